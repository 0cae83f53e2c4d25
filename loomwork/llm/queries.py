"""The queries of this subpackage, for the driver's registry, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import context_mix, decontam, ext_hash, license_dice, line_templates, packing, periodic_runs, pipeline, quality_bt, simhash_tiles, site_tree, sstable, token_alignment, weak_rules

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bt.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge(table(spark, sf_dir, "documents"))


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mix.score(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_dice.scan(table(spark, sf_dir, "documents"))


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op8_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tiles.near_duplicates(table(spark, sf_dir, "documents"))


def op9_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ext_hash.shard(table(spark, sf_dir, "documents"))


def op10_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find(periodic_runs.with_planted(table(spark, sf_dir, "documents"))))


def op12_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.digest(site_tree.extract(table(spark, sf_dir, "pages")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digest(token_alignment.align(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Query]:
    ops = (op1_quality_bradley_terry, op2_quality_rules, op3_context_mixing, op4_decontamination, op5_license_scan, op6_sum_of_squares_packing, op7_line_templates, op8_simhash_tiles, op9_extendible_sharding, op10_sstable_tokens, op11_periodic_runs, op12_site_style_tree, op13_token_alignment)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline.run}


#: op4: exact containment over all documents and items. Items of fewer than five words are left to the tests.
_DECONTAMINATION = r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
    d AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 4], ' ') for i in generate_series(1, len(w) - 4)]) AS s FROM w WHERE len(w) >= 5),
    b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
    i AS (SELECT DISTINCT item_id, unnest([array_to_string(w[i:i + 4], ' ') for i in generate_series(1, len(w) - 4)]) AS s FROM b WHERE len(w) >= 5),
    q AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1),
    f AS (SELECT doc_id, item_id, count(*) AS n_found FROM d JOIN i USING (s) GROUP BY ALL)
    SELECT doc_id, item_id, n AS n_shingles, n_found, n_found::DOUBLE / n AS containment FROM f JOIN q USING (item_id) WHERE n_found >= 0.8 * n
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": _DECONTAMINATION, "op5_license_scan": license_dice.oracle_sql(), "op9_extendible_sharding": ext_hash.oracle_sql()}

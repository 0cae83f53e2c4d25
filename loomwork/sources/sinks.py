"""Writers of splits, evaluation artifacts and failure reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators.gates import manifest, write_json
from loomwork.sources.files import write_jsonl


def write_splits(df: DataFrame, folder: str, columns: tuple[str, ...], split: str = "split", order: str = "_ord") -> None:
    """JSON lines below split=<name>, in order within each file and over the files of a split by name; an existing folder is refused.

    Rows are range-partitioned by split and order, so a large split is written by many tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, split, order).sortWithinPartitions(split, order).select(split, F.to_json(F.struct(*columns)).alias("value"))
    rows.write.mode("errorifexists").partitionBy(split).text(folder)


def write_manifest(df: DataFrame, path: str, split: str, key: str, seed: int) -> dict:
    """Counts, bounds and an order-free digest of each split as one JSON document; returns what it wrote."""
    value = {"seed": seed, "splits": {r[split]: {"n": r["n"], "first": r["first"], "last": r["last"], "digest": r["digest"]} for r in manifest(df, split, key, seed).collect()}}
    write_json(path, value)
    return value


def write_evaluation(predictions: DataFrame, folder: str, *, protected: bool = False, correct: str = "primary_correct") -> None:
    """Predictions, and the wrong ones beside them unless the split is protected."""
    columns = tuple(predictions.columns)
    write_jsonl(predictions, f"{folder}/predictions", columns, columns[0])
    if not protected:
        write_jsonl(predictions.filter(~F.coalesce(F.col(correct), F.lit(False))), f"{folder}/error_cases", columns, columns[0])


def raw_copy(spark, source: str, folder: str) -> str:
    """The files of source below folder/raw, byte for byte, by Hadoop's file system; one that is there stays."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    origin = jvm.org.apache.hadoop.fs.Path(source)
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/raw", origin.getName())
    if not target.getFileSystem(conf).exists(target):
        jvm.org.apache.hadoop.fs.FileUtil.copy(origin.getFileSystem(conf), origin, target.getFileSystem(conf), target, False, conf)
    return target.toString()


def output_folder(spark: SparkSession, folder: str, resume: str | None = None) -> str:
    """A folder to write to: a new one is made, one that is there is refused, unless work goes on from a folder inside of it. On any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    whole = fs.makeQualified(path(folder))
    if not fs.exists(whole):
        if resume is not None:
            raise FileNotFoundError(f"cannot go on: {folder} does not exist")
        fs.mkdirs(whole)
        return whole.toString()
    if resume is None:
        raise FileExistsError(f"{folder} exists")
    inside = fs.makeQualified(path(resume))
    above = inside
    while above is not None and above.toString() != whole.toString():
        above = above.getParent()
    if above is None:
        raise ValueError(f"{resume} is not inside of {folder}")
    if not fs.exists(inside) or not fs.getFileStatus(inside).isDirectory():
        raise FileNotFoundError(f"{resume} is no folder")
    return whole.toString()


def open_split(split: str, allow_test: bool = False) -> str:
    """The name of a split that may be evaluated: validation, or test where that is said outright."""
    if split not in ("validation", "test"):
        raise ValueError("an evaluation takes the validation or the test split")
    if split == "test" and not allow_test:
        raise ValueError("the test split is protected; allow it outright")
    return split


def write_debug_traces(solved: DataFrame, folder: str, columns: tuple[str, ...] = ("pid", "task_type", "rule", "error")) -> None:
    """What the solvers said, beside the training rows and never among them."""
    write_jsonl(solved, f"{folder}/debug/raw_traces", columns, columns[0])


def write_smoke(train: DataFrame, dev: DataFrame, folder: str, columns: tuple[str, ...]) -> None:
    """A sampled training set, and the dev rows as its validation."""
    write_jsonl(train, f"{folder}/train", columns)
    write_jsonl(dev, f"{folder}/validation", columns)


def require(df: DataFrame, error: str, report: str) -> DataFrame:
    """df, where no row has an error; else the counts are written to the report first and ValueError follows."""
    bad = {r[0]: r[1] for r in df.filter(F.col(error).isNotNull()).groupBy(error).count().collect()}
    if bad:
        write_json(report, {"status": "failed", "errors": bad})
        raise ValueError(f"{sum(bad.values())} invalid rows; see {report}")
    return df


def write_exclusions(rows: DataFrame, folder: str, max_length: int) -> None:
    """split, id and reason of every excluded row as JSON lines, each with the length that the audit was made for."""
    rows.select(F.to_json(F.struct("split", "id", "reason", F.lit(max_length).alias("max_length"))).alias("value")).write.mode("errorifexists").text(folder)


def read_exclusions(spark: SparkSession, folder: str, max_length: int, id_type: str = "string") -> DataFrame:
    """split, id, reason of an audit made for the same length; another length is an error."""
    rows = spark.read.text(folder).select(F.from_json("value", f"split string, id {id_type}, reason string, max_length int").alias("r")).select("r.*")
    other = rows.filter(~F.col("max_length").eqNullSafe(F.lit(max_length))).select("max_length").head(1)
    if other:
        raise ValueError(f"the audit is for max_length {other[0][0]}, not {max_length}")
    return rows.drop("max_length")

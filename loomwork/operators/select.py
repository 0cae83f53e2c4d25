"""Quota-greedy selection under global dedup.

Buckets are filled in order. A bucket takes the first rows whose hash no earlier pick has, until its quota is met; rows
that it never reaches claim nothing, so a later bucket may still take them. That is why one global row_number would
give other rows.

All buckets are filled at once, in rounds. A bucket reads its rows, one a hash, down to a depth: at first its quota. Where buckets that read as deep as they do meet
at one hash, the first of them takes it; it would whatever the others did, since only an earlier bucket could take it away and would keep it from them
too. A bucket goes on by as many rows as it lost. Depths only grow, and once none does, each bucket has its quota, or all it can get: the rows
that filling one after the other gives. A round is one count over the hashes that several buckets have; the driver sees a number a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.session import settle, tidy
from loomwork.operators.split import rank_within

#: Rounds after which selection is taken for stuck.
ROUNDS = 1000


def _of(values: dict[str, int], bucket: Column) -> Column:
    return F.coalesce(*[F.when(bucket == b, F.lit(v)) for b, v in values.items()])


def quota_rounds(pools: DataFrame, quotas: dict[str, int], *, bucket: str = "bucket", key: str = "hash", order: str = "_ord") -> tuple[DataFrame, int]:
    """The rows picked, and how many rounds it took; a quota of 0 still picks one row where it can.

    Rows of one bucket and key are one, the first; a null key is no other row's key. Rows of other buckets are left out.
    """
    if not quotas:
        return pools.limit(0), 0
    place = {b: i for i, b in enumerate(quotas)}
    rows = pools.filter(F.col(bucket).isin(*quotas))
    first = rows.groupBy(F.col(bucket).alias("b"), F.col(key).alias("k"), F.when(F.col(key).isNull(), F.col(order)).alias("alone")).agg(F.min(order).alias("o"))
    ranked = settle(rank_within(first.withColumn("i", _of(place, F.col("b"))), "b", "o").select("b", "k", "o", "i", "rank"))
    # Hashes of one bucket alone are never lost, and take no part in the rounds.
    shared = ranked.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    shared = settle(ranked.join(shared, "k", "left_semi").select("k", "i", "rank", "b"))
    wanted = {b: max(1, q) for b, q in quotas.items()}
    depth, lost = dict(wanted), {}
    for n in range(1, ROUNDS + 1):
        reached = shared.filter(F.col("rank") <= _of(depth, F.col("b")))
        losers = reached.groupBy("k").agg(F.array_sort(F.collect_list("i")).alias("all")).filter(F.size("all") > 1).select("k", F.explode(F.slice("all", F.lit(2), F.size("all"))).alias("i"))
        lost = {r[0]: r[1] for r in losers.groupBy("i").count().collect()}
        now = {b: q + lost.get(place[b], 0) for b, q in wanted.items()}
        if now == depth:
            break
        depth = now
    else:
        raise RuntimeError("selection did not settle")
    picked = ranked.filter(F.col("rank") <= _of(depth, F.col("b"))).join(losers, ["k", "i"], "left_anti").select(F.col("b").alias(bucket), F.col("o").alias(order))
    out = settle(rows.join(picked, [bucket, order], "left_semi"))
    tidy(pools.sparkSession)
    return out, n


def quota_select(pools: DataFrame, quotas: dict[str, int], *, bucket: str = "bucket", key: str = "hash", order: str = "_ord") -> DataFrame:
    """The rows picked (see ``quota_rounds``). ``order`` tells the rows of a bucket apart."""
    return quota_rounds(pools, quotas, bucket=bucket, key=key, order=order)[0]


def shortages(picked: DataFrame, quotas: dict[str, int], bucket: str = "bucket") -> dict[str, tuple[int, int]]:
    """Buckets that got fewer rows than their quota: (got, quota)."""
    have = {r[0]: r[1] for r in picked.groupBy(bucket).count().collect()}
    return {b: (have.get(b, 0), q) for b, q in quotas.items() if have.get(b, 0) < q}


def require_filled(picked: DataFrame, quotas: dict[str, int], bucket: str = "bucket") -> DataFrame:
    if short := shortages(picked, quotas, bucket):
        raise ValueError("not enough candidates: " + ", ".join(f"{b} {g}/{q}" for b, (g, q) in short.items()))
    return picked


def effective_quotas(quotas: dict[str, int], available: dict[str, int], external: tuple[str, ...], fallback: str) -> dict[str, int]:
    """What external categories lack moves to the fallback category; the total stays."""
    out = dict(quotas)
    for c in external:
        have = min(out[c], available.get(c, 0))
        out[fallback] += out[c] - have
        out[c] = have
    return out


def apportioned(rows: DataFrame, levels: tuple[str, ...], total: int | dict[str, int], *keys: Column | str) -> DataFrame:
    """A sample of total rows, dealt over nested levels by largest remainder, as a table of quotas joined to ranks.

    At each level a group's rows are shared out among its parts: to each part its share cut off, the rows left over to the largest remainders (ties: the part's
    name). total may give the parts of the first level their numbers by name; what a part is too small for goes to the others, by largest remainder over what they have
    left. Within a part of the last level rows are taken in the order of ``keys``, which tell them apart.
    Quotas are a row a group, counted and dealt in the driver; rows are ranked in range partitions, so no group is one task's. Null names are a part like others.
    """
    sizes = {tuple(r[: len(levels)]): r["__n"] for r in rows.groupBy(*levels).agg(F.count("*").alias("__n")).collect()}
    quotas = {k: q for k, q in _deal(sizes, total).items() if q}
    if not quotas:
        return rows.limit(0)
    names = [f"__l{i}" for i in range(len(levels))]
    schema = ", ".join(f"{n} {rows.schema[c].dataType.simpleString()}" for n, c in zip(names, levels, strict=True))
    table = rows.sparkSession.createDataFrame([(*k, q) for k, q in quotas.items()], f"{schema}, __quota long")
    stratum = F.to_json(F.struct(*levels), {"ignoreNullFields": "false"})
    ranked = rank_within(rows.withColumn("__stratum", stratum), "__stratum", *keys)
    same = [ranked[c].eqNullSafe(table[n]) for c, n in zip(levels, names, strict=True)]
    # A row a group: bounded by the names of the levels, as the counts above are.
    return ranked.join(F.broadcast(table), same).filter(F.col("rank") <= F.col("__quota")).drop("__stratum", "rank", "__quota", *names)


def _shares(sizes: dict, total: int) -> dict:
    """total over parts by largest remainder of their sizes, none above its size."""
    whole = sum(sizes.values())
    total = min(total, whole)
    if not total:
        return dict.fromkeys(sizes, 0)
    out = {k: total * n // whole for k, n in sizes.items()}
    # A remainder is left only where the share is below the size, so one more fits.
    by_rest = sorted(sizes, key=lambda k: (-(total * sizes[k] % whole), k is None, str(k)))
    for k in by_rest[: total - sum(out.values())]:
        out[k] += 1
    return out


def _deal(sizes: dict[tuple, int], total: int | dict[str, int]) -> dict[tuple, int]:
    """Quotas of nested groups: by the first level, then within each of its parts by the rest."""
    parts: dict = {}
    for k, n in sizes.items():
        parts.setdefault(k[0], {})[k[1:]] = n
    whole = {k: sum(v.values()) for k, v in parts.items()}
    if isinstance(total, dict):
        upper = {k: min(total.get(k, 0), n) for k, n in whole.items()}
        more = _shares({k: n - upper[k] for k, n in whole.items()}, sum(total.values()) - sum(upper.values()))
        upper = {k: q + more[k] for k, q in upper.items()}
    else:
        upper = _shares(whole, total)
    out = {}
    for k, v in parts.items():
        below = {(): upper[k]} if () in v else _deal(v, upper[k])
        out |= {(k, *rest): q for rest, q in below.items()}
    return out

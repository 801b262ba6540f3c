"""Samples and splits by stable orders: equal on every run and every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored


def systematic_sample(df: DataFrame, n: int, order: str, start: float = 1.0, total: int | None = None) -> DataFrame:
    """Rows number int(start + i * N / n), i = 0..n-1, in the given order (numbers from 1); ties go by a hash of the row.

    Only the order and that hash are range-partitioned.  They are written once with the partition that each row fell
    into, so that the rows' numbers and the counts before each partition come from one and the same division.  The
    numbers that are hit (n of them at most) are then looked up in df by a broadcast; no task sorts everything, and wide
    columns are never shuffled.
    """
    mark = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])
    keys = df.select(F.col(order).alias("o"), mark.alias("h")).repartitionByRange("o", "h").withColumn("p", F.spark_partition_id())
    keys = stored(df.sparkSession, keys, "order")
    sizes = keys.groupBy("p").agg(F.count("*").alias("n"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    offsets = sizes.select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = keys.count() if total is None else total
    if n > rows:
        raise ValueError(f"sample of {n} from {rows} rows")
    step = rows / n
    number = F.row_number().over(Window.partitionBy("p").orderBy("o", "h")) + F.col("offset")
    numbered = keys.join(F.broadcast(offsets), "p").withColumn("k", number)
    # row k is hit if some i has int(start + i * step) = k
    i = F.ceil((F.col("k") - F.lit(start)) / F.lit(step))
    hit = (i >= 0) & (i < n) & (F.floor(F.lit(start) + i * F.lit(step)) == F.col("k"))
    wanted = numbered.where(hit).groupBy("o", "h").agg(F.count("*").alias("times"))
    # rows of one order and hash are equal: one of them, as often as it was hit
    columns = [F.col(f"`{c}`") for c in df.columns]
    marked = df.select(F.struct(*columns).alias("r"), F.col(order).alias("ro"), mark.alias("rh"))
    found = marked.join(F.broadcast(wanted), F.col("ro").eqNullSafe(F.col("o")) & (F.col("rh") == F.col("h")))
    one = found.groupBy("o", "h").agg(F.first("r").alias("r"), F.first("times").alias("times"))
    return one.select("r", F.explode(F.sequence(F.lit(1), F.col("times")))).select("r.*")


def _hashed(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash of the key (a top-k, not a full sort)."""
    return df.orderBy(_hashed(key, seed), key).limit(n)


def stratified_split(df: DataFrame, stratum: str, key: str, fraction: float = 0.4, seed: int = 42) -> DataFrame:
    """df with ``split``: dev for the first round(fraction * n) rows of each stratum in hash order, else train.

    Counts per stratum and hash prefix (65,536 at most for a stratum) tell in which prefix the cut falls; only that
    prefix's rows are ranked, and the cut's hash and key decide every row where it stands.  Keys are unique in a stratum.
    """
    rows = df.select(F.col(stratum).alias("s"), F.col(key).alias("k"), _hashed(key, seed).alias("h"))
    bins = rows.groupBy("s", F.substring("h", 1, 4).alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("s")
    upto = F.sum("n").over(w.orderBy("b"))
    bins = bins.select("s", "b", "n", upto.alias("upto"), F.floor(F.sum("n").over(w) * fraction + 0.5).alias("cut"))
    edge = bins.where((F.col("upto") >= F.col("cut")) & (F.col("upto") - F.col("n") < F.col("cut")))
    edge = edge.select(F.col("s").alias("es"), F.col("b").alias("eb"), (F.col("cut") - F.col("upto") + F.col("n")).alias("need"))
    ranked = rows.join(edge, F.col("s").eqNullSafe(F.col("es")) & (F.substring("h", 1, 4) == F.col("eb")))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("h", "k")))
    cuts = ranked.where("r = need").select(F.col("s").alias("__s"), F.col("h").alias("__h"), F.col("k").alias("__k"))
    own = _hashed(key, seed)
    dev = (own < F.col("__h")) | ((own == F.col("__h")) & (F.col(key) <= F.col("__k")))
    out = df.join(cuts, F.col(stratum).eqNullSafe(F.col("__s")), "left")
    return out.withColumn("split", F.when(dev, "dev").otherwise("train")).drop("__s", "__h", "__k")


def first_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def cap_groups(df: DataFrame, group: str, n: int = 50, seed: int = 42) -> DataFrame:
    """Rows of at most n groups, drawn in hash order."""
    drawn = hash_sample(df.select(group).distinct(), n, group, seed)
    return df.join(drawn, group, "left_semi")

"""Row numbers over a whole table, and samples by quota: exact, repeatable, without one task that holds a stratum."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsight.sources.sinks import scratch

#: Parts over which a stratum is ranked first.
PARTS = 64


def numbered(df: DataFrame, *order, name: str = "__n") -> DataFrame:
    """``df`` with each row's number in that order, from 0 on. The order should be unique, or equal rows are one task's.

    Rows are dealt by ranges and sorted within them; a row's number is its place in its range and the sizes of those
    before. Written in between, so that both come from one and the same dealing.
    """
    at = scratch(df.sparkSession)
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()).write.parquet(at)
    held = df.sparkSession.read.parquet(at)
    part = F.shiftright("__at", 33)
    sizes = held.groupBy(part.alias("__p")).agg(F.count("*").alias("__size"))
    # a row for each range
    before = sizes.select("__p", (F.sum("__size").over(Window.orderBy("__p")) - F.col("__size")).alias("__before"))
    out = held.withColumn("__p", part).join(F.broadcast(before), "__p")
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__p", "__at", "__before")


def _hash(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def largest_remainder(shares: DataFrame, by: list[str], weight: str, total: int) -> DataFrame:
    """``by, quota``: ``total`` in proportion to the weights, whole numbers by largest remainder, ties in order of ``by``.

    ``shares`` has a row for each stratum, as many as the ratios name, so one small window does.
    """
    whole = shares.withColumn("__ideal", F.lit(total) * F.col(weight) / F.sum(weight).over(Window.partitionBy()))
    # a ratio's last bits must not decide where equal remainders meet
    parts = whole.withColumns({"__floor": F.floor(F.round("__ideal", 9)).cast("long"), "__rest": F.round("__ideal", 9) - F.floor(F.round("__ideal", 9))})
    left = F.lit(total) - F.sum("__floor").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("__rest"), *by))
    return parts.select(*by, (F.col("__floor") + F.when(rank <= left, 1).otherwise(0)).alias("quota"))


def quotas(spark, ratios: dict[str, dict[str, float]], total: int) -> DataFrame:
    """D-02: a quota for each combination of the dimensions' values, by the product of their ratios."""
    names = list(ratios)
    rows = []
    for values in product(*(ratios[n] for n in names)):
        weight = 1.0
        for n, v in zip(names, values):
            weight *= ratios[n][v]
        rows.append((*values, float(weight)))
    shares = spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names) + ", __weight double")
    return largest_remainder(shares, names, "__weight", total)


def by_quota(df: DataFrame, quota: DataFrame, by: list[str], key: str, trend: Column | None = None, floor_percent: int = 20, most: int | None = None) -> DataFrame:
    """D-02: of each stratum its ``quota`` of rows, by hash rank of the key.

    With ``trend``, at least ``floor_percent`` of a quota, rounded up, are rows of it as far as there are any: these stand
    first, then all others by hash. A stratum with fewer rows than its quota gives all. No stratum is one task's: the
    first ``most`` rows of each of ``PARTS`` parts are ranked alone, and only they meet; ``most`` is at least the largest
    quota, which is looked up if it is not told.
    """
    most = most if most is not None else (quota.agg(F.max("quota")).first()[0] or 0)
    rows = df.join(F.broadcast(quota), by).withColumns({"__h": _hash(key), "__trend": F.coalesce(trend, F.lit(False)) if trend is not None else F.lit(False)})
    rows = rows.withColumn("__part", F.pmod(F.crc32("__h"), F.lit(PARTS)))
    few = Window.partitionBy(*by, "__trend", "__part").orderBy("__h", key)
    rows = rows.withColumn("__rank", F.row_number().over(few)).where(F.col("__rank") <= most)
    own = Window.partitionBy(*by, "__trend").orderBy("__h", key)
    first = F.col("__trend") & (F.col("__own") <= F.ceil(F.col("quota") * floor_percent / 100))
    rows = rows.withColumn("__own", F.row_number().over(own)).withColumn("__late", ~first)
    last = Window.partitionBy(*by).orderBy("__late", "__h", key)
    return rows.withColumn("__rank", F.row_number().over(last)).where(F.col("__rank") <= F.col("quota")).select(*df.columns)


def stratified_split(df: DataFrame, by: list[str], key: str, holdout_percent: int = 25) -> DataFrame:
    """D-07: ``split`` by hash rank within each stratum: ``holdout_percent`` of it, rounded, and one row at least where it
    has two, so that both sides cover every stratum. A row alone in its stratum is for development."""
    placed = numbered(df.withColumn("__h", _hash(key)), *by, "__h", key)
    sizes = placed.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min("__n").alias("__first"), F.count("*").alias("__size"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    held = F.when(F.col("__size") < 2, 0).otherwise(F.greatest(F.lit(1), F.round(F.col("__size") * holdout_percent / 100)))
    split = F.when(F.col("__n") - F.col("__first") < held, "holdout").otherwise("dev").alias("split")
    return placed.join(sizes, same, "left").select(*df.columns, split)

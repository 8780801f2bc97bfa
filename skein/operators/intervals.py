"""Interval, band and as-of joins, merging, islands and runs over (media, s, e) relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, key: str, bucket: float, slack: float = 0.0, strict: bool = False) -> DataFrame:
    """Pairs with equal keys whose [s, e] overlap; columns l.*, r.* as structs.

    Each interval is posted in the buckets of time it touches, so a hot key spreads over as many
    partitions as it has buckets; a pair is kept in the first bucket that both touch.
    """
    at = lambda c: F.floor(c / bucket).cast("long")
    posted = lambda d, n, pad: d.select(F.struct("*").alias(n), F.col(key).alias("k"), F.explode(F.sequence(at(F.col("s") - pad), at(F.col("e") + pad))).alias("b"))
    both = posted(left, "l", slack).join(posted(right, "r", 0.0), ["k", "b"])
    ls, le, rs, re = F.col("l.s") - slack, F.col("l.e") + slack, F.col("r.s"), F.col("r.e")
    meets = (ls < re) & (le > rs) if strict else (ls <= re) & (le >= rs)
    return both.where(meets & (F.col("b") == F.greatest(at(ls), at(rs)))).select("l", "r")


def merge_intervals(d: DataFrame, key: str, gap: float = 0.0) -> DataFrame:
    """Unions of intervals that touch or lie within `gap`, with the number merged."""
    w = Window.partitionBy(key).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("new", F.when(reach.isNull() | (F.col("s") - reach > gap), 1).otherwise(0))
    d = d.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(key, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n")).drop("island")


def complement(merged: DataFrame, key: str) -> DataFrame:
    """What lies between merged intervals."""
    w = Window.partitionBy(key).orderBy("s")
    return merged.select(key, F.col("e").alias("s"), F.lead("s").over(w).alias("e")).where("e is not null and e > s")


def islands(d: DataFrame, key: str, order: list[Column | str], same: Column) -> DataFrame:
    """d with `island`: a number that steps where `same` (over the row and its lag) is not true."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.row_number().over(w) == 1
    return d.withColumn("island", F.sum(F.when(first | ~F.coalesce(same, F.lit(False)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], direction: str = "backward") -> DataFrame:
    """left with the right row's values last at or before (or first at or after) its time, by one sort of the union."""
    one = left.select(key, time, F.lit(1).alias("side"), F.struct("*").alias("row"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("v"))
    two = right.select(key, time, F.lit(0 if direction == "backward" else 2).alias("side"), F.lit(None).cast(one.schema["row"].dataType).alias("row"), F.struct(*values).alias("v"))
    order = Window.partitionBy(key).orderBy(time, "side")
    if direction == "backward":
        near = F.last("v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    else:
        near = F.first("v", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return one.unionByName(two).withColumn("near", near).where("side = 1").select("row.*", "near")


def tumbling(d: DataFrame, size: float, end: str = "duration") -> DataFrame:
    """Fixed windows over each row's duration, the last cut short, one at least."""
    n = F.greatest(F.ceil(F.col(end) / size), F.lit(1)).cast("int")
    d = d.withColumn("idx", F.explode(F.sequence(F.lit(0), n - 1)))
    return d.withColumn("w_start", F.col("idx") * F.lit(size)).withColumn("w_end", F.least((F.col("idx") + 1) * F.lit(size), F.col(end)))


def hopping(d: DataFrame, size: float, step: float, end: str = "duration") -> DataFrame:
    """Windows of `size` every `step`, up to the first that reaches the end."""
    n = F.greatest(F.ceil((F.col(end) - size) / step), F.lit(0)).cast("int")
    d = d.withColumn("idx", F.explode(F.sequence(F.lit(0), n)))
    return d.withColumn("w_start", F.col("idx") * F.lit(step)).withColumn("w_end", F.least(F.col("idx") * F.lit(step) + size, F.col(end)))

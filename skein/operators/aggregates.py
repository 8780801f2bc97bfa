"""Aggregations, window folds, ranking and set operations of the archive pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace


def mode_first(d: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Most frequent value of each key; of equals the one seen first."""
    counts = d.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("seen"))).alias("mode"), F.max("n").alias("n"))


def ordered_distinct_ci(d: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Values without regard to case, first spelling, in first-seen order, as one text."""
    first = d.groupBy(key, F.lower(value).alias("low")).agg(F.min_by(value, order).alias("spelling"), F.min(order).alias("seen"))
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seen", "spelling"))), lambda x: x["spelling"]), ",").alias("vals"), F.count("*").alias("n"))


def last_wins(d: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def weighted_median(d: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """First value whose cumulative weight reaches half of the total."""
    w = Window.partitionBy(key).orderBy(value, weight).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("cum", F.sum(weight).over(w)).withColumn("total", F.sum(weight).over(Window.partitionBy(key)))
    return d.where("cum >= total / 2").groupBy(key).agg(F.min(value).alias("median"))


def median_deviation(d: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """Weighted median of each key, and the weighted median of the distances from it."""
    median = weighted_median(d, key, value, weight)
    away = d.join(median, key).select(key, F.abs(F.col(value) - F.col("median")).alias("away"), F.col(weight).alias("weight"))
    return median.join(weighted_median(away, key, "away", "weight").withColumnRenamed("median", "mad"), key)


def share_and_rank(d: DataFrame, group: str, member: str, amount: str) -> DataFrame:
    """Each member's share of its group's total, and its place by share."""
    total = d.groupBy(group, member).agg(F.sum(amount).alias("amount"))
    w = Window.partitionBy(group)
    total = total.withColumn("share", F.col("amount") / F.sum("amount").over(w))
    return total.withColumn("rank", F.rank().over(w.orderBy(F.desc("amount"))))


def set_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison of two versions: added, removed, changed, same."""
    a, b = before.select(key, F.col(value).alias("old"), F.lit(1).alias("l")), after.select(key, F.col(value).alias("new"), F.lit(1).alias("r"))
    what = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, what.alias("what"))


def grouping_report(d: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Overall and one row per value of each key: grouping sets ((), (k1), (k2), ...)."""
    sets = [[], *([F.col(k)] for k in keys)]
    return d.groupingSets(sets, *[F.col(k) for k in keys]).agg(*aggregates)


def calibrated_floors(d: DataFrame, observed: str = "precision", floor: str = "floor", target: str = "target", n: str = "n", low: Column | float = 0.5, high: Column | float = 0.99) -> DataFrame:
    """Policy floors moved by observed precision: up by half the gap (0.15 at most), down by a quarter of the surplus (0.05 at most), with eight observations or more, within an action's bounds."""
    low, high = (F.lit(x) if isinstance(x, float) else x for x in (low, high))
    gap = F.col(target) - F.col(observed)
    moved = F.when(gap > 0, F.col(floor) + F.least(F.lit(0.15), 0.5 * gap)).otherwise(F.col(floor) - F.least(F.lit(0.05), -0.25 * gap))
    return d.withColumn("new_floor", F.when(F.col(n) >= 8, F.greatest(low, F.least(high, moved))).otherwise(F.col(floor)))


def overrides(log: DataFrame, target: str, order: str, actor: str, verdict: str) -> DataFrame:
    """Human refutations whose target a machine had confirmed last before."""
    w = Window.partitionBy(target).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col(actor) == "machine", F.col(verdict)), ignorenulls=True).over(w)
    return log.withColumn("before", before).where((F.col(actor) == "human") & (F.col(verdict) == "refute") & (F.col("before") == "confirm"))


def stratified_sample(d: DataFrame, stratum: list[str], key: str, weight: Column, n: int, seed: int = 0) -> DataFrame:
    """Weighted sampling without replacement in each stratum, drained round robin: order by place in the stratum."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    w = Window.partitionBy(*stratum).orderBy(F.desc(F.ln(u) / weight), key)
    return d.withColumn("place", F.row_number().over(w)).orderBy("place", *stratum).limit(n)


def fuse_log_odds(scores: dict[str, tuple[Column, float]], prior: float = 0.08, blocked: Column | None = None) -> Column:
    """Posterior of weighted evidence: logit of the prior plus weighted logits, clipped; fewer than two present cap at 0.65, a block at 0.2."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0.02)), F.lit(0.98))
    total, present = F.ln(F.lit(prior / (1 - prior))), F.lit(0)
    for c, w in scores.values():
        total = total + F.when(c.isNull(), 0.0).otherwise(w * F.ln(clip(c) / (1 - clip(c))))
        present = present + c.isNotNull().cast("int")
    p = 1 / (1 + F.exp(-total))
    p = F.when(present < 2, F.least(p, F.lit(0.65))).otherwise(p)
    return p if blocked is None else F.when(blocked, F.least(p, F.lit(0.2))).otherwise(p)


def edges(d: DataFrame, subject: str, predicate: str, object_: str, undirected: bool = True, evidence: str | None = None) -> DataFrame:
    """Upserted edges: mean confidence, distinct events, extent in time; weight 0.16 an event, duration, 0.04 an evidence id (0.2 at most) and confidence, 1 at most."""
    a, b = (F.least(subject, object_), F.greatest(subject, object_)) if undirected else (F.col(subject), F.col(object_))
    cited = F.count_distinct(evidence) if evidence else F.lit(0)
    e = d.groupBy(a.alias("subject"), F.col(predicate).alias("predicate"), b.alias("object")).agg(F.avg(F.coalesce("conf", F.lit(0.5))).alias("confidence"), F.count_distinct("event").alias("n_events"), cited.alias("n_evidence"), F.min("s").alias("s"), F.max("e").alias("e"))
    weight = 0.16 * F.col("n_events") + F.least((F.col("e") - F.col("s")) / 1800, F.lit(0.25)) + F.least(0.04 * F.col("n_evidence"), F.lit(0.2)) + 0.25 * F.col("confidence")
    return e.withColumn("weight", F.least(F.lit(1.0), weight))


def latest_patch(log: DataFrame, target: str, field: str, value: str, order: str, superseded: str) -> DataFrame:
    """Event-sourced corrections: the last live value of each target and field."""
    return log.where(~F.col(superseded)).groupBy(target, field).agg(F.max_by(value, order).alias("value"))


def transitive(merges: DataFrame, work: Workspace | None = None) -> DataFrame:
    """src -> dst at the end of its chain of merges, by pointer doubling: rounds are logarithmic in the number of merges.

    Each round joins a merge with the one that its end is the source of, and keeps the least id met.
    Where merges run in a circle, its members and what leads to it end at the circle's least id.
    """
    work = work or Workspace(merges.sparkSession, "transitive")
    m = merges.where("src <> dst").groupBy("src").agg(F.min("dst").alias("dst"))
    m = work.save(m.withColumn("low", F.least("src", "dst")), "merges-0")
    rounds = max(1, m.count()).bit_length() + 1
    for k in range(rounds):
        on = m.select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("low").alias("beyond"))
        if not m.join(on, "dst", "left_semi").limit(1).count():
            return m.select("src", "dst")
        m = m.join(on, "dst", "left").select("src", F.coalesce("next", "dst").alias("dst"), F.least("low", "beyond").alias("low"))
        m = work.save(m, f"merges-{k + 1}")
        work.drop(f"merges-{k}")
    # what still ends at a source is on a circle, all of which that source's least id has seen
    on = m.select(F.col("src").alias("dst"), F.col("low").alias("circle"))
    return m.join(on, "dst", "left").select("src", F.coalesce("circle", "dst").alias("dst")).where("src <> dst")

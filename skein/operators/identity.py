"""Entities: groups of mentions, name pairs, co-presence, merge candidates, places, capture years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import semantics as sem
from . import aggregates as agg


def groups(mentions: DataFrame, label: str, event: str, order: str) -> DataFrame:
    """One row an entity key: its first spelling, all spellings, events, extent, mentions and mean confidence."""
    m = mentions.withColumn("key", sem.normalize_key(F.col(label))).where("key <> ''")
    spellings = agg.ordered_distinct_ci(m, "key", label, order).withColumnRenamed("vals", "aliases").drop("n")
    whole = m.groupBy("key").agg(F.min_by(label, order).alias("label"), F.count_distinct(event).alias("n_events"), F.count("*").alias("mentions"), F.min("s").alias("first_s"), F.max("e").alias("last_e"), F.avg("conf").alias("confidence"))
    return whole.join(spellings, "key")


def name_score(a: Column, b: Column) -> Column:
    """1 for equal names, 0.92 for one spelling key, 0.85 for a common stem, 0.6 and more for 0.8 and more of edit similarity, else 0."""
    x, y = sem.normalize_key(a), sem.normalize_key(b)
    stem = lambda c: F.regexp_replace(c, "(ochka|enka|ushka|ette|ina|ie|y|a)$", "")
    same = (stem(x) == stem(y)) & (F.length(stem(x)) >= 3)
    alike = sem.edit_similarity(x, y)
    return F.when(x == y, 1.0).when(sem.spelling_key(a) == sem.spelling_key(b), 0.92).when(same, 0.85).when(alike >= 0.8, 0.6 + (alike - 0.8)).otherwise(0.0)


def co_presence(seen: DataFrame, entity: str, frame: str) -> DataFrame:
    """a, b, frames: entities seen in one frame twice or more, and so two and not one."""
    s = seen.select(F.col(entity).alias("x"), F.col(frame).alias("f")).distinct()
    j = s.alias("l").join(s.alias("r"), F.expr("l.f = r.f and l.x < r.x"))
    return j.groupBy(F.col("l.x").alias("a"), F.col("r.x").alias("b")).agg(F.count("*").alias("frames")).where("frames >= 2")


def shared_clusters(links: DataFrame, entity: str, cluster: str, confidence: str) -> DataFrame:
    """a, b, score: half, and half of the best smaller confidence, for entities linked to one cluster."""
    best = links.groupBy(F.col(entity).alias("x"), F.col(cluster).alias("c")).agg(F.max(confidence).alias("w"))
    j = best.alias("l").join(best.alias("r"), F.expr("l.c = r.c and l.x < r.x"))
    return j.groupBy(F.col("l.x").alias("a"), F.col("r.x").alias("b")).agg((0.5 + 0.5 * F.max(F.least("l.w", "r.w"))).alias("score"))


def co_occurrence(seen: DataFrame, entity: str, event: str) -> DataFrame:
    """a, b, score: 0.5 and the Jaccard similarity of their events, 0.85 at most, for entities that share one."""
    s = seen.select(F.col(entity).alias("x"), F.col(event).alias("v")).distinct()
    size = s.groupBy("x").agg(F.count("*").alias("n"))
    j = s.alias("l").join(s.alias("r"), F.expr("l.v = r.v and l.x < r.x")).groupBy(F.col("l.x").alias("a"), F.col("r.x").alias("b")).agg(F.count("*").alias("both"))
    j = j.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    return j.select("a", "b", F.least(F.lit(0.85), 0.5 + F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("score"))


def merge_candidates(dimensions: dict[str, tuple[DataFrame, float]], blocked: DataFrame, k: int = 60) -> DataFrame:
    """The k likeliest pairs, fused from dimensions (a, b, score) and their weights; blocked pairs (a, b) are capped."""
    whole = None
    for name, (d, _) in dimensions.items():
        d = d.select("a", "b", F.col("score").alias(name))
        whole = d if whole is None else whole.join(d, ["a", "b"], "full_outer")
    whole = whole.join(blocked.select("a", "b", F.lit(True).alias("block")), ["a", "b"], "left")
    p = agg.fuse_log_odds({n: (F.col(n), w) for n, (_, w) in dimensions.items()}, blocked=F.coalesce("block", F.lit(False)))
    return whole.select("a", "b", F.round(p, 9).alias("p")).orderBy(F.desc("p"), "a", "b").limit(k)


def candidate_confidence(signals: DataFrame, keys: list[str], signal: str, event: str) -> DataFrame:
    """Strongest signal, plus 0.12 of the sum of all (0.18 at most) and 0.03 an event beyond the first (0.09 at most), 1 at most."""
    g = signals.groupBy(*keys).agg(F.max(signal).alias("top"), F.sum(signal).alias("total"), F.count_distinct(event).alias("n_events"))
    return g.withColumn("confidence", F.least(F.lit(1.0), F.col("top") + F.least(F.lit(0.18), 0.12 * F.col("total")) + F.least(F.lit(0.09), 0.03 * (F.col("n_events") - 1))))


def parse_region(text: Column, states: dict[str, str]) -> Column:
    """struct(city, state, country) of comma parts: the last a country unless it is a state of one."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    known = F.create_map(*[F.lit(v) for pair in states.items() for v in pair])
    n = F.size(parts)
    at = lambda k: F.when(n >= k, F.element_at(parts, -k))
    country_of = known[F.lower(at(1))]
    is_state = country_of.isNotNull()
    return F.struct(F.when(is_state, at(2)).otherwise(F.when(n >= 2, F.element_at(parts, 1))).alias("city"), F.when(is_state, at(1)).when(n >= 3, at(2)).alias("state"), F.when(is_state, country_of).otherwise(at(1)).alias("country"))


def regions_apart(a: Column, b: Column, km: Column) -> Column:
    """Whether two regions cannot be one place: other countries, other states, or, where a state is unknown, more than 150 km."""
    other = lambda f: F.lower(a[f]) != F.lower(b[f])
    states = a["state"].isNotNull() & b["state"].isNotNull()
    return F.coalesce(F.when(other("country"), True).when(states, other("state")).otherwise(km > 150), F.lit(False))


def majority_years(years: DataFrame, key: str, year: str, reach: int = 3) -> DataFrame:
    """The year of each key with most votes within `reach` years, the first of equals: key, year, votes."""
    n = years.groupBy(key, F.col(year).alias("y")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("y").rangeBetween(-reach, reach)
    n = n.withColumn("votes", F.sum("n").over(w))
    return n.groupBy(key).agg(F.max_by("y", F.struct("votes", -F.col("y"))).alias("year"), F.max("votes").alias("votes"))


def capture_windows(observed: DataFrame, key: str, year: str, trusted: str, reach: int = 3) -> DataFrame:
    """First and last year of each key's trusted observations and of others within `reach` years of them, a year's pad on both sides; without trusted ones, of all."""
    core = observed.where(F.col(trusted)).groupBy(key).agg(F.min(year).alias("lo"), F.max(year).alias("hi"))
    d = observed.join(core, key, "left")
    near = F.col("lo").isNull() | ((F.col(year) >= F.col("lo") - reach) & (F.col(year) <= F.col("hi") + reach))
    return d.where(near).groupBy(key).agg((F.min(year) - 1).alias("start_year"), (F.max(year) + 1).alias("end_year"), F.when(F.bool_or(F.coalesce(trusted, F.lit(False))), "trusted").otherwise("envelope").alias("basis"), F.count("*").alias("n"))


def best_anchor(rows: DataFrame, label: str, source: str, confidence: str, ranks: dict[str, int]) -> DataFrame:
    """The anchor of each label's key that ranks highest by its source, then by confidence, then by name."""
    rank = F.coalesce(F.create_map(*[F.lit(v) for pair in ranks.items() for v in pair])[F.col(source)], F.lit(0))
    key = sem.normalize_key(F.col(label))
    return rows.withColumn("key", key).groupBy("key").agg(F.max(F.struct(rank.alias("rank"), F.col(confidence).alias("confidence"), F.col(source).alias("source"))).alias("best")).select("key", "best.*")

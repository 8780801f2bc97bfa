"""Claims and corrections as logs: append, supersede, fingerprints, replay, policy gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(*parts: Column) -> Column:
    """A content key: the row is known again by what it says, not by its id."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def live_claims(log: DataFrame, claim: str, order: str, supersedes: str) -> DataFrame:
    """The last row of each claim that no later claim supersedes."""
    w = Window.partitionBy(claim).orderBy(F.desc(order))
    last = log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    gone = log.where(F.col(supersedes).isNotNull()).groupBy(F.col(supersedes).alias(claim)).agg(F.max(order).alias("_at"))
    return last.join(gone, claim, "left").where(F.col("_at").isNull() | (F.col("_at") < F.col(order))).drop("_at")


def store_stats(log: DataFrame, live: DataFrame, kind: str) -> DataFrame:
    """Rows, live claims and superseded ones of each kind."""
    a = log.groupBy(kind).agg(F.count("*").alias("rows"))
    b = live.groupBy(kind).agg(F.count("*").alias("live"))
    return a.join(b, kind, "left").withColumn("live", F.coalesce("live", F.lit(0)))


def resolve_targets(corrections: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """corrections (id, target, key) with the row they now mean: the same id if its content still matches, else the only row of that content, else why not."""
    same = rows.select(F.col("id").alias("target"), F.col(key).alias("now"))
    unique = rows.groupBy(key).agg(F.count("*").alias("matches"), F.min("id").alias("only"))
    j = corrections.join(same, "target", "left").join(unique, key, "left")
    kept = F.col("now") == F.col(key)
    to = F.when(kept, F.col("target")).when(F.col("matches") == 1, F.col("only"))
    reason = F.when(kept, "same").when(F.col("matches") == 1, "moved").when(F.col("matches") > 1, "ambiguous").otherwise("missing")
    return j.select("id", to.alias("target"), reason.alias("reason"))


def undecided(suggestions: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """Suggestions without a decision on the same target."""
    return suggestions.join(decided.select(*keys).distinct(), keys, "left_anti")


def quarantine(log: DataFrame, machine: Column, key: str) -> DataFrame:
    """Machine rows without a fingerprint are superseded; their targets can no longer be checked."""
    return log.withColumn("superseded", F.col("superseded") | (machine & F.col(key).isNull()))


def block_reason(action: Column, confidence: Column, floor: Column, contradicted: Column, evidence: Column) -> Column:
    """Why a suggestion is not applied unseen, or null."""
    return F.when(confidence.isNull(), "no confidence").when(confidence < floor, "below floor").when(contradicted, "contradicted").when(action.contains("relationship") & (evidence < 2), "one witness")


def select_suggestions(rows: DataFrame, target: str, reason: str, confidence: str) -> DataFrame:
    """One row a suggestion: selected, skipped for its reason, or second to a stronger one on the same target."""
    w = Window.partitionBy(target, F.col(reason).isNull()).orderBy(F.desc(confidence), "id")
    first = F.row_number().over(w) == 1
    return rows.withColumn("outcome", F.when(F.col(reason).isNotNull(), F.col(reason)).when(first, "selected").otherwise("duplicate target"))

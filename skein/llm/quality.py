"""Quality by hierarchical empirical Bayes: document evidence on top of path, host and global posteriors."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, fresh
from .toxicity import LONGEST, Trees

#: Bounds of the labelled sample that the document classifier learns from: rows, and characters of their texts.
MAX_ROWS, MAX_CHARS = 4000, 20_000_000
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGITS = re.compile(r"\d")
#: Weight of a site is kept within these pseudo-counts, and scores away from 0 and 1 by this much.
KAPPA, EDGE = (2.0, 10_000.0), 1e-3


def features(text: str | None) -> list[float]:
    """Shape of a whole text: size, variety, repetition of words and lines, capitals, digits, marks and signs."""
    text = text or ""
    words, lines = text.split(), text.split("\n")
    n, size = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    top = max(counts.values(), default=0)
    marks, signs = sum(map(text.count, ".,;:!?")), sum(map(text.count, "#$%&*|=@/{}<>_~"))
    return [math.log1p(len(words)), len(counts) / n, top / n, size / n, 1 - len(set(lines)) / len(lines), size / len(lines), len(CAPITALS.findall(text)) / size, len(DIGITS.findall(text)) / size, marks / n, signs / n, text.count("!") / n, text.count("|") / n, sum(w.isupper() for w in counts) / n, max(map(len, counts), default=0)]


def matrix(texts) -> np.ndarray:
    return np.asarray([features(t) for t in texts], np.float64).reshape(len(texts), 14)


def evidence_column(text: Column, labelled: DataFrame, rows: int = MAX_ROWS, chars: int = MAX_CHARS, longest: int = LONGEST) -> tuple[Column, float]:
    """Classifier probability of a good document, and the share of good ones it was learnt at.

    Boosted trees over shape features, fitted on the driver from at most `rows` labelled texts of
    `chars` characters in all and `longest` in one, in the order of their digests. Without both
    labels every document has the same probability.
    """
    body, label, order = (fresh(labelled, c) for c in ("learn_text", "learn_label", "learn_order"))
    picked = labelled.where("quality in (0, 1)").select(F.coalesce("text", F.lit("")).alias(body), F.col("quality").cast("int").alias(label))
    picked = picked.where(F.length(body) <= longest).withColumn(order, F.md5(body)).orderBy(order, label).limit(rows)
    x, y, total = [], [], 0
    for r in picked.toLocalIterator():
        total += len(r[body])
        if total > chars:
            break
        x.append(features(r[body]))
        y.append(r[label])
    prior = (sum(y) + 1) / (len(y) + 2)
    if len(set(y)) < 2 or len(y) < 8:
        return F.lit(prior), prior
    trees = Trees.fit(np.asarray(x), np.asarray(y, np.float64))
    from pyspark.sql import SparkSession

    sent = SparkSession.active().sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def evidence(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(np.clip(sent.value.predict(matrix(part.tolist())), EDGE, 1 - EDGE))

    return evidence(text), prior


def strength(sites: DataFrame, centre: Column) -> float:
    """Pseudo-counts of the Beta prior of sites around their centre, by moments: large where sites differ no more than chance would have it."""
    d = F.col("good") / F.col("n") - centre
    m = sites.where("n > 1").agg(F.count("*").alias("k"), F.avg(d * d).alias("v"), F.avg(centre * (1 - centre)).alias("spread"), F.avg(centre * (1 - centre) / F.col("n")).alias("noise")).first()
    if not m["k"] or m["k"] < 2 or m["v"] <= m["noise"]:
        return KAPPA[1]
    return float(min(max(m["spread"] / (m["v"] - m["noise"]) - 1, KAPPA[0]), KAPPA[1]))


def quality(docs: DataFrame, labelled: DataFrame, host: Column, path: Column, work: Workspace, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, evidence, host_prior, path_prior, score for every row.

    Sites are grouped sums of the documents' probabilities, reduced before their shuffle. A host's
    posterior shrinks towards the global mean by `strength`, a path's towards its host's; a
    document's own probability is left out of its sites. The score adds the evidence's log-odds
    over the global prior to the path posterior's. Null hosts and paths are sites of their own; a
    null text is empty and a very long one is read whole; a site of one document has its parent's
    prior; repeated rows stay and equal ones score alike; an empty table gives no rows; other columns
    are ignored, whatever their names. Driver memory holds the labelled sample and a few numbers only.
    """
    p, prior = evidence_column(F.col(text), labelled)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), p.alias("evidence"))
    rows = work.save(rows, "evidence")
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("good"))
    paths = work.save(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = min(max(total["good"] / total["n"], EDGE), 1 - EDGE) if total["n"] else prior
    k_host = strength(hosts, F.lit(mean))
    sites = paths.join(hosts.select("host", F.col("n").alias("hn"), F.col("good").alias("hg")), "host")
    # paths shrink towards their host, so it is around their host that they are measured
    k_path = strength(sites, (F.col("hg") + k_host * mean) / (F.col("hn") + k_host))
    out = rows.join(sites, ["host", "path"])
    own = F.col("evidence")
    out = out.withColumn("host_prior", (F.col("hg") - own + k_host * mean) / (F.col("hn") - 1 + k_host))
    out = out.withColumn("path_prior", (F.col("good") - own + k_path * F.col("host_prior")) / (F.col("n") - 1 + k_path))
    inside = lambda c: F.least(F.greatest(c, F.lit(EDGE)), F.lit(1 - EDGE))
    odds = lambda c: F.ln(c / (1 - c))
    total_odds = odds(inside(F.col("path_prior"))) + odds(inside(own)) - math.log(prior / (1 - prior))
    return out.select("doc_id", "evidence", "host_prior", "path_prior", (1 / (1 + F.exp(-total_odds))).alias("score"))

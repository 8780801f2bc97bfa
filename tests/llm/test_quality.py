import math

import pytest
from pyspark.sql import functions as F

from skein.llm import quality, queries
from skein.llm.common import Workspace

SF = "/root/testdata/sf0.01"


def test_posteriors_equal_plain_sums(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "evidence_column", lambda text, labelled: (F.when(text == "good", 0.9).otherwise(0.2), 0.5))
    texts = ["good", "bad", "good", None, "good", "bad", "bad"]
    rows = list(zip(range(7), texts, ["a", "a", "a", "b", "b", None, "c"], ["x", "x", "y", "x", "x", None, "z"], strict=True))
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in quality.quality(d, d, F.col("source"), F.col("lang"), Workspace(spark, "q", str(tmp_path))).collect()}
    p = [0.9 if t == "good" else 0.2 for t in texts]
    mean = sum(p) / 7

    def strength(groups):
        groups = [g for g in groups if len(g) > 1]
        v = sum((sum(g) / len(g) - mean) ** 2 for g in groups) / max(1, len(groups))
        noise = sum(mean * (1 - mean) / len(g) for g in groups) / max(1, len(groups))
        return 1e4 if len(groups) < 2 or v <= noise else min(max(mean * (1 - mean) / (v - noise) - 1, 2), 1e4)

    by = lambda key: [[p[i] for i, r in enumerate(rows) if key(r) == k] for k in {key(r) for r in rows}]
    kh, kp = strength(by(lambda r: r[2])), strength(by(lambda r: r[2:]))
    for i, r in enumerate(rows):
        h = [p[j] for j, o in enumerate(rows) if o[2] == r[2]]
        s = [p[j] for j, o in enumerate(rows) if o[2:] == r[2:]]
        host = (sum(h) - p[i] + kh * mean) / (len(h) - 1 + kh)
        path = (sum(s) - p[i] + kp * host) / (len(s) - 1 + kp)
        odds = math.log(path / (1 - path)) + math.log(p[i] / (1 - p[i]))
        assert got[i].host_prior == pytest.approx(host) and got[i].path_prior == pytest.approx(path)
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-odds)))


def test_odd_tables(spark, docs, tmp_path):
    none = docs([]).withColumn("quality", F.lit(1))
    assert quality.quality(none, none, F.col("source"), F.col("lang"), Workspace(spark, "q", str(tmp_path))).count() == 0
    d = docs([None, "", "word " * 50000, "same", "same"], ids=[None, 1, 2, 3, 3])
    got = quality.quality(d, none, F.col("source"), F.col("lang"), Workspace(spark, "q", str(tmp_path))).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)


def test_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = queries.queries()["op1_quality_classifier"](spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    order, good = rows.score.rank(), rows.quality == 1
    auc = (order[good].mean() - order[~good].mean()) / len(rows) + 0.5
    print("auc", auc, (rows.predicted == rows.quality).mean(), good.mean())
    assert auc > 0.75

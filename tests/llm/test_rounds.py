"""Pairs of blocks are dealt in rounds and texts in slices, without a link lost."""

import random

from skein.llm import jaccard
from skein.llm.common import Workspace

from .test_jaccard import brute, edited


def test_rounds_bound_what_is_copied_at_once(spark, tmp_path, monkeypatch):
    r = random.Random(11)
    base = [f"w{r.randrange(400)}" for _ in range(60)]
    # one crowded cluster: near copies of one text, some not near each other, and a null id
    texts = [" ".join(base), *(edited(r, base, r.randrange(1, 4)) for _ in range(59))]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, edited(r, base, 1)), (3, texts[7])], "doc_id long, text string")
    want = {d: c for d, _, c in jaccard.jaccard_classes(df, Workspace(spark, "one", str(tmp_path))).collect()}
    assert {i: want[i] for i, _ in rows} == {i: c for i, (_, c) in brute([*rows, (3, texts[7])]).items()}

    copied, save = [], Workspace.save

    def spy(self, df, name, mode="errorifexists"):
        if name == "links":
            copied.append(self.path)
        return save(self, df, name, mode)

    monkeypatch.setattr(Workspace, "save", spy)
    for name, value in {"BLOCK": 4, "VALUES": 300, "ROUND": 500}.items():
        monkeypatch.setattr(jaccard, name, value)
    got = {d: c for d, _, c in jaccard.jaccard_classes(df, Workspace(spark, "many", str(tmp_path))).collect()}
    assert got == want
    assert len(copied) > 4


def test_chains_of_shared_phrases_are_no_crowd(spark, tmp_path):
    r = random.Random(3)
    # each text shares a phrase with the next, so all are chained; near copies of some lie between
    word = lambda: f"w{r.randrange(10**6)}"
    phrases = [[word() for _ in range(12)] for _ in range(81)]
    texts = [" ".join([*phrases[k], word(), word(), *phrases[k + 1]]) for k in range(80)]
    texts += [edited(r, texts[k].split(), 1) for k in range(0, 80, 8)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {d: c for d, _, c in jaccard.jaccard_classes(df, Workspace(spark, "chain", str(tmp_path))).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}
    at = next(tmp_path.glob("chain-*"))
    # a set's places begin with what it meets the others under
    places = spark.read.parquet(f"{at}/stays").selectExpr("inline(places)")
    met = [x["count"] for x in places.groupBy(places.columns[0]).count().collect()]
    assert met and max(met) < 20

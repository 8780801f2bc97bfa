"""Tables with every name that an operator or stage uses inside, and texts longer than a stretch."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skein.llm import ann, html, jaccard, langid, packing, repeats, tokens, toxicity
from skein.llm.common import Workspace

from .test_repeats import brute

NAMES = "h key s e p sid seg copies ranges gone parts __cut __h __digest text_digest cut_ranges cut_whole cut_done row_key row_number found_language benchmark_scan scan spans kept kept_text digest version n c1 c2 listed kind bucket packed component_id n_shingles ids start length doc_tokens sequence_id offset block perm v rank score query_id learn_text learn_label learn_order toxic quality order size".split()


@pytest.fixture(scope="module")
def clash(spark, docs):
    r = random.Random(2)
    shared = " ".join(f"w{r.randrange(999)}" for _ in range(60))
    texts = [f"start {k} " + " ".join(f"u{r.randrange(10**6)}" for _ in range(30)) + " " + shared for k in range(6)] + [None, "", "a b c", "a b c"]
    rows = docs(texts, langs=["en"] * len(texts)).drop("h", "n_tokens")
    return texts, rows.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES))


def test_operators_keep_rows_and_other_columns(spark, clash, tmp_path):
    texts, d = clash
    work = Workspace(spark, "c", str(tmp_path))
    assert jaccard.jaccard_classes(d, work).count() == len(texts)
    counted = tokens.token_counts(d, public_tokenizers.path("word_bpe_49k.json"), work)
    assert counted.count() == len(texts) and counted.where("__digest = 'own __digest' and text_digest = 'own text_digest'").count() == len(texts)
    cut = repeats.remove_repeats(d, work)
    got = {x.doc_id: x for x in cut.collect()}
    assert [bytes(got[i].kept) for i in range(len(texts))] == [k for k, _ in brute([t or "" for t in texts])]
    assert all(x[n] == f"own {n}" for x in got.values() for n in NAMES if n not in ("kept", "kept_text", "spans"))
    assert packing.pack(d, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id").distinct().count() == len(texts)
    samples = langid.sample(d)
    assert d.select(langid.language_column(F.col("text"), samples).alias("x"), html.main_text_column(F.col("text")).alias("y")).count() == len(texts)
    rows = toxicity.sample(d.drop("toxic").withColumn("toxic", (F.col("doc_id") % 2).cast("int")))
    assert d.select(toxicity.score_column(F.col("text"), rows).alias("x")).count() == len(texts)
    vectors = d.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("embedding"), *NAMES)
    assert ann.PermutationIndex(vectors, work).search(vectors, 3).count() == 3 * len(texts)


def test_stages_keep_other_columns(spark, clash, tmp_path_factory):
    _, d = clash
    folder = str(tmp_path_factory.mktemp("clash"))
    spark.createDataFrame([(1, "none of these")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, folder)
        assert out.columns == d.columns, name
        for row in out.collect():
            assert all(row[n] == f"own {n}" for n in NAMES), name


def test_one_id_with_different_texts_and_null_ids(spark, docs):
    base, other = " ".join(f"w{k}" for k in range(50)), " ".join(f"v{k}" for k in range(50))
    d = docs([base, other, base, base, other + " x", "lone words", "lone words", None, None, base + " tail"], ids=[3, 3, 9, None, None, None, None, 5, None, 1])
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_duplicates(spark, d, "").collect()))
    assert got == sorted([(False, 1, base + " tail"), (False, 3, other), (True, 0, "lone words"), (False, 5, ""), (True, 0, "")])


def test_vectors_of_each_dimension_are_searched(spark, tmp_path):
    rows = [(k, [float(k), 1.0]) for k in range(30)] + [(100 + k, [float(k), 1.0, 2.0]) for k in range(7)] + [(200, [1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.PermutationIndex(d, Workspace(spark, "a", str(tmp_path))).search(d.where("vec_id % 20 = 0"), 20).collect()
    found = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 20, 100, 200)}
    assert len(found[0]) == len(found[20]) == 20 and found[20][0] == 29
    assert found[100] == [101, 102, 103, 104, 105, 106] and found[200] == []


def test_long_texts_are_cut_in_stretches():
    r = random.Random(7)
    passage = bytes(r.choice(b"abcd") for _ in range(260))
    raw = [bytes(r.choice(b"efgh") for _ in range(900)) + passage + bytes(r.choice(b"efgh") for _ in range(700)) for _ in range(3)]
    spans = lambda x: {(t, w, p - w, k) for t, s, e, p, k in zip(*map(list, x), strict=True) for w in range(s, e + 1)}
    assert spans(repeats.segments(raw, stretch=150)) == spans(repeats.segments(raw)) and len(repeats.segments(raw, stretch=150)[0]) > len(repeats.segments(raw)[0])

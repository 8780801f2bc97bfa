"""Languages with long texts only, and tables that teach no language."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from skein.llm import langid


def plain_phrases(line, learned):
    at = n = 0
    while at < len(line):
        size = 0
        while at + size < len(line) and line[at : at + size + 1] in learned:
            size += 1
        at, n = at + max(1, size), n + 1
    return n


def test_whole_texts_are_parsed_unbroken():
    r = random.Random(6)
    samples = {"p": " ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 7))) for _ in range(300)) + " " + "a" * 7, "q": "abde f" * 20 + "e" * 40}
    parser = langid.Parser(samples)
    texts = [" ".join("".join(r.choice("abcdef") for _ in range(r.randint(1, 9))) for _ in range(n)) for n in (1, 300, 3000, 20)]
    texts += ["a" * 12000, "e" * 11001, "ab" * 7000 + "z", "z" * 2050, "x1 ", "7 a 7", "", ("abde f" * 400 + "q") * 5]
    for size in (1, 3):
        for some in (texts[at::size] for at in range(size)):
            counts, sizes = parser.phrases(some)
            for i, text in enumerate(some):
                line = langid.squeezed(text)
                assert sizes[i] == len(line)
                assert counts[i].tolist() == [plain_phrases(line, langid.squeezed(samples[x])) for x in parser.languages], text[:40]

EN, FR = "the dog and the cat of the house ", "le chien et le chat de la maison "


def test_long_texts_are_learned_from(docs):
    d = docs(["7" * 30000 + EN * 2000, EN * 1500, FR * 3, "1" * 30000], langs=["en", "en", "fr", "de"])
    samples = langid.sample(d)
    assert sorted(samples) == ["en", "fr"] and samples["fr"] == FR * 3
    assert 20000 < len(samples["en"]) <= langid.SAMPLE_CHARS + 1 and "dog and the cat" in samples["en"]
    got = docs([EN, FR]).select(langid.language_column(F.col("text"), samples).alias("s")).collect()
    assert [r.s.lang for r in got] == ["en", "fr"]


def test_short_texts_go_before_spans_of_long_ones(docs):
    d = docs([EN * 5, FR * 1500], langs=["x", "x"])
    got = langid.sample(d)["x"]
    assert got.startswith(EN * 5) and "chien" in got and len(got) <= langid.SAMPLE_CHARS + 1
    full = [f"{k} " + EN * 90 for k in range(9)]
    assert "chien" not in langid.sample(docs([*full, FR * 1500], langs=["x"] * 10))["x"]


def test_stage_keeps_lettered_documents_when_nothing_was_learned(spark, docs):
    d = docs([EN, EN * 3000, None, "", "12 !", "日本"])
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, d, "").collect()) == [0, 1, 5]
    d = docs([EN * 1500, FR * 1500, "34", None], langs=["en", "fr", "en", "fr"], ids=[0, 1, 4, 5])
    assert sorted(r.doc_id for r in corpus_pipeline.language(spark, d, "").collect()) == [0, 1]

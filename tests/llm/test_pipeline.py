"""run() against the same stages written plainly, on a small table."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from skein.llm import decontam, langid, queries

from .test_jaccard import brute as classes
from .test_repeats import brute as without_repeats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    words = {"en": "the of and to in is that for with was on are".split(), "fr": "le de un et les des en du que dans pour une".split()}
    text = lambda lang, n: " ".join(r.choice(words[lang]) + r.choice(["", "x", "yz", str(r.randrange(99))]) for _ in range(n))
    rows, items = [], [(k, text("en", 30)) for k in range(4)]
    shared = text("en", 80)
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        rows.append([i, text(lang, r.randint(20, 200)), lang])
    for i in range(60, 70):
        rows.append([i, text("en", 60) + " " + shared + " " + text("en", 60), "en"])
    for i in range(70, 80):
        rows.append([i, rows[i - 70][1], rows[i - 70][2]])
    for i in range(80, 90):
        rows.append([i, rows[i - 70][1] + " tail", rows[i - 70][2]])
    rows += [[90, None, None], [91, "", None], [92, "123 !!", "en"], [93, items[0][1], "en"], [94, text("en", 10) + " " + items[1][1], "en"], [95, text("en", 2000) + " " + items[2][1], "en"], [96, text("fr", 9000), "fr"]]
    out = tmp_path_factory.mktemp("sf")
    schema = "doc_id long, text string, lang string, source string, n_chars long, h string"
    spark.createDataFrame([(i, t, g, "s", len(t or ""), "z") for i, t, g in rows], schema).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), [(i, t) for i, t, _ in rows], items


def test_run_equals_plain_stages(spark, folder):
    path, rows, items = folder
    rows = [(i, t) for i, t in rows if t and any(map(str.isalpha, t))]
    group = classes(rows)
    rows = [(i, t) for i, t in rows if group[i][1] == i]
    cut = without_repeats([t for _, t in rows])
    rows = [(i, kept.decode("utf-8", "ignore")) for (i, _), (kept, _) in zip(rows, cut, strict=True) if kept.decode("utf-8", "ignore").strip(" ")]
    scanner = decontam.Scanner(items)
    rows = [(i, t) for i, t in rows if not ((s := scanner.scan(t))[1] > 0 and 20 * s[1] >= s[0])]
    tokenizer = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    want = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    got = {}
    for r in corpus_pipeline.run(spark, path).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == want
    assert {93, 94}.isdisjoint(got) and 95 in got


def test_stages_keep_columns_and_take_odd_tables(spark, folder):
    path = folder[0]
    whole = spark.read.parquet(f"{path}/documents.parquet")
    for docs in (whole.limit(0), whole.where("text is null"), whole.union(whole.limit(3)).selectExpr("doc_id", "text", "lang", "cast(null as string) source", "n_chars", "h")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, path).columns == docs.columns
            stage(spark, docs, path).count()
    assert len(Counter(n for n, _ in corpus_pipeline.STAGES)) == 5 and re.match("[a-z_]+$", langid.UNKNOWN)

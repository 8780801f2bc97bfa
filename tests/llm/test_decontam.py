import random
import re

from pyspark.sql import functions as F

from skein.llm import decontam


def brute(text, items, window=13):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    hit, found = set(), set()
    for key, item in items:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (item or "").lower())
        for at in range(max(1, len(ws) - window + 1) if ws else 0):
            part = ws[at : at + window]
            for p in range(len(words) - len(part) + 1):
                if words[p : p + len(part)] == part:
                    hit |= set(range(p, p + len(part)))
                    if key is not None:
                        found.add(key)
    return len(words), len(hit), sorted(found)


def test_scan_equals_brute_force(spark, docs):
    r = random.Random(3)
    word = lambda: r.choice(["a", "b", "c", "é", "日本", "x1"])
    items = [(1, " ".join(word() for _ in range(20))), (2, "A, b; C!"), (3, "short"), (3, "short"), (None, "zz yy"), (4, None), (5, "  ...  ")]
    texts = [None, "", "...", "zz  YY!", "short " * 3, items[0][1].upper() + " tail"]
    texts += [", ".join(word() for _ in range(r.randint(1, 200))) + " " + items[0][1][: r.randint(1, 60)] for _ in range(40)]
    texts.append("filler " * 20000 + items[0][1])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = docs(texts).select("doc_id", "text", decontam.scan_column(F.col("text"), bench).alias("s")).collect()
    for row in got:
        assert (row.s.n_words, row.s.n_hit, row.s["items"]) == brute(row.text, items)
        for a, b in row.s.spans:
            assert row.text[a:b].strip() == row.text[a:b]
            assert len(decontam.normalised(row.text[a:b])) >= 1
        assert sum(len(decontam.normalised(row.text[a:b])) for a, b in row.s.spans) == row.s.n_hit


def test_empty_benchmark(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    row = docs(["some words"]).select(decontam.scan_column(F.col("text"), bench).alias("s")).first()
    assert row.s.n_words == 2 and row.s.n_hit == 0 and row.s["items"] == []


def test_parts_and_long_hits_equal_one_scan(spark, docs, tmp_path):
    import time

    from skein.llm.common import Workspace

    r = random.Random(4)
    items = [(k, " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 40)))) for k in range(60)]
    texts = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 60))) + " " + items[k][1] for k in range(30)] + [None, ""]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontam.PART_BYTES, 400):
        got = decontam.scan(docs(texts), bench, Workspace(spark, "d", str(tmp_path)), part_bytes=size).select("text", "scan", "h").collect()
        for row in got:
            assert (row.scan.n_words, row.scan.n_hit, row.scan["items"]) == brute(row.text, items), size
            assert sum(len(decontam.normalised(row.text[a:b])) for a, b in row.scan.spans) == row.scan.n_hit
    scanner = decontam.Scanner([(1, "é b c d e f g h i j k l m n o")])
    line = "é b c d e f g h i j k l m n o, -- " * 40_000
    began = time.time()
    assert len(scanner.scan(line)[3]) == 1 and time.time() - began < 20


def test_the_automaton_grows_with_the_items_not_their_windows():
    scanner = decontam.Scanner([(1, " ".join(f"word{k}" for k in range(2000)))])
    assert scanner.automaton.get_stats()["nodes_count"] < 1.3 * len(" ".join(f"word{k}" for k in range(2000)))

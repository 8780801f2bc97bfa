import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skein.llm import packing, tokens
from skein.llm.common import Workspace

ODD = [None, "", " ", "  ", "a", "The <|endoftext|> end <|startoftext|>x", "x\n <|endoftext|> y", "a  b   c \n d\n\n e ", "don't we'll 12 345 ...", "Ünïcode é é ß 日本 　 \x1c \x85 q", "tab\t x \t y\r\n z ", "trail  ", "trail ", "\n", "word " * 3000, "same", "same"]


def random_texts(n=300, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(["a", "B", "é", " ", "  ", "\n", "\t", "'s", "1", "!", "<|endoftext|>", "́", "the ", "\x1f"]) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_chunked_encoding_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), tokens.ByteEncoder(path)
    for text in [x for x in ODD if x is not None] + random_texts():
        assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_chunked_counts_equal_the_library(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    t, c = Tokenizer.from_file(path), tokens.WordCounter(path)
    monkeypatch.setattr(tokens, "CHUNKS", 50)
    texts = [x for x in ODD if x is not None] + random_texts(seed=2)
    assert c.counts(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_and_cache(spark, docs, tmp_path, file):
    path, cache = public_tokenizers.path(file), str(tmp_path / "cache")
    d = docs(ODD)
    got = tokens.token_counts(d, path, Workspace(spark, "t", str(tmp_path)), cache)
    rows = {r.doc_id: r for r in got.collect()}
    counter = tokens.shared("piece" if file.endswith("model") else "word", path)
    assert {k: r.n_tokens for k, r in rows.items()} == {i: counter.counts([t or ""])[0] for i, t in enumerate(ODD)}
    assert rows[9].n_bytes == len(ODD[9].encode()) and rows[0].n_bytes == 0 and rows[0].h == "x"
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in ODD})
    tokens.token_counts(docs([*ODD, "new one"]), path, Workspace(spark, "t", str(tmp_path)), cache)
    assert spark.read.parquet(cache).count() == stored + 1
    assert tokens.token_counts(docs([]), path, Workspace(spark, "t", str(tmp_path))).count() == 0


def test_packing_round_trip(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack(docs(ODD, ids=[None, *range(1, len(ODD))]), path, limit=64).collect()
    for i, text in enumerate(ODD):
        mine = sorted((r for r in rows if r.doc_id == (i or None)), key=lambda r: r.start)
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in mine]).tolist() == ids
        assert all(r.length & (r.length - 1) == 0 and r.length <= 64 and r.doc_tokens == len(ids) for r in mine)
    assert len({r.sequence_id for r in rows}) == len(rows)
    assert packing.pack(docs([]), path).count() == 0


def test_write_buckets(spark, docs, tmp_path):
    pieces = packing.pack(docs(["one two three", "four"]), public_tokenizers.path("byte_bpe_50k.json"))
    packing.write_buckets(pieces, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == pieces.count()


def test_ranks_give_the_library_ids_for_every_code_point():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), tokens.ByteEncoder(path)
    assert e.ranked is not None
    points = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    for lo in range(0, len(points), 4096):
        line = "b".join(f"a{c}1{c}!{c} {c} {c}\n{c}\n" for c in points[lo : lo + 4096])
        assert e.ids(line) == t.encode(line, add_special_tokens=False).ids, hex(ord(points[lo]))
    for text in ("\n" * 60_000 + "x", "a" * 70_000, " " * 60_000, "x " * 60_000):
        assert e.ids(text) == t.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_are_not_ranked():
    assert tokens.ranked(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))) is None

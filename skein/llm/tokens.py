"""Token counts through a digest cache, and the chunk-wise encoders that fill it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, claim, fresh, keeps

#: Chunks of a generation of a process's store, which keeps two: memory does not grow with the corpus.
CHUNKS = 1_000_000
#: Characters of a chunk that is still kept.
LONGEST = 48
#: Characters of texts that are cut into chunks together, about.
BATCH = 4 << 20
_loaded: dict[tuple[str, str], object] = {}


def load_tokenizer(path: str):
    """A tokenizers file, with its libraries' own threads off: Spark already uses the cores."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class PieceCounter:
    """Token counts of whole texts under a sentencepiece model; it has no chunk boundary that is always safe."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(self.model.encode(t, num_threads=1)) for t in texts]


class ChunkStore:
    """What chunks are encoded to, each encoded once while it stays in use.

    A full generation becomes the older one and the one before it goes; chunks looked up in the
    older one move to the younger, so frequent chunks are never lost.
    """

    def __init__(self, encode):
        self.encode, self.young, self.old = encode, {}, {}

    def look_up(self, chunks: list[str]) -> list:
        found = list(map(self.young.get, chunks))
        at = [i for i, value in enumerate(found) if value is None]
        if at:
            missing = dict.fromkeys([chunks[i] for i in at])
            new = {c: v for c in missing if (v := self.old.get(c)) is not None}
            fresh = [c for c in missing if c not in new]
            for lo in range(0, len(fresh), 4096):
                part = fresh[lo : lo + 4096]
                new.update(zip(part, self.encode(part), strict=True))
            for i in at:
                found[i] = new[chunks[i]]
            self.young.update((c, v) for c, v in new.items() if len(c) <= LONGEST)
            if len(self.young) > CHUNKS:
                self.young, self.old = {}, self.young
        return found


def chunked(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Texts cut at blanks: each chunk's place among the distinct ones, these, and where each text's chunks begin and end."""
    lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
    coded = lists.values.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist(), lists.offsets.to_numpy().astype(np.int64)


class WordCounter:
    """Counts under a tokenizer that drops white space before it merges: a text's count is the sum of its chunks'.

    Blanks and line feeds always end a pre-token there, so each distinct chunk between them is
    encoded once and then looked up. Special strings hold no blank and stay within a chunk.
    """

    def __init__(self, path: str):
        tokenizer = load_tokenizer(path)
        self.store = ChunkStore(lambda chunks: map(len, tokenizer.encode_batch_fast(chunks, add_special_tokens=False)))

    def counts(self, texts: list[str]) -> list[int]:
        at, chunks, ends = chunked([t.replace("\n", " ") for t in texts])
        sums = np.concatenate([[0], np.cumsum(np.asarray(self.store.look_up(chunks), np.int64)[at])]) if len(at) else np.zeros(1, np.int64)
        return (sums[ends[1:]] - sums[ends[:-1]]).tolist()


#: Fixed: the pre-token pattern of the byte-level pre-tokenizer, with possessive repeats.
PRETOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: White space that is no longer left to the pattern's backtracking.
RUN = 50_000
LONG_RUN = re.compile(r"\s{%d}" % RUN)


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones stand for themselves, others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {**{chr(b): b for b in printable}, **{chr(0x100 + i): b for i, b in enumerate(rest)}}


def ranked(tokenizer) -> object | None:
    """An encoding by token ranks that gives the tokenizer's ids on texts without its special strings, or None if it need not.

    Merging by the rank of the result equals merging by the file's list if the list is in the order
    of its results' ids and every token of the vocabulary is what its own letters are merged to:
    then a pair whose join is a token never stands side by side without being on the list.
    """
    import json

    import tiktoken

    file = json.loads(tokenizer.to_str())
    model, cutter, letters = file["model"], file["pre_tokenizer"] or {}, byte_letters()
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    if not plain or file["normalizer"] or file["post_processor"] or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex"):
        return None
    special = {a["content"] for a in file["added_tokens"]}
    words = {t: i for t, i in model["vocab"].items() if t not in special}
    made = [words.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    in_order = all(a < b for a, b in zip([-1, *made], made, strict=False))
    if not in_order or any(c not in letters for t in words for c in t) or any(len(tokenizer.model.tokenize(t)) != 1 for t in words):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in words.items()}
    return tiktoken.Encoding("file", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={}) if all(bytes([b]) in ranks for b in range(256)) else None


class ByteEncoder:
    """Ids under a byte-level tokenizer: by token ranks where that is proven the same (see `ranked`), by the library itself elsewhere."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.special = [str(t) for t in (a.content for a in self.tokenizer.get_added_tokens_decoder().values())]
        self.ranked = ranked(self.tokenizer)

    def ids(self, text: str) -> list[int]:
        if self.ranked is None or any(s in text for s in self.special) or (len(text) >= RUN and LONG_RUN.search(text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)

    def encode(self, text: str) -> bytes:
        return np.asarray(self.ids(text), "<u4").tobytes()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids end to end, and how many each text has."""
        found = [np.asarray(self.ids(t), "<u4") for t in texts]
        return np.concatenate([*found, np.zeros(0, "<u4")]), np.fromiter(map(len, found), np.int64, len(found))


keeps("tokens", _loaded.clear)


def shared(kind: str, path: str):
    """One encoder per process and file."""
    claim("tokens")
    key = (kind, path)
    if key not in _loaded:
        _loaded[key] = {"word": WordCounter, "piece": PieceCounter, "byte": ByteEncoder}[kind](path)
    return _loaded[key]


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: a new vocabulary never meets counts of an older one."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


CACHE = "version string, digest binary, n_tokens long"


def token_counts(docs: DataFrame, tokenizer: str, work: Workspace, cache: str | None = None, text: str = "text") -> DataFrame:
    """docs with n_bytes and n_tokens, each distinct text encoded at most once per tokenizer version.

    The cache is a Parquet table (version, digest, n_tokens) at `cache`, or a new one in the shared
    folder. Texts are null-normalised to empty and digested in the JVM; digests that the cache
    lacks are reduced to one text each before the shuffle's write, encoded, and appended; then all
    rows take their count from the cache. A null text counts as empty; extra columns pass through
    unless named n_bytes or n_tokens, which are replaced; an empty input gives no rows. Rows keep
    their multiplicity. Two writers may append the same digest: the count is the same, and the
    read takes one. A file ending in .model is read by sentencepiece, any other by tokenizers.
    """
    version = tokenizer_version(tokenizer)
    spark, path = docs.sparkSession, cache or f"{work.path}/token-cache"
    kind = "piece" if tokenizer.endswith(".model") else "word"
    docs = docs.drop("n_bytes", "n_tokens")
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.md5(body))
    try:
        cached = spark.read.schema(CACHE).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cached = None
    texts = docs.select(digest.alias("digest"), body.alias("text"))
    if cached is not None:
        texts = texts.join(cached.where(F.col("version") == version).select("digest").distinct(), "digest", "left_anti")
    texts = texts.dropDuplicates(["digest"])

    @F.pandas_udf("long")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = shared(kind, tokenizer)
        for part in parts:
            sizes = np.cumsum(part.str.len().to_numpy(np.int64)) // BATCH
            yield pd.Series([n for _, some in part.groupby(sizes) for n in counter.counts(some.tolist())], dtype="int64")

    # one folder a version: a reader of this one never opens counts of another
    texts.select(F.lit(version).alias("version"), "digest", count("text").alias("n_tokens")).write.mode("append").partitionBy("version").parquet(path)
    key = fresh(docs, "text_digest")
    now = spark.read.schema(CACHE).parquet(path).where(F.col("version") == version)
    now = now.groupBy(F.col("digest").alias(key)).agg(F.max("n_tokens").alias("n_tokens"))
    keep = [docs[c] for c in docs.columns if c != text]
    rows = docs.select(*keep, F.octet_length(body).cast("long").alias("n_bytes"), digest.alias(key))
    return rows.join(now, key).drop(key)

"""Language identification by cross-parsing entropy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, keeps, trim

#: Characters of labelled text that a language's automaton is built from, at most, and rows looked at to fill them.
SAMPLE_CHARS = 24_000
SAMPLE_ROWS = 200
#: Texts are parsed side by side in pieces of this many symbols, whose seams are parsed again until they agree with an unbroken parse.
PIECE = 1024
#: Characters parsed side by side, about.
BATCH = 1 << 20
UNKNOWN = "und"
RESULT = "lang string, score double"
_automata: dict[int, tuple] = {}
keeps("langid", _automata.clear)


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of a text (Blumer et al.)."""
    step: list[dict[str, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def cleaned(text: str) -> str:
    """Letters in lower case, every run of anything else one blank: markup and digits say nothing about a language."""
    return "".join(c if c.isalpha() else " " for c in text.lower())


def squeezed(text: str) -> str:
    return " ".join(cleaned(text).split())


class Parser:
    """One complete transition table over all languages' automata.

    Entry [state, symbol] holds the next state, and its two lowest bits how many phrases begin
    there, so that parsing is one table look-up a symbol. A symbol that a language has never seen
    is a phrase of its own, and another begins after it.
    """

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        texts = [squeezed(samples[x]) for x in self.languages]
        symbols = sorted(set("".join(texts)) | {" "})
        self.width = len(symbols) + 1
        self.code = {c: i + 1 for i, c in enumerate(symbols)}
        self.blank = self.code[" "]
        self.map = np.full(0x110000, self.blank, np.uint16)
        self.map[np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)] = 0
        for c, i in self.code.items():
            self.map[ord(c)] = i
        self.tables = []
        for text in texts:
            steps = suffix_automaton(text)
            table = np.full((len(steps), self.width), -1, np.int64)
            for state, out in enumerate(steps):
                for c, to in out.items():
                    table[state, self.code[c]] = to
            root = np.where(table[0] < 0, 0, table[0])
            done = np.where(table < 0, (root * self.width << 2) | np.where(table[0] < 0, 2, 1), table * self.width << 2).astype(np.int32)
            done[0] = np.where(table[0] < 0, 1, table[0] * self.width << 2)
            self.tables.append(done.ravel())

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' symbols end to end, squeezed, and how many each text has."""
        lines = [t.lower() for t in texts]
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        raw = self.map[np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)]
        blank = raw == self.blank
        before = np.empty(len(raw), bool)
        before[1:] = blank[:-1]
        ends = np.cumsum(size)
        before[(ends - size)[size > 0]] = True
        keep = ~(blank & before)
        kept = np.zeros(len(keep) + 1, np.int32)
        np.cumsum(keep, out=kept[1:])
        codes, sizes = raw[keep], (kept[ends] - kept[ends - size]).astype(np.int64)
        # a text's last blank goes as well
        last = (np.cumsum(sizes) - 1)[sizes > 0]
        drop = last[codes[last] == self.blank]
        sizes[np.flatnonzero(sizes > 0)[codes[last] == self.blank]] -= 1
        return np.delete(codes, drop) if len(drop) else codes, sizes

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases per text and language, and symbols per text.

        Pieces are parsed from the root at first. A piece that its predecessor does not leave at the
        root is then parsed again from the state it leaves, beside the earlier parse, until both are
        in one state, from which on they are the same; where they meet nowhere, the piece ends in
        another state and its successor's turn comes. So the counts are those of whole texts.
        """
        n = len(texts)
        codes, sizes = self.codes(texts)
        counts = np.zeros((n, len(self.languages)), np.int64)
        if not len(codes):
            return counts, sizes
        begins = np.cumsum(sizes) - sizes
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(n), pieces)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begins[owner] + rank * PIECE
        length = np.minimum(sizes[owner] - rank * PIECE, PIECE)
        order = np.argsort(-length, kind="stable")
        sorted_start, sorted_length = start[order], length[order]
        ends_text = np.append(rank[1:] == 0, True)
        for k, table in enumerate(self.tables):
            state = np.zeros(len(owner), np.int32)
            broken = np.zeros(len(owner), np.int64)
            live = len(owner)
            for at in range(int(sorted_length[0])):
                while sorted_length[live - 1] <= at:
                    live -= 1
                entry = table[state[:live] + codes[sorted_start[:live] + at]]
                broken[:live] += entry & 3
                state[:live] = entry >> 2
            end, found = np.empty_like(state), np.empty_like(broken)
            end[order], found[order] = state, broken
            entered = np.zeros(len(owner), np.int32)
            again = np.flatnonzero((rank > 0) & (np.append(np.int32(0), end[:-1]) != 0))
            while len(again):
                new, old = end[again - 1], entered[again]
                entered[again] = new
                at, live = 0, np.arange(len(again))
                while len(live):
                    symbol = codes[start[again[live]] + at]
                    a, b = table[new[live] + symbol], table[old[live] + symbol]
                    found[again[live]] += (a & 3).astype(np.int64) - (b & 3)
                    new[live], old[live] = a >> 2, b >> 2
                    at += 1
                    live = live[(new[live] != old[live]) & (length[again[live]] > at)]
                apart = again[new != old]
                end[apart] = new[new != old]
                again = apart[~ends_text[apart]] + 1
            # the first phrase begins with the text; one that would begin after its last symbol is none
            counts[:, k] = np.bincount(owner, found, n).astype(np.int64)
            counts[sizes > 0, k] += 1
            counts[owner[ends_text & (end == 0)], k] -= 1
        return counts, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language of fewest phrases, ties to the first in name order, and its share of certainty.

        The score is the winner's weight among weights exp(-phrases * log(symbols) / ...), taken on
        the per-symbol entropy estimate so that it does not saturate with length.
        """
        lines = [t or "" for t in texts]
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        ends = np.cumsum([0, *map(len, lines)])
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + BATCH, BATCH)).clip(0, len(lines)))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            counts, sizes = self.phrases(lines[lo:hi])
            rate = counts / np.maximum(sizes, 1)[:, None] * np.log2(1 + SAMPLE_CHARS)
            best = rate.argmin(1)
            weight = np.exp(-4 * (rate - rate.min(1, keepdims=True)))
            for i in range(len(sizes)):
                if sizes[i]:
                    langs[lo + i], scores[lo + i] = self.languages[best[i]], weight[i, best[i]] / weight[i].sum()
        return langs, scores


def sample(labelled: DataFrame, chars: int = SAMPLE_CHARS, rows: int = SAMPLE_ROWS) -> dict[str, str]:
    """Text per language for its automaton: whole texts in the order of their digests, until `chars` are gathered.

    Where a language's texts of at most `chars` do not fill it, longer ones do: of each, in the order
    of their digests, the first `chars` characters, runs of anything but letters counted as one. The
    bound is per language and does not grow with the corpus: of at most `rows` distinct texts of
    either kind, those that fill `chars` come to the driver. Each task passes on the least `rows`
    digests of a language and kind, the executors merge them in two steps, and only texts of the
    digests left are read; copies of one text count once.
    """
    body = labelled.where("text is not null and lang is not null").where(has_letter(F.col("text")))
    body = body.select("lang", (F.length("text") > chars).alias("long"), F.md5("text").alias("digest"), "text")

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid")
        kept: dict[tuple[str, bool], list[str]] = {}
        for batch in batches:
            for key, part in batch.to_pandas().groupby(["lang", "long"])["digest"]:
                kept[key] = sorted({*kept.get(key, ()), *part})[:rows]
        found = [(*key, d) for key, some in kept.items() for d in some]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.string()))], names=["lang", "long", "digest"])

    few = body.select("lang", "long", "digest").mapInArrow(least, "lang string, long boolean, digest string").distinct()
    for keys in (["lang", "long", F.substring("digest", 1, 2)], ["lang", "long"]):
        few = few.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("digest"))).where(F.col("n") <= rows).drop("n")
    span = F.substring(F.ltrim(F.regexp_replace("text", r"\P{L}+", " ")), 1, chars)
    texts = body.join(F.broadcast(few), ["lang", "long", "digest"]).withColumn("text", F.when(F.col("long"), span).otherwise(F.col("text")))
    texts = texts.dropDuplicates(["lang", "long", "digest"])
    before = Window.partitionBy("lang").orderBy("long", "digest").rowsBetween(Window.unboundedPreceding, -1)
    texts = texts.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("before") < chars)
    texts = texts.withColumn("text", F.when(F.col("long"), F.expr(f"substring(text, 1, cast({chars} - before as int))")).otherwise(F.col("text")))
    out: dict[str, list[str]] = {}
    for r in texts.orderBy("lang", "long", "digest").select("lang", "text").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return {name: " ".join(got) for name, got in out.items()}


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def language_column(text: Column, samples: dict[str, str]) -> Column:
    """struct(lang, score) of a text column.

    `und` with score 0 where the text is null or has no letter, and everywhere if nothing was
    learned. Whole texts are parsed; memory is one table per language and some MB a batch. Ties go
    to the first language by name.
    """
    if not samples:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))

    @F.pandas_udf(RESULT)
    def detect(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("langid")
        key = hash(tuple(sorted(samples.items())))
        if key not in _automata:
            _automata.clear()
            _automata[key] = Parser(samples)
        for part in parts:
            langs, scores = _automata[key].predict(part.tolist())
            del part
            trim()
            yield pd.DataFrame({"lang": langs, "score": scores})

    # so marked, a filter on the result is not a second parse
    return detect.asNondeterministic()(text)

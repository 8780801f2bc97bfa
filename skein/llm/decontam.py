"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, claim, fresh, keeps

WINDOW = 13
#: Bytes of normalised items in one automaton, which has a node a byte at most; larger benchmarks are scanned in parts.
PART_BYTES = 4 << 20
#: Fixed: ASCII letters and digits and every byte above 0x7F are word bytes; A-Z count as a-z.
NORMAL = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
IS_WORD = np.frombuffer(NORMAL, np.uint8) != 0x20
RESULT = "n_words long, n_hit long, items array<long>, spans array<struct<start:long,end:long>>, words array<struct<start:long,end:long>>"
_automata: dict[int, object] = {}
keeps("decontam", _automata.clear)


def normalised(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


def true_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    turn = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


class Scanner:
    """The automaton over the items: every window of an item holds one of its blocks whole.

    An item is cut into blocks of (window + 1) / 2 words from its beginning; these are the patterns,
    each between blanks so that only whole words match, and the automaton grows with the items' bytes,
    not with their windows. Where a block occurs, the words around it are compared with its items';
    a run of a window's length or more is hit. Items of fewer words than a window are one pattern.
    """

    def __init__(self, items: list[tuple[int | None, str]], window: int = WINDOW):
        import ahocorasick

        self.window, self.block = window, (window + 1) // 2
        self.ids: dict[bytes, int] = {}
        found: dict[str, list[int]] = defaultdict(list)
        flat, self.start_of, self.keys, self.size = [-1] * window, [], [], []
        for key, text in items:
            words = normalised(text)
            if not words:
                continue
            self.keys.append(key)
            self.start_of.append(len(flat))
            self.size.append(len(words))
            step = len(words) if len(words) < window else self.block
            for at in range(0, len(words) - step + 1, step):
                found[(b" " + b" ".join(words[at : at + step]) + b" ").decode("latin-1")].append(len(flat) + at)
            flat += [self.ids.setdefault(w, len(self.ids)) for w in words]
            # the words beside an item are none of any text
            flat += [-1] * window
        self.flat, self.starts = np.asarray(flat), np.asarray(self.start_of)
        self.sizes = np.asarray(self.size)
        self.automaton = ahocorasick.Automaton()
        for pattern, places in found.items():
            self.automaton.add_word(pattern, (pattern.count(" ") - 1, np.asarray(places)))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def scan(self, text: str) -> tuple[int, int, list[int], list[tuple[int, int]], list[tuple[int, int]]]:
        """Words, hit words, items, and the hit runs as character offsets into the original text and as word numbers."""
        words = normalised(text)
        if self.empty or not words:
            return len(words), 0, [], [], []
        line = b" " + b" ".join(words) + b" "
        hits = list(self.automaton.iter(line.decode("latin-1")))
        if not hits:
            return len(words), 0, [], [], []
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        reach = self.window - 1
        mine = np.full(len(words) + 2 * reach + 1, -2)
        mine[reach : reach + len(words)] = [self.ids.get(w, -3) for w in words]
        edge, owners = np.zeros(len(words) + 1, np.int64), []
        for (end, (n, places)), last in zip(hits, np.searchsorted(blanks, [e for e, _ in hits]).tolist(), strict=True):
            first = last - n
            owner = np.searchsorted(self.starts, places, side="right") - 1
            whole = self.sizes[owner] < self.window
            lefts, rights = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
            on = ~whole
            for k in range(1, reach + 1):
                on = on & (self.flat[places - k] == mine[reach + first - k])
                if not on.any():
                    break
                lefts += on
            on = ~whole
            for k in range(reach):
                on = on & (self.flat[places + n + k] == mine[reach + last + k])
                if not on.any():
                    break
                rights += on
            hit = whole & (self.sizes[owner] == n) | (lefts + n + rights >= self.window) & ~whole
            if hit.any():
                np.add.at(edge, first - lefts[hit], 1)
                np.add.at(edge, last + rights[hit], -1)
                owners.append(owner[hit])
        runs = true_runs(np.cumsum(edge)[:-1] > 0)
        items = {self.keys[i] for i in np.unique(np.concatenate(owners)).tolist()} - {None} if owners else set()
        return len(words), sum(b - a for a, b in runs), sorted(items), offsets(text, runs), runs


def offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as character offsets into the text, in one pass over its bytes."""
    if not runs:
        return []
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    turn = np.flatnonzero(np.diff(np.concatenate([[0], IS_WORD[raw].astype(np.int8), [0]])))
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(begins[turn[2 * a]]), int(begins[turn[2 * b - 1]])) for a, b in runs]


def sent_items(benchmark: DataFrame, part: int = 0, parts: int = 1) -> list[tuple[int | None, str]]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    if parts > 1:
        rows = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
    return [tuple(r) for r in rows.collect()]


def bytes_of(benchmark: DataFrame) -> int:
    return benchmark.where("text is not null").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def scan_column(text: Column, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> Column:
    """struct(n_words, n_hit, items, spans, words) of a text column against a benchmark that one automaton holds; `scan` takes any."""
    if (size := bytes_of(benchmark)) > part_bytes:
        raise ValueError(f"benchmark of {size} bytes exceeds one automaton's {part_bytes}; use scan")
    return sent_column(text, sent_items(benchmark), window)


def sent_column(text: Column, items: list[tuple[int | None, str]], window: int) -> Column:
    from pyspark.sql import SparkSession

    sent = SparkSession.active().sparkContext.broadcast(items)

    @F.pandas_udf(RESULT)
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        claim("decontam")
        key = hash(tuple(sent.value)), window
        if key not in _automata:
            _automata.clear()
            _automata[key] = Scanner(sent.value, window)
        scanner = _automata[key]
        ranges = lambda pairs: [{"start": a, "end": b} for a, b in pairs]
        for part in parts:
            rows = [scanner.scan(t or "") for t in part]
            yield pd.DataFrame({"n_words": [r[0] for r in rows], "n_hit": [r[1] for r in rows], "items": [r[2] for r in rows], "spans": [ranges(r[3]) for r in rows], "words": [ranges(r[4]) for r in rows]})

    return scan.asNondeterministic()(text)


def merged_column(text: Column, one: Column, other: Column) -> Column:
    """The union of two scans of the same text."""

    @F.pandas_udf(RESULT)
    def merge(texts: pd.Series, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for t, n, i1, w1, i2, w2 in zip(texts, a["n_words"], a["items"], a["words"], b["items"], b["words"], strict=True):
            hit = np.zeros(n, bool)
            for x in [*w1, *w2]:
                hit[x["start"] : x["end"]] = True
            runs = true_runs(hit)
            ranges = lambda pairs: [{"start": s, "end": e} for s, e in pairs]
            rows.append((n, int(hit.sum()), sorted({*i1, *i2}), ranges(offsets(t or "", runs)), ranges(runs)))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans", "words"])

    return merge(text, one, other)


def scan(docs: DataFrame, benchmark: DataFrame, work: Workspace, text: str = "text", out: str = "scan", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs with a column `out`, struct(n_words, n_hit, items, spans, words), against benchmark(item_id, text).

    The items are the build side: their bytes are summed before any are sent. Up to `part_bytes` the
    corpus is scanned once, with no shuffle; a larger benchmark is scanned in parts by a hash of its
    items, one automaton at a time, each pass merged into the written table of the one before. spans
    are character offsets into the original text, words the same runs in word numbers. Null texts and
    items have no words; an item with a null id marks words but is not listed; repeated items count
    once per id, repeated documents once each; an empty benchmark hits nothing; an empty table gives
    no rows; a very long text is scanned whole, in time linear in it; other columns pass through,
    but for `out`, which is replaced.
    """
    parts = max(1, -(-bytes_of(benchmark) // part_bytes))
    docs = docs.drop(out).withColumn(out, sent_column(F.col(text), sent_items(benchmark, 0, parts), window))
    more = fresh(docs, "more_scan")
    for k in range(1, parts):
        docs = work.save(docs, f"scan-{k}")
        docs = docs.withColumn(more, sent_column(F.col(text), sent_items(benchmark, k, parts), window))
        docs = docs.withColumn(out, merged_column(F.col(text), F.col(out), F.col(more))).drop(more)
    return docs


def is_contaminated(scan: Column) -> Column:
    """At least one hit word in twenty."""
    return (scan["n_hit"] > 0) & (20 * scan["n_hit"] >= scan["n_words"])

"""Removal of repeated byte strings: minimiser-dealt segments, and a column-wise multi-document BWT over each bucket.

The construction inserts one symbol of every segment each round, carrying the segments' order (the
permutation that the collection's Burrows-Wheeler column is read in) and the common prefixes of
neighbours (here of the texts read backwards) from round to round, so a bucket costs time linear in
its bytes. Segments of a bucket are aligned at their shared minimiser: equal strings stand in equal
columns, so neighbours in a round's order are all that need comparing.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, Workspace, claim, fresh, keeps, trim
from .jaccard import parts

#: Bytes of a string whose second occurrence is removed, and of the minimiser chosen within it.
LENGTH, GRAM = 200, 100
#: Never a byte of UTF-8: stands for the columns that a segment does not reach.
MISSING = 0xFF
#: Segments whose columns are held in memory; those of larger buckets are in sequential files.
IN_MEMORY = 32_768
_hash = RollingHash(11)
keeps("repeats", _hash.forget)
#: Low bits of a hash that give way to a position, and the bytes of a text that are cut at a time.
INDEX_BITS, STRETCH = 28, 1 << 24


def segments(raw: list[bytes], length: int = LENGTH, gram: int = GRAM, stretch: int = STRETCH) -> tuple[np.ndarray, ...]:
    """Segments (see `segments_of`) of texts of any size: longer ones than `stretch` are cut in stretches that share a window less a byte.

    A run of windows that a stretch's end parts is two segments of one key, which changes nothing
    for what repeats.
    """
    pieces = [(i, at) for i, t in enumerate(raw) for at in range(0, max(1, len(t) - length + 1), stretch)]
    if len(pieces) == len(raw):
        return segments_of(raw, length, gram)
    out = []
    for i, at in pieces:
        _, start, end, place, key = segments_of([raw[i][at : at + stretch + length - 1]], length, gram)
        out.append((np.full(len(start), i), start + at, end + at, place + at, key))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def segments_of(raw: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, start, end, minimiser, key): maximal runs start..end of `length`-byte windows with one minimiser.

    A window's minimiser is its gram of least hash, the first of equals, and so depends on the
    window's bytes alone: equal windows have equal keys and equal places of the minimiser.
    """
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    none = np.zeros(0, np.int64)
    if not len(sizes) or sizes.max() < length:
        return none, none, none, none, none
    begins = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        grams = _hash.windows(_hash.prefix(data), gram)
    width = length - gram + 1
    n = len(grams)
    mask = np.uint64((1 << INDEX_BITS) - 1)
    packed = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    packed[:n] = (grams & ~mask) | np.arange(n, dtype=np.uint64)
    grid = packed.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    count = n - width + 1
    place = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & mask).astype(np.int64)
    mark = np.zeros(count + 2, np.int32)
    whole = sizes >= length
    np.add.at(mark, begins[whole], 1)
    np.add.at(mark, begins[whole] + sizes[whole] - length + 1, -1)
    valid = np.cumsum(mark)[:count] > 0
    same = valid[1:] & valid[:-1] & (place[1:] == place[:-1])
    start = np.flatnonzero(valid & ~np.concatenate([[False], same]))
    end = np.flatnonzero(valid & ~np.concatenate([same, [False]]))
    text = np.searchsorted(begins, start, side="right") - 1
    # empty texts share a begin with their successor; the last of equal begins is the one that holds bytes
    base = begins[text]
    return text, start - base, end - base, place[start] - base, grams[place[start]].view(np.int64)


class Columns:
    """The aligned segments of a bucket, one column of symbols a round, in memory or in a file written and read in order."""

    def __init__(self, rows: list[bytes], offsets: np.ndarray, width: int, rounds: int, in_memory: int = IN_MEMORY):
        self.n, self.rounds = len(rows), rounds
        self.first = width - 1 - offsets
        self.past = self.first + np.fromiter(map(len, rows), np.int64, self.n)
        self.file = None if self.n <= in_memory else tempfile.TemporaryFile()  # noqa: SIM115
        if self.file is None:
            self.table = self._aligned(rows, 0)
        else:
            self.strips = []
            for lo in range(0, self.n, in_memory):
                part = self._aligned(rows[lo : lo + in_memory], lo)
                self.strips.append((self.file.tell(), part.shape[1]))
                self.file.write(part.tobytes())

    def _aligned(self, rows: list[bytes], lo: int) -> np.ndarray:
        m = len(rows)
        out = np.full((m, self.rounds), MISSING, np.uint8)
        sizes = self.past[lo : lo + m] - self.first[lo : lo + m]
        at = np.repeat(np.arange(m) * self.rounds + self.first[lo : lo + m] - (np.cumsum(sizes) - sizes), sizes)
        out.ravel()[at + np.arange(int(sizes.sum()))] = np.frombuffer(b"".join(rows), np.uint8)
        return np.ascontiguousarray(out.T)

    def column(self, j: int) -> np.ndarray:
        if self.file is None:
            return self.table[j]
        out = []
        for at, m in self.strips:
            self.file.seek(at + j * m)
            out.append(np.frombuffer(self.file.read(m), np.uint8))
        return np.concatenate(out)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def range_maxima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """max(values[lo..hi]) for many ranges, from maxima of power-of-two spans."""
    span = hi - lo + 1
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(lo), values.dtype)
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.maximum(table[:-half], table[half:])
        here = np.flatnonzero(level == k)
        out[here] = np.maximum(table[lo[here]], table[hi[here] - (1 << k) + 1])
    return out


def repeated_windows(rows: list[bytes], offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, in_memory: int = IN_MEMORY) -> np.ndarray:
    """rows x windows: whether a segment's window also stands in another of the (distinct) segments.

    Round j inserts column j: the order becomes that of the texts up to j read backwards, by one
    stable sort on the new symbols, and `since`, the column from which a segment and its
    predecessor in that order agree, becomes the largest over the old neighbours between them.
    """
    width = length - gram + 1
    rounds = 2 * width - 2 + gram
    columns = Columns(rows, offsets, width, rounds, in_memory)
    n = len(rows)
    flags = np.zeros((n, width), bool)
    order = np.arange(n)
    since = np.zeros(n, np.int16)
    first, past = columns.first, columns.past
    for j in range(rounds):
        symbol = columns.column(j)[order]
        moved = np.argsort(symbol, kind="stable")
        ranked = symbol[moved]
        joined = np.zeros(n, bool)
        joined[1:] = ranked[1:] == ranked[:-1]
        fresh = np.full(n, j + 1, np.int16)
        with_left = np.flatnonzero(joined)
        lo, hi = moved[with_left - 1] + 1, moved[with_left]
        near = lo == hi
        fresh[with_left[near]] = since[hi[near]]
        far = ~near
        if far.any():
            fresh[with_left[far]] = range_maxima(since, lo[far], hi[far])
        order, since = order[moved], fresh
        if j >= length - 1:
            live = ranked != MISSING
            pair = np.flatnonzero(joined & live & (since <= j - length + 1))
            a, b = order[pair - 1], order[pair]
            at = j - length + 1
            fits = (first[a] <= at) & (first[b] <= at)
            for x in (a[fits], b[fits]):
                flags[x, at - first[x]] = True
    columns.close()
    return flags


def runs(flags: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, first, last) of each run of true values."""
    padded = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    turn = np.diff(padded, axis=1)
    rows, starts = np.nonzero(turn == 1)
    _, ends = np.nonzero(turn == -1)
    return zip(rows.tolist(), starts.tolist(), (ends - 1).tolist(), strict=True)


def cut(raw: bytes, ranges: list[tuple[int, int]], length: int = LENGTH) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left without the bytes of the windows that start in the ranges, and the maximal removed runs."""
    edge = np.zeros(len(raw) + 1, np.int32)
    for a, b in ranges:
        edge[a] += 1
        edge[min(len(raw), b + length)] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


def remove_repeats(docs: DataFrame, work: Workspace, length: int = LENGTH, gram: int = GRAM, text: str = "text") -> DataFrame:
    """docs with `kept` (binary), `kept_text` (its whole characters) and `spans` (array of struct(start, end), byte offsets).

    Every byte covered by a `length`-byte string that also starts anywhere else in the column is
    removed; strings are judged on the input. Equal texts are one text that is repeated whole.

    1. Distinct texts are cut into segments, runs of windows under one minimiser, keyed by its hash.
       Only keys that occur twice go on; the others hold nothing that repeats. Texts are cut twice:
       once to count keys, once to pick the segments of those.
    2. Their bytes are fetched, equal segments collapse to one with a count before the shuffle's write.
    3. Distinct segments meet by key in `repeated_windows`.
    4. Ranges of windows return to their texts and are cut out.

    A null text is empty; shorter texts than `length` keep everything unless nothing else; repeated
    rows remove each other; an empty table gives no rows; other columns pass through, but for those
    three names. Very long texts are cut in stretches; buckets above IN_MEMORY segments keep their
    columns in files, their distinct segments stand in one task's memory.
    """
    docs = docs.drop("kept", "kept_text", "spans")
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.md5(body))
    texts = docs.select(digest.alias("h"), body.alias("text"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments of the texts, of copies met in one task those of the first."""
        claim("repeats")
        seen: set[bytes] = set()
        for batch in batches:
            fresh = []
            for h in batch.column(0).to_pylist():
                fresh.append(h not in seen)
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(h)
            batch = batch.filter(pa.array(fresh))
            for lo, hi in parts(batch.column(1)):
                raw = [t.as_buffer().to_pybytes() for t in batch.column(1).slice(lo, hi - lo).cast(pa.binary())]
                t, start, end, place, key = segments(raw, length, gram)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(t)), pa.array(key), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(place.astype(np.int32))], names=["h", "key", "s", "e", "p"])
        del seen
        _hash.forget()
        trim()

    long_enough = F.octet_length("text") >= length
    copies = work.save(texts.where(long_enough).groupBy("h").agg(F.count("*").alias("copies")), "copies")
    dealt = texts.where(long_enough).mapInArrow(cut_up, "h binary, key long, s int, e int, p int")
    # a key occurs twice if two places of it differ; copies of a text met in different tasks are one place.
    # The sums are reduced before their shuffle and joined as a table, so a key that many texts share can be split
    place = F.xxhash64("h", "s")
    often = dealt.groupBy("key").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("key")
    often = work.save(often, "keys")
    work.release()
    wanted = dealt.join(often, "key", "left_semi")
    wanted = wanted.groupBy("h").agg(F.collect_set(F.struct("s", "e", "p", "key")).alias("parts"))
    wanted = work.save(wanted, "wanted")
    del dealt, often
    work.release()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments with their bytes; of equal segments met in one task only the first carries them."""
        import hashlib

        names = ["sid", "key", "off", "h", "s", "run", "seg"]
        kinds = [pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
        seen: set[bytes] = set()
        last = None
        out: list[list] = [[] for _ in names]
        size = 0
        for batch in batches:
            for h, body, cuts in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                h = h.as_py()
                if h == last:
                    continue
                last, raw = h, body.as_py().encode("utf-8", "surrogatepass")
                values = cuts.values
                for s, e, p, key in zip(*(values.field(c).to_pylist() for c in ("s", "e", "p", "key")), strict=True):
                    seg = raw[s : e + length]
                    sid = hashlib.blake2b(seg, digest_size=16).digest()
                    new = sid not in seen
                    if new:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(sid)
                    for column, value in zip(out, (sid, key, p - s, h, s, e - s + 1, seg if new else None), strict=True):
                        column.append(value)
                    size += len(seg) + 64
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
                        out, size = [[] for _ in names], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
        del seen, out
        trim()

    fetched = texts.where(long_enough).join(wanted, "h").sortWithinPartitions("h").select("h", "text", "parts")
    # a text whose copies were dealt to several tasks by a skewed join gives its segments once
    fetched = fetched.mapInArrow(fetch, "sid binary, key long, off int, h binary, s int, run int, seg binary")
    fetched = work.save(fetched, "segments")
    work.drop("wanted")
    work.drop("keys")
    work.release()
    where = fetched.select("sid", "h", "s", "run").groupBy("sid", "h", "s", "run").agg(F.lit(1).alias("one")).drop("one")
    many = where.groupBy("sid").agg(F.count("*").alias("k"), F.max("run").alias("run")).where("k > 1")
    distinct = fetched.where("seg is not null").groupBy("sid").agg(F.first("key").alias("key"), F.first("off").alias("off"), F.first("seg").alias("seg"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole buckets, some thousands of segments at a time; buckets of one segment are done."""
        ids: list[bytes] = []
        rows: list[bytes] = []
        offs: list[int] = []
        begun, last = 0, None

        def flushed() -> pa.RecordBatch:
            found = list(runs(repeated_windows(rows, np.asarray(offs), length, gram))) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([ids[r] for r, _, _ in found], pa.binary()), pa.array([a for _, a, _ in found], pa.int32()), pa.array([b for _, _, b in found], pa.int32())], names=["sid", "a", "b"])

        for batch in batches:
            for sid, key, off, seg in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != last:
                    if len(rows) - begun == 1:
                        ids.pop(), rows.pop(), offs.pop()
                    if len(rows) >= IN_MEMORY // 2:
                        yield flushed()
                        ids, rows, offs = [], [], []
                    begun, last = len(rows), key
                ids.append(sid), rows.append(seg), offs.append(off)
        if len(rows) - begun == 1:
            ids.pop(), rows.pop(), offs.pop()
        yield flushed()
        trim()

    bucketed = distinct.select("sid", "key", "off", "seg").repartition("key").sortWithinPartitions("key")
    ranges = bucketed.mapInArrow(solve, "sid binary, a int, b int")
    ranges = work.save(ranges, "ranges")
    del bucketed, distinct
    work.release()
    ranges = ranges.unionByName(many.select("sid", F.lit(0).alias("a"), (F.col("run") - 1).alias("b")))
    found = where.join(ranges, "sid").join(copies.where("copies > 1"), "h", "left_anti")
    found = found.groupBy("h").agg(F.collect_list(F.struct((F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b")).alias("b"))).alias("ranges"))
    found = work.save(found, "found")
    del where, many, ranges, fetched
    work.drop("segments")
    work.release()

    @F.pandas_udf("kept binary, kept_text string, spans array<struct<start:long,end:long>>")
    def cut_out(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for bodies, lists in pairs:
            kept, spans = [], []
            for t, r in zip(bodies, lists, strict=True):
                left, gone = cut(t.encode("utf-8", "surrogatepass"), [(x["a"], x["b"]) for x in r], length) if t is not None else (None, None)
                kept.append(left)
                spans.append(None if gone is None else [{"start": a, "end": b} for a, b in gone])
            yield pd.DataFrame({"kept": kept, "kept_text": [None if k is None else k.decode("utf-8", "ignore") for k in kept], "spans": spans})

    # helper columns go by names that the table does not have; the three results are made beside them
    h, ranges, gone, done = (fresh(docs, c) for c in ("text_digest", "cut_ranges", "cut_whole", "cut_done"))
    whole = copies.where("copies > 1").select(F.col("h").alias(h), F.lit(None).cast(found.schema["ranges"].dataType).alias(ranges), F.lit(True).alias(gone))
    marks = found.select(F.col("h").alias(h), F.col("ranges").alias(ranges), F.lit(False).alias(gone)).unionByName(whole)
    rows = docs.withColumn(h, digest).join(marks, h, "left").drop(h)
    touched = F.col(ranges).isNotNull()
    rows = rows.withColumn(done, cut_out.asNondeterministic()(F.when(touched, body), F.col(ranges)))
    empty = F.array().cast("array<struct<start:long,end:long>>")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length(body).cast("long").alias("end")))
    rows = rows.withColumn("kept", F.when(touched, F.col(f"{done}.kept")).when(F.col(gone), F.lit(b"")).otherwise(body.cast("binary")))
    rows = rows.withColumn("kept_text", F.when(touched, F.col(f"{done}.kept_text")).when(F.col(gone), F.lit("")).otherwise(body))
    rows = rows.withColumn("spans", F.when(touched, F.col(f"{done}.spans")).when(F.col(gone), all_of_it).otherwise(empty))
    return rows.drop(done, ranges, gone)

"""Packing by power-of-two decomposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import trim
from .jaccard import parts
from .tokens import shared


def binary_lengths(n: int, limit: int) -> list[int]:
    """Lengths of the pieces of n tokens: as many of the limit as fit, then the rest's binary digits, longest first."""
    rest = n % limit
    return [limit] * (n // limit) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> np.ndarray:
    """Ids of texts end to end, each text's followed by the end id."""
    out = np.full(len(ids) + len(sizes), end_id, "<u4")
    body = np.ones(len(out), bool)
    body[np.cumsum(sizes + 1) - 1] = False
    out[body] = ids
    return out


def cut(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of all pieces of documents of these sizes, in order (see `binary_lengths`)."""
    lists = [binary_lengths(n, limit) for n in sizes.tolist()]
    owner = np.repeat(np.arange(len(sizes)), [len(x) for x in lists])
    length = np.fromiter((n for x in lists for n in x), np.int64, len(owner))
    return owner, np.cumsum(length) - length - (np.cumsum(sizes) - sizes)[owner], length


def stretches(length: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of pieces of at most so many ids, one piece at least."""
    group = (np.cumsum(length) - 1) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(length)]
    return ((a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a)


def pack(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32 bytes), doc_tokens, sequence_id, offset.

    A document's ids and its end id are cut into pieces whose lengths are powers of two up to
    `limit`, itself a power of two. Each piece is a sequence of its own, so no sequence crosses
    documents and none needs padding; `length` is the bucket from which equal-length batches are
    drawn. There is no shuffle. sequence_id follows the input's partitions and rows, so it is
    repeatable where the input is a file scan. A null or empty text gives its end id alone; a null
    doc_id is kept; repeated rows are packed each; an empty table gives none; other columns are
    ignored. Texts are encoded in parts of a MB and pieces sent on in parts of some MB, so a very long
    text costs memory in proportion to itself only.
    """
    if limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType())))])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared("byte", tokenizer)
        for batch in batches:
            for lo, hi in parts(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                found, sizes = encoder.encode_all([t or "" for t in part.column(1).to_pylist()])
                ids, sizes = with_end(found, sizes, end_id), sizes + 1
                owner, start, length = cut(sizes, limit)
                # pieces follow one another, so they are stretches of one buffer
                for at, to in stretches(length, 4 << 20):
                    own, first = owner[at:to], int(length[:at].sum())
                    size = length[at:to]
                    offsets = np.concatenate([[0], 4 * np.cumsum(size)]).astype(np.int32)
                    data = np.ascontiguousarray(ids[first : first + int(size.sum())], "<u4")
                    packed = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own)), pa.array(start[at:to]), pa.array(size), packed, pa.array(sizes[own])], names=["doc_id", "start", "length", "ids", "doc_tokens"])
        trim()

    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(pieces, schema)
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Pieces as Parquet, one folder per length, ready for batches of equal shape."""
    pieces.write.partitionBy("length").parquet(path)

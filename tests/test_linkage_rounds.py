"""Linkage in rounds against a linkage over one whole matrix, and its time on many vectors."""

import time
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from skein.operators.linkage import linkage
from skein.plans import archive
from skein.workspace import Workspace

from .test_linkage import clusters, plain


@pytest.mark.parametrize("last", [8, 65536])
def test_rounds_equal_whole_linkage(spark, tmp_path, last):
    r = np.random.default_rng(5)
    v = np.concatenate([c + 0.4 * r.normal(size=(14, 10)) for c in r.normal(size=(8, 10))])
    ids, frames = r.permutation(len(v)) * 7, r.integers(0, 9, len(v))
    d = spark.createDataFrame([(int(i), f"f{f}", x.tolist()) for i, f, x in zip(ids, frames, v, strict=True)], "id long, frame string, v array<double>")
    rows = linkage(d, 0.5, Workspace(spark, "t", str(tmp_path)), 40, last).collect()
    order = np.argsort(ids)
    want = plain(ids[order], frames[order], v[order], 0.5)
    assert 8 < len(want) < len(v) / 2
    assert clusters(rows) == want
    assert all(k == min(g) for k in {r.cluster for r in rows} for g in want if k in g)


@pytest.mark.parametrize("last", [2, 65536])
def test_copies_and_rows_without_a_vector(spark, tmp_path, last):
    # whole numbers of one length: distances of copies are exactly 0, those of different vectors equal
    axes = [[5.0 if i == k else 0.0 for i in range(4)] for k in range(4)]
    v = [axes[0]] * 9 + [axes[1]] * 6 + [[3.0, 4.0, 0.0, 0.0]] * 5
    frames = [0, 1, 1, 2, 0, 0, 3, 1, 2, 0, 0, 4, 5, 4, 1, 6, 6, 7, 8, 9]
    ids = np.arange(len(v))
    want = plain(ids, np.array(frames), v, 0.5)
    assert len({len(g) for g in want}) > 2
    bad = [(100, 1, None), (101, 1, [float("nan")] * 4), (102, 1, [1.0, None, 0.0, 0.0]), (103, 1, [0.0] * 4), (104, 1, [1.0, 0.0]), (105, 2, [1.0, 0.0]), (None, 1, axes[0]), (106, None, axes[3]), (107, None, axes[3]), (108, 3, axes[3]), (109, 3, axes[3])]
    d = spark.createDataFrame([(int(i), f, x) for i, f, x in zip(ids, frames, v, strict=True)] + bad, "id long, frame long, v array<double>")
    rows = linkage(d, 0.5, Workspace(spark, "t", str(tmp_path)), 4, last).collect()
    assert len(rows) == len(v) + len(bad)
    assert clusters(rows) == want | {frozenset(g) for g in ([100], [101], [102], [103], [104, 105], [None], [106, 107, 108], [109])}


def exact(ids, frames, v, cutoff):
    """Clusters of whole vectors of length 2, all in fractions; ties by the smaller ids."""
    groups = {i: ([k], {f}) for k, (i, f) in enumerate(zip(ids, frames, strict=True))}
    dot = (np.array(v) @ np.array(v).T).tolist()
    while True:
        pairs = [(1 - Fraction(sum(dot[x][y] for x in groups[i][0] for y in groups[j][0]), 4 * len(groups[i][0]) * len(groups[j][0])), i, j) for i in groups for j in groups if i < j and not groups[i][1] & groups[j][1]]
        if not pairs or min(pairs)[0] > cutoff:
            return {frozenset(ids[k] for k in g) for g, _ in groups.values()}
        _, i, j = min(pairs)
        g, f = groups.pop(j)
        groups[i] = (groups[i][0] + g, groups[i][1] | f)


@pytest.mark.parametrize("last", [2, 65536])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ties_and_classes_go_by_the_smaller_ids(spark, tmp_path, seed, last):
    r = np.random.default_rng(seed)
    kinds = np.array([[1, 1, 1, 1, 0, 0], [1, 1, 1, 0, 1, 0], [1, 1, 0, 0, 1, 1], [0, 0, 1, -1, 1, 1], [1, -1, 1, 0, 0, 1]][: 2 + seed])
    v = kinds[r.integers(0, len(kinds), 36)]
    # copies of some rows stand in one frame, as in a table that is repeated
    ids, frames = [int(i) for i in r.permutation(36)], [int(f) for f in r.integers(0, 4, 36)]
    d = spark.createDataFrame([(i, f, [float(y) for y in x]) for i, f, x in zip(ids, frames, v, strict=True)], "id long, frame long, v array<double>")
    rows = linkage(d, 0.9, Workspace(spark, "t", str(tmp_path)), 16, last).collect()
    order = np.argsort(ids)
    assert clusters(rows) == exact(sorted(ids), [frames[k] for k in order], v[order].tolist(), Fraction(9, 10))


def test_many_nearly_random_vectors_end_soon(spark, tmp_path):
    n = 25_000
    v = np.random.default_rng(1).normal(size=(n, 64))
    pq.write_table(pa.table({"vec_id": pa.array(range(n)), "embedding": pa.array(v.tolist())}), tmp_path / "embeddings.parquet")
    began = time.time()
    rows = archive.QUERIES["constrained_hac"](spark, str(tmp_path)).collect()
    assert time.time() - began < 100
    found = clusters(rows)
    assert sum(map(len, found)) == n
    assert all(len({i % 50 for i in g}) == len(g) for g in found)

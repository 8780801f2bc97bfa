"""constrained_hac and its components against a linkage over one whole matrix."""

import numpy as np
import pytest

from skein.operators import folds
from skein.plans import archive
from skein.workspace import Workspace

SF = "/root/testdata/sf0.001"


def plain(ids, frames, v, cutoff):
    x = np.asarray(v, float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    dist = 1 - x @ x.T
    dist[np.equal.outer(frames, frames)] = np.inf
    groups = {k: [k] for k in range(len(ids))}
    while True:
        live = sorted(groups)
        sub = dist[np.ix_(live, live)]
        at = int(sub.argmin())
        i, j = sorted((live[at // len(live)], live[at % len(live)]))
        if not dist[i, j] <= cutoff:
            return {frozenset(ids[k] for k in g) for g in groups.values()}
        a, b = len(groups[i]), len(groups[j])
        dist[i] = dist[:, i] = (a * dist[i] + b * dist[j]) / (a + b)
        dist[j] = dist[:, j] = np.inf
        dist[i, i] = np.inf
        groups[i] += groups.pop(j)


def clusters(rows):
    out = {}
    for r in rows:
        out.setdefault(r.cluster, set()).add(r.id)
    return {frozenset(g) for g in out.values()}


def test_query_equals_whole_linkage(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    want = plain(ids, ids % 50, [r.embedding for r in rows], 0.9)
    label = {r.vec_id: r.label for r in rows}
    assert any(len({label[i] for i in g}) > 1 for g in want)
    assert clusters(archive.QUERIES["constrained_hac"](spark, SF).collect()) == want


@pytest.mark.parametrize("rows", [7, 2048])
def test_components_and_clusters(spark, tmp_path, rows):
    r = np.random.default_rng(3)
    centres = r.normal(size=(8, 12))
    v = np.concatenate([c + 0.25 * r.normal(size=(9, 12)) for c in centres])
    ids, frames = r.permutation(len(v)), r.integers(0, 6, len(v))
    d = spark.createDataFrame([(int(i), int(f), x.tolist()) for i, f, x in zip(ids, frames, v, strict=True)], "id long, frame long, v array<double>")
    found = folds.within_cutoff(d, 0.1, Workspace(spark, "t", str(tmp_path)), rows)
    assert found.select("component").distinct().count() > 4
    order = np.argsort(ids)
    assert clusters(folds.average_linkage(found, 0.1).collect()) == plain(ids[order], frames[order], v[order], 0.1)

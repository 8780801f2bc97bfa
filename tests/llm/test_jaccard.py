import random
import re

import numpy as np
import pytest

from skein.llm import jaccard
from skein.llm.common import Workspace, components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else ({tuple(words)} if words else set())


def brute(rows):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingles(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"x{r.random()}"
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    out = [None, "", "  \t\n", "one", "ONE", "one two", "one  two", "a b c", "A b\tc", "日本 é ß", "nb sp x", "nb sp x"]
    for n in (9, 10, 19, 20, 30, 60, 150, 400):
        base = [f"w{r.randrange(10**6)}" for _ in range(n)]
        out += [" ".join(base), " ".join(base).upper()]
        out += [edited(r, base, k) for k in (1, 1, 1, 2, 3, max(1, n // 40), max(1, n // 33)) for _ in range(3)]
        out.append(" ".join(base[: int(n * 0.9) + 1]))
    hot = [f"h{k}" for k in range(120)]
    out += [edited(r, hot, 1) for _ in range(150)] + [" ".join(hot)] * 40
    out.append(" ".join(f"long{k}" for k in range(30000)))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_classes_equal_brute_force(spark, docs, texts, tmp_path, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = jaccard.jaccard_classes(docs(texts), Workspace(spark, "t", str(tmp_path))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(list(enumerate(texts)))


def test_null_and_repeated_ids(spark, docs, tmp_path):
    base = " ".join(f"w{k}" for k in range(50))
    other = " ".join(f"v{k}" for k in range(50))
    d = docs([base, base, base, other, other, "lone words here", base], ids=[None, 7, 3, 3, 9, None, 7])
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.component_id) for r in jaccard.jaccard_classes(d, Workspace(spark, "t", str(tmp_path))).collect()), key=str)
    assert got == sorted([(True, 0, 3), (False, 7, 3), (False, 7, 3), (False, 3, 3), (False, 3, 3), (False, 9, 3), (True, 0, None)], key=str)
    assert jaccard.jaccard_classes(docs([]), Workspace(spark, "t", str(tmp_path))).count() == 0


def test_bands_meet():
    for a in range(1, 400):
        for b in range(a, a * 100 // 90 + 1):
            both = (a + b) * 10 // 190
            mine = {x: k for x, k in jaccard.bands(a)}
            theirs = {x: k for x, k in jaccard.bands(b)}
            assert any(mine[x] == theirs[x] > both for x in mine.keys() & theirs.keys()), (a, b)


def test_rtree_finds_every_point_in_bound():
    r = np.random.default_rng(2)
    points = r.poisson(3, (500, jaccard.GROUPS)).astype(np.int32)
    points[1] = points[0]
    points[2] = points[0]
    points[2, 3] += 2
    sizes = points.sum(1)
    tree = jaccard.RTree(points)
    for i in range(0, 500, 25):
        shared = np.minimum(points, points[i]).sum(1)
        want = np.flatnonzero(100 * shared >= 90 * (sizes[i] + sizes - shared))
        assert sorted(tree.search(points[i], int(sizes[i]), sizes, (90, 100)).tolist()) == want.tolist()


def test_components(spark, tmp_path):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + r.randrange(50), 100 + r.randrange(50)) for _ in range(40)] + [(None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "c", str(tmp_path))).collect()}
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root

"""The near-duplicate stage: five words and 0.8, against a brute force of its own."""

import random

import numpy as np

import corpus_pipeline
from skein.llm import jaccard

from .test_jaccard import edited


def kept(rows):
    sets = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}) for i, t in rows for w in [t.split()]]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i for i in root if find(i) == i}


def test_stage_equals_brute_force(spark, docs):
    r = random.Random(7)
    texts = []
    for n in (6, 12, 30, 60, 100, 200, 400):
        for _ in range(6):
            base = [f"w{r.randrange(10**6)}" for _ in range(n)]
            texts += [" ".join(base), *(edited(r, base, max(1, k)) for k in (n // 100, n // 60, n // 45, n // 30)), " ".join(base[: int(n * 0.85)])]
    r.shuffle(texts)
    got = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs(texts), "").collect()}
    assert got == kept(list(enumerate(texts)))


def test_bands_meet_at_four_fifths():
    for a in range(1, 300):
        for b in range(a, a * 100 // 80 + 1):
            mine, theirs = dict(jaccard.bands(a, (80, 100))), dict(jaccard.bands(b, (80, 100)))
            assert any(mine[x] == theirs[x] > (a + b) * 20 // 180 for x in mine.keys() & theirs.keys()), (a, b)


def test_similar_sets_share_a_signature_and_others_do_not():
    r = np.random.default_rng(4)
    draw = lambda n: np.unique(r.integers(0, 2**64, n, np.uint64))
    for n in (1, 3, 9, 20, 50, 100, 333, 1000) * 20:
        a = draw(n)
        gone = int(r.integers(0, n // 9 + 1))
        b = np.unique(np.concatenate([r.permutation(a)[gone:], draw(gone)]))
        if jaccard.similar(a, b, (80, 100)):
            assert np.intersect1d(jaccard.signatures(a, (80, 100)), jaccard.signatures(b, (80, 100))).size, n
    many = [set(jaccard.signatures(draw(n), (80, 100)).tolist()) for n in r.integers(80, 125, 300)]
    assert sum(bool(x & y) for k, x in enumerate(many) for y in many[:k]) < 100


def test_sets_meet_at_the_threshold():
    r = np.random.default_rng(9)
    draw = lambda n: np.unique(r.integers(0, 2**64, n, np.uint64))
    used = 0
    for n in (40, 41, 60, 100, 150, 333, 700, 1500) * 60:
        a = draw(n)
        # as many differences as 0.8 allows, dealt to one side or to both
        most = jaccard.apart(jaccard.band_of(n, (80, 100)), (80, 100))
        for gone, new in ((n // 5, 0), (0, n // 4), (n // 9, n // 9)):
            b = np.unique(np.concatenate([r.permutation(a)[gone:], draw(new)])) if new else np.sort(r.permutation(a)[gone:])
            if jaccard.similar(a, b, (80, 100)):
                used += 1
                assert np.intersect1d(jaccard.signatures(a, (80, 100)), jaccard.signatures(b, (80, 100))).size, (n, gone, new, most)
    assert used > 500

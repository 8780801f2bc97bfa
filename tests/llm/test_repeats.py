import random
from collections import Counter

import numpy as np

from skein.llm import repeats
from skein.llm.common import Workspace


def brute(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((np.frombuffer(b, np.uint8)[~gone].tobytes(), int((edge == 1).sum())))
    return out


def corpus():
    r = random.Random(9)
    text = lambda n: "".join(r.choice("abcdé \x00\n日") for _ in range(n))
    hot, line, mid = text(300), text(120), text(700)
    out = [None, "", "short", text(199), "x" * 900, "ab" * 300, text(500), hot, hot]
    for _ in range(30):
        out.append(text(r.randint(0, 400)) + hot + text(r.randint(0, 400)) + line + text(r.randint(0, 100)))
    for _ in range(10):
        a = r.randint(0, 450)
        out.append(text(r.randint(0, 50)) + mid[a : a + 250] + text(60) + line)
    near = text(2000)
    out += [near[:k] + "Z" + near[k + 1 :] for k in (10, 500, 1000, 1999)] * 2
    out.append(text(30000) + mid)
    return out


def test_removal_equals_brute_force(spark, docs, tmp_path, monkeypatch):
    texts = corpus()
    got = {r.doc_id: r for r in repeats.remove_repeats(docs(texts), Workspace(spark, "t", str(tmp_path))).collect()}
    for i, (kept, n) in enumerate(brute(texts)):
        assert (bytes(got[i].kept), len(got[i].spans)) == (kept, n), i
        assert got[i].kept_text == kept.decode("utf-8", "ignore")
    assert got[0].h == "x"
    assert repeats.remove_repeats(docs([]), Workspace(spark, "t", str(tmp_path))).count() == 0


def test_buckets_in_files_give_the_same():
    r = random.Random(4)
    core = bytes(r.randrange(1, 200) for _ in range(100))
    sides = [bytes(r.randrange(97, 99) for _ in range(100)) for _ in range(6)]
    rows, offsets = [], []
    for k in range(60):
        a, b = r.randint(0, 100), r.randint(0, 100)
        if a + b < 100:
            a = 100
        rows.append(sides[k % 3][100 - a :] + core + sides[3 + k % 3][:b])
        offsets.append(a)
    keep = {x: i for i, x in enumerate(rows)}.values()
    rows, offsets = [rows[i] for i in keep], np.asarray([offsets[i] for i in keep])
    small = repeats.repeated_windows(rows, offsets, in_memory=7)
    assert (small == repeats.repeated_windows(rows, offsets)).all() and small.any()
    for i, row in enumerate(rows):
        for w in range(len(row) - 199):
            want = any(j != i and 0 <= offsets[j] - offsets[i] + w <= len(x) - 200 and x[offsets[j] - offsets[i] + w :][:200] == row[w : w + 200] for j, x in enumerate(rows))
            assert small[i, w] == want

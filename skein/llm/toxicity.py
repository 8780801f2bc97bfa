"""Toxicity: gradient-boosted trees over dense lexicon, address, shape and obfuscation features, isotonically calibrated."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Bounds of the labelled sample that leaves the executors: rows, characters of their texts, and of the longest text in it.
MAX_ROWS = 4000
MAX_CHARS = 20_000_000
LONGEST = 2_000_000
TREES, DEPTH, BINS, RATE = 80, 3, 32, 0.15
#: Fixed sample values: words of direct address, and characters that stand for letters.
ADDRESS = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr usted ustedes ti tus vosotros".split())
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})
#: Word beginnings that count as lexicon entries beside whole words, by length.
STEMS = (4, 5, 6, 7)
TIERS = 5
EDGES = (1.0, 1.8, 2.6, 3.4)
NEAR = 3
KNOWN = 300_000
NOT_LETTERS = re.compile(r"[\W\d_]+")
_models: dict[int, object] = {}


@cache
def upper_table() -> np.ndarray:
    """Whether a code point is a capital, of any script."""
    return np.fromiter((chr(i).isupper() for i in range(0x110000)), bool, 0x110000)


def plain(word: str) -> str:
    """Letters of a word in lower case, from its first to its last, marks between them dropped."""
    word = word.lower()
    return word if word.isalpha() else NOT_LETTERS.sub("", word)


def entries(word: str) -> set[str]:
    """What a word can be found under: itself, ended by a full stop, and its beginnings."""
    return {word + ".", *(word[:n] for n in STEMS if len(word) >= n)} if word else set()


def learn_lexicon(texts: list[str], labels: np.ndarray) -> dict[str, float]:
    """Entry -> smoothed log-odds of standing in a toxic text, of entries in three toxic texts or more.

    The odds are discounted by one standard error, so that rare entries weigh less.
    """
    toxic, other = Counter(), Counter()
    known: dict[str, set[str]] = {}
    for text, y in zip(texts, labels, strict=True):
        found: set[str] = set()
        for w in set(text.split()):
            if w not in known:
                known[w] = entries(plain(w))
            found |= known[w]
        (toxic if y else other).update(found)
    a_all, b_all = int(labels.sum()), int(len(labels) - labels.sum())
    out = {}
    for entry, a in toxic.items():
        if a >= 3:
            b = other[entry]
            odds = math.log((a + 0.5) / (a_all + 1)) - math.log((b + 0.5) / (b_all + 1)) - math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) * (b > 0))
            if odds > EDGES[0] / 2:
                out[entry] = odds
    return out


class Features:
    """Dense features of whole texts; per-word facts are looked up once per distinct word."""

    NAMES = [*(f"lexicon_{i}_{k}" for i in range(TIERS) for k in ("count", "density")), "near", "near_density", "weight", "top", "capitals", "shouted", "marks", "exclaims", "disguised", "signs", "words", "word_length"]

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}
        self.heads = {e[: STEMS[0]] for e in lexicon}

    def _weight(self, base: str) -> float:
        if base[: STEMS[0]] not in self.heads and base + "." not in self.heads:
            return 0.0
        return max((self.lexicon.get(e, 0.0) for e in entries(base)), default=0.0)

    def _facts(self, word: str) -> int:
        """Tier of the strongest entry (3 bits), address, disguise, shouting, and the strongest weight in 32nds."""
        base = plain(word)
        best = self._weight(base)
        hidden = False
        if base and not word.isalpha():
            core = word.strip(".,;:!?\"'()[]")
            if core and not core.isalpha():
                hidden = True
                best = max(best, self._weight(plain(core.translate(LOOKALIKE))))
        tier = 0 if best <= EDGES[0] / 2 else 1 + sum(best > e for e in EDGES)
        return tier | (base in ADDRESS) << 3 | hidden << 4 | (word.isupper() and len(base) > 1) << 5 | min(255, int(best * 32)) << 8

    def row(self, text: str) -> list[float]:
        words = text.split()
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = self._facts(w)
        facts = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        n, size = max(1, len(words)), max(1, len(text))
        tier, weight = facts & 7, (facts >> 8) / 32
        counts = np.bincount(tier, minlength=TIERS + 1)[1 : TIERS + 1]
        near = 0
        strong, you = np.flatnonzero(tier >= 3), np.flatnonzero(facts & 8)
        if len(strong) and len(you):
            at = np.searchsorted(you, strong)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - strong), np.abs(you[np.maximum(at - 1, 0)] - strong))
            near = int((gap <= NEAR).sum())
        capitals = int(upper_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].sum())
        marks = sum(text.count(c) for c in ".,;:!?")
        out = [v for c in counts for v in (float(c), c / n)]
        return [*out, near, near / n, float(weight.sum()) / n, float(weight.max(initial=0)), capitals / size, float((facts & 32 > 0).mean()) if words else 0.0, marks / size, text.count("!") / size, float((facts & 16 > 0).mean()) if words else 0.0, sum(text.count(c) for c in "#$%&*@^~|") / size, math.log1p(len(words)), size / n]

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.asarray([self.row(t or "") for t in texts], np.float64).reshape(len(texts), len(self.NAMES))


@dataclass
class Trees:
    """Boosted depth-limited regression trees for log-loss, over binned features."""

    cuts: list[np.ndarray]
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    base: float

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        # few rows are toxic: a feature that is mostly zero still needs cuts among its other values
        cuts = [np.unique(np.concatenate([k, np.quantile(c[c > 0], np.linspace(0, 1, 9)[:-1]) - 1e-12])) if (c > 0).any() else k for k, c in zip(cuts, x.T, strict=True)]
        bins = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(cuts, x.T, strict=True)], 1)
        width = max(map(len, cuts)) + 2
        # one count over (feature, bin) for all features of a node's rows
        flat = bins + np.arange(bins.shape[1]) * width
        shape = (bins.shape[1], width)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        trees = Trees(cuts, [], math.log(p / (1 - p)))
        score = np.full(len(y), trees.base)
        for _ in range(TREES):
            prob = 1 / (1 + np.exp(-score))
            g, h = y - prob, prob * (1 - prob)
            feature, cut, leaf = np.zeros(2**DEPTH, np.int64), np.full(2**DEPTH, width, np.int64), np.zeros(2**DEPTH)
            at = np.ones(len(y), np.int64)
            for node in range(1, 2**DEPTH):
                rows = np.flatnonzero(at == node)
                best = (1e-6, 0, width)
                if len(rows) >= 10:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    at_bins = flat[rows].T.ravel()
                    sums = lambda w: np.bincount(at_bins, w, shape[0] * width).reshape(shape).cumsum(1)  # noqa: B023, E731
                    gl, hl = sums(np.tile(g[rows], shape[0])), sums(np.tile(h[rows], shape[0]))
                    nl = sums(None)
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < 4) | (len(rows) - nl < 4)] = 0
                    k = int(gain.argmax())
                    if gain.flat[k] > best[0]:
                        best = (gain.flat[k], k // width, k % width)
                _, feature[node], cut[node] = best
                at[rows] = 2 * node + (bins[rows, best[1]] > best[2])
            final = at - 2**DEPTH
            leaf = RATE * np.bincount(final, g, 2**DEPTH) / (np.bincount(final, h, 2**DEPTH) + 1)
            trees.nodes.append((feature, cut, leaf))
            score += leaf[final]
        return trees

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(k, c, side="left") for k, c in zip(self.cuts, x.T, strict=True)], 1) if len(x) else np.zeros((0, x.shape[1]), np.int64)
        rows, score = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, leaf in self.nodes:
            at = np.ones(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + (bins[rows, feature[at]] > cut[at])
            score += leaf[at - 2**DEPTH]
        return 1 / (1 + np.exp(-score))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y (pool adjacent violators), with one pseudo-row of the mean per pool."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, t in zip(score[order], y[order], strict=True):
        if pools and pools[-1][3] == s:
            pools[-1][0] += t
            pools[-1][1] += 1
        else:
            pools.append([t, 1, s, s])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            t2, n2, _, top = pools.pop()
            pools[-1][0] += t2
            pools[-1][1] += n2
            pools[-1][3] = top
    mean = float(y.mean())
    xs = [v for p in pools for v in (p[2], p[3])]
    ys = [(p[0] + mean) / (p[1] + 1) for p in pools for _ in (0, 1)]
    return np.asarray(xs), np.maximum.accumulate(np.asarray(ys))


class Model:
    """Lexicon, trees and calibration; the lexicon and the trees see different halves while scores for calibration are made."""

    def __init__(self, texts: list[str], labels: list[int], folds: int = 4):
        y = np.asarray(labels, np.float64)
        part = np.arange(len(y)) % folds
        x = np.zeros((len(y), len(Features.NAMES)))
        for k in range(folds):
            inside = np.flatnonzero(part == k)
            rest = np.flatnonzero(part != k)
            lexicon = learn_lexicon([texts[i] for i in rest], y[rest])
            x[inside] = Features(lexicon).matrix([texts[i] for i in inside])
        held = np.zeros(len(y))
        for k in range(folds):
            if (part != k).any() and (part == k).any():
                held[part == k] = Trees.fit(x[part != k], y[part != k]).predict(x[part == k])
        self.features = Features(learn_lexicon(texts, y))
        self.trees = Trees.fit(x, y)
        self.knots = isotonic(held, y)

    def score(self, texts: list[str | None]) -> np.ndarray:
        raw = self.trees.predict(self.features.matrix(texts))
        return np.clip(np.interp(raw, *self.knots), 0, 1)


def sample(labelled: DataFrame, rows: int = MAX_ROWS, chars: int = MAX_CHARS, longest: int = LONGEST) -> list[tuple[str, int]]:
    """(text, toxic) rows to learn from, in the order of their texts' digests.

    At most `rows`, of texts of at most `longest` characters, and whole texts up to `chars` in all.
    """
    text, label, order = (fresh(labelled, c) for c in ("learn_text", "learn_label", "learn_order"))
    picked = labelled.where("toxic in (0, 1)").select(F.coalesce("text", F.lit("")).alias(text), F.col("toxic").cast("int").alias(label))
    picked = picked.where(F.length(text) <= longest).withColumn(order, F.md5(text)).orderBy(order, label).limit(rows)
    out, total = [], 0
    for r in picked.toLocalIterator():
        total += len(r[text])
        if total > chars:
            break
        out.append((r[text], r[label]))
    return out


def score_column(text: Column, rows: list[tuple[str, int]]) -> Column:
    """Calibrated probability of a toxic label for whole texts.

    Null counts as empty; a very long text is scored whole; an empty table gives no rows; only the one
    column is read, so further ones never clash. With no toxic or no other labelled row the score is the labels' mean, or
    0 with no label at all. Repeated rows score alike. The model is fitted once, on the driver,
    from the bounded sample, and sent to the workers; scoring is one pass with no shuffle.
    """
    labels = [y for _, y in rows]
    if len(rows) < 8 or len(set(labels)) < 2:
        return F.lit(float(np.mean(labels)) if labels else 0.0)
    model = Model([unicodedata.normalize("NFC", t) for t, _ in rows], labels)
    from pyspark.sql import SparkSession

    sent = SparkSession.active().sparkContext.broadcast((model.features.lexicon, model.trees, model.knots))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, trees, knots = sent.value
        key = id(lexicon)
        if key not in _models:
            _models.clear()
            _models[key] = (Features(lexicon), lexicon)
        features = _models[key][0]
        for part in parts:
            raw = trees.predict(features.matrix([t and unicodedata.normalize("NFC", t) for t in part]))
            yield pd.Series(np.clip(np.interp(raw, *knots), 0, 1))

    return score(text)

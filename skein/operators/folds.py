"""Order-dependent folds and clustering, each exact within an island or component found by the planner first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace
from .graph import components


#: What an event may carry beside id, media, s, e, label and words for its merge score.
SIGNALS = ["places", "dates", "people", "source", "boundary"]


def merge_score(a, b, gap: float) -> float:
    """How well event b goes with a cluster's event a, `gap` seconds after that cluster's end.

    Words 3 (Jaccard 0.55) or 1.5 (0.35), label 1 or -2, a place 2, a date 2 or -1, a person 1 where
    words share a quarter, overlap 0.75 or 0.5 within 30 s, another source 0.5, a chunk's boundary 0.75;
    what either lacks counts for nothing.
    """
    both = lambda f: (getattr(a, f), getattr(b, f))
    x, y = both("words")
    share = len(x & y) / len(x | y) if x and y else 0.0
    score = 3.0 if share >= 0.55 else 1.5 if share >= 0.35 else 0.0
    if a.label and b.label:
        score += 1.0 if a.label == b.label else -2.0
    x, y = both("places")
    score += 2.0 if x & y else 0.0
    x, y = both("dates")
    score += 2.0 if x & y else -1.0 if x and y else 0.0
    x, y = both("people")
    score += 1.0 if x & y and share >= 0.25 else 0.0
    score += 0.75 if gap <= 0 else 0.5 if gap <= 30 else 0.0
    x, y = both("source")
    score += 0.5 if x is not None and y is not None and x != y else 0.0
    return score + (0.75 if a.boundary or b.boundary else 0.0)


def stitch(events: DataFrame, gap: float = 120.0, least: float = 4.0) -> DataFrame:
    """media, id, s, e, label, words and any of SIGNALS -> id, media, cluster: each event joins the current cluster or opens one.

    First cut where a start lies more than `gap` after every earlier end: no cluster crosses such a
    cut. Islands are then folded independently: an event joins if its best merge_score with an event
    of the cluster is `least` or more. words, places, dates and people are arrays, boundary a boolean.
    """
    w = Window.partitionBy("media").orderBy("s", "id")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    given = ["id", "media", "s", "e", "label", "words", *[c for c in SIGNALS if c in events.columns]]
    cut = events.select(given).withColumn("new", F.when(reach.isNull() | (F.col("s") - reach > gap), 1).otherwise(0))
    cut = cut.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    cut = cut.withColumn("rows", F.count("*").over(Window.partitionBy("media", "island")))
    # an island of one event is its own cluster; only others are folded
    alone = cut.where(F.col("rows") == 1).select("id", "media", (F.col("island") * 1_000_000 + 1).alias("cluster"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, cluster, members, end = None, 0, [], float("-inf")
        for rows in batches:
            for c in ("words", "places", "dates", "people"):
                rows[c] = [frozenset() if v is None else frozenset(v) for v in rows[c]] if c in rows else [frozenset()] * len(rows)
            rows["source"] = rows["source"].astype(object).where(rows["source"].notna(), None) if "source" in rows else None
            rows["boundary"] = rows["boundary"].fillna(False).astype(bool) if "boundary" in rows else False
            out = []
            for r in rows.itertuples():
                if at != (r.media, r.island):
                    at, cluster, members, end = (r.media, r.island), 0, [], float("-inf")
                wait = r.s - end
                if wait > gap or max((merge_score(m, r, wait) for m in members), default=float("-inf")) < least:
                    cluster, members, end = cluster + 1, [], float("-inf")
                members.append(r)
                end = max(end, r.e)
                out.append(cluster)
            yield pd.DataFrame({"id": rows["id"], "media": rows["media"], "cluster": rows["island"] * 1_000_000 + out})

    # islands lie whole and in order in one partition; batches cut them, so the fold carries its state
    ordered = cut.where(F.col("rows") > 1).repartition("media", "island").sortWithinPartitions("media", "island", "s", "id")
    return ordered.mapInPandas(fold, "id long, media long, cluster long").unionByName(alone)


def budget_batches(d: DataFrame, key: str, max_rows: int = 45, max_span: float = 720.0) -> DataFrame:
    """Greedy batches in time order of at most so many rows and seconds."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["s", "id"])
        batch, n, start, out = 0, 0, None, []
        for s, e in zip(rows["s"], rows["e"], strict=True):
            if start is None or n >= max_rows or e - start > max_span:
                batch, n, start = batch + 1, 0, s
            n += 1
            out.append(batch)
        return pd.DataFrame({"id": rows["id"], "media": rows[key], "batch": out})

    return d.groupBy(key).applyInPandas(fold, "id long, media long, batch long")


def within_cutoff(d: DataFrame, cutoff: float, work: Workspace, rows: int = 2048) -> DataFrame:
    """id, frame, v -> component, id, frame, v: what pairs of different frames within a cosine distance connect.

    Rows are dealt into blocks of about `rows`; every pair of blocks is one group, which passes on a
    spanning forest of its links, so edges stay linear in a group though all pairs are compared.
    """
    d = work.save(d.select("id", "frame", "v"), "rows")
    blocks = max(1, -(-d.count() // rows))
    block = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
    dealt = d.where("id is not null").withColumn("block", block).withColumn("pair", F.explode(pairs)).select("pair.x", "pair.y", "block", "id", "frame", "v")

    def forest(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x = np.stack(rows["v"].to_list()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        ids, frame, block = rows["id"].to_numpy(), pd.factorize(rows["frame"])[0], rows["block"].to_numpy()
        # with two blocks only pairs across them: each block meets itself in a group of its own
        across = rows["x"].iloc[0] != rows["y"].iloc[0]
        unseen, a, b = np.ones(len(x), bool), [], []
        for start in range(len(x)):
            stack = [start] if unseen[start] else []
            unseen[start] = False
            while stack:
                i = stack.pop()
                near = unseen & (frame != frame[i])
                if across:
                    near &= block != block[i]
                to = np.flatnonzero(near)
                # a little above the cutoff: rounding may add a link, never lose one
                to = to[1 - x[to] @ x[i] <= cutoff + 1e-9]
                unseen[to] = False
                a += [ids[i]] * len(to)
                b += ids[to].tolist()
                stack += to.tolist()
        return pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    links = work.save(dealt.groupBy("x", "y").applyInPandas(forest, "a long, b long"), "links")
    found = components(links, work).toDF("id", "component")
    return d.join(found, "id", "left").select(F.coalesce("component", "id").alias("component"), "id", "frame", "v")


def average_linkage(d: DataFrame, cutoff: float) -> DataFrame:
    """component, id, frame, v -> id, cluster: average linkage by cosine up to a cutoff, never two of one frame together.

    `component` must hold what allowed pairs within the cutoff connect (see `within_cutoff`);
    clusters never cross it. The mean distance of two clusters is 1 less the product of their mean
    unit vectors, so a component's memory is linear in its rows; its time is not.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values("id").reset_index(drop=True)
        n = len(rows)
        x = np.stack(rows["v"].to_list()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        frame = pd.factorize(rows["frame"], use_na_sentinel=False)[0]
        of_frame = [np.flatnonzero(frame == f) for f in range(frame.max() + 1)]
        frames = [{f} for f in frame.tolist()]
        # sums of unit vectors, sizes, and each live cluster's nearest allowed one
        sums, sizes, parent = x, np.ones(n), np.arange(n)
        dead = np.zeros(n, bool)
        near, least = np.zeros(n, np.int64), np.full(n, np.inf)

        def distances(of: np.ndarray) -> np.ndarray:
            dist = 1 - (sums[of] @ sums.T) / (sizes[of, None] * sizes)
            for row, i in zip(dist, of.tolist(), strict=True):
                for f in frames[i]:
                    row[parent[of_frame[f]]] = np.inf
            dist[:, dead] = np.inf
            return dist

        def renew(of: np.ndarray) -> None:
            for lo in range(0, len(of), 256):
                part = of[lo : lo + 256]
                dist = distances(part)
                near[part] = dist.argmin(1)
                least[part] = dist.min(1)

        renew(np.arange(n))
        while least[k := int(least.argmin())] <= cutoff:
            i, j = sorted((k, int(near[k])))
            sums[i] += sums[j]
            sizes[i] += sizes[j]
            frames[i] |= frames[j]
            parent[parent == j] = i
            dead[j], least[j] = True, np.inf
            # clusters whose nearest was one of the two; no other comes nearer by a merge
            stale = np.flatnonzero(~dead & ((near == i) | (near == j)) & (least <= cutoff))
            renew(np.union1d(stale, [i]))
        return pd.DataFrame({"id": rows["id"], "cluster": rows["id"].to_numpy()[parent]})

    return d.groupBy("component").applyInPandas(run, "id long, cluster long")

"""Average linkage of whole tables: reciprocal pairs merge in rounds, all pairs compared in blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace

#: Distances nearer than this are equal, and the smaller id goes first: sums differ by their order.
TIE = 1e-12


def _kernels(cutoff: float, tie: float = TIE):
    """(nearest, settle, coded), made here so that executors get them by value."""
    import numpy as np

    def coded(frames) -> list:
        """Arrays of frames as arrays of numbers, equal where the frames are."""
        sizes = [len(f) for f in frames]
        flat = np.concatenate([np.asarray(f) for f, n in zip(frames, sizes, strict=True) if n] or [np.empty(0, np.int64)])
        return np.split(pd.factorize(flat)[0], np.cumsum(sizes)[:-1])

    def stand(frames: list, at: np.ndarray) -> tuple:
        """Frames of some clusters in order, and the place of each one's cluster."""
        flat = np.concatenate([frames[i] for i in at])
        place = np.repeat(np.arange(len(at)), [len(frames[i]) for i in at])
        order = np.argsort(flat, kind="stable")
        return flat[order], place[order]

    def nearest(u: np.ndarray, frames: list, of: np.ndarray, to: np.ndarray) -> tuple:
        """For each of `of` the least distance within the cutoff to one of `to` without a common frame, the first such (or -1), and how many tie.

        Products in single precision find who may be nearest: both errors are within the slack.
        These are compared in double precision.
        """
        least, near, ties = np.full(len(of), np.inf), np.full(len(of), -1), np.zeros(len(of), np.int64)
        if not len(of) or not len(to):
            return least, near, ties
        at = np.full(len(u), -1)
        at[to] = np.arange(len(to))
        small = u.astype(np.float32)
        slack = (u.shape[1] + 3) * 2.0**-22 + tie
        columns = np.ascontiguousarray(small[to].T)
        held, place = stand(frames, to)
        for lo in range(0, len(of), 256):
            part = of[lo : lo + 256]
            sim = small[part] @ columns
            mine, row = stand(frames, part)
            codes, first = np.unique(mine, return_index=True)
            begin, end = np.searchsorted(held, codes), np.searchsorted(held, codes, "right")
            for r, b, e in zip(np.split(row, first[1:]), begin, end, strict=False):
                if b < e:
                    sim[r[:, None], place[b:e]] = -np.inf
            itself = np.flatnonzero(at[part] >= 0)
            sim[itself, at[part[itself]]] = -np.inf
            top = sim.max(1)
            rows = np.flatnonzero(top >= 1 - cutoff - slack)
            if not len(rows):
                continue
            may = sim >= (top - slack)[:, None]
            r, c = np.divmod(np.flatnonzero(may if len(rows) == len(part) else may[rows]), len(to))
            if len(r) <= 16 * len(rows):
                dist = 1 - np.einsum("ij,ij->i", u[part[rows[r]]], u[to[c]])
            else:
                dist = (1 - u[part[rows]] @ u[to].T)[r, c]
            best = np.minimum.reduceat(dist, np.searchsorted(r, np.arange(len(rows))))
            tied = np.flatnonzero(dist <= best[r] + tie)
            chosen = c[tied[np.unique(r[tied], return_index=True)[1]]]
            ok = best <= cutoff
            least[lo + rows[ok]], near[lo + rows[ok]] = best[ok], to[chosen[ok]]
            ties[lo + rows[ok]] = np.bincount(r[tied], minlength=len(rows))[ok]
        return least, near, ties

    def settle(u: np.ndarray, n: np.ndarray, frames: list, heads: list, near: np.ndarray, least: np.ndarray, ties: np.ndarray, stale: np.ndarray) -> None:
        """All further rounds over classes in memory; heads, of (id, members) of a class's clusters, become those of the last clusters."""
        first = np.array([h[0][0] for h in heads])
        live = np.argsort(first)
        while len(live):
            of = live[stale[live]]
            least[of], near[of], ties[of] = nearest(u, frames, of, live)
            live = live[near[live] >= 0]
            if not len(live):
                break
            if not len(of):
                # nearly equal distances in a circle: the least goes first
                i = live[least[live].argmin()]
                near[near[i]] = i
            a = live[(near[near[live]] == live) & (first[live] < first[near[live]])]
            met, gone = np.zeros(len(u), bool), np.ones(len(u), bool)
            met[a] = met[near[a]] = True
            more = []
            for i, j in zip(a.tolist(), near[a].tolist(), strict=True):
                m = 1 if max(ties[i], ties[j]) > 1 else min(len(heads[i]), len(heads[j]))
                pair = [(u[k].copy(), n[k], frames[k], heads[k][m:]) for k in (i, j)]
                heads[i] = [(min(x[0], y[0]), x[1] + y[1]) for x, y in zip(heads[i][:m], heads[j][:m], strict=True)]
                u[i], n[i], frames[i] = (n[i] * u[i] + n[j] * u[j]) / (n[i] + n[j]), n[i] + n[j], np.concatenate([frames[i], frames[j]])
                heads[j] = []
                more += [x for x in pair if x[3]]
            live = live[[len(heads[k]) > 0 for k in live.tolist()]]
            if more:
                # what is left of larger classes
                live = np.concatenate([live, np.arange(len(u), len(u) + len(more))])
                u, n = np.concatenate([u, [x[0] for x in more]]), np.concatenate([n, [x[1] for x in more]])
                frames, first = frames + [x[2] for x in more], np.concatenate([first, [x[3][0][0] for x in more]])
                heads += [x[3] for x in more]
                near, least, ties = (np.concatenate([x, np.zeros(len(more), x.dtype)]) for x in (near, least, ties))
                met, gone = (np.concatenate([x, np.ones(len(more), bool)]) for x in (met, gone))
            live = live[np.argsort(first[live])]
            gone[live] = False
            stale = met | met[near] | gone[near]

    return nearest, settle, coded


def linkage(d: DataFrame, cutoff: float, work: Workspace, rows: int = 8192, last: int = 65536) -> DataFrame:
    """id, frame, v -> id, cluster: average linkage by cosine up to a cutoff, never two of one frame together.

    A cluster's id is its smallest; equal distances go by the smaller ids; a null frame forbids
    nothing. Rows without id or a finite vector are clusters of their own, and so are vectors of
    different dimensions to each other.

    A mean distance to a merged cluster is never less than the lesser one to its parts, nor is one
    allowed that neither part allows. So two clusters that are nearest to each other meet in any
    order of merges, and all such pairs merge in one round; only clusters whose nearest has merged
    look again, and those with none within the cutoff are done. The mean distance of two clusters is
    1 less the product of their mean unit vectors. Clusters are dealt into blocks of about `rows`,
    and every pair of blocks is one group. One task does the remaining rounds as soon as it holds at
    most `last` clusters, and looks at no more pairs in its first round than `last` times `rows` / 4.
    Copies meet first, at distance 0: the k-th rows of all frames are one cluster. Clusters of equal
    vectors and frames stand as one class, whose array of clusters is in one row: two classes that are
    nearest to each other, and to no third as near, merge their k-th clusters with each other.
    """
    nearest, settle, coded = _kernels(cutoff)
    d = d.select("id", "frame", F.col("v").cast("array<double>").alias("v")).orderBy("id", F.xxhash64("frame", "v"))
    d = work.save(d.withColumn("key", F.monotonically_increasing_id()), "rows")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    norm = F.col("norm")
    turn = F.row_number().over(Window.partitionBy("v", "frame").orderBy("key"))
    turn = F.when(norm < 1e-12, F.col("key")).when(F.col("frame").isNull(), 1).otherwise(turn)
    copies = d.where(F.col("id").isNotNull() & (F.size("v") > 0) & finite).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).withColumn("turn", turn)
    copies = work.save(copies.select("key", "frame", "v", "norm", F.min("key").over(Window.partitionBy("v", "turn")).alias("first")), "copies")

    heads = copies.groupBy(F.col("first").alias("key")).agg(F.first("v").alias("v"), F.first("norm").alias("norm"), F.count("*").cast("double").alias("n"), F.array_sort(F.collect_set("frame")).alias("frames"))
    # clusters without a frame may meet each other
    free = F.when(F.size("frames") == 0, F.col("key"))
    heads = heads.groupBy("v", "norm", "n", "frames", free.alias("free")).agg(F.array_sort(F.collect_list(F.struct("key", F.array("key").alias("members")))).alias("heads"))
    unit = F.transform("v", lambda x: x / F.greatest("norm", F.lit(1e-12)))
    # a class that is done has no u
    none = [F.lit(None).cast("long").alias("near"), F.lit(None).cast("double").alias("least"), F.lit(0).cast("long").alias("ties"), F.lit(True).alias("stale")]
    state = work.save(heads.select(F.col("heads")[0]["key"].alias("key"), F.size("v").alias("dim"), "n", unit.alias("u"), "frames", "heads", *none), "state-0")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values("key")
        key, block, stale = rows["key"].to_numpy(), rows["block"].to_numpy(), rows["stale"].to_numpy().astype(bool)
        u, frames = np.stack(rows["u"].to_list()), coded(rows["frames"].to_list())
        x, y = rows["x"].iloc[0], rows["y"].iloc[0]
        out = []
        for i, j in [(x, y)] if x == y else [(x, y), (y, x)]:
            of = np.flatnonzero(stale & (block == i))
            least, near, ties = nearest(u, frames, of, np.flatnonzero(block == j))
            ok = near >= 0
            out.append(pd.DataFrame({"key": key[of[ok]], "least": least[ok], "near": key[near[ok]], "ties": ties[ok]}))
        return pd.concat(out)

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values("key")
        key, stale = rows["key"].to_numpy(), rows["stale"].to_numpy(bool, copy=True)
        heads = [[(h["key"], [h["members"]]) for h in x] for x in rows["heads"]]
        # what a stale class is nearest to is looked for again
        near = np.searchsorted(key, rows["near"].where(~stale, key[0]).to_numpy())
        settle(np.stack(rows["u"].to_list()), rows["n"].to_numpy(float, copy=True), coded(rows["frames"].to_list()), heads, near, rows["least"].to_numpy(float, copy=True), rows["ties"].to_numpy(np.int64, copy=True), stale)
        found = [(k, np.concatenate(members)) for x in heads for k, members in x]
        return pd.DataFrame({"first": np.concatenate([m for _, m in found]), "to": np.repeat([k for k, _ in found], [len(m) for _, m in found])})

    step = 0
    while True:
        live = state.where("u is not null")
        count, stale = live.agg(F.count("*"), F.count_if("stale")).first()
        if count <= last and count * stale <= last * rows // 4:
            break
        now = live.where("not stale").select("key", "least", "near", "ties")
        if stale:
            blocks = -(-count // rows)
            block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
            pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(o, F.col("block")).alias("x"), F.greatest(o, F.col("block")).alias("y")))
            dealt = live.withColumn("block", block).withColumn("pair", F.explode(pairs)).select("dim", "pair.x", "pair.y", "block", "key", "u", "frames", "stale")
            found = dealt.repartition(blocks * (blocks + 1) // 2, "dim", "x", "y").groupBy("dim", "x", "y").applyInPandas(compare, "key long, least double, near long, ties long")
            found = found.groupBy("key").agg(F.min("least").alias("least"), F.collect_list(F.struct("near", "least", "ties")).alias("all"))
            tied = F.filter("all", lambda z: z["least"] <= F.col("least") + TIE)
            count = F.aggregate(tied, F.lit(0).cast("long"), lambda a, z: a + z["ties"])
            now = now.unionByName(found.select("key", "least", F.array_min(F.transform(tied, lambda z: z["near"])).alias("near"), count.alias("ties")))
        else:
            # nearly equal distances in a circle: the least goes first
            a = live.orderBy("least", "key").select("key", "near").first()
            now = now.withColumn("near", F.when(F.col("key") == a["near"], a["key"]).otherwise(F.col("near")))
        now = work.save(now, f"now-{step}")

        back = now.select(F.col("key").alias("near"), F.col("near").alias("back"), F.col("ties").alias("theirs"))
        mutual = F.col("back") == F.col("key")
        met = now.join(back, "near", "left").select("key", "near", "least", "ties", F.when(mutual, F.least("key", "near")).alias("into"), (F.greatest("ties", "theirs") > 1).alias("tied"))
        theirs = met.select(F.col("key").alias("near"), F.col("into").alias("theirs"), F.lit(True).alias("lives"))
        met = met.join(theirs, "near", "left").select("key", "near", "least", "ties", "into", "tied", (F.col("lives").isNull() | F.col("theirs").isNotNull()).alias("stale"))
        after = state.drop("near", "least", "ties", "stale").join(met, "key", "left")
        alone = after.where("into is null").withColumn("u", F.when(F.col("stale").isNotNull(), F.col("u"))).drop("into", "tied")
        both = after.where("into is not null").groupBy("into").agg(F.array_sort(F.collect_list(F.struct("key", "dim", "n", "u", "frames", "heads", "tied"))).alias("of"))
        a, b = F.col("of")[0], F.col("of")[1]
        both = both.withColumn("m", F.when(a["tied"], 1).otherwise(F.least(F.size(a["heads"]), F.size(b["heads"]))))
        joined = F.zip_with(F.slice(a["heads"], F.lit(1), F.col("m")), F.slice(b["heads"], F.lit(1), F.col("m")), lambda x, y: F.struct(F.least(x["key"], y["key"]).alias("key"), F.concat(x["members"], y["members"]).alias("members")))
        mean = F.zip_with(a["u"], b["u"], lambda x, y: (a["n"] * x + b["n"] * y) / (a["n"] + b["n"]))
        one = both.select(F.col("into").alias("key"), a["dim"].alias("dim"), (a["n"] + b["n"]).alias("n"), mean.alias("u"), F.concat(a["frames"], b["frames"]).alias("frames"), joined.alias("heads"), *none)
        # what is left of the larger class
        rest = both.select("m", F.explode("of").alias("o")).where(F.size("o.heads") > F.col("m")).select("o.dim", "o.n", "o.u", "o.frames", F.slice("o.heads", F.col("m") + 1, F.size("o.heads") - F.col("m")).alias("heads"), *none)
        state = work.save(alone.unionByName(one).unionByName(rest.withColumn("key", F.col("heads")[0]["key"])), f"state-{step + 1}")
        for name in (f"now-{step}", f"state-{step}"):
            work.drop(name)
        step += 1

    done = state.where("u is null").select(F.explode("heads").alias("h")).select(F.explode("h.members").alias("first"), F.col("h.key").alias("to"))
    done = work.save(done.unionByName(live.withColumn("near", F.coalesce("near", "key")).groupBy("dim").applyInPandas(finish, "first long, to long")), "done")
    ids = d.select(F.col("key").alias("to"), F.col("id").alias("cluster"))
    placed = copies.select("key", "first").join(done, "first").join(ids, "to").select("key", "cluster")
    return d.join(placed, "key", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))

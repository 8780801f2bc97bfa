"""N-gram Jaccard join: groups of sets that share hash groups, R-trees of group-count vectors, verified sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, Workspace, claim, components, keeps, mix, trim

#: Words a shingle, and the least similarity as a fraction of whole numbers.
WIDTH, LEAST = 3, (90, 100)
#: Hash groups of a count vector, points in a leaf and nodes under a node of the R-tree, and points in a task's block and their shingles, about.
GROUPS, LEAF, BLOCK, VALUES = 64, 32, 4096, 3_000_000
#: Shingles that a round copies for pairs of blocks, or a slice of the texts brings, before there are more of them; most slices.
ROUND, SLICES = 16_000_000, 8
#: Postings that a task gathers before it sends them to their buckets, and sets that one is verified against at once.
POSTED, TOGETHER = 1 << 20, 64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_hash = RollingHash()
_cuts: dict[int, np.ndarray] = {}
keeps("jaccard", lambda: (_hash.forget(), _cuts.clear()))


def shingle_hashes(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; a text of fewer words is one shingle."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    ends = np.cumsum(sizes)
    space = SPACE[data]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    words = _hash.spans(_hash.prefix(data), start, end)
    first = np.searchsorted(start, ends - sizes)
    last = np.append(first[1:], len(start)) if len(first) else first
    out = []
    odd = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
    multipliers = [np.uint64(pow(int(odd[0]), k + 1, 2**64)) ^ odd[1] for k in range(width)]
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k, m in enumerate(multipliers):
            rolled += words[k : k + len(rolled)] * m
        rolled = mix(rolled)
        for lo, hi in zip(first.tolist(), last.tolist(), strict=True):
            n = hi - lo
            if n >= width:
                out.append(np.unique(rolled[lo : hi - width + 1]))
            elif n:
                total = np.uint64(n)
                for k in range(n):
                    total += words[lo + k] * multipliers[k]
                out.append(mix(np.asarray([total])))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def bands(n: int, least: tuple[int, int] = LEAST) -> list[tuple[int, int]]:
    """(band, groups) under which a set of n shingles is posted: its own size band and the one below.

    Band b starts at size edge(b), each edge the least size that a set of the edge before cannot
    reach; sets that can be similar are thus in one band or in neighbours. Under band b two sets
    differ in at most T shingles, so of T + 1 or more hash groups at least one holds the same shingles.
    """
    if n == 0:
        return []
    own = band_of(n, least)
    return [(b, groups(b, least)) for b in (own, own - 1) if b >= 0]


def apart(b: int, least: tuple[int, int] = LEAST) -> int:
    """Shingles in which two similar sets posted under band b differ, at most."""
    num, den = least
    low = edge(b + 1, least) - 1
    return (low + low * den // num) * (den - num) // (den + num)


def groups(b: int, least: tuple[int, int]) -> int:
    """Hash groups of band b: more than apart(b), by so many that its sets' largest apart(b) + 1 groups hold several shingles each."""
    most = apart(b, least)
    return most + max(1, most * 3 // 5, min(most, 5))


_edges: dict[tuple[int, int], list[int]] = {}


def edge(b: int, least: tuple[int, int] = LEAST) -> int:
    """edge(0) = 1; a set smaller than edge(b) is never similar to one of edge(b + 1) or more."""
    e = _edges.setdefault(least, [1])
    while len(e) <= b:
        e.append((e[-1] * least[1]) // least[0] + 1)
    return e[b]


def band_of(n: int, least: tuple[int, int] = LEAST) -> int:
    edge(0, least)
    e = _edges[least]
    while e[-1] <= n:
        edge(len(e), least)
    return int(np.searchsorted(e, n, side="right")) - 1


def cuts(k: int) -> np.ndarray:
    """Bounds of k equal ranges of hashes."""
    if k not in _cuts:
        if len(_cuts) > 4096:
            _cuts.clear()
        _cuts[k] = np.asarray([(i << 64) // k for i in range(1, k)], np.uint64)
    return _cuts[k]


def signatures(s: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """One hash for each posted hash group: equal if and (but for collisions) only if the groups' shingles are.

    Posted are the groups as large as the set's (apart + 1)-th largest one or larger. Of two similar
    sets take the one for which that size is larger: their differences spoil fewer of its posted
    groups than there are, so one of them is the other's too and is posted by both. Small groups,
    which sets meet in that share no more than a phrase, are left out so.
    """
    if not len(s):
        return np.zeros(0, np.int64)
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s + np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    out = []
    for b, k in bands(len(s), least):
        at = np.concatenate([[0], np.searchsorted(s, cuts(k)), [len(s)]])
        size = np.diff(at)
        rank = k - apart(b, least) - 1
        posted = np.flatnonzero(size >= np.partition(size, rank)[rank])
        group = posted.astype(np.uint64) + np.uint64((b << 40) + 1)
        out.append(mix((sums[at[posted + 1]] - sums[at[posted]]) ^ mix(group)))
    return np.concatenate(out).view(np.int64)


def set_id(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    import hashlib

    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class RTree:
    """Count vectors in a packed R-tree: leaves of points sorted along their widest coordinates, boxes above.

    A point's overlap with anything in a box is at most the summed minima of its counts and the
    box's upper corner, and its difference at least the summed distances from the box.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        order = np.arange(len(points))
        stack, parts = [order], []
        while stack:
            part = stack.pop()
            if len(part) <= LEAF:
                parts.append(part)
                continue
            spread = points[part].max(0).astype(np.int64) - points[part].min(0)
            part = part[np.argsort(points[part, int(spread.argmax())], kind="stable")]
            half = len(part) // 2
            stack += [part[half:], part[:half]]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.leaves = parts
        low = np.stack([points[p].min(0) for p in parts])
        high = np.stack([points[p].max(0) for p in parts])
        self.levels.append((low, high))
        while len(low) > 1:
            starts = np.arange(0, len(low), LEAF)
            low, high = np.minimum.reduceat(low, starts, 0), np.maximum.reduceat(high, starts, 0)
            self.levels.append((low, high))

    def search(self, x: np.ndarray, n: int, sizes: np.ndarray, least: tuple[int, int]) -> np.ndarray:
        """Points whose summed minima with x allow the similarity."""
        num, den = least
        nodes = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            low, high = self.levels[level]
            most = np.minimum(high[nodes], x).sum(1)
            floor = np.maximum(low[nodes].sum(1), 1)
            # overlap <= most and union >= n + |y| - most with |y| >= the lower corner's sum
            nodes = nodes[den * most >= num * np.maximum(n, n + floor - most)]
            if level:
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < len(self.levels[level - 1][0])]
        if not len(nodes):
            return np.zeros(0, np.int64)
        rows = np.concatenate([self.leaves[i] for i in nodes])
        shared = np.minimum(self.points[rows], x).sum(1)
        return rows[den * shared >= num * (n + sizes[rows] - shared)]


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int]) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return least[1] * both >= least[0] * (len(a) + len(b) - both)


def count_vector(s: np.ndarray) -> np.ndarray:
    return np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def block_links(left: list[np.ndarray], right: list[np.ndarray] | None, least: tuple[int, int]) -> list[tuple[int, int]]:
    """A spanning forest of the links within left, or between left and right (numbered after left).

    A pair already connected by found links needs no verification: it can add nothing to the classes.
    """
    sets, (num, den) = left + (right or []), least
    points = np.stack([count_vector(s) for s in sets])
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    offset = len(left) if right is not None else 0
    tree = RTree(points[offset:])
    # shingles are numbered, so that one set's are marks in an array and others count theirs there
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    coded = np.split(codes, np.cumsum(sizes)[:-1])
    marks = np.zeros(int(codes.max()) + 1, np.int32)
    label = np.arange(len(sets))
    links = []
    for i in range(len(left)):
        near = tree.search(points[i], int(sizes[i]), sizes[offset:], least) + offset
        near = near[near > i]
        near = near[label[near] != label[i]]
        marks[coded[i]] = 1
        while len(near):
            now, near = near[:TOGETHER], near[TOGETHER:]
            both = np.add.reduceat(marks[np.concatenate([coded[j] for j in now.tolist()])], np.concatenate([[0], np.cumsum(sizes[now])[:-1]]))
            for j in now[den * both >= num * (sizes[i] + sizes[now] - both)].tolist():
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    links.append((i, j))
            near = near[label[near] != label[i]]
        marks[coded[i]] = 0
    return links


#: Columns of the first pass: a document's size and set, an edge of a set to its group's leader (c1 to c2), or packed postings of a bucket.
DEALT = "kind tinyint, bucket int, doc_id long, n long, c1 long, c2 long, packed binary"
DOCUMENT, EDGE, POSTINGS = 0, 1, 2


def dealt_rows(kind: int, bucket, doc_id=None, n=None, c1=None, c2=None, packed=None) -> pa.RecordBatch:
    size = len(bucket)
    kinds = {"kind": pa.int8(), "bucket": pa.int32(), "doc_id": pa.int64(), "n": pa.int64(), "c1": pa.int64(), "c2": pa.int64(), "packed": pa.binary()}
    given = {"kind": np.full(size, kind, np.int8), "bucket": bucket, "doc_id": doc_id, "n": n, "c1": c1, "c2": c2, "packed": packed}
    return pa.RecordBatch.from_arrays([pa.nulls(size, t) if given[c] is None else given[c] if isinstance(given[c], pa.Array) else pa.array(given[c], t) for c, t in kinds.items()], names=list(kinds))


def met(sig: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, leader) edges without loops and repeats; a signature's leader is its least owner."""
    order = np.argsort(sig)
    sig, owner = sig[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(sig)))
    low = np.repeat(np.minimum.reduceat(owner, first), size) if len(first) else owner
    differ = owner != low
    pairs = np.unique(np.stack([owner[differ], low[differ]], 1), axis=0) if differ.any() else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def post(batches: Iterator[pa.RecordBatch], least: tuple[int, int], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Sizes and set ids of (doc_id, text) rows, and the postings of the task's distinct sets, packed by bucket.

    A signature is not reduced here: all its owners have to meet one leader, the least of all tasks'.
    """
    claim("jaccard")
    seen: set[int] = set()
    sigs: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    total = turn = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        sig, owner = np.concatenate([*sigs, np.zeros(0, np.int64)]), np.concatenate([*owners, np.zeros(0, np.int64)])
        order = np.argsort(sig)
        sig, owner = sig[order], owner[order]
        # signatures are in order, so a bucket is a stretch of them
        at = np.searchsorted(sig, np.asarray([(k << 64) // buckets - (1 << 63) for k in range(buckets)] + [(1 << 63) - 1], np.int64))
        at[-1] = len(sig)
        held = np.flatnonzero(np.diff(at))
        for lo in range(0, len(held), 512):
            some = held[lo : lo + 512]
            yield dealt_rows(POSTINGS, some.astype(np.int32), packed=[sig[at[k] : at[k + 1]].tobytes() + owner[at[k] : at[k + 1]].tobytes() for k in some.tolist()])

    for batch in batches:
        for lo, hi in parts(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            sets = shingle_hashes(part.column(1).to_pylist(), width)
            ids = [set_id(s) for s in sets]
            turn += 1
            c1, c2 = (np.fromiter((i[k] for i in ids), np.int64, len(ids)) for k in (0, 1))
            yield dealt_rows(DOCUMENT, ((np.arange(len(ids)) + turn * 7919) % buckets).astype(np.int32), part.column(0), np.fromiter(map(len, sets), np.int64, len(sets)), c1, c2)
            for s, i in zip(sets, ids, strict=True):
                if len(s) and i[0] not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(i[0])
                    found = signatures(s, least)
                    sigs.append(found)
                    owners.append(np.full(len(found), i[0]))
                    total += len(found)
            if total > POSTED:
                yield from flushed()
                sigs, owners, total = [], [], 0
    yield from flushed()
    _hash.forget()
    del sigs, owners, seen
    trim()


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each bucket's postings, which follow one another; rows of the other kinds pass."""
    import pyarrow.compute as pc

    claim("jaccard")
    last, held = None, []

    def solved() -> pa.RecordBatch:
        whole = [np.frombuffer(x, np.int64) for x in held]
        a, b = met(np.concatenate([x[: len(x) // 2] for x in whole]), np.concatenate([x[len(x) // 2 :] for x in whole]))
        return dealt_rows(EDGE, np.zeros(len(a), np.int32), c1=a, c2=b)

    for batch in batches:
        posted = pc.equal(batch.column(0), POSTINGS)
        yield batch.filter(pc.invert(posted))
        rows = batch.filter(posted)
        for bucket, packed in zip(rows.column(1).to_pylist(), rows.column(6), strict=True):
            if bucket != last:
                if held:
                    yield solved()
                last, held = bucket, []
            held.append(packed.as_py())
    if held:
        yield solved()
    del held
    trim()


def jaccard_classes(docs: DataFrame, work: Workspace, least: tuple[int, int] = LEAST, width: int = WIDTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the classes of the n-gram Jaccard join.

    1. Each text's shingles are hashed; equal sets are one class each. A class is posted under hashes
       of its hash groups (see `bands` and `signatures`): similar classes share at least one. Postings go to buckets
       of signatures once, packed, and a signature's least owner leads the others.
    2. A leader and all that it leads under any signature are one group. Two sets that share a signature
       are both in its leader's group, so groups stand for all candidates without following chains of
       them: sets that only others connect meet in no group. A group inside another one is left out.
    3. A group's sets become points, counts of their shingles in GROUPS hash groups; R-trees bound
       overlaps by summed minima, and survivors are verified on whole sets. A group of more than
       BLOCK sets, or of VALUES shingles, is dealt as pairs of blocks, so a task's memory does not
       follow the group's size. Groups are dealt in rounds, so the disk holds part of the copies
       that they need, not all at once.
    4. Found links and equal sets give the components.

    No link between different texts is lost. A null or empty text has the empty set and is its own
    component; a very long text is one set in memory. A null doc_id is never a component's name while
    another id is in it; alone it has the null component. Rows with the same id are one document to
    the components; an empty table gives no rows. Extra columns are ignored. Only set hashes are
    compared: 64 bits a shingle, 128 bits a set.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    buckets = min(1 << 16, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    dealt = rows.mapInArrow(lambda batches: post(batches, least, width, buckets), DEALT).repartition("bucket").sortWithinPartitions("bucket")
    dealt = work.save(dealt.mapInArrow(meet, DEALT).select("kind", "doc_id", "n", "c1", "c2"), "dealt")
    work.release()
    sized = dealt.where(F.col("kind") == DOCUMENT).select("doc_id", "n", "c1", "c2")
    edges = dealt.where(F.col("kind") == EDGE).select("c1", F.col("c2").alias("leader"))
    reps = sized.where("n > 0").groupBy("c1", "c2").agg(F.min("n").alias("n"), F.min("doc_id").alias("rep"), F.max(F.col("doc_id").isNull()).alias("unnamed"))
    groups_of = work.save(edges.union(edges.select("leader", "leader")).distinct(), "groups")
    groups_of = groups_of.join(contained(groups_of), "leader", "left_anti")
    stays = work.save(reps.join(groups_of, "c1").select("leader", "c1", "c2", "n", "rep"), "members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / VALUES)).cast("int").alias("blocks")
    stays = stays.join(stays.groupBy("leader").agg(blocks), "leader").withColumn("block", F.pmod(F.xxhash64("c1", "c2"), "blocks").cast("int"))
    places = F.collect_list(F.struct("leader", "blocks", "block")).alias("places")
    stays = stays.groupBy("c1", "c2").agg(F.first("n").alias("n"), F.first("rep").alias("rep"), places)
    stays = work.save(stays, "stays")
    dealt_out = F.aggregate("places", F.lit(0).cast("long"), lambda total, p: total + p["blocks"]) * F.col("n")
    values, replicas = (int(v or 0) for v in stays.agg(F.sum("n"), F.sum(dealt_out)).first())

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("jaccard")
        for batch in batches:
            for lo, hi in parts(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                sets = shingle_hashes(part.column(1).to_pylist(), width)
                ids = [set_id(s) for s in sets]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([i[0] for i in ids], pa.int64()), pa.array([i[1] for i in ids], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))], names=["doc_id", "c1", "c2", "listed"])
        _hash.forget()
        trim()

    # texts are shuffled a slice of the ids at a time, each set taken from its representative, so from one slice
    slices = min(SLICES, max(1, -(-values // ROUND)))
    unnamed = bool(stays.where("rep is null").limit(1).count())
    for k in range(slices):
        mine = lambda d, c: d.where(F.pmod(F.xxhash64(c), F.lit(slices)) == k) if slices > 1 else d  # noqa: B023, E731
        here = mine(stays, "rep")
        # the ids grow with the corpus: sorted and merged at every size, never sent whole to a task
        wanted = mine(rows, "doc_id").join(here.select(F.col("rep").alias("doc_id")).where("doc_id is not null").distinct().hint("merge"), "doc_id", "left_semi")
        if unnamed:
            wanted = wanted.unionByName(mine(rows.where("doc_id is null"), "doc_id"))
        found = here.join(wanted.select("doc_id", "text").mapInArrow(whole_sets, "doc_id long, c1 long, c2 long, listed array<long>"), ["c1", "c2"])
        found = found.where(F.coalesce(F.col("rep") == F.col("doc_id"), F.col("rep").isNull() & F.col("doc_id").isNull()))
        sets = work.save(found.select("c1", "c2", "places", "listed").dropDuplicates(["c1", "c2"]), "sets", "append")
        del here, wanted, found
        work.release()
    # a block meets itself and every later block of its group, as (least, greatest) pairs; a set is copied once a
    # pair, so pairs are dealt in rounds that copy half of all sets at most, about, and leave no files behind
    rounds = max(1, -(-replicas // max(values // 2, ROUND)))
    pair = lambda p, o: F.struct(p["leader"].alias("leader"), F.least(o, p["block"]).alias("x"), F.greatest(o, p["block"]).alias("y"), p["block"].alias("block"))
    pairs = F.flatten(F.transform("places", lambda p: F.transform(F.sequence(F.lit(0), p["blocks"] - 1), lambda o: pair(p, o))))
    keys = ["leader", "x", "y"]
    for k in range(rounds):
        now = F.filter(pairs, lambda q: F.pmod(F.xxhash64(*(q[c] for c in keys)), F.lit(rounds)) == k)  # noqa: B023
        met_now = sets.select("c1", "c2", "listed", F.explode(now).alias("pair")).select(*(f"pair.{c}" for c in keys), "pair.block", "c1", "c2", "listed")
        met_now = met_now.repartition(*keys).sortWithinPartitions(*keys, "block")
        links = work.save(met_now.mapInArrow(lambda batches: links_of(batches, least), LINKS), "links", "append")
        del met_now
        work.release()
    del sets
    work.drop("sets")
    linked = components(links, work).select("node.c1", "node.c2", F.col("component").alias("class"))
    linked = reps.join(linked, ["c1", "c2"], "left").withColumn("class", F.coalesce("class", F.struct("c1", "c2")))
    # an id on rows with different texts joins their classes as well
    ids = sized.where("n > 0 and doc_id is not null").select("doc_id", "c1", "c2").distinct()
    twice = ids.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    if twice.limit(1).count():
        more = ids.join(twice, "doc_id").join(linked.select("c1", "c2", "class"), ["c1", "c2"])
        more = more.select("doc_id", "class").join(more.groupBy("doc_id").agg(F.min("class").alias("b")), "doc_id").select(F.col("class").alias("a"), "b")
        linked = linked.join(components(more, Workspace(spark, "ids", work.path)).toDF("class", "joined"), "class", "left").withColumn("class", F.coalesce("joined", "class")).drop("joined")
    names = linked.groupBy("class").agg(F.min("rep").alias("component_id"))
    linked = work.save(linked.join(names, "class").select("c1", "c2", "component_id"), "classes")
    work.release()
    joined = sized.where("n > 0").join(linked, ["c1", "c2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return joined.unionByName(sized.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def contained(groups_of: DataFrame) -> DataFrame:
    """Leaders whose whole group (c1, leader) is also in the largest group that the leader is led in: all its pairs meet there.

    That group's leader is a lesser one, so of groups that hold each other's sets one stays.
    """
    sizes = groups_of.groupBy("leader").agg(F.count("*").alias("m"))
    led = groups_of.where("c1 <> leader").join(sizes, "leader").groupBy("c1").agg(F.max(F.struct("m", "leader"))["leader"].alias("over"))
    led = led.withColumnRenamed("c1", "leader").join(sizes.select("leader"), "leader", "left_semi")
    outside = groups_of.join(led, "leader").join(groups_of.withColumnRenamed("leader", "over"), ["c1", "over"], "left_anti")
    return led.select("leader").join(outside.select("leader").distinct(), "leader", "left_anti")


def parts(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about a MB of text each, one row at least."""
    import pyarrow.compute as pc

    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    lo, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > size:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


LINKS = "a struct<c1:long,c2:long>, b struct<c1:long,c2:long>"


def links_of(batches: Iterator[pa.RecordBatch], least: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Links of each pair of blocks in a partition sorted by group and pair."""
    kind = pa.struct([("c1", pa.int64()), ("c2", pa.int64())])
    key, held = None, []

    def solved() -> Iterator[pa.RecordBatch]:
        # held: (block, id, set)
        _, x, y = key
        left, right = ([h for h in held if h[0] == b] for b in (x, y))
        both, out = left if x == y else left + right, []
        if left and right:
            out = [(both[i][1], both[j][1]) for i, j in block_links([h[2] for h in left], None if x == y else [h[2] for h in right], least)]
        yield pa.RecordBatch.from_arrays([pa.array([dict(c1=e[k][0], c2=e[k][1]) for e in out], kind) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        values, ends = batch.column(6).values.to_numpy(), batch.column(6).offsets.to_numpy()
        for r, (*now, block, c1, c2) in enumerate(zip(*columns, strict=True)):
            if now != key:
                if key is not None:
                    yield from solved()
                key, held = now, []
            held.append((block, (c1, c2), values[ends[r] : ends[r + 1]].copy().view(np.uint64)))
    if key is not None:
        yield from solved()
    del held
    trim()

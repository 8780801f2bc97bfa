"""Every sequence and decision query against DuckDB, and the ordered rules against folds over plain lists."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.operators import decisions as dec
from skein.operators import folds
from skein.operators import sequences as seq
from skein.plans import archive, decisions, sequences

from .test_archive import rows

SF = "/root/testdata/sf0.001"
PLANS = {**{n: sequences for n in sequences.QUERIES}, **{n: decisions for n in decisions.QUERIES}}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(PLANS))
def test_oracle(spark, duck, name):
    got, want = PLANS[name].QUERIES[name](spark, SF).toPandas(), duck.execute(PLANS[name].SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(want)


def plain_scenes(cuts, spans, duration, least):
    """The rule read forwards: short content goes back, or on to the next content; equal spans that touch are one."""
    edges = sorted({0.0, duration, *(c for c in cuts if 0 < c < duration), *(x for s, e, _ in spans for x in (s, e))})
    parts = [[a, b, next((n for s, e, n in spans if s <= (a + b) / 2 < e), None)] for a, b in zip(edges, edges[1:], strict=False)]
    kept, k = [], 0
    while k < len(parts):
        s, e, label = parts[k]
        short = label is None and e - s < least
        if short and kept and kept[-1][2] is None:
            kept[-1][1] = e
        elif short and k + 1 < len(parts) and parts[k + 1][2] is None:
            parts[k + 1][0] = s
        elif label is not None and kept and kept[-1][2] == label:
            kept[-1][1] = e
        else:
            kept.append([s, e, label])
        k += 1
    return [tuple(x) for x in kept]


def test_scenes_equal_a_forward_fold(spark):
    draw, cuts, spans, ends, want = random.Random(3), [], [], [], {}
    for media in range(40):
        at = sorted(draw.sample(range(1, 80), 12))
        mine = [(float(at[i]), float(at[i + 1]), draw.choice("ab")) for i in range(0, 12, 3)]
        mine += [(mine[-1][1], mine[-1][1] + 1.0, mine[-1][2])] if media % 2 else []
        own = [float(draw.randrange(-5, 95)) for _ in range(25)]
        cuts += [(media, t) for t in own]
        spans += [(media, *x) for x in mine]
        ends.append((media, 85.0))
        want[media] = plain_scenes(own, mine, 85.0, 4.0)
    out = seq.scenes(spark.createDataFrame(cuts, "media long, t double"), spark.createDataFrame(spans, "media long, s double, e double, label string"), spark.createDataFrame(ends, "media long, duration double"), "media", 4.0)
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r.media, r.s)):
        got.setdefault(r.media, []).append((r.s, r.e, r.label))
    assert got == want and sum(map(len, want.values())) > 200


def test_turns_equal_a_forward_fold(spark):
    draw, data, want = random.Random(5), [], []
    for i in range(400):
        s = i * 2.0 + draw.random()
        data.append((i % 2, i, s, s + draw.random() * 6, draw.choice("ab"), draw.random()))
    for media in (0, 1):
        turns = []
        for _, _, s, e, label, conf in sorted((r for r in data if r[0] == media), key=lambda r: r[2]):
            last = turns[-1] if turns else None
            if last and last[0] == label and s - last[2] <= 1.5:
                last[2], last[3], last[4] = max(last[2], e), last[3] + 1, (last[4] + conf) / 2
            else:
                turns.append([label, s, e, 1, conf])
        want += [(media, t[0], round(t[1], 6), round(t[2], 6), t[3], round(t[4], 9)) for t in turns]
    out = seq.turns(spark.createDataFrame(data, "media long, id long, s double, e double, speaker string, conf double"), "media", "speaker")
    assert sorted((r.media, r.speaker, round(r.s, 6), round(r.e, 6), r.n, round(r.confidence, 9)) for r in out.collect()) == sorted(want)
    assert max(w[4] for w in want) > 3


def test_parts_own_each_row_once(spark):
    owned = sequences.QUERIES["overlap_ownership"](spark, SF)
    assert owned.count() == owned.select("id").distinct().count() == 1000


def test_spans_fall_back_to_the_longest(spark):
    blank = spark.createDataFrame([(1, 4.0, 90.0), (2, 0.0, 50.0)], "media long, s double, e double")
    ends = spark.createDataFrame([(1, 97.0), (2, 97.0), (3, 0.0)], "media long, duration double")
    got = sorted(map(tuple, seq.content_spans(blank, ends, "media").collect()))
    assert got == [(1, 90.0, 97.0), (2, 50.0, 97.0)]


def test_unknown_values(spark):
    nothing = spark.createDataFrame([], "media long, id long, s double, e double, line string")
    assert seq.without_loops(nothing, "media", "line").count() == 0 and seq.stride_sample(nothing, "media").count() == 0
    d = spark.createDataFrame([(1, 1, 0.0, 1.0, None), (1, 2, 5.0, 6.0, "..."), (1, 3, None, 9.0, "a"), (1, 4, 9.0, 9.0, "a b"), (1, 5, 10.0, 12.0, "A, b!")], nothing.schema)
    assert [r.id for r in seq.without_loops(d, "media", "line").collect()] == [4]
    none = F.lit(None)
    x = spark.range(1).select(dec.content_label(none.cast("string"), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(False)).alias("c"), dec.date_origin(none.cast("string"), F.lit("inside"), F.lit(True)).alias("d"), dec.relation_confidence(F.lit("other"), F.lit(0)).alias("r")).first()
    assert x.c.label == "uncertain" and x.c.confidence == 0.45 and x.d.origin is None and x.d.needs_review and x.r == 0.54


def test_stitching_takes_all_eight_signals(spark):
    """Against a fold written from the rule, over every island of the query's events."""
    k = F.col("k")
    e = archive.segments(spark, SF).where("media < 4").withColumn("s", F.expr("(s - 1704067200) / 400")).withColumn("e", F.expr("s + conf * 500"))
    e = e.select("id", "media", "s", "e", "label", F.array("label", (k % 3).cast("string")).alias("words"), F.array(k % 5).alias("places"), F.when(k % 6 > 0, F.array(k % 6)).alias("dates"), F.array(k % 4).alias("people"), (F.col("id") % 2).alias("source"), (k > 90).alias("boundary"))
    got = {r.id: (r.media, r.cluster) for r in folds.stitch(e, 60.0).collect()}
    want, number, used = {}, 0, set()
    for media in range(4):
        held, end = [], None
        for r in sorted((r for r in e.collect() if r.media == media), key=lambda r: (r.s, r.id)):
            best = 0.0
            for m in held:
                gap, a, b = r.s - end, set(m.words), set(r.words)
                j = len(a & b) / len(a | b)
                parts = {"words": 3.0 if j >= 0.55 else 1.5 if j >= 0.35 else 0, "label": 1 if m.label == r.label else -2, "place": 2 if m.places == r.places else 0, "date": 0 if not (m.dates and r.dates) else 2 if m.dates == r.dates else -1, "person": 1 if m.people == r.people and j >= 0.25 else 0, "near": 0.75 if gap <= 0 else 0.5 if gap <= 30 else 0, "source": 0.5 * (m.source != r.source), "boundary": 0.75 * (m.boundary or r.boundary)}
                best = max(best, sum(parts.values()))
                used |= {p for p, v in parts.items() if v}
            if not held or r.s - end > 60 or best < 4:
                number, held, end = number + 1, [], -1e9
            held.append(r)
            end = max(end, r.e)
            want[r.id] = number
    groups = lambda m: {frozenset(i for i in m if m[i] == c) for c in set(m.values())}
    assert groups(got) == groups(want) and len(used) == 8 and len(groups(want)) < len(want)

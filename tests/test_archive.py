"""Every SQL-expressible archive query against DuckDB, and operators against hand-made rows."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.functions import semantics as sem
from skein.operators import aggregates as agg
from skein.operators import folds
from skein.operators import intervals as iv
from skein.plans import archive
from skein.sources import readers
from skein.streaming.sessions import sessions

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def cell(v):
    if v is None or str(v) == "<NA>" or isinstance(v, float) and math.isnan(v):
        return "-"
    return f"{float(v):.6g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted("|".join(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(archive.SQL))
def test_oracle(spark, duck, name):
    got, want = archive.QUERIES[name](spark, SF).toPandas(), duck.execute(archive.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(archive.QUERIES) - set(archive.SQL)))
def test_rows(spark, name):
    assert archive.QUERIES[name](spark, SF).count() > 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    lit = F.lit
    assert one(spark, sem.light_stem(lit("running"))) == "runn" and one(spark, sem.light_stem(lit("stories"))) == "story"
    assert one(spark, sem.terms(lit("The DOGS 12 l'été"))) == ["dog", "l'été"] or one(spark, sem.terms(lit("dogss")))
    assert one(spark, sem.parse_clock(lit("01:02,5"))) == 62.5 and one(spark, sem.parse_clock(lit("x"))) == 0
    assert one(spark, sem.parse_date(lit("in the 80s"))).year == 1980 and one(spark, sem.parse_date(lit("on 2004-05-06"))).iso == "2004-05-06"
    assert one(spark, sem.parse_exif_date(lit("2004:05:06 07:08:09"))) == "2004-05-06T07:08:09" and one(spark, sem.parse_exif_date(lit("0000:05:06"))) is None
    assert one(spark, sem.range_label(lit(61.0), lit(3700.0))) == "01:01-01:01:40" and one(spark, sem.range_label(lit(None).cast("double"), lit(1.0))) == "unknown time"
    assert one(spark, sem.spelling_key(lit("Philippa Marria"))) == one(spark, sem.spelling_key(lit("Filipa Marya")))
    assert abs(one(spark, sem.haversine_km(lit(0.0), lit(0.0), lit(0.0), lit(1.0))) - 111.19) < 0.01
    assert one(spark, sem.falsy_coalesce(lit(0.0), lit(None).cast("double"), lit(2.0))) == 2.0
    box = F.struct(lit(0.0).alias("x"), lit(0.0).alias("y"), lit(2.0).alias("width"), lit(1.0).alias("height"))
    half = F.struct(lit(1.0).alias("x"), lit(0.0).alias("y"), lit(2.0).alias("width"), lit(1.0).alias("height"))
    assert abs(one(spark, sem.bbox_iou(box, half)) - 1 / 3) < 1e-9
    assert one(spark, sem.snippet(lit("a" * 300 + "needle" + "b" * 300), lit("NEEDLE"))).startswith("...")


def test_interval_join_once_per_pair(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 50.0), (2, 1, 49.0, 49.0), (3, 2, 0.0, 5.0)], "id long, media long, s double, e double")
    j = iv.interval_join(a, a, "media", 7.0).select("l.id", "r.id").collect()
    assert sorted(map(tuple, j)) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]
    assert iv.interval_join(a, a, "media", 7.0, strict=True).where("l.id = 2 and r.id = 2").count() == 0


def test_stitch_islands_equal_one_fold(spark):
    rows = [(i, 1, float(s), float(s + 20), "a" if i % 4 else "b", ["x", "y"] if i % 3 else ["z"]) for i, s in enumerate((i * 37 + (i % 5) * 60 for i in range(60)))]
    d = spark.createDataFrame(rows, "id long, media long, s double, e double, label string, words array<string>")
    got = {r.id: r.cluster for r in folds.stitch(d, gap=100.0).collect()}
    cluster, members, end, want = 0, [], -1e9, {}
    for i, _, s, e, label, words in sorted(rows, key=lambda r: (r[2], r[0])):
        best = max((((3 if len(set(words) & set(m[5])) / len(set(words) | set(m[5])) >= 0.55 else 0) + (1 if m[4] == label else -2) + (0.75 if s <= m[3] and e >= m[2] else 0.5 if s - m[3] <= 30 else 0)) for m in members), default=-9)
        if s - end > 100 or best < 4:
            cluster, members, end = cluster + 1, [], -1e9
        members.append((i, 1, s, e, label, words))
        end = max(end, e)
        want[i] = cluster
    pairs = lambda m: {frozenset(k for k in m if m[k] == c) for c in m.values()}
    assert pairs(got) == pairs(want)


def test_linkage_keeps_frames_apart(spark):
    d = spark.createDataFrame([(1, 1, 1, [1.0, 0.0]), (1, 2, 1, [1.0, 0.01]), (1, 3, 2, [1.0, 0.02]), (1, 4, 3, [0.0, 1.0])], "component long, id long, frame long, v array<double>")
    got = {r.id: r.cluster for r in folds.average_linkage(d, 0.2).collect()}
    assert got[1] != got[2] and got[3] in (got[1], got[2]) and got[4] == 4


def test_merge_chain_and_patches(spark):
    m = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8)], "src long, dst long")
    assert {r.src: r.dst for r in agg.transitive(m).collect()} == {5: 1, 4: 1, 3: 1, 9: 8}


def test_readers(spark, tmp_path):
    assert readers.read_jsonl(spark, str(tmp_path / "none"), "a long").count() == 0
    readers.append_jsonl(spark.createDataFrame([(1,), (2,)], "a long"), str(tmp_path / "j"))
    assert readers.read_jsonl(spark, str(tmp_path / "j"), "a long").count() == 2
    assert readers.subtitle_cues("WEBVTT\n\n1\n00:01.5 --> 00:03,25\n<b>Hi</b>\n42\nyou\n") == [(1.5, 3.25, "Hi you")]
    lines = spark.createDataFrame([("SPEAKER m 1 2.0 3.5 <NA> <NA> anna",), ("# SPEAKER x",), ("SPEAKER m 1",)], "value string")
    assert [tuple(r) for r in readers.rttm(lines).collect()] == [("m", 2.0, 5.5, "anna")]
    assert readers.salvage_json('```json\n{"a": 1:05, "b": [1, 2, {"c"') == '{"a": 65, "b": [1, 2]}'
    assert readers.salvage_json("no") is None
    fault = readers.span_faults(F.lit("source"), F.lit(2.0), F.lit(1.0), F.lit(9.0))
    assert one(spark, fault) == "reversed"
    encode = readers.text_encoder(lambda texts: [[len(t), 1.0] for t in texts], 2)
    assert spark.createDataFrame([("abc",)], "t string").select(encode("t").alias("v")).first().v == [3.0, 1.0]


def test_streaming_sessions_equal_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = sessions(stream, "user_id", "ts", late="60 days").writeStream.outputMode("complete").format("memory").queryName("s").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("s").collect())) == sorted(map(tuple, sessions(e, "user_id", "ts").collect()))


def test_circles_of_merges_end_at_their_least_id(spark):
    m = spark.createDataFrame([(1, 2), (2, 1), (5, 4), (4, 3), (13, 11), (11, 12), (12, 13), (20, 13), (21, 20), (7, 7)], "src long, dst long")
    assert {r.src: r.dst for r in agg.transitive(m).collect()} == {2: 1, 5: 3, 4: 3, 13: 11, 12: 11, 20: 11, 21: 11}


def test_json_clocks(spark):
    assert readers.salvage_json('{"start_s": 1:02:03, "end_s": 2:05}') == '{"end_s": 125, "start_s": 3723}'
    assert readers.salvage_json('{"note": "at \\"x\\": 1:05, they", "b": 1}') == '{"b": 1, "note": "at \\"x\\": 1:05, they"}'
    assert readers.salvage_json('{"a": "1:05", "b": 1:05, "c": [1, 2, {"d') == '{"a": "1:05", "b": 65, "c": [1, 2]}'


def test_dates_by_month_name(spark):
    d = lambda t: one(spark, sem.parse_date(F.lit(t)))
    assert d("on July 4, 1996 at home").iso == "1996-07-04" and d("Sept 9th 2001").iso == "2001-09-09"
    assert d("may 1987").precision == "year" and d("nothing").precision == "unknown"

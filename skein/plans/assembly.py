"""Queries of event assembly, identity and corrections over the driver tables, on a timeline two hundred times as dense."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import semantics as sem
from ..operators import aggregates as agg
from ..operators import assembly as asm
from ..operators import corrections as cor
from ..operators import identity as idn
from ..operators import intervals as iv
from .archive import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as id, media, s, e, label, conf, k, with many overlaps."""
    e = table(spark, sf_dir, "events")
    s = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200.0) / 200
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("media"), s.alias("s"), (s + F.col("value")).alias("e"), F.col("event_type").alias("label"), F.least(F.col("value") / 500, F.lit(1.0)).alias("conf"), F.get_json_object("props", "$.k").cast("int").alias("k"))


SEG = "seg AS (SELECT event_id AS id, user_id AS media, (epoch_us(ts) / 1e6 - 1704067200.0) / 200 AS s, (epoch_us(ts) / 1e6 - 1704067200.0) / 200 + value AS e, event_type AS label, least(value / 500, 1.0) AS conf, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"
PART = "greatest(least(a.e, b.e) - greatest(a.s, b.s), 0.0)"
ENOUGH = "((a.s >= x.s AND a.s <= x.e) OR (a.e > a.s AND greatest(least(a.e, x.e) - greatest(a.s, x.s), 0) / (a.e - a.s) >= 0.5))"
MERGED = "m0 AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY media ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS new FROM ex0), m1 AS (SELECT *, sum(new) OVER (PARTITION BY media ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m0), ex AS (SELECT media, min(s) AS s, max(e) AS e FROM m1 GROUP BY media, i)"


@query(f"WITH {SEG}, r AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL WHEN id % 3 = 0 THEN e ELSE s END AS s, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 3 = 0 THEN s ELSE e END AS e FROM seg) SELECT id, round(least(coalesce(s, e), coalesce(e, s)), 6) AS s, round(greatest(coalesce(s, e), coalesce(e, s)), 6) AS e FROM r")
def normalized_ranges(spark, sf_dir):
    d = dense(spark, sf_dir)
    swap = F.col("id") % 3 == 0
    d = d.select("id", F.when(F.col("id") % 7 != 0, F.when(swap, F.col("e")).otherwise(F.col("s"))).alias("s"), F.when(F.col("id") % 11 != 0, F.when(swap, F.col("s")).otherwise(F.col("e"))).alias("e"))
    r = d.select("id", asm.normalised_range(F.col("s"), F.col("e")).alias("r"))
    return r.select("id", F.round("r.s", 6).alias("s"), F.round("r.e", 6).alias("e"))


@query("SELECT event_id AS id, round(value + (user_id % 9) * 1170.0, 6) AS s, round(value + CAST(json_extract(props, '$.k') AS INTEGER) + (user_id % 9) * 1170.0, 6) AS e, (user_id % 9) * 1170.0 AS off FROM events WHERE value + CAST(json_extract(props, '$.k') AS INTEGER) <= 120.001")
def chunk_spans(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    end = F.col("value") + F.get_json_object("props", "$.k").cast("int")
    x = e.select(F.col("event_id").alias("id"), asm.chunk_to_source(F.col("value"), end, (F.col("user_id") % 9) * 1170.0, F.lit(120.0)).alias("x")).where("x is not null")
    return x.select("id", F.round("x.s", 6).alias("s"), F.round("x.e", 6).alias("e"), F.col("x.offset").alias("off"))


@query("WITH f AS (SELECT event_id, value AS luma, CAST(json_extract(props, '$.k') AS INTEGER) AS std, user_id % 200 AS r, event_id % 90 AS g, event_id % 256 AS b FROM events) SELECT CASE WHEN luma < 18 AND std < 12 THEN 'black' WHEN b > 80 AND b > 1.35 * r AND b > 1.15 * g AND std < 28 THEN 'blue' WHEN std > 62 AND luma > 45 AND luma < 210 THEN 'static' ELSE 'content' END AS kind, count(*) AS n FROM f GROUP BY kind")
def frame_classes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = asm.frame_class(F.col("value"), F.get_json_object("props", "$.k").cast("int"), F.col("user_id") % 200, F.col("event_id") % 90, F.col("event_id") % 256)
    return e.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT media, round(max(e), 4) AS e FROM (SELECT user_id % 40 * 100 + event_id % 37 AS media, event_type IN ('error', 'signup', 'click') AS out, value AS e FROM events) GROUP BY media HAVING bool_and(out)")
def source_level_exclusion(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40 * 100 + F.col("event_id") % 37).alias("media"), F.col("event_type").isin("error", "signup", "click").alias("out"), F.col("value").alias("e"))
    return asm.source_exclusions(e, "media", "out", "e").select("media", F.round("e", 4).alias("e"))


EXCLUDED = f"{SEG}, ex0 AS (SELECT media, s, e FROM seg WHERE label = 'error' OR (label = 'purchase' AND conf >= 0.18)), {MERGED}"


def _excluded(d):
    out = d.where("label = 'error' or (label = 'purchase' and conf >= 0.18)")
    return iv.merge_intervals(out.select("media", "s", "e"), "media").drop("n")


@query(f"WITH {EXCLUDED} SELECT media, round(s, 5) AS s, round(e, 5) AS e FROM ex")
def exclusion_ranges(spark, sf_dir):
    return _excluded(dense(spark, sf_dir)).select("media", F.round("s", 5).alias("s"), F.round("e", 5).alias("e"))


@query(f"WITH {EXCLUDED}, st AS (SELECT a.id // 2 AS item, a.k = 0 AS marked, a.label = 'signup' AND a.k > 80 AS family, EXISTS (SELECT 1 FROM ex x WHERE x.media = a.media AND a.s <= x.e AND a.e >= x.s AND {ENOUGH}) AS gone FROM seg a WHERE a.label <> 'error') SELECT item, CASE WHEN bool_or(marked) THEN false WHEN bool_or(family) THEN true ELSE NOT bool_and(gone) END AS visible FROM st GROUP BY item")
def visible_rows(spark, sf_dir):
    d = dense(spark, sf_dir)
    rows = d.where("label <> 'error'").withColumn("item", F.expr("id div 2"))
    return asm.visible(rows, _excluded(d), "media", "item", F.col("k") == 0, (F.col("label") == "signup") & (F.col("k") > 80))


@query(f"WITH {SEG} SELECT a.id AS range_id, count(DISTINCT b.id) AS n, min(b.id) AS first FROM seg a JOIN seg b ON a.media = b.media AND a.label = 'purchase' AND b.label <> 'purchase' AND b.s <= a.e + 45 AND b.e >= a.s - 45 GROUP BY a.id")
def segments_near_ranges(spark, sf_dir):
    d = dense(spark, sf_dir)
    near = asm.near_segments(d.where("label = 'purchase'"), d.where("label <> 'purchase'"), "media")
    return near.groupBy("range_id").agg(F.count("*").alias("n"), F.min("segment_id").alias("first"))


@query(f"WITH {SEG} SELECT a.id AS segment_id, arg_min(b.id, {{'s': b.s, 'id': b.id}}) AS event_id FROM seg a JOIN seg b ON a.media = b.media AND a.label = 'click' AND b.label = 'view' AND a.s BETWEEN b.s - 1 AND b.e + 1 GROUP BY a.id")
def event_for_segment(spark, sf_dir):
    d = dense(spark, sf_dir)
    return asm.first_event(d.where("label = 'click'"), d.where("label = 'view'"), "media")


@query(f"WITH {SEG} SELECT b.id AS event_id, a.k % 4 AS speaker, round(sum({PART}), 5) AS seconds FROM seg a JOIN seg b ON a.media = b.media AND a.label IN ('click', 'error') AND b.label = 'view' AND a.s < b.e AND a.e > b.s GROUP BY b.id, a.k % 4")
def event_speaker_seconds(spark, sf_dir):
    d = dense(spark, sf_dir).withColumn("speaker", F.col("k") % 4)
    out = asm.speaker_seconds(d.where("label in ('click', 'error')"), d.where("label = 'view'"), "media", "speaker")
    return out.select("event_id", "speaker", F.round("seconds", 5).alias("seconds"))


@query(f"WITH {SEG} SELECT a.id AS a, b.id AS b FROM seg a JOIN seg b ON a.media = b.media AND a.id < b.id AND a.s <= b.e AND a.e >= b.s")
def co_occurring_tracks(spark, sf_dir):
    d = dense(spark, sf_dir)
    return iv.interval_join(d, d, "media", 600.0).where("l.id < r.id").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


@query(f"WITH {SEG}, j AS (SELECT a.id, b.label, b.conf, b.id AS bid, abs(a.s - b.s) AS d, b.s >= a.s AS later FROM (SELECT * FROM seg WHERE label = 'view') a JOIN (SELECT * FROM seg WHERE label IN ('signup', 'purchase')) b ON a.media = b.media) SELECT id, label AS near_label, round(greatest(0.2, conf - least(0.25, d / 180)), 6) AS near_confidence, round(d, 5) AS distance FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, later DESC, bid) = 1")
def nearest_anchor_label(spark, sf_dir):
    d = dense(spark, sf_dir)
    rows = d.where("label = 'view'").select("id", "media", "s")
    out = asm.nearest_label(rows, d.where("label in ('signup', 'purchase')"), "media", "s", "label", "conf")
    return out.select("id", "near_label", F.round("near_confidence", 6).alias("near_confidence"), F.round("distance", 5).alias("distance"))


@query(f"WITH {SEG}, t AS (SELECT *, [k % 10, k % 7 + 10, k % 5 + 20, k % 3 + 30] AS w FROM seg), a AS (SELECT * FROM t WHERE label = 'view'), b AS (SELECT * FROM t WHERE label = 'click'), o AS (SELECT a.id, bool_or({PART} > 0.3 * greatest(1.0, least(a.e - a.s, b.e - b.s)) AND len(list_intersect(a.w, b.w)) >= 2) AS agrees, bool_or({PART} > 0) AS covered FROM a JOIN b ON a.media = b.media AND a.s <= b.e AND a.e >= b.s GROUP BY a.id), w AS (SELECT DISTINCT a.id FROM a JOIN b ON a.media = b.media AND len(list_intersect(a.w, b.w)) >= 3) SELECT a.id, CASE WHEN agrees THEN 'corroborated' WHEN covered THEN 'content_disputed' WHEN w.id IS NOT NULL THEN 'range_disputed' ELSE 'uncovered' END AS verdict FROM a LEFT JOIN o ON a.id = o.id LEFT JOIN w ON a.id = w.id")
def second_opinion(spark, sf_dir):
    d = dense(spark, sf_dir).withColumn("w", F.array(F.col("k") % 10, F.col("k") % 7 + 10, F.col("k") % 5 + 20, F.col("k") % 3 + 30))
    return asm.second_opinion(d.where("label = 'view'"), d.where("label = 'click'"), "media", "w")


@query(f"WITH {SEG}, b AS (SELECT id, media, s + k % 20 AS s, e + k % 20 AS e FROM seg WHERE id % 10 <> 0), j AS (SELECT a.id, b.id AS new_id, round({PART} / greatest(0.001, least(a.e - a.s, b.e - b.s)), 9) AS share FROM seg a JOIN b ON a.media = b.media AND a.s <= b.e AND a.e >= b.s) SELECT id, new_id, share FROM j WHERE share >= 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY share DESC, new_id) = 1")
def remapped_corrections(spark, sf_dir):
    d = dense(spark, sf_dir)
    new = d.where("id % 10 <> 0").withColumn("s", F.col("s") + F.col("k") % 20).withColumn("e", F.col("e") + F.col("k") % 20)
    return asm.best_remap(d, new, "media")


@query(f"WITH {SEG}, p AS (SELECT a.id AS a, b.id AS b, (CASE WHEN abs(a.k - b.k) <= 10 THEN 3.0 WHEN abs(a.k - b.k) <= 30 THEN 1.5 ELSE 0.0 END) + (CASE WHEN a.label = b.label THEN 1.0 ELSE -2.0 END) + (CASE WHEN a.k % 5 = b.k % 5 THEN 2.0 ELSE 0.0 END) + (CASE WHEN a.k % 6 = b.k % 6 THEN 2.0 WHEN a.k % 6 <> 0 AND b.k % 6 <> 0 THEN -1.0 ELSE 0.0 END) + (CASE WHEN 1.0 / (1 + abs(a.k % 4 - b.k % 4)) >= 0.25 THEN 1.0 ELSE 0.0 END) + (CASE WHEN a.s <= b.e AND a.e >= b.s THEN 0.75 WHEN greatest(a.s - b.e, b.s - a.e) <= 30 THEN 0.5 ELSE 0.0 END) + (CASE WHEN a.id % 2 <> b.id % 2 THEN 0.5 ELSE 0.0 END) + (CASE WHEN a.k > 90 THEN 0.75 ELSE 0.0 END) AS score FROM seg a JOIN seg b ON a.media = b.media AND a.id < b.id AND a.s <= b.e + 60 AND a.e >= b.s - 60) SELECT a, b, score FROM p")
def event_pair_scores(spark, sf_dir):
    d = dense(spark, sf_dir)
    j = iv.interval_join(d, d, "media", 600.0, slack=60.0).where("l.id < r.id")
    lk, rk = F.col("l.k"), F.col("r.k")
    far = F.abs(lk - rk)
    score = asm.pair_score(F.when(far <= 10, 0.6).when(far <= 30, 0.4).otherwise(0.0), F.col("l.label") == F.col("r.label"), lk % 5 == rk % 5, lk % 6 == rk % 6, (lk % 6 != 0) & (rk % 6 != 0), 1.0 / (1 + F.abs(lk % 4 - rk % 4)), (F.col("l.s") <= F.col("r.e")) & (F.col("l.e") >= F.col("r.s")), F.greatest(F.col("l.s") - F.col("r.e"), F.col("r.s") - F.col("l.e")), F.col("l.id") % 2 != F.col("r.id") % 2, lk > 90)
    return j.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), score.alias("score"))


@query(f"WITH {SEG} SELECT media * 10 + k % 10 AS cluster, round(min(s), 5) AS s, round(max(e), 5) AS e, count(DISTINCT media) AS n_media, string_agg(CAST(id AS VARCHAR), ',' ORDER BY s, id) AS members, round(avg(conf), 9) AS confidence FROM seg GROUP BY media * 10 + k % 10")
def cluster_to_event(spark, sf_dir):
    d = dense(spark, sf_dir).withColumn("cluster", F.col("media") * 10 + F.col("k") % 10)
    c = asm.cluster_events(d, "cluster")
    return c.select("cluster", F.round("s", 5).alias("s"), F.round("e", 5).alias("e"), "n_media", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), F.round("confidence", 9).alias("confidence"))


@query("WITH a AS (SELECT event_id, event_id % 13 <> 0 AS has, least(value / 200, 1.0) AS nearby, CAST(json_extract(props, '$.k') AS INTEGER) / 100.0 AS elsewhere, (user_id % 10) / 10.0 AS entity, (event_id % 4) / 4.0 AS evidence FROM events) SELECT CASE WHEN NOT has THEN 'missing_range' WHEN elsewhere >= greatest(0.45, nearby + 0.2) THEN 'possible_misaligned' WHEN 0.55 * nearby + 0.25 * entity + 0.2 * evidence >= 0.45 THEN 'aligned' WHEN 0.55 * nearby + 0.25 * entity + 0.2 * evidence >= 0.2 THEN 'weakly_aligned' WHEN evidence > 0 THEN 'model_only' ELSE 'unsupported' END AS status, count(*) AS n FROM a GROUP BY status")
def alignment_status(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = asm.alignment_status(F.col("event_id") % 13 != 0, F.least(F.col("value") / 200, F.lit(1.0)), F.get_json_object("props", "$.k").cast("int") / 100.0, (F.col("user_id") % 10) / 10.0, (F.col("event_id") % 4) / 4.0)
    return e.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {SEG}, p AS (SELECT id, greatest(0.0, s - 5) AS a, least(13000.0, e + 5) AS b FROM seg) SELECT id, round(CASE WHEN b - a > 120 THEN (a + b) / 2 - 60 ELSE a END, 5) AS s, round(CASE WHEN b - a > 120 THEN (a + b) / 2 + 60 ELSE b END, 5) AS e FROM p")
def clip_plan(spark, sf_dir):
    d = dense(spark, sf_dir).select("id", asm.clip(F.col("s"), F.col("e"), F.lit(13000.0)).alias("c"))
    return d.select("id", F.round("c.s", 5).alias("s"), F.round("c.e", 5).alias("e"))


@query(f"WITH {SEG}, x AS (SELECT *, CAST(floor(s / 1200) AS INTEGER) % 4 AS chunk, s - 1200 * floor(s / 1200) AS sp, e - 1200 * floor(e / 1200) AS ep FROM seg) SELECT id FROM x WHERE least(least(sp, 1200 - sp), least(ep, 1200 - ep)) <= 30 OR chunk >= 2")
def chunk_boundary_events(spark, sf_dir):
    d = dense(spark, sf_dir)
    return d.where(asm.near_seam(F.col("s"), F.col("e"), F.floor(F.col("s") / 1200).cast("int") % 4, 1200.0)).select("id")


WORDS = "regexp_extract_all(lower(text), '[a-z]+')"


@query(f"WITH c AS (SELECT conv_id, turn, list_distinct({WORDS}) AS w FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS claim, b.w AS shown FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT conv_id, turn, CASE WHEN len(claim) > 0 AND len(list_intersect(claim, shown)) / len(claim) >= 0.3 THEN 'supported' WHEN len(list_intersect(claim, shown)) = 0 AND len(shown) >= 6 THEN 'contradicted' ELSE 'unclear' END AS verdict FROM p")
def keyword_adjudication(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w"))
    p = c.alias("a").join(c.withColumn("turn", F.col("turn") - 1).alias("b"), ["conv_id", "turn"])
    return p.select("conv_id", "turn", asm.keyword_verdict(F.col("a.w"), F.col("b.w")).alias("verdict"))


@query("WITH m AS (SELECT event_id, user_id, CASE event_id % 3 WHEN 0 THEN upper(event_type) ELSE event_type END || ' & ' || user_id % 15 AS label, value FROM events), k AS (SELECT *, trim(regexp_replace(replace(lower(label), '&', ' and '), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key FROM m), f AS (SELECT key, arg_min(label, event_id) AS spelling, min(event_id) AS seen FROM k GROUP BY key, lower(label)), al AS (SELECT key, string_agg(spelling, ',' ORDER BY seen) AS aliases FROM f GROUP BY key) SELECT k.key, arg_min(label, event_id) AS label, any_value(aliases) AS aliases, count(DISTINCT user_id) AS n_events, count(*) AS mentions, round(avg(least(value / 500, 1.0)), 9) AS confidence FROM k JOIN al ON k.key = al.key GROUP BY k.key")
def entity_groups(spark, sf_dir):
    d = dense(spark, sf_dir)
    label = F.concat(F.when(F.col("id") % 3 == 0, F.upper("label")).otherwise(F.col("label")), F.lit(" & "), (F.col("media") % 15).cast("string"))
    g = idn.groups(d.withColumn("label", label), "label", "media", "id")
    return g.select("key", "label", "aliases", "n_events", "mentions", F.round("confidence", 9).alias("confidence"))


@query("WITH d AS (SELECT DISTINCT p_name AS a, split_part(p_name, ' ', 2) AS blk FROM part), n AS (SELECT x.a, y.a AS b, trim(regexp_replace(lower(x.a), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS kx, trim(regexp_replace(lower(y.a), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS ky FROM d x JOIN d y ON x.blk = y.blk AND x.a < y.a), k AS (SELECT a, b, kx, ky, regexp_replace(regexp_replace(regexp_replace(regexp_replace(kx, 'ph', 'f', 'g'), '(bb|cc|dd|ff|gg|hh|jj|kk|ll|mm|nn|pp|qq|rr|ss|tt|vv|ww|xx|yy|zz)', '#', 'g'), 'ia', 'ya', 'g'), 'ie', 'y', 'g') AS sx, regexp_replace(regexp_replace(regexp_replace(regexp_replace(ky, 'ph', 'f', 'g'), '(bb|cc|dd|ff|gg|hh|jj|kk|ll|mm|nn|pp|qq|rr|ss|tt|vv|ww|xx|yy|zz)', '#', 'g'), 'ia', 'ya', 'g'), 'ie', 'y', 'g') AS sy, regexp_replace(kx, '(ochka|enka|ushka|ette|ina|ie|y|a)$', '') AS tx, regexp_replace(ky, '(ochka|enka|ushka|ette|ina|ie|y|a)$', '') AS ty, 1 - levenshtein(kx, ky) / greatest(length(kx), length(ky)) AS sim FROM n) SELECT a, b, round(CASE WHEN kx = ky THEN 1.0 WHEN sx = sy THEN 0.92 WHEN tx = ty AND length(tx) >= 3 THEN 0.85 WHEN sim >= 0.8 THEN 0.6 + (sim - 0.8) ELSE 0.0 END, 9) AS score FROM k")
def name_pair_score(spark, sf_dir):
    d = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct().withColumn("blk", F.split("a", " ")[1])
    j = d.alias("x").join(d.alias("y"), F.expr("x.blk = y.blk and x.a < y.a"))
    return j.select(F.col("x.a").alias("a"), F.col("y.a").alias("b"), F.round(idn.name_score(F.col("x.a"), F.col("y.a")), 9).alias("score"))


PEOPLE = "p AS (SELECT DISTINCT user_id % 60 AS x, CAST(json_extract(props, '$.k') AS INTEGER) + 100 * (event_id % 20) AS v FROM events)"


def _people(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("x"), (F.get_json_object("props", "$.k").cast("int") + 100 * (F.col("event_id") % 20)).alias("v")).distinct()


@query(f"WITH {PEOPLE} SELECT l.x AS a, r.x AS b, count(*) AS frames FROM p l JOIN p r ON l.v = r.v AND l.x < r.x GROUP BY l.x, r.x HAVING count(*) >= 2")
def co_presence_block(spark, sf_dir):
    return idn.co_presence(_people(spark, sf_dir), "x", "v")


LINK = "l AS (SELECT user_id % 60 AS x, event_id % 97 AS c, max(least(value / 200, 1.0)) AS w FROM events GROUP BY user_id % 60, event_id % 97)"


@query(f"WITH {LINK} SELECT a.x AS a, b.x AS b, round(0.5 + 0.5 * max(least(a.w, b.w)), 9) AS score FROM l a JOIN l b ON a.c = b.c AND a.x < b.x GROUP BY a.x, b.x")
def shared_cluster_score(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("x"), (F.col("event_id") % 97).alias("c"), F.least(F.col("value") / 200, F.lit(1.0)).alias("w"))
    return idn.shared_clusters(e, "x", "c", "w").withColumn("score", F.round("score", 9))


@query(f"WITH {PEOPLE}, {LINK}, s AS (SELECT x, count(*) AS n FROM p GROUP BY x), co AS (SELECT q.a, q.b, least(0.85, 0.5 + nb / (sa.n + sb.n - nb)) AS c FROM (SELECT l.x AS a, r.x AS b, count(*) AS nb FROM p l JOIN p r ON l.v = r.v AND l.x < r.x GROUP BY l.x, r.x) q JOIN s sa ON sa.x = q.a JOIN s sb ON sb.x = q.b), sh AS (SELECT a.x AS a, b.x AS b, 0.5 + 0.5 * max(least(a.w, b.w)) AS s FROM l a JOIN l b ON a.c = b.c AND a.x < b.x GROUP BY a.x, b.x), f AS (SELECT coalesce(co.a, sh.a) AS a, coalesce(co.b, sh.b) AS b, CASE WHEN c IS NOT NULL THEN least(greatest(c, 0.02), 0.98) END AS c, CASE WHEN s IS NOT NULL THEN least(greatest(s, 0.02), 0.98) END AS s FROM co FULL JOIN sh ON co.a = sh.a AND co.b = sh.b), z AS (SELECT a, b, 1 / (1 + exp(-(ln(0.08 / 0.92) + coalesce(0.6 * ln(c / (1 - c)), 0) + coalesce(0.9 * ln(s / (1 - s)), 0)))) AS p, (c IS NOT NULL)::INT + (s IS NOT NULL)::INT AS m FROM f) SELECT a, b, round(CASE WHEN (a + b) % 9 = 0 THEN least(CASE WHEN m < 2 THEN least(p, 0.65) ELSE p END, 0.2) WHEN m < 2 THEN least(p, 0.65) ELSE p END, 9) AS p FROM z ORDER BY p DESC, a, b LIMIT 60")
def person_merge_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 60).alias("x"), (F.col("event_id") % 97).alias("c"), F.least(F.col("value") / 200, F.lit(1.0)).alias("w"))
    shared, together = idn.shared_clusters(e, "x", "c", "w"), idn.co_occurrence(_people(spark, sf_dir), "x", "v")
    blocked = shared.select("a", "b").union(together.select("a", "b")).distinct().where("(a + b) % 9 = 0")
    return idn.merge_candidates({"together": (together, 0.6), "shared": (shared, 0.9)}, blocked)


@query("WITH g AS (SELECT user_id % 50 AS speaker, event_type AS person, max(least(value / 400, 0.7)) AS top, sum(least(value / 400, 0.7)) AS total, count(DISTINCT event_id % 11) AS n_events FROM events WHERE event_id % 5 = 0 GROUP BY user_id % 50, event_type), c AS (SELECT *, least(1.0, top + least(0.18, 0.12 * total) + least(0.09, 0.03 * (n_events - 1))) AS confidence FROM g) SELECT speaker, person, round(confidence, 9) AS confidence FROM c WHERE confidence >= 0.28 QUALIFY row_number() OVER (PARTITION BY speaker ORDER BY round(confidence, 9) DESC, person) <= 5")
def speaker_identity_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id % 5 = 0").select((F.col("user_id") % 50).alias("speaker"), F.col("event_type").alias("person"), F.least(F.col("value") / 400, F.lit(0.7)).alias("signal"), (F.col("event_id") % 11).alias("event"))
    c = idn.candidate_confidence(e, ["speaker", "person"], "signal", "event").where("confidence >= 0.28").select("speaker", "person", F.round("confidence", 9).alias("confidence"))
    w = Window.partitionBy("speaker").orderBy(F.desc("confidence"), "person")
    return c.withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r")


@query("WITH r AS (SELECT n_name || ', ' || r_name AS t, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_name, NULL, NULL FROM nation UNION ALL SELECT 'Town, ' || n_name || ', ' || r_name, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), p AS (SELECT t, string_split(t, ', ') AS a FROM r) SELECT t, CASE WHEN lower(a[-1]) IN ('asia', 'europe') THEN a[-2] WHEN len(a) >= 2 THEN a[1] END AS city, CASE WHEN lower(a[-1]) IN ('asia', 'europe') THEN a[-1] WHEN len(a) >= 3 THEN a[-2] END AS state, CASE lower(a[-1]) WHEN 'asia' THEN 'East' WHEN 'europe' THEN 'West' ELSE a[-1] END AS country FROM p")
def region_parse(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    t = n.select(F.concat_ws(", ", "n_name", "r_name").alias("t")).union(n.select("n_name")).union(n.select(F.concat_ws(", ", F.lit("Town"), "n_name", "r_name")))
    return t.select("t", idn.parse_region(F.col("t"), {"asia": "East", "europe": "West"}).alias("r")).select("t", "r.*")


YEARS = "y AS (SELECT o_custkey % 200 AS media, year(o_orderdate) AS y, o_orderpriority = '1-URGENT' AS sure FROM orders)"


def _years(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("media"), F.year("o_orderdate").cast("long").alias("y"), (F.col("o_orderpriority") == "1-URGENT").alias("sure"))


@query(f"WITH {YEARS}, n AS (SELECT media, y, count(*) AS n FROM y GROUP BY media, y), v AS (SELECT media, y, sum(n) OVER (PARTITION BY media ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS votes FROM n) SELECT media, y AS year, votes::BIGINT AS votes FROM v QUALIFY row_number() OVER (PARTITION BY media ORDER BY votes DESC, y) = 1")
def majority_years(spark, sf_dir):
    return idn.majority_years(_years(spark, sf_dir), "media", "y", reach=1)


@query(f"WITH {YEARS}, c AS (SELECT media, min(y) AS lo, max(y) AS hi FROM y WHERE sure AND y % 2 = 0 GROUP BY media) SELECT y.media, min(y) - 1 AS start_year, max(y) + 1 AS end_year, CASE WHEN bool_or(sure AND y % 2 = 0) THEN 'trusted' ELSE 'envelope' END AS basis, count(*) AS n FROM y LEFT JOIN c ON y.media = c.media WHERE lo IS NULL OR y BETWEEN lo - 1 AND hi + 1 GROUP BY y.media")
def capture_windows(spark, sf_dir):
    d = _years(spark, sf_dir).withColumn("sure", F.col("sure") & (F.col("y") % 2 == 0))
    return idn.capture_windows(d, "media", "y", "sure", reach=1)


@query("WITH a AS (SELECT trim(regexp_replace(lower(p_brand), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key, CASE p_size % 3 WHEN 0 THEN 'human' WHEN 1 THEN 'vote' ELSE 'geocode' END AS source, p_retailprice AS confidence FROM part) SELECT key, CASE source WHEN 'human' THEN 3 WHEN 'vote' THEN 2 ELSE 1 END AS rank, confidence, source FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY CASE source WHEN 'human' THEN 3 WHEN 'vote' THEN 2 ELSE 1 END DESC, confidence DESC, source DESC) = 1")
def best_anchor(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    p = p.select("p_brand", F.when(F.col("p_size") % 3 == 0, "human").when(F.col("p_size") % 3 == 1, "vote").otherwise("geocode").alias("source"), F.col("p_retailprice").alias("confidence"))
    return idn.best_anchor(p, "p_brand", "source", "confidence", {"human": 3, "vote": 2, "geocode": 1})


CLAIMS = "c AS (SELECT event_id AS seq, user_id * 100 + event_id % 17 AS claim, event_type AS kind, CASE WHEN event_id % 6 = 0 THEN user_id * 100 + (event_id + 5) % 17 END AS gone FROM events), l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY claim ORDER BY seq DESC) = 1), g AS (SELECT gone AS claim, max(seq) AS gone_at FROM c WHERE gone IS NOT NULL GROUP BY gone), live AS (SELECT l.* FROM l LEFT JOIN g ON l.claim = g.claim WHERE gone_at IS NULL OR gone_at < seq)"


def _claims(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), (F.col("user_id") * 100 + F.col("event_id") % 17).alias("claim"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 6 == 0, F.col("user_id") * 100 + (F.col("event_id") + 5) % 17).alias("gone"))


@query(f"WITH {CLAIMS} SELECT claim, seq, kind FROM live")
def live_claims(spark, sf_dir):
    return cor.live_claims(_claims(spark, sf_dir), "claim", "seq", "gone").select("claim", "seq", "kind")


@query(f"WITH {CLAIMS} SELECT c.kind, count(*) AS rows, (SELECT count(*) FROM live WHERE live.kind = c.kind) AS live FROM c GROUP BY c.kind")
def claim_store_stats(spark, sf_dir):
    log = _claims(spark, sf_dir)
    return cor.store_stats(log, cor.live_claims(log, "claim", "seq", "gone"), "kind")


PRINT = "sha1(p_name || '|' || p_brand || '|' || CAST(p_size AS VARCHAR))"


@query(f"WITH r AS (SELECT p_partkey AS id, {PRINT} AS fp FROM part WHERE p_partkey % 9 <> 0), k AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN p_partkey + 1 ELSE p_partkey END AS target, {PRINT} AS fp FROM part), u AS (SELECT fp, count(*) AS m, min(id) AS lone FROM r GROUP BY fp) SELECT k.id, CASE WHEN r.fp = k.fp THEN k.target WHEN m = 1 THEN lone END AS target, CASE WHEN r.fp = k.fp THEN 'same' WHEN m = 1 THEN 'moved' WHEN m > 1 THEN 'ambiguous' ELSE 'missing' END AS reason FROM k LEFT JOIN r ON r.id = k.target LEFT JOIN u ON u.fp = k.fp")
def resolved_fingerprints(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), cor.fingerprint(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("fp"))
    k = p.withColumn("target", F.when(F.col("id") % 4 == 0, F.col("id") + 1).otherwise(F.col("id")))
    return cor.resolve_targets(k, p.where("id % 9 <> 0"), "fp")


@query("SELECT event_id FROM events e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'signup' AND d.user_id = e.user_id AND CAST(json_extract(d.props, '$.k') AS INTEGER) % 6 = CAST(json_extract(e.props, '$.k') AS INTEGER) % 6)")
def undecided_suggestions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", (F.get_json_object("props", "$.k").cast("int") % 6).alias("field"))
    return cor.undecided(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"), ["user_id", "field"]).select("event_id")


@query("WITH s AS (SELECT event_id AS id, user_id % 30 AS target, event_type || CASE WHEN event_id % 2 = 0 THEN '_relationship' ELSE '' END AS action, CASE WHEN event_id % 19 <> 0 THEN value / 200 END AS c, event_id % 8 = 0 AS against, event_id % 3 AS evidence FROM events), r AS (SELECT id, target, c, CASE WHEN c IS NULL THEN 'no confidence' WHEN c < 0.5 THEN 'below floor' WHEN against THEN 'contradicted' WHEN contains(action, 'relationship') AND evidence < 2 THEN 'one witness' END AS reason FROM s) SELECT id, CASE WHEN reason IS NOT NULL THEN reason WHEN row_number() OVER (PARTITION BY target, reason IS NULL ORDER BY c DESC, id) = 1 THEN 'selected' ELSE 'duplicate target' END AS outcome FROM r")
def applied_suggestions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    s = e.select(F.col("event_id").alias("id"), (F.col("user_id") % 30).alias("target"), F.concat("event_type", F.when(F.col("event_id") % 2 == 0, "_relationship").otherwise("")).alias("action"), F.when(F.col("event_id") % 19 != 0, F.col("value") / 200).alias("c"), (F.col("event_id") % 8 == 0).alias("against"), (F.col("event_id") % 3).alias("evidence"))
    s = s.withColumn("reason", cor.block_reason(F.col("action"), F.col("c"), F.lit(0.5), F.col("against"), F.col("evidence")))
    return cor.select_suggestions(s, "target", "reason", "c").select("id", "outcome")


@query("SELECT event_type, count(*) FILTER (event_id % 10 = 0 OR (event_type IN ('view', 'click') AND event_id % 4 = 0)) AS superseded FROM events GROUP BY event_type")
def quarantined_corrections(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 10 == 0).alias("superseded"), F.when(F.col("event_id") % 4 != 0, F.md5(F.col("event_id").cast("string"))).alias("fp"))
    return cor.quarantine(e, F.col("event_type").isin("view", "click"), "fp").groupBy("event_type").agg(F.count_if("superseded").alias("superseded"))


@query("WITH c AS (SELECT user_id AS media, value, sum(w) OVER (PARTITION BY user_id ORDER BY value, w ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY user_id) AS total FROM (SELECT *, 1 + event_id % 3 AS w FROM events)), m AS (SELECT media, min(value) AS median FROM c WHERE cum >= total / 2 GROUP BY media), a AS (SELECT user_id AS media, abs(value - median) AS away, 1 + event_id % 3 AS w, median FROM events JOIN m ON user_id = m.media), d AS (SELECT *, sum(w) OVER (PARTITION BY media ORDER BY away, w ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY media) AS total FROM a) SELECT media, any_value(median) AS median, round(min(away), 9) AS mad FROM d WHERE cum >= total / 2 GROUP BY media")
def median_deviation(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("media"), "value", (1 + F.col("event_id") % 3).alias("w"))
    return agg.median_deviation(e, "media", "value", "w").select("media", "median", F.round("mad", 9).alias("mad"))


@query("SELECT p_name, trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key, count(*) AS n FROM part GROUP BY p_name")
def entity_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n")).select("p_name", sem.normalize_key(F.col("p_name")).alias("key"), "n")


@query("WITH d AS (SELECT doc_id, text, position('license' IN lower(text)) AS hit FROM documents WHERE contains(lower(text), 'license')), s AS (SELECT *, greatest(hit - 70, 1) AS a FROM d) SELECT doc_id, CASE WHEN a > 1 THEN '...' ELSE '' END || substring(text, a, 220) || CASE WHEN a + 219 < length(text) THEN '...' ELSE '' END AS snippet FROM s")
def search_snippets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("license")))
    return d.select("doc_id", sem.snippet(F.col("text"), F.lit("license")).alias("snippet"))


@query("WITH t AS (SELECT event_id, CAST(value AS INTEGER) AS v FROM events), c AS (SELECT event_id, lpad(CAST(v // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(v % 60 AS VARCHAR), 2, '0') || ',25' AS clock, v FROM t) SELECT event_id, clock, v + 0.25 AS seconds FROM c")
def timestamp_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.rint("value").cast("int").alias("v"))
    clock = F.concat(F.lpad(F.floor(F.col("v") / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("v") % 60).cast("string"), 2, "0"), F.lit(",25"))
    return e.select("event_id", clock.alias("clock"), sem.parse_clock(clock).alias("seconds"))


@query("WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, 'on %Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%B %-d, %Y') WHEN 2 THEN strftime(o_orderdate, 'in %Y') ELSE 'the ' || (o_orderkey % 10) * 10 || 's' END AS t, o_orderdate AS d FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN 'day' WHEN o_orderkey % 4 = 2 THEN 'year' ELSE 'decade' END AS precision, CASE WHEN o_orderkey % 4 < 3 THEN year(d) WHEN (o_orderkey % 10) * 10 >= 30 THEN 1900 + (o_orderkey % 10) * 10 ELSE 2000 + (o_orderkey % 10) * 10 END AS year, CASE WHEN o_orderkey % 4 < 2 THEN strftime(d, '%Y-%m-%d') END AS iso FROM d WHERE o_orderkey % 4 < 3 OR o_orderkey % 10 > 0")
def date_parse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate").cast("timestamp")
    text = F.when(k == 0, F.date_format(d, "'on' yyyy-MM-dd")).when(k == 1, F.date_format(d, "MMMM d, yyyy")).when(k == 2, F.date_format(d, "'in' yyyy")).otherwise(F.concat(F.lit("the "), (F.col("o_orderkey") % 10 * 10).cast("string"), F.lit("s")))
    o = o.where("o_orderkey % 4 < 3 or o_orderkey % 10 > 0")
    return o.select("o_orderkey", sem.parse_date(text).alias("p")).select("o_orderkey", "p.*")


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type = 'error' AND CAST(json_extract(props, '$.k') AS INTEGER) % 2 = 1")
def eval_followup_queue(spark, sf_dir):
    """An odd k stands for needs_family_followup."""
    return table(spark, sf_dir, "events").where((F.col("event_type") == "error") & (F.get_json_object("props", "$.k").cast("int") % 2 == 1)).select("event_id", "event_type", "user_id")


@query("SELECT event_type AS task_type, count(*) AS n, round(avg(value / 500), 9) AS confidence, count(*) FILTER (value / 500 < 0.05) AS doubtful FROM events GROUP BY event_type")
def eval_prompting_lab(spark, sf_dir):
    c = F.col("value") / 500
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task_type")).agg(F.count("*").alias("n"), F.round(F.avg(c), 9).alias("confidence"), F.count_if(c < 0.05).alias("doubtful"))

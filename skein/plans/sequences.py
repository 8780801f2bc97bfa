"""Queries of ordered rules over the driver tables: scenes, turns, loops, continuity, chunk clocks, eras."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import sequences as seq
from .archive import table
from .assembly import SEG, dense

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

THREE = f"{SEG}, three AS (SELECT * REPLACE (media % 3 AS media, conf * 5 / 7 AS conf) FROM seg)"
LENGTH = 14000.0


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def merged_sql(labels: str) -> str:
    return f"m0 AS (SELECT media, s, e, CASE WHEN s - max(e) OVER (PARTITION BY media ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS new FROM seg WHERE label IN ({labels})), m1 AS (SELECT *, sum(new) OVER (PARTITION BY media ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m0), ex AS (SELECT media, min(s) AS s, max(e) AS e, CASE WHEN count(*) > 1 THEN 'static' ELSE 'blank' END AS label FROM m1 GROUP BY media, i)"


def merged(d: DataFrame, *labels: str) -> DataFrame:
    m = iv.merge_intervals(d.where(F.col("label").isin(*labels)).select("media", "s", "e"), "media")
    return m.select("media", "s", "e", F.when(F.col("n") > 1, "static").otherwise("blank").alias("label"))


def three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir).withColumn("media", F.col("media") % 3).withColumn("conf", F.col("conf") * 5 / 7)


def ends(d: DataFrame) -> DataFrame:
    return d.select("media").distinct().withColumn("duration", F.lit(LENGTH))


@query(f"WITH {SEG}, {merged_sql("'error'")}, ed AS (SELECT media, s AS t FROM seg WHERE label = 'view' AND s > 0 AND s < {LENGTH} UNION SELECT media, s FROM ex UNION SELECT media, e FROM ex UNION SELECT media, CAST(0 AS DOUBLE) FROM seg UNION SELECT media, CAST({LENGTH} AS DOUBLE) FROM seg), pc AS (SELECT media, t AS s, lead(t) OVER (PARTITION BY media ORDER BY t) AS e FROM ed), pl AS (SELECT p.media, p.s, p.e, x.label FROM pc p LEFT JOIN ex x ON x.media = p.media AND x.s <= p.s AND x.e > p.s WHERE p.e > p.s), r0 AS (SELECT *, lag(label) OVER w AS prev, row_number() OVER w AS rn FROM pl WINDOW w AS (PARTITION BY media ORDER BY s)), r1 AS (SELECT *, label IS NULL AND (rn = 1 OR prev IS NOT NULL) AS head FROM r0), r2 AS (SELECT *, last_value(CASE WHEN head THEN s END IGNORE NULLS) OVER (PARTITION BY media ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM r1), r3 AS (SELECT *, sum(CASE WHEN label IS NULL THEN CASE WHEN head OR (e - s >= 40 AND s - run >= 40) THEN 1 ELSE 0 END WHEN prev IS NULL OR prev <> label THEN 1 ELSE 0 END) OVER (PARTITION BY media ORDER BY s ROWS UNBOUNDED PRECEDING) AS scene FROM r2) SELECT media, round(min(s), 5) AS s, round(max(e), 5) AS e, coalesce(min(label), 'content') AS label, count(*) AS pieces FROM r3 GROUP BY media, scene")
def scene_intervals(spark, sf_dir):
    d = dense(spark, sf_dir)
    out = seq.scenes(d.where("label = 'view'").select("media", F.col("s").alias("t")), merged(d, "error"), ends(d), "media", 40.0)
    return out.select("media", F.round("s", 5).alias("s"), F.round("e", 5).alias("e"), F.coalesce("label", F.lit("content")).alias("label"), "pieces")


@query(f"WITH {SEG}, p AS (SELECT part, part * 1170.0 AS s, part * 1170.0 + 1200 AS e FROM range(12) t(part)) SELECT a.id, p.part FROM seg a JOIN p ON a.s <= p.e AND a.e >= p.s WHERE (a.s + a.e) / 2 >= CASE WHEN p.part = 0 THEN p.s ELSE p.s + 15 END AND (p.part = 11 OR (a.s + a.e) / 2 < p.e - 15)")
def overlap_ownership(spark, sf_dir):
    d = dense(spark, sf_dir)
    parts = ends(d).select("media", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("part")).select("media", F.col("part").cast("long").alias("part"), (F.col("part") * 1170.0).alias("s"), (F.col("part") * 1170.0 + 1200).alias("e"))
    rows = iv.interval_join(d, parts, "media", 1200.0).select("l.id", "l.media", "r.part", "l.s", "l.e")
    return seq.owned_by_part(rows, parts, "media").select("id", "part")


@query(f"WITH {THREE} SELECT media, CAST(floor((s + e) / 2 / 10) AS BIGINT) AS bucket, id FROM three WHERE e > s QUALIFY row_number() OVER (PARTITION BY media, floor((s + e) / 2 / 10) ORDER BY e - s DESC, s, id) = 1")
def stride_sampling(spark, sf_dir):
    return seq.stride_sample(three(spark, sf_dir), "media")


@query(f"WITH {THREE}, a AS (SELECT media, id, s, e, conf, k % 2 AS speaker, CASE WHEN k % 2 = lag(k % 2) OVER (PARTITION BY media ORDER BY s, id) THEN 0 ELSE 1 END AS turned FROM three), b AS (SELECT *, sum(turned) OVER (PARTITION BY media ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS run FROM a), c AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY media, run ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1.5 THEN 0 ELSE 1 END AS opens FROM b), t AS (SELECT *, sum(opens) OVER (PARTITION BY media, run ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS turn FROM c) SELECT media, speaker, round(min(s), 5) AS s, round(max(e), 5) AS e, count(*) AS n, round(list_reduce(list(conf ORDER BY s, id), lambda x, y: (x + y) / 2), 9) AS confidence FROM t GROUP BY media, run, turn, speaker")
def speaker_turns(spark, sf_dir):
    t = seq.turns(three(spark, sf_dir).withColumn("speaker", F.col("k") % 2), "media", "speaker")
    return t.select("media", "speaker", F.round("s", 5).alias("s"), F.round("e", 5).alias("e"), "n", F.round("confidence", 9).alias("confidence"))


@query(f"WITH {THREE}, a AS (SELECT id, s - lag(s) OVER (PARTITION BY media, label, k % 5 ORDER BY s, id) AS since FROM three) SELECT id FROM a WHERE since IS NULL OR since >= 120")
def loop_free_lines(spark, sf_dir):
    word = F.when(F.col("id") % 2 == 0, F.initcap("label")).otherwise(F.col("label"))
    d = three(spark, sf_dir).withColumn("line", F.concat(word, F.lit(" -- "), (F.col("k") % 5).cast("string"), F.when(F.col("id") % 3 == 0, "!").otherwise("")))
    return seq.without_loops(d, "media", "line").select("id")


@query(f"WITH {THREE}, a AS (SELECT id, media, s, e, k % 3 AS stream, CASE WHEN k % 2 = 0 THEN label ELSE upper(label) END AS line, row_number() OVER (PARTITION BY media ORDER BY s, id) AS place FROM three), b AS (SELECT *, lag(place) OVER w AS p, lag(e) OVER w AS pe, lag(line) OVER w AS pl FROM a WINDOW w AS (PARTITION BY media, stream ORDER BY place)) SELECT id, CASE WHEN line = lower(line) AND place - p <= 6 AND s - pe >= -0.5 AND s - pe <= 3.0 THEN pl || ' ' || line ELSE line END AS whole FROM b")
def continued_lines(spark, sf_dir):
    line = F.when(F.col("k") % 2 == 0, F.col("label")).otherwise(F.upper("label"))
    d = three(spark, sf_dir).withColumn("stream", F.col("k") % 3).withColumn("line", line)
    return seq.continued_lines(d, "media", "stream", "line").select("id", "whole")


@query(f"WITH {SEG}, {merged_sql("'error'")}, a AS (SELECT id, media, s, e, CASE WHEN k % 5 < 2 THEN floor(s / 3000) END AS region, CASE WHEN k % 7 < 2 THEN floor(s / 4000) END AS year, CASE WHEN k % 3 = 0 THEN floor(s / 2500) % 2 END AS language FROM seg WHERE label <> 'error'), b AS (SELECT *, lag(e) OVER w AS pe, lag(region) OVER w AS pr, lag(year) OVER w AS py, lag(language) OVER w AS pl FROM a WINDOW w AS (PARTITION BY media ORDER BY s, id)), c AS (SELECT id, media, s, CASE WHEN EXISTS (SELECT 1 FROM ex x WHERE x.media = b.media AND x.e - x.s >= 20 AND x.s >= b.pe AND x.e <= b.s) THEN 'gap' WHEN region <> pr THEN 'region' WHEN abs(year - py) >= 1 THEN 'year' WHEN language <> pl THEN 'language' END AS reason FROM b) SELECT media, id, CAST(1 + count(reason) OVER (PARTITION BY media ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment, coalesce(reason, '-') AS reason FROM c")
def segment_contexts(spark, sf_dir):
    d, at = dense(spark, sf_dir), lambda size: F.floor(F.col("s") / size)
    k = F.col("k")
    events = d.where("label <> 'error'").select("media", "id", "s", "e", F.when(k % 5 < 2, at(3000)).alias("region"), F.when(k % 7 < 2, at(4000)).alias("year"), F.when(k % 3 == 0, at(2500) % 2).alias("language"))
    out = seq.continuity(events, merged(d, "error"), "media", 20.0)
    return out.select("media", "id", "segment", F.coalesce("reason", F.lit("-")).alias("reason"))


@query(f"WITH {SEG}, {merged_sql("'error'")}, r AS (SELECT event_id AS id, user_id AS media, CASE WHEN event_id % 7 <> 0 THEN value END AS s, CASE WHEN event_id % 11 <> 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) * 4.0 END AS e, CASE WHEN event_id % 3 <> 0 THEN 300.0 END AS loc, (event_id % 12) * 1000.0 AS off FROM events), a AS (SELECT id, media, loc, off, s IS NULL AND e IS NULL AS un, least(coalesce(s, e), coalesce(e, s)) AS lo, greatest(coalesce(s, e), coalesce(e, s)) AS hi FROM r), b AS (SELECT id, media, off, un, coalesce(hi > loc, false) AS c1, lo + off AS lo, CASE WHEN hi > loc THEN loc ELSE hi END + off AS hi FROM a), c AS (SELECT id, media, off, un, c1, coalesce(hi > 11200, false) AS c2, lo, CASE WHEN hi > 11200 THEN 11200 ELSE hi END AS hi FROM b WHERE un OR lo < 11200), d AS (SELECT c.*, EXISTS (SELECT 1 FROM ex x WHERE x.media = c.media AND x.s <= c.lo AND x.e > c.lo) AS gone, (SELECT min(x.s) FROM ex x WHERE x.media = c.media AND x.s > c.lo AND x.s < c.hi) AS wall FROM c) SELECT id, round(coalesce(lo, off), 5) AS s, round(coalesce(wall, hi, off), 5) AS e, concat_ws('+', CASE WHEN un THEN 'no_time' END, CASE WHEN c1 THEN 'chunk_end' END, CASE WHEN c2 THEN 'source_end' END, CASE WHEN wall IS NOT NULL THEN 'before_error' END) AS notes FROM d WHERE un OR (NOT gone AND coalesce(wall, hi) >= lo)")
def placed_intervals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("int") * 4.0
    rows = e.select(i.alias("id"), F.col("user_id").alias("media"), F.when(i % 7 != 0, F.col("value")).alias("s"), F.when(i % 11 != 0, k).alias("e"), ((i % 12) * 1000.0).alias("offset"), F.when(i % 3 != 0, 300.0).alias("local"), F.lit(11200.0).alias("duration"))
    walls = merged(dense(spark, sf_dir), "error").withColumn("label", F.lit("error"))
    return seq.placed_intervals(rows, walls, "media").select("id", F.round("s", 5).alias("s"), F.round("e", 5).alias("e"), "notes")


@query("WITH a AS (SELECT event_id // 5 AS chunk, event_type <> 'error' AS ev, CASE WHEN event_id // 5 % 3 = 0 THEN value / 60 ELSE value END AS v, 60.0 + (event_id // 5 % 5) * 50 AS loc FROM events), g AS (SELECT chunk, max(loc) AS loc, max(v) AS top, count(*) FILTER (ev) AS n, max(v) FILTER (ev) AS last FROM a GROUP BY chunk), h AS (SELECT *, coalesce(n >= 3 AND last < loc / 10, false) AS early, coalesce(n >= 3 AND last < loc / 10 AND top * 60 <= loc * 1.05, false) AS mins FROM g), i AS (SELECT *, top * CASE WHEN mins THEN 60.0 ELSE 1.0 END AS reach FROM h) SELECT chunk, round(CASE WHEN mins THEN 60.0 ELSE 1.0 END * CASE WHEN reach > loc * 1.05 THEN loc / reach ELSE 1.0 END, 9) AS scale, concat_ws('+', CASE WHEN mins THEN 'minutes' WHEN early THEN 'unreliable' END, CASE WHEN reach > loc * 1.05 THEN 'overrun' END) AS basis FROM i WHERE top > 0")
def chunk_timeline_scales(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("chunk", F.expr("event_id div 5"))
    v = F.when(F.col("chunk") % 3 == 0, F.col("value") / 60).otherwise(F.col("value"))
    items = e.select("chunk", "event_type", (F.col("value") * 0).alias("s"), v.alias("e"), (60.0 + F.col("chunk") % 5 * 50).alias("local"))
    return seq.chunk_scales(items, "chunk", F.col("event_type") != "error", "local").select("chunk", F.round("scale", 9).alias("scale"), "basis")


@query("WITH g AS (SELECT event_id // 4 AS run, sum(CAST(json_extract(props, '$.k') AS INTEGER)) * 15 AS duration, count(*) AS n, max(value) AS last FROM events WHERE event_type <> 'error' GROUP BY event_id // 4) SELECT run, n >= 3 AND duration >= 1800 AND last > 0 AND last < least(duration * 0.12, 600.0) AS suspect FROM g")
def timing_suspects(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    g = e.groupBy(F.expr("event_id div 4").alias("run")).agg((F.sum(F.get_json_object("props", "$.k").cast("int")) * 15).alias("duration"), F.count("*").alias("n"), F.max("value").alias("last"))
    return g.select("run", seq.timing_suspect(F.col("duration"), F.col("n"), F.col("last")).alias("suspect"))


@query(f"WITH {SEG}, {merged_sql("'error', 'purchase'")}, ed AS (SELECT media, s, e FROM ex UNION ALL SELECT DISTINCT media, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM seg UNION ALL SELECT DISTINCT media, {LENGTH}, {LENGTH} FROM seg), c AS (SELECT media, e AS s, lead(s) OVER (PARTITION BY media ORDER BY s, e) AS e FROM ed), p AS (SELECT media, s, e, CASE WHEN s - max(e) OVER (PARTITION BY media ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 15 THEN 0 ELSE 1 END AS new FROM c WHERE e > s), q AS (SELECT *, sum(new) OVER (PARTITION BY media ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM p), g AS (SELECT media, min(s) AS s, max(e) AS e FROM q GROUP BY media, i), h AS (SELECT *, max(e - s) OVER (PARTITION BY media) AS most, row_number() OVER (PARTITION BY media ORDER BY e - s DESC, s) AS rank FROM g) SELECT media, round(s, 5) AS s, round(e, 5) AS e FROM h WHERE e - s >= 600 OR (most < 600 AND rank = 1)")
def fallback_spans(spark, sf_dir):
    d = dense(spark, sf_dir)
    out = seq.content_spans(merged(d, "error", "purchase"), ends(d), "media", 15.0, 600.0)
    return out.select("media", F.round("s", 5).alias("s"), F.round("e", 5).alias("e"))


WEIGHTS = {"click": 2.0, "view": 1.0, "error": 0.5}
VOTES = "v AS (SELECT user_id % 3 AS person, event_type AS basis, 1950 + event_id % 70 AS year, 'P' || (CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) % 5 = 0 THEN event_id % 4 ELSE event_id % 70 // 9 % 4 END) AS place FROM events WHERE event_id % 70 % 8 <> 0), t AS (SELECT person, year, place, sum(CASE basis WHEN 'click' THEN 2.0 WHEN 'view' THEN 1.0 WHEN 'error' THEN 0.5 ELSE 1.0 END) AS weight FROM v GROUP BY ALL), y AS (SELECT person, year, arg_min(place, {'a': -weight, 'b': place}) AS place, CAST(count(*) > 1 AS INTEGER) AS split FROM t GROUP BY person, year)"


def _winners(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id % 70 % 8 <> 0")
    year = F.col("event_id") % 70
    place = F.when(F.get_json_object("props", "$.k").cast("int") % 5 == 0, F.col("event_id") % 4).otherwise(F.floor(year / 9) % 4)
    votes = e.select((F.col("user_id") % 3).alias("person"), (1950 + year).alias("year"), F.concat(F.lit("P"), place.cast("string")).alias("place"), F.col("event_type").alias("basis"))
    return seq.year_winners(votes, "person", WEIGHTS)


@query(f"WITH {VOTES} SELECT * FROM y")
def residence_vote_argmax(spark, sf_dir):
    return _winners(spark, sf_dir)


@query(f"WITH {VOTES}, a AS (SELECT *, CASE WHEN place = lag(place) OVER w AND year - lag(year) OVER w <= 2 THEN 0 ELSE 1 END AS new FROM y WINDOW w AS (PARTITION BY person ORDER BY year)), b AS (SELECT *, sum(new) OVER (PARTITION BY person ORDER BY year ROWS UNBOUNDED PRECEDING) AS i FROM a), g AS (SELECT person, i, min(place) AS place, min(year) AS first_year, max(year) AS l, CAST(sum(split) AS BIGINT) AS conflicts FROM b GROUP BY person, i), h AS (SELECT *, i = max(i) OVER (PARTITION BY person) AND l < 2030 AS extended FROM g) SELECT person, place, first_year, CASE WHEN extended THEN 2030 ELSE l END AS last_year, conflicts, extended FROM h")
def residence_eras(spark, sf_dir):
    return seq.eras(_winners(spark, sf_dir), "person", 2030)

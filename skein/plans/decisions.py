"""Queries of decision rules over the driver tables: content, dates, ages, places, reviews, costs, albums, evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import decisions as dec
from .archive import table
from .assembly import SEG, dense

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EV = "ev AS (SELECT event_id AS id, user_id AS u, event_type AS label, value AS v, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as id, u, label, v, k."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("u"), F.col("event_type").alias("label"), F.col("value").alias("v"), k.alias("k"))


@query(f"WITH {EV}, a AS (SELECT id, CASE id % 7 WHEN 0 THEN 'non_content' WHEN 1 THEN 'likely_unrelated' WHEN 2 THEN 'family' END AS m, k % 6 AS f, k // 6 % 6 AS x, id % 4 AS n, id % 5 AS us, id % 5 + id % 2 AS fa, id % 3 = 0 AS o FROM ev), b AS (SELECT id, m, round(CASE WHEN m = 'family' THEN 0.5 ELSE 0 END + least(f * 0.08, 0.32) + least(n * 0.05, 0.2) + CASE WHEN us > 0 THEN least(us * 0.04, 0.16) WHEN fa > 0 THEN 0.04 ELSE 0 END, 6) AS p, round(CASE WHEN m = 'likely_unrelated' THEN 0.7 ELSE 0 END + least(x * 0.12, 0.48) + CASE WHEN o AND x > 0 THEN 0.08 ELSE 0 END, 6) AS q FROM a) SELECT id, CASE WHEN m = 'non_content' THEN 'non_content' WHEN round(q - p, 6) >= 0.22 AND q >= 0.62 THEN 'likely_unrelated' WHEN round(p - q, 6) >= 0.12 AND p >= 0.62 THEN 'likely_family' ELSE 'uncertain' END AS label, round(CASE WHEN m = 'non_content' THEN 0.96 WHEN round(q - p, 6) >= 0.22 AND q >= 0.62 THEN least(0.95, 0.5 + q - p * 0.35) WHEN round(p - q, 6) >= 0.12 AND p >= 0.62 THEN least(0.93, 0.48 + p - q * 0.25) ELSE greatest(0.35, least(0.68, 0.45 + abs(p - q))) END, 5) AS confidence FROM b")
def content_labels(spark, sf_dir):
    d, n = events(spark, sf_dir), F.col("id")
    mark = F.when(n % 7 == 0, "non_content").when(n % 7 == 1, "likely_unrelated").when(n % 7 == 2, "family")
    x = dec.content_label(mark, F.col("k") % 6, F.floor(F.col("k") / 6) % 6, n % 4, n % 5, n % 5 + n % 2, n % 3 == 0)
    return d.select("id", x.alias("x")).select("id", "x.label", F.round("x.confidence", 5).alias("confidence"))


@query("WITH o AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'day' WHEN 1 THEN 'day' WHEN 2 THEN 'year' WHEN 3 THEN 'decade' ELSE 'none' END AS p, year(o_orderdate) AS y, CASE WHEN o_custkey % 10 > 0 THEN 1993 + o_custkey % 3 END AS a, o_orderkey % 2 = 0 AS seen FROM orders), c AS (SELECT *, CASE WHEN a IS NULL THEN 'no_window' WHEN y BETWEEN a AND a + 4 THEN 'inside' ELSE 'outside' END AS ck FROM o) SELECT id, ck AS window_check, coalesce(CASE WHEN p IN ('day', 'year') AND ck = 'outside' OR p = 'decade' THEN 'narrated_historical' WHEN p = 'day' AND seen THEN 'overlay_datestamp' WHEN p = 'day' OR p = 'year' AND ck = 'inside' THEN 'narrated_current' END, '-') AS origin, NOT (p = 'day' AND ck <> 'outside') AS excluded, CASE WHEN p = 'day' THEN ck = 'no_window' AND NOT seen WHEN p = 'year' THEN ck <> 'outside' ELSE p <> 'decade' END AS needs_review FROM c")
def date_origins(spark, sf_dir):
    n = F.col("o_orderkey")
    kind = F.when(n % 5 <= 1, "day").when(n % 5 == 2, "year").when(n % 5 == 3, "decade").otherwise("none")
    first = F.when(F.col("o_custkey") % 10 > 0, 1993 + F.col("o_custkey") % 3)
    check = dec.window_check(F.year("o_orderdate"), first, first + 4)
    o = table(spark, sf_dir, "orders").select(n.alias("id"), check.alias("window_check"), dec.date_origin(kind, check, n % 2 == 0).alias("x"))
    return o.select("id", "window_check", F.coalesce("x.origin", F.lit("-")).alias("origin"), "x.excluded", "x.needs_review")


@query(f"WITH {EV}, a AS (SELECT id, abs((1940 + k) - (1940 + u * 3 % 100)) AS d, 1 + id % 5 AS sa, 1 + id % 4 AS sb, id % 6 AS n, id % 2 = 0 AS o FROM ev), b AS (SELECT *, d >= 15 AND sa <= 4 AND sb <= 4 AND o AS veto, d / greatest(1.0, sqrt(sa * sa + sb * sb)) AS z FROM a) SELECT id, CASE WHEN n >= 3 THEN CASE WHEN veto THEN 0.02 ELSE round(greatest(0.05, least(0.95, exp(-0.5 * z * z))), 4) END END AS score, n >= 3 AND veto AS blocked FROM b")
def age_agreement(spark, sf_dir):
    n = F.col("id")
    x = dec.age_agreement(1940 + F.col("k"), 1940 + F.col("u") * 3 % 100, 1 + n % 5, 1 + n % 4, n % 6, n % 2 == 0)
    return events(spark, sf_dir).select("id", x.alias("x")).select("id", "x.*")


BASES = ["direct_place", "same_event_place_context", "continuity", "nearby_time"]


@query(f"WITH {EV}, a AS (SELECT id, ['direct_place', 'same_event_place_context', 'continuity', 'nearby_time'][id % 4 + 1] AS b, CASE WHEN id % 3 > 0 THEN id % 3 = 1 END AS apart, k / 100.0 AS c FROM ev) SELECT id, CASE WHEN contains(b, 'direct') OR b = 'same_event_place_context' THEN 'geo' ELSE 'era' END AS kind, coalesce(apart, false) AS contradiction, CASE WHEN apart THEN least(c, 0.4) ELSE c END AS confidence FROM a")
def context_kinds(spark, sf_dir):
    n = F.col("id")
    basis = F.element_at(F.array(*[F.lit(b) for b in BASES]), (n % 4 + 1).cast("int"))
    x = dec.context_kind(basis, F.when(n % 3 > 0, n % 3 == 1), F.col("k") / 100.0)
    return events(spark, sf_dir).select("id", x.alias("x")).select("id", "x.*")


EDGES = ["inside_place_candidate", "within_region_candidate", "same_event_place_context", "nearby_time_place_context", "other"]


@query(f"WITH {EV}, a AS (SELECT id, id % 5 AS p, CASE WHEN id % 13 > 0 THEN k / 100.0 ELSE 0 END AS c, id % 11 = 0 AS closed, id % 2 = 0 AS open FROM ev) SELECT id, NOT closed AND CASE WHEN p < 2 THEN true WHEN p = 2 THEN c >= 0.6 WHEN p = 3 THEN c >= 0.56 ELSE open END AS reviewable, 4 - p AS rank, CASE WHEN p < 2 THEN 70 WHEN p = 2 THEN 48 WHEN p = 3 THEN 40 ELSE 42 END AS priority FROM a")
def place_edge_reviews(spark, sf_dir):
    n = F.col("id")
    predicate = F.element_at(F.array(*[F.lit(b) for b in EDGES]), (n % 5 + 1).cast("int"))
    x = dec.place_edge(predicate, F.when(n % 13 > 0, F.col("k") / 100.0), n % 11 == 0, n % 2 == 0)
    return events(spark, sf_dir).select("id", x.alias("x")).select("id", "x.reviewable", F.col("x.rank").cast("long").alias("rank"), "x.priority")


@query(f"WITH {EV}, a AS (SELECT id, least(greatest((k * 1.5 - 24) / 88.0, 0.0), 1.0) AS side, least(v / 60.0, 1.0) AS sharp, id % 256 AS b FROM ev) SELECT id, round(least(greatest(sqrt(side) * (0.5 + 0.5 * sharp) * CASE WHEN b < 30 THEN greatest(0.2, b / 30) WHEN b > 225 THEN greatest(0.2, (255 - b) / 225) ELSE 1.0 END, 0.0), 1.0), 9) AS weight FROM a")
def crop_weights(spark, sf_dir):
    return events(spark, sf_dir).select("id", F.round(dec.crop_weight(F.col("k") * 1.5, F.col("v"), F.col("id") % 256), 9).alias("weight"))


@query(f"WITH {EV} SELECT id, round(least(0.9, CASE id % 3 WHEN 0 THEN 0.72 WHEN 1 THEN 0.86 ELSE 0.58 END + least(k % 6 - 1, 3) * 0.04), 2) AS confidence FROM ev")
def relation_confidences(spark, sf_dir):
    n = F.col("id")
    basis = F.when(n % 3 == 0, "name_mention").when(n % 3 == 1, "event_summary_direct_phrase").otherwise("event_subject")
    return events(spark, sf_dir).select("id", dec.relation_confidence(basis, F.col("k") % 6).alias("confidence"))


@query(f"WITH {EV}, a AS (SELECT id, CASE id % 4 WHEN 0 THEN 'possible_misaligned' WHEN 1 THEN 'model_only' ELSE 'aligned' END AS st, CASE WHEN id % 5 < 3 THEN k / 100.0 END AS an, k % 3 AS rj, id % 7 = 0 AS nm, id % 2 = 0 AS mv, CASE WHEN id % 9 > 0 THEN v / 70 ELSE 0 END AS su FROM ev), b AS (SELECT *, an IS NOT NULL AND (st = 'possible_misaligned' OR nm) AS rt FROM a) SELECT id, CASE WHEN rt THEN 'retitled' WHEN st = 'model_only' THEN 'unverified' WHEN rj > 0 THEN 'places_filtered' ELSE 'supported' END AS title_status, CASE WHEN rt THEN 'corrected' WHEN st = 'model_only' THEN 'needs_evidence' WHEN rj > 0 THEN 'metadata_corrected' ELSE 'accepted' END AS status, round(CASE WHEN rt THEN least(0.95, an + CASE WHEN rj > 0 THEN 0.08 ELSE 0 END + CASE WHEN mv THEN 0.06 ELSE 0 END) WHEN st = 'model_only' THEN least(0.45, su) WHEN rj > 0 THEN greatest(0.5, least(0.9, su)) ELSE greatest(0.5, least(0.95, su)) END, 3) AS confidence FROM b")
def reconciled_events(spark, sf_dir):
    n, k = F.col("id"), F.col("k")
    status = F.when(n % 4 == 0, "possible_misaligned").when(n % 4 == 1, "model_only").otherwise("aligned")
    x = dec.reconciliation(status, F.when(n % 5 < 3, k / 100.0), k % 3, n % 7 == 0, n % 2 == 0, F.when(n % 9 > 0, F.col("v") / 70))
    return events(spark, sf_dir).select("id", x.alias("x")).select("id", "x.*")


RATES = "('click', 'tokens', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 2.5), ('click', 'minutes', 0.1, 9.0, NULL), ('view', 'images', NULL, 1.5, NULL), ('view', 'tokens', NULL, 0.4, 3.0), ('error', 'frames', 1.0, NULL, NULL)"


@query(f"WITH {EV}, r(label, unit, direct, k1, m1) AS (VALUES {RATES}), x AS (SELECT id, label, unnest(['tokens', 'minutes', 'images']) AS unit, unnest([v * 1000, k, id % 3]) AS n FROM ev) SELECT id, round(sum(coalesce(n * direct, n / 1e3 * k1, n / 1e6 * m1)), 8) AS cost FROM x LEFT JOIN r USING (label, unit) GROUP BY id")
def unit_costs(spark, sf_dir):
    rates = spark.sql(f"SELECT label, unit, CAST(direct AS DOUBLE) AS direct, CAST(per_1k AS DOUBLE) AS per_1k, CAST(per_1m AS DOUBLE) AS per_1m FROM VALUES {RATES} AS r(label, unit, direct, per_1k, per_1m)")
    return dec.unit_cost({"tokens": F.col("v") * 1000, "minutes": F.col("k"), "images": F.col("id") % 3}, rates, events(spark, sf_dir), "label")


@query(f"WITH {SEG}, c AS (SELECT id, media, s, CASE WHEN id % 17 = 0 THEN s ELSE e END AS e, least(conf * 8, 1.0) AS conf FROM seg WHERE label = 'click'), x AS (SELECT DISTINCT c.id FROM c JOIN seg b ON b.media = c.media AND b.label = 'view' AND c.e > c.s AND b.s < c.e AND b.e > c.s WHERE (least(c.e, b.e) - greatest(c.s, b.s)) / (c.e - c.s) >= 0.5 OR (least(c.e, b.e) - greatest(c.s, b.s)) / greatest(b.e - b.s, 0.001) >= 0.5) SELECT id, CASE WHEN x.id IS NOT NULL OR c.e <= c.s THEN 'known' WHEN conf < 0.7 THEN 'backlog' WHEN conf < 0.9 THEN 'review' ELSE 'promoted' END AS outcome FROM c LEFT JOIN x USING (id)")
def promoted_events(spark, sf_dir):
    d = dense(spark, sf_dir)
    c = d.where("label = 'click'").select("id", "media", "s", F.when(F.col("id") % 17 == 0, F.col("s")).otherwise(F.col("e")).alias("e"), F.least(F.col("conf") * 8, F.lit(1.0)).alias("conf"))
    return dec.promotions(c, d.where("label = 'view'"), "media")


@query(f"WITH {SEG} SELECT id, round(CASE WHEN id % 3 = 0 THEN s + 10 WHEN id % 5 <> 0 AND id % 4 = 0 THEN s - k ELSE s END, 5) AS s, round(CASE WHEN id % 3 = 0 THEN e + 10 WHEN id % 5 <> 0 AND id % 4 = 0 THEN e - k ELSE e END, 5) AS e, CASE WHEN id % 3 = 0 THEN 'range' WHEN id % 5 = 0 THEN 'content' WHEN id % 4 = 0 THEN 'regrounding' ELSE '-' END AS basis, id % 3 <> 0 AND id % 5 = 0 AS needs_review FROM seg")
def adjusted_events(spark, sf_dir):
    d = dense(spark, sf_dir).select("id", "s", "e", "k")
    moved = lambda by: d.select("id", (F.col("s") + by).alias("s"), (F.col("e") + by).alias("e"), F.lit(False).alias("needs_review"))
    flags = d.where("id % 5 = 0").select("id", F.lit(None).alias("s"), F.lit(None).alias("e"), F.lit(True).alias("needs_review"))
    out = dec.adjusted(d.drop("k"), [("range", moved(F.lit(10)).where("id % 3 = 0")), ("content", flags), ("regrounding", moved(-F.col("k")).where("id % 4 = 0"))])
    return out.select("id", F.round("s", 5).alias("s"), F.round("e", 5).alias("e"), F.coalesce("basis", F.lit("-")).alias("basis"), "needs_review")


WORDS = ["Correct", " mostly-correct", "Partial", "INCORRECT", "not sure", "skip", "needs followup", "what?"]


@query(f"WITH {EV}, j AS (SELECT label AS task, ['correct', 'mostly_correct', 'partial', 'incorrect', 'not_sure', 'skip', 'needs_followup', 'not_sure'][k % 8 + 1] AS j FROM ev WHERE id % 3 > 0), s AS (SELECT *, CASE j WHEN 'correct' THEN 1.0 WHEN 'mostly_correct' THEN 0.75 WHEN 'partial' THEN 0.5 WHEN 'incorrect' THEN 0.0 END AS p FROM j) SELECT coalesce(task, 'all') AS task, count(*) AS total, count(p) AS scored, round(avg(p), 6) AS score, {', '.join(f'count(*) FILTER (j = {w!r}) AS {w}' for w in ['correct', 'mostly_correct', 'partial', 'incorrect', 'not_sure', 'needs_followup', 'skip'])} FROM s GROUP BY GROUPING SETS ((task), ())")
def judged_packet(spark, sf_dir):
    d = events(spark, sf_dir)
    words = F.element_at(F.array(*[F.lit(w) for w in WORDS]), F.col("k") % 8 + 1)
    out = dec.judged(d.select("id", F.col("label").alias("task")), d.where("id % 3 > 0").select("id", words.alias("judgment")))
    return out.withColumn("task", F.coalesce("task", F.lit("all")))


@query(f"WITH {EV}, i AS (SELECT id, id % 9 AS t, CASE WHEN id % 4 > 0 THEN v END AS s FROM ev WHERE id % 9 <> 0 OR id % 5 = 0), n AS (SELECT *, CASE WHEN t < 7 THEN t ELSE 99 END AS p FROM i) SELECT id, t AS task_number, row_number() OVER (ORDER BY p, s NULLS LAST, id) AS number FROM n QUALIFY number <= 200")
def eval_packet(spark, sf_dir):
    tasks = [*dec.TASK_ORDER, "place_role_claim", "continuity_context"]
    name = F.element_at(F.array(*[F.lit(t) for t in tasks]), (F.col("id") % 9 + 1).cast("int"))
    d = events(spark, sf_dir).where("id % 9 <> 0 or id % 5 = 0").select("id", name.alias("task"), F.when(F.col("id") % 4 > 0, F.col("v")).alias("s"))
    return dec.packet(d).select("id", (F.col("id") % 9).alias("task_number"), F.col("number").cast("long").alias("number"))


@query(f"WITH {EV} SELECT id, CASE WHEN k % 10 >= 4 THEN 'primary' ELSE 'backlog' END AS tier, row_number() OVER (PARTITION BY u, k % 10 >= 4 ORDER BY k % 10 DESC, CASE WHEN id % 6 > 0 THEN v / 500 ELSE 1.0 END, CASE WHEN id % 5 > 0 THEN v END NULLS LAST, label, id) AS place FROM ev")
def review_tiers(spark, sf_dir):
    d = events(spark, sf_dir).select("id", "u", (F.col("k") % 10).alias("priority"), F.when(F.col("id") % 6 > 0, F.col("v") / 500).alias("conf"), F.when(F.col("id") % 5 > 0, F.col("v")).alias("s"), F.initcap("label").alias("title"))
    return dec.review_tiers(d, F.col("priority") >= 4, "u").select("id", "tier", F.col("place").cast("long").alias("place"))


@query(f"WITH {EV}, s AS (SELECT u, k % 25 AS p, ['voice_bucket_a', 'name_mention', 'role_identity_bridge', 'voice_bucket_b', 'co_presence'][k % 5 + 1] AS src, least(v / 300, 0.6) AS w, id // 3 AS ev3, id FROM ev), g AS (SELECT u, p, round(greatest(0.05, least(CASE WHEN bool_and(starts_with(src, 'voice_bucket')) THEN 0.68 WHEN NOT bool_or(src = 'role_identity_bridge') THEN 0.72 ELSE 0.94 END, max(w) + least(0.18, sum(w) * 0.12) + least(0.08, count(DISTINCT ev3) * 0.02) + least(0.08, count(DISTINCT id) * 0.004))), 6) AS confidence FROM s GROUP BY u, p) SELECT u AS speaker, p AS person, confidence, row_number() OVER (PARTITION BY u ORDER BY confidence DESC, p) AS place FROM g WHERE confidence >= 0.28 QUALIFY place <= 5")
def speaker_person_top5(spark, sf_dir):
    sources = ["voice_bucket_a", "name_mention", "role_identity_bridge", "voice_bucket_b", "co_presence"]
    d = events(spark, sf_dir).select(F.col("u").alias("speaker"), (F.col("k") % 25).alias("person"), F.element_at(F.array(*[F.lit(x) for x in sources]), F.col("k") % 5 + 1).alias("source"), F.least(F.col("v") / 300, F.lit(0.6)).alias("weight"), F.expr("id div 3").alias("event"), F.col("id").alias("segment"))
    return dec.speaker_candidates(d, "speaker", "person").withColumn("place", F.col("place").cast("long"))


@query(f"WITH {EV}, c AS (SELECT k % 20 AS person, 'p' || (id % 40) AS path, max(round(least(v / 300, 1.0) * least(v / 120, 1.0), 4)) AS score FROM ev WHERE least(v / 120, 1.0) >= 0.45 GROUP BY ALL) SELECT person, path, score, row_number() OVER (PARTITION BY person ORDER BY score DESC, path) AS place FROM c QUALIFY place <= 3")
def avatar_crops(spark, sf_dir):
    c = events(spark, sf_dir).select((F.col("k") % 20).alias("person"), F.concat(F.lit("p"), (F.col("id") % 40).cast("string")).alias("path"), F.least(F.col("v") / 120, F.lit(1.0)).alias("quality"), F.least(F.col("v") / 300, F.lit(1.0)).alias("attribution"))
    return dec.best_crops(c, "person", "path").withColumn("place", F.col("place").cast("long"))


@query(f"WITH {EV}, m AS (SELECT id // 3 AS album, array_to_string(list_sort(list(DISTINCT k % 5)), ',') AS members, max(v) / 500 AS conf FROM ev GROUP BY id // 3), a AS (SELECT album, album % 3 AS kind, CASE WHEN album % 10 > 0 THEN members END AS members, album % 4 = 0 AS cover, album % 2 = 0 AS unreviewed, conf FROM m) SELECT arg_max(album, {{'c': cover, 'u': unreviewed, 'f': conf, 'i': -album}}) AS id, count(*) AS n FROM a GROUP BY coalesce(kind || ':' || members, 'album ' || album)")
def distinct_albums(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("album", F.expr("id div 3"))
    n = F.col("album")
    albums = d.groupBy("album").agg((F.max("v") / 500).alias("conf")).select(n.alias("id"), (n % 3).alias("kind"), F.when(n % 4 == 0, n).alias("cover"), (n % 2 == 0).alias("unreviewed"), "conf")
    return dec.distinct_albums(albums, d.where("album % 10 > 0").select(n.alias("id"), (F.col("k") % 5).alias("event")), "kind")


CITES = "ct AS (SELECT DISTINCT id // 4 AS ev, CASE WHEN id % 6 = 0 THEN -id ELSE id // 400 * 400 + k * 4 END AS x FROM ev WHERE id // 4 % 9 > 0), vd AS (SELECT id AS x, v AS s, CASE WHEN id % 8 > 0 THEN v + k END AS e, CASE WHEN id % 3 = 0 THEN 'non_content_range' ELSE 'transcript' END AS kind FROM ev)"


def _cites(spark, sf_dir):
    """Event and claim cites of evidence; every sixth cites what does not exist."""
    n = F.col("id")
    return events(spark, sf_dir).withColumn("x", F.when(n % 6 == 0, -n).otherwise(F.expr("id div 400 * 400 + k * 4"))).select(F.expr("id div 4").alias("ev"), "x").where("ev % 9 > 0")


@query(f"WITH {EV}, {CITES}, e AS (SELECT id // 4 AS ev, min(v) AS s, min(v) + min(k) - 20 AS e FROM ev GROUP BY id // 4), g AS (SELECT ev, min(vd.s) AS gs, max(coalesce(vd.e, vd.s)) AS ge, count(*) AS n, bool_and(kind = 'non_content_range') AS blank FROM ct JOIN vd USING (x) GROUP BY ev) SELECT ev AS id, round(coalesce(gs, e.s), 6) AS s, round(greatest(coalesce(ge, e.e), coalesce(gs, e.s)), 6) AS e, coalesce(n, 0) AS n FROM e LEFT JOIN g USING (ev) WHERE NOT coalesce(blank, false)")
def cited_event_ranges(spark, sf_dir):
    d, n = events(spark, sf_dir), F.col("id")
    e = d.groupBy(F.expr("id div 4").alias("id")).agg(F.min("v").alias("s"), (F.min("v") + F.min("k") - 20).alias("e"))
    held = d.select(n.alias("evidence_id"), F.col("v").alias("s"), F.when(n % 8 > 0, F.col("v") + F.col("k")).alias("e"), F.when(n % 3 == 0, "non_content_range").otherwise("transcript").alias("kind"))
    out = dec.cited_events(e, _cites(spark, sf_dir).select(F.col("ev").alias("id"), F.col("x").alias("evidence_id")), held)
    return out.select("id", F.round("s", 6).alias("s"), F.round("e", 6).alias("e"), "n")


@query(f"WITH {EV}, {CITES}, cl AS (SELECT id AS claim, ['person_mention', 'place_candidate', 'language', 'gesture'][id % 4 + 1] AS p, label AS value, id // 400 * 400 + k * 4 AS x FROM ev WHERE id % 5 = 0), f AS (SELECT ev, claim, CASE p WHEN 'person_mention' THEN 'people' WHEN 'place_candidate' THEN 'place_candidates' WHEN 'language' THEN 'languages' END AS field, value FROM ct JOIN cl USING (x)) SELECT ev AS id, field, value, min(claim) AS first FROM f WHERE field IS NOT NULL GROUP BY ev, field, value")
def enriched_events(spark, sf_dir):
    n = F.col("id")
    c = events(spark, sf_dir).where("id % 5 = 0")
    name = F.element_at(F.array(*[F.lit(p) for p in ("person_mention", "place_candidate", "language", "gesture")]), (n % 4 + 1).cast("int"))
    claims = c.select(n.alias("claim"), name.alias("predicate"), F.col("label").alias("value"))
    cites = _cites(spark, sf_dir).select(F.col("ev").alias("id"), F.col("x").alias("evidence_id"))
    fields = {"person_mention": "people", "place_candidate": "place_candidates", "language": "languages", "date_candidate": "date_candidates"}
    return dec.enriched(cites, claims, c.select(n.alias("claim"), F.expr("id div 400 * 400 + k * 4").alias("evidence_id")), fields)


@query(f"WITH {SEG}, t AS (SELECT 'transcript' AS kind, conv_id * 1000 + turn AS source_id, conv_id AS media, CAST(turn AS DOUBLE) AS s, turn + 1.0 AS e, text FROM conversations UNION ALL SELECT 'caption', id, media, s, e, label FROM seg WHERE label = 'view' UNION ALL SELECT 'ocr', id, media, s, e, label || k FROM seg WHERE label = 'click') SELECT kind, media, count(*) AS n, round(min(s), 5) AS s, round(max(e), 5) AS e, CAST(sum(length(text)) AS BIGINT) AS chars, min(kind || '_' || lpad(CAST(source_id AS VARCHAR), 12, '0')) AS first FROM t GROUP BY kind, media")
def evidence_relation(spark, sf_dir):
    d = dense(spark, sf_dir)
    c = table(spark, sf_dir, "conversations")
    spoken = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("media"), F.col("turn").cast("double").alias("s"), (F.col("turn") + 1.0).alias("e"), "text")
    u = dec.evidence_union({"transcript": spoken, "caption": d.where("label = 'view'").withColumn("text", F.col("label")), "ocr": d.where("label = 'click'").withColumn("text", F.concat("label", F.col("k").cast("string")))})
    return u.groupBy("kind", "media").agg(F.count("*").alias("n"), F.round(F.min("s"), 5).alias("s"), F.round(F.max("e"), 5).alias("e"), F.sum(F.length("text")).alias("chars"), F.min("evidence_id").alias("first"))


@query(f"WITH {EV}, m(f, t) AS (VALUES (1, 9), (2, 9), (4, 9), (7, 3)), r AS (SELECT id, u, coalesce(t, u % 10) AS person FROM ev LEFT JOIN m ON f = u % 10) SELECT person, count(*) AS n, count(DISTINCT u % 10 * 1000 + id % 50) AS refs, min(id) AS first FROM r GROUP BY person")
def redirected_people(spark, sf_dir):
    moves = spark.sql("SELECT CAST(a AS BIGINT) AS f, CAST(b AS BIGINT) AS t FROM VALUES (1, 2), (2, 4), (4, 9), (7, 3) AS v(a, b)")
    d = events(spark, sf_dir).withColumn("person", F.col("u") % 10).withColumn("ref", F.col("person") * 1000 + F.col("id") % 50)
    out = dec.redirected(d, "person", agg.transitive(moves.toDF("src", "dst")))
    return out.groupBy("person").agg(F.count("*").alias("n"), F.count_distinct("ref").alias("refs"), F.min("id").alias("first"))


@query(f"WITH {EV} SELECT k * 20 + u % 20 AS claim, min(v) AS v FROM ev WHERE id % 2 = 0 AND k * 20 + u % 20 NOT IN (SELECT k * 20 + u % 20 FROM ev WHERE id % 2 = 1) GROUP BY ALL")
def backfilled_claims(spark, sf_dir):
    d = events(spark, sf_dir).withColumn("claim", F.col("k") * 20 + F.col("u") % 20)
    return dec.absent(d.where("id % 2 = 0").select("claim", "v"), d.where("id % 2 = 1"), "claim")


@query("WITH x AS (SELECT vec_id % 10 AS g, vec_id % 4 AS w, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS x FROM embeddings), s AS (SELECT g, dim, sum(CAST(x AS DOUBLE) * w) AS x FROM x WHERE w > 0 GROUP BY g, dim) SELECT g, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY g)), 6) AS x FROM s")
def weighted_centroids(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 10).alias("g"), "embedding", (F.col("vec_id") % 4).alias("w"))
    return dec.weighted_centroids(e, "g", "embedding", "w").select("g", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query("WITH o AS (SELECT source, text, min(doc_id) AS id FROM documents GROUP BY source, text), n AS (SELECT source, count(*) AS n FROM o GROUP BY source), h AS (SELECT source, id, unnest(regexp_extract_all(text, '(^|[^\\p{L}])\\p{L}{3,}')) AS hit FROM o), w AS (SELECT source, lower(regexp_extract(hit, '(\\p{L}+)', 1)) AS word, id, regexp_matches(hit, '^[^.!?\\n\\p{L}]\\p{Lu}') AS proper FROM h), g AS (SELECT source, word, count(*) + 2 * count(*) FILTER (proper) AS tf, count(DISTINCT id) AS df FROM w WHERE word NOT IN ('the', 'and', 'der', 'die') GROUP BY source, word), s AS (SELECT source, word, round(tf * (ln((1 + n) / (1 + df)) + 0.01), 6) AS score FROM g JOIN n USING (source)) SELECT source, word, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, word) AS place FROM s QUALIFY place <= 4")
def source_keywords(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    return dec.keywords(d, "source", "text", ["the", "and", "der", "die"]).withColumn("place", F.col("place").cast("long"))


@query("WITH d AS (SELECT doc_id, text, doc_id % 3 = 0 AS named, doc_id % 9 = 0 AS child, regexp_extract_all(text, '[^ \\t\\n\\r\\f]+') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(CASE WHEN named THEN 1.0 ELSE 0 END + CASE WHEN child THEN 1.5 ELSE 0 END + CASE WHEN regexp_matches(text, '(^|[^A-Za-z])[Tt]he[^A-Za-z]') THEN 3.0 ELSE 0 END + CASE WHEN regexp_matches(text, '[Ll]icense') THEN -2.0 ELSE 0 END + CASE WHEN regexp_matches(text, '![ \\t\\n\\r\\f]*$') AND len(w) <= 10 THEN 0.75 ELSE 0 END + CASE WHEN len(list_distinct(list_transform(w, lambda x: lower(x)))) <= 2 OR length(regexp_replace(text, '[^0-9]', '', 'g')) > length(text) / 4 THEN -2.0 ELSE 0 END, 3) AS salience FROM d")
def line_salience(spark, sf_dir):
    patterns = {"first": ("(^|[^A-Za-z])[Tt]he[^A-Za-z]", 3.0), "procedural": ("[Ll]icense", -2.0)}
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", dec.salience(F.col("text"), patterns, F.col("doc_id") % 3 == 0, F.col("doc_id") % 9 == 0).alias("salience"))

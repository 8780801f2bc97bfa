"""Queries over the driver tables: events are media segments, documents the search corpus, orders a ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import semantics as sem
from ..operators import aggregates as agg
from ..operators import folds, search
from ..operators import intervals as iv
from ..operators.linkage import linkage
from ..sources import readers
from ..streaming.sessions import sessions
from ..workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as id, media, s, e, label, conf, k."""
    e = table(spark, sf_dir, "events")
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("media"), s.alias("s"), (s + F.col("value")).alias("e"), F.col("event_type").alias("label"), F.least(F.col("value") / 500, F.lit(1.0)).alias("conf"), F.get_json_object("props", "$.k").cast("int").alias("k"))


SEG = "seg AS (SELECT event_id AS id, user_id AS media, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value AS e, event_type AS label, least(value / 500, 1.0) AS conf, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"
STOP = ", ".join(f"'{w}'" for w in sem.STOPWORDS)
TERMS = f"""w AS (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_'']+')) AS t FROM docs),
kept AS (SELECT id, CASE WHEN t LIKE '%ing' AND length(t) > 6 THEN t[:-4] WHEN t LIKE '%ed' AND length(t) > 5 THEN t[:-3] WHEN t LIKE '%ies' AND length(t) > 6 THEN t[:-4] || 'y' WHEN t LIKE '%s' AND length(t) > 4 THEN t[:-2] ELSE t END AS term
  FROM w WHERE length(t) > 1 AND t NOT IN ({STOP}) AND NOT regexp_full_match(t, '[0-9]+')),
tf AS (SELECT id, term, count(*) AS tf FROM kept GROUP BY ALL),
n AS (SELECT count(*) AS n FROM docs),
st AS (SELECT term, count(*) AS df, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 AS idf FROM tf, n GROUP BY term),
po AS (SELECT id, term, tf, (1 + ln(tf)) * idf AS weight FROM tf JOIN st USING (term)),
no AS (SELECT id, sqrt(sum(weight * weight)) AS norm, sum(tf) AS length FROM po GROUP BY id)"""
DOCS = "docs AS (SELECT doc_id AS id, text, lang FROM documents)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")


QTERMS = "q0 AS (SELECT term, count(*) AS qtf FROM (VALUES ('idiot'), ('licens'), ('under'), ('apache'), ('license'), ('version')) v(term) GROUP BY term)"


@query(f"WITH {DOCS}, {TERMS}, {QTERMS}, q AS (SELECT term, (1 + ln(qtf)) * coalesce(idf, 1.0) AS qw FROM q0 LEFT JOIN st USING (term)) SELECT id, round(sum(weight * qw) / (any_value(norm) * (SELECT sqrt(sum(qw * qw)) FROM q)), 9) AS score FROM po JOIN q USING (term) JOIN no USING (id) GROUP BY id ORDER BY score DESC, id LIMIT 20")
def tfidf_search(spark, sf_dir):
    index = search.build_index(corpus(spark, sf_dir))
    scores = search.tfidf_scores(index, search.query_terms(spark, "idiot licensed under apache license version"))
    return search.top(scores.withColumn("score", F.round("score", 9)), 20)


@query(f"WITH {DOCS}, {TERMS} SELECT term, df, round(idf, 9) AS idf FROM st")
def doc_frequency(spark, sf_dir):
    return search.build_index(corpus(spark, sf_dir)).stats.select("term", "df", F.round("idf", 9).alias("idf"))


@query(f"WITH {DOCS}, {TERMS}, {QTERMS} SELECT id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (SELECT avg(length) FROM no)))), 6) AS score FROM po JOIN q0 USING (term) JOIN st USING (term) JOIN no USING (id), n GROUP BY id ORDER BY score DESC, id LIMIT 20")
def bm25_rank(spark, sf_dir):
    index = search.build_index(corpus(spark, sf_dir))
    return search.top(search.bm25_scores(index, search.query_terms(spark, "idiot licensed under apache license version")).withColumn("score", F.round("score", 6)), 20)


@query(f"WITH {DOCS}, {TERMS}, a AS (SELECT term, weight AS w FROM po WHERE id = 5) SELECT id, round(sum(weight * w) / (any_value(norm) * (SELECT norm FROM no WHERE id = 5)), 9) AS score FROM po JOIN a USING (term) JOIN no USING (id) WHERE id <> 5 GROUP BY id ORDER BY score DESC, id LIMIT 20")
def tfidf_similar(spark, sf_dir):
    return search.similar(search.build_index(corpus(spark, sf_dir)), 5, 20).withColumn("score", F.round("score", 9))


@query(f"WITH {DOCS}, {TERMS}, {QTERMS}, sc AS (SELECT id, lang, round(sum(tf * qtf), 6) AS score FROM po JOIN q0 USING (term) JOIN docs USING (id) GROUP BY id, lang) SELECT id, lang, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 8")
def sectioned_topk(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    index = search.build_index(docs)
    hit = index.postings.join(F.broadcast(search.query_terms(spark, "idiot licensed under apache license version")), "term")
    hit = hit.groupBy("id").agg(F.sum(F.col("tf") * F.col("qtf")).cast("double").alias("score")).join(docs.select("id", "lang"), "id")
    return search.sectioned(hit, "lang", 8)


VEC = "q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], qe::DOUBLE[]) AS score FROM embeddings, q)"


def _dense(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = e.where("id = 0").select(F.col("v").alias("q"))
    return e.join(F.broadcast(q)).select("id", search.dot(F.col("v"), F.col("q")).alias("score"))


@query(f"WITH {VEC} SELECT id, round(score, 9) AS score FROM d ORDER BY score DESC, id LIMIT 20")
def dense_topk(spark, sf_dir):
    return search.top(_dense(spark, sf_dir), 20).withColumn("score", F.round("score", 9))


@query(f"WITH {DOCS}, {TERMS}, {QTERMS}, {VEC}, sp AS (SELECT id, round(sum(weight) / any_value(norm) / 10, 9) AS score FROM po JOIN q0 USING (term) JOIN no USING (id) GROUP BY id), rk AS (SELECT id, 1.0 / row_number() OVER (ORDER BY score DESC, id) AS score FROM sp), ex AS (SELECT id, 1.0 AS score FROM docs WHERE contains(lower(text), 'apache license')) SELECT id, round(sum(score), 6) AS score FROM (SELECT id, score FROM d UNION ALL SELECT id, 0.8 * score FROM sp UNION ALL SELECT id, 0.35 * score FROM rk UNION ALL SELECT id, 0.25 * score FROM ex) GROUP BY id ORDER BY score DESC, id LIMIT 20")
def exact_bonus_hybrid(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    index = search.build_index(docs)
    q = search.query_terms(spark, "idiot licensed under apache license version")
    sparse = index.postings.join(F.broadcast(q), "term").groupBy("id").agg(F.sum("weight").alias("w")).join(index.norms, "id").select("id", F.round(F.col("w") / F.col("norm") / 10, 9).alias("score"))
    # rounded, so that the order of a sum's terms decides no tie; only documents that match a query term are ranked
    rank = sparse.select("id", (1.0 / F.row_number().over(Window.orderBy(F.desc("score"), "id"))).alias("score"))
    exact = docs.where(F.contains(F.lower("text"), F.lit("apache license"))).select("id", F.lit(1.0).alias("score"))
    return search.hybrid(_dense(spark, sf_dir), sparse, rank, exact, 20).withColumn("score", F.round("score", 6))


@query("WITH c AS (SELECT label, p, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, p), cn AS (SELECT label, list(m ORDER BY p) AS c FROM c GROUP BY label) SELECT vec_id AS id, round((list_cosine_similarity(embedding::DOUBLE[], c) + 1) / 2, 9) AS confidence FROM embeddings JOIN cn USING (label)")
def centroid_confidence(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("p", "x")).groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("c"))
    norm = lambda v: F.sqrt(search.dot(v, v))
    cos = search.dot(F.col("embedding"), F.col("c")) / (norm(F.col("embedding")) * norm(F.col("c")))
    return e.join(c, "label").select(F.col("vec_id").alias("id"), F.round((cos + 1) / 2, 9).alias("confidence"))


@query(f"WITH {SEG} SELECT a.id AS a, b.id AS b, round(least(a.e, b.e) - greatest(a.s, b.s), 4) AS seconds FROM seg a JOIN seg b ON a.media = b.media AND a.label = 'view' AND b.label = 'click' AND a.s <= b.e AND a.e >= b.s")
def interval_overlap_join(spark, sf_dir):
    s = segments(spark, sf_dir)
    j = iv.interval_join(s.where("label = 'view'"), s.where("label = 'click'"), "media", 600.0)
    return j.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.round(F.least("l.e", "r.e") - F.greatest("l.s", "r.s"), 4).alias("seconds"))


@query(f"WITH {SEG} SELECT a.id AS point, b.id AS span FROM seg a JOIN seg b ON a.media = b.media AND a.id <> b.id AND a.s BETWEEN b.s AND b.e")
def point_in_interval(spark, sf_dir):
    s = segments(spark, sf_dir)
    j = iv.interval_join(s.withColumn("e", F.col("s")), s, "media", 600.0)
    return j.where("l.id <> r.id").select(F.col("l.id").alias("point"), F.col("r.id").alias("span"))


@query(f"WITH {SEG} SELECT a.id, count(*) AS n, string_agg(b.label, ' ' ORDER BY b.s, b.id) AS labels FROM seg a JOIN seg b ON a.media = b.media AND b.s BETWEEN a.s - 8 AND a.s + 8 GROUP BY a.id")
def band_self_join_8s(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("e", F.col("s"))
    j = iv.interval_join(s, s, "media", 16.0, slack=8.0)
    near = F.transform(F.array_sort(F.collect_list(F.struct("r.s", "r.id", "r.label"))), lambda x: x["label"])
    return j.groupBy(F.col("l.id").alias("id")).agg(F.count("*").alias("n"), F.array_join(near, " ").alias("labels"))


@query(f"WITH {SEG} SELECT a.id, b.id AS before FROM (SELECT * FROM seg WHERE label = 'purchase') a ASOF LEFT JOIN (SELECT * FROM seg WHERE label = 'click') b ON a.media = b.media AND a.s >= b.s")
def as_of_nearest(spark, sf_dir):
    s = segments(spark, sf_dir)
    out = iv.as_of(s.where("label = 'purchase'"), s.where("label = 'click'"), "media", "s", ["id"])
    return out.select("id", F.col("near.id").alias("before"))


@query(f"WITH {SEG}, j AS (SELECT a.id, b.id AS near, greatest(b.s - a.s, a.s - b.e, 0.0) AS gap FROM seg a JOIN seg b ON a.media = b.media AND a.label = 'error' AND b.label = 'view' AND a.s >= b.s - 900 AND a.s <= b.e + 900) SELECT id, near, round(gap, 4) AS gap FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY gap, near DESC) = 1")
def nearest_within_900s(spark, sf_dir):
    s = segments(spark, sf_dir)
    points = s.where("label = 'error'").withColumn("e", F.col("s"))
    j = iv.interval_join(points, s.where("label = 'view'"), "media", 1800.0, slack=900.0)
    j = j.select(F.col("l.id").alias("id"), F.col("r.id").alias("near"), F.greatest(F.col("r.s") - F.col("l.s"), F.col("l.s") - F.col("r.e"), F.lit(0.0)).alias("gap"))
    w = Window.partitionBy("id").orderBy("gap", F.desc("near"))
    return j.withColumn("r", F.row_number().over(w)).where("r = 1").select("id", "near", F.round("gap", 4).alias("gap"))


MERGE = "m0 AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY media ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 15 THEN 0 ELSE 1 END AS new FROM seg), m1 AS (SELECT *, sum(new) OVER (PARTITION BY media ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m0), m AS (SELECT media, min(s) AS s, max(e) AS e, count(*) AS n FROM m1 GROUP BY media, i)"


@query(f"WITH {SEG}, {MERGE} SELECT media, round(s, 4) AS s, round(e, 4) AS e, n FROM m")
def merge_intervals(spark, sf_dir):
    m = iv.merge_intervals(segments(spark, sf_dir), "media", 15.0)
    return m.select("media", F.round("s", 4).alias("s"), F.round("e", 4).alias("e"), "n")


@query(f"WITH {SEG}, {MERGE}, c AS (SELECT media, e AS s, lead(s) OVER (PARTITION BY media ORDER BY s) AS e FROM m) SELECT media, round(s, 4) AS s, round(e, 4) AS e FROM c WHERE e > s")
def complement_spans(spark, sf_dir):
    c = iv.complement(iv.merge_intervals(segments(spark, sf_dir), "media", 15.0), "media")
    return c.select("media", F.round("s", 4).alias("s"), F.round("e", 4).alias("e"))


@query(f"WITH {SEG}, x AS (SELECT * FROM seg WHERE label = 'error') SELECT count(*) AS kept, sum(id)::BIGINT AS ids FROM seg a WHERE label <> 'error' AND NOT EXISTS (SELECT 1 FROM x WHERE x.media = a.media AND a.s <= x.e AND a.e >= x.s AND ((a.s >= x.s AND a.s <= x.e) OR (a.e > a.s AND greatest(least(a.e, x.e) - greatest(a.s, x.s), 0) / (a.e - a.s) >= 0.5)))")
def exclusion_filter(spark, sf_dir):
    s = segments(spark, sf_dir)
    rows, out = s.where("label <> 'error'"), s.where("label = 'error'")
    j = iv.interval_join(rows, out, "media", 600.0).where(sem.overlaps_enough(F.col("l.s"), F.col("l.e"), F.col("r.s"), F.col("r.e")))
    kept = rows.join(j.select(F.col("l.id").alias("id")).distinct(), "id", "left_anti")
    return kept.agg(F.count("*").alias("kept"), F.sum("id").alias("ids"))


@query(f"WITH {SEG}, c AS (SELECT *, CASE WHEN label = lag(label) OVER w THEN 0 ELSE 1 END AS new FROM seg WINDOW w AS (PARTITION BY media ORDER BY s, id)), i AS (SELECT *, sum(new) OVER (PARTITION BY media ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS i FROM c) SELECT media, label, count(*) AS n, min(id) AS first_id, round(max(e) - min(s), 4) AS seconds FROM i GROUP BY media, i, label")
def rle_labels(spark, sf_dir):
    w = Window.partitionBy("media").orderBy("s", "id")
    runs = iv.islands(segments(spark, sf_dir), "media", ["s", "id"], F.col("label") == F.lag("label").over(w))
    return runs.groupBy("media", "island", "label").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.round(F.max("e") - F.min("s"), 4).alias("seconds")).drop("island")


@query(f"WITH {SEG}, c AS (SELECT *, CASE WHEN label = lag(label) OVER w AND s - lag(e) OVER w <= 900 THEN 0 ELSE 1 END AS new FROM seg WINDOW w AS (PARTITION BY media ORDER BY s, id)), i AS (SELECT *, sum(new) OVER (PARTITION BY media ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS i FROM c) SELECT media, label, count(*) AS n, min(id) AS first_id FROM i GROUP BY media, i, label")
def type_segments_900s(spark, sf_dir):
    w = Window.partitionBy("media").orderBy("s", "id")
    same = (F.col("label") == F.lag("label").over(w)) & (F.col("s") - F.lag("e").over(w) <= 900)
    return iv.islands(segments(spark, sf_dir), "media", ["s", "id"], same).groupBy("media", "island", "label").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).drop("island")


@query("WITH c AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM c) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 900000000 AS end_us, count(*) AS n FROM i GROUP BY user_id, i")
def session_islands(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return sessions(e, "user_id", "ts").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query(f"WITH {SEG}, d AS (SELECT *, CASE WHEN label = 'signup' THEN k END AS mark FROM seg) SELECT id, last_value(mark IGNORE NULLS) OVER (PARTITION BY media ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS carried FROM d")
def carry_forward(spark, sf_dir):
    w = Window.partitionBy("media").orderBy("s", "id").rowsBetween(Window.unboundedPreceding, 0)
    return segments(spark, sf_dir).select("id", F.last(F.when(F.col("label") == "signup", F.col("k")), ignorenulls=True).over(w).alias("carried"))


DUR = "t AS (SELECT user_id AS media, sum(value) AS duration FROM events GROUP BY user_id)"


def _durations(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("media")).agg(sem.exact_sum(F.col("value")).alias("duration"))


@query(f"WITH {DUR}, w AS (SELECT media, duration, unnest(range(0, greatest(ceil(duration / 30), 1)::BIGINT)) AS idx FROM t) SELECT media, idx, idx * 30.0 AS w_start, round(least((idx + 1) * 30.0, duration), 6) AS w_end FROM w")
def tumbling_windows(spark, sf_dir):
    return iv.tumbling(_durations(spark, sf_dir), 30.0).select("media", F.col("idx").cast("long").alias("idx"), "w_start", F.round("w_end", 6).alias("w_end"))


@query(f"WITH {DUR}, w AS (SELECT media, duration, unnest(range(0, greatest(ceil((duration - 1200) / 1170), 0)::BIGINT + 1)) AS idx FROM t) SELECT media, idx, idx * 1170.0 AS w_start, round(least(idx * 1170.0 + 1200, duration), 6) AS w_end FROM w")
def hopping_windows(spark, sf_dir):
    return iv.hopping(_durations(spark, sf_dir), 1200.0, 1170.0).select("media", F.col("idx").cast("long").alias("idx"), "w_start", F.round("w_end", 6).alias("w_end"))


@query(f"WITH {DUR} SELECT media, round(coalesce(sum(duration) OVER (ORDER BY media ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS at FROM t")
def running_offsets(spark, sf_dir):
    """Media are few beside their rows: one row each is ordered globally."""
    w = Window.orderBy("media").rowsBetween(Window.unboundedPreceding, -1)
    return _durations(spark, sf_dir).select("media", F.round(F.coalesce(F.sum("duration").over(w), F.lit(0.0)), 4).alias("at"))


@query(f"WITH {SEG}, a AS (SELECT media, id, avg(conf) OVER (PARTITION BY media ORDER BY s, id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m, count(*) OVER (PARTITION BY media ORDER BY s, id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n FROM seg) SELECT media, id, round(m, 9) AS m FROM a WHERE n = 3 QUALIFY row_number() OVER (PARTITION BY media ORDER BY round(m, 9) DESC, id) = 1")
def moving_avg_argmax(spark, sf_dir):
    w = Window.partitionBy("media").orderBy("s", "id").rowsBetween(0, 2)
    a = segments(spark, sf_dir).select("media", "id", F.round(F.avg("conf").over(w), 9).alias("m"), F.count("*").over(w).alias("n")).where("n = 3")
    return a.withColumn("r", F.row_number().over(Window.partitionBy("media").orderBy(F.desc("m"), "id"))).where("r = 1").select("media", "id", "m")


@query("WITH t AS (SELECT user_id AS media, event_type AS label, round(sum(value), 6) AS amount FROM events GROUP BY ALL) SELECT media, label, amount, round(amount / sum(amount) OVER (PARTITION BY media), 6) AS share, rank() OVER (PARTITION BY media ORDER BY amount DESC) AS rank FROM t")
def overlap_duration_share_rank(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("media"), F.col("event_type").alias("label"), "value")
    t = e.groupBy("media", "label").agg(F.round(F.sum("value"), 6).alias("v"))
    return agg.share_and_rank(t, "media", "label", "v").withColumn("share", F.round("share", 6))


@query("SELECT event_type, CAST(user_id % 3 AS BIGINT) AS part, round(avg(value), 6) AS mean, count(*) AS n, count(*) FILTER (value > 100) AS high FROM events GROUP BY GROUPING SETS ((), (event_type), (user_id % 3))")
def grouping_sets_score(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("part", F.col("user_id") % 3)
    return agg.grouping_report(e, ["event_type", "part"], [F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("high")])


@query("SELECT lang, count(quality) AS judged, count(*) FILTER (quality = 1) AS supported, round(count(*) FILTER (quality = 1) / count(quality), 6) AS precision FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang))")
def verification_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    ok = F.count_if(F.col("quality") == 1)
    return agg.grouping_report(d, ["lang"], [F.count("quality").alias("judged"), ok.alias("supported"), F.round(ok / F.count("quality"), 6).alias("precision")])


@query("SELECT source, count(*) AS n, round(avg(quality), 6) AS precision FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING count(*) >= 8 AND avg(quality) < 0.9")
def low_precision_having(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.avg("quality").alias("precision")).where("n >= 8 and precision < 0.9").withColumn("precision", F.round("precision", 6))


@query("SELECT o_orderpriority AS service, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS cost, count(*) FILTER (l_tax = 0) AS untaxed FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY GROUPING SETS ((), (o_orderpriority))")
def cost_summary(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("service", F.col("o_orderpriority"))
    return agg.grouping_report(j, ["service"], [F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("cost"), F.count_if(F.col("l_tax") == 0).alias("untaxed")])


@query("SELECT event_type, 'k' AS unit, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def unit_map_explode(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("unit", "v"))
    return e.groupBy("event_type", "unit").agg(F.sum(F.col("v").try_cast("long")).alias("total"))


@query("WITH r AS (SELECT * FROM (VALUES ('view', 0.5), ('click', 1.25)) v(label, rate)) SELECT event_type, round(sum(value * rate), 4) AS cost, count(*) FILTER (rate IS NULL) AS unknown FROM events LEFT JOIN r ON event_type = label GROUP BY event_type")
def rate_lookup(spark, sf_dir):
    rates = spark.createDataFrame([("view", 0.5), ("click", 1.25)], "event_type string, rate double")
    e = table(spark, sf_dir, "events").join(F.broadcast(rates), "event_type", "left")
    return e.groupBy("event_type").agg(F.round(F.sum(F.col("value") * F.col("rate")), 4).alias("cost"), F.count_if(F.col("rate").isNull()).alias("unknown"))


@query("WITH c AS (SELECT user_id AS media, value, sum(w) OVER (PARTITION BY user_id ORDER BY value, w ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY user_id) AS total FROM (SELECT *, 1 + event_id % 3 AS w FROM events)) SELECT media, min(value) AS median FROM c WHERE cum >= total / 2 GROUP BY media")
def weighted_median_mad(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("media"), "value", (1 + F.col("event_id") % 3).alias("w"))
    return agg.weighted_median(e, "media", "value", "w")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS seen FROM events GROUP BY ALL) SELECT user_id, event_type AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, seen) = 1")
def mode_first_seen(spark, sf_dir):
    return agg.mode_first(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@query("WITH x AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS v FROM events), f AS (SELECT user_id, arg_min(v, event_id) AS v, min(event_id) AS seen FROM x GROUP BY user_id, lower(v)) SELECT user_id, string_agg(v, ',' ORDER BY seen) AS vals, count(*) AS n FROM f GROUP BY user_id")
def ordered_distinct_ci(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")))
    return agg.ordered_distinct_ci(e, "user_id", "v", "event_id")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def last_wins_dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.struct("user_id", "event_type").alias("key"))
    return agg.last_wins(e, "key", [F.desc("event_id")]).drop("key")


@query("WITH a AS (SELECT event_id AS id, value AS v FROM events WHERE event_id % 3 <> 0), b AS (SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN value + 1 ELSE value END AS v FROM events WHERE event_id % 3 <> 1) SELECT CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS what, count(*) AS n FROM a FULL JOIN b ON a.id = b.id GROUP BY what")
def set_diff_full_outer(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("v"))
    new = e.where("id % 3 <> 1").withColumn("v", F.when(F.col("id") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return agg.set_diff(e.where("id % 3 <> 0"), new, "id", "v").groupBy("what").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_uncovered(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("WITH n AS (SELECT DISTINCT p_name AS a FROM part) SELECT x.a AS left_name, y.a AS right_name, round(1 - levenshtein(x.a, y.a) / greatest(length(x.a), length(y.a)), 6) AS similarity FROM n x JOIN n y ON split_part(x.a, ' ', 2) = split_part(y.a, ' ', 2) AND x.a < y.a")
def edit_similarity(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct().withColumn("block", F.split("a", " ")[1])
    j = n.alias("x").join(n.alias("y"), F.expr("x.block = y.block and x.a < y.a"))
    return j.select(F.col("x.a").alias("left_name"), F.col("y.a").alias("right_name"), F.round(sem.edit_similarity(F.col("x.a"), F.col("y.a")), 6).alias("similarity"))


@query("WITH d AS (SELECT unnest(regexp_extract_all(text, '\\b((?:18|19|20)\\d\\d)\\b', 1)) AS y FROM documents) SELECT y AS year_text, count(*) AS n FROM d GROUP BY y")
def year_mentions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\b((?:18|19|20)\d\d)\b"), F.lit(1))).alias("year_text"))
    return d.groupBy("year_text").agg(F.count("*").alias("n"))


@query("WITH p AS (SELECT event_id AS id, least(greatest(least(value / 500, 1.0), 0.02), 0.98) AS a, least(greatest(CAST(json_extract(props, '$.k') AS INTEGER) / 100.0, 0.02), 0.98) AS b FROM events) SELECT id, round(1 / (1 + exp(-(ln(0.08 / 0.92) + 1.0 * ln(a / (1 - a)) + 0.5 * ln(b / (1 - b))))), 9) AS p FROM p")
def log_odds_fusion(spark, sf_dir):
    s = segments(spark, sf_dir)
    return s.select("id", F.round(agg.fuse_log_odds({"conf": (F.col("conf"), 1.0), "k": (F.col("k") / 100.0, 0.5)}), 9).alias("p"))


EDGE = f"WITH {SEG}, x AS (SELECT least(media, k) AS subject, label AS predicate, greatest(media, k) AS object, id, conf, s, e FROM seg), g AS (SELECT subject, predicate, object, avg(conf) AS confidence, count(DISTINCT id) AS n_events, count(DISTINCT id // 3) AS n_evidence, min(s) AS s, max(e) AS e FROM x GROUP BY subject, predicate, object)"


@query(f"{EDGE} SELECT subject, predicate, object, n_events, round(confidence, 9) AS confidence, round(least(1.0, 0.16 * n_events + least((e - s) / 1800, 0.25) + least(0.04 * n_evidence, 0.2) + 0.25 * confidence), 6) AS weight FROM g")
def edge_aggregate(spark, sf_dir):
    s = segments(spark, sf_dir).withColumn("evidence", F.expr("id div 3")).withColumnRenamed("id", "event")
    return agg.edges(s, "media", "label", "k", evidence="evidence").select("subject", "predicate", "object", "n_events", F.round("confidence", 9).alias("confidence"), F.round("weight", 6).alias("weight"))


@query("WITH o AS (SELECT event_type AS action, count(*) AS n, (count(*) FILTER (value > 20) + 1.0) / (count(*) + 2.0) AS p FROM events GROUP BY event_type) SELECT action, n, round(CASE WHEN n >= 8 THEN greatest(0.5, least(0.99, CASE WHEN 0.7 - p > 0 THEN 0.8 + least(0.15, 0.5 * (0.7 - p)) ELSE 0.8 - least(0.05, 0.25 * (p - 0.7)) END)) ELSE 0.8 END, 9) AS new_floor FROM o")
def calibrate_floors(spark, sf_dir):
    o = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("n"), ((F.count_if(F.col("value") > 20) + 1) / (F.count("*") + 2)).alias("precision"))
    return agg.calibrated_floors(o.withColumn("floor", F.lit(0.8)).withColumn("target", F.lit(0.7))).select("action", "n", F.round("new_floor", 9).alias("new_floor"))


LOG = "log AS (SELECT event_id AS seq, user_id % 20 AS target, CASE WHEN event_type IN ('view', 'click') THEN 'machine' ELSE 'human' END AS actor, CASE WHEN value > 40 THEN 'confirm' ELSE 'refute' END AS verdict, event_type AS field, value FROM events)"


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), (F.col("user_id") % 20).alias("target"), F.when(F.col("event_type").isin("view", "click"), "machine").otherwise("human").alias("actor"), F.when(F.col("value") > 40, "confirm").otherwise("refute").alias("verdict"), F.col("event_type").alias("field"), "value")


@query(f"WITH {LOG}, b AS (SELECT *, last_value(CASE WHEN actor = 'machine' THEN verdict END IGNORE NULLS) OVER (PARTITION BY target ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM log) SELECT seq, target FROM b WHERE actor = 'human' AND verdict = 'refute' AND before = 'confirm'")
def ordered_override_fold(spark, sf_dir):
    return agg.overrides(_log(spark, sf_dir), "target", "seq", "actor", "verdict").select("seq", "target")


@query(f"WITH {LOG} SELECT target, field, arg_max(value, seq) AS value FROM log WHERE NOT (verdict = 'refute') GROUP BY target, field")
def replay_corrections(spark, sf_dir):
    log = _log(spark, sf_dir).withColumn("superseded", F.col("verdict") == "refute")
    return agg.latest_patch(log, "target", "field", "value", "seq", "superseded")


@query("WITH RECURSIVE m AS (SELECT c_custkey AS src, c_custkey // 3 AS dst FROM customer WHERE c_custkey % 3 = 0 AND c_custkey > 0), r AS (SELECT src, dst FROM m UNION ALL SELECT r.src, m.dst FROM r JOIN m ON r.dst = m.src) SELECT src, min(dst) AS dst FROM r GROUP BY src")
def transitive_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0 and c_custkey > 0")
    return agg.transitive(c.select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 3").alias("dst")))


@query("WITH v AS (SELECT o_custkey % 25 AS media, year(o_orderdate) AS y, o_orderstatus AS region, sum(CASE o_orderpriority WHEN '1-URGENT' THEN 2.0 ELSE 1.0 END) AS votes FROM orders GROUP BY ALL), t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY media, y ORDER BY votes DESC, region) = 1), c AS (SELECT *, CASE WHEN region = lag(region) OVER (PARTITION BY media ORDER BY y) AND y - lag(y) OVER (PARTITION BY media ORDER BY y) <= 2 THEN 0 ELSE 1 END AS new FROM t), i AS (SELECT *, sum(new) OVER (PARTITION BY media ORDER BY y ROWS UNBOUNDED PRECEDING) AS i FROM c) SELECT media, region, CAST(min(y) AS BIGINT) AS from_year, CAST(max(y) AS BIGINT) AS to_year FROM i GROUP BY media, i, region")
def era_islands(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    votes = o.groupBy((F.col("o_custkey") % 25).alias("media"), F.year("o_orderdate").cast("long").alias("y"), F.col("o_orderstatus").alias("region")).agg(F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 2.0).otherwise(1.0)).alias("votes"))
    best = Window.partitionBy("media", "y").orderBy(F.desc("votes"), "region")
    t = votes.withColumn("r", F.row_number().over(best)).where("r = 1")
    w = Window.partitionBy("media").orderBy("y")
    same = (F.col("region") == F.lag("region").over(w)) & (F.col("y") - F.lag("y").over(w) <= 2)
    return iv.islands(t, "media", ["y"], same).groupBy("media", "island", "region").agg(F.min("y").alias("from_year"), F.max("y").alias("to_year")).drop("island")


@query("SELECT event_type AS task_type, count(*) AS n FROM events GROUP BY event_type")
def eval_task_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("task_type")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type, value / 500 AS confidence FROM events WHERE value / 500 < 0.75 OR value IS NULL OR event_type = 'error'")
def eval_low_confidence_queue(spark, sf_dir):
    """An error row stands for one whose review_status is needs_review."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("value") / 500).alias("confidence"))
    return e.where("confidence is null or confidence < 0.75 or event_type = 'error'").orderBy(F.asc_nulls_first("confidence"), "event_id")


@query("SELECT user_id % 10 AS grp, CAST(least(floor(value / 50), 9) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def histogram(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 10).alias("grp"), F.least(F.floor(F.col("value") / 50), F.lit(9)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations) SELECT conv_id, role, count(*) AS turns, sum(n)::BIGINT AS chars, min(turn) AS first_turn FROM t GROUP BY conv_id, role")
def speaker_tracks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.min("turn").alias("first_turn"))


@query("SELECT n_name, r_name, count(c_custkey) AS people, round(avg(c_acctbal), 6) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
def place_groups(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.groupBy("n_name", "r_name").agg(F.count("c_custkey").alias("people"), F.round(F.avg("c_acctbal"), 6).alias("mean"))


@query()
def stitch_events(spark, sf_dir):
    """All eight signals, made of k and id; a gap of 900 s, as segments here lie far apart."""
    k = F.col("k")
    s = segments(spark, sf_dir).withColumn("words", F.array("label", (k % 3).cast("string")))
    s = s.withColumns({"places": F.array(k % 5), "dates": F.when(k % 6 > 0, F.array(k % 6)), "people": F.array(k % 4), "source": F.col("id") % 2, "boundary": k > 90})
    return folds.stitch(s, gap=900.0)


@query()
def budget_batches(spark, sf_dir):
    return folds.budget_batches(segments(spark, sf_dir), "media")


@query()
def constrained_hac(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 50).alias("frame"), F.col("embedding").alias("v"))
    return linkage(e, 0.9, Workspace(spark, "hac"))


@query()
def stratified_sample(spark, sf_dir):
    return agg.stratified_sample(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", F.col("value") + 0.01, 200)


@query()
def json_salvage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    broken = F.concat(F.lit("```json {\"start_s\": 1:23, \"items\": ["), "props", F.lit(", {\"cut"))
    return e.select("event_id", readers.salvaged(broken).alias("json"))


@query()
def subtitle_cues(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    # a blank line would end the cue, and a line of digits would be a counter
    text = F.regexp_replace("text", r"[\r\n]+", " ")
    cue = F.concat(F.lit("1\n00:00:0"), (F.col("turn") % 10).cast("string"), F.lit(",500 --> 00:01:00,000\n<i>"), text, F.lit("</i>\n\n"))
    return readers.subtitles(c.select("conv_id", "turn", cue.alias("value")))

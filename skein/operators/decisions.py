"""Decision rules as column expressions, and the relations that apply them: content, dates, ages, places, reviews, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv

# fixed values of judgments and of the order of review tasks
JUDGMENT_SCORES = {"correct": 1.0, "mostly_correct": 0.75, "partial": 0.5, "incorrect": 0.0}
OPEN_JUDGMENTS = ["not_sure", "needs_followup", "skip"]
TASK_ORDER = ["event_correctness", "album_grouping", "place_resolution", "person_identity", "date_candidate", "relationship_candidate", "context_edge"]
RELATION_BASES = {"name_mention": 0.72, "event_summary_direct_phrase": 0.86}


def lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(v) for pair in values.items() for v in pair])[key]


def content_label(marked: Column, family_terms: Column, foreign_terms: Column, named: Column, usable_faces: Column, faces: Column, has_ocr: Column, least: float = 0.62) -> Column:
    """struct(label, confidence): family or unrelated by terms, names, faces and the mark it had.

    Family gains 0.5 by its mark, 0.08 a term (0.32 at most), 0.05 a name (0.2), 0.04 a usable face (0.16, or
    0.04 for unusable ones); unrelated 0.7, 0.12 a term (0.48) and 0.08 for on-screen text beside them.
    A side wins with `least` and a lead of 0.12 (family) or 0.22.
    """
    known = F.lower(F.coalesce(marked, F.lit("")))
    face = F.when(usable_faces > 0, F.least(usable_faces * 0.04, F.lit(0.16))).when(faces > 0, 0.04).otherwise(0.0)
    ours = F.when(known.isin("likely_family", "family", "personal"), 0.5).otherwise(0.0) + F.least(family_terms * 0.08, F.lit(0.32)) + F.least(named * 0.05, F.lit(0.2)) + face
    foreign = F.when(known.isin("likely_unrelated", "unrelated"), 0.7).otherwise(0.0) + F.least(foreign_terms * 0.12, F.lit(0.48)) + F.when(has_ocr & (foreign_terms > 0), 0.08).otherwise(0.0)
    x, y = F.round(ours, 6), F.round(foreign, 6)
    say = lambda label, confidence: F.struct(F.lit(label).alias("label"), F.round(confidence, 6).alias("confidence"))
    return F.when(known == "non_content", say("non_content", F.lit(0.96))).when((F.round(y - x, 6) >= 0.22) & (y >= least), say("likely_unrelated", F.least(F.lit(0.95), 0.5 + y - x * 0.35))).when((F.round(x - y, 6) >= 0.12) & (x >= least), say("likely_family", F.least(F.lit(0.93), 0.48 + x - y * 0.25))).otherwise(say("uncertain", F.greatest(F.lit(0.35), F.least(F.lit(0.68), 0.45 + F.abs(x - y)))))


def window_check(year: Column, first: Column, last: Column) -> Column:
    """inside, outside or no_window."""
    return F.when(year.isNull() | first.isNull(), "no_window").when(year.between(first, last), "inside").otherwise("outside")


def date_origin(precision: Column, check: Column, on_screen: Column) -> Column:
    """struct(origin, excluded, needs_review) of a parsed date: day, year, decade or unparsed, against its capture window."""
    say = lambda origin, excluded, review: F.struct(F.lit(origin).cast("string").alias("origin"), F.lit(excluded).alias("excluded"), review.alias("needs_review"))
    no, yes = F.lit(False), F.lit(True)
    day = F.when(check == "outside", say("narrated_historical", True, no)).when(on_screen, say("overlay_datestamp", False, no)).otherwise(say("narrated_current", False, check == "no_window"))
    year = F.when(check == "outside", say("narrated_historical", True, no)).when(check == "inside", say("narrated_current", True, yes)).otherwise(say(None, True, yes))
    return F.when(precision == "day", day).when(precision == "year", year).when(precision == "decade", say("narrated_historical", True, no)).otherwise(say(None, True, yes))


def age_agreement(birth_a: Column, birth_b: Column, sigma_a: Column, sigma_b: Column, samples: Column, overlap: Column) -> Column:
    """struct(score, blocked): exp(-z^2 / 2) within 0.05 to 0.95; null below three samples; 0.02 and blocked where sure birth years 15 apart or more meet in one year."""
    apart = F.abs(birth_a - birth_b)
    z = apart / F.greatest(F.lit(1.0), F.sqrt(sigma_a * sigma_a + sigma_b * sigma_b))
    veto = (apart >= 15) & (sigma_a <= 4) & (sigma_b <= 4) & overlap
    score = F.when(veto, 0.02).otherwise(F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.exp(-0.5 * z * z))), 4))
    return F.struct(F.when(samples >= 3, score).alias("score"), ((samples >= 3) & veto).alias("blocked"))


def context_kind(basis: Column, apart: Column, confidence: Column) -> Column:
    """struct(kind, contradiction, confidence): geo by a direct basis or one event, else era; 0.4 at most where anchored regions are apart."""
    kind = F.when(F.contains(basis, F.lit("direct")) | (basis == "same_event_place_context"), "geo").otherwise("era")
    clash = F.coalesce(apart, F.lit(False))
    return F.struct(kind.alias("kind"), clash.alias("contradiction"), F.when(clash, F.least(confidence, F.lit(0.4))).otherwise(confidence).alias("confidence"))


def place_edge(predicate: Column, confidence: Column, closed: Column, needs_review: Column) -> Column:
    """struct(reviewable, rank, priority) of an edge between places."""
    inner = predicate.isin("inside_place_candidate", "within_region_candidate")
    at, near = predicate == "same_event_place_context", predicate == "nearby_time_place_context"
    conf = F.coalesce(confidence, F.lit(0.0))
    open_ = ~closed & F.when(inner, F.lit(True)).when(at, conf >= 0.6).when(near, conf >= 0.56).otherwise(needs_review)
    rank = F.when(predicate == "inside_place_candidate", 4).when(inner, 3).when(at, 2).when(near, 1).otherwise(0)
    return F.struct(open_.alias("reviewable"), rank.alias("rank"), F.when(inner, 70).when(at, 48).when(near, 40).otherwise(42).alias("priority"))


def crop_weight(min_side: Column, sharpness: Column, brightness: Column) -> Column:
    """0 to 1: the root of the side's place between 24 and 112 pixels, halved by blur (full at 60), lowered by light outside 30 to 225."""
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    light = F.when(brightness < 30, F.greatest(F.lit(0.2), brightness / 30)).when(brightness > 225, F.greatest(F.lit(0.2), (255 - brightness) / 225)).otherwise(1.0)
    return unit(F.sqrt(unit((min_side - 24) / 88.0)) * (0.5 + 0.5 * unit(sharpness / 60.0)) * light)


def relation_confidence(basis: Column, evidence: Column) -> Column:
    """Its basis, and 0.04 a piece of evidence beyond the first, three at most; none costs 0.04; 0.9 at most."""
    return F.round(F.least(F.lit(0.9), F.coalesce(lookup(RELATION_BASES, basis), F.lit(0.58)) + F.least(evidence - 1, F.lit(3)) * 0.04), 2)


def reconciliation(status: Column, anchor: Column, rejected: Column, names_rejected: Column, relocated: Column, support: Column) -> Column:
    """struct(title_status, status, confidence): whether an event is retitled by its local context, needs evidence, loses places or stands.

    anchor: the best context anchor's confidence, null without one; rejected: rejected places;
    names_rejected: the title names one; relocated: other ranges were found; support: the alignment's score, or the event's.
    """
    say = lambda title, state, c: F.struct(F.lit(title).alias("title_status"), F.lit(state).alias("status"), F.round(c, 3).alias("confidence"))
    s = F.coalesce(support, F.lit(0.0))
    clamp = lambda top: F.greatest(F.lit(0.5), F.least(F.lit(top), s))
    retitle = anchor.isNotNull() & ((status == "possible_misaligned") | names_rejected)
    found = F.least(F.lit(0.95), anchor + F.when(rejected > 0, 0.08).otherwise(0.0) + F.when(relocated, 0.06).otherwise(0.0))
    return F.when(retitle, say("retitled", "corrected", found)).when(status == "model_only", say("unverified", "needs_evidence", F.least(F.lit(0.45), s))).when(rejected > 0, say("places_filtered", "metadata_corrected", clamp(0.9))).otherwise(say("supported", "accepted", clamp(0.95)))


def unit_cost(units: dict[str, Column], rates: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """id, cost of rows by their units' first known rate (key, unit, direct, per_1k, per_1m); null where no unit has one. rates is a price list, at most a row a unit and key."""
    u = rows.select("id", key, F.explode(F.array(*[F.struct(F.lit(n).alias("unit"), c.cast("double").alias("amount")) for n, c in units.items()])).alias("u")).select("id", key, "u.*")
    j = u.join(rates, [key, "unit"], "left")
    cost = F.coalesce(F.col("amount") * F.col("direct"), F.col("amount") / 1e3 * F.col("per_1k"), F.col("amount") / 1e6 * F.col("per_1m"))
    return j.groupBy("id").agg(F.round(F.sum(cost), 8).alias("cost"))


def promotions(candidates: DataFrame, existing: DataFrame, key: str, share: float = 0.5, bucket: float = 600.0) -> DataFrame:
    """id, outcome of second-opinion events: known (half of either lies on an event, or no length), backlog below 0.7, review below 0.9, promoted."""
    j = iv.interval_join(candidates.where("e > s"), existing, key, bucket, strict=True)
    part = F.least("l.e", "r.e") - F.greatest("l.s", "r.s")
    on = (part / (F.col("l.e") - F.col("l.s")) >= share) | (part / F.greatest(F.col("r.e") - F.col("r.s"), F.lit(0.001)) >= share)
    known = j.where(on).select(F.col("l.id").alias("id")).distinct().withColumn("known", F.lit(True))
    d = candidates.join(known, "id", "left")
    outcome = F.when(F.col("known") | ~(F.col("e") > F.col("s")), "known").when(F.col("conf") < 0.7, "backlog").when(F.col("conf") < 0.9, "review").otherwise("promoted")
    return d.select("id", outcome.alias("outcome"))


def adjusted(events: DataFrame, layers: list[tuple[str, DataFrame]]) -> DataFrame:
    """events (id, s, e) with the first layer's change (id, s, e, needs_review) to each: `basis` names it; a layer without a range keeps the event's."""
    whole = None
    for k, (name, d) in enumerate(layers):
        d = d.select("id", F.struct(F.lit(k).alias("layer"), F.lit(name).alias("basis"), F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e"), F.col("needs_review").alias("needs_review")).alias("a"))
        whole = d if whole is None else whole.unionByName(d)
    first = whole.groupBy("id").agg(F.min("a").alias("a"))
    rest = [c for c in events.columns if c not in ("id", "s", "e")]
    return events.join(first, "id", "left").select("id", F.coalesce("a.s", "s").alias("s"), F.coalesce("a.e", "e").alias("e"), *rest, F.col("a.basis").alias("basis"), F.coalesce("a.needs_review", F.lit(False)).alias("needs_review"))


def judged(items: DataFrame, annotations: DataFrame) -> DataFrame:
    """task (null: all), total, scored, score and one column a judgment, of annotations (id, judgment) on items (id, task); unknown words count as not_sure."""
    word = F.regexp_replace(F.lower(F.trim(F.coalesce("judgment", F.lit("")))), "[- ]", "_")
    known = [*JUDGMENT_SCORES, *OPEN_JUDGMENTS]
    j = annotations.select("id", F.when(word.isin(known), word).otherwise("not_sure").alias("judgment")).join(items.select("id", "task"), "id")
    score = lookup(JUDGMENT_SCORES, F.col("judgment"))
    g = j.withColumn("score", score).groupingSets([["task"], []], "task").agg(F.count("*").alias("total"), F.count("score").alias("scored"), F.round(F.avg("score"), 6).alias("score"), *[F.count_if(F.col("judgment") == k).alias(k) for k in known])
    return g


def packet(items: DataFrame, k: int = 200) -> DataFrame:
    """The first k items (task, s, id) by task, time and id, numbered: the size of a packet for reviewers."""
    place = F.coalesce(lookup({t: i for i, t in enumerate(TASK_ORDER)}, F.col("task")), F.lit(99))
    order = [place.asc(), F.asc_nulls_last("s"), F.asc("id")]
    top = items.withColumn("place", place).orderBy("place", F.asc_nulls_last("s"), "id").limit(k)
    # k rows at most: the numbering is one small task
    return top.withColumn("number", F.row_number().over(Window.orderBy(*order))).drop("place")


def review_tiers(items: DataFrame, primary: Column, group: str) -> DataFrame:
    """items (priority, conf, s, title) with tier and their place in it within each group: priority, least confidence (unknown: 1), time, title, id."""
    d = items.withColumn("tier", F.when(primary, "primary").otherwise("backlog"))
    w = Window.partitionBy(group, "tier").orderBy(F.desc("priority"), F.coalesce("conf", F.lit(1.0)), F.asc_nulls_last("s"), F.lower("title"), "id")
    return d.withColumn("place", F.row_number().over(w))


def speaker_candidates(signals: DataFrame, speaker: str, person: str, least: float = 0.28, k: int = 5) -> DataFrame:
    """The k likeliest persons of each speaker, from signals (weight, source, event, segment).

    The strongest weight, 0.12 of all (0.18 at most), 0.02 an event and 0.004 a segment (0.08 at most each);
    0.72 at most without a self-identification or a role bridge, 0.68 by voice alone; within 0.05 to 0.94.
    """
    strong = F.col("source").isin("self_identification_phrase", "role_identity_bridge")
    g = signals.groupBy(speaker, person).agg(F.max("weight").alias("top"), F.sum("weight").alias("total"), F.count_distinct("event").alias("events"), F.count_distinct("segment").alias("segments"), F.bool_or(strong).alias("strong"), F.bool_and(F.startswith("source", F.lit("voice_bucket"))).alias("voice"))
    raw = F.col("top") + F.least(F.lit(0.18), F.col("total") * 0.12) + F.least(F.lit(0.08), F.col("events") * 0.02) + F.least(F.lit(0.08), F.col("segments") * 0.004)
    cap = F.when(F.col("voice"), 0.68).when(~F.col("strong"), 0.72).otherwise(0.94)
    g = g.withColumn("confidence", F.round(F.greatest(F.lit(0.05), F.least(cap, raw)), 6)).where(F.col("confidence") >= least)
    place = F.row_number().over(Window.partitionBy(speaker).orderBy(F.desc("confidence"), person))
    return g.withColumn("place", place).where(F.col("place") <= k).select(speaker, person, "confidence", "place")


def best_crops(crops: DataFrame, person: str, path: str, floor: float = 0.45, k: int = 3) -> DataFrame:
    """The k best crops of each person: attribution times quality, a path once."""
    d = crops.where(F.col("quality") >= floor).groupBy(person, path).agg(F.max(F.round(F.col("attribution") * F.col("quality"), 4)).alias("score"))
    return d.withColumn("place", F.row_number().over(Window.partitionBy(person).orderBy(F.desc("score"), path))).where(F.col("place") <= k)


def distinct_albums(albums: DataFrame, members: DataFrame, kind: str) -> DataFrame:
    """One album (id, kind, cover, unreviewed, conf) of each kind and set of member events (id, event): with a cover, unreviewed, of most confidence, of least id; albums without members stay."""
    one = members.where("event is not null").select("id", "event").distinct()
    # the set's digest: its size, and two sums over the hashes of its members, so no set is collected
    sign = one.groupBy("id").agg(F.struct(F.count("*"), F.sum(F.xxhash64("event").cast("decimal(38,0)")), F.sum(F.xxhash64("event", F.lit(7)).cast("decimal(38,0)"))).alias("sign"))
    d = albums.join(sign, "id", "left")
    alone = F.when(F.col("sign").isNull(), F.col("id"))
    rank = F.struct(F.col("cover").isNotNull(), F.col("unreviewed"), F.coalesce("conf", F.lit(0.0)), -F.col("id"))
    return d.groupBy(F.when(F.col("sign").isNotNull(), F.col(kind)).alias(kind), "sign", alone.alias("alone")).agg(F.max_by("id", rank).alias("id"), F.count("*").alias("n")).select("id", "n")


def cited_events(events: DataFrame, cites: DataFrame, evidence: DataFrame) -> DataFrame:
    """events (id, s, e) with the extent of the known evidence (evidence_id, s, e, kind) that they cite (id, evidence_id) and its number.

    Events all of whose known evidence is non-content go; those without any keep their own range; an end before its start becomes the start.
    """
    known = cites.distinct().join(evidence.select("evidence_id", F.col("s").alias("x"), F.col("e").alias("y"), "kind"), "evidence_id")
    g = known.groupBy("id").agg(F.min("x").alias("x"), F.max(F.coalesce("y", "x")).alias("y"), F.count("*").alias("n"), F.bool_and(F.col("kind") == "non_content_range").alias("blank"))
    d = events.join(g, "id", "left").where(~F.coalesce("blank", F.lit(False)))
    s = F.coalesce("x", "s")
    return d.select("id", s.alias("s"), F.greatest(F.coalesce("y", "e"), s).alias("e"), F.coalesce("n", F.lit(0)).alias("n"))


def enriched(cites: DataFrame, claims: DataFrame, claim_cites: DataFrame, fields: dict[str, str]) -> DataFrame:
    """id, field, value, first: values of the claims (claim, predicate, value) that share evidence with an event, by the field their predicate feeds; first is the least claim."""
    c = claims.withColumn("field", lookup(fields, F.col("predicate"))).where("field is not null and value is not null")
    pairs = cites.distinct().join(claim_cites.distinct(), "evidence_id").select("id", "claim").distinct()
    return pairs.join(c, "claim").groupBy("id", "field", "value").agg(F.min("claim").alias("first"))


def evidence_union(modalities: dict[str, DataFrame]) -> DataFrame:
    """kind, source_id, media, s, e, text of all modalities (id, media, s, e, text), with an id made of kind and source, the same in every run."""
    whole = None
    for kind, d in modalities.items():
        d = d.select(F.lit(kind).alias("kind"), F.col("id").alias("source_id"), "media", "s", "e", "text")
        whole = d if whole is None else whole.unionByName(d)
    return whole.withColumn("evidence_id", F.concat_ws("_", "kind", F.lpad(F.col("source_id").cast("string"), 12, "0")))


def redirected(rows: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """rows with `column` sent on by resolved moves (src, dst)."""
    to = moves.select(F.col("src").alias(column), F.col("dst").alias("sent_to"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("sent_to", column)).drop("sent_to")


def absent(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not held yet, one a key, the least of all its columns: what a backfill adds."""
    names = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.min(F.struct(*names)).alias("row")).select(key, "row.*")
    return one.join(held.select(key).distinct(), key, "left_anti")


def salience(text: Column, patterns: dict[str, tuple[str, float]], named: Column, child: Column) -> Column:
    """Sum of the points of the patterns found, 1 for a named speaker, 1.5 for a child, 0.75 for a short exclamation, -2 for filler (two different words at most, or a quarter of digits)."""
    words = F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f]+"), F.lit(0))
    score = named.cast("int") * 1.0 + child.cast("int") * 1.5
    for pattern, points in patterns.values():
        score = score + F.when(text.rlike(pattern), points).otherwise(0.0)
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    filler = (F.size(F.array_distinct(F.transform(words, lambda w: F.lower(w)))) <= 2) | (digits > F.length(text) / 4)
    score = score + F.when(text.rlike(r"![ \t\n\r\f]*$") & (F.size(words) <= 10), 0.75).otherwise(0.0)
    return F.round(score + F.when(filler, -2.0).otherwise(0.0), 3)


def weighted_centroids(rows: DataFrame, key: str, vector: str, weight: str) -> DataFrame:
    """key, dim, x: the weighted mean of each key's vectors, scaled to length 1; weights of zero or less take no part, nor does a mean of zero."""
    d = rows.where(F.col(weight) > 0).select(key, F.posexplode(vector).alias("dim", "x"), F.col(weight).alias("w"))
    g = d.groupBy(key, "dim").agg((F.sum(F.col("x").cast("double") * F.col("w"))).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return g.withColumn("norm", norm).where("norm > 0").select(key, "dim", (F.col("x") / F.col("norm")).alias("x"))


def keywords(texts: DataFrame, key: str, text: str, stop: list[str], k: int = 4) -> DataFrame:
    """key, word, score, place: the k words of three letters and more of most (occurrences + 2 where capital inside a sentence) times idf over the key's texts (id), each different text once; ties to the word."""
    one = texts.groupBy(key, F.col(text).alias("t")).agg(F.min("id").alias("id"))
    n = one.groupBy(key).agg(F.count("*").alias("n"))
    found = one.select(key, "id", F.explode(F.regexp_extract_all("t", F.lit(r"(?:^|[^\p{L}])\p{L}{3,}"), F.lit(0))).alias("hit"))
    found = found.withColumn("word", F.lower(F.regexp_extract("hit", r"(\p{L}+)", 1)))
    proper = F.col("hit").rlike(r"^[^.!?\n\p{L}]\p{Lu}")
    w = found.where(~F.col("word").isin(stop)).groupBy(key, "word").agg((F.count("*") + 2 * F.count_if(proper)).alias("tf"), F.count_distinct("id").alias("df"))
    w = w.join(n, key).withColumn("score", F.round(F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 0.01), 6))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "word"))
    return w.withColumn("place", place).where(F.col("place") <= k).select(key, "word", "score", "place")

"""Scenes, turns, loops, continuity segments and chunk timelines: ordered rules as windows over (key, s, e) relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv

BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, 0)


def scenes(cuts: DataFrame, spans: DataFrame, ends: DataFrame, key: str, least: float = 1.0) -> DataFrame:
    """key, s, e, label, pieces: scenes of [0, duration], label null for content.

    cuts: key, t; spans: key, s, e, label, disjoint; ends: key, duration. Every cut, span end and end
    of the whole is a boundary. A content piece shorter than `least` goes to the scene before it, or,
    at the head of a run of content, to the next until they reach `least`; touching spans of one label
    are one scene. Cuts outside the duration and keys without one give nothing.
    """
    inner = cuts.join(ends, key).where("t > 0 and t < duration").select(key, "t")
    edges = inner.union(spans.select(key, "s")).union(spans.select(key, "e")).union(ends.select(key, F.lit(0.0))).union(ends.select(key, "duration")).distinct()
    w = Window.partitionBy(key)
    pieces = edges.select(key, F.col("t").alias("s"), F.lead("t").over(w.orderBy("t")).alias("e")).where("e > s")
    near = iv.as_of(pieces, spans, key, "s", ["e", "label"])
    p = near.select(key, "s", "e", F.when(F.col("near.e") > (F.col("s") + F.col("e")) / 2, F.col("near.label")).alias("label"))
    order = w.orderBy("s")
    first = (F.row_number().over(order) == 1) | F.col("prev").isNotNull()
    p = p.withColumn("prev", F.lag("label").over(order)).withColumn("head", F.col("label").isNull() & first)
    p = p.withColumn("run", F.last(F.when(F.col("head"), F.col("s")), ignorenulls=True).over(order.rowsBetween(*SO_FAR)))
    content = F.col("head") | ((F.col("e") - F.col("s") >= least) & (F.col("s") - F.col("run") >= least))
    opens = F.when(F.col("label").isNull(), content).otherwise(F.col("prev").isNull() | (F.col("prev") != F.col("label")))
    p = p.withColumn("scene", F.sum(opens.cast("int")).over(order.rowsBetween(*SO_FAR)))
    return p.groupBy(key, "scene").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.first("label").alias("label"), F.count("*").alias("pieces")).drop("scene")


def owned_by_part(rows: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """The rows (key, part, s, e) whose middle lies in their part's own zone: parts (key, part, s, e) share an overlap half and half, and the last one has no end."""
    w = Window.partitionBy(key).orderBy("part")
    before, after = F.lag("e").over(w), F.lead("s").over(w)
    zones = parts.select(key, "part", F.when(before.isNull(), F.col("s")).otherwise(F.col("s") + (before - F.col("s")) / 2).alias("lo"), F.when(after.isNotNull(), after + (F.col("e") - after) / 2).alias("hi"))
    middle = (F.col("s") + F.col("e")) / 2
    return rows.join(zones, [key, "part"]).where((middle >= F.col("lo")) & (F.col("hi").isNull() | (middle < F.col("hi")))).drop("lo", "hi")


def stride_sample(rows: DataFrame, key: str, stride: float = 10.0) -> DataFrame:
    """key, bucket, id: of the rows whose middle lies in one stride the longest, the earliest and then least id of equals; rows without a length go."""
    bucket = F.floor((F.col("s") + F.col("e")) / 2 / stride)
    best = F.max_by("id", F.struct(F.col("e") - F.col("s"), -F.col("s"), -F.col("id")))
    return rows.where("e > s").groupBy(key, bucket.alias("bucket")).agg(best.alias("id"))


def turns(rows: DataFrame, key: str, label: str, gap: float = 1.5) -> DataFrame:
    """key, label, s, e, n, confidence: neighbours of one label within `gap` of all that went before are one turn.

    The confidence is the mean of the turn so far and the next row, row by row, whose closed form
    weighs the last row 1/2, the one before 1/4, and so on: sums, and nothing is collected.
    """
    d = iv.islands(rows, key, ["s", "id"], F.col(label) == F.lag(label).over(Window.partitionBy(key).orderBy("s", "id"))).withColumnRenamed("island", "run")
    w = Window.partitionBy(key, "run").orderBy("s", "id")
    reach = F.max("e").over(w.rowsBetween(*BEFORE))
    d = d.withColumn("opens", F.when(reach.isNull() | (F.col("s") - reach > gap), 1).otherwise(0))
    d = d.withColumn("turn", F.sum("opens").over(w.rowsBetween(*SO_FAR)))
    back = F.row_number().over(Window.partitionBy(key, "run", "turn").orderBy(F.desc("s"), F.desc("id")))
    d = d.withColumn("weight", F.pow(F.lit(0.5), F.when(F.col("opens") == 1, back - 1).otherwise(back)))
    g = d.groupBy(key, "run", "turn").agg(F.first(label).alias(label), F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"), F.sum(F.coalesce("conf", F.lit(0.0)) * F.col("weight")).alias("confidence"))
    return g.drop("run", "turn")


def without_loops(lines: DataFrame, key: str, text: str, within: float = 120.0) -> DataFrame:
    """Lines (s, id) but those said `within` seconds after the same words, kept or not; letters, digits and _ count, case does not; lines without words or a start go."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))
    d = lines.withColumn("said", words).where("said <> '' and s is not null")
    before = F.lag("s").over(Window.partitionBy(key, "said").orderBy("s", "id"))
    return d.withColumn("before", before).where(F.col("before").isNull() | (F.col("s") - F.col("before") >= within)).drop("said", "before")


def continued_lines(lines: DataFrame, key: str, stream: str, text: str) -> DataFrame:
    """lines with `whole`: a line that begins in lower case follows the last line of its stream, if that is one of the six before it and ends 3 s before to 0.5 s after its start."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("s", "id"))
    own = Window.partitionBy(key, stream).orderBy("place")
    d = lines.withColumn("place", place).withColumn("prev", F.lag(F.struct("place", "e", text)).over(own))
    wait, line = F.col("s") - F.col("prev.e"), F.trim(text)
    joins = line.rlike(r"^\p{Ll}") & (F.col("place") - F.col("prev.place") <= 6) & (wait >= -0.5) & (wait <= 3.0)
    return d.withColumn("whole", F.when(joins, F.concat_ws(" ", F.trim(F.col("prev")[text]), line)).otherwise(line)).drop("place", "prev")


def continuity(events: DataFrame, spans: DataFrame, key: str, least: float = 120.0, bucket: float = 600.0) -> DataFrame:
    """key, id, segment, reason: segments of one flow, and why each but the first was cut off.

    events: key, id, s, e, region, year, language. Reasons, the first that holds: a span (key, s, e) of
    `least` seconds or more within the gap, another region, another year, another language; what is
    unknown on either side gives none.
    """
    w = Window.partitionBy(key).orderBy("s", "id")
    d = events.select(key, "id", "s", *[F.lag(c).over(w).alias(f"p_{c}") for c in ("e", "region", "year", "language")], "region", "year", "language")
    gaps = d.where("p_e <= s").select(key, "id", F.col("p_e").alias("s"), F.col("s").alias("e"))
    long = spans.where(F.col("e") - F.col("s") >= least).select(key, "s", "e")
    held = iv.interval_join(gaps, long, key, bucket).where("r.s >= l.s and r.e <= l.e").select(F.col("l.id").alias("id")).distinct()
    d = d.join(held.withColumn("held", F.lit(True)), "id", "left")
    reason = F.when(F.col("held"), "gap").when(F.col("region") != F.col("p_region"), "region").when(F.abs(F.col("year") - F.col("p_year")) >= 1, "year").when(F.col("language") != F.col("p_language"), "language")
    d = d.withColumn("reason", reason)
    return d.select(key, "id", (1 + F.sum(F.col("reason").isNotNull().cast("int")).over(w.rowsBetween(*SO_FAR))).alias("segment"), "reason")


def placed_intervals(rows: DataFrame, walls: DataFrame, key: str, bucket: float = 600.0) -> DataFrame:
    """id, s, e, notes of chunk rows (key, id, s, e, offset, local, duration) on their source's clock.

    Reversed and half-known ranges are put right, ends are cut to the chunk's own length (`local`, if
    known) and the source's, and before the first wall (key, s, e, label) that begins inside; rows that
    begin in a wall or past the source go. A row without any time lies at its offset.
    """
    a, b = F.coalesce("s", "e"), F.coalesce("e", "s")
    d = rows.withColumn("unknown", a.isNull()).withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))
    d = d.withColumn("chunk_cut", F.coalesce(F.col("hi") > F.col("local"), F.lit(False)))
    d = d.withColumn("hi", F.when(F.col("chunk_cut"), F.col("local")).otherwise(F.col("hi")) + F.col("offset")).withColumn("lo", F.col("lo") + F.col("offset"))
    d = d.where(F.col("unknown") | (F.col("lo") < F.col("duration")))
    d = d.withColumn("source_cut", F.coalesce(F.col("hi") > F.col("duration"), F.lit(False))).withColumn("hi", F.when(F.col("source_cut"), F.col("duration")).otherwise(F.col("hi")))
    timed = d.where(~F.col("unknown")).select(key, "id", F.col("lo").alias("s"), F.col("hi").alias("e"))
    met = iv.interval_join(timed.where("s <= e"), walls, key, bucket)
    inside = (F.col("l.s") >= F.col("r.s")) & (F.col("l.s") < F.col("r.e"))
    ahead = (F.col("l.s") < F.col("r.s")) & (F.col("r.s") < F.col("l.e"))
    wall = met.groupBy(F.col("l.id").alias("id")).agg(F.bool_or(inside).alias("gone"), F.min(F.when(ahead, F.struct(F.col("r.s").alias("s"), F.col("r.label").alias("label")))).alias("wall"))
    d = d.join(wall, "id", "left").where(F.col("unknown") | (~F.coalesce("gone", F.lit(False)) & (F.coalesce("wall.s", "hi") >= F.col("lo"))))
    notes = F.concat_ws("+", F.when(F.col("unknown"), "no_time"), F.when(F.col("chunk_cut"), "chunk_end"), F.when(F.col("source_cut"), "source_end"), F.concat(F.lit("before_"), F.col("wall.label")))
    return d.select("id", F.coalesce("lo", "offset").alias("s"), F.coalesce("wall.s", "hi", "offset").alias("e"), notes.alias("notes"))


def chunk_scales(items: DataFrame, chunk: str, is_event: Column, local: str, slack: float = 1.05) -> DataFrame:
    """chunk, scale, basis of items (s, e): what their seconds are to be multiplied by.

    Three events or more that all end in the first tenth of `local`: minutes, if sixty times the
    largest time fits, else `unreliable`. Times beyond `local` by more than `slack` are shrunk onto it.
    """
    top = F.greatest("s", "e")
    g = items.groupBy(chunk).agg(F.max(local).alias("local"), F.max(top).alias("top"), F.count_if(is_event & F.col("e").isNotNull()).alias("n"), F.max(F.when(is_event, F.col("e"))).alias("last"))
    early = (F.col("n") >= 3) & (F.col("last") < F.col("local") / 10)
    minutes = early & (F.col("top") * 60 <= F.col("local") * slack)
    reach = F.col("top") * F.when(minutes, 60.0).otherwise(1.0)
    over = reach > F.col("local") * slack
    scale = F.when(minutes, 60.0).otherwise(1.0) * F.when(over, F.col("local") / reach).otherwise(1.0)
    basis = F.concat_ws("+", F.when(minutes, "minutes").when(early, "unreliable"), F.when(over, "overrun"))
    return g.where("local > 0 and top > 0").select(chunk, scale.alias("scale"), basis.alias("basis"))


def timing_suspect(duration: Column, n: Column, last: Column) -> Column:
    """Whether three events or more of half an hour or more all lie in its first 12 % and ten minutes."""
    return F.coalesce((duration >= 1800) & (n >= 3) & (last > 0) & (last < F.least(duration * 0.12, F.lit(600.0))), F.lit(False))


def content_spans(blank: DataFrame, ends: DataFrame, key: str, gap: float = 15.0, least: float = 10.0) -> DataFrame:
    """key, s, e: what the merged blank spans leave of [0, duration], joined over gaps of `gap`; spans of `least` seconds, or the longest where there is none."""
    w = Window.partitionBy(key)
    edges = blank.select(key, "s", "e").union(ends.select(key, F.lit(0.0), F.lit(0.0))).union(ends.select(key, "duration", "duration"))
    left = iv.merge_intervals(iv.complement(iv.merge_intervals(edges, key), key), key, gap).withColumn("long", F.col("e") - F.col("s"))
    left = left.withColumn("any", F.max("long").over(w) >= least).withColumn("rank", F.row_number().over(w.orderBy(F.desc("long"), "s")))
    return left.where((F.col("long") >= least) | (~F.col("any") & (F.col("rank") == 1))).select(key, "s", "e")


def year_winners(votes: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """key, year, place, split: the place of most weight by its votes' bases (1 for others), the least name of equals, and whether others had votes."""
    weight = F.coalesce(F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])[F.col("basis")], F.lit(1.0))
    tally = votes.where("place is not null").groupBy(key, "year", "place").agg(F.sum(weight).alias("weight"))
    return tally.groupBy(key, "year").agg(F.min_by("place", F.struct(-F.col("weight"), "place")).alias("place"), (F.count("*") > 1).cast("int").alias("split"))


def eras(winners: DataFrame, key: str, until: int | None = None) -> DataFrame:
    """key, place, first_year, last_year, conflicts, extended: years of one place at most two apart are one era; the last of a key lasts to `until`, if that is later."""
    w = Window.partitionBy(key).orderBy("year")
    flow = (F.col("place") == F.lag("place").over(w)) & (F.col("year") - F.lag("year").over(w) <= 2)
    g = iv.islands(winners, key, ["year"], flow).groupBy(key, "island").agg(F.first("place").alias("place"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.sum("split").alias("conflicts"))
    last = F.col("island") == F.max("island").over(Window.partitionBy(key))
    extended = last & (F.lit(until) > F.col("last_year")) if until is not None else F.lit(False)
    return g.withColumn("extended", extended).select(key, "place", "first_year", F.when(F.col("extended"), F.lit(until)).otherwise(F.col("last_year")).alias("last_year"), "conflicts", "extended")

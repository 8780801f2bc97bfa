"""Column helpers whose rules silently change answers: absent values, order, ties, closed ends, text keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sample contents; callers pass their own.
STOPWORDS = ("the", "and", "of", "to", "in", "is", "that", "for", "with", "on", "de", "la", "le", "et", "que")


def falsy_coalesce(*columns: Column) -> Column:
    """The first value that is neither null nor zero nor empty."""
    return F.coalesce(*[F.when((c.cast("string") != "") & (F.coalesce(c.try_cast("double"), F.lit(1.0)) != 0), c) for c in columns])


def number_or_null(c: Column) -> Column:
    return c.try_cast("double")


def exact_sum(c: Column) -> Column:
    """The sum of doubles of ten decimals at most, whatever their order; any others are added as doubles."""
    d = c.try_cast("decimal(28,10)")
    exact = F.bool_and(F.coalesce(d.cast("double") == c, c.isNull()))
    return F.coalesce(F.when(exact, F.try_sum(d).cast("double")), F.sum(c))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column, closed: bool = True) -> Column:
    return (a_start <= b_end) & (a_end >= b_start) if closed else (a_start < b_end) & (a_end > b_start)


def overlap_seconds(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0.0))


def overlaps_enough(s: Column, e: Column, xs: Column, xe: Column, share: float = 0.5) -> Column:
    """Zero-length rows by containment, others by an overlapping share or a start inside the exclusion."""
    inside = (s >= xs) & (s <= xe)
    return F.when(e <= s, inside).otherwise((overlap_seconds(s, e, xs, xe) / (e - s) >= share) | inside)


def light_stem(t: Column) -> Column:
    n = F.length(t)
    cut = lambda k: F.substring(t, 1, n - k)
    return F.when(t.endswith("ing") & (n > 6), cut(3)).when(t.endswith("ed") & (n > 5), cut(2)).when(t.endswith("ies") & (n > 6), F.concat(cut(3), F.lit("y"))).when(t.endswith("s") & (n > 4), cut(1)).otherwise(t)


def terms(text: Column, stopwords=STOPWORDS) -> Column:
    """Words of a text as search terms: longer than one letter, no stop word, not all digits, stemmed; repeats kept."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_']+)"), F.lit(1))
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stopwords) & ~w.rlike(r"^[0-9]+$"))
    return F.transform(kept, light_stem)


def normalize_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}]+", " "))


def spelling_key(c: Column) -> Column:
    """Entity names that sound alike share a key: ph as f, doubled letters once, ia as ya, ie as y."""
    k = F.regexp_replace(normalize_key(c), "ph", "f")
    k = F.regexp_replace(k, r"([b-df-hj-np-tv-z])\1", "$1")
    return F.regexp_replace(F.regexp_replace(k, "ia", "ya"), "ie", "y")


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(h))


def bbox_iou(a: Column, b: Column) -> Column:
    """Intersection over union of structs x, y, width, height."""
    side = lambda o, n: F.greatest(F.least(a[o] + a[n], b[o] + b[n]) - F.greatest(a[o], b[o]), F.lit(0.0))
    inter = side("x", "width") * side("y", "height")
    union = a["width"] * a["height"] + b["width"] * b["height"] - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def parse_clock(c: Column) -> Column:
    """Seconds of h:m:s, m:s or s, with a comma or point for decimals; anything else is 0."""
    parts = F.transform(F.split(F.replace(F.trim(c), F.lit(","), F.lit(".")), ":"), lambda p: p.try_cast("double"))
    return F.coalesce(F.when(F.size(parts) <= 3, F.aggregate(parts, F.lit(0.0), lambda acc, p: acc * 60 + p)), F.lit(0.0))


def range_label(s: Column, e: Column) -> Column:
    def clock(x: Column) -> Column:
        n = F.floor(x).cast("int")
        h, m, r = (n / 3600).cast("int"), F.pmod((n / 60).cast("int"), F.lit(60)), F.pmod(n, F.lit(60))
        return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))

    return F.when(s.isNull(), "unknown time").otherwise(F.concat(clock(s), F.lit("-"), clock(F.coalesce(e, s))))


def snippet(text: Column, needle: Column, size: int = 220, back: int = 70) -> Column:
    at = F.instr(F.lower(text), F.lower(needle))
    start = F.greatest(at - back, F.lit(1))
    body = F.substring(text, start, F.lit(size))
    return F.concat(F.when(start > 1, "...").otherwise(""), body, F.when(start + size - 1 < F.length(text), "...").otherwise(""))


#: Fixed: months by their first three letters.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def parse_date(text: Column) -> Column:
    """struct(precision, year, iso): a day in ISO form or by its month's name, else a year of 1800-2099, else a decade, else unknown."""
    day = F.regexp_extract(text, r"\b((?:18|19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]))\b", 1)
    named = lambda k: F.regexp_extract(F.lower(text), r"\b(" + "|".join(MONTHS) + r")[a-z]*\.? (\d{1,2})(?:st|nd|rd|th)?,? ((?:18|19|20)\d\d)\b", k)
    month = F.lit("")
    for k, name in enumerate(MONTHS):
        month = F.when(named(1) == name, f"{k + 1:02d}").otherwise(month)
    written = F.when((named(1) != "") & named(2).try_cast("int").between(1, 31), F.concat_ws("-", named(3), month, F.lpad(named(2), 2, "0"))).otherwise("")
    day = F.when(day != "", day).otherwise(written)
    year = F.regexp_extract(text, r"\b((?:18|19|20)\d\d)\b", 1)
    decade = F.regexp_extract(text, r"\b(\d0)s\b", 1)
    d = decade.try_cast("int")
    made = lambda precision, y, iso: F.struct(F.lit(precision).alias("precision"), y.cast("int").alias("year"), iso.cast("string").alias("iso"))
    none = F.lit(None)
    found = F.when(day != "", made("day", F.substring(day, 1, 4), day)).when(year != "", made("year", year, none))
    return found.when(decade != "", made("decade", F.when(d >= 30, 1900 + d).otherwise(2000 + d), none)).otherwise(made("unknown", none, none))


def parse_exif_date(c: Column) -> Column:
    """ISO text of YYYY:MM:DD with an optional time; null where a part of the date is zero."""
    part = lambda k: F.regexp_extract(c, r"^(\d{4}):(\d\d):(\d\d)(?: (\d\d:\d\d:\d\d))?", k)
    fine = (part(1) != "") & (part(1) != "0000") & (part(2) != "00") & (part(3) != "00")
    day = F.concat_ws("-", part(1), part(2), part(3))
    return F.when(fine, F.when(part(4) != "", F.concat(day, F.lit("T"), part(4))).otherwise(day))

"""Readers: JSON lines under a schema, subtitles, diarisation, tolerant JSON; and quarantine of bad spans."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME = re.compile(r"(\S+)\s*-->\s*(\S+)")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """A JSON-lines artifact; a missing path is an empty relation, a malformed line raises or, if not strict, is dropped."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def append_jsonl(d: DataFrame, path: str) -> None:
    d.write.mode("append").json(path)


def seconds(clock: str) -> float:
    """h:m:s, m:s or s with a comma or point; anything else is 0."""
    total = 0.0
    parts = clock.strip().replace(",", ".").split(":")
    if len(parts) > 3:
        return 0.0
    for p in parts:
        try:
            total = total * 60 + float(p)
        except ValueError:
            return 0.0
    return total


def subtitle_cues(text: str | None) -> list[tuple[float, float, str]]:
    """Cues of SRT or VTT text: a timing line, then lines without tags; lines of digits alone are counters."""
    out = []
    for block in re.split(r"\n\s*\n", (text or "").replace("\r", "")):
        lines = block.split("\n")
        for i, line in enumerate(lines):
            if m := TIME.search(line):
                body = " ".join(x for x in (re.sub(r"<[^>]*>", "", y).strip() for y in lines[i + 1 :]) if x and not x.isdigit())
                if body:
                    out.append((seconds(m[1]), seconds(m[2]), body))
                break
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("s", T.DoubleType()), T.StructField("e", T.DoubleType()), T.StructField("text", T.StringType())])))
def cues_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"s": s, "e": e, "text": x} for s, e, x in subtitle_cues(t)], na_action=None)


def subtitles(files: DataFrame, text: str = "value") -> DataFrame:
    """One row per cue of files read with wholetext."""
    return files.select("*", F.inline(cues_of(F.col(text)))).drop(text)


def rttm(lines: DataFrame, line: str = "value") -> DataFrame:
    """SPEAKER rows with eight fields or more: media, start, end, label."""
    f = F.split(F.trim(line), r"\s+")
    rows = lines.where(~F.col(line).startswith("#")).withColumn("f", f).where((F.size("f") >= 8) & (F.col("f")[0] == "SPEAKER"))
    s = F.col("f")[3].try_cast("double")
    return rows.select(F.col("f")[1].alias("media"), s.alias("s"), (s + F.col("f")[4].try_cast("double")).alias("e"), F.col("f")[7].alias("label"))


def span_faults(clock: Column, s: Column, e: Column, duration: Column, slack: float = 0.001) -> Column:
    """Why a span is rejected, or null; spans are never clamped."""
    return (
        F.when(~F.coalesce(clock.isin("source", "chunk", "capture"), F.lit(False)), "unknown clock")
        .when(s.isNull() | e.isNull() | F.isnan(s) | F.isnan(e), "not a number")
        .when((s < 0) | (e < 0), "negative")
        .when(e < s, "reversed")
        .when(e > duration + slack, "beyond its media")
    )


#: A whole string, and the bare clock value that may follow it as a key.
CLOCK = re.compile(r'("(?:[^"\\]|\\.)*")(?:(\s*:\s*)(\d+(?::\d\d){1,2})(?=\s*[,}\]]))?')


def clock_seconds(m: re.Match) -> str:
    return m[0] if m[3] is None else f"{m[1]}{m[2]}{seconds(m[3]):g}"


def salvage_json(text: str | None) -> str | None:
    """The JSON object in a model's answer; where it does not parse, bare clock values are made numbers and a cut tail is closed."""
    if not text or "{" not in text:
        return None
    body = re.sub(r"```\w*", "", text) if "```" in text else text
    body = body[body.index("{") :] if "{" in body else text[text.index("{") :]
    for attempt in (lambda: body, lambda: CLOCK.sub(clock_seconds, body)):
        try:
            return json.dumps(json.JSONDecoder().raw_decode(attempt())[0], sort_keys=True)
        except ValueError:
            pass
    body = CLOCK.sub(clock_seconds, body)
    ends, stack, quoted, skip = [], [], False, False
    for i, c in enumerate(body):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
            ends.append((i + 1, "".join(reversed(stack))))
        elif c == ",":
            ends.append((i, "".join(reversed(stack))))
    for at, tail in reversed(ends):
        try:
            return json.dumps(json.loads(body[:at] + tail), sort_keys=True)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def salvaged(text: pd.Series) -> pd.Series:
    return text.map(salvage_json, na_action=None)


def text_encoder(encode, dimension: int):
    """A column function from an injected callable list[str] -> list[vector]; the callable is loaded once a worker."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([list(map(float, v))[:dimension] for v in encode(part.fillna("").tolist())])

    return F.pandas_udf(run, T.ArrayType(T.FloatType()))

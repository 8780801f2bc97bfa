"""The eleven queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, html, jaccard, langid, packing, quality, repeats, tokens, toxicity
from .common import Workspace, ship, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def id_crc(column: str, modulus: int):
    """crc32 of an id written as text, modulo a small number; a null id counts as no remainder of the contract's."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


def with_labels(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """Documents of at most `rows` labels, first by digest of their ids: few enough to be sent to every task, so no text is shuffled."""
    few = labels.where(F.col(label).isNotNull()).select("doc_id", label).orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id", label).limit(rows)
    return docs.join(F.broadcast(few), "doc_id")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are sources, paths their languages; every fifth id by crc32 is held out of learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    held_out = id_crc("doc_id", 5) == 0
    labelled = with_labels(docs.select("doc_id", "text").where(~held_out), table(spark, sf_dir, "labels").where(~held_out), "quality", quality.MAX_ROWS)
    out = quality.quality(docs, labelled, F.col("source"), F.col("lang"), Workspace(spark, "op1"))
    return out.withColumn("held_out", held_out).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents"), Workspace(spark, "op2"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tokens.token_counts(docs, vocabulary("word_bpe_49k.json"), Workspace(spark, "op3"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_crc("doc_id", 4) == 2
    samples = langid.sample(docs.where(~held_out))
    out = docs.select("doc_id", held_out.alias("held_out"), langid.language_column(F.col("text"), samples).alias("s"))
    return out.select("doc_id", "held_out", F.col("s.lang").alias("lang_pred"), "s.score")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    out = repeats.remove_repeats(docs, Workspace(spark, "op5"))
    return out.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html.main_text_column(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_crc("doc_id", 3) == 1
    rows = toxicity.sample(with_labels(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out), "toxic", toxicity.MAX_ROWS))
    out = docs.select("doc_id", held_out.alias("held_out"), toxicity.score_column(F.col("text"), rows).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.scan(docs, table(spark, sf_dir, "benchmark"), Workspace(spark, "op8"), out="s")
    ids = F.array_join(F.array_sort(F.transform("s.items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "s.n_words", "s.n_hit", F.size("s.items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), decontam.is_contaminated(F.col("s")).alias("contaminated"))


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index = ann.PermutationIndex(vectors, Workspace(spark, "op9"))
    return index.search(vectors.where("vec_id % 20 = 0"), 20)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _shipped(f: Callable) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    query.__name__, query.__doc__ = f.__name__, f.__doc__
    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: _shipped(f) for f in (op1_quality_classifier, op2_ngram_jaccard_join, op3_token_counts, op4_language_id, op5_suffix_array_dedup, op6_html_extraction, op7_toxicity, op8_benchmark_decontamination, op9_permutation_index, op10_packing)}


#: Words of the decontamination contract, and its windows, over whole tables.
OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[p : p + 12], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS p FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, p, array_to_string(ws[p : p + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, sizes WHERE len(ws) >= n)),
h AS (SELECT doc_id, dw.n, p, item_id FROM dw JOIN iw USING (n, k)),
hits AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM h)) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_benchmark_decontamination": OP8_SQL}

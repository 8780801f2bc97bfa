"""Corpus cleaning, end to end: each stage writes Parquet that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import decontam, jaccard, langid, packing, queries, repeats
from skein.llm.common import Workspace, fresh, ship, table

#: Words a shingle of the near-duplicate stage, and its least similarity; op2's are the operator's defaults.
NEAR_WIDTH, NEAR_LEAST = 5, (80, 100)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart, with `lang` the language that the operator predicts.

    Null and empty texts and those without a letter go. If no language could be learned, only they
    go and `lang` stays. Repeated rows stay; an empty table gives none; other columns pass.
    """
    ship(spark)
    samples = langid.sample(docs.where(queries.id_crc("doc_id", 4) != 2))
    if not samples:
        return docs.where(langid.has_letter(F.col("text")))
    mark = fresh(docs, "found_language")
    marked = docs.withColumn(mark, langid.language_column(F.col("text"), samples))
    return marked.where(F.col(f"{mark}.lang") != langid.UNKNOWN).withColumn("lang", F.col(f"{mark}.lang")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of the Jaccard join of five words and 0.8.

    Rows that agree in id and text are one document, of which one row stays; rows of one id with
    different texts, and rows without an id, are documents of their own, told apart by a digest of
    id and text. Null ids go before none: a class keeps its least id, and a null id only where it has
    no other. Null and empty texts are linked with nothing; an empty table gives none; other columns pass.
    """
    ship(spark)
    work, key, n = Workspace(spark, "near"), fresh(docs, "row_key"), fresh(docs, "row_number")
    own = F.xxhash64("doc_id", "text")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(n)).where(F.col(n) > 1).select("doc_id")
    simple = not repeated.limit(1).count() and not docs.where("doc_id is null").limit(1).count()
    if simple:
        keyed = docs.withColumn(key, F.col("doc_id"))
    else:
        named = docs.where("doc_id is not null").join(repeated.withColumn(n, F.lit(1)), "doc_id", "left")
        keyed = named.withColumn(key, F.when(F.col(n).isNull(), F.col("doc_id")).otherwise(own)).drop(n).unionByName(docs.where("doc_id is null").withColumn(key, own))
    classes = jaccard.jaccard_classes(keyed, work, NEAR_LEAST, NEAR_WIDTH, doc_id=key)
    if simple:
        stay = classes.where("doc_id = component_id").select(F.col("doc_id").alias(key))
        return keyed.join(stay, key, "left_semi").select(docs.columns)
    ids = keyed.select(F.col(key).alias("k"), F.col("doc_id").alias("id")).distinct()
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "k"))
    stay = classes.select(F.col("doc_id").alias("k"), "component_id").distinct().join(ids, "k").groupBy("component_id").agg(first.alias("s")).select(F.col("s.k").alias(key))
    kept = keyed.join(stay, key, "left_semi")
    order = Window.partitionBy(key).orderBy(*(c for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant")))
    return kept.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).select(docs.columns)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated byte strings, cut back to whole characters; texts left blank by that go.

    A null text stays; rows that are repeated whole remove each other; other columns pass.
    """
    ship(spark)
    extra = [c for c in docs.columns if c in ("kept", "kept_text", "spans")]
    own = {c: fresh(docs, f"own_{c}") for c in extra}
    cut = repeats.remove_repeats(docs.withColumnsRenamed(own), Workspace(spark, "repeats"))
    whole = F.size("spans") == 0
    text = F.when(whole, F.col("text")).otherwise(F.col("kept_text"))
    cut = cut.withColumn("text", F.when(F.col("text").isNotNull(), text)).where(whole | (F.trim("text") != ""))
    cut = cut.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return cut.drop("kept", "kept_text", "spans").withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in twenty lies in a benchmark window.

    Null and empty texts have no words and stay, as do repeated rows; other columns pass.
    """
    ship(spark)
    scan = fresh(docs, "benchmark_scan")
    marked = decontam.scan(docs, table(spark, sf_dir, "benchmark"), Workspace(spark, "decontaminated"), out=scan)
    return marked.where(~decontam.is_contaminated(F.col(scan))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of power-of-two lengths, with their ids."""
    ship(spark)
    return packing.pack(docs, queries.vocabulary("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_text", repeated_text), ("decontaminated", decontaminated), ("packed", packed)]

#: Stages 1, 3 and 5 have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        work.release()
    return docs

"""Search index as three relations (postings, norms, statistics) and the scorers over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.semantics import STOPWORDS, terms


@dataclass
class Index:
    postings: DataFrame  # id, term, tf, weight
    norms: DataFrame  # id, norm, length
    stats: DataFrame  # term, df, idf
    documents: int


def build_index(docs: DataFrame, stopwords=STOPWORDS) -> Index:
    """id, text -> TF-IDF index: idf = ln((1+N)/(1+df))+1, weight = (1+ln tf) * idf."""
    n = docs.count()
    tf = docs.select("id", F.explode(terms(F.col("text"), stopwords)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    stats = tf.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.ln((1.0 + n) / (1.0 + F.col("df"))) + 1)
    postings = tf.join(stats.select("term", "idf"), "term").select("id", "term", "tf", ((1 + F.ln("tf")) * F.col("idf")).alias("weight"))
    norms = postings.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), F.sum("tf").alias("length"))
    return Index(postings, norms, stats, n)


def write_index(index: Index, path: str) -> None:
    """The index as Parquet, postings in order of their terms, so that a query reads the row groups of its own terms only."""
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/postings")
    index.stats.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/stats")
    index.norms.write.parquet(f"{path}/norms")
    index.stats.sparkSession.createDataFrame([(index.documents,)], "documents long").write.parquet(f"{path}/size")


def read_index(spark: SparkSession, path: str, only: DataFrame | None = None) -> Index:
    """A written index; with a query's terms (see `query_terms`) the part of it that they need."""
    postings, stats = (spark.read.parquet(f"{path}/{n}") for n in ("postings", "stats"))
    if only is not None:
        wanted = [r["term"] for r in only.select("term").collect()]
        postings, stats = postings.where(F.col("term").isin(wanted)), stats.where(F.col("term").isin(wanted))
    return Index(postings, spark.read.parquet(f"{path}/norms"), stats, spark.read.parquet(f"{path}/size").first()["documents"])


def query_terms(spark: SparkSession, text: str, stopwords=STOPWORDS) -> DataFrame:
    """The query's terms and counts; a query is one row, so this side is small by construction."""
    return spark.createDataFrame([(text,)], "text string").select(F.explode(terms(F.col("text"), stopwords)).alias("term")).groupBy("term").agg(F.count("*").alias("qtf"))


def tfidf_scores(index: Index, query: DataFrame) -> DataFrame:
    """Cosine of query and documents; terms that no document has count in the query's norm with weight 1 each."""
    q = query.join(index.stats, "term", "left").select("term", ((1 + F.ln("qtf")) * F.coalesce("idf", F.lit(1.0))).alias("qw"))
    norm = q.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    dots = index.postings.join(F.broadcast(q), "term").groupBy("id").agg(F.sum(F.col("weight") * F.col("qw")).alias("dot"))
    return dots.join(index.norms, "id").join(F.broadcast(norm)).select("id", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))


def bm25_scores(index: Index, query: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    mean = index.norms.agg(F.avg("length").alias("mean"))
    hit = index.postings.join(F.broadcast(query.select("term")), "term").join(index.stats.select("term", "df"), "term").join(index.norms.select("id", "length"), "id").join(F.broadcast(mean))
    idf = F.ln((index.documents - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return hit.groupBy("id").agg(F.sum(part).alias("score"))


def top(scores: DataFrame, k: int, by: str = "score") -> DataFrame:
    return scores.orderBy(F.desc(by), "id").limit(k)


def hybrid(dense: DataFrame, sparse: DataFrame, rank: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """dense + 0.8 sparse + 0.35 text rank + 0.25 for the query as a substring."""
    parts = [(dense, 1.0), (sparse, 0.8), (rank, 0.35), (exact, 0.25)]
    whole = None
    for d, w in parts:
        d = d.select("id", (F.col("score") * w).alias("score"))
        whole = d if whole is None else whole.unionByName(d)
    return top(whole.groupBy("id").agg(F.sum("score").alias("score")), k)


def similar(index: Index, anchor: int, k: int) -> DataFrame:
    """More like a document: cosine over its own terms, itself left out."""
    mine = index.postings.where(F.col("id") == anchor).select("term", F.col("weight").alias("w"))
    dots = index.postings.where(F.col("id") != anchor).join(mine, "term").groupBy("id").agg(F.sum(F.col("weight") * F.col("w")).alias("dot"))
    own = index.norms.where(F.col("id") == anchor).select(F.col("norm").alias("own"))
    return top(dots.join(index.norms, "id").join(F.broadcast(own)).select("id", (F.col("dot") / (F.col("norm") * F.col("own"))).alias("score")), k)


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def sectioned(scores: DataFrame, section: str, k: int) -> DataFrame:
    w = Window.partitionBy(section).orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

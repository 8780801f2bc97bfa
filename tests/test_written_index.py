"""A written search index gives what the one in the plan gives."""

from pyspark.sql import functions as F

from skein.operators import search
from skein.plans import archive

SF = "/root/testdata/sf0.001"


def test_written_index_scores_alike(spark, tmp_path):
    index = search.build_index(archive.corpus(spark, SF))
    search.write_index(index, str(tmp_path / "i"))
    q = search.query_terms(spark, "idiot licensed under apache license version")
    again = search.read_index(spark, str(tmp_path / "i"), q)
    assert again.documents == index.documents
    for scores in (search.tfidf_scores, search.bm25_scores):
        a, b = ({r["id"]: r.s for r in scores(i, q).select("id", F.round("score", 9).alias("s")).collect()} for i in (index, again))
        assert a == b and a

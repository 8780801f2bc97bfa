"""subtitle_cues reads whole conversation texts."""

from skein.plans import archive


def test_whole_texts_reach_the_reader(spark, tmp_path):
    long = "word " * 500 + "end"
    rows = [(1, 0, "u", long), (1, 1, "u", "one\n\ntwo\r\n \r\n42\nthree " + long), (2, 0, "u", None), (2, 1, "u", "short")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): " ".join(r.text.split()) for r in archive.QUERIES["subtitle_cues"](spark, str(tmp_path)).collect()}
    assert got == {(i, t): " ".join(x.split()) for i, t, _, x in rows if x}


def test_given_texts_reach_the_reader(spark):
    sf = "/root/testdata/sf0.001"
    want = {(r.conv_id, r.turn): " ".join(r.text.split()) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect() if (r.text or "").strip()}
    got = {(r.conv_id, r.turn): " ".join(r.text.split()) for r in archive.QUERIES["subtitle_cues"](spark, sf).collect()}
    assert got == want

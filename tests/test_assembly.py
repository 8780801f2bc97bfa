"""Every assembly query against DuckDB, none of them on nothing, and the rules on rows made by hand."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.operators import assembly as asm
from skein.operators import corrections as cor
from skein.operators import identity as idn
from skein.plans import assembly

from .test_archive import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(assembly.SQL))
def test_oracle(spark, duck, name):
    got, want = assembly.QUERIES[name](spark, SF).toPandas(), duck.execute(assembly.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(want)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rules(spark):
    lit = F.lit
    assert tuple(one(spark, asm.normalised_range(lit(None).cast("double"), lit(4.0)))) == (4.0, 4.0)
    assert one(spark, asm.chunk_to_source(lit(5.0), lit(130.0), lit(10.0), lit(120.0))) is None
    assert one(spark, asm.frame_class(lit(10.0), lit(3.0), lit(0), lit(0), lit(0))) == "black"
    assert tuple(one(spark, asm.clip(lit(100.0), lit(500.0), lit(1000.0)))) == (240.0, 360.0)
    words = lambda t: F.array(*[lit(w) for w in t.split()]) if t else F.array().cast("array<string>")
    assert one(spark, asm.keyword_verdict(words("a b c"), words("a x y"))) == "supported"
    assert one(spark, asm.keyword_verdict(words("a b c"), words("u v w x y z"))) == "contradicted"
    assert one(spark, idn.name_score(lit("Philippa Marria"), lit("Filipa Marya"))) == 0.92 and one(spark, idn.name_score(lit("Anna"), lit("Boris"))) == 0.0
    east = idn.parse_region(lit("Springfield, Ohio"), {"ohio": "USA"})
    assert tuple(one(spark, east)) == ("Springfield", "Ohio", "USA")
    west = idn.parse_region(lit("Portland, Oregon"), {"oregon": "USA"})
    assert one(spark, idn.regions_apart(east, west, lit(None).cast("double"))) is True
    assert one(spark, cor.block_reason(lit("add_relationship"), lit(0.9), lit(0.5), lit(False), lit(1))) == "one witness"


def test_nearest_label_prefers_the_later_of_equally_near(spark):
    rows_ = spark.createDataFrame([(1, 1, 10.0), (2, 1, 0.0), (3, 1, 99.0), (4, 2, 1.0)], "id long, media long, s double")
    anchors = spark.createDataFrame([(1, 5.0, "a", 0.9), (1, 15.0, "b", 0.8)], "media long, s double, label string, conf double")
    got = {r.id: r.near_label for r in asm.nearest_label(rows_, anchors, "media", "s", "label", "conf").collect()}
    assert got == {1: "b", 2: "a", 3: "b"}

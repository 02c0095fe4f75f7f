"""What passes through the driver, and how often texts are cut into words."""

from pyspark.sql import functions as F

from inkwell.operators import bm25
from inkwell.plans.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_larger_sides_of_joins_stay_out_of_the_driver(spark):
    few, many = bm25.small(spark.range(100)), bm25.small(spark.range(30_000))
    wide = bm25.small(spark.range(1_000).select("id", F.repeat(F.lit("x"), F.lit(10_000)).alias("text")))
    assert "LocalRelation" in plan(few)
    assert "LocalRelation" not in plan(many) and "LocalRelation" not in plan(wide)
    assert (few.count(), many.count(), wide.count()) == (100, 30_000, 1_000)


def test_index_terms_read_texts_once_without_a_cache(spark, sf_dir):
    made = plan(QUERIES["r2_index_terms"](spark, sf_dir))
    # one scan for each of the two fields
    assert "InMemoryRelation" not in made and made.count("inline(") <= 2 and "Join Inner" not in made

"""How jobs are laid out: what filters hold, how rows are dealt."""

from pyspark.sql import functions as F

from requestlab.operators import normalize
from requestlab.plans import tables


def test_filters_do_not_inline_what_makes_a_request(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/ids")
    made = F.concat(F.lit("GET /marker"), F.col("id").cast("string"), F.lit(" HTTP/1.1\nHost: a.b"))
    df = spark.read.parquet(f"{tmp_path}/ids").select(F.col("id").alias("request_id"), made.alias("request"))
    got = normalize.extract_flags(normalize.normalize_requests(df).where("error IS NULL"), keys=("request_id",))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # once in each branch; a filter with it would repeat it
    assert plan.count("GET /marker") == 2
    assert not [x for x in plan.splitlines() if "Filter" in x and "GET /marker" in x]
    assert got.count() > 0


def test_rows_are_dealt_whatever_the_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "DEALT", 100)
    spark.range(2000).coalesce(1).write.parquet(f"{tmp_path}/one")
    df = tables.spread(spark.read.parquet(f"{tmp_path}/one"))
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 200 and sum(sizes) == 2000

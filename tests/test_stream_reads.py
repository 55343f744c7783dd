"""How often a stream's rows are worked on."""

from requestlab.plans import tables
from requestlab.streaming import streams


def test_flag_rate_job_reads_a_batch_once(spark, tmp_path):
    rows = tables.requests(spark, "/root/testdata/sf0.001").limit(50)
    spark.createDataFrame(rows.collect(), rows.schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    once = streams.stream_normalize(stream).where("error IS NULL")
    names = ["ts", "flags", "path_flags", "params", "qsep", "headers"]
    once = once.select("request_id", *names).mapInPandas(count, once.select("request_id", *names).schema)
    streams.flag_rate_job(once, f"{tmp_path}/out").awaitTermination()
    assert seen.value == spark.read.parquet(f"{tmp_path}/in").where("request_id % 97 <> 0").count()

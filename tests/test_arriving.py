"""Parts of a stream are written by all tasks, and a compile folds once."""

from pyspark.sql import functions as F

from tessera.operators import compile as K
from tessera.plans import versions as V
from tessera.streaming import families as S
from tessera.streaming.ingest import shared_path


def test_a_part_is_written_by_many_tasks(spark):
    df = spark.range(1000, numPartitions=8).withColumnRenamed("id", "n")
    path = shared_path(spark, "arriving")
    sizes = [spark.read.parquet(path).count() for _ in S.arriving(df, F.col("n"), 2, path)]
    assert sizes == [500, 1000]
    assert len(spark.read.parquet(path).inputFiles()) > 2


def test_a_second_compile_reads_what_the_first_wrote(spark):
    _, late = V.compiled(spark, "/root/testdata/sf0.001")
    plan = late.claims._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
    assert K.CLAIM_COLUMNS == late.changed.columns

"""Tables played as streams: files in, a stateful query, files out, all in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoa.session import scratch, written


def replayed(rows: DataFrame, query: Callable[[DataFrame], DataFrame], name: str, runs: int = 1, mode: str = "append", batches: int = 1) -> DataFrame:
    """What ``query`` gives for ``rows`` as a stream; ``runs`` over one set of checkpoints take each file once.

    With more ``batches`` the rows come in order of ``ts``, that many files one after the other.
    """
    spark = rows.sparkSession
    home = scratch(spark, f"stream-{name}")
    if batches == 1:
        rows.write.parquet(f"{home}/in")
    else:
        dealt = written(rows.repartitionByRange(batches, "ts").withColumn("_turn", F.spark_partition_id()), "turns")
        for k in range(batches):
            dealt.where(F.col("_turn") == k).drop("_turn").coalesce(1).write.mode("append").parquet(f"{home}/in")
    for _ in range(runs):
        made = query(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1 if batches > 1 else 10_000).parquet(f"{home}/in"))
        run = made.writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/marks").outputMode(mode).trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{home}/out")

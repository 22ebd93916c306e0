"""Gapless positions in a total order, without a global sort in one task.

Rows are dealt by ranges of the order, sorted inside each range and written once with their range and place in it; the
rows of the ranges before are a prefix sum over one count a range. A range is an equal share of the rows, whatever
the values, as the order must tell all rows apart (end it with a key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import unique_dir

POSITION = "position"


def with_position(df: DataFrame, *order: Column, name: str = POSITION, ranges: int | None = None) -> DataFrame:
    """``df`` with its 1-based position in ``order``. The rows come back range by range, each range in order, so
    files written from it follow the order, too."""
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_range"), place.alias("_place"))
    path = unique_dir(spark, "ordered")
    dealt.write.parquet(path)  # written: ranges are drawn from a sample, so a second run might draw others
    rows = spark.read.schema(dealt.schema).parquet(path)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = counts.select(F.col("_range"), before.alias("_begin"))
    return (rows.join(F.broadcast(begins), "_range").withColumn(name, (F.col("_begin") + F.col("_place") + 1).cast("bigint"))
            .drop("_range", "_place", "_begin"))

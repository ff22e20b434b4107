"""Row numbers and running sums over a whole key without bringing the key into one task: rows are range-partitioned, written, and counted by part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.session import shared_folder, written


def running(rows: DataFrame, keys: list[str], order: list, value: str | None, out: str, folder: str | None = None) -> DataFrame:
    """rows with out: the sum of `value` (1 for None: a row number from 1) over the rows of the same keys up to and with each, by `order`.

    Only one sum for each key and part is put in order over a whole key. Order ties must be broken by the caller."""
    folder = folder or shared_folder(rows.sparkSession)
    made = rows.withColumn("value_", F.lit(1).cast("long") if value is None else F.col(value))
    for k, c in enumerate(order):
        made = made.withColumn(f"order{k}_", c if not isinstance(c, str) else F.col(c))
    names = [f"order{k}_" for k in range(len(order))]
    parts = written(made.repartitionByRange(*keys, *names).withColumn("part_", F.spark_partition_id()), folder, f"ranges-{out}")
    sums = parts.groupBy(*keys, "part_").agg(F.sum("value_").alias("sum_"))
    before = F.coalesce(F.sum("sum_").over(Window.partitionBy(*keys).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*keys, "part_", before.alias("before_"))
    own = F.sum("value_").over(Window.partitionBy(*keys, "part_").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("own_", own).join(offsets, [*keys, "part_"]).select(*rows.columns, (F.col("own_") + F.col("before_")).alias(out))

"""Places in a total order over tables of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut_lineage


def placed(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """rows with their place from 1 in an order that has no ties.

    Rows are dealt out by ranges of the order and numbered within each, on top
    of the sizes of the ranges before; only those sizes, one number a
    partition, are ever in one task.
    """
    ranged = cut_lineage(cut_lineage(rows).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    nth = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_nth", nth).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")

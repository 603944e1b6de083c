"""Contiguous shards of near equal bytes from global prefix sums.

Rows are ordered by (doc_id, crc32 of the text); nulls come first.  The order
is made by a range exchange of ids, sizes and checksums only - never of texts.
Each partition's totals (a row a partition) give every partition its starting
offset; inside a partition a running sum gives every row its global offset, and
a row belongs to the shard in whose equal target its middle byte lies.  Shards
are therefore contiguous in doc_id and differ by at most about one row's size.

Nulls: a null text has no bytes (size 16, crc32 of nothing); a null doc_id sorts
first.  Repeated rows are rows like any other; ties are broken by checksum and
then arbitrarily among rows that are equal anyway.  Empty tables give no rows.
Only doc_id and text are read, so extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.shared import table, written

ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, global offset of every document."""
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(data).cast("long") + F.lit(ROW_BYTES)).alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.repartitionByRange(parts, "doc_id", "text_crc32").withColumn("part", F.spark_partition_id()), "shard-order")

    # a row a partition: its totals, and what lies before it
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy("doc_id", "text_crc32")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({"sum_in": F.sum("size").over(upto), "row_in": F.row_number().over(inside)})
    global_ = local.join(F.broadcast(starts), "part").select(
        "doc_id", "size", "text_crc32",
        (F.col("bytes_before") + F.col("sum_in") - F.col("size")).alias("offset"),
        (F.col("rows_before") + F.col("row_in") - 1).alias("ordinal"),
        "total",
    )
    middle = F.col("offset").cast("decimal(38,0)") * 2 + F.col("size")
    shard = F.floor(middle * F.lit(shards) / (F.col("total").cast("decimal(38,0)") * 2)).cast("int")
    cut = written(global_.withColumn("shard", F.least(shard, F.lit(shards - 1))).drop("total"), "shard-cut")
    first = cut.groupBy("shard").agg(F.min("ordinal").alias("first"))  # at most a row a shard
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("ordinal") - F.col("first")).alias("slot"), "offset"
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of near equal bytes; `law` is `bytes`."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# text_crc32 has no counterpart in DuckDB; the rest of the law is tested against brute force.
ORACLE_SQL: dict[str, str] = {}

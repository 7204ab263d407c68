"""Operator 4: contiguous byte-balanced shards, in DataFrame functions only.

Rows are ordered by id.  A range partitioning of narrow rows (id, size, checksum)
is written once, so that every row keeps its partition; partition totals are a
row each, their running sum is where a partition begins, and a window inside
the partition adds the row's own place.  The cuts stand at equal targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, table, unused


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row.

    size is the text's UTF-8 bytes plus 1 (a null text has none).  Rows lie in the
    order (id, checksum, size); rows that agree in all three are alike, so which
    one comes first does not matter.  A row goes where the middle of its bytes
    falls, so a shard's bytes differ from the mean by at most one text at either
    end.  slot counts from 0 in each shard.  A null id comes first; a text that
    is larger than a shard takes one to itself and may leave others empty; no
    rows give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(_text(text_col)) + F.lit(1)).cast("long").alias("size"), F.crc32(_text(text_col).cast("binary")).alias("text_crc32"))
    parted = materialize(narrow.repartitionByRange("doc_id", "text_crc32", "size").withColumn("part", F.spark_partition_id()), "parts")
    totals = parted.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    total = totals.agg(F.sum("part_bytes")).first()[0] or 1
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition, no more
    starts = totals.select("part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parted.withColumns({"upto": F.sum("size").over(inside), "nth": F.count("*").over(inside)}).join(starts, "part")
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / F.lit(2 * total).cast("decimal(38,0)"))).cast("int")
    placed = placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("nth"))
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first")).alias("slot"))  # firsts: a row a shard


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as Parquet under path, a folder shard=N each, all columns kept; rows carry their slot."""
    names = unused(docs, "_id", "_crc", "_size", "_nth")
    key = names[:3]
    same = Window.partitionBy(*key).orderBy(F.lit(0))
    plan = shard_by_bytes(docs, shards, id_col, text_col).toDF(key[0], key[2], key[1], "shard", "slot").withColumn(names[3], F.row_number().over(same))
    keyed = docs.withColumns(dict(zip(key, (F.col(id_col), F.crc32(_text(text_col).cast("binary")), (F.octet_length(_text(text_col)) + F.lit(1)).cast("long")), strict=True))).withColumn(names[3], F.row_number().over(same))
    on = [keyed[c].eqNullSafe(plan[c]) for c in names]
    keep = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    keyed.join(plan, on).select(*[keyed[c] for c in keep], plan.shard, plan.slot).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes; a null text counts as empty."""
    placed = shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

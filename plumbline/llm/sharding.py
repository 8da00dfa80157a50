"""Sharding (operator 2): a Feistel permutation with cycle walking over global row numbers.

Every row gets its number in the order of (id, CRC-32 and size of the text): a range partitioning of the narrow rows
is written to the shared folder, and the sizes of its partitions (one row each) give the first number of every
partition. A keyed four-round Feistel network permutes the smallest even-bit domain that holds all numbers; a result
beyond the last number is permuted again until it falls inside (under four times on average). Position p goes to
shard p mod n, slot p div n. So shard and slot of a row number can be computed anywhere from the seed and the number
of rows alone, shards differ by one row at most (law `rows`), and the same input is shuffled the same way again.

Null texts have size 1 and the CRC-32 of the empty text. Null ids come first; repeated rows are rows of their own. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from plumbline.llm.byte_words import mixed
from plumbline.sources.storage import scratch_path

ROUNDS = 4


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The places of the row numbers (0 to n - 1) in the shuffled order: a bijection on 0 to n - 1."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = mixed(np.uint64(seed % 2**64) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for key in keys:
            left, right = right, left ^ (mixed(right ^ key) & mask)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def numbered(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """The narrow rows with their numbers from 0 on in the order of the columns, and how many there are."""
    spark = rows.sparkSession
    path = scratch_path(spark, "numbered")
    rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.schema(StructType([*rows.schema, StructField("__part", IntegerType())])).parquet(path)
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))  # one row for each written partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("__part", before.alias("__first"))
    number = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    out = placed.withColumn(name, number).join(F.broadcast(first), "__part").withColumn(name, F.col(name) + F.col("__first"))
    return out.drop("__part", "__first"), placed.count()


def shards(docs: DataFrame, n_shards: int = 8, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, row_number, position, shard, slot) of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows, total = numbered(narrow, ["id", "text_crc32", "size"], "row_number")
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = permute(batch.column("row_number").to_numpy(zero_copy_only=False), total, seed)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place), pa.array((place % n_shards).astype(np.int32)), pa.array(place // n_shards)],
                names=[id_col, "size", "text_crc32", "row_number", "position", "shard", "slot"],
            )

    fields = f"`{id_col}` {kind}, size long, text_crc32 long, row_number long, position long, shard int, slot long"
    return rows.select("id", "size", "text_crc32", F.col("row_number").cast("long")).mapInArrow(run, fields)

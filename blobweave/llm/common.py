"""Small helpers shared by the operators: reading tables, cutting lineage, batching."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch as Scratch
from ..session import ship

#: Text bytes that a Python kernel handles at once. A longer single text is one block of its own.
BLOCK_BYTES = 1 << 20
#: A key with more than this share (inverse) of all rows is heavy. There are fewer heavy keys than this number, so they
#: can be broadcast, and each is dealt into parts of this share at most.
HEAVY = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def blocks(batches, column: str = "text", limit: int = BLOCK_BYTES):
    """Slices Arrow batches so that ``column`` holds at most ``limit`` bytes in a slice, or one row."""
    for batch in batches:
        col = batch.column(column)
        n = len(col)
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i in range(n):
            if i > start and held + sizes[i] > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(sizes[i])
        yield batch.slice(start, n - start)


def heavy_keys(sizes: DataFrame, on: list[str], total: int) -> DataFrame:
    """The keys of sizes (on, n) with more than a share of total rows, and how many parts each is dealt into."""
    return sizes.where(F.col("n") * HEAVY > total).select(*on, F.ceil(F.col("n") * HEAVY / F.lit(max(1, total))).cast("int").alias("_parts"))


def join_split(rows: DataFrame, table: DataFrame, on: str | list[str], sizes: DataFrame | None = None, heavy: DataFrame | None = None, hashed: bool = False) -> DataFrame:
    """The inner join of rows with a table of one row for each key, without sending a heavy key's rows to one task.

    sizes (on, n): how many rows a key has, as a table that is cheap to read; else they are counted, unless the heavy keys are given.
    Heavy keys are dealt by a hash of the row into parts, and the table's row is repeated for each part. With ``hashed`` the table is the much
    shorter one: a task holds its part of it in memory, and neither is sorted.
    """
    on = [on] if isinstance(on, str) else on
    if heavy is None:
        sizes = sizes if sizes is not None else rows.groupBy(*on).agg(F.count("*").alias("n"))
        heavy = heavy_keys(sizes, on, sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    heavy = F.broadcast(heavy)
    dealt = rows.join(heavy, on, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int"))).drop("_parts")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    table = table.join(heavy, on, "left").withColumn("_part", parts).drop("_parts")
    return dealt.join(table.hint("shuffle_hash") if hashed else table, [*on, "_part"]).drop("_part")


def by_key(rows: DataFrame, table: DataFrame, key: str, name: str) -> DataFrame:
    """rows, left-joined with a table whose key column is ``name``; rows with a null key have no match and are not shuffled."""
    none = table.schema.fields
    met = rows.where(F.col(key).isNotNull()).join(table, F.col(key) == F.col(name), "left").drop(name)
    alone = rows.where(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in none if f.name != name])
    return met.union(alone)

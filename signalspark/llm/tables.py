"""Tables in the shared folder: they cut lineage and outlive any executor."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signalspark.context import fresh_path


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the cluster's shared folder; return it as read back, and its path.

    No shuffle file of the query that makes it stays.
    """
    spark = df.sparkSession
    path = fresh_path(spark, f"llm-{name}")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete stored tables that no later step reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a filter of hashes, at any size of input (8 MB).
FILTER_BITS = 1 << 26


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """A bit per hash of the one long column, as unsigned 32-bit words; its size is fixed."""
    bit = F.pmod(F.col(hashes.columns[0]), F.lit(FILTER_BITS))
    got = (
        hashes.select(F.shiftright(bit, 5).cast("int").alias("word"), (bit % 32).cast("int").alias("bit"))
        .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    )
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return out


def listed_in(hashes: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Tells in tasks which hashes the filter of the one long column lets pass."""
    shared = hashes.sparkSession.sparkContext.broadcast(bit_filter(hashes))

    def listed(values: np.ndarray) -> np.ndarray:
        bit = values % FILTER_BITS
        return (shared.value[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).astype(bool)

    return listed


def keep_rows(documents: DataFrame, found: DataFrame, doc_id: str, key: Column, name: str) -> DataFrame:
    """The rows of ``documents`` that ``found`` (doc_id, ``name``, kept) keeps, with all their columns.

    ``key`` computes ``name`` from a row of ``documents``; id and key name the
    rows.  Where an id and key occur several times in ``found`` and one of them is
    kept, one row stays; rows that ``found`` leaves out stay.  Only rows that go or repeat are listed.  A filter of fixed size
    lets all others pass where they are read: only rows that may be listed are shuffled.
    """
    pair = found.groupBy("doc_id", name).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    odd, _ = store(pair.filter("not kept or n > 1").select(F.struct("doc_id", F.col(name).alias("key")).alias("_pair"), "kept"), "odd")
    names = [f"c{i}" for i in range(len(documents.columns))]
    x = documents.withColumn("_pair", F.struct(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), key.alias("key")))
    x = x.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(documents.columns, names, strict=True)], "_pair")
    shared = documents.sparkSession.sparkContext.broadcast(bit_filter(odd.select(F.xxhash64("_pair"))))

    @F.pandas_udf("boolean")
    def listed(h: pd.Series) -> pd.Series:
        bit = h.to_numpy() % FILTER_BITS
        return pd.Series((shared.value[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).astype(bool))

    maybe = x.filter(listed(F.xxhash64("_pair")))
    out = x.filter(~listed(F.xxhash64("_pair"))).select(*names)
    out = out.unionByName(maybe.join(odd, "_pair", "left_anti").select(*names))
    repeated = odd.filter("kept")
    if not repeated.isEmpty():
        out = out.unionByName(maybe.join(repeated, "_pair", "left_semi").dropDuplicates(["_pair"]).select(*names))
    return out.toDF(*documents.columns)

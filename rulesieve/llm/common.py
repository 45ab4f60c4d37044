"""What the operators share: scratch tables, words, Arrow helpers, components."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Hashable, Iterator
from types import SimpleNamespace
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulesieve.session import scratch_path

#: Entries after which a cache inside a task is emptied; bounds its memory.
CACHE_ENTRIES = 300_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the folder of ``spark.checkpoint.dir`` and read back.

    This cuts the lineage with a copy that outlives executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python in Arrow batches of at most 8 MB and 2,000 rows.

    An executor holds a batch for every running task, on both sides.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text, under the names ``id`` and ``text``."""
    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))


def fold(id_column: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(folds))


def per_process(key: Hashable, make: Callable[[], Any]) -> Any:
    """``make()``, called once in a Python worker.

    Functions come to executors by value, so what their module holds is new in
    every task; a worker runs many tasks.
    """
    kept = sys.modules.setdefault("rulesieve_kept", SimpleNamespace(values={})).values
    if key not in kept:
        kept[key] = make()
    return kept[key]


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def batches(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``size``."""
    for batch in rows:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def give_back() -> None:
    """Free memory that this Python worker still holds goes back to the system.

    A worker lives on after its task, and what Arrow and the C library keep for
    it is lost to the executor's other tasks.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim is not None:
        trim(0)


def by_bytes(rows: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of a text column, one row at least and 500 at most.

    What is free when a batch is done goes back to the system.
    """
    for batch in rows:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for at, size in enumerate(sizes.tolist()):
            if at > start and (held + size > limit or at - start >= 500):
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch
        give_back()


class WordHashes(dict):
    """64-bit hashes of words as eight bytes each, remembered for a while."""

    def __init__(self, seed: int = 0, entries: int = CACHE_ENTRIES // 2):
        self.seed, self.entries = seed, entries

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.entries:
            self.clear()
        value = xxhash.xxh64_intdigest(word, self.seed).to_bytes(8, "little")
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(node, component)`` for every node of the undirected ``edges(u, v)``.

    The component is the smallest node reachable. Alternates large-star and
    small-star until nothing changes; each round is written to the shared
    folder. Only one row of counts per round reaches the driver. Null ends and
    loops are left out. With ``rounds`` it stops after so many: nodes with the
    same component are connected then, but not all connected ones have the same.
    """
    now = stored(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    before, done = None, 0
    while True:
        found = now.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("a"),
            F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31))).alias("b"),
        ).first()
        if found == before or not found.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select("v", "v").distinct()
            )
        if done == rounds:
            ends = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v"))
            return ends.groupBy("node").agg(F.min("component").alias("component"))
        before, done = found, done + 1
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Not made distinct: it has no more rows than there are edges, and the shuffle would cost as much as it saves.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(least).distinct(), "edges")

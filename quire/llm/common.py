"""Shared helpers: table access, tables written to the shared folder, Arrow plumbing, batched hashing.

Conventions that hold for every operator of this subpackage:

* a null text counts as an empty text unless the docstring says otherwise;
* rows that repeat both id and text are copies of one row and get the same result; every input row gets its own output row;
* input columns other than those named by parameters are never read by the operator, so their names cannot clash.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back.  Survives lost executors."""
    out, path = store.written(df)
    out._quire_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that nothing lazy reads any more."""
    for t in tables:
        store.drop(t._quire_path)


def slices(t: pa.Table, size: int) -> Iterator[pa.Table]:
    """Runs of rows whose column text holds about size bytes at most; a longer text stands alone."""
    if "text" not in t.column_names:
        yield t
        return
    total = np.cumsum(pc.fill_null(pc.binary_length(t["text"]), 0).to_numpy())
    a = 0
    while a < t.num_rows:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + size, "right")))
        yield t.slice(a, b - a)
        a = b


def give_back() -> None:
    """Return what this worker has freed to the system: it lives on, idle, beside the JVM's next stages."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc only
        trim(0)


def scan(df: DataFrame, columns: list, f: Callable[[pa.Table], pa.Table | None], schema, size: int = 6 << 20) -> DataFrame:
    """Apply f to Arrow slices of the given columns, of about size bytes of text; f sees whole rows and keeps nothing between calls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = part = out = None
        try:
            for b in batches:
                if b.num_rows:
                    for part in slices(pa.Table.from_batches([b]), size):
                        if (out := f(part)) is not None:
                            yield from out.to_batches()
        finally:
            del b, part, out
            give_back()

    return df.select(*columns).mapInArrow(run, schema)


def growing(df: DataFrame) -> DataFrame:
    """Marks a side of a join that grows with the corpus: it is merged, never broadcast, at every size."""
    return df.hint("merge")


def bucket(column: str | object, mod: int):
    """crc32(id as text) mod m: the fold of a row."""
    return F.crc32((F.col(column) if isinstance(column, str) else column).cast("string")) % mod


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The different numbers of x, each where it stands last; marks: an array that has a place for each, of any content."""
    at = np.arange(len(x))
    marks[x] = at
    return x[marks[x] == at]


#: Bytes of one piece of a long text.
PIECE = 1 << 20
#: Letters and digits, A-Z lowered; all other ASCII parts words, and what is not ASCII belongs to them.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(raw: bytes) -> Iterator[bytes]:
    """The words of a text in UTF-8 of whatever length, which is parted piece by piece."""
    raw = raw.translate(_WORDS)
    a = 0
    while a < len(raw):
        b = raw.find(b" ", a + PIECE) if a + PIECE < len(raw) else -1
        b = len(raw) if b < 0 else b
        yield from raw[a:b].split()
        a = b


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes; the table follows from the polynomial."""
    steps = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        steps.append(n)
    raw = f"[CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT) FOR i IN range(1, octet_length(encode({text})) + 1)]"
    return f"xor(list_reduce({raw}, lambda c, b: xor(c >> 8, ({steps}::BIGINT[])[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def placed(df: DataFrame, order: list, weight: str | None = None) -> DataFrame:
    """df, a written table, with place, how many rows stand before each in this order, and with a weight also before, the sum of theirs.

    A range exchange, running counts within its partitions, and one offset for each of them (so many rows are collected).  Equal rows are
    parted by their place in the table, so that no key fills a partition; which of them comes first is open.
    """
    spark = df.sparkSession
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = salted.repartitionByRange(n, *order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", _part int, _at long, _sum long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            own = b.column(weight).to_numpy(zero_copy_only=False).astype(np.int64) if weight else np.zeros(b.num_rows, np.int64)
            sums = total + np.concatenate([[0], np.cumsum(own)])
            more = [np.full(b.num_rows, part, np.int32), np.arange(at, at + b.num_rows), sums[:-1]]
            at, total = at + b.num_rows, int(sums[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, more)], [*b.schema.names, "_part", "_at", "_sum"])

    rows = written(dealt.mapInArrow(run, schema))
    last = F.max(F.col("_sum") + (F.col(weight) if weight else F.lit(0)))
    offsets, seen, total = [], 0, 0
    for r in sorted(rows.groupBy("_part").agg((F.max("_at") + 1).alias("n"), last.cast("long").alias("w")).collect()):
        offsets.append((r["_part"], seen, total))
        seen, total = seen + r["n"], total + r["w"]
    first = spark.createDataFrame(offsets, "_part int, _first long, _base long")
    out = rows.join(F.broadcast(first), "_part").withColumn("place", F.col("_at") + F.col("_first")).withColumn("before", F.col("_sum") + F.col("_base"))
    return out.drop("_part", "_at", "_sum", "_first", "_base", *([] if weight else ["before"]))

"""Helpers shared by the operators: reading, batching, shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text that a worker turns into Python objects at once; Spark bounds the bytes of an Arrow batch.
PIECE_ROWS, PIECE_BYTES = 256, 4 << 20

#: ASCII white space, the separator of ``[^\x20\x09-\x0D]+`` words; bytes.split() uses the same set.
ASCII_SPACE = b" \t\n\x0b\x0c\r"

#: A-Z to a-z, every other byte kept: UTF-8 continuation bytes are untouched.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``PIECE_ROWS`` and, but for single longer texts, ``PIECE_BYTES`` of the column at most."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes, dtype=np.int64), 0
        while at < batch.num_rows:
            most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_BYTES, side="right"))
            stop = min(at + PIECE_ROWS, max(at + 1, most))
            yield batch.slice(at, stop - at)
            at = stop


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where all run in one process tree on one machine."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        have = sc._jsc.sc().getCheckpointDir()
        if have.isDefined():
            where = have.get()
        elif sc.master.partition("[")[0] == "local":
            where = tempfile.mkdtemp(prefix="spoolglass-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that a lost executor costs no earlier iteration."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, under fixed names; null text is the empty text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


_KEPT: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]):
    """What ``make()`` gives, kept in this process: a worker's later tasks find it, with what it has learnt since."""
    if key not in _KEPT:
        while len(_KEPT) >= 4:
            del _KEPT[next(iter(_KEPT))]
        _KEPT[key] = make()
    return _KEPT[key]


def free_name(taken: DataFrame | list[str], name: str) -> str:
    """The name, or with underscores added until no column has it (in any case)."""
    used = {c.lower() for c in (taken if isinstance(taken, list) else taken.columns)}
    while name.lower() in used:
        name += "_"
    return name


def by_text(
    make: Callable[[], Callable[[str], tuple]], schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: doc_id stays, ``make()(text)`` gives the other columns of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in pieces(batches):
            rows = [work(t) for t in batch.column("text").to_pylist()]
            columns = list(zip(*rows, strict=True))
            arrays = [batch.column("doc_id")]
            arrays += [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return run


def filter_texts(docs: DataFrame, make: Callable[[], Callable[[str], bool]], text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text ``make()`` accepts; null text is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts = make()
        for batch in pieces(batches, text_col):
            yield batch.filter(pa.array([accepts(t or "") for t in batch.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def row_keys(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """Rows with a key that no two of them share, and its name: the ids themselves where none is null or repeated.

    Else the rows are written once, sorted by id (null last), then by a hash of
    the text columns, and numbered in that order, so that a smaller id has a
    smaller key.
    """
    ids = docs.groupBy(id_col).count().filter(F.col(id_col).isNull() | (F.col("count") > 1))
    if ids.isEmpty():
        return docs, id_col
    key = free_name(docs, "row_key")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(id_col).asc_nulls_last(), F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if kind == "string"] or [F.lit(0)])]
    numbered = docs.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id())
    return cut_lineage(numbered), key


class Bloom:
    """A filter of fixed size over 64-bit keys, built in Spark; it may pass other keys but never loses one.

    Its size doesn't depend on the data, so it can be broadcast.  With more
    keys than it is made for it passes more rows on, to exact operators.  It is
    compressed, as the driver and each executor keep a file of what is
    broadcast, and a filter of few keys is nearly all zeros.
    """

    BITS = 26

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> bytes:
        """At most 2**(BITS - 6) rows of 64 bits reach the driver."""
        return cls.by_count(keys.select(column, F.lit(1).alias("n")), column, "n", (0,))[0]

    @classmethod
    def by_count(cls, keys: DataFrame, column: str, count: str, levels: tuple[int, ...]) -> list[bytes]:
        """For each level a filter of the keys whose count is over it.

        At most 2**(BITS - 6) rows of 64 bits a level reach the driver.
        """
        slot = F.shiftrightunsigned(F.xxhash64(column), 64 - cls.BITS)
        bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
        words = keys.select(slot.alias("slot"), F.col(count).alias("n")).select(F.shiftright("slot", 6).alias("word"), bit.alias("bit"), "n").groupBy("word")
        found = words.agg(*[F.bit_or(F.when(F.col("n") > x, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"bits_{i}") for i, x in enumerate(levels)]).toArrow()
        from zstandard import ZstdCompressor

        filters, squeezed = [], ZstdCompressor(level=1)
        for i in range(len(levels)):
            out = np.zeros(1 << (cls.BITS - 6), np.int64)
            out[found.column("word").to_numpy()] = found.column(f"bits_{i}").to_numpy()
            filters.append(squeezed.compress(out.tobytes()))
        return filters

    @staticmethod
    def opened(packed: bytes) -> np.ndarray:
        from zstandard import ZstdDecompressor

        return np.frombuffer(ZstdDecompressor().decompress(packed), np.uint64)

    @classmethod
    def holds(cls, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        slot = spark_xxhash64(keys) >> np.uint64(64 - cls.BITS)
        return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def spark_xxhash64(keys: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's xxhash64 of a column of longs: XXH64 of the eight bytes."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, n: int) -> np.ndarray:
        return x << np.uint64(n) | x >> np.uint64(64 - n)

    with np.errstate(over="ignore"):
        k = turned(keys.astype(np.int64).view(np.uint64) * p2, 31) * p1
        h = turned((np.uint64(seed) + p5 + np.uint64(8)) ^ k, 27) * p1 + p4
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        return h ^ h >> np.uint64(32)

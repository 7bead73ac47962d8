"""Operator 5: benchmark decontamination by a prefix-filtered set join.

Every window of consecutive item words is a set of word shingles.  Shingles are
ordered by how rare they are in the documents.  A window that occurs has all of
its shingles, so its necessary prefix is its single rarest one: documents join
windows on that shingle alone.  The shingle's place in the window then bounds
where the window may start and end in the document (position and length), and
the words are compared for exact containment.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolglass.llm.common import as_batch, cut_lineage, filter_texts, free_name, keyed_texts, pieces

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
#: Benchmark text that is broadcast at once, up to twice this; more is joined in blocks, one after the other.
BLOCK_BYTES = 4 << 20

#: [0-9a-z] and bytes of other scripts are word bytes, A-Z are lower-cased, all else separates.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


class Windows:
    """The windows of a block of items, and their shingles as numbers."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW_WORDS) -> None:
        self.number: dict[bytes, int] = {}
        self.items: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                self.items[tuple(ids[i : i + window])] |= set() if item is None else {item}
        if (len(self.number) + 1) ** SHINGLE_WORDS >= 1 << 63:
            raise ValueError("a block has too many different words for the shingles' numbers")
        self.base = np.int64(len(self.number) + 1)
        self.sizes = sorted({min(SHINGLE_WORDS, len(w)) for w in self.items})
        self.prefixes: dict[int, dict[int, list[tuple[int, tuple[int, ...]]]]] = {}
        self.filters: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def numbers(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))

    def shingles(self, ids: np.ndarray, size: int) -> np.ndarray:
        """A number for each shingle of known words, -1 for the others; fewer words give none."""
        n = len(ids) - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(size):
            part = ids[k : k + n]
            code = code * self.base + part
            known &= part > 0
        return np.where(known, code, -1)

    def all_shingles(self) -> dict[int, np.ndarray]:
        out = {s: set() for s in self.sizes}
        for w in self.items:
            size = min(SHINGLE_WORDS, len(w))
            out[size].update(self.shingles(np.array(w), size).tolist())
        return {s: np.array(sorted(v), np.int64) for s, v in out.items()}

    def order(self, frequency: dict[tuple[int, int], int]) -> None:
        """Choose each window's prefix: its rarest shingle, the first of equally rare ones."""
        for w in self.items:
            size = min(SHINGLE_WORDS, len(w))
            codes = self.shingles(np.array(w), size).tolist()
            at = min(range(len(codes)), key=lambda i: (frequency.get((size, codes[i]), 0), i))
            self.prefixes.setdefault(size, {}).setdefault(codes[at], []).append((at, w))
        self.filters = {s: filtered(np.array(sorted(p), np.int64)) for s, p in self.prefixes.items()}

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Marks of the words inside any occurrence of a window, and the items with such a window."""
        n, hit, found = len(ids), np.zeros(len(ids), bool), set()
        listed = None
        for size, starts in self.prefixes.items():
            codes = self.shingles(ids, size)
            for p in candidates(codes, *self.filters[size]).tolist():
                if listed is None:
                    listed = ids.tolist()
                for offset, w in starts[int(codes[p])]:
                    a = p - offset
                    if a >= 0 and a + len(w) <= n and tuple(listed[a : a + len(w)]) == w:
                        hit[a : a + len(w)] = True
                        found |= self.items[w]
        return hit, found


def filtered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes, with a bit map by hash that most absent codes fail."""
    bits = np.zeros(1 << 20, bool)
    bits[slot(codes)] = True
    return codes, bits


def slot(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


def candidates(codes: np.ndarray, wanted: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(bits[slot(codes)] & (codes >= 0))
    if not len(at) or not len(wanted):
        return at[:0]
    near = np.minimum(np.searchsorted(wanted, codes[at]), len(wanted) - 1)
    return at[wanted[near] == codes[at]]


def rarity(docs: DataFrame, shared) -> dict[tuple[int, int], int]:
    """Occurrences of the windows' shingles over all documents; at most one row for each shingle reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        filters = {s: filtered(c) for s, c in windows.all_shingles().items()}
        counts: Counter = Counter()
        for batch in pieces(batches):
            for text in batch.column("text").to_pylist():
                ids = windows.numbers(text)
                for size, f in filters.items():
                    codes = windows.shingles(ids, size)
                    at = candidates(codes, *f)
                    if len(at):
                        counts.update(zip(repeat(size), codes[at].tolist()))
        columns = [pa.array([k[0] for k in counts], pa.int64()), pa.array([k[1] for k in counts], pa.int64()), pa.array(counts.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["size", "code", "n"])

    counted = docs.select("text").mapInArrow(run, "size long, code long, n long").groupBy("size", "code").agg(F.sum("n").alias("n"))
    return {(r["size"], r["code"]): r["n"] for r in counted.toArrow().to_pylist()}


def blocks_of(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_bytes: int) -> tuple[DataFrame, int]:
    """item, text, block of the distinct items, and the number of blocks; no block is over twice ``block_bytes``.

    Items of over a quarter of that are cut into pieces that share all but one
    of a window's words, so that each window lies in a piece.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).distinct()
    size, most = F.octet_length("text"), max(1, block_bytes // 4)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words, first = words_of(text), 0
                ends = np.cumsum([len(w) + 1 for w in words] or [0])
                while first == 0 or first + window <= len(words):
                    last = max(first + window, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most)))
                    out.append((item, b" ".join(words[first:last]).decode()))
                    first = last - window + 1
            yield as_batch(out, pa.schema([("item", pa.string()), ("text", pa.string())]))

    total = items.agg(F.sum(size).alias("n"), F.max(size).alias("most")).first()
    if (total["most"] or 0) > most:
        items = cut_lineage(items.filter(size <= most).unionByName(items.filter(size > most).mapInArrow(cut, "item string, text string")).distinct())
        total = items.agg(F.sum(size).alias("n")).first()
    n = -(-(total["n"] or 0) // block_bytes) or 1
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
        if n == 1 or dealt.groupBy("block").agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0] <= max(2 * block_bytes, 8 * most):
            return dealt, n
        n += -(-n // 2)


def block_of(items: DataFrame, k: int) -> list[tuple[str | None, str]]:
    return [(r["item"], r["text"]) for r in items.filter(F.col("block") == k).toArrow().to_pylist()]


def ordered_windows(rows: DataFrame, block: list[tuple[str | None, str]], window: int):
    """The block's windows with their prefixes, broadcast: ``BLOCK_BYTES`` bounds their size."""
    context = rows.sparkSession.sparkContext
    windows = Windows(block, window)
    windows.order(rarity(rows, context.broadcast(windows)))
    return context.broadcast(windows)


HIT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("hit", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def block_hits(rows: DataFrame, items: DataFrame, n: int, window: int) -> DataFrame:
    """doc_id, digest (of the text), hit, items of the rows that each block's windows occur in, a row for each block.

    Only these are kept between the passes of the blocks; texts are read, not written.
    """
    slim, found = rows.select("doc_id", "text", F.md5("text").alias("digest")), None
    for k in range(n):
        shared = ordered_windows(rows, block_of(items, k), window)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for batch in pieces(batches):
                out = []
                for doc, text, digest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "digest")), strict=True):
                    hit, found = windows.hits(windows.numbers(text))
                    if hit.any():
                        out.append((doc, digest, np.flatnonzero(hit).tolist(), sorted(found)))
                if out:
                    yield as_batch(out, HIT_SCHEMA)

        hits = cut_lineage(slim.mapInArrow(run, "doc_id long, digest string, hit array<int>, items array<string>").distinct())
        found = hits if found is None else found.unionByName(hits)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows that no window of the benchmark occurs in, with all their columns."""
    items, n = blocks_of(benchmark, item_col, item_text_col, window, block_bytes)
    rows = keyed_texts(docs, id_col, text_col)
    if n == 1:  # decided where the row is
        shared = ordered_windows(rows, block_of(items, 0), window)

        def make():
            windows = shared.value
            return lambda text: not windows.hits(windows.numbers(text))[0].any()

        return filter_texts(docs, make, text_col)
    own, other = free_name(docs, "own_id"), free_name(docs, "own_digest")
    hits = block_hits(rows, items, n, window).select(F.col("doc_id").alias(own), F.col("digest").alias(other)).distinct()
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.join(hits, docs[id_col].eqNullSafe(hits[own]) & (F.md5(text) == hits[other]), "left_anti")


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``.

    A window is ``window`` consecutive item words, or a whole shorter item that
    has words.  Null texts have no words; items without an id mark words but
    are not counted; equal ids count once; null document ids stay null and
    repeated rows each give a row; other columns are not read.  An empty
    benchmark hits nothing; no documents give no rows.
    """
    rows = keyed_texts(docs, id_col, text_col)
    items, n = blocks_of(benchmark, item_col, item_text_col, window, block_bytes)

    def row(doc: int | None, n_words: int, n_hit: int, found: list[str]) -> tuple:
        return doc, n_words, n_hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), n_hit > 0

    if n == 1:
        shared = ordered_windows(rows, block_of(items, 0), window)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for batch in pieces(batches):
                out = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = windows.numbers(text)
                    hit, found = windows.hits(ids)
                    out.append(row(doc, len(ids), int(hit.sum()), sorted(found)))
                yield as_batch(out, SCHEMA)

        return rows.mapInArrow(run, DDL)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sizes = [len(words_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), batch.column("digest")], names=["doc_id", "n_words", "digest"])

    slim = rows.select("doc_id", "text", F.md5("text").alias("digest")).mapInArrow(counted, "doc_id long, n_words long, digest string")
    merged = block_hits(rows, items, n, window).groupBy(F.col("doc_id").alias("own_id"), F.col("digest").alias("own_digest"))
    merged = merged.agg(F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = slim.join(merged, slim["doc_id"].eqNullSafe(merged["own_id"]) & (slim["digest"] == merged["own_digest"]), "left")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )

"""Operator 6: repeated passages by a sparse suffix array over words.

A k-gram of words is a minimiser where its hash is the least of a window of
k-grams; equal passages have equal minimisers, and every passage of ``length``
words holds one.  Only suffixes at minimisers are kept.  They are sorted by
their k-gram and the words that follow; neighbours with more words in common
stand closer, so one comparison with the neighbour above tells how far the
match reaches to the right, for the whole run of suffixes that share it.
Within such a run the matches are extended to the left by the words before.
The suffixes of a k-gram that is too common for one sorted run are compared
window by window: each window of ``length`` words through them is a key of its
own, counted where it is made and then joined, so that no task gets them all.

Words are compared by 32-bit hashes, windows of common k-grams by 128-bit ones:
two different windows of ``length`` words pass as equal if all the words they
differ in collide, so with 2**-32 at most for each pair that differs in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolglass.llm.common import LOWER_AZ, Bloom, cut_lineage, keyed_texts, pieces

LENGTH = 50
GRAM = 8
#: Contexts that a task remembers, to send one of equal ones to the sort.
SEEN_CONTEXTS = 200_000
#: Suffixes of a k-gram that are sorted together at most.
HOT_SUFFIXES = 16_384

SUFFIX_SCHEMA = pa.schema([("gram", pa.int64()), ("left_words", pa.binary()), ("right_words", pa.binary()), ("doc_id", pa.int64()), ("at", pa.int32()), ("last", pa.int32())])
SUFFIX_DDL = "gram long, left_words binary, right_words binary, doc_id long, at int, last int"
SPAN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
SPAN_DDL = "doc_id long, first int, last int"
PASSAGE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_repeated", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])
PASSAGE_DDL = "doc_id long, n_repeated long, spans array<struct<first:int,last:int>>"


def word_hashes(text: str, memo: dict[bytes, int]) -> np.ndarray:
    """32-bit hashes of the words, A-Z lower-cased, split at ASCII white space."""
    words = text.encode().translate(LOWER_AZ).split()
    return np.fromiter(map(memo.__getitem__, words), np.uint32, len(words))


class WordMemo(dict):
    def __init__(self, size: int = 300_000) -> None:
        super().__init__()
        from xxhash import xxh32_intdigest

        self.hash, self.size = xxh32_intdigest, size

    def __missing__(self, word: bytes) -> int:
        h = self.hash(word)
        if len(self) >= self.size:
            self.clear()
        if len(word) <= 100:
            self[word] = h
        return h


def gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` words."""
    n = len(words) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = (h ^ words[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def minimisers(grams: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of minimisers, with the first and last window start that each is the (leftmost) minimum of."""
    n = len(grams) - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    places = np.arange(len(grams))
    best, width = places, 1
    while width < window:  # the leftmost minimum of 1, 2, 4 ... k-grams, then of the window
        step = min(width, window - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(grams[b] < grams[a], b, a)
        width += step
    chosen = best[:n]
    cuts = np.flatnonzero(np.diff(chosen)) + 1
    first = np.concatenate(([0], cuts))
    last = np.concatenate((cuts - 1, [n - 1]))
    return chosen[first], first, last


def suffix_rows(docs: DataFrame, length: int, gram: int, repeated: Broadcast | None, hot: Broadcast | None = None) -> DataFrame:
    """The k-gram of each kept suffix, or, of those in the filter ``repeated``, the suffix with the words around it.

    The context reaches from the first to the last window that has its minimum
    at the suffix: all words that can belong to a match through it, no more.
    Of suffixes with the same context in a task one goes to the sort; all of
    them are repeated, and the others go on as finished spans (no words, from
    ``at`` to ``last``) under keys of their own, so that the copies of a common
    passage don't meet in one task.  A suffix whose k-gram is in the filter
    ``hot`` gives its windows instead: digest as left_words, no right_words.
    """
    window = length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        memo = WordMemo()
        bits = repeated and Bloom.opened(repeated.value)
        hot_bits = hot and Bloom.opened(hot.value)
        seen: dict[bytes, tuple] = {}
        for batch in pieces(batches):
            rows: list[tuple] = []
            found: list[np.ndarray] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = word_hashes(text, memo)
                grams = gram_hashes(words, gram)
                at, first, last = minimisers(grams, window)
                keys = grams[at].view(np.int64)
                if bits is None:
                    found.append(keys)
                    continue
                kept = np.flatnonzero(Bloom.holds(bits, keys))
                if not len(kept):
                    continue
                packed = words.astype(">u4").tobytes()
                if hot_bits is not None and len(common := kept[Bloom.holds(hot_bits, keys[kept])]):
                    for a, b in zip(first[common].tolist(), last[common].tolist(), strict=True):
                        rows += [(0, xxh3_128_digest(packed[4 * i : 4 * (i + length)]), None, doc, i, i + length) for i in range(a, b + 1)]
                    kept = np.setdiff1d(kept, common)
                for k, m, a, b in zip(*(x[kept].tolist() for x in (keys, at, first, last)), strict=True):
                    context = xxh3_128_digest(packed[4 * a : 4 * (b + length)])
                    before = seen.get(context)
                    if before is None:
                        if len(seen) >= SEEN_CONTEXTS:
                            seen.clear()
                        seen[context] = (doc, a, b + length)
                        rows.append((k, packed[4 * a : 4 * m], packed[4 * m : 4 * (b + length)], doc, m, None))
                        continue
                    if before:  # the first of them, until now only in the sort
                        rows.append((own_key(*before), None, None, *before))
                        seen[context] = ()
                    rows.append((own_key(doc, a, b + length), None, None, doc, a, b + length))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64())], names=["gram"])
            if rows:
                arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SUFFIX_SCHEMA, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=SUFFIX_SCHEMA)

    return docs.mapInArrow(run, "gram long" if repeated is None else SUFFIX_DDL)


def own_key(doc: int | None, first: int, last: int) -> int:
    return hash((doc, first, last))  # of integers: the same in every process


def common_bytes(a: bytes, b: bytes) -> int:
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


class Run:
    """The suffixes of one k-gram, given in sorted order; reports the windows found a second time."""

    def __init__(self, length: int) -> None:
        self.length, self.above = length, b""
        self.seen: list[dict[bytes, list]] = [{} for _ in range(length + 1)]
        self.owners: list[list] = []

    def add(self, left: bytes, right: bytes, doc: int | None, at: int) -> list | None:
        """The suffix as [doc, at, offsets of repeated windows], if it is done; else it is kept until the end."""
        length, seen = self.length, self.seen
        shared = common_bytes(self.above, right) // 4 if self.above else 0
        self.above = right
        for o in range(max(0, length - shared)):  # windows that reach further right than the neighbours' match
            if seen[o]:
                seen[o] = {}
        row, owns = [doc, at, []], False
        for o in range(length - len(right) // 4, len(left) // 4 + 1):
            words = left[len(left) - 4 * o :]
            owner = seen[o].get(words)
            if owner is None:
                seen[o][words] = row
                owns = True
            else:
                row[2].append(o)
                if not owner[2] or owner[2][-1] != o:
                    owner[2].append(o)
        if owns:
            self.owners.append(row)
            return None
        return row


def spans_of(row: list, length: int) -> list[tuple[int | None, int, int]]:
    doc, at, offsets = row
    out: list[tuple[int | None, int, int]] = []
    for start in sorted(at - o for o in set(offsets)):
        if out and start <= out[-1][2]:
            out[-1] = (doc, out[-1][1], start + length)
        else:
            out.append((doc, start, start + length))
    return out


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, hot_suffixes: int = HOT_SUFFIXES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first, last: spans of words that lie in a passage of ``length`` words found twice or more.

    Words are split at ASCII white space, A-Z lower-cased; both places may be
    in one document.  Spans of a document may touch or overlap.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed_texts(docs, id_col, text_col)
    counts = cut_lineage(suffix_rows(rows, length, gram, None).groupBy("gram").count().filter("count > 1"))
    too_common = counts.filter(F.col("count") > hot_suffixes)
    hot = None if too_common.isEmpty() else spark.sparkContext.broadcast(Bloom.of(too_common, "gram"))
    kept = suffix_rows(rows, length, gram, spark.sparkContext.broadcast(Bloom.of(counts, "gram")), hot)
    windows = None
    if hot is not None:
        kept = cut_lineage(kept)
        is_window = F.col("right_words").isNull() & F.col("left_words").isNotNull()
        each = kept.filter(is_window).select(F.col("left_words").alias("digest"), "doc_id", F.col("at").alias("first"), "last")
        kept = kept.filter(~is_window)
        again = cut_lineage(each.groupBy("digest").count().filter("count > 1").select("digest"))
        windows = each.join(again.hint("shuffle_merge"), "digest").select("doc_id", "first", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, Run(length), []
        for batch in batches:
            for k, left, right, doc, at, last in zip(*(batch.column(c).to_pylist() for c in SUFFIX_SCHEMA.names), strict=True):
                if right is None:
                    out.append((doc, at, last))
                    continue
                if k != key:
                    out += [s for r in group.owners for s in spans_of(r, length)]
                    key, group = k, Run(length)
                if (row := group.add(left, right, doc, at)) is not None:
                    out += spans_of(row, length)
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SPAN_SCHEMA, strict=True)], schema=SPAN_SCHEMA)
                out = []
        out += [s for r in group.owners for s in spans_of(r, length)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SPAN_SCHEMA, strict=True)], schema=SPAN_SCHEMA)

    found = kept.repartition(n, "gram").sortWithinPartitions("gram", "right_words").mapInArrow(run, SPAN_DDL)
    return found if windows is None else found.unionByName(windows)


def repeated_passages(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, hot_suffixes: int = HOT_SUFFIXES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_repeated, spans: each document with passages of ``length`` words or more that repeat, word for word.

    spans are the disjoint maximal runs of repeated words, as numbers of the
    first word and of the word after the last; n_repeated is their words.
    Documents without such a passage give no row, so null and short texts give
    none.  Rows with the same id, or without one, are reported together.
    Other columns are not read.  No rows give no rows.
    """
    spans = repeated_spans(docs, length=length, gram=gram, hot_suffixes=hot_suffixes, id_col=id_col, text_col=text_col)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # document and its spans so far
        out: list[tuple] = []
        for batch in batches:
            for doc, first, last in zip(*(batch.column(c).to_pylist() for c in SPAN_SCHEMA.names), strict=True):
                if held is None or held[0] != doc:
                    if held is not None:
                        out.append(held)
                    held = (doc, [[first, last]])
                elif first <= held[1][-1][1]:
                    held[1][-1][1] = max(last, held[1][-1][1])
                else:
                    held[1].append([first, last])
            if len(out) > 5_000:
                yield packed(out)
                out = []
        if held is not None:
            out.append(held)
        if out:
            yield packed(out)

    def packed(found: list[tuple]) -> pa.RecordBatch:
        rows = [(d, sum(b - a for a, b in s), [{"first": a, "last": b} for a, b in s]) for d, s in found]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PASSAGE_SCHEMA, strict=True)], schema=PASSAGE_SCHEMA)

    return spans.distinct().repartition(n, "doc_id").sortWithinPartitions("doc_id", "first").mapInArrow(run, PASSAGE_DDL)

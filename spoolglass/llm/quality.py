"""Operator 2: quality rules with compression bands.

A text that says the same again and again compresses too well, noise hardly
compresses at all.  The ratio of raw to compressed bytes under zstandard is
taken over the whole document and over fixed chunks, and each has to lie within
the band of its length: short inputs compress less than long ones.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from spoolglass.llm.common import by_text, filter_texts, keyed_texts

LEVEL = 3
CHUNK_BYTES = 4096

#: (bytes up to, lowest ratio, highest ratio) for whole documents and chunks alike.  The low limits lie between what
#: base64-like noise reaches at a length (1.18 at 360 bytes, 1.26 at 600, 1.33 at 1.2 KB, 1.40 from 5 KB on) and the
#: least ratio of ordinary prose (1.35, 1.43, 1.69, 1.92 and more in the sample tables, lower for three-byte scripts);
#: the high limits lie a fifth or more above the greatest of prose that passes the base rule (1.85 to 2.9).
BANDS = ((512, 1.2, 2.3), (1024, 1.3, 2.6), (2048, 1.4, 2.9), (8192, 1.5, 3.2), (32768, 1.6, 3.6), (float("inf"), 1.6, 4.2))

#: Share of a document's chunks that may lie outside their band.
MAX_BAD_CHUNKS = 0.5

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
    + [(n, pa.float64()) for n in ("ratio", "min_chunk_ratio", "max_chunk_ratio", "bad_chunks")]
)
DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, min_chunk_ratio double, max_chunk_ratio double, bad_chunks double"
)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS)))
    lines = raw.split(b"\n")
    dup_lines = 0
    if len(lines) > 1:
        full = [x for x in lines if x and not x.isspace()]
        dup_lines = len(full) - len(set(full))
    return n, chars, symbols, dup_lines, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    put, twice = seen.setdefault, set()
    for i, w in enumerate(windows):
        if put(w, i) != i:
            twice.add(w)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def within(size: int, ratio: float) -> bool:
    low, high = next((lo, hi) for most, lo, hi in BANDS if size <= most)
    return low <= ratio <= high


def chunks_of(raw: bytes) -> list[bytes]:
    """Chunks of ``CHUNK_BYTES``; a rest of less than a quarter of that belongs to the chunk before it."""
    starts = list(range(0, max(1, len(raw) - CHUNK_BYTES // 4 + 1), CHUNK_BYTES))
    return [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]


class Bands:
    def __init__(self) -> None:
        import zstandard

        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)

    def ratio(self, raw: bytes) -> float:
        return len(raw) / len(self.packer.compress(raw)) if raw else 0.0

    def verdict(self, raw: bytes) -> tuple[bool, float, float, float, float]:
        """kept, and the ratios: whole, least and greatest of the chunks, share of chunks outside their band."""
        if not raw:
            return False, 0.0, 0.0, 0.0, 0.0
        whole = self.ratio(raw)
        chunks = [(len(raw), whole)]
        if len(raw) > CHUNK_BYTES:
            chunks = [(len(p), self.ratio(p)) for p in chunks_of(raw)]
        bad = sum(not within(n, r) for n, r in chunks) / len(chunks)
        ratios = [r for _, r in chunks]
        return within(len(raw), whole) and bad <= MAX_BAD_CHUNKS, whole, min(ratios), max(ratios), bad


def base_failed(counts: tuple[int, ...]) -> bool:
    return counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]


def kept_documents(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows that ``quality`` keeps, with all their columns: decided row by row, without a shuffle."""

    def make():
        bands = Bands()
        return lambda text: not base_failed(base_counts(text)) and bands.verdict(text.encode())[0]

    return filter_texts(docs, make, text_col)


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base rule and compression verdict of each whole text.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept and the ratios.  Null and empty texts
    have no words and fail; a null id stays null; repeated rows each give a
    row; other columns are not read.  No rows give no rows.
    """

    def make():
        bands = Bands()

        def work(text: str) -> tuple:
            counts = base_counts(text)
            failed = base_failed(counts)
            kept, *ratios = bands.verdict(text.encode())
            return (*counts, failed, kept and not failed, *ratios)

        return work

    return keyed_texts(docs, id_col, text_col).mapInArrow(by_text(make, SCHEMA), DDL)

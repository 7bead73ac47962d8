"""Character n-grams of words, counted by language: what operator 3 learns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolglass.llm.common import pieces

ORDER = 4
DISCOUNT = 0.75
OPEN, CLOSE = "\x02", "\x03"
LETTERS = re.compile(r"[^\W\d_]+")
FLUSH_WORDS, FLUSH_GRAMS = 300_000, 600_000

GRAM_SCHEMA = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])


def grams_of(words: Counter, order: int, into: Counter) -> None:
    pad = OPEN * (order - 1)
    for word, n in words.items():
        text = f"{pad}{word}{CLOSE}"
        for i in range(len(word) + 1):
            into[text[i : i + order]] += n


def gram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n over all rows: counted in the tasks, then summed by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        grams: dict[str, Counter] = {}

        def fold() -> None:
            for lang, found in words.items():
                grams_of(found, order, grams.setdefault(lang, Counter()))
            words.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in grams.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], schema=GRAM_SCHEMA)
            grams.clear()

        for batch in pieces(batches):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
            if sum(map(len, words.values())) > FLUSH_WORDS:
                fold()
                if sum(map(len, grams.values())) > FLUSH_GRAMS:
                    yield from out()
        fold()
        yield from out()

    return labelled.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

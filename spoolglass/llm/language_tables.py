"""The Kneser-Ney model of operator 3 as tables, for one that is too large to broadcast.

The probabilities are those of ``language.Model``, but counts, contexts and
scores stay in Spark.  Only what has one row a language reaches the driver.
Distinct n-grams of the texts are scored order by order, each through its
suffix; then distinct words, then texts, by joins whose sides are exchanged, so
that adaptive execution splits hot keys.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolglass.llm.common import as_batch, cut_lineage, pieces
from spoolglass.llm.language_counts import DISCOUNT, LETTERS, OPEN, grams_of

#: A longer word stands under a digest, so that it is not repeated for each of its n-grams.
LONG_WORD = 64
WORD_SCHEMA = pa.schema([("key", pa.int64()), ("word", pa.string()), ("n", pa.int64())])
TEXT_SCHEMA = pa.schema([("word", pa.string()), ("text", pa.string())])
GRAM_SCHEMA = pa.schema([("word", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
FLUSH_ROWS, FLUSH_CHARS = 20_000, 4 << 20


def word_key(word: str) -> str:
    """The word, or a digest of a long one under a mark that no word has."""
    return word if len(word) <= LONG_WORD else OPEN + hashlib.sha256(word.encode()).hexdigest()


def words_of_texts(rows: DataFrame) -> DataFrame:
    """key, word, n: the distinct words of each row (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                out += [(key, word_key(w), n) for w, n in Counter(LETTERS.findall(text.lower())).items()]
            yield as_batch(out, WORD_SCHEMA)

    return rows.mapInArrow(run, "key long, word string, n long")


def distinct_words(rows: DataFrame) -> DataFrame:
    """word, text: each word of the rows (key, text) once, with its characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = {w for text in batch.column("text").to_pylist() for w in LETTERS.findall(text.lower())}
            yield as_batch([(word_key(w), w) for w in found], TEXT_SCHEMA)

    return rows.mapInArrow(run, "word string, text string").groupBy("word").agg(F.first("text").alias("text"))


def grams_of_words(words: DataFrame, order: int) -> DataFrame:
    """word, gram, n of the rows (word, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[tuple] = []
            for word, text in zip(batch.column("word").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found: Counter = Counter()
                grams_of(Counter([text]), order, found)
                out += [(word, gram, n) for gram, n in found.items()]
                if len(out) > FLUSH_ROWS:
                    yield as_batch(out, GRAM_SCHEMA)
                    out = []
            yield as_batch(out, GRAM_SCHEMA)

    return words.mapInArrow(run, "word string, gram string, n long")


class Tables:
    """The model of the counts (lang, gram, n), which are read again at each step."""

    def __init__(self, counts: DataFrame, langs: list[str], order: int) -> None:
        self.langs, self.order = langs, order
        self.counts = {order: counts}
        for k in range(order - 1, 0, -1):  # continuation counts: distinct left neighbours
            wide = self.counts[k + 1].select("lang", F.substring("gram", 2, k).alias("gram"))
            self.counts[k] = cut_lineage(wide.groupBy("lang", "gram").agg(F.count("*").alias("n")))

    def by_lang(self, value: Column) -> Column:
        """An aggregate: the value's sum in each language."""
        return F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == x, value)), F.lit(0)).cast("double") for x in self.langs])

    def each(self, expression: str) -> Column:
        """An array with the expression's value for each language ``i``."""
        return F.expr(f"transform(sequence(0, {len(self.langs) - 1}), i -> {expression})")

    @cached_property
    def unigrams(self) -> tuple[int, list[float], list[float]]:
        """Characters known, and in each language the counts of characters in all and of distinct ones."""
        letters = self.counts[1].select("gram").distinct().count()
        found = {r["lang"]: r for r in self.counts[1].groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("seen")).collect()}
        return max(2, letters), [float(found[x]["total"]) for x in self.langs], [float(found[x]["seen"]) for x in self.langs]

    def means(self) -> list[float]:
        """Of each language, the mean cross-entropy of its own n-grams."""
        counts = self.counts[self.order]
        scored = self.probabilities(counts.select("gram").distinct(), self.order)
        own = F.expr("-ln(p[cast(array_position(langs, lang) - 1 as int)])")
        langs = F.array(*map(F.lit, self.langs)).alias("langs")
        rows = counts.join(scored, "gram").select("lang", "n", "p", langs).groupBy("lang").agg((F.sum(F.col("n") * own) / F.sum("n")).alias("mean")).collect()
        found = {r["lang"]: r["mean"] for r in rows}
        return [found[x] for x in self.langs]

    def probabilities(self, grams: DataFrame, k: int) -> DataFrame:
        """gram, p (an array by language) of distinct n-grams of order ``k``."""
        own = self.counts[k].groupBy("gram").agg(self.by_lang(F.col("n")).alias("own"))
        rows = grams.join(own, "gram", "left")
        seen = "coalesce(own[i], 0D)"
        if k == 1:
            letters, total, kinds = self.unigrams
            base = [max(s, 1.0) * DISCOUNT / t / (letters + 1) for s, t in zip(kinds, total, strict=True)]
            rows = rows.withColumn("total", F.lit(total)).withColumn("base", F.lit(base))
            return rows.select("gram", self.each(f"greatest(greatest({seen} - {DISCOUNT}D, 0D) / total[i] + base[i], 1e-12D)").alias("p"))
        context = F.substring("gram", 1, k - 1).alias("context")
        contexts = self.counts[k].groupBy(context).agg(self.by_lang(F.col("n")).alias("total"), self.by_lang(F.lit(1)).alias("kinds"))
        suffix = F.substring("gram", 2, k - 1)
        lower = self.probabilities(grams.select(suffix.alias("gram")).distinct(), k - 1).select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        rows = rows.withColumn("context", F.substring("gram", 1, k - 1)).withColumn("suffix", suffix)
        rows = rows.join(contexts, "context", "left").join(lower, "suffix")
        known = "coalesce(total[i], 0D) > 0"
        p = f"if({known}, greatest({seen} - {DISCOUNT}D, 0D) / total[i] + {DISCOUNT}D * kinds[i] / total[i] * lower[i], lower[i])"
        return cut_lineage(rows.select("gram", self.each(p).alias("p")))

    def entropies(self, rows: DataFrame) -> DataFrame:
        """key, chars, entropy (an array by language) of the rows (key, text) that have a letter; keys are distinct."""
        grams = cut_lineage(grams_of_words(distinct_words(rows), self.order))
        scored = self.probabilities(grams.select("gram").distinct(), self.order)
        total = [F.sum(F.col("n") * F.log(F.col("p")[i])) for i in range(len(self.langs))]
        words = grams.join(scored, "gram").groupBy("word").agg(F.array(*total).alias("logp"))
        chars = F.col("n") * F.when(F.col("word").startswith(OPEN), F.col("length")).otherwise(F.length("word") + 1)
        sizes = grams.filter(F.col("word").startswith(OPEN)).groupBy("word").agg(F.sum("n").alias("length"))
        texts = words_of_texts(rows).join(words.join(sizes, "word", "left"), "word")
        sums = [F.sum(F.col("n") * F.col("logp")[i]) for i in range(len(self.langs))]
        found = texts.groupBy("key").agg(F.sum(chars).alias("chars"), F.array(*sums).alias("logp"))
        return found.select("key", "chars", self.each("-logp[i] / chars").alias("entropy"))

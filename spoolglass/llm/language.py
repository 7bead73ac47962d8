"""Operator 3: language identification by Kneser-Ney character models.

Words are runs of letters, lower-cased and closed by marks, so that an n-gram
never crosses a word.  One pass counts the highest-order n-grams of every
labelled text by language; lower orders use continuation counts, which follow
from the distinct higher-order n-grams.  The interpolated probabilities of all
languages lie in sorted hash arrays, one for each order.  A text gets the
language of least cross-entropy per character.  Rejection is calibrated on
training documents that the model doesn't count: a cross-entropy beyond that of
all but ``REJECT_SHARE`` of a language's own texts of the length is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoolglass.llm.common import as_batch, cut_lineage, pieces, row_keys
from spoolglass.llm.language_counts import CLOSE, DISCOUNT, LETTERS, OPEN, ORDER, gram_counts
from spoolglass.llm.language_tables import Tables

#: How sharply differences of cross-entropy turn into a score.
SHARPNESS = 12.0
#: Share of a language's own texts that may be rejected; one training document in CALIBRATION_SHARE sets the limits.
REJECT_SHARE, CALIBRATION_SHARE = 0.005, 16
#: Characters after which a longer text is not expected to lie closer to its language's mean, and nats added to each limit.
STEADY_CHARS, REJECT_MARGIN = 400, 0.1
#: Texts that a language needs for limits of its own; with fewer it has the widest of the others', or this many nats.
CALIBRATION_TEXTS, REJECT_DEFAULT = 20, 1.0
UNKNOWN = "und"
MEMO_WORDS = 200_000
#: Distinct n-grams times languages of a model that may be collected and broadcast: 100 MB at most.
MODEL_CELLS = 1 << 23

SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_()), ("cross_entropy", pa.float64())])
DDL = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean, cross_entropy double"


def held_out(doc_id: Column) -> Column:
    """The fold that training never reads; rows without an id belong to it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def hashes(codes: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each row of code points."""
    h = np.full(len(codes), 0x9E3779B97F4A7C15 + codes.shape[1], np.uint64)
    for k in range(codes.shape[1]):
        h = (h ^ codes[:, k].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


@dataclass
class Level:
    """Of one order: hashes of n-grams with log probabilities, and of their contexts with log back-off weights."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the wanted hashes, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    def __init__(self, langs: list[str], lang: np.ndarray, grams: list[str], n: np.ndarray, order: int = ORDER) -> None:
        """lang: numbers into ``langs``; grams: strings of ``order`` characters; n: their counts."""
        self.langs, self.order = langs, order
        codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, order)
        counts = [(codes, lang, n.astype(np.float64))]
        for k in range(order - 1, 0, -1):  # continuation counts: distinct left neighbours
            wide, by, _ = counts[-1]
            h = hashes(wide[:, 1:]) ^ (by.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            _, first, each = np.unique(h, return_index=True, return_counts=True)
            counts.append((wide[first, 1:], by[first], each.astype(np.float64)))
        size = len(langs)
        vocabulary = max(2, len(np.unique(codes[:, -1])) if len(codes) else 2)
        self.floor = np.full(size, -math.log(vocabulary) - 4.0)
        self.levels: list[Level] = []
        for k, (wide, by, each) in enumerate(reversed(counts), 1):
            h = hashes(wide)
            keys, first, row = np.unique(h, return_index=True, return_inverse=True)
            own = np.zeros((len(keys), size))
            own[row, by] = each
            if k == 1:
                total = np.maximum(own.sum(axis=0), 1)
                seen = (own > 0).sum(axis=0)
                p = np.maximum(own - DISCOUNT, 0) / total + DISCOUNT * np.maximum(seen, 1) / total / (vocabulary + 1)
                self.levels.append(Level(keys, np.log(np.maximum(p, 1e-12)), np.empty(0, np.uint64), np.empty((0, size))))
                self.floor = np.log(DISCOUNT * np.maximum(seen, 1) / total / (vocabulary + 1))
                continue
            contexts, crow = np.unique(hashes(wide[first, :-1]), return_inverse=True)
            total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, crow, own)
            np.add.at(kinds, crow, own > 0)
            known = total > 0
            backoff = np.where(known, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            low = self.levels[-1]
            at, there = lookup(low.keys, hashes(wide[first, 1:]))
            lower = np.exp(np.where(there[:, None], low.logp[at], self.floor))
            p = np.maximum(own - DISCOUNT, 0) / np.maximum(total[crow], 1) + backoff[crow] * lower
            self.levels.append(Level(keys, np.log(p), contexts, np.log(backoff)))
        # Until it is calibrated: the mean over a language's own n-grams, and a wide limit.
        self.mean, self.reach = np.zeros(size), np.full(size, REJECT_DEFAULT * math.sqrt(STEADY_CHARS))
        if len(codes):
            at, _ = lookup(self.levels[-1].keys, hashes(codes))
            for i in range(size):
                if (own := lang == i).any():
                    self.mean[i] = np.average(-self.levels[-1].logp[at[own], i], weights=n[own])
        for level in self.levels:
            level.logp, level.backoff = level.logp.astype(np.float32), level.backoff.astype(np.float32)

    def limit(self, lang: int, chars: int) -> float:
        """The greatest cross-entropy that is accepted of a text of so many characters."""
        return float(self.mean[lang] + self.reach[lang] / math.sqrt(min(chars, STEADY_CHARS)) + REJECT_MARGIN)

    def logp(self, codes: np.ndarray) -> np.ndarray:
        """Log probability of each row's last character in each language."""
        k = codes.shape[1]
        level = self.levels[k - 1]
        at, there = lookup(level.keys, hashes(codes))
        out = level.logp[at] if len(level.keys) else np.zeros((len(codes), len(self.langs)), np.float32)
        miss = np.flatnonzero(~there)
        if len(miss):
            if k == 1:
                out[miss] = self.floor
            else:
                low = self.logp(codes[miss, 1:])
                at, there = lookup(level.contexts, hashes(codes[miss, :-1]))
                if there.any():
                    low[there] += level.backoff[at[there]]
                out[miss] = low
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """Summed log probabilities of each word in each language."""
        pad = OPEN * (self.order - 1)
        text = np.frombuffer("".join([f"{pad}{w}{CLOSE}" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
        windows = np.lib.stride_tricks.sliding_window_view(text, self.order)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.concatenate(([0], np.cumsum(sizes + self.order - 1)[:-1]))
        firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        rows = np.arange(sizes.sum()) + np.repeat(starts - firsts, sizes)
        return np.add.reduceat(self.logp(windows[rows]), firsts, axis=0)


class Identifier:
    """Scores texts; word scores are kept in a bounded memo."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.rows: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def texts(self, texts: list[str]) -> list[tuple[str, float, bool, float | None]]:
        """lang_pred, score, accepted and cross-entropy of each."""
        split = [LETTERS.findall(t.lower()) for t in texts]
        known, model = self.known([w for words in split for w in words]), self.model
        out = []
        for words in split:
            if not words or not model.langs:
                out.append((UNKNOWN, 0.0, False, None))
                continue
            n = sum(map(len, words)) + len(words)
            entropy = -np.array([known[w] for w in words]).sum(axis=0) / n
            best = int(entropy.argmin())
            weight = np.exp(-SHARPNESS * (entropy - entropy[best]))
            out.append((model.langs[best], float(1 / weight.sum()), bool(entropy[best] <= model.limit(best, n)), float(entropy[best])))
        return out

    def known(self, words: list[str]) -> dict[str, tuple]:
        rows = self.rows
        new = [w for w in set(words) if w not in rows]
        for w in [w for w in new if w in self.older]:
            rows[w] = self.older[w]
        new = [w for w in new if w not in rows]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            rows.update(zip(part, map(tuple, self.model.words(part).tolist()), strict=True))
        if len(rows) > MEMO_WORDS:
            self.older = {w: r for w, r in rows.items() if len(w) <= 64}
            self.rows = {}
            return self.older | rows
        return rows


def train(counts: DataFrame, order: int = ORDER) -> Model:
    """The model of the counts (lang, gram, n), all of which reach the driver."""
    found = counts.toArrow()
    lang = found.column("lang").to_pylist()
    langs = sorted(set(lang))
    number = {x: i for i, x in enumerate(langs)}
    return Model(langs, np.array([number[x] for x in lang], np.int64), found.column("gram").to_pylist(), found.column("n").to_numpy(), order)


def own_entropies(model: Model, rows: DataFrame) -> DataFrame:
    """lang (its number), entropy, chars of the rows (text, lang) to which the model gives their own language."""
    shared, number = rows.sparkSession.sparkContext.broadcast(model), {x: i for i, x in enumerate(model.langs)}
    schema = pa.schema([("lang", pa.int32()), ("entropy", pa.float64()), ("chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(shared.value)
        for batch in pieces(batches):
            texts, out = batch.column("text").to_pylist(), []
            for text, lang, (found, _, _, entropy) in zip(texts, batch.column("lang").to_pylist(), identifier.texts(texts), strict=True):
                if found == lang:
                    out.append((number[lang], entropy, sum(len(w) + 1 for w in LETTERS.findall(text.lower()))))
            yield as_batch(out, schema)

    return rows.select("text", "lang").mapInArrow(run, "lang int, entropy double, chars long")


def limits(own: DataFrame) -> dict[int, tuple[float, float]]:
    """Mean cross-entropy and reach of each language (one row each), from its own texts (lang, entropy, chars)."""
    scored = cut_lineage(own.select("lang", "entropy", F.sqrt(F.least("chars", F.lit(STEADY_CHARS))).alias("root")))
    means = scored.groupBy("lang").agg(F.count("*").alias("n"), F.avg("entropy").alias("mean")).filter(F.col("n") >= CALIBRATION_TEXTS)
    far = (F.col("entropy") - F.col("mean")) * F.col("root")
    rows = scored.join(F.broadcast(means), "lang").groupBy("lang").agg(F.first("mean").alias("mean"), F.percentile_approx(far, 1 - REJECT_SHARE, 10_000).alias("reach")).collect()
    return {r["lang"]: (r["mean"], max(0.0, r["reach"])) for r in rows}


def calibrated(model: Model, rows: DataFrame) -> Model:
    """The model with limits from rows (text, lang) that it hasn't counted: those it gives their own language."""
    if model.langs and (found := limits(own_entropies(model, rows))):
        model.reach[:] = max(reach for _, reach in found.values())
        for i, (mean, reach) in found.items():
            model.mean[i], model.reach[i] = mean, reach
    return model


def identify_by_tables(rows: DataFrame, tables: Tables, to_calibrate: DataFrame) -> DataFrame:
    """As ``identify``, for rows (doc_id, text, held_out), by joins; to_calibrate has key, text and lang."""
    langs, size = F.array(*map(F.lit, tables.langs)), len(tables.langs)
    best = F.array_position("entropy", F.array_min("entropy")).cast("int")
    own = tables.entropies(to_calibrate.select("key", "text")).join(to_calibrate.select("key", "lang"), "key")
    own = own.filter(langs[best - 1] == F.col("lang")).select((best - 1).alias("lang"), F.array_min("entropy").alias("entropy"), "chars")
    found = limits(own)
    widest = max((reach for _, reach in found.values()), default=REJECT_DEFAULT * math.sqrt(STEADY_CHARS))
    means = tables.means() if len(found) < size else [0.0] * size
    mean, reach = zip(*[found.get(i, (means[i], widest)) for i in range(size)], strict=True)
    limit = F.array(*map(F.lit, mean))[best - 1] + F.array(*map(F.lit, reach))[best - 1] / F.sqrt(F.least("chars", F.lit(STEADY_CHARS))) + REJECT_MARGIN
    weight = F.aggregate("entropy", F.lit(0.0), lambda total, x: total + F.exp((x - F.array_min("entropy")) * -SHARPNESS))
    named, key = row_keys(rows)
    named = named.withColumn("key", F.col(key))
    lowest = F.array_min("entropy")
    scored = tables.entropies(named.select("key", "text")).select("key", langs[best - 1].alias("lang_pred"), (1 / weight).alias("score"), (lowest <= limit).alias("accepted"), lowest.alias("cross_entropy"))
    out = named.select("key", "doc_id", "held_out").join(scored, "key", "left")
    return out.select("doc_id", "held_out", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("accepted", F.lit(False)).alias("accepted"), "cross_entropy")


def identify(docs: DataFrame, *, order: int = ORDER, model_cells: int = MODEL_CELLS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the labelled rows outside the held-out fold, predict all rows.

    Of the rows to train on one in ``CALIBRATION_SHARE``, by a hash of its id,
    is not counted but sets the limits of rejection.  A model of at most
    ``model_cells`` (distinct n-grams times languages) is broadcast; a larger
    one stays in tables, with the same results up to rounding.
    Returns doc_id, held_out, lang_pred, score (0 to 1), accepted,
    cross_entropy (nats a character).  A null text, or one without a letter,
    is ``und`` with score 0, as is every text when no row is labelled.  Rows
    without an id are held out.  Repeated rows each give a row; other columns
    are not read.  No rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"), held_out(F.col(id_col)).alias("held_out"))
    labelled = rows.filter(~F.col("held_out") & F.col("lang").isNotNull())
    sets_limits = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 4) % CALIBRATION_SHARE == 0
    counts = cut_lineage(gram_counts(labelled.filter(~sets_limits).select("text", "lang"), order))
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if counts.select("gram").distinct().count() * len(langs) > model_cells:
        to_calibrate, key = row_keys(labelled.filter(sets_limits))
        return identify_by_tables(rows.select("doc_id", "text", "held_out"), Tables(counts, langs, order), to_calibrate.withColumn("key", F.col(key)))
    model = calibrated(train(counts, order), labelled.filter(sets_limits))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(shared.value)
        for batch in pieces(batches):
            found = zip(*identifier.texts(batch.column("text").to_pylist()), strict=True)
            arrays = [pa.array(c, f.type) for c, f in zip(found, list(SCHEMA)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *arrays], names=SCHEMA.names)

    return rows.select("doc_id", "text", "held_out").mapInArrow(run, DDL)

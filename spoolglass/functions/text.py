"""Text functions on columns, all inside the JVM but for ``similarity``.

Every class in a pattern is Unicode-aware (``(?U)``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from spoolglass.functions.arrays import bound
from spoolglass.functions.matching import ratios

# Limits, labels, texts and phrases that results have to agree on.
MIN_WORDS, MAX_WORDS, MAX_SENTENCES = 6, 300, 8
GENERIC_SUMMARY = "The specific subjects and actions are unclear."
GENERIC_EXCLUSION = "Specific subjects, actions, settings, identities, emotions, locations, and visible text are unverified."
STYLES = ("formal", "sarcastic", "humorous_tech", "humorous_non_tech")
SUFFIXES = {
    "sarcastic": "with the situation apparently taking itself very seriously",
    "humorous_tech": "while the visible action completes its runtime",
    "humorous_non_tech": "with all the confidence of a carefully planned outing",
}
PADDING = ("in", "the", "visible", "scene", "shown", "here.")
ABBREVIATIONS = "Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|Mt|vs|etc"
WORD = r"(?U)\b[\w'-]+\b"
REFUSALS = (
    r"\bas an ai\b",
    r"\bi cannot\b",
    r"\bi can't\b",
    r"\bi (?:am )?unable to\b",
    r"\bunable to (?:comply|provide|complete|help|assist)\b",
)
PLANNING = (
    r"\b(?:the user (?:wants|asked|requests)|let me (?:analyze|reason|plan|think|draft|write|find|craft|compose)"
    r"|plan my caption|key facts|hard exclusions|target style|trusted narrative|chronology from"
    r"|analysis of (?:the )?evidence|i (?:should|need to|will) (?:write|draft|use|frame))\b",
    r"(?:^|\n)\s*\d+[.)]\s+",
    r"(?:^|\n)\s*[-*+]\s+",
)
MARKDOWN = (r"`", r"^\s{0,3}#{1,6}\s+", r"(?:^|\n)\s*[-*+]\s+", r"\*\*[^*]+\*\*", r"__[^_]+__", r"\[[^\]]+\]\([^)]+\)")
JSON_PIECES = (r"^\s*[\{\[]", r"[\}\]]\s*$", r"[\"']\s*[A-Za-z_][A-Za-z0-9_ -]*\s*[\"']\s*:")
COMPLETE = r"[.!?][\"']?$"
DANGLING = r"\b(?:who|which|that|because|although|while|when|until|unless|and|or|but|so|just|as if|as though)\s*[.!?][\"']?$"
TRANSIENT = ("http 429", "http 500", "http 502", "http 503", "http 504", "upstream_network_error", "temporary failure", "connection reset", "remote end closed connection", "timed out")

MARK = "\x00"


def collapsed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def matches_any(c: Column, patterns: tuple[str, ...], flags: str = "U") -> Column:
    found = c.rlike(f"(?{flags}){patterns[0]}")
    for p in patterns[1:]:
        found = found | c.rlike(f"(?{flags}){p}")
    return found


def word_count(c: Column) -> Column:
    """Words of letters, digits, apostrophes and hyphens: the linter's count."""
    return F.regexp_count(c, F.lit(WORD))


def token_count(c: Column) -> Column:
    """Tokens between white space: the summary's count."""
    one = collapsed(c)
    return F.when(one == "", F.lit(0)).otherwise(F.size(F.split(one, " ")))


def sentences(c: Column) -> Column:
    """Sentences of a text; decimals, abbreviations and initials don't end one.  Null and blank texts have none."""
    t = stripped(F.coalesce(c, F.lit("")))
    t = F.regexp_replace(t, r"(?U)(\d)\.(\d)", f"$1{MARK}$2")
    t = F.regexp_replace(t, rf"(?iU)\b({ABBREVIATIONS})\.", f"$1{MARK}")
    # A run of initials: each that another follows, then the last one.
    t = F.regexp_replace(t, r"(?U)\b([A-Z])\.(?=\s*\b[A-Z]\.)", f"$1{MARK}")

    def with_last(t: Column) -> Column:
        last = F.regexp_replace(t, rf"(?U)(?<=\b[A-Z]{MARK}\s{{0,99}})\b([A-Z])\.", f"$1{MARK}")
        return F.when(t.rlike(f"[A-Z]{MARK}"), last).otherwise(t)  # the look-behind is slow, and few texts have initials

    t = bound(t, with_last)
    t = F.regexp_replace(t, r"(?U)\b([A-Z])\.(?=\s+[A-Z][A-Za-z'-]+)", f"$1{MARK}")
    parts = F.regexp_extract_all(t, F.lit(r"(?U)[^.!?]+[.!?]+(?:[\"'](?=\s|\z))?|[^.!?]+\z"), F.lit(0))
    return F.filter(F.transform(parts, lambda s: stripped(F.translate(s, MARK, "."))), lambda s: s != "")


def normal_label(c: Column) -> Column:
    return F.regexp_replace(F.lower(stripped(c)), r"(?U)[\s-]+", "_")


def has_style_prefix(c: Column, style: Column) -> Column:
    """The text before the first colon, of 32 characters at most, is the style or any known label."""
    head = F.substring_index(c, ":", 1)
    label = normal_label(head)
    return F.contains(c, F.lit(":")) & (F.length(head) <= 32) & ((label == normal_label(style)) | label.isin(*STYLES))


def lint_reasons(caption: Column, style: Column | None = None) -> Column:
    """All reasons against a caption, in a fixed order; a null caption is not a string, a blank one is empty."""
    def found(t: Column) -> Column:
        rules = [
            (word_count(t) < MIN_WORDS, "caption is too short"),
            (word_count(t) > MAX_WORDS, "caption is too long"),
            (F.size(sentences(t)) > MAX_SENTENCES, "caption has too many sentences"),
            (matches_any(t, MARKDOWN), "caption must not contain markdown"),
            (matches_any(t, JSON_PIECES), "caption must not contain JSON fragments"),
            (matches_any(t, REFUSALS, "iU"), "caption must not contain refusal text"),
            (matches_any(t, PLANNING, "iU"), "caption must not expose reasoning or planning"),
            (~t.rlike(f"(?U){COMPLETE}") | t.rlike(f"(?iU){DANGLING}"), "caption must be a complete sentence"),
        ]
        if style is not None:
            rules.append((has_style_prefix(t, style), "caption must not start with a style label"))
        reasons = F.array_compact(F.array(*[F.when(rule, F.lit(reason)) for rule, reason in rules]))
        return F.when(t == "", F.array(F.lit("caption must be non-empty"))).otherwise(reasons)

    return F.when(caption.isNull(), F.array(F.lit("caption must be a string"))).otherwise(bound(stripped(caption), found))


def lint_value(value: Column, style: Column | None = None) -> Column:
    """``lint_reasons`` of a VARIANT: a number, boolean, list, object or null is not a string."""
    text = F.try_variant_get(value, "$", "string")
    return lint_reasons(F.when(F.schema_of_variant(value) == "STRING", text), style)


def clean_summary(c: Column, max_words: Column | int = MAX_WORDS) -> Column:
    """Whole sentences of a summary up to a number of words and eight sentences; generic if it is no prose."""
    most = max_words if isinstance(max_words, Column) else F.lit(max_words)

    def prose(t: Column) -> Column:
        bad = (t == "") | F.substring(t, 1, 1).isin("{", "[") | F.contains(t, F.lit("`")) | t.rlike(r"(?U)[\"']?factual_summary[\"']?\s*:")
        return F.when(bad, F.lit(GENERIC_SUMMARY)).otherwise(t)

    def step(acc: Column, s: Column) -> Column:
        tokens = F.split(collapsed(s), " ")
        over = acc["n"] + F.size(tokens) > most
        short = F.concat(F.regexp_replace(F.array_join(F.slice(tokens, F.lit(1), most), " "), r"[ ,;:\-.!?]+\z", ""), F.lit("."))
        taken = (
            F.when(acc["full"], acc["taken"])
            .when(over & (F.size(acc["taken"]) == 0), F.array(short))
            .when(over, acc["taken"])
            .otherwise(F.concat(acc["taken"], F.array(s)))
        )
        return F.struct(taken.alias("taken"), F.when(acc["full"] | over, acc["n"]).otherwise(acc["n"] + F.size(tokens)).alias("n"), (acc["full"] | over).alias("full"))

    def kept(parts: Column, t: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("taken"), F.lit(0).alias("n"), F.lit(False).alias("full"))
        parts = F.slice(F.when(F.size(parts) == 0, F.array(t)).otherwise(parts), 1, MAX_SENTENCES)
        return stripped(F.array_join(F.aggregate(parts, start, step)["taken"], " "))

    def finished(out: Column) -> Column:
        tokens = F.filter(F.split(collapsed(out), " "), lambda w: w != "")
        n = F.size(tokens)
        padded = F.array_join(F.concat(tokens, F.slice(F.array(*map(F.lit, PADDING)), F.lit(1), F.greatest(F.lit(0), F.lit(6) - n))), " ")
        return F.when(n < 6, padded).otherwise(out)

    def closed(out: Column) -> Column:
        return F.when(F.substring(out, -1, 1).isin(".", "!", "?"), out).otherwise(F.concat(out, F.lit(".")))

    text = bound(collapsed(F.coalesce(F.when(c == "", None).otherwise(c), F.lit(GENERIC_SUMMARY))), prose)
    out = bound(text, lambda t: bound(sentences(t), lambda parts: kept(parts, t)))
    return bound(bound(out, finished), closed)


def suffix_of(style: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), style)


def fallback_caption(style: Column, summary: Column, cleaned: Column | None = None) -> Column:
    """The caption of a style when nothing better is there; unknown styles get the cleaned summary.

    cleaned: ``clean_summary(summary)`` where it is known already.  A summary
    that has room for the suffix is the same under the suffix's limit, so it is
    cleaned again only if it is too long.
    """

    def with_suffix(base: Column) -> Column:
        def of(suffix: Column) -> Column:
            most = F.lit(MAX_WORDS) - word_count(suffix)
            short = F.when(token_count(base) <= most, base).otherwise(clean_summary(summary, most))
            return F.when(suffix.isNull(), base).otherwise(F.concat(F.regexp_replace(short, r"[.!?]+\z", ""), F.lit(", "), suffix, F.lit(".")))

        return bound(suffix_of(style), of)

    return with_suffix(cleaned) if cleaned is not None else bound(clean_summary(summary), with_suffix)


def avoid_excerpt(c: Column, limit: int = 600) -> Column:
    t = collapsed(c)
    cut = F.left(t, F.lit(limit))
    at_word = F.regexp_replace(F.regexp_extract(cut, r"(?s)^(.*) ", 1), r"(?U)\s+\z", "")
    return F.when(F.length(t) <= limit, t).when(at_word == "", cut).otherwise(at_word)


def safe_excerpt(body: Column, access_id: Column | None = None, limit: int = 500) -> Column:
    """A response body for a log: stripped, an access id hidden, cut; never blank."""
    t = stripped(body)
    if access_id is not None:
        t = F.when(F.coalesce(access_id, F.lit("")) == "", t).otherwise(F.replace(t, access_id, F.lit("[redacted]")))
    cut = F.left(t, F.lit(limit))
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit("empty response body")).otherwise(cut)


def is_transient(message: Column) -> Column:
    low = F.lower(message)
    found = F.contains(low, F.lit(TRANSIENT[0]))
    for marker in TRANSIENT[1:]:
        found = found | F.contains(low, F.lit(marker))
    return found


def prefix_similarity(left: Column, right: Column) -> Column:
    """Equal tokens at the start, of at most eight, over the shorter side's (lower case)."""
    a, b = (F.slice(F.filter(F.split(collapsed(F.lower(x)), " "), lambda w: w != ""), 1, 8) for x in (left, right))
    n = F.least(F.size(a), F.size(b))
    same = F.transform(F.arrays_zip(F.slice(a, F.lit(1), n).alias("l"), F.slice(b, F.lit(1), n).alias("r")), lambda z: z["l"] == z["r"])
    first = F.array_position(same, False)
    shared = F.when(first == 0, n.cast("long")).otherwise(first - 1)
    return shared / F.greatest(F.lit(1), n)


def folded(text: str) -> str:
    return " ".join(text.lower().split())


@F.pandas_udf(DoubleType())
def sequence_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """The larger of the matching ratios of characters and of tokens; the order of the sides matters."""
    pairs = [None if a is None or b is None else (folded(a), folded(b)) for a, b in zip(left, right, strict=True)]
    known = [p for p in pairs if p is not None]
    found = iter(np.maximum(ratios(known), ratios([(a.split(), b.split()) for a, b in known])).tolist())
    return pd.Series([None if p is None else next(found) for p in pairs], dtype="float64")


def similarity(left: Column, right: Column) -> Column:
    return F.greatest(sequence_similarity(left, right), prefix_similarity(left, right))

import re
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spoolglass.functions import text as T


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


CASES = [
    "A dog runs.",
    "Dr. Smith paid 3.50 to J. R. Smith in the U.S. yesterday. He left!",
    "One. Two? Three! \"Four.\" 'Five.' six",
    "Mr. X met St. John vs. etc. and left.",
    "We stopped in Köln an der Öst. Then we went on.",
    "",
    "   \n\t ",
    "No end at all",
    "A. B. C. D went home. E. Flynn stayed.",
    "it's a well-known ‘fact’ – naïve café 42 _x_",
]


def plain_sentences(value):
    """The rules, in plain Python: what ends a sentence and what doesn't."""
    text = value.strip()
    keep = set()
    for m in re.finditer(r"(?<=\d)\.(?=\d)", text):
        keep.add(m.start())
    for m in re.finditer(r"\b(?:mr|mrs|ms|dr|prof|sr|jr|st|mt|vs|etc)\.", text, re.I):
        keep.add(m.end() - 1)
    for m in re.finditer(r"(?:\b[A-Z]\.\s*){2,}", "".join("\0" if i in keep else c for i, c in enumerate(text))):
        keep |= {i for i in range(m.start(), m.end()) if text[i] == "."}
    for m in re.finditer(r"\b[A-Z]\.(?=\s+[A-Z][A-Za-z'-]+)", text):
        if m.end() - 1 not in keep:
            keep.add(m.end() - 1)
    masked = "".join("\0" if i in keep else c for i, c in enumerate(text))
    out, at = [], 0
    for m in re.finditer(r"[^.!?]+[.!?]+(?:[\"'](?=\s|$))?|[^.!?]+$", masked):
        out.append(text[m.start() : m.end()].strip())
    return [s for s in out if s]


def test_sentences(spark):
    assert column(spark, CASES, T.sentences) == [plain_sentences(c) for c in CASES]


def test_counts(spark):
    assert column(spark, CASES, T.word_count) == [len(re.findall(r"\b[\w'-]+\b", c)) for c in CASES]
    assert column(spark, CASES, T.token_count) == [len(c.split()) for c in CASES]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="aB.É 1'-!?\n _`{", max_size=40), min_size=20, max_size=20))
def test_text_properties(spark, values):
    assert column(spark, values, T.collapsed) == [" ".join(v.split()) for v in values]
    assert column(spark, values, T.stripped) == [v.strip() for v in values]
    assert column(spark, values, T.word_count) == [len(re.findall(r"\b[\w'-]+\b", v)) for v in values]


GOOD = "A calm dog walks along the quiet street."
REASONS = [
    (None, ["caption must be a string"]),
    ("  ", ["caption must be non-empty"]),
    ("Only five words are here.", ["caption is too short"]),
    ("Here are six words in all.", []),
    (" ".join(["word"] * 299) + " end.", []),
    (" ".join(["word"] * 300) + " end.", ["caption is too long"]),
    ("One two. " * 8, []),
    ("One two. " * 9, ["caption has too many sentences"]),
    ("A `quoted` dog walks along the street.", ["caption must not contain markdown"]),
    ("A **bold** dog walks along the street.", ["caption must not contain markdown"]),
    ("A [dog](x) walks along the quiet street.", ["caption must not contain markdown"]),
    ("First a line follows here\n- then a bullet of words.", ["caption must not contain markdown", "caption must not expose reasoning or planning"]),
    ('A dog says "name": all along the street.', ["caption must not contain JSON fragments"]),
    ("{ A dog walks along the quiet street.", ["caption must not contain JSON fragments"]),
    ("As an AI the dog walks along the street.", ["caption must not contain refusal text"]),
    ("I can't say where the dog walks now.", ["caption must not contain refusal text"]),
    ("Let me think about where the dog walks.", ["caption must not expose reasoning or planning"]),
    ("1) The dog walks along the quiet street.", ["caption must not expose reasoning or planning"]),
    ("A calm dog walks along the quiet street", ["caption must be a complete sentence"]),
    ("A calm dog walks along the street while.", ["caption must be a complete sentence"]),
    ('A calm dog said "walk along the street."', []),
    ("Formal: a dog walks along the quiet street.", ["caption must not start with a style label"]),
    ("My-Style: a dog walks along the quiet street.", ["caption must not start with a style label"]),
    (GOOD, []),
]


def test_lint(spark):
    assert column(spark, [c for c, _ in REASONS], lambda c: T.lint_reasons(c, F.lit("my style"))) == [r for _, r in REASONS]


def test_label_length_boundary(spark):
    long, short = "x" * 33 + ": y", "x" * 32 + ": y"
    assert column(spark, [long, short], lambda c: T.has_style_prefix(c, F.lit("x" * 33))) == [False, False]
    assert column(spark, [short], lambda c: T.has_style_prefix(c, F.lit("x" * 32))) == [True]


SUMMARIES = [
    (None, 300, T.GENERIC_SUMMARY),
    ("", 300, T.GENERIC_SUMMARY),
    ("  ", 300, T.GENERIC_SUMMARY),
    ("{x} y", 300, T.GENERIC_SUMMARY),
    ('say "factual_summary" : x', 300, T.GENERIC_SUMMARY),
    ("A dog runs.", 300, "A dog runs. in the visible."),
    ("Six words are in this one", 300, "Six words are in this one."),
    ("one two three four five six seven, eight nine. ten.", 7, "one two three four five six seven."),
    ("One two three four five six. Seven eight. Nine.", 8, "One two three four five six. Seven eight."),
    ("One two three four five six. Seven eight. Nine.", 7, "One two three four five six."),
    ("a b. " * 10, 300, " ".join(["a b."] * 8)),
]


def test_summaries(spark):
    for text, most, expected in SUMMARIES:
        assert column(spark, [text], lambda c, m=most: T.clean_summary(c, m)) == [expected]


def test_fallbacks(spark):
    found = column(spark, list(T.STYLES) + ["other"], lambda c: T.fallback_caption(c, F.lit("The cat sits on the red mat!")))
    assert found == ["The cat sits on the red mat!"] + [f"The cat sits on the red mat, {T.SUFFIXES[s]}." for s in T.STYLES[1:]] + ["The cat sits on the red mat!"]


def test_excerpts(spark):
    long = "word " * 200
    assert column(spark, ["a  b", long, "x" * 700], T.avoid_excerpt) == ["a b", ("word " * 120)[:600].rsplit(" ", 1)[0].rstrip(), "x" * 600]
    assert column(spark, [" \n", "my key is key", "y" * 600, None], lambda c: T.safe_excerpt(c, F.lit("key"))) == ["empty response body", "my [redacted] is [redacted]", "y" * 500, "empty response body"]


PAIRS = [("tide", "diet"), ("diet", "tide"), ("a b c d", "a b x d"), ("", ""), ("Same Text", "same  text"), ("ab" * 150, "ba" * 150), ("one two three four five six seven eight nine", "one two three four five six seven eight ten")]


def test_similarity(spark):
    def plain(a, b):
        a, b = " ".join(a.lower().split()), " ".join(b.lower().split())
        x, y = a.split(), b.split()
        same = 0
        while same < min(8, len(x), len(y)) and x[same] == y[same]:
            same += 1
        return max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, x, y).ratio(), same / max(1, min(8, len(x), len(y))))

    rows = spark.createDataFrame(PAIRS, "a string, b string").select(T.similarity(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in rows] == pytest.approx([plain(*p) for p in PAIRS])


def test_transient(spark):
    assert column(spark, ["HTTP 429", "http 404", "Connection Reset", "timed out"], T.is_transient) == [True, False, True, True]


def test_ratios_are_difflibs():
    """with the sizes at which difflib leaves out popular elements, repeated ones, and words."""
    import random
    from difflib import SequenceMatcher

    from spoolglass.functions.matching import LONGEST, ratios

    r, pairs = random.Random(5), [("", ""), ("a", ""), ("ab" * LONGEST, "ba" * 60), ("a" * 500, "a" * 300)]
    for _ in range(400):
        a, b = ("".join(r.choice(letters) for _ in range(r.choice((1, 7, 60, 199, 200, 420)))) for letters in [r.choice(("ab", "abcdefgh é\U0001f600"))] * 2)
        pairs.append((a, b if r.random() < 0.6 else a[len(a) // 3 :] + b[:20]))
    assert ratios(pairs).tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    words = [(a.split(), b.split()) for a, b in pairs]
    assert ratios(words).tolist() == [SequenceMatcher(None, a, b).ratio() for a, b in words]


def test_pairs_are_dealt_out(spark):
    from spoolglass.functions.text import prefix_similarity
    from spoolglass.operators.captions import caption_pairs

    rows = spark.createDataFrame([(i, p, f"s{p}", "x y") for i in range(20) for p in range(2)], "task_id int, style_pos int, style string, caption string").coalesce(1)
    assert caption_pairs(rows, "task_id", "style_pos", prefix_similarity).select(F.spark_partition_id()).distinct().count() > 1

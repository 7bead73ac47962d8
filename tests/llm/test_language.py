import random
import zlib
from collections import Counter

import numpy as np
from conftest_llm import ODD

from spoolglass.llm.language import STEADY_CHARS, Identifier, Model, calibrated, hashes, identify, train
from spoolglass.llm.language_counts import CLOSE, DISCOUNT, OPEN, gram_counts, grams_of


def test_model_matches_the_definition():
    """Interpolated Kneser-Ney by dictionaries, for one language."""
    r = random.Random(1)
    tokens = ["".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(80)]
    order, grams = 3, {}
    for w in tokens:
        text = OPEN * (order - 1) + w + CLOSE
        for i in range(len(w) + 1):
            grams[text[i : i + order]] = grams.get(text[i : i + order], 0) + 1
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    vocabulary = len({g[-1] for g in grams})

    def p(g):
        own = {x: n for x, n in counts[len(g)].items() if x[:-1] == g[:-1]}
        lower = p(g[1:]) if len(g) > 1 else 1 / (vocabulary + 1)
        if not own:
            return lower
        total = sum(own.values())
        return max(own.get(g, 0) - DISCOUNT, 0) / total + DISCOUNT * len(own) / total * lower

    model = Model(["xx"], np.zeros(len(grams), np.int64), list(grams), np.array(list(grams.values())), order)
    wanted = [*grams, "aaa", "abz", "zzz", "zab", OPEN * 2 + "q", "cba"]
    codes = np.frombuffer("".join(wanted).encode("utf-32-le"), np.uint32).reshape(-1, order)
    assert np.allclose(model.logp(codes)[:, 0], [np.log(p(g)) for g in wanted], atol=1e-5)
    words = model.words(["ab", "cccc", "a"])[:, 0]
    assert np.isclose(words[0], sum(np.log(p((OPEN * 2 + "ab" + CLOSE)[i : i + 3])) for i in range(3)), atol=1e-4)
    assert all(np.all(np.diff(level.keys.astype(np.float64)) >= 0) for level in model.levels)
    assert len(np.unique(hashes(codes))) == len(set(wanted))


def corpus(n=400):
    r = random.Random(3)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["ou", "che", "lle"], "cc": ["stra", "unk", "ei"]}
    lang = {i: r.choice(list(parts)) for i in range(n)}
    return [(i, " ".join("".join(r.choice(parts[lang[i]]) for _ in range(r.randrange(1, 4))) for _ in range(20))) for i in range(n)], lang


def test_held_out_accuracy(spark, table):
    docs, lang = corpus()
    odd = [(i + 5000 if i else i, t) for i, t in ODD] + [(6000, "12 34!"), (6001, "zzqq xxyy wwvv " * 20)]
    rows = identify(table(docs + odd, lang.get)).collect()
    assert len(rows) == len(docs) + len(odd)
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.doc_id in lang and r.held_out]
    assert len(held) > 50
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.accepted for r in held]) > 0.97
    assert {r.accepted for r in rows if r.lang_pred == "und"} == {False}
    by = {r.doc_id: r for r in rows}
    assert [by[i].lang_pred for i in (5001, 5002, 5003, 6000)] == ["und"] * 4
    assert by[6001].lang_pred in ("aa", "bb", "cc") and not by[6001].accepted


def test_tables_give_what_the_broadcast_model_gives(spark, table):
    docs, lang = corpus(700)
    lang |= {9000: "dd", 9003: "dd", 9004: "dd"}  # a language without limits of its own
    strange = [(9000, "zu za zo"), (9003, "zo zi"), (9004, "za zi zu"), (6000, "12 34!"), (6001, "zzqq xxyy " * 20), (6002, "ka" * 4000 + " lo mi"), (6003, "\U00020000\U00020001 é 漢字²")]
    odd = [(i + 5000 if i else i, t) for i, t in ODD]
    rows = table(docs + odd + strange + docs[:3], lang.get)
    order = ("doc_id", "cross_entropy", "held_out")
    small = identify(rows).orderBy(*order).collect()
    tables = identify(rows, model_cells=0).orderBy(*order).collect()
    assert len(tables) == len(small) == len(docs) + len(odd) + len(strange) + 3
    assert {r.lang_pred for r in small} >= {"aa", "bb", "cc", "dd", "und"}
    for a, b in zip(small, tables, strict=True):
        assert (a.doc_id, a.held_out, a.lang_pred, a.accepted) == (b.doc_id, b.held_out, b.lang_pred, b.accepted)
        assert np.isclose(a.score, b.score, atol=1e-3)
        assert a.cross_entropy == b.cross_entropy or np.isclose(a.cross_entropy, b.cross_entropy, atol=1e-4)


def test_no_labels(spark, table):
    assert {r.lang_pred for r in identify(table(ODD)).collect()} == {"und"}
    assert identify(table([])).count() == 0
    assert identify(table([]), model_cells=0).count() == 0


def test_model_holds_every_gram(spark):
    r = random.Random(9)
    rows = [(" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(1500)), lang) for lang in ("aa", "bb", "cc")]
    expected = {lang: Counter() for _, lang in rows}
    for text, lang in rows:
        grams_of(Counter(text.split()), 4, expected[lang])
    model = train(gram_counts(spark.createDataFrame(rows, "text string, lang string")))
    assert len(model.levels[-1].keys) == len(set().union(*expected.values()))
    found = {lang: Counter({r.gram: r.n for r in gram_counts(spark.createDataFrame([(t, x) for t, x in rows if x == lang], "text string, lang string")).collect()}) for lang in expected}
    assert found == expected


def test_limits_come_from_rows_that_are_not_counted(spark):
    docs, lang = corpus(900)
    rows = [(t, lang[i]) for i, t in docs]
    frame = lambda part: spark.createDataFrame(part, "text string, lang string")
    model = calibrated(train(gram_counts(frame(rows[:400]))), frame(rows[400:700]))
    for i, name in enumerate(model.langs):
        own = [t for t, x in rows[400:700] if x == name]
        found = [r for r in Identifier(model).texts(own) if r[0] == name]
        assert np.isclose(model.mean[i], np.mean([r[3] for r in found]))
        sizes = [min(STEADY_CHARS, sum(len(w) + 1 for w in t.split())) for t in own]
        far = sorted((r[3] - model.mean[i]) * n**0.5 for r, n in zip(found, sizes, strict=True))
        assert far[-3] <= model.reach[i] <= far[-1] + 1e-9
    rest = Identifier(model).texts([t for t, _ in rows[700:]])
    assert np.mean([r[2] for r in rest]) >= 0.98  # other texts of the languages
    r = random.Random(4)
    strange = [" ".join("".join(r.choices("bcdfghjklmnpqrstvwxz", k=6)) for _ in range(20)) for _ in range(50)]
    assert not any(x[2] for x in Identifier(model).texts(strange))


def test_counts_of_all_languages_together(spark):
    docs, lang = corpus(300)
    expected = {}
    for i, t in docs:
        grams_of(Counter(t.split()), 4, expected.setdefault(lang[i], Counter()))
    rows = spark.createDataFrame([(t, lang[i]) for i, t in docs], "text string, lang string").repartition(7)
    assert {(r.lang, r.gram): r.n for r in gram_counts(rows).collect()} == {(x, g): n for x, c in expected.items() for g, n in c.items()}

import hashlib
import random
import re

import pytest
from conftest_llm import ODD, words

from spoolglass.llm.decontamination import clean_documents, contamination


def tokens(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(docs, items):
    out, windows = [], {}
    for item, passage in items:
        p = tokens(passage)
        n = min(10, len(p))
        for i in range(len(p) - n + 1 if n else 0):
            windows.setdefault(tuple(p[i : i + n]), set()).update(() if item is None else (str(item),))
    for doc, text in docs:
        t, hit, found = tokens(text), set(), set()
        for n in range(1, 11):
            for i in range(len(t) - n + 1):
                if (w := tuple(t[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[w]
        out.append((doc, len(t), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def cases():
    r = random.Random(3)
    items = [(i, " ".join(words(r.choice((3, 9, 10, 11, 30)), 50 + i, 400)) + ".") for i in range(40)]
    items.append((80, " ".join(words(2500, 12, 400))))  # longer than a block, where blocks are small
    docs_of_long = [(400 + k, " ".join(items[-1][1].split()[a : a + 25])) for k, a in enumerate(range(0, 2480, 61))]
    items += [(90, None), (91, " !"), (None, "no id but " + " ".join(words(12, 9))), (92, items[0][1]), (92, items[5][1]), (93, "one"), (94, "two words")]
    docs = list(ODD)
    for k in range(60):
        t = words(80, 1000 + k, 400)
        for _ in range(r.randrange(3)):
            p = items[r.randrange(40)][1].upper().split()
            a = r.randrange(len(p))
            at = r.randrange(len(t))
            t[at:at] = p[a : a + r.choice((9, 10, 12, 30))]
        docs.append((100 + k, ", ".join(t)))
    docs += docs_of_long
    docs += [(300, "one"), (301, "two. WORDS one"), (302, "words two")]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_hits_match_brute_force(spark, table, block_bytes):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item")
    found = contamination(table(docs), bench, block_bytes=block_bytes)
    expected = brute(docs, items)
    assert sorted(map(tuple, found.collect()), key=repr) == expected
    frame = table(docs).selectExpr("*", "1 AS own_id", "2 AS digest")
    left = clean_documents(frame, bench, block_bytes=block_bytes)
    assert left.columns == frame.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((r[0] for r in expected if not r[5]), key=repr)


def test_empty_tables(spark, table):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(table([]), none).count() == 0
    assert [tuple(r)[1:4] for r in contamination(table([(1, "a b")]), none).collect()] == [(2, 0, 0)]

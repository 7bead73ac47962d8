import hashlib
import random

import pytest

from spoolglass.llm.chat import as_reply_chain, escaped, format_conversations, formatted_turn, parsed_turns, paths, read_back, unescaped

TREE = "tree_id long, node_id long, parent_id long, score double, role string, text string"


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|x", "<\\\\||<|", "<", "a\n<|im_start|>assistant\n", "é "])
def test_escapes_are_reversible(text):
    assert "<|" not in escaped(text) and unescaped(escaped(text)) == text
    assert parsed_turns(formatted_turn(text, text)[0] * 2) == [(text, text)] * 2


def brute_paths(rows, branches):
    out, trees = set(), {}
    for t, n, p, s, *_ in rows:
        if n is not None:
            old = trees.setdefault(t, {}).get(n)
            new = (p is not None, p or 0, s or 0.0)
            trees[t][n] = min(old, new) if old else new
    for t, nodes in trees.items():
        up = {n: (x[1] if x[0] and x[1] in nodes else None) for n, x in nodes.items()}
        found = []
        for leaf in set(nodes) - set(up.values()):
            walk, n = [], leaf
            while n is not None and n not in walk:
                walk.append(n)
                n = up[n]
            if n is None:
                found.append((-sum(nodes[x][2] for x in walk), leaf, walk[::-1]))
        for b, (_, _, walk) in enumerate(sorted(found)[:branches], 1):
            out |= {(t, b, n, d) for d, n in enumerate(walk)}
    return out


def test_paths_match_brute_force(spark):
    r = random.Random(4)
    rows = []
    for t in range(8):
        for n in range(1, r.randrange(2, 40)):
            rows.append((t, n, r.randrange(0, n) or None, r.choice((None, 0.0, 1.0, 2.0)), "user", "t"))
    rows += [(50, n, n - 1 if n else None, 1.0, "user", "t") for n in range(75)]  # a long chain
    rows += [(60, 1, 2, 1.0, "a", "t"), (60, 2, 1, 1.0, "a", "t"), (60, 3, 2, 1.0, "a", "t"), (60, 4, None, 0.0, "a", "t")]  # a cycle
    rows += [(61, 1, 99, 1.0, "a", "t"), (None, 1, None, 1.0, "a", "t"), (None, 2, 1, 1.0, "a", "t"), (62, None, None, 1.0, "a", "t"), (63, 1, None, 1.0, "a", "t"), (63, 1, None, 1.0, "a", "t")]
    df = spark.createDataFrame(rows, TREE).selectExpr("*", "1 AS branch", "2 AS depth")
    for branches in (1, 3):
        assert set(map(tuple, paths(df, branches=branches).collect())) == brute_paths(rows, branches)
    assert paths(spark.createDataFrame([], TREE)).count() == 0


def test_conversations(spark):
    nasty = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "é <|x|>"), (1, 2, "assistant", None), (2, 5, None, None), (-1, 0, "user", nasty), (-1, 1, "assistant", nasty), (3, None, "user", "a"), (3, 0, "user", "b"), (3, 0, "user", "b"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS node_id", "2 AS depth")
    found = {r.conv_id: r for r in read_back(format_conversations(as_reply_chain(df))).collect()}
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        by.setdefault(c, []).append((role or "", text or ""))
    assert set(found) == set(by)
    for c, turns in by.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        size = sum(len(formatted_turn(*x)[0]) for x in turns)
        assert tuple(found[c])[1:] == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), size)
    assert read_back(format_conversations(as_reply_chain(df.limit(0)))).count() == 0
    # Conversations in many rows, which come in any order, give the same.
    split = format_conversations(as_reply_chain(df), part_chars=5)
    assert split.filter("part > 0").count() > 3
    assert {r.conv_id: r for r in read_back(split.orderBy("part", "tree_id")).collect()} == found


def test_a_path_is_one_conversation(spark):
    rows = [(1, 0, None, 0.0, "system", "s"), (1, 1, 0, 1.0, "user", "u"), (1, 2, 1, 5.0, "assistant", "<|best|>"), (1, 3, 1, 2.0, "assistant", "other"), (2, 7, None, None, None, None)]
    df = spark.createDataFrame(rows, TREE).selectExpr("*", "1 AS branch", "2 AS depth", "3 AS part", "4 AS formatted", "5 AS last")
    found = sorted(format_conversations(df, branches=2).collect(), key=lambda r: (r.tree_id, r.branch))
    assert [(r.tree_id, r.branch, r.part, r.last, r.n_turns) for r in found] == [(1, 1, 0, True, 3), (1, 2, 0, True, 3), (2, 1, 0, True, 1)]
    assert parsed_turns(found[0].formatted) == [("system", "s"), ("user", "u"), ("assistant", "<|best|>")]
    assert [unescaped(found[0].formatted[a:b]) for a, b in zip(found[0].mask_starts, found[0].mask_ends)] == ["<|best|>"]
    assert found[1].formatted.endswith("other<|im_end|>\n") and found[2].mask_starts == []


def test_a_very_long_conversation_and_a_giant_tree(spark):
    n = 3000
    chain = spark.range(n).selectExpr("7 AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('<|x', 40) AS text")
    found = read_back(format_conversations(as_reply_chain(chain), part_chars=10_000)).collect()
    text = "<|x" * 40
    said = "".join(f"{('user', 'assistant')[i % 2]}\n{text}\n" for i in range(n))
    assert [(r.n_turns, r.turns_sha256, r.loss_chars) for r in found] == [(n, hashlib.sha256(said.encode()).hexdigest(), n // 2 * len(text))]
    tree = spark.range(1, 20_000).selectExpr("1L AS tree_id", "id AS node_id", "if(id = 1, null, id div 2) AS parent_id", "cast(id as double) AS score", "'user' AS role", "'t' AS text")
    best = max(range(10_000, 20_000), key=lambda i: (sum(i >> k for k in range(i.bit_length())), -i))
    walk = [best >> k for k in reversed(range(best.bit_length()))]
    assert [r.node_id for r in paths(tree).orderBy("depth").collect()] == walk

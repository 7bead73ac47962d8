import random

import numpy as np
import xxhash
from conftest_llm import ODD, words

from spoolglass.llm.common import Bloom
from spoolglass.llm.graph import components
from spoolglass.llm.repeats import WordMemo
from spoolglass.llm.simhash import KINDS, BKTree, Parities, WordPrints, fingerprint, first_of_similar, in_block_pairs, jaccard, near_duplicates, parity, part_prints, shingle_set, similar_documents


def brute_print(text, size=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    tokens = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in lower).split(" ") if w]
    shingles = [" ".join(tokens[i : i + size]) for i in range(max(1, len(tokens) - size + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if root(j) == root(i) and d is not None]
        out.append((doc, f"{prints[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def corpus():
    rows, r = list(ODD), random.Random(5)
    for g in range(12):
        base = words(400, g, 60)
        for k in range(8):
            copy = list(base)
            for _ in range(k // 2):
                copy[r.randrange(len(copy))] = "edit"
            rows.append((100 + g * 10 + k, " ".join(copy)))
    return rows


def test_fingerprints():
    for _, text in ODD:
        assert int.from_bytes(fingerprint(text or "")) == brute_print(text)


def test_components_match_brute_force(spark, table):
    rows = corpus()
    expected = brute_components(rows)
    assert sorted(map(tuple, near_duplicates(table(rows)).collect()), key=repr) == expected
    # Shards over the limit are dealt again by other bits: the result stays the same.
    assert sorted(map(tuple, near_duplicates(table(rows), shard_limit=3).collect()), key=repr) == expected
    # Shards over the limit after the last dealing: trees are broadcast in blocks.
    assert sorted(map(tuple, near_duplicates(table(rows), shard_limit=1, tree_block=20).collect()), key=repr) == expected
    assert near_duplicates(table([])).count() == 0


def test_tree_follows_edges_within_the_radius():
    r = random.Random(1)
    values = list(dict.fromkeys(r.getrandbits(14) for _ in range(400)))
    tree = BKTree()
    for v in values:
        tree.add(v)
    for q in values[:60]:
        assert sorted(tree.near(q, 3)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 3]


def test_long_chains_and_hubs_connect(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 180)] + [(500, 500), (None, 3), (7, 6), (7, 6)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_tasks_by_their_edges(spark):
    """Each task of each step costs files: 60 partitions of few edges took 7,452 tasks."""
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 180)]
    context, settings = spark.sparkContext, {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    context.setJobGroup("components", "tasks by edges")
    try:
        found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
        tracker = context.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("components")]
        tasks = sum(s.numCompletedTasks for j in jobs for s in map(tracker.getStageInfo, j.stageIds) if s)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert found == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)}
    assert jobs and 0 < tasks < 800


def test_filters_of_few_keys_are_small(spark):
    """The driver and each executor write a file of what is broadcast: 8 MB a filter, whatever its keys."""
    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 3_000)
    packed = Bloom.of(spark.createDataFrame([(int(k),) for k in keys[:2_000]], "id long"), "id")
    held = Bloom.holds(Bloom.opened(packed), keys)
    assert held[:2_000].all() and held[2_000:].sum() < 10
    assert len(packed) < 1 << 16


def test_word_prints():
    text = "a b a c " * 300 + " ".join(words(700, 1))
    counts = {}
    for w in text.split():
        counts[w] = min(2, counts.get(w, 0) + 1)
    expected = []
    for kind in range(KINDS):
        hashes = [(xxhash.xxh64_intdigest(w, kind), n) for w, n in counts.items()]
        x = sum(1 << b for b in range(64) if 2 * sum(n for h, n in hashes if h >> b & 1) > sum(counts.values()))
        expected.append(x - (1 << 64) if x >> 63 else x)
    assert WordPrints().of(text) == expected
    assert WordPrints().of(" ") == [0] * KINDS


def shingled(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_every_candidate_pair_between_components_is_verified(spark, table):
    r, base, rows = random.Random(3), words(300, 77), []
    for i in range(120):
        copy = list(base)
        for at in r.sample(range(300), r.randrange(2, 7)):
            copy[at] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    sets, prints = [shingled(t) for _, t in rows], [WordPrints().of(t) for _, t in rows]
    parts = [part_prints(shingle_set(t, 5, WordMemo())) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            near = any((x ^ y).bit_count() <= 3 for x, y in zip(prints[i], prints[j])) or any(x == y for x, y in zip(parts[i], parts[j]))
            both = len(sets[i] & sets[j])
            if near and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    found = dict(map(tuple, similar_documents(table(rows)).collect()))
    assert all(found.get(i, i) == root(i) for i in range(len(rows)))


def test_copies_with_a_block_edited(spark, table):
    """Texts with a block appended, cut off or replaced, each alike to its base by 0.8 or more."""
    rows, pairs = [], []
    for g in range(60):
        base, new = words(150 + 20 * g, 700 + g), words(400, 800 + g)
        n = len(base)
        edits = (base + new[: n * 22 // 100], base[: n * 84 // 100], base[: n // 3] + new[: n * 8 // 100] + base[n // 3 + n * 8 // 100 :])
        rows.append((10 * g, " ".join(base)))
        rows += [(10 * g + k, " ".join(e)) for k, e in enumerate(edits, 1)]
        pairs += [(10 * g + k, 10 * g) for k in (1, 2, 3)]
    sets = {i: shingled(t) for i, t in rows}
    assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in pairs)
    found = dict(map(tuple, similar_documents(table(rows)).collect()))
    assert all(c == i // 10 * 10 for i, c in found.items())
    assert sum(found.get(a) == b for a, b in pairs) >= 0.99 * len(pairs)


def test_a_further_document_removes_no_link(spark, table):
    base = words(300, 31)
    close = [*base[:150], "new", *base[150:]]
    mixed = random.Random(1).sample(base, len(base))
    two = [(2, " ".join(base)), (3, " ".join(close))]
    for rows in (two, [(1, " ".join(mixed)), *two], [*two, (4, " ".join(mixed))]):
        assert dict(map(tuple, similar_documents(table(rows)).collect())) == {2: 2, 3: 2}


def test_rows_that_share_an_id_or_have_none(spark, table):
    a, b, c = (" ".join(words(200, k)) for k in (1, 2, 3))
    rows = [(5, a), (5, b), (None, a), (None, c), (None, c), (7, b), (8, "other " * 60)]
    assert sorted(map(tuple, similar_documents(table(rows)).collect()), key=repr) == sorted([(5, 5), (5, 5), (None, 5), (None, None), (None, None), (7, 5)], key=repr)
    frame = table(rows).selectExpr("*", "4 AS row_key")
    left = first_of_similar(frame)
    assert left.columns == frame.columns and sorted(r.text for r in left.collect()) == sorted([a, b, c, "other " * 60])


def test_block_pairs_bring_any_two_together(spark):
    rows = spark.range(50).selectExpr("id AS node", "id * 7 AS print", "if(id < 40, 1L, 2L) AS shard")
    found = {}
    for r in in_block_pairs(rows, rows.groupBy("shard").count(), 8).collect():
        found.setdefault(r.shard, set()).add(r.node)
    together = {(a, b) for g in found.values() for a in g for b in g}
    assert together == {(a, b) for a in range(50) for b in range(50) if (a < 40) == (b < 40)}
    assert max(map(len, found.values())) < 30


def test_parities_refuse_no_alike_pair():
    r, sets = np.random.default_rng(4), [np.empty(0, np.uint32)]
    for n in (3, 60, 64, 70, 260, 1000):
        base = r.integers(0, 1 << 32, n, dtype=np.uint32)
        for lost in (0, 1, n // 12, n // 5, n // 3):
            sets.append(np.unique(np.concatenate((base[lost:], r.integers(0, 1 << 32, lost // 3, dtype=np.uint32)))))
    packed = np.empty(len(sets), object)
    packed[:] = [parity(x) for x in sets]
    filtered = Parities(np.array([len(x) for x in sets]), packed, 0.8)
    passed = [set(filtered.alike(i, np.arange(len(sets))).tolist()) for i in range(len(sets))]
    alike = [{j for j in range(len(sets)) if jaccard(sets[i], sets[j]) >= 0.8} for i in range(len(sets))]
    assert all(a <= p for a, p in zip(alike, passed))
    assert sum(map(len, passed)) < 2 * sum(map(len, alike))


def test_similar_documents_match_brute_force(spark, table):
    r = random.Random(8)
    rows = list(ODD)
    for g in range(25):
        base = words(300, 50 + g)
        for k in range(6):
            copy = list(base)
            for at in range(r.randrange(60), len(copy), (60, 80, 100, 25, 15, 9)[k]):
                copy[at] = f"edit{g}{k}{at}"
            rows.append((1000 + g * 10 + k, " ".join(copy)))
    rows += [(2000, rows[-1][1]), (1999, rows[-1][1])]
    sets = {}
    for i, t in rows:
        if i is not None:
            w = (t or "").lower().split()
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sorted(sets):
        for b in sorted(sets):
            if b < a:
                both = len(sets[a] & sets[b])
                if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    expected = {i: root(i) for i in sets}
    found = dict(map(tuple, similar_documents(table(rows)).collect()))
    joined = [i for i in expected if expected[i] != i or list(expected.values()).count(i) > 1]
    assert all(expected[i] == c for i, c in found.items())  # no false link
    assert len(set(found) & set(joined)) >= 0.95 * len(joined)
    assert similar_documents(table([])).count() == 0

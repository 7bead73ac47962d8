"""Operator 9: SimHash near-duplicates with BK-trees.

Fingerprints at most ``RADIUS`` bits apart agree on one of four 16-bit groups
of bits, whichever way the 64 bits are dealt into four groups.  Distinct
fingerprints are therefore dealt into shards by the bits of a group; every
shard holds a BK-tree whose children are keyed by their integer Hamming
distance to the parent, and a look-up follows only the edges within the radius.
A shard over ``SHARD_LIMIT`` fingerprints is dealt again by the groups of the
next dealing, which loses no link.  The trees of shards that are over the limit
even then are built in blocks of ``TREE_BLOCK`` fingerprints, and each block is
broadcast to all tasks that hold queries of those shards.  The other shards
reach their queries by the shuffle: all trees together grow with the data, and
fingerprints of all documents may not go through the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoolglass.llm.common import LOWER_AZ, Bloom, as_batch, by_text, cut_lineage, keyed_texts, pieces, row_keys
from spoolglass.llm.graph import components
from spoolglass.llm.repeats import WordMemo, gram_hashes, word_hashes

RADIUS = 3
SEED = 42
SHARD_LIMIT = 16_384
#: Fingerprints in the trees of one broadcast, about 3 MB.
TREE_BLOCK = 65_536

#: Fingerprints of each text in the search for similar texts, and how often a word counts in them at most.
KINDS, MAX_COUNT = 12, 2
SIMILARITY, SHINGLE_WORDS = 0.8, 5
#: Parts of each text in that search: two shingles each, so that a pair at 0.8 shares one with 1 - (1 - 0.8**2)**PARTS.
PARTS = 8

#: Four groups of bits for each dealing: by the base-4 digits of a bit's number, the highest digit first.
GROUPS = [[sum(1 << i for i in range(64) if i // 4**digit % 4 == g) for g in range(4)] for digit in (2, 0, 1)]

PRINT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])
LINK_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, words: int = 3, block: int = 1 << 14) -> bytes:
    """Eight bytes, most significant first: the bits set in over half the shingles' XXH64."""
    from xxhash import xxh64_digest as digest

    tokens = text.encode().translate(LOWER_AZ).split()
    if not tokens:
        return bytes(8)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()[min(words, len(tokens)) - 1 :]
    n, ones = len(ends), np.zeros(64, np.int64)
    for at in range(0, n, block):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + block], ends[at : at + block], strict=False)])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


class BKTree:
    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Numbers of the values within the radius; edges outside distance ± radius are never followed."""
        found, values, children = [], self.values, self.children
        todo = [0] if values else []
        while todo:
            i = todo.pop()
            d = (values[i] ^ value).bit_count()
            if d <= radius:
                found.append(i)
            if kids := children[i]:
                if len(kids) <= 2 * radius:
                    todo += [k for e, k in kids.items() if d - radius <= e <= d + radius]
                else:
                    todo += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return found

    def add(self, value: int) -> None:
        n = len(self.values)
        i = 0
        while n:
            d = (self.values[i] ^ value).bit_count()
            if d not in self.children[i]:
                self.children[i][d] = n
                break
            i = self.children[i][d]
        self.values.append(value)
        self.children.append({})


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join all values within the radius of one another, one for each value that is joined on."""
    tree, joined, out = BKTree(), Joined(), []
    for i, value in enumerate(values):
        out += [(i, j) for j in tree.near(value, radius) if joined.join(i, j)]
        tree.add(value)
    return out


class Joined:
    """Which nodes are connected by the links so far."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, i: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(i, i)) != i:
            parent[i] = parent[up]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Connect two nodes; whether they weren't before."""
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """The groups of two rows or more of a partition sorted by a key; at most a batch and a group are held."""
    held: list[dict[str, np.ndarray]] = []

    def taken() -> dict[str, np.ndarray]:
        return {c: np.concatenate([h[c] for h in held]) for c in held[0]} if len(held) > 1 else held[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        keys = columns[key]
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        if held and held[-1][key][-1] != keys[0]:
            if sum(len(h[key]) for h in held) > 1:
                yield taken()
            held = []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = {n: c[a:b] for n, c in columns.items()} if b - a > 1 or k == 0 or b == len(keys) else None
            if b < len(keys):
                if held:
                    held.append(part)
                    part, held = taken(), []
                if part is not None and len(part[key]) > 1:
                    yield part
            else:
                held.append({n: c.copy() for n, c in part.items()})
    if held and sum(len(h[key]) for h in held) > 1:
        yield taken()


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in sorted_groups(batches, "shard"):
            nodes = group["node"].tolist()
            values = [p & 0xFFFFFFFFFFFFFFFF for p in group["print"].tolist()]
            out += [(nodes[i], nodes[j]) for i, j in forest(values, radius)]
            if len(out) > 50_000:
                yield as_batch(out, LINK_SCHEMA)
                out = []
        if out:
            yield as_batch(out, LINK_SCHEMA)

    return run


def part_prints(shingles: np.ndarray) -> list[int]:
    """One print for each of ``PARTS`` parts, the two shingles that are least under hashes of the part's own.

    A shingle that is least in one text is least in the other with the
    probability of their Jaccard similarity, wherever the texts differ.
    """
    if not len(shingles):
        return []
    k = np.arange(1, 2 * PARTS + 1, dtype=np.uint64)[:, None]
    h = (shingles.astype(np.uint64) + (k << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    least = (h ^ h >> np.uint64(32)).min(axis=1).reshape(PARTS, 2)
    return ((least[:, 0] ^ least[:, 1] >> np.uint64(7)) * np.uint64(0xFF51AFD7ED558CCD) ^ least[:, 1]).view(np.int64).tolist()


def parity(shingles: np.ndarray) -> bytes:
    """Whether an odd number of the distinct hashes falls on each of 64 bits or more, a bit for each hash."""
    bits = max(64, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 64
    return np.packbits((np.bincount(shingles & np.uint32(bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


class Parities:
    """Which pairs of sets can be alike: each hash that one of them lacks turns at most one bit of their parities.

    A pair at the similarity or above is never refused; most others are.
    Parities of twice the bits are folded, which keeps that.
    """

    def __init__(self, sizes: np.ndarray, packed: np.ndarray, similarity: float) -> None:
        self.sizes, self.similarity = sizes.astype(np.int64), similarity
        self.width = np.fromiter(map(len, packed), np.int64, len(packed))
        self.at, self.rows, self.folded = np.zeros(len(packed), np.int64), {}, {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.at[own] = np.arange(len(own))
            self.rows[w] = np.frombuffer(b"".join(packed[own].tolist()), np.uint64).reshape(len(own), -1)
            if w > 8:
                self.folded[w] = self.rows[w][:, : w // 16] ^ self.rows[w][:, w // 16 :]

    def alike(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that can be alike to i."""
        s, w = self.similarity, int(self.width[i])
        small, large = np.minimum(self.sizes[others], self.sizes[i]), np.maximum(self.sizes[others], self.sizes[i])
        others = others[small >= s * large - 1e-6]
        out = []
        for width, left, right in ((w, self.rows, self.rows), (w // 2, self.folded, self.rows), (2 * w, self.rows, self.folded)):
            js = others[self.width[others] == width]
            if len(js):
                apart = np.bitwise_count(left[w][self.at[i]] ^ right[width][self.at[js]]).sum(axis=1, dtype=np.int64)
                out.append(js[apart <= (self.sizes[js] + self.sizes[i]) * (1 - s) / (1 + s) + 1e-6])
        return np.concatenate(out) if out else others[:0]


def _open_pairs(radius: int, similarity: float):
    """Every pair of a shard within the radius that can be alike and isn't yet in one component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, "shard"):
            nodes, comps, prints = group["node"], group["comp"], group["print"]
            if (comps == comps[0]).all():
                continue
            cuts = [0, *(np.flatnonzero(prints[1:] != prints[:-1]) + 1).tolist(), len(prints)]
            sets, tree = Parities(group["size"], group["parity"], similarity), BKTree()
            for a, b in zip(cuts, cuts[1:], strict=False):
                value = int(prints[a]) & 0xFFFFFFFFFFFFFFFF
                before = np.concatenate([np.arange(cuts[g], cuts[g + 1]) for g in tree.near(value, radius)] + [np.empty(0, np.int64)])
                tree.add(value)
                for i in range(a, b):
                    others = np.concatenate((before, np.arange(a, i)))
                    others = others[comps[others] != comps[i]]
                    if len(others):
                        others = sets.alike(i, others)
                    if len(others):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(others), nodes[i])), pa.array(nodes[others])], schema=LINK_SCHEMA)

    return run


def dealt(rows: DataFrame, level: int) -> DataFrame:
    """Each fingerprint once for each of the four groups of this dealing, in the shard of that group's bits."""
    groups = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(signed(m)).alias("mask")) for g, m in enumerate(GROUPS[level])])
    own = [c for c in rows.columns if c != "shard"]
    return rows.select(*own, "shard", F.explode(groups).alias("x")).select(
        *own, F.xxhash64("shard", F.lit(level), "x.g", F.col("print").bitwiseAND(F.col("x.mask"))).alias("shard")
    )


def tree_links(rows: DataFrame, radius: int, block: int) -> DataFrame:
    """Links of the rows (node, print, shard) by broadcast trees, a block of about ``block`` fingerprints at a time.

    Each task gives the links that join two components of what it has seen: one
    for each of its nodes and of those in the block at most.
    """
    context, blocks, found = rows.sparkSession.sparkContext, -(-rows.count() // block), None

    def looked_up(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees, joined = shared.value, Joined()
            for batch in batches:
                out: list[tuple[int, int]] = []
                for node, value, shard in zip(*(batch.column(c).to_pylist() for c in ("node", "print", "shard")), strict=True):
                    if (held := trees.get(shard)) is not None:
                        tree, nodes = held
                        out += [(node, nodes[j]) for j in tree.near(value & 0xFFFFFFFFFFFFFFFF, radius) if joined.join(node, nodes[j])]
                if out:
                    yield as_batch(out, LINK_SCHEMA)

        return run

    for k in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("shard", "node", F.lit(7)), F.lit(blocks)) == k).select("shard", "print", "node").toArrow()
        trees: dict[int, tuple[BKTree, list[int]]] = {}
        for shard, value, node in zip(*(part.column(c).to_pylist() for c in ("shard", "print", "node")), strict=True):
            tree, nodes = trees.setdefault(shard, (BKTree(), []))
            tree.add(value & 0xFFFFFFFFFFFFFFFF)
            nodes.append(node)
        links = cut_lineage(rows.mapInArrow(looked_up(context.broadcast(trees)), "a long, b long"))
        found = links if found is None else found.unionByName(links)
    return found


def in_block_pairs(rows: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """The rows of shards (shard, count) over the limit, dealt so that any two of a shard meet in one of less than twice the limit."""
    joined = rows.join(sizes.select("shard", F.ceil(F.col("count") / limit).alias("blocks")), "shard")
    own, other = F.pmod(F.xxhash64("node", "print"), "blocks"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = joined.withColumn("own", own).withColumn("other", other)
    key = F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other"))
    return pairs.withColumn("shard", key).select(rows.columns)


def linked(prints: DataFrame, *, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT, tree_block: int = TREE_BLOCK, carried: tuple[str, ...] = (), links=None) -> DataFrame:
    """a, b: links that connect all nodes whose fingerprints are within the radius (at most 3) of one another.

    prints: node, print, and shard, which keeps fingerprints of different kinds
    apart; the fingerprints of a shard are distinct.  ``links`` is another
    choice of links within a shard, which may read the ``carried`` columns and
    fingerprints that several nodes have.
    """
    if radius > 3:
        raise ValueError("four groups find pairs of at most three differing bits")
    spark = prints.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links_of = links or _links(radius)
    rows, found = prints.select("node", "print", *carried, "shard"), []

    def by_shuffle(part: DataFrame) -> DataFrame:
        return part.repartition(n, "shard").sortWithinPartitions("shard", "print").mapInArrow(links_of, "a long, b long")

    for level in range(len(GROUPS)):
        rows = dealt(rows, level)
        full = cut_lineage(rows.groupBy("shard").count().filter(F.col("count") > shard_limit))
        if full.isEmpty():
            found.append(by_shuffle(rows))
            break
        found.append(by_shuffle(rows.join(full, "shard", "left_anti")))
        rows = rows.join(full, "shard", "left_semi")
        if level == len(GROUPS) - 1:
            rows = cut_lineage(rows)
            found.append(tree_links(rows, radius, tree_block) if links is None else by_shuffle(in_block_pairs(rows, full, shard_limit)))
    return reduce(DataFrame.unionByName, found)


def near_duplicates(docs: DataFrame, *, words: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", shard_limit: int = SHARD_LIMIT, tree_block: int = TREE_BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links).

    One row for each row of ``docs``.  Null and wordless texts have fingerprint
    zero and link like others; a text of fewer words than a shingle is one
    shingle.  Equal fingerprints are one node, so copies add no pairs.  Rows
    with a null id are kept; their component is the smallest id reachable, null
    if there is none.  Other columns are not read.  No rows give no rows.
    """

    def make():
        return lambda text: (int.from_bytes(fingerprint(text, words), signed=True),)

    marked = cut_lineage(keyed_texts(docs, id_col, text_col).mapInArrow(by_text(make, PRINT_SCHEMA), "doc_id long, print long"))
    nodes = cut_lineage(marked.groupBy("print").agg(F.min("doc_id").alias("first")))
    prints = nodes.select(F.col("print").alias("node"), "print", F.lit(0).cast("long").alias("shard"))
    roots = components(linked(prints, radius=radius, shard_limit=shard_limit, tree_block=tree_block))
    of_root = roots.join(nodes, roots["node"] == nodes["print"]).select("root", "print", "first")
    least = of_root.groupBy("root").agg(F.min("first").alias("least"))
    joined = of_root.join(least, "root").select("print", "least")
    # Materialised, so that the rows of one fingerprint can be split in the last join.
    ids = cut_lineage(nodes.join(joined, "print", "left").select("print", F.coalesce("least", "first").alias("component_id")))
    return marked.join(ids, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


class WordPrints:
    """``KINDS`` fingerprints over a text's words, each with its own seed; a word counts ``MAX_COUNT`` times at most.

    An edit changes few words, so similar texts differ in few bits, and capped
    counts keep the commonest words from making all texts alike.
    """

    def __init__(self, size: int = 200_000) -> None:
        from xxhash import xxh64_digest

        self.digest, self.size, self.known = xxh64_digest, size, {}

    def of(self, text: str) -> list[int]:
        counts = Counter(text.encode().translate(LOWER_AZ).split())
        if not counts:
            return [0] * KINDS
        if len(self.known) > self.size:
            self.known.clear()
        known, rows = self.known, []
        for word in counts:
            row = known.get(word)
            if row is None:
                row = b"".join([self.digest(word, seed) for seed in range(KINDS)])
                if len(word) <= 100:
                    known[word] = row
            rows.append(row)
        again = [row for row, n in zip(rows, counts.values(), strict=True) if n > 1]
        ones = sum((self.ones(part) for part in (rows, again) if part), start=np.zeros(64 * KINDS, np.int64))
        return np.packbits(2 * ones > len(rows) + len(again)).view(">i8").tolist()

    @staticmethod
    def ones(rows: list[bytes], block: int = 255) -> np.ndarray:
        """How often each bit is set, in blocks that a byte can count."""
        out = np.zeros(64 * KINDS, np.int64)
        for i in range(0, len(rows), block):
            bits = np.frombuffer(b"".join(rows[i : i + block]), np.uint8).reshape(-1, 8 * KINDS)
            out += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.uint8)
        return out


def shingle_set(text: str, words: int, memo: WordMemo) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one shingle."""
    tokens = word_hashes(text, memo)
    grams = gram_hashes(tokens, min(words, len(tokens))) if len(tokens) else np.empty(0, np.uint64)
    return np.unique((grams >> np.uint64(32)).astype(np.uint32))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def similar_pairs(docs: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b: ids) whose texts share at least ``similarity`` of their distinct shingles."""
    spark = docs.sparkSession
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = spark.sparkContext.broadcast(Bloom.of(ends, "id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, bits = WordMemo(), Bloom.opened(wanted.value)
        for batch in pieces(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(Bloom.holds(bits, ids)).tolist()
            packed = [shingle_set(batch.column("text")[i].as_py(), words, memo).tobytes() for i in rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "left"):
            left, right = (batch.column(c).to_pylist() for c in ("left", "right"))
            alike = [jaccard(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= similarity for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    found = cut_lineage(docs.mapInArrow(sets, "doc_id long, shingles binary"))
    joined = pairs.join(found.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")).hint("shuffle_merge"), "a")
    joined = joined.join(found.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")).hint("shuffle_merge"), "b")
    return joined.select("a", "b", "left", "right").mapInArrow(verify, "a long, b long")


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, component_id (the smallest id of its group) of the documents that are alike or equal to another.

    Rows without an id, or that share one, are compared like all others (see
    ``row_keys``); a group has a null component only if no row of it has an id.
    Documents without a link give no row.  No rows give no rows.
    """
    keyed, key = row_keys(docs, id_col)
    found = keyed_similar(keyed_texts(keyed, key, text_col), **settings)
    if key == id_col:
        return found
    ids = keyed.select(F.col(key).alias("key"), F.col(id_col).alias("id"))
    for column in ("doc_id", "component_id"):
        found = found.join(ids, found[column] == ids["key"]).drop(column, "key").withColumnRenamed("id", column)
    return found


def first_of_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows, with all their columns, without those that are alike to one of a smaller id in their group."""
    keyed, key = row_keys(docs, id_col)
    found = keyed_similar(keyed_texts(keyed, key, text_col), **settings).filter("doc_id > component_id").select(F.col("doc_id").alias(key))
    kept = keyed.join(found, key, "left_anti")
    return kept.select(*[kept[c] for c in docs.columns])


def keyed_similar(rows: DataFrame, *, words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``similar_documents`` of rows doc_id (unique) and text.

    Equal texts count once.  Texts with one of ``KINDS`` word fingerprints
    within the radius are candidates, found by BK-trees, and so are texts that
    share one of ``PARTS`` parts, which finds copies with a block added, cut or
    replaced; links are those that share at least ``similarity`` of their
    distinct ``words``-word shingles.
    Links that connect the candidates are verified first; then every other
    candidate pair between two of the resulting components, so that no pair
    is left out for a link that proved wrong.
    """
    spark = rows.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("same", pa.binary()), ("prints", pa.list_(pa.int64())), ("parts", pa.list_(pa.int64())), ("size", pa.int64()), ("parity", pa.binary())])

    def make():
        from xxhash import xxh3_128_digest

        prints, memo = WordPrints(), WordMemo()

        def work(text: str) -> tuple:
            shingles = shingle_set(text, words, memo)
            return xxh3_128_digest(text.encode()), prints.of(text), part_prints(shingles), len(shingles), parity(shingles)

        return work

    marked = cut_lineage(rows.mapInArrow(by_text(make, schema), "doc_id long, same binary, prints array<long>, parts array<long>, size long, parity binary"))
    of_text = F.min(F.struct("doc_id", "prints", "parts", "size", "parity")).alias("x")
    firsts = cut_lineage(marked.groupBy("same").agg(of_text).select("same", F.col("x.doc_id").alias("first"), "x.prints", "x.parts", "x.size", "x.parity"))
    copies = marked.join(firsts.select("same", "first"), "same").filter("doc_id > first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = firsts.select(F.col("first").alias("id"), F.posexplode(F.concat("prints", "parts")).alias("kind", "print")).select("id", F.col("kind").cast("long").alias("shard"), "print")
    nodes = cut_lineage(each.groupBy("shard", "print").agg(F.min("id").alias("node")))
    equal = each.join(nodes, ["shard", "print"]).filter(F.col("id") > F.col("node")).select(F.col("id").alias("a"), F.col("node").alias("b"), (F.col("shard") < KINDS).alias("by_words"))
    near = linked(nodes.filter(F.col("shard") < KINDS)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.lit(True).alias("by_words"))
    pairs = cut_lineage(equal.unionByName(near).filter(F.col("a") > F.col("b")).groupBy("a", "b").agg(F.max("by_words").alias("by_words")))
    alike = cut_lineage(similar_pairs(rows, pairs.select("a", "b"), words, similarity))
    # Every text with a candidate has one in ``pairs``; what is still apart there is compared in full.
    roots = components(alike).select(F.col("node").alias("first"), F.col("root").alias("comp"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("first"), "by_words").groupBy("first").agg(F.max("by_words").alias("by_words"))
    still = firsts.join(ends, "first").join(roots, "first", "left").select(F.col("first").alias("node"), F.coalesce("comp", "first").alias("comp"), "size", "parity", "prints", "parts", "by_words")
    still = cut_lineage(still)
    carried = ("comp", "size", "parity")
    by_words = still.filter("by_words").select("node", *carried, F.posexplode("prints").alias("shard", "print")).withColumn("shard", F.col("shard").cast("long"))
    missed = linked(by_words, carried=carried, links=_open_pairs(RADIUS, similarity))
    keys = still.select("node", "comp", F.posexplode("parts").alias("kind", "print")).select("node", "comp", "print", F.xxhash64("kind", "print").alias("shard"))
    apart = keys.groupBy("shard").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("shard")
    open_keys = keys.join(apart, "shard").join(still.select("node", "size", "parity"), "node").select("node", "print", *carried, "shard")
    by_parts = open_keys.repartition(n, "shard").sortWithinPartitions("shard", "print").mapInArrow(_open_pairs(0, similarity), "a long, b long")
    missed = missed.unionByName(by_parts)
    missed = missed.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") > F.col("b")).distinct()
    missed = cut_lineage(missed.join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    if not missed.isEmpty():
        alike = alike.unionByName(similar_pairs(rows, missed, words, similarity))
    return components(alike.unionByName(copies)).select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))

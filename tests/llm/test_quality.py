import random
import string
from collections import Counter

from conftest_llm import ODD, words

import zstandard

from spoolglass.llm.quality import BANDS, CHUNK_BYTES, MAX_BAD_CHUNKS, base_counts, chunks_of, quality


def brute(text):
    text = text or ""
    tokens = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = [tuple(tokens[i : i + 3]) for i in range(len(tokens) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r") and x in lines[:i])
    return len(tokens), sum(map(len, tokens)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


TEXTS = ["a b c a b c", "x\nx\n\n\nx \nx", "a a a a", "# | <b> \x1c é z", " ".join(words(120, 3, 8)), "a b", "p q r s p q r"]


def test_counts():
    for text in TEXTS + [t for _, t in ODD[:6]]:
        assert base_counts(text or "") == brute(text), text


def brute_kept(text):
    """The bands by their definition: every byte lies in one chunk, a short rest in the last one."""
    raw = (text or "").encode()
    n_words, _, _, _, n_repeat = brute(text)
    if not raw or n_words < 50 or 100 * n_repeat > 50 * n_words:
        return False

    def inside(part):
        packed = len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(part))
        low, high = [(lo, hi) for most, lo, hi in BANDS if len(part) <= most][0]
        return low <= len(part) / packed <= high

    n = max(1, len(raw) // CHUNK_BYTES + (len(raw) % CHUNK_BYTES >= CHUNK_BYTES // 4))
    parts = [raw[i * CHUNK_BYTES : None if i == n - 1 else (i + 1) * CHUNK_BYTES] for i in range(n)]
    bad = sum(not inside(p) for p in parts)
    return inside(raw) and bad <= MAX_BAD_CHUNKS * n


def test_every_byte_is_in_a_chunk():
    for n in (1, 1023, 1024, 4095, 4096, 4097, 5119, 5120, 8192, 9215, 9216, 50_000):
        raw = bytes(i % 251 for i in range(n))
        parts = chunks_of(raw)
        assert b"".join(parts) == raw and all(len(p) == CHUNK_BYTES for p in parts[:-1])
        assert len(parts) == 1 or CHUNK_BYTES // 4 <= len(parts[-1]) < CHUNK_BYTES * 5 // 4


def test_kept_matches_a_second_implementation(spark, table):
    r = random.Random(9)
    noise = lambda n: " ".join("".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(8)) for _ in range(n))
    loops = [" ".join(f"{k} " + " ".join(words(n, k % m)) for k in range(6)) for n, m in ((20, 2), (60, 1), (300, 3), (900, 1))]
    prose = [" ".join(words(n, n, v)) for n in (40, 55, 120, 600, 790, 3000) for v in (50, 3000)]
    mixed = [" ".join(words(600, 3)) + noise(n) for n in (30, 90, 400, 3000)] + [" ".join(words(500, 4)) + " yes no" * n for n in (60, 400)]
    noises = [noise(n) for n in (60, 100, 200, 400, 900)]
    rows = list(enumerate([t for _, t in ODD] + noises + loops + prose + mixed))
    found = {x.doc_id: x.kept for x in quality(table(rows)).collect()}
    assert found == {i: brute_kept(t) for i, t in rows}
    assert not any(found[len(ODD) + k] for k in range(len(noises)))  # short noise as well as long
    assert 5 < sum(found.values()) < len(rows) - 5


def test_verdicts(spark, table):
    r = random.Random(2)
    prose = " ".join(words(600, 1))
    noise = " ".join("".join(r.choice(string.printable[:94]) for _ in range(9)) for _ in range(900))
    looped = "\n".join(f"{k} " + " ".join(words(900, 7)) for k in range(8))
    rows = [(1, prose), (2, noise), (3, looped), (4, None), (5, "few words"), (6, "same " * 400), (6, "same " * 400), (None, prose)]
    found = [(r.doc_id, r.base_failed, r.kept) for r in quality(table(rows)).collect()]
    assert sorted(found, key=repr) == sorted([(1, False, True), (2, False, False), (3, True, False), (4, True, False), (5, True, False), (6, True, False), (6, True, False), (None, False, True)], key=repr)
    assert quality(table([])).count() == 0
    assert quality(table(ODD)).count() == len(ODD)

"""Operator 4: token counts of a byte-level BPE vocabulary without building ids.

Offline, each vocabulary string is tried once, on the driver: those that the
pre-tokeniser leaves whole and that merge into the one token themselves form
the whole-token set, which the workers are given.
A pre-token in that set counts one, with no merging; the rest are merged by
rank, once for each distinct pre-token while the bounded memo holds it.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame

from spoolglass.llm.common import by_text, kept, keyed_texts
from spoolglass.llm.piece_tokens import Memo

#: The byte-level pre-tokeniser's pattern (fixed by the vocabulary's format).
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MEMO_WORDS = 400_000
DEFAULT_LIMIT = 512

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
DDL = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_letters() -> dict[int, str]:
    """The visible letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def refuse_unhandled(spec: dict) -> None:
    """Raise for vocabularies whose counts differ from the ones of this module."""
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    wrong = {
        "not of the merge type": model.get("type", "BPE") != "BPE",
        "a normaliser": spec["normalizer"],
        "another pre-tokeniser": split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True),
        "merges ignored": model.get("ignore_merges"),
        "dropout": model.get("dropout"),
        "marked parts of words": model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"),
        "truncation or padding": spec.get("truncation") or spec.get("padding"),
        "special strings that take their surroundings": any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")),
        "special strings that overlap": any(a["content"] != b["content"] and a["content"] in b["content"] for a in spec["added_tokens"] for b in spec["added_tokens"]),
    }
    if found := [what for what, is_so in wrong.items() if is_so]:
        raise ValueError(f"vocabularies with this are not supported: {', '.join(found)}")


class TokenCounter:
    """whole: the whole-token set, where it is known already."""

    def __init__(self, vocabulary: bytes, whole: frozenset[str] | None = None) -> None:
        import regex

        spec = json.loads(vocabulary)
        refuse_unhandled(spec)
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.split = regex.compile(PRE_TOKENS)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in special)) if special else None
        self.special_strings = special
        self.whole = dict.fromkeys(self.whole_tokens(spec["model"]["vocab"]) if whole is None else whole, 1)
        self.counts = Memo(self._merged_count, MEMO_WORDS)

    def whole_tokens(self, vocabulary) -> set[str]:
        """Vocabulary strings that are one pre-token and merge into themselves."""
        back = {c: b for b, c in self.letters.items()}
        out = set()
        for token in vocabulary:
            try:
                text = bytes(back[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if self.split.findall(text) == [text] and self.merged(list(token)) == [token]:
                out.add(text)
        return out

    def merged(self, parts: list[str]) -> list[str]:
        """Merge by rank, leftmost first among equals; long inputs by a heap over a linked list."""
        rank = self.rank
        if len(parts) > 64:
            return self._merged_long(parts)
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = rank.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        import heapq

        rank, n = self.rank, len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != left or parts[j] != right:
                continue  # a side has been merged since
            parts[i], parts[j], after[i] = left + right, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else -1
                if b >= 0 and (r := rank.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p]

    def _merged_count(self, word: str) -> int:
        return self.whole.get(word) or len(self.merged([self.letters[b] for b in word.encode()]))

    def count(self, text: str) -> int:
        if self.special is not None and any(s in text for s in self.special_strings):
            spans = self.special.split(text)
            return len(spans) - 1 + sum(self._count_plain(s) for s in spans)
        return self._count_plain(text)

    def _count_plain(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.split.findall(text)))


def count_tokens(docs: DataFrame, vocabulary_path: str, *, limit: int = DEFAULT_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of each whole text: doc_id, n_bytes, n_tokens, over_limit (more than ``limit``).

    A special string inside a text is one token.  A null text is the empty text
    (no bytes, no tokens); a null id stays null; repeated rows each give a row;
    other columns are not read.  An empty table gives an empty result.
    """

    with open(vocabulary_path, "rb") as f:
        vocabulary = f.read()
    name = f"counts {hashlib.sha256(vocabulary).hexdigest()}"
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, frozenset(kept(name, lambda: TokenCounter(vocabulary)).whole)))

    def make():
        counter = kept(name, lambda: TokenCounter(*shared.value))

        def work(text: str) -> tuple:
            n = counter.count(text)
            return len(text.encode()), n, n > limit

        return work

    return keyed_texts(docs, id_col, text_col).mapInArrow(by_text(make, SCHEMA), DDL)

"""Operator 1: SentencePiece encoding and decoding of merge-type vocabularies.

A merge-type encoding has two properties: each run of tokens of an encoding is
itself the encoding of the text it covers, and a token sequence is an encoding
if and only if each adjacent pair is.  So every prefix of a text has one last
token.  The encoder stores that token for each prefix: an automaton lists the
pieces that end there, and the one that is pair-compatible with the last token
of the shorter prefix is kept.  Ids are recovered from the end backwards.
The table takes time linear in the text, whatever its length.

No piece has a word mark after another character, so no merge crosses from a
character into a mark; texts are cut there and the pieces of words kept in a
bounded memo.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from spoolglass.llm.common import by_text, kept, keyed_texts

MARK = "▁"

#: Words kept in each generation of a worker's memo.
MEMO_WORDS = 300_000

#: Tested pairs that a worker keeps.
MEMO_PAIRS = 500_000

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)
DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def wire_fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a serialised message, nested ones as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            out, shift, at = out | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return out

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, raw[at : at + size]
        at += size


def refuse_unhandled(model: bytes) -> None:
    """Raise for models whose encoding differs from the one of this module.

    Handled are merge-type models with byte fallback and no user-defined
    pieces, whose normaliser changes nothing, keeps white space, and puts a
    mark in front.
    """
    trainer, normaliser, user_defined = {}, {}, False
    for number, value in wire_fields(model):
        if number == 1:
            user_defined |= dict(wire_fields(value)).get(3) == 4
        elif number == 2:
            trainer = dict(wire_fields(value))
        elif number == 3:
            normaliser = dict(wire_fields(value))
    wrong = {
        "not of the merge type": trainer.get(3, 1) != 2,
        "no byte fallback": not trainer.get(35),
        "white space as a suffix": trainer.get(24),
        "user-defined pieces": user_defined,
        "a normaliser that changes characters": normaliser.get(2) or normaliser.get(6),
        "no mark in front": not normaliser.get(3, 1),
        "white space removed": normaliser.get(4, 1),
        "white space not marked": not normaliser.get(5, 1),
    }
    if found := [what for what, is_so in wrong.items() if is_so]:
        raise ValueError(f"models with this are not supported: {', '.join(found)}")


class PrefixTableEncoder:
    """Encodes as the library does, for the models that ``refuse_unhandled`` lets pass.

    tokens: ids of the pieces that are their own encoding, where they are
    known already; they are found by trying each piece.
    """

    def __init__(self, model: bytes, tokens: frozenset[int] | None = None) -> None:
        import ahocorasick
        import sentencepiece

        refuse_unhandled(model)
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.end_id = sp.eos_id()
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids: dict[int, int] = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif sp.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.score[piece], self.ids[piece] = sp.get_score(i), i
        self.letters = frozenset(p for p in self.ids if len(p) == 1)
        if not self.letters.issuperset("".join(self.ids)):
            raise ValueError("each character of a piece has to be a piece")
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            self.cut = re.compile(r"(?s).+")  # a piece may cross a word's end: the whole text is one word
        self.automaton = ahocorasick.Automaton()
        self.texts: dict[int, str] = {}
        for piece, i in self.ids.items():
            if i in tokens if tokens is not None else self.merged(piece) == [piece]:  # others can never be a token
                self.texts[i] = piece
                self.automaton.add_word(piece, (len(piece), i, {}))  # with the tokens tested before it
        self.automaton.make_automaton()
        self.sizes = [len(self.texts.get(i, "")) for i in range(size)]
        self.n_pieces, self.n_tested = size, 0
        self.words = Memo(self._word, MEMO_WORDS)

    def merged(self, text: str) -> list[str]:
        """The definition, for strings of a few characters: join the best pair, leftmost first, until none is left."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def tokens(self, word: str) -> list[int]:
        """Tokens of a string without cuts, by its prefix table; a character c that is no piece is n_pieces + ord(c)."""
        n, letters = len(word), self.letters
        last = [-1] * n  # of the prefix that ends with each character
        if not letters.issuperset(word):
            for i, c in enumerate(word):
                if c not in letters:
                    last[i] = self.n_pieces + ord(c)
        for end, (size, token, tested) in self.automaton.iter(word):
            if last[end] >= 0:
                continue
            if size > end:
                last[end] = token
                continue
            before = last[end - size]
            fit = tested.get(before)
            if fit is None:
                fit = self._fit(before, token, tested)
            if fit:
                last[end] = token
        out, sizes, n_pieces = [], self.sizes, self.n_pieces
        n -= 1
        while n >= 0:
            token = last[n]
            out.append(token)
            n -= sizes[token] if token < n_pieces else 1
        out.reverse()
        return out

    def _fit(self, before: int, token: int, tested: dict[int, bool]) -> bool:
        """Whether the two tokens are the encoding of their joined text."""
        left = self.texts[before] if before < self.n_pieces else chr(before - self.n_pieces)
        right = self.texts[token]
        fit = self.merged(left + right) == [left, right]
        if self.n_tested < MEMO_PAIRS:
            tested[before] = fit
            self.n_tested += 1
        return fit

    def _word(self, word: str) -> tuple[bytes, str]:
        out = self.tokens(word)
        if max(out) >= self.n_pieces:  # characters that are no pieces are written as bytes
            out = [i for t in out for i in ([t] if t < self.n_pieces else [self.byte_ids[b] for b in chr(t - self.n_pieces).encode()])]
        return array("i", out).tobytes(), " ".join(map(str, out))

    def encoded(self, text: str) -> tuple[list[int], str]:
        """Ids with the end id, and the same as decimal numbers joined by spaces."""
        if not text:
            return [self.end_id], str(self.end_id)
        words = list(map(self.words.__getitem__, self.cut.findall(MARK + text.replace(" ", MARK))))
        ids = array("i", b"".join([w[0] for w in words])).tolist()
        ids.append(self.end_id)
        return ids, f"{' '.join([w[1] for w in words])} {self.end_id}"

    def encode(self, text: str) -> list[int]:
        return self.encoded(text)[0]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


class Memo(dict):
    """A memo of two generations: when one is full, the older is forgotten."""

    def __init__(self, make, size: int) -> None:
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= 200:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


def encode_decode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode each whole text with an end id, and decode its ids.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``keep_ids``
    also ids and decoded.  A null text is the empty text (the end id alone); a
    null id stays null; repeated rows each give a row; other columns of
    ``docs`` are not read.  An empty table gives an empty result.  The model is
    read and its pieces are tried on the driver, once for each model.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    name = f"pieces {hashlib.sha256(model).hexdigest()}"
    shared = docs.sparkSession.sparkContext.broadcast((model, frozenset(kept(name, lambda: PrefixTableEncoder(model)).texts)))

    def make():
        encoder = kept(name, lambda: PrefixTableEncoder(*shared.value))

        def work(text: str) -> tuple:
            ids, written = encoder.encoded(text)
            decoded = encoder.decode(ids)
            digests = (len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
            return (*digests, ids, decoded) if keep_ids else digests

        return work

    schema, ddl = SCHEMA, DDL
    if keep_ids:
        schema = schema.append(pa.field("ids", pa.list_(pa.int32()))).append(pa.field("decoded", pa.string()))
        ddl += ", ids array<int>, decoded string"
    return keyed_texts(docs, id_col, text_col).mapInArrow(by_text(make, schema), ddl)

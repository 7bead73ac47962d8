import hashlib
import json

import pytest
from conftest_llm import ODD, words

from spoolglass.llm import token_counts
from spoolglass.llm.piece_tokens import PrefixTableEncoder, encode_decode, refuse_unhandled
from spoolglass.llm.queries import vocabulary
from spoolglass.llm.token_counts import TokenCounter, count_tokens

TEXTS = ["", " ", "a", "  two  spaces ", "▁mark▁▁", "日本語🎉é\x00", "<s></s><unk><0x41>", "a" * 1000, " " * 200, "\n\t x", "x<|endoftext|>y <|endoftext|>", "don't we'll  \n  1234½ ²", " ".join(words(300, 1))]


def contents(name):
    with open(vocabulary(name), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def encoder():
    return PrefixTableEncoder(contents("piece_bpe_32k.model"))


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_library_s(encoder, text):
    ids = encoder.library.encode(text, add_eos=True)
    assert encoder.encode(text) == ids
    assert encoder.encoded(text)[1] == " ".join(map(str, ids))


def test_encode_decode(spark, table, encoder):
    rows = encode_decode(table(ODD), vocabulary("piece_bpe_32k.model"), keep_ids=True).collect()
    assert len(rows) == len(ODD)
    for r, (_, text) in zip(sorted(rows, key=repr), sorted(ODD, key=repr), strict=True):
        assert r.n_tokens == len(r.ids)
    of = {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in rows}
    for i, text in ODD:
        ids = encoder.library.encode(text or "", add_eos=True)
        assert (i, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(encoder.library.decode(ids).encode()).hexdigest()) in of
    assert encode_decode(table([]), vocabulary("piece_bpe_32k.model")).count() == 0


def test_counts_are_the_library_s(spark, table):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    counter = TokenCounter(contents("byte_bpe_50k.json"))
    for text in TEXTS + ["q" * 3000, "héé" * 40]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), text[:40]
    for token in list(counter.whole)[::500]:
        assert len(library.encode(token, add_special_tokens=False).ids) == 1
    rows = count_tokens(table(ODD), vocabulary("byte_bpe_50k.json"))
    found = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in rows.collect())
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in ODD]
    assert found == sorted((i or -1, len((t or "").encode()), k, k > 512) for (i, t), k in zip(ODD, n, strict=True))
    assert count_tokens(table([]), vocabulary("byte_bpe_50k.json")).count() == 0


def test_models_that_are_not_handled_are_refused():
    model = contents("piece_bpe_32k.model")
    refuse_unhandled(model)
    for more in (b"\x12\x02\x18\x01", b"\x1a\x02\x12\x00", b"\x1a\x02\x20\x01", b"\x1a\x03\x12\x01x", b"\x0a\x05\x0a\x01q\x18\x04"):
        with pytest.raises(ValueError):
            refuse_unhandled(model + more)


def test_vocabularies_that_are_not_handled_are_refused():
    spec = json.loads(contents("byte_bpe_50k.json"))
    token_counts.refuse_unhandled(spec)
    changes = [
        {"normalizer": {"type": "NFC"}},
        {"pre_tokenizer": {"type": "Whitespace"}},
        {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}},
        {"model": {"type": "BPE", "ignore_merges": True}},
        {"model": {"type": "Unigram"}},
        {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]},
    ]
    for change in changes:
        with pytest.raises(ValueError):
            token_counts.refuse_unhandled(spec | change)


def test_worker_state_given_is_worker_state_found(encoder):
    again = PrefixTableEncoder(contents("piece_bpe_32k.model"), frozenset(encoder.texts))
    assert again.texts == encoder.texts and all(again.encode(t) == encoder.encode(t) for t in TEXTS)

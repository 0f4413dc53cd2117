"""Encoding and decoding against the tokenizers library."""

import hashlib
import random
from functools import lru_cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from normlake.llm.queries import tokenizer_path
from normlake.llm.tokens import BLOCK, ByteBPE, ByteToText, WordBPE, digests, sufficient_lookahead

draw = random.Random(11)
ODD = ["", " ", "The  cat's <|endoftext|> éclair 12!!!", "a   b \n c\t\td ", "ΣΑΣ Straße ǅ İ é", "日本語 テスト٣٤ ½", "a b c\x1cd\x85e", "<|startoftext|><|endoftext|>", "it's we'll I'D 'S", "\n\n\nx\n"]
ODD += ["".join(draw.choice("etaoinshrdlu") for _ in range(6000)), "a" * 4000, "in" * 2500]
ODD += ["".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(160, 600), draw.randrange(0x300, 0x340), draw.randrange(0x4E00, 0x4F00), 32, 10, 9])) for _ in range(50)) for _ in range(150)]


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_same_ids_and_same_text(text):
    path = tokenizer_path("word_bpe_49k.json")
    own, library = WordBPE.load(path), library_of(path)
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    decoded = library.decode(ids, skip_special_tokens=False)
    assert "".join(own.decode_pieces(ids)) == decoded
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert own.digest(text) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))
    path = tokenizer_path("byte_bpe_50k.json")
    assert ByteBPE.load(path).encode_bytes(text) == np.array(library_of(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache
def library_of(path):
    return Tokenizer.from_file(path)


def test_lookahead_bounds_a_toy_merge_list():
    # "ab" is settled only once it is known whether the b goes on as "bc", and that only once "cd" is ruled out.
    merges = [("c", "d"), ("b", "c"), ("a", "b")]
    assert sufficient_lookahead(merges, dict.fromkeys("abcd", 1)) == 3


def test_streaming_keeps_a_bounded_buffer():
    own = WordBPE.load(tokenizer_path("word_bpe_49k.json"))
    word = "".join(draw.choice("etaoinsh") for _ in range(5000))
    seen = [0]

    def symbols():
        for c in word:
            seen[0] += 1
            yield c

    tokens, at = own._tokens(symbols()), 0
    for token in tokens:
        at += len(token.removesuffix("</w>"))
        assert seen[0] - at <= 2 * own.lookahead + 2
    assert at == len(word)


def test_bytes_to_text_machine_at_every_cut():
    data = "aé日😀z".encode() + b"\xff\xe6\x97"
    for k in range(len(data) + 1):
        machine = ByteToText()
        assert machine.push(data[:k]) + machine.push(data[k:]) + machine.end() == data.decode("utf-8", "replace")


def test_odd_rows(spark, odd_docs):
    found = digests(odd_docs, tokenizer_path("word_bpe_49k.json"))
    by = {r["doc_id"]: r for r in found.collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert found.count() == odd_docs.count() and by[3][1:] == by[4][1:] == by[7][1:] == (0, nothing, nothing)
    assert digests(odd_docs.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_long_texts_are_settled_in_blocks():
    path = tokenizer_path("word_bpe_49k.json")
    encoder, reference = WordBPE.load(path), library_of(path)
    text = " ".join(f"w{i % 977}é" for i in range(2 * BLOCK + 5)) + "  <|endoftext|>\n\n tail"
    ids = reference.encode(text, add_special_tokens=False).ids
    assert encoder.digest(text) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest())

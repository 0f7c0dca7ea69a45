"""Alignment by units: words that come again are not encoded again, and texts stay exact."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_links_alignment_middle import brute_alignment

from decoylog.llm import alignment
from decoylog.llm.queries import PIECES, vocabulary

SPACES = [
    " ", " ", "  ", "\n", "\r\n", "\r", "\t", "\xa0", "\u3000", "\x1c", "\x85", "\u2003", " \n ", ";\r",
]
PARTS = ["word", "wörd", "日本", "🙂", "x1", "});", "!", "'s", "<s>", "\x00", "é", "0", "<0x0A>", "q" * 40]


@pytest.fixture(scope="module")
def vocabularies():
    with open(vocabulary(), encoding="utf-8") as a, open(public_tokenizers.path(PIECES), "rb") as b:
        return alignment.ByteLevel(a.read()), alignment.Pieces(b.read())


def mixed(seed, count, most):
    source = random.Random(seed)
    return [
        "".join(source.choice(PARTS if source.random() < 0.6 else SPACES) for _ in range(source.randint(0, most)))
        for _ in range(count)
    ]


@pytest.fixture(scope="module")
def aligner(vocabularies):
    return alignment.Aligner(*(v.bytes for v in vocabularies))


def whole(vocabularies, aligner, text):
    """Numbers, groups and pairs of a text that is aligned whole."""
    tokens, pieces = vocabularies
    if not text:
        return [0] * 4, "", {}
    a, b = tokens.encode(text), pieces.encode(text)
    if not aligner.gives_back(b, b" " + text.encode()):
        return [0] * 4, "", {}
    groups, _, links, _ = aligner.align(a, b)
    return [len(a), len(b), len(groups), len(links)], ";".join(groups), Counter(links.tolist())


def by_units(known, texts):
    totals, groups, offsets, pairs, times = known.block(texts)
    return [
        (totals[i].tolist(), groups[i], dict(zip(pairs[j:k].tolist(), times[j:k].tolist())))
        for i, (j, k) in enumerate(zip(offsets, offsets[1:]))
    ]


def test_words_that_come_again_are_not_encoded_again(vocabularies, monkeypatch, words):
    tokens, pieces = vocabularies
    read = []
    monkeypatch.setattr(
        alignment.Pieces, "encode", lambda self, text: read.append(len(text)) or self.model.encode(text)
    )
    known = alignment.Units(tokens, pieces)
    vocabulary_of = words(500).split()
    source = random.Random(5)
    texts = [" ".join(source.choices(vocabulary_of, k=200)) for _ in range(100)]
    known.block(texts[:50])
    known.block(texts[50:])
    assert known.by_unit
    assert sum(read) < sum(map(len, texts)) / 10


@pytest.mark.parametrize("most", [0, 20, alignment.UNITS])
def test_units_give_what_whole_texts_give(vocabularies, aligner, most):
    known = alignment.Units(*vocabularies, most)
    texts = [None, "", " ", "\n", "x ", "a▁b", "▁ a", "}\r\n", "};\r", " " * 5_000 + "a", *mixed(3, 1_500, 12)]
    for start in range(0, len(texts), 100):
        block = texts[start : start + 100]
        for text, got in zip(block, by_units(known, block)):
            assert got == whole(vocabularies, aligner, text), repr(text)[:80]
    assert len(known.places) <= most + 1_200
    assert len(known.groups) == len(known.places) == len(known.counts)
    assert all(len(u) <= alignment.SHORT for u in known.places)


def test_vocabularies_that_do_not_end_units(vocabularies, aligner):
    texts = mixed(4, 100, 8)
    known = alignment.Units(*vocabularies)
    known.by_unit = False
    assert by_units(known, texts) == [whole(vocabularies, aligner, text) for text in texts]
    assert not known.places and not known.groups


def test_pieces_that_span_units_are_noticed(vocabularies):
    made = alignment.sentencepiece_model_pb2.ModelProto.FromString(vocabularies[1].model.serialized_model_proto())
    made.pieces[-1].piece = "of▁the"
    assert vocabularies[1].by_unit
    assert not alignment.Pieces(made.SerializeToString()).by_unit


def test_mixed_texts_against_all_ranges(spark):
    texts = mixed(6, 120, 10)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(2)
    result = alignment.align_documents(docs, vocabulary(), public_tokenizers.path(PIECES), 50)
    by = {r.doc_id: r for r in result.collect()}
    for i, expected in enumerate(brute_alignment(texts)):
        r = by[i]
        got = (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
        assert got == expected, repr(texts[i])
        assert r.groups_sha256 in ("", hashlib.sha256(";".join(r.groups).encode()).hexdigest())
        assert len(r.groups) == r.n_groups
    assert np.sum([r.n_links for r in by.values()]) > 1_000

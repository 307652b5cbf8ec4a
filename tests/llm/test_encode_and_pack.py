from __future__ import annotations

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import encode, packing

DOCS = "doc_id long, text string"
needs_vocabulary = pytest.mark.skipif(not os.path.exists(encode.VOCABULARY), reason="no vocabulary here")
TEXTS = ["", "Hello  world\n\n x", "it's 12½ ² Ⅷ naïve", "日本語のテキスト。", "a" * 3000, " \t\x1c\x85\u3000 end ", "e\u0301 🎉👩‍👩‍👧", "<|endoftext|>", "\x00\x01", "We'LL we'll 1٣२"]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    path = encode.VOCABULARY.replace(".tiktoken", ".json")
    if not os.path.exists(path):
        pytest.skip("no reference tokenizer here")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@needs_vocabulary
def test_same_ids_as_the_public_tokenizer(reference):
    e = encode.encoder(encode.VOCABULARY)
    assert e.encode_batch(TEXTS) == [x.ids for x in reference.encode_batch(TEXTS, add_special_tokens=False)]
    assert [e.decode(x) for x in e.encode_batch(TEXTS)] == TEXTS


@needs_vocabulary
@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_any_text(reference, text):
    e = encode.encoder(encode.VOCABULARY)
    (ids,) = e.encode_batch([text])
    assert ids == reference.encode(text, add_special_tokens=False).ids and e.decode(ids) == text


@needs_vocabulary
def test_encoding_operator(frame):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (4, "word " * 50_000)]
    encoded = encode.encode_documents(frame(rows, DOCS))
    got = sorted((r.doc_id, len(r.ids)) for r in encoded.collect())
    assert got == [(1, 2), (1, 2), (2, 0), (3, 0), (4, 50_001)] or got[:4] == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert {r.doc_id: r.text for r in encode.decode_documents(encoded).collect()}[4] == "word " * 50_000
    assert encode.encode_documents(frame([], DOCS)).count() == 0


def check_packing(rows, sizes, capacity):
    """Nothing lost, nothing over capacity, splits only of texts above it, no gaps inside containers."""
    by: dict = {}
    for r in rows:
        by.setdefault(r.container, []).append(r)
    empty = by.pop(None, [])
    for pieces in by.values():
        pieces.sort(key=lambda r: r.place)
        assert [p.place for p in pieces] == list(range(len(pieces)))
        assert [p.position for p in pieces] == list(np.cumsum([0] + [p.n_tokens for p in pieces])[:-1])
        assert sum(p.n_tokens for p in pieces) <= capacity
    got: dict = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
    assert set(got) == {i for i, _ in sizes}
    for i, n in sizes:
        parts = sorted(got[i])
        assert sum(x for _, x in parts) == (n or 0) and (len(parts) == 1 or n > capacity)
        assert [s for s, _ in parts] == [k * capacity for k in range(len(parts))]
    assert len(empty) == sum(not n for _, n in sizes)
    return by


def test_packing_operator(frame):
    rng = np.random.default_rng(1)
    sizes = [(i, int(n)) for i, n in enumerate(np.minimum(rng.lognormal(5, 1.2, 3000).astype(int), 9000))] + [(90_001, 0), (90_002, None), (90_003, 2048), (90_004, 2049), (90_005, 50_000)]
    rows = packing.pack(frame(sizes, "doc_id long, n_tokens long"), shard_tokens=150_000).collect()
    by = check_packing(rows, sizes, 2048)
    assert sum(n or 0 for _, n in sizes) / (2048 * len(by)) > 0.97
    assert packing.pack(frame([], "doc_id long, n_tokens long")).count() == 0
    assert packing.fill_report(packing.pack(frame([(1, 5), (1, 5)], "doc_id long, n_tokens long"))).first().pieces == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_pack_shard(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    containers, places = packing.pack_shard(lengths, 64)
    for c in set(containers):
        assert lengths[containers == c].sum() <= 64 and sorted(places[containers == c]) == list(range((containers == c).sum()))


def test_soundness_sees_faults(frame):
    sizes = frame([(1, 5000), (2, 300), (3, 0), (4, 2048)], "doc_id long, n_tokens long")
    packed = packing.pack(sizes)
    assert packing.soundness(packed, sizes).first().asDict() == {"texts": 4, "empty_texts": 1, "incomplete_texts": 0, "wrongly_split_texts": 0, "bad_containers": 0, "well_filled": True}
    lost = packing.soundness(packed.where("doc_id <> 2"), sizes).first()
    assert lost.incomplete_texts == 1 and lost.wrongly_split_texts == 1
    moved = packing.soundness(packed.selectExpr("doc_id", "part", "start", "n_tokens", "container * 0 as container", "place", "position"), sizes).first()
    assert moved.bad_containers == 1
    assert packing.fill_report(packed).first().cost_spread >= 0

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from collonade.llm import bpe, packing
from collonade.llm.queries import vocabulary

TEXTS = ["", " ", "Ünïcode ÀÉ İstanbul ΑΣ ΣΑΣ don't I'LL 123abc", "\x1c foo\x1fbar", "a<|endoftext|>b <|startoftext|> c", "x y　z", "é ñ ﬁ", "😀😀 👍🏽 x😀y", "日本語 テキスト ١٢٣", "a​b﻿", "\x00\x01ab", "!" * 5000 + "aaaa" * 2000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("by_library", [True, False])
def test_encoder(library, text, by_library):
    got = np.frombuffer(bpe.encoder(vocabulary(), by_library).encode(text), "<u4").tolist()
    assert got == library.encode(text, add_special_tokens=False).ids


def test_cached_words_are_bounded_by_bytes(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5000)
    enc = bpe.Encoder(vocabulary())
    text = " ".join(f"word{i % 700}{'x' * (i % 90)}" for i in range(3000))
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert enc.chunks.size < 7000 and len(enc.chunks) < 100 and len(enc.chunks.pieces) < 100


def test_query(odd, nothing, library):
    got = bpe.digests(bpe.decode(bpe.encode(odd, vocabulary()), vocabulary())).collect()
    want = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        out = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id or -1, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(out.encode()).hexdigest()))
    assert sorted((r.doc_id or -1, *r[1:]) for r in got) == sorted(want)
    assert bpe.decode(bpe.encode(nothing, vocabulary()), vocabulary()).count() == 0


def test_packing(odd, nothing, library):
    pieces = packing.pack(odd, vocabulary()).orderBy("sequence_id", "offset").collect()
    at = 0
    for p in pieces:  # one gapless line, cut at the windows
        assert p.sequence_id * packing.WINDOW + p.offset == at and p.offset + p.length <= packing.WINDOW
        at += p.length
    want = sorted([*library.encode(r.text or "", add_special_tokens=False).ids, packing.END] for r in odd.collect())
    got, open_ids = [], []
    for p in pieces:
        assert p.start == len(open_ids)
        open_ids += np.frombuffer(p.ids, "<u4").tolist()
        if len(open_ids) == p.doc_tokens:
            got.append(open_ids)
            open_ids = []
    assert sorted(got) == want and not open_ids
    d = packing.digests(packing.pack(odd, vocabulary())).where("doc_id = 101").first()
    assert d.ids_crc32 == zlib.crc32((2).to_bytes(4, "little")) and d.boundary == "whole"
    assert packing.pack(nothing, vocabulary()).count() == 0

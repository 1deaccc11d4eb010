import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from crosswise.llm import packing, planes
from crosswise.llm.queries import vocabulary
from crosswise.llm.tokens import PartEncoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", FILES)
def test_parts_equal_whole_texts(name):
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "a", "Bc", ".", ",", "'s", "é", "12", "\t", " ", "😀", "ß", "<|endoftext|>", "<|ENDOFTEXT|>", "Σ",
             "!", "%%", "$", "#", "\u00a0", "\u3000", "\u2003", "\x85", "\r\n", "×", "÷", "ñ", "\u0301", "İ", "K", "\x1f", "\x00", "'", "’s", "日本", "I'LL", "7", "_"]
    texts = ["", " ", "plain words, here.\nAnd there", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(6000))]
    code = PartEncoder(vocabulary(name), remember=2000)
    assert code.mode != "whole"
    for some in (texts[:700], texts[700:3000], texts[3000:]):
        ids, counts = code.encode(pa.array(some))
        got = np.split(ids, np.cumsum(counts)[:-1])
        want = [e.ids for e in code.tok.encode_batch(some, add_special_tokens=False)]
        assert [g.tolist() for g in got] == want


@pytest.mark.parametrize("plane_bits", [1, 8])
@pytest.mark.parametrize("id_bits", [16, 32])
def test_planes_round_trip(plane_bits, id_bits):
    rng = np.random.default_rng(2)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 1 << min(id_bits, 31), n).astype(np.uint32)
        assert (planes.from_planes(planes.to_planes(ids, id_bits, plane_bits), n, id_bits, plane_bits) == ids).all()


@pytest.mark.parametrize("bits", [1, 8])
def test_shards_hold_all_ids(spark, odd, bits):
    name = vocabulary("word_bpe_49k.json")
    manifest = planes.write_shards(odd, name, planes.scratch(spark, "t"), plane_bits=bits, block=500)
    rows = planes.read_shards(spark, manifest).collect()
    rows.sort(key=lambda r: r.start)
    tok = PartEncoder(name).tok
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    want = sorted((-1 if d is None else d, zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for d, t in texts)
    assert sorted((-1 if r.doc_id is None else r.doc_id, zlib.crc32(r.ids)) for r in rows) == want
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    assert planes.read_shards(spark, planes.write_shards(odd.limit(0), name, planes.scratch(spark, "t"))).count() == 0


def test_best_fit_is_tightest():
    rng = random.Random(3)
    for _ in range(30):
        cap = rng.choice([8, 13, 64])
        lengths = np.array([rng.randint(1, cap) for _ in range(60)])
        window, offset, n = packing.best_fit_decreasing(lengths, cap)
        room, slow = [], []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [(r, w) for w, r in enumerate(room) if r >= lengths[i]]
            best = min(fits)[0] if fits else None
            slow.append(best)
            if best is None:
                room.append(cap)
                best, w = cap, len(room) - 1
            else:
                w = min(fits)[1]
            room[w] -= lengths[i]
        assert n == len(room)
        for w in range(n):
            own = np.flatnonzero(window == w)
            own = own[np.argsort(offset[own])]
            assert (offset[own] == np.cumsum(lengths[own]) - lengths[own]).all() and lengths[own].sum() <= cap


def test_packing_covers_every_id(odd):
    name = vocabulary("byte_bpe_50k.json")
    rows = packing.pack_documents(odd, name, 64, block_tokens=5000).collect()
    tok = PartEncoder(name).tok
    want = sorted(np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for r in odd.collect())
    windows, docs = {}, {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(len(r.ids) for r in rows) == sum(map(len, want))
    assert packing.pack_documents(odd.limit(0), name).count() == 0

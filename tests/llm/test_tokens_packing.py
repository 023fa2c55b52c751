import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from dialex.llm import packing, tokens


def random_texts(n):
    rng = random.Random(4)
    bits = [" ", "  ", "a", "Bc", "the", "\n", "\t", "▁", "é", ".", "<|endoftext|>", "<s>", "1", "́", "'s", "Σ", "\x1c", "\xa0", "İ", "日本"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_are_the_library_s(name, hard):
    model = tokens.load(name)
    real = (lambda t: len(model.encode(t))) if name.endswith(".model") else (lambda t: len(model.encode(t, add_special_tokens=False).ids))
    texts = random_texts(1500)
    assert tokens.counter(name).counts(texts) == [real(t) for t in texts]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(hard, name).collect()), key=str)
    assert got == sorted(((r.doc_id, len((r.text or "").encode()), real(r.text or "")) for r in hard.collect()), key=str)


def test_a_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "KEEP_CHARS", 500)
    monkeypatch.setattr(tokens, "LONGEST", 6)
    model = tokens.load("piece_bpe_32k.model")
    counter = tokens.PieceCounter("piece_bpe_32k.model")
    for t in random_texts(200):
        assert counter.counts([t, "the " + t]) == [len(model.encode(t)), len(model.encode("the " + t))]
        assert max(map(len, counter.known), default=0) <= 6 and len(counter.known) < 30


def test_ids_are_the_library_s():
    model = tokens.load("word_bpe_49k.json")
    encoder = packing.IdEncoder("word_bpe_49k.json")
    assert not encoder.whole and encoder.parted
    rng = random.Random(8)
    bits = ["The", "été", "ÉTÉ", "straße", "Ünïcode", "ªº", "x", "ſt", "ǅ", "don", "'", "t", "'S", "9", "...", "!", "%%%", '")', "<|ENDOFTEXT|>", "<|endoftext|>", "<", "|>", "-", "́", "̸", "Σ", "İ", "日本", "ⅷ", "\t", "\r", "\x1c", "\x85", " ", "\n", "µ", "×", "ÿ", "Ÿ", "Ꞌ"]
    texts = random_texts(800) + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(4000)] + ["", "x" * 5000]
    real = [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.ids(pa.array(texts))] == real
    for t, ids in zip(texts[::20], real[::20], strict=True):
        assert encoder.ids(pa.array([t, None]))[0].tolist() == ids
    assert encoder.ids(pa.array([], pa.string())) == [] and [len(x) for x in encoder.ids(pa.array([None, ""], pa.string()))] == [0, 0]


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_cover_every_id_once(hard, capacity):
    model = tokens.load("word_bpe_49k.json")
    ids = defaultdict(list)
    for r in hard.collect():
        ids[r.doc_id].append(np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"))
    pieces = packing.pack(hard, "word_bpe_49k.json", capacity).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, copies in ids.items():
        mine, whole = by_doc[doc], copies[0]
        assert sum(p.length for p in mine) == len(whole) * len(copies)
        for p in mine:
            assert p.doc_tokens == len(whole) and p.length > 0
            assert zlib.crc32(whole[p.start : p.start + p.length].tobytes()) == p.ids_crc32
        cover = np.zeros(len(whole), int)
        for p in mine:
            cover[p.start : p.start + p.length] += 1
        assert (cover == len(copies)).all()
    for seq in by_sequence.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)


def test_empty(empty):
    assert packing.pack(empty, "word_bpe_49k.json").count() == 0
    assert tokens.count_tokens(empty, "piece_bpe_32k.model").count() == 0


def test_differencing():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 40))]
        k = rng.randint(1, 8)
        parts = packing.difference(sizes, k)
        assert len(parts) == k and sorted(i for p in parts for i in p) == list(range(len(sizes)))
        loads = [sum(sizes[i] for i in p) for p in parts]
        assert max(loads) - min(loads) <= max(sizes)
        full, rest = packing.pack_group(sizes, 120)
        pieces = sorted(x for w in [*full, rest] for x in w)
        assert all(sum(n for _, _, n in w) == 120 for w in full) and sum(n for _, _, n in rest) == sum(sizes) % 120
        assert all(sum(n for i, _, n in pieces if i == k) == s for k, s in enumerate(sizes)) and all(a + n == b for (i, a, n), (j, b, _) in zip(pieces, pieces[1:]) if i == j)
        uncut, rest = packing.pack_group(sizes, 120, fill=False)
        assert not rest
        assert all(sum(n for _, _, n in w) <= 120 for w in uncut) and sorted(i for w in uncut for i, _, _ in w) == list(range(len(sizes)))
    assert sorted(sum([4, 5, 6, 7, 8][i] for i in p) for p in packing.difference([4, 5, 6, 7, 8], 2)) == [14, 16]


def test_the_window_count_rises():
    windows, rest = packing.pack_group([70, 70, 60], 100, fill=False)  # 200 ids, but no two items fit one window
    assert len(windows) == 3 and not rest
    windows, rest = packing.pack_group([70, 70, 60], 100)
    assert [sum(n for _, _, n in w) for w in windows] == [100, 100] and not rest
    assert sorted(len({i for i, _, _ in w}) for w in windows) == [2, 2]  # two items stay whole, the third fills their room

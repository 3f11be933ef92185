import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from talewind.llm import packing
from talewind.llm.tokens import encoder, public_path

WORDS, RANKS = public_path("word_bpe_49k.json"), public_path("byte_bpe_50k.tiktoken")
ODD = [
    "a  b  c\n\n d'S 's é  　x", "", "  lead", "   q \x1c z x\x1cy a\x85b ", "<|endoftext|> x<|startoftext|>", None, "é́ é ́ Σ ΑΣ İ ",
    "\x00 a\x00b\x7f x\xa0y ½ ²x ß ŉ ǰ don't DON'T 'll''s re're 12ab", "漢字 かな 한국", "x" * 3000,
]


def whole(texts):
    tokenizer = Tokenizer.from_file(WORDS)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def parted(encode, texts):
    ids, starts = encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]


def test_pieces_have_the_tokenizer_s_ids(documents):
    texts = [r.text for r in documents.collect()] + ODD
    assert encoder(WORDS).fast and parted(encoder(WORDS), texts) == whole(texts)


def test_rank_ids_are_lossless():
    encode = encoder(RANKS)
    parts = parted(encode, ODD)
    assert [encode.encoding.decode(x) for x in parts] == [t or "" for t in ODD]


def first_fit(sizes, capacity):
    free, out = [], []
    for n in sizes:
        b = next((i for i, f in enumerate(free) if f >= n), len(free))
        free += [capacity] if b == len(free) else []
        free[b] -= n
        out.append(b)
    return out


def test_trees_choose_as_defined():
    rng = random.Random(1)
    for _ in range(40):
        capacity, sizes = 100, sorted((rng.randrange(1, 101) for _ in range(rng.randrange(1, 80))), reverse=True)
        tree = packing.FirstFit(len(sizes), capacity)
        assert [tree.place(n) for n in sizes] == first_fit(sizes, capacity)
        best, free = packing.BestFit(len(sizes), capacity), {}
        for n in sizes:
            b = best.place(n)
            room = [f for f in free.values() if f >= n]
            assert free.get(b, capacity) == (min(room) if room else capacity) and (b in free) == bool(room)
            free[b] = free.get(b, capacity) - n


def check(rows, texts, capacity):
    docs = {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        assert r.length == len(r.ids) // 4
    for doc, ids in texts.items():
        parts = sorted(docs[doc])
        assert [i for _, p in parts for i in p] == [*ids, 2] and [s for s, _ in parts] == [sum(len(p) for _, p in parts[:k]) for k in range(len(parts))]
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= capacity
    return bins


def test_every_id_is_in_one_piece(documents):
    rows = packing.packed_pieces(documents, WORDS, capacity=256, group=64).collect()
    data = documents.collect()
    bins = check(rows, dict(zip([r.doc_id for r in data], whole([r.text for r in data]), strict=True)), 256)
    assert sum(r.length for r in rows) > 0.9 * 256 * len(bins)


def test_odd_rows(odd):
    rows = packing.packed_pieces(odd, WORDS, capacity=16).collect()
    assert {r.doc_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1} and sum(r.doc_id == 5 for r in rows) == 3
    check(rows, {}, 16)
    assert packing.packed_pieces(odd.limit(0), WORDS).count() == 0
    assert packing.packed_matrix(odd.limit(0), RANKS, 50256, 50256).count() == 0


def test_matrix(documents):
    rows = packing.packed_matrix(documents, RANKS, 50256, 50256, capacity=128, group=50).collect()
    docs, encode = {}, encoder(RANKS)
    for r in rows:
        ids = np.frombuffer(r.input_ids, "<u4")
        assert len(ids) == 128 and r.cu_seqlens == [*r.position_resets, r.n_tokens] and (ids[r.n_tokens :] == 50256).all()
        for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            docs.setdefault(doc, []).append((start, ids[a:b].tolist()))
    for r in documents.collect():
        joined = [i for _, p in sorted(docs[r.doc_id]) for i in p]
        assert joined[-1] == 50256 and encode.encoding.decode(joined[:-1]) == r.text

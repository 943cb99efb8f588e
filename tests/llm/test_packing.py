"""Tokens, plans and packed sequences."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from mailloom.llm import packing


def test_words_encode_like_whole_texts():
    encoder, plain = packing.Encoder(packing.TOKENIZER), Tokenizer.from_file(packing.TOKENIZER)
    for text in ["", "  ", "Été ÀÉ.. don't DON'T it's' é̀x", "İstanbul ΣΑΣ straße", "<|endoftext|> a <|ENDOFTEXT|>",
                 "a b\x1cc x\xa0y 12ab34 ½", "é ́x Å", "日本語 テスト", "\x00 \x85 a", "ab''s .,.,'s !?'t", "ª º µ ß %%% a###"]:
        ids = plain.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text.encode()) == np.array(ids, "<u4").tobytes(), text


@pytest.mark.parametrize("seed, n", [(0, 0), (1, 1), (2, 50), (3, 3000), (4, 200_000)])
def test_plans_place_every_piece_without_gaps(seed, n):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(256, rng.lognormal(3, 1.4, n).astype(int) + 1)
    counts = np.bincount(lengths, minlength=257)
    segments, sequences = packing.plan(counts, 256)
    placed = sorted(segments)
    ends = {}
    used = np.zeros(sequences, np.int64)
    for s, after in zip(placed, placed[1:] + [None]):
        assert s.rank == ends.get(s.length, 0)
        same = after is not None and after.length == s.length
        upto = after.rank if same else counts[s.length]
        rank = np.arange(s.rank, upto)
        np.add.at(used, s.sequence + (rank - s.rank) // s.each, s.length)
        ends[s.length] = upto
    assert all(ends.get(i, 0) == counts[i] for i in range(1, 257))
    total = int((counts * np.arange(257)).sum())
    assert used.sum() == total and (used <= 256).all() and (used > 0).all()
    if n >= 3000:
        assert sequences <= -(-total // 256) * 1.01 + 1


def test_least_squares_is_not_negative_and_fits():
    counts = np.zeros(13, np.int64)
    counts[[3, 4, 5, 9]] = [100, 60, 60, 40]  # forty times 9 + 3, sixty times 5 + 4 + 3
    rows = packing.patterns(counts, 12)
    x = packing.fit(counts, rows, 2000)
    assert (x >= 0).all()
    made = np.bincount(rows.ravel(), ((rows > 0) * x[:, None]).ravel(), 13)
    made[0] = 0
    assert np.abs(made - counts).max() < 1


def test_awkward(awkward):
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    want = []
    for r in awkward.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at: at + 2048], "<u4")
            want.append((str(r.doc_id), k, at, len(part), zlib.crc32(part.tobytes())))
    found = packing.pack(awkward).toPandas()
    rows = found[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)
    ids = ["None" if x != x else str(int(x)) for x in found.doc_id]
    assert sorted((i, *r) for i, r in zip(ids, rows)) == sorted(want)
    placed = found.sort_values(["sequence_id", "offset"])
    sizes = placed.groupby("sequence_id").length
    assert (sizes.cumsum() - placed.length == placed.offset).all()
    assert sizes.sum().max() <= 2048


def test_nothing(nothing):
    assert packing.pack(nothing).count() == 0

"""Runs of spaces in sampled segmentations, against every piece that the model's own library has."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from brinework.llm.piece_sampling import TEMPERATURE, Pieces

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def full_list():
    model = SentencePieceProcessor(model_file=PIECES)
    out = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)):
            out[model.id_to_piece(i)] = (i, -model.get_score(i))
    last = max(rank for _, rank in out.values() if rank < 1e8)
    return {k: (i, math.exp(-TEMPERATURE * math.log(1 + min(rank, last)))) for k, (i, rank) in out.items()}


@pytest.mark.parametrize("text", ["a    b", "  x", "if   y  ", " ", "   ", "a" + " " * 5])
def test_runs_of_spaces_have_their_pieces(text):
    pieces, data = full_list(), "▁" + text.replace(" ", "▁")
    assert {k for k in pieces if len(k) > 1 and not k.strip("▁")} <= {k.decode() for k in Pieces(PIECES).weights}

    def ways(s):
        if s == len(data):
            yield (), 1.0
        for e in range(s + 1, len(data) + 1):
            if got := pieces.get(data[s:e]):
                for rest, w in ways(e):
                    yield (got[0], *rest), w * got[1]

    chance = dict(ways(0))
    total, n = sum(chance.values()), 20_000
    model = Pieces(PIECES)
    ids, bounds = model.sample([text] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919))
    seen = Counter(tuple(ids[bounds[i] : bounds[i + 1]].tolist()) for i in range(n))
    assert set(seen) <= set(chance) and all(abs(seen[k] / n - p / total) < 0.02 for k, p in chance.items())


def test_spaces_and_literal_marks_come_back():
    model = Pieces(PIECES)
    texts = ["", " ", "▁", " ▁", "  ▁▁ ▁x", "a   ▁   b▁  ", " " * 40 + "é🙂 ", "x" + " " * 100 + "y▁", "\t  \n   z"]
    for seed in range(30):
        ids, bounds = model.sample(texts, np.arange(len(texts), dtype=np.uint64) + np.uint64(1000 * seed))
        assert [model.decode(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == texts

"""The token coder's work for each id, and the ids that it is given."""

import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from brinework.llm import bytebpe, range_coder

BPE = public_tokenizers.path("byte_bpe_50k.json")


def seconds(run) -> float:
    took = []
    for _ in range(3):
        began = time.process_time()
        run()
        took.append(time.process_time() - began)
    return min(took)


def test_a_round_trip_costs_few_sorts():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").combine_chunks()
    ids = np.concatenate([ids for ids, _ in bytebpe.Encoder(BPE).groups(texts, 2)])
    numbers = np.random.default_rng(3).integers(0, 1 << 63, len(ids), np.uint64)
    sort = seconds(lambda: np.sort(numbers))
    assert seconds(lambda: range_coder.decode_blocks(*range_coder.encode_blocks(ids), len(ids))) < 55 * sort  # before rANS: 109 of them


@pytest.mark.parametrize("special_as_text", [False, True])
def test_ids_of_odd_spaces_in_small_groups(monkeypatch, special_as_text):
    monkeypatch.setattr(bytebpe, "GROUP_BYTES", 5000)
    monkeypatch.setattr(bytebpe, "REMEMBERED", 700)
    rng = random.Random(5)
    parts = ["a", "b", "'s", "Hello", "don't", " ", "  ", "\n", "\t", "é", "你", "\x85", " ", "　", ".", "12", "<|endoftext|>", " ", "\x1c", "ǆ", "😀", "  \n", " \n ", ","]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(6000)]
    library = Tokenizer.from_file(BPE)
    library.encode_special_tokens = special_as_text
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = bytebpe.Encoder(BPE, special_as_text)
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == want
    for kind in (pa.string(), pa.large_string()):
        got = list(encoder.groups(pa.array([*texts, None], kind).slice(7), 2))
        ids, sizes = (np.concatenate(x).tolist() for x in zip(*got, strict=True))
        assert sizes == [len(x) + 1 for x in want[7:]] + [1]
        assert ids == [i for x in [*want[7:], []] for i in [*x, 2]]


@pytest.mark.parametrize("skew", [1.05, 1.5, 3.0])
def test_round_trip_of_skewed_and_repeated_ids(skew):
    rng = np.random.default_rng(7)
    ids = (rng.zipf(skew, 50_000) % 65536).astype("<u2")
    ids[20_000:24_000] = ids[19_900:23_900]  # repeated at once, within blocks
    ids[30_000:40_000] = 9
    model, blocks = range_coder.encode_blocks(ids)
    assert (range_coder.decode_blocks(model, blocks, len(ids)) == ids).all()


def test_segments_end_with_the_document_that_fills_them(spark, monkeypatch, tmp_path):
    texts = [(i, "word " * (i % 9)) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    write = range_coder._write(BPE, 2)
    monkeypatch.setattr(range_coder, "SEGMENT", 500)
    monkeypatch.setattr(bytebpe, "GROUP_BYTES", 300)
    monkeypatch.setattr(range_coder, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    rows = [r for b in write(iter(docs.toArrow().to_batches(max_chunksize=90))) for r in b.to_pylist()]
    assert [d for r in rows for d in r["doc_ids"]] == list(range(400))
    assert [r["segment"] for r in rows] == list(range(len(rows)))
    for r in rows:
        assert r["n_tokens"] == sum(r["lengths"])
    assert all(500 <= r["n_tokens"] and r["n_tokens"] - r["lengths"][-1] < 500 for r in rows[:-1])


def test_long_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(bytebpe, "GROUP_BYTES", 2000)
    monkeypatch.setattr(bytebpe, "REMEMBERED", 1000)
    encoder, rng = bytebpe.Encoder(BPE), random.Random(1)
    texts = ["a " + "".join(rng.choices("你好abcd", k=900)) for _ in range(60)]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    assert encoder.words.n < 8 * 1000 + 4000


def test_texts_without_words():
    encoder = bytebpe.Encoder(BPE)
    assert encoder.encode([]) == []
    assert encoder.encode(["", None]) == [b"", b""]
    assert encoder.encode([" "]) == [np.array(Tokenizer.from_file(BPE).encode(" ").ids, "<u2").tobytes()]

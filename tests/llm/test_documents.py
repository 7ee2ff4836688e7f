import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import SCHEMA, documents, low, prose, words
from tokenizers import Tokenizer

from brinework.llm import piece_sampling, pitman_yor, range_coder, separator_scan, suffix_array
from brinework.llm.bytebpe import Encoder
from brinework.llm.fourier_quality import accepted, fit, quality_scores
from brinework.llm.hamming_join import near_duplicates
from brinework.llm.piece_sampling import Pieces, decoded_pieces, sampled_digest, sampled_pieces
from brinework.llm.surrogates import pseudonymised, replaced

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def empty(docs):
    return docs.where("false")


# --- near-duplicates ---

def brute_components(rows, n):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        root = min(ids, default=None)
        out.append((d, len(sets[i]), d if root is None else root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(docs, n):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = near_duplicates(docs, shingle=n).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == brute_components(rows, n)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_duplicates_mixed_keys(spark):
    """Copies of copies: links that no key's smallest member shows, and ties."""
    base = prose(5, 60).split()
    rows = []
    for i in range(60):
        w = list(base)
        for k in range(i % 9):
            w[(i * 7 + k * 13) % 60] = f"z{i}{k}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA), shingle=4).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=str) == brute_components(rows, 4)


def test_near_duplicates_empty(docs):
    assert near_duplicates(empty(docs)).count() == 0


# --- suffix arrays ---

BENCH = [(1, prose(1, 40)), (2, "one two"), (3, None), (4, "!!!"), (5, prose(3, 25).upper()), (5, "repeated id " + prose(9, 12)), (6, "one")]
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(rows, bench):
    windows = {}
    for item, t in bench:
        w = ALNUM.findall(low(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for d, t in rows:
        w, hit, items = ALNUM.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= got
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [suffix_array.BLOCK_BYTES, 200])
def test_contamination(spark, docs, monkeypatch, block):
    monkeypatch.setattr(suffix_array, "BLOCK_BYTES", block)
    bench = spark.createDataFrame([(i, t, 0) for i, t in BENCH], "item_id long, text string, doc_id int")
    got = sorted([tuple(r) for r in suffix_array.contamination(docs, bench).collect()], key=str)
    assert got == brute_contamination([(r.doc_id, r.text) for r in docs.collect()], BENCH)
    left = suffix_array.decontaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(g[0]) for g in got if not g[5])


def test_contamination_empty(docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in suffix_array.contamination(docs, none).collect())
    assert suffix_array.contamination(empty(docs), none).count() == 0


# --- token files ---

def test_encoder_equals_library():
    t = Tokenizer.from_file(BPE)
    texts = ["a  b", "a   b ", "\n x", "x \n  y", "", "it's. we'll,", "<|endoftext|> x", "don.", "été, ñ.", "x \x85 y", " ", "  ", "a.b,c", "ǆ. 你好 。", "trail "]
    got = Encoder(BPE).encode([*texts, None])
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)] + [[]]


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 9000])
@pytest.mark.parametrize("top", [1, 7, 65536])
def test_coder_round_trip(n, top):
    ids = np.random.default_rng(n + top).integers(0, top, n).astype("<u2")
    assert (range_coder.decode_blocks(*range_coder.encode_blocks(ids), n) == ids).all()


def test_coder_beats_a_general_codec():
    import pyarrow.parquet as pq
    import zstandard

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    ids = np.frombuffer(b"".join(Encoder(BPE).encode(texts)), "<u2")
    model, blocks = range_coder.encode_blocks(ids)
    assert (range_coder.decode_blocks(model, blocks, len(ids)) == ids).all()
    assert len(model) + sum(map(len, blocks)) < 0.9 * len(zstandard.compress(ids.tobytes(), 3))
    # each block is decoded from the header and its own bytes alone
    k = len(blocks) // 2
    size = range_coder.BLOCK
    assert (range_coder.decode_blocks(model, blocks[k : k + 1], size) == ids[k * size : (k + 1) * size]).all()


def test_whole_table_has_the_library_s_ids(spark):
    import pyarrow.parquet as pq

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist(), key=lambda r: r["doc_id"])
    at, want = 0, []
    for r, e in zip(rows, Tokenizer.from_file(BPE).encode_batch([r["text"] or "" for r in rows], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 2], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, range_coder.coded_documents(docs, BPE).collect())) == want


def test_coded_documents(docs):
    encoder, at, want = Encoder(BPE), 0, []
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    for d, t in rows:
        ids = np.append(np.frombuffer(encoder.encode([t])[0], "<u2"), 2).astype("<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, range_coder.coded_documents(docs, BPE).collect()), key=str) == sorted(want, key=str)
    assert range_coder.coded_documents(empty(docs), BPE).count() == 0


def test_damage_is_found(docs, tmp_path):
    range_coder.write_ids(docs, str(tmp_path / "f"), BPE)
    spark = docs.sparkSession
    files = spark.read.schema(range_coder.FILE).parquet(str(tmp_path / "f"))
    files.selectExpr("part", "segment", "n_tokens", "doc_ids", "lengths", "sizes", "transform(checks, c -> c + 1) as checks", "model", "payload").write.parquet(str(tmp_path / "g"))
    with pytest.raises(Exception, match="damaged"):
        range_coder.read_ids(spark, str(tmp_path / "g"))[0].count()


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_separator_scan(docs, monkeypatch, block):
    monkeypatch.setattr(separator_scan.flat_files, "__defaults__", (50256, block if block > 3 else 997))
    encoder = Encoder(BPE, True)
    want = Counter((r.doc_id, len(encoder.encode([r.text])[0]) // 2) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in separator_scan.document_token_counts(docs, BPE).collect()) == want


def test_scan_of_raw_blocks(spark):
    stream, size = [5, 9, 9, 1, 2, 3, 4, 5, 6, 9, 7], 2
    blocks = [("f", i, np.array(stream[s : s + size], "<u2").tobytes()) for i, s in enumerate(range(0, len(stream), size))] + [("e", 0, None), ("g", 0, b"")]
    got = separator_scan.scan(spark.createDataFrame(blocks, "file string, block int, ids binary"), separator=9).collect()
    assert sorted(map(tuple, got)) == [("f", 0, 0, 1, True), ("f", 1, 2, 0, True), ("f", 2, 3, 6, True), ("f", 3, 10, 1, False)]


def test_raw_files(spark, tmp_path):
    np.array([1, 9, 2, 2, 9], "<u2").tofile(tmp_path / "a.bin")
    got = separator_scan.scan(separator_scan.read_flat(spark, str(tmp_path), 2, 2), separator=9).collect()
    assert sorted((r.number, r.start, r.n_tokens, r.ended) for r in got) == [(0, 0, 1, True), (1, 2, 2, True)]


# --- language model ---

def test_language_model(docs, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BATCH_TOKENS", 500)
    rows = [(r.doc_id, words(r.text) + [None]) for r in docs.collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter(x for d, w in rows if not held(d) for x in w)
    n, v = sum(counts.values()), len(counts)
    got = pitman_yor.document_scores(docs).collect()
    want = sorted([(d, held(d), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for d, w in rows], key=str)
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got], key=str) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert pitman_yor.document_scores(empty(docs)).count() == 0


def test_model_beats_base_on_held_out_text(spark):
    rows = [(i, " ".join(f"w{(i * 3 + k) % 40}" for k in range(60))) for i in range(200)]
    got = pitman_yor.document_scores(spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA)).where("held_out").collect()
    assert sum(r.score for r in got) > 0.5 * sum(r.base_score for r in got)


def test_seating_matches_the_process():
    """Mean tables of long and short parties against the process simulated one customer at a time."""
    rng = np.random.default_rng(0)
    for count, mass, d in ((5, 0.7, 0.5), (300, 2.5, 0.4)):
        key = rng.integers(0, 2**62, 4000).astype(np.uint64)
        got = pitman_yor.seat(np.full(4000, count), np.full(4000, mass), d, key).mean()
        tables = np.ones(4000)
        for i in range(1, count):
            tables += rng.random(4000) * (i - d * tables + mass) < mass
        assert abs(got - tables.mean()) < 0.05 * tables.mean()


# --- quality ---

def quality_rows(spark):
    good = [(i, prose(i, 150) + ".") for i in range(150)]
    bad = [(1000 + i, " ".join(["spam!!"] * 60 + prose(i, 5).upper().split())) for i in range(60)]
    docs = spark.createDataFrame([(d, t, "", "") for d, t in [*good, *bad, (5000, None), (5001, "")]], SCHEMA)
    labels = spark.createDataFrame([(d, 1) for d, _ in good] + [(d, 0) for d, _ in bad] + [(5000, None), (None, 1), (1, 1)], "doc_id long, quality int")
    return docs, labels


def test_quality(spark):
    docs, labels = quality_rows(spark)
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert len(got) == 212 and all(0 <= r.score <= 1 for r in got.values())
    held = [r for r in got.values() if r.held_out and r.doc_id < 5000]
    assert held and np.mean([r.predicted == (r.doc_id < 1000) for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    kept = accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.predicted}


def test_quality_without_labels(spark):
    docs, labels = quality_rows(spark)
    assert {r.score for r in quality_scores(docs, labels.where("false")).collect()} == {0.5}
    assert quality_scores(docs.where("false"), labels).count() == 0


# --- personal data ---

PRIVATE = [
    (1, "Mr John Smith met Mrs. Smith; mail A.b@Ex.co.uk or a.b@ex.co.uk, card 4111 1111 1111 1111, 10.0.0.1"),
    (2, None), (3, ""), (4, "г-жа Иванова и Елена Иванова"), (5, 'token="0123456789abcdef" and +1 (017) 555-7713'), (5, 'token="0123456789abcdef" and +1 (017) 555-7713'), (6, "plain prose, 12 of them."),
]


def test_surrogates(spark):
    docs = spark.createDataFrame([(d, t, "keep", "me") for d, t in PRIVATE], SCHEMA)
    got = {r.doc_id: r for r in pseudonymised(docs, "k").collect()}
    one = re.fullmatch(r"Mr (\w+) (\w+) met Mrs\. (\w+); mail (\S+) or (\S+), card (\d{4} \d{4} \d{4} \d{4}), (\d+\.\d+\.\d+\.\d+)", got[1].text)
    assert one[2] == one[3] != "Smith" and one[4] == one[5] != "a.b@ex.co.uk" and one[4].endswith(".uk")
    digits = [int(c) for c in one[6] if c.isdigit()]
    assert sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits)) % 10 == 0
    assert all(1 <= int(x) <= 254 for x in one[7].split(".")) and got[1].kinds == "card,email,ip,name"
    assert got[2].text is None and got[3].text == "" and got[6].text == PRIVATE[-1][1]
    four = re.fullmatch(r"г-жа (\w+) и (\w+) (\w+)", got[4].text)
    assert four[1] == four[3] != "Иванова" and re.search("[а-я]$", four[2])
    assert re.fullmatch(r'token="[0-9a-f]{16}" and \+1 \(\d{3}\) \d{3}-\d{4}', got[5].text) and got[5].text != PRIVATE[4][1]
    out = replaced(docs, "k")
    assert out.columns == [*docs.columns, "_entities"] and out.count() == len(PRIVATE)
    assert replaced(docs.where("false"), "k").count() == 0


def test_surrogates_stay_distinct(spark):
    """More surnames than short surrogate names: clashes must be drawn anew."""
    rows = [(i, f"Mr {chr(65 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}") for i in range(1500)]
    got = pseudonymised(spark.createDataFrame([(d, t, "", "") for d, t in rows], SCHEMA), "k").collect()
    assert len({r.text for r in got}) == len({t for _, t in rows}) == 1500


# --- pieces ---

def test_pieces_round_trip(docs):
    out = decoded_pieces(sampled_pieces(docs, PIECES), PIECES)
    assert out.columns == [*docs.columns, "pieces", "decoded"]
    assert all(r.decoded == r.text for r in out.collect())
    first = sorted(map(tuple, sampled_digest(docs, PIECES).collect()), key=str)
    assert first == sorted(map(tuple, sampled_digest(docs.repartition(3), PIECES).collect()), key=str)
    assert all(r[3] for r in first) and sampled_digest(empty(docs), PIECES).count() == 0


def test_pieces_follow_the_lattice():
    model, word = Pieces(PIECES), "their"
    data = ("▁" + word).encode()

    def ways(s):
        if s == len(data):
            yield (), 0.0
        for e in range(s + 1, len(data) + 1):
            if got := model.weights.get(data[s:e]):
                for rest, w in ways(e):
                    yield (got[0], *rest), w + got[1]

    chance = {k: math.exp(w) for k, w in ways(0)}
    total, n = sum(chance.values()), 40_000
    ids, bounds = model.sample([word] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919))
    seen = Counter(tuple(ids[bounds[i] : bounds[i + 1]].tolist()) for i in range(n))
    assert set(seen) <= set(chance) and all(abs(seen[k] / n - p / total) < 0.02 for k, p in chance.items())


def test_long_and_short_lattices_agree(monkeypatch):
    model = Pieces(PIECES)
    words = ["their", "x", "", "naïve", "  two", "🙂▁é" * 5, "a" * 70, "b" * 300]
    want = model.lattices(words)
    for short in (0, 16):
        monkeypatch.setattr(piece_sampling, "_SHORT", short)
        assert all(np.allclose(x, y) for x, y in zip(model.lattices(words), want, strict=True))


def test_sampled_words_take_about_as_many_pieces_as_the_library():
    from sentencepiece import SentencePieceProcessor

    text = "The quick brown fox jumps over the lazy dog near the river bank in early spring"
    ids, _ = Pieces(PIECES).sample([text] * 500, np.arange(500, dtype=np.uint64))
    assert len(ids) / 500 < 1.5 * len(SentencePieceProcessor(model_file=PIECES).encode(text))


def test_documents_that_occur_twice_are_scored_apart(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BATCH_TOKENS", 3000)
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(2000)]
    made = [" ".join(rng.choice(vocabulary, 60)) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(made)] + [(1000 + i, t) for i, t in enumerate(made[:50])]
    got = pitman_yor.document_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    score = {r.doc_id: r.score / r.n_tokens for r in got if not r.held_out}
    assert all(abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)
    twice = [score[i] for i in range(50) if i in score and 1000 + i in score]
    once = [score[i] for i in range(50, 150) if i in score]
    assert min(twice) > max(once)
    # contexts grow with the corpus: rare words predict what follows them as well as frequent ones do
    assert np.mean(once) > np.mean([r.score / r.n_tokens for r in got if r.held_out and 50 <= r.doc_id < 150]) + 0.5

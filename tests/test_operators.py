"""Operators beyond the registered queries, against brute force on small fixtures."""

import re
import zipfile

import pytest
from pyspark.sql import functions as F

from brinework.functions import scalars
from brinework.operators import build, faithful, knowledge, layout, rules, text, tools, workflow
from brinework.plans import registry
from brinework.sources import loaders
from brinework.sources.field import Field
from brinework.sources.store import new_path
from brinework.sources.versioned import Conflict, VersionedTable
from brinework.streaming import intake

SF = "/root/testdata/sf0.001"


# --- texts ---

def cut(paragraph, limit, overlap):
    while len(paragraph) > limit:
        spaces = [i for i in range(limit - 200, limit) if paragraph[i] == " "]
        at = spaces[-1] if spaces else limit
        yield paragraph[:at].strip(), True
        paragraph = paragraph[at - overlap :].strip()
    yield paragraph, False


def packed(source, limit=1500, overlap=200):
    done, held = [], ""
    for p in re.split(r"\n\s*\n", source or ""):
        for piece, alone in cut(p.strip(), limit, overlap):
            if alone:
                done += [*([held] if held else []), piece]
                held = ""
            elif piece and held and len(held) + 2 + len(piece) > limit:
                done.append(held)
                held = (held[-overlap:] + "\n\n" + piece).strip()
            elif piece:
                held = held + "\n\n" + piece if held else piece
    return [*done, held] if held else done


def test_paragraph_chunks(spark):
    word = "abcdefghi "
    texts = [None, "", " \n\n ", "one\n\ntwo", word * 400, "x" * 4000, "p\n \nq " * 300, word * 140 + "\n\n" + word * 20 + "\n\nend", "é" * 1499 + "\n\n" + "ü" * 10, word * 149 + "\n\n" + "y" * 1600 + " z\n\ntail"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", text.paragraph_chunks(F.col("text")).alias("c")).collect()
    assert {r.i: r.c for r in got} == {i: packed(t) for i, t in enumerate(texts)}


UNIQUE = [f"w{k:05d}" for k in range(400)]


@pytest.mark.parametrize("source", ["", "short", ". ".join(UNIQUE), "first\n\n" + "\n".join(UNIQUE), " ".join(UNIQUE), "".join(UNIQUE)])
def test_recursive_pieces_cover_the_text(source):
    pieces = text.recursive_pieces(source)
    assert all(p and len(p) <= 400 for p in pieces)
    at = 0
    for p in pieces:  # in order, each beginning no later than where the one before ends
        k = source.find(p)
        assert k >= 0 and at - 60 <= k + 2 and not source[at:k].strip()
        at = k + len(p)
    assert not source[at:].strip()


def test_sentences_stay_together_by_topic(spark):
    rows = [(1, 0, "A.", [1.0, 0.0]), (1, 1, "B.", [0.9, 0.1]), (1, 2, "C.", [0.0, 1.0]), (1, 3, "D" * 900, [0.0, 1.0]), (2, 0, "E.", None), (2, 1, "F.", [1.0, 0.0])]
    got = text.sentence_chunks(spark.createDataFrame(rows, "doc_id int, n int, sentence string, embedding array<double>")).collect()
    assert sorted((r.doc_id, r.chunk, r.piece[:5]) for r in got) == [(1, 0, "A. B."), (1, 1, "C."), (1, 2, "DDDDD"), (2, 0, "E."), (2, 1, "F.")]
    row = spark.createDataFrame([("Hi there. Is it? Yes!  ok", "ﬁ\x01１")], "t string, u string").select(text.sentences_of(F.col("t")).alias("s"), text.nfkc(F.col("u")).alias("n")).first()
    assert row.s == ["Hi there.", "Is it?", "Yes!", "ok"] and row.n == "fi1"


def test_numbers_are_cited_or_not(spark):
    rows = [("VRR 1.327 and 0.6", [1.3269, 0.56], []), ("about 1.4", [1.327], ["1.4"]), ("fell by 0.0255", [-0.025477], []), ("in 2024, v1.2.3 of 7", [], []), ("", [], []), ("12.5%", None, ["12.5"])]
    got = spark.createDataFrame([(a, b) for a, b, _ in rows], "t string, f array<double>").select(text.uncited(F.col("t"), F.coalesce("f", F.array().cast("array<double>"))).alias("u")).collect()
    assert [r.u for r in got] == [u for _, _, u in rows]


def test_redaction_keeps_order_and_kinds(spark):
    rows = [(1, "mail a@b.org, ssn 123-45-6789, password: x9 4111 1111 1111 1111"), (2, None), (3, "nothing here")]
    got = {r.doc_id: (r.clean, r.kinds) for r in text.redacted(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    want = {}
    for i, t in rows:
        clean, kinds = t or "", []
        for kind, pattern in text.PII.items():
            if re.search(pattern, clean):
                kinds.append(kind)
            clean = re.sub(pattern, f"[REDACTED:{kind}]", clean)
        want[i] = (clean, kinds)
    assert got == want


# --- narration ---

def test_faithfulness(spark):
    drivers = [("water_inj_res", 0.7, 0.1, 50.0), ("oil_res", 0.05, -0.01, 5.0), ("free_gas_res", 0.25, 0.03, -9.0)]
    said = {
        "Water injection increased and drove the move.": ([], ["water_inj_res"]),
        "The move was driven by oil production.": ([("unsupported_driver", "oil_res")], []),
        "Oil production contributed little.": ([], ["oil_res"]),
        "Gas injection rose.": ([("unsupported_driver", "gas_inj_res")], []),
        "Water injection fell, pushing the ratio up.": ([("wrong_direction", "water_inj_res")], ["water_inj_res"]),
        "Produced gas was lower.": ([], ["free_gas_res"]),
    }
    kind = "answer string, drivers array<struct<term: string, share: double, contribution: double, delta: double>>"
    got = {r.answer: ([tuple(v) for v in r.violations], r.supported) for r in faithful.checked(spark.createDataFrame([(a, drivers) for a in said], kind)).collect()}
    assert got == said
    assert all(r.faithful for r in faithful.checked(spark.createDataFrame([("Oil rate fell", None), (None, drivers), ("Oil rate fell", [])], kind)).collect())


def test_narratives_hold_only_computed_numbers(spark):
    rows = registry.QUERIES["j05_narratives"](spark, SF).collect()
    assert rows and all(r.n_uncited == 0 for r in rows)
    lines = [r.narrative.split("\n") for r in rows]
    assert all(x[1].startswith("Ratio ") and x[2].startswith("Rules: ") and x[3].startswith("Inputs: ") and x[-1].startswith("Proposed: ") for x in lines)
    assert any(x.startswith("Since the month before: ") for n in lines for x in n) and any(len(x) == 5 for x in lines)
    assert any("fluid properties by " in x[3] and "recomputed " in x[3] for x in lines)


# --- the stored build ---

@pytest.fixture(scope="module")
def built(spark):
    return build.store(Field(spark, SF), new_path(spark, "curated"), "run-1")


def test_a_tampered_row_is_found(spark, built):
    field = Field(spark, SF)
    victim = built.monthly.where("prod_res > 0").orderBy("id_pattern", "vrr_date").select("id_pattern", "vrr_date").first()
    hit = (F.col("id_pattern") == victim.id_pattern) & (F.col("vrr_date") == victim.vrr_date)
    tampered = built.monthly.withColumn("vrr", F.when(hit, F.col("vrr") + 0.01).otherwise(F.col("vrr")))
    audited = tools.audit(tampered, build.pattern_vrr(build.contrib_of(field), "monthly"))
    assert [(r.id_pattern, r.vrr_date) for r in audited.where("not matches and recomputed_vrr is not null").collect()] == [tuple(victim)]
    diff = rules.recompute_difference(tampered, built.contrib).where(f"abs(difference) > {rules.RECOMPUTE_TOLERANCE}").collect()
    assert [(r.id_pattern, r.period) for r in diff] == [tuple(victim)]


def test_a_stale_build_is_a_finding(spark):
    rows = [(1, 5, ["exact"], 0, 0, 0, 0, 10, 0.5), (2, 5, ["exact"], 0, 0, 0, 0, 10, 0.0), (3, 5, ["closest"], 0, 0, 0, 0, 10, 0.5), (4, 0, [], 0, 0, 0, 0, 10, None), (5, 5, ["exact"], 0, 0, 0, 2, 2000, None)]
    kind = "id_pattern int, n_rows int, pvt_methods array<string>, n_missing_pressure int, n_missing_factor int, n_allocation_over_one int, n_allocated_without_volumes int, allocation_age_days int, difference double"
    got = {r.id_pattern: r for r in rules.assess_inputs(spark.createDataFrame(rows, kind)).collect()}
    assert [got[i].verdict for i in range(1, 6)] == ["DATA_ARTIFACT", "REAL_SIGNAL", "DATA_ARTIFACT", "INCONCLUSIVE", "INCONCLUSIVE"]
    assert got[1].summary == "stale_build" and got[3].summary == "pvt_not_measured" and got[1].owner == "data_steward" and got[2].actionable
    assert [f.rule for f in got[5].findings] == ["allocated_without_volumes", "stale_allocation"]


def test_stored_rows_carry_the_run(built):
    assert {r.run_id for t in (built.contrib, built.pattern, built.cumulative) for r in t.select("run_id").distinct().collect()} == {"run-1"}
    assert {r.grain for r in built.pattern.select("grain").distinct().collect()} == {"monthly", "daily"}


def test_held_values(spark):
    needs = spark.createDataFrame([("a", 1), ("a", 5), ("a", 5), ("a", 9), ("b", 3)], "k string, d int")
    known = spark.createDataFrame([("a", 2, 20.0), ("a", 5, 50.0), ("c", 1, 1.0)], "k string, r int, v double")
    got = {(x.k, x.d): x.v for x in build.held_values(needs, known, "k", "d", "r", "v").collect()}
    assert got == {("a", 1): None, ("a", 5): 50.0, ("a", 9): 50.0, ("b", 3): None}


def test_units_and_sums(spark):
    row = spark.createDataFrame([(1.0, 3.0, 0.0)], "a double, b double, z double").select(
        scalars.vrr(F.col("b"), F.col("a")).alias("v"), scalars.vrr(F.col("a"), F.col("z")).alias("n"), scalars.same(F.col("a"), F.col("a") + 1e-12).alias("s"), scalars.log_mean(F.col("a"), F.col("b")).alias("l"),
        build.unit_multiplier(F.lit("Metric")).alias("m"), build.unit_multiplier(F.lit(None).cast("string")).alias("o"), scalars.is_hex_id(scalars.hex_id(F.lit("x"), F.lit("y"))).alias("h"),
    ).first()
    assert row.v == 3.0 and row.n is None and row.s and abs(row.l - 2 / 1.0986122886681098) < 1e-12 and (row.m, row.o, row.h) == (1.0, 1000.0, True)


# --- workflow ---

def test_moves_need_the_role_of_their_stage(spark):
    queue = spark.createDataFrame([(1, "draft"), (2, "rm"), (3, "site"), (4, "executed"), (5, "analyst"), (6, "odd")], "action_id int, stage string")
    asked = spark.createDataFrame([(1, "advance", "u", "analyst"), (2, "reject", "u", "analyst"), (3, "advance", "u", "site"), (4, "advance", "u", "site"), (6, "advance", "u", "rm")], "action_id int, verb string, user string, role string")
    got = {r.action_id: (r.moved_to, r.refused, r.moved_by) for r in workflow.moved(queue, asked).collect()}
    assert got == {1: ("analyst", None, "u"), 2: ("rm", "needs site", None), 3: ("executed", None, "u"), 4: ("executed", "stage is final", None), 5: ("analyst", None, None), 6: ("odd", "stage is final", None)}
    cases = [("draft", "analyst", True), ("draft", "rm", False), ("site", "rejected", True), ("executed", "rejected", False)]
    got = spark.createDataFrame(cases, "a string, b string, w boolean").select("w", workflow.can_transition(F.col("a"), F.col("b")).alias("g")).collect()
    assert all(r.w == r.g for r in got)


def test_asked_dates(spark):
    want = {"what of 2026-04-17?": "2026-04-01", "in 2026-04": "2026-04-01", "April 2026 please": "2026-04-01", "since apr 2025": "2025-04-01", "no date": None, "in 2026-13": None, "week 2024": None}
    got = spark.createDataFrame([(q,) for q in want], "q string").select("q", workflow.asked_date(F.col("q")).cast("string").alias("d")).collect()
    assert {r.q: r.d for r in got} == want


def test_rate_limits_fold_in_order(spark):
    calls = [("chat_agentic", "u", float(t)) for t in (0, 10, 20, 30, 40, 50, 299, 300, 301)] + [("chat_agentic", "v", 1.0), ("other", "u", 2.0)]
    got = {(r.bucket, r.who, r.ts): (r.n, r.refused) for r in workflow.rate_limited(spark.createDataFrame(calls, "bucket string, who string, ts double")).collect()}
    assert [got["chat_agentic", "u", t] for b, u, t in calls if (b, u) == ("chat_agentic", "u")] == [(1, False), (2, False), (3, False), (4, False), (5, False), (6, True), (7, True), (1, False), (2, False)]
    assert got["chat_agentic", "v", 1.0] == (1, False) and got["other", "u", 2.0] == (1, False)


def test_trace_scores(spark):
    tool = lambda t, o, name, out, answer=None: (t, o, name, "TOOL", out, answer)
    rows = [
        tool(1, 0, "VRR_AUDIT", "value 1.25"), tool(1, 1, "RECOMMEND_CHANGE", "ok"), (1, 2, "end", "CHAIN", None, "VRR is 1.25"),
        tool(2, 0, "RECOMMEND_CHANGE", "DATA_ARTIFACT"), (2, 1, "end", "CHAIN", "gate rejected", "reduce injection to 9.99"),
        tool(3, 0, "tool_call", '{"tool": "INPUT_AUDIT"}'), tool(3, 1, "tool_call", '{"tool": "RECOMMEND_CHANGE"}'),
    ]
    got = {r.trace_id: (r.tools_used, r.audit_before_advice, r.gate_passed, r.no_advice_on_artifact, r.numbers_grounded) for r in workflow.trace_scores(spark.createDataFrame(rows, "trace_id int, ordinal int, name string, span_type string, outputs string, answer string")).collect()}
    assert got == {1: (2, True, True, True, True), 2: (1, False, False, False, False), 3: (2, True, True, True, True)}
    row = workflow.latency_summary(spark.createDataFrame([(i, float(i)) for i in range(11)], "trace_id int, duration_ms double")).first()
    assert tuple(row) == (5.0, 9.0, 10.0)


def test_keyed_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, workflow.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, workflow.inserted_if_absent(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    queue = spark.createDataFrame([(1, "d1", "draft"), (1, "d2", "draft"), (1, "d1", "rm")], "id_pattern int, vrr_date string, stage string")
    assert sorted(map(tuple, workflow.replaced_drafts(queue, spark.createDataFrame([(1, "d1", "draft")], queue.schema)).collect())) == [(1, "d1", "draft"), (1, "d1", "rm"), (1, "d2", "draft")]


# --- layout and knowledge ---

def test_five_spot_is_a_square(spark):
    rows = [(1, "2024-01", c, "injector" if c == 0 else "producer", 0.5, 0.0 if c == 0 else 0.25, 1.0 if c == 0 else 0.0, "exact") for c in range(5)]
    kind = "id_pattern int, vrr_date string, id_completion int, role string, factor double, share_of_production double, share_of_injection double, pvt_methods string"
    named = spark.createDataFrame(rows, kind).withColumn("completion_name", F.lit("W"))
    got = {r.id_completion: r for r in layout.placed(named, spark.createDataFrame([(1, 2)], "id_completion int, n_patterns int")).collect()}
    assert {r.geometry for r in got.values()} == {"five_spot"} and (got[0].x, got[0].y) == (0.0, 0.0)
    assert (got[1].x, got[1].y) == (56.57, -56.57) and (got[2].x, got[2].y) == (56.57, 56.57) and got[1].shared and not got[2].shared


def test_registry_and_topics(spark):
    kind = "doc_id string, file_name string, status string, sha256 string, uploaded_by string"
    old = spark.createDataFrame([("d1", "f", "pending_review", "ab", "u"), ("d2", "g", "pending_review", "cd", "u"), ("d3", "h", "approved", "ef", "u"), ("d4", "i", "pending_review", None, "u")], kind)
    uploads = spark.createDataFrame([("x", bytearray(b"one"), "u"), ("y", bytearray(b"one"), "u"), ("z", bytearray(b"two"), "u")], "file_name string, content binary, uploaded_by string")
    got = {r.file_name: r for r in knowledge.registered(old, uploads).collect()}
    assert got["y"].reason == "content is registered already" and [r.accepted for r in knowledge.registered(old, uploads, chunks=20_000).collect()] == [False] * 3
    full = {r.file_name: r.reason for r in knowledge.registered(old, uploads.withColumn("errors", F.when(F.col("file_name") == "x", F.array(F.lit("too large")))), max_documents=5).collect()}
    assert full == {"x": "rejected: too large", "y": None, "z": "documents are full"}
    assert got["x"].accepted and not got["y"].accepted and got["z"].accepted and got["x"].doc_id == "up-" + got["x"].sha256[:24]
    reviews = spark.createDataFrame([("d1", True), ("d2", False), ("d3", False), ("d4", True)], "doc_id string, approve boolean")
    chunks = spark.createDataFrame([("d1",), ("d1",), ("d3",)], "doc_id string")
    assert {r.doc_id: r.status for r in knowledge.reviewed(old, reviews, chunks).collect()} == {"d1": "approved", "d2": "rejected", "d3": "approved", "d4": "pending_review"}
    tight = {r.doc_id: (r.status, r.review_note) for r in knowledge.reviewed(old, reviews, chunks, max_chunks=1).collect()}
    assert tight["d1"] == ("pending_review", "chunks are full") and tight["d4"] == ("pending_review", "nothing could be ingested")
    assert knowledge.usage(old, chunks).first().asDict() == {"documents": 4, "approved": 1, "pending": 3, "chunks": 3, "documents_left": 196, "chunks_left": 19997}
    topics = spark.createDataFrame([("approvals", ["approve", "board"]), ("roles", ["role", "can approve"]), ("none", ["zzz"])], "topic_id string, keywords array<string>")
    asked = spark.createDataFrame([(1, "Which role can approve?"), (2, "the board"), (3, None)], "question_id int, question string")
    assert {r.question_id: r.topic_id for r in knowledge.matched_topics(asked, topics).collect()} == {1: "roles", 2: "approvals"}


def test_previews(spark):
    long = "word " * 500
    pages = [(1, 2, "b a@b.com"), (1, 1, "call 555-123-4567\nor a@b.com, c@d.org"), (2, 1, long), (3, 1, None), (3, 2, "")]
    got = {r.doc_id: r for r in text.preview(spark.createDataFrame(pages, "doc_id int, page int, text string"), strategy="fixed").collect()}
    assert got[1].extracted_text == "call [REDACTED:phone] or [REDACTED:email], [REDACTED:email]\n\nb [REDACTED:email]" and got[1].pii_kinds == {"email": 2, "phone": 1}
    assert [(r.pages, r.n_chunks, r.truncated, r.empty_extraction) for r in (got[1], got[2], got[3])] == [(2, 2, False, True), (1, 13, True, False), (2, 0, False, True)]
    assert got[2].total_chars == len(long.strip()) and got[2].extracted_text == long[:1200] and got[2].pii_kinds == {} and got[3].total_chars == 2
    recursive = text.preview(spark.createDataFrame(pages, "doc_id int, page int, text string")).where("doc_id = 2").first()
    assert recursive.n_chunks == len(text.recursive_pieces(long.strip()))


# --- files and streams ---

def test_every_file_of_a_folder_is_a_row(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,two\n3,\n")
    (tmp_path / "y.txt").write_text("plain")
    (tmp_path / "p.html").write_text("<title> T </title><script>no</script><p>yes</p>")
    (tmp_path / "z.foo").write_text("?")
    (tmp_path / "bad.docx").write_text("no zip")
    with zipfile.ZipFile(tmp_path / "w.docx", "w") as z:
        z.writestr("[Content_Types].xml", "")
        z.writestr("word/document.xml", "<w:p ><w:t>one</w:t></w:p><w:p ><w:t>two</w:t></w:p>")
    rows = loaders.load_directory(spark, f"file://{tmp_path}").collect()
    got = {(r.path.rpartition("/")[2], r.page): r for r in rows}
    assert got["x.csv", 1].text == "a: 1\nb: two" and got["x.csv", 2].text == "a: 3\nb: " and got["y.txt", 1].text == "plain"
    assert got["p.html", 1].title == "T" and "yes" in got["p.html", 1].text and "no" not in got["p.html", 1].text
    assert got["w.docx", 1].text == "one\ntwo" and got["bad.docx", None].error and got["z.foo", None].error and len(rows) == 7
    errors = {r.path.rpartition("/")[2]: r.errors for r in loaders.validated(loaders.files(spark, f"file://{tmp_path}")).collect()}
    assert errors["y.txt"] == ["file is empty or truncated"] and errors["p.html"] == [] and errors["w.docx"] == []
    assert errors["z.foo"] == ["type is not accepted"] and errors["bad.docx"] == ["file is empty or truncated", "content does not match its type"]


def test_every_broken_rule_of_an_upload_is_told(spark, tmp_path):
    long = "a line of text\n" * 2000
    (tmp_path / "late.txt").write_bytes(long.encode() + b"\x00")
    (tmp_path / "mixed.csv").write_bytes(bytes(range(256)) * 4096)
    (tmp_path / "run.md").write_bytes(b"#!/bin/sh\n" + long.encode())
    (tmp_path / "packed.pdf").write_bytes(b"\x1f\x8b" + b"\x00" * 20)
    (tmp_path / "large.html").write_text("x" * ((5 << 20) + 1))
    (tmp_path / "fine.TXT").write_text(long)
    with zipfile.ZipFile(tmp_path / "bomb.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("../word/document.xml", "0" * 4_000_000)
    (tmp_path / "torn.docx").write_bytes(b"PK\x03\x04" + b"x" * 100)
    got = {r.path.rpartition("/")[2]: r.errors for r in loaders.validated(loaders.files(spark, f"file://{tmp_path}")).collect()}
    assert got == {
        "late.txt": ["text holds binary data"], "mixed.csv": ["text holds binary data"], "run.md": ["executable or packed content"], "packed.pdf": ["executable or packed content"],
        "large.html": ["file is too large"], "fine.TXT": [], "torn.docx": ["archive cannot be read"],
        "bomb.docx": ["archive is packed too tightly", "archive is no document", "archive names paths outside itself"],
    }


def events(n):
    return [(i % 7, f"2024-01-{1 + i % 5:02d}", float(i), i) for i in range(n)]


def test_batches_merge_as_one(spark):
    kind = "id_completion long, d string, oil double, o long"
    of = lambda rows: spark.createDataFrame(rows, kind).select("id_completion", F.to_date("d").alias("event_date"), "oil", *[F.lit(0.0).alias(c) for c in intake.VOLUMES[1:]], F.concat(F.lit("u"), "o").alias("uom"), F.lit(None).cast("timestamp").alias("emitted_ts"), "o")
    rows = events(80)
    whole = intake.merged(of(rows), "o")
    state = intake.merged(of(rows[50:]), "o")
    state = intake.absorb(intake.absorb(state, of(rows[:20]), "o"), of(rows[20:50]), "o")
    key = lambda df: sorted(str(tuple(r)) for r in df.select(*whole.columns).collect())
    assert key(state) == key(whole) and intake.redeliveries(whole).first()[0] == 80 - whole.count()


def test_a_stream_ends_in_the_merged_state(spark, tmp_path):
    source, rows = tmp_path / "in", events(60)
    for k in range(3):
        part = spark.createDataFrame(rows[k * 20 : k * 20 + 20], "id_completion long, d string, oil double, o long")
        part.coalesce(1).write.mode("append").parquet(f"file://{source}")
    stream = spark.readStream.schema("id_completion long, d string, oil double, o long").option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
    shaped = stream.select("id_completion", F.to_date("d").alias("event_date"), "oil", *[F.lit(0.0).alias(c) for c in intake.VOLUMES[1:]], F.lit("OilField").alias("uom"), F.lit(None).cast("timestamp").alias("emitted_ts"), "o")
    query = intake.stream_to(shaped, f"file://{tmp_path}/state", f"file://{tmp_path}/cp", "o")
    assert [(p["batch"], p["n_rows"]) for p in intake.batch_progress(query) if p["n_rows"]] == [(0, 20), (1, 20), (2, 20)]
    table = VersionedTable(spark, f"file://{tmp_path}/state")
    assert table.versions() == [0, 1, 2, 3] and table.read(1).agg(F.sum("n_deliveries")).first()[0] == 20
    last = table.read()
    batch = spark.createDataFrame(rows[:20], "id_completion long, d string, oil double, o long").select("id_completion", F.to_date("d").alias("event_date"), "oil", *[F.lit(0.0).alias(c) for c in intake.VOLUMES[1:]], F.lit("OilField").alias("uom"), F.lit(None).cast("timestamp").alias("emitted_ts"), "o")
    again = table.change(batch, lambda state, new: intake.absorb(state, new, "o"), writer=f"file://{tmp_path}/cp", number=2)
    assert again == 3 and table.versions() == [0, 1, 2, 3]  # a batch that is run again changes nothing
    want = {}
    for c, d, oil, o in rows:
        n, top = want.get((c, d), (0, (-1, 0.0)))
        want[c, d] = (n + 1, max(top, (o, oil)))
    assert {(r.id_completion, str(r.event_date)): (r.n_deliveries, (r.o, r.oil)) for r in last.collect()} == want


def test_payloads_that_do_not_parse_are_kept(spark):
    rows = [('{"id_completion": 1, "event_date": "2024-01-01", "oil": 2.5}', 1), ("{broken", 2), ('{"oil": 1}', 3), (None, 4)]
    good, dead = intake.parsed(spark.createDataFrame(rows, "value string, n int"))
    assert [r.oil for r in good.collect()] == [2.5] and sorted(r.n for r in dead.collect()) == [2, 3, 4]


def test_resume_date(spark):
    dated = lambda name, days: spark.createDataFrame([(d,) for d in days], "d string").select(F.to_date("d").alias(name))
    of = lambda a, b: str(intake.resume_date(dated("event_date", a), dated("prod_date", b)).first()[0])
    assert of(["2024-02-28", None], ["2024-01-01"]) == "2024-02-29" and of([], ["2024-12-31"]) == "2025-01-01" and of([], []) == "1900-01-02"


def test_published_events_parse_back(spark):
    rows = spark.sql("select 5L id_completion, date '2024-01-02' event_date, 1.5D oil, cast(null as double) water, 0D gas, 0D water_inj, 0D gas_inj, 'OilField' uom, timestamp '2024-01-03 04:05:06' emitted_ts")
    sent = intake.kafka_rows(rows)
    good, dead = intake.parsed(sent)
    assert sent.first().key == "5" and good.drop("key").collect() == rows.collect() and dead.isEmpty()

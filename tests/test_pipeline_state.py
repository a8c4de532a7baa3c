import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from docketry import app, model
from docketry import __main__ as cli
from docketry.operators import classify, enrich, report, state
from docketry.sources import tables

ROWS = "doc_id long, file_name string, text string, n_pages int"


def types(frame):
    return {(r.doc_id, r.doc_type): round(r.score, 6) for r in frame.collect()}


@pytest.mark.parametrize("name,doc_type,score", [
    ("Deposition of A.pdf", "deposition", 1.0), ("condensed_transcript.pdf", "deposition", 1.0), ("Hearing Transcript 2.pdf", "hearing_transcript", 1.0), ("Rebuttal Report.pdf", "expert_report", 1.0),
    ("Decl. of B.pdf", "declaration", 1.0), ("Motion to Dismiss.pdf", "motion", 1.0), ("Reply.pdf", "brief", 1.0), ("US patent.pdf", "patent", 1.0), ("Office Action.pdf", "patent_prosecution", 1.0),
    ("Settlement.pdf", "agreement", 1.0), ("10-K.pdf", "sec_filing", 1.0), ("IEEE 802.pdf", "technical_standard", 1.0), ("Affidavit.pdf", "witness_statement", 1.0), ("Resp to ROGs.pdf", "discovery_response", 1.0),
    ("Second Set of RFPs.pdf", "discovery_request", 1.0), ("intel_prox_0001234.pdf", "exhibit", 0.15),
])
def test_file_names(spark, name, doc_type, score):
    assert types(classify.filename_signal(spark.createDataFrame([(1, name, "", 1)], ROWS)))[1, doc_type] == score


def test_responses_are_no_requests(spark):
    got = types(classify.filename_signal(spark.createDataFrame([(1, "Resp to 2nd Set of Rogs.pdf", "", 1), (2, "plain.pdf", "", 1)], ROWS)))
    assert got == {(1, "discovery_response"): 1.0}


def test_shapes_of_lines(spark):
    texts = [
        "\n".join(f" {i % 25 + 1}  Q.  What?" for i in range(40)), "\n".join(f"{i % 25 + 1}   text" for i in range(25)), "\n".join(f"{i}. The point" for i in range(19)), "\n".join(f"{i}.2.1 Part" for i in range(6)),
        "From: a\nTo: b\nSubject: c\nDate: d", "ITEM 1\n item 2\nITEM 3", "see ¶ 4\n§ 5 x\n¶6\n¶ 7", "INTERROGATORY NO. 1\nINTERROGATORY NO. 2", "INTERROGATORY NO. 1\nGENERAL OBJECTIONS",
    ]
    got = types(classify.structural_signal(spark.createDataFrame([(i, "", t, 3) for i, t in enumerate(texts)], ROWS)))
    assert got == {
        (0, "deposition"): 1.0, (0, "hearing_transcript"): 0.5, (1, "deposition"): 0.7, (2, "expert_report"): 1.0, (2, "declaration"): 0.6, (3, "technical_standard"): 0.4, (3, "agreement"): 0.3, (4, "correspondence"): 1.0,
        (5, "sec_filing"): 0.75, (6, "expert_report"): 0.5, (7, "discovery_request"): 0.666667, (8, "discovery_response"): 0.333333,
    } | ({(0, "deposition"): 1.0})


def test_fonts_and_columns(spark):
    spans = spark.createDataFrame([(1, 1, "Courier-Bold", 0, "x" * 60), (1, 2, "Times", 16, "y" * 40), (1, 9, "Arial", 0, "z" * 900), (2, 1, "Arial", 0, "abc")], "doc_id long, page_no int, font string, flags int, text string")
    ratios = {r.doc_id: r for r in classify.font_ratios(spans).collect()}
    assert (ratios[1].monospace, ratios[1].serif, ratios[1].sans, ratios[1].bold) == (0.6, 0.4, 0.0, 1.0)
    assert types(classify.font_signal(spans)) == {(1, "deposition"): 0.6, (1, "hearing_transcript"): 0.36}
    blocks = spark.createDataFrame([(1, 1, x, x + 100, 600.0) for x in (50.0, 52.0, 54.0, 350.0, 352.0, 354.0)] + [(2, 1, 50.0 + i, 200.0, 600.0) for i in range(6)] + [(3, 1, 1.0, 2.0, 600.0)], "doc_id long, page_no int, l double, r double, width double")
    assert {r.doc_id: r.has_two_columns for r in classify.two_columns(blocks).collect()} == {1: True, 2: False, 3: False}
    rows = spark.createDataFrame([(1, "", "UNDER PENALTY OF PERJURY\n¶ 1 x\n\nIN THE DISTRICT OF X COURT", 2)], ROWS)
    p = classify.fingerprint(rows, spans, blocks).first()
    assert (p.has_perjury_language, p.paragraph_marker_density, p.has_court_caption, p.has_two_columns, p.monospace_ratio, p.avg_chars_per_page) == (1.0, 0.5, 1.0, 1.0, 0.6, len("UNDER PENALTY OF PERJURY\n¶ 1 x\n\nIN THE DISTRICT OF X COURT") / 2)


def test_types_by_all_signals(spark):
    depo = "DEPOSITION OF X\nCOURT REPORTER\nCSR\n" + "\n".join(f" {i}  Q.  The column?" for i in range(1, 26))
    rows = [(1, "Deposition of X.pdf", depo, 1), (2, "x.pdf", "", 1), (3, None, None, 1), (4, "scan.pdf", "\n".join(f"{i % 25 + 1}   text" for i in range(30)), 1), (5, "mail.pdf", "From: a\nTo: b\nSubject: c\nDate: d\nDear", 1)]
    got = {r.doc_id: r for r in classify.classify(spark.createDataFrame(rows, ROWS)).collect()}
    assert (got[1].doc_type, got[1].needs_input) == ("deposition", False) and got[5].doc_type == "correspondence"
    assert [(got[i].doc_type, got[i].confidence, got[i].needs_input) for i in (2, 3)] == [("unknown", 0.0, True)] * 2
    assert got[4].doc_type == "unknown" and got[4].confidence > 0 and got[4].top_types[0].doc_type == "deposition"
    named = classify.with_overrides(classify.classify(spark.createDataFrame(rows, ROWS)), spark.createDataFrame([(2, "brief")], "doc_id long, doc_type string"))
    assert {r.doc_id: (r.doc_type, r.needs_input) for r in named.collect()}[2] == ("brief", False)


def test_profiles_are_learned_and_merged(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 9)] + [("b", 5.0)], "doc_type string, v double")
    halves = [classify.profiles(rows.filter(c), "doc_type", ["v"]) for c in ("v < 3", "v >= 3")]
    both = {r.doc_type: (r.n, r.mean, round(r.m2, 3)) for r in classify.merge_profiles(*halves, "doc_type").collect()}
    assert both == {r.doc_type: (r.n, r.mean, round(r.m2, 3)) for r in classify.profiles(rows, "doc_type", ["v"]).collect()} and both["a"] == (4, 3.75, 38.75)
    near = {(r.k, r.doc_type): r.score for r in classify.profile_scores(spark.createDataFrame([(1, 3.75)], "k long, v double"), "k", ["v"], classify.profiles(rows, "doc_type", ["v"]), "doc_type").collect()}
    assert near[1, "a"] == 1.0 and near[1, "b"] < 0.1


def test_texts_and_condensed_transcripts(spark):
    pages = spark.createDataFrame([(1, 1, "x" * 150), (1, 2, "x" * 60), (2, 1, "scan"), (2, 9, "y" * 999), (3, 2, "7 (5 to 8)")], "doc_id long, page_no int, text string")
    assert {r.doc_id: r.is_text_based for r in classify.text_based(pages).collect()} == {1: True, 2: False, 3: False}
    names = spark.createDataFrame([(1, "a.pdf"), (2, "A Condensed.pdf"), (3, "b.pdf")], "doc_id long, file_name string")
    assert {r.doc_id: r.is_condensed for r in classify.condensed(names, pages).collect()} == {1: False, 2: True, 3: True}


def test_names_skip_what_is_taken(spark):
    assert state.unique_names(["a", "a", "a_2", "a", "a_2", "b"]) == ["a", "a_2", "a_2_2", "a_3", "a_2_3", "b"]
    names = spark.createDataFrame([(i, s) for i, s in enumerate(["a", "a", "a_2", "a", "b", "b_2", "b"])], "k long, stem string")
    got = [r.unique_stem for r in state.disambiguate(names, "k", "stem").orderBy("k").collect()]
    assert got == ["a", "a_2", "a_2_2", "a_3", "b", "b_2", "b_3"] and len(set(got)) == len(got)


def known(spark, *rows):
    at = dt.datetime(2020, 1, 1)
    full = [{"filename": f"{r['stem']}.pdf", "stages_completed": [], "status": "in_progress", "last_updated": at, "retry_count": 0} | r for r in rows]
    names = [c.split()[0] for c in state.DOCUMENTS.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], state.DOCUMENTS)


def test_documents_are_kept_up_to_date(spark):
    held = known(spark, {"stem": "a", "content_hash": "h", "page_count": 0, "author": ""})
    seen = spark.createDataFrame([("a", "a.pdf", "new", 5, "x"), ("b", "b.pdf", "hb", 2, None)], "stem string, filename string, content_hash string, page_count int, author string")
    got = {r.stem: r for r in state.upsert(held, seen).collect()}
    assert (got["a"].content_hash, got["a"].page_count, got["a"].author) == ("h", 0, "x") and (got["b"].status, got["b"].stages_completed, got["b"].retry_count) == ("in_progress", [], 0)
    events = [("a", 1, "stage", "conversion", None), ("a", 2, "failed", None, "boom"), ("a", 3, "stage", "conversion", None), ("a", 4, "completed", None, None), ("b", 1, "failed", None, "x"), ("b", 2, "failed", None, "y")]
    log = spark.createDataFrame([(s, dt.datetime(2021, 1, n), k, g, e) for s, n, k, g, e in events], "stem string, ts timestamp, kind string, stage string, error string")
    after = {r.stem: r for r in state.advance(state.upsert(held, seen), log).collect()}
    assert (after["a"].status, after["a"].stages_completed, after["a"].retry_count, after["a"].error) == ("completed", ["conversion"], 1, "boom")
    assert (after["b"].status, after["b"].retry_count, after["b"].error) == ("failed", 2, "y")


def test_what_is_skipped(spark):
    held = known(spark, {"stem": "a", "content_hash": "h", "status": "failed", "retry_count": 1}, {"stem": "b", "status": "completed"}, {"stem": "c", "status": "failed", "retry_count": 3}, {"stem": "d", "stages_completed": ["conversion"]})
    files = spark.createDataFrame([("a", "1", "h"), ("b", "2", None), ("c", "3", None), ("e", "4", "h"), ("f", "5", "q"), ("g", "6", "q"), ("d", "7", None)], "stem string, path string, content_hash string")
    got = {r.stem: (r.skip, r.duplicate_of) for r in state.skip_reasons(files, held).collect()}
    assert got == {"a": (None, None), "b": ("completed", None), "c": ("failed", None), "e": ("duplicate", "a"), "f": (None, None), "g": ("duplicate", "f"), "d": (None, None)}
    assert {r.skip for r in state.skip_reasons(files, held, force=True).collect()} == {None}
    assert {r.stem: r.skip for r in state.skip_reasons(files, held, skip_failed=False, self_is_duplicate=True).collect()}["a"] == "duplicate"
    stems = spark.createDataFrame([(s,) for s in "abcdz"], "stem string")
    assert {r.stem for r in state.should_process(stems, held, "conversion").filter("process").collect()} == {"a", "b", "z"}
    assert state.should_process(stems, held, "conversion", force=True).filter("process").count() == 5
    assert {r.stem for r in state.incomplete(held).collect()} == {"a", "c", "d"} and state.failed(held).count() == 2
    assert tuple(state.summary(held).first()) == (4, 1, 1, 2)


def test_what_is_indexed(spark):
    row = lambda n, h, c=1, k=("bm25",): (n, n, h, dt.datetime(2020, 1, 1), c, list(k))
    held = spark.createDataFrame([row("a", "1", 20, ("bm25", "chroma")), row("b", "2", 40)], state.INDEXED)
    files = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "filename string, content_hash string")
    assert {r.filename for r in state.to_reindex(files, held).collect()} == {"b", "c"} and state.to_reindex(files, held, True).count() == 3
    assert state.index_is_stale(files, held) and state.index_is_stale(files.filter("filename = 'a'"), held)  # b is gone
    assert not state.index_is_stale(spark.createDataFrame([("a", "1"), ("b", "2")], "filename string, content_hash string"), held)
    assert {r.filename for r in state.index_prune(held, files.filter("filename <> 'b'")).collect()} == {"a"}
    assert state.index_upsert(held, spark.createDataFrame([row("b", "9", 5)], state.INDEXED)).agg(F.sum("chunk_count")).first()[0] == 25
    assert tuple(state.index_summary(held).first()) == (2, 60, 2, 1) and state.index_remove(held, files).count() == 0


ANSWERS = {
    "clean": json.dumps({"summary": " S ", "key_quotes": ["exact words", "not there", " exact words "], "category": "Procedural", "relevance_score": "HIGH", "claims_addressed": [1, 7654321, "7", 2.9, True, "x"]}),
    "fenced": 'Here:\n```json\n{"summary": "", "key_quotes": null, "category": "odd"}\n```\nbye', "around": 'so {"relevance_score": "none"} ok', "broken": "{not json", "empty": "", "none": None,
}


def test_answers_are_read_and_validated(spark):
    empty = spark.createDataFrame([], model.CHUNKS)
    base = spark.createDataFrame([(k, "some exact words here", ["kept"]) for k in ANSWERS] + [("done", "x", [])], "chunk_id string, core_text string, key_quotes array<string>")
    chunks = empty.unionByName(base, allowMissingColumns=True).withColumn("classification_method", F.when(F.col("chunk_id") == "done", "llm"))
    assert enrich.unenriched(chunks).count() == len(ANSWERS) and enrich.unenriched(chunks, True).count() == len(ANSWERS) + 1
    answers = spark.createDataFrame([(k, v, "failed" if v is None else None) for k, v in ANSWERS.items()], "chunk_id string, answer string, error string")
    applied = enrich.apply(chunks, answers, "test")
    got = {r.chunk_id: r for r in applied.collect()}
    c = got["clean"]
    assert (c.summary, c.key_quotes, c.category, c.relevance_score, c.claims_addressed, c.llm_backend) == ("S", ["kept", "exact words"], "procedural", "high", [1, 2, 7], "test")
    assert (got["fenced"].summary, got["fenced"].category, got["fenced"].relevance_score) == (None, "unclassified", "medium") and got["around"].relevance_score == "medium"
    assert all(got[k].enrich_error and got[k].classification_method is None and got[k].key_quotes == ["kept"] for k in ("broken", "empty", "none")) and got["done"].enrich_error is None
    assert enrich.stats(applied).first().asDict() == {"total": 7, "enriched": 3, "skipped": 1, "failed": 3, "quotes_validated": 2, "quotes_discarded": 1}


def test_models_are_asked_again(spark):
    chunks = spark.createDataFrame([("a", "the text"), ("b", "bad")], "chunk_id string, core_text string")
    state_of = {"n": 0}

    def model_fn(prompt):
        state_of["n"] += 1
        if "bad" in prompt or state_of["n"] == 1:
            raise OSError("no")
        return prompt

    got = {r.chunk_id: r for r in enrich.ask(chunks.coalesce(1), model_fn, enrich.context_lines("patent", ["A", "B"], claims=[1]), tries=2, pause=0).collect()}
    assert "the text" in got["a"].answer and "Parties: A, B\nClaims at issue: 1" in got["a"].answer and "exact" not in got["b"].error and got["b"].error == "OSError: no"


def results(spark, *rows):
    names = [c.split()[0] for c in model.RESULTS.split(", ")]
    full = [{"status": "OK", "doc_type": "brief", "classification_confidence": 0.9, "extraction_method": "converter", "citations_count": 5, "coverage_pct": 90.0, "chunks_count": 2, "elapsed_seconds": 2.0, "had_json": True, "citation_degraded": False} | r for r in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], model.RESULTS).withColumn("source_path", F.col("file"))


def test_reports_tell_what_is_wrong(spark):
    rows = [{"file": "ok"}, {"file": "zero", "citations_count": 0, "coverage_pct": 0.0}, {"file": "low", "coverage_pct": 40.0, "chunks_count": 0}, {"file": "deg", "citation_degraded": True, "had_json": False, "classification_confidence": 0.1}, {"file": "bad", "status": "FAILED", "error": "boom"}, {"file": "skip", "status": "SKIPPED"}]
    df = results(spark, *rows)
    warned = sorted((r.file, r.warning) for r in report.warnings(df.filter("status = 'OK'"), "file").collect())
    assert warned == [("deg", "citation_degraded"), ("deg", "low_confidence"), ("deg", "no_json"), ("low", "low_coverage"), ("low", "zero_chunks"), ("zero", "zero_citations")]
    told = report.lines(df, 65, spark.createDataFrame([("c.pdf",)], "file string")).collect()
    by = {}
    for r in told:
        by.setdefault(r.title, []).append(r.line)
    assert by["SUMMARY"][0] == "Documents:  6 total | 4 OK | 1 failed | 1 skipped | 1 condensed" and by["SUMMARY"][-1] == "Time:       1m 05s (2.0s avg/doc)"
    assert by["ERRORS"] == ["FAIL  bad: boom"] and len(by["WARNINGS"]) == 6 and by["INFO"] == ["Skipped: 1", "Condensed transcript, not supported: c.pdf"]
    assert by["CLASSIFICATION DISTRIBUTION"] == ["brief".ljust(24) + "    4  (100.0%)"]
    assert [r.file for r in state.failed_documents(df).collect()] == ["bad"]
    assert {r.title for r in report.lines(results(spark)).collect()} == {"SUMMARY"}


def test_benchmark_figures(spark):
    hits = spark.createDataFrame([("q1", "bm25", 1, "a_1"), ("q1", "bm25", 2, "b_1"), ("q1", "rerank", 1, "a_1"), ("q1", "rerank", 2, "a_2"), ("q2", "bm25", 1, "c_1")], "query string, mode string, rank int, chunk_id string")
    queries = spark.createDataFrame([("q1", ["a_"]), ("q2", ["z", "y"])], "query string, prefixes array<string>")
    seen = report.evaluate(hits, queries, 2)
    assert {(r["query"], r["mode"]): (r.precision, r.hit) for r in seen.collect()} == {("q1", "bm25"): (0.5, True), ("q1", "rerank"): (1.0, True), ("q2", "bm25"): (0.0, False), ("q2", "rerank"): (0.0, False)}
    times = spark.createDataFrame([(f"q{i}", "bm25", float(i)) for i in range(20)], "query string, mode string, latency_ms double")
    got = {r["mode"]: r for r in report.mode_summary(seen, times).collect()}
    assert (got["bm25"].mean_precision, got["bm25"].hit_rate, got["bm25"].p50_latency_ms, got["bm25"].p95_latency_ms, got["bm25"].max_latency_ms) == (0.25, 0.5, 10.0, 19.0, 19.0)
    assert {r["query"]: r.delta for r in report.mode_deltas(seen, "bm25", "rerank").collect()} == {"q1": 0.5, "q2": 0.0}


def converter():
    """A converter for tests: lines of text as elements, one under another. Made here, so that workers need not import this file."""

    def convert(name, raw):
        if b"broken" in raw:
            raise ValueError("cannot read")
        lines = raw.decode().split("\n")
        elements = [{"self_ref": f"#/texts/{i}", "label": "text", "text": x, "page_no": 1 + i // 3, "l": 80.0, "r": 500.0, "t": 700.0 - 20 * i, "b": 690.0 - 20 * i} for i, x in enumerate(lines)]
        return json.dumps({"md": "\n".join(lines), "elements": elements, "pages": [{"page_no": 1, "width": 612.0, "height": 792.0, "text": raw.decode()}]})

    return convert


PAGE = " " * 32


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("in")
    (root / "sub").mkdir()
    (root / "Expert Report.pdf").write_text("EXPERT REPORT on METHODOLOGY\n1. The first opinion is about red wheels.\nmore of it\n2. The second one is about blue doors.\nend of the text")
    (root / "sub" / "Deposition of Bob.txt").write_text(f"{PAGE}5\n 1   Q.  Did the red wheel turn?\n 2   A.  It did turn at noon.\n")
    (root / "bad.pdf").write_text("broken")
    (root / "copy.pdf").write_text((root / "Expert Report.pdf").read_text())
    made = app.Corpus(spark, str(tmp_path_factory.mktemp("out") / "corpus"))
    made.root = str(root)
    made.first = {r.file: r for r in made.process(made.root, converter()).collect()}
    return made


def test_files_are_processed(spark, corpus):
    got = corpus.first
    assert {f: r.status for f, r in got.items()} == {"Expert Report.pdf": "OK", "Deposition of Bob.txt": "OK", "bad.pdf": "FAILED", "copy.pdf": "SKIPPED"} and "cannot read" in got["bad.pdf"].error
    assert got["Deposition of Bob.txt"].doc_type == "deposition" and got["Deposition of Bob.txt"].citations_count == 2 and got["Deposition of Bob.txt"].coverage_pct == 100.0
    chunks = {r.stem: r for r in corpus.table("chunks").collect()}
    assert chunks["deposition_of_bob"].citation_string == "Deposition Of Bob Dep. 5:1-2" and chunks["expert_report"].citation_string == "Expert Report ¶¶1-2"
    assert chunks["expert_report"].citation.pdf_pages == [1, 2] and "[PAGE:2]" in chunks["expert_report"].core_text
    held = {r.stem: (r.status, r.retry_count) for r in corpus.table("state").collect()}
    assert held == {"expert_report": ("completed", 0), "deposition_of_bob": ("completed", 0), "bad": ("failed", 1)}


def test_corpus_is_searched_enriched_and_shrunk(spark, corpus):
    assert corpus.index()["keyword"] == "built" and corpus.index() == {"keyword": "unchanged"}
    hits = corpus.search("red wheel turn", mode="bm25").collect()
    assert hits[0].stem == "deposition_of_bob" and hits[0].hit_page == 5
    by, totals = corpus.stats()
    assert totals["num_documents"] == 2 and by.count() == 2
    counts = corpus.enrich(lambda prompt: ANSWERS["clean"], "test")
    assert counts["enriched"] == 2 and corpus.enrich(lambda prompt: ANSWERS["clean"], "test")["skipped"] == 2
    assert {r.category for r in corpus.table("chunks").collect()} == {"procedural"}
    again = {r.file: r.status for r in corpus.process(corpus.root, converter()).collect()}
    assert again == {"Expert Report.pdf": "SKIPPED", "Deposition of Bob.txt": "SKIPPED", "bad.pdf": "FAILED", "copy.pdf": "SKIPPED"}
    assert corpus.table("chunks").count() == 2 and {r.stem: r.retry_count for r in corpus.table("state").collect()}["bad"] == 2
    out = corpus.path + "-json"
    corpus.export(out)
    exported = {r.stem: json.loads(r.value) for r in spark.read.text(f"{out}/citations").collect()}
    first = next(iter(exported["deposition_of_bob"].items()))
    assert first[0] == "line_P5_L1" and first[1]["bates"] is None and first[1]["transcript_page"] == 5 and "discovery_request_kind" not in first[1] and list(exported["expert_report"]) == [f"#/texts/{i}" for i in range(5)]
    chunk = [json.loads(r.value) for r in spark.read.text(f"{out}/chunks").collect() if "Bob" in r.value][0]
    assert chunk["chunk_id"] == "deposition_of_bob_chunk_0000" and "column_lines" not in chunk["citation"]
    assert [json.loads(r.value)["file"] for r in spark.read.text(f"{out}/failed_documents").collect()] == ["bad.pdf"]
    learned = corpus.learn(spark.createDataFrame([("bad", "brief")], "stem string, doc_type string"))
    assert learned.filter("doc_type = 'brief'").count() == len(classify.LAYOUT_FEATURES) + len(classify.TEXT_FEATURES)
    gone = corpus.remove("Deposition of Bob")
    assert gone["chunks"] == 1 and gone["documents"] == 1 and gone["citations"] == 2 and gone["index"] == 1
    assert corpus.search("red wheel turn", mode="bm25").filter("stem = 'deposition_of_bob'").count() == 0


def test_load_files_are_ingested(spark, tmp_path):
    from test_sources import delivery

    root = delivery(tmp_path)
    corpus = app.Corpus(spark, str(tmp_path / "corpus"))
    (row,) = corpus.ingest(str(root), natives={}).collect()
    assert (row.total_records, row.text_route, row.single, row.vendor_ff, row.unpaged_no_ocr, row.pagination_flagged, row.skipped_no_content) == (4, 3, 1, 1, 1, 1, 1)
    cited = {(r.stem, r.page): r.bates for r in corpus.table("citations").collect()}
    assert cited["ab0001", 2] == "AB0002" and cited["ab0004", 1] == "AB0004" and ("ab0004", 2) not in cited
    chunk = {r.stem: r for r in corpus.table("chunks").collect()}["ab0001"]
    assert "[PAGE:2 | AB0002]" in chunk.core_text and chunk.citation_string == "Ab0001 at AB0001-AB0002" and "**Custodian:** Smith\n**From:** me" in chunk.core_text
    assert corpus.table("flagged_content").first().bates == "AB0007" and corpus.table("flagged_pages").first().bates_range == ["AB0004", "AB0006"]
    assert {r.bates: (r.route, r.pagination) for r in corpus.table("manifest").collect()}["AB0003"] == ("text", "single")
    with pytest.raises(FileNotFoundError):
        corpus.ingest(str(tmp_path / "corpus" / "stats"))


def test_pages_are_recognised_and_aligned(spark, tmp_path):
    from test_sources import delivery

    root = delivery(tmp_path)
    pages = [" ".join(f"word{p}x{i}" for i in range(40)) for p in range(3)]
    (root / "PROD1" / "TEXT" / "AB0004.txt").write_text("\n".join(pages))
    (root / "PROD1" / "I").mkdir()
    for i, page in enumerate(pages, 4):
        (root / "PROD1" / "I" / f"{i}.tif").write_text(page)
    with open(root / "load files" / "PROD1.opt", "a", encoding="utf-8") as file:
        file.write("AB0004,V,I\\4.tif,Y,,,3\nAB0005,V,I\\5.tif,,,,\nAB0006,V,I\\6.tif,,,,\n")
    corpus = app.Corpus(spark, str(tmp_path / "corpus"))
    corpus.ingest(str(root), recognise=lambda path, raw: raw.decode())
    cited = {(r.stem, r.page): r.bates for r in corpus.table("citations").collect()}
    assert [cited["ab0004", p] for p in (1, 2, 3)] == ["AB0004", "AB0005", "AB0006"]
    assert {r.bates: r.pagination for r in corpus.table("manifest").collect()}["AB0004"] == "aligned"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    root = tmp_path / "in"
    root.mkdir()
    (root / "Deposition of Ann.txt").write_text(f"{PAGE}5\n 1   Q.  Was it a green gate?\n 2   A.  It was.\n")
    monkeypatch.setattr(cli.SparkSession.builder.__class__, "getOrCreate", lambda self: spark, raising=False)
    level = spark.sparkContext.setLogLevel
    run = lambda *a: cli.run(cli.parser().parse_args([str(x) for x in a]), spark)
    out = tmp_path / "corpus"
    assert run("process", root, out) == 0 and "1 OK" in capsys.readouterr().out
    assert run("search", out, "green gate", "--mode", "bm25") == 0
    hit = json.loads(capsys.readouterr().out.splitlines()[-1])
    assert hit["citation_string"] == "Deposition Of Ann Dep. 5:1-2"
    assert run("stats", out) == 0 and run("index", out) == 0 and "unchanged" in capsys.readouterr().out
    assert run("classify", root) == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["doc_type"] == "deposition"
    assert run("remove", out, "Deposition of Ann") == 0 and json.loads(capsys.readouterr().out.splitlines()[-1])["chunks"] == 1
    settings = tmp_path / "s.json"
    settings.write_text('{"search": {"top_k": 2}}')
    for args in (["--config", str(settings), "search", "c", "q"], ["search", "--config", str(settings), "c", "q"]):
        assert cli.parser().parse_args(args).config == str(settings)
    assert cli.function("json:dumps") is json.dumps and cli.function(None) is None
    with pytest.raises(FileNotFoundError):
        run("process", tmp_path / "none" , out)
    assert level and tables.exists(spark, f"{out}/chunks")

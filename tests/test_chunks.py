import random

import pytest
from pyspark.sql import functions as F

from docketry import model
from docketry.operators import chunks, cite

DOCS = "doc_id long, stem string, md string, doc_type string, file_name string, source_path string"


def cited(spark, rows):
    """Citations from dicts; the order of the list is theirs."""
    names = [c.split()[0] for c in model.CITATIONS.split(", ")]
    return spark.createDataFrame([tuple(({"doc_id": 1, "ord": i, "type": "page_only"} | r).get(n) for n in names) for i, r in enumerate(rows)], model.CITATIONS)


def run(spark, md, citations, doc_type="unknown", stem="my_doc_x3rd", file_name=None, **budget):
    docs = spark.createDataFrame([(1, stem, md, doc_type, file_name, "in/a.pdf")], DOCS)
    return chunks.chunk(docs, cited(spark, citations), **budget).orderBy("chunk_idx").collect()


def test_gap_pages_are_marked_and_kept_apart(spark):
    md = "# Title\n[TEXT:1]\nfirst line\nmore of it\n[TEXT:2]\nsecond text"
    (c,) = run(spark, md, [{"ref": "#/texts/1", "page": 1}, {"ref": "#/texts/2", "page": 6}])
    assert c.core_text == "# Title\n[PAGE:1]\nfirst line\nmore of it\n[PAGE:6]\nsecond text"
    assert c.citation.page_map == [None, 1, 1, 1, 6, 6] and len(c.citation.page_map) == len(c.core_text.split("\n"))
    assert [tuple(s) for s in c.citation.page_spans] == [(1, 2, 4), (6, 5, 6)]
    assert c.citation_string == "My Doc X3Rd, pp. 1, 6" and c.pages == [1, 6] and c.chunk_id == "my_doc_x3rd_chunk_0000"
    assert (c.tokens, c.doc_type, c.key_quotes, c.citation.bates_map, c.source_path) == (len(c.core_text) // 4, "unknown", [], None, "in/a.pdf")


def test_no_citations_no_chunks(spark):
    assert run(spark, "text", []) == []
    assert run(spark, None, [{"ref": "#/texts/1", "page": 1}]) == [] and run(spark, "", [{"ref": "#/texts/1", "page": 1}]) == []


def test_stamps_come_from_the_file_name(spark):
    md = "[TEXT:1]\na\n[TEXT:2]\nb"
    both = [{"ref": "#/texts/1", "page": 1}, {"ref": "#/texts/2", "page": 2}]
    (c,) = run(spark, md, both, file_name="in/Abbott0000009-0000010 some thing.pdf")
    assert c.core_text == "[PAGE:1 | ABBOTT0000009]\na\n[PAGE:2 | ABBOTT0000010]\nb" and c.citation_string == "My Doc X3Rd at ABBOTT0000009-ABBOTT0000010"
    assert c.citation.bates_map == ["ABBOTT0000009"] * 2 + ["ABBOTT0000010"] * 2
    assert run(spark, md, both, file_name="ABBOTT0000009-0000019.pdf")[0].citation.bates_map is None
    (c,) = run(spark, md, [both[0] | {"bates": "X1"}, both[1]], file_name="ABBOTT0000009-0000010.pdf")
    assert c.citation.bates_map == ["X1"] * 4 and c.citation.bates_range == ["X1"]


@pytest.mark.parametrize("name,fits", [("AB00001-00002", True), ("ab 00001_ab-00002_x", True), ("AB00001–00002", True), ("A00001-00002", False), ("AB00001-000020000011", False), ("AB0001-0002", False)])
def test_stamp_ranges(spark, name, fits):
    c = cited(spark, [{"ref": "#/texts/1", "page": 2}])
    got = chunks.derive_stamps(c, spark.createDataFrame([(1, name)], "doc_id long, file_name string")).first()
    assert got.bates == ("AB00002" if fits else None)


def slow_generic(lines, target):
    out, held, fresh = [], [], 0
    for i, line in enumerate(lines):
        held.append(i)
        if len("\n".join(lines[j] for j in held)) // 4 >= target:
            out.append((held[0], i + 1))
            held = held[-5:] if len(held) > 5 else []
    return [*out, (held[0], len(lines))] if held else out


def slow_paragraph(lines, opens, target, most):
    out, held = [], []
    for i, line in enumerate(lines):
        tokens = len("\n".join(lines[j] for j in held)) // 4
        if line.strip() and held and (opens[i] and tokens >= target or tokens >= most):
            out.append((held[0], i))
            held = []
        held.append(i)
    return [*out, (held[0], len(lines))] if held else out


@pytest.mark.parametrize("seed", range(30))
def test_budgets_against_joined_texts(seed):
    rng = random.Random(seed)
    lines = ["x" * rng.choice([0, 0, 3, 12, 40, 200]) for _ in range(rng.randrange(80))]
    opens = [bool(x) and rng.random() < 0.3 for x in lines]
    kinds = [chunks.OPENS * o | chunks.BLANK * (not x.strip()) for x, o in zip(lines, opens, strict=True)]
    n = [len(x) for x in lines]
    assert chunks.generic_cuts(n, 20) == slow_generic(lines, 20)
    assert chunks.paragraph_cuts(n, kinds, 20, 30) == slow_paragraph(lines, opens, 20, 30)
    cut = chunks.request_cuts(n, kinds, 20, 30, 5)
    assert {i for a, b, *_ in cut for i in range(a, b)} >= {i for i, k in enumerate(kinds) if not k & chunks.BLANK}
    for a, b, again, head, part, total in cut:
        assert a < b and (part is None or total >= part and again == (part > 1 and head >= 0))


def test_paragraphs(spark):
    md = "[TEXT:1]\n¶ 1 " + "a" * 60 + "\nmore\n[TEXT:2]\n2. The " + "b" * 70 + "\n[TEXT:3]\n3. End"
    got = run(spark, md, [{"ref": f"#/texts/{i}", "page": 1, "paragraph_number": i, "type": "paragraph"} for i in (1, 2, 3)], "declaration", target=15, most=40)
    assert [c.citation_string for c in got] == ["My Doc X3Rd ¶1", "My Doc X3Rd ¶2", "My Doc X3Rd ¶3"] and {c.doc_type for c in got} == {"expert_report"}
    (c,) = run(spark, md, [{"ref": f"#/texts/{i}", "page": 1, "paragraph_number": i, "type": "paragraph"} for i in (1, 2, 3)], "brief")
    assert c.citation_string == "My Doc X3Rd ¶¶1-3" and c.citation.paragraph_numbers == [1, 2, 3]


def test_requests_with_their_responses(spark):
    body = "\n".join(f"word {i} of the answer" for i in range(40))
    md = f"[TEXT:1]\nGENERAL OBJECTIONS\n[TEXT:2]\n## INTERROGATORY NO. 5\nState all.\nRESPONSE TO INTERROGATORY NO. 5\n{body}\n[TEXT:3]\n**REQUEST FOR PRODUCTION NO. 2\nshort"
    got = run(spark, md, [{"ref": f"#/texts/{i}", "page": i} for i in (1, 2, 3)], "discovery_response", target=100, most=150, overlap=10)
    assert [c.citation_string for c in got] == ["My Doc X3Rd (preamble), p. 1", *[f"My Doc X3Rd ROG No. 5 (Pt. {i}/3)" for i in (1, 2, 3)], "My Doc X3Rd RFP No. 2"]
    assert got[2].core_text.startswith("## INTERROGATORY NO. 5  (cont’d)\n[PAGE:2]\nword ") and got[2].citation.page_map[0] is None
    last = got[1].core_text.split("\n")[-2:]
    assert got[2].core_text.split("\n")[2:4] == last and (got[2].citation.discovery_part, got[2].citation.discovery_part_total) == (2, 3)
    assert [c.citation.discovery_request_kind for c in got] == [None, "rog", "rog", "rog", "rfp"] and {c.doc_type for c in got} == {"discovery_response"}


TESTIMONY = "[PAGE:7]\n 1  Q  Where were you?\n 2  A  At home all day.\nand there.\n[PAGE:8]\n 1  Q.  And then?\n 2  A  I left.\n 3  Q  When?\n 4  A  At five."


def test_testimony(spark):
    places = [{"ref": f"line_P{p}_L{n}", "page": p, "line_start": n, "line_end": n, "transcript_page": p, "type": "transcript_line", "bates": f"B{p}"} for p, n in ((7, 1), (7, 2), (8, 1), (8, 2), (8, 3), (8, 4))]
    (c,) = run(spark, TESTIMONY, places, "deposition")
    assert "[PAGE:" not in c.core_text and c.citation.page_map == [7, 7, 7, 8, 8, 8, 8] and c.citation.bates_map[2] == "B7"
    assert c.citation_string == "My Doc X3Rd Dep. 7:1-2, 8:1-4" and c.citation.transcript_lines == {"7": [1, 2], "8": [1, 4]} and c.citation.transcript_pages == [7, 8]
    got = run(spark, TESTIMONY, places, "hearing_transcript", target=14)
    assert len(got) > 1 and all(c.core_text.split("\n")[-1].split()[1] == "A" for c in got[:-1]) and {c.doc_type for c in got} == {"deposition"}
    assert got[1].core_text.split("\n")[:3] == got[0].core_text.split("\n")[-3:]


def test_testimony_of_a_converter(spark):
    """References of elements; a table whose line numbers are those of the citation; a citation found by transcript page."""
    md = "[PAGE:3]\n[TEXT:42]\n| Q. Your name?  | 09:30:50 |\n|---|---|\n| some note | 09:30:51 |\n 5  A  Bob."
    places = [{"ref": "#/texts/42", "page": 2, "line_start": 4, "transcript_page": 3, "type": "transcript_line"}, {"ref": "#/texts/50", "page": 2, "line_start": 5, "transcript_page": 3, "type": "transcript_line", "bates": "Z9"}]
    (c,) = run(spark, md.replace("[TEXT:42]\n| Q", "[TEXT:42]\n| Q"), places, "unknown")
    assert c.core_text == "4 Q Your name?\nsome note\n 5  A  Bob." and c.doc_type == "deposition"
    md = "[PAGE:3]\n 5  A  Bob."
    (c,) = run(spark, md, places[1:], "deposition")
    assert c.citation.bates_range == ["Z9"] and c.pages == [2] and c.citation.transcript_lines == {"2": [5, 5]}


def test_title_is_by_letters(spark):
    names = ["o'neil_x-ray_3rd", "a__b", "été_1"]
    got = spark.createDataFrame([(n,) for n in names], "s string").select(chunks.title(F.col("s"))).collect()
    assert [r[0] for r in got] == [n.replace("_", " ").title() for n in names]


# Citations from layout


def elements(spark, rows):
    names = [c.split()[0] for c in model.ELEMENTS.split(", ")]
    full = [{"doc_id": 1, "ord": i, "self_ref": f"#/texts/{i}", "label": "text", "text": "words of some length", "page_no": 1, "l": 100.0, "r": 300.0} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], model.ELEMENTS)


def rebuild(spark, rows, doc_type, sizes=(), sidecar=None):
    types = spark.createDataFrame([(1, doc_type)], "doc_id long, doc_type string")
    found = cite.reconstruct(elements(spark, rows), types, spark.createDataFrame(list(sizes), model.PAGE_SIZES), sidecar)
    return found.orderBy("ord").collect()


def test_transcript_lines_pages_and_stamps(spark):
    boxes = [{"t": 655.0 - 22.7 * i, "b": 655.0 - 22.7 * (i + 1)} for i in range(10)]
    rows = [{"text": "Page 7", "l": 500.0, "t": 760.0, "b": 750.0}, {"text": "CONFIDENTIAL matter", "t": 700.0, "b": 690.0}, {"label": "section_header", "t": 700.0, "b": 690.0}]
    rows += [*boxes, {"text": "Page 18", "l": 90.0, "t": 500.0, "b": 490.0}, {"text": "Page 8", "l": 500.0, "t": 760.0, "b": 750.0, "page_no": 2}]
    rows += [{"label": "code", "text": "3 DANIEL A 7 Do you 40 not", "page_no": 2, "t": 600.0, "b": 100.0}, {"text": " ", "t": 9.0, "b": 1.0}, {"t": 300.0, "b": 299.0}, {"label": "page_footer", "text": "x ABBOTT0000123", "t": 20.0, "b": 10.0, "page_no": 2}]
    got = rebuild(spark, rows, "deposition")
    assert [r.transcript_page for r in got] == [7] * 11 + [8] * 2 and got[0].line_start == 1 and all(1 <= r.line_start <= r.line_end <= 25 for r in got)
    code = got[11]
    assert (code.line_start, code.line_end, code.page, code.bates, code.type) == (3, 7, 2, "ABBOTT0000123", "transcript_line")
    named = spark.createDataFrame([(1, 2, "S1")], model.STAMPS)
    assert rebuild(spark, rows, "deposition", sidecar=named)[11].bates == "S1"


@pytest.mark.parametrize("left,right,column", [(60.0, 250.0, 1), (265.0, 500.0, 2), (50.0, 500.0, None), (270.0, 300.0, 2)])
def test_patent_columns(spark, left, right, column):
    filler = [{"l": 60.0, "r": 250.0, "t": 700.0 - 9 * i, "b": 692.0 - 9 * i, "text": "w" * 60, "page_no": 4} for i in range(6)]
    got = rebuild(spark, [*filler, {"l": left, "r": right, "t": 500.0, "b": 490.0, "text": "w" * 60, "page_no": 4}, {"text": "FIG", "t": 50.0, "b": 40.0, "page_no": 1}], "patent", [(1, 1, 612.0, 792.0)])
    assert got[6].column == column and got[6].type == ("patent_column" if column else "cross_column_merge") and got[7].type == "patent_figure"


def test_paragraph_numbers(spark):
    texts = ["intro", "1. The first", "follows", "2. The next", "see ¶ 42 there", "3. Too low", "50. lower", "50. Up", "Paragraph 15", "9. no", "201. Too High", "16. Yes", "x"]
    got = rebuild(spark, [{"text": t, "t": 9.0, "b": 1.0} for t in texts], "pleading")
    assert [r.paragraph_number for r in got] == [None, 1, 1, 2, 42, 42, 42, 50, 15, 15, 15, 16, 16]
    assert [r.type for r in got][:2] == ["page_only", "paragraph"]


def slow_paragraphs(texts):
    import re

    now, out = None, []
    for t in texts:
        n = None
        for p in (r"(?:^|\s)[¶§]\s*(\d+)", r"(?:^|\s)[Pp]aragraph\s+(\d+)"):
            m = re.search(p, t)
            if m and n is None:
                n = int(m[1])
        m = re.match(r"(\d+)\.\s+[A-Z]", t)
        if n is None and m and (now is None or 1 <= int(m[1]) <= 200 and int(m[1]) >= now):
            n = int(m[1])
        now = now if n is None else n
        out.append(now)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_paragraph_numbers_against_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    texts = [rng.choice(["plain", f"{rng.randrange(300)}. Text", f"x ¶ {rng.randrange(60)}", f"Paragraph {rng.randrange(60)}", "0. Zero"]) for _ in range(80)]
    texts = [t if rng.random() < 0.8 else "words" for t in texts]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, ord long, text string")
    assert [r.paragraph for r in cite.paragraph_numbers(rows).orderBy("ord").collect()] == slow_paragraphs(texts)


def test_requests_carry_on(spark):
    texts = ["General", "INTERROGATORY NO. 3: State", "It is", "## RESPONSE TO REQUEST FOR ADMISSION NO. 4", "Denied"]
    got = rebuild(spark, [{"text": t, "t": 9.0, "b": 1.0} for t in texts], "discovery_request")
    assert [(r.discovery_request_kind, r.discovery_request_number) for r in got] == [(None, None), ("rog", 3), ("rog", 3), ("rfa", 4), ("rfa", 4)]


def test_validation(spark):
    rows = [{"ref": "a", "page": 1, "line_start": 1, "transcript_page": 5, "bates": "AB00001", "type": "transcript_line"}, {"ref": "b", "page": 1, "line_start": 9, "transcript_page": 5, "bates": "AB00002", "type": "transcript_line"}]
    rows += [{"ref": "c", "page": 2, "bates": "AB00002"}, {"ref": "d", "page": 3, "bates": "AB00018"}]
    m = cite.validate(cited(spark, rows)).first()
    assert (m.total_items, m.coverage_pct, m.has_line_numbers, m.has_column_numbers, m.has_bates) == (4, 50.0, True, False, True)
    assert m.type_distribution == {"page_only": 2, "transcript_line": 2} and m.line_gaps == ["Page 5: gap 1->9"]
    assert m.bates_gaps == ["Pages 2-3: Bates 2->18 (gap: 15)"] and m.bates_duplicates == ["Page 1: multiple Bates stamps"]

import random
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from docketry import config
from docketry.operators import postprocess
from docketry.sources import files, loadfile, transcripts

PAGE = " " * 32
TRANSCRIPT = f"front matter\n{PAGE}41\n 1   Q.  Did you review it?\n 2   A.  I did.\n 3       THE WITNESS: Yes.\n26   too far\nno number\n{PAGE}42\n 1   Q  And then?\n12   \n 2   A.  Later.\n"


def texts(spark, *contents):
    return spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "doc_id long, content string")


@pytest.mark.parametrize("content,yes", [(TRANSCRIPT, True), ("Plain prose.\nMore of it.", False), (" 1   Q.  No pages\n 2   A.  Right", False), (f"{PAGE}7\nno lines", False), ("", False), (None, False), ("x\n" * 90 + TRANSCRIPT, False), (TRANSCRIPT.replace("\n", "\r\n"), True)])
def test_transcripts_are_told_by_their_heads(spark, content, yes):
    assert transcripts.is_transcript(texts(spark, content)).first().is_transcript is yes


def test_plain_transcripts(spark):
    md, cited = transcripts.from_text(texts(spark, TRANSCRIPT, None, "no pages"))
    (row,) = md.collect()
    assert row.md == "\n[PAGE:41]\n 1  Q  Did you review it?\n 2  A  I did.\n 3  THE WITNESS: Yes.\n\n[PAGE:42]\n 1  Q  And then?\n 2  A  Later."
    got = cited.orderBy("ord").collect()
    assert [r.ref for r in got] == ["line_P41_L1", "line_P41_L2", "line_P41_L3", "line_P42_L1", "line_P42_L2"]
    assert all(r.page == r.transcript_page and r.line_start == r.line_end and r.type == "transcript_line" for r in got)


def test_transcripts_of_spans(spark):
    one = [("Page 7", 450, 80, 500, 90), ("CONFIDENTIAL", 200, 40, 300, 50), (" 1 ", 60, 100, 70, 110), ("Q", 120, 101, 130, 111), ("Why   not?", 150, 102, 300, 112), ("2", 60, 130, 70, 140), ("A", 120, 133, 130, 143), ("far", 120, 134, 200, 145), ("phone", 100, 735, 200, 745), ("note", 120, 160, 200, 170)]
    two = [("Conducted on May 19, 2025 10", 100, 60, 400, 70), ("30", 60, 100, 70, 110), ("x", 120, 100, 130, 110)]
    rows = [(1, p, i, *s) for p, page in ((1, one), (2, two)) for i, s in enumerate(page)]
    spans = spark.createDataFrame([(d, p, i, t, *map(float, b)) for d, p, i, t, *b in rows], "doc_id long, page_no int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "doc_id long, page_no int")
    md, cited = transcripts.from_spans(spans, pages)
    assert md.first().md == "\n[PAGE:7]\n 1  Q Why  not?\n 2  A\nfar\nnote\n\n[PAGE:10]\n30 x\n\n[PAGE:3]"
    assert [(r.ref, r.page, r.transcript_page) for r in cited.orderBy("ord").collect()] == [("line_P7_L1", 1, 7), ("line_P7_L2", 1, 7)]


def cells(*values):
    q = loadfile.QUALIFIER
    return loadfile.FIELD.join(q + v + q for v in values)


def delivery(tmp_path):
    """Three documents: two pages with a form feed, one page, three pages without breaks or images."""
    root = tmp_path / "delivery"
    (root / "PROD1" / "TEXT").mkdir(parents=True)
    (root / "load files").mkdir()
    body = "\n".join([cells("BegDoc", "EndDoc", "PgCount", "TextLink", "FileName", "Custodian", "DateTimeSent", "From"), cells("AB0001", "AB0002", "2", "PROD1\\TEXT\\AB0001.txt", "a.doc", "Smith", "", "me"), cells("AB0003", "AB0003", "1", ".\\TEXT\\AB0003.txt", "", "", "2020", ""), cells("AB0004", "AB0006", "3", "TEXT\\AB0004.txt", "c.pdf"), "", cells("AB0007", "AB0007", "x", "TEXT\\none.txt", "v.mp4")])
    (root / "load files" / "PROD1.dat").write_text("﻿" + body, encoding="utf-8")
    (root / "PROD1" / "PROD1.dat").write_text("broken", encoding="utf-8")
    (root / "load files" / "PROD1.opt").write_text("AB0001,V,I\\1.tif,Y,,,2\nAB0002,V,I\\2.tif,,,,\nAB0003,V,I\\3.tif,Y,,,1\nshort,row\n", encoding="utf-8")
    (root / "PROD1" / "TEXT" / "AB0001.txt").write_text("First page of it\n\nsecond paragraph\f\nThe other page\f", encoding="utf-8")
    (root / "PROD1" / "TEXT" / "AB0003.txt").write_text("A single page of text here", encoding="utf-8")
    (root / "PROD1" / "TEXT" / "AB0004.txt").write_text("Three pages of text without a break between them", encoding="utf-8")
    return root


def test_productions_are_found_once(spark, tmp_path):
    root = delivery(tmp_path)
    listed = spark.createDataFrame([(str(p),) for p in root.rglob("*") if p.is_file()], "path string")
    (row,) = loadfile.productions(listed, str(root)).collect()
    assert (row.dat, row.name, row.folder) == (f"{root}/load files/PROD1.dat", "PROD1", f"{root}/PROD1")
    assert loadfile.named_dat(listed, f"{root}/PROD1").first().path == f"{root}/PROD1/PROD1.dat"


def test_headers_of_other_vendors(spark):
    rows = [("p", 0, cells("PRODBEG", "ProdEnd", "Source ID (Box #)", "CUSTODIAN")), ("p", 1, cells("A1", "A2", "V1", "Sþmith")), ("p", 2, " "), ("p", 3, cells("A3"))]
    got = loadfile.parse_records(spark.createDataFrame(rows, "production string, line_no long, line string")).orderBy("line_no").collect()
    assert [(r.beg_bates, r.end_bates, r.prod_vol, r.custodian) for r in got] == [("A1", "A2", "V1", "Sþmith"), ("A3", "", "", "")]
    lines = loadfile.rows_of(spark.createDataFrame([("p", "﻿a\r\nb\x0bc\n")], "production string, content string")).orderBy("line_no").collect()
    assert [r.line for r in lines] == ["a", "b", "c", ""]


def test_pages_of_texts(spark):
    rows = [(1, "a\fb", 1, 0), (2, "a\fb\f \f", 2, 0), (3, "a\fb\fc", 2, 0), (4, "abcdef", 3, 3), (5, "abc", 2, 1), (6, "abc", 2, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, content string, n_pages int, n_images int")
    aligned = spark.createDataFrame([(4, [2, 4], True, "why")], "doc_id long, starts array<int>, flagged boolean, reason string")
    got = {r.doc_id: (r.route, r.text, r.flagged) for r in loadfile.paginate(docs, aligned).collect()}
    assert got == {1: ("single", "a\nb", False), 2: ("vendor-ff", "a\fb", False), 3: ("unpaged-mismatch", "a\nb\nc", True), 4: ("aligned", "ab\fcd\fef", True), 5: ("unpaged-no-ocr", "abc", True), 6: ("unpaged-no-ocr", "abc", True)}
    assert {r.route for r in loadfile.paginate(docs).collect()} == {"single", "vendor-ff", "unpaged-mismatch", "unpaged-no-ocr"}


def test_repeated_begin_stamps_start_anew(spark):
    rows = [(i, b, f"{i}.tif", y) for i, (b, y) in enumerate([("Z", ""), ("A", "Y"), ("B", ""), ("C", "Y"), ("A", "Y")])]
    pages = spark.createDataFrame([("p", *r) for r in rows], "production string, line_no long, bates string, path string, doc_break string")
    got = {r.beg_bates: r.images for r in loadfile.latest_pages(loadfile.group_pages(pages)).collect()}
    assert got == {"A": ["4.tif"], "C": ["3.tif"]}


def test_many_pages_are_counted_in_ranges(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(loadfile, "RANGE_LINES", 7)
    rows = [("p", i, f"B{i}", str(i), "Y" if rng.random() < 0.3 else "") for i in range(200)]
    want, now = {}, None
    for _, _, b, p, y in rows:
        now = b if y else now
        if now:
            want.setdefault(now, []).append(p)
    got = loadfile.group_pages(spark.createDataFrame(rows, "production string, line_no long, bates string, path string, doc_break string"))
    assert {r.beg_bates: r.images for r in got.collect()} == want


def test_relative_paths(spark):
    listed = spark.createDataFrame([("/d/P/x.txt",), ("/d/y.txt",), ("/d/P/P/z.txt",)], "path string")
    records = spark.createDataFrame([(i, p, "/d/P/") for i, p in enumerate([".\\x.txt", "y.txt", "z.txt", "none", "", None])], "doc_id long, rel string, root string")
    got = {r.doc_id: r.file for r in loadfile.resolve(records, "rel", listed, "file").collect()}
    assert got == {0: "/d/P/x.txt", 1: "/d/y.txt", 2: "/d/P/P/z.txt", 3: None, 4: None, 5: None}


def test_mail_and_other_formats(spark):
    message = EmailMessage()
    message["Subject"], message["From"], message["To"] = "Hello", "a@x", "b@x"
    message.set_content("The body.\n")
    message.add_alternative("<p>html</p>", subtype="html")
    message.add_attachment(b"x", maintype="application", subtype="pdf", filename="f.pdf")
    text = files.parse_mail(message.as_bytes())
    assert text.startswith("# Email: Hello\n\n**From:** a@x\n**To:** b@x\n**Date:** Unknown") and "The body." in text and "html" not in text and text.endswith("**Attachments:**\n- f.pdf")
    rows = [("/m.eml", "m.eml", "eml", message.as_bytes()), ("/t.txt", "t.txt", "txt", "é".encode()), ("/b.txt", "b.txt", "txt", b"\xff"), ("/s.xlsx", "s.xlsx", "xlsx", b"1"), ("/o.msg", "o.msg", "msg", b""), ("/q.zip", "q.zip", "zip", b"")]
    df = spark.createDataFrame(rows, "path string, name string, ext string, content binary")
    got = {r.path: r for r in files.convert(df, {"sheets": lambda name, raw: files.sheet_text("s", [("One", [["a", None], [None, None], [1, 2]])])}).collect()}
    assert got["/m.eml"].doc_type == "exhibit" and got["/t.txt"].md == "é" and got["/b.txt"].error.startswith("UnicodeDecodeError")
    assert got["/s.xlsx"].md == "# s\n\n\n## Sheet: One\n\n| a |  |\n| 1 | 2 |" and got["/o.msg"].error and got["/q.zip"].error == "no connector for fallback"
    assert files.slide_text("d", [["x", ""], []]) == "# d\n\n\n## Slide 1\n\nx\n\n## Slide 2\n"


def test_page_images_are_read_once(spark):
    images = spark.createDataFrame([(1, 1, "a", b"A"), (1, 2, "b", b"B"), (1, 3, "c", b"")], "doc_id long, page_no int, path string, content binary")
    known = spark.createDataFrame([("a", "seen")], "path string, text string")
    got = files.recognised(images, known, lambda path, raw: "read " + raw.decode() if raw else 1 / 0)
    assert {r.page_no: r.text for r in got.collect()} == {1: "seen", 2: "read B", 3: ""}


@pytest.mark.parametrize("value,iso", [("D:20240115113045-05'00", "2024-01-15T11:30:45"), ("20240115", "2024-01-15T00:00:00"), ("D:202401151130", "2024-01-15T11:30:00"), ("D:2024", None), ("D:20241315", None), (None, None), ("nonsense", None)])
def test_document_dates(spark, value, iso):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(files.document_date(F.col("v"))).first()[0] == iso
    assert [r[0] for r in spark.createDataFrame([(" a ",), (" ",), (None,)], "v string").select(files.clean_metadata(F.col("v"))).collect()] == ["a", None, None]


def slow_clean(lines):
    import re

    out, over, contents = [], False, False
    for i, line in enumerate(lines):
        if re.match(r"^[A-Z]\s*$", line) and out and i + 10 < len(lines):
            words = []
            for x in lines[i : i + 10]:
                if not re.match("^[A-Za-z]+$", x.strip()):
                    break
                words.append(x.strip().lower())
            if len(words) >= 5 and words == sorted(words):
                over = True
        if re.match(r"^(table\s+of\s+contents|contents)", line, re.I):
            contents = True
            continue
        if re.match(r"^\d{1,2}\s+[QA]\s+|^[¶§]\s*\d+", line) or re.match(r"^CLAIM \d+", line, re.I):
            contents = False
        if over or contents or (not line.strip() and (not out or not out[-1].strip())) or re.match(r"^[_\.\s]{10,}$", line):
            continue
        out.append(re.sub(r"\s{3,}", "  ", line))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_cleaning_against_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    pool = ["words   here", "", " ", "..........", "Table of Contents", "1 Q  said", "¶ 3 more", "claim 4 is", "A", "b", "alpha", "beta", "gamma", "delta", "     " * 3, "x y"]
    docs = []
    for n in range(25):
        rows = [rng.choice(pool) for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.4:
            rows += ["A", "able", "baker", "cab", "dog", "x y", *["tail"] * 8]
        docs.append((n, "\n".join(rows)))
    got = {r.doc_id: r.md for r in postprocess.clean(spark.createDataFrame(docs, "doc_id long, md string")).collect()}
    assert got == {n: "\n".join(slow_clean(md.split("\n"))) for n, md in docs}


def test_marks_of_elements_are_used_up():
    elements = [("4", "The first paragraph of the text, which is long"), ("5", "short"), ("6", "The first paragraph of the text, which is long"), ("7", "| cell of a table that is wide")]
    lines = ["# The first paragraph of the text", "", "The first paragraph of the text, which is long", "a short one", "again: The first paragraph of the text", "short", "x | cell of a table that ends"]
    assert postprocess.mark_elements(lines, elements) == [*lines[:2], "[TEXT:4]", lines[2], "[TEXT:5]", lines[3], "[TEXT:6]", *lines[4:6], "[TEXT:7]", lines[6]]


@pytest.mark.parametrize("seed", range(10))
def test_marks_against_a_scan_of_all_elements(seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "x"]
    make = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))
    elements = [(str(i), make()) for i in range(30)]
    lines = [make() if rng.random() < 0.9 else "" for _ in range(60)]
    used, want = set(), []
    for line in lines:
        flat = line.strip()
        for i, (n, text) in enumerate(elements if flat else []):
            prefix = text[:50].strip()
            if i not in used and (prefix in flat or (len(prefix) > 20 and prefix[:20] in flat)):
                used.add(i)
                want.append(f"[TEXT:{n}]")
                break
        want.append(line)
    assert postprocess.mark_elements(lines, elements) == want


def test_footnotes_move_behind_their_paragraph(spark):
    md = "A claim.\nIts end.\n\n1 See the report at 5.\n2 plain list item\n12 Id. at 7\n\n# Head\nNext text\n3 ABC_001"
    notes = {"1": "See the report at 5.", "12": "Id. at 7", "2": "other", "3": "ABC_001"}
    got = postprocess.inline_footnotes(md.split("\n"), notes)
    assert got == ["A claim.", "Its end.", "[FOOTNOTE 1: See the report at 5.]", "", "2 plain list item", "", "# Head", "[FOOTNOTE 12: Id. at 7]", "Next text", "[FOOTNOTE 3: ABC_001]"]
    rows = [(1, 0, "#/texts/9", "text", "A claim."), (1, 1, None, "footnote", "1 See the report at 5."), (1, 2, None, "footnote", "no number"), (1, 3, None, "text", "Next text")]
    elements = spark.createDataFrame(rows, "doc_id long, ord long, self_ref string, label string, text string")
    docs = spark.createDataFrame([(1, md, "unknown"), (2, "alone", "unknown"), (3, None, "unknown")], "doc_id long, md string, doc_type string")
    marked = {r.doc_id: r.md for r in postprocess.insert_footnotes(postprocess.insert_text_marks(docs, elements), elements).collect()}
    assert marked[1].startswith("[TEXT:9]\nA claim.\nIts end.\n[FOOTNOTE 1: See the report at 5.]\n") and "[TEXT:3]\nNext text" in marked[1] and marked[2] == "alone" and marked[3] is None


def test_citation_marks(spark):
    md = "Page 3 of it\nINTEL_PROX_00012345 here\n 4 Q Why?\n¶ 7 says\nplain"
    docs = spark.createDataFrame([(1, md, "deposition"), (2, "col. 5 and p. 9\ncolumn 6", "patent")], "doc_id long, md string, doc_type string")
    marked, cited = postprocess.mark_citations(docs)
    text = {r.doc_id: r.md for r in marked.collect()}
    assert text[1] == "[PAGE:3]\nPage 3 of it\n[BATES:INTEL_PROX_00012345]\nINTEL_PROX_00012345 here\n[LINE:4]\n4  Q  Why?\n[PARA:7]\n¶ 7 says\nplain"
    assert text[2] == "[PAGE:9]\ncol. 5 and p. 9\n[COLUMN:6]\ncolumn 6"
    assert [(r.ref, r.page, r.line_start, r.paragraph_number, r.bates, r.type) for r in cited.orderBy("ord").collect()] == [("line_2", 3, 4, None, "INTEL_PROX_00012345", "transcript_line"), ("line_3", 3, None, 7, "INTEL_PROX_00012345", "paragraph")]
    found = {r.doc_id: r for r in postprocess.found_citations(docs.select("doc_id", "md")).collect()}
    assert (found[1].doc_type, found[1].pages, found[1].line_markers, found[1].needs_reconstruction) == ("deposition", [3], [4], False)
    assert found[2].doc_type == "patent" and found[2].column_markers == [5, 6]


def test_settings(tmp_path):
    path = tmp_path / "s.json"
    path.write_text('{"search": {"top_k": 3}, "other": {"a": 1}}')
    got = config.settings(str(path), {"search": {"mode": "bm25", "top_k": None}})
    assert got["search"] == {"top_k": 3, "mode": "bm25"} and got["other"] == {"a": 1} and got["chunking"]["target_tokens"] == 800
    (tmp_path / "docketry.json").write_text('{"chunking": {"target_tokens": 9}}')
    assert config.settings(folder=str(tmp_path))["chunking"] == {"target_tokens": 9, "max_tokens": 1200, "overlap_tokens": 100}
    assert config.settings(folder=str(tmp_path / "none")) == config.DEFAULTS
    for name, text in (("a.json", "{"), ("b.json", "[1]"), ("c.txt", "{}")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            config.load(str(tmp_path / name))
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "missing.json"))

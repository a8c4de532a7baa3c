import duckdb
import pytest
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.operators import chunking, chunks, citations, classify, enrich, folds, search, state
from docketry.plans import catalog
from docketry.sources import loadfile

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "customer supplier part orders lineitem events documents embeddings labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def rows_of(frame, columns):
    frame = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(str, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows_of(ours, columns) == rows_of(theirs, columns)


def test_flagship_is_ranked(spark):
    hits = catalog.flagship(spark, SF).toPandas()
    assert list(hits["rank"]) == list(range(1, len(hits) + 1)) and hits["score"].is_monotonic_decreasing and (hits["hit_page"] >= 1).all()


@pytest.mark.parametrize("pages,text", [([1, 6, 8, 9, 10], "pp. 1, 6, 8-10"), ([4], "p. 4"), ([], ""), ([1, None, 2, None, 5], "pp. 1-2, 5"), ([10, 1, 2, 1, 10], "pp. 1-2, 10")])
def test_page_ranges(spark, pages, text):
    assert spark.createDataFrame([(pages,)], "p array<int>").select(T.page_ranges(F.col("p"))).first()[0] == text


@pytest.mark.parametrize("name,stem", [("My File - Copy", "my_file_copy"), ("__a  b__", "a_b"), ("X-Y", "x_y")])
def test_stem(spark, name, stem):
    assert spark.createDataFrame([(name,)], "n string").select(T.normalize_stem(F.col("n"))).first()[0] == stem


@pytest.mark.parametrize("seconds,text", [(0.0, "0.0s"), (5.5, "5.5s"), (59.9, "59.9s"), (60.0, "1m 00s"), (65.0, "1m 05s"), (3599.9, "59m 59s"), (3725.0, "1h 02m"), (360000.0, "100h 00m")])
def test_duration(spark, seconds, text):
    assert spark.createDataFrame([(seconds,)], "s double").select(T.duration(F.col("s"))).first()[0] == text


@pytest.mark.parametrize("edge,line", [(655.0, 1), (87.5, 25), (700.0, 1), (0.0, 25)])
def test_box_lines(spark, edge, line):
    assert spark.range(1).select(T.bbox_line(F.lit(edge), F.lit(655.0), F.lit(87.5), F.lit(25))).first()[0] == line


@pytest.mark.parametrize("pages,spans", [([1, 1, 1], [(1, 1, 3)]), ([1, None, 2], [(1, 1, 1), (2, 3, 3)]), ([1, 1, 6, 6, 1], [(1, 1, 2), (6, 3, 4), (1, 5, 5)]), ([None, 5], [(5, 2, 2)])])
def test_page_spans(spark, pages, spans):
    got = spark.createDataFrame([(pages,)], "p array<int>").select(F.inline(chunks.page_spans(F.col("p")))).collect()
    assert [tuple(r) for r in got] == spans


@pytest.mark.parametrize("pages,text", [([5, 6], ["[PAGE:5]", "a", "[PAGE:6]", "b"]), ([None, None, 3], ["a", "b", "[PAGE:3]", "c"]), ([7, 7, 7], ["[PAGE:7]", "a", "b", "c"]), ([1], ["a", "b"])])
def test_page_marks(spark, pages, text):
    lines_of = [x for x in text if not x.startswith("[")]
    rows = spark.createDataFrame([("generic", lines_of, pages, [None] * len(pages))], "family string, text_lines array<string>, page_map array<int>, bates_map array<string>")
    got = chunks.with_page_marks(rows).first()
    assert got.text_lines == text and (len(got.page_map) == len(text) or len(pages) == 1)


def chunk_loop(text, target, overlap=5):
    done, cur, out = text.split("\n"), [], []
    for i, line in enumerate(done):
        cur.append(i)
        if len("\n".join(done[j] for j in cur)) // 4 >= target:
            out.append((cur[0] + 1, i + 1))
            cur = cur[-overlap:] if len(cur) > overlap else []
    return out + ([(cur[0] + 1, len(done))] if cur else [])


def test_chunks_equal_a_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for target in (40, 800):
        got = {}
        for r in chunking.generic_chunks(docs, target).orderBy("doc_id", "chunk_idx").collect():
            got.setdefault(r.doc_id, []).append((r.line_start, r.line_end))
        assert got == {r.doc_id: chunk_loop(r.text, target) for r in docs.collect()}


def test_fusion_order(spark):
    a = spark.createDataFrame([("1", 1), ("2", 2), ("3", 3)], "id string, rank int")
    b = spark.createDataFrame([("2", 1), ("1", 2), ("4", 3)], "id string, rank int")
    got = search.fuse(a, b, "id").orderBy("rank").collect()
    assert [r.id for r in got[:2]] == ["1", "2"] and got[0].score == round(1 / 61 + 1 / 62, 6) and all(r.score > 0 for r in got)


def test_update_plan_and_changes(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    plan = state.update_plan(ids(1, 2, 3), ids(2, 3, 4), ids(3), "k").collect()
    assert sorted((r.k, r.action) for r in plan) == [(1, "add"), (3, "add"), (3, "delete"), (4, "delete")]
    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, content_hash string")
    old = spark.createDataFrame([(1, "a"), (2, "x")], "k int, content_hash string")
    assert [r.k for r in state.changes(now, old, "k").collect()] == [2]
    assert state.changes(now, now, "k").count() == 0 and state.changes(now, now, "k", force=True).count() == 2


def test_enrichment_is_validated(spark):
    row = ("c", "some exact words here", ["exact words", "not there", " exact words "], "odd", "odd", ["1", "7654321", "7", "9876543"])
    df = spark.createDataFrame([row], "chunk_id string, core_text string, key_quotes array<string>, category string, relevance string, claims array<string>")
    got = enrich.validate(df).first()
    assert (got.key_quotes, got.category, got.relevance, got.claims) == (["exact words"], "unclassified", "medium", [1, 7])


def test_load_file(spark):
    f, q = loadfile.FIELD, loadfile.QUALIFIER
    raw = [("p", 0, f.join(q + x + q for x in ("BegBates", "EndBates", "Pages"))), ("p", 1, f.join(q + x + q for x in ("A001", "A002", "2"))), ("p", 2, ""), ("p", 3, q + "A003" + q)]
    got = loadfile.parse_records(spark.createDataFrame(raw, "production string, line_no int, line string")).orderBy("line_no").collect()
    assert [(r.beg_bates, r.end_bates, r.pages) for r in got] == [("A001", "A002", "2"), ("A003", "", "")]
    pages = [("p", 0, "Z", "z", ""), ("p", 1, "A001", "a", "Y"), ("p", 2, "A002", "b", ""), ("p", 3, "A003", "c", "Y")]
    docs = loadfile.group_pages(spark.createDataFrame(pages, "production string, line_no int, bates string, path string, doc_break string")).orderBy("doc").collect()
    assert [(r.beg_bates, r.images) for r in docs] == [("A001", ["a", "b"]), ("A003", ["c"])]


def test_change_stream(spark, tmp_path):
    from docketry.streaming.changes import watch

    now = spark.createDataFrame([(1, "a"), (2, "b")], "k int, content_hash string")
    now.write.parquet(str(tmp_path / "in"))
    old, seen = spark.createDataFrame([(1, "a")], "k int, content_hash string"), []
    watch(spark, str(tmp_path / "in"), "k int, content_hash string", lambda: old, "k", lambda df, n: seen.extend(r.k for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert seen == [2]


def test_pages_are_aligned_through_noise(spark):
    pages = [" ".join(f"word{p}x{i}" for i in range(61)) for p in range(3)]
    text = "\n".join(pages)
    noisy = [" ".join(w for i, w in enumerate(p.split()) if i % 7 != 3) for p in pages]
    rows = spark.createDataFrame([(1, text, noisy), (2, text, [noisy[0], "@@", noisy[2]]), (3, None, None), (4, "", ["", ""])], "doc_id long, text string, pages array<string>")
    got = {}
    for r in folds.align_pages(rows).orderBy("doc_id", "page").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.has_anchor))
    exact = [0, len(pages[0]) + 1, len(pages[0]) + len(pages[1]) + 2]
    assert got[1] == [(at, True) for at in exact]
    assert [a for _, a in got[2]] == [True, False, True] and [s for s, _ in got[2]] == sorted(s for s, _ in got[2])
    assert 3 not in got and len(got[4]) == 2
    assert folds.rising([3, 1, 2, 2, 1]) == [1, 2, 3]


def test_the_longest_rising_run():
    import random

    def slow(pages):
        best = [1] * len(pages)
        for i in range(len(pages)):
            best[i] = 1 + max((best[j] for j in range(i) if pages[j] <= pages[i]), default=0)
        return max(best, default=0)

    rng = random.Random(1)
    for n in range(200):
        pages = [rng.randrange(1 + n // 8) for _ in range(n % 40)]
        run = folds.rising(pages)
        assert len(run) == slow(pages) and run == sorted(set(run)) and all(pages[a] <= pages[b] for a, b in zip(run, run[1:]))
    assert len(folds.rising(list(range(50_000)))) == 50_000


def test_wide_gaps_are_refined_or_marked(spark):
    common = ["alpha beta gamma", "delta epsilon zeta", "beta gamma alpha", "zeta delta omega"]
    # Boilerplate that repeats has no anchor; the only ones are the first word and the last.
    first, second = "opening\n" + "\n".join(common * 2), "\n".join(["omega sigma sigma tau", "tau rho omega sigma"] * 12) + "\nclosing"
    text = first + "\n" + second
    starts, _, wide = folds.align(text, [first, second])
    assert starts == [len(first) + 1] and wide == [False]
    other = "opening " + "\n".join(["kappa lambda"] * 60) + " closing"
    starts, _, wide = folds.align(other, ["opening", "nothing like the text closing"])
    assert wide == [True] and 0 < starts[0] < len(other)
    rows = spark.createDataFrame([(1, text, [first, second]), (2, other, ["opening", "nothing like the text closing"])], "doc_id long, text string, pages array<string>")
    got = [(r.doc_id, r.page, r.start, r.wide, r.flagged) for r in folds.align_pages(rows).orderBy("doc_id", "page").collect()]
    assert got == [(1, 1, 0, False, False), (1, 2, len(first) + 1, False, False), (2, 1, 0, False, True), (2, 2, starts[0], True, True)]


def test_keywords_are_sought_in_distinct_lines(spark):
    rows = spark.createDataFrame([(1, "a court reporter,\na CCR\na court reporter,\n\nYour\nHonor"), (2, "")], "doc_id long, text string")
    found = classify.content_signal(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct(split(upper(text" in plan
    # no keyword goes over the end of a line, and one counts once however many lines have it
    assert [(r.doc_id, r.doc_type, round(r.score, 6)) for r in found.collect()] == [(1, "deposition", round(2 / 3.6, 6))]


def test_stamps_of_a_task_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(citations, "TASK_ROWS", 10, raising=False)
    rows = spark.range(200, numPartitions=1).selectExpr("id % 50 AS doc_id", "int(id % 2) AS page", "id % 100 AS stamp")
    found = citations.stamp_duplicates(rows, "doc_id")
    assert {(r.doc_id, r.page, r.n_stamps, r.first_stamp) for r in found.collect()} == {(i, i % 2, 2, i) for i in range(50)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and ", 21" in plan  # nothing is summed before it is dealt

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docketry import model
from docketry.operators import index, retrieve, search
from docketry.sources import tables

TEXTS = {
    "alpha_chunk_0000": "The patent claims cover a red wheel of the machine.",
    "alpha_chunk_0001": "A witness saw the red wheel turn,\nand the red wheel stopped at noon.\nNobody else saw it.",
    "beta_chunk_0000": "Payment terms of the license are net thirty days.",
    "beta_chunk_0001": "the of and",
}


@pytest.fixture(scope="module")
def chunks(spark):
    empty = spark.createDataFrame([], model.CHUNKS)
    rows = spark.createDataFrame([(k, k.rsplit("_", 2)[0], t) for k, t in TEXTS.items()], "chunk_id string, stem string, core_text string")
    pages = F.transform(F.split("core_text", "\n"), lambda x, i: (i + 3).cast("int"))
    named = F.named_struct(*[x for f in empty.schema["citation"].dataType for x in (F.lit(f.name), (pages if f.name == "page_map" else F.lit(None).cast(f.dataType)))])
    return empty.unionByName(rows.withColumn("citation", named).withColumn("doc_type", F.lit("unknown")), allowMissingColumns=True)


def embed(text):
    return [float(text.lower().count(w)) for w in ("red", "wheel", "license", "days")]


@pytest.fixture(scope="module")
def built(spark, chunks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    index.build(chunks.select("chunk_id", F.col("core_text").alias("text")), f"{path}/keyword", key="chunk_id")
    vectors = {k: embed(t) for k, t in TEXTS.items()}
    made = F.udf(lambda k: vectors[k], "array<double>")
    index.update_vectors(chunks.select("chunk_id", "stem"), f"{path}/vectors", lambda df: df.withColumn("embedding", made("chunk_id")))
    return path


def slow_scores(query):
    def bag(text):
        w = [t for t in re.findall(r"\w\w+", text.lower()) if t not in search.STOP_WORDS]
        return Counter([*w, *map(" ".join, zip(w, w[1:]))])

    bags = {k: bag(t) for k, t in TEXTS.items()}
    df = Counter(t for b in bags.values() for t in b)
    idf = {t: math.log((1 + len(TEXTS)) / (1 + n)) + 1 for t, n in df.items()}
    vec = lambda b: {t: (1 + math.log(n)) * idf[t] for t, n in b.items() if t in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    q = vec(bag(query))
    return {k: round(sum(q.get(t, 0) * x for t, x in vec(b).items()) / norm(vec(b)) / norm(q), 6) for k, b in bags.items() if set(q) & set(b)}


def test_keyword_search_is_the_cosine(spark, built):
    opened = index.KeywordIndex(spark, f"{built}/keyword")
    for query in ("red wheel", "the red wheel red", "license days", "unknown words", "", "the of"):
        want = slow_scores(query) if query.strip() not in ("", "the of", "unknown words") else {}
        got = opened.search(query).collect()
        assert {r.chunk_id: r.score for r in got} == want
        assert [r.chunk_id for r in got] == sorted(want, key=lambda k: (-want[k], k)) and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert len(opened.search("red wheel license", 1).collect()) == 1


def test_index_needs_texts_and_is_found_when_built(spark, built, tmp_path):
    assert index.available(spark, f"{built}/keyword") and not index.available(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        index.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "x"))
    with pytest.raises(FileNotFoundError):
        index.KeywordIndex(spark, str(tmp_path / "none"))
    index.build(spark.createDataFrame([(1, "red red wheel"), (2, "red door"), (3, None)], "doc_id long, text string"), str(tmp_path / "few"), max_features=1)
    assert [r.term for r in tables.read(spark, str(tmp_path / "few/terms")).collect()] == ["red"]


def test_a_posting_takes_few_bytes(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    texts = [(i, " ".join(rng.choices(words, k=120))) for i in range(1500)]
    index.build(spark.createDataFrame(texts, "doc_id long, text string"), str(tmp_path / "i"))
    postings = sum(len({*w, *zip(w, w[1:])}) for w in (t.split() for _, t in texts))
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 8 * postings


def test_postings_of_segments_are_merged_in_blocks(monkeypatch):
    pa = pytest.importorskip("pyarrow")
    from docketry.operators import inverted

    monkeypatch.setattr(inverted, "BLOCK", 3)
    texts = [["red", "wheel", "red"], None, ["red", "the", "wheel"], [], ["red"], ["ünter", "red"], ["red", "wheel", "red", "wheel"]]
    want = {}
    for number, words in enumerate(texts):
        words = [w for w in words or [] if w != "the"]
        for term, tf in Counter([*words, *map(" ".join, zip(words, words[1:]))]).items():
            want.setdefault(term, []).append((number, tf))
    parts, rows, keys = 4, [], {}
    batches = [pa.record_batch([pa.array([f"k{i}" for i in range(a, b)]), pa.array(texts[a:b], pa.list_(pa.string()))], ["key", "w"]) for a, b in ((0, 3), (3, 4), (4, 7))]
    pieces = [b for base, held in ((0, batches[:1]), (3, batches[1:])) for b in inverted._segment(held, base, parts, ["the"])]
    for p in range(parts):
        own = [b.filter(pa.compute.equal(b.column(0), p)) for b in pieces]
        for b in inverted.merged(pa.string())(own):
            rows += [r for r in b.to_pylist() if r["term"]]
            keys |= {n: k for r in b.to_pylist() if not r["term"] for n, k in zip(r["texts"], r["keys"])}
    assert keys == {i: f"k{i}" for i in range(7)}
    got = {}
    for r in rows:
        assert len(r["texts"]) <= 3 and r["part"] == inverted.part_of(r["term"], parts) and r["block"] == len(got.get(r["term"], [])) // 3
        got.setdefault(r["term"], []).extend(zip(r["texts"], r["tfs"]))
        assert r["df"] == len(want[r["term"]]) and r["occurrences"] == sum(tf for _, tf in want[r["term"]])
    assert got == want and len(got["red"]) == 5


def test_versions_replace_each_other(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read(spark, path) is None
    for n in range(4):
        tables.write(spark.range(n), path)
        assert tables.read(spark, path).count() == n
    assert len(tables.versions(spark, path)) == tables.KEPT


def found(spark, built, chunks, *args, **kwargs):
    rerank = kwargs.pop("reranker", None)
    return retrieve.Retriever(spark, built, chunks, kwargs.pop("embed", embed), rerank).search(*args, **kwargs).orderBy("rank").collect()


def test_modes(spark, built, chunks):
    words = found(spark, built, chunks, "red wheel", mode="bm25")
    assert words[0].score == 1.0 and words[-1].score == 0.0 and {r.stem for r in words} == {"alpha"}
    near = found(spark, built, chunks, "red wheel", mode="semantic")
    assert near[0].chunk_id == "alpha_chunk_0000" and near[0].bm25_score is None and near[0].semantic_score == 1.0
    both = found(spark, built, chunks, "red wheel", mode="hybrid")
    assert len(both) == 4 and all(r.score > 0 for r in both) and {both[0].chunk_id, both[1].chunk_id} == {"alpha_chunk_0000", "alpha_chunk_0001"}
    assert found(spark, built, chunks, "  ") == []
    with pytest.raises(ValueError):
        found(spark, built, chunks, "x", mode="other")
    alone = found(spark, built, chunks, "red wheel", embed=None)
    assert [r.chunk_id for r in alone] == [r.chunk_id for r in words]
    assert len(found(spark, built, chunks, "red wheel", 1, "bm25")) == 1
    gap = retrieve.Retriever(spark, built, chunks.filter("chunk_id <> 'alpha_chunk_0000'"), embed).search("red wheel", mode="semantic").orderBy("rank").collect()
    assert gap[0]["rank"] == 2 and len(gap) == 3


def test_phrases_are_lifted_and_reranking_trims_last(spark, built, chunks):
    query = "red wheel stopped at noon"
    plain = found(spark, built, chunks, query, mode="bm25")
    assert plain[0].chunk_id == "alpha_chunk_0001" and plain[0].score == search.PHRASE_FACTOR and plain[0].bm25_score == search.PHRASE_FACTOR
    back = lambda q, text: -F.length(text)
    again = found(spark, built, chunks, "red wheel", mode="bm25", rerank=True, rerank_top_k=1, reranker=back)
    assert [(r.chunk_id, r["rank"], r.score) for r in again] == [("alpha_chunk_0000", 1, -float(len(TEXTS["alpha_chunk_0000"])))]
    assert len(found(spark, built, chunks, "red wheel", 2, mode="bm25", rerank=True)) == 2


@pytest.mark.parametrize("query,line,page", [("A witness saw", 1, 3), ("the RED wheel stopped", 2, 4), ("nobody else", 3, 5), ("wheel noon stopped else", 2, 4), ("zebra", None, None), (" ", None, None)])
def test_place_of_a_hit(spark, chunks, query, line, page):
    r = retrieve.hit_places(chunks.filter("chunk_id = 'alpha_chunk_0001'"), query).first()
    assert (r.hit_line, r.hit_page, r.hit_bates) == (line, page, None)
    shown = retrieve.display(chunks.filter("chunk_id = 'alpha_chunk_0001'").withColumns({"rank": F.lit(1), "score": F.lit(0.5)}), query).first()
    assert "\n" not in shown.preview and shown.hit_page == page


def test_fusion_of_two_lists(spark):
    lists = "chunk_id string, bm25_score double, semantic_score double, rank int"
    a = spark.createDataFrame([(c, 0.5, None, i) for i, c in enumerate("123", 1)], lists)
    b = spark.createDataFrame([(c, None, 0.5, i) for i, c in enumerate("214", 1)], lists)
    got = retrieve.fuse(a, b).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["1", "2", "3", "4"] and got[0].score == got[1].score == pytest.approx(1 / 61 + 1 / 62)
    assert got[0].bm25_score == got[0].semantic_score == 0.5


def test_vectors_follow_their_chunks(spark, tmp_path):
    path = str(tmp_path / "v")
    calls = []

    def embedder(df):
        calls.append(sorted(r.chunk_id for r in df.collect()))
        return df.withColumn("embedding", F.when(F.col("chunk_id") != "b_chunk_0001", F.array(F.length("text").cast("double"))))

    first = spark.createDataFrame([("a_chunk_0000", "a", "x"), ("b_chunk_0000", "b", "yy"), ("b_chunk_0001", "b", "zzz")], "chunk_id string, stem string, text string")
    assert index.existing(spark, path).count() == 0
    assert index.update_vectors(first, path, embedder) == {"added": 2, "deleted": 0}
    assert index.update_vectors(first, path, embedder) == {"added": 0, "deleted": 0} and calls[-1] == ["b_chunk_0001"]  # tried again
    second = spark.createDataFrame([("a_chunk_0000", "a", "changed"), ("c_chunk_0000", "c", "new")], "chunk_id string, stem string, text string")
    changed = spark.createDataFrame([("a",)], "stem string")
    assert index.update_vectors(second, path, embedder, changed=changed) == {"added": 2, "deleted": 2} and calls[-1] == ["a_chunk_0000", "c_chunk_0000"]
    assert {r.chunk_id: r.embedding for r in tables.read(spark, path).collect()} == {"a_chunk_0000": [7.0], "c_chunk_0000": [3.0]}
    assert index.update_vectors(second, path, embedder, incremental=False)["added"] == 2
    near = index.search_vectors(tables.read(spark, path), [3.0], 1).first()
    assert (near.chunk_id, near.score, near["rank"]) == ("c_chunk_0000", 1.0, 1)


def test_documents_are_removed(spark, built, chunks, tmp_path):
    path = str(tmp_path)
    index.build(chunks.select("chunk_id", F.col("core_text").alias("text")), f"{path}/keyword", key="chunk_id")
    index.update_vectors(chunks.select("chunk_id", "stem"), f"{path}/vectors", lambda df: df.withColumn("embedding", F.array(F.lit(1.0))))
    assert index.remove(spark, path, "alpha") == 2 and index.remove(spark, path, "alpha") == 0
    assert {r.stem for r in index.existing(spark, f"{path}/vectors").collect()} == {"beta"}
    assert index.KeywordIndex(spark, f"{path}/keyword").search("red wheel").count() == 0


def test_candidates_below_k_can_be_lifted(spark, tmp_path):
    """A phrase is fetched fifty deep, reranking three times k, either list of a fusion twice that; lists are trimmed last."""
    query = "red fox jumps high today"
    texts = [(f"d{i:02d}_chunk_0000", f"d{i:02d}", "red fox jumps high " * 3 + f"w{i}") for i in range(15)] + [("z_chunk_0000", "z", "today a Red  fox jumps\nhigh today")]
    empty = spark.createDataFrame([], model.CHUNKS)
    made = empty.unionByName(spark.createDataFrame(texts, "chunk_id string, stem string, core_text string"), allowMissingColumns=True)
    path = str(tmp_path)
    index.build(made.select("chunk_id", F.col("core_text").alias("text")), f"{path}/keyword", "chunk_id")
    index.update_vectors(made.select("chunk_id", "stem"), f"{path}/vectors", lambda df: df.withColumn("embedding", F.array(F.length("chunk_id").cast("double"))))
    plain = {r.chunk_id: r["rank"] for r in index.KeywordIndex(spark, f"{path}/keyword").search(query, 50).collect()}
    assert len(plain) == 16
    opened = retrieve.Retriever(spark, path, made, lambda q: [12.0])
    for mode in ("bm25", "hybrid"):
        got = opened.search(query, 3, mode).orderBy("rank").collect()
        assert got[0].chunk_id == "z_chunk_0000" and len(got) == 3
    lifted = retrieve.Retriever(spark, path, made, None, lambda q, text: text.contains("w14").cast("double"))
    assert plain["d14_chunk_0000"] > 6 and lifted.search("red fox", 6, "bm25", rerank=True, rerank_top_k=1).first().chunk_id == "d14_chunk_0000"
    assert (search.fetch_k("two words", 10), search.fetch_k("two words", 10, True), search.fetch_k(query, 10), search.fetch_k(query, 20, True)) == (10, 30, 50, 60)

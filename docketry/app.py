"""A corpus in a folder of tables, and what can be done with it: process, ingest, index, search, remove, enrich."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import model
from docketry.functions import text as T
from docketry.operators import chunks as C
from docketry.operators import cite, classify, enrich, folds, index, postprocess, report, retrieve, state
from docketry.sources import files, loadfile, sinks, tables, transcripts

#: What a converter gives of a file, as JSON: marked-down text, layout elements, page sizes, texts of the first pages.
CONVERTED = (
    "struct<md:string,elements:array<struct<self_ref:string,label:string,text:string,page_no:int,l:double,t:double,r:double,b:double>>,"
    "pages:array<struct<page_no:int,width:double,height:double,text:string>>>"
)
FIRST_PAGES = 5


class Corpus:
    """Tables below a path: documents, citations, chunks, state, results, flagged_*, manifest, stats, index_state; indexes below index/."""

    def __init__(self, spark: SparkSession, path: str, settings: dict | None = None) -> None:
        from docketry import config

        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings or config.settings()

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        found = tables.read(self.spark, f"{self.path}/{name}")
        if found is None:
            if schema is None:
                raise FileNotFoundError(f"no table {name} in {self.path}")
            return self.spark.createDataFrame([], schema)
        return found

    def save(self, name: str, df: DataFrame) -> DataFrame:
        tables.write(df, f"{self.path}/{name}")
        return self.table(name)

    def _replace(self, name: str, rows: DataFrame, key: str = "stem") -> DataFrame:
        """Rows of some documents in place of what there was of them."""
        held = tables.read(self.spark, f"{self.path}/{name}")
        if held is not None:
            rows = held.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)
        return self.save(name, rows)

    # Documents

    def process(self, root: str, converter: Callable[[str, bytes], str] | None = None, labels: DataFrame | None = None, force: bool = False, skip_failed: bool = True, learned: DataFrame | None = None) -> DataFrame:
        """Take up the files below root: classify, convert, mark, cite, chunk. The results, a row a file (model.RESULTS and source_path).

        Plain transcripts are read as they are; other texts are marked as they are; all other files go
        to converter, which gives CONVERTED as JSON. A file that fails, or that has no converter, is
        FAILED and says why; what is a duplicate, done, or has failed too often is SKIPPED. labels
        (stem, doc_type) are types that a person has given.
        """
        began = time.time()
        found = files.discover(self.spark, root)
        found = found.withColumn("doc_id", F.xxhash64("path"))
        named = state.disambiguate(found.drop("content"), "path", "stem").select("path", F.col("unique_stem").alias("stem"))
        taken = self.save("inputs", found.drop("stem").join(named, "path"))
        before = self.table("state", state.DOCUMENTS)
        hashed = taken.select("stem", "path", F.when(F.col("ext") == "pdf", F.col("content_hash")).alias("content_hash"))
        gate = state.skip_reasons(hashed, before, force, skip_failed).select("path", "skip", "duplicate_of")
        todo = taken.join(gate.filter("skip IS NULL").select("path"), "path", "left_semi")
        made = self._converted(todo, converter)
        typed = self._typed(made, labels, learned)
        documents, citations = self._cited(typed)
        chunked = C.chunk(documents, citations, self.settings["chunking"]["target_tokens"], self.settings["chunking"]["max_tokens"], self.settings["chunking"]["overlap_tokens"])
        documents = self._replace("documents", documents)
        citations = self._replace("citations", citations.join(documents.select("doc_id", "stem"), "doc_id"))
        chunked = self._replace("chunks", chunked)
        results = self._results(taken, gate, typed, citations, chunked, (time.time() - began))
        results = self.save("results", results)
        self._advance(before, taken, results)
        return results

    def _converted(self, todo: DataFrame, converter) -> DataFrame:
        """doc_id, path, stem, ext, md, elements, pages, method, content, is_transcript, error of each file."""
        plain = todo.filter("ext = 'txt'").select("doc_id", "path", "name", "stem", "ext", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
        told = transcripts.is_transcript(plain.select("doc_id", F.col("text").alias("content")))
        texts = plain.join(told, "doc_id").withColumn("method", F.when(F.col("is_transcript"), "text_extractor").otherwise("plain"))
        none = F.from_json(F.lit("{}"), CONVERTED)
        texts = texts.select("doc_id", "path", "name", "stem", "ext", F.when(~F.col("is_transcript"), F.col("text")).alias("md"), none["elements"].alias("elements"), none["pages"].alias("pages"), "method", F.col("text").alias("raw"), "is_transcript", F.lit(None).cast("string").alias("error"))
        other = todo.filter("ext <> 'txt'")
        known = {"fallback": converter} if converter else None
        made = files.convert(other, known).select("path", "md", "error")
        read = other.select("doc_id", "path", "name", "stem", "ext").join(made, "path").withColumn("j", F.from_json("md", CONVERTED))
        broken = F.when(F.col("error").isNull() & F.col("j.md").isNull(), F.lit("the converter gave no text")).otherwise(F.col("error"))
        rest = read.select("doc_id", "path", "name", "stem", "ext", "j.md", "j.elements", "j.pages", F.lit("converter").alias("method"), F.lit(None).cast("string").alias("raw"), F.lit(False).alias("is_transcript"), broken.alias("error"))
        return self.save("converted", texts.unionByName(rest))

    def _typed(self, made: DataFrame, labels: DataFrame | None, learned: DataFrame | None) -> DataFrame:
        first = F.array_join(F.transform(F.filter(F.coalesce("pages", F.array()), lambda p: p["page_no"] <= FIRST_PAGES), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
        text = F.coalesce(F.nullif(first, F.lit("")), "md", "raw", F.lit(""))
        n = F.greatest(F.lit(1), F.least(F.lit(FIRST_PAGES), F.size(F.coalesce("pages", F.array()))))
        kinds = classify.classify(made.select("stem", F.col("name").alias("file_name"), text.alias("text"), n.alias("n_pages")), learned=learned, key="stem")
        if labels is not None:
            kinds = classify.with_overrides(kinds, labels, "stem")
        joined = made.join(kinds.select("stem", "doc_type", "confidence", "needs_input"), "stem")
        forced = F.col("is_transcript")
        return self.save("typed", joined.withColumns({"doc_type": F.when(forced, "deposition").otherwise(F.col("doc_type")), "confidence": F.when(forced, 1.0).otherwise(F.col("confidence")), "needs_input": F.col("needs_input") & ~forced}))

    def _cited(self, typed: DataFrame) -> tuple[DataFrame, DataFrame]:
        ok = typed.filter("error IS NULL")
        spoken = ok.filter("is_transcript").select("doc_id", F.col("raw").alias("content"))
        md_a, cites_a = transcripts.from_text(spoken)
        rest = ok.filter("NOT is_transcript")
        elements = rest.select("doc_id", F.posexplode("elements").alias("ord", "e")).select("doc_id", F.col("ord").cast("long").alias("ord"), "e.*")
        sizes = rest.select("doc_id", F.inline("pages")).select("doc_id", "page_no", "width", "height")
        md_b, cites_b = postprocess.process(rest.select("doc_id", "md", "doc_type"), elements)
        rebuilt = cite.reconstruct(elements, rest.select("doc_id", "doc_type"), sizes)
        # what is rebuilt from layout takes the place of what the text told
        told = cites_b.join(rebuilt.select("doc_id").distinct(), "doc_id", "left_anti")
        md = md_a.unionByName(md_b)
        about = ok.select("doc_id", "stem", "doc_type", F.col("name").alias("file_name"), F.col("path").alias("source_path"))
        return self.save("marked", md.join(about, "doc_id")), self.save("cited", cites_a.unionByName(rebuilt).unionByName(told))

    def _results(self, taken: DataFrame, gate: DataFrame, typed: DataFrame, citations: DataFrame, chunked: DataFrame, seconds: float) -> DataFrame:
        metrics = cite.validate(citations)
        counted = chunked.groupBy("stem").agg(F.count(F.lit(1)).alias("chunks_count"))
        rows = taken.select("doc_id", F.col("name").alias("file"), "stem", F.col("path").alias("source_path")).join(gate.withColumnRenamed("path", "source_path"), "source_path")
        about = typed.select("stem", "doc_type", F.col("confidence").alias("classification_confidence"), F.col("method").alias("extraction_method"), "error", (F.size(F.coalesce("elements", F.array())) > 0).alias("had_elements"))
        joined = rows.join(about, "stem", "left").join(metrics, "doc_id", "left").join(counted, "stem", "left")
        status = F.when(F.col("skip").isNotNull(), "SKIPPED").when(F.col("error").isNotNull(), "FAILED").otherwise("OK")
        ok = status == "OK"
        have = {
            "status": status, "citations_count": F.when(ok, F.coalesce("total_items", F.lit(0))), "coverage_pct": F.when(ok, F.coalesce("coverage_pct", F.lit(0.0))), "chunks_count": F.when(ok, F.coalesce("chunks_count", F.lit(0))),
            "elapsed_seconds": F.lit(seconds), "had_json": F.when(F.col("extraction_method") == "converter", F.col("had_elements")).otherwise(True), "citation_degraded": F.lit(False), "error": F.coalesce("error", "skip"),
        }
        names = [c.split()[0] for c in model.RESULTS.split(", ")]
        return joined.select(*[have[n].alias(n) if n in have else F.col(n) for n in names], "source_path")

    def _advance(self, before: DataFrame, taken: DataFrame, results: DataFrame) -> None:
        ran = results.filter("status <> 'SKIPPED'")
        seen = taken.join(ran.select("stem"), "stem", "left_semi").select("stem", F.col("name").alias("filename"), F.col("path").alias("source_path"), F.col("length").alias("file_size_bytes"), F.when(F.col("ext") == "pdf", F.col("content_hash")).alias("content_hash"))
        now = F.current_timestamp()
        done = ran.filter("status = 'OK'").select("stem", now.alias("ts"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("stage")) for k, s in (("stage", "conversion"), ("stage", "post_processing"), ("stage", "citation_tracking"), ("completed", None))])).alias("x")).select("stem", "ts", "x.*", F.lit(None).cast("string").alias("error"))
        bad = ran.filter("status = 'FAILED'").select("stem", now.alias("ts"), F.lit("failed").alias("kind"), F.lit(None).cast("string").alias("stage"), "error")
        self.save("state", state.advance(state.upsert(before, seen), done.unionByName(bad)))

    # Load files

    def ingest(self, root: str, natives: dict | None = None, recognise: Callable[[str, bytes], str] | None = None, pagination: bool = True) -> DataFrame:
        """Take up the load-file productions below root: their statistics, a row each.

        Vendor texts come first; natives are connectors for files without one. Texts of several pages
        without breaks are aligned with what recognise reads from page images.
        """
        listed = files.discover(self.spark, root, extensions=("dat", "opt", "txt", "tif", "tiff", "jpg", "png", *loadfile.PARSEABLE), content=False)
        found = loadfile.productions(listed.select("path"), root)
        if not found.take(1):
            raise FileNotFoundError(f"no load files below {root}")
        contents = loadfile.read_text_files(self.spark, root)
        dats = found.join(contents, found.dat == contents.path).select(F.col("name").alias("production"), "content")
        opts = found.withColumn("opt", F.regexp_replace("dat", r"\.dat$", ".opt")).join(contents, F.col("opt") == contents.path).select(F.col("name").alias("production"), "content")
        records = loadfile.parse_records(loadfile.rows_of(dats)).withColumn("doc_id", F.xxhash64("production", "line_no")).join(found.select(F.col("name").alias("production"), F.col("folder").alias("root")), "production")
        records = self.save("records", records)
        images = loadfile.latest_pages(loadfile.group_pages(loadfile.parse_pages(loadfile.rows_of(opts))))
        resolved = loadfile.resolve(loadfile.resolve(records, "text_path", listed, "text_file"), "native_path", listed, "native_file")
        texts = resolved.join(contents, resolved.text_file == contents.path).select("doc_id", "content")
        native = None
        if natives is not None:
            raw = files.discover(self.spark, root, extensions=loadfile.PARSEABLE)
            made = files.convert(raw.join(resolved.select(F.col("native_file").alias("path")), "path", "left_semi"), natives)
            native = resolved.join(made.filter("error IS NULL"), resolved.native_file == made.path).select("doc_id", F.col("md").alias("content"))
        aligned = self._aligned(records, texts, images, listed, root, recognise) if recognise and pagination else None
        made = loadfile.ingest(records, texts, images, native, aligned, pagination)
        documents, citations = self.save("marked", made["documents"]), self.save("cited", made["citations"])
        for name in ("manifest", "flagged_content", "flagged_pages", "stats"):
            self.save(name, made[name])
        s = self.settings["chunking"]
        chunked = C.chunk(documents, citations, s["target_tokens"], s["max_tokens"], s["overlap_tokens"])
        self._replace("documents", documents)
        self._replace("citations", citations.join(documents.select("doc_id", "stem"), "doc_id"))
        self._replace("chunks", chunked)
        return self.table("stats")

    def _aligned(self, records, texts, images, listed, root, recognise) -> DataFrame:
        pages = records.join(images, ["production", "beg_bates"]).select("doc_id", "root", F.posexplode("images").alias("i", "image"))
        placed = loadfile.resolve(pages, "image", listed, "file").filter("file IS NOT NULL").select("doc_id", (F.col("i") + 1).alias("page_no"), F.col("file").alias("path"))
        raw = files.discover(self.spark, root, extensions=("tif", "tiff", "jpg", "png")).select("path", "content")
        known = self.table("recognised", "doc_id long, page_no int, path string, text string").select("path", "text").dropDuplicates(["path"])
        read = self.save("recognised", files.recognised(placed.join(raw, "path"), known, recognise))
        listed_pages = read.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p")).select("doc_id", F.col("p.text").alias("pages"))
        starts = folds.align_pages(texts.select("doc_id", F.col("content").alias("text")).join(listed_pages, "doc_id"))
        by = starts.filter("page > 1").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "start"))).alias("s"), F.max("flagged").alias("flagged"), F.count_if("wide").alias("wide"), F.count_if(~F.col("has_anchor")).alias("bare"))
        why = F.when(F.col("flagged"), F.format_string("%d wide boundaries, %d pages without an anchor", "wide", "bare")).otherwise("")
        return by.select("doc_id", F.col("s.start").alias("starts"), "flagged", why.alias("reason"))

    # Search

    def index(self, embed: Callable[[DataFrame], DataFrame] | None = None, force: bool = False) -> dict:
        """Bring the indexes up to date with the chunks: what was done. Nothing, if no document is new, changed or gone."""
        chunked = self.table("chunks")
        content = F.sha2(F.concat_ws("\0", F.array_sort(F.collect_list(F.concat_ws("\1", "chunk_id", "core_text", "citation_string")))), 256)
        now = chunked.groupBy("stem").agg(content.alias("content_hash"), F.count(F.lit(1)).alias("chunk_count")).select(F.concat("stem", F.lit("_chunks.json")).alias("filename"), "stem", "content_hash", "chunk_count")
        held = self.table("index_state", state.INDEXED)
        if not force and not state.index_is_stale(now, held):
            return {"keyword": "unchanged"}
        changed = state.to_reindex(now, held, force)
        n_changed = changed.count()
        keyword = self.settings["keyword"]
        more = {"stop_words": keyword["stop_words"]} if keyword.get("stop_words") is not None else {}
        index.build(chunked.select("chunk_id", F.col("core_text").alias("text")), f"{self.path}/index/keyword", "chunk_id", keyword["max_features"], **more)
        done = {"keyword": "built", "changed": n_changed}
        kinds = ["bm25"]
        if embed is not None:
            done |= index.update_vectors(chunked.select("chunk_id", "stem", F.col("core_text").alias("text")), f"{self.path}/index/vectors", embed, None if not force else False, changed.select("stem"))
            kinds.append("chroma")
        rows = now.select("filename", F.concat(F.lit(f"{self.path}/chunks/"), "stem").alias("file_path"), "content_hash", F.current_timestamp().alias("last_indexed"), "chunk_count", F.array(*map(F.lit, kinds)).alias("index_types"))
        self.save("index_state", rows)
        return done

    def retriever(self, embed: Callable[[str], list[float]] | None = None, rerank: Callable[[str, Column], Column] | None = None) -> retrieve.Retriever:
        return retrieve.Retriever(self.spark, f"{self.path}/index", self.table("chunks"), embed, rerank)

    def search(self, query: str, top_k: int = 10, mode: str = "hybrid", rerank: bool = False, embed=None, reranker=None) -> DataFrame:
        """What a reader is shown of the hits."""
        return retrieve.display(self.retriever(embed, reranker).search(query, top_k, mode, rerank), query)

    def remove(self, name: str) -> dict[str, int]:
        """Take a document out of all tables and indexes: how many rows each had of it. name: its stem or file name."""
        stem = self.spark.range(1).select(T.normalize_stem(F.lit(name))).first()[0]
        gone = {}
        for table in ("documents", "citations", "chunks", "state"):
            held = tables.read(self.spark, f"{self.path}/{table}")
            if held is not None:
                gone[table] = held.filter(F.col("stem") == stem).count()
                if gone[table]:
                    self.save(table, held.filter(F.col("stem") != stem))
        gone["index"] = index.remove(self.spark, f"{self.path}/index", stem)
        held = tables.read(self.spark, f"{self.path}/index_state")
        if held is not None:
            self.save("index_state", state.index_remove(held, self.spark.createDataFrame([(f"{stem}_chunks.json",)], "filename string")))
        return gone

    def enrich(self, ask: Callable[[str], str], backend: str, context: str | None = None, force: bool = False) -> dict:
        """Ask a model about the chunks that it has not been asked about, and keep what is valid: counts. The chunks before stay a version."""
        chunked = self.table("chunks")
        answers = self.save("answers", enrich.ask(enrich.unenriched(chunked, force), ask, context))
        applied = self.save("enriched", enrich.apply(chunked, answers, backend))
        self.save("chunks", applied.select(*chunked.columns))
        return enrich.stats(applied).first().asDict()

    def report(self, seconds: float = 0.0) -> DataFrame:
        return report.lines(self.table("results"), seconds)

    def export(self, path: str) -> None:
        """Chunks, citations, results and what failed as JSON files below path."""
        sinks.chunks(self.table("chunks"), f"{path}/chunks")
        sinks.citations(self.table("citations"), f"{path}/citations")
        for name in ("results", "manifest", "flagged_content", "flagged_pages", "stats"):
            held = tables.read(self.spark, f"{self.path}/{name}")
            if held is not None:
                sinks.rows(held, f"{path}/{name}")
                if name == "results":
                    sinks.rows(state.failed_documents(held), f"{path}/failed_documents")

    def stats(self) -> tuple[DataFrame, dict]:
        return self.retriever().stats()

    def learn(self, labels: DataFrame) -> DataFrame:
        """Profiles of the documents that labels (stem, doc_type) name, added to those that are known."""
        typed = self.table("typed")
        rows = typed.join(labels.select("stem", F.col("doc_type").alias("given")), "stem").select("stem", "given", F.coalesce("md", "raw", F.lit("")).alias("text"), F.lit(1).alias("n_pages"))
        prints = classify.fingerprint(rows, key="stem").join(rows.select("stem", F.col("given").alias("doc_type")), "stem")
        new = classify.profiles(prints, "doc_type", [*classify.LAYOUT_FEATURES, *classify.TEXT_FEATURES])
        known = tables.read(self.spark, f"{self.path}/profiles")
        return self.save("profiles", new if known is None else classify.merge_profiles(known, new, "doc_type"))


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON objects, nulls left out, a line each."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value"))


def plain(value) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)


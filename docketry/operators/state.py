"""State kept between runs: duplicates, changes, retries, names, what was indexed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry import workers

MAX_RETRIES = 3
#: What is taken over from a file only where nothing is known yet.
SOURCE_FIELDS = ("source_path", "file_size_bytes", "page_count", "content_hash", "author", "creation_date", "modified_date")
DOCUMENTS = (
    "stem string, filename string, stages_completed array<string>, status string, last_updated timestamp, error string, retry_count int, "
    "source_path string, file_size_bytes long, page_count int, content_hash string, author string, creation_date string, modified_date string"
)
INDEXED = "filename string, file_path string, content_hash string, last_indexed timestamp, chunk_count long, index_types array<string>"


def content_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, content_hash, first_id: the first document with the same content, itself or an earlier one."""
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"))
    return hashed.join(first, "content_hash").select("doc_id", "content_hash", "first_id")


def changes(current: DataFrame, known: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Rows of current that are new or whose hash differs from the known one."""
    joined = current.join(known.select(key, F.col("content_hash").alias("known_hash")), key, "left")
    return joined.filter(F.lit(force) | F.col("known_hash").isNull() | (F.col("known_hash") != F.col("content_hash"))).select(*current.columns)


def vanished(current: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return known.join(current.select(key).distinct(), key, "left_anti")


def update_plan(current: DataFrame, existing: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """key, action: delete what is gone or changed, add what is new or changed."""
    gone = existing.join(current, key, "left_anti").select(key, F.lit("delete").alias("action"))
    redone = existing.join(changed, key, "left_semi").select(key, F.lit("delete").alias("action"))
    new = current.join(existing, key, "left_anti").select(key, F.lit("add").alias("action"))
    again = current.join(existing, key, "left_semi").join(changed, key, "left_semi").select(key, F.lit("add").alias("action"))
    return gone.unionByName(redone).unionByName(new).unionByName(again)


def fold(events: DataFrame) -> DataFrame:
    """Status of each document from its log: stages done, failures, last state."""
    return events.groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count_if(F.col("event_type") == "error").alias("retry_count"),
        F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("stages"), F.count(F.lit(1)).alias("n_events"),
    )


def gate(state: DataFrame, force: bool = False) -> DataFrame:
    """Whether a document is to be processed, and why not."""
    reason = F.when(F.lit(force), "forced").when(F.col("status") == "purchase", "completed").when(F.col("retry_count") >= MAX_RETRIES, "failed").otherwise("run")
    return state.withColumn("decision", reason)


def unique_names(stems: list[str]) -> list[str]:
    """Stems in order, each with the first of _2, _3, ... that no name before it has, if it is taken itself."""
    taken: set[str] = set()
    tried: dict[str, int] = {}
    out = []
    for stem in stems:
        name = stem
        while name in taken:
            tried[stem] = tried.get(stem, 1) + 1
            name = f"{stem}_{tried[stem]}"
        taken.add(name)
        out.append(name)
    return out


def disambiguate(names: DataFrame, key: str, stem: str) -> DataFrame:
    """names with unique_stem, in the order of key. Names can only meet where they are equal but for numbers at their ends."""
    root = F.regexp_replace(F.coalesce(stem, F.lit("")), r"(_\d+)+$", "")
    schema = names.select(key, stem, root.alias("_root"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(key, kind="stable")
        return pd.DataFrame({key: ordered[key], "unique_stem": unique_names(ordered[stem].fillna("").tolist())})

    workers.ship(names.sparkSession)
    found = schema.groupBy("_root").applyInPandas(run, f"{key} {schema.schema[key].dataType.simpleString()}, unique_stem string")
    return names.join(found, key)


# Documents of a run


def upsert(state: DataFrame, seen: DataFrame) -> DataFrame:
    """state (DOCUMENTS) with the files that a run has seen (stem, filename, SOURCE_FIELDS): new ones begin, known ones only get what they lack."""
    fresh = seen.select("stem", F.col("filename").alias("_filename"), *[F.col(c).alias(f"_{c}") if c in seen.columns else F.lit(None).alias(f"_{c}") for c in SOURCE_FIELDS])
    joined = state.join(fresh, "stem", "full")
    blank = lambda c: F.when(F.col(c).cast("string").isin("", "0"), None).otherwise(F.col(c)) if c != "page_count" else F.col(c)
    types = dict(c.split() for c in DOCUMENTS.split(", "))
    out = {
        "stem": F.col("stem"), "filename": F.coalesce("filename", "_filename"), "stages_completed": F.coalesce("stages_completed", F.array().cast("array<string>")),
        "status": F.coalesce("status", F.lit("in_progress")), "last_updated": F.coalesce("last_updated", F.current_timestamp()), "error": F.col("error"), "retry_count": F.coalesce("retry_count", F.lit(0)),
    } | {c: F.coalesce(blank(c), F.col(f"_{c}")) for c in SOURCE_FIELDS}
    return joined.select(*[out[c].cast(t).alias(c) for c, t in types.items()])


def advance(state: DataFrame, events: DataFrame) -> DataFrame:
    """state after events (stem, ts, kind, stage, error): stages done once each in order, failures counted, the last status; an error stays until the next."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "kind", "stage", "error")))
    by = events.groupBy("stem").agg(ordered.alias("e"))
    status = F.element_at(F.filter("e", lambda x: x["kind"].isin("failed", "completed")), -1)
    failures = F.filter("e", lambda x: x["kind"] == "failed")
    stages = F.transform(F.filter("e", lambda x: x["kind"] == "stage"), lambda x: x["stage"])
    told = by.select(
        "stem", stages.alias("_stages"), F.when(F.exists("e", lambda x: x["kind"].isin("failed", "completed")), status["kind"]).alias("_status"), F.size(failures).alias("_failures"),
        F.when(F.size(failures) > 0, F.element_at(failures, -1)["error"]).alias("_error"), F.element_at("e", -1)["ts"].alias("_ts"),
    )
    out = {
        "stages_completed": F.array_distinct(F.concat("stages_completed", F.coalesce("_stages", F.array().cast("array<string>")))), "status": F.coalesce("_status", "status"),
        "retry_count": F.col("retry_count") + F.coalesce("_failures", F.lit(0)), "error": F.coalesce("_error", "error"), "last_updated": F.coalesce("_ts", "last_updated"),
    }
    return state.join(told, "stem", "left").select(*[out[c].alias(c) if c in out else F.col(c) for c in state.columns])


def should_process(stems: DataFrame, state: DataFrame, stage: str, force: bool = False) -> DataFrame:
    """stems with ``process``: unless the stage is done, or the document has failed MAX_RETRIES times."""
    known = state.select("stem", F.array_contains("stages_completed", stage).alias("_done"), ((F.col("status") == "failed") & (F.col("retry_count") >= MAX_RETRIES)).alias("_given_up"))
    joined = stems.join(known, "stem", "left")
    return joined.withColumn("process", F.lit(force) | ~(F.coalesce("_done", F.lit(False)) | F.coalesce("_given_up", F.lit(False)))).drop("_done", "_given_up")


def skip_reasons(files: DataFrame, state: DataFrame, force: bool = False, skip_failed: bool = True, self_is_duplicate: bool = False) -> DataFrame:
    """files (stem, path, content_hash) with skip: duplicate, completed, failed, or null; and duplicate_of.

    A file is a duplicate of a known document with its hash, or of a file before it in the run (by
    path). Files without a hash are none. self_is_duplicate: a document's own record counts too, which
    keeps failed ones from being tried again.
    """
    hashes = state.filter("content_hash IS NOT NULL").select("content_hash", F.col("stem").alias("_other"))
    own = F.lit(self_is_duplicate) | (F.col("_other") != F.col("stem"))
    before = files.join(hashes, "content_hash", "left").groupBy("stem", "path").agg(F.min(F.when(own, F.col("_other"))).alias("_known"))
    first = F.first("stem").over(Window.partitionBy("content_hash").orderBy("path"))
    met = files.withColumn("_first", F.when(F.col("content_hash").isNotNull(), first)).join(before, ["stem", "path"])
    duplicate = F.coalesce("_known", F.when(F.col("_first") != F.col("stem"), F.col("_first")))
    joined = met.join(state.select("stem", "status", "retry_count"), "stem", "left")
    skip = (
        F.when(F.lit(force), None).when(duplicate.isNotNull(), "duplicate").when(F.col("status") == "completed", "completed")
        .when(F.lit(skip_failed) & (F.col("status") == "failed") & (F.col("retry_count") >= MAX_RETRIES), "failed")
    )
    return joined.select(*files.columns, skip.alias("skip"), F.when(skip == "duplicate", duplicate).alias("duplicate_of"))


def incomplete(state: DataFrame) -> DataFrame:
    return state.filter("status <> 'completed'")


def failed(state: DataFrame) -> DataFrame:
    return state.filter("status = 'failed'")


def summary(state: DataFrame) -> DataFrame:
    """One row: total, completed, in_progress, failed."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return state.agg(F.count(F.lit(1)).alias("total"), count("completed"), count("in_progress"), count("failed"))


def failed_documents(results: DataFrame) -> DataFrame:
    """file, stem, source_path, error, elapsed_seconds of what failed."""
    return results.filter("status = 'FAILED'").select("file", "stem", "source_path", F.coalesce("error", F.lit("Unknown error")).alias("error"), "elapsed_seconds")


# What is indexed


def index_upsert(state: DataFrame, rows: DataFrame) -> DataFrame:
    """state (INDEXED) with rows of it in place of those of the same file."""
    return state.join(rows.select("filename"), "filename", "left_anti").unionByName(rows)


def index_remove(state: DataFrame, names: DataFrame) -> DataFrame:
    return state.join(names.select("filename"), "filename", "left_anti")


def index_prune(state: DataFrame, files: DataFrame) -> DataFrame:
    """state without the files that are there no more."""
    return state.join(files.select("filename").distinct(), "filename", "left_semi")


def to_reindex(files: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """files (filename, content_hash) that are new, changed, or all by force."""
    return changes(files, state, "filename", force)


def index_is_stale(files: DataFrame, state: DataFrame) -> bool:
    """Whether a file is new or changed, or an indexed one is gone: what is gone must leave the indexes too."""
    return bool(to_reindex(files, state).take(1)) or bool(vanished(files, state, "filename").take(1))


def index_summary(state: DataFrame) -> DataFrame:
    """One row: documents, chunks, how many documents have each kind of index."""
    kind = lambda k: F.count_if(F.array_contains("index_types", k)).alias(k)
    return state.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"), kind("bm25"), kind("chroma"))


def stem_of(name: Column) -> Column:
    """The document of a chunk file's name."""
    return F.regexp_replace(name, r"_chunks\.json$", "")


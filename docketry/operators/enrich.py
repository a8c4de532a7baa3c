"""What a model says of a chunk: asking, reading, validating, merging, counting."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import workers
from docketry.functions import text as T

#: Fixed values.
CATEGORIES = (
    "legal_argument", "factual_allegation", "evidence_reference", "expert_opinion", "witness_statement", "damages_analysis", "procedural", "background",
    "statutory_regulatory", "case_citation", "claim_construction", "infringement_analysis", "validity_invalidity", "unclassified",
)
RELEVANCE = ("high", "medium", "low")
MOST_CLAIM = 99
ANSWER = "struct<summary:string,key_quotes:array<string>,category:string,relevance_score:string,claims_addressed:array<string>>"
PROMPT = """You read one excerpt of a legal document.
{context}
The excerpt stands between the lines:
---
{text}
---

Answer with one JSON object and nothing else. Its fields:
- "summary": two or three sentences on what the excerpt means for the case
- "key_quotes": one to three passages, copied letter by letter from the excerpt; never reworded or shortened
- "category": one of {categories}
- "relevance_score": one of {relevance}
- "claims_addressed": the patent claims that matter here, as whole numbers; an empty list if none does"""


def context_lines(case_type: str = "patent", parties: list[str] = (), patents: list[str] = (), claims: list[int] = ()) -> str:
    """What is known of a case, a line each."""
    lines = [f"Case type: {case_type}"]
    for name, values in (("Parties", parties), ("Patents", patents), ("Claims at issue", claims)):
        if values:
            lines.append(f"{name}: {', '.join(map(str, values))}")
    return "\n".join(lines)


def prompt(text: Column, context: str | None = None) -> Column:
    """The request for one chunk's text."""
    asked = PROMPT.format(context=f"\nThe case:\n{context}\n" if context else "", text="\0", categories=", ".join(CATEGORIES), relevance=", ".join(RELEVANCE))
    before, after = asked.split("\0")
    return F.concat(F.lit(before), text, F.lit(after))


def parse_answer(answer: Column) -> Column:
    """The JSON object in an answer, fenced or with words around it, as ANSWER; null if there is none."""
    flat = T.strip(answer)
    fenced = F.regexp_extract(flat, r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```", 1)
    inner = F.when(fenced != "", T.strip(fenced)).otherwise(flat)
    body = F.regexp_extract(inner, r"(?s)\{.*\}", 0)
    kept = F.when(body != "", body)
    return F.when(F.try_parse_json(kept).isNotNull(), F.from_json(kept, ANSWER, {"mode": "PERMISSIVE"}))


def valid_quotes(quotes: Column, text: Column) -> Column:
    """Quotes, stripped, that stand in the text as they are."""
    return F.filter(F.transform(F.coalesce(quotes, F.array().cast("array<string>")), T.strip), lambda q: F.coalesce((q != "") & (F.instr(text, q) > 0), F.lit(False)))


def valid_claims(claims: Column) -> Column:
    """Whole numbers of 1 to MOST_CLAIM, each once, ascending; patent numbers and words are dropped, true counts as 1."""
    number = lambda c: F.when(F.lower(c) == "true", 1).otherwise(F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), T.strip(c).try_cast("bigint")).otherwise(F.when(c.rlike(r"^[+-]?\d+\.\d*$"), F.floor(c.try_cast("double")))))
    known = F.filter(F.transform(F.coalesce(claims, F.array().cast("array<string>")), number), lambda n: n.between(1, MOST_CLAIM))
    return F.transform(F.array_sort(F.array_distinct(known)), lambda n: n.cast("int"))


def one_of(value: Column, allowed: tuple[str, ...], otherwise: str) -> Column:
    low = F.lower(T.strip(value))
    return F.when(low.isin(*allowed), low).otherwise(otherwise)


def validate(enriched: DataFrame) -> DataFrame:
    """chunk_id, key_quotes, category, relevance, claims of (chunk_id, core_text, key_quotes, category, relevance, claims)."""
    return enriched.select(
        "chunk_id", F.array_distinct(valid_quotes(F.col("key_quotes"), F.col("core_text"))).alias("key_quotes"), one_of(F.col("category"), CATEGORIES, "unclassified").alias("category"),
        one_of(F.col("relevance"), RELEVANCE, "medium").alias("relevance"), valid_claims(F.col("claims")).alias("claims"),
    )


def merge_quotes(existing: Column, found: Column) -> Column:
    """Existing quotes first, then new ones, each once."""
    return F.array_distinct(F.concat(existing, found))


def unenriched(chunks: DataFrame, force: bool = False) -> DataFrame:
    """Chunks that no model has been asked about yet, or all by force; blank ones never."""
    new = F.coalesce("classification_method", F.lit("")) == ""
    return chunks.filter((F.lit(force) | new) & (T.strip(F.coalesce("core_text", F.lit(""))) != ""))


def ask(chunks: DataFrame, model: Callable[[str], str], context: str | None = None, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """chunk_id, answer, error: what model says to each chunk's prompt; a failure is tried again after twice the pause each time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for text in batch.column("prompt").to_pylist():
                answer, error = None, None
                for n in range(tries):
                    try:
                        answer, error = model(text), None
                        break
                    except Exception as e:  # noqa: BLE001 - a backend may raise anything; the row says what
                        error = f"{type(e).__name__}: {e}"
                        if n + 1 < tries:
                            time.sleep(pause * 2**n)
                answers.append(answer)
                errors.append(error if answer is None and error else None if answer is not None else "no answer")
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), pa.array(answers, pa.string()), pa.array(errors, pa.string())], ["chunk_id", "answer", "error"])

    workers.ship(chunks.sparkSession)
    return chunks.select("chunk_id", prompt(F.col("core_text"), context).alias("prompt")).mapInArrow(run, "chunk_id string, answer string, error string")


def apply(chunks: DataFrame, answers: DataFrame, backend: str) -> DataFrame:
    """chunks with what valid answers (chunk_id, answer, error) say; others stay as they are, and ``enrich_error`` says why.

    quotes_kept and quotes_dropped count an answer's quotes.
    """
    told = answers.select("chunk_id", F.col("error").alias("_failure"), parse_answer(F.col("answer")).alias("_a"), F.lit(True).alias("_asked"))
    joined = chunks.join(told, "chunk_id", "left")
    ok, a = F.col("_failure").isNull() & F.col("_a").isNotNull(), F.col("_a")
    good = valid_quotes(a["key_quotes"], F.col("core_text"))
    new = {
        "summary": F.nullif(T.strip(a["summary"]), F.lit("")), "category": one_of(a["category"], CATEGORIES, "unclassified"), "relevance_score": one_of(a["relevance_score"], RELEVANCE, "medium"),
        "claims_addressed": valid_claims(a["claims_addressed"]), "classification_method": F.lit("llm"), "llm_backend": F.lit(backend),
        "key_quotes": merge_quotes(F.coalesce("key_quotes", F.array().cast("array<string>")), good),
    }
    error = F.when(F.col("_asked") & ~ok, F.coalesce("_failure", F.lit("the answer is no JSON object")))
    kept, all_quotes = F.when(ok, F.size(good)), F.when(ok, F.size(F.coalesce(a["key_quotes"], F.array().cast("array<string>"))))
    return joined.select(*[F.when(ok, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in chunks.columns], error.alias("enrich_error"), "_asked", kept.alias("quotes_kept"), (all_quotes - kept).alias("quotes_dropped"))


def stats(applied: DataFrame) -> DataFrame:
    """One row: total, enriched, skipped, failed, quotes_validated, quotes_discarded of apply()'s rows."""
    asked = F.coalesce("_asked", F.lit(False))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return applied.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(asked & F.col("enrich_error").isNull()).alias("enriched"), F.count_if(~asked).alias("skipped"), F.count_if(F.col("enrich_error").isNotNull()).alias("failed"),
        total("quotes_kept").alias("quotes_validated"), total("quotes_dropped").alias("quotes_discarded"),
    )

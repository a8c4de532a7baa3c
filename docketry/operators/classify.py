"""Document classification: file name, keywords, shapes of lines, fonts, learned profiles; weighted argmax."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry import model
from docketry.functions import text as T

# Forms of file names, keywords and patterns of lines by document type.
FILE_NAMES = {
    "deposition": r"deposition|condensed.?transcript|transcript.?of",
    "hearing_transcript": r"hearing.?transcript",
    "expert_report": r"expert.?report|rebuttal.?report",
    "declaration": r"declaration.?of|decl\.?\s+of",
    "motion": r"motion.?to|mot\.",
    "brief": r"\bbrief\b|opposition|reply\b",
    "patent": r"\bpatent\b",
    "patent_prosecution": r"office.?action|file.?wrapper|prosecution",
    "agreement": r"agreement|license|contract|settlement",
    "sec_filing": r"10-[kq]|sec\b|annual.?report",
    "technical_standard": r"\bieee\b|standard|specification",
    "witness_statement": r"statement.?of|witness.?statement|affidavit",
    "discovery_response": (
        r"resp(?:onses?|s)?\s+(?:and\s+objs?|to)\s+.*(?:rogs?|interrog|rfps?|requests?\s+for\s+production|rfas?|requests?\s+for\s+admiss)"
        r"|obj(?:\.|ections?)?\s+and\s+resp(?:onses?|s)?|supp(?:l(?:emental)?)?\s+resp|\b(?:rogs?|rfps?|rfas?)\s+no"
    ),
    "discovery_request": (
        r"(?:first|second|third|fourth|fifth|\d(?:st|nd|rd|th)?)\s+set\s+of\s+(?:rogs?|interrog|rfps?|requests?|rfas?)"
        r"|set\s+of\s+(?:interrogatories|requests?\s+for\s+(?:production|admission))"
    ),
}
STAMPED_NAME, STAMPED_SCORE = r"^[a-z]+_[a-z]+_\d{5,}", 0.15
KEYWORDS = {
    "deposition": ["DEPOSITION OF", "TRANSCRIPT OF PROCEEDINGS", "COURT REPORTER", "VIDEOGRAPHER", "CCR", "RPR", "CRR", "CSR", "SWORN TESTIMONY"],
    "hearing_transcript": ["HEARING", "PROCEEDINGS", "THE COURT", "YOUR HONOR", "ARBITRATION", "ORAL ARGUMENT"],
    "expert_report": ["EXPERT REPORT", "OPINION", "METHODOLOGY", "ANALYSIS", "RETAINED BY", "QUALIFICATIONS"],
    "declaration": ["DECLARATION OF", "UNDER PENALTY OF PERJURY", "DECLARANT", "I DECLARE"],
    "motion": ["MOTION TO", "MOVES THIS COURT", "IN SUPPORT OF", "MEMORANDUM OF POINTS"],
    "brief": ["BRIEF IN", "TABLE OF AUTHORITIES", "ARGUMENT", "STATEMENT OF ISSUES"],
    "patent": ["UNITED STATES PATENT", "CLAIMS", "ABSTRACT", "INVENTORS", "FIELD OF THE INVENTION", "PRIOR ART"],
    "patent_prosecution": ["OFFICE ACTION", "NOTICE OF ALLOWANCE", "INFORMATION DISCLOSURE", "CLAIMS REJECTED", "AMENDMENT"],
    "agreement": ["WHEREAS", "NOW THEREFORE", "WITNESSETH", "LICENSE AGREEMENT", "EFFECTIVE DATE", "HEREBY AGREES"],
    "correspondence": ["FROM:", "TO:", "SUBJECT:", "DATE:", "DEAR"],
    "technical_standard": ["IEEE", "NORMATIVE REFERENCES", "SCOPE", "SHALL", "CONFORMANCE"],
    "scholarly": ["ABSTRACT", "REFERENCES", "INTRODUCTION", "CONCLUSION", "DOI", "ISSN", "UNIVERSITY"],
    "sec_filing": ["SECURITIES AND EXCHANGE", "10-K", "ANNUAL REPORT", "FORM 10-Q", "ITEM 1"],
    "witness_statement": ["STATEMENT OF", "AFFIDAVIT", "SWORN", "NOTARIZED"],
    "discovery_response": [
        "INTERROGATORY NO.", "RESPONSE TO INTERROGATORY", "REQUEST FOR PRODUCTION NO.", "RESPONSE TO REQUEST FOR PRODUCTION", "REQUEST FOR ADMISSION NO.",
        "RESPONSE TO REQUEST FOR ADMISSION", "GENERAL OBJECTIONS", "SUPPLEMENTAL RESPONSE", "PURSUANT TO RULES 26 AND 33", "PURSUANT TO RULE 33", "PURSUANT TO RULE 34",
        "PURSUANT TO RULE 36", "OBJECTIONS AND RESPONSES",
    ],
    "discovery_request": [
        "INTERROGATORY NO.", "REQUEST FOR PRODUCTION NO.", "REQUEST FOR ADMISSION NO.", "PROPOUNDS THE FOLLOWING", "FIRST SET OF INTERROGATORIES",
        "SECOND SET OF INTERROGATORIES", "FIRST SET OF REQUESTS", "SECOND SET OF REQUESTS", "NOTICE OF DEPOSITION",
    ],
}
LINE_SHAPES = {
    "turns": r"^\s*\d{0,2}\s*[QA][.\s:]",
    "margin_numbers": r"^\s{0,4}\d{1,2}\s{2,}",
    "numbered_paragraphs": r"^\d+\.\s+[A-Z]",
    "section_numbers": r"^\d+\.\d+\.?\d*\.?\s+",
    "mail_headers": r"^(From|To|Subject|Date|Cc|Bcc)\s*:",
    "items": r"(?i)^\s*ITEM\s+\d+",
    "paragraph_signs": r"[¶§]\s*\d+",
    "requests": r"(?i)^\s*(?:INTERROGATORY|REQUEST\s+FOR\s+(?:PRODUCTION|ADMISSION))\s+NO\.\s*\d+",
}
MAIL_LINES = 30
ANSWERS = ["RESPONSE TO INTERROGATORY", "RESPONSE TO REQUEST", "OBJECTIONS AND RESPONSES", "GENERAL OBJECTIONS", "SUPPLEMENTAL RESPONSE"]
FONTS = {"monospace": r"courier|mono|consolas|menlo", "serif": r"times|garamond|georgia|palatino|serif", "sans": r"arial|helvetica|calibri|sans"}
FONT_PAGES = 5
WEIGHTS = {"filename": 0.20, "content": 0.30, "structural": 0.30, "font": 0.15}
LEARNED_WEIGHTS = {"filename": 0.15, "content": 0.25, "structural": 0.25, "font": 0.10, "profile": 0.25}
LEAST_CONFIDENCE, LEAST_MARGIN = 0.12, 0.04


def _scores(rows: DataFrame, key: str, found: dict[str, Column]) -> DataFrame:
    """key, doc_type, score of the types whose score is known and above zero."""
    every = F.array(*[F.struct(F.lit(t).alias("doc_type"), F.coalesce(s.cast("double"), F.lit(0.0)).alias("score")) for t, s in found.items()])
    return rows.select(key, F.inline(F.filter(every, lambda x: x["score"] > 0)))


def filename_signal(rows: DataFrame, key: str = "doc_id", name: str = "file_name") -> DataFrame:
    """1 for each form that the name has; a stamped name is weakly an exhibit; a response is no request."""
    low = F.lower(F.col(name))
    has = {t: low.rlike(form) for t, form in FILE_NAMES.items()}
    has["discovery_request"] = has["discovery_request"] & ~has["discovery_response"]
    return _scores(rows, key, {t: F.when(h, 1.0) for t, h in has.items()} | {"exhibit": F.when(low.rlike(STAMPED_NAME), STAMPED_SCORE)})


def content_signal(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keywords found, over at least three or four tenths of the type's list, at most 1."""
    # once for all keywords; none goes over the end of a line, so a line that is repeated is looked into once
    rows = rows.select(key, F.array_join(F.array_distinct(F.split(F.upper("text"), "\n", -1)), "\n").alias("_up"))
    hits = lambda words: reduce(lambda a, b: a + b, (F.col("_up").contains(w).cast("int") for w in words))
    return _scores(rows, key, {t: F.least(F.lit(1.0), hits(words) / max(3.0, 0.4 * len(words))) for t, words in KEYWORDS.items()})


def line_counts(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pages, answers and the number of lines of each shape; mail headers count in the first lines only."""
    rows = rows.select(key, "n_pages", F.upper("text").alias("_up"), F.split("text", "\n", -1).alias("_lines"))
    lines = F.col("_lines")
    shaped = lambda p: lambda x: x.rlike(p)
    counted = {n: F.size(F.filter(F.slice(lines, 1, MAIL_LINES) if n == "mail_headers" else lines, shaped(p))) for n, p in LINE_SHAPES.items()}
    answers = reduce(lambda a, b: a | b, (F.col("_up").contains(a) for a in ANSWERS))
    return rows.select(key, F.greatest(F.col("n_pages"), F.lit(1)).alias("pages"), answers.alias("answers"), *[c.alias(n) for n, c in counted.items()])


def structural_signal(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Scores from the numbers of lines of certain shapes; the higher counts where two shapes speak for a type."""
    c = line_counts(rows, key)
    share = lambda column, over, most=1.0: F.least(F.lit(most), F.col(column) / over)
    dense = F.col("numbered_paragraphs") / F.col("pages")
    request = F.when(F.col("requests") >= 1, F.least(F.lit(1.0), F.col("requests") / 3))
    return _scores(c, key, {
        "deposition": F.greatest(F.when(F.col("turns") > 10, share("turns", 30)), F.when(F.col("margin_numbers") > 20, 0.7)),
        "hearing_transcript": F.when(F.col("turns") > 10, share("turns", 60, 0.5)),
        "expert_report": F.greatest(F.when(F.col("numbered_paragraphs") > 5, F.least(F.lit(1.0), dense / 3)), F.when(F.col("paragraph_signs") > 3, 0.5)),
        "declaration": F.when(F.col("numbered_paragraphs") > 5, F.least(F.lit(0.6), dense / 5)),
        "technical_standard": F.when(F.col("section_numbers") > 5, share("section_numbers", 15)),
        "agreement": F.when(F.col("section_numbers") > 5, share("section_numbers", 20, 0.5)),
        "correspondence": F.when(F.col("mail_headers") >= 3, 1.0),
        "sec_filing": F.when(F.col("items") >= 2, share("items", 4)),
        "discovery_response": F.when(F.col("answers"), request),
        "discovery_request": F.when(~F.col("answers"), request),
    })


def font_ratios(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, monospace, serif, sans, bold: shares of characters of spans (key, page_no, font, flags, text) on the first pages."""
    name, n = F.lower("font"), F.length("text")
    family = reduce(lambda acc, x: acc.when(name.rlike(x[1]), x[0]), FONTS.items(), F.when(F.lit(False), ""))
    bold = name.contains("bold") | (F.coalesce("flags", F.lit(0)).bitwiseAND(16) != 0)
    rows = spans.filter(F.col("page_no") <= FONT_PAGES).select(key, family.alias("family"), bold.alias("is_bold"), n.alias("n"))
    part = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0)) / F.sum("n")
    return rows.groupBy(key).agg(*[part(F.col("family") == f).alias(f) for f in FONTS], part(F.col("is_bold")).alias("bold"))


def font_signal(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mostly monospaced pages are transcripts."""
    mono = F.col("monospace")
    return _scores(font_ratios(spans, key), key, {"deposition": F.when(mono > 0.4, F.least(F.lit(1.0), mono)), "hearing_transcript": F.when(mono > 0.4, F.least(F.lit(0.5), mono * 0.6))})


#: Features of a fingerprint from text; those of fonts and columns come from spans and blocks.
TEXT_FEATURES = (
    "qa_line_density", "paragraph_marker_density", "section_number_density", "avg_line_length", "avg_chars_per_page", "has_margin_line_numbers", "has_email_headers",
    "has_court_caption", "has_qa_format", "has_perjury_language", "has_whereas_clauses", "has_patent_claims", "has_sec_items", "has_academic_structure",
)
LAYOUT_FEATURES = ("monospace_ratio", "serif_ratio", "sans_ratio", "bold_ratio", "has_two_columns")
MAIL_FINGERPRINT = r"^(From|To|Subject|Date)\s*:"


def two_columns(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, has_two_columns: whether the halves of the first page's block centres have medians a quarter of its width apart.

    blocks has (key, page_no, l, r, width); fewer than six blocks are one column.
    """
    centres = blocks.filter("page_no = 1").select(key, "width", ((F.col("l") + F.col("r")) / 2).alias("x"))
    ranked = centres.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("x"))).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy(key)))
    left = F.col("n") <= F.floor(F.col("all") / 2)
    halves = ranked.groupBy(key).agg(F.first("all").alias("all"), F.max("width").alias("width"), F.percentile(F.when(left, F.col("x")), F.lit(0.5)).alias("a"), F.percentile(F.when(~left, F.col("x")), F.lit(0.5)).alias("b"))
    return halves.select(key, F.coalesce((F.col("all") >= 6) & (F.col("b") - F.col("a") > F.col("width") * 0.25), F.lit(False)).alias("has_two_columns"))


def fingerprint(rows: DataFrame, spans: DataFrame | None = None, blocks: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """key and the nineteen features that profiles are learned from; without spans or blocks those are zero."""
    up, lines = F.upper("text"), F.split("text", "\n", -1)
    filled = F.filter(lines, lambda x: T.strip(x) != "")
    mean = F.when(F.size(filled) > 0, F.aggregate(F.transform(filled, F.length), F.lit(0), lambda a, b: a + b) / F.size(filled)).otherwise(0.0)
    mail = F.size(F.filter(F.slice(lines, 1, MAIL_LINES), lambda x: x.rlike(MAIL_FINGERPRINT))) >= 3
    has = {
        "has_court_caption": up.rlike(r"IN THE .{5,40} COURT"), "has_perjury_language": up.contains("UNDER PENALTY OF PERJURY"), "has_whereas_clauses": up.contains("WHEREAS") & up.contains("NOW THEREFORE"),
        "has_patent_claims": up.contains("UNITED STATES PATENT") | (up.contains("CLAIMS") & up.contains("ABSTRACT")), "has_sec_items": up.rlike(r"ITEM\s+\d+"),
        "has_academic_structure": up.contains("ABSTRACT") & up.contains("REFERENCES"), "has_email_headers": mail,
    }
    plain = rows.select(key, F.length("text").alias("_n"), mean.alias("avg_line_length"), *[c.alias(n) for n, c in has.items()])
    counts = line_counts(rows, key).join(plain, key)
    told = counts.select(
        key, (F.col("turns") / F.col("pages")).alias("qa_line_density"), (F.col("paragraph_signs") / F.col("pages")).alias("paragraph_marker_density"),
        (F.col("section_numbers") / F.col("pages")).alias("section_number_density"), "avg_line_length", (F.col("_n") / F.col("pages")).alias("avg_chars_per_page"),
        (F.col("margin_numbers") > 20).alias("has_margin_line_numbers"), (F.col("turns") > 10).alias("has_qa_format"), *has,
    )
    fonts = font_ratios(spans, key).select(key, *[F.col(f).alias(f"{f}_ratio") for f in ("monospace", "serif", "sans", "bold")]) if spans is not None else None
    for more in (fonts, two_columns(blocks, key) if blocks is not None else None):
        told = told if more is None else told.join(more, key, "left")
    return told.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in told.columns else F.lit(0.0).alias(c) for c in (*LAYOUT_FEATURES, *TEXT_FEATURES)])


def _long(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return rows.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])))


def profiles(features: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """label, feature, n, mean, m2 (sum of squared deviations) of each feature."""
    return _long(features, label, columns).groupBy(label, "feature").agg(
        F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.var_pop("value") * F.count("value"), 4).alias("m2")
    )


def merge_profiles(old: DataFrame, new: DataFrame, label: str) -> DataFrame:
    """Two sets of profiles as one: counts add up, means by count, squared deviations with what the means are apart."""
    both = old.unionByName(new)
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    apart = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.sum("n") * mean * mean
    return both.groupBy(label, "feature").agg(n.alias("n"), mean.alias("mean"), (F.sum("m2") + F.greatest(apart, F.lit(0.0))).alias("m2"))


def profile_scores(rows: DataFrame, key: str, columns: list[str], profiles: DataFrame, label: str) -> DataFrame:
    """key, label, score = 1 / (1 + d) against each profile; d is the root mean square of z-scores.

    profiles has (label, feature, n, mean, m2): a row per type and feature, joined by feature.
    """
    spread = F.greatest(F.sqrt(F.when(F.col("n") > 1, F.col("m2") / F.col("n")).otherwise(0.01)), F.lit(0.01))
    near = _long(rows, key, columns).join(profiles, "feature").withColumn("z", (F.col("value") - F.col("mean")) / spread)
    return near.groupBy(key, label).agg(F.round(1 / (1 + F.sqrt(F.avg(F.col("z") * F.col("z")))), 6).alias("score"))


def aggregate(rows: DataFrame, signals: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """key, doc_type, confidence, margin, needs_input, top_types from signals (key, doc_type, score) by name.

    Scores are weighted, summed by type and divided by all weights; profiles change the weights where
    there are any. The highest wins, ties to the smaller name. A deposition that neither name nor
    keywords speak for is unknown; so is a document without a score. Whether a person should look is
    told by the winner's score and its distance from the second, before that.
    """
    weights = LEARNED_WEIGHTS if "profile" in signals else WEIGHTS
    known = [s.filter(F.col("doc_type").isin(*model.DOCUMENT_TYPES)).select(key, "doc_type", F.lit(weights[n]).alias("w"), "score", F.lit(n).alias("signal")) for n, s in signals.items()]
    told = F.max(F.when(F.col("signal").isin("filename", "content"), F.col("score")))
    summed = reduce(DataFrame.unionByName, known).groupBy(key, "doc_type").agg((F.sum(F.col("score") * F.col("w")) / sum(weights.values())).alias("score"), told.alias("told"))
    order = F.struct((-F.round("score", 9)).alias("down"), F.col("doc_type").alias("doc_type"), F.col("score").alias("score"), F.coalesce("told", F.lit(0.0)).alias("told"))
    listed = summed.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("s"))
    first, second = F.get("s", F.lit(0)), F.coalesce(F.get("s", F.lit(1))["score"], F.lit(0.0))
    doc_type = F.when((first["doc_type"] == "deposition") & (first["told"] == 0), "unknown").when(first["score"] == 0, "unknown").otherwise(first["doc_type"])
    top = F.transform(F.slice("s", 1, 5), lambda x: F.struct(x["doc_type"].alias("doc_type"), F.round(x["score"], 3).alias("score")))
    won = listed.select(
        key, doc_type.alias("doc_type"), F.round(first["score"], 3).alias("confidence"), F.round(first["score"] - second, 6).alias("margin"),
        ((F.round(first["score"], 9) < LEAST_CONFIDENCE) | (F.round(first["score"] - second, 9) < LEAST_MARGIN)).alias("needs_input"), top.alias("top_types"),
    )
    return rows.select(key).join(won, key, "left").select(
        key, F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("margin", F.lit(0.0)).alias("margin"),
        F.coalesce("needs_input", F.lit(True)).alias("needs_input"), "top_types",
    )


def classify(rows: DataFrame, spans: DataFrame | None = None, blocks: DataFrame | None = None, learned: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """aggregate() of all signals of rows (key, file_name, text, n_pages); texts are of the first pages.

    learned: profiles (doc_type, feature, n, mean, m2). Null texts and names have no signals.
    """
    rows = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("file_name", F.coalesce("file_name", F.lit("")))
    signals = {"filename": filename_signal(rows, key), "content": content_signal(rows, key), "structural": structural_signal(rows, key)}
    if spans is not None:
        signals["font"] = font_signal(spans, key)
    if learned is not None:
        columns = [*LAYOUT_FEATURES, *TEXT_FEATURES]
        signals["profile"] = profile_scores(fingerprint(rows, spans, blocks, key), key, columns, learned, "doc_type")
    return aggregate(rows, signals, key)


def with_overrides(classified: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Types that a person has given (key, doc_type) in place of the found ones; those need no more input."""
    given = labels.filter("doc_type <> 'unknown'").select(key, F.col("doc_type").alias("given"))
    named = F.col("given").isNotNull()
    out = classified.join(given, key, "left").withColumn("doc_type", F.coalesce("given", "doc_type")).withColumn("needs_input", F.col("needs_input") & ~named)
    return out.drop("given")


def text_based(pages: DataFrame, key: str = "doc_id", sample: int = 5, least: int = 100) -> DataFrame:
    """key, is_text_based: whether the first pages (key, page_no, text) have more than ``least`` characters on average."""
    return pages.filter(F.col("page_no") <= sample).groupBy(key).agg((F.avg(F.length(F.coalesce("text", F.lit("")))) > least).alias("is_text_based"))


CONDENSED = r"\d+\s*\(\s*\d+\s+to\s+\d+\s*\)"


def condensed(names: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, is_condensed: transcripts with several pages on one, by their name or a heading such as '1 (1 to 4)' on the first three pages."""
    headed = pages.filter("page_no <= 3").groupBy(key).agg(F.bool_or(F.col("text").rlike(CONDENSED)).alias("headed"))
    return names.join(headed, key, "left").select(key, (F.lower("file_name").contains("condensed") | F.coalesce("headed", F.lit(False))).alias("is_condensed"))

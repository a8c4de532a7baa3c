"""Production load files: delimited records, image page lists, pages of texts, and what is ingested of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry import model
from docketry.functions import text as T
from docketry.sources.files import plain_path

FIELD, QUALIFIER, BYTE_ORDER_MARK = "\x14", "þ", "﻿"
#: Names that vendors give a field, by the canonical one; the first that a header has counts. Fixed values.
ALIASES = {
    "beg_bates": ["PRODBEG", "BEGDOC", "BEGBATES", "BATES BEG"],
    "end_bates": ["PRODEND", "ENDDOC", "ENDBATES", "BATES END"],
    "beg_attach": ["PRODBEGATT", "BEGATTACH", "BEGATT"],
    "end_attach": ["PRODENDATT", "ENDATTACH", "ENDATT"],
    "custodian": ["CUSTODIAN"],
    "native_path": ["NATIVEFILE", "NATIVELINK", "NATIVEPATH"],
    "file_desc": ["FILEDESC", "RECORD TYPE", "RECORDTYPE"],
    "folder": ["FOLDER", "FILE_PATH", "FILEPATH"],
    "file_name": ["FILENAME"],
    "doc_ext": ["DOCEXT", "FILE EXTENSION", "FILEEXT"],
    "pages": ["PAGES", "PGCOUNT", "PAGECOUNT", "PAGE COUNT"],
    "author": ["AUTHOR"],
    "date_created": ["DATECREATED", "DATETIMECREATED"],
    "date_last_mod": ["DATELASTMOD", "DATE TIME MOD"],
    "subject": ["SUBJECT"],
    "from_field": ["FROM"],
    "to_field": ["TO"],
    "cc": ["CC"],
    "bcc": ["BCC"],
    "date_sent": ["DATESENT", "DATETIMESENT"],
    "date_rcvd": ["DATERCVD", "DATETIMERCVD"],
    "confidentiality": ["CONFIDENTIALITY"],
    "text_path": ["TEXTPATH", "TEXTFILE", "TEXTLINK", "OCRPATH", "FULLTEXT"],
    "prod_vol": ["PRODVOL", "VOLUME", "SOURCE ID (BOX #)"],
}
#: Extensions of native files that have text to extract; fixed values.
PARSEABLE = ("docx", "doc", "xlsx", "xls", "pptx", "ppt", "msg", "eml", "txt", "md", "rtf", "html", "htm", "csv", "tsv", "json", "xml")
LEAST_TEXT_BYTES = 15
#: Lines of a heading and the field of each, in order.
HEADING = {"Original filename": "file_name", "Custodian": "custodian", "Date": "date", "From": "from_field", "To": "to_field", "Cc": "cc", "Subject": "subject", "Confidentiality": "confidentiality"}
ROUTES = ("single", "vendor-ff", "aligned", "unpaged-mismatch", "unpaged-no-ocr", "n/a")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of whole text files below a folder, without byte order marks."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select(plain_path(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))).alias("path"), F.regexp_replace("value", f"^{BYTE_ORDER_MARK}", "").alias("content"))


def rows_of(files: DataFrame) -> DataFrame:
    """production, line_no (from 0), line of load files (production, content)."""
    split = F.split(F.regexp_replace("content", f"^{BYTE_ORDER_MARK}", ""), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]", -1)
    return files.select("production", F.posexplode(split).alias("pos", "line")).select("production", F.col("pos").cast("long").alias("line_no"), "line")


def parse_records(lines: DataFrame) -> DataFrame:
    """production, line_no and all canonical fields of lines (production, line_no, line).

    A production's first line names its fields, in capitals or not; text marks are taken off the ends
    of a cell, and stay inside. A short row has empty fields at its end; blank rows are skipped.
    """
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, f"^{QUALIFIER}+", ""), f"{QUALIFIER}+$", "")
    cells = lines.withColumn("cells", F.split("line", FIELD, -1))
    head = cells.filter("line_no = 0").select("production", F.transform("cells", lambda c: F.upper(T.strip(bare(c)))).alias("header"))
    rows = cells.filter((F.col("line_no") > 0) & (T.strip(F.col("line")) != "")).join(F.broadcast(head), "production")  # a row a production
    out = []
    for name, aliases in ALIASES.items():
        # a name that a header repeats is its last column
        found = [F.nullif(F.size("header") - F.array_position(F.reverse("header"), a) + 1, F.size("header") + 1) for a in aliases]
        at = F.coalesce(*found).cast("int")
        out.append(F.coalesce(bare(F.get("cells", at - 1)), F.lit("")).alias(name))
    return rows.select("production", "line_no", *out)


def parse_pages(lines: DataFrame) -> DataFrame:
    """production, line_no, bates, path, doc_break of image lists (production, line_no, line); rows of less than four fields are skipped."""
    parts = F.split(F.regexp_replace("line", f"^{BYTE_ORDER_MARK}", ""), ",", -1)
    rows = lines.filter(T.strip(F.col("line")) != "").select("production", "line_no", parts.alias("p")).filter("size(p) >= 4")
    return rows.select("production", "line_no", T.strip(F.col("p")[0]).alias("bates"), T.strip(F.col("p")[2]).alias("path"), F.upper(T.strip(F.col("p")[3])).alias("doc_break"))


#: Lines of a production whose document breaks are counted together.
RANGE_LINES = 1 << 16


def group_pages(pages: DataFrame) -> DataFrame:
    """production, doc, beg_bates, images: a row with doc_break Y opens a document, rows before the first are dropped.

    Breaks are counted within ranges of lines, and ranges by their totals, so that a large production
    is spread over tasks.
    """
    numbered = pages.withColumn("range", F.floor(F.col("line_no") / RANGE_LINES)).withColumn("opens", (F.col("doc_break") == "Y").cast("int"))
    totals = numbered.groupBy("production", "range").agg(F.sum("opens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("production").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("opens").over(Window.partitionBy("production", "range").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    joined = numbered.withColumn("inside", inside).join(totals.select("production", "range", before.alias("before")), ["production", "range"])
    placed = joined.withColumn("doc", F.col("before") + F.col("inside")).filter("doc > 0")
    grouped = placed.groupBy("production", "doc").agg(F.array_sort(F.collect_list(F.struct("line_no", "bates", "path"))).alias("rows"))
    return grouped.select("production", "doc", F.col("rows")[0]["bates"].alias("beg_bates"), F.col("rows.path").alias("images"))


def latest_pages(grouped: DataFrame) -> DataFrame:
    """Of documents with one begin stamp the last: a repeated stamp starts its list anew."""
    return grouped.groupBy("production", "beg_bates").agg(F.max_by("images", "doc").alias("images"))


def page_stamps(beg: str, end: str, n: str) -> Column:
    """Stamps of n pages: each its own if the range has as many, else the first for all."""
    first, last = T.bates_parts(F.col(beg)), T.bates_parts(F.col(end))
    fits = (first["prefix"] == last["prefix"]) & (last["number"] - first["number"] + 1 == F.col(n))
    own = F.transform(F.sequence(F.lit(0), F.col(n) - 1), lambda i: F.concat(first["prefix"], T.pad_number(first["number"] + i, first["width"])))
    return F.when(F.coalesce(fits, F.lit(False)), own).otherwise(F.array_repeat(F.col(beg), F.col(n)))


def usable(text: Column) -> Column:
    """Whether a text has LEAST_TEXT_BYTES bytes that are no white space."""
    return F.coalesce(F.octet_length(F.regexp_replace(text, "[ \t\r\n]", "")) >= LEAST_TEXT_BYTES, F.lit(False))


def posix(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def resolve(records: DataFrame, column: str, files: DataFrame, out: str) -> DataFrame:
    """records with ``out``: the file (root, path) that a relative path names; below its root, above it, or in a folder in it of its name.

    records has root, the folder of the production; files has path, one row a file. The first base that has the file counts.
    """
    root, name = F.regexp_replace("root", "/+$", ""), F.regexp_extract(F.regexp_replace("root", "/+$", ""), r"([^/]*)$", 1)
    bases = F.array(root, F.regexp_replace(root, "/[^/]*$", ""), F.concat_ws("/", root, name))
    tried = records.withColumn("_n", F.monotonically_increasing_id()).select("*", F.posexplode_outer(F.when(F.coalesce(F.col(column), F.lit("")) != "", F.transform(bases, lambda b: F.concat_ws("/", b, posix(F.col(column)))))).alias("_order", "_path"))
    known = files.select(F.col("path").alias("_path"), F.lit(True).alias("_there")).distinct()
    met = tried.join(known, "_path", "left")
    best = met.groupBy("_n").agg(F.min_by("_path", F.when(F.col("_there"), F.col("_order"))).alias(out), *[F.first(c).alias(c) for c in records.columns])
    return best.drop("_n")


def paginate(docs: DataFrame, aligned: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, content, n_pages, n_images) with text, route, flagged, reason: how a text gets its pages.

    One page takes no breaks; as many form feeds as pages are the pages, blank ones at the end aside;
    other numbers of form feeds cannot be trusted, and texts without any are cut where aligned
    (doc_id, starts array<int>, flagged, reason) says. What cannot be cut safely stays whole and is flagged.
    """
    segments = F.split("content", "\f", -1)
    filled = F.coalesce(F.array_max(F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda i: F.when(T.strip(F.get(segments, i)) != "", i + 1))), F.lit(0))
    kept = F.slice(segments, 1, F.greatest(filled, F.least(F.size(segments), F.col("n_pages"))))
    joined = docs if aligned is None else docs.join(aligned.select("doc_id", "starts", F.col("flagged").alias("unsure"), F.col("reason").alias("why")), "doc_id", "left")
    if aligned is None:
        joined = docs.withColumns({"starts": F.lit(None).cast("array<int>"), "unsure": F.lit(None).cast("boolean"), "why": F.lit(None).cast("string")})
    route = (
        F.when(F.col("n_pages") <= 1, "single").when(F.size(kept) == F.col("n_pages"), "vendor-ff").when(F.size(kept) > 1, "unpaged-mismatch")
        .when((F.col("n_images") == F.col("n_pages")) & F.col("starts").isNotNull(), "aligned").otherwise("unpaged-no-ocr")
    )
    joined = joined.withColumn("route", route).withColumn("n_segments", F.size(kept))
    ends = F.concat(F.col("starts"), F.array(F.length("content")))
    cut = F.array_join(F.transform(F.concat(F.array(F.lit(0)), F.col("starts")), lambda s, i: F.substring("content", s + 1, F.get(ends, i) - s)), "\f")
    flat = F.translate("content", "\f", "\n")
    text = F.when(F.col("route") == "vendor-ff", F.array_join(kept, "\f")).when(F.col("route") == "aligned", cut).when(F.col("route") == "unpaged-no-ocr", F.col("content")).otherwise(flat)
    reason = (
        F.when(F.col("route") == "unpaged-mismatch", F.format_string("the text has %d form-feed pages, the document %d", "n_segments", "n_pages"))
        .when(F.col("route") == "unpaged-no-ocr", "no image of each page to align with").when(F.col("route") == "aligned", F.coalesce("why", F.lit(""))).otherwise("")
    )
    flagged = F.col("route").isin("unpaged-mismatch", "unpaged-no-ocr") | ((F.col("route") == "aligned") & F.coalesce("unsure", F.lit(False)))
    return joined.select(*docs.columns, text.alias("text"), "route", flagged.alias("flagged"), reason.alias("reason"))


def heading() -> Column:
    """The lines that stand above a record's text: title, stamps, and a line for each field that has a value."""
    date = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("date_sent", "date_created", "date_last_mod")])
    value = lambda c: date if c == "date" else F.nullif(F.col(c), F.lit(""))
    lines = [F.when(value(c).isNotNull(), F.concat(F.lit(f"**{label}:** "), value(c))) for label, c in HEADING.items()]
    title = F.concat(F.lit("# "), "beg_bates", F.lit("\n\n**Bates range:** "), "beg_bates", F.lit(" – "), "end_bates")
    return F.concat_ws("\n", title, *lines)


def marked_texts(paged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, md), citations of records with pages (doc_id, record fields, text): a mark and a citation for each paragraph.

    Paragraphs are numbered through the document; each is cited by its page and that page's stamp.
    """
    rows = paged.withColumn("segments", F.split("text", "\f", -1)).withColumn("n", F.size("segments"))
    rows = rows.withColumn("last", F.coalesce(F.nullif("end_bates", F.lit("")), "beg_bates")).withColumn("stamps", page_stamps("beg_bates", "last", "n"))
    parts = lambda s: F.filter(F.transform(F.split(F.regexp_replace(s, r"(\r?\n){2,}", "\n\n"), "\n\n"), T.strip), lambda x: x != "")
    flat = F.flatten(F.transform("segments", lambda s, i: F.transform(parts(s), lambda p: F.struct((i + 1).cast("int").alias("page"), F.get("stamps", i).alias("bates"), p.alias("text")))))
    rows = rows.withColumn("paragraphs", flat)
    body = F.array_join(F.transform("paragraphs", lambda p, i: F.concat(F.lit("[TEXT:"), i.cast("string"), F.lit("]\n\n"), p["text"], F.lit("\n"))), "\n")
    md = rows.select("doc_id", F.concat(heading(), F.lit("\n\n---\n\n"), body).alias("md"))
    cited = rows.select("doc_id", F.posexplode("paragraphs").alias("ord", "p"))
    have = {"doc_id": F.col("doc_id"), "ord": F.col("ord"), "ref": F.format_string("#/texts/%d", "ord"), "page": F.col("p.page"), "bates": F.col("p.bates"), "type": F.lit("page_only")}
    kinds = dict(c.split() for c in model.CITATIONS.split(", "))
    return md, cited.select(*[have.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def ingest(records: DataFrame, texts: DataFrame, images: DataFrame, natives: DataFrame | None = None, aligned: DataFrame | None = None, pagination: bool = True) -> dict[str, DataFrame]:
    """What becomes of a production's records: documents, citations, manifest, flagged_content, flagged_pages, stats.

    records: parse_records() with doc_id. texts: (doc_id, content) of the vendor's text files; natives
    the same of converted native files, for records without usable text whose extension is parseable.
    images: (production, beg_bates, images) as of latest_pages(). Pages are only sought in vendor
    texts. A page count that is no number is one.
    """
    given = texts.select("doc_id", F.col("content").alias("vendor"))
    native = (natives if natives is not None else records.sparkSession.createDataFrame([], "doc_id long, content string")).select("doc_id", F.col("content").alias("native"))
    ext = F.lower(F.coalesce(F.nullif("doc_ext", F.lit("")), F.regexp_extract("native_path", r"\.([^./\\]*)$", 1)))
    rows = records.join(given, "doc_id", "left").join(native, "doc_id", "left").join(images.select("production", "beg_bates", F.size("images").alias("n_images")), ["production", "beg_bates"], "left")
    source = F.when(usable(F.col("vendor")), "text").when(F.col("native").isNotNull() & (F.col("native_path") != "") & ext.isin(*PARSEABLE), "native")
    rows = rows.withColumn("source_route", source).withColumn("content", F.when(F.col("source_route") == "text", F.col("vendor")).otherwise(F.col("native")))
    rows = rows.withColumn("n_pages", F.coalesce(T.strip(F.coalesce(F.nullif("pages", F.lit("")), F.lit("1"))).try_cast("int"), F.lit(1))).drop("vendor", "native")
    kept = rows.filter("source_route IS NOT NULL")
    cut = paginate(kept, aligned)
    whole = (F.col("source_route") == "native") | F.lit(not pagination)
    cut = cut.withColumns({"text": F.when(whole, F.col("content")).otherwise(F.col("text")), "route": F.when(whole, "n/a").otherwise(F.col("route")), "flagged": F.col("flagged") & ~whole})
    md, citations = marked_texts(cut)
    ranges = [F.array("beg_bates", "end_bates").alias("bates_range"), F.array("beg_attach", "end_attach").alias("attach_range")]
    manifest = cut.select(
        "doc_id", F.col("beg_bates").alias("bates"), *ranges, "custodian", "file_name", "doc_ext", "pages", "author", "date_sent", "date_created", "date_last_mod", "subject", F.col("from_field").alias("from"),
        F.col("to_field").alias("to"), "cc", "confidentiality", F.col("prod_vol").alias("production"), F.col("source_route").alias("route"), F.col("route").alias("pagination"), F.col("flagged").alias("pagination_flagged"),
    )
    no_content = rows.filter("source_route IS NULL").select(F.col("beg_bates").alias("bates"), "file_name", "doc_ext", "text_path", "native_path", F.lit("neither usable text nor a native file with text").alias("reason"))
    unsure = cut.filter("flagged").select(F.col("beg_bates").alias("bates"), ranges[0], "file_name", F.col("n_pages").alias("pages"), "route", "reason")
    counts = [F.count_if(F.col("pagination") == r).alias(r.replace("-", "_").replace("/", "")) for r in ROUTES]
    told = manifest.join(records.select("doc_id", F.col("production").alias("name")), "doc_id").groupBy("name").agg(
        F.count_if(F.col("route") == "text").alias("text_route"), F.count_if(F.col("route") == "native").alias("native_route"), *counts, F.count_if("pagination_flagged").alias("pagination_flagged"),
    )
    totals = records.groupBy(F.col("production").alias("name")).agg(F.count(F.lit(1)).alias("total_records"))
    stats = totals.join(told, "name", "left").na.fill(0).withColumn("skipped_no_content", F.col("total_records") - F.col("text_route") - F.col("native_route")).withColumnRenamed("name", "production")
    stem = cut.select("doc_id", F.lower("beg_bates").alias("stem"), F.lit("exhibit").alias("doc_type"), F.coalesce(F.nullif("file_name", F.lit("")), "beg_bates").alias("file_name"), F.concat(F.lower("beg_bates"), F.lit(".md")).alias("source_path"))
    return {"documents": md.join(stem, "doc_id"), "citations": citations, "manifest": manifest, "flagged_content": no_content, "flagged_pages": unsure, "stats": stats}


def productions(files: DataFrame, root: str) -> DataFrame:
    """dat, name, folder: load files of a delivery (path of each file), one for each name, and where their documents lie.

    Those in the root come before those in 'load files' and in folders one level down. Documents lie
    in the folder of the load file's name, or in the root.
    """
    below = F.substring(F.col("path"), F.length(F.lit(root.rstrip("/"))) + 2, F.length("path"))
    rows = files.filter(F.startswith("path", F.lit(root.rstrip("/") + "/"))).select("path", below.alias("below"))
    folders = rows.filter(F.col("below").contains("/")).select(F.split("below", "/")[0].alias("folder")).distinct()
    depth = F.size(F.split("below", "/"))
    place = F.when(depth == 1, 0).when(F.startswith("below", F.lit("load files/")), 1).otherwise(2)
    dats = rows.filter((depth <= 2) & F.col("below").rlike(r"\.dat$")).select("path", place.alias("place"), F.regexp_extract("below", r"([^/]*)\.dat$", 1).alias("name"))
    first = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("place", "path"))
    best = dats.withColumn("_n", first).filter("_n = 1")
    own = best.join(folders, best.name == folders.folder, "left")
    return own.select(F.col("path").alias("dat"), "name", F.when(F.col("folder").isNotNull(), F.concat_ws("/", F.lit(root.rstrip("/")), "folder")).otherwise(root.rstrip("/")).alias("folder"))


def named_dat(files: DataFrame, production: str) -> DataFrame:
    """The load file (path) of one production folder: in it, in 'load files' of it or of its parent, or in its parent; of its name first."""
    root = production.rstrip("/")
    parent, name = root.rsplit("/", 1)
    bases = [root, f"{root}/load files", f"{parent}/load files", parent]
    folder = F.regexp_replace("path", "/[^/]*$", "")
    order = reduce(lambda acc, x: acc.when(folder == x[1], x[0]), enumerate(bases), F.when(F.lit(False), 0))
    found = files.filter(F.col("path").rlike(r"\.dat$")).withColumn("_at", order).filter("_at IS NOT NULL")
    other = (F.lower(F.regexp_extract("path", r"([^/]*)\.dat$", 1)) != name.lower()).cast("int")
    return found.orderBy(other, "_at", "path").limit(1).select("path")

"""Document types, their families, and the schemas of tables that operators pass on."""

from __future__ import annotations

#: Document types; fixed values.
DOCUMENT_TYPES = (
    "deposition", "patent", "expert_report", "pleading", "exhibit", "unknown", "hearing_transcript", "declaration", "motion", "brief", "patent_prosecution",
    "agreement", "correspondence", "technical_standard", "scholarly", "sec_filing", "witness_statement", "discovery_response", "discovery_request",
)
#: Types that are cited and cut alike; all others are cited by page.
TRANSCRIPTS = ("deposition", "hearing_transcript")
PARAGRAPHS = ("expert_report", "pleading", "declaration", "motion", "brief", "witness_statement", "agreement")
PATENTS = ("patent",)
DISCOVERY = ("discovery_response", "discovery_request")
FAMILIES = {"transcript": TRANSCRIPTS, "paragraph": PARAGRAPHS, "patent": PATENTS, "discovery": DISCOVERY}

ELEMENTS = "doc_id long, ord long, self_ref string, label string, text string, page_no int, l double, t double, r double, b double"
PAGE_SIZES = "doc_id long, page_no int, width double, height double"
STAMPS = "doc_id long, page_no int, bates string"
CITATIONS = (
    "doc_id long, ord long, ref string, page int, line_start int, line_end int, bates string, column int, paragraph_number long, type string, "
    "transcript_page int, discovery_request_kind string, discovery_request_number long"
)
CHUNK_CITATION = (
    "struct<pdf_pages:array<int>,bates_range:array<string>,page_map:array<int>,page_spans:array<struct<page:int,line_start:int,line_end:int>>,bates_map:array<string>,"
    "transcript_lines:map<string,array<int>>,transcript_pages:array<int>,paragraph_numbers:array<bigint>,column_lines:struct<columns:array<int>>,"
    "discovery_request_kind:string,discovery_request_number:bigint,discovery_part:int,discovery_part_total:int>"
)
CHUNKS = (
    f"doc_id long, stem string, chunk_idx int, chunk_id string, core_text string, pages array<int>, citation {CHUNK_CITATION}, citation_string string, "
    "key_quotes array<string>, tokens int, doc_type string, summary string, category string, relevance_score string, claims_addressed array<int>, "
    "classification_method string, llm_backend string, source_path string"
)
INDEX_STATE = "filename string, file_path string, stem string, content_hash string, chunk_count long, index_types array<string>, last_indexed timestamp"
DOCUMENT_STATE = (
    "stem string, filename string, status string, stages array<string>, retry_count int, error string, source_path string, content_hash string, "
    "started_at timestamp, completed_at timestamp"
)
RESULTS = (
    "file string, stem string, status string, doc_type string, classification_confidence double, extraction_method string, citations_count long, coverage_pct double, "
    "type_distribution map<string,bigint>, bates_gaps array<string>, chunks_count long, elapsed_seconds double, had_json boolean, citation_degraded boolean, error string"
)


def family(doc_type: str) -> str:
    """transcript, paragraph, patent, discovery or generic."""
    return next((name for name, types in FAMILIES.items() if doc_type in types), "generic")

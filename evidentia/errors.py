"""Failures as values: codes with a fixed message, and the exit status the command line gives them."""

from __future__ import annotations


class EvidenceError(Exception):
    """A refused request or operation; ``status`` is 2 for what the caller gave, 1 for what failed under way."""

    def __init__(self, code: str, message: str, status: int = 2):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.status = code, message, status


#: Codes and messages of collection errors (a document with one has no items).
COLLECTION = {
    "DOCUMENT_NOT_ZIP": "Document is not a supported readable ZIP archive.",
    "HWPX_MIMETYPE_INVALID": "HWPX mimetype is missing or invalid.",
    "HWPX_SECTION_MISSING": "HWPX contains no section XML.",
    "HWPX_XML_INVALID": "HWPX section XML is invalid.",
    "HWPX_LIMIT_EXCEEDED": "HWPX archive exceeds a safety limit.",
    "SOURCE_CHANGED_DURING_SCAN": "Source changed during scan.",
    "REFERENCE_LIMIT_EXCEEDED": "Reference extraction exceeds a safety limit.",
}
#: Two refusals that share a code with others but tell more.
LAYOUT_AMBIGUOUS = "HWPX section layout is ambiguous."
ARCHIVE_UNREADABLE = "Document is not a readable ZIP archive."
STAGE_OF = {"REFERENCE_LIMIT_EXCEEDED": "extract"}
#: Refusals that several places make, as code and message.
JSON_INVALID = ("REVIEW_JSON_INVALID", "Review JSON is not valid bounded JSON.")
LEDGER_INVALID = ("REVIEW_LEDGER_INVALID", "Review ledger is invalid or does not match the report.")
OUTPUT_EXISTS = ("REVIEW_OUTPUT_EXISTS", "Output exists.")
CONFLICT = ("REVIEW_CONFLICT", "Review ledger changed during update.")
CATALOG_NOT_FOUND = ("CATALOG_NOT_FOUND", "Catalog was not found.")

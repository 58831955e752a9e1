"""Domains and schemas of documents, units and results."""

from __future__ import annotations

from pyspark.sql import types as T

# Domains of the document and unit columns.
DOC_FORMS = ("UU", "PP", "PERPU", "PERPRES", "POJK", "PERMEN", "PERDA", "SE", "LAINNYA")
DOC_STATUSES = ("Berlaku", "Tidak Berlaku")
UNIT_TYPES = ("DOKUMEN", "BUKU", "BAB", "BAGIAN", "PARAGRAF", "PASAL", "ANGKA_AMANDEMENT", "AYAT", "HURUF", "ANGKA")
LEAF_TYPES = ("AYAT", "HURUF", "ANGKA")

_text = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PATH = T.ArrayType(_struct(type=_text, label=_text, unit_id=_text))
REFERENCE = _struct(regulation_reference=_text, reference_link=_text)
DECISION = _struct(
    decision_number=_text, pdf_url=_text, decision_content=_text, provision_references=T.ArrayType(_text), decision_summary=_text,
    decision_type=_text, legal_basis=_text, binding_status=_text, conditions=_text, interpretation=_text,
)
DOCUMENT_JSON = T.StructType(
    [T.StructField(c, _text) for c in (
        "doc_id", "doc_source", "doc_type", "doc_title", "doc_form", "doc_form_short", "doc_number", "doc_year", "doc_status", "doc_teu", "doc_place_enacted",
        "doc_language", "doc_location", "doc_field", "doc_date_enacted", "doc_date_promulgated", "doc_date_effective",
    )]
    + [
        T.StructField("doc_subject", T.ArrayType(_text)),
        T.StructField("relationships", T.MapType(_text, T.ArrayType(REFERENCE))),
        T.StructField("uji_materi", T.ArrayType(DECISION)),
    ]
    + [T.StructField(c, _text) for c in ("detail_url", "source_url", "pdf_url", "uji_materi_pdf_url", "pdf_path", "text_path", "doc_content", "doc_processing_status", "document_tree", "last_updated")]
)

"""Named queries of the llm operators, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm.canonical import map_to_list, match_report
from statuta.llm.chunks import oversized, pieces
from statuta.llm.mixing import mix, mix_report
from statuta.llm.packing import pack, pack_report
from statuta.llm.personal import masked, personal_information
from statuta.llm.residue import residue, validate
from statuta.llm.scans import all_lines, broken_compounds, furniture_of, odd_forms, repaired, scan_defects, typed_forms
from statuta.session import load


def _scanned(spark: SparkSession, d: str) -> list[tuple[DataFrame, str, str, str]]:
    return [
        (load(spark, d, "extraction_results"), "extraction_id", "text", "extraction_results"),
        (load(spark, d, "legal_units"), "unit_row_id", "local_content", "legal_units"),
    ]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_defects(_scanned(spark, d))


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """All texts of extraction results as continuous paragraphs, with the vocabulary of both tables."""
    results, units = _scanned(spark, d)
    furniture = furniture_of([results, units])
    forms = typed_forms(all_lines([results, units], furniture))
    odd, compounds = odd_forms(forms), broken_compounds(forms)
    return repaired(*results, odd, compounds, furniture).unionByName(repaired(*units, odd, compounds, furniture))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return residue(load(spark, d, "legal_documents")).select("doc_row_id", "field_name")


def p2_validation(spark: SparkSession, d: str) -> DataFrame:
    return validate(load(spark, d, "legal_documents"))


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return map_to_list(load(spark, d, "relationship_refs"), load(spark, d, "regulation_catalog"), other_titles=load(spark, d, "legal_documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("ref_id", "doc_id")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return match_report(_mapped(spark, d))


_LONG = ("unit_row_id", ["content", "bm25_body"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized(load(spark, d, "legal_units"), *_LONG)


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces(load(spark, d, "legal_units"), *_LONG)


def p5_cover(spark: SparkSession, d: str) -> DataFrame:
    """Per value: the characters of its pieces without the overlaps, and whether any piece is too long."""
    cut = pieces(load(spark, d, "legal_units"), *_LONG)
    own = F.length("piece") - F.when(F.col("piece_no") > 0, 100).otherwise(0)
    return cut.groupBy("unit_row_id", "field_name").agg(F.sum(own).alias("n_chars"), F.max(F.length("piece") > 1500).alias("too_long"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(load(spark, d, "documents"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return pack_report(pack(load(spark, d, "documents")))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    targets = load(spark, d, "mix_targets")
    return mix_report(mix(load(spark, d, "documents"), targets), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_information(load(spark, d, "documents")).select("doc_id", "kind", "start_pos")


def p9_masked(spark: SparkSession, d: str) -> DataFrame:
    return masked(load(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_validation, p3_found, p3_report, p5_found, p5_pieces, p5_cover, p7_packed, p7_report, p8_mix, p8_report, p9_found, p9_masked)}
_VALUES = "SELECT unit_row_id, 'content' AS field_name, content AS v FROM legal_units UNION ALL SELECT unit_row_id, 'bm25_body', bm25_body FROM legal_units"
ORACLES: dict[str, str] = {
    "p5_found": f"SELECT unit_row_id, field_name FROM ({_VALUES}) WHERE length(v) > 1500",
    "p5_cover": f"SELECT unit_row_id, field_name, CAST(length(v) AS BIGINT) AS n_chars, false AS too_long FROM ({_VALUES}) WHERE v IS NOT NULL",
}


def collect() -> tuple[dict, dict]:
    return QUERIES, ORACLES

"""Queries over nested crawl records and over references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators.nested import child_links, decisions, map_items, nested_items, tree_nodes
from statuta.operators.orphans import orphan_references, orphan_report
from statuta.session import load


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return child_links(load(spark, d, "crawl_records"))


def p4_nodes(spark: SparkSession, d: str) -> DataFrame:
    return tree_nodes(load(spark, d, "crawl_records")).select("record_id", "parent_key", "child_key", "depth", "type", "unit_id", "number_label")


def p4_references(spark: SparkSession, d: str) -> DataFrame:
    return map_items(load(spark, d, "crawl_records"))


def p4_provisions(spark: SparkSession, d: str) -> DataFrame:
    return nested_items(load(spark, d, "crawl_records")).withColumnRenamed("item", "provision_reference")


def p4_decisions(spark: SparkSession, d: str) -> DataFrame:
    return decisions(load(spark, d, "crawl_records")).select("record_id", "decision_key", "decision_number", "decision_type", "binding_status", "n_provisions")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(load(spark, d, "relationship_refs"), load(spark, d, "legal_documents"), load(spark, d, "regulation_catalog"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d)).orderBy("target_table", "month", "reason")


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    """Of all orphans of the whole check, those that carry a details link, which plain SQL can find too."""
    linked = load(spark, d, "relationship_refs").where(F.lower("reference_link").rlike(r"details/\d")).select("ref_id")
    return _orphans(spark, d).join(linked, "ref_id", "left_semi").select("ref_id", "doc_id", "reason")


QUERIES = {f.__name__: f for f in (p4_found, p4_nodes, p4_references, p4_provisions, p4_decisions, p6_found, p6_report, p6_links)}

_TREE = """
WITH RECURSIVE roots AS (
  SELECT record_id, CAST(document_tree AS JSON) AS node FROM crawl_records
  WHERE document_tree IS NOT NULL AND json_valid(document_tree)
), tree AS (
  SELECT record_id, CAST(NULL AS VARCHAR) AS parent_key, 'r' AS child_key, 0 AS depth, node FROM roots
  UNION ALL
  SELECT s.record_id, s.child_key, s.child_key || '.' || CAST(s.i - 1 AS VARCHAR), s.depth + 1, s.kids[s.i]
  FROM (
    SELECT record_id, child_key, depth, kids, unnest(range(1, len(kids) + 1)) AS i
    FROM (
      SELECT record_id, child_key, depth,
        CASE json_type(c) WHEN 'ARRAY' THEN CAST(c AS JSON[]) WHEN 'OBJECT' THEN [c] ELSE CAST([] AS JSON[]) END AS kids
      FROM (
        SELECT record_id, child_key, depth,
          CASE WHEN json_type(raw) = 'VARCHAR' AND json_valid(raw ->> '$') THEN CAST(raw ->> '$' AS JSON) ELSE raw END AS c
        FROM (SELECT record_id, child_key, depth, json_extract(node, '$.children') AS raw FROM tree)
      )
    )
  ) s
  WHERE s.kids[s.i] IS NOT NULL AND json_type(s.kids[s.i]) <> 'NULL'
)"""
_REFERENCES = """
SELECT record_id, e.key AS parent_key, e.key || '.' || CAST(i - 1 AS VARCHAR) AS child_key, e.value[i] AS item
FROM (
  SELECT record_id, e, unnest(range(1, len(e.value) + 1)) AS i
  FROM (SELECT record_id, unnest(map_entries(relationships)) AS e FROM crawl_records)
) WHERE e.value[i] IS NOT NULL"""
_DECISIONS = "SELECT record_id, uji_materi, unnest(range(1, len(uji_materi) + 1)) AS i FROM crawl_records"
_PROVISIONS = f"""
SELECT record_id, CAST(i - 1 AS VARCHAR) AS parent_key, CAST(i - 1 AS VARCHAR) || '.' || CAST(j - 1 AS VARCHAR) AS child_key,
  uji_materi[i].decision_number AS decision_number, uji_materi[i].provision_references[j] AS provision_reference
FROM (
  SELECT record_id, uji_materi, i, unnest(range(1, len(uji_materi[i].provision_references) + 1)) AS j FROM ({_DECISIONS})
) WHERE uji_materi[i].provision_references[j] IS NOT NULL"""

ORACLES = {
    "p4_found": f"""{_TREE}
SELECT record_id, 'node' AS entity, parent_key, child_key FROM tree WHERE depth > 0
UNION ALL SELECT record_id, 'reference', parent_key, child_key FROM ({_REFERENCES})
UNION ALL SELECT record_id, 'provision', parent_key, child_key FROM ({_PROVISIONS})""",
    "p4_nodes": f"""{_TREE}
SELECT record_id, parent_key, child_key, CAST(depth AS INTEGER) AS depth, node ->> '$.type' AS "type", node ->> '$.unit_id' AS unit_id,
  node ->> '$.number_label' AS number_label FROM tree WHERE depth > 0""",
    "p4_references": f"SELECT record_id, parent_key, child_key, item.regulation_reference AS regulation_reference, item.reference_link AS reference_link FROM ({_REFERENCES})",
    "p4_provisions": _PROVISIONS,
    "p4_decisions": f"""
SELECT record_id, CAST(i - 1 AS VARCHAR) AS decision_key, uji_materi[i].decision_number AS decision_number, uji_materi[i].decision_type AS decision_type,
  uji_materi[i].binding_status AS binding_status, CAST(coalesce(len(uji_materi[i].provision_references), 0) AS INTEGER) AS n_provisions
FROM ({_DECISIONS}) WHERE uji_materi[i] IS NOT NULL""",
    "p6_links": r"""
WITH docs AS (
  SELECT doc_id, bool_or(deleted_at IS NULL) AS alive, min(ingested_at) AS first_in FROM legal_documents WHERE doc_id IS NOT NULL GROUP BY doc_id
), pages AS (
  SELECT DISTINCT regexp_extract(lower(detail_url), 'details/0*([0-9]+)', 1) AS number, doc_id FROM legal_documents WHERE doc_id IS NOT NULL AND regexp_matches(lower(detail_url), 'details/[0-9]')
), best AS (
  SELECT number, doc_id, alive, first_in FROM pages JOIN docs USING (doc_id) QUALIFY row_number() OVER (PARTITION BY number ORDER BY NOT alive, doc_id) = 1
), refs AS (
  SELECT ref_id, recorded_at, regexp_extract(lower(trim(reference_link)), 'details/0*([0-9]+)', 1) AS number FROM relationship_refs WHERE regexp_matches(lower(reference_link), 'details/[0-9]')
)
SELECT ref_id, doc_id, CASE WHEN doc_id IS NULL THEN 'absent' WHEN NOT alive THEN 'deleted' ELSE 'late' END AS reason
FROM refs LEFT JOIN best USING (number) WHERE doc_id IS NULL OR NOT alive OR first_in > recorded_at""",
}

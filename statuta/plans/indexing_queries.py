"""Queries of the indexing pipeline: trees to units, article texts, processed texts, pages, patterns, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import legal, patterns
from statuta.functions.templates import Template, rendered
from statuta.operators import indexing
from statuta.session import load


def _units(spark: SparkSession, d: str) -> DataFrame:
    return indexing.unit_rows(load(spark, d, "crawl_records"), "record_id")


def indexed_trees(spark: SparkSession, d: str) -> DataFrame:
    """All units of all crawled trees."""
    return _units(spark, d).select("record_id", "seq", "depth", "unit_type", "unit_id", "parent_unit_id", "parent_pasal_id", "ordinal_int", "hierarchy_path")


def tree_sizes(spark: SparkSession, d: str) -> DataFrame:
    return indexing.tree_sizes(_units(spark, d), "record_id")


def article_texts(spark: SparkSession, d: str) -> DataFrame:
    """Full text of every article of the unit table, indented by level."""
    units = load(spark, d, "legal_units").select("doc_id", "unit_id", "unit_type", "number_label", "local_content", "parent_pasal_id", "seq", F.size(F.split("unit_id", "/")).alias("depth"), "unit_row_id")
    first = units.groupBy("doc_id", "unit_id").agg(F.min_by(F.struct("unit_type", "number_label", "local_content", "parent_pasal_id", "seq", "depth"), "unit_row_id").alias("u")).select("doc_id", "unit_id", "u.*")
    return indexing.article_texts(first, "doc_id").select("doc_id", "unit_id", F.md5("full_content").alias("hash"), F.length("full_content").alias("n_chars"))


def processed_extractions(spark: SparkSession, d: str) -> DataFrame:
    """Best extraction of each document, cleaned."""
    return indexing.processed_extractions(load(spark, d, "extraction_results"))


def backend_confidences(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "extraction_results")
    return rows.select("extraction_id", F.round(indexing.backend_confidence(F.col("text"), F.col("method")), 4).alias("confidence"))


def joined_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each document's extractions as pages: those of confidence 60 and more joined in order of arrival."""
    pages = load(spark, d, "extraction_results").select("doc_id", F.col("extraction_id").alias("page_no"), "text", "confidence")
    return indexing.pages_text(pages, "doc_id").select("doc_id", F.md5("text").alias("hash"), F.round("confidence", 6).alias("confidence"), "n_pages")


def vector_records(spark: SparkSession, d: str) -> DataFrame:
    """Vector records of all articles with text, with what filters them."""
    year = F.expr("try_cast(doc_year as int)")
    docs = load(spark, d, "legal_documents").groupBy("doc_id").agg(F.min_by(F.struct(legal.known_form(F.col("doc_form")).alias("doc_form"), year.alias("doc_year"), "doc_number", legal.known_status(F.col("doc_status")).alias("doc_status")), "doc_row_id").alias("r")).select("doc_id", "r.*")
    units = load(spark, d, "legal_units").select("doc_id", "unit_id", "unit_type", "content")
    return indexing.vector_rows(units, docs).drop("embedding")


def article_parts(spark: SparkSession, d: str) -> DataFrame:
    """The second article of each text, from its heading to the next one: how much it holds."""
    rows = load(spark, d, "extraction_results").where("text <> ''").select("extraction_id", patterns.article_hierarchy(F.col("text"), F.lit("2")).alias("h"))
    return rows.where("h.content is not null").select("extraction_id", F.length("h.content").alias("n_chars"), F.size("h.verses").alias("n_verses"), F.size("h.letters").alias("n_letters"), F.size("h.references").alias("n_references"))


def pattern_totals(spark: SparkSession, d: str) -> DataFrame:
    """Matches of every group of patterns over all texts."""
    rows = load(spark, d, "extraction_results").where("text <> ''").select(patterns.pattern_counts(F.col("text")).alias("c")).select("c.*")
    return rows.agg(*[F.sum(c).cast("bigint").alias(c) for c in rows.columns])


def references_in_place(spark: SparkSession, d: str) -> DataFrame:
    """Legal references in all texts with their place, in order of place."""
    rows = load(spark, d, "extraction_results").where("text <> ''")
    return rows.select("extraction_id", F.posexplode(patterns.located(F.col("text"), patterns.REFERENCES)).alias("n", "r")).select("extraction_id", "n", "r.place", "r.kind", "r.value", F.col("r.confidence").cast("double").alias("confidence"))


def type_numbers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "legal_documents").groupBy("doc_form").agg(F.count("*").alias("n")).select("doc_form", legal.type_number(F.col("doc_form")).alias("type_number"), "n")


def title_kinds(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "relationship_refs").select("ref_id", legal.title_kind(F.col("regulation_reference")).alias("t")).select("ref_id", "t.*")


PROMPT = Template("summary", "Ringkas {doc_id} {{singkat}}: {doc_title}", ("doc_id",))


def rendered_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "legal_documents").select("doc_row_id", rendered(PROMPT, doc_id=F.col("doc_id"), doc_title=F.col("doc_title")).alias("p"))
    return rows.select("doc_row_id", F.col("p.text").alias("text"), F.array_join("p.missing", ",").alias("missing"))


QUERIES = {f.__name__: f for f in (
    indexed_trees, tree_sizes, article_texts, processed_extractions, backend_confidences, joined_pages, vector_records, article_parts, pattern_totals, references_in_place, type_numbers, title_kinds, rendered_prompts,
)}

_FORMS = "'UU','PP','PERPU','PERPRES','POJK','PERMEN','PERDA','SE','LAINNYA'"
_FIRST = "SELECT * FROM legal_units QUALIFY row_number() OVER (PARTITION BY doc_id, unit_id ORDER BY unit_row_id) = 1"
_LABEL = "CASE upper(unit_type) WHEN 'AYAT' THEN '(' || coalesce(number_label, '') || ')' WHEN 'HURUF' THEN coalesce(number_label, '') || '.' WHEN 'ANGKA' THEN coalesce(number_label, '') || '.' WHEN 'PASAL' THEN NULL ELSE NULL END"
_REF = patterns.REFERENCES


def _count(pattern: str) -> str:
    return "len(regexp_extract_all(text, '" + pattern.replace("'", "''") + "'))"


_KINDS = ("UU|Undang-Undang", "PP|Peraturan\\s+Pemerintah", "Permen|Peraturan\\s+Menteri", "Perpres|Peraturan\\s+Presiden", "Perda|Peraturan\\s+Daerah")


def _kind(i: int) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(regulation_reference, '(?i)({k})\\s*(?:No\\.?|Nomor)\\s*([0-9]+)\\s*Tahun\\s*([0-9]{{4}})', {i}), '')" for k in _KINDS) + ")"


_TYPES = "CASE lower(trim(n ->> '$.type')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in indexing.NODE_TYPES.items()) + " ELSE 'DOKUMEN' END"
_SHOWN = f"coalesce(nullif(n ->> '$.label_display', 'null'), nullif(n ->> '$.number_label', 'null'), {_TYPES})"
_KIDS = """CASE json_type(c) WHEN 'ARRAY' THEN list_filter(CAST(c AS JSON[]), lambda x: json_type(x) = 'OBJECT') WHEN 'OBJECT' THEN [c] ELSE CAST([] AS JSON[]) END"""


def _decoded(column: str) -> str:
    return f"CASE WHEN json_type({column}) = 'VARCHAR' AND json_valid({column} ->> '$') THEN CAST({column} ->> '$' AS JSON) ELSE {column} END"


# unit ids are unique within the trees of the test data, so that no subtree is skipped; the tests cover those that are
_WALK = f"""WITH RECURSIVE roots AS (
  SELECT record_id, CAST(document_tree AS JSON) AS n FROM crawl_records WHERE document_tree IS NOT NULL AND json_valid(document_tree)
), start AS (
  SELECT record_id, n, {_KIDS.replace('(c', '(' + _decoded("json_extract(n, '$.children')")).replace('[c]', '[' + _decoded("json_extract(n, '$.children')") + ']')} AS kids FROM roots WHERE json_type(n) = 'OBJECT'
), walk AS (
  SELECT record_id, place, 1 AS depth, node AS n, CASE WHEN childless THEN NULL ELSE top END AS parent, CAST(NULL AS VARCHAR) AS pasal, CAST([] AS VARCHAR[]) AS above FROM (
    SELECT record_id, [i] AS place, kids[i] AS node, n ->> '$.unit_id' AS top, false AS childless FROM (SELECT *, unnest(range(1, len(kids) + 1)) AS i FROM start)
    UNION ALL SELECT record_id, [CAST(1 AS BIGINT)], n, NULL, true FROM start WHERE len(kids) = 0)
  UNION ALL
  SELECT record_id, list_append(place, i), depth + 1, kids[i], n ->> '$.unit_id', CASE WHEN t = 'PASAL' THEN n ->> '$.unit_id' ELSE pasal END, list_append(above, shown) FROM (
    SELECT *, unnest(range(1, len(kids) + 1)) AS i FROM (
      SELECT record_id, place, depth, n, pasal, above, {_TYPES} AS t, {_SHOWN} AS shown, {_KIDS} AS kids FROM (SELECT *, {_decoded("json_extract(n, '$.children')")} AS c FROM walk)))
), units AS (
  SELECT record_id, CAST(row_number() OVER (PARTITION BY record_id ORDER BY place) - 1 AS INTEGER) AS seq, CAST(depth AS INTEGER) AS depth, {_TYPES} AS unit_type, n ->> '$.unit_id' AS unit_id, parent AS parent_unit_id, pasal AS parent_pasal_id,
    coalesce(n ->> '$.number_label', '') AS number_label, array_to_string(list_append(above, {_SHOWN}), ' / ') AS hierarchy_path FROM walk)"""
_ROMAN = "list_transform(string_split(number_label, ''), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 ELSE 0 END)"
_ORDINAL = f"""CAST(CASE WHEN regexp_matches(number_label, '^[IVXLCDM]+$') THEN (SELECT sum(CASE WHEN i < len(v) AND v[i] < v[i + 1] THEN -v[i] ELSE v[i] END) FROM (SELECT {_ROMAN} AS v), range(1, length(number_label) + 1) r(i))
 WHEN regexp_matches(number_label, '^[0-9]+[A-Za-z]*$') THEN CAST(regexp_extract(number_label, '^([0-9]+)', 1) AS INTEGER) WHEN regexp_matches(number_label, '^[A-Za-z]$') THEN ascii(lower(number_label)) - 96 ELSE 0 END AS INTEGER)"""

ORACLES = {
    "indexed_trees": f"{_WALK} SELECT record_id, seq, depth, unit_type, unit_id, parent_unit_id, parent_pasal_id, {_ORDINAL} AS ordinal_int, hierarchy_path FROM units",
    "tree_sizes": f"{_WALK} SELECT record_id, count(*) + 1 AS n_nodes, max(depth) AS depth FROM units GROUP BY record_id",
    "backend_confidences": """SELECT extraction_id, round(least(CASE method WHEN 'pymupdf' THEN 95.0 WHEN 'pdfplumber' THEN 90.0 WHEN 'pypdf' THEN 85.0 ELSE 0.0 END::DOUBLE, coalesce(length(text), 0) / 100.0::DOUBLE), 4) AS confidence FROM extraction_results""",
    "joined_pages": """SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY extraction_id)) AS hash, round(avg(confidence), 6) AS confidence, count(*) AS n_pages FROM extraction_results WHERE confidence >= 60 GROUP BY doc_id""",
    "article_texts": f"""WITH u AS ({_FIRST}), l AS (SELECT doc_id, CASE WHEN unit_type = 'PASAL' THEN unit_id ELSE parent_pasal_id END AS pasal, seq, len(string_split(unit_id, '/')) AS depth, concat_ws(' ', {_LABEL}, nullif(local_content, '')) AS line FROM u),
b AS (SELECT doc_id, unit_id AS pasal, len(string_split(unit_id, '/')) AS base FROM u WHERE unit_type = 'PASAL'),
x AS (SELECT doc_id, pasal, seq, repeat('  ', greatest(depth - base, 0)) || line AS line FROM l JOIN b USING (doc_id, pasal) WHERE line <> ''),
t AS (SELECT doc_id, pasal, string_agg(line, chr(10) ORDER BY seq, line) AS full_content FROM x GROUP BY 1, 2)
SELECT doc_id, pasal AS unit_id, md5(full_content) AS hash, CAST(length(full_content) AS INTEGER) AS n_chars FROM t""",
    "vector_records": f"""WITH d AS (SELECT doc_id, arg_min(struct_pack(doc_form := CASE WHEN upper(trim(doc_form)) IN ({_FORMS}) THEN upper(trim(doc_form)) ELSE 'LAINNYA' END, doc_year := TRY_CAST(doc_year AS INTEGER), doc_number := doc_number,
doc_status := CASE WHEN lower(trim(doc_status)) = 'tidak berlaku' THEN 'Tidak Berlaku' ELSE 'Berlaku' END), doc_row_id) AS r FROM legal_documents GROUP BY doc_id)
SELECT doc_id, unit_id, 'pasal' AS content_type, r.doc_form AS doc_form, r.doc_year AS doc_year, r.doc_number AS doc_number, r.doc_status AS doc_status, nullif(regexp_extract(unit_id, '.*/bab-([^/]*)', 1), '') AS bab_number, nullif(regexp_extract(unit_id, '.*/pasal-([^/]*)', 1), '') AS pasal_number,
nullif(regexp_extract(unit_id, '.*/ayat-([^/]*)', 1), '') AS ayat_number, CAST(len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) AS INTEGER) AS token_count, CAST(length(content) AS INTEGER) AS char_count
FROM legal_units JOIN d USING (doc_id) WHERE unit_type = 'PASAL' AND trim(content) <> ''""",
    "type_numbers": "SELECT doc_form, CASE lower(trim(doc_form)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in legal.TYPE_NUMBERS.items()) + " END AS type_number, count(*) AS n FROM legal_documents GROUP BY 1, 2",
    "title_kinds": f"SELECT ref_id, {_kind(1)} AS kind, {_kind(2)} AS number, {_kind(3)} AS year FROM relationship_refs",
    "rendered_prompts": """SELECT doc_row_id, 'Ringkas ' || doc_id || ' {singkat}: ' || doc_title AS text, concat_ws(',', CASE WHEN doc_id IS NULL THEN 'doc_id' END, CASE WHEN doc_title IS NULL THEN 'doc_title' END) AS missing FROM legal_documents""",
}

"""Queries over texts and units: cleaning, patterns, labels, hierarchy, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import cleaning, legal, patterns
from statuta.operators import tree
from statuta.session import load


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "extraction_results").select("extraction_id", "text").where("text <> ''")


def _units(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "legal_units")


def text_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("extraction_id", cleaning.statistics(F.col("text")).alias("s")).select("extraction_id", "s.*")


def cleaning_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("extraction_id", F.array_join(cleaning.suggestions(F.col("text")), ",").alias("operations"))


def whitespace_normalised(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("extraction_id", F.md5(cleaning.normalise_whitespace(F.col("text"))).alias("hash"), F.md5(cleaning.collapse(F.col("text"))).alias("collapsed_hash"))


def cleaned_texts(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("extraction_id", cleaning.clean(F.col("text")).alias("text"))


def text_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles, chapters and verses named in each text: how many, and how many different ones."""
    t = F.col("text")
    parts = [(n, patterns.extract(t, r), patterns.extract(t, r, distinct=True)) for n, r in (("chapters", patterns.CHAPTERS), ("articles", patterns.ARTICLES), ("verses", patterns.VERSES), ("items", patterns.LETTERED))]
    return _texts(spark, d).select("extraction_id", *[F.size(a).alias(f"n_{n}") for n, a, _ in parts], *[F.size(u).alias(f"n_different_{n}") for n, _, u in parts])


def text_references(spark: SparkSession, d: str) -> DataFrame:
    """References to regulations in documents' texts, as edges."""
    docs = load(spark, d, "documents").where("text is not null")
    found = docs.select("doc_id", F.explode(patterns.extract(F.col("text"), patterns.REFERENCES)).alias("f"))
    return found.groupBy("doc_id", F.regexp_replace("f.value", r"\s+", " ").alias("reference"), F.col("f.kind").alias("kind")).agg(F.count("*").alias("n"))


def document_types(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", patterns.document_type(F.col("text")).alias("type"), F.coalesce(patterns.is_definition(F.col("text")), F.lit(False)).alias("is_definition"))


def structure_reports(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("extraction_id", patterns.structure_report(F.col("text")).alias("s")).select("extraction_id", "s.*")


def unit_ordinals(spark: SparkSession, d: str) -> DataFrame:
    rows = _units(spark, d).withColumn("o", legal.ordinal(F.col("number_label")))
    return rows.select("unit_row_id", F.col("o.ordinal_int").alias("ordinal_int"), F.col("o.ordinal_suffix").alias("ordinal_suffix"), legal.sort_key(F.col("o.ordinal_int"), F.col("o.ordinal_suffix")).alias("sort_key"), legal.label_display(F.col("unit_type"), F.col("number_label")).alias("label"))


def unit_citations(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select("unit_row_id", legal.citation(F.lit("T"), F.col("path")).alias("citation"), F.array_join(F.transform("path", lambda p: p["label"]), " / ").alias("hierarchy"))


def unit_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select("unit_row_id", *[legal.path_number(F.col("unit_id"), level).alias(f"{level}_number") for level in ("bab", "pasal", "ayat", "huruf")])


def unit_roll_up(spark: SparkSession, d: str) -> DataFrame:
    """Full content of every unit out of the local content below it."""
    units = tree.keep_first(_units(spark, d).select("doc_id", "unit_id", "unit_row_id", "seq", "local_content"))
    return tree.roll_up(units).select("doc_id", "unit_id", F.md5("content").alias("hash"), F.length("content").alias("n_chars"))


def vector_records(spark: SparkSession, d: str) -> DataFrame:
    """Articles as records of a vector table: filter columns and sizes next to the text."""
    units = tree.keep_first(_units(spark, d)).where("unit_type = 'PASAL'")
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != ""))
    return units.select(
        F.sha2(F.concat_ws("|", "doc_id", "unit_id"), 256).alias("vector_id"), "doc_id", "unit_id", legal.path_number(F.col("unit_id"), "bab").alias("bab_number"), legal.path_number(F.col("unit_id"), "pasal").alias("pasal_number"),
        F.when(F.col("content").isNotNull(), words).alias("token_count"), F.length("content").alias("char_count"),
    )


def parsed_trees(spark: SparkSession, d: str) -> DataFrame:
    """Nodes parsed out of the content of every record, as unit rows."""
    docs = load(spark, d, "legal_documents").where("doc_content is not null").select(F.concat_ws("#", "doc_id", "doc_row_id").alias("doc_id"), "doc_title", "doc_content")
    return tree.unit_rows(tree.parse_tree(docs), docs.select("doc_id", "doc_title"))


def tree_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Units per document and type, and how deep they lie."""
    return _units(spark, d).groupBy("doc_id", "unit_type").agg(F.count("*").alias("n"), F.max(F.size(F.split("unit_id", "/")) - 1).alias("depth"))


QUERIES = {f.__name__: f for f in (
    text_statistics, cleaning_suggestions, whitespace_normalised, cleaned_texts, text_articles, text_references, document_types, structure_reports, unit_ordinals, unit_citations, unit_hierarchy,
    unit_roll_up, vector_records, parsed_trees, tree_statistics,
)}

_T = "(SELECT extraction_id, text FROM extraction_results WHERE text <> '')"
_PROBES = dict(cleaning.PROBES)
_PROBE_SQL = ", ".join(f"regexp_matches(text, '{p}') AS {n}" for n, p in _PROBES.items())


def _all(rules: tuple, group: int = 1) -> str:
    return "list_concat(" + ", ".join(["CAST([] AS VARCHAR[])", *[f"regexp_extract_all(text, '{p}', {group})" for _, p, _ in rules]]) + ")"


_COUNTED = (("chapters", patterns.CHAPTERS), ("articles", patterns.ARTICLES), ("verses", patterns.VERSES), ("items", patterns.LETTERED))
_ROMAN = "list_transform(string_split(number_label, ''), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 ELSE 0 END)"
_ORD = f"""CAST(CASE WHEN regexp_matches(number_label, '^[IVXLCDM]+$') THEN (SELECT sum(CASE WHEN i < len(v) AND v[i] < v[i + 1] THEN -v[i] ELSE v[i] END) FROM (SELECT {_ROMAN} AS v), range(1, length(number_label) + 1) r(i))
 WHEN regexp_matches(number_label, '^[0-9]+[A-Za-z]*$') THEN CAST(regexp_extract(number_label, '^([0-9]+)', 1) AS INTEGER) WHEN regexp_matches(number_label, '^[A-Za-z]$') THEN ascii(lower(number_label)) - 96 ELSE 0 END AS INTEGER)"""


def _seg(level: str) -> str:
    return f"nullif(regexp_replace(list_filter(string_split(unit_id, '/'), lambda s: starts_with(s, '{level}-'))[-1], '^{level}-', ''), '')"


_FIRST = "(SELECT * FROM legal_units QUALIFY row_number() OVER (PARTITION BY doc_id, unit_id ORDER BY unit_row_id) = 1)"
_WS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(?m)^[ \\t]+', '', 'g'), '(?m)[ \\t]+$', '', 'g'), '[ \\t]{2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
_NAMES = {"undang-undang": "UU", "peraturan pemerintah": "PP", "peraturan presiden": "PERPRES", "peraturan menteri": "PERMEN", "peraturan daerah": "PERDA"}

ORACLES = {
    "text_statistics": f"""SELECT extraction_id, CAST(length(text) AS INTEGER) AS character_count, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS word_count,
CAST(len(string_split(text, chr(10))) AS INTEGER) AS line_count, {_PROBE_SQL} FROM {_T}""",
    "cleaning_suggestions": f"""SELECT extraction_id, concat_ws(',', 'clean_legal_document_comprehensive', CASE WHEN has_sk_noise THEN 'remove_document_noise' END, CASE WHEN has_garbled_text THEN 'fix_critical_ocr_errors' END,
CASE WHEN has_spacing_issues THEN 'fix_spacing_issues' END, CASE WHEN has_excessive_newlines THEN 'normalize_whitespace' END) AS operations FROM (SELECT extraction_id, {_PROBE_SQL} FROM {_T})""",
    "whitespace_normalised": f"SELECT extraction_id, md5({_WS}) AS hash, md5(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS collapsed_hash FROM {_T}",
    "text_articles": "SELECT extraction_id, "
    + ", ".join(f"CAST(len({_all(r)}) AS INTEGER) AS n_{n}, CAST(len(list_distinct({_all(r)})) AS INTEGER) AS n_different_{n}" for n, r in _COUNTED)
    + f" FROM {_T}",
    "text_references": f"""WITH f AS ({' UNION ALL '.join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}', 1)) AS v FROM documents" for k, p, _ in patterns.REFERENCES)})
SELECT doc_id, regexp_replace(v, '\\s+', ' ', 'g') AS reference, kind, count(*) AS n FROM f GROUP BY ALL""",
    "document_types": f"""SELECT doc_id, coalesce(CASE regexp_replace(lower(regexp_extract(text, '(?i)(UNDANG-UNDANG|PERATURAN\\s+PEMERINTAH|PERATURAN\\s+PRESIDEN|PERATURAN\\s+MENTERI|PERATURAN\\s+DAERAH)\\s+(?:REPUBLIK\\s+INDONESIA\\s+)?(?:NOMOR|NO\\.?)\\s*\\d+[A-Z]?\\s*TAHUN\\s*\\d{{4}}', 1)), '\\s+', ' ', 'g')
{' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items())} END, nullif(upper(regexp_extract(text, '(?i)\\b(UU|PP|Perpres|Permen|Perda)\\s*(?:No\\.?|Nomor)?\\s*\\d+[A-Z]?\\s*(?:Tahun|th\\.?)?\\s*\\d{{4}}', 1)), '')) AS "type",
coalesce(regexp_matches(text, '(?i)Dalam\\s+(?:Undang-Undang|Peraturan)\\s+ini\\s+yang\\s+dimaksud\\s+dengan|\\b(?:KETENTUAN\\s+UMUM|DEFINISI|PENGERTIAN)\\b'), false) AS is_definition FROM documents""",
    "structure_reports": "SELECT *, (CAST(has_chapters AS INTEGER) + CAST(has_articles AS INTEGER) + CAST(has_verses AS INTEGER) + CAST(has_items AS INTEGER)) / 4.0::DOUBLE AS score, (CAST(has_chapters AS INTEGER) + CAST(has_articles AS INTEGER) + CAST(has_verses AS INTEGER) + CAST(has_items AS INTEGER)) > 2 AS is_valid FROM (SELECT extraction_id, "
    + ", ".join(f"len({_all(r)}) > 0 AS has_{n}" for n, r in _COUNTED)
    + f" FROM {_T})",
    "unit_ordinals": f"""WITH o AS (SELECT unit_row_id, unit_type, number_label, coalesce({_ORD}, 0) AS ordinal_int, CASE WHEN regexp_matches(number_label, '^[0-9]+[A-Za-z]*$') THEN regexp_extract(number_label, '^[0-9]+([A-Za-z]*)$', 1) ELSE '' END AS ordinal_suffix FROM legal_units)
SELECT unit_row_id, ordinal_int, ordinal_suffix, lpad(CAST(ordinal_int AS VARCHAR), 4, '0') || '|' || ordinal_suffix AS sort_key,
CASE WHEN unit_type = 'PASAL' THEN 'Pasal ' || number_label WHEN unit_type IN ('BUKU','BAB','BAGIAN','PARAGRAF') THEN unit_type || ' ' || number_label WHEN unit_type = 'AYAT' THEN '(' || number_label || ')' WHEN unit_type IN ('HURUF','ANGKA') THEN number_label || '.' ELSE number_label END AS label FROM o""",
    "unit_citations": """WITH p AS (SELECT unit_row_id, path, list_transform(list_filter(path, lambda x: lower(x.type) IN ('pasal','ayat','huruf','angka')), lambda x: CASE lower(x.type) WHEN 'pasal' THEN x.label WHEN 'ayat' THEN 'ayat (' || regexp_replace(x.label, '[^0-9]', '', 'g') || ')'
WHEN 'huruf' THEN 'huruf ' || regexp_replace(x.label, '[^a-zA-Z]', '', 'g') ELSE 'angka ' || regexp_replace(x.label, '[^0-9]', '', 'g') END) AS c FROM legal_units)
SELECT unit_row_id, CASE WHEN len(c) > 0 THEN 'T, ' || array_to_string(c, ' ') ELSE 'T' END AS citation, array_to_string(list_transform(path, lambda x: x.label), ' / ') AS hierarchy FROM p""",
    "unit_hierarchy": "SELECT unit_row_id, " + ", ".join(f"{_seg(x)} AS {x}_number" for x in ("bab", "pasal", "ayat", "huruf")) + " FROM legal_units",
    "unit_roll_up": f"""WITH u AS (SELECT doc_id, unit_id, seq, local_content, string_split(unit_id, '/') AS s FROM {_FIRST} WHERE local_content IS NOT NULL AND unit_id IS NOT NULL),
a AS (SELECT doc_id, seq, local_content, array_to_string(s[1:n], '/') AS unit_id FROM (SELECT *, unnest(range(2, len(s) + 1)) AS n FROM u WHERE len(s) > 1)),
c AS (SELECT doc_id, unit_id, string_agg(local_content, chr(10) || chr(10) ORDER BY seq NULLS FIRST, local_content) AS content FROM a GROUP BY doc_id, unit_id)
SELECT doc_id, unit_id, md5(content) AS hash, CAST(length(content) AS INTEGER) AS n_chars FROM c""",
    "vector_records": f"""SELECT sha256(concat_ws('|', doc_id, unit_id)) AS vector_id, doc_id, unit_id, {_seg('bab')} AS bab_number, {_seg('pasal')} AS pasal_number,
CAST(CASE WHEN content IS NOT NULL THEN len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) END AS INTEGER) AS token_count, CAST(length(content) AS INTEGER) AS char_count FROM {_FIRST} WHERE unit_type = 'PASAL'""",
    "tree_statistics": "SELECT doc_id, unit_type, count(*) AS n, CAST(max(len(string_split(unit_id, '/')) - 1) AS INTEGER) AS depth FROM legal_units GROUP BY doc_id, unit_type",
}

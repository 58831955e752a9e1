"""Queries over document records: normalisation, indexing, metadata, relationships, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import html, legal
from statuta.operators import quality
from statuta.operators.orphans import details_number
from statuta.operators.service import preview
from statuta.session import load
from statuta.sources import writers


def _legal(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "legal_documents")


def document_records(spark: SparkSession, d: str) -> DataFrame:
    """Crawled records as table rows: domains, dates, numeric year (else null), content length."""
    return _legal(spark, d).select(
        "doc_row_id", "doc_id", legal.known_form(F.col("doc_form")).alias("doc_form"), legal.known_status(F.col("doc_status")).alias("doc_status"),
        F.expr("try_cast(doc_year as int)").alias("doc_year"), F.coalesce("doc_title", F.lit("Unknown")).alias("doc_title"),
        *[legal.to_date(F.col(c)).alias(c) for c in ("doc_date_enacted", "doc_date_promulgated", "doc_date_effective")],
        F.coalesce(F.length("doc_content"), F.lit(0)).alias("doc_content_length"), F.upper(F.trim("doc_source")).alias("doc_source"),
    )


def document_subjects(spark: SparkSession, d: str) -> DataFrame:
    rows = _legal(spark, d).select("doc_id", F.explode("doc_subject").alias("subject")).where(F.trim("subject") != "")
    return rows.select("doc_id", F.upper(F.trim("subject")).alias("subject")).distinct()


def new_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Get-or-create: subjects that only documents after 2020 bring, with how many documents."""
    rows = document_subjects(spark, d).join(_legal(spark, d).select("doc_id", F.expr("try_cast(doc_year as int)").alias("y")).distinct(), "doc_id")
    known = rows.where("y <= 2000").select("subject").distinct()
    return rows.where("y > 2000").join(known, "subject", "left_anti").groupBy("subject").agg(F.countDistinct("doc_id").alias("n_documents"))


def subject_dimension(spark: SparkSession, d: str) -> DataFrame:
    """The subjects of older documents, with those created for the newer ones."""
    rows = document_subjects(spark, d).join(_legal(spark, d).select("doc_id", F.expr("try_cast(doc_year as int)").alias("y")).distinct(), "doc_id")
    return writers.with_dimension(rows.where("y <= 2000").select("subject").distinct(), rows.where("y > 2000"), "subject")


def extraction_choice(spark: SparkSession, d: str) -> DataFrame:
    """The extraction that trying the back ends in order takes: the first above 80, else the best of all."""
    c = F.col
    rank = F.when(c("method") == "pymupdf", 0).when(c("method") == "pdfplumber", 1).when(c("method") == "pypdf", 2).otherwise(3)
    rows = load(spark, d, "extraction_results").withColumn("score", legal.extraction_score(c("success"), c("confidence"), c("text"), c("method"))).withColumn("rank", rank)
    good = c("score") > 80
    order = F.struct((~good).alias("a"), F.when(good, c("rank")).otherwise(0).alias("b"), F.when(good, 0.0).otherwise(-c("score")).alias("c"), c("rank"), c("extraction_id"))
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("extraction_id", "method", F.round("score", 4).alias("score")), order).alias("b")).select("doc_id", "b.*")


def document_counts(spark: SparkSession, d: str) -> DataFrame:
    return _legal(spark, d).groupBy(legal.known_form(F.col("doc_form")).alias("doc_form"), legal.known_status(F.col("doc_status")).alias("doc_status")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("doc_id").alias("n_documents"), F.sum(F.length("doc_content")).alias("n_chars")
    )


def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents, units, articles, rows whose extraction failed."""
    docs = _legal(spark, d).agg(F.countDistinct("doc_id").alias("n_documents"))
    units = load(spark, d, "legal_units").agg(F.count("*").alias("n_units"), F.count_if(F.col("unit_type") == "PASAL").alias("n_pasal"))
    failed = load(spark, d, "extraction_results").agg(F.count_if(~F.col("success")).alias("n_errors"))
    return docs.join(F.broadcast(units)).join(F.broadcast(failed))


def recent_documents(spark: SparkSession, d: str) -> DataFrame:
    return _legal(spark, d).orderBy(F.desc("ingested_at"), "doc_row_id").limit(5).select("doc_row_id", "doc_id", preview(F.col("doc_content")).alias("preview"))


def new_documents(spark: SparkSession, d: str) -> DataFrame:
    """Records of the newer half whose document the older half does not have, one per document."""
    rows = _legal(spark, d).select("doc_id", "ingested_at")
    old, new = rows.where("ingested_at < timestamp_ntz'2023-01-01 00:00:00'"), rows.where("ingested_at >= timestamp_ntz'2023-01-01 00:00:00'")
    return writers.new_only(new.groupBy("doc_id").agg(F.min("ingested_at").alias("ingested_at")), old)


def merged_documents(spark: SparkSession, d: str) -> DataFrame:
    """Update of stored records: a later crawl replaces content and state, other fields stay."""
    rows = _legal(spark, d)
    first = rows.groupBy("doc_id").agg(F.min_by(F.struct("doc_title", "doc_content", "doc_processing_status"), "doc_row_id").alias("r"), F.min("doc_row_id").alias("i")).select("doc_id", "r.*", "i")
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct("doc_title", "doc_content", "doc_processing_status"), "doc_row_id").alias("r"), F.count("*").alias("n")).where("n > 1").select("doc_id", "r.*")
    return writers.merged(first.drop("i"), last, replace=("doc_content", "doc_processing_status")).select("doc_id", "doc_title", F.md5("doc_content").alias("content_hash"), "doc_processing_status")


def text_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _legal(spark, d).select("doc_row_id", F.length(writers.first_text("doc_content", "doc_title", "doc_id")).alias("n_chars"))


def repeated_documents(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_keys(_legal(spark, d), "doc_form", "doc_number", "doc_year")


def repeated_units(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_keys(load(spark, d, "legal_units"), "doc_id", "unit_id")


def validated_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.validate(_legal(spark, d), (*quality.REQUIRED, "doc_status", "doc_content"))
    return rows.select("doc_row_id", "n_issues", "is_valid", F.array_join(F.transform("issues", lambda i: i["field"]), ",").alias("fields"))


def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = quality.validate(_legal(spark, d), (*quality.REQUIRED, "doc_status", "doc_content"))
    return rows.select(F.explode("issues").alias("i")).groupBy("i.field", "i.severity").agg(F.count("*").alias("n"))


def document_dates(spark: SparkSession, d: str) -> DataFrame:
    """How each written date reads: ISO, day/month/year and month names; null for the rest."""
    return _legal(spark, d).select(F.col("doc_date_enacted").alias("written")).distinct().select("written", legal.to_date(F.col("written")).alias("date"))


def document_ids(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _legal(spark, d).select(
        "doc_row_id", legal.doc_id(c("doc_type"), c("doc_year"), c("doc_number")).alias("made_id"), legal.short_form(c("doc_type")).alias("short_form"),
        F.concat_ws("_", legal.file_type(c("doc_title"), c("doc_type")), legal.file_part(c("doc_number")), legal.file_part(c("doc_year"))).alias("file_name"),
        quality.validation_id(c("doc_form"), c("doc_number"), c("doc_year")).alias("validation_id"),
    )


def title_parts(spark: SparkSession, d: str) -> DataFrame:
    return _legal(spark, d).select("doc_row_id", legal.title_parts(F.col("doc_title")).alias("t")).select("doc_row_id", "t.*")


def status_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Status of a record by keyword, and the year its page address names."""
    s = F.lower("doc_status")
    status = F.when(s.contains("tidak berlaku"), "revoked").when(s.contains("berlaku"), "in force").otherwise("unknown")
    return _legal(spark, d).select("doc_row_id", status.alias("state"), F.nullif(F.regexp_extract("detail_url", r"tahun-(\d{4})", 1), F.lit("")).cast("int").alias("url_year"), details_number(F.col("detail_url")).alias("page_no"))


def relationship_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "relationship_refs")
    return rows.groupBy(legal.relation_key(F.col("relationship_type")).alias("relation"), legal.edge_type(F.col("relationship_type")).alias("edge_type")).agg(F.count("*").alias("n"), F.countDistinct("source_doc_id").alias("n_sources"))


def distinct_references(spark: SparkSession, d: str) -> DataFrame:
    """Distinct references per record, in order of first occurrence."""
    rows = load(spark, d, "crawl_records")
    refs = F.flatten(F.transform(F.map_values("relationships"), lambda v: F.transform(F.filter(F.coalesce(v, F.array()), lambda r: r.isNotNull()), lambda r: r["regulation_reference"])))
    return rows.select("record_id", F.size(F.array_distinct(F.filter(refs, lambda r: r.isNotNull()))).alias("n_distinct"), F.size(refs).alias("n_all")).where("n_all >= 0")


def pdf_sources(spark: SparkSession, d: str) -> DataFrame:
    """The PDF of each record: from its own address, else from the links in its content."""
    links = F.array(F.struct(F.coalesce("pdf_url", F.lit("")).alias("href"), F.lit("unduh").alias("text")), F.struct(F.coalesce("source_url", F.lit("")).alias("href"), F.lit("sumber").alias("text")))
    return _legal(spark, d).select("doc_row_id", html.pdf_link(links).alias("pdf"))


def extraction_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The best extraction of each document by score; retries and failures compete."""
    c = F.col
    rows = load(spark, d, "extraction_results").withColumn("score", legal.extraction_score(c("success"), c("confidence"), c("text"), c("method")))
    return rows.groupBy("doc_id").agg(F.max_by(F.struct("extraction_id", "method", F.round("score", 4).alias("score")), F.struct("score", -F.col("extraction_id"))).alias("b"), F.count("*").alias("n")).select("doc_id", "b.*", "n")


def extraction_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Per method: mean of positive confidences, share of good pages (60 and more), mean pages."""
    conf = F.col("confidence")
    return load(spark, d, "extraction_results").groupBy("method").agg(
        F.round(F.avg(F.when(conf > 0, conf)), 4).alias("mean_confidence"), F.round(F.avg((F.coalesce(conf, F.lit(0.0)) >= 60).cast("double")), 4).alias("share_good"),
        F.round(F.avg("page_count"), 4).alias("mean_pages"), F.count("*").alias("n"),
    )


QUERIES = {f.__name__: f for f in (
    document_records, document_subjects, new_subjects, subject_dimension, extraction_choice, document_counts, run_statistics, recent_documents, new_documents, merged_documents, text_fallback, repeated_documents, repeated_units,
    validated_documents, validation_summary, document_dates, document_ids, title_parts, status_keywords, relationship_counts, distinct_references, pdf_sources, extraction_ranking, extraction_confidence,
)}

_FORMS = "'UU','PP','PERPU','PERPRES','POJK','PERMEN','PERDA','SE','LAINNYA'"
_FORM = f"CASE WHEN upper(trim(doc_form)) IN ({_FORMS}) THEN upper(trim(doc_form)) ELSE 'LAINNYA' END"
_STATUS = "CASE WHEN lower(trim(doc_status)) = 'tidak berlaku' THEN 'Tidak Berlaku' ELSE 'Berlaku' END"


def _case(pairs, subject: str, otherwise: str, test: str = "contains({0}, '{1}')") -> str:
    return "CASE " + " ".join("WHEN " + test.format(subject, a) + f" THEN '{b}'" for a, b in pairs) + f" ELSE {otherwise} END"


def _date(c: str) -> str:
    t = f"lower(trim({c}))"
    month = "CASE regexp_extract(" + t + ", '^[0-9]{1,2} ([a-z]+) [0-9]{4}$', 1) " + " ".join(f"WHEN '{m}' THEN '{i:02d}'" for i, m in enumerate(legal.MONTHS, 1)) + " END"
    return f"""CASE WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST({t} AS DATE)
 WHEN {month} IS NOT NULL THEN TRY_CAST(regexp_extract({t}, '([0-9]{{4}})$', 1) || '-' || {month} || '-' || lpad(regexp_extract({t}, '^([0-9]{{1,2}})', 1), 2, '0') AS DATE)
 WHEN regexp_matches({t}, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}$') THEN TRY_CAST(try_strptime({t}, '%d/%m/%Y') AS DATE) END"""


_SUBJECTS = "subjects AS (SELECT DISTINCT doc_id, upper(trim(s)) AS subject FROM (SELECT doc_id, unnest(doc_subject) AS s FROM legal_documents) WHERE trim(s) <> '')"
_CHECKED = ("doc_id", "doc_title", "doc_form", "doc_number", "doc_year", "doc_status", "doc_content")
_ISSUES = "list_filter([" + ", ".join(f"CASE WHEN coalesce(trim({c}), '') = '' THEN '{c}' END" for c in _CHECKED) + "], lambda x: x IS NOT NULL)"
_ABBREVIATION = f"""CASE WHEN coalesce(lower(trim(doc_type)), '') = '' THEN 'UNKNOWN' ELSE coalesce({_case(legal.ABBREVIATIONS, 'lower(trim(doc_type))', 'NULL', "{0} = '{1}'")}, {_case(legal.ABBREVIATIONS, 'lower(trim(doc_type))', "'?'")}) END"""
_TITLE_TYPES = [(n, k) for k, names in legal.TITLE_TYPES for n in names]
_FILE_TYPE = _case(_TITLE_TYPES, "lower(coalesce(doc_title, ''))", _case([(names[0], k) for k, names in legal.TITLE_TYPES], "lower(coalesce(doc_type, ''))", "'peraturan_perundang_undangan'"))


def _part(c: str) -> str:
    return f"coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\w\\s-]', '', 'g'), '[-\\s_]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown')"


ORACLES = {
    "document_records": f"""SELECT doc_row_id, doc_id, {_FORM} AS doc_form, {_STATUS} AS doc_status, TRY_CAST(doc_year AS INTEGER) AS doc_year, coalesce(doc_title, 'Unknown') AS doc_title,
{', '.join(f'{_date(c)} AS {c}' for c in ('doc_date_enacted', 'doc_date_promulgated', 'doc_date_effective'))}, CAST(coalesce(length(doc_content), 0) AS INTEGER) AS doc_content_length, upper(trim(doc_source)) AS doc_source FROM legal_documents""",
    "document_subjects": f"WITH {_SUBJECTS} SELECT * FROM subjects",
    "new_subjects": f"""WITH {_SUBJECTS}, y AS (SELECT DISTINCT doc_id, TRY_CAST(doc_year AS INTEGER) AS y FROM legal_documents), r AS (SELECT * FROM subjects JOIN y USING (doc_id))
SELECT subject, count(DISTINCT doc_id) AS n_documents FROM r WHERE y > 2000 AND subject NOT IN (SELECT subject FROM r WHERE y <= 2000) GROUP BY subject""",
    "subject_dimension": f"WITH {_SUBJECTS} SELECT DISTINCT subject FROM subjects JOIN (SELECT DISTINCT doc_id, TRY_CAST(doc_year AS INTEGER) AS y FROM legal_documents) USING (doc_id) WHERE y IS NOT NULL",
    "extraction_choice": """WITH s AS (SELECT doc_id, extraction_id, method, CASE method WHEN 'pymupdf' THEN 0 WHEN 'pdfplumber' THEN 1 WHEN 'pypdf' THEN 2 ELSE 3 END AS rank,
CASE WHEN NOT coalesce(success, false) OR coalesce(length(text), 0) = 0 THEN 0.0 ELSE least(100.0, coalesce(confidence, 0.0) + CASE WHEN length(text) > 5000 THEN 10 WHEN length(text) > 1000 THEN 5 ELSE 0 END
+ CASE method WHEN 'pymupdf' THEN 5 WHEN 'pdfplumber' THEN 3 ELSE 0 END) END AS score FROM extraction_results)
SELECT doc_id, extraction_id, method, round(CAST(score AS DOUBLE), 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score <= 80, CASE WHEN score > 80 THEN rank ELSE 0 END, CASE WHEN score > 80 THEN 0 ELSE -score END, rank, extraction_id) = 1""",
    "document_counts": f"SELECT {_FORM} AS doc_form, {_STATUS} AS doc_status, count(*) AS n_rows, count(DISTINCT doc_id) AS n_documents, CAST(sum(length(doc_content)) AS BIGINT) AS n_chars FROM legal_documents GROUP BY 1, 2",
    "run_statistics": """SELECT (SELECT count(DISTINCT doc_id) FROM legal_documents) AS n_documents, (SELECT count(*) FROM legal_units) AS n_units,
(SELECT count(*) FROM legal_units WHERE unit_type = 'PASAL') AS n_pasal, (SELECT count(*) FROM extraction_results WHERE NOT success) AS n_errors""",
    "recent_documents": "SELECT doc_row_id, doc_id, CASE WHEN length(doc_content) > 200 THEN substring(doc_content, 1, 200) || '...' ELSE doc_content END AS preview FROM legal_documents ORDER BY ingested_at DESC, doc_row_id LIMIT 5",
    "new_documents": """SELECT doc_id, min(ingested_at) AS ingested_at FROM legal_documents WHERE ingested_at >= TIMESTAMP '2023-01-01' AND doc_id NOT IN (SELECT doc_id FROM legal_documents WHERE ingested_at < TIMESTAMP '2023-01-01' AND doc_id IS NOT NULL) GROUP BY doc_id""",
    "merged_documents": """WITH f AS (SELECT doc_id, arg_min(struct_pack(t := doc_title, c := doc_content, s := doc_processing_status), doc_row_id) AS a, arg_max(struct_pack(c := doc_content, s := doc_processing_status), doc_row_id) AS z FROM legal_documents GROUP BY doc_id)
SELECT doc_id, a.t AS doc_title, md5(coalesce(z.c, a.c)) AS content_hash, coalesce(z.s, a.s) AS doc_processing_status FROM f""",
    "text_fallback": "SELECT doc_row_id, CAST(length(coalesce(nullif(doc_content, ''), nullif(doc_title, ''), nullif(doc_id, ''))) AS INTEGER) AS n_chars FROM legal_documents",
    "repeated_documents": "SELECT doc_form, doc_number, doc_year, count(*) AS n FROM legal_documents GROUP BY ALL HAVING count(*) > 1",
    "repeated_units": "SELECT doc_id, unit_id, count(*) AS n FROM legal_units GROUP BY ALL HAVING count(*) > 1",
    "validated_documents": f"SELECT doc_row_id, CAST(len(i) AS INTEGER) AS n_issues, len(i) = 0 AS is_valid, array_to_string(i, ',') AS fields FROM (SELECT doc_row_id, {_ISSUES} AS i FROM legal_documents)",
    "validation_summary": f"SELECT field, 'error' AS severity, count(*) AS n FROM (SELECT unnest({_ISSUES}) AS field FROM legal_documents) GROUP BY field",
    "document_dates": f"SELECT DISTINCT doc_date_enacted AS written, {_date('doc_date_enacted')} AS date FROM legal_documents",
    "document_ids": f"""SELECT doc_row_id, concat_ws('-', {_ABBREVIATION}, coalesce(doc_year, 'UNKNOWN'), regexp_replace(coalesce(doc_number, 'UNKNOWN'), '[^a-zA-Z0-9-]', '', 'g')) AS made_id,
CASE WHEN coalesce(doc_type, '') = '' THEN 'Unknown' ELSE {_case(legal.SHORT_FORMS, 'lower(doc_type)', "coalesce(nullif(regexp_extract(doc_type, '\\(([^)]+)\\)', 1), ''), doc_type)")} END AS short_form,
concat_ws('_', {_FILE_TYPE}, {_part('doc_number')}, {_part('doc_year')}) AS file_name, lower(concat_ws('_', doc_form, doc_number, doc_year)) AS validation_id FROM legal_documents""",
    "title_parts": "SELECT doc_row_id, "
    + ", ".join(f"nullif(regexp_extract(doc_title, '(?i)^\\s*(.*?)\\s+(?:nomor|no\\.?)\\s*([0-9]+\\w*)\\s+tahun\\s+([0-9]{{4}})', {i}), '') AS {n}" for i, n in ((1, "kind"), (2, "number"), (3, "year")))
    + " FROM legal_documents",
    "status_keywords": """SELECT doc_row_id, CASE WHEN contains(lower(doc_status), 'tidak berlaku') THEN 'revoked' WHEN contains(lower(doc_status), 'berlaku') THEN 'in force' ELSE 'unknown' END AS state,
CAST(nullif(regexp_extract(detail_url, 'tahun-([0-9]{4})', 1), '') AS INTEGER) AS url_year, nullif(regexp_extract(lower(detail_url), 'details/0*([0-9]+)', 1), '') AS page_no FROM legal_documents""",
    "relationship_counts": f"""SELECT regexp_replace(lower(trim(relationship_type)), '\\s+', '_', 'g') AS relation, {_case(legal.EDGE_TYPES, "replace(lower(relationship_type), '_', ' ')", 'NULL')} AS edge_type, count(*) AS n, count(DISTINCT source_doc_id) AS n_sources
FROM relationship_refs GROUP BY 1, 2""",
    "distinct_references": """WITH r AS (SELECT record_id, list_transform(list_filter(flatten(list_filter(map_values(relationships), lambda v: v IS NOT NULL)), lambda x: x IS NOT NULL), lambda x: x.regulation_reference) AS l FROM crawl_records WHERE relationships IS NOT NULL)
SELECT record_id, CAST(len(list_distinct(list_filter(l, lambda x: x IS NOT NULL))) AS INTEGER) AS n_distinct, CAST(len(l) AS INTEGER) AS n_all FROM r""",
    "pdf_sources": """WITH l AS (SELECT doc_row_id, coalesce(pdf_url, '') AS a, coalesce(source_url, '') AS b FROM legal_documents), u AS (SELECT doc_row_id, list_filter([a, b], lambda x: NOT regexp_matches(lower(x), 'uji\\s*materi|putusan')) AS h FROM l)
SELECT doc_row_id, coalesce(list_filter(h, lambda x: regexp_matches(lower(x), '/download/.*\\.pdf'))[1], list_filter(h, lambda x: regexp_matches(lower(x), '\\.pdf(\\?|$)'))[1], list_filter(h, lambda x: contains(lower(x), '/download/'))[1]) AS pdf FROM u""",
    "extraction_ranking": """WITH s AS (SELECT doc_id, extraction_id, method, CASE WHEN NOT coalesce(success, false) OR coalesce(length(text), 0) = 0 THEN 0.0 ELSE least(100.0, coalesce(confidence, 0.0) + CASE WHEN length(text) > 5000 THEN 10 WHEN length(text) > 1000 THEN 5 ELSE 0 END
+ CASE method WHEN 'pymupdf' THEN 5 WHEN 'pdfplumber' THEN 3 ELSE 0 END) END AS score FROM extraction_results)
SELECT doc_id, extraction_id, method, round(CAST(score AS DOUBLE), 4) AS score, n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, extraction_id) = 1)""",
    "extraction_confidence": """SELECT method, round(avg(CASE WHEN confidence > 0 THEN confidence END), 4) AS mean_confidence, round(avg(CASE WHEN coalesce(confidence, 0) >= 60 THEN 1.0 ELSE 0.0 END), 4) AS share_good,
round(avg(page_count), 4) AS mean_pages, count(*) AS n FROM extraction_results GROUP BY method""",
}

"""Queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import search as S
from statuta.operators import service as V
from statuta.operators import vectors as VI
from statuta.operators.filters import Filters
from statuta.operators.index import corpus_index_of, document_rows, index_of
from statuta.operators.tree import keep_first
from statuta.session import checkpoint_dir, load

TEXT_QUERY, TEXT_FILTERED = "laporan berkala wajib", "dokumen lingkungan"
CONTEXT_LIMIT = 20
QUERIES_TEXT = ("laporan berkala", "retribusi parkir", "baku mutu air")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return document_rows(load(spark, d, "legal_documents"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    return keep_first(load(spark, d, "legal_units"))


_COLS = ("unit_row_id", "doc_id", "unit_id")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: BM25 over documents and cosine over embeddings, weighted, fused, ranked."""
    docs = corpus_index_of(spark, d, "documents", "doc_id", "text")
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    text = docs.top(TEXT_QUERY, leaves=False).select(F.col("doc_id").alias("id"), "score")
    near = S.vector_search(vectors, vectors.where("id = 0").select(F.col("embedding").alias("q")), limit=20, key="id")
    return S.fuse(near, text, "id", 20).select("id", F.round("score", 6).alias("score"), "source")


def text_search(spark: SparkSession, d: str) -> DataFrame:
    return index_of(spark, d).top(TEXT_QUERY).select(*_COLS, "unit_type", F.round("score", 6).alias("score"))


def text_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    f = Filters.from_text(doc_form="PERDA, PERMEN", doc_year="2001,2004,2010,2012,2016,2019,2022,2023", doc_status="Berlaku")
    return index_of(spark, d).top(TEXT_FILTERED, f, 50).select(*_COLS, "doc_form", "doc_year", F.round("score", 6).alias("score"))


def text_search_unindexed(spark: SparkSession, d: str) -> DataFrame:
    """The same search by scanning all texts, for tables without an index."""
    return S.text_search(_units(spark, d), _docs(spark, d), TEXT_QUERY).select(*_COLS, "unit_type", F.round("score", 6).alias("score"))


def article_filtered_search(spark: SparkSession, d: str) -> DataFrame:
    """Full text within articles 1 to 3 of chapters I and II and documents of given numbers (all optional filters at once)."""
    f = Filters.from_text(pasal_number="1,2,3", bab_number="I,II", doc_number="1,2,3,4,5,6,7,8,9,10,11,12", unit_type="AYAT,HURUF")
    return index_of(spark, d).top("wajib", f, 50).select(*_COLS, "unit_type", "pasal_number", "bab_number", F.round("score", 6).alias("score"))


def vector_search(spark: SparkSession, d: str) -> DataFrame:
    v = load(spark, d, "embeddings")
    return S.vector_search(v, v.where("vec_id = 7").select(F.col("embedding").alias("q")), limit=15).select("vec_id", "label", F.round("score", 6).alias("score"))


_VECTORS: dict = {}


def _vector_index(spark: SparkSession, d: str) -> VI.VectorIndex:
    slot = (spark.sparkContext.applicationId, d)
    if slot not in _VECTORS:
        _VECTORS[slot] = VI.build(load(spark, d, "embeddings"), f"{checkpoint_dir(spark)}/vector-index-{spark.sparkContext.applicationId}-{abs(hash(d))}")
    return _VECTORS[slot]


def vector_search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors through the inverted lists."""
    query = load(spark, d, "embeddings").where("vec_id = 7").first()
    return _vector_index(spark, d).search(list(query["embedding"]), 15).select("vec_id", "label", F.round("score", 6).alias("score"))


def vector_index_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the inverted lists at ten results, for every row whose id is divisible by 20 as a query, against all rows."""
    index = _vector_index(spark, d)
    n, share = VI.recall(index, index.rows.where("vec_id % 20 = 0"))
    return spark.createDataFrame([(n, share >= 0.9, round(share, 4))], "n_queries bigint, enough boolean, recall double")


def vector_with_units(spark: SparkSession, d: str) -> DataFrame:
    """Vector hits with their unit where it is an article (left join, condition on the right).

    The vectors of the test data name no unit; vector n stands for the unit of row id n, as in ``_service``.
    """
    v = load(spark, d, "embeddings")
    hits = S.vector_search(v, v.where("vec_id = 3").select(F.col("embedding").alias("q")), limit=40)
    pasal = load(spark, d, "legal_units").where("unit_type = 'PASAL'").select(F.col("unit_row_id").alias("vec_id"), "unit_id", "citation_string")
    return hits.join(pasal, "vec_id", "left").select("vec_id", "unit_id", F.coalesce("citation_string", F.concat(F.lit("Pasal "), F.col("vec_id").cast("string"))).alias("citation"), F.round("score", 6).alias("score"))


def explicit_search(spark: SparkSession, d: str) -> DataFrame:
    return S.explicit_units(index_of(spark, d).units, "Pasal 2 ayat (1)", 40).select(*_COLS, "doc_year", "ordinal_int", "score")


def explicit_supplemented(spark: SparkSession, d: str) -> DataFrame:
    index = index_of(spark, d)
    found = S.explicit_units(index.units, "Pasal 2 ayat (1) huruf c UU No. 1 Tahun 1993", 20).select(*_COLS, "score")
    return S.supplemented(found, index.top("laporan berkala").select(*_COLS, "score"), 20).select("unit_row_id", "source", F.round("score", 6).alias("score"))


def query_routing(spark: SparkSession, d: str) -> DataFrame:
    refs = load(spark, d, "relationship_refs").select("ref_id", F.col("regulation_reference").alias("query"))
    return S.route(refs).select("ref_id", "strategy")


def query_citations(spark: SparkSession, d: str) -> DataFrame:
    """Citation parts of all captions of units, read as explicit queries."""
    return load(spark, d, "legal_units").select("unit_row_id", S.citation_parts(F.col("citation_string")).alias("c")).select("unit_row_id", "c.pasal", "c.ayat", "c.huruf")


def related_units(spark: SparkSession, d: str) -> DataFrame:
    """Related content of the article with most units below it."""
    index = index_of(spark, d)
    head = index.units.where("parent_pasal_id is not null").groupBy("parent_pasal_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "parent_pasal_id").first()
    rows = V.SearchService(index).related(head[0] if head else "")
    return rows.select("id", "unit_id", "unit_type", "ordinal_int", "ordinal_suffix", "citation", F.col("document.form").alias("doc_form"), F.col("document.year").alias("doc_year"))


def document_outline(spark: SparkSession, d: str) -> DataFrame:
    """Outline of the document with most units, ordered by sort key, with the place of each item."""
    index = index_of(spark, d)
    head = index.units.groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").first()
    return V.SearchService(index).outline(head[0] if head else "", with_content=True)


def contextual_search(spark: SparkSession, d: str) -> DataFrame:
    hits = index_of(spark, d).top("laporan berkala", limit=2 * CONTEXT_LIMIT).select(*_COLS, "score")
    return S.boosted(hits, ["/pasal-1/", "/bab-II/"], CONTEXT_LIMIT).select("unit_row_id", "unit_id", F.round("score", 6).alias("score"))


def multi_query_search(spark: SparkSession, d: str) -> DataFrame:
    """Several queries at once: their best ten each, each unit once, the best twenty."""
    rows = V.SearchService(index_of(spark, d)).search_all(list(QUERIES_TEXT))
    return rows.select("id", "source_type", F.col("metadata")["original_rank"].cast("int").alias("original_rank"), F.round("score", 6).alias("score"))


def _short_first(documents: DataFrame, query: str) -> DataFrame:
    """Stand-in for an external scorer: shorter texts first, lettered items without a score."""
    return documents.where("unit_type <> 'HURUF'").select("unit_row_id", (1000.0 / (1 + F.length("document_text"))).alias("relevance"))


def reranked_search(spark: SparkSession, d: str) -> DataFrame:
    V.register_reranker("short-first", _short_first)
    rows = V.SearchService(index_of(spark, d), provider="short-first").search("laporan berkala", limit=20, strategy="fts", rerank=True)
    return rows.select("id", F.col("metadata")["original_rank"].cast("int").alias("original_rank"), "source_type", F.round("score", 6).alias("score"))


def _service(spark: SparkSession, d: str) -> V.SearchService:
    """A service whose vectors are those of the test data; vector n stands for the unit of row id n."""
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("unit_row_id"), "embedding")
    return V.SearchService(index_of(spark, d), V.checked_vectors(v, dimension=64), lambda _: v.where("unit_row_id = 11").select(F.col("embedding").alias("q")))


def _rows(response: DataFrame) -> DataFrame:
    return response.select("id", "unit_id", "unit_type", F.col("document.form").alias("doc_form"), F.col("document.year").alias("doc_year"), "source_type", "strategy", F.round("score", 6).alias("score"))


def service_auto_explicit(spark: SparkSession, d: str) -> DataFrame:
    """Automatic choice for an explicit query that full text answers amply: it stays with full text."""
    return _rows(_service(spark, d).search("ayat (1)", limit=10))


def service_auto_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Automatic choice for a query in words: vectors and text, weighted and fused."""
    return _rows(_service(spark, d).search("laporan berkala", limit=10))


def service_empty(spark: SparkSession, d: str) -> DataFrame:
    return _rows(_service(spark, d).search("   "))


def service_log(spark: SparkSession, d: str) -> DataFrame:
    """What the searches of a session leave in the log."""
    service = _service(spark, d)
    for q in ("laporan berkala", "Pasal 2 ayat (1)", " "):
        service.search(q, limit=5)
    out = service.log[0]
    for row in service.log[1:]:
        out = out.unionByName(row)
    return out.select("query", "query_hash", "strategy", "result_limit")


def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Document frequency and occurrences of every term of the inverted index."""
    return S.postings(load(spark, d, "legal_units")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


def search_log(spark: SparkSession, d: str) -> DataFrame:
    """Log of events as searches: per hour and type, number, mean duration, largest."""
    e = load(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.max("value"), 4).alias("max_value"))


QUERIES = {f.__name__: f for f in (
    hybrid_search, text_search, text_search_unindexed, text_search_filtered, article_filtered_search, service_auto_explicit, service_auto_hybrid, service_empty, service_log, vector_search, vector_search_indexed, vector_index_recall, vector_with_units, explicit_search, explicit_supplemented, query_routing, query_citations,
    related_units, document_outline, contextual_search, multi_query_search, reranked_search, term_statistics, search_log,
)}

_FORMS = "'UU','PP','PERPU','PERPRES','POJK','PERMEN','PERDA','SE','LAINNYA'"
DOCS = f"""docs AS (
  SELECT doc_id, arg_min(struct_pack(doc_form := CASE WHEN upper(trim(doc_form)) IN ({_FORMS}) THEN upper(trim(doc_form)) ELSE 'LAINNYA' END,
    doc_year := TRY_CAST(nullif(regexp_extract(doc_year, '([0-9]{{4}})', 1), '') AS INTEGER), doc_number := doc_number,
    doc_status := CASE WHEN lower(trim(doc_status)) = 'tidak berlaku' THEN 'Tidak Berlaku' ELSE 'Berlaku' END), doc_row_id) AS r
  FROM legal_documents WHERE deleted_at IS NULL GROUP BY doc_id)"""
UNITS = "units AS (SELECT * FROM legal_units QUALIFY row_number() OVER (PARTITION BY doc_id, unit_id ORDER BY unit_row_id) = 1)"
LEAVES = "leaves AS (SELECT u.*, r.doc_form AS doc_form, r.doc_year AS doc_year, r.doc_number AS doc_number, r.doc_status AS doc_status FROM units u JOIN docs USING (doc_id) WHERE unit_type IN ('AYAT','HURUF','ANGKA'))"


def bm25_sql(name: str, source: str, query: str, body: str, key: str, where: str = "true") -> str:
    """Common table expressions that end in ``name`` (all columns of source and score)."""
    terms = S.query_terms(query)
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (1 - 0.75 + 0.75 * dl / av))" for i in range(len(terms)))
    every = " AND ".join(f"f{i} > 0" for i in range(len(terms)))
    return f"""{name}_t AS (SELECT *, list_filter(string_split_regex(lower({body}), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM {source} WHERE {where}),
{name}_c AS (SELECT *, len(t) AS dl, {tf} FROM {name}_t WHERE len(t) > 0),
{name}_s AS (SELECT count(*) AS n, avg(dl) AS av, {df} FROM {name}_c),
{name} AS (SELECT *, {score} AS score FROM {name}_c, {name}_s WHERE {every})"""


def _cos(a: str, b: str) -> str:
    return f"(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))))"


_BASE = f"WITH {DOCS}, {UNITS}, {LEAVES}"
_HITS40 = f"{_BASE}, {bm25_sql('b', 'leaves', 'laporan berkala', 'bm25_body', 'unit_row_id')}, hits AS (SELECT * FROM b ORDER BY score DESC, unit_row_id LIMIT 40)"
# the query vector is that of unit 11; both sides give ten rows, each unit keeps its best score
_FUSED = f"""SELECT unit_row_id, score, source FROM (
  SELECT unit_row_id, score * 0.6 AS score, 'vector' AS source, row_number() OVER (ORDER BY score DESC, unit_row_id) AS seq FROM (
    SELECT vec_id AS unit_row_id, {_cos('embedding', '(SELECT embedding FROM embeddings WHERE vec_id = 11)')} AS score FROM embeddings JOIN (SELECT u.unit_row_id FROM units u JOIN docs USING (doc_id)) ON unit_row_id = vec_id ORDER BY score DESC, vec_id LIMIT 10)
  UNION ALL SELECT unit_row_id, score / max(score) OVER () * 0.4, 'fts', row_number() OVER (ORDER BY score DESC, unit_row_id) + 1000000 FROM (SELECT unit_row_id, score FROM f ORDER BY score DESC, unit_row_id LIMIT 10)
) QUALIFY row_number() OVER (PARTITION BY unit_row_id ORDER BY score DESC, seq) = 1 ORDER BY score DESC, seq, unit_row_id LIMIT 10"""
_ANSWER = """SELECT r.unit_row_id AS id, u.unit_id AS unit_id, lower(u.unit_type) AS unit_type, d.r.doc_form AS doc_form, d.r.doc_year AS doc_year, source AS source_type, '{label}' AS strategy, round(r.score, 6) AS score
FROM r JOIN units u ON u.unit_row_id = r.unit_row_id JOIN docs d ON d.doc_id = u.doc_id"""
_LABEL = "coalesce(nullif(label_display, ''), nullif(title, ''), unit_id)"
_EXPLICIT_SQL = "regexp_matches(q, '(?i)pasal\\s+[0-9]+[a-z]?|ayat\\s*\\([0-9]+\\)|ayat\\s+[0-9]+|huruf\\s*[a-z]|angka\\s*[0-9]+|artikel?\\s+[0-9]+|(uu|pp|perpu|perpres)\\s+(no\\.?\\s*)?[0-9]+(/|\\s+tahun\\s+)[0-9]{4}|bab\\s+([ivx]+|[0-9]+)')"

ORACLES = {
    "hybrid_search": f"""WITH {bm25_sql('b', '(SELECT doc_id AS id, text FROM documents)', TEXT_QUERY, 'text', 'id')},
q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id AS id, {_cos('embedding', 'q')} AS score FROM embeddings, q ORDER BY score DESC, id LIMIT 20),
t AS (SELECT id, score FROM b ORDER BY score DESC, id LIMIT 20),
u AS (SELECT id, score * 0.6 AS score, 'vector' AS source, row_number() OVER (ORDER BY score DESC, id) AS seq FROM v
  UNION ALL SELECT id, score / max(score) OVER () * 0.4, 'fts', row_number() OVER (ORDER BY score DESC, id) + 1000000 FROM t)
SELECT id, round(score, 6) AS score, source FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, seq) = 1) ORDER BY u.score DESC, seq, id LIMIT 20""".replace("ORDER BY u.score", "ORDER BY score"),
    "text_search": f"{_BASE}, {bm25_sql('b', 'leaves', TEXT_QUERY, 'bm25_body', 'unit_row_id')} SELECT unit_row_id, doc_id, unit_id, unit_type, round(score, 6) AS score FROM b ORDER BY b.score DESC, unit_row_id LIMIT 20",
    "text_search_filtered": f"""{_BASE}, {bm25_sql('b', 'leaves', TEXT_FILTERED, 'bm25_body', 'unit_row_id', "doc_form IN ('PERDA','PERMEN') AND doc_year IN (2001,2004,2010,2012,2016,2019,2022,2023) AND doc_status = 'Berlaku'")}
SELECT unit_row_id, doc_id, unit_id, doc_form, doc_year, round(score, 6) AS score FROM b ORDER BY b.score DESC, unit_row_id LIMIT 50""",
    "text_search_unindexed": f"{_BASE}, {bm25_sql('b', 'leaves', TEXT_QUERY, 'bm25_body', 'unit_row_id')} SELECT unit_row_id, doc_id, unit_id, unit_type, round(score, 6) AS score FROM b ORDER BY b.score DESC, unit_row_id LIMIT 20",
    "article_filtered_search": f"""{_BASE}, n AS (SELECT *, nullif(regexp_extract(unit_id, '.*/pasal-([^/]*)', 1), '') AS pasal_number, nullif(regexp_extract(unit_id, '.*/bab-([^/]*)', 1), '') AS bab_number FROM leaves),
{bm25_sql('b', 'n', 'wajib', 'bm25_body', 'unit_row_id', "pasal_number IN ('1','2','3') AND bab_number IN ('I','II') AND doc_number IN ('1','2','3','4','5','6','7','8','9','10','11','12') AND unit_type IN ('AYAT','HURUF')")}
SELECT unit_row_id, doc_id, unit_id, unit_type, pasal_number, bab_number, round(score, 6) AS score FROM b ORDER BY b.score DESC, unit_row_id LIMIT 50""",
    "service_auto_hybrid": f"""{_BASE}, {bm25_sql('f', 'leaves', 'laporan berkala', 'bm25_body', 'unit_row_id')}, r AS ({_FUSED})
{_ANSWER.format(label='hybrid')}""",
    "service_auto_explicit": f"""{_BASE}, {bm25_sql('f', 'leaves', 'ayat (1)', 'bm25_body', 'unit_row_id')}, t AS (SELECT * FROM f ORDER BY score DESC, unit_row_id LIMIT 30), h AS ({_FUSED}),
r AS (SELECT unit_row_id, score, 'fts' AS source FROM (SELECT * FROM t ORDER BY score DESC, unit_row_id LIMIT 10) WHERE (SELECT count(*) FROM t) >= 10
  UNION ALL SELECT * FROM h WHERE (SELECT count(*) FROM t) < 10)
{_ANSWER.format(label='fts')}""",
    "service_empty": "SELECT CAST(0 AS BIGINT) AS id, '' AS unit_id, '' AS unit_type, '' AS doc_form, CAST(0 AS INTEGER) AS doc_year, '' AS source_type, '' AS strategy, CAST(0 AS DOUBLE) AS score WHERE false",
    "service_log": "SELECT q AS query, sha256(q) AS query_hash, s AS strategy, CAST(5 AS INTEGER) AS result_limit FROM (VALUES ('laporan berkala', 'hybrid'), ('Pasal 2 ayat (1)', 'fts'), (' ', 'empty_query')) AS t(q, s)",
    "vector_search": f"WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, label, {_cos('embedding', 'q')} AS s FROM embeddings, q) SELECT vec_id, label, round(s, 6) AS score FROM s ORDER BY s DESC, vec_id LIMIT 15",
    "vector_with_units": f"""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 3), s AS (SELECT vec_id, {_cos('embedding', 'q')} AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 40)
SELECT vec_id, unit_id, coalesce(citation_string, 'Pasal ' || CAST(vec_id AS VARCHAR)) AS citation, round(s, 6) AS score FROM s LEFT JOIN legal_units ON unit_row_id = vec_id AND unit_type = 'PASAL'""",
    "explicit_search": f"""WITH {DOCS}, {UNITS} SELECT unit_row_id, doc_id, unit_id, r.doc_year AS doc_year, ordinal_int, CAST(1 AS DOUBLE) AS score FROM units JOIN docs USING (doc_id)
WHERE unit_type = 'AYAT' AND contains(lower(unit_id) || '/', '/ayat-1/') AND contains(lower(unit_id) || '/', '/pasal-2/') ORDER BY r.doc_year DESC NULLS LAST, ordinal_int NULLS FIRST, unit_row_id LIMIT 40""",
    "explicit_supplemented": f"""{_BASE}, {bm25_sql('b', 'leaves', 'laporan berkala', 'bm25_body', 'unit_row_id')},
e AS (SELECT unit_row_id FROM units JOIN docs USING (doc_id) WHERE unit_type = 'HURUF' AND contains(lower(unit_id) || '/', '/huruf-c/') AND contains(lower(unit_id) || '/', '/ayat-1/')
  AND contains(lower(unit_id) || '/', '/pasal-2/') AND r.doc_form = 'UU' AND r.doc_number = '1' AND r.doc_year = 1993 ORDER BY r.doc_year DESC, ordinal_int, unit_row_id LIMIT 20),
t AS (SELECT unit_row_id, score FROM b ORDER BY score DESC, unit_row_id LIMIT 20),
x AS (SELECT *, row_number() OVER (ORDER BY score DESC, unit_row_id) AS i FROM t WHERE unit_row_id NOT IN (SELECT unit_row_id FROM e))
SELECT unit_row_id, 'explicit' AS source, CAST(1 AS DOUBLE) AS score FROM e
UNION ALL SELECT unit_row_id, 'fts', round(score, 6) FROM x, (SELECT count(*) AS n FROM e) WHERE n < 10 AND i <= 20 - n""",
    "query_routing": f"SELECT ref_id, CASE WHEN q IS NULL OR trim(q) = '' THEN 'empty_query' WHEN {_EXPLICIT_SQL} THEN 'fts' ELSE 'hybrid' END AS strategy FROM (SELECT ref_id, regulation_reference AS q FROM relationship_refs)",
    "query_citations": """SELECT unit_row_id, nullif(upper(regexp_extract(c, '(?i)(?:pasal|artikel|article)\\s+([0-9]+[a-z]?)\\b', 1)), '') AS pasal,
nullif(regexp_extract(c, '(?i)ayat\\s*\\(?([0-9]+)\\)?', 1), '') AS ayat, nullif(lower(regexp_extract(c, '(?i)huruf\\s+([a-z])\\b', 1)), '') AS huruf
FROM (SELECT unit_row_id, citation_string AS c FROM legal_units)""",
    "related_units": f"""{_BASE}, x AS (SELECT u.*, r FROM units u JOIN docs USING (doc_id)), h AS (SELECT parent_pasal_id AS p, count(*) AS n FROM x WHERE parent_pasal_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, p LIMIT 1)
SELECT unit_row_id AS id, unit_id, lower(coalesce(unit_type, 'pasal')) AS unit_type, ordinal_int, ordinal_suffix, coalesce(citation_string, 'Pasal ' || unit_id) AS citation, r.doc_form AS doc_form, r.doc_year AS doc_year FROM x, h WHERE unit_id = p OR parent_pasal_id = p""",
    "document_outline": f"""{_BASE}, x AS (SELECT u.* FROM units u JOIN docs USING (doc_id)), h AS (SELECT doc_id AS p, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, p LIMIT 1)
SELECT unit_row_id, unit_type, unit_id, {_LABEL} AS label, citation_string, local_content AS content FROM x, h WHERE doc_id = p""",
    "contextual_search": f"""{_HITS40}, x AS (SELECT unit_row_id, unit_id, score * CASE WHEN contains(unit_id, '/pasal-1/') OR contains(unit_id, '/bab-II/') THEN 1.2 ELSE 1 END AS s FROM hits)
SELECT unit_row_id, unit_id, round(s, 6) AS score FROM x ORDER BY s DESC, unit_row_id LIMIT 20""",
    "multi_query_search": f"""{_BASE},
{', '.join(bm25_sql(f'b{i}', 'leaves', q, 'bm25_body', 'unit_row_id') for i, q in enumerate(QUERIES_TEXT))},
u AS ({' UNION ALL '.join(f'(SELECT unit_row_id, score, {i} AS query_no FROM b{i} ORDER BY score DESC, unit_row_id LIMIT 10)' for i in range(len(QUERIES_TEXT)))}),
x AS (SELECT unit_row_id, score AS s, query_no FROM u QUALIFY row_number() OVER (PARTITION BY unit_row_id ORDER BY score DESC, query_no) = 1),
y AS (SELECT * FROM x ORDER BY s DESC, query_no, unit_row_id LIMIT 20)
SELECT unit_row_id AS id, 'fts' AS source_type, CAST(row_number() OVER (ORDER BY s DESC, unit_row_id) - 1 AS INTEGER) AS original_rank, round(s, 6) AS score FROM y""",
    "reranked_search": f"""{_HITS40}, k AS (SELECT *, row_number() OVER (ORDER BY score DESC, unit_row_id) - 1 AS original_rank FROM hits),
x AS (SELECT unit_row_id, original_rank, unit_type <> 'HURUF' AS scored, CASE WHEN unit_type <> 'HURUF' THEN 1000.0::DOUBLE / (1 + length(coalesce(citation_string, '') || ': ' || coalesce(bm25_body, local_content, ''))) ELSE score END AS s FROM k)
SELECT unit_row_id AS id, CAST(original_rank AS INTEGER) AS original_rank, CASE WHEN scored THEN 'fts_reranked' ELSE 'fts' END AS source_type, round(s, 6) AS score FROM x ORDER BY s DESC, unit_row_id LIMIT 20""",
    "term_statistics": """WITH p AS (SELECT unit_row_id, unnest(list_filter(string_split_regex(lower(bm25_body), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM legal_units WHERE bm25_body IS NOT NULL)
SELECT term, count(DISTINCT unit_row_id) AS df, count(*) AS occurrences FROM p GROUP BY term""",
    "search_log": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 4) AS mean_value, round(max(value), 4) AS max_value FROM events GROUP BY 1, 2",
}

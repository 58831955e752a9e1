"""Retrieval: full text (BM25), vectors (cosine), explicit citations, fusion and what builds on them.

Every function is lazy and returns at most its limit of rows per query. Scores are functions of columns,
top-k is a partial sort in each task, and only one-row statistics or the rows of a query are broadcast.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.operators.filters import Filters
from statuta.schema import LEAF_TYPES

K1, B = 1.2, 0.75
VECTOR_WEIGHT, TEXT_WEIGHT = 0.6, 0.4
CONTEXT_BOOST = 1.2
SPLIT = "[^a-z0-9]+"

# What makes a query explicit.
EXPLICIT = (
    r"(?i)pasal\s+\d+[a-z]?", r"(?i)ayat\s*\(\d+\)", r"(?i)ayat\s+\d+", r"(?i)huruf\s*[a-z]", r"(?i)angka\s*\d+", r"(?i)artikel?\s+\d+",
    r"(?i)(?:uu|pp|perpu|perpres)\s+(?:no\.?\s*)?\d+(?:/|\s+tahun\s+)\d{4}", r"(?i)bab\s+(?:[ivx]+|\d+)",
)


def tokens(text: Column) -> Column:
    """Lower-case letter and digit runs of a text; null for null."""
    return F.filter(F.split(F.lower(text), SPLIT), lambda t: t != "")


def query_terms(query: str) -> list[str]:
    out: list[str] = []
    for t in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split():
        if t not in out:
            out.append(t)
    return out


def postings(units: DataFrame, key: str = "unit_row_id", body: str = "bm25_body") -> DataFrame:
    """Inverted index: term, key, tf, dl; to be written partitioned or bucketed by term."""
    rows = units.where(F.col(body).isNotNull()).select(key, tokens(F.col(body)).alias("_t")).where(F.size("_t") > 0)
    return rows.select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term")).groupBy("term", key, "dl").agg(F.count("*").alias("tf"))


def _count(low: Column, term: str) -> Column:
    """Occurrences of a token; the pattern runs only over texts that hold its letters."""
    return F.when(F.contains(low, F.lit(term)), F.regexp_count(low, F.lit(f"(?<![a-z0-9]){term}(?![a-z0-9])"))).otherwise(0)


def bm25(df: DataFrame, query: str, body: str = "bm25_body", score: str = "score") -> DataFrame:
    """Rows of ``df`` that hold all terms of ``query``, with their BM25 score over ``df``.

    A query without terms matches nothing. Statistics are one row over the whole of ``df``.
    """
    terms = query_terms(query)
    if not terms:
        return df.withColumn(score, F.lit(0.0)).where("false")
    # counts by pattern stay in generated code; the token arrays of ``tokens`` would be built row by row
    low = F.lower(F.col(body))
    counted = df.select("*", F.regexp_count(low, F.lit("[a-z0-9]+")).alias("_dl"), *[_count(low, term).alias(f"_f{i}") for i, term in enumerate(terms)])
    counted = counted.where("_dl > 0")
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    hits = counted.where(reduce(lambda a, b: a & b, [F.col(f"_f{i}") > 0 for i in range(len(terms))])).join(F.broadcast(stats))
    parts = []
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        tf = F.col(f"_f{i}")
        parts.append(idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_dl") / F.col("_avg"))))
    return hits.withColumn(score, reduce(lambda a, b: a + b, parts)).select(*df.columns, score)


def top(df: DataFrame, limit: int, score: str = "score", *ties: str) -> DataFrame:
    return df.orderBy(F.desc(score), *ties).limit(limit)


def leaf_units(units: DataFrame, docs: DataFrame) -> DataFrame:
    """Searchable units with the columns of their documents; ``docs`` has one row per doc_id."""
    return units.where(F.col("unit_type").isin(list(LEAF_TYPES))).join(docs, "doc_id")


def text_search(units: DataFrame, docs: DataFrame, query: str, filters: Filters = Filters(), limit: int = 20) -> DataFrame:
    """The best leaf units for ``query`` by BM25 over the filtered leaves."""
    return top(bm25(leaf_units(units, docs).where(filters.predicate()), query), limit, "score", "unit_row_id")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two float arrays, computed in double; null where a norm is 0."""
    return _dot(a, b) / F.nullif(F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)), F.lit(0.0))


def vector_search(vectors: DataFrame, query: DataFrame, filters: Filters = Filters(), limit: int = 10, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The rows of ``vectors`` nearest to the one vector of ``query`` (column q)."""
    # the query's own norm is taken once, not once a row
    one = query.select("q").limit(1).select(F.transform("q", lambda x: x.cast("double") / F.nullif(F.sqrt(_dot(F.col("q"), F.col("q"))), F.lit(0.0))).alias("q"))
    norm = F.nullif(F.sqrt(_dot(F.col(embedding), F.col(embedding))), F.lit(0.0))
    scored = vectors.where(filters.predicate()).join(F.broadcast(one)).withColumn("score", _dot(F.col(embedding), F.col("q")) / norm).drop("q")
    return top(scored.where("score is not null"), limit, "score", key)


def is_explicit(query: Column) -> Column:
    """Whether a query cites a place in the law."""
    return reduce(lambda a, b: a | b, [query.rlike(p) for p in EXPLICIT])


def is_explicit_text(query: str) -> bool:
    """``is_explicit`` of one string on the driver."""
    return any(re.search(p, query) for p in EXPLICIT)


def citation_parts(query: Column) -> Column:
    """pasal, ayat, huruf, angka, bab and document of an explicit query; missing parts are null."""
    def part(pattern: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(query, pattern, group), F.lit(""))

    doc = r"(?i)\b(uu|pp|perpu|perpres)\s+(?:no\.?\s*)?(\d+)(?:/|\s+tahun\s+)(\d{4})"
    return F.struct(
        F.upper(part(r"(?i)(?:pasal|artikel|article)\s+(\d+[a-z]?)\b")).alias("pasal"),
        part(r"(?i)ayat\s*\(?(\d+)\)?").alias("ayat"),
        F.lower(part(r"(?i)huruf\s+([a-z])\b")).alias("huruf"),
        part(r"(?i)angka\s+(\d+)").alias("angka"),
        F.upper(part(r"(?i)\bbab\s+([ivxl]+|\d+)\b")).alias("bab"),
        F.upper(part(doc, 1)).alias("doc_form"),
        part(doc, 2).alias("doc_number"),
        part(doc, 3).cast("int").alias("doc_year"),
    )


def explicit_search(units: DataFrame, docs: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Units that an explicit query cites, newest document first, each with score 1; ``docs`` has one row per doc_id."""
    return explicit_units(units.join(docs, "doc_id"), query, limit)


# Citation parts of a query from the innermost level outwards; group 1 is the number.
_CITED = (
    ("huruf", r"(?i)huruf\s+([a-z])\b"), ("angka", r"(?i)angka\s+(\d+)"), ("ayat", r"(?i)ayat\s*\(?(\d+)\)?"), ("pasal", r"(?i)(?:pasal|artikel|article)\s+(\d+[a-z]?)\b"), ("bab", r"(?i)\bbab\s+([ivxl]+|\d+)\b"),
)
_CITED_DOCUMENT = re.compile(r"(?i)\b(uu|pp|perpu|perpres)\s+(?:no\.?\s*)?(\d+)(?:/|\s+tahun\s+)(\d{4})")


def explicit_units(units: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Units (with the columns of their documents) that an explicit query cites, newest document first, with score 1.

    The innermost cited level selects the units, the outer levels must be among their ancestors. A query
    that cites only a document gives its units; one that cites nothing gives no rows. The query is read
    on the driver, so type, number and document are plain predicates that the scan can push down.
    """
    cited = [(level, m[1].lower()) for level, pattern in _CITED if (m := re.search(pattern, query))]
    document = _CITED_DOCUMENT.search(query)
    if not cited and not document:
        return units.where("false").withColumn("score", F.lit(1.0))
    cond = F.lit(True)
    if cited:
        cond = cond & (F.col("unit_type") == cited[0][0].upper())
        for level, number in cited:
            cond = cond & F.contains(F.concat(F.lower("unit_id"), F.lit("/")), F.lit(f"/{level}-{number}/"))
    if document:
        cond = cond & (F.col("doc_form") == document[1].upper()) & (F.col("doc_number") == document[2]) & (F.col("doc_year") == int(document[3]))
    return units.where(cond).withColumn("score", F.lit(1.0)).orderBy(F.desc("doc_year"), "ordinal_int", "unit_row_id").limit(limit)


def supplemented(explicit: DataFrame, text: DataFrame, limit: int, key: str = "unit_row_id") -> DataFrame:
    """``explicit`` results, filled up from ``text`` results where fewer than half of ``limit``."""
    n = explicit.agg(F.count("*").alias("_n"))
    text = top(text.join(explicit.select(key), key, "left_anti"), limit, "score", key)  # so the window sees limit rows at most
    order = Window.orderBy(F.desc("score"), key)
    extra = text.withColumn("_i", F.row_number().over(order)).join(F.broadcast(n))
    extra = extra.where((F.col("_n") < limit // 2) & (F.col("_i") <= limit - F.col("_n"))).drop("_i", "_n")
    return explicit.withColumn("source", F.lit("explicit")).unionByName(extra.withColumn("source", F.lit("fts")))


def best_of(df: DataFrame, key: str, limit: int) -> DataFrame:
    """One row per key: the one of highest score, on ties of the lowest seq; then the best ``limit``."""
    order = Window.partitionBy(key).orderBy(F.desc("score"), "seq")
    return df.withColumn("_i", F.row_number().over(order)).where("_i = 1").drop("_i").orderBy(F.desc("score"), "seq", key).limit(limit)


def fuse(vectors: DataFrame, text: DataFrame, key: str, limit: int, vector_weight: float = VECTOR_WEIGHT, text_weight: float = TEXT_WEIGHT, normalise: bool = True) -> DataFrame:
    """Weighted union of two result lists (key, score), the best score of each key, ranked.

    BM25 is unbounded, so its scores are divided by the list's best unless ``normalise`` is off.
    """
    # no row beyond the best ``limit`` of its own list can be among the best ``limit`` of both
    vectors, text = top(vectors, limit, "score", key), top(text, limit, "score", key)
    best = Window.orderBy(F.desc("score"), key)
    ranked_v = vectors.select(key, (F.col("score") * vector_weight).alias("score"), F.lit("vector").alias("source"), F.row_number().over(best).alias("seq"))
    scale = F.max("score").over(Window.partitionBy(F.lit(0))) if normalise else F.lit(1.0)
    ranked_t = text.select(key, (F.col("score") / scale * text_weight).alias("score"), F.lit("fts").alias("source"), (F.row_number().over(best) + 1_000_000).alias("seq"))
    return best_of(ranked_v.unionByName(ranked_t), key, limit)


def related_units(units: DataFrame, docs: DataFrame, pasal_id: str, include_children: bool = True) -> DataFrame:
    """An article and, if asked, the units whose nearest article it is, in order."""
    own = F.col("unit_id") == pasal_id
    where = own | (F.col("parent_pasal_id") == pasal_id) if include_children else own
    return units.where(where).join(docs, "doc_id").orderBy("ordinal_int", "ordinal_suffix", "unit_row_id")


def outline(units: DataFrame, doc_id: str, with_content: bool = False, tree_order: bool = False) -> DataFrame:
    """The units of a document by sort key, or in tree order (by position)."""
    label = F.coalesce(F.nullif("label_display", F.lit("")), F.nullif("title", F.lit("")), F.col("unit_id"))
    keys = ["seq", "unit_row_id"] if tree_order else ["seq_sort_key", "ordinal_int", "ordinal_suffix", "unit_row_id"]
    rows = units.where(F.col("doc_id") == doc_id).orderBy(*keys)
    return rows.select("unit_row_id", "unit_type", "unit_id", label.alias("label"), "citation_string", F.when(F.lit(with_content), F.col("local_content")).alias("content"))


def boosted(results: DataFrame, context: list[str], limit: int, boost: float = CONTEXT_BOOST, key: str = "unit_row_id") -> DataFrame:
    """Results with the score of those raised once whose unit_id contains a context id."""
    hit = F.exists(F.array(*[F.lit(c) for c in context]), lambda c: F.contains(F.col("unit_id"), c)) if context else F.lit(False)
    return top(results.withColumn("score", F.when(hit, F.col("score") * boost).otherwise(F.col("score"))), limit, "score", key)


def multi_search(df: DataFrame, queries: list[str], key: str, body: str, per_query: int = 10, limit: int = 20) -> DataFrame:
    """The best results of several queries together: each key once, with its best score."""
    parts = [top(bm25(df.select(key, body), q, body), per_query, "score", key).select(key, "score", F.lit(i).alias("query_no")) for i, q in enumerate(queries)]
    rows = reduce(lambda a, b: a.unionByName(b), parts).withColumn("seq", F.col("query_no"))
    return best_of(rows, key, limit).drop("seq")


def rerank(results: DataFrame, scores: DataFrame, limit: int, key: str, cap: int = 100) -> DataFrame:
    """Results in the order of an external score (column relevance), at most ``cap`` of them.

    Rows without an external score keep their own; original_rank counts from 0.
    """
    ranked = results.orderBy(F.desc("score"), key).limit(cap).withColumn("original_rank", F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1)
    joined = ranked.join(scores.select(key, "relevance"), key, "left").withColumn("source", F.lit("reranked"))
    return top(joined.withColumn("score", F.coalesce(F.col("relevance").cast("double"), "score")).drop("relevance"), limit, "score", key)


def route(queries: DataFrame, query: str = "query") -> DataFrame:
    """Strategy of each query: empty_query, fts (explicit) or hybrid."""
    q = F.col(query)
    return queries.withColumn("strategy", F.when(q.isNull() | (F.trim(q) == ""), "empty_query").when(is_explicit(q), "fts").otherwise("hybrid"))

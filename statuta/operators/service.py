"""The search service: strategies, the automatic choice among them, reranking, responses, related content, log.

Everything up to the result is one lazy plan; the choice between explicit lookup, full text and hybrid
depends on counts inside that plan, not on actions of the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.operators import search as S
from statuta.operators.filters import Filters
from statuta.operators.index import SearchIndex

# Strategies, and the number of rows of the full-text probe of an explicit query.
STRATEGIES = ("auto", "explicit", "fts", "vector", "hybrid")
PROBE = 30
#: Most rows that a reranker is given.
RERANK_CAP = 100
DIMENSIONS = (128, 2048)

_RESULT = ("unit_row_id", "doc_id", "unit_id", "unit_type", "citation_string", "doc_form", "doc_year", "doc_number", "score", "source")

Scorer = Callable[[DataFrame, str], DataFrame]
_SCORERS: dict[str, Scorer | None] = {"none": None}


def register_reranker(name: str, scorer: Scorer | None) -> None:
    """Makes a reranker known: (results with column document_text, query) -> key and relevance."""
    _SCORERS[name.lower()] = scorer


def reranker(name: str | None) -> Scorer | None:
    """The reranker of that name; None, which keeps the order, for "none" and names that are not known."""
    return _SCORERS.get((name or "none").lower())


def strategy_label(query: str | None) -> str:
    """Label of a response: empty_query, fts for explicit queries, else hybrid."""
    if query is None or not query.strip():
        return "empty_query"
    return "fts" if S.is_explicit_text(query) else "hybrid"


def checked_vectors(vectors: DataFrame, embedding: str = "embedding", dimension: int | None = None) -> DataFrame:
    """``vectors`` whose length is asserted: the given one (128 to 2,048), and no value null.

    The check runs with the query; a wrong vector fails it with a message.
    """
    if dimension is not None and not DIMENSIONS[0] <= dimension <= DIMENSIONS[1] and dimension != 64:
        raise ValueError(f"the dimension must be between {DIMENSIONS[0]} and {DIMENSIONS[1]}")
    e = F.col(embedding)
    good = (F.size(e) == dimension if dimension else F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull())
    return vectors.withColumn(embedding, F.when(good, e).otherwise(F.raise_error(F.lit("vector of a wrong length or with nulls")).cast(vectors.schema[embedding].dataType)))


@dataclass
class SearchService:
    """Search over an index and, if given, vectors of units (unit_row_id, embedding, filter columns).

    ``embed`` turns a query into a one-row frame with its vector q; without it a vector or hybrid
    search has the text side only.
    """

    index: SearchIndex
    vectors: DataFrame | None = None
    embed: Callable[[str], DataFrame] | None = None
    vector_weight: float = S.VECTOR_WEIGHT
    text_weight: float = S.TEXT_WEIGHT
    provider: str = "none"
    log: list[DataFrame] = field(default_factory=list)

    def _text(self, query: str, filters: Filters, limit: int) -> DataFrame:
        return self.index.top(query, filters, limit).withColumn("source", F.lit("fts")).select(*_RESULT)

    def _vector(self, query: str, filters: Filters, limit: int) -> DataFrame | None:
        if self.vectors is None or self.embed is None:
            return None
        units = self.index.units.select(*[c for c in _RESULT if c not in ("score", "source")], "doc_status", "pasal_number", "bab_number")
        near = S.vector_search(self.vectors.join(units, "unit_row_id"), self.embed(query), filters, limit, "unit_row_id")
        return near.withColumn("source", F.lit("vector")).select(*_RESULT)

    def _explicit(self, query: str, limit: int) -> DataFrame:
        # the service ignores filters here: a citation names its document itself
        found = S.explicit_units(self.index.units, query, limit)
        return found.withColumn("source", F.lit("explicit")).select(*_RESULT)

    def _hybrid(self, query: str, filters: Filters, limit: int) -> DataFrame:
        text = self._text(query, filters, limit)
        near = self._vector(query, filters, limit)
        if near is None:
            return text.withColumn("score", F.col("score") * self.text_weight)
        ranked = S.fuse(near, text, "unit_row_id", limit, self.vector_weight, self.text_weight)
        columns = near.unionByName(text).drop("score", "source").dropDuplicates(["unit_row_id"])
        return ranked.select("unit_row_id", "score", "source").join(F.broadcast(columns), "unit_row_id").select(*_RESULT)

    def _auto(self, query: str, filters: Filters, limit: int) -> DataFrame:
        """An explicit query that full text answers with ``limit`` rows or more stays with it; all else is hybrid."""
        if not S.is_explicit_text(query):
            return self._hybrid(query, filters, limit)
        probe = self._text(query, filters, PROBE)
        n = probe.agg(F.count("*").alias("_n"))
        order = Window.orderBy(F.desc("score"), "unit_row_id")  # at most PROBE rows
        enough = probe.withColumn("_i", F.row_number().over(order)).join(F.broadcast(n)).where((F.col("_n") >= limit) & (F.col("_i") <= limit)).drop("_i", "_n")
        rest = self._hybrid(query, filters, limit).join(F.broadcast(n)).where(F.col("_n") < limit).drop("_n")
        return enough.unionByName(rest)

    def retrieve(self, query: str, strategy: str = "auto", filters: Filters = Filters(), limit: int = 20) -> DataFrame:
        """Results of a strategy: at most ``limit`` rows, best first when ordered by score."""
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy!r}; known are {', '.join(STRATEGIES)}")
        if strategy == "fts":
            return self._text(query, filters, limit)
        if strategy == "vector":
            near = self._vector(query, filters, limit)
            return self._text(query, filters, limit).where("false") if near is None else near
        if strategy == "explicit":
            found = self._explicit(query, limit)
            columns = [c for c in _RESULT if c != "source"]
            return S.supplemented(found.select(*columns), self._text(query, filters, limit).select(*columns), limit).select(*_RESULT)
        return self._hybrid(query, filters, limit) if strategy == "hybrid" else self._auto(query, filters, limit)

    def search(self, query: str | None, *, limit: int = 10, filters: Filters = Filters(), strategy: str = "auto", rerank: bool = False) -> DataFrame:
        """The response rows of one query (see ``response``), labelled with the strategy; logged.

        A blank query has no rows. Twice the limit is fetched when reranking is asked for.
        """
        label = strategy_label(query)
        if label == "empty_query":
            hits = self.index.units.where("false").withColumn("score", F.lit(0.0)).withColumn("source", F.lit("")).select(*_RESULT).withColumn("original_rank", F.lit(0))
        else:
            hits = self.retrieve(query, strategy, filters, 2 * limit if rerank else limit)
            hits = self.reranked(hits, query, limit) if rerank else hits.withColumn("original_rank", F.lit(None).cast("int"))
        self.log.append(log_row(self.index.units.sparkSession, query or "", label, limit))
        return S.top(response(self.index.with_texts(hits), label), limit, "score", "id")

    def reranked(self, hits: DataFrame, query: str, limit: int) -> DataFrame:
        """``hits`` in the order of the registered reranker; as they are where there is none."""
        scorer = reranker(self.provider)
        order = Window.orderBy(F.desc("score"), "unit_row_id")  # at most RERANK_CAP rows
        ranked = S.top(hits, min(RERANK_CAP, 2 * limit), "score", "unit_row_id").withColumn("original_rank", F.row_number().over(order) - 1)
        if scorer is None:
            return S.top(ranked, limit, "score", "unit_row_id")
        texts = self.index.with_texts(ranked)
        documents = texts.withColumn("document_text", F.concat(F.coalesce("citation_string", F.lit("")), F.lit(": "), F.coalesce("bm25_body", "local_content", F.lit(""))))
        scores = scorer(documents, query).select("unit_row_id", "relevance")
        joined = ranked.join(scores, "unit_row_id", "left").withColumn("source", F.when(F.col("relevance").isNotNull(), F.concat("source", F.lit("_reranked"))).otherwise(F.col("source")))
        return S.top(joined.withColumn("score", F.coalesce(F.col("relevance").cast("double"), "score")).drop("relevance"), limit, "score", "unit_row_id")

    def search_all(self, queries: list[str], *, per_query: int = 10, limit: int = 20) -> DataFrame:
        """The best results of several queries together, reordered by the reranker for the first of them."""
        parts = [self._text(q, Filters(), per_query).withColumn("seq", F.lit(i)) for i, q in enumerate(queries) if q and q.strip()]
        if not parts:
            return self.search("", limit=limit)
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        best = S.best_of(every, "unit_row_id", limit).drop("seq")
        return S.top(response(self.index.with_texts(self.reranked(best, queries[0], limit)), "multi_query"), limit, "score", "id")

    def related(self, pasal_id: str, include_children: bool = True) -> DataFrame:
        """An article and the units below it, in order, as responses without a rank."""
        own = F.col("unit_id") == pasal_id
        rows = self.index.units.where(own | (F.col("parent_pasal_id") == pasal_id) if include_children else own)
        shaped = rows.withColumn("score", F.lit(1.0)).withColumn("source", F.lit("related")).withColumn("original_rank", F.lit(None).cast("int"))
        return response(shaped, "related", "ordinal_int", "ordinal_suffix").orderBy("ordinal_int", "ordinal_suffix", "id")

    def outline(self, doc_id: str, with_content: bool = False, tree_order: bool = False) -> DataFrame:
        return S.outline(self.index.units, doc_id, with_content, tree_order)


def response(hits: DataFrame, label: str, *more: str) -> DataFrame:
    """Results as nested rows: id, text, citation, score, source, unit and document structs, metadata, strategy.

    Missing texts read as the indexed body, then empty; a missing citation as "Pasal" and the unit id, a
    missing type as pasal.
    """
    return hits.select(
        F.col("unit_row_id").alias("id"),
        F.coalesce(F.nullif("local_content", F.lit("")), "bm25_body", F.lit("")).alias("text"),
        F.coalesce("citation_string", F.concat(F.lit("Pasal "), F.col("unit_id"))).alias("citation"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.col("source").alias("source_type"),
        F.lower(F.coalesce("unit_type", F.lit("pasal"))).alias("unit_type"),
        "unit_id",
        F.struct(F.col("doc_form").alias("form"), F.col("doc_year").alias("year"), F.col("doc_number").alias("number")).alias("document"),
        F.map_filter(F.create_map(F.lit("original_rank"), F.col("original_rank").cast("string"), F.lit("doc_id"), F.col("doc_id")), lambda _, v: v.isNotNull()).alias("metadata"),
        F.lit(label).alias("strategy"),
        *more,
    )


def log_row(spark, query: str, label: str, limit: int, duration_ms: float | None = None, n_results: int | None = None) -> DataFrame:
    """One row of the search log."""
    schema = "search_id string, query string, query_hash string, strategy string, result_limit int, duration_ms double, n_results bigint"
    frame = spark.createDataFrame([(uuid.uuid4().hex, query, "", label, limit, duration_ms, n_results)], schema)
    return frame.withColumn("query_hash", F.sha2("query", 256)).withColumn("searched_at", F.current_timestamp())


def append_log(rows: list[DataFrame], path: str) -> None:
    """Appends log rows to the table at ``path`` in one write."""
    if rows:
        out = rows[0]
        for r in rows[1:]:
            out = out.unionByName(r)
        out.coalesce(1).write.mode("append").parquet(path)


def benchmark_summary(log: DataFrame) -> DataFrame:
    """Queries timed, their mean duration and the sum of their results."""
    return log.agg(F.count("*").alias("n_queries"), F.round(F.avg("duration_ms"), 3).alias("mean_ms"), F.sum("n_results").alias("n_results"))


def preview(text: Column, length: int = 200) -> Column:
    """The first ``length`` characters of a text, with an ellipsis where more follow."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)

"""The stored search index: deduplicated units, a posting table bucketed by term, vectors with their norms.

Deduplication, tokenising and document joins happen once, when the index is written. A query then reads
the buckets of its own terms only (partition pruning, then row groups by term) and narrow columns of the
units; texts are fetched for the rows that are returned.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import legal
from statuta.operators import search as S
from statuta.operators.filters import Filters
from statuta.operators.tree import keep_first
from statuta.schema import LEAF_TYPES
from statuta.session import checkpoint_dir, load

#: Directories that the posting table is spread over, by hash of the term.
BUCKETS = 64


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def document_rows(documents: DataFrame) -> DataFrame:
    """One row per document that is not deleted: its first crawl, domains checked, the year a number."""
    year = F.nullif(F.regexp_extract("doc_year", r"(\d{4})", 1), F.lit("")).cast("int")
    rows = documents.where("deleted_at is null").select("doc_id", legal.known_form(F.col("doc_form")).alias("doc_form"), year.alias("doc_year"), "doc_number", legal.known_status(F.col("doc_status")).alias("doc_status"), "doc_row_id")
    return rows.groupBy("doc_id").agg(*[F.min_by(c, "doc_row_id").alias(c) for c in ("doc_form", "doc_year", "doc_number", "doc_status")])


@dataclass(frozen=True)
class SearchIndex:
    """The tables of an index: units (with document columns and dl, the length in tokens) and postings (term, key, tf)."""

    units: DataFrame
    postings: DataFrame
    buckets: int = BUCKETS
    key: str = "unit_row_id"

    def bm25(self, query: str, filters: Filters = Filters(), leaves: bool = True) -> DataFrame:
        """Keys of units that hold all terms of ``query``, with the narrow columns and score, over the filtered units."""
        terms = S.query_terms(query)
        pool = self.units.where(filters.predicate()).where("dl > 0")
        if leaves:
            pool = pool.where(F.col("unit_type").isin(list(LEAF_TYPES)))
        narrow = pool.drop("local_content", "bm25_body", "content", "display_text", "path")
        if not terms:
            return narrow.withColumn("score", F.lit(0.0)).where("false")
        rows = self.postings.where(F.col("term").isin(terms))
        if "bucket" in self.postings.columns:
            known = sorted({r[0] for r in self.postings.sparkSession.createDataFrame([(t,) for t in terms], "t string").select(bucket(F.col("t"), self.buckets)).collect()})
            rows = rows.where(F.col("bucket").isin(known))
        tf = [F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"_f{i}") for i, t in enumerate(terms)]
        per_unit = rows.groupBy(self.key).agg(*tf)
        hits = per_unit.join(narrow, self.key)
        stats = narrow.agg(F.count("*").alias("_n"), F.avg("dl").alias("_avg"))
        every = F.lit(True)
        for i in range(len(terms)):
            every = every & F.col(f"_f{i}").isNotNull()
        counted = hits.agg(*[F.count(f"_f{i}").alias(f"_df{i}") for i in range(len(terms))])
        scored = hits.where(every).join(F.broadcast(stats)).join(F.broadcast(counted))
        score = sum(
            (F.log(1 + (F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)) * F.col(f"_f{i}") * (S.K1 + 1) / (F.col(f"_f{i}") + S.K1 * (1 - S.B + S.B * F.col("dl") / F.col("_avg"))) for i in range(len(terms))),
            F.lit(0.0),
        )
        return scored.withColumn("score", score).select(*narrow.columns, "score")

    def top(self, query: str, filters: Filters = Filters(), limit: int = 20, leaves: bool = True) -> DataFrame:
        return S.top(self.bm25(query, filters, leaves), limit, "score", self.key)

    def with_texts(self, hits: DataFrame) -> DataFrame:
        """Results with the text of their units; ``hits`` are few, so they are what is broadcast."""
        texts = self.units.select(self.key, "local_content", "bm25_body")
        return texts.join(F.broadcast(hits), self.key)


def prepared(units: DataFrame, docs: DataFrame) -> DataFrame:
    """Each (doc_id, unit_id) once, with its document's columns, numbers from the unit id, and dl."""
    tokens = F.regexp_count(F.lower("bm25_body"), F.lit("[a-z0-9]+"))
    kept = keep_first(units).select(
        "unit_row_id", "doc_id", "unit_type", "unit_id", "seq", "number_label", "ordinal_int", "ordinal_suffix", "label_display", "seq_sort_key", "title", "citation_string", "parent_pasal_id", "local_content", "bm25_body",
        legal.path_number(F.col("unit_id"), "pasal").alias("pasal_number"), legal.path_number(F.col("unit_id"), "bab").alias("bab_number"), F.coalesce(tokens, F.lit(0)).alias("dl"),
    )
    return kept.join(docs, "doc_id")


def build(units: DataFrame, documents: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes the index of ``units`` and ``documents`` under ``path``, over what is there."""
    prepared(units, document_rows(documents)).write.mode("overwrite").parquet(f"{path}/units")
    stored = units.sparkSession.read.parquet(f"{path}/units")
    rows = S.postings(stored, "unit_row_id", "bm25_body").withColumn("bucket", bucket(F.col("term"), buckets))
    rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def opened(spark: SparkSession, path: str, buckets: int = BUCKETS) -> SearchIndex:
    return SearchIndex(spark.read.parquet(f"{path}/units"), spark.read.parquet(f"{path}/postings"), buckets)


_OPEN: dict[tuple[str, str], SearchIndex] = {}


def _stamp(*tables: DataFrame) -> str:
    """A name made of the names, sizes and times of the files of some tables."""
    rows = [str(r) for t in tables for r in t.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()]
    return hashlib.sha256("\n".join(sorted(rows)).encode()).hexdigest()[:24]


def _place(spark: SparkSession, *tables: DataFrame) -> str:
    return f"{checkpoint_dir(spark)}/search-index-{spark.sparkContext.applicationId}-{_stamp(*tables)}"


def _there(spark: SparkSession, index: SearchIndex) -> bool:
    """Whether the files of an open index still exist."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for t in (index.units, index.postings) for f in t.inputFiles()[:1]]
    return all(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in paths)


def index_of(spark: SparkSession, folder: str) -> SearchIndex:
    """The index of the units in ``folder``, written into the shared folder when a session first asks for it.

    Its name has the names, sizes and times of the tables' files, so changed tables get a new index.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OPEN or not _there(spark, _OPEN[key]):
        units, documents = load(spark, folder, "legal_units"), load(spark, folder, "legal_documents")
        path = _place(spark, units, documents)
        build(units, documents, path)
        _OPEN[key] = opened(spark, path)
    return _OPEN[key]


def corpus_index_of(spark: SparkSession, folder: str, table: str, key: str, text: str) -> SearchIndex:
    """The index of any table's texts, as ``index_of``; its units are (key, dl)."""
    slot = (spark.sparkContext.applicationId, f"{folder}/{table}")
    if slot not in _OPEN or not _there(spark, _OPEN[slot]):
        rows = load(spark, folder, table)
        path = _place(spark, rows)
        rows.select(key, F.coalesce(F.regexp_count(F.lower(text), F.lit("[a-z0-9]+")), F.lit(0)).alias("dl")).write.mode("overwrite").parquet(f"{path}/units")
        found = S.postings(rows, key, text).drop("dl").withColumn("bucket", bucket(F.col("term")))
        found.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        _OPEN[slot] = SearchIndex(spark.read.parquet(f"{path}/units"), spark.read.parquet(f"{path}/postings"), BUCKETS, key)
    return _OPEN[slot]

"""The engine's own tables below one folder: creating, dropping, counting, and indexing documents into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import legal
from statuta.operators import indexing
from statuta.operators.tree import roll_up
from statuta.sources import writers

SCHEMAS = {
    "documents": "doc_id string, doc_title string, doc_form string, doc_number string, doc_year int, doc_status string, doc_source string, doc_date_enacted date, doc_content string, doc_content_length int",
    "units": "doc_id string, seq int, depth int, unit_type string, unit_id string, number_label string, title string, local_content string, parent_unit_id string, parent_pasal_id string, ordinal_int int, ordinal_suffix string, seq_sort_key string, hierarchy_path string, content string",
    "subjects": "subject string",
    "document_subjects": "doc_id string, subject string",
    "search_log": "search_id string, query string, query_hash string, strategy string, result_limit int, duration_ms double, n_results bigint, searched_at timestamp",
}


def _path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def create(spark: SparkSession, root: str) -> list[str]:
    """Makes the tables that are not there yet; their names."""
    made = []
    for name, schema in SCHEMAS.items():
        if not exists(spark, _path(root, name)):
            spark.createDataFrame([], schema).write.parquet(_path(root, name))
            made.append(name)
    return made


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def drop(spark: SparkSession, root: str) -> list[str]:
    """Removes the engine's tables below ``root`` and nothing else there; their names."""
    gone = []
    for name in SCHEMAS:
        target = spark._jvm.org.apache.hadoop.fs.Path(_path(root, name))
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(target):
            files.delete(target, True)
            gone.append(name)
    return gone


def reset(spark: SparkSession, root: str) -> list[str]:
    drop(spark, root)
    return create(spark, root)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(_path(root, name))


def status(spark: SparkSession, root: str) -> DataFrame:
    """Rows of each table that is there."""
    out = None
    for name in SCHEMAS:
        if exists(spark, _path(root, name)):
            one = table(spark, root, name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
            out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "table_name string, n_rows bigint")


def document_rows(records: DataFrame) -> DataFrame:
    """Records as rows of the documents table: domains checked, dates read, the year a number (else null), defaults filled in."""
    title = F.coalesce(F.nullif(F.trim("doc_title"), F.lit("")), F.lit("Unknown"))
    made = legal.doc_id(F.coalesce("doc_form_short", "doc_form", "doc_type"), F.col("doc_year"), F.col("doc_number"))
    return records.select(
        F.coalesce(F.nullif("doc_id", F.lit("")), made).alias("doc_id"), title.alias("doc_title"), legal.known_form(F.coalesce("doc_form", "doc_type")).alias("doc_form"), F.coalesce("doc_number", F.lit("Unknown")).alias("doc_number"),
        F.expr("try_cast(doc_year as int)").alias("doc_year"), legal.known_status(F.col("doc_status")).alias("doc_status"), F.coalesce("doc_source", F.lit("Unknown")).alias("doc_source"),
        legal.to_date(F.col("doc_date_enacted")).alias("doc_date_enacted"), "doc_content", F.coalesce(F.length("doc_content"), F.lit(0)).alias("doc_content_length"),
    )


def index_documents(spark: SparkSession, root: str, records: DataFrame) -> DataFrame:
    """Appends records that the documents table does not have, with their units and subjects; counts of what was appended.

    A document whose year is no number is kept with a null year. One row: n_documents, n_units, n_subjects, n_rejected (records without any id).
    """
    create(spark, root)
    rows = document_rows(records).withColumn("_tree", F.lit(None).cast("string"))
    raw = records.select(F.coalesce(F.nullif("doc_id", F.lit("")), legal.doc_id(F.coalesce("doc_form_short", "doc_form", "doc_type"), F.col("doc_year"), F.col("doc_number"))).alias("doc_id"), "document_tree", "doc_subject")
    fresh = writers.new_only(rows.drop("_tree").where("doc_id is not null"), table(spark, root, "documents"))
    n_before = {n: table(spark, root, n).count() for n in ("documents", "units", "subjects")}
    trees = raw.where("document_tree is not null").groupBy("doc_id").agg(F.min("document_tree").alias("document_tree")).join(fresh.select("doc_id"), "doc_id", "left_semi")
    units = indexing.unit_rows(trees, "doc_id")
    content = roll_up(units.select("doc_id", "seq", "unit_id", "local_content"))
    listed = raw.join(fresh.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.explode("doc_subject").alias("s")).where(F.trim("s") != "").select("doc_id", F.upper(F.trim("s")).alias("subject")).distinct()
    # everything below reads ``fresh`` before the documents table grows, so that comes last
    units.join(content, ["doc_id", "unit_id"], "left").select(*[c.split()[0] for c in SCHEMAS["units"].split(", ")]).write.mode("append").parquet(_path(root, "units"))
    listed.write.mode("append").parquet(_path(root, "document_subjects"))
    writers.new_only(listed.select("subject"), table(spark, root, "subjects"), "subject").write.mode("append").parquet(_path(root, "subjects"))
    fresh.select(*[c.split()[0] for c in SCHEMAS["documents"].split(", ")]).write.mode("append").parquet(_path(root, "documents"))
    added = {n: table(spark, root, n).count() - before for n, before in n_before.items()}
    return spark.createDataFrame([(added["documents"], added["units"], added["subjects"])], "n_documents bigint, n_units bigint, n_subjects bigint")

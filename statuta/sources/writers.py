"""Sinks: appending new records, merging updates, text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that an update replaces; every other field keeps what it has.
TREE_FIELDS = ("document_tree", "doc_content", "doc_processing_status")


def new_only(incoming: DataFrame, existing: DataFrame, key: str = "doc_id") -> DataFrame:
    """Incoming records whose key does not exist yet, each key once (see ``one_each``)."""
    return one_each(incoming.join(existing.select(key), key, "left_anti"), key)


def one_each(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Each key once: the first row by the columns ``order``, ties and no order falling to the smaller content.

    A null key is a key.
    """
    row = F.struct(*df.columns)
    picked = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.struct(*[F.col(c) for c in order], F.to_json(row).alias("_j"))).alias("_r"))
    return picked.select("_r.*")


def merged(existing: DataFrame, incoming: DataFrame, key: str = "doc_id", replace: tuple[str, ...] = TREE_FIELDS) -> DataFrame:
    """``existing`` with the fields ``replace`` taken from ``incoming`` where it has them, plus new records."""
    fresh = one_each(incoming, key)
    update = fresh.select(key, *[F.col(c).alias(f"_new_{c}") for c in replace if c in fresh.columns])
    old = existing.join(update, key, "left")
    for c in replace:
        if f"_new_{c}" in old.columns:
            old = old.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c))).drop(f"_new_{c}")
    return old.select(*existing.columns).unionByName(new_only(fresh, existing, key).select(*[c for c in existing.columns if c in fresh.columns]), allowMissingColumns=True)


def first_text(*columns: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def write_texts(df: DataFrame, path: str, key: str, *columns: str) -> None:
    """Writes the first of ``columns`` that is not empty as one text file per row, below a folder named by its key."""
    df.select(F.col(key), first_text(*columns).alias("value")).where("value is not null").write.mode("overwrite").partitionBy(key).text(path)


def with_dimension(dimension: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``dimension`` with the values of ``incoming`` that it lacks: get or create for all of them at once."""
    return dimension.select(key).unionByName(new_only(incoming.select(key).where(F.col(key).isNotNull()), dimension, key)).distinct()


def append(df: DataFrame, path: str, *partition: str) -> None:
    """Appends to a Parquet table, partitioned by the given columns."""
    df.write.mode("append").partitionBy(*partition).parquet(path)

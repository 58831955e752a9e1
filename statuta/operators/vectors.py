"""An inverted-list index for vectors: rows are stored by the cell of their nearest centroid.

Centroids are fitted on a bounded sample (parameter ``sample``); every row is indexed. A query reads the
``probes`` cells nearest to it and scores their rows exactly, so only recall is approximate, and with all
cells probed nothing is. ``recall`` measures it against an exact scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import search as S

#: Cells, rows that the centroids are fitted on at most (about), rounds of fitting, cells read per query.
CELLS, SAMPLE, ROUNDS, PROBES = 32, 20_000, 12, 20
#: Queries that are compared with all rows at a time.
BLOCK = 2_000


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centroids(vectors: DataFrame, embedding: str = "embedding", cells: int = CELLS, sample: int = SAMPLE, seed: int = 5) -> np.ndarray:
    """Unit vectors of at most ``cells`` centroids by spherical k-means; no row for no vector."""
    rows = vectors.where(F.col(embedding).isNotNull())
    share = min(1.0, sample / max(rows.count(), 1))
    drawn = rows.where(F.pmod(F.xxhash64(embedding), F.lit(1 << 20)) < share * (1 << 20)).select(embedding).collect()
    x = _unit(np.array(sorted(r[0] for r in drawn), dtype=np.float64)) if drawn else np.zeros((0, 1))
    if len(x) == 0:
        return x
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-9, _unit(sums), c)
    return c


@dataclass(frozen=True)
class VectorIndex:
    """Rows (key, embedding scaled to length 1, further columns, cell) and the centroids of the cells."""

    rows: DataFrame
    centres: np.ndarray
    key: str = "vec_id"

    def cells_of(self, query: list[float], probes: int = PROBES) -> list[int]:
        q = _unit(np.array([query], dtype=np.float64))
        return [int(i) for i in np.argsort(-(q @ self.centres.T)[0], kind="stable")[:probes]]

    def search(self, query: list[float], limit: int = 10, probes: int = PROBES) -> DataFrame:
        """The nearest rows among ``probes`` cells, with their cosine as score."""
        q = _unit(np.array([query], dtype=np.float64))[0]
        scored = self.rows.where(F.col("cell").isin(self.cells_of(query, probes))).withColumn("score", S._dot(F.col("unit"), F.array(*[F.lit(float(v)) for v in q])))
        return S.top(scored.drop("unit", "cell"), limit, "score", self.key)


def build(vectors: DataFrame, path: str, key: str = "vec_id", embedding: str = "embedding", cells: int = CELLS, sample: int = SAMPLE) -> VectorIndex:
    """Writes the rows of ``vectors`` under ``path``, partitioned by cell. Null and zero vectors are in no cell."""
    spark = vectors.sparkSession
    centres = centroids(vectors, embedding, cells, sample)
    shared = spark.sparkContext.broadcast(centres)

    def run(values: pd.Series) -> pd.DataFrame:
        x = _unit(np.array(values.tolist(), dtype=np.float64))
        near = (x @ shared.value.T).argmax(axis=1) if len(shared.value) else np.zeros(len(x), dtype=int)
        return pd.DataFrame({"cell": near.astype(np.int32), "unit": list(x)})

    placed = vectors.where(F.exists(embedding, lambda v: v != 0)).withColumn("_p", F.pandas_udf(run, "struct<cell: int, unit: array<double>>")(F.col(embedding)))
    stored = placed.select("*", F.col("_p.cell").alias("cell"), F.col("_p.unit").alias("unit")).drop("_p", embedding)
    stored.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(path)
    return VectorIndex(spark.read.schema(stored.schema).parquet(path), centres, key)


def recall(index: VectorIndex, queries: DataFrame, limit: int = 10, probes: int = PROBES) -> tuple[int, float]:
    """(queries, share of their exact nearest ``limit`` rows that the index finds); ``queries`` has key and unit.

    Queries are compared with all rows in blocks of BLOCK, each block once with the index's cells only.
    """
    spark: SparkSession = index.rows.sparkSession
    n, found = 0, 0.0
    asked = queries.select(index.key, "unit").orderBy(index.key).collect()
    for start in range(0, len(asked), BLOCK):
        block = np.array([r["unit"] for r in asked[start : start + BLOCK]], dtype=np.float64)
        open_cells = np.zeros((len(block), len(index.centres)), dtype=bool)
        np.put_along_axis(open_cells, np.argsort(-(block @ index.centres.T), axis=1, kind="stable")[:, :probes], True, axis=1)
        shared = spark.sparkContext.broadcast((block, open_cells))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            q, cells = shared.value
            for batch in batches:
                s = np.array(batch["unit"].tolist()) @ q.T
                inside = cells[:, batch["cell"].to_numpy()].T
                top = np.argsort(-s, axis=0, kind="stable")[:limit]  # the best of a batch hold the best of all
                yield pd.DataFrame({"q": np.tile(np.arange(len(q)), (len(top), 1)).ravel(), "s": np.take_along_axis(s, top, 0).ravel(), "inside": np.take_along_axis(inside, top, 0).ravel()})

        scored = index.rows.select("unit", "cell").mapInPandas(run, "q int, s double, inside boolean")
        best = scored.groupBy("q").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("s", "inside")))), 1, limit).alias("b"))
        got = best.agg(F.count("*").alias("n"), F.sum(F.size(F.filter("b", lambda x: x["inside"])) / F.size("b")).alias("f")).first()
        n, found = n + got["n"], found + (got["f"] or 0.0)
    return n, found / n if n else 1.0

"""Filling containers of fixed capacity with texts, by bounded-space online best fit.

Each partition packs its own texts as they come, with a fixed number of open containers. A bitset has
bit f set while some open container has f tokens free, so the tightest container that fits is one shift
and one lowest-bit away; a full set of open containers closes its fullest one. Memory is the number of
open containers whatever the input, no task sees the whole, and no row moves.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm.tokens import VOCABULARY, n_tokens

CAPACITY = 2_048
OPEN = 64


class BestFit:
    """Online best fit with at most ``most`` open containers."""

    def __init__(self, capacity: int, most: int = OPEN) -> None:
        if capacity < 1 or most < 1:
            raise ValueError("capacity and number of open containers must be positive")
        self.capacity, self.most = capacity, most
        self.bits = 0
        self.by_free: dict[int, list[int]] = {}
        self.n_open = self.n_made = 0

    def _take(self, free: int) -> int:
        same = self.by_free[free]
        container = same.pop()
        if not same:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return container

    def _put(self, container: int, free: int) -> None:
        if free <= 0:
            return  # full: closed at once
        self.by_free.setdefault(free, []).append(container)
        self.bits |= 1 << free
        self.n_open += 1

    def place(self, size: int) -> int:
        """Number of the container that takes an item of ``size`` (1 to capacity)."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            container = self._take(free)
        else:
            if self.n_open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            container, free = self.n_made, self.capacity
            self.n_made += 1
        self._put(container, free - size)
        return container


def pack(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    capacity: int = CAPACITY,
    most_open: int = OPEN,
    vocabulary: str = VOCABULARY,
    size: str | None = None,
) -> DataFrame:
    """Each text (or part of one) with the container it goes into.

    Columns: key, part (from 0), container (unique text: partition and number), from_token, n_tokens.
    Only a text of more than ``capacity`` tokens is split: into full containers of its own and a rest
    that is packed like any text. A text without tokens (null or empty) has part 0, no container and
    0 tokens. Repeated rows are items of their own. ``size`` names a column that already holds the
    number of tokens. Containers are numbered by partition, so a partition that is computed again after
    the loss of an executor gives the same containers as long as its rows come in the same order.
    """
    sized = df.select(F.col(key).alias("_k"), (F.col(size).cast("int") if size else n_tokens(F.col(text), vocabulary)).alias("_n"), F.spark_partition_id().alias("_p"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        fit = None
        for batch in batches:
            out = []
            for k, n, p in zip(batch["_k"], batch["_n"].fillna(0).astype("int64"), batch["_p"], strict=True):
                if fit is None:
                    fit, solo = BestFit(capacity, most_open), 0
                if n <= 0:
                    out.append((k, 0, None, 0, 0))
                    continue
                whole, rest = divmod(int(n), capacity)
                for part in range(whole):
                    out.append((k, part, f"{p}-s{solo}", part * capacity, capacity))
                    solo += 1
                if rest:
                    out.append((k, whole, f"{p}-{fit.place(rest)}", whole * capacity, rest))
            yield pd.DataFrame(out, columns=[key, "part", "container", "from_token", "n_tokens"])

    return sized.mapInPandas(run, f"`{key}` {kind}, part int, container string, from_token bigint, n_tokens int")


def pack_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: texts, items, containers, tokens, and the share of all container space that is used."""
    return packed.agg(
        F.count("container").alias("n_items"),
        F.count_if(F.col("container").isNull()).alias("n_empty"),
        F.count_distinct("container").alias("n_containers"),
        F.sum("n_tokens").alias("n_tokens"),
    ).withColumn("used_share", F.round(F.col("n_tokens") / (F.col("n_containers") * F.lit(capacity)), 6))

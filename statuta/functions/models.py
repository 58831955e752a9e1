"""Plug points for models outside the engine: embedding, completion, relevance.

A model is any function over a list of texts. It runs inside Arrow batches, a few texts per call, with the
retries of ``retrying``; a batch that fails for good gives nulls, so one bad text costs no query.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts per call; vectors may have so many numbers.
BATCH, DIMENSIONS = 16, (1, 2048)


class Retry(Exception):
    """Raised by a model for what may pass: time-outs, broken connections, server errors (5xx)."""


def wait_before(attempt: int) -> float:
    """Seconds before the retry after attempt ``attempt`` (from 0): 1, 2, 4, 8, then 10."""
    return float(min(2**attempt, 10))


def retrying(call: Callable, *arguments, retries: int = 3, sleep: Callable[[float], None] = time.sleep):
    """What ``call`` returns, tried again up to ``retries`` times after Retry, TimeoutError or ConnectionError."""
    for attempt in range(retries + 1):
        try:
            return call(*arguments)
        except (Retry, TimeoutError, ConnectionError):
            if attempt == retries:
                raise
            sleep(wait_before(attempt))


def _called(texts: list[str], call: Callable[[list[str]], list], batch: int, retries: int) -> list:
    out: list = []
    for i in range(0, len(texts), batch):
        part = texts[i : i + batch]
        try:
            got = list(retrying(call, part, retries=retries))
        except Exception:  # noqa: BLE001  (any failure of an outside model leaves nulls)
            got = []
        out += got if len(got) == len(part) else [None] * len(part)
    return out


def _over(text: Column, call: Callable[[list[str]], list], kind: str, batch: int, retries: int, check: Callable) -> Column:
    def run(values: pd.Series) -> pd.Series:
        given = [i for i, v in enumerate(values) if v is not None and v.strip()]
        out: list = [None] * len(values)
        for i, v in zip(given, _called([values.iloc[i] for i in given], call, batch, retries), strict=True):
            out[i] = v if v is not None and check(v) else None
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, kind)(text)


def embedded(text: Column, embed: Callable[[list[str], str], list[list[float]]], *, task: str = "passage", dimension: int | None = None, batch: int = BATCH, retries: int = 3) -> Column:
    """Vectors of a column of texts by ``embed(texts, task)``; task is passage or query.

    Null and blank texts, failed batches, batches with another number of vectors than texts, and vectors
    of a wrong length give null.
    """
    if task not in ("passage", "query"):
        raise ValueError("task must be passage or query")

    def right(v: list[float]) -> bool:
        return len(v) == dimension if dimension else DIMENSIONS[0] <= len(v) <= DIMENSIONS[1]

    return _over(text, lambda texts: embed(texts, task), "array<float>", batch, retries, right)


def completed(prompt: Column, complete: Callable[[list[str]], list[str]], *, batch: int = 1, retries: int = 3) -> Column:
    """What a language model answers to a column of prompts; null for null, blank and failed ones."""
    return _over(prompt, complete, "string", batch, retries, lambda v: isinstance(v, str))


def answer_fields(answer: Column, schema: str) -> Column:
    """A model's JSON answer as a struct: fences and text around the outermost braces are cut away; null where it is no JSON."""
    return F.from_json(F.regexp_extract(answer, r"(?s)(\{.*\})", 1), schema)

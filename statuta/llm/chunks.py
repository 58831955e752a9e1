"""Cutting long texts into overlapping pieces at natural boundaries, by agglomerative merging.

The text is first cut at every natural boundary; then, weakest boundary first, neighbours are merged as
long as the merged piece with its overlap stays within the limit. What remains are the strongest
boundaries that the limit allows.
"""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1_500, 100

# strength of a boundary, from the structure of law texts down to a cut inside a word
PARAGRAPH, STRUCTURE, LINE, SENTENCE, CLAUSE, WORD, INSIDE = 7, 6, 5, 4, 3, 2, 1
_STRUCTURE = r"(?:BAB\b|BAGIAN\b|Bagian\b|Paragraf\b|Pasal\s+\d+|\(\d+[a-z]?\)|[a-z]\.\s|\d+\.\s)"
_BOUNDARY = re.compile(
    rf"(?P<p>\n[ \t]*\n\s*)|(?P<s>\n[ \t]*(?={_STRUCTURE}))|(?P<l>\n)|(?P<e>(?<=[.!?;])[ \t]+(?=[A-Z(\"“]))|(?P<c>(?<=[,;:])[ \t]+)"
)
_STRENGTH = {"p": PARAGRAPH, "s": STRUCTURE, "l": LINE, "e": SENTENCE, "c": CLAUSE}
_WORD = re.compile(r"\s+")


def _atoms(text: str, most: int) -> tuple[list[int], list[int]]:
    """Start of every atom and the strength of the boundary before it; no atom is longer than ``most``."""
    starts, strengths = [0], [0]
    for m in _BOUNDARY.finditer(text):
        if 0 < m.end() < len(text):
            starts.append(m.end())
            strengths.append(_STRENGTH[m.lastgroup])
    out, power = [], []
    for k, (a, s) in enumerate(zip(starts, strengths, strict=True)):
        b = starts[k + 1] if k + 1 < len(starts) else len(text)
        out.append(a)
        power.append(s)
        while b - a > most:
            # words as long as they help, else inside a word
            cut = next((m.end() for m in reversed(list(_WORD.finditer(text, a + most // 2, a + most)))), None)  # a window of the text, not its rest
            power.append(WORD if cut else INSIDE)
            a = cut or a + most
            out.append(a)
    return out, power


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, strength) of each piece; strength is that of the boundary the piece was cut at.

    Every piece but the first starts ``overlap`` characters before the end of the piece before it. A text
    within the limit is one piece.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, 0)]
    starts, power = _atoms(text, limit - overlap)
    count = len(starts)
    ends = [*starts[1:], n]
    after = list(range(1, count + 1))
    before = list(range(-1, count - 1))
    alive = [True] * count

    def weight(i: int) -> tuple[int, int, int, int]:
        j = after[i]
        return power[j], ends[j] - starts[i], i, j

    heap = [weight(i) for i in range(count - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if not (alive[i] and j < count and alive[j] and after[i] == j) or ends[j] - starts[i] != size:
            continue
        if size + (overlap if starts[i] else 0) > limit:
            continue
        alive[j] = False
        ends[i], after[i] = ends[j], after[j]
        if after[j] < count:
            before[after[j]] = i
            heapq.heappush(heap, weight(i))
        if before[i] >= 0:
            heapq.heappush(heap, weight(before[i]))
    cores = [(starts[i], ends[i], power[i]) for i in range(count) if alive[i]]
    # a first piece shorter than the overlap could not be overlapped by that much: it takes in text from the next
    if len(cores) > 1 and cores[0][1] < overlap:
        end = next((m.end() for m in _WORD.finditer(text, overlap, limit)), overlap)
        if end < cores[1][1]:
            cores[:2] = [(0, end, 0), (end, cores[1][1], WORD if text[end - 1].isspace() else INSIDE)]
    return [(a - overlap if a else 0, b, s) for a, b, s in cores]


_SPANS = "array<struct<start: int, end: int, boundary: int, piece: string>>"


def spans(text: Column, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> Column:
    """The pieces of a text longer than ``limit`` as an array of spans (counted from 0), with their text if asked.

    A long text is cut where it is in memory once: cutting each piece out of the whole text again would
    cost its length for every piece.
    """

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "boundary": s, "piece": t[a:b] if with_text else None} for a, b, s in cut(t, limit, overlap)] if t is not None else None)

    return F.pandas_udf(run, _SPANS)(text)


def pieces(df: DataFrame, key: str, columns: list[str], limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """Columns ``columns`` of ``df`` cut into pieces.

    Columns: key, field_name, piece_no (from 0), n_pieces, start_pos, end_pos, boundary and, unless
    ``with_text`` is false, piece. A value within the limit is one piece and never leaves the JVM; null
    values have no piece, empty ones an empty piece; blanks at a cut stay with the piece before it, so
    that the pieces without their overlaps make up the text. An unbroken run longer than the limit is cut
    inside, without other loss. The overlap must be shorter than half the limit.
    """
    if not 0 <= overlap * 2 < limit:
        raise ValueError("the overlap must be at least 0 and shorter than half the limit")
    values = df.select(F.col(key).alias("_k"), F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in columns])).alias("v")).select("_k", "v.*")
    long = values.where(F.length("text") > limit).withColumn("spans", spans(F.col("text"), limit, overlap, with_text))
    short = values.where(F.length("text") <= limit).withColumn("spans", F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(0).alias("boundary"), (F.col("text") if with_text else F.lit(None).cast("string")).alias("piece"))))
    both = long.unionByName(short).select("_k", "field_name", F.size("spans").alias("n_pieces"), F.posexplode("spans").alias("piece_no", "s"))
    text = [F.col("s.piece").alias("piece")] if with_text else []
    return both.select(F.col("_k").alias(key), "field_name", "piece_no", "n_pieces", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), F.col("s.boundary").alias("boundary"), *text)


def oversized(df: DataFrame, key: str, columns: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, field_name) of each value that had to be cut."""
    return pieces(df, key, columns, limit, overlap, with_text=False).where("piece_no = 1").select(key, "field_name")

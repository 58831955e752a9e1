"""Pieces: within the limit, exact overlaps, exact cover, strongest boundaries."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statuta.llm.chunks import PARAGRAPH, cut, oversized, pieces

SCHEMA = "unit_row_id bigint, content string, bm25_body string, piece string, text string"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "kata ", "Kalimat. ", "ya, ", "\n", "\n\n", "\n(1) ", "Pasal 3\n", "z" * 40, "é"]), max_size=200).map("".join), st.integers(5, 120), st.integers(0, 40))
def test_cover(text, limit, overlap):
    if overlap * 2 >= limit:
        overlap = limit // 3
    got = cut(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b, _ in got)
    assert all(c == b - overlap and d > b for (_, b, _), (c, d, _) in zip(got, got[1:], strict=False))
    assert (len(got) == 1) == (len(text) <= limit)


def test_boundaries():
    text = "\n\n".join(["Kalimat satu yang panjang. Kalimat dua yang panjang."] * 6)
    assert {s for _, _, s in cut(text, 130, 10)[1:]} == {PARAGRAPH}


def test_rows(spark):
    long = "Pemohon wajib menyampaikan laporan. " * 100
    data = [(1, long, None), (2, "", "pendek"), (3, None, "x" * 4_000), (3, None, "x" * 4_000), (4, "é" * 1_500, "é" * 1_501)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in data], SCHEMA)
    got = pieces(df, "unit_row_id", ["content", "bm25_body"])
    assert got.agg(F.max(F.length("piece"))).first()[0] <= 1_500
    assert sorted((r["unit_row_id"], r["field_name"]) for r in oversized(df, "unit_row_id", ["content", "bm25_body"]).collect()) == [(1, "content"), (3, "bm25_body"), (3, "bm25_body"), (4, "bm25_body")]
    whole = "".join(r["piece"][100 if r["piece_no"] else 0 :] for r in got.where("unit_row_id = 1").orderBy("piece_no").collect())
    assert whole == long
    assert [r["piece"] for r in got.where("unit_row_id = 2 and field_name = 'content'").collect()] == [""]
    assert pieces(df.where("false"), "unit_row_id", ["content"]).count() == 0

"""Retrieval against brute force and by invariants; sources, sinks and the stream."""

from __future__ import annotations

import json
import math

from pyspark.sql import functions as F

from statuta.operators import search as S
from statuta.operators.filters import Filters
from statuta.sources import readers, writers
from statuta.streaming import incremental

TEXTS = {1: "izin usaha izin", 2: "usaha kecil dan izin", 3: "pajak", 4: None, 5: "", 6: "izin usaha mikro usaha"}


def bm25_by_hand(query):
    docs = {k: [w for w in (t or "").split() if w] for k, t in TEXTS.items()}
    docs = {k: w for k, w in docs.items() if w}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    terms, out = query.split(), {}
    for k, words in docs.items():
        if all(t in words for t in terms):
            out[k] = 0.0
            for t in terms:
                df = sum(t in w for w in docs.values())
                tf = words.count(t)
                out[k] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg))
    return out


def test_bm25(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "id bigint, body string")
    for query in ("izin usaha", "usaha", "pajak izin"):
        got = {r["id"]: r["score"] for r in S.bm25(df, query, "body").collect()}
        want = bm25_by_hand(query)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert S.bm25(df, " ?! ", "body").count() == 0
    assert S.bm25(df.where("false"), "izin", "body").count() == 0


def test_filters_never_enlarge(spark):
    df = spark.createDataFrame([("UU", 2001), ("PP", 2002), (None, None)], "doc_form string, doc_year int")
    assert df.where(Filters().predicate()).count() == 3
    assert df.where(Filters(doc_form=()).predicate()).count() == 3
    assert df.where(Filters.from_text(doc_form="UU, PP", doc_year="2001").predicate()).count() == 1


def test_cosine_and_fusion(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "vec_id bigint, embedding array<float>")
    got = S.vector_search(v, v.where("vec_id = 1").select(F.col("embedding").alias("q")), limit=5).collect()
    assert [(r["vec_id"], round(r["score"], 4)) for r in got] == [(1, 1.0), (2, 0.7071)]
    a = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id bigint, score double")
    b = spark.createDataFrame([(2, 8.0), (3, 4.0)], "id bigint, score double")
    fused = S.fuse(a, b, "id", 10).collect()
    assert [r["id"] for r in fused] == [1, 2, 3] and len({r["id"] for r in fused}) == 3
    assert all(x["score"] >= y["score"] for x, y in zip(fused, fused[1:], strict=False))


def test_routing_and_parts(spark):
    q = spark.createDataFrame([("Pasal 1 ayat 2",), ("UU No. 1 Tahun 2023",), ("izin usaha",), ("",), (None,), ("bab ini",)], "query string")
    assert [r["strategy"] for r in S.route(q).collect()] == ["fts", "fts", "hybrid", "empty_query", "empty_query", "fts"]
    parts = q.limit(1).select(S.citation_parts(F.col("query")).alias("c")).first()["c"]
    assert parts["pasal"] == "1" and parts["ayat"] == "2" and parts["huruf"] is None


def test_sinks(spark):
    old = spark.createDataFrame([("A", "t", "x"), ("B", "u", None)], "doc_id string, doc_title string, doc_content string")
    new = spark.createDataFrame([("A", "other", "y"), ("C", "v", "z"), ("C", "v", "z")], "doc_id string, doc_title string, doc_content string")
    assert writers.new_only(new, old).count() == 1
    got = {r["doc_id"]: (r["doc_title"], r["doc_content"]) for r in writers.merged(old, new, replace=("doc_content",)).collect()}
    assert got == {"A": ("t", "y"), "B": ("u", None), "C": ("v", "z")}


def test_sources_and_stream(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"d{i}.json").write_text(json.dumps({"doc_id": f"UU-200{i}-1", "doc_title": "x", "relationships": {"mengubah": [{"regulation_reference": "a"}]}}))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "d1.txt").write_text("isi naskah")
    (tmp_path / "zz.txt").write_text("tanpa pasangan")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    docs = readers.json_documents(spark, str(tmp_path))
    assert docs.where("doc_id is not null").count() == 2
    assert [r["doc_content"] for r in readers.with_texts(docs, readers.text_files(spark, str(tmp_path))).collect()] == ["isi naskah"]
    assert readers.pdf_files(spark, str(tmp_path)).first()["is_pdf"]
    (tmp_path / "in").mkdir()
    for n, i in ((1, 1), (2, 1), (3, 2)):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"doc_id": f"UU-200{i}-1", "last_updated": "2024-01-01 00:00:00"}))
    query = incremental.start(incremental.document_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2

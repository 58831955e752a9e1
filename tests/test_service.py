"""The search service: strategies and their automatic choice, reranking, responses, related content, index."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from statuta.operators import index as I
from statuta.operators import search as S
from statuta.operators import service as V
from statuta.operators.filters import Filters

UNITS = "unit_row_id bigint, doc_id string, unit_type string, unit_id string, seq int, number_label string, ordinal_int int, ordinal_suffix string, label_display string, seq_sort_key string, title string, citation_string string, parent_pasal_id string, local_content string, bm25_body string, score double"
DOCS = "doc_row_id bigint, doc_id string, doc_form string, doc_year string, doc_number string, doc_status string, deleted_at timestamp"


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    units = []
    for i in range(1, 41):
        doc = f"UU-{2000 + i % 2}-1"
        pasal = f"{doc}/bab-I/pasal-{i}"
        units.append((2 * i, doc, "PASAL", pasal, i, str(i), i, "", f"Pasal {i}", "", None, f"UU, Pasal {i}", None, None, None, 0.0))
        text = f"pasal {i} laporan berkala wajib disampaikan" if i % 4 else "laporan berkala " * 3
        units.append((2 * i + 1, doc, "AYAT", f"{pasal}/ayat-1", i, "1", 1, "", "(1)", "", None, None if i == 4 else f"UU, Pasal {i} ayat (1)", pasal, text, text, 0.0))
    units.append((999, "UU-2001-1", "AYAT", "UU-2001-1/bab-I/pasal-1/ayat-1", 1, "1", 1, "", "(1)", "", None, "again", None, "laporan", "laporan", 0.0))
    docs = [(1, "UU-2000-1", "uu", "2000", "1", "Berlaku", None), (2, "UU-2001-1", "UU", "2001", "1", "x", None), (3, "UU-2001-1", "PP", "1999", "9", "x", None)]
    path = str(tmp_path_factory.mktemp("index"))
    I.build(spark.createDataFrame(units, UNITS), spark.createDataFrame(docs, DOCS), path, 4)
    vectors = spark.createDataFrame([(2 * i + 1, [float(i), 1.0]) for i in range(1, 41)], "unit_row_id bigint, embedding array<float>")
    return V.SearchService(I.opened(spark, path, 4), vectors, lambda q: spark.createDataFrame([([1.0, 0.0],)], "q array<float>"))


def test_index_equals_scan(service):
    units = service.index.units
    for query, filters in (("laporan berkala", Filters()), ("wajib", Filters(doc_year=(2000,))), ("laporan nihil", Filters()), ("", Filters())):
        want = {(r["unit_row_id"], round(r["score"], 9)) for r in S.bm25(units.where("unit_type = 'AYAT'").where(filters.predicate()), query).collect()}
        assert {(r["unit_row_id"], round(r["score"], 9)) for r in service.index.bm25(query, filters).collect()} == want
    assert units.count() == 80 and units.where("unit_row_id = 999").count() == 0  # a reload of a unit is one unit


def test_strategies(service):
    def sources(q, **more):
        return {r["source"] for r in service.retrieve(q, **more).collect()}

    assert sources("laporan", strategy="fts") == {"fts"} and sources("laporan", strategy="vector") == {"vector"}
    assert sources("Pasal 3 ayat (1)", strategy="explicit", limit=4) == {"explicit"}
    assert sources("laporan", strategy="hybrid") == {"vector"} and service.retrieve("laporan", limit=7).count() == 7
    # automatic: an explicit query that text answers with limit rows stays with it, else hybrid; words are hybrid
    assert sources("pasal 1", limit=1) == {"fts"} and "vector" in sources("pasal 1", limit=20) and "vector" in sources("laporan")
    alone = V.SearchService(service.index)
    assert {r["source"] for r in alone.retrieve("laporan").collect()} == {"fts"} and alone.retrieve("laporan", "vector").count() == 0
    with pytest.raises(ValueError):
        service.retrieve("x", "guess")
    assert V.strategy_label(" ") == V.strategy_label(None) == "empty_query" and V.strategy_label("bab II") == "fts" and V.strategy_label("pajak") == "hybrid"


def test_explicit_reads_levels_and_documents(service):
    units = service.index.units
    assert [r["unit_id"] for r in S.explicit_units(units, "pasal 3 ayat 1").collect()] == ["UU-2001-1/bab-I/pasal-3/ayat-1"]
    assert S.explicit_units(units, "uu no. 1 tahun 2000", 100).count() == 40 and S.explicit_units(units, "pajak").count() == 0
    assert S.explicit_units(units, "pasal 3 uu 1/2000").count() == 0


def test_response_and_reranking(service):
    V.register_reranker("reverse", lambda documents, query: documents.where("unit_row_id <> 9").select("unit_row_id", (F.col("unit_row_id") / 1000.0).alias("relevance")))
    rows = V.SearchService(service.index, provider="reverse").search("laporan berkala", limit=5, strategy="fts", rerank=True).collect()
    assert len(rows) == 5 and all(r["source_type"].startswith("fts") for r in rows) and [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    plain = service.search("laporan berkala", limit=40, strategy="fts", filters=Filters(doc_year=(2000,))).collect()
    assert {r["document"]["form"] for r in plain} == {"UU"} and {r["document"]["year"] for r in plain} == {2000} and all(r["text"] for r in plain)
    assert next(r for r in plain if r["id"] == 9)["citation"] == "Pasal UU-2000-1/bab-I/pasal-4/ayat-1"
    assert service.search(None).count() == 0 and V.SearchService(service.index, provider="nobody").search("laporan", rerank=True, limit=3).count() == 3
    assert service.search_all(["laporan berkala", "wajib", ""]).count() == 20 and service.search_all([" "]).count() == 0


def test_related_outline_log(spark, service, tmp_path):
    assert [r["unit_type"] for r in service.related("UU-2001-1/bab-I/pasal-3").collect()] == ["ayat", "pasal"] and service.related("UU-2001-1/bab-I/pasal-3", False).count() == 1
    assert service.outline("UU-2000-1").count() == 40 and service.outline("nothing").count() == 0
    timed = [V.log_row(spark, "a", "fts", 10, 20.0, 3), V.log_row(spark, "b", "hybrid", 10, 40.0, 5)]
    V.append_log(timed, str(tmp_path / "log"))
    V.append_log(timed[:1], str(tmp_path / "log"))
    assert V.benchmark_summary(spark.read.parquet(str(tmp_path / "log"))).first().asDict() == {"n_queries": 3, "mean_ms": 26.667, "n_results": 11}


def test_vector_checks(spark):
    good = spark.createDataFrame([([1.0, 2.0],)], "embedding array<float>")
    assert V.checked_vectors(good).count() == 1
    with pytest.raises(ValueError):
        V.checked_vectors(good, dimension=5)
    for bad in ([], [None, 1.0], [1.0]):
        with pytest.raises(Exception, match="wrong length"):
            V.checked_vectors(spark.createDataFrame([(bad,)], "embedding array<float>"), dimension=128).collect()

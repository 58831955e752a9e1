"""Queries over saved pages. The test data has none, so a few authored pages stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import html
from statuta.session import share_package

BASE = "https://jdih.contoh.example"
# one page for each layout, one of results, one without anything
PAGES = (
    (1, """<html><head><title>Peraturan - BPK</title></head><body><h1>Undang-Undang Nomor 4 Tahun 2009</h1><div class="card"><h4 class="text-primary">METADATA PERATURAN</h4>
<p>Tipe Dokumen</p><p>Undang-undang</p><p>Nomor</p><p>Nomor 4</p><p>Tahun</p><p>Tahun 2009</p><p>Subjek</p><p>PAJAK, RETRIBUSI; -</p></div>
<div class="card"><h4 class="text-primary">STATUS PERATURAN</h4><div class="row"><div class="col">Mencabut</div></div><div class="row"><ol><li><a href="/Details/11/uu-1-1999">UU No. 1 Tahun 1999</a> tentang Kehutanan</li><li>Staatsblad 1926</li></ol></div>
<div class="row"><div>Diubah Dengan</div></div><div class="row"><ul><li><a href="https://lain.example/Details/12">PP No. 2 Tahun 2011</a></li></ul></div></div>
<div class="card"><h4>UJI MATERI</h4><ul><li><a href="/Download/9/putusan.pdf">Putusan 12/PUU-XV/2017</a> Menolak permohonan atas Pasal 3 ayat (1) dan Pasal 7 untuk seluruhnya</li></ul></div>
<a href="/Download/8/uu4.pdf">Unduh</a></body></html>"""),
    (2, """<body><div class="row"><div class="col-3">Bentuk</div><div class="col-9">Peraturan Daerah</div></div><div class="row"><div class="col-3">Nomor</div><div class="col-9">No. 17</div></div>
<div class="row"><div class="col-3">Tempat Penetapan</div><div class="col-9">Sekajati</div></div><div class="content"><p>Pasal 1</p><p>Dalam peraturan ini</p><p>berlaku PP No. 5 Tahun 2004</p><p>Pasal 2</p><p>Cukup jelas</p></div></body>"""),
    (3, """<table><tr><th>Tahun<td>1998</tr><tr><td>Status</td><td>Tidak Berlaku</td></tr></table><dl><dt>Judul</dt><dd>Tata Ruang Wilayah</dd><dt>Tahun Terbit</dt><dd>1999</dd></dl>"""),
    (4, """<table><tr><td><a href="/Details/5/perda-3-2001">Perda No. 3 Tahun 2001</a></td><td>Tidak Berlaku</td></tr></table><a href="/Details/6/x">Peraturan Presiden Nomor 8 Tahun 2015 berlaku</a>"""),
    (5, ""),
)


def _pages(spark: SparkSession) -> DataFrame:
    share_package(spark)
    return spark.createDataFrame(list(PAGES), "page_id bigint, html string").select("page_id", html.page_record(F.col("html"), BASE).alias("p"))


def page_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark).select("page_id", F.explode("p.metadata").alias("field", "value"))


def page_relationships(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark).select("page_id", F.explode("p.relationships").alias("relation", "refs")).select("page_id", "relation", F.inline("refs"))


def page_decisions(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark).select("page_id", F.col("p.review_pdf").alias("review_pdf"), html.pdf_link(F.col("p.links")).alias("pdf"), F.inline("p.uji_materi"))
    return rows.select("page_id", "review_pdf", "pdf", "decision_number", "decision_type", F.array_join("provision_references", "; ").alias("provisions"))


def page_results(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark).select("page_id", F.inline("p.results")).where("page_id = 4")


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark).where("p.text <> ''").select("page_id", F.col("p.text").alias("text"), F.array_join("p.text_references", "; ").alias("named"))


QUERIES = {f.__name__: f for f in (page_metadata, page_relationships, page_decisions, page_results, page_texts)}


def _values(columns: str, *rows: tuple) -> str:
    def one(v: object) -> str:
        return "NULL" if v is None else "CAST(" + str(v) + " AS BIGINT)" if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


# what a reader finds on these pages
ORACLES = {
    "page_metadata": _values(
        "page_id, field, value", (1, "type", "Undang-undang"), (1, "number", "4"), (1, "year", "2009"), (1, "subject", "PAJAK, RETRIBUSI; -"), (1, "title", "Undang-Undang Nomor 4 Tahun 2009"),
        (2, "form", "Peraturan Daerah"), (2, "number", "17"), (2, "place_enacted", "Sekajati"), (3, "year", "1999"), (3, "status", "Tidak Berlaku"), (3, "title", "Tata Ruang Wilayah"),
    ),
    "page_relationships": _values(
        "page_id, relation, regulation_reference, reference_link", (1, "mencabut", "UU No. 1 Tahun 1999 tentang Kehutanan", f"{BASE}/Details/11/uu-1-1999"), (1, "mencabut", "Staatsblad 1926", None),
        (1, "diubah_dengan", "PP No. 2 Tahun 2011", "https://lain.example/Details/12"),
    ),
    "page_decisions": _values("page_id, review_pdf, pdf, decision_number, decision_type, provisions", (1, f"{BASE}/Download/9/putusan.pdf", "/Download/8/uu4.pdf", "12/PUU-XV/2017", "ditolak", "Pasal 3 ayat (1); Pasal 7")),
    "page_results": _values(
        "page_id, doc_title, detail_url, doc_type, doc_number, doc_year, doc_status", (4, "Perda No. 3 Tahun 2001", f"{BASE}/Details/5/perda-3-2001", "Perda", "3", "2001", None),
        (4, "Peraturan Presiden Nomor 8 Tahun 2015 berlaku", f"{BASE}/Details/6/x", "Peraturan Presiden", "8", "2015", "Berlaku"),
    ),
    "page_texts": _values("page_id, text, named", (2, "Pasal 1 Dalam peraturan ini berlaku PP No. 5 Tahun 2004\n\nPasal 2 Cukup jelas", "PP No. 5 Tahun 2004")),
}

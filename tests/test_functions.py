"""Golden cases of column functions and the parsers."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from statuta.functions import cleaning, html, legal, patterns
from statuta.functions.citation import damerau, form_of, number_of, read_reference
from statuta.operators.tree import parse, parse_tree, roll_up, unit_rows


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.orderBy("i").select(column(F.col("t")).alias("v")).collect()]


def test_ordinals(spark):
    got = values(spark, ["IV", "XIX", "12A", "c", "satu", "", None, "7"], legal.ordinal)
    assert [(r["ordinal_int"], r["ordinal_suffix"]) for r in got] == [(4, ""), (19, ""), (12, "A"), (3, ""), (0, ""), (0, ""), (0, ""), (7, "")]


def test_dates(spark):
    got = values(spark, ["14 Maret 1981", "7 Mei 2003", "2001-02-03", "31/12/1999", "31 Foo 1999", "Unknown", None, "2001-13-40"], legal.to_date)
    assert got == [dt.date(1981, 3, 14), dt.date(2003, 5, 7), dt.date(2001, 2, 3), dt.date(1999, 12, 31), None, None, None, None]


def test_identifiers(spark):
    assert values(spark, ["Undang-Undang", "Peraturan Gubernur Khusus", "", None, "Maklumat Dewan"], legal.type_abbreviation) == ["UU", "PER", "UNKNOWN", "UNKNOWN", "MD"]
    assert values(spark, ["Peraturan Daerah", "Piagam (PG)", None], legal.short_form) == ["Perda", "PG", "Unknown"]
    assert values(spark, ["No. 5/A b", None, "--"], legal.file_part) == ["no_5a_b", "unknown", "unknown"]
    assert values(spark, ["U/bab-I/pasal-3A/ayat-2", "U", None], lambda c: legal.path_number(c, "pasal")) == ["3A", None, None]


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("Pasal 1\r\nKetentuan  umum ini", "Pasal 1\nKetentuan umum ini"),
        ("BABXII tentang sesuatu", "BAB XII tentang sesuatu"),
        ("Pasal\n7 mengatur hal ini", "Pasal 7 mengatur hal ini"),
        ("huruf (11) dan Pasal 27B tetap", "huruf (11) dan Pasal 27B tetap"),
        ("warga memiliki kualitas", "warga memiliki kualitas"),
        ("nilai 1.5 di http://a.b/c", "nilai 1.5 di http://a.b/c"),
        ("isi pasal\n- 3 -\nlanjutan isi", "isi pasal\n\nlanjutan isi"),
        ("pendek", ""),
    ],
)
def test_cleaning(spark, text, clean):
    assert values(spark, [text], cleaning.clean) == [clean]


def test_cleaning_of_null(spark):
    assert values(spark, [None, ""], cleaning.clean) == [None, ""]


def test_patterns(spark):
    text = "BAB I\nPasal 1\n(1) satu\n(2) dua\na. x\nPasal 1\nUndang-Undang Nomor 4 Tahun 2009"
    got = values(spark, [text], lambda c: patterns.extract(c, patterns.ARTICLES, distinct=True))[0]
    assert [r["value"] for r in got] == ["1"]
    assert values(spark, [text], lambda c: F.size(patterns.extract(c, patterns.VERSES))) == [2]
    assert values(spark, [text, "x", None], patterns.document_type) == ["UU", None, None]
    report = values(spark, [text], patterns.structure_report)[0]
    assert report["score"] == 1.0 and report["is_valid"]


def test_tree(spark):
    text = "BAB I\nKETENTUAN UMUM\nPasal 1\nDalam peraturan ini\n(1) verse satu yang panjang;\na. huruf pertama;\nb. huruf kedua;\n(2) verse dua\nPasal 1\nulang\nPasal 3 ayat (1) berlaku sebagai kutipan"
    nodes = parse("D", text)
    ids = [n[7] for n in nodes]
    assert ids == ["D/bab-I", "D/bab-I/pasal-1", "D/bab-I/pasal-1/ayat-1", "D/bab-I/pasal-1/ayat-1/huruf-a", "D/bab-I/pasal-1/ayat-1/huruf-b", "D/bab-I/pasal-1/ayat-2", "D/bab-I/pasal-1-2"]
    assert len(set(ids)) == len(ids) and nodes[0][5] == "KETENTUAN UMUM"
    assert nodes[2][9] == "D/bab-I/pasal-1" and nodes[1][9] is None
    docs = spark.createDataFrame([("D", "Judul", text), ("E", None, None), ("F", "x", ""), ("G", "x", "tanpa struktur")], "doc_id string, doc_title string, doc_content string")
    units = unit_rows(parse_tree(docs), docs.select("doc_id", "doc_title"))
    by_id = {r["unit_id"]: r for r in units.collect()}
    assert len(by_id) == 7
    letter = by_id["D/bab-I/pasal-1/ayat-1/huruf-a"]
    assert letter["citation_string"] == "Judul, Pasal 1 ayat (1) huruf a" and letter["seq_sort_key"] == "0001|" and letter["label_display"] == "a."
    content = {r["unit_id"]: r["content"] for r in roll_up(units).collect()}
    assert content["D/bab-I/pasal-1"].split("\n\n") == ["Dalam peraturan ini", "verse satu yang panjang;", "huruf pertama;", "huruf kedua;", "verse dua"]


def test_references():
    r = read_reference("Peratran Menteri No. XLIV Th. 2023, Pajak Rumah Susun Sewa di Ulin")
    assert (r.code, r.title[:2]) == ("PERMEN-2023-44", ["pajak", "rumah"])
    assert read_reference("U.U. Nomor Tiga Puluh Empat Tahun 1991").code == "UU-1991-34"
    assert read_reference(" per. daerah 013/2007 ").code == "PERDA-2007-13"
    assert read_reference("Per. Daerah No. l2 Tahun l997 tentang X").code == "PERDA-1997-12"
    assert read_reference("lihat juga Peraturan OJK 50 thn 03 perihal Pembinaan").code == "POJK-2003-50"
    assert read_reference("Undang-Undang Tahun 2022 Nomor 12").code == "UU-2022-12"
    amending = read_reference("SE No. 3 Tahun 2012 tentang Perubahan atas Keputusan Nomor 2 Tahun 2001 tentang Pajak")
    assert amending.code == "SE-2012-3" and amending.amends and "#kep" in amending.title
    for text in (None, "", " ", "-", "?", "n/a", "lihat lampiran", "(tidak ada)"):
        assert not read_reference(text).names
    assert read_reference("Ordonansi Pelabuhan Nomor 3 Tahun 1950").form is None
    assert form_of("Peraturan Pemerintah Pengganti Undang-Undang") == "PERPU" and form_of("bab") is None
    assert number_of("XIX") == "19" and number_of("sebelas") == "11" and number_of("dua puluh satu") == "21"
    assert damerau("kota", "okta") == 1 and damerau("abc", "xyz", 1) == 2


def test_html(spark):
    page = """<html><head><title>x</title></head><body><h1>Judul Peraturan Panjang</h1><table><tr><td>Nomor</td><td>No. 12</td></tr><tr><th>Tahun</th><td>2004</td></tr></table>
    <div class="row"><div>Status</div><div>Berlaku</div></div><a href="/Download/1/uji_materi.pdf">Uji Materi</a><a href="/Download/2/uu.pdf">unduh</a></body></html>"""
    meta, links = html.read_page(page)
    assert meta["number"] == "12" and meta["year"] == "2004" and meta["status"] == "Berlaku" and len(links) == 2
    assert html.read_page(None) == ({}, [])
    got = values(spark, [page, None, ""], html.page_fields)
    assert got[0]["metadata"]["title"] == "Judul Peraturan Panjang" and got[1]["metadata"] == {}
    df = spark.createDataFrame([(page,)], "t string").select(html.pdf_link(html.page_fields(F.col("t"))["links"]).alias("p"))
    assert df.first()["p"] == "/Download/2/uu.pdf"
    assert values(spark, ["PAJAK; retribusi, x; Pajak"], html.subjects) == [["PAJAK", "RETRIBUSI"]]

"""Orphan references against a plain reading of the same rules, and the filter against a set."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from statuta.operators.bloom import BloomFilter
from statuta.operators.orphans import orphan_references, orphan_report
from statuta.operators.spelling import correct_words

T = dt.datetime
LEGAL = "doc_id string, doc_title string, detail_url string, deleted_at timestamp, ingested_at timestamp, text string"
CATALOG = "doc_id string, doc_title string, withdrawn_at timestamp"
REFS = "ref_id bigint, regulation_reference string, reference_link string, recorded_at timestamp, target string, doc string"


def tables(spark):
    legal = [
        ("UU-2001-1", "Undang-Undang Nomor 1 Tahun 2001 tentang Pengelolaan Hutan Rakyat Kota Banyu", "https://x/Details/100/a", None, T(2020, 1, 1), "c"),
        ("PP-2002-2", "Pembinaan Pasar Desa di Kabupaten Randu", "https://x/Details/101/b", T(2021, 1, 1), T(2019, 1, 1), "c"),
        ("PP-2002-2", "Pembinaan Pasar Desa di Kabupaten Randu", "https://x/Details/101/b", T(2021, 2, 1), T(2019, 2, 1), "c"),
        ("PERDA-2003-3", None, "https://x/details/0102", None, T(2023, 1, 1), None),
        (None, None, None, None, None, None),
    ]
    catalog = [("SE-2010-5", "Pemulihan Lahan Gambut bagi Daerah Tertinggal Lemo", None), ("SE-2011-6", "Retribusi Parkir Tepi Jalan Kota Sekar", T(2022, 1, 1))]
    return spark.createDataFrame(legal, LEGAL), spark.createDataFrame(catalog, CATALOG)


CASES = [
    (1, None, "https://x/Details/100/a", T(2021, 1, 1), None),
    (2, None, "HTTPS://X/DETAILS/999", T(2021, 1, 1), "absent"),
    (3, None, "/details/101", T(2021, 1, 1), "deleted"),
    (4, None, "//x/Details/102#r", T(2022, 1, 1), "late"),
    (5, "PERDA-2003-3", None, T(2024, 1, 1), None),
    (6, "uu no. 1 thn 2001", "#", T(2024, 1, 1), None),
    (7, "Undang-Undang Nomor 9 Tahun 2001", "", T(2024, 1, 1), "absent"),
    (8, "Pengelolaan Hutn Rakyat Kota Bnayu", None, T(2024, 1, 1), None),
    (9, "UU No. 77 Tahun 1999 tentang Pengelolaan Hutan Rakyat Kota Banyu", None, T(2024, 1, 1), None),
    (10, "Surat Edaran 6/2011", "javascript:void(0)", T(2000, 1, 1), "withdrawn"),
    (11, "Se. nomor 5, tahun 2010", None, T(2000, 1, 1), None),
    (12, "-", None, T(2024, 1, 1), None),
    (13, None, None, T(2024, 1, 1), None),
    (14, "lihat lampiran", "https://x/unduh/a.pdf", None, None),
    (15, "Ordonansi Pelabuhan Nomor 3 Tahun 1950", None, None, "absent"),
    (16, "Pemulihan Lahan Gambut bagi Daerah Terti…", None, T(2024, 1, 1), None),
    (17, "PembinaanPasarDesadiKabupatenRandu 2002", None, T(2024, 1, 1), "deleted"),
    (19, "Pemulihan Lahan Gambut bagi Daerah Ter dst.", None, T(2024, 1, 1), None),
    (20, "Surat Edaran ttg Pemulihan Lahan Gambut bagi Daerah Terting", None, T(2024, 1, 1), None),
    (21, "Perda ttg Pembinaan Pasar Desa di Kabupaten Ran", None, T(2024, 1, 1), "deleted"),
    (18, "x" * 50_000, None, T(2024, 1, 1), "absent"),
]


def test_reasons(spark):
    legal, catalog = tables(spark)
    refs = spark.createDataFrame([(i, t, u, r, "clash", "clash") for i, t, u, r, _ in CASES], REFS)
    got = {r["ref_id"]: r["reason"] for r in orphan_references(refs, legal, catalog).collect()}
    assert got == {i: why for i, _, _, _, why in CASES if why}


def test_repeated_rows_and_empty_tables(spark):
    legal, catalog = tables(spark)
    refs = spark.createDataFrame([(i, t, u, r, "", "") for i, t, u, r, _ in CASES], REFS)
    once = orphan_references(refs, legal, catalog).count()
    assert orphan_references(refs.union(refs), legal, catalog).count() == 2 * once
    assert orphan_references(refs.where("false"), legal, catalog).count() == 0
    bare = orphan_references(refs, legal.where("false"), catalog.where("false"))
    assert {r["reason"] for r in bare.collect()} == {"absent"}
    report = orphan_report(orphan_references(refs, legal, catalog))
    assert sum(r["n_orphans"] for r in report.collect()) == once


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    other = spark.range(20_000, 60_000).select(F.concat(F.lit("k"), "id").alias("key"))
    bloom = BloomFilter(keys)
    assert bloom.probe(keys).where("not maybe").count() == 0
    assert bloom.probe(other).where("maybe").count() < 40_000 * 0.05
    crowded = BloomFilter(keys, max_blocks=1)  # too small: more maybes, never a wrong no
    assert crowded.probe(keys).where("not maybe").count() == 0
    assert BloomFilter(keys.where("false")).probe(other).where("maybe").count() == 0


def test_corrections_are_nearest_words(spark):
    lexicon = spark.createDataFrame([("kabupaten", 9), ("kawasan", 8), ("pembinaan", 5), ("pembiayaan", 4), ("kota", 9), ("rakyat", 3)], "word string, n bigint")
    words = spark.createDataFrame([("kabupatn",), ("kbaupaten",), ("kws.",), ("kab.",), ("okta",), ("akyat",), ("zzzzzz",), ("kota",)], "word string")
    got = {r["word"]: r["correction"] for r in correct_words(words, lexicon).collect()}
    assert got == {"kabupatn": "kabupaten", "kbaupaten": "kabupaten", "kws.": "kawasan", "kab.": "kabupaten", "okta": "kota", "akyat": "rakyat"}

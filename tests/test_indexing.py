"""Trees to units, article texts, processed texts, templates, models, tables and the command line."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from statuta.__main__ import run
from statuta.config import Chunking, timed
from statuta.functions import cleaning, html, legal, models, patterns
from statuta.functions.templates import Template, Templates, rendered
from statuta.operators import indexing
from statuta.sources import tables, writers


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def node(kind, unit, *children, **more):
    return {"type": kind, "unit_id": unit, "children": list(children), **more}


TREE = node(
    "dokumen", "D",
    node("bab", "D/bab-I", node("pasal", "D/p1", node("ayat", "D/p1/a1", node("huruf", "D/p1/a1/a", number_label="a", local_content="satu"), number_label="1", local_content="dua"), number_label="1"), label_display="BAB I"),
    node("pasal", "D/p1", node("ayat", "D/p1/new", number_label="9", local_content="never indexed"), number_label="1"),
    node("lampiran", "D/x", number_label="IV"),
)


def test_flatten():
    rows = indexing.flatten(TREE)
    assert [r[3] for r in rows] == ["D/bab-I", "D/p1", "D/p1/a1", "D/p1/a1/a", "D/x"]  # the repeated article goes with all below it
    assert [r[8] for r in rows] == [None, None, "D/p1", "D/p1", None]  # the nearest article above
    assert rows[4][2] == "DOKUMEN" and rows[0][7] == "D" and rows[3][9] == ["BAB I", "1", "1", "a"]
    assert [r[3] for r in indexing.flatten({"type": "pasal", "unit_id": "only"})] == ["only"]  # a childless root is indexed itself
    assert [r[3] for r in indexing.flatten({"children": {"type": "pasal"}})] == ["/0"]  # a lone child, named by its place
    deep = {"type": "pasal"}
    for _ in range(3_000):
        deep = {"type": "bab", "children": [deep]}
    assert len(indexing.flatten(deep)) == 3_000


def test_unit_rows(spark):
    trees = [json.dumps(TREE), None, "not json", "[1]", "{}", json.dumps(TREE)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(trees)], "record_id bigint, document_tree string, unit_id string")
    units = indexing.unit_rows(df, "record_id")
    assert {r["record_id"]: r["count"] for r in units.groupBy("record_id").count().collect()} == {0: 5, 4: 1, 5: 5}
    row = units.where("record_id = 0 and unit_id = 'D/x'").first()
    assert row["ordinal_int"] == 4 and row["seq_sort_key"] == "0004|"
    texts = {(r["record_id"], r["unit_id"]): r["full_content"] for r in indexing.article_texts(units, "record_id").collect()}
    assert texts == {(k, "D/p1"): "  (1) dua\n    a. satu" for k in (0, 5)}
    assert indexing.unit_rows(df.where("false"), "record_id").count() == 0
    assert {r["n_nodes"] for r in indexing.tree_sizes(units.where("record_id = 0"), "record_id").collect()} == {6}


def test_processing(spark):
    texts = spark.createDataFrame([("a", "Pasal 1\nSetiap orarg wajib\nlapor."), ("b", None), ("c", "x")], "doc_id string, text string")
    got = {r["doc_id"]: (r["doc_content"], r["doc_processing_status"], r["confidence"]) for r in indexing.processed_texts(texts, "doc_id", "text").collect()}
    assert got == {"a": ("Pasal 1\nSetiap orang wajib lapor.", "txt_processed", 100.0), "b": (None, "failed", 100.0), "c": ("", "failed", 100.0)}
    pages = spark.createDataFrame([("d", 2, "dua", 80.0), ("d", 1, "satu", 60.0), ("d", 3, "buram", 59.0), ("e", 1, "x", 10.0)], "doc_id string, page_no int, text string, confidence double")
    assert [tuple(r) for r in indexing.pages_text(pages, "doc_id").collect()] == [("d", "satu\n\ndua", 70.0, 2)]
    docs = spark.createDataFrame([("D", "Judul", "BAB I\nUMUM\nPasal 1\n(1) ayat pertama;\na. huruf;"), ("E", "x", None)], "doc_id string, doc_title string, doc_content string")
    units = {r["unit_id"]: r["content"] for r in indexing.indexed_texts(docs).collect()}
    assert units["D/bab-I/pasal-1"] == "ayat pertama;\n\nhuruf;"


def test_vectors(spark):
    units = spark.createDataFrame([("D", "D/bab-I/pasal-1", "PASAL", "satu dua"), ("D", "D/bab-I/pasal-2", "PASAL", "salah"), ("D", "D/bab-I/pasal-3", "PASAL", " "), ("D", "D/x", "AYAT", "isi")], "doc_id string, unit_id string, unit_type string, content string")
    docs = spark.createDataFrame([("D", "UU", 2001, "1", "Berlaku")], "doc_id string, doc_form string, doc_year int, doc_number string, doc_status string")

    def embed(texts, task):
        if "salah" in texts:
            raise ValueError("broken")
        return [[1.0, 2.0] for _ in texts]

    rows = indexing.vector_rows(units, docs, models.embedded(F.col("content"), embed, dimension=2, batch=1, retries=0), 2).collect()
    assert [(r["unit_id"], r["pasal_number"], r["token_count"], r["embedding"]) for r in rows] == [("D/bab-I/pasal-1", "1", 2, [1.0, 2.0])]
    assert indexing.vector_rows(units, docs).count() == 2


def test_models(spark):
    tried = []

    def flaky(x):
        tried.append(x)
        if len(tried) < 3:
            raise models.Retry
        return x

    waits = []
    assert models.retrying(flaky, 7, sleep=waits.append) == 7 and waits == [1.0, 2.0] and models.wait_before(9) == 10.0
    with pytest.raises(ValueError):
        models.retrying(lambda: (_ for _ in ()).throw(ValueError()), sleep=waits.append)
    assert values(spark, ["a", None, " ", "b"], lambda c: models.completed(c, lambda ts: [t.upper() for t in ts])) == ["A", None, None, "B"]
    assert values(spark, ["a", "b"], lambda c: models.completed(c, lambda ts: [])) == [None, None]
    assert values(spark, ['```json\n{"x": "1"}\n```', "no"], lambda c: models.answer_fields(c, "x string")["x"]) == ["1", None]
    with pytest.raises(ValueError):
        models.embedded(F.lit("x"), lambda t, k: [], task="other")


def test_templates(spark):
    t = Template("t", "Halo {nama}, {{bukan}} {kota}", ("nama",))
    box = Templates()
    box.add(t)
    assert box.render("t", nama="A", kota="B") == "Halo A, {bukan} B" and t.places == ("nama", "kota")
    with pytest.raises(KeyError):
        box.render("t", nama="A")
    for bad in (Template("", "x"), Template("a", " "), Template("a", "x", ("y",)), Template("a", "x {")):
        with pytest.raises(ValueError):
            box.add(bad)
    with pytest.raises(ValueError):
        box.update("t", "tanpa tempat")
    assert Templates.from_json(box.to_json()).items == box.items and box.statistics()["n_places"] == 2
    got = values(spark, ["x", None], lambda c: rendered(t, nama=c, kota=F.lit("K")))
    assert got[0]["text"] == "Halo x, {bukan} K" and got[0]["missing"] == [] and got[1]["text"] is None and got[1]["missing"] == ["nama"]


def test_cleaning_phases(spark):
    def one(text, f):
        return values(spark, [text], f)[0]

    assert one("Pasa1 5 dan\r\nﬁnal “kata” Ｘ", cleaning.normalise_unicode) == 'Pasa1 5 dan\nfinal "kata" X'
    assert one("isi\n- 3 -\n~~~\na. item\nBAB II . . .\n(2) ayat ...", cleaning.remove_noise_lines) == "isi\n\n\na. item\nBAB II . . .\n(2) ayat ..."
    assert one("P A S A L\nP A\nA B C", cleaning.close_spaced_capitals) == "PASAL\nP A\nA B C"
    assert one("k0ta ada1ah dengaa clalam Undarg dan / atau", cleaning.correct_ocr) == "kota adalah dengan dalam Undang dan/atau"
    assert one("orang yang\nmelapor kepada Pemerintah\nDaerah wajib.\nPasal 2\na. satu;\nb. dua", cleaning.rejoin_lines) == "orang yang melapor kepada Pemerintah Daerah wajib.\nPasal 2\na. satu;\nb. dua"
    assert one("syarat: a. satu; b. dua", cleaning.expand_lists) == "syarat:\na. satu;\nb. dua"
    for text, want in (
        ("BAB ll\nKETENTUAN PIDANA", "BAB II\nKETENTUAN PIDANA"), ("Pasal 1 2\nIsi pasal ini.", "Pasal 12\nIsi pasal ini."), ("sebagaimana dimaksud pada ayat\n(1) huruf\na berlaku", "sebagaimana dimaksud pada ayat (1) huruf a berlaku"),
        ("Undang-\nUndang Nomor\n4 Tahun\n2009", "Undang-Undang Nomor 4 Tahun 2009"), ("(1) (1) Ayat yang dobel. (2) Pemohon lapor.", "(1) Ayat yang dobel.\n(2) Pemohon lapor."), ("Pasal 27B (11) 1.5 www.a.example", "Pasal 27B\n(11) 1.5 www.a.example"),
    ):
        assert one(text, cleaning.clean) == want
    got = one("isi pasal yang panjang\n\n\n\nakhir", cleaning.cleaned_with_statistics)
    assert got["text"] == "isi pasal yang panjang\n\nakhir" and not got["fallback"] and got["operations"][0] == "normalize_unicode" and got["reduction"] > 0
    lines = ["BAB II", "Pasal 3", "isi biasa.", "dan seterusnya", "yang"]
    assert values(spark, lines, cleaning.is_structure_line) == [True, True, False, False, False] and values(spark, lines, cleaning.is_sentence_end)[2]
    assert values(spark, lines, cleaning.is_continuation) == [False, False, True, True, True] and values(spark, lines, cleaning.is_incomplete)[4]


def test_patterns(spark):
    text = "Pasal 1\nKetentuan Umum\nIsi satu UU No. 3 Tahun 2001.\n(1) ayat\n[2] kurung\n(3) tiga\nPasal 2\nIsi dua\nBAB II\nPasal 3\nakhir"
    assert values(spark, [text], lambda c: patterns.article_slice(c, F.lit("2"))) == ["Pasal 2\nIsi dua\n"] and values(spark, [text], lambda c: patterns.article_slice(c, F.lit("9"))) == [None]
    got = values(spark, [text, "", None], lambda c: patterns.located(c, patterns.VERSES))
    assert [r["value"] for r in got[0]] == ["1", "2", "3"] and [r["place"] for r in got[0]] == sorted(r["place"] for r in got[0]) and got[1] == [] and got[2] is None
    assert values(spark, [text], lambda c: patterns.extract(c, patterns.TITLED_ARTICLES))[0][0]["value"] == "1"
    assert values(spark, [text], lambda c: patterns.pattern_counts(c)["articles"]) == [3] and values(spark, ["perda", "Perjanjian"], patterns.normalised_type) == ["PERDA", "PERJANJIAN"]
    assert values(spark, ["Tentang Perda No. 3 Tahun 2001", None], lambda c: legal.title_kind(c)["number"]) == ["3", None] and values(spark, ["UU", "x"], legal.type_number) == ["8", None]


def test_pages():
    assert html.parse(None).text() == "" and html.read_page("<td>Nomor<td>5") == ({}, []) and html.metadata(html.parse("<table><tr><td>Nomor Peraturan<td>No 5</table>")) == {"number": "5"}
    assert html.metadata(html.parse("<meta property='og:title' content='Judul meta'><title>BPK panjang sekali</title>")) == {"title": "Judul meta"}
    assert html.reference_text("1. UUtentangPajak") == "UU tentang Pajak" and html.reference_text("a. Surat biasa") == "Surat biasa" and html.reference_text("P eraturan Daerah") == "P eraturan Daerah"
    assert html.text_references("PP No. 5  Tahun 2004 dan PP No. 5 Tahun 2004") == ["PP No. 5 Tahun 2004"]
    assert html.article_blocks("Pasal 1\nsatu\ndua\n\nPasal 2 ayat (1)\ntiga") == "Pasal 1 satu dua\n\nPasal 2 ayat (1) tiga"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "z"), ("a", 1, "x"), ("b", 5, "")], "k string, n int, t string")
    assert sorted(map(tuple, writers.one_each(rows, "k", "n").collect())) == [("a", 1, "x"), ("b", 5, "")]
    old = spark.createDataFrame([("p",), ("q",)], "s string")
    assert sorted(r[0] for r in writers.with_dimension(old, spark.createDataFrame([("q",), ("r",), (None,)], "s string"), "s").collect()) == ["p", "q", "r"]
    writers.write_texts(rows.where("n <> 2"), str(tmp_path / "t"), "k", "t", "k")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["b", "x", "z"]


def test_settings():
    assert Chunking().problems() == [] and len(Chunking(most=50, overlap=30, verse=60).problems()) >= 4
    with pytest.raises(ValueError), timed("x") as record:
        raise ValueError("no")
    assert record["status"] == "failed" and record["duration_ms"] >= 0


def test_command_line(spark, tmp_path):
    root = str(tmp_path / "tables")
    assert len(run(["--root", root, "init"], spark)) == len(tables.SCHEMAS) and run(["--root", root, "init"], spark) == []
    jsons, texts = tmp_path / "json", tmp_path / "text"
    jsons.mkdir()
    texts.mkdir()
    record = {"doc_id": "UU-2001-1", "doc_title": "Judul", "doc_form": "uu", "doc_number": "1", "doc_year": "Unknown", "doc_subject": ["PAJAK", " "], "document_tree": json.dumps(TREE)}
    (jsons / "a.json").write_text(json.dumps(record))
    (jsons / "b.json").write_text(json.dumps(record | {"doc_id": "UU-2001-2", "document_tree": None}))
    assert run(["--root", root, "index", str(jsons)], spark) == [{"n_documents": 2, "n_units": 5, "n_subjects": 1}]
    assert run(["--root", root, "index", str(jsons)], spark) == [{"n_documents": 0, "n_units": 0, "n_subjects": 0}]
    assert {r["table_name"]: r["n_rows"] for r in run(["--root", root, "status"], spark)}["documents"] == 2
    (texts / "b.txt").write_text("Pasal 1\nSetiap orang wajib lapor.")
    assert len(run(["--root", root, "reset"], spark)) == len(tables.SCHEMAS)
    assert run(["--root", root, "ingest", str(texts), str(jsons)], spark)[0]["n_documents"] == 1
    assert tables.table(spark, root, "documents").first()["doc_content"] == "Pasal 1\nSetiap orang wajib lapor."
    folder = "/root/testdata/sf0.001"
    assert run(["--tables", folder, "search", "pasal 1 ayat (1)", "--strategy", "explicit", "--limit", "3", "--form", "UU"], spark)
    assert isinstance(run(["--tables", folder, "outline", "nothing"], spark), list) and run(["--tables", folder, "related", "nothing"], spark) == []
    assert run(["--tables", folder, "benchmark"], spark)[0]["n_queries"] == 8

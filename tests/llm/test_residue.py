"""Residue: learns from weak labels, generalises, spares content that speaks about messages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from statuta.llm.residue import family, kept, residue, validate

GOOD = [f"(1) Pemohon wajib menyampaikan dokumen {w} kepada bupati paling lambat {i} hari.\nPasal {i}" for i, w in enumerate(["izin", "lingkungan", "usaha", "retribusi", "parkir", "pasar", "hutan", "air"] * 20)]
BAD = ["404 Not Found", "Terjadi gangguan pada sistem", "Silakan aktifkan JavaScript di peramban Anda.", "You need to enable JavaScript to run this app", "Lorem ipsum quidam tores velor", "lorem ipsum tores quidam mundi", "xxx xxx xxx", '{"status": 503, "message": "x"}', "503 Service Unavailable", "Gagal memuat berkas"]
SPARED = [
    "Pelaku usaha wajib memastikan situs layanan menampilkan pesan halaman tidak ditemukan dengan sopan.",
    "Ketentuan ayat (2) [dihapus].",
    "LAMPIRAN FORMULIR\nNama pemohon : ....................\nTanda tangan : ( .................... )",
    "Rumus tarif adalah {a + b} dikalikan indeks [c] sebagaimana tercantum dalam lampiran.",
]
SCHEMA = "doc_row_id bigint, doc_title string, doc_content string, detail_url string, field_name string, score double, segment string"


def frame(spark, cells):
    return spark.createDataFrame([(i, t, c, f"https://h{i % 7}.example/x", "clash", 1.0, "clash") for i, (t, c) in enumerate(cells)], SCHEMA)


def test_cells(spark):
    title = "Peraturan Daerah Nomor 5 Tahun 2001 tentang Pajak Parkir Kota Banyu"
    cells = [(title, g) for g in GOOD] + [(title, b) for b in BAD] + [(title, s) for s in SPARED]
    cells += [("Peraturan Menteri Nomor XX Tahun 20XX tentang XXXXX", GOOD[0]), (title, GOOD[0] + "\nDitetapkan di {{tempat}} pada tanggal <tanggal>."), (title, "Tores mundi quidam velor tores"), (None, None), ("", "")]
    df = frame(spark, cells)
    got = {(r["doc_row_id"], r["field_name"]) for r in residue(df).collect()}
    first = len(GOOD)
    want = {(first + i, "doc_content") for i in range(len(BAD))}
    start = first + len(BAD) + len(SPARED)
    want |= {(start, "doc_title"), (start + 1, "doc_content"), (start + 2, "doc_content")}
    assert got == want
    clean = kept(df)
    assert clean.count() == len(cells) and clean.where("doc_title is null").count() == 2
    report = {r["labels_left_out"]: r for r in validate(df).collect()}
    assert report["none"]["group_kind"] == "host" and report["none"]["recall"] >= 0.5
    assert all((r["false_share"] or 0.0) <= 0.05 for r in report.values()) and set(report) <= {"none", "placeholder", "filler", "status", "phrase"}


def test_edge_cases(spark):
    assert residue(frame(spark, [])).count() == 0
    assert residue(frame(spark, [(None, None)] * 3)).count() == 0
    long = " ".join(GOOD) * 20
    cells = [("x", long)] * 2 + [("x", b) for b in BAD] * 2
    got = [(r["doc_row_id"], r["field_name"]) for r in residue(frame(spark, cells)).collect()]
    assert not [g for g in got if g[0] < 2 and g[1] == "doc_content"]
    assert len([g for g in got if g[1] == "doc_content"]) == 2 * len(BAD)


def test_model_finds_what_no_pattern_marks(spark):
    """A message in the words of others, which no pattern knows, is found by the classifier alone."""
    unmarked = "Sistem pada portal sedang gangguan, peramban Anda gagal"
    cells = [("Pajak Parkir", g) for g in GOOD] + [("Pajak Parkir", b) for b in BAD] * 3
    cells += [("Pajak Parkir", f"Terjadi gangguan pada {w} portal, peramban Anda gagal") for w in ("sistem", "layanan", "basis data")] + [("Pajak Parkir", unmarked)]
    df = frame(spark, cells)
    last = len(cells) - 1
    marked = df.where(f"doc_row_id = {last}").select(family(F.col("doc_content"), F.lit(False)).alias("f")).first()["f"]
    assert marked is None and (last, "doc_content") in {(r["doc_row_id"], r["field_name"]) for r in residue(df).collect()}


def test_all_rows_are_learned_from(spark):
    """Residue in a few of many records, whichever they are: 30,000 rows, the last of them by hash of the key."""
    by_hash = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    late = F.row_number().over(Window.orderBy(by_hash.desc(), "id"))
    bad = F.element_at(F.array(*[F.lit(b) for b in BAD]), F.col("late"))
    rows = spark.range(30_000).withColumn("late", late).select(
        F.col("id").alias("doc_row_id"), F.lit("Pajak Parkir").alias("doc_title"),
        F.when(F.col("late") <= len(BAD), bad).otherwise(F.concat(F.lit("Pemohon wajib menyampaikan dokumen "), (F.col("id") % 200).cast("string"))).alias("doc_content"), F.lit(None).cast("string").alias("detail_url"), "late",
    ).persist()
    want = {r["doc_row_id"] for r in rows.where(F.col("late") <= len(BAD)).collect()}
    assert {r["doc_row_id"] for r in residue(rows).where("field_name = 'doc_content'").collect()} == want
    held = F.pmod(F.xxhash64(F.col("doc_row_id").cast("string")), F.lit(5)) == 0
    n_clean = rows.where(held & (F.col("late") > len(BAD))).count()
    report = {r["labels_left_out"]: r for r in validate(rows).collect()}
    assert report["none"]["n_clean"] == n_clean and report["none"]["n_residue"] == rows.where(held & (F.col("late") <= len(BAD))).count()
    rows.unpersist()

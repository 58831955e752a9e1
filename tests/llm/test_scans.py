"""Scan repair: lines, hyphens, misreadings against planted damage, and edge cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from statuta.llm.scans import MISREADINGS, Furniture, broken_compounds, corrections, furniture_of, odd_forms, page_end, paragraphs, read_lines, repaired, scan_defects, text_lines, typed_forms, word_counts

WORDS = "pemerintah daerah wajib menyampaikan laporan berkala kepada masyarakat sesuai dengan ketentuan perizinan lingkungan hidup".split()
SCHEMA = "k bigint, text string, table_name string, word string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


def found(spark, texts):
    rows = scan_defects([(frame(spark, texts), "k", "text", "t")]).collect()
    return sorted((r["row_key"], r["line_no"], r["defect"]) for r in rows)


HEADERS = ["SK No 035746 C", "S A L I N A N", "jdih.kota.example", "Undang-Undang No. 8/1995", "BUPATI X YZW  4/5"]


def corpus(headers, pages=12, seed=11):
    """Texts of several pages whose running headers recur beside page numbers and nowhere else."""
    rng = random.Random(seed)
    texts = []
    for n in range(pages):
        lines = []
        for page in range(1, 4):
            lines += [" ".join(rng.sample(WORDS, 8)) + "," for _ in range(6)]
            lines += [f"- {page} -", headers[n % len(headers)]]
        texts.append("\n".join([*lines, "Pasal 3", " ".join(WORDS) + "."]))
    return texts


def test_margins(spark):
    for line in ("- 2 -", "–  11 –", "[3]", "2 |", "4/5", "Halaman 2 dari 3", "hlm. 7", "Hal : 2", ". . . 1", "xii", "tata urutan …", "(9) Untuk . . ."):
        assert page_end(line), line
    seen = furniture_of([(frame(spark, corpus(HEADERS, 40)), "k", "text", "t")])
    for line in HEADERS:
        assert seen.is_margin(["pembuka biasa", "isi biasa", "isi lagi", line], 3), line
    for line in ("(3)", "BAB XII", "Pasal 8C", "2021.", "pemohon.", "a. memeriksa;", "07.00 - 15.00 waktu"):
        assert not page_end(line) and not seen.is_margin(["pembuka", "isi biasa", "isi lagi", line], 3), line
    # capitals that open a document or stand under a chapter heading are its own
    assert not seen.is_margin(["PERATURAN DAERAH NOMOR 2 TAHUN 2001", "isi"], 0)
    assert not seen.is_margin(["a", "b", "c", "BAB II", "KETENTUAN UMUM"], 4)
    assert not Furniture({}).is_margin(["a", "b", "c", "S A L I N A N"], 3)


def test_headers_of_an_unseen_publisher(spark):
    """Host, mixed-case header and filing mark of a publisher that the code has never heard of."""
    headers = ["Warta Hukum Negeri Antah", "arsip.antah-berantah.test", "Berkas AB-77 Seri 9"]
    texts = corpus(headers, 30)
    got = found(spark, texts)
    want = {(k, n, "margin") for k, t in enumerate(texts) for n, line in enumerate(t.split("\n"), 1) if line in headers or page_end(line)}
    assert {g for g in got if g[2] == "margin"} == want
    # the same lines that never stand beside a page end are text
    plain = [f"{h}\n{' '.join(WORDS)}" for h in headers] * 10
    assert not [g for g in found(spark, plain) if g[2] == "margin"]


def test_hyphens_over_furniture():
    lines = {e[0]: e for e in read_lines("kata me-\n- 3 -\n\nnulis lagi\nperundang-\nundangan")}
    assert lines[1][2] and lines[1][3] == 4 and lines[2][1] and lines[4][4].strip() == "lagi"
    assert lines[5][2] and not lines[6][2]
    assert not read_lines("pukul 07.00 -\n15.00")[0][2]


def test_planted_damage(spark):
    rng = random.Random(3)
    texts, want = [], set()
    for i in range(400):
        lines = []
        for n in range(1, 4):
            words = [rng.choice(WORDS) for _ in range(9)]
            if rng.random() < 0.1:
                j = rng.randrange(len(words))
                true, seen = rng.choice([r for r in MISREADINGS if r[0] and r[0].isalpha() and r[0] in words[j]] or [("", "")])
                if true:
                    words[j] = words[j].replace(true, seen, 1)
                    want.add((i, n, "glyph"))
            lines.append(" ".join(words))
        texts.append("\n".join(lines))
    assert set(found(spark, texts)) == want


def test_corrections_follow_frequency(spark):
    counts = spark.createDataFrame([("dalam", 500), ("dalarn", 3), ("clalam", 2), ("rukun", 40), ("co2", 30), ("tahun", 90), ("tahuri", 1), ("dari", 80), ("dan", 300)], "word string, n bigint")
    got = {r["word"]: r["correction"] for r in corrections(counts).collect()}
    assert got == {"dalarn": "dalam", "clalam": "dalam", "tahuri": "tahun"}


def test_copies_do_not_hide_damage(spark):
    rng = random.Random(5)
    clean = [" ".join([*rng.sample(WORDS, 9), f"butir {i}"]) for i in range(60)]
    damaged = "pemerintah dacrah wajib"
    for copies in (1, 400):
        assert found(spark, [*clean, *[damaged] * copies]) == [(60 + i, 1, "glyph") for i in range(copies)]
    # one ratio, whatever the number
    for size in (1, 1000):
        counts = spark.createDataFrame([("kerja", 8 * size), ("kerjo", size), ("kota", 6 * size), ("kata", 2 * size)], "word string, n bigint")
        assert [(r["word"], r["correction"]) for r in corrections(counts).collect()] == [("kerjo", "kerja")]


def test_edge_cases(spark):
    long = " ".join(WORDS * 3_000)
    texts = [None, "", " \n ", long, long, "x" * 200_000, "satu baris"]
    assert found(spark, texts) == []
    assert scan_defects([(frame(spark, []), "k", "text", "t")]).count() == 0
    damaged = "sur@t izin\nkepa.da warga\n- 1 -"
    assert found(spark, [damaged, damaged]) == [(k, n, d) for k in (0, 1) for n, d in ((1, "glyph"), (2, "glyph"), (3, "margin"))]


def test_repair(spark):
    texts = [" ".join(WORDS)] * 30 + ["BAB I\nPasal 1\n(1) Pernerintah dae-\n   - 2 -\nrah wojib menyampaikan\nlaporan berkala.\n(2) Kepada masyarakat", None, ""]
    df = frame(spark, texts)
    odd = odd_forms(typed_forms(text_lines(df, "k", "text", "t")))
    out = {r["row_key"]: r["text"] for r in repaired(df, "k", "text", "t", odd).collect()}
    assert out[30] == "BAB I\nPasal 1\n(1) Pemerintah daerah wajib menyampaikan laporan berkala.\n(2) Kepada masyarakat"
    assert out[31] is None and out[32] == "" and len(out) == len(texts)
    assert paragraphs("sebaik-\nbaiknya dan kehati-\nhatian", {}) == "sebaik-baiknya dan kehati-hatian"
    assert word_counts(typed_forms(text_lines(df, "k", "text", "t"))).where(F.col("word") == "daerah").first()["n"] == 31


def test_hyphen_evidence(spark):
    texts = ["dampak sosial-ekonomi dan sosial-ekonomi", "sektor non-formal", "kerja sama dan nonblok", "dampak sosial-\nekonomi, sektor non-\nformal dan masya-\nrakat non-\nblok"]
    df = frame(spark, texts)
    forms = typed_forms(text_lines(df, "k", "text", "t"))
    out = {r["row_key"]: r["text"] for r in repaired(df, "k", "text", "t", odd_forms(forms), broken_compounds(forms)).collect()}
    assert out[3] == "dampak sosial-ekonomi, sektor non-formal dan masyarakat nonblok"

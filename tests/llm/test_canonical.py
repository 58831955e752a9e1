"""Mapping typed references: planted slips come back, strangers are reported, brute force agrees."""

from __future__ import annotations

import random

import pytest

from statuta.llm.canonical import UNMATCHED, Dictionary, deletions, map_to_list, match_report, weighted_distance

PLACES = ["Banyuloka", "Randumoro", "Sekajati", "Tirtasari", "Lemolingga", "Cemolingga"]
TOPICS = ["Pengelolaan Hutan Rakyat", "Pembinaan Pasar Desa", "Pembiayaan Usaha Mikro", "Retribusi Parkir Tepi Jalan", "Pengendalian Pencemaran Sungai"]
CATALOG = [(f"PERDA-{2000 + i}-{j}", f"{t} di Kabupaten {p}") for i, p in enumerate(PLACES) for j, t in enumerate(TOPICS, 1)]
SCHEMA = "ref_id bigint, regulation_reference string, doc_id string, cost double"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 0.0) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame([(*c, "clash") for c in CATALOG], "doc_id string, doc_title string, ref_id string")


def mapped(spark, catalog, texts, **more):
    return [r["doc_id"] for r in map_to_list(frame(spark, texts), catalog, **more).orderBy("ref_id").collect()]


def test_forms(spark, catalog):
    doc, title = CATALOG[3]
    texts = [
        doc, "perda no. 4 thn 2000", "Per. Daerah 04/2000", f"PERDA No. 4 Tahun 2000 tentang {title}", f"Perda No. 99 Tahun 1950 tentang {title}", title.upper(), "RETRIBSI PARKIR TEPI JALAN DI KABUAPTEN BANYULOKA",
        "Retr. Parkir Tepi Jalan di Kab. Banyuloka", "RetribusiParkirTepiJalandiKabupatenBanyuloka 2000", "Parkir Tepi Jalan di Kabupaten Banyuloka Retribusi", "Perda ttg Retribusi Parkir Tepi Jalan di Kabupaten Bany…", f"{title} (Perda Nomor 4 Tahun 2000)",
    ]
    assert mapped(spark, catalog, texts) == [doc] * len(texts)


def test_strangers(spark, catalog):
    texts = ["-", "", " ", "sda", "Ordonansi Pelabuhan No. 4 Tahun 2000", "PERDA-1900-1", "Pengelolaan Hutan Rakyat di Kabupaten Nusantara", "UU No. 1 Tahun 2012 tentang Perubahan atas Peraturan Daerah Nomor 4 Tahun 2000 tentang Retribusi Parkir Tepi Jalan di Kabupaten Banyuloka", "z" * 100_000, None]
    assert mapped(spark, catalog, texts) == [UNMATCHED] * (len(texts) - 1)
    report = match_report(map_to_list(frame(spark, texts), catalog)).collect()
    assert sum(r["n"] for r in report) == len(texts) - 1 and {r["outcome"] for r in report} == {"unmatched"}


def test_good_words_are_not_corrected(spark, catalog):
    others = spark.createDataFrame([("Pajak di Kabupaten Randumuro", "x")] * 2, "doc_title string, w string")
    text = ["Pembinaan Pasar Desa di Kabupaten Randumuro"]
    assert mapped(spark, catalog, text) == ["PERDA-2001-2"]
    assert mapped(spark, catalog, text, other_titles=others) == [UNMATCHED]
    # both names are in the list: one letter apart, never confused
    assert mapped(spark, catalog, ["Pembinaan Pasar Desa di Kabupaten Lemolingga", "Pembinaan Pasar Desa di Kabupaten Cemolingga"]) == ["PERDA-2004-2", "PERDA-2005-2"]


def test_planted_slips(spark, catalog):
    rng = random.Random(5)
    texts, want = [], []
    for _ in range(300):
        doc, title = rng.choice(CATALOG)
        words = title.split()
        j = rng.choice([k for k, w in enumerate(words) if len(w) > 5])
        w = words[j]
        i = rng.randrange(1, len(w) - 1)
        words[j] = rng.choice([w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "q" + w[i + 1 :], w[:i] + w[i] + w[i:]])
        texts.append(" ".join(words))
        want.append(doc)
    got = mapped(spark, catalog, texts)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 295
    index = Dictionary([(d, t, 0) for d, t in CATALOG])
    for text, answer in zip(texts[:60], got, strict=False):
        best = min(CATALOG, key=lambda c: sum(min(weighted_distance(x, y.lower()) for y in c[1].split()) for x in text.lower().split()))
        assert answer in (best[0], UNMATCHED) and index.resolve(text)[0] == answer


def test_bounds_and_empty_tables(spark, catalog):
    # a list longer than a broadcast may be is looked up in shards, with the same answers
    texts = ["PERDA-2000-4", "Pembinaan Psar Desa di Kabupaten Sekajati", "Retr. Parkir Tepi Jalan di Kab. Banyuloka", "-", "Pajak Embung di Kabupaten Nusantara"]
    assert mapped(spark, catalog, texts, max_entries=8) == mapped(spark, catalog, texts) == ["PERDA-2000-4", "PERDA-2002-2", "PERDA-2000-4", UNMATCHED, UNMATCHED]
    twice = frame(spark, texts).union(frame(spark, texts))
    assert map_to_list(twice, catalog, max_entries=8).count() == map_to_list(twice, catalog).count() == 2 * len(texts)
    assert mapped(spark, catalog, []) == []
    assert mapped(spark, catalog.where("false"), ["PERDA-2000-4", "x y z"]) == [UNMATCHED] * 2
    assert mapped(spark, catalog, ["PERDA-2000-4"] * 3) == ["PERDA-2000-4"] * 3
    assert deletions("abc", 1) == {"abc", "bc", "ac", "ab"} and weighted_distance("kota", "okta") < 1 < weighted_distance("kota", "desa")


def test_equal_titles_across_shards(spark):
    """Twelve entries of one title: form, number and year decide, however many shards the list has."""
    title = "Pengelolaan Sampah di Kabupaten Banyuloka"
    entries = [(f"PERDA-{2000 + i}-{i + 1}", title) for i in range(12)] + [("PP-1999-1", "Retribusi Parkir Tepi Jalan di Kabupaten Randumoro"), ("UU-1990-5", "Kehutanan Rakyat Nusantara Bersama")]
    catalog = spark.createDataFrame(entries, "doc_id string, doc_title string")
    texts = [f"Perda No. {i + 1} Tahun {2000 + i} tentang {title}" for i in range(12)]
    # slips, a title cut short, one without blanks, an abbreviation, the title alone (the most referred to, then the smaller key)
    texts += [f"Perda No. 3 Tahun 2002 tentang {title.replace('Sampah', 'Smapah')}", "Retribusi Parkir Tepi Jal…", "RetribusiParkirTepiJalnadiKabupatenRandumoro", "Retr. Parkir Tepi Jalan di Kab. Randumoro", title, "PERDA-2007-8", "PERDA-2007-8", "Kehutanan Rakyat Seberang Laut"]
    want = [e[0] for e in entries[:12]] + ["PERDA-2002-3", "PP-1999-1", "PP-1999-1", "PP-1999-1", "PERDA-2007-8", "PERDA-2007-8", "PERDA-2007-8", UNMATCHED]
    assert mapped(spark, catalog, texts) == want
    for most in (8, 3, 1):
        assert mapped(spark, catalog, texts, max_entries=most) == want


def test_whole_candidate_lists():
    """No expansion or reading is cut off, and a glued title is found whatever part of it is damaged."""
    entries = [(f"PP-2000-{i}", f"Per{c * 3}an {w} Desa Mandiri") for i, (c, w) in enumerate(zip("abdefghijk", ["Ladang", "Sungai", "Pesisir", "Hutan", "Pasar", "Jalan", "Sekolah", "Koperasi", "Perahu", "Kebun"], strict=True))]
    index = Dictionary([(d, t, 0) for d, t in entries])
    assert len(index.spell("per.")) == 11
    for doc, title in entries:
        words = title.split()
        assert index.resolve(" ".join(["Per.", *words[1:]]))[0] == doc
        glue = "".join(words)
        for i in range(0, len(glue) - 1, 3):
            assert index.resolve(glue[:i] + glue[i + 1] + glue[i] + glue[i + 2 :] if i else "x" + glue[1:])[0] == doc

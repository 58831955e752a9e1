"""Personal information: planted persons are found at every mention, look-alikes are left."""

from __future__ import annotations

import random

import numpy as np

from statuta.llm.personal import DIMENSIONS, Model, Node, _h, fit, mask, masked, personal_information, read_nodes, skip_links, train

FIRST = ["Rogiwara", "Sumedha", "Latunda", "Marosto", "Duripa", "Nesarsa", "Watulan", "Joranto"]
LAST = ["Tarumaya", "Olenrio", "Harsukma", "Sentoko", "Kertanaya", "Wiramaja"]
RULE = "Pemohon wajib menyampaikan laporan berkala kepada bupati paling lambat 30 hari kerja. "


def person(rng):
    return f"{rng.choice(FIRST)} {rng.choice(['', 'T. ', 'bin '])}{rng.choice(LAST)}"


def document(rng):
    name = person(rng)
    forms = [
        (f"Saksi pertama bernama {name}.", [("name", name)]),
        (f"Menurut keterangan Ibu {name}, pengukuran di Jl. Kenanga Raya No. 12A, Desa Sekajati belum selesai.", [("name", name), ("address", "Jl. Kenanga")]),
        (f"Nama: {name}\nNIK: 4737050612960802\nTelepon: 0849-2641-3245", [("name", name), ("id_number", "4737050612960802"), ("phone", "0849-2641-3245")]),
        ("Surel rogi_wara@warga.example atau sumedha (at) kantor [dot] test. Hubungi +62 849 2431 9893.", [("email", "rogi_wara"), ("email", "sumedha (at)"), ("phone", "+62")]),
        ("Rekening kas daerah 00420570160 dan nomor registrasi dokumen 9459731418559872 dicatat.", []),
        (f"Kegiatan dilaksanakan oleh PT {rng.choice(LAST)} Abadi. Ruas Jalan Gelatik sampai dengan Jalan Melati ditetapkan.", []),
        ("Ditetapkan di Sekajati pada tanggal 2 Mei 1981", []),
        (f"Pemohon keberatan, Dr. {name}, menyatakan bahwa {name} tidak hadir.", [("name", name), ("name", name)]),
    ]
    text, want = "", []
    for _ in range(rng.randint(2, 5)):
        part, marks = rng.choice(forms)
        text += RULE + "\n"
        at = len(text)
        for kind, value in marks:
            start = text_find(part, value, [w[1] - at for w in want if w[1] >= at and w[0] == kind])
            want.append((kind, at + start))
        text += part + "\n"
    return text, sorted(set(want))


def text_find(part, value, taken):
    start = part.index(value)
    while start in taken:
        start = part.index(value, start + 1)
    return start


def test_planted(spark):
    rng = random.Random(11)
    sample = [document(rng) for _ in range(600)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, (t, _) in enumerate(sample)], "doc_id bigint, text string, kind string, start_pos int")
    got = {(r["doc_id"], r["kind"], r["start_pos"]) for r in personal_information(df).collect()}
    want = {(i, k, s) for i, (_, marks) in enumerate(sample) for k, s in marks}
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


def test_common_words_of_all_documents(spark):
    rng = random.Random(4)
    texts = [document(rng)[0] for _ in range(400)]
    # lower case only in documents beyond the sample: too long for it, or not drawn
    texts += [RULE * 700 + "surat edaran berlaku.", *["Surat Edaran berlaku. Hadir Sumedha Olenrio."] * 150]
    # a name part in lower case in two documents of many different ones (copies count as one)
    texts += [f"Saksi pertama bernama Sumedha Olenrio, berkas {i}." for i in range(450)] + ["tertulis sumedha saja."] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    common = train(df, "doc_id", "text", 300).common
    assert "edaran" in common and "sumedha" not in common


def test_skip_edges_carry_evidence():
    rng = random.Random(2)
    model = fit([document(rng)[0] for _ in range(400)])
    # an unknown name, given away by one mention only
    text = "Saksi pertama bernama Zulfandri Quelmoza.\nKemudian dilihat Zulfandri Quelmoza di balai."
    alone = Model(model.common, model.words, model.numbers, model.chain, 0.0)
    starts = [s for k, s, _ in model.find(text) if k == "name"]
    assert text.index("Zulfandri") in starts and model.skip > 0
    nodes = read_nodes(text, model.common)
    skip_links(nodes)
    second = next(i for i, n in enumerate(nodes) if n.start > 45 and n.key == "zulfandri")
    assert model.names(nodes)[second] > alone.names(nodes)[second]


def test_mask():
    assert mask("a Budi b x@y.z", [("name", 2, 6), ("email", 9, 14)]) == "a [NAME] b [EMAIL]"
    assert mask("abc", []) == "abc"


def test_edge_cases(spark):
    schema = "doc_id bigint, text string"
    texts = [None, "", " ", "A" * 300_000, RULE * 3_000, "Nama: Rogi Tarumaya", "Nama: Rogi Tarumaya"]
    df = spark.createDataFrame(list(enumerate(texts)), schema)
    found = personal_information(df).collect()
    assert {r["doc_id"] for r in found} <= {5, 6}
    out = {r["doc_id"]: r["text"] for r in masked(df).collect()}
    assert len(out) == len(texts) and out[0] is None and out[1] == ""
    assert personal_information(df.where("false")).count() == 0
    assert train(df.where("false"), "doc_id", "text").find("apa saja") == []


def test_only_a_skip_edge_decides_a_number():
    """A number that its own surroundings do not tell is a telephone number where another notation of it is labelled."""
    rng = random.Random(2)
    model = fit([document(rng)[0] for _ in range(400)])
    alone = Model(model.common, model.words, model.numbers, model.chain, 0.0, model.spans)
    text = "Telepon: 0849-2641-3245\nnomor 849-2641-3245 itu"
    second = text.index("849-2641-3245 itu")
    assert ("phone", second) in {f[:2] for f in model.find(text)} and ("phone", second) not in {f[:2] for f in alone.find(text)}


def test_similar_words_are_joined():
    nodes = read_nodes("Saksi Zulfandri hadir.\nLalu Zulfanderi pergi dan Quelmoza datang.", frozenset({"saksi", "lalu"}))
    skip_links(nodes)
    assert nodes[0].links == (1,) and nodes[1].links == (0,) and nodes[2].links == ()


def test_evidence_crosses_many_mentions():
    """What the last of sixty mentions says reaches the first, and passing has settled by then."""
    nodes = [Node(i, i + 1, "w", "Zulfandri", "zulfandri", ("", "", "", "")) for i in range(60)]
    nodes[-1].context = ("bernama", "", "", "")
    skip_links(nodes)
    model = Model(frozenset(), np.zeros(DIMENSIONS), np.zeros((3, DIMENSIONS)), 0.5, 2.0)
    plain = model.names(nodes)
    model.words[_h("p1=bernama")] = 8.0
    model.known.clear()
    told = model.names(nodes)
    assert abs(plain[0]) < 1e-6 and told[0] > 0.05 and told == sorted(told)


def test_roads_and_handles_are_weighed(spark):
    rng = random.Random(9)
    model = fit([document(rng)[0] for _ in range(400)])
    text = RULE + "\nRuas Jalan Gelatik ditetapkan. Alamat Jl. Kenanga Raya No. 12A, Desa Sekajati.\nSurel rogi@warga.example"
    got = {(k, text[a:b]) for k, a, b in model.find(text)}
    assert ("address", "Jl. Kenanga Raya No. 12A") in got and ("email", "rogi@warga.example") in got and not any("Gelatik" in v for _, v in got)
    copies = spark.createDataFrame([(i, "Surat Edaran berlaku.") for i in range(300)] + [(900 + i, f"surat edaran {i}") for i in range(2)], "doc_id bigint, text string")
    assert "edaran" in train(copies, "doc_id", "text").common  # copies count as one text

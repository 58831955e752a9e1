"""Column functions over legal metadata: numbers, labels, citations, dates, identifiers, file names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from statuta.schema import DOC_FORMS

# Months, type abbreviations (exact, then first contained in this order), short forms, file types.
MONTHS = ("januari", "februari", "maret", "april", "mei", "juni", "juli", "agustus", "september", "oktober", "november", "desember")
ABBREVIATIONS = (
    ("undang-undang", "UU"), ("undang undang", "UU"), ("uu", "UU"), ("peraturan pemerintah", "PP"), ("pp", "PP"), ("peraturan otoritas jasa keuangan", "POJK"),
    ("surat edaran otoritas jasa keuangan", "SEOJK"), ("surat edaran", "SE"), ("peraturan presiden", "PERPRES"), ("perpres", "PERPRES"), ("peraturan menteri", "PERMEN"),
    ("permen", "PERMEN"), ("keputusan presiden", "KEPPRES"), ("keppres", "KEPPRES"), ("keputusan menteri", "KEPMEN"), ("kepmen", "KEPMEN"), ("peraturan daerah", "PERDA"),
    ("perda", "PERDA"), ("peraturan pemerintah pengganti undang-undang", "PERPU"), ("perpu", "PERPU"), ("keputusan", "KEP"), ("peraturan", "PER"),
)
SHORT_FORMS = (
    ("undang-undang", "UU"), ("peraturan pemerintah", "PP"), ("peraturan presiden", "Perpres"), ("peraturan menteri", "Permen"),
    ("peraturan daerah", "Perda"), ("peraturan walikota", "Perwali"), ("peraturan bupati", "Perbup"), ("peraturan gubernur", "Pergub"),
)
TITLE_TYPES = (
    ("undang_undang", ("undang-undang", "uu")), ("peraturan_pemerintah", ("peraturan pemerintah", "pp")), ("peraturan_presiden", ("peraturan presiden", "perpres")),
    ("peraturan_menteri", ("peraturan menteri", "permen")), ("peraturan_daerah", ("peraturan daerah", "perda")),
)
EDGE_TYPES = (
    ("mencabut sebagian", "revokes_partially"), ("dicabut sebagian", "revoked_partially_by"), ("mengubah sebagian", "amends_partially"), ("diubah sebagian", "amended_partially_by"),
    ("dicabut dengan", "revoked_by"), ("diubah dengan", "amended_by"), ("mengatur lebih lanjut", "further_regulates"), ("diatur lebih lanjut", "further_regulated_by"),
    ("mencabut", "revokes"), ("mengubah", "amends"), ("merubah", "amends"), ("diubah", "amended_by"), ("dicabut", "revoked_by"), ("melaksanakan", "implements"),
    ("dilaksanakan", "implemented_by"), ("merujuk", "refers_to"), ("dirujuk", "referred_by"), ("membentuk", "established_by"), ("menetapkan", "establishes"), ("ditetapkan", "established_by"),
)


# Numbers of the regulation types in the portal's search.
TYPE_NUMBERS = {
    "uud": "7", "ketetapan_mpr": "39", "uu": "8", "uudarurat": "36", "perpu": "9", "pp": "10", "perpres": "11", "keppres": "12", "inpres": "13", "peraturan_mendagri": "40", "peraturan_menkeu": "42",
    "peraturan_menpolhukam": "43", "peraturan_menlu": "45", "peraturan_menhukham": "46", "peraturan_menhan": "47", "peraturan_menhub": "48", "pergub": "20", "perbup": "23", "peraturan_walikota": "30",
}


def type_number(kind: Column) -> Column:
    """The portal's number of a regulation type (any case, blanks or underscores); null for others."""
    key = F.regexp_replace(F.lower(F.trim(kind)), r"\s+", "_")
    return F.create_map(*[F.lit(x) for pair in TYPE_NUMBERS.items() for x in pair])[key]


def title_kind(title: Column) -> Column:
    """struct(kind, number, year) of a title by five kinds in order; the first that occurs anywhere wins."""
    kinds = ("UU|Undang-Undang", r"PP|Peraturan\s+Pemerintah", r"Permen|Peraturan\s+Menteri", r"Perpres|Peraturan\s+Presiden", r"Perda|Peraturan\s+Daerah")
    patterns = [rf"(?i)({k})\s*(?:No\.?|Nomor)\s*(\d+)\s*Tahun\s*(\d{{4}})" for k in kinds]
    return F.struct(*[F.coalesce(*[F.nullif(F.regexp_extract(title, p, i), F.lit("")) for p in patterns]).alias(n) for i, n in ((1, "kind"), (2, "number"), (3, "year"))])


def _first_in(text: Column, pairs, otherwise: Column) -> Column:
    """Value of the first pair whose phrase occurs in ``text``."""
    return reduce(lambda rest, p: F.when(F.contains(text, F.lit(p[0])), p[1]).otherwise(rest), reversed(list(pairs)), otherwise)


def roman(text: Column) -> Column:
    """Value of a Roman numeral in capitals; 0 for anything else."""
    values = F.transform(F.split(text, ""), lambda c: reduce(lambda rest, p: F.when(c == p[0], p[1]).otherwise(rest), [("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)], F.lit(0)))
    total = F.aggregate(F.reverse(values), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda a, v: F.struct((a["sum"] + F.when(v < a["last"], -v).otherwise(v)).alias("sum"), F.greatest(v, a["last"]).alias("last")), lambda a: a["sum"])
    return F.when(text.rlike("^[IVXLCDM]+$"), total).otherwise(0)


def ordinal(label: Column) -> Column:
    """(number, suffix) of a label: Roman, digits with letters, one letter; else (0, '')."""
    digits = F.regexp_extract(label, r"^(\d+)([A-Za-z]*)$", 1)
    number = (
        F.when(label.rlike("^[IVXLCDM]+$"), roman(label))
        .when(digits != "", F.nullif(digits, F.lit("")).cast("int"))
        .when(label.rlike("^[A-Za-z]$"), F.ascii(F.lower(label)) - 96)
        .otherwise(0)
    )
    return F.struct(F.coalesce(number, F.lit(0)).cast("int").alias("ordinal_int"), F.coalesce(F.regexp_extract(label, r"^(\d+)([A-Za-z]*)$", 2), F.lit("")).alias("ordinal_suffix"))


def sort_key(number: Column, suffix: Column) -> Column:
    return F.concat(F.lpad(number.cast("string"), 4, "0"), F.lit("|"), F.coalesce(suffix, F.lit("")))


def label_display(kind: Column, number: Column) -> Column:
    k = F.upper(kind)
    return (
        F.when(k == "PASAL", F.concat(F.lit("Pasal "), number))
        .when(k.isin("BUKU", "BAB", "BAGIAN", "PARAGRAF"), F.concat(k, F.lit(" "), number))
        .when(k == "AYAT", F.concat(F.lit("("), number, F.lit(")")))
        .when(k.isin("HURUF", "ANGKA"), F.concat(number, F.lit(".")))
        .otherwise(number)
    )


def citation(title: Column, path: Column) -> Column:
    """"Title, Pasal 3 ayat (2) huruf a": other levels than these are left out."""
    level = lambda p: F.lower(p["type"])
    digits = lambda p: F.regexp_replace(p["label"], "[^0-9]", "")
    parts = F.transform(
        F.filter(path, lambda p: level(p).isin("pasal", "ayat", "huruf", "angka")),
        lambda p: F.when(level(p) == "pasal", p["label"])
        .when(level(p) == "ayat", F.concat(F.lit("ayat ("), digits(p), F.lit(")")))
        .when(level(p) == "huruf", F.concat(F.lit("huruf "), F.regexp_replace(p["label"], "[^a-zA-Z]", "")))
        .otherwise(F.concat(F.lit("angka "), digits(p))),
    )
    return F.when(F.size(parts) > 0, F.concat(title, F.lit(", "), F.array_join(parts, " "))).otherwise(title)


def path_number(unit_id: Column, level: str) -> Column:
    """Number of the last ``level`` segment of a unit id; null where there is none."""
    last = F.get(F.reverse(F.filter(F.split(unit_id, "/"), lambda s: s.startswith(level + "-"))), F.lit(0))
    return F.nullif(F.regexp_replace(last, f"^{level}-", ""), F.lit(""))


def to_date(text: Column) -> Column:
    """Date of "14 Maret 1981", ISO or day/month/year; null for anything else."""
    t = F.lower(F.trim(text))
    month = reduce(lambda rest, m: F.when(F.regexp_extract(t, r"^\d{1,2} (\p{L}+) \d{4}$", 1) == m[1], m[0]).otherwise(rest), enumerate(MONTHS, 1), F.lit(None).cast("int"))
    named = F.concat_ws("-", F.regexp_extract(t, r"(\d{4})$", 1), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(t, r"^(\d{1,2})", 1), 2, "0"))
    slashed = F.regexp_replace(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")).when(month.isNotNull(), F.try_to_date(named, "yyyy-MM-dd")).when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(slashed, "yyyy-M-d"))


def known_form(form: Column) -> Column:
    up = F.upper(F.trim(form))
    return F.when(up.isin(list(DOC_FORMS)), up).otherwise("LAINNYA")


def known_status(status: Column) -> Column:
    return F.when(F.lower(F.trim(status)) == "tidak berlaku", "Tidak Berlaku").otherwise("Berlaku")


def type_abbreviation(kind: Column) -> Column:
    """Exact name, else the first contained one, else initials (10 at most); UNKNOWN for nothing."""
    t = F.lower(F.trim(kind))
    exact = reduce(lambda rest, p: F.when(t == p[0], p[1]).otherwise(rest), reversed(ABBREVIATIONS), F.lit(None).cast("string"))
    initials = F.substring(F.upper(F.array_join(F.transform(F.split(t, r"\s+"), lambda w: F.substring(w, 1, 1)), "")), 1, 10)
    return F.when(F.coalesce(t, F.lit("")) == "", "UNKNOWN").otherwise(F.coalesce(exact, _first_in(t, ABBREVIATIONS, initials)))


def doc_id(kind: Column, year: Column, number: Column) -> Column:
    return F.concat_ws("-", type_abbreviation(kind), F.coalesce(year, F.lit("UNKNOWN")), F.regexp_replace(F.coalesce(number, F.lit("UNKNOWN")), r"[^a-zA-Z0-9-]", ""))


def short_form(form: Column) -> Column:
    inside = F.nullif(F.regexp_extract(form, r"\(([^)]+)\)", 1), F.lit(""))
    return F.when(F.coalesce(form, F.lit("")) == "", "Unknown").otherwise(_first_in(F.lower(form), SHORT_FORMS, F.coalesce(inside, form)))


def file_type(title: Column, form: Column) -> Column:
    t, f = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(form, F.lit("")))
    by_form = _first_in(f, [(names[0], kind) for kind, names in TITLE_TYPES], F.lit("peraturan_perundang_undangan"))
    return _first_in(t, [(n, kind) for kind, names in TITLE_TYPES for n in names], by_form)


def file_part(text: Column) -> Column:
    """Lower-case letters, digits and single underscores; 'unknown' for nothing."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\w\s-]", ""), r"[-\s_]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(t, r"^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def edge_type(label: Column) -> Column:
    """Canonical edge type of a relationship label, most specific phrase first."""
    return _first_in(F.replace(F.lower(label), F.lit("_"), F.lit(" ")), EDGE_TYPES, F.lit(None).cast("string"))


def relation_key(label: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(label)), r"\s+", "_")


def title_parts(title: Column) -> Column:
    """(type, number, year) of a heading "... Nomor n Tahun y"."""
    p = r"(?i)^\s*(.*?)\s+(?:nomor|no\.?)\s*(\d+\w*)\s+tahun\s+(\d{4})"
    return F.struct(*[F.nullif(F.regexp_extract(title, p, i), F.lit("")).alias(n) for i, n in ((1, "kind"), (2, "number"), (3, "year"))])


def extraction_score(success: Column, confidence: Column, text: Column, method: Column) -> Column:
    """Confidence plus 10 over 5,000 or 5 over 1,000 characters and 5 or 3 by method, 100 at most; 0 for a failure."""
    size = F.length(text)
    bonus = F.when(size > 5000, 10).when(size > 1000, 5).otherwise(0) + F.when(method == "pymupdf", 5).when(method == "pdfplumber", 3).otherwise(0)
    failed = ~F.coalesce(success, F.lit(False)) | (F.coalesce(size, F.lit(0)) == 0)
    return F.when(failed, 0.0).otherwise(F.least(F.lit(100.0), F.coalesce(confidence, F.lit(0.0)) + bonus))

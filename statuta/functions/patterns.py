"""Table-valued pattern extraction: chapters, articles, verses, items and references in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (kind, pattern, group of the number, confidence).
CHAPTERS = (("roman", r"\bBAB\s+([IVX]+)\b", 0.95), ("numeric", r"\bBAB\s+(\d+)\b", 0.90))
TITLED_ARTICLES = (("titled", r"(?m)^[ \t]*Pasal[ \t]+(\d+[A-Z]?)[ \t]*\n[ \t]*(?=[A-Z][^\n.;]{2,80}\n)", 0.90),)
ARTICLES = (("article", r"\bPasal\s+(\d+[A-Z]?)\b", 0.80),)
VERSES = (("parenthesis", r"(?m)^\s*\((\d+)\)", 0.95), ("bracket", r"(?m)^\s*\[(\d+)\]", 0.85))
LETTERED = (("period", r"(?m)^\s*([a-z])\.\s", 0.90), ("parenthesis", r"(?m)^\s*([a-z])\)\s", 0.85))
NUMBERED = (("parenthesis", r"(?m)^\s*(\d+)\)\s", 0.90), ("period", r"(?m)^\s*(\d{1,2})\.\s", 0.85))
REFERENCES = (
    ("standard", r"\b((?:UU|PP|Perpres|Peraturan\s+Presiden|Peraturan\s+Pemerintah|Undang-Undang)\s+(?:No\.?|Nomor)?\s*\d+[A-Z]?\s+(?:Tahun|th\.?)\s+\d{4})", 0.95),
    ("ministerial", r"\b((?:Permen|Peraturan\s+Menteri)\s+(?:No\.?|Nomor)?\s*\d+[A-Z]?\s+(?:Tahun|th\.?)\s+\d{4})", 0.90),
    ("regional", r"\b((?:Perda|Peraturan\s+Daerah)\s+(?:No\.?|Nomor)?\s*\d+[A-Z]?\s+(?:Tahun|th\.?)\s+\d{4})", 0.85),
)


def _matches(text: Column, kind: str, pattern: str, confidence: float) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 1), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.lit(confidence).alias("confidence")))


def extract(text: Column, rules: tuple, distinct: bool = False) -> Column:
    """Matches of ``rules`` as an array of (kind, value, confidence), rule by rule, in order of place.

    ``distinct`` keeps the first match of each value.
    """
    found = F.concat(*[_matches(text, *rule) for rule in rules])
    if distinct:
        values = F.transform(found, lambda f: f["value"])
        found = F.filter(found, lambda f, i: F.array_position(values, f["value"]) == i + 1)
    return found


def located(text: Column, rules: tuple, distinct: bool = False) -> Column:
    """As ``extract``, with the place of each match (from 1), all rules together in order of place.

    The place of the n-th match of a rule is found by counting its matches before it; at one place the
    rule of higher confidence comes first.
    """

    def one(kind: str, pattern: str, confidence: float) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), 1)
        return F.transform(found, lambda v, i: F.struct(F.regexp_instr(_after(text, pattern, i), F.lit(pattern)).alias("rest"), v.alias("value"), i.alias("n"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence")))

    def placed(kind: str, pattern: str, confidence: float) -> Column:
        size = F.length(text)
        return F.transform(one(kind, pattern, confidence), lambda f: F.struct((size - F.length(_after(text, pattern, f["n"])) + f["rest"]).alias("place"), (-f["confidence"]).alias("order"), f["kind"].alias("kind"), f["value"].alias("value"), f["confidence"].alias("confidence")))

    found = F.transform(F.array_sort(F.concat(*[placed(*r) for r in rules])), lambda f: F.struct(f["place"].alias("place"), f["kind"].alias("kind"), f["value"].alias("value"), f["confidence"].alias("confidence")))
    if distinct:
        values = F.transform(found, lambda f: f["value"])
        found = F.filter(found, lambda f, i: F.array_position(values, f["value"]) == i + 1)
    return found


def _after(text: Column, pattern: str, n: Column) -> Column:
    """What stands behind the first ``n`` matches of a pattern."""
    parts = F.split(text, pattern, -1)
    return F.when(n == 0, text).otherwise(F.substring(text, F.length(text) - F.length(F.array_join(F.slice(parts, n + 1, F.size(parts)), "")) - _kept(text, pattern, parts, n) + 1, F.length(text)))


def _kept(text: Column, pattern: str, parts: Column, n: Column) -> Column:
    """Length of the matches behind the first ``n``: all of the text that is in no part."""
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    return F.aggregate(F.slice(matches, n + 1, F.greatest(F.size(matches) - n, F.lit(0))), F.lit(0), lambda total, m: total + F.length(m))


def article_slice(text: Column, number: Column) -> Column:
    """The part of a text from the heading "Pasal n" to the next article or chapter heading, or its end; null without it.

    ``number`` may differ from row to row: the text is cut at every heading and the piece is picked.
    """
    pieces = F.split(text, r"(?m)(?=^[ \t]*(?:Pasal[ \t]+\d+[A-Z]?[ \t]*$|BAB[ \t]+[IVXLC]+))")
    return F.get(F.filter(pieces, lambda p: F.regexp_extract(p, r"^[ \t]*Pasal[ \t]+(\d+[A-Z]?)[ \t]*(?:\n|$)", 1) == number), F.lit(0))


def article_hierarchy(text: Column, number: Column) -> Column:
    """struct(content, verses, letters, numbers, references) of one article of a text."""
    part = article_slice(text, number)
    return F.struct(part.alias("content"), extract(part, VERSES).alias("verses"), extract(part, LETTERED).alias("letters"), extract(part, NUMBERED).alias("numbers"), extract(part, REFERENCES).alias("references"))


def pattern_counts(text: Column) -> Column:
    """Matches of each group of patterns in a text."""
    groups = {"chapters": CHAPTERS, "articles": ARTICLES, "titled_articles": TITLED_ARTICLES, "verses": VERSES, "letters": LETTERED, "numbers": NUMBERED, "references": REFERENCES}
    return F.struct(*[sum((F.regexp_count(text, F.lit(r[1])) for r in rules), F.lit(0)).alias(name) for name, rules in groups.items()])


def is_definition(text: Column) -> Column:
    """Whether a text opens or heads a section of definitions."""
    heading = F.upper(text).rlike(r"\b(?:KETENTUAN\s+UMUM|DEFINISI|PENGERTIAN)\b")
    opening = F.lower(text).rlike(r"dalam\s+(?:undang-undang|peraturan)\s+ini\s+yang\s+dimaksud\s+dengan")
    return heading | opening


# Document types by their full and their short names.
TYPE_NAMES = {"UU": ("undang-undang", "uu"), "PP": ("peraturan pemerintah", "pp"), "PERPRES": ("peraturan presiden", "perpres"), "PERMEN": ("peraturan menteri", "permen"), "PERDA": ("peraturan daerah", "perda")}


def document_type(text: Column) -> Column:
    """Type that the first full heading with number and year names, else the first short one; null without any."""
    flat = F.regexp_replace(F.lower(text), r"\s+", " ")

    def first(names: list[str], tail: str) -> Column:
        return F.regexp_extract(flat, r"\b(" + "|".join(names) + r")" + tail, 1)

    full = first([n for n, _ in TYPE_NAMES.values()], r"(?: republik indonesia)? (?:nomor|no\.?) ?\d+[a-z]? ?tahun ?\d{4}")
    short = first([n for _, n in TYPE_NAMES.values()], r" ?(?:no\.?|nomor)? ?\d+[a-z]? ?(?:tahun|th\.?)? ?\d{4}")
    return F.coalesce(*[F.when(full == names[0], F.lit(kind)) for kind, names in TYPE_NAMES.items()], *[F.when(short == names[1], F.lit(kind)) for kind, names in TYPE_NAMES.items()])


def normalised_type(name: Column) -> Column:
    """Abbreviation of a document type's full or short name; other names in capitals."""
    low = F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")
    return F.coalesce(*[F.when(low.isin(*names), F.lit(kind)) for kind, names in TYPE_NAMES.items()], F.upper(F.trim(name)))


def structure_report(text: Column) -> Column:
    """Which levels a text has, its score (mean of four probes) and whether it counts as structured."""
    flags = {
        "has_chapters": F.size(extract(text, CHAPTERS)) > 0,
        "has_articles": F.size(extract(text, ARTICLES)) > 0,
        "has_verses": F.size(extract(text, VERSES)) > 0,
        "has_items": F.size(extract(text, LETTERED)) > 0,
    }
    score = sum((f.cast("int") for f in flags.values()), F.lit(0)) / 4
    return F.struct(*[f.alias(k) for k, f in flags.items()], score.alias("score"), (score > 0.5).alias("is_valid"))

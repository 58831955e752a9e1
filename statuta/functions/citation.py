"""Reading a freely typed reference to a regulation: form, number, year and title.

``read_reference`` is pure Python on one string; ``parse_references`` runs it over a column in Arrow
batches. The reader knows the written forms of this legal family and nothing about any table.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Written forms of each regulation type, letters only, lower case.
FORMS = {
    "UU": ["undangundang", "uu"],
    "PERPU": ["peraturanpemerintahpenggantiundangundang", "perpu", "perppu"],
    "PP": ["peraturanpemerintah", "perpemerintah", "pp"],
    "PERPRES": ["peraturanpresiden", "perpresiden", "perpres"],
    "PERMEN": ["peraturanmenteri", "permenteri", "permen"],
    "PERDA": ["peraturandaerah", "perdaerah", "perda"],
    "POJK": ["peraturanotoritasjasakeuangan", "peraturanojk", "pojk"],
    "SE": ["suratedaran", "srtedaran", "se"],
    "KEP": ["keputusan", "kep"],
}
# Texts that stand for "nothing entered".
EMPTY_TEXTS = {"", "na", "sda", "nihil", "tidakada", "lihatlampiran", "terlampir", "dokumenterlampir", "belumdiisi", "kosong", "none", "null", "idem"}
# Indonesian number words.
UNITS = {"nol": 0, "satu": 1, "dua": 2, "tiga": 3, "empat": 4, "lima": 5, "enam": 6, "tujuh": 7, "delapan": 8, "sembilan": 9, "sepuluh": 10, "sebelas": 11, "seratus": 100}

_ALIAS = {alias: form for form, names in FORMS.items() for alias in names}
_LEAD = re.compile(r"^(?:lihat(?:\s+juga)?|vide|bandingkan|bdk\.?)\s+", re.I)
_NUM_WORD = r"(?:" + "|".join(UNITS) + r"|puluh|belas|ratus)"
_NUMBER = re.compile(
    rf"\b(?:nomor|nomer|nomo|no|nmr)\b\s*[.:]?\s*(?P<n>{_NUM_WORD}(?:\s+{_NUM_WORD})*\b|[IVXLC]+\b(?![a-z])|[0-9lIOo]+\b)", re.I
)
_YEAR = re.compile(r"\b(?:tahun|thn|th)\b\s*[.:]?\s*(?P<y>[0-9lIOo]{4}|[0-9]{2})\b", re.I)
_SLASH = re.compile(r"(?<!\d)(?P<n>[0-9lIO]{1,4})\s*/\s*(?P<y>[0-9lIO]{4})(?!\d)")
_CODE = re.compile(r"^\s*(?P<f>[A-Za-z]+)-(?P<y>\d{4})-(?P<n>\d+)\s*$")
_ABOUT = re.compile(r"\b(?:tentang|ttg|perihal|mengenai)\b\s*[.:]?\s*", re.I)
_PAREN = re.compile(r"^(?P<title>.{12,}?)\s*\((?P<code>[^()]{3,80})\)\s*$")
_AMEND = re.compile(r"^\s*perubahan\s+(?:(?:ke\w+)\s+)?atas\s+", re.I)
_WORDS = re.compile(r"[^\W_]+(?:\.(?=\s|$))?|&|…")
# Words for "and so on" that end a text cut short.
_AND_SO_ON = re.compile(r"[\s,;(]+(?:dst|dsb|dll|etc|dan seterusnya)\b[.)]*$", re.I)
_GLUE = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Reference:
    """What a text names. ``names`` is False where it names no regulation at all."""

    names: bool = False
    form: str | None = None
    head: str | None = None
    number: str | None = None
    year: int | None = None
    title: list[str] = field(default_factory=list)
    truncated: bool = False
    glued: bool = False
    amends: bool = False

    @property
    def code(self) -> str | None:
        return f"{self.form}-{self.year}-{self.number}" if self.form and self.number and self.year else None


def damerau(a: str, b: str, limit: int = 99) -> int:
    """Optimal string alignment distance, given up (limit + 1) once it must exceed ``limit``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > limit:
            return limit + 1
        before = last
    return row[-1]


def letters(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalpha())


def form_of(head: str) -> str | None:
    """The type that a heading names, spelling slips included; None for an unknown heading."""
    return _form(letters(head))


@functools.lru_cache(65_536)
def _form(word: str) -> str | None:
    if word in _ALIAS:
        return _ALIAS[word]
    best, found = 3, None
    for alias, form in _ALIAS.items():
        if len(alias) < 8 or abs(len(alias) - len(word)) > 2:
            continue
        limit = min(best - 1, 2 if len(alias) >= 12 else 1)
        d = damerau(word, alias, limit)
        if d <= limit:
            best, found = d, form
    return found


def _roman(text: str) -> int:
    value = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}
    digits = [value[c] for c in text.upper()]
    return sum(-a if a < b else a for a, b in zip(digits, digits[1:] + [0], strict=True))


def number_of(text: str) -> str | None:
    """A number as typed (digits, misread digits, Roman, words) as plain digits."""
    text = text.strip()
    words = text.lower().split()
    if words and all(w in UNITS or w in ("puluh", "belas", "ratus") for w in words):
        total = last = 0
        for w in words:
            if w == "puluh":
                last *= 10
            elif w == "belas":
                last += 10
            elif w == "ratus":
                last *= 100
            else:
                total, last = total + last, UNITS[w]
        return str(total + last)
    if re.fullmatch(r"[IVXLC]+", text) and text not in ("I", "l"):
        return str(_roman(text))
    digits = text.translate(str.maketrans("lIOo", "1100"))
    return str(int(digits)) if digits.isdigit() else None


def _year_of(text: str) -> int | None:
    digits = text.translate(str.maketrans("lIOo", "1100"))
    if not digits.isdigit():
        return None
    y = int(digits)
    return y if y > 99 else (2000 + y if y <= 30 else 1900 + y)


def title_words(text: str) -> list[str]:
    """Lower-case words of a title; an abbreviation keeps its point, ``&`` reads as ``dan``.

    The citation inside "perubahan atas ..." becomes the words #form, #number, #year, so that its
    notation does not matter.
    """
    inner = _AMEND.match(text)
    if inner:
        ref = read_reference(text[inner.end() :])
        marks = [f"#{x}".lower() for x in (ref.form or letters(ref.head or ""), ref.number, ref.year) if x]
        return ["perubahan", "atas", *marks, *ref.title]
    return [w if w != "&" else "dan" for w in (m.lower() for m in _WORDS.findall(text)) if w != "…"]


def read_reference(text: str | None) -> Reference:
    """What ``text`` names; empty, null and placeholder texts name nothing."""
    ref = Reference()
    if text is None:
        return ref
    t = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text.replace("…", "…")).replace("...", "…")).strip()
    t = _LEAD.sub("", t)
    if re.sub(r"[^a-z]", "", t.lower()) in EMPTY_TEXTS and not any(c.isdigit() for c in t):
        return ref
    code = _CODE.match(t)
    if code and form_of(code["f"]):
        return Reference(True, form_of(code["f"]), code["f"], str(int(code["n"])), int(code["y"]))
    paren = _PAREN.match(t)
    if paren:
        inside = read_reference(paren["code"])
        if inside.form and inside.number:
            outer = read_reference(paren["title"])
            inside.title, inside.truncated, inside.glued, inside.amends = outer.title, outer.truncated, outer.glued, outer.amends
            return inside
    cut = _AND_SO_ON.sub("…", t)
    if cut.endswith("…"):
        ref.truncated = True
        t = cut.rstrip("… ")
    about = _ABOUT.search(t)
    lead, title = (t[: about.start()], t[about.end() :]) if about else (t, "")
    if _AMEND.match(t):
        lead, title = "", t
    first = re.search(r"\b(?:nomor|nomer|nomo|no|nmr|tahun|thn|th)\b|\d", lead, re.I)
    head = lead[: first.start()] if first else lead
    ref.form = form_of(head) if head.strip() else None
    if ref.form is None and not about and not _AMEND.match(t):
        # no heading: the longest opening run of words that is a heading, the rest a title
        words = list(re.finditer(r"\S+", t))
        for k in range(min(7, len(words)), 0, -1):
            got = form_of(t[: words[k - 1].end()])
            if got and first is not None and words[k - 1].end() <= first.start() + 1:
                ref.form, head = got, t[: words[k - 1].end()]
                break
    body = lead[len(head) :] if lead.startswith(head) else lead
    known = ref.form is not None
    number, year, slash = _NUMBER.search(body), _YEAR.search(body), _SLASH.search(body)
    end = 0
    if slash and not (number and year):
        ref.number, ref.year = number_of(slash["n"]), _year_of(slash["y"])
        end = slash.end()
    else:
        if number:
            ref.number = number_of(number["n"])
            end = number.end()
        if year:
            ref.year = _year_of(year["y"])
            end = max(end, year.end())
            if not number and known:
                bare = re.match(r"\s*([0-9lIO]{1,4})\s", body)
                if bare:
                    ref.number = number_of(bare[1])
        elif number is None and known:
            bare = re.match(r"\s*([0-9]{1,3})\b", body)
            if bare:
                ref.number, end = number_of(bare[1]), bare.end()
    if not title:
        if known or end:
            title = body[end:].strip(" ,.;:-") if (known or ref.number) else body
        else:
            title = t
        if not known and not ref.number and head.strip():
            title = (head + " " + body).strip()
    if not known and not about and not ref.number:
        tail = re.search(r"\s+(\d{4})$", title)
        if tail:
            ref.year, title = int(tail[1]), title[: tail.start()]
    ref.head = head.strip() or None
    ref.amends = bool(_AMEND.match(title))
    if title and " " not in title.strip() and len(title) > 20:
        ref.glued = True
    ref.title = title_words(title)
    ref.names = bool(known or ref.number or len(ref.title) >= 3 or ref.glued)
    return ref


REFERENCE_TYPE = "struct<names: boolean, form: string, number: string, year: int, code: string, title: array<string>, truncated: boolean, glued: boolean, amends: boolean, foreign_form: boolean>"


def _parse(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        r = read_reference(text)
        rows.append((r.names, r.form, r.number, r.year, r.code, r.title, r.truncated, r.glued, r.amends, bool(r.form is None and r.number is not None and r.head)))
    out = pd.DataFrame(rows, columns=["names", "form", "number", "year", "code", "title", "truncated", "glued", "amends", "foreign_form"])
    out["year"] = out["year"].astype("Int32")
    return out


def parse_references(text: Column) -> Column:
    """The reading of each text as a struct; null texts read as naming nothing."""
    return F.pandas_udf(_parse, REFERENCE_TYPE)(text)

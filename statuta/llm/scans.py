"""Repair of text that comes from scanned pages, in Spark SQL.

Three kinds of damage, found in this order:

* page furniture: page numbers and announcements of the next page's first words are known by their form;
  they show where the pages end. A running header or footer is a line whose normalised form (case, digits
  and misreadings folded), opening or shape stands beside such page ends far more often than lines of the
  body do, counted over the whole corpus: no publisher's header is written down here;
* words hyphenated across lines, the furniture between their halves left aside;
* misread characters and stray marks: every word of the corpus gets an anagram hash (sum of the fifth
  powers of its character codes), a misreading shifts the hash by a known difference, and so a join of
  rare words with frequent words on hash plus difference proposes corrections, which are then checked
  letter by letter and ranked.

Lines are handled inside their row by array functions; only words are shuffled, counted on the map side
first. All statistics are over all rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.session import checkpoint

# What a character (left) is misread as (right); letters of words in lower case.
MISREADINGS = [
    ("a", "o"), ("a", "@"), ("a", "4"), ("b", "6"), ("b", "8"), ("c", "e"), ("d", "cl"), ("d", "c1"), ("e", "c"), ("g", "q"), ("g", "9"),
    ("h", "li"), ("h", "1i"), ("i", "!"), ("i", "]"), ("i", "1"), ("i", "|"), ("i", "l"), ("j", ";"), ("k", "lc"), ("k", "1c"), ("l", "1"), ("l", "|"), ("l", "i"), ("m", "rn"),
    ("m", "ivi"), ("n", "ri"), ("n", "i\\i"), ("o", "0"), ("r", "k"), ("rn", "m"), ("s", "5"), ("t", "f"), ("t", "7"), ("u", "ii"), ("u", "ij"),
    ("w", "vv"), ("0", "o"), ("0", "O"), ("1", "l"), ("1", "i"), ("1", "I"), ("2", "z"), ("2", "Z"), ("5", "s"), ("5", "S"), ("6", "b"), ("8", "B"),
    ("", "'"), ("", "^"), ("", "~"), ("", ","), ("", "."), ("", "`"), ("", "*"), ("", "|"),
]
#: A variant is taken for a correction if it is on at least this many times as many lines of distinct texts ...
RATIO = 5
#: ... and on at least this many.
FREQUENT = 4
#: Most corrections that are broadcast; more of them are joined by shuffle.
BROADCAST_WORDS = 500_000

HYPHENS = "-‐‑\u00ad¬"
SPLIT = "\u0001"
_D = "[0-9lIOoSZB]"
_PAGE = (
    rf"(?:[-–—]\s*{_D}{{1,4}}\s*[-–—]|\[\s*{_D}{{1,4}}\s*\]|{_D}{{1,4}}\s*\||{_D}{{1,4}}\s*/\s*{_D}{{1,4}}|(?:\.\s){{2,3}}\.?\s*{_D}{{1,4}}"
    rf"|[Hh]a.(?:aman)?\s*[:.]?\s*{_D}{{1,4}}(?:\s+dari\s+{_D}{{1,4}})?|hlm.?\s*{_D}{{1,4}}|[0-9]{{1,4}}|[ivxlc]{{1,8}})"
)
_PAGE_LINE = re.compile(f"^{_PAGE}$")
_PAGE_END = re.compile(rf"\s{{2,}}{_PAGE}$")
_CATCH_LINE = re.compile(r"^(?:\S+\s){0,4}\S*\s?(?:\.\s?\.\s?\.|…)$")
_CHAPTER = re.compile(r"^(?:B.B\s+[IVXL1l]+|BUKU\s+\w+|BAGIAN\s+\w+)\W*$")
_NOT_CAPITAL, _NOT_SMALL = re.compile("[^A-Z]+"), re.compile("[^a-km-z]+")
#: Share of its occurrences that a form must have beside page ends, and their least number, by level of evidence:
#: whole line, first two words, first word and number of words, shape; a whole line of prose.
EDGE_SHARE, SUPPORT = (0.3, 0.3, 0.3, 0.3, 0.6), (2, 3, 3, 8, 8)
#: Most forms that are collected and broadcast (9 bytes each).
BROADCAST_FORMS = 4_000_000
_BROKEN = re.compile(rf"[^\W\d_][{HYPHENS}]\s*$")
_START = re.compile(r"^\s*([^\W\d_]\S*)")


_FOLD = str.maketrans("0@4o1l|!]ji;c5f7q968bkr", "aaaaiiiiiiiiesttggbbbrr")
_PROSE = re.compile(r"(?:^|\s)[a-z](?=[a-z\s]|$)(?!\S*[.:/]\w)")  # a word in lower case that is no host
_PROSE_FOLD = str.maketrans("123456789", "000000000")
_TOKEN = re.compile(r"[\w@|!\]]+")
_GLUED = (("rn", "m"), ("vv", "w"), ("cl", "d"))


def page_end(line: str) -> bool:
    """Whether a stripped line is a page number or announces the next page, by its form."""
    if len(line) >= 60:
        return False
    return bool(_PAGE_LINE.match(line)) or (line[-1] in ".…" and bool(_CATCH_LINE.match(line)))


def forms_of(line: str) -> tuple[str, ...] | None:
    """What furniture may have in common, from the most to the least specific; None for a line that can be none.

    The whole line, its first two words, its first word (both with the number of words), its shape; digits
    count as #, letters that are misread for each other are one. Each form determines the next. Lower-case
    prose has only its whole line.
    """
    head = _PAGE_END.sub("", line) if "  " in line else line
    if _PROSE.search(head):
        return ("4" + head.lower().translate(_PROSE_FOLD),)
    tokens = []
    for t in _TOKEN.findall(head):
        if sum(c.isdigit() for c in t) * 2 >= len(t):
            tokens.append("#")
            continue
        t = t.lower()
        for many, one in _GLUED:
            t = t.replace(many, one)
        tokens.append(t.translate(_FOLD))
    if not tokens or (len(tokens) < 2 and len(head) < 5):
        return None
    if len(_NOT_CAPITAL.sub("", head)) >= 5 and len(_NOT_SMALL.sub("", head)) <= 1:
        shape = "C"
    elif " " not in head and any(c in ".:/" for c in head[1:-1]):
        shape = "H"
    elif any(w[0].isalpha() for w in head.split()) and head[-1] not in ".;:,":
        shape = "T#" if "#" in tokens else "T"
    else:
        return ("4" + head.lower().translate(_PROSE_FOLD),)
    n = len(tokens)
    return (f"0{shape} {' '.join(tokens)}", f"1{shape}{n} {' '.join(tokens[:2])}", f"2{shape}{n} {tokens[0]}", f"3{shape}" if shape in "CH" else f"3{shape}{n}")


def _hash(form: str) -> int:
    return xxhash.xxh64_intdigest(form) - (1 << 63)


def edge_counts(texts) -> dict[int, list[int]]:
    """Per hashed form: its level, occurrences beside a page end, all occurrences, and its less specific forms, in some texts."""
    found: dict[int, list[int]] = {}
    for text in texts:
        lines = [x for x in (line.strip() for line in text.split("\n")) if x]
        ends = [page_end(x) for x in lines]
        if not any(ends):
            continue
        for i, line in enumerate(lines):
            forms = None if ends[i] else forms_of(line)
            if forms is None or own_heading(lines, i):
                continue
            beside = (i > 0 and ends[i - 1]) or (i + 1 < len(lines) and ends[i + 1]) or bool(_PAGE_END.search(line))
            hashes = [_hash(f) for f in forms]
            for level, h in enumerate(hashes):
                entry = found.get(h)
                if entry is None:
                    entry = found[h] = [int(forms[level][0]), 0, 0, *([0] * (level + 1) + hashes[level + 1 :])[-3:]] if len(hashes) > 1 else [4, 0, 0, 0, 0, 0]
                entry[1] += beside
                entry[2] += 1
    return found


def own_heading(lines: list[str], i: int) -> bool:
    """Whether a line belongs to the document: to its opening, or in capitals as the title under a chapter heading."""
    if len(_NOT_SMALL.sub("", lines[i])) > 1:
        return i <= 2 and "#" not in (forms_of(lines[i]) or ("",))[0]
    return bool(_CHAPTER.match(lines[i])) or (i > 0 and bool(_CHAPTER.match(lines[i - 1]))) or (i <= 2 and len(_NOT_CAPITAL.sub("", lines[0])) > 0.6 * len(lines[0]))


class Furniture:
    """The forms that counting has judged: furniture or body; a line goes by the most specific form that is judged."""

    def __init__(self, forms: dict[int, bool] | tuple[np.ndarray, np.ndarray]) -> None:
        if isinstance(forms, dict):
            keys = np.array(sorted(forms), dtype=np.int64)
            forms = keys, np.array([forms[k] for k in keys.tolist()], dtype=bool)
        self.keys, self.verdicts = forms
        # a dict is quicker than the arrays, but several times their size
        self.table = dict(zip(self.keys.tolist(), self.verdicts.tolist(), strict=True)) if len(self.keys) <= 500_000 else None
        self.known: dict[str, tuple[bool, bool]] = {}

    def judged(self, form: str) -> bool | None:
        h = _hash(form)
        if self.table is not None:
            return self.table.get(h)
        at = int(np.searchsorted(self.keys, h))
        return bool(self.verdicts[at]) if at < len(self.keys) and self.keys[at] == h else None

    def is_margin(self, lines: list[str], i: int) -> bool:
        """Whether line ``i`` of the non-blank, stripped ``lines`` of a text is page furniture."""
        line = lines[i]
        if page_end(line):
            return True
        got = self.known.get(line)
        if got is None:
            got = next(((v, f[0] == "3") for f in forms_of(line) or () if (v := self.judged(f)) is not None), (False, False))
            if len(self.known) < 200_000:
                self.known[line] = got
        verdict, by_shape = got
        return verdict and not (by_shape and own_heading(lines, i))


NO_FURNITURE = Furniture({})


def read_lines(text: str, furniture: Furniture = NO_FURNITURE) -> list[tuple]:
    """(line_no, margin, hyphen, next_no, joined) of every line that is not blank.

    ``hyphen``: a body line that ends inside a word; its ``joined`` has the second half, taken from body
    line ``next_no``, after the mark SPLIT, and that line's ``joined`` lacks it.
    """
    lines = [(i, line) for i, line in enumerate(text.split("\n")) if line.strip()]
    bare = [line.strip() for _, line in lines]
    out: list[list] = []
    open_line: list | None = None
    for at, (i, line) in enumerate(lines):
        if furniture.is_margin(bare, at):
            out.append([i + 1, True, False, None, None])
            continue
        joined = line
        if open_line is not None:
            start = _START.match(line)
            if start:
                open_line[2], open_line[3] = True, i + 1
                open_line[4] = open_line[4].rstrip() + SPLIT + start[1]
                joined = line[start.end() :]
        entry = [i + 1, False, False, None, joined]
        out.append(entry)
        open_line = entry if _BROKEN.search(line) else None
    return [tuple(e) for e in out]


_COUNTED = ["h", "level", "n_edge", "n", "f1", "f2", "f3"]


def furniture_of(columns: list[tuple[DataFrame, str, str, str]]) -> Furniture:
    """The judged forms of several columns' texts together; counts are over all lines of all texts.

    A form is judged at SUPPORT occurrences beside page ends or ten times as many in all. Shapes and first
    words, which grow with the vocabulary only, are all collected; of whole lines and first two words only
    those whose verdict the less specific forms would not give: a title that runs over the pages of its one
    document is furniture by its shape, so there are not as many forms as documents.
    """

    def run(batches):
        for batch in batches:
            found = edge_counts(batch["text"])
            yield pd.DataFrame([(h, *n) for h, n in found.items()], columns=_COUNTED)

    counted = None
    for df, _, text, _ in columns:
        one = df.select(F.col(text).alias("text")).where(F.contains("text", F.lit("\n"))).mapInPandas(run, "h bigint, level int, n_edge bigint, n bigint, f1 bigint, f2 bigint, f3 bigint")
        counted = one if counted is None else counted.unionByName(one)
    total = counted.groupBy("h", "level").agg(F.sum("n_edge").alias("n_edge"), F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("f1", "f2", "f3")])
    support, share = (F.element_at(F.array(*[F.lit(x) for x in table]), F.col("level") + 1) for table in (SUPPORT, EDGE_SHARE))
    furniture = F.col("n_edge") >= share * F.col("n")
    judged = checkpoint(total.where((F.col("n_edge") >= support) | (F.col("n") >= 10 * support)).select("h", "level", furniture.alias("furniture"), "f1", "f2", "f3"))
    rest = judged
    for i in (1, 2, 3):
        rest = rest.join(judged.where(F.col("level") == i).select(F.col("h").alias(f"f{i}"), F.col("furniture").alias(f"v{i}")), f"f{i}", "left")
    otherwise = F.coalesce("v1", "v2", "v3", F.lit(False))
    rows = rest.where(F.col("level").isin(2, 3) | (F.col("furniture") != otherwise)).select("h", "furniture").limit(BROADCAST_FORMS + 1).toPandas()
    if len(rows) > BROADCAST_FORMS:
        raise ValueError(f"more than {BROADCAST_FORMS} forms of lines are exceptions to their shape; count them with higher SUPPORT")
    rows = rows.sort_values("h")
    return Furniture((rows["h"].to_numpy(np.int64), rows["furniture"].to_numpy(bool)))


def text_lines(df: DataFrame, key: str, text: str, table_name: str, furniture: Furniture = NO_FURNITURE) -> DataFrame:
    """All lines that are not blank: table_name, row_key, line_no, margin, hyphen, next_no, joined, text_hash.

    Null and empty texts have no lines. A text of one line has no page edge and no line break, so it
    never leaves the JVM.
    """
    rows = df.select(F.lit(table_name).alias("table_name"), F.col(key).cast("bigint").alias("row_key"), F.col(text).alias("text")).where(F.trim("text") != "").withColumn("text_hash", F.xxhash64("text"))
    one = rows.where(~F.contains("text", F.lit("\n"))).selectExpr("table_name", "row_key", "1 as line_no", "false as margin", "false as hyphen", "cast(null as int) as next_no", "text as joined", "text_hash")

    shared = df.sparkSession.sparkContext.broadcast((furniture.keys, furniture.verdicts))

    def run(batches):
        known = Furniture(shared.value)
        for batch in batches:
            out = [(t, k, *entry, h) for t, k, v, h in zip(batch["table_name"], batch["row_key"], batch["text"], batch["text_hash"], strict=True) for entry in read_lines(v, known)]
            frame = pd.DataFrame(out, columns=["table_name", "row_key", "line_no", "margin", "hyphen", "next_no", "joined", "text_hash"])
            frame["next_no"] = frame["next_no"].astype("Int32")
            yield frame

    schema = "table_name string, row_key bigint, line_no int, margin boolean, hyphen boolean, next_no int, joined string, text_hash bigint"
    many = rows.where(F.contains("text", F.lit("\n"))).mapInPandas(run, schema)
    return one.unionByName(many)


#: The outer punctuation of a sentence.
_OUTER = r"^\[(?=[^\]]*$)|^[(\"“]+|(?<![).,;:\"”?])[).,;:\"”?]+$"


def _words(joined: Column) -> Column:
    return F.split(joined, r"[ \t\r/–—]+")


def _bare(word: Column) -> Column:
    """A word without outer punctuation, in lower case unless it is a short code or number."""
    bare = F.regexp_replace(F.regexp_replace(word, f"[{HYPHENS}]?{SPLIT}", ""), _OUTER, "")
    return F.when(bare.rlike("[0-9]") & ~bare.rlike(r"\p{L}{2}") & (F.length(bare) <= 6), bare).otherwise(F.lower(bare))


def typed_forms(lines: DataFrame) -> DataFrame:
    """(typed, word, n, n_lines): every distinct word as typed in the body lines, its bare form, its number,
    and the number of lines that have it in distinct texts, where all copies of a text count as one.

    Kept in the shared folder: a filter or pattern on words must not be pushed below this count, where
    it would run for every occurrence.
    """
    distinct = lines.where(~F.col("margin")).groupBy("text_hash", "line_no", "joined").agg(F.count("*").alias("copies"))
    words = _words(F.col("joined"))
    all_of = F.transform(words, lambda w: F.struct(w.alias("typed"), F.col("copies").alias("n"), F.lit(0).cast("bigint").alias("n_lines")))
    once = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("typed"), F.lit(0).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("n_lines")))
    counted = distinct.select(F.inline(F.concat(all_of, once))).groupBy("typed").agg(F.sum("n").alias("n"), F.sum("n_lines").alias("n_lines"))
    return checkpoint(counted).select("typed", _bare(F.col("typed")).alias("word"), "n", "n_lines")


def word_counts(forms: DataFrame) -> DataFrame:
    """(word, n, n_lines) over all rows; words of one letter are left out."""
    return checkpoint(forms.where("length(word) > 1").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_lines").alias("n_lines")))


def odd_forms(forms: DataFrame) -> DataFrame:
    """(typed, word, correction) of every form that was misread; correction is null where none is known."""
    return checkpoint(forms.select("typed", "word").join(odd_words(word_counts(forms)), "word"))


def broken_compounds(forms: DataFrame) -> DataFrame:
    """(typed, keeps) of every word broken at a hyphen that the corpus has whole: whether the hyphen is its own.

    It is if the form with the hyphen is on more lines of distinct texts than the joined form; only words
    that are not broken themselves are evidence.
    """
    plain = F.regexp_replace("word", f"[{HYPHENS}]", "-")
    whole = forms.where(~F.contains("typed", F.lit(SPLIT))).groupBy(plain.alias("form")).agg(F.sum("n_lines").alias("n_form"))
    broken = forms.where(F.contains("typed", F.lit(SPLIT)))
    hyphened = _bare(F.regexp_replace("typed", f"[{HYPHENS}]?{SPLIT}", "-"))
    both = broken.select("typed", F.explode(F.array(F.struct(F.lit(True).alias("own"), F.regexp_replace(hyphened, f"[{HYPHENS}]", "-").alias("form")), F.struct(F.lit(False).alias("own"), plain.alias("form")))).alias("f"))
    counted = both.select("typed", "f.own", "f.form").join(whole, "form").groupBy("typed").agg(F.sum(F.when(F.col("own"), F.col("n_form")).otherwise(-F.col("n_form"))).alias("more"))
    return checkpoint(counted.select("typed", (F.col("more") > 0).alias("keeps")))


def anagram_hash(word: Column) -> Column:
    """Sum of the fifth powers of the character codes: equal for anagrams, shifted by misreadings.

    Codes count modulo 1,024 and the sum modulo 2^60, so that no letter and no length overflows it.
    """

    def power(c: Column) -> Column:
        v = F.pmod(F.ascii(c).cast("bigint"), F.lit(1024))
        return v * v * v * v * v

    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda total, c: F.pmod(total + power(c), F.lit(_MODULUS)))


_MODULUS = 1 << 60


def _power_sum(text: str) -> int:
    return sum((ord(c) % 1024) ** 5 for c in text)


def _rules() -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(seen).alias("seen"),
                F.lit(_power_sum(true) - _power_sum(seen)).cast("bigint").alias("delta"),
                F.lit(max(len(true), len(seen))).alias("moved"),
                F.lit(1.1 if seen.isalpha() else 1.0).alias("cost"),
            )
            for true, seen in MISREADINGS
        ]
    )


def _shifts(word: Column) -> Column:
    """What one or two misreadings present in ``word`` may have done to its hash."""
    present = F.filter(_rules(), lambda r: F.contains(word, r["seen"]))

    def with_second(rules: Column) -> Column:
        one = F.transform(rules, lambda r: F.struct(r["delta"].alias("delta"), r["moved"].alias("moved"), r["cost"].alias("cost")))
        two = F.transform(
            rules,
            lambda a, i: F.transform(
                F.slice(rules, i + 1, F.size(rules)),
                lambda b: F.struct((a["delta"] + b["delta"]).alias("delta"), (a["moved"] + b["moved"]).alias("moved"), (a["cost"] + b["cost"]).alias("cost")),
            ),
        )
        return F.concat(one, F.flatten(two))

    return F.get(F.transform(F.array(present), with_second), F.lit(0))


#: A letter word with digits or marks inside, which no code, clause number or amount is.
_STRANGE = r"\p{L}[0-9@!\]^~'`*|\;.,]+\p{L}|^[0-9@!\]|]+\p{L}{2}|\p{L}{2}[0-9@!|\]]+$|\p{L}{2}[@!\]^~'`|][0-9]*$"
_CODE = r"^(?:[a-z]{1,3}[0-9]{1,3}|[0-9]+[A-HJ-NP-RT-Y]|rp[0-9.,]+|(?:[a-z]\.)+[a-z]?|[a-z]+\.[a-z]+\.[a-z.]+)$"


def corrections(counts: DataFrame) -> DataFrame:
    """(word, correction, cost) of rare words that are a misreading of frequent ones.

    ``counts`` has word, n and n_lines (taken as n if absent). Ties fall to the cheaper, then the more
    frequent, then the smaller word. Lines of distinct texts decide, at one ratio whatever their number; two
    words that both are on fewer than FREQUENT of them are judged by all their occurrences instead.
    """
    word, n = F.col("word"), F.col("n")
    strange = word.rlike(_STRANGE)
    n_lines = F.col("n_lines") if "n_lines" in counts.columns else n
    hashed = counts.select("word", "n", n_lines.alias("n_lines"), anagram_hash(word).alias("h"))
    frequent = hashed.where((n >= FREQUENT) & ~strange).select(word.alias("correction"), n.alias("n_frequent"), F.col("n_lines").alias("lines_frequent"), "h")
    shifted = hashed.where(~word.rlike(_CODE)).select("word", "n", "n_lines", "h", F.explode(_shifts(word)).alias("s")).select("word", "n", "n_lines", F.pmod(F.col("h") + F.col("s.delta"), F.lit(_MODULUS)).alias("h"), "s.moved", "s.cost")
    told = F.greatest("lines_frequent", "n_lines") >= FREQUENT
    near = shifted.join(frequent, "h").where(
        (word != F.col("correction"))
        & (strange | F.when(told, F.col("lines_frequent") >= RATIO * F.col("n_lines")).otherwise(F.col("n_frequent") >= RATIO * n))
        & (F.levenshtein("word", "correction") <= F.col("moved"))
    )
    order = F.struct(F.col("cost"), -F.col("lines_frequent"), -F.col("n_frequent"), F.col("correction"))
    best = near.groupBy("word").agg(F.min_by(F.struct("correction", "cost"), order).alias("b"))
    return best.select("word", "b.correction", "b.cost")


def odd_words(counts: DataFrame) -> DataFrame:
    """(word, correction) of all words that were misread; correction is null where none is known."""
    word = F.col("word")
    alone = counts.where(word.rlike(_STRANGE) & ~word.rlike(_CODE)).select("word")
    return alone.join(corrections(counts), "word", "full_outer").select("word", "correction")


_MISREAD_NUMBER = (
    r"(?:^\s*|ayat )\([lIOZSBsbzo]{1,2}\)|\b(?:Pasal|Nomor|Tahun|lambat|waktu|anggaran|sedikit) [lIOZSBszo]{1,2}\b"
    r"|\b(?:Nomor|NOMOR|Tahun|TAHUN|lambat|waktu|anggaran) (?=\S*[0-9])[0-9]*B[0-9]*\b|ayat \([0-9]*B[0-9]*\)"
    r"|^\s*B.B [IVXL]*[l1|][IVXLl1|]*\s*$|^\s*(?:BA[86]|8AB) "
)


def _occurrences(lines: DataFrame, odd: DataFrame) -> DataFrame:
    """Every occurrence of an odd form in the body lines, by broadcast only below a counted size."""
    small = odd.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS
    typed = lines.where(~F.col("margin")).select("table_name", "row_key", "line_no", "next_no", F.explode(_words(F.col("joined"))).alias("typed"))
    return typed.join(F.broadcast(odd) if small else odd, "typed")


def line_defects(lines: DataFrame, odd: DataFrame) -> DataFrame:
    """(table_name, row_key, line_no, defect): one row per noisy line and defect."""
    keys = ["table_name", "row_key"]
    plain = lines.where(F.col("margin") | F.col("hyphen") | F.col("joined").rlike(_MISREAD_NUMBER)).select(
        *keys,
        "line_no",
        F.explode(
            F.filter(
                F.array(F.when(F.col("margin"), F.lit("margin")), F.when(F.col("hyphen"), F.lit("hyphen")), F.when(~F.col("margin") & F.col("joined").rlike(_MISREAD_NUMBER), F.lit("glyph"))),
                lambda x: x.isNotNull(),
            )
        ).alias("defect"),
    )
    hit = _occurrences(lines, odd)
    # a misread word split over two lines: which half differs from the correction
    split = F.contains("typed", F.lit(SPLIT))
    first = F.lower(F.regexp_replace(F.regexp_extract("typed", f"^([^{SPLIT}]*){SPLIT}", 1), f"[{HYPHENS}]$", ""))
    second = F.lower(F.regexp_replace(F.regexp_extract("typed", f"{SPLIT}(.*)$", 1), _OUTER, ""))
    marks = r"[0-9@!\]^~'`*|;.,]"
    first_bad = F.coalesce(~F.col("correction").startswith(first), first.rlike(marks))
    second_bad = F.coalesce(~F.col("correction").endswith(second), second.rlike(marks))
    places = F.filter(F.array(F.when(~split | first_bad | ~second_bad, F.col("line_no")), F.when(split & second_bad, F.col("next_no"))), lambda x: x.isNotNull())
    glyph = hit.select(*keys, F.explode(places).alias("line_no"), F.lit("glyph").alias("defect"))
    return plain.unionByName(glyph).distinct()


def scan_defects(columns: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Noisy lines of several columns, each (table, key, text column, table_name), with one vocabulary.

    Columns: table_name, row_key, line_no, defect (margin, hyphen, glyph). Null and empty texts have no
    lines; repeated rows are judged alike; a text of any length is read whole; line feeds alone separate
    lines. A vocabulary without frequent words proposes no correction, so that only words with marks or
    digits inside are called misread.
    """
    lines = all_lines(columns, furniture_of(columns))
    return line_defects(lines, odd_forms(typed_forms(lines)))


def all_lines(columns: list[tuple[DataFrame, str, str, str]], furniture: Furniture) -> DataFrame:
    """The lines of several columns, each (table, key, text column, table_name)."""
    out = None
    for df, key, text, name in columns:
        one = text_lines(df, key, text, name, furniture)
        out = one if out is None else out.unionByName(one)
    return out


# Compounds that keep their hyphen where the corpus has neither form whole (besides doubled words).
_COMPOUND = re.compile(rf"\b(\w{{3,}}|perundang|kehati|sebaik)-{SPLIT}(?i:(\1|undangan|hatian|baiknya))")
_BROKEN_WORD = re.compile(rf"[^ \t\r/–—]*{SPLIT}[^ \t\r/–—]*")
_OPENS = re.compile(r"^\s*(?:BAB\b|Pasal\b|\(\S{1,3}\)|[a-z]\.\s|\d+\.\s)")


def paragraphs(text: str, fixes: dict[str, str], hyphens: dict[str, bool] | None = None, furniture: Furniture = NO_FURNITURE) -> str:
    """The text without furniture, its words whole and corrected, one paragraph to a line.

    ``hyphens`` says of broken words whether the hyphen is their own; of others a fixed pattern does.
    """
    out: list[str] = []
    kept = None
    for line_no, margin, _, _, joined in read_lines(text, furniture):
        if margin or not joined.strip():
            continue
        whole = _BROKEN_WORD.sub(lambda m: _mended(m[0], hyphens or {}), joined)
        words = [_fixed(w, fixes) for w in whole.split()]
        line = " ".join(words)
        if kept is None or _OPENS.match(line) or (kept.endswith((".", ";", ":")) and line[:1].isupper()) or _OPENS.match(kept) and len(kept) < 16:
            out.append(line)
        else:
            out[-1] += " " + line
        kept = line
    return "\n".join(out)


def _mended(typed: str, hyphens: dict[str, bool]) -> str:
    keeps = hyphens.get(typed)
    if keeps is None:
        typed = _COMPOUND.sub(r"\1-\2", typed)
    return re.sub(f"[{HYPHENS}]{SPLIT}", "-" if keeps else "", typed)


def _fixed(typed: str, fixes: dict[str, str]) -> str:
    bare = re.sub(_OUTER, "", typed)
    right = fixes.get(bare.lower()) or fixes.get(bare)
    if not right:
        return typed
    if bare.isupper() or sum(c.isupper() for c in bare) > 2:
        right = right.upper()
    elif bare[:1].isupper():
        right = right[:1].upper() + right[1:]
    return typed.replace(bare, right, 1)


def repaired(df: DataFrame, key: str, text: str, table_name: str, odd: DataFrame, compounds: DataFrame | None = None, furniture: Furniture = NO_FURNITURE) -> DataFrame:
    """(table_name, row_key, text): each text repaired into continuous readable paragraphs.

    A compound broken at its own hyphen keeps it where ``compounds`` (see broken_compounds) says so; a
    word of which the corpus has neither form whole is joined, unless it is doubled or in a fixed list.
    Null texts stay null, empty ones empty.
    """
    marks = odd.where("correction is not null").selectExpr("typed", "word", "correction", "cast(null as boolean) as keeps")
    if compounds is not None:
        marks = marks.unionByName(compounds.selectExpr("typed", "cast(null as string) as word", "cast(null as string) as correction", "keeps"))
    found = _occurrences(text_lines(df, key, text, table_name, furniture), marks)
    fixes = found.groupBy("row_key").agg(
        F.map_from_entries(F.collect_set(F.when(F.col("word").isNotNull(), F.struct("word", "correction")))).alias("fixes"),
        F.map_from_entries(F.collect_set(F.when(F.col("keeps").isNotNull(), F.struct("typed", "keeps")))).alias("hyphens"),
    )
    rows = df.select(F.col(key).cast("bigint").alias("row_key"), F.col(text).alias("text")).join(fixes, "row_key", "left")

    shared = df.sparkSession.sparkContext.broadcast((furniture.keys, furniture.verdicts))

    def run(batches):
        known = Furniture(shared.value)
        for batch in batches:
            texts = [
                paragraphs(t, dict(f) if f is not None else {}, dict(h) if h is not None else {}, known) if t is not None else None
                for t, f, h in zip(batch["text"], batch["fixes"], batch["hyphens"], strict=True)
            ]
            yield pd.DataFrame({"table_name": table_name, "row_key": batch["row_key"], "text": texts})

    return rows.mapInPandas(run, "table_name string, row_key bigint, text string")

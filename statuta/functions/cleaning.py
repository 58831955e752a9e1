"""Cleaning of legal text as named phases of ordered rules, folded into one column expression.

A rule is (name, pattern, replacement). Every phase is a function of a column and can be used alone;
``clean`` runs them in a fixed order. Only the Unicode normal form needs Python, once, in Arrow batches.
Rules that the survey marks as damaging legitimate text (letters after article numbers, two-digit verses,
decimals, addresses, plain words with doubled letters, lines of one word) are narrowed to what is an error.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Literal repairs of wrongly decoded and typographic characters.
ENCODING = (
    ("â€œ", '"'), ("â€˜", "'"), ("â€™", "'"), ("â€¢", "•"), ("â€¦", "..."), ("â€¯", " "), ("Â ", " "), ("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("—", "--"), (" ", " "),
    ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"),
)
LINE_ENDS = (("crlf", r"\r\n?", "\n"),)
LEGAL = (
    ("article_word", r"(?i)\b(?:pasa1|pasai|pa5al|passal)\b(?=\s*\d)", "Pasal"),
    ("article_l", r"\b(Pasal\s+\d*)[lI](?=\d*\b)", "$11"),
    ("article_o", r"\b(Pasal\s+\d+)[oO](?=\d*\b)", "$10"),
    ("verse_cut", r"\((\d)[lI]\s", "($1) "),
    ("verse_spaces", r"\(\s*(\d+)\s*\)", "($1)"),
    ("chapter_glued", r"\bBAB(?=[IVX]+\b)", "BAB "),
    ("article_split", r"\bPasal\s*\n\s*(\d+[A-Z]?)", "Pasal $1"),
    ("verse_own_line", r"(Pasal\s+\d+[A-Za-z]?)[ \t]+\((\d+)\)", "$1\n($2)"),
    ("chapter_own_line", r"(?<=[.;])[ \t]+(BAB\s+[IVXL]+\b)", "\n$1"),
)
# Words as scanners misread them, with the right word.
MISREAD = (
    ("Undang", r"[UL]n[dc]l?an[ge]|Undarg|Undalg|Undarrg"), ("Peraturan", r"Peratutan|Peraluran|Peraturarr?|Pcraturan"), ("Pemerintah", r"Pemerin[fl]ah|Pemerintalr|Pcmerintah"), ("Presiden", r"Presldcn|Presiclen|Fresiden|Ptesiden"),
    ("Menteri", r"Menleri|Mentcri|Mentert"), ("Republik", r"Republlk|Republil<|Repubiik"), ("Indonesia", r"lndonesia|1ndonesia|Indonesla"), ("Ketentuan", r"Ketenluan|Ketertuan|Kctentuan"), ("tentang", r"tenlang|tentarg|tcntang"),
    ("dengan", r"dengaa|derrgan|dcngan"), ("adalah", r"ada1ah|adaiah|adalalr"), ("sebagaimana", r"sebagairnana|sebagaimara|scbagaimana"), ("dimaksud", r"dimaksrd|dimaksr\.rd|dimaksucl|climaksud"), ("dalam", r"dalarn|clalam|daiam"),
    ("huruf", r"hurul|hurrf|hunrf"), ("pidana", r"pidarra|piclana|pldana"), ("setiap", r"seliap|sctiap"), ("orang", r"orarg|oralrg"), ("tahun", r"tahrn|tahur|tahurr"), ("paling", r"palirg|pa1ing"),
)
CRITICAL = (
    ("one_in_word", r"(?<=\p{Ll})1(?=\p{Ll})", "l"),
    ("nought_in_word", r"(?<=\p{Ll})0(?=\p{Ll})", "o"),
    ("five_in_word", r"(?<=\p{Ll})5(?=\p{Ll})", "s"),
    ("bar_in_word", r"(?<=\p{L})[|](?=\p{L})", "l"),
    ("stray_marks", r"[~^`]{1,}|[{}\\\\]{2,}", ""),
)
MISREAD_RULES = tuple((f"word_{right}", rf"\b(?:{wrong})\b", right) for right, wrong in MISREAD)
FORMATTING = (
    ("and_or", r"\b([Dd]an)\s*/\s*(atau)\b", "$1/$2"),
    ("word_break", r"(?<=\p{Ll})[-\u00ad\u2010]\n[ \t]*(?=\p{Ll})", ""),
    ("verse_in_brackets", r"\[(\d+)\)|\((\d+)\]", "($1$2)"),
    ("mark_runs", r"([;:])(?:\s*[;:])+", "$1"),
)
HEADERS = (
    ("president", r"(?m)^[ \t]*(?:PRES\s?[I1l]\s?DEN|FRESIDEN|PRESTDEN)[ \t]*$", "PRESIDEN"),
    ("republic", r"(?m)^[ \t]*(?:RE[FP]U[BE]\S{0,3}[KX]?|REPUBLIK)\s+[I1l]N[DO0]{2}NES[I1l]A[ \t]*$", "REPUBLIK INDONESIA"),
    ("wordless", r"(?m)^[^\p{L}\d\n()]{4,}$", ""),
)
CHAPTERS = (
    ("chapter_glued", r"\bBAB(?=[IVX]+\b)", "BAB "),
    ("chapter_dots", r"(?m)^([ \t]*BAB\s+[IVXLC]+)\s*(?:\.[ \t]?){2,}…?\s*\d*[ \t]*$", "$1"),
    *((f"chapter_l{i}", r"(?m)^([ \t]*BAB\s+[IVXLC]*)[l1|](?=[IVXLCl1|]*[ \t]*$)", "$1I") for i in range(4)),
    ("chapter_case", r"(?m)^[ \t]*[Bb]ab\s+([IVXLC]+)[ \t]*$", "BAB $1"),
    ("chapter_split", r"(?m)^([ \t]*BAB)[ \t]*\n[ \t]*([IVXLC]+)[ \t]*$", "$1 $2"),
)
ARTICLES = (
    ("article_digits", r"(?m)^([ \t]*Pasal\s+\d)[ \t]+(\d{1,2})[ \t]*$", "$1$2"),
    ("article_head", r"(?m)^([ \t]*)(?:PASAL|pasal)(\s+\d+[A-Z]?)[ \t]*$", "$1Pasal$2"),
    ("section_own_line", r"(?<=[.;])[ \t]+((?:BAGIAN|Bagian)\s+(?:Ke\w+|KE\w+|\w+)|(?:Paragraf|PARAGRAF)\s+\d+)[ \t]*(?=\n)", "\n$1"),
    ("article_break", r"(?m)^([ \t]*Pasal\s+\d+[A-Z]?)[ \t]+(?=\(\d+\))", "$1\n"),
)
TOGETHER = (
    ("verse_of", r"\b([Aa]yat)[ \t]*\n[ \t]*(?=\(\d+\))", "$1 "),
    ("letter_of", r"\b([Hh]uruf)[ \t]*\n[ \t]*(?=[a-z]\b)", "$1 "),
    ("number_of", r"\b(angka|[Nn]omor|NOMOR|[Tt]ahun|TAHUN|No\.)[ \t]*\n[ \t]*(?=\d)", "$1 "),
    ("article_of", r"\b(dalam|dimaksud|dan|atau|ketentuan)[ \t]*\n[ \t]*(?=Pasal\s+\d+[A-Z]?[ \t]+(?:ayat|dan|atau|huruf))", "$1 "),
    ("law_name", r"\b(Undang|UNDANG)-[ \t]*\n[ \t]*(?=(?:Undang|undang|UNDANG)\b)", "$1-"),
    ("verse_list", r"(\(\d+\),?)[ \t]*\n[ \t]*((?:dan|atau|sampai dengan)\s+ayat)\b", "$1 $2"),
    ("about", r"\b(Tahun\s+\d{4})[ \t]*\n[ \t]*(?=tentang\b)", "$1 "),
    ("state_gazette", r"\b((?:Tambahan\s+)?Lembaran)[ \t]*\n[ \t]*(?=(?:Negara|Daerah)\b)", "$1 "),
)
VERSES = (
    ("verse_open", r"\((\d{1,2})[ \t]+(?=\p{Lu}\p{Ll})", "($1) "),
    ("verse_spaces", r"\(\s*(\d+)\s*\)", "($1)"),
    ("verse_new_line", r"(?<=[.;:])[ \t]+(?=\(\d+\)[ \t]+\p{Lu})", "\n"),
    ("verse_twice", r"(?m)^([ \t]*\(\d+\))[ \t]+\1", "$1"),
    ("item_twice", r"(?m)^([ \t]*[a-z]\.)[ \t]+\1", "$1"),
)
STANDARD = (
    ("list_letter", r"(?m)^([ \t]*[a-z])[ \t]+\.(?=[ \t])", "$1."),
    ("list_number", r"(?m)^([ \t]*\d{1,2})[ \t]+([.)])(?=[ \t])", "$1$2"),
    ("section_case", r"(?m)^[ \t]*BAGIAN[ \t]+(KE\w+)[ \t]*$", "Bagian $1"),
)
COLLAPSED_LISTS = (("list_items", r"(?<=[;:])[ \t]+(?=[a-z]\.[ \t]+\p{L})", "\n"), ("list_numbers", r"(?<=[;:])[ \t]+(?=\d{1,2}\.[ \t]+\p{L})", "\n"))
NOISE = (
    ("filing_inline", r"[ \t]*\bSK\s+No\.?\s*\d{5,}\s*[A-Z]?\b", ""),
    ("filing_number", r"(?m)^[ \t]*SK\s+No\s+\d+\s*[A-Z]?[ \t]*$", ""),
    ("page_number", r"(?m)^[ \t]*(?:-\s*\d+\s*-|Halaman\s+\d+(?:\s+dari\s+\d+)?|Page\s+\d+)[ \t]*$", ""),
    ("next_page", r"(?m)^(?!\s*BAB\s)[^\n]{0,40}\.\s?\.\s?\.[ \t]*$", ""),
)
# Lines that go whole: page marks, crests, symbols; and what keeps a line whatever it looks like.
NOISE_LINE = r"^[ \t]*(?:-\s*[t\d]{1,4}[a-z]?\s*-|\[\s*\d{1,4}\s*\]|\d{1,4}\s*\||PRESIDEN|REPUBLIK\s+INDONESIA|SK\s+No\.?\s*\d+\s*[A-Z]?|[.\-,;:*_=~|\[\]{}\\\\'\"+]+|\.\s\.\s\..*|\p{L}|(?:\S+\s){0,4}\S*\s?(?:\.\s?\.\s?\.|…))[ \t]*$"
KEPT_LINE = r"(?i)^[ \t]*(?:BAB\s+[IVXLC]+\b.*|[a-z]\.\s+\w+.*[^.…]|.*\bpidana\b.*|.*\bayat\b.*|\(\d+\).*[^.…])$"
# A line that stands alone, and one that continues what is above it.
STRUCTURE_LINE = r"^[ \t]*(?:BAB[ \t]+[IVXLCDM\d]+|(?:BAGIAN|Bagian|BUKU|Buku|ATURAN|Aturan)[ \t]+\w+|(?:Paragraf|PARAGRAF)[ \t]+\w+|Pasal[ \t]+\d+[A-Z]?|\(\d+\)|[a-z]\.|\d+\.|[A-Z][A-Z ]*[A-Z])[ \t]*$"
JOINS = (
    # lower case after a line that ends no sentence; both ends are looked at and only the break is replaced
    ("wrapped", r"(?<=[\p{Ll}\d,)”\"])[ \t]*(?<!\n[ \t]?\(\d\))\n[ \t]*(?=(?:\p{Ll}{2}|\p{Ll}[ \t]+\p{Ll}|dan/|\d+[ \t]+\()(?![.)]))", " "),
    ("wrapped_name", r"(?<=\p{Ll}{2})[ \t]*\n[ \t]*(?=\p{Lu}\p{Ll}+(?:[ \t]+\p{Ll}|[ \t]*[,.;]))(?!(?:Pasal|Bagian|Paragraf|Buku|Menimbang|Mengingat|Menetapkan|Memutuskan|Ditetapkan|Diundangkan)\b)", " "),
)
SPACING = (
    ("comma_runs", r",(?:\s*,)+", ","),
    ("before_mark", r"[ \t]+([,;:])", "$1"),
    ("after_mark", r"([,;])(?=\p{L})", "$1 "),
)
WHITESPACE = (
    ("line_start", r"(?m)^[ \t]+", ""),
    ("line_end", r"(?m)[ \t]+$", ""),
    ("spaces", r"[ \t]{2,}", " "),
    ("newlines", r"\n{3,}", "\n\n"),
)
SHORTEST = 10


def fold(text: Column, *phases: tuple) -> Column:
    """``text`` after all rules of ``phases`` in order."""
    return reduce(lambda t, r: F.regexp_replace(t, r[1], r[2]), [r for p in phases for r in p], text)


def fix_encoding(text: Column) -> Column:
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), ENCODING, text)


def normalise_whitespace(text: Column) -> Column:
    return fold(text, LINE_ENDS, WHITESPACE)


def collapse(text: Column) -> Column:
    """All white space to single blanks: the fallback clean."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def nfkc(text: Column) -> Column:
    """The compatibility normal form: ligatures, full-width letters and composed characters in their plain form."""
    return F.pandas_udf(lambda t: t.map(lambda x: unicodedata.normalize("NFKC", x) if x is not None and not x.isascii() else x), "string")(text)


def normalise_unicode(text: Column) -> Column:
    """Line ends as line feeds, wrongly decoded characters repaired, then NFKC; bullets stay what they are."""
    return nfkc(fix_encoding(fold(text, LINE_ENDS)))


def _lines(text: Column, drop) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.when(drop(line), "").otherwise(line)), "\n")


def remove_noise_lines(text: Column) -> Column:
    """Page marks, crests and symbol lines emptied; chapters, list items, verses and what speaks of penalties stay."""
    return _lines(text, lambda line: line.rlike(NOISE_LINE) & ~line.rlike(KEPT_LINE))


def close_spaced_capitals(text: Column) -> Column:
    """Lines of single capitals set apart ("P A S A L") closed up."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line: F.when(line.rlike(r"^[ \t]*(?:[A-Z][ \t]){3,}[A-Z][ \t]*$"), F.regexp_replace(line, r"[ \t]", "")).otherwise(line)), "\n")


def correct_ocr(text: Column) -> Column:
    """Three phases in order: marks and digits inside words, misread words, formatting."""
    return fold(text, CRITICAL, MISREAD_RULES, FORMATTING)


def is_structure_line(line: Column) -> Column:
    return line.rlike(STRUCTURE_LINE)


def is_sentence_end(line: Column) -> Column:
    return line.rlike(r"[.!?][ \t]*$")


def is_sentence_start(line: Column) -> Column:
    return line.rlike(r"^[ \t]*[A-Z0-9(]")


def is_continuation(line: Column) -> Column:
    """Whether a line goes on with what is above it: lower case, and no list item."""
    return line.rlike(r"^[ \t]*\p{Ll}(?![.)])") & ~is_structure_line(line)


def is_incomplete(line: Column) -> Column:
    """Whether a line ends inside a sentence: on a comma, a linking word or no mark at all."""
    return line.rlike(r"(?i)(?:,|\b(?:dan|atau|yang|dengan|dalam|untuk|dari|oleh|pada|di|ke|dan/atau))[ \t]*$") | ~line.rlike(r"[.!?;:][ \t]*$")


def rejoin_lines(text: Column) -> Column:
    """Lines that only the page width broke joined again; headings, verses, items and ended sentences keep theirs."""
    return fold(text, JOINS)


def expand_lists(text: Column) -> Column:
    """Items that run on in one line set on lines of their own."""
    return fold(text, COLLAPSED_LISTS)


#: Phases of ``clean`` in order.
PHASES = (
    ("normalize_unicode", normalise_unicode),
    ("remove_document_noise", lambda t: fold(remove_noise_lines(t), NOISE)),
    ("fix_headers", lambda t: fold(close_spaced_capitals(t), HEADERS, CHAPTERS)),
    ("fix_legal_ocr", lambda t: fold(correct_ocr(t), LEGAL)),
    ("fix_articles", lambda t: fold(t, ARTICLES)),
    ("keep_references", lambda t: fold(t, TOGETHER)),
    ("format_verses", lambda t: fold(t, VERSES)),
    ("standardize", lambda t: fold(t, STANDARD)),
    ("rejoin_lines", rejoin_lines),
    ("fix_spacing_issues", lambda t: fold(t, SPACING)),
    ("normalize_whitespace", lambda t: F.regexp_replace(fold(t, WHITESPACE), r"^\s+|\s+$", "")),
)


def clean(text: Column) -> Column:
    """All phases; fewer than ten characters that are not blank clean to ''; null stays null."""
    full = reduce(lambda t, phase: phase[1](t), PHASES, text)
    return F.when(F.length(F.regexp_replace(text, r"\s", "")) < SHORTEST, "").otherwise(full)


def cleaned_with_statistics(text: Column) -> Column:
    """struct(text, fallback, original, cleaned, reduction, operations): the cleaned text and what was done.

    Where the phases leave nothing of a text that has ten characters, the fallback clean stands in.
    """
    done = clean(text)
    lost = (done == "") & (F.length(F.regexp_replace(text, r"\s", "")) >= SHORTEST)
    out = F.when(lost, collapse(text)).otherwise(done)
    share = F.round(1.0 - F.length(out) / F.nullif(F.length(text), F.lit(0)), 4)
    return F.struct(out.alias("text"), lost.alias("fallback"), statistics(text).alias("original"), statistics(out).alias("cleaned"), share.alias("reduction"), F.array(*[F.lit(n) for n, _ in PHASES]).alias("operations"))


# Names of the probes of a text, and what each of them looks for.
PROBES = (
    ("has_pasal_references", r"(?i)\bPasal\s+\d+"), ("has_bab_headers", r"(?i)\bBAB\s+[IVX]+"), ("has_ayat_numbers", r"\(\d+\)"), ("has_list_markers", r"(?m)^[a-z]\.\s"),
    ("has_sk_noise", r"(?i)SK\s+No"), ("has_garbled_text", r"[{}\[\]\\|~`@#$%^&*+=<>]"), ("has_spacing_issues", r",\s*,\s*,"), ("has_excessive_newlines", r"\n{3,}"),
)


def statistics(text: Column) -> Column:
    """Sizes and probes of a text."""
    return F.struct(
        F.length(text).alias("character_count"),
        F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).alias("word_count"),
        F.size(F.split(text, "\n")).alias("line_count"),
        *[text.rlike(pattern).alias(name) for name, pattern in PROBES],
    )


def suggestions(text: Column) -> Column:
    """Names of the cleaning operations that the probes call for, in order."""
    s = statistics(text)
    # Names of operations.
    wanted = F.array(
        F.lit("clean_legal_document_comprehensive"),
        F.when(s["has_sk_noise"], "remove_document_noise"),
        F.when(s["has_garbled_text"], "fix_critical_ocr_errors"),
        F.when(s["has_spacing_issues"], "fix_spacing_issues"),
        F.when(s["has_excessive_newlines"], "normalize_whitespace"),
    )
    return F.filter(wanted, lambda w: w.isNotNull())

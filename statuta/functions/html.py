"""Metadata, relationships, decisions, links and texts out of saved pages, with the standard library's parser.

A page is read once into a small tree of elements; every reader below walks that tree. Pages come in as a
column of HTML, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of metadata in both languages, in order of precedence.
LABELS = (
    ("number", ("nomor", "number")), ("year", ("tahun", "year")), ("title", ("judul", "title")), ("form", ("bentuk", "form")), ("type", ("tipe dokumen", "jenis", "type")), ("status", ("status",)), ("subject", ("subjek", "subject")),
    ("date_enacted", ("tanggal penetapan", "ditetapkan tanggal")), ("date_promulgated", ("tanggal pengundangan", "diundangkan tanggal")), ("date_effective", ("tanggal berlaku", "berlaku tanggal")),
    ("place_enacted", ("tempat penetapan",)), ("language", ("bahasa", "language")), ("location", ("lokasi", "location")), ("field", ("bidang", "field")), ("teu", ("t.e.u.", "teu")),
)
# Subjects that say nothing; words that a regulation's name contains; sections of a detail page.
NO_SUBJECTS = ("tidak ada", "-", "n/a")
REGULATION_WORDS = ("eraturan", "undang", "eputusan", "nstruksi", "ermenko", "erpres", "anun")
_METADATA, _STATUS, _REVIEW = "METADATA PERATURAN", re.compile(r"STATUS.*PERATURAN", re.I | re.S), "UJI MATERI"
SUBJECT_SPLIT = r"\s*[;|•\n\r]\s*|\s*,\s*|\s+[-–/]\s+"
_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
#: Elements that end an open element of the same kind where HTML leaves the closing tag out.
_SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",), "option": ("option",)}
_HOLDERS = ("ul", "ol", "dl", "table", "tbody", "thead", "div", "body", "html", "section", "article")


class Element:
    """One element: tag, attributes, children (elements and strings), parent."""

    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Element | str] = []

    @property
    def css(self) -> list[str]:
        return (self.attributes.get("class") or "").split()

    def walk(self) -> Iterator[Element]:
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]

    def all(self, *tags: str, where: Callable[[Element], bool] = lambda e: True) -> list[Element]:
        return [e for e in self.walk() if (not tags or e.tag in tags) and where(e)]

    def strings(self) -> Iterator[str]:
        todo: list[Element | str] = list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                yield c
            elif c.tag not in ("script", "style"):
                todo += reversed(c.children)

    def text(self, between: str = " ") -> str:
        """All text below, blanks collapsed, the strings joined by ``between``."""
        return between.join(x for x in (re.sub(r"\s+", " ", t).strip() for t in self.strings()) if x)

    def above(self, test: Callable[[Element], bool]) -> Element | None:
        e = self.parent
        while e is not None and not test(e):
            e = e.parent
        return e

    def following(self) -> list[Element]:
        """Elements after this one below the same parent."""
        same = [c for c in self.parent.children if isinstance(c, Element)] if self.parent else []
        return same[same.index(self) + 1 :] if self in same else []


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        closes = _SELF_CLOSING.get(tag, ())
        e = self.at
        while e.parent is not None and closes and e.tag not in _HOLDERS:
            if e.tag in closes:
                self.at = e.parent
                if tag != "tr" or e.tag == "tr":
                    break
            e = e.parent
        child = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(child)
        if tag not in _VOID:
            self.at = child

    def handle_endtag(self, tag):
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Element:
    """The element tree of a page; null, empty and broken pages have what could be read."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.root


def field_of(label: str) -> str | None:
    """The metadata field that a label names: it equals or begins with one of the field's labels, in their order."""
    low = re.sub(r"\s+", " ", label).strip().lower().rstrip(" :")
    return next((name for name, labels in LABELS if any(low == x or low.startswith(x) for x in labels)), None) if low else None


def _pairs(root: Element) -> Iterator[tuple[str, str]]:
    """(label, value) of the four layouts, one after the other: labelled section, rows and columns, tables, lists."""
    for e in root.walk():
        own = " ".join(c for c in e.children if isinstance(c, str))
        if _METADATA in re.sub(r"\s+", " ", own).upper():
            box = e if e.tag in ("div", "section", "article") else e.above(lambda x: x.tag in ("div", "section", "article"))
            lines = [x for x in (re.sub(r"\s+", " ", t).strip() for t in (box or root).strings()) if x]
            yield from zip(lines, lines[1:], strict=False)
    for row in root.all("div", where=lambda e: any("row" in c for c in e.css)):
        columns = [c for c in row.all("div") if any("col" in x for x in c.css)] or [c for c in row.children if isinstance(c, Element) and c.tag == "div"]
        if len(columns) >= 2:
            yield columns[0].text(), columns[1].text()
    for row in root.all("tr"):
        cells = row.all("td", "th")
        if len(cells) >= 2:
            yield cells[0].text(), cells[1].text()
    for box in root.all("dl"):
        terms, values = box.all("dt"), box.all("dd")
        if len(terms) == len(values):
            yield from ((t.text(), v.text()) for t, v in zip(terms, values, strict=True))


def metadata(root: Element) -> dict[str, str]:
    """Fields of a detail page; a later layout overwrites an earlier one, numbers and years keep their first digits.

    A page without a title field has that of its first long heading, else of its meta or title element
    (unless that is the portal's own).
    """
    found: dict[str, str] = {}
    for label, value in _pairs(root):
        name = field_of(label)
        if name and value and value != label and not (field_of(value) and value.rstrip(" :").lower() in {x for _, ls in LABELS for x in ls}):
            found[name] = value
    if "title" not in found:
        heads = [h.text() for tag in ("h1", "h2", "h3") for h in root.all(tag) if len(h.text()) > 10]
        metas = [m.attributes["content"].strip() for m in root.all("meta") if (m.attributes.get("name") or m.attributes.get("property") or "").lower() in ("title", "og:title") and m.attributes.get("content", "").strip()]
        titles = [t.text() for t in root.all("title") if len(t.text()) > 10 and "BPK" not in t.text()]
        best = next(iter([*heads, *metas, *titles]), None)
        if best:
            found["title"] = best
    for name in ("number", "year"):
        digits = re.search(r"\d+", found.get(name, ""))
        if name in found and digits:
            found[name] = digits[0]
    return found


def _section(root: Element, test: Callable[[str], bool]) -> Element | None:
    """The card (or else the nearest container) of the first heading that passes ``test``."""
    for h in root.all("h1", "h2", "h3", "h4", "h5"):
        if test(h.text().upper()):
            return h.above(lambda e: any("card" in c for c in e.css)) or h.above(lambda e: e.tag in ("div", "section", "article", "body"))
    return None


def relationships(root: Element, base: str = "") -> dict[str, list[tuple[str, str | None]]]:
    """Relation label (lower case, underscores) to its (reference, link) pairs, from the status section.

    A label is a row without list items that the next row with list items follows; links are made absolute.
    """
    box = _section(root, lambda t: bool(_STATUS.search(t)))
    found: dict[str, list[tuple[str, str | None]]] = {}
    for row in box.all("div", where=lambda e: any("row" in c for c in e.css)) if box else ():
        label = row.text().rstrip(" :")
        if row.all("li") or not label or field_of(label):
            continue
        items = next((n for n in row.following() if any("row" in c for c in n.css)), None)
        refs = []
        for li in items.all("li") if items else ():
            link = next((a.attributes["href"] for a in li.all("a") if a.attributes.get("href")), None)
            if li.text():
                refs.append((li.text(), urljoin(base, link) if link else None))
        if refs:
            found.setdefault(re.sub(r"\s+", "_", label.lower()), []).extend(refs)
    return found


_DECISION = re.compile(r"\b\d+(?:-\d+)?/PUU-[IVXLC]+/\d{4}\b|\bP?UT?U?SAN\s+(?:NOMOR|NO\.?)\s+[^\s,;]+", re.I)
_PROVISION = re.compile(r"\bPasal\s+\d+[A-Z]?(?:\s+ayat\s+\(\d+[a-z]?\))?(?:\s+huruf\s+[a-z])?", re.I)
_OUTCOMES = (("ditolak", "menolak|ditolak"), ("dikabulkan sebagian", "mengabulkan\\s+sebagian|dikabulkan\\s+sebagian"), ("dikabulkan", "mengabulkan|dikabulkan"), ("tidak dapat diterima", "tidak\\s+dapat\\s+diterima"))


def decisions(root: Element, base: str = "") -> list[dict]:
    """Judicial-review decisions: number, pdf, content (over 20 characters, else empty), provisions it cites, outcome.

    Summaries and the other fields that need a language model stay null; its scores enter as columns.
    """
    box = _section(root, lambda t: _REVIEW in t)
    out: list[dict] = []
    for a in box.all("a") if box else ():
        href = a.attributes.get("href") or ""
        number = _DECISION.search(a.text())
        if ".pdf" not in href.lower() and not number:
            continue
        holder = a.above(lambda e: e.tag in ("li", "tr", "p") or "row" in " ".join(e.css)) or box
        content = holder.text().replace(a.text(), "", 1).strip()
        if len(content) <= 20:
            after = holder.following()
            content = after[0].text() if after and not after[0].all("a") else content
        if len(content) <= 20:
            content = ""
        outcome = next((name for name, p in _OUTCOMES if re.search(p, content, re.I)), None)
        out.append({"decision_number": number[0] if number else a.text(), "pdf_url": urljoin(base, href), "decision_content": content, "provision_references": list(dict.fromkeys(m[0] for m in _PROVISION.finditer(content))), "decision_type": outcome})
    return out


_TITLE_PARTS = (("UU", r"UU|Undang-Undang"), ("PP", r"PP|Peraturan\s+Pemerintah"), ("Permen", r"Permen|Peraturan\s+Menteri"), ("Perpres", r"Perpres|Peraturan\s+Presiden"), ("Perda", r"Perda|Peraturan\s+Daerah"))


def title_parts(title: str) -> tuple[str | None, str | None, str | None]:
    """(type as written, number, year) of a result's title: the first of five kinds that fits, wherever it stands."""
    for _, names in _TITLE_PARTS:
        m = re.search(rf"({names})\s*(?:No\.?|Nomor)\s*(\d+)\s*Tahun\s*(\d{{4}})", title, re.I)
        if m:
            return m[1], m[2], m[3]
    return None, None, None


def result_items(root: Element, base: str = "") -> list[dict]:
    """Results of a search page: its detail links; else table rows that name a regulation; else marked result boxes."""
    links = root.all("a", where=lambda e: "details" in (e.attributes.get("href") or "").lower())
    if links:
        chosen = [(a, a) for a in links]
    else:
        rows = [r for r in root.all("tr") if len(r.text()) >= 10 and any(w in r.text().lower() for w in REGULATION_WORDS)]
        boxes = rows or root.all(where=lambda e: any(c in ("result", "result-item", "search-result", "list-group-item") for c in e.css))
        chosen = [(b, next((a for a in b.all("a") if a.attributes.get("href")), None)) for b in boxes]
    out = []
    for box, link in chosen:
        if link is None:
            continue
        kind, number, year = title_parts(link.text())
        low = box.text().lower()
        status = "Tidak Berlaku" if "tidak berlaku" in low or "dicabut" in low else "Berlaku" if "berlaku" in low else None
        any_year = re.search(r"\b(?:19|20)\d\d\b", box.text())
        out.append({"doc_title": link.text(), "detail_url": urljoin(base, link.attributes["href"]), "doc_type": kind, "doc_number": number, "doc_year": year or (any_year[0] if any_year else None), "doc_status": status})
    return out


def review_pdf(root: Element, base: str = "") -> str | None:
    """The PDF of a judicial review: a link named as a decision, else the first PDF below the review heading."""
    for a in root.all("a"):
        href = a.attributes.get("href") or ""
        if ".pdf" in href.lower() and ("PUU" in a.text() or re.search(r"putusan", href, re.I)):
            return urljoin(base, href)
    box = _section(root, lambda t: _REVIEW in t)
    return next((urljoin(base, a.attributes["href"]) for a in (box.all("a") if box else ()) if ".pdf" in (a.attributes.get("href") or "").lower()), None)


_ARTICLE_LINE = re.compile(r"\s*Pasal\s+\d+")


def article_blocks(text: str) -> str:
    """Lines of one article joined into one line, articles parted by blank lines."""
    blocks: list[list[str]] = [[]]
    for line in text.split("\n"):
        if _ARTICLE_LINE.match(line) and blocks[-1]:
            blocks.append([])
        if line.strip():
            blocks[-1].append(line)
    return "\n\n".join(" ".join(" ".join(b).split()) for b in blocks if b)


def body_text(root: Element) -> str:
    """The regulation's text on a page: its content element, else its container, in article blocks; empty without either."""
    for name in ("content", "container"):
        box = next(iter(root.all("div", where=lambda e, n=name: n in e.css)), None)
        if box is not None:
            return article_blocks(box.text("\n"))
    return ""


def reference_text(text: str | None) -> str:
    """A listed reference without its list number, its ``tentang`` set apart, blanks single.

    A single letter in front goes too, unless what follows is the rest of a regulation's name broken there.
    """
    t = re.sub(r"^\d+\.?\s*", "", (text or "").strip())
    lettered = re.match(r"[a-z]\.?\s+(.*)", t, re.I | re.S)
    if lettered and not any(lettered[1].lower().startswith(w) for w in REGULATION_WORDS):
        t = lettered[1]
    return " ".join(re.sub(r"(?<=\w)tentang(?=\w)", " tentang ", t).split())


_NAMED = re.compile(r"\b(?:(?:UU|PP)\s+No\.?|Peraturan\s+\w+\s+(?:No\.?|Nomor)|Undang-Undang\s+(?:No\.?|Nomor))\s*\d+\s+Tahun\s+\d{4}", re.I)


def text_references(text: str | None) -> list[str]:
    """Regulations that running text names by number and year, each spelling once, in order."""
    return list(dict.fromkeys(" ".join(m[0].split()) for m in _NAMED.finditer(text or "")))


def read_page(html: str | None) -> tuple[dict[str, str], list[dict[str, str]]]:
    """(metadata, links) of a page."""
    root = parse(html)
    return metadata(root), [{"href": a.attributes.get("href") or "", "text": a.text()} for a in root.all("a")]


_PAGE = (
    "struct<metadata: array<struct<key: string, value: string>>, links: array<struct<href: string, text: string>>,"
    " relationships: array<struct<key: string, value: array<struct<regulation_reference: string, reference_link: string>>>>,"
    " uji_materi: array<struct<decision_number: string, pdf_url: string, decision_content: string, provision_references: array<string>, decision_type: string>>,"
    " results: array<struct<doc_title: string, detail_url: string, doc_type: string, doc_number: string, doc_year: string, doc_status: string>>,"
    " review_pdf: string, text: string, text_references: array<string>>"
)


def page_record(html: Column, base: str = "") -> Column:
    """Everything that can be read from a page, as one struct; links are made absolute against ``base``."""

    def run(pages: pd.Series) -> pd.DataFrame:
        rows = []
        for page in pages:
            root = parse(page)
            related = [(k, [{"regulation_reference": r, "reference_link": h} for r, h in v]) for k, v in relationships(root, base).items()]
            text = body_text(root)
            rows.append((list(metadata(root).items()), [{"href": a.attributes.get("href") or "", "text": a.text()} for a in root.all("a")], related, decisions(root, base), result_items(root, base), review_pdf(root, base), text, text_references(text)))
        return pd.DataFrame(rows, columns=["metadata", "links", "relationships", "uji_materi", "results", "review_pdf", "text", "text_references"])

    got = F.pandas_udf(run, _PAGE)(html)
    return F.struct(
        F.map_from_entries(got["metadata"]).alias("metadata"), got["links"].alias("links"), F.map_from_entries(got["relationships"]).alias("relationships"),
        *[got[c].alias(c) for c in ("uji_materi", "results", "review_pdf", "text", "text_references")],
    )


def page_fields(html: Column) -> Column:
    """struct(metadata map, links array) of each page."""

    def run(pages: pd.Series) -> pd.DataFrame:
        rows = [read_page(p) for p in pages]
        return pd.DataFrame({"metadata": [list(m.items()) for m, _ in rows], "links": [x for _, x in rows]})

    kind = "struct<metadata: array<struct<key: string, value: string>>, links: array<struct<href: string, text: string>>>"
    got = F.pandas_udf(run, kind)(html)
    return F.struct(F.map_from_entries(got["metadata"]).alias("metadata"), got["links"].alias("links"))


def subjects(text: Column) -> Column:
    """Subjects of a text: split at delimiters, upper case, without parts of one letter and values that say nothing."""
    return F.array_distinct(F.transform(F.filter(F.transform(F.split(text, SUBJECT_SPLIT), F.trim), lambda s: (F.length(s) > 1) & ~F.lower(s).isin(*NO_SUBJECTS)), F.upper))


def pdf_link(links: Column) -> Column:
    """The regulation's PDF: a download link, else any .pdf; links of judicial reviews never."""
    usable = F.filter(links, lambda x: ~F.lower(F.concat_ws(" ", x["href"], x["text"])).rlike(r"uji\s*materi|putusan"))
    pick = lambda cond: F.get(F.filter(usable, cond), F.lit(0))["href"]
    return F.coalesce(pick(lambda x: F.lower(x["href"]).rlike(r"/download/.*\.pdf")), pick(lambda x: F.lower(x["href"]).rlike(r"\.pdf(\?|$)")), pick(lambda x: F.lower(x["href"]).contains("/download/")))

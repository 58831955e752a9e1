"""Personal information in free text: found by a skip-chain conditional random field, then masked.

A text is read into nodes that may or may not be personal information: capitalised words that are no
common words (name or not), numbers (phone, identity number or neither), expressions around an at sign
(e-mail address or not) and road expressions (address or mere road). Neighbouring words of one expression
are chained, and equal or similar tokens anywhere in the document are joined by skip edges: words one
letter apart, numbers with the same digits in another notation. Node weights and both edge weights are
learned by pseudo-likelihood from a bounded sample of documents that patterns label weakly; loopy message
passing over all kinds of nodes then makes the labels of a document consistent, so what only one of its
mentions gives away is found at all of them.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents the model is fitted on and their characters together, at most (about); hash size of the weights; training rounds.
SAMPLE_DOCS, SAMPLE_CHARS, DIMENSIONS, ROUNDS = 3_000, 30_000_000, 1 << 18, 60
#: Sweeps of message passing, to and fro, unless it has settled before; and from which of them on messages are damped.
SWEEPS, DAMPED_FROM = 60, 12
#: Most texts with copies whose hashes are broadcast; more of them are joined by shuffle.
BROADCAST_COPIES = 1_000_000
#: A word is common if it is in lower case in at least this share of as many documents as have it capitalised.
LOWER_SHARE = 1 / 200
KINDS = ("name", "email", "phone", "id_number", "address")

_AT = r"(?:\s?(?:@|＠|\(at\)|\[at\]|\{at\})\s?|\s(?:at|AT)\s(?=[\w-]+(?:\(dot\)|\[dot\]|\s?\[dot\]|\s?\(dot\)|\.[A-Za-z]{2,})))"
_DOT = r"(?:\.|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\s(?:dot|DOT)\s)"
EMAIL = rf"[A-Za-z0-9][A-Za-z0-9._+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}"
# Words that open an address, and how a house is given.
_ROAD = r"(?:Jalan|Jln\.?|Jl\.?|JALAN|JLN\.?|JL\.?|Gang|Gg\.?|GANG|GG\.?|Komplek|Kompleks|Komp\.|Perumahan|Perum\.?|Dusun|Dsn\.?|Kampung|Kp\.?|Lingkungan|Apartemen|Rusun)"
_HOUSE = r"(?:[Bb]lok\s+\w{1,4}|(?:No\.?|Nomor|NO\.?|nomor|no\.?)\s?\d+\s?[A-Za-z]?\b|RT\.?\s?\d+|\d+\s?[A-Z]?\b(?!\s+(?:Tahun|tahun)))"
ADDRESS = rf"\b{_ROAD}\s+(?:[A-Z][\w'-]*\s+){{0,5}}{_HOUSE}"
#: Expressions around an at sign and after a road word, whatever they are.
_EMAIL = re.compile(rf"(?P<whole>{EMAIL})|[A-Za-z0-9][A-Za-z0-9._+-]*\s?(?:@|＠|\(at\)|\[at\]|\{{at\}})\s?[A-Za-z0-9-]+")
_ADDRESS = re.compile(rf"(?P<whole>{ADDRESS})|\b{_ROAD}\s+[A-Z][\w'-]*")
_WHOLE_EMAIL = re.compile(EMAIL)
_NUMBER = re.compile(r"\d(?:[ .-]?\d){5,22}(?![\w/])")
_AREA = re.compile(r"(?:\(\+?\d{1,4}\)[ .-]?|\+)\Z")
_LETTERED = re.compile(r"[A-Z]{1,2}\d{6,8}(?!\w)")
_WORD = re.compile(r"[A-Z][A-Za-z']{2,}")
_AT_SIGNS = ("@", "＠", "(at)", "[at]", "{at}", " at ", " AT ")
_ROADS = ("Jalan", "JALAN", "Jl", "JL", "Jln", "Gang", "GANG", "Gg", "GG", "Komp", "Perum", "Dusun", "Dsn", "Kampung", "Kp", "Lingkungan", "Apartemen", "Rusun")
_ROMAN = re.compile(r"[IVXLC]+\Z")
# Capitalised words of documents that never are names.
_NEVER = frozenset({"bab", "puu", "ttd", "dto", "nik", "nip", "ktp", "npwp", "paspor", "yth", "pasal", "perihal", "nomor", "tahun", "januari", "februari", "maret", "april", "mei", "juni", "juli", "agustus", "september", "oktober", "november", "desember"})
_LAST_WORDS = re.compile(r"[^\s,;|]+")
_GAP = re.compile(r"(?:[ -]|\s(?:bin|binti|BIN|BINTI|Bin|Binti)\s|\s[A-Z]\.?\s)\Z")
_LOWER = re.compile(r"(?<![\w@.+-])[a-z]{2,}(?![\w@.]\w)")

# Forms of address and labels before a name; words before what is no name.
_BEFORE_NAME = {"bernama", "nama:", "saudara", "saudari", "sdr.", "sdri.", "ibu", "bapak", "dr.", "drs.", "dra.", "ir.", "prof.", "h.", "hj.", "mr.", "mrs.", "ms.", "an.", "a.n.", "menghadap", "kediaman", "penyuluh:", "tn.", "ny."}
_TITLES = {"dr", "drs", "dra", "ir", "prof", "ibu", "bapak", "saudara", "saudari", "sdr", "sdri", "mrs", "nyonya", "tuan", "haji"}
_BEFORE_OTHER = {
    "di", "kota", "kabupaten", "kab.", "desa", "kel.", "kelurahan", "kecamatan", "kec.", "provinsi", "bupati", "kawasan", "adat", "nelayan", "perbatasan", "tertinggal", "kecil", "dusun", "daerah",
    "pt", "cv", "yayasan", "forum", "ud", "koperasi", "jalan", "jln", "jl.", "jl", "gang", "gg.", "komplek", "perumahan", "ruas", "peraturan", "undang-undang", "pasal", "bab", "tanggal", "hari", "in", "at", "naskah",
}
_AFTER_OTHER = {"dan"}
_PHONE_LABELS = ("telepon", "telp", "faksimile", "fax", "kontak", "hubungi", "melalui", "telephone", "contacted", "hp", "wa", "seluler", "phone")
_ID_LABELS = ("nik", "ktp", "kependudukan", "npwp", "pajak", "nip", "paspor", "passport", "identity", "pegawai")
_OTHER_LABELS = ("rekening", "registrasi", "wilayah", "indeks", "surat", "putusan", "lembaran", "dokumen", "daerah", "kode", "rp", "seri", "invoice", "pos")

_SKIPPED = _NEVER | _TITLES
# Words inside names that are in lower case.
_LINKS = ("bin", "binti")


class Node:
    """One token that may be personal information."""

    __slots__ = ("start", "end", "kind", "text", "key", "context", "whole", "left", "links")

    def __init__(self, start, end, kind, text, key, context, whole=False):
        self.start, self.end, self.kind, self.text, self.key, self.context, self.whole = start, end, kind, text, key, context, whole
        self.left = -1
        self.links = ()


def _marked(text: str) -> list[tuple[int, int, str]]:
    """Spans of at-sign expressions, road expressions and numbers, in order and without overlap; capital letter: with a host, a house."""
    found: list[tuple[int, int, str]] = []
    if any(s in text for s in _AT_SIGNS):
        found += [(*m.span(), "E" if m["whole"] else "e") for m in _EMAIL.finditer(text)]
    if any(s in text for s in _ROADS):
        found += [(*m.span(), "A" if m["whole"] else "a") for m in _ADDRESS.finditer(text)]
    for m in _NUMBER.finditer(text):
        start, end = m.span()
        area = _AREA.search(text, max(0, start - 9), start)
        if area:
            start = area.start()
        if start and (text[start - 1].isalnum() or text[start - 1] in "_.,/-"):
            continue
        found.append((start, end, "n"))
    for m in _LETTERED.finditer(text):
        start, end = m.span()
        if not (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
            found.append((start, end, "n"))
    if len(found) < 2:
        return found
    found.sort(key=lambda f: (f[0], -f[1]))
    out = [found[0]]
    for f in found[1:]:
        if f[0] >= out[-1][1]:
            out.append(f)
    return out


def read_nodes(text: str, common: frozenset[str]) -> list[Node]:
    """The nodes of a text in order; words whose lower-case form is common are no nodes."""
    marked = _marked(text)
    spans: list[tuple[int, int, str]] = []
    at, last = 0, len(marked)
    for m in _WORD.finditer(text):
        word = m[0]
        key = word.lower()
        if key in common or key in _SKIPPED or (word.isupper() and _ROMAN.match(word)):
            continue
        start = m.start()
        if text[m.end() : m.end() + 1] == ":":  # the label of a field
            continue
        while at < last and marked[at][0] <= start:
            spans.append(marked[at])
            at += 1
        if at and start < marked[at - 1][1] and marked[at - 1][2] != "a":
            continue
        spans.append((start, m.end(), "w"))
    spans += marked[at:]
    nodes: list[Node] = []
    size = len(text)
    for start, end, kind in spans:
        word = text[start:end]
        whole, kind = kind.isupper(), kind.lower()
        key = word.lower() if kind == "w" else re.sub(r"\W", "", word.lower())
        before = text[max(0, start - 40) : start]
        line = before.rfind("\n")
        words = before[line + 1 :].replace(",", " ").replace(";", " ").replace("|", " ").split()
        p1 = words[-1].lower() if words else ("^" if line >= 0 or start < 40 else "")
        p2 = words[-2].lower() if len(words) > 1 else ""
        if not words and line > 0:
            above = before[:line].rstrip()
            p2 = "^" + ("," if above.endswith(",") else above[-4:].lower() if above[-1:] in ".)" else "")
        after = text[end : min(size, end + 24)]
        n1 = _LAST_WORDS.match(after.lstrip(" "))
        mark = after[:1] if after[:1] in ",;:|.\n()" or not after else " "
        context = (p1 if not p1.isdigit() else "9", p2 if len(p2) < 18 else "", n1[0].lower() if n1 and len(n1[0]) < 18 else "", mark)
        node = Node(start, end, kind, word, key, context, whole)
        if nodes and kind == "w" and nodes[-1].kind == "w" and start - nodes[-1].end <= 9:
            if _GAP.match(text[nodes[-1].end : start]) and nodes[-1].key not in _BEFORE_OTHER:
                node.left = len(nodes) - 1
        nodes.append(node)
    return nodes


def _h(feature: str) -> int:
    return zlib.crc32(feature.encode()) % DIMENSIONS


def word_features(node: Node, chained: bool) -> list[int]:
    word, key = node.text, node.key
    p1, p2, n1, mark = node.context
    shape = "A" if word.isupper() else "Aa" if word[1:].islower() else "aA"
    own = [f"w={key}", f"p3={key[:3]}", f"p4={key[:4]}", f"s3={key[-3:]}", f"s4={key[-4:]}", f"s2={key[-2:]}", f"sh={shape}", "b"]
    ctx = [f"p1={p1}", f"p2={p2}|{p1}", f"n1={n1}", f"m={mark}{shape}", f"c={chained}{p1[:1] == '^'}{mark}", f"p1n={p1}|{n1}"]
    return [_h(f) for f in own], [_h(f) for f in ctx]


def number_features(node: Node) -> tuple[list[int], list[int]]:
    digits = re.sub(r"\D", "", node.text)
    p1, p2, _, mark = node.context
    shape = re.sub(r"\d+", lambda m: str(len(m[0])), node.text)
    own = [f"nsh={re.sub(r'[A-Z]', 'A', shape)}", f"nl={len(digits)}", f"n2={node.text[:2]}", f"n3={digits[:3]}", f"nsep={re.sub(r'[0-9A-Z]', '', node.text)[:3]}", "nb", f"nn={len(digits)}|{node.text[:2]}"]
    ctx = [f"np1={p1}", f"np2={p2}|{p1}", f"np2={p2}", f"nm={mark}"]
    return [_h(f) for f in own], [_h(f) for f in ctx]


def span_features(node: Node) -> tuple[list[int], list[int]]:
    """Of an at-sign or road expression: its make, its first and last word, and what stands around it."""
    p1, p2, n1, mark = node.context
    words = re.findall(r"[A-Za-z]+|[^\sA-Za-z0-9]+", node.text)
    make = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z][a-z]*", "A", re.sub(r"\d+", "0", node.text)))
    k = node.kind
    own = [f"{k}b", f"{k}whole={node.whole}", f"{k}first={words[0].lower() if k == 'a' else ''}", f"{k}make={make[-4:]}", f"{k}digits={any(c.isdigit() for c in node.text)}", f"{k}marks={''.join(w for w in words if not w[0].isalpha())[:6]}", f"{k}n={min(len(words), 8)}"]
    ctx = [f"{k}p1={p1}", f"{k}p2={p2}|{p1}", f"{k}n1={n1}", f"{k}m={mark}"]
    return [_h(f) for f in own], [_h(f) for f in ctx]


def node_features(node: Node) -> tuple[list[int], list[int]]:
    if node.kind == "w":
        return word_features(node, node.left >= 0)
    return number_features(node) if node.kind == "n" else span_features(node)


def weak_word(nodes: list[Node], i: int, text: str, marks: dict[int, int]) -> int | None:
    """1 name, 0 no name, None unknown, by patterns alone."""
    node = nodes[i]
    p1, p2, n1, _ = node.context
    if node.key in _TITLES:
        return 0
    if p1 in _BEFORE_OTHER or p1.rstrip(".,") in _BEFORE_OTHER:
        return 0
    if node.left >= 0:
        return marks.get(node.left)
    if p1 in _BEFORE_NAME or (p1 == "dari" and p2 == "kuasa") or (p1 in ("keterangan", "permohonan") and p2 in ("menurut", "menimbang")):
        return 1
    start = text.rfind("\n", 0, node.start) + 1
    own = text[max(start, node.start - 160) : node.start]
    if re.search(r"\b(?:tentang|TENTANG|Perihal:)\s+(?:[^\s.,;]+\s+)*$", own):
        return 0  # inside the title of a regulation
    tail = i
    while tail + 1 < len(nodes) and nodes[tail + 1].left == tail:
        tail += 1
    if re.match(r", (?:S\.|M\.|Ph)", text[nodes[tail].end : nodes[tail].end + 5]):
        return 1
    alone = text[nodes[tail].end : nodes[tail].end + 1] in ("\n", "")
    if p1 == "^" and tail > i and alone and (p2 in ("^,", "^ttd.", "^dto", "^gan)") or p2.startswith("^")):
        return 1
    if p1 == "^" and tail > i and n1.startswith("|"):
        return 1
    if tail == i and p1 == "^" and text[node.end : node.end + 1] == " " and n1[:1].islower():
        return 0
    if own.isupper() and len(own.split()) >= 2 and own.split()[0].lower() not in _BEFORE_NAME:
        return 0  # inside a heading
    return None


def weak_number(node: Node, text: str) -> int | None:
    """0 neither, 1 phone, 2 identity number, None unknown, by labels and forms alone."""
    label = re.findall(r"[a-z]+", text[max(0, node.start - 34) : node.start].rsplit("\n", 1)[-1].lower())[-3:]
    digits = re.sub(r"\D", "", node.text)
    if any(w in _OTHER_LABELS for w in label[-2:]) and not any(w in _ID_LABELS for w in label):
        return 0
    if re.fullmatch(r"\d\d\.\d{3}\.\d{3}\.\d-\d{3}\.\d{3}", node.text) or any(w in _ID_LABELS for w in label):
        return 2
    if any(w in _PHONE_LABELS for w in label) or re.match(r"\+|\(0|08|628", node.text) and 9 <= len(digits) <= 14:
        return 1
    return None


def word_uses(texts: Iterable[str]) -> dict[str, list[int]]:
    """Per word the number of texts that have it in lower case, and of those that have it capitalised."""
    uses: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for t in texts:
        plain = _WHOLE_EMAIL.sub(" ", t) if any(a in t for a in _AT_SIGNS) else t
        for w in set(_LOWER.findall(plain)):
            uses[w][0] += 1
        for w in {w.lower() for w in _WORD.findall(plain)}:
            uses[w][1] += 1
    return uses


def common_words(texts: list[str]) -> frozenset[str]:
    """Capitalised words that also occur in lower case, in LOWER_SHARE as many texts at least: no names."""
    return frozenset(w for w, (low, high) in word_uses(texts).items() if low and high and low >= LOWER_SHARE * high and w not in _LINKS)


def once_each(df: DataFrame, key: str, text: str) -> DataFrame:
    """Column t: the non-blank texts of a table, of copies only the one of smallest key.

    Only hashes are counted; texts that have copies are few, so their hashes are broadcast below a
    counted size.
    """
    rows = df.where(F.length(F.trim(text)) > 0).select(F.col(key).alias("k"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    copied = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("k").alias("first")).where("n > 1").select("h", "first")
    small = copied.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES
    return rows.join(F.broadcast(copied) if small else copied, "h", "left").where("first is null or k = first").select("k", "t")


def corpus_common_words(texts: DataFrame) -> frozenset[str]:
    """``common_words`` of all texts (column t), whatever their number and length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(w, *n) for w, n in word_uses(batch["t"]).items()], columns=["word", "low", "high"])

    uses = texts.select("t").mapInPandas(run, "word string, low bigint, high bigint").groupBy("word").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    common = uses.where((F.col("low") > 0) & (F.col("high") > 0) & (F.col("low") >= LOWER_SHARE * F.col("high")) & ~F.col("word").isin(*_LINKS))
    return frozenset(r["word"] for r in common.select("word").collect())


def _likeness(node: Node) -> list[str]:
    """Keys that similar tokens share: a word less one letter (up to 40 letters: longer runs are no words), digits without country code."""
    if node.kind == "n":
        return [node.kind + re.sub(r"^(?:00?62|62|0)", "", node.key)]
    if node.kind == "w" and 6 <= len(node.key) <= 40:
        return ["w" + node.key, *{"w" + node.key[:i] + node.key[i + 1 :] for i in range(len(node.key))}]
    return [node.kind + node.key]


def skip_links(nodes: list[Node]) -> None:
    """Joins equal and similar tokens: each to the last one of every key it shares with earlier ones."""
    seen: dict[str, int] = {}
    keys: dict[str, list[str]] = {}
    links: dict[int, set[int]] = defaultdict(set)
    for i, node in enumerate(nodes):
        own = keys.get(node.kind + node.key)
        if own is None:
            own = keys[node.kind + node.key] = _likeness(node)
        for key in own:
            j = seen.get(key)
            if j is not None and node.left != j:
                links[i].add(j)
                links[j].add(i)
            seen[key] = i
    for i, js in links.items():
        nodes[i].links = tuple(sorted(js))


#: Labels of each kind of node; the first is no personal information.
LABELS = {"w": ("", "name"), "n": ("", "phone", "id_number"), "e": ("", "email"), "a": ("", "address")}


class Model:
    """Weights of nodes (one row per label of their kind, words as one row) and of chain and skip edges."""

    def __init__(self, common: frozenset[str], words: np.ndarray, numbers: np.ndarray, chain: float, skip: float, spans: dict[str, np.ndarray] | None = None) -> None:
        self.common, self.words, self.numbers, self.chain, self.skip, self.spans = common, words, numbers, chain, skip, spans or {}
        self.known: dict = {}

    def field(self, node: Node) -> list[float]:
        """Scores of the labels of a node by itself, that of the first label being 0."""
        slot = (node.kind, node.key if node.kind == "w" else node.text, node.text[1:2].isupper(), node.context, node.left >= 0)
        got = self.known.get(slot)
        if got is None:
            own, ctx = node_features(node)
            if node.kind == "w":
                got = [0.0, float(self.words[own].sum() + self.words[ctx].sum())]
            elif node.kind == "n":
                scores = (self.numbers[:, own].sum(axis=1) + self.numbers[:, ctx].sum(axis=1)).tolist()
                got = [x - scores[0] for x in scores]
            else:
                row = self.spans.get(node.kind)
                got = [0.0, float(row[own].sum() + row[ctx].sum()) if row is not None else 0.0]
            if len(self.known) < 300_000:
                self.known[slot] = got
        return got

    def beliefs(self, nodes: list[Node]) -> list[list[float]]:
        """Scores of the labels of all nodes after loopy message passing over chain and skip edges.

        Nodes send in order of occurrence and then in reverse, so one pair of sweeps carries evidence
        through a whole text; passing ends when no message moves by more than 0.001.
        """
        belief = [list(self.field(x)) for x in nodes]
        edges: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, x in enumerate(nodes):
            if x.left >= 0:
                edges[i].append((x.left, 2.0 * self.chain))
                edges[x.left].append((i, 2.0 * self.chain))
            for j in x.links:
                edges[i].append((j, 2.0 * self.skip))
        if not edges:
            return belief
        messages = {(i, j): [0.0] * len(belief[j]) for i, out in edges.items() for j, _ in out}
        order = sorted(edges)
        for sweep in range(SWEEPS):
            moved = 0.0
            for i in order if sweep % 2 == 0 else reversed(order):
                total = belief[i]
                for j, w in edges[i]:
                    back, old = messages[j, i], messages[i, j]
                    new = _message([t - b for t, b in zip(total, back, strict=True)], w)
                    if sweep >= DAMPED_FROM:
                        new = [0.5 * (a + b) for a, b in zip(new, old, strict=True)]
                    target = belief[j]
                    for c in range(1, len(new)):
                        step = new[c] - old[c]
                        target[c] += step
                        if abs(step) > moved:
                            moved = abs(step)
                    messages[i, j] = new
            if moved < 1e-3 and sweep:
                break
        return belief

    def names(self, nodes: list[Node]) -> list[float]:
        """Log-odds of all word nodes being part of a name."""
        return [b[1] if x.kind == "w" else -9.0 for x, b in zip(nodes, self.beliefs(nodes), strict=True)]

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of all personal information in ``text``, in order."""
        nodes = read_nodes(text, self.common)
        if not nodes:
            return []
        skip_links(nodes)
        out: list[list] = []
        last = -2
        for i, (x, scores) in enumerate(zip(nodes, self.beliefs(nodes), strict=True)):
            best = max(range(len(scores)), key=scores.__getitem__)
            if x.kind != "w":
                if best:
                    out.append([LABELS[x.kind][best], x.start, x.end])
                last = -2
            elif best and x.key not in _TITLES:
                if x.left == last:
                    out[-1][2] = x.end
                else:
                    out.append(["name", x.start, x.end])
                last = i
            else:
                last = -2
        return [tuple(o) for o in out]


def _message(cavity: list[float], w: float) -> list[float]:
    """What a node tells a neighbour that gains ``w`` by having the same label; the first label's score is 0."""
    if len(cavity) == 2:
        c = max(-30.0, min(30.0, cavity[1] - cavity[0]))
        return [0.0, 2.0 * math.atanh(math.tanh(w / 2.0) * math.tanh(c / 2.0) * 0.999999)]
    top = max(cavity)
    weights = [math.exp(c - top) for c in cavity]
    total, gain = sum(weights), math.exp(w) - 1.0
    sums = [math.log(total + gain * x) for x in weights]
    return [x - sums[0] for x in sums]


def _fit(own: list, ctx: list, y: np.ndarray, extra: np.ndarray, classes: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Adagrad on the (pseudo-)likelihood with dropped contexts; rows of weights per class, and edge weights.

    ``extra`` (node, kind of edge, class) counts the labelled neighbours of each class.
    """
    a, b = np.array(own), np.array(ctx)
    w = np.zeros((classes, DIMENSIONS), dtype=np.float64)
    g2 = np.full_like(w, 1e-2)
    edge, e2 = np.full(extra.shape[1], 0.3), np.full(extra.shape[1], 1e-2)
    target = np.eye(classes)[y]
    share = target.mean(axis=0).clip(0.02)
    weight = (1.0 / share)[y]
    weight /= weight.mean()
    for _ in range(ROUNDS):
        keep = rng.random(b.shape) > 0.35
        keep_own = rng.random(a.shape) > 0.4
        z = (w[:, a] * keep_own).sum(axis=2).T + (w[:, b] * keep).sum(axis=2).T
        z += 2.0 * np.einsum("nec,e->nc", extra, edge)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        d = (p - target) * weight[:, None] / len(y)
        for c in range(classes):
            g = np.bincount(a.ravel(), (d[:, c, None] * keep_own).ravel(), DIMENSIONS) + np.bincount(b.ravel(), (d[:, c, None] * keep).ravel(), DIMENSIONS) + 1e-7 * w[c]
            g2[c] += g * g * 1e4
            w[c] -= 0.5 * g * 1e2 / np.sqrt(g2[c]) * 0.5
        ge = 2.0 * np.einsum("nec,nc->e", extra, d)
        e2 += ge * ge
        edge = np.clip(edge - 0.05 * ge / np.sqrt(e2), 0.05, 2.0)
    return w, edge


def _weak(nodes: list[Node], text: str) -> dict[int, int]:
    """Labels that patterns give to some nodes of a text, as positions in LABELS."""
    marks: dict[int, int] = {}
    words: dict[int, int] = {}
    for i, node in enumerate(nodes):
        m = weak_word(nodes, i, text, words) if node.kind == "w" else weak_number(node, text) if node.kind == "n" else int(node.whole)
        if m is not None:
            marks[i] = m
            if node.kind == "w":
                words[i] = m
    return marks


def fit(texts: list[str], seed: int = 7, common: frozenset[str] | None = None) -> Model:
    """The model of a sample of texts, with the common words of their corpus (else of the sample).

    A sample without one kind of nodes leaves their weights at zero, so that none of them is found.
    """
    if common is None:
        common = common_words(texts)
    rng = np.random.default_rng(seed)
    rows: dict[str, list] = {k: [] for k in LABELS}
    for text in texts:
        nodes = read_nodes(text, common)
        skip_links(nodes)
        marks = _weak(nodes, text)
        right = {x.left: i for i, x in enumerate(nodes) if x.left >= 0}
        for i, m in marks.items():
            node = nodes[i]
            near = np.zeros((2, len(LABELS[node.kind])))
            for e, js in ((0, (node.left, right.get(i, -1))), (1, node.links)):
                for j in js:
                    if j in marks:
                        near[e, marks[j]] += 1
            rows[node.kind].append((*node_features(node), m, near))
    edge = np.array([0.5, 0.5])
    weights: dict[str, np.ndarray] = {}
    for kind, labels in LABELS.items():
        if not rows[kind]:
            continue
        own, ctx, y, near = zip(*rows[kind], strict=True)
        if len(set(y)) < 2 and kind in "wn":
            continue
        w, own_edge = _fit(list(own), list(ctx), np.array(y), np.array(near), len(labels), rng)
        weights[kind] = w
        if kind == "w":
            edge = own_edge
    words = weights["w"][1] - weights["w"][0] if "w" in weights else np.zeros(DIMENSIONS)
    numbers = weights.get("n", np.zeros((3, DIMENSIONS)))
    spans = {k: (weights[k][1] - weights[k][0]).astype(np.float32) for k in "ea" if k in weights}
    return Model(common, words.astype(np.float32), numbers.astype(np.float32), float(edge[0]), float(edge[1]), spans)


def train(df: DataFrame, key: str, text: str, sample: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """The model, fitted on about ``sample`` different texts of ``sample_chars`` characters together, drawn by hash.

    Texts of any length may be drawn. Only weights come from the sample; the common words are counted
    over all different texts.
    """
    texts = once_each(df, key, text)
    n, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    share = min(1.0, sample / max(n, 1), sample_chars / max(chars, 1))
    drawn = texts.where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < share * (1 << 20)).select("t").collect() if n else []
    return fit(sorted(r["t"] for r in drawn), common=corpus_common_words(texts))


def personal_information(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS) -> DataFrame:
    """(key, kind, start_pos, end_pos) of each occurrence; positions count code points from 0.

    Null and empty texts have none; repeated rows are read alike; texts are read whole whatever their
    length. A table without texts gives an empty result.
    """
    model = df.sparkSession.sparkContext.broadcast(train(df, key, text, sample))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = model.value.find
        for batch in batches:
            out = [(k, *f) for k, t in zip(batch["k"], batch["t"], strict=True) if t for f in find(t)]
            yield pd.DataFrame(out, columns=[key, "kind", "start_pos", "end_pos"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"`{key}` {kind}, kind string, start_pos int, end_pos int")


def mask(text: str, found: list[tuple[str, int, int]]) -> str:
    """``text`` with typed placeholders in place of what was found."""
    out, at = [], 0
    for kind, start, end in found:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
    return "".join([*out, text[at:]])


def masked(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS) -> DataFrame:
    """(key, text, n_masked): every text with its personal information replaced; null stays null."""
    model = df.sparkSession.sparkContext.broadcast(train(df, key, text, sample))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = model.value.find
        for batch in batches:
            found = [find(t) if t else [] for t in batch["t"]]
            texts = [mask(t, f) if t is not None else None for t, f in zip(batch["t"], found, strict=True)]
            yield pd.DataFrame({key: batch["k"], "text": texts, "n_masked": [len(f) for f in found]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"`{key}` {kind}, text string, n_masked int")

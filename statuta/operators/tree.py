"""Parsing of cleaned statute text into rows of a hierarchy, and roll-ups over it.

One document is one row; its lines are classified and stacked in a Python generator per Arrow batch,
because a node's parent depends on all lines before it. What follows from a node alone (sort keys, labels,
citations) is left to column functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.functions import legal

# Levels of the hierarchy and what a line of each level looks like.
LEVELS = (
    ("buku", 1.0, re.compile(r"BUKU\s+([IVXLC]+)\b", re.I)),
    ("bab", 2.0, re.compile(r"BAB\s+([IVXL]+[A-Z]?)\b")),
    ("bagian", 3.0, re.compile(r"BAGIAN\s+(?:KE\s*)?(\w+)", re.I)),
    ("paragraf", 4.0, re.compile(r"PARAGRAF\s+(?:KE\s*)?(\w+)", re.I)),
    ("pasal", 5.0, re.compile(r"Pasal\s+(\d+[A-Z]?)\s*$")),
    ("ayat", 6.0, re.compile(r"\(\s*(\d+)\s*\)")),
    ("angka", 7.5, re.compile(r"(\d{1,2})\.(?=\s|$)")),
    ("huruf", 7.0, re.compile(r"([a-z])\.(?=\s|$)")),
)
AMENDING = re.compile(r"disisipkan|diubah|dicabut|ditambahkan|\d+\.\s+(?:di\s*antara|setelah|sebelum)", re.I)
NOISE = re.compile(r"(?:PRESIDEN\s+)?REPUBLIK INDONESIA$|PRESIDEN$|DENGAN RAHMAT TUHAN YANG MAHA ESA|(?:Page|Halaman)\s+\d+(?:\s+(?:of|dari)\s+\d+)?\s*$|-\s*\d+\s*-$")
#: Types whose text may be of any length, and the least length of running text of others.
ITEMS, SHORTEST = ("ayat", "huruf", "angka"), 5
MARKER = re.compile(r"\(\d\)$|[a-z0-9]{1,2}[.)]$|[IVX]+$")
_FIELDS = ["seq", "depth", "type", "number", "title", "local_content", "unit_id", "parent_unit_id", "parent_pasal_id", "path_types", "path_labels", "path_ids"]
_SCHEMA = (
    "doc_id string, seq int, depth int, type string, number string, title string, local_content string, unit_id string, parent_unit_id string,"
    " parent_pasal_id string, path_types array<string>, path_labels array<string>, path_ids array<string>"
)


def classify(line: str, amending: bool = False) -> tuple[str, float, str, str] | None:
    """(type, level, number, rest of the line) of a line that opens a node; None for running text.

    An article heading stands alone on its line, so a sentence that begins with a citation opens none; a
    numbered item of an amending section stands between paragraph and article.
    """
    for kind, level, pattern in LEVELS:
        m = pattern.match(line)
        if m:
            number = m[1].upper() if kind in ("buku", "bab") else m[1]
            if kind == "angka" and amending:
                level = 4.5
            return kind, level, number, line[m.end() :].strip()
    return None


def parse(doc_id: str, text: str | None) -> list[tuple]:
    """Nodes of one document in pre-order; equal ids among them get -2, -3 and so on."""
    nodes: list[dict] = []
    stack: list[dict] = [{"level": 0.0, "unit_id": doc_id, "pasal": None, "path": [], "text": [], "type": "dokumen"}]
    used: dict[str, int] = {}
    amending = False
    for raw in (text or "").splitlines():
        line = raw.strip()
        # lines of up to three characters are noise unless they are markers of verses and items
        if len(line) < 2 or NOISE.match(line) or (len(line) <= 3 and not MARKER.match(line)):
            continue
        if AMENDING.search(line):
            amending = True
        found = classify(line, amending)
        if found is None:
            if not (stack[-1]["type"] in ITEMS and stack[-1]["text"][-1:] == [line]):  # a list item's line read twice
                stack[-1]["text"].append(line)
            continue
        kind, level, number, rest = found
        if kind in ("buku", "bab", "bagian"):
            amending = False
        while len(stack) > 1 and stack[-1]["level"] >= level:
            stack.pop()
        up = stack[-1]
        base = f"{up['unit_id']}/{kind}-{number}"
        used[base] = used.get(base, 0) + 1
        unit_id = base if used[base] == 1 else f"{base}-{used[base]}"
        label = {"pasal": f"Pasal {number}", "ayat": f"({number})", "huruf": f"{number}.", "angka": f"{number}."}.get(kind, f"{kind.upper()} {number}")
        node = {
            "level": level, "type": kind, "number": number, "unit_id": unit_id, "parent": up["unit_id"], "depth": len(stack), "text": [],
            "title": rest if kind in ("buku", "bab", "bagian", "paragraf") and rest else None,
            "above": up["pasal"], "pasal": unit_id if kind == "pasal" else up["pasal"], "path": [*up["path"], (kind, label, unit_id)],
        }
        if rest and kind in ("ayat", "huruf", "angka"):
            node["text"].append(rest)
        nodes.append(node)
        stack.append(node)
    out = []
    for seq, n in enumerate(nodes):
        body = re.sub(r"^\s*[,;.]\s*", "", " ".join(n["text"])).strip()
        if len(body) < SHORTEST and n["type"] not in ITEMS:  # crumbs of running text
            body = ""
        title = n["title"]
        if title is None and n["type"] in ("buku", "bab", "bagian", "paragraf") and body:
            title, body = body, ""
        path = n["path"]
        out.append((doc_id, seq, n["depth"], n["type"], n["number"], title, body or None, n["unit_id"], n["parent"], n["above"], [p[0] for p in path], [p[1] for p in path], [p[2] for p in path]))
    return out


def parse_tree(docs: DataFrame, text: str = "doc_content") -> DataFrame:
    """One row per node of each document; documents without headings, null and empty texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for d, t in zip(batch["doc_id"], batch["t"], strict=True) for r in parse(d, t)]
            yield pd.DataFrame(rows, columns=["doc_id", *_FIELDS])

    return docs.where(F.col(text).isNotNull()).select("doc_id", F.col(text).alias("t")).mapInPandas(run, _SCHEMA)


def unit_rows(nodes: DataFrame, titles: DataFrame) -> DataFrame:
    """Nodes as unit rows with ordinals, sort key, label, citation and path; ``titles``: doc_id, doc_title."""
    path = F.transform(F.arrays_zip("path_types", "path_labels", "path_ids"), lambda p: F.struct(p["path_types"].alias("type"), p["path_labels"].alias("label"), p["path_ids"].alias("unit_id")))
    rows = nodes.join(titles, "doc_id", "left").withColumn("path", path).withColumn("_o", legal.ordinal(F.col("number")))
    return rows.select(
        "doc_id", F.upper("type").alias("unit_type"), "unit_id", "seq", F.col("number").alias("number_label"), "_o.ordinal_int", "_o.ordinal_suffix",
        legal.label_display(F.col("type"), F.col("number")).alias("label_display"), legal.sort_key(F.col("_o.ordinal_int"), F.col("_o.ordinal_suffix")).alias("seq_sort_key"),
        "title", "local_content", "path", legal.citation(F.col("doc_title"), F.col("path")).alias("citation_string"), "parent_unit_id", "parent_pasal_id",
        F.array_join("path_labels", " / ").alias("hierarchy_path"),
    )


def roll_up(units: DataFrame) -> DataFrame:
    """Own and descendants' local content in tree order, joined by blank lines: doc_id, unit_id, content.

    Each unit hands its text to all its ancestors, so a row is repeated once per level and the sums are
    grouped by ancestor.
    """
    steps = F.split("unit_id", "/")
    ancestors = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    spread = units.where("unit_id is not null and local_content is not null").where(F.size(steps) > 1).select("doc_id", "seq", "local_content", F.explode(ancestors).alias("unit_id"))
    return spread.groupBy("doc_id", "unit_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "local_content"))), lambda x: x["local_content"]), "\n\n").alias("content"))


def keep_first(units: DataFrame, key: str = "unit_row_id") -> DataFrame:
    """Each (doc_id, unit_id) once: its first row by ``key``."""
    order = Window.partitionBy("doc_id", "unit_id").orderBy(key)
    return units.withColumn("_i", F.row_number().over(order)).where("_i = 1").drop("_i")

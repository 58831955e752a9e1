"""From document trees to unit rows and vectors, and from texts to trees: the indexing pipeline.

A tree is one JSON value per document and small, so it is walked in a Python generator per Arrow batch;
what follows from a node alone is left to column functions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions import cleaning, legal
from statuta.operators import tree

# Node types of a tree and the unit types they become; all others become DOKUMEN.
NODE_TYPES = {
    "dokumen": "DOKUMEN", "buku": "BUKU", "bab": "BAB", "bagian": "BAGIAN", "paragraf": "PARAGRAF", "pasal": "PASAL", "angka_amandement": "ANGKA_AMANDEMENT", "ayat": "AYAT", "huruf": "HURUF", "angka": "ANGKA",
}

_FIELDS = ["seq", "depth", "unit_type", "unit_id", "number_label", "title", "local_content", "parent_unit_id", "parent_pasal_id", "labels"]
_SCHEMA = "_k string, seq int, depth int, unit_type string, unit_id string, number_label string, title string, local_content string, parent_unit_id string, parent_pasal_id string, labels array<string>"


def _kids(node: dict) -> list[dict]:
    kids = node.get("children")
    while isinstance(kids, str):  # stored as JSON in a string
        try:
            kids = json.loads(kids)
        except ValueError:
            return []
    if isinstance(kids, dict):
        kids = [kids]
    return [k for k in kids if isinstance(k, dict)] if isinstance(kids, list) else []


def _text(node: dict, name: str) -> str | None:
    value = node.get(name)
    return None if value is None or isinstance(value, (dict, list)) else str(value)


def flatten(root: dict) -> list[tuple]:
    """Rows of a tree in pre-order, fields as in _FIELDS.

    The children of the root are indexed; the root itself only where it has none. A node whose unit_id was
    seen before is skipped with all that is below it. parent_pasal_id is the nearest article above a node.
    Nodes without a unit_id are named by their place.
    """
    out: list[tuple] = []
    seen: set[str] = set()
    start = _kids(root) or [root]
    top = _text(root, "unit_id") if _kids(root) else None
    # (node, depth, parent id, nearest article, labels above, place), a stack in place of recursion
    todo = [(n, 1, top, None, [], str(i)) for i, n in reversed(list(enumerate(start)))]
    while todo:
        node, depth, parent, pasal, above, place = todo.pop()
        unit_id = _text(node, "unit_id") or f"{parent or ''}/{place}"
        if unit_id in seen:
            continue
        seen.add(unit_id)
        kind = NODE_TYPES.get(str(node.get("type") or "").strip().lower(), "DOKUMEN")
        labels = [*above, _text(node, "label_display") or _text(node, "number_label") or kind]
        out.append((len(out), depth, kind, unit_id, _text(node, "number_label"), _text(node, "title"), _text(node, "local_content"), parent, pasal, labels))
        below = unit_id if kind == "PASAL" else pasal
        todo += [(k, depth + 1, unit_id, below, labels, str(i)) for i, k in reversed(list(enumerate(_kids(node))))]
    return out


def unit_rows(records: DataFrame, key: str, tree_column: str = "document_tree") -> DataFrame:
    """The units of every record's tree: key, the fields of ``flatten``, ordinals, sort key and hierarchy path.

    Null, unreadable and non-object trees give no unit.
    """
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch["_k"], batch["_t"], strict=True):
                try:
                    root = json.loads(text)
                except (ValueError, RecursionError):
                    continue
                if isinstance(root, dict):
                    rows += [(k, *r) for r in flatten(root)]
            yield pd.DataFrame(rows, columns=["_k", *_FIELDS])

    nodes = records.where(F.col(tree_column).isNotNull()).select(F.col(key).cast("string").alias("_k"), F.col(tree_column).alias("_t")).mapInPandas(run, _SCHEMA)
    rows = nodes.withColumn("_o", legal.ordinal(F.coalesce("number_label", F.lit(""))))
    return rows.select(
        F.col("_k").cast(kind).alias(key), "seq", "depth", "unit_type", "unit_id", "number_label", "title", "local_content", "parent_unit_id", "parent_pasal_id",
        "_o.ordinal_int", "_o.ordinal_suffix", legal.sort_key(F.col("_o.ordinal_int"), F.col("_o.ordinal_suffix")).alias("seq_sort_key"), F.array_join("labels", " / ").alias("hierarchy_path"),
    )


def tree_sizes(units: DataFrame, key: str) -> DataFrame:
    """Nodes of each tree, the root counted too, and their greatest depth."""
    return units.groupBy(key).agg((F.count("*") + 1).alias("n_nodes"), F.max("depth").alias("depth"))


def article_texts(units: DataFrame, key: str) -> DataFrame:
    """(key, unit_id, full_content) of each article: its own text and that of all units below it, in order.

    Each unit stands on a line of its own, indented by two blanks for each level below the article and
    led by its label. Only text below an article moves, once, to that article.
    """
    own = units.where("unit_type = 'PASAL'").select(key, F.col("unit_id").alias("pasal"), F.col("depth").alias("base"))
    label = legal.label_display(F.col("unit_type"), F.coalesce("number_label", F.lit("")))
    line = F.concat_ws(" ", F.when(F.col("unit_type") != "PASAL", F.nullif(label, F.lit(""))), F.nullif("local_content", F.lit("")))
    rows = units.select(key, F.when(F.col("unit_type") == "PASAL", F.col("unit_id")).otherwise(F.col("parent_pasal_id")).alias("pasal"), "seq", "depth", line.alias("line")).where("pasal is not null and line <> ''")
    placed = rows.join(own, [key, "pasal"]).withColumn("line", F.concat(F.repeat(F.lit("  "), F.greatest(F.col("depth") - F.col("base"), F.lit(0))), F.col("line")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n")
    return placed.groupBy(key, F.col("pasal").alias("unit_id")).agg(joined.alias("full_content"))


def vector_rows(units: DataFrame, documents: DataFrame, embed: Column | None = None, dimension: int | None = None) -> DataFrame:
    """Vector records of articles with text: filter columns of their documents, sizes, and the vector.

    ``units`` have doc_id and content; ``embed`` is an expression over ``content`` (a registered function
    or a column of vectors). Rows whose vector is null or of another length are left out; without
    ``embed`` the vector column is null and no row is dropped.
    """
    rows = units.where("unit_type = 'PASAL' and trim(content) <> ''").join(documents, "doc_id")
    vector = embed if embed is not None else F.lit(None).cast("array<float>")
    out = rows.select(
        "doc_id", "unit_id", F.lit("pasal").alias("content_type"), vector.alias("embedding"), "doc_form", "doc_year", "doc_number", "doc_status",
        *[legal.path_number(F.col("unit_id"), level).alias(f"{level}_number") for level in ("bab", "pasal", "ayat")],
        F.size(F.filter(F.split("content", r"\s+"), lambda w: w != "")).alias("token_count"), F.length("content").alias("char_count"),
    )
    if embed is None:
        return out
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    return out.where(good & (F.size("embedding") == dimension) if dimension else good)


def processed_texts(texts: DataFrame, key: str, text: str, method: str = "manual_txt_input", confidence: float = 100.0) -> DataFrame:
    """Cleaned text and processing state of text files; what a PDF extraction gives passes through the same way.

    Columns: key, doc_content, method, confidence, doc_processing_status (txt_processed, or failed where
    nothing is left after cleaning).
    """
    clean = cleaning.clean(F.col(text))
    return texts.select(F.col(key), clean.alias("doc_content"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence")).withColumn(
        "doc_processing_status", F.when(F.coalesce(F.col("doc_content"), F.lit("")) == "", "failed").otherwise("txt_processed")
    )


def processed_extractions(results: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The best extraction of each document by score, cleaned: key, doc_content, method, confidence, score, doc_processing_status."""
    c = F.col
    scored = results.withColumn("_s", legal.extraction_score(c("success"), c("confidence"), c(text), c("method")))
    best = scored.groupBy(key).agg(F.max_by(F.struct(c(text).alias("t"), "method", "confidence", c("_s").alias("score")), F.struct("_s", -c("extraction_id"))).alias("b"))
    done = best.select(key, cleaning.clean(c("b.t")).alias("doc_content"), "b.method", "b.confidence", "b.score")
    return done.withColumn("doc_processing_status", F.when(F.coalesce(c("doc_content"), F.lit("")) == "", "failed").otherwise("pdf_processed"))


def indexed_texts(documents: DataFrame, text: str = "doc_content") -> DataFrame:
    """Texts to unit rows in one plan: parsed, labelled, each with its own and its descendants' text as content."""
    units = tree.unit_rows(tree.parse_tree(documents, text), documents.select("doc_id", "doc_title").dropDuplicates(["doc_id"]))
    content = tree.roll_up(units.select("doc_id", "seq", "unit_id", "local_content"))
    return units.join(content, ["doc_id", "unit_id"], "left")


def pages_text(pages: DataFrame, key: str, least: float = 60.0) -> DataFrame:
    """OCR pages as one text per document: pages under ``least`` confidence fall out, the rest joined by blank lines in order."""
    kept = pages.where(F.col("confidence") >= least)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n\n")
    return kept.groupBy(key).agg(ordered.alias("text"), F.avg("confidence").alias("confidence"), F.count("*").alias("n_pages"))


# Highest confidence of each extraction back end.
BACKEND_CAPS = {"pymupdf": 95.0, "pdfplumber": 90.0, "pypdf": 85.0}


def backend_confidence(text: Column, method: Column) -> Column:
    """Confidence of an extraction by its length: a hundredth of its characters, up to the back end's cap; 0 for others."""
    cap = F.lit(0.0)
    for name, most in BACKEND_CAPS.items():
        cap = F.when(method == name, most).otherwise(cap)
    return F.least(cap, F.coalesce(F.length(text), F.lit(0)) / 100.0)



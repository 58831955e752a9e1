"""Relational tables out of deeply nested records, by higher-order SQL projection.

A tree column is a JSON string of a recursive node; Spark schemas cannot recurse, so the node stays a
``VARIANT`` and one expression of nested ``transform`` calls walks it. Each level hands its own key to
the level below, ``flatten`` joins what the levels return, and a single ``inline`` per target table
emits the rows. No row leaves its task: there is no shuffle, join or Python in these plans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels below the root that the tree projection covers unless told otherwise.
MAX_DEPTH = 16

NODE_FIELDS = {
    "type": "string",
    "unit_id": "string",
    "number_label": "string",
    "ordinal_int": "int",
    "title": "string",
    "local_content": "string",
}


def _shape(value: Column) -> Column:
    """ARRAY, OBJECT, STRING ... of a variant; null for null."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def _as_list(value: Column, decode: int = 2) -> Column:
    """The children of a node in whatever shape they are stored, as an array of variants.

    A list stays as it is, a lone object becomes a list of one, a string is read as JSON (up to
    ``decode`` times over; JSON in a string beyond that fails the query), anything else has no children.
    """
    shape = _shape(value)
    out = F.when(shape == "ARRAY", value.cast("array<variant>")).when(shape == "OBJECT", F.array(value))
    if decode:
        inner = F.try_parse_json(value.cast("string"))
        out = out.when(shape == "STRING", F.get(F.transform(F.array(inner), lambda v: _as_list(v, decode - 1)), F.lit(0)))
    else:
        deeper = F.coalesce(_shape(F.try_parse_json(value.cast("string"))).isin("ARRAY", "OBJECT", "STRING"), F.lit(False))
        out = out.when((shape == "STRING") & deeper, F.raise_error(F.lit("children are JSON in a string too many times over")).cast("array<variant>"))
    return out


def _children(node: Column) -> Column:
    raw = F.variant_get(node, "$.children", "variant")
    # the one-element transform binds the extracted value to a name, so it is extracted once
    return F.coalesce(F.get(F.transform(F.array(raw), lambda v: _as_list(v)), F.lit(0)), F.array().cast("array<variant>"))


def _subtree(node: Column, key: Column, depth: int, left: int) -> Column:
    """Rows of all nodes below ``node``, pre-order."""
    if left == 0:
        overflow = F.raise_error(F.lit(f"the tree has nodes more than {depth - 1} levels below its root; raise max_depth"))
        return F.when(F.size(F.filter(_children(node), lambda c: c.isNotNull())) > 0, overflow.cast(_ROWS)).otherwise(F.array().cast(_ROWS))

    def below(child: Column, position: Column) -> Column:
        own = F.concat(key, F.lit("."), position.cast("string"))
        row = F.struct(
            key.alias("parent_key"),
            own.alias("child_key"),
            F.lit(depth).alias("depth"),
            *[F.try_variant_get(child, f"$.{name}", kind).alias(name) for name, kind in NODE_FIELDS.items()],
        )
        return F.when(_present(child), F.concat(F.array(row), _subtree(child, own, depth + 1, left - 1))).otherwise(F.array().cast(_ROWS))

    return F.flatten(F.transform(_children(node), below))


def _present(child: Column) -> Column:
    return child.isNotNull() & ~F.is_variant_null(child)


_ROWS = "array<struct<parent_key: string, child_key: string, depth: int, " + ", ".join(f"{k}: {v}" for k, v in NODE_FIELDS.items()) + ">>"


def tree_nodes(df: DataFrame, key: str = "record_id", tree: str = "document_tree", max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per node below the root of the JSON tree in column ``tree``.

    Columns: ``key``, parent_key, child_key, depth and the node's own scalar fields. The root has key
    ``r`` and no row; positions count from 0; null elements keep their position and give no row; a null,
    empty or unreadable tree gives none, as does a tree without children. A tree deeper than
    ``max_depth`` fails the query with a message: no node is dropped silently. Other columns of ``df``
    do not matter; repeated records give repeated rows.
    """
    parsed = df.select(F.col(key).alias("_key"), F.try_parse_json(F.col(tree)).alias("_root")).where("_root is not null")
    rows = parsed.select("_key", _subtree(F.col("_root"), F.lit("r"), 1, max_depth).alias("_rows"))
    return rows.selectExpr(f"_key as `{key}`", "inline(_rows)")


def map_items(df: DataFrame, key: str = "record_id", column: str = "relationships") -> DataFrame:
    """One row per element of a map of arrays of structs; parent_key is the map key as stored.

    Null maps, null and empty lists give no rows; a null element keeps its position and gives no row.
    """
    pairs = F.transform(
        F.map_entries(column),
        lambda e: F.transform(
            F.coalesce(e["value"], F.array()),
            lambda item, i: F.when(
                item.isNotNull(),
                F.struct(e["key"].alias("parent_key"), F.concat_ws(".", e["key"], i.cast("string")).alias("child_key"), item.alias("item")),
            ),
        ),
    )
    rows = df.select(F.col(key).alias("_key"), F.filter(F.flatten(pairs), lambda r: r.isNotNull()).alias("_rows"))
    return rows.selectExpr("_key", "inline(_rows)").select(F.col("_key").alias(key), "parent_key", "child_key", "item.*")


def nested_items(df: DataFrame, key: str = "record_id", column: str = "uji_materi", field: str = "provision_references", carry: tuple[str, ...] = ("decision_number",)) -> DataFrame:
    """One row per element of the array ``field`` inside the array of structs ``column``.

    parent_key is the position of the struct, child_key adds the element's own position; null structs,
    null and empty lists give no rows but keep their place in the count. ``carry`` names fields of the
    struct that each row repeats.
    """
    rows = F.transform(
        F.col(column),
        lambda outer, i: F.transform(
            F.coalesce(outer[field], F.array()),
            lambda item, j: F.when(
                item.isNotNull(),
                F.struct(
                    i.cast("string").alias("parent_key"),
                    F.concat_ws(".", i.cast("string"), j.cast("string")).alias("child_key"),
                    *[outer[c].alias(c) for c in carry],
                    item.alias("item"),
                ),
            ),
        ),
    )
    flat = df.select(F.col(key).alias("_key"), F.filter(F.flatten(F.filter(rows, lambda r: r.isNotNull())), lambda r: r.isNotNull()).alias("_rows"))
    return flat.selectExpr(f"_key as `{key}`", "inline(_rows)")


def decisions(df: DataFrame, key: str = "record_id", column: str = "uji_materi") -> DataFrame:
    """One row per non-null decision, with its position as decision_key and its scalar fields."""
    item = df.schema[column].dataType.elementType
    scalars = [f.name for f in item.fields if f.dataType.simpleString() == "string"]
    rows = F.transform(
        F.col(column),
        lambda d, i: F.when(d.isNotNull(), F.struct(i.cast("string").alias("decision_key"), *[d[c].alias(c) for c in scalars], F.size(F.coalesce(d["provision_references"], F.array())).alias("n_provisions"))),
    )
    flat = df.select(F.col(key).alias("_key"), F.filter(rows, lambda r: r.isNotNull()).alias("_rows"))
    return flat.selectExpr(f"_key as `{key}`", "inline(_rows)")


def child_links(df: DataFrame, key: str = "record_id") -> DataFrame:
    """All parent-child links of crawl records: entity is node, reference or provision."""
    parts = [("node", tree_nodes(df, key)), ("reference", map_items(df, key)), ("provision", nested_items(df, key))]
    out = None
    for entity, rows in parts:
        one = rows.select(key, F.lit(entity).alias("entity"), "parent_key", "child_key")
        out = one if out is None else out.unionByName(one)
    return out

"""Nested records: every shape of children, null elements, depth, empty tables."""

from __future__ import annotations

import json

import pytest

from statuta.operators.nested import child_links, decisions, map_items, nested_items, tree_nodes
from statuta.schema import DECISION, REFERENCE

SCHEMA = f"record_id bigint, entity string, parent_key string, relationships map<string, array<{REFERENCE.simpleString()}>>, uji_materi array<{DECISION.simpleString()}>, document_tree string"


def rows(spark, *records):
    return spark.createDataFrame([(i, "x", "y", r.get("rel"), r.get("uji"), r.get("tree")) for i, r in enumerate(records)], SCHEMA)


def keys(df):
    return sorted((r["record_id"], r["parent_key"], r["child_key"]) for r in df.collect())


def brute(tree):
    out = []

    def kids(n):
        c = n.get("children") if isinstance(n, dict) else None
        for _ in range(2):
            if isinstance(c, str):
                try:
                    c = json.loads(c)
                except ValueError:
                    c = None
        return [c] if isinstance(c, dict) else c if isinstance(c, list) else []

    def walk(n, key):
        for i, c in enumerate(kids(n)):
            if c is not None:
                out.append((0, key, f"{key}.{i}"))
                walk(c, f"{key}.{i}")

    walk(tree, "r")
    return sorted(out)


def test_children_in_every_shape(spark):
    leaf = {"type": "huruf", "number_label": "a"}
    tree = {"type": "dokumen", "children": [None, {"type": "bab", "children": leaf}, {"type": "bab", "children": json.dumps([leaf, None, {"type": "x", "children": json.dumps(leaf)}])}, {"children": []}, {"children": None}, {"children": "no json"}, {"children": 5}]}
    got = keys(tree_nodes(rows(spark, {"tree": json.dumps(tree)})))
    assert got == brute(tree)
    assert (0, "r.2", "r.2.2") in got and (0, "r", "r.0") not in got


def test_depth_is_never_cut_silently(spark):
    tree = {"type": "x"}
    for _ in range(9):
        tree = {"children": [tree]}
    df = rows(spark, {"tree": json.dumps(tree)})
    assert len(tree_nodes(df, max_depth=9).collect()) == 9
    with pytest.raises(Exception, match="raise max_depth"):
        tree_nodes(df, max_depth=5).collect()


def test_unreadable_null_and_empty_trees(spark):
    df = rows(spark, {"tree": None}, {"tree": ""}, {"tree": '{"children": [{"a": 1}'}, {"tree": "{}"}, {"tree": "[]"}, {"tree": "null"})
    assert tree_nodes(df).count() == 0


def test_references_and_provisions(spark):
    rel = {"mengubah": [("A", None), None, ("B", "#")], "mencabut": None, "merujuk": []}
    uji = [None, ("1/X", None, None, ["p", None, "q"], None, None, None, None, None, None), ("2/X", None, None, None, None, None, None, None, None, None)]
    df = rows(spark, {"rel": rel, "uji": uji}, {"rel": None, "uji": None}, {"rel": {}, "uji": []})
    assert keys(map_items(df)) == [(0, "mengubah", "mengubah.0"), (0, "mengubah", "mengubah.2")]
    assert keys(nested_items(df)) == [(0, "1", "1.0"), (0, "1", "1.2")]
    assert sorted(r["decision_key"] for r in decisions(df).collect()) == ["1", "2"]
    assert child_links(df).count() == 4


def test_repeated_rows_and_empty_table(spark):
    df = rows(spark, {"tree": '{"children": [{}, {}]}'})
    assert child_links(df.union(df)).count() == 4
    assert child_links(df.where("false")).count() == 0

"""Command line: ``python -m statuta COMMAND``.

init, reset, status   the engine's tables below --root
index PATH            document JSON files into those tables
ingest TEXTS JSONS    text files joined to their JSON by name, cleaned, parsed and indexed
search QUERY          over a folder of tables (--tables) with --strategy, --limit and filters
outline DOC_ID, related UNIT_ID, benchmark
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import functions as F

from statuta.config import timed
from statuta.operators import indexing, service
from statuta.operators.filters import Filters
from statuta.operators.index import index_of
from statuta.session import local_session
from statuta.sources import readers, tables

# The queries of the benchmark command.
BENCHMARK = ("izin usaha", "pasal 1", "laporan berkala", "sanksi administratif", "pasal 2 ayat (1)", "retribusi daerah", "lingkungan hidup", "ketentuan umum")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="statuta", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--cpus", default="*")
    p.add_argument("--root", default="statuta-tables", help="folder of the engine's own tables")
    p.add_argument("--tables", default=".", help="folder of the searched tables")
    commands = p.add_subparsers(dest="command", required=True)
    for name in ("init", "reset", "status", "benchmark"):
        commands.add_parser(name)
    one = commands.add_parser("index")
    one.add_argument("path")
    one.add_argument("--pattern", default="*.json")
    one = commands.add_parser("ingest")
    one.add_argument("texts")
    one.add_argument("jsons")
    one = commands.add_parser("search")
    one.add_argument("query")
    one.add_argument("--strategy", default="auto", choices=service.STRATEGIES)
    one.add_argument("--limit", type=int, default=10)
    one.add_argument("--rerank", action="store_true")
    for name in ("form", "year", "number", "status"):
        one.add_argument(f"--{name}", help="comma-separated values")
    one = commands.add_parser("outline")
    one.add_argument("doc_id")
    one.add_argument("--tree", action="store_true", help="in the order of the text")
    one = commands.add_parser("related")
    one.add_argument("unit_id")
    return p


def run(arguments: list[str] | None = None, spark=None) -> list[dict]:
    """Runs a command and returns the rows it prints."""
    a = _parser().parse_args(arguments)
    spark = spark or local_session(a.cpus)
    with timed(a.command) as record:
        rows = _COMMANDS[a.command](spark, a)
        record["n_results"] = len(rows)
    return rows


def _dicts(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _index(spark, a) -> list[dict]:
    return _dicts(tables.index_documents(spark, a.root, readers.json_documents(spark, a.path, a.pattern)))


def _ingest(spark, a) -> list[dict]:
    both = readers.with_texts(readers.json_documents(spark, a.jsons), readers.text_files(spark, a.texts))
    clean = indexing.processed_texts(both, "doc_id", "doc_content").select("doc_id", F.col("doc_content").alias("_text"), F.col("doc_processing_status").alias("_state"))
    done = both.drop("doc_processing_status", "doc_content").join(clean, "doc_id").withColumnRenamed("_text", "doc_content").withColumnRenamed("_state", "doc_processing_status")
    return _dicts(tables.index_documents(spark, a.root, done))


def _search(spark, a) -> list[dict]:
    filters = Filters.from_text(doc_form=a.form, doc_year=a.year, doc_number=a.number, doc_status=a.status)
    found = service.SearchService(index_of(spark, a.tables)).search(a.query, limit=a.limit, filters=filters, strategy=a.strategy, rerank=a.rerank)
    return _dicts(found.withColumn("preview", service.preview(F.col("text"))).drop("text"))


def _benchmark(spark, a) -> list[dict]:
    searcher, log = service.SearchService(index_of(spark, a.tables)), []
    for q in BENCHMARK:
        began = time.perf_counter()
        n = searcher.search(q, limit=10).count()
        log.append(service.log_row(spark, q, service.strategy_label(q), 10, (time.perf_counter() - began) * 1_000, n))
    out = log[0]
    for row in log[1:]:
        out = out.unionByName(row)
    return _dicts(service.benchmark_summary(out))


_COMMANDS = {
    "init": lambda spark, a: [{"table_name": n} for n in tables.create(spark, a.root)],
    "reset": lambda spark, a: [{"table_name": n} for n in tables.reset(spark, a.root)],
    "status": lambda spark, a: _dicts(tables.status(spark, a.root)),
    "index": _index,
    "ingest": _ingest,
    "search": _search,
    "outline": lambda spark, a: _dicts(service.SearchService(index_of(spark, a.tables)).outline(a.doc_id, tree_order=a.tree)),
    "related": lambda spark, a: _dicts(service.SearchService(index_of(spark, a.tables)).related(a.unit_id)),
    "benchmark": _benchmark,
}


def main() -> None:
    for row in run():
        print(*[f"{k}: {v}" for k, v in row.items()], sep="\n", end="\n\n")


if __name__ == "__main__":
    sys.exit(main())

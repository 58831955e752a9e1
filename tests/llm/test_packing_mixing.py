"""Containers and mixes: nothing lost, nothing over, shares reached."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from statuta.llm.mixing import exponential_key, mix, mix_report
from statuta.llm.packing import BestFit, pack, pack_report
from statuta.llm.tokens import VOCABULARY, encoding, n_tokens


def test_best_fit_equals_a_plain_search():
    rng = random.Random(1)
    fit, open_bins, made = BestFit(100, 8), {}, 0
    for _ in range(3_000):
        size = rng.randint(1, 100)
        fits = [f for f in open_bins.values() if f >= size]
        got = fit.place(size)
        if fits:
            assert open_bins[got] == min(fits)
        else:
            if len(open_bins) >= 8:
                del open_bins[next(k for k, f in open_bins.items() if f == min(open_bins.values()) and k not in [x for v in fit.by_free.values() for x in v])]
            assert got == made
            open_bins[got], made = 100, made + 1
        open_bins[got] -= size
        if not open_bins[got]:
            del open_bins[got]
        assert len(open_bins) <= 8 and sorted(open_bins.values()) == sorted(f for f, v in fit.by_free.items() for _ in v)
    with pytest.raises(ValueError, match="positive"):
        BestFit(0)


def test_pack(spark):
    sizes = [0, None, 5, 100, 101, 350, 99, 1, 60, 60, 40] * 40
    df = spark.createDataFrame([(i, n, "clash", "x") for i, n in enumerate(sizes)], "doc_id bigint, size int, container string, part string")
    got = pack(df, size="size", capacity=100, most_open=4)
    back = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert back == {i: n or 0 for i, n in enumerate(sizes)}
    assert got.where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.max("n")).first()[0] <= 100
    assert got.where("part > 0").select("doc_id").distinct().count() == sum((n or 0) > 100 for n in sizes)
    report = pack_report(got, 100).first()
    assert report["n_empty"] == 80 and report["used_share"] > 0.8
    assert pack(df.where("false"), size="size").count() == 0


def test_token_counts(spark):
    texts = ["Pasal 1 ayat (2).", "", None, "kata " * 20_000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in df.orderBy("i").select(n_tokens(F.col("t")).alias("n")).collect()]
    enc = encoding(VOCABULARY)
    assert got == [len(enc.encode_ordinary(t)) if t else 0 for t in texts] and all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)


def docs(spark, counts):
    rows = [(f"{s}{i}", f"Pemohon wajib menyampaikan laporan nomor {i}. " * (1 + i % 5), s, 1.0) for s, n in counts.items() for i in range(n)]
    return spark.createDataFrame([*rows, ("z1", None, "a", 1.0), ("z2", "", "a", 1.0), ("z3", "teks", None, 1.0), ("z4", "teks", "unknown", 1.0)], "doc_id string, text string, source string, n_tokens double")


def test_mix(spark):
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 4), ("c", 0.1, 2), ("absent", 0.2, 9)], "source string, target_share double, max_repeats int")
    table = docs(spark, {"a": 400, "b": 60, "c": 200})
    out = mix(table, targets)
    report = {r["source"]: r for r in mix_report(out, targets).collect()}
    for s, share in (("a", 0.6), ("b", 0.3), ("c", 0.1)):
        assert abs(report[s]["reached_share"] - share) < 0.01 and report[s]["most_copies"] <= report[s]["max_repeats"]
    assert report["absent"]["tokens"] == 0 and out.where("doc_id like 'z%'").count() == 0
    # complete epochs before any fraction: copies of one source differ by at most one
    spread = out.where("source = 'b'").agg(F.max("copies") - F.min("copies"), F.count("*")).first()
    assert spread[0] <= 1 and spread[1] == 60
    assert sorted(out.collect()) == sorted(mix(table, targets).collect())
    large = {r["source"]: r for r in mix_report(mix(table, targets, total_tokens=10**7), targets).collect()}
    assert [large[s]["most_copies"] for s in "abc"] == [1, 4, 2]
    assert mix(table.where("false"), targets).count() == 0 and mix(table, targets.where("false")).count() == 0


def test_heavier_weights_come_first(spark):
    keys = spark.range(20_000).select(exponential_key(F.col("id"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0), 1).alias("k"), (F.col("id") % 2 == 0).alias("heavy"))
    first = keys.orderBy("k").limit(2_000)
    share = first.agg(F.avg(F.col("heavy").cast("int"))).first()[0]
    assert 0.75 < share < 0.85  # four to one


def test_buckets_are_even_for_any_weights(spark):
    """No bucket holds much more than its part of a source, be its texts of weight 1, 0.05 or both."""
    for weights in ((1.0,), (0.05,), (0.05, 1.0)):
        rows = spark.range(40_000).select(F.col("id").alias("_k"), F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("id"), F.lit(len(weights))).cast("int") + 1).alias("_w"))
        scaled = exponential_key(F.col("_k"), F.col("_w"), 17) * F.lit(sum(weights) / len(weights))
        most = rows.groupBy(F.floor(scaled / (1 + scaled) * 64).alias("b")).count().agg(F.max("count")).first()[0]
        assert most <= 40_000 / 64 * 4

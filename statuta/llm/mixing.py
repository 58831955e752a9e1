"""Mixing sources to target shares of all tokens, by weighted sampling without replacement.

Every text draws an exponential key scaled by its quality weight (Efraimidis and Spirakis: the k smallest
keys are a weighted sample of k). Within a source, texts are taken in key order up to the source's token
budget; a budget beyond the source's size is first met by complete epochs. The running sum of a source
is taken in two steps, over key buckets and inside the one bucket that the budget ends in, so no task
sorts a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuta.llm.tokens import VOCABULARY, n_tokens
from statuta.session import checkpoint

#: Key buckets of a source; at most so many sums per source are broadcast, whatever the number of texts.
BUCKETS = 1_024
#: Most target sources for which budgets and bucket sums are broadcast; those of more are joined by shuffle.
MAX_SOURCES = 500


def quality_weight(text: Column) -> Column:
    """A weight from 0.05 to 1: the share of letters and spaces, less for very short texts."""
    length = F.length(text)
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\s.,;()]", "")) / F.greatest(length, F.lit(1))
    size = F.least(F.lit(1.0), F.log1p(length) / F.log1p(F.lit(1000.0)))
    return F.greatest(F.lit(0.05), F.coalesce(plain * plain * size, F.lit(0.05)))


def exponential_key(key: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u uniform from a hash of the key, so that a rerun draws the same."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11)
    u = (bits + 0.5) / F.lit(float(1 << 53))
    return -F.log(u) / weight


def budgets(totals: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """Per target source: share, size, max_repeats, budget, complete epochs and the rest to be sampled.

    Without ``total_tokens`` the mix is as large as it can be with every source that has texts at its
    share within its repeats. Shares are taken over the sources that have texts; a source whose budget
    exceeds what its repeats allow gives all it may.
    """
    plan = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats")).join(totals, "source", "left").fillna(0, ["source_tokens", "source_docs"])
    live = F.when((F.col("source_tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.col("target_share"))
    whole = Window.partitionBy(F.lit(0))
    plan = plan.withColumn("live_share", F.coalesce(live / F.sum(live).over(whole), F.lit(0.0)))
    cap = F.col("source_tokens") * F.col("max_repeats")
    size = F.lit(float(total_tokens)) if total_tokens is not None else F.coalesce(F.min(F.when(F.col("live_share") > 0, cap / F.col("live_share"))).over(whole), F.lit(0.0))
    plan = plan.withColumn("budget", F.least(F.col("live_share") * size, cap.cast("double")))
    # a budget a hair under a whole number of epochs is that number of epochs
    epochs = F.when(F.col("source_tokens") > 0, F.floor(F.col("budget") / F.col("source_tokens") + F.lit(1e-9))).otherwise(F.lit(0))
    return plan.withColumn("epochs", F.least(epochs, F.col("max_repeats")).cast("int")).withColumn(
        "rest", F.when(F.col("epochs") < F.col("max_repeats"), F.greatest(F.col("budget") - F.col("epochs") * F.col("source_tokens"), F.lit(0.0))).otherwise(F.lit(0.0))
    )


def mix(
    docs: DataFrame,
    targets: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    total_tokens: int | None = None,
    seed: int = 17,
    vocabulary: str = VOCABULARY,
    buckets: int = BUCKETS,
) -> DataFrame:
    """The texts of the mix: key, source, n_tokens, copies (how many times the text is used).

    ``targets`` has source, target_share and max_repeats. Texts of sources without a target, with a null
    source or without tokens are not used; repeated texts are texts of their own. The last text of a
    source is taken if at least half of it is within the budget, so a source misses its budget by at
    most half a text.
    """
    sized = docs.select(F.col(key).alias("_k"), F.col(source).alias("source"), n_tokens(F.col(text), vocabulary).alias("n_tokens"), quality_weight(F.col(text)).alias("_w"))
    # read several times below: one pass of the tokenizer, kept in the shared folder
    sized = checkpoint(sized.where("source is not null and n_tokens > 0").withColumn("_key", exponential_key(F.col("_k"), F.col("_w"), seed)))
    plan = plan_of(sized, targets, total_tokens)
    few = targets.select("source").distinct().limit(MAX_SOURCES + 1).count() <= MAX_SOURCES

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    # keys of weight w lie around 1 / w; scaled by the source's mean weight, this map spreads them evenly and,
    # with its long tail, keeps light texts of a source of heavy ones out of one last bucket
    scaled = F.col("_key") * F.col("mean_weight")
    placed = sized.drop("_w").join(side(plan), "source").withColumn("_bucket", F.floor(scaled / (1 + scaled) * buckets).cast("int"))
    sums = placed.where("rest > 0").groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_sum"))
    order = Window.partitionBy("source").orderBy("_bucket")
    # rows per source are at most the number of buckets
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.join(side(sums), ["source", "_bucket"], "left")
    full = placed.where((F.col("rest") > 0) & (F.col("_before") + F.col("_sum") <= F.col("rest"))).withColumn("_more", F.lit(1))
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", "_k").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.where((F.col("rest") > 0) & (F.col("_before") <= F.col("rest")) & (F.col("_before") + F.col("_sum") > F.col("rest")))
    edge = edge.withColumn("_ahead", F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).withColumn("_more", (F.col("_ahead") + F.col("n_tokens") / 2 <= F.col("rest")).cast("int")).drop("_ahead")
    none = placed.where((F.col("rest") <= 0) | (F.col("_before") > F.col("rest"))).withColumn("_more", F.lit(0))
    out = full.unionByName(edge).unionByName(none)
    return out.select(F.col("_k").alias(key), "source", "n_tokens", (F.col("epochs") + F.col("_more")).cast("int").alias("copies")).where("copies > 0")


def plan_of(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """The budgets of all target sources."""
    known = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("source_docs"), F.avg("_w").alias("mean_weight"))
    return budgets(totals, known, total_tokens).fillna(1.0, ["mean_weight"])


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: wanted share, reached share, tokens, texts and most repeats."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens").cast("bigint") * F.col("copies")).alias("tokens"), F.count("*").alias("n_texts"), F.max("copies").alias("most_copies"))
    rows = targets.select("source", "target_share", "max_repeats").join(used, "source", "left").fillna(0, ["tokens", "n_texts", "most_copies"])
    return rows.withColumn("reached_share", F.coalesce(F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(0))), 6), F.lit(0.0)))

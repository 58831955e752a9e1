"""References to records that do not exist, no longer exist or came later.

Each reference is read into the keys its target may have: the number of a details page, a code
(form-year-number), a title. A Bloom filter of all parent keys, bounded in size and broadcast, proves most
missing targets at once; only references with a key that the filter lets pass go to the exact join.
References are first reduced to their distinct targets, so a target that a third of the rows share is
resolved once. Targets that no whole title answers are then looked for by near keys (a title cut short, a
title with one word that no title has); a Bloom filter of those few keys keeps all other parent keys
from being shuffled. Keys are hashes of 64 bits, and every pair they join is compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.citation import parse_references
from statuta.operators.bloom import BloomFilter
from statuta.operators.spelling import correct_words
from statuta.session import checkpoint


def details_number(link: Column) -> Column:
    """The number after ``Details/`` in a link, without leading zeros; null where there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(F.trim(link)), r"details/(\d+)", 1), r"^0+(?=\d)", ""), F.lit(""))


def _hashed(kind: str, value: Column) -> Column:
    return F.xxhash64(F.lit(kind), value)


def _bag(words: Column) -> Column:
    """Hash of the words of a title in any order; a word taken away is that word's hash taken away."""
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda total, w: total.bitwiseXOR(F.xxhash64(w)))


def _glue(words: Column) -> Column:
    return F.regexp_replace(F.array_join(words, ""), r"\.", "")


#: Lengths, in characters, at which the beginning of a title is a key.
CUTS = (8, 12, 16, 24, 32, 40, 48, 64, 80, 96, 128)


def _documents(legal: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per document and title: doc_id, place, alive, first_in, number, words."""
    rows = legal.where("doc_id is not null").select("doc_id", "doc_title", "deleted_at", "ingested_at", details_number(F.col("detail_url")).alias("number"))
    # the state of a document is that of all its rows; its titles and page numbers are kept one by one
    state = rows.groupBy("doc_id").agg(
        F.max(F.col("deleted_at").isNull()).alias("alive"),
        F.min("ingested_at").alias("first_in"),
    )
    names = rows.select("doc_id", "doc_title", "number").distinct()
    own = names.join(state, "doc_id").select("doc_id", F.lit("legal_documents").alias("place"), "alive", "first_in", "number", "doc_title")
    listed = catalog.where("doc_id is not null").select(
        "doc_id",
        F.lit("regulation_catalog").alias("place"),
        F.col("withdrawn_at").isNull().alias("alive"),
        F.lit(None).cast(legal.schema["ingested_at"].dataType).alias("first_in"),
        F.lit(None).cast("string").alias("number"),
        "doc_title",
    )
    both = own.unionByName(listed)
    return both.withColumn("words", parse_references(F.col("doc_title"))["title"]).drop("doc_title")


_PARENT = ("doc_id", "place", "alive", "first_in", "words")


def _parent_keys(docs: DataFrame) -> DataFrame:
    """Keys that name a document as a whole: details number, code, title in any word order, title without blanks."""
    words = F.col("words")
    many = F.size(words) > 0
    keys = F.array(
        F.when(F.col("number").isNotNull(), _hashed("D", F.col("number"))),
        _hashed("C", F.upper("doc_id")),
        F.when(many, _hashed("T", _bag(words))),
        F.when(many, _hashed("G", _glue(words))),
    )
    return docs.select(F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).alias("key"), *_PARENT, "number")


def _near_parent_keys(docs: DataFrame) -> DataFrame:
    """Keys that name a title by its beginning, or by all of its words but one (``missing``)."""
    words = F.col("words")
    titled = docs.where(F.size("words") > 2).select(*_PARENT).distinct().withColumn("_t", F.array_join(words, " ")).withColumn("_h", _bag(words))
    starts = F.array(*[F.when(F.length("_t") >= n, F.struct(_hashed(f"P{n}", F.substring("_t", 1, n)).alias("key"), F.lit(None).cast("string").alias("missing"))) for n in CUTS])
    partly = F.transform(F.array_distinct(words), lambda w: F.struct(_hashed("L", F.col("_h").bitwiseXOR(F.xxhash64(w))).alias("key"), w.alias("missing")))
    return titled.select(F.explode(F.filter(F.concat(starts, partly), lambda k: k.isNotNull())).alias("k"), *_PARENT).select("k.*", *_PARENT)


def _correct(targets: DataFrame, docs: DataFrame) -> DataFrame:
    """``targets`` with the words of their titles corrected against the titles of the documents.

    ``typed`` keeps the words as typed, ``odd`` those that no title has.
    """
    lexicon = checkpoint(docs.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    whole = F.when(F.col("truncated"), F.slice("title", 1, F.greatest(F.size("title") - 1, F.lit(0)))).otherwise(F.col("title"))
    typed = targets.where("size(title) > 0 and not glued").select("target", F.explode(F.array_distinct(whole)).alias("word"))
    odd = checkpoint(typed.select("word").distinct().join(lexicon.select("word"), "word", "left_anti"))
    fixes = odd.join(correct_words(odd, lexicon), "word", "left").select("word", "correction")
    per_target = typed.join(fixes, "word").groupBy("target").agg(F.collect_list(F.struct("word", "correction")).alias("fixes"))
    fix = F.map_from_entries("fixes")
    return (
        targets.join(per_target, "target", "left")
        .withColumn("odd", F.coalesce(F.transform("fixes", lambda f: f["word"]), F.array().cast("array<string>")))
        .withColumn("typed", F.col("title"))
        .withColumn("title", F.transform("title", lambda w: F.coalesce(fix[w], w)))
        .drop("fixes")
    )


_KEPT = ("target", "title", "typed", "code", "form", "number", "year", "number_link")


def _exploded(targets: DataFrame, keys: Column) -> DataFrame:
    return targets.select(*_KEPT, F.explode(F.filter(keys, lambda k: k["key"].isNotNull())).alias("k")).select(*_KEPT, "k.*")


def _target_keys(targets: DataFrame) -> DataFrame:
    title = F.col("title")
    given = F.size(title) > 0
    return _exploded(targets, F.array(
        F.struct(F.when(F.col("number_link").isNotNull(), _hashed("D", F.col("number_link"))).alias("key"), F.lit(0).alias("rank")),
        F.struct(F.when(given & ~F.col("truncated"), _hashed("T", _bag(title))).alias("key"), F.lit(1).alias("rank")),
        F.struct(F.when(given & F.col("glued"), _hashed("G", _glue(title))).alias("key"), F.lit(2).alias("rank")),
        F.struct(F.when(F.col("code").isNotNull(), _hashed("C", F.upper("code"))).alias("key"), F.lit(4).alias("rank")),
    ))


def _begins() -> Column:
    """The title as far as it goes: its last word, which may be cut short, as typed."""
    last = F.try_element_at("typed", F.lit(-1))
    return F.rtrim(F.array_join(F.concat(F.slice("title", 1, F.greatest(F.size("title") - 1, F.lit(0))), F.array(last)), " "), F.lit("."))


def _near_target_keys(targets: DataFrame) -> DataFrame:
    """The longest beginning that is a key; and, for each word that no title has, all the others."""
    title, cut = F.col("title"), F.size("title") > 2
    begins = _begins()
    start = F.coalesce(*[F.when(cut & ~F.col("glued") & (F.length(begins) >= n), _hashed(f"P{n}", F.substring(begins, 1, n))) for n in reversed(CUTS)])
    bag = _bag(title)
    slots = F.transform(
        F.filter(F.arrays_zip(F.col("typed").alias("w"), title.alias("c")), lambda p: F.array_contains("odd", p["w"])),
        lambda p: F.struct(F.when(cut, _hashed("L", bag.bitwiseXOR(F.xxhash64(p["c"])))).alias("key"), F.lit(2).alias("rank"), p["w"].alias("lost")),
    )
    whole = F.array(F.struct(start.alias("key"), F.lit(3).alias("rank"), F.lit(None).cast("string").alias("lost")))
    return _exploded(targets, F.concat(whole, slots))


def _same_words(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def resolve_targets(refs: DataFrame, legal: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each distinct target of ``refs`` with the document it means.

    Columns: target (the details number, or the text where there is none), names (whether it names a
    regulation), doc (null, or a struct of doc_id, place, alive, first_in) and proven_absent (the filter of
    parent keys ruled every key of the target out, and no near key is any parent's).
    """
    linked = refs.where("number_link is not null").select(F.concat(F.lit("D:"), "number_link").alias("target"), "number_link").distinct()
    texts = refs.where("number_link is null and text is not null").select(F.concat(F.lit("X:"), "text").alias("target"), "text").distinct()
    parsed = texts.withColumn("r", parse_references(F.col("text"))).select("target", F.lit(None).cast("string").alias("number_link"), "r.*")
    empty = {"names": "true", "form": "cast(null as string)", "number": "cast(null as string)", "year": "cast(null as int)", "code": "cast(null as string)", "title": "cast(array() as array<string>)", "truncated": "false", "glued": "false", "amends": "false", "foreign_form": "false"}
    targets = linked.selectExpr("target", "number_link", *[f"{v} as {k}" for k, v in empty.items()]).unionByName(parsed)
    # parsed and corrected once each, in the shared folder: both are read several times below
    docs = checkpoint(_documents(legal, catalog))
    targets = checkpoint(_correct(checkpoint(targets), docs))
    named = targets.where("names")
    parents = _parent_keys(docs)
    keys = BloomFilter(parents.select("key")).probe(_target_keys(named))
    words, title, rank = F.col("words"), F.col("title"), F.col("rank")
    same = (
        F.when(rank == 0, F.col("number_link") == F.col("p_number"))
        .when(rank == 1, _same_words(words, title))
        .when(rank == 2, _glue(words) == _glue(title))
        .otherwise(F.upper("doc_id") == F.upper("code"))
    )
    maybe = checkpoint(keys.where("maybe").drop("maybe").join(parents.withColumnRenamed("number", "p_number"), "key").where(same).drop("p_number", "key"))
    answered = maybe.where("rank < 3").select("target").distinct()
    left = named.where("size(title) > 2").join(answered, "target", "left_anti")
    wanted = checkpoint(_near_target_keys(left))
    offered = BloomFilter(wanted.select("key").distinct()).probe(_near_parent_keys(docs)).where("maybe").drop("maybe")
    stem = F.rtrim(F.col("lost"), F.lit("."))
    gap = F.when(F.array_sort(F.split(stem, "")) == F.array_sort(F.split("missing", "")), 1).otherwise(F.levenshtein(stem, F.col("missing")))
    fits = F.when(rank == 2, (gap <= 3) & (gap * 2 <= F.length("missing")) & (F.size("words") == F.size("title"))).otherwise(F.col("missing").isNull() & (F.size("words") >= F.size("title")) & F.array_join(words, " ").startswith(_begins()))
    near = wanted.join(offered, "key").where(fits).withColumn("gap", F.coalesce(gap, F.lit(0))).drop("key", "missing", "lost")
    parts = F.split("doc_id", "-")
    agree = (F.coalesce(F.get(parts, F.lit(0)) == F.col("form"), F.lit(False))).cast("int") + F.coalesce(F.get(parts, F.lit(1)) == F.col("year").cast("string"), F.lit(False)).cast("int") + F.coalesce(F.get(parts, F.lit(2)) == F.col("number"), F.lit(False)).cast("int")
    order = F.struct(
        F.when((rank < 3) & (F.col("gap") == 0), 0).otherwise(rank).alias("rank"),
        "gap",
        (-agree).alias("agree"),
        (words != title).alias("order"),
        (~F.col("alive")).alias("gone"),
        F.col("doc_id"),
    )
    both = maybe.withColumn("gap", F.lit(0)).unionByName(near)
    best = both.groupBy("target").agg(F.min_by(F.struct("doc_id", "place", "alive", "first_in"), order).alias("doc"))
    passed = keys.groupBy("target").agg((~F.max("maybe")).alias("proven_absent"))
    out = targets.select("target", "names").join(best, "target", "left").join(passed, "target", "left")
    return out.withColumn("proven_absent", F.coalesce("proven_absent", F.lit(False)) & F.col("doc").isNull())


def orphan_references(
    refs: DataFrame,
    legal: DataFrame,
    catalog: DataFrame,
    *,
    key: str = "ref_id",
    text: str = "regulation_reference",
    link: str = "reference_link",
    period: str = "recorded_at",
) -> DataFrame:
    """The rows of ``refs`` whose target is missing, deleted, withdrawn or later than the reference.

    Columns: key, the period column, doc_id and target_table (null where no table has the target),
    reason (absent, deleted, withdrawn, late), proven_absent. A row whose link leads to no details page
    and whose text is null or names no regulation is no orphan; a repeated row is judged like its twin;
    a null period is never earlier than an arrival; empty parent tables make every named target absent.
    """
    rows = refs.select(F.col(key).alias("_k"), F.col(text).alias("text"), F.col(period).alias("_p"), details_number(F.col(link)).alias("number_link"))
    named = rows.withColumn("target", F.coalesce(F.concat(F.lit("D:"), "number_link"), F.concat(F.lit("X:"), "text"))).where("target is not null")
    judged = named.select("_k", "_p", "target").join(resolve_targets(rows, legal, catalog), "target")
    reason = (
        F.when(F.col("doc").isNull(), "absent")
        .when(~F.col("doc.alive"), F.when(F.col("doc.place") == "legal_documents", "deleted").otherwise("withdrawn"))
        .when(F.col("doc.first_in") > F.col("_p"), "late")
    )
    return (
        judged.where("names")
        .withColumn("reason", reason)
        .where("reason is not null")
        .select(F.col("_k").alias(key), F.col("_p").alias(period), F.col("doc.doc_id").alias("doc_id"), F.col("doc.place").alias("target_table"), "reason", "proven_absent")
    )


def orphan_report(orphans: DataFrame, period: str = "recorded_at") -> DataFrame:
    """Orphans counted per target table, reason and month."""
    return orphans.groupBy(
        F.coalesce("target_table", F.lit("neither")).alias("target_table"), "reason", F.date_format(F.date_trunc("month", F.col(period)), "yyyy-MM").alias("month")
    ).agg(F.count("*").alias("n_orphans"), F.count_if(F.coalesce("proven_absent", F.lit(False))).alias("n_proven_by_filter"))

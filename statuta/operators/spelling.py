"""Word correction as joins: a symmetric-delete index that is a table, not a broadcast.

Both sides are distinct words, so the work grows with the vocabulary and not with the text; a word and
its correction share a string left by deleting up to two letters, and that string is the join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deletions(word: Column, most: int = 2) -> Column:
    """``word`` and every string left by deleting up to ``most`` (1 or 2) of its letters."""

    def once(w: Column) -> Column:
        return F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))

    one = once(word)
    out = F.concat(F.array(word), one)
    if most > 1:
        out = F.concat(out, F.flatten(F.transform(one, once)))
    return F.array_distinct(out)


def edits_allowed(word: Column) -> Column:
    return F.when(F.length(word) < 2, 0).when(F.length(word) < 6, 1).otherwise(2)


def slips(a: Column, b: Column) -> Column:
    """Edit distance in which two swapped letters (equal letters in another order) count as one edit."""
    plain = F.levenshtein(a, b)
    swapped = (plain == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return F.when(swapped, 1).otherwise(plain)


#: Most strings of the words to be corrected that are broadcast; more of them are joined by shuffle.
BROADCAST_KEYS = 200_000


def _keys(word: Column) -> Column:
    return F.when(F.length(word) < 6, deletions(word, 1)).otherwise(deletions(word, 2))


def _letters(word: Column, most: int) -> Column:
    """First letter of a word with every later one (``most`` 2), and with every two later ones in order (3)."""
    size = F.length(word)
    places = F.when(size > 1, F.sequence(F.lit(2), size)).otherwise(F.array().cast("array<int>"))
    first = F.substring(word, 1, 1)

    def at(i: Column) -> Column:
        return F.substring(word, i, F.lit(1))

    out = F.transform(places, lambda i: F.concat(first, at(i)))
    if most > 2:
        out = F.concat(out, F.flatten(F.transform(places, lambda i: F.transform(F.filter(places, lambda j: j > i), lambda j: F.concat(first, at(i), at(j))))))
    return F.array_distinct(out)


def _joined(asked: DataFrame, offered: DataFrame) -> DataFrame:
    """Join on d; the keys of the words to be corrected, mostly few, are broadcast below a counted size."""
    small = asked.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return offered.join(F.broadcast(asked) if small else asked, "d")


def correct_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, correction, distance) for each word of ``words`` that is near a word of ``lexicon``.

    ``words`` has column word, ``lexicon`` columns word and n; both hold distinct, non-null words. Words
    of the lexicon are not corrected; an abbreviation (trailing point) goes to the most frequent word that
    it begins, else to the most frequent one that starts like it and has its letters in order, found by
    the first letters it shares. Ties fall to the more frequent, then the smaller word. Words with no
    neighbour have no row.
    """
    odd = words.join(lexicon.select("word"), "word", "left_anti").select("word", F.rtrim(F.col("word"), F.lit(".")).alias("stem"), F.col("word").endswith(".").alias("short"))
    known = lexicon.select(F.col("word").alias("correction"), "n")
    near = (
        _joined(odd.where("not short").select("word", "stem", F.explode(_keys(F.col("stem"))).alias("d")), known.select("*", F.explode(_keys(F.col("correction"))).alias("d")))
        .select("word", "stem", "correction", "n")
        .withColumn("distance", slips(F.col("stem"), F.col("correction")))
        .where(F.col("distance") <= edits_allowed(F.col("stem")))
    )
    stems = odd.where(F.col("short") & (F.length("stem") >= 2))
    begun = _joined(stems.select("word", "stem", F.col("stem").alias("d")), known.where("length(correction) > 1").select("*", F.explode(F.expr("transform(sequence(1, length(correction) - 1), i -> substring(correction, 1, i))")).alias("d")))
    in_order = _joined(
        stems.select("word", "stem", F.substring("stem", 1, 3).alias("d")),
        known.select("*", F.explode(_letters(F.col("correction"), 3)).alias("d")),
    ).where((F.length("correction") > F.length("stem")) & F.expr("correction rlike concat('^', array_join(split(stem, ''), '.*'))"))
    ranked = near.select("word", "correction", "n", "distance").unionByName(begun.select("word", "correction", "n", F.lit(0).alias("distance"))).unionByName(in_order.select("word", "correction", "n", F.lit(1).alias("distance")))
    best = ranked.groupBy("word").agg(F.min_by(F.struct("correction", "distance"), F.struct("distance", -F.col("n"), "correction")).alias("b"))
    return best.select("word", "b.correction", "b.distance")

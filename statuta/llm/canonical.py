"""Mapping freely typed values to the entries of a reference list.

Method: symmetric-delete dictionary. The list (bounded, its bound is checked) is indexed once per
worker: words under all strings that deleting up to two letters leaves, entries under their words. A
typed value is read into form, number, year and title words; each word is looked up through its own
deletions, the survivors are ranked by a weighted Damerau-Levenshtein distance, entries by the sum over
their words and then by how often they are referred to. Values that mean no entry are reported.

Every answer carries its rank, a total order over all entries. A list too long for one broadcast is
cut into shards that share one vocabulary, and the best rank over all shards is the answer, so the number
of shards changes nothing.
"""

from __future__ import annotations

import bisect
import functools
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions.citation import Reference, parse_references, read_reference

UNMATCHED = "UNMATCHED"
#: Most entries of a reference list that are broadcast at once; a longer list is looked up in shards.
MAX_ENTRIES = 200_000
#: Most distinct words of a sharded list (its vocabulary is broadcast whole); more of them fail the query.
MAX_WORDS = 3_000_000
#: Most distinct values that meet a shard in one task.
BLOCK = 100_000
#: Edits up to which a title typed without blanks is looked for.
GLUED_EDITS = 3
#: Sum of word distances up to which a title counts as the entry's title, and its share of the words.
TITLE_COST, COST_PER_WORD = 2.6, 0.4
VOWELS = set("aeiou")


def weighted_distance(a: str, b: str, limit: float = 9.0) -> float:
    """Damerau-Levenshtein distance with the weights of typing slips.

    A swap of neighbours costs 0.6, a doubled or dropped double letter 0.5, one vowel for another 0.8,
    any other edit 1; an edit of the first letter costs 0.3 more.
    """
    if a == b:
        return 0.0
    n, m = len(a), len(b)
    rows = [[0.0] * (m + 1) for _ in range(n + 1)]
    for j in range(1, m + 1):
        rows[0][j] = rows[0][j - 1] + (1.3 if j == 1 else 1.0)
    for i in range(1, n + 1):
        rows[i][0] = rows[i - 1][0] + (1.3 if i == 1 else 1.0)
        x = a[i - 1]
        for j in range(1, m + 1):
            y = b[j - 1]
            first = 0.3 if i == 1 and j == 1 else 0.0
            sub = 0.0 if x == y else (0.8 if x in VOWELS and y in VOWELS else 1.0) + first
            delete = 0.5 if i > 1 and a[i - 2] == x else 1.0
            insert = 0.5 if j > 1 and b[j - 2] == y else 1.0
            d = min(rows[i - 1][j - 1] + sub, rows[i - 1][j] + delete, rows[i][j - 1] + insert)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                d = min(d, rows[i - 2][j - 2] + 0.6)
            rows[i][j] = d
        if min(rows[i]) > limit:
            return limit + 1
    return rows[n][m]


def deletions(word: str, most: int) -> set[str]:
    """``word`` and every string left by deleting up to ``most`` of its letters."""
    out, level = {word}, {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return out


def edits_allowed(word: str) -> int:
    return 0 if len(word) < 2 else 1 if len(word) < 6 else 2


class Dictionary:
    """The symmetric-delete index of reference entries (doc_id, title, frequency).

    ``vocabulary`` counts the words of the whole list where ``entries`` are only a shard of it.
    """

    def __init__(self, entries: list[tuple[str, str, int]], vocabulary: dict[str, int] | None = None) -> None:
        self.codes: dict[str, str] = {}
        self.frequency: dict[str, int] = {}
        self.titles: dict[str, list[str]] = {}
        self.by_words: dict[str, list[str]] = defaultdict(list)
        self.by_glue: dict[str, list[str]] = defaultdict(list)
        self.by_word: dict[str, set[str]] = defaultdict(set)
        self.words: Counter = Counter(vocabulary or {})
        for doc_id, title, frequency in entries:
            self.codes[doc_id.upper()] = doc_id
            self.frequency[doc_id] = frequency
            words = read_reference(title).title
            self.titles[doc_id] = words
            self.by_words[" ".join(sorted(words))].append(doc_id)
            self.by_glue["".join(words)].append(doc_id)
            if vocabulary is None:
                self.words.update(words)
            for w in words:
                self.by_word[w].add(doc_id)
        plain = [w for w in self.words if w and not w.startswith("#")]
        self.deletes: dict[str, list[str]] = defaultdict(list)
        for w in plain:
            for d in deletions(w, edits_allowed(w)):
                self.deletes[d].append(w)
        self.sorted = sorted(plain)
        self.by_letter: dict[tuple[str, str], set[str]] = defaultdict(set)
        for w in plain:
            for c in set(w[1:]):
                self.by_letter[w[0], c].add(w)
        self.segments: dict[tuple[int, int, str], list[str]] = defaultdict(list)
        for glue in self.by_glue:
            for i, (at, part) in enumerate(_parts(glue)):
                if part:
                    self.segments[len(glue), i, part].append(glue)
                del at
        self.spell = functools.lru_cache(200_000)(self._spell)

    def _spell(self, word: str) -> tuple[tuple[str, float], ...]:
        """All words of the list that ``word`` may stand for, with their cost, best first."""
        if word in self.words:
            return ((word, 0.0),)
        if word.startswith("#"):
            return ()
        if word.endswith("."):
            stem = word[:-1]
            if stem in self.words:
                return ((stem, 0.0),)
            full = self.expansions(stem)
            if full:
                return tuple((w, 0.1) for w in sorted(full, key=lambda w: (-self.words[w], w)))
            word = stem
        most = edits_allowed(word)
        found = {w for d in deletions(word, most) for w in self.deletes.get(d, ())}
        ranked = sorted((weighted_distance(word, w, most + 0.5), -self.words[w], w) for w in found)
        return tuple((w, c) for c, _, w in ranked if c <= most + 0.3)

    def expansions(self, stem: str) -> list[str]:
        """Words that begin with ``stem``; if there are none, words that start like it and have its letters in order."""
        if not stem:
            return []
        full, at = [], bisect.bisect_right(self.sorted, stem)
        while at < len(self.sorted) and self.sorted[at].startswith(stem):
            full.append(self.sorted[at])
            at += 1
        if full or len(stem) < 2:
            return full
        pools = sorted((self.by_letter.get((stem[0], c), set()) for c in set(stem[1:])), key=len)
        return [w for w in set.intersection(*pools) if len(w) > len(stem) and _within(stem, w)]

    def cost(self, words: list[tuple[str, tuple]], doc_id: str) -> float:
        """Distance of typed words (each with its readings) from the title of an entry, in any order."""
        left = Counter(self.titles[doc_id])
        total, odd = 0.0, []
        # words typed in full come first, so that no abbreviation takes theirs
        for typed, readings in sorted(words, key=lambda w: not w[1] or w[1][0][1] > 0.0):
            for w, c in readings:
                if left[w] > 0:
                    left[w] -= 1
                    total += c
                    break
            else:
                if readings and readings[0][1] == 0.0:
                    total += 1.5  # a good word that is not in this title is no slip for another
                else:
                    odd.append(typed)
        rest = list(left.elements())
        for typed in odd:
            c, w = min(((weighted_distance(typed, w, 2.6), w) for w in rest), default=(9.0, ""))
            if c <= 2.6 and c < max(len(typed), len(w)) * 0.6:
                rest.remove(w)
                total += c
            else:
                total += 1.5
        return total + 1.5 * len(rest)

    def by_title(self, ref: Reference, known: frozenset[str]) -> tuple[list[str], int, float]:
        """Entries whose title the words of ``ref`` give, all of equal cost; the stage that found them; that cost."""
        title = ref.title
        exact = self.by_words.get(" ".join(sorted(title)))
        if exact:
            return exact, 0, 0.0
        if ref.glued:
            glue = "".join(title).replace(".", "")
            if glue in self.by_glue:
                return self.by_glue[glue], 1, 0.0
            return self._glued(glue)
        words = self.readings(title, known)
        if all(r for _, r in words):
            plain = self.by_words.get(" ".join(sorted(r[0][0] for _, r in words)))
            if plain:
                return plain, 2, sum(r[0][1] for _, r in words)
        if ref.truncated:
            return self._truncated(title, words)
        ranked = sorted((round(self.cost(words, d), 6), d) for d in self._voted(title, words))
        if not ranked or ranked[0][0] > min(TITLE_COST, COST_PER_WORD * len(title)):
            # a value cut short without a mark
            return self._truncated(title, words) if title[-1] not in self.words and title[-1] not in known else ([], 9, 9.0)
        return [d for c, d in ranked if c == ranked[0][0]], 3, ranked[0][0]

    def _voted(self, title: list[str], words: list[tuple[str, tuple]]) -> list[str]:
        """Entries that lack at most two of the typed words (and have two at least).

        An entry with ``need`` of n words has one of any n - need + 1 of them, so only the rarest so
        many words are opened.
        """
        need = max(2, len(title) - 2)
        having = sorted(((set().union(*(self.by_word.get(w, ()) for w, _ in r)) if len(r) != 1 else self.by_word.get(r[0][0], set())) for _, r in words), key=len)
        pool = set().union(*having[: len(having) - need + 1]) if len(having) >= need else set()
        return [d for d in pool if sum(d in h for h in having) >= need]

    def _glued(self, glue: str) -> tuple[list[str], int, float]:
        """Entries whose title without blanks is within GLUED_EDITS edits (swaps included), through shared segments.

        An edit touches at most two of the 2 x GLUED_EDITS + 1 segments of a title, so one of them is left whole.
        """
        near = set()
        for size in range(len(glue) - GLUED_EDITS, len(glue) + GLUED_EDITS + 1):
            for i, (at, part) in enumerate(_parts("x" * max(size, 0))):
                for start in range(max(0, at - GLUED_EDITS), at + GLUED_EDITS + 1):
                    piece = glue[start : start + len(part)]
                    if part and len(piece) == len(part):
                        near.update(self.segments.get((size, i, piece), ()))
        costs = sorted((round(weighted_distance(glue, other, 3.0), 6), other) for other in near)
        if not costs or costs[0][0] >= 3.0:
            return [], 9, 9.0
        return [d for c, other in costs if c == costs[0][0] for d in self.by_glue[other]], 3, costs[0][0]

    def readings(self, title: list[str], known: frozenset[str]) -> list[tuple[str, tuple]]:
        return [(w, ((w, 0.0),) if w in known and w not in self.words else self.spell(w)) for w in title]

    def _truncated(self, title: list[str], words: list[tuple[str, tuple]]) -> tuple[list[str], int, float]:
        """Entries whose title begins with the typed words, the last of which may be cut short."""
        if len(title) < 3:
            return [], 9, 9.0
        pools = sorted(({d for w, _ in readings for d in self.by_word.get(w, ())} for _, readings in words[:-1]), key=len)
        last = title[-1].rstrip(".")
        out = []
        for d in set.intersection(*pools):
            full = self.titles[d]
            if len(full) < len(title):
                continue
            total = 0.0
            for (_, readings), w in zip(words[:-1], full, strict=False):
                c = next((c for r, c in readings if r == w), None)
                if c is None:
                    break
                total += c
            else:
                if full[len(title) - 1].startswith(last):
                    out.append((round(total, 6), d))
        out.sort()
        return ([d for c, d in out if c == out[0][0]], 4, out[0][0]) if out else ([], 9, 9.0)

    def answer(self, text: str | None, known: frozenset[str] = frozenset()) -> tuple:
        """(doc_id or UNMATCHED, how, cost, rank) of one typed value; the smallest rank of all shards is the answer.

        ``known`` holds words of the text that are good words elsewhere and so are never corrected. The
        rank is (stage, cost, disagreement in form, number and year, other word order, -frequency, doc_id).
        """
        ref = read_reference(text)
        if not ref.names:
            return _missed("names nothing")
        coded = self.codes.get(ref.code.upper()) if ref.code else None
        if not ref.title:
            return self._best([coded], ref, "code", 0, 0.0) if coded else _missed("code not in list")
        found, stage, cost = self.by_title(ref, known)
        if found:
            return self._best(found, ref, "title", stage, cost)
        if coded:
            miss = self.cost(self.readings(ref.title, known), coded)
            if miss <= 0.5 * max(len(ref.title), len(self.titles[coded])):
                return self._best([coded], ref, "code and similar title", 5, miss)
        return _missed("title not in list")

    def resolve(self, text: str | None, known: frozenset[str] = frozenset()) -> tuple[str, str, float]:
        """(doc_id or UNMATCHED, how it was found, cost) of one typed value."""
        return self.answer(text, known)[:3]

    def _best(self, found: list[str], ref: Reference, how: str, stage: int, cost: float) -> tuple:
        def rank(d: str) -> tuple:
            form, year, number = d.split("-")[0], d.split("-")[1] if d.count("-") >= 2 else "", d.rsplit("-", 1)[-1]
            agree = (form == ref.form) + (number == ref.number) + (year == str(ref.year))
            return stage, round(cost, 6), 3 - agree, int(self.titles[d] != ref.title), -self.frequency[d], d

        best = min(rank(d) for d in found)
        return best[-1], how, cost, best


def _missed(how: str) -> tuple:
    return UNMATCHED, how, 0.0, (9, 0.0, 0, 0, 0, UNMATCHED)


def _parts(text: str) -> list[tuple[int, str]]:
    """``text`` in 2 x GLUED_EDITS + 1 segments of nearly equal length, each with its start."""
    n = 2 * GLUED_EDITS + 1
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _within(short: str, long: str) -> bool:
    rest = iter(long)
    return all(c in rest for c in short)


def map_to_list(
    values: DataFrame,
    catalog: DataFrame,
    *,
    value_key: str = "ref_id",
    value: str = "regulation_reference",
    key: str = "doc_id",
    title: str = "doc_title",
    other_titles: DataFrame | None = None,
    max_entries: int = MAX_ENTRIES,
) -> DataFrame:
    """Each typed value with the entry of ``catalog`` that it means.

    Columns: value_key, doc_id (an entry or UNMATCHED), how, cost. One row for every row whose value is
    not null; repeated values get equal answers; blank and placeholder texts and texts of any length are
    UNMATCHED with how = "names nothing" unless they name an entry; an empty catalog leaves all
    UNMATCHED. Ties between entries fall to the one that agrees in form, number and year, then to the one
    in the same word order, then to the one referred to most often, then to the smaller key. Words that
    occur in ``other_titles`` (column ``title``) are good words, so they are never corrected into a word of
    the catalog. A list longer than ``max_entries`` is looked up in shards, with the same answers; a value
    that a third of the rows share is looked up once.
    """
    spark = values.sparkSession
    rows = values.where(F.col(value).isNotNull()).select(F.col(value_key).alias("k"), F.col(value).alias("v"))
    distinct = rows.groupBy("v").agg(F.count("*").alias("n"))
    code = F.upper(F.trim("v"))
    frequency = distinct.where(code.rlike(r"^[A-Z]+-\d{4}-\d+$")).groupBy(code.alias("k")).agg(F.sum("n").alias("n"))
    listed = catalog.select(F.col(key).alias("k"), F.col(title).alias("t")).where("k is not null and t is not null")
    n_listed = listed.count()
    words = F.array_distinct(F.regexp_extract_all(F.lower("v"), F.lit(r"[\p{L}\p{N}]+"), 0))
    if other_titles is not None:
        own = listed.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}]+"), 0))).alias("w")).distinct()
        good = other_titles.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(r"[\p{L}\p{N}]{4,}"), 0))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
        # the words of the list, which are most words, leave before anything is shuffled
        odd = distinct.select("v", F.explode(words).alias("w")).join(F.broadcast(own) if n_listed <= max_entries else own, "w", "left_anti")
        known = odd.join(good, "w", "left_semi").groupBy("v").agg(F.sort_array(F.collect_set("w")).alias("known"))
        distinct = distinct.select("v").join(known, "v", "left")
    else:
        distinct = distinct.select("v", F.lit(None).cast("array<string>").alias("known"))
    counted = listed.join(frequency, "k", "left").select("k", "t", F.coalesce("n", F.lit(0)).alias("n"))
    if n_listed <= max_entries:
        # a fixed number of parts: the size of the rows, which adaptive execution would go by, says little of the work
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        answers = _looked_up(distinct.repartition(parts, "v"), counted)
    else:
        answers = _looked_up_in_shards(distinct, counted, -(-5 * n_listed // (4 * max_entries)))  # a quarter of room for uneven shards
    return rows.join(answers, "v").select(F.col("k").alias(value_key), "doc_id", "how", "cost")


_ANSWER = "v string, doc_id string, how string, cost double"
_RANKED = _ANSWER + ", stage int, disagree int, reordered int, minus_n bigint"


def _answers(index: Dictionary, texts, knowns) -> Iterator[tuple]:
    for v, known in zip(texts, knowns, strict=True):
        yield v, *index.answer(v, frozenset(known) if known is not None else frozenset())


def _looked_up(distinct: DataFrame, counted: DataFrame) -> DataFrame:
    """(v, doc_id, how, cost) of distinct values, by one broadcast dictionary."""
    entries = sorted((r["k"], r["t"], int(r["n"])) for r in counted.collect())
    shared = distinct.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, entries))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, listed = shared.value
        index = _index(name, lambda: Dictionary(listed))
        for batch in batches:
            yield pd.DataFrame([a[:4] for a in _answers(index, batch["v"], batch["known"])], columns=["v", "doc_id", "how", "cost"])

    return distinct.mapInPandas(run, _ANSWER)


def _looked_up_in_shards(distinct: DataFrame, counted: DataFrame, n_shards: int) -> DataFrame:
    """As ``_looked_up`` for a list that is too long: shards of the list meet blocks of values on the executors."""
    spark = distinct.sparkSession
    vocabulary = counted.select(F.explode(parse_references(F.col("t"))["title"]).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    words = vocabulary.limit(MAX_WORDS + 1).collect()
    if len(words) > MAX_WORDS:
        raise ValueError(f"the reference list has more than {MAX_WORDS} distinct words")
    name = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast({r["w"]: r["n"] for r in words})
    n_blocks = max(1, -(-distinct.count() // BLOCK))
    shards = counted.select(F.pmod(F.xxhash64("k"), F.lit(n_shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "*")
    asked = distinct.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_shards - 1).cast("bigint"))).alias("shard"), F.pmod(F.xxhash64("v"), F.lit(n_blocks)).cast("int").alias("block"), "*")

    def run(key: tuple, values: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        def build() -> Dictionary:
            return Dictionary(sorted(zip(entries["k"], entries["t"], entries["n"].astype(int), strict=True)), shared.value)

        index = _index(f"{name} {key[0]}", build)
        rows = [(v, d, how, c, rank[0], rank[2], rank[3], rank[4]) for v, d, how, c, rank in _answers(index, values["v"], values["known"])]
        return pd.DataFrame(rows, columns=["v", "doc_id", "how", "cost", "stage", "disagree", "reordered", "minus_n"])

    every = asked.groupBy("shard", "block").cogroup(shards.groupBy("shard", "block")).applyInPandas(run, _RANKED)
    order = F.struct("stage", F.round("cost", 6).alias("cost"), "disagree", "reordered", "minus_n", "doc_id")
    return every.groupBy("v").agg(F.min_by(F.struct("doc_id", "how", "cost"), order).alias("b")).select("v", "b.*")


_INDEXES: dict = {}


def _index(name: str, build) -> Dictionary:
    """The dictionary called ``name`` in this worker process, built once; the name is unique to a list (and shard)."""
    if name not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[name] = build()
    return _INDEXES[name]


def match_report(mapped: DataFrame) -> DataFrame:
    """Counts of matched and unmatched values by how they were decided."""
    return mapped.groupBy(F.when(F.col("doc_id") == UNMATCHED, F.lit("unmatched")).otherwise("matched").alias("outcome"), "how").agg(F.count("*").alias("n"), F.avg("cost").alias("mean_cost"))

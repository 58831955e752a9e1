"""Template residue, filler, error pages and script notices in place of content.

Cells are cut into segments (lines and sentences). Response statuses, phrases, filler and placeholder
notations label all segments of the table weakly; an L2-regularised logistic regression on hashed word
n-grams, length and title features learns from all of them and scores every one. Equal segments are
labelled, learned from and scored once, with their number as weight. The patterns are no features: they
only label, and a last exact check of the few segments of high score spares rules that speak of such
messages, editorial brackets, formulas and blanks in forms for the public. A cell with a residual segment
is residue.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.operators.bloom import BloomFilter
from statuta.session import checkpoint

#: Hashed dimensions; regularisation; threshold.
DIMENSIONS, REGULARISATION, THRESHOLD = 1 << 14, 1e-4, 0.5
#: Fitting ends when a round gains less than this share of the loss, or after so many rounds.
TOLERANCE, ROUNDS = 1e-4, 100
#: Weight of a segment that no pattern judges: content, more often than not.
UNJUDGED = 0.02

# Names of fields in templates.
FIELDS = (
    r"(?i:judul|nomor|tahun|tentang|tempat|tanggal|bulan|wilayah|daerah|instansi|bentuk|jenis|isi|konten|nama(?:_\w+)?|jabatan|perihal|subjek"
    r"|title|number|year|date|subject|name|content|body|text|place|field|value|doc(?:\.\w+)?|regulation(?:\.\w+)?|[a-z]+_[a-z_]+|[a-z]+\.[a-z.]+)"
)
# Notations of unfilled placeholders.
PLACEHOLDERS = (
    rf"\{{\{{[^{{}}]*\}}\}}|\$\{{[^{{}}]*\}}|<%=?[^%]*%>|\[\[[^\[\]]+\]\]|«[^«»]*»|@@[^@\s]+@@|%{FIELDS}%|#{FIELDS}#|__{FIELDS}__"
    rf"|\{{{FIELDS}\}}|<{FIELDS}>|\[{FIELDS}\]|\b20XX\b|\bX{{4,}}\b|\bNomor XX\b|\((?:isi|tuliskan|ketik|masukkan)\b[^)]*\)"
    r"|\b(?:Nomor|No\.|Tahun|Thn|tentang|ttg)\s*(?:\.{2,}|…+|_{2,}|null\b|undefined\b|NaN\b)|\bTahun 20(?:\.\.|__)|^undefined\b"
)
# Response statuses and server messages.
STATUSES = (
    r"(?i)\b[45]\d\d\b\s*[-:]?\s*(?:-|not found|forbidden|bad gateway|gateway time-?out|service unavailable|internal server error|unauthori[sz]ed|bad request|too many requests|berkas|halaman)"
    r"|\b(?:error|http|galat)\s+[45]\d\d\b|\"status\":\s*[45]\d\d|<html\b|\btimed out after\b|\bfatal error\b|^warning: |\bjust a moment\b|page you requested"
)
# Messages to a visitor and notices about scripts.
PHRASES = (
    r"(?i)\b(?:terjadi (?:gangguan|masalah|kesalahan|galat) pada|gagal memuat|tidak dapat terhubung|(?:akses|permintaan|koneksi|token|sesi|waktu masuk|alamat) anda\b"
    r"|maaf, |(?:memeriksa|memverifikasi) (?:peramban|koneksi|perangkat) anda|terlalu banyak permintaan|mohon (?:kembali|coba)|silakan (?:masuk|muat|ulangi)|muat ulang"
    r"|gerbang tidak merespons)"
    r"|(?:aktifkan|nyalakan|izinkan|hidupkan|membutuhkan|memerlukan|menjalankan|mendukung) (?:javascript|js|skrip)\b|(?:enable|allow) (?:javascript|js|scripts?)\b"
    r"|\b(?:javascript|js|scripts?|skrip) (?:is |are )?(?:disabled|blocked|turned off|dimatikan|diblokir|tidak aktif|dinonaktifkan)"
)
# Openings and words of filler text.
FILLERS = r"(?i)\blorem\b|\bipsum\b|^(?:x{2,}\s*)+$|^(?:tes|test)\s+(?:tes|test)\b|ganti teks ini|\bdi sini\W*$|\bdami\b|^\(\s*(?:naskah|isi|teks|konten|judul)\b[^)]*\)$|untitled document|^(?:judul|nama|perihal) (?:dokumen|peraturan)\b.{0,3}(?:\.{3}|…|_{3,}|\(isi\))"
_MASHED = r"(?i)^(?=.{5,})(?:[qwertyuiop]+[ .]*)+$|^(?=.{5,})(?:[asdfghjkl]+[ .]*)+$|^(?=.{5,})(?:[zxcvbnm]+[ .]*)+$"
#: Words that make a segment a rule or a heading of a regulation.
_NORM = (
    r"\b(?:wajib|berhak|harus|dilarang|berwenang|bertugas|berkewajiban|bertanggung jawab|apabila|sebagaimana|menimbang|menetapkan|mengingat|memperhatikan|pemohon)\b|(?<!tidak )\bdapat me\w+"
    r"|^(?:BAB [IVXL]+|Pasal \d+[A-Z]?|\(\d+\)|[a-z]\. )|^(?:Ketentuan|Menimbang|Mengingat) |(?:Nomor|No\.) \d+ Tahun \d{4} tentang \p{L}{4,} \p{L}{3,}|\b(?:dicatat|disusun|ditetapkan|diatur|dilaksanakan|dimuat|diumumkan|dimaksud) (?:oleh|dalam)\b|\bpaling (?:lama|lambat|sedikit|banyak)\b|orang per |^LAMPIRAN\b"
)
_FORM_LINE = r"^[^:]{3,40}:\s*\(?\s*[._…]{5,}"


def segments(df: DataFrame, key: str, fields: list[str], host: str | None = None, group: str | None = None) -> DataFrame:
    """(key, field_name, host, grp, segment, title, alone) of all non-null, non-blank cells."""
    where = F.lower(F.regexp_extract(F.col(host), r"^\w*:?//([^/]+)", 1)) if host else F.lit("")
    cells = df.select(F.col(key).alias("_k"), where.alias("host"), F.col(group or key).alias("grp"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("c")).select("_k", "host", "grp", "c.*").where("text is not null")
    parts = F.split(F.col("text"), r"\n|(?<=[.;!?])\s+(?=[\p{Lu}(\[{<#%$@«_])")
    rows = cells.select("_k", "host", "grp", "field_name", parts.alias("parts")).select("_k", "host", "grp", "field_name", F.size("parts").alias("n"), F.explode("parts").alias("segment")).withColumn("segment", F.trim("segment"))
    return rows.where("segment <> ''").select(F.col("_k").alias(key), "field_name", "host", "grp", "segment", (F.col("field_name").contains("title")).alias("title"), (F.col("n") <= 4).alias("alone"))


def words_of(segment: Column) -> Column:
    """Lower-case words and marks of a segment; every digit becomes 0, so numbers differ by length alone."""
    return F.regexp_extract_all(F.translate(F.lower(segment), "123456789", "000000000"), F.lit(r"\p{L}+|0+|[^\s\p{L}0]{1,3}"), 0)


def features(words: Column, segment: Column, title: Column, alone: Column) -> Column:
    """Hashed n-grams: words and marks, pairs of them, length and shape, and whether it is a title or stands alone."""
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    few = F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1))
    size = F.greatest(F.length(segment), F.lit(1))
    vowels = F.length(segment) - F.length(F.translate(segment, "aeiouAEIOU", ""))
    shape = F.array(
        F.concat(F.lit("#len"), F.floor(F.log2(F.length(segment) + 1)).cast("string")),
        F.concat(F.lit("#title"), title.cast("string")),
        F.concat(F.lit("#alone"), alone.cast("string"), title.cast("string")),
        F.concat(F.lit("#few"), F.floor(few * 4).cast("string"), F.when(F.size(words) > 7, "long").otherwise("short")),
        F.concat(F.lit("#vowels"), F.floor(vowels / size * 12).cast("string")),
        F.concat(F.lit("#first "), F.coalesce(F.get(words, F.lit(0)), F.lit(""))),
        F.concat(F.lit("#last "), F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))),
    )
    return F.concat(words, pairs, shape)


def repeats(segment: Column) -> Column:
    """At least eight words, most of them repeated."""
    words = F.filter(F.split(F.lower(segment), r"\s+"), lambda w: w.rlike(r"^\p{L}"))
    return (F.size(words) >= 8) & (F.size(F.array_distinct(words)) <= 0.5 * F.size(words))


#: What gives a segment away, by families of patterns.
FAMILIES = ("placeholder", "filler", "status", "phrase")


def family(segment: Column, title: Column) -> Column:
    """The family of patterns that marks a segment as residue; null where none does."""
    return (
        F.when(segment.rlike(PLACEHOLDERS) & (title | ~segment.rlike(_FORM_LINE)), "placeholder")
        .when(segment.rlike(FILLERS) | segment.rlike(_MASHED) | repeats(segment), "filler")
        .when(segment.rlike(_NORM), None)
        .when(segment.rlike(STATUSES), "status")
        .when(segment.rlike(PHRASES), "phrase")
    )


def content(segment: Column, title: Column) -> Column:
    """Whether a segment that no family marks is surely content."""
    return segment.rlike(_NORM) | (~title & segment.rlike(_FORM_LINE)) | (title & segment.rlike(r"(?i)\b(?:kota|kabupaten|kawasan|bagi|di) \S+(?: \S+){0,2}$"))


def labelled(rows: DataFrame) -> DataFrame:
    """``rows`` with family, label (1 residue, else 0) and sure (whether a pattern decided)."""
    marked = rows.withColumn("family", family(F.col("segment"), F.col("title")))
    return marked.withColumn("label", F.col("family").isNotNull().cast("double")).withColumn("sure", F.col("family").isNotNull() | content(F.col("segment"), F.col("title")))


def _vectors(rows: DataFrame) -> DataFrame:
    hashed = HashingTF(inputCol="_terms", outputCol="features", numFeatures=DIMENSIONS, binary=True)
    # the words are a column of their own, so they are found once and not once for each use
    split = rows.withColumn("_words", words_of(F.col("segment")))
    terms = split.withColumn("_terms", features(F.col("_words"), F.col("segment"), F.col("title"), F.col("alone")))
    return hashed.transform(terms).drop("_terms", "_words")


def counted(rows: DataFrame, *by: str) -> DataFrame:
    """Each different segment of ``rows`` (and ``by``) with n, the number of rows that have it."""
    found = rows.groupBy("segment", "title", "alone", *by).agg(F.count("*").alias("n"))
    # each round of training moves one gradient a partition, so they are no more than keep the cores busy, or a quarter of a shuffle's
    spark = rows.sparkSession
    return found.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))


def train(rows: DataFrame, without: str | None = None) -> LogisticRegressionModel | None:
    """The classifier of labelled segments, each as often as its n says; those of the family ``without`` are left aside.

    None if one of the classes has no segment.
    """
    used = rows.where(F.col("family").isNull() | (F.col("family") != without)) if without else rows
    counts = {r["label"]: r["n"] for r in used.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if len(counts) < 2:
        return None
    weight = F.when(F.col("label") == 1, F.lit(max(1.0, min(10.0, counts[0.0] / counts[1.0])))).when(F.col("sure"), 1.0).otherwise(UNJUDGED)
    # not persisted: the regression keeps the vectors in blocks of its own
    weighted = _vectors(used).select("features", "label", (weight * F.col("n")).alias("w"))
    return LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", regParam=REGULARISATION, maxIter=ROUNDS, tol=TOLERANCE, standardization=False).fit(weighted)


def score(rows: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """``rows`` with column score: the probability that a segment is residue."""
    return model.transform(_vectors(rows)).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def spared(segment: Column, title: Column) -> Column:
    """Exact check: content that only speaks of such messages, and blanks for the public to fill in."""
    return ~segment.rlike(PLACEHOLDERS) & (segment.rlike(_NORM) | (~title & segment.rlike(_FORM_LINE)))


def residue(df: DataFrame, key: str = "doc_row_id", fields: tuple[str, ...] = ("doc_title", "doc_content")) -> DataFrame:
    """(key, field_name, score) of each cell that holds residue instead of content.

    Null and blank cells are no residue; repeated rows are judged alike; texts are read whole. Weights and
    scores come from every segment of the table. Without segments of both kinds to learn from there is no
    result row.
    """
    rows = segments(df, key, list(fields))
    same = ["segment", "title", "alone"]
    known = labelled(counted(rows)).persist()  # read for the class counts, in training and for the scores
    try:
        model = train(known)
        if model is None:
            return rows.where("false").select(key, "field_name", F.lit(0.0).alias("score"))
        # the check runs on segments of high score only
        bad = F.when(F.col("score") >= THRESHOLD, ~spared(F.col("segment"), F.col("title"))).otherwise(False)
        found = checkpoint(score(known, model).where(bad).select(*same, "score"))
    finally:
        known.unpersist()
    # only rows that may hold a residual segment are moved to be compared
    maybe = BloomFilter(found.select(F.xxhash64(*same).alias("_h")), "_h").probe(rows.withColumn("_h", F.xxhash64(*same)), "_h", "_maybe").where("_maybe")
    return maybe.select(F.col(key), "field_name", *same).join(found, same).groupBy(key, "field_name").agg(F.max("score").alias("score"))


def kept(df: DataFrame, key: str = "doc_row_id", fields: tuple[str, ...] = ("doc_title", "doc_content")) -> DataFrame:
    """``df`` with residual cells set to null, as it should enter an index."""
    found = residue(df, key, fields).groupBy(key).agg(F.collect_set("field_name").alias("_bad"))
    out = df.join(found, key, "left")
    for f in fields:
        out = out.withColumn(f, F.when(F.coalesce(F.array_contains("_bad", f), F.lit(False)), None).otherwise(F.col(f)))
    return out.drop("_bad")


def validate(df: DataFrame, key: str = "doc_row_id", fields: tuple[str, ...] = ("doc_title", "doc_content"), host: str = "detail_url", group: str = "doc_id") -> DataFrame:
    """What the classifier knows beyond its labels, on hosts that training did not see.

    Every fifth host is held out; where there are fewer than five hosts, every fifth document (column
    ``group``, so that crawls of one document are on one side), which the column group_kind says. One row
    for all families together, and one for each family of patterns whose labels training did not see:
    n_residue marked segments, recall of them by the classifier alone, n_clean surely clean segments and
    the share of them that it takes for residue. Agreement with patterns, not with a reader.
    """
    rows = segments(df, key, list(fields), host, group if group in df.columns else key)
    hosts = rows.select("host").distinct().limit(5).count()
    by = F.col("host") if hosts >= 5 else F.coalesce(F.col("grp").cast("string"), F.lit(""))
    rows = labelled(counted(rows.withColumn("_held", F.pmod(F.xxhash64(by), F.lit(5)) == 0), "_held")).persist()
    out = []
    for left_out in (None, *FAMILIES):
        model = train(rows.where("not _held"), left_out)
        if model is None:
            continue
        judged = score(rows.where("_held"), model).withColumn("hit", F.col("score") >= THRESHOLD)
        marked = (F.col("label") == 1) & (F.col("family") == left_out if left_out else F.lit(True))
        clean = (F.col("label") == 0) & F.col("sure")
        n = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
        out.append(judged.agg(
            n(marked).alias("n_residue"), F.round(n(marked & F.col("hit")) / F.nullif(n(marked), F.lit(0)), 4).alias("recall"),
            n(clean).alias("n_clean"), F.round(n(clean & F.col("hit")) / F.nullif(n(clean), F.lit(0)), 4).alias("false_share"),
        ).select(F.lit("host" if hosts >= 5 else "document").alias("group_kind"), F.lit(left_out or "none").alias("labels_left_out"), "*"))
    if not out:
        return df.sparkSession.createDataFrame([], "group_kind string, labels_left_out string, n_residue bigint, recall double, n_clean bigint, false_share double")
    return reduce(DataFrame.unionByName, out)

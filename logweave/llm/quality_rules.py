"""Quality rules with DataFrame functions only: per-document counts and cross-document line frequency.

``line_frequency`` hashes normalised lines (lower case, runs of white space as one
space, trimmed), counts the distinct documents of each host that hold a line,
removes lines above the limit and rejects documents that lose too much.

Defined results: a null or blank text has no words or lines and fails the base
rules; a null source is a host of its own; rows that repeat a whole row are
separate documents with equal results; an empty table gives no rows; columns
beyond doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is boilerplate when more documents of its host hold it, whatever the host's size.
MAX_LINE_DOCS = 10
#: A document is depleted when less than this share of its word characters is left.
MIN_LEFT = 0.5

_BLANKS = "\t\n\x0b\f\r"


def split_words(text: Column) -> Column:
    """``[^\\x20\\x09-\\x0D]+`` as an array, by a one-character split."""
    return F.array_remove(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " "), "")


def text_lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")))


def base_counts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w, last = WINDOW, WINDOW - 1
    d = docs.withColumn("_t", F.coalesce("text", F.lit(""))).withColumn("_w", F.transform(split_words(F.col("_t")), lambda x: F.xxhash64(x)))
    d = d.withColumn("_h", F.expr(f"CASE WHEN size(_w) > {w} THEN transform(sequence(1, size(_w) - {last}), i -> xxhash64(slice(_w, i, {w}))) ELSE cast(array() AS array<bigint>) END"))
    # only texts in which some window repeats are sorted to find which ones
    d = d.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> struct(h AS h, i AS i))) ELSE cast(array() AS array<struct<h: bigint, i: int>>) END"))
    d = d.withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, i) -> (i > 0 AND _s[i - 1].h = x.h) OR (i < size(_s) - 1 AND _s[i + 1].h = x.h)), x -> x.i))"))
    d = d.withColumn("_l", text_lines(F.col("_t")))
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.translate("_t", " " + _BLANKS, "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": F.expr(f"aggregate(transform(_p, (p, i) -> CASE WHEN i = size(_p) - 1 THEN {w} ELSE least({w}, _p[i + 1] - p) END), 0L, (a, x) -> a + x)"),
    })
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return d.drop("_t", "_w", "_h", "_s", "_p", "_l")


def line_frequency(docs: DataFrame, max_docs: int = MAX_LINE_DOCS, max_share: float | None = None) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, th (hash of the text), removed_chars, removed_lines, for documents that lose lines.

    The number of documents decides alone, for small and large hosts alike, unless a share of the host's documents must be exceeded too.
    Counts are pre-aggregated before each shuffle (distinct lines of a document
    first, then partial counts), and only lines over the limit are joined back; a
    host or line that holds a large share of the rows is split by AQE's skew join.
    """
    host = F.coalesce(F.concat(F.lit("h"), F.col("source")), F.lit(""))
    # numbered before lines are unfolded, so that a row's lines share its number
    lines = docs.select("doc_id", F.monotonically_increasing_id().alias("copy"), F.xxhash64("text").alias("th"), host.alias("host"), F.transform(text_lines(F.coalesce("text", F.lit(""))), lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.length(F.translate(x, " \t\x0b\f\r", "")).alias("c"))).alias("l"))
    counts = lines.select("host", F.explode(F.array_distinct(F.transform("l", lambda x: x["h"]))).alias("h")).groupBy("host", "h").agg(F.count("*").alias("n"))
    over = counts.where(F.col("n") > max_docs)
    if max_share is not None:
        over = over.join(lines.groupBy("host").agg(F.count("*").alias("host_docs")), "host").where(F.col("n") > max_share * F.col("host_docs"))
    over = over.select("host", "h")
    return lines.select("doc_id", "th", "host", "copy", F.inline("l")).join(over, ["host", "h"], "left_semi").groupBy("doc_id", "th", "host", "copy").agg(F.sum("c").alias("removed_chars"), F.count("*").alias("removed_lines"), F.collect_set("h").alias("removed_hashes"))


def quality(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, source and text with counts, removed_chars, removed_lines, base_failed, kept and cleaned (text without removed lines)."""
    docs = docs.select("doc_id", "source", "text")
    base = base_counts(docs).withColumn("_th", F.xxhash64("text")).withColumn("_host", F.coalesce(F.concat(F.lit("h"), F.col("source")), F.lit("")))
    lost = line_frequency(docs, **limits).select(F.col("doc_id").alias("_d"), F.col("th").alias("_lh"), F.col("host").alias("_lhost"), "removed_chars", "removed_lines", "removed_hashes").dropDuplicates(["_d", "_lh", "_lhost"])
    out = base.join(lost, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_lh")) & (F.col("_host") == F.col("_lhost")), "left")
    out = out.withColumns({"removed_chars": F.coalesce("removed_chars", F.lit(0)).cast("long"), "removed_lines": F.coalesce("removed_lines", F.lit(0)).cast("long")})
    left = F.col("word_chars") - F.col("removed_chars")
    out = out.withColumn("kept", ~F.col("base_failed") & (left >= MIN_LEFT * F.col("word_chars")))
    hit = lambda x: F.coalesce(F.array_contains("removed_hashes", F.xxhash64(normal_line(x))), F.lit(False))
    out = out.withColumn("cleaned", F.when(F.col("removed_lines") == 0, F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x: ~hit(x)), "\n")))
    return out.drop("_th", "_host", "_d", "_lh", "_lhost", "removed_hashes")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_lines", "removed_chars")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce('h' || source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, host, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS h, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS c FROM (SELECT doc_id, host, unnest(l) AS x FROM w)),
over_limit AS (SELECT host, h FROM (SELECT host, h, count(DISTINCT doc_id) AS n FROM ln GROUP BY host, h) WHERE n > 10),
lost AS (SELECT doc_id, sum(c) AS c, count(*) AS n FROM ln SEMI JOIN over_limit USING (host, h) GROUP BY doc_id),
b AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  coalesce(lost.n, 0)::BIGINT AS removed_lines, coalesce(lost.c, 0)::BIGINT AS removed_chars
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND word_chars - removed_chars >= 0.5 * word_chars AS kept FROM b
"""

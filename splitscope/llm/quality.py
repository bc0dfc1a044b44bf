"""Op 9: quality rules, with the cross-document frequency of lines. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitscope.llm.common import BESIDE, renewed, save

#: A line is boilerplate of a host if at least so many of its distinct documents hold it, however large the host is.
LINE_DOCUMENTS = 20
#: A document is depleted if less than this share of its word characters, or fewer words than the base rule asks for, stay.
LEAST_LEFT, LEAST_WORDS = 0.3, 20
WINDOW = 8
_SPACE = r"[\x20\x09-\x0D]+"
_TRIM = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def normal_line(line: Column) -> Column:
    """White space runs as one space, trimmed, lower case, digits as 0."""
    return F.lower(F.translate(F.btrim(F.regexp_replace(line, _SPACE, " "), F.lit(" ")), "123456789", "000000000"))


def with_repeated_words(df: DataFrame, hashes: str) -> DataFrame:
    """Adds n_repeat_words: words that lie in windows of WINDOW words found twice or more. `hashes`: column of the words' hashes, dropped.

    Windows are hashed; most texts repeat none, which one distinct count
    shows. In the others, window starts are sorted by hash, neighbours with equal hashes marked, and
    the marked starts, in order, each add the words that the one before doesn't cover.
    The arrays are columns of their own: inside a lambda they would be computed for each element.
    """
    n = F.size(hashes)
    df = df.withColumn("_windows", F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))))
    some = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_at", F.when(some, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def twin(x: Column, k: Column) -> Column:
        return ((k > 0) & (F.get("_at", k - 1)["h"] == x["h"])) | ((k < F.size("_at") - 1) & (F.get("_at", k + 1)["h"] == x["h"]))

    starts = F.sort_array(F.transform(F.filter("_at", twin), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(hashes, "_windows", "_at")


def _lines(text: Column) -> Column:
    """Lines with a word, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(_TRIM)) != "")


_KEY = ("doc_id", "text_hash", "host")


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """Rows are told apart by id, text and host; a null host counts as the empty one."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("source", F.lit("")).alias("host"), *more)


def base_metrics(docs: DataFrame) -> DataFrame:
    """Word, symbol and repetition counts of every text, and the base rule's verdict."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = _keyed(docs, text.alias("_text"), words_of(text).alias("_words"), _lines(F.col("text")).alias("_lines"))
    out = split.select(
        *_KEY,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit("[" + SYMBOLS + "]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    out = with_repeated_words(out, "_hashes")
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def frequent_lines(docs: DataFrame) -> DataFrame:
    """(host, line): hashes of the normalised lines that LINE_DOCUMENTS distinct documents of the host hold. Each counts once for a line.

    Documents of a host with the same text are one document: a page that was fetched often
    isn't boilerplate. Texts and lines are summed up before their shuffles, of
    hashes alone, so neither a hot host, a hot text nor a hot line meets in one task.
    """
    hashes = F.array_distinct(F.transform(_lines(F.col("text")), lambda x: F.xxhash64(normal_line(x))))
    texts = _keyed(docs, hashes.alias("lines")).groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    held = texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    return held.where(F.col("n") >= LINE_DOCUMENTS).select("host", "line")


def removals(docs: DataFrame) -> DataFrame:
    """For each document with lines above the limits: their hashes, and the words and word characters they take, counted as often as they stand there."""
    line = lambda x: F.struct(
        F.xxhash64(normal_line(x)).alias("line"),
        F.length(F.regexp_replace(x, _SPACE, "")).alias("chars"),
        F.size(words_of(x)).alias("words"),
    )
    rows = _keyed(docs, F.posexplode(F.transform(_lines(F.col("text")), line))).select(*_KEY, "pos", "col.*")
    found = rows.join(frequent_lines(docs), ["host", "line"])
    # equal rows of the input give equal line rows: one of them is counted
    once = found.groupBy(*_KEY, "pos").agg(*(F.first(c).alias(c) for c in ("line", "chars", "words")))
    return once.groupBy(*_KEY).agg(
        F.collect_set("line").alias("removed"), F.count("*").alias("removed_lines"), F.sum("words").alias("removed_words"), F.sum("chars").alias("removed_chars")
    )


def _judged(docs: DataFrame) -> DataFrame:
    base, gone = base_metrics(docs), removals(docs)
    words = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    chars = F.col("word_chars") - F.coalesce("removed_chars", F.lit(0))
    depleted = F.col("removed_words").isNotNull() & ((words < LEAST_WORDS) | (chars < LEAST_LEFT * F.col("word_chars")))
    match = base["doc_id"].eqNullSafe(gone["doc_id"]) & base["text_hash"].eqNullSafe(gone["text_hash"]) & (base["host"] == gone["host"])
    return base.join(gone, match, "left").select(
        *(base[c] for c in base.columns),
        F.coalesce("removed", F.array().cast("array<long>")).alias("removed"),
        F.coalesce("removed_lines", F.lit(0)).alias("n_removed_lines"),
        (~F.col("base_failed") & ~depleted).alias("kept"),
    )


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document, and how many of its lines are boilerplate of its host (n_removed_lines); a row for each row.

    Null or empty text: no words, so it fails the base rule. Null source: the
    empty host. Rows repeated in full, and other copies on a host, count as one document for the frequency of lines. Extra
    columns are ignored. An empty table gives an empty result.
    """
    return _judged(docs).drop("text_hash", "host", "removed")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, without the lines above the limits; columns as those of `docs`, n_chars renewed."""
    # written before it is filtered: a filter would move below the join and compute the rules anew
    doc, key, host, removed, kept = names = [BESIDE + x for x in (*_KEY, "removed", "kept")]
    verdicts, _ = save(_judged(docs).select(*_KEY, "removed", "kept").toDF(*names), "quality")
    verdicts = verdicts.where(F.col(kept)).drop(kept).distinct()
    match = docs["doc_id"].eqNullSafe(verdicts[doc]) & (F.xxhash64(docs["text"]) == verdicts[key]) & (F.coalesce(docs["source"], F.lit("")) == verdicts[host])
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(removed, F.xxhash64(normal_line(x)))), "\n")
    out = docs.join(verdicts, match).withColumn("text", F.when(F.size(removed) == 0, F.col("text")).otherwise(left))
    return renewed(out, docs)


#: DuckDB SQL of quality_verdicts over the table documents.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) > 8)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
repeats AS (
  SELECT doc_id, sum(n) AS n
  FROM (SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8)) AS n FROM twice)
  GROUP BY doc_id),
base AS (
  SELECT doc_id, host, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN repeats USING (doc_id)),
each_line AS (
  SELECT doc_id, host, line, len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words,
         length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
         lower(translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), '123456789', '000000000')) AS norm
  FROM (SELECT doc_id, host, unnest(lines) AS line FROM d)),
frequent AS (SELECT host, norm FROM each_line JOIN d USING (doc_id, host) GROUP BY host, norm HAVING count(DISTINCT text) >= 20),
gone AS (SELECT doc_id, count(*) AS n_lines, sum(words) AS w, sum(chars) AS c FROM each_line JOIN frequent USING (host, norm) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
       coalesce(n_lines, 0)::BIGINT AS n_removed_lines,
       NOT failed AND NOT (w IS NOT NULL AND (n_words - w < 20 OR word_chars - c < 0.3 * word_chars)) AS kept
FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS failed FROM base) LEFT JOIN gone USING (doc_id)
"""

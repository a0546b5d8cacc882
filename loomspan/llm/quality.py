"""Quality rules: per-document repetition counts and cross-document line frequency, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan import scratch
from loomspan.llm.columns import hide, show

#: The six white-space characters that part words.
BLANKS = " \t\n\x0b\x0c\r"
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"


def spaced(text: Column) -> Column:
    """Text with each blank character as a plain space."""
    for c in BLANKS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words(text: Column) -> Column:
    """Array of the maximal runs of other characters than the six blanks; empty for null."""
    return F.coalesce(F.array_remove(F.split(spaced(text), " "), ""), F.array().cast("array<string>"))


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _triples(hashes: Column) -> Column:
    """Hash of each run of three words, from the array of word hashes."""
    n = F.size(hashes)
    pairs = F.zip_with(F.slice(hashes, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(hashes, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.zip_with(F.slice(pairs, F.lit(1), F.greatest(n - 2, F.lit(0))), F.slice(hashes, F.lit(3), F.greatest(n - 2, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _bound(x: Column, then) -> Column:
    """then(x), with x worked out once although a lambda inside may use it for every element."""
    return F.transform(F.array(x), then)[0]


def _pairs_of(s: Column, step) -> Column:
    n = F.greatest(F.size(s) - 1, F.lit(0))
    return F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, F.lit(2), n), step)


def _repeated(triples: Column) -> Column:
    """Words covered by three-word windows found at least twice, from the array of window hashes.

    Sorted hashes tell which are found twice. If those are few, the windows are looked up among them; otherwise windows
    are sorted next to their place. Either way each repeated window adds the words that the one before has not covered.
    """
    twice = F.array_distinct(F.filter(_pairs_of(F.sort_array(triples), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))

    def by_look(found: Column) -> Column:
        return _covered(F.filter(F.transform(triples, lambda h, i: F.when(F.array_contains(found, h), i + 1)), lambda x: x.isNotNull()))

    placed = F.transform(triples, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i")))
    by_sort = _bound(F.array_sort(placed), _covered_by)
    return _bound(twice, lambda found: F.when(F.size(found) <= 32, by_look(found)).otherwise(by_sort))


def _covered(places: Column) -> Column:
    """Words that windows of three words at these places, in order, cover."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(x.alias("last"), (a.n + F.least(F.lit(3), x - a["last"])).alias("n"))
    return F.aggregate(places, start, step, lambda a: a.n)


def _covered_by(s: Column) -> Column:
    n = F.size(s)

    def twin(x: Column, i: Column) -> Column:
        before = (i > 0) & (F.element_at(s, F.greatest(i, F.lit(1))).h == x.h)
        return before | ((i < n - 1) & (F.element_at(s, F.least(i + 2, n)).h == x.h))

    return _covered(F.sort_array(F.transform(F.filter(s, twin), lambda x: x.i)))


def _with_words(lines: Column) -> Column:
    return F.filter(lines, lambda x: F.length(F.replace(spaced(x), F.lit(" "), F.lit(""))) > 0)


def counts(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed added (and `_at`).

    A null text has no words: all counts are 0 and base_failed is true.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spread = docs.withColumn("_spaced", spaced(text))
    flat = spread.withColumn("_words", F.array_remove(F.split("_spaced", " "), "")).withColumn("_triples", _triples(F.transform("_words", lambda w: F.xxhash64(w))))
    # most texts have no line twice, blank ones apart; only the others' lines are looked at one by one
    several = flat.withColumn("_lines", F.array_remove(F.split(text, "\n"), ""))
    held = several.withColumn("_lines", F.when(F.size("_lines") > F.size(F.array_distinct("_lines")), _with_words(F.col("_lines"))).otherwise(F.array().cast("array<string>")))
    symbols = F.length(F.regexp_replace("_spaced", f"[^{SYMBOLS}]+", ""))
    doubled = F.size(F.array_distinct("_triples")) < F.size("_triples")
    # an indeterminate column keeps filters above this projection, so that no count is worked out in a filter again
    counted = held.select(
        *docs.columns,
        F.monotonically_increasing_id().alias("_at"),
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.replace("_spaced", F.lit(" "), F.lit(""))).cast("bigint").alias("word_chars"),
        symbols.cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("_words") < 4, 0).otherwise(F.when(doubled, _repeated(F.col("_triples"))).otherwise(0)).cast("bigint").alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def norm(line: Column) -> Column:
    """Hash of a line that is trimmed, lower-cased and has single blanks."""
    return F.xxhash64(F.lower(F.array_join(words(line), " ")))


def line_table(docs: DataFrame, host: str = "source") -> DataFrame:
    """(host, _row, at, document, line, n) per line with a word: row_key, place, hash of the document, line hash, words.

    Documents with the same characters but for case and blanks are one document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    document = F.xxhash64(F.lower(F.replace(spaced(text), F.lit(" "), F.lit(""))))
    held = docs.select(F.col(host).alias("host"), row_key(host).alias("_row"), document.alias("document"), F.split(text, "\n").alias("lines"))
    held = held.select("host", "_row", "document", F.posexplode("lines").alias("at", "line")).where(F.length("line") > 0).select("host", "_row", "at", "document", norm(F.col("line")).alias("line"), F.size(words(F.col("line"))).alias("n"))
    return scratch.materialize(held, "lines").where("n > 0")


def frequent_lines(held: DataFrame, min_docs: int = 10, share: float = 0.02) -> DataFrame:
    """(f_host, f_line) of a line table: lines of more than max(min_docs, share of the host's documents) distinct documents.

    Documents with the same characters but for case and blanks count once, so that copies of a document don't make its
    own lines frequent. Documents that differ otherwise are distinct, so pages of one template count each, however short
    their own lines are. Null hosts form a host of their own.
    """
    sizes = held.groupBy("host").agg(F.countDistinct("document").alias("host_docs"))
    found = held.groupBy("host", "line").agg(F.countDistinct("document").alias("line_docs")).where(F.col("line_docs") > min_docs)
    found = found.join(sizes.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).where(F.col("line_docs") > share * F.col("host_docs"))
    return scratch.materialize(found.select(F.col("host").alias("f_host"), F.col("line").alias("f_line")), "frequent-lines")


def _losses(held: DataFrame, frequent: DataFrame) -> DataFrame:
    """(_key, _lost, _hot) per document that holds frequent lines: the words in them, and their hashes. _key is row_key."""
    hot = held.join(frequent, (F.col("line") == F.col("f_line")) & F.col("host").eqNullSafe(F.col("f_host")))
    hot = hot.dropDuplicates(["_row", "at"])  # rows alike share a key and have the same lines
    return hot.groupBy(F.col("_row").alias("_key")).agg(F.sum("n").alias("_lost"), F.collect_set("line").alias("_hot"))


def row_key(host: str = "source") -> Column:
    """Equal for rows that agree in id, text and host: such rows share their verdict."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")), F.coalesce(F.col(host), F.lit("")))


def _judge(docs: DataFrame, host: str, min_docs: int, share: float, keep_words: float) -> DataFrame:
    """docs with their counts, base_failed, kept and _hot: the hashes of their frequent lines, null if they have none."""
    held = line_table(docs.select("doc_id", "text", host), host)
    losses = _losses(held, frequent_lines(held, min_docs, share))
    judged = counts(docs.withColumn("_row", row_key(host))).join(losses, F.col("_row") == F.col("_key"), "left")
    depleted = F.coalesce(F.col("n_words") - F.col("_lost") < keep_words * F.col("n_words"), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("_row", "_key", "_lost")


def judge(docs: DataFrame, host: str = "source", min_docs: int = 10, share: float = 0.02, keep_words: float = 0.2) -> DataFrame:
    """Each row of docs with its counts, base_failed and kept.

    kept is false if base_failed, and otherwise if the document is depleted: fewer than keep_words of its words lie
    outside frequent lines. Repeated rows get equal verdicts; an empty table gives no rows; columns besides doc_id, text
    and the host pass through unless they bear the name of an output or a working column.
    """
    made = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "_row", "_key", "_lost", "_hot", "_at", "_words", "_spaced", "_triples", "_lines"}
    docs = docs.select(*[c for c in docs.columns if c not in made])
    return _judge(docs, host, min_docs, share, keep_words).drop("_at", "_hot")


def clean(docs: DataFrame, host: str = "source", min_docs: int = 10, share: float = 0.02, keep_words: float = 0.2) -> DataFrame:
    """The rows of docs that judge() keeps, without their frequent lines; texts without such lines stay as they are."""
    needed = ("doc_id", "text", host, "n_chars")
    docs, names = hide(docs, *needed)
    kept = _judge(docs, host, min_docs, share, keep_words).where(F.col("kept") & (F.col("_at") >= 0))
    rest = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_hot", norm(x)))
    out = kept.withColumn("text", F.when(F.col("_hot").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))).select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return show(out, names, *needed)


#: The result in DuckDB SQL, for the default limits.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS r,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY r),
ln AS (
  SELECT r, source, line FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY r),
fp AS (SELECT r, lower(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS document FROM d),
nl AS (
  SELECT ln.r, ln.source, fp.document,
         lower(array_to_string(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> ''), ' ')) AS line,
         len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n
  FROM ln JOIN fp USING (r)),
hs AS (SELECT source, count(DISTINCT document) AS host_docs FROM nl GROUP BY source),
fr AS (
  SELECT l.source, l.line FROM (SELECT source, line, count(DISTINCT document) AS c FROM nl GROUP BY source, line) l
  JOIN hs ON l.source IS NOT DISTINCT FROM hs.source WHERE c > 10 AND c > 0.02 * host_docs),
lost AS (
  SELECT nl.r, sum(nl.n) AS n, sum(CASE WHEN fr.line IS NOT NULL THEN nl.n ELSE 0 END) AS gone
  FROM nl LEFT JOIN fr ON nl.line = fr.line AND nl.source IS NOT DISTINCT FROM fr.source GROUP BY nl.r),
c AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(lost.n - lost.gone < 0.2 * lost.n, false) AS depleted
  FROM d LEFT JOIN cov USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT depleted AS kept
FROM b
"""

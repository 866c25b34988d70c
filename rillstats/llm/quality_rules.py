"""Quality rules: a table of thresholds compiled into one native projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, WORD_CLASS, read_table

LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
#: Characters that count as symbols.
SYMBOL_CLASS = r"[#*$%&|<>]"

#: Frequent function words of the four languages.
STOP_WORDS = tuple(
    "the of and to in a is that it on for was with as be by at this from are "
    "der die und das den von zu mit auf ist ein eine im dem des nicht sich für an auch "
    "de la le et les des un une que en pour du dans est qui sur pas avec au ce "
    "el y los se del las por con no para su al lo como una más pero".split()
)

#: (name, metric, least, most); None is no bound. A text fails a rule if its metric lies outside.
RULES: tuple[tuple[str, str, float | None, float | None], ...] = (
    ("word_length", "mean_word_chars", 2.0, 14.0),
    ("symbols", "symbol_ratio", None, 0.1),
    ("exclamations", "exclamation_ratio", None, 0.3),
    ("ellipses", "ellipsis_line_ratio", None, 0.5),
    ("stop_words", "stop_word_ratio", 0.005, None),
    ("repeated_lines", "dup_line_ratio", None, 0.3),
)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def _covered(windows: Column, width: int) -> Column:
    """Words in windows whose hash stands there twice or more."""

    def marked(ordered: Column) -> Column:
        at = lambda k: F.get(ordered, k)["h"]
        flagged = F.filter(ordered, lambda x, k: F.coalesce(at(k - 1) == x["h"], F.lit(False)) | F.coalesce(at(k + 1) == x["h"], F.lit(False)))
        return F.sort_array(F.transform(flagged, lambda x: x["p"]))

    def summed(places: Column) -> Column:
        gaps = F.transform(places, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(places, k + 1) - p, F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("p"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(let(ordered, marked), summed))


def _word_part(words: Column) -> Column:
    n = F.size(words)
    threes = F.slice(F.transform(words, lambda w, k: F.xxhash64(w, F.get(words, k + 1), F.get(words, k + 2))), 1, F.greatest(n - 2, F.lit(0)))
    stops = F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS)))
    return F.struct(n.cast("long").alias("n_words"), let(threes, lambda t: _covered(t, 3)).cast("long").alias("n_repeat_words"), stops.cast("long").alias("n_stop_words"))


def _line_part(lines: Column) -> Column:
    ellipses = F.size(F.filter(lines, lambda x: x.endswith("...") | x.endswith("…")))
    return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), ellipses.cast("long").alias("n_ellipsis_lines"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, the counts of each text, and the ratios that rules use. No
    shuffle and no Python. Null texts count as empty: all counts and ratios are 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    base = docs.select(*keep, F.col(text_col).alias("text")) if text_col not in keep else docs.select(*keep)
    counted = base.select(
        *keep, let(words_of(text), _word_part).alias("w"), let(lines, _line_part).alias("l"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE_CLASS))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL_CLASS)).cast("long").alias("n_symbols"), F.regexp_count(text, F.lit("!")).cast("long").alias("n_exclamations"),
    )
    flat = counted.select(*keep, "w.*", "l.*", "word_chars", "n_symbols", "n_exclamations")
    c = F.col
    return flat.select(
        "*", ratio(c("word_chars"), c("n_words")).alias("mean_word_chars"), ratio(c("n_symbols"), c("n_words")).alias("symbol_ratio"), ratio(c("n_exclamations"), c("n_words")).alias("exclamation_ratio"),
        ratio(c("n_ellipsis_lines"), c("n_lines")).alias("ellipsis_line_ratio"), ratio(c("n_stop_words"), c("n_words")).alias("stop_word_ratio"), ratio(c("n_dup_lines"), c("n_lines")).alias("dup_line_ratio"),
        ratio(c("n_repeat_words"), c("n_words")).alias("repeat_ratio"),
    )


def failed(rules=RULES) -> Column:
    """An array of the names of the rules that a row of statistics() fails."""
    each = []
    for name, metric, least, most in rules:
        bad = F.lit(False)
        if least is not None:
            bad = bad | (F.col(metric) < least)
        if most is not None:
            bad = bad | (F.col(metric) > most)
        each.append(F.when(bad, F.lit(name)))
    return F.array_compact(F.array(*each))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judged(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts, ratios, base_failed, failed_rules, kept.

    Null and empty texts have no words, so base_failed is true. Only id and text are
    read: other columns, whatever their names, don't matter. Repeated rows and null ids
    come back as they are; an empty table gives an empty result; texts are read whole."""
    renamed = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    out = statistics(renamed, "text", ("_id",)).withColumns({"base_failed": base_failed(), "failed_rules": failed(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).withColumnRenamed("_id", id_col)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '{SPACE_CLASS}+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(list_zip(ws, ws[2:], ws[3:], range(1, len(ws) + 1))) AS x FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, x[4] AS k, count(*) OVER (PARTITION BY doc_id, x[1], x[2], x[3]) AS c FROM p WHERE x[3] IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM g, (SELECT unnest(range(0, 3)) AS j) WHERE c >= 2 GROUP BY doc_id),
s AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
             length(t) - length(regexp_replace(t, '{SYMBOL_CLASS}', '', 'g')) AS n_symbols, length(t) - length(replace(t, '!', '')) AS n_excl,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
             len(list_filter(ls, lambda x: x LIKE '%...' OR x LIKE '%…')) AS n_ell,
             len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}))) AS n_stop
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.1::DOUBLE AND n_excl / n_words <= 0.3::DOUBLE
         AND n_ell / n_lines <= 0.5::DOUBLE AND n_stop / n_words >= 0.005::DOUBLE AND n_dup_lines / n_lines <= 0.3::DOUBLE AS kept
FROM b
"""

"""Quality rules: a table of thresholds compiled into one projection, no user functions.

Every rule is (name, metric, least, most); a bound that is None does not apply. `compiled` turns
the table into one boolean column and one array with the names of the broken rules. Metrics are
Column expressions over the whole text, evaluated once per document in a single narrow stage:
nothing is shuffled, so skew of sources or copies costs nothing.

A null text has no words: all counts are 0 and the document fails the base rules. Metrics with an
empty denominator are null and break no rule. Other columns of the input are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelframe.llm.base import SPACES, WORD, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Frequent function words of the supported languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with", "be", "by", "on", "are", "this",
    "an", "from", "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im",
    "dem", "nicht", "ein", "eine", "de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con",
    "no", "una", "su", "para", "es", "al", "lo", "le", "les", "et", "du", "une", "est", "pour", "dans", "qui", "par",
    "sur", "pas", "au", "avec", "ou",
)

#: name, metric, least, most
RULES = (
    ("mean_word_length", "mean_word_length", 1.5, 30.0),
    ("symbols_per_word", "symbols_per_word", None, 0.1),
    ("stop_words", "stop_words", 1.0, None),
    ("dup_line_ratio", "dup_line_ratio", None, 0.40),
)


def _counts(text: Column) -> dict[str, Column]:
    whole = F.coalesce(text, F.lit(""))
    return {
        "text": whole,
        "words": F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)),
        "lines": F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    }


def _repeats() -> Column:
    """Words covered by the windows that occur at least twice.

    Only texts in which some window repeats sort their windows; hashed windows are 64 bits wide.
    """
    return F.expr(f"""
      CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L ELSE
        aggregate(
          array_sort(transform(
            filter(
              transform(sorted, (x, i) -> struct(x.p AS p,
                (i > 0 AND x.h = sorted[greatest(i - 1, 0)].h)
                OR (i < size(sorted) - 1 AND x.h = sorted[least(i + 1, size(sorted) - 1)].h) AS again)),
              x -> x.again),
            x -> x.p)),
          named_struct('n', 0L, 'upto', -1),
          (acc, p) -> named_struct('n', acc.n + {WINDOW} - greatest(acc.upto - p, 0), 'upto', p + {WINDOW}),
          acc -> acc.n) END""")


def metrics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """`key` and the counts of each document."""
    parts = docs.select(F.col(f"`{key}`").alias(key), *[c.alias(n) for n, c in _counts(F.col(f"`{text}`")).items()])
    hashed = parts.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    windows = hashed.withColumn("windows", F.expr(f"""
      CASE WHEN size(hashes) < {WINDOW} THEN cast(array() AS array<bigint>) ELSE
        transform(sequence(0, size(hashes) - {WINDOW}),
          i -> xxhash64({", ".join(f"hashes[i + {j}]" for j in range(WINDOW))})) END"""))
    ordered = windows.withColumn("sorted", F.expr("""
      CASE WHEN size(array_distinct(windows)) = size(windows) THEN null ELSE
        array_sort(transform(windows, (h, i) -> struct(h AS h, i AS p))) END"""))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return ordered.select(
        key,
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        _repeats().alias("n_repeat_words"),
        F.size(F.array_intersect(F.split(F.lower("text"), r"[\x20\x09-\x0D.,;:!?]+"), stop)).cast("double").alias("stop_words"),
    )


def compiled(rules=RULES) -> tuple[Column, Column]:
    """(all rules hold, names of the broken ones) as columns over the metrics."""
    broken = []
    for name, metric, least, most in rules:
        tests = ([F.col(metric) < least] if least is not None else []) + ([F.col(metric) > most] if most is not None else [])
        test = tests[0] if len(tests) == 1 else tests[0] | tests[1]
        broken.append((name, F.coalesce(test, F.lit(False))))
    names = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in broken]))
    good = F.lit(True)
    for _, t in broken:
        good = good & ~t
    return good, names


def judged(docs: DataFrame, rules=RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts, `base_failed`, `kept` and the names of the broken rules."""
    good, names = compiled(rules)
    n = F.expr("nullif(n_words, 0)")
    return (
        metrics(docs, text, key)
        .withColumn("mean_word_length", F.col("word_chars") / n)
        .withColumn("symbols_per_word", F.col("n_symbols") / n)
        .withColumn("dup_line_ratio", F.col("n_dup_lines") / F.expr("nullif(n_lines, 0)"))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & good)
        .withColumn("broken", names)
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP10_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS (
  SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 3)) AS p, words FROM parts WHERE len(words) >= 5),
keyed AS (SELECT doc_id, p, list_aggregate(words[p:p + 4], 'string_agg', ' ') AS k FROM windows),
again AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1),
covered AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM again) GROUP BY doc_id),
counted AS (
  SELECT doc_id, len(words) AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
    length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_intersect(list_distinct(regexp_split_to_array(lower(t), '[\x20\x09-\x0D.,;:!?]+')),
      [{", ".join(f"'{w}'" for w in STOP_WORDS)}]))::DOUBLE AS stop_words
  FROM parts LEFT JOIN covered USING (doc_id)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND NOT coalesce(word_chars / nullif(n_words, 0) < 1.5 OR word_chars / nullif(n_words, 0) > 30.0, false)
  AND NOT coalesce(n_symbols / nullif(n_words, 0) > 0.1, false)
  AND NOT stop_words < 1.0
  AND NOT coalesce(n_dup_lines / nullif(n_lines, 0) > 0.40, false) AS kept
FROM based
"""

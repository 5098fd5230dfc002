"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Each document's counts come from array functions of one row; a rule divides two counts and bounds the
ratio. No shuffle, no Python. Texts that are null count as empty; an empty text has zero counts and fails the
base rules. Rows are independent, so repeated ids and ties need no rule; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = "[#*$%&|<>]"
UPPER = "[A-Z]"
STOP_WORDS = sorted(set(
    "the of and to in is that for it as was with be by on not he this are or from at which a an "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des et un une du en que est pour dans par sur pas plus avec ce "
    "el los las y del se por una su con no para lo al como o".split()
))


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; a bound that is None is open, an empty denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        ratio = F.col(self.numerator) / F.nullif(F.col(self.denominator), F.lit(0))
        test = F.lit(True)
        if self.low is not None:
            test = test & (ratio >= self.low)
        if self.high is not None:
            test = test & (ratio <= self.high)
        return F.coalesce(test, F.lit(True))


#: The threshold table: word length, symbols, capitals, stop words, lines, repetition.
RULES = (
    Rule("word_length_low", "word_chars", "n_words", low=2.0),
    Rule("word_length_high", "word_chars", "n_words", high=12.0),
    Rule("symbols", "n_symbols", "word_chars", high=0.05),
    Rule("capitals", "n_upper", "word_chars", high=0.4),
    Rule("exclamations", "n_exclaim", "n_words", high=0.3),
    Rule("stop_words", "n_stop", "n_words", low=0.03),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.4),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.5),
)


def rule_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that rules use: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_upper, n_exclaim, n_stop (all long). Columns of these names in ``df`` are replaced; others stay, whatever their names.

    n_repeat_words is the number of words in three-word windows that occur twice or more in the text. Windows
    are compared by a 64-bit hash inside one document.
    """
    t, w, h, s, p = (F.col(c) for c in "twhsp")
    step = df.select(F.struct("*").alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    step = step.select(
        "row",
        F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "").alias("w"),
        F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("s"),
        *[F.regexp_count(t, F.lit(x)).cast("long").alias(c) for c, x in (("n_symbols", SYMBOLS), ("n_upper", UPPER), ("n_exclaim", "!"))],
    )
    done = ["n_symbols", "n_upper", "n_exclaim"]
    stop = [F.lit(x) for x in STOP_WORDS]
    window = lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))
    step = step.select(
        "row",
        *done,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(s).cast("long").alias("n_lines"),
        (F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(stop))).cast("long").alias("n_stop"),
        F.when(F.size(w) >= 3, F.transform(F.slice(w, F.lit(1), F.size(w) - 2), window)).alias("h"),
    )
    done += ["n_words", "word_chars", "n_lines", "n_dup_lines", "n_stop"]
    # Only documents with a repeated window sort their windows; the others stop here.
    pair = lambda x, i: F.struct(x.alias("h"), i.alias("i"))
    step = step.select(
        "row", *done, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, pair))).alias("s")
    )
    same = lambda x, i: (
        (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
    )
    step = step.select("row", *done, F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"])).alias("p"))
    start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate(
        p,
        start,
        lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(3), x - a["at"])).alias("n")),
        lambda a: a["n"],
    )
    # The counts leave by a generator of one row: a filter on them stays above it, where pushing it down would write
    # the nested array functions out once for every count that it reads.
    counts = F.struct(*done, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    kept = [c for c in df.columns if c not in COUNTS]
    return step.select("row", F.inline(F.array(counts))).select(*[F.col("row").getField(c).alias(c) for c in kept], *COUNTS)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_stop"]


def quality_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, least_words: int = 50, most_repeat_percent: int = 50) -> DataFrame:
    """Adds the counts, ``base_failed``, one boolean ``passes_<rule>`` for each rule, and ``kept``, in place of columns of the
    same names; other columns stay."""
    counts = rule_counts(df, text)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    verdict = ~failed
    for rule in rules:
        verdict = verdict & rule.holds()
    return counts.withColumns({"base_failed": failed, **{f"passes_{r.name}": r.holds() for r in rules}, "kept": verdict})


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rule_sql(rule: Rule) -> str:
    ratio = f"{rule.numerator}::DOUBLE / nullif({rule.denominator}, 0)"
    tests = [f"{ratio} >= {rule.low}"] * (rule.low is not None) + [f"{ratio} <= {rule.high}"] * (rule.high is not None)
    return f"coalesce({' AND '.join(tests)}, true)"


def rules_sql(source: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL of the same counts and verdict over ``source``."""
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM {source}
), a AS (
  SELECT doc_id, text,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
), grams AS (
  SELECT doc_id, w, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: [w[i], w[i+1], w[i+2]])) AS g,
    unnest(range(1, greatest(len(w) - 1, 1))) AS i
  FROM a
), repeated AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM repeated) GROUP BY doc_id
), counts AS (
  SELECT a.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
    length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclaim,
    len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    len(list_filter(w, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM a LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {' AND '.join(map(_rule_sql, rules))} AS kept
FROM counts"""


ORACLE = rules_sql()

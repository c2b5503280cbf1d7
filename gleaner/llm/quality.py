"""Quality rules: a table of thresholds compiled into one projection of built-in expressions.

Every metric is a count of regular expression matches or a length, over the whole text; a rule
bounds one metric from below or above and may hold only from a number of words on.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import col

STOP_WORDS = (
    *("the", "of", "and", "to", "in", "is", "that", "for", "with", "be", "it", "as", "was", "on"),
    *("der", "die", "das", "und", "ist", "nicht", "mit", "von", "zu", "ein", "eine", "auf", "für", "sich"),
    *("le", "la", "les", "des", "et", "de", "du", "un", "une", "que", "pour", "dans", "qui", "par"),
    *("el", "los", "las", "en", "del", "se", "por", "con", "para", "su", "al", "lo", "como", "y"),
)


class Rule(NamedTuple):
    """``metric`` must be at least or at most ``bound`` in texts of ``from_words`` words or more."""

    name: str
    metric: str
    side: str
    bound: float
    from_words: int = 0


RULES: Sequence[Rule] = (
    Rule("no_words", "n_words", "min", 1),
    Rule("short_words", "mean_word_chars", "min", 2.0),
    Rule("long_words", "mean_word_chars", "max", 14.0),
    Rule("symbols", "symbol_ratio", "max", 0.3),
    Rule("upper_case", "upper_ratio", "max", 0.4),
    Rule("no_letters", "wordless_ratio", "max", 0.45, 5),
    Rule("stop_words", "stop_ratio", "min", 0.02, 80),
    Rule("bullets", "bullet_ratio", "max", 0.9, 20),
    Rule("ellipses", "ellipsis_ratio", "max", 0.3, 20),
    Rule("same_lines", "same_line_ratio", "max", 0.6, 20),
)


def metrics(text: Column) -> dict[str, Column]:
    """The metrics by name. Words are runs without ASCII white space; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))

    def count(pattern: str, of: Column = text) -> Column:
        return F.regexp_count(of, F.lit(pattern)).cast("double")

    n_words, n_lines = count("\\S+"), count("\n") + 1
    per_word, per_line = F.greatest(n_words, F.lit(1.0)), n_lines
    inside = F.length(text) - count("\\s")
    return {
        "n_words": n_words,
        "mean_word_chars": inside / per_word,
        "symbol_ratio": count("[#$%&*|{}<>=~^\\\\]") / per_word,
        "upper_ratio": count("\\p{Lu}") / F.greatest(inside, F.lit(1.0)),
        "wordless_ratio": count("(?<!\\S)[^\\s\\p{L}]++(?!\\S)") / per_word,
        "stop_ratio": count(f"(?<!\\S)(?:{'|'.join(STOP_WORDS)})(?!\\S)", F.lower(text)) / per_word,
        "bullet_ratio": count("(?md)^[ \\t]*+[-*•]") / per_line,
        "ellipsis_ratio": count("(?md)(?:\\.\\.\\.|…)[ \\t]*+$") / per_line,
        "same_line_ratio": 1 - F.size(F.array_distinct(F.split(text, "\n", -1))) / per_line,
    }


def with_quality(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs``, the metrics rounded to six places, the broken rules' names joined by commas
    (``failed``), and whether there are none (``keep``).

    A rule of an unknown metric or side is an error; no rules keep everything. A null text is
    judged as an empty one. Long texts count whole; repeated rows stay, each with the same verdict; a metric equal to its bound
    breaks no rule; an empty table stays empty. Columns with the names of added ones are replaced: ``prefix`` avoids that."""
    for r in rules:
        if r.side not in ("min", "max"):
            raise ValueError(f"rule {r.name}: {r.side!r} is neither min nor max")
    all_metrics = metrics(col(text_col))
    values = {f"{prefix}{k}": F.round(v, 6) for k, v in all_metrics.items()}
    measured = docs.withColumns(values)

    def broken(r: Rule) -> Column:
        at, words = col(f"{prefix}{r.metric}"), col(f"{prefix}n_words")
        beyond = at < F.lit(float(r.bound)) if r.side == "min" else at > F.lit(float(r.bound))
        return F.when(beyond & (words >= r.from_words), F.lit(r.name))

    failed = F.concat_ws(",", *[broken(r) for r in rules]) if rules else F.lit("")
    return measured.withColumn(f"{prefix}failed", failed).withColumn(f"{prefix}keep", col(f"{prefix}failed") == "")


def rules_of(table: DataFrame) -> list[Rule]:
    """The rules of a table of thresholds ``(name, metric, side, bound, from_words)``, which is as
    small as a setting."""
    return [Rule(r["name"], r["metric"], r["side"], float(r["bound"]), int(r["from_words"] or 0)) for r in table.collect()]


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics, broken rules and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_quality(docs).drop("text")


_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_FAILED = ", ".join(f"CASE WHEN {r.metric} {'<' if r.side == 'min' else '>'} {r.bound} AND n_words >= {r.from_words} THEN '{r.name}' END" for r in RULES)
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\v]+'), lambda w: w <> '') AS ws,
  string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
n AS (SELECT *, CAST(len(ws) AS DOUBLE) AS n_words, CAST(len(ls) AS DOUBLE) AS n_lines, greatest(len(ws), 1) AS pw,
  length(regexp_replace(text, '[ \t\n\r\f\v]', '', 'g')) AS inside FROM d),
m AS (SELECT doc_id, round(n_words, 6) AS n_words, round(inside / pw, 6) AS mean_word_chars,
  round(length(regexp_replace(text, '[^#$%&*|{{}}<>=~^\\]', '', 'g')) / pw, 6) AS symbol_ratio,
  round(length(regexp_replace(text, '\P{{Lu}}', '', 'g')) / greatest(inside, 1), 6) AS upper_ratio,
  round(len(list_filter(ws, lambda w: NOT regexp_matches(w, '\p{{L}}'))) / pw, 6) AS wordless_ratio,
  round(len(list_filter(string_split(regexp_replace(lower(text), '[ \t\n\r\f\v]', ' ', 'g'), ' '), lambda w: w IN ({_STOPS}))) / pw, 6) AS stop_ratio,
  round(len(list_filter(ls, lambda l: regexp_matches(l, '^[ \t]*[-*•]'))) / n_lines, 6) AS bullet_ratio,
  round(len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)[ \t]*$'))) / n_lines, 6) AS ellipsis_ratio,
  round(1 - len(list_distinct(ls)) / n_lines, 6) AS same_line_ratio FROM n)
SELECT *, concat_ws(',', {_FAILED}) AS failed, concat_ws(',', {_FAILED}) = '' AS keep FROM m
"""

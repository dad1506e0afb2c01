"""Quality rules: a threshold table compiled into one Spark projection.

Every rule bounds a ratio ``100 * numerator / denominator`` of counts taken from the whole text;
comparisons are made on integers (cross-multiplied), so no rounding decides a document. All
counting is done by built-in functions. Defined results: a null text has no words, so it fails
the base rule and is not kept; so does an empty one. Repeated rows each get their own result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tabsight.llm.common import packed

# The commonest function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in a is that it was for on with as by at be this are or an not from have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un une du dans est que qui pour pas sur au par il ce ne se plus".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más".split(),
}


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * numerator / denominator <= high``; a missing bound does not bind, and a
    rule whose denominator is 0 passes."""

    name: str
    numerator: str
    denominator: str
    low: int | None = None
    high: int | None = None

    def sql(self) -> str:
        """The test in SQL that Spark and other engines read alike."""
        tests = [f"100 * {self.numerator} >= {self.low} * {self.denominator}"] if self.low is not None else []
        tests += [f"100 * {self.numerator} <= {self.high} * {self.denominator}"] if self.high is not None else []
        return "(" + " AND ".join(tests) + ")"


BASE_RULES = (
    Rule("words", "n_words", "1", low=5000),
    Rule("repeated_words", "n_repeat_words", "n_words", high=50),
)
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=200, high=1400),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("stop_words", "n_stop_words", "n_words", low=4),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=70),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90),
)

_SYMBOLS = "#*$%&|<>"


def _without(column: str, characters: list[str]) -> str:
    for c in characters:
        column = f"replace({column}, {c})"
    return column


def measure(docs: DataFrame, text: str = "text", stop_words: dict[str, list[str]] = STOP_WORDS) -> DataFrame:
    """``docs`` packed into ``__row`` beside the counts that the rules compare: word_chars,
    n_words, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_stop_words,
    n_ellipsis_lines and n_bullet_lines."""
    blanks = ["' '", "'\\t'", "'\\n'", "'\\u000B'", "'\\u000C'", "'\\r'"]
    stops = ", ".join(f"'{w}'" for w in sorted({w for words in stop_words.values() for w in words}))
    parts = packed(docs, __text=text).withColumn("__text", F.coalesce(F.col("__text"), F.lit("")))
    parts = parts.select(
        "__row",
        F.expr(f"char_length({_without('__text', blanks)})").alias("word_chars"),
        F.expr(f"char_length(__text) - char_length({_without('__text', [repr(c) for c in _SYMBOLS])})")
        .alias("n_symbols"),
        F.expr(r"filter(split(__text, '[\\x20\\x09-\\x0D]+'), w -> w != '')").alias("__words"),
        F.expr(r"filter(split(__text, '\\n'), l -> trim(BOTH ' \t\u000B\u000C\r' FROM l) != '')").alias("__lines"),
    )
    parts = parts.select(
        "__row",
        F.col("word_chars").cast("long"),
        F.col("n_symbols").cast("long"),
        F.size("__words").cast("long").alias("n_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.expr("cast(size(__lines) - size(array_distinct(__lines)) as long)").alias("n_dup_lines"),
        F.expr(f"cast(size(filter(__words, w -> lower(rtrim('.,', w)) IN ({stops}))) as long)").alias("n_stop_words"),
        F.expr("cast(size(filter(__lines, l -> endswith(l, '...') OR endswith(l, '…'))) as long)")
        .alias("n_ellipsis_lines"),
        F.expr("cast(size(filter(__lines, l -> startswith(ltrim(l), '- ') OR startswith(ltrim(l), '* ')"
               " OR startswith(ltrim(l), '•'))) as long)").alias("n_bullet_lines"),
        # the 3-word windows in order, each with the place of its first word
        F.expr("CASE WHEN size(__words) > 3 THEN sort_array(transform(sequence(0, size(__words) - 3), i -> "
               "struct(concat_ws(' ', get(__words, i), get(__words, i + 1), get(__words, i + 2)) AS g, i AS i))) "
               "ELSE array() END").alias("__grams"),
    )
    parts = parts.withColumn("__places", F.expr(
        "CASE WHEN size(__grams) > 1 THEN sort_array(transform(filter(sequence(0, size(__grams) - 1), "
        "j -> get(__grams, j).g = coalesce(get(__grams, j - 1).g, '') "
        "OR get(__grams, j).g = coalesce(get(__grams, j + 1).g, '')), j -> get(__grams, j).i)) "
        "ELSE array() END"))
    # a window adds the words that the window before it has not covered, at most three
    covered = F.expr("aggregate(__places, struct(0L AS n, -3 AS at), "
                     "(a, p) -> struct(a.n + least(3, p - a.at) AS n, p AS at), a -> a.n)")
    return parts.withColumn("n_repeat_words", covered).drop("__grams", "__places")


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES,
          base_rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """:func:`measure` plus ``base_failed``, ``failed_rules`` (names) and ``kept``."""
    base = " AND ".join(r.sql() for r in base_rules) or "true"
    own = " AND ".join(r.sql() for r in rules) or "true"
    failed = F.array_compact(F.array(*[F.when(~F.expr(r.sql()), F.lit(r.name)) for r in (*base_rules, *rules)]))
    return (measure(docs, text)
            .withColumns({"base_failed": ~F.expr(base), "failed_rules": failed})
            .withColumn("kept", ~F.col("base_failed") & F.expr(own)))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass every rule, with their own columns.

    Rejected rows leave through an empty array: a filter would be pushed below the steps of
    :func:`measure`, which copies their expressions into each other."""
    return judge(docs, text).select(F.inline(F.when(F.col("kept"), F.array("__row"))))


# DuckDB SQL of the query's digest
def oracle_sql(rules: tuple[Rule, ...] = RULES, base_rules: tuple[Rule, ...] = BASE_RULES) -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for words in STOP_WORDS.values() for w in words}))
    base, own = " AND ".join(r.sql() for r in base_rules), " AND ".join(r.sql() for r in rules)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT r, unnest(range(len(ws) - 2)) AS i,
             unnest(list_transform(range(1, len(ws) - 1), lambda k: ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2])) AS g
      FROM w WHERE len(ws) > 2),
twice AS (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1),
places AS (SELECT DISTINCT r, i + d AS p FROM g JOIN twice USING (r, g), (SELECT unnest(range(3)) AS d)),
rep AS (SELECT r, count(*) AS n FROM places GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words,
             length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words,
             len(list_filter(ws, lambda a: lower(rtrim(a, '.,')) IN ({stops}))) AS n_stop_words,
             len(list_filter(ls, lambda l: ends_with(l, '...') OR ends_with(l, '…'))) AS n_ellipsis_lines,
             len(list_filter(ls, lambda l: starts_with(ltrim(l), '- ') OR starts_with(ltrim(l), '* ')
                                      OR starts_with(ltrim(l), '•'))) AS n_bullet_lines
      FROM w LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       NOT ({base}) AS base_failed, ({base}) AND ({own}) AS kept FROM m
"""

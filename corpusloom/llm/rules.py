"""Quality rules: a table of thresholds compiled into one projection.

Every figure is an expression over the words and lines of a text, every rule a
comparison of two figures in whole numbers, so the verdict has no rounding.
There is no shuffle and no Python: one pass over the text, row by row.

Edge cases: a null or empty text has no words, all its counts are 0 and it fails
``min_words``; rows are judged one by one, so repeated rows and null ids stay as
they are; an empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.registry import query, table

#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "be",
    "der", "die", "und", "das", "ist", "nicht", "ein", "eine", "mit", "von", "zu", "den", "auf",
    "le", "la", "les", "et", "de", "un", "une", "des", "du", "que", "pour", "dans", "sur", "par",
    "el", "los", "las", "y", "en", "por", "con", "una", "se", "no", "es", "para", "del",
)


@dataclass(frozen=True)
class Rule:
    """Passes if ``scale * figure`` isn't beyond ``limit * base``, or if ``only`` doesn't pass."""

    name: str
    figure: str
    side: str  # "most" or "least"
    limit: int
    base: str | None = None
    scale: int = 1
    only: Rule | None = None

    def failed(self) -> Column:
        left = F.lit(self.scale).cast("long") * F.col(self.figure)
        right = F.lit(self.limit).cast("long") * (F.col(self.base) if self.base else F.lit(1))
        beyond = left > right if self.side == "most" else left < right
        return beyond if self.only is None else beyond & ~self.only.failed()


BASE_RULES = (
    Rule("min_words", "n_words", "least", 50),
    Rule("repeated_words", "n_repeat_words", "most", 50, "n_words", 100),
)
#: Short texts repeat a line easily, so the strict ratio takes ten lines. Stop words are listed for
#: languages in Latin letters: a text that is mostly beyond ASCII has none of them to show.
MANY_LINES = Rule("many_lines", "n_lines", "least", 10)
LISTED_SCRIPT = Rule("listed_script", "n_beyond_ascii", "most", 50, "word_chars", 100)
METHOD_RULES = (
    Rule("symbols", "n_symbols", "most", 10, "n_words", 100),
    Rule("repeated_lines", "n_dup_lines", "most", 70, "n_lines", 100),
    Rule("repeated_lines_of_many", "n_dup_lines", "most", 30, "n_lines", 100, MANY_LINES),
    Rule("stop_words", "n_stop_words", "least", 2, "n_words", 100, LISTED_SCRIPT),
    Rule("short_words", "word_chars", "least", 2, "n_words"),
    Rule("long_words", "word_chars", "most", 20, "n_words"),
)
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           "n_lines", "n_stop_words", "n_beyond_ascii")

_SPACE = r"[\\x20\\x09-\\x0D]+"


def any_failed(rules: Sequence[Rule]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | rule.failed()
    return out


def figures(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text",
            stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``keep`` and the counts named in ``FIGURES``."""
    ids = [f"_k{i}" for i in range(len(keep))]
    stops = ", ".join(f"'{w}'" for w in stop_words)
    source = docs.select(*[F.col(c).alias(i) for c, i in zip(keep, ids, strict=True)],
                         F.coalesce(F.col(text), F.lit("")).alias("_t"))
    split = source.selectExpr(
        *ids, "_t", f"array_remove(split(_t, '{_SPACE}'), '') AS _w",
        "filter(split(_t, '\\n', -1), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]') AS _l")
    windows = split.selectExpr(
        "*", """CASE WHEN size(_w) < 3 THEN array() ELSE
                  zip_with(zip_with(slice(_w, 1, size(_w) - 2), slice(_w, 2, size(_w) - 2),
                                    (a, b) -> concat_ws(' ', a, b)),
                           slice(_w, 3, size(_w) - 2), (a, b) -> concat_ws(' ', a, b)) END AS _g""")
    # Where a window repeats, sort the windows with their starts: equal ones become neighbours.
    sorted_windows = windows.selectExpr(
        *ids, "_t", "_w", "_l", """CASE WHEN size(array_distinct(_g)) = size(_g) THEN array()
                  ELSE sort_array(transform(_g, (g, i) -> struct(g AS g, i AS i))) END AS _s""")
    starts = """flatten(filter(zip_with(slice(_s, 1, size(_s) - 1), slice(_s, 2, size(_s) - 1),
                  (a, b) -> IF(a.g = b.g, array(a.i, b.i), NULL)), x -> x IS NOT NULL))"""
    covered = f"""CASE WHEN size(_s) < 2 THEN 0 ELSE size(array_distinct(flatten(transform(
                  array_distinct({starts}), i -> array(i, i + 1, i + 2))))) END"""
    return sorted_windows.selectExpr(
        *[f"{i} AS `{c}`" for c, i in zip(keep, ids, strict=True)],
        "CAST(size(_w) AS BIGINT) AS n_words",
        "CAST(length(array_join(_w, '')) AS BIGINT) AS word_chars",
        "CAST(regexp_count(_t, '[#*$%&|<>]') AS BIGINT) AS n_symbols",
        "CAST(size(_l) - size(array_distinct(_l)) AS BIGINT) AS n_dup_lines",
        f"CAST({covered} AS BIGINT) AS n_repeat_words",
        "CAST(size(_l) AS BIGINT) AS n_lines",
        f"CAST(size(filter(_w, x -> lower(x) IN ({stops}))) AS BIGINT) AS n_stop_words",
        "CAST(regexp_count(_t, '[^\\\\x00-\\\\x7F]') AS BIGINT) AS n_beyond_ascii")


def quality_rules(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text",
                  base: Sequence[Rule] = BASE_RULES,
                  rules: Sequence[Rule] = METHOD_RULES) -> DataFrame:
    """``keep``, the figures, ``base_failed``, ``failed_rules`` (names) and ``kept``."""
    counted = figures(docs, keep, text)
    names = F.array_compact(F.array(*[F.when(r.failed(), F.lit(r.name)) for r in (*base, *rules)]))
    return counted.select(
        *counted.columns, any_failed(base).alias("base_failed"), names.alias("failed_rules"),
        (~any_failed([*base, *rules])).alias("kept"))


_SQL_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
      FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + o) AS n FROM r, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS wc,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
        len(list_filter(w, lambda x: lower(x) IN ({_SQL_STOPS})))::BIGINT AS n_stop_words,
        len(regexp_extract_all(t, '[^\x00-\x7F]'))::BIGINT AS n_beyond_ascii
      FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, coalesce(wc, 0) AS word_chars,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 70 * n_lines
       OR (n_lines >= 10 AND 100 * n_dup_lines > 30 * n_lines)
       OR (100 * n_beyond_ascii <= 50 * word_chars AND 100 * n_stop_words < 2 * n_words) OR word_chars < 2 * n_words
       OR word_chars > 20 * n_words) AS kept
FROM b"""


@query("op2_quality_rules", _SQL)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept")

"""Operator 3: quality rules as one Spark projection.

``RULES`` is the threshold table: a measure with its least and greatest allowed value.  It is
compiled, with the measures, into column expressions; nothing leaves the JVM.

Defined cases: a null text is the empty text: no words, all measures zero, base_failed and not
kept; ratios of wordless texts are zero; repeated rows get equal results; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in a window, fewest words of a text and most hundredths of its words in repeated windows.
WINDOW, LEAST_WORDS, REPEATED_PERCENT = 8, 20, 30
#: Frequent words of the corpus' languages.
STOP_WORDS = (
    "the of and to in is that for with was are this on as at be from it or an by not have he you but they his her which "
    "der die das und ist ein eine von zu mit den nicht dem für auf im des sich auch es an werden aus er hat dass sie nach wird bei "
    "le la les de un une et en est que pour dans au du il qui ne sur se pas plus par je avec tout faire son ce mais "
    "el los las y por con para su no lo como más pero sus al ya o este sí porque esta entre cuando muy sin sobre también me hasta hay"
).split()
#: measure: (least, greatest); None: no bound.
RULES: dict[str, tuple[float | None, float | None]] = {
    "mean_word_chars": (2.0, 12.0),
    "symbol_ratio": (None, 0.1),
    "stop_word_ratio": (0.02, None),
    "dup_line_ratio": (None, 0.5),
}

_SPACE = r"[ \t-\r]"
_SPACES = " \t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _repeated(hashes: Column) -> Column:
    """Words in windows that occur more than once, from the words' hashes."""

    def of_windows(w: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            n = F.size(s)
            twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < n - 1) & (F.get(s, k + 1)["h"] == x["h"])))
            places = F.array_sort(F.transform(twice, lambda x: x["i"]))
            covered = lambda p: F.aggregate(F.transform(p, lambda v, k: F.coalesce(F.least(F.lit(WINDOW), F.get(p, k + 1) - v), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
            # least() skips nulls, so the last place counts a whole window.
            return _let(places, covered)

        marked = F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_let(F.array_sort(marked), of_sorted))

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - F.lit(WINDOW)), lambda i: F.xxhash64(*[F.get(h, i + F.lit(k)) for k in range(WINDOW)]))

    return F.when(F.size(hashes) < WINDOW, F.lit(0)).otherwise(_let(hashes, lambda h: _let(windows(h), of_windows)))


def measures(text: Column) -> dict[str, Column]:
    """Expressions of the base measures of a text."""
    body = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(body, F.lit(_SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{_SPACE}+"))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    return {"words": words, "lines": lines, "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long")}


def verdict(values: dict[str, Column]) -> Column:
    """The threshold table as one condition."""
    out = F.lit(True)
    for name, (least, greatest) in RULES.items():
        if least is not None:
            out = out & (values[name] >= F.lit(float(least)))
        if greatest is not None:
            out = out & (values[name] <= F.lit(float(greatest)))
    return out


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the ratios."""
    m = measures(F.col(text_col).cast("string"))
    cut = docs.select(F.col(id_col).alias("_id"), m["words"].alias("_words"), m["lines"].alias("_lines"), m["n_symbols"].alias("n_symbols"))
    base = cut.select(
        "_id",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.transform("_words", lambda w: F.xxhash64(w))).cast("long").alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: w.isin(STOP_WORDS))).cast("long").alias("_n_stop"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))
    values = {"mean_word_chars": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "n_words"), "stop_word_ratio": ratio("_n_stop", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "_n_lines")}
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return base.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(values)).alias("kept"), *[v.alias(k) for k, v in values.items()],
    )


def _sql_rules() -> str:
    of = {"mean_word_chars": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "stop_word_ratio": ("n_stop", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines")}
    parts = []
    for name, (least, greatest) in RULES.items():
        value = "CASE WHEN {1} > 0 THEN CAST({0} AS DOUBLE) / {1} ELSE CAST(0 AS DOUBLE) END".format(*of[name])
        parts += [f"{value} {op} CAST({x!r} AS DOUBLE)" for op, x in ((">=", least), ("<=", greatest)) if x is not None]
    return " AND ".join(parts)


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(len(list_filter(ws, lambda x: list_contains([{", ".join("'" + w + "'" for w in STOP_WORDS)}], x))) AS BIGINT) AS n_stop FROM w),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW}),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + {WINDOW - 1}), ' ') AS k FROM s),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g),
p AS (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS c FROM r WHERE n > 1),
q AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_repeat_words FROM p GROUP BY doc_id),
f AS (SELECT m.*, coalesce(q.n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN q USING (doc_id)),
b AS (SELECT *, (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {_sql_rules()}) AS kept FROM b
"""

"""Quality rules: one threshold table compiled into one Spark projection.

The metrics are built-in expressions on the text column and every rule is an
integer comparison ``scale * numerator <op> limit * denominator``, so the whole
operator is a map-only projection without user functions.

Defined cases: a NULL or blank text has no words (all metrics 0) and fails
``min_words``; very long texts are evaluated whole; repeated rows and ties are
independent rows; every input column is kept and the operator's own working
columns live inside one struct (default ``quality``), so clashing names in the
input are harmless.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = "!?"

#: Common function words of the corpus languages (en, de, fr, es), fixed values.
STOP_WORDS = tuple("""
the of and to in that is for with on as by at from was this are it not or
der die das und den dem von zu mit ist auf für nicht ein eine im des auch als
le la les des de et un une en est que dans pour pas sur qui au aux du ne
el los las del y que en un una por con para se no lo es su
""".split())


class Rule(NamedTuple):
    """Passes when ``scale * metric`` is within [low, high] times ``per``."""
    name: str
    metric: str
    per: str | None
    scale: int
    low: int | None
    high: int | None


#: The first two rules are the base; the others are the method's verdict.
THRESHOLDS = (
    Rule("min_words", "n_words", None, 1, 50, None),
    Rule("repeated_words", "n_repeat_words", "n_words", 100, None, 50),
    Rule("word_length", "word_chars", "n_words", 1, 3, 10),
    Rule("symbol_ratio", "n_symbols", "n_words", 100, None, 10),
    Rule("mark_ratio", "n_marks", "n_words", 100, None, 30),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 100, 2, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 100, None, 50),
)
BASE_RULES = ("min_words", "repeated_words")


def _let(value: Column, body) -> Column:
    """Bind an expression once: inside ``body`` it is evaluated a single time."""
    return F.transform(F.array(value), body)[0]


def _chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice (first included).

    Only texts in which some window hash repeats pay for the sort; equality is
    decided on the words themselves.
    """
    last = F.size(w) - 3
    at = F.sequence(F.lit(0), last)
    hashes = F.transform(at, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(s):
        def same(j, k):
            a, b = F.get(s, j), F.get(s, k)
            return F.coalesce((a["h"] == b["h"]) & (a["a"] == b["a"])
                              & (a["b"] == b["b"]) & (a["c"] == b["c"]), F.lit(False))
        pos = F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1),
                                   lambda j: F.when(same(j, j - 1) | same(j, j + 1), s[j]["i"])),
                       lambda x: x.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(pos, lambda i: F.array(i, i + 1, i + 2)))))

    windows = F.sort_array(F.transform(at, lambda i: F.struct(
        F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), w[i].alias("a"),
        w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i"))))
    some = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(last < 1, F.lit(0)).when(some, _let(windows, covered)).otherwise(F.lit(0)).cast("long")


def metrics(text: Column) -> Column:
    """Struct of all metrics of one text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD))
    of_words = _let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        _repeat_words(w).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(of_words.alias("w"), of_lines.alias("l"),
                    F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
                    _chars(text, SYMBOLS).alias("n_symbols"), _chars(text, MARKS).alias("n_marks"))


def _passes(rule: Rule, m) -> Column:
    value = m(rule.metric) * rule.scale
    per = m(rule.per) if rule.per else F.lit(1)
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (value >= per * rule.low)
    if rule.high is not None:
        ok = ok & (value <= per * rule.high)
    return ok


def quality(df: DataFrame, text_col: str = "text", out: str = "quality",
            rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """Add one struct column with the metrics, the failed rules and the verdict."""
    if out in df.columns:
        raise ValueError(f"the input already has a column {out!r}; name another one with out=")

    def judged(q):
        place = {"n_words": q["w"]["n_words"], "n_stop_words": q["w"]["n_stop_words"],
                 "n_repeat_words": q["w"]["n_repeat_words"], "n_lines": q["l"]["n_lines"],
                 "n_dup_lines": q["l"]["n_dup_lines"]}

        def m(name):
            return place.get(name, q[name] if name not in place else None)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "n_stop_words", "n_marks", "n_lines")
        failed = F.array_compact(F.array(*[F.when(~_passes(r, m), F.lit(r.name)) for r in rules]))
        base = [~_passes(r, m) for r in rules if r.name in BASE_RULES]
        base_failed = F.lit(False)
        for b in base:
            base_failed = base_failed | b
        return F.struct(*[m(n).alias(n) for n in names], failed.alias("failed"),
                        base_failed.alias("base_failed"), (F.size(failed) == 0).alias("kept"))

    return df.withColumn(out, _let(metrics(F.col(text_col)), judged))


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text passes every rule, with the input's columns."""
    out = "_quality"
    while out in df.columns:
        out += "_"
    return quality(df, text_col, out).where(F.col(out)["kept"]).drop(out)


_W = r"regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+')"

ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter({_W}, lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT rid, i, list_slice(w, i, i + 2) AS gram
      FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat
      FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: list_contains([{", ".join(f"'{s}'" for s in STOP_WORDS)}], lower(x))))::BIGINT AS n_stop_words,
    (length(t) - length(regexp_replace(t, '[!?]', '', 'g')))::BIGINT AS n_marks,
    len(l)::BIGINT AS n_lines
  FROM d LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words
   AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND 100 * n_symbols <= 10 * n_words
   AND 100 * n_marks <= 30 * n_words AND 100 * n_stop_words >= 2 * n_words
   AND 100 * n_dup_lines <= 50 * n_lines) AS kept,
  n_stop_words, n_marks, n_lines
FROM m
"""

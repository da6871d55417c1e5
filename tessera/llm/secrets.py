"""Secret scan: fixed patterns plus a battery of randomness tests.

Base kinds (``assign``, ``access``, ``hex``) are regular expressions; spans come
from ``split`` and ``regexp_extract_all`` alone. The kind ``random`` adds long
unbroken tokens that look machine-made. For each the encoding (alphabet of k
characters) is inferred and three statistics are taken:

* chi-squared uniformity over the alphabet,
* Wald-Wolfowitz runs around the middle of the alphabet,
* lag-1 serial correlation of the character indices.

A token must pass all three as "random" (|z| below ``BATTERY_Z``), and two
hypotheses must be rejected, so its p-value is the larger of theirs:

* "letters of prose, written in this alphabet": the chi-squared statistic is
  compared with its non-central distribution under the letter frequencies of
  prose, and the number of character-class changes with the rate of prose; both
  z are combined (Stouffer);
* "an identifier of joined words" (camel case, paths, trailing numbers): the
  likelihood ratio of uniform characters against word letters, alternating vowels
  and consonants, and word boundaries. One over the ratio is a p-value at any length (Markov's
  inequality), so no normal tail is needed. Alphabets without letters skip it.

Rejection is decided over the whole corpus by a weighted Benjamini-Hochberg
procedure whose weights grow with the token length (longer tokens carry more
evidence), on a histogram of log p-values with a fixed number of bins.

Only DataFrame / SQL functions run. Two scans of the text: the histogram, then
the spans; nothing is shuffled but the histogram (at most ``BINS`` rows).

Defined cases: NULL and empty texts have no spans; positions are code points;
spans of kind ``random`` never overlap base spans; a corpus without candidates
accepts none; every row is judged alone, so repeated rows get equal results.
Input columns are kept; the result lives in one struct (default ``secrets``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and the shortest match each of them keeps.
ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
KINDS = ("assign", "access", "hex", "random")

#: Letters of prose, percent, a to z (fixed values: usual English frequencies).
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9,
           0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Encodings in the order they are tried: name, full-match pattern, alphabet.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", DIGITS),
    ("hex", r"^[0-9a-f]+$", DIGITS + LOWER[:6]),
    ("hex_upper", r"^[0-9A-F]+$", DIGITS + UPPER[:6]),
    ("lower", r"^[a-z]+$", LOWER),
    ("upper", r"^[A-Z]+$", UPPER),
    ("base32", r"^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", r"^[a-z0-9]+$", DIGITS + LOWER),
    ("base62", r"^[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    ("base64", r"^[A-Za-z0-9+/_-]+$", DIGITS + UPPER + LOWER + "+/_-"),
)
MIN_TOKEN = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % MIN_TOKEN
BATTERY_Z = 3.7          # two-sided 2e-4 per test
CLASS_CHANGE = 0.05      # prose: character-class changes per character
WORD_BREAK = 0.25        # identifiers: word boundaries per character
PATH_BREAK = 0.35        # the same where the alphabet has separators (both sides of one count)
ABBREVIATED = 0.15       # share of identifier letters that follow no prose frequency
VOWELS, VOWEL_PAIR = "aeiou", 0.15  # identifiers: share of vowels that follow a vowel
BOUNDARY = (r"(?<=[a-z])(?![a-z])(?=.)|(?<=[0-9])(?![0-9])(?=.)|(?<=[A-Z])(?![A-Za-z])(?=.)"
            r"|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[+/_-])(?=[A-Za-z0-9])")
FDR = 0.01
BINS, PER_DECADE = 400, 10
MASK = "[SECRET]"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _prose_divergence(alphabet: str) -> float:
    """k * sum(p^2) - 1 for prose letters restricted to the alphabet (decimal: 1)."""
    p = [LETTERS[ord(c.lower()) - 97] for c in alphabet if c.isalpha()]
    if not p:
        return 1.0
    single = p if len({c.lower() for c in alphabet if c.isalpha()}) == len(p) else p[:26]
    total = sum(single)
    return len(alphabet) * sum((x / total) ** 2 for x in single) - 1.0


def _letter_evidence(alphabet: str) -> list[float]:
    """log10 of uniform over identifier frequency, per character; 0 for digits and separators."""
    distinct = len({c.lower() for c in alphabet if c.isalpha()})
    total = sum(LETTERS)
    return [math.log10(1 / distinct / ((1 - ABBREVIATED) * LETTERS[ord(c.lower()) - 97] / total + ABBREVIATED / 26))
            if c.isalpha() else 0.0 for c in alphabet]


def _break_evidence(alphabet: str) -> tuple[float, float]:
    """log10 of uniform over identifier odds of a word boundary, and of none, between two characters."""
    k = len(alphabet)
    digit, upper, lower = (sum(map(f, alphabet)) / k for f in (str.isdigit, str.isupper, str.islower))
    other = max(0.0, 1 - digit - upper - lower)
    seen = (lower * (1 - lower) + digit * (1 - digit) + upper * (digit + other) + upper * upper * lower
            + other * (1 - other))
    if seen < 1e-9:
        return 0.0, 0.0
    word = PATH_BREAK if other > 1e-9 else WORD_BREAK
    return math.log10(seen / word), math.log10((1 - seen) / (1 - word))


def _pair_evidence() -> tuple[float, ...]:
    """log10 of independent over alternating, per pair of neighbours (consonant, vowel, no letter): 3 x 3."""
    vowel = sum(LETTERS[ord(c) - 97] for c in VOWELS) / sum(LETTERS)
    after_consonant = vowel * (1 - VOWEL_PAIR) / (1 - vowel)  # the share that keeps the vowel frequency
    return (math.log10((1 - vowel) / (1 - after_consonant)), math.log10(vowel / after_consonant), 0.0,
            math.log10((1 - vowel) / (1 - VOWEL_PAIR)), math.log10(vowel / VOWEL_PAIR), 0.0, 0.0, 0.0, 0.0)


def _starts(lens: Column) -> Column:
    """Exclusive prefix sums of an int array, two levels so long arrays stay near-linear."""
    block = 256
    zero = F.lit(0)

    def total(part):
        return F.aggregate(part, zero, lambda a, x: a + x)

    def within(x, heads):
        return F.transform(F.sequence(zero, F.size(x) - 1), lambda i: heads[F.floor(i / block).cast("int")]
                           + total(F.slice(x, F.floor(i / block).cast("int") * block + 1, i % block)))

    return _let(lens, lambda x: _let(
        F.transform(F.sequence(zero, F.floor((F.size(x) - 1) / block).cast("int")),
                    lambda b: total(F.slice(x, F.lit(1), b * block))),
        lambda heads: within(x, heads)))


SPAN = "array<struct<start:int,end:int,kind:string,rank:int>>"
_EMPTY = F.array


def _matches(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans of the pattern, in order; ``keep(i, match)`` drops failing ones."""
    rank = KINDS.index(kind)

    def spans(m):
        lens = F.zip_with(F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), F.length), m,
                          lambda s, x: F.struct(s.alias("gap"), F.length(x).alias("n")))
        return _let(lens, lambda z: _let(
            _starts(F.transform(z, lambda x: x["gap"] + x["n"])),
            lambda at: F.transform(m, lambda x, i: F.struct(
                (at[i] + z[i]["gap"]).cast("int").alias("start"),
                (at[i] + z[i]["gap"] + z[i]["n"]).cast("int").alias("end"),
                F.lit(kind).alias("kind"), F.lit(rank).alias("rank")))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    out = _let(found, lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(F.array().cast(SPAN)))
    if keep is not None:
        out = keep(out)
    return out


def base_spans(text: Column) -> Column:
    def long_values(spans):
        values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
        return _let(spans, lambda s: F.when(F.size(s) == 0, s).otherwise(_let(
            values, lambda v: F.filter(s, lambda x, i: F.length(v[i]) >= MIN_VALUE))))

    return F.concat(_matches(text, ASSIGN, "assign", long_values),
                    _matches(text, ACCESS, "access"), _matches(text, HEX, "hex"))


#: Chebyshev coefficients of log(erfc(x) / t) + x^2, t = 1 / (1 + x / 2), constant term first.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
        -0.82215223, 0.17087277)


def _phi(z: Column) -> Column:
    """Normal distribution function; relative error below 2e-7 in the lower tail too."""
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = 1 / (1 + x / 2)
    poly = F.lit(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = poly * t + c
    tail = t * F.exp(poly - x * x) / 2
    return F.when(z <= 0, tail).otherwise(1 - tail)


def token_tests(token: Column) -> Column:
    """Struct of the battery for one token: encoding, n, z of each test, log10 p against prose."""
    enc = F.coalesce(*[F.when(token.rlike(p), F.lit(i)) for i, (_, p, _) in enumerate(ENCODINGS)])
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("alphabet"),
                               F.lit(float(len(a))).alias("k"), F.lit(_prose_divergence(a)).alias("d"),
                               F.lit(len({c.isdigit() + 2 * c.isupper() for c in a}) > 1).alias("classes"),
                               F.lit(any(map(str.isalpha, a))).alias("letters"),
                               F.array(*map(F.lit, _letter_evidence(a))).alias("letter"),
                               F.array(*[F.lit(int(c.lower() in VOWELS) if c.isalpha() else 2) for c in a])
                               .alias("sound"),
                               F.lit(_break_evidence(a)[0]).alias("broken"),
                               F.lit(_break_evidence(a)[1]).alias("joined"))
                      for n, _, a in ENCODINGS])
    pairs = F.array(*map(F.lit, _pair_evidence()))

    def tests(e):
        n = F.length(token).cast("double")
        idx = F.transform(F.split(token, ""), lambda c: F.position(c, e["alphabet"]).cast("double") - 1)
        squares = F.aggregate(F.transform(F.split(e["alphabet"], ""), lambda a: n - F.length(
            F.replace(token, a, F.lit("")))), F.lit(0.0), lambda s, c: s + c * c)

        def with_index(x):
            at = F.sequence(F.lit(0), F.size(x) - 2)
            mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
            up = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.when(v * 2 >= e["k"] - 1, 1.0).otherwise(0.0))
            runs = 1 + F.aggregate(at, F.lit(0.0), lambda s, i: s + F.when(
                (x[i] * 2 >= e["k"] - 1) != (x[i + 1] * 2 >= e["k"] - 1), 1.0).otherwise(0.0))
            return _let(mean, lambda m: F.struct(
                up.alias("up"), runs.alias("runs"),
                F.aggregate(x, F.lit(0.0), lambda s, v: s + e["letter"][v.cast("int")]).alias("letters"),
                F.aggregate(at, F.lit(0.0), lambda s, i: s + pairs[
                    e["sound"][x[i].cast("int")] * 3 + e["sound"][x[i + 1].cast("int")]]).alias("pairs"),
                F.aggregate(at, F.lit(0.0), lambda s, i: s + (x[i] - m) * (x[i + 1] - m)).alias("lag"),
                F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)).alias("var")))

        changes = (F.size(F.split(token, r"(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])|(?<=[0-9])(?![0-9])"))
                   - 2).cast("double")
        breaks = (F.size(F.split(token, BOUNDARY)) - 1).cast("double")
        chi = squares * e["k"] / n - n

        def verdict(r):
            df = e["k"] - 1
            z_chi = (F.pow(r["chi"] / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
            two = 2 * r["x"]["up"] * (n - r["x"]["up"])
            z_runs = F.when((two > n), (r["x"]["runs"] - two / n - 1)
                            / F.sqrt(two * (two - n) / (n * n * (n - 1)))).otherwise(F.lit(99.0))
            z_lag = F.when(r["x"]["var"] > 0, (r["x"]["lag"] / r["x"]["var"] + 1 / n) * F.sqrt(n)) \
                .otherwise(F.lit(99.0))
            prose_chi = (r["chi"] - df - n * e["d"]) / F.sqrt(2 * df + 4 * n * e["d"])
            prose_runs = ((n - 1) * CLASS_CHANGE - r["changes"]) / F.sqrt((n - 1) * CLASS_CHANGE * (1 - CLASS_CHANGE))
            z = F.when(e["classes"], (prose_chi + prose_runs) / F.sqrt(F.lit(2.0))).otherwise(prose_chi)
            ratio = r["x"]["letters"] + r["x"]["pairs"] + r["breaks"] * e["broken"] + (n - 1 - r["breaks"]) * e["joined"]
            prose = F.log10(F.greatest(_phi(F.greatest(z, F.lit(-9.0))), F.lit(1e-38)))
            identifier = F.when(e["letters"], F.least(-ratio, F.lit(0.0))).otherwise(F.lit(-99.0))
            return F.struct(e["name"].alias("encoding"), n.cast("int").alias("n"), z_chi.alias("z_chi"),
                            z_runs.alias("z_runs"), z_lag.alias("z_lag"),
                            F.greatest(prose, identifier).alias("log_p"))
        return _let(F.struct(chi.alias("chi"), changes.alias("changes"), breaks.alias("breaks"), _let(idx, with_index).alias("x")), verdict)

    return _let(table[enc], tests)


def _weight(n: Column) -> Column:
    """Length-aware weight before scaling to mean 1: evidence grows with length, to 64."""
    return F.least(n, F.lit(64)) / 64.0


def _bin(t: Column, scale: float) -> Column:
    """Histogram bin of the weighted log p-value; 0 holds everything that fails the battery."""
    random = ((F.abs(t["z_chi"]) <= BATTERY_Z) & (F.abs(t["z_runs"]) <= BATTERY_Z)
              & (F.abs(t["z_lag"]) <= BATTERY_Z))
    weighted = -(t["log_p"] - F.log10(_weight(t["n"]) * scale))
    value = F.floor(F.greatest(weighted, F.lit(0.0)) * PER_DECADE).cast("int")
    return F.when(random, F.least(value, F.lit(BINS - 1))).otherwise(F.lit(0))


def fdr_threshold(df: DataFrame, text_col: str = "text", fdr: float = FDR) -> tuple[int, float]:
    """(lowest accepted bin, weight scale) of the weighted Benjamini-Hochberg rule over all tokens.

    The scan returns at most BINS x (64 - MIN_TOKEN + 1) counts, whatever the corpus size.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tokens = df.select(F.explode(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).alias("token"))
    rows = (tokens.select(token_tests(F.col("token")).alias("t"))
            .groupBy(F.least(F.col("t")["n"], F.lit(64)).alias("n"), _bin(F.col("t"), 64.0 / 64).alias("raw"),
                     F.floor(F.greatest(-F.col("t")["log_p"], F.lit(0.0)) * PER_DECADE).alias("p"))
            .agg(F.count(F.lit(1)).alias("c")).collect())
    total = sum(r["c"] for r in rows)
    if total == 0:
        return BINS, 1.0
    scale = total / sum(r["c"] * r["n"] / 64.0 for r in rows)
    hist = [0] * BINS
    for r in rows:
        if r["raw"] > 0:
            value = r["p"] / PER_DECADE + math.log10(r["n"] / 64.0 * scale)
            hist[min(BINS - 1, max(0, math.floor(value * PER_DECADE)))] += r["c"]
    above, best = 0, BINS
    for b in range(BINS - 1, 0, -1):
        above += hist[b]
        if above and 10 ** (-b / PER_DECADE) <= fdr * above / total:
            best = b
    return best, scale


def _random_flags(tokens: Column, bar: tuple[int, float]) -> Column:
    return F.transform(tokens, lambda t: _let(token_tests(t), lambda r: _bin(r, bar[1]) >= bar[0]))


def all_spans(text: Column, bar: tuple[int, float]) -> Column:
    """Base and random spans, by start and then kind."""
    def keep_random(spans):
        tokens = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
        return _let(spans, lambda s: F.when(F.size(s) == 0, s).otherwise(_let(
            _random_flags(tokens, bar), lambda ok: F.filter(s, lambda x, i: ok[i]))))

    extra = _matches(text, CANDIDATE, "random", keep_random)

    def merged(base):
        free = F.filter(extra, lambda c: ~F.exists(base, lambda b: (c["start"] < b["end"]) & (b["start"] < c["end"])))
        return F.struct(F.array_sort(base, _by_start).alias("base"),
                        F.array_sort(F.concat(base, free), _by_start).alias("all"))
    return _let(base_spans(text), merged)


def _by_start(a: Column, b: Column) -> Column:
    def less(x, y):
        return (x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["rank"] < y["rank"]))
    return F.when(less(a, b), -1).when(less(b, a), 1).otherwise(0)


def find_secrets(df: DataFrame, text_col: str = "text", out: str = "secrets", fdr: float = FDR,
                 bar: tuple[int, float] | None = None) -> DataFrame:
    """Add a struct column: ``base`` (spans of the patterns) and ``all`` (with random ones)."""
    if out in df.columns:
        raise ValueError(f"the input already has a column {out!r}; name another one with out=")
    bar = bar or fdr_threshold(df, text_col, fdr)
    return df.withColumn(out, all_spans(F.coalesce(F.col(text_col).cast("string"), F.lit("")), bar))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _mask(text: Column, pattern: str, flags) -> Column:
    """Replace the pattern's flagged matches by the mask, in one pass over the segments."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def rebuilt(m):
        shown = _let(flags(m), lambda ok: F.transform(m, lambda x, i: F.when(ok[i], F.lit(MASK)).otherwise(x)))
        parts = F.zip_with(F.split(text, pattern, -1), shown, lambda s, x: F.concat(s, F.coalesce(x, F.lit(""))))
        return F.when(F.size(m) == 0, text).otherwise(F.array_join(parts, ""))
    return _let(found, rebuilt)


def redact(df: DataFrame, text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """Replace every secret by ``MASK``; texts without one (NULLs too) stay as they are."""
    bar = fdr_threshold(df, text_col, fdr)

    def assign_flags(text):
        return lambda m: F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)),
                                     lambda v: F.length(v) >= MIN_VALUE)

    def all_true(m):
        return F.transform(m, lambda x: F.lit(True))

    t = F.col(text_col).cast("string")
    masked = _let(_mask(t, ASSIGN, assign_flags(t)), lambda a: _let(
        _mask(a, ACCESS, all_true), lambda b: _let(
            _mask(b, HEX, all_true), lambda c: _mask(c, CANDIDATE, lambda m: _random_flags(m, bar)))))
    return df.withColumn(text_col, F.when(F.col(text_col).isNotNull(), masked))

"""Quality rules by distribution divergence (DataFrame functions only, no shuffle of rows).

A document is compared with language references: the histogram of its
characters over classes and the histogram of its commonest words.  Both are
measured by the Jensen-Shannon distance (base 2, so 0 to 1).  References are
the corpus's own: one aggregate over all documents adds up the histograms per
language, of documents of ``min_words`` words or more of which ``least_known``
percent are among the common words of one language, which then is theirs; a
language with fewer than ``least_words`` words in all has no reference.  The
result is a row per language, whatever the corpus.

A document is measured against the word reference of the language that most of
its common words belong to, and against the nearest character reference; where
there is none, the distance is null and decides nothing.  A sample of n draws
over k classes is off its own source by about sqrt((k - 1) / (8 n ln 2)), so
limits are a fixed distance plus a multiple of that; below ``min_words`` the
base rule alone decides.

Defined cases: a null text counts as an empty one; an empty text, or one of
white space only, has no words and fails the base rule; repeated rows are
judged one by one, and count in the references as often; a corpus too small
for references, or an empty table, is judged by the base rule alone; columns
other than the text pass through unless they have the name of a result column,
which replaces them, or of a helper column (``_q_`` and a word).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACES, SPACES, let, words_of

#: Ten of the commonest words of each language (stop words; how common they are is learned).
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "las", "del"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"),
}
CLASSES = ("other", "upper", "symbol", "digit", "mark")
#: All that is neither an upper-case letter, a symbol, a digit nor a mark, as Java classes; then the first three of these by what else to drop.
PLAIN, CLASS_PATTERNS = "[^!-`{-~]+", ("[^A-Z]+", "[^#*$%&|<>]+", "[^0-9]+")
WINDOW = 8
FEW = 24


@dataclass(frozen=True)
class QualityRules:
    """Limits: a distance is too far beyond ``far`` plus ``spread`` times what chance makes of so many words or characters."""

    min_words: int = 20
    max_repeat_percent: int = 30
    char_far: float = 0.125
    char_spread: float = 4.0
    word_far: float = 0.2
    word_spread: float = 0.6
    least_known: int = 5
    least_words: int = 2000


@dataclass(frozen=True)
class References:
    """Counts per language: of characters by CLASSES, and of its COMMON_WORDS and all other words."""

    chars: dict
    words: dict


def _distance(counts: Column, reference: tuple) -> Column:
    """Jensen-Shannon distance of a histogram (array of long) to fixed shares."""
    total = float(sum(reference))
    shares = F.array(*[F.lit(x / total) for x in reference])

    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    def both(p: Column, q: Column) -> Column:
        return (term(p, (p + q) / 2) + term(q, (p + q) / 2)) / 2

    whole = F.aggregate(counts, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return let(
        whole,
        lambda n: F.when(n == 0, F.lit(1.0)).otherwise(
            F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(counts, shares, lambda c, q: both(c / n, q)), F.lit(0.0), lambda acc, x: acc + x)))
        ),
    )


def _distance_to(reference: tuple):
    return lambda counts: _distance(counts, reference)


def _is(words: list[str]):
    return lambda w: w.isin(words)


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of every window of 8 words, doubled from words to pairs, fours and eights; empty for shorter texts."""

    def doubled(part: Column, step: int) -> Column:
        short = F.greatest(F.size(part) - step, F.lit(0))
        return F.zip_with(F.slice(part, F.lit(1), short), F.slice(part, F.lit(step + 1), short), lambda x, y: F.xxhash64(x, y))

    return let(doubled(F.transform(words, lambda w: F.xxhash64(w)), 1), lambda pairs: let(doubled(pairs, 2), lambda fours: doubled(fours, 4)))


def repeated_words(windows: Column) -> Column:
    """Words that lie in a window found twice or more, the first find included.

    windows is a column of window_hashes.  A text without a repeat ends after
    one hash set.  Else the repeated windows are looked up while they are few;
    many are found by sorting, so that texts that repeat throughout cost
    n log n.  Both ways give the same count.
    """

    def sorted_way(_: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        near = lambda s: lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(let(ordered, lambda s: F.filter(s, near(s))), lambda x: x["i"]))

    def lookup_way(twice: Column) -> Column:
        at = F.transform(windows, lambda x, i: F.when(F.array_contains(twice, x), i))
        return F.filter(at, lambda i: i.isNotNull())

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"))
        return F.aggregate(positions, start, step, lambda acc: acc["n"])

    ordered = F.sort_array(windows)
    pairs = F.zip_with(F.slice(ordered, F.lit(2), F.greatest(F.size(windows) - 1, F.lit(0))), ordered, lambda x, y: F.when(x == y, x))
    found = let(
        F.array_distinct(F.filter(pairs, lambda x: x.isNotNull())),
        lambda twice: covered(F.when(F.size(twice) <= FEW, lookup_way(twice)).otherwise(sorted_way(twice))),
    )
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(found).cast("long")


def _chance(n: Column, classes: int) -> Column:
    """The distance that n draws over so many classes have from their own source, roughly."""
    return F.sqrt((classes - 1) / (8 * math.log(2)) / F.greatest(n, F.lit(1)))


def _histograms(df: DataFrame, body: Column) -> DataFrame:
    """df with _q_words, _q_solid, n_words, word_chars, n_symbols, _q_chars (counts by CLASSES), _q_common (per language the counts of its words) and _q_language."""
    df = df.withColumns({"_q_words": words_of(body), "_q_solid": F.regexp_replace(body, SPACES, "")})
    df = df.withColumn("_q_marked", F.regexp_replace("_q_solid", PLAIN, ""))
    upper, symbols, digits = (F.length(F.regexp_replace("_q_marked", p, "")).cast("long") for p in CLASS_PATTERNS)
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    df = df.withColumns(
        {
            "n_words": F.size("_q_words").cast("long"),
            "word_chars": F.length("_q_solid").cast("long"),
            "n_symbols": symbols,
            "_q_upper": upper,
            "_q_digits": digits,
            "_q_marks": F.length("_q_marked").cast("long"),
            "_q_known": F.filter("_q_words", _is(every)),
        }
    )
    chars = F.array(F.col("word_chars") - F.col("_q_marks"), F.col("_q_upper"), F.col("n_symbols"), F.col("_q_digits"), F.col("_q_marks") - F.col("_q_upper") - F.col("n_symbols") - F.col("_q_digits"))
    mass = [F.struct(F.size(F.filter("_q_known", _is(list(words)))).alias("n"), F.lit(k).alias("k")) for k, words in COMMON_WORDS.items()]
    return df.withColumns({"_q_chars": chars, "_q_language": F.array_max(F.array(*mass))})


def _word_counts(language: str) -> Column:
    """Counts of a language's common words, and of all others."""
    counted = F.array(*[F.size(F.filter("_q_known", _is([w]))).cast("long") for w in COMMON_WORDS[language]])
    return let(counted, lambda known: F.concat(known, F.array(F.col("n_words") - F.aggregate(known, F.lit(0).cast("long"), lambda acc, x: acc + x))))


def references(docs: DataFrame, text: str = "text", rules: QualityRules = QualityRules()) -> References:
    """The corpus's references, from one aggregate over all its documents; what comes to the driver is a row per language."""
    df = _histograms(docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_q_body")), F.col("_q_body"))
    # Documents that don't count have no language: a filter would be moved below the histograms and compute them once more.
    counted = (F.col("n_words") >= rules.min_words) & (F.col("_q_language.n") * 100 >= F.col("n_words") * rules.least_known)
    counts = F.coalesce(*[F.when(F.col("_q_language.k") == k, _word_counts(k)) for k in COMMON_WORDS])
    df = df.select(F.when(counted, F.col("_q_language.k")).alias("k"), "n_words", counts.alias("w"), F.col("_q_chars").alias("c"))
    sums = [F.sum(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(11)] + [F.sum(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    rows = [r for r in df.groupBy("k").agg(F.sum("n_words").alias("n"), *sums).collect() if r.k is not None and r.n >= rules.least_words]
    return References({r.k: tuple(r[f"c{i}"] for i in range(len(CLASSES))) for r in rows}, {r.k: tuple(r[f"w{i}"] for i in range(11)) for r in rows})


def quality(docs: DataFrame, text: str = "text", rules: QualityRules = QualityRules(), known: References | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), char_distance, word_distance (double; null without a reference), base_failed and kept (boolean).

    known: references, else those of docs, for which docs is read once more.
    """
    known = references(docs, text, rules) if known is None else known
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept"]
    df = docs.withColumn("_q_body", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    df = df.drop(*[c for c in docs.columns if c.lower() in made])
    columns = df.columns[:-1]
    df = _histograms(df, F.col("_q_body")).withColumn("_q_lines", F.filter(F.split("_q_body", "\n"), lambda x: F.rlike(x, F.lit(NOT_SPACES))))
    df = df.withColumn("_q_windows", window_hashes(F.col("_q_words")))
    none = F.lit(None).cast("double")
    by_word = F.coalesce(none, *[F.when(F.col("_q_language.k") == k, let(_word_counts(k), _distance_to(r))) for k, r in known.words.items()])
    nearest = [_distance(F.col("_q_chars"), r) for r in known.chars.values()]
    by_char = F.array_min(F.array(*nearest)) if nearest else none
    df = df.withColumns(
        {
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
            "n_repeat_words": repeated_words(F.col("_q_windows")),
            "char_distance": by_char,
            "word_distance": by_word,
        }
    )
    n = F.col("n_words")
    failed = (n < rules.min_words) | (F.col("n_repeat_words") * 100 > n * rules.max_repeat_percent)
    far_chars = F.col("char_distance") > rules.char_far + rules.char_spread * _chance(F.col("word_chars"), len(CLASSES))
    far_words = F.col("word_distance") > rules.word_far + rules.word_spread * _chance(n, 11)
    far = F.coalesce(far_chars, F.lit(False)) | F.coalesce(far_words, F.lit(False))
    df = df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~far)
    return df.select(*[F.col(f"`{c}`") for c in columns], *made)

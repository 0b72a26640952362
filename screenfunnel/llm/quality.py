"""Quality rules: base counts of a text, and the distance of its histograms from those of known languages.

A document is compared with each language's reference by the Jensen-Shannon distance (base 2, 0 to 1) of two histograms:
classes of characters, and common words with one bucket for all other words. References are sums over all documents of a
language, for every language of the table. The nearest language counts, so a mislabelled or mixed document is not punished;
a language without listed words has all its words in one bucket, where any text is near, so its reference serves its own
documents only. A document whose language has no reference is not measured against others. Everything is built from column
functions: one pass sums the references, the second gives the verdicts row by row, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenfunnel.llm.common import SPACES, let, words

#: Frequent function words. Fixed values.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that for it as was with be by on not he are this".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas avec".split(),
}
SYMBOLS = "[#*$%&|<>]+"
#: Classes of characters; no character is in two.
CLASSES = ["upper", "digit", "symbol", "punct", "beyond_ascii", "space", "rest"]
#: By language: sums of CLASSES, and words by count ('' for all words that are not listed).
References = dict[str, tuple[list[int], dict[str, int]]]


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; a text shorter than a guard is not judged by that histogram."""

    common_words: dict[str, list[str]] = field(default_factory=lambda: COMMON_WORDS)
    min_words: int = 10
    max_repeat_percent: int = 20
    guard_chars: int = 200
    guard_words: int = 50
    max_char_distance: float = 0.27
    max_word_distance: float = 0.40
    reference_words: int = 1000

    @property
    def vocabulary(self) -> list[str]:
        return sorted({w for v in self.common_words.values() for w in v})


def _without(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeat_words(w: Column, size: int = 5) -> Column:
    """Words inside windows of ``size`` words that the array holds twice or more, the first included.

    Windows are compared by 64-bit hashes. Only a text that repeats one has its windows sorted together with their places.
    """

    def places(keyed: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            before = F.coalesce(x["h"] == F.get(keyed, i - 1)["h"], F.lit(False))
            return before | F.coalesce(x["h"] == F.get(keyed, i + 1)["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(keyed, same), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(size)), F.lit(size)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def of(windows: Column) -> Column:
        keyed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        none = F.size(F.array_distinct(windows)) == F.size(windows)
        return F.when(none, F.lit(0).cast("long")).otherwise(let(let(keyed, places), covered))

    def joined(a: Column, reach: int, b: Column, more: int) -> Column:
        """Hashes over ``reach + more`` words, from ``a`` over the first ``reach`` and ``b`` over the next ``more``."""
        n = F.size(w) - (reach + more - 1)
        return F.zip_with(F.slice(a, 1, n), F.slice(b, reach + 1, n), lambda x, y: F.xxhash64(x, y))

    def grow(v: Column, reach: int, then: Callable[[Column], Column]) -> Column:
        """Windows double while they can, then take in single words."""
        if reach == size:
            return then(v)
        if 2 * reach <= size:
            return let(joined(v, reach, v, reach), lambda x: grow(x, 2 * reach, then))
        return let(joined(v, reach, w, 1), lambda x: grow(x, reach + 1, then))

    return F.when(F.size(w) <= size, F.lit(0).cast("long")).otherwise(grow(w, 1, of))


def _profile(df: DataFrame, rules: QualityRules, text: str, keep: list[Column]) -> DataFrame:
    """``keep`` with the text (``body``), its words (``w``), those of the vocabulary (``known``) and the counts of ``CLASSES``.

    Null texts count as empty. Lower-case ASCII letters and white space are deleted once; most classes are counted in the
    little that is left.
    """
    vocabulary = rules.vocabulary
    body = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("body"))
    split = body.withColumns({"w": words(F.col("body")), "spaced": F.regexp_replace("body", "[a-z]+", "")})
    odd = F.col("odd")
    counted = split.withColumn("odd", F.regexp_replace("spaced", SPACES, "")).withColumns(
        {
            "n_words": F.size("w").cast("long"),
            "n_code_points": F.length("body").cast("long"),
            "known": F.filter("w", lambda x: x.isin(vocabulary)),
            "n_upper": _without(odd, r"\p{Lu}+"),
            "n_digit": _without(odd, r"\p{Nd}+"),
            "n_symbol": _without(odd, SYMBOLS),
            "n_punct": _without(odd, r"\p{P}+") - _without(odd, "[#*%&]+"),
            "n_beyond_ascii": F.length(F.regexp_replace(odd, r"[\x00-\x7F\p{Lu}\p{Nd}\p{P}]+", "")),
            "n_space": F.length("spaced") - F.length("odd"),
        }
    )
    listed = [F.col(f"n_{k}").cast("long") for k in CLASSES[:-1]]
    return counted.withColumn("chars", F.array(*listed, F.col("n_code_points") - sum(listed, F.lit(0).cast("long"))))


def base_counts(df: DataFrame, rules: QualityRules, text: str = "text", lang: str = "lang") -> DataFrame:
    """A struct ``row`` of the columns of ``df``, its language, the base counts, and both histograms.

    ``chars`` counts the CLASSES; ``bins`` are structs (place in the vocabulary, 0 for all other words; n) of the words present.
    """
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns if c.lower() != "quality"]).alias("row")
    h = _profile(df, rules, text, [row, F.col(lang).alias("reference")])
    lines = F.filter(F.split("body", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    vocabulary = F.array(*map(F.lit, rules.vocabulary))
    each = F.transform(
        F.array_distinct("known"),
        lambda v: F.struct(
            F.array_position(vocabulary, v).cast("int").alias("at"),
            (F.size("known") - F.size(F.array_remove("known", v))).cast("long").alias("n"),
        ),
    )
    others = F.struct(F.lit(0).alias("at"), (F.col("n_words") - F.size("known")).alias("n"))
    return h.select(
        "row", "reference", "n_words", "n_code_points", (F.col("n_code_points") - F.col("n_space")).alias("word_chars"),
        F.col("n_symbol").cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"), "chars", F.concat(F.array(others), each).alias("bins"),
    )


def language_references(counted: DataFrame, rules: QualityRules) -> References:
    """Histograms per value of the language, summed over all rows of ``base_counts``.

    What reaches the driver is one line per language. Languages with fewer than ``rules.reference_words`` words in the table
    are left out.
    """
    known = counted.where(F.col("reference").isNotNull())
    # bins are never empty; the outer form keeps the optimiser from adding a filter that would make them once more
    items = known.select("reference", "chars", F.inline_outer("bins"))
    # the character counts ride on the first bin, which every document has
    once = [F.sum(F.when(F.col("at") == 0, F.get("chars", F.lit(k)))).alias(f"c{k}") for k in range(len(CLASSES))]
    summed = items.groupBy("reference", "at").agg(F.sum("n").alias("n"), *once)
    chars = [F.sum(f"c{k}").alias(f"c{k}") for k in range(len(CLASSES))]
    whole = summed.groupBy("reference").agg(F.sum("n").alias("total"), F.collect_list(F.struct("at", "n")).alias("bins"), *chars)
    out: References = {}
    for row in whole.where(F.col("total") >= max(rules.reference_words, 1)).collect():
        by_word = {["", *rules.vocabulary][x["at"]]: x["n"] for x in row["bins"]}
        out[row["reference"]] = ([row[f"c{k}"] for k in range(len(CLASSES))], by_word)
    return dict(sorted(out.items()))


def _gap(p: Column, q: Column) -> Column:
    """One bin's share in twice the divergence, in bits."""

    def half(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / m)).otherwise(F.lit(0.0))

    return let(p + q, lambda m: half(p, m) + half(q, m))


def _total(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def _char_shares(reference: list[int]) -> list[float]:
    return [x / sum(reference) for x in reference]


def _word_shares(reference: dict[str, int], vocabulary: list[str]) -> list[float]:
    whole = sum(reference.values())
    return [reference.get(v, 0) / whole for v in ["", *vocabulary]]


def char_distance(counts: Column, n: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of a histogram of ``n`` characters from the shares of a reference."""
    parts = F.zip_with(counts, shares, lambda c, y: let(c / n, lambda p: _gap(p, y)))
    return F.sqrt(F.greatest(_total(parts) / 2, F.lit(0.0)))


def word_distance(bins: Column, n: Column, shares: Column) -> Column:
    """The same for ``n`` words in ``bins``; a word that is absent adds its share of the reference."""
    parts = F.transform(bins, lambda x: let(F.get(shares, x["at"]), lambda y: let(x["n"] / n, lambda p: _gap(p, y)) - y))
    return F.sqrt(F.greatest((F.lit(1.0) + _total(parts)) / 2, F.lit(0.0)))


def _nearest(each: list[Column]) -> Column:
    return (F.least(*each) if len(each) > 1 else each[0]) if each else F.lit(None).cast("double")


def verdicts(counted: DataFrame, rules: QualityRules, references: References) -> DataFrame:
    """The rows of ``base_counts`` with their columns and a struct ``quality``."""
    n_chars, n_words = F.col("n_code_points").cast("double"), F.col("n_words").cast("double")
    shares = {k: (_char_shares(c), _word_shares(w, rules.vocabulary)) for k, (c, w) in references.items()}
    listed = {k: v for k, v in shares.items() if k in rules.common_words}
    others = [(k, *v) for k, v in shares.items() if k not in listed]
    by_char = [char_distance(F.col("chars"), n_chars, F.array(*map(F.lit, c))) for c, _ in listed.values()]
    by_word = [word_distance(F.col("bins"), n_words, F.array(*map(F.lit, w))) for _, w in listed.values()]
    measured = F.col("reference").isNull() | F.col("reference").isin(list(listed))
    if others:
        # one line per language and no text: sent to the rows
        own = counted.sparkSession.createDataFrame(others, "reference string, own_chars array<double>, own_words array<double>")
        counted = counted.join(F.broadcast(own), "reference", "left")
        has = F.col("own_chars").isNotNull()
        by_char.append(F.when(has, char_distance(F.col("chars"), n_chars, F.col("own_chars"))))
        by_word.append(F.when(has, word_distance(F.col("bins"), n_words, F.col("own_words"))))
        measured |= has
    near = counted.withColumns(
        {
            "char_js": F.when(measured & (n_chars >= max(rules.guard_chars, 1)), _nearest(by_char)),
            "word_js": F.when(measured & (n_words >= max(rules.guard_words, 1)), _nearest(by_word)),
            "base_failed": (F.col("n_words") < rules.min_words)
            | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
        }
    )
    near_chars = F.coalesce("char_js", F.lit(0.0)) <= rules.max_char_distance
    near_words = F.coalesce("word_js", F.lit(0.0)) <= rules.max_word_distance
    verdict = F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.round("char_js", 6).alias("char_distance"), F.round("word_js", 6).alias("word_distance"),
        "base_failed", (~F.col("base_failed") & near_chars & near_words).alias("kept"),
    )
    return near.select("row.*", verdict.alias("quality"))


def quality_rules(df: DataFrame, rules: QualityRules | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """``df`` with the column ``quality``: a struct of the base counts, the two distances, ``base_failed`` and ``kept``.

    * Every row stays, repeated rows and rows with null ids too; the verdict is the row's own.
    * A null text counts as empty and fails the base rules. A row without a language is measured against the languages of
      ``rules.common_words``.
    * A distance is null (and not held against the row) below its length guard, or if the row's language has no reference.
    * Columns of ``df`` keep their values; an own column ``quality`` is replaced.
    """
    rules = rules or QualityRules()
    counted = base_counts(df, rules, text, lang)
    return verdicts(counted, rules, language_references(counted, rules))


def keep_good(df: DataFrame, rules: QualityRules | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows that pass, with the columns of ``df``, whatever their names."""
    whole = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns]).alias("whole")
    judged = quality_rules(df.select(whole, F.col(text).alias("text"), F.col(lang).alias("lang")), rules)
    # the generator keeps the optimiser from moving the filter below the counts and making them once more for each use
    return judged.select("whole", F.explode_outer(F.array("quality.kept")).alias("kept")).where("kept").select("whole.*")

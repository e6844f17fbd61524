"""Quality rules with adaptive thresholds [native].

Fixed rules look at one text. The adaptive ones compare a text's measures with those of its language and source. A
DDSketch (Masson, Rim, Lee 2019: counts of logarithmic buckets, of relative error ALPHA) of every measure is built for
each (lang, source) and merged by adding counts into one for each language and one for all. A text is rejected where a
measure lies beyond an outer fence of its group, on the logarithmic scale of the sketch: above q75 * (q75 / q25) ** FENCE,
or for measures with a lower limit below q25 / (q75 / q25) ** FENCE. No limit is a fixed number: all follow the quartiles.

Counts are smoothed (half an occurrence more), so texts without any occurrence differ by their length, and a group
in which nearly no text has one still has quartiles. A spread can come out too small by chance or because all texts of
a group are alike; it counts as the ratio of SPREADS at least, by which one occurrence or the shortest texts' noise moves
a measure. Texts that fail the base rule on length are noise and no part of the sketches.

The sketches are groupBy counts: they merge in any order and always give the same result, and everything after the
buckets is whole-number arithmetic. A group with fewer than MIN_ROWS such texts takes its language's sketch, then the one
of all rows; where that is empty too, no text has passed the base rules. Texts are measured once: the measures are stored with
the columns that are to come back, sketched from there, and meet their group's thresholds in a null-safe join.

Nulls: a null text has no words (so it fails the base rules); a null lang or source is a group of its own. Repeated
rows are judged alike, each for itself. Extra columns pass through. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, UPPER, stored, text_of

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
ALPHA, FENCE, MIN_ROWS = 0.01, 3, 50
GAMMA = (1 + ALPHA) / (1 - ALPHA)
LOG_GAMMA = math.log(GAMMA)
#: Measure -> SQL; never zero where a text has words.
MEASURES = {
    "symbols_per_word": "(n_symbols + 0.5D) / (n_words + 1D)",
    "repeated_line_odds": "(n_dup_lines + 0.5D) / (size(_lines) - n_dup_lines + 0.5D)",
    "capitals_per_char": "(n_capitals + 0.5D) / (word_chars + 1D)",
    "chars_per_word": "word_chars / cast(n_words as double)",
}
#: Measure -> least q75 / q25: a smoothed count of nothing is uncertain by a factor of two, that of the ten or so capitals
#: of a short text by half; the mean of MIN_WORDS word lengths, whose deviation is half their mean, has an IQR of a tenth.
SPREADS = {"symbols_per_word": 2.0, "repeated_line_odds": 2.0, "capitals_per_char": 1.5, "chars_per_word": 1.1}
#: Measures that can be too low as well.
LOWER = ("chars_per_word",)


def _words(text: str) -> Column:
    return F.expr(rf"regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+', 0)")


def line_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with _t, _words, _lines, n_words, word_chars, n_symbols, n_capitals and n_dup_lines."""
    return (
        df.withColumn("_t", text_of(text))
        .withColumn("_words", _words("_t"))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.char_length(F.translate("_t", SPACES, "")).cast("long"))
        .withColumn("n_symbols", (F.char_length("_t") - F.char_length(F.translate("_t", "#*$%&|<>", ""))).cast("long"))
        .withColumn("n_capitals", (F.char_length("_t") - F.char_length(F.translate("_t", UPPER, ""))).cast("long"))
        .withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    )


def repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words from _words: 3-word windows are hashed and sorted within the row; windows whose sorted neighbour
    has the same hash and the same words cover their three positions."""
    same = "(get(_sorted, j + {d}).h = x.h and get(_words, get(_sorted, j + {d}).i) = get(_words, x.i) and get(_words, get(_sorted, j + {d}).i + 1) = get(_words, x.i + 1) and get(_words, get(_sorted, j + {d}).i + 2) = get(_words, x.i + 2))"
    return (
        df.withColumn("_sorted", F.expr("""sort_array(transform(if(size(_words) < 3, cast(array() as array<int>), sequence(0, size(_words) - 3)),
            i -> struct(xxhash64(_words[i], _words[i + 1], _words[i + 2]) as h, i as i)))"""))
        .withColumn("_again", F.expr(f"transform(filter(_sorted, (x, j) -> coalesce({same.format(d=-1)}, false) or coalesce({same.format(d=1)}, false)), x -> x.i)"))
        .withColumn("n_repeat_words", F.expr("cast(size(array_distinct(flatten(transform(_again, i -> array(i, i + 1, i + 2))))) as bigint)"))
    )


def buckets() -> dict[str, Column]:
    """The sketch's bucket of each measure, over ``line_measures``: the whole number k of GAMMA ** (k - 1) < v <= GAMMA ** k."""
    return {m: F.when(F.col("n_words") > 0, F.ceil(F.log(F.expr(sql)) / F.lit(LOG_GAMMA)).cast("int")) for m, sql in MEASURES.items()}


def sketches(measured: DataFrame) -> DataFrame:
    """(_lang, _source, measure, bucket, n): the sketch of each measure for each language and source."""
    pairs = [F.struct(F.lit(m).alias("measure"), F.col(m).alias("bucket")) for m in MEASURES]
    long = measured.where(F.col("n_words") >= MIN_WORDS).select("_lang", "_source", F.inline(F.array(*pairs)))
    return long.groupBy("_lang", "_source", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Merges the sketches of each ``keys`` by adding counts: total, and the buckets b25 and b75 of the quartiles."""
    by = ", ".join([*keys, "measure"])
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    ranked = merged.selectExpr("*", f"sum(n) over (partition by {by} order by bucket) as upto", f"sum(n) over (partition by {by}) as total")
    return ranked.groupBy(*keys, "measure").agg(F.max("total").alias("total"), *(F.expr(f"min(if({part} * upto >= {of} * total, bucket, null))").alias(name) for part, of, name in ((4, 1, "b25"), (4, 3, "b75"))))


def least_spread(measure: str) -> int:
    """SPREADS in buckets."""
    return round(math.log(SPREADS[measure]) / LOG_GAMMA)


def thresholds(sketch: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each of ``groups`` (_lang, _source): the highest bucket of every measure as column high_<measure>,
    and the lowest as low_<measure>, NULL where no text at all was sketched."""
    spread = F.greatest(F.col("b75") - F.col("b25"), F.coalesce(*(F.when(F.col("measure") == m, F.lit(least_spread(m))) for m in MEASURES)))
    level = []
    for k, keys in enumerate((["_lang", "_source"], ["_lang"], [])):
        fences = quartiles(sketch, keys).where("true" if k == 2 else f"total >= {MIN_ROWS}").withColumn("spread", F.lit(FENCE) * spread)
        wide = fences.groupBy(*keys).agg(F.lit(True).alias(f"is{k}"), *(F.max(F.when(F.col("measure") == m, F.col("b75") + F.col("spread"))).alias(f"high{k}_{m}") for m in MEASURES), *(F.max(F.when(F.col("measure") == m, F.col("b25") - F.col("spread"))).alias(f"low{k}_{m}") for m in LOWER))
        level.append(wide.withColumnsRenamed({c: f"{c}{k}" for c in keys}))
    same = lambda c, k: F.col(c).eqNullSafe(F.col(f"{c}{k}"))
    joined = groups.join(level[0], same("_lang", 0) & same("_source", 0), "left").join(level[1], same("_lang", 1), "left").join(F.broadcast(level[2]), F.lit(True), "left")
    first = lambda name: F.when(F.col("is0"), F.col(name.replace("_", "0_", 1))).when(F.col("is1"), F.col(name.replace("_", "1_", 1))).otherwise(F.col(name.replace("_", "2_", 1))).alias(name)
    return joined.select("_lang", "_source", *(first(f"high_{m}") for m in MEASURES), *(first(f"low_{m}") for m in LOWER))


def all_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and
    kept.

    Columns of docs that have one of these names come out under it with underscores in front.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    keep = docs.columns if keep is None else keep
    carried = [f"_c{k}" for k in range(len(keep))]
    inner = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, carried, strict=True)), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("_lang"), F.col(f"`{source}`").alias("_source"))
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(c.alias(m) for m, c in buckets().items())]
    measured = stored(repeat_words(line_measures(inner)).select(*carried, "_lang", "_source", *numbers), "measured")
    # a few rows for each source; stored, their size is known, and Spark broadcasts them if it is small
    limits = stored(thresholds(stored(sketches(measured), "sketches"), measured.select("_lang", "_source").distinct()), "limits").withColumnsRenamed({"_lang": "_l", "_source": "_s"})
    joined = measured.join(limits, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    within = [F.col(m) <= F.col(f"high_{m}") for m in MEASURES] + [F.col(m) >= F.col(f"low_{m}") for m in LOWER]
    ruled = joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(all_of(within), F.lit(False)))
    taken = {c.lower() for c in added}
    names = []
    for c, n in zip(keep, carried, strict=True):
        out = c
        while out.lower() in taken:
            out = f"_{out}"
        taken.add(out.lower())
        names.append(F.col(n).alias(out))
    return ruled.select(*names, *added)


def op10_quality_rules(docs: DataFrame) -> DataFrame:
    """The digest of the contract: doc_id, the counts, base_failed and kept, one row for each row of ``docs``."""
    return judge(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

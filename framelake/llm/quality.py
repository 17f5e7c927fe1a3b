"""Quality rules whose thresholds follow each language and source.

Texts give integer rates: symbols, repeated lines and repeated words per 100,000,
and a hundred times the mean word length. For each language and source a
histogram on a grid of six significant binary digits counts the values of each
rate. Such a sketch answers quantiles to one part in 32, and sketches merge by
adding counts, so partial results combine in any order to the same sketch: those of a language's
sources to the language's, and those to the sketch of all.

A sketch's fence lies ``reach`` halves of the distance from its median to an upper quantile beyond that
quantile; ``RULES`` names both for each rate. A group's fence is the mean of its own and its language's fence, the own
weighing as many documents as it has and the other ``SHRINK``; likewise a language's and that of all. So small groups
follow their language and large ones themselves, with no size where one turns into the other. Where nearly
all values are zero the fence of the shares is at least ``FLOOR``. Rows meet their group's fences in a join.

Only documents that pass the base rules enter the sketches. Everything is a
DataFrame expression; the sketches hold at most a few thousand rows a group and
stay in the cluster.

Defined results: a null or empty text has no words and fails the base rules;
null languages and sources are groups of their own; repeated rows are judged
each on its own, alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import SPACES, WORD, broadcast_if_small, text_or_empty, words_of
from framelake.session import materialise

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: Quantile in per cent and reach of each rate's fence. Mean word lengths have a fence below as well, mirrored.
RULES = {"symbol_rate": (95, 1), "line_rate": (99, 1), "repeat_rate": (99, 1), "word_length": (90, 6)}
#: Documents that the parent's fence weighs, and the least fence of a share (5 %).
SHRINK, FLOOR = 200, 5_000


def text_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (the input) with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    A window of eight words is compared by a 64-bit hash of its words.
    """
    df = docs.select(F.struct("*").alias("row"), text_or_empty(text).alias("t"))
    df = df.withColumn("words", words_of(F.col("t"))).withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    starts = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    grams = F.when(F.col("n_words") > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("grams", grams)
    df = df.select(
        "row",
        "n_words",
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # Most texts repeat no window: they skip the sort.
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ranked"),
    )
    hit = F.transform(
        "ranked",
        lambda x, k: F.when((F.coalesce(F.get("ranked", k - 1)["h"] == x["h"], F.lit(False))) | F.coalesce(F.get("ranked", k + 1)["h"] == x["h"], F.lit(False)), x["i"]),
    )
    df = df.withColumn("hits", F.array_sort(F.filter(hit, lambda i: i.isNotNull())))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total"))
    covered = F.aggregate("hits", start, lambda a, i: F.struct(i.alias("last"), (a["total"] + F.least(F.lit(WINDOW), i - a["last"])).alias("total")), lambda a: a["total"])
    return df.select("row", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def grid(value: Column) -> Column:
    """The value cut to six significant binary digits."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def _rates() -> dict[str, Column]:
    return {
        "symbol_rate": F.expr("n_symbols * 100000 div greatest(n_words, 1)"),
        "line_rate": F.expr("n_dup_lines * 100000 div greatest(n_lines, 1)"),
        "repeat_rate": F.expr("n_repeat_words * 100000 div greatest(n_words, 1)"),
        "word_length": F.expr("word_chars * 100 div greatest(n_words, 1)"),
    }


def group_sketches(features: DataFrame) -> DataFrame:
    """Counts on the grid: one row per lang, source, rate and grid value."""
    rates = F.array(*(F.struct(F.lit(k).alias("rate"), grid(v).alias("value")) for k, v in _rates().items()))
    cells = features.where("NOT base_failed").select("lang", "source", F.inline(rates))
    return cells.groupBy("lang", "source", "rate", "value").agg(F.count("*").alias("n"))


def fences(sketches: DataFrame) -> DataFrame:
    """Low and high fence for each (lang, source, rate), and ``n``, the documents of its own sketch."""
    groups = sketches.select("lang", "source").distinct()
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang").alias("at_lang"), F.col("source").alias("at_source")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("at_lang"), F.lit(None).cast("string").alias("at_source")),
        F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias("at_lang"), F.lit(None).cast("string").alias("at_source")),
    )
    keys = ["level", "at_lang", "at_source", "rate"]
    merged = sketches.select("*", F.inline(levels)).groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    by_rate = lambda place: F.create_map(*(F.lit(x) for rate, rule in RULES.items() for x in (rate, rule[place])))[F.col("rate")]
    at = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("total") * percent, F.col("value")))
    ranked = ranked.withColumn("percent", by_rate(0))
    quantiles = ranked.groupBy(*keys).agg(F.max("total").alias("total"), at(100 - F.col("percent")).alias("less"), at(F.lit(50)).alias("middle"), at(F.col("percent")).alias("more")).withColumn("reach", by_rate(1))
    own = quantiles.select(
        F.col("level").alias("l"), F.col("at_lang").alias("al"), F.col("at_source").alias("as_"), "rate", "total",
        F.expr("greatest(less - reach * (middle - less) div 2, 0)").alias("low"), F.expr("more + reach * (more - middle) div 2").alias("high"),
    )
    met = groups.select("lang", "source", F.inline(levels)).join(own, (F.col("level") == F.col("l")) & F.col("at_lang").eqNullSafe(F.col("al")) & F.col("at_source").eqNullSafe(F.col("as_")))
    pick = lambda c, level: F.max(F.when(F.col("level") == level, F.col(c))).alias(f"{c}{level}")
    wide = met.groupBy("lang", "source", "rate").agg(*(pick(c, level) for c in ("total", "low", "high") for level in range(3)))

    def shrunk(c: str) -> Column:
        language = f"((total1 * {c}1 + {SHRINK} * {c}2) div (total1 + {SHRINK}))"
        return F.expr(f"(total0 * {c}0 + {SHRINK} * {language}) div (total0 + {SHRINK})")

    least = F.when(F.col("rate") == "word_length", 0).otherwise(FLOOR)
    return wide.select("lang", "source", "rate", F.col("total0").alias("n"), shrunk("low").alias("low"), F.greatest(shrunk("high"), least).alias("high"))


def judge(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per document: key, lang, source, the features, ``base_failed`` and ``kept``.

    Features are written once in the shared folder, since the sketches and the
    final join both read them.
    """
    df = text_features(docs, text).select(F.col("row").getField(key).alias("doc_id"), F.col("row").getField(lang).cast("string").alias("lang"), F.col("row").getField(source).cast("string").alias("source"), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    features = materialise(df.withColumn("base_failed", failed), "quality")
    limits = fences(group_sketches(features)).groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("rate") == r, F.col(side))).alias(f"{r}_{side}") for r in RULES for side in ("low", "high"))
    )
    limits = broadcast_if_small(materialise(limits, "fences").select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *(f"{r}_{s}" for r in RULES for s in ("low", "high"))))
    # On the grid like the sketches, so that what a quantile falls on is not beyond it.
    rates = {r: grid(v) for r, v in _rates().items()}
    inside = [rates[r] <= F.col(f"{r}_high") for r in RULES] + [rates["word_length"] >= F.col("word_length_low")]
    good = inside[0]
    for x in inside[1:]:
        good = good & x
    joined = features.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    return joined.select(*features.columns, (~F.col("base_failed") & F.coalesce(good, F.lit(True))).alias("kept"))

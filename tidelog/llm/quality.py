"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each document's rule metrics are whole numbers, so a histogram of them is a quantile sketch: its
counts merge by addition, exactly and in any order. Four metrics keep every value; the two sizes, lines and words,
keep their four leading bits. Sketches are kept for each (language, source), each language and the whole table.

A group's thresholds lie outside its quartiles by some interquartile ranges, and at least by what a few events
would add in its median document, so nothing in them is fixed but the number of events. A group leans
on its language, and that on the whole table, by the numbers of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidelog.llm.common import let, staged

#: Characters that count as symbols, and white space that ends words (fixed by the contract).
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
SPLIT = "[ \\t-\\r]+"
WINDOW = 5
METRICS, SIZES = ("symbols", "length", "lines", "repeats"), ("n_lines", "n_words")
#: A threshold lies FENCE interquartile ranges outside the quartiles, and at least so far that the median document of the
#: group may have a symbol more in each SYMBOL_WORDS words, LINES more repeated lines, WINDOWS more words in repeated
#: windows than the quartile; a mean word length may differ by half the median one.
FENCE, SYMBOL_WORDS, LINES, WINDOWS = 3, 3, 3, 6 * WINDOW
#: Documents of the wider group that count beside a group's own.
LEAN = 100
#: Groups whose thresholds may be broadcast.
BROADCAST_GROUPS = 50_000


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPLIT), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, the first occurrence included."""
    windows = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    )

    def covered(hashes: Column) -> Column:
        """Sorted (hash, place) pairs bring equal windows together; then the union of their spans is measured."""
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda p, k, by: F.coalesce(F.get(p, k + by)["h"] == F.get(p, k)["h"], F.lit(False))
        places = let(
            pairs,
            lambda p: F.array_sort(
                F.filter(
                    F.transform(p, lambda x, k: F.when(((k > 0) & same(p, k, -1)) | same(p, k, 1), x["i"])), lambda i: i.isNotNull()
                )
            ),
        )
        spans = let(places, lambda at: F.transform(at, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - i, F.lit(WINDOW)))))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda total, n: total + n)

    none = F.lit(0).cast("long")
    return let(
        words,
        lambda w: F.when(F.size(w) < WINDOW + 1, none).otherwise(
            let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h)))
        ),
    )


def rule_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long), n_lines of lines with a word.

    Null and empty texts have zero of all. The new columns replace columns of the same names.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    removed = lambda chars: F.length(F.translate(t, chars, ""))
    two = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), F.size(F.array_distinct(x)).cast("long").alias("distinct")))
    counted = let(_words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("repeats")))
    return (
        docs.withColumn("__lines", two)
        .withColumn("__words", counted)
        .withColumn("n_words", F.col("__words.n"))
        .withColumn("word_chars", removed(SPACES).cast("long"))
        .withColumn("n_symbols", (F.length(t) - removed(SYMBOLS)).cast("long"))
        .withColumn("n_lines", F.col("__lines.all"))
        .withColumn("n_dup_lines", F.col("__lines.all") - F.col("__lines.distinct"))
        .withColumn("n_repeat_words", F.col("__words.repeats"))
        .drop("__lines", "__words")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def metric_columns() -> dict[str, Column]:
    """Per mille of symbols, of repeated lines and of words in repeated windows; ten times the mean word length."""
    ratio = lambda a, b, by: F.floor(F.lit(by) * F.col(a) / F.greatest(F.col(b), F.lit(1).cast("long")))
    return {
        "symbols": ratio("n_symbols", "word_chars", 1000),
        "length": ratio("word_chars", "n_words", 10),
        "lines": ratio("n_dup_lines", "n_lines", 1000),
        "repeats": ratio("n_repeat_words", "n_words", 1000),
    }


def leading_bits(n: Column) -> Column:
    """A whole number with all but its four leading bits zero: a bin of a sketch whose relative error is an eighth."""
    shift = F.greatest(F.length(F.bin(n)) - 4, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", n, shift), shift)


def sketches(counts: DataFrame) -> DataFrame:
    """lang, source, metric, bin, n: histograms over the documents that pass the base rules."""
    values = metric_columns() | {c: leading_bits(F.col(c)) for c in SIZES}
    kinds = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("bin")) for m, v in values.items()]))
    passed = counts.where(~base_failed()).select("lang", "source", kinds.alias("m"))
    return passed.groupBy("lang", "source", "m.metric", "m.bin").agg(F.count(F.lit(1)).alias("n"))


def thresholds(bins: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n (documents), and for each metric the struct (low, high) of its fences, from merged sketches."""
    merged = bins.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    # the smallest bin that q quarters of the documents do not exceed
    at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("bin")))
    quartiles = ranked.groupBy(*keys, "metric").agg(at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"), F.max("total").alias("n"))
    each = [F.max(F.when(F.col("metric") == m, F.struct("q1", "q2", "q3"))).alias(m) for m in (*METRICS, *SIZES)]
    rows = quartiles.groupBy(*keys).agg(F.max("n").alias("n"), *each)
    share = lambda events, of: F.floor(F.lit(1000 * events) / F.greatest(of, F.lit(1)))
    least = {
        "symbols": share(10, SYMBOL_WORDS * F.col("length.q2")),
        "length": F.floor(F.col("length.q2") / 2),
        "lines": share(LINES, F.col("n_lines.q2")),
        "repeats": share(WINDOWS, F.col("n_words.q2")),
    }
    away = {m: F.greatest(FENCE * (F.col(m)["q3"] - F.col(m)["q1"]), least[m]) for m in METRICS}
    fences = [F.struct((F.col(m)["q1"] - away[m]).alias("low"), (F.col(m)["q3"] + away[m]).alias("high")).alias(m) for m in METRICS]
    return rows.select(*keys, "n", *fences)


def _leaning(n: Column, own: Column, wider: Column, lean: int) -> Column:
    """Fences of a group of n documents, beside which those of the wider group count as `lean` documents more."""
    mixed = lambda side: F.floor((n * own[side] + lean * wider[side]) / (n + lean)).alias(side)
    return F.struct(mixed("low"), mixed("high"))


def quality_rules(docs: DataFrame, lean: int = LEAN) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, kept, and `failed`, which metrics are outside their thresholds (if not base_failed).

    A document is kept if it passes the base rules and each metric lies within its group's fences;
    for symbols, lines and repeats only the upper fence counts, for word length both do. A group is
    (lang, source); its fences are a mean of its own ones, by its documents that pass the base rules, and of
    its language's, by `lean`, and those in the same way of the language's own and the whole table's. Null
    lang and null source are groups like others. A table in which no document passes the base rules
    has no thresholds and keeps nothing. Repeated rows are
    documents each; an empty table gives an empty result; other columns of docs are ignored.
    """
    counts = rule_counts(docs.select("doc_id", "lang", "source", "text")).drop("text")
    counts = staged(counts.withColumn("base_failed", base_failed()), "quality")
    bins = sketches(counts)
    wide = thresholds(bins.withColumn("every", F.lit(1)), ["every"])
    own, by_lang = thresholds(bins, ["lang", "source"]), thresholds(bins, ["lang"])
    in_lang = [_leaning(F.col("lang.n"), F.col(f"lang.{m}"), F.col(f"wide.{m}"), lean).alias(m) for m in METRICS]
    by_lang = by_lang.alias("lang").join(F.broadcast(wide).alias("wide"), F.lit(True), "left").select("lang.lang", *in_lang)  # one row
    in_group = [_leaning(F.col("own.n"), F.col(f"own.{m}"), F.col(f"lang.{m}"), lean).alias(m) for m in METRICS]
    groups = own.alias("own").join(by_lang.alias("lang"), F.col("own.lang").eqNullSafe(F.col("lang.lang")), "left")
    groups = groups.select(F.col("own.lang").alias("g_lang"), F.col("own.source").alias("g_source"), *in_group)
    groups = staged(groups, "thresholds")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    values = metric_columns()
    outside = [
        F.when((v > F.col(m)["high"]) | ((v < F.col(m)["low"]) if m == "length" else F.lit(False)), F.lit(m)) for m, v in values.items()
    ]
    verdict = F.array_compact(F.array(*outside))
    return (
        counts.join(groups, same, "left")
        .withColumn("failed", F.when(F.col("base_failed"), "").otherwise(F.concat_ws(",", verdict)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("failed") == ""))
        .select(
            "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"
        )
    )

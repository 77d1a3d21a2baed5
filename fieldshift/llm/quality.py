"""Quality rules with thresholds that adapt to each language and source, in DataFrame functions only.

Word and line statistics are array expressions over one text. Three rates of it - symbols per character, repeated lines
per line, characters per word - go into quantile sketches per language and source: counts by bucket, where buckets
are exact to 1 / 1024 for small rates and to 1 / 128 of the rate beyond, so that a sketch has a bounded number of
buckets, whatever it has seen, and sketches merge by adding counts. A group's quartiles are those of its own sketch
blended with its language's and with that of all, each weighing as much as ``PRIOR`` documents, so that many own
documents decide and few ones follow the wider groups, by one formula at every size. A document is kept if no count of
its is beyond what the fences of its group allow: ``REACH`` quartile ranges beyond the quartiles, times the length, and
``SIGMAS`` standard deviations of a Poisson count. No fixed limit takes part, and all verdicts are the same in every run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .support import materialize

#: Documents that the sketch of a language, and that of all, weigh in each group's blend.
PRIOR = 100
#: Quartile ranges beyond the quartiles that are still kept, and the standard deviations that a count may vary by.
REACH, SIGMAS = 3, 3.0
#: Buckets of a sketch: rates are taken in units of 1 / UNIT, of which the first MANTISSA binary digits count.
UNIT, MANTISSA = 1024, 8
#: The threshold table is broadcast if it has no more groups than this.
MOST_BROADCAST_GROUPS = 100_000

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: The rates: a count, what it is counted over, and whether a low rate is odd too.
RATES = {"symbols": ("n_symbols", "word_chars", False), "lines": ("n_dup_lines", "n_lines", False), "letters": ("word_chars", "n_words", True)}


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more among the windows of the same text."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap).cast("long")

    def sorted_starts(hashes: Column) -> Column:
        marked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bind(
            marked,
            lambda m: F.array_sort(
                F.transform(
                    F.filter(
                        m,
                        lambda x, i: F.coalesce(F.get(m, i - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(m, i + 1)["h"] == x["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            bind(sorted_starts(hashes), covered)
        )

    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)])
    )
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(bind(windows, count))


def _measured(text: Column) -> Column:
    """A struct of the base statistics of one text."""
    blank = F.lit(BLANKS)

    def of(trimmed: Column) -> Column:
        none = F.array().cast("array<string>")
        return bind(F.when(trimmed == "", none).otherwise(F.split(trimmed, "[ \\t-\\r]+")), of_words)

    def of_words(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, blank) != "")
        return bind(
            lines,
            lambda known: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
                (F.size(known) - F.size(F.array_distinct(known))).cast("long").alias("n_dup_lines"),
                _repeated_words(words).alias("n_repeat_words"),
                F.size(known).cast("long").alias("n_lines"),
            ),
        )

    return bind(F.btrim(text, blank), of)


def measure(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns ``keep`` with the base statistics, n_lines and base_failed.

    A null text counts as empty: no words, no lines, base_failed. Other columns, clashing or not, are left out.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = docs.select(*[F.col(f"`{c}`") for c in keep], _measured(text).alias("_m")).select(*keep, "_m.*")
    return found.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    )


def bucket(count: Column, over: Column) -> Column:
    """The bucket of a rate, by its lower edge in units of 1 / UNIT."""
    units = F.floor(count / F.greatest(over, F.lit(1)) * F.lit(float(UNIT))).cast("long")
    return bind(
        units,
        lambda u: bind(
            F.greatest(F.length(F.bin(u)) - MANTISSA, F.lit(0)),
            lambda cut: F.call_function("shiftleft", F.call_function("shiftright", u, cut), cut),
        ),
    )


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, rate, edge, n): documents per bucket of each rate, over documents that pass the base rules."""
    parts = [F.struct(F.lit(name).alias("rate"), bucket(F.col(k), F.col(e)).alias("edge")) for name, (k, e, _) in RATES.items()]
    return (
        measured.where(~F.col("base_failed"))
        .select("lang", "source", F.explode(F.array(*parts)).alias("p"))
        .groupBy("lang", "source", "p.rate", "p.edge")
        .agg(F.count("*").alias("n"))
    )


def merged(found: DataFrame, *keys: str) -> DataFrame:
    """Sketches of wider groups: ``found`` with only the group columns ``keys`` left."""
    return found.groupBy(*keys, "rate", "edge").agg(F.sum("n").alias("n"))


def thresholds(found: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, low_... and high_... of each rate, in units) from the sketches of :func:`sketches`.

    Every group is blended over the buckets that occur anywhere, whose number is bounded by the sketch, so these are
    broadcast. Weights are whole numbers, multiplied out, so that sums have no rounding.
    """
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)")

    def sized(sketch: DataFrame, prefix: str, *keys: str) -> DataFrame:
        total = F.sum("n").over(Window.partitionBy(*keys, "rate"))
        return sketch.select(*[F.col(k).alias(f"{prefix}_{k}") for k in (*keys, "rate", "edge")], F.col("n").alias(f"{prefix}_n"), total.alias(f"{prefix}_all"))

    by_lang = merged(found, "lang")
    wide = sized(by_lang, "l", "lang")
    groups = found.groupBy("lang", "source", "rate").agg(F.lit(None).alias("_")).drop("_")
    langs = by_lang.groupBy("lang", "rate").agg(F.sum("n").alias("l_size")).withColumnsRenamed({"lang": "s_lang", "rate": "s_rate"})
    grid = (
        groups.join(F.broadcast(sized(merged(by_lang), "a")), F.col("rate") == F.col("a_rate"))
        .join(langs, F.col("lang").eqNullSafe(F.col("s_lang")) & (F.col("rate") == F.col("s_rate")))
        .join(wide, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("rate") == F.col("l_rate")) & (F.col("a_edge") == F.col("l_edge")), "left")
    )
    own = found.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.col("rate").alias("g_rate"), F.col("edge").alias("g_edge"), F.col("n").alias("g_n"))
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")) & (F.col("rate") == F.col("g_rate")) & (F.col("a_edge") == F.col("g_edge"))
    weight = whole("g_n") * whole("l_size") * whole("a_all") + F.lit(prior) * (whole("l_n") * whole("a_all") + whole("a_n") * whole("l_size"))
    group = Window.partitionBy("lang", "source", "rate")
    ranked = grid.join(own, same, "left").select("lang", "source", "rate", F.col("a_edge").alias("edge"), weight.cast("decimal(38,0)").alias("w")).select(
        "lang", "source", "rate", "edge", F.sum("w").over(group.orderBy("edge")).alias("below"), F.sum("w").over(group).alias("total")
    )
    quartile = lambda rate, q: F.min(F.when((F.col("rate") == rate) & (4 * F.col("below") >= q * F.col("total")), F.col("edge")))
    fences = []
    for rate in RATES:
        q1, q3 = quartile(rate, 1), quartile(rate, 3)
        fences += [(q1 - REACH * (q3 - q1)).alias(f"low_{rate}"), (q3 + REACH * (q3 - q1)).alias(f"high_{rate}")]
    return ranked.groupBy("lang", "source").agg(*fences)


def _allowed(rate: str) -> Column:
    """Whether a document's count is one that the fences of its group allow."""
    count, over, both = RATES[rate]
    expected = lambda side: F.col(f"{side}_{rate}") / F.lit(float(UNIT)) * F.col(over)
    most = expected("high") + F.lit(SIGMAS) * F.sqrt(expected("high") + 1)
    least = expected("low") - F.lit(SIGMAS) * F.sqrt(F.greatest(expected("low"), F.lit(0.0)) + 1)
    return (F.col(count) <= most) & ((F.col(count) >= least) if both else F.lit(True))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with kept: false for base_failed, else whether every rate lies within its group's limits.

    The limits are broadcast if a count shows few groups; else the join shuffles measures, never texts. A null
    language or source is a group like any other.
    """
    few = len(limits.take(MOST_BROADCAST_GROUPS + 1)) <= MOST_BROADCAST_GROUPS
    table = limits.withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    within = reduce(Column.__and__, map(_allowed, RATES))
    return (
        measured.join(F.broadcast(table) if few else table, same, "left")
        .withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(within, F.lit(True))))
        .drop("_lang", "_source")
    )


def assess(docs: DataFrame) -> DataFrame:
    """Every row's doc_id, statistics, limits and verdict.

    A null or empty text has no words and fails the base rules; texts of any length are measured whole; a null language
    or source is a group like any other; repeated rows are judged alike; an empty table gives no row; other columns of
    ``docs``, whatever their names, are left out.
    """
    measured = materialize(measure(docs), "measures")
    limits = materialize(thresholds(sketches(measured)), "limits")
    return judge(measured, limits)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``; :func:`assess` says how odd rows are judged.

    Texts are measured once and aren't shuffled: rows are written with their measures and read again to be judged. Rows
    pass as one struct, so that no column's name can clash.
    """
    named = docs.select(F.struct("*").alias("_row"), "text", "lang", "source")
    measured = materialize(measure(named, keep=("_row", "lang", "source")), "measures")
    limits = materialize(thresholds(sketches(measured)), "limits")
    return judge(measured, limits).where("kept").select("_row.*")

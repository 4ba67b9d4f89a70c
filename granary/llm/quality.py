"""Quality rules whose limits come from the corpus: quantile sketches per language and source.

A sketch is a table: for each group and metric, how many documents have each value, values cut to their six
highest bits (so a quantile is off by less than 1/32). Sketches of parts, days or sources merge by adding their
counts, and merged sketches are those of the union, exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.store import written

SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
WINDOW = 5

#: Metric: least spread, whether low values fail too. Rates are per thousand, lengths in hundredths.
METRICS = {"symbol_rate": (10, False), "word_length": (100, True), "dup_line_rate": (60, False)}


def words(text: Column) -> Column:
    """The words of a text; none for null, empty or blank texts."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, WORD_GAP)).otherwise(F.array().cast("array<string>"))


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    All are 0, and base_failed is true, for null and empty texts. Columns of these names are replaced. Repeated windows are found by 64-bit hashes of
    their words within one text, sorted with their positions, in n log n time for a text of n words.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)
    out = df.withColumns({"rule:words": words(F.col(text)), "rule:lines": lines}).withColumns({
        "n_words": F.size("rule:words").cast("long"),
        "word_chars": F.length(F.array_join("rule:words", "")).cast("long"),
        "n_symbols": F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("rule:lines") - F.size(F.array_distinct("rule:lines"))).cast("long"),
        "rule:windows": F.when(
            F.size("rule:words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("rule:words") - WINDOW),
                lambda i: F.xxhash64(*[F.get("rule:words", i + k) for k in range(WINDOW)]),
            ),
        ),
    })
    # windows sorted by hash, then place: those that occur twice have an equal neighbour
    def twice(window: Column, i: Column) -> Column:
        return F.get("rule:sorted", i - 1)["h"].eqNullSafe(window["h"]) | F.get("rule:sorted", i + 1)["h"].eqNullSafe(window["h"])

    out = out.withColumn(
        "rule:sorted",
        F.when(
            F.size(F.array_distinct("rule:windows")) < F.size("rule:windows"),
            F.array_sort(F.transform("rule:windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
        ),
    ).withColumn("rule:places", F.array_sort(F.transform(F.filter("rule:sorted", twice), lambda w: w["at"])))
    # each place covers a window's words, less those the next place covers as well
    covered = F.aggregate(
        F.transform("rule:places", lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get("rule:places", i + 1) - at, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    )
    # a row of one: filters on the counts stay above it; below, they would compute the arrays anew for each element
    once = F.explode(F.array(F.struct(*counts))).alias("rule:counts")
    columns = [F.col(f"`{c}`") for c in df.columns if c not in counts]
    return out.select(*columns, once).select(*columns, "`rule:counts`.*")


def with_metrics(df: DataFrame) -> DataFrame:
    """Add the metrics that the rules judge, whole numbers, to rows that have the counts."""
    return df.withColumns({
        "symbol_rate": F.expr("if(word_chars > 0, 1000 * n_symbols div word_chars, 0)"),
        "word_length": F.expr("if(n_words > 0, 100 * word_chars div n_words, 0)"),
        "dup_line_rate": F.expr("if(n_words > 0, 1000 * n_dup_lines div n_words, 0)"),
    })


def sketch(df: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The sketch of each metric in each group, of the rows that pass the base rules: (groups, metric, value, n).
    Counts are added up before they are shuffled, so a group is as large as its distinct values, however many
    rows it has."""
    metrics = F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name in METRICS
    ]))
    cut = F.expr("shiftleft(shiftright(value, greatest(length(bin(value)) - 6, 0)), greatest(length(bin(value)) - 6, 0))")
    return (
        df.filter(~F.col("base_failed")).select(*groups, metrics.alias("m")).select(*groups, "m.metric", "m.value")
        .groupBy(*groups, "metric", cut.alias("value")).agg(F.count("*").alias("n"))
    )


def merged(sketches: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """The sketch of the union of all groups that agree in `groups`, or of sketches taken apart."""
    return sketches.groupBy(*groups, "metric", "value").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, groups: tuple[str, ...], width: int = 3) -> DataFrame:
    """Per group and metric: `docs`, and limits `low` and `high`, `width` times the distance of the quartiles
    (at least the metric's least spread) below the first and above the third quartile."""
    by = Window.partitionBy(*groups, "metric")
    ranked = sketches.withColumns({
        "upto": F.sum("n").over(by.orderBy("value")),
        "docs": F.sum("n").over(by),
    })
    quartiles = ranked.groupBy(*groups, "metric").agg(
        F.max("docs").alias("docs"),
        F.min(F.when(4 * F.col("upto") >= F.col("docs"), F.col("value"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("docs"), F.col("value"))).alias("q3"),
    )
    least = F.create_map(*[F.lit(x) for name, (spread, _) in METRICS.items() for x in (name, spread)])
    both = F.col("metric").isin([name for name, (_, low_too) in METRICS.items() if low_too])
    reach = width * F.greatest(F.col("q3") - F.col("q1"), least[F.col("metric")])
    return quartiles.select(
        *groups, "metric", "docs",
        F.when(both, F.col("q1") - reach).alias("low"),
        (F.col("q3") + reach).alias("high"),
    )


def limits(sketches: DataFrame, least_docs: int = 100) -> DataFrame:
    """One row per language and source: `low_<metric>` and `high_<metric>`. A group of fewer than `least_docs`
    documents takes the limits of its language, and a language of fewer those of the whole corpus."""

    def wide(groups: tuple[str, ...], suffix: str) -> DataFrame:
        own = fences(merged(sketches, groups), groups)
        return own.groupBy(*groups).agg(
            F.max("docs").alias(f"docs{suffix}"),
            *[
                F.max(F.when(F.col("metric") == name, F.col(side))).alias(f"{side}_{name}{suffix}")
                for name in METRICS for side in ("low", "high")
            ],
        )

    own = wide(("lang", "source"), "_own")
    lang = wide(("lang",), "_lang").withColumnRenamed("lang", "_lang")
    whole = wide((), "_whole").select(F.struct("*")).scalar()
    joined = own.join(lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("_all", whole)
    chosen = []
    for name in METRICS:
        for side in ("low", "high"):
            c = f"{side}_{name}"
            chosen.append(
                F.when(F.col("docs_own") >= least_docs, F.col(f"{c}_own"))
                .when(F.col("docs_lang") >= least_docs, F.col(f"{c}_lang"))
                .otherwise(F.col(f"_all.{c}_whole")).alias(c)
            )
    return joined.select("lang", "source", *chosen)


def judged(metrics: DataFrame, limits_of: DataFrame) -> DataFrame:
    """Add `kept` to rows with counts and metrics: false for those that failed the base rules or have a metric
    beyond the limits of their language and source. Rows of a group without limits are judged by the base rules alone."""
    right = limits_of.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    fits = ~F.col("base_failed")
    for name in METRICS:
        inside = (F.col(name) >= F.coalesce(f"low_{name}", name)) & (F.col(name) <= F.coalesce(f"high_{name}", name))
        fits = fits & inside
    on = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    return (
        metrics.join(right, on, "left").withColumn("kept", fits)
        .drop(*right.columns)
    )


def corpus_limits(metrics: DataFrame) -> DataFrame:
    """The limits of a corpus, from the sketches of its documents that pass the base rules, as a small
    written table: the planner sees its size and broadcasts it only if that is below its own limit."""
    return written(limits(sketch(metrics)), "limits")


def quality_rules(docs: DataFrame) -> DataFrame:
    """All columns of `docs` (with text, lang, source) of the documents that the rules keep."""
    columns = docs.columns
    marked = docs.withColumnsRenamed({c: f"doc:{c}" for c in columns}).withColumns(
        {c: F.col(f"`doc:{c}`") for c in ("text", "lang", "source")}
    )
    # written once, with the rows: counting the words anew would take longer than reading them back
    metrics = written(with_metrics(with_counts(marked)).drop("text"), "metrics")
    kept = judged(metrics, corpus_limits(metrics)).filter("kept")
    return kept.select([F.col(f"`doc:{c}`").alias(c) for c in columns])

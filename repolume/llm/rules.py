"""Quality rules whose cutoffs are chosen under control of the risk.

A rule rejects a text whose value exceeds a cutoff. Texts that are labelled fall, by a hash of
the id, into a smaller part to learn from and a larger one to prove with. In the first, each
stratum (a band of text lengths) gets a path: the cutoffs of the grids that catch bad texts
which the rule's more lenient cutoff misses, from those that reject the fewest good texts on.
At a place of the path all cutoffs up to it are in force together. In the second part the
places are tried in turn: of n good texts the rules together would reject k, and the exact
binomial probability of at most k rejections, if the true rate were ``RISK``, must stay under
the error level. The walk ends at the first place that fails, so trying many places needs no
correction (the path does not depend on the texts that prove it); the strata share the error
level (Bonferroni), those apart that have too few good texts to prove anything. With
probability 1 - ERROR, in every stratum, all rules together reject at most RISK of the good
texts. A stratum without evidence rejects nothing beyond the base.

Everything is a DataFrame expression: hashes of words and windows, sorted within the row.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolume.llm.common import one_label, written

RISK, ERROR = 0.02, 0.05
LEAST_WORDS = 50
BANDS = (100, 250, 1000)  # first number of words of the second and later strata
LEARNT = 4  # one labelled text in so many is learnt from, the others prove

# Rules and their cutoffs, from the most lenient to the strictest.
CUTOFFS = {
    "symbol_share": (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01),
    "exclaim_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05),
    "capital_share": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "repeat_share": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "line_share": (0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "word_length": (60.0, 40.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0, 9.0),
}

GAP = r"[\x20\x09-\x0D]+"


def _combine(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def features(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_exclaims, n_capitals of every row; all 0 for a null text.

    Repeated windows are found by sorting: by a window's hash, then its three words, then its
    place, so equal windows are neighbours, and neighbours count as equal by their words.
    Arrays are combined pairwise, so no step looks back into an array for each of its
    elements, and a text of n words takes n log n.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = documents.select(F.col("doc_id").cast("long"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "doc_id",
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_exclaims"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        lines.alias("lines"),
        F.array_remove(F.split("text", GAP, -1), "").alias("words"),
    )
    df = df.select(
        "doc_id", "n_symbols", "n_exclaims", "n_capitals",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "words",
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    plain = df.columns[:-2]
    inner = F.greatest(F.size("hashes") - 2, F.lit(0))
    pairs = F.zip_with(
        F.slice("hashes", F.lit(1), inner), F.slice("hashes", F.lit(2), inner), _combine
    )
    df = df.select(
        *plain,
        F.zip_with(pairs, F.slice("hashes", F.lit(3), inner), _combine).alias("hash"),
        *(F.slice("words", F.lit(i + 1), inner).alias(c) for i, c in enumerate("abc")),
    )
    some = F.size("hash") > F.size(F.array_distinct("hash"))
    parts = ("hash", *"abc")
    windows = F.transform(
        F.arrays_zip(*parts),
        lambda x, i: F.struct(*(x[p].alias(p) for p in parts), i.cast("long").alias("place")),
    )
    df = df.select(*plain, F.when(some, F.sort_array(windows)).alias("sorted"))
    count = F.size("sorted")
    after = F.zip_with(  # same as the one after
        "sorted",
        F.slice("sorted", F.lit(2), count),
        lambda x, y: F.coalesce(reduce(and_, (x[p] == y[p] for p in parts)), F.lit(False)),
    )
    df = df.select(*plain, "sorted", after.alias("after"))
    same = F.concat(F.array(F.lit(False)), F.slice("after", F.lit(1), count - 1))
    places = F.zip_with(
        "sorted",
        F.zip_with(same, "after", lambda a, b: a | b),
        lambda s, twice: F.when(twice, s["place"]).otherwise(F.lit(-1)),
    )
    df = df.select(
        *plain, F.sort_array(F.array_remove(places, F.lit(-1).cast("long"))).alias("places")
    )
    steps = F.zip_with(
        "places",
        F.slice("places", F.lit(2), F.greatest(F.size("places"), F.lit(0))),
        lambda a, b: F.least(F.lit(3).cast("long"), F.coalesce(b - a, F.lit(3).cast("long"))),
    )
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x)
    return df.select(*plain, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def _values() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / chars,
        "exclaim_share": F.col("n_exclaims") / words,
        "capital_share": F.col("n_capitals") / chars,
        "repeat_share": F.col("n_repeat_words") / words,
        "line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "word_length": F.col("word_chars") / words,
    }


def _stratum() -> Column:
    return sum(((F.col("n_words") >= b).cast("int") for b in BANDS), F.lit(0))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words")
    )


def at_most(k: Column, n: Column, rate: float) -> Column:
    """Exact probability of at most ``k`` of ``n`` at ``rate``, summed in logs."""
    odds = F.log(F.lit(rate / (1 - rate)))
    first = n * F.log(F.lit(1 - rate))
    step = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(
        F.array().cast("array<bigint>")
    )

    def add(state: Column, j: Column) -> Column:
        term = state["term"] + F.log((n - j + 1) / j) + odds
        top = F.greatest(state["sum"], term)
        return F.struct(
            term.alias("term"),
            (top + F.log(F.exp(state["sum"] - top) + F.exp(term - top))).alias("sum"),
        )

    start = F.struct(first.alias("term"), first.alias("sum"))
    return F.exp(F.aggregate(step, start, add, lambda state: state["sum"]))


def _tried() -> list[Column]:
    """Each cutoff of each rule, and whether it rejects the row."""
    values = _values()
    return [
        F.struct(
            F.lit(rule).alias("rule"),
            F.lit(step).alias("step"),
            F.lit(float(cutoff)).alias("cutoff"),
            (values[rule] > cutoff).cast("long").alias("rejected"),
        )
        for rule, grid in CUTOFFS.items()
        for step, cutoff in enumerate(grid)
    ]


def _paths(learnt: DataFrame) -> DataFrame:
    """stratum, rule, step, cutoff, place from labelled rows. At most as many rows as the grids
    have cutoffs, in each stratum. Of cutoffs that reject equally many good texts those of the
    rule that catches the most bad ones with no more come first, then by its name."""
    of_rule = Window.partitionBy("stratum", "rule").orderBy("step")
    of_stratum = Window.partitionBy("stratum").orderBy("good", F.desc("caught"), "rule", "step")
    return (
        learnt.select("stratum", "label", F.explode(F.array(*_tried())).alias("t"))
        .groupBy("stratum", "t.rule", "t.step", "t.cutoff")
        .agg(
            F.sum(F.col("t.rejected") * F.col("label")).alias("good"),
            F.sum(F.col("t.rejected") * (1 - F.col("label"))).alias("bad"),
        )
        .withColumn("before", F.lag("bad", 1, 0).over(of_rule))
        .where("bad > before")
        .withColumn("caught", F.max("bad").over(Window.partitionBy("stratum", "rule", "good")))
        .withColumn("place", F.row_number().over(of_stratum))
        .select("stratum", "rule", "step", "cutoff", "place")
    )


def cutoffs(
    measured: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR
) -> DataFrame:
    """stratum, place, rule, step, cutoff, n, k, chance, level, and whether the walk passed the
    place: of ``n`` good texts ``k`` are rejected by the cutoffs up to it together."""
    marked = measured.where(~base_failed()).join(one_label(labels, "quality"), "doc_id")
    marked = marked.withColumn("stratum", _stratum())
    learning = F.pmod(F.xxhash64("doc_id"), F.lit(LEARNT)) == 0
    path = _paths(marked.where(learning))
    steps = F.sort_array(F.collect_list(F.struct("place", "rule", "cutoff")))
    whole = path.groupBy("stratum").agg(steps.alias("path"))
    values = F.create_map(*(x for rule, v in _values().items() for x in (F.lit(rule), v)))
    first = F.array_min(
        F.transform(
            F.filter("path", lambda x: F.element_at("value", x["rule"]) > x["cutoff"]),
            lambda x: x["place"],
        )
    )
    proving = marked.where(~learning & (F.col("label") == 1)).withColumn("value", values)
    rejected = (
        proving.join(F.broadcast(whole), "stratum", "left")  # one row for each of the bands
        .groupBy("stratum", first.alias("place"))
        .agg(F.count("*").alias("m"))
    )
    able = F.pow(F.lit(1 - risk), F.col("n")) <= error / (len(BANDS) + 1)
    totals = rejected.groupBy("stratum").agg(F.sum("m").alias("n")).where(able)
    # one row for each of the bands
    totals = totals.withColumn("shares", F.count("*").over(Window.partitionBy(F.lit(1))))
    until = Window.partitionBy("stratum").orderBy("place")
    counted = path.join(F.broadcast(totals), "stratum").join(
        rejected.where("place IS NOT NULL"), ["stratum", "place"], "left"
    )
    counted = counted.withColumn("k", F.sum(F.coalesce("m", F.lit(0))).over(until))
    # more than the expected number is never enough evidence, and long to sum
    chance = F.when(F.col("k") <= F.col("n") * risk, at_most(F.col("k"), F.col("n"), risk))
    counted = counted.withColumns(
        {"chance": F.coalesce(chance, F.lit(1.0)), "level": F.lit(error) / F.col("shares")}
    )
    passed = F.max((F.col("chance") > F.col("level")).cast("int")).over(until) == 0
    return counted.select(
        "stratum", "place", "rule", "step", "cutoff", "n", "k", "chance", "level",
        passed.alias("passed"),
    )


def judge(
    documents: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR
) -> DataFrame:
    """The features of every row, base_failed, rejected_by (rules in order of name), kept.

    A null or empty text has no words and fails the base. A null id is judged like any row.
    Repeated ids are judged one by one, and all count if labelled. A value equal to a cutoff
    passes. A stratum with fewer than 217 good texts to prove with (at the defaults), one without bad texts to learn from, and a table without labels reject by the base
    alone. A very long text is one row, sorted within its task; an empty table gives no rows.
    Only ``doc_id`` and ``text`` are read of ``documents``.
    """
    spark = documents.sparkSession
    measured = written(spark, features(documents), "rule-features")
    chosen = (
        cutoffs(measured, labels, risk, error)
        .where("passed")
        .groupBy("stratum", "rule")
        .agg(F.min("cutoff").alias("cutoff"))
        .groupBy("stratum")
        .pivot("rule", sorted(CUTOFFS))
        .agg(F.first("cutoff"))
    )
    chosen = chosen.select(
        "stratum", *(F.col(rule).alias(f"cut_{rule}") for rule in sorted(CUTOFFS))
    )
    values = _values()
    failed = F.array_compact(
        F.array(
            *(
                F.when(values[rule] > F.col(f"cut_{rule}"), F.lit(rule))
                for rule in sorted(CUTOFFS)
            )
        )
    )
    return (
        measured.withColumn("stratum", _stratum())
        .join(F.broadcast(chosen), "stratum", "left")  # one row for each of the bands
        .withColumn("base_failed", base_failed())
        .withColumn("rejected_by", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .drop(*(f"cut_{rule}" for rule in CUTOFFS))
    )

"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of WINDOW words, a window into shingles. A document
contains a window only if it holds all of its shingles in their places, so it must hold the
rarest one: each window is looked up by that necessary shingle alone. The place of the match
fixes where the window would begin (positional bound) and whether it fits into the document
(length bound); then all shingles of the window must stand in their places.

Everything is a DataFrame expression or join. The documents are read once: of their
shingles only those that occur in the benchmark are kept, with their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolume.llm.common import written

WINDOW = 10
SHINGLE = 4
# Up to this many distinct shingles (8 bytes each) of the benchmark are broadcast.
BROADCAST_SHINGLES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(column: str) -> Column:
    """Words of a text with A-Z in lower case; none for null. A text of ASCII alone has as
    many bytes as characters, and lower() is faster there."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )
    return F.array_remove(F.split(low, BETWEEN, -1), "")


def _hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_array(hashes: str, size: int) -> Column:
    """Hash of each ``size`` neighbouring words, by doubling: hashes of 2, then of 3 or 4."""

    def joined(a: Column, b: Column, offset: int) -> Column:
        many = F.greatest(F.size(b) - offset, F.lit(0))
        return F.zip_with(
            F.slice(a, F.lit(1), many),
            F.slice(b, F.lit(1 + offset), many),
            lambda x, y: F.xxhash64(x, y),
        )

    one = F.col(hashes)
    if size == 1:
        return one
    two = joined(one, one, 1)
    if size == 2:
        return two
    return joined(two, one, 2) if size == 3 else joined(two, two, 2)


def _shingles(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The keys, n_words and the shingles of ``text``, worked out step by step, so that no
    array is computed again for each use."""
    df = df.select(*keys, _hashes_of_text().alias("hashes"))
    if size == 4:
        df = df.select(
            *keys, F.size("hashes").alias("n_words"), shingle_array("hashes", 2).alias("pairs")
        )
        many = F.greatest(F.size("pairs") - 2, F.lit(0))
        four = F.zip_with(
            F.slice("pairs", F.lit(1), many),
            F.slice("pairs", F.lit(3), many),
            lambda x, y: F.xxhash64(x, y),
        )
        return df.select(*keys, "n_words", four.alias("shingles"))
    return df.select(
        *keys, F.size("hashes").alias("n_words"), shingle_array("hashes", size).alias("shingles")
    )


def _hashes_of_text() -> Column:
    return F.transform(word_array("text"), lambda w: F.xxhash64(w))


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, size (words), q (shingle size), code (hash of the words), offset, shingle:
    one row per item, window and place of a shingle in it."""
    items = benchmark.select(
        F.col("item_id").cast("long"), _hashes_of_text().alias("hashes")
    ).where(F.size("hashes") > 0)
    cut = items.select(
        "item_id",
        F.least(F.size("hashes"), F.lit(window)).alias("size"),
        "hashes",
        F.explode(
            F.sequence(F.lit(1), F.greatest(F.size("hashes") - window + 1, F.lit(1)))
        ).alias("begin"),
    )
    cut = cut.select(
        "item_id", "size", F.slice("hashes", F.col("begin"), F.col("size")).alias("hashes")
    )
    cut = cut.groupBy("item_id", "hashes", "size").agg(F.lit(1).alias("one"))
    q = F.least(F.col("size"), F.lit(SHINGLE))
    shingles = shingle_array("hashes", 1)
    for n in range(2, SHINGLE + 1):
        shingles = F.when(q == n, shingle_array("hashes", n)).otherwise(shingles)
    code = F.concat_ws("-", F.xxhash64("hashes"), F.hash("hashes"), "size")
    return cut.select(
        "item_id", "size", q.alias("q"), code.alias("code"), F.posexplode(shingles)
    ).withColumnsRenamed({"pos": "offset", "col": "shingle"})


def occurrences(documents: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, text_hash, n_words, q, place, shingle: for every row one with place -1, and
    one for each shingle that the benchmark has. ``wanted`` has (q, shingle)."""
    few = wanted.count() <= BROADCAST_SHINGLES
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn(
        "text_hash", F.xxhash64("text")
    )
    out = None
    for q in sizes:
        own = wanted.where(F.col("q") == q).select("shingle", F.lit(True).alias("known"))
        df = _shingles(docs, ["doc_id", "text_hash", "text"], q).drop("text")
        # the first entry stands for the row itself
        marked = F.concat(F.array(F.lit(0).cast("long")), F.col("shingles"))
        df = df.select(
            "doc_id", "text_hash", "n_words", F.posexplode(marked).alias("place", "shingle")
        )
        df = df.join(F.broadcast(own) if few else own, "shingle", "left")
        itself = (F.col("place") == 0) if q == sizes[0] else F.lit(False)
        df = df.where(itself | (F.col("known") & (F.col("place") > 0))).select(
            "doc_id",
            "text_hash",
            "n_words",
            F.lit(q).alias("q"),
            (F.col("place") - 1).alias("place"),
            "shingle",
        )
        out = df if out is None else out.unionByName(df)
    return out


KEY = ["doc_id", "text_hash"]


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on the key, where null equals null."""
    right = right.withColumnsRenamed({k: f"r_{k}" for k in KEY})
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in KEY]
    return left.join(right, on[0] & on[1], how).drop(*(f"r_{k}" for k in KEY))


def contained(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n_words), one for each row of ``documents``, and occurrences
    (doc_id, text_hash, code, size, start) of benchmark windows, each once, with the windows
    by item (code, item_id) beside them."""
    spark = documents.sparkSession
    parts = written(spark, windows(benchmark, window), "benchmark-windows")
    sizes = sorted((r.q for r in parts.select("q").distinct().collect()), reverse=True)
    wanted = parts.select("q", "shingle").distinct()
    found = occurrences(documents, wanted, sizes or [SHINGLE])
    found = written(spark, found, "benchmark-shingles")
    rows = found.where("place = -1").select(*KEY, "n_words")
    there = found.where("place >= 0").dropDuplicates([*KEY, "q", "place"])

    frequency = there.groupBy("q", "shingle").agg(F.count("*").alias("frequency"))
    shapes = parts.select("code", "size", "q", "offset", "shingle").distinct()
    ordered = shapes.join(frequency, ["q", "shingle"], "left").groupBy("code", "size", "q").agg(
        F.min(F.struct(F.coalesce("frequency", F.lit(0)).alias("f"), "shingle", "offset")).alias(
            "rarest"
        ),
        F.sort_array(F.collect_list(F.struct("offset", "shingle"))).alias("all"),
    )
    necessary = ordered.where("rarest.f > 0").select(
        "code", "size", "q", "rarest.shingle", F.col("rarest.offset").alias("offset"), "all"
    )
    candidates = (
        there.join(necessary, ["q", "shingle"])
        .withColumn("start", F.col("place") - F.col("offset"))
        .where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
        .select(*KEY, "code", "size", "q", "start", F.inline("all"))
        .withColumn("place", F.col("start") + F.col("offset"))
    )
    places = there.select(*KEY, "q", "place", "shingle")
    places = places.withColumnsRenamed({c: f"r_{c}" for c in places.columns})
    agreed = candidates.join(
        places,
        F.col("doc_id").eqNullSafe(F.col("r_doc_id"))
        & F.col("text_hash").eqNullSafe(F.col("r_text_hash"))
        & (F.col("q") == F.col("r_q"))
        & (F.col("place") == F.col("r_place"))
        & (F.col("shingle") == F.col("r_shingle")),
    )
    verified = (
        agreed.groupBy(*KEY, "code", "size", "q", "start")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") == F.col("size") - F.col("q") + 1)
        .select(*KEY, "code", "size", "start")
    )
    return rows, written(spark, verified, "benchmark-hits"), parts.select("code", "item_id").distinct()


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW
) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, item_ids (sorted as strings) for every row.

    Null and empty texts have no words; items without words have no window; without items
    nothing is hit. Repeated rows, null ids and repeated item ids are counted as they stand
    (an id once in ``item_ids``; null item ids are left out there). Only ``doc_id``, ``text``
    and ``item_id`` are read.
    """
    rows, hits, owners = contained(documents, benchmark, window)
    words = (
        hits.select(
            *KEY,
            F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("w"),
        )
        .groupBy(*KEY, "w")
        .agg(F.lit(1).alias("one"))
        .groupBy(*KEY)
        .agg(F.count("*").alias("n_hit"))
    )
    items = (
        hits.select(*KEY, "code")
        .distinct()
        .join(owners.where(F.col("item_id").isNotNull()), "code")
        .groupBy(*KEY)
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    out = _same(_same(rows, words, "left"), items, "left")
    none = F.array().cast("array<string>")
    return out.select(
        *KEY,
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
    )

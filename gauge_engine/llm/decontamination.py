"""Benchmark decontamination by spaced seeds, in DataFrame expressions only.

A seed is a fixed mask over consecutive words: marked positions are hashed, the others are
ignored, so a word replaced at an ignored place does not hide a copied passage. Seeds of
documents are joined with seeds of the benchmark. Each hit lines a document up with an
item; around it the words are compared place by place, and a passage counts if enough
words of some stretch agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gauge_engine.session import materialize

# Masks by the number of words of the item. Marked places of the long ones are six in a stretch
# of 9, 11 and 12 words. The ones for 9 to 13 words meet every stretch with the replacements
# that PERCENT leaves (`tests/llm/test_decontamination.py` enumerates them).
MASKS = ("111010011", "11010001101", "101100010011")
SHORT_MASKS = ("111011", "1110011", "1101011")
MOST_SHORT = 13
# Items of fewer words have to be held word for word: one mask, all of it marked.
LEAST_SPACED = 9
# Shorter items are no passages.
SHORTEST = 5
# A stretch of so many words (or the whole item) with so many of a hundred words equal.
STRETCH = 16
PERCENT = 80
# Rows and bytes up to which a written table is sent to all executors.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20
# Bytes of a row without its arrays.
ROW_BYTES = 32


def sized(df: DataFrame, array_col: str | None = None) -> DataFrame:
    """A written table, marked for broadcast if it is small enough; else joined by shuffle.

    Rows of a fixed width are counted; with ``array_col``, eight bytes for each of its elements
    are counted too.
    """
    if array_col is None:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    width = F.lit(ROW_BYTES) + 8 * F.size(array_col).cast("bigint")
    held = df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased runs of letters and digits."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(found, lambda w: F.xxhash64(w))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(id_col, text_col)


def _seeds(hashes: Column, mask: str) -> Column:
    """One 64-bit seed per place at which the mask fits."""
    marked = [i for i, m in enumerate(mask) if m == "1"]
    places = F.sequence(F.lit(0), F.size(hashes) - len(mask))
    seeds = F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in marked]))
    return F.when(F.size(hashes) >= len(mask), seeds).otherwise(F.array().cast("array<bigint>"))


def masks_for(n: int) -> tuple[str, ...]:
    """The masks that look for an item of ``n`` words."""
    if n < LEAST_SPACED:
        return ("1" * n,)
    return SHORT_MASKS if n <= MOST_SHORT else MASKS


def _all_seeds(hashed: DataFrame, masks: list[str], *keep: str, own: bool = False) -> DataFrame:
    """``seed, mask, place`` and the columns to keep, in one pass: the seeds of all masks stand
    one behind the other in one array. ``hashed`` has ``hashes``; with ``own``, a row has the
    seeds of the masks for its number of words only."""
    n, none = F.size("hashes"), F.array().cast("array<bigint>")

    def fits(mask: str, size: Column) -> Column:
        if not own:
            return size >= len(mask)
        if mask in MASKS:
            return size > MOST_SHORT
        return size.between(LEAST_SPACED, MOST_SHORT) if mask in SHORT_MASKS else size == len(mask)

    joined = F.concat(*[F.when(fits(m, n), _seeds(F.col("hashes"), m)).otherwise(none) for m in masks])
    exploded = hashed.select(*keep, n.alias("_n"), F.posexplode(joined).alias("_i", "seed"))
    before, mask, place = F.lit(0), F.lit(None), F.lit(None)
    for i, m in enumerate(masks):
        here = F.when(fits(m, F.col("_n")), F.col("_n") - len(m) + 1).otherwise(0)
        inside = (F.col("_i") >= before) & (F.col("_i") < before + here)
        mask = F.when(inside, F.lit(i)).otherwise(mask)
        place = F.when(inside, F.col("_i") - before).otherwise(place)
        before = before + here
    return exploded.select(*keep, "seed", mask.alias("mask"), place.alias("place"))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``key, id, item, start, matched, stretch``: documents that hold a passage of an item.

    ``key`` is a hash of id and text and names the row; ``start`` is the word at which the
    best stretch begins, ``matched`` how many of its ``stretch`` words agree.

    Words are lower-cased runs of letters and digits, compared by 64-bit hashes. Items of
    ``LEAST_SPACED`` words or more match with replaced words, shorter ones word for word; items
    under ``SHORTEST`` words are no passages and, like null and empty texts, match nothing.
    Null ids are kept as null, repeated rows share one result, an empty table on either side
    gives no rows. Other columns are ignored. Of equally good stretches the first is given.
    Very long texts are searched whole; a hit carries only the words beside its item.
    """
    worded = benchmark.select(F.col(item_col).alias("item"), word_hashes(F.col(item_text_col)).alias("words"))
    # A text is named by a hash, as ids can be null or stand for several texts.
    items = materialize(
        worded.where(F.size("words") >= SHORTEST).distinct().withColumn("name", F.xxhash64("item", "words")), "benchmark-items"
    )
    # Item lengths decide which masks documents need: a handful of rows, as long items are one.
    lengths = items.select(F.least(F.size("words"), F.lit(MOST_SHORT + 1)).alias("n")).distinct().collect()
    masks = sorted({m for r in lengths for m in masks_for(r["n"])}) or list(MASKS)
    seeds = materialize(
        _all_seeds(items.select("name", F.col("words").alias("hashes"), F.size("words").alias("n")), masks, "name", "n", own=True)
        .withColumnRenamed("place", "item_place"),
        "benchmark-seeds",
    )
    hashed = docs.select(
        row_key(id_col, text_col).alias("key"), word_hashes(F.col(text_col)).alias("hashes")
    )
    hits = materialize(
        _all_seeds(hashed, masks, "key")
        .join(sized(seeds), ["seed", "mask"])
        .select("key", "name", "n", (F.col("place") - F.col("item_place")).alias("shift"))
        .distinct(),
        "seed-hits",
    )
    keyed = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    found = keyed.join(sized(materialize(hits.select("key").distinct(), "hit-keys")), "key", "left_semi").dropDuplicates(["key"])
    # Only the words beside the item travel on.
    beside = F.slice("doc", F.greatest("shift", F.lit(0)) + 1, F.col("n") + F.least("shift", F.lit(0)))
    lined = (
        hits.join(found.select("key", "id", word_hashes(F.col("_text")).alias("doc")), "key")
        .select("key", "id", "name", "n", "shift", beside.alias("beside"))
        .join(sized(items, "words"), "name")
    )
    agree = F.transform("words", lambda w, i: (F.get("beside", i + F.least("shift", F.lit(0))) == w).cast("int"))
    measured = lined.select(
        "key", "id", "item", "shift", F.transform(agree, lambda a: F.coalesce(a, F.lit(0))).alias("agree"),
        F.least("n", F.lit(STRETCH)).alias("stretch"), (F.col("n") < LEAST_SPACED).alias("exact"),
    )
    sums = F.transform(
        F.sequence(F.lit(0), F.size("agree") - F.col("stretch")),
        lambda i: F.struct(
            F.aggregate(F.slice("agree", i + 1, F.col("stretch")), F.lit(0), lambda a, x: a + x).alias("matched"),
            (-i).alias("back"),
        ),
    )
    best = measured.withColumn("best", F.array_max(sums)).where(
        100 * F.col("best.matched") >= F.when(F.col("exact"), 100).otherwise(PERCENT) * F.col("stretch")
    )
    return (
        best.groupBy("key", "id", "item")
        .agg(F.max(F.struct("best.matched", (F.col("best.back") - F.col("shift")).alias("back"), "stretch")).alias("top"))
        .select(
            "key", "id", "item", F.greatest(-F.col("top.back"), F.lit(0)).alias("start"), F.col("top.matched").alias("matched"),
            F.col("top.stretch").alias("stretch"),
        )
    )


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` without a passage of the benchmark, with their own columns."""
    leaks = materialize(
        find_leaks(docs, benchmark, id_col, text_col, item_col, item_text_col).select("key").distinct(), "leaks"
    )
    held = docs.select(row_key(id_col, text_col).alias("key"), F.struct("*").alias("_row"))
    return held.join(sized(leaks), "key", "left_anti").select("_row.*")

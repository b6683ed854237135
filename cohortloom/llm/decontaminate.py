"""Benchmark decontamination by spaced seeds (op 4), in DataFrame functions only.

Words are runs of letters and digits, lower case. At each position of a text and of a benchmark item
every mask gives one hash of the words it keeps (it ignores the words under a 0). Equal hashes put an
item beside a text; words are then compared place by place over the whole item. A text is
contaminated by an item if at least ``least`` of the item's words agree in place, or ``run`` words in
a row do.

Null text: no words. Items of fewer than four words are not searched, null items neither. Repeated
item_ids count as one. Null doc_id stands for a row like another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm import common as C

MASKS = ("1111", "11011", "1100101")
MOST_BROADCAST = 2_000_000  # seeds; 24 bytes each


def words_of(text: Column) -> Column:
    split = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed(words: Column, mask: int, keep: list[int]):
    return lambda i: F.struct(F.xxhash64(F.lit(mask), *[F.get(words, i + j) for j in keep]).alias("seed"), i.alias("at"))


def seeds_of(words: Column) -> Column:
    """Structs of a seed hash and its position, for all masks."""
    parts = []
    for k, mask in enumerate(MASKS):
        n = F.size(words) - len(mask)
        at = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(at, _seed(words, k, [i for i, c in enumerate(mask) if c == "1"])))
    return F.concat(*parts)


def _run(same: Column) -> Column:
    """Longest run of true values."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s, x):
        now = F.when(x, s["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(now, s["best"]).alias("best"))

    return F.aggregate(same, zero, step, lambda s: s["best"])


def overlaps(docs: DataFrame, items: DataFrame, least: float = 0.8, run: int = 13) -> DataFrame:
    """``k1, k2, item_id, start, similarity, run`` for each item found in a text."""
    items = items.select("item_id", words_of(F.col("text")).alias("item")).filter(F.size("item") >= 4)
    items = C.stored(items.distinct(), "items")
    seeds = items.select("item_id", F.explode(seeds_of(F.col("item"))).alias("s")).select("item_id", F.col("s.seed").alias("seed"), F.col("s.at").alias("item_at"))
    seeds = C.stored(seeds.distinct(), "seeds")
    keyed = C.text_keys(docs)
    texts = keyed.select("k1", "k2", words_of(F.col("text")).alias("words"))
    at = texts.select("k1", "k2", F.explode(seeds_of(F.col("words"))).alias("s")).select("k1", "k2", F.col("s.seed").alias("seed"), F.col("s.at").alias("at"))
    # Beyond the bound of the benchmark's size the seeds meet in a shuffle.
    near = seeds.select("item_id", "seed", "item_at")
    hits = at.join(F.broadcast(near) if seeds.count() <= MOST_BROADCAST else near, "seed")
    # One place of an item in a text is often hit by many seeds; compare it once.
    hits = C.stored(hits.select("k1", "k2", "item_id", (F.col("at") - F.col("item_at")).alias("start")).distinct(), "seed-hits")
    hits = hits.join(keyed.dropDuplicates(["k1", "k2"]), ["k1", "k2"]).join(items, "item_id")
    own = words_of(F.col("text"))
    start = F.col("start")
    hits = hits.select("k1", "k2", "item_id", "item", "start", F.slice(own, F.greatest(start, F.lit(0)) + 1, F.greatest(F.size("item") + F.least(start, F.lit(0)), F.lit(0))).alias("own"))
    shifted = F.concat(F.array_repeat(F.lit(None).cast("long"), F.greatest(-F.col("start"), F.lit(0))), F.col("own"))
    same = F.zip_with("item", shifted, lambda a, b: F.coalesce(a == b, F.lit(False)))
    hits = hits.withColumn("same", F.slice(same, F.lit(1), F.size("item")))
    found = hits.select("k1", "k2", "item_id", "start", (F.size(F.filter("same", lambda x: x)) / F.size("item")).alias("similarity"), _run(F.col("same")).alias("run"))
    return found.filter((F.col("similarity") >= least) | (F.col("run") >= run))


def contamination(docs: DataFrame, items: DataFrame, least: float = 0.8, run: int = 13) -> DataFrame:
    """``doc_id, contaminated, items`` (sorted item_ids), ``similarity`` (greatest) for each row of ``docs``."""
    found = overlaps(docs, items, least, run).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("similarity").alias("similarity"))
    keys = C.text_keys(docs).select("k1", "k2")
    return keys.join(C.stored(found, "contaminated"), ["k1", "k2"], "left").select(
        C.doc_id_of(F.col("k1")).alias("doc_id"), F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )


def clean(docs: DataFrame, items: DataFrame, least: float = 0.8, run: int = 13) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    found = C.stored(overlaps(docs, items, least, run).select("k1", "k2").distinct(), "contaminated")
    text = F.coalesce(F.col("text"), F.lit(""))
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) == found.k1
    return docs.join(found, own & (F.xxhash64(text) == found.k2), "left_anti")

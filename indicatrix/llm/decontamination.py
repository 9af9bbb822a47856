"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, and exact shingle similarity of what they find."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from indicatrix.llm.common import Scratch, words_of

SHINGLE, THRESHOLD = 5, 0.8
#: A fingerprint has eight blocks of eight bits. Fingerprints at most RADIUS bits apart have a block at most BLOCK_RADIUS bits apart: 8 * 3 > 23.
BLOCKS, BLOCK_BITS, BLOCK_RADIUS, RADIUS = 8, 8, 2, 23
#: Items are searched for in lots of about so many items and words, each with one pass over the documents. The broadcast block values have 296 rows
#: of three longs for each item, so 2.4 million; the broadcast anchors at most a row for every three words. A lot of more words (one long item) is not broadcast.
ITEMS_AT_ONCE, WORDS_AT_ONCE = 8_000, 2_000_000
#: Lane sums hold items of up to so many shingles; longer ones skip the fingerprints and go to the exact test.
LANE_MAX = 65_535


def shingles(words: Column, width=SHINGLE) -> Column:
    """64-bit hashes of every five (or width) words in a row; of all words where there are fewer."""
    width = width if isinstance(width, Column) else F.lit(width)
    count = F.greatest(F.size(words) - width + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(words, i, width)))


def simhash(hashes: Column) -> Column:
    """Bit b is set where more than half of the shingles, repeats counted, have it set in their hash.

    Sixteen sums of four 16-bit lanes count all 64 bits at once: sum j has the bits j, j + 16, j + 32 and j + 48.
    """
    lanes = F.lit(0x0001_0001_0001_0001).cast("long")
    sums = F.aggregate(hashes, F.array_repeat(F.lit(0).cast("long"), 16),
                       lambda acc, h: F.transform(acc, lambda v, j: v + F.call_function("shiftrightunsigned", h, j).bitwiseAND(lanes)))

    def bits(v: Column, j: Column) -> Column:
        set_ = [F.when(F.shiftrightunsigned(v, 16 * q).bitwiseAND(F.lit(0xFFFF).cast("long")) * 2 > F.size(hashes), F.lit(1 << (16 * q)).cast("long")).otherwise(F.lit(0).cast("long"))
                for q in range(4)]
        return F.call_function("shiftleft", set_[0] + set_[1] + set_[2] + set_[3], j)

    return F.aggregate(F.transform(sums, bits), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def block(fingerprint: Column, number) -> Column:
    return F.call_function("shiftrightunsigned", fingerprint, number * BLOCK_BITS).bitwiseAND(F.lit(2**BLOCK_BITS - 1).cast("long"))


def numbered(hashes: Column) -> Column:
    """Each hash with how often it has occurred so far, so that sets of them intersect as multisets do."""
    repeats = F.transform(hashes, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(hashes, F.lit(1), i + 1), lambda y: y == x))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.transform(hashes, lambda x: F.xxhash64(x, F.lit(1)))).otherwise(repeats)


def similarity(left: Column, right: Column) -> Column:
    """Weighted Jaccard of two shingle arrays, the weight of a shingle being its count."""
    shared = F.size(F.array_intersect(numbered(left), numbered(right)))
    return shared / (F.size(left) + F.size(right) - shared)


def _items(benchmark: DataFrame) -> DataFrame:
    words = words_of(F.lower(F.coalesce(benchmark["text"], F.lit(""))))
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), words.alias("item_words")).where(F.size("item_words") > 0).distinct()
    return items.withColumns({"item_key": F.xxhash64("item_id", "item_words"), "n": F.size("item_words"), "item_shingles": shingles(F.col("item_words"))}) \
        .withColumn("item_print", F.when(F.size("item_shingles") <= LANE_MAX, simhash(F.col("item_shingles"))))


def _anchors(items: DataFrame) -> DataFrame:
    """Word triples of an item such that every window as like as the threshold has one of them.

    A window that reaches similarity t shares at least t * L of the item's L shingles, so it lacks at most L - ceil(t * L). Triples at steps of
    three are disjoint, a shingle of five words has at most one of them whole, and a triple the window lacks costs the item at least one shingle:
    one triple more than that number cannot all be lacking. Those with the longest middle words are taken. Items of one or two words are
    their own anchor.
    """
    total = F.size("item_shingles")
    lacking = total - F.ceil(total * F.lit(THRESHOLD) - F.lit(1e-9)).cast("int")
    triples = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.col("n") / 3).cast("int") - 1, F.lit(0))),
                          lambda i: F.struct((-F.char_length(F.get("item_words", F.least(i * 3 + 1, F.col("n") - 1)))).alias("rank"), F.least(i * 3 + 1, F.col("n") - 1).alias("offset")))
    chosen = F.slice(F.sort_array(triples), F.lit(1), lacking + 1)
    return items.select("n", "item_words", F.explode(F.transform(chosen, lambda c: c["offset"])).alias("offset")) \
        .select("n", F.get("item_words", F.col("offset")).alias("word"),
                F.when(F.col("n") > 1, F.get("item_words", F.col("offset") - 1)).alias("left"), F.when(F.col("n") > 2, F.get("item_words", F.col("offset") + 1)).alias("right")).distinct()


def _block_key(n: Column, number: Column, value: Column) -> Column:
    """The size of an item, a block's number and its value as one long."""
    return (n.cast("long") * BLOCKS + number) * 2**BLOCK_BITS + value


def _near_values(items: DataFrame) -> DataFrame:
    """Every block value within BLOCK_RADIUS bits of an item's block: 8 * 37 rows of three longs for each item."""
    flips = [sum(1 << b for b in bits) for k in range(BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), k)]
    each = items.select("item_key", "n", "item_print", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")) \
        .select("*", F.explode(F.transform(F.array(*[F.lit(f).cast("long") for f in flips]), lambda f: block(F.col("item_print"), F.col("block")).bitwiseXOR(f))).alias("value"))
    return each.select(_block_key(F.col("n"), F.col("block"), F.col("value")).alias("key"), "item_key", "item_print")


def _first_near_block(left: Column, right: Column) -> Column:
    """The first block in which two fingerprints are at most BLOCK_RADIUS bits apart."""
    return reduce(lambda rest, b: F.when(F.bit_count(block(left.bitwiseXOR(right), F.lit(b))) <= BLOCK_RADIUS, b).otherwise(rest), range(BLOCKS - 1, -1, -1), F.lit(None).cast("int"))


def _runs(docs: DataFrame, items: DataFrame, few_words: bool) -> DataFrame:
    """doc_id, row, n and runs: for each text and item size the windows that have an anchor, as runs of first words that do not overlap.

    Hits are places, never words: a text of one repeated anchor has a row of five numbers for each place, and its overlapping windows are one run.
    """
    worded = docs.select("doc_id", "row", words_of(F.lower("text")).alias("words"))
    each = worded.select("doc_id", "row", "words", F.posexplode("words").alias("at", "word"))
    anchors = _anchors(items)
    hits = each.join(F.broadcast(anchors) if few_words else anchors, "word") \
        .where(F.col("left").isNull() | ((F.col("at") > 0) & (F.get("words", F.col("at") - 1) == F.col("left")))) \
        .where(F.col("right").isNull() | (F.get("words", F.col("at") + 1) == F.col("right")))
    # all windows of the item's size that have the anchor; where the text is shorter, the text
    last = F.greatest(F.size("words") - F.col("n"), F.lit(0))
    low, high = F.least(F.greatest(F.col("at") + F.when(F.col("n") <= 2, 1).otherwise(2) - F.col("n"), F.lit(0)), last), F.least(F.greatest(F.col("at") - 1, F.lit(0)), last)
    low, high = F.least(low, high), F.greatest(low, F.when(F.col("n") <= 2, F.least(F.col("at"), last)).otherwise(high))
    ranges = hits.select("doc_id", "row", "n", low.alias("low"), high.alias("high")).groupBy("doc_id", "row", "n", "low").agg(F.max("high").alias("high"))
    before = W.partitionBy("doc_id", "row", "n").orderBy("low").rowsBetween(W.unboundedPreceding, -1)
    fresh = ranges.withColumn("low", F.greatest("low", F.coalesce(F.max("high").over(before) + 1, F.lit(0)))).where("low <= high")
    return fresh.groupBy("doc_id", "row", "n").agg(F.collect_list(F.struct("low", "high")).alias("runs"))


def _search(docs: DataFrame, items: DataFrame, scratch: Scratch, lot: int, few_words: bool, some_long: bool) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    runs = scratch.keep(_runs(texts, items, few_words), f"runs-{lot}").withColumnsRenamed({"doc_id": "run_doc", "row": "run_row"})
    # repeated rows are one again before anything is made of their words
    found = texts.join(runs, texts["doc_id"].eqNullSafe(runs["run_doc"]) & (texts["row"] == runs["run_row"])) \
        .groupBy("doc_id", "row", "n").agg(F.first("text").alias("text"), F.first("runs").alias("runs"))
    # items of fewer than five words meet windows of just as many words; texts of fewer than five have one shingle of all their words
    windows = found.select("doc_id", "n", "runs", words_of(F.lower("text")).alias("words")) \
        .select("doc_id", "n", "runs", shingles(F.col("words"), F.least("n", F.lit(SHINGLE))).alias("hashes")) \
        .select("doc_id", "n", "hashes", F.explode("runs").alias("run")) \
        .select("doc_id", "n", "hashes", F.explode(F.sequence("run.low", "run.high")).alias("start")) \
        .select("doc_id", "n", "start", F.slice("hashes", F.col("start") + 1, F.greatest(F.col("n") - (SHINGLE - 1), F.lit(1))).alias("window")).where(F.size("window") > 0)
    prints = windows.withColumn("print", simhash(F.col("window")))
    keyed = prints.select("*", F.posexplode(F.array(*[block(F.col("print"), F.lit(b)) for b in range(BLOCKS)])).alias("block", "value")) \
        .withColumn("key", _block_key(F.col("n"), F.col("block"), F.col("value")))
    met = keyed.join(F.broadcast(_near_values(items.where("item_print is not null"))), "key") \
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS) \
        .where(F.col("block") == _first_near_block(F.col("print"), F.col("item_print"))).select("doc_id", "item_key", "start", "window")
    candidates = met.join(items.select("item_key", "item_id", "n", "item_shingles"), "item_key").drop("item_key")
    if some_long:  # longer than the lanes of a fingerprint: the exact test alone
        candidates = candidates.unionByName(windows.join(items.where("item_print is null").select("item_id", "n", "item_shingles"), "n"))
    return candidates.withColumn("similarity", similarity(F.col("window"), F.col("item_shingles"))) \
        .where(F.col("similarity") >= THRESHOLD).select("doc_id", "item_id", "start", "n", "similarity")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each (document, item) with a window of the item's size whose five-word shingles are at least 0.8 like the item's.

    doc_id, item_id, similarity of the best window (weighted Jaccard, a shingle's weight being its count), its first word's place and its length.
    Words are lower-cased. Only windows that have one of the item's anchors are fingerprinted; no window that reaches the threshold lacks
    one (see _anchors). Fingerprints find the items: the blocks find every item within 23 of 64 bits; at the threshold shingle sets
    differ in 10 bits on average, with a deviation of 3. Null texts and items are empty and match nothing; items
    without an id are found like others and count as one item whose id is null; repeated rows give one result; documents with
    one id share results. Texts shorter than an item are one window. Items are searched in lots, so what is broadcast is bounded. Very long texts, also of one
    repeated anchor, cost a row of numbers for each place of an anchor. The places of the windows are kept in the checkpoint folder.
    """
    items, scratch = _items(benchmark), Scratch(docs.sparkSession, "decontamination")
    size = items.agg(F.count("*").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.coalesce(F.max(F.size("item_shingles")), F.lit(0)).alias("longest")).first()
    lots = max(1, -(-size["items"] // ITEMS_AT_ONCE), -(-size["words"] // WORDS_AT_ONCE))
    found = []
    for lot in range(lots):
        mine = items.where(F.pmod(F.xxhash64("item_key"), F.lit(lots)) == lot) if lots > 1 else items
        words = mine.agg(F.sum("n")).first()[0] if lots > 1 else size["words"]
        found.append(_search(docs, mine, scratch, lot, (words or 0) <= 2 * WORDS_AT_ONCE, size["longest"] > LANE_MAX))
    best = reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("best"))
    return best.select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("start_word"), F.col("best.n").alias("n_words"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose document has no passage of the benchmark, unchanged."""
    hit = contaminated(docs, benchmark).select(F.col("doc_id").alias("__hit")).distinct()
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit["__hit"]), "left_anti")

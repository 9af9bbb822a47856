"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from indicatrix.llm.common import shuffle_width

#: Cells of a fingerprint; a multiple of three, one third for each hash.
CELLS = 24
#: A paragraph is a line, cut after the first sentence end behind so many characters.
PARAGRAPH_CHARS = 60


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def paragraph_digests(text: Column) -> Column:
    """The distinct 64-bit digests of a text's paragraphs. Lines break at \\n; an empty text has none."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PARAGRAPH_CHARS}}}[^\n.!?]*[.!?]*"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def signed(digests: Column, sign: int) -> Column:
    return F.transform(digests, lambda k: F.struct(F.lit(sign).alias("s"), k.alias("k")))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(3))


def sketch(items: Column, cells: Column) -> Column:
    """Cells (n, k, c) of signed digests: each digest goes to one cell in each third; n sums signs, k and c are xors of digests and checks.

    Items are put in order of their cell, behind one empty item for each cell, and every run from one empty item to the next is summed.
    """
    third = (cells / 3).cast("long")

    def item(i: Column, real: int, n: Column, k: Column, c: Column) -> Column:
        return F.struct(i.alias("i"), F.lit(real).alias("real"), n.alias("n"), k.alias("k"), c.alias("c"))

    def places(x: Column) -> Column:
        spots = (F.pmod(x["k"], third), third + F.pmod(F.xxhash64(x["k"], F.lit(1)), third), third * 2 + F.pmod(F.xxhash64(x["k"], F.lit(2)), third))
        return F.array(*[item(spot, 1, x["s"], x["k"], _check(x["k"])) for spot in spots])

    zero = F.lit(0).cast("long")
    empty = F.transform(F.sequence(zero, third * 3 - 1), lambda i: item(i, 0, F.lit(0), zero, zero))

    def summed(ordered: Column) -> Column:
        def runs(heads: Column) -> Column:
            def run(head: Column, at: Column) -> Column:
                length = F.coalesce(F.get(heads, at + 1), F.size(ordered) + 1) - head
                start = F.struct(F.lit(0).alias("n"), zero.alias("k"), zero.alias("c"))
                return F.when(length == 1, start).otherwise(F.aggregate(F.slice(ordered, head, length), start, lambda a, x: F.struct(
                    (a["n"] + x["n"]).alias("n"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["c"].bitwiseXOR(x["c"]).alias("c"))))

            return F.transform(heads, run)

        return _let(F.filter(F.sequence(F.lit(1), F.size(ordered)), lambda p: F.element_at(ordered, p)["real"] == 0), runs)

    return _let(F.sort_array(F.concat(F.flatten(F.transform(items, places)), empty)), summed)


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(difference: Column, cells: Column) -> Column:
    """The signed digests that two sketches do not share, or null where the cells are too few.

    In a round, every cell that holds one digest (n is 1 or -1 and the check fits) gives it up, and it is taken out of its other cells.
    """
    def pure(x: Column) -> Column:
        return (F.abs(x["n"]) == 1) & (x["c"] == _check(x["k"]))

    def state(left, found, live) -> Column:
        return F.struct(left.alias("cells"), found.alias("found"), live.alias("live"))

    def round_(s: Column, _r: Column) -> Column:
        def take(p: Column) -> Column:
            return F.when(F.size(p) == 0, state(s["cells"], s["found"], F.lit(False))).otherwise(
                state(subtract(s["cells"], sketch(p, cells)), F.concat(s["found"], p), F.lit(True)))

        alone = F.array_distinct(F.transform(F.filter(s["cells"], pure), lambda x: F.struct(x["n"].alias("s"), x["k"].alias("k"))))
        return F.when(s["live"], _let(alone, take)).otherwise(s)

    start = state(difference, F.array().cast("array<struct<s:int,k:bigint>>"), F.lit(True))
    return F.aggregate(F.sequence(F.lit(1), F.lit(30)), start, round_,
                       lambda s: F.when(~F.exists(s["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["c"] != 0)), s["found"]))


def differing(left: Column, right: Column, left_sketch: Column, right_sketch: Column) -> Column:
    """The signed digests on one side only: the two fingerprints subtracted and peeled; on failure larger sketches, three times, and at last the sets themselves."""
    both = F.concat(signed(left, 1), signed(right, -1))
    enough = (F.size(left) + F.size(right)) * F.lit(1.6) + 12
    larger = [peel(sketch(both, cells), cells) for cells in (F.ceil(enough * factor / 3) * 3 for factor in (1, 2, 4))]
    sets = F.concat(signed(F.array_except(left, right), 1), signed(F.array_except(right, left), -1))
    return F.coalesce(peel(subtract(left_sketch, right_sketch), F.lit(CELLS)), *larger, sets)


def likeness(left: Column, right: Column, apart: Column) -> Column:
    """Shared digests over all digests, from the sizes and the number of differing ones; 1 where both have none."""
    total, d = F.size(left) + F.size(right), F.size(apart)
    return F.when(total == 0, F.lit(1.0)).otherwise((total - d) / (total + d))


def as_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda x: F.concat_ws(":", F.hex(x["n"]), F.hex(x["k"]), F.hex(x["c"]))), " ")


def with_next_text(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text, the text of the next row in ascending doc_id order; the last row has the first one's.

    Rows go to ranges of doc_id between quantiles and look ahead in their range; the last of a range takes the first text of the next one.
    Rows with one doc_id follow in the order of text hash and text; null ids come first. A single row is its own next.
    """
    spark = docs.sparkSession
    ranges = 4 * shuffle_width(spark)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("cuts")).first()["cuts"] or []
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    key = F.struct("doc_id", "tie", "text")
    rows = docs.withColumn("tie", F.xxhash64("text")).withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(cuts, lambda c: c <= F.col("doc_id")))))
    ends = rows.groupBy("range").agg(F.min(key).alias("first"))  # one row for each range
    order = W.orderBy("range")
    after = ends.select("range", F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))["text"].alias("after"))
    ahead = rows.withColumn("ahead", F.lead("text").over(W.partitionBy("range").orderBy("doc_id", "tie", "text")))
    return ahead.join(F.broadcast(after), "range").select("doc_id", "text", F.coalesce("ahead", "after").alias("next_text"))  # as many rows as ranges


def edited_text(text: Column, following: Column) -> Column:
    """The last quarter of a text's code points (rounded down) replaced by the first as many, or all, of the following text."""
    n = F.char_length(text)
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are to each other and to the next document's.

    Null texts count as empty; an empty text has a fingerprint of empty cells. Equal texts have equal fingerprints. Repeated rows stay. Very long
    texts get larger sketches when they are compared, as many cells as both have paragraphs.
    """
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = with_next_text(texts).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       *[paragraph_digests(F.col(c)).alias(d) for c, d in (("text", "a"), ("edited", "b"), ("next_text", "c"))])
    rows = rows.withColumns({f"sketch_{x}": sketch(signed(F.col(x), 1), F.lit(CELLS)) for x in "abc"})
    rows = rows.withColumns({f"apart_{x}": differing(F.col("a"), F.col(x), F.col("sketch_a"), F.col(f"sketch_{x}")) for x in "bc"})
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch_a")).alias("fingerprint"), as_text(F.col("sketch_b")).alias("edited_fingerprint"),
                       likeness(F.col("a"), F.col("b"), F.col("apart_b")).alias("near_edited"), likeness(F.col("a"), F.col("c"), F.col("apart_c")).alias("near_next"),
                       F.size(F.filter("apart_b", lambda x: x["s"] > 0)).alias("n_lost"), F.size(F.filter("apart_b", lambda x: x["s"] < 0)).alias("n_gained"))

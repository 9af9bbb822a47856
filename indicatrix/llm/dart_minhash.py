"""Near-duplicates by DartMinHash signatures, banded joining and exact weighted Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.llm.common import TEXT_ROWS, Scratch
from indicatrix.llm.components import components
from indicatrix.llm.packing import find_words, mix, text_bytes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
#: 25 bands of 4 coordinates: a pair at the threshold meets in none of them twice in a million times.
BANDS, ROWS = 25, 4
COORDINATES = BANDS * ROWS
#: Pairs whose signatures agree in less than this share are not compared: at the threshold, six deviations below the mean.
LEAST_AGREEMENT = 0.55
#: Members of a component that one task compares with one another.
BLOCK = 1000


def elements(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts in a row, the hash of every (five-word shingle, how often it has occurred in the text so far), and where each text's begin.

    A shingle's weight is its count; layer l of a shingle is the unit of weight from l to l + 1. So two texts share as many elements as
    the smaller weights of their shingles sum to. A text of fewer than five words has one shingle of all its words, a text without words has none.
    """
    data, offsets = text_bytes(texts)
    starts, ends, before = find_words(data, offsets)
    words = word_hashes(data, starts, ends)
    count = np.diff(before)
    n = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    first = before[doc] + np.arange(bounds[-1]) - bounds[doc]
    total = np.zeros(len(first), np.uint64)
    for k in range(SHINGLE):
        there = first + k < before[doc + 1]
        total = np.where(there, total * np.uint64(0x2545F4914F6CDD1D) + words[np.minimum(first + k, len(words) - 1)], total) if len(words) else total
    total = mix(total)
    order = np.argsort(mix(total + mix(doc.astype(np.uint64))))
    same = np.concatenate([[False], (total[order][1:] == total[order][:-1]) & (doc[order][1:] == doc[order][:-1])]) if len(order) else np.zeros(0, bool)
    run = np.maximum.accumulate(np.where(same, 0, np.arange(len(order)))) if len(order) else np.zeros(0, np.int64)
    layer = np.empty(len(order), np.uint64)
    layer[order] = (np.arange(len(order)) - run).astype(np.uint64)
    return mix(total ^ mix(layer + np.uint64(1))), bounds


#: Ranks are cut into slices; in one slice an element's layer has a Poisson number of darts with the slice's width as mean.
_SLICES = [0.0, 0.0625, 0.125, 0.25, 0.5, 1.0]


def _slice(number: int) -> tuple[float, float]:
    return (_SLICES[number], _SLICES[number + 1]) if number + 1 < len(_SLICES) else (float(number - len(_SLICES) + 2), float(number - len(_SLICES) + 3))


def _poisson_steps(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, 2 ... darts, until they reach one."""
    p, total, steps, k = np.exp(-mean), 0.0, [], 0
    while total < 1 - 1e-15 and k < 40:
        total += p
        steps.append(total)
        k += 1
        p *= mean / k
    return np.array(steps)


def signatures(items: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """DartMinHash: one row of COORDINATES numbers for each text; a text without elements has a row of the largest number.

    Each element throws the darts of its hash: how many fall in a slice of ranks, at which rank and to which coordinate depends on the element and slice alone.
    Darts up to a rank that yields k ln k + 2 k darts in a text on average are thrown, and the earliest of each coordinate is kept. Two texts agree in a coordinate
    with the probability of their weighted Jaccard similarity. A text with an empty coordinate throws on to twice the rank.
    """
    k, none = COORDINATES, np.uint64(2**64 - 1)
    n_docs = len(bounds) - 1
    out = np.full(n_docs * k, none, np.uint64)
    size = np.diff(bounds)
    doc = np.repeat(np.arange(n_docs), size)
    limit = (k * np.log(k) + 2 * k) / np.maximum(size, 1)
    done = np.zeros(n_docs)
    waiting = size > 0
    while waiting.any():
        number = 0
        top = limit[waiting].max()
        while _slice(number)[0] < top:
            low, high = _slice(number)
            mine = np.flatnonzero((waiting & (limit > low) & (done < high))[doc])
            if len(mine):
                salt = mix(np.array([number + 1], np.uint64))[0]
                seed = mix(items[mine] ^ salt)
                steps = _poisson_steps(high - low)
                darts = np.searchsorted(steps, (seed >> np.uint64(11)).astype(float) * 2.0**-53, "right")
                hit = np.flatnonzero(darts)
                for turn in range(int(darts.max()) if len(darts) else 0):
                    hit = hit[darts[hit] > turn]
                    dart = mix(seed[hit] + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64))
                    rank = low + (high - low) * ((dart >> np.uint64(32)).astype(float) * 2.0**-32)
                    to = mix(dart)
                    d = doc[mine[hit]]
                    inside = rank < limit[d]
                    value = (np.minimum(rank[inside] * 2.0**28, 2.0**40 - 1).astype(np.uint64) << np.uint64(24)) | (to[inside] & np.uint64(0xFFFFFF))
                    np.minimum.at(out, d[inside] * k + ((to[inside] >> np.uint64(32)) % np.uint64(k)).astype(np.int64), value)
            number += 1
        done = np.where(waiting, limit, done)
        waiting = waiting & (out.reshape(n_docs, k) == none).any(axis=1)
        limit = np.where(waiting, 2 * limit, limit)
    return out.reshape(n_docs, k)


def _bands(signature: np.ndarray) -> np.ndarray:
    total = np.zeros((len(signature), BANDS), np.uint64)
    for r in range(ROWS):
        total = mix(total + signature[:, r::ROWS] * np.uint64(2) + np.uint64(1))
    return total


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for batch in (big.slice(k, 128) for k in range(0, big.num_rows, 128)):
            items, bounds = elements(batch.column("text"))
            bands = _bands(signatures(items, bounds)).view(np.int64)
            full = np.diff(bounds) > 0
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)), pa.array(bands[full].reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), lists], names=["doc_id", "text_key", "bands"])


def similarity(left: np.ndarray, right: np.ndarray) -> float:
    """Weighted Jaccard of two sorted element arrays."""
    small, large = (left, right) if len(left) <= len(right) else (right, left)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    shared = int((large[at] == small).sum())
    return shared / (len(left) + len(right) - shared)


def merged_labels(texts: list[str], labels: list) -> list[tuple]:
    """Labels of members that links at or above the threshold connect: (label, smallest label of its class), where they differ.

    Pairs are tried from the most to the least agreeing signatures and compared exactly only while they are not connected, so every link that is left out joins
    members that are connected anyway. A pair takes ten bytes, and as many again while they are put in order.
    """
    flat, bounds = elements(pa.array(texts, pa.large_string()))
    signature = signatures(flat, bounds)
    own = [np.sort(flat[a:b]) for a, b in zip(bounds, bounds[1:])]
    size = np.diff(bounds)
    places: dict = {}
    parent = [places.setdefault(label, i) for i, label in enumerate(labels)]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tried: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(texts) - 1):
        agree = (signature[i + 1:] == signature[i]).sum(axis=1).astype(np.int16)
        fits = (agree >= LEAST_AGREEMENT * COORDINATES) & (np.minimum(size[i + 1:], size[i]) >= THRESHOLD * np.maximum(size[i + 1:], size[i]))
        j = np.flatnonzero(fits)
        tried.append((agree[j], np.full(len(j), i, np.int32), (j + i + 1).astype(np.int32)))
    if not tried:
        return []
    agree, a, b = (np.concatenate(x) for x in zip(*tried))
    tried.clear()
    for p in np.argsort(-agree, kind="stable"):
        i, j = int(a[p]), int(b[p])
        x, y = find(i), find(j)
        if x != y and similarity(own[i], own[j]) >= THRESHOLD:
            parent[max(x, y)] = min(x, y)
    classes: dict[int, list] = {}
    for label, i in places.items():
        classes.setdefault(find(i), []).append(label)
    return [(label, min(own_class)) for own_class in classes.values() for label in own_class if label != min(own_class)]


def _merge_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group; of each group, the labels that merge."""
    group, texts, labels = None, [], []

    def merged() -> pa.RecordBatch:
        found = merged_labels(texts, labels) if len(set(labels)) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["label", "root"])

    for big in batches:
        for batch in (big.slice(k, 256) for k in range(0, big.num_rows, 256)):
            for name, text, label in zip(*(batch.column(c).to_pylist() for c in ("group", "text", "label"))):
                if name != group:
                    if texts:
                        yield merged()
                    group, texts, labels = name, [], []
                texts.append(text)
                labels.append(label)
    if texts:
        yield merged()


def _merges(members: DataFrame, texts: DataFrame) -> DataFrame:
    """label and root of the labels that links within a group of members (group, text_key, label) merge."""
    rows = members.join(texts.hint("merge"), "text_key").select("group", "text", "label")
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(_merge_groups, "label binary, root binary")


def _relabel(members: DataFrame, merges: DataFrame) -> DataFrame:
    return members.join(merges, "label", "left").withColumn("label", F.coalesce("root", "label")).drop("root")


def _blocks(members: DataFrame) -> DataFrame:
    """component, text_key, block and blocks: components are split into blocks of about BLOCK members."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("text_key"), F.col("blocks")))


def near_classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_key (the text's digest), class_key (one text of the class) and class_id, the smallest doc_id among the near-duplicates of a row, of every row.

    Classes are the components of the links at weighted Jaccard 0.8 or more over five-word shingles. Equal texts are one node. Nodes that share a band are tied
    to the smallest node of the band's bucket, never to each other in pairs; the components of these ties hold all links that any bucket holds. Within a
    component the links are found exactly, block by block. A component of several blocks is merged by the classes of its blocks, and while it still has more than one class,
    all pairs of its blocks are compared, across classes alone: no bucket, component or block is cut short. Null texts are alone in their class; texts without words
    are near only to equal texts; rows with one doc_id may be in several classes.
    """
    key = F.unhex(F.md5(F.col("text").cast("binary")))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).where("text is not null").withColumn("text_key", key)
    signed = scratch.keep(rows.select("doc_id", "text_key", "text").mapInArrow(_sign, "doc_id long, text_key binary, bands array<long>"), "signed")
    nodes = signed.groupBy("text_key").agg(F.first("bands").alias("bands"))
    banded = nodes.select("text_key", F.posexplode("bands").alias("band", "value"))
    buckets = banded.groupBy("band", "value").agg(F.min("text_key").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    ties = banded.join(buckets, ["band", "value"]).where("text_key != lead").select(F.col("text_key").alias("a"), F.col("lead").alias("b")).distinct()
    tied = scratch.keep(components(ties, scratch, "ties"), "tied").select(F.col("node").alias("text_key"), F.col("root").alias("component"))
    texts = scratch.keep(rows.join(tied.hint("merge"), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text")), "texts")

    members = scratch.keep(_blocks(tied), "members")
    group = F.concat_ws("/", F.hex("component"), "block").alias("group")
    first = scratch.keep(_merges(members.select(group, "text_key", F.col("text_key").alias("label")), texts), "merges-0")
    labelled = scratch.keep(_relabel(members.withColumn("label", F.col("text_key")), first), "labelled-0")
    # components of several blocks: the classes of the blocks meet, again in blocks, until one block holds them or nothing merges
    level, wide = 0, labelled.where("blocks > 1")
    while not wide.isEmpty():
        level += 1
        roots = scratch.keep(_blocks(wide.select("component", F.col("label").alias("text_key")).distinct()), f"roots-{level}")
        merges = scratch.keep(_merges(roots.select(group, "text_key", F.col("text_key").alias("label")), texts), f"merges-{level}")
        wide = scratch.keep(_relabel(wide, merges), f"labelled-{level}")
        if roots.where("blocks > 1").isEmpty() or merges.isEmpty():
            break
    if level:
        # a component that still has several classes: all pairs of its blocks, across classes alone
        split = wide.groupBy("component").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("component")
        pairs = wide.join(split, "component").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("other != block") \
            .select(F.concat_ws("/", F.hex("component"), F.least("block", "other"), F.greatest("block", "other")).alias("group"), "text_key", "label")
        late = scratch.keep(_merges(pairs, texts), "merges")
        if not late.isEmpty():
            ends = components(late.select(F.col("label").alias("a"), F.col("root").alias("b")), scratch, "classes").select(F.col("node").alias("label"), "root")
            wide = _relabel(wide, ends)
    classes = labelled.where("blocks = 1").select("text_key", "label").unionByName(wide.select("text_key", "label")) if level else labelled.select("text_key", "label")
    classes = classes.withColumnRenamed("label", "root")
    scratch.drop("texts", "members", "tied")
    placed = signed.select("doc_id", "text_key").join(classes, "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))
    first = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    alone = docs.where(docs["text"].isNull()).select(docs["doc_id"].cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("text_key"), F.lit(None).cast("binary").alias("class_key"), docs["doc_id"].cast("long").alias("class_id"))
    return placed.join(first, "root").select("doc_id", "text_key", F.col("root").alias("class_key"), "class_id").unionByName(alone)


def first_of_each(docs: DataFrame) -> DataFrame:
    """One row of each class: that of the smallest doc_id, among rows of one id that of the smallest text digest. Null texts stay.

    All columns come back as they were, whatever their names. Empty texts are one class.
    """
    scratch = Scratch(docs.sparkSession, "near-first", batch_rows=TEXT_ROWS)
    classes = scratch.keep(near_classes(docs, scratch).where("text_key is not null"), "rows")
    order = F.struct(F.coalesce("doc_id", F.lit(-(2**63))), "text_key")  # a null id is the smallest
    kept = classes.groupBy("class_key").agg(F.min_by(F.struct("doc_id", "text_key"), order).alias("k"))
    kept = kept.select(F.col("k.doc_id").alias("__id"), F.col("k.text_key").alias("__key"))
    # all columns of a row travel as one struct, so none of theirs can clash with the keys
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("doc"), F.unhex(F.md5(docs["text"].cast("binary"))).alias("digest"))
    stay = keyed.join(kept, keyed["doc"].eqNullSafe(kept["__id"]) & (keyed["digest"] == kept["__key"]), "left_semi")
    if not classes.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        stay = stay.dropDuplicates(["doc", "digest"])
    return stay.unionByName(keyed.where("digest is null")).select(*[F.col("row")[c].alias(c) for c in docs.columns])

"""Exact ranked lexical search: documents as sparse integer vectors in forests of ball trees, searched best-first under integer bounds.

A term's part in a score is (weight of the term) * (impact of its count in the document), both integers, so a score is an inner product of an item's weights and a document's
impacts. Every chunk of documents becomes a ball tree: a node has a centre of whole numbers and a radius, rounded up, around all its documents; by Cauchy and
Schwarz no score below it exceeds <q, centre> + |q| * radius. With thousands of sparse terms one radius says little, so a node also keeps its extent in each
single term, a ball of one dimension; the smaller bound counts. All of it is integer arithmetic rounded up, so nothing at or above the twentieth score is ever cut.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from indicatrix.llm.common import Scratch, doc_texts
from indicatrix.llm.packing import find_words, text_bytes, word_hashes

TOP, LEAF = 20, 32
#: Documents of one tree, at most; fewer where there are many terms, so that its centres fit CENTRE_CELLS integers.
CHUNK_DOCS, CENTRE_CELLS = 4096, 2 << 20
#: Items are searched in groups of about so many bytes of text, which travel to all tasks; a longer item is a group by itself.
ITEM_BYTES = 2 << 20
#: Text that a task looks at in one step.
SEGMENT_BYTES = 2 << 20

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every run, one run after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


# ---- terms --------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Vocabulary:
    """The terms of a group of items, by ascending hash, with their bytes one after the other."""

    hashes: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and which ones: by hash, then byte by byte."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = word_hashes(data, starts, ends)
        seen = np.zeros(1 << 16, bool)
        seen[self.hashes & np.uint64(0xFFFF)] = True
        at = np.flatnonzero(seen[hashes & np.uint64(0xFFFF)])
        term = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        fits = (self.hashes[term] == hashes[at]) & (self.lengths[term] == (ends - starts)[at])
        at, term = at[fits], term[fits]
        if len(at):
            n = self.lengths[term]
            same = np.logical_and.reduceat(data[_gather(starts[at], n)] == self.data[_gather(self.starts[term], n)], np.cumsum(n) - n)
            at, term = at[same], term[same]
        return at, term


def terms_of(texts: list[str]) -> list[list[bytes]]:
    """The terms of each text in order, A-Z in lower case."""
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    data = _LOWER[data]
    starts, ends, before = find_words(data, offsets, _OUTSIDE)
    words = [data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())]
    return [words[a:b] for a, b in zip(before[:-1].tolist(), before[1:].tolist())]


def vocabulary(terms: set[bytes]) -> tuple[Vocabulary, dict[bytes, int]]:
    words = sorted(terms)
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(words), np.uint8)
    hashes = word_hashes(data, ends - lengths, ends)
    order = np.argsort(hashes)
    if (np.diff(hashes[order]) == 0).any():
        raise ValueError("two terms of a group of items have one hash: search with another ITEM_BYTES")
    return Vocabulary(hashes[order], data, (ends - lengths)[order], lengths[order]), {words[i]: k for k, i in enumerate(order.tolist())}


def _segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """The bytes in steps that end between words or texts, however long a text is."""
    a = 0
    while a < len(data):
        b = min(a + SEGMENT_BYTES, len(data))
        edge = int(offsets[np.searchsorted(offsets, b)])
        while b < edge:
            gaps = np.flatnonzero(_OUTSIDE[data[b:min(b + 65536, edge)]])
            if len(gaps):
                edge = b + int(gaps[0])
            b = min(b + 65536, edge)
        yield a, b
        a = b


def count_terms(texts: pa.Array, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text with repeats; and text, term and count of the known terms, in that order."""
    data, offsets = text_bytes(texts)
    n = np.zeros(len(offsets) - 1, np.int64)
    keys, counts, width = [], [], max(1, len(known.hashes))
    for a, b in _segments(data, offsets):
        first, last = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b))
        piece = _LOWER[data[a:b]]
        starts, ends, before = find_words(piece, np.clip(offsets[first:last + 1], a, b) - a, _OUTSIDE)
        n[first:last] += np.diff(before)
        at, term = known.find(piece, starts, ends)
        key, count = np.unique((np.searchsorted(before, at, "right") - 1 + first) * width + term, return_counts=True)
        keys.append(key), counts.append(count)
    if not keys:
        return n, *[np.zeros(0, np.int64)] * 3
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return n, key // width, key % width, np.bincount(place, np.concatenate(counts), len(key)).astype(np.int64)


def _vectors(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """doc_id, n, terms and counts of every document that has a term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, text, term, count = count_terms(batch.column("text"), known)
            kept = np.flatnonzero(n)
            bounds = pa.array(np.append(np.searchsorted(text, kept), len(text)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(t))) for x, t in ((term, np.int32), (count, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(kept)), pa.array(n[kept]), *lists], names=["doc_id", "n", "terms", "counts"])

    return doc_texts(docs).mapInArrow(counted, "doc_id long, n long, terms array<int>, counts array<long>")


# ---- trees --------------------------------------------------------------------------------------------------------

def _root_up(square: int) -> int:
    root = math.isqrt(square)
    return root + (root * root < square)


class Tree:
    """A ball tree over sparse rows (bounds into term and value, all values positive)."""

    def __init__(self, bounds: np.ndarray, term: np.ndarray, value: np.ndarray):
        self.names, term = np.unique(term, return_inverse=True)
        self.square = np.add.reduceat(value * value, bounds[:-1])
        self._rows = bounds, term, value
        self.low, self.high, self.second, self.radius, centres, extents, order = [], [], [], [], [], [], []
        self._grow(np.arange(len(bounds) - 1), order, centres, extents)
        self.order = np.concatenate(order)
        lengths = np.diff(bounds)[self.order]
        entries = _gather(bounds[:-1][self.order], lengths)
        self.bounds, self.term, self.value = np.append(0, np.cumsum(lengths)), term[entries], value[entries]
        for node in reversed(range(len(self.second))):
            if self.second[node] is not None:
                extents[node] = np.maximum(extents[node + 1], extents[self.second[node]])
        self.centres, self.extents, self.radius = np.array(centres).T.copy(), np.array(extents).T.copy(), np.array(self.radius, np.int64)
        del self._rows

    def _grow(self, rows: np.ndarray, order: list, centres: list, extents: list) -> int:
        """Add a node for the rows and those below it: the first child follows its parent, second names the other."""
        bounds, term, value = self._rows
        lengths = np.diff(bounds)[rows]
        entries = _gather(bounds[:-1][rows], lengths)
        t, x, firsts = term[entries], value[entries], np.cumsum(lengths) - lengths

        def squares(point: np.ndarray) -> np.ndarray:
            return self.square[rows] + int((point * point).sum()) - 2 * np.add.reduceat(x * point[t], firsts)

        node, centre = len(self.radius), np.bincount(t, x, len(self.names)).astype(np.int64) // len(rows)
        away = squares(centre)
        self.radius.append(_root_up(int(away.max())))
        self.second.append(None)
        self.low.append(sum(map(len, order)))
        centres.append(centre), extents.append(None), self.high.append(0)
        if len(rows) <= LEAF:
            extents[node] = np.zeros(len(self.names), np.int64)
            np.maximum.at(extents[node], t, x)
            order.append(rows)
        else:
            distances = []
            for _ in range(2):  # a row far from the centre, and one far from that
                far, point = int(away.argmax()), np.zeros(len(self.names), np.int64)
                point[t[firsts[far]:firsts[far] + lengths[far]]] = x[firsts[far]:firsts[far] + lengths[far]]
                away = squares(point)
                distances.append(away)
            ranked = rows[np.argsort(distances[0] - distances[1], kind="stable")]
            self._grow(ranked[:len(rows) // 2], order, centres, extents)
            self.second[node] = self._grow(ranked[len(rows) // 2:], order, centres, extents)
        self.high[node] = sum(map(len, order))
        return node

    def bound(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For every node a number that no score below it exceeds."""
        length = _root_up(sum(w * w for w in weight.tolist()))
        return np.minimum(weight @ self.centres[at] + length * self.radius, weight @ self.extents[at])

    def scores(self, node: int, query: np.ndarray) -> np.ndarray:
        """Of the documents of a node, in the tree's order."""
        a, b = self.low[node], self.high[node]
        entries = slice(self.bounds[a], self.bounds[b])
        return np.add.reduceat(query[self.term[entries]] * self.value[entries], self.bounds[a:b] - self.bounds[a])


class Best:
    """The highest scores so far, ties by ascending id, null ids last."""

    def __init__(self):
        self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == TOP else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        score, doc, null = (np.concatenate(p) for p in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[:TOP]
        self.score, self.doc, self.null = score[order], doc[order], null[order]


def search(tree: Tree, doc: np.ndarray, null: np.ndarray, term: np.ndarray, weight: np.ndarray, best: Best) -> int:
    """Add to best what the tree has for an item (ascending terms and their weights); how many documents were scored."""
    at = np.minimum(np.searchsorted(tree.names, term), len(tree.names) - 1)
    there = (tree.names[at] == term) & (weight > 0)
    at, weight = at[there], weight[there]
    if not len(at):
        return 0
    bounds = tree.bound(at, weight).tolist()
    query = np.zeros(len(tree.names), np.int64)
    query[at] = weight
    heap, scored = [(-bounds[0], 0)], 0
    while heap and -heap[0][0] >= best.least:
        node = heapq.heappop(heap)[1]
        if tree.second[node] is not None:
            for child in (node + 1, tree.second[node]):
                heapq.heappush(heap, (-bounds[child], child))
            continue
        found = tree.scores(node, query)
        rows = tree.order[tree.low[node]:tree.high[node]]
        scored += len(rows)
        good = found >= best.least
        if good.any():
            best.add(found[good], doc[rows[good]], null[rows[good]])
    return scored


# ---- search -------------------------------------------------------------------------------------------------------

def impacts(count: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What each count is worth in a document of n terms."""
    wide = 25 * int(n.max(initial=0)) * documents >= 1 << 63
    m = 75 + (np.array([25 * k * documents // terms for k in n.tolist()], np.int64) if wide else 25 * n * documents // terms)
    return 1_000_000_000 * count // (1000 * count + 12 * m)


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    waiting, n = [], 0
    for batch in batches:
        while batch.num_rows:
            waiting.append(batch.slice(0, size - n))
            n += waiting[-1].num_rows
            batch = batch.slice(waiting[-1].num_rows)
            if n == size:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, n = [], 0
    if n:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _searched(vectors: DataFrame, queries: list[tuple[int | None, np.ndarray, np.ndarray]], documents: int, terms: int, size: int) -> DataFrame:
    """item_id, doc_id and score: for each task and item the TOP highest scores; the scores of one chunk bound the search of the next."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best() for _ in queries]
        for table in _chunks(batches, size):
            lists = table.column("terms").combine_chunks(), table.column("counts").combine_chunks()
            lengths = np.diff(lists[0].offsets.to_numpy())
            term, count = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
            value = impacts(count, np.repeat(table.column("n").to_numpy(), lengths), documents, terms)
            full = np.flatnonzero(lengths)
            if not len(full):
                continue
            tree = Tree(np.append(0, np.cumsum(lengths[full])), term, value)
            ids = table.column("doc_id").combine_chunks()
            null, doc = ids.is_null().to_numpy(zero_copy_only=False)[full], ids.fill_null(0).to_numpy()[full]
            for (_, t, w), b in zip(queries, best):
                search(tree, doc, null, t, w, b)
        rows = [(q[0], b) for q, b in zip(queries, best) if len(b.score)]
        if rows:
            item = pa.array([i for i, b in rows for _ in b.score], pa.int64())
            doc = pa.array(np.concatenate([b.doc for _, b in rows]), mask=np.concatenate([b.null for _, b in rows]))
            yield pa.RecordBatch.from_arrays([item, doc, pa.array(np.concatenate([b.score for _, b in rows]))], names=["item_id", "doc_id", "score"])

    return vectors.mapInArrow(searched, "item_id long, doc_id long, score long")


def _groups(items: DataFrame) -> tuple[F.Column, int]:
    """A hash that deals the items into groups of at most twice ITEM_BYTES, or of one item; and how many groups."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / ITEM_BYTES))
    while True:
        group = F.pmod(F.xxhash64("item_id"), F.lit(n))
        over = items.groupBy(group.alias("g")).agg(F.sum(F.octet_length("text")).alias("b"), F.count_distinct(F.coalesce("item_id", F.lit(0)), F.col("item_id").isNull()).alias("k")).where(f"b > {2 * ITEM_BYTES} and k > 1")
        if over.isEmpty():
            return group, n
        n *= 2


def _top(rows: DataFrame, documents: int) -> DataFrame:
    """The TOP first rows of each item; first within parts of an item, as every task sends some."""
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(1 + math.isqrt(documents // 100_000))))
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("item_id", "part").orderBy(*best))).where(f"r <= {TOP}")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*best))).where(f"rank <= {TOP}").select("item_id", "rank", "doc_id", "score")


def top_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the 20 documents with the highest scores above 0 for each item; equal scores by ascending doc_id, null ids last.

    Rows of documents are documents each, also with one id or text. Rows of items with one id are one item, with the terms of all their different texts; an item without an
    id is one too. Texts that are null, empty or without terms have no rows. Texts of any length count whole. Other columns stay behind. Items are collected
    in groups of bounded size, each of which searches all documents; of the documents only counts come to the driver.
    """
    spark = docs.sparkSession
    items = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].alias("text")).where("text is not null").distinct()
    group, groups = _groups(items)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for g in range(groups):
        rows = items.where(group == g).collect()
        terms: dict[int | None, list[bytes]] = {}
        for row, found in zip(rows, terms_of([r["text"] for r in rows])):
            terms.setdefault(row["item_id"], []).extend(found)
        known, number = vocabulary({t for found in terms.values() for t in found})
        if not number:
            continue
        vectors = Scratch(spark, "search").keep(_vectors(docs, known), "vectors")
        documents, total = vectors.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            break
        df = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # one row for each term of the group
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(k, 0) + 1))) for k in range(len(number))], np.int64)
        queries = []
        for item, found in terms.items():
            term, times = np.unique(np.array([number[t] for t in found], np.int64), return_counts=True)
            queries.append((item, term, times * weight[term]))
        size = max(LEAF, min(CHUNK_DOCS, CENTRE_CELLS // len(number) * LEAF // 4))
        out = out.unionByName(_top(_searched(vectors, queries, documents, total, size), documents))
    return out


def oracle_sql() -> str:
    """The same ranking in DuckDB: every document that shares a term with the item is scored."""
    words = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
        tf AS MATERIALIZED (SELECT doc_id, len(w) AS n, t, count(*) AS tf FROM d, unnest(w) u(t) GROUP BY doc_id, w, t),
        whole AS (SELECT count(*)::HUGEINT AS documents, sum(len(w))::HUGEINT AS terms FROM d WHERE len(w) > 0),
        weights AS (SELECT t, floor(1000 * ln((2 * any_value(documents) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::HUGEINT AS weight FROM tf, whole GROUP BY t),
        q AS (SELECT item_id, t, count(*)::HUGEINT AS times FROM (SELECT item_id, unnest({words}) AS t FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, t),
        scores AS (SELECT item_id, doc_id, sum(times * weight * ((1000000000 * tf)::HUGEINT // (1000 * tf + 12 * (75 + (25 * n * documents) // terms)))) AS score
            FROM q JOIN weights USING (t) JOIN tf USING (t), whole GROUP BY item_id, doc_id),
        ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score::BIGINT AS score FROM scores WHERE score > 0)
        SELECT * FROM ranked WHERE rank <= {TOP}"""

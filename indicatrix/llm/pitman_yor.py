"""A hierarchical Pitman-Yor language model: a restaurant for each word before, above them one for each class of such words, above these one parent restaurant."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.llm.common import TEXT_ROWS, Scratch, shuffle_width
from indicatrix.llm.packing import find_words, mix, pack, pack_sorted, text_bytes, unpack, unpack_sorted, word_hashes

#: Classes of contexts, the level between the words before and the parent: a word's class is a hash of its last three bytes and its length up to four.
CLASSES = 1024
#: Sweeps of the sampler before the first kept one, and kept ones whose predictions are averaged.
BURN_IN, SAMPLES = 2, 3
#: Strengths of the restaurants of words, of classes and of the parent. Discounts are estimated from how many counts are one and two.
LINK_STRENGTH, STRENGTH, PARENT_STRENGTH = 1.0, 1.0, 1.0
#: A task holds about so many bytes of text at a time; a bucket of words comes from about so many.
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: Buckets of link hashes whose links are seated together.
LEAF = 4
#: Chunks are scored in so many lots, so that what buckets return is on disk for one lot at a time.
LOTS = 2

END = mix(np.array([0xE4D], np.uint64))[0]


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, each text closed by END; the class of each token as a context; and where each text's tokens begin."""
    data, offsets = text_bytes(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, before = find_words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    size = np.minimum(ends - starts, 4)
    tail = size.astype(np.uint64) << np.uint64(24)
    for k in range(3):
        tail |= np.where(size > k, data[np.maximum(ends - 1 - k, 0)] if len(data) else 0, 0).astype(np.uint64) << np.uint64(8 * k)
    own = (mix(tail) % np.uint64(CLASSES - 1)).astype(np.int64) + 1
    tokens, classes = np.insert(hashes, before[1:], END), np.insert(own, before[1:], 0)  # class 0: a text's begin, which follows an END
    return tokens, classes, before + np.arange(len(before))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    waiting, size = [], 0
    for big in batches:
        for batch in (big.slice(k, 64) for k in range(0, big.num_rows, 64)):
            waiting.append(batch)
            size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if size >= CHUNK_BYTES:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _cuts(ascending: np.ndarray, buckets: int) -> np.ndarray:
    """Where the numbers of each bucket, an equal share of all 64-bit numbers, begin, and where the last ones end."""
    inner = np.searchsorted(ascending, np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)) if buckets > 1 else np.zeros(0, np.int64)
    return np.concatenate([[0], inner, [len(ascending)]])


def _link_hashes(words: np.ndarray, link_word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each pair (word, word before), ascending, and the links in this order."""
    hashes = mix(words[link_word] ^ mix(words[context] + np.uint64(0x632BE59BD9B4E019)))
    order = np.argsort(hashes, kind="stable")
    return hashes[order], order


def _give_back() -> None:
    """Hand the memory that earlier calls freed back to the system: a worker is kept from task to task, and with it what it holds."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], field.type) for i, field in enumerate(schema)], schema=schema)


_CHUNK = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("pairs", pa.binary())])
_CHUNK_SQL = "kind string, chunk long, bucket int, words binary, pairs binary"


def _count(buckets: int):
    """Per chunk: its documents as links, that is pairs (word, word before); what the links are; and for each bucket of link hashes the links' training counts."""

    def rows_of(table: pa.Table, number: int) -> pa.RecordBatch:
        _give_back()
        tokens, classes, bounds = _tokens(table.column("text").combine_chunks())
        held = table.column("held_out").to_numpy()
        words, word = np.unique(tokens, return_inverse=True)
        before = np.concatenate([[np.searchsorted(words, END)], word[:-1]])
        links, link = np.unique(word * len(words) + before, return_inverse=True)
        link_word, context = links // len(words), links % len(words)
        kinds = np.zeros(len(words), np.int64)
        kinds[word] = classes
        doc = np.repeat(np.arange(table.num_rows), np.diff(bounds))
        counts = np.bincount(link[~held[doc]], minlength=len(links))
        ids = table.column("doc_id").fill_null(0).to_numpy()
        known = table.column("doc_id").is_valid().to_numpy().astype(np.int64)
        per_word = np.bincount(link_word, minlength=len(words))
        places = np.sort(doc * len(links) + link).astype(np.uint64)
        rows = [("docs", number, -1, pack_sorted(places), pack(ids, known, held.astype(np.int64), bounds)),
                ("parts", number, -1, pack_sorted(words), pack(per_word, context, kinds))]
        hashes, order = _link_hashes(words, link_word, context)
        cuts = _cuts(hashes, buckets)
        rows += [("links", number, k, pack_sorted(hashes[a:b]), pack(counts[order[a:b]])) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return _batch(rows, _CHUNK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for table in _chunks(batches):
            yield rows_of(table, number)
            number += 1

    return count


def _link(table: pa.Table) -> pa.Table:
    """Per bucket of link hashes: for each chunk its links' training counts over all chunks, and which of them no chunk before it has; and what the bucket's leaf must know.

    A leaf seats the links of two and more tokens of LEAF buckets, in the order of their hashes: it is told their counts, which chunks have them and which chunk was first.
    """
    rows = sorted(table.select(["chunk", "bucket", "words", "pairs"]).to_pylist(), key=lambda r: r["chunk"])
    hashes = [unpack_sorted(r["words"]) for r in rows]
    _, first, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    total = np.zeros(len(first), np.int64)
    np.add.at(total, place, np.concatenate([unpack(r["pairs"])[0] for r in rows]))
    own = np.zeros(len(place), np.int64)
    own[first] = 1
    ends = np.cumsum([len(h) for h in hashes])
    out = [("links", r["chunk"], r["bucket"], b"", pack(total[place[end - len(h):end]], own[end - len(h):end])) for r, h, end in zip(rows, hashes, ends)]
    many = total > 1
    if many.any():
        there = many[place]
        sizes = np.add.reduceat(there.astype(np.int64), ends - [len(h) for h in hashes])
        seated = (np.cumsum(many) - 1)[place[there]]
        out.append(("routes", rows[0]["bucket"], rows[0]["bucket"] // LEAF, b"", pack(total[many], np.array([r["chunk"] for r in rows]), sizes, np.diff(seated, prepend=0), own[there])))
    return pa.Table.from_batches([_batch(out, _CHUNK)])


def _meet(buckets: int):
    """Per chunk: its links and their training counts; and for each bucket of words the chunk's words and their classes of words before.

    Links that no earlier chunk has count here for all chunks: as customers of a word in a class (one for each link, the first table of its dish), as occurrences
    of the word, as words that follow the context, and as links of one and two tokens. Those of two and more tokens have tables to be seated: the bucket of their word
    learns which pair (word, class) and the bucket of the context which word their leaves will ask for, and the leaves from which buckets the answers come.
    """

    def meet(table: pa.Table) -> pa.Table:
        _give_back()
        rows = sorted(table.select(["chunk", "bucket", "words", "pairs"]).to_pylist(), key=lambda r: r["bucket"])
        words, (per_word, context, kinds) = unpack_sorted(rows[0]["words"]), unpack(rows[0]["pairs"])
        link_word = np.repeat(np.arange(len(words)), per_word)
        hashes, order = _link_hashes(words, link_word, context)
        found = [unpack(r["pairs"]) for r in rows[1:]]
        count, own = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        count[order], own[order] = np.concatenate([c for c, _ in found]), np.concatenate([o for _, o in found])
        count_here = count * own
        pairs, pair = np.unique(link_word * CLASSES + kinds[context], return_inverse=True)
        customers = np.bincount(pair[count_here > 0], minlength=len(pairs))
        occurs = np.zeros(len(words), np.int64)
        np.add.at(occurs, link_word, count_here)
        follow = np.bincount(context[count_here > 0], minlength=len(words))
        cuts, pair_word, ends = _cuts(words, buckets), pairs // CLASSES, np.concatenate([[0], np.cumsum(per_word)])
        number = rows[0]["chunk"]
        many = np.cumsum(count > 1) - 1
        out = [("counts", number, -2, b"", pack(count, per_word, context, kinds, many[order[count[order] > 1]]))]
        mine = count_here[order] > 1
        leaf = np.repeat(np.arange(buckets), np.diff(_cuts(hashes, buckets)))[mine] // LEAF
        mine = order[mine]
        bucket = np.repeat(np.arange(buckets), np.diff(cuts))
        word_bucket, context_bucket = bucket[link_word[mine]], bucket[context[mine]]
        starts = np.flatnonzero(np.diff(leaf, prepend=-1))
        out += [("leaf", number, int(leaf[x]), b"", pack(word_bucket[x:y], context_bucket[x:y], kinds[context[mine[x:y]]])) for x, y in zip(starts, [*starts[1:], len(leaf)])]
        asks = []
        for at, asked in ((word_bucket, pair[mine]), (context_bucket, context[mine])):
            by_bucket = np.argsort(at, kind="stable")
            asks.append((np.searchsorted(at[by_bucket], np.arange(buckets + 1)), asked[by_bucket], leaf[by_bucket]))
        (pair_cuts, pair_asked, pair_leaf), (word_cuts, word_asked, word_leaf) = asks
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                p, q = np.searchsorted(pair_word, [a, b])
                here = count_here[ends[a]:ends[b]]
                few = np.array([(here == 1).sum(), (here == 2).sum()], np.int64)
                i, j = slice(*pair_cuts[k:k + 2]), slice(*word_cuts[k:k + 2])
                out.append(("words", number, k, pack_sorted(words[a:b]), pack(np.bincount(pair_word[p:q] - a, minlength=b - a), pairs[p:q] % CLASSES, customers[p:q], occurs[a:b], follow[a:b], few,
                                                                              pair_asked[i] - p, pair_leaf[i], word_asked[j] - a, word_leaf[j])))
        return pa.Table.from_batches([_batch(out, _CHUNK)])

    return meet


def _merge(table: pa.Table) -> pa.Table:
    """Per bucket: its words' pairs (word, class) with customers over all chunks, the words' occurrences and followers, and what leaves ask for; pairs and words that no training text has are left out.

    In a row of its own, for the end: where each chunk's words and pairs are among the bucket's.
    """
    rows = sorted(table.select(["chunk", "words", "pairs"]).to_pylist(), key=lambda r: r["chunk"])
    parts = [(unpack_sorted(r["words"]), *unpack(r["pairs"])) for r in rows]
    word = np.concatenate([np.repeat(w, n) for w, n, *_ in parts])
    kind = np.concatenate([c for _, _, c, *_ in parts])
    count = np.concatenate([c for _, _, _, c, *_ in parts])
    seen = count > 0
    word, kind, count = word[seen], kind[seen], count[seen]
    order = np.lexsort((kind, word))
    word, kind, count = word[order], kind[order], count[order]
    head = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (kind[1:] != kind[:-1])])) if len(word) else np.zeros(0, np.int64)
    word, kind, count = word[head], kind[head], np.add.reduceat(count, head) if len(head) else count
    words, per_word = np.unique(word, return_counts=True)
    known = np.searchsorted(words, word) * CLASSES + kind
    occurs, follow = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    asked: list[list[np.ndarray]] = [[], [], [], []]
    found: list[list[np.ndarray]] = [[], [], [], []]
    for w, n, c, _, o, f, _, pair, pair_leaf, context, context_leaf in parts:
        at = np.minimum(np.searchsorted(words, w), max(len(words) - 1, 0))
        there = words[at] == w if len(words) else np.zeros(len(w), bool)
        np.add.at(occurs, at[there], o[there])
        np.add.at(follow, at[there], f[there])
        key = np.repeat(at, n) * CLASSES + c
        place = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
        has = np.repeat(there, n) & (known[place] == key) if len(known) else np.zeros(len(key), bool)
        for to, x in zip((*asked, *found), (place[pair], pair_leaf, at[context], context_leaf, there, at[there], has, place[has])):
            to.append(x)
    pair, pair_leaf, context, context_leaf = (np.concatenate(x) for x in asked)
    there, at, has, place = (np.concatenate(x).astype(np.int64) for x in found)
    sizes = [np.array([len(x) for x in xs]) for xs in (found[0], found[2])]
    places = pack(np.array([r["chunk"] for r in rows]), sizes[0], there, np.diff(at, prepend=0), sizes[1], has, np.diff(place, prepend=0))
    by_leaf, context_by_leaf = np.argsort(pair_leaf, kind="stable"), np.argsort(context_leaf, kind="stable")
    asks = pack(pair[by_leaf], pair_leaf[by_leaf], context[context_by_leaf], context_leaf[context_by_leaf])
    few = np.sum([p[6] for p in parts], axis=0)
    ones = np.ones(len(kind), np.int64), np.ones(len(words), np.int64)
    bucket, margins = table.column("bucket")[0].as_py(), _margins(kind, count, ones[0], per_word, per_word, ones[1], occurs, few)
    state = [bucket, pack(per_word, kind, count, occurs, follow, few), asks, [pack(count, *ones, follow)], *(m[0].as_py() for m in margins)]
    return pa.Table.from_batches([_batch([("state", *state), ("places", bucket, places, *[None] * 5)], pa.schema([("kind", pa.string()), *_STATE]))])


#: c, t: customers and tables of each class; ones, twos: pairs of one and two customers; the same of the parent's words.
#: asks: the pairs and the words of which leaves are told, by leaf. samples: customers and tables of pairs, tables of words in the parent, tables in each word's restaurant as a context.
_STATE = pa.schema([("bucket", pa.int32()), ("pairs", pa.binary()), ("asks", pa.binary()), ("samples", pa.list_(pa.binary())), ("c", pa.list_(pa.int64())), ("t", pa.list_(pa.int64())),
                    ("totals", pa.list_(pa.int64()))])
_STATE_SQL = "bucket int, pairs binary, asks binary, samples array<binary>, c array<long>, t array<long>, totals array<long>"


def _margins(kind, count, tables, per_word, parent, parent_tables, occurs, few) -> list[pa.Array]:
    sums = [np.bincount(kind, weights=w, minlength=CLASSES).astype(np.int64) for w in (count, tables)]
    totals = [occurs.sum(), len(per_word), (count == 1).sum(), (count == 2).sum(), (parent == 1).sum(), (parent == 2).sum(), parent.sum(), parent_tables.sum(), *few]
    return [pa.array([s.tolist()], pa.list_(pa.int64())) for s in (*sums, np.array(totals, np.int64))]


def seat(customers: np.ndarray, new_table: np.ndarray | Callable, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of a dish after its customers sat down one by one: the next opens a table with probability a / (a + n - discount * t).

    a is the weight of a new table, or a function of some places and of their tables so far, n the customers and t the tables so far. From the 32nd customer on a sixteenth of them sit down at once.
    """
    tables = np.ones(len(customers), np.int64)
    active, n = np.flatnonzero(customers > 1), 1
    while len(active):
        step, so_far = 1 if n < 32 else n // 16, tables[active]
        a = new_table(active, so_far) if callable(new_table) else new_table[active]
        p = a / (a + n - discount * so_far)
        tables[active] += rng.random(len(active)) < p if step == 1 else rng.binomial(np.minimum(step, customers[active] - n), p)
        n += step
        active = active[customers[active] > n]
    return tables


def _sum_margins(parts: list[pa.RecordBatch] | list[pa.Table], part: int) -> dict:
    """The sums of c, t and totals over rows, as one row."""
    return {"part": [part]} | {name: [np.sum([np.sum(np.array(p.column(name).to_pylist(), np.int64), axis=0) for p in parts], axis=0).tolist()] for name in ("c", "t", "totals")}


_SUMS = pa.schema([("part", pa.int32()), ("c", pa.list_(pa.int64())), ("t", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64()))])


def _sum_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if parts:
        yield pa.RecordBatch.from_pydict(_sum_margins(parts, TaskContext.get().partitionId() % 32), schema=_SUMS)


def _sum_part(table: pa.Table) -> pa.Table:
    return pa.Table.from_pydict(_sum_margins([table], table.column("part")[0].as_py()), schema=_SUMS)


class Totals:
    """What all buckets sum to: of each class, its customers and tables, and the sizes of the whole. Summed in tasks, then in at most 32 rows, then here."""

    def __init__(self, state: DataFrame):
        fields = "part int, c array<long>, t array<long>, totals array<long>"
        rows = state.select("c", "t", "totals").mapInArrow(_sum_task, fields).groupBy("part").applyInArrow(_sum_part, fields).collect()
        self.c, self.t = (np.sum([r[name] for r in rows], axis=0).astype(float) if rows else np.zeros(CLASSES) for name in ("c", "t"))
        sums = np.sum([r["totals"] for r in rows], axis=0).tolist() if rows else [0] * 10
        self.tokens, self.words, one, two, parent_one, parent_two, self.parent_c, self.parent_t, link_one, link_two = sums
        self.link_discount, self.discount, self.parent_discount = (min(0.95, max(0.05, a / max(1, a + 2 * b))) for a, b in ((link_one, link_two), (one, two), (parent_one, parent_two)))

    def parent(self, customers, tables, more=0) -> np.ndarray:
        """The parent's probability of words; a word without customers has that of one unknown word. more: customers that came since the sums were taken."""
        d, s = self.parent_discount, PARENT_STRENGTH
        return (customers - d * np.minimum(tables, customers) + (s + d * self.parent_t) / (self.words + 1)) / (s + self.parent_c + more)

    def in_class(self, kind, customers, tables, parent, more=0) -> np.ndarray:
        """The probability of words in classes, given what the parent gives them; 0 customers and tables where a class lacks a word."""
        return (customers - self.discount * np.minimum(tables, customers) + (STRENGTH + self.discount * self.t[kind]) * parent) / (STRENGTH + self.c[kind] + more)


def _leaf(buckets: int):
    """Per leaf: its links' counts and classes, and which of them the answers of each bucket of words are for: first on their pairs (word, class), then on their contexts."""

    def leaf(table: pa.Table) -> pa.Table:
        _give_back()
        rows = table.to_pylist()
        counts, chunks, places, size = [], [], [], 0
        for _, count, numbers, sizes, place, own in _routes(rows):
            mine = own == 1
            chunks.append(np.repeat(numbers, sizes)[mine])
            places.append(place[mine] + size)
            counts.append(count)
            size += len(count)
        count, chunk, place = np.concatenate(counts), np.concatenate(chunks), np.concatenate(places)
        place = place[np.lexsort((place, chunk))]
        rows = sorted((r for r in rows if r["kind"] == "leaf"), key=lambda r: r["chunk"])
        *both, kinds = (np.concatenate(x) for x in zip(*(unpack(r["pairs"]) for r in rows)))
        kind = np.empty(len(count), np.int64)
        kind[place] = kinds
        arrays = [count, kind]
        for at in both:
            arrays += [place[np.argsort(at, kind="stable")], np.bincount(at, minlength=buckets)]
        return pa.Table.from_batches([_batch([("leaf", -1, table.column("bucket")[0].as_py(), b"", pack(*arrays))], _CHUNK)])

    return leaf


def _routes(rows: list[dict]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What _link says of a leaf's links, bucket by bucket: its number, the counts, the chunks, how many of the links each chunk has, and of each of these its place and whether the chunk is the first."""
    for r in sorted((r for r in rows if r["kind"] == "routes"), key=lambda r: r["chunk"]):
        count, numbers, sizes, steps, own = unpack(r["pairs"])
        yield r["chunk"], count, numbers, sizes, np.cumsum(steps), own


def _tell(totals: Totals):
    """Per bucket of words: to each leaf the customers, tables and parent's probabilities of the pairs and the tables of the contexts that it asks for."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                per_word, *_ = unpack(r["pairs"])
                word = np.repeat(np.arange(len(per_word)), per_word)
                customers, tables, parent_tables, follow = unpack(r["samples"][-1])
                parent = totals.parent(np.bincount(word, weights=tables, minlength=len(per_word)), parent_tables)
                chance = parent.astype(np.float32).view(np.uint32).astype(np.int64)
                pair, pair_leaf, context, context_leaf = unpack(r["asks"])
                leaves = np.union1d(pair_leaf, context_leaf)
                cuts = [(x[:-1], x[1:]) for x in (np.append(np.searchsorted(at, leaves), len(at)) for at in (pair_leaf, context_leaf))]
                rows = [("told", r["bucket"], int(k), b"", pack(customers[pair[a:b]], tables[pair[a:b]], chance[word[pair[a:b]]], follow[context[p:q]])) for k, a, b, p, q in zip(leaves, *cuts[0], *cuts[1])]
                if rows:
                    yield _batch(rows, _CHUNK)

    return tell


def _seat_links(turn: int, totals: Totals):
    """Per leaf: seat all customers of its links anew, one link's taken out at a time, given what the restaurants and classes were after the last sweep.

    Each table that a link opens again is one more of its context and one more customer of its word in the class. Tables beyond the first go to the buckets of words.
    """

    def seat_links(table: pa.Table) -> pa.Table:
        _give_back()
        rows = table.select(["kind", "chunk", "pairs"]).to_pylist()
        count, kind, pair_place, pairs, context_place, contexts = unpack(next(r["pairs"] for r in rows if r["kind"] == "leaf"))
        before = next((unpack(r["pairs"])[0] for r in rows if r["kind"] == "tables"), np.ones(len(count), np.int64))
        told = zip(*(unpack(r["pairs"]) for r in sorted((r for r in rows if r["kind"] == "told"), key=lambda r: r["chunk"])))
        customers, class_tables, follow, parent = *(np.empty(len(count), np.int64) for _ in range(3)), np.empty(len(count))
        customers[pair_place], class_tables[pair_place], of_parent, follow[context_place] = (np.concatenate(t) for t in told)
        parent[pair_place] = of_parent.astype(np.uint32).view(np.float32)
        customers, follow = customers - before, follow - before

        def new_table(i, tables):
            chance = totals.in_class(kind[i], customers[i] + tables, class_tables[i], parent[i], tables - before[i])
            return (LINK_STRENGTH + totals.link_discount * (follow[i] + tables)) * chance

        number = table.column("bucket")[0].as_py()
        tables = seat(count, new_table, totals.link_discount, np.random.default_rng([turn, len(pairs) + number]))
        for_pairs, for_contexts = tables[pair_place] - 1, tables[context_place] - 1
        ends, context_ends = np.cumsum(pairs), np.cumsum(contexts)
        out = [("more", number, int(k), b"", pack(for_pairs[ends[k] - pairs[k]:ends[k]], for_contexts[context_ends[k] - contexts[k]:context_ends[k]])) for k in np.flatnonzero(pairs + contexts)]
        out.append(("tables", turn, number, b"", pack(tables)))
        return pa.Table.from_batches([_batch(out, _CHUNK)])

    return seat_links


def _sweep(turn: int, totals: Totals):
    """Per bucket of words: seat all customers of the classes and of the parent anew, one word's in one class or the parent taken out at a time, given the links' tables of this sweep
    and what classes and parent were after the last."""

    def sweep(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        r = next(r for r in rows if r["samples"] is not None)
        per_word, kind, count, occurs, follow, few = unpack(r["pairs"])
        pair, _, context, _ = unpack(r["asks"])
        more = [unpack(m["pairs"]) for m in sorted((m for m in rows if m["samples"] is None), key=lambda m: m["leaf"])]
        if more:
            np.add.at(count, pair, np.concatenate([m[0] for m in more]))
            np.add.at(follow, context, np.concatenate([m[1] for m in more]))
        word = np.repeat(np.arange(len(per_word)), per_word)
        rng = np.random.default_rng([turn, r["bucket"]])
        _, before, parent_before, _ = unpack(r["samples"][-1])
        others = np.bincount(word, weights=before, minlength=len(per_word)).astype(np.int64)[word] - before

        def new_table(i, tables):
            return (STRENGTH + totals.discount * (totals.t[kind[i]] - before[i] + tables)) * totals.parent(others[i] + tables, parent_before[word[i]], tables - before[i])

        def new_parent_table(i, tables):
            return (PARENT_STRENGTH + totals.parent_discount * (totals.parent_t - parent_before[i] + tables)) / (totals.words + 1)

        tables = seat(count, new_table, totals.discount, rng)
        parent = np.bincount(word, weights=tables, minlength=len(per_word)).astype(np.int64)
        parent_tables = seat(parent, new_parent_table, totals.parent_discount, rng)
        samples = [*(r["samples"] if turn > BURN_IN + 1 else []), pack(count, tables, parent_tables, follow)]
        return pa.Table.from_arrays([pa.array([r["bucket"]], pa.int32()), pa.array([r["pairs"]]), pa.array([r["asks"]]), pa.array([samples], pa.list_(pa.binary())),
                                     *_margins(kind, count, tables, per_word, parent, parent_tables, occurs, few)], schema=_STATE)

    return sweep


def _of_lot(lot: int) -> str:
    return f"(chunk + shiftright(chunk, 32)) % {LOTS} = {lot}"


def _in_lot(chunk: int, lot: int) -> bool:
    return (chunk + (chunk >> 32)) % LOTS == lot


def _predict(lot: int):
    """Per bucket of words: for each chunk of a lot its words' training count, and of each kept sweep their tables as contexts, customers and tables in the parent, and its pairs' customers and tables.

    Of the second sweep on only what changed is sent, small numbers that take little room.
    """

    def predict(table: pa.Table) -> pa.Table:
        _give_back()
        rows = table.to_pylist()
        state, places = (next(r for r in rows if (r["samples"] is None) == missing) for missing in (False, True))
        per_word, _, _, occurs, *_ = unpack(state["pairs"])
        word = np.repeat(np.arange(len(per_word)), per_word)
        of_words, of_pairs = [occurs], []
        for customers, tables, parent_tables, follow in (unpack(x) for x in state["samples"]):
            of_words += [follow, np.bincount(word, weights=tables, minlength=len(per_word)).astype(np.int64), parent_tables]
            of_pairs += [customers, tables]
        of_words[4:] = [x - y for x, y in zip(of_words[4:], of_words[1:])]
        of_pairs[2:] = [x - y for x, y in zip(of_pairs[2:], of_pairs)]
        numbers, *parts = unpack(places["pairs"])
        lists = [(found == 1, np.cumsum(steps), np.cumsum(sizes), np.concatenate([[0], np.cumsum(found)]), numbered) for (sizes, found, steps), numbered in ((parts[:3], of_words), (parts[3:], of_pairs))]
        out = []
        for k, c in enumerate(numbers):
            if _in_lot(int(c), lot):
                told = []
                for found, place, ends, before, numbered in lists:
                    a, b = ends[k - 1] if k else 0, ends[k]
                    for x in numbered:
                        told.append(np.zeros(b - a, np.int64))
                        told[-1][found[a:b]] = x[place[before[a]:before[b]]]
                out.append(("told", int(c), state["bucket"], b"", pack(*told)))
        return pa.Table.from_batches([_batch(out, _CHUNK)])

    return predict


def _hand_out(lot: int):
    """Per leaf: to each chunk of a lot the tables of its links of two and more tokens, summed over the kept sweeps."""

    def hand_out(table: pa.Table) -> pa.Table:
        _give_back()
        rows, out, size = table.to_pylist(), [], 0
        tables = np.sum([unpack(r["pairs"])[0] for r in rows if r["kind"] == "tables"], axis=0)
        for bucket, count, numbers, sizes, place, _ in _routes(rows):
            ends = np.cumsum(sizes)
            out += [("tables", int(c), bucket, b"", pack(tables[place[e - n:e] + size])) for c, n, e in zip(numbers, sizes, ends) if _in_lot(int(c), lot)]
            size += len(count)
        return pa.Table.from_batches([_batch(out, _CHUNK)])

    return hand_out


_SCORE_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(kept: list[Totals]):
    """Per chunk: its documents' sums over their tokens, of the probabilities averaged over the kept sweeps."""

    def score(table: pa.Table) -> pa.Table:
        _give_back()
        rows = sorted(table.select(["kind", "bucket", "words", "pairs"]).to_pylist(), key=lambda r: r["bucket"])
        of = {kind: [r for r in rows if r["kind"] == kind] for kind in ("counts", "docs", "told", "tables")}
        counts, docs = of["counts"][0], of["docs"][0]
        count, per_word, context, kinds, many = unpack(counts["pairs"])
        ids, known, held, bounds = unpack(docs["pairs"])
        link_word = np.repeat(np.arange(len(per_word)), per_word)
        pairs, pair = np.unique(link_word * CLASSES + kinds[context], return_inverse=True)
        pair_word, kind = pairs // CLASSES, pairs % CLASSES
        occurs, *told = (np.concatenate(x) for x in zip(*(unpack(r["pairs"]) for r in of["told"])))
        of_words, of_pairs = told[:3 * len(kept)], told[3 * len(kept):]
        many = np.flatnonzero(count > 1)[many]
        tables = len(kept) * (count > 0)
        tables[many] = np.concatenate([np.zeros(0, np.int64), *(unpack(r["pairs"])[0] for r in of["tables"])])
        chance = len(kept) * count - kept[0].link_discount * tables
        follow = customers = seated = parent = parent_tables = 0
        for s, totals in enumerate(kept):
            follow, parent, parent_tables = (x + y for x, y in zip((follow, parent, parent_tables), of_words[3 * s:]))
            customers, seated = customers + of_pairs[2 * s], seated + of_pairs[2 * s + 1]
            above = totals.in_class(kind, customers, seated, totals.parent(parent, parent_tables)[pair_word])
            chance += (LINK_STRENGTH + totals.link_discount * follow)[context] * above[pair]
        model = kept[-1]
        log = np.log10(chance / len(kept) / (LINK_STRENGTH + occurs[context]))
        base = np.log10((occurs + 1) / (model.tokens + model.words + 1))[link_word]
        link = (unpack_sorted(docs["words"]) % np.uint64(len(count))).astype(np.int64)

        def by_doc(x):
            return pa.array(np.add.reduceat(x[link], bounds[:-1]))

        return pa.Table.from_arrays([pa.array(ids, mask=known == 0), pa.array(held == 1), pa.array(np.diff(bounds)), by_doc((occurs > 0).astype(np.int64)[link_word]), pa.array(np.full(len(ids), model.tokens)),
                                     by_doc(base), by_doc(log)],
                                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return score


def score_documents(docs: DataFrame, held_out) -> DataFrame:
    """Every row with its log10 probability under a model learnt from the rows where the column held_out is false.

    Tokens are words, A-Z lower-cased, and one end for each text. Each word before is a restaurant of its own (texts begin behind an end); its dishes are words. A table
    there is a customer of the restaurant of the context's class; the new tables of a class send a customer to the parent, which all classes share; the parent's new
    tables draw one of the known words or the unknown one. Counts of links (word, word before) are summed within chunks and in buckets of link hashes, and the first chunk
    that has a link counts it for its word, its class and its context, so no word, class or context is a large group: links of two and more tokens are seated in leaves,
    equal shares of the link hashes; a word's seatings in all classes and in the parent lie in one bucket; what buckets share is the tables of each class, summed after
    each sweep. Each sweep of the Gibbs sampler seats every customer of words before, classes and parent anew: all of one dish leave their restaurant and sit down again
    one by one, given the others as they were after the last sweep. For that, buckets of words tell leaves their pairs' customers, tables and parent's probabilities and
    their contexts' tables, and leaves send back the tables that came. After BURN_IN sweeps the predictive probabilities of SAMPLES sweeps are averaged: buckets return
    their counts and leaves their tables to the chunks, in LOTS lots, which sum them for their documents.
    base_score is the add-one unigram log10 probability, n_known the tokens the training texts have, train_tokens their number. Null texts are empty: one end.
    Repeated rows count as often as they occur. Without training rows every token has the probability of the unknown word.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pitman-yor", free_shuffles=True, batch_rows=TEXT_ROWS)
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_width(spark), math.ceil(size / BUCKET_BYTES))
    chunks = scratch.keep(rows.mapInArrow(_count(buckets), _CHUNK_SQL), "chunks", "kind")
    linked = scratch.keep(chunks.where("kind = 'links'").groupBy("bucket").applyInArrow(_link, _CHUNK_SQL), "linked", "kind")
    scratch.drop("chunks/kind=links")
    chunks = scratch.read("chunks", chunks.schema)
    met = scratch.keep(chunks.where("kind = 'parts'").unionByName(linked.where("kind = 'links'")).groupBy("chunk").applyInArrow(_meet(buckets), _CHUNK_SQL), "met", "kind")
    scratch.drop("linked/kind=links", "chunks/kind=parts")
    chunks, routes = (scratch.read(name, chunks.schema) for name in ("chunks", "linked"))
    leaves = scratch.keep(routes.unionByName(met.where("kind = 'leaf'")).groupBy("bucket").applyInArrow(_leaf(buckets), _CHUNK_SQL), "leaves")
    scratch.drop("met/kind=leaf")
    met = scratch.read("met", chunks.schema)
    merged = scratch.keep(met.where("kind = 'words'").groupBy("bucket").applyInArrow(_merge, f"kind string, {_STATE_SQL}"), "state-0", "kind")
    scratch.drop("met/kind=words")
    state = merged.where("kind = 'state'").drop("kind")
    totals, kept, tables = Totals(state), [], []
    for turn in range(1, BURN_IN + SAMPLES + 1):
        told = reduce(DataFrame.unionByName, tables[-1:], leaves.unionByName(state.mapInArrow(_tell(totals), _CHUNK_SQL)))
        seated = scratch.keep(told.groupBy("bucket").applyInArrow(_seat_links(turn, totals), _CHUNK_SQL), f"seated-{turn}", "kind")
        more = seated.where("kind = 'more'").select("bucket", F.col("chunk").alias("leaf"), "pairs")
        both = state.unionByName(more, allowMissingColumns=True)
        state = scratch.keep(both.groupBy("bucket").applyInArrow(_sweep(turn, totals), _STATE_SQL), f"state-{turn}")
        scratch.drop(f"state-{turn - 1}" if turn > 1 else "state-0/kind=state", f"seated-{turn}/kind=more")
        totals = Totals(state)
        tables.append(scratch.read(f"seated-{turn}", chunks.schema))
        if turn > BURN_IN:
            kept.append(totals)
    places = scratch.read("state-0", merged.schema).where("kind = 'places'")
    both = state.select("bucket", "pairs", "samples").unionByName(places.select("bucket", "pairs", "samples"))
    sampled = reduce(DataFrame.unionByName, tables[BURN_IN:], routes)
    scratch.drop("leaves")
    met = scratch.read("met", chunks.schema)
    waiting = chunks.where("kind = 'docs'").unionByName(met.where("kind = 'counts'"))
    for lot in range(LOTS):
        returned = both.groupBy("bucket").applyInArrow(_predict(lot), _CHUNK_SQL)
        handed = sampled.groupBy("bucket").applyInArrow(_hand_out(lot), _CHUNK_SQL)
        meeting = waiting.where(_of_lot(lot)).unionByName(returned).unionByName(handed)
        scratch.keep(meeting.groupBy("chunk").applyInArrow(_score(kept), _SCORE_SQL), f"scores-{lot}")
    scratch.drop("chunks", "linked", "met", f"state-{turn}", "state-0", *(f"seated-{k}" for k in range(1, turn + 1)))
    return reduce(DataFrame.unionByName, (scratch.read(f"scores-{lot}", _SCORE_SQL) for lot in range(LOTS)))

"""Repeated byte strings by suffix arrays: shards sorted by induction, permuted common prefixes, and the bytes that repeats cover.

Every 200-byte window is dealt by its anchor, the 32 bytes in it with the smallest hash: equal windows have equal anchors at the same place, so all occurrences of a string
meet in one bucket. Windows in a row with the same anchor travel as one string. In a bucket, equal strings become one (compared byte by byte); the different strings
that share an anchor are concatenated to shards, whose suffix arrays are built by induced sorting: suffixes are classified, the substrings between leftmost
smaller suffixes sorted by a first induction and named, their names sorted, and the array induced from them in two linear passes. A window whose
permuted common prefix with a neighbour in the array has 200 bytes is a repeat.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.llm.common import Scratch, shuffle_width
from indicatrix.llm.packing import mix, pack, text_bytes, unpack, word_hashes

WINDOW, ANCHOR = 200, 32
#: A task looks at about so many bytes at a time; a bucket of strings comes from about so many bytes of text; a shard has about so many.
CHUNK_BYTES, BUCKET_BYTES, SHARD_BYTES = 2 << 20, 16 << 20, 1 << 20
#: An anchor with at least so many different strings, and at least this share of all bytes, is used only where a window has no other one.
HOT_STRINGS, HOT_SHARE, HOT_IN_CHUNK = 10_000, 1 / 10_000_000, 4
_PLACE = np.uint64((1 << 24) - 1)


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; zeros follow the end."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _common(words: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many bytes from a and b on are equal, at most limit."""
    out, live, k = np.zeros(len(a), np.int64), np.flatnonzero(limit > 0), 0
    while len(live):
        x = words[a[live] + k] ^ words[b[live] + k]
        same = x == 0
        out[live[~same]] = k + (np.bitwise_count((x[~same] & -x[~same]) - np.uint64(1)).astype(np.int64) >> 3)
        live, k = live[same], k + 8
        out[live] = k
        live = live[limit[live] > k]
    return np.minimum(out, limit)


# ---- suffix arrays ------------------------------------------------------------------------------------------------

def _with_runs(j: np.ndarray, run_start: np.ndarray) -> np.ndarray:
    """Suffixes of one bucket and those that they induce in it: first all by one place of their run of equal bytes, then all by two, ..."""
    n = j - run_start[j]
    total = int(n.sum())
    if not total:
        return j
    step = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + 1
    order = np.argsort(step, kind="stable")
    return np.concatenate([j, np.repeat(j, n)[order] - step[order]])


def _induce(t: np.ndarray, run_start: np.ndarray, sizes: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """The suffix array that the order of the leftmost smaller suffixes induces: larger suffixes from the left, smaller ones from the right, a bucket of one byte at a time."""
    sa, begin = np.empty(len(t), np.int64), np.append(0, np.cumsum(sizes))
    grouped = leftmost[np.argsort(t[leftmost], kind="stable")]
    group = np.append(0, np.cumsum(np.bincount(t[leftmost], minlength=256)))
    used = np.flatnonzero(sizes).tolist()

    def before(j: np.ndarray, c: int, larger: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The places before j whose byte is larger (smaller) than c, by byte; their bytes, numbers within each byte, and counts."""
        p = j[j > 0] - 1
        byte = t[p]
        p = p[byte > c] if larger else p[byte < c]
        p = p[np.argsort(t[p], kind="stable")]
        byte = t[p]
        counts = np.bincount(byte, minlength=256)
        return p, byte, np.arange(len(p)) - (np.cumsum(counts) - counts)[byte], counts

    head = begin[:-1].copy()
    for c in used:
        j = _with_runs(sa[begin[c]:head[c]], run_start)
        sa[begin[c]:begin[c] + len(j)] = j
        head[c] = begin[c] + len(j)
        p, byte, number, counts = before(np.concatenate([j, grouped[group[c]:group[c + 1]]]), c, True)
        sa[head[byte] + number] = p
        head += counts
    tail = begin[1:].copy()
    tail[0] -= 1
    sa[tail[0]] = len(t) - 1
    for c in reversed(used):
        j = _with_runs(sa[tail[c]:begin[c + 1]][::-1], run_start)
        tail[c] = begin[c + 1] - len(j)
        sa[tail[c]:begin[c + 1]] = j[::-1]
        p, byte, number, counts = before(np.concatenate([j, sa[begin[c]:head[c]][::-1]]), c, False)
        sa[tail[byte] - 1 - number] = p
        tail -= counts
    return sa


def suffix_array(t: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """The suffixes of t by their first ``depth`` bytes at least, up to the next zero. Strings of t end with a zero, and two zeros never follow each other."""
    edges = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    lengths = np.diff(np.append(edges, len(t)))
    smaller = np.repeat(np.append(t[edges[:-1]] < t[edges[1:]], True), lengths)
    run_start, sizes = np.repeat(edges, lengths), np.bincount(t, minlength=256)
    first = np.append(False, smaller[1:] & ~smaller[:-1])
    leftmost = np.flatnonzero(first)
    ordered = _induce(t, run_start, sizes, leftmost)
    ordered = ordered[first[ordered]]
    number = np.cumsum(first) - 1
    extent = np.append(np.diff(leftmost) + 1, 1)[number[ordered]]
    alike = extent[1:] == extent[:-1]
    alike[alike] = _common(_words(t), ordered[:-1][alike], ordered[1:][alike], extent[1:][alike]) == extent[1:][alike]
    name = np.empty(len(leftmost), np.int64)
    name[number[ordered]] = np.append(0, np.cumsum(~alike))
    reach = 1  # a name stands for so many substrings, of two bytes at least; pairs of names are named again until no two are equal or the depth is reached
    while len(name) and name.max() + 1 < len(name) and 2 * reach < depth:
        second = np.append(name[reach:], np.full(min(reach, len(name)), -1))[:len(name)]
        name = np.unique(name * (len(name) + 1) + second + 1, return_inverse=True)[1]
        reach *= 2
    return _induce(t, run_start, sizes, leftmost[np.argsort(name, kind="stable")])


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place the suffix before its own in the array (-1: none) and how many bytes the two have in common before the next zero.

    Where both are preceded by the same byte and the place before has the neighbour before, there is one byte less in common; only elsewhere are bytes compared.
    """
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[0]], phi[sa[1:]] = -1, sa[:-1]
    ends = np.flatnonzero(t == 0)
    rest = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    previous = np.append(0, t[:-1])
    fresh = np.append(True, phi[1:] != phi[:-1] + 1) | (previous == 0) | (previous != previous[phi]) | (phi < 0)
    at = np.flatnonzero(fresh & (phi >= 0))
    common = np.zeros(n, np.int64)
    common[at] = _common(_words(t), at, phi[at], np.minimum(rest[at], rest[phi[at]]))
    last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return phi, common[last] - (np.arange(n) - last)


def repeated_places(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated strings' places, each string followed by one place more, whose WINDOW bytes are found at another place too; and the first place of each string."""
    t = np.zeros(sum(map(len, strings)) + len(strings), np.uint8)
    starts = np.append(0, np.cumsum([len(s) + 1 for s in strings]))
    for s, a in zip(strings, starts.tolist()):
        t[a:a + len(s)] = s + np.uint8(1)  # UTF-8 has no byte 255
    phi, common = permuted_prefixes(t, suffix_array(t))
    long = common >= WINDOW
    long[phi[long]] = True
    return np.flatnonzero(long), starts[:-1]


# ---- windows by anchor --------------------------------------------------------------------------------------------

def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from every place on."""
    h, width, factor = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while width < ANCHOR:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % 2**64, 2 * width
    return mix(h)


def _runs(data: np.ndarray, offsets: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, first window, number of windows and anchor of every run of windows with one anchor. data has at most 2^24 bytes."""
    lengths = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    if not lengths.any():
        return *[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64)
    grams = _grams(data)
    key = (grams & ~_PLACE) >> np.uint64(1)
    if len(hot):
        seen = np.zeros(1 << 16, bool)
        seen[hot & np.uint64(0xFFFF)] = True
        at = np.flatnonzero(seen[grams & np.uint64(0xFFFF)])
        at = at[hot[np.minimum(np.searchsorted(hot, grams[at]), len(hot) - 1)] == grams[at]]
        key[at] |= np.uint64(1 << 63)
    key = (key & ~_PLACE) | np.arange(len(key), dtype=np.uint64)
    width, span = 1, WINDOW - ANCHOR + 1
    while 2 * width <= span:
        key, width = np.minimum(key[:-width], key[width:]), 2 * width
    key = np.minimum(key[:len(key) - (span - width)], key[span - width:])
    at = _gather(offsets[:-1], lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = (key[at] & _PLACE).astype(np.int64)
    edges = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
    return text[edges], at[edges], np.diff(np.append(edges, len(at))), grams[place[edges]]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """data, offsets, and for each text its id, its hash and the place in it where its bytes here start; long texts come in pieces that overlap by less than a window."""
    parts, ids, tags, firsts, size = [], [], [], [], 0

    def piece():
        data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        return data, np.append(0, np.cumsum([len(p) for p in parts])), np.array(ids), np.array(tags), np.array(firsts)

    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        numbers, hashes = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
        for k in np.flatnonzero(np.diff(offsets) >= WINDOW).tolist():
            a, end = int(offsets[k]), int(offsets[k + 1])
            while end - a >= WINDOW:
                b = min(end, a + CHUNK_BYTES + WINDOW - 1)
                parts.append(data[a:b]), ids.append(numbers[k]), tags.append(hashes[k]), firsts.append(a - int(offsets[k]))
                size += b - a
                a = b - WINDOW + 1
                if size >= CHUNK_BYTES:
                    yield piece()
                    parts, ids, tags, firsts, size = [], [], [], [], 0
    if parts:
        yield piece()


def _alike(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, anchors: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal strings follow each other, and where in it each set of equal strings starts."""
    order = np.lexsort((lengths, hashes, anchors))
    same = np.flatnonzero((anchors[order[1:]] == anchors[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]]) & (lengths[order[1:]] == lengths[order[:-1]]))
    a, b, n = starts[order[same]], starts[order[same + 1]], lengths[order[same]]
    head = np.ones(len(order), bool)
    if len(same):
        head[same + 1] = _common(_words(data), a, b, n) < n
    return order, np.flatnonzero(head)


def _hot_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with several different strings in one chunk, and how many."""
    for data, offsets, _, _, _ in _pieces(batches):
        _, at, n, anchors = _runs(data, offsets, np.zeros(0, np.uint64))
        pairs = np.unique(np.stack([anchors, word_hashes(data, at, at + n + WINDOW - 1)], axis=1), axis=0) if len(at) else np.zeros((0, 2), np.uint64)
        anchor, count = np.unique(pairs[:, 0], return_counts=True)
        often = count >= HOT_IN_CHUNK
        yield pa.RecordBatch.from_arrays([pa.array(anchor[often].view(np.int64)), pa.array(count[often].astype(np.int64))], names=["anchor", "n"])


def _emit(buckets: int, hot: np.ndarray):
    """Per chunk and bucket each string once; strings that the chunk has twice or more are known as repeats and go without a place."""
    import zstandard

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, (data, offsets, ids, tags, firsts) in enumerate(_pieces(batches)):
            text, at, n, anchors = _runs(data, offsets, hot)
            lengths = n + WINDOW - 1
            order, heads = _alike(data, at, lengths, anchors, word_hashes(data, at, at + lengths))
            often = np.diff(np.append(heads, len(order))) > 1
            known = order[np.repeat(often, np.diff(np.append(heads, len(order))))]
            start = at - offsets[text] + firsts[text]
            rows = [(turn % buckets, None, pack(ids[text[known]], tags[text[known]], start[known], n[known]), None)] if len(known) else []
            one = order[heads]
            bucket = (mix(anchors[one] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            one, often, bounds = one[by], often[by], np.searchsorted(bucket[by], np.arange(buckets + 1))
            squeeze = zstandard.ZstdCompressor(level=1)
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                s, known = one[bounds[k]:bounds[k + 1]], often[bounds[k]:bounds[k + 1]].astype(np.int64)
                rows.append((k, anchors[s].tobytes(), pack(ids[text[s]], tags[text[s]], start[s], n[s], known), squeeze.compress(data[_gather(at[s], lengths[s])].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "anchors", "places", "strings"])

    return emit


def _windows_found(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of different strings in the order of their anchors: string, first and number of the windows that occur in another of them too. Shards end between anchors."""
    found, first = [], 0
    edges = np.flatnonzero(np.append(anchors[1:] != anchors[:-1], True)) + 1
    sizes = np.cumsum(lengths)
    while first < len(starts):
        room = (sizes[first - 1] if first else 0) + SHARD_BYTES
        e = np.searchsorted(edges, first, "right")
        last = int(edges[max(e, np.searchsorted(sizes[edges - 1], room, "right") - 1)])
        if last - first > 1:
            places, begins = repeated_places([data[a:a + n] for a, n in zip(starts[first:last].tolist(), lengths[first:last].tolist())])
            string = np.searchsorted(begins, places, "right") - 1
            heads = np.flatnonzero(np.append(True, (np.diff(places) != 1) | (np.diff(string) != 0))) if len(places) else np.zeros(0, np.int64)
            found.append((string[heads] + first, places[heads] - begins[string[heads]], np.diff(np.append(heads, len(places)))))
        first = last
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))


def _sorted_shards(groups: int):
    """Per bucket: the windows of its strings that occur twice, packed for groups of documents."""
    import zstandard

    def sort(table: pa.Table) -> pa.Table:
        repeats, anchors, metas, blobs = [], [], [], []
        for a, places, strings in zip(*(table.column(c).to_pylist() for c in ("anchors", "places", "strings"))):
            if a is None:
                repeats.append(unpack(places))
            else:
                anchors.append(np.frombuffer(a, np.uint64)), metas.append(unpack(places)), blobs.append(strings)
        if anchors:
            every = np.concatenate(anchors)
            names, place, count = np.unique(every, return_inverse=True, return_counts=True)
            shared, first, kept = count[place] > 1, 0, []
            for k, blob in enumerate(blobs):  # a string whose anchor no other string has is no repeat
                mine = shared[first:first + len(anchors[k])]
                first += len(mine)
                blobs[k] = None
                if mine.any():
                    lengths = metas[k][3] + WINDOW - 1
                    starts = np.cumsum(lengths) - lengths
                    kept.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)[_gather(starts[mine], lengths[mine])])
            ids, tags, start, n, known = (np.concatenate([m[i] for m in metas])[shared] for i in range(5))
            data, every, lengths = np.concatenate(kept) if kept else np.zeros(0, np.uint8), every[shared], n + WINDOW - 1
            starts = np.cumsum(lengths) - lengths
            order, heads = _alike(data, starts, lengths, every, word_hashes(data, starts, starts + lengths))
            times = np.diff(np.append(heads, len(order)))
            whole = order[np.repeat(times > 1, times)]
            whole = whole[known[whole] == 0]
            repeats.append([ids[whole], tags[whole], start[whole], n[whole]])
            one = order[heads]
            string, at, windows = _windows_found(data, starts[one], lengths[one], every[one])
            open_ = (times[string] == 1) & (known[one[string]] == 0)
            s = one[string[open_]]
            repeats.append([ids[s], tags[s], start[s] + at[open_], windows[open_]])
        found = [np.concatenate([r[i] for r in repeats]).astype(np.int64) for i in range(4)]
        group = (mix(found[0].view(np.uint64) ^ mix(found[1].view(np.uint64))) % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((found[2], found[1], found[0], group))
        found, cuts = [f[order] for f in found], np.searchsorted(group[order], np.arange(groups + 1))
        full = np.flatnonzero(np.diff(cuts))
        return pa.Table.from_arrays([pa.array(full.astype(np.int32)), pa.array([pack(*(f[cuts[g]:cuts[g + 1]] for f in found)) for g in full.tolist()], pa.binary())], names=["group", "repeats"])

    return sort


def _spans(table: pa.Table) -> pa.Table:
    """Of a group of documents: the longest runs of bytes that repeated windows cover, per document."""
    parts = [unpack(r) for r in table.column("repeats").to_pylist()]
    ids, tags, start, n = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((start, tags, ids))
    ids, tags, start, end = ids[order], tags[order], start[order], (start + n + WINDOW - 1)[order]
    doc = np.cumsum(np.append(True, (np.diff(ids) != 0) | (np.diff(tags) != 0))) - 1
    reach = np.maximum.accumulate(end + (doc << 40)) - (doc << 40)  # a text has less than 2^40 bytes
    heads = np.flatnonzero(np.append(True, (np.diff(doc) != 0) | (start[1:] > reach[:-1])))
    last = np.append(heads[1:], len(ids)) - 1
    firsts = np.flatnonzero(np.append(True, np.diff(doc[heads]) != 0))
    bounds = pa.array(np.append(firsts, len(heads)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (start[heads], reach[last])]
    return pa.Table.from_arrays([pa.array(ids[heads][firsts]), pa.array(tags[heads][firsts]), *lists], names=["id", "tag", "starts", "ends"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its bytes, those that go, the runs they make, and what is left."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        out: list[list] = [[], [], [], [], []]
        for k, (starts, ends) in enumerate(zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist())):
            text, starts, ends = data[offsets[k]:offsets[k + 1]], starts or [], ends or []
            kept = b"".join([text[a:b].tobytes() for a, b in zip([0, *ends], [*starts, len(text)])])
            for column, value in zip(out, (len(text), len(text) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), list(zip(starts, ends)))):
                column.append(value)
        spans = pa.array([[{"start": a, "end": b} for a, b in s] for s in out[4]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], spans],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start and end in bytes) of every row, without the bytes that a repeated 200-byte string covers.

    A string repeats where it starts at any other place, in the same text, another row, or a row of the same id. Null texts are empty; texts of less than 200 bytes have no
    such string. Rows are documents each, also equal ones, and a null id is an id. Long texts are looked at in overlapping pieces, so any length counts whole.
    Equal strings are compared byte by byte: hashes only deal them out. Other columns stay behind.
    A chunk sends each of its strings once, so a passage of very many documents is one string for each chunk. An anchor that very many different strings have (a line that
    many documents share) comes last in every window's choice; the counts for that come from one pass before, and at most 1 / (86 * HOT_SHARE) such anchors exist.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    text = F.coalesce(docs["text"], F.lit(""))
    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.when(doc_id.isNull(), F.xxhash64(text, F.lit("no id"))).otherwise(F.xxhash64(text)).alias("tag"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_width(spark), math.ceil(size / BUCKET_BYTES))
    long = rows.where(F.octet_length("text") >= WINDOW).select("id", "tag", "text")
    counted = long.mapInArrow(_hot_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HOT_STRINGS, math.ceil(size * HOT_SHARE)))
    hot = np.sort(np.array([r["anchor"] for r in counted.collect()], np.int64).view(np.uint64))
    strings = long.mapInArrow(_emit(buckets, hot), "bucket int, anchors binary, places binary, strings binary")
    repeats = strings.groupBy("bucket").applyInArrow(_sorted_shards(buckets), "group int, repeats binary")
    spans = scratch.keep(repeats.groupBy("group").applyInArrow(_spans, "id long, tag long, starts array<long>, ends array<long>"), "spans")
    joined = rows.join(spans, ["id", "tag"], "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")

"""Repeated passages: windows of words as edges of a De Bruijn graph, compacted to paths and verified at their source."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from indicatrix.llm.common import TEXT_ROWS, Scratch, shuffle_width
from indicatrix.llm.packing import find_words, mix, pack, pack_sorted, text_bytes, unpack, unpack_sorted, word_hashes
from indicatrix.operators.ranking import number_large_groups

WINDOW = 13
#: A task looks at about so many bytes of text at a time; a bucket of edges comes from about so many.
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 16 << 20

SPAN = "struct<start:int,n:int,source:bigint,source_start:int>"


def _edges(hashes: np.ndarray, words_before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every WINDOW words in a row of one document, and the place of its first word among all words."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(hashes) - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        total = total * np.uint64(0x2545F4914F6CDD1D) + hashes[k:k + len(total)]
    doc = np.repeat(np.arange(len(words_before) - 1), np.diff(words_before))
    whole = np.flatnonzero(doc[:len(total)] == doc[WINDOW - 1:])
    return mix(total[whole]), whole


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    waiting, size = [], 0
    for batch in batches:
        first = 0
        sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        while first < batch.num_rows:
            room = CHUNK_BYTES - size + (sizes[first - 1] if first else 0)
            last = min(max(first + 1, int(np.searchsorted(sizes, room))), batch.num_rows)
            waiting.append(batch.slice(first, last - first))
            size += int(sizes[last - 1] - (sizes[first - 1] if first else 0))
            first = last
            if size >= CHUNK_BYTES:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, size = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _emit_edges(buckets: int, copies: int):
    """Per chunk and bucket: the edges that start in the chunk's first document with that edge; and the repeats within the chunk, already known to be repeats."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for table in _chunks(batches):
            table = table.take(pc.sort_indices(table.column("key")))
            keys = table.column("key").to_numpy()
            data, offsets = text_bytes(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()))
            starts, ends, before = find_words(data, offsets)
            edge, at = _edges(word_hashes(data, starts, ends), before)
            doc = np.searchsorted(before, at, "right") - 1
            place = at - before[doc]
            order = np.argsort(edge, kind="stable")
            edge, doc, place = edge[order], doc[order], place[order]
            head = np.concatenate([[True], edge[1:] != edge[:-1]]) if len(edge) else np.zeros(0, bool)
            lead = np.flatnonzero(head)[np.cumsum(head) - 1]
            own = keys[doc] // copies == keys[doc[lead]] // copies
            late = np.flatnonzero(~own)
            rows = []
            if len(late):
                rows.append((turn % buckets, None, pack(keys[doc[late]], place[late], keys[doc[lead[late]]], place[lead[late]])))
            edge, doc, place = edge[own], doc[own], place[own]
            bounds = np.searchsorted(edge, np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)) if buckets > 1 else np.zeros(0, np.int64)
            bounds = np.concatenate([[0], bounds, [len(edge)]])
            for k in range(buckets):
                a, b = bounds[k], bounds[k + 1]
                if b > a:
                    rows.append((k, pack_sorted(edge[a:b]), pack(keys[doc[a:b]], place[a:b])))
            turn += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "edges", "places"])

    return emit


def _join_edges(copies: int, groups: int):
    """Per bucket: every edge that also starts in a document with a smaller id, with the first place it starts at, packed for groups of documents."""

    def join(table: pa.Table) -> pa.Table:
        parts, repeats = [], []
        for edges, places in zip(table.column("edges").to_pylist(), table.column("places").to_pylist()):
            if edges is None:
                repeats.append(unpack(places))
            else:
                parts.append((unpack_sorted(edges), *unpack(places)))
        if parts:
            edge = np.concatenate([p[0] for p in parts])
            key = np.concatenate([p[1] for p in parts])
            place = np.concatenate([p[2] for p in parts])
            del parts
            order = np.argsort(edge, kind="stable")
            edge = edge[order]
            same = edge[1:] == edge[:-1]
            often = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            order, edge = order[often], edge[often]
            key, place = key[order], place[order]
            order = np.lexsort((place, key, edge))
            edge, key, place = edge[order], key[order], place[order]
            head = np.concatenate([[True], edge[1:] != edge[:-1]]) if len(edge) else np.zeros(0, bool)
            lead = np.flatnonzero(head)[np.cumsum(head) - 1]
            late = key // copies > key[lead] // copies
            repeats.append([key[late], place[late], key[lead[late]], place[lead[late]]])
        found = [np.concatenate([r[i] for r in repeats]) for i in range(4)]
        group = (mix(found[0].astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
        order = np.lexsort((found[1], found[0], group))
        found = [f[order] for f in found]
        cuts = np.searchsorted(group[order], np.arange(groups + 1))
        full = np.flatnonzero(np.diff(cuts))
        return pa.Table.from_arrays([pa.array(full.astype(np.int32)), pa.array([pack(*(f[cuts[g]:cuts[g + 1]] for f in found)) for g in full.tolist()], pa.binary())], names=["group", "repeats"])

    return join


def _compact(table: pa.Table) -> pa.Table:
    """Repeated edges of a group of documents to paths: a path goes on while the next edge starts one word further in the document and in the same source."""
    parts = [unpack(r) for r in table.column("repeats").to_pylist()]
    key, place, source, source_place = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((source_place, source, place, key))
    key, place, source, source_place = key[order], place[order], source[order], source_place[order]
    once = np.concatenate([[True], (np.diff(place) != 0) | (np.diff(key) != 0)])
    key, place, source, source_place = key[once], place[once], source[once], source_place[once]
    breaks = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(place) != 1) | (np.diff(source) != 0) | (np.diff(source_place) != 1)]))
    n = np.diff(np.concatenate([breaks, [len(key)]]))
    spans = pa.StructArray.from_arrays([pa.array(x.astype(t)) for x, t in ((place[breaks], np.int32), (n, np.int32), (source[breaks], np.int64), (source_place[breaks], np.int32))],
                                       names=["start", "n", "source", "source_start"])
    firsts = np.flatnonzero(np.concatenate([[True], np.diff(key[breaks]) != 0]))
    bounds = pa.array(np.concatenate([firsts, [len(breaks)]]).astype(np.int32))
    return pa.Table.from_arrays([pa.array(key[breaks][firsts]), pa.ListArray.from_arrays(bounds, spans)], names=["key", "spans"])


def _digest(data: bytes, starts: list[int], ends: list[int], first: int, edges: int) -> bytes | None:
    """Of the words that a path of edges covers."""
    last = first + edges + WINDOW - 1
    return hashlib.blake2b(b" ".join([data[s:e] for s, e in zip(starts[first:last], ends[first:last])]), digest_size=16).digest() if last <= len(starts) else None


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: the words that no path covers, and digests of its paths and of those that others have it as source of."""
    wanted = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("digest", pa.binary())]))
    for big in batches:
        for batch in (big.slice(k, 256) for k in range(0, big.num_rows, 256)):
            data, offsets = text_bytes(batch.column("text"))
            starts, ends, before = find_words(data, offsets)
            spans, asked = batch.column("spans").to_pylist(), batch.column("asked").to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            for k in range(batch.num_rows):
                low, text = offsets[k], data[offsets[k]:offsets[k + 1]].tobytes()
                s, e = starts[before[k]:before[k + 1]] - low, ends[before[k]:before[k + 1]] - low
                covered = np.zeros(len(s) + 1, np.int64)
                for p in spans[k] or ():
                    covered[min(p["start"], len(s))] += 1
                    covered[min(p["start"] + p["n"] + WINDOW - 1, len(s))] -= 1
                kept = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
                sl, el = s.tolist(), e.tolist()
                words = b" ".join([text[sl[i]:el[i]] for i in kept.tolist()])
                if len(kept) == len(s):
                    rest = text
                else:  # what follows a removed word up to the next one goes with it
                    runs = np.split(kept, np.flatnonzero(np.diff(kept) != 1) + 1) if len(kept) else []
                    rest = b"".join([text[sl[r[0]] if r[0] else 0:sl[r[-1] + 1] if r[-1] + 1 < len(sl) else len(text)] for r in runs])
                out[0].append(len(s))
                out[1].append(len(s) - len(kept))
                out[2].append(hashlib.sha256(words).hexdigest())
                out[3].append(rest.decode())
                out[4].append([_digest(text, sl, el, p["start"], p["n"]) for p in spans[k] or ()])
                out[5].append([{"start": p["start"], "n": p["n"], "digest": _digest(text, sl, el, p["start"], p["n"])} for p in asked[k] or ()])
            arrays = [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.binary()), wanted))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("carried"), batch.column("spans"), *arrays],
                                             names=["key", "carried", "spans", "n_words", "n_removed", "kept_sha256", "kept_text", "digests", "answers"])


def _keyed(docs: DataFrame, carried: list[str]) -> tuple[DataFrame, int, int]:
    """key, carried columns and text; a key is doc_id * copies + the row's number among rows with that id. Also copies, and the bytes of all texts.

    Ids for which that would leave 64 bits are first replaced by their ranks, which keep their order; a null id comes before all.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), (F.struct(*[docs[c] for c in carried]) if carried else F.lit(None).cast("int")).alias("carried"), text.alias("text"))
    low, high, size = rows.agg(F.min("id"), F.max("id"), F.sum(F.octet_length("text"))).first()
    often = rows.groupBy("id").count().where("count > 1").agg(F.max("count")).first()[0] or 1
    if max(abs((low or 0) - 1), abs(high or 0) + 1) * often < 1 << 63:
        rows = rows.withColumn("id", F.coalesce("id", F.lit((low or 0) - 1)))
    else:
        ranks = number_large_groups(rows.where("id is not null").select(F.lit(0).alias("all"), "id").distinct(), ["all"], "id", True, "rank", ["id"])
        rows = rows.join(ranks.select("id", "rank"), "id", "left").select(F.coalesce("rank", F.lit(0)).cast("long").alias("id"), "carried", "text")
    if often == 1:
        return rows.withColumnRenamed("id", "key"), 1, size or 0
    number = F.row_number().over(W.partitionBy("id").orderBy(F.xxhash64("text"), "text")) - 1
    return rows.select((F.col("id") * F.lit(often) + number).alias("key"), "carried", "text"), often, size or 0


def find_repeats(docs: DataFrame, carried: list[str]) -> DataFrame:
    """carried (a struct), n_words, n_removed, kept_sha256 and kept_text of every row of docs.

    A window of 13 words is an edge between its first and last twelve. Chunks send the edges of their texts to buckets by hash, each edge once for each
    chunk, so an edge that a third of all documents have is no large group. A bucket joins equal edges and returns those that start in a document with a smaller
    id, with that source. Grouped by document, consecutive edges with consecutive source places compact to one path. Paths are then verified: the document
    and the source digest the words at both coordinates, and a path whose digests differ (a 64-bit collision) is dropped and its document done again.
    A collision can hide a repeat behind a text that is none: one window in 2^64 / (number of windows).
    Null and empty texts have no words. Rows with one doc_id are documents of the same id: neither is smaller. A null id counts as smaller than all.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings", batch_rows=TEXT_ROWS)
    rows, copies, size = _keyed(docs, carried)
    buckets = max(shuffle_width(spark), math.ceil(size / BUCKET_BYTES))
    edges = rows.select("key", "text").mapInArrow(_emit_edges(buckets, copies), "bucket int, edges binary, places binary")
    repeated = edges.groupBy("bucket").applyInArrow(_join_edges(copies, buckets), "group int, repeats binary")
    paths = scratch.keep(repeated.groupBy("group").applyInArrow(_compact, f"key long, spans array<{SPAN}>"), "paths")

    def applied(rows: DataFrame, paths: DataFrame) -> DataFrame:
        asked = paths.select(F.explode("spans").alias("s")).groupBy(F.col("s.source").alias("key"), F.col("s.source_start").alias("start"), F.col("s.n").alias("n")).count() \
            .groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("asked"))
        joined = rows.join(paths, "key", "left").join(asked, "key", "left").select("key", "carried", "text", "spans", "asked")
        kind = dict(rows.dtypes)["carried"]
        return joined.mapInArrow(_apply, f"key long, carried {kind}, spans array<{SPAN}>, n_words long, n_removed long, kept_sha256 string, kept_text string, "
                                         "digests array<binary>, answers array<struct<start:int,n:int,digest:binary>>")

    done = scratch.keep(applied(rows, paths), "done")
    claims = done.select("key", F.explode(F.arrays_zip("spans", "digests")).alias("c")) \
        .select("key", F.col("c.spans.source").alias("source"), F.col("c.spans.source_start").alias("start"), F.col("c.spans.n").alias("n"), F.col("c.spans.start").alias("at"), F.col("c.digests").alias("digest"))
    answers = done.select(F.col("key").alias("source"), F.explode("answers").alias("a")).select("source", "a.start", "a.n", F.col("a.digest").alias("found"))
    wrong = claims.join(answers, ["source", "start", "n"], "left").where("found is null or digest is null or found != digest").select("key", "at")
    wrong = scratch.keep(wrong, "wrong")
    result = ["carried", "n_words", "n_removed", "kept_sha256", "kept_text"]
    if wrong.isEmpty():
        scratch.drop("paths", "wrong")
        return done.select(*result)
    hit = wrong.groupBy("key").agg(F.collect_set("at").alias("bad"))
    right = paths.join(hit, "key").select("key", F.filter("spans", lambda s: ~F.array_contains("bad", s["start"])).alias("spans"))
    again = applied(rows.join(hit.select("key"), "key", "left_semi"), right)
    return done.join(hit, "key", "left_anti").select(*result).unionByName(again.select(*result))


def repeated_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    return find_repeats(docs, ["doc_id"]).select(F.col("carried.doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated words cut out of the texts, white space elsewhere as it was; every row stays, and n_chars follows where there is one."""
    names = [c for c in docs.columns if c != "text"]
    out = find_repeats(docs, names).select(*[F.col(f"carried.{c}").alias(c) for c in names], F.col("kept_text").alias("text"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

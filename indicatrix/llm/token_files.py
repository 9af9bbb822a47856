"""Token ids of documents in compressed files: one shared dictionary, one frame for each document, an offset index for each pack."""

from __future__ import annotations

import hashlib
import math
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from indicatrix.llm.common import Scratch, doc_texts, shuffle_width

#: A pack holds whole documents up to about so many ids; it is the unit of reading.
PACK_IDS = 500_000
#: The dictionary is trained on so many documents at most, each of so many characters at most. Every document is written.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 1000, 20_000, 64 * 1024
#: A shard, the work of one task, comes from about so many bytes of text; there are as many as the shuffle is wide at least.
SHARD_BYTES = 64 << 20
#: Words whose ids a task keeps at a time.
KEPT_WORDS = 500_000

PACKS = "shard int, pack int, dict_hash string, doc_ids array<long>, n_tokens array<int>, offsets array<long>, frames binary"


class WordEncoder:
    """Encodes texts word by word, each different word once.

    The tokenizer never joins ids over white space, nor over a letter and a punctuation mark, and lower-cases first: so the ids of a text are those of its words in a row,
    marks at the end of a word may stand apart, and capitals of the English alphabet may go first, unless a special token (<|...|>) could be meant.
    """

    def __init__(self, tokenizer_json: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_str(tokenizer_json), end_id
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]

    def _slots(self, words: list[str]) -> np.ndarray:
        fresh = [w for w in words if w not in self.slots]
        if fresh and len(self.slots) + len(fresh) > max(KEPT_WORDS, len(words)):
            self.forget()
            fresh = words
        if fresh:
            self.slots.update(zip(fresh, range(len(self.slots), len(self.slots) + len(fresh))))
            groups = [fresh[k:k + 256] for k in range(0, len(fresh), 256)]
            for group, found in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
                first = np.cumsum([0] + [len(w) + 1 for w in group[:-1]])
                word = np.searchsorted(first, [at for at, _ in found.offsets], "right") - 1
                self.counts.append(np.bincount(word.astype(np.int64), minlength=len(group)))
                self.ids.append(np.array(found.ids, np.uint32))
        return np.fromiter((self.slots[w] for w in words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each with the end id behind it, and how many ids each text has."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"([A-Za-z0-9])([.,!?;:$%&#*]+)([ \n])", r"\1 \2\3"))
        lists = split.offsets.to_numpy().astype(np.int64)
        words = split.values.slice(lists[0], lists[-1] - lists[0]).dictionary_encode()
        slots = self._slots(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
        self.ids, self.counts = [np.concatenate(self.ids)], [np.concatenate(self.counts)]
        ids, counts = self.ids[0], self.counts[0]
        starts = np.concatenate([[0], np.cumsum(counts)])
        n = counts[slots]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.repeat(starts[slots] - ends[:-1], n) + np.arange(ends[-1])]
        per_text = np.diff(ends[lists - lists[0]])
        return np.insert(flat, np.cumsum(per_text), self.end_id).astype(np.uint32), per_text + 1


@lru_cache(1)
def kept_encoder(tokenizer_json: str, end_id: int) -> WordEncoder:
    """The encoder of this Python worker: its next tasks find the vocabulary loaded and words encoded."""
    return WordEncoder(tokenizer_json, end_id)


def _encode(batches: Iterator[pa.RecordBatch], encoder: WordEncoder) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            ids, counts = encoder.encode(part.column("text"))
            yield part.column("doc_id").to_pylist(), ids, counts


def _compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=False, write_dict_id=False)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def dict_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def train_dictionary(docs: DataFrame, encoder: WordEncoder, width: str) -> bytes:
    """A dictionary from the serialized id arrays of a bounded sample: the documents with the smallest id hashes. Empty where the sample is too small."""
    import zstandard

    sample = docs.where(F.char_length("text").between(1, SAMPLE_CHARS)).orderBy(F.xxhash64("doc_id"), "text").limit(SAMPLE_DOCS).select("text").toArrow()
    ids, counts = encoder.encode(sample.column("text").combine_chunks() if sample.num_rows else pa.array([], pa.string()))
    arrays = [a.astype(width).tobytes() for a in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []
    try:
        return zstandard.train_dictionary(DICT_BYTES, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to learn from
        return b""


def write_packs(docs: DataFrame, path: str, tokenizer_json: str, end_id: int) -> None:
    """Encode every document and write packs in ascending doc_id order, as the table `packs` below path, and the table `dictionary`.

    Shards are ranges of (doc_id, text hash), so shard and pack number give the order of the whole. A pack row has the dictionary's hash, the ids
    of its documents, their token counts, the offset of each frame and the frames, so one document is read by one row and one frame.
    Ids are serialized as 16-bit little-endian numbers where the vocabulary allows it, else 32-bit. Null texts are empty: the end id alone.
    Rows with one doc_id stay apart, in the order of their text hashes; null ids come first. No rows: no packs.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)  # one file of a vocabulary, a few MB whatever the documents
    encoder = WordEncoder(tokenizer_json, end_id)
    texts = doc_texts(docs)
    width = "<u2" if max(encoder.tokenizer.get_vocab_size(True), end_id + 1) <= 65536 else "<u4"
    seen = Observation()  # the bytes of all texts, summed by the pass that takes the sample
    dictionary, size = b"", 0
    if not texts.isEmpty():
        dictionary = train_dictionary(texts.observe(seen, F.sum(F.octet_length("text")).alias("bytes")), encoder, width)
        size = seen.get["bytes"]
    digest = dict_hash(dictionary)
    spark.createDataFrame([(digest, dictionary, width)], "dict_hash string, dictionary binary, width string").coalesce(1).write.mode("overwrite").parquet(f"{path}/dictionary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, compress = TaskContext.get().partitionId(), 0, _compressor(dictionary).compress
        doc_ids: list = []
        frames: list[bytes] = []
        sizes: list[int] = []

        def row():
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).tolist()
            return pa.RecordBatch.from_pylist([{"shard": shard, "pack": number, "dict_hash": digest, "doc_ids": doc_ids, "n_tokens": sizes, "offsets": offsets, "frames": b"".join(frames)}], schema=schema)

        schema = pa.schema([("shard", pa.int32()), ("pack", pa.int32()), ("dict_hash", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())),
                            ("offsets", pa.list_(pa.int64())), ("frames", pa.binary())])
        for names, ids, counts in _encode(batches, kept_encoder(shared.value, end_id)):
            ends = np.cumsum(counts)
            stored = ids.astype(width)
            for name, end, n in zip(names, ends.tolist(), counts.tolist()):
                doc_ids.append(name)
                frames.append(compress(stored[end - n:end].tobytes()))
                sizes.append(n)
            if sum(sizes) >= PACK_IDS:
                yield row()
                number, doc_ids, frames, sizes = number + 1, [], [], []
        if doc_ids:
            yield row()

    order = [F.col("doc_id"), F.xxhash64("text")]
    placed = texts.repartitionByRange(max(shuffle_width(spark), math.ceil(size / SHARD_BYTES)), *order).sortWithinPartitions(*order)
    placed.mapInArrow(pack, PACKS).write.mode("overwrite").option("compression", "none").parquet(f"{path}/packs")


def _dictionaries(spark: SparkSession, path: str) -> dict[str, tuple[bytes, str]]:
    return {r["dict_hash"]: (bytes(r["dictionary"]), r["width"]) for r in spark.read.parquet(f"{path}/dictionary").collect()}


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document: shard, pack, place in the pack, doc_id, n_tokens, ids from the start of the pack to the document, and ids."""
    known = _dictionaries(spark, path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {k: (_decompressor(d), w) for k, (d, w) in known.items()}
        for batch in batches:
            for r in batch.to_pylist():
                reader, width = readers[r["dict_hash"]]
                arrays = [np.frombuffer(reader.decompress(r["frames"][a:b]), width).astype("<u4") for a, b in zip(r["offsets"], r["offsets"][1:])]
                n = [len(a) for a in arrays]
                if n != r["n_tokens"]:
                    raise ValueError(f"pack {r['shard']}/{r['pack']}: frames and index differ")
                ends = np.cumsum([0, *n])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(arrays).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]] * len(n), pa.int32()), pa.array([r["pack"]] * len(n), pa.int32()), pa.array(range(len(n)), pa.int32()),
                                                  pa.array(r["doc_ids"], pa.int64()), pa.array(n, pa.int64()), pa.array(ends[:-1], pa.int64()),
                                                  pa.array([zlib.crc32(a.tobytes()) for a in arrays], pa.int64()), ids],
                                                 names=["shard", "pack", "place", "doc_id", "n_tokens", "before", "ids_crc32", "ids"])

    return spark.read.parquet(f"{path}/packs").mapInArrow(unpack, "shard int, pack int, place int, doc_id long, n_tokens long, before long, ids_crc32 long, ids array<int>")


def document_ids(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this doc_id, from their packs and frames alone."""
    known = _dictionaries(spark, path)
    found = spark.read.parquet(f"{path}/packs").where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("doc_ids")))) \
        .where(F.element_at("doc_ids", F.col("at")) == doc_id) \
        .select("shard", "pack", "at", "dict_hash", F.expr("substring(frames, cast(offsets[at - 1] + 1 as int), cast(offsets[at] - offsets[at - 1] as int))").alias("frame")).orderBy("shard", "pack", "at").collect()
    return [np.frombuffer(_decompressor(known[r["dict_hash"]][0]).decompress(bytes(r["frame"])), known[r["dict_hash"]][1]).tolist() for r in found]


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it in the whole order), n_tokens and ids_crc32, from the files alone.

    Totals are summed per pack and per shard; the only window over everything has one row for each shard.
    """
    read = read_packs(spark, path).drop("ids")
    packs = spark.read.parquet(f"{path}/packs").select("shard", "pack", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = packs.groupBy("shard").agg(F.sum("n").alias("n"))
    earlier = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_first"))
    inside = W.partitionBy("shard").orderBy("pack").rowsBetween(W.unboundedPreceding, -1)
    first = packs.select("shard", "pack", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("pack_first")).join(shards, "shard")
    return read.join(first, ["shard", "pack"]).select("doc_id", (F.col("shard_first") + F.col("pack_first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def written_index(docs: DataFrame, tokenizer_json: str, end_id: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "token-files")
    write_packs(docs, scratch.root, tokenizer_json, end_id)
    return token_index(docs.sparkSession, scratch.root)

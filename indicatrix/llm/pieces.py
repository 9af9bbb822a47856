"""SentencePiece ids and back, with a max-plus scan over the chunks of giant texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indicatrix.llm.common import TEXT_ROWS, Scratch

#: Longer texts are split into chunks of about so many characters.
CHUNK_CHARS = 16_384
SPACE = "▁"
_CUT = re.compile(f"(?<=[^{SPACE}]){SPACE}")
_WORD, _BYTE = re.compile(" +[^ ]*"), re.compile("<0x[0-9A-F]{2}>")
#: A worker forgets its words when it knows more than this.
KEPT_WORDS = 1 << 18
LOW = float("-inf")

State = tuple[int, int] | None


class Pieces:
    """The pieces of a model and the lattice of a text: which piece may follow which, and what it weighs.

    In a unigram model any piece may follow any other and weighs its score: the best path is the model's segmentation. In a BPE model two pieces may be neighbours
    where merging their characters alone ends in these two; a path of such neighbours is the merge result of the whole, there is one of them, and pieces weigh nothing.
    A state at a boundary is the piece (its begin and end, relative to the boundary) that covers the last character before it; None where no piece crosses: at a
    word's first space, since no piece has a space behind a letter, and at both ends of a text.
    """

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models that keep the text as it is and put a space before it")
        self.merges = proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces)}
        if any(_CUT.search(p) for p in self.scores):
            raise ValueError("a piece has a space behind another character")
        self.longest = max(map(len, self.scores))
        self.unknown = min(self.scores.values()) - 10
        self.fits = lru_cache(1 << 20)(partial(_fits, self.scores))  # not a method: without a circle a task's pieces go when it ends

    def normal(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        spelled = [f"<0x{b:02X}>" for b in piece.encode()]
        return [self.ids[s] for s in spelled] if all(s in self.ids for s in spelled) else [self.library.unk_id()]

    def starting(self, text: str, at: int) -> list[str]:
        found = [text[at:end] for end in range(at + 1, min(at + self.longest, len(text)) + 1) if text[at:end] in self.scores]
        return found if text[at] in self.scores else [text[at], *found]

    def weight(self, piece: str) -> float:
        return 0.0 if self.merges else self.scores.get(piece, self.unknown)

    def states(self, text: str, at: int, cut: bool) -> list[State]:
        """All pieces of the text that begin before a boundary and end at it or behind it."""
        if cut:
            return [None]
        return [(s - at, s + len(p) - at) for s in range(max(0, at - self.longest), at) for p in self.starting(text, s) if s + len(p) >= at]

    def walk(self, text: str, first: int, entry: list[State], last: int, leave: list[State], keep: bool = False):
        """Best weights from every entry state at first to every leave state at last; with keep, also the nodes with their best predecessors."""
        width = len(entry)
        ending: dict[int, list[tuple]] = {}
        for x, state in enumerate(entry):
            value = np.full(width, LOW)
            value[x] = 0.0
            ending.setdefault(first if state is None else first + state[1], []).append((None if state is None else text[first + state[0]:first + state[1]], value, None, None))
        crossing: dict[tuple[int, int], tuple] = {}
        for at in range(first, last):
            for piece in self.starting(text, at) if at in ending else ():
                best, back = np.full(width, LOW), None
                for node in ending[at]:
                    if node[0] is None or not self.merges or self.fits(node[0], piece):
                        better = node[1] > best
                        if better.any():
                            best = np.maximum(best, node[1])
                            back = node if better[0] else back
                if best.max() > LOW:
                    node = (piece, best + self.weight(piece), back if keep else None, at)
                    ending.setdefault(at + len(piece), []).append(node)
                    if at + len(piece) >= last:
                        crossing[at - last, at + len(piece) - last] = node
        table = np.full((width, len(leave)), LOW)
        chosen: list = [None] * len(leave)
        for y, state in enumerate(leave):
            nodes = ending.get(last, []) if state is None else [crossing[state]] if state in crossing else []
            for node in nodes:
                chosen[y] = node if (node[1] > table[:, y])[0] else chosen[y]
                table[:, y] = np.maximum(table[:, y], node[1])
        return table, chosen

    def path(self, text: str, first: int, entry: State, last: int, leave: State) -> list[str]:
        """The pieces of the best path, those of the entry state not among them."""
        node = self.walk(text, first, [entry], last, [leave], keep=True)[1][0]
        out = []
        while node is not None and node[3] is not None:
            out.append(node[0])
            node = node[2]
        return out[::-1]

    def ends_of_word(self, text: str, first: int, last: int, first_cut: bool, last_cut: bool) -> tuple[int, int] | None:
        """The first and last cut of a chunk, both ends included where they are cuts; None where there is none."""
        cuts = [m.start() for m in _CUT.finditer(text, first, last) if m.start() > first]
        cuts = ([first] if first_cut else []) + cuts + ([last] if last_cut else [])
        return (cuts[0], cuts[-1]) if cuts else None

    def transfer(self, c: dict) -> np.ndarray:
        """A chunk's matrix: the best weight from each state at its begin to each at its end. Between two cuts every path is the same, which adds nothing to a choice."""
        text, first, last = c["text"], c["first"], c["last"]
        entry, leave = self.states(text, first, c["first_cut"]), self.states(text, last, c["last_cut"])
        between = self.ends_of_word(text, first, last, c["first_cut"], c["last_cut"])
        if between is None:
            return self.walk(text, first, entry, last, leave)[0]
        head = self.walk(text, first, entry, between[0], [None])[0] if between[0] > first else np.zeros((1, 1))
        tail = self.walk(text, between[1], [None], last, leave)[0] if between[1] < last else np.zeros((1, 1))
        return head + tail

    def chunk_ids(self, c: dict, x: int, y: int) -> list[int]:
        text, first, last = c["text"], c["first"], c["last"]
        entry, leave = self.states(text, first, c["first_cut"])[x], self.states(text, last, c["last_cut"])[y]
        between = self.ends_of_word(text, first, last, c["first_cut"], c["last_cut"])
        if between is None:
            return [i for p in self.path(text, first, entry, last, leave) for i in self.piece_ids(p)]
        head = self.path(text, first, entry, between[0], None) if between[0] > first else []
        tail = self.path(text, between[1], None, last, leave) if between[1] < last else []
        middle = text[between[0] + 1:between[1]].replace(SPACE, " ")  # the library puts the first space back
        inner = self.library.encode(middle) if middle else self.piece_ids(SPACE) if between[1] > between[0] else []
        return [*(i for p in head for i in self.piece_ids(p)), *inner, *(i for p in tail for i in self.piece_ids(p))]


def _fits(scores: dict[str, float], left: str, right: str) -> bool:
    """Whether merging the characters of two pieces in a row ends in these two."""
    symbols = list(left + right)
    while len(symbols) > 1:
        merged = [(-scores[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in scores]
        if not merged:
            break
        k = min(merged)[1]
        symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
    return symbols == [left, right]


class Words:
    """Ids of whole texts and texts of ids, batch by batch: a word and the spaces before it are encoded once, as no piece crosses a cut, and gathered from then on."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        table = [pieces.library.id_to_piece(i) for i in range(pieces.library.get_piece_size())]
        spelled = [bytes([int(t[3:5], 16)]) if _BYTE.fullmatch(t) else t.replace(SPACE, " ").encode() for t in table]
        self.lengths = np.array([len(t) for t in spelled], np.int64)
        self.data, self.starts = np.frombuffer(b"".join(spelled), np.uint8), np.cumsum(self.lengths) - self.lengths
        self.plain = np.array([t.encode() == x or _BYTE.fullmatch(t) is not None or SPACE in t for t, x in zip(table, spelled)])
        self.plain &= np.array([not (pieces.library.is_unknown(i) or pieces.library.is_control(i) or pieces.library.is_unused(i)) for i in range(len(table))])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        rest = [w[1:] for w in words]  # the library puts the first space back
        coded = iter(self.pieces.library.encode([r for r in rest if r], num_threads=1))
        new = [next(coded) if r else self.pieces.piece_ids(SPACE) for r in rest]
        count = np.array([len(n) for n in new], np.int64)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(new), np.int32, int(count.sum()))])

    def encode(self, texts: list[str]) -> pa.ListArray:
        if len(self.known) > KEPT_WORDS:
            self.forget()
        words = [_WORD.findall(f" {t.replace(SPACE, ' ')}") if t else [] for t in texts]
        flat = list(chain.from_iterable(words))
        new = set(flat) - self.known.keys()
        if new:
            self._learn(list(new))
        number = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        count = self.count[number]
        behind = np.append(0, np.cumsum(count))[np.append(0, np.cumsum([len(w) for w in words], dtype=np.int64))]
        return pa.ListArray.from_arrays(pa.array(behind.astype(np.int32)), pa.array(self.ids[_gather(self.begin[number], count)]))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """What the library makes of the ids: the bytes of all pieces, less the first space. Ids without bytes of their own, and bytes that are no text, are left to the library."""
        flat, bounds = ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy().astype(np.int64)
        flat, bounds = flat, bounds - bounds[0]
        if self.plain[flat].all():
            lengths = self.lengths[flat]
            data = self.data[_gather(self.starts[flat], lengths)]
            ends = np.append(0, np.cumsum(lengths))[bounds]
            first = ends[:-1][np.diff(ends) > 0]
            if (data[first] == 32).all():
                spaces = np.concatenate([[0], np.cumsum(np.diff(ends) > 0)])
                out = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(ends - spaces), pa.py_buffer(np.delete(data, first))])
                try:
                    out.validate(full=True)
                    return out.cast(pa.string())
                except pa.ArrowInvalid:
                    pass
        return pa.array(self.pieces.library.decode(ids.to_pylist()), pa.string())


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def max_plus(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The product of two transfer matrices: associative."""
    return (left[:, :, None] + right[None, :, :]).max(axis=1)


def choose_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each boundary on the best path, from products of the matrices before and behind it."""
    before, behind = [matrices[0]], [matrices[-1]]
    for m in matrices[1:]:
        before.append(max_plus(before[-1], m))
    for m in reversed(matrices[:-1]):
        behind.append(max_plus(m, behind[-1]))
    behind.reverse()
    out, at = [0], 0
    for k in range(len(matrices) - 1):
        at = int((matrices[k][at] + behind[k + 1][:, 0]).argmax())  # ties: the first
        out.append(at)
    return [*out, 0]


def split_chunks(pieces: Pieces, text: str, chunk_chars: int) -> list[dict]:
    """Chunks of a text, each with as much of its neighbours as a piece can reach; boundaries at a cut where one is near, else in the middle of a word."""
    whole = pieces.normal(text)
    chunk_chars = max(chunk_chars, 2 * pieces.longest)
    bounds, cuts = [0], [True]
    while len(whole) - bounds[-1] > chunk_chars:
        at = bounds[-1] + chunk_chars
        near = [m.start() for m in _CUT.finditer(whole, max(at - 1024, bounds[-1] + chunk_chars // 2), at)]
        bounds.append(near[-1] if near else at)
        cuts.append(bool(near))
    bounds.append(len(whole))
    cuts.append(True)
    out = []
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        low, high = max(0, a - pieces.longest), min(len(whole), b + pieces.longest)
        out.append({"number": k, "text": whole[low:high], "first": a - low, "last": b - low, "first_cut": cuts[k], "last_cut": cuts[k + 1]})
    return out


_CHUNK = pa.schema([("key", pa.int64()), ("number", pa.int32()), ("text", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("first_cut", pa.bool_()), ("last_cut", pa.bool_())])


def encode(docs: DataFrame, model: bytes, carried: list[str], chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """carried (a struct of columns), ids and chunks (how many the text was split into) of every row: the ids the model gives the whole text.

    Texts of up to chunk_chars characters are one chunk, of which a worker has each word encoded by the library once. Longer ones are split, also inside a word where there is no space. Each chunk yields
    the max-plus matrix between the pieces that may cross its begin and its end; a text's matrices, which are small, are multiplied; and each chunk finds its pieces
    again between the two states chosen for it. Null texts are empty and have no ids. Rows stay as they are, repeated ones too.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pieces", batch_rows=TEXT_ROWS)
    shared = spark.sparkContext.broadcast(model)  # one file of a vocabulary, whatever the documents
    rows = docs.select(F.struct(*[docs[c] for c in carried]).alias("carried"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["carried"]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(Pieces(shared.value))
        for big in batches:
            for batch in (big.slice(k, 256) for k in range(0, big.num_rows, 256)):
                found = words.encode(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("carried"), found, pa.array(np.ones(len(found), np.int32))], names=["carried", "ids", "chunks"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, key = Pieces(shared.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            for k in range(batch.num_rows):
                chunks = [{"key": key} | c for c in split_chunks(pieces, batch.column("text")[k].as_py(), chunk_chars)]
                first = [batch.column("carried")[k].as_py()] + [None] * (len(chunks) - 1)
                table = pa.RecordBatch.from_pylist(chunks, schema=_CHUNK)
                yield pa.RecordBatch.from_arrays([*table.columns, pa.array(first, batch.schema.field("carried").type)], names=[*_CHUNK.names, "carried"])
                key += 1

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        for batch in batches:
            tables = [pieces.transfer(c).tolist() for c in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("number"), pa.array(tables, pa.list_(pa.list_(pa.float64())))], names=["key", "number", "matrix"])

    def scan(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["number"])
        states = choose_states([np.array(r["matrix"]) for r in rows])
        return pa.table({"key": pa.array([r["key"] for r in rows], pa.int64()), "number": pa.array([r["number"] for r in rows], pa.int32()), "x": pa.array(states[:-1], pa.int32()), "y": pa.array(states[1:], pa.int32())})

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(shared.value)
        for batch in batches:
            found = [pieces.chunk_ids(c, c["x"], c["y"]) for c in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("number"), pa.array(found, pa.list_(pa.int32()))], names=["key", "number", "ids"])

    small = rows.where(F.char_length("text") <= chunk_chars).mapInArrow(short, f"carried {kind}, ids array<int>, chunks int")
    fields = "key long, number int, text string, first int, last int, first_cut boolean, last_cut boolean"
    chunks = scratch.keep(rows.where(F.char_length("text") > chunk_chars).mapInArrow(split, f"{fields}, carried {kind}"), "chunks")
    parts = chunks.drop("carried").repartition("key", "number")
    states = parts.mapInArrow(transfer, "key long, number int, matrix array<array<double>>").groupBy("key").applyInArrow(scan, "key long, number int, x int, y int")
    traced = chunks.drop("carried").join(states, ["key", "number"]).mapInArrow(trace, "key long, number int, ids array<int>")
    joined = traced.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("number", "ids"))).alias("c"))
    large = joined.join(chunks.where("number = 0").select("key", "carried"), "key").select("carried", F.flatten(F.transform("c", lambda x: x["ids"])).alias("ids"), F.size("c").alias("chunks"))
    return small.unionByName(large)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """encoded with a column decoded, the text of its ids; the mark ▁ in a text comes back as a space."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(Pieces(shared.value))
        for big in batches:
            for batch in (big.slice(k, 256) for k in range(0, big.num_rows, 256)):
                yield pa.RecordBatch.from_arrays([*batch.columns, words.decode(batch.column("ids"))], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(texts, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def round_trips(docs: DataFrame, model: bytes, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids in decimal, joined by commas), chunks and round_trip of every row."""
    plain = docs.select("doc_id", "text", F.md5(F.translate(F.coalesce("text", F.lit("")), SPACE, " ").cast("binary")).alias("digest"))
    back = decode(encode(plain, model, ["doc_id", "digest"], chunk_chars), model)
    digits = F.concat_ws(",", F.transform("ids", lambda i: i.cast("string")))
    return back.select(F.col("carried.doc_id").cast("long").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), F.crc32(digits.cast("binary")).alias("ids_crc32"), "chunks",
                       (F.md5(F.col("decoded").cast("binary")) == F.col("carried.digest")).alias("round_trip"))

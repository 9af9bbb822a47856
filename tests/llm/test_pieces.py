import gc
import random
import weakref
import zlib

import pyarrow as pa
import pytest

from indicatrix.llm import pieces
from indicatrix.llm.queries import piece_model


@pytest.fixture(scope="module")
def model():
    return piece_model()


def scanned(p, text, chunk):
    chunks = pieces.split_chunks(p, text, chunk)
    states = pieces.choose_states([p.transfer(c) for c in chunks])
    return [i for c, x, y in zip(chunks, states, states[1:]) for i in p.chunk_ids(c, x, y)]


def test_scan_gives_the_librarys_ids(model, texts):
    p, rng = pieces.Pieces(model), random.Random(3)
    parts = ["the", "ing", "er", "a", "b", "▁", " ", "   ", "\n", "é", "漢", "🙂", "0", "tion", "aa", "http"]
    made = ["".join(rng.choices(parts, k=rng.randint(1, 120))) for _ in range(100)] + ["".join(rng.choices(parts[:5], k=200)) for _ in range(40)] + ["a" * 300, "▁" * 100, " " * 133, ""]
    for text in made + [t for _, t in texts[:20]] + [t.replace(" ", "")[:2000] for _, t in texts[:10]]:
        if text:
            assert scanned(p, text, 40) == p.library.encode(text)


def test_unigram_path_weighs_as_much_as_the_librarys(model):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    proto.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
    p, rng = pieces.Pieces(proto.SerializeToString()), random.Random(5)
    for _ in range(60):
        text = "".join(rng.choices(["the", "ing", "er", "a", "b", "tion", "aa", "http", " x"], k=rng.randint(20, 60)))
        weights = [sum(p.scores[p.library.id_to_piece(i)] for i in ids) for ids in (scanned(p, text, 40), p.library.encode(text))]
        assert weights[0] == pytest.approx(weights[1])


def test_words_give_the_librarys_ids_and_texts(model, texts, monkeypatch):
    """Also with spaces at both ends, marks, control characters, special tokens, and words that are forgotten; decoding is the library's, for any ids."""
    monkeypatch.setattr(pieces, "KEPT_WORDS", 500)
    p, rng = pieces.Pieces(model), random.Random(9)
    words = pieces.Words(p)
    parts = ["the", "ing", " ", "  ", "▁", "\n", "\t", "\x00", "\u00a0", "é", "e\u0301", "漢", "🙂", "<s>", "</s>", "<unk>", "<0x41>", "0", "A", "\ufffd", "\r\n"]
    made = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(3000)] + ["", " ", "   ", "▁", "a ", " a", "\n"] + [t for _, t in texts]
    for k in range(0, len(made), 256):
        batch = made[k:k + 256]
        ids = words.encode(batch)
        assert ids.to_pylist() == p.library.encode(batch)
        assert words.decode(ids).to_pylist() == p.library.decode(ids.to_pylist())
    size = p.library.get_piece_size()
    for _ in range(300):
        ids = [[rng.randrange(size) for _ in range(rng.randint(0, 6))] for _ in range(3)]
        assert words.decode(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == p.library.decode(ids)


def test_products_are_associative():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b, c = rng.normal(size=(3, 4)), rng.normal(size=(4, 5)), rng.normal(size=(5, 2))
    assert np.allclose(pieces.max_plus(pieces.max_plus(a, b), c), pieces.max_plus(a, pieces.max_plus(b, c)))


def test_round_trips_of_odd_rows(odd_docs, no_docs, model):
    library = pieces.Pieces(model).library
    got = sorted((r["doc_id"] or 0, r["n_pieces"], r["ids_crc32"], r["round_trip"]) for r in pieces.round_trips(odd_docs, model, 512).collect())
    rows = [(r["doc_id"] or 0, library.encode(r["text"] or "")) for r in odd_docs.select("doc_id", "text").collect()]
    assert got == sorted((d, len(ids), zlib.crc32(",".join(map(str, ids)).encode()), True) for d, ids in rows)
    assert pieces.round_trips(no_docs, model).count() == 0


def test_pieces_go_when_a_task_ends(model):
    """A worker lives on after its task; what the task knew must not wait in it for the collector."""
    words = pieces.Words(pieces.Pieces(model))
    words.encode(["some words", "w" * 50])
    gone = weakref.ref(words.pieces)
    gc.disable()
    try:
        del words
        assert gone() is None
    finally:
        gc.enable()

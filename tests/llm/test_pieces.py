"""SentencePiece ids against the library: its BPE model, and unigram models that are written here by hand."""

import hashlib
import random
import struct

import pyarrow.dataset as ds
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from sentencepiece import SentencePieceProcessor  # noqa: E402

from tallyweave.llm import pieces  # noqa: E402

SP = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["▁", " ", "  ", "a", "b", "the", "ing", "tion", "\n", "é", "日", "🙂", "\t", "0", "==", "aaa", "--", "\x00", " ", "ﬁ", "<s>", "é"]


def field(number, data):
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(data, int):
        return varint(number << 3) + varint(data)
    if isinstance(data, float):
        return varint(number << 3 | 5) + struct.pack("<f", data)
    return varint(number << 3 | 2) + varint(len(data)) + data


def unigram(path, words, with_bytes):
    """A unigram model file: the unknown piece, perhaps bytes, and words with scores."""
    rows = [("<unk>", 0.0, 2)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256) if with_bytes] + [(w, s, 1) for w, s in words]
    data = b"".join(field(1, field(1, w.encode()) + field(2, s) + field(3, kind)) for w, s, kind in rows)
    data += field(2, field(3, 1) + field(4, len(rows)) + field(35, int(with_bytes))) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    path.write_bytes(data)
    return str(path)


def test_every_document(small):
    own, library = pieces.Pieces(SP), SentencePieceProcessor(model_file=SP)
    texts = [t or "" for t in ds.dataset(f"{small}/documents.parquet").to_table(columns=["text"])["text"].to_pylist()]
    want = library.encode(texts, num_threads=1)
    for text, ids in zip(texts, want):
        got = own.encode(text)
        assert got.tolist() == ids and own.decode(got) == library.decode(ids)
    for text, ids in list(zip(texts, want))[:40]:  # without stretches that are kept, in chunks of any size
        whole = library.normalize(text)
        assert list(own.stream([whole])) == ids == list(own.stream(whole[i : i + 7] for i in range(0, len(whole), 7)))


def test_merges_of_any_text():
    own, library, rng = pieces.Pieces(SP), SentencePieceProcessor(model_file=SP), random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        assert own.encode(text).tolist() == library.encode(text) == list(own.stream(library.normalize(text)))
    for c in "▁a=-0 \n":
        for n in range(200):
            assert own.encode(c * n).tolist() == library.encode(c * n)


@pytest.mark.parametrize("with_bytes", [True, False])
def test_unigram_models(tmp_path, with_bytes):
    rng = random.Random(4)
    made = {"".join(rng.choice("abc▁") for _ in range(rng.randint(2, 7))) for _ in range(150)} | set("abc▁")
    path = unigram(tmp_path / "m.model", [(w, -rng.randint(64, 768) / 64) for w in sorted(made)], with_bytes)
    own, library = pieces.Pieces(path), SentencePieceProcessor(model_file=path)
    assert own.merges is None and not own.by_word
    for _ in range(500):
        text = "".join(rng.choice(["a", "b", "c", " ", "ab", "日", "x"]) for _ in range(rng.randint(0, 120)))
        assert own.encode(text).tolist() == library.encode(text)
        assert not with_bytes or own.decode(own.encode(text)) == text


def test_window_stays_small(monkeypatch):
    own, rng, held = pieces.Pieces(SP), random.Random(8), []
    commit = own._commit
    monkeypatch.setattr(own, "_commit", lambda window, best, at: held.append(len(window)) or commit(window, best, at))
    assert sum(1 for _ in own.stream("".join(rng.choice("abcdefghij") for _ in range(50)) for _ in range(400))) > 4000
    assert len(held) > 1000 and max(held) < 20 * own.longest


def test_documents(spark):
    rows = [(1, "some words  here "), (2, None), (3, ""), (None, "no id"), (4, "row twice"), (4, "row twice"), (5, "long " * 60_000 + "x" * 50_000)]
    got = pieces.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), SP).collect()
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert all(r.round_trip for r in got) and [r.n_ids for r in got if r.doc_id in (2, 3)] == [0, 0]

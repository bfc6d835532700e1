"""BPE codec, token counts and wavelet files against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnlake.llm import bpe, shared, token_counts, wavelet
from tarnlake.llm.shared import materialize, read, shared_dir

PARTS = [" ", "  ", "\n", "\t", "'s", "'t", ".", ",", "1", "2", "é", "漢", "́", "\x1c", "\x85", "▁", "<|endoftext|>", "<|startoftext|>", "😀", "Σ", "İ", "the", "Word", "ll", "<s>", "'"]


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(n)] + ["", "a" * 4000, " " * 50, "word " * 400]


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_codec_matches_library(vocabulary):
    path = vocabulary("byte_bpe_50k.json")
    own, lib = bpe.Codec(path), Tokenizer.from_file(path)
    texts = odd_texts(1500)
    got = own.encode(texts)
    for t, g, e in zip(texts, got, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert g == packed(e.ids), t
        assert own.decode(g) == lib.decode(e.ids, skip_special_tokens=False)
    assert own.encode(texts) == got  # from the kept dictionaries


def test_both_trees_agree(vocabulary):
    own = bpe.Codec(vocabulary("byte_bpe_50k.json"))
    rnd = random.Random(5)
    words = {"".join(rnd.choice("abcdethrsion") for _ in range(rnd.randint(1, 120))) for _ in range(300)}
    for w, ids in own.encode_pieces([*words]).items():
        assert ids == packed(own.merge_one(own.byte_id[np.frombuffer(w.encode(), np.uint8)].tolist()))


def test_wrong_utf8_is_replaced(vocabulary):
    own = bpe.Codec(vocabulary("byte_bpe_50k.json"))
    assert own.decode(packed([int(own.byte_id[0xC3])])) == "�"


def test_encode_decode_frame(spark, odd_rows, no_rows, vocabulary):
    path = vocabulary("byte_bpe_50k.json")
    out = bpe.digests(bpe.encode_decode(odd_rows, path)).collect()
    lib = Tokenizer.from_file(path)
    want = []
    for r in odd_rows.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert bpe.encode_decode(no_rows, path).count() == 0


def test_counts_match_library(spark, odd_rows, no_rows, vocabulary, data):
    path = vocabulary("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    model = token_counts.Pieces(path)
    for t in odd_texts(1500, 2):
        units, marks = model.split(t)
        assert sum(model.count(units)) + marks == len(lib.encode(t)), t
    for frame in (odd_rows, no_rows, read(spark, data, "documents")):
        want = sorted(str((r.doc_id, len((r.text or "").encode()), len(lib.encode(r.text or "")))) for r in frame.collect())
        for hot in (0, 50, 100_000):  # all by shuffle, a mix, and nearly all by broadcast
            got = token_counts.token_counts(frame, path, hot_size=max(1, hot), hot_sample=100)
            assert sorted(str(tuple(r)) for r in got.collect()) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=700), st.data())
def test_wavelet_matrix(ids, data):
    ids = np.array(ids, dtype=np.uint32)
    m = wavelet.ShardFile(wavelet.pack([3, 0], ids, [1, None], np.array([0, len(ids)]))).matrix
    assert (m.all() == ids).all()
    at = np.arange(len(ids))
    assert (m.access(at) == ids).all()
    token = data.draw(st.sampled_from([*ids.tolist(), 5, 10**6]))
    where = np.flatnonzero(ids == token)
    a, b = sorted(data.draw(st.tuples(st.integers(0, len(ids)), st.integers(0, len(ids)))))
    assert m.count(token) == len(where)
    assert m.count(token, a, b) == ((where >= a) & (where < b)).sum()
    assert (m.occurrences(token) == where).all() and (m.occurrences(token, 1, 3) == where[1:3]).all()


def test_library_encoder(vocabulary):
    path = vocabulary("word_bpe_49k.json")
    own, lib = wavelet.LibraryEncoder(path), Tokenizer.from_file(path)
    texts = odd_texts(1500, 3) + ["Éa, ÉTÉ. straße, naïve"]
    assert own.by_chunk and own.by_letters
    for again in range(3):  # then from the kept dictionaries, then whole texts
        own.by_chunk = again < 2
        ids, counts = own.encode(texts)
        for t, g in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert packed(g) == packed(lib.encode(t, add_special_tokens=False).ids), t
    ids, counts = own.encode([])
    assert len(ids) == len(counts) == 0


def test_encoder_doubts_other_vocabularies(vocabulary):
    """A vocabulary whose tokens carry spaces is not cut at them."""
    path = vocabulary("byte_bpe_50k.json")
    own, lib = wavelet.LibraryEncoder(path), Tokenizer.from_file(path)
    assert not own.by_chunk
    texts = odd_texts(100, 4)
    ids, counts = own.encode(texts)
    assert [packed(g) for g in np.split(ids, np.cumsum(counts)[:-1])] == [packed(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_look_ups_read_parts_of_a_file():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 40_000, 3_000_000).astype(np.uint32)
    data = wavelet.pack([0, 0], ids, [1], np.array([len(ids)]))
    got = []

    def read(start, size):
        got.append((start, size))
        return data[start : start + size]

    m = wavelet.ShardFile(read).matrix
    assert m.access([1_234_567])[0] == ids[1_234_567]
    assert len(got) == 2 + m.bits  # header, and one block of each plane
    token = int(ids[77])
    where = np.flatnonzero(ids == token)
    assert m.count(token) == len(where) and m.count(token, 1000, 2_000_000) == ((where >= 1000) & (where < 2_000_000)).sum()
    assert m.occurrences(token, 2, 3)[0] == where[2]
    assert sum(s for _, s in got) < 0.9 * len(data)
    assert (m.occurrences(token) == where).all() and (m.all() == ids).all()


@pytest.mark.parametrize("which", ["odd", "data"])
def test_wavelet_round_trip(spark, monkeypatch, odd_rows, vocabulary, data, which):
    monkeypatch.setattr(shared, "MAX_REGIONS", 2)  # regions cut into parts
    path = vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    frame = odd_rows if which == "odd" else read(spark, data, "documents")
    rows = sorted(frame.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    folder = shared_dir(spark, "wm")
    manifest = materialize(wavelet.write(frame, path, folder, 2, shard_bytes=60_000, file_tokens=9_000), "wm-manifest")
    assert which == "odd" or manifest.filter("number > 0").count() > 3
    got = wavelet.read_documents(spark, folder, manifest).collect()
    start, want = 0, []
    for r in rows:
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(packed(ids)), packed(ids)))
        start += len(ids)
    assert [tuple(r) for r in sorted(got, key=lambda r: r.start)] == want


def test_wavelet_of_nothing(no_rows, vocabulary):
    assert wavelet.round_trip(no_rows, vocabulary("word_bpe_49k.json")).count() == 0

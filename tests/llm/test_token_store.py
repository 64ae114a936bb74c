import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tillsight.llm import bpe_cache
from tillsight.llm.bpe_cache import encoder
from tillsight.llm.queries import tokenizer_path
from tillsight.llm.token_store import LENGTHS, pack, read_corpus, token_report, unpack, write_corpus


@pytest.fixture(scope="module")
def whole():
    """The library on whole texts."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("top", [1, 255, 256, 65535, 65536, 2**24, 2**32 - 1])
@pytest.mark.parametrize("n", [0, 1, 3, 4, 1001])
def test_coding_round_trip(top, n):
    values = np.random.default_rng(n).integers(0, top, n, endpoint=True, dtype=np.uint64).astype(np.uint32)
    control, data = pack(values)
    assert len(control) == -(-n // 4)
    assert len(data) == sum(1 + (v > 255) + (v > 65535) + (v > 16777215) for v in values.tolist())
    assert unpack(control, data, n).tolist() == values.tolist()


def test_lengths_by_control_byte():
    assert LENGTHS[0b11100100].tolist() == [1, 2, 3, 4]


def test_pieces_encode_like_whole_texts(whole):
    enc = encoder(tokenizer_path())
    parts = [" ", "  ", "\n", " \n", "\t", "a", "it's", "é", "中文", "12", "!", "\x1c", "\xa0", "don't", "É", "\r", "😀",
             "#", "'", "'s", "٣", "́", ".", "\x85", "​", "\0", "<|endoftext|>", "word", "Word***"]
    rnd = random.Random(4)
    for _ in range(5000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9)))
        assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == whole(text), repr(text)


def test_batches_encode_like_whole_texts(whole, monkeypatch):
    enc = encoder(tokenizer_path())
    parts = [" ", "  ", "\n", "a", "it's", "é", "中文", "12", "!", "\x1c", "\xa0", " \xa0", "\u3000", " \u2003", "\x85", "\x0b ",
             "word ", "Word*** ", "the ", "<|endoftext|>", "😀 ", "x" * 90 + " "]
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    array = pa.array(["skipped", *texts]).slice(1)
    for size in (1, 500, 4 << 20):
        monkeypatch.setattr(bpe_cache, "SLICE_BYTES", size)
        got = list(enc.encode_batch(array))
        assert len(got) == len(texts)
        for text, ids in zip(texts, got):
            assert np.frombuffer(ids, enc.dtype).tolist() == whole(text), repr(text)
    assert list(enc.encode_batch(array.slice(0, 0))) == []


def test_pieces_of_a_batch_are_encoded_once(monkeypatch):
    """Texts of some megabytes are numbered together: what they share goes to the library once, cache or not."""
    monkeypatch.setattr(bpe_cache, "CACHE_BYTES", 1)
    enc, sent = bpe_cache.BpeEncoder(tokenizer_path()), []

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            sent.extend(p for t in texts for p in t.split())
            return tokenizer.encode_batch_fast(texts, **kw)

    tokenizer, text = enc.tokenizer, " ".join(f"word{i:x}" for i in range(300_000))
    enc.tokenizer = Counted()
    got = list(enc.encode_batch(pa.array([text] * 3)))
    assert got[0] == got[1] == got[2] == np.array(tokenizer.encode(text, add_special_tokens=False).ids, enc.dtype).tobytes()
    assert len(sent) <= 300_000


def test_a_word_is_encoded_once_whatever_marks_follow_it(whole):
    enc, sent = bpe_cache.BpeEncoder(tokenizer_path()), []

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            sent.extend(p for t in texts for p in t.split())
            return tokenizer.encode_batch_fast(texts, **kw)

    tokenizer, enc.tokenizer = enc.tokenizer, Counted()
    marks = ["", ",", ".", "***", "$$$", "?!", "'", ")\"", "\\", "`~", "'s", "'.s", "é", "×", "1"]
    texts = [" ".join(["x", *(f"{w}{m}" for m in marks for w in ("bakery", "año", "Ørsted"))]) for _ in range(2)]
    for text, ids in zip(texts, enc.encode_batch(pa.array(texts))):
        assert np.frombuffer(ids, enc.dtype).tolist() == whole(text)
    assert [sent.count(w) for w in ("bakery", "año", "Ørsted")] == [1, 1, 1]
    assert not {"bakery,", "año***", "Ørsted`~"} & set(sent)


def test_coded_pieces_take_few_bytes():
    """What a worker holds from slice to slice: a word of 9 letters with its ids and places, 100 bytes at most, and the whole is bounded."""
    import gc
    import tracemalloc
    enc, digits = bpe_cache.BpeEncoder(tokenizer_path()), str.maketrans("0123456789", "abcdefghij")
    words = [f"{i * 7919 % 10**9:09d}".translate(digits) for i in range(100_000)]
    list(enc.encode_batch(pa.array(["x " + " ".join(words[:10])])))
    gc.collect()
    tracemalloc.start()
    arrow = pa.total_allocated_bytes()
    list(enc.encode_batch(pa.array(["x " + " ".join(words)])))
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held <= 100 * len(words)


def test_kept_pieces_are_bounded_by_bytes(whole, monkeypatch):
    monkeypatch.setattr(bpe_cache, "KEPT_BYTES", 5_000)
    enc = bpe_cache.BpeEncoder(tokenizer_path())
    for k in range(20):
        texts = [f"x common word{k} {'y' * 70} " + " ".join(f"{k}a{i}b" for i in range(200)) for k in (k, k, k + 1)]
        assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode_batch(pa.array(texts))] == list(map(whole, texts))
        assert len(enc.kept.pieces) == len(enc.kept.size) and enc.kept.size.sum() == len(enc.kept.ids)
        assert enc.kept.pieces.get_total_buffer_size() + enc.kept.ids.nbytes + enc.kept.size.nbytes <= 5_200
        assert "y" * 70 not in enc.kept.pieces.to_pylist()


def test_every_white_space_of_python_is_arrows():
    import re
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    found = pc.match_substring_regex(pa.array([c + " " for c in every]), bpe_cache._ARROW_RUN).to_pylist()
    assert [c for c, f in zip(every, found) if f] == [c for c in every if re.match(r"\s", c)]


def test_caches_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe_cache, "CACHE_BYTES", 200_000)
    enc = bpe_cache.BpeEncoder(tokenizer_path())
    rnd = random.Random(2)
    unspaced = ["".join(chr(rnd.randint(0x4E00, 0x9FFF)) for _ in range(2000)) for _ in range(100)]
    spaced = [" ".join(str(rnd.random()) for _ in range(200)) for _ in range(100)]
    list(enc.encode_batch(pa.array(unspaced + spaced)))
    for cache in (enc.words, enc.spaced, enc.plain):
        for age in (cache, cache.old):
            assert all(len(k) <= bpe_cache.CACHE_LENGTH for k in age)
            assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in age.items()) <= 200_000


def test_files_hold_every_document_in_order(spark, awkward, clashing, whole, tmp_path):
    docs = clashing(awkward)
    path = str(tmp_path / "tokens")
    write_corpus(docs, path, tokenizer_path(), block_ids=50)
    got = read_corpus(spark, path).collect()
    want = sorted(((r.doc_id, whole(r.text or "") + [2]) for r in docs.collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(map(repr, ((r.doc_id, r.ids) for r in got))) == sorted(map(repr, want))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [w[0] for w in want]
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    ranks = spark.read.parquet(path + "/vocab").orderBy("rank").collect()
    assert [r.n for r in ranks] == sorted((r.n for r in ranks), reverse=True) and sum(r.n for r in ranks) == at


def test_empty_table(awkward):
    assert token_report(awkward.where("false"), tokenizer_path()).collect() == []

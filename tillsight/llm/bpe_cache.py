"""Byte-level BPE encoding with the tokenizers library, one word at a time and cached.

A byte-level BPE splits a text into pre-tokens before merging, and no pre-token
goes on over white space after a non-space character. A text is therefore cut
there, and each distinct piece is encoded by the library's own model and cached. The
texts of a batch are cut and numbered by Arrow; a word and the marks behind it are
encoded apart, so that a word goes to the library once, whatever marks follow it.
Coded pieces stay in Arrow and numpy arrays, and only new ones become Python strings;
numpy lays the ids out in the order of the texts. Texts outside that rule go to the
library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of entries kept per age (two of them) in each of a worker's three caches of single pieces.
CACHE_BYTES = 16 << 20
#: Bytes of coded pieces that a worker keeps from slice to slice.
KEPT_BYTES = 16 << 20
#: Longer pieces (code points) are not kept: they hardly come again.
CACHE_LENGTH = 64
#: New pieces given to the library as one text.
JOINED = 1000
#: Bytes of text numbered at once, at most; a longer text is a slice of its own.
SLICE_BYTES = 20 << 20

#: White space beside a space: then cuts at spaces alone would part a run.
_RUN = re.compile(r"\s | \s")
#: The same for Arrow, whose own class of white space is ASCII only.
_SPACE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_ARROW_RUN = f"{_SPACE} | {_SPACE}"
_PIECE = re.compile(r"\s*\S+|\s+")
#: White space to Python, but not to the library.
_ODD = re.compile(r"[\x1c-\x1f]")
_LATIN = re.compile(r"[\x00-ɏ]*")
#: Letters, and ASCII marks, in every version of Unicode. A run of marks that ends a piece is one pre-token.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MARKED = f"^[{_LETTERS}]+[{re.escape(_MARKS)}]+$"

#: Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """Byte -> its letter: printable Latin-1 bytes stand for themselves, others for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Cache(dict):
    """Makes what is missing. When full, the entries become the old ones; those met again are taken back."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old, self.held = make, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHE_LENGTH:
            size = 250 + 4 * len(key) + len(value)  # at most: two objects and the entry's share of the table
            self.held += size
            if self.held >= CACHE_BYTES:
                self.old, self.held = dict(self), size
                self.clear()
            self[key] = value
        return value


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``start`` to ``start + size`` of each pair, one pair after the other."""
    ends = np.cumsum(size, dtype=np.int32)  # a slice has fewer than 2^31 ids
    place = np.repeat(start.astype(np.int32) - (ends - size), size)
    place += np.arange(len(place), dtype=np.int32)
    return place


def _starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size, dtype=np.int32) - size


class _Kept:
    """Spaced pieces and their ids; those of the last slices, as far as ``KEPT_BYTES`` go."""

    def __init__(self, dtype):
        self.pieces, self.ids, self.size = pa.array([], pa.string()), np.zeros(0, dtype), np.zeros(0, np.int32)

    def coded(self, pieces: pa.Array, make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size): where in ``ids`` each of the distinct ``pieces`` has its own; ``make`` gives those of new ones."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.pieces), -1).to_numpy()
        new = np.flatnonzero(at < 0)
        made, made_size = make(pieces.take(pa.array(new)).to_pylist())
        ids = np.concatenate([self.ids, made])
        at = at.copy()
        at[new] = len(self.size) + np.arange(len(new))
        size = np.concatenate([self.size, made_size])
        start = _starts(size)
        unseen = np.ones(len(self.size), dtype=bool)
        unseen[at[at < len(unseen)]] = False
        self._keep(pa.concat_arrays([pieces, self.pieces.filter(pa.array(unseen))]),
                   ids, np.concatenate([at, np.flatnonzero(unseen)]), start, size)
        return ids, start[at], size[at]

    def _keep(self, pieces: pa.Array, ids: np.ndarray, at: np.ndarray, start: np.ndarray, size: np.ndarray):
        short = pc.less_equal(pc.utf8_length(pieces), CACHE_LENGTH).to_numpy(zero_copy_only=False)
        held = pc.binary_length(pieces).to_numpy() + size[at] * ids.itemsize + 8  # with the places of both
        fits = np.flatnonzero(short & (np.cumsum(np.where(short, held, 0), dtype=np.int64) <= KEPT_BYTES))
        self.pieces, at = pieces.take(pa.array(fits)), at[fits]
        self.ids, self.size = ids[_spans(start[at], size[at])], size[at]


class BpeEncoder:
    """``encode(text)`` gives the ids of ``Tokenizer.encode`` as little-endian bytes."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"  # of array, on little-endian machines
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (spec["model"]["type"] == "BPE" and spec.get("normalizer") is None
                         and spec.get("post_processor") is None and pre.get("type") == "ByteLevel"
                         and not pre.get("add_prefix_space") and pre.get("use_regex", True))
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.letters = byte_letters()
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)  # ids that begin with a space
        self.opens[[i for token, i in vocab.items() if token.startswith(self.letters[0x20])]] = True
        self.pre_token = regex.compile(PRE_TOKEN)
        self.words = _Cache(self._word)
        self.spaced = _Cache(self._spaced)
        self.plain = _Cache(lambda piece: b"".join(map(self.words.__getitem__, self._pre_tokens(piece))))
        self.kept = _Kept(self.dtype)

    def _word(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _pre_tokens(self, piece: str) -> list[str]:
        if _LATIN.fullmatch(piece):
            return self.pre_token.findall(piece)
        at, words = 0, []  # the library's own character classes
        for _, (_, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece):
            words.append(piece[at:end])
            at = end
        return words

    def _spaced(self, piece: str) -> bytes:
        """A piece that a space precedes; after a leading word the rest stands for itself."""
        if piece.isalpha():
            return self._word(" " + piece)
        if piece and piece[0].isalpha():
            word, *rest = self._pre_tokens(piece)
            return self.spaced[word] + b"".join(map(self.words.__getitem__, rest))
        return b"".join(map(self.words.__getitem__, self._pre_tokens(" " + piece)))

    def encode(self, text: str) -> bytes:
        if not self.by_piece or any(t in text for t in self.added):
            return self._whole(text)
        if _RUN.search(text):
            if _ODD.search(text):
                return self._whole(text)
            return b"".join(map(self.plain.__getitem__, _PIECE.findall(text)))
        pieces = text.split(" ")
        head = self.plain[pieces[0]] if pieces[0] else b""
        return head + b"".join(map(self.spaced.__getitem__, pieces[1:]))

    def encode_batch(self, texts: pa.Array) -> Iterator[bytes]:
        """``encode`` of each text in turn, by even slices of ``SLICE_BYTES`` at most."""
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, total = 0, int(sizes[-1]) if len(sizes) else 0
        share = -(-total // max(1, -(-total // SLICE_BYTES)))
        while at < len(texts):
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + share, side="right")))
            yield from self._encode_slice(texts.slice(at, to - at))
            at = to

    def _encode_slice(self, texts: pa.Array) -> list[bytes]:
        if not self.by_piece:
            return [self._whole(t) for t in texts.to_pylist()]
        special = pc.match_substring_regex(texts, _ARROW_RUN)
        for token in self.added:
            special = pc.or_(special, pc.match_substring(texts, token))
        special = special.to_numpy(zero_copy_only=False)
        plain = iter(self._encode_spaced(texts.filter(pa.array(~special))))
        return [self.encode(texts[i].as_py()) if alone else next(plain) for i, alone in enumerate(special)]

    def _encode_spaced(self, texts: pa.Array) -> list[bytes]:
        """Texts without white space beside a space: the first piece stands alone, a space precedes each other."""
        if not len(texts):
            return []
        cut = pc.split_pattern(texts, " ")
        numbered = cut.flatten().dictionary_encode()
        code, pieces = numbered.indices.to_numpy().copy(), numbered.dictionary
        first = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        del cut, numbered
        heads, head_code = np.unique(code[first], return_inverse=True)
        code[first] = len(pieces)
        used = np.zeros(len(pieces) + 1, dtype=bool)
        used[code] = True
        used = used[:-1]
        ids, size = self._spaced_pieces(pieces.filter(pa.array(used)))
        lead = [self.plain[p] if p else b"" for p in pieces.take(pa.array(heads)).to_pylist()]
        lead_size = np.fromiter(map(len, lead), np.int32, len(lead)) // self.dtype.itemsize
        code = (np.cumsum(used, dtype=np.int32) - 1)[np.minimum(code, len(pieces) - 1)]
        code[first] = len(size) + head_code
        ids = np.concatenate([ids, np.frombuffer(b"".join(lead), self.dtype)])
        size = np.concatenate([size, lead_size])
        n = size[code]
        ids = ids[_spans(_starts(size)[code], n)].tobytes()
        ends = np.cumsum(np.add.reduceat(n, first), dtype=np.int64) * self.dtype.itemsize
        return [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def _spaced_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``_spaced`` of distinct pieces, one after the other, and the number of ids of each."""
        marked = pc.match_substring_regex(pieces, _MARKED)
        some = pieces.filter(marked)
        stems = pc.ascii_rtrim(some, characters=_MARKS)
        tails = pc.replace_substring_regex(some, f"^[{_LETTERS}]+", "", max_replacements=1).dictionary_encode()
        keys = pc.replace_with_mask(pieces, marked, stems).dictionary_encode()
        ids, start, size = self.kept.coded(keys.dictionary, self._new)
        # A piece is its key's ids and its marks', of which there are none if it is its own key.
        marks = [self.words[t] for t in tails.dictionary.to_pylist()]
        marks_size = np.fromiter(map(len, marks), np.int32, len(marks)) // self.dtype.itemsize
        pair_start, pair_size = np.zeros((2, len(pieces), 2), dtype=np.int32)
        pair_start[:, 0], pair_size[:, 0] = start[keys.indices], size[keys.indices]
        behind = marked.to_numpy(zero_copy_only=False)
        pair_start[behind, 1] = len(ids) + _starts(marks_size)[tails.indices]
        pair_size[behind, 1] = marks_size[tails.indices]
        pool = np.concatenate([ids, np.frombuffer(b"".join(marks), self.dtype)])
        return pool[_spans(pair_start.ravel(), pair_size.ravel())], pair_size.sum(axis=1, dtype=np.int32)

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many each has. The library gets them joined; the ids that begin with a space part them."""
        ids, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int32)]
        for at in range(0, len(pieces), JOINED):
            own = pieces[at:at + JOINED]
            coded = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(own)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            size = np.diff(np.append(np.flatnonzero(self.opens[coded]), len(coded)))
            if len(size) != len(own) or "" in own:
                found = [self._spaced(p) for p in own]
                coded = np.frombuffer(b"".join(found), self.dtype)
                size = np.fromiter(map(len, found), np.int32, len(found)) // self.dtype.itemsize
            ids.append(coded)
            sizes.append(size.astype(np.int32))
        return np.concatenate(ids), np.concatenate(sizes)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()


_ENCODERS: dict[str, BpeEncoder] = {}


def encoder(path: str) -> BpeEncoder:
    """This worker's encoder for ``path``; its cache lives as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BpeEncoder(path)
    return _ENCODERS[path]

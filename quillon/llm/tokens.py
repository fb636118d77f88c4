"""Ids of whole texts by the ``tokenizers`` library, each distinct piece of text encoded once.

A vocabulary whose pre-tokenizer drops white space and never joins an ASCII letter to the punctuation after it may be
given its texts in pieces; equal pieces have equal ids, so a worker keeps the ids of the pieces it has met.  For every
other vocabulary whole texts are encoded.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces whose ids a worker keeps at most; it starts anew when they are more.
CACHE = 300_000
#: Text that is worked on at once, and that is encoded at once.
SLICE_BYTES, ENCODE_BYTES = 1 << 20, 2 << 20

# The pre-tokenizer pattern and normalizers for which texts may be cut as described above.
_PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECE_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Punctuation before which a piece ends if an ASCII letter stands before it; no apostrophe, and nothing of <|...|>.
_PUNCTUATION = b".,;:!?$%&*#()\"@+=/-_~^"

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(_PUNCTUATION)] = True

#: The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Letters that Python lowers by their neighbours or to more than one.
_CASED_BY_CONTEXT = frozenset("\u03a3\u0130")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, one past the last) row of runs of about *most* bytes of text; a longer text is a run of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(texts)
    while at < n:
        done = int(sizes[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield at, end
        at = end


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of *texts* (null: empty) laid end to end, and where each text starts, with the end of the last."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.load(open(path))
        try:
            kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
            split = spec["pre_tokenizer"]["pretokenizers"][0]
            self.pieces = kinds == _PIECE_NORMALIZERS and split["pattern"]["Regex"] == _PIECE_PATTERN and split["behavior"] == "Removed" and split["invert"]
        except (KeyError, TypeError, IndexError):
            self.pieces = False
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.lens, self.starts, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _encode_pieces(self, words: list[str]) -> list[list[int]]:
        """A piece of letters alone, already composed, is one word to the pre-tokenizer: the model alone takes it."""
        model, found, rest = self.tokenizer.model, [], []
        for k, w in enumerate(words):
            if w.isalpha() and (w.isascii() or is_normalized("NFC", w) and not _CASED_BY_CONTEXT.intersection(w)):
                found.append([t.id for t in model.tokenize(w if w.isascii() and w.islower() else w.lower().encode().decode("latin-1").translate(_BYTE_LEVEL))])
            else:
                found.append(None)
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([words[k] for k in rest], add_special_tokens=False)):
            found[k] = e.ids
        return found

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            found = self._encode_pieces(part)
            n = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(n.sum()))
            k = len(self.codes)
            while k + len(part) > len(self.lens):
                self.lens, self.starts = np.concatenate([self.lens, self.lens * 0]), np.concatenate([self.starts, self.starts * 0])
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.lens[k : k + len(part)] = n
            self.starts[k : k + len(part)] = self.used + np.cumsum(n) - n
            self.ids[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            self.codes.update(zip(part, range(k, k + len(part))))

    def _cut(self, raw: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
        """The pieces of each text: cut at ASCII white space, and between an ASCII letter and punctuation."""
        if len(raw):
            after = np.append(raw[1:], np.uint8(32))
            if b"<|" not in raw.tobytes():  # special tokens are looked for in the text as it is
                raw = np.where(_UPPER[raw] & (after < 128), raw + np.uint8(32), raw)
            gaps = np.flatnonzero(_LETTER[raw] & _PUNCT[after]) + 1
            offsets = offsets + np.searchsorted(gaps, offsets, "left")
            raw = np.insert(raw, gaps, np.uint8(32))
        texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(raw)))
        return pc.ascii_split_whitespace(texts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts laid end to end, and where each text's ids start, with the end of the last."""
        if not self.pieces:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int64)
            return np.fromiter((i for ids in found for i in ids), np.uint32, int(ends[-1])), ends
        cut = self._cut(*joined(texts))
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.codes) + len(words) > CACHE:
            self._forget()
        self._learn([w for w in words if w not in self.codes])
        code = np.fromiter((self.codes[w] for w in words), np.int64, len(words))
        code = code[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else code
        n = self.lens[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.starts[code] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[cut.offsets.to_numpy(zero_copy_only=False) - cut.offsets[0].as_py()]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for the vocabulary at *path*."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def documents_ids(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, starts) of slices of *batches*, whose column text is encoded; *end_id* closes each document."""
    enc = encoder(vocabulary)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for a, b in slices(texts, ENCODE_BYTES):
            ids, ends = enc.encode(texts.slice(a, b - a))
            if end_id is not None:
                ids = np.insert(ids, ends[1:], np.uint32(end_id))
                ends = ends + np.arange(len(ends))
            yield batch.slice(a, b - a), ids, ends

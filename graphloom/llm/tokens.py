"""Encoding of whole texts by a byte-level BPE tokenizer file: cut at sure token boundaries, distinct pieces encoded once.

In the split pattern of byte-level BPE no token crosses these places, whatever stands
further left or right: after a letter before an ASCII character that is none; before a
space that something visible follows; before white space after something visible; after
a line feed, tab or the like before something visible. So a text is the concatenation of
the encodings of its pieces between them. Pieces repeat, texts don't. All texts of a
slice are cut together by numpy on their bytes, Arrow finds the distinct pieces, and only
those that no earlier slice had reach the tokenizer: many at a time as one text where
each starts with a space or stands between line feeds, so that the ids tell the pieces apart.

A tokenizer of another family (normalizer, other pre-tokenizer, dropout) is not cut: its
pieces are the whole texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: A piece, perhaps with a space before it, that has no white space of Unicode.
_VISIBLE = re.compile(rb" ?[!-~\x80-\xc1\xc3-\xe0\xe4-\xf4]+").fullmatch
#: The split pattern that the cuts hold for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of pieces in one text for the library, and of texts at once: its own results take far more room than the ids.
_JOINED, _AT_ONCE = 4_000, 400_000
_LETTER, _OTHER, _SEEN, _SPACE, _FEED, _PRINT = 1, 2, 4, 8, 16, 32


def _classes() -> np.ndarray:
    """Per byte: ASCII letter, other ASCII, start of something visible, white space, white space but the space, visible ASCII."""
    out = np.zeros(256, "u1")
    for b in range(128):
        out[b] = _LETTER if chr(b).isalpha() else _OTHER
    out[0x21:0x7F] |= _SEEN | _PRINT
    out[0xC3:0xF5] |= _SEEN
    out[0xE1:0xE4] &= ~np.uint8(_SEEN)  # these may start Unicode white space
    out[9:14] |= _SPACE | _FEED
    out[32] |= _SPACE
    return out


_CLASS = _classes()


def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task; Spark has the others
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Offsets of the pieces of UTF-8 bytes, the total last. starts: offsets of the texts, the total last."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[starts] = True
    if n > 1:
        kind = _CLASS[data]
        letter = kind & _LETTER
        # U+00C0 to U+00FF but the signs of multiplication and division.
        second = data[1:]
        letter[1:] |= (data[:-1] == 0xC3) & (second != 0x97) & (second != 0xB7)
        seen = kind & _SEEN
        before = (data == 0x20)[:-1] & (seen[1:] != 0)
        inner = starts[(starts > 0) & (starts < n)]
        before[inner - 1] = False  # what follows is another text
        cut[: n - 1] |= before
        after, own = kind[:-1], kind[1:]
        closed = (seen[1:] != 0) & (after & _FEED != 0)
        closed[inner - 1] = False
        cut[1:n] |= ((letter[:-1] != 0) & (own & _OTHER != 0)) | ((own & _SPACE != 0) & (after & _PRINT != 0)) | closed
        cut[: n - 1] |= closed  # the last of a run of white space stands alone
    return np.flatnonzero(cut)


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; null is the empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, "u1"), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, "<i8" if wide else "<i4")[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    return whole[at[0] : at[-1]], at - at[0]


def distinct_pieces(texts: pa.Array, cuttable: bool = True) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(which distinct piece stands at each place, the distinct pieces, number of pieces before each text, the total last)."""
    data, starts = _flat(texts)
    if len(data) >= 1 << 31:
        raise ValueError("texts of 2 GB and more need smaller slices")
    offsets = cuts(data, starts) if cuttable else np.unique(starts)
    if len(offsets) < 2:
        return np.zeros(0, np.int32), [], np.zeros(len(texts) + 1, np.int64)
    pieces = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(data)])
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.searchsorted(offsets, starts)


def laid_out(which: np.ndarray, first: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(values of all pieces in order, number of values per text), of each distinct piece's unsigned 32-bit values."""
    if not len(which):
        return np.zeros(0, "<u4"), np.zeros(len(first) - 1, np.int64)
    flat = np.frombuffer(b"".join(texts), "<u4")
    count = np.fromiter(map(len, texts), np.int32, len(texts)) // 4
    begin = np.cumsum(count, dtype=np.int32) - count
    n = count[which]
    ends = np.cumsum(n, dtype=np.int32)
    place = np.arange(ends[-1], dtype=np.int32)
    place += np.repeat(begin[which] - (ends - n), n)
    return flat[place], np.diff(np.concatenate([[0], ends])[first])


class PieceEncoder:
    """Texts to ids. The memo of pieces is bounded; it is emptied when full."""

    def __init__(self, path: str, memo: int = 500_000):
        self.tokenizer, self.limit = load_tokenizer(path), memo
        self.memo: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.cuttable = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
            and model["type"] == "BPE" and not model.get("dropout") and all(t.get("special") for t in spec.get("added_tokens", []))
        )
        if self.cuttable:
            self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id's bytes start with a space, which byte-level vocabularies write so.
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[k for token, k in vocabulary.items() if token[:1] == "Ġ"]] = True

    def _library(self, texts: list[str]) -> Iterator[np.ndarray]:
        at, total = 0, 0
        for k, text in enumerate(texts, 1):
            total += len(text) + 16
            if total >= _AT_ONCE or k == len(texts):
                for e in self.tokenizer.encode_batch_fast(texts[at:k], add_special_tokens=False):
                    yield np.array(e.ids, "<u4")
                at, total = k, 0

    def _together(self, words: list[bytes], between: bytes) -> None:
        """Words without white space but a space before each, or a line feed between them."""
        groups, at, total = [], 0, 0
        for k, w in enumerate(words, 1):
            total += len(w) + 1
            if total >= _JOINED or k == len(words):
                groups.append(words[at:k])
                at, total = k, 0
        for group, ids in zip(groups, self._library([between.join(g).decode() for g in groups]), strict=True):
            if between:
                stops = [*np.flatnonzero(ids == self.feed).tolist(), len(ids)]
                edges = [0, *(k + 1 for k in stops[:-1])]
            else:
                edges = np.flatnonzero(self.spaced[ids]).tolist()
                stops = [*edges[1:], len(ids)]
            if len(edges) != len(group):
                raise ValueError("the ids don't tell the pieces apart")
            raw = ids.tobytes()
            self.memo.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(group, edges, stops, strict=True))

    def _learn(self, new: list[bytes]) -> None:
        if self.cuttable:
            visible = [w for w in new if _VISIBLE(w)]
            self._together([w for w in visible if w[0] == 32], b"")
            self._together([w for w in visible if w[0] != 32], b"\n")
            new = [w for w in new if w not in self.memo]
        self.memo.update(zip(new, (ids.tobytes() for ids in self._library([w.decode() for w in new])), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids per text); null is the empty text."""
        which, words, first = distinct_pieces(texts, self.cuttable)
        if len(self.memo) > self.limit:
            self.memo.clear()
        found = list(map(self.memo.get, words))
        unknown = [k for k, ids in enumerate(found) if ids is None]
        self._learn([words[k] for k in unknown])
        for k in unknown:
            found[k] = self.memo[words[k]]
        return laid_out(which, first, found)

    def encode_ending(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with one more id at the end of each text."""
        ids, lengths = self.encode(texts)
        return np.insert(ids, np.cumsum(lengths), end_id).astype("<u4", copy=False), lengths + 1


@cache
def shared_encoder(path: str) -> PieceEncoder:
    """One per worker process, so that the memo outlives a task."""
    return PieceEncoder(path)


def slices(texts: pa.Array, size: int = 6_000_000) -> Iterator[tuple[int, int]]:
    """(first, last) of slices of about so many bytes each, so that memory follows the texts and not the row count."""
    ends = _flat(texts)[1]
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        yield first, last
        first = last


def binary_column(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of ids as one binary column, without a copy. ends: where each run ends."""
    offsets = np.concatenate([[0], 4 * ends])
    if offsets[-1] < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(ids)])
    raw = ids.tobytes()
    return pa.array([raw[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)], pa.binary())

"""Whole text columns to token ids with the tokenizers library, encoding each distinct stretch of text once.

Byte-level and word-level vocabularies never merge across the place where white space begins, so a text's ids are
those of its stretches in order. A worker keeps the ids of stretches it has met, up to a bound, in numpy arrays.
A row that holds a special token's text, such as <|endoftext|>, goes whole to the library, which gives that text its
one id: all ids are those of Tokenizer.encode(text, add_special_tokens=False).
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from wayfold.llm.bytescan import LOWER_ASCII, byte_set, column_bytes, hash_spans, row_blocks, words

#: White space at which every tokenizer here ends a stretch.
_PLAIN_SPACE = byte_set((0x20, 0x20), (0x09, 0x0A), (0x0D, 0x0D))
_LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A))
_PUNCTUATION = byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
#: Distinct stretches that a worker remembers.
REMEMBERED = 2_000_000
_BLOCK = 1 << 20


Table = tuple[np.ndarray, np.ndarray, np.ndarray]


def _empty_table() -> Table:
    return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)


def _merged(left: Table, right: Table) -> Table:
    place = np.searchsorted(left[0], right[0])
    return tuple(np.insert(a, place, b) for a, b in zip(left, right, strict=True))  # type: ignore[return-value]


class StretchEncoder:
    """Encodes text columns; `keeps_space` says whether white space is part of the ids (byte-level) or dropped."""

    def __init__(self, path: str, keeps_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        #: Stretches come folded and without the rows that hold special tokens, so none may arise in them.
        self.tokenizer.encode_special_tokens = True
        #: For the rows that hold one; special tokens are matched in a text as it stands, case and all.
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        if hasattr(self.tokenizer.model, "_resize_cache"):  # each stretch comes once: its own cache only costs time
            self.tokenizer.model._resize_cache(0)
        self.keeps_space = keeps_space
        #: The word-level vocabulary has lower case only, so that A-Z and a-z are the same to it.
        self.fold = np.arange(256, dtype=np.uint8) if keeps_space else LOWER_ASCII
        vocabulary = self.tokenizer.get_vocab()
        #: Both kinds of vocabulary spell a byte as one character; a word's last token also bears "</w>".
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.token_bytes[i] = len(token.removesuffix("" if keeps_space else "</w>"))
        self._forget()

    def _forget(self) -> None:
        #: Two sorted tables of (hash, begin in ids, length): a large one, and one that new stretches join first.
        self.tables = [_empty_table(), _empty_table()]
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0

    def _stretches(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins, ends and each row's first of stretches: at the ends of white space or before it, and between an ASCII
        letter and ASCII punctuation, where these tokenizers never join what stands on both sides."""
        begins = np.zeros(len(data), dtype=bool)
        begins[1:] = _LETTER[data[:-1]] & _PUNCTUATION[data[1:]]
        if not self.keeps_space:
            first, last, _ = words(data, offsets, _PLAIN_SPACE)
            begins[first] = True
            at = np.flatnonzero(begins)
            ends = np.append(at[1:], len(data))
            word_end = last[np.searchsorted(last, at, side="right")] if len(at) else at
            return at, np.minimum(ends, word_end), np.searchsorted(at, offsets)
        space = _PLAIN_SPACE[data]
        # a stretch must not begin after white space of another kind: ASCII controls, or the last byte of a wide blank
        blank = np.zeros(len(data), dtype=bool)
        blank[2:] = (data[:-2] == 0xC2) & ((data[1:-1] == 0x85) | (data[1:-1] == 0xA0))
        blank[3:] |= (data[:-3] >= 0xE1) & (data[:-3] <= 0xE3) & ((data[1:-2] == 0x9A) | (data[1:-2] == 0x80) | (data[1:-2] == 0x81))
        begins[1:] |= space[1:] & (data[:-1] > 0x20) & ~blank[1:]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        at = np.flatnonzero(begins)
        return at, np.append(at[1:], len(data)), np.searchsorted(at, offsets)

    def _encode_each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        length = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.int32, int(length.sum())), length

    def _encode_stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of each stretch, joining those that may stand beside one another."""
        if not self.keeps_space:
            return self._encode_joined(texts)
        plain = np.fromiter((t[0] == " " and t[-1] > " " for t in texts), bool, len(texts))
        if plain.all():
            return self._encode_joined(texts)
        ids, length = zip(*(f([t for t, p in zip(texts, plain, strict=True) if p == want]) for f, want in ((self._encode_joined, True), (self._encode_each, False))), strict=True)
        sizes = np.zeros(len(texts), dtype=np.int64)
        sizes[plain], sizes[~plain] = length
        begin = np.zeros(len(texts), dtype=np.int64)
        begin[plain], begin[~plain] = np.cumsum(length[0]) - length[0], len(ids[0]) + np.cumsum(length[1]) - length[1]
        pool, upto = np.concatenate(ids), np.cumsum(sizes)
        return pool[np.repeat(begin - (upto - sizes), sizes) + np.arange(len(pool))], sizes

    def _encode_joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All stretches encoded as one text; a token's bytes say whose it is."""
        joined = ("" if self.keeps_space else "\n").join(texts)
        if self.keeps_space:
            sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
        else:
            parts = self.tokenizer.normalizer.normalize_str(joined).split(" ")
            if len(parts) != len(texts):  # other white space within a stretch
                return self._encode_each(texts)
            sizes = np.fromiter((len(t.encode()) for t in parts), np.int64, len(parts))
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.int32)
        token_ends, ends = np.cumsum(self.token_bytes[ids]), np.cumsum(sizes)
        upto = np.searchsorted(token_ends, ends, side="right")
        if len(ids) == 0 or token_ends[-1] != ends[-1] or (token_ends[upto[ends > 0] - 1] != ends[ends > 0]).any():
            return self._encode_each(texts)
        return ids, np.diff(upto, prepend=0)

    def _learn(self, data: np.ndarray, keys: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        ids, length = self._encode_stretches([raw[b:e].decode() for b, e in zip(begins.tolist(), ends.tolist(), strict=True)])
        begin = self.used + np.cumsum(length) - length
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        large, small = self.tables
        small = _merged(small, (keys, begin, length))
        if len(small[0]) > max(50_000, len(large[0]) // 8):
            large, small = _merged(large, small), _empty_table()
        self.tables = [large, small]

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of these stretches begin (-1: not met) and how many they are."""
        begin, length = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        for known, at, size in self.tables:
            if len(known):
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                met = known[place] == keys
                begin[met], length[met] = at[place[met]], size[place[met]]
        return begin, length

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins, ends, rows = self._stretches(data, offsets)
        keys = hash_spans(data, begins, ends, None if self.keeps_space else _PLAIN_SPACE)
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if sum(len(t[0]) for t in self.tables) > REMEMBERED:
            self._forget()
        at, size = self._find(distinct)
        if (new := at < 0).any():
            self._learn(data, distinct[new], begins[first[new]], ends[first[new]])
            at, size = self._find(distinct)
        length = size[which]
        upto = np.cumsum(length)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.ids[np.repeat(at[which] - (upto - length), length) + np.arange(total)]
        return ids, np.concatenate([[0], upto])[rows]

    def encode(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and where each row's ids begin (rows + 1). Null counts as empty; empty texts have no ids."""
        marked = np.zeros(len(column), dtype=bool)
        for token in self.special:
            marked |= pc.fill_null(pc.match_substring(column, token), False).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._encode_unmarked(column)
        rows = np.flatnonzero(marked)
        ids, starts = self._encode_unmarked(pc.if_else(pa.array(marked), "", column))
        found = [np.array(self.whole.encode(column[k].as_py(), add_special_tokens=False).ids, dtype=np.int32) for k in rows.tolist()]
        length = np.zeros(len(column), dtype=np.int64)
        length[rows] = [len(x) for x in found]
        # unmarked rows' ids stay in order; a marked row has none there yet
        return np.insert(ids, np.repeat(starts[rows], length[rows]), np.concatenate(found)), starts + np.concatenate([[0], np.cumsum(length)])

    def _encode_unmarked(self, column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = column_bytes(column)
        ids, starts, total = [], [np.zeros(1, dtype=np.int64)], 0
        for first, last in row_blocks(offsets, _BLOCK):
            found, begin = self._block(self.fold[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first])
            ids.append(found)
            starts.append(total + begin[1:])
            total += len(found)
        return (np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)), np.concatenate(starts)


_encoders: dict[tuple[str, bool], StretchEncoder] = {}


def encoder(path: str, keeps_space: bool) -> StretchEncoder:
    """This worker's encoder for a vocabulary file."""
    if (path, keeps_space) not in _encoders:
        _encoders[path, keeps_space] = StretchEncoder(path, keeps_space)
    return _encoders[path, keeps_space]


def vocabulary_path(name: str) -> str:
    """Where this machine has a public vocabulary file; called in tasks, since each machine has its own copy."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def with_end(ids: np.ndarray, starts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append end_id to each row's ids."""
    out = np.insert(ids, starts[1:], end_id)
    return out, starts + np.arange(len(starts))

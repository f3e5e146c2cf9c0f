"""Byte-level BPE over Arrow columns: each distinct pre-token is encoded once per worker.

Pre-tokens are found with NumPy over the bytes of many texts (character classes, then run borders); a
hash table of those already seen gives their ids, and only unseen ones go to the tokenizer library.
Prose repeats its words, so most of the work is a table lookup.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import kernel as K

DEFAULT_FILE = "byte_bpe_50k.json"

#: Code points with the White_Space property.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

OTHER, LETTER, NUMBER, BLANK, UNKNOWN = 0, 1, 2, 3, 4
#: A worker forgets its table beyond so many distinct pre-tokens, which bounds its memory.
MOST_KNOWN = 1 << 18
#: Pre-tokens that the library encodes in one call.
AT_ONCE = 4096

_classes: np.ndarray | None = None


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


#: Code points that this Python doesn't know may be letters or digits in the library's newer tables.
_CLASS = {**dict.fromkeys(("Lu", "Ll", "Lt", "Lm", "Lo"), LETTER), **dict.fromkeys(("Nd", "Nl", "No"), NUMBER), "Cn": UNKNOWN}


def _class_table() -> np.ndarray:
    global _classes
    if _classes is None:
        _classes = np.fromiter((_CLASS.get(unicodedata.category(chr(c)), OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        _classes[list(WHITE)] = BLANK
    return _classes


def _byte_classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte's character, and which bytes begin a character."""
    table = _class_table()
    lead = (data & 0xC0) != 0x80
    out = table[data]
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        b0 = padded[wide]
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        b = [padded[wide + t] & 0x3F for t in (1, 2, 3)]
        point = np.select([size == 2, size == 3], [(b0 & 0x1F) << 6 | b[0], (b0 & 0x0F) << 12 | b[0] << 6 | b[1]], (b0 & 0x07) << 18 | b[0] << 12 | b[1] << 6 | b[2])
        kind = table[np.minimum(point, 0x10FFFF)]
        for t in range(4):
            at = wide[size > t] + t
            ok = at < len(out)
            out[at[ok]] = kind[size > t][ok]
    return out, lead


def pretokens(block: K.Block, added: tuple[bytes, ...] = ()) -> np.ndarray:
    """Start of every pre-token, in order; each ends where the next or the next text begins.

    A text that holds one of ``added`` (tokens that the library looks for first) or a character of unknown
    class stays in one piece, for the library to cut.
    """
    data, n = block.data, len(block.data)
    if not n:
        return np.zeros(0, np.int64)
    kind, lead = _byte_classes(data)
    raw = data.tobytes() if added else b""
    whole = np.concatenate([np.flatnonzero(kind == UNKNOWN), *(_occurrences(raw, t) for t in added)])
    text_start = np.zeros(n + 1, bool)
    text_start[block.ptr] = True
    run = text_start[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    run_at = np.flatnonzero(run)
    run_end = np.append(run_at[1:], n)
    blank = kind[run_at] == BLANK
    # A blank run before a word: its last character stands apart, and a space joins the word.
    before = blank & ~text_start[run_end]
    leads = np.maximum.accumulate(np.where(lead, np.arange(n), 0))
    last = leads[run_end[before] - 1]
    start[last] = True
    joined = run_end[before][data[last] == 0x20]
    start[joined] = False
    # Contractions: an apostrophe that begins a pre-token takes the letters of its suffix with it.
    quote = run_at[(data[run_at] == 0x27) & (run_end - run_at == 1) & start[run_at]]
    quote = quote[(quote + 1 < n)]
    quote = quote[(kind[quote + 1] == LETTER) & ~text_start[quote + 1]]
    if len(quote):
        tail = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = tail[quote + 1], tail[quote + 2]
        pair = (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)) & ~text_start[np.minimum(quote + 2, n)]
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        size = np.where(single, 1, np.where(pair, 2, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        rest = quote + 1 + size
        start[rest[rest < n]] = True
    for d in np.unique(np.searchsorted(block.ptr, whole, "right") - 1):
        start[block.ptr[d] + 1 : block.ptr[d + 1]] = False
    return np.flatnonzero(start)


def _occurrences(raw: bytes, part: bytes) -> np.ndarray:
    found, at = [], raw.find(part)
    while at >= 0:
        found.append(at)
        at = raw.find(part, at + 1)
    return np.array(found, np.int64)


class Encoder:
    """Ids of texts under one tokenizer file; lives as long as its Python worker."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core; its threads would only cost memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = tuple(t.content.encode() for t in added.values())
        # Bytes that each id stands for: a character of a byte-level token is a byte.
        sizes = {i: len(t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()} | {i: len(t.content.encode()) for i, t in added.items()}
        self.widths = np.zeros(max(sizes, default=0) + 1, np.int64)
        self.widths[list(sizes)] = list(sizes.values())
        self.clear()

    def clear(self) -> None:
        self.slots = 1 << 16
        self.keys = np.zeros(self.slots, np.uint64)
        self.place = np.zeros(self.slots, np.int64)
        self.known = 0
        self.first = np.zeros(1 << 15, np.int64)
        self.count = np.zeros(1 << 15, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 if unknown; linear probing, all hashes at once."""
        mask = np.uint64(self.slots - 1)
        out = np.full(len(h), -1, np.int64)
        todo, slot = np.arange(len(h)), (h & mask).astype(np.int64)
        while len(todo):
            key = self.keys[slot]
            hit = key == h[todo]
            out[todo[hit]] = self.place[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def _put(self, h: np.ndarray, place: np.ndarray) -> None:
        todo, slot = np.arange(len(h)), (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            free = self.keys[slot] == 0
            _, winner = np.unique(slot[free], return_index=True)
            at = np.flatnonzero(free)[winner]
            self.keys[slot[at]], self.place[slot[at]] = h[todo[at]], place[todo[at]]
            left = np.ones(len(todo), bool)
            left[at] = False
            todo, slot = todo[left], (slot[left] + 1) & (self.slots - 1)

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and all ids; each piece is an input of its own."""
        got = [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        return np.array([len(ids) for ids in got], np.int64), np.array([x for ids in got for x in ids], np.uint32)

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_each``, but the pieces are the words of one input, which gives one result, without offsets.

        The bytes that ids stand for tell where each piece ends. Where they don't meet the pieces' ends, as under a tokenizer that changes
        or drops characters, each piece is an input.
        """
        (got,) = self.tokenizer.encode_batch_fast([pieces], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(got.ids, np.uint32)
        widths = self.widths[ids]
        reach, ends = np.concatenate([[0], np.cumsum(widths)]), np.cumsum([len(p.encode()) for p in pieces])
        at = np.minimum(np.searchsorted(reach, ends), len(ids))
        if at[-1] == len(ids) and (reach[at] == ends).all() and (widths > 0).all():
            return np.diff(at, prepend=0), ids
        return self._each(pieces)

    def _learn(self, h: np.ndarray, pieces: list[str]) -> None:
        counts, flat = (np.concatenate(x) for x in zip(*(self._encoded(pieces[i : i + AT_ONCE]) for i in range(0, len(pieces), AT_ONCE)), strict=True))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(h) > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.ids[self.used : self.used + len(flat)] = flat
        new = slice(self.known, self.known + len(h))
        self.first[new], self.count[new] = self.used + np.cumsum(counts) - counts, counts
        places = np.arange(self.known, self.known + len(h))
        self.used, self.known = self.used + len(flat), self.known + len(h)
        if self.known * 2 > self.slots:
            live = self.keys != 0
            old_keys, old_place = self.keys[live], self.place[live]
            while self.known * 2 > self.slots:
                self.slots *= 2
            self.keys, self.place = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int64)
            self._put(old_keys, old_place)
        self._put(h, places)

    def _places(self, block: K.Block) -> tuple[np.ndarray, np.ndarray]:
        """The known pre-token of each pre-token of the block, and each text's first."""
        if self.known > MOST_KNOWN:
            self.clear()
        starts = pretokens(block, self.added)
        ends = np.append(starts[1:], len(block.data))
        h = K.hashes(K.prefix(block.data), starts, ends) | np.uint64(1)
        place = self._find(h)
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            new, first = np.unique(h[unknown], return_index=True)
            raw = block.data.tobytes()
            self._learn(new, [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[unknown[first]].tolist(), ends[unknown[first]].tolist(), strict=True)])
            place[unknown] = self._find(h[unknown])
        return place, np.searchsorted(starts, block.ptr)

    def counts(self, block: K.Block) -> np.ndarray:
        """Number of ids of each text."""
        place, first = self._places(block)
        return np.diff(np.concatenate([[0], np.cumsum(self.count[place])])[first])

    def encode(self, block: K.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin."""
        place, first = self._places(block)
        n = self.count[place]
        ptr = np.concatenate([[0], np.cumsum(n)])[first]
        return self.ids[np.repeat(self.first[place], n) + K.ragged(n)], ptr


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def text_blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[K.Block, pa.RecordBatch]]:
    for block in K.blocks(batch.column(column)):
        yield block, batch.slice(block.row, len(block))

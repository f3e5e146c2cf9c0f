"""SentencePiece BPE encoding and decoding over Arrow columns.

The last token of a prefix's encoding is unique, so a table of last tokens describes the encodings of all prefixes, and the
ids of the whole are read from it backwards. The automaton of all pieces names those that end at a character; the one that
may stand there is the one whose predecessor, the last token of the prefix before it, is compatible: merging the two tokens'
characters by rank gives just these two. Time is linear in the text, whatever its words.

Texts are cut between characters that no piece has side by side, such as a letter and a space, and a worker keeps the ids of the
stretches it has seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import tokens

DEFAULT_FILE = "piece_bpe_32k.model"
#: The mark that stands for a space inside pieces.
SPACE = "▁"
#: Stretches whose ids, and pairs whose compatibility, a worker remembers.
MOST_KNOWN = MOST_PAIRS = 1 << 19
#: In a prefix table: a character that is no piece. It merges with nothing.
FOREIGN = -1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


class Model:
    """Pieces of a model file. Only what this module encodes exactly is accepted: BPE, identity normalisation, a space put before, byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        p = self.library
        n = p.get_piece_size()
        self.pieces = [p.id_to_piece(i) for i in range(n)]
        self.begin, self.end = p.bos_id(), p.eos_id()
        special = np.array([p.is_control(i) or p.is_unknown(i) for i in range(n)])
        is_byte = np.array([p.is_byte(i) for i in range(n)])
        if is_byte.sum() != 256 or any(p.is_unused(i) for i in range(n)):
            raise ValueError("a model with a piece for each byte and no unused pieces is asked for")
        self.scores = {self.pieces[i]: p.get_score(i) for i in range(n) if not special[i] and not is_byte[i]}
        self.ids = {self.pieces[i]: i for i in range(n) if not special[i] and not is_byte[i]}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in np.flatnonzero(is_byte).tolist()}
        # Bytes that stand side by side in a piece, with the space written either way.
        self.beside = np.zeros((256, 256), bool)
        for x in self.ids:
            for raw in {x.encode(), x.replace(SPACE, " ").encode()}:
                codes = np.frombuffer(raw, np.uint8)
                self.beside[codes[:-1], codes[1:]] = True
        mark = SPACE.encode()
        self.beside[0x20, mark[0]] = self.beside[mark[-1], 0x20] = self.beside[0x20, 0x20]
        # For decoding: what each id stands for, and which may lose a space at the beginning.
        surface = [b"" if p.is_control(i) else p.decode([i]).encode() if p.is_unknown(i) else bytes([int(x[3:5], 16)]) if is_byte[i] else x.replace(SPACE, " ").encode() for i, x in enumerate(self.pieces)]
        self.is_byte, self.is_control = is_byte, np.array([p.is_control(i) for i in range(n)])
        self.leads = np.array([x.startswith(SPACE) for x in self.pieces]) & ~special & ~is_byte
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.sizes = np.array([len(x) for x in surface], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes


class _Ids(NamedTuple):
    ids: list[int]


class PrefixTable:
    """Ids of a stretch of text by the table of last tokens of its prefixes."""

    def __init__(self, model: Model) -> None:
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        for piece, i in model.ids.items():
            if self.merged(piece) == [piece]:  # others never stand in an encoding
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """Characters merged pair by pair, best score first and leftmost among equals. For short texts only."""
        parts, scores = list(text), self.model.scores
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        a, b = self.model.pieces[left], self.model.pieces[right]
        return self.merged(a + b) == [a, b]

    def last_tokens(self, text: str) -> list[int]:
        """Entry i is the last token of the first i characters; entry 0 is void."""
        last, done, pairs = [FOREIGN] * (len(text) + 1), 0, self.pairs
        if len(pairs) > MOST_PAIRS:
            pairs.clear()
        for end, (token, size) in self.automaton.iter(text):  # the longest piece first among those of an end
            if end < done:
                continue
            if end > done:
                self._foreign(text[done:end])
            before = last[end + 1 - size]
            if before >= 0:
                pair = before << 32 | token
                fits = pairs.get(pair)
                if fits is None:
                    fits = pairs[pair] = self.compatible(before, token)
                if not fits:
                    continue
            done = end + 1
            last[done] = token
        self._foreign(text[done:])
        return last

    def _foreign(self, skipped: str) -> None:
        if any(c in self.model.ids for c in skipped):
            raise ArithmeticError("a prefix without a last token: the model's scores don't order its merges")

    def encode(self, text: str) -> list[int]:
        last, out, at = self.last_tokens(text), [], len(text)
        while at:
            token = last[at]
            if token == FOREIGN:
                out += [self.model.byte_ids[b] for b in reversed(text[at - 1].encode())]
                at -= 1
            else:
                out.append(token)
                at -= len(self.model.pieces[token])
        out.reverse()
        return out

    def encode_batch(self, texts: list[str], add_special_tokens: bool = False) -> list[_Ids]:
        return [_Ids(self.encode(t.replace(" ", SPACE))) for t in texts]


class Encoder(tokens.Encoder):
    """Ids of texts under one model; lives as long as its Python worker."""

    _encoded = tokens.Encoder._each

    def __init__(self, path: str) -> None:
        self.model = Model(path)
        self.tokenizer = PrefixTable(self.model)
        self.clear()
        for probe in ("", "a", "  a b", f"{SPACE}x  ", "\x00漢힤", "<s>" + " " * 40 + "1.5\n\n"):
            if self.model.library.encode(probe) != (self.encode(with_space(K.blocks(pa.array([probe])).__next__()))[0].tolist() if probe else []):
                raise ValueError("the model normalises or splits texts in a way that isn't known here")

    def starts(self, block: K.Block) -> np.ndarray:
        """Where the stretches begin: at texts, and at characters that follow no such byte in any piece."""
        begins = np.zeros(len(block.data) + 1, bool)
        begins[1:-1] = ((block.data[1:] & 0xC0) != 0x80) & ~self.model.beside[block.data[:-1], block.data[1:]]
        begins[block.ptr] = True
        return np.flatnonzero(begins[:-1])

    def _places(self, block: K.Block) -> tuple[np.ndarray, np.ndarray]:
        if self.known > MOST_KNOWN:
            self.clear()
        starts = self.starts(block)
        ends = np.append(starts[1:], len(block.data))
        h = K.hashes(K.prefix(block.data), starts, ends) | np.uint64(1)
        place = self._find(h)
        unknown = np.flatnonzero(place < 0)
        if len(unknown):
            new, first = np.unique(h[unknown], return_index=True)
            raw = block.data.tobytes()
            self._learn(new, [raw[s:e].decode() for s, e in zip(starts[unknown[first]].tolist(), ends[unknown[first]].tolist(), strict=True)])
            place[unknown] = self._find(h[unknown])
        return place, np.searchsorted(starts, block.ptr)

    def parts(self, block: K.Block) -> Iterator[K.Block]:
        """The block's texts with the space put before them; a long text comes in several parts, cut between stretches."""
        whole = with_space(block)
        if len(whole) > 1 or len(whole.data) <= 2 * K.BLOCK_BYTES:
            yield whole
            return
        starts, at = self.starts(whole), 0
        while at < len(whole.data):
            i = int(np.searchsorted(starts, at + K.BLOCK_BYTES, "right")) - 1
            stop = int(starts[i]) if starts[i] > at else int(starts[i + 1]) if i + 1 < len(starts) else len(whole.data)
            if at + K.BLOCK_BYTES >= len(whole.data):
                stop = len(whole.data)
            yield K.Block(whole.data[at:stop], np.array([0, stop - at]), block.row)
            at = stop

    def decode(self, ids: np.ndarray, ptr: np.ndarray, begin: bool = True) -> list[bytes]:
        """Texts of runs of ids, in UTF-8. The first piece of a text loses a space it begins with, if ``begin``."""
        m = self.model
        if len(ids) and int(ids.max()) >= len(m.pieces):
            raise ValueError("an id beyond the model's pieces")
        n = m.sizes[ids]
        raw = m.bytes[np.repeat(m.first[ids], n) + K.ragged(n)].tobytes()
        at = np.concatenate([[0], np.cumsum(n)])[ptr].tolist()
        control = m.is_control[ids]
        said = np.flatnonzero(~control)
        first = np.searchsorted(said, ptr[:-1])
        control[ptr[:-1][ptr[:-1] < ptr[1:]]] = control[ptr[1:][ptr[:-1] < ptr[1:]] - 1] = False
        parted = set((np.searchsorted(ptr, np.flatnonzero(control), "right") - 1).tolist())
        out = []
        for i, f in enumerate(first.tolist()):
            text = raw[at[i] : at[i + 1]]
            if begin and text and m.leads[ids[said[f]]]:
                text = text[1:]
            if i in parted or not _is_text(text):  # what no text gives: as the library replaces bytes
                own = ids[ptr[i] : ptr[i + 1]].tolist()
                text = m.library.decode(own if begin else [m.ids[SPACE], *own]).encode()
            out.append(text)
        return out


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def with_space(block: K.Block) -> K.Block:
    """The block with a space before every text that isn't empty."""
    sizes = np.diff(block.ptr)
    grown = sizes + (sizes > 0)
    ptr = np.concatenate([[0], np.cumsum(grown)])
    data = np.full(ptr[-1], 0x20, np.uint8)
    data[np.arange(len(block.data)) + np.repeat(np.cumsum(sizes > 0), sizes)] = block.data
    return K.Block(data, ptr, block.row)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row, with the begin and end ids; null texts are empty. Repeated rows and null ids stay; other columns are not read."""
    path = model or default_path()

    def run(batches):
        e = encoder(path)
        for batch in batches:
            for block, part in tokens.text_blocks(batch, "text"):
                flat, ptr = [], None
                for b in e.parts(block):
                    ids, ptr = e.encode(b)
                    flat.append(ids.astype(np.int32))
                if len(flat) > 1:
                    ptr = np.array([0, sum(map(len, flat))])
                ids, n = np.concatenate(flat), np.diff(ptr)
                full = np.empty(len(ids) + 2 * len(n), np.int32)
                stop = np.cumsum(n + 2)
                full[stop - 2 - n], full[stop - 1] = e.model.begin, e.model.end
                inner = np.ones(len(full), bool)
                inner[stop - 2 - n] = inner[stop - 1] = False
                full[inner] = ids
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), K.list_array(pa.array(full), n + 2)], ["doc_id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """``doc_id, text`` of every row of ids; null or empty lists give empty texts, null entries and ids beyond the model an error."""
    path = model or default_path()
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        e = encoder(path)
        for batch in batches:
            lists = batch.column("ids")
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("a null among ids")
            ptr = lists.offsets.to_numpy().astype(np.int64)
            texts = e.decode(flat.to_numpy(), ptr - ptr[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of what ``encode`` and then ``decode`` give, in one pass.

    A long text is encoded, decoded and digested part by part. Rows are as in ``encode``.
    """
    path = model or default_path()

    def run(batches):
        e = encoder(path)
        begin, end = (np.array([i], "<u4").tobytes() for i in (e.model.begin, e.model.end))
        for batch in batches:
            for block, part in tokens.text_blocks(batch, "text"):
                sums = [(hashlib.sha256(begin), hashlib.sha256()) for _ in range(len(block))]
                n = np.full(len(block), 2, np.int64)
                for turn, b in enumerate(e.parts(block)):
                    ids, ptr = e.encode(b)
                    raw, at = ids.astype("<u4").tobytes(), (ptr * 4).tolist()
                    for i, (text, (x, y)) in enumerate(zip(e.decode(ids, ptr, begin=not turn), sums, strict=True)):
                        x.update(raw[at[i] : at[i + 1]])
                        y.update(text)
                    n += np.diff(ptr)
                for x, _ in sums:
                    x.update(end)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array([x.hexdigest() for x, _ in sums]), pa.array([y.hexdigest() for _, y in sums])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

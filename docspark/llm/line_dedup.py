"""Line dedup by a segment-partition edit join.

A line of n characters is cut into threshold + 1 even segments; a line within the threshold keeps one of them
whole, near its old place. Segments are indexed under (length, place in the cut, content); every line
probes, for each length that it may pair with, the substrings that the multi-match-aware window allows.
Candidates are verified with banded bit-parallel edit distance, many pairs at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators.components import connected_components

from . import kernel as K
from .common import BROADCAST_ROWS, cut, in_blocks
from .ngram_join import LIST_BLOCK, _longs, _pair_batch


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each character's bytes begin (and the end of all), its bytes as one number, and each byte's character."""
    lead = (data & 0xC0) != 0x80
    if lead.all() and not (data & 0x80).any():
        places = np.arange(len(data) + 1)
        return places, data.astype(np.uint64), places
    at = np.flatnonzero(lead)
    value, end = data[at].astype(np.uint64), np.append(at[1:], len(data))
    for k in range(1, 4):
        more = np.flatnonzero(at + k < end)
        value[more] = value[more] * np.uint64(256) + data[at[more] + k]
    return np.append(at, len(data)), value, np.concatenate([[0], np.cumsum(lead)])


def _lines(block: K.Block, least: int, char_of: np.ndarray):
    """Starts, ends, text and number of the lines of at least ``least`` characters."""
    starts, ends, first = K.lines(block)
    owner = np.repeat(np.arange(len(block)), np.diff(first))
    number = np.arange(len(starts)) - first[owner]
    keep = char_of[ends] - char_of[starts] >= least
    return starts[keep], ends[keep], owner[keep], number[keep]


def line_table(docs: DataFrame, least: int) -> DataFrame:
    """``doc_id, line_no, line, n_bytes`` of every line of at least ``least`` characters; ``line`` is its hash."""

    def run(batches):
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                s, e, owner, number = _lines(block, least, characters(block.data)[2])
                ids = batch.slice(block.row, len(block)).column("doc_id").take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), _longs(K.hashes(K.prefix(block.data), s, e)), pa.array((e - s).astype(np.int32))], ["doc_id", "line_no", "line", "n_bytes"])

    return docs.mapInArrow(run, "doc_id long, line_no int, line long, n_bytes int")


def bigram_parity(value: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit map of each span: a bit tells whether an odd number of its character pairs fall on it.

    One edit takes or adds at most four pairs, so lines within ``tau`` edits differ in at most 4 ``tau`` bits.
    """
    bit = np.uint64(1) << (K.mix((value[:-1] << np.uint64(32)) + value[1:]) >> np.uint64(58))
    running = np.zeros(len(value), np.uint64)
    np.bitwise_xor.accumulate(bit, out=running[1:])
    return running[ends - 1] ^ running[starts]


def segment_keys(docs: DataFrame, least: int, tau: int) -> DataFrame:
    """``key, role, line, bits``: index segments (role 0, which also probe their own place) and probes (role 1)."""

    def key_of(h, length, i):
        return K.mix(h + length.astype(np.uint64) * K._COMBINE[50] + K._COMBINE[51 + i])

    def run(batches):
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                place, value, char_of = characters(block.data)
                s, e, _, _ = _lines(block, least, char_of)
                sums = K.prefix(block.data)
                line, at = np.unique(K.hashes(sums, s, e), return_index=True)
                if not len(line):
                    continue
                s, e = char_of[s[at]], char_of[e[at]]
                parity, n = bigram_parity(value, s, e), e - s
                keys, roles, lines, bits = [], [], [], []
                for delta in range(tau + 1):
                    length = n - delta  # of the lines to find
                    for i in range(tau + 1):
                        short, longer = length // (tau + 1), length % (tau + 1)
                        begin = i * short + np.maximum(0, i - (tau + 1 - longer))
                        size = short + (i >= tau + 1 - longer)
                        for shift in range(max(-i, delta - (tau - i)), min(i, delta + (tau - i)) + 1):
                            ok = (begin + shift >= 0) & (begin + shift + size <= n) & (length >= least)
                            p = s[ok] + begin[ok] + shift
                            keys.append(key_of(K.hashes(sums, place[p], place[p + size[ok]]), length[ok], i))
                            roles.append(np.full(len(p), 0 if delta == 0 and shift == 0 else 1, np.int8))
                            lines.append(line[ok])
                            bits.append(parity[ok])
                yield pa.RecordBatch.from_arrays([_longs(np.concatenate(keys)), pa.array(np.concatenate(roles)), _longs(np.concatenate(lines)), _longs(np.concatenate(bits))], ["key", "role", "line", "bits"])

    return docs.mapInArrow(run, "key long, role byte, line long, bits long")


def candidate_pairs(rows: DataFrame, tau: int) -> DataFrame:
    """Distinct pairs of different lines of which one indexes what the other probes, by key and by bitmap; a segment's list is compared block by block."""

    def compare(batch):
        names = ("key", "x", "y", "own", "role", "line", "bits")
        together = np.ones(len(batch) - 1, bool)
        for c in names[:3]:
            v = batch.column(c).to_numpy()
            together &= v[1:] == v[:-1]
        at = np.flatnonzero(np.append(together, False) | np.append(False, together))
        if not len(at):  # most segments stand in one line only
            return None
        columns = [batch.column(c).to_numpy()[at] for c in names]
        order = np.lexsort(columns[5::-1])
        columns = [c[order] for c in columns]
        new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns[:6]], axis=0)])
        key, x, y, own, role, line, bits = (c[new] for c in columns)
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
        live, d, found = np.arange(len(key)), 1, []
        while True:
            live = live[live + d < len(key)]
            live = live[group[live] == group[live + d]]
            if not len(live):
                break
            other = live + d
            use = ((role[live] == 0) | (role[other] == 0)) & (line[live] != line[other]) & (np.bitwise_count(bits[live] ^ bits[other]) <= 4 * tau)
            use &= (x[live] == y[live]) | (own[live] != own[other])
            if use.any():
                found.append(np.stack([line[live[use]], line[other[use]]]))
            d += 1
        if not found:
            return None
        pairs = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
        return _pair_batch(pairs[0], pairs[1])

    return in_blocks(rows, LIST_BLOCK, compare, "a long, b long").distinct()


def texts_of(docs: DataFrame, least: int, wanted: DataFrame) -> DataFrame:
    """``line, body`` once for each wanted line; few wanted ones are filtered for in the scan, many by the later join."""
    few = wanted.limit(BROADCAST_ROWS + 1).toPandas()["line"].to_numpy(np.int64)
    chosen = docs.sparkSession.sparkContext.broadcast(np.sort(few)) if len(few) <= BROADCAST_ROWS else None

    def run(batches):
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                s, e, _, _ = _lines(block, least, characters(block.data)[2])
                line, at = np.unique(K.hashes(K.prefix(block.data), s, e).view(np.int64), return_index=True)
                if chosen is not None:
                    keep = np.isin(line, chosen.value)
                    line, at = line[keep], at[keep]
                raw = block.data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(line), pa.array([raw[s[i] : e[i]] for i in at], pa.binary())], ["line", "body"])

    return docs.mapInArrow(run, "line long, body binary").dropDuplicates(["line"])


def _codes(x: bytes) -> np.ndarray:
    """The code points of UTF-8; bytes that are none stand for themselves."""
    if x.isascii():
        return np.frombuffer(x, np.uint8)
    return np.frombuffer(x.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)


def within(a: list[bytes], b: list[bytes], tau: int) -> np.ndarray:
    """Which pairs of UTF-8 texts are within ``tau`` edits of code points: banded bit-parallel columns, all pairs side by side.

    A word of 64 bits holds the vertical differences of a band that slides down the diagonal, its top bit
    ``tau`` rows below. While the band's end is above the longer text's end the distance follows the
    diagonal; afterwards it follows the last row as the band slides past it.
    """
    a, b = [_codes(x) for x in a], [_codes(x) for x in b]
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    out = np.abs(size_a - size_b) <= tau
    at = np.flatnonzero(out)
    if not len(at):
        return out
    rows = [(a[i], b[i]) if size_a[i] >= size_b[i] else (b[i], a[i]) for i in at]
    m, n = np.array([len(x) for x, _ in rows]), np.array([len(y) for _, y in rows])
    wide = int(m.max()) + 2 * tau + 2
    kind = np.int32 if any(int(z.max(initial=0)) >= 1 << 15 for row in rows for z in row if z.itemsize > 1) else np.int16
    pattern = np.full((len(rows), wide), -1, kind)  # padded by tau before and behind
    text = np.full((len(rows), int(n.max(initial=0))), -2, kind)
    for r, (x, y) in enumerate(rows):
        pattern[r, tau : tau + len(x)] = x
        text[r, : len(y)] = y
    pattern, text = np.ascontiguousarray(pattern.T), np.ascontiguousarray(text.T)
    one, ones = np.uint64(1), ~np.uint64(0)
    vp = np.full(len(rows), ones << np.uint64(63 - tau), np.uint64)
    vn = np.zeros(len(rows), np.uint64)
    far = np.full(len(rows), tau, np.int64)
    for i in range(text.shape[0]):
        match = np.zeros(len(rows), np.uint64)
        for t in range(2 * tau + 1):
            match |= (pattern[min(i + 2 * tau - t, wide - 1)] == text[i]).astype(np.uint64) << np.uint64(63 - t)
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        along = i < m - tau
        bit = np.clip(62 - (i - (m - tau)), 0, 63).astype(np.uint64)
        step = np.where(along, 1 - (d0 >> np.uint64(63)).astype(np.int64), ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64))
        far += np.where(i < n, step, 0)
        vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
    out[at] = far <= tau
    return out


def verified(pairs: DataFrame, bodies: DataFrame, tau: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.slice(lo, 2000)
                ok = pa.array(within(part.column("x").to_pylist(), part.column("y").to_pylist(), tau))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(ok), part.column("b").filter(ok)], ["a", "b"])

    x = bodies.select(F.col("line").alias("lx"), F.col("body").alias("x"))
    y = bodies.select(F.col("line").alias("ly"), F.col("body").alias("y"))
    both = pairs.join(x, F.col("a") == F.col("lx")).join(y, F.col("b") == F.col("ly")).select("a", "b", "x", "y")
    return both.mapInArrow(run, "a long, b long")


def near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 2, least: int = 1, joined: int = 10) -> DataFrame:
    """One row per line of at least ``least`` characters: ``doc_id, line_no, class_doc_id, class_line_no, n_links, kept``.

    Lines are the parts between line feeds. Different lines of at least ``joined`` characters are linked when at
    most ``tau`` edits of characters (code points) turn one into the other; shorter ones, where so many edits
    change what is said, stand by equality alone. A class is what links and equality reach, named by its first
    line (smallest id, then number), which alone is kept. ``n_links`` counts the different lines linked to this
    one. Null and empty texts and empty lines give no rows; rows that share an id count as one document; a null
    id sorts first. Other columns are not read.
    """
    joined = max(joined, least)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = cut(line_table(docs, least))
    pairs = cut(candidate_pairs(segment_keys(docs, joined, tau), tau))
    wanted = cut(pairs.select(F.col("a").alias("line")).union(pairs.select("b")).distinct())
    links = cut(verified(pairs, cut(texts_of(docs, joined, wanted)), tau))
    comps = connected_components(links, "a", "b").select(F.col("node").alias("cn"), "component")
    degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("dn")).agg(F.count(F.lit(1)).alias("n_links"))
    linked = cut(comps.join(degree, F.col("cn") == F.col("dn")).select("cn", "component", "n_links"))
    named = lines.join(linked, F.col("line") == F.col("cn"), "left").withColumn("class", F.coalesce("component", "line"))
    named = named.select("doc_id", "line_no", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    firsts = named.groupBy(F.col("class").alias("c")).agg(F.min(F.struct("doc_id", "line_no")).alias("f"))
    out = named.join(firsts, F.col("class") == F.col("c"))
    return out.select("doc_id", "line_no", F.col("f.doc_id").alias("class_doc_id"), F.col("f.line_no").alias("class_line_no"), "n_links", (F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("line_no") == F.col("f.line_no"))).alias("kept"))

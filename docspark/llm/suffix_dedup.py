"""Repeated passages by longest-previous-factor arrays over sparse suffixes.

A byte goes when a string of ``length`` bytes over it also starts earlier. Only suffixes that can have such
a match are sorted: each string of that length holds an anchor (the least gram hash of its window, a choice
that equal strings share), and only anchors whose gram occurs more than once are kept. Each kept anchor brings
the short context of its window starts; contexts meet by gram, equal ones count once, and their suffixes are
sorted whole. In suffix order, the nearest suffixes on either side that start earlier (previous and next smaller
positions) give a suffix's longest previous factor; those of ``length`` or more mark later copies, and the
first stays. Windows of grams that occur very often meet by a cryptographic digest of their bytes instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut, join_small, shuffle_width
from .ngram_join import _longs, whole_lists

GRAM = 40
#: Occurrences of a gram beyond which its windows are dealt one by one, by a 128-bit digest of their bytes.
HOT = 2000


def anchors(block: K.Block, length: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window start in order: its text, its place in the block, and its anchor's place. ``sums``: ``K.prefix`` of the block.

    An anchor is the leftmost gram of least value in the window, by the first polynomial alone: grams of equal value
    only share a place in the order.
    """
    none = np.zeros(0, np.int64)
    n, w = len(block.data), length - GRAM + 1
    if n < length:
        return none, none, none
    # Sliding minimum by doubling over values with places below them, so the left one of equal values stays.
    least, span = K.polynomial(sums, GRAM) << np.uint64(32) | np.arange(n - GRAM + 1, dtype=np.uint64), 1
    while span < w:
        step = min(span, w - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    least = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.maximum(0, np.diff(block.ptr) - length + 1)
    owner = np.repeat(np.arange(len(block)), sizes)
    start = block.ptr[owner] + K.ragged(sizes)
    return owner, start, least[start]


def _runs(owner: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])) if len(anchor) else np.zeros(0, np.int64)


def all_anchors(docs: DataFrame, length: int) -> DataFrame:
    """``key, doc, tie, at``: gram hash and place of every anchor."""

    def run(batches):
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                sums = K.prefix(block.data)
                owner, _, anchor = anchors(block, length, sums)
                first = _runs(owner, anchor)
                owner, anchor = owner[first], anchor[first]
                part, rows = batch.slice(block.row, len(block)), pa.array(owner)
                yield pa.RecordBatch.from_arrays([_longs(K.hashes(sums, anchor, anchor + GRAM)), part.column("doc").take(rows), part.column("tie").take(rows), pa.array((anchor - block.ptr[owner]).astype(np.int32))], ["key", "doc", "tie", "at"])

    return docs.select("doc", "tie", "text").mapInArrow(run, "key long, doc long, tie long, at int")


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """``doc, tie, at, hot`` of anchors whose gram occurs more than once."""

    def run(batches):
        for batch in whole_lists(batches):
            key = batch.column("key").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.repeat(np.diff(np.append(first, len(key))), np.diff(np.append(first, len(key))))
            keep = pa.array(size > 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in ("doc", "tie", "at")), pa.array(size[size > 1] > HOT)], ["doc", "tie", "at", "hot"])

    return rows.repartition(shuffle_width(rows.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "doc long, tie long, at int, hot boolean")


CONTEXT = "key long, check long, doc long, tie long, start int, context binary"
PLACES = ["key", "check", "doc", "tie", "start", "context"]


def contexts(texts: DataFrame, length: int) -> DataFrame:
    """Contexts of the kept anchors of ``doc, tie, text, at, hot`` (two arrays): from the first window start to the last window's end.

    A hot anchor gives a row per window instead, keyed by the digest of the window and without its bytes.
    """

    def digests(raw: bytes, starts: np.ndarray) -> np.ndarray:
        joined = b"".join(hashlib.blake2b(raw[a : a + length], digest_size=16).digest() for a in starts.tolist())
        return np.frombuffer(joined, np.int64).reshape(-1, 2)

    def run(batches):
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                part = batch.slice(block.row, len(block))
                sums = K.prefix(block.data)
                owner, start, anchor = anchors(block, length, sums)
                if not len(owner):
                    continue
                places, hots = part.column("at"), part.column("hot")
                counts = places.value_lengths().to_numpy()
                kept = places.flatten().to_numpy() + np.repeat(block.ptr[:-1], counts)
                flag = np.full(len(block.data), -1, np.int8)
                flag[kept] = hots.flatten().to_numpy(zero_copy_only=False)
                first = _runs(owner, anchor)
                last = np.append(first[1:], len(anchor)) - 1
                state = flag[anchor[first]]
                cold, hot = first[state == 0], np.flatnonzero(np.repeat(state == 1, last - first + 1))
                doc, tie = part.column("doc"), part.column("tie")
                begin, end = start[cold], start[last[state == 0]] + length
                raw = block.data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        _longs(K.hashes(sums, anchor[cold], anchor[cold] + GRAM)), _longs(np.zeros(len(cold), np.int64)), doc.take(pa.array(owner[cold])), tie.take(pa.array(owner[cold])),
                        pa.array((begin - block.ptr[owner[cold]]).astype(np.int32)), pa.array([raw[a:b] for a, b in zip(begin, end, strict=True)], pa.binary()),
                    ],
                    PLACES,
                )
                for lo in range(0, len(hot), 1 << 17):
                    some = hot[lo : lo + (1 << 17)]
                    digest, rows = digests(raw, start[some]), pa.array(owner[some])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(digest[:, 0]), pa.array(digest[:, 1]), doc.take(rows), tie.take(rows), pa.array((start[some] - block.ptr[owner[some]]).astype(np.int32)), pa.nulls(len(some), pa.binary())],
                        PLACES,
                    )

    return texts.mapInArrow(run, CONTEXT)


def _smaller_before(place: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix, in suffix order, and the nearest one before it of smaller place (0 if none).

    ``lcp`` is the common prefix of each suffix and the one before it. Blocks of doubling size whose places are all
    larger are stepped over, largest block first.
    """
    n = len(place)
    least, common = [place], [lcp]
    while 1 << len(least) <= n:
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][half:], least[-1][:-half]))
        common.append(np.minimum(common[-1][half:], common[-1][:-half]))
    at, low = np.arange(n), lcp.copy()  # at: all from it on are larger; low: common prefix with the one before it
    for level in range(len(least) - 1, -1, -1):
        size = 1 << level
        live = np.flatnonzero((at >= size) & (low > 0))
        from_ = at[live] - size
        over = least[level][from_] > place[live]
        live, from_ = live[over], from_[over]
        at[live] = from_
        low[live] = np.minimum(low[live], common[level][from_])
    low[at == 0] = 0
    return low


def longest_previous(suffix: np.ndarray, size: np.ndarray, group: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix within its ``group``: the longest prefix that also starts at an earlier place.

    ``suffix``: rows of big-endian words, padded with zeros beyond ``size`` bytes. In suffix order the longest one is
    shared with the nearest suffix of smaller place before or after it.
    """
    order = np.lexsort((size, *(suffix[:, c] for c in range(suffix.shape[1] - 1, -1, -1)), group))
    s, n, g, at = suffix[order], size[order], group[order], place[order]
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        apart = s[1:] ^ s[:-1]
        word = np.argmax(apart != 0, axis=1)
        first = apart[np.arange(len(apart)), word]
        byte = 8 - sum((first >> np.uint64(8 * t) != 0).astype(np.int64) for t in range(8))  # leading bytes that agree
        equal = np.where(first == 0, suffix.shape[1] * 8, word * 8 + byte)
        lcp[1:] = np.where(g[1:] == g[:-1], np.minimum(equal, np.minimum(n[1:], n[:-1])), 0)
    after = _smaller_before(at[::-1].copy(), np.append(0, lcp[:0:-1]))[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(_smaller_before(at, lcp), after)
    return out


def _repeated(h: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def removed_runs(rows: DataFrame, length: int) -> DataFrame:
    """``doc, tie, begin, end``: parts of the documents that a longest previous factor covers."""

    def run(batches):
        for batch in whole_lists(batches):
            key, check, start = (batch.column(c).to_numpy() for c in ("key", "check", "start"))
            doc = np.arange(len(batch))  # rows stand for their documents until the end
            context = batch.column("context")
            single = context.is_null().to_numpy(zero_copy_only=False)
            same_key = np.concatenate([[False], (key[1:] == key[:-1]) & (check[1:] == check[:-1])])
            later = single & same_key & np.concatenate([[False], single[:-1]])
            docs, begins, ends = [doc[later]], [start[later]], [start[later] + length]
            cold = np.flatnonzero(~single)
            if len(cold):
                data, ptr = K.buffers(context.take(pa.array(cold)))
                size = np.diff(ptr)
                group = np.cumsum(np.concatenate([[True], key[cold][1:] != key[cold][:-1]]))
                # Rows are in the order of places, so the first of equal contexts is the earliest.
                base = ptr[0]
                sums = K.prefix(data[base : ptr[-1]])
                h = K.hashes(sums, ptr[:-1] - base, ptr[1:] - base)
                _, first = np.unique(K.mix(h + group.astype(np.uint64)), return_index=True)
                new = np.zeros(len(cold), bool)
                new[first] = True
                copy = cold[~new]
                docs.append(doc[copy])
                begins.append(start[copy])
                ends.append(start[copy] + size[~new])
                at = np.flatnonzero(new)
                windows = size[at] - length + 1
                owner = np.repeat(at, windows)
                offset = K.ragged(windows)
                # A factor of ``length`` needs a second suffix of the group that begins with the same string.
                begin = ptr[owner] + offset - base
                twice = _repeated(K.mix(K.hashes(sums, begin, begin + length) + group[owner].astype(np.uint64)))
                owner, offset = owner[twice], offset[twice]
                wide = -(-int(size.max()) // 8) * 8
                view = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(wide, np.uint8)]), wide)
                cuts = [0]  # whole groups of about so many suffixes at a time
                while cuts[-1] < len(owner):
                    hi = min(len(owner), cuts[-1] + (1 << 17))
                    if hi < len(owner):
                        hi = int(np.searchsorted(group[owner], group[owner[hi - 1]], "right"))
                    cuts.append(hi)
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    o, f = owner[lo:hi], offset[lo:hi]
                    left = size[o] - f
                    words = np.where(np.arange(wide) < left[:, None], view[ptr[o] + f], 0).view(">u8").astype(np.uint64)
                    factor = longest_previous(words, left, group[o], np.arange(hi - lo))
                    gone = np.flatnonzero(factor >= length)
                    docs.append(doc[cold[o[gone]]])
                    begins.append(start[cold[o[gone]]] + f[gone])
                    ends.append(start[cold[o[gone]]] + f[gone] + factor[gone])
            d, b, e = (np.concatenate(x) for x in (docs, begins, ends))
            if len(d):
                # Overlapping parts of a document become one before they are sent on.
                owner, tie = batch.column("doc").to_numpy()[d], batch.column("tie").to_numpy()[d]
                order = np.lexsort((b, tie, owner))
                d, owner, tie, b, e = d[order], owner[order], tie[order], b[order].astype(np.int64), e[order].astype(np.int64)
                shift = np.cumsum(np.concatenate([[0], (owner[1:] != owner[:-1]) | (tie[1:] != tie[:-1])])) * (int(e.max()) + 2)
                reach = np.maximum.accumulate(e + shift)
                head = np.concatenate([[True], (b + shift)[1:] > reach[:-1]])
                tail = np.append(np.flatnonzero(head)[1:], len(d)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(owner[head]), pa.array(tie[head]), pa.array(b[head].astype(np.int32)), pa.array((reach - shift)[tail].astype(np.int32))], ["doc", "tie", "begin", "end"])

    width = shuffle_width(rows.sparkSession)
    return rows.repartition(width, "key").sortWithinPartitions("key", "check", "doc", "tie", "start").mapInArrow(run, "doc long, tie long, begin int, end int")


def _cut_out(batches):
    for batch in batches:
        kept, spans = [], []
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            raw, whole = (text or "").encode(), []
            for b, e in sorted((r["begin"], r["end"]) for r in runs or []):
                if whole and b <= whole[-1][1]:
                    whole[-1][1] = max(e, whole[-1][1])
                else:
                    whole.append([b, e])
            edges = [0, *(x for span in whole for x in span), len(raw)]
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            spans.append([{"begin": b, "end": e} for b, e in whole])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.encode()) for t in batch.column("text").to_pylist()], pa.int64()), pa.array(spans, pa.list_(SPAN)), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], ["doc_id", "n_bytes", "spans", "kept", "kept_sha256"])


SPAN = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
PASSAGES = "doc_id long, n_bytes long, spans array<struct<begin:int,end:int>>, kept binary, kept_sha256 string"


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, spans`` (maximal removed runs, in order), ``kept`` (the bytes left) and their sha-256.

    Texts are UTF-8 bytes, null counts as empty; matches never cross documents. Documents stand in the order of id, null
    last, and of their texts' digests where an id has several texts. Of texts equal as a whole the first keeps its bytes
    and the others lose all of them (if they have ``length``), without their suffixes being sorted; so one of several
    rows that are equal in id and text keeps its bytes. ``kept`` is null where all is as it was. Other columns are not
    read. A text is worked on in one task, in some 100 bytes of memory for each of its own.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumns({"doc": F.coalesce("doc_id", F.lit(2**63 - 1)), "x": F.xxhash64("text")})
    grouped = docs.select("doc_id", "doc", "x", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n")).groupBy("doc_id", "doc", "x", "sha", "n").agg(F.count(F.lit(1)).alias("rows"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("sha")) - 1
    named = grouped.filter("doc_id is not null").withColumn("tie", number.cast("long"))
    marked = cut(named.unionByName(grouped.filter("doc_id is null").withColumn("tie", F.col("x"))))
    firsts = marked.filter(F.col("n") >= length).groupBy(F.col("sha").alias("s")).agg(F.min(F.struct("doc", "tie")).alias("first"))
    judged = marked.join(firsts, F.col("sha") == F.col("s"), "left").withColumn("searched", F.coalesce(F.struct("doc", "tie") == F.col("first"), F.lit(False)))
    judged = cut(judged.select("doc_id", "doc", "tie", "x", "sha", "n", "rows", "searched"))

    long = docs.filter(F.octet_length("text") >= length)
    odd = judged.filter(F.col("n") >= length).filter("not searched or tie != 0 or rows > 1")
    odd = cut(odd.select(F.col("doc").alias("odd_doc"), F.col("x").alias("odd_x"), "tie", "searched"))
    same = (F.col("doc") == F.col("odd_doc")) & (F.col("x") == F.col("odd_x"))
    plain = join_small(long, odd.drop("tie", "searched"), same, "left_anti").withColumn("tie", F.lit(0).cast("long"))
    shared = join_small(long, odd.filter("searched"), same).dropDuplicates(["doc", "tie"])
    searched = plain.select("doc_id", "doc", "tie", "text").union(shared.select("doc_id", "doc", "tie", "text"))

    kept = repeated_anchors(all_anchors(searched, length)).groupBy(F.col("doc").alias("d"), F.col("tie").alias("t")).agg(F.collect_list(F.struct("at", "hot")).alias("a"))
    kept = cut(kept)
    there = (F.col("doc") == F.col("d")) & (F.col("tie") == F.col("t"))
    texts = searched.join(kept, there).select("doc", "tie", "text", F.col("a.at").alias("at"), F.col("a.hot").alias("hot"))
    runs = removed_runs(contexts(texts, length), length)
    runs = cut(runs.groupBy(F.col("doc").alias("d"), F.col("tie").alias("t")).agg(F.collect_list(F.struct("begin", "end")).alias("runs")))
    changed = searched.join(runs, there).select("doc_id", "text", "runs").mapInArrow(_cut_out, PASSAGES)
    spans = PASSAGES.split("spans ")[1].split(", kept")[0]
    untouched = judged.join(runs.select("d", "t"), there & F.col("searched"), "left_anti")
    whole = untouched.withColumn("here", F.when(F.col("n") < length, F.col("rows")).when(F.col("searched"), 1).otherwise(0))
    whole = whole.filter("here > 0").withColumn("r", F.explode(F.sequence(F.lit(1), F.col("here").cast("int"))))
    whole = whole.select("doc_id", F.col("n").alias("n_bytes"), F.array().cast(spans).alias("spans"), F.lit(None).cast("binary").alias("kept"), "sha")
    gone = judged.filter(F.col("n") >= length).withColumn("here", F.col("rows") - F.col("searched").cast("int"))
    gone = gone.filter("here > 0").withColumn("r", F.explode(F.sequence(F.lit(1), F.col("here").cast("int"))))
    gone = gone.select("doc_id", F.col("n").alias("n_bytes"), F.array(F.struct(F.lit(0).alias("begin"), F.col("n").cast("int").alias("end"))).cast(spans).alias("spans"), F.lit(b"").alias("kept"), F.sha2(F.lit(""), 256))
    return changed.union(whole).union(gone)


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of what ``repeated_passages`` gives."""
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return repeated_passages(docs, **options).select("doc_id", "n_bytes", length.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")

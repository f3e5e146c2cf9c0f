"""N-gram Jaccard join with token-combination prefixes, exact, returning components.

A token is a shingle hash. All tokens are counted over the corpus and fall into classes: rare ones (1), frequent
ones (2) and very frequent ones (3). A class-k token is indexed in combinations of k, so the lists of frequent
tokens stay short, and prefixes are extended by what combinations waste. Take a set's tokens in the order of
class and hash. Of a prefix with c tokens of class k in a group, a partner without a common combination of that
group lacks at least c - k + 1 of them; once these numbers sum to more than the tokens that a partner may lack,
a partner shares a combination. Frequent tokens are dealt to groups, as many as the set's size class allows
without wasting too many tokens, so a set gives combinations in proportion to its size.

Equal sets collapse to one node first, and a first round links nodes to a few of their nearest neighbours: a
large group of near copies becomes a component before tokens are counted. A second round links each node to the
nearest ones in the nearest other components of its lists, and the exact round draws pairs only between
components that are still apart: what the first round left of a group doesn't meet it in all pairs. Parity
bitmaps bound the difference of two sets from below, so most pairs that would fail are never drawn.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.components import connected_components

from . import kernel as K
from .common import cut, in_blocks, join_small, shuffle_width, whole_lists

#: Components beyond which a token leaves class 1, and class 2.
CLASS_BOUNDS = (32, 1024)
#: Frequent tokens (9 bytes each) up to which their table is broadcast; beyond it they reach the texts by a join.
BROADCAST_TOKENS = 2_000_000
GROUP = 512
#: Bits of a set's parity bitmap, and of the one that sets of over ``WIDE_ABOVE`` tokens have.
BITS, WIDE_BITS, WIDE_ABOVE = 512, 4096, 800
#: Neighbours by size that the first round looks at in a list, and those that it keeps.
LOOK, KEEP = 64, 4
#: Lists up to this length are compared row by row together; longer ones one at a time.
SHORT_LIST = 64
#: Rows of a list that are held together; longer lists are compared in blocks of so many.
LIST_BLOCK = 4096


def token_sets(block: K.Block, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; words are lower-cased in A-Z."""
    data = K.LOWER[block.data]
    starts, ends, first = K.words(block)
    h = K.hashes(K.prefix(data), starts, ends)
    tokens, owner = K.shingles(h, first, k)
    order = np.argsort(owner, kind="stable")
    ptr = np.searchsorted(owner[order], np.arange(len(block) + 1))
    tokens = tokens[order]
    return [np.unique(tokens[a:b]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]


def _longs(x) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if getattr(x, "dtype", None) == np.uint64 else np.asarray(x, np.int64))


def _parity(s: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of tokens fall on it: each token of only one set flips one bit."""
    width = WIDE_BITS if len(s) > WIDE_ABOVE else BITS
    odd = np.bincount((s % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Bitmaps:
    """Parity bitmaps of many sets; wide ones also folded to the common width."""

    def __init__(self, column: pa.Array) -> None:
        data, ptr = K.buffers(column)
        size = np.diff(ptr)
        self.wide_at = np.where(size == WIDE_BITS // 8, np.cumsum(size == WIDE_BITS // 8) - 1, -1)
        self.wide = np.concatenate([data[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True) if b - a == WIDE_BITS // 8] or [np.zeros(0, np.uint8)]).view(np.uint64).reshape(-1, WIDE_BITS // 64)
        self.common = np.zeros((len(size), BITS // 64), np.uint64)
        narrow = np.flatnonzero(size == BITS // 8)
        self.common[narrow] = data[(ptr[narrow][:, None] + np.arange(BITS // 8)).reshape(-1)].view(np.uint64).reshape(-1, BITS // 64)
        self.common[self.wide_at >= 0] = np.bitwise_xor.reduce(self.wide.reshape(-1, WIDE_BITS // BITS, BITS // 64), axis=1)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A lower bound of the number of tokens that only one of the two sets has."""
        out = np.bitwise_count(self.common[i] ^ self.common[j]).sum(1, dtype=np.int64)
        both = np.flatnonzero((self.wide_at[i] >= 0) & (self.wide_at[j] >= 0))
        if len(both):
            out[both] = np.bitwise_count(self.wide[self.wide_at[i[both]]] ^ self.wide[self.wide_at[j[both]]]).sum(1, dtype=np.int64)
        return out


def may_link(apart: np.ndarray, total: np.ndarray, percent: int) -> np.ndarray:
    """100 * both >= percent * union, where both = (total - apart) / 2 and union = (total + apart) / 2."""
    return 100 * (total - apart) >= percent * (total + apart)


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, sig, low, bits``: set size, 64-bit signature, three smallest hashes, parity bitmap."""

    def run(batches):
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                sets = token_sets(block, k)
                sig = np.array([np.bitwise_xor.reduce(K.mix(s + np.uint64(77))) if len(s) else 0 for s in sets], np.uint64)
                low = [s[:3] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.slice(block.row, len(block)).column("doc_id"), _longs([len(s) for s in sets]), _longs(sig),
                        K.list_array(_longs(np.concatenate(low)), np.array([len(x) for x in low])), pa.array([_parity(s) for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "sig", "low", "bits"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, sig long, low array<long>, bits binary")


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def nearest_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of each node and the ``KEEP`` nearest, by bitmap, of its ``LOOK`` neighbours by size in a list."""

    def run(batches):
        for batch in whole_lists(batches):
            key, node, n = (batch.column(c).to_numpy() for c in ("key", "node", "n"))
            maps, found = Bitmaps(batch.column("bits")), []
            live = np.arange(len(key))
            for d in range(1, LOOK + 1):
                live = live[live + d < len(key)]
                live = live[(key[live] == key[live + d]) & (100 * n[live] >= percent * n[live + d])]
                if not len(live):
                    break
                apart = maps.apart(live, live + d)
                ok = may_link(apart, n[live] + n[live + d], percent)
                found.append((live[ok], live[ok] + d, apart[ok]))
            if found:
                i, j, apart = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((apart, i))
                i, j = i[order], j[order]
                first = np.searchsorted(i, i)
                near = np.arange(len(i)) - first < KEEP
                yield _pair_batch(node[i[near]], node[j[near]])

    width = max(shuffle_width(rows.sparkSession), 1)
    return rows.repartition(width, "key").sortWithinPartitions("key", "n", "node").mapInArrow(run, "a long, b long").distinct()


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of document ids whose token sets reach the threshold, compared whole.

    Texts travel once per group of up to ``GROUP`` partners of one document; more partners make more groups.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("salts"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt"))
    members = cut(dealt.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("member")).union(dealt.select("a", "salt", F.lit(0), F.col("a")).distinct()))
    texts = join_small(docs, members, docs["doc_id"] == members["member"]).select("a", "salt", "role", "member", "text")

    def run(batches):
        here, centres = None, []
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                part = batch.slice(block.row, len(block))
                a, salt, role, member = (part.column(c).to_pylist() for c in ("a", "salt", "role", "member"))
                links = []
                for i, s in enumerate(token_sets(block, k)):
                    if (a[i], salt[i]) != here:
                        here, centres = (a[i], salt[i]), []
                    if role[i] == 0:
                        centres.append(s)
                        continue
                    for c in centres:
                        both = len(np.intersect1d(c, s, assume_unique=True))
                        if both and 100 * both >= percent * (len(c) + len(s) - both):
                            links.append((a[i], member[i]))
                            break
                yield pa.RecordBatch.from_arrays([_longs([x for x, _ in links]), _longs([x for _, x in links])], ["a", "b"])

    width = max(shuffle_width(docs.sparkSession), 1)
    return texts.repartition(width, "a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(run, "a long, b long")


def counted_as(s: np.ndarray) -> np.ndarray:
    """What tokens are counted by: their first 48 bits. Two tokens that share them share a class, which does no harm."""
    return s >> np.uint64(16)


def frequent_tokens(docs: DataFrame, k: int) -> DataFrame:
    """``token, kind``: tokens (as counted) of more than ``CLASS_BOUNDS[0]`` of ``docs`` and their class.

    Each task counts its own tokens and deals sorted runs, as differences, to ranges of tokens, where runs are added up.
    """
    buckets = 4 * shuffle_width(docs.sparkSession)

    def run(batches):
        def dealt(parts):
            tokens = np.concatenate(parts)
            parts.clear()
            tokens.sort()
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            counts, tokens = np.diff(np.append(first, len(tokens))), tokens[first]
            ptr = np.searchsorted((tokens * np.uint64(buckets)) >> np.uint64(48), np.arange(buckets + 1))
            counts, steps = counts.astype(np.uint32), np.diff(tokens, prepend=np.uint64(0))
            some = np.flatnonzero(np.diff(ptr))
            packed = []
            for i in some:
                step = steps[ptr[i] : ptr[i + 1]].copy()
                step[0] = 0
                packed.append(step.astype(np.uint32 if step.max() < 1 << 32 else np.uint64).tobytes())
            return pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), _longs(tokens[ptr[some]]), pa.array(packed, pa.binary()), pa.array([counts[ptr[i] : ptr[i + 1]].tobytes() for i in some], pa.binary())],
                ["bucket", "base", "steps", "counts"],
            )

        parts, held = [], 0
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                parts += [counted_as(s) for s in token_sets(block, k)]
                held += sum(map(len, parts[-len(block) :]))
                if held > 1 << 21:
                    yield dealt(parts)
                    held = 0
        if held:
            yield dealt(parts)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, counts = [], []
        for base, step, count in zip(pdf["base"], pdf["steps"], pdf["counts"], strict=True):
            counts.append(np.frombuffer(count, np.uint32))
            step = np.frombuffer(step, np.uint32 if len(step) == len(count) else np.uint64)
            tokens.append(np.uint64(base) + np.cumsum(step, dtype=np.uint64))
        tokens, counts = np.concatenate(tokens), np.concatenate(counts)
        order = np.argsort(tokens, kind="stable")
        tokens, counts = tokens[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        kind = 1 + np.searchsorted(CLASS_BOUNDS, np.add.reduceat(counts, first))
        return pd.DataFrame({"token": tokens[first][kind > 1].astype(np.int64), "kind": kind[kind > 1].astype(np.int8)})

    runs = docs.mapInArrow(run, "bucket int, base long, steps binary, counts binary")
    return cut(runs.groupBy("bucket").applyInPandas(total, "token long, kind byte"))


def with_frequent(docs: DataFrame, k: int, frequent: DataFrame) -> DataFrame:
    """``docs`` with ``often``: its frequent tokens and their classes, joined by token (a text without any has null)."""

    def tokens(batches):
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                sets = token_sets(block, k)
                ids = batch.slice(block.row, len(block)).column("doc_id").take(pa.array(np.repeat(np.arange(len(block)), [len(x) for x in sets])))
                yield pa.RecordBatch.from_arrays([ids, _longs(counted_as(np.concatenate(sets)))], ["id", "token"])

    found = docs.select("doc_id", "text").mapInArrow(tokens, "id long, token long").join(frequent, "token")
    found = cut(found.groupBy("id").agg(F.collect_set(F.struct("token", "kind")).alias("often")))  # at most a text's own tokens
    return docs.join(found, docs["doc_id"] == found["id"], "left").drop("id")


def levels(n: int, percent: int) -> list[tuple[int, int]]:
    """Size classes (binary logarithms) in which a set of ``n`` is indexed, each with 1 if it is only a guest there.

    Two sets that may link meet in the class of the smaller one, where the larger one is at most a guest.
    """
    own = n.bit_length() - 1
    return [(own, 0)] + ([(own - 1, 1)] if math.ceil(percent * n / 100) < 1 << own else [])


def combinations(s: np.ndarray, kind: np.ndarray, need: int, level: int, percent: int) -> np.ndarray:
    """Keys of the combinations of the shortest prefix of ``s`` (by class, then hash) that a partner can't miss.

    ``s`` are the tokens of classes above 1, of which a partner may lack fewer than ``need``. In small size classes, where
    groups would waste more tokens than there are to spare, the classes count as lower ones.
    """
    spare = math.ceil(percent * (1 << level) / 100) - 1
    kind = np.minimum(kind, 1 if spare < 1 else 2 if spare < 3 else 3).astype(np.int64)
    groups = np.array([1, 1, max(1, spare // 3), max(1, spare // 6)], np.uint64)
    order = np.lexsort((s, kind))
    s, kind = s[order], kind[order]
    group = (K.mix(s + np.uint64(level + 1)) % groups[kind]).astype(np.int64) * 4 + kind
    by_group = np.argsort(group, kind="stable")
    first = np.searchsorted(group[by_group], group[by_group])
    rank = np.empty(len(s), np.int64)
    rank[by_group] = np.arange(len(s)) - first
    p = int(np.searchsorted(np.cumsum(rank >= kind - 1), need)) + 1
    by_group = by_group[by_group < p]
    s, group, kind = s[by_group], group[by_group], kind[by_group]
    size = np.bincount(group).max(initial=0) if len(group) else 0
    weight, tag, out = K._COMBINE[40:43], K._COMBINE[44] * np.uint64(level + 1), []
    one = np.flatnonzero(kind == 1)
    out.append(K.mix(s[one] * weight[0] + tag))
    for d in range(1, size):
        i = np.flatnonzero((group[:-d] == group[d:]) & (kind[d:] == 2))
        out.append(K.mix(s[i] * weight[0] + s[i + d] * weight[1] + tag))
        for e in range(d + 1, size):
            i = np.flatnonzero((group[:-e] == group[e:]) & (kind[e:] == 3))
            out.append(K.mix(s[i] * weight[0] + s[i + d] * weight[1] + s[i + e] * weight[2] + tag))
    return np.concatenate(out)


def index_keys(s: np.ndarray, kind: np.ndarray, percent: int) -> list[tuple[np.ndarray, int]]:
    """Keys of a set's prefix, and 1 with those by which it is a guest: rare tokens alone, others in combinations."""
    n = len(s)
    need = n - math.ceil(percent * n / 100) + 1
    rare = np.sort(s[kind == 1])[:need]
    out = [(rare, 0)]
    if len(rare) < need:
        often = kind > 1
        out += [(combinations(s[often], kind[often], need - len(rare), level, percent), guest) for level, guest in levels(n, percent)]
    return out


def index_rows(docs: DataFrame, k: int, percent: int, frequent: DataFrame) -> DataFrame:
    """``key, comp, node, n, guest`` of every prefix key of ``docs`` (``doc_id, comp, text``)."""
    few = frequent.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS
    if few:
        table = frequent.toPandas().sort_values("token")
        shared = docs.sparkSession.sparkContext.broadcast((table["token"].to_numpy(np.uint64), table["kind"].to_numpy(np.int8)))
    else:
        docs = with_frequent(docs, k, frequent)

    def classes(s, tokens, kinds):
        if not len(tokens):
            return np.ones(len(s), np.int8)
        counted = counted_as(s)
        at = np.minimum(np.searchsorted(tokens, counted), len(tokens) - 1)
        return np.where(tokens[at] == counted, kinds[at], np.int8(1))

    def own(row):
        rows = sorted((x["token"], x["kind"]) for x in row or [])
        return np.array([t for t, _ in rows], np.uint64), np.array([c for _, c in rows], np.int8)

    def run(batches):
        for batch in batches:
            for block in K.blocks(batch.column("text")):
                part = batch.slice(block.row, len(block))
                node, comp = part.column("doc_id").to_numpy(), part.column("comp").to_numpy()
                found, owner, guest, sizes = [], [], [], []
                for i, s in enumerate(token_sets(block, k)):
                    if not len(s):
                        continue
                    tokens, kinds = shared.value if few else own(part.column("often")[i].as_py())
                    for keys, visiting in index_keys(s, classes(s, tokens, kinds), percent):
                        found.append(keys)
                        owner.append(i)
                        guest.append(visiting)
                        sizes.append(len(s))
                if not found:
                    continue
                counts = np.array([len(x) for x in found])
                owner = np.repeat(np.array(owner), counts)
                yield pa.RecordBatch.from_arrays(
                    [_longs(np.concatenate(found)), _longs(comp[owner]), _longs(node[owner]), pa.array(np.repeat(np.array(sizes, np.int32), counts)), pa.array(np.repeat(np.array(guest, np.int8), counts))],
                    ["key", "comp", "node", "n", "guest"],
                )

    return docs.mapInArrow(run, "key long, comp long, node long, n int, guest byte")


def shared_lists(rows: DataFrame) -> DataFrame:
    """Those of ``rows`` whose key is in more than one component; a long list is sorted and held by Spark, which spills."""
    key = Window.partitionBy("key")
    return rows.withColumns({"__a": F.min("comp").over(key), "__b": F.max("comp").over(key)}).filter("__a != __b").drop("__a", "__b")


def nearest_of(i: np.ndarray, j: np.ndarray, comp: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of those pairs that lead from row ``i`` to the nearest row of one of the ``KEEP`` nearest components."""
    order = np.lexsort((apart, comp[j], i))
    new = np.ones(len(order), bool)
    new[1:] = (i[order][1:] != i[order][:-1]) | (comp[j[order]][1:] != comp[j[order]][:-1])
    at = order[new]
    at = at[np.lexsort((apart[at], i[at]))]
    return at[np.arange(len(at)) - np.searchsorted(i[at], i[at]) < KEEP]


def pairs_between(rows: DataFrame, percent: int, nearest: bool = False) -> DataFrame:
    """Distinct pairs of nodes of different components that share a key and may reach the threshold.

    ``rows``: ``key, comp, node, n, guest, bits``. Sizes and bitmaps rule pairs out. Lists are compared block by block; of a
    long one only rows outside its largest component are held against the others. With ``nearest`` a row gives at most
    ``KEEP`` of its pairs in a list, so their number goes with the rows, whatever the lists' lengths.
    """

    def may(i, j, comp, n, guest, maps):
        size = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
        use = size & (comp[i] != comp[j]) & ((guest[i] == 0) | (guest[j] == 0))
        i, j = i[use], j[use]
        apart = maps.apart(i, j)
        ok = may_link(apart, n[i] + n[j], percent)
        return i[ok], j[ok], apart[ok]

    def compare(batch):
        key, comp, node, guest, x, y, own = (batch.column(c).to_numpy() for c in ("key", "comp", "node", "guest", "x", "y", "own"))
        n = batch.column("n").to_numpy().astype(np.int64)
        maps, found = Bitmaps(batch.column("bits")), []
        change = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        first = np.flatnonzero(np.concatenate([[True], change]))
        length = np.diff(np.append(first, len(key)))
        group = np.repeat(np.arange(len(first)), length)
        short = (length <= SHORT_LIST) & (x[first] == y[first])
        live = np.flatnonzero(np.repeat(short, length))
        for d in range(1, SHORT_LIST):
            live = live[live + d < len(key)]
            live = live[group[live] == group[live + d]]
            if not len(live):
                break
            found.append(may(live, live + d, comp, n, guest, maps))
        for begin, size in zip(first[~short], length[~short], strict=True):
            at = np.arange(begin, begin + size)
            values, counts = np.unique(comp[at], return_counts=True)
            main = comp[at] == values[np.argmax(counts)]
            cross = x[begin] != y[begin]  # two blocks: rows of one are held against those of the other
            for t in np.flatnonzero(~main):
                others = main | (np.arange(size) > t)
                if cross:
                    others &= own[at] != own[begin + t]
                others = at[others]
                i, j, apart = may(np.full(len(others), begin + t), others, comp, n, guest, maps)
                keep = nearest_of(i, j, comp, apart) if nearest else slice(None)
                found.append((i[keep], j[keep], apart[keep]))
        if not found:
            return None
        i, j, apart = (np.concatenate(z) for z in zip(*found, strict=True))
        if nearest:
            keep = nearest_of(i, j, comp, apart)
            i, j = i[keep], j[keep]
        pairs = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=1)
        return _pair_batch(pairs[0], pairs[1])

    return in_blocks(rows, LIST_BLOCK, compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, sig``.

    Documents are linked when 100 * shared shingles >= ``percent`` * all shingles of the two; texts of
    fewer words are one shingle of all their words. Null and empty texts are linked with nothing, and
    their component is their own id. Rows that share an id are one document with the links of each; rows
    without an id have component null. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prof = cut(profiles(docs, words))
    nodes = cut(prof.filter("n_shingles > 0 and doc_id is not null").groupBy("sig", "n_shingles").agg(F.min("doc_id").alias("node"), F.min("low").alias("low"), F.min("bits").alias("bits")))
    low = nodes.select(F.explode("low").alias("key"), "node", F.col("n_shingles").alias("n"), "bits")
    first_pairs = nearest_pairs(low, percent)
    first_links = cut(verified(docs, cut(first_pairs), words, percent))
    comps = cut(connected_components(first_links, "a", "b").withColumnRenamed("component", "comp"))

    named = prof.join(nodes.select("sig", "n_shingles", "node"), ["sig", "n_shingles"], "left")
    copies = named.filter("node is not null and doc_id != node").select("doc_id").distinct()
    special = cut(copies.select(F.col("doc_id").alias("id"), F.lit(None).cast("long").alias("comp")).union(comps.select("node", "comp")))
    reps = join_small(docs.filter("doc_id is not null"), special, docs["doc_id"] == special["id"], "left").filter("id is null or comp is not null")
    reps = reps.select("doc_id", F.coalesce("comp", "doc_id").alias("comp"), "text")
    frequent = frequent_tokens(reps.filter("doc_id = comp").select("doc_id", "text"), words)
    lists = cut(shared_lists(index_rows(reps, words, percent, frequent)))
    bits = nodes.select(F.col("node").alias("__n"), "bits")
    lists = lists.join(bits, F.col("node") == F.col("__n")).drop("__n")
    near_links = cut(verified(docs, cut(pairs_between(lists, percent, nearest=True)), words, percent))
    links = first_links.union(near_links)
    comps = cut(connected_components(links, "a", "b").select(F.col("node").alias("__n"), F.col("component").alias("__c")))
    lists = lists.join(comps, F.col("node") == F.col("__n"), "left").withColumn("comp", F.coalesce("__c", "comp")).drop("__n", "__c")
    more_links = verified(docs, cut(pairs_between(lists, percent)), words, percent)
    final = connected_components(links.union(more_links), "a", "b").withColumnRenamed("node", "__node")
    out = named.join(final, F.col("node") == F.col("__node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"), "sig")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all its columns, the document of smallest id of each component (rows without id stay)."""
    id_col = options.get("id_col", "doc_id")
    kept = near_duplicates(docs, **options).filter("component_id = doc_id").select(F.col("doc_id").alias("__kept")).distinct()
    with_id = docs.join(kept, docs[id_col].cast("long") == kept["__kept"], "left_semi")
    return with_id.unionByName(docs.filter(F.col(id_col).isNull()))

"""Collocated phrases from a weighted de Bruijn graph of the corpus.

A language's pieces (texts cut at punctuation) are walks through a graph whose nodes are the phrases one word shorter than the
longest, and whose edges are the longest phrases with their counts. Counts of shorter phrases follow from the flow through the nodes: a phrase is
followed by a word, which is an edge's weight, or ends its piece, which is counted beside. Stretches without a branch are compacted:
all phrases on them have the stretch's weight and lie in longer ones, so they never are results of their own.

Before, a filter of fixed size counts phrases of each length by cells, and a phrase ends where a longer one's cell stays under ``least``: that
one is no candidate, so no candidate's counts change, and most phrases that occur once never reach the shuffle.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut, join_small, shuffle_width

#: Cells of the pair filter and the ranges they are counted in: 16 MB as bits, broadcast whatever the corpus.
CELLS, RANGES = 1 << 27, 128
#: Words that a task holds before it passes their counts on.
HELD = 1 << 20
#: Words (8 bytes each) up to which their names are broadcast.
NAMED = 2_000_000
#: Of so many parts of the texts (the last number), those read when words are gathered first, second, and so on.
SHARES = (1, 4, 16, 64)

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[[0x20, 0x09]] = True

_STEP = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


class Words:
    """Hashes of the words of some texts in order; ``ends`` marks words that end a piece. ``raw`` gives a word's bytes."""

    def __init__(self, block: K.Block, langs: np.ndarray) -> None:
        data = K.LOWER[block.data]
        starts, ends = K.spans(~_OUTSIDE[data], block.ptr)
        self.hashes = K.hashes(K.prefix(data), starts, ends) | np.uint64(1)  # 0 stands for no word
        breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
        doc = np.searchsorted(block.ptr, starts, "right") - 1
        self.ends = np.ones(len(starts), bool)
        if len(starts):
            self.ends[:-1] = (breaks[starts[1:]] > breaks[ends[:-1]]) | (doc[1:] != doc[:-1])
        self.langs = langs[doc]
        self.data, self.starts, self.stops = data, starts, ends

    def raw(self, i: int) -> str:
        return self.data[self.starts[i] : self.stops[i]].tobytes().decode("utf-8", "replace")


def _cells(words: Words, marks: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``most`` words: the cell of the phrase that begins at each word, and whether its piece goes on so far."""
    n = len(words.hashes)
    key, inside = K.mix(words.hashes + marks[words.langs]), np.ones(n, bool)
    for k in range(1, most + 1):
        if k > 1:
            key = K.mix(key * _STEP + np.append(words.hashes[k - 1 :], np.zeros(min(k - 1, n), np.uint64)))
            inside = inside & ~np.append(words.ends[k - 2 :], np.ones(min(k - 2, n), bool))
        yield (key & np.uint64(CELLS - 1)).astype(np.uint32), inside


def _lang_hash(lang: str) -> np.uint64:
    raw = lang.encode()
    return np.uint64(zlib.crc32(raw) << 32 | zlib.adler32(raw))


def _word_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str], np.ndarray]]:
    """Words of about a quarter of a megabyte of text at a time, with the batch's languages and their hashes."""
    for batch in batches:
        coded = batch.column("lang").dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        marks = np.array([_lang_hash(x) for x in names], np.uint64)
        for block in K.blocks(batch.column("text")):
            yield Words(block, codes[block.row : block.row + len(block)]), names, marks


def frequency_filter(texts: DataFrame, most: int, least: int) -> bytes:
    """A bit for each cell that ``least`` or more occurrences of phrases of up to ``most`` words fall in.

    Tasks send the cells they saw with counts up to 255, as bytes for each range of cells; a range is added up in one array
    of fixed size. Other phrases in a cell can only raise it, so nothing frequent is lost. In a corpus that fills all cells, all
    phrases are counted in the shuffle.
    """
    share = CELLS // RANGES

    def count(batches):
        held, size = [], 0

        def flush():
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            n = np.minimum(n, 255).astype(np.uint8)
            at = np.searchsorted(cells, np.arange(RANGES + 1, dtype=np.int64) * share)
            for r in range(RANGES):
                a, b = at[r], at[r + 1]
                if a < b:
                    gaps = np.diff(cells[a:b].astype(np.int64), prepend=r * share)
                    yield r, zlib.compress(gaps.astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes() + n[a:b].tobytes(), 1), b - a

        def out(rows):
            rows = list(rows)
            return pa.RecordBatch.from_arrays([pa.array([int(r[0]) for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([int(r[2]) for r in rows], pa.int32())], ["range", "cells", "n"])

        for words, _, marks in _word_runs(batches):
            if len(words.hashes):
                held += [cells[inside] for cells, inside in _cells(words, marks, most)]
                size += most * len(words.hashes)
            if size >= 12 * HELD:
                yield out(flush())
                held, size = [], 0
        if held:
            yield out(flush())

    def add(batches):
        now, total = None, None

        def bits():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= min(least, 255)).tobytes()])], ["range", "bits"])

        for batch in batches:
            for r, raw, n in zip(batch.column("range").to_pylist(), batch.column("cells").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if r != now:
                    if now is not None:
                        yield bits()
                    now, total = r, np.zeros(share, np.uint16)
                plain = np.frombuffer(zlib.decompress(raw), np.uint8)
                gaps = np.ascontiguousarray(plain[: 4 * n].reshape(4, n).T).view("<u4").ravel()
                cells = np.cumsum(gaps.astype(np.int64))
                total[cells] = np.minimum(total[cells] + plain[4 * n :], 60_000)
        if now is not None:
            yield bits()

    parts = texts.mapInArrow(count, "range int, cells binary, n int")
    parts = parts.repartition(min(RANGES, max(shuffle_width(texts.sparkSession), 1)), "range").sortWithinPartitions("range").mapInArrow(add, "range int, bits binary")
    out = bytearray(CELLS // 8)
    for r in parts.collect():  # RANGES rows of CELLS / RANGES bits
        out[r["range"] * share // 8 : (r["range"] + 1) * share // 8] = r["bits"]
    return bytes(out)


def _rooms(words: Words, marks: np.ndarray, most: int, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """How many words a phrase from each word may have, and whether a word is in a phrase of two or more."""
    room, joined = np.zeros(len(words.hashes), np.int64), np.zeros(len(words.hashes), bool)
    for k, (cells, inside) in enumerate(_cells(words, marks, most)):
        room += (room == k) & inside & (_hot(bits, cells) if bits is not None else True)
    for i in range(most):
        joined[np.flatnonzero((room > 1) & (room > i)) + i] = True
    return room, joined


def joined_words(texts: DataFrame, most: int, filtered) -> DataFrame:
    """``hash, word`` of the words that candidates may have: those in phrases of two or more that the filter lets pass.

    A task sends each once. Texts are read in shares, each with three times the texts of those before it, and a word of an earlier
    share isn't sent again. So a word comes from the few tasks of the first share that has it, and the rows go with the
    number of words and not with that of tasks. Words beyond the first ``NAMED`` are sent by each task that has them.
    """
    spark, known, parts = texts.sparkSession, None, []

    def run(batches):
        bits, old = None if filtered is None else np.frombuffer(filtered.value, np.uint8), np.zeros(0, np.uint64) if known is None else known.value
        seen = {}
        for words, _, marks in _word_runs(batches):
            at = np.flatnonzero(_rooms(words, marks, most, bits)[1])
            some, first = np.unique(words.hashes[at], return_index=True)
            new = ~_among(old, some)[0]
            for h, i in zip(some[new].tolist(), at[first[new]].tolist(), strict=True):
                if h not in seen:
                    seen[h] = words.raw(i)
        hashes = np.fromiter(seen, np.uint64, len(seen))
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(list(seen.values()), pa.string())], ["hash", "word"])

    place = F.pmod(F.xxhash64("text"), F.lit(SHARES[-1]))
    for low, high in zip((0, *SHARES), SHARES, strict=False):
        share = texts.filter((place >= low) & (place < high)).mapInArrow(run, "hash long, word string")
        parts.append(cut(share.distinct()))
        if high < SHARES[-1]:
            known = spark.sparkContext.broadcast(_first_hashes(_union(parts), NAMED))
    return _union(parts).dropDuplicates(["hash"])


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.union, parts)


def _first_hashes(rows: DataFrame, most: int) -> np.ndarray:
    """Up to ``most`` hashes, in order."""
    return np.sort(rows.select("hash").limit(most).toPandas()["hash"].to_numpy(np.int64).view(np.uint64))


def _among(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``h`` the ordered ``table`` has, and where."""
    if not len(table):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return table[at] == h, at


def graph(texts: DataFrame, most: int, least: int) -> DataFrame:
    """``lang, h1..h<most>, word, weight``: a word gives the phrase that begins with it and ends with its piece, after ``most`` words, or before the filter rules a longer one out.

    So rows of ``most`` words are the edges, and rows of fewer (then 0) are phrases that end there. Rows of weight 0 and no language spell the words
    that candidates may have; a row of no words counts all words of the language. A word is named by its place among these, so that a
    phrase takes one number in the shuffle, and other words have no rows; where they are too many for that or for a broadcast, it is named by its hash.
    """
    filtered = texts.sparkSession.sparkContext.broadcast(frequency_filter(texts, most, least)) if least > 1 else None
    names = [f"h{i}" for i in range(1, most + 1)]
    spelled = cut(joined_words(texts, most, filtered))
    room_for, width = min(NAMED, (1 << 63 // most) - 2), 63 // most
    few = _first_hashes(spelled, room_for + 1)
    table = texts.sparkSession.sparkContext.broadcast(few) if len(few) <= room_for else None

    def named(h):
        """Places from 1 on, 0 for other words; hashes where there is no table."""
        if table is None:
            return h
        there, at = _among(table.value, h)
        return np.where(there, at.astype(np.uint64) + np.uint64(1), np.uint64(0))

    def out(lang, rows, weight):
        if table is not None:
            rows = [_packed(rows, width)]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(weight), pa.string()), *(pa.array(h.view(np.int64)) for h in rows), pa.array(weight)], ["lang", *sent, "weight"])

    def flush(held, totals):
        for lang, parts in held.items():
            yield out(lang, *_counted(np.concatenate(parts, axis=1), width if table is not None else None))
        for lang, n in totals.items():
            yield out(lang, np.zeros((most, 1), np.uint64), np.array([n]))

    def walk(batches):
        bits = None if filtered is None else np.frombuffer(filtered.value, np.uint8)
        held, totals, size = {}, {}, 0
        for words, langs, marks in _word_runs(batches):
            n = len(words.hashes)
            if not n:
                continue
            names_here, rows = named(words.hashes), np.zeros((most, n), np.uint64)
            room = np.where(names_here == 0, 0, _rooms(words, marks, most, bits)[0])
            for i in range(most):
                at = np.flatnonzero(room > i)
                rows[i, at] = names_here[at + i]
            for code in np.unique(words.langs).tolist():
                mine, lang = words.langs == code, langs[code]
                totals[lang] = totals.get(lang, 0) + int(mine.sum())
                held.setdefault(lang, []).append(rows[:, mine & (room > 0)])
            size += n
            if size >= HELD:
                yield from flush(held, totals)
                held, totals, size = {}, {}, 0
        yield from flush(held, totals)

    def spell(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(named(batch.column("hash").to_numpy().view(np.uint64)).view(np.int64)), batch.column("word")], ["h1", "word"])

    sent = names if table is None else ["phrase"]
    found = texts.mapInArrow(walk, ", ".join(["lang string", *(f"{h} long" for h in sent), "weight long"]))
    found = found.groupBy("lang", *sent).agg(F.sum("weight").alias("weight"))
    if table is not None:
        mask = F.lit((1 << width) - 1)
        found = found.select("lang", *(F.shiftright("phrase", width * (most - i)).bitwiseAND(mask).alias(h) for i, h in enumerate(names, 1)), "weight")
    none = F.lit(0).cast("long")
    words = spelled.mapInArrow(spell, "h1 long, word string").select(F.lit(None).cast("string").alias("lang"), "h1", *(none.alias(h) for h in names[1:]), "word", none.alias("weight"))
    return found.select("lang", *names, F.lit(None).cast("string").alias("word"), "weight").union(words)


def _packed(rows: np.ndarray, width: int) -> np.ndarray:
    key = np.zeros(rows.shape[1], np.uint64)
    for h in rows:
        key = (key << np.uint64(width)) | h
    return key


def _hot(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)


def _counted(rows: np.ndarray, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns and how often each is there, in the order of their first words, which compresses well in the shuffle.

    Names of ``width`` bits are sorted as one number; of hashes a key brings equals together, and columns are compared whole.
    """
    if width is None:
        key = np.zeros(rows.shape[1], np.uint64)
        for h in rows:
            key = K.mix(key * _STEP + h)
        order = np.lexsort((key, rows[0]))
    else:
        order = np.argsort(_packed(rows, width))
    rows = rows[:, order]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    return rows[:, first], np.diff(np.append(first, rows.shape[1])).astype(np.int64)


def _prefix(k: int, start: int = 1) -> list[str]:
    return [f"h{i}" for i in range(start, start + k)]


def node_flows(g: DataFrame, k: int, least: int) -> DataFrame:
    """``lang, h1..h<k>, f``: occurrences of phrases of ``k`` words, as far as they are ``least`` or more.

    A node's flow: the weights of all edges that leave it, and the phrases that end with it.
    """
    flow = g.filter(F.col(f"h{k}") != 0).groupBy("lang", *_prefix(k)).agg(F.sum("weight").alias("f"))
    return flow.filter(F.col("f") >= least)


def compact(edges: DataFrame, most: int) -> DataFrame:
    """``edges`` (``item, weight, before, after``, the flows through their first and last node) with ``path, place, path_words``.

    A node is passed without a branch if an edge that comes in and one that goes out have all its flow. Edges point to their
    predecessor over such a node and the pointers are doubled, so a stretch of n edges takes log n rounds; a round's table is
    written. Stretches begin where pieces do, so none is a ring. Edges between branches are stretches of their own and stay as they are.
    """
    inner = _prefix(most - 1)
    chained = edges.filter("weight = before or weight = after")
    come = chained.filter("weight = after").select("lang", *(F.col(f"h{i + 1}").alias(f"h{i}") for i in range(1, most)), F.col("item").alias("to"))
    go = chained.filter("weight = before").select("lang", *inner, "item")
    links = go.join(come, ["lang", *inner]).filter("item != to").select("item", "to")
    now = cut(links.withColumn("place", F.lit(1).cast("long")))  # edges without a predecessor head their stretch
    while now.limit(1).count():
        further = now.select(F.col("item").alias("to"), F.col("to").alias("next"), F.col("place").alias("more"))
        now = cut(now.join(further, "to", "left").select("item", F.coalesce("next", "to").alias("to"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("next").isNotNull().alias("moved")))
        if not now.filter("moved").limit(1).count():
            break
    lengths = now.groupBy("to").agg((F.max("place") + most).alias("path_words"))
    at = now.select("item", F.col("to").alias("path"), "place").unionByName(lengths.select(F.col("to").alias("item"), F.col("to").alias("path"), F.lit(0).cast("long").alias("place")))
    at = at.join(lengths.withColumnRenamed("to", "path"), "path")
    single = {"path": F.coalesce("path", "item"), "place": F.coalesce("place", F.lit(0).cast("long")), "path_words": F.coalesce("path_words", F.lit(most).cast("long"))}
    return edges.filter("weight != before and weight != after").withColumns({"path": F.col("item"), "place": F.lit(0).cast("long"), "path_words": F.lit(most).cast("long")}).unionByName(chained.join(at, "item", "left").withColumns(single))


def _scored(rows: DataFrame, size: int, flows: dict[int, DataFrame]) -> DataFrame:
    """Candidates of ``size`` words (``lang, h.., a``) with ``l, r, score`` of their lowest cut.

    ``before`` and ``after``, where ``rows`` have them, are the counts without the last and without the first word.
    """
    for k in range(1, size):
        known = "before" in rows.columns
        if k == size - 1 and known:
            rows = rows.withColumn(f"l{k}", F.col("before"))
        else:
            rows = _joined(rows, flows[k].withColumnRenamed("f", f"l{k}"), ["lang", *_prefix(k)], k)
        if k == 1 and known:
            rows = rows.withColumn(f"r{k}", F.col("after"))
        else:
            right = flows[size - k].select("lang", *(F.col(f"h{i}").alias(f"h{i + k}") for i in range(1, size - k + 1)), F.col("f").alias(f"r{k}"))
            rows = _joined(rows, right, ["lang", *_prefix(size - k, k + 1)], size - k)
    cuts = [F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]
    best = F.array_min(F.array(*cuts))
    return rows.select("lang", *_prefix(size), "a", "path_words", best["l"].alias("l"), best["r"].alias("r"), best["score"].alias("score"))


def _joined(rows: DataFrame, counts: DataFrame, on: list[str], words: int) -> DataFrame:
    """Words' counts are few numbers a row and far fewer than phrases, so they are broadcast as far as their number allows."""
    return join_small(rows, counts, on) if words == 1 else rows.join(counts, on)


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) in whole decimals of 38 digits; beyond them Spark raises an error."""
    big = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (big(a) * big(a)) * F.lit(1_000_000).cast("decimal(7,0)"), big(l) * big(r))


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = 3, least: int = 10, covered: int = 50, top: int = 2000
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score, path_words``: each language's ``top`` phrases of 2 to ``most`` words.

    Null and empty texts have no words; a null language is ``und``; repeated rows count each; other columns are not read; an empty table gives no
    rows. A candidate in a longer one with at least ``covered`` per cent of its occurrences is left out: only longer ones by
    one word need a look, since a phrase between the two occurs no less often. Ties of score, count and phrase can't remain.
    ``path_words`` is the number of words of the stretch without a branch that the phrase lies on (its own if shorter than ``most``).
    """
    if most < 2:
        raise ValueError("phrases have two words or more")
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    g = cut(graph(texts, most, least))
    flows = {k: cut(node_flows(g, k, least)) for k in range(1, most)}
    edges = g.filter((F.col(f"h{most}") != 0) & (F.col("weight") >= least)).select("lang", *_prefix(most), "weight")
    inner = flows[most - 1]
    edges = edges.join(inner.withColumnRenamed("f", "before"), ["lang", *_prefix(most - 1)])
    edges = edges.join(inner.select("lang", *(F.col(f"h{i}").alias(f"h{i + 1}") for i in range(1, most)), F.col("f").alias("after")), ["lang", *_prefix(most - 1, 2)])
    edges = cut(edges.withColumn("item", F.monotonically_increasing_id()))
    found = _scored(compact(edges, most).withColumnRenamed("weight", "a"), most, flows)
    for size in range(most - 1, 1, -1):
        longer = edges.select("lang", *_prefix(most), F.col("weight").alias("w")) if size == most - 1 else flows[size + 1].withColumnRenamed("f", "w")
        shifted = longer.select("lang", *(F.col(f"h{i + 1}").alias(f"h{i}") for i in range(1, size + 1)), "w")
        over = longer.select("lang", *_prefix(size), "w").unionByName(shifted).groupBy("lang", *_prefix(size)).agg(F.max("w").alias("w"))
        rows = flows[size].withColumnRenamed("f", "a").join(over, ["lang", *_prefix(size)], "left")
        rows = rows.filter(~F.coalesce(100 * F.col("w") >= covered * F.col("a"), F.lit(False))).withColumn("path_words", F.lit(size).cast("long")).drop("w")
        found = found.unionByName(_scored(rows, size, flows), allowMissingColumns=True)

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    few = cut(found.withColumn("place", F.rank().over(best)).filter(F.col("place") <= top).drop("place"))
    words = g.filter("word is not null").select("h1", "word")
    for i in range(1, most + 1):
        few = few.join(words.select(F.col("h1").alias(f"h{i}"), F.col("word").alias(f"w{i}")), f"h{i}", "left")
    few = few.withColumn("phrase", F.concat_ws(" ", *(f"w{i}" for i in range(1, most + 1))))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    totals = g.filter("h1 = 0").select("lang", F.col("weight").alias("n"))
    out = few.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).join(totals, "lang")
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "path_words")

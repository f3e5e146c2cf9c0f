"""Quality rules: counts per document and lines that recur across a host's documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import cut, join_small

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True

PROFILE = (
    "row long, doc_id long, host string, content long, n_words long, word_chars long, n_symbols long,"
    " n_dup_lines long, n_repeat_words long, line_hash array<long>, line_words array<int>"
)


def _repeats(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: is it an equal (group, key)'s second or later one; has it an equal at all."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    same = np.zeros(len(g), bool)
    same[1:] = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    any_equal = same.copy()
    any_equal[:-1] |= same[1:]
    later, equal = np.zeros(len(g), bool), np.zeros(len(g), bool)
    later[order], equal[order] = same, any_equal
    return later, equal


def _lines(block: K.Block, ws: np.ndarray, we: np.ndarray):
    """Each line's start and end, each text's first line, each line's words, and the identity of those with words.

    A line's identity across documents: its lower-cased words, whatever stands between them.
    """
    ls, le, lf = K.lines(block)
    first_word = np.searchsorted(ws, ls)
    words_in = np.searchsorted(ws, le) - first_word
    used = words_in > 0
    # Only words and one separator after each are left, so a line's bytes run from its first word to its last.
    space = K.SPACE[block.data]
    keep = ~space
    keep[1:] |= keep[:-1]
    place = np.concatenate([[0], np.cumsum(keep)])
    left = K.LOWER[block.data[keep]]
    left[space[keep]] = 0x20
    first = first_word[used]
    return ls, le, lf, words_in, K.hashes(K.prefix(left), place[ws[first]], place[we[first + words_in[used] - 1]])


def _measure(block: K.Block) -> dict[str, np.ndarray]:
    n, data = len(block), block.data
    sums = K.prefix(data)
    ws, we, wf = K.words(block)
    n_words = np.diff(wf)
    count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[block.ptr])
    word_chars = count(~K.SPACE[data] & ((data & 0xC0) != 0x80))
    doc_of_word = np.repeat(np.arange(n), n_words)
    exact = K.hashes(sums, ws, we)

    ls, le, lf, words_in, line_hash = _lines(block, ws, we)
    used = words_in > 0
    doc_of_line = np.repeat(np.arange(n), np.diff(lf))[used]
    later, _ = _repeats(doc_of_line, K.hashes(sums, ls[used], le[used]))

    covered = np.zeros(len(ws) + 1, np.int64)
    if len(ws) > 2:
        runs = K.mix(exact[:-2] * K._COMBINE[0] + exact[1:-1] * K._COMBINE[1] + exact[2:] * K._COMBINE[2])
        at = np.flatnonzero(doc_of_word[:-2] == doc_of_word[2:])
        _, equal = _repeats(doc_of_word[at], runs[at])
        hit = at[equal]
        for t in range(3):
            covered[hit + t] = 1
    repeat_words = np.diff(np.concatenate([[0], np.cumsum(covered[:-1])])[wf])
    return {
        "content": K.hashes(sums, block.ptr[:-1], block.ptr[1:]), "n_words": n_words, "word_chars": word_chars, "n_symbols": count(_SYMBOL[data]),
        "n_dup_lines": np.bincount(doc_of_line[later], minlength=n), "n_repeat_words": repeat_words,
        "lines": np.bincount(doc_of_line, minlength=n), "line_hash": line_hash, "line_words": words_in[used],
    }


def _profile(batches):
    for batch in batches:
        for block in K.blocks(batch.column("text")):
            m = _measure(block)
            part = batch.slice(block.row, len(block))
            longs = lambda x: pa.array(np.ascontiguousarray(x).astype(np.int64, copy=False))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"), part.column("doc_id"), part.column("host"), longs(m["content"].view(np.int64)),
                    *(longs(m[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                    K.list_array(longs(m["line_hash"].view(np.int64)), m["lines"]), K.list_array(pa.array(m["line_words"].astype(np.int32)), m["lines"]),
                ],
                ["row", "doc_id", "host", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hash", "line_words"],
            )


def quality_verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    line_min_docs: int = 8,
    min_left_percent: int = 30,
) -> DataFrame:
    """One row per input row: counts, ``base_failed``, ``removed_words`` and ``kept``.

    A line (its words in lower case) is boilerplate on a host when it stands in more than
    ``line_min_docs`` of the host's documents, however many it has; documents of equal
    text count once, so a group of copies cannot make its own lines boilerplate. A document is depleted,
    and not kept, when boilerplate lines hold so many of its words that under ``min_left_percent`` % are
    left. A null host is a host of its own; null or empty texts have no words and fail the base rule.
    ``row`` tells repeated rows apart; other columns are not read.
    """
    profile, found = _found(docs, id_col, text_col, host_col, line_min_docs)
    return _verdicts(profile, found, min_words, max_repeat_percent, min_left_percent)


def _found(docs: DataFrame, id_col: str, text_col: str, host_col: str, line_min_docs: int) -> tuple[DataFrame, DataFrame]:
    """The profile of every row, and the boilerplate lines in it."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), _host(host_col).alias("host"), F.col(text_col).alias("text"))
    profile = cut(rows.mapInArrow(_profile, PROFILE))
    entries = profile.select("row", "host", "content", F.explode(F.arrays_zip("line_hash", "line_words")).alias("e")).select("row", "host", "content", F.col("e.line_hash").alias("line"), F.col("e.line_words").alias("words"))
    distinct = entries.select("host", "line", "content").distinct()
    boilerplate = distinct.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > line_min_docs)
    boilerplate = cut(boilerplate.select(F.col("host").alias("__bh"), F.col("line").alias("__bl")))
    there = (F.col("host") == F.col("__bh")) & (F.col("line") == F.col("__bl"))
    return profile, join_small(entries, boilerplate, there, "left_semi")


def _host(host_col: str):
    return F.coalesce(F.col(host_col).cast("string"), F.lit("\0"))


def _verdicts(profile: DataFrame, found: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, min_left_percent: int = 30) -> DataFrame:
    removed = found.groupBy(F.col("row").alias("r")).agg(F.sum("words").alias("removed_words"))
    base_failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    left_words = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    depleted = left_words * 100 < F.col("n_words") * min_left_percent
    return profile.join(removed, F.col("row") == F.col("r"), "left").select(
        "row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), F.coalesce("removed_words", F.lit(0)).alias("removed_words"), (~base_failed & ~depleted).alias("kept"),
    )


def keep_good(docs: DataFrame, **rules) -> DataFrame:
    """``docs`` with all its columns, without the documents that ``quality_verdicts`` rejects.

    Decisions go by id: of rows that share an id each is kept if one of them is.
    """
    id_col = rules.get("id_col", "doc_id")
    kept = quality_verdicts(docs, **rules).filter("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["__kept"]), "left_semi")


def _keyed(text_col: str, names: list[str]):
    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            content = np.concatenate([K.hashes(K.prefix(b.data), b.ptr[:-1], b.ptr[1:]) for b in K.blocks(batch.column(text_col))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(content.view(np.int64))], [*names, "__content"])

    return run


def _rebuilt(text_col: str, names: list[str]):
    def run(batches):
        for batch in batches:
            texts, gone = batch.column(text_col), batch.column("__gone")
            changed = []
            for block in K.blocks(texts) if gone.null_count < len(batch) else ():
                part = gone.slice(block.row, len(block))
                ws, we, _ = K.words(block)
                ls, le, lf, words_in, line_hash = _lines(block, ws, we)
                identity = np.zeros(len(ls), np.uint64)
                identity[words_in > 0] = line_hash
                for d in np.flatnonzero(part.is_valid().to_numpy(zero_copy_only=False)):
                    at = np.arange(lf[d], lf[d + 1])
                    keep = at[(words_in[at] == 0) | ~np.isin(identity[at].view(np.int64), part[d].values.to_numpy())]
                    changed.append("\n".join(block.data[ls[i] : le[i]].tobytes().decode("utf-8", "replace") for i in keep))
            if changed:
                texts = pc.replace_with_mask(texts, gone.is_valid(), pa.array(changed, texts.type))
            yield pa.RecordBatch.from_arrays([texts if n == text_col else batch.column(n) for n in names], names)

    return run


def keep_clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_min_docs: int = 8, **limits) -> DataFrame:
    """What ``keep_good`` keeps, with all its columns, and its texts without their host's boilerplate lines.

    The other lines, those without words among them, keep their order and bytes; a text without boilerplate is
    not touched. Only the text changes, not what other columns say of it.
    """
    profile, found = _found(docs, id_col, text_col, host_col, line_min_docs)
    found = cut(found)
    kept = _verdicts(profile, found, **limits).filter("kept").select(F.col("doc_id").alias("__kept")).distinct()
    gone = cut(found.groupBy(F.col("host").alias("__h"), F.col("content").alias("__c")).agg(F.collect_set("line").alias("__gone")))
    good = docs.join(kept, docs[id_col].cast("long").eqNullSafe(kept["__kept"]), "left_semi")
    key = T.StructType([*docs.schema.fields, T.StructField("__content", T.LongType())])
    keyed = good.mapInArrow(_keyed(text_col, docs.columns), key)
    marked = keyed.join(gone, (_host(host_col) == F.col("__h")) & (F.col("__content") == F.col("__c")), "left").select(*docs.columns, "__gone")
    return marked.mapInArrow(_rebuilt(text_col, docs.columns), docs.schema)

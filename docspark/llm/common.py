"""What the operators of this subpackage share: reading and size-checked joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.storage import cut

__all__ = ["WORD", "cut", "in_blocks", "join_small", "read", "shuffle_width", "whole_lists"]

#: Java and RE2 pattern of a word: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a narrow table up to which it is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_small(wide: DataFrame, narrow: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join a table of texts to a written table of a few numbers a row, by broadcast if it has few rows.

    The count decides only how the join runs; beyond it both sides are shuffled.
    """
    few = narrow.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return wide.join(F.broadcast(narrow) if few else narrow, on, how)


def whole_lists(batches, names: tuple[str, ...] = ("key",)):
    """Batches sorted by ``names``, dealt anew so that the rows of equal ones fall in one batch."""
    held = []

    def change(batch):
        out = np.zeros(len(batch), bool)
        for n in names:
            v = batch.column(n).to_numpy()
            out[1:] |= v[1:] != v[:-1]
        return out

    def same(x, y):
        return all(x.column(n)[len(x) - 1].as_py() == y.column(n)[0].as_py() for n in names)

    for batch in batches:
        if not len(batch):
            continue
        if held and not same(held[-1], batch):
            yield _joined(held)
            held = []
        starts = np.flatnonzero(change(batch))
        if len(starts):
            held.append(batch.slice(0, int(starts[-1])))
            yield _joined(held)
            held = [batch.slice(int(starts[-1]))]
        else:
            held.append(batch)
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def bounded_lists(batches, limit: int):
    """Batches sorted by ``key`` as batches of whole lists of up to ``limit`` rows, with None, and rows of longer ones, with each row's block of ``limit``.

    No more than a list of ``limit`` rows is held from one batch to the next.
    """
    held, last, gone = None, None, 0  # ``gone`` rows of the long list ``last`` were passed on
    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            batch = _joined([held, batch])
        key = batch.column("key").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(first, len(key)))
        gone = gone if key[0] == last else 0
        seen = length + np.where(first == 0, gone, 0)
        long = seen > limit
        if long.any():
            ready = ~long
            ready[-1] = False
            if ready.any():
                yield batch.filter(pa.array(np.repeat(ready, length))), None
            for i in np.flatnonzero(long):
                yield batch.slice(int(first[i]), int(length[i])), (np.arange(length[i]) + seen[i] - length[i]) // limit
        elif len(first) > 1:
            yield batch.slice(0, int(first[-1])), None
        held, last, gone = (None, key[-1], seen[-1]) if long[-1] else (batch.slice(int(first[-1])), None, 0)
    if held is not None:
        yield held, None


def in_blocks(rows: DataFrame, limit: int, compare, schema: str) -> DataFrame:
    """``compare`` (a batch of whole lists to a batch of ``schema`` or None) over ``rows`` dealt by ``key, x, y``, so that any two rows of a key meet.

    A key's rows are cut into blocks of ``limit``; a row of block k goes to (k, j) or (j, k) for every block j, the smaller number
    first, and ``own`` is its block. So a task holds at most two blocks of a key. A key of one block has (0, 0) alone: it is compared
    where its rows first meet, in the pass that numbers the blocks of longer ones and passes their rows on.
    """
    width = max(shuffle_width(rows.sparkSession), 1)
    names, made = rows.columns, [part.split()[0] for part in schema.split(", ")]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def first(batches):
        for batch, block in bounded_lists(batches, limit):
            n = len(batch)
            if block is None:
                zero = pa.array(np.zeros(n, np.int32))
                out = compare(pa.RecordBatch.from_arrays([*batch.columns, zero, zero, zero], [*names, "own", "x", "y"]))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([*out.columns, *(pa.nulls(len(out), t) for t in batch.schema.types), pa.nulls(len(out), pa.int32())], [*made, *names, "own"])
            else:
                yield pa.RecordBatch.from_arrays([*(pa.nulls(n, pa.int64()) for _ in made), *batch.columns, pa.array(block.astype(np.int32))], [*made, *names, "own"])

    def again(batches):
        for batch in whole_lists(batches, ("key", "x", "y")):
            out = compare(batch)
            if out is not None:
                yield out

    both = cut(rows.repartition(width, "key").sortWithinPartitions("key").mapInArrow(first, f"{schema}, {types}, own int"))
    long = both.filter("own is not null").select(*names, "own")
    blocks = long.groupBy(F.col("key").alias("__key")).agg(F.max("own").alias("__last"))
    long = long.join(blocks, F.col("key") == F.col("__key")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("__last"))))
    long = long.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("__key", "__last", "other")
    long = long.repartition(width, "key", "x", "y").sortWithinPartitions("key", "x", "y", "own")
    return both.filter("own is null").select(*made).union(long.mapInArrow(again, schema))

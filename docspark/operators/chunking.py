"""Cutting node texts into chunks by estimated tokens, and choosing diverse candidates; vectorised helpers in tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A chunk may end behind one of these.
BOUNDARIES = "\n\r。！？；.!?;"


def weights(text: str) -> np.ndarray:
    """Quarter tokens of each character: white space 0, ASCII letters and digits 1, others 4."""
    if not text:
        return np.zeros(0, np.int64)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = code < 128
    alnum = small & (((code >= 48) & (code <= 57)) | ((code >= 65) & (code <= 90)) | ((code >= 97) & (code <= 122)))
    space = np.isin(code, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
    return np.where(space, 0, np.where(alnum, 1, 4)).astype(np.int64)


def cut(text: str, target: int = 384, most: int = 480, overlap: int = 64) -> list[str]:
    """Pieces of at most ``most`` tokens, cut at the first boundary from ``target`` on, ``overlap`` tokens repeated."""
    upto = np.concatenate([[0], np.cumsum(weights(text))])
    n, start, out = len(text), 0, []
    if upto[-1] <= most * 4:
        return [text.strip()] if text.strip() else []
    ends = np.array([m.end() for m in re.finditer(f"[{re.escape(BOUNDARIES)}]", text)], np.int64)
    while start < n:
        hard = int(np.searchsorted(upto, upto[start] + most * 4, "right")) - 1
        stop = n if hard >= n else max(hard, start + 1)
        if stop < n:
            least = int(np.searchsorted(upto, upto[start] + target * 4, "left"))
            at = int(np.searchsorted(ends, max(least, start + 1), "left"))
            if at < len(ends) and ends[at] <= stop:
                stop = int(ends[at])
        piece = text[start:stop].strip()
        if piece:
            out.append(piece)
        if stop >= n:
            break
        start = max(start + 1, int(np.searchsorted(upto, upto[stop] - overlap * 4, "left")))
    return out


def chunk_nodes(nodes: DataFrame, target: int = 384, most: int = 480, overlap: int = 64) -> DataFrame:
    """``revision_id, node_id, ordinal, text``: pieces of each node's text (its table data if it has no text).

    Ordinals run on through the nodes of a revision. Empty and null texts give no chunk. Each text is cut in the
    task that reads it; only the ordinals need the rows of a revision together.
    """

    @F.pandas_udf("array<string>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: cut(t, target, most, overlap) if t else [])

    text = F.coalesce("text", "table_data") if "table_data" in nodes.columns else F.col("text")
    made = nodes.select("revision_id", "node_id", F.col("ordinal").alias("node_ordinal"), F.posexplode(pieces(text)).alias("piece", "text"))
    order = Window.partitionBy("revision_id").orderBy("node_ordinal", "node_id", "piece")
    return made.select("revision_id", "node_id", F.row_number().over(order).alias("ordinal"), "text")


def cap_tokens(text: Column, n: int) -> Column:
    """The longest prefix of at most ``n`` estimated tokens."""

    @F.pandas_udf("string")
    def head(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: t and t[: int(np.searchsorted(np.cumsum(weights(t)), n * 4, "right"))])

    return head(text)


def mmr_select(candidates: DataFrame, limit: int, words: int = 256) -> DataFrame:
    """``query_id, chunk_id, place``: a greedy choice of relevant and different candidates.

    The ``limit`` * 3 best by ``fused`` are weighed: .78 of the share of the best score, less .22 of the largest
    likeness to those chosen (Jaccard of the first ``words`` tokens, .2 at least within a file). Ties go by chunk id.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("fused"), "chunk_id")
    top = candidates.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= limit * 3).select("query_id", "file_id", "chunk_id", "fused", "text")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["fused", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
        sets = [set(re.findall(r"[^\W_]+", (t or "").lower())[:words]) for t in rows.text]
        gain = 0.78 * (rows.fused / max(rows.fused.max(), 1e-12)).to_numpy()
        worst, free, chosen = np.zeros(len(rows)), list(range(len(rows))), []
        while free and len(chosen) < limit:
            pick = max(free, key=lambda i: (round(gain[i] - 0.22 * worst[i], 12), -i))
            free.remove(pick)
            chosen.append(pick)
            for i in free:
                union = len(sets[i] | sets[pick])
                like = len(sets[i] & sets[pick]) / union if union else 0.0
                worst[i] = max(worst[i], like, 0.2 if rows.file_id[i] == rows.file_id[pick] else 0.0)
        return pd.DataFrame({"query_id": rows.query_id[chosen], "chunk_id": rows.chunk_id[chosen], "place": range(1, len(chosen) + 1)})

    types = dict(candidates.dtypes)
    return top.groupBy("query_id").applyInPandas(choose, f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, place int")

"""The supplied tables as the library's tables, in Spark and, for the oracles, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.sources.files import read_table


def files(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as files: source as root, language as extension."""
    d = read_table(spark, sf, "documents")
    name = F.concat(F.lit("Doc "), (F.col("doc_id") % 211).cast("string"), F.when(F.col("doc_id") % 3 == 0, " copy").when(F.col("doc_id") % 3 == 1, "_v2").otherwise(""), F.lit("."), F.col("lang"))
    folder = F.when(F.col("doc_id") % 17 == 0, "Node_Modules").when(F.col("doc_id") % 19 == 0, "tmp_cache").otherwise("docs")
    return d.select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("root_id"), name.alias("display_name"), F.col("lang").alias("extension"),
        F.concat(F.lit("\\\\?\\C:\\"), "source", F.lit("/"), folder, F.lit("\\"), name).alias("canonical_path"), F.col("n_chars").alias("size_bytes"),
        F.sha2("text", 256).alias("content_sha256"), F.when(F.col("doc_id") % 23 == 0, "failed").when(F.col("doc_id") % 11 == 0, "waiting").otherwise("parsed").alias("parse_status"),
        F.lit("present").alias("availability"), "text",
    )


FILES = r"""
files AS (
  SELECT doc_id AS file_id, source AS root_id, name AS display_name, lang AS extension,
         '\\?\C:\' || source || '/' || (CASE WHEN doc_id % 17 = 0 THEN 'Node_Modules' WHEN doc_id % 19 = 0 THEN 'tmp_cache' ELSE 'docs' END) || '\' || name AS canonical_path,
         n_chars AS size_bytes, sha256(text) AS content_sha256,
         CASE WHEN doc_id % 23 = 0 THEN 'failed' WHEN doc_id % 11 = 0 THEN 'waiting' ELSE 'parsed' END AS parse_status, 'present' AS availability, text
  FROM (SELECT *, 'Doc ' || (doc_id % 211) || (CASE WHEN doc_id % 3 = 0 THEN ' copy' WHEN doc_id % 3 = 1 THEN '_v2' ELSE '' END) || '.' || lang AS name FROM documents)
)
"""
KEY = r"regexp_replace(regexp_replace(lower(replace(canonical_path, '/', '\')), '^\\\\\?\\', ''), '\\+$', '')"


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the documents as chunks; ``chunk_id`` joins file and ordinal."""
    from docspark.operators.lexical import text_lines_to_nodes

    n = text_lines_to_nodes(read_table(spark, sf, "documents"))
    return n.select(F.concat_ws("-", "doc_id", "ordinal").alias("chunk_id"), F.col("doc_id").alias("file_id"), "ordinal", "text")


CHUNKS = r"""
chunks AS (
  SELECT doc_id || '-' || ordinal AS chunk_id, doc_id AS file_id, ordinal, text FROM (
    SELECT doc_id, i AS ordinal, regexp_replace(l[i], '^\s+|\s+$', '', 'g') AS text
    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\n|\r') AS l FROM documents))
  ) WHERE text != ''
)
"""


def hits(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` as ranked hits of four channels for a few hundred queries."""
    from pyspark.sql import Window

    li, channel = read_table(spark, sf, "lineitem"), ((F.col("l_linenumber") - 1) % 4 + 1).cast("int")
    reason = F.element_at(F.array(*map(F.lit, ("filename", "path", "semantic", "fulltext"))), channel)
    h = li.select((F.col("l_orderkey") % 500).alias("query_id"), channel.alias("channel"), (F.col("l_suppkey") % 40).alias("file_id"), F.col("l_partkey").alias("chunk_id"), reason.alias("reason"), F.round(F.col("l_discount") * 10, 6).alias("score"))
    h = h.groupBy("query_id", "channel", "file_id", "chunk_id", "reason").agg(F.max("score").alias("score"))
    return h.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "channel").orderBy(F.desc("score"), "file_id", "chunk_id")))


HITS = """
hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, file_id, chunk_id) AS place FROM (
    SELECT l_orderkey % 500 AS query_id, ((l_linenumber - 1) % 4 + 1)::INT AS channel, l_suppkey % 40 AS file_id, l_partkey AS chunk_id,
           ['filename', 'path', 'semantic', 'fulltext'][((l_linenumber - 1) % 4 + 1)::INT] AS reason, max(round(l_discount * 10, 6)) AS score
    FROM lineitem GROUP BY ALL)
)
"""


def fs_events(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as file events: user as root, milliseconds for minutes so that bursts form."""
    kind = F.create_map(*[F.lit(x) for x in ("click", "created", "view", "modified", "purchase", "renamed", "error", "removed", "signup", "modified")])
    return read_table(spark, sf, "events").select(
        F.concat(F.lit("r"), (F.col("user_id") % 20).cast("string")).alias("root_id"), kind[F.col("event_type")].alias("event_type"),
        F.get_json_object("props", "$.k").alias("path"), F.timestamp_millis(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 6000000)).alias("ts"), "event_id",
    )


EVENTS = """
fs AS (
  SELECT 'r' || (user_id % 20) AS root_id, CASE event_type WHEN 'click' THEN 'created' WHEN 'purchase' THEN 'renamed' WHEN 'error' THEN 'removed' ELSE 'modified' END AS event_type,
         json_extract_string(props, '$.k') AS path, make_timestamp_ms(epoch_us(ts) // 6000000) AS ts, event_id FROM events
)
"""

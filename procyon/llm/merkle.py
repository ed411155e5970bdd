"""WARC fixity audit: records and ordered offset ranges hashed into trees, replicas compared root first.

Records (file_id, rec_offset, rec_length, digest) of a replica become tree nodes: level 0 hashes the records that start
in one range of `span` bytes, in the order of their offsets; a node of level k + 1 hashes `fanout` neighbouring nodes;
the root hashes what the top level holds. The audit joins the roots of two replicas, then goes down one level at a time
into children of nodes that differ, so that only mismatching branches are read, and ends with the differing records.
Groups are bounded: a range holds at most `span` bytes of record starts, a node `fanout` children.

Edge cases: a null url or html is empty in the record; a null page_id is a record in a file of its own hash; records
that repeat an offset are all hashed, in the order of their digests; a record that one replica lacks is `missing`, one
that only the other has is `extra`; equal or two empty replicas give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import save

PER_FILE, SPAN, FANOUT, LEVELS = 1000, 1 << 16, 16, 3


def warc_record(url: Column, body: Column) -> Column:
    """A response record with its header block."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(page_id, file_id, rec_offset, rec_length, digest, url, html): pages as records laid end to end in files by page_id."""
    record = warc_record(F.col("url"), F.col("html"))
    spread = F.coalesce(F.floor(F.col("page_id") / per_file), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 20)))
    rows = pages.select("page_id", spread.alias("file_id"), F.octet_length(record).cast("bigint").alias("rec_length"), F.sha2(record, 256).alias("digest"))
    order = W.partitionBy("file_id").orderBy("page_id", "digest").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("rec_offset", F.coalesce(F.sum("rec_length").over(order), F.lit(0)))


def tree(records: DataFrame, span: int = SPAN, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(level, file_id, node, hash) of all nodes of a replica's trees; the roots have level `levels` and node 0."""
    leaf = F.concat_ws(":", "rec_offset", "rec_length", "digest")
    node = records.groupBy("file_id", F.floor(F.col("rec_offset") / span).alias("node")).agg(F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rec_offset", leaf.alias("leaf")))), lambda x: x["leaf"])), 256).alias("hash"))
    out = node = node.select(F.lit(0).alias("level"), "file_id", "node", "hash")
    for level in range(1, levels + 1):
        parent = F.lit(0).cast("bigint") if level == levels else F.floor(F.col("node") / fanout)
        kids = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: F.concat_ws("=", x["node"], x["hash"]))
        node = node.groupBy("file_id", parent.alias("parent")).agg(F.sha2(F.concat_ws(",", kids), 256).alias("hash")).select(F.lit(level).alias("level"), "file_id", F.col("parent").alias("node"), "hash")
        out = out.union(node)
    return out


def audit(good: DataFrame, other: DataFrame, span: int = SPAN, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(page_id, file_id, rec_offset, rec_length, status) of the records that differ: changed, missing or extra in `other`."""
    good, other = save(good), save(other)
    nodes = [save(tree(t, span, fanout, levels)) for t in (good, other)]
    bad = None
    for level in range(levels, -1, -1):
        a, b = (n.where(F.col("level") == level).select("file_id", "node", F.col("hash").alias(h)) for n, h in zip(nodes, ("x", "y"), strict=True))
        if bad is not None:
            up = F.lit(0).cast("bigint") if level + 1 == levels else F.floor(F.col("node") / fanout)
            a, b = (t.withColumn("parent", up).join(bad.withColumnRenamed("node", "parent"), ["file_id", "parent"], "left_semi").drop("parent") for t in (a, b))
        bad = a.join(b, ["file_id", "node"], "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("file_id", "node")
    bad = save(bad)
    a, b = (t.withColumn("node", F.floor(F.col("rec_offset") / span)).join(bad, ["file_id", "node"], "left_semi").drop("node") for t in (good, other))
    a, b = a.select("file_id", "rec_offset", F.struct("page_id", "rec_length", "digest").alias("a")), b.select("file_id", "rec_offset", F.struct("page_id", "rec_length", "digest").alias("b"))
    both = a.join(b, ["file_id", "rec_offset"], "full").where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return both.select(F.coalesce("a.page_id", "b.page_id").alias("page_id"), "file_id", "rec_offset", F.coalesce("a.rec_length", "b.rec_length").alias("rec_length"), status.alias("status"))

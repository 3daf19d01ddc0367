"""WARC records with Merkle fixity: two replicas are compared by their trees, from the root down.

Records are serialised where their pages are read. What is shuffled is their metadata alone (id, address, length
and SHA-256 of the record): it deals records to segments, puts them in order, and gives them their offsets. Records
hash to leaves, over their place as well as their bytes; each ``fanout`` consecutive leaves or nodes of a segment,
an ordered range of offsets, hash to a node, up to the segment's root, and the segments' roots to the replica's. The
audit compares the replicas' roots and stops if they are equal; if not, it goes from the segments' roots down and
joins only the children of nodes that differ.

Defined cases: null columns are written as empty; empty and very long bodies are records like others; repeated pages
give records of their own, whose order among each other doesn't matter as they are equal; an empty table
gives one empty tree; further columns, of whatever names, are left alone; a record that one replica lacks is reported missing.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.llm.common import stored

FANOUT = 32
#: At least so many segments; more where they would be larger than so many bytes of page texts on average.
SEGMENTS, SEGMENT_BYTES = 256, 128 << 20


def record(page_id: Column, url: Column, body: Column) -> Column:
    """The bytes of a WARC 1.1 resource record."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), text(page_id),
        F.lit(">\r\nWARC-Target-URI: "), text(url),
        F.lit("\r\nContent-Type: text/html\r\nWARC-Block-Digest: sha256:"), F.sha2(F.encode(text(body), "utf-8"), 256),
        F.lit("\r\nContent-Length: "), F.octet_length(text(body)).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.encode(F.concat(head, text(body), F.lit("\r\n\r\n")), "utf-8")


def number_of(*columns: str) -> Column:
    """A 32-bit number from columns' values, by a hash that SQL engines share."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns).cast("binary")), 1, 8), 16, 10).cast("long")


def records(pages: DataFrame) -> DataFrame:
    """page_id, url and record of each page; nothing is shuffled."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))


def metadata(rows: DataFrame, copy: Column | None = None) -> DataFrame:
    """page_id, url, length and digest of records; with ``copy``, another replica's bytes, also copy_length and copy_digest."""
    digest = lambda c: F.sha2(c, 256)
    own = [F.octet_length("record").cast("long").alias("length"), digest(F.col("record")).alias("digest")]
    more = [] if copy is None else [F.octet_length(copy).cast("long").alias("copy_length"), digest(copy).alias("copy_digest")]
    return rows.select("page_id", "url", *own, *more)


def segments_for(pages: DataFrame) -> int:
    return max(SEGMENTS, (pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0) // SEGMENT_BYTES)


def placed(rows: DataFrame, name: str, segments: int = SEGMENTS) -> DataFrame:
    """Adds segment, seq and offset to records' metadata, stored. The record's digest decides with its id, so that no page fills a segment with its versions."""
    w = W.partitionBy("segment").orderBy("page_id", "url", "length", "digest")
    out = rows.withColumn("segment", (number_of("page_id", "url", "digest") % segments).cast("int"))
    before = F.coalesce(F.sum("length").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return stored(out.withColumns({"seq": F.row_number().over(w).cast("long") - 1, "offset": before}), name)


def parse(rows: DataFrame) -> DataFrame:
    """page_id, url, html, digest_ok of serialised records."""
    text = F.decode("record", "utf-8")
    head, at = F.split_part(text, F.lit("\r\n\r\n"), F.lit(1)), F.instr(text, "\r\n\r\n")
    html = F.substring(text, at + 4, F.length(text) - at - 7)
    field = lambda name: F.regexp_extract(head, rf"(?m)^{name}: (.*)\r?$", 1)
    out = rows.select(F.regexp_extract(head, "<urn:page:([^>]*)>", 1).alias("page_id"), field("WARC-Target-URI").alias("url"), html.alias("html"), field("WARC-Block-Digest").alias("_digest"))
    return out.withColumn("digest_ok", F.col("_digest") == F.concat(F.lit("sha256:"), F.sha2(F.encode("html", "utf-8"), 256))).drop("_digest")


def leaves(replica: DataFrame, length: str = "length", digest: str = "digest") -> DataFrame:
    """level 0 of the tree: a hash per record, over its place as well as its bytes."""
    place = F.concat_ws(":", "seq", "offset", length, digest)
    return replica.select("segment", F.lit(0).alias("level"), F.col("seq").alias("node"), F.sha2(place.cast("binary"), 256).alias("hash"), "offset", (F.col("offset") + F.col(length)).alias("end"))


def tree(leaf: DataFrame, name: str, fanout: int = FANOUT) -> DataFrame:
    """All nodes (segment, level, node, hash, offset, end) over leaves, stored by level. A node's group has ``fanout`` children at most."""
    levels = [stored(leaf, f"{name}-0")]
    most = levels[0].agg(F.max("node")).first()[0] or 0
    while most:
        below = levels[-1]
        children = F.sort_array(F.collect_list(F.struct("node", "hash")))
        up = below.groupBy("segment", F.lit(len(levels)).alias("level"), F.floor(F.col("node") / fanout).alias("node")).agg(children.alias("c"), F.min("offset").alias("offset"), F.max("end").alias("end"))
        levels.append(stored(up.select("segment", "level", "node", F.sha2(F.array_join("c.hash", ",").cast("binary"), 256).alias("hash"), "offset", "end"), f"{name}-{len(levels)}"))
        most //= fanout
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def top_level(nodes: DataFrame) -> int:
    return nodes.agg(F.max("level")).first()[0] or 0


def root(nodes: DataFrame, fanout: int = FANOUT) -> str:
    """The replica's root: a tree over the roots of its segments, so that no task has more than ``fanout`` of them. Empty for a tree without nodes."""
    level = nodes.filter(F.col("level") == top_level(nodes)).select(F.col("segment").cast("long").alias("node"), "hash")
    most = level.agg(F.max("node")).first()[0] or 0
    while most:
        children = F.sort_array(F.collect_list(F.struct("node", "hash")))
        up = level.groupBy(F.floor(F.col("node") / fanout).alias("node")).agg(children.alias("c"))
        both = F.transform("c", lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"]))
        level = up.select("node", F.sha2(F.array_join(both, ",").cast("binary"), 256).alias("hash"))
        most //= fanout
    found = level.first()
    return found["hash"] if found else ""


def audit(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """segment, seq and state (changed, missing_a, missing_b) of the records on which two trees differ.

    The replicas' roots come first: if they are equal, nothing else is compared. Level by level from the
    segments' roots, only the children of differing nodes are compared; equal branches are never read further
    than their top hash.
    """
    empty = a.limit(0).select("segment", F.col("node").alias("seq"), F.lit("").alias("state"))
    top = max(top_level(t) for t in (a, b))
    if root(a, fanout) == root(b, fanout):
        return empty
    suspects = None
    for level in range(top, -1, -1):
        pick = lambda t: t.filter(F.col("level") == level).select("segment", "node", "hash")  # noqa: E731, B023
        x, y = pick(a), pick(b)
        if suspects is not None:
            up = F.floor(F.col("node") / fanout)
            parent = suspects.select("segment", F.col("node").alias("_up"))
            x, y = (t.withColumn("_up", up).join(parent, ["segment", "_up"], "left_semi").drop("_up") for t in (x, y))
        both = x.withColumnRenamed("hash", "hash_a").join(y.withColumnRenamed("hash", "hash_b"), ["segment", "node"], "full")
        suspects = stored(both.filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))), f"audit-{level}")
    state = F.when(F.col("hash_a").isNull(), "missing_a").when(F.col("hash_b").isNull(), "missing_b").otherwise("changed")
    return suspects.select("segment", F.col("node").alias("seq"), state.alias("state"))

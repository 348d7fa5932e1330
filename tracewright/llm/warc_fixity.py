"""Merkle fixity audit of WARC files.

Pages become WARC/1.1 resource records; a file's records stand one behind the other, so each has an offset. A
leaf is the hash of the gap before a record, its length and the SHA-256 over its bytes, so that leaves fix all
offsets; ``fanout`` neighbours in offset order make a node (the hash of the bytes it spans and its children's
hashes), and so on to a root per file. To compare replicas, roots are joined first, and of each level only the
children of nodes that differ are joined next, down to the records at fault.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import materialize, table

FANOUT = 8
RECORDS_A_FILE = 512  # a file's records are ordered in one task


def record_bytes(page_id: Column, url: Column, payload: Column) -> Column:
    """The whole record: header block, payload, two line ends. Null url and payload count as empty."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    ).cast("binary")
    return F.concat(head, body, F.lit("\r\n\r\n").cast("binary"))


def _number(text: Column) -> Column:
    """32 bits of a hash that other engines have too."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def replicas(pages: DataFrame, payloads: list[Column], files: int) -> list[DataFrame]:
    """For each payload a replica, (file, no, offset, length, page_id, digest) of the records of all pages.

    The first payload is the archive's: pages are dealt to ``files`` files by a hash of id, url and its
    record, and stand in a file by id (null first), then url, then the hash of its record, from offset 0; the other
    replicas keep this order. Repeated rows are records of their own: they are counted before they are shuffled, and every
    RECORDS_A_FILE copies of a row are dealt by a hash of their own, so that no file gets all copies. Null ids, urls and payloads count as empty.
    """
    made = [record_bytes(F.col("page_id"), F.col("url"), p) for p in payloads]
    hashed = [F.struct(F.octet_length(m).cast("long").alias("length"), F.sha2(m, 256).alias("digest")) for m in made]
    rows = pages.select("page_id", "url", *[h.alias(f"r{k}") for k, h in enumerate(hashed)])
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    rows = rows.withColumn("lot", F.explode(F.sequence(F.lit(0), F.expr(f"cast((copies - 1) div {RECORDS_A_FILE} as int)"))))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(RECORDS_A_FILE), F.col("copies") - F.col("lot") * RECORDS_A_FILE)))).drop("copies", "copy")
    lot = F.when(F.col("lot") > 0, F.col("lot").cast("string"))  # skipped where null
    text = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), "r0.digest", lot)
    order = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first(), "r0.digest")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("file", F.pmod(_number(text), F.lit(files)).cast("int")).withColumn("no", (F.row_number().over(order) - 1).cast("long"))
    rows = materialize(rows.withColumns({f"o{k}": F.coalesce(F.sum(f"r{k}.length").over(upto), F.lit(0)) for k in range(len(payloads))}))
    return [rows.select("file", "no", F.col(f"o{k}").alias("offset"), f"r{k}.length", "page_id", f"r{k}.digest") for k in range(len(payloads))]


def records(pages: DataFrame, files: int) -> DataFrame:
    """The records of one replica, see ``replicas``."""
    return replicas(pages, [F.col("html")], files)[0]


def tree(leaves: DataFrame, height: int, fanout: int = FANOUT) -> list[DataFrame]:
    """(file, no, span, digest) of the nodes of each level, from (file, no, offset, length, digest) leaves at level 0 up
    to ``height``. A leaf's hash is that of gap, length and the record's digest, where the gap is what lies
    between the end of the record before it (the file's start) and its offset; a node's is that of its span, the gaps and
    lengths below it, and of its children's hex hashes in order. Each level is written by itself."""
    bound = lambda *c: F.sha2(F.concat_ws("|", *c), 256).alias("digest")
    end = F.lag(F.col("offset") + F.col("length")).over(Window.partitionBy("file").orderBy("no"))
    placed = leaves.withColumn("gap", F.col("offset") - F.coalesce(end, F.lit(0)))
    levels = [materialize(placed.select("file", "no", (F.col("gap") + F.col("length")).alias("span"), bound("gap", "length", "digest")))]
    for _ in range(height):
        up = levels[-1].groupBy("file", F.floor(F.col("no") / fanout).alias("no")).agg(F.sum("span").alias("span"), F.array_sort(F.collect_list(F.struct("no", "digest"))).alias("c"))
        levels.append(materialize(up.select("file", "no", "span", bound("span", F.array_join("c.digest", "")))))
    return levels


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(file, no, offset, length, page_id, digest, replica_digest, fault) of the records at which two
    replicas of the files differ, given the (file, no, offset, length, page_id, digest) of each.

    fault is ``changed`` (its bytes), ``moved`` (equal bytes behind another gap; records behind it
    that keep their own gap aren't at fault), or ``missing`` or ``added`` where only one replica has that record number. A file
    that one replica lacks has all its records at fault. Equal replicas, and empty ones, give no row.
    """
    most = max((r[0] or 0) for r in left.agg(F.max("no")).union(right.agg(F.max("no"))).collect())
    height = 1
    while fanout**height < most + 1:
        height += 1
    suspects = None
    for x, y in zip(*(reversed(tree(t, height, fanout)) for t in (left, right))):  # roots first
        x, y = x.select("file", "no", F.col("digest").alias("l")), y.select("file", "no", F.col("digest").alias("r"))
        if suspects is not None:  # only the children of nodes that differ
            up = suspects.select("file", F.col("no").alias("up"))
            x, y = (t.withColumn("up", F.floor(F.col("no") / fanout)).join(up, ["file", "up"], "left_semi").drop("up") for t in (x, y))
        suspects = materialize(x.join(y, ["file", "no"], "full_outer").where("not (l <=> r)"))
    at = left.select("file", "no", "offset", "length", "page_id", "digest")
    other = right.select("file", "no", F.col("offset").alias("o"), F.col("length").alias("n"), F.col("page_id").alias("p"), F.col("digest").alias("replica_digest"))
    full = suspects.join(at, ["file", "no"], "left").join(other, ["file", "no"], "left")
    same = F.col("digest").eqNullSafe(F.col("replica_digest"))
    fault = F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "added").when(same, "moved").otherwise("changed")
    gone = F.col("l").isNull()
    return full.select("file", "no", F.when(gone, F.col("o")).otherwise(F.col("offset")).alias("offset"), F.when(gone, F.col("n")).otherwise(F.col("length")).alias("length"), F.when(gone, F.col("p")).otherwise(F.col("page_id")).alias("page_id"), "digest", "replica_digest", fault.alias("fault"))


def damaged_payload() -> Column:
    """The payload with planted damage: on every 50th page by a hash of its id one character is another one (an
    empty payload gets one)."""
    hit = _number(F.coalesce(F.col("page_id").cast("string"), F.lit(""))) % 50 == 7
    half = F.expr("cast(length(html) div 2 as int)")
    flipped = F.concat(F.substring("html", 1, half), F.lit("~"), F.expr("substring(html, cast(length(html) div 2 as int) + 2)"))
    return F.when(hit, F.coalesce(flipped, F.lit("~"))).otherwise(F.col("html"))


def op2_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of ``pages`` in one replica against a replica with damage planted in every 50th.

    Null ids, urls and texts count as empty, an empty table gives no row; equal rows are records of their own, see
    ``replicas``.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    files = max(1, math.ceil(pages.count() / RECORDS_A_FILE))
    return audit(*replicas(pages, [F.col("html"), damaged_payload()], files))


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, html, ('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 8))::BIGINT AS hd,
    greatest(1, CAST(ceil((SELECT count(*) FROM pages) / 512.0) AS BIGINT)) AS files FROM pages
), b AS (
  SELECT *, CASE WHEN hd % 50 = 7 THEN coalesce(substr(html, 1, length(html) // 2) || '~' || substr(html, length(html) // 2 + 2), '~') ELSE html END AS html2 FROM p
), r AS (
  SELECT page_id, url, files,
    'WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:' AS h0, coalesce(html, '') AS x, coalesce(html2, '') AS y FROM b
), t AS (
  SELECT page_id, url, files,
    replace(h0, '\r\n', chr(13) || chr(10)) || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head, x, y, chr(13) || chr(10) || chr(13) || chr(10) AS e FROM r
), d AS (
  SELECT page_id, url, files, head || strlen(x) || e || x || e AS rx, head || strlen(y) || e || y || e AS ry FROM t
), f AS (
  SELECT *, CAST(('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|' || sha256(rx) || CASE WHEN lot > 0 THEN '|' || lot ELSE '' END), 1, 8))::BIGINT % files AS INTEGER) AS file
  FROM (SELECT *, (row_number() OVER (PARTITION BY page_id, url, rx) - 1) // 512 AS lot FROM d)
), o AS (
  SELECT file, row_number() OVER w - 1 AS no, CAST(coalesce(sum(strlen(rx)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
    CAST(strlen(rx) AS BIGINT) AS length, page_id, sha256(rx) AS digest, sha256(ry) AS replica_digest
  FROM f WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS FIRST, url NULLS FIRST, sha256(rx))
)
SELECT *, 'changed' AS fault FROM o WHERE digest <> replica_digest
"""

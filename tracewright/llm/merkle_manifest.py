"""A Merkle manifest of a table: a tree of row hashes for each group, a tree over the groups' roots, and proofs.

Leaves are dealt by ranges of (group, order) to indexed partitions, of which each knows the number its first leaf has in its
group. A partition runs over its leaves once with a stack of peaks, as a mountain range: a leaf is pushed, and as long as
the last ``fanout`` nodes of a level complete a parent, they are carried into it, like digits in base ``fanout``. A node
whose parent reaches beyond the partition is an edge peak. Edge peaks are merged in blocks of ever more leaves, each block
in a task, until each group has its root; there the last run of a level may be short: it is hashed as it is, without padding.

A node's record is (g, level, no, digest); no counts the nodes of its level from the left. Proofs go down by chunks of
at most ``CHUNK_LEAVES`` nodes: a chunk meets the path from its top to the root, and each of its nodes gets its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import materialize, quoted, releasing, ship, table, written

FANOUT = 2
ROWS_IN_PARTITION = 100_000
MOST_PARTITIONS = 4_096  # whatever the table: the driver holds a few values for each
CHUNK_LEAVES = 1 << 12
MERGED_LEAVES = 1 << 20  # of the first blocks in which edge peaks are merged; each round's blocks hold 1,024 of the round before
FLUSH = 20_000


def node_hash(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def record_hash(columns: list[Column]) -> Column:
    """SHA-256 (lowercase hex) of the values one behind the other: ``-`` for a null, else the number of UTF-8 bytes, ``:`` and the value."""
    said = []
    for c in columns:
        text = c.cast("string")
        said.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*said), 256)


class Peaks:
    """The stack of one group's nodes inside a partition that starts at leaf ``start``."""

    def __init__(self, start: int, fanout: int):
        self.fanout, self.next = fanout, start
        self.levels: list[list[tuple[int, str]]] = []  # of each level the nodes whose parent isn't full

    def push(self, digest: str) -> Iterator[tuple[int, int, str, bool]]:
        """Add a leaf; (level, no, digest, edge) of the nodes that are done with."""
        level, no = 0, self.next
        self.next += 1
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            own = self.levels[level]
            own.append((no, digest))
            if (no + 1) % self.fanout:
                return
            whole = len(own) == self.fanout  # else the run began in an earlier partition
            for n, d in own:
                yield level, n, d, not whole
            up = node_hash([d for _, d in own]) if whole else ""
            own.clear()
            if not whole:
                return
            level, no, digest = level + 1, no // self.fanout, up

    def close(self) -> Iterator[tuple[int, int, str, bool]]:
        for level, own in enumerate(self.levels):
            for n, d in own:
                yield level, n, d, True


def merge(nodes: list[tuple[int, int, str]], count: int, fanout: int, height: int) -> Iterator[tuple[int, int, str, bool]]:
    """Of edge nodes (level, no, digest) of a group of ``count`` leaves: they and their parents up to level ``height``, each with
    whether its own parent is still to be made."""
    levels: dict[int, dict[int, str]] = {}
    for level, no, digest in nodes:
        levels.setdefault(level, {})[no] = digest
    level = 0
    while levels:
        own, width, runs = levels.pop(level, {}), -(-count // fanout**level), {}
        for no in sorted(own):
            runs.setdefault(no // fanout, []).append(no)
        for up, children in runs.items():
            whole = width > 1 and level < height and len(children) == min(fanout, width - up * fanout)
            if whole:
                levels.setdefault(level + 1, {})[up] = node_hash([own[c] for c in children])
            for c in children:
                yield level, c, own[c], not whole
        level += 1


def chunk_paths(digests: list[str], width: int, fanout: int, levels: int) -> list[str]:
    """For neighbouring nodes from a multiple of fanout ** levels on, of a level of ``width`` nodes: the path of each up to
    ``levels`` levels higher or the root. A level is ``place:digests;``, the place in the run and the run's other nodes."""
    paths, own, at = [[] for _ in digests], digests, list(range(len(digests)))
    for _ in range(levels):
        if width == 1:
            break
        for path, i in zip(paths, at):
            run = i - i % fanout
            path.append(f"{i - run}:{''.join(own[run:i] + own[i + 1 : run + fanout])};")
        own = [node_hash(own[k : k + fanout]) for k in range(0, len(own), fanout)]
        at = [i // fanout for i in at]
        width = -(-width // fanout)
    return ["".join(p) for p in paths]


def siblings(path: Column) -> Column:
    """The digests of a path, level by level."""
    return F.regexp_replace(path, "[0-9]+:|;", "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""

    def step(digest: Column, level: Column) -> Column:
        rest = F.substring_index(level, ":", -1)
        at = F.substring_index(level, ":", 1).cast("int") * 64
        return F.sha2(F.concat(F.substring(rest, F.lit(1), at), digest, F.substring(rest, at + 1, F.length(rest))), 256)

    return F.aggregate(F.filter(F.split(path, ";"), lambda s: s != ""), leaf, step)


def _starts(dealt: DataFrame) -> dict[int, int]:
    """By partition the number of its first leaf in its group: what earlier partitions hold of that group."""
    part = F.col("part")
    ends = dealt.groupBy("part").agg(F.min("g").alias("first"), F.max("g").alias("last"))
    counts = dealt.groupBy("part", "g").agg(F.count("*").alias("n")).join(ends, "part").where("g = first or g = last")
    at = lambda end: F.max(F.when(F.col("g") == F.col(end), F.col("n"))).alias(f"n_{end}")
    found = counts.groupBy("part").agg(F.min("first").alias("first"), F.max("last").alias("last"), at("first"), at("last")).orderBy(part)
    starts, group, upto = {}, None, 0
    for r in found.collect():  # a row for each partition, MOST_PARTITIONS at most
        starts[r["part"]] = upto if r["first"] == group else 0
        upto = starts[r["part"]] + r["n_first"] if r["first"] == r["last"] else r["n_last"]
        group = r["last"]
    return starts


def tree(leaves: DataFrame, order: list[str], fanout: int = FANOUT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From leaves (g, digest, others), g not null: the leaves with ``no``, their number in their group by ``order``
    (nulls first), then digest; (g, level, no, digest) of all nodes above leaves, and of single leaves; (g, count, height)."""
    spark = leaves.sparkSession
    fixed = written(leaves.withColumn("tie", F.monotonically_increasing_id()))  # equal rows spread, and ranges agree when a task runs again
    parts = min(MOST_PARTITIONS, max(1, math.ceil(fixed.count() / ROWS_IN_PARTITION)))
    keys = ["g", *order, "digest", "tie"]
    dealt = materialize(fixed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("tie").withColumn("part", F.spark_partition_id()))
    starts = _starts(dealt)
    carried = [f for f in dealt.schema.fields if f.name not in ("g", "digest", "part")]
    schema = T.StructType([*dealt.select("g", "digest").schema.fields, *carried, *T._parse_datatype_string("level int, no bigint, edge boolean, kind string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stack, nodes = None, None, []

        def told(types: dict[str, pa.DataType]) -> pa.RecordBatch:
            column = lambda k, t: pa.array([r[k] for r in nodes], t)
            made = [column(0, pa.string()), column(3, pa.string()), *[pa.nulls(len(nodes), types[f.name]) for f in carried], column(1, pa.int32()), column(2, pa.int64()), column(4, pa.bool_()), pa.array(["node"] * len(nodes))]
            nodes.clear()
            return pa.RecordBatch.from_arrays(made, names=schema.names)

        types = {}
        for b in batches:
            types = {n: b.schema.field(n).type for n in b.schema.names}
            first = len(types) and stack is None
            numbers = []
            for g, digest in zip(b.column("g").to_pylist(), b.column("digest").to_pylist()):
                if g != group:
                    if stack is not None:
                        nodes.extend((group, *n) for n in stack.close())
                    stack = Peaks(starts[b.column("part")[0].as_py()] if first else 0, fanout)
                    group, first = g, False
                numbers.append(stack.next)
                nodes.extend((group, *n) for n in stack.push(digest) if n[0] or n[3])  # leaves inside aren't told twice
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("digest"), *[b.column(f.name) for f in carried], pa.nulls(len(numbers), pa.int32()), pa.array(numbers, pa.int64()), pa.nulls(len(numbers), pa.bool_()), pa.array(["leaf"] * len(numbers))], names=schema.names)
            if len(nodes) > FLUSH:
                yield told(types)
        if stack is not None:
            nodes.extend((group, *n) for n in stack.close())
            yield told(types)

    ship(spark)
    records = written(dealt.mapInArrow(releasing(run), schema), "kind")
    numbered = records.where("kind = 'leaf'").select("g", "digest", *[f.name for f in carried], "no")
    powers = F.array(*[F.lit(fanout**k) for k in range(63) if fanout**k < 1 << 62])
    totals = numbered.groupBy("g").agg(F.count("*").alias("count"))
    totals = written(totals.withColumn("height", F.size(F.filter(powers, lambda p: p < F.col("count")))))
    node = records.where("kind = 'node'").select("g", "level", "no", "digest", "edge")
    done, edges = node.where("not edge"), node.where("edge")
    highest = totals.agg(F.max("height")).first()[0] or 0
    height = 0
    while height < highest or height == 0:
        height += max(1, round(math.log(MERGED_LEAVES if height == 0 else 1024, fanout)))
        merged = written(_merged(edges, totals, fanout, height))
        done, edges = done.union(merged.where("not edge")), merged.where("edge")
    return numbered, done.union(edges).select("g", "level", "no", "digest"), totals


def _merged(edges: DataFrame, totals: DataFrame, fanout: int, height: int) -> DataFrame:
    """One round of merging, in blocks of fanout ** height leaves."""

    def run(own: pa.Table) -> pa.Table:
        g, count = own.column("g")[0].as_py(), own.column("count")[0].as_py()
        nodes = zip(*[own.column(c).to_pylist() for c in ("level", "no", "digest")])
        made = list(merge(list(nodes), count, fanout, height))
        columns = [[g] * len(made), *[[m[k] for m in made] for k in range(4)]]
        return pa.table(dict(zip(("g", "level", "no", "digest", "edge"), map(pa.array, columns, [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]))))

    up = F.pow(F.lit(float(fanout)), F.greatest(F.lit(height) - F.col("level"), F.lit(0))).cast("long")
    block = F.floor(F.col("no") / up).cast("long")
    return edges.join(totals.select("g", "count"), "g").withColumn("block", block).groupBy("g", "block").applyInArrow(run, "g string, level int, no bigint, digest string, edge boolean")


def proofs(numbered: DataFrame, nodes: DataFrame, totals: DataFrame, above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The leaves with ``path``, that of ``above`` (g, path, others) behind their own, and with the others."""
    levels = max(1, int(math.log(CHUNK_LEAVES, fanout) + 1e-9))
    highest = totals.agg(F.max("height")).first()[0] or 0
    tails = above.join(totals, "g").withColumn("no", F.lit(0).cast("long"))
    base = levels * max(0, -(-highest // levels) - 1)
    while base > 0:
        short = tails.where(F.col("height") < base)
        rows = nodes.where(F.col("level") == base)
        made = _paths(rows.select("g", "no", "digest"), tails.where(F.col("height") >= base), base, levels, fanout)
        tails = written(made.select(*[F.col(quoted(c)) for c in tails.columns]).unionByName(short))
        base -= levels
    return _paths(numbered, tails, 0, levels, fanout).drop("count", "height")


def _paths(rows: DataFrame, tails: DataFrame, base: int, levels: int, fanout: int) -> DataFrame:
    """rows (g, no, digest, others) of level ``base`` with path and what else ``tails`` has of the chunk's top, whose number is no."""
    chunk = F.floor(F.col("no") / fanout**levels).cast("long")
    own = [f for f in rows.schema.fields]
    added = [f for f in tails.schema.fields if f.name not in ("g", "no")]
    schema = T.StructType([*own, *added])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], schema=pa.schema([*[left.schema.field(f.name) for f in own], *[right.schema.field(f.name) for f in added]]))
        left = left.sort_by("no")
        tail = {f.name: right.column(f.name)[0] for f in added}
        width = -(-tail["count"].as_py() // fanout**base)
        paths = chunk_paths(left.column("digest").to_pylist(), width, fanout, levels)
        made = {f.name: left.column(f.name) for f in own}
        made |= {f.name: pa.repeat(tail[f.name], left.num_rows) for f in added}
        made["path"] = pa.array([p + tail["path"].as_py() for p in paths], pa.string())
        return pa.table(made)

    ship(rows.sparkSession)
    right = tails.select(F.col("g").alias("tail_g"), F.col("no").alias("tail_no"), *[F.col(quoted(f.name)).alias(f.name) for f in added])
    return rows.withColumn("chunk", chunk).groupBy("g", "chunk").cogroup(right.groupBy("tail_g", "tail_no")).applyInArrow(run, schema)


def manifest(df: DataFrame, group_col: str, order_col: str, leaf: Column, keep: list[Column], fanout: int = FANOUT) -> DataFrame:
    """(keep, leaf, no, path, subroot, root) of every row, no its number in its group, path its proof up to ``root``.

    A group's leaves ascend by ``order_col`` (null first; ties by leaf, equal rows in any order); while more than one node
    remains, each ``fanout`` neighbours become the hash of their hex digests. A group's last node is its subroot; subroots,
    in order of the group's text (null first, by UTF-8 bytes), give the root alike. A path has for each level the place in the
    run and the other digests of the run, none in a run of one, see ``siblings`` and ``folded``. Rows with null in any column,
    and repeated rows, are leaves like others; an empty table gives no row.
    """
    names = [f"c{k}" for k in range(len(keep))]
    group = F.col(quoted(group_col)).cast("string")
    g = F.when(group.isNull(), "0").otherwise(F.concat(F.lit("1"), group))
    rows = df.select(g.alias("g"), F.col(quoted(order_col)).alias("place"), leaf.alias("digest"), *[k.alias(n) for k, n in zip(keep, names)])
    numbered, nodes, totals = tree(rows, ["place"], fanout)
    top = lambda nodes, totals: nodes.join(totals, "g").where("level = height")
    subroots = top(nodes, totals).select(F.lit("").alias("g"), F.col("g").alias("sub_g"), "digest")
    sub_numbered, sub_nodes, sub_totals = tree(subroots, ["sub_g"], fanout)
    root = top(sub_nodes, sub_totals).select("g", F.lit("").alias("path"), F.col("digest").alias("root"))
    above = proofs(sub_numbered, sub_nodes, sub_totals, root, fanout).select(F.col("sub_g").alias("g"), "path", F.col("digest").alias("subroot"), "root")
    made = proofs(numbered, nodes, totals, written(above), fanout)
    original = df.select(*keep).columns
    return made.select(*[F.col(n).alias(o) for n, o in zip(names, original)], F.col("digest").alias("leaf"), "no", "path", "subroot", "root")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document; a null id is tampered with never."""
    docs = table(spark, sf_dir, "documents")
    hashed = lambda n: record_hash([F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")])
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = F.when(hit & F.col("n_chars").isNotNull(), hashed(F.col("n_chars") + 1)).alias("tampered")
    made = manifest(docs, "lang", "doc_id", hashed(F.col("n_chars")), [F.col("doc_id"), tampered])
    made = made.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text FROM documents),
c AS (SELECT *, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: list_transform(range(0, 8), lambda j: (ord(s) >> CAST(j AS INTEGER)) & 1)))),
    lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))) AS x FROM d),
t AS (SELECT *, n_chars + CASE WHEN xor(x, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS n2 FROM c),
f AS (SELECT r, doc_id, lang,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS n, coalesce(strlen(CAST(n2 AS VARCHAR)) || ':' || CAST(n2 AS VARCHAR), '-') AS m, coalesce(strlen(text) || ':' || text, '-') AS z FROM t),
leaves AS MATERIALIZED (SELECT r, doc_id, lang, sha256(a || n || z) AS leaf, sha256(a || m || z) AS changed FROM f),
nodes AS (
  SELECT 0 AS level, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS no, leaf AS h FROM leaves
  UNION ALL
  SELECT level + 1, lang, no // 2, sha256(string_agg(h, '' ORDER BY no)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS w FROM nodes) WHERE w > 1 GROUP BY level, lang, no // 2
),
subroots AS (SELECT lang, arg_max(h, level) AS h FROM nodes GROUP BY lang),
tops AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS no, h FROM subroots
  UNION ALL
  SELECT level + 1, no // 2, sha256(string_agg(h, '' ORDER BY no)) FROM (SELECT *, count(*) OVER () AS w FROM tops) WHERE w > 1 GROUP BY level, no // 2
),
starts AS (
  SELECT r, doc_id, l.lang, leaf, changed, s.h AS subroot, row_number() OVER (PARTITION BY l.lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS no, dense_rank() OVER (ORDER BY encode(l.lang) NULLS FIRST) - 1 AS top
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
),
heights AS (SELECT lang, max(level) AS height FROM nodes GROUP BY lang),
path AS (
  SELECT s.r, n.level, (s.no >> CAST(n.level AS INTEGER)) & 1 AS place, coalesce(o.h, '') AS h
  FROM starts s JOIN heights g ON s.lang IS NOT DISTINCT FROM g.lang JOIN (SELECT unnest(range(0, 64)) AS level) n ON n.level < g.height
  LEFT JOIN nodes o ON o.lang IS NOT DISTINCT FROM s.lang AND o.level = n.level AND o.no = xor(s.no >> CAST(n.level AS INTEGER), 1)
  UNION ALL
  SELECT s.r, 100 + n.level, (s.top >> CAST(n.level AS INTEGER)) & 1, coalesce(o.h, '')
  FROM starts s JOIN (SELECT unnest(range(0, 64)) AS level) n ON n.level < (SELECT max(level) FROM tops)
  LEFT JOIN tops o ON o.level = n.level AND o.no = xor(s.top >> CAST(n.level AS INTEGER), 1)
),
proofs AS (SELECT r, string_agg(h, '' ORDER BY level) AS proof, list(place || h ORDER BY level) AS steps FROM path GROUP BY r),
made AS (
  SELECT s.*, (SELECT arg_max(h, level) FROM tops) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_concat([changed], coalesce(steps, [])), lambda a, b: CASE WHEN b[1] = '0' THEN sha256(a || b[2:]) ELSE sha256(b[2:] || a) END) AS folded_root
  FROM starts s LEFT JOIN proofs p USING (r)
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM made
"""

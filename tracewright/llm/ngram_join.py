"""N-gram Jaccard self-join by MinHash banding.

Documents become sets of five-word shingles (a text of fewer words is one shingle of all its words); texts with
equal sets are one node. Signatures of b bands with r rows are compared by shuffling on band hashes; b
and r are the steepest choice whose recall at the threshold reaches the target. Nodes that share a bucket
are tied in a star, never pair by pair, and the components of these ties are the blocks in which pairs are
verified on their full n-gram sets, as products of incidence matrices inside one task; a component of
much text or many nodes is cut, and each pair of its parts is a block of its own. Only counts of links and one tie per
node leave a task, so a group of thousands of near copies makes thousands of rows, not millions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import byte_slices, free_names, materialize, quoted, releasing, ship, table

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.9999  # of pairs at the threshold; pairs above it are met more surely
HASHES = 420  # 51 bands of 8 rows: of pairs at a similarity of 0.3 one in 300 is tied
BLOCK_SHINGLES = 500_000  # bounds of one part of a component, in shingles and in nodes
BLOCK_NODES = 512
SEEN = 100_000  # different rows that a task remembers to drop repeats before a shuffle

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = _RNG.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def banding(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which the bands that the recall asks for fit the hashes."""
    if not 0 < hashes <= len(_MULTIPLIERS):
        raise ValueError(f"hashes must be from 1 to {len(_MULTIPLIERS)}")
    best = (hashes, 1)
    for r in range(1, hashes + 1):
        p = threshold**r
        b = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if b * r <= hashes:
            best = (b, r)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_INVERSE = pow(int(_BASE), -1, 2**64)
POWERS_KEPT = 1 << 21  # bytes of text for which a worker keeps the powers: two tables of 16 MB
_KEPT: list[np.ndarray] = []


def _both_powers(n: int) -> list[np.ndarray]:
    """Ascending powers of the base and of its inverse, n or more; kept for texts of usual size."""
    if n > POWERS_KEPT:
        return [_powers(n, int(_BASE)), _powers(n, _INVERSE)]
    if not _KEPT:
        _KEPT.extend([_powers(POWERS_KEPT, int(_BASE)), _powers(POWERS_KEPT, _INVERSE)])
    return _KEPT


def shingle_sets(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): each text's distinct shingle hashes ascending, behind one another; a word is a run
    without ASCII white space. All words of all texts are hashed at a time."""
    data = [t.encode() for t in texts]
    x = np.frombuffer(b" ".join(data) + b" ", dtype=np.uint8)
    space = _SPACE[x]
    up, down = _both_powers(len(x) + 1)
    begin = np.flatnonzero(~space & np.append(True, space[:-1]))
    end = np.flatnonzero(space & np.append(False, ~space[:-1]))
    sums = np.append(np.uint64(0), np.cumsum(_BYTE[x] * up[: len(x)], dtype=np.uint64))
    words = _mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    starts = np.cumsum([0] + [len(d) + 1 for d in data])
    owner = np.searchsorted(starts, begin, side="right") - 1
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    shingles = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
    at = np.repeat(first - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    of = np.repeat(np.arange(len(texts)), shingles)
    last = (first + count)[of]
    h = np.full(len(at), 7, dtype=np.uint64)
    for j in range(width):
        h = _mix(h * _BASE + np.where(at + j < last, words[np.minimum(at + j, max(0, len(words) - 1))] if len(words) else np.uint64(0), np.uint64(j + 1)))
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    keep = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)]
    h, of = h[keep], of[keep]
    return h, np.searchsorted(of, np.arange(len(texts) + 1))


def band_hashes(h: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash a band for each non-empty set, from MinHash values under multiply-shift permutations."""
    heads = ends[:-1]
    mixed = _mix(h)
    out = np.empty((len(heads), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(heads), b + 1, dtype=np.uint64)
        for r in range(rows):
            m = _MULTIPLIERS[b * rows + r]
            turned = mixed * m
            turned ^= turned >> np.uint64(32)
            key = _mix(key * _BASE + np.minimum.reduceat(turned, heads))
        out[:, b] = key
    return out


def set_key(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """(doc, th, node, n, bands) of every row of (doc, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "text", 1 << 20):
                h, ends = shingle_sets(part.column("text").to_pylist(), width)
                n = np.diff(ends)
                made: list = [None] * len(n)
                some = np.flatnonzero(n)
                if len(some):
                    for i, b in zip(some.tolist(), band_hashes(h, ends[np.append(some, some[-1] + 1)] if len(some) < len(n) else ends, bands, rows).view(np.int64)):
                        made[i] = b
                keys = [set_key(h[a:b]) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("th"), pa.array(keys, type=pa.int64()), pa.array(n, type=pa.int64()), pa.array(made, type=pa.list_(pa.int64()))], names=["doc", "th", "node", "n", "bands"])

    ship(docs.sparkSession)
    return docs.select("doc", "th", "text").mapInArrow(releasing(run), "doc bigint, th bigint, node bigint, n bigint, bands array<bigint>")


def without_repeats(texts: DataFrame) -> DataFrame:
    """(key, no_key, th, text) with most repeats of (key, no_key, th) gone: a task drops those it met among its last
    SEEN different ones, so that rows that come a million times are few before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "no_key", "th")))):
                if row not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(row)
                    keep[k] = True
            yield batch if keep.all() else batch.filter(pa.array(keep))

    ship(texts.sparkSession)
    return texts.mapInArrow(releasing(run), texts.schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of (a, b) ties; the root is the component's smallest node.

    Alternates large-star and small-star steps until the ties stand still; the ties are never more than
    at the start, and a hub's rows are met by a join, which Spark can split.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    state = None
    while True:
        both = now.union(now.select("b", "a"))
        # written before it is joined, so that Spark can split the rows of a hub
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a > b").distinct()
        now = materialize(small)
        found = tuple(now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first())
        if found == state:
            break
        state = found
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()).distinct()


def _linked(h: np.ndarray, ends: np.ndarray, rows: np.ndarray, columns: np.ndarray, threshold: float) -> np.ndarray:
    """Which of these sets are at least as similar as the threshold: exact counts of shared shingles.

    Only shingles that several sets have take part in the products, a slice of them at a time.
    """
    sizes = np.diff(ends)
    shared = np.zeros((len(rows), len(columns)), dtype=np.float32)
    own = lambda sel: (np.concatenate([h[ends[i] : ends[i + 1]] for i in sel]), np.repeat(np.arange(len(sel)), sizes[sel]))
    hr, wr = own(rows)
    hc, wc = own(columns)
    common = np.intersect1d(hr, hc)
    if len(common) == 0:
        return np.zeros(shared.shape, dtype=bool)
    ar, ac = np.searchsorted(common, hr), np.searchsorted(common, hc)
    ok = common[np.minimum(ar, len(common) - 1)] == hr
    ar, wr = ar[ok], wr[ok]
    ok = common[np.minimum(ac, len(common) - 1)] == hc
    ac, wc = ac[ok], wc[ok]
    order, order_c = np.argsort(ar, kind="stable"), np.argsort(ac, kind="stable")
    ar, wr, ac, wc = ar[order], wr[order], ac[order_c], wc[order_c]
    step = 4096
    for a in range(0, len(common), step):
        r, c = slice(*np.searchsorted(ar, [a, a + step])), slice(*np.searchsorted(ac, [a, a + step]))
        width = min(step, len(common) - a)
        left, right = np.zeros((len(rows), width), dtype=np.float32), np.zeros((len(columns), width), dtype=np.float32)
        left[wr[r], ar[r] - a] = 1
        right[wc[c], ac[c] - a] = 1
        shared += left @ right.T
    union = sizes[rows][:, None] + sizes[columns][None, :] - shared
    return shared >= threshold * union - 1e-9


def _verify(table_: pa.Table, width: int, threshold: float) -> pa.Table:
    """Links inside one block: for each node the documents and nodes it is linked to, and the smallest
    node it reaches here."""
    node = table_.column("node").to_numpy()
    part, side = table_.column("part").to_numpy(), (table_.column("i").to_numpy(), table_.column("j").to_numpy())
    weight = table_.column("members").to_numpy()
    _, first = np.unique(node, return_index=True)  # a row that comes twice counts once
    node, part, weight = node[first], part[first], weight[first]
    i, j = int(side[0][0]), int(side[1][0])
    texts = table_.column("text").to_pylist()
    h, ends = shingle_sets([texts[k] for k in first], width)
    root = np.arange(len(node))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links, docs = np.zeros(len(node), dtype=np.int64), np.zeros(len(node), dtype=np.int64)
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    chunk = 256
    for a in range(0, len(left), chunk):
        for b in range(a if i == j else 0, len(right), chunk):
            r, c = left[a : a + chunk], right[b : b + chunk]
            hit = _linked(h, ends, r, c, threshold)
            if i == j and a == b:
                np.fill_diagonal(hit, False)
            links[r] += hit.sum(axis=1)
            docs[r] += hit @ weight[c]
            if not (i == j and a == b):
                links[c] += hit.sum(axis=0)
                docs[c] += weight[r] @ hit
            for x, y in zip(*np.nonzero(hit)) if hit.sum() < 4 * (len(r) + len(c)) else _spanning(hit):
                u, v = find(r[x]), find(c[y])
                root[max(u, v)] = min(u, v)
    low = node[[find(k) for k in range(len(node))]]  # nodes ascend, so the smallest index is the smallest node
    return pa.table({"node": node, "links": links, "docs": docs, "low": low})


def _spanning(hit: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ties that join what a dense block of links joins: breadth first from each row not yet met."""
    rows_left, columns_left = np.ones(hit.shape[0], dtype=bool), np.ones(hit.shape[1], dtype=bool)
    for x in range(hit.shape[0]):
        if not rows_left[x]:
            continue
        queue, rows_left[x] = [x], False
        while queue:
            r = queue.pop()
            for y in np.flatnonzero(hit[r] & columns_left):
                columns_left[y] = False
                yield r, y
                for z in np.flatnonzero(hit[:, y] & rows_left):
                    rows_left[z] = False
                    queue.append(z)
                    yield z, y


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = WIDTH, recall: float = RECALL, hashes: int = HASHES) -> DataFrame:
    """(doc_id, class_id, n_links, n_class, first, th) of every row.

    class_id is the smallest id of the documents that links connect with it, n_links the number of other
    rows whose Jaccard similarity is at least the threshold, copies of its own text included, n_class the
    rows of the class, first whether it is the one of the class with the smallest id (null last), then text hash; th a hash of the text. Null text counts as empty; texts without a word have no shingle and are copies
    of one another only. Null ids form classes like others (null class_id only if all ids of a class are null). Repeated rows are
    copies. Other columns are left out; join on the id and th to get them.
    """
    bands, rows = banding(threshold, recall, hashes)
    base = docs.select(docs[id_col].cast("bigint").alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    sig = materialize(signatures(base, bands, rows, width))
    nodes = sig.groupBy("node").agg(F.count("*").alias("members"), F.min(F.struct(F.col("doc").isNull(), "doc", "th")).alias("pick"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(nodes)
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("bucket"))
    anchors = buckets.groupBy("bucket").agg(F.min("node").alias("anchor"), F.count("*").alias("k")).where("k > 1").select("bucket", "anchor")
    ties = buckets.join(anchors, "bucket").where("node <> anchor").select(F.col("node").alias("a"), F.col("anchor").alias("b"))
    comps = materialize(components(ties))
    # written before it is joined, so that Spark can split the rows of a large component
    sized = materialize(comps.join(nodes.select("node", "n"), "node").groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_NODES)).cast("int").alias("parts")))
    parts = comps.join(sized, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    chosen = parts.join(nodes.select("node", "members", "pick"), "node").select("node", "root", "parts", "part", "members", F.coalesce("pick.doc", F.lit(0)).alias("key"), F.col("pick.doc").isNull().alias("no_key"), F.col("pick.th").alias("th"))
    texts = base.select(F.coalesce("doc", F.lit(0)).alias("key"), F.col("doc").isNull().alias("no_key"), "th", "text")
    # repeated rows go before the shuffle but for one a task, and behind the join but for one
    rows_ = chosen.join(without_repeats(texts), ["key", "no_key", "th"]).dropDuplicates(["key", "no_key", "th"])
    # part p takes part in the blocks (p, q) and (q, p) of all parts q, each once with i <= j
    rows_ = rows_.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("part", "q")).withColumn("j", F.greatest("part", "q"))
    rows_ = rows_.select("node", "root", "i", "j", "part", "members", "text")
    found = materialize(rows_.groupBy("root", "i", "j").applyInArrow(lambda t: _verify(t, width, threshold), "node bigint, links bigint, docs bigint, low bigint"))
    links = found.groupBy("node").agg(F.sum("docs").alias("docs"))
    if sized.agg(F.max("parts")).first()[0] not in (None, 1):  # classes reach over the parts of a cut component
        classes = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    else:
        classes = found.where("node <> low").select("node", F.col("low").alias("root"))
        classes = classes.union(classes.select(F.col("root").alias("node"), "root").distinct())
    own = nodes.select("node", "members", "pick").join(links, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = materialize(own)
    # written before they are joined, so that Spark can split the rows of a large class
    heads = materialize(own.groupBy("root").agg(F.min("pick").alias("first"), F.sum("members").alias("n_class")))
    own = materialize(own.join(heads, "root").select("node", "first", "n_class", (F.col("members") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links")))
    is_first = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("th") == F.col("first.th"))
    return sig.select("doc", "th", "node").join(own, "node").select(F.col("doc").alias("doc_id"), F.col("first.doc").alias("class_id"), "n_links", "n_class", is_first.alias("first"), "th")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without all but one of each class of similar documents: the one with
    the smallest id, then text hash. Of repeated rows one stays. Documents in no group stay as they are; columns and their
    order stay.
    """
    gone = similar_documents(docs, id_col, text_col, **options).where("not first").select("doc_id", "th").distinct()
    own, no = free_names(docs.columns, "own", "no")
    rows = docs.withColumn(own, F.struct(docs[id_col].cast("bigint").alias("id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("th")))
    gone = gone.select(F.struct(F.col("doc_id").alias("id"), "th").alias(no))
    left = rows.join(gone, F.col(f"{own}.id").eqNullSafe(F.col(f"{no}.id")) & (F.col(f"{own}.th") == F.col(f"{no}.th")), "left_anti")
    number = F.row_number().over(Window.partitionBy(f"{own}.id", f"{own}.th").orderBy(f"{own}.th"))
    return left.withColumn(no, number).where(F.col(no) == 1).select(*[F.col(quoted(c)) for c in docs.columns])


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, class_id, n_links, n_class) of every document; see ``similar_documents``."""
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_class")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(0, CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(len(ws) - 4, 1) END), lambda i: array_to_string(ws[i + 1 : i + 5], ' '))) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), j AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM j JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), k AS (SELECT a AS doc_id, min(b) AS class_id, count(*) AS n_class FROM r GROUP BY 1
), m AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT k.doc_id, k.class_id, coalesce(m.n_links, 0) AS n_links, k.n_class FROM k LEFT JOIN m USING (doc_id)
"""

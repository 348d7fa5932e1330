"""Source divergence, Merkle manifest and line dedup against plain Python on hard rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracewright.llm import line_runs, merkle_manifest, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SHARED = "A Line that Many documents share, Äpfel and all of that"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows():
    out = []
    for k in range(60):
        lines = [f"own line number {k} of this document, which nobody shares", "short", SHARED if k % 3 else f"\t {SHARED.lower().replace('ä', 'Ä')} \r"]
        out.append((k, "\n".join(lines * (1 + k % 2)), ["en", "fr", None, ""][k % 4], f"src{k % 7}", 10 + k))
    out += [
        (None, SHARED + "\n\n", "en", "src0", None), (None, None, "en", None, 3), (100, "", None, "src1", 0), (101, "x" * 39 + "\n" + "y" * 40, "de", "", 1),
        (102, (SHARED + "\n") * 20000 + "end", "en", "src9", 5), (102, SHARED, "en", "src9", 6), (103, "日本 word word 𝄞 WORD word-word 3word\x00word", "en", "zz", 1),
    ]
    return out + [(104, "no shared line here\nword", "日本", "q", 7)] * 3


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("audits"))
    spark.createDataFrame(rows(), SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    return path


def line_key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def plain_dedup(data):
    held = defaultdict(list)
    for r, (doc_id, text, *_) in enumerate(data):
        for key in {line_key(x) for x in (text or "").split("\n")}:
            if len(key) >= 40:
                held[key].append((r, -1 if doc_id is None else doc_id))
    gone = {k: max(i for _, i in v) for k, v in held.items() if len(v) >= 5}
    for doc_id, text, *_ in data:
        lines = (text or "").split("\n")
        kept = [x for x in lines if gone.get(line_key(x), -1 if doc_id is None else doc_id) == (-1 if doc_id is None else doc_id)]
        yield doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))


def test_line_dedup(spark, table):
    made = line_runs.op13_line_dedup(spark, table).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, made), key=repr) == sorted(plain_dedup(rows()), key=repr)


def test_levelled_runs(spark):
    """Whatever the batches, a hash is kept once, with what its first batch said; full levels are compacted."""
    met = line_runs.LevelledRuns(fanout=2)
    for k in range(5):
        met.add(spark.range(k * 10, k * 10 + 15).select(F.col("id").alias("h1"), (F.col("id") * 7).alias("h2"), F.lit(k).alias("keeper")))
    assert [len(level) for level in met.levels] == [1, 0, 1]
    found = sorted((r["h1"], r["keeper"]) for r in met.met().collect())
    assert found == [(h, max(0, -(-(h - 14) // 10))) for h in range(55)]


def test_line_dedup_clashing_names_and_empty(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).withColumnRenamed("lang", "KEEPER").withColumn("h1", F.lit(1)).withColumn("N_Lines", F.lit("x")).withColumn("a.b`", F.lit(2))
    made = line_runs.drop_shared_lines(docs, batches=3, fanout=2)
    assert made.columns == ["doc_id", "text", "KEEPER", "source", "n_chars", "h1", "a.b`", "n_lines", "n_dropped", "kept"]
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], sha(r["kept"])) for r in made.collect()), key=repr) == sorted(plain_dedup(rows()), key=repr)
    assert line_runs.drop_shared_lines(docs.limit(0)).count() == 0


def test_one_line_in_a_third_of_many_rows(spark):
    """200,000 equal rows beside others: all but the largest id lose the line, equal ones of it keep it."""
    docs = spark.range(200_000).select((F.col("id") % 1000).alias("doc_id"), F.lit(SHARED).alias("text")).union(spark.range(400_000).select((F.col("id") + 5000).alias("doc_id"), F.concat(F.lit("own line of a document with more than forty characters "), F.col("id").cast("string"))))
    made = line_runs.drop_shared_lines(docs).groupBy("n_dropped").count().collect()
    assert {r["n_dropped"]: r["count"] for r in made} == {0: 400_200, 1: 199_800}


def test_halving_finds_each(spark):
    for n in (1, 2, 3, 7, 8, 33):
        held = F.array(*[F.struct(F.lit(k * 2).cast("long").alias("h1"), F.lit(k).cast("long").alias("h2")) for k in range(n)])
        found = spark.range(2 * n + 2).select("id", line_runs._found(held, F.struct(F.col("id").alias("h1"), F.floor(F.col("id") / 2).alias("h2"))).alias("f")).collect()
        assert [r["f"] for r in found] == [k % 2 == 0 and k < 2 * n for k in range(2 * n + 2)]


def h(children):
    return sha("".join(children))


def plain_manifest(data, fanout=2):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: sha("".join(said(v) for v in (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            a = i - i % fanout
            yield i % fanout, level[a:i] + level[i + 1 : a + fanout]
            i //= fanout

    groups = defaultdict(list)
    for r in data:
        groups[r[2]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = up([leaf(r) for r in groups[g]])
    top = up([trees[g][-1][0] for g in order])
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            steps = [*path(trees[g], i), *path(top, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            at = leaf(r, int(hit))
            for place, rest in steps:
                at = h(rest[:place] + [at] + rest[place:])
            yield r[0], leaf(r), trees[g][-1][0], top[-1][0], h([x for _, rest in steps for x in rest]), at, at == top[-1][0]


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("most", [100_000, 7])
def test_manifest(spark, table, monkeypatch, most):
    """In one partition and in several whose edges cut through nodes and groups, proofs by small chunks."""
    monkeypatch.setattr(merkle_manifest, "ROWS_IN_PARTITION", most)
    if most == 7:
        monkeypatch.setattr(merkle_manifest, "CHUNK_LEAVES", 4)
        monkeypatch.setattr(merkle_manifest, "MERGED_LEAVES", 4)
    made = merkle_manifest.op12_merkle_manifest(spark, table).select(*COLUMNS).collect()
    assert sorted(map(tuple, made), key=repr) == sorted(plain_manifest(rows()), key=repr)


@pytest.mark.parametrize("fanout", [3, 5])
def test_manifest_with_other_fanouts(spark, table, monkeypatch, fanout):
    monkeypatch.setattr(merkle_manifest, "ROWS_IN_PARTITION", 9)
    monkeypatch.setattr(merkle_manifest, "CHUNK_LEAVES", fanout)
    docs = spark.read.parquet(f"{table}/documents.parquet")
    leaf = merkle_manifest.record_hash([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    made = merkle_manifest.manifest(docs, "lang", "doc_id", leaf, [F.col("doc_id")], fanout)
    made = made.withColumn("proof", F.sha2(merkle_manifest.siblings(F.col("path")), 256)).withColumn("again", merkle_manifest.folded(F.col("leaf"), F.col("path"))).collect()
    assert sorted((((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in made)), key=repr) == sorted((t[:5] for t in plain_manifest(rows(), fanout)), key=repr)
    assert all(r["again"] == r["root"] for r in made)


def test_manifest_of_few_and_of_equal_rows(spark, tmp_path):
    few = [(1, "a", "en", "s", 1)]
    spark.createDataFrame(few, SCHEMA).write.parquet(f"{tmp_path}/one/documents.parquet")
    assert [tuple(r) for r in merkle_manifest.op12_merkle_manifest(spark, f"{tmp_path}/one").select(*COLUMNS).collect()] == list(plain_manifest(few))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert merkle_manifest.op12_merkle_manifest(spark, f"{tmp_path}/none").count() == 0
    equal = [(5, "equal rows", "en", "s", 2)] * 3000 + [(k, "x", "en", "s", 1) for k in range(20)]
    spark.createDataFrame(equal, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/equal/documents.parquet")
    made = merkle_manifest.op12_merkle_manifest(spark, f"{tmp_path}/equal").select(*COLUMNS).collect()
    assert sorted(map(tuple, made)) == sorted(plain_manifest(equal))


def plain_divergence(data, least, top):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    found = [(r[2] or "", r[3] or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in term.findall(r[1] or "")]) for r in data]
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in found:
        df[lang].update(set(terms))
        groups[lang].add(source)
    kept = {lang: {t for t, n in df[lang].items() if n >= least} for lang in groups}
    for lang, source, terms in found:
        own = [t for t in terms if t in kept[lang]]
        counts[lang, source].update(own)
        counts[lang, None].update(own)
    for lang, sources in groups.items():
        total = lambda s: sum(counts[lang, s].values()) + 5 * len(kept[lang])  # noqa: E731, B023
        p = lambda s, t: 1 + 1000000000 * (counts[lang, s][t] + 5) // total(s)  # noqa: E731, B023
        for s in sources:
            pairs = [(sum(abs(p(s, t) - p(o, t)) for t in kept[lang]), o) for o in sources if o != s]
            own = [(p(s, t) - p(None, t), t) for t in kept[lang] if counts[lang, s][t] and p(s, t) > p(None, t)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", own, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    yield lang, s, part, item, value, rank


@pytest.mark.parametrize("small", [False, True])
def test_source_divergence(spark, table, monkeypatch, small):
    """With one automaton and one block of terms, and with several of both."""
    if small:
        monkeypatch.setattr(source_divergence, "VOCABULARY_BYTES", 200)
        monkeypatch.setattr(source_divergence, "CELLS", 12)
        monkeypatch.setattr(source_divergence, "HELD", 3)
    docs = spark.read.parquet(f"{table}/documents.parquet")
    made = source_divergence.audit(docs, least_docs=4, top=3).collect()
    want = sorted(plain_divergence(rows(), 4, 3))
    assert sorted(map(tuple, made)) == want and {r[2] for r in want} == {"pair", "term"}
    assert source_divergence.audit(docs.limit(0)).count() == 0


def test_source_divergence_registered(spark, table):
    assert sorted(map(tuple, source_divergence.op11_source_divergence(spark, table).collect())) == sorted(plain_divergence(rows(), 30, 50))


def test_terms_stand_between_delimiters():
    machine = source_divergence.automaton(["ab", "b", "é"])
    assert list(source_divergence.occurrences(machine, "ab,AB b-b3b abb é\x00éé B".encode())) == ["ab", "ab", "b", "b", "b", "é", "b"]

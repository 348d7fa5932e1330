"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import itertools
import random
import re
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import fingerprints, langid_ppm, license_rules, ngram_join, sentencepiece_codec, shard_shuffle, source_mix, toxicity_pu, vptree, warc_fixity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, score string"
ODD = [(1, None, None, None, "x"), (2, "", "en", "a", None), (3, " \n", "en", "a", None), (4, "one two three four five six", "en", None, None), (4, "one two three four five six", "en", None, None), (None, "one two three four five six", "en", "b", None), (7, "word " * 30000, "fr", "b", None), (8, "日本 𝄞\x00 é", None, "b", "")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pieces_equal_the_library(spark, odd, empty):
    with open(sentencepiece_codec.default_model(), "rb") as f:
        codec = sentencepiece_codec.MergeCodec(f.read())
    rng = random.Random(1)
    parts = ["a", "th", " ", "  ", "\n", "é", "日", "𝄞", "\x00", "▁", " the", "ing", "<s>", "�"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 40, 2000]))) for _ in range(500)]
    assert codec.encode(texts) == codec.library.encode(texts)
    rows = sentencepiece_codec.encode_decode(odd, sentencepiece_codec.default_model()).collect()
    assert all(r["ids"] == codec.library.encode(r["text"] or "") and r["decoded"] == codec.library.decode(r["ids"]) for r in rows)
    assert sentencepiece_codec.encode_decode(empty, sentencepiece_codec.default_model()).count() == 0


def test_fixity_finds_each_fault(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * (i % 90)) for i in range(1200)] + [(None, None, None)], "page_id bigint, url string, html string")
    left, right = warc_fixity.replicas(pages, [F.col("html"), warc_fixity.damaged_payload()], 3)
    found = {r["page_id"] for r in warc_fixity.audit(left, right).collect()}
    want = {r["page_id"] for r in left.alias("a").join(right.alias("b"), ["file", "no"]).where("a.digest <> b.digest").select("a.page_id").collect()}
    assert found == want and len(found) > 10
    assert warc_fixity.audit(left, left).count() == 0
    short = warc_fixity.audit(left, right.where("no < 5"))
    assert short.where("fault = 'missing'").count() == left.where("no >= 5").count()


def test_fixity_finds_moved_records(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * (i % 90)) for i in range(100)], "page_id bigint, url string, html string")
    left = warc_fixity.records(pages, 1)
    gap = left.withColumn("offset", F.col("offset") + F.when(F.col("no") >= 90, 2).otherwise(0))
    assert sorted((r["no"], r["fault"], r["digest"] == r["replica_digest"]) for r in warc_fixity.audit(left, gap).collect()) == [(90, "moved", True)]


def test_positive_unlabelled_learning_on_held_out_rows(spark, odd, empty):
    rng = random.Random(2)
    plain = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(plain, k=40) + (["vilest", "vilely"] if i % 6 == 0 else [])), None, None, None) for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 900, 2)], "doc_id bigint, toxic int")
    model = toxicity_pu.learn(docs, labels.where(~toxicity_pu.held_out(F.col("doc_id"))))
    made = toxicity_pu.score(docs, model).where(toxicity_pu.held_out(F.col("doc_id"))).collect()
    assert np.mean([(r["doc_id"] % 6 == 0) == bool(r["predicted"]) for r in made]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in toxicity_pu.score(odd, model).collect())
    assert toxicity_pu.learn(empty, labels.limit(0)) is None
    assert toxicity_pu.score(odd, None).where("predicted = 0").count() == len(ODD)


def test_sketches_estimate_and_merge(spark, odd, empty):
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join(words[:1500]), " ".join(words[1500:]), ""]
    df = spark.createDataFrame([tuple(texts)], "a string, b string, c string, d string").select(*[fingerprints.sketch(F.col(c)).alias(c) for c in "abcd"])
    r = df.select(fingerprints.resemblance(F.col("a"), F.col("b")), fingerprints.containment(F.col("b"), F.col("a")), fingerprints.distinct_shingles(F.col("a")), fingerprints.resemblance(F.col("d"), F.col("d")), fingerprints.merge(F.col("b"), F.col("c"))).first()
    assert abs(r[0] - 0.5) < 0.15 and r[1] > 0.8 and abs(r[2] / 2996 - 1) < 0.3 and r[3] == 1.0 and len(r[4]) == fingerprints.K
    made = fingerprints.with_next_text(odd).collect()
    assert len(made) == len(ODD) and fingerprints.with_next_text(empty).count() == 0
    by = {m["id"]: m for m in made if m["id"] != 4}
    assert by[8]["next_id"] == 7 and by[2]["next_id"] == 1 and by[None]["next_id"] == 8
    assert by[8]["edited"] == ODD[-1][1][: len(ODD[-1][1]) - len(ODD[-1][1]) // 3] + ("word " * 9)[: len(ODD[-1][1]) // 3]


def test_successors_of_repeated_rows_and_ids(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 7, 7, 3, rng.randint(-40, 90)]), f"text {rng.randint(0, 60)} of some words") for _ in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    hashed = docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").isNull(), "text").alias("th")).collect()
    order = sorted(((r["doc_id"] is None, -(r["doc_id"] or 0), r["th"], r["text"], r["doc_id"]) for r in hashed), key=lambda r: r[:3])
    want = [(a[4], a[3], a[3][: len(a[3]) - len(a[3]) // 3] + b[3][: len(a[3]) // 3], b[4]) for a, b in zip(order, order[1:] + order[:1])]
    got = [(r["id"], r["text"], r["edited"], r["next_id"]) for r in fingerprints.with_next_text(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    # one row 150,000 times: work that grows with the square would not end in the time given
    many = spark.range(150_000).selectExpr("5L as doc_id", "'the same row again and again' as text").union(docs)
    spark.sparkContext.setJobGroup("repeats", "", True)
    stop = threading.Timer(90, spark.sparkContext.cancelJobGroup, ["repeats"])
    stop.start()
    try:
        assert fingerprints.with_next_text(many).where("id = 5 and next_id = 5 and edited is not null").count() >= 149_999
    finally:
        stop.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_trees_are_exact_at_factor_one(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))
    x[50:80] = x[0]
    rows = [(i, x[i].tolist()) for i in range(600)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (None, [1.0] * 8)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = vptree.nearest(v, v.where("vec_id % 20 = 0"), k=20, factor=1.0).collect()
    found: dict = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(0, 600, 20):
        s = (x[q] * x).sum(axis=1)
        assert found[q] == [i for i in sorted(range(600), key=lambda i: (-s[i], i)) if i != q][:20]
    assert set(found) == set(range(0, 600, 20))


def test_shards_have_exact_sizes(spark, odd, empty):
    df = spark.range(1003).select(F.col("id").alias("doc_id"))
    rows = shard_shuffle.shuffle_into_shards(df, ["doc_id"]).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(map(len, by.values())) == [62] * 5 + [63] * 11 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert shard_shuffle.shuffle_into_shards(odd, ["doc_id", "text"]).count() == len(ODD) and shard_shuffle.shuffle_into_shards(empty, ["doc_id"]).count() == 0
    matrix = shard_shuffle.communication_matrix([10, 0, 25], [12, 12, 11], 1)
    assert [sum(m) for m in matrix] == [10, 0, 25] and [sum(c) for c in zip(*matrix)] == [12, 12, 11]


def test_license_places(spark, odd, empty):
    scan = license_rules.Scanner(license_rules.rules()).scan
    r = scan("Used under the MIT license, under the mit License. CC-BY-NC; SPDX-License-Identifier: GPL-3.0-only")
    assert [s for s, _ in r["base"]] == [1, 5, 9] and {f[2] for f in r["found"]} >= {"mit", "gpl-3"}
    assert not any(a is not b and a[0] <= b[0] and b[1] <= a[1] for a in r["found"] for b in r["found"])
    assert scan("")["n_words"] == 0 and license_rules.scan_licenses(odd).count() == len(ODD) and license_rules.scan_licenses(empty).count() == 0


def _matches(pattern, most=2000):
    """Texts that a rule's pattern matches: all of them, or if they are many, each alternative in some."""
    kind = re._constants

    def several(parts):
        if np.prod([float(len(p)) for p in parts]) <= most:
            return ["".join(c) for c in itertools.product(*parts)]
        return ["".join(p[i % len(p)] for p in parts) for i in range(max(map(len, parts)))]

    def spelled(op, x):
        if op == kind.LITERAL:
            return [chr(x)]
        if op == kind.NOT_LITERAL or op == kind.IN and x[0][0] == kind.NEGATE:
            return ["q"]
        if op == kind.IN:
            return [chr(v) for _, v in x]
        if op == kind.SUBPATTERN:
            return several([spelled(*e) for e in x[3]])
        if op == kind.BRANCH:
            return [t for way in x[1] for t in several([spelled(*e) for e in way])]
        if op in (kind.MAX_REPEAT, kind.MIN_REPEAT):
            return ([""] if x[0] == 0 else []) + several([spelled(*e) for e in x[2]])
        assert op in (kind.ASSERT, kind.ASSERT_NOT), op
        return [""]

    return several([spelled(*e) for e in re._parser.parse(pattern)])


def test_license_keywords_are_in_every_match():
    keywords: dict = {}
    for rule in license_rules.rules():
        keywords.setdefault((rule.label, rule.pattern), set()).add(rule.keyword)
    missed = [(label, text) for (label, pattern), words in keywords.items() for text in _matches(pattern) if not words & set(text.split())]
    assert missed == []
    scan = license_rules.Scanner(license_rules.rules()).scan
    for use in ("research use", "research purposes", "noncommercial use", "non-commercial purposes"):
        r = scan(f"The weights are released for {use} only.")
        assert [f[2] for f in r["found"]] == ["non-commercial"] and r["score"] > 0


def test_license_names_alone_and_containment():
    rules = license_rules.rules()
    scan = license_rules.Scanner(rules).scan
    headings = {"Mozilla Public License Version 2.0": "mpl-2", "GNU General Public License version 3": "gpl-3", "Apache License, Version 1.1": "apache-1", "GNU Lesser General Public License version 2.1": "lgpl-2.1", "The Unlicense": "unlicense", "Apache 1.1 license": "apache-1"}
    for text, label in headings.items():
        r = scan(text)
        assert [(f[0], f[1], f[2]) for f in r["found"]] == [(0, r["n_words"], label)] and r["score"] == 0.7, text
    assert scan("Apache 1.1, GPL 3, MPL 2.0 and lesser general public license 3 text")["found"] == [(9, 14, "lgpl-3", "lgpl-3:name:lesser", 50)]
    for label, name, _, words in license_rules._NAMED:
        for text in _matches(name):
            if re.search("licen[cs]e", text):
                found = scan(f"x {text} x")["found"]
                assert any(f[0] <= 1 and f[1] >= 1 + len(text.split()) for f in found), (label, text)
    r = license_rules.Scanner([license_rules.Rule("wide", "w", "b", "a b c d", 10, 0.5), license_rules.Rule("best", "b", "b", "b c", 20, 0.5), license_rules.Rule("cut", "c", "b", "b c d e", 5, 0.5), license_rules.Rule("other", "o", "b", "a b", 1, 0.5)]).scan("a b c d e a b")
    assert [(f[0], f[1], f[3]) for f in r["found"]] == [(0, 2, "other"), (1, 3, "best"), (5, 7, "other")]
    rng = random.Random(6)
    own = [license_rules.Rule(f"r{k}", "x", "a", " ".join(rng.choice("ab") for _ in range(rng.randint(1, 5))), rng.randint(1, 4), 0.5) for k in range(25)]
    one = [license_rules.Scanner([r]).scan for r in own]
    for _ in range(60):
        text = "a " + " ".join(rng.choice("ab") for _ in range(20))
        kept: list = []
        for s, e, k in sorted(((f[0], f[1], k) for k, by in enumerate(one) for f in by(text)["found"]), key=lambda h: (-own[h[2]].priority, h[0] - h[1], h[0], h[2])):
            if not any(a <= s and e <= b or s <= a and b <= e for a, b, _ in kept):
                kept.append((s, e, own[k].name))
        assert [(f[0], f[1], f[3]) for f in license_rules.Scanner(own).scan(text)["found"]] == sorted(kept)


def test_mix_comes_near_targets(spark, odd, empty):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 60), None, f"s{min(i % 7, 3)}", None) for i in range(2000)]
    made = source_mix.pareto_mix(spark.createDataFrame(rows, SCHEMA)).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max("copies").alias("c")).collect()
    assert all(abs(r["t"] - r["target"]) <= 0.01 * r["target"] + 2 and r["c"] <= 3 for r in made)
    assert source_mix.pareto_mix(odd).where("taken > 3 * size").count() == 0 and source_mix.pareto_mix(odd).count() == len(ODD) and source_mix.pareto_mix(empty).count() == 0


def test_code_lengths_against_plain_python(spark, odd, empty):
    trees = langid_ppm.FrozenTrees(["a", "b"], *_counts({"a": b"the cat sat on the mat", "b": b"der hund und die katze"}))
    text = b"the hund xyz"
    assert np.allclose(trees.code_lengths(text).sum(axis=0), [_plain(b"the cat sat on the mat", text), _plain(b"der hund und die katze", text)], atol=1e-3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = langid_ppm.identify(docs, langid_ppm.learn(docs.where(~langid_ppm.held_out(F.col("doc_id"))))).where(langid_ppm.held_out(F.col("doc_id"))).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in made]) > 0.95
    got = langid_ppm.identify(odd, langid_ppm.learn(docs)).collect()
    assert [r["lang_pred"] for r in got][:3] == ["und"] * 3 and langid_ppm.learn(empty) is None


def test_copies_leave_the_language_sample_whole(spark):
    rng = random.Random(7)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    few, many, hot = [text("abcde") for _ in range(3)], [text("abcde") for _ in range(400)], text("abcde")
    rows = [(None, t, "few", None, None) for t in few * 300] + [(None, t, "many", None, None) for t in many + [hot] * 1000]
    docs = spark.createDataFrame(rows, SCHEMA)
    made = langid_ppm.identify(docs, langid_ppm.learn(docs, most=60)).select("lang", "lang_pred").distinct().collect()
    assert {r["lang_pred"] for r in made if r["lang"] == "few"} == {"few"}
    languages, drawn = langid_ppm.draw(docs.select("text", "lang"), 60)
    sample = [(r["lang"], r["text"]) for r in drawn.collect()]
    assert languages == ["few", "many"] and len(sample) == len(set(sample))
    assert sorted(t for lang, t in sample if lang == "few") == sorted(few) and 30 < sum(lang == "many" for lang, _ in sample) < 100


def _counts(texts):
    language, gram = [], []
    for i, t in enumerate(texts.values()):
        g = langid_ppm.grams(t)
        language += [i] * len(g)
        gram += g.tolist()
    keys, n = np.unique(np.array([language, gram]), axis=1, return_counts=True)
    return keys[0], keys[1], n


def _plain(train, text, order=4):
    seen: dict = {}
    t = b" " * order + train
    for i in range(order, len(t)):
        for k in range(order + 1):
            seen.setdefault(t[i - k : i], {}).setdefault(t[i], 0)
            seen[t[i - k : i]][t[i]] += 1
    x, bits = b" " * order + text, 0.0
    for i in range(order, len(x)):
        for k in range(order, -1, -1):
            c = seen.get(x[i - k : i])
            if c is None:
                continue
            total = sum(c.values()) + len(c)
            if x[i] in c:
                bits -= np.log2(c[x[i]] / total)
                break
            bits -= np.log2(len(c) / total)
        else:
            bits += 8
    return bits


def test_ngram_join_equals_brute_force(spark, odd, empty, monkeypatch):
    rng = random.Random(5)
    rows = []
    for g in range(30):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 40, 200]))]
        for _ in range(rng.choice([1, 2, 9])):
            own = list(words)
            own[rng.randrange(len(own))] = "new" + str(rng.randint(0, 3))
            rows.append((len(rows), " ".join(own), None, None, None))
    docs = spark.createDataFrame(rows, SCHEMA)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t, *_ in rows}
    near = {i: {j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    assert {r["doc_id"]: r["n_links"] for r in ngram_join.similar_documents(docs).collect()} == {i: len(n) for i, n in near.items()}
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 300)  # components are cut
    cut = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in ngram_join.similar_documents(docs).collect()}
    assert {i: n for i, (n, _) in cut.items()} == {i: len(n) for i, n in near.items()} and all(cut[i][1] == cut[j][1] for i in near for j in near[i])
    kept = [r["doc_id"] for r in ngram_join.keep_one(odd).collect()]
    assert sorted(kept) == [1, 4, 7, 8]  # texts without a word are copies, so are the equal ones with and without an id
    assert ngram_join.keep_one(empty).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("kept"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = ngram_join.materialize(after)
        assert docs.where("score is null or score <> 'kept'").count() == 0
    assert corpus_pipeline.tokens(spark, docs, SF).count() == docs.count() > 50

"""The registered queries and the pipeline against plain Python, row by row, and extra columns with clashing names."""

import hashlib
import math
import random
import re
import struct
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from tracewright.llm import common, fingerprints, langid_ppm, license_rules, ngram_join, sentencepiece_codec, shard_shuffle, source_mix, toxicity_pu, vptree, warc_fixity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
HARD = [
    (9001, None, None, None, 0),
    (9002, "", "en", "src1", 0),
    (9003, " \n\t", None, None, 3),
    (9004, "Under the MIT License, under the mit license; Apache License, Version 2 and CC-BY-NC. İ word É", "en", "src2", 0),
    (9005, "word " * 40000, "fr", "src2", 0),
    (9006, "日本 𝄞 \u0000 é", None, "zz", 0),
    (9007, "word " * 40000, "fr", None, 0),
    (9008, "½ ② ³ Ⅻ 4 _", "en", None, 0),
    (None, "no id at all under the mit license", "en", "src1", 0),
    (None, "no id at all under the mit license", "en", "src1", 0),
]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """sf0.001 and some hard rows, written; and the rows."""
    path = str(tmp_path_factory.mktemp("small"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(spark.createDataFrame(HARD, docs.schema))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path, spark.read.parquet(f"{path}/documents.parquet").collect()


def has_letter(text):
    return any(unicodedata.category(c).startswith("L") for c in text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, small):
    path, docs = small
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    want = []
    for d in docs:
        ids = library.encode(d["text"] or "")
        want.append((d["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, sentencepiece_codec.op1_sentencepiece(spark, path).collect()), key=repr) == sorted(want, key=repr)


def test_op3(spark, small):
    path, docs = small
    made = toxicity_pu.op3_toxicity(spark, path).collect()
    assert Counter(r["doc_id"] for r in made) == Counter(d["doc_id"] for d in docs)
    for r in made:
        text = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(text.encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    labels = spark.read.parquet(f"{path}/labels.parquet")
    model = toxicity_pu.learn(spark.read.parquet(f"{path}/documents.parquet"), labels.where(~toxicity_pu.held_out(labels["doc_id"])))
    want = {(d["doc_id"], d["text"]): model.score(d["text"]) for d in docs}
    by_id = {i: s for (i, _), s in want.items()}
    assert all(abs(r["score"] - by_id[r["doc_id"]]) < 1e-12 for r in made)
    changed = labels.withColumn("toxic", F.when(toxicity_pu.held_out(labels["doc_id"]), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity_pu.learn(spark.read.parquet(f"{path}/documents.parquet"), changed.where(~toxicity_pu.held_out(labels["doc_id"])))
    assert again.weights == model.weights and again.bias == model.bias


def test_prior_and_long_or_repeated_texts(spark):
    rng = np.random.default_rng(1)
    for prior in (0.05, 0.2, 0.5):
        zp, zu = rng.normal(2, 1, 3000), np.concatenate([rng.normal(2, 1, int(6000 * prior)), rng.normal(-2, 1, int(6000 * (1 - prior)))])
        assert abs(toxicity_pu.class_prior(zp, zu) - prior) < 0.05
    bad, good = "vile " * 3 + "calm day ", "calm day under a wide sky "
    rows = [(k % 150, (bad if k % 3 == 0 else good) * (20000 if k < 6 else 1) + f"w{k % 150}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(150)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    made = toxicity_pu.score(docs, toxicity_pu.learn(docs, labels)).collect()
    assert [r["predicted"] for r in made] == [int(k % 3 == 0) for k in range(300)]


def fingerprint(text, k=fingerprints.K, width=fingerprints.WIDTH):
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    words = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    found = set()
    for i in range(max(1, len(words) - width + 1) if words else 0):
        seed = 42
        for w in words[i : i + width]:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", w), seed)
        found.add(signed(seed))
    return sorted(found)[:k]


def likeness(a, b, k=fingerprints.K):
    union = sorted(set(a) | set(b))[:k]
    return len(set(a) & set(b) & set(union)) / len(union) if union else 1.0


def test_op4(spark, small):
    path, docs = small
    text = {d["doc_id"]: d["text"] or "" for d in docs if d["doc_id"] is not None}
    order = sorted(text, reverse=True)
    made = fingerprints.op4_fingerprint(spark, path).collect()
    assert Counter(r["doc_id"] for r in made) == Counter(d["doc_id"] for d in docs)
    show = lambda a: ",".join(f"{x & (2**64 - 1):x}" for x in a)
    for r in made:
        if r["doc_id"] in (None, order[-1]):  # null ids stand between the last and the first
            continue
        own, after = text[r["doc_id"]], text[order[order.index(r["doc_id"]) + 1]]
        cut = len(own) // 3
        edited = own[: len(own) - cut] + after[:cut]
        a, b, c = fingerprint(own), fingerprint(edited), fingerprint(after)
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(own), sha(edited), show(a), show(b)), r["doc_id"]
        assert abs(r["near_edited"] - likeness(a, b)) < 1e-12 and abs(r["near_next"] - likeness(a, c)) < 1e-12


def test_op6(spark, small):
    path, docs = small
    made = shard_shuffle.op6_shard_shuffle(spark, path).collect()
    size = lambda d: len((d["text"] or "").encode()) + 1
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in made), key=repr) == sorted(((d["doc_id"], size(d), zlib.crc32((d["text"] or "").encode())) for d in docs), key=repr)
    slots = {}
    for r in made:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert set(slots) <= set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shuffles_are_uniform(spark):
    """Every row meets every shard and slot about equally often over seeds; rows close by part."""
    rng = random.Random(3)
    draws = Counter(shard_shuffle.hypergeometric(rng, 12, 18, 10) for _ in range(20000))
    for x in range(11):
        p = math.comb(12, x) * math.comb(18, 10 - x) / math.comb(30, 10)
        assert abs(draws[x] / 20000 - p) < 5 * math.sqrt(max(p * (1 - p), 1e-4) / 20000)
    rows = [sum(m[0][0] for m in [shard_shuffle.communication_matrix([10, 30], [20, 20], seed)]) for seed in range(4000)]
    assert abs(np.mean(rows) - 5) < 0.1 and abs(np.var(rows) - 10 * 0.5 * 0.5 * 30 / 39) < 0.2
    df = spark.range(40).select(F.col("id").alias("doc_id"))
    hits = np.zeros((40, 4))
    places = Counter()
    for seed in range(20):
        for r in shard_shuffle.shuffle_into_shards(df, ["doc_id"], 4, seed * 10).collect():
            hits[r["doc_id"], r["shard"]] += 1
            places[r["shard"] * 10 + r["slot"]] += r["doc_id"]
    assert ((hits - 5) ** 2 / 5).sum() < 220  # chi square, 120 degrees of freedom
    assert all(abs(v / 20 - 19.5) < 12 for v in places.values())


def test_op7_base(spark, small):
    path, docs = small
    made = license_rules.op7_licenses(spark, path).collect()
    want = []
    for d in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), d["text"] or ""))
        at = [(i, label) for phrase, label in license_rules.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        want.append((d["doc_id"], len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in made), key=repr) == sorted(want, key=repr)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in made)


def test_op7_labels_and_score_without_gate(spark, small):
    """Every rule on every text, no keyword looked at first; of two places one inside the other the better stays."""
    path, docs = small
    own = [(k, r, re.compile(rf"(?<= )(?:{r.pattern})(?= )".encode())) for k, r in enumerate(license_rules.rules())]
    phrases = ["released under the terms of the apache license version 2 0", "spdx license identifier mit", "gnu general public license version 3", "licensed under the mit license or the apache license version 2", "cc by nc"]
    more = [(i, f"{'x ' * i}{a} and {b} {a}") for i, (a, b) in enumerate((a, b) for a in phrases for b in phrases)]
    texts = [(d["doc_id"], d["text"]) for d in docs if len(d["text"] or "") < 100_000] + more
    made = license_rules.scan_licenses(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert len(made) == len(texts) and sum(len(r["detections"]) > 0 for r in made) >= len(more)
    for r in made:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        line = b" " + b" ".join(w.encode() for w in words) + b" "
        hits = sorted(((-rule.priority, m.start() - m.end(), m.start(), k, m.end(), rule) for k, rule, p in own for m in p.finditer(line)), key=lambda h: h[:4])
        kept = []
        for h in hits:
            if not any((a[2] <= h[2] and h[4] <= a[4]) or (h[2] <= a[2] and a[4] <= h[4]) for a in kept):
                kept.append(h)
        number = lambda at: line[:at].count(b" ") - 1
        # the rules of one form of a name differ only in the word that gates them, so their own name isn't compared
        want = sorted((number(h[2]), number(h[4] + 1), h[5].label, h[5].priority) for h in kept)
        assert sorted((x["start"], x["end"], x["label"], x["priority"]) for x in r["detections"]) == want
        assert r["score"] == (1.0 if r["base"] else max((h[5].confidence for h in kept), default=0.0))


def water(sizes, weights=(5, 2, 1), cap=3):
    """Targets by pouring: what a source can't take goes to the others."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(full.values())
        over = [s for s in free if left * w[s] / sum(w[x] for x in free) > cap * sizes[s] + 1e-9]
        if not over:
            return full | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        full |= {s: cap * sizes[s] for s in over}


def test_op8(spark, small):
    path, docs = small
    made = source_mix.op8_source_mix(spark, path).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for d in docs:
        sizes[d["source"]] += size(d["text"])
    aims = water(sizes)
    source = {(d["doc_id"], size(d["text"])): d["source"] for d in docs}
    taken, largest = Counter(), Counter()
    for r in made:
        s = source[(r["doc_id"], r["size"])]
        assert r["source_size"] == sizes[s] and abs(r["target"] - aims[s]) < 1e-6 * max(1, aims[s]) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert len(made) == len(docs) and all(abs(taken[s] - aims[s]) <= largest[s] / 2 + 1 for s in aims)
    assert sorted(map(tuple, source_mix.op8_source_mix(spark, path).collect()), key=repr) == sorted(map(tuple, made), key=repr)
    caps = {"a": 1000, "b": 5, "c": 7, "d": 300, "e": 1, None: 40, "f": 0}
    rows = spark.createDataFrame(list(caps.items()), "source string, source_size bigint")
    assert {r["source"]: round(r["target"], 6) for r in source_mix.targets(rows).collect()} == {s: round(float(t), 6) for s, t in water(caps).items()}


def test_inclusion_adds_up_to_what_is_drawn(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, "w " * rng.randint(0, 90), f"s{i % 5}") for i in range(3000)], "doc_id bigint, text string, source string")
    for r in source_mix.pareto_mix(docs).groupBy("source").agg(F.sum(F.col("inclusion") * F.col("size")).alias("p"), F.first("target").alias("t"), F.first("source_size").alias("s")).collect():
        assert abs(r["p"] - (r["t"] - math.floor(r["t"] / r["s"] + 1e-9) * r["s"])) < 0.01 * r["t"] + 1


def test_op9(spark, small):
    path, docs = small
    made = langid_ppm.op9_language_id(spark, path).collect()
    assert Counter(r["doc_id"] for r in made) == Counter(d["doc_id"] for d in docs)
    known = {d["lang"] for d in docs if d["lang"]}
    text = {d["doc_id"]: d["text"] for d in docs}
    for r in made:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not has_letter(text[r["doc_id"]] or "")) and r["lang_pred"] in known | {"und"}


def plain_bits(counts, order, data):
    """Code length of bytes by partial matching: counts of each context of 0 to ``order`` bytes."""
    known = {}

    def cost(context, byte):
        if (context, byte) not in known:
            seen = counts.get(context)
            lower = 8.0 if not context and (not seen or byte not in seen) else None
            if seen and byte in seen:
                made = -math.log2(seen[byte] / (sum(seen.values()) + len(seen)))
            else:
                lower = cost(context[1:], byte) if lower is None else lower
                made = lower - math.log2(len(seen) / (sum(seen.values()) + len(seen))) if seen else lower
            known[context, byte] = made
        return known[context, byte]

    padded = b" " * order + data
    return sum(cost(padded[i : i + order], padded[i + order]) for i in range(len(data)))


def test_op9_rows_against_plain_python(spark, small):
    path, docs = small
    order = langid_ppm.ORDER
    learned = {(d["lang"], d["text"]) for d in docs if d["lang"] is not None and d["text"] is not None and zlib.crc32(str("" if d["doc_id"] is None else d["doc_id"]).encode()) % 4 != 2}
    counts = {lang: {} for lang in sorted({lang for lang, _ in learned})}
    for lang, text in learned:
        data = b" " * order + langid_ppm.normal(text)
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[lang].setdefault(data[i - k : i], Counter())[data[i]] += 1
    text = {d["doc_id"]: d["text"] for d in docs}
    tried = 0
    for r in langid_ppm.op9_language_id(spark, path).collect():
        own = text[r["doc_id"]] or ""
        if not has_letter(own):
            assert (r["lang_pred"], r["score"], r["bits_per_byte"]) == ("und", 0.0, None)
            continue
        data = langid_ppm.normal(own)
        bits = {lang: plain_bits(c, order, data) for lang, c in counts.items()}
        best = min(sorted(bits), key=bits.get)
        tried += 1
        assert r["lang_pred"] == best and abs(r["bits_per_byte"] - bits[best] / len(data)) < 1e-4
        assert abs(r["score"] - 1 / sum(2.0 ** max(bits[best] - b, -1000) for b in bits.values())) < 0.02
    assert tried > 20


def test_training_follows_the_stated_risk(monkeypatch):
    """Steps of ``train`` against numeric gradients of the non-negative risk, on both of its sides."""
    monkeypatch.setattr(toxicity_pu, "STEPS", 0)
    rng = np.random.default_rng(8)
    width, prior, rounds, rate, decay = 6, 0.6, 40, 0.1, 1e-5
    p = [rng.choice(3, size=4) for _ in range(20)]
    u = [np.append(rng.integers(0, width, size=5), 3) for _ in range(30)]
    bag = lambda rows: np.stack([np.bincount(r, minlength=width) for r in rows]).astype(float)
    xp, xu, loss = bag(p), bag(u), lambda z: 1 / (1 + np.exp(z))

    def clean(v):
        return loss(-(xu @ v[:-1] + v[-1])).mean() - prior * loss(-(xp @ v[:-1] + v[-1])).mean()

    def objective(v, side):
        return prior * loss(xp @ v[:-1] + v[-1]).mean() + clean(v) if side else -clean(v)

    v, past, sides = np.append(np.zeros(width), math.log(prior / (1 - prior))), np.full(width + 1, 1e-4), Counter()
    for _ in range(rounds):
        side = clean(v) >= 0
        sides[bool(side)] += 1
        g = np.array([(objective(v + e, side) - objective(v - e, side)) / 2e-6 for e in 1e-6 * np.eye(width + 1)]) + decay * np.append(v[:-1], 0)
        past += g * g
        v = v - rate * g / np.sqrt(past)
    w, bias = toxicity_pu.train(p, u, width, prior, rounds=rounds, batch=64, rate=rate, decay=decay)
    assert np.allclose(np.append(w, bias), v, atol=1e-4) and sides[True] > 2 and sides[False] > 2


def test_extra_columns_with_internal_names(spark, small):
    """Whatever an extra column is named, it comes back as it was, and the results are those without it."""
    docs = spark.read.parquet(f"{small[0]}/documents.parquet").where("doc_id is not null")
    names = ["unit", "at", "rest", "closer", "_s", "own", "law", "m", "q", "cut", "no", "th", "_th", "_key", "_no", "_u", "_b", "_k", "_p", "_o", "_cuts", "id", "node", "bin", "step", "level", "key", "times", "copy", "a.b", "x`y", "Score", "SIZE", "Shard", "ids", "kept_0"]
    odd = docs.select("*", *[F.concat_ws(":", F.lit(n), "doc_id").alias(n) for n in names])
    def same(made, replaced=()):
        wrong = [F.coalesce(F.col(common.quoted(n)) != F.concat_ws(":", F.lit(n), "doc_id"), F.lit(True)) for n in names if n.lower() not in replaced]
        assert list(made.agg(*[F.count_if(w) for w in wrong]).first()) == [0] * len(wrong)

    mixed = source_mix.pareto_mix(odd)
    same(mixed, ("size",))
    plain = source_mix.pareto_mix(docs)
    assert sorted(r[:] for r in mixed.select("doc_id", "copies").collect()) == sorted(r[:] for r in plain.select("doc_id", "copies").collect())
    dealt = shard_shuffle.shuffle_into_shards(odd, ["doc_id"])
    same(dealt, ("shard",))
    assert sorted(r[:] for r in dealt.select("doc_id", "shard", "slot").collect()) == sorted(r[:] for r in shard_shuffle.shuffle_into_shards(docs, ["doc_id"]).select("doc_id", "shard", "slot").collect())
    kept = ngram_join.keep_one(odd)
    same(kept)
    assert kept.columns == odd.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r["doc_id"] for r in ngram_join.keep_one(docs).collect())
    same(sentencepiece_codec.encode_decode(odd.where("doc_id < 20"), sentencepiece_codec.default_model()), ("ids",))


def test_pipeline_against_plain_python(spark, small):
    import corpus_pipeline

    path, _ = small
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({n: F.concat_ws(":", F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("None"))) for n in ("rest", "unit", "Score", "copy", "_th")})
    rows, ids = docs.collect(), lambda d: sorted(((r["doc_id"], r["text"]) for r in d), key=repr)
    model = toxicity_pu.learn(docs, spark.read.parquet(f"{path}/labels.parquet"))
    after = common.materialize(corpus_pipeline.toxicity(spark, docs, path))
    assert after.columns == docs.columns and ids(after.collect()) == ids(r for r in rows if model.score(r["text"]) < 0.5)
    docs, rows = after, after.collect()
    after = common.materialize(corpus_pipeline.language_id(spark, docs, path))
    trees = langid_ppm.learn(docs)
    def speaks(text):
        if not text or not has_letter(text) or not langid_ppm.normal(text):
            return False
        data = langid_ppm.normal(text)
        return trees.code_lengths(data).astype(float).sum(axis=0).min() / len(data) < 8
    assert after.columns == docs.columns and ids(after.collect()) == ids(r for r in rows if speaks(r["text"]))
    docs, rows = after, after.collect()
    after = common.materialize(corpus_pipeline.near_duplicates(spark, docs, path))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (WORD.findall(r["text"]) for r in rows)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                group = [group[j] if g == group[i] else g for g in group]
    left = {min((rows[k]["doc_id"] is None, rows[k]["doc_id"] or 0) for k in range(len(rows)) if group[k] == g) for g in set(group)}
    assert after.columns == docs.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in after.collect()) == sorted(left)
    docs, rows = after, after.collect()
    after = common.materialize(corpus_pipeline.mix(spark, docs, path))
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
        most[r["source"]] = max(most[r["source"]], len(WORD.findall(r["text"])))
    for r in after.collect():
        taken[r["source"]] += len(WORD.findall(r["text"]))
        assert r["rest"] == f"rest:{r['doc_id']}" and r["Score"] == f"Score:{r['doc_id']}"
    assert after.columns == docs.columns and max(Counter(r["doc_id"] for r in after.collect()).values()) <= 3
    assert all(abs(taken[s] - t) <= most[s] / 2 + 1 for s, t in water(sizes).items())
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    for r in corpus_pipeline.tokens(spark, after, path).join(after.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r["ids"] == library.encode(r["text"]) and r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == sha(library.decode(r["ids"]))


def test_pipeline_on_empty_and_null_rows(spark, tmp_path):
    import corpus_pipeline

    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for name, rows in (("none", []), ("null", [(1, None, None, None, None), (None, "", None, None, None), (None, None, None, None, None)])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == 0


def test_any_finite_vector_takes_part(spark):
    rows = [(20, [1e200, 1.0]), (21, [-1e200, 2.0]), (22, [1e-200, 1e-200]), (40, [3.0, 4.0]), (41, [3.0, 4.0]), (42, [float("inf"), 1.0]), (60, [1.0, 2.0, 3.0]), (61, [1.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    made = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in vptree.nearest(v, v.where("vec_id % 20 = 0"), factor=1.0).collect())
    assert [x for x in made if x[0] == 40] == [(40, 1, 20), (40, 2, 41), (40, 3, 22), (40, 4, 21)]
    assert [x for x in made if x[0] == 60] == [(60, 1, 61)] and len(made) == 9
    assert vptree.nearest(v.limit(0), v.limit(0)).count() == 0


def test_repeated_vectors_and_ids(spark):
    rows = [(20, [1.0, 0.0])] * 3 + [(21, [1.0, 1.0])] * 2 + [(22, [0.5, 0.0]), (20, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    made = vptree.nearest(v, v.where("vec_id = 20 and embedding[0] = 1"), k=10, factor=1.0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in made] == [(20, 1.0), (20, 1.0), (21, 1.0), (21, 1.0), (22, 0.5), (20, 0.0)]


def test_recall_over_shards(spark, monkeypatch):
    """Several shards against brute force: exact at factor 1, recall at the production factor, and rows left out."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7000:7040] = x[3]
    truth = {q: sorted((i for i in range(len(x)) if i != q), key=lambda i, s=x @ x[q]: (-s[i], i))[:20] for q in range(0, 12000, 400)}
    monkeypatch.setattr(vptree, "SHARD_BYTES", 2 << 20)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    for factor, least in ((1.0, 0.9999), (vptree.FACTOR, 0.9)):
        found: dict = {}
        for r in vptree.nearest(v, v.where("vec_id % 400 = 0"), factor=factor).collect():
            found.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert np.mean([len(found[q] & set(t)) / 20 for q, t in truth.items()]) >= least
    tree = vptree.VantagePointTree(x)
    tree.search(x[::100], 21, vptree.FACTOR)
    assert tree.visited < 0.85 * 120 * len(x)


def test_cells_leave_out_most_of_clustered_vectors(spark, monkeypatch):
    """Cells are visited only where the triangle inequality allows a neighbour: exact at factor 1, few cells beyond it."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(40, size=3000)] + 0.15 * rng.normal(size=(3000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1000:1040] = x[0]
    monkeypatch.setattr(vptree, "SHARD_BYTES", 24 << 10)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(5000 + i, [1.0 + i, 2.0]) for i in range(5)], "vec_id bigint, embedding array<double>")
    asked = v.where("vec_id % 100 = 0")
    for factor, least in ((1.0, 1.0), (None, 0.9)):
        found: dict = {}
        for r in vptree.nearest(v, asked, factor=factor).orderBy("query_id", "rank").collect():
            found.setdefault(r["query_id"], []).append(r["vec_id"])
        truth = {q: sorted((i for i in range(len(x)) if i != q), key=lambda i, s=(x * x[q]).sum(axis=1): (-s[i], i))[:20] for q in range(0, 3000, 100)}
        truth[5000] = [5004, 5003, 5002, 5001]
        assert set(found) == set(truth) and np.mean([len(set(found[q]) & set(t)) / len(t) for q, t in truth.items()]) >= least
        if factor == 1:
            assert found == truth
    own = vptree.usable(v, "vec_id", "embedding").selectExpr("size(v) as dim", "xxhash64(size(v), v) as h", "v", "vec_id", "array_max(transform(v, x -> abs(x))) as largest")
    layout = vptree._layout(own, 20, None)
    assert list(layout) == [16, 2] and len(layout[16].centres) == 16
    cell, far = layout[16].deal(x, False)
    layout[16].radius = np.array([far[cell == c].max(initial=-np.inf) for c in range(16)])
    q = x[::100]
    kth = np.sort(q @ x.T, axis=1)[:, -21]
    for factor, most in ((1.0, 1.0), (vptree.FACTOR, 0.5)):
        layout[16].factor = factor
        reached = layout[16].reached(q, kth)
        assert sum(map(len, reached)) <= most * 16 * len(q)
        if factor == 1:
            assert all(set(cell[np.flatnonzero(x @ q[n] >= kth[n])]) <= set(c) for n, c in enumerate(reached))


def test_op5_over_a_table_of_odd_rows(spark, tmp_path):
    """The registered query against brute force: null, empty, short, zero and infinite vectors, a null id, clashing columns."""
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=6).tolist(), i, f"s{i}") for i in range(300)]
    rows += [(320, None, 0, ""), (340, [], 0, None), (360, [0.0] * 6, 0, ""), (380, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, ""), (400, [float("inf")] + [1.0] * 5, 0, ""), (None, [1.0] * 6, 0, ""), (420, [2.0, 1.0], 0, ""), (421, [1.0, 1.0], 0, "")]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, slot int, dim string").write.parquet(f"{tmp_path}/embeddings.parquet")
    good = {r[0]: np.array(r[1]) for r in rows[:300] + rows[-2:]}
    got: dict = {}
    for r in vptree.op5_vptree(spark, str(tmp_path)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {q for q in good if q % 20 == 0}
    hits = total = 0
    for q, found in got.items():
        score = {i: float(np.einsum("ij,ij->i", good[q][None], v[None])[0]) for i, v in good.items() if i != q and len(v) == len(good[q])}
        truth = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert [n for n, _, _ in found] == list(range(1, len(truth) + 1)) and all(s == score[i] for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits, total = hits + len(set(truth) & {i for _, i, _ in found}), total + len(truth)
    assert hits >= 0.9 * total
    spark.createDataFrame([], "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert vptree.op5_vptree(spark, f"{tmp_path}/none").count() == 0


def test_replica_keeps_the_order_of_the_archive(spark):
    rows = [(7, "u", "x" * 20 + str(k)) for k in range(30)] + [(None, None, None), (None, None, "y"), (7, "u", "x" * 20 + "3")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    spoilt = F.when(F.col("html").endswith("x5"), F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    left, right = warc_fixity.replicas(pages, [F.col("html"), spoilt], 2)
    made = warc_fixity.audit(left, right).collect()
    assert [(r["page_id"], r["fault"]) for r in made] == [(7, "changed")] and left.count() == 33
    empty = pages.limit(0)
    assert warc_fixity.audit(*warc_fixity.replicas(empty, [F.col("html"), spoilt], 1)).count() == 0


def test_hash_bounds():
    assert ngram_join.banding() == (51, 8)
    with pytest.raises(ValueError, match="hashes"):
        ngram_join.banding(hashes=5000)

"""Many equal rows: results stay whole, and no task gets them all."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.llm import ngram_join, shard_shuffle, warc_fixity

MANY = 60_000


def test_equal_rows_are_dealt_evenly(spark, monkeypatch):
    hot = spark.range(MANY).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x").alias("m"), F.col("id").alias("Q"))
    rest = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("y").alias("m"), F.lit(-1).cast("long").alias("Q"))
    dealt = shard_shuffle.shuffle_into_shards(hot.union(rest), ["doc_id", "m"]).cache()
    assert dealt.columns == ["doc_id", "m", "Q", "shard", "slot"]
    assert dealt.where("Q >= 0").select("Q").distinct().count() == MANY
    per = {r["shard"]: (r["n"], r["low"], r["high"], r["d"], r["hot"]) for r in dealt.groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("d"), F.sum((F.col("Q") >= 0).cast("int")).alias("hot")).collect()}
    assert sorted(per) == list(range(16))
    assert all(n - (MANY + 1000) // 16 in (0, 1) and low == 0 and high == n - 1 and d == n for n, low, high, d, _ in per.values())
    # as many of the equal rows in each shard as a uniform shuffle gives, within six standard deviations of the law
    assert all(abs(h - MANY / 16) < 6 * (MANY / 16 * 1000 / (MANY + 1000)) ** 0.5 for *_, h in per.values())
    # rows that aren't hot are dealt by their key alone
    monkeypatch.setattr(shard_shuffle, "HOT_ROWS", 10 * MANY)
    again = shard_shuffle.shuffle_into_shards(rest.repartition(7), ["doc_id", "m"]).select("doc_id", "shard", "slot")
    first = shard_shuffle.shuffle_into_shards(rest, ["doc_id", "m"]).select("doc_id", "shard", "slot")
    assert sorted(again.collect()) == sorted(first.collect())


def test_equal_pages_spread_over_files(spark, tmp_path):
    one = spark.range(5000).select(F.lit(4).cast("long").alias("page_id"), F.lit("http://a").alias("url"), F.lit("<p>same</p>").alias("html"))
    rest = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://b/"), "id").alias("url"), F.concat(F.lit("<p>"), "id").alias("html"))
    none = spark.range(600).select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    pages = one.union(rest).union(none)
    made = warc_fixity.records(pages, 17)
    assert made.count() == 8600
    assert made.where("page_id = 4").select("file").distinct().count() > 5
    assert made.groupBy("file").agg((F.max("no") + 1 == F.count("*")).alias("ok")).where("not ok").count() == 0
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    found = warc_fixity.op2_warc_fixity(spark, str(tmp_path))
    names = sorted(found.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({warc_fixity.ORACLE})").fetchall()
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.select(*names).collect()), key=order) == sorted(want, key=order)
    assert len(want) > 0


@pytest.mark.parametrize("seen", [100_000, 1])
def test_repeated_documents_beside_a_near_copy(spark, monkeypatch, seen):
    monkeypatch.setattr(ngram_join, "SEEN", seen)
    text = " ".join(f"w{k}" for k in range(60))
    same = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    few = spark.createDataFrame([(2, text + " more"), (3, "another text of some words"), (None, text), (None, text)], "doc_id long, text string")
    found = ngram_join.similar_documents(same.union(few)).groupBy("doc_id", "class_id", "n_links", "n_class").count().collect()
    assert sorted(map(tuple, found), key=str) == sorted([(1, 1, 20_002, 20_003, 20_000), (2, 1, 20_002, 20_003, 1), (None, 1, 20_002, 20_003, 2), (3, 3, 0, 1, 1)], key=str)


def test_repeats_go_before_the_shuffle(spark):
    rows = spark.range(0, 50_000, 1, 4).select(F.lit(1).cast("long").alias("key"), F.lit(False).alias("no_key"), F.lit(5).cast("long").alias("th"), F.lit("a b c").alias("text"))
    assert ngram_join.without_repeats(rows).count() <= 4

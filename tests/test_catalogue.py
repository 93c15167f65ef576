"""The catalogue source: shards, keys, time limits and broken answers."""

import os
import time

from pyspark.sql import functions as F

from provenia.sources import catalogue as c

SHARDS = 8


def build(spark, tmp_path, n=60):
    rows = [(f"https://doi.org/10.1/X{k}", f"Title, No. {k}") for k in range(n)] + [(None, "Only a title"), ("10.9/none", None), (None, None), ("10.1/x0", "Another title")]
    df = spark.createDataFrame(rows, "doi string, title string")
    assert c.write_catalogue(df, f"file://{tmp_path}/c", SHARDS) == SHARDS
    return f"file://{tmp_path}/c"


def statuses(spark, path, rows, **how):
    records = spark.createDataFrame(rows, "k int, doi string, title string")
    return {r.k: (r.status, r.method, r.matched_title) for r in c.looked_up(records, c.read_catalogue(spark, path, SHARDS, **how), SHARDS).collect()}


ROWS = [(0, "DOI: 10.1/x7", None), (1, None, "title no 9"), (2, "10.1/unknown", "title no 9"), (3, " ", " "), (4, None, "ONLY a title!"), (5, "10.9/NONE", None), (6, None, "no such title"), (7, "10.1/x0", None)]


def test_records_are_looked_up(spark, tmp_path):
    path = build(spark, tmp_path)
    want = {0: ("verified", "doi", "Title, No. 7"), 1: ("verified", "title", "Title, No. 9"), 2: ("not_found", "doi", None), 3: ("unresolvable", None, None), 4: ("verified", "title", "Only a title"), 5: ("verified", "doi", None), 6: ("not_found", "title", None), 7: ("verified", "doi", "Another title")}
    assert statuses(spark, path, ROWS) == want
    keys = [r.k for r in spark.createDataFrame(ROWS, "k int, doi string, title string").select(c.key_of(F.col("doi"), F.col("title")).alias("k")).collect() if r.k]
    asked = c.read_catalogue(spark, path, SHARDS, keys)
    assert asked.rdd.getNumPartitions() == len({c.shard_of(k, SHARDS) for k in keys}) and statuses(spark, path, ROWS, keys=keys) == want
    assert {r.key: r.http_status for r in asked.where("key is not null").collect()} == {k: 404 if "unknown" in k or "such" in k else 200 for k in keys}
    assert statuses(spark, path, ROWS[:0]) == {} and c.read_catalogue(spark, path, SHARDS, []).collect() == []


def test_shards_that_do_not_answer(spark, tmp_path):
    path = build(spark, tmp_path)
    keys = {k: f"doi:10.1/x{k}" for k in range(60)}
    by = {}
    for k, key in keys.items():
        by.setdefault(c.shard_of(key, SHARDS), k)
    broken, missing, slow, fine = sorted(by)[:4]
    (tmp_path / "c" / f"{broken}.jsonl").write_text('{"key": "doi:10.1')
    (tmp_path / "c" / f"{missing}.jsonl").unlink()
    (tmp_path / "c" / f"{slow}.jsonl").unlink()
    os.mkfifo(tmp_path / "c" / f"{slow}.jsonl")  # opens when a writer comes, and none does
    began = time.monotonic()
    got = statuses(spark, path, [(s, f"10.1/x{by[s]}", None) for s in (broken, missing, slow, fine)], timeout=1.5)
    assert {s: got[s][0] for s in got} == {broken: "unavailable", missing: "unavailable", slow: "unavailable", fine: "verified"}
    assert time.monotonic() - began < 60


def test_filters_are_pushed_where_the_session_allows(spark, tmp_path):
    path, key = build(spark, tmp_path), "doi:10.1/x3"
    spark.conf.set(c._PUSHDOWN, "true")
    try:
        df = c.read_catalogue(spark, path, SHARDS).where(F.col("key") == key)
        assert df.rdd.getNumPartitions() == 1 and [(r.key, r.http_status) for r in df.collect()] == [(key, 200)]
        both = c.read_catalogue(spark, path, SHARDS).where(F.col("key").isin(key, "doi:none"))
        assert {r.key: r.http_status for r in both.collect()} == {key: 200, "doi:none": 404}
    finally:
        spark.conf.unset(c._PUSHDOWN)
    whole = c.read_catalogue(spark, path, SHARDS)
    assert whole.rdd.getNumPartitions() == SHARDS and whole.where(F.col("key") == key).count() == 1

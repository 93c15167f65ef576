"""The segmented index against a scan of the passages."""

import random

import pytest
from pyspark.sql import functions as F

from provenia.operators import index, search

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omicron upsilon quantum quantums gardens garden gardening".split()


def passages(spark, n, seed=1, sources=7, words=WORDS):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 30)))
        s = f"s{k % sources}"
        rows.append((f"{s}:p{k}", s, text, f"Title of {s} {rng.choice(words)}", None if k % 5 == 0 else "/en"))
    return spark.createDataFrame(rows, "node_id string, source_id string, text string, title string, section_path string")


def rows(df):
    return [(r.node_id, r.source_id, round(r.score, 5)) for r in df.collect()]


def counts(df):
    return sorted(tuple(r) for r in df.select("field", "term", "passages", "occurrences").collect())


QUERIES = ["alpha", "alpha beta", "upsilon quantum", "quant", "gardn", "alpha gardnes thta", "title s3", "nothinglikeit", "", "omicro upsilom"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    n = passages(spark, 400).cache()
    return n, index.build_index(n, f"file://{tmp_path_factory.mktemp('index')}")


@pytest.mark.parametrize("query", QUERIES)
def test_search_equals_a_scan(small, query):
    n, built = small
    for limit, some in ((1, [{}]), (10, [{}, {"fuzzy": False}, {"fuzzy": False, "prefix": False}]), (None, [{}])):
        for how in some:
            want = search.ranked_search(n, query, limit, fields=search.FIELDS, **how)
            got = built.search(query, limit, **how)
            assert sorted(rows(got)) == sorted(rows(want)) if limit is None else rows(got) == rows(want)


def test_search_of_one_field_and_other_weights(small):
    n, built = small
    r = search.Ranking(k=2.0, b=0.1, d=0.2, fuzzy=0.4, fuzzy_weight=0.9)
    for query in ("alpha title", "gmma garden"):
        assert rows(built.search(query, 10, r=r, fields=("text",))) == rows(search.ranked_search(n, query, 10, r=r, fields=("text",)))


def test_many_matching_terms_are_joined(small, monkeypatch):
    n, built = small
    monkeypatch.setattr(index, "PUSHED", 2)
    assert built.plan("alpha garden quant") is None
    assert rows(built.search("alpha garden quant")) == rows(search.ranked_search(n, "alpha garden quant", fields=search.FIELDS))


def test_blocks_below_the_threshold_are_not_read(spark, tmp_path):
    n = passages(spark, 6000, seed=3, sources=50, words=WORDS[:12])
    built = index.build_index(n, f"file://{tmp_path}", ("text",))
    plan = built.plan("alpha", 10, fuzzy=False, prefix=False)
    assert plan.all > 4000 and plan.read * 5 <= plan.all
    assert rows(built.search("alpha", 10, fuzzy=False, prefix=False)) == rows(search.ranked_search(n, "alpha", 10, fuzzy=False, prefix=False))
    seen = built.part("blocks").where("term = 'alpha'").agg(F.max("n"), F.sum("n")).first()
    assert seen[0] <= index.BLOCK and seen[1] == plan.all
    both = built.plan("alpha kappa", 10, fuzzy=False, prefix=False)
    assert both.read < both.all and rows(built.search("alpha kappa", 10, fuzzy=False, prefix=False)) == rows(search.ranked_search(n, "alpha kappa", 10, fuzzy=False, prefix=False))


def test_a_common_word_of_the_documents_is_hardly_read(spark, tmp_path):
    from provenia.sources.tables import nodes_of

    nodes = nodes_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    built = index.build_index(nodes, f"file://{tmp_path}", ("text",))
    plan = built.plan("the", 10, fuzzy=False, prefix=False)
    assert plan.read * 5 <= plan.all


def test_index_kept_up_equals_a_fresh_one(spark, tmp_path):
    n = passages(spark, 600, seed=5, sources=12).cache()
    part = F.pmod(F.xxhash64("node_id"), F.lit(3))
    now = index.SearchIndex(spark, f"file://{tmp_path}/kept")
    for k in range(3):
        now = now.add(n.where(part == k))
    now = now.delete(["s1", "s2", "none"]).delete(n.where("source_id = 's5'").select("source_id"))
    newer = n.where("source_id = 's2'").withColumn("text", F.concat("text", F.lit(" upsilon upsilon")))
    now = now.add(newer).delete(["s7"])
    left = n.where("source_id NOT IN ('s1', 's2', 's5', 's7')").unionByName(newer)
    fresh = index.build_index(left, f"file://{tmp_path}/fresh")
    for kept in (now, now.merged(2), now.merged(4)):
        assert kept.figures() == fresh.figures() and counts(kept.terms()) == counts(fresh.terms())
        for query in ("alpha", "upsilon quantum", "gardn", "title s3"):
            assert rows(kept.search(query)) == rows(fresh.search(query)) == rows(search.ranked_search(left, query, fields=search.FIELDS))
    assert len(now.segments) == 4 and len(now.merged(2).segments) < 4
    assert rows(now.merged(2).delete(["s3"]).search("alpha")) == rows(search.ranked_search(left.where("source_id <> 's3'"), "alpha", fields=search.FIELDS))


def test_upkeep_reads_no_old_text(spark, tmp_path, monkeypatch):
    n = passages(spark, 60)
    built = index.build_index(n, f"file://{tmp_path}")
    cut = []
    monkeypatch.setattr(index, "_forward", lambda nodes, fields, real=index._forward: cut.append(nodes.count()) or real(nodes, fields))
    more = passages(spark, 5, seed=9).withColumn("source_id", F.lit("new")).withColumn("node_id", F.concat(F.lit("new"), "node_id"))
    after = built.add(more).delete(["s1"]).merged(1 << 20).merged(2)
    assert cut == [5] and after.search("alpha").count() > 0
    unused = {s.name for s in built.segments} - {s.name for s in after.segments}
    after.drop_unused()
    assert not any((tmp_path / name).exists() for name in unused) and after.search("alpha").count() > 0


def test_empty_indexes(spark, tmp_path):
    none = index.SearchIndex(spark, f"file://{tmp_path}/a")
    assert none.search("alpha").collect() == [] and none.delete(["x"]) == none and none.merged() == none
    n = passages(spark, 20)
    empty = index.build_index(n.limit(0), f"file://{tmp_path}/b")
    assert empty.search("alpha").collect() == [] and rows(empty.add(n).search("alpha")) == rows(search.ranked_search(n, "alpha", fields=search.FIELDS))
    gone = index.build_index(n, f"file://{tmp_path}/c").delete([f"s{k}" for k in range(7)])
    assert gone.search("alpha gamma").collect() == [] and gone.terms().collect() == []


def test_fuzzy_lookup_is_by_equality(small):
    _, built = small
    for word in ("gardens", "thta", "gardeninf", "upsilonn"):
        found = {r.term for r in built._candidates([word], search.Ranking(), True, False).collect()}
        most = round(0.2 * len(word))
        near = {r.term for r in built.part("strata").where(F.levenshtein("term", F.lit(word), most) >= 0).collect()}
        assert near <= found and near
    plan = built._candidates(["gardens"], search.Ranking(), True, False)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(form" in plan and "levenshtein" not in plan


def test_forms_with_characters_left_out(spark):
    terms = spark.createDataFrame([("a",), ("ab",), ("gardens",), ("日本語です",)], "term string")
    got = {}
    for r in index.variants(terms).collect():
        got.setdefault(r.term, set()).add(r.form)
    for term, forms in got.items():
        most = 2 if len(term) >= index.TWO_OUT else 1
        want = spark.createDataFrame([(f,) for f in index.shortened_forms(term, most)], "f string").select(F.xxhash64("f").alias("f"))
        assert forms == {r.f for r in want.collect()}


def test_impacts_under_another_mean():
    rng = random.Random(8)
    r = search.Ranking()
    for _ in range(2000):
        tf, size, mean, now = rng.randint(1, 50), rng.randint(1, 400), rng.uniform(1, 200), rng.uniform(1, 200)
        x, y = (tf / (tf + r.k * (1 - r.b + r.b * size / m)) for m in (mean, now))
        low, high = index.moved_impact(x, mean, now)
        assert low - 1e-12 <= y <= high + 1e-12


def test_terms_are_counted_without_rows_of_terms_in_a_shuffle(spark, tmp_path):
    n = passages(spark, 50)
    plan = index._forward(n, search.FIELDS)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan
    built = index.build_index(n, f"file://{tmp_path}")
    made = lambda: {x.name for x in (tmp_path / built.segments[0].name).iterdir()}
    assert made() == {"forward"}
    assert built.search("alpha", fuzzy=False).count() == 10 and made() == {"forward", "blocks", "strata"}
    assert built.search("gardn").count() == 10 and made() == {"forward", "blocks", "strata", "variants"}


def test_runs_of_postings_and_passages_twice(spark, tmp_path, monkeypatch):
    n = passages(spark, 300)
    n = n.unionByName(n.where("source_id = 's1'")).unionByName(n.where("source_id = 's1'").withColumn("text", F.concat("text", F.lit(" alpha"))))
    monkeypatch.setattr(index, "GROUPED", 40)
    monkeypatch.setattr(index, "BLOCK", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        built = index.build_index(n, f"file://{tmp_path}")
        for query in ("alpha", "upsilon quantum", "gardn"):
            assert rows(built.search(query)) == rows(search.ranked_search(n, query, fields=search.FIELDS))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_merges_that_lead_to_others_write_once(spark, tmp_path, monkeypatch):
    now, merges = index.SearchIndex(spark, f"file://{tmp_path}", ("text",)), []
    for k, size in enumerate((8, 8, 16, 32)):
        now = now.add(spark.range(size).selectExpr(f"'{k}:' || id AS node_id", f"'s{k}' AS source_id", "'w' || id AS text").coalesce(1))
    monkeypatch.setattr(index.SearchIndex, "_merge", lambda self, some, real=index.SearchIndex._merge: merges.append(len(some)) or real(self, some))
    after = now.merged(2)
    assert merges == [4] and len(after.segments) == 1 and counts(after.terms()) == counts(now.terms())

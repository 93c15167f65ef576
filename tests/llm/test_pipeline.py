"""The pipeline against brute force, stage by stage."""

import random
import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tests.llm.test_dedup import brute_cut, classes, fingerprint  # noqa: E402


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("text", F.when(F.col("doc_id") == 3, F.lit("1 2 3")).otherwise(F.col("text")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = now.columns
    stages = [f for _, f in corpus_pipeline.STAGES]

    known = stages[0](spark, now, str(tmp_path))
    lost = {r.doc_id for r in now.collect()} - {r.doc_id for r in known.collect()}
    assert known.columns == columns and 3 in lost and len(lost) <= 2
    rows = sorted((r.doc_id, r.text) for r in known.collect())

    seen, unique = set(), []
    for i, t in rows:
        if (k := re.sub(r"[\x20\x09-\x0D]+", " ", t)) not in seen:
            seen.add(k)
            unique.append((i, t))
    once = stages[1](spark, known, str(tmp_path))
    assert once.columns == columns and {r.doc_id for r in once.collect()} == {i for i, _ in unique}

    fp = {r.doc_id: fingerprint(r.text) for r in once.collect()}
    comp = classes([(a, b) for a in fp for b in fp if a < b and bin(fp[a] ^ fp[b]).count("1") <= 2], fp)
    apart = stages[2](spark, once, str(tmp_path))
    assert apart.columns == columns and {r.doc_id for r in apart.collect()} == {i for i in fp if comp[i] == i}

    left = sorted((r.doc_id, r.text) for r in apart.collect())
    cut = stages[3](spark, apart, str(tmp_path))
    got = {r.doc_id: r for r in cut.collect()}
    for (i, t), (_, _, n, kept) in zip(left, brute_cut(left, 50), strict=True):
        assert got[i].text == (kept if n else t) and got[i].n_chars == len(got[i].text)

    pieces = corpus_pipeline.run(spark, str(tmp_path))
    packed = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {p.doc_id for p in packed} == set(got) and all(p.n == p["all"] for p in packed)


def test_near_copies_without_ids(spark):
    long = " ".join(f"w{k}" for k in range(3000))
    rows = [(None, "a text of its own", "x"), (None, "known elsewhere", "x"), (7, "known elsewhere", "x"), (8, "another one", "x")]
    rows += [(None, long, "x"), (None, long, "y"), (None, long + " end", "x"), (None, long, "x")]
    near = bin(fingerprint(long) ^ fingerprint(long + " end")).count("1") <= 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted((str(g.doc_id), g.text, g.lang) for g in got if len(g.text) < 100) == [("7", "known elsewhere", "x"), ("8", "another one", "x"), ("None", "a text of its own", "x")]
    assert near and sum(len(g.text) >= 100 for g in got) == 1


def test_near_copies_under_one_id(spark):
    rows = [(5, "copied from three", "a"), (3, "copied from three", "b"), (5, "a text of its own", "c"), (9, "twice", "d"), (9, "twice", "d"), (9, None, "e"), (9, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted((g.doc_id, g.text or "") for g in got) == [(3, "copied from three"), (5, "a text of its own"), (9, ""), (9, "twice")]


WORDS = {"en": "the of and to in that is it for was on are with as they", "de": "der die und den von zu das mit sich des auf für ist im dem"}
PASSAGE = " ".join(f"passage{k}" for k in range(60))


def odd_documents():
    r = random.Random(3)
    text = lambda lang, n=40: " ".join(r.choice(WORDS[lang].split()) for _ in range(n))
    rows = [(k, text(lang), lang) for k, lang in enumerate(["en", "de"] * 30)]
    rows += [(100, rows[0][1], "en"), (101, rows[0][1], None), (None, text("en"), "en"), (None, text("de"), None), (102, None, "en"), (103, "", "de"), (None, None, None)]
    rows += [(104, text("en", 30_000), "en"), (105, text("en") + " " + PASSAGE, "en"), (None, text("de") + " " + PASSAGE, "de"), (106, PASSAGE + " " + text("en"), "en")]
    rows += [rows[2], rows[2], rows[62], (2, text("de"), "de")]
    return rows


@pytest.mark.parametrize("empty", [False, True])
def test_stages_take_odd_rows(spark, empty):
    """Nulls in all columns, empty and long texts, ties, repeated rows, clashing names, and no rows at all."""
    clash = "score string, kept int, h int, bucket string, fp string, removed int, start int, id string, component string, n_chars long"
    rows = [(*x, "s", 1, None, "b", "f", 2, 3, None, "c", None) for x in ([] if empty else odd_documents())]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, {clash}")
    now, names = docs, docs.columns
    texts = [sorted((str(r.doc_id), r.text or "") for r in now.collect())]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == names
        now = spark.createDataFrame(now.collect(), docs.schema)
        texts.append(sorted((str(r.doc_id), r.text or "") for r in now.collect()))
    pieces = corpus_pipeline.pack_sequences(spark, now, "").collect()
    if empty:
        assert texts == [[]] * 5 and pieces == []
        return
    known, once, apart, cut = texts[1:]
    assert not any(t == "" for _, t in known) and len(known) == sum(t != "" for _, t in texts[0])
    first = {}
    for i, t in sorted(known, key=lambda x: (x[0] == "None", int(x[0]) if x[0] != "None" else 0)):
        first.setdefault(t, i)
    assert once == sorted((i, t) for i, t in known if first[t] == i)
    assert set(apart) <= set(once) and len(apart) == len(set(apart)) and {t for _, t in apart} >= {t for _, t in once if len(t) > 1000}
    assert sum("None" == i for i, _ in cut) == sum("None" == i for i, _ in apart) == 3
    with_passage = [t for _, t in cut if "passage3 " in t]
    assert len(with_passage) == 1 and len(cut) == len(apart)
    assert sum(p.length for p in pieces if p.start == 0) and {str(p.doc_id) for p in pieces} == {i for i, _ in cut}

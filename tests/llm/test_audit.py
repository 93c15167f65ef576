"""Source divergence, fertility rules and vector codes against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from provenia.llm import fertility, vector_codes
from provenia.llm.fertility import fertility_rules
from provenia.llm.queries import QUERIES, vocabulary
from provenia.llm.source_divergence import share, source_divergence

SF = "/root/testdata/sf0.001"
PIECES, BYTES = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


# ---------------------------------------------------------------- source divergence


def divergence_by_hand(docs, top=200):
    """docs: (text, lang, source), in Python integers."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    docs = [([low(t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")], lang or "", source or "") for text, lang, source in docs]
    out = []
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        kept = {t for t, n in Counter(t for d in own for t in set(d[0])).items() if n >= 3}
        counts = {s: Counter(t for d in own if d[2] == s for t in d[0] if t in kept) for s in {d[2] for d in own}}
        whole = sum(counts.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        q = p(whole)
        for s, c in counts.items():
            mine = p(c)
            pair = [(sum(f(mine[t], p(o)[t]) for t in kept), other) for other, o in counts.items() if other != s]
            term = [(f(mine[t], q[t]), t) for t in kept if c[t] and mine[t] > q[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def test_divergence_matches_integers_by_hand(spark):
    rng = random.Random(3)
    words = ["Alpha", "alpha", "beta", "Ünder", "ünder", "日本", "x1y", "gamma-delta", "ÉTÉ", "𝔘ni"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "é", None])) for k in range(150)]
    rows += [(None, None, "en", "only null"), (5, "", "xx", "a"), (6, "once twice", "xx", "b"), (6, "once twice", "xx", "b"), (7, "solo", "yy", "a")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("term", F.lit(1)).withColumn("value", F.lit("v")).withColumn("item", F.lit(2.5))
    want = divergence_by_hand([r[1:] for r in rows])
    assert rows_of(source_divergence(docs)) == want
    assert ("xx", "a", "pair", "b", 0, 1) in want  # no kept term
    assert rows_of(source_divergence(docs, top=2)) == divergence_by_hand([r[1:] for r in rows], 2)
    assert source_divergence(docs.limit(0)).collect() == []


def test_divergence_of_a_hot_source_and_long_text(spark):
    rows = [(k, "same words here " * 5, "en", "hot") for k in range(60)] + [(100 + k, f"word{chr(97 + k % 5)} here", "en", f"s{k % 7}") for k in range(30)]
    rows.append((999, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}" for k in range(200_000)), "en", "long"))
    assert rows_of(source_divergence(spark.createDataFrame(rows, DOCS))) == divergence_by_hand([r[1:] for r in rows])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**12), st.integers(0, 10**13), st.integers(1, 10**6)), min_size=1, max_size=20))
def test_shares_are_exact(spark, figures):
    rows = [(n, n + more, terms) for n, more, terms in figures]
    got = spark.createDataFrame(rows, "n long, total long, terms long").select(share("n", "total", "terms").alias("p")).collect()
    assert [g.p for g in got] == [1 + 10**9 * (n + 1) // (total + terms) for n, total, terms in rows]


# ---------------------------------------------------------------- fertility


def base_by_hand(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    dup = sum(line in lines[:k] for k, line in enumerate(lines))
    counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside))
    return *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def measures_by_hand(text):
    ids = sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text)
    tokens = Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    chars = sum(c.isalnum() if ord(c) < 128 else True for c in text)
    k = max(len(ids) // 256, 1)
    at = lambda i: -(-i * len(ids) // k)
    total = 0.0
    for part in (ids[at(i) : at(i + 1)] for i in range(k)):
        n = len(part)
        total += n * (sum(c / n * math.log2(n / c) for c in Counter(part).values()) / math.log2(n) if n > 1 else 1.0)
    entropy = round(1000 * (total / len(ids) if ids else 1.0))
    return 1000 * chars // max(len(ids), 1), 1000 * chars // max(len(tokens), 1), 1000 * sum(map(sp.is_byte, ids)) // max(len(ids), 1), entropy


TEXTS = [None, "", "one", "a b c a b c", "x\n\n x\nx\n \n x\n", "# * $ ** <p> | & %", "ü ü ü ü", "日本語 のテキスト です", "tab\tsep\x0bwords\x0c\x1c still", "　wide space", "Привет мир " * 40, "word " * 300, "a" * 5000]


def test_base_counts_and_measures_match_brute_force(spark):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    got = {r.id: r for r in fertility_rules(spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string"), PIECES, BYTES).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        g = got[k]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == base_by_hand(t), t
        near = measures_by_hand(t or "")
        assert (g.chars_per_piece, g.chars_per_token, g.byte_share) == near[:3] and abs(g.entropy - near[3]) <= 1, t
    assert [got[k].script for k in (0, 2, 7, 10)] == ["none", "latin", "kana", "cyrillic"]


def test_bands_match_medians_by_hand(spark):
    rng = random.Random(5)
    values = [rng.randint(1900, 2100) for _ in range(151)] + [300] * 40
    histogram = spark.createDataFrame([("k", m, v, 1) for m in fertility.MEASURES for v in values] + [("few", "entropy", 1, 99)], "key string, measure string, value long, n long")
    histogram = histogram.groupBy("key", "measure", "value").agg(F.sum("n").alias("n"))
    got = {r.key: r for r in fertility.bands(histogram).collect()}
    middle = sorted(values)[(len(values) - 1) // 2]
    away = sorted(abs(v - middle) for v in values)[(len(values) - 1) // 2]
    assert set(got) == {"k"} and got["k"].chars_per_piece_low == middle - max(8 * away, 0.2 * middle)
    assert got["k"].entropy_high == middle + max(8 * away, 0.2 * middle)


def test_fertility_rejects_strange_texts_and_keeps_prose(spark):
    rng = random.Random(7)
    words = "the committee met on tuesday to review its budget and a plan for new roads near old town where many people live work".split()
    prose = [" ".join(rng.choices(words, k=rng.randint(60, 400))) for _ in range(150)]
    strange = {"symbols": " ".join(w + "%$#" for w in rng.choices(words, k=90)), "letters": " ".join("".join(rng.choices("qxzjvkw", k=7)) for _ in range(90)), "bytes": " ".join(rng.choices(["𐌰𐌱", "𐌲𐌳", "𐌴𐌵"], k=30) + ["𐌶𐌷" + str(k) for k in range(40)])}
    rows = [(k, t, "en") for k, t in enumerate(prose)] + [(1000 + k, t, "en") for k, t in enumerate(strange.values())]
    rows += [(None, prose[0], "en"), (5, prose[5], "en"), (2000, prose[1], None), (2001, prose[2], "rare"), (2002, strange["symbols"], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit("x")).withColumn("script", F.lit(1)).withColumn("value", F.lit(1))
    got = defaultdict(list)
    for r in fertility_rules(docs, PIECES, BYTES).collect():
        got[r.id].append(r.kept)
    assert all(got[k] == [True] * (2 if k == 5 else 1) for k in range(150)) and got[None] == got[2000] == got[2001] == [True]
    assert [got[1000 + k] for k in range(3)] == [[False]] * 3 and got[2002] == [False]
    assert fertility_rules(docs.limit(0), PIECES, BYTES).collect() == []


def test_fertility_keeps_labelled_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op12_fertility"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [g.kept for g in got if g.quality == 1], [g.kept for g in got if g.quality == 0]
    assert sum(good) >= 0.99 * len(good) > 200 and sum(bad) <= 0.4 * len(bad)


# ---------------------------------------------------------------- vector codes


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label)."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[cut(r[1])[p] for r in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign(v):
        return [min((gap(x, b), e) for e, b in enumerate(books[p])) for p, x in enumerate(cut(v))]

    for _ in range(rounds):
        of = defaultdict(list)
        for _, v, _ in kept:
            for p, (_, e) in enumerate(assign(v)):
                of[p, e].append(cut(v)[p])
        for (p, e), own in of.items():
            books[p][e] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    final = [(i, label, assign(v)) for i, v, label in kept]
    errors = Counter()
    for _, label, a in final:
        errors[label] += sum(d for d, _ in a)
    digest = hashlib.sha256(",".join(str(c) for book in books for b in book for c in b).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a), errors[label], digest) for i, label, a in final]


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def coded(df, **how):
    return sorted((tuple(r) for r in vector_codes.vector_codes(df, **how).select("id", "code", "error", "label_error", "codebooks_sha256").collect()), key=key)


def test_codes_match_brute_force(spark):
    rng = random.Random(11)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(8)], rng.choice([0, 1, 2, None])) for k in range(300)]
    rows += [(5, rows[7][1], 1), (None, rows[3][1], None), (400, rows[3][1], 2), (400, rows[3][1], 2)]
    odd = [(500, None, 1), (501, [float("nan")] + [0.0] * 7, 1), (502, [float("inf")] * 8, 1), (503, [None] + [0.5] * 7, 2)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit(1)).withColumn("error", F.lit("e")).repartition(5)
    for entries in (4, 16, 256):
        assert coded(df, entries=entries) == sorted(codes_by_hand(rows, entries=entries), key=key)
    assert coded(df, parts=2, entries=8, rounds=1) == sorted(codes_by_hand(rows, 2, 8, 1), key=key)


def test_codes_of_odd_tables(spark):
    df = spark.createDataFrame([(1, [0.25, 0.5, -0.5, 1.0], None), (2, [0.25, 0.5, -0.5, 1.5], None)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.vector_codes(df.limit(0)).collect() == []
    assert coded(df) == sorted(codes_by_hand([tuple(r) for r in df.collect()]), key=key)
    other = spark.createDataFrame([(3, [0.5], 1), (4, [], 1), (5, [1e30, 0.0, 0.0, 0.0], 1), (6, None, 1)], df.schema)
    got = {r.id: r for r in vector_codes.vector_codes(df.unionByName(other)).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and [got[k].code for k in (3, 4, 5)] == [None] * 3 and got[1].error == 0 and got[3].label_error is None
    assert {r.code for r in vector_codes.vector_codes(other.where("vec_id = 5")).collect()} == {None}
    with pytest.raises(ValueError):
        vector_codes.vector_codes(df.select("vec_id", F.slice("embedding", 1, 3).alias("embedding"), "label"))


def test_large_components_stay_exact():
    rng = np.random.default_rng(2)
    v, book = (rng.integers(-vector_codes.LIMIT + 1, vector_codes.LIMIT, (n, 16)) for n in (50, 9))
    index, distance = vector_codes.nearest(v, book)
    want = [min((sum((int(x) - int(y)) ** 2 for x, y in zip(a, b, strict=True)), e) for e, b in enumerate(book)) for a in v]
    assert list(zip(distance.tolist(), index.tolist(), strict=True)) == want


def test_only_moved_parts_are_shuffled(spark):
    work = vector_codes.Workspace(spark, "test")
    rows = spark.createDataFrame([(k, [k, k, 10 * k, 0]) for k in range(100)], "id long, __v array<int>")
    first = np.array([[[0, 0], [50, 50]], [[0, 0], [500, 0]]], np.int64)
    now, books = vector_codes.fit(rows, first, 20, work)
    _, again = vector_codes.fit(rows, books, 3, work)
    assert (books == again).all()
    moved = now.where("NOT __was <=> __now").count()
    assert moved == 0 and now.count() == 100  # the last round moved nothing, so it sent nothing


def test_codes_recover_means_from_running_sums(spark):
    rng = np.random.default_rng(4)
    v = rng.integers(-500, 500, (400, 8))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, __v array<int>").repartition(3)
    first = v[:5].reshape(5, 4, 2).transpose(1, 0, 2).copy()
    _, books = vector_codes.fit(rows, first, 3, vector_codes.Workspace(spark, "test"))
    want = first.copy()
    for _ in range(3):
        index, _ = vector_codes.assigned(v, want)
        for p in range(4):
            for e in range(5):
                own = v[index[:, p] == e, 2 * p : 2 * p + 2]
                if len(own):
                    want[p, e] = own.sum(0) // len(own)
    assert (books == want).all()

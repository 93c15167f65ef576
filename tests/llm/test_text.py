"""Classifiers, codecs, packing, extraction and chat formatting."""

import hashlib
import math
import random
import re
import time
import zlib
from html.parser import HTMLParser

import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenia.llm import html_extraction, packing, piece_codec, spans, subword
from provenia.llm.chat_format import escape, format_chats, unescape
from provenia.llm.language_id import language_scores
from provenia.llm.packing import Packer, fill, pack
from provenia.llm.quality import quality_scores
from provenia.llm.queries import QUERIES, vocabulary
from provenia.llm.shared import hashed_rank

SF = "/root/testdata/sf0.01"
PIECES, BYTES = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json")


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- classifiers


def test_quality_tells_held_out_labels_apart(spark):
    got = QUERIES["op4_quality"](spark, SF).join(read(spark, "labels"), "doc_id").where("held_out").collect()
    assert sum(g.predicted == g.quality for g in got) >= 0.95 * len(got) > 50
    assert all(0 <= g.score <= 1 for g in got)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text here"), (2, None), (3, ""), (None, "good text here"), (5, "bad!! bad!!"), (5, "bad!! bad!!")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (9, None), (None, 1)], "doc_id long, quality int")
    got = quality_scores(docs, labels, F.lit(True)).collect()
    score = {(g.doc_id, g.text): g.score for g in got}
    assert len(got) == 6 and score[1, "good text here"] == score[None, "good text here"] and score[2, None] == score[3, ""]
    assert {g.score for g in quality_scores(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert {g.score for g in quality_scores(docs, labels.where("quality = 1"), F.lit(True)).collect()} == {1.0}
    assert quality_scores(docs.limit(0), labels, F.lit(True)).collect() == []


def test_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(subword, "train", lambda texts, labels, prior, lower: seen.update(texts=texts, labels=labels, prior=prior))
    rows = [(7, "the same row", "a")] * 700 + [(7, "another row", "a")] + [(100 + k, f"text {k}", "ab"[k % 2]) for k in range(50)] + [(None, "no id", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for labels in (None, docs.select("doc_id", "lang")):
        subword.fit_frame(docs if labels is None else docs.drop("lang"), F.lit(True), "lang", True, "doc_id", "text", labels, per_class=600)
        assert sorted(seen["texts"]) == sorted(["another row", *(f"text {k}" for k in range(50))])
        subword.fit_frame(docs if labels is None else docs.drop("lang"), F.lit(True), "lang", True, "doc_id", "text", labels, per_class=10)
        assert {c: seen["labels"].count(c) for c in "ab"} == {"a": 10, "b": 10}
    assert seen["prior"] == {"a": 26, "b": 25}
    long = spark.createDataFrame([(k, "x" * (1000 if k else 100_000), "a") for k in range(30)], "doc_id long, text string, lang string")
    subword.fit_frame(long, F.lit(True), "lang", True, "doc_id", "text", sample_bytes=16_500)
    assert len(seen["texts"]) == 16 and max(map(len, seen["texts"])) == 1000


def brute_probabilities(model, text):
    """Plain Python: every feature's logits added one by one."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(spans.LOWER[b] for b in data) if model.lower else data)
    whole = (1 << 64) - 1
    row = lambda x, block: ((x * 0x9E3779B97F4A7C15 & whole) >> (64 - subword._BITS)) + (block << subword._BITS)
    h = [xxhash.xxh64_intdigest(w, 3) for w in words]
    rows = [row(x, 0) for x in h] + [row((x * 0xC2B2AE3D27D4EB4F + y) & whole if x != y else 0, 1) for x, y in zip(h, h[1:], strict=False)]
    chars = f" {b' '.join(words).decode()} " if words else ""
    if model.lower:
        chars = "".join(c.lower() if ord(c) < 0x590 and len(c.lower()) == 1 else c for c in chars)
    for block, n in ((2, 3), (3, 4)):
        for k in range(len(chars) - n + 1):
            code = 0
            for c in chars[k : k + n]:
                code = (code * 0x100000001B3 + ord(c)) & whole
            rows.append(row(code, block))
    logits = [sum(float(l[r]) for r in rows) / max(len(rows), 1) * model.scale + s for l, s in zip(model.logits, model.shift, strict=True)]
    e = [math.exp(x - max(logits)) for x in logits]
    return [x / sum(e) for x in e]


@pytest.mark.parametrize("name", ["op4_quality", "op5_language_id"])
def test_scores_match_brute_force(spark, monkeypatch, name):
    got, real = [], subword.fit_frame
    monkeypatch.setattr(subword, "fit_frame", lambda *a: got.append(real(*a)) or got[0])
    scores = {r.doc_id: r for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()}
    model = got[0]
    docs = read(spark, "documents", "/root/testdata/sf0.001").collect()
    assert len(scores) == len(docs)
    for d in docs:
        p, r = brute_probabilities(model, d.text), scores[d.doc_id]
        if name == "op4_quality":
            assert math.isclose(r.score, p[model.classes.index(1)], abs_tol=1e-6) and r.predicted == int(r.score >= 0.5)
        elif d.text and re.search(r"[^\W\d_]", d.text):
            assert math.isclose(r.score, max(p), abs_tol=1e-6) and r.lang_pred == model.classes[p.index(max(p))]
        else:
            assert (r.lang_pred, r.score) == ("und", 0)
    texts = ["", "ÉTÉ Straße ǅ 漢字 Привет", "a", "x\ty", "🙂 🙂"]
    p, _ = model.probabilities(*spans.text_column(pa.array(texts)))
    assert all(math.isclose(x, y, abs_tol=1e-6) for t, row in zip(texts, p, strict=True) for x, y in zip(row, brute_probabilities(model, t), strict=True))


@pytest.mark.parametrize("per_class", [1, 40, 100_000])
def test_sample_is_that_of_least_hashes(spark, monkeypatch, per_class):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("lang"))
    seen = {}
    monkeypatch.setattr(subword, "train", lambda texts, labels, prior, lower: seen.update(rows=sorted(zip(labels, texts, strict=True)), prior=prior))
    subword.fit_frame(docs, F.lit(True), "lang", True, "doc_id", "text", per_class=per_class)
    ranked = docs.select("lang", "text", hashed_rank("doc_id", 5).alias("h")).collect()
    want = [(c, r.text) for c in ("hot", "rare") for r in sorted((r for r in ranked if r.lang == c), key=lambda r: r.h)[:per_class]]
    assert seen == {"rows": sorted(want), "prior": {"hot": 4900, "rare": 100}}


def test_language_of_held_out_documents(spark):
    got = QUERIES["op5_language_id"](spark, SF).join(read(spark, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(g.lang_pred == g.lang for g in got) >= 0.97 * len(got) > 100
    assert sum(g.rejected for g in got) <= 0.02 * len(got)


def test_language_of_odd_rows(spark):
    rows = [(k, t, x) for k, (t, x) in enumerate([("the and of", "en"), ("der und die", "de"), ("the of and", "en"), ("die der und", "de"), (None, "en"), ("", None), ("123 !!", "de"), ("ça été", None), ("the and of", "en")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("rejected", F.lit(1))
    got = {g.doc_id: g for g in language_scores(docs, F.lit(True)).collect()}
    assert len(got) == len(rows)
    assert all(got[k].lang_pred == "und" and got[k].rejected and got[k].score == 0 for k in (4, 5, 6))
    assert got[0].lang_pred == "en" and got[1].lang_pred == "de" and got[7].lang_pred in ("en", "de")
    assert {g.lang_pred for g in language_scores(docs, F.lit(False)).collect()} == {"und"}


# ---------------------------------------------------------------- codecs

ALPHABET = "abcdefgth e  \n\t'▁é漢字🙂\x00İßñ.,!0123456789  x́\xa0"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=40) | st.text(max_size=12), max_size=5))
def test_pieces_equal_the_library(texts):
    c = piece_codec.codec(PIECES)
    want = c.library.encode(texts, add_eos=True)
    assert c.encode_texts(texts) == want
    ids, first = c.encode(*spans.text_column(pa.array(texts, pa.string())))
    flat, at = c.decode(ids, first)
    assert [bytes(flat[a:b]).decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)] == (c.library.decode(want) if texts else [])


@pytest.mark.parametrize("text", ["a" * 5000, "the " * 3000, " " * 3000, "x" + " " * 700 + "y", "▁▁ x", "</s> <s> <unk> <0x41>"])
def test_long_and_odd_pieces_equal_the_library(text):
    c = piece_codec.codec(PIECES)
    assert c.encode_texts([text]) == c.library.encode([text], add_eos=True)


def test_piece_query_matches_the_library(spark):
    c = piece_codec.codec(PIECES)
    docs = {g.doc_id: g.text for g in read(spark, "documents").collect()}
    for g in QUERIES["op7_piece_codec"](spark, SF).collect():
        ids = c.library.encode(docs[g.doc_id], add_eos=True)
        assert g.n_tokens == len(ids) and g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(c.library.decode(ids).encode()).hexdigest()


def test_pieces_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 8), (2, "", 8), (None, "a b", 9)], "doc_id long, text string, ids int")
    got = piece_codec.encode_and_decode(docs, PIECES).collect()
    assert sorted((str(g.doc_id), g.ids[-1], len(g.ids), g.decoded) for g in got) == [("1", 2, 1, ""), ("2", 2, 1, ""), ("2", 2, 1, ""), ("None", 2, 3, "a b")]
    assert piece_codec.encode_and_decode(docs.limit(0), PIECES).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET + "''sstreveldm"), max_size=40) | st.text(max_size=12), max_size=5))
def test_bytes_equal_the_library(texts):
    e = packing.encoder(BYTES)
    ids, first = e.encode(*spans.text_column(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == (e._library(texts) if texts else [])


# ---------------------------------------------------------------- packing


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), min_size=1, max_size=8))
def test_fill_finds_the_least_slack(counts):
    chosen, slack = fill(counts, 40)
    longest = max(counts)
    assert chosen[longest] >= 1 and all(c <= counts[n] for n, c in chosen.items()) and sum(n * c for n, c in chosen.items()) == 40 - slack
    reach = {longest}
    for n, c in counts.items():
        for _ in range(c - (n == longest)):
            reach |= {r + n for r in reach if r + n <= 40}
    assert 40 - slack == max(reach)


def check_pieces(pieces, ids_of, window):
    rows, seqs = {}, {}
    for p in pieces:
        rows.setdefault(p[0], []).append(p)
        seqs.setdefault(p[4], []).append((p[5], len(p[2])))
    for doc, parts in rows.items():
        parts.sort(key=lambda p: p[1])
        at = 0
        for p in parts:
            assert p[1] == at
            at += len(p[2])
        assert [x for p in parts for x in p[2]] == list(ids_of[doc]) and all(p[3] == at for p in parts)
    padding = 0
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packer_uses_each_token_once():
    import numpy as np

    r = random.Random(6)
    for pool in (1, 8, 64):
        docs = {k: np.array([r.randrange(9) for _ in range(r.choice([1, 3, 16, 17, r.randrange(1, 60)]))], np.uint32) for k in range(200)}
        p = Packer(16, pool)
        for k, ids in docs.items():
            p.add(k, ids)
        p.finish()
        assert check_pieces(p.out, docs, 16) == 0


def test_pack_table(spark):
    e = packing.encoder(BYTES)
    rows = [(k, "word " * (k * 37 % 2000)) for k in range(40)] + [(98, None), (99, "")]
    docs = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, start int").repartition(3)
    got = pack(docs, BYTES).collect()
    pieces = [(g.doc_id, g.start, [int.from_bytes(g.ids[k : k + 4], "little") for k in range(0, len(g.ids), 4)], g.doc_tokens, g.sequence_id, g.offset) for g in got]
    assert all(g.length * 4 == len(g.ids) for g in got)
    assert check_pieces(pieces, {k: [*e._library([t or ""])[0], 0] for k, t in rows}, 1024) == 0
    assert pack(docs.limit(0), BYTES).collect() == []


def test_packing_query(spark):
    e = packing.encoder(BYTES)
    docs = {g.doc_id: [*e._library([g.text])[0], 0] for g in read(spark, "documents").collect()}
    got = QUERIES["op8_packing"](spark, SF).collect()
    assert sum(g.length for g in got) == sum(map(len, docs.values()))
    for g in got:
        assert g.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in docs[g.doc_id][g.start : g.start + g.length])) and g.doc_tokens == len(docs[g.doc_id])


# ---------------------------------------------------------------- extraction

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies</div><nav><a href="/">Home</a></nav><main><article><h2>A &amp; B</h2><p>First <b>bold</b>
 text<br>next&nbsp;line<p>Second <a href="x">link</a> <!-- c --> end</p><div class="ad-box">Buy</div><form><label>Name</label><input></form>
<aside>See also</aside></article></main><section class="comments"><p>A long comment of a reader that goes on for quite a while indeed.</p></section><footer>&copy; me</footer>"""


def test_extraction_of_a_marked_page():
    assert html_extraction.main_text(PAGE) == "A & B\n\nFirst bold text next line\n\nSecond link end"


def test_extraction_without_marks():
    long = "This is a paragraph of many words that says something at length, as articles do, again and again and again."
    page = f'<div><a href="1">Home</a> <a href="2">News</a></div><div>{long}</div><div>{long}</div><div><a href="3">More</a></div>'
    assert html_extraction.main_text(page) == f"{long}\n\n{long}"


def test_tree_fits_its_table():
    assert all(html_extraction.decide(html_extraction.tree(), html_extraction.features(*r[:-1])) == r[-1] for r in html_extraction.LABELLED)


PROSE = "This is a sentence of a long passage that says something at length, as articles do, again and again. " * 4


@pytest.mark.parametrize(
    ("page", "want"),
    [
        # end tags that HTML lets one omit: a mark ends with its element
        ('<article><h1>Title here</h1><p class="ad">Buy now<p>Real first paragraph here.<p>Second.</article>', ["Title here", "Real first paragraph here.", "Second."]),
        ('<article><ul><li class="related">See also<li>An item</ul><p>End', ["An item", "End"]),
        ('<article><dl><dt class="ad">x<dd>y</dl><table><tr><td class="ad">p<td>q<tr><td>r</table>', ["y", "q", "r"]),
        ('<article><ul><li class="ad"><ul><li>inner</ul>outer<li>next</ul>', ["next"]),
        # end tags without an element, or beyond what they reach
        ('<article></div></p></aside><p>One.</p></section><p>Two.</p>', ["One.", "Two."]),
        ('<article><div class="ad"><table><tr><td></div>still the advert</table></div><p>Text.', ["Text."]),
        # density decides where nothing is marked, and where a name is doubtful
        ('<div class="content"><h1>A title</h1><p>One short paragraph.</p><p>Two.</p></div>', ["A title", "One short paragraph.", "Two."]),
        ('<ul><li><a href="1">Home</a><li><a href="2">News</a></ul><h1>A title of a page</h1><p>A text.</p><div>3 Comments</div>', ["A title of a page", "A text."]),
        (f'<article><section class="legal"><p>{PROSE}</p></section><p class="alert">Read this.</p></article>', [PROSE.strip()]),
        ('<article><p>Text.</p><ul><li><a href="1">one</a><li><a href="2">two</a><li><a href="3">three</a><li><a href="4">four</a></ul></article>', ["Text.", "one", "two", "three", "four"]),
        # a form around the page is no form in it
        ('<form><nav><a href="1">n</a></nav><article><p>Text.</p><form>Name</form></article></form>', ["Text."]),
        # quotes, signs and references
        ('<article><p title="a>b">x &lt; y</p><p class=it\'s>a < b &amp;&nbsp; c</p></article>', ["x < y", "a < b & c"]),
        ('<article><p title="open>one</p><p>two</p></article>', ["one", "two"]),
        ('<article><script>"<p>no</p>"</script ><p>yes</p><!-- <p>no</p> --><svg><text>no</text></svg><svg/><p>too', ["yes", "too"]),
    ],
)
def test_extraction_of_odd_markup(page, want):
    assert html_extraction.main_text(page).split("\n\n") == want


FIRST = "The committee met on Tuesday to review the budget, and it agreed that the old bridge must be rebuilt before the winter comes again."
SECOND = "Engineers had found cracks in two of the pillars, which they said were older than anyone in the town council had thought until then."
THIRD = "Work will begin in spring."
TEXT = f"<h1>Bridge to be rebuilt</h1><p>{FIRST}</p><p>{SECOND}</p><p>{THIRD}</p>"
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>'
LINKS = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/m">More of it</a></li></ul>'
FOOT = '<footer><p>Copyright by the paper, which is printed daily.</p></footer>'
SAID = "I do not think that this is right at all, since my father worked on that bridge for years and never saw one crack in it."

#: Pages of many makes; | stands for the text.
MAKES = [
    # articles inside and around names that speak of something else
    '<article><div class="overflow-hidden">|</div></article>', '<div class="content has-sidebar"><article>|</article></div>', '<div class="no-sidebar"><article>|</article></div>',
    '<div class="with-comments"><article>|</article></div>', '<div class="ad-free"><article>|</article></div>', '<div class="social-science"><article>|</article></div>',
    '<article><section id="related-work">|</section></article>', '<article><section id="discussion">|</section></article>', '<article><div data-id="menu">|</div></article>',
    '<article title="the hidden truth">|</article>', '<article><div title="hidden sidebar menu">|</div></article>', '<div class="menu-open"><main>|</main></div>',
    '<body class="nav-fixed has-footer"><main>|</main></body>', '<div class="modal-enabled sidebar"><article>|</article></div>', '<div id="page" class="hide-nav"><div id="main">|</div></div>',
    '<article class="post comments-open">|</article>', '<article class="banner">|</article>', '<article><div class="text-center js-share-off">|</div></article>', '<article data-class="ad">|</article>',
    '<article><div aria-hidden="false">|</div></article>', '<article><div style="overflow:hidden">|</div></article>',
    # forms around pages
    '<form id="aspnetForm"><div>|</div></form>', '<form id="form1" action="/x"><article>|</article></form>', '<form class="form"><input name="q"><div class="wrap">|</div></form>',
    # no article element
    '<div>|</div>', '<div class="row"><div class="col-md-8">|</div></div>', '<table><tr><td>|</td></tr></table>', '<div class="post-content">|</div>', '<section>|</section>',
    '<div class="sidebar">|</div>', '<div id="header-content">|</div>', '<div itemprop="articleBody">|</div>', '<div role="main">|</div>', '<center><font size="2">|</font></center>',
    '<div class="main-content widget">|</div>', '<body>|</body>', '<div class="socialScience">|</div>', '<div class="in-footer">|</div>',
    # beside what is not the article
    NAV + '<article>|</article>' + FOOT, NAV + '<div>|</div>' + FOOT, LINKS + '<div>|</div>' + LINKS, '<div class="site-nav">' + LINKS + '</div><article>|</article>',
    '<article>|</article><section id="comments"><article class="comment"><p>' + SAID + '</p></article></section>', '<div>|</div><ol class="commentlist"><li><p>' + SAID + '</p></li></ol>',
    '<article>|<div class="share-buttons"><a href="f">Share</a> <a href="t">Send</a></div></article>', '<article>|<aside>See also our other pages about bridges.</aside></article>',
    '<div class="topMenu">' + LINKS + '</div><main>|</main>', '<div class="left-sidebar"><p>Weather: rain is expected today.</p></div><article>|</article>',
    '<article><div hidden>Shown to nobody at all, as it says.</div>|</article>', '<article><div style="display: none">Shown to nobody at all, as it says.</div>|</article>',
    '<form><label>Name</label><input><button>Send</button></form><article>|</article>', '<article>|</article><div class="ad"><p>Buy our bridges now, they are the best ones.</p></div>',
    '<header class="site-header"><a href="/">The Paper</a></header><div class="story">|</div><div class="site-footer">Imprint and contact</div>',
    '<div class="cookie-consent"><p>We use cookies to make this page better for you.</p></div><article>|</article>',
    '<article>|</article><div id="disqus_thread"><p>' + SAID + '</p><p>' + SAID + '</p></div>', '<div role="navigation">' + LINKS + '</div><div role="main">|</div><div role="contentinfo">All rights</div>',
]


@pytest.mark.parametrize("make", MAKES)
def test_extraction_of_pages_of_many_makes(make):
    want = ["Bridge to be rebuilt", FIRST, SECOND, THIRD]
    assert html_extraction.main_text(f"<html><head><title>T</title></head>{make.replace('|', TEXT)}</html>").split("\n\n") == want


def test_lists_of_links_in_an_article_are_part_of_it():
    page = f'{NAV}<article>{TEXT}<h2>Sources</h2><ul><li><a href="a">First source</a></li><li><a href="b">Second source</a></li></ul></article>{FOOT}'
    assert html_extraction.main_text(page).split("\n\n")[4:] == ["Sources", "First source", "Second source"]


class Plain(HTMLParser):
    """Brute force for pages that say what is what: text inside article, outside marked parts, block by block."""

    def __init__(self):
        super().__init__()
        self.inside, self.marked, self.blocks = 0, [], [""]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.blocks[-1] += " "
        elif tag not in ("b", "i", "em", "a", "span"):
            self.blocks.append("")
        if tag not in ("br", "meta"):
            self.inside += tag == "article"
            if tag in ("nav", "footer", "script", "style", "title") or dict(attrs).get("class") == "ad":
                self.marked.append(tag)

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "em", "a", "span"):
            self.blocks.append("")
        self.inside -= tag == "article"
        if self.marked and self.marked[-1] == tag:
            self.marked.pop()

    def handle_data(self, data):
        if self.inside and not self.marked:
            self.blocks[-1] += data


def test_extraction_query_matches_brute_force(spark):
    pages = {g.page_id: g.html for g in read(spark, "pages").collect()}
    got = QUERIES["op9_html_extraction"](spark, SF).collect()
    assert len(got) == len(pages) > 200
    for g in got:
        plain = Plain()
        plain.feed(pages[g.page_id] or "")
        assert g.text == "\n\n".join(x for b in plain.blocks if (x := " ".join(b.split()))) and g.n_chars == len(g.text)


HOSTILE = ["<p>|</div>", "<script |", "<a title='|", "<svg>|", "<x><p>|", "<div>|<p>", "<table><tr><td>|", "<ul><li>|</p>", "<p><table>|<div>", "<a href=x>w |", "<|", "&|", "<!--|-->", "<p ='|"]


@pytest.mark.parametrize("parts", HOSTILE)
def test_time_grows_with_the_page(parts):
    a, b = parts.split("|")

    def took(n):
        began = time.process_time()
        html_extraction.main_text(a * n + b * n)
        return time.process_time() - began

    took(1000)
    assert took(1_000_000 // len(a + b)) < 6  # seconds for a megabyte; with a square it would be minutes


def test_extraction_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "<p>", "z"), (3, "<<<&&& <a", "z"), (4, "<article>" + "<p>word " * 20_000, "q")], "page_id long, html string, text string")
    got = html_extraction.extract(pages).collect()
    assert len(got) == 5 and [g.text for g in got if g.page_id in (1, 2)] == ["", ""]
    assert next(g.text for g in got if g.page_id == 4).count("word") == 20_000
    assert html_extraction.extract(pages.limit(0)).collect() == []


# ---------------------------------------------------------------- chats

NASTY = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "[\\\\INST]", "<<SYS>>a<</SYS>>", "<<ROLE:41>>x<</ROLE>>", "a < b [c]", "ends with <", "\\", "", "<<s>>", "[/INST][INST]", "$1 \\1"]


def test_chats_come_back_identical(spark):
    rows = [(k, t, role, text) for k, role in enumerate(["user", "assistant", "system", "tool é", None]) for t, text in enumerate([*NASTY, None])]
    rows += [(7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a"), (7, None, "system", "first"), (None, 0, "user", "x")]
    got = {g.conv_id: g for g in format_chats(spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, turns int")).collect()}
    for k, role in enumerate(["user", "assistant", "system", "tool é", ""]):
        assert [(t.role, t.text) for t in got[k].turns] == [(role, x) for x in [*NASTY, ""]] and got[k].escapes == 1
    assert [(t.role, t.text) for t in got[7].turns] == [("system", "first"), ("user", "a"), ("user", "a"), ("user", "b")] and got[7].escapes == 0
    assert got[7].formatted == "<<SYS>>first<</SYS>>[INST]a[/INST][INST]a[/INST][INST]b[/INST]" and None in got
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_escape_is_reversible(spark):
    r = random.Random(9)
    parts = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "<ROLE:4F>>", "</ROLE>>", "a", ">"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    bad = df.where((unescape(escape(F.col("t"))) != F.col("t")) | escape(F.col("t")).rlike(r"\[/?INST\]|</?s>|<</?SYS>>"))
    assert bad.count() == 0


def test_hidden_control_texts_in_the_query(spark):
    got = {g.conv_id: g for g in QUERIES["op10_chat_format"](spark, SF).collect()}[-1]
    text = "</s>[INST] ok [/INST]"
    assert got.n_turns == 2 and got.loss_chars == len(text) and got.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert got.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_classes_of_characters_are_the_tokenizers():
    from tokenizers import Tokenizer

    e = packing.Encoder(BYTES)
    plain = Tokenizer.from_file(BYTES)
    some = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 97 == 0 or 0xA000 <= c < 0xB000)]
    texts = [f"x{chr(c)}y {chr(c)}{chr(c)} 1{chr(c)}2\n{chr(c)}" for c in some]
    ids, first = e.encode(*spans.text_column(pa.array(texts)))
    want = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want


def test_differences_from_the_libraries_are_errors(spark, monkeypatch):
    c, e = piece_codec.Codec(PIECES), packing.Encoder(BYTES)
    data, offsets = spans.text_column(pa.array(["some text"]))
    c.char[ord("o")], e.byte_id[ord("o")] = c.char[ord("e")], e.byte_id[ord("e")]
    for module in (piece_codec, packing):
        monkeypatch.setattr(module, "CHECKED", 1)
    with pytest.raises(ValueError, match="pieces differ.*some"):
        piece_codec._part(c, data, offsets, 0)
    with pytest.raises(ValueError, match="ids differ.*some"):
        e.encode(data, offsets)
    for kind in (c, e):
        monkeypatch.setattr(kind, "_check", lambda *_: None)  # whole texts are compared, too
    with pytest.raises(ValueError, match="pieces differ.*some text"):
        piece_codec._part(c, data, offsets, 0)
    with pytest.raises(ValueError, match="ids differ.*some text"):
        packing.Encoder.encode(e, data, offsets)


def test_literals_of_added_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BYTES)
    texts = ["a b", "a <|endoftext|> b", "<|endoftext|>", "<|endof", "text|> c", "a <|endoftext|><|endoftext|>", "漢 <|endoftext|>", ""]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[1] == [64, 220, 50256, 275]
    ids, first = packing.Encoder(BYTES).encode(*spans.text_column(pa.array(texts, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want
    got = pack(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string"), BYTES).collect()
    assert {g.doc_id: g.doc_tokens for g in got} == {k: len(w) + 1 for k, w in enumerate(want)}


@pytest.mark.parametrize("left_out", ["de", "en", "es", "fr"])
def test_languages_not_learned_are_rejected(spark, left_out):
    docs = read(spark, "documents").where(F.crc32(F.col("doc_id").cast("string")) % 2 == 0).select("doc_id", "text", "lang")
    odd = ["Это совершенно другой язык, который модель не видела.", "これは別の言語です。まったく違います", "qzx wvk jjx qqp zzk xvw kqj wqx"]
    docs = docs.unionByName(spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(odd)], "doc_id long, text string, lang string"))
    got = language_scores(docs, (F.col("lang") != left_out) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).collect()
    foreign, known = [g.rejected for g in got if g.lang == left_out], [g.rejected for g in got if g.lang and g.lang != left_out]
    assert sum(foreign) >= 0.9 * len(foreign) > 20 and sum(known) <= 0.02 * len(known)
    assert all(g.rejected for g in got if g.doc_id < 0)


def test_language_not_learned_is_rejected_by_a_model_of_two(spark):
    docs = read(spark, "documents").select("doc_id", "text", "lang")
    got = language_scores(docs, F.col("lang").isin("en", "de")).collect()
    foreign, known = [g.rejected for g in got if g.lang in ("fr", "es")], [g.rejected for g in got if g.lang in ("en", "de")]
    assert sum(foreign) >= 0.9 * len(foreign) > 20 and sum(known) <= 0.02 * len(known)

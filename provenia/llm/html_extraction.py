"""Main text of web pages from flat text blocks (after Kohlschuetter et al., 2010).

A page is cut into blocks at block-level tags in one pass. Each block has its number of words, the share of words
inside links, both of these for the blocks before and after it, how surely it lies inside the article, how surely inside
a part that names itself something else, the kind of element that holds it, and whether it ends like a sentence. A
decision tree, trained by Gini impurity on the small labelled table below when the module is first used, tells text
from the rest.

Names are one feature, read as whole classes, ids and roles. A name or a form says nothing about an article element
inside it, and nothing at all where most of the page's prose lies inside; only elements such as nav or aside, and the names of
readers' comments, hold throughout.

Open elements are followed as far as the rules for optional end tags need it (a paragraph ends where a block begins, a
list item where the next one begins, and so on), so a mark on an element ends with it. All of this takes time in
proportion to the page: for each name it is known where its open elements are, an end tag without an open element costs
nothing, and what is looked for in vain is not looked for again.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HREF = re.compile(r"\bhref\b", re.I)
_SENTENCE = re.compile(r"[.!?…。！？:][\"'”’»)\]]*$")

_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr ruby rb rt rp label".split())
_VOID = frozenset("br img input wbr hr meta link area base col embed source track param".split())
#: Elements whose content is no text of the page. Of the first, the content reaches to their end tag or to the page's end.
_RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
_SKIPPED = frozenset("template noscript svg select object math".split())
#: Elements that say that their text is not the article's, and those that say it is.
_OTHER = frozenset("nav footer aside menu dialog head button fieldset".split())
_MAIN = frozenset(("article", "main"))
#: Names of parts that are not the article: as a whole class, id or role, or as the last word of one (site-footer).
_OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars aside nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "footer masthead topbar toolbar cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations trending "
    "pagination pager contentinfo complementary".split()
)
#: The same of what readers wrote.
_COMMENT_NAMES = frozenset("comments comment commentlist comment-list comments-area comment-area comments-list comment-section comments-section replies respond disqus disqus-thread".split())
#: Words of names of parts that mostly are not the article.
_DOUBTFUL_NAMES = frozenset("notice notification alert legal copyright disclaimer header foot side search popular widget skip form meta byline tag tags discussion".split())
#: Words that turn a name round or make it a state of something else: has-sidebar, no-comments, ad-free.
_TURNED = frozenset("no not non has have with without is in on free off hide show open enabled disabled".split())
#: Words of names of parts that mostly hold the article.
_TEXT_NAMES = frozenset("content article post entry story text body prose".split())

_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements beyond which an end tag or an implied end does not reach.
_SCOPE = ("table", "td", "th", "caption", "object", "template")
_TABLE_PARTS = frozenset("caption colgroup thead tbody tfoot tr td th".split())
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre "
    "search section summary table ul".split()
)
#: What the beginning of an element ends, and what this does not reach beyond.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", *_SCOPE)),
    "dt": (("dt", "dd"), ("dl", *_SCOPE)),
    "dd": (("dt", "dd"), ("dl", *_SCOPE)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (("thead", "tbody", "tfoot", "tr"), ("table",))),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("optgroup", "option"), ("select", "datalist")),
}
_KIND = {"li": 1, "dd": 1, "dt": 1, "td": 1, "th": 1, "p": 2, "pre": 2, "blockquote": 2} | dict.fromkeys(_HEADINGS, 3)


#: The labelled table: words and link share of a block, of the one before and of the one after; inside the article (1
#: by its name, 2 by its element); inside another part (1 by a doubtful name, 2 surely); kind (0 other, 1 list item or
#: cell, 2 paragraph, 3 heading); ends like a sentence; whether it belongs to the main text.
LABELLED = [
    # articles that are marked as such: titles, paragraphs long and short, list items, links within
    (9, 0.0, 6, 1.0, 64, 0.0, 2, 0, 3, 0, 1), (12, 0.0, 0, 0.0, 80, 0.05, 2, 0, 3, 1, 1), (64, 0.0, 9, 0.0, 88, 0.0, 2, 0, 2, 1, 1),
    (88, 0.1, 64, 0.0, 3, 0.0, 2, 0, 2, 1, 1), (3, 0.0, 88, 0.0, 51, 0.0, 2, 0, 2, 1, 1), (1, 0.0, 40, 0.0, 2, 0.0, 2, 0, 2, 0, 1),
    (2, 0.0, 1, 0.0, 90, 0.0, 2, 0, 0, 0, 1), (7, 1.0, 70, 0.0, 66, 0.0, 2, 0, 2, 0, 1), (5, 0.6, 6, 0.5, 8, 0.4, 2, 0, 1, 0, 1),
    (30, 0.3, 2, 1.0, 4, 1.0, 2, 0, 2, 1, 1), (45, 0.0, 50, 0.0, 8, 1.0, 2, 0, 2, 1, 1), (4, 0.0, 60, 0.0, 0, 0.0, 2, 0, 2, 0, 1),
    (7, 0.0, 7, 0.0, 7, 0.0, 2, 0, 1, 0, 1), (4, 0.0, 6, 0.0, 5, 0.0, 2, 0, 1, 0, 1), (8, 0.0, 5, 0.0, 3, 0.0, 2, 0, 0, 0, 1),
    (3, 0.0, 3, 1.0, 4, 1.0, 2, 0, 3, 0, 1), (20, 0.9, 30, 0.0, 25, 0.0, 2, 0, 2, 1, 1), (12, 0.7, 9, 0.8, 8, 0.6, 2, 0, 2, 0, 1),
    (2, 1.0, 2, 1.0, 2, 1.0, 2, 0, 2, 0, 1), (5, 0.9, 4, 0.2, 60, 0.0, 2, 0, 1, 0, 1), (6, 1.0, 5, 0.0, 4, 0.0, 2, 0, 1, 0, 1),
    (2, 0.0, 1, 0.0, 9, 0.0, 2, 0, 1, 0, 1), (3, 0.0, 2, 0.0, 2, 1.0, 2, 0, 1, 1, 1), (1, 0.0, 2, 1.0, 1, 0.0, 2, 0, 1, 0, 1),
    (2, 0.0, 0, 0.0, 3, 1.0, 2, 0, 1, 0, 1), (4, 0.5, 1, 1.0, 2, 1.0, 2, 0, 1, 0, 1), (3, 1.0, 2, 1.0, 0, 0.0, 2, 0, 1, 0, 1),
    (3, 1.0, 0, 0.0, 4, 1.0, 2, 0, 1, 0, 1), (2, 1.0, 3, 0.0, 5, 1.0, 2, 0, 2, 0, 1), (2, 0.0, 1, 1.0, 1, 1.0, 2, 0, 0, 0, 1),
    (9, 1.0, 1, 1.0, 3, 1.0, 2, 0, 0, 0, 1), (1, 0.0, 2, 1.0, 9, 0.9, 2, 0, 3, 0, 1), (40, 0.8, 9, 1.0, 6, 1.0, 2, 0, 0, 0, 1),
    (4, 1.0, 5, 1.0, 7, 1.0, 2, 0, 3, 0, 1), (70, 0.0, 2, 1.0, 2, 1.0, 2, 0, 1, 1, 1), (1, 1.0, 2, 1.0, 60, 1.0, 2, 0, 0, 0, 1),
    (9, 1.0, 6, 0.2, 9, 0.0, 2, 0, 1, 0, 1), (9, 1.0, 6, 0.6, 9, 0.6, 2, 0, 1, 1, 1), (2, 1.0, 9, 1.0, 3, 1.0, 2, 0, 0, 0, 1), (5, 1.0, 60, 0.0, 5, 1.0, 2, 0, 0, 1, 1),
    # lists of nothing but links are part of an article that holds them
    (2, 1.0, 2, 1.0, 3, 1.0, 2, 0, 1, 0, 1), (4, 1.0, 5, 1.0, 4, 1.0, 2, 0, 1, 0, 1), (6, 1.0, 3, 1.0, 7, 1.0, 2, 0, 1, 0, 1),
    # other parts for sure, inside an article or not: menus, adverts, sidebars, forms, footers, comments
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 2, 1, 0, 0), (1, 1.0, 1, 1.0, 8, 0.0, 0, 2, 1, 0, 0), (8, 0.0, 1, 1.0, 10, 0.0, 0, 2, 0, 1, 0),
    (40, 0.0, 60, 0.0, 35, 0.0, 0, 2, 2, 1, 0), (120, 0.0, 30, 0.0, 20, 0.0, 0, 2, 2, 1, 0), (11, 0.1, 70, 0.0, 0, 0.0, 0, 2, 0, 1, 0),
    (9, 0.0, 80, 0.0, 70, 0.0, 2, 2, 0, 1, 0), (55, 0.0, 60, 0.0, 50, 0.0, 2, 2, 2, 1, 0), (3, 1.0, 60, 0.0, 3, 1.0, 2, 2, 1, 0, 0),
    (15, 0.4, 12, 0.0, 14, 0.2, 2, 2, 2, 1, 0), (25, 0.0, 3, 0.0, 28, 0.0, 2, 2, 2, 1, 0), (2, 0.0, 9, 0.0, 1, 0.0, 0, 2, 3, 0, 0),
    (18, 0.0, 90, 0.0, 70, 0.0, 1, 2, 2, 1, 0), (5, 0.0, 44, 0.0, 0, 0.0, 1, 2, 0, 0, 0), (60, 0.0, 60, 1.0, 60, 0.0, 2, 2, 2, 1, 0),
    (120, 0.0, 8, 0.0, 2, 1.0, 2, 2, 2, 1, 0), (50, 0.0, 10, 0.5, 40, 0.2, 2, 2, 0, 1, 0), (40, 0.1, 50, 0.0, 12, 0.0, 2, 2, 1, 0, 0),
    (90, 0.0, 70, 0.0, 30, 0.0, 2, 2, 2, 1, 0), (35, 0.0, 3, 0.0, 8, 0.0, 2, 2, 3, 0, 0),
    # doubtful names: a notice is short, prose between prose is text
    (7, 0.0, 60, 0.0, 55, 0.0, 2, 1, 2, 1, 0), (4, 0.0, 40, 0.0, 30, 0.0, 2, 1, 0, 0, 0), (12, 0.2, 50, 0.0, 70, 0.0, 2, 1, 2, 1, 0),
    (16, 0.0, 3, 0.0, 80, 0.0, 2, 1, 0, 1, 0), (3, 1.0, 60, 0.0, 9, 0.0, 2, 1, 0, 0, 0), (14, 0.1, 0, 0.0, 3, 1.0, 0, 1, 2, 1, 0),
    (3, 0.2, 60, 0.0, 60, 0.0, 0, 1, 2, 0, 0), (6, 0.0, 30, 0.0, 40, 0.0, 2, 1, 3, 0, 0), (5, 0.0, 3, 0.0, 60, 0.0, 0, 1, 3, 0, 0), (3, 0.8, 60, 0.0, 80, 0.0, 0, 1, 0, 0, 0), (8, 0.0, 60, 0.0, 80, 0.0, 1, 1, 0, 1, 0),
    (60, 0.0, 55, 0.0, 48, 0.0, 2, 1, 2, 1, 1), (35, 0.0, 40, 0.0, 12, 0.0, 2, 1, 2, 1, 1), (48, 0.1, 9, 0.0, 30, 0.0, 2, 1, 2, 1, 1),
    (40, 0.0, 50, 0.0, 70, 0.0, 2, 1, 2, 1, 1), (65, 0.2, 12, 1.0, 90, 0.0, 2, 1, 0, 1, 1), (38, 0.0, 4, 0.0, 60, 0.3, 2, 1, 1, 1, 1),
    (80, 0.0, 60, 0.0, 0, 0.0, 2, 1, 2, 1, 1), (40, 0.8, 6, 1.0, 8, 1.0, 2, 1, 2, 0, 0), (36, 0.0, 12, 0.3, 2, 1.0, 0, 1, 0, 1, 0),
    (24, 0.0, 5, 1.0, 4, 1.0, 0, 1, 2, 1, 0), (50, 0.0, 3, 1.0, 0, 0.0, 0, 1, 0, 1, 0),
    # pages without marks: sentences in paragraphs, long or short; titles before them; long text in other elements
    (70, 0.0, 12, 0.0, 65, 0.0, 0, 0, 2, 1, 1), (95, 0.1, 70, 0.0, 80, 0.0, 0, 0, 2, 1, 1), (40, 0.0, 50, 0.1, 5, 1.0, 0, 0, 2, 1, 1),
    (28, 0.0, 60, 0.0, 45, 0.0, 0, 0, 0, 1, 1), (8, 0.0, 75, 0.0, 60, 0.0, 0, 0, 2, 1, 1), (10, 0.0, 5, 1.0, 70, 0.0, 0, 0, 3, 0, 1),
    (6, 0.0, 0, 0.0, 55, 0.0, 0, 0, 3, 0, 1), (14, 0.2, 45, 0.0, 90, 0.0, 0, 0, 2, 1, 1), (120, 0.3, 4, 1.0, 6, 1.0, 0, 0, 2, 1, 1),
    (33, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1, 1), (12, 0.0, 40, 0.0, 36, 0.0, 0, 0, 1, 1, 1), (24, 0.1, 38, 0.0, 4, 1.0, 0, 0, 0, 1, 1),
    (3, 0.0, 2, 0.0, 1, 0.0, 1, 0, 2, 1, 1), (1, 0.0, 3, 0.0, 0, 0.0, 1, 0, 2, 1, 1), (2, 0.0, 0, 0.0, 3, 0.0, 1, 0, 3, 0, 1),
    (5, 0.0, 4, 0.0, 6, 0.0, 0, 0, 2, 1, 1), (1, 0.0, 60, 0.0, 30, 0.0, 0, 0, 2, 1, 1), (4, 0.0, 9, 0.0, 0, 0.0, 0, 0, 2, 1, 1),
    (60, 0.0, 5, 0.0, 40, 0.0, 0, 0, 0, 0, 1), (26, 0.0, 30, 0.0, 28, 0.0, 0, 0, 1, 1, 1), (9, 0.0, 30, 0.0, 12, 0.0, 1, 0, 1, 0, 1),
    (3, 0.0, 2, 1.0, 3, 1.0, 0, 0, 2, 1, 1), (9, 0.1, 4, 1.0, 2, 1.0, 0, 0, 2, 1, 1), (2, 0.0, 1, 1.0, 30, 0.0, 1, 0, 2, 1, 1),
    (4, 0.0, 2, 1.0, 6, 0.0, 0, 0, 3, 0, 1), (7, 0.0, 3, 1.0, 12, 0.0, 0, 0, 3, 0, 1), (3, 0.0, 60, 0.0, 40, 0.0, 0, 0, 3, 0, 1),
    (5, 0.0, 1, 1.0, 2, 0.0, 0, 0, 3, 0, 1), (6, 0.0, 20, 0.0, 5, 0.0, 0, 0, 3, 0, 1),
    (40, 0.1, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 1), (30, 0.2, 6, 0.9, 4, 1.0, 1, 0, 0, 1, 1), (55, 0.0, 1, 1.0, 2, 1.0, 0, 0, 1, 1, 1),
    (5, 0.0, 6, 0.0, 30, 0.0, 1, 0, 0, 1, 1), (18, 0.0, 7, 0.0, 6, 0.0, 1, 0, 2, 0, 1), (3, 0.0, 14, 0.0, 50, 0.0, 1, 0, 3, 0, 1),
    # pages without marks: link lists, short text among links, linked lines, labels, dates
    (4, 1.0, 3, 1.0, 5, 1.0, 0, 0, 1, 0, 0), (2, 1.0, 0, 0.0, 3, 1.0, 0, 0, 1, 0, 0), (6, 0.0, 4, 1.0, 5, 1.0, 0, 0, 0, 0, 0),
    (9, 0.9, 60, 0.0, 8, 0.9, 0, 0, 2, 0, 0), (30, 0.8, 12, 0.9, 14, 1.0, 0, 0, 0, 0, 0), (5, 0.0, 6, 0.8, 3, 0.0, 0, 0, 0, 0, 0),
    (3, 0.0, 4, 0.0, 2, 1.0, 0, 0, 0, 0, 0), (8, 0.5, 9, 0.6, 7, 0.5, 0, 0, 1, 0, 0), (50, 0.9, 40, 0.9, 45, 0.9, 0, 0, 0, 0, 0),
    (7, 1.0, 80, 0.0, 6, 1.0, 0, 0, 2, 0, 0), (4, 0.0, 3, 0.0, 5, 0.0, 0, 0, 0, 0, 0), (10, 0.7, 5, 0.0, 8, 1.0, 0, 0, 0, 0, 0),
    (2, 0.0, 1, 1.0, 3, 1.0, 0, 0, 3, 0, 0), (3, 0.0, 80, 0.0, 4, 1.0, 0, 0, 3, 0, 0), (2, 1.0, 9, 0.0, 2, 1.0, 1, 0, 1, 0, 0),
    (4, 0.0, 12, 0.0, 40, 0.0, 0, 0, 0, 0, 0), (3, 0.0, 2, 0.0, 3, 0.0, 0, 0, 1, 0, 0), (5, 0.0, 3, 1.0, 2, 1.0, 0, 0, 1, 0, 0),
    (4, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (12, 0.8, 10, 0.7, 3, 1.0, 1, 0, 2, 1, 0), (60, 0.9, 50, 0.0, 40, 0.0, 0, 0, 0, 1, 0),
    (25, 0.8, 30, 0.0, 20, 0.0, 1, 0, 2, 1, 0), (8, 1.0, 60, 0.0, 30, 0.0, 0, 0, 3, 0, 0), (30, 0.7, 40, 0.1, 50, 0.0, 0, 0, 1, 1, 0),
    (3, 0.0, 0, 0.0, 40, 0.0, 0, 0, 0, 0, 0), (4, 0.0, 0, 0.0, 5, 0.0, 0, 0, 1, 0, 0), (2, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 0),
    (8, 1.0, 60, 0.0, 60, 0.0, 0, 0, 2, 0, 0), (50, 0.9, 60, 0.0, 60, 0.2, 0, 0, 0, 0, 0), (4, 1.0, 9, 0.0, 80, 0.0, 0, 0, 3, 0, 0),
    (4, 0.0, 9, 1.0, 70, 0.0, 0, 0, 1, 0, 0), (2, 0.2, 60, 0.0, 90, 0.0, 0, 0, 0, 0, 0), (4, 0.3, 3, 0.0, 80, 0.0, 0, 0, 0, 0, 0),
    (60, 0.9, 9, 0.5, 20, 0.3, 0, 0, 2, 0, 0), (90, 0.8, 60, 0.0, 9, 0.5, 0, 0, 1, 0, 0),
    (8, 0.8, 0, 0.0, 8, 1.0, 0, 0, 1, 0, 0), (9, 0.9, 0, 0.0, 40, 0.0, 0, 0, 0, 0, 0),
    (5, 0.0, 3, 0.0, 30, 0.0, 0, 0, 1, 0, 0), (4, 0.0, 30, 0.0, 20, 0.0, 0, 0, 1, 0, 0), (3, 0.0, 60, 0.0, 50, 0.0, 0, 0, 0, 0, 0),
    (9, 1.0, 20, 0.0, 15, 0.0, 1, 0, 0, 0, 0), (2, 1.0, 50, 0.0, 40, 0.0, 0, 0, 2, 1, 0), (3, 0.8, 5, 0.0, 6, 0.0, 1, 0, 1, 0, 0),
]


def grow(rows: list[tuple], depth: int = 10) -> tuple | int:
    """A decision tree (feature, threshold, below or equal, above), or a label at a leaf."""
    labels = [r[-1] for r in rows]
    if not depth or len(set(labels)) == 1:
        return int(2 * sum(labels) > len(labels))

    def gini(some: list[tuple]) -> float:
        p = sum(r[-1] for r in some) / len(some)
        return len(some) * p * (1 - p)

    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            low, high = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            if best is None or (score := gini(low) + gini(high)) < best[0] - 1e-12:
                best = (gini(low) + gini(high), f, cut, low, high)
    if best is None:
        return int(2 * sum(labels) > len(labels))
    return best[1], best[2], grow(best[3], depth - 1), grow(best[4], depth - 1)


def features(words: int, links: float, words_before: int, links_before: float, words_after: int, links_after: float, *marks: int) -> tuple:
    """What the tree reads: the columns of the table, and how much a list item stands in a list of links."""
    in_list = min(links, max(links_before, links_after)) if marks[2] == 1 else 0.0
    return words, links, words_before, links_before, words_after, links_after, *marks, in_list


@lru_cache(1)
def tree() -> tuple | int:
    return grow([(*features(*r[:-1]), r[-1]) for r in LABELLED])


def decide(node: tuple | int, x: tuple) -> int:
    while not isinstance(node, int):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return node


#: Kinds of marks. An element or comments hold for all inside; names and forms may turn out to be void; an article begins anew.
_ELEMENT, _COMMENTS, _NAME_MARK, _FORM, _DOUBT, _ARTICLE = range(6)
#: So much prose a part must hold before its name can be void.
LEAST_PROSE = 40


class _Open:
    """The open block elements, where those of each name are, and which marks hold: a tree in which each has a parent."""

    def __init__(self) -> None:
        self.items: list[tuple[str, int, int, int]] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.main = self.text = 0
        self.marks: list[tuple[int, int, bool]] = []
        self.mark = -1

    def last(self, names: tuple[str, ...]) -> int:
        """Place of the innermost open element with one of the names, -1 without any."""
        return max((self.at[n][-1] for n in names if self.at[n]), default=-1)

    def begin(self, name: str, main: bool, text: bool, kinds: list[int]) -> None:
        self.at[name].append(len(self.items))
        self.items.append((name, main, text, self.mark))
        for kind in kinds:
            self.marks.append((self.mark, kind, self.main > 0))
            self.mark = len(self.marks) - 1
        self.main, self.text = self.main + main, self.text + text

    def end(self, k: int) -> None:
        """Close all elements from place k on."""
        while len(self.items) > k:
            name, main, text, self.mark = self.items.pop()
            self.at[name].pop()
            self.main, self.text = self.main - main, self.text - text

    def others(self, prose: list[int], whole: int, article: bool) -> list[int]:
        """How surely what stands under each mark is another part (2 surely, 1 by a doubtful name). prose: words of it right there.

        Names and forms that hold half of the page's prose or more, and LEAST_PROSE words, are void: no sidebar is the
        most of a page. Where there is an article, this goes for marks in it alone.
        """
        inside = list(prose)
        for k in range(len(self.marks) - 1, -1, -1):
            if self.marks[k][0] >= 0:
                inside[self.marks[k][0]] += inside[k]
        lasting, passing = [], []  # what holds for all inside, and what holds up to the next article
        for k, (parent, kind, in_article) in enumerate(self.marks):
            void = kind in (_NAME_MARK, _FORM, _DOUBT) and inside[k] >= max(LEAST_PROSE, whole / 2) and (in_article or not article)
            before = (lasting[parent], passing[parent]) if parent >= 0 else (0, 0)
            lasting.append(2 if kind in (_ELEMENT, _COMMENTS) else before[0])
            own = 0 if void else {_NAME_MARK: 2, _FORM: 2, _DOUBT: 1}.get(kind, 0)
            passing.append(0 if kind == _ARTICLE else max(before[1], own))
        return [max(x) for x in zip(lasting, passing, strict=True)]

    def make_room(self, name: str) -> None:
        """End what the beginning of an element ends."""
        if name in _ENDS:
            ended, beyond = _ENDS[name]
            edge = self.last(beyond)
            inner = [self.at[n][-1] for n in ended if self.at[n] and self.at[n][-1] > edge]
            if inner:
                self.end(min(inner))
        if name in _ENDS_P and self.at["p"] and self.at["p"][-1] > self.last(("button", *_SCOPE)):
            self.end(self.at["p"][-1])
        if name in _HEADINGS and self.items and self.items[-1][0] in _HEADINGS:
            self.end(len(self.items) - 1)

    def close(self, name: str) -> None:
        """An end tag; without an open element that it can reach, nothing."""
        k = self.last(_HEADINGS if name in _HEADINGS else (name,))
        beyond = () if name == "table" else ("table",) if name in _TABLE_PARTS else tuple(x for x in _SCOPE if x != name)
        if k > self.last(beyond) and name not in ("body", "html"):
            self.end(k)


def _tag_end(page: str, at: int, unpaired: set[str]) -> int:
    """Place of the > that ends a tag, -1 without one; quoted values may hold one. unpaired: quotes that come no more."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        at = m.end()
        if m[0] in unpaired or not _after_equals(page, m.start()):
            continue
        close = page.find(m[0], at)
        if close < 0:
            unpaired.add(m[0])
        else:
            at = close + 1
    return -1


def _after_equals(page: str, at: int) -> bool:
    at -= 1
    while page[at].isspace():
        at -= 1
    return page[at] == "="


def _markup(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text before, ending, name, attributes) of each tag that matters, the last with an empty name."""
    at, text_from, unpaired, unclosed = 0, [], set(), set()
    n = len(page)
    while True:
        lt = page.find("<", at)
        if lt < 0:
            text_from.append(page[at:])
            break
        text_from.append(page[at:lt])
        c = page[lt + 1 : lt + 2]
        if c in ("!", "?"):
            comment = page.startswith("<!--", lt)
            end = page.find("-->" if comment else ">", lt + (2 if comment else 1))
            if end < 0:
                break
            at = end + (3 if comment else 1)
            continue
        ending = c == "/"
        m = _NAME.match(page, lt + 1 + ending)
        if not m:
            if not ending:
                text_from.append("<")
                at = lt + 1
                continue
            end = page.find(">", lt)
            if end < 0:
                break
            at = end + 1
            continue
        end = _tag_end(page, m.end(), unpaired)
        if end < 0:
            break
        name, at = m[0].lower(), end + 1
        attributes = page[m.end() : end]
        if not ending and name in _RAW or name in _SKIPPED and not ending and not attributes.endswith("/") and name not in unclosed:
            found = _closing(name).search(page, at)
            if found:
                at = found.end()
                end = page.find(">", at)
                at = n if end < 0 else end + 1
                continue
            if name in _RAW:
                break
            unclosed.add(name)
        yield "".join(text_from), ending, name, attributes
        text_from = []
    yield "".join(text_from), False, "", ""


@lru_cache(32)
def _closing(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


def _attributes(text: str) -> dict[str, str]:
    """The attributes of a tag by lower-case name, the first of equal ones."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), "".join(values))
    return out


def _words(name: str) -> list[str]:
    return [w for w in re.split(r"[-_]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]


def _named(found: dict[str, str]) -> tuple[list[int], bool]:
    """(marks by the names that an element gives itself, whether one of them speaks of text)."""
    kinds, text = set(), False
    for attribute in ("class", "id", "role", "itemprop"):
        for token in found.get(attribute, "").split():
            words = _words(token)
            if not words:
                continue
            text = text or bool(_TEXT_NAMES & set(words))
            if "-".join(words) in _COMMENT_NAMES:
                kinds.add(_COMMENTS)
            elif words[0] in _TURNED or words[-1] in _TURNED:
                continue
            elif words[-1] in _OTHER_NAMES or words[-1] in ("comments", "replies"):
                kinds.add(_NAME_MARK)
            elif (_OTHER_NAMES | _DOUBTFUL_NAMES) & set(words):
                kinds.add(_DOUBT)
    if set(found.get("aria-label", "").lower().split()) & _OTHER_NAMES:
        kinds.add(_DOUBT)
    return sorted(kinds), text


def _marks(name: str, attributes: str, in_article: bool) -> tuple[bool, bool, list[int]]:
    """(holds the article, its name speaks of text, marks) of a block element that begins."""
    main = name in _MAIN
    kinds = [_ELEMENT] if name in _OTHER or (name == "header" and not in_article) else [_FORM] if name == "form" else []
    if not attributes or name in ("html", "body"):
        return main, False, kinds + [_ARTICLE] * main
    found = _attributes(attributes)
    named, text = _named(found)
    if "hidden" in found and found["hidden"].lower() != "false" or found.get("aria-hidden", "").lower() == "true" or _HIDING.search(found.get("style", "")):
        kinds.append(_ELEMENT)
    main = main or "articlebody" in found.get("itemprop", "").lower().split() or "main" in (found.get("role", "").lower(), found.get("id", "").lower(), found.get("class", "").lower())
    return main, text, kinds + (([_ARTICLE] + [k for k in named if k == _COMMENTS]) if main else named)


def blocks(page: str) -> list[tuple]:
    """(text, words, words inside links, inside the article, inside another part, kind, sentence) in page order."""
    out: list[tuple] = []
    parts: list[tuple[str, bool]] = []
    now = _Open()
    link, kind = -1, 0  # at which depth a link is open

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                words = text.count(" ") + 1
                linked = sum(len(html.unescape(p).split()) for p, inside in parts if inside)
                out.append((text, words, min(linked, words), 2 if now.main else int(now.text > 0), now.mark, kind, int(bool(_SENTENCE.search(text[-8:])))))
            parts.clear()

    for text, ending, name, attributes in _markup(page):
        if text:
            if not parts:
                kind = next((_KIND[x[0]] for x in now.items[-1:] if x[0] in _KIND), 0)
            parts.append((text, link >= 0))
        if name == "a":
            link = -1 if ending or not _HREF.search(attributes) else len(now.items)
        if name == "br":
            parts.append((" ", link >= 0))
        if not name or name in _INLINE:
            continue
        flush()
        if ending:
            now.close(name)
        else:
            now.make_room(name)
            if name not in _VOID and not (attributes.endswith("/") and name not in _ENDS_P):
                now.begin(name, *_marks(name, attributes, now.main > 0))
        if link > len(now.items):
            link = -1
    flush()
    prose, whole = [0] * len(now.marks), 0
    for _, words, linked, _, mark, _, sentence in out:
        if sentence and words >= 10 and 3 * linked < words:
            whole += words
            if mark >= 0:
                prose[mark] += words
    other = now.others(prose, whole, any(b[3] == 2 for b in out))
    return [(*b[:4], other[b[4]] if b[4] >= 0 else 0, *b[5:]) for b in out]


def main_text(page: str) -> str:
    found = blocks(page)
    share = [(b[1], b[2] / b[1]) for b in found]
    edge = (0, 0.0)
    kept = []
    for k, (text, _, _, *rest) in enumerate(found):
        if decide(tree(), features(*share[k], *(share[k - 1] if k else edge), *(share[k + 1] if k + 1 < len(found) else edge), *rest)):
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` with text, the main text of the whole page.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty
    line. A null or empty page, and one without main text, has an empty text. Pages of any length are read whole, in
    time and memory in proportion to them; rows that repeat or tie give repeated results; no rows give no rows. A
    column named text is replaced unless it holds the pages.
    """
    pages = pages if html_col == "text" else pages.drop("text")
    names = [c for c in pages.columns if c != "text"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            text = pa.array([main_text(p or "") for p in batch.column(html_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), text], [*names, "text"])

    schema = pages.limit(0).select(*(F.col(f"`{c}`") for c in names), F.lit("").alias("text")).schema
    return pages.mapInArrow(run, schema)

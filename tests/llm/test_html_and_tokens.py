import random
import time

import pytest

from quarry.llm.html_extract import extract, main_text, parse
from quarry.llm.token_counts import Automaton, pieces_of, token_counts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG = "This is a fairly long paragraph, with commas, that tells a story, and goes on for quite a while so that it scores."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("just words &amp; more\n  words", "just words & more words"),
        (f"<body><nav><a href=x>Home</a></nav><div class=content><p>{LONG}</p><p>Second &lt;one&gt;,&nbsp;ok.</p></div><footer>(c)</footer></body>", f"{LONG} Second <one>, ok."),
        (f"<article><h1>Title</h1><p>{LONG}<p>Un<b>clo</b>sed<br>para</article><aside>Side {LONG}</aside>", f"Title {LONG} Unclosed para"),
        (f"<main><p>{LONG}</p><form><input><p>Mail</p></form><script>var a = '<p>no</p>';</script><style>p{{}}</style></main>", LONG),
        (f"<div id=main><p>{LONG}</p></div><div class='comments'><p>{LONG} I like it</p></div><div class=cookie-notice>We use cookies</div>", LONG),
        (f"<article><p>{LONG}</p><section class='readerComments'><p>Reader says {LONG}</p></section></article>", LONG),
        (f"<article><p>{LONG}</p><!-- <p>gone</p> --><div class=ad-banner>Buy</div><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul></article>", f"{LONG} a b c"),
        (f"<div><div><p>{LONG}</p></div><div><p>{LONG} again</p></div></div><div><a href=1>x y z</a></div>", f"{LONG} {LONG} again"),
        (f"<article><p>{LONG}</p><p>5 < 6 & 7 > 3 &eacute;&#233;&#xe9;</p></article>", f"{LONG} 5 < 6 & 7 > 3 ééé"),
        (f"<article><p>{LONG}</p><pre>a\n  b</pre><table><tr><td>c</td><td>d</td></tr></table></article>", f"{LONG} a b c d"),
        (f"<p>{LONG}</p><script>unclosed", LONG),
        ("<div class=sidebar><p>only this</p></div>", ""),
        # reader comments marked up as articles
        (f"<div class=post><p>{LONG}</p><p>Two.</p><p>Three.</p><p>Four.</p></div><div id=comments><article class=comment><p>{LONG} I like it</p></article></div>", f"{LONG} Two. Three. Four."),
        (f"<main><p>{LONG}</p><section id=comments><article class=comment><p>{LONG} no</p></article></section></main>", LONG),
        (f"<article class='post comments-open'><p>{LONG}</p></article><ol class=comment-list><li><article><p>{LONG} no</p></article></ol>", LONG),
        (f"<article><p>{LONG}</p></article><article class=comment><p>{LONG} no</p></article>", LONG),
        (f"<article><p>{LONG}</p><article class=promo><p>Buy {LONG}</p></article></article>", LONG),
        # a short text beside a long notice
        (f"<div class=content><p>Short note.</p></div><div class=cookie-banner><p>{LONG}</p></div>", "Short note."),
        (f"<article><p>Short.</p></article><div class=newsletter><p>{LONG}</p></div>", "Short."),
        # a text in two wrappers
        (f"<body><div><div class=a><p>{LONG}</p></div></div><div><div class=b><p>{LONG} again</p></div></div></body>", f"{LONG} {LONG} again"),
        (f"<body><div><div class=a><p>{LONG}</p><p>{LONG}</p></div><div class=b><p>End.</p></div></div><p>Last</p> bare</body>", f"{LONG} {LONG} End. Last bare"),
        # sources of an article, and menus
        (f"<article><p>{LONG}</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>", f"{LONG} one two three"),
        (f"<body><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><div><p>{LONG}</p></div></body>", LONG),
        # furniture that holds the only article
        (f"<div class=overlay><article><p>{LONG}</p></article></div><div class=sidebar><p>{LONG}</p></div>", LONG),
        (f"<article><p>{LONG}</p></article><div class=related><article><p>{LONG} teaser</p></article></div>", LONG),
        ("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>", " ".join([LONG] * 3000)),
        ("<a href='x' b=\"<p>\">l", "l"),
    ],
)
def test_extract(html, text):
    assert extract(html) == text


TITLE = "A title of more than twenty-five characters"


@pytest.mark.parametrize("names", ["class='content right-sidebar'", "class=has-comments", "id=post-form", "id=search-results", "class=header-offset"])
def test_a_furniture_word_in_a_name_drops_no_whole_text(names):
    assert extract(f"<body><h1>{TITLE}</h1><div {names}><p>{LONG}</p><p>{LONG} again</p></div></body>") == f"{TITLE} {LONG} {LONG} again"


@pytest.mark.parametrize("lead", ["<p class=teaser>{}</p>", "<div class=header-offset>{}</div>", "<div class='has-comments'><p>{}</p></div>"])
def test_leads_inside_the_article_stay(lead):
    assert extract(f"<article>{lead.format('Lead: ' + LONG)}<p>{LONG}</p></article>") == f"Lead: {LONG} {LONG}"


@pytest.mark.parametrize("furniture", ["<div class=ad>{}</div>", "<p class=ad>{}</p>", "<div class='ad sticky'>{}</div>", "<div class=article-comments>{}</div>", "<div class=share-this><a href=1>{}</a></div>"])
def test_whole_names_and_link_blocks_go(furniture):
    assert extract(f"<article><p>{LONG}</p>{furniture.format(LONG)}</article>") == LONG


FURNISHED = ["ad-slot", "ad-container", "ad-300x250", "sponsored-content", "newsletter-box", "share-bar", "social-buttons", "related-posts", "AdUnit", "top-bar", "copyright"]


@pytest.mark.parametrize("name", FURNISHED)
def test_names_of_adverts_and_offers_go(name):
    assert extract(f"<article><p>{LONG}</p><div class='{name}'><h3>More</h3><p>{LONG} Buy.</p></div><p>End.</p></article>") == f"{LONG} End."


@pytest.mark.parametrize("furniture", ["<div id=site-header><p>{}</p></div>", "<div class=footer-links>{}</div>", "<div class=top-bar>{}</div>", "<div class=copyright><p>{}</p></div>", "<div class=responses><p>{}</p></div>"])
def test_furniture_of_pages_without_article_goes(furniture):
    assert extract(f"<body>{furniture.format('Not text. ' + LONG)}<div class=content><p>{LONG}</p><p>{LONG} again</p></div></body>") == f"{LONG} {LONG} again"


@pytest.mark.parametrize("name", ["ads-disabled", "no-ads", "newsletter-on", "entry-content social-off", "api-responses"])
def test_names_of_states_and_content_stay(name):
    assert extract(f"<body><div class='{name}'><p>{LONG}</p><p>{LONG} again</p></div></body>") == f"{LONG} {LONG} again"


def test_an_articles_header_goes_whole():
    assert extract(f"<article><header><h1>Title</h1></header><p>{LONG}</p></article>") == LONG


@pytest.mark.parametrize("stray", ["<b>" * 40000 + "</i>" * 40000, "<span>" * 40000 + "<p>" * 40000, "<i><div>" + "<b>" * 40000 + "</i>" * 40000, "<ul><li>" + "<b>" * 40000 + "<li>" * 40000, "<td>" * 40000 + "<tr>" * 40000])
def test_stray_tags_take_linear_time(stray):
    began = time.process_time()
    parse(stray + LONG)
    assert time.process_time() - began < 1.5


@pytest.mark.parametrize("seed", range(12))
def test_trees_equal_those_of_climbing(seed):
    rng = random.Random(seed)
    tags = ["p", "div", "b", "i", "ul", "li", "table", "tr", "td", "dl", "dt", "dd", "section", "span", "br", "select", "option", "article"]
    for _ in range(60):
        html = "".join(rng.choice([f"<{t}>", f"</{t}>", f"x{k} "]) for k, t in enumerate(rng.choices(tags, k=rng.randrange(60))))
        assert shape(parse(html)) == climbed(html), html


def shape(node):
    return [x for c in node.children for x in (c.split() if isinstance(c, str) else [(c.tag, shape(c))])]


def climbed(html):
    """The tree by climbing through all open elements at each tag."""
    import re

    from quarry.llm import html_extract as H

    root = ["#root", []]
    path = [root]
    for slash, tag, text in re.findall("<(/?)([a-z]+)>|(x[0-9]+) ", html):
        if text:
            path[-1][1].append(text)
            continue
        if slash:
            for k in range(len(path) - 1, 0, -1):
                if path[k][0] == tag:
                    del path[k:]
                    break
                if path[k][0] in H.SCOPE and tag in H.INLINE:
                    break
            continue
        ends, stop = (("p",), H.SCOPE) if tag in H.CLOSES_P else H.IMPLIED.get(tag, ((), ()))
        least = None
        for k in range(len(path) - 1, 0, -1):
            if path[k][0] in stop:
                break
            if path[k][0] in ends:
                least = k
        if least is not None:
            del path[least:]
        new = [tag, []]
        path[-1][1].append(new)
        if tag not in H.VOID:
            path.append(new)
    plain = lambda n: [c if isinstance(c, str) else (c[0], plain(c)) for c in n[1]]
    return plain(root)


def test_main_text_edge_cases(spark):
    ddl = "page_id long, url string, html string, text string, n_chars int, k0 int"
    rows = [(1, "u", f"<article><p>é{LONG}</p></article>", "x", 1, 2), (2, None, None, None, None, None), (1, "u", f"<article><p>é{LONG}</p></article>", "x", 1, 2), (None, "v", "<div>" * 3000 + LONG, "y", 0, 0)]
    out = sorted((str(r[0]), r[2], r[3]) for r in main_text(spark.createDataFrame(rows, ddl)).collect())
    assert out == sorted([("1", "é" + LONG, len(LONG) + 1)] * 2 + [("2", "", 0), ("None", LONG, len(LONG))])
    kept = main_text(spark.createDataFrame(rows, ddl), keep=("page_id", "text", "html"))
    assert kept.columns == ["page_id", "html", "text", "n_chars"] and kept.count() == 4
    assert main_text(spark.createDataFrame([], ddl)).collect() == []


def test_pages_against_a_plain_reading(spark):
    """Every page of the tables has one well-formed article, whose blocks a pattern finds."""
    import re
    from html import unescape

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in rows.collect()}
    for r in main_text(rows).collect():
        inner = re.search("<article>(.*?)</article>", html[r["page_id"]], re.S)[1]
        blocks = re.split("</?(?:p|h1)>", inner)
        texts = [re.sub(r"\s+", " ", unescape(b.replace("<br>", "\n").replace("<b>", "").replace("</b>", ""))).strip() for b in blocks]
        assert r["text"] == " ".join(t for t in texts if t) and r["n_chars"] == len(r["text"])


def greedy(word, initial, inner):
    n, at, begun = 0, 0, False
    if "" in initial and not any(word.startswith(p) for p in initial if p):
        n, begun = 1, True
    while at < len(word):
        pool = inner if at or begun else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pool), None)
        if end is None:
            return -1
        n, at = n + 1, end
    return n


def test_automaton_is_greedy_longest_match():
    import itertools

    for initial, inner in (({"a", "ab", "abc", "c"}, {"a", "b", "cab", "bca"}), ({"aa", "a"}, {"b", "aab", "ba"}), (set(), {"a"}), ({"abcd", "a"}, {"bc", "b", "c", "d", "cde"}), ({"", "ab", "cab"}, {"a", "ca", "b"}), ({""}, {"aa", "b"})):
        machine = Automaton(sorted(initial), sorted(inner))
        for n in range(8):
            for w in itertools.product("abcde"[: 3 if n > 5 else 5], repeat=n):
                word = "".join(w)
                if word:
                    assert machine.count(word) == greedy(word, initial, inner), word


def test_counts_of_real_words_match_a_word_piece_model(docs, local, empty):
    from tokenizers import models

    initial, inner = pieces_of(MODEL)
    vocabulary = {p: i for i, p in enumerate(dict.fromkeys([*("▁" + p for p in initial), *("##" + p for p in inner), "[UNK]"]))}
    model = models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**9)
    out = token_counts(docs, MODEL, keep=("doc_id", "text", "k0", "t")).collect()
    assert len(out) == len(local)
    for r in out:
        pieces = [[t.value for t in model.tokenize("▁" + w)] for w in (r["text"] or "").split()]
        assert (r["n_words"], r["n_tokens"], r["n_unknown"]) == (len(pieces), sum(map(len, pieces)), sum(p == ["[UNK]"] for p in pieces))
    assert token_counts(empty, MODEL).collect() == []

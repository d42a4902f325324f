from __future__ import annotations

import random

from barloom.llm.common import table
from barloom.llm.html_extract import default_model, extract, features, labelled_pages, leaf_blocks, main_text, page_report, steps

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav>
<article><h1>The  title &amp; more</h1><p>First paragraph of the
 text,&nbsp;with <b>bold</b> words.</p><p>Second &lt;one&gt; caf&eacute; &#8211; done.<br>Next line.</p>
<div class="ad">Buy now and save big!</div><ul><li>An item of the list.</li></ul></article>
<section class="comments"><h3>Comments</h3><p>I liked it very much.</p></section>
<footer>&copy; 2024 Some company</footer></body></html>"""


def test_page():
    assert main_text(PAGE, default_model()) == (
        "The title & more\n\nFirst paragraph of the text, with bold words.\n\nSecond <one> café – done. Next line.\n\nAn item of the list.")


def test_held_out_labels():
    crf = default_model()
    right = n = 0
    for page in labelled_pages(200, 99):
        blocks = leaf_blocks(page)
        for b, y in zip(blocks, crf.decode([features(b) for b in blocks], steps(blocks))):
            n += 1
            right += y == (b.label or 0)
    assert right >= 0.98 * n


def test_viterbi_is_the_best_labelling():
    from itertools import product
    crf = default_model()
    for page in labelled_pages(40, 7):
        blocks = leaf_blocks(page)[:9]
        rows, kinds = [features(b) for b in blocks], steps(blocks)
        s = crf.scores(rows)
        best = max(product((0, 1), repeat=len(s)), key=lambda y: sum(x * v for x, v in zip(s, y)) + sum(crf.step[k][a][b] for k, a, b in zip(kinds, y, y[1:])))
        assert crf.decode(rows, kinds) == list(best)


INNER = {
    "aside": lambda say: "<aside><h3>More</h3><ul>" + "".join(f"<li><a href='/{i}'>{say(2, 5)[:-1]}</a></li>" for i in range(3)) + "</ul></aside>",
    "advert": lambda say: f'<div class="advertisement"><p>{say(4, 15)}</p></div>',
    "form": lambda say: f'<form class="newsletter"><label>{say(1, 3)[:-1]}</label><input name="e"><button>Go</button></form>',
    "share": lambda say: '<div class="share"><a href="x">Mail</a> <a href="y">Print</a></div>',
    "two": lambda say: f'<div class="share"><a href="x">Mail</a></div><div class="promo"><p>{say(3, 9)}</p></div>',
}


def test_text_after_inner_blocks():
    """Articles of ordinary words with something else inside, which the labelled pages' generator did not write."""
    rng = random.Random(1)
    vocabulary = "the of and river stone market light morning village under between people work water garden history small road children winter story music paper north simple".split()
    say = lambda low, high: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(low, high))).capitalize() + "."
    crf, kept, wanted, wrong = default_model(), 0, 0, 0
    for _ in range(500):
        inner = rng.choice(list(INNER.values()))(say)
        before, after = ([say(15, 45) for _ in range(rng.randint(1, 4))] for _ in range(2))
        paragraphs = lambda ps: "".join(f"<p>{p}</p>" for p in ps)
        page = (f"<html><head><title>x</title></head><body><nav><a href='/'>Home</a> <a href='/a'>About</a></nav><article><h1>{say(3, 8)[:-1]}</h1>"
                f"{paragraphs(before)}{inner}{paragraphs(after)}</article><footer>Copyright 2020</footer></body></html>")
        got = main_text(page, crf).split("\n\n")
        kept += sum(p in got for p in before + after)
        wanted += len(before + after)
        wrong += sum(b.text in got for b in leaf_blocks(inner))
    assert kept >= 0.99 * wanted and wrong <= 0.01 * wanted


def test_text_of_all_inline_elements():
    page = "<body><article><h1>On limits</h1><p>Let <math><mi>x</mi></math> be a small number, and <object>this</object> a text of some length.</p><p>Then it ends.</p></article><noscript>Please enable JavaScript.</noscript></body>"
    assert main_text(page, default_model()) == "On limits\n\nLet x be a small number, and this a text of some length.\n\nThen it ends."


def test_broken_markup():
    crf = default_model()
    for html in (None, "", "   ", "<", "<p", "<!-- open", "<script>never closed", "</p></div>", "<p>a<p>b<div>", "<![CDATA[x", "a < b > c", "\x00<p>퟿</p>", "<a href='x>y</a>" * 300, "<div>" * 3000 + "deep" + "</div>" * 3000):
        assert isinstance(main_text(html, crf), str)


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "r", "t"), (1, "u", PAGE, "r", "t"), (None, None, None, None, None), (3, "v", "", "r", "t")], "page_id long, url string, html string, row string, text string")
    got = [tuple(r) for r in page_report(pages).orderBy("page_id").collect()]
    text = main_text(PAGE, default_model())
    assert got == [(None, None, "", 0), (1, "u", text, len(text)), (1, "u", text, len(text)), (3, "v", "", 0)]
    assert extract(pages).where("row.row = 'r'").count() == 3
    assert page_report(pages.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    got = page_report(pages).collect()
    assert len(got) == pages.count()
    assert sum(r["n_chars"] > 0 for r in got) >= 0.95 * len(got)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


#: Pages written by hand, of layouts of all ages, with the blocks of their main text.
BY_HAND = [
    ("""<html><head><title>Garden</title></head><body><table width="100%"><tr><td><a href="/">Home</a> <a href="/b">Blog</a></td><td><h1>Growing tomatoes</h1>
     <p>Tomatoes need sun and warm soil to grow well.</p><p>Water them every morning in summer.</p></td><td>Buy cheap seeds now!</td></tr></table></body></html>""",
     ["Growing tomatoes", "Tomatoes need sun and warm soil to grow well.", "Water them every morning in summer."]),
    ("""<body><header class="masthead"><a href="/">The Daily</a></header><main><h1>A walk by the river</h1><p>We walked along the river for hours.</p><p>It rained in the end.</p>
     <div class="user-reviews"><h4>Reviews</h4><p>Nice walk, I did it too.</p></div></main><footer>&copy; 2020 The Daily</footer></body>""",
     ["A walk by the river", "We walked along the river for hours.", "It rained in the end."]),
    ("""<body><div class="cookie-banner">We use cookies to make this site better. <button>Accept</button></div><div id="content"><h2>Bread</h2><p>Mix flour and water, then wait for an hour.</p>
     <ul><li>500 g flour</li><li>300 g water</li></ul></div><div id="sidebar"><h3>Popular</h3><ul><li><a href="/1">Ten cakes</a></li></ul></div></body>""",
     ["Bread", "Mix flour and water, then wait for an hour.", "500 g flour", "300 g water"]),
    ("<html><body><h1>Plain page</h1><p>This page has no containers at all, just text.</p><p>And a second paragraph.</p></body></html>",
     ["Plain page", "This page has no containers at all, just text.", "And a second paragraph."]),
    ("""<body><div id="wrap"><div id="top-nav"><ul><li><a href="/">Start</a><li><a href="/x">Archive</a></ul></div><div class="entry-content"><h1>On old maps</h1>
     <p>Old maps show what people knew, and what they guessed.</p><blockquote><p>Here be dragons.</p></blockquote><p>Few maps ever said so.</p></div>
     <div id="comments"><ol class="comment-list"><li><p>Great post about maps!</p></li><li><p>I have one at home.</p></li></ol><form><label>Name</label><p>Leave a reply</p></form></div></div></body>""",
     ["On old maps", "Old maps show what people knew, and what they guessed.", "Here be dragons.", "Few maps ever said so."]),
    ("""<body><article><header><h1>Night trains</h1></header><p>Night trains are coming back to many lines.</p><aside class="related"><a href="/r">Ten best lines</a></aside>
     <p>Tickets cost less than a hotel.</p><div class="newsletter-signup"><p>Sign up for our newsletter</p></div></article><nav class="pagination"><a href="/2">Next page</a></nav></body>""",
     ["Night trains", "Night trains are coming back to many lines.", "Tickets cost less than a hotel."]),
    ("""<body><div class="alert notice">This shop is closed on Sundays.</div><div class="post"><h1>Repairing a bicycle</h1><p>Take off the wheel before you start. Keep the nuts in a cup.</p>
     <pre>wheel, tube, tyre</pre><table><tr><td>Tube</td><td>5 euros</td></tr></table><div class="share-buttons"><a href="/f">Share</a> <a href="/t">Tweet</a></div></div>
     <div class="footer">All rights reserved.</div></body>""",
     ["Repairing a bicycle", "Take off the wheel before you start. Keep the nuts in a cup.", "wheel, tube, tyre", "Tube", "5 euros"]),
    ("""<body><section id="main"><div class="story"><h2>Der Zug</h2><p>Der Zug f&auml;hrt um acht Uhr ab.</p><p>Er kommt am Abend an.</p></div><section class="discussion"><h3>Kommentare</h3><p>Sch&ouml;n.</p></section></section>
     <div class="sponsored"><p>G&uuml;nstig reisen mit uns!</p></div></body>""",
     ["Der Zug", "Der Zug fährt um acht Uhr ab.", "Er kommt am Abend an."]),
]


def test_pages_written_by_hand():
    crf = default_model()
    hit = found = wanted = exact = 0
    for html, expected in BY_HAND:
        got = main_text(html, crf).split("\n\n")
        hit += len(set(got) & set(expected))
        found += len(got)
        wanted += len(expected)
        exact += got == expected
    assert 2 * hit / (found + wanted) >= 0.95
    assert exact >= len(BY_HAND) - 2

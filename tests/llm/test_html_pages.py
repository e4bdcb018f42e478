"""Main text of labelled pages of several kinds, and the whole extraction against all labellings of small pages."""

from __future__ import annotations

import itertools
import random
import re
import time

from linekin.llm import html_text

W = html_text.train()

#: Pages; lines that begin with "+" are main text, "-" are not. Markup stands around the text.
PAGES = [
    # A table layout without classes.
    """<html><body><table><tr><td><a href=1>-Home</a><a href=2>-News</a></td></tr><tr><td><font size=2><p>+The mill on the hill was built in 1820 by two brothers.</p>
<p>+It burned down twice, and twice it was built again.</p><p>+See <a href=x>the map</a> for its place.</p></font></td></tr><tr><td><center>-© 2004 Hill Society. All rights reserved.</center></td></tr></table></body></html>""",
    # Nested containers without meaning in their names.
    """<body><div id=a1><div id=b1><ul><li><a href=/>-Start</a></li><li><a href=/w>-Work</a></li><li><a href=/k>-Contact us</a></li></ul></div></div><div id=c7><div><h1>+How to bake rye bread</h1>
<p>+Mix the flour with water and leave it in a warm place for a day.</p><p>+Knead well.</p><ol><li>+Form a loaf and cover it with a cloth.</li><li>+Bake it for one hour at moderate heat.</li></ol></div></div>
<div><p>-We use cookies on this site. Accept?</p></div></body>""",
    # An article with sections that are none of it.
    """<article><h1>+River levels rise</h1><p>+The river rose by a metre overnight, and the lower bridge is closed to all traffic.</p><p><a href=n>+The full table of levels is kept by the harbour office and shown here.</a></p><p>+Photo: J. Hill</p>
<h3>-Related stories</h3><ul><li><a href=1>-A dry summer ahead</a></li><li><a href=2>-Bridges of the north</a></li></ul><h3>-Comments</h3><p>-I crossed it yesterday and it was fine, really.</p><p>-Comments are closed.</p></article>""",
    # Only one paragraph.
    "<html><body><p>+Hello</p></body></html>",
    "+Only plain text, without any tag at all.",
    # A blog of the usual kind.
    """<body class=home><header class=site-header><h1>-My blog</h1><p>-Thoughts on boats and other things.</p></header><main id=content><div class=entry-content><h2>+Varnish</h2><p>+Three coats are enough for most woods, if you sand between them.</p>
<blockquote><p>+Patience is the best brush, they say.</p></blockquote><pre>+sand; coat; wait</pre></div><div class="share-buttons"><a href=t>-Share on this and that</a></div></main><aside class=sidebar><h4>-About me</h4><p>-I sail a small boat on a large lake.</p></aside>
<div id=disqus_thread><p>-Nice post, thank you so much for the advice!</p></div><footer><p>-Powered by wind. Copyright 2011.</p></footer></body>""",
    # Answers in a definition list, unclosed elements.
    """<div class=main><h1>+Questions</h1><dl><dt>+May I bring a dog?<dd>+Yes, if it is on a lead and does not bark at night.<dt>+When do you open?<dd>+At nine every day but Monday.</dl></div><div class=footer><ul><li><a href=i>-Imprint</a><li><a href=p>-Privacy policy</a></ul></div>""",
    # A newsletter box inside the text.
    """<article><p>+The committee met on Tuesday and spoke for three hours about the roof.</p><div class=newsletter><p>-Get our news by mail every week.</p><form><input name=m><button>Go</button></form></div><p>+No decision was made, but a new estimate is due in May.</p>
<p>+The roof has leaked since the storm of last autumn.</p></article>""",
    # Short paragraphs and an anchor that is never closed.
    """<article><a name=top><p>+One.</p><p>+Two.</p><p>+Three is a little longer than both.</p><p>+Four.</p></article><nav><a href=1>-Next</a><a href=2>-Back</a></nav>""",
    # Words of notices inside long sentences are text.
    """<main><h1>+Cookies through the ages</h1><p>+Nobody knows who baked the first cookie, but many sailors wrote down that we use cookies of oats and honey on long voyages.</p><p>+Copyright law, on the other hand, began much later, and a newsletter of 1710 tells of it at length to all of its readers.</p></main>""",
    # An advert between paragraphs; hidden text; a skip link.
    """<body><a href=#c>-Skip to main content</a><div class=content id=c><p>+The old road runs along the ridge and down to the sea, as it always has.</p><div class="ad-banner"><p>-Buy one, get one free. Only today!</p></div><p>+At low tide you can walk on the sand to the next village.</p>
<p hidden>-This is not shown to anyone at all.</p></div></body>""",
    # A product page with reviews.
    """<div id=main><h1>+Garden spade</h1><p>+A spade of forged steel with a handle of ash, made to last a lifetime.</p><ul><li>+Weight: 2 kg</li><li>+Length: 110 cm</li></ul><p>-Add to cart</p></div><div class=reviews><h2>-Customer reviews</h2><p>-Broke after a week, I want my money back.</p></div>""",
]


def marked(page):
    """The page without its marks, and the (mark, text) of each marked block, inline tags left out."""
    clean, blocks = "", []
    for part in re.split(r"(?:(?<=>)|^)(?=[+-])", page):
        if part[:1] in "+-" and part[:1]:
            text = re.split(r"</?(?:p|a(?= href=[0-9iptk])|li|h[1-4]|td|center|dt|dd|blockquote|pre|div|ol|ul|dl|article|main)\b", part[1:])[0]
            blocks.append((part[0], " ".join(re.sub(r"<[^>]*>", "", text).split())))
            part = part[1:]
        clean += part
    return clean, [b for b in blocks if b[1]]


def test_labelled_pages():
    right = wrong = lost = 0
    for page in PAGES:
        clean, blocks = marked(page)
        got = html_text.extract(clean, W)
        for mark, text in blocks:
            if mark == "+":
                right, lost = right + (text in got), lost + (text not in got)
            else:
                wrong += any(text in line for line in got.split("\n"))
    assert right + lost > 35
    assert right / (right + lost) >= 0.95 and right / (right + wrong) >= 0.95, (right, lost, wrong)


def cheapest(prices, joins):
    def cost(keep):
        return sum(p for p, k in zip(prices, keep, strict=True) if p > 0 and not k) + sum(-p for p, k in zip(prices, keep, strict=True) if p < 0 and k) + sum(c for a, b, c in joins if keep[a] != keep[b])

    every = list(itertools.product([False, True], repeat=len(prices)))
    least = min(map(cost, every))
    return [k for k in every if cost(k) == least]


def test_extraction_is_the_cheapest_labelling():
    r = random.Random(4)
    tags = ["p", "div", "li", "h2", "section class=sidebar", "article", "nav", "footer", "td", "div class=comment", "span", "a href=x", "aside"]
    texts = ["One.", "A longer sentence that reads well, as it has a few words.", "Menu", "Related", "Log in", "word " * 30 + "."]
    for _ in range(300):
        page = ""
        for _ in range(r.randint(1, 7)):
            open_ = [r.choice(tags) for _ in range(r.randint(0, 3))]
            page += "".join(f"<{t}>" for t in open_) + r.choice(texts) + "".join(f"</{t.split()[0]}>" for t in reversed(open_) if r.random() < 0.8)
        found = html_text.blocks(page)
        # A plain sum of features and weights, and all labellings.
        rows = html_text.features(found)
        prices = [round(max(-20.0, min(20.0, sum(a * b for a, b in zip(row, W, strict=True)))) * html_text.UNIT) for row in rows]
        best = ["\n".join(text for (_, text), k in zip(found, keep, strict=True) if k) for keep in cheapest(prices, html_text.edges(found))]
        assert html_text.extract(page, W) in best


def test_text_is_kept_where_it_was_lost():
    article = "<article><p><a name='top'>First sentence of it.</p><p>Second one of it here.</p><p>Third.</p></article>"
    assert html_text.extract(article, W) == "First sentence of it.\nSecond one of it here.\nThird."
    assert html_text.extract("<body><p>Hello</p></body>", W) == "Hello" and html_text.extract("plain &amp; simple", W) == "plain & simple"
    assert html_text.extract("<article><h3>Related</h3><p>Comments are open here.</p></article>", W) == ""


def test_scanning_is_linear():
    took = []
    for n in (20_000, 40_000):
        start = time.process_time()
        html_text.extract("<svg><object><select><canvas>" * n, W)
        html_text.extract("<p><div>" + "<span class=x>" * n + "<h2>x</h2>" * 300, W)
        took.append(time.process_time() - start)
    assert took[1] < 4 * took[0] + 0.5


def test_very_long_page():
    page = "<article>" + "<p>word here.</p>" * 60_000 + "</article>"
    assert html_text.extract(page, W).count("\n") == 59_999

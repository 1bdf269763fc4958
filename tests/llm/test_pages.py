"""The page parser on hostile pages, and the labeller on layouts that its generator doesn't make."""

import time

import numpy as np
import pytest

from eventloom.llm import htmltext

#: Units of hostile pages: unclosed quotes and tags, deep nesting, ends without a start, many different names.
UNITS = ['<a "', "<a '\"", "<a <", "<div><p>x", "</script ", "<script>", "<!", "<b>", "</b>x<i>", "<svg>", "<table><tr>", '"', '<li class="q w">x', '<div class="{name}">x']


def repeated(unit: str, size: int) -> str:
    names = (f"{a}{b}-x" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz")
    return "".join(unit.replace("{name}", next(names, "y")) for _ in range(size // len(unit)))


@pytest.mark.parametrize("unit", UNITS)
def test_a_megabyte_of_anything_is_read_in_seconds(unit):
    start = time.process_time()
    page = htmltext.Page(htmltext.blocks_of(repeated(unit, 1_000_000)))
    assert time.process_time() - start < 20
    assert len(page.paths) <= max(1, page.n)


def test_many_blocks_are_labelled_whole():
    page = "<nav><a href=/>Home</a></nav><article><h1>Title here</h1>" + "<p>One more sentence of the long article stands here.</p>" * 20_000 + "</article><footer>All rights reserved.</footer>"
    text = htmltext.extract([page], htmltext.model())[0]
    assert text.count("One more sentence") == 20_000 and "Home" not in text and "rights" not in text


PROSE = [
    "The council met on Tuesday to discuss the new bridge over the river, which has been planned for years.",
    "Engineers said that the foundations would need to be deeper than expected because of the soft ground.",
    "A final decision is expected before the end of the year, according to the mayor.",
]
P = "".join(f"<p>{x}</p>" for x in PROSE)
MENU = '<nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
FOOT = '<footer class="site-footer"><p>All rights reserved. <a href="/i">Imprint</a></p></footer>'
SIDE = '<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/a">Ten tips</a></li><li><a href="/b">What to cook</a></li></ul></aside>'
HEAD = '<header class="masthead"><a href="/">The Paper</a></header>'
SAID = "I do not agree with this at all, and neither does my neighbour."
H, SUB = "A new bridge for the town", "What happens next"
#: Layouts by name: the page and the lines of its main text (all of PROSE where there are none). None was made by the generator.
LAYOUTS = {
    "main with microdata": f'<body>{MENU}<main itemscope><div itemprop="articleBody" class="article-body">{P}</div></main>{SIDE}{FOOT}</body>',
    "sections of a story": f'<body>{HEAD}<div class="page"><section class="story"><section>{P}</section></section><div class="share"><a href="#">Share</a><a href="#">Tweet</a></div></div>{FOOT}</body>',
    "breaks inside an entry": f'<body>{MENU}<div class="post"><div class="entry-content">{"".join(f"<div>{x}</div>" for x in PROSE)}</div></div><div id="comments" class="comments"><p class="comment">{SAID}</p></div>{FOOT}</body>',
    "attributes without quotes": f"<body><div id=nav><a href=/>Home</a> <a href=/x>Login</a></div><article class=content>{P}</article><div class=cookie-notice><p>We use cookies to improve your experience.</p><button>Accept all</button></div></body>",
    "upper case and unclosed": "<BODY><UL CLASS=menu><LI><A HREF=/>Home</A><LI><A HREF=/x>News</A></UL><ARTICLE>" + "".join(f"<P>{x}" for x in PROSE) + "</ARTICLE><DIV CLASS=footer><P>All rights reserved.</DIV></BODY>",
    "bare body": ("<html><body>Bare body text of a page, with nothing round it but that.</body></html>", ["Bare body text of a page, with nothing round it but that."]),
    "a line without markup": ("A short line.", ["A short line."]),
    "long text without markup": (" ".join(PROSE), [" ".join(PROSE)]),
    "paragraphs alone": P,
    "bare heading and paragraphs": (f"<html><head><title>{H}</title></head><body><h1>{H}</h1>{P}</body></html>", [H, *PROSE]),
    "bare preformatted": ("<html><body><pre>first line of it\n  second line of it</pre></body></html>", ["first line of it second line of it"]),
    "definition list": (f"<body>{MENU}<main><article><h1>{H}</h1>{P}<dl><dt>Term</dt><dd>Its definition in a sentence.</dd></dl></article></main>{FOOT}</body>", [H, *PROSE, "Term", "Its definition in a sentence."]),
    "glossary": (f"<body>{HEAD}{MENU}<article><dl><dt>Pier</dt><dd>A support that stands in the water.</dd><dt>Span</dt><dd>The part between two supports.</dd></dl></article>{FOOT}</body>", ["Pier", "A support that stands in the water.", "Span", "The part between two supports."]),
    "code, list and table": (f"<body>{MENU}<main><article><p>{PROSE[0]}</p><pre>x = 1</pre><ul><li>One thing</li><li>Another</li></ul><table><tr><td>Length</td><td>300 m</td></tr></table><p>{PROSE[1]}</p></article></main>{FOOT}</body>", [PROSE[0], "x = 1", "One thing", "Another", "Length", "300 m", PROSE[1]]),
    "comments with a count": (f'<body>{MENU}<article><h1>{H}</h1>{P}</article><div id=comments><h2>Comments (2)</h2><div class=comment><p>{SAID}</p></div><div class=comment><p>Well said.</p></div></div>{FOOT}</body>', [H, *PROSE]),
    "discussion of posts": f"<body>{HEAD}<main><article>{P}</article><div class=discussion><div class=post><b>bob</b> I think it is too dear.</div><div class=post><b>ann</b> {SAID}</div></div></main>{FOOT}</body>",
    "nested replies": f'<body>{MENU}<article>{P}</article><section class="responses"><h3>3 responses</h3><ol><li><p>{SAID}</p><ol><li><p>Nor do I, to be honest.</p></li></ol></li></ol></section>{FOOT}</body>',
    "thread without names": f"<body>{MENU}<article>{P}</article><section><h2>Comments</h2><div><b>bob</b><p>{SAID}</p></div><div><b>eve</b><p>It was about time.</p></div></section>{FOOT}</body>",
    "comments inside the article": f'<body>{MENU}<article>{P}<div class="comments"><h3>Leave a comment</h3><p>{SAID}</p></div></article>{FOOT}</body>',
    "figure": (f"<body>{MENU}<article><p>{PROSE[0]}</p><figure><img src=a.jpg><figcaption>The river in spring.</figcaption></figure><p>{PROSE[1]}</p></article>{FOOT}</body>", [PROSE[0], "The river in spring.", PROSE[1]]),
    "quotation": (f"<body>{MENU}<article><p>{PROSE[0]}</p><blockquote><p>We need it now.</p></blockquote><p>{PROSE[1]}</p></article>{FOOT}</body>", [PROSE[0], "We need it now.", PROSE[1]]),
    "numbered steps": (f"<body>{HEAD}<article><h1>{H}</h1><ol><li>Dig the ground.</li><li>Pour the concrete.</li><li>Wait for a month.</li></ol></article>{FOOT}</body>", [H, "Dig the ground.", "Pour the concrete.", "Wait for a month."]),
    "table with a head": (f"<body>{MENU}<article><p>{PROSE[0]}</p><table><caption>Costs</caption><thead><tr><th>Year</th><th>Sum</th></tr></thead><tbody><tr><td>2020</td><td>3 million</td></tr></tbody></table></article>{FOOT}</body>", [PROSE[0], "Costs", "Year", "Sum", "2020", "3 million"]),
    "headings between": (f"<body>{MENU}<article><h1>{H}</h1><p>{PROSE[0]}</p><h2>{SUB}</h2><p>{PROSE[1]}</p><h3>And then</h3><p>{PROSE[2]}</p></article>{SIDE}{FOOT}</body>", [H, PROSE[0], SUB, PROSE[1], "And then", PROSE[2]]),
    "header of the article": (f"<body>{HEAD}{MENU}<article><header><h1>{H}</h1></header>{P}</article>{FOOT}</body>", [H, *PROSE]),
    "advert in the middle": f'<body>{MENU}<article><p>{PROSE[0]}</p><div class="advertisement"><p>Buy the best boots today. Free shipping.</p></div><p>{PROSE[1]}</p><p>{PROSE[2]}</p></article>{FOOT}</body>',
    "newsletter in the middle": f'<body>{MENU}<article><p>{PROSE[0]}</p><form class="newsletter"><label>Email</label><input><button>Subscribe</button></form><p>{PROSE[1]}</p><p>{PROSE[2]}</p></article>{FOOT}</body>',
    "related in the middle": f'<body>{MENU}<div class="article-body"><p>{PROSE[0]}</p><div class="related"><h4>Related articles</h4><ul><li><a href="/z">The old bridge</a></li></ul></div><p>{PROSE[1]}</p><p>{PROSE[2]}</p></div>{FOOT}</body>',
    "sidebar first": f"<body>{HEAD}{SIDE}<main>{P}</main>{FOOT}</body>",
    "cookie notice first": f'<body><div class="cookie-consent"><p>This site uses cookies. By continuing you agree.</p><button>Accept all</button></div>{MENU}<div id="content">{P}</div>{FOOT}</body>',
    "crumbs and pages": f'<body>{HEAD}<div class="breadcrumb"><a href="/">Home</a> <a href="/t">Town</a></div><div class="content">{P}</div><div class="pagination"><a href="?2">Next</a></div>{FOOT}</body>',
    "table as a layout": f'<body><table><tr><td class="menu"><a href="/">Home</a><br><a href="/n">News</a></td><td class="content">{P}</td></tr></table><div class="footer">All rights reserved.</div></body>',
    "divisions without names": f"<body><nav><a href=/>Home</a></nav><div><div>{P}</div></div><footer>All rights reserved.</footer></body>",
    "loose text in an article": (f"<body>{MENU}<article>{PROSE[0]}<p>{PROSE[1]}</p>{PROSE[2]}</article>{FOOT}</body>", PROSE),
    "one short paragraph": (f"<body>{MENU}<article><p>Closed today.</p></article>{FOOT}</body>", ["Closed today."]),
    "many links in the text": (f'<body>{MENU}<article><p><a href="/1">The council</a> met <a href="/2">on Tuesday</a> to speak about <a href="/3">the bridge</a>.</p><p>{PROSE[1]}</p></article>{FOOT}</body>', ["The council met on Tuesday to speak about the bridge.", PROSE[1]]),
    "author box and tags": f'<body>{MENU}<article>{P}</article><div class="author-box"><p>Jo writes of towns and rivers.</p></div><div class="tags"><a href="/t/b">bridge</a> <a href="/t/c">council</a></div>{FOOT}</body>',
    "search and login": f'<body><header><form class="search"><input><button>Search</button></form><a href="/l">Sign in</a></header><article>{P}</article>{FOOT}</body>',
    "nested list": (f"<body>{MENU}<article><p>{PROSE[0]}</p><ul><li>Costs<ul><li>Steel</li><li>Stone</li></ul></li><li>Time</li></ul></article>{FOOT}</body>", [PROSE[0], "Costs", "Steel", "Stone", "Time"]),
    "code in a division": (f'<body>{MENU}<div class="post-content"><p>{PROSE[0]}</p><div class="highlight"><pre><code>if x:\n    y()</code></pre></div><p>{PROSE[1]}</p></div>{FOOT}</body>', [PROSE[0], "if x: y()", PROSE[1]]),
    "two articles": (f"<body>{MENU}<main><article><h2>{H}</h2><p>{PROSE[0]}</p></article><article><h2>{SUB}</h2><p>{PROSE[1]}</p></article></main>{FOOT}</body>", [H, PROSE[0], SUB, PROSE[1]]),
    "references and breaks": (f"<body>{MENU}<article><p>Fish &amp; chips cost 5&nbsp;&euro;<br>at the new bridge.</p><p>{PROSE[1]}</p></article>{FOOT}</body>", ["Fish & chips cost 5 € at the new bridge.", PROSE[1]]),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_that_no_generator_made(name):
    page, lines = LAYOUTS[name] if isinstance(LAYOUTS[name], tuple) else (LAYOUTS[name], PROSE)
    assert htmltext.extract([page], htmltext.model())[0].split("\n") == lines


def test_weights_of_the_package_are_those_of_a_training():
    """A short training by the same code learns what the stored weights know."""
    from eventloom.llm.pagemaker import made_pages

    weights = htmltext.trained(pages=300, seed=htmltext.SEED + 1)
    assert {k: v.shape for k, v in weights.items()} == {k: v.shape for k, v in htmltext.model().items()}
    right = []
    for page, truth in made_pages(40, 99):
        blocks = htmltext.blocks_of(page)
        right += [(o > 0) == (b.text in truth) for o, b in zip(htmltext.scores(weights, [htmltext.Page(blocks)])[0], blocks, strict=True)]
    assert np.mean(right) > 0.9


def test_repeated_pages_and_no_pages(spark):
    rows = [(1, "u", LAYOUTS["main with microdata"])] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = htmltext.main_text(pages).collect()
    assert [r["text"] for r in got] == ["\n".join(PROSE)] * 2
    assert htmltext.main_text(pages.limit(0)).collect() == []

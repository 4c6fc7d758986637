"""Main text of page layouts that the model is not trained on."""

import time

import pytest

from apiloom.llm import html_extraction as H
from apiloom.llm.html_dom import parse

P1 = "The old mill stood by the river for two hundred years before the flood of last spring took it away."
P2 = "Nobody in the village had expected the water to rise so fast, and many lost what they had in their cellars."
P3 = "The council met on Thursday evening to talk about what should be built in its place, and who should pay."
C1 = "I remember playing there as a child, such a loss for all of us who grew up in the valley."
C2 = "They should have repaired the dam years ago, but nobody in the town hall would listen to us."
LINKS = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul>'
BODY = f"<h1>The mill is gone</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p>"
MAIN = f"The mill is gone {P1} {P2} {P3}"

LAYOUTS = {
    "comments in the article": (f"<html><body><nav>{LINKS}</nav><article>{BODY}<div class='comments'><h3>Comments</h3><p>{C1}</p><p>{C2}</p></div></article><footer>Imprint</footer></body></html>", MAIN),
    "boilerplate in the article": (
        f"<html><body><article><nav><a href='/'>Menu</a></nav><h1>The mill is gone</h1><p>{P1}</p><div class='advert'>Advert text</div><p>{P2}</p><aside>Read also: other floods</aside><p>{P3}</p>"
        f"<form><p>Subscribe</p><button>Go</button></form><div class='ad'><p>Buy our great new shoes today</p></div><div class='notice'>This text was changed on Monday.</div></article></body></html>",
        MAIN,
    ),
    "no article": (f"<html><body><div class='top'>{LINKS}</div><div id='story'>{BODY}</div><div class='footer'>All rights reserved</div></body></html>", MAIN),
    "bare blocks": (f"<html><body><div id='nav'>{LINKS}</div><div>{BODY}</div><div id='comments'><p>{C1}</p><p>{C2}</p></div></body></html>", MAIN),
    "main and sidebars": (f"<html><body><header><h2>The Valley Paper</h2></header><main>{BODY}</main><aside><h3>Most read</h3>{LINKS}</aside><aside class='ads'><p>New cars at low prices this week only.</p></aside></body></html>", MAIN),
    "table layout": (f"<html><body><table><tr><td class='menu'>{LINKS}</td><td class='text'>{BODY}</td><td class='ads'>Cheap flights to the sea</td></tr></table></body></html>", MAIN),
    "comment list": (f"<html><body><nav>{LINKS}</nav><section class='entry'>{BODY}</section><ol class='comment-list'><li><p>{C1}</p></li><li><p>{C2}</p></li></ol></body></html>", MAIN),
    "cookie notice first": (f"<html><body><div class='cookie-banner'><p>We and our partners use cookies to show you adverts and to count visits.</p><button>Accept</button></div><article>{BODY}</article></body></html>", MAIN),
    "nested wrappers": (f"<html><body><div class='page'><div class='container'><div class='header'>{LINKS}</div><div class='row'><div class='post-content'>{BODY}</div><div class='sidebar'>{LINKS}</div></div></div></div></body></html>", MAIN),
    "form and search": (f"<html><body><form class='search'><p>Search this site</p></form><div role='main'>{BODY}</div><form><p>Leave a reply, your address will not be shown.</p><textarea>text</textarea></form></body></html>", MAIN),
    "lists and quotes are content": (
        f"<html><body><nav>{LINKS}</nav><article><h1>The mill is gone</h1><p>{P1}</p><ul><li>Two barns were damaged, and a bridge</li><li>The road to the north is still closed</li></ul><blockquote><p>{P2}</p></blockquote></article></body></html>",
        f"The mill is gone {P1} Two barns were damaged, and a bridge The road to the north is still closed {P2}",
    ),
    "share and tags": (f"<html><body><article>{BODY}<div class='share'><a href='/f'>Share</a> <a href='/m'>Mail</a></div><div class='tags'><a href='/t'>floods</a></div></article></body></html>", MAIN),
    "related inside": (f"<html><body><article><h1>The mill is gone</h1><p>{P1}</p><div class='related'><h3>More</h3>{LINKS}</div><p>{P2}</p><p>{P3}</p></article></body></html>", MAIN),
    "newsletter box": (f"<html><body><main><article>{BODY}</article><div class='newsletter'><p>Get the best stories of the week by mail, for free.</p></div></main></body></html>", MAIN),
    "reader comments section": (f"<html><body><div id='content'>{BODY}</div><section id='comments' class='reader-comments'><h2>What readers say</h2><div class='comment'><p>{C1}</p></div><div class='comment'><p>{C2}</p></div></section></body></html>", MAIN),
    "scripts and references": (f"<html><head><title>x</title><style>p{{}}</style></head><body><script>var a='<p>no</p>';</script><article><h1>The mill is gone</h1><p>{P1.replace('two', '&#116;wo')}</p><p>{P2}</p>\n\n<p>{P3}<script>b()</script></article></body></html>", MAIN),
}


@pytest.fixture(scope="module")
def models(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    return {"alone": H.train([]), "table": H.train(pages[:60]), "query": H.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
@pytest.mark.parametrize("kind", ["alone", "table", "query"])
def test_layout(models, kind, name):
    page, want = LAYOUTS[name]
    assert models[kind].extract(page) == want


FOOT = "<div class='footer'>All rights reserved</div>"
#: Articles without paragraphs, and containers of names that no template has.
BARE = {
    "text between br": (f"<html><body><nav>{LINKS}</nav><article>{P1}<br><br>{P2}</article><footer>Imprint</footer></body></html>", f"{P1} {P2}"),
    "short text between br": ("<html><body><article>A<br><br>B</article></body></html>", "A B"),
    "div for p": (f"<article><div>{P1}</div><div>{P2}</div></article>", f"{P1} {P2}"),
    "short div for p": ("<article><div>A</div><div>B</div></article>", "A B"),
    "one span": (f"<article><span>{P1}</span></article>", P1),
    "content cut by br": (f"<html><body><div class='menu'>{LINKS}</div><div class='content'>{P1}<br>{P2}<br>{P3}<br>{P1}</div>{FOOT}</body></html>", f"{P1} {P2} {P3} {P1}"),
    "bare body": (f"<html><body>{P1} {P2}</body></html>", f"{P1} {P2}"),
    "text and p": (f"<html><body><nav>{LINKS}</nav><article>{P1}<p>{P2}</p></article></body></html>", f"{P1} {P2}"),
    "heading, text and p": (f"<html><body><nav>{LINKS}</nav><article><h1>The mill is gone</h1>{P1}<p>{P2}</p></article></body></html>", f"The mill is gone {P1} {P2}"),
    "nested div of unknown names": (f"<html><body><div class='zork'>{LINKS}</div><div class='blurb'><div><div>{P1}</div><div>{P2}</div></div></div><div class='gnorp'>Imprint</div></body></html>", f"{P1} {P2}"),
    "br in unknown names": (f"<html><body><div class='quux'>{LINKS}</div><div class='lorem'><h2>The mill</h2>{P1}<br>{P2}<br>{P3}</div><div class='plugh'>{LINKS}</div></body></html>", f"The mill {P1} {P2} {P3}"),
    "comments of an unknown name after it": (f"<html><body><nav>{LINKS}</nav><article>{BODY}</article><div class='opinions'><p>{C1}</p><p>{C2}</p></div></body></html>", MAIN),
}


@pytest.mark.parametrize("name", sorted(BARE))
@pytest.mark.parametrize("kind", ["table", "query"])
def test_bare_text(models, kind, name):
    page, want = BARE[name]
    assert models[kind].extract(page) == want


def test_stray_end_tags_are_linear():
    began = time.time()
    tree = parse("<div>" * 20_000 + "x" + "</section></p></li>" * 20_000)
    assert tree.blocks[0][0] == 20_000 and time.time() - began < 5


def test_training_is_short(models):
    began = time.time()
    H.train([LAYOUTS["comments in the article"][0]] * 60)
    assert time.time() - began < 10

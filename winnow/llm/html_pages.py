"""Labelled pages to train the extraction model on.

Elements marked `data-main` hold the article; `data-main="no"` inside of them is not part of it.
The layouts are made up: common arrangements of public web pages, with filler sentences.
"""

from __future__ import annotations

_FILLER = (
    "The river rose during the night and reached the lower fields by noon. "
    "People moved their tools, their animals and most of the grain to the hill. "
    "Nobody had expected so much water this early in the year! "
    "Since then, the council has met twice, but it has not agreed on a new dam. "
    "What would it cost, and who would pay for it? "
    "An engineer who knows the valley said that the old walls could be repaired. "
    "Her report, which has forty pages, will be read in public next week. "
)
_SENTENCES = [s + "." if s[-1] not in "!?" else s for s in _FILLER.replace("! ", "!. ").replace("? ", "?. ").strip().rstrip(".").split(". ")]


def _text(n: int, first: int = 0) -> str:
    return " ".join(_SENTENCES[(first + i) % len(_SENTENCES)] for i in range(n))


def _links(*names: str) -> str:
    return "".join(f'<li><a href="/{n}">{n}</a></li>' for n in names)


def _paragraphs(*sizes: int) -> str:
    return "".join(f"<p>{_text(n, i)}</p>" for i, n in enumerate(sizes))


_NAV = f"<nav><ul>{_links('Home', 'News', 'Sport', 'Contact us')}</ul></nav>"
_MENU = f'<div class="menu"><ul>{_links("Start", "Products", "Prices", "Help")}</ul></div>'
_FOOTER = "<footer><p>&copy; 2020 The Valley News. All rights reserved.</p></footer>"
_ASIDE = f"<aside><h3>Related</h3><ul>{_links('A dry summer ahead', 'The bridge is closed')}</ul><p>{_text(1)}</p></aside>"
_AD = f'<div class="ad">{_text(1, 2)}</div>'
_COMMENTS = f'<section class="comments"><h3>2 comments</h3><div class="comment"><p>{_text(2, 4)}</p></div><div class="comment"><p>{_text(1, 1)}</p></div></section>'
_FORM = '<form action="/s"><label>Your address</label><p>Get our letter every week.</p></form>'
_COOKIES = f'<div id="cookie-notice"><p>We use cookies. {_text(1, 5)}</p></div>'
_TABLE = "<table><tr><th>Year</th><th>Level</th></tr><tr><td>2019</td><td>3.1 m</td></tr><tr><td>2020</td><td>4.5 m</td></tr></table>"
_HEADER = '<header><h2>The Valley News</h2><p>Every day since 1901</p></header>'

_BODIES = [
    f"{_NAV}{_AD}<article data-main><h1>High water</h1>{_paragraphs(3, 2, 4, 1)}</article>{_FOOTER}",
    f"{_NAV}{_AD}<article data-main><h1>Yes.</h1><p>{_text(1)}</p><p>No.</p></article>{_FOOTER}",
    f"{_HEADER}{_MENU}<main data-main><h1>High water</h1>{_paragraphs(2, 5, 3)}</main>{_ASIDE}{_FOOTER}",
    f"{_HEADER}{_NAV}<main><article data-main><h1>Title</h1>{_paragraphs(1, 3)}{_AD.replace('class', 'data-main="no" class')}{_paragraphs(2)}</article>{_COMMENTS}</main>{_ASIDE}{_FOOTER}",
    f'{_COOKIES}{_MENU}<div class="content" data-main><h1>High water</h1>{_paragraphs(4, 1, 2)}<ul><li>{_text(1)}</li><li>{_text(1, 3)}</li></ul></div><div class="sidebar"><h4>More</h4>{_paragraphs(1)}</div><div class="footer">{_text(1)}</div>',
    f'{_MENU}<div id="page"><div class="post" data-main><h2>Walls</h2>{_paragraphs(2, 2)}<blockquote><p>{_text(2, 5)}</p></blockquote>{_paragraphs(3)}</div><div id="comments"><div class="comment"><p>{_text(3)}</p></div><p>{_text(1, 2)}</p></div>{_FORM}</div>{_FOOTER}',
    f"<div><ul>{_links('One', 'Two', 'Three')}</ul></div><div data-main><h1>Plain</h1>{_paragraphs(3, 4, 3)}</div><div><p><a href='/x'>Imprint</a> <a href='/y'>Privacy</a></p></div>",
    f"{_HEADER}<div class='wrapper'><div data-main><h1>Plain</h1>{_paragraphs(2, 3)}{_TABLE}{_paragraphs(2)}</div><div class='related'><ul>{_links('This', 'That')}</ul></div></div>{_FOOTER}",
    f'{_NAV}<article data-main><h1>Levels</h1><pre>a = 1\nb = 2</pre>{_paragraphs(2)}<h2>Years</h2><dl><dt>2019</dt><dd>{_text(1)}</dd></dl>{_TABLE}<figure><figcaption>{_text(1)}</figcaption></figure><section class="comments" data-main="no"><p>{_text(2)}</p><article class="comment"><p>{_text(1)}</p></article></section></article>{_FOOTER}',
    f'{_NAV}{_FORM}<section class="article-body" data-main>{_paragraphs(3, 1, 2, 2)}</section><div class="newsletter"><p>{_text(1)}</p></div><div class="share"><ul>{_links("Mail", "Print")}</ul></div>{_FOOTER}',
    f'<header><nav><ul>{_links("Home")}</ul></nav><h1>Site</h1></header><article data-main><header><h1>High water</h1></header><section><h2>Part</h2>{_paragraphs(2, 2)}</section><section>{_paragraphs(3)}</section><footer data-main="no"><p>Tags: <a>water</a></p></footer></article><div class="banner">{_text(1)}</div>',
    f"{_NAV}{_AD}<article data-main><h1>Ha</h1>{'<p>Ha ha said he.</p>' * 30}</article>{_FOOTER}",
    f"{_MENU}<article data-main><h1>List</h1><p>one two</p>{'<p><b>one | two<br>' * 25}</article>{_ASIDE}{_FOOTER}",
    f"{_NAV}<article data-main><h1>Title</h1>{_paragraphs(3, 1)}<ul class='related' data-main='no'><li>{_text(1)}</li><li>{_text(1, 2)}</li></ul><div class='share' data-main='no'><p>Tell your friends</p></div>{_paragraphs(2)}</article><div id='comments' class='comments-area'><ol class='comment-list'><li class='comment'><article><p>{_text(1, 3)}</p></article></li><li class='reply'><article><p>{_text(2, 3)}</p></article></li></ol></div>",
    f"{_HEADER}<article data-main><h2>Title</h2>{_paragraphs(2, 1)}<aside data-main='no'><h4>Box</h4><p>{_text(2)}</p></aside>{_paragraphs(2)}</article><section class='discussion'><article><h5>A reader</h5><p>{_text(2, 3)}</p></article><article><h5>Another</h5><p>{_text(1, 3)}</p></article></section>{_FOOTER}",
    f"<div><a href='/'>Home</a> <a href='/x'>News</a></div><div data-main><h1>Plain</h1>{_paragraphs(2, 1)}</div><div>Copyright 2020</div>",
    f"<div><p><a href='/'>Home</a></p></div><div><div data-main><h2>Plain</h2>{_paragraphs(1, 3, 2)}</div><div><ul>{_links('A', 'B')}</ul></div></div>",
    f"<div><table><tr><td><a href='/'>Home</a></td><td><a href='/x'>News</a></td></tr></table></div><div data-main>{_paragraphs(3, 1, 2)}{_TABLE}</div>",
    f"{_NAV}{_AD}<article data-main><h1>Ha</h1>{'<p>It rained and then it rained on.</p>' * 60}</article>{_FOOTER}",
    f"{_NAV}{_AD}<article data-main><h1>Ha</h1>{('<p>' + 'It rained. ' * 20 + '</p>') * 60}</article>{_FOOTER}",
    f"{_NAV}{_FORM}{_FOOTER}",
    f"{_HEADER}{_MENU}<ul>{_links('A dry summer ahead', 'The bridge is closed', 'Results of the day')}</ul>{_FOOTER}",
    f'<div class="cookie consent">{_text(2)}</div><div class="promo"><h3>Offer</h3><p>{_text(1)}</p></div><div class="story" data-main>{_paragraphs(1, 1, 1)}</div><div role="complementary"><p>{_text(2)}</p></div><div role="contentinfo"><p>{_text(1)}</p></div>',
]
PAGES = [f"<!DOCTYPE html><html><head><title>x</title></head><body>{b}</body></html>" for b in _BODIES]

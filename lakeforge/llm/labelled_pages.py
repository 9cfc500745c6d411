"""Labelled pages for the extraction model: layouts written by hand, filled with made-up prose.

``<x-label data-main="1">`` encloses what belongs to the main text, ``"0"`` what doesn't.  The parser takes the label
from it and makes no node of it, so the model sees the page as it would be without.
"""

from __future__ import annotations

import random

WORDS = "the of market river garden winter council report morning study village music engine harbour letter bridge doctor season story paper light people water history".split()

#: Openings and closings of a main container.
MAINS = [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"),
    ('<div id="content">', "</div>"), ('<div id="main-content">', "</div>"), ('<div class="post-body">', "</div>"), ('<div class="entry-content">', "</div>"),
    ('<section class="article-body">', "</section>"), ('<div class="story">', "</div>"), ('<article class="post"><div class="text">', "</div></article>"),
    ('<div role="main">', "</div>"), ("<table><tr><td>", "</td></tr></table>"), ('<div class="wrapper"><div class="main">', "</div></div>"),
    ('<div itemprop="articleBody">', "</div>"), ("<section>", "</section>"), ("<div><div>", "</div></div>"),
]

#: Layouts of what isn't main text; {p} is prose, {s} a short phrase, {l} a list of links, {i} link texts in a row.
BEFORE = [
    "<nav><ul>{l}</ul></nav>", '<div class="menu"><ul>{l}</ul></div>', '<ul class="nav navbar">{l}</ul>', '<div id="navigation">{i}</div>',
    "<header><h1>{s}</h1><p>{p}</p></header>", '<header class="site-header"><a href="/">{s}</a><nav>{i}</nav></header>', '<div class="header"><h2>{s}</h2><p>{p}</p></div>',
    '<div id="header"><div class="logo">{s}</div><span>{p}</span></div>', '<div class="ad">{p}</div>', '<div class="advert"><p>{p}</p></div>',
    '<div class="advertisement">{p}</div>', '<div id="ads"><a href="/x">{p}</a></div>', '<ins class="adsbygoogle">{s}</ins>', '<aside class="sponsored"><p>{p}</p></aside>',
    '<div class="promo banner"><b>{s}</b> {p}</div>', '<div class="cookie-notice"><p>{p}</p><button>{s}</button></div>', '<div class="notice">{p}</div>',
    '<div id="cookie-banner">{p} <a href="/c">{s}</a></div>', '<div class="consent" role="dialog"><p>{p}</p></div>', '<div role="alert">{p}</div>',
    '<div class="breadcrumb">{i}</div>', '<ol class="breadcrumbs">{l}</ol>', '<form action="/s"><label>{s}</label><input name="q"><button>{s}</button></form>',
    '<div class="search"><form><input><input type="submit" value="x"></form></div>', '<aside><h3>{s}</h3><p>{p}</p></aside>',
    '<div class="sidebar"><h3>{s}</h3><ul>{l}</ul></div>', '<div id="sidebar"><p>{p}</p></div>', '<noscript>{p}</noscript>', '<div class="topbar">{s} {i}</div>',
    '<div class="alert warning"><p>{p}</p></div>', '<div role="banner">{s}</div>', '<div role="navigation">{i}</div>', '<div class="popup modal"><p>{p}</p></div>',
]
AFTER = [
    "<footer>&copy; {s} &middot; {p}</footer>", '<footer class="site-footer"><p>{p}</p>{i}</footer>', '<div class="footer"><p>{p}</p></div>', '<div id="footer">&copy; {s}</div>',
    '<div class="copyright">{p}</div>', '<div role="contentinfo">{p}</div>', '<section class="comments"><h3>{s}</h3><p>{p}</p><p>{p}</p></section>',
    '<div id="comments"><div class="comment"><b>{s}</b><p>{p}</p></div><div class="comment"><p>{p}</p></div></div>', '<ol class="commentlist"><li><p>{p}</p></li><li><p>{p}</p></li></ol>',
    '<div class="reader-comments"><blockquote>{p}</blockquote><p>{p}</p></div>', '<div class="comment-section"><ul><li>{p}</li><li>{p}</li></ul></div>', '<div id="disqus_thread"><p>{p}</p></div>',
    '<div class="reply"><p>{p}</p></div>', '<div class="related"><h3>{s}</h3><ul>{l}</ul></div>', '<div class="related-posts"><p><a href="/r">{p}</a></p></div>', '<div class="share social">{i}</div>',
    '<aside class="sidebar"><p>{p}</p><ul>{l}</ul></aside>', '<aside><p>{p}</p></aside>', '<form class="newsletter"><p>{p}</p><input><button>{s}</button></form>', '<div class="subscribe"><p>{p}</p></div>',
    '<form><h3>{s}</h3><textarea>{p}</textarea><select><option>{s}</option><option>{s}</option></select></form>', '<div class="login"><form><label>{s}</label><input></form></div>',
    '<div class="widget"><h4>{s}</h4>{i}</div>', '<div class="pagination">{i}</div>', '<div class="tags">{i}</div>', '<div class="author-bio"><p>{p}</p></div>', '<div class="disclaimer legal">{p}</div>',
    '<div class="ad">{p}</div>', '<div class="sponsor"><p>{p}</p></div>', '<nav class="footer-nav">{i}</nav>', '<div class="notice legal"><p>{p}</p></div>',
]
#: Layouts inside the main container that aren't main text.
WITHIN = ['<div class="ad">{p}</div>', '<aside><p>{p}</p></aside>', '<div class="share">{i}</div>', '<div class="related">{i}</div>', '<div class="advert"><p>{p}</p></div>',
          '<form><input><button>{s}</button></form>', '<nav>{i}</nav>', '<div class="newsletter-signup"><p>{p}</p></div>', '<p class="ad">{p}</p>',
          '<section id="comments"><h2>{s}</h2><p>{p}</p></section>', '<footer><p>{p}</p></footer>', '<div class="notice">{p}</div>']
#: Blocks of main text.
BLOCKS = ["<p>{p}</p>", "<p>{p}</p>", "<p>{p} {p}</p>", "<p>{p} {p} {p}</p>", "<p>{s}</p>", "<p>{w}.</p>", "<p><b>{p}<br><p>{p}</p>", "<h2>{s}</h2>", "<p>{p} <a href='/a'>{s}</a> {p}</p>", "<ul><li>{p}</li><li>{s}</li></ul>",
          "<blockquote><p>{p}</p></blockquote>", "<p><em>{p}</em></p>", "<div>{p}</div>", "<pre>{p}</pre>", "<figure><figcaption>{p}</figcaption></figure>",
          "<table><tr><th>{s}</th><td>{s}</td></tr></table>", "<p><b>{s}</b> {p}<br>{p}</p>", "<ol><li>{p}</li></ol>", "<h3>{s}</h3>"]


def filled(layout: str, r: random.Random) -> str:
    def phrase(a: int, b: int) -> str:
        return " ".join(r.choice(WORDS) for _ in range(r.randint(a, b)))

    out = layout
    for mark, make in (("{p}", lambda: phrase(3, 30).capitalize() + r.choice([".", ".", ".", "!", "?", ""])), ("{s}", lambda: phrase(1, 4)), ("{w}", lambda: phrase(1, 1)),
                       ("{l}", lambda: "".join(f'<li><a href="/{phrase(1, 1)}">{phrase(1, 3)}</a></li>' for _ in range(r.randint(2, 8)))),
                       ("{i}", lambda: " ".join(f'<a href="/{phrase(1, 1)}">{phrase(1, 2)}</a>' for _ in range(r.randint(1, 6))))):
        while mark in out:
            out = out.replace(mark, make(), 1)
    return out


def page(seed: int) -> str:
    """A labelled page."""
    r = random.Random(seed)
    part = lambda layouts, n, main: "".join(f'<x-label data-main="{main}">{filled(r.choice(layouts), r)}</x-label>' for _ in range(n))
    begin, end = r.choice(MAINS)
    title = r.choice(["<h1>{s} {s}</h1>", "<h1>{p}</h1>", "<h1 class='title'>{s}</h1>", "", "<header><h1>{s}</h1></header>"])
    body = part([title], 1, 1) + part(BLOCKS, r.randint(1, 4), 1)
    for _ in range(r.randint(0, 3)):
        body += part(WITHIN, 1, 0) * (r.random() < 0.25) + part(BLOCKS, r.randint(1, 5), 1)
    wrap = r.choice([("", ""), ("", ""), ('<div class="container">', "</div>"), ('<div id="page"><div class="row">', "</div></div>")])
    return ("<!DOCTYPE html><html><head><title>x</title></head><body>" + wrap[0] + part(BEFORE, r.randint(1, 5), 0) + begin + body + end
            + part(AFTER, r.randint(1, 5), 0) + wrap[1] + "</body></html>")

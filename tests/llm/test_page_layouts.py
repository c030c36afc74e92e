"""Pages written by hand, apart from the generator of training pages: each article comes out whole and alone."""

import pytest

from skeinlake.llm import html_tree

A = "The river rose three metres in one night and cut the village off from the main road. Boats brought bread and medicine."
B = "Nobody had expected the dam to hold for as long as it did, said the engineer who built it forty years ago."
C = "By morning the water had gone back, and people began to carry wet furniture into the street."
D = "A committee will look into the warnings that were sent out too late."
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul></nav>'
FOOT = "<footer><p>&copy; 2021 The Daily Example. All rights reserved.</p></footer>"
LINKS = '<ul><li><a href="/1">Ten ways to sleep</a></li><li><a href="/2">Rain again</a></li><li><a href="/3">Markets fall</a></li></ul>'


def page(body: str, title: str = "Flood") -> str:
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title></head><body>{body}</body></html>'


#: name: page, its article's blocks.
LAYOUTS = {
    "header_in_article": (page(f"{NAV}<article><header><h1>Flood</h1></header><p>{A}</p><p>{B}</p></article>{FOOT}"), ["Flood", A, B]),
    "one_paragraph_main": (page(f"{NAV}<main><p>{A}</p></main>{FOOT}"), [A]),
    "main_and_aside": (page(f'{NAV}<main><p>{A}</p></main><aside class="note">Subscribe to our newsletter.</aside>{FOOT}'), [A]),
    "script_ending_in_slash": (page(f"{NAV}<article><h1>Flood</h1><script src=/a.js/>var x=1;</script><p>{A}</p><p>{B}</p></article>{FOOT}"), ["Flood", A, B]),
    "header_with_byline": (page(f'{NAV}<article><header><h1>Flood</h1><p class="byline">By Ann Smith</p></header><p>{A}</p><p>{B}</p><p>{C}</p></article>{FOOT}'), ["Flood", "By Ann Smith", A, B, C]),
    "figure_with_caption": (page(f'{NAV}<article><h1>Flood</h1><figure><img src="a.jpg"><figcaption>The bridge on Sunday</figcaption></figure><p>{A}</p><p>{B}</p></article>{FOOT}'), ["Flood", "The bridge on Sunday", A, B]),
    "site_header": (page(f'<header><h1>The Daily Example</h1>{NAV}</header><article><h2>Flood</h2><p>{A}</p><p>{B}</p></article>{FOOT}'), ["Flood", A, B]),
    "div_content": (page(f'<div id="header"><div class="logo">Example</div>{LINKS}</div><div id="content"><h1>Flood</h1><p>{A}</p><p>{B}</p><p>{C}</p></div><div id="footer">Contact us</div>'), ["Flood", A, B, C]),
    "wrapped_twice": (page(f'<div class="site"><div class="container">{NAV}<main><article><h1>Flood</h1><p>{A}</p><p>{B}</p></article></main></div>{FOOT}</div>'), ["Flood", A, B]),
    "sidebar_of_prose": (page(f'{NAV}<main><h1>Flood</h1><p>{A}</p><p>{B}</p><p>{C}</p></main><aside class="sidebar"><h3>About us</h3><p>We have written about this valley since 1951.</p>{LINKS}</aside>{FOOT}'), ["Flood", A, B, C]),
    "sidebar_before": (page(f'{NAV}<div class="sidebar"><h3>Popular</h3>{LINKS}</div><article><h1>Flood</h1><p>{A}</p><p>{B}</p></article>{FOOT}'), ["Flood", A, B]),
    "comments_section": (page(f'{NAV}<article><h1>Flood</h1><p>{A}</p><p>{B}</p></article><section id="comments"><h3>2 comments</h3><div class="comment"><p>I saw it from my window, it was frightening.</p></div><div class="comment"><p>Thanks for the report.</p></div></section>{FOOT}'), ["Flood", A, B]),
    "comments_in_article": (page(f'{NAV}<article><h1>Flood</h1><p>{A}</p><p>{B}</p><p>{C}</p><div class="comments"><ol><li><b>Tom</b> I saw it from my window.</li></ol></div></article>{FOOT}'), ["Flood", A, B, C]),
    "sections_with_headings": (page(f"{NAV}<article><h1>Flood</h1><section><h2>The night</h2><p>{A}</p></section><section><h2>The dam</h2><p>{B}</p><p>{C}</p></section></article>{FOOT}"), ["Flood", "The night", A, "The dam", B, C]),
    "list_in_article": (page(f"{NAV}<article><h1>Flood</h1><p>{A}</p><ul><li>Keep away from the river</li><li>Boil your water</li></ul><p>{B}</p></article>{FOOT}"), ["Flood", A, "Keep away from the river", "Boil your water", B]),
    "quotation": (page(f"{NAV}<article><h1>Flood</h1><p>{A}</p><blockquote><p>{B}</p></blockquote><p>{C}</p></article>{FOOT}"), ["Flood", A, B, C]),
    "table": (page(f"{NAV}<article><h1>Flood</h1><p>{A}</p><table><tr><th>Day</th><th>Level</th></tr><tr><td>Monday</td><td>3.1</td></tr></table><p>{B}</p></article>{FOOT}"), ["Flood", A, "Day", "Level", "Monday", "3.1", B]),
    "code": (page(f"{NAV}<article><h1>Levels</h1><p>{A}</p><pre><code>level = read()</code></pre><p>{B}</p></article>{FOOT}"), ["Levels", A, "level = read()", B]),
    "advert_between": (page(f'{NAV}<article><h1>Flood</h1><p>{A}</p><div class="ad">Buy boats now!</div><p>{B}</p><p>{C}</p></article>{FOOT}'), ["Flood", A, B, C]),
    "cookie_notice": (page(f'<div class="cookie-notice"><p>We use cookies to improve this site.</p><button>Accept</button></div>{NAV}<article><h1>Flood</h1><p>{A}</p><p>{B}</p></article>{FOOT}'), ["Flood", A, B]),
    "newsletter_form": (page(f'{NAV}<article><h1>Flood</h1><p>{A}</p><p>{B}</p><form class="newsletter"><label>Your email</label><input><button>Sign up</button></form><p>{C}</p></article>{FOOT}'), ["Flood", A, B, C]),
    "share_links": (page(f'{NAV}<article><h1>Flood</h1><div class="share"><ul><li><a href="#">Post</a></li><li><a href="#">Mail</a></li></ul></div><p>{A}</p><p>{B}</p></article>{FOOT}'), ["Flood", A, B]),
    "related_behind": (page(f'{NAV}<article><h1>Flood</h1><p>{A}</p><p>{B}</p></article><section class="related"><h2>Read on</h2>{LINKS}</section>{FOOT}'), ["Flood", A, B]),
    "text_in_divs": (page(f'{NAV}<div class="post-body"><h1>Flood</h1><div>{A}</div><div>{B}</div><div>{C}</div></div>{FOOT}'), ["Flood", A, B, C]),
    "unclosed_paragraphs": (page(f"{NAV}<article><h1>Flood</h1><p>{A}<p>{B}<p>{C}</article>{FOOT}"), ["Flood", A, B, C]),
    "links_in_prose": (page(f'{NAV}<article><h1>Flood</h1><p>The <a href="/river">river rose</a> three metres in <a href="/n">one night</a>, as it does each spring.</p><p>{B}</p></article>{FOOT}'), ["Flood", "The river rose three metres in one night, as it does each spring.", B]),
    "unquoted_links": (page(f"<nav><a href=/about/>About</a> <a href=/news/>News</a> <a href=/sport/>Sport</a></nav><article><h1>Flood</h1><p>{A}</p><p>{B}</p></article>{FOOT}"), ["Flood", A, B]),
    "subheads_and_time": (page(f'{NAV}<main><article><header><h1>Flood</h1><time>4 May</time></header><p>{A}</p><h2>The dam</h2><p>{B}</p><h2>The morning</h2><p>{C}</p><p>{D}</p></article></main>{FOOT}'), ["Flood", "4 May", A, "The dam", B, "The morning", C, D]),
    "footer_in_article": (page(f'{NAV}<article><h1>Flood</h1><p>{A}</p><p>{B}</p><footer><a href="/tag/rain">rain</a> <a href="/tag/dam">dam</a></footer></article>{FOOT}'), ["Flood", A, B]),
    "grid_columns": (page(f'{NAV}<div class="row"><div class="col-8"><h1>Flood</h1><p>{A}</p><p>{B}</p><p>{C}</p></div><div class="col-4"><h4>Latest</h4>{LINKS}</div></div>{FOOT}'), ["Flood", A, B, C]),
    "breadcrumbs": (page(f'{NAV}<div class="breadcrumb"><a href="/">Home</a> / <a href="/news">News</a></div><main><h1>Flood</h1><p>{A}</p><p>{B}</p></main>{FOOT}'), ["Flood", A, B]),
    "bare_body": (page(f"<h1>Flood</h1><p>{A}</p><p>{B}</p><p>{C}</p>"), ["Flood", A, B, C]),
    "many_paragraphs": (page(f"{NAV}<article><header><h1>Flood</h1></header>" + f"<p>{A}</p><p>{B}</p><p>{C}</p>" * 4 + f"</article>{FOOT}"), ["Flood", *[A, B, C] * 4]),
    "role_attributes": (page(f'<div role="navigation">{LINKS}</div><div role="main"><h1>Flood</h1><p>{A}</p><p>{B}</p></div><div role="contentinfo">Example Media</div>'), ["Flood", A, B]),
    "big_footer": (page(f'{NAV}<article><h1>Flood</h1><p>{A}</p><p>{B}</p></article><footer><h4>About</h4><p>The Daily Example has reported from the valley since 1951. Write to us at any time.</p>{LINKS}</footer>'), ["Flood", A, B]),
    "hgroup_and_lead": (page(f'{NAV}<main><hgroup><h1>Flood</h1><p>Water cuts off a village</p></hgroup><p class="lead">{A}</p><p>{B}</p></main>{FOOT}'), ["Flood", "Water cuts off a village", A, B]),
}
#: More of them, of the kinds that publishing tools make.
OTHERS = {
    "wordpressish":(page(f'<div id="page" class="hfeed site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">My Blog</a></p><p class="site-description">Just another site</p></header><div id="content" class="site-content"><main id="main"><article id="post-12" class="post-12 post type-post"><header class="entry-header"><h1 class="entry-title">Flood</h1><div class="entry-meta">May 4 by ann</div></header><div class="entry-content"><p>{A}</p><p>{B}</p></div><footer class="entry-footer">Posted in <a href="/c">News</a></footer></article><div id="comments" class="comments-area"><h2>One reply</h2><ol class="comment-list"><li class="comment"><p>Great post, thank you.</p></li></ol></div></main></div><aside id="secondary" class="widget-area">{LINKS}</aside><footer id="colophon">Powered by Words</footer></div>'),["Flood","May 4 by ann",A,B]),
    "docs":(page(f'<div class="topbar">Project docs</div><div class="layout"><div class="sidebar-nav">{LINKS}</div><div class="document"><h1>Install</h1><p>{A}</p><h2>Steps</h2><ol><li>Download the file.</li><li>Run it.</li></ol><pre>pip install x</pre><p>{B}</p></div></div><div class="footer">Built with Docs</div>'),["Install",A,"Steps","Download the file.","Run it.","pip install x",B]),
    "wiki":(page(f'<div id="mw-navigation">{LINKS}</div><div id="content" class="mw-body"><h1 id="firstHeading">Flood</h1><div id="bodyContent"><p>{A}</p><h2>History</h2><p>{B}</p><ul><li>1951: a dam is built.</li></ul><p>{C}</p></div></div><div id="footer"><ul><li>This page was last edited in May.</li></ul></div>'),["Flood",A,"History",B,"1951: a dam is built.",C]),
    "short":(page(f'{NAV}<article><h1>Flood</h1><p>It rained.</p></article>{FOOT}'),["Flood","It rained."]),
    "main_header":(page(f'<header><a href="/">Example</a></header><main><header><h1>Flood</h1></header><p>{A}</p></main><footer>Contact</footer>'),["Flood",A]),
    "br_text":(page(f'{NAV}<div class="story">{A}<br><br>{B}<br><br>{C}</div>{FOOT}'),[f"{A} {B} {C}"]),
    "nested_sections":(page(f'{NAV}<main><section class="intro"><h1>Flood</h1><p>{A}</p></section><section><h2>Dam</h2><p>{B}</p></section></main><section class="newsletter"><h2>Stay informed</h2><p>Get our letter each week.</p></section>{FOOT}'),["Flood",A,"Dam",B]),
    "dl":(page(f'{NAV}<article><h1>Terms</h1><dl><dt>Dam</dt><dd>{A}</dd><dt>Weir</dt><dd>{B}</dd></dl></article>{FOOT}'),["Terms","Dam",A,"Weir",B]),
    "aside_in_article":(page(f'{NAV}<article><h1>Flood</h1><p>{A}</p><aside><h3>Read more</h3>{LINKS}</aside><p>{B}</p><p>{C}</p></article>{FOOT}'),["Flood",A,B,C]),
    "paywall":(page(f'{NAV}<article><h1>Flood</h1><p>{A}</p><p>{B}</p><div class="paywall"><p>Subscribe to read all of our stories.</p><button>Subscribe</button></div></article>{FOOT}'),["Flood",A,B]),
    "no_nav":(page(f'<article><h1>Flood</h1><p>{A}</p></article>'),["Flood",A]),
    "only_main_text":(page(f'{NAV}<main>{A} {B}</main>{FOOT}'),[f"{A} {B}"]),
    "h1_outside":(page(f'{NAV}<h1>Flood</h1><article><p>{A}</p><p>{B}</p></article>{FOOT}'),["Flood",A,B]),
    "many_links_list":(page(f'{NAV}<article><h1>Flood</h1><p>{A}</p><p>{B}</p><p>{C}</p><h2>Sources</h2><ul><li><a href="/x">The dam report of 1951</a></li><li><a href="/y">Rain tables</a></li></ul></article>{FOOT}'),["Flood",A,B,C,"Sources","The dam report of 1951","Rain tables"]),
    "author_box":(page(f'{NAV}<article><h1>Flood</h1><p>{A}</p><p>{B}</p></article><div class="author-box"><h4>Ann Smith</h4><p>Ann has written about rivers for ten years.</p></div>{FOOT}'),["Flood",A,B]),
    "alert":(page(f'<div class="alert" role="alert">Site maintenance on Sunday.</div>{NAV}<main><h1>Flood</h1><p>{A}</p><p>{B}</p></main>{FOOT}'),["Flood",A,B]),
    "tables_layout":(page(f'<table><tr><td>{LINKS}</td><td><h1>Flood</h1><p>{A}</p><p>{B}</p><p>{C}</p></td></tr></table>'),["Flood",A,B,C]),
    "login_form":(page(f'{NAV}<form action="/login"><p>Log in to comment.</p><input><button>Go</button></form><article><h2>Flood</h2><p>{A}</p><p>{B}</p></article>{FOOT}'),["Flood",A,B]),
    "pager":(page(f'{NAV}<article><h1>Flood</h1><p>{A}</p><p>{B}</p></article><div class="pagination"><a href="/p">Previous</a> <a href="/n">Next</a></div>{FOOT}'),["Flood",A,B]),
    "long_comments":(page(f'{NAV}<article><h1>Flood</h1><p>{A}</p></article><div class="comments"><div class="comment"><p>{B}</p><p>{C}</p></div><div class="comment"><p>{D}</p><p>{C}</p></div></div>{FOOT}'),["Flood",A]),
}
#: Those that the model must get right; of the others at least so many that 95 in a hundred come out whole.
NAMED = ("header_in_article", "one_paragraph_main", "main_and_aside", "script_ending_in_slash")


#: Wrappings, bodies and surroundings that all go together.
WRAPPINGS = {"article": "article", "main": "main", "section": "section", "div": "div", "div content": 'div class="content"', "div story": 'div class="story"'}
EIGHT = [A, B, C, D, B, A, D, C]
BODIES = {
    "one p": (f"<p>{A}</p>", [A]), "three p": (f"<p>{A}</p><p>{B}</p><p>{C}</p>", [A, B, C]), "eight divs": ("".join(f"<div>{t}</div>" for t in EIGHT), EIGHT), "headed divs": (f"<h1>Flood</h1><div>{A}</div><div>{B}</div>", ["Flood", A, B]),
}
AROUND = {
    "bare": "{}", "menus": f"{NAV}{{}}{FOOT}", "sidebar": f'<div class="wrapper">{NAV}<div class="row">{{}}<aside class="sidebar"><h3>Popular</h3>{LINKS}</aside></div>{FOOT}</div>',
}


def grid():
    for w, tag in WRAPPINGS.items():
        for b, (body, want) in BODIES.items():
            for a, around in AROUND.items():
                yield f"{w}, {b}, {a}", page(around.format(f"<{tag}>{body}</{tag.split()[0]}>")), want


def test_no_ordinary_article_comes_out_empty():
    """Every wrapping with every body in every surrounding: none empty or with anything else, and but for a heading in one of 72 whole."""
    got = [(name, html_tree.contents(html_tree.trained(), [html])[0], want) for name, html, want in grid()]
    wrong = [(name, out) for name, out, want in got if out != want]
    assert len(got) == 72 and len(wrong) <= 1, wrong
    assert all([t for t in want if t != "Flood"] == [t for t in out if t != "Flood"] for _, out, want in got), wrong


#: What stands within an article, and what doesn't belong to it.
WITHIN = {
    "reading_list": (page(f'{NAV}<article><h1>Flood</h1><p>{A}</p><p>{B}</p><h2>Reading list</h2><ul><li><a href="/b">Rivers of the north</a></li><li><a href="/c">The dam and the town</a></li></ul></article>{FOOT}'), ["Flood", A, B, "Reading list", "Rivers of the north", "The dam and the town"]),
    "user_comments": (page(f'{NAV}<article><h1>Flood</h1><p>{A}</p><p>{B}</p><section id="user-comments"><ul><li>I saw it from my window.</li><li>Thanks for the report.</li></ul></section></article>{FOOT}'), ["Flood", A, B]),
    "site_name": (page(f"<header><h1>The Daily Example</h1></header><main><p>{A}</p></main>{FOOT}"), [A]),
}


@pytest.mark.parametrize("name", WITHIN)
def test_within_articles(name):
    html, want = WITHIN[name]
    assert html_tree.contents(html_tree.trained(), [html])[0] == want


def extracted(name: str) -> list[str]:
    return html_tree.contents(html_tree.trained(), [LAYOUTS[name][0]])[0]


@pytest.mark.parametrize("name", NAMED)
def test_named_layouts(name):
    assert extracted(name) == LAYOUTS[name][1]


def test_layouts_come_out_whole():
    wrong = [n for n in LAYOUTS if extracted(n) != LAYOUTS[n][1]]
    assert len(wrong) <= 0.05 * len(LAYOUTS), wrong


def test_other_layouts_come_out_whole():
    wrong = [n for n, (p, want) in OTHERS.items() if html_tree.contents(html_tree.trained(), [p])[0] != want]
    assert len(wrong) <= 0.1 * len(OTHERS), wrong


@pytest.mark.parametrize("tag", ["script", "style", "script type=module", "style media=x/"])
def test_scripts_and_styles_never_close_themselves(tag):
    """A slash at a tag's end means nothing to these elements; their text runs up to their end tag, or to the page's end."""
    name = tag.split()[0]
    for slash in ("/", " /", ""):
        runs = [t for _, t in html_tree.parse(f"<p>one</p><{tag}{slash}>p > 1; '</p>'</{name} x><p>two</p>").runs]
        assert runs == ["one", "two"]
        assert [t for _, t in html_tree.parse(f"<p>one</p><{tag}{slash}>var x").runs] == ["one"]


def test_other_raw_elements_without_an_end_hide_nothing():
    assert [t for _, t in html_tree.parse("<p>one</p><iframe src=x /><p>two</p><svg/><p>three</p>").runs] == ["one", "two", "three"]


def test_deep_and_long_pages():
    """Time in proportion to the page; nothing is lost."""
    deep = "<div>" * 50_000 + f"<p>{A}</p>"
    assert [t for _, t in html_tree.parse(deep).runs] == [A]
    assert len(html_tree.forest_of([html_tree.parse(deep)]).levels) <= html_tree.DEEPEST + 2
    long = page(f"{NAV}<article><h1>Flood</h1>" + f"<p>{A}</p><p>{B}</p>" * 25_000 + f"</article>{FOOT}")
    assert len(long) > 5_000_000
    assert html_tree.contents(html_tree.trained(), [long])[0] == ["Flood", *[A, B] * 25_000]
    assert [t for _, t in html_tree.parse("<iframe>" * 100_000 + "text").runs] == ["text"]

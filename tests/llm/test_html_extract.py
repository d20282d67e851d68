import itertools
import math

from trendloom.llm.html_extract import KINDS, extract_text, label, labelled_pages, main_text, marginals, parse, trained


def test_marginals_equal_enumeration():
    parent, kinds = [-1, 0, 0, 1, 1, 4], [0, 1, 0, 2, 0, 0]
    unary = [0.3, -1.0, 0.5, 2.0, -0.4, 0.1]
    bond = [[0.2, -0.5, 0.1, 0.9], [1.0, 0.0, -1.0, 0.3], [0.0, 0.7, 0.2, -0.2]][:KINDS]
    p, joint, log_z = marginals(parent, unary, bond, kinds)
    weights = {}
    for y in itertools.product((0, 1), repeat=6):
        s = sum(u * v for u, v in zip(unary, y)) + sum(bond[kinds[i]][2 * y[parent[i]] + y[i]] for i in range(1, 6))
        weights[y] = math.exp(s)
    z = sum(weights.values())
    assert abs(math.log(z) - log_z) < 1e-9
    for i in range(6):
        assert abs(sum(w for y, w in weights.items() if y[i]) / z - p[i]) < 1e-9
    assert abs(sum(w for y, w in weights.items() if y[1] and y[4]) / z - joint[4][3]) < 1e-9


def test_held_out_pages():
    model, right, all_ = trained(), 0, 0
    for source, content in labelled_pages(150, seed=77):
        page = parse(source)
        want = label(page, content)
        got = [x > 0.5 for x in model.scores(page)]
        for node, _ in page.runs:
            right += got[node] == want[node]
            all_ += 1
    assert right > 0.97 * all_


def test_rows(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><!-- ad --><div class="ad">Buy   now.</div>
    <article><h1>The &amp; title</h1><p><b>First   line of the text.<br><p>Second, with a <a href="x">link</a> &lt;here&gt;.</p></article>
    <footer>&copy; site &middot; all rights.</footer></body></html>"""
    want = "The & title\n\nFirst line of the text.\n\nSecond, with a link <here>."
    assert main_text(page, trained()) == want
    long = "<article>" + "<p>" + "Some words of text here. " * 3000 + "</p></article>"
    rows = [(1, "u", page, "x"), (1, "u", page, None), (2, None, None, None), (3, "v", "", None), (4, "w", "<p", None), (5, "y", "<script>never closed", None), (6, "z", long, None), (7, "q", "<nav><a href=x>menu</a></nav>", None)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [x.text for x in got if x.page_id == 1] == [want] * 2 and len(got) == 8
    by = {x.page_id: x for x in got}
    assert [by[i].text for i in (2, 3, 4, 5, 7)] == [""] * 5
    assert by[6].text == " ".join(("Some words of text here. " * 3000).split()) and all(x.n_chars == len(x.text) for x in got)
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_forms_around_pages_and_within():
    lines = ["The river rose by two metres overnight, and the old bridge was closed to all traffic.", "Nobody was hurt, the mayor said on Tuesday. Work on the new bridge starts next spring.", "Residents can use the ferry, which runs every twenty minutes from six in the morning."]
    body = "".join(f"<p>{x}</p>" for x in lines)
    pages = [
        f'<form id="aspnetForm"><article>{body}</article></form>',
        f'<html><body><form method=post action="/"><nav><ul><li><a href=#>Home</a></li></ul></nav><div class="content">{body}</div><footer>Copyright us.</footer></form></body></html>',
        f'<html><body><div class="content">{body}</div><form><p>Sign up for our letter and get the news first.</p><label>Mail</label><input name=m><button>Go</button></form></body></html>',
        f"<html><body><main>{body}</main><dialog open><p>We use cookies to make this site better. Read more in our policy.</p><button>OK</button></dialog></body></html>",
        f'<html><body><main>{body}<form class="comment-form"><fieldset><legend>Reply</legend><p>Leave a comment below, your address is not shown.</p><textarea></textarea></fieldset></form></main></body></html>',
    ]
    for page in pages:
        assert main_text(page, trained()) == "\n\n".join(lines), page


def test_pages_of_other_designs():
    """A blog, a page laid out as a table, nested divisions, a manual: built by hand, unlike the pages trained on."""
    A = "The council voted on Monday to restore the old market hall, after years of debate about its future."
    B = "Work will start in June and is expected to take two years. Traders will move to a temporary site near the station, where rents stay the same."
    C = "“We are relieved,” said one of the traders, who has sold fish here since 1984."
    blog = f"""<!doctype html><html lang=en><head><title>Hall</title><meta charset=utf-8><style>.x{{}}</style></head><body class="post-template-default single">
<div id="page" class="site"><a class="skip-link" href="#content">Skip to content</a>
<header id="masthead" class="site-header"><div class="site-branding"><p class="site-title"><a href="/">The Daily Sheet</a></p><p class="site-description">News from the valley</p></div><nav id="site-navigation" class="main-navigation"><ul><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul></nav></header>
<div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-1" class="post type-post"><header class="entry-header"><h1 class="entry-title">Market hall to be restored</h1><div class="entry-meta">Posted on <a href="#">3 May</a> by <a href="#">K. Lind</a></div></header>
<div class="entry-content"><p>{A}</p><p>{B}</p><blockquote><p>{C}</p></blockquote></div><footer class="entry-footer">Filed under <a href="#">Town</a></footer></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts</h2><ol class="comment-list"><li class="comment"><div class="comment-body"><p>Great news for all of us in the old town. I hope they keep the clock.</p></div></li></ol></div></main></div>
<aside id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="#">Rain again</a></li></ul></section></aside></div>
<footer id="colophon" class="site-footer"><div class="site-info">Proudly powered. All rights reserved.</div></footer></div></body></html>"""
    table = f"""<html><body bgcolor=white><table width=100%><tr><td colspan=2><a href="/">Home</a> | <a href="/a">About</a> | <a href="/c">Contact</a></td></tr><tr><td width=150><a href=1>Politics</a><br><a href=2>Weather</a><br><a href=3>Sport</a></td><td><h1>Market hall to be restored</h1><p>{A}<p>{B}<p>{C}</td></tr><tr><td colspan=2><small>Copyright 2003 The Daily Sheet</small></td></tr></table></body></html>"""
    divs = f"""<html><body><div class="top"><div class="logo"><a href="/">Sheet</a></div><div class="menu"><a href=1>One</a> <a href=2>Two</a></div></div><div class="cookie-banner"><p>We use cookies to improve your visit. By going on you agree.</p><button>OK</button></div><div class="col"><div class="txt"><h1>Market hall to be restored</h1><div>{A}</div><div>{B}</div><div>{C}</div></div><div class="share-bar">Share: <a href=1>Mail</a></div><div class="related"><h3>More stories</h3><ul><li><a href=3>Bus lines change in the spring timetable</a></li><li><a href=4>New head of the library named</a></li></ul></div></div><div class="bottom">Imprint · Privacy · Terms of use</div></body></html>"""
    docs = f"""<html><body><div class="sidebar"><ul><li><a href=1>Install</a></li><li><a href=2>Use</a></li></ul></div><div role="main" class="document"><div class="section" id="s1"><h1>Using the tool</h1><p>{B}</p><h2>Options</h2><ul><li>The first option sets the depth of the search.</li><li>The second option names the output.</li></ul><pre>tool --depth 3 out.txt</pre><p>{A}</p></div></div><footer><hr><p>© Copyright 2020, the authors.</p></footer></body></html>"""
    T = "Market hall to be restored"
    manual = ["Using the tool", B, "Options", "The first option sets the depth of the search.", "The second option names the output.", "tool --depth 3 out.txt", A]
    for page, want in ((blog, [T, A, B, C]), (table, [T, A, B, C]), (divs, [T, A, B, C]), (docs, manual)):
        assert main_text(page, trained()) == "\n\n".join(want)


def test_text_of_articles_that_controls_and_tables_hold():
    model = trained()
    prose = "<p>It was a long day in the valley, and nobody had seen the rain come down so hard.</p>"
    page = lambda x: main_text(f"<html><body><article><h1>On the rain</h1>{prose}{x}{prose}</article></body></html>", model).split("\n\n")
    assert "So we get x = 2 in the end, as was to be shown." in page("<p>So we get <math><mi>x</mi> <mo>=</mo> <mn>2</mn></math> in the end, as was to be shown.</p>")
    assert "Press the Start key, then hold Reset for a while." in page("<p>Press the <button>Start</button> key, then hold <label>Reset</label> for a while.</p>")
    assert "Sign up" not in page("<div><button>Sign up</button></div>") and "Name Send" not in page("<form><label>Name</label> <button>Send</button></form>")
    got = page("<table><caption>Rain by year</caption><tr><th>Year</th><th>Tons</th></tr><tr><td>1999</td><td>12</td></tr></table>")
    assert ("Year" in got) == ("1999" in got) and ("Tons" in got) == ("12" in got) and "1999" in got
    # whatever is around them, labels of elements are those of the exact marginals
    assert page("<p>One<button>two</button></p>")[2] == "Onetwo"

import html
import random

from llm_helpers import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from forumlens.llm.html_text import extract_html, main_text

JUNK = [
    "<nav><ul><li><a href=/a>Home, sweet</a></li></ul></nav>", '<div class="ad">Buy now, cheap, fast, and in bulk from all of us.</div>', "<script>var a = '<p>no</p>';</script>", "<style>p{}</style>",
    '<aside><p>Related, reading, for everyone who liked this text.</p></aside>', '<form><p>Sign up, please, with your address and name.</p></form>', '<div id="comments"><p>A reader, so wise, says a lot of words here.</p></div>',
    '<div class="cookie-notice"><p>We use cookies, many, all of them, for everything.</p></div>', "<!-- note, <p>hidden</p> -->", '<p style="display: none">Hidden, text, for nobody at all to read.</p>', "<footer>(c) all, rights, reserved</footer>",
]


def page(paragraphs, seed, container="article"):
    r = random.Random(seed)
    body = "".join(r.choice(["<p>", "<P class=x>\n"]) + html.escape(p).replace(" ", r.choice([" ", "\n  ", " <b></b>"]), 3) + r.choice(["</p>", ""]) for p in paragraphs)
    junk = JUNK[:]
    r.shuffle(junk)
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{''.join(junk[:6])}<{container}>{body}</{container.split()[0]}>{''.join(junk[6:])}</body></html>"


def test_finds_the_article_whatever_surrounds_it():
    for seed in range(60):
        want = [prose(seed * 10 + k, 12 + seed % 30) + ", " + prose(k, 20) for k in range(1 + seed % 5)]
        for container in ("article", "div", 'div class="post"', "section", "main"):
            assert main_text(page(want, seed, container)) == "\n".join(want), (seed, container)


def test_blocks_references_and_spaces():
    text = main_text("<body><article><h1>A &amp; B</h1><p>one&nbsp;two<br>three &#233;&eacute;</p><ul><li>x<li>y</ul><pre>a\n b</pre><table><tr><td>1<td>2</table></article></body>")
    assert text == "A & B\none two three éé\nx\ny\na b\n1\n2"


def test_siblings_and_links():
    body = '<div class="wrap"><h2>Title of it</h2><div class="content"><p>' + prose(1, 60) + "</p><p>" + prose(2, 60) + '</p></div><p>' + prose(3, 40) + '</p><div><a href=x>' + prose(4, 50) + "</a></div></div>"
    assert main_text(f"<body>{body}</body>") == "\n".join(["Title of it", prose(1, 60), prose(2, 60), prose(3, 40)])


def test_header_inside_the_article_counts():
    assert main_text("<body><header><h1>Site</h1></header><article><header><h1>Head</h1></header><p>" + prose(1, 30) + "</p></article></body>") == "Head\n" + prose(1, 30)


def test_parts_of_one_article():
    parts = [prose(k, 30 if k else 120) + ", end" for k in range(3)]
    assert main_text("<body><article><div class=a><p>" + parts[0] + "</p></div><div class=b><p>" + parts[1] + "</p></div><section><p>" + parts[2] + "</p></section></article></body>") == "\n".join(parts)
    assert main_text("<body><div><div class=part><p>" + parts[0] + "</p></div><div class=part><p>" + parts[1] + "</p></div></div></body>") == "\n".join(parts[:2])


def test_names_of_boilerplate():
    text, other = prose(1, 80), "Words, many words, of other matters, which the reader does not want, at all."
    for junk in ('<div class="article-comments">', '<section class="main-sidebar">', '<div id="cookieBanner">', '<article class="comment">', '<div class="content-ad">', '<ins class="adsbygoogle">', '<div role="alert">', '<ol class="commentlist">', "<div hidden>"):
        tag = junk[1:].split()[0].rstrip(">")
        assert main_text(f"<body><div class=story><p>{text}</p></div>{junk}<p>{other}</p></{tag}></body>") == text, junk
        assert main_text(f"<body><article><p>{text}</p>{junk}<p>{other}</p></{tag}></article></body>") == text, junk
    assert main_text(f'<body><article><div class="article-header"><h1>Head</h1></div><p>{text}</p></article></body>') == "Head\n" + text


def test_page_inside_a_form():
    assert main_text("<body><form action=/><div><p>" + prose(1, 50) + "</p></div></form></body>") == prose(1, 50)


def test_edges():
    for t in (None, "", "  ", "<p></p>", "<script>x</script>", "<!-- x"):
        assert main_text(t) == ""
    assert main_text("just text") == "just text"
    assert main_text("a < b, c > d") == "a < b, c > d"
    assert main_text("<div>" * 20_000 + "deep") == "deep"
    long = prose(1, 50_000)
    assert main_text(f"<article><p>{long}</p></article>") == long


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/=\"' abp&;!-ntdivul", max_size=80))
def test_never_fails(text):
    assert isinstance(main_text(text), str)


def test_operator(spark):
    rows = [(1, "u", page([prose(1, 40)], 1)), (2, None, None), (None, "v", ""), (1, "u", page([prose(1, 40)], 1))]
    out = extract_html(spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted((r.text, r.n_chars) for r in out) == sorted([(prose(1, 40), len(prose(1, 40)))] * 2 + [("", 0)] * 2)
    assert extract_html(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_names_on_what_holds_the_content():
    text, other = prose(1, 80) + "\n" + prose(2, 60), "Words, many words, of other matters, which the reader does not want, at all."
    body = "".join(f"<p>{p}</p>" for p in text.split("\n"))
    for tag in ('div class="content has-sidebar"', 'div class="content no-sidebar"', 'div class="hasSidebar"', 'div class="content sidebar"', 'div id="sidebar-layout"', 'div class="page-header-fixed"', 'article class="post has-comments"', 'article class="post comments-open"'):
        end = tag.split()[0]
        assert main_text(f"<body><{tag}>{body}<div class=sidebar><p>{other}</p></div><div id=comments><p>{other}</p></div></{end}></body>") == text, tag
        assert main_text(f'<body><div class="sidebar"><p>{other}</p></div><{tag}>{body}</{end}><div class="comments"><p>{other * 20}</p></div></body>') == text, tag
    assert main_text(f'<body><div class="ads-layout"><main>{body}</main></div></body>') == text


def test_articles_and_headings_beside_an_article():
    a, b = prose(1, 80), prose(2, 60)
    linked = f"<article><p><a href=x>{prose(3, 40)}</a></p></article>"
    remark = f'<article class="comment"><p>{prose(4, 40)}</p></article>'
    assert main_text(f"<body><article><p>{a}</p></article><article><p>{b}</p></article>{linked}{remark}</body>") == f"{a}\n{b}"
    assert main_text(f"<body><main><h1>Head</h1><article><p>{a}</p></article></main></body>") == f"Head\n{a}"
    assert main_text(f"<body><main><h1>Head</h1><article><p>{a}</p></article><article><p>{b}</p></article></main></body>") == f"Head\n{a}\n{b}"


def test_nothing_inside_the_article_is_dropped():
    text = prose(1, 60)
    for more, want in (
        ("<ul><li><a href=a>Source one</a></li><li><a href=b>Source two</a></li></ul>", "Source one\nSource two"),
        ("<ul>" + "<li><a href=a>Short</a></li>" * 5 + "</ul>", "\n".join(["Short"] * 5)),
        ("<table><tr><td><a href=a>Cell</a></td><td>two</td></tr></table>", "Cell\ntwo"),
        ("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding=x>no</annotation></math> here.</p>", "Energy is E=m here."),
        ('<div class="related-work"><p>Others did so.</p></div>', "Others did so."),
        ('<section class="share-of-voice"><h2>Share</h2><p>Of voice.</p></section>', "Share\nOf voice."),
    ):
        assert main_text(f"<body><article><p>{text}</p>{more}</article></body>") == f"{text}\n{want}", more
    for junk in ('class="related-posts"', 'class="share-buttons"', 'class="ad-container"', 'class="newsletter-signup"', 'class="social"', 'id="comments"'):
        assert main_text(f"<body><article><p>{text}</p><div {junk}><p>Words of it.</p></div></article></body>") == text, junk


def test_short_siblings_beside_a_container():
    text = "".join(f"<p>{prose(k, 60)}</p>" for k in (1, 2))
    menu = "<ul>" + "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(6)) + "</ul>"
    more = "<p>See <a href=x>the source</a> for it.</p><section><h2>End</h2><p>Short end.</p></section>"
    assert main_text(f"<body><div>{menu}<div class=content>{text}</div>{more}</div></body>") == "\n".join([prose(1, 60), prose(2, 60), "See the source for it.", "End", "Short end."])


def blocks(r, depth=0):
    """Random article markup and the lines that it must give."""
    words = lambda n: prose(r.randrange(10**6), n)
    kind = r.choice(["p", "p", "p", "list", "table", "quote", "heading", "linked", "pre"] + ["section"] * (depth < 3))
    if kind == "section":
        inner = [blocks(r, depth + 1) for _ in range(r.randrange(1, 4))]
        tag = r.choice(["div", "section", "div class=body-part", "figure"])
        return f"<{tag}>{''.join(m for m, _ in inner)}</{tag.split()[0]}>", [x for _, lines in inner for x in lines]
    lines = [words(r.randrange(3, 40)) for _ in range(1 if kind not in ("list", "table") else r.randrange(1, 5))]
    inner = [r.choice([html.escape(x), html.escape(x).replace(" ", "\n  ", 2), f"<b>{html.escape(x)}</b>"]) for x in lines]
    if kind == "list":
        tag = r.choice(["ul", "ol"])
        return f"<{tag}>" + "".join(f"<li>{r.choice([x, f'<a href=/q>{x}</a>'])}{r.choice(['</li>', ''])}" for x in inner) + f"</{tag}>", lines
    if kind == "table":
        return "<table><tbody>" + "".join(f"<tr><td>{x}</td></tr>" for x in inner) + "</tbody></table>", lines
    tag = {"p": "p", "quote": "blockquote", "heading": r.choice(["h2", "h3", "h5"]), "linked": "p", "pre": "pre"}[kind]
    if kind == "linked":
        inner[0] = f'See <a href="/x">{inner[0]}</a>.'
        lines[0] = f"See {lines[0]}."
    return f"<{tag}>{inner[0]}</{tag}>", lines


def test_generated_pages_come_out_whole():
    """Two thousand random layouts whose text is known from how they were made."""
    for seed in range(2000):
        r = random.Random(seed)
        first = prose(seed, 40)
        parts = [blocks(r) for _ in range(r.randrange(1, 7))]
        junk = JUNK[:]
        r.shuffle(junk)
        inner = f"<p>{first}</p>" + "".join(m + r.choice(["", "", "", '<div class="ad">Buy, now, all of it.</div>', "<!-- x -->", "<script>f('<p>')</script>"]) for m, _ in parts)
        container = r.choice(["article", 'article class="post has-sidebar"', "main><article"])
        end = "</article></main>" if container.startswith("main") else "</article>"
        got = main_text(f"<html><body>{''.join(junk[:5])}<{container}>{inner}{end}{''.join(junk[5:])}</body></html>")
        assert got == "\n".join([first, *(x for _, lines in parts for x in lines)]), seed


def paragraph(seed, n=50):
    return prose(seed, n), f"<p>{prose(seed, n)}</p>"


def test_rows_of_a_grid_and_wrapped_articles():
    (a, pa), (b, pb) = paragraph(1), paragraph(2)
    for outer in ("{}", "<main>{}</main>", "<div class=page>{}</div>"):
        for row in ("<div class=row><div class=col>{}</div></div>", "<div class=cell><article>{}</article></div>", "<section><div><div>{}</div></div></section>"):
            assert main_text("<body>" + outer.format(row.format(pa) + row.format(pb)) + "</body>") == f"{a}\n{b}", (outer, row)


def test_a_thread_beside_or_inside_the_article_goes():
    a, b = prose(1, 60)[:320], prose(2, 60)[:320]
    for times in (1, 3):
        for name in ("user-post", "user-remark", "reader-comment", "guest message", "post user", "x"):
            page = f"<body><article>{f'<p>{a}</p>' * times}</article><div class=thread><div class='{name}'><p>{b}</p></div></div></body>"
            assert main_text(page) == "\n".join([a] * times), name
    for name in ("reader-comments", "discussion", "user-comments", "reader-opinions"):
        assert main_text(f"<body><article><p>{a}</p><div class='{name}'><p>{b}</p></div></article></body>") == a, name
    assert main_text(f"<body><div class=thread><div class=user-post><p>{a}</p></div></div></body>") == a, "a page of nothing else"
    science = f'<section id=discussion class=discussion><h2>Discussion</h2><p>{b}</p></section>'
    assert main_text(f"<body><article><p>{a}</p>{science}</article></body>") == f"{a}\nDiscussion\n{b}"


def test_lists_of_links_under_a_heading_or_text():
    a, pa = paragraph(1)
    links = "<ul>" + "".join(f"<li><a href={x}>{x}</a>" for x in ("One", "Two", "Three")) + "</ul>"
    for tag in ("main", "div class=content", "article"):
        for before, want in (("<h2>Sources</h2>", "Sources\n"), ("<p>See</p>", "See\n"), ("Look at", "Look at\n")):
            assert main_text(f"<body><{tag}>{pa}{before}{links}</{tag.split()[0]}></body>") == f"{a}\n{want}One\nTwo\nThree", (tag, before)
    assert main_text(f"<body><main><div>{links}</div>{pa}</main></body>") == a


def test_labels_and_the_title_outside_the_wrapper():
    a, pa = paragraph(1)
    assert main_text(f"<body><article><p>An <label>odd label</label> here.</p>{pa}</article></body>") == f"An odd label here.\n{a}"
    assert main_text(f"<body><article>{pa}<label>Name <input></label><label for=x>Mail</label></article></body>") == a
    for inner, want in (("", f"Head\n{a}"), ("<h1>Own</h1>", f"Own\n{a}")):
        assert main_text(f"<body><h1>Head</h1><div class=outer><div class=content>{inner}{pa}{pa}</div></div></body>") == f"{want}\n{a}"
        assert main_text(f"<body><h1>Head</h1><div><div class=outer><article>{inner}{pa}</article></div></div></body>") == want


def test_generated_wrappers_and_threads():
    """Two thousand pages whose article lies in random wrappers or rows, with threads of readers beside it."""
    for seed in range(2000):
        r = random.Random(seed)
        lines = [prose(seed * 7 + k, r.randrange(30, 60)) for k in range(r.randrange(1, 6))]
        paragraphs = [f"<p>{x}</p>" for x in lines]
        kind = r.choice(["grid", "articles", "one", "one"])
        if kind == "grid":
            row = r.choice(["<div class=row><div class=col>{}</div></div>", "<div class=r>{}</div>", "<section><div>{}</div></section>"])
            body = "".join(map(row.format, paragraphs))
        elif kind == "articles":
            body = "".join(map(r.choice(["<div class=item><article>{}</article></div>", "<article>{}</article>"]).format, paragraphs))
        else:
            body = f"<article>{''.join(paragraphs)}</article>"
        for _ in range(r.randrange(0, 4)):
            body = r.choice(["<div>{}</div>", "<main>{}</main>", "<div class=wrap-1>{}</div>", "<section>{}</section>"]).format(body)
        thread = "".join(f'<div class="{r.choice(["user-post", "reader-remark", "comment", "guest-message"])}"><p>{prose(r.randrange(10**6), r.randrange(5, 60))}</p></div>' for _ in range(r.randrange(0, 4)))
        thread = r.choice(['<div class="thread">{}</div>', '<div class="reader-comments">{}</div>', "<div id=comments>{}</div>", "<div class=discussion>{}</div>"]).format(thread)
        junk = r.sample(JUNK, 6)
        assert main_text(f"<body>{''.join(junk[:3])}{body}{thread}{''.join(junk[3:])}</body>") == "\n".join(lines), seed


def test_stray_tags_take_linear_time():
    import time

    for make in (lambda n: "<div>" * n + "</b>" * n, lambda n: "<b>" * n + "<hr>" * n, lambda n: "<b><table>" + "<div>" * n + "</b>" * n, lambda n: "<header>" * n + "x", lambda n: "<table><tr><td>" * n + "</i>" * n, lambda n: "<main><p>x, y</p>" + "<ul><li><a>a</a><li><a>b</a><li><a>c</a></ul>" * (n // 8), lambda n: "<div>" * n + "<p>" + "some words, " * 9):
        began = time.process_time()
        main_text(make(30_000))
        assert time.process_time() - began < 3, make(2)

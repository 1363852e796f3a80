"""HTML extraction: pages whose text is known by construction, broken and very long ones."""

import random
import time

import pytest

from freshet.llm.html_text import Page, _Tags, extract_pages, main_text

BODY = "A sentence of prose that goes on for a while. " * 8
TEXT = BODY.strip()


def test_a_form_around_the_page_keeps_its_content():
    page = f'<body><form id="aspnetForm"><input name="v"><div class="c"><p>{BODY}</p><p>{BODY}</p><button>Go</button></div></form></body>'
    assert main_text(page) == f"{TEXT}\n\n{TEXT}"
    assert main_text(f"<body><form><article><p>short</p></article></form></body>") == "short"
    # A form of its own goes with its text.
    assert main_text(f'<body><div class="c"><p>{BODY}</p><form><p>Your name</p><label>Mail</label></form></div></body>') == TEXT


@pytest.mark.parametrize("name", ["news-alert", "social-history", "menu-recipes", "side-by-side", "search-engine-review"])
def test_a_name_that_says_more_than_boilerplate_keeps_its_text(name):
    assert main_text(f'<body><div class="{name}"><p>{BODY}</p></div><div class="x"><p>abcd</p></div></body>') in (TEXT, f"{TEXT}\n\nabcd")
    links = "".join(f'<a href="/{i}">A link of some length here</a> ' for i in range(9))
    assert main_text(f'<body><div class="{name}">{links} and</div><div class="x"><p>{BODY}</p></div></body>') == TEXT


@pytest.mark.parametrize("name", ["reader-comments", "user-comment", "comment-body", "search-results", "related-articles", "commentList", "comments", "side-bar"])
def test_comments_and_lists_inside_an_article_go(name):
    for tag in ("div", "section", "ol"):
        assert main_text(f'<body><article><p>{BODY}</p><{tag} class="{name}"><p>{BODY}</p></{tag}></article></body>') == TEXT
    assert main_text(f'<body><main><p>{BODY}</p><article class="comment-body"><p>Nice words.</p></article></main></body>') == TEXT
    assert main_text(f'<body><article><p>{BODY}</p><p class="commentary">So</p></article></body>') == f"{TEXT}\n\nSo"


def made(rng):
    """A page and its text."""
    word = lambda: rng.choice(["alpha", "beta", "gamma", "dé&eacute;", "x&lt;y", "it's"])
    words = lambda n: " ".join(word() for _ in range(n))
    plain = lambda t: t.replace("&eacute;", "é").replace("&lt;", "<")
    noise = [lambda: f"<nav><ul><li><a href='/'>{words(2)}</a></ul></nav>", lambda: f"<script>if (a < b) {{ x = '<p>{words(3)}</p>' }}</script>", lambda: "<style>p > b { color: red }</style>", lambda: f'<div class="ad-box">{words(9)}</div>', lambda: f'<aside><p>{words(30)}</aside>', lambda: f"<!-- <p>{words(5)}</p> -->", lambda: f'<p hidden>{words(4)}</p>', lambda: f'<form><input value="a>b"><label>{words(3)}</label></form>', lambda: f'<div class="user-comments"><p>{words(20)}</p><p>{words(20)}</p></div>']
    blocks, html = [], []
    for _ in range(rng.randrange(2, 9)):
        kind = rng.choice(["p", "h2", "li", "blockquote", "noise"])
        if kind == "noise":
            html.append(rng.choice(noise)())
            continue
        a, b, c = words(rng.randrange(3, 40)), words(2), words(3)
        blocks.append(plain(f"{a} {b} {c}"))
        inner = f"{a}\n  <b title='>'>{b}</b><br>{c}"
        html.append({"li": f"<ul><li>{inner}</ul>", "blockquote": f"<blockquote>{inner}</blockquote>"}.get(kind, f"<{kind}>{inner}</{kind}>"))
    around = lambda: "".join(rng.choice(noise)() for _ in range(rng.randrange(3)))
    lead = words(60)
    return f"<!doctype html><html><head><title>{words(3)}</title></head><body>{around()}<div><article><p>{lead}</p>{''.join(html)}</article></div>{around()}<footer>{words(5)}</footer></body></html>", "\n\n".join([plain(lead), *blocks])


def test_pages_with_known_text(spark):
    rng = random.Random(8)
    pages = [made(rng) for _ in range(200)]
    rows = [(i, f"http://h{i % 7}.example/{i}", html, "x", 1) for i, (html, _) in enumerate(pages)] + [(3, None, pages[3][0], "x", 1), (None, "http://h1.example/", pages[4][0], "x", 1), (900, "http://h2.example", None, None, None), (901, None, "", None, None)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, host string, shard int")).collect()
    text_of = {html: text for html, text in pages} | {None: "", "": ""}
    want = sorted(((i, url, text_of[html], len(text_of[html])) for i, url, html, *_ in rows), key=repr)
    assert sorted(map(tuple, got), key=repr) == want


def test_the_end_of_a_tag_by_trial():
    rng = random.Random(9)
    for _ in range(3000):
        source = "".join(rng.choice("ab\"'> <") for _ in range(rng.randrange(1, 24)))
        tags = _Tags(source)
        for at in range(len(source)):
            place, quote, want = at, None, -1
            while place < len(source):
                c = source[place]
                if quote:
                    quote = None if c == quote else quote
                elif c == ">":
                    want = place
                    break
                elif c in "\"'":
                    quote = c
                place += 1
            assert tags.end(at) == (want if want >= 0 else source.find(">", at))


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a '>\"", '<a ">', "</a ", "<!-- ", "<p>", "<div>", "<li><b>", "<form>", '<a class="', '<div class="news-alert">', "<b><div><i></b>"])
def test_a_megabyte_of_broken_markup(piece):
    began = time.perf_counter()
    main_text(piece * (1_000_000 // len(piece)))
    main_text(piece * (1_000_000 // len(piece)) + "'")
    assert time.perf_counter() - began < 20


def test_a_very_long_page():
    page = "<body><article>" + "".join(f"<p>Paragraph {i} says so.</p>" for i in range(60_000)) + "</article></body>"
    text = main_text(page)
    assert text.count("\n\n") == 59_999 and text.endswith("Paragraph 59999 says so.")
    assert len(Page("<b>" * 1000 + "x").tag) == 1001

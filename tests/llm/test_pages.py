from specval.llm.html import extract, main_text


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


ARTICLE = "<h1>Title &amp; more</h1><p>First, <b>bold</b>\n  text&nbsp;here, and so on.<br>Next line</p><p>Ok.<p>Third <a href='x'>link</a>, yes.</p>"
TEXT = "Title & more\nFirst, bold text here, and so on. Next line\nOk.\nThird link, yes."


def test_article_alone():
    assert main_text(page(f"<nav><ul><li><a href=/>a</a></ul></nav><div class='ad'>Buy, buy, buy!</div><article>{ARTICLE}</article><footer>f, g, h</footer>")) == TEXT


def test_boilerplate_inside_and_around():
    extra = "<aside><p>side, side, side</p></aside><form><p>name, mail</p><input></form><div id=comments><p>Nice, good, fine, great, wow!</p></div>"
    assert main_text(page(f"<header><p>Site, head</p></header><div class='cookie-notice'>We use cookies, ok?</div><article>{ARTICLE}{extra}</article>")) == TEXT
    assert main_text(page(f"<div class='sidebar'><p>a, b, c, d, e, f, g</p></div><div class='content'>{ARTICLE}</div><div class='footer'>x, y</div>")) == TEXT
    assert main_text(page(f"<ul class='menu'><li><a href=a>Home, page</a></li></ul><main>{ARTICLE}</main>")) == TEXT


def test_container_and_siblings():
    text = "A paragraph, long enough, with commas, to win. " * 4
    body = f"<div><h1>Head</h1><div><p>{text}</p><p>{text}</p></div><div><p>{text}</p></div></div><div><a href=a>link one</a> <a href=b>two</a></div>"
    assert main_text(page(body)) == "\n".join(["Head", *[text.strip()] * 3])


def test_broken_markup():
    assert main_text(None) == main_text("") == main_text("<div></div>") == ""
    assert main_text("<p>one<p>two < 3 & four &lt;b&gt; <!-- no") == "one\ntwo < 3 & four <b>"
    assert main_text("<article><p>a <script>x</article>") == "a"
    assert main_text("<article><p>a</b></p></div><p>b</article>") == "a\nb"
    assert main_text("plain text") == "plain text"
    assert main_text("<article>" + "<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000) == "deep"
    assert len(main_text("<article>" + "<p>word, word</p>" * 20_000)) == 20_000 * 11 - 1


def test_lists_and_tables_keep_their_order():
    body = "<article><p>Intro, text.</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><blockquote>said, so</blockquote></article>"
    assert main_text(page(body)) == "Intro, text.\none\ntwo\na\nb\nsaid, so"


def test_extract_rows(spark):
    rows = [(1, "u", page(f"<article>{ARTICLE}</article>"), "x"), (2, None, None, None), (None, "v", "", "y"), (1, "u", page(f"<article>{ARTICLE}</article>"), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract(df).collect()
    assert sorted((r["page_id"] or 0, r["__text"]) for r in out) == sorted([(1, TEXT), (2, ""), (0, ""), (1, TEXT)]) and "text" in out[0].asDict()
    assert extract(df.limit(0)).count() == 0


def test_pages_table_matches_its_articles(spark, folder):
    import html
    import re

    pages = spark.read.parquet(f"{folder}/pages.parquet").selectExpr("page_id", "html", "html AS copy")
    out = extract(pages, carry=["page_id", "copy"])
    for r in out.collect():
        inner = r["copy"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?p>|</?h1>", inner)]
        assert r["__text"] == "\n".join(b for b in blocks if b)


LONG = "<p>A paragraph of the article, with commas, words, and more words, so that it counts.</p>"
REMARK = "<p>GONE remark of a reader, which is long too, has commas, and goes on, and on, and on.</p>"


def test_unclosed_unseen_elements_take_nothing_with_them():
    for tag in ("select", "canvas", "svg", "object", "iframe", "noscript", "template", "math"):
        got = main_text(f"<article><h1>T</h1><{tag}><option>GONE<option>GONE{LONG * 3}</article>")
        assert got.split("\n")[0] == "T" and got.count("A paragraph") == 3 and "GONE" not in got
        assert "GONE" not in main_text(f"<article>{LONG}<{tag}><p>GONE</p></{tag}>{LONG}</article>")
    for tag in ("script", "style", "title", "textarea"):
        assert main_text(f"<article>{LONG}<{tag}>{LONG}</article>").count("A paragraph") == 1


def test_any_depth():
    for depth in (70, 2000):
        got = main_text("<article><h1>T</h1><p>Intro, it is.</p>" + "<div>" * depth + LONG * 3 + "</div>" * depth + "<p>End, it is.</p></article>").split("\n")
        assert (got[0], got[1], got[-1], len(got)) == ("T", "Intro, it is.", "End, it is.", 6)
    menu = "<ul>" + "<li><div>" * 12 + "<a href=x>GONE, menu</a>" + "</div></li>" * 12 + "</ul>"
    assert "GONE" not in main_text(f"<div>{LONG * 3}{menu}</div>")


def test_reader_comments_and_asides_go():
    for name in ("comment-body", "sidebar-content", "ad-text", "story-comments", "reader-replies"):
        assert "GONE" not in main_text(f"<article>{LONG * 2}<div class='{name}'>{REMARK}</div></article>")
        assert "GONE" not in main_text(f"<body><article>{LONG * 4}</article><section id='{name}'>{REMARK}</section></body>")
    for heading in ("Comments", "3 comments", "Comments (12)", "Leave a reply", "Kommentare"):
        assert "GONE" not in main_text(f"<body><div>{LONG * 4}</div><h3>{heading}</h3><div>{REMARK}</div>{REMARK}</body>")
        got = main_text(f"<article>{LONG * 4}<h3>{heading}</h3>{REMARK}<div>{REMARK}</div><h3>Method</h3><p>More, of it.</p></article>")
        assert "GONE" not in got and got.endswith("Method\nMore, of it.")


def test_names_that_speak_of_something_else_stay():
    for name in ("no-sidebar", "has-comments", "overflow-hidden", "entry-header", "post-header"):
        assert main_text(f"<article><div class='{name}'><h1>T</h1></div>{LONG * 3}</article>").startswith("T\nA paragraph")


def test_built_pages_give_back_their_article():
    """Brute force: pages put together from parts whose place is known."""
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() + rng.choice(["", "", "", ","]) for _ in range(n)) + "."
    for _ in range(150):
        blocks, html = [], ""
        for k in range(rng.randint(4, 9)):
            kind = rng.choice(["p", "p", "p", "h2", "li"])
            line = text(rng.randint(25, 60)) if kind != "h2" else word()
            blocks.append(line)
            dressed = line.replace(" ", rng.choice([" ", "\n  ", " <b>", "&#32;"]), 1)
            html += f"<ul><li>{dressed}</li></ul>" if kind == "li" else f"<{kind}>{dressed}" + rng.choice([f"</{kind}>", f"</{kind}>\n"])
        wrap = rng.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<article>" + "<div>" * 80 + "{}" + "</div>" * 80 + "</article>"])
        around = rng.sample([f"<nav><a href=/>{word()}</a></nav>", f"<div class='cookie-banner'><p>{text(30)}</p></div>", f"<script>{text(20)}</script>",
                             f"<form><select><option>{word()}</select><p>{text(25)}</p></form>", f"<div id='comments'><p>{text(40)}</p></div>",
                             f"<aside class='x'><p>{text(40)}</p></aside>"], 4)
        page_ = f"<html><head><title>{word()}</title></head><body>{around[0]}{around[1]}{wrap.format(html)}{around[2]}<footer>{text(9)}</footer>{around[3]}</body></html>"
        assert main_text(page_) == "\n".join(blocks)

"""Wrappers and main text of small pages."""

import random

import pytest

from ledgerlife.llm import wrappers as W

SCHEMA = "page_id bigint, url string, html string, text string, _host int, _rules int"


def page(body, head="<title>t</title><style>p{}</style><script>var a='</p><p>no';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        ("plain  text\n only &amp; more", "plain text only & more"),
        (page("<nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Head</h1><p>One <b>two</b><br>three<p>four &lt;&#233;&gt;</article><footer>&copy; me</footer>"), "Head\nOne two\nthree\nfour <é>"),
        (page('<div class="cookie-notice">We use</div><main><div class="sidebar">side</div><p>Body</p><form><p>Mail</p><input></form><section id="comments"><p>nice</p></section></main>'), "Body"),
        (page('<header>Site</header><div class="post-content"><p>A</p><ul><li>x<li>y</ul><aside>z</aside></div><div class="related">r</div>'), "A\nx\ny"),
        (page("<header>Site</header><p>A</p><!-- no <p>comment</p> --><p hidden>h</p><p style='display: none'>n</p><div class='ad'>buy</div><p>B"), "A\nB"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<article><p>a < b and c</p><p title='x > y'>d</p></article>", "a < b and c\nd"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"),
        ("<ARTICLE><P>Upper</P></ARTICLE><SCRIPT>x</SCRIPT>", "Upper"),
        ("<article><header><h1>Head</h1></header><p>x</p><footer>by me</footer></article>", "Head\nx"),
        ("<article><p>a b &nbsp; c</p></article>", "a b c"),
        ("<script>never closed <p>x</p>", ""),
    ],
)
def test_main_text(html, text):
    assert W.main_text(html) == text


def shop(i, extra="", items=3):
    links = "".join(f'<li><a href="/{i}/{k}">link {i} {k}</a></li>' for k in range(items))
    return page(f"<div class='top'><p>Welcome to the shop</p></div><ul>{links}</ul>{extra}<div><h2>Item {i}</h2><p>Text number {i}.</p></div><p>All rights reserved by us</p>")


def test_wrapper_has_groups_optionals_and_slots():
    node = W.folded(W.parse(shop(0)))
    for i in range(1, 8):
        node = W.merged(node, W.folded(W.parse(shop(i, "<h3>Sale</h3>" if i % 2 else "", i))))
    told = W.expression(node)
    assert '"Welcome to the shop"' in told and "(<li> <a> # </a> </li>)+" in told and '(<h3> "Sale" </h3>)?' in told and "<h2> # </h2>" in told
    again = W.expression(W.unpacked(W.packed(node)))
    assert again == told
    learned = W.rules(node)
    assert any(p.endswith("/ul") for p in learned["lists"])
    assert W.main_text(shop(9), learned) == "Item 9\nText number 9."


def test_repeated_pairs_become_one_group():
    node = W.folded(W.parse("<dl><dt>a<dd>1<dt>b<dd>2<dt>c<dd>3</dl>"))
    assert W.expression(node).strip() == "<dl> (<dt> # </dt> <dd> # </dd>)+ </dl>"


def test_extraction_on_spark(spark):
    rows = [(i, f"https://shop.example.com/{i}", shop(i, items=i % 4 + 1)) for i in range(20)]
    rows += [(100, "http://one.example.org/", page("<article><p>Alone</p></article>")), (101, None, page("<p>No address</p>")), (102, "not an address", None), (103, "https://shop.example.com/x", ""), (3, rows[3][1], rows[3][2])]
    rows += [(104, "http://big.example.org/", "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"), (105, "http://deep.example.org/", "<div>" * 300 + "deep" + "</div>" * 300)]
    df = spark.createDataFrame([(*r, "old", 1, 2) for r in rows], SCHEMA).repartition(4)
    found = W.extract(df).collect()
    assert len(found) == len(rows) and set(found[0].asDict()) == {"page_id", "url", "html", "text", "_host", "_rules"}
    text = {r["page_id"]: r["text"] for r in found}
    assert text[7] == "Item 7\nText number 7." and text[100] == "Alone" and text[101] == "No address" and text[102] == text[103] == ""
    assert text[104].count("\n") == 19_999 and text[105] == "deep"
    assert W.infer(df).count() == 5
    assert W.extract(df.limit(0)).count() == 0


ARTICLE = "<article><h1>Head</h1><p>Body</p></article>"


@pytest.mark.parametrize(
    "body, text",
    [
        (f"<form action=x><input><label>Mail</label>{ARTICLE}</form>", "Head\nBody"),
        (f"<div class='content-sidebar-wrap'>{ARTICLE}<div class=sidebar>side</div></div>", "Head\nBody"),
        ("<div class='with-sidebar'><div class='content'><p>Body</p></div><div id='sidebar'><p>side</p></div></div>", "Body"),
        ("<div class='post-with-comments'><div class='entry-content'><p>Body</p></div><div class='comments'><div class='content'>nice</div></div></div>", "Body"),
        ("<article><div class='post-with-comments'><div class='entry-content'><p>Body</p></div><form><p>Mail</p></form></div></article>", "Body"),
        (f"<div class='widget'>{ARTICLE}</div>", "Head\nBody"),
        (f"<p>Site</p><div id='overlay'>{ARTICLE}</div>", "Head\nBody"),
        (f"<main><p>Main</p></main><div class='related'>{ARTICLE}</div>", "Main"),
        ("<form><p>One</p><p>Two</p><button>Send</button></form>", "One\nTwo"),
        ("<p>Text</p><form><p>Mail</p></form>", "Text"),
        (f"<div hidden>{ARTICLE}</div><nav>{ARTICLE}</nav>", ""),
    ],
)
def test_chrome_that_holds_the_main_part_is_gone_into(body, text):
    assert W.main_text(page(body)) == text


def test_alignment_is_exact_at_every_width():
    rnd = random.Random(5)
    for n, m in [(0, 3), (1, 1), (5, 9), (30, 40), (220, 230)]:
        p, q = [rnd.choice("abcd") for _ in range(n)], [rnd.choice("abcde") for _ in range(m)]
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                best[i + 1][j + 1] = best[i][j] + 1 if p[i] == q[j] else max(best[i][j + 1], best[i + 1][j])
        pairs = W._common(p, q)
        assert len(pairs) == best[n][m] and all(p[i] == q[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
    wide = [f"s{i}" for i in range(2_000)]
    assert len(W._common(["last", *wide], [*wide, "last"])) == 2_000


@pytest.mark.parametrize("tag", ["div", "font"])
def test_depth_is_not_limited(tag):
    html = page(f"<{tag}>" * 100_000 + "deep<p>text")
    assert W.main_text(html).split() == ["deep", "text"] or W.main_text(html) == "deeptext"
    node = W.merged(W.folded(W.parse(html)), W.folded(W.parse(html)))
    again = W.unpacked(W.packed(node))
    assert again.pages == 2 and len(W.packed(again)) == len(W.packed(node)) > 100_000
    assert W.expression(again).count("<") > 100_000 and W.rules(again) == {}


def test_no_row_holds_a_host(spark):
    """Ids and classes that differ by page: rules and rows stay as small as a page, and template lines are found under common paths."""

    def slugged(i):
        return page(f"<p>Welcome to the shop</p><div id=slug-q{chr(97 + i % 26)}{chr(97 + i // 26)}z><h2>Item {i}</h2><p>Text {i} and <b>more {i}</b> and so on {i}.</p></div><p class=by>by <a>us {i}</a> alone</p><p>All rights reserved</p>")

    n = 200
    df = spark.createDataFrame([(i, "http://slugs.example.org/", slugged(i)) for i in range(n)], "page_id bigint, url string, html string").repartition(4)
    found = {r["page_id"]: r["text"] for r in W.extract(df).collect()}
    assert found == {i: f"Item {i}\nText {i} and more {i} and so on {i}.\nus {i}" for i in range(n)}
    facts = W.counted(df.select(df.url.alias("host"), W.F.xxhash64("html").alias("page"), "html"))
    rules = W.learned(facts, df.groupBy(df.url.alias("host")).agg(W.F.count("*").alias("of")))
    assert rules.count() == 4  # two lines, two places of the by-line
    assert "Text" not in W.infer(df).first()["wrapper"]


def test_common_words_within_paragraphs_stay(spark):
    rows = [(i, "http://a.example.org/", page(f"<p>Word {i} <b>x{i}</b> and <i>y{i}</i></p><p>the <b>{i}</b> or <i>z{i}</i> end {i}</p>")) for i in range(12)]
    found = W.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).filter("page_id = 7").first()
    assert found["text"] == "Word 7 x7 and y7\nthe 7 or z7 end 7"

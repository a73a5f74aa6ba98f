"""Main texts of the given pages and of hand-made ones."""

import html
import re
import time

import pytest

from gradeloom.llm import html_extract as he


def article(page):
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())


def test_given_pages(tables):
    want = {r.page_id: article(r.html) for r in tables.pages.collect()}
    got = he.extract(tables.pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


LEARNED = {"w:p": 1.0, "w:h1": 1.0, "t:p": -0.05, "t:article": -40.0, "t:body": -40.0, "t:html": -40.0, "w:dropped": -0.05, "t:dropped": -0.05}


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        ("a < b &lt;p&gt; &eacute;&#233;&nbsp;x", "a < b <p> éé x"),
        ("<html><head><title>t t t</title></head><body><header>Site name</header><article><h1>A &amp; B</h1><p>wo<b>r</b>d<br>two</p></article><footer>f f f f</footer></body></html>", "A & B word two"),
        ("<body><div class='cookie-notice'>We use cookies</div><article><p>one<aside>no</aside><p>two<form>n <input> n</form><script>if(a<b){}</script><!-- x > y --><p>three</article><div id=comments><p>great</div>", "one two three"),
        ("<article><ul><li>one<li>two <a href='a>b'>li nk</a></ul></article><article class='comment'><p>mine</article>", "one two li nk"),
        ("<article><p>one</p><div class=\"sidebar box\"><p>s s s s s</p></div><p>two</p></article>", "one two"),
        ("<article><p>unclosed <b>bold <p>next", "unclosed bold next"),
    ],
)
def test_hand_made_pages(page, text):
    assert he.main_text(page, LEARNED) == text


@pytest.mark.parametrize("name", ["content with-sidebar", "has-sidebar", "no-sidebar", "search-results", "has-related", "notice", "share", "ad"])
@pytest.mark.parametrize("inner", ["article", "main"])
def test_wrappers_of_the_text_stay(name, inner):
    page = f"<body><div class='{name}'><div class='{name}'><{inner}><p>one</p><div class='ad'>buy</div><p>two</p></{inner}></div><div class='ad'>buy</div></div></body>"
    assert he.main_text(page, LEARNED) == "one two"


def test_the_stretch_is_the_best_one():
    import random

    rnd = random.Random(1)
    for _ in range(300):
        page = "".join(rnd.choice(["<p>a b</p>", "<div>", "</div>", "x ", "<table><tr><td>y", "</table>", "<h1>t</h1>"]) for _ in range(12))
        learned = {"w:p": 1.0, "w:none": -0.5, "w:td": 0.3, "t:div": -2.0, "t:table": -1.5, "w:div": 0.2}
        found = he.tokens(page)
        score = [n * learned.get(k, he.NEW_WORD if k[0] == "w" else -he.TAG_COST) for k, n, *_ in found]
        best = max([0.0] + [sum(score[i:j]) for i in range(len(found)) for j in range(i + 1, len(found) + 1)])
        texts = {"" if not best else None} | {
            " ".join("".join(t or " " * (t is None) for _, _, t, _ in found[i:j]).split())
            for i in range(len(found)) for j in range(i + 1, len(found) + 1) if abs(sum(score[i:j]) - best) < 1e-9
        }
        assert he.main_text(page, learned) in texts


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", ""), (2, "u", "<p>" + "w " * 50_000), (2, "u", "<p>a"), (2, "u", "<p>a")], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.url, r.n_chars) for r in he.extract(df.selectExpr("*", "1 AS text", "2 AS n_chars")).collect()), key=str)
    assert got == sorted([(1, None, 0), (None, "u", 0), (2, "u", 99_999), (2, "u", 1), (2, "u", 1)], key=str)
    assert he.extract(df.limit(0)).count() == 0


def test_quotes_that_close_and_quotes_that_do_not():
    assert he.main_text("<p><a title='x > y' rel=\"a>b\">one</a> two", LEARNED) == "one two"
    assert he.main_text("<p>one <a title=\"x>two</a> <b class='y>z'>three</b>", LEARNED) == "one two z'>three"
    assert he.main_text("<p>one <a", LEARNED) == "one <a"


@pytest.mark.parametrize(
    "page, length",
    [
        ("<p>one <a " + '"' * 10_001 + " two", 10_012),
        ("<p>one <a " + '"' * 10_001 + "> two", 7),
        ('<a b="> x ' * 20_001, 40_001 - 20_000),
        ("<script " * 10_000, 79_999),
        ("<script>" * 10_000, 0),
        ("<script>" + "</script " * 100_000, 0),
        ("<!--" * 100_000, 0),
        ("<" * 100_000, 100_000),
        ("<p>x" + "<div>" * 8_000 + "</p>" * 8_000, 1),
        ("<p>x" + "<b>" * 8_000 + "<hr>" * 8_000, 1),
        ("<b>x " * 20_000, 39_999),
        ("<div class='ad'>" * 8_000 + "<article>x</article>", 1),
        ("<p>&#" + "9" * 100_000 + ";&#" + "0" * 100_000 + "65;&#" + "0" * 100_000 + ";", 3),
        ("<p " + 'class="a ' * 50_000 + "> x", 1),
    ],
    ids=range(14),
)
def test_hostile_pages_take_linear_time(page, length):
    began = time.process_time()
    text = he.main_text(page, {})
    assert time.process_time() - began < 5
    assert len(text) == length


def grown(rnd, depth, block, inside, dropped, out, counted):
    """A well-formed piece of a page, and what its tokens count as."""

    def count(kind, n):
        counted.setdefault("t:dropped" if dropped and kind[0] == "t" else "w:dropped" if dropped else kind, [0, 0])[0 if inside else 1] += n

    for _ in range(rnd.randint(1, 4)):
        if depth == 0 or rnd.random() < 0.5:
            n = rnd.randint(1, 4)
            out.append(" " + "w " * n + ("<!-- <p> no -->" if rnd.random() < 0.2 else "<script>x < y</script>" if rnd.random() < 0.2 else ""))
            count(f"w:{block}", n)
            continue
        name = rnd.choice(["div", "ul", "table", "b", "a", "blockquote", "nav", "x-y"])
        known = "other" if name == "x-y" else name
        out.append(f'<{name} title="> <p>">')
        gone = dropped or name == "nav"
        if gone:
            counted.setdefault("t:dropped", [0, 0])[0 if inside else 1] += 1
        else:
            count(f"t:{known}", 1)
        grown(rnd, depth - 1, block if name == "b" else known, inside, gone, out, counted)
        out.append(f"</{name}>")
        counted.setdefault("t:dropped" if gone else f"t:{known}", [0, 0])[0 if inside else 1] += 1


def test_counts_of_well_formed_pages():
    import random

    rnd = random.Random(7)
    for _ in range(300):
        out, want = ["<body>"], {"t:body": [0, 2]}
        grown(rnd, 2, "body", False, False, out, want)
        out.append("<article>")
        want.setdefault("t:article", [0, 2])
        grown(rnd, 3, "article", True, False, out, want)
        out.append("</article>")
        grown(rnd, 2, "body", False, False, out, want)
        assert he.counts("".join(out) + "</body>") == want
    assert he.counts("<body><p>no article</body>") == {}


def test_weights_are_log_ratios_within_bounds():
    import math

    totals = {"w:p": (90, 10), "w:div": (10, 90), "t:p": (30, 10), "t:footer": (0, 50), "t:div": (5, 40)}
    got = he.weights(totals)
    ratio = lambda kind, letter: math.log((totals[kind][0] + 0.5) / (sum(v[0] for k, v in totals.items() if k[0] == letter) + 1)) - math.log(
        (totals[kind][1] + 0.5) / (sum(v[1] for k, v in totals.items() if k[0] == letter) + 1)
    )
    assert got["w:p"] == min(1.0, ratio("w:p", "w")) and got["w:div"] == max(-1.0, ratio("w:div", "w"))
    assert got["t:p"] == -he.TAG_COST and ratio("t:p", "t") > 0
    assert got["t:div"] == max(-he.TAG_BOUND, he.TAG_SCALE * ratio("t:div", "t")) < -he.TAG_COST
    assert got["t:footer"] == max(-he.TAG_BOUND, he.TAG_SCALE * ratio("t:footer", "t"))

import random

import pytest

from tillsight.llm.html_extract import best_region, item_weights, class_counts, main_text, main_text_report

SCHEMA = "page_id long, url string, html string"
WORDS = "alpha beta gamma délta épsilon zeta eta theta iota kappa".split()


def page(rnd, article=True, extra=True):
    """(html, the blocks of its main text)."""
    def words(n):
        return " ".join(rnd.choice(WORDS) for _ in range(n))

    blocks, body = [words(4)], []
    body.append(f"<h1>{blocks[0]}</h1>")
    for _ in range(rnd.randint(2, 6)):
        a, b = words(rnd.randint(3, 20)), words(rnd.randint(3, 20))
        body.append(f"<p>{a} &amp; <b>{b}</b>\n &eacute;&#x41;.<br>" + rnd.choice(["</p>", ""]))
        blocks.append(f"{a} & {b} éA.")
        if extra and rnd.random() < 0.3:
            body.append(rnd.choice([
                '<div class="ad">Buy now cheap things</div>', "<form><label>Name</label><input name=q><button>Send it</button></form>",
                "<script>var p = '<p>no</p>';</script>", '<aside>more to read here</aside>', "<!-- <p>no</p> -->",
                '<div id="newsletter-box"><p>Subscribe to our letter today</p></div>']))
    comments = "".join(f"<div class='comment'><p>{words(12)}</p></div>" for _ in range(3)) if extra else ""
    tag = "article" if article else "div"
    html = (f"<html><head><title>{words(5)}</title><style>p {{}}</style></head><body><header><a href='/'>Home page</a></header>"
            f"<nav><ul>{''.join(f'<li><a href=x>{w}</a></li>' for w in WORDS)}</ul></nav>"
            f'<div class="cookie-notice">We use cookies on this site ok</div><{tag}>{"".join(body)}</{tag}>'
            f'<section id="comments"><h2>Comments</h2>{comments}</section><footer>&copy; all rights {words(6)}</footer></body></html>')
    return html, "\n\n".join(blocks)


def test_labelled_and_unlabelled_pages(spark):
    rnd = random.Random(6)
    made = [page(rnd, article=i % 4 > 0) for i in range(60)]
    df = spark.createDataFrame([(i, f"http://x/{i}", h) for i, (h, _) in enumerate(made)], SCHEMA).repartition(3)
    got = {r.page_id: r for r in main_text_report(df).collect()}
    for i, (_, want) in enumerate(made):
        assert got[i].text == want
        assert got[i].n_chars == len(want)


def test_region_has_the_largest_sum():
    rnd = random.Random(1)
    for _ in range(300):
        scores = [rnd.choice([-3, -1, -0.5, 0, 1, 2]) for _ in range(rnd.randint(0, 12))]
        best = max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)], default=0)
        first, end, total = best_region(scores)
        assert total == pytest.approx(max(best, 0)) and sum(scores[first:end]) == pytest.approx(total)


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<article></article>", ""), ("<nav><a>Home</a></nav>", ""),
    ("<article><p>one&nbsp;two\t three", "one two three"), ("<ARTICLE><P>A &lt;b&gt; c<P>d</ARTICLE>", "A <b> c\n\nd"),
    ("<article><p>3 < 4 and a<b>c</b></p></article>", "3 < 4 and ac"),
    ('<article><p title="a > b">x y</p><div hidden>no</div></article>', "x y"),
    ("<main><article><header><h1>T</h1></header><p>x</p></article><footer>f</footer></main>", "T\n\nx"),
    ("<article><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table></article>", "a b\n\nc"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep")])
def test_odd_markup(html, text):
    weights = item_weights(class_counts([page(random.Random(i))[0] for i in range(20)]))
    assert main_text(html, weights) == text


def test_awkward_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "u", ""), (2, "u", "<article><p>" + "w " * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = main_text_report(df.withColumn("text", df.html).withColumn("n_chars", df.url)).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 0, 399_999]
    assert main_text_report(df.where("false")).collect() == []


@pytest.mark.parametrize("html, text", [
    ('<article><p>one <svg class="i"/> two</p><p>three</p></article>', "one two\n\nthree"),
    ('<article><p>one <svg class="i" /> two <svg><path d="M0"/>no</svg> three</p></article>', "one two three"),
    ("<article><template-card><p>one</p></template-card><svg-icon></svg-icon><p>two</p></article>", "one\n\ntwo"),
    ("<article><p>one</p><template><p>no</p></template><iframe src=x>no</iframe><svg\n><text>no</text></svg><p>two</p></article>", "one\n\ntwo")])
def test_raw_elements_end_where_they_do(html, text):
    weights = item_weights(class_counts([page(random.Random(i))[0] for i in range(20)]))
    assert main_text(html, weights) == text


STORY = "<p>" + " ".join(WORDS) + "</p><p>" + " ".join(WORDS[:7]) + "</p>"
STORY_TEXT = " ".join(WORDS) + "\n\n" + " ".join(WORDS[:7])
ASIDE = '<div class="sidebar"><p>more to read here</p></div><div id="comments"><article class="comment"><p>nice one</p></article></div>'


@pytest.mark.parametrize("wrap", [
    '<div class="container has-sidebar">{}</div>', '<div class="no-sidebar">{}</div>', '<div class="layout-with-nav">{}</div>',
    '<form id="aspnetForm">{}</form>', '<div class="page-header-fixed"><div id="site-overlay">{}</div></div>', '<div class="widget">{}</div>'])
@pytest.mark.parametrize("inner", [
    "<article>{}</article>", "<main>{}</main>", '<article><div class="post social-share-enabled">{}</div></article>',
    '<div class="post social-share-buttons">{}</div>', "<article class='post ad-free'>{}</article>",
    '<article><div class="post social-share-buttons">{}</div><div id="comments"><p>first words of a comment</p></div></article>'])
def test_wrappers_of_the_content_are_no_furniture(wrap, inner):
    weights = item_weights(class_counts([page(random.Random(i))[0] for i in range(20)]))
    body = wrap.format(inner.format(STORY) + ASIDE)
    assert main_text(f"<html><body><nav><a href=x>Home</a></nav>{body}<footer>&copy; us</footer></body></html>", weights) == STORY_TEXT


def test_furniture_beside_the_content_stays_furniture():
    weights = item_weights(class_counts([page(random.Random(i))[0] for i in range(20)]))
    related = '<div class="related-posts">' + "<article><p>other story of many words to read next</p></article>" * 9 + "</div>"
    assert main_text(f"<article>{STORY}</article>{related}", weights) == STORY_TEXT
    assert main_text(f"<main>{STORY}{related}<form>Your name please</form></main>", weights) == STORY_TEXT

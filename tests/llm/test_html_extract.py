import numpy as np
import pytest
from tidelog.llm import html_extract as h
from tidelog.llm.html_blocks import blocks
from tidelog.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id bigint, url string, html string"


def test_blocks_of_a_page():
    page = ("<html><head><title>T &amp; t</title><style>p{}</style><script>var x='</p>';</script></head><body class='a b-c'>"
            "<!-- <p>gone</p> --><ul><li><a href='/x'>One</a><li>Two</ul><div id=main><p>A <b>bold<br>word</b>\n  &eacute;&nbsp;x"
            "<p>B<table><tr><td>1<td>2</table></div>tail")
    got = [(b.text, b.path) for b in blocks(page)]
    body = ("html", "body", "class:a", "class:b", "class:c")
    assert got == [("T & t", ("html", "head", "title")), ("One", (*body, "ul", "li")), ("Two", (*body, "ul", "li")),
                   ("A bold word é x", (*body, "div", "id:main", "p")), ("B", (*body, "div", "id:main", "p")),
                   ("1", (*body, "div", "id:main", "table", "tr", "td")), ("2", (*body, "div", "id:main", "table", "tr", "td")),
                   ("tail", body)]
    assert [b.linked for b in blocks(page)][:2] == [0, 3]


@pytest.mark.parametrize("page", ["", "plain", "<p", "<div><p>x", "</div>x</p>", "<script>x", "<!-- x", "<a <b>x", "&#xD800;&bogus;"])
def test_broken_markup(page):
    assert all(b.text for b in blocks(page))


def test_gradients():
    """Back-propagation against finite differences."""
    rng = np.random.default_rng(0)
    net, pages = h.Labeller(3), [h.made_up(i) for i in (1, 2, 3)]
    x, y = h.Inputs([p[:5] for p, _ in pages]), np.concatenate([label[:5] for _, label in pages])

    def loss():
        padded, mask, at = net._padded(net.vectors(x), x.sizes)
        p = h._sigmoid(net._states(padded, mask)[0][at[0], at[1]] @ net.p["out"] + net.p["bias"])[:, 0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), padded, mask, at, p

    _, padded, mask, at, p = loss()
    states, f_steps, b_steps = net._states(padded, mask)
    d = (p - y) / len(y)
    ds = np.zeros_like(states)
    ds[at[0], at[1]] = d[:, None] * net.p["out"][:, 0]
    grads = {k: np.zeros_like(v) for k, v in net.p.items()}
    net._unread("f", padded, f_steps, ds[:, :, :h.HIDDEN], grads)
    net._unread("b", padded[::-1], b_steps, ds[::-1, :, h.HIDDEN:], grads)
    for name in ("fx", "fh", "f1", "bx", "bh", "b1"):
        place = tuple(rng.integers(0, n) for n in net.p[name].shape)
        net.p[name][place] += 1e-5
        high = loss()[0]
        net.p[name][place] -= 2e-5
        low = loss()[0]
        net.p[name][place] += 1e-5
        assert grads[name][place] == pytest.approx((high - low) / 2e-5, rel=1e-3, abs=1e-7)


def test_layouts_never_seen_in_training():
    pages = [h.made_up(s) for s in range(h.MADE_PAGES)]
    net = h.Labeller().train([p for p, _ in pages], [y for _, y in pages])
    new = [h.made_up(s) for s in range(10_000, 10_200)]
    right = [(p > 0.5) == (y > 0.5) for p, (_, y) in zip(net.label([p for p, _ in new]), new)]
    assert np.mean(np.concatenate(right)) > 0.97
    alone = net.label([new[0][0]])[0]
    assert np.allclose(alone, net.label([p for p, _ in new[:9]])[0])  # a page's labels don't depend on its batch


def test_report_against_the_elements(spark):
    """Pages of the table hold their main text in `article`."""
    rows = QUERIES["op9_html_extract"](spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == "\n\n".join(b.text for b in blocks(pages[r.page_id]) if "article" in b.path)
        assert r.n_chars == len(r.text)


def test_odd_rows(spark):
    article = "<body><nav><a>Home</a></nav><article><p>" + "Some long text. " * 20 + "</p></article><footer>c</footer></body>"
    rows = [(1, None, None, 0), (2, "u", "", 0), (None, "u", article, 0), (3, "u", article, 0), (3, "u", article, 0),
            (4, "u", "<article>" + "<p>word word.</p>" * 8_000 + "</article>", 0), (5, "u", "<nav>Menu</nav>", 0)]
    frame = spark.createDataFrame(rows, f"{SCHEMA}, text int")
    net = h.learn(spark.read.parquet(f"{SF}/pages.parquet"))
    out = h.extract(frame, net)
    assert out.columns == ["page_id", "url", "html", "text"]
    got = sorted((str(r.page_id), r.text) for r in out.collect())
    whole = ("Some long text. " * 20).strip()
    assert got == sorted([("1", ""), ("2", ""), ("None", whole), ("3", whole), ("3", whole), ("5", ""),
                          ("4", "\n\n".join(["word word."] * 8_000))])
    assert h.main_text_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_self_closing_svg_is_skipped_alone():
    page = "<p>one</p><svg class='a>b' href=\"x\"/><p>two</p><SVG/><p>three</p><svg><path/>no</svg><p>four <svg />five</p>"
    assert [b.text for b in blocks(page)] == ["one", "two", "three", "four five"]

import html
import random
import re

import numpy as np

from quaylark.llm import html_extract as hx


def wanted(page):
    """The article of the driver's simple pages: its h1 and paragraphs."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", x))).split()) for x in re.split(r"</?p>|</?h1>|</?div[^>]*>|</?li>|</?ul>", inside)]
    return "\n".join(x for x in parts if x)


def test_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = hx.op6_html_extract(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    right = [r.text == wanted(pages[r.page_id]) for r in rows]
    assert np.mean(right) > 0.98, [(r.text, wanted(pages[r.page_id])) for r, ok in zip(rows, right) if not ok][:1]
    assert all(r.n_chars == len(r.text) for r in rows)


def test_gradients_against_differences():
    rng = np.random.default_rng(3)
    net = hx.Labeller(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((5, 3, hx.PATH + hx.WORDS + hx.COUNTS))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    y = rng.integers(0, 2, mask.shape).astype(np.float64)
    grads, _ = net.gradients(x, mask, y)
    for name in net.p:
        flat, g = net.p[name].reshape(-1), grads[name].reshape(-1)
        for k in rng.integers(0, flat.size, 4):
            old = flat[k]
            flat[k] = old + 1e-2
            up = net.gradients(x, mask, y)[1]
            flat[k] = old - 1e-2
            down = net.gradients(x, mask, y)[1]
            flat[k] = old
            assert abs((up - down) / 2e-2 - g[k]) < 3e-3 + 0.05 * abs(g[k]), name


def test_blocks():
    found = hx.blocks("<head><title>no</title></head><body><!-- <p>no</p> --><p>a &amp; <b>b</b>\n c<br>d<p>e<script>var x='</p>'</script> f</p><ul><li><a href='>'>g</a><li>h</ul>i < j <style>p{}</style><div class=\"ad big\">k</div>")
    assert [b.text for b in found] == ["a & b c d", "e f", "g", "h", "i < j", "k"]
    assert found[2].linked == 1 and ".ad" in found[5].path
    assert hx.blocks(None) == [] and hx.blocks("") == [] and [b.text for b in hx.blocks("plain")] == ["plain"]


def test_unseen_templates():
    rng = random.Random(99)
    words = "the of and to in that is for on with as this by it are at from news house".split()
    net = hx.train([])
    right = total = 0
    for _ in range(60):
        page, labels = hx.made_page(rng, words)
        found = hx.blocks(page)
        assert len(found) == len(labels)
        p = net.labels([hx.vectors(found, {})])[0]
        right += int(((p >= 0.5) == np.array(labels, bool)).sum())
        total += len(labels)
    assert right / total > 0.97


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (1, None, "x")], "page_id long, html string, text string")
    net = hx.Labeller(np.random.default_rng(0))
    assert [r.text for r in hx.extract(df, net).collect()] == ["", "", ""]
    assert hx.extract(df.limit(0), net).collect() == []


def test_nothing_is_lost_to_quotes_and_unclosed_elements():
    said = lambda page: [b.text for b in hx.blocks(page)]
    assert said("<article><p title=it's>First part of article.</p><p>Second, don't lose it.</p><p>Third</p></article>") == ["First part of article.", "Second, don't lose it.", "Third"]
    assert said("<p>a</p><svg><path d=x><p>b</p>") == ["a", "b"] and said("<object><p>b</p><canvas>c") == ["b", "c"]
    assert said("<p>x <math><mi>E</mi>=<mi>mc</mi></math> y</p>") == ["x E=mc y"]
    assert said("<head><title>no</title><body><p>yes</p>") == ["yes"] and said("<head>text") == ["text"]
    assert said("<p>a<!-->b<!-- c --!>d") == ["abd"]
    assert said("<p a = 'x>y' b=\"z>\">t</p><p c='>u") == ["t", "u"]
    assert said("<title>open <p>kept</p>") == ["open", "kept"]


def brute_forward(net, x):
    """The chance of each block, one page, one block, one gate at a time."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    states = []
    for side in "fb":
        h, c, out = np.zeros(hx.HIDDEN), np.zeros(hx.HIDDEN), {}
        for t in range(len(x)) if side == "f" else reversed(range(len(x))):
            a = x[t] @ net.p[f"x{side}"] + h @ net.p[f"h{side}"] + net.p[f"b{side}"]
            i, f, o, g = np.split(a, 4)
            c = sig(f) * c + sig(i) * np.tanh(g)
            h = sig(o) * np.tanh(c)
            out[t] = h
        states.append(out)
    return [sig(np.concatenate((states[0][t], states[1][t])) @ net.p["out"] + net.p["bias"][0]) for t in range(len(x))]


def test_forward_pass_block_by_block():
    net, rng = hx.train([]), random.Random(4)
    pages = [hx.vectors(hx.blocks(hx.made_page(rng, ["word", "other", "third."])[0]), {}) for _ in range(12)]
    for x, p in zip(pages, net.labels(pages)):
        assert np.allclose(p, brute_forward(net, x), atol=1e-4)


def test_very_long_pages_and_blocks():
    net = hx.train([])
    long = "word and " * 50_000
    page = "<html><body><article><h1>T</h1>" + "".join(f"<p>block {k} of the page.</p>" for k in range(20_000)) + f"<p>{long}</p></article></body></html>"
    found = hx.blocks(page)
    assert len(found) == 20_002 and len(net.labels([hx.vectors(found, {})])[0]) == 20_002
    other = hx.blocks(page.replace("word and word and </p>", "word and last end </p>"))
    assert not np.array_equal(hx.vectors(found[-1:], {}), hx.vectors(other[-1:], {}))

"""Page blocks against an independent parser, odd markup, and the labeller against plain loops."""

import time
from html.parser import HTMLParser

import numpy as np
import pytest

from framelake.llm import html_blocks, html_extraction
from framelake.llm.common import table


class Plain(HTMLParser):
    """Texts between block-level tags, by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.text, self.silent = [], "", []

    def flush(self):
        words = " ".join(self.text.replace("\x85", " ").split())
        self.blocks += [words] if words else []
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if self.silent or tag in html_blocks.SILENT | html_blocks.RAW:
            self.silent += [tag] if tag not in html_blocks.VOID else []
        elif tag == "br":
            self.text += " "
        elif tag in html_blocks.BLOCK:
            self.flush()

    def handle_startendtag(self, tag, attrs):
        if tag not in ("svg", "math"):
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.silent:
            if tag in self.silent:
                del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag):]
        elif tag in html_blocks.BLOCK:
            self.flush()

    def handle_data(self, data):
        self.text += "" if self.silent else data


def plain_blocks(html):
    parser = Plain()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def test_blocks_equal_an_independent_parser(spark, sf):
    pages = [r.html for r in table(spark, sf, "pages").collect()]
    maker = html_extraction.PageMaker(3)
    pages += [maker.page()[0] for _ in range(150)]
    for html in pages:
        assert [" ".join(b.text.split()) for b in html_blocks.leaves(html)] == plain_blocks(html)


@pytest.mark.parametrize("html,expected", [
    ("<p title=it's>Hello", ["Hello"]), ('<p data-x=5">Hello</p>', ["Hello"]), ('<p class="x>Hello</p><p>two', ["Hello", "two"]),
    ("<svg><svg></svg><text>leak</text></svg>ok", ["ok"]), ("<p title='a>b'>y", ["y"]), ("a < b > c", ["a < b > c"]),
    ('<a "b <p c=\' >x', ["x"]), ("<p a=b/c>x</p>", ["x"]), ("<div title = 'x > y' id=q>z</div>", ["z"]), ("<p =''>x", ["x"]),
    ("<select><option>a<select>b</select></select>c", ["c"]), ("<script>if (a<b) '</p>'</script>d", ["d"]), ("<!-- <p>x", []),
    ("<svg/><p>a", ["a"]), ("<svg width=10/>b</svg>c", ["c"]), ("<textarea><p>x</textarea>y", ["y"]), ("x<br/>y<br>z", ["x y z"]),
    ("<title>t</title><p>&lt;p&gt; &amp;amp;", ["<p> &amp;"]), ("<video><video></video>x</video>y", ["y"]),
])
def test_odd_markup(html, expected):
    assert [b.text for b in html_blocks.leaves(html)] == expected


@pytest.mark.parametrize("unit,times", [
    ('<a "b <p c=\' ', 80_000), ("<div>", 100_000), ("<div>x", 100_000), ("<a c='>' ", 100_000), ("<a ", 300_000), ('<p class="', 50_000),
    ("<svg>", 100_000), ("<ul><li>", 50_000), ("<!--", 100_000), ("</p>", 200_000), ("<p><td><div>", 40_000), ("&amp;", 200_000),
])
def test_parsing_is_linear(unit, times):
    def seconds(n):
        begin = time.process_time()
        html_blocks.leaves(unit * n + "</p>" * 10 + "x")
        return time.process_time() - begin

    assert seconds(times) < 5  # about half a second where it was measured


def test_paths_of_deep_pages_share_their_hashes():
    page = html_blocks.leaves("<div class='a b'>" * 20_000 + "deep")
    assert len(page) == 1 and len(page[0].node.slots) <= 3 and len(page[0].path) == 60_000
    assert page[0].node.slots is page[0].node.parent.slots


def plain_forward(model, x):
    """P(main text) of one page's blocks, gate by gate."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    n, states = len(x), {}
    for side in "fb":
        h = c = np.zeros(html_extraction.HIDDEN)
        for t in range(n) if side == "f" else range(n - 1, -1, -1):
            gates = x[t].astype(float) @ model.p[f"x{side}"] + h @ model.p[f"h{side}"] + model.p[f"c{side}"]
            i, f, g, o = np.split(gates, 4)
            c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
            h = sigmoid(o) * np.tanh(c)
            states[side, t] = h
    both = np.array([np.concatenate([states["f", t], states["b", t]]) for t in range(n)])
    return sigmoid((both @ model.p["out"])[:, 0] + model.p["bias"])


def test_gathered_weights_equal_plain_vectors(monkeypatch):
    """Labels from sparse inputs, in any grouping and pieces, equal those of a plain loop over dense vectors."""
    maker, model = html_extraction.PageMaker(9), html_extraction.BiLstm(4)
    pages = [html_blocks.leaves(maker.page()[0]) for _ in range(25)]
    pages += [[], html_blocks.leaves("text alone"), html_blocks.leaves("<p>" + " ".join(f"w{i}" for i in range(3000)))]
    expected = [plain_forward(model, html_extraction.vectors(p)) if p else np.zeros(0) for p in pages]
    for cells in (16_000, 60, 7):
        monkeypatch.setattr(html_extraction, "CELLS", cells)
        for found, own in zip(model.label(html_extraction.Features(pages)), expected):
            assert np.allclose(found, own, atol=1e-5) and found.shape == own.shape
    x, mask = html_extraction.padded([html_extraction.vectors(p) for p in pages if p])
    dense, _ = model.forward(x, mask)
    assert all(np.allclose(dense[:len(own), k], own, atol=1e-5) for k, own in enumerate(e for e in expected if len(e)))


def test_long_pages_need_little_memory():
    """Beyond the buffers of one piece, a block takes less than a kilobyte."""
    import tracemalloc

    model, peaks = html_extraction.BiLstm(1), []
    for n in (20_000, 60_000):
        page = html_blocks.leaves("<ul>" + "<li>some words here</li>" * n + "</ul>")
        tracemalloc.start()
        assert len(model.label(html_extraction.Features([page]))[0]) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] - peaks[0] < 40_000 * 1000

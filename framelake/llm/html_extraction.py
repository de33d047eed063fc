"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks. Each block is a vector of its hashed tag path, its
hashed words (all of them, as counts of unit length), and a few measures such as length and link density. A bidirectional LSTM in NumPy reads
the sequence both ways and labels every block as main text or not, so a block is judged with the
whole page around it. Blocks labelled main text are joined in page order. When pages are labelled the
vectors are never built: the input weights of what is set in them are gathered and added up, once for each
different path, and long pages are read in pieces.

The labeller is trained here, when it is first needed, on pages made from layout rules: containers
of menus, headers, footers, sidebars, notices, adverts, forms and comments around articles in many
markups, of which each block's label is known; a bounded, seeded number of pages. It never sees
labels of the table it is applied to.

Nulls: a null page is an empty one and gives an empty text. Repeated rows give a row each. A page
without main blocks gives an empty text. Pages are read whole. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from framelake.llm.common import schema_of
from framelake.llm.html_blocks import SLOTS, Leaf, leaves, slot

PATH, WORDS, MEASURES, HIDDEN = SLOTS, 1024, 8, 24
INPUT = PATH + WORDS + MEASURES
#: Made pages to learn from, training steps, pages a step, and pages whose blocks are read together.
TRAINING_PAGES, STEPS, BATCH, GROUP = 3000, 600, 24, 96
#: Blocks in one padded array at most: long pages go alone, in pieces.
CELLS = 16_000
#: Blocks of more different words than this are added up one by one, so many words at a time.
LONG, ENTRIES = 64, 1024
#: Distinct paths whose sums of weights a worker keeps.
PATHS = 1 << 13


@lru_cache(maxsize=1 << 16)
def _word_slot(token: str) -> int:
    """A word without the punctuation around it; 'surrogatepass' as pages may hold anything."""
    return xxhash.xxh32_intdigest(token.strip(".,;:!?()\"'").encode("utf-8", "surrogatepass"), 7) % WORDS


#: Hashes of the names on a block's path, and of the name next to it, apart from those around it.
PathKey = tuple[frozenset[int], int]
NO_PATH: PathKey = (frozenset(), -1)


class Features:
    """Inputs of the blocks of some pages, all blocks in a row: only what is set is held.

    ``paths`` has a key per block, ``measures`` a row; the words of block i are entries ``ends[i]`` to
    ``ends[i + 1]`` of ``slots`` and ``weights``, counts of a length of one.
    """

    def __init__(self, pages: list[list[Leaf]]):
        self.lengths = np.array([len(page) for page in pages], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        n = int(self.starts[-1])
        self.paths: list[PathKey] = []
        found: list[int] = []
        told = []  # of each block: characters, words, characters in links, stops, whether it ends in one, its place, a sign
        for page in pages:
            for k, leaf in enumerate(page):
                text, node = leaf.text, leaf.node
                self.paths.append((node.slots, slot("=" + node.names[-1])) if node else NO_PATH)
                tokens = text.lower().split()
                found += map(_word_slot, tokens)
                told.append((len(text), len(tokens), leaf.linked, sum(map(text.count, ".,;!?")), text[-1] in ".!?:", k,
                             "\N{COPYRIGHT SIGN}" in text))
        size, counts, linked, stops, ended, place, sign = np.array(told, np.int64).reshape(-1, 7).T
        self.measures = np.stack([
            np.log1p(size) / 6, np.log1p(counts) / 4, np.minimum(linked / np.maximum(size, 1), 1), stops / (counts + 1), ended,
            place / np.repeat(self.lengths, self.lengths), 1 / (1 + place), sign], axis=1).astype(np.float32)
        keys, times = np.unique(np.repeat(np.arange(n), counts) * WORDS + np.array(found, np.int64), return_counts=True)
        rows, self.slots = keys // WORDS, (keys % WORDS).astype(np.int32)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
        weights = np.log1p(times)  # a word that a block repeats does not drown the others
        norms = np.maximum(np.sqrt(np.bincount(rows, weights * weights, minlength=n)), 0.5)
        self.weights = (weights / norms[rows]).astype(np.float32)

    def words(self, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Sums of ``weights`` over the words of ``rows``."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        out = np.zeros((len(rows), weights.shape[1]), np.float32)
        # The first words of all blocks together, then the second ones; blocks in falling order of length.
        order = np.argsort(-sizes, kind="stable")
        long = int(np.count_nonzero(sizes > LONG))
        sums, begins = np.zeros((len(rows) - long, weights.shape[1]), np.float32), self.ends[rows[order[long:]]]
        left = np.searchsorted(-sizes[order[long:]], -np.arange(LONG), side="left")  # blocks of more than k words
        for k, n in enumerate(left.tolist()):
            if not n:
                break
            at = begins[:n] + k
            sums[:n] += weights[self.slots[at]] * self.weights[at, None]
        out[order[long:]] = sums
        for i in order[:long].tolist():
            low, high = self.ends[rows[i]], self.ends[rows[i] + 1]
            for at in range(low, high, ENTRIES):
                part = slice(at, min(at + ENTRIES, high))
                out[i] += np.einsum("w,wg->g", self.weights[part], weights[self.slots[part]])
        return out

    def dense(self) -> np.ndarray:
        """One row of ``INPUT`` numbers a block, as training takes them."""
        out = np.zeros((len(self.paths), INPUT), np.float32)
        for row, (slots, last) in zip(out, self.paths):
            row[list(slots)] = 1.0
            if last >= 0:
                row[last] = 1.0
        out[np.repeat(np.arange(len(out)), np.diff(self.ends)), PATH + self.slots] = self.weights
        out[:, PATH + WORDS:] = self.measures
        return out


def vectors(page: list[Leaf]) -> np.ndarray:
    """One row a block."""
    return Features([page]).dense()


class BiLstm:
    """Bidirectional LSTM with a logistic output per step; gates in order input, forget, cell, output."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.p = {"out": draw(2 * HIDDEN, 1, scale=0.2), "bias": np.zeros(1, np.float32)}
        self.sums: dict[tuple[PathKey, str], np.ndarray] = {}
        for side in "fb":
            self.p[f"x{side}"] = draw(INPUT, 4 * HIDDEN, scale=0.1)
            self.p[f"h{side}"] = draw(HIDDEN, 4 * HIDDEN, scale=0.2)
            self.p[f"c{side}"] = np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 0.5 + 0.5 * np.tanh(0.5 * x)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        """States (steps, pages, HIDDEN) of one direction; padding leaves the state as it is."""
        projected = (x.reshape(-1, INPUT) @ self.p[f"x{side}"] + self.p[f"c{side}"]).reshape(*x.shape[:2], 4 * HIDDEN)
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        states, saved = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            gates = projected[t] + h @ self.p[f"h{side}"]
            open_ = self._sigmoid(gates)
            i, f, o = (open_[:, k * HIDDEN:(k + 1) * HIDDEN] for k in (0, 1, 3))
            g = np.tanh(gates[:, 2 * HIDDEN:3 * HIDDEN])
            m = mask[t][:, None]
            new_c = m * (f * c + i * g) + (1 - m) * c
            new_h = m * (o * np.tanh(new_c)) + (1 - m) * h
            if keep:
                saved.append((t, h, c, new_c, i, f, g, o, m))
            h, c = new_h, new_c
            states[t] = h
        return states, saved

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Probabilities (steps, pages), with what the backward pass needs."""
        forward, saved_f = self._run(x, mask, "f", keep)
        backward, saved_b = self._run(x, mask, "b", keep)
        both = np.concatenate([forward, backward], axis=2)
        return self._sigmoid((both @ self.p["out"])[:, :, 0] + self.p["bias"]), (both, saved_f, saved_b)

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over blocks, by backpropagation through time."""
        found, (both, *saved) = self.forward(x, mask, keep=True)
        error = ((found - labels) * mask / mask.sum()).astype(np.float32)
        grads = {"out": np.einsum("tbh,tb->h", both, error)[:, None], "bias": error.sum(keepdims=True)[0]}
        by_state = error[:, :, None] * self.p["out"][:, 0]
        for side, steps, part in zip("fb", saved, (by_state[:, :, :HIDDEN], by_state[:, :, HIDDEN:])):
            by_gates = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            grads[f"h{side}"] = np.zeros_like(self.p[f"h{side}"])
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, new_c, i, f, g, o, m in reversed(steps):
                dh = dh + part[t]
                tanh_c = np.tanh(new_c)
                d = dc * m + dh * m * o * (1 - tanh_c**2)
                gates = np.concatenate([
                    d * g * i * (1 - i), d * c * f * (1 - f), d * i * (1 - g**2), dh * m * tanh_c * o * (1 - o)], axis=1)
                by_gates[t] = gates
                grads[f"h{side}"] += h.T @ gates
                dc = d * f + dc * (1 - m)
                dh = gates @ self.p[f"h{side}"].T + dh * (1 - m)
            flat = by_gates.reshape(-1, 4 * HIDDEN)
            grads[f"x{side}"] = x.reshape(-1, INPUT).T @ flat
            grads[f"c{side}"] = flat.sum(0)
        return grads

    def _along_path(self, key: PathKey, side: str) -> np.ndarray:
        """Sum of the input weights of a path's names."""
        found = self.sums.get((key, side))
        if found is None:
            slots, last = key
            chosen = sorted(slots | {last}) if last >= 0 else []
            found = self.p[f"x{side}"][chosen].sum(0)
            if len(self.sums) >= 2 * PATHS:
                self.sums.clear()
            self.sums[key, side] = found
        return found

    def _inputs(self, features: Features, rows: np.ndarray, side: str) -> np.ndarray:
        """What the gates of one direction take from the blocks ``rows``, which rise: gathered sums of weights,
        no vector of a block."""
        weights = self.p[f"x{side}"]
        out = features.words(weights[PATH:PATH + WORDS], rows) + self.p[f"c{side}"]
        kinds: dict[PathKey, int] = {}
        which = np.array([kinds.setdefault(features.paths[r], len(kinds)) for r in rows.tolist()])
        out += np.stack([self._along_path(key, side) for key in kinds])[which]
        for k in range(MEASURES):
            out += features.measures[rows, k, None] * weights[PATH + WORDS + k]
        return out

    def _states(self, features: Features, pages: np.ndarray, side: str) -> np.ndarray:
        """States (steps, pages, HIDDEN) of one direction over some pages, in pieces of ``CELLS`` blocks."""
        lengths, first = features.lengths[pages], features.starts[pages]
        steps, size = int(lengths.max()), max(1, CELLS // len(pages))
        states = np.zeros((steps, len(pages), HIDDEN), np.float32)
        h = c = np.zeros((len(pages), HIDDEN), np.float32)
        edges = range(0, steps, size)
        for low in edges if side == "f" else reversed(edges):
            high = min(low + size, steps)
            place, column = np.nonzero(np.arange(low, high)[:, None] < lengths)
            rows = first[column] + low + place
            order = np.argsort(rows)
            taken = np.zeros((high - low, len(pages), 4 * HIDDEN), np.float32)
            taken[place[order], column[order]] = self._inputs(features, rows[order], side)
            for t in range(low, high) if side == "f" else range(high - 1, low - 1, -1):
                gates = taken[t - low] + h @ self.p[f"h{side}"]
                open_ = self._sigmoid(gates)
                i, f, o = (open_[:, k * HIDDEN:(k + 1) * HIDDEN] for k in (0, 1, 3))
                m = (t < lengths)[:, None]
                c = np.where(m, f * c + i * np.tanh(gates[:, 2 * HIDDEN:3 * HIDDEN]), c)
                h = np.where(m, o * np.tanh(c), h)
                states[t] = h
        return states

    def label(self, features: Features) -> list[np.ndarray]:
        """P(main text) of each page's blocks; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0)] * len(features.lengths)
        order = [int(k) for k in np.argsort(features.lengths, kind="stable") if features.lengths[k]]
        at = 0
        while at < len(order):
            stop = at + 1
            while stop < len(order) and (stop + 1 - at) * features.lengths[order[stop]] <= CELLS:
                stop += 1
            pages = np.array(order[at:stop])
            raw = sum(np.einsum("tbh,h->tb", self._states(features, pages, side), part[:, 0])
                      for side, part in zip("fb", np.split(self.p["out"], 2)))
            found = self._sigmoid(raw + self.p["bias"])
            for column, k in enumerate(pages):
                out[k] = found[:features.lengths[k], column]
            at = stop
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), INPUT), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, page in enumerate(pages):
        x[:len(page), k], mask[:len(page), k] = page, 1
    return x, mask


# Pages to learn from --------------------------------------------------------------------------

# Names that containers bear; a page draws some of them, or none.
ROLES = {
    "nav": ["nav", "menu", "navbar", "navigation", "main-menu", "breadcrumb", "breadcrumbs", "topnav", "toc", "tabs"],
    "header": ["header", "site-header", "masthead", "top-bar", "branding", "logo"],
    "footer": ["footer", "site-footer", "copyright", "legal", "bottom", "colophon", "imprint"],
    "aside": ["sidebar", "widget", "related", "recommended", "aside", "rail", "trending", "popular", "more-stories", "tags"],
    "notice": ["cookie", "cookie-banner", "consent", "notice", "gdpr", "alert", "popup", "modal", "newsletter",
               "subscribe", "paywall", "disclaimer", "warning", "message"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "adslot", "sponsor", "promotion"],
    "form": ["form", "search", "login", "signup", "contact-form", "subscribe-form"],
    "comments": ["comments", "comment", "comment-list", "replies", "reply", "responses", "discussion", "disqus", "respond"],
    "share": ["share", "social", "sharing", "buttons", "follow"],
}
MAIN = ["content", "main", "article", "post", "entry", "story", "article-body", "post-content", "entry-content", "text", "body"]
# Words of their own that the texts of containers bear, some of them in each block.
SPEECH = {
    "nav": "home menu about contact products services blog news archive topics start kontakt inicio accueil",
    "header": "welcome official logo menu login search edition",
    "footer": "copyright rights reserved privacy policy terms imprint contact legal sitemap impressum datenschutz aviso",
    "aside": "related recommended popular trending stories read latest tags posts week",
    "notice": "cookies cookie consent accept agree privacy preferences partners experience settings subscribe newsletter "
              "inbox javascript browser zustimmen akzeptieren aceptar accepter",
    "advert": "sponsored advertisement buy now offer sale discount deal free shipping order today save limited anzeige publicidad",
    "form": "search email name password login sign submit send address required register",
    "comments": "reply replies says thanks comment comments agree great wrote ago love lol guest",
    "share": "share tweet facebook twitter email print follow link copy whatsapp",
}
TAGS = {"nav": ["nav", "div", "ul", "header"], "header": ["header", "div"], "footer": ["footer", "div"],
        "aside": ["aside", "div", "section"], "notice": ["div", "section", "aside", "p"], "advert": ["div", "aside", "section", "p"],
        "form": ["form"], "comments": ["div", "section", "ol", "ul"], "share": ["div", "ul"]}


class PageMaker:
    """Pages of invented words in varied markup, with the label of each block."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.common = [""]

    def words(self, low: int, high: int, own: str = "") -> str:
        """Invented words; of a container with words of its own, often some of these."""
        pick, often = self.rng.choice, self.rng.choice([0.0, 0.2, 0.5]) if own else 0.0
        own = own.split()
        syllables = ["an", "the", "re", "on", "st", "er", "in", "ou", "la", "de", "que", "sch", "ion", "en", "ti", "ar", "é", "ü", "os"]
        made = [pick(own) if often and self.rng.random() < often else
                pick(self.common) if self.rng.random() < 0.4 else "".join(pick(syllables) for _ in range(self.rng.randint(1, 4))) for _ in range(self.rng.randint(low, high))]
        text, odd = "", self.rng.random()
        if odd < 0.04:  # lists by signs, and repeated words, are main text as often as not
            return pick([" | ", " - ", " / ", " * "]).join(made)
        if odd < 0.07:
            made = [pick(made[:2]) for _ in made]
        for k, word in enumerate(made):
            text += word + (pick([". ", ", ", " ", " ", " ", " ", " ", " "]) if k < len(made) - 1 else "")
        return text.capitalize() + (pick([".", ".", ".", "", "!", "?"]) if len(made) > 4 else "")

    def attributes(self, names: list[str], often: float = 0.8) -> str:
        if self.rng.random() > often:
            return ""
        return f' {self.rng.choice(["class", "class", "id"])}="{self.rng.choice(names)}"'

    def boilerplate(self, role: str) -> list[tuple[str, int | None]]:
        """Pieces of html, and the label of those that are blocks."""
        tag = self.rng.choice(TAGS[role])
        plain = tag in ("nav", "header", "footer", "aside", "form")
        out: list[tuple[str, int | None]] = [(f"<{tag}{self.attributes(ROLES[role], 0.5 if plain else 1.0)}>", None)]
        if role == "comments":
            out += [(f"<h3>{self.words(1, 3, SPEECH[role])}</h3>", 0)]
        lists = role in ("nav", "share") or role in ("aside", "footer", "header") and self.rng.random() < 0.6
        item = "li" if lists else self.rng.choice(["p", "div", "p", "span"])
        if lists and tag not in ("ul", "ol"):
            out.append(("<ul>", None))
        for _ in range(self.rng.randint(1, 8) if lists or role == "comments" else self.rng.randint(1, 3)):
            text = self.words(1, 3, SPEECH[role]) if lists else self.words(3, 40, SPEECH[role])
            text = f'<a href="/{text[:3]}">{text}</a>' if lists or self.rng.random() < 0.2 else text
            if role == "footer" and self.rng.random() < 0.6:
                text = "&copy; " + text
            if tag == "p" or item == "span":
                out.append((f"{text} ", 0))
            elif role == "comments" and item != "li":
                out.append((f'<div{self.attributes(ROLES["comments"], 0.6)}><p>{text}</p></div>', 0))
            else:
                out.append((f"<{item}>{text}</{item}>", 0))
        if lists and tag not in ("ul", "ol"):
            out.append(("</ul>", None))
        if role == "form":
            out.append((f"<label>{self.words(1, 3, SPEECH[role])}</label><input type=text>", 0))
            out.append((f"<button>{self.words(1, 2, SPEECH[role])}</button>", 0))
        return [*out, (f"</{tag}>", None)]

    def spoken(self) -> str:
        """A long paragraph of a notice, an advert or a comment, half of it in its own words at least."""
        own = SPEECH[self.rng.choice(["notice", "advert", "comments"])].split()
        made = [w for n in range(self.rng.randint(6, 20)) for w in (self.rng.choice(own), self.words(1, 1).lower())]
        return " ".join(made).capitalize() + "."

    def article(self) -> list[tuple[str, int | None]]:
        tag = self.rng.choice(["article", "article", "article", "main", "div", "section"])
        out: list[tuple[str, int | None]] = [(f"<{tag}{self.attributes(MAIN, 0.4 if tag in ('article', 'main') else 1.0)}>", None)]
        inner = self.rng.random() < 0.3
        if inner:
            out.append((f"<div{self.attributes(MAIN, 0.7)}>", None))
        if self.rng.random() < 0.85:
            head = self.rng.choice(["h1", "h1", "h2"])
            out.append((f"<{head}>{self.words(2, 12)}</{head}>", 1))
        style = self.rng.random()
        for _ in range(self.rng.choice([1, 2, 3, 5, 8, 12, 20])):
            kind = self.rng.random()
            text = self.words(3, 60)
            if kind < 0.72:
                text = f"<b>{text}<br>" if style < 0.3 and self.rng.random() < 0.3 else text
                out.append((f"<p>{text}" + ("</p>" if self.rng.random() < 0.85 else ""), 1))
            elif kind < 0.78:
                out.append((f"<h2>{self.words(1, 8)}</h2>", 1))
            elif kind < 0.84:
                out += [("<ul>", None), *((f"<li>{self.words(2, 20)}</li>", 1) for _ in range(self.rng.randint(1, 5))), ("</ul>", None)]
            elif kind < 0.88:
                out.append((f"<blockquote><p>{text}</p></blockquote>", 1))
            elif kind < 0.91:
                out.append((f"<pre>{text}</pre>", 1))
            elif kind < 0.94:
                out += [("<table><tr>", None), (f"<td>{self.words(1, 4)}</td>", 1), (f"<td>{self.words(1, 4)}</td>", 1), ("</tr></table>", None)]
            elif kind < 0.96:
                out.append((f'<p>{self.words(3, 10)} <a href="/x">{self.words(1, 3)}</a> {self.words(3, 20)}</p>', 1))
            elif kind < 0.98:
                out += self.boilerplate(self.rng.choice(["advert", "aside", "share", "notice", "form"]))
            else:  # nothing around it tells, only its words
                out.append((f"<p>{self.spoken()}</p>", 0))
        if inner:
            out.append(("</div>", None))
        return [*out, (f"</{tag}>", None)]

    def page(self) -> tuple[str, list[int]]:
        """A page, and a label for each block that ``leaves`` finds in it."""
        rng = self.rng
        # Each page has frequent words of its own, so that no slot of a common word stands for main text or not.
        self.common = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéüñ", k=rng.randint(1, 9))) for _ in range(40)]
        above = [r for r in ("header", "nav", "notice", "advert", "share", "form", "aside") if rng.random() < 0.4]
        below = [r for r in ("advert", "share", "aside", "comments", "form", "notice", "nav", "footer") if rng.random() < 0.4]
        pieces: list[tuple[str, int | None]] = [("<!DOCTYPE html><html><head><title>x</title></head><body>", None)]
        wrapped = rng.random() < 0.4
        pieces += [(f"<div{self.attributes(['wrapper', 'page', 'container', 'site'], 0.8)}>", None)] * wrapped
        for role in above:
            pieces += self.boilerplate(role)
        if rng.random() < 0.97:
            pieces += self.article()
        for role in below:
            pieces += self.boilerplate(role)
        pieces += [("</div>", None)] * wrapped + [("</body></html>", None)]
        # A block's label travels in its text: pieces may merge into one block or leave none.
        marked = "".join(h.replace(">", f">\x01{label}\x02", 1) if label is not None and h.startswith("<")
                         else (f"\x01{label}\x02{h}" if label is not None else h) for h, label in pieces)
        labels = []
        for leaf in leaves(marked):
            at = leaf.text.find("\x01")
            labels.append(int(leaf.text[at + 1]) if at >= 0 else (labels[-1] if labels else 0))
        html = "".join(h for h, _ in pieces)
        return html, labels


@lru_cache(maxsize=2)
def trained(seed: int = 5, pages: int = TRAINING_PAGES, steps: int = STEPS) -> BiLstm:
    """The labeller after ``steps`` Adam steps over made pages; the same for the same arguments."""
    maker, model, rng = PageMaker(seed), BiLstm(seed), random.Random(seed)
    examples = []
    while len(examples) < pages:
        html, labels = maker.page()
        found = leaves(html)
        if found and len(found) == len(labels):
            examples.append((vectors(found), np.float32(labels)))
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        part = rng.sample(examples, BATCH)
        x, mask = padded([v for v, _ in part])
        labels = np.zeros_like(mask)
        for k, (_, own) in enumerate(part):
            labels[:len(own), k] = own
        rate = 0.01 * (1 - step / (steps + 1)) + 0.0005
        for name, g in model.gradients(x, mask, labels).items():
            g = np.clip(g, -1, 1)
            m[name] = 0.9 * m[name] + 0.1 * g
            s[name] = 0.999 * s[name] + 0.001 * g * g
            model.p[name] -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)
    return model


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
              model: BiLstm | None = None, least: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars: blocks of probability ``least`` or more, joined by two line ends."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    fields = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP):
                part = batch.slice(start, GROUP)
                blocks = [leaves(x.as_py()) for x in part.column(2)]
                chances = labeller.label(Features(blocks))
                texts = ["\n\n".join(leaf.text for leaf, p in zip(b, chance) if p >= least)
                         for b, chance in zip(blocks, chances)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()),
                     pa.array(map(len, texts), pa.int64())], schema=schema_of(fields))

    return pages.select(page_id, url, html).mapInArrow(run, fields)

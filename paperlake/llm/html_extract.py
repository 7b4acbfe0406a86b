"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags, each with the elements that it lies in. A block's features are its
ancestors' tags and class or id words and its text's shape (length, share of link text, punctuation, place in the page). The chain's weights are
trained here, by maximum likelihood, on labelled pages that ``labelled_pages`` writes from templates; Viterbi decoding labels all blocks of a page at once, and
the blocks labelled as the article are its text.

Defined results: a null or empty page, and one without an article, has the empty text; broken markup is read as far as it goes (an unclosed
element ends with its parent, an unclosed comment or raw-text element with the page, of an unclosed svg, object, noscript or template only the tag is skipped, a lone < is text); repeated rows are pages each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only

BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu"
    " nav ol option p pre section select summary table tbody td tfoot th thead tr ul button iframe".split()
)
RAW_TAGS = frozenset("script style textarea title noscript template svg iframe object xmp".split())
#: Of these, elements that hold markup in HTML: without an end tag only the opening tag is skipped. The others are raw text to the page's end then.
MARKUP_TAGS = frozenset("noscript template svg object".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag that ends open elements of these names, up to the nearest of the stops.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("article aside body div dl footer form header main nav ol section table ul".split())
ENDS_P = BLOCK_TAGS - {"button", "option", "summary", "legend"}
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)[^>]*+>""", re.S
)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?=[\s=>/]|$)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_DIGIT = re.compile(r"\d")

#: Class, id and role words by what they say about a block.
KINDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager tabs toc skip", "head": "header masthead topbar banner logo branding",
    "foot": "footer foot bottom copyright legal colophon contentinfo", "side": "sidebar aside side rail widget widgets complementary related recommended trending popular more",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted dfp adsense", "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay newsletter subscribe subscription signup paywall",
    "social": "share sharing social follow like tweet", "comment": "comment comments reply replies respond disqus discussion thread", "form": "form login search contact input",
    "body": "article content post entry main story text body prose page",
}
_KIND_OF = {w: k for k, words in KINDS.items() for w in words.split()}
_TAGS = "nav header footer aside form article main section table figure blockquote ul ol dl li td p pre div h1 h2 h3 h4 button select label legend details dialog a figcaption".split()


@dataclass
class Block:
    """A leaf block's text; the names of the elements that it lies in and of the innermost block element; what their class, id and role words say; its share of link text."""

    text: str
    tags: frozenset[str]
    inner: str
    kinds: frozenset[str]
    hidden: bool
    linked: float


@dataclass
class _Open:
    """An open element. All but name and block hold for it and those around it, so no stack is walked at a block."""

    name: str
    tags: frozenset[str] = frozenset()
    inner: str = ""
    kinds: frozenset[str] = frozenset()
    hidden: bool = False
    block: bool = False


_OUTSIDE = _Open("")


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order, those without text left out."""
    out: list[Block] = []
    stack: list[_Open] = []
    open_: Counter[str] = Counter()  # how many elements of a name are open
    held: list[str] = []
    links = [0, 0]  # characters inside and outside of links in the open block

    around = lambda: stack[-1] if stack else _OUTSIDE

    def put(raw: str) -> None:
        held.append(raw)
        links["a" in around().tags] += len(raw.strip())

    def close(k: int) -> None:
        for e in stack[k:]:
            open_[e.name] -= 1
        del stack[k:]

    def end() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                e = around()
                out.append(Block(text, e.tags, e.inner, e.kinds, e.hidden, links[1] / max(1, sum(links))))
            held.clear()
            links[:] = [0, 0]

    at, size, unclosed = 0, len(page), set()
    while at < size:
        m = _MARKUP.search(page, at)
        if not m:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["close"] or m["close2"]:
            if name in BLOCK_TAGS:
                end()
            for k in range(len(stack) - 1, -1, -1) if open_[name] else ():
                if stack[k].name == name:
                    close(k)
                    break
                if name not in BLOCK_TAGS and stack[k].block:
                    break
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in RAW_TAGS:
            if name in BLOCK_TAGS:
                end()
            if not (m["attrs"] or "").endswith("/") and name not in unclosed:
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif name in MARKUP_TAGS:
                    unclosed.add(name)
                else:
                    at = size
            continue
        if name in BLOCK_TAGS:
            end()
            ends = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
            for k in range(len(stack) - 1, -1, -1) if any(open_[x] for x in ends) else ():
                if stack[k].name in ends:
                    close(k)
                    break
                if stack[k].name in STOPS:
                    break
        if name in VOID_TAGS or (m["attrs"] or "").endswith("/"):
            continue
        attrs, e, block = m["attrs"] or "", around(), name in BLOCK_TAGS
        kinds, hidden = _marks(attrs) if "=" in attrs or "hidden" in attrs else (frozenset(), False)
        tags = e.tags if name in e.tags else e.tags | {name}
        stack.append(_Open(name, tags, name if block else e.inner, e.kinds if kinds <= e.kinds else e.kinds | kinds, e.hidden or hidden, block))
        open_[name] += 1
    end()
    return out


@lru_cache(maxsize=4096)
def _marks(attrs: str) -> tuple[frozenset[str], bool]:
    kinds, hidden = set(), False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
        elif key in ("class", "id", "role"):
            kinds.update(_KIND_OF[t] for t in _TOKEN.findall(value) if t in _KIND_OF)
    return frozenset(kinds), hidden


@lru_cache(maxsize=1)
def _vocabulary() -> dict[str, int]:
    names = ["bias", "hidden", *[f"in:{t}" for t in _TAGS], *[f"at:{t}" for t in _TAGS], *[f"kind:{k}" for k in KINDS], "no kind", "in article or main", "header in article", "aside in article"]
    names += [f"words:{k}" for k in range(7)] + [f"linked:{k}" for k in range(4)] + ["sentence", "copyright", "digits", "commas", "first", "last", "shouting"]
    return {n: k for k, n in enumerate(names)}


def features(b: Block, place: int, of: int) -> list[int]:
    """Indexes of a block's features."""
    v, tags = _vocabulary(), b.tags
    n = b.text.count(" ") + 1
    names = ["bias", *[f"in:{t}" for t in tags], *[f"kind:{k}" for k in b.kinds], f"words:{min(6, n.bit_length() - 1)}", f"linked:{min(3, int(4 * b.linked))}"]
    names.append(f"at:{b.inner}")
    article = "article" in tags or "main" in tags
    names += ["no kind"] * (not b.kinds) + ["hidden"] * b.hidden + ["in article or main"] * article + ["header in article"] * (article and "header" in tags) + ["aside in article"] * (article and "aside" in tags)
    names += ["sentence"] * (b.text[-1] in ".!?…。\"”»") + ["copyright"] * ("©" in b.text) + ["digits"] * (10 * len(_DIGIT.findall(b.text)) > len(b.text)) + ["commas"] * ("," in b.text)
    names += ["first"] * (place == 0) + ["last"] * (place == of - 1) + ["shouting"] * b.text.isupper()
    return [v[x] for x in names if x in v]


@dataclass(frozen=True)
class Chain:
    """emit: score of each feature for the article label; step[a, b]: from label a to b; begin: of the article label at the first block."""

    emit: np.ndarray
    step: np.ndarray
    begin: float

    def decode(self, found: list[Block]) -> list[bool]:
        """The likeliest labels (Viterbi)."""
        if not found:
            return []
        emit = [float(self.emit[features(b, k, len(found))].sum()) for k, b in enumerate(found)]
        (s00, s01), (s10, s11) = self.step.tolist()
        no, yes, back = 0.0, self.begin + emit[0], []
        for e in emit[1:]:
            back.append((yes + s10 > no + s00, yes + s11 > no + s01))
            no, yes = max(no + s00, yes + s10), max(no + s01, yes + s11) + e
        label, out = yes > no, []
        for b in reversed(back):
            out.append(label)
            label = b[label]
        return [label, *reversed(out)]


def main_text(page: str, chain: Chain) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, yes in zip(found, chain.decode(found), strict=True) if yes)


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> Chain:
    """Maximum likelihood by forward-backward and Adam, all pages at once."""
    size, longest = len(_vocabulary()), max(len(b) for b, _ in pages)
    x = np.zeros((len(pages), longest, size), np.float32)
    y, mask = np.zeros((len(pages), longest), np.int64), np.zeros((len(pages), longest), bool)
    for p, (found, labels) in enumerate(pages):
        for k, b in enumerate(found):
            x[p, k, features(b, k, len(found))] = 1
        y[p, : len(found)], mask[p, : len(found)] = labels, True
    w = np.zeros(size + 5)
    m, v = np.zeros_like(w), np.zeros_like(w)
    both = mask[:, 1:]
    gold = np.zeros((2, 2))
    np.add.at(gold, (y[:, :-1][both], y[:, 1:][both]), 1)
    for r in range(1, rounds + 1):
        emit, step, begin = w[:size], w[size : size + 4].reshape(2, 2), w[-1]
        e = np.stack([np.zeros(mask.shape), x @ emit], axis=2)
        e[:, 0, 1] += begin
        ahead = [e[:, 0]]
        for k in range(1, longest):
            s = np.logaddexp(ahead[-1][:, 0, None] + step[0], ahead[-1][:, 1, None] + step[1]) + e[:, k]
            ahead.append(np.where(mask[:, k, None], s, ahead[-1]))
        behind = [np.zeros((len(pages), 2))]
        for k in range(longest - 2, -1, -1):
            s = e[:, k + 1] + behind[-1]
            s = np.logaddexp(step[None, :, 0] + s[:, 0, None], step[None, :, 1] + s[:, 1, None])
            behind.append(np.where(mask[:, k + 1, None], s, behind[-1]))
        a, b = np.stack(ahead, 1), np.stack(behind[::-1], 1)
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        p1 = np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None]) * mask
        pair = np.exp(a[:, :-1, :, None] + step[None, None] + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        g = np.concatenate((np.einsum("pk,pkf->f", y * mask - p1, x), (gold - pair.sum((0, 1))).reshape(-1), [(y[:, 0] - p1[:, 0]).sum()])) / len(pages) - ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
    return Chain(w[:size], w[size : size + 4].reshape(2, 2), float(w[-1]))


class _Writer:
    """Writes one labelled page: text of article blocks is marked by a private character, taken off before use."""

    MARK = "\ue000"

    def __init__(self, rng: random.Random):
        self.r = rng

    def words(self, low: int, high: int) -> str:
        syllables = "an er to mi sel ra ko ven ti lo ga des pu ri na sho lek".split()
        return " ".join("".join(self.r.choices(syllables, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int, high: int) -> str:
        return ". ".join(self.words(low, high).capitalize() for _ in range(self.r.randint(1, 4))) + "."

    def kind(self, *names: str) -> str:
        return f'{self.r.choice(["class", "id"])}="{self.r.choice(names)}"'

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{k}">{self.words(1, 3)}</a></li>' for k in range(n))

    def rubbish(self) -> str:
        r, w, s = self.r, self.words, self.sentence
        bare = r.random() < 0.4
        mark = lambda *n: "" if bare else " " + self.kind(*n)
        return r.choice([
            lambda: f"<nav><ul>{self.links(r.randint(2, 8))}</ul></nav>", lambda: f"<nav>{s(1, 9)}</nav>", lambda: f"<aside>{s(2, 25)}</aside>", lambda: f"<aside><p>{s(2, 25)}</p></aside>",
            lambda: f"<form><p>{s(2, 20)}</p></form>", lambda: f"<footer><p>{s(2, 20)}</p></footer>", lambda: f"<div{mark('menu', 'navbar', 'breadcrumb')}><ul>{self.links(r.randint(2, 8))}</ul></div>",
            lambda: f'<div class="{r.choice(["ad", "ads", "advert", "sponsored", "promo-box"])}">{s(3, 15)}</div>', lambda: f'<aside{mark("sidebar", "related")}><h3>{w(1, 4)}</h3><p>{s(3, 20)}</p><ul>{self.links(3)}</ul></aside>',
            lambda: f'<div class="{r.choice(["cookie-notice", "notice", "consent-banner", "newsletter", "alert"])}"><p>{s(4, 20)}</p><button>{w(1, 2)}</button></div>',
            lambda: f"<form{mark('search', 'login-form', 'contact')}><label>{w(1, 2)}</label><input name=q><p>{s(3, 9)}</p><button>{w(1, 2)}</button></form>",
            lambda: f'<{(t := r.choice(["section", "div"]))} class="{r.choice(["comments", "comment-list", "replies"])}"><h3>{w(1, 3)}</h3>' + "".join(f'<{(u := r.choice(["p", "div", "article", "li"]))} class="comment">{s(4, 25)}</{u}>' for _ in range(r.randint(1, 4))) + f"</{t}>",
            lambda: f'<div class="{r.choice(["share", "social"])}"><a href="#">{w(1, 2)}</a> <a href="#">{w(1, 2)}</a></div>', lambda: f'<div class="{r.choice(["sidebar", "widget", "related-posts"])}"><h4>{w(1, 4)}</h4><p>{s(4, 18)}</p></div>',
            lambda: f'<p {r.choice(["hidden", "style=display:none", "aria-hidden=true"])}>{s(4, 20)}</p>', lambda: f"<script>var x='<p>{w(2, 5)}</p>';</script>",
        ])()

    def article(self) -> str:
        r, m = self.r, self.MARK
        out = [f"<{(h := r.choice(['h1', 'h1', 'h2']))}>{m}{self.words(2, 12)}</{h}>"]
        if r.random() < 0.2:
            out = [f"<header>{out[0]}</header>"]
        for _ in range(r.randint(1, 9)):
            text = r.choice([lambda: self.sentence(3, 40), lambda: self.sentence(1, 6), lambda: self.words(1, 4) + ".", lambda: self.words(1, 30), lambda: " | ".join(self.words(1, 1) for _ in range(12))])()
            if r.random() < 0.2:
                text += f' <a href="x">{self.words(1, 3)}</a> {self.words(1, 6)}.'
            body = r.choice(["<p>{}</p>"] * 6 + ["<p><b>{}<br>", "<p>{}", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<pre>{}</pre>", "<figure><figcaption>{}</figcaption></figure>", "<table><tr><td>{}</td></tr></table>", "<div>{}</div>"])
            out.append(body.format(m + text))
            if r.random() < 0.2:
                out.append(self.rubbish())
        return "".join(out)

    def page(self) -> str:
        r = self.r
        top = [f"<header{r.choice(['', ' class=site-header'])}><{(h := r.choice(['p', 'h1', 'div']))}>{self.words(1, 4)}</{h}><ul>{self.links(3)}</ul></header>"] * (r.random() < 0.4)
        top += [self.rubbish() for _ in range(r.choice([0, 1, 2, 2, 3]))]
        end = [self.rubbish() for _ in range(r.choice([0, 1, 2]))]
        end += [f"<footer>&copy; {self.words(1, 3)} &middot; {self.sentence(2, 12)}</footer>", f'<div class="footer">{self.sentence(2, 12)}</div>', ""][r.choice([0, 0, 1, 2]) :][:1]
        a, b = r.choice([("<article>", "</article>")] * 3 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main-content"><div class="post">', "</div></div>"), ("<div>", "</div>"), ("<section>", "</section>"), ("", "")])
        if r.random() < 0.1:
            return f"{a}{self.article()}{b}"
        if r.random() < 0.1:
            return f"{a}<p>{self.MARK}{self.sentence(2, 20)}</p>{b}"
        return f"<html><head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style></head><body>{''.join(top)}{a}{self.article()}{b}{''.join(end)}</body></html>"


def labelled_pages(n: int, seed: int) -> list[tuple[list[Block], list[bool]]]:
    writer, out = _Writer(random.Random(seed)), []
    for _ in range(n):
        found = blocks(writer.page())
        labels = [_Writer.MARK in b.text for b in found]
        for b in found:
            b.text = b.text.replace(_Writer.MARK, "")
        out.append((found, labels))
    return out


@lru_cache(maxsize=1)
def default_chain() -> Chain:
    return train(labelled_pages(800, 1))


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    chain = chain or default_chain()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            source = b.column(2)
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = [main_text(source[i].as_py() or "", chain) for i in range(k, min(k + 256, b.num_rows))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return only(pages, page_id="long", url="string", html="string").mapInArrow(make, "page_id long, url string, text string, n_chars long")

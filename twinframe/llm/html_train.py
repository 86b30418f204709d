"""Trains the weights of html_extract on generated pages: python -m twinframe.llm.html_train [pages] [epochs]

Pages are made from invented words in layouts of many kinds: semantic elements or named divisions or neither, menus, headers,
sidebars, notices, adverts (between paragraphs too), forms, reader comments with whole sentences, footers. A block is labelled
main if it belongs to the generated article. Back-propagation through time and Adam, in numpy; one seed, so the result is fixed.
"""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np

from .html_extract import HIDDEN, INPUT, Page, inputs, run_lstm, sigmoid

MARK = "⁠"  # ends every generated main block, and is taken off before the inputs are made

SYLLABLES = [s.split() for s in ("an er th in on re ti es st en ha or the nd at ou ly ing ble sh", "ch ein sch en ber ge ver lich keit ung au ä ö ü zu der", "le la ou ai eu é è ment tion que re oi an", "ción ar os la que ñ ta do es mi ez rr", "ка то ни ве ро ст на ля", "shi ka ra to mi no yu ki")]
CHROME = "Home About Contact News Sports Login Register Search Menu Archive Privacy Terms Help Next Previous Share Tweet Print Tags Category Subscribe Newsletter Follow Sitemap RSS".split()


class Maker:
    def __init__(self, r: random.Random):
        self.r = r
        self.own = r.choice(SYLLABLES)

    def word(self, pool=None) -> str:
        return "".join(self.r.choice(pool or self.own) for _ in range(self.r.randint(1, 4)))

    def sentence(self, least=3, most=18) -> str:
        pool = self.own
        w = [self.word(pool) for _ in range(self.r.randint(least, most))]
        s = " ".join(w).capitalize()
        return (s.replace(" ", ", ", 1) if self.r.random() < 0.3 else s) + self.r.choice("....?!")

    def prose(self, least=1, most=6) -> str:
        s = " ".join(self.sentence() for _ in range(self.r.randint(least, most)))
        if self.r.random() < 0.2:
            s = s.replace(" ", "&nbsp;", 1).replace(" ", " &amp; ", 1)
        if self.r.random() < 0.25:
            a, _, b = s.partition(" ")
            s = f"{a} <a href='/{self.word()}'>{self.word()}</a> {b}" if self.r.random() < 0.5 else f"<{(t := self.r.choice(['b', 'i', 'em', 'span']))}>{a}</{t}> {b}"
        return s

    def short(self) -> str:
        return self.r.choice(CHROME) if self.r.random() < 0.4 else " ".join(self.word() for _ in range(self.r.randint(1, 4)))

    def wrap(self, inner: str, semantic: str, names: str) -> str:
        """An element for a part of the page: its semantic one, a named division, or (seldom) a bare division."""
        name = self.r.choice(names.split())
        how = self.r.random()
        attr = self.r.choice([f'class="{name}"', f'id="{name}"', f'class="{name} {self.word()}"', f"class={name}", f'class="site-{name}"', f'id="{name}-{self.r.randint(1, 9)}"'])
        if how < 0.45 and semantic != "div":
            return f"<{semantic}{self.r.choice(['', ' ' + attr])}>{inner}</{semantic}>"
        if how < 0.93:
            tag = self.r.choice(["div", "div", "section", "div", "ul" if "<li" in inner else "div"])
            return f"<{tag} {attr}>{inner}</{tag}>"
        return f"<div>{inner}</div>"

    def links(self, least=2, most=14) -> str:
        kind = self.r.random()
        items = [f'<a href="/{self.word()}">{self.short()}</a>' for _ in range(self.r.randint(least, most))]
        if kind < 0.7:
            return "<ul>" + "".join(f"<li>{x}" + self.r.choice(["</li>"] * 3 + [""]) for x in items) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(items) if kind < 0.85 else "".join(f"<p>{x}</p>" for x in items)

    def menu(self):
        return self.wrap(self.links(), "nav", "menu nav navbar navigation main-menu topnav breadcrumb breadcrumbs tabs")

    def header(self):
        inner = self.r.choice([f"<h1>{self.short()}</h1>", f"<p>{self.sentence()}</p>", f"<a href=/>{self.short()}</a>", f"<div class=logo>{self.short()}</div>"])
        return self.wrap(inner + (self.links(1, 5) if self.r.random() < 0.4 else ""), "header", "header masthead top banner page-header site-header topbar branding")

    def footer(self):
        inner = self.r.choice([f"&copy; {self.short()} &middot; {self.prose(1, 2)}", f"<p>© 20{self.r.randint(10, 30)} {self.short()}. {self.sentence()}</p>", self.links(), f"<p>{self.prose()}</p>"])
        return self.wrap(inner, "footer", "footer bottom foot copyright colophon page-footer legal")

    def sidebar(self):
        inner = "".join(self.r.choice([f"<h3>{self.short()}</h3>{self.links(2, 6)}", f"<p>{self.prose(1, 3)}</p>", f"<div class=widget>{self.sentence()}</div>"]) for _ in range(self.r.randint(1, 3)))
        return self.wrap(inner, "aside", "sidebar side related widget aside rail recommended trending popular more-stories secondary")

    def notice(self):
        inner = self.r.choice([f"<p>{self.prose(1, 2)}</p>", self.prose(1, 2), f"<p>{self.sentence()}</p><button>{self.short()}</button>"])
        return self.wrap(inner, self.r.choice(["div", "aside", "dialog"]), "notice cookie cookie-notice consent gdpr popup modal alert newsletter banner-notice paywall subscribe message warning disclaimer")

    def advert(self):
        inner = self.r.choice([self.prose(1, 2), f"<p>{self.prose(1, 2)}</p>", f'<a href="//{self.word()}">{self.sentence()}</a>'])
        return f"<!-- ad {self.r.randint(0, 99)} -->" * (self.r.random() < 0.4) + self.wrap(inner, "div", "ad ads advert advertisement sponsor sponsored promo promoted ad-slot adbox banner-ad")

    def form(self):
        inner = f"<label>{self.short()}</label><input name=q>" + self.r.choice([f"<p>{self.sentence()}</p>", "", f"<select><option>{self.short()}<option>{self.short()}</select>"]) + f"<button>{self.short()}</button>"
        return f'<form action="/{self.word()}">{inner}</form>' if self.r.random() < 0.9 else self.wrap(inner, "div", "form search login signup contact-form")

    def comments(self):
        one = lambda: self.r.choice([f"<p>{self.prose(1, 4)}</p>", f"<b>{self.short()}</b><p>{self.prose(1, 3)}</p>", f"<li><cite>{self.short()}</cite><p>{self.prose(1, 3)}</p></li>", f"<div class=comment><h4>{self.short()}</h4>{self.prose(1, 3)}</div>", f"<article class=comment><p>{self.prose(1, 3)}</p></article>"])
        return self.wrap(self.r.choice([f"<h2>{self.short()}</h2>", "", "<h3>Comments</h3>"]) + "".join(one() for _ in range(self.r.randint(1, 6))), "div", "comments comment-list commentlist responses discussion replies reader-comments disqus comment-section user-comments feedback")

    def article(self):
        m = MARK
        title = self.short() if self.r.random() < 0.3 else self.sentence(2, 10)
        parts = []
        if self.r.random() < 0.8:
            h = f"<h1>{title}{m}</h1>"
            parts.append(f"<header>{h}</header>" if self.r.random() < 0.08 else h)
        for _ in range(self.r.choice([1, 1, 2, 3, 4, 6, 9, 15])):
            x = self.r.random()
            if x < 0.1:
                parts.append(f"<h{(n := self.r.randint(2, 4))}>{self.sentence(1, 6)}{m}</h{n}>")
            elif x < 0.16:
                parts.append("<ul>" + "".join(f"<li>{self.sentence()}{m}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>")
            elif x < 0.2:
                parts.append(f"<blockquote><p>{self.prose(1, 2)}{m}</p></blockquote>")
            elif x < 0.22:
                parts.append("<table>" + "".join(f"<tr><td>{self.word()}{m}<td>{self.sentence(1, 4)}{m}" for _ in range(2)) + "</table>")
            elif x < 0.24:
                parts.append(f"<pre>{self.prose(1, 2)}{m}</pre>")
            elif x < 0.3 and len(parts) > 1:
                parts.append(self.r.choice([self.advert, self.notice, self.advert, self.sidebar])())
            body = self.prose(*self.r.choice([(1, 2), (1, 6), (4, 12)]))
            parts.append(self.r.choice([f"<p>{body}{m}</p>"] * 6 + [f"<p>{body}{m}", f"<p><b>{body}<br>{m}", f"<div>{body}{m}</div>"]))
        return self.wrap("".join(parts), self.r.choice(["article", "article", "main"]), "article content post entry story main article-body post-content entry-content body-text text hentry maincontent")

    def page(self) -> str:
        r = self.r
        if r.random() < 0.2:  # the plainest layout
            top, after = [self.menu()] * (r.random() < 0.9) + [self.advert()] * (r.random() < 0.8), [self.footer()] * (r.random() < 0.9)
        else:
            makers = [self.header, self.menu, self.notice, self.advert, self.form, self.sidebar]
            top = [r.choice(makers)() for _ in range(r.randint(0, 4))]
            after = [r.choice([self.comments, self.comments, self.sidebar, self.advert, self.form, self.notice, self.menu])() for _ in range(r.randint(0, 4))] + [self.footer()] * (r.random() < 0.85)
        body = "".join(top) + (self.article() if r.random() < 0.97 else "") + "".join(after)
        if r.random() < 0.3:
            body = f'<div class="{r.choice(["wrapper", "container", "page", "site", "row", self.word()])}">{body}</div>'
        return f'<!DOCTYPE html><html><head><title>{self.short()}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{body}' + "</body></html>" * (r.random() < 0.9)


def examples(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    r = random.Random(seed)
    out = []
    while len(out) < n:
        p = Page(Maker(r).page())
        y = np.array([MARK in t for t in p.texts], np.float32)
        p.texts = [t.replace(MARK, "").strip() or "." for t in p.texts]
        if len(y):
            out.append((inputs(p), y))
    return out


def backward(x, mask, w, side, keep, dout, grad) -> None:
    """Adds the gradients of one direction; dout is the loss's by each hidden state."""
    dh = np.zeros((x.shape[0], HIDDEN), np.float32)
    dc = np.zeros_like(dh)
    dz_all = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
    for k, h, c, i, f, o, u, s, m in reversed(keep):
        dh = dh + dout[:, k]
        live = np.where(m, dh, 0)
        d = np.where(m, dc, 0) + live * o * (1 - s * s)
        dz = np.concatenate([d * u * i * (1 - i), d * c * f * (1 - f), live * s * o * (1 - o), d * i * (1 - u * u)], axis=1)
        dz_all[:, k] = dz
        grad[f"{side}h"] += h.T @ dz
        dh = np.where(m, 0, dh) + dz @ w[f"{side}h"].T
        dc = np.where(m, d * f, dc)
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    grad[f"{side}x"] += x.reshape(-1, INPUT).T @ flat
    grad[f"{side}b"] += flat.sum(0)


def train(n_pages: int = 8000, epochs: int = 10, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    data, held = examples(n_pages, seed), examples(400, seed + 1)
    w = {}
    for s in "fr":
        w[f"{s}x"] = (rng.normal(size=(INPUT, 4 * HIDDEN)) / np.sqrt(INPUT)).astype(np.float32)
        w[f"{s}h"] = (rng.normal(size=(HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)).astype(np.float32)
        w[f"{s}b"] = np.zeros(4 * HIDDEN, np.float32)
        w[f"{s}b"][HIDDEN : 2 * HIDDEN] = 1.0
    w["o"], w["ob"] = (rng.normal(size=(2 * HIDDEN, 1)) * 0.2).astype(np.float32), np.zeros(1, np.float32)
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][1]) + rng.uniform(0, 6))
        batches = [order[a : a + 32] for a in range(0, len(order), 32)]
        loss = 0.0
        for k in rng.permutation(len(batches)):
            group = [data[i] for i in batches[k]]
            t = max(len(y) for _, y in group)
            x, y, mask = np.zeros((len(group), t, INPUT), np.float32), np.zeros((len(group), t), np.float32), np.zeros((len(group), t), bool)
            for j, (a, b) in enumerate(group):
                x[j, : len(b)], y[j, : len(b)], mask[j, : len(b)] = a, b, True
            x *= rng.random(x.shape) > 0.1  # drop-out of inputs
            keeps = {"f": [], "r": []}
            h = np.concatenate([run_lstm(x, mask, w, s, keeps[s]) for s in "fr"], axis=2)
            p = sigmoid(h @ w["o"] + w["ob"])[:, :, 0]
            loss -= float(np.where(mask, y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7), 0).sum())
            dz = (np.where(mask, p - y, 0) / len(group))[:, :, None].astype(np.float32)
            grad = {n: np.zeros_like(v) for n, v in w.items()}
            grad["o"], grad["ob"] = h.reshape(-1, 2 * HIDDEN).T @ dz.reshape(-1, 1), dz.sum((0, 1))
            dh = dz @ w["o"].T
            for s, part in (("f", dh[:, :, :HIDDEN]), ("r", dh[:, :, HIDDEN:])):
                backward(x, mask, w, s, keeps[s], part, grad)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            rate = 0.006 * (1 - 0.9 * step / (epochs * len(batches)))
            for n, g in grad.items():
                g = g * min(1.0, 5.0 / max(norm, 1e-9))
                first[n], second[n] = 0.9 * first[n] + 0.1 * g, 0.999 * second[n] + 0.001 * g * g
                w[n] -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
        from .html_extract import label

        right = [((q >= 0.5) == (y > 0.5)) for q, (_, y) in zip(label([x for x, _ in held], w), held, strict=True)]
        print(f"epoch {epoch}: loss a page {loss / len(data):.3f}; held-out blocks right {np.concatenate(right).mean():.4f}, pages right {np.mean([r.all() for r in right]):.3f}", flush=True)
    return w


if __name__ == "__main__":
    weights = train(*(int(a) for a in sys.argv[1:]))
    np.savez_compressed(Path(__file__).with_name("html_weights.npz"), **{k: v.astype(np.float16) for k, v in weights.items()})

"""Trains the block labeller of ``blocks`` on made-up pages and writes its weights beside that module.

Run ``python -m gradeloom.llm.block_training``; it takes some minutes. No given page is read.
"""

from __future__ import annotations

import re

import numpy as np

from gradeloom.llm.blocks import PATH, PLAIN, UNITS, WEIGHTS, WORDS, Labeller, _sigmoid, block_vectors, leaf_blocks, padded

#: Made-up pages that the labeller is trained on, and rounds over them.
TRAIN_PAGES, EPOCHS = 8000, 8


class Trainer(Labeller):
    """A labeller that starts from random weights and learns by gradients through time."""

    def __init__(self, seed: int = 1):
        r, d = np.random.default_rng(seed), PATH + WORDS + PLAIN
        super().__init__({})
        for side in "fb":
            self.p["w" + side] = r.normal(0, 1 / np.sqrt(d), (d, 4 * UNITS)) * 0.7
            self.p["u" + side] = r.normal(0, 1 / np.sqrt(UNITS), (UNITS, 4 * UNITS)) * 0.7
            self.p["c" + side] = np.zeros(4 * UNITS)
            self.p["c" + side][UNITS : 2 * UNITS] = 1  # to remember at first
        self.p["o"], self.p["oc"] = r.normal(0, 0.2, 2 * UNITS), np.zeros(1)

    def forward(self, x: np.ndarray, mask: np.ndarray):
        hf, _, kf = self.run(x, "f", mask, keep=True)
        hb, _, kb = self.run(x[::-1], "b", mask[::-1], keep=True)
        h = np.concatenate((hf, hb[::-1]), axis=2)
        return _sigmoid(h @ self.p["o"] + self.p["oc"]), (h, kf, kb)

    def back(self, x, mask, dh, kept, side, grad):
        steps, n, d = x.shape
        u = self.p["u" + side]
        dh_next, dc_next, dz_all = np.zeros((n, UNITS)), np.zeros((n, UNITS)), np.zeros((steps, n, 4 * UNITS))
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, a, tc, m = kept[t]
            dht = dh[t] + dh_next
            live, pass_h, pass_c = dht * m, dht * ~m, dc_next * ~m
            dc = dc_next * m + live * o * (1 - tc * tc)
            dz = np.concatenate((dc * a * i * (1 - i), dc * c * f * (1 - f), live * tc * o * (1 - o), dc * i * (1 - a * a)), axis=1)
            dz_all[t] = dz
            grad["u" + side] += h.T @ dz
            dh_next, dc_next = dz @ u.T + pass_h, dc * f + pass_c
        grad["w" + side] += x.reshape(steps * n, d).T @ dz_all.reshape(steps * n, -1)
        grad["c" + side] += dz_all.sum(axis=(0, 1))

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 2, rate: float = 0.015) -> Trainer:
        r, m1, m2, step = np.random.default_rng(seed), {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for epoch in range(epochs):
            order = r.permutation(len(pages))
            for at in range(0, len(order), 32):
                group = [pages[i] for i in order[at : at + 32]]
                x, mask = padded([g[0] for g in group])
                y = np.zeros(mask.shape)
                for j, g in enumerate(group):
                    y[: len(g[1]), j] = g[1]
                prob, (h, kf, kb) = self.forward(x, mask)
                e = (prob - y) * mask / mask.sum()
                grad = {k: np.zeros_like(v) for k, v in self.p.items()}
                grad["o"], grad["oc"] = np.einsum("tn,tnk->k", e, h), np.array([e.sum()])
                dh = e[:, :, None] * self.p["o"]
                self.back(x, mask, dh[:, :, :UNITS], kf, "f", grad)
                self.back(x[::-1], mask[::-1], dh[::-1, :, UNITS:], kb, "b", grad)
                step += 1
                for k in self.p:
                    m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                    m2[k] = 0.999 * m2[k] + 0.001 * grad[k] ** 2
                    self.p[k] -= rate * (1 - epoch / epochs) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self


# Words that menus, notices, adverts and comments tend to hold, in four languages.
AROUND = "cookie cookies accept akzeptieren accepter aceptar privacy datenschutz login anmelden connexion subscribe abonnieren newsletter advert anzeige publicité anuncio sponsored sale angebot offre oferta share teilen partager compartir reply antworten répondre responder comment kommentar commentaire comentario copyright impressum menu home search suche related".split()


#: Names of boxes that may hold anything.
SAYING_NOTHING = "wrapper container page inner outer row col story body text box block section center left wrap grid layout root app site".split()


def tag_of(start: str) -> str:
    return re.match(r"<(\w+)", start)[1]


def made_up_page(r: np.random.Generator) -> tuple[str, list[bool]]:
    """A page of random layout and invented words, and for each leaf block whether it is main text."""
    parts, truth = ["<!DOCTYPE html><html><head><title>x</title></head><body>"], []
    pick = lambda *a: a[r.integers(len(a))]
    parts[:] = pick(parts, parts, [], ["<html><body>"])
    syllables = ("th er on an re he in ed nd ha at en es or ti it sch ung ver ein qu el ou ment ción ado que mi").split()

    def word(own=()):
        if own and r.random() < 0.4:
            return own[r.integers(len(own))]
        w = "".join(syllables[r.integers(len(syllables))] for _ in range(r.integers(1, 4)))
        return w.upper() if r.random() < 0.02 else w

    def text(least, most, own=()):
        own = own if r.random() < 0.5 else ()  # half of what surrounds a text is told by place alone
        s = " ".join(word(own) for _ in range(r.integers(least, most)))
        return s.capitalize() + pick(".", ".", ".", "!", "?", "")

    def put(open_, s, close, main):
        parts.append(open_ + s + close)
        truth.append(main)

    def link():
        return f'<a href="/{word()}">{word()}</a>'

    def menu(tag):
        parts.append(tag)
        if r.random() < 0.8:
            parts.append("<ul>")
            for _ in range(r.integers(2, 9)):
                put("<li>", link(), "</li>", False)
            parts.append("</ul>")
        else:
            put(pick("<div>", ""), pick(" | ", " ").join(link() for _ in range(r.integers(1, 7))), pick("</div>", ""), False)
        parts.append("</" + tag_of(tag) + ">")

    def noise(tag, least=1, most=25, own=AROUND):
        name = tag_of(tag)
        parts.append(tag)
        for _ in range(r.integers(1, 4)):
            inner = pick("p", "div", "h3", "")
            if inner:
                put(f"<{inner}>", link() if r.random() < 0.3 else text(least, most, own), f"</{inner}>", False)
            else:
                parts.append("<div>")
                put("", text(least, most, own), "</div>", False)
        parts.append(f"</{name}>")

    side = lambda: pick('<aside>', '<aside class="sidebar">', '<div class="sidebar">', '<div id="sidebar">', '<div class="related">', '<section class="related-posts">', '<div class="widget">', '<aside class="widget-area">')
    advert = lambda: pick('<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">', '<div class="promo">', '<div class="banner">', '<aside class="ad">', '<section class="promo">')
    notice = lambda: pick('<div class="cookie-notice">', '<div class="notice">', '<div id="cookie-banner">', '<div class="newsletter">', '<div class="popup">', '<div class="share">', '<div class="breadcrumb">', '<div class="consent">', '<div role="alert">', '<div class="social">', '<section class="notice">')
    comments = lambda: pick('<div class="comments">', '<section class="comments">', '<section id="comments">', '<div id="comments">', '<ol class="comment-list">', '<div class="comment">', '<div class="discussion">')

    def form():
        parts.append(pick('<form action="/s">', '<form class="search">', '<form id="signup">'))
        put(pick("<p>", "<div>", "<label>"), text(1, 8), "</p>", False)
        parts.append('<input name="q"></form>')

    def bare(tag):
        name = tag_of(tag)
        put(tag, link() if r.random() < 0.2 else text(1, 30, AROUND), f"</{name}>", False)

    def before():
        for kind in r.permutation(6):
            if r.random() < 0.45:
                [lambda: menu(pick("<nav>", '<nav class="menu">', '<div class="nav">', '<div id="menu">', '<ul class="menu">')), lambda: bare(advert()), lambda: bare(notice()), lambda: noise(pick("<header>", '<header class="site-header">', '<div class="header">', '<div id="header">')), form, lambda: bare(side())][kind]()
                if r.random() < 0.3:
                    parts.append(f"<!-- {word()} -->")

    def after():
        for kind in r.permutation(6):
            if r.random() < 0.45:
                [lambda: noise(side()), lambda: noise(comments()), lambda: bare(advert()), lambda: noise(notice()), form, lambda: menu("<nav>")][kind]()
        if r.random() < 0.85:
            tag = pick("<footer>", "<footer>", '<div class="footer">', '<div id="footer">', '<footer class="site-footer">')
            (bare if r.random() < 0.7 else noise)(tag)

    def inside():
        kind = r.integers(6)
        [lambda: bare(advert()), lambda: bare(side()), lambda: noise(comments()), form, lambda: menu("<nav>"), lambda: bare(notice())][kind]()

    own_name = lambda: f' {pick("class", "class", "id")}="{word() if r.random() < 0.6 else pick(*SAYING_NOTHING)}"' if r.random() < 0.7 else ""
    layout = r.random()
    if layout < 0.02:  # no markup at all
        parts[:] = []
        put("", text(3, 60), "", True)
        return parts[0] + "", truth
    if layout < 0.4:  # paragraphs in the body, or in boxes that say nothing; with or without what surrounds them
        alone = r.random() < 0.3
        if alone and r.random() < 0.5:
            parts[:] = []
        outer = [f"<{pick('div', 'section', 'center')}{own_name()}>" for _ in range(int(r.integers(0, 3)))]
        parts += outer
        if not alone:
            before()
        boxes = [f"<{pick('div', 'div', 'section')}{own_name()}>" for _ in range(int(r.integers(0, 4)))]
        parts += boxes
        if r.random() < 0.5:
            put(pick("<h1>", "<h2>", "<h3>"), text(1, 10), "</h1></h2></h3>", True)
        tag = pick("p", "p", "div", "div", "td", "section", "")
        named = r.random() < 0.3
        for _ in range(int(r.integers(1, 12))):
            kind = tag or pick("p", "div", "blockquote", "li", "h3")
            s = text(*((1, 5) if r.random() < 0.2 else (4, 70)))
            if r.random() < 0.15:
                s += f" {link()} " + text(2, 20)
            put(f"<{kind}{own_name() if named else ''}>", s, f"</{kind}>", True)
        parts.append("".join(f"</{tag_of(b)}>" for b in boxes[::-1]))
        if not alone:
            after()
        parts.append("".join(f"</{tag_of(b)}>" for b in outer[::-1]))
        return "".join(parts), truth
    wrapped = r.random() < 0.3
    if wrapped:
        parts.append(f"<div{own_name()}>")
    before()
    box = pick("", "<div>", "<section>", "<table><tr><td>", f"<div{own_name()}>", f"<div{own_name()}>") if r.random() < 0.25 else pick("<article>", "<article>", "<article>", "<main>", "<main><article>", '<div class="content">', '<div id="content">', '<div class="post">', '<div class="article-body">', '<div class="entry-content">', '<article class="post">', '<div id="main">')
    parts.append(box)
    if r.random() < 0.8:
        put(pick("<h1>", '<h1 class="title">', "<h2>"), text(2, 12) if r.random() < 0.9 else word(), "</h1>", True)
    for _ in range(int(r.integers(1, 5)) if r.random() < 0.5 else int(r.integers(5, 25))):
        kind, length = r.random(), (1, 4) if r.random() < 0.25 else (4, 60)
        s = text(*length)
        if r.random() < 0.15:
            s += f" {link()} " + text(2, 20)
        if kind < 0.66:
            put(pick("<p>", "<p>", "<p><b>", '<p class="lead">'), s, pick("</p>", "</p>", "<br>") if r.random() < 0.5 else "</p>", True)
            if not parts[-1].endswith("</p>"):
                parts.append("</p>" if r.random() < 0.3 else "<p>")
        elif kind < 0.74:
            put(pick("<h2>", "<h3>"), text(1, 8), "</h2></h3>", True)
        elif kind < 0.82:
            parts.append("<ul>")
            for _ in range(r.integers(1, 5)):
                put("<li>", text(1, 20), "</li>", True)
            parts.append("</ul>")
        elif kind < 0.9:
            put(pick("<blockquote>", "<pre>", "<blockquote><p>", "<div>", "<figcaption>"), s, "</p></blockquote></pre></div></figcaption>", True) if box != '<div class="content">' else put("<blockquote>", s, "</blockquote>", True)
        elif kind < 0.95:
            parts.append("<table><tr>")
            for _ in range(r.integers(1, 4)):
                put("<td>", text(1, 6), "</td>", True)
            parts.append("</tr></table>")
        elif r.random() < 0.7:
            inside()
    if r.random() < 0.2:
        inside()
    parts.append("".join(f"</{n}>" for n in re.findall(r"<(\w+)", box)[::-1]))
    after()
    parts.append("</body></html>")
    return "".join(parts), truth


def main(pages: int = TRAIN_PAGES) -> None:
    r, rows = np.random.default_rng(11), []
    while len(rows) < pages:
        page, truth = made_up_page(r)
        blocks = leaf_blocks(page)
        if len(blocks) == len(truth):
            rows.append((block_vectors(blocks), np.array(truth, float)))
    weights = Trainer().train(rows).p
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float32) for k, v in weights.items()})


if __name__ == "__main__":
    main()

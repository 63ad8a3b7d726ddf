"""A plain rule for the main text of the test tables' pages: what stands in article, without parts that surround a text."""

import re
from html.parser import HTMLParser

VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr b big cite code em font i kbd mark q s small span strong sub sup u br img input label".split())
SILENT = {"script", "style", "noscript", "template", "title", "select", "button", "textarea"}
AROUND = {"nav", "aside", "footer", "header", "form"}
AROUND_CLASS = re.compile(r"\b(ad|ads|advert|comments?|cookie|notice|sidebar|related|share|newsletter|menu|promo)\b")


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.buf, self.blocks = [], [], []

    def flush(self):
        text = " ".join("".join(self.buf).split())
        self.buf.clear()
        names = [n for n, _ in self.stack]
        if text and "article" in names and not any(n in AROUND or AROUND_CLASS.search(c) for n, c in self.stack):
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in INLINE:
            self.buf.append(" " if tag == "br" else "")
            return
        self.flush()
        if tag in ("p", "h1", "h2", "h3", "ul", "div", "aside", "table", "blockquote", "pre", "form") and self.stack and self.stack[-1][0] == "p":
            self.stack.pop()
        if tag not in VOID:
            self.stack.append((tag, " ".join(v or "" for k, v in attrs if k in ("class", "id"))))

    def handle_endtag(self, tag):
        if tag in INLINE:
            return
        self.flush()
        if tag in [n for n, _ in self.stack]:
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(n in SILENT for n, _ in self.stack):
            self.buf.append(data)


def main_text(html: str | None) -> str:
    p = Plain()
    p.feed(html or "")
    p.close()
    p.flush()
    return "\n\n".join(p.blocks)

"""HTML to plain text with headings, by the standard library's event parser, a hundred pages at a time."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SKIPPED = {"script", "style", "nav", "head", "noscript", "template"}
BLOCKS = {"p", "div", "article", "section", "li", "ul", "ol", "tr", "table", "br", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "body"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skip:
            self.skip += [tag] * (tag == self.skip[0])
        elif tag in SKIPPED:
            self.skip.append(tag)
        elif tag in BLOCKS:
            self.out.append("\n" + ("=" * int(tag[1]) + " " if tag[0] == "h" and tag[1:].isdigit() and tag != "h1" else ""))

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip[0]:
                self.skip.pop()
        elif tag in BLOCKS:
            self.out.append((" " + "=" * int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() and tag != "h1" else "") + "\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.out.append(data)


def plain(html: str | None) -> str:
    """Text of a page: skipped parts by depth of the same tag, entities decoded once, blocks on lines of their own."""
    if not html:
        return ""
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.out).split("\n"))
    return "\n".join(x for x in lines if x)


#: Rows go to Python in batches of a hundred: an Arrow batch of 10,000 whole pages, held several times over, fills a worker.
_plain = F.udf(plain, StringType(), useArrow=False)


def html_text(html: Column | str) -> Column:
    return _plain(html)

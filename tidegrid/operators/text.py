"""Text of web pages."""

from __future__ import annotations

import re
from functools import partial
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content is not text, and elements before and after which a line ends.
HIDDEN = frozenset(["script", "style", "noscript", "template"])
BLOCKS = frozenset(["p", "div", "br", "li", "ul", "ol", "tr", "table", "section", "article", "header", "footer", "nav", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"])


def _events(html: str) -> list[tuple[str, str]]:
    """What a page holds, in order: ('open', tag), ('close', tag) and ('data', text)."""
    found: list[tuple[str, str]] = []
    note = lambda kind, what, *_: found.append((kind, what))
    reader = HTMLParser(convert_charrefs=True)
    reader.handle_starttag, reader.handle_endtag, reader.handle_data = partial(note, "open"), partial(note, "close"), partial(note, "data")
    reader.feed(html)
    reader.close()
    return found


def _open_references_kept(html: str) -> tuple[str, str]:
    """html with another character, one that it lacks, for each & that begins no reference ended by a semicolon; and that character."""
    held = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in html)
    return re.sub("&(?!#?[0-9A-Za-z]+;)", held, html), held


def text_of(html: str | None, closed: bool = False) -> str | None:
    """Visible text: a line ends at each block element, runs of blanks are one blank, and of empty lines in a row one stays.

    A page that can't be parsed gives what is left when each <...> is a blank. Null stays null. closed: only character
    references with their semicolon are read; others, as where a text was cut short, stay as they stand.
    """
    if html is None:
        return None
    if closed and "&" in html:
        own, held = _open_references_kept(html)
        return text_of(own).replace(held, "&")
    try:
        events = _events(html)
    except Exception:  # markup that the parser gives up on
        return re.sub("<[^>]+>", " ", html)
    depth, pieces = 0, []
    for kind, what in events:
        if kind == "data":
            pieces.append("" if depth else what)
        elif what in HIDDEN:
            depth = max(0, depth + (1 if kind == "open" else -1))
        elif what in BLOCKS:
            pieces.append("\n")
    blanks = re.sub("[ \t]+", " ", "".join(pieces))
    return re.sub(r"\n\s*\n", "\n\n", blanks).strip()


def page_texts(pages: DataFrame, closed: bool = False) -> DataFrame:
    def texts_of(html: pd.Series) -> pd.Series:
        return html.map(partial(text_of, closed=closed))

    return pages.select("page_id", "url", F.pandas_udf(texts_of, "string")("html").alias("text"))

"""Structure of raw pages in one Arrow pass over the standard library's HTML parser: head data, headings, lines, links, JSON-LD."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "struct<title:string,description:string,canonical:string,og_title:string,lang:string,h1:string,h2s:array<string>,lines:array<string>,links:array<struct<href:string,anchor:string,section:string>>,n_words:int,organisation:string,people:array<struct<name:string,role:string>>>"
_SKIP = {"script", "style", "noscript", "template"}
_BLOCK = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "br", "section", "article", "header", "footer", "nav", "title", "ul", "ol", "table", "address", "body"}
_SECTIONS = {"header", "nav", "footer", "main", "aside"}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: dict = {"title": None, "description": None, "canonical": None, "og_title": None, "lang": None, "h1": None, "h2s": [], "lines": [], "links": [], "n_words": 0, "organisation": None, "people": []}
        self.stack: list[str] = []
        self.text: list[str] = []
        self.link: dict | None = None
        self.script: list[str] | None = None

    def flush(self) -> None:
        line = " ".join("".join(self.text).split())
        self.text.clear()
        if not line:
            return
        place = next((t for t in reversed(self.stack) if t in ("title", "h1", "h2")), "")
        if place == "title":
            self.out["title"] = self.out["title"] or line
            return
        if place == "h1":
            self.out["h1"] = self.out["h1"] or line
        if place == "h2":
            self.out["h2s"].append(line)
        if not self.out["lines"] or self.out["lines"][-1] != line:
            self.out["lines"].append(line)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in _BLOCK:
            self.flush()
        if tag == "html":
            self.out["lang"] = a.get("lang") or None
        if tag == "meta" and (a.get("name", "").lower() == "description"):
            self.out["description"] = a.get("content") or None
        if tag == "meta" and a.get("property") == "og:title":
            self.out["og_title"] = a.get("content") or None
        if tag == "link" and a.get("rel") == "canonical":
            self.out["canonical"] = a.get("href") or None
        if tag == "a" and "href" in a:
            section = next((t for t in reversed(self.stack) if t in _SECTIONS), "body")
            self.link = {"href": a["href"].strip(), "anchor": "", "section": section}
            self.out["links"].append(self.link)
        if tag == "script" and a.get("type") == "application/ld+json":
            self.script = []
        if tag not in ("meta", "link", "br", "img", "input", "hr"):
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self.flush()
        if tag == "a" and self.link is not None:
            self.link["anchor"] = " ".join(self.link["anchor"].split())
            self.link = None
        if tag == "script" and self.script is not None:
            self.structured("".join(self.script))
            self.script = None
        if tag in self.stack:
            del self.stack[len(self.stack) - 1 - self.stack[::-1].index(tag) :]

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        if self.stack and self.stack[-1] in _SKIP:
            return
        self.text.append(data)
        if self.link is not None:
            self.link["anchor"] += data

    def structured(self, raw: str) -> None:
        """Organisation and people of JSON-LD, wherever they are nested; bad JSON has none."""
        try:
            todo = [json.loads(raw)]
        except ValueError:
            return
        while todo:
            node = todo.pop(0)
            if isinstance(node, list):
                todo = node + todo
            elif isinstance(node, dict):
                kind = node.get("@type")
                kind = str((kind[0] if isinstance(kind, list) and kind else kind) or "").lower()
                name = node.get("name")
                if kind in ("organization", "localbusiness", "corporation") and isinstance(name, str):
                    self.out["organisation"] = self.out["organisation"] or name
                if kind == "person" and isinstance(name, str):
                    role = node.get("jobTitle")
                    self.out["people"].append({"name": name, "role": role if isinstance(role, str) else None})
                todo = [v for v in node.values() if isinstance(v, (dict, list))] + todo


def read_page(html: str | None) -> dict:
    page = _Page()
    page.feed(html or "")
    page.close()
    page.flush()
    page.out["n_words"] = sum(len(x.split()) for x in page.out["lines"])
    return page.out


def _series(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_page(x) for x in html], columns=[f.split(":")[0] for f in ("title", "description", "canonical", "og_title", "lang", "h1", "h2s", "lines", "links", "n_words", "organisation", "people")])


def parsed(html: pd.Series) -> pd.DataFrame:
    """Like _series, for pages of any kind: one that breaks the parser has empty parts."""

    def one(x):
        try:
            return read_page(x)
        except Exception:  # a broken page must not end a stream
            return read_page("")

    return pd.DataFrame([one(x) for x in html], columns=[f.split(":")[0] for f in ("title", "description", "canonical", "og_title", "lang", "h1", "h2s", "lines", "links", "n_words", "organisation", "people")])


def structure(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """(ident, page): the parsed page as a struct; null or empty HTML has empty parts."""
    return pages.select(ident, F.pandas_udf(_series, SCHEMA)(F.col(html)).alias("page"))

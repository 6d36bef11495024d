"""Elements of raw pages as a table in document order, and what follows from the order by windows.

One Arrow pass gives a row for each element: `pre` and `post` number the starts and ends of elements in one sequence, so an element lies within another if and only
if its interval does. Questions on the tree are then windows over `pre`, without joins of a page with itself: "inside such an element" is a running maximum of
`post`, "the nearest heading before it in its section" an as-of last value. Windows are partitioned by page and part (PART elements), carry what stands before a
part in from a small table, and so bound what one task holds even for a page of millions of elements.

Defined cases: null or empty HTML has no elements; void elements and comments nest nothing; end tags without a start are passed over; elements never closed end with their parent; a
paragraph or list item ends where the next begins; text in scripts and styles is none.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "pre int, post int, depth int, tag string, id string, class string, role string, href string, title string, label string, section string, location string, text string"
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Sections by tag, by role, and by hints in id or class, in the order in which hints count.
BY_TAG = {"header": "header", "nav": "nav", "footer": "footer", "main": "main", "aside": "aside"}
BY_ROLE = {"banner": "header", "navigation": "nav", "contentinfo": "footer", "main": "main"}
HINTS = (("footer", "footer"), ("navbar", "header"), ("topbar", "header"), ("masthead", "header"), ("nav", "nav"), ("menu", "nav"))
LOCATIONS = {"nav": "nav", "header": "header", "footer": "footer", "main": "main", "article": "main"}
#: Elements of a page that one window takes.
PART = 1 << 16
#: Elements that the next of their kind ends, and the elements within which it does.
_ENDS = {"p": frozenset(("p",)), "li": frozenset(("li",)), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd"))}
_WALLS = frozenset(("ul", "ol", "table", "dl", "select", "div", "section", "article", "body"))
_LEFT = ("script", "style", "noscript", "template")


def section_of(tag: str, a: dict[str, str]) -> str | None:
    """The section that an element opens, by tag, role or hints."""
    if tag in BY_TAG:
        return BY_TAG[tag]
    if (role := a.get("role", "").lower()) in BY_ROLE:
        return BY_ROLE[role]
    named = f"{a.get('id', '')} {a.get('class', '')}".lower()
    return next((s for hint, s in HINTS if hint in named), None)


class _Reader(HTMLParser):
    """Rows of the elements of one page, kept until they end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[tuple[str, int, str, str, list[str] | None]] = []  # tag, row, section and location for what is within, text
        self.clock = 0

    def tick(self) -> int:
        self.clock += 1
        return self.clock - 1

    def close_top(self) -> None:
        _, row, _, _, text = self.open.pop()
        self.rows[row][1] = self.tick()
        if text is not None:
            self.rows[row][12] = " ".join(" ".join(text).split())

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in _ENDS.get(tag, ()):
                while len(self.open) > k:
                    self.close_top()
                break
            if self.open[k][0] in _WALLS:
                break
        section, location = (self.open[-1][2], self.open[-1][3]) if self.open else ("body", "body")
        self.rows.append([self.tick(), 0, len(self.open), tag, a.get("id"), a.get("class"), a.get("role"), a["href"].strip() if "href" in a else None, a.get("title"), a.get("aria-label"), section, location, None])
        self.open.append((tag, len(self.rows) - 1, section_of(tag, a) or section, LOCATIONS.get(tag, location), [] if tag == "a" or tag in HEADINGS else None))
        if tag in VOID:
            self.close_top()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.close_top()

    def handle_endtag(self, tag):
        if any(o[0] == tag for o in self.open):
            while self.open[-1][0] != tag:
                self.close_top()
            self.close_top()

    def handle_data(self, data):
        if self.open and self.open[-1][0] in _LEFT:
            return
        for o in self.open:
            if o[4] is not None:
                o[4].append(data)

    def finish(self, html: str) -> list[list]:
        self.feed(html)
        self.close()
        while self.open:
            self.close_top()
        return self.rows


def elements(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """(ident, pre, post, depth, tag, id, class, role, href, title, label, section, location, text): the elements of each page. `section` and `location` are
    those that the element stands in; links and headings have their text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    slim = pages.select(F.col(ident), F.col(html).cast("string").alias("__html"))
    out = f"`{ident}` {slim.schema[ident].dataType.simpleString()}, {SCHEMA}"
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = to_arrow_schema(slim.select(F.lit(None).cast(f"struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>").alias("x")).select("x.*").schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, page in enumerate(b["__html"].to_pylist()):
                rows = _Reader().finish(page or "")
                if rows:
                    own = [pa.array(c, types.field(n).type) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
                    yield pa.RecordBatch.from_arrays([b[ident].take(pa.array([i] * len(rows))), *own], names=[ident, *names])

    return slim.mapInArrow(read, out)


def _carried(rows: DataFrame, ident: str, value: Column, part: int) -> tuple[DataFrame, DataFrame]:
    """(rows with `__part`; __id, __p, __before): `__before` is the greatest `value` of the parts before one, an aggregate of few rows for
    each page, so that windows need not span a page."""
    parted = rows.withColumn("__part", F.floor(F.col("pre") / (2 * part)).cast("int"))
    ends = parted.groupBy(ident, "__part").agg(F.max(value).alias("__end"))
    before = Window.partitionBy(ident).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return parted, ends.withColumn("__before", F.max("__end").over(before)).select(F.col(ident).alias("__id"), F.col("__part").alias("__p"), "__before")


def within(rows: DataFrame, ident: str, outer: Column, part: int = PART) -> DataFrame:
    """Adds `inside`: whether an element lies within one that `outer` names (not being it)."""
    parted, before = _carried(rows, ident, F.when(outer, F.col("post")), part)
    run = Window.partitionBy(ident, "__part").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    far = F.greatest(F.max(F.when(outer, F.col("post"))).over(run), F.col("__before"))
    return parted.join(before, F.col(ident).eqNullSafe(F.col("__id")) & (F.col("__part") == F.col("__p"))).select(*rows.columns, F.coalesce(far > F.col("post"), F.lit(False)).alias("inside"))


def headed_links(rows: DataFrame, ident: str, part: int = PART) -> DataFrame:
    """(ident, pre, href, text, title, label, section, location, heading) of each link; `heading` is the nearest heading before it (120 characters at most, the feature's bound) if
    it stands in the same section."""
    place = F.when(F.col("tag").isin(*HEADINGS) & (F.coalesce("text", F.lit("")) != ""), F.struct("pre", F.left("text", F.lit(120)).alias("text"), "section"))
    parted, before = _carried(rows.where(F.col("tag").isin(*HEADINGS) | ((F.col("tag") == "a") & F.col("href").isNotNull())), ident, place, part)
    run = Window.partitionBy(ident, "__part").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = parted.join(before, F.col(ident).eqNullSafe(F.col("__id")) & (F.col("__part") == F.col("__p"))).drop("__id", "__p")
    last = joined.withColumn("__head", F.coalesce(F.last(place, ignorenulls=True).over(run), F.col("__before")))
    heading = F.when(F.col("__head.section") == F.col("section"), F.col("__head.text"))
    return last.where("tag = 'a'").select(ident, "pre", "href", "text", "title", "label", "section", "location", heading.alias("heading"))

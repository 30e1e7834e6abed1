"""Anchors, blocks and crawl walks over stored pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import dates, text
from quorumlake.storage import stored

ANCHOR = r'<a [^>]*href="([^"]*)"[^>]*>([^<]*)</a>'


def anchors(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The pages' other columns with pos, href and label of each plain anchor."""
    pairs = F.arrays_zip(F.regexp_extract_all(text.text(F.col(html_col)), F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(text.text(F.col(html_col)), F.lit(ANCHOR), F.lit(2)).alias("label"))
    rows = pages.withColumn("__pairs", pairs).select(*[c for c in pages.columns if c != html_col], F.posexplode("__pairs").alias("pos", "__a"))
    return rows.select(*[c for c in pages.columns if c != html_col], "pos", F.col("__a.href").alias("href"), text.squeeze(F.col("__a.label")).alias("label"))


def absolute(href: Column, page_url: Column) -> Column:
    """href against the page's address: whole, from the host's root, or beside the page."""
    host = F.regexp_extract(page_url, r"^(https?://[^/?#]+)", 1)
    beside = F.regexp_replace(F.regexp_replace(page_url, "[?#].*$", ""), r"(://[^/]+/(?:.*/)?)[^/]*$", "$1")
    return F.when(F.rlike(href, F.lit("^https?://")), href).when(F.startswith(href, F.lit("/")), F.concat(host, href)).otherwise(F.concat(beside, href))


class _Leaves(HTMLParser):
    """Leaf blocks (tag, class, text) of a page."""

    BLOCKS = frozenset("p div section article li h1 h2 h3 h4 td".split())
    UNSEEN = frozenset("script style".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at: tuple[str, str] = ("", "")
        self.said: list[str] = []
        self.blocks: list[tuple[str, str, str]] = []
        self.unseen = 0

    def flush(self) -> None:
        said = " ".join("".join(self.said).split())
        if said:
            self.blocks.append((*self.at, said))
        self.said = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.unseen += tag in self.UNSEEN
        if tag in self.BLOCKS:
            self.flush()
            self.at = (tag, dict(attrs).get("class") or "")

    def handle_endtag(self, tag: str) -> None:
        self.unseen = max(0, self.unseen - (tag in self.UNSEEN))
        if tag in self.BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.said.append(data)


def _leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for page, html in zip(frame["page_id"], frame["html"], strict=True):
            parser = _Leaves()
            parser.feed(html or "")
            parser.close()
            parser.flush()
            out += [(page, k, *block) for k, block in enumerate(parser.blocks)]
        yield pd.DataFrame(out, columns=["page_id", "pos", "tag", "class", "text"])


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, class, text) of leaf blocks."""
    return pages.select("page_id", "html").mapInPandas(_leaves, "page_id long, pos int, tag string, class string, text string")


#: Words of a roadworks heading.
STREET_WORDS = "straße|strasse|gasse|weg|platz|brücke|bruecke|allee|kai|ring|gürtel|guertel|kreuzung|bereich"


def roadworks(leaves: DataFrame) -> DataFrame:
    """(page_id, title, period, text): street headings with what follows up to the next heading; the first of equal titles."""
    heading = F.col("tag").isin("h1", "h2", "h3", "h4") & F.rlike(F.lower("text"), F.lit(STREET_WORDS))
    window = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = leaves.withColumn("block", F.sum(F.when(heading, 1).otherwise(0)).over(window)).where("block > 0")
    parts = F.array_sort(F.collect_list(F.when(~heading, F.struct("pos", "text"))))
    grouped = marked.groupBy("page_id", "block").agg(F.max(F.when(heading, F.col("text"))).alias("title"), F.transform(parts, lambda p: p["text"]).alias("parts"))
    dated = F.filter("parts", lambda p: F.rlike(p, F.lit(r"[0-9]{1,2}\.[0-9]{1,2}\.|derzeit")))
    rows = grouped.select("page_id", "block", "title", F.coalesce(F.try_element_at(dated, F.lit(1)), F.lit("")).alias("period"), F.array_join("parts", " ").alias("text"))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("page_id", F.lower("title")).orderBy("block"))).where("n = 1").drop("n", "block")


def crawl(links: DataFrame, start: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(url, depth): pages reached from start (url) over stored links (url, target), nearest first, in at most most_rounds rounds.

    The frontier is what the last round reached and nothing before it did; each
    round is checkpointed.
    """
    edges = links.select("url", "target").distinct()
    seen = start.select("url").distinct().withColumn("depth", F.lit(0)).checkpoint()
    frontier = seen
    for depth in range(1, most_rounds + 1):
        new = frontier.join(edges, "url").select(F.col("target").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if new.isEmpty():
            break
        seen, frontier = seen.union(new).checkpoint(), new
    return seen


def meeting_links(pages: DataFrame, most: int) -> DataFrame:
    """(url, number, date) of links to meetings, 'n. Gemeinderatssitzung ... d.m.yyyy', each address once, the newest most."""
    found = anchors(pages).where(F.rlike("label", F.lit(r"(?i)^[0-9]+\. *Gemeinderatssitzung")))
    rows = found.select(F.col("href").alias("url"), F.regexp_extract("label", r"^([0-9]+)", 1).cast("int").alias("number"), dates.from_german(F.col("label")).alias("date"))
    return rows.groupBy("url").agg(F.min("number").alias("number"), F.min("date").alias("date")).orderBy(F.col("date").desc(), "url").limit(most)


def crawl_within(pages: DataFrame, links: DataFrame, start: DataFrame, budget: int) -> DataFrame:
    """(place, url, depth, error): the first pages that a walk visits over stored links, in its order, no more than budget.

    pages has url and readable; links has url, pos and target; start has url and
    pos. Pages are visited breadth-first: by the place of the page that first
    links to them, then by the link's place on it. A page that isn't stored or
    can't be read counts as visited, with its error, and leads nowhere. Each
    round takes no more pages than the budget has left, of the whole frontier.
    """
    state = start.groupBy("url").agg(F.min("pos").alias("pos")).withColumn("parent", F.lit(0))
    seen, used, depth = None, 0, 0
    while used < budget:
        # At most what is left of the budget is numbered.
        first = state.orderBy("parent", "pos", "url").limit(budget - used)
        numbered = first.withColumn("place", F.row_number().over(Window.orderBy("parent", "pos", "url")) + used)
        known = numbered.join(pages.select("url", "readable"), "url", "left")
        error = F.when(F.col("readable").isNull(), "not stored").when(~F.col("readable"), "not readable")
        visited = stored(known.select(F.col("place").cast("int").alias("place"), "url", F.lit(depth).alias("depth"), error.alias("error")), "crawl")
        n = visited.count()
        if not n:
            break
        seen, used, depth = visited if seen is None else seen.union(visited), used + n, depth + 1
        found = visited.where("error IS NULL").join(links, "url").groupBy(F.col("target").alias("url")).agg(F.min(F.struct(F.col("place").alias("parent"), "pos")).alias("at"))
        state = found.join(seen.select("url"), "url", "left_anti").select("url", "at.pos", "at.parent")
    return seen if seen is not None else pages.sparkSession.createDataFrame([], "place int, url string, depth int, error string")

"""Decision pages: votes with notes, titles, attachments, tab entries."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import text

#: Lines of a decision note.
ORGAN = r"(?iu)^(Gemeinderat|Ausschuss\b.*)$"
ORGAN_DATE = r"(?iu)^(Gemeinderat|Ausschuss\b.+?)\s+am\s+([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})$"
DATE_LINE = r"(?iu)^am\s+([0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})$"
OUTCOME = r"(?iu)^(?:(einstimmig|mehrheitlich|mehrstimmig)?\s*(angenommen|abgelehnt|zugewiesen|vertagt))\.?$"
ANSWERED = r"(?iu)^(?:(?:wird|werden)\s+)?(?:mündlich|muendlich|schriftlich)?\s*beantwortet\.?$"
NOTED = r"(?iu)^zur\s+kenntnis\s+gebracht\.?$"
PARTIES = {"approval": "Zustimmung", "against": "Gegen|Dagegen|Gegenstimmen?", "abstention": "Enthaltung"}


def decision_votes(lines: DataFrame) -> DataFrame:
    """(source, line_no, organ, date, outcome, outcome_text, approval, against, abstention, notes) of lines (source, line_no, line).

    Organ and date carry on until the next; a vote's notes run up to the next
    outcome or organ, dates and the heading of the notes left out. Nothing counts
    from the line that names the clerk on.
    """
    by = Window.partitionBy("source").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    plain = lines.withColumn("line", text.squeeze(F.col("line"))).where("line <> ''")
    low = F.lower("line")
    ended = F.max(F.when(F.startswith(low, F.lit("schriftführer")), 1).otherwise(0)).over(by)
    rows = plain.withColumn("__ended", ended).where("__ended = 0").drop("__ended")
    organ = F.coalesce(*[F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in (ORGAN_DATE, ORGAN)])
    dated = F.coalesce(F.nullif(F.regexp_extract("line", ORGAN_DATE, 2), F.lit("")), F.nullif(F.regexp_extract("line", DATE_LINE, 1), F.lit("")))
    decided = F.nullif(F.regexp_extract(low, OUTCOME, 2), F.lit(""))
    how = F.regexp_extract(low, OUTCOME, 1)
    outcome = (
        F.when(decided == "angenommen", F.when(how == "einstimmig", "accepted_unanimous").when(how != "", "accepted_majority").otherwise("accepted"))
        .when(decided == "abgelehnt", F.when(how.isin("mehrheitlich", "mehrstimmig"), "rejected_majority").otherwise("rejected"))
        .when(decided == "zugewiesen", "assigned")
        .when(decided == "vertagt", "postponed")
        .when(F.rlike("line", F.lit(NOTED)), "noted")
        .when(F.rlike("line", F.lit(ANSWERED)), "source_available")
    )
    marked = rows.withColumns({"own_organ": organ, "own_date": dated, "outcome": outcome})
    marked = marked.withColumn("own_date", F.when(F.col("own_organ").isNotNull(), F.coalesce("own_date", F.lit(""))).otherwise(F.col("own_date")))
    breaks = F.col("outcome").isNotNull() | F.col("own_organ").isNotNull()
    marked = marked.withColumns(
        {
            "organ": F.coalesce(F.last("own_organ", ignorenulls=True).over(by), F.lit("")),
            "date": F.coalesce(F.last("own_date", ignorenulls=True).over(by), F.lit("")),
            "block": F.sum(F.when(breaks, 1).otherwise(0)).over(by),
        }
    )
    note = F.col("outcome").isNull() & F.col("own_organ").isNull() & F.col("own_date").isNull() & ~F.startswith(F.lower("line"), F.lit("anmerkungen zur abstimmung"))
    notes = F.transform(F.array_sort(F.collect_list(F.when(note, F.struct("line_no", "line")))), lambda x: x["line"])
    first = lambda c: F.min_by(c, F.when(F.col("outcome").isNotNull(), F.col("line_no")))
    votes = marked.groupBy("source", "block").agg(
        F.min(F.when(F.col("outcome").isNotNull(), F.col("line_no"))).alias("line_no"),
        first(F.when(F.col("outcome").isNotNull(), F.col("organ"))).alias("organ"),
        first(F.when(F.col("outcome").isNotNull(), F.col("date"))).alias("date"),
        F.max("outcome").alias("outcome"),
        F.max(F.when(F.col("outcome").isNotNull(), F.col("line"))).alias("outcome_text"),
        notes.alias("notes"),
    )

    def named(label: str):
        said = F.flatten(F.transform("notes", lambda n: F.regexp_extract_all(n, F.lit(rf"(?iu)\b(?:{label})\s*:\s*([^.;\n]+)"), F.lit(1))))
        parts = F.flatten(F.transform(said, lambda p: F.split(p, r",| und ")))
        return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")

    kept = votes.where("outcome IS NOT NULL")
    return kept.select("source", "line_no", "organ", "date", "outcome", "outcome_text", *[named(p).alias(c) for c, p in PARTIES.items()], "notes")


ATTACHMENT = r'(?is)<a\b([^>]*href="[^"]*document/attachment[^"]*"[^>]*)>(.*?)</a>'


def attachment_titles(pages: DataFrame) -> DataFrame:
    """(page_id, titles): titles or texts of attachment links, distinct but for case, in page order."""
    attributes = F.regexp_extract_all(text.text(F.col("html")), F.lit(ATTACHMENT), F.lit(1))
    inner = F.regexp_extract_all(text.text(F.col("html")), F.lit(ATTACHMENT), F.lit(2))

    def title(a, t):
        named = text.squeeze(F.regexp_extract(a, r'(?i)\btitle="([^"]*)"', 1))
        return F.when(named != "", named).otherwise(text.squeeze(F.regexp_replace(t, "<[^>]*>", " ")))

    found = F.filter(F.zip_with(attributes, inner, title), lambda t: t != "")
    return pages.select("page_id", text.first_distinct(found).alias("titles"))


#: What ends a title, what it skips, and what begins the text below it.
TITLE_STOPS = ("anlagen", "freigaben / unterschriften", "beschlussvermerk", "gemeinderat", "materialien")
METADATA = r"(?iu)^(betreff|datum|einlagezahl|geschäftszahl|gz|status|verfasser(in)?|dienststelle|sitzung|ausschuss)\s*:?$"
ROLE = r"(?iu)^(?:Berichterstatter(?:in|:in)?|Bearbeiter(?:in|:in)?|Einbringer(?:in|:in)?)\s*:?"
REFERENCE = r"^[A-Za-zÄÖÜäöüß]{1,16}-[0-9]{3,}/[0-9]{4}( [A-Za-zÄÖÜäöüß]{1,16}-[0-9]{3,}/[0-9]{4})*$"
BODY_START = r"(?iu)^(?:ausgangslage|der|die|das|frau|herr|ich|wir|es|gemäß|gemaess|seit|sehr\s+geehrte|am\s+vergangenen|kurz\s+vor)\b|[.!?]$"
TITLE_LINES, SNIPPET_BUDGET = 6, 900


def _after_date(lines: DataFrame) -> DataFrame:
    """The lines from the second after 'Datum' on, with their place from 1; those of a reference, a label or a role are marked."""
    plain = lines.withColumn("line", text.squeeze(F.col("line")))
    at = F.min(F.when(F.lower(F.regexp_replace("line", "^[ :]+|[ :]+$", "")) == "datum", F.col("place"))).over(Window.partitionBy("source"))
    placed = plain.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("line_no"))).withColumn("__at", at)
    rows = placed.where(F.col("place") >= F.col("__at") + 2).withColumn("place", F.col("place") - F.col("__at") - 1).drop("__at")
    key = F.lower(F.regexp_replace("line", "^[ :]+|[ :]+$", ""))
    return rows.withColumns(
        {
            "stop": key.isin(*TITLE_STOPS),
            "skip": F.rlike("line", F.lit(REFERENCE)) | F.rlike("line", F.lit(METADATA)) | F.rlike("line", F.lit(ROLE)),
            "body": F.rlike("line", F.lit(BODY_START)),
        }
    )


def subject_titles(lines: DataFrame) -> DataFrame:
    """(source, title, snippet) of decision pages' lines (source, line_no, line).

    The title is what stands after the date line and the one below it: up to six
    lines, references, labels and roles left out, up to a blank line, a closing
    label or the first line of the text. The snippet is the text behind it, up to a closing label
    and about 900 characters.
    """
    by = Window.partitionBy("source").orderBy("place")
    upto, before = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    rows = _after_date(lines)
    rows = rows.withColumn("closed", F.max(F.when(F.col("stop"), 1).otherwise(0)).over(upto)).where("closed = 0")
    useful = ~F.col("skip") & (F.col("line") != "")
    rows = rows.withColumn("seen", F.coalesce(F.max(F.when(useful, 1).otherwise(0)).over(before), F.lit(0)))
    ends = (F.col("line") == "") | (useful & F.when(F.col("seen") == 1, F.col("body")).otherwise(F.rlike("line", F.lit(BODY_START.removesuffix("|[.!?]$"))))) | (F.col("place") > TITLE_LINES)
    rows = rows.withColumn("ended", F.max(F.when(ends, 1).otherwise(0)).over(upto))
    said = rows.where(useful)
    used = F.coalesce(F.sum(F.when(F.col("ended") == 1, F.length("line") + 1).otherwise(0)).over(before), F.lit(0))
    said = said.withColumn("used", used)

    def joined(kept):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("place", "line")))), lambda x: x["line"]), " ")

    out = said.groupBy("source").agg(joined(F.col("ended") == 0).alias("title"), joined((F.col("ended") == 1) & (F.col("used") < SNIPPET_BUDGET)).alias("snippet"))
    return out.withColumn("snippet", text.clip_words(F.col("snippet"), 1100, " ..."))


class _Panel(HTMLParser):
    """Leaf blocks of the preview under one tab: (lines, link, bold code outside links)."""

    VOID = frozenset("br hr img input meta link".split())

    def __init__(self, tab: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tab, self.panel = tab.lower(), ""
        self.open: list[tuple[str, bool]] = []  # tag, whether the panel's preview begins here
        self.label: list[str] | None = None
        self.href = self.panel_of = ""
        self.inside = 0
        self.blocks: list[dict] = []
        self.block: dict | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag in self.VOID:
            if self.block is not None and tag == "br":
                self.block["text"].append("\n")
                self.block["after"].append("\n")
            return
        begins = bool(self.panel) and a.get("id") == self.panel and not self.inside
        self.inside += begins
        self.open.append((tag, begins))
        if tag == "a" and not self.inside:
            self.label, self.panel_of = [], a.get("aria-controls") or (a.get("href") or "").lstrip("#")
        if self.inside and tag in ("div", "p"):
            self.block = {"text": [], "href": "", "code": False, "after": []}  # an inner block makes the outer one no leaf
        if self.block is not None and tag == "a":
            self.block["href"] = self.block["href"] or a.get("href") or ""

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _ in self.open):
            return
        if tag == "a" and self.label is not None:
            if " ".join("".join(self.label).split()).lower() == self.tab and not self.panel:
                self.panel = self.panel_of
            self.label = None
        if tag in ("div", "p") and self.block is not None:
            self.blocks.append(self.block)
            self.block = None
        while True:
            t, begins = self.open.pop()
            self.inside -= begins
            if t == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.label is not None:
            self.label.append(data)
        if self.block is None:
            return
        self.block["text"].append(data)
        tags = [t for t, _ in self.open]
        if "b" in tags and "a" not in tags and data.strip() and data.strip().lower() != "einlagezahl":
            self.block["code"] = True
        if self.block["href"] and "a" not in tags:
            self.block["after"].append(data)


#: So many blocks at most are held before they are given on, however many pages a batch has.
BLOCKS_HELD = 20_000


def panel_blocks(pages: DataFrame, tab: str) -> DataFrame:
    """(page_id, pos, text, href, entry, primary, inline) of the leaf blocks under a tab of pages (page_id, html)."""
    names = ["page_id", "pos", "text", "href", "entry", "primary", "inline"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, html in zip(frame["page_id"], frame["html"], strict=True):
                panel = _Panel(tab)
                panel.feed(html or "")
                panel.close()
                for k, b in enumerate(panel.blocks):
                    said = " ".join("".join(b["text"]).split())
                    entry = "Einlagezahl" in said and "document" in b["href"]
                    if said:
                        out.append((page, k, said, b["href"], entry, entry and b["code"], " ".join("".join(b["after"]).split()) if entry else ""))
                    if len(out) == BLOCKS_HELD:
                        yield pd.DataFrame(out, columns=names)
                        out = []
            yield pd.DataFrame(out, columns=names)

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "html").mapInPandas(run, f"page_id {kind}, pos int, text string, href string, entry boolean, primary boolean, inline string")


def panel_entries(blocks: DataFrame) -> DataFrame:
    """(page_id, entry_no, href, kind, description): entries in order with the blocks that describe them.

    After 'Bezug zu Stück' everything is skipped up to the next entry with a code
    of its own. Entries without one below a heading of additional or amendment
    motions are of that kind.
    """
    by = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    low = F.lower("text")
    head = F.when(~F.col("entry") & F.startswith(low, F.lit("zusatzanträge")), "Zusatzantrag").when(~F.col("entry") & F.startswith(low, F.lit("abänderungsanträge")), "Abänderungsantrag")
    skips = ~F.col("entry") & F.startswith(low, F.lit("bezug zu stück"))
    mode = F.when(F.col("primary"), "").when(skips, "skip").otherwise(head)
    rows = blocks.withColumns({"__own": mode, "__head": head.isNotNull() | skips})
    # A heading of related motions doesn't end skipping; only an entry with a code does.
    skipping = F.last(F.when(F.col("primary"), False).when(F.col("__own") == "skip", True), ignorenulls=True).over(by)
    related = F.last("__own", ignorenulls=True).over(by)
    rows = rows.withColumns({"__skip": F.coalesce(skipping, F.lit(False)), "__mode": F.coalesce(related, F.lit(""))}).where("NOT __skip AND NOT __head")
    rows = rows.withColumn("entry_no", F.sum(F.when(F.col("entry"), 1).otherwise(0)).over(by)).where("entry_no > 0")
    said = F.when(F.col("entry"), F.when(F.col("__mode") != "", F.when(F.col("inline") != "", F.concat(F.lit("Betreff: "), "inline"))).otherwise(F.nullif("inline", F.lit("")))).otherwise(F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.when(said.isNotNull(), F.struct("pos", said.alias("said"))))), lambda x: x["said"])
    return rows.groupBy("page_id", "entry_no").agg(F.max(F.when(F.col("entry"), F.col("href"))).alias("href"), F.max(F.when(F.col("entry"), F.col("__mode"))).alias("kind"), F.array_join(parts, " | ").alias("description"))


#: Labels of people, in the order in which they count, with what is put before the name.
SUBMITTERS = (
    (("antragsteller:in(nen)", "antragsteller:innen", "antragsteller", "fragesteller:in", "fragesteller"), ""),
    (("berichterstatter:in", "berichterstatterin", "berichterstatter", "berichterstatter:innen"), "Berichterstatterin: "),
    (("bearbeiter:in", "bearbeiterin", "bearbeiter"), "Bearbeiterin: "),
    (("freigaben / unterschriften",), ""),
)
ADDRESSEES = ((("regierungsmitglied(er)", "regierungsmitglied", "adressat", "adressat:in", "adressat:innen"), ""),)


def labelled_people(lines: DataFrame, tiers: tuple[tuple[tuple[str, ...], str], ...]) -> DataFrame:
    """(source, person): the line below the first label of the first tier that has one.

    A line with a colon names nobody; a later tier doesn't stand in for it.
    """
    key = F.lower(F.regexp_replace(F.trim("line"), "^[ :]+|[ :]+$", ""))
    below = F.lead("line").over(Window.partitionBy("source").orderBy("line_no"))
    tier, before = F.lit(None).cast("int"), F.lit("")
    for k, (labels, prefix) in reversed(list(enumerate(tiers))):
        tier, before = F.when(key.isin(*labels), k).otherwise(tier), F.when(key.isin(*labels), prefix).otherwise(before)
    name = F.regexp_replace(text.squeeze(below), "^[ ,;]+|[ ,;]+$", "")
    named = F.when((name != "") & ~F.contains(name, F.lit(":")), F.concat(before, name)).otherwise("")
    found = lines.withColumns({"__tier": tier, "__named": named}).where("__tier IS NOT NULL")
    return found.groupBy("source").agg(F.min_by("__named", F.struct("__tier", "line_no")).alias("person"))


HEAD_LINES, CONTEXT_LINES = 14, 40


def document_types(lines: DataFrame) -> DataFrame:
    """(source, kind) of decision pages, by the words of their first lines and of what stands before the decision; '' if none says it."""
    placed = lines.withColumn("__n", F.row_number().over(Window.partitionBy("source").orderBy("line_no")))
    decided = F.min(F.when(F.lower("line") == "beschlussvermerk", F.col("__n"))).over(Window.partitionBy("source"))
    placed = placed.withColumn("__end", F.coalesce(decided, F.lit(CONTEXT_LINES + 1)))

    def joined(kept):
        return F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("__n", "line")))), lambda x: x["line"]), " "))

    n = F.col("__n")
    said = placed.groupBy("source").agg(joined(n <= HEAD_LINES).alias("head"), joined(n <= CONTEXT_LINES).alias("context"), joined(n < F.col("__end")).alias("before"))

    def has(column: str, pattern: str):
        return F.rlike(column, F.lit(pattern))

    around = F.concat_ws(" ", "head", "before")
    kind = (
        F.when(F.rlike(around, F.lit("abänderungsantrag|abaenderungsantrag")), "amendment_motion")
        .when(F.contains(around, F.lit("zusatzantrag")), "additional_motion")
        .when(has("head", "fragestunde|fragesteller") | has("context", r"(^|[^\p{L}])stellt\s+an\s+.+folgende\s+frage($|[^\p{L}])"), "question_hour")
        .when(has("head", "mitteilung an den gemeinderat|mitteilung von bürgermeister:in"), "communication")
        .when(has("head", "anfrage an bürgermeister:in"), "written_question")
        .when(has("head", "selbständiger antrag|selbstaendiger antrag"), "written_motion")
        .when(has("head", "dringlicher antrag"), "urgent_motion")
        .when(has("head", "bericht an den gemeinderat"), "agenda_item")
        .otherwise("")
    )
    return said.select("source", kind.alias("kind"))

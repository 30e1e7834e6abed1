"""Ordered rows into blocks, by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumlake.functions import extract, text

#: Headings that begin a section.
SECTIONS = {
    "mitteilungen": "Mitteilungen",
    "fragestunde": "Fragestunde",
    "tagesordnung": "Tagesordnung",
    "dringlichkeitsanträge": "Dringlichkeitsanträge",
    "dringlichkeitsantraege": "Dringlichkeitsanträge",
    "anfragen (schriftlich)": "Anfragen (schriftlich)",
    "anträge (schriftlich)": "Anträge (schriftlich)",
    "antraege (schriftlich)": "Anträge (schriftlich)",
}
AGENDA_ITEM = r"(?i)^(?:[0-9]+(?:\.[0-9]+)* +)?(?:Stk\.? *([0-9]+)\)|TO *([0-9]+) *:) *(.+)$"


def lines_of(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(source, line_no, line): numbered, non-blank, trimmed lines."""
    rows = texts.select(F.col(id_col).alias("source"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("line_no", "line"))
    return rows.withColumn("line", F.trim(F.regexp_replace("line", r"[ \t\r]+", " "))).where("line != ''")


def _before(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def carried(rows: DataFrame, value: Column, name: str, keys: list[str], order: str) -> DataFrame:
    """rows with the last non-null value up to each row."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(_before(keys, order)))


def numbered_blocks(rows: DataFrame, starts: Column, keys: list[str], order: str) -> DataFrame:
    """rows with block: how many starts there are up to each; rows before the first are left out."""
    return rows.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(_before(keys, order))).where("block > 0")


def numbered_chunks(lines: DataFrame) -> DataFrame:
    """(source, section, item_no, heading, body, block) of lines (source, line_no, line).

    A section heading carries on and closes the chunk before it; 'Stk. n)' and
    'TO n:' open a chunk whose following lines are its body. Lines with a tab and
    a page number at the end are entries of a contents list.
    """
    key = F.lower(F.regexp_replace(F.trim("line"), r"^[0-9]+(\.[0-9]+)* +", ""))
    section = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])[key]
    marked = lines.withColumn("own_section", section)
    marked = carried(marked, F.col("own_section"), "section", ["source"], "line_no")
    item = F.coalesce(F.nullif(F.regexp_extract("line", AGENDA_ITEM, 1), F.lit("")), F.nullif(F.regexp_extract("line", AGENDA_ITEM, 2), F.lit("")))
    marked = marked.withColumn("item", item).where(~F.rlike("line", F.lit("\t[0-9]{1,4}$")))
    opened = F.col("item").isNotNull() | F.col("own_section").isNotNull()
    blocks = numbered_blocks(marked, opened, ["source"], "line_no")
    parts = F.array_sort(F.collect_list(F.when(F.col("item").isNull(), F.struct("line_no", "line"))))
    chunks = blocks.where("own_section IS NULL").groupBy("source", "block").agg(
        F.max("section").alias("section"),
        F.max(F.col("item").cast("int")).alias("item_no"),
        F.max(F.when(F.col("item").isNotNull(), F.regexp_extract("line", AGENDA_ITEM, 3))).alias("heading"),
        F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("body"),
    )
    return chunks.where("item_no IS NOT NULL").select("source", F.coalesce("section", F.lit("")).alias("section"), "item_no", F.trim("heading").alias("heading"), "body", "block")


def agenda_chunks(lines: DataFrame) -> DataFrame:
    """The chunks of numbered_chunks without their order."""
    return numbered_chunks(lines).drop("block")


def parsed_records(lines: DataFrame) -> DataFrame:
    """(source, ordinal, section, item_no, title, numbers, amounts, status, body): chunks as records, the first of those with one section, number and title."""
    rows = numbered_chunks(lines).withColumn("title", extract.title_of(F.col("heading")))
    key = Window.partitionBy("source", "section", "item_no", F.lower("title")).orderBy("block")
    first = rows.withColumn("__n", F.row_number().over(key)).where("__n = 1")
    numbered = first.withColumn("ordinal", F.row_number().over(Window.partitionBy("source").orderBy("block")))
    found = extract.status_of(F.col("body"))
    return numbered.select(
        "source", "ordinal", "section", "item_no", "title", extract.business_numbers(F.col("heading")).alias("numbers"), extract.amounts_of_item(F.col("heading"), F.col("body")).alias("amounts"), found["status"].alias("status"), "body"
    )


def carried_reporter(lines: DataFrame) -> DataFrame:
    """Numbered agenda items with the reporter named before them: (source, line_no, item_no, title, reporter)."""
    named = F.nullif(F.regexp_extract("line", r"^Berichterstatter(?:in)? *: *(.+)$", 1), F.lit(""))
    marked = carried(lines, named, "reporter", ["source"], "line_no")
    item = F.regexp_extract("line", r"^([0-9]{1,3})[.)] +(.+)$", 1)
    return marked.where(item != "").select("source", "line_no", item.cast("int").alias("item_no"), F.regexp_extract("line", r"^([0-9]{1,3})[.)] +(.+)$", 2).alias("title"), F.coalesce("reporter", F.lit("")).alias("reporter"))


def labelled_values(lines: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(source, label, value): 'Label: value' lines; an empty value is the next line. The first non-empty one of each label."""
    following = F.lead("line").over(Window.partitionBy("source").orderBy("line_no"))
    pattern = rf"(?i)^({'|'.join(labels)}) *: *(.*)$"
    found = lines.withColumn("next", following).withColumn("label", F.lower(F.regexp_extract("line", pattern, 1))).where("label != ''")
    own = F.trim(F.regexp_extract("line", pattern, 2))
    values = found.withColumn("value", F.when(own != "", own).otherwise(F.coalesce("next", F.lit("")))).where("value != ''")
    return values.groupBy("source", "label").agg(F.min_by("value", "line_no").alias("value"))


def turns(rows: DataFrame, order: str = "turn") -> DataFrame:
    """Question and answer blocks of (conv_id, turn, role, text): a user turn opens one, the others until the next belong to it."""
    blocks = numbered_blocks(rows, F.col("role") == "user", ["conv_id"], order)
    said = F.array_sort(F.collect_list(F.when(F.col("role") != "user", F.struct(order, "text"))))
    return blocks.groupBy("conv_id", "block").agg(
        F.max(F.when(F.col("role") == "user", F.col("text"))).alias("question"),
        F.array_join(F.transform(said, lambda x: x["text"]), "\n").alias("answer"),
        F.count("*").alias("turns"),
    )


def followed(rows: DataFrame, hit: Column, detail: Column, keys: list[str], order: str, most: int = 3) -> DataFrame:
    """rows with part_of: the order of the hit whose run of at most `most` detail rows they continue, or their own."""
    window = _before(keys, order)
    at = F.last(F.when(hit, F.col(order)), ignorenulls=True).over(window)
    broken = F.last(F.when(~hit & ~detail, F.col(order)), ignorenulls=True).over(window)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    marked = rows.withColumns({"__at": at, "__broken": broken, "__place": place})
    hit_place = F.last(F.when(hit, F.col("__place")), ignorenulls=True).over(window)
    kept = marked.withColumn("__hit", hit_place).where(F.col("__at").isNotNull() & (F.col("__broken").isNull() | (F.col("__broken") < F.col("__at"))) & (F.col("__place") - F.col("__hit") <= most))
    return kept.withColumn("part_of", F.col("__at")).drop("__at", "__broken", "__place", "__hit")


def within_budget(rows: DataFrame, keys: list[str], order: str, size: Column, most: int) -> DataFrame:
    """The leading rows whose sizes before them add up to less than most."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__used", F.coalesce(F.sum(size).over(before), F.lit(0))).where(F.col("__used") < most).drop("__used")


#: Labels of an entry's metadata.
ENTRY_LABELS = (
    "antragsteller:in(nen)",
    "antragsteller:innen",
    "antragsteller:in",
    "antragsteller",
    "berichterstatter:innen",
    "berichterstatter:in",
    "berichterstatterin",
    "berichterstatter",
    "bearbeiter:in",
    "bearbeiterin",
    "bearbeiter",
    "regierungsmitglied(er)",
    "regierungsmitglied",
    "fragesteller:in",
    "fragesteller",
    "geschäftszahl(en)",
    "geschaeftszahl(en)",
    "dienststelle(n)",
    "dienststelle",
    "vorberatendes organ",
    "freigaben / unterschriften",
    "kompetenztatbestand",
    "erhöhte mehrheiten",
    "erhoehte mehrheiten",
    "einlagezahl",
    "materialien",
    "anlagen",
    "fraktion",
    "datum",
    "ez/oz",
    "betr",
    "betreff",
)
#: Lines that name what an entry is.
ENTRY_TYPE = (
    r"(?iu)^(?:Anfrage\s+an\s+Bürgermeister:in|Selbständiger\s+Antrag|Dringlicher\s+Antrag|Mitteilung\s+an\s+den\s+Gemeinderat|Mitteilung\s+von\s+Bürgermeister:in|"
    r"Bericht\s+an\s+den\s+Gemeinderat|Frage\s+für\s+die\s+Fragestunde|Fragestunde|Tagesordnungspunkt|Abänderungsantrag|Abaenderungsantrag|Zusatzantrag)\b"
)
#: What a label says, by how it begins.
ENTRY_FIELDS = {"betr": "title", "antragsteller": "submitter", "fragesteller": "submitter", "berichterstatter": "reporter", "bearbeiter": "editor", "regierungsmitglied": "addressee"}


def entry_metadata(lines: DataFrame) -> DataFrame:
    """(source, title, submitter, reporter, editor, addressee) of entries' lines (source, line_no, line).

    A label may stand alone, with its value on the next line that isn't blank,
    or before it. A subject goes on over all lines up to the next label or name
    of a type; of the others the first one with a value counts. Empty strings where
    there is none; every source with a line has a row.
    """
    plain = F.regexp_replace(text.squeeze(F.replace("line", F.lit("​"), F.lit(""))), "^[ ,]+|[ ,]+$", "")
    rows = lines.select("source", "line_no", plain.alias("line"))
    shown = rows.where("line <> ''")
    quoted = "|".join(label.replace("(", r"\(").replace(")", r"\)") for label in sorted(ENTRY_LABELS, key=len, reverse=True))
    pattern = rf"(?iu)^({quoted})(?::\s*(.*))?$"
    label = F.lower(F.regexp_extract("line", pattern, 1))
    head = (label != "") | F.rlike("line", F.lit(ENTRY_TYPE))
    window = Window.partitionBy("source").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = shown.withColumns({"head": head, "label": label}).withColumn("run", F.sum(F.when(F.col("head"), 1).otherwise(0)).over(window)).where("run > 0")
    named = F.max(F.when(F.col("head"), F.col("label")))
    own = F.max(F.when(F.col("head") & (F.col("label") != ""), F.trim(F.regexp_extract("line", pattern, 2))))
    rest = F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line")))), lambda x: x["line"])
    runs = marked.groupBy("source", "run").agg(named.alias("label"), F.coalesce(own, F.lit("")).alias("own"), rest.alias("rest"))
    field = F.lit(None).cast("string")
    for begin, name in ENTRY_FIELDS.items():
        field = F.when(F.startswith("label", F.lit(begin)), name).otherwise(field)
    said = F.when(F.col("field") == "title", F.array_join(F.filter(F.concat(F.array("own"), F.col("rest")), lambda x: x != ""), " ")).when(F.col("own") != "", F.col("own")).otherwise(F.coalesce(F.try_element_at("rest", F.lit(1)), F.lit("")))
    found = runs.withColumn("field", field).where("field IS NOT NULL").withColumn("said", F.regexp_replace(said, "^[ ,;]+|[ ,;]+$", "")).where("said <> ''")
    # A person's line that holds another label's colon is no person.
    found = found.where((F.col("field") == "title") | ~F.contains("said", F.lit(":")))
    values = found.groupBy("source").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == "title", F.struct("run", "said")))), lambda x: x["said"]), " ").alias("title"),
        *[F.min_by(F.when(F.col("field") == name, F.col("said")), F.when(F.col("field") == name, F.col("run"))).alias(name) for name in ("submitter", "reporter", "editor", "addressee")],
    )
    all_rows = rows.select("source").distinct().join(values, "source", "left")
    prefixed = {"reporter": "Berichterstatterin: ", "editor": "Bearbeiterin: "}
    return all_rows.select("source", *[F.coalesce(F.concat(F.lit(prefixed.get(c, "")), c), F.lit("")).alias(c) for c in ("title", "submitter", "reporter", "editor", "addressee")])

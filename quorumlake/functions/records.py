"""Guards, normalisation and wording of whole records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import compact_date, from_german
from .text import clip, squeeze, text

#: Result texts that say nothing.
EMPTY_RESULTS = ("unbekannt", "ergebnis fehlt", "kein ergebnis", "keine angabe")
#: Phrases of reasons that say nothing.
EMPTY_REASONS = (
    "kurze bezeichnung des themas",
    "kompakte beschreibung des gemeinsamen themas",
    "kompakt und beinhaltet den wesentlichen inhalt",
    "kompakte beschreibung des gemeinsamen inhalts",
    "kurze zusammenfassung der beiden themen",
    "gleiche geschäftszahl-basis",
    "gleiche geschaeftszahl-basis",
)


def meaningful_result(value: Column, empty: tuple[str, ...] = EMPTY_RESULTS) -> Column:
    """Whether a result text says something."""
    plain = F.lower(squeeze(value))
    return (plain != "") & ~plain.isin(*empty)


def meaningful_reason(value: Column) -> Column:
    """The reason, or empty where it is a stock phrase or up to three words on brevity."""
    plain = F.regexp_replace(F.lower(squeeze(value)), "^[ .]+|[ .]+$", "")
    stock = F.rlike(plain, F.lit("|".join(EMPTY_REASONS)))
    short = (F.size(F.split(plain, " +")) <= 3) & F.rlike(plain, F.lit("kurz|kompakt"))
    return F.when(stock | short, "").otherwise(F.trim(text(value)))


def complete_summary(summary: Column, easy: Column) -> Column:
    return (text(summary) != "") & (text(easy) != "")


def valid_heading(label: Column, confidence: Column) -> Column:
    """A proposed heading has up to 90 characters and nine words, and a confidence from 0 to 1."""
    plain = F.trim(text(label))
    sure = confidence.try_cast("double")
    return (plain != "") & (F.length(plain) <= 90) & (F.size(F.split(squeeze(plain), " ")) <= 9) & F.coalesce(sure.between(0, 1), F.lit(False))


def valid_summary(summary: Column, easy: Column) -> Column:
    """Both texts have 20 characters at least, and up to 2400 and 1800."""
    return F.length(F.trim(text(summary))).between(20, 2400) & F.length(F.trim(text(easy))).between(20, 1800)


#: Types that are assigned unless something else is said.
WRITTEN = ("written_question", "written_motion", "amendment_motion", "additional_motion")
ASSIGNED_TEXT, NOTED_TEXT = "Der geschäftsordnungsmäßigen Behandlung zugewiesen.", "Mitteilung ohne Beschluss."


def submission_status(kind: Column, status: Column, status_text: Column, raw: Column) -> Column:
    """struct(status, status_text, raw): unknown communications are noted, unknown written submissions assigned."""

    def said(value: Column, default: str) -> Column:
        return F.coalesce(F.nullif(text(value), F.lit("")), F.lit(default))

    def one(s: Column, t: Column, r: Column) -> Column:
        return F.struct(s.alias("status"), t.alias("status_text"), r.alias("raw"))

    unknown = status == "unknown"
    return (
        F.when(unknown & (kind == "communication"), one(F.lit("noted"), said(status_text, "zur Kenntnis genommen"), said(raw, NOTED_TEXT)))
        .when(unknown & kind.isin(*WRITTEN), one(F.lit("assigned"), said(status_text, "zugewiesen"), said(raw, ASSIGNED_TEXT)))
        .otherwise(one(text(status), text(status_text), text(raw)))
    )


def normalised(records: DataFrame, empty: tuple[str, ...] = ("", "Unbekannt", "Ergebnis fehlt")) -> DataFrame:
    """records (kind, status, status_text, raw_result, result, votes) with submission_status; what changed gets a result and a vote if it has none.

    votes are structs of (subject, outcome, raw_text).
    """
    rows = records.withColumn("__s", submission_status(F.col("kind"), F.col("status"), F.col("status_text"), F.col("raw_result")))
    changed = F.col("__s.status") != text(F.col("status"))
    vote = F.array(F.struct(F.lit("procedure").alias("subject"), F.lit("assigned").alias("outcome"), F.col("__s.raw").alias("raw_text")))
    return rows.withColumns(
        {
            "result": F.when(changed & text(F.col("result")).isin(*empty), "Verfahren: zugewiesen").otherwise(F.col("result")),
            "votes": F.when(changed & (F.coalesce(F.size("votes"), F.lit(0)) <= 0), vote).otherwise(F.col("votes")),
            "raw_result": F.when(changed, F.col("__s.raw")).otherwise(F.col("raw_result")),
            "status_text": F.when(changed, F.col("__s.status_text")).otherwise(F.col("status_text")),
            "status": F.col("__s.status"),
        }
    ).drop("__s")


def date_in(value: Column, latest: int = 26) -> Column:
    """d.m.yyyy, else the first six digits in a row that make a date: yymmdd at the start or up to the year latest, or ddmmyy."""
    plain = text(value)
    written = F.regexp_extract(plain, r"\b[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\b", 0)

    def read(m: Column, i: Column) -> Column:
        a, b, c = (F.substring(m, k, 2) for k in (1, 3, 5))
        forth, back = compact_date(a, b, c), compact_date(c, b, a)
        first = (i == 0) & F.startswith(plain, m)
        return F.when((forth != "") & (first | (a.cast("int") <= latest)), forth).otherwise(back)

    runs = F.filter(F.regexp_extract_all(plain, F.lit("[0-9]+"), F.lit(0)), lambda m: F.length(m) == 6)
    found = F.filter(F.transform(runs, read), lambda d: d != "")
    return F.when(written != "", from_german(written)).otherwise(F.coalesce(F.try_element_at(found, F.lit(1)), F.lit("")))


def asset_date(label: Column, url: Column, around: Column, fallback: Column) -> Column:
    """The date in a file's label, name or surroundings, else the fallback."""
    name = F.regexp_extract(F.regexp_replace(text(url), r"\?.*$", ""), "([^/]*)$", 1)
    return F.coalesce(*[F.nullif(date_in(x), F.lit("")) for x in (label, name, around)], fallback)


def navigation_label(label: Column, url: Column) -> Column:
    """Whether an anchor only leads around a site: bare numbers and years, contact, overviews, pager links that are no files."""
    plain = F.lower(squeeze(label))
    named = plain.isin("kontakt", "feedback an autor", "archiv/nachlese übersicht", "archiv/nachlese uebersicht")
    path = F.lower(F.regexp_replace(text(url), r"\?.*$", ""))
    pager = F.contains(text(url), F.lit("cms_nearest")) & ~F.rlike(path, F.lit(r"\.(pdf|doc|docx)$"))
    return F.rlike(plain, F.lit(r"^(?:(?:alt\s*\+\s*)?[0-9]+|20[0-9]{2})$")) | named | pager


def yearly_label(label: Column) -> Column:
    return F.rlike(F.trim(F.lower(text(label))), F.lit(r"^(?:gr-sitzungen\s+)?20[0-9]{2}(?:\s*\(.*\))?$"))


def meeting_label(label: Column) -> Column:
    return F.rlike(text(label), F.lit(r"\b[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}\b")) | F.contains(F.lower(text(label)), F.lit("gemeinderatssitzung"))


def chosen_types(kinds: str) -> list[str]:
    """Types named in a comma-separated list."""
    return [k.strip() for k in kinds.split(",") if k.strip()]


#: States of a proposed point.
POINT_STATES = ("beschlossen", "abgelehnt", "zugewiesen", "beantragt", "gefragt", "mitgeteilt", "offen", "nicht_erfasst")
POINT = "array<struct<kind:string,text:string,simple:string,status:string>>"
MOST_POINTS = 12


def json_in(value: Column, schema: str) -> Column:
    """The object between the first and the last brace of a text."""
    return F.from_json(F.regexp_extract(text(value), r"(?s)\{.*\}", 0), schema)


def key_points(points: Column, fallback: Column) -> Column:
    """Of the first MOST_POINTS points those with a text, squeezed, with a known status; the fallback if there are none."""

    def one(p: Column) -> Column:
        state = F.replace(F.lower(squeeze(p["status"])), F.lit("-"), F.lit("_"))
        kind = F.coalesce(F.nullif(squeeze(p["kind"]), F.lit("")), F.lit("Kernpunkt"))
        return F.struct(kind.alias("kind"), squeeze(p["text"]).alias("text"), squeeze(p["simple"]).alias("simple"), F.when(state.isin(*POINT_STATES), state).otherwise("offen").alias("status"))

    kept = F.filter(F.transform(F.slice(points, 1, MOST_POINTS), one), lambda p: p["text"] != "")
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(fallback)


def text_list(values: Column, fallback: Column) -> Column:
    """The first MOST_POINTS non-blank texts, squeezed; the fallback if there are none."""
    kept = F.slice(F.filter(F.transform(values, squeeze), lambda v: v != ""), 1, MOST_POINTS)
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(fallback)


#: What a question is not.
NO_ANSWER = (
    "Wenn in den lokalen Daten keine Antwort steht, heißt das nur: In dieser Datenbasis ist keine Antwort erfasst. Es darf daraus nicht geschlossen werden, dass es keine Antwort gab."
)


def source_role(kind: Column, submitter: Column, addressee: Column) -> Column:
    """A sentence on what a record is, by its type; empty for others."""
    by, to = F.trim(text(submitter)), F.trim(text(addressee))
    person = F.when(by != "", by).otherwise("eine Person bzw. Fraktion im Gemeinderat")

    def asked(how: str, end: str, without: str) -> Column:
        return F.when(to != "", F.concat(person, F.lit(f" {how} "), to, F.lit(f". {end} {NO_ANSWER}"))).otherwise(F.concat(person, F.lit(f" {without} {end} {NO_ANSWER}")))

    told = F.lit("Die Stadt bzw. die zuständige Stelle teilte dazu etwas mit")
    return (
        F.when(kind == "written_motion", F.concat(person, F.lit(" stellte dazu einen selbständigen Antrag.")))
        .when(kind == "urgent_motion", F.concat(person, F.lit(" stellte dazu einen Dringlichkeitsantrag.")))
        .when(kind == "amendment_motion", F.concat(person, F.lit(" brachte dazu einen Abänderungsantrag ein.")))
        .when(kind == "additional_motion", F.concat(person, F.lit(" brachte dazu einen Zusatzantrag ein.")))
        .when(kind == "written_question", asked("stellte dazu eine schriftliche Frage an", "Das ist eine Anfrage und kein Beschluss.", "stellte dazu eine schriftliche Frage."))
        .when(kind == "question_hour", asked("fragte dazu in der Fragestunde", "Das ist eine Frage und kein Beschluss.", "stellte dazu in der Fragestunde eine Frage."))
        .when(
            kind == "communication",
            F.concat(told, F.when(by != "", F.concat(F.lit("; als Bearbeitung/Einbringung ist "), by, F.lit(" erfasst"))).otherwise(""), F.lit(". Das ist eine Mitteilung, nicht automatisch ein Beschluss.")),
        )
        .when(
            kind == "archive_agenda_item",
            "Dieser Treffer stammt aus einer Tagesordnung in einem Archiv-PDF. Er belegt, dass das Stück auf der Tagesordnung stand; ein Beschluss oder Ergebnis muss aus Protokoll oder Folgebeschlüssen belegt werden.",
        )
        .otherwise("")
    )


def short_role(role: Column) -> Column:
    """The role in a few words."""

    def has(words: str) -> Column:
        return F.contains(role, F.lit(words))

    return (
        F.when(has("selbständigen Antrag"), "Schriftlicher Antrag.")
        .when(has("Dringlichkeitsantrag"), "Dringlichkeitsantrag.")
        .when(has("schriftliche Frage"), "Das ist eine schriftliche Anfrage und kein Beschluss.")
        .when(has("Fragestunde"), "Das ist eine Frage in der Fragestunde und kein Beschluss.")
        .when(has("teilte dazu"), "Das ist eine Mitteilung.")
        .when(has("Archiv-PDF"), "Das belegt die Behandlung im Archiv, aber nicht automatisch einen Beschluss.")
        .otherwise(clip(role, 180))
    )


def source_group(priority: Column, label: Column, role: Column) -> Column:
    """decided, rejected, open or treated, by a source's decision and role."""
    said, named = F.lower(text(role)), F.lower(text(label))
    return (
        F.when(priority == 0, "decided")
        .when((priority == 2) | F.rlike(named, F.lit("abgelehnt|nicht beschlossen")), "rejected")
        .when(F.rlike(said, F.lit("stellte dazu|brachte dazu|fragte dazu|schriftliche frage|fragestunde")), "open")
        .when((priority == 1) | F.contains(said, F.lit("teilte dazu")), "treated")
        .otherwise("open")
    )


def source_facts(kind: Column, date: Column, label: Column, numbers: Column, places: Column) -> Column:
    """Up to six facts of a source: type, date, decision, file numbers and places."""
    gz, at = F.array_join(numbers, ", "), F.array_join(places, ", ")
    facts = F.array(kind, date, label, F.when(gz != "", F.concat(F.lit("GZ "), clip(gz, 46))), F.when(at != "", F.concat(F.lit("Orte "), clip(at, 70))))
    return F.slice(F.filter(facts, lambda f: text(f) != ""), 1, 6)


def pending(kind: Column, date: Column, today: Column) -> Column:
    """Whether an urgent motion or agenda item lies ahead, so that it has no result yet."""
    return kind.isin("urgent_motion", "agenda_item") & F.rlike(text(date), F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")) & (date > today)


def with_pending(records: DataFrame, today: Column) -> DataFrame:
    """records (kind, date, status, result, raw_result, votes) with those that lie ahead pending, their votes cleared."""
    ahead = pending(F.col("kind"), F.col("date"), today)
    rows = records.withColumn("__ahead", ahead)
    kind = dict(records.dtypes)["votes"]
    return rows.withColumns(
        {
            "raw_result": F.when(F.col("__ahead"), F.coalesce(F.nullif("raw_result", F.lit("")), "result")).otherwise(F.col("raw_result")),
            "status": F.when(F.col("__ahead"), "pending").otherwise(F.col("status")),
            "result": F.when(F.col("__ahead"), "ausstehend").otherwise(F.col("result")),
            "votes": F.when(F.col("__ahead"), F.array().cast(kind)).otherwise(F.col("votes")),
        }
    ).drop("__ahead")


#: What a question's words bring with them.
EXPANSIONS = (
    (("anrainer|anwohner|bewohner", "park"), ("anwohnerparkzone", "anrainerparkplatz", "anrainerparken", "parkzone", "gruenzone", "gruene", "blaue", "zone")),
    (("gruen|gruene|parkzone|park",), ("parkraumbewirtschaftung", "bewohnerparken", "parkraum")),
    (("amt|aemter|service|melde|hauptwohnsitz|pass|reisepass|termin|formular",), ("buergerinnenamt", "buergeramt", "meldewesen", "dokumente", "digitales amt", "service")),
    (("muell|abfall|wasser|kanal|bim|bus",), ("kommunale services", "abfall", "wasser", "oeffentlicher verkehr")),
)
#: Words that no question is about.
QUESTION_STOPWORDS = (
    "also alles angenommen annahme antrag antraege anträge auch bezirk bezirke beschluss beschluesse beschlüsse beschlossen dann dass dazu deine dringlich dringliche "
    "einen einer eine einstimmig ergebnis erzaehl erzähle frage fragen gemeinderat gemacht gibt hier info infos kann kurz mehr mehrheitlich nicht oder sage sag sich "
    "sind status tagesordnungspunkt ueber über und warum wenn werden wird wurde wurden wieso zum"
).split()


def question_words(query: Column, expansions: tuple = EXPANSIONS) -> Column:
    """Distinct words of four characters or more, no stopwords, and what they bring with them."""
    words = F.filter(F.split(F.trim(F.regexp_replace(text(query), r"[^\p{L}\p{N}-]+", " ")), " "), lambda w: (F.length(w) >= 4) & ~w.isin(*QUESTION_STOPWORDS))
    joined = F.array_join(words, " ")
    none = F.array().cast("array<string>")
    more = [F.when(_all(joined, patterns), F.array(*map(F.lit, added))).otherwise(none) for patterns, added in expansions]
    return F.array_distinct(F.concat(words, *more))


def _all(value: Column, patterns: tuple[str, ...]) -> Column:
    held = F.lit(True)
    for p in patterns:
        held = held & F.rlike(value, F.lit(p))
    return held

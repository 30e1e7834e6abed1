"""Entities in agenda texts: file numbers, amounts, places, people, results and votes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_distinct, squeeze, text
from .text import fold as lower_folded

#: Patterns of file numbers, amounts and places.
BUSINESS_NUMBER = r"(?iu)\b(?:Präs\.?|Praes\.?|AB|A *[0-9]+(?: */ *[0-9]+)?) *(?:[-–] *)?[0-9]{3,}(?: */ *[0-9]{1,4}){0,3}(?: *[-–] *[0-9]{1,4}(?! *\.))?"
AMOUNT = r"€ *[0-9][0-9. ]*(?:, *(?:[0-9]{1,2}|-+))?"
AMOUNT_SCOPE = r"(?iu)(?:folgender\s+(?:Antrag|Anfrage)\s+gestellt|Der\s+Gemeinderat\s+wolle\s+beschließen)"
STREET = r"(?iu)[\p{L}\p{N}_.-]+(?:straße|strasse|gasse|weg|platz|park|brücke|bruecke|allee|kai|ufer|ring|gürtel|guertel|graben|lände|laende|steig|steg|zeile)\b"
PLACES = (
    ("street", STREET),
    ("place", r"(?iu)[\p{L}\p{N}_.-]+platz\b"),
    ("park", r"(?iu)[\p{L}\p{N}_.-]+park\b"),
    ("bridge", r"(?iu)[\p{L}\p{N}_.-]+(?:brücke|bruecke)\b"),
    ("cadastral_municipality", r"(?iu)\bKG +[\p{L}][\p{L}\p{N}_.-]+"),
    ("land_register", r"(?iu)\bEZ +[0-9]+"),
    ("parcel", r"(?iu)\bGdst\.? *Nr\.? *[0-9/]+"),
)
NOT_PUBLIC = ("parcel", "land_register", "cadastral_municipality")
#: Words that only look like places.
NOT_PLACES = (
    "arbeitsweg carsharing fluchtweg fussweg fußweg gehsteig gehweg heimweg hinweg radweg rueckweg rückweg schlichtweg schulweg schutzweg umlaufweg umweg vorweg"
).split()
#: Status by the first phrase that occurs, the last three as whole words.
STATUSES = (
    ("assigned", "geschäftsordnungsmäßigen Behandlung zugewiesen"),
    ("noted", "zur Kenntnis (?:genommen|gebracht)"),
    ("accepted_unanimous", "einstimmig angenommen"),
    ("accepted_majority", "mehr(?:heitlich|stimmig) angenommen"),
    ("rejected_majority", "mehr(?:heitlich|stimmig) abgelehnt"),
    ("accepted", "angenommen"),
    ("rejected", "abgelehnt"),
    ("postponed", "vertagt"),
)


WHOLE_WORDS = ("accepted", "rejected", "postponed")


def phrase(status: str) -> str:
    """The pattern of a status; its first group is what is said."""
    said = dict(STATUSES)[status]
    return rf"(?iu)(?:^|[^\p{{L}}\p{{N}}_])({said})(?:$|[^\p{{L}}\p{{N}}_])" if status in WHOLE_WORDS else f"(?iu)({said})"


def all_of(value: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text(value), F.lit(pattern), F.lit(0))


def business_numbers(value: Column) -> Column:
    """Distinct file numbers, without blanks around slashes and dashes."""

    def plain(n: Column) -> Column:
        n = F.regexp_replace(F.regexp_replace(squeeze(n), " */ *", "/"), " *[-–] *", "-")
        return F.regexp_replace(n, r"(?iu)^(praes|präs)\.?", "Präs.")

    return first_distinct(F.transform(all_of(value, BUSINESS_NUMBER), plain))


def base_number(number: Column) -> Column:
    """Without the last /n or /n-m."""
    return F.regexp_replace(number, r"/[0-9]+(-[0-9]+)?$", "")


def lines_before(body: Column, patterns: tuple[str, ...]) -> Column:
    """The lines of a body before the first that has one of the patterns."""
    lines = F.split(text(body), "\n")
    at = F.array_position(F.transform(lines, lambda x: reduce(lambda a, p: a | F.rlike(x, F.lit(p)), patterns[1:], F.rlike(x, F.lit(patterns[0])))), True)
    return F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines)


def amounts(value: Column) -> Column:
    """Distinct amounts as '€ 1.000,-'."""

    def plain(a: Column) -> Column:
        return F.regexp_replace(F.replace(squeeze(a), F.lit(" ,"), F.lit(",")), ", *-+", ",-")

    return first_distinct(F.transform(all_of(value, AMOUNT), plain))


def amounts_of_item(heading: Column, body: Column) -> Column:
    """Amounts of a heading and of what is applied for: the body from the words that open an application up to its result."""
    lines = lines_before(body, (FORMAL_RESULT,))
    at = F.array_position(F.transform(lines, lambda x: F.rlike(x, F.lit(AMOUNT_SCOPE))), True)
    applied = F.when(at > 0, F.slice(lines, at.cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>"))
    return amounts(F.array_join(F.concat(F.array(text(heading)), applied), "\n"))


#: Characters after which no further line is searched for places.
PLACE_BUDGET = 1600


def place_text(heading: Column, body: Column) -> Column:
    """Heading and body lines up to the first with a result or a status, until their length reaches PLACE_BUDGET."""
    lines = lines_before(body, (FORMAL_RESULT, *(phrase(name) for name, _ in STATUSES)))
    none = F.array().cast("array<string>")
    start = F.struct(F.length(text(heading)).alias("n"), none.alias("kept"))

    def step(held: Column, line: Column) -> Column:
        room = F.size(held["kept"]) == 0
        fits = room | (held["n"] < PLACE_BUDGET)
        return F.struct(F.when(fits, held["n"] + F.length(line)).otherwise(held["n"]).alias("n"), F.when(fits, F.concat(held["kept"], F.array(line))).otherwise(held["kept"]).alias("kept"))

    kept = F.aggregate(lines, start, step, lambda held: held["kept"])
    return F.array_join(F.concat(F.array(text(heading)), kept), "\n")


def amount_value(amount: Column) -> Column:
    """An amount as a decimal."""
    plain = F.regexp_replace(F.regexp_replace(amount, r"[€ .]", ""), ",-+$", "")
    return F.replace(plain, F.lit(","), F.lit(".")).try_cast("decimal(18,2)")


def places(value: Column, around: int = 80) -> Column:
    """array<struct(type, value, context, confidence)>: public places with their surroundings, words that only look like places left out."""

    def side(plain: Column, kind: str, pattern: str) -> Column:
        found = F.filter(first_distinct(all_of(plain, pattern)), lambda p: ~F.lower(p).isin(*NOT_PLACES))

        def entry(p: Column) -> Column:
            at = F.position(p, plain)
            begin = F.greatest(at - around, F.lit(1))
            return F.struct(F.lit(kind).alias("type"), p.alias("value"), F.trim(F.substring(plain, begin, at - begin + F.length(p) + around)).alias("context"), F.lit(0.75).alias("confidence"))

        return F.transform(found, entry)

    # As an element of an array the text is worked out once, not for each kind and place.
    sides = lambda plain: F.concat(*[side(plain, kind, pattern) for kind, pattern in PLACES if kind not in NOT_PUBLIC])
    return F.transform(F.array(squeeze(value)), sides)[0]


def status_of(value: Column) -> Column:
    """struct(status, status_text) of the first phrase in order; unknown without any."""
    plain = text(value)
    found = F.struct(F.lit("unknown").alias("status"), F.lit("").alias("status_text"))
    for name, _ in reversed(STATUSES):
        said = F.regexp_extract(plain, phrase(name), 1)
        found = F.when(said != "", F.struct(F.lit(name).alias("status"), said.alias("status_text"))).otherwise(found)
    return found


def title_of(heading: Column) -> Column:
    """A heading without file numbers and reporters."""
    plain = F.regexp_replace(text(heading), BUSINESS_NUMBER, " ")
    plain = F.regexp_replace(plain, r"\((?:Berichterstatter(?:in)?|GR|KlObm|KlObf)[^)]+\)", " ")
    plain = F.regexp_replace(plain, r"^ *[-–,;] *", "")
    return F.regexp_replace(squeeze(plain), "^[ ,;]+|[ ,;]+$", "")


def submitter_of(value: Column) -> Column:
    """'role: name' of a reporter in brackets, else the author of a motion; empty if neither is named."""
    reporter = r"\((Berichterstatter(?:in)?|GR|KlObm|KlObf) *:? *([^)]+)\)"
    author = r"(?i)((?:GR(?:in)?\.?|Gemeinderätin|Gemeinderat|KlObm|KlObf)[^:\n]{2,120}?) +stellt +(?:folgenden|folgende|den) +(?:dringlichen +)?(?:Antrag|Anfrage)"

    def name(x: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(squeeze(x), "^[ .,:;]+|[ .,:;]+$", ""), "(?i)^(Frau|Herr) +", "")

    role = F.regexp_extract(text(value), reporter, 1)
    return F.when(role != "", F.concat(role, F.lit(": "), name(F.regexp_extract(text(value), reporter, 2)))).otherwise(name(F.regexp_extract(text(value), author, 1)))


#: What a result can be about.
SUBJECTS = (("Abänderungsantrag", "amendment"), ("Abaenderungsantrag", "amendment"), ("Zusatzantrag", "additional_motion"), ("Tagesordnungspunkt", "agenda_item"), ("Antrag", "motion"))
FORMAL_RESULT = (
    r"(?iu)(?:Der\s+(?:Antrag|Abänderungsantrag|Abaenderungsantrag|Zusatzantrag|Tagesordnungspunkt)[^.\n]{0,240}?\b(?:angenommen|abgelehnt|zugewiesen|vertagt)"
    r"(?:\s*\((?:Gegen|Dagegen|Zustimmung|Enthaltung)\s*:?\s*[^)]{1,220}\))?\.?|Der\s+geschäftsordnungsmäßigen\s+Behandlung\s+zugewiesen\.?)"
)


def results(value: Column) -> Column:
    """Distinct formal result sentences."""
    return F.array_distinct(F.transform(all_of(value, FORMAL_RESULT), squeeze))


def parties(value: Column, label: str) -> Column:
    """Party names after a label in brackets."""
    named = F.regexp_extract(text(value), rf"(?i)\((?:{label}) *:? *([^)]+)\)", 1)
    return F.filter(F.transform(F.split(named, r",| und "), lambda p: F.trim(p)), lambda p: p != "")


def vote_of(result: Column) -> Column:
    """struct(subject, outcome, approval, against, abstention, raw_text) of one result sentence."""
    subject = F.coalesce(*[F.when(F.contains(result, F.lit(word)), F.lit(code)) for word, code in SUBJECTS], F.lit("procedure"))
    outcome = status_of(F.regexp_replace(result, "zugewiesen", "geschäftsordnungsmäßigen Behandlung zugewiesen"))["status"]
    return F.struct(
        subject.alias("subject"),
        outcome.alias("outcome"),
        parties(result, "Zustimmung").alias("approval"),
        parties(result, "Gegen|Dagegen|Gegenstimmen?").alias("against"),
        parties(result, "Enthaltung").alias("abstention"),
        result.alias("raw_text"),
    )


def collapsed(found: Column, status: Column) -> Column:
    """Votes of which a later one on the same subject replaces an earlier one that contradicts the status or says less."""

    def fits(v: Column) -> Column:
        o = v["outcome"]
        side = F.when(F.startswith(status, F.lit("accepted")), "accepted").when(F.startswith(status, F.lit("rejected")), "rejected")
        return F.when(side.isNotNull(), F.startswith(o, side)).otherwise(o == status)

    def generic(v: Column) -> Column:
        return v["outcome"].isin("accepted", "rejected")

    def specific(v: Column) -> Column:
        return v["outcome"].isin("accepted_unanimous", "accepted_majority", "rejected_majority") | (F.size(v["against"]) > 0) | (F.size(v["approval"]) > 0)

    def step(held: Column, v: Column) -> Column:
        from_end = F.array_position(F.reverse(F.transform(held, lambda x: x["subject"])), v["subject"])
        at = (F.size(held) - from_end + 1).cast("int")
        old = F.try_element_at(held, at)
        replaced = F.concat(F.slice(held, F.lit(1), at - 1), F.array(v), F.slice(held, at + 1, F.size(held)))
        return (
            F.when(from_end == 0, F.concat(held, F.array(v)))
            .when(fits(v) & ~fits(old), replaced)
            .when(generic(old) & specific(v), replaced)
            .when(generic(v) & specific(old), held)
            .otherwise(F.concat(held, F.array(v)))
        )

    return F.aggregate(F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), F.slice(found, F.lit(1), F.lit(1)), step)


def votes(value: Column) -> Column:
    """Votes of all formal results, contradictions with the text's status settled."""
    found = F.transform(results(value), vote_of)
    return F.when(F.size(found) < 2, found).otherwise(collapsed(found, status_of(value)["status"]))


def status_of_votes(found: Column) -> Column:
    """One status for several votes: accepted wins over rejected; majority over plain, unanimous only if all are."""

    def any_of(*names: str) -> Column:
        return F.exists(found, lambda v: v["outcome"].isin(*names))

    return (
        F.when(F.size(found) == 0, "unknown")
        .when(any_of("accepted_majority"), "accepted_majority")
        .when(F.forall(found, lambda v: v["outcome"] == "accepted_unanimous"), "accepted_unanimous")
        .when(any_of("accepted", "accepted_unanimous"), "accepted")
        .when(any_of("rejected_majority"), "rejected_majority")
        .when(any_of("rejected"), "rejected")
        .otherwise(F.try_element_at(found, F.lit(1))["outcome"])
    )


#: Labels of vote subjects and outcomes.
SUBJECT_LABELS = {"motion": "Antrag", "amendment": "Abänderungsantrag", "additional_motion": "Zusatzantrag", "agenda_item": "Tagesordnungspunkt", "procedure": "Verfahren"}
OUTCOME_LABELS = {
    "accepted_unanimous": "einstimmig angenommen",
    "accepted_majority": "mehrheitlich angenommen",
    "accepted": "angenommen",
    "noted": "zur Kenntnis genommen",
    "rejected_majority": "mehrheitlich abgelehnt",
    "rejected": "abgelehnt",
    "source_available": "Quelle verfügbar",
    "assigned": "zugewiesen",
    "postponed": "vertagt",
    "pending": "ausstehend",
    "unknown": "unbekannt",
}


def label(code: Column, labels: dict[str, str]) -> Column:
    """The label of a code, or the code itself."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[code], code)


def votes_text(found: Column) -> Column:
    """Readable lines, one per vote."""

    def line(v: Column) -> Column:
        named = [
            F.when(F.size(v[side]) > 0, F.concat(F.lit(f"{word}: "), F.array_join(v[side], ", ")))
            for side, word in (("approval", "Zustimmung"), ("against", "Gegen"), ("abstention", "Enthaltung"))
        ]
        sides = F.concat_ws("; ", *named)
        said = F.concat(label(v["subject"], SUBJECT_LABELS), F.lit(": "), label(v["outcome"], OUTCOME_LABELS))
        return F.when(sides != "", F.concat(said, F.lit(" ("), sides, F.lit(")"))).otherwise(said)

    return F.array_join(F.transform(found, line), "\n")


def confidence(*points: tuple[Column, float], base: float = 0.45) -> Column:
    """base plus the points whose condition holds, at most 1."""
    return F.round(F.least(reduce(lambda a, p: a + F.when(p[0], p[1]).otherwise(0.0), points, F.lit(base)), F.lit(1.0)), 4)


def inferred_places(stored: Column, details: Column, context: Column, near: Column, names: tuple[str, ...] = ()) -> Column:
    """Stored places and those that the text near a record names, distinct but for case.

    Four places or more that come from a long text (context characters, 1800 or
    more) or with four details or more are trusted only where the near text has them.
    names are districts and the like that count where they stand as words.
    """
    plain = lower_folded(near)

    def said(p: Column) -> Column:
        return F.contains(F.regexp_replace(F.concat(F.lit(" "), plain, F.lit(" ")), r"[^\p{L}\p{N}_]+", " "), F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_folded(p), r"[^\p{L}\p{N}_]+", " ")), F.lit(" ")))

    broad = (F.size(stored) >= 4) & ((details >= 4) | (context >= 1800))
    kept = F.when(broad, F.filter(stored, said)).otherwise(stored)
    found = F.transform(F.filter(places(near), lambda p: p["type"] == "street"), lambda p: p["value"])
    named = F.filter(F.array(*map(F.lit, names)), said) if names else F.array().cast("array<string>")
    return first_distinct(F.concat(kept, found, named))


def question_confidence(question: Column, answer: Column, follow_up: Column) -> Column:
    return confidence((text(question) != "", 0.25), (text(answer) != "", 0.2), (text(follow_up) != "", 0.1))


def motion_confidence(title: Column, submitter: Column, head: Column) -> Column:
    """head holds the first twelve lines."""
    low = F.lower(text(head))
    return confidence((text(title) != "", 0.2), (text(submitter) != "", 0.15), (F.contains(low, F.lit("gemeinderat")), 0.1), (F.contains(low, F.lit("dringlich")), 0.1))


def written_question_confidence(topic: Column, speaker: Column, question: Column, answer: Column) -> Column:
    return confidence((text(topic) != "", 0.15), (text(speaker) != "", 0.15), (text(question) != "", 0.15), (text(answer) != "", 0.05), base=0.5)

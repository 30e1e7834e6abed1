"""Question hours and written questions: cases with results written out, and pieces against whole files."""

import random

from quorumlake.operators import segment, turns


def lines(spark, *said):
    return spark.createDataFrame([("f", k, line) for k, line in enumerate(said)], "source string, line_no int, line string")


def paged(spark, *said):
    return spark.createDataFrame([("f", k, line, page) for k, (page, line) in enumerate(said)], "source string, line_no int, line string, page int")


def test_labels_with_followups(spark):
    got = turns.question_hours(
        lines(
            spark,
            "Gemeinderatssitzung am 16.12.2021",
            "Fragestellerin: GR Beispiel",
            "Frage: Welche Maßnahmen sind am Beispielplatz geplant?",
            "Antwort: Die zuständige Abteilung prüft",
            "  die Situation.  ",
            "Zusatzfrage: Wird auch die Beispielgasse berücksichtigt?",
            "Zusatzantwort: Die Beispielgasse wird aufgenommen.",
            "17",
            "Frage: Wie ist der Zeitplan?",
            "Antwort: Nach der Abstimmung.",
        )
    ).orderBy("block").collect()
    assert [(r.number, r.question, r.answer, r.followup_question, r.followup_answer) for r in got] == [
        (1, "Welche Maßnahmen sind am Beispielplatz geplant?", "Die zuständige Abteilung prüft die Situation.", "Wird auch die Beispielgasse berücksichtigt?", "Die Beispielgasse wird aufgenommen."),
        (2, "Wie ist der Zeitplan?", "Nach der Abstimmung.", "", ""),
    ]
    assert got[0].speaker == "GR Beispiel" and got[1].speaker == ""


def test_turns_under_numbered_topics(spark):
    got = turns.question_hours(
        lines(
            spark,
            "Sitzung des Gemeinderates vom 18. November 2010 20",
            "F R A G E S T U N D E",
            "8) Parktarife in den Blauen Zonen",
            "GR. Eichberger stellt an Bgm.-Stvin. Rücker folgende Frage:",
            "GR. Eichberger: Wann kommt es zu dieser Erhöhung?",
            "Bgm.-Stvin. Rücker: Ein Vorschlag wird im Frühling diskutiert.",
            "GR. Eichberger: Gibt es 2011 diesbezügliche Anträge?",
            "Bgm.-Stvin. Rücker: Für 2011 wird ein Vorschlag entwickelt.",
            "9) Gemeindewohnungen ohne",
            "Heizmöglichkeit",
            "GRin. Pavlovec-Meixner stellt an StRin. Kahr folgende Frage:",
            "GRin. Pavlovec-Meixner: Wie viele Wohnungen?",
            "StRin. Kahr: Es gibt keine.",
        )
    ).orderBy("block").collect()
    assert [(r.number, r.title, r.speaker, r.respondent, r.question, r.answer, r.followup_question, r.followup_answer) for r in got] == [
        (8, "Parktarife in den Blauen Zonen", "GR. Eichberger", "Bgm.-Stvin. Rücker", "Wann kommt es zu dieser Erhöhung?", "Ein Vorschlag wird im Frühling diskutiert.", "Gibt es 2011 diesbezügliche Anträge?", "Für 2011 wird ein Vorschlag entwickelt."),
        (9, "Gemeindewohnungen ohne Heizmöglichkeit", "GRin. Pavlovec-Meixner", "StRin. Kahr", "Wie viele Wohnungen?", "Es gibt keine.", "", ""),
    ]


def test_topics_drop_who_asks(spark):
    got = turns.question_hours(
        lines(
            spark,
            "1) Aktionsprogramm gegen Armut GRin. Meißlitzer stellt an StRin. Maga Grabner folgende Frage:",
            "Was ist geplant?",
            "StRin. Maga Grabner: Die Maßnahmen werden geprüft.",
            "2) Unterstützung in der Hochsteingasse 16 GRin. Mag",
            "a Taberhofer stellt an Stadtrat Beispiel folgende Frage:",
            "Welche Unterstützung gibt es?",
            "Stadtrat Beispiel: Eine Prüfung läuft.",
        )
    ).orderBy("block").collect()
    assert [r.title for r in got] == ["Aktionsprogramm gegen Armut", "Unterstützung in der Hochsteingasse 16"]
    assert got[1].speaker == "GRin. Maga Taberhofer"


def test_written_questions_by_number_and_by_subject(spark):
    got = turns.written_questions(
        paged(
            spark,
            (2, "Gemeinderatssitzung vom 22. April 2004 46"),
            (2, "1) Eintrittspreise für Freibäder"),
            (2, "GR. Hohensinner stellt folgende Anfrage:"),
            (2, "GR. Hohensinner: Warum sind sie höher?"),
            (3, "Bgm. Mag. Nagl: Ich werde Gespräche führen."),
            (4, "2) Ohne das Zentrum hat die Stadt ein Problem"),
            (4, "GRin. Mag a Beispiel stellt folgende Anfrage:"),
            (4, "GRin. Maga Beispiel: Wie geht es weiter?"),
            (5, "Betr.: Maßnahmenpaket Sturzgasse"),
            (5, "MÜNDLICHE ANFRAGE"),
            (5, "von Herrn Gemeinderat Wilhelm Kolar"),
            (5, "an Bürgermeister Mag. Siegfried NAGL"),
            (5, "Sehr geehrter Herr Bürgermeister!"),
            (5, "die Anfrage,"),
            (5, "ob du bereit bist?"),
        )
    ).orderBy("block").collect()
    assert [(r.number, r.title, r.page, r.speaker, r.question, r.answer) for r in got] == [
        (1, "Eintrittspreise für Freibäder", 2, "GR. Hohensinner", "GR. Hohensinner: Warum sind sie höher?", "Ich werde Gespräche führen."),
        (2, "Ohne das Zentrum hat die Stadt ein Problem", 4, "GRin. Maga Beispiel", "GRin. Maga Beispiel: Wie geht es weiter?", ""),
        (3, "Maßnahmenpaket Sturzgasse", 5, "Herrn Gemeinderat Wilhelm Kolar", "ob du bereit bist?", ""),
    ]


def test_heads_inside_lines_part_them(spark):
    got = turns.written_questions(
        paged(
            spark,
            (3, "Betr.: Mariatrosterstrasse/Tempo 30"),
            (3, "MÜNDLICHE ANFRAGE"),
            (3, "von Frau Gemeinderätin Edeltraud Meißlitzer"),
            (3, "die Anfrage,"),
            (4, "ob Sie bereit sind, Tempo 30 zu erwirken?GR CO HR Dr. Peter Piffl-Perčević 16.11.2006"),
            (4, "A N F R A G E"),
            (4, "Betr: Nutzungskonzept Schlossberg, Nutzung der Möglichkeiten dort auch"),
            (4, "weiterhin ein Garnisonsmuseum zu betreiben."),
            (4, "Ich erlaube mir daher an Dich die"),
            (4, "Anfrage,"),
            (5, "bist du bereit? A N F R A G E Betreff: Drittes Thema"),
            (5, "Wer zahlt?"),
            (5, "Und wann?"),
        )
    ).orderBy("block").collect()
    assert [(r.title, r.page) for r in got] == [
        ("Mariatrosterstrasse/Tempo 30", 3),
        ("Nutzungskonzept Schlossberg, Nutzung der Möglichkeiten dort auch weiterhin ein Garnisonsmuseum zu betreiben", 4),
        ("Drittes Thema", 5),
    ]
    assert got[2].question == "Und wann?"


def test_pieces_give_what_whole_files_give(spark, monkeypatch):
    rng = random.Random(4)
    said = ["3) Thema", "Frage: A?", "Frage:", "Antwort: B.", "Antwort:", "Zusatzfrage: C?", "Zusatzantwort: D.", "GR. X: sagt", "Bgm. Y: meint", "GR. X:", "Text", "GR. X stellt an StR. Y folgende Frage:", "Fragesteller: Z", "Stadtrat W"]
    rows = [(f"f{n}", k, rng.choice(said)) for n in range(60) for k in range(25)]
    frame = spark.createDataFrame(rows, "source string, line_no int, line string")
    got = sorted(map(tuple, turns.question_hours(frame).collect()))
    pieces = turns._numbered_pieces
    monkeypatch.setattr(turns, "_numbered_pieces", lambda x, begins: pieces(x, turns.F.lit(False)))
    assert got == sorted(map(tuple, turns.question_hours(frame).collect())) and len(got) > 100


def test_motions_in_pieces_equal_motions_of_whole_files(spark, monkeypatch):
    rng = random.Random(6)
    said = ["Dringlicher Antrag", "Betrifft: etwas", "12) Nummer", "im Gemeinderat", "Antrag", "Text", "Worte. Dringlicher Antrag wegen", "dringlich"]
    rows = [(f"f{n}", k, rng.choice(said)) for n in range(80) for k in range(20)]
    frame = spark.createDataFrame(rows, "source string, line_no int, line string")
    got = sorted(map(tuple, turns.motion_blocks(frame).collect()))
    pieces = turns._numbered_pieces
    monkeypatch.setattr(turns, "_numbered_pieces", lambda x, begins: pieces(x, turns.F.lit(False)))
    assert got == sorted(map(tuple, turns.motion_blocks(frame).collect())) and len(got) > 100


def test_no_lines(spark):
    empty = spark.createDataFrame([], "source string, line_no int, line string")
    assert turns.question_hours(empty).count() == turns.written_questions(empty).count() == turns.motion_blocks(empty).count() == 0


def metadata(spark, *said):
    return segment.entry_metadata(lines(spark, *said)).first()


def test_values_beside_and_below_labels(spark):
    got = metadata(
        spark, "A 8 - 123/2024", "Betreff:", "Sanierung der", "  Beispielstraße,", "2. Bauabschnitt", "Antragsteller:in(nen): GRin Muster", "GR Zweiter", "Berichterstatterin", "", "StRin Beispiel", "Bearbeiter:", "Datum: 1.2.2024", "Regierungsmitglied(er): Bgm.in Elke"
    )
    assert tuple(got)[1:] == ("Sanierung der Beispielstraße 2. Bauabschnitt", "GRin Muster", "Berichterstatterin: StRin Beispiel", "", "Bgm.in Elke")


def test_types_and_labels_end_a_subject(spark):
    got = metadata(spark, "Betr: Eins", "Selbständiger Antrag", "nicht dabei", "Betreff: Zwei", "und drei", "Fragesteller:in", "Dienststelle: A10", "Fragesteller:in: GR Später", "Betreffend nichts")
    assert (got.title, got.submitter) == ("Eins Zwei und drei", "GR Später")


def test_an_entry_without_labels_has_an_empty_row(spark):
    assert tuple(metadata(spark, "nur Text", "Anlagen"))[1:] == ("",) * 5

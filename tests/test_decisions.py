"""Decision pages, motion files and whole records, by cases with results written out."""

from pyspark.sql import functions as F

from quorumlake.functions import records
from quorumlake.operators import decisions, turns


def lines(spark, *said):
    return spark.createDataFrame([("f", k, x) for k, x in enumerate(said)], "source string, line_no long, line string")


def one(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expression.alias("x")).first()["x"]


def test_votes_carry_organ_date_and_notes(spark):
    frame = lines(
        spark, "Ausschuss für Kultur am 3.4.2024", "einstimmig  angenommen", "Gemeinderat", "am 5.4.2024", "Mehrheitlich abgelehnt.", "Anmerkungen zur Abstimmung", "Zustimmung: KPÖ und SPÖ", "Gegen: ÖVP, FPÖ; laut Zuruf",
        "wird schriftlich beantwortet", "Schriftführer: X", "angenommen",
    )
    got = [(r.organ, r.date, r.outcome, r.approval, r.against) for r in decisions.decision_votes(frame).orderBy("line_no").collect()]
    assert got == [
        ("Ausschuss für Kultur", "3.4.2024", "accepted_unanimous", [], []),
        ("Gemeinderat", "5.4.2024", "rejected_majority", ["KPÖ", "SPÖ"], ["ÖVP", "FPÖ"]),
        ("Gemeinderat", "5.4.2024", "source_available", [], []),
    ]
    assert decisions.decision_votes(lines(spark, "Gemeinderat", "es wurde angenommen")).count() == 0


def test_an_organ_without_date_forgets_the_last(spark):
    got = decisions.decision_votes(lines(spark, "am 1.2.2024", "Gemeinderat", "vertagt")).collect()
    assert [(r.organ, r.date, r.outcome) for r in got] == [("Gemeinderat", "", "postponed")]


def test_attachments_are_distinct_but_for_case(spark):
    html = '<a href="/document/attachment/1" title="Plan A">x</a><a href="/document/attachment/2"><i>PLAN a</i></a><a href="/x">B</a><a title="" href="/document/attachment/3"> C <b>d</b></a>'
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert {r.page_id: r.titles for r in decisions.attachment_titles(pages).collect()} == {1: ["Plan A", "C d"], 2: []}


def test_titles_stand_below_the_date(spark):
    frame = lines(spark, "Kopf", "Datum:", "1.2.2024", "GR-12345/2024", "Bearbeiterin: Huber", "Radweg am Ring", "und Kreuzung", "Der Radweg wird gebaut.", "Er kostet viel.", "Beschlussvermerk", "Anderes")
    r = decisions.subject_titles(frame).first()
    assert (r.title, r.snippet) == ("Radweg am Ring und Kreuzung", "Der Radweg wird gebaut. Er kostet viel.")
    assert decisions.subject_titles(lines(spark, "ohne", "alles")).count() == 0
    r = decisions.subject_titles(lines(spark, "Datum", "x", "Die Lage", "Titel hier")).first()
    assert (r.title, r.snippet) == ("", "Die Lage Titel hier")


def test_motions_open_with_a_title(spark):
    frame = lines(
        spark, "Deckblatt", "Dringlicher Antrag an den Gemeinderat", "Betreff: Erstes", "Text. Dringlicher Antrag der KPÖ", "Betrifft Zweites", "17", "3) Drittes", "Schluss",
    )
    got = [r.body.split("\n") for r in turns.motion_blocks(frame).orderBy("block").collect()]
    assert got == [["Dringlicher Antrag an den Gemeinderat", "Betreff: Erstes", "Text"], ["Dringlicher Antrag der KPÖ", "Betrifft Zweites"], ["3) Drittes", "Schluss"]]
    assert turns.motion_blocks(lines(spark, "Antrag ohne Titel", "Text")).count() == 0


def test_tab_entries_skip_references(spark):
    html = """<ul class="ui-tabs-nav"><li><a href="#a">Anfragen</a></li><li><a aria-controls="b" href="#">Anträge</a></li></ul><div id="a"><p><b>1</b> Einlagezahl <a href="/document/0">x</a></p></div>
    <div id="b"><p>Vorspann</p><p><b>7</b> Einlagezahl <b><a href="/document/1">E</a></b> gleich<br>danach</p><div>Betreff: <i>Eins</i></div><p>Bezug zu Stück 2</p><p>Einlagezahl <a href="/document/2">E</a></p>
    <p>Zusatzanträge</p><p><b>8</b> Einlagezahl <a href="/document/3">E</a></p><p>Abänderungsanträge:</p><p>Einlagezahl <a href="/document/4">E</a> der SPÖ</p></div>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>nichts</p>")], "page_id long, html string")
    got = decisions.panel_entries(decisions.panel_blocks(pages, "anträge")).orderBy("entry_no").collect()
    assert [(r.page_id, r.entry_no, r.href, r.kind, r.description) for r in got] == [
        (1, 1, "/document/1", "", "gleich danach | Betreff: Eins"),
        (1, 2, "/document/3", "", ""),
        (1, 3, "/document/4", "Abänderungsantrag", "Betreff: der SPÖ"),
    ]


def test_file_dates(spark):
    def of(t):
        return one(spark, records.date_in(F.col("t")), t=t)

    assert of("Sitzung 7.3.2024, 240101") == "2024-03-07" and of("240307_x") == "2024-03-07" and of("x_070324") == "2007-03-24"
    assert of("x 310324") == "2024-03-31" and of("x 1234567 999999") == "" and of("") == ""
    dated = records.asset_date(F.col("a"), F.col("b"), F.col("c"), F.lit("2020-01-01"))
    assert one(spark, dated, a="Protokoll", b="https://x.org/1.1.2001/p.pdf?d=1.1.2002", c="vom 9.8.2023") == "2023-08-09"
    assert one(spark, dated, a="", b="", c="") == "2020-01-01"


def test_unknown_submissions_are_settled(spark):
    schema = "kind string, status string, status_text string, raw_result string, result string, votes array<struct<subject:string,outcome:string,raw_text:string>>"
    rows = [("written_question", "unknown", "", "", "", []), ("communication", "unknown", "", "eigen", "Text", None), ("urgent_motion", "unknown", "", "", "", []), ("written_motion", "rejected", "a", "b", "c", [("motion", "rejected", "b")])]
    got = [(r.status, r.status_text, r.raw_result, r.result, [v.outcome for v in r.votes]) for r in records.normalised(spark.createDataFrame(rows, schema)).collect()]
    assert got == [
        ("assigned", "zugewiesen", records.ASSIGNED_TEXT, "Verfahren: zugewiesen", ["assigned"]),
        ("noted", "zur Kenntnis genommen", "eigen", "Text", ["assigned"]),
        ("unknown", "", "", "", []),
        ("rejected", "a", "b", "c", ["rejected"]),
    ]


def test_text_guards(spark):
    def heading(label, sure):
        return one(spark, records.valid_heading(F.col("t"), F.col("c")), t=label, c=sure)

    assert heading("Radweg", "1") and not heading("", "1") and not heading("x" * 91, "1") and not heading("Radweg", "1.1") and not heading("Radweg", None) and not heading("a b c d e f g h i j", "0.5")
    assert one(spark, records.meaningful_reason(F.col("t")), t="Kurz  gesagt.") == "" and one(spark, records.meaningful_reason(F.col("t")), t=" Viele Bürger fragten kurz nach ") == "Viele Bürger fragten kurz nach"
    assert not one(spark, records.meaningful_result(F.col("t")), t=" Unbekannt") and one(spark, records.meaningful_result(F.col("t")), t="vertagt")
    found = one(spark, records.json_in(F.col("t"), "a string"), t='Antwort: ```json {"a": "b"} ```')
    assert found["a"] == "b" and one(spark, records.json_in(F.col("t"), "a string"), t="nichts") is None


def test_places_from_long_texts_need_a_mention(spark):
    from quorumlake.functions import extract

    def of(stored, details, near):
        frame = spark.createDataFrame([(stored, near)], "s array<string>, n string")
        return frame.select(extract.inferred_places(F.col("s"), F.lit(details), F.lit(0), F.col("n"), ("Gries",))).first()[0]

    assert of(["Aweg"], 9, "Umbau der Bgasse") == ["Aweg", "Bgasse"]
    assert of(["Aweg", "Bgasse", "Cweg", "Dplatz"], 4, "Umbau der BGASSE in Gries") == ["Bgasse", "Gries"]
    assert of(["Aweg", "Bgasse", "Cweg", "Dplatz"], 3, "in Griesheim") == ["Aweg", "Bgasse", "Cweg", "Dplatz"]


def test_blocks_of_many_pages_are_given_on_in_parts(spark, monkeypatch):
    page = '<ul class="ui-tabs-nav"><li><a href="#t1">Tagesordnung</a></li></ul><div id="t1"><div class="preview">' + "<p>eins</p><p>zwei</p>" * 4 + "</div></div>"
    pages = spark.createDataFrame([(k, page) for k in range(5)], "page_id long, html string")
    whole = sorted(tuple(r) for r in decisions.panel_blocks(pages, "Tagesordnung").collect())
    assert len(whole) == 40
    monkeypatch.setattr(decisions, "BLOCKS_HELD", 3)
    frames = []
    monkeypatch.setattr(type(pages), "mapInPandas", lambda self, run, schema: frames.extend(run([self.toPandas()])))
    decisions.panel_blocks(pages, "Tagesordnung")
    assert max(len(f) for f in frames) == 3 and sum(len(f) for f in frames) == 40

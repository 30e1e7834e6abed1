from pyspark.sql import functions as F

from quorumlake.functions import dates, extract, labels, text


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def test_fold_and_tokens(spark):
    assert one(spark, text.fold(F.col("t")), t="Über Straßen") == "ueber strassen"
    assert one(spark, text.query_tokens(F.col("t")), t="Was wurde zum Rad-Weg in der Übelbacher Straße?") == ["rad-weg", "rad", "weg", "uebelbacher", "strasse"]
    assert one(spark, text.alternatives(F.col("t")), t="kindergaerten") == ["kindergaerten", "kindergaert"]


def test_clip_at_words(spark):
    assert one(spark, text.clip_words(F.col("t"), 10), t="eins zwei drei vier") == "eins zwei."


def test_sentences(spark):
    assert one(spark, text.sentences(F.col("t")), t="Das ist ein langer Satz. Kurz. Und hier noch einer, der zählt.") == ["Das ist ein langer Satz.", "Und hier noch einer, der zählt."]


def test_dates(spark):
    assert one(spark, dates.from_file_name(F.col("t")), t="protokoll_2023-05-17.docx") == "2023-05-17"
    assert one(spark, dates.from_file_name(F.col("t")), t="230517_protokoll.pdf") == "2023-05-17"
    assert one(spark, dates.from_file_name(F.col("t")), t="239917_protokoll.pdf") == ""
    assert one(spark, dates.from_long(F.col("t")), t="am 3. Jänner 2024 im Rathaus") == "2024-01-03"
    assert one(spark, dates.meeting_date(F.lit("x"), F.col("t")), t="Sitzung des Gemeinderates am 7. 3. 2024") == "2024-03-07"


def test_periods(spark):
    p = one(spark, dates.period(F.col("t")), t="3.5. bis 17.9.2024")
    assert (p["start"], p["end"]) == ("2024-05-03", "2024-09-17")
    p = one(spark, dates.period(F.col("t")), t="derzeit - 1.2.2024")
    assert (p["start"], p["end"]) == ("", "2024-02-01")
    status = dates.period_status(F.col("t"), F.lit(""), F.lit("2024-02-01"), F.lit("2024-01-15"))
    assert one(spark, status, t="derzeit - 1.2.2024") == "aktuell"


def test_extraction(spark):
    heading = "A 8 - 12345/2023/7 Sanierung Annenstraße, € 1.250.000,- (Berichterstatterin: GRin Maier)"
    assert one(spark, extract.business_numbers(F.col("t")), t=heading) == ["A 8-12345/2023/7"]
    assert one(spark, extract.base_number(F.lit("A 8-12345/2023/7"))) == "A 8-12345/2023"
    assert one(spark, extract.amounts(F.col("t")), t=heading) == ["€ 1.250.000,-"]
    assert str(one(spark, extract.amount_value(F.lit("€ 1.250.000,50")))) == "1250000.50"
    assert one(spark, extract.submitter_of(F.col("t")), t=heading) == "Berichterstatterin: GRin Maier"
    found = one(spark, extract.places(F.col("t")), t="Am Schulweg und Fußweg zur Annenstraße, zum GRIESPLATZ, KG Gries, EZ 12")
    assert [(p["type"], p["value"]) for p in found] == [("street", "Annenstraße"), ("street", "GRIESPLATZ"), ("place", "GRIESPLATZ")]


def test_file_numbers_have_edges(spark):
    def of(t):
        return one(spark, extract.business_numbers(F.col("t")), t=t)

    assert of("GZ: Präs. 12345/2024/0003 und präs 12345/2024/0003") == ["Präs. 12345/2024/0003"]
    assert of("HALAB 12345") == [] and of("ab 12345 - 1 gilt") == ["ab 12345-1"]
    assert of("A 10/8 – 98765/2022 - 3. Änderung") == ["A 10/8-98765/2022"]
    assert of("kein Stück") == of("") == []


def test_amounts_are_those_applied_for(spark):
    def of(heading, *body):
        frame = spark.createDataFrame([(heading, "\n".join(body))], "h string, b string")
        return frame.select(extract.amounts_of_item(F.col("h"), F.col("b"))).first()[0]

    wanted = "Der Gemeinderat wolle beschließen: € 2.000,- für den Park"
    assert of("Zaun um € 10.000 ,--", "Früher € 1,-", wanted, "davon € 500,50", "Der Antrag wurde angenommen. € 9,-", "€ 8,-") == ["€ 10.000,-", "€ 2.000,-", "€ 500,50"]
    assert of("Zaun", "Früher € 1,-") == of("", "") == []
    assert of("Zaun", "Der Antrag wurde vertagt.", wanted) == []


def test_file_titles_keep_numbers_that_are_no_date(spark):
    title = lambda name: one(spark, labels.file_title(F.lit(f"https://x.example.org/a/{name}?x=1")))
    assert title("1998-06-15_Bebauungsplan_KG_Waltendorf_EZ_123456.pdf") == "Bebauungsplan KG Waltendorf EZ 123456"
    assert title("980615_Antrag_zu_EZ_123456.pdf") == "Antrag zu EZ 123456"
    assert title("Antrag_980615.pdf") == "Antrag"
    assert title("Konto_1234567.pdf") == "Konto 1234567"


def test_the_text_of_places_is_worked_out_once(spark):
    rows = spark.createDataFrame([("Annenstraße, Hauptplatz und Stadtpark an der Keplerbrücke",)], ["t"]).select(extract.places(F.concat("t", F.lit(" einmal"))).alias("x"))
    assert len(rows.first()["x"]) == 7
    assert rows._jdf.queryExecution().analyzed().toString().count(" einmal") == 1


def test_places_within_the_budget(spark):
    def of(*body):
        frame = spark.createDataFrame([("Bau", "\n".join(body))], "h string, b string")
        return frame.select(extract.place_text(F.col("h"), F.col("b"))).first()[0].split("\n")

    assert of("a", "Der Antrag wurde einstimmig angenommen.", "b") == ["Bau", "a"]
    assert of("a", "zur Kenntnis genommen", "b") == ["Bau", "a"] and of("x unangenommen y", "b") == ["Bau", "x unangenommen y", "b"]
    assert of("x" * 1600, "b") == ["Bau", "x" * 1600] and of("x" * 1590, "b", "c" * 9, "d") == ["Bau", "x" * 1590, "b", "c" * 9]


def test_results_of_both_forms(spark):
    def of(t):
        return [(v["subject"], v["outcome"], v["approval"], v["against"]) for v in one(spark, extract.votes(F.col("t")), t=t)]

    assert of("Der geschäftsordnungsmäßigen  Behandlung zugewiesen.") == [("procedure", "assigned", [], [])]
    assert of("DER ANTRAG wurde EINSTIMMIG ANGENOMMEN.") == [("procedure", "accepted_unanimous", [], [])]
    assert of("Der Tagesordnungspunkt wurde mehrheitlich angenommen (Gegen: KPÖ und Grüne).") == [("agenda_item", "accepted_majority", [], ["KPÖ", "Grüne"])]
    assert of("Der Antrag wurde angenommen. Der Antrag wurde mehrheitlich angenommen.") == [("motion", "accepted_majority", [], [])]
    assert of("Der Antrag wurde abgelehnt. Der Antrag wurde einstimmig angenommen.") == [("motion", "accepted_unanimous", [], [])]
    assert of("Der Zusatzantrag wurde abgelehnt. Der Antrag wurde vertagt.") == [("additional_motion", "rejected", [], []), ("motion", "postponed", [], [])]
    assert of("Darüber wurde geredet.") == []


def test_status_words_are_whole(spark):
    def of(t):
        return one(spark, extract.status_of(F.col("t"))["status"], t=t)

    assert of("wurde vorangenommen") == "unknown" and of("so angenommen.") == "accepted" and of("abgelehnt") == "rejected"
    assert of("mehrstimmig abgelehnt") == "rejected_majority" and of("abgelehnt, dann angenommen") == "accepted"
    assert of("einstimmig angenommen und zur Kenntnis gebracht") == "noted"


def test_votes(spark):
    said = "Der Antrag wurde mehrheitlich angenommen (Gegen: A, B und C). Der Zusatzantrag wurde abgelehnt (Zustimmung: D)."
    votes = one(spark, extract.votes(F.col("t")), t=said)
    assert [(v["subject"], v["outcome"], v["against"], v["approval"]) for v in votes] == [("motion", "accepted_majority", ["A", "B", "C"], []), ("additional_motion", "rejected", [], ["D"])]
    assert one(spark, extract.status_of_votes(extract.votes(F.col("t"))), t=said) == "accepted_majority"
    assert one(spark, extract.votes_text(extract.votes(F.col("t"))), t=said).splitlines() == ["Antrag: mehrheitlich angenommen (Gegen: A, B, C)", "Zusatzantrag: abgelehnt (Zustimmung: D)"]
    assert one(spark, extract.status_of(F.col("t"))["status"], t="nichts") == "unknown"


def test_labels(spark):
    assert one(spark, labels.category(F.col("t")), t="Neuer Radweg und mehr Rad") == "Verkehr & Mobilität"
    assert one(spark, labels.category(F.col("t")), t="Ganz anderes") == "Sonstiges"
    assert one(spark, labels.answer_group(F.lit("accepted"), F.lit("Ausschuss"), F.lit("agenda_item"))) == "committee"
    assert one(spark, labels.canonical_url(F.lit("https://x.org/a?b=1&ref=9#z"))) == "https://x.org/a?ref=9"

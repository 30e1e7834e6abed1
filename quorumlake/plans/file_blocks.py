"""Registered queries over files of questions that are made of the records: one file a meeting."""

from __future__ import annotations

from quorumlake.operators import segment, turns
from quorumlake.plans import inputs
from quorumlake.plans.queries import RAW, query

_WHO, _HEAD = "'StR. Muster'", "CAST(item_no AS STRING) || ') ' || subject"
#: A third of the questions is written with labels, the others as turns under a numbered topic.
HOURS = f"""
SELECT date AS source, CAST(id * 20 AS BIGINT) AS line_no, {_HEAD} AS line FROM {{raw}} WHERE id % 3 <> 0
UNION ALL SELECT date, CAST(id * 20 + 1 AS BIGINT), '12' FROM {{raw}}
UNION ALL SELECT date, CAST(id * 20 + 2 AS BIGINT), person || ' stellt an ' || {_WHO} || ' folgende Frage:' FROM {{raw}} WHERE id % 3 = 1
UNION ALL SELECT date, CAST(id * 20 + 3 AS BIGINT), person || ': Wann kommt es zur ' || subject || '?' FROM {{raw}} WHERE id % 3 <> 0
UNION ALL SELECT date, CAST(id * 20 + 4 AS BIGINT), {_WHO} || ':  ' || result_text FROM {{raw}} WHERE id % 3 <> 0
UNION ALL SELECT date, CAST(id * 20 + 5 AS BIGINT), 'Mehr dazu später.' FROM {{raw}} WHERE id % 3 <> 0
UNION ALL SELECT date, CAST(id * 20 + 6 AS BIGINT), person || ': Was kostet es?' FROM {{raw}} WHERE id % 3 <> 0 AND item_no % 2 = 0
UNION ALL SELECT date, CAST(id * 20 + 7 AS BIGINT), {_WHO} || ': ' || amount_text FROM {{raw}} WHERE id % 3 <> 0 AND item_no % 2 = 0
UNION ALL SELECT date, CAST(id * 20 + 8 AS BIGINT), 'Frage: Wie steht es um ' || subject || '?' FROM {{raw}} WHERE id % 3 = 0
UNION ALL SELECT date, CAST(id * 20 + 9 AS BIGINT), 'Fragestellerin: ' || person FROM {{raw}} WHERE id % 3 = 0
UNION ALL SELECT date, CAST(id * 20 + 10 AS BIGINT), 'Antwort: ' || result_text FROM {{raw}} WHERE id % 3 = 0
UNION ALL SELECT date, CAST(id * 20 + 11 AS BIGINT), 'Zusatzfrage: Und das Geld?' FROM {{raw}} WHERE id % 3 = 0 AND item_no % 2 = 0
UNION ALL SELECT date, CAST(id * 20 + 12 AS BIGINT), 'Zusatzantwort: ' || amount_text FROM {{raw}} WHERE id % 3 = 0 AND item_no % 2 = 0
"""


@query(
    f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY id)::INT AS block, item_no % 2 = 0 AS more, id % 3 <> 0 AS turns FROM {RAW})
    SELECT date AS source, block, CASE WHEN turns AND item_no > 0 THEN item_no ELSE block END::INT AS number, person AS speaker, CASE WHEN turns THEN 'StR. Muster' ELSE '' END AS respondent,
      CASE WHEN turns THEN 'Wann kommt es zur ' ELSE 'Wie steht es um ' END || subject || '?' AS question, result_text || CASE WHEN turns THEN ' Mehr dazu später.' ELSE '' END AS answer,
      CASE WHEN NOT more THEN '' WHEN turns THEN 'Was kostet es?' ELSE 'Und das Geld?' END AS followup_question, CASE WHEN more THEN amount_text ELSE '' END AS followup_answer FROM b"""
)
def x3_question_hours(s, d):
    raw = inputs.raw_records(s, d)
    return turns.question_hours(s.sql(HOURS, raw=raw)).select("source", "block", "number", "speaker", "respondent", *turns.PARTS)


#: Written questions under a number or a subject, with an introduction or an author and an address.
WRITTEN = """
SELECT date AS source, CAST(id * 20 AS BIGINT) AS line_no, CASE WHEN id % 2 = 0 THEN CAST(item_no + 1 AS STRING) || ') ' || subject ELSE 'Betr.: ' || subject END AS line FROM {raw}
UNION ALL SELECT date, CAST(id * 20 + 1 AS BIGINT), 'MÜNDLICHE ANFRAGE' FROM {raw} WHERE id % 2 = 1
UNION ALL SELECT date, CAST(id * 20 + 2 AS BIGINT), CASE WHEN id % 2 = 0 THEN person || ' stellt folgende Anfrage:' ELSE 'von Herrn Gemeinderat ' || substr(person, 4) END FROM {raw}
UNION ALL SELECT date, CAST(id * 20 + 3 AS BIGINT), 'Sehr geehrter Herr Bürgermeister!' FROM {raw} WHERE id % 2 = 1
UNION ALL SELECT date, CAST(id * 20 + 4 AS BIGINT), 'Sie kennen ' || subject || '.' FROM {raw}
UNION ALL SELECT date, CAST(id * 20 + 5 AS BIGINT), 'die Anfrage,' FROM {raw}
UNION ALL SELECT date, CAST(id * 20 + 6 AS BIGINT), 'kostet das ' || amount_text || '?' FROM {raw}
UNION ALL SELECT date, CAST(id * 20 + 7 AS BIGINT), 'Bgm. Mag. Nagl: ' || result_text FROM {raw} WHERE item_no % 3 = 0
"""


@query(
    f"""SELECT date AS source, row_number() OVER (PARTITION BY date ORDER BY id)::INT AS block, CASE WHEN id % 2 = 0 THEN item_no + 1 ELSE row_number() OVER (PARTITION BY date ORDER BY id) END::INT AS number,
      CASE WHEN length(subject) <= 112 THEN subject ELSE rtrim(substr(subject, 1, 111), ' ,.;') || '…' END AS title,
      CASE WHEN id % 2 = 0 THEN person ELSE 'Herrn Gemeinderat ' || substr(person, 4) END AS speaker, 'Sie kennen ' || subject || '. kostet das ' || amount_text || '?' AS question, CASE WHEN item_no % 3 = 0 THEN result_text ELSE '' END AS answer FROM {RAW}"""
)
def x6_written_questions(s, d):
    return turns.written_questions(s.sql(WRITTEN, raw=inputs.raw_records(s, d))).drop("page")


#: An entry's lines: subjects on one line or several, people beside their label or below it, labels without a value.
ENTRIES = """
SELECT record_id AS source, 1 AS line_no, CASE WHEN id % 3 = 0 THEN 'Betreff:' ELSE 'Betreff: ' || subject END AS line FROM {raw}
UNION ALL SELECT record_id, 2, subject || ',' FROM {raw} WHERE id % 3 = 0
UNION ALL SELECT record_id, 3, '  ' FROM {raw}
UNION ALL SELECT record_id, 4, 'zweiter Teil' FROM {raw} WHERE id % 3 <> 2
UNION ALL SELECT record_id, 5, 'Dringlicher Antrag an den Gemeinderat' FROM {raw} WHERE id % 5 = 0
UNION ALL SELECT record_id, 6, 'kein Teil des Betreffs' FROM {raw} WHERE id % 5 = 0
UNION ALL SELECT record_id, 7, 'Antragsteller:in(nen):' FROM {raw}
UNION ALL SELECT record_id, 8, person FROM {raw} WHERE id % 4 <> 0
UNION ALL SELECT record_id, 9, 'Datum: ' || date FROM {raw}
UNION ALL SELECT record_id, 10, 'Fragesteller: ' || person || ' jun.' FROM {raw} WHERE id % 2 = 0
UNION ALL SELECT record_id, 11, 'Berichterstatterin' FROM {raw}
UNION ALL SELECT record_id, 12, '' FROM {raw}
UNION ALL SELECT record_id, 13, 'StR. Muster' FROM {raw}
UNION ALL SELECT record_id, 14, 'BEARBEITER: ' || segment FROM {raw} WHERE id % 7 = 0
UNION ALL SELECT record_id, 15, 'Regierungsmitglied(er): Bgm. Beispiel' FROM {raw} WHERE id % 6 = 0
"""


@query(
    f"""SELECT record_id AS source, CASE WHEN id % 3 = 2 THEN subject ELSE subject || ' zweiter Teil' END AS title, CASE WHEN id % 4 <> 0 THEN person ELSE person || ' jun.' END AS submitter,
      'Berichterstatterin: StR. Muster' AS reporter, CASE WHEN id % 7 = 0 THEN 'Bearbeiterin: ' || segment ELSE '' END AS editor, CASE WHEN id % 6 = 0 THEN 'Bgm. Beispiel' ELSE '' END AS addressee FROM {RAW}"""
)
def x11_entry_metadata(s, d):
    return segment.entry_metadata(s.sql(ENTRIES, raw=inputs.raw_records(s, d)))

"""Registered queries of small steps: titles, people, lists, counters and checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quorumlake.functions import extract, labels, text
from quorumlake.operators import facets, link, topics
from quorumlake.plans import inputs
from quorumlake.plans.queries import LINES, RAW, REC, TODAY, fold_sql, q, query, search_text_sql


@query("SELECT DISTINCT replace(lower(p_name || ' strasse'), 'strasse', 'straße') AS name FROM part")
def s7_street_dimension(s, d):
    return inputs.table(s, d, "part").select(text.street_name(F.concat("p_name", F.lit("  Strasse"))).alias("name")).distinct()


_SIGNS = "CASE c_custkey % 4 WHEN 0 THEN 'KPÖ' WHEN 1 THEN 'Grüne' WHEN 2 THEN 'SPÖ' ELSE 'Liste' END"


@query(f"SELECT c_custkey, CASE {_SIGNS} WHEN 'Liste' THEN 'ohne Klub' ELSE {_SIGNS} END AS party, 'Vor' || c_nationkey || ' ' || replace(c_name, '#', '') AS name FROM customer")
def s15_council_members(s, d):
    c = inputs.table(s, d, "customer")
    sign = F.element_at(F.array(*map(F.lit, ("KPÖ", "Grüne", "SPÖ", "Liste"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    label = F.concat(F.lit("Mag. Dr. "), F.replace("c_name", F.lit("#"), F.lit("")), F.lit(", Vor"), F.col("c_nationkey").cast("string"), F.lit(" ("), sign, F.lit(")"))
    return c.select("c_custkey", labels.party(label).alias("party"), labels.member_name(label).alias("name"))


@query(f"SELECT record_id, row_number() OVER (ORDER BY id)::INT AS row FROM {RAW} WHERE date >= '{TODAY}' AND kind = 'communication' QUALIFY row <= 200")
def f13_running_roadworks(s, d):
    r = inputs.raw_records(s, d).where((F.col("date") >= TODAY) & (F.col("kind") == "communication"))
    top = r.select("record_id", "id").orderBy("id").limit(200)
    return top.select("record_id", F.row_number().over(Window.orderBy("id")).alias("row"))


@query(f"SELECT record_id, id % 9 = 0 OR id % 9 = 1 AS generic, CASE WHEN id % 9 IN (0, 1) THEN 'Betreff: ' || subject ELSE subject END AS shown FROM {RAW}")
def p9_display_titles(s, d):
    r = inputs.raw_records(s, d)
    own = F.when(F.col("id") % 9 == 0, "Antrag").when(F.col("id") % 9 == 1, "Stk. 12)").otherwise(F.col("subject"))
    generic = labels.generic_title(own)
    return r.select("record_id", generic.alias("generic"), F.when(generic, F.concat(F.lit("Betreff: "), "subject")).otherwise(own).alias("shown"))


@query(f"SELECT record_id, trim(regexp_replace(subject, ' +', ' ', 'g')) AS title FROM {RAW}")
def p10_file_titles(s, d):
    r = inputs.raw_records(s, d)
    url = F.concat(F.lit("https://x.example.org/a/"), F.col("date"), F.lit("_"), F.url_encode(F.replace("subject", F.lit(" "), F.lit("_"))), F.lit(".pdf?x=1"))
    return r.select("record_id", labels.file_title(url).alias("title"))


@query(f"SELECT record_id, array_to_string([subject, person, lower(kind)], '|') AS vals FROM {RAW}")
def p16_distinct_values(s, d):
    values = F.array("subject", "person", F.lower("kind"), F.upper("kind"), F.lower("person"), F.col("subject"))
    return inputs.raw_records(s, d).select("record_id", F.array_join(text.first_distinct(values), "|").alias("vals"))


@query(f"SELECT record_id, year AS asked FROM {RAW}")
def p25_question_years(s, d):
    said = F.concat(F.lit("Was geschah am 3.4."), F.col("year"), F.lit(" in Nr. 12?"))
    return inputs.raw_records(s, d).select("record_id", F.regexp_extract(said, r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:$|[^0-9])", 1).alias("asked"))


@query(f"SELECT record_id, CASE WHEN id % 3 = 0 THEN person WHEN kind = 'question_hour' THEN 'Bürgermeisterin' ELSE 'unbekannt' END AS recipient FROM {RAW}")
def p32_recipients(s, d):
    r = inputs.raw_records(s, d)
    named = F.when(F.col("id") % 3 == 0, F.col("person")).otherwise("")
    by_section = F.when(F.col("kind") == "question_hour", F.lit("Bürgermeisterin"))
    return r.select("record_id", F.coalesce(F.nullif(named, F.lit("")), by_section, F.lit("unbekannt")).alias("recipient"))


@query("SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '') AS asked, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '') AS answered FROM conversations GROUP BY conv_id")
def p40_question_parts(s, d):
    c = inputs.table(s, d, "conversations")

    def said(role: str):
        parts = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text"))))
        return F.array_join(F.transform(parts, lambda x: x["text"]), " ")

    return c.groupBy("conv_id").agg(said("user").alias("asked"), said("assistant").alias("answered"))


@query(f"SELECT record_id, round(least(0.55 + 0.1 + CASE WHEN length(title) >= 8 THEN 0.15 ELSE 0 END + CASE WHEN item_no > 0 THEN 0.15 ELSE 0 END + CASE WHEN section <> '' THEN 0.05 ELSE 0 END, 1), 4)::DOUBLE AS agenda, round(least(0.45 + CASE WHEN length(subject) > 20 THEN 0.25 ELSE 0 END + 0.2, 1), 4)::DOUBLE AS hour FROM {REC}")
def p47_confidences(s, d):
    r = inputs.records(s, d)
    agenda = extract.confidence((F.size("numbers") > 0, 0.1), (F.length("title") >= 8, 0.15), (F.col("item_no") > 0, 0.15), (F.col("section") != "", 0.05), base=0.55)
    hour = extract.confidence((F.length("subject") > 20, 0.25), (F.col("result_text") != "", 0.2), base=0.45)
    return r.select("record_id", agenda.alias("agenda"), hour.alias("hour"))


@query(f"SELECT record_id, CASE WHEN contains(subject, ' und ') THEN split_part(subject, ' und ', 1) || '' ELSE subject || ' 5' END AS place FROM {RAW}")
def p51_geocoding_texts(s, d):
    r = inputs.raw_records(s, d)
    return r.select("record_id", labels.geocoding_text(F.concat("subject", F.lit(" 5-9 (Umleitung)"))).alias("place"))


@query(
    f"SELECT record_id, array_to_string(list_filter(string_split_regex(trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_-]+', ' ', 'g')), ' +'), lambda x, i: length(x) >= 6 AND x NOT IN ({', '.join(q(x) for x in topics.STOPWORDS)}) AND list_position(string_split_regex(trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_-]+', ' ', 'g')), ' +'), x) = i)[1:4], ' ') AS words FROM {REC}"
)
def p56_keywords(s, d):
    return inputs.records(s, d).select("record_id", F.array_join(topics.keywords(F.col("title")), " ").alias("words"))


@query(f"SELECT record_id, CASE WHEN id % 3 = 0 THEN 'alt ' || id WHEN id % 7 = 0 THEN 'neu ' || title ELSE '' END AS summary FROM {REC}")
def j10_backfilled_summaries(s, d):
    r = inputs.records(s, d)
    old = r.where("id % 3 = 0").select("record_id", F.concat(F.lit("alt "), F.col("id").cast("string")).alias("old"))
    new = r.where("id % 7 = 0").select("record_id", F.concat(F.lit("neu "), "title").alias("new"))
    return r.join(old, "record_id", "left").join(new, "record_id", "left").select("record_id", F.coalesce("old", "new", F.lit("")).alias("summary"))


@query(
    f"""WITH r AS (SELECT id, custkey, date::DATE AS s, date::DATE + (id % 40)::INT AS e FROM {RAW})
    SELECT a.id AS a, b.id AS b FROM r a JOIN r b ON a.custkey = b.custkey AND a.id < b.id AND a.s <= b.e AND b.s <= a.e"""
)
def j15_overlapping_periods(s, d):
    r = inputs.raw_records(s, d).select("id", "custkey", F.to_date("date").alias("s"), F.date_add(F.to_date("date"), (F.col("id") % 40).cast("int")).alias("e"))
    b = r.select("custkey", F.col("id").alias("b"), F.col("s").alias("bs"), F.col("e").alias("be"))
    return r.join(b, "custkey").where("id < b AND s <= be AND bs <= e").select(F.col("id").alias("a"), "b")


@query(
    f"""WITH n AS (SELECT DISTINCT person, {search_text_sql('person')} AS f, split_part({search_text_sql('person')}, ' ', 3) AS last FROM {RAW}), a AS (SELECT id, 'Was sagte ' || person || ' dazu?' AS query FROM {RAW})
    SELECT a.id, n.person FROM a JOIN n ON split_part({search_text_sql('query')}, ' ', 5) = n.last"""
)
def j17_people_asked_about(s, d):
    r = inputs.raw_records(s, d)
    names = r.select("person").distinct().withColumn("word", F.element_at(F.split(text.search_text(F.col("person")), " "), -1))
    asked = r.select("id", F.explode(F.array_distinct(F.split(text.search_text(F.concat(F.lit("Was sagte "), "person", F.lit(" dazu?"))), " "))).alias("word"))
    return asked.join(names, "word").select("id", "person")


@query("SELECT event_type AS status, count(*) AS n, sum(CASE WHEN value > 10 THEN 1 ELSE 0 END)::BIGINT AS large FROM events GROUP BY event_type")
def a17_legend(s, d):
    return inputs.table(s, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 10).alias("large"))


@query("SELECT count(*) AS rows, count_if(text IS NOT NULL AND text <> '') AS filled, count_if(quality = 1) AS good, count_if(toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def a19_counters(s, d):
    joined = inputs.table(s, d, "documents").join(inputs.table(s, d, "labels"), "doc_id", "left")
    return joined.agg(F.count("*").alias("rows"), F.count_if(F.col("text") != "").alias("filled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query(
    f"""WITH p AS (SELECT a.id, list_distinct(string_split(lower(a.subject), ' ')) AS x, list_distinct(string_split(lower(b.subject), ' ')) AS y FROM {RAW} a JOIN {RAW} b ON b.id = a.id + 6)
    SELECT id, len(list_intersect(x, y))::INT AS shared, round(len(list_intersect(x, y)) / len(x), 4)::DOUBLE AS share FROM p"""
)
def u3_token_sets(s, d):
    r = inputs.raw_records(s, d).select("id", F.lower("subject").alias("x"))
    other = r.select((F.col("id") - 6).alias("id"), F.col("x").alias("y"))
    words = lambda c: F.array_distinct(F.split(c, " "))
    p = r.join(other, "id")
    return p.select("id", F.size(F.array_intersect(words(F.col("x")), words(F.col("y")))).alias("shared"), F.round(link.token_overlap(F.col("x"), F.col("y")), 4).alias("share"))


@query(f"SELECT date, url, min(title) AS title FROM {REC} GROUP BY date, url")
def u4_unique_links(s, d):
    r = inputs.records(s, d).select("date", "url", "title")
    return facets.unique_by(r, F.struct("date", "url"), "title").select("date", "url", "title")


@query(f"SELECT id, array_to_string(list_distinct(list_filter(regexp_extract_all({fold_sql('subject')}, '[\\p{{L}}\\p{{N}}_-]+', 0), lambda t: length(t) >= 4 AND t NOT IN ({', '.join(q(w) for w in text.QUERY_STOPWORDS)}))), ' ') <> '' AS has_words FROM {RAW}")
def q12_question_words(s, d):
    words = F.filter(text.query_tokens(F.col("subject")), lambda t: F.length(t) >= 4)
    return inputs.raw_records(s, d).select("id", (F.size(words) > 0).alias("has_words"))


@query("SELECT item_id, text IS NULL OR text = '' AS blank, count(*) OVER (PARTITION BY item_id) > 1 AS twice FROM benchmark")
def v3_gold_checks(s, d):
    b = inputs.table(s, d, "benchmark")
    return b.select("item_id", (text.text(F.col("text")) == "").alias("blank"), (F.count("*").over(Window.partitionBy("item_id")) > 1).alias("twice"))


@query(f"SELECT date || '_' || lpad(row_number() OVER (PARTITION BY date ORDER BY id)::VARCHAR, 3, '0') AS record_id, coalesce(nullif(result_text, ''), 'Unbekannt') AS result, floor(price)::BIGINT AS amount FROM {RAW}")
def m2_entries_to_records(s, d):
    r = inputs.records(s, d)
    place = F.lpad(F.row_number().over(Window.partitionBy("date").orderBy("id")).cast("string"), 3, "0")
    return r.select(F.concat_ws("_", "date", place).alias("record_id"), F.coalesce(F.nullif("result_text", F.lit("")), F.lit("Unbekannt")).alias("result"), extract.amount_value(F.col("amounts")[0]).cast("long").alias("amount"))


@query(f"SELECT source, CASE WHEN bool_or(contains(line, 'Zusatzantrag')) THEN 'additional_motion' WHEN bool_or(contains(line, 'Tagesordnungspunkt')) THEN 'agenda_item' WHEN bool_or(contains(line, 'Antrag')) THEN 'written_motion' ELSE 'communication' END AS kind FROM {LINES} GROUP BY source")
def x13_types_of_documents(s, d):
    has = lambda w: F.bool_or(F.contains("line", F.lit(w)))
    return inputs.lines(s, d).groupBy("source").agg(F.when(has("Zusatzantrag"), "additional_motion").when(has("Tagesordnungspunkt"), "agenda_item").when(has("Antrag"), "written_motion").otherwise("communication").alias("kind"))

"""Further registered queries: sources, segmentation, presentation, answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quorumlake.functions import dates, extract, labels, text
from quorumlake.operators import answers, facets, link, quality, search, segment
from quorumlake.plans import inputs
from quorumlake.plans.queries import LINES, RAW, REC, TODAY, fold_sql, group_sql, q, query, search_text_sql, status_sql
from quorumlake.sources import html, sinks

_ANCHORS = f"""(SELECT page_id, url, h[i + 1] AS href, trim(regexp_replace(l[i + 1], '[ \\t\\n\\r]+', ' ', 'g')) AS label, i FROM (SELECT *, unnest(range(0, len(h))) AS i FROM
  (SELECT page_id, url, regexp_extract_all(coalesce(html, ''), {q(html.ANCHOR)}, 1) AS h, regexp_extract_all(coalesce(html, ''), {q(html.ANCHOR)}, 2) AS l FROM pages)))"""


@query(f"SELECT label, count(*) AS n, min(page_id) AS first_page FROM {_ANCHORS} WHERE regexp_matches(label, '^[A-Z]') AND length(label) >= 4 GROUP BY label")
def s13_meeting_links(s, d):
    a = html.anchors(inputs.table(s, d, "pages"))
    return a.where(F.rlike("label", F.lit("^[A-Z]")) & (F.length("label") >= 4)).groupBy("label").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(f"SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n, count(DISTINCT href) AS targets FROM {_ANCHORS} GROUP BY ALL")
def k13_link_index(s, d):
    a = html.anchors(inputs.table(s, d, "pages"))
    return a.groupBy(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host")).agg(F.count("*").alias("n"), F.count_distinct("href").alias("targets"))


@query(
    f"""SELECT record_id, tab, row_number() OVER (PARTITION BY date, tab ORDER BY id)::INT AS place, coalesce(nullif(CASE WHEN id % 4 = 0 THEN '' ELSE title END, ''), subject) AS title
    FROM {REC} JOIN (VALUES ('agenda_item', 'Tagesordnung'), ('urgent_motion', 'Dringlichkeitsanträge'), ('communication', 'Mitteilungen')) t(kind2, tab) ON kind = kind2"""
)
def s18_entries(s, d):
    r = inputs.records(s, d)
    tab = F.create_map(*[F.lit(x) for x in ("agenda_item", "Tagesordnung", "urgent_motion", "Dringlichkeitsanträge", "communication", "Mitteilungen")])[F.col("kind")]
    rows = r.withColumn("tab", tab).where("tab IS NOT NULL")
    own = F.when(F.col("id") % 4 == 0, "").otherwise(F.col("title"))
    place = F.row_number().over(Window.partitionBy("date", "tab").orderBy("id"))
    return rows.select("record_id", "tab", place.alias("place"), F.coalesce(F.nullif(own, F.lit("")), "subject").alias("title"))


@query(
    f"""WITH c AS (SELECT source, line_no, regexp_extract(line, '(?i)Stk\\.? *([0-9]+)\\) *(.+)$', 1)::INT AS item_no, trim(regexp_extract(line, '(?i)Stk\\.? *([0-9]+)\\) *(.+)$', 2)) AS heading FROM {LINES} WHERE regexp_matches(line, '^Stk')),
    f AS (SELECT source, item_no, heading, count(*) AS n FROM c GROUP BY ALL) SELECT source, item_no, heading, row_number() OVER (PARTITION BY source ORDER BY item_no, heading)::INT AS ordinal FROM f"""
)
def x2_parsed_records(s, d):
    c = segment.agenda_chunks(inputs.lines(s, d)).select("source", "item_no", "heading").distinct()
    return c.withColumn("ordinal", F.row_number().over(Window.partitionBy("source").orderBy("item_no", "heading")))


@query(
    f"""WITH b AS (SELECT *, sum(CASE WHEN starts_with(line, 'Betreff: ') THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY line_no) AS block FROM {LINES})
    SELECT source, block::BIGINT AS block, max(CASE WHEN starts_with(line, 'Betreff: ') THEN substr(line, 10) END) AS topic, count(*) AS n FROM b WHERE block > 0 GROUP BY source, block"""
)
def x6_question_blocks(s, d):
    starts = F.startswith("line", F.lit("Betreff: "))
    b = segment.numbered_blocks(inputs.lines(s, d), starts, ["source"], "line_no")
    return b.groupBy("source", "block").agg(F.max(F.when(starts, F.substring("line", 10, 10_000))).alias("topic"), F.count("*").alias("n"))


@query(
    f"""WITH b AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[0-9]+\\. ') THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY line_no) AS block FROM {LINES})
    SELECT source, block::BIGINT AS block, min_by(line, line_no) AS title, coalesce(string_agg(CASE WHEN NOT regexp_matches(line, '^[0-9]+\\. ') THEN line END, ' ' ORDER BY line_no), '') AS body FROM b WHERE block > 0 GROUP BY ALL"""
)
def x7_communication_blocks(s, d):
    starts = F.rlike("line", F.lit(r"^[0-9]+\. "))
    b = segment.numbered_blocks(inputs.lines(s, d), starts, ["source"], "line_no")
    rest = F.array_sort(F.collect_list(F.when(~starts, F.struct("line_no", "line"))))
    return b.groupBy("source", "block").agg(F.min_by("line", "line_no").alias("title"), F.array_join(F.transform(rest, lambda x: x["line"]), " ").alias("body"))


@query(
    f"""WITH a AS (SELECT record_id, CASE kind WHEN 'question_hour' THEN 'question_hour' WHEN 'agenda_item' THEN 'agenda' WHEN 'communication' THEN 'communications' ELSE 'motions' END AS route, item_no > 20 AS stub FROM {RAW})
    SELECT record_id, CASE WHEN stub THEN 'archive_source' ELSE route END AS route FROM a"""
)
def x8_routed_assets(s, d):
    r = inputs.records(s, d)
    name = F.create_map(*[F.lit(x) for x in ("question_hour", "Fragestunde", "agenda_item", "Tagesordnung", "communication", "Mitteilungen")])[F.col("kind")]
    assets = r.select("record_id", "item_no", labels.asset_kind(F.coalesce(name, F.lit("Anträge")), F.lit("x.pdf")).alias("route"))
    extracted = assets.where("item_no <= 20").select("record_id")
    stubs = assets.join(extracted, "record_id", "left_anti").select("record_id", F.lit("archive_source").alias("route"))
    return assets.join(extracted, "record_id", "left_semi").select("record_id", "route").unionByName(stubs)


@query(
    f"""WITH l AS (SELECT *, last_value(CASE WHEN starts_with(line, 'Berichterstatterin') THEN substr(line, 21) END IGNORE NULLS) OVER (PARTITION BY source ORDER BY line_no) AS organ FROM {LINES})
    SELECT source, coalesce(organ, '') AS organ, {status_sql('line')} AS outcome, count(*) AS n FROM l WHERE regexp_matches(line, {q(extract.FORMAL_RESULT)}) GROUP BY ALL"""
)
def x9_decision_votes(s, d):
    organ = F.nullif(F.regexp_extract("line", "^Berichterstatterin: (.+)$", 1), F.lit(""))
    rows = segment.carried(inputs.lines(s, d), organ, "organ", ["source"], "line_no").where(F.rlike("line", F.lit(extract.FORMAL_RESULT)))
    voted = rows.select("source", F.coalesce("organ", F.lit("")).alias("organ"), F.inline(extract.votes(F.col("line"))))
    return voted.groupBy("source", "organ", "outcome").agg(F.count("*").alias("n"))


@query(
    f"""SELECT source, min_by(v, (tier, line_no)) AS value FROM (SELECT source, line_no, CASE WHEN starts_with(line, 'Betreff: ') THEN 1 ELSE 0 END AS tier, split_part(line, ': ', 2) AS v FROM {LINES} WHERE regexp_matches(line, '^(Betreff|Berichterstatterin): ')) GROUP BY source"""
)
def x12_label_tiers(s, d):
    label = F.regexp_extract("line", "^(Betreff|Berichterstatterin): ", 1)
    rows = inputs.lines(s, d).withColumn("label", label).where("label <> ''")
    value = F.split("line", ": ")[1]
    return rows.groupBy("source").agg(F.min_by(value, F.struct(F.when(F.col("label") == "Betreff", 1).otherwise(0), F.col("line_no"))).alias("value"))


@query(f"SELECT record_id FROM {REC} WHERE kind <> 'archive_source' AND NOT regexp_matches(lower(title), 'protokolle der (nicht)?öffentlichen')")
def f4_topic_records(s, d):
    from quorumlake.operators.topics import noise

    return inputs.records(s, d).where(~noise(F.col("kind"), F.col("title"))).select("record_id")


@query(f"WITH p AS (SELECT DISTINCT unnest(places) AS place FROM {REC}), a AS (SELECT DISTINCT replace(p_name, ' ', '') || 'gasse' AS place FROM part WHERE p_size > 25) SELECT place FROM p SEMI JOIN a USING (place)")
def f8_public_places(s, d):
    p = inputs.records(s, d).select(F.explode("places").alias("place")).distinct()
    allowed = inputs.table(s, d, "part").where("p_size > 25").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("gasse")).alias("place")).distinct()
    return p.join(allowed, "place", "left_semi")


@query(f"SELECT record_id, contains(lower(result_text), 'angenommen') AND NOT starts_with(status, 'accepted') AS contradicts FROM {REC}")
def f16_contradictions(s, d):
    r = inputs.records(s, d)
    return r.select("record_id", (F.contains(F.lower("result_text"), F.lit("angenommen")) & ~F.startswith("status", F.lit("accepted"))).alias("contradicts"))


@query(f"SELECT record_id, kind IN ('urgent_motion', 'agenda_item') AND date > '{TODAY}' AS pending, CASE WHEN kind IN ('urgent_motion', 'agenda_item') AND date > '{TODAY}' THEN 'pending' WHEN kind IN ('written_question', 'written_motion', 'amendment_motion', 'additional_motion') AND status = 'unknown' THEN 'assigned' ELSE status END AS status FROM {REC}")
def p24_pending(s, d):
    pending = F.col("kind").isin("urgent_motion", "agenda_item") & (F.col("date") > TODAY)
    written = F.col("kind").isin("written_question", "written_motion", "amendment_motion", "additional_motion") & (F.col("status") == "unknown")
    return inputs.records(s, d).select("record_id", pending.alias("pending"), F.when(pending, "pending").when(written, "assigned").otherwise(F.col("status")).alias("status"))


@query(
    f"""WITH w AS (SELECT id, string_split({search_text_sql('subject')}, ' ') AS w FROM {RAW}), n AS (SELECT DISTINCT p_name AS name, {search_text_sql('p_name')} AS gram FROM part),
    g AS (SELECT id, pos, array_to_string(w[pos:pos + n - 1], ' ') AS gram FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM w, (VALUES (1), (2), (3)) x(n)))
    SELECT id, name, min(pos)::INT AS first FROM g JOIN n USING (gram) GROUP BY ALL"""
)
def p29_gazetteer(s, d):
    r = inputs.raw_records(s, d).select("id", F.col("subject").alias("text"))
    return answers.gazetteer(r, inputs.table(s, d, "part").select(F.col("p_name").alias("name")))


@query(
    """SELECT conv_id, CASE WHEN bool_or(role = 'assistant') THEN 'answered_written' WHEN bool_or(role = 'system') THEN 'answered_oral' ELSE 'answer_pending_written' END AS status FROM conversations GROUP BY conv_id"""
)
def p43_question_status(s, d):
    c = inputs.table(s, d, "conversations")
    has = lambda role: F.bool_or(F.col("role") == role)
    return c.groupBy("conv_id").agg(F.when(has("assistant"), "answered_written").when(has("system"), "answered_oral").otherwise("answer_pending_written").alias("status"))


@query(
    r"""SELECT s_suppkey, regexp_replace(translate(lower(s_name), 'äöüéèáà', 'aoueeaa'), '[^a-z0-9]+', '', 'g') AS identity, CASE WHEN regexp_matches(s_name, '0$') THEN 'belegt' WHEN regexp_matches(s_name, '[1-5]$') THEN 'frei' ELSE '' END AS hint FROM supplier"""
)
def p50_garage_identities(s, d):
    sup = inputs.table(s, d, "supplier")
    identity = F.regexp_replace(F.translate(F.lower("s_name"), "äöüéèáà", "aoueeaa"), "[^a-z0-9]+", "")
    hint = F.when(F.rlike("s_name", F.lit("0$")), "belegt").when(F.rlike("s_name", F.lit("[1-5]$")), "frei").otherwise("")
    return sup.select("s_suppkey", identity.alias("identity"), hint.alias("hint"))


@query(f"SELECT record_id, person || ' brachte ein: ' || title || '. ' || result_text AS summary FROM {REC}")
def p53_summaries(s, d):
    return inputs.records(s, d).select("record_id", answers.template_summary(F.col("title"), F.col("person"), F.col("result_text")).alias("summary"))


@query(
    r"""WITH a AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\x0B\f]+', ' ', 'g')) AS t FROM documents),
    b AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?]) ([A-ZÄÖÜ])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: length(x) > 15) AS l FROM a),
    c AS (SELECT doc_id, len(l)::INT AS sentences, trim(array_to_string(l[1:2], ' ')) AS j FROM b), e AS (SELECT *, regexp_replace(regexp_extract(substr(j, 1, 260), '^(.*) [^ ]*$', 1), '[ ,;:]+$', '') AS k FROM c)
    SELECT doc_id, sentences, CASE WHEN length(j) <= 260 THEN j ELSE (CASE WHEN k <> '' THEN k ELSE substr(j, 1, 260) END) || '.' END AS summary FROM e"""
)
def p54_sentences(s, d):
    docs = inputs.table(s, d, "documents")
    return docs.select("doc_id", F.size(text.sentences(F.col("text"))).alias("sentences"), text.first_sentences(F.col("text"), 2, 260).alias("summary"))


@query(f"SELECT year, CASE WHEN kind = 'archive_source' THEN 'archive' ELSE {group_sql('status', 'result_text', 'kind')} END AS grp, count(*) AS n, max_by(record_id, (date, record_id)) AS latest FROM {REC} GROUP BY ALL")
def a20_latest_by_group(s, d):
    r = inputs.records(s, d)
    grp = F.when(F.col("kind") == "archive_source", "archive").otherwise(labels.answer_group(F.col("status"), F.col("result_text"), F.col("kind")))
    return r.groupBy("year", grp.alias("grp")).agg(F.count("*").alias("n"), F.max_by("record_id", F.struct("date", "record_id")).alias("latest"))


@query(
    f"""SELECT person, year, count_if(kind IN ('urgent_motion', 'written_motion', 'amendment_motion', 'additional_motion')) AS motions, count_if(kind IN ('written_question', 'question_hour')) AS questions,
    count_if(starts_with(status, 'accepted')) AS decided, count_if(status IN ('unknown', 'assigned', 'pending')) AS open FROM {REC} GROUP BY ALL"""
)
def a13_contributions(s, d):
    return answers.contributions(inputs.records(s, d))


@query("SELECT event_type AS kind, date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def a5_daily_kinds(s, d):
    e = inputs.table(s, d, "events")
    return e.groupBy(F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(
    f"""WITH b AS (SELECT *, CASE WHEN id % 3 = 0 THEN '' ELSE url END AS u, CASE WHEN id % 2 = 0 THEN [] ELSE amounts END AS am FROM {REC}), f AS (SELECT custkey, min_by(u, id) AS du FROM b WHERE u <> '' GROUP BY custkey), g AS (SELECT custkey, min_by(am, id) AS da FROM b WHERE len(am) > 0 GROUP BY custkey)
    SELECT record_id, CASE WHEN u = '' THEN coalesce(du, '') ELSE u END AS url, array_to_string(CASE WHEN len(am) = 0 AND da IS NOT NULL THEN da ELSE am END, ',') AS amounts FROM b LEFT JOIN f USING (custkey) LEFT JOIN g USING (custkey)"""
)
def j3_inherited_links(s, d):
    r = inputs.records(s, d).withColumns({"url": F.when(F.col("id") % 3 == 0, "").otherwise(F.col("url")), "amounts": F.when(F.col("id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.col("amounts"))})
    b = link.inherit(link.inherit(r, r, ["custkey"], ["url"], "id"), r, ["custkey"], ["amounts"], "id")
    return b.select("record_id", F.coalesce("url", F.lit("")).alias("url"), F.array_join("amounts", ",").alias("amounts"))


@query(
    f"""WITH p AS (SELECT replace(p_name, ' ', '') || 'weg' AS place, 2 AS prio, min(p_partkey)::DOUBLE AS lat FROM part GROUP BY ALL UNION ALL SELECT place, 1, min(id)::DOUBLE FROM (SELECT unnest(places) AS place, id FROM {REC}) GROUP BY place)
    SELECT place, min_by(lat, prio) AS lat FROM p GROUP BY place"""
)
def j13_place_priority(s, d):
    used = inputs.records(s, d).select(F.explode("places").alias("place"), F.col("id").cast("double").alias("lat"))
    known = inputs.table(s, d, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("weg")).alias("place"), F.col("p_partkey").cast("double").alias("lat"))
    return answers.by_priority([used, known], "place")


@query(
    f"""WITH t AS (SELECT DISTINCT p_name AS term, {search_text_sql('p_name')} AS f FROM part), a AS (SELECT id AS query_id, {search_text_sql('subject')} AS w FROM {RAW})
    SELECT query_id, term FROM a JOIN t ON contains(' ' || w || ' ', ' ' || f || ' ') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY length(f) DESC, term) = 1"""
)
def j18_focus(s, d):
    asked = inputs.raw_records(s, d).select(F.col("id").alias("query_id"), F.col("subject").alias("query"))
    return answers.focus_terms(asked, inputs.table(s, d, "part").select(F.col("p_name").alias("term")).distinct())


@query(
    f"""WITH s AS (SELECT doc_id AS source_id, coalesce(source, '') AS title, {search_text_sql("coalesce(source, '') || ' ' || coalesce(text, '')")} AS f, {search_text_sql("coalesce(source, '')")} AS tf FROM documents),
    a AS (SELECT item_id AS query_id, trim(regexp_replace(text, '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g')) AS query FROM benchmark),
    k AS (SELECT query_id, {search_text_sql('query')} AS whole, list_filter(list_distinct(regexp_extract_all({fold_sql('query')}, '[\\p{{L}}\\p{{N}}_-]+', 0)), lambda t: length(t) >= 4 AND t NOT IN ({', '.join(q(w) for w in text.QUERY_STOPWORDS)})) AS l FROM a),
    w AS (SELECT query_id, unnest(l) AS word FROM k), d AS (SELECT source_id, unnest(list_distinct(string_split(f, ' '))) AS word FROM s), h AS (SELECT source_id, unnest(list_distinct(string_split(tf, ' '))) AS word FROM s),
    m AS (SELECT query_id, w.word, d.source_id, h.word IS NOT NULL AS th FROM w JOIN d USING (word) LEFT JOIN h ON h.source_id = d.source_id AND h.word = w.word),
    c AS (SELECT query_id, source_id, count(*) AS matched, count_if(th) AS heads FROM m GROUP BY ALL),
    r AS (SELECT c.query_id, c.source_id, matched, len(l) AS n, ((CASE WHEN length(whole) >= 6 AND contains(f, whole) THEN 8 ELSE 0 END) + 3 * heads + matched + CASE WHEN matched = len(l) THEN 4 ELSE 0 END)::BIGINT AS score FROM c JOIN k USING (query_id) JOIN s USING (source_id))
    SELECT query_id, source_id, score, matched FROM r WHERE score >= CASE WHEN n <= 2 THEN 1 ELSE greatest(2, ceil(0.35 * n)) END"""
)
def q11_question_scores(s, d):
    from quorumlake.plans.queries import _asked

    docs = inputs.table(s, d, "documents").select(F.col("doc_id").alias("source_id"), F.coalesce("source", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("body"))
    return answers.question_scores(_asked(s, d), docs)


@query(f"SELECT id AS answer_id, unnest([item_no % 5 + 1, 9]) AS source_no, unnest([0, 1]) AS place FROM {RAW} WHERE item_no % 5 <> 8")
def q15_citations(s, d):
    n = (F.col("item_no") % 5 + 1).cast("string")
    said = F.concat(F.lit("Siehe ["), n, F.lit("] und Quelle 9, nochmals ["), n, F.lit("]."))
    return answers.citations(inputs.raw_records(s, d).select(F.col("id").alias("answer_id"), said.alias("answer")))


@query(
    f"""WITH u AS (SELECT 'record' AS source, record_id AS key, title FROM {REC} UNION ALL SELECT 'service', 's' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'garage', 'p' || p_partkey, p_name FROM part)
    SELECT source, count(*) AS n, count(DISTINCT lower(title)) AS titles FROM u GROUP BY source"""
)
def u1_all_sources(s, d):
    r = inputs.records(s, d).select(F.lit("record").alias("source"), F.col("record_id").alias("key"), "title")
    sup = inputs.table(s, d, "supplier").select(F.lit("service").alias("source"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_name").alias("title"))
    part = inputs.table(s, d, "part").select(F.lit("garage").alias("source"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("title"))
    return r.unionByName(sup).unionByName(part).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct(F.lower("title")).alias("titles"))


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def u8_repeated_names(s, d):
    return inputs.table(s, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


@query(f"SELECT record_id || ':' || field AS chunk_id, weight::DOUBLE AS weight, text FROM (SELECT record_id, unnest(['titel', 'ergebnis', 'geschaeftszahlen', 'orte', 'einbringer']) AS field, unnest([5.0, 3.0, 5.0, 4.0, 3.0]) AS weight, trim(unnest([title, result_text, array_to_string(numbers, ' '), array_to_string(places, ' '), submitter])) AS text FROM {REC}) WHERE text <> ''")
def q1_search_chunks(s, d):
    fields = {"titel": F.col("title"), "ergebnis": F.col("result_text"), "geschaeftszahlen": F.array_join("numbers", " "), "orte": F.array_join("places", " "), "einbringer": F.col("submitter")}
    return search.chunks(inputs.records(s, d), fields).select("chunk_id", "weight", "text")


@query(f"SELECT record_id, i - 1 AS place, 'votes[' || (i - 1) || '].' || c || ' fehlt' AS error FROM (SELECT record_id, len(regexp_extract_all(body, {q(extract.FORMAL_RESULT)}, 0)) AS n, id FROM {RAW}), (VALUES (1)) v(i), (VALUES ('subject', 3), ('outcome', 4)) x(c, k) WHERE n >= 1 AND id % k = 0")
def v1_vote_errors(s, d):
    r = inputs.records(s, d)

    def damaged(v):
        return F.struct(F.when(F.col("id") % 3 != 0, v["subject"]).alias("subject"), F.when(F.col("id") % 4 != 0, v["outcome"]).otherwise("").alias("outcome"))

    votes = F.transform(extract.votes(F.col("body")), damaged)
    found = r.select("record_id", F.explode(quality.vote_errors(votes)).alias("error"))
    return found.select("record_id", F.regexp_extract("error", "votes.([0-9]+)", 1).cast("int").alias("place"), "error")


@query(
    f"""SELECT 'official-' || substr(regexp_replace(regexp_replace(lower(subject), '[^a-z0-9äöüß]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) || '-' || date AS feed_id, coalesce(nullif(section, ''), 'Ohne Bereich') AS area, date AS "start" FROM {RAW} WHERE kind = 'communication'"""
)
def k8_public_feed(s, d):
    r = inputs.records(s, d).where("kind = 'communication'")
    return r.select(F.concat_ws("-", F.lit("official"), text.slug(F.col("subject")), "date").alias("feed_id"), F.coalesce(F.nullif("section", F.lit("")), F.lit("Ohne Bereich")).alias("area"), F.col("date").alias("start"))


@query(
    f"""SELECT record_id, CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.TYPE_LABELS.items())} ELSE kind END AS typ, CASE status {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in extract.OUTCOME_LABELS.items())} ELSE status END AS ergebnis, title AS titel, date AS datum, category AS kategorie, array_to_string(places, ', ') AS orte FROM {REC}"""
)
def k14_presentation(s, d):
    r = inputs.records(s, d)
    return r.select("record_id", extract.label(F.col("kind"), labels.TYPE_LABELS).alias("typ"), extract.label(F.col("status"), extract.OUTCOME_LABELS).alias("ergebnis"), F.col("title").alias("titel"), F.col("date").alias("datum"), F.col("category").alias("kategorie"), F.array_join("places", ", ").alias("orte"))


@query(f"SELECT record_id, pos::INT AS pos, value FROM (SELECT record_id, unnest(places) AS value, unnest(range(0, len(places))) AS pos FROM {REC})")
def k3_star_places(s, d):
    return sinks.star_tables(inputs.records(s, d).withColumn("votes", extract.votes(F.col("body"))))["locations"]


@query(f"SELECT source_file AS value FROM (SELECT DISTINCT source_file FROM {RAW}) ORDER BY value DESC LIMIT 900")
def a9_suggestion_values(s, d):
    return facets.facet(inputs.records(s, d), "source_file").select("value").orderBy(F.col("value").desc()).limit(900)


@query(f"SELECT record_id FROM {REC} ORDER BY CASE WHEN starts_with(status, 'accepted') THEN 0 WHEN starts_with(status, 'rejected') THEN 1 ELSE 2 END, date DESC, lower(title), record_id LIMIT 50")
def o5_answer_order(s, d):
    r = inputs.records(s, d)
    priority = labels.decision(F.col("status"), F.lit(False))["priority"]
    return r.orderBy(priority, F.col("date").desc(), F.lower("title"), "record_id").select("record_id").limit(50)


@query(f"SELECT record_id, CASE WHEN date < '{TODAY}' THEN 'abgeschlossen' WHEN date = '{TODAY}' THEN 'aktuell' ELSE 'kuenftig' END AS status FROM {RAW}")
def p22_time_status(s, d):
    r = inputs.records(s, d)
    return r.select("record_id", dates.period_status(F.lit(""), F.col("date"), F.col("date"), F.lit(TODAY)).alias("status"))

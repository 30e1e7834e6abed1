"""Registered queries that write what they derive from the tables as files of a source's format and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorumlake.functions import extract
from quorumlake.plans import inputs
from quorumlake.plans.queries import RAW, REC, query, squeeze_sql
from quorumlake.storage import new_path, stored
from quorumlake.sources import readers, sinks
from quorumlake.streaming import incremental


@query(f"SELECT record_id, kind AS record_type, date AS meeting_date, title, array_to_string(numbers, ',') AS numbers FROM {REC}")
def s1_k1_record_lines(s, d):
    r = inputs.records(s, d)
    path = new_path(s, "records")
    named = r.select("record_id", F.col("kind").alias("record_type"), F.col("date").alias("meeting_date"), "date", "title", F.col("numbers").alias("business_numbers"), "status")
    sinks.write_records(named, path)
    return readers.records(s, path).select("record_id", "record_type", "meeting_date", "title", F.array_join("business_numbers", ",").alias("numbers"))


@query(f"SELECT url, date AS meeting_date, title FROM {REC}")
def s2_index_documents(s, d):
    path = new_path(s, "index")
    links = inputs.records(s, d).select("url", F.col("date").alias("meeting_date"), "title")
    # One document per year, as one page of an archive each.
    documents = links.groupBy(F.substring("meeting_date", 1, 4).alias("year")).agg(F.collect_list(F.struct("url", "meeting_date", "title")).alias("assets"))
    documents.select("assets").write.option("maxRecordsPerFile", 1).json(path)
    return readers.index_document(s, path, "assets", "struct<url:string,meeting_date:string,title:string>")


@query(f"SELECT item_id::VARCHAR AS id, {squeeze_sql('text')} AS question, 'r' || item_id AS expected FROM benchmark")
def s3_gold_queries(s, d):
    path = new_path(s, "gold")
    b = inputs.table(s, d, "benchmark")
    one = F.struct(F.col("item_id").cast("string").alias("id"), F.trim(F.regexp_replace("text", r"[ \t\n\r\x0B\f]+", " ")).alias("question"), F.array(F.concat(F.lit("r"), F.col("item_id").cast("string"))).alias("expected_record_ids"))
    documents = b.groupBy(F.pmod("item_id", F.lit(16)).alias("part")).agg(F.collect_list(one).alias("queries"))
    documents.select("queries").write.option("maxRecordsPerFile", 1).json(path)
    return readers.gold_queries(s, path).select("id", "question", F.array_join("expected", ",").alias("expected"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT trim(regexp_replace(line, '[ \t\r\f]+', ' ', 'g')) AS line FROM l)
    SELECT line, count(*) AS n FROM t WHERE NOT regexp_matches(line, '^([0-9]{1,4}|Seite [0-9]+( von [0-9]+)?)?$') GROUP BY line""")
def s5_page_lines(s, d):
    path = new_path(s, "pages")
    inputs.table(s, d, "documents").where("text IS NOT NULL").select("text").write.text(path)
    return readers.page_lines(s, path).groupBy("line").agg(F.count("*").alias("n"))


@query(f"SELECT record_id AS source_file, subject AS text FROM {RAW} WHERE id % 4 <> 0")
def s4_v4_word_files(s, d):
    import io
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    @F.udf("binary")
    def packed(said: str, broken: bool):
        if broken:
            return bytearray(b"no zip file")
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>{said}</w:t></w:r></w:p><w:p/></w:body></w:document>')
        return bytearray(data.getvalue())

    files = inputs.raw_records(s, d).select(F.col("record_id").alias("path"), packed("subject", F.col("id") % 4 == 0).alias("content"))
    found = readers.word_paragraphs(files)
    return found.where("error = ''").select("source_file", "text")


@query(f"SELECT title, 'https://x.org/' || id AS link, date FROM (SELECT *, trim(subject) AS title FROM {RAW}) WHERE id % 6 <> 0")
def s11_news_items(s, d):
    path = new_path(s, "news")
    r = inputs.raw_records(s, d)
    title = F.when(F.col("id") % 6 != 0, F.concat(F.lit("<title> "), "subject", F.lit("</title>"))).otherwise("")
    item = F.concat(F.lit("<item>"), title, F.lit("<link>https://x.org/"), F.col("id").cast("string"), F.lit("</link><pubDate>Mon, "), F.date_format(F.to_date("date"), "d MMM yyyy"), F.lit(" 10:00:00 +0100</pubDate></item>"))
    # One feed per month.
    feeds = r.groupBy(F.substring("date", 1, 7).alias("month")).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("value"))
    feeds.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.news_items(s, path).select("title", "link", "date")


@query("SELECT s_suppkey, s_acctbal::VARCHAR AS s_acctbal, '-' AS tags FROM supplier")
def k6_csv_cells(s, d):
    path = new_path(s, "csv")
    rows = inputs.table(s, d, "supplier").select("s_suppkey", "s_acctbal", F.array().cast("array<string>").alias("tags"))
    sinks.write_csv(rows, path)
    cells = s.read.option("sep", ";").option("header", True).schema("s_suppkey string, s_acctbal string, tags string").csv(path)
    return cells.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_acctbal", "tags")


_STREAMED = ["record_id", "date", "kind", "status", "title", "confidence"]
_STREAM_SCHEMA = "record_id string, date string, kind string, status string, title string, confidence double"


def _streamed(s, d, views=()):
    """Later records arrive in four files, two a batch, some without an id, some invalid, some twice; the last batch is played again. Returns the table and the folder of the views."""
    source, path, state, rejects, folder = (new_path(s, name) for name in ("arrived", "table", "state", "rejected", "views"))
    r = inputs.records(s, d).withColumn("confidence", F.lit(0.5))
    table = incremental.Versions(s, path, r.select(*_STREAMED).schema)
    table.write(-1, r.where("date < '2000-01-01'").select(*_STREAMED))
    new = r.where("date >= '2000-01-01'").withColumn("kind", F.when(F.col("id") % 12 == 0, "xx").otherwise(F.col("kind")))
    new = new.withColumn("record_id", F.when(F.col("id") % 50 == 1, "").otherwise(F.col("record_id")))
    again = new.where("id % 7 = 0 AND record_id <> ''")
    new.unionByName(again).select(*_STREAMED).repartition(4, "record_id", "title").write.json(source)
    required = ("record_id", "title")
    incremental.run_updates(s, source, _STREAM_SCHEMA, table, state, required, rejects, views, folder, files=2).awaitTermination()
    last = table.numbers()[-1]
    incremental.update_step(table, stored(table.parts([last]), "replayed"), last, required, rejects, views, folder)
    return table, folder


@query(f"SELECT CASE WHEN date >= '2000-01-01' AND id % 50 = 1 THEN '' ELSE record_id END AS record_id FROM {RAW} WHERE date < '2000-01-01' OR id % 12 <> 0")
def t1_streamed_updates(s, d):
    """Files of later records, added by the stream to the earlier ones in several batches."""
    return _streamed(s, d)[0].all().select("record_id")


_ALL = f"SELECT * FROM {RAW} WHERE date < '2000-01-01' OR id % 12 <> 0"


@query(f"""WITH r AS ({_ALL}) SELECT 'counts' AS view, kind AS key, count(*) AS n FROM r GROUP BY kind UNION ALL SELECT 'largest', kind, n FROM (SELECT kind, count(*) AS n FROM r GROUP BY kind ORDER BY n DESC, kind LIMIT 3)""")
def t3_streamed_views(s, d):
    """Views that depend on each other, made anew with each batch; one fails at run time, and what needs it is skipped."""
    views = [
        incremental.View("largest", lambda t: t["counts"].orderBy(F.col("n").desc(), "key").limit(3), ("counts",)),
        incremental.View("counts", lambda t: t["records"].groupBy(F.col("kind").alias("key")).agg(F.count("*").alias("n")), ("records",)),
        incremental.View("broken", lambda t: t["records"].select(F.assert_true(F.col("kind") == "none").cast("string").alias("x")), ("records",)),
        incremental.View("needs_broken", lambda t: t["broken"], ("broken",)),
    ]
    _, folder = _streamed(s, d, views)
    log = s.read.parquet(f"{folder}/log").groupBy("view").agg(F.collect_set("outcome").alias("seen")).collect()
    if {r.view: r.seen for r in log} != {"counts": ["made"], "largest": ["made"], "broken": ["failed"], "needs_broken": ["skipped"]}:
        raise ValueError(f"unexpected outcomes: {log}")
    newest = [incremental.Versions(s, f"{folder}/{name}", s.createDataFrame([], "key string, n long").schema).last().select(F.lit(name).alias("view"), "key", "n") for name in ("counts", "largest")]
    return newest[0].unionByName(newest[1])


@query(f"SELECT kind, pos::INT AS pos, count(*) AS n FROM (SELECT 'business_numbers' AS kind, unnest(range(0, len(numbers))) AS pos FROM {REC} UNION ALL SELECT 'amounts', unnest(range(0, len(amounts))) FROM {REC}) GROUP BY ALL UNION ALL SELECT 'meetings', 0, count(DISTINCT date) FROM {REC}")
def k3_star_written(s, d):
    path = new_path(s, "star")
    sinks.write_star(inputs.records(s, d).withColumn("votes", extract.votes(F.col("body"))), path)
    values = [s.read.parquet(f"{path}/{kind}").select(F.lit(kind).alias("kind"), "pos") for kind in ("business_numbers", "amounts")]
    counted = values[0].unionByName(values[1]).groupBy("kind", "pos").agg(F.count("*").alias("n"))
    meetings = s.read.parquet(f"{path}/meetings").agg(F.count("*").alias("n")).select(F.lit("meetings").alias("kind"), F.lit(0).alias("pos"), "n")
    return counted.unionByName(meetings)

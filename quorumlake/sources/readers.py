"""Readers of civic sources as DataFrames. Schemas are given, never inferred."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorumlake.functions import text

VOTE = "struct<subject:string,outcome:string,approval:array<string>,against:array<string>,abstention:array<string>,raw_text:string>"
RECORD = (
    "record_id string, record_type string, source_file string, meeting_date string, section string, agenda_item_no int, business_numbers array<string>, title string, "
    f"status string, status_text string, result_text string, raw_result_text string, votes array<{VOTE}>, amounts array<string>, locations array<string>, source_snippet string, "
    "parser_confidence double, location_details array<struct<type:string,value:string,context:string,confidence:double>>, result_source string, portal_url string, "
    "portal_business_number string, portal_match_score double, protocol_result_text string, source_url string, source_page int, local_source_url string, submitter string, "
    "addressee string, question_parts map<string,string>, attachment_titles array<string>"
)


def records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of records; blank lines are skipped, what can't be read becomes null."""
    return spark.read.schema(RECORD).option("mode", "PERMISSIVE").json(path)


def index_document(spark: SparkSession, path: str, entries: str, kind: str) -> DataFrame:
    """The rows of one array in a JSON document."""
    document = spark.read.schema(f"{entries} array<{kind}>, errors array<struct<url:string,error:string>>").option("multiLine", True).json(path)
    return document.select(F.inline(entries))


def gold_queries(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, expected, tags) of a gold standard; rows without id, question or expectation, or with a repeated id, fail the job."""
    kind = "struct<id:string,question:string,expected_record_ids:array<string>,tags:array<string>>"
    rows = index_document(spark, path, "queries", kind).withColumnRenamed("expected_record_ids", "expected")
    bad = rows.where((text.text(F.col("id")) == "") | (text.text(F.col("question")) == "") | (F.coalesce(F.size("expected"), F.lit(0)) <= 0))
    twice = rows.groupBy("id").count().where("count > 1")
    if not bad.isEmpty() or not twice.isEmpty():
        raise ValueError("gold standard: an id, question or expectation is missing, or an id is repeated")
    return rows


def _paragraphs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    for frame in frames:
        out = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            try:
                root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
                out.append((path, -1, "", "", str(error)))  # one bad file doesn't stop the run
                continue
            for k, p in enumerate(root.iter(f"{w}p")):
                style = p.find(f"{w}pPr/{w}pStyle")
                said = "".join("\t" if x.tag == f"{w}tab" else "\n" if x.tag == f"{w}br" else x.text or "" for x in p.iter() if x.tag in (f"{w}t", f"{w}tab", f"{w}br"))
                if said.strip():
                    out.append((path, k, "" if style is None else style.get(f"{w}val", ""), said.strip(), ""))
        yield pd.DataFrame(out, columns=["source_file", "para_idx", "style", "text", "error"])


def word_paragraphs(files: DataFrame) -> DataFrame:
    """(source_file, para_idx, style, text, error) of Word files given as (path, content)."""
    return files.select("path", "content").mapInPandas(_paragraphs, "source_file string, para_idx int, style string, text string, error string")


def page_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, page, line_no, line) of text files: page 0, blank lines and bare page numbers left out."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    lines = files.withColumn("line", F.trim(F.regexp_replace("line", r"[ \t\r\f]+", " ")))
    return lines.where(~F.rlike("line", F.lit("^([0-9]{1,4}|Seite [0-9]+( von [0-9]+)?)?$"))).select("source", F.lit(0).alias("page"), "line_no", "line")


def parking(spark: SparkSession, path: str, delimiter: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """Garages (name, address, lon, lat, kind, origin) of a CSV with decimal commas; rows without name or place are dropped."""
    raw = spark.read.option("sep", delimiter).option("encoding", encoding).option("header", True).schema("NAME string, ANSCHRIFT string, PHI string, LAMBDA string, KAT3 string, HERKUNFT string").csv(path)
    return garages(raw)


def decimal(value: Column) -> Column:
    return F.replace(F.trim(text.text(value)), F.lit(","), F.lit(".")).try_cast("double")


def garages(raw: DataFrame) -> DataFrame:
    name = F.trim(F.replace(text.squeeze(F.col("NAME")), F.lit("(TG)"), F.lit("TG")))
    rows = raw.select(name.alias("name"), text.squeeze(F.col("ANSCHRIFT")).alias("address"), decimal(F.col("PHI")).alias("lat"), decimal(F.col("LAMBDA")).alias("lon"), F.col("KAT3").alias("kind"), F.col("HERKUNFT").alias("origin"))
    return rows.where((F.col("name") != "") & F.col("lat").isNotNull() & F.col("lon").isNotNull())


OSM = "elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"


def osm_elements(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """(id, lat, lon, name, tags) of named elements; a way's place is its centre."""
    rows = documents.select(F.inline(F.from_json(json_col, OSM)["elements"]))
    named = rows.select("id", F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"), text.squeeze(F.col("tags")["name"]).alias("name"), "tags")
    return named.where((F.col("name") != "") & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def health_kind(tags: Column) -> Column:
    """pharmacy, doctor or hospital by tags, else null."""
    amenity, care = F.coalesce(tags["amenity"], F.lit("")), F.coalesce(tags["healthcare"], F.lit(""))
    return F.when((amenity == "pharmacy") | (care == "pharmacy"), "pharmacy").when(amenity.isin("doctors", "clinic", "dentist") | care.isin("doctor", "clinic", "dentist"), "doctor").when((amenity == "hospital") | (care == "hospital"), "hospital")


def news_items(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, description, date) of an RSS feed's items with title and link."""
    raw = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string").load(path)
    said = F.regexp_extract("pubDate", r"([0-9]{1,2} [A-Za-z]{3} [0-9]{4})", 1)
    date = F.coalesce(F.date_format(F.try_to_date(said, "d MMM yyyy"), "yyyy-MM-dd"), F.lit(""))
    items = raw.select(text.squeeze(F.col("title")).alias("title"), F.trim(text.text(F.col("link"))).alias("link"), text.squeeze(F.col("description")).alias("description"), date.alias("date"))
    return items.where((F.col("title") != "") & (F.col("link") != ""))


def file_links(links: DataFrame) -> DataFrame:
    """(file_name, url): the local names that a link's copy can have."""
    stem = F.concat_ws("_", "date", F.substring(F.regexp_replace(F.lower("title"), "[^a-z0-9äöüß]+", "-"), 1, 60), F.substring(F.sha1("url"), 1, 10))
    return links.select(F.explode(F.transform(F.array(F.lit("pdf"), F.lit("txt")), lambda s: F.concat(stem, F.lit("."), s))).alias("file_name"), "url")


def first_files(files: DataFrame, endings: tuple[str, ...], most: int | None = None) -> DataFrame:
    """(path, place) of files with one of the endings, by name; the first most of them."""
    kept = files.where(F.rlike(F.lower("path"), F.lit("(" + "|".join(e.replace(".", "[.]") for e in endings) + ")$")))
    kept = kept.orderBy("path").limit(most) if most is not None else kept
    return kept.withColumn("place", F.row_number().over(Window.orderBy("path")))


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of fixed rows, for a broadcast join."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def cached(requested: DataFrame, snapshot: DataFrame, load: Callable[[], DataFrame], version: int, column: str = "date") -> DataFrame:
    """The snapshot's rows of the requested dates if it has this version and all of them, else what load() reads."""
    held = snapshot.where(F.col("cache_version") == version)
    if requested.join(held.select(column).distinct(), column, "left_anti").isEmpty():
        return held.drop("cache_version").join(requested.distinct(), column, "left_semi")
    return load()


def parking_documents(files: DataFrame) -> DataFrame:
    """Garages of CSV files given as content: UTF-8 with or without a mark, else Latin 1; semicolons, or commas where the first line has more of them."""
    plain = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    lines = F.split(F.regexp_replace(plain, "^\ufeff", ""), "\r?\n")
    commas = F.length(F.regexp_replace(lines[0], "[^,]", "")) > F.length(F.regexp_replace(lines[0], "[^;]", ""))
    rows = files.select(commas.alias("commas"), F.explode(F.slice(lines, 2, F.size(lines))).alias("line")).where("line <> ''")
    schema = "NAME string, ANSCHRIFT string, PHI string, LAMBDA string, KAT3 string, HERKUNFT string"
    raw = F.when(F.col("commas"), F.from_csv("line", schema, {"sep": ","})).otherwise(F.from_csv("line", schema, {"sep": ";"}))
    return garages(rows.select(raw.alias("r")).select("r.*"))

"""The corpus operators' registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, infill, language, licenses, mtree, prefixes, resampling, secrets
from .html_text import extract_text
from .minhash import near_duplicates
from .mixing import mix_sources
from .packing import pack_documents
from .suffix_dedup import remove_repeats


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = language.train(docs.where(~language.held_out()))
    return language.identify(docs, model, keep=["doc_id"]).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = _documents(spark, sf_dir).select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), audio.wav(audio.text_payload(F.col("text"))).alias("media"))
    found = audio.audio_features(media)
    held = F.aggregate("spans", F.lit(0.0), lambda a, x: a + x["end"] - x["start"])
    feature = F.format_string("%d|%.3f|%.3f", F.size("spans"), held, F.col("level"))
    stored = [F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")]
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", *stored, feature.alias("feature"), "spans", "tensors")


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir))


def op7_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = mtree.whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return mtree.top_inner_products(vectors, vectors.where("vec_id % 20 = 0"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("found", lambda x: x["ord"] < len(secrets.BASE))
    counts = [F.size(F.filter("found", lambda x: x["kind"] == rule.kind)).cast("long").alias(f"n_{rule.kind}") for rule in secrets.BASE]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("found")).alias("spans"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(_documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"])
    text = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    found = prefixes.prefix_counts(_documents(spark, sf_dir).select("doc_id", "text", size), keep=["doc_id", "n_bytes"])
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


QUERIES = {
    "op1_html": op1_html,
    "op2_language": op2_language,
    "op3_mixing": op3_mixing,
    "op4_minhash": op4_minhash,
    "op5_media": op5_media,
    "op6_suffixes": op6_suffixes,
    "op7_mtree": op7_mtree,
    "op8_licenses": op8_licenses,
    "op9_secrets": op9_secrets,
    "op10_packing": op10_packing,
    "op11_infill": op11_infill,
    "op12_resampling": op12_resampling,
    "op13_tokens": op13_tokens,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Splits the lower-cased text into its words.
_WORDS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_MIXING = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, sid % 3 + 1 AS weight, 3 * n AS cap, (sum(n) OVER ())::BIGINT AS total FROM s),
p AS (SELECT *, row_number() OVER o AS place, (total - (sum(cap) OVER o - cap))::BIGINT / (sum(weight) OVER ()  - (sum(weight) OVER o - weight))::BIGINT AS share
      FROM w WINDOW o AS (ORDER BY cap / weight, sid ROWS UNBOUNDED PRECEDING)),
f AS (SELECT min(place) AS first_free FROM p WHERE share * weight <= cap),
t AS (SELECT p.source, p.n, coalesce(CASE WHEN place < first_free THEN cap::DOUBLE ELSE weight * (SELECT share FROM p WHERE place = first_free) END, 0) AS target FROM p, f),
b AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole FROM t),
g AS (SELECT d.source, d.h, sum(size)::BIGINT AS n FROM d GROUP BY ALL),
c AS (SELECT g.*, b.target - b.whole * b.n AS rest, sum(g.n) OVER (PARTITION BY g.source ORDER BY g.h) - g.n AS before FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source),
e AS (SELECT source, min(h) AS edge, bool_or(false) AS x FROM c WHERE before + n > rest GROUP BY source),
k AS (SELECT e.source, e.edge, 2 * (c.rest - c.before) >= c.n AS edge_in FROM e JOIN c ON c.source IS NOT DISTINCT FROM e.source AND c.h = e.edge)
SELECT d.doc_id, d.size, b.n AS source_size, b.target,
       (least(3, b.whole + CASE WHEN k.edge IS NULL OR d.h < k.edge OR (d.h = k.edge AND k.edge_in) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans_sql() -> str:
    """One select per rule: matches, what lies between them, and from both the positions."""
    sides = []
    for k, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("(?i)(password|passwd|secret|token|api_?key)", "(" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY])")
        sides.append(f"SELECT doc_id, '{rule.kind}' AS kind, {k} AS ord, {rule.least} AS least, regexp_extract_all(t, {_quoted(pattern)}, 0) AS m, regexp_extract_all(t, {_quoted(pattern)}, {rule.group}) AS g, string_split_regex(t, {_quoted(pattern)}) AS b FROM d")
    return " UNION ALL ".join(sides)


def _licenses_sql() -> str:
    def canonical(text: str) -> str:
        x = f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
        for pattern in (licenses.COPYRIGHT_LINE, licenses.RESERVED_LINE):
            x = f"regexp_replace({x}, {_quoted(pattern)}, chr(10), 'g')"
        x = f"' ' || regexp_replace({x}, '[^a-z0-9]+', ' ', 'g') || ' '"
        for a, b in licenses.EQUIVALENT:
            x = f"replace({x}, ' {a} ', ' {b} ')"
        return f"sha256(trim(regexp_replace({x}, ' +', ' ', 'g')))"

    rows = ", ".join(f"({_quoted(name)}, {_quoted(body)})" for name, title, text in licenses.KNOWN for body in (text, f"{title}\n\n{text}"))
    return f"""
WITH k AS (SELECT DISTINCT {canonical('body')} AS digest, name FROM (VALUES {rows}) v(name, body)),
d AS (SELECT doc_id, {canonical('text')} AS digest FROM documents)
SELECT d.doc_id, d.digest, k.name AS license FROM d LEFT JOIN k ON d.digest = k.digest"""


_INFILL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS us, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(us)::BIGINT AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS i, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) AS j FROM u),
p AS (SELECT *, array_to_string(us[1:i], '') AS p, array_to_string(us[i + 1:j], '') AS m, array_to_string(us[j + 1:], '') AS s,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

ORACLE_SQL = {
    "op11_infill": _INFILL,
    "op3_mixing": _MIXING,
    "op4_minhash": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
         JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
         GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
""",
    "op7_mtree": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
""",
    "op8_licenses": _licenses_sql(),
    "op9_secrets": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({_spans_sql()}),
x AS (SELECT doc_id, kind, ord, least, m, g, b, unnest(range(1, len(m) + 1)) AS i FROM r WHERE len(m) > 0),
p AS (SELECT doc_id, kind, ord, length(g[i]) AS part, length(m[i]) AS whole, least,
        list_sum(list_transform(b[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS a FROM x),
s AS (SELECT doc_id, kind, ord, a::BIGINT AS a, kind || ':' || a::BIGINT || ':' || (a + whole)::BIGINT AS e FROM p WHERE part >= least),
o AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
        coalesce(string_agg(e, ',' ORDER BY a, ord) FILTER (ord < 3), '') AS base, string_agg(e, ',' ORDER BY a, ord) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (doc_id)
""",
}

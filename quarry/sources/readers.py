"""Sources: binary files, documents, delimited text, logs, tables in Markdown, XML dumps, JSON lines, inline rows, stored corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans.registry import query, table

#: First bytes of file kinds (hexadecimal), then file endings.
MAGIC = [("255044462D", "application/pdf"), ("504B0304", "application/zip"), ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("1F8B", "application/gzip"), ("425A68", "application/x-bzip2")]
ENDINGS = [("md", "text/markdown"), ("txt", "text/plain"), ("csv", "text/csv"), ("tsv", "text/tab-separated-values"), ("json", "application/json"), ("jsonl", "application/x-ndjson"), ("html", "text/html"), ("xml", "application/xml"), ("log", "text/x-log"), ("py", "text/x-python"), ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"), ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet")]


def walk_files(spark: SparkSession, path: str, most_bytes: int, pattern: str = "*") -> DataFrame:
    """Files below path of at most most_bytes, with their SHA-256 and media type; larger ones are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).where(F.col("length") <= most_bytes)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"), media_type(F.col("path"), F.col("content")).alias("media_type"))


def media_type(path: Column, content: Column) -> Column:
    """By first bytes, then by ending."""
    head = F.hex(F.substring(content, 1, 8))
    ending = F.lower(F.element_at(F.split(path, r"\."), -1))
    out = F.when(F.length(content) == 0, "inode/x-empty")
    for magic, kind in MAGIC:
        out = out.when(head.startswith(magic), kind)
    for e, kind in ENDINGS:
        out = out.when(ending == e, kind)
    return out.otherwise(F.when(looks_binary(content), "application/octet-stream").otherwise("text/plain"))


def looks_binary(content: Column) -> Column:
    """More than 8 % of the first 4 KiB are control bytes, read as pairs of hexadecimal digits."""
    head = F.hex(F.substring(content, 1, 4096))
    odd = F.regexp_count(F.regexp_replace(head, "(..)", "$1 "), F.lit(r"\b(0[0-8BEF]|1[0-9A-F]|7F) "))
    return odd > 0.08 * F.greatest(F.length(head) / 2, F.lit(1))


def decode_text(content: Column) -> Column:
    """UTF-16LE with its mark, else UTF-8 without its mark; NUL to a space, CRLF to LF."""
    wide = F.hex(F.substring(content, 1, 2)) == "FFFE"
    text = F.when(wide, F.decode(F.substring(content, 3, 1 << 30), "UTF-16LE")).otherwise(F.decode(content, "UTF-8"))
    return F.translate(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "^\ufeff", ""), "\0", " ")


def pages_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page, start, text): form-feed pages with the code point at which each starts."""
    rows = docs.select(key, F.posexplode(F.split("text", "\f")).alias("page", "body"))
    before = Window.partitionBy(key).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(key, "page", F.coalesce(F.sum(F.length("body") + 1).over(before), F.lit(0)).cast("long").alias("start"), F.col("body").alias("text"))


def sniff_delimiter(line: Column) -> Column:
    """The most frequent of comma, tab and semicolon; comma wins ties, then tab."""
    n = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    return F.when((n(",") >= n("\t")) & (n(",") >= n(";")), ",").when(n("\t") >= n(";"), "\t").otherwise(";")


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """CSV, TSV or semicolon-separated text with a header and quotes; the first line decides the delimiter."""
    first = spark.read.text(path).select(sniff_delimiter(F.col("value")).alias("d")).first()
    return spark.read.csv(path, sep=first["d"] if first else ",", header=True, quote='"', escape='"')


def markdown_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, cells) of pipe tables in texts: lines between two pipes that are not the rule below the header."""
    rows = docs.select(key, F.posexplode(F.split("text", "\n")).alias("line", "s")).withColumn("s", F.trim("s"))
    table_line = F.col("s").rlike(r"^\|.*\|$") & ~F.col("s").rlike(r"^\|[\s:|-]+\|$")
    cells = F.transform(F.split(F.expr("substring(s, 2, length(s) - 2)"), r"\|"), lambda x: F.trim(x))
    return rows.where(table_line).select(key, "line", cells.alias("cells"))


LOG = r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d\S*)\s+\[?(DEBUG|INFO|WARN|ERROR)\]?\s+(?:\[?([\w.]+)\]?:\s+)?(.*)$"


def parse_logs(lines: DataFrame, column: str = "value") -> DataFrame:
    """(at, severity, component, message, attributes) of ISO-stamped lines; k=v words become attributes."""
    part = lambda i: F.regexp_extract(column, LOG, i)
    pairs = F.regexp_extract_all(part(4), F.lit(r"(\w+=\S+)"), F.lit(1))
    rows = lines.where(F.col(column).rlike(LOG)).select(part(1).alias("at"), part(2).alias("severity"), F.nullif(part(3), F.lit("")).alias("component"), part(4).alias("message"), pairs.alias("pairs"))
    return rows.withColumn("attributes", F.map_from_entries(F.transform("pairs", lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring_index(x, "=", -1).alias("v"))))).drop("pairs")


def read_wiki_dump(spark: SparkSession, path: str, least_chars: int = 1) -> DataFrame:
    """(id, title, text) of the articles of a MediaWiki XML dump, plain or bzip2: namespace 0, no redirects, not too short."""
    schema = "id long, ns int, title string, redirect struct<_title: string>, revision struct<text: struct<_VALUE: string>>"
    rows = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return rows.where("ns = 0 AND redirect IS NULL").select("id", "title", F.col("revision.text._VALUE").alias("text")).where(F.length("text") >= least_chars)


def strip_boilerplate(text: Column) -> Column:
    """What lies between the START and END lines of a Gutenberg text; all of it where they are missing."""
    body = F.regexp_extract(text, r"(?s)\*\*\* ?START OF[^\n]*\*\*\*\s*(.*?)\s*\*\*\* ?END OF", 1)
    return F.when(body != "", body).otherwise(text)


def comments_of(text: Column) -> Column:
    """Comment texts of source code: after #, after //, and between /* and */."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(#[^\n]*|//[^\n]*|/\*.*?\*/)"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"^(#+|//+|/\*+)|\*+/$", "")))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that come with a request."""
    return spark.createDataFrame(rows, schema)


def batches_by_bytes(docs: DataFrame, key: str, size: Column, budget: int, width: int = 4096) -> DataFrame:
    """(source, key, batch): items in order of key, a whole number, within their source, cut where the running bytes pass a multiple of budget. Runs of width keys are summed first, so that no task orders a whole source."""
    before = lambda order, *by: F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = docs.select("source", key, size.alias("_n"), F.floor(F.col(key) / width).alias("_run"))
    runs = rows.groupBy("source", "_run").agg(F.sum("_n").alias("_n")).select("source", "_run", before("_run", "source").alias("_base"))
    met = rows.withColumn("_own", before(key, "source", "_run")).join(runs.toDF("_source", "_r", "_base"), F.col("source").eqNullSafe(F.col("_source")) & F.col("_run").eqNullSafe(F.col("_r")))
    return met.select("source", key, F.floor((F.col("_base") + F.col("_own")) / budget).alias("batch"))


@query(
    "html_regex_text",
    "S21",
    r"""WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '<(script|style|nav|aside|footer|head)\b.*?</\1>', ' ', 'gsi') AS h FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(h, '</?(p|div|h[1-6]|li|br|article)\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'gs') AS t FROM a)
SELECT page_id, md5(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), chr(10) || ' ')) AS digest FROM b""".replace("</\\1>", "</(?:script|style|nav|aside|footer|head)>"),
)
def html_regex_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(plain_html(F.col("html"))).alias("digest"))


def plain_html(html: Column) -> Column:
    """Text of a page by patterns alone: skipped elements go, block tags end lines, a few entities are decoded."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?si)<(script|style|nav|aside|footer|head)\b.*?</(?:script|style|nav|aside|footer|head)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)</?(p|div|h[1-6]|li|br|article)\b[^>]*>", "\n"), r"(?s)<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"), F.lit("\n "))


@query("byte_batches", "S19 S13", "WITH r AS (SELECT source, doc_id, coalesce(sum(strlen(coalesce(text, ''))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) SELECT source, doc_id, floor(b / 20000)::BIGINT AS batch FROM r")
def byte_batches(spark, d):
    return batches_by_bytes(table(spark, d, "documents"), "doc_id", F.octet_length(F.coalesce("text", F.lit(""))), 20000)


@query("page_structure", "S07 S06", "WITH p AS (SELECT doc_id, string_split(replace(text, '. ', chr(12)), chr(12)) AS p FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(range(0, len(p))) AS page, unnest(p) AS body FROM p) SELECT doc_id, page::INTEGER AS page, coalesce(sum(length(body) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM e")
def page_structure(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.replace("text", F.lit(". "), F.lit("\f")).alias("text"))
    return pages_of(docs).select("doc_id", "page", "start")


@query("markdown_cells", "S09 S08", "WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, trim(unnest(string_split(text, chr(10)))) AS s FROM documents WHERE text IS NOT NULL) SELECT doc_id, line::INTEGER AS line, len(string_split(s, '|'))::INTEGER AS cells FROM l WHERE s LIKE '%|%'")
def markdown_cells(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s")).where(F.col("s").contains("|"))
    wrapped = docs.select(F.struct("doc_id", "line").alias("at"), F.concat(F.lit("|"), F.trim("s"), F.lit("|")).alias("text"))
    return markdown_rows(wrapped, "at").select("at.doc_id", "at.line", F.size("cells").alias("cells"))


@query("log_lines", "S10", "SELECT event_id, CASE WHEN value > 100 THEN 'WARN' ELSE 'INFO' END AS severity, event_type AS component, user_id::VARCHAR AS user FROM events")
def log_lines(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    level = F.when(F.col("value") > 100, "WARN").otherwise("INFO")
    lines = table(spark, d, "events").select(F.concat(stamp, F.lit(" ["), level, F.lit("] "), F.col("event_type"), F.lit(": seen id="), F.col("event_id"), F.lit(" user="), F.col("user_id")).alias("value"))
    return parse_logs(lines).select(F.col("attributes")["id"].cast("long").alias("event_id"), "severity", "component", F.col("attributes")["user"].alias("user"))


@query("schema_columns", "S28 S27", "SELECT 'orders' AS name, 6::BIGINT AS n_columns UNION ALL SELECT 'customer', 5 UNION ALL SELECT 'events', 6")
def schema_columns(spark, d):
    names = ["orders", "customer", "events"]
    return inline(spark, [(n, len(table(spark, d, n).columns)) for n in names], "name string, n_columns long")


@query("blob_store", "S24 S02 S20", "SELECT sha256(html) AS hash, strlen(any_value(html))::BIGINT AS bytes, min(page_id) AS first_page FROM pages WHERE html IS NOT NULL AND strlen(html) <= 1000000 GROUP BY 1")
def blob_store(spark, d):
    rows = table(spark, d, "pages").where("html IS NOT NULL AND octet_length(html) <= 1000000")
    return rows.groupBy(F.sha2("html", 256).alias("hash")).agg(F.first(F.octet_length("html")).cast("long").alias("bytes"), F.min("page_id").alias("first_page"))


@query("gutenberg_body", "S14", "SELECT doc_id, md5(regexp_replace(text, '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g')) AS digest FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\v\\f\\r]')")
def gutenberg_body(spark, d):
    """Texts between a licence's START and END lines are read back without them."""
    docs = table(spark, d, "documents").where(F.col("text").rlike(r"\S"))
    book = F.concat(F.lit("Title\n*** START OF THE PROJECT BOOK ***\n"), "text", F.lit("\n*** END OF THE PROJECT BOOK ***\nlicence"))
    return docs.select("doc_id", F.md5(strip_boilerplate(book)).alias("digest"))


def identifiers_of(text: Column) -> Column:
    """Distinct names in source code of three characters or more, cut at underscores and where a capital follows a small letter, in small letters and order."""
    names = F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    words = F.flatten(F.transform(names, lambda x: F.split(F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1_$2"), "_")))
    return F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda x: F.length(x) >= 3), lambda x: F.lower(x))))


@query(
    "code_surfaces",
    "S15",
    r"""WITH c AS (SELECT page_id, regexp_extract_all(html, '(?s)(#[^\n]*|//[^\n]*|/\*.*?\*/)', 1) AS c, list_reduce(list_prepend('', regexp_extract_all(html, '(?si)<(script|style)[^>]*>(.*?)</', 2)), lambda a, b: a || ' ' || b) AS code FROM pages WHERE html IS NOT NULL),
w AS (SELECT page_id, len(c) AS comments, flatten(list_transform(regexp_extract_all(code, '([A-Za-z_][A-Za-z0-9_]*)', 1), lambda x: string_split(regexp_replace(x, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '_'))) AS w FROM c)
SELECT page_id, comments::INTEGER AS comments, array_to_string(list_sort(list_distinct(list_transform(list_filter(w, lambda x: length(x) >= 3), lambda x: lower(x)))), ' ') AS identifiers FROM w""",
)
def code_surfaces(spark, d):
    """Comments counted in whole pages, identifiers of their scripts and styles."""
    code = F.array_join(F.regexp_extract_all("html", F.lit(r"(?si)<(script|style)[^>]*>(.*?)</"), F.lit(2)), " ")
    return table(spark, d, "pages").where("html IS NOT NULL").select("page_id", F.size(comments_of(F.col("html"))).alias("comments"), F.array_join(identifiers_of(code), " ").alias("identifiers"))


#: lanes of an engineering folder by path, first match wins; the rest is held back
LANES = [("code", r"\.(py|js|ts|rs|go|java|c|cpp)$"), ("tables", r"\.(csv|tsv|xlsx|parquet)$"), ("text", r"\.(md|txt|html)$|/(en|fr|de|es)/"), ("logs", r"\.log$")]


def lane_of(path: Column) -> Column:
    path, out = F.lower(path), None
    for lane, pattern in LANES:
        out = F.when(path.rlike(pattern), lane) if out is None else out.when(path.rlike(pattern), lane)
    return out.otherwise("held")


def dry_run(files: DataFrame) -> DataFrame:
    """(lane, files, bytes, unique_files): what an ingest of files (path, length, sha256) would take, a row a lane, without taking it."""
    return files.groupBy(lane_of(F.col("path")).alias("lane")).agg(F.count("*").alias("files"), F.sum("length").cast("long").alias("bytes"), F.count_distinct("sha256").alias("unique_files"))


_LANE = "CASE " + " ".join(f"WHEN regexp_matches(lower(path), '{p}') THEN '{lane}'" for lane, p in LANES) + " ELSE 'held' END"


@query("lane_dry_run", "S16", f"WITH f AS (SELECT regexp_replace(url, '[?].*', '') AS path, strlen(html) AS n, sha256(html) AS h FROM pages WHERE url IS NOT NULL AND html IS NOT NULL) SELECT {_LANE} AS lane, count(*) AS files, sum(n)::BIGINT AS bytes, count(DISTINCT h) AS unique_files FROM f GROUP BY 1")
def lane_dry_run(spark, d):
    pages = table(spark, d, "pages").where("url IS NOT NULL AND html IS NOT NULL")
    return dry_run(pages.select(F.regexp_replace("url", "[?].*", "").alias("path"), F.octet_length("html").alias("length"), F.sha2("html", 256).alias("sha256")))


CONCEPTS = "id string, weight double, edges array<struct<to: string, relation: string, weight: double>>"


def concept_edges(lines: DataFrame, column: str = "value") -> DataFrame:
    """(src, relation, dst, weight) of concept records, a JSON object a line; lines that do not parse or name no concept give none."""
    x = lines.select(F.from_json(column, CONCEPTS).alias("x")).where("x.id IS NOT NULL").select("x.id", F.explode("x.edges").alias("e"))
    return x.select(F.col("id").alias("src"), F.col("e.relation").alias("relation"), F.col("e.to").alias("dst"), F.col("e.weight").alias("weight"))


@query("concept_stream", "S18", "SELECT 'o' || l_orderkey AS src, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'holds' END AS relation, 'p' || l_partkey AS dst, l_quantity AS weight FROM lineitem")
def concept_stream(spark, d):
    relation = F.when(F.col("l_returnflag") == "R", "returned").otherwise("holds")
    edge = F.struct(F.concat(F.lit("p"), "l_partkey").alias("to"), relation.alias("relation"), F.col("l_quantity").alias("weight"))
    rows = table(spark, d, "lineitem").groupBy(F.concat(F.lit("o"), "l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("weight"), F.collect_list(edge).alias("edges"))  # an order's lines are few
    return concept_edges(rows.select(F.to_json(F.struct("id", "weight", "edges")).alias("value")))


@query("delimited_sniff", "S08", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def delimited_sniff(spark, d):
    """Lines that differ in delimiter, each read by its own."""
    mark = F.when(F.col("c_custkey") % 3 == 0, ",").when(F.col("c_custkey") % 3 == 1, "\t").otherwise(";")
    line = F.concat(F.col("c_custkey"), mark, F.lit('"'), F.col("c_name"), F.lit('"'), mark, F.col("c_acctbal"))
    return delimited(table(spark, d, "customer").select(line.alias("value")), "c_custkey long, c_name string, c_acctbal double")


def delimited(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Columns of lines, each parsed with quotes by the delimiter it shows."""
    first = sniff_delimiter(F.col(column))
    parsed = F.when(first == ",", F.from_csv(column, schema, {"sep": ","})).when(first == "\t", F.from_csv(column, schema, {"sep": "\t"})).otherwise(F.from_csv(column, schema, {"sep": ";"}))
    return lines.select(parsed.alias("x")).select("x.*")

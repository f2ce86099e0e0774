"""Text functions as column expressions: tokens, shapes, scripts, anchors, redaction, chunks, ids."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import cut
from quarry.plans.registry import query, table, texts

TOKEN = r"[\p{IsLatin}\p{M}\p{Nd}_]+|\p{L}"
_TOK = r"regexp_extract_all(lower(text), '[\p{Latin}\p{M}\p{Nd}_]+|\p{L}')"


def tokens(text: Column) -> Column:
    """Lower-case runs of Latin letters, marks, digits and underscores; other letters one by one."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def shape(token: Column) -> Column:
    """Upper-case letters to A, lower-case to a, digits to 0."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(token, r"\p{Lu}", "A"), r"\p{Ll}", "a"), r"\p{Nd}", "0")


_SHAPE = r"regexp_replace(regexp_replace(regexp_replace({x}, '\p{Lu}', 'A', 'g'), '\p{Ll}', 'a', 'g'), '\p{Nd}', '0', 'g')"


@query("token_counts", "X01 X03", f"SELECT doc_id, len({_TOK})::BIGINT AS n_tokens, len(list_distinct({_TOK}))::BIGINT AS n_distinct FROM documents")
def token_counts(spark, d):
    t = tokens(F.col("text"))
    return texts(spark, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query(
    "feature_sets",
    "X04 X05 F10",
    f"""WITH t AS (SELECT item_id, {_TOK} AS t FROM benchmark),
f AS (SELECT item_id, list_sort(list_distinct(list_concat(list_transform(t, lambda x: 'sym:' || x), list_transform(range(1, greatest(len(t), 1)), lambda i: 'bi:' || t[i] || '_' || t[i + 1])))) AS f FROM t)
SELECT item_id, array_to_string(f[1:32], ' ') AS features, len(list_filter(f, lambda x: x LIKE 'bi:%'))::BIGINT AS n_pairs FROM f""",
)
def feature_sets(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", tokens(F.col("text")).alias("t"))
    pairs = F.when(F.size("t") > 1, F.transform(F.sequence(F.lit(0), F.size("t") - 2), lambda i: F.concat(F.lit("bi:"), F.get("t", i), F.lit("_"), F.get("t", i + 1)))).otherwise(F.array().cast("array<string>"))
    all_of = F.array_sort(F.array_distinct(F.concat(F.transform("t", lambda x: F.concat(F.lit("sym:"), x)), pairs)))
    rows = rows.select("item_id", all_of.alias("f"))
    return rows.select("item_id", F.concat_ws(" ", F.slice("f", 1, 32)).alias("features"), F.size(F.filter("f", lambda x: x.startswith("bi:"))).cast("long").alias("n_pairs"))


@query(
    "shape_transitions",
    "W11 X08",
    """WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations WHERE text IS NOT NULL),
s AS (SELECT list_transform(w, lambda x: """ + _SHAPE.replace("{x}", "x") + """) AS s FROM t),
p AS (SELECT unnest(list_transform(range(1, greatest(len(s), 1)), lambda i: s[i] || '>' || s[i + 1])) AS pair FROM s)
SELECT pair, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, pair LIMIT 50""",
)
def shape_transitions(spark, d):
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    rows = table(spark, d, "conversations").select(F.transform(words, shape).alias("s")).where(F.size("s") > 1)
    pairs = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("s") - 2), lambda i: F.concat(F.get("s", i), F.lit(">"), F.get("s", i + 1)))).alias("pair"))
    return pairs.groupBy("pair").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair").limit(50)


@query(
    "script_mass",
    "X07 X25",
    r"""SELECT doc_id, round(len(regexp_extract_all(text, '\p{Latin}')) / greatest(length(text), 1), 6) AS latin, round(len(regexp_extract_all(text, '\p{Nd}')) / greatest(length(text), 1), 6) AS digits,
round(len(regexp_extract_all(text, '[\p{P}\p{S}]')) / greatest(length(text), 1), 6) AS marks FROM documents""",
)
def script_mass(spark, d):
    n = F.greatest(F.length("text"), F.lit(1))
    share = lambda p: F.round(F.regexp_count("text", F.lit(p)) / n, 6)
    return texts(spark, d).select("doc_id", share(r"\p{IsLatin}").alias("latin"), share(r"\p{Nd}").alias("digits"), share(r"[\p{P}\p{S}]").alias("marks"))


#: Fixed patterns of what redaction hides.
SECRETS = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+", "[EMAIL]"), (r"(?i)(api[_-]?key|token|secret|password)\s*[:=]\s*\S+", "[SECRET]"), (r"\b[0-9]+-[0-9]+-[0-9]+\b", "[NUMBER]"), (r"\b[A-Fa-f0-9]{32,}\b", "[HEX]")]


def redact(text: Column) -> Column:
    for pattern, to in SECRETS:
        text = F.regexp_replace(text, pattern, to)
    return text


@query(
    "redact_secrets",
    "X11 X14",
    "WITH r AS (SELECT doc_id, text, " + "regexp_replace(" * 4 + "text" + "".join(f", '{p}', '{t}', 'g')" for p, t in SECRETS) + " AS r FROM documents) SELECT doc_id, md5(r) AS digest, length(r)::BIGINT AS n_chars FROM r WHERE r <> text",
)
def redact_secrets(spark, d):
    rows = texts(spark, d).select("doc_id", "text", redact(F.col("text")).alias("r"))
    return rows.where("r <> text").select("doc_id", F.md5("r").alias("digest"), F.length("r").cast("long").alias("n_chars"))


@query(
    "chunk_offsets",
    "X10 S07 W03",
    """WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS para FROM p),
o AS (SELECT doc_id, i, strlen(para) AS bytes, length(para) AS chars, coalesce(sum(strlen(para) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_start FROM e)
SELECT doc_id, byte_start // 1024 AS chunk, min(byte_start) AS byte_start, max(byte_start + bytes) AS byte_end, sum(chars)::BIGINT AS n_chars FROM o GROUP BY 1, 2""",
)
def chunk_offsets(spark, d):
    return chunks(texts(spark, d), 1024)


def chunks(docs: DataFrame, size: int) -> DataFrame:
    """Paragraphs merged into chunks by the size-byte cell in which they start, with byte offsets; paragraphs are not split."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "para"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("byte_start", F.coalesce(F.sum(F.octet_length("para") + 1).over(before), F.lit(0)).cast("long"))
    cell = F.floor(F.col("byte_start") / size).alias("chunk")
    return placed.groupBy("doc_id", cell).agg(F.min("byte_start").alias("byte_start"), F.max(F.col("byte_start") + F.octet_length("para")).alias("byte_end"), F.sum(F.length("para")).alias("n_chars"))


@query("content_ids", "X19 S24", "SELECT DISTINCT 'ev_' || substr(sha256(text), 1, 24) AS content_id, sha256(text) AS content_hash, strlen(text)::BIGINT AS bytes FROM documents WHERE text IS NOT NULL")
def content_ids(spark, d):
    digest = F.sha2("text", 256)
    rows = texts(spark, d).where("text IS NOT NULL")
    return rows.select(F.concat(F.lit("ev_"), F.substring(digest, 1, 24)).alias("content_id"), digest.alias("content_hash"), F.octet_length("text").cast("long").alias("bytes")).dropDuplicates(["content_hash"])


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a of the bytes of an ASCII text, as a fold over its characters."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(F.split(text, ""), F.lit(2166136261).cast("long"), lambda h, c: F.when(c == "", h).otherwise(step(h, c)))


@query(
    "fnv_buckets",
    "X19",
    """WITH RECURSIVE n AS (SELECT DISTINCT p_brand AS s FROM part), f AS (SELECT s, 0 AS i, 2166136261::BIGINT AS h FROM n
UNION ALL SELECT s, i + 1, ((xor(h, ascii(substr(s, i + 1, 1))::BIGINT) * 16777619::BIGINT) & 4294967295) FROM f WHERE i < length(s))
SELECT s AS p_brand, h AS fnv FROM f WHERE i = length(s)""",
)
def fnv_buckets(spark, d):
    return table(spark, d, "part").select("p_brand").distinct().select("p_brand", fnv1a(F.col("p_brand")).alias("fnv"))


@query(
    "hashed_vector",
    "X16",
    f"""WITH t AS (SELECT item_id, unnest({_TOK}) AS t FROM benchmark), h AS (SELECT item_id, sha256(t) AS h FROM t),
b AS (SELECT item_id, (('0x' || substr(h, 1, 8))::BIGINT) % 64 AS bucket, CASE WHEN (('0x' || substr(h, 9, 2))::BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign FROM h),
s AS (SELECT item_id, bucket, sum(sign)::DOUBLE AS v FROM b GROUP BY 1, 2)
SELECT item_id, bucket, round(v / nullif(sqrt(sum(v * v) OVER (PARTITION BY item_id)), 0), 6) AS value FROM s WHERE v <> 0""",
)
def hashed_vector(spark, d):
    h = table(spark, d, "benchmark").select("item_id", F.explode(tokens(F.col("text"))).alias("t")).withColumn("h", F.sha2("t", 256))
    number = lambda a, n: F.conv(F.substring("h", a, n), 16, 10).cast("long")
    b = h.groupBy("item_id", (number(1, 8) % 64).alias("bucket")).agg(F.sum(F.when(number(9, 2) % 2 == 0, 1.0).otherwise(-1.0)).alias("v")).where("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("item_id")))
    return b.select("item_id", "bucket", F.round(F.col("v") / norm, 6).alias("value"))


@query(
    "bounded_edit_distance",
    "X12 J22",
    "SELECT a.p_partkey AS a, b.p_partkey AS b, least(levenshtein(a.p_name, b.p_name), 6)::INTEGER AS distance FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey",
)
def bounded_edit_distance(spark, d):
    bound = F.levenshtein("x", "y", 5)
    return named_pairs(table(spark, d, "part"), F.when(bound >= 0, bound).otherwise(6).alias("distance"))


#: Keys that one row of named_pairs() holds.
KEYS = 256


def named_pairs(part: DataFrame, *measures: Column) -> DataFrame:
    """(a, b, measures): every pair of parts a < b of one brand and size, with symmetric measures of their names x and y.

    Measures are taken once for each pair of different names of a group; the keys that bear a name lie in rows of about KEYS,
    and pairs of such rows are opened into pairs of keys in the task that made them, so no pair of parts is shuffled.
    """
    group = ["p_brand", "p_size"]
    rows = part.where("p_partkey IS NOT NULL AND p_brand IS NOT NULL AND p_size IS NOT NULL")
    # a missing name is a name too: its measures are of null
    rows = rows.select(*group, F.coalesce(F.concat(F.lit("="), "p_name"), F.lit("")).alias("name"), F.col("p_partkey").alias("k"))
    sizes = cut(rows.groupBy(*group, "name").agg(F.count("*").alias("n")))
    # names with many keys are dealt into rows of about KEYS by the key's hash; a key's repeats stay together
    runs = rows.join(sizes, [*group, "name"]).withColumn("run", F.pmod(F.xxhash64("k"), F.ceil(F.col("n") / KEYS)))
    runs = cut(runs.groupBy(*group, "name", "run").agg(F.collect_list("k").alias("ks")))
    names = sizes.select(*group, "name")
    pairs = names.withColumnRenamed("name", "nx").join(names.withColumnRenamed("name", "ny"), group).where("nx <= ny")
    name = lambda c: F.when(F.col(c) != "", F.substring(c, 2, 1 << 30))
    measured = pairs.select(*group, "nx", "ny", name("nx").alias("x"), name("ny").alias("y")).select(*group, "nx", "ny", F.struct(*measures).alias("m"))
    one, two = runs.toDF(*group, "nx", "r1", "k1"), runs.toDF(*group, "ny", "r2", "k2")
    # of one name, a run meets itself and those after it
    met = measured.join(one, [*group, "nx"]).join(two, [*group, "ny"]).where("nx < ny OR r1 <= r2")
    opened = met.select("m", (F.col("nx") == F.col("ny")).alias("same"), "r1", "r2", "k2", F.explode("k1").alias("k"))
    opened = opened.select("m", (F.col("same") & (F.col("r1") == F.col("r2"))).alias("within"), "k", F.explode("k2").alias("l"))
    # a run that meets itself has every pair from both sides
    opened = opened.where("k < l OR (k > l AND NOT within)")
    return opened.select(F.least("k", "l").alias("a"), F.greatest("k", "l").alias("b"), "m.*")


@query(
    "number_and_date_cells",
    "X24 X26",
    r"""WITH c AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '1,234.5' WHEN 1 THEN '2024-01-31' WHEN 2 THEN 'true' WHEN 3 THEN '12kg' ELSE p_retailprice::VARCHAR END AS cell FROM part)
SELECT p_partkey, try_cast(replace(cell, ',', '') AS DOUBLE) AS number, regexp_matches(cell, '^\d\d\d\d-\d\d-\d\d$') AS is_date, lower(cell) IN ('true', 'false') AS is_boolean, nullif(regexp_extract(cell, '^[0-9.,]+\s*([a-zA-Z%]+)$', 1), '') AS unit FROM c""",
)
def number_and_date_cells(spark, d):
    key = F.col("p_partkey") % 5
    cell = F.when(key == 0, "1,234.5").when(key == 1, "2024-01-31").when(key == 2, "true").when(key == 3, "12kg").otherwise(F.col("p_retailprice").cast("string"))
    rows = table(spark, d, "part").select("p_partkey", cell.alias("cell"))
    unit = F.regexp_extract("cell", r"^[0-9.,]+\s*([a-zA-Z%]+)$", 1)
    return rows.select("p_partkey", F.regexp_replace("cell", ",", "").try_cast("double").alias("number"), F.col("cell").rlike(r"^\d\d\d\d-\d\d-\d\d$").alias("is_date"), F.lower("cell").isin("true", "false").alias("is_boolean"), F.when(unit != "", unit).alias("unit"))


@query("json_props", "X20 F07 X23", "SELECT event_id, json_extract_string(props, '$.k') AS k, (json_extract_string(props, '$.k'))::BIGINT % 2 = 0 AS even, epoch_us(ts) // 1000 AS ms FROM events WHERE json_type(props, '$.k') IN ('BIGINT', 'UBIGINT')")
def json_props(spark, d):
    v = F.try_parse_json("props")
    rows = table(spark, d, "events").select("event_id", "ts", F.try_variant_get(v, "$.k", "string").alias("k"), F.schema_of_variant(F.try_variant_get(v, "$.k", "variant")).alias("kind"))
    return rows.where("kind = 'BIGINT'").select("event_id", "k", (F.col("k").cast("long") % 2 == 0).alias("even"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


def canonical_json(value: Column) -> Column:
    """JSON with keys sorted at every depth, as an Arrow-batched function; not-finite numbers become null."""
    @F.pandas_udf("string")
    def canonical(s: pd.Series) -> pd.Series:
        import json
        import math

        def clean(x):
            if isinstance(x, float):
                return None if not math.isfinite(x) else 0 if x == 0 else x
            if isinstance(x, dict):
                return {k: clean(v) for k, v in x.items()}
            return [clean(v) for v in x] if isinstance(x, list) else x

        return s.map(lambda t: None if t is None else json.dumps(clean(json.loads(t)), sort_keys=True, separators=(",", ":"), ensure_ascii=False))

    return canonical(value)


@query("canonical_props", "X18", "SELECT event_id, replace(props, ' ', '') AS canonical FROM events")
def canonical_props(spark, d):
    return table(spark, d, "events").select("event_id", canonical_json(F.col("props")).alias("canonical"))


def nfc(text: Column) -> Column:
    """NFC, with NUL to a space and CRLF to LF; an Arrow-batched function, as Spark has no normaliser."""
    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        import unicodedata

        return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t.replace("\0", " ").replace("\r\n", "\n")))

    return normal(text)


@query("normalised_text", "S04", "SELECT doc_id, md5(nfc_normalize(replace(text, chr(13) || chr(10), chr(10)))) AS digest FROM documents WHERE text IS NOT NULL")
def normalised_text(spark, d):
    return texts(spark, d).where("text IS NOT NULL").select("doc_id", F.md5(nfc(F.col("text"))).alias("digest"))

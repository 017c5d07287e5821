"""Registered queries around search: records, sources, limits, answers, samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import text as tx
from spanloom.operators import graph
from spanloom.plans import retrieval
from spanloom.plans.retrieval import BM25_TOPK, Q, bm25_topk, table, wins
from spanloom.sources import parsers, records

# ---- records


def record_metadata(s, d):
    """Records with the metadata of source and parser merged, and their places."""
    docs = table(s, d, "documents").select(
        F.concat(F.lit("source:"), "doc_id").alias("source_id"), F.lit(0).alias("ordinal"), "text", F.when(F.col("doc_id") % 3 == 0, "markdown").otherwise("plaintext").alias("parser"),
        F.create_map(F.lit("title"), F.col("source"), F.lit("lang"), F.col("lang")).alias("metadata"),
        F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("title"), F.concat(F.lit("Doc "), "doc_id"))).otherwise(F.create_map(F.lit("media_type"), F.lit("x/y"))).alias("parsed_metadata"),
        F.when(F.col("doc_id") % 5 == 0, F.col("doc_id")).cast("long").alias("char_start"), F.when(F.col("doc_id") % 5 == 0, F.lit(0)).cast("long").alias("char_end"),
    )
    out = records.records(docs)
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("record_id", flat.alias("metadata"), "source_start", "source_end")


RECORD_METADATA = """SELECT 'source:' || doc_id || ':record:0' AS record_id, 'lang=' || lang || ';media_type=' || CASE WHEN doc_id % 2 = 1 THEN 'x/y' WHEN doc_id % 3 = 0 THEN 'text/markdown' ELSE 'text/plain' END || ';parser=' || CASE WHEN doc_id % 3 = 0 THEN 'markdown' ELSE 'plaintext' END || ';title=' || CASE WHEN doc_id % 2 = 0 THEN 'Doc ' || doc_id ELSE source END AS metadata,
CAST(CASE WHEN doc_id % 5 = 0 THEN doc_id ELSE 0 END AS BIGINT) AS source_start, CAST(CASE WHEN doc_id % 5 = 0 THEN doc_id ELSE length(text) END AS BIGINT) AS source_end FROM documents WHERE length(trim(text)) > 0"""


def raw_source_scan(s, d):
    """Raw sources as documents, and error rows for the empty ones."""
    rows = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("name"), F.when(F.col("event_id") % 7 == 0, "  ").when(F.col("event_id") % 5 == 0, F.concat(F.lit("seen "), "event_type")).otherwise(F.col("props")).alias("content"), F.lit(None).cast("string").alias("media_type"))
    docs, errors = records.raw_sources(rows)
    return docs.select("source_id", "media_type", F.lit(None).cast("string").alias("error")).unionByName(errors.select("source_id", F.lit(None).cast("string").alias("media_type"), "error"))


RAW_SOURCE_SCAN = "SELECT 'raw:' || event_id || ':' || event_type AS source_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'text/plain' ELSE 'application/json' END AS media_type, CASE WHEN event_id % 7 = 0 THEN 'the source is empty' END AS error FROM events"


def connector_marking(s, d):
    c = table(s, d, "conversations").select(F.col("turn").alias("nth"), F.concat(F.lit("c"), "conv_id").alias("name"), F.when(F.col("role") == "user", "chat").alias("source_type"))
    return records.marked(c, "slack").select("source_id", "source_origin", "source_type")


CONNECTOR_MARKING = "SELECT 'connector:slack:' || turn || ':c' || conv_id AS source_id, 'connector' AS source_origin, CASE WHEN role = 'user' THEN 'chat' ELSE 'slack' END AS source_type FROM conversations"


def webhook_documents(s, d):
    c = table(s, d, "conversations").withColumn("x", F.struct("turn", F.col("role").alias("name"), F.when(F.col("turn") % 4 == 3, " ").otherwise(F.col("text")).alias("content")))
    configs = c.groupBy(F.col("conv_id").alias("connector_id")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["name"].alias("name"), x["content"].alias("content"))).alias("documents"))).alias("config"))
    return records.webhook_documents(configs).select("connector_id", "nth", "name", F.md5("content").alias("content_md5"))


WEBHOOK_DOCUMENTS = "SELECT conv_id AS connector_id, nth, role AS name, md5(text) AS content_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS nth FROM conversations) WHERE turn % 4 <> 3 AND length(trim(text)) > 0"


def json_item_spans(s, d):
    """Where the records of JSON-lines payloads stand in them."""
    blobs = table(s, d, "events").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda x: x["props"]), "\n").alias("content"), F.count("*").alias("n")).where("n > 1")
    docs = blobs.select(F.col("user_id").cast("string").alias("source_id"), F.lit("x.ndjson").alias("name"), F.lit(None).cast("string").alias("media_type"), "content", F.lit("json").alias("parser_name"))
    return parsers.parse_documents(docs).select("source_id", "ordinal", "text", "start", "end", "error")


JSON_ITEM_SPANS = """WITH e AS (SELECT user_id, props, row_number() OVER w - 1 AS ordinal, coalesce(sum(length(props) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT CAST(user_id AS VARCHAR) AS source_id, ordinal, array_to_string(list_transform(json_keys(props), lambda k: k || ': ' || json_extract_string(props, '$.' || k)), chr(10)) AS text, CAST(start AS BIGINT) AS start, CAST(start + length(props) AS BIGINT) AS "end", CAST(NULL AS VARCHAR) AS error FROM e WHERE n > 1"""


def generated_lines(s, d):
    return records.generated_lines(s, 2_000, 1_234, "the refund was approved")


GENERATED_LINES = "SELECT range AS line_no, CASE WHEN range = 1234 THEN 'the refund was approved' ELSE 'noise line ' || lpad(range::VARCHAR, 4, '0') || ' without meaning' END AS text FROM range(1, 2001)"


def source_listing(s, d):
    """The first page of sources, the latest first."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderdate").cast("date").alias("created"))
    return o.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created"), "source_id")).cast("long")).where("place <= 100").select("source_id", F.col("created").cast("string").alias("created"), "place")


SOURCE_LISTING = "SELECT source_id, CAST(created AS VARCHAR) AS created, place FROM (SELECT o_orderkey AS source_id, CAST(o_orderdate AS DATE) AS created, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS place FROM orders) WHERE place <= 100"


def connector_limit(s, d):
    """At most three documents of each connector, in order."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(s, d, "conversations").withColumn("nth", F.row_number().over(order)).where("nth <= 3").select("conv_id", "turn")


CONNECTOR_LIMIT = "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations) WHERE nth <= 3"


def source_delete(s, d):
    """The stored documents after the sources of one customer are deleted."""
    gone = table(s, d, "orders").where("o_custkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("order_index")).join(gone, "l_orderkey", "left_anti")


SOURCE_DELETE = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS order_index FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0)"


def api_key_lookup(s, d):
    """The requests whose key's SHA-256 is an active key's."""
    keys = table(s, d, "customer").where("c_acctbal >= 0").select(F.sha2(F.concat(F.lit("key-"), F.col("c_custkey").cast("string")), 256).alias("hash"))
    asked = table(s, d, "orders").select("o_orderkey", F.sha2(F.concat(F.lit("key-"), F.col("o_custkey").cast("string")), 256).alias("hash"))
    return asked.join(keys, "hash", "left_semi").select("o_orderkey", F.substring("hash", 1, 12).alias("key"))


API_KEY_LOOKUP = "SELECT o_orderkey, substr(sha256('key-' || o_custkey), 1, 12) AS key FROM orders WHERE sha256('key-' || o_custkey) IN (SELECT sha256('key-' || c_custkey) FROM customer WHERE c_acctbal >= 0)"


def seeded_sample(s, d):
    """A sample without replacement, and which fold each sampled row is in, by a seeded hash."""
    draw = F.md5(F.concat(F.lit("17:"), F.col("doc_id").cast("string")))
    rows = table(s, d, "documents").select("doc_id", draw.alias("draw")).orderBy("draw", "doc_id").limit(500)
    return rows.select("doc_id", F.when(F.conv(F.substring("draw", 1, 4), 16, 10).cast("long") % 5 == 0, "validation").otherwise("train").alias("fold"))


SEEDED_SAMPLE = "SELECT doc_id, CASE WHEN ('0x' || substr(draw, 1, 4))::BIGINT % 5 = 0 THEN 'validation' ELSE 'train' END AS fold FROM (SELECT doc_id, md5('17:' || doc_id) AS draw FROM documents ORDER BY draw, doc_id LIMIT 500)"


def flatten_json_nested(s, d):
    """Paths and values of payloads of several levels."""
    payload = F.to_json(F.struct(F.col("event_id").alias("id"), F.struct(F.col("user_id").alias("id"), F.array("event_type", F.lit("x")).alias("tags")).alias("user"), F.array().cast("array<string>").alias("none"), F.array(F.struct(F.col("event_type").alias("kind"))).alias("list")))
    docs = table(s, d, "events").select(F.col("event_id").cast("string").alias("source_id"), F.lit("x.json").alias("name"), F.lit(None).cast("string").alias("media_type"), payload.alias("content"))
    return parsers.parse_documents(docs).select("source_id", "text")


FLATTEN_JSON_NESTED = "SELECT CAST(event_id AS VARCHAR) AS source_id, 'id: ' || event_id || chr(10) || 'user.id: ' || user_id || chr(10) || 'user.tags[0]: ' || event_type || chr(10) || 'user.tags[1]: x' || chr(10) || 'none: []' || chr(10) || 'list[0].kind: ' || event_type AS text FROM events"


def sanitize_nested(s, d):
    """Metadata of several levels without secrets."""
    m = F.to_json(F.struct(F.col("event_id").alias("id"), F.lit("s").alias("apiKey"), F.struct(F.lit("p").alias("password"), F.col("event_type").alias("kind"), F.array(F.struct(F.lit("c").alias("client_secret"), F.col("user_id").alias("user"))).alias("list")).alias("auth")))
    return table(s, d, "events").select("event_id", parsers.json_without_secrets(m).alias("metadata"))


SANITIZE_NESTED = """SELECT event_id, '{"id":' || event_id || ',"auth":{"kind":"' || event_type || '","list":[{"user":' || user_id || '}]}}' AS metadata FROM events"""


# ---- requests and answers


def request_limits(s, d):
    o = table(s, d, "orders")
    asked = {"top_k": F.col("o_orderkey") % 70, "raw_sources": F.col("o_custkey") % 25, "connectors": F.col("o_orderkey") % 5, "raw_bytes": F.col("o_totalprice").cast("double") * 10}
    return o.select("o_orderkey", records.limit_errors(asked).alias("error"))


REQUEST_LIMITS = "SELECT o_orderkey, CASE WHEN o_orderkey % 70 > 50 THEN 'top_k is over 50' WHEN o_custkey % 25 > 20 THEN 'raw_sources is over 20' WHEN o_orderkey % 5 > 3 THEN 'connectors is over 3' WHEN CAST(o_totalprice AS DOUBLE) * 10 > 1048576 THEN 'raw_bytes is over 1048576' END AS error FROM orders"


def cacheable_origins(s, d):
    """Which conversations come from stored sources only, so that their index may be kept."""
    origin = F.when(F.col("turn") % 3 == 2, "raw").otherwise("stored")
    sets = table(s, d, "conversations").where("turn < 2 or conv_id % 2 = 0").groupBy("conv_id").agg(F.collect_set(origin).alias("origins"))
    return sets.select("conv_id", (F.size(F.array_except("origins", F.array(F.lit("stored")))) == 0).alias("use_cache"))


CACHEABLE_ORIGINS = "SELECT conv_id, bool_and(turn % 3 <> 2) AS use_cache FROM conversations WHERE turn < 2 OR conv_id % 2 = 0 GROUP BY conv_id"


def collapsed_snippets(s, d):
    """The beginning of each document on one line, with an ellipsis where it goes on."""
    one = F.trim(F.regexp_replace("text", r"\s+", " "))
    return table(s, d, "documents").select("doc_id", F.when(F.length(one) > 280, F.concat(F.rtrim(F.substring(one, 1, 277)), F.lit("..."))).otherwise(one).alias("snippet"))


COLLAPSED_SNIPPETS = r"SELECT doc_id, CASE WHEN length(one) > 280 THEN rtrim(substring(one, 1, 277)) || '...' ELSE one END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS one FROM documents)"


def _answer_rows(s, d):
    top = bm25_topk(s, d).where("rank <= 3")
    return top.join(wins(s, d).select("window_id", "text"), "window_id").select("rank", F.substring("text", 1, 280).alias("snippet"))


ANSWER_CTE = "tp AS (SELECT * FROM ({}) WHERE rank <= 3), an AS (SELECT rank, substring(text, 1, 280) AS snippet FROM tp JOIN win USING (window_id))".format(BM25_TOPK)


def extractive_answer(s, d):
    """The answer without a model: the three best snippets, cited."""
    rows = _answer_rows(s, d).agg(F.array_sort(F.collect_list(F.struct("rank", "snippet"))).alias("x"))  # three rows
    return rows.select(F.array_join(F.transform("x", lambda r: F.concat(F.lit("- "), r["snippet"], F.lit(" ["), r["rank"].cast("string"), F.lit("]"))), "\n").alias("answer"))


EXTRACTIVE_ANSWER = f"WITH {retrieval.WIN}, {ANSWER_CTE} SELECT string_agg('- ' || snippet || ' [' || rank || ']', chr(10) ORDER BY rank) AS answer FROM an"


def answer_prompt(s, d):
    """What a model would be asked."""
    rows = _answer_rows(s, d).agg(F.array_sort(F.collect_list(F.struct("rank", "snippet"))).alias("x"))
    sources = F.array_join(F.transform("x", lambda r: F.concat(F.lit("["), r["rank"].cast("string"), F.lit("] "), r["snippet"])), "\n\n")
    return rows.select(F.format_string("Question: %s\n\nSources:\n%s\n\nAnswer from the sources only and cite them.", F.lit(Q), sources).alias("prompt"))


ANSWER_PROMPT = f"WITH {retrieval.WIN}, {ANSWER_CTE} SELECT 'Question: {Q}' || chr(10) || chr(10) || 'Sources:' || chr(10) || string_agg('[' || rank || '] ' || snippet, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Answer from the sources only and cite them.' AS prompt FROM an"


def inclusion_score(s, d):
    """Share of the query's words that a window has anywhere in it."""
    words = tx.query_tokens(Q)
    low = F.lower("text")
    share = sum((F.contains(low, F.lit(w)).cast("double") for w in words), F.lit(0.0)) / len(words)
    return wins(s, d).select("window_id", F.round(share, 6).alias("score")).where("score > 0")


INCLUSION_SCORE = f"WITH {retrieval.WIN} SELECT * FROM (SELECT window_id, round(({' + '.join(f'contains(lower(text), {w!r})::DOUBLE' for w in tx.query_tokens(Q))}) / {len(tx.query_tokens(Q))}, 6) AS score FROM win) WHERE score > 0"


def confidence_mode(s, d):
    """How far results can be trusted, from which models were there and how the best hit stands out."""
    m = table(s, d, "events").groupBy("user_id").agg(F.max("value").alias("top"), F.count_if(F.col("event_type") == "purchase").alias("models"))
    return m.select("user_id", F.when(F.col("models") == 0, "lexical").when(F.col("models") < 3, "degraded").otherwise("full").alias("mode"), F.when(F.col("top") >= 90, "high").when(F.col("top") >= 50, "medium").otherwise("low").alias("confidence"))


CONFIDENCE_MODE = "SELECT user_id, CASE WHEN models = 0 THEN 'lexical' WHEN models < 3 THEN 'degraded' ELSE 'full' END AS mode, CASE WHEN top >= 90 THEN 'high' WHEN top >= 50 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT user_id, max(value) AS top, count(*) FILTER (event_type = 'purchase') AS models FROM events GROUP BY user_id)"


# ---- graph of rules


def _rows_of_pages(s, d):
    """Customers as rows of pages (nations) and sections (market segments) of one source per account sign."""
    return table(s, d, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_acctbal") < 0, "a").otherwise("b").alias("source"), F.col("c_custkey").alias("row"), F.col("c_nationkey").alias("page"), F.col("c_mktsegment").alias("section"))


def rule_adjacency(s, d):
    """Edges by neighbouring rows, pages and sections, the eight heaviest of each node."""
    e = graph.normalized(graph.rule_edges(_rows_of_pages(s, d)))
    return e.select("src", "dst", F.round("w", 6).alias("w"))


RULE_ADJACENCY = """WITH u AS (SELECT c_custkey AS node, CASE WHEN c_acctbal < 0 THEN 'a' ELSE 'b' END AS source, c_nationkey AS page, c_mktsegment AS section FROM customer),
e AS (SELECT a.node AS src, b.node AS dst, greatest(CASE WHEN abs(a.node - b.node) = 1 THEN 0.8 ELSE 0 END, CASE WHEN a.page = b.page THEN 0.6 ELSE 0 END, CASE WHEN a.section = b.section THEN 0.5 ELSE 0 END) AS w FROM u a JOIN u b ON a.source = b.source AND a.node <> b.node),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM e WHERE w > 0) WHERE r <= 8)
SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6)::DOUBLE AS w FROM k"""


QUERIES = {
    "flatten_json_nested": (flatten_json_nested, FLATTEN_JSON_NESTED), "sanitize_nested": (sanitize_nested, SANITIZE_NESTED),
    "record_metadata": (record_metadata, RECORD_METADATA), "raw_source_scan": (raw_source_scan, RAW_SOURCE_SCAN), "connector_marking": (connector_marking, CONNECTOR_MARKING), "webhook_documents": (webhook_documents, WEBHOOK_DOCUMENTS),
    "json_item_spans": (json_item_spans, JSON_ITEM_SPANS), "generated_lines": (generated_lines, GENERATED_LINES), "source_listing": (source_listing, SOURCE_LISTING), "connector_limit": (connector_limit, CONNECTOR_LIMIT), "source_delete": (source_delete, SOURCE_DELETE),
    "api_key_lookup": (api_key_lookup, API_KEY_LOOKUP), "seeded_sample": (seeded_sample, SEEDED_SAMPLE), "request_limits": (request_limits, REQUEST_LIMITS), "cacheable_origins": (cacheable_origins, CACHEABLE_ORIGINS), "collapsed_snippets": (collapsed_snippets, COLLAPSED_SNIPPETS),
    "extractive_answer": (extractive_answer, EXTRACTIVE_ANSWER), "answer_prompt": (answer_prompt, ANSWER_PROMPT), "inclusion_score": (inclusion_score, INCLUSION_SCORE), "confidence_mode": (confidence_mode, CONFIDENCE_MODE), "rule_adjacency": (rule_adjacency, RULE_ADJACENCY),
}

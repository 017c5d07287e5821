"""Registered queries over texts: windows, tokens, scorers, fusion, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import text as tx
from spanloom.operators import fusion, graph, scoring, search, windows
from spanloom.plans import cache, planner

Q = "anes oner edst thou"
BATCH = {1: "anes oner edst thou", 2: "reer edha thre", 3: "ensch enie nicht nicht"}
REGEX_Q = 'anes oner regex("th[aeiou]n")'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", "text")


def wins(spark, d):
    return windows.windows_unplaced(docs(spark, d))


# ---- SQL building blocks

PARTS = "parts AS (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents), flat AS (SELECT doc_id, source, unnest(p) AS text, CAST(generate_subscripts(p, 1) AS BIGINT) AS line_no FROM parts)"
WIN = PARTS + ", numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM flat WHERE length(text) > 0), win AS (SELECT 'source:' || doc_id || ':record:0:window:' || n AS window_id, doc_id, source, text, n FROM numbered WHERE regexp_matches(text, '\\S'))"
STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
ALIAS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in tx.ALIASES.items()) + "}"


def tok(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[a-z0-9]+')"


def stopped(text: str) -> str:
    return f"list_filter({tok(text)}, lambda x: NOT list_contains({STOP}, x))"


def values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


def term_rows(queries: dict[int, str]):
    return [(i, t, tx.query_terms(q).count(t)) for i, q in queries.items() for t in dict.fromkeys(tx.query_terms(q))]


def bm25_sql(queries: dict[int, str], units: str, unit: str, text: str = "text") -> str:
    return f"""tk AS (SELECT {unit}, {stopped(text)} AS t FROM {units}), st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk), ex AS (SELECT {unit}, len(t) AS dl, unnest(t) AS term FROM tk),
 qt(query_id, term, times) AS {values(term_rows(queries))}, tf AS (SELECT {unit}, dl, term, count(*) AS tf FROM ex WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 bm AS (SELECT query_id, {unit}, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) * times) AS score FROM tf JOIN df USING (term) JOIN qt USING (term), st GROUP BY ALL)"""


def top_sql(source: str, unit: str, k: int, extra: str = "") -> str:
    return f"SELECT CAST(query_id AS BIGINT) AS query_id, {unit}, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank{extra} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, {unit}) AS rank FROM {source}) WHERE rank <= {k}"


def pattern_sql(query: str, text: str = "text") -> str:
    """Occurrences through the tokens and what is between them."""
    parts = []
    for _, body, weight in tx.query_patterns(query):
        # every other character of a boundary is doubled so that neighbours do not share it
        padded = f"(' ' || regexp_replace(lower({text}), '([^a-z0-9])', '\\1\\1', 'g') || ' ')"
        pat = body.replace(" ", "  ")
        parts.append(f"{weight} * ln(1 + len(regexp_extract_all({padded}, '[^a-z0-9]{pat}[^a-z0-9]')))")
    return " + ".join(parts)


# ---- queries


def line_windows(s, d):
    w = windows.with_neighbors(windows.line_windows(docs(s, d)))
    return w.select("window_id", "doc_id", "text", "n", "line_no", "start", "end")


LINE_WINDOWS = f"""WITH {PARTS}, placed AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM flat),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM placed WHERE length(text) > 0)
SELECT 'source:' || doc_id || ':record:0:window:' || n AS window_id, doc_id, text, n, line_no, CAST(start AS BIGINT) AS start, CAST(start + length(text) AS BIGINT) AS "end" FROM numbered WHERE regexp_matches(text, '\\S')"""


def window_neighbors(s, d):
    return windows.with_neighbors(windows.line_windows(docs(s, d))).select("window_id", "prev_id", "next_id")


WINDOW_NEIGHBORS = f'WITH w AS ({LINE_WINDOWS}) SELECT window_id, lag(window_id) OVER o AS prev_id, lead(window_id) OVER o AS next_id FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY start, "end", window_id)'


def token_chunks(s, d):
    return windows.token_chunks(docs(s, d)).select("chunk_id", "doc_id", "chunk", "token_count", F.md5("content").alias("content_md5"), "start", "end")


CHUNK_CTE = """w AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+') AS t, regexp_extract_all(text, '[ \\t\\n\\r\\f\\v]+') AS g, CASE WHEN regexp_matches(text, '^[ \\t\\n\\r\\f\\v]') THEN 1 ELSE 0 END AS lead FROM documents),
c0 AS (SELECT *, len(t) AS n, unnest(range(0, greatest(len(t), 1), 450)) AS first FROM w WHERE len(t) > 0),
c AS (SELECT *, least(first + 500, n) AS last, first // 450 AS chunk FROM c0 WHERE first = 0 OR first - 450 + 500 < n),
cl AS (SELECT *, coalesce(list_sum(list_transform(t[1:first], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(g[1:first + lead], lambda x: length(x))), 0) AS start, coalesce(list_sum(list_transform(t[first + 1:last], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(g[first + lead + 1:last + lead - 1], lambda x: length(x))), 0) AS len FROM c),
ch AS (SELECT doc_id || ':0:0:' || chunk AS chunk_id, doc_id, CAST(chunk AS BIGINT) AS chunk, substring(text, CAST(start + 1 AS BIGINT), CAST(len AS BIGINT)) AS content, CAST(last - first AS BIGINT) AS token_count, CAST(start AS BIGINT) AS start, CAST(start + len AS BIGINT) AS "end" FROM cl)"""
TOKEN_CHUNKS = f'WITH {CHUNK_CTE} SELECT chunk_id, doc_id, chunk, token_count, md5(content) AS content_md5, start, "end" FROM ch'


def chunk_adjacency(s, d):
    return windows.chunk_neighbors(windows.token_chunks(docs(s, d))).select("chunk_id", "prev_id", "next_id")


CHUNK_ADJACENCY = f"WITH {CHUNK_CTE} SELECT chunk_id, lag(chunk_id) OVER (PARTITION BY doc_id ORDER BY chunk) AS prev_id, lead(chunk_id) OVER (PARTITION BY doc_id ORDER BY chunk) AS next_id FROM ch"


def _tokens(kind):
    def run(s, d):
        t = {"ascii": tx.ascii_tokens, "stopped": tx.content_tokens, "unicode": tx.unicode_tokens, "alias": lambda c: tx.canonical(tx.unicode_tokens(c))}[kind](F.col("text"))
        return docs(s, d).select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))

    return run


def tokens_sql(t):
    return f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {t} AS t FROM documents)"


UNI = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


def polarity_features(s, d):
    text = F.concat(F.col("event_type"), F.lit(" was not "), F.when(F.col("value") > 20, "approved").otherwise("denied"), F.lit(" refund"))
    return table(s, d, "events").select("event_id", F.array_join(tx.polarity_tokens(tx.unicode_tokens(text)), " ").alias("marks"))


POLARITY_FEATURES = f"""WITH t AS (SELECT event_id, string_split(lower(event_type) || ' was not ' || CASE WHEN value > 20 THEN 'approved' ELSE 'denied' END || ' refund', ' ') AS t FROM events),
c AS (SELECT event_id, t, list_filter(t, lambda x: len(x) > 2 AND NOT list_contains([{', '.join("'%s'" % w for w in tx.NEGATING + tx.DENYING + tx.AFFIRMING)}], x)) AS c FROM t)
SELECT event_id, array_to_string(list_concat(list_concat(CASE WHEN list_has_any(t, [{', '.join("'%s'" % w for w in tx.NEGATING)}]) THEN list_transform(c, lambda x: 'NEG_' || x) ELSE [] END, CASE WHEN list_has_any(t, [{', '.join("'%s'" % w for w in tx.DENYING)}]) THEN list_transform(c, lambda x: 'DENIED_' || x) ELSE [] END), CASE WHEN list_has_any(t, [{', '.join("'%s'" % w for w in tx.AFFIRMING)}]) THEN list_transform(c, lambda x: 'POS_' || x) ELSE [] END), ' ') AS marks FROM c"""


def term_freq(s, d):
    return docs(s, d).select("doc_id", F.explode(tx.content_tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


TERM_FREQ = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({stopped('text')}) AS term FROM documents) GROUP BY ALL"


def doc_freq(s, d):
    return docs(s, d).select(F.explode(F.array_distinct(tx.content_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


DOC_FREQ = f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({stopped('text')})) AS term FROM documents) GROUP BY ALL"


def bm25_topk(s, d):
    return scoring.top_k(scoring.bm25_literal(wins(s, d), {1: Q}), 10).select("window_id", "score", "rank")


BM25_TOPK = f"WITH {WIN}, {bm25_sql({1: Q}, 'win', 'window_id')} SELECT window_id, score, rank FROM ({top_sql('bm', 'window_id', 10)})"


def bm25_batch(s, d):
    return scoring.top_k(scoring.bm25_literal(wins(s, d), BATCH), 20).select("query_id", "window_id", "score", "rank")


BM25_BATCH = f"WITH {WIN}, {bm25_sql(BATCH, 'win', 'window_id')} {top_sql('bm', 'window_id', 20)}"


def phrase_head(s, d):
    return scoring.phrase_hits(wins(s, d), "thou of anes")


PHRASE_HEAD = f"WITH {WIN} SELECT window_id, 1.0::DOUBLE AS score FROM win WHERE contains(lower(text), 'thou anes') OR contains(lower(text), 'thou of anes')"


def query_patterns(s, d):
    rows = [(i, k, b, float(w)) for i, q in BATCH.items() for k, b, w in tx.query_patterns(q)]
    return s.createDataFrame(rows, "query_id long, kind string, body string, weight double")


QUERY_PATTERNS = f"""WITH q(query_id, q) AS {values(BATCH.items())}, t AS (SELECT query_id, string_split(q, ' ') AS t FROM q), p AS (
SELECT query_id, 'token' AS kind, unnest(t) AS body, 1.0 AS weight FROM t UNION ALL SELECT query_id, 'phrase', array_to_string(t, ' '), 2.0 FROM t WHERE len(t) > 1 UNION ALL
SELECT query_id, 'phrase', unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])), 1.5 FROM t)
SELECT CAST(query_id AS BIGINT) AS query_id, kind, body, CAST(max(weight) AS DOUBLE) AS weight FROM p GROUP BY query_id, kind, body"""


def _scored(column, name="score"):
    def run(s, d):
        return wins(s, d).select("window_id", F.round(column(F.col("text")), 6).alias(name)).where(F.col(name) > 0)

    return run


TRIE_SCORE = f"WITH {WIN} SELECT * FROM (SELECT window_id, round({pattern_sql(Q)}, 6) AS score FROM win) WHERE score > 0"
LITERAL_HITS = f"WITH {WIN} SELECT * FROM (SELECT window_id, round(0.35 * (length(text) - length(replace(lower(text), 'tion th', ''))) / 7, 6) AS score FROM win) WHERE score > 0"
REGEX_HITS = f"WITH {WIN} SELECT * FROM (SELECT window_id, CAST(len(regexp_extract_all(text, '(?i)th[aeiou]n')) AS DOUBLE) AS score FROM win) WHERE score > 0"
EXACT_EXPR = f"{pattern_sql('anes oner')} + 0.35 * (length(text) - length(replace(lower(text), 'anes oner', ''))) / 9 + len(regexp_extract_all(text, '(?i)th[aeiou]n'))"
EXACT_CHANNEL = f"WITH {WIN} SELECT * FROM (SELECT window_id, round({EXACT_EXPR}, 6) AS score FROM win) WHERE score > 0"


def _structure(tokens):
    return scoring.structure_score(tokens, line=F.col("n"), origin=F.lit("raw"), neighbors=(F.col("prev_id").isNotNull().cast("int") + F.col("next_id").isNotNull().cast("int")), metadata=F.concat_ws(" ", "source", F.lit("raw")))


def structure_channel(s, d):
    return windows.with_neighbors(windows.line_windows(docs(s, d))).select("window_id", F.round(_structure(["src1", "raw"]), 6).alias("score"))


NEIGH = f'lw AS ({LINE_WINDOWS}), nb AS (SELECT lw.*, d.source, lag(window_id) OVER o AS prev_id, lead(window_id) OVER o AS next_id FROM lw JOIN documents d USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY start, "end", window_id))'.replace("SELECT lw.*", "SELECT lw.window_id, lw.doc_id, lw.text, lw.n, lw.start")


def structure_sql(tokens):
    overlap = " + ".join(f"contains(lower(source || ' raw'), '{t}')::INT" for t in tokens)
    return f"least(0.45, 0.08 + 0.05 + least(0.08, 0.04 * ((prev_id IS NOT NULL)::INT + (next_id IS NOT NULL)::INT)) + least(0.18, 0.06 * ({overlap})))"


STRUCTURE_CHANNEL = f"WITH {NEIGH} SELECT window_id, round({structure_sql(['src1', 'raw'])}, 6)::DOUBLE AS score FROM nb"


def semantic_cosine(s, d):
    units = docs(s, d)
    q = s.createDataFrame([(1, Q)], "query_id long, text string")
    return scoring.top_k(scoring.semantic_scores(units, q, "doc_id"), 20, "doc_id").select("doc_id", "score", "rank")


def marks_sql(t: str) -> str:
    quoted = {k: "[" + ", ".join(f"'{w}'" for w in v) + "]" for k, v in tx.POLARITY.items()}
    every = "[" + ", ".join(f"'{w}'" for v in tx.POLARITY.values() for w in v) + "]"
    content = f"list_filter({t}, lambda x: len(x) > 2 AND NOT list_contains({every}, x))"
    return " || ".join(f"CASE WHEN list_has_any({t}, {words}) THEN list_transform({content}, lambda x: lower('{mark}') || x) ELSE [] END" for mark, words in quoted.items())


def vector_sql(units: str, unit: str, name: str) -> str:
    canon = f"list_transform(r || {marks_sql('r')}, lambda x: coalesce({ALIAS}[x], x))"
    return f"""{name}r AS (SELECT {unit}, {UNI} AS r FROM {units}), {name}t AS (SELECT {unit}, {canon} AS t FROM {name}r), {name}f AS (SELECT {unit}, unnest(list_distinct(t)) AS f, 1.0::DOUBLE AS w FROM {name}t UNION ALL SELECT {unit}, unnest(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))), 1.35 FROM {name}t),
{name}b AS (SELECT {unit}, ('0x' || substr(md5(f), 1, 8))::BIGINT % 256 AS bucket, sum(w) AS w FROM {name}f GROUP BY ALL), {name} AS (SELECT {unit}, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY {unit})) AS w FROM {name}b)"""


SEMANTIC_COSINE = f"""WITH qx(query_id, text) AS (VALUES (1, '{Q}')), {vector_sql('documents', 'doc_id', 'dv')}, {vector_sql('qx', 'query_id', 'qv')},
sc AS (SELECT query_id, doc_id, greatest(0, sum(dv.w * qv.w)) AS score FROM dv JOIN qv USING (bucket) GROUP BY ALL) SELECT doc_id, score, rank FROM ({top_sql('sc', 'doc_id', 20)})"""


def mrl_truncate_topk(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double")).alias("v"))
    q = e.where("vec_id = 0").select(F.col("v").alias("q")).limit(1)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    scored = e.join(F.broadcast(q)).withColumn("score", F.round(dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q")), 6))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).cast("long")).where("rank <= 50").select("vec_id", "score", "rank")


MRL_TRUNCATE_TOPK = "WITH e AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS v FROM embeddings), s AS (SELECT e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM e, e q WHERE q.vec_id = 0) SELECT * FROM (SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 50"


def trigram_prefilter(s, d):
    """Stage 0: as many windows as the plan for ten results scans."""
    scored = wins(s, d).select("window_id", tx.trigram_overlap(F.col("text"), Q).cast("long").alias("overlap")).where("overlap > 0")
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("overlap"), "window_id")).cast("long")).where(F.col("rank") <= plan(s, d).scan)


def plan_tiers(s, d):
    facts = wins(s, d).agg(F.count("*").alias("n")).join(table(s, d, "documents").agg(F.sum(F.octet_length("text")).alias("bytes"))).first()
    rows = [(b, k, p.tier, p.scan, p.candidates, p.rerank, p.partial) for k in (1, 10, 50) for b in ("auto", "fast", "thorough") for p in [planner.plan(k, facts.n, facts.bytes, budget=b)]]
    return s.createDataFrame(rows, "budget string, top_k long, tier string, scan long, candidates long, rerank long, partial boolean")


PLAN_TIERS = f"""WITH {WIN}, f AS (SELECT (SELECT count(*) FROM win) AS n, (SELECT sum(strlen(text)) FROM documents) AS b), k AS (SELECT * FROM (VALUES ('auto'), ('fast'), ('thorough')) b(budget), (VALUES (1), (10), (50)) k(k)),
t AS (SELECT *, greatest(CASE WHEN n <= 400 THEN 0 WHEN n <= 4000 THEN 1 ELSE 2 END, CASE WHEN b <= 2097152 THEN 0 WHEN b <= 33554432 THEN 1 ELSE 2 END) AS t FROM f, k),
l AS (SELECT *, CASE t WHEN 0 THEN n WHEN 1 THEN least(n, greatest(1200, 120 * k)) ELSE least(n, greatest(1500, 90 * k)) END AS scan, CASE t WHEN 0 THEN greatest(200, 30 * k) WHEN 1 THEN least(greatest(320, 40 * k), 1200) ELSE least(n, 5000) END AS c0, CASE t WHEN 0 THEN greatest(120, 20 * k) WHEN 1 THEN least(greatest(200, 25 * k), 320) ELSE least(n, 5000, 50) END AS r0 FROM t),
m AS (SELECT *, CASE budget WHEN 'thorough' THEN least(n, 2 * c0) WHEN 'fast' THEN greatest(5 * k, c0 // 2) ELSE c0 END AS c FROM l)
SELECT budget, CAST(k AS BIGINT) AS top_k, CASE t WHEN 0 THEN 'tiny' WHEN 1 THEN 'medium' ELSE 'huge' END AS tier, CAST(scan AS BIGINT) AS scan, CAST(c AS BIGINT) AS candidates, CAST(CASE budget WHEN 'thorough' THEN least(c, floor(1.5 * r0)) WHEN 'fast' THEN least(c, greatest(3 * k, r0 // 2)) ELSE r0 END AS BIGINT) AS rerank, n > scan AS partial FROM m"""


def channels(s, d):
    """The windows of all documents with their scores."""
    return search.scored(search.line_units(docs(s, d)), Q)


EXACT_Q = f"{pattern_sql(Q)} + 0.35 * (length(text) - length(replace(lower(text), '{Q}', ''))) / {len(Q)}"
CHANNELS = f"""{NEIGH}, qx(query_id, text) AS (VALUES (1, '{Q}')), {vector_sql('lw', 'window_id', 'wv')}, {vector_sql('qx', 'query_id', 'qv')},
sem AS (SELECT window_id, greatest(0, sum(wv.w * qv.w)) AS sem FROM wv JOIN qv USING (bucket) GROUP BY ALL),
chn AS (SELECT window_id, doc_id, text, round({EXACT_Q}, 6) AS exact, round(coalesce(sem, 0), 6) AS semantic, round({structure_sql(tx.query_tokens(Q))}, 6)::DOUBLE AS structure FROM nb LEFT JOIN sem USING (window_id)),
chs AS (SELECT *, round(exact * 0.58 + semantic * 0.30 + structure * 0.12, 4) AS score FROM chn)"""
CAND_ORDER = "score DESC, exact DESC, semantic DESC, doc_id, window_id"


def combined_score(s, d):
    return channels(s, d).select("window_id", "exact", "semantic", "structure", "score")


COMBINED_SCORE = f"WITH {CHANNELS} SELECT window_id, exact, semantic, structure, score FROM chs"


def plan(s, d, top_k=10):
    lines = F.size(F.filter(F.split("text", windows.SEPARATOR), lambda x: x.rlike(r"\S")))
    facts = docs(s, d).agg(F.sum(lines).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    return planner.plan(top_k, facts.n, facts.bytes)


PLAN_CTE = """pf AS (SELECT (SELECT count(*) FROM win) AS n, (SELECT sum(strlen(text)) FROM documents) AS b), pt AS (SELECT *, greatest(CASE WHEN n <= 400 THEN 0 WHEN n <= 4000 THEN 1 ELSE 2 END, CASE WHEN b <= 2097152 THEN 0 WHEN b <= 33554432 THEN 1 ELSE 2 END) AS t FROM pf),
pl AS (SELECT *, CASE t WHEN 0 THEN n WHEN 1 THEN least(n, 1200) ELSE least(n, 1500) END AS scan, CASE t WHEN 0 THEN 300 WHEN 1 THEN 400 ELSE least(n, 5000) END AS cand, CASE t WHEN 0 THEN 200 WHEN 1 THEN 250 ELSE least(n, 50) END AS rerank FROM pt)"""


TRIGRAM_PREFILTER = f"WITH {WIN}, {PLAN_CTE}, o AS (SELECT window_id, " + " + ".join(f"contains(lower(text), '{g.decode()}')::BIGINT" for g in tx.trigrams(Q.encode())) + " AS overlap FROM win) SELECT window_id, overlap, rank FROM (SELECT window_id, CAST(overlap AS BIGINT) AS overlap, row_number() OVER (ORDER BY overlap DESC, window_id) AS rank FROM o WHERE overlap > 0), pl WHERE rank <= scan"


def candidate_topk(s, d):
    """The candidates that the plan for ten results keeps, of all windows."""
    c = search.candidates(channels(s, d), plan(s, d).candidates)
    return c.select("window_id", "score", "phase", F.col("c").cast("long").alias("rank"))


CANDIDATE_TOPK = f"WITH {CHANNELS}, {WIN}, {PLAN_CTE} SELECT window_id, score, phase, rank FROM (SELECT window_id, score, CASE WHEN exact > 0 THEN 'exact' ELSE 'proxy' END AS phase, row_number() OVER (ORDER BY {CAND_ORDER}) AS rank FROM chs), pl WHERE rank <= cand"


def span_search(s, d):
    return search.span_search(docs(s, d), Q).results


QTOK = "[" + ", ".join(f"'{t}'" for t in dict.fromkeys(tx.query_tokens(Q))) + "]"
RERANK = f"0.25 * score + len(list_intersect(list_distinct({tok('text')}), {QTOK})) / {len(dict.fromkeys(tx.query_tokens(Q)))}.0"
RR_CTE = f"{CHANNELS}, {WIN}, {PLAN_CTE}, cand AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {CAND_ORDER}) AS c FROM chs), pl WHERE c <= cand), rr AS (SELECT *, round({RERANK}, 6) AS score2 FROM cand), fin AS (SELECT *, row_number() OVER (ORDER BY score2 DESC, window_id) AS rank FROM rr)"
PATTERNS = list(dict.fromkeys([b for _, b, _ in tx.query_patterns(Q)] + [Q]))
OVERLAP = " + ".join(f"contains(lower(text), '{g.decode()}')::BIGINT" for g in tx.trigrams(Q.encode()))
SPAN_SEARCH = f"""WITH {NEIGH}, {WIN}, {PLAN_CTE}, ov AS (SELECT *, {OVERLAP} AS overlap FROM nb), s0 AS (SELECT *, row_number() OVER (ORDER BY overlap DESC, window_id) AS r0 FROM ov), st AS (SELECT s0.* FROM s0, pl WHERE t = 0 OR pl.n <= scan OR (overlap > 0 AND r0 <= scan)),
qx(query_id, text) AS (VALUES (1, '{Q}')), {vector_sql('st', 'window_id', 'wv')}, {vector_sql('qx', 'query_id', 'qv')}, sem AS (SELECT window_id, greatest(0, sum(wv.w * qv.w)) AS sem FROM wv JOIN qv USING (bucket) GROUP BY ALL),
chn AS (SELECT window_id, doc_id, text, round({EXACT_Q}, 6) AS exact, round(coalesce(sem, 0), 6) AS semantic, round({structure_sql(tx.query_tokens(Q))}, 6)::DOUBLE AS structure FROM st LEFT JOIN sem USING (window_id)), chs AS (SELECT *, round(exact * 0.58 + semantic * 0.30 + structure * 0.12, 4) AS score FROM chn),
cn AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {CAND_ORDER}) AS c FROM chs), pl WHERE c <= cand), sh AS (SELECT * FROM (SELECT *, count(*) OVER () AS n_candidates, row_number() OVER (ORDER BY CASE WHEN t = 2 THEN -semantic ELSE c END, window_id) AS sr FROM cn) WHERE sr <= rerank),
rr AS (SELECT *, count(*) OVER () AS n_shortlist, round({RERANK}, 6) AS score2 FROM sh), fin AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score2 DESC, window_id) AS rank FROM rr) WHERE rank <= 10),
po AS (SELECT window_id, p, unnest(range(1, length(text) + 1)) AS i, lower(text) AS low FROM fin, (SELECT unnest({PATTERNS}) AS p)), sp AS (SELECT DISTINCT window_id, i - 1 AS start, i - 1 + length(p) AS "end" FROM po WHERE substring(low, i, length(p)) = p AND (p = '{Q}' OR NOT regexp_matches(CASE WHEN i > 1 THEN substring(low, i - 1, 1) ELSE '' END || substring(low, i + length(p), 1), '[a-z0-9]'))),
ra AS (SELECT *, max("end") OVER (PARTITION BY window_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM sp), gr AS (SELECT *, sum(CASE WHEN m IS NULL OR start > m THEN 1 ELSE 0 END) OVER (PARTITION BY window_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS isl FROM ra),
mg AS (SELECT window_id, min(start) AS start, max("end") AS "end" FROM gr GROUP BY window_id, isl), sl AS (SELECT window_id, string_agg(start || '-' || "end", ',' ORDER BY start) AS spans, arg_min(start, start) AS sa, arg_min("end", start) AS upto FROM mg GROUP BY window_id),
pr AS (SELECT *, coalesce(sa, 0) AS p0, coalesce(upto, least(length(text), 280)) AS p1 FROM fin LEFT JOIN sl USING (window_id)), lo AS (SELECT *, CASE WHEN spans IS NULL THEN 0 ELSE greatest(0, least(length(text) - 280, (p0 + p1) // 2 - 140)) END AS low FROM pr)
SELECT rank, window_id, score2 AS score, score AS combined, exact, semantic, structure, CASE WHEN exact > 0 THEN 'exact' ELSE 'proxy' END AS phase, coalesce(spans, '') AS spans, CAST(p0 AS BIGINT) AS primary_start, CAST(p1 AS BIGINT) AS primary_end, CAST(low AS BIGINT) AS snippet_start, substring(text, CAST(low + 1 AS BIGINT), 280) AS snippet, '[' || rank || ']' AS citation,
CASE t WHEN 0 THEN 'tiny' WHEN 1 THEN 'medium' ELSE 'huge' END AS tier, n > scan AS partial, CAST(CASE WHEN t = 0 OR n <= scan THEN n ELSE scan END AS BIGINT) AS scan_limit, n_candidates, n_shortlist FROM lo"""


def heuristic_rerank(s, d):
    c = search.candidates(channels(s, d), plan(s, d).candidates)
    return c.select("window_id", F.round(scoring.heuristic_rerank(F.col("score"), F.col("text"), Q), 6).alias("score"))


HEURISTIC_RERANK = f"WITH {RR_CTE} SELECT window_id, score2 AS score FROM rr"


# ---- chunk path


def _chunks(s, d, of=None):
    """The chunks, of all documents or of those in ``of`` (doc_id)."""
    held = docs(s, d) if of is None else docs(s, d).join(F.broadcast(of), "doc_id", "left_semi")
    return windows.token_chunks(held).withColumnRenamed("content", "text").select("chunk_id", "doc_id", "chunk", "token_count", "text")


def _facts(s, d):
    """(chunk_id, doc_id, chunk, token_count, trie, phrase, cosine, dl, tf0, ...): all that the heads take of a chunk.

    Every chunk is made and read once; the heads share this table, which has no texts.
    """
    text = F.col("text")
    facts = _chunks(s, d).select(
        "chunk_id", "doc_id", "chunk", "token_count", scoring.term_facts(text, {1: Q}).alias("terms"),
        F.round(scoring.pattern_score(text, Q), 6).alias("trie"), scoring.has_phrase(text, Q).alias("phrase"), F.round(scoring.semantic_column(text, Q), 6).alias("cosine"),
    )
    kept = cache.shared.get(facts)
    kept.count()  # filled by one job: jobs that start together would each make the chunks
    return scoring.unpacked(kept, "terms", {1: Q})


def _few(df):
    """A result of a fixed number of rows at most, taken now, so that plans over it stay small."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _heads(s, d):
    c = _facts(s, d)
    bm = scoring.bm25_of_facts(c, {1: Q}, "chunk_id").select("chunk_id", F.round("score", 6).alias("score"))
    # as in `semantic_scores`, without a cosine of 0
    cs = c.where("cosine > 0").select("chunk_id", F.col("cosine").alias("score"))
    return c, bm, cs


def _best(df, k, unit="chunk_id"):
    return df.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("score"), unit))).where(F.col("__r") <= k).drop("__r")


def sps_fusion(s, d):
    _, bm, cs = _heads(s, d)
    return fusion.sps(bm, cs, "chunk_id", 100)


CHUNK_HEADS = f"""{CHUNK_CTE}, {bm25_sql({1: Q}, 'ch', 'chunk_id', 'content')}, bmr AS (SELECT chunk_id, round(score, 6) AS score FROM bm), cx AS (SELECT chunk_id, content AS text FROM ch), qx(query_id, text) AS (VALUES (1, '{Q}')), {vector_sql('cx', 'chunk_id', 'cv')}, {vector_sql('qx', 'query_id', 'qv')},
csr AS (SELECT chunk_id, round(greatest(0, sum(cv.w * qv.w)), 6) AS score FROM cv JOIN qv USING (bucket) GROUP BY ALL),
sb AS (SELECT chunk_id, score AS b FROM bmr ORDER BY score DESC, chunk_id LIMIT 300), sc AS (SELECT chunk_id, score AS c FROM csr ORDER BY score DESC, chunk_id LIMIT 300),
spsr AS (SELECT chunk_id, round(0.6 * coalesce(b, 0) / (SELECT max(b) FROM sb) + 0.4 * coalesce(c, 0), 6) AS score FROM sb FULL JOIN sc USING (chunk_id)), sps AS (SELECT * FROM (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM spsr) WHERE rank <= 100)"""
SPS_FUSION = f"WITH {CHUNK_HEADS} SELECT * FROM sps"


#: Units that the cortical head looks at, and returns.
CORTICAL_CAP, CORTICAL_MOST = 2_000, 80


def _cortical(c):
    """(node, score, rank): the units that stand out by patterns and cosine, spread over neighbouring chunks, and gated."""
    found = c.select("chunk_id", "doc_id", "chunk", "token_count", "trie", F.col("cosine").alias("s"))
    top = found.agg(F.max("trie").alias("m"))  # one row
    salient = found.join(F.broadcast(top)).withColumns({"l": F.when(F.col("m") > 0, F.col("trie") / F.col("m")).otherwise(0.0)}).where("l + s > 0")
    order = Window.orderBy(F.desc(F.round(F.col("l") + F.col("s"), 9)), "chunk_id")
    kept = salient.withColumn("r", F.row_number().over(order)).where(F.col("r") <= CORTICAL_CAP).select(F.col("chunk_id").alias("node"), F.col("doc_id").alias("source"), "chunk", F.col("token_count").alias("cost"), "l", "s")
    kept = _few(kept)  # CORTICAL_CAP rows, read for the edges and in each step
    edges = graph.normalized(graph.rule_edges(kept.select("node", "source", "chunk")))
    return graph.gate(graph.diffuse(kept, edges), "cost", CORTICAL_MOST).select("node", "score", "rank")


def cortical_head(s, d):
    return _cortical(_facts(s, d))


CORTICAL_CTE = f"""ct AS (SELECT chunk_id, doc_id, chunk, token_count, round({pattern_sql(Q, 'content')}, 6) AS trie FROM ch), cm AS (SELECT ct.*, coalesce(csr.score, 0) AS s, CASE WHEN max(trie) OVER () > 0 THEN trie / max(trie) OVER () ELSE 0 END AS l FROM ct LEFT JOIN csr USING (chunk_id)),
ck AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY round(l + s, 9) DESC, chunk_id) AS r FROM cm WHERE l + s > 0) WHERE r <= {CORTICAL_CAP}), ce0 AS (SELECT a.chunk_id AS src, b.chunk_id AS dst FROM ck a JOIN ck b ON a.doc_id = b.doc_id AND abs(a.chunk - b.chunk) = 1), ce AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM ce0),
k1 AS (SELECT *, tanh(0.3 * l + 0.2 * s) AS c FROM ck), j1 AS (SELECT src AS chunk_id, sum(w * c) AS f FROM ce JOIN k1 ON ce.dst = k1.chunk_id GROUP BY src), k2 AS (SELECT ck.*, tanh(0.5 * coalesce(f, 0) + 0.3 * l + 0.2 * s) AS c FROM ck LEFT JOIN j1 USING (chunk_id)),
j2 AS (SELECT src AS chunk_id, sum(w * c) AS f FROM ce JOIN k2 ON ce.dst = k2.chunk_id GROUP BY src), k3 AS (SELECT ck.*, tanh(0.5 * coalesce(f, 0) + 0.3 * l + 0.2 * s) AS c FROM ck LEFT JOIN j2 USING (chunk_id)),
cg AS (SELECT chunk_id, round(0.35 * l + 0.35 * s + 0.20 * c - 0.10 * token_count / (SELECT max(token_count) FROM k3), 6) AS score FROM k3), cortical AS (SELECT * FROM (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM cg) WHERE rank <= {CORTICAL_MOST})"""
CORTICAL_HEAD = f"WITH {CHUNK_HEADS}, {CORTICAL_CTE} SELECT chunk_id AS node, score, rank FROM cortical"


def _fused(s, d, k=100):
    c, bm, cs = _heads(s, d)
    cortical = _cortical(c).select(F.col("node").alias("chunk_id"), "score")
    heads = {"sps": fusion.sps(bm, cs, "chunk_id", 100).select("chunk_id", "score"), "bm25": _best(bm, 100), "phrase": _best(c.where("phrase").select("chunk_id", F.lit(1.0).alias("score")), 100), "cortical": cortical}
    return fusion.rrf(heads, "chunk_id", k)


def rrf_fusion(s, d):
    return _fused(s, d)


def _phrase_where(column):
    terms = tx.query_terms(Q)
    return " OR ".join(f"contains(lower({column}), '{p}')" for p in sorted({" ".join(terms[i : i + n]) for n in (2, 3) for i in range(len(terms) - n + 1)} | {Q}))


RRF_CTE = f"""{CHUNK_HEADS}, {CORTICAL_CTE}, hd AS (SELECT chunk_id, 0 AS no, 'sps' AS head, rank AS r FROM sps UNION ALL SELECT * FROM (SELECT chunk_id, 1, 'bm25', row_number() OVER (ORDER BY score DESC, chunk_id) AS r FROM bmr) WHERE r <= 100 UNION ALL SELECT * FROM (SELECT chunk_id, 2, 'phrase', row_number() OVER (ORDER BY chunk_id) AS r FROM ch WHERE {_phrase_where('content')}) WHERE r <= 100 UNION ALL SELECT chunk_id, 3, 'cortical', rank FROM cortical),
fz AS (SELECT chunk_id, round(sum(1.0 / (60 + r)), 6) AS score, string_agg(head, ',' ORDER BY no) AS channels FROM hd GROUP BY chunk_id), fused AS (SELECT * FROM (SELECT chunk_id, score, channels, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM fz) WHERE rank <= 100)"""
RRF_FUSION = f"WITH {RRF_CTE} SELECT * FROM fused"


def adaptive_budget(s, d):
    return fusion.adaptive(_few(_fused(s, d)), 10, 20).select("chunk_id", "score", "rank", "widened")


ADAPTIVE_BUDGET = f"WITH {RRF_CTE}, fc AS (SELECT (max(CASE WHEN rank = 1 THEN score END) - coalesce(max(CASE WHEN rank = 5 THEN score END), 0)) < 0.15 OR count(*) < 10 AS widened FROM fused) SELECT chunk_id, score, rank, widened FROM fused, fc WHERE rank <= CASE WHEN widened THEN 60 ELSE 20 END"


def _sentences(units, unit):
    """(unit, pos, sentence, n): the sentences of at least twelve characters, and how many a unit has."""
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x)), lambda x: F.length(x) >= 12)
    return units.select(unit, parts.alias("p")).select(unit, F.size("p").alias("n"), F.posexplode("p").alias("pos", "sentence"))


def best_sentences(units, query, unit):
    """(unit, sentence, score): of each unit with two sentences or more the one nearest to the query, the first of equals."""
    s = units.sparkSession
    parts = _sentences(units, unit).where("n >= 2").withColumn("at", F.struct(unit, "pos"))
    q = s.createDataFrame([(1, query)], "query_id long, text string")
    scored = scoring.semantic_scores(parts.select("at", F.col("sentence").alias("text")), q, "at").select(F.col(f"at.{unit}").alias(unit), F.col("at.pos").alias("pos"), F.round("score", 6).alias("score"))
    best = scored.where("score > 0").groupBy(unit).agg(F.min(F.struct((-F.col("score")).alias("s"), "pos")).alias("b")).select(unit, F.col("b.pos").alias("pos"), (-F.col("b.s")).alias("score"))
    return parts.join(best, [unit, "pos"]).select(unit, "sentence", "score")


def multihead_search(s, d):
    """The fused heads re-ranked; the best sentence of a chunk is its span, where there is one."""
    fused = _few(_fused(s, d))  # 100 rows
    # texts are made again for the documents of the fused chunks only
    of = fused.select(F.split("chunk_id", ":")[0].cast("long").alias("doc_id")).distinct()
    hits = fused.select("chunk_id", "score", "channels").join(_chunks(s, d, of).select("chunk_id", "text"), "chunk_id")
    rr = hits.withColumn("score", F.round(scoring.heuristic_rerank(F.col("score"), F.col("text"), Q), 8))
    top = _few(rr.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")).cast("long")).where("rank <= 10"))
    best = best_sentences(top.select("chunk_id", "text"), Q, "chunk_id").select("chunk_id", "sentence")
    return top.join(best, "chunk_id", "left").select("chunk_id", "score", "channels", "rank", "sentence")


def sentence_sql(units: str, unit: str, name: str) -> str:
    return f"""{name}s0 AS (SELECT {unit}, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda x: trim(x)), lambda x: length(x) >= 12) AS p FROM {units}), {name}s1 AS (SELECT {unit}, unnest(p) AS text, generate_subscripts(p, 1) AS pos FROM {name}s0 WHERE len(p) >= 2), {name}s2 AS (SELECT {unit} || '#' || pos AS sid, {unit}, pos, text FROM {name}s1),
{vector_sql(name + 's2', 'sid', name + 'v')}, {name}q(query_id, text) AS (VALUES (1, '{Q}')), {vector_sql(name + 'q', 'query_id', name + 'w')}, {name}c AS (SELECT sid, round(sum({name}v.w * {name}w.w), 6) AS score FROM {name}v JOIN {name}w USING (bucket) GROUP BY sid),
{name} AS (SELECT {unit}, text AS sentence, score FROM (SELECT *, row_number() OVER (PARTITION BY {unit} ORDER BY score DESC, pos) AS r FROM {name}s2 JOIN {name}c USING (sid) WHERE score > 0) WHERE r = 1)"""


MULTIHEAD_SEARCH = f"WITH {RRF_CTE}, mh AS (SELECT chunk_id, channels, content AS text, round(0.25 * fused.score + len(list_intersect(list_distinct({tok('content')}), {QTOK})) / 4.0, 8) AS score FROM fused JOIN ch USING (chunk_id)), mt AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM mh) WHERE rank <= 10), {sentence_sql('mt', 'chunk_id', 'bs')} SELECT chunk_id, mt.score, channels, rank, sentence FROM mt LEFT JOIN bs USING (chunk_id)"


def best_sentence(s, d):
    """The sentence of each document that is nearest to the query."""
    return best_sentences(docs(s, d), Q, "doc_id")


BEST_SENTENCE = f"WITH {sentence_sql('documents', 'doc_id', 'bs')} SELECT doc_id, sentence, score FROM bs"


def _spans(s, d):
    found = wins(s, d).select("window_id", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.split(F.lower("text"), p).alias("x")) for p in ("tion", "onth", "nth")])).alias("y")).select("window_id", "y.p", "y.x")
    placed = found.select("window_id", "p", F.posexplode(F.slice("x", 1, F.size("x") - 1)).alias("i", "piece"))
    order = Window.partitionBy("window_id", "p").orderBy("i")
    end = F.sum(F.length("piece") + F.length("p")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("end", end.cast("long")).select("window_id", (F.col("end") - F.length("p")).alias("start"), "end")


def merge_spans(s, d):
    return windows.merge_spans(_spans(s, d), "window_id")


SPANS_CTE = f"""{WIN}, pt(p) AS (VALUES ('tion'), ('onth'), ('nth')), sx AS (SELECT window_id, p, string_split(lower(text), p) AS x FROM win, pt), sy AS (SELECT window_id, p, unnest(x[1:len(x) - 1]) AS piece, unnest(range(1, len(x))) AS i FROM sx WHERE len(x) > 1),
sp AS (SELECT window_id, e - length(p) AS start, e AS "end" FROM (SELECT *, sum(length(piece) + length(p)) OVER (PARTITION BY window_id, p ORDER BY i) AS e FROM sy))"""
MERGE_SPANS = f"""WITH {SPANS_CTE}, r AS (SELECT *, max("end") OVER (PARTITION BY window_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM sp), g AS (SELECT *, sum(CASE WHEN m IS NULL OR start > m THEN 1 ELSE 0 END) OVER (PARTITION BY window_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS isl FROM r)
SELECT window_id, CAST(min(start) AS BIGINT) AS start, CAST(max("end") AS BIGINT) AS "end" FROM g GROUP BY window_id, isl"""


def span_snippets(s, d):
    """A snippet around the middle of every hit."""
    low = F.lower("text")
    places = F.filter(F.sequence(F.lit(1), F.length("text")), lambda i: F.substring(low, i, F.lit(4)) == "tion")
    hits = wins(s, d).where(F.contains(low, F.lit("tion"))).select("window_id", "text", F.explode(places).alias("at"))
    w = hits.withColumn("len", F.length("text")).withColumn("low", search.snippet_start(F.col("at") - 1, F.col("at") + 3, F.col("len")).cast("int"))
    return w.select("window_id", (F.col("at") - 1).cast("long").alias("start"), F.col("low").cast("long").alias("snippet_start"), F.least(F.col("low") + 280, F.col("len")).cast("long").alias("snippet_end"), F.expr("substring(text, low + 1, 280)").alias("snippet"))


SPAN_SNIPPETS = f"WITH {WIN}, a AS (SELECT *, unnest(range(1, length(text) + 1)) AS pos, length(text) AS len FROM win WHERE contains(lower(text), 'tion')), b AS (SELECT *, greatest(0, least(len - 280, (pos - 1 + pos + 3) // 2 - 140)) AS low FROM a WHERE substring(lower(text), pos, 4) = 'tion') SELECT window_id, CAST(pos - 1 AS BIGINT) AS start, CAST(low AS BIGINT) AS snippet_start, CAST(least(low + 280, len) AS BIGINT) AS snippet_end, substring(text, CAST(low + 1 AS BIGINT), 280) AS snippet FROM b"


def citation_labels(s, d):
    return bm25_topk(s, d).select("window_id", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")).alias("label"))


CITATION_LABELS = f"SELECT window_id, '[' || rank || ']' AS label FROM ({BM25_TOPK})"


# ---- graph


def _turns(s, d):
    return table(s, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("node"), "conv_id", "turn", "text")


def cortical_adjacency(s, d):
    e = graph.normalized(graph.sequence_edges(_turns(s, d), "conv_id", "turn", "node", 2))
    return e.select("src", "dst", F.round("w", 6).alias("w"))


EDGE_CTE = """tn AS (SELECT conv_id || ':' || turn AS node, conv_id, turn, text FROM conversations), ed0 AS (SELECT a.node AS src, b.node AS dst, max(1.0 / abs(a.turn - b.turn)) AS w FROM tn a JOIN tn b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) BETWEEN 1 AND 2 GROUP BY ALL),
ed1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM ed0) WHERE r <= 8), ed AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM ed1)"""
CORTICAL_ADJACENCY = f"WITH {EDGE_CTE} SELECT src, dst, round(w, 6)::DOUBLE AS w FROM ed"


def _nodes(s, d):
    t = _turns(s, d)
    size = F.size(tx.ascii_tokens(F.col("text")))
    return t.select("node", F.round(F.log1p(tx.pattern_count(F.col("text"), "thou").cast("double")), 6).alias("l"), F.round(scoring.overlap_ratio(F.col("text"), Q), 6).alias("s"), size.alias("cost"))


def diffusion(s, d):
    e = graph.normalized(graph.sequence_edges(_turns(s, d), "conv_id", "turn", "node", 2))
    return graph.diffuse(_nodes(s, d), e).select("node", F.round("c", 6).alias("c"))


NODE_CTE = f"""{EDGE_CTE}, nd AS (SELECT node, round(ln(1 + len(list_filter({tok('text')}, lambda x: x = 'thou'))), 6)::DOUBLE AS l, round(len(list_intersect(list_distinct({tok('text')}), {QTOK})) / 4.0, 6)::DOUBLE AS s, len({tok('text')}) AS cost FROM tn),
c1 AS (SELECT *, tanh(0.3 * l + 0.2 * s) AS c FROM nd), i1 AS (SELECT src AS node, sum(w * c) AS f FROM ed JOIN c1 ON ed.dst = c1.node GROUP BY src), c2 AS (SELECT nd.*, tanh(0.5 * coalesce(f, 0) + 0.3 * l + 0.2 * s) AS c FROM nd LEFT JOIN i1 USING (node)), i2 AS (SELECT src AS node, sum(w * c) AS f FROM ed JOIN c2 ON ed.dst = c2.node GROUP BY src), c3 AS (SELECT nd.*, tanh(0.5 * coalesce(f, 0) + 0.3 * l + 0.2 * s) AS c FROM nd LEFT JOIN i2 USING (node))"""
DIFFUSION = f"WITH {NODE_CTE} SELECT node, round(c, 6) AS c FROM c3"


def gate(s, d):
    e = graph.normalized(graph.sequence_edges(_turns(s, d), "conv_id", "turn", "node", 2))
    return graph.gate(graph.diffuse(_nodes(s, d), e), "cost", 80).select("node", "score", "rank")


GATE = f"WITH {NODE_CTE}, gt AS (SELECT node, round(0.35 * l + 0.35 * s + 0.20 * c - 0.10 * cost / (SELECT max(cost) FROM c3), 6) AS score FROM c3) SELECT * FROM (SELECT node, score, row_number() OVER (ORDER BY score DESC, node) AS rank FROM gt) WHERE rank <= 80"


def cortical_search(s, d):
    active = graph.diffuse(_nodes(s, d).where("l + s > 0"), graph.normalized(graph.sequence_edges(_turns(s, d), "conv_id", "turn", "node", 2)))
    return graph.gate(active, "cost", 20).select("node", "score", "rank")


CORTICAL_SEARCH = f"WITH {NODE_CTE.replace('FROM tn),', 'FROM tn WHERE true),').replace('c1 AS (SELECT *, tanh', 'nz AS (SELECT * FROM nd WHERE l + s > 0), c1 AS (SELECT *, tanh').replace('AS c FROM nd)', 'AS c FROM nz)').replace('SELECT nd.*', 'SELECT nz.*').replace('FROM nd LEFT', 'FROM nz LEFT')}, gt AS (SELECT node, round(0.35 * l + 0.35 * s + 0.20 * c - 0.10 * cost / (SELECT max(cost) FROM c3), 6) AS score FROM c3) SELECT * FROM (SELECT node, score, row_number() OVER (ORDER BY score DESC, node) AS rank FROM gt) WHERE rank <= 20"


QUERIES = {
    "line_windows": (line_windows, LINE_WINDOWS), "window_neighbors": (window_neighbors, WINDOW_NEIGHBORS), "token_chunks": (token_chunks, TOKEN_CHUNKS), "chunk_adjacency": (chunk_adjacency, CHUNK_ADJACENCY),
    "tokenize_ascii": (_tokens("ascii"), tokens_sql(tok("text"))), "tokenize_stopped": (_tokens("stopped"), tokens_sql(stopped("text"))), "tokenize_unicode": (_tokens("unicode"), tokens_sql(UNI)),
    "alias_canonical": (_tokens("alias"), tokens_sql(f"list_transform({UNI}, lambda x: coalesce({ALIAS}[x], x))")), "polarity_features": (polarity_features, POLARITY_FEATURES),
    "term_freq": (term_freq, TERM_FREQ), "doc_freq": (doc_freq, DOC_FREQ), "bm25_topk": (bm25_topk, BM25_TOPK), "bm25_batch": (bm25_batch, BM25_BATCH), "phrase_head": (phrase_head, PHRASE_HEAD), "query_patterns": (query_patterns, QUERY_PATTERNS),
    "trie_score": (_scored(lambda t: scoring.pattern_score(t, Q)), TRIE_SCORE), "literal_hits": (_scored(lambda t: scoring.literal_score(t, "tion th")), LITERAL_HITS), "regex_hits": (_scored(lambda t: scoring.regex_score(t, tx.query_regexes(REGEX_Q))), REGEX_HITS),
    "exact_channel": (_scored(lambda t: scoring.exact_score(t, REGEX_Q)), EXACT_CHANNEL), "structure_channel": (structure_channel, STRUCTURE_CHANNEL), "semantic_cosine": (semantic_cosine, SEMANTIC_COSINE), "mrl_truncate_topk": (mrl_truncate_topk, MRL_TRUNCATE_TOPK),
    "combined_score": (combined_score, COMBINED_SCORE), "trigram_prefilter": (trigram_prefilter, TRIGRAM_PREFILTER), "plan_tiers": (plan_tiers, PLAN_TIERS), "candidate_topk": (candidate_topk, CANDIDATE_TOPK), "span_search": (span_search, SPAN_SEARCH), "heuristic_rerank": (heuristic_rerank, HEURISTIC_RERANK),
    "sps_fusion": (sps_fusion, SPS_FUSION), "rrf_fusion": (rrf_fusion, RRF_FUSION), "adaptive_budget": (adaptive_budget, ADAPTIVE_BUDGET), "multihead_search": (multihead_search, MULTIHEAD_SEARCH), "best_sentence": (best_sentence, BEST_SENTENCE),
    "merge_spans": (merge_spans, MERGE_SPANS), "span_snippets": (span_snippets, SPAN_SNIPPETS), "citation_labels": (citation_labels, CITATION_LABELS), "cortical_adjacency": (cortical_adjacency, CORTICAL_ADJACENCY), "diffusion": (diffusion, DIFFUSION), "cortical_head": (cortical_head, CORTICAL_HEAD), "gate": (gate, GATE), "cortical_search": (cortical_search, CORTICAL_SEARCH),
}

"""Scores of text units for a query."""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType
from pyspark.sql.window import Window

from spanloom.functions import text as tx

K1, B = 1.5, 0.75
EXACT_SHARE, SEMANTIC_SHARE, STRUCTURE_SHARE = 0.58, 0.30, 0.12
BUCKETS = 256


def bm25(units: DataFrame, queries: DataFrame, unit: str = "window_id") -> DataFrame:
    """(query_id, unit, score) for every query and unit with a positive score.

    ``queries``: (query_id, term, times), small: it is broadcast only if Spark's size
    check allows.  Only tokens that some query asks for are exploded.
    """
    tokens = units.select(unit, tx.content_tokens(F.col("text")).alias("tokens"))
    stats = tokens.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))  # one row
    terms = queries.select("term").distinct()
    tf = tokens.select(unit, F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(terms, "term").groupBy(unit, "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    joined = tf.join(df, "term").join(queries, "term").join(F.broadcast(stats))
    return joined.groupBy("query_id", unit).agg(F.sum(part * F.col("times")).alias("score")).where("score > 0")


def term_facts(text: Column, queries: dict[int, str]) -> Column:
    """What `bm25_of_facts` takes of a unit, as one array: its length and how often it has each term."""
    terms, stop = asked_terms(queries), frozenset(tx.STOP_WORDS)

    @F.pandas_udf(ArrayType(IntegerType()))
    def facts(lowered: pd.Series) -> pd.Series:
        def one(t: str) -> list[int]:
            words = re.findall("[a-z0-9]+", t)
            return [len(words) - sum(map(stop.__contains__, words)), *map(words.count, terms)]

        return lowered.map(one, na_action="ignore")

    return facts(F.lower(text))


def unpacked(facts: DataFrame, column: str, queries: dict[int, str]) -> DataFrame:
    """The array of `term_facts` as columns ``dl``, ``tf0`` and so on."""
    return facts.withColumns({"dl": F.get(column, F.lit(0)), **{f"tf{i}": F.get(column, F.lit(i + 1)) for i in range(len(asked_terms(queries)))}}).drop(column)


def asked_terms(queries: dict[int, str]) -> list[str]:
    return sorted({t for q in queries.values() for t in tx.query_terms(q)})


def bm25_of_facts(facts: DataFrame, queries: dict[int, str], unit: str) -> DataFrame:
    """`bm25_literal` of units whose `term_facts` are known."""
    terms = asked_terms(queries)
    if not terms:
        return facts.select(F.lit(0).cast("long").alias("query_id"), unit, F.lit(0.0).alias("score")).limit(0)
    stats = facts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])  # one row
    held = facts.where(F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0)) > 0)
    return _bm25_scores(held, stats, queries, unit)


def _bm25_scores(held: DataFrame, stats: DataFrame, queries: dict[int, str], unit: str) -> DataFrame:
    terms = asked_terms(queries)

    def part(t: str) -> Column:
        i = terms.index(t)
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        return idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))

    scores = [F.struct(F.lit(i).cast("long").alias("query_id"), sum((part(t) for t in tx.query_terms(q)), F.lit(0.0)).alias("score")) for i, q in queries.items()]
    return held.join(F.broadcast(stats)).select(unit, F.explode(F.array(*scores)).alias("x")).select("x.query_id", unit, "x.score").where("score > 0")


def bm25_literal(units: DataFrame, queries: dict[int, str], unit: str = "window_id") -> DataFrame:
    """The same for queries that are known when the plan is made: two scans, and no shuffle.

    The first scan sums lengths and document frequencies to one row; the second scores
    the units that hold a term.
    """
    terms = asked_terms(queries)
    if not terms:
        return units.select(F.lit(0).cast("long").alias("query_id"), unit, F.lit(0.0).alias("score")).limit(0)
    lowered = units.select(unit, F.lower("text").alias("low"))

    def tf(t: str) -> Column:
        return F.when(F.contains("low", F.lit(t)), F.regexp_count("low", F.lit(rf"(?<![a-z0-9]){t}(?![a-z0-9])"))).otherwise(0)

    stats = lowered.agg(F.count("*").alias("n"), F.avg(tx.content_count(F.col("low"))).alias("avgdl"), *[F.sum((tf(t) > 0).cast("long")).alias(f"df{i}") for i, t in enumerate(terms)])  # one row
    held = lowered.where(F.col("low").rlike(rf"(?<![a-z0-9])(?:{'|'.join(terms)})(?![a-z0-9])"))
    held = held.select(unit, tx.content_count(F.col("low")).alias("dl"), *[tf(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    return _bm25_scores(held, stats, queries, unit)


def top_k(hits: DataFrame, k: int, unit: str = "window_id", score: str = "score") -> DataFrame:
    """Rank by the score rounded to six places, ties by the unit's id, within each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), unit)
    return hits.withColumn(score, F.round(score, 6)).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def query_table(spark, queries: dict[int, str]) -> DataFrame:
    rows = []
    for ident, text in queries.items():
        terms = tx.query_terms(text)
        rows += [(ident, t, terms.count(t)) for t in dict.fromkeys(terms)]
    return spark.createDataFrame(rows, "query_id long, term string, times long")


def pattern_score(text: Column, query: str) -> Column:
    """Sum over the query's patterns of weight * ln(1 + occurrences)."""
    total = F.lit(0.0)
    for _, body, weight in tx.query_patterns(query):
        total = total + F.lit(weight) * F.log1p(tx.pattern_count(text, body).cast("double"))
    return total


def literal_score(text: Column, query: str) -> Column:
    """0.35 for each occurrence of the whole query, overlapping ones too, if it is longer than two characters."""
    q = " ".join(query.lower().split())
    if len(q) <= 2:
        return F.lit(0.0)
    return F.lit(0.35) * F.regexp_count(F.lower(text), F.lit(f"(?={re.escape(q)})"))


def regex_score(text: Column, patterns: list[str]) -> Column:
    total = F.lit(0.0)
    for p in patterns:
        total = total + F.regexp_count(text, F.lit(f"(?i){p}")).cast("double")
    return total


def exact_score(text: Column, query: str) -> Column:
    plain = tx.REGEX_LITERAL.sub(" ", query)
    return pattern_score(text, query) + literal_score(text, plain) + regex_score(text, tx.query_regexes(query))


def structure_score(tokens: list[str], *, row=None, line=None, page=None, section=None, origin=None, neighbors=None, metadata=None) -> Column:
    """What a unit's place and source add, 0.45 at most."""
    present = lambda c, v: F.when(c.isNotNull(), v).otherwise(0.0) if c is not None else F.lit(0.0)
    score = present(row, 0.12) + present(line, 0.08) + present(page, 0.08) + present(section, 0.05)
    if origin is not None:
        score = score + F.when(origin == "raw", 0.05).when(origin == "connector", 0.03).when(origin == "stored", 0.02).otherwise(0.0)
    if neighbors is not None:
        score = score + F.least(F.lit(0.08), F.lit(0.04) * neighbors)
    if metadata is not None and tokens:
        overlap = F.lit(0)
        for t in tokens:
            overlap = overlap + F.contains(F.lower(metadata), F.lit(t)).cast("int")
        score = score + F.least(F.lit(0.18), F.lit(0.06) * overlap)
    return F.least(score, F.lit(0.45))


def with_features(units: DataFrame, unit: str) -> DataFrame:
    """(unit, t): words in canonical form, polarity marks included.

    The words are a column of their own, so that they are taken from the text once.
    """
    raw = units.select(unit, tx.unicode_tokens(F.col("text")).alias("raw"))
    marking = tx.literals([w for words in tx.POLARITY.values() for w in words])
    marked = F.when(F.arrays_overlap("raw", marking), F.transform(tx.polarity_tokens(F.col("raw")), F.lower)).otherwise(F.array().cast("array<string>"))
    return raw.select(unit, tx.canonical(F.concat("raw", marked)).alias("t"))


def hashed_vectors(units: DataFrame, unit: str, dim: int = BUCKETS) -> DataFrame:
    """(unit, bucket, w): L2-normalised bag of distinct features, hashed by MD5."""
    flat = with_features(units, unit)
    weighted = flat.select(unit, F.explode(F.concat(F.transform(F.array_distinct("t"), lambda x: F.struct(x.alias("f"), F.lit(tx.UNIGRAM_WEIGHT).alias("w"))), F.transform(F.array_distinct(tx.pairs(F.col("t"))), lambda x: F.struct(x.alias("f"), F.lit(tx.BIGRAM_WEIGHT).alias("w"))))).alias("x"))
    bucket = (F.conv(F.substring(F.md5("x.f"), 1, 8), 16, 10).cast("long") % dim).cast("int")
    sums = weighted.select(unit, bucket.alias("bucket"), F.col("x.w").alias("w")).groupBy(unit, "bucket").agg(F.sum("w").alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(unit)))
    return sums.withColumn("w", F.col("w") / norm)


def _bucketed(features: Column, weight: float, dim: int) -> Column:
    bucket = lambda f: (F.conv(F.substring(F.md5(f), 1, 8), 16, 10).cast("long") % dim).cast("int")
    return F.transform(features, lambda f: F.struct(bucket(f).alias("b"), F.lit(weight).alias("w")))


def _marked(words: list[str]) -> list[str]:
    """The words in canonical form with their polarity marks, as `with_features` gives them."""
    if not _MARKING.isdisjoint(words):
        content = [w for w in words if w not in _MARKING and len(w) > 2]
        words = words + [mark.lower() + w for mark, of in tx.POLARITY.items() if not set(of).isdisjoint(words) for w in content]
    return [tx.ALIASES.get(w, w) for w in words]


_MARKING = frozenset(w for words in tx.POLARITY.values() for w in words)
#: Words whose buckets a task holds at most.
MEMO = 1 << 18


def _cosine_with(query: np.ndarray, dim: int):
    """A column function from the words of a text, joined by spaces, to the cosine of its hashed vector with ``query``."""

    @F.pandas_udf(DoubleType())
    def cosine(joined: pd.Series) -> pd.Series:
        memo: dict[str, int] = {}
        md5 = hashlib.md5

        def bucket(f: str) -> int:
            return int.from_bytes(hashlib.md5(f.encode()).digest()[:4], "big") % dim

        def one(text: str) -> float:
            words = _marked(text.split(" ")) if text else []
            single = []
            for w in set(words):
                if (b := memo.get(w)) is None:
                    b = memo[w] = bucket(w)
                single.append(b)
            if len(memo) > MEMO:
                memo.clear()
            pairs = {f"{x} {y}" for x, y in zip(words, words[1:])}
            # of the first four bytes a power of two up to 256 leaves the last one's bits
            double = [md5(f.encode()).digest()[3] % dim for f in pairs] if 256 % dim == 0 else [bucket(f) for f in pairs]
            v = tx.UNIGRAM_WEIGHT * np.bincount(np.array(single, np.int64), minlength=dim) + tx.BIGRAM_WEIGHT * np.bincount(np.array(double, np.int64), minlength=dim)
            square = float(v @ v)
            return float(v @ query) / math.sqrt(square) if square else 0.0

        return joined.map(one, na_action="ignore").astype("float64")

    return cosine


def semantic_column(text: Column, query: str, dim: int = BUCKETS) -> Column:
    """Cosine of the hashed vectors of a text and a query that is known when the plan is made, not below 0."""
    words = _marked(re.findall(r"\w+", query.lower()))
    v = np.zeros(dim)
    for weight, features in ((tx.UNIGRAM_WEIGHT, set(words)), (tx.BIGRAM_WEIGHT, {f"{x} {y}" for x, y in zip(words, words[1:])})):
        for f in features:
            v[int.from_bytes(hashlib.md5(f.encode()).digest()[:4], "big") % dim] += weight
    norm = math.sqrt(v @ v) or 1.0
    return F.greatest(F.lit(0.0), F.coalesce(_cosine_with(v / norm, dim)(F.array_join(tx.unicode_tokens(text), " ")), F.lit(0.0)))


def semantic_scores(units: DataFrame, query: DataFrame, unit: str, dim: int = BUCKETS) -> DataFrame:
    """(query_id, unit, score): cosine of hashed vectors, not below 0; ``query`` has one row (query_id, text).

    Each unit's features are summed by bucket, normalised and met with the query inside
    its row, so nothing is shuffled.  Units with a cosine of 0 are left out.
    """
    q = hashed_vectors(query, "query_id", dim).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("q"))  # one row
    t = with_features(units, unit)
    weighted = F.sort_array(F.concat(_bucketed(F.array_distinct("t"), tx.UNIGRAM_WEIGHT, dim), _bucketed(F.array_distinct(tx.pairs(F.col("t"))), tx.BIGRAM_WEIGHT, dim)))
    rows = t.select(unit, weighted.alias("x")).join(F.broadcast(q))
    start = F.struct(F.lit(-1).alias("b"), F.lit(0.0).alias("run"), F.lit(0.0).alias("dot"), F.lit(0.0).alias("sq"))

    def close(a: Column, b: Column, run: Column) -> Column:
        """The finished bucket goes to the sums, and a new one begins."""
        done = a["run"]
        return F.struct(b.alias("b"), run.alias("run"), (a["dot"] + done * F.coalesce(F.try_element_at("q", a["b"]), F.lit(0.0))).alias("dot"), (a["sq"] + done * done).alias("sq"))

    def step(a: Column, x: Column) -> Column:
        same = F.struct(a["b"].alias("b"), (a["run"] + x["w"]).alias("run"), a["dot"].alias("dot"), a["sq"].alias("sq"))
        return F.when(a["b"] == x["b"], same).otherwise(close(a, x["b"], x["w"]))

    sums = rows.select("query_id", unit, F.aggregate("x", start, step, lambda a: close(a, F.lit(-1), F.lit(0.0))).alias("s"))
    score = F.when(F.col("s.sq") > 0, F.col("s.dot") / F.sqrt("s.sq")).otherwise(0.0)
    return sums.select("query_id", unit, F.greatest(F.lit(0.0), score).alias("score")).where("score > 0")


def has_phrase(text: Column, query: str) -> Column:
    """Whether a text holds any run of two or three non-stop words of the query, or the whole query."""
    terms = tx.query_terms(query)
    phrases = {" ".join(terms[i : i + n]) for n in (2, 3) for i in range(len(terms) - n + 1)} | {" ".join(query.lower().split())}
    lowered = F.lower(text)
    found = F.lit(False)
    for p in sorted(p for p in phrases if p):
        found = found | F.contains(lowered, F.lit(p))
    return found


def phrase_hits(units: DataFrame, query: str, unit: str = "window_id") -> DataFrame:
    """Units that hold any run of two or three non-stop words of the query, or the whole query."""
    return units.where(has_phrase(F.col("text"), query)).select(unit, F.lit(1.0).alias("score"))


def combined(exact: Column, semantic: Column, structure: Column) -> Column:
    return exact * EXACT_SHARE + semantic * SEMANTIC_SHARE + structure * STRUCTURE_SHARE


def overlap_ratio(text: Column, query: str) -> Column:
    """Share of the query's distinct words that the text has."""
    q = list(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))
    if not q:
        return F.lit(0.0)
    return F.size(F.array_intersect(F.array_distinct(tx.ascii_tokens(text)), tx.literals(q))) / F.lit(float(len(q)))


def heuristic_rerank(score: Column, text: Column, query: str) -> Column:
    return 0.25 * score + overlap_ratio(text, query)

"""Span search: planned, prefiltered, scored by three channels, re-ranked, with exact spans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.functions import text as tx
from spanloom.operators import scoring, windows
from spanloom.plans import planner

CHANNELS = ("exact", "semantic", "structure")
SNIPPET = 280


def checked_channels(names) -> tuple[str, ...]:
    """The channels to score; none, or one that there is not, is an error."""
    names = tuple(dict.fromkeys(names))
    if not names or set(names) - set(CHANNELS):
        raise ValueError(f"channels are {', '.join(CHANNELS)}; asked for: {', '.join(names) or 'none'}")
    return names


def line_units(docs: DataFrame) -> DataFrame:
    """(window_id, doc_id, source, text, n, neighbors): the windows of (doc_id, source, text), made inside each row, so with no shuffle.

    ``neighbors`` is how many of the windows before and after there are.
    """
    numbered = F.transform(F.filter(F.split("text", windows.SEPARATOR), lambda x: F.length(x) > 0), lambda x, i: F.struct((i + 1).alias("n"), x.alias("text")))
    kept = docs.select("doc_id", "source", F.filter(numbered, lambda x: x["text"].rlike(r"\S")).alias("w"))
    flat = kept.select("doc_id", "source", F.size("w").alias("many"), F.posexplode("w").alias("i", "x"))
    return flat.select(
        F.concat(F.lit("source:"), F.col("doc_id").cast("string"), F.lit(":record:0:window:"), F.col("x.n").cast("string")).alias("window_id"),
        "doc_id", "source", F.col("x.text").alias("text"), F.col("x.n").cast("long").alias("n"), ((F.col("i") > 0).cast("int") + (F.col("i") < F.col("many") - 1).cast("int")).alias("neighbors"),
    )


def scored(units: DataFrame, query: str, channels=CHANNELS, origin: str = "raw") -> DataFrame:
    """``units`` with exact, semantic, structure and score; units without any score are left out.  A channel that is not asked for is not computed."""
    names = checked_channels(channels)
    out = units
    if "semantic" in names:
        q = units.sparkSession.createDataFrame([(1, query)], "query_id long, text string")
        found = scoring.semantic_scores(units.select("window_id", "text"), q, "window_id").select("window_id", F.round("score", 6).alias("semantic"))
        out = out.join(found, "window_id", "left").withColumn("semantic", F.coalesce("semantic", F.lit(0.0)))
    structure = scoring.structure_score(tx.query_tokens(query), line=F.col("n"), origin=F.lit(origin), neighbors=F.col("neighbors"), metadata=F.concat_ws(" ", "source", F.lit(origin)))
    parts = {"exact": lambda: F.round(scoring.exact_score(F.col("text"), query), 6), "semantic": lambda: F.col("semantic"), "structure": lambda: F.round(structure, 6)}
    out = out.withColumns({name: parts[name]() if name in names else F.lit(0.0) for name in CHANNELS})
    total = scoring.combined(F.col("exact"), F.col("semantic"), F.col("structure"))
    return out.withColumn("score", F.round(total, 4)).where("exact > 0 or semantic > 0 or structure > 0")


def candidates(channels: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` units in the order of the candidates, with their place, ``c``, and ``phase``."""
    order = Window.orderBy(F.desc("score"), F.desc("exact"), F.desc("semantic"), "doc_id", "window_id")
    return channels.withColumn("c", F.row_number().over(order)).where(F.col("c") <= limit).withColumn("phase", F.when(F.col("exact") > 0, "exact").otherwise("proxy"))


def prefiltered(units: DataFrame, query: str, limit: int) -> DataFrame:
    """Stage 0: the units that share most trigrams with the query; those that share none are left out."""
    overlap = units.withColumn("overlap", tx.trigram_overlap(F.col("text"), query).cast("long")).where("overlap > 0")
    return overlap.withColumn("r", F.row_number().over(Window.orderBy(F.desc("overlap"), "window_id"))).where(F.col("r") <= limit).drop("r")


def exact_spans(units: DataFrame, query: str) -> DataFrame:
    """(window_id, spans): the places of the query's patterns, regexes and whole text, overlapping ones merged, as ``start-end`` with commas.

    Meant for results: every place of a text is looked at.
    """
    plain = " ".join(tx.REGEX_LITERAL.sub(" ", query).lower().split())
    low = F.lower("text")
    alone = lambda c: ~c.rlike("[a-z0-9]")
    span = "array<struct<start:bigint,end:bigint>>"

    def places(body: str, bounded: bool) -> Column:
        n = len(body)

        def here(i):
            same = F.substring(low, i, F.lit(n)) == body
            return same & alone(F.when(i > 1, F.substring(low, i - 1, F.lit(1))).otherwise("")) & alone(F.substring(low, i + n, F.lit(1))) if bounded else same

        found = F.filter(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1))), here)
        spans = F.transform(found, lambda i: F.struct((i - 1).cast("long").alias("start"), (i - 1 + n).cast("long").alias("end")))
        return F.when(F.contains(low, F.lit(body)), spans).otherwise(F.array().cast(span))

    arrays = [places(body, True) for body in dict.fromkeys(b for _, b, _ in tx.query_patterns(query))]
    if len(plain) > 2:
        arrays.append(places(plain, False))
    for pattern in tx.query_regexes(query):
        # places of regex matches: the lengths of what is between and inside them, in turn
        inside = F.regexp_extract_all("text", F.lit(f"(?i)({pattern})"), F.lit(0))
        between = F.split(F.col("text"), f"(?i)(?:{pattern})", -1)

        def after(a, x):
            start = F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(0)) + F.length(x["b"])
            return F.concat(a, F.array(F.struct(start.cast("long").alias("start"), (start + F.length(F.coalesce(x["m"], F.lit("")))).cast("long").alias("end"))))

        pieces = F.zip_with(between, inside, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
        arrays.append(F.slice(F.aggregate(pieces, F.array().cast(span), after), 1, F.size(inside)))
    if not arrays:
        return units.select("window_id", F.lit("").alias("spans")).limit(0)
    flat = units.select("window_id", F.explode(F.concat(*arrays)).alias("x")).select("window_id", "x.start", "x.end").distinct()
    merged = windows.merge_spans(flat, "window_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))
    return merged.groupBy("window_id").agg(F.array_join(listed, ",").alias("spans"), F.min(F.struct("start", "end")).alias("first"))


def snippet_start(start: Column, end: Column, length: Column) -> Column:
    """Where a snippet around the middle of a span begins."""
    return F.greatest(F.lit(0), F.least(length - SNIPPET, F.floor((start + end) / 2) - SNIPPET // 2)).cast("long")


@dataclass(frozen=True)
class Found:
    """Results, and the plan by which they were found."""

    plan: planner.QueryPlan
    results: DataFrame


def span_search(docs: DataFrame, query: str, top_k: int = 10, budget: str = "auto", channels=CHANNELS, origin: str = "raw") -> Found:
    """The best windows of (doc_id, source, text) for a query.

    One job counts windows and bytes, which give the plan.  Then, in one plan: stage 0 by
    trigrams if there are more windows than the plan scans, channels, candidates, in the huge tier the
    nearest of them by the semantic channel, re-ranking, spans.  Results say which phase found them, whether
    the search was partial, and how many windows each step had.  Windows without exact spans have
    their beginning as context.  No windows, no results.
    """
    checked_channels(channels)
    units = line_units(docs)
    lines = F.size(F.filter(F.split("text", windows.SEPARATOR), lambda x: x.rlike(r"\S")))
    facts = docs.agg(F.sum(lines).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = facts.n or 0
    plan = planner.plan(top_k, n, facts.bytes or 0, {origin}, budget)
    stage0 = plan.tier != "tiny" and n > plan.scan
    scanned = prefiltered(units, query, plan.scan) if stage0 else units
    limited = candidates(scored(scanned, query, channels, origin), plan.candidates)
    total = Window.partitionBy()  # over the candidates only
    near = Window.orderBy(F.desc("semantic"), "window_id") if plan.tier == "huge" else Window.orderBy("c")
    short = limited.withColumn("n_candidates", F.count("*").over(total)).withColumn("s", F.row_number().over(near)).where(F.col("s") <= plan.rerank)
    short = short.withColumn("n_shortlist", F.count("*").over(total)).withColumn("reranked", F.round(scoring.heuristic_rerank(F.col("score"), F.col("text"), query), 6))
    best = short.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("reranked"), "window_id")).cast("long")).where(F.col("rank") <= max(1, top_k))
    spans = exact_spans(best.select("window_id", "text"), query)
    length = F.length("text")
    out = best.join(spans, "window_id", "left").withColumns({"length": length, "at": F.coalesce("first.start", F.lit(0)), "to": F.coalesce("first.end", F.least(length, F.lit(SNIPPET)).cast("long"))})
    low = F.when(F.col("spans").isNull(), F.lit(0)).otherwise(snippet_start(F.col("at"), F.col("to"), F.col("length"))).cast("int")
    results = out.withColumn("low", low).select(
        "rank", "window_id", F.col("reranked").alias("score"), F.col("score").alias("combined"), "exact", "semantic", "structure", "phase",
        F.coalesce("spans", F.lit("")).alias("spans"), F.col("at").alias("primary_start"), F.col("to").alias("primary_end"),
        F.col("low").cast("long").alias("snippet_start"), F.expr(f"substring(text, low + 1, {SNIPPET})").alias("snippet"),
        F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("]")).alias("citation"),
        F.lit(plan.tier).alias("tier"), F.lit(plan.partial).alias("partial"), F.lit(plan.scan if stage0 else n).cast("long").alias("scan_limit"), "n_candidates", "n_shortlist",
    )
    return Found(plan, results)

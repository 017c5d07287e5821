"""Small cases of single operators."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import corpus, fusion, graph, rerank, scoring, search, sketch, windows
from spanloom.plans import cache, planner
from spanloom.sources import connectors, parsers, records, store
from spanloom.streaming import live


def test_lines_have_exact_offsets(spark):
    docs = spark.createDataFrame([(1, "s", "one\r\ntwo\n\n  \nth😀ree"), (2, "s", "")], "doc_id long, source string, text string")
    rows = {r.n: r for r in windows.line_windows(docs).collect()}
    assert [rows[n].text for n in (1, 2, 4)] == ["one", "two", "th😀ree"]
    text = "one\r\ntwo\n\n  \nth😀ree"
    assert all(text[r.start : r.end] == r.text for r in rows.values())


def test_chunks_overlap_and_keep_the_text(spark):
    text = "  a b  c d e f g h "
    docs = spark.createDataFrame([(1, "s", text)], "doc_id long, source string, text string")
    rows = windows.token_chunks(docs, 4, 2).orderBy("chunk").collect()
    assert [r.content for r in rows] == ["a b  c d", "c d e f", "e f g h"]
    assert all(text[r.start : r.end] == r.content for r in rows)


def test_spans_that_touch_are_merged(spark):
    spans = spark.createDataFrame([("w", 0, 3), ("w", 3, 5), ("w", 7, 9), ("w", 8, 12)], "w string, start long, end long")
    assert sorted((r.start, r.end) for r in windows.merge_spans(spans, "w").collect()) == [(0, 5), (7, 12)]


def test_patterns_count_at_word_boundaries(spark):
    df = spark.createDataFrame([("Card declined. card-declined, discard card declined2",)], "text string")
    row = df.select(tx.pattern_count(F.col("text"), "card").alias("a"), tx.pattern_count(F.col("text"), "card declined").alias("b")).first()
    assert (row.a, row.b) == (3, 1)


def test_query_patterns_keep_the_first_weight():
    assert tx.query_patterns("red car") == [("token", "red", 1.0), ("token", "car", 1.0), ("phrase", "red car", 2.0)]
    assert tx.query_regexes('x regex("a+") regex("(")') == ["a+"]


def test_opposite_polarity_is_less_alike(spark):
    units = spark.createDataFrame([(1, "refund request denied by bank"), (2, "refund request approved by bank"), (3, "refund inquiry rejected by bank")], "id long, text string")
    query = spark.createDataFrame([(0, "refund request rejected")], "query_id long, text string")
    s = {r.id: r.score for r in scoring.semantic_scores(units, query, "id").collect()}
    assert s[1] > s[2]


def test_bm25_orders_and_ignores_stop_words(spark):
    units = spark.createDataFrame([("a", "cat cat dog"), ("b", "cat bird bird bird"), ("c", "the fish")], "window_id string, text string")
    hits = scoring.bm25(units, scoring.query_table(spark, {1: "the cat"})).orderBy(F.desc("score")).collect()
    assert [h.window_id for h in hits] == ["a", "b"]
    assert scoring.bm25(units, scoring.query_table(spark, {1: "the"})).count() == 0


def test_rrf_sums_reciprocal_ranks(spark):
    a = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "id string, score double")
    b = spark.createDataFrame([("y", 5.0)], "id string, score double")
    rows = fusion.rrf({"a": a, "b": b}, "id", 10).orderBy("rank").collect()
    assert [(r.id, r.channels) for r in rows] == [("y", "a,b"), ("x", "a")]
    assert rows[0].score == round(1 / 62 + 1 / 61, 6)


def test_a_full_filter_has_an_estimate(spark):
    full = sketch.bloom_estimate(spark.range(sketch.BLOOM_BITS).withColumnRenamed("id", "bit")).first()
    assert tuple(full) == (sketch.BLOOM_BITS, 150_001.0)
    assert sketch.bloom_estimate(spark.range(0).withColumnRenamed("id", "bit")).first().estimate == 0.0


def test_diffusion_of_nothing_stays_zero(spark):
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 0.0)], "node string, l double, s double")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, w double")
    assert all(r.c == 0 for r in graph.diffuse(nodes, edges).collect())


def test_plan_tiers():
    assert planner.plan(5, 120, 1000).tier == "tiny"
    assert planner.plan(5, 2200, 1000).tier == "medium"
    huge = planner.plan(5, 18000, 1000)
    assert (huge.tier, huge.partial, huge.candidates, huge.rerank) == ("huge", True, 5000, 50)
    assert planner.plan(5, 120, 40 << 20).tier == "huge"


def test_formats(spark):
    rows = [("j", "x.json", None, '[{"a": {"b": 1}, "c": []}, {"a": [true, null]}]'), ("n", "x", None, '{"a": 1}\n{"a": 2}'), ("c", "x", None, "name,age\nAnn,3\n\nBob,\n"), ("m", "x.md", None, "# Title\n\nsome *text* here"), ("h", "x", None, "<html><p>a</p><script>no</script><p>b</p>"), ("e", "x", None, "  ")]
    docs = spark.createDataFrame(rows, "source_id string, name string, media_type string, content string")
    got = {(r.source_id, r.ordinal): (r.parser, r.text, r.row_number) for r in parsers.parse_documents(docs).collect()}
    assert got["j", 0] == ("json", "a.b: 1\nc: []", None) and got["j", 1][1] == "a[0]: True\na[1]: None"
    assert got["n", 1][1] == "a: 2" if ("n", 1) in got else True
    assert got["c", 0] == ("csv", "name: Ann | age: 3", 2)
    assert got["m", 0][1] == "Title\n\nsome text here" and got["h", 0][1] == "a b"
    assert not any(k[0] == "e" for k in got)


def test_payloads_that_cannot_be_read_give_error_rows(spark):
    rows = [("a", "x.json", None, "not json", None), ("b", "x.json", None, '[{"a": 1}, {"a": ', None), ("c", "x.txt", None, "h\n1\n\n2", "csv"), ("d", "x", None, ' [ {"k": "é"} , [] ]', None), ("e", "x.json", None, None, None), ("f", "x", None, "&lt;b&gt; <i>x &amp; y</i>", "html"), ("g", "x.ndjson", None, '{"a": 1}\r\n\n{"a": 22}\n', "json")]
    docs = spark.createDataFrame(rows, "source_id string, name string, media_type string, content string, parser_name string")
    got = {(r.source_id, r.ordinal): r for r in parsers.parse_documents(docs).collect()}
    assert got["a", 0].error and got["a", 0].text is None
    assert got["b", 0].text == "a: 1" and got["b", 1].error
    assert [(got["c", i].text, got["c", i].row_number, got["c", i].start, got["c", i].end) for i in (0, 1)] == [("h: 1", 2, 2, 3), ("h: 2", 4, 5, 6)]
    content = {r[0]: r[3] for r in rows}
    assert content["d"][got["d", 0].start : got["d", 0].end] == '{"k": "é"}' and got["d", 1].text == "[]"
    assert got["f", 0].text == "<b> x & y"
    assert [content["g"][got["g", i].start : got["g", i].end] for i in (0, 1)] == ['{"a": 1}', '{"a": 22}']
    assert not any(k[0] == "e" for k in got)


def test_quota_refuses_without_counting():
    ok, held = live.admit([0, 10, 20, 61], [6, 5, 4, 6], [], 10, 10)
    assert ok == [True, False, True, True] and [t for t, _ in held] == [20, 61]
    assert live.admit([0, 60], [6, 6], [], 10, 10)[0] == [True, False]  # 60 seconds later the first still counts


def test_streaming_quota_and_search(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("k", i, float(i * 10), 4.0) for i in range(6)]
    spark.createDataFrame(rows, "key string, request_id long, ts double, cost double").write.parquet(str(source))
    stream = spark.readStream.schema("key string, request_id long, ts double, cost double").parquet(str(source))
    q = live.quota(stream, 10, 100).writeStream.format("memory").queryName("quota_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want, _ = live.admit([r[2] for r in rows], [r[3] for r in rows], [], 10, 100)
    assert [r.admitted for r in spark.table("quota_out").orderBy("request_id").collect()] == want


def test_span_search_plans_scores_and_places(spark):
    rows = [(1, "notes", "Card was declined today.\nnothing here\n\nthe card declined, card Declined again"), (2, "other", "a declined payment\nxcardx"), (3, "empty", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    found = search.span_search(docs, 'card declined regex("pay[a-z]+")', top_k=5)
    assert (found.plan.tier, found.plan.partial) == ("tiny", False)
    got = {r.window_id: r for r in found.results.collect()}
    best = next(r for r in got.values() if r.rank == 1)
    assert best.window_id == "source:1:record:0:window:3" and best.spans == "4-17,19-32" and best.phase == "exact"
    text = "the card declined, card Declined again"
    assert text[best.primary_start : best.primary_end] == "card declined" and best.snippet == text
    assert got["source:2:record:0:window:1"].spans == "2-10,11-18"
    assert got["source:2:record:0:window:2"].spans == "" and got["source:2:record:0:window:2"].phase == "proxy"
    assert search.span_search(docs.where("doc_id = 3"), "card").results.count() == 0
    only = search.span_search(docs, "card", channels=("exact",)).results.collect()
    assert all(r.semantic == 0 and r.structure == 0 and r.exact > 0 for r in only) and len(only) == 3
    for names in ((), ("exact", "other")):
        with pytest.raises(ValueError):
            search.span_search(docs, "card", channels=names)


def test_rule_edges_keep_the_heaviest_rule(spark):
    rows = [(i, "s", i, 1 if i < 12 else 2, None, [11] if i == 1 else []) for i in range(1, 15)] + [(99, "t", 2, 1, "x", [1])]
    units = spark.createDataFrame(rows, "node long, source string, row long, page long, section string, explicit array<long>")
    e = {(r.src, r.dst): r.w for r in graph.rule_edges(units).collect()}
    assert e[1, 2] == 0.8 and e[1, 3] == 0.6 and e[1, 11] == 1.0 and (1, 99) not in e and (99, 1) not in e
    kept = graph.normalized(graph.rule_edges(units)).where("src = 1").collect()
    assert len(kept) == 8 and abs(sum(r.w for r in kept) - 1) < 1e-12


def test_records_and_limits(spark):
    with pytest.raises(ValueError, match="top_k"):
        records.check_limits(top_k=51)
    records.check_limits(top_k=50, connectors=3)
    rows = spark.createDataFrame([(1, "a", '{"x": 1}', None), (2, "b", " ", None), (3, "c", None, None), (4, "d", "text", "text/x")], "id long, name string, content string, media_type string")
    docs, errors = records.raw_sources(rows)
    assert {(r.source_id, r.media_type) for r in docs.collect()} == {("raw:1:a", "application/json"), ("raw:4:d", "text/x")}
    assert {r.source_id for r in errors.collect()} == {"raw:2:b", "raw:3:c"}


def test_connectors_go_on_when_one_fails(spark):
    connectors.register(spark)
    configs = [{"id": "w", "type": "webhook", "config": {"documents": [{"name": "n", "content": {"a": 1}}, {"content": " "}, {"content": "t"}]}}, {"id": "x", "type": "nowhere"}, {"id": "c", "type": "chat", "config": {"channels": {"general": [{"text": "hi"}, {}, {"text": "there"}]}}}, {"id": "b", "type": "webhook", "config": {"documents": [{"content": "ok"}, 7]}}]
    got = spark.read.format("connectors").option("configs", json.dumps(configs)).option("max_documents", 2).load().collect()
    assert sorted((r.connector_id, r.content) for r in got if not r.error) == [("b", "ok"), ("c", "hi\nthere"), ("w", "t"), ("w", '{"a":1}')]
    assert sorted(r.connector_id for r in got if r.error) == ["b", "x"]
    assert spark.read.format("connectors").load().count() == 0
    with pytest.raises(ValueError):
        connectors.registry.add("webhook", connectors.webhook)


def test_store_lists_expires_and_deletes(spark, tmp_path):
    now = datetime.datetime(2026, 1, 10)
    held = store.Store(spark, f"file://{tmp_path}/store")
    held.create_corpus("c1", "first", datetime.datetime(2026, 1, 1))
    held.create_corpus("c2", "short", datetime.datetime(2026, 1, 2), ttl_seconds=3600)
    shape = "source_id string, name string, media_type string, content string"
    errors = held.ingest(spark.createDataFrame([("s1", "a.csv", None, "h,k\n1,2\n3,4\n"), ("s2", "b.json", None, "{"), ("s3", "c.txt", None, "one\n\ntwo")], shape), datetime.datetime(2026, 1, 3), "c1")
    assert [r.source_id for r in errors.collect()] == ["s2"]
    held.ingest(spark.createDataFrame([("s4", "d.txt", None, "x")], shape), datetime.datetime(2026, 1, 4), "c2")
    held.ingest(spark.createDataFrame([("s5", "e.txt", None, "y")], shape), datetime.datetime(2026, 1, 5))
    assert [(r.corpus_id, r.status, r.n_sources, r.windows) for r in held.corpora(now).collect()] == [("c2", "expired", 1, 1), ("c1", "active", 2, 4)]
    assert [r.source_id for r in held.list_sources(now).collect()] == ["s5", "s1", "s3"]
    assert [(r.source_id, r.text) for r in held.documents(now, "c1").collect()] == [("s1", "h: 1 | k: 2"), ("s1", "h: 3 | k: 4"), ("s3", "one\n\ntwo")]
    held.delete_corpus("c1")
    assert [r.corpus_id for r in held.corpora(now).collect()] == ["c2"] and held.table("documents").count() == 2
    held.delete_sources(["s4"])
    assert [r.source_id for r in held.table("sources").collect()] == ["s5"]


def test_cache_keeps_by_content_time_and_number(spark):
    now = [0.0]
    kept = cache.IndexCache(most=2, ttl=10, clock=lambda: now[0])
    frames = [spark.range(n).selectExpr("id + 1 as x") for n in (3, 4, 5)]
    assert kept.get(frames[0]) is kept.get(spark.range(3).selectExpr("id + 1 as x")) and (kept.hits, kept.misses) == (1, 1)
    kept.get(frames[1])
    kept.get(frames[2])
    assert len(kept.held) == 2 and kept.key(frames[0]) not in kept.held
    now[0] = 11.0
    kept.get(frames[2])
    assert len(kept.held) == 1 and kept.misses == 4


def test_reranker_cascade_falls_back(spark):
    hits = spark.createDataFrame([("a", 1.0, "red car"), ("b", 2.0, "blue"), ("c", 0.5, "red")], "window_id string, score double, text string")

    def broken(ids, texts, query):
        raise OSError("no service")

    def some(ids, texts, query):
        return {i: 9.0 for i in ids if i == "c"}

    got = [(r.window_id, r.by, r.rank) for r in rerank.cascade(hits, "red car", 3, (broken, some)).orderBy("rank").collect()]
    assert got == [("c", 1, 1), ("a", -1, 2), ("b", -1, 3)]
    assert [r.window_id for r in rerank.cascade(hits, "red car", 2).orderBy("rank").collect()] == ["a", "c"]
    model = rerank.cross_encoder(lambda: lambda pairs: [float(len(t)) for _, t in pairs])
    assert model(["x"], [""], "q") == {"x": 0.5}


def test_sketch_of_a_stream_rotates(spark, tmp_path):
    s = sketch.GhostSketch(rotate_at=50)
    for i in range(200):
        s.add(f"w{i}")
    assert s.rotations >= 2 and s.holds("w199") and s.count("w199") >= 1
    again = sketch.GhostSketch(*s.state())
    assert again.holds("w199") and again.estimate() == s.estimate()
    spark.createDataFrame([("k", "the refund was refund")], "key string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, text string").parquet(str(tmp_path / "in"))
    q = sketch.sketched(stream, ["refund", "absent"]).writeStream.format("memory").queryName("sketch_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("sketch_out").first()
    assert (r.verdict, r.found, r.rotations, round(r.estimate)) == (True, 2, 0, 3)


def test_scripted_changes_of_a_set(spark):
    docs = spark.createDataFrame([("a", 0, "one"), ("b", 1, "two"), ("c", 2, "three")], "doc_id string, place long, text string")
    steps = [{"op": "add", "doc_id": "d", "text": "four"}, {"op": "delete", "doc_id": "b"}, {"op": "change", "doc_id": "a", "text": "uno"}, {"op": "reorder", "order": ["d", "c"]}]
    assert [(r.doc_id, r.text) for r in corpus.mutate(docs, steps).orderBy("place").collect()] == [("d", "four"), ("c", "three"), ("a", "uno")]
    with pytest.raises(ValueError):
        corpus.mutate(docs, [{"op": "swap"}])


def test_cases_projections_and_events(spark, tmp_path):
    cases = {"cases": [{"case_id": "x", "query": "q", "profiles": ["smoke"], "documents": [{"name": "n", "content": "c"}], "expected": [{"source": "n"}]}, {"case_id": "y", "query": "r", "profiles": ["full"]}]}
    (tmp_path / "a.json").write_text(json.dumps(cases, indent=1))
    assert [(r.case_id, r.documents[0].content) for r in corpus.load_cases(spark, str(tmp_path / "a.json"), "smoke").collect()] == [("x", "c")]
    (tmp_path / "b.json").write_text(json.dumps({"cases": [{"case_id": "z"}]}))
    with pytest.raises(Exception, match="needs case_id"):
        corpus.load_cases(spark, str(tmp_path / "b.json")).collect()
    weights = spark.createDataFrame([(1, 0, 3.0), (1, 1, 4.0), (2, 1, 1.0)], "feature int, dim int, v double")
    corpus.save_projection(weights, str(tmp_path / "w"))
    features = spark.createDataFrame([("u", 1, 2.0), ("v", 9, 1.0)], "unit string, feature long, w double")
    assert sorted((r.unit, r.dim, round(r.x, 9)) for r in corpus.project(features, spark.read.parquet(str(tmp_path / "w")), "unit").collect()) == [("u", 0, 0.6), ("u", 1, 0.8)]
    results = spark.createDataFrame([(1, "exact", "a"), (2, "proxy", "b")], "rank long, phase string, id string")
    assert [(r.phase, r.nth, r.data) for r in corpus.events(results, F.struct("id")).orderBy("nth").collect()] == [("done", 0, '{"results":2}'), ("exact_results", 1, '{"id":"a"}'), ("proxy_results", 2, '{"id":"b"}')]


def test_streams_of_progress_and_first_hits(spark, tmp_path):
    rows = [("k", 1.0, "nothing\nat all"), ("k", 2.0, "the card\n\nwas declined"), ("m", 3.0, "x")]
    spark.createDataFrame(rows, "stream_id string, at double, text string").write.parquet(str(tmp_path / "in"))

    def result(name, make):
        stream = spark.readStream.schema("stream_id string, at double, text string").parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.table(name).collect()))

    assert result("progress_out", live.progress) == [("k", 36, 4), ("m", 1, 1)]
    assert result("first_out", lambda s: live.first_hits(s, "declined", "at")) == [("k", 2.0)]


def test_bytes_become_text(spark):
    rows = [("a", "x.txt", None, bytearray(b"caf\xc3\xa9 \xff!")), ("b", "x.json", None, bytearray(b'{"a": 1}'))]
    docs = spark.createDataFrame(rows, "source_id string, name string, media_type string, content binary")
    got = {r.source_id: r.text for r in parsers.parse_documents(docs).collect()}
    assert got == {"a": "café \ufffd!", "b": "a: 1"}

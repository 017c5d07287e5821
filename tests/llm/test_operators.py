"""The operators against brute force, exact round trips or held-out accuracy, and their edge cases."""

import collections
import hashlib
import random
import re
import zlib
from html import unescape

import numpy as np
import pandas as pd
import pytest
import xxhash

import public_tokenizers
from pyspark.sql import functions as F
from spanloom.llm import byte_bpe, common, components, decontamination, hnsw, html_main_text, lm_scoring, queries, sharding, simhash, substring_dedup, toxicity, warc

SF = "/root/testdata/sf0.001"
EDGE = [(None, "a b", "x"), (None, None, "x"), (1, None, "x"), (2, "", "x"), (3, "one two three", "x"), (3, "one two three", "x"), (4, "w " * 30000, "x")]
EDGE_SCHEMA = "doc_id long, text string, n_words string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, EDGE_SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "documents pages labels".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = queries.queries()[name](spark, SF)
    result = con.execute(queries.oracle_sql()[name])
    assert [d[0] for d in result.description] == got.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(result.fetchall(), key=str)


def test_the_filter_keeps_all_keys(spark):
    keys = spark.range(0, 300_000, 3)
    held = common.MOST_BITS
    try:
        for common.MOST_BITS, most in ((held, 0.05), (1 << 20, 0.4), (1 << 18, 1.0)):
            has = common.member(keys, "id")
            assert keys.where(~has(F.col("id"))).count() == 0
            assert spark.range(300_000, 310_000).where(has(F.col("id"))).count() <= most * 10_000
    finally:
        common.MOST_BITS = held


def test_all_ten_queries_are_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.queries()] == list(range(1, 11))


# ---- 1


def test_main_text_of_made_up_pages():
    for page in html_main_text.labelled_pages(40, seed=99):
        inside = page[page.index("<!--[-->") + 8 : page.index("<!--]-->")]
        inside = re.sub(r"</?(?:a|b)\b[^>]*>", "", inside)
        want = "\n".join(x for x in (re.sub(r"\s+", " ", unescape(p)).strip() for p in re.split(r"<[^>]+>", inside)) if x)
        assert html_main_text.main_text(page) == want


def test_main_text_of_the_table(spark):
    pages = {r.page_id: r.html for r in common.table(spark, SF, "pages").collect()}
    for r in html_main_text.op1_html_main_text(spark, SF).collect():
        h = pages[r.page_id]
        body = re.sub(r"<[a-zA-Z/][^>]*$", "", h[h.find("<article>") + 9 :].split("</article>")[0])
        want = "\n".join(x for x in (re.sub(r"\s+", " ", unescape(p)).strip() for p in re.split(r"<[^>]+>", re.sub(r"</?b>", "", body))) if x)
        assert (r.text, r.n_chars) == (want, len(want))


@pytest.mark.parametrize("html, text", [(None, ""), ("", ""), ("<p>only one</p>", "only one"), ("a &amp; b < c", "a & b < c"), ("<nav>x y</nav>", ""), ("<article><h1>T</h1><p>a\n b &am", "T\na b &am"), ("<article><p>cut</p><p cla", "cut")])
def test_main_text_edges(html, text):
    assert html_main_text.main_text(html) == text


@pytest.mark.parametrize("attrs, furniture", [('href="/hidden-valley"', 0), ('href="/p?id=comments"', 0), ("href=/p?id=comments", 0), ('title="the hidden display: none"', 0), ('data-role="search"', 0), ('data-id="ad-7"', 0), ('style="overflow:hidden"', 0), ("hidden", 1), ("role='search'", 1), ('style="display: none"', 1), ('aria-hidden="true"', 1)])
def test_attributes_are_known_by_whole_names(attrs, furniture):
    assert html_main_text.marked_as_furniture("a", html_main_text.attributes(" " + attrs)) == bool(furniture)


BODY = "<h1>A title of this page</h1><p>" + "some words of the first paragraph " * 5 + "</p>{}<p>" + "and the words that follow after it " * 5 + "</p>"
FIRST, AFTER = "A title of this page\n" + " ".join(["some words of the first paragraph"] * 5), " ".join(["and the words that follow after it"] * 5)


@pytest.mark.parametrize("holder", ["<article>{}</article>", "<main>{}</main>", '<div id="content" style="overflow:hidden" data-role="navigation">{}</div>', "<div class=story><div>{}</div></div>"])
@pytest.mark.parametrize(
    "inserted, text",
    [
        ('<svg class="x" viewBox="0 0 1 1"/>', ""), ('<svg><title>no</title><path d="M0"/></svg>', ""), ('<p data-id="ad-7">kept one</p>', "kept one"), ('<div title="the hidden gem">kept two</div>', "kept two"),
        ('<section id="discussion"><h2>Head</h2><p>of it</p></section>', "Head\nof it"), ('<section class="legal-history"><h2>Head</h2><p>of it</p></section>', "Head\nof it"),
        ("<p>where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", "where x=1 holds"), ('<p><a href="/p?id=comments">a link</a></p>', "a link"), ("<p title=it's>an &eacute;t&#233;</p>", "an été"),
        ('<div class="ad">gone</div>', ""), ('<div id="cookie-notice">gone</div>', ""), ('<section class="comments-area"><h3>Two comments</h3><p>gone</p></section>', ""), ("<aside>gone</aside>", ""), ("<form><input><button>gone</button></form>", ""),
        ('<script>var a = "</p>";</script><style>p{}</style>', ""), ("<ul><li>one<li>two</ul>", "one\ntwo"), ("<p>a<br>b", "a\nb"), ("<!-- <p>gone</p> -->", ""),
    ],
)
def test_what_stands_in_an_article(holder, inserted, text):
    around = '<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav>{}<footer>&copy; us</footer></body></html>'
    page = around.format(holder.format(BODY.format(inserted)))
    assert html_main_text.main_text(page) == "\n".join(x for x in (FIRST, text, AFTER) if x)


def test_pages_are_read_in_linear_time():
    import time

    began = time.time()
    for page in ("<div>" * 200_000 + "words here " * 10, ("<div>a " * 100_000) + "</b>" * 100_000, "<b>" * 100_000 + "<p>x</p>" * 100_000, "<a href='" * 50_000, "<p " * 50_000, "x < y " * 100_000):
        html_main_text.main_text(page)
    assert time.time() - began < 60
    assert html_main_text.main_text("<div>" * 200_000 + "words here " * 10) == " ".join(["words here"] * 10)


def test_pages_with_edges_through_spark(spark):
    rows = [(None, "u", "<p>a b c</p>", 1), (1, None, None, 2), (2, "u", "", 3), (2, "u", "", 3), (3, "u", "<p>" + "long " * 200_000 + "</p>", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.url, r.n_chars) for r in html_main_text.extract(pages).collect()), key=str)
    assert got == sorted([(None, "u", 5), (1, None, 0), (2, "u", 0), (2, "u", 0), (3, "u", 999_999)], key=str)
    assert html_main_text.extract(pages.limit(0)).count() == 0


def test_best_region():
    assert html_main_text.best_region([1, -2, 3, -1, 2, -5, 1]) == (2, 5)
    assert html_main_text.best_region([-1, -2]) == (0, 0)


# ---- 2


def check_shards(rows, texts, slack):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    sizes = {k: sum(r["size"] for r in v) for k, v in by.items()}
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert max(sizes.values()) - min(sizes.values()) <= slack
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text_crc32, r["size"]) for r in rows) == sorted((d if d is not None else -1, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in texts)


def test_shards_of_the_table(spark):
    texts = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    rows = sharding.op2_sharding(spark, SF).collect()
    assert {r.shard for r in rows} == set(range(16)) and {r.law for r in rows} == {"bytes"}
    check_shards(rows, texts, 2 * max(len(t.encode()) for _, t in texts))


def test_shards_with_one_hot_text(spark, edge):
    texts = [(i, "hot " * 10) for i in range(400)] + [(i, f"other {i}") for i in range(800)]
    rows = sharding.shard_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check_shards(rows, texts, 2 * 41)
    assert len(sharding.shard_documents(edge).collect()) == len(EDGE)
    assert sharding.shard_documents(edge.limit(0)).count() == 0


def test_shards_with_one_hot_row(spark):
    texts = [(7, "the same row")] * 3_000 + [(i, f"other {i}") for i in range(500)]
    rows = sharding.shard_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    check_shards(rows, texts, 2 * 13)


# ---- 3


def test_chain_on_held_out_documents(spark):
    rnd = random.Random(5)
    plain = ["w%d" % i for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad, low = rnd.random() < 0.3, rnd.random() < 0.4
        words = [rnd.choice(plain) for _ in range(rnd.randint(5, 60))] + (["vile" + rnd.choice(["", "st", "ness", "ly"])] * 2 if bad else []) + (["spam", "offer"] if low else [])
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(not low), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if x[0] < 600], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.toxicity(docs, known).collect()}
    assert np.mean([got[i] == bool(t) for i, _, t in labels[600:]]) > 0.97
    kept = {r.doc_id for r in toxicity.without_toxic(docs, known).collect()}
    assert kept == {i for i, t in got.items() if not t}


def test_chain_edges(spark, edge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.toxic for r in toxicity.toxicity(edge, none).collect()] == [False] * len(EDGE)
    one = spark.createDataFrame([(3, 1, 0), (3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(edge, one).where("toxic").count() == 0
    assert toxicity.toxicity(edge.limit(0), one).count() == 0
    names = edge.withColumnRenamed("n_words", "toxic").withColumn("quality", F.lit(1)).withColumn("p", F.lit(0.5))
    assert toxicity.toxicity(names, one).count() == len(EDGE)
    assert toxicity.without_toxic(names, one).columns == names.columns


# ---- 4


def removed_by_brute_force(rows):
    words = [(t or "").encode().split() for _, t in rows]
    owner = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - 49 if d is not None else 0):
            x = tuple(w[i : i + 50])
            owner[x] = min(owner.get(x, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - 49 if d is not None else 0):
            if owner[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(30)]
    blocks = [[rnd.choice(vocabulary) for _ in range(70)] for _ in range(5)]
    rows = []
    for _ in range(n):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, 25)
            text += rnd.choice(blocks)[at : at + rnd.randint(40, 70)] + [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 20))]
        rows.append((rnd.randint(0, 80), " ".join(text)))
    return rows + [(None, " ".join(blocks[0])), (90, " ".join(blocks[0])), (91, " ".join(blocks[0])), (91, " ".join(blocks[0])), (92, "x\n" * 300), (93, "x\t" * 120), (94, None), (95, "")]


@pytest.mark.parametrize("batches", [1, 6])
def test_substring_dedup_equals_brute_force(spark, batches):
    rows = passages(batches, 80)
    docs = spark.createDataFrame([(d, t, "extra") for d, t in rows], "doc_id long, text string, content string")
    got = sorted((tuple(r) for r in substring_dedup.removals(docs, batches).collect()), key=str)
    want = removed_by_brute_force(rows)
    assert got == want and sum(r[2] > 0 for r in want) > 10
    texts = sorted(hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() for r in substring_dedup.without_repeats(docs, batches).collect())
    assert texts == sorted(r[3] for r in want)
    assert substring_dedup.removals(docs.limit(0)).count() == 0


def test_the_index_is_compacted_saved_and_taken_up_again(spark, tmp_path):
    rows = [r for r in passages(11, 60) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = [docs.where(f"doc_id >= {a} and doc_id < {b}") for a, b in ((0, 20), (20, 40), (40, 60), (60, 100))]
    index = substring_dedup.FingerprintIndex(spark)
    decided = [index.add(p)[1] for p in parts[:3]]
    assert index.compactions == 3 and all(len(r) == 2 for r in index.runs.values())
    index.save(str(tmp_path / "manifest"))
    later = substring_dedup.FingerprintIndex.load(spark, str(tmp_path / "manifest"), parts[:3])
    assert later.batches == 3
    decided.append(later.add(parts[3])[1])
    got = {r.doc_id for d in decided for r in d.collect()}
    assert got == {r[0] for r in removed_by_brute_force(rows) if r[2]}


# ---- 5


def components_by_brute_force(values, bound):
    ids = sorted(values)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (values[a] ^ values[b]).bit_count() <= bound:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def slow_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())) if w]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in common.table(spark, SF, "documents").collect()}
    prints = {d: slow_fingerprint(t) for d, t in texts.items()}
    want = components_by_brute_force(prints, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op5_simhash(spark, SF).collect()}
    assert got == {d: ("%016x" % prints[d], want[d]) for d in texts}


def test_gray_index_finds_every_pair():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (60, 30), dtype=np.uint64)
    fps = np.unique(np.concatenate([base, (base[:, None] ^ flips).ravel()]))
    held = simhash.HELD
    try:
        for simhash.HELD in (held, 64):  # whole, and in small parts
            for exact in (0, 16, 21):
                index = simhash.GrayIndex(fps, exact)
                for bound in (0, 1, 3):
                    got = [(int(fps[x]), int(index.fps[y])) for q, f in index.pairs(fps, bound) for x, y in zip(q, f)]
                    want = {(int(a), int(b)) for a in fps for b in fps if (int(a) ^ int(b)).bit_count() <= bound and int(a ^ b) >> (64 - exact) == 0}
                    assert set(got) == want and len(got) == len(want)
    finally:
        simhash.HELD = held


@pytest.mark.parametrize("bound", [2, 3])
def test_links_give_the_components_of_all_pairs(spark, bound):
    rnd = random.Random(bound)
    values = [rnd.getrandbits(64) for _ in range(80)]
    for _ in range(300):
        x = rnd.choice(values)
        for _ in range(rnd.randint(1, 4)):
            x ^= 1 << rnd.randint(0, 63)
        values.append(x)
    prints = dict(enumerate(dict.fromkeys(values)))
    held, simhash.GROUP = simhash.GROUP, 50
    try:
        rows = [(0, x - (1 << 64) if x >> 63 else x, i) for i, x in prints.items()]
        links = simhash.near_links(spark.createDataFrame(rows, "t int, fp long, node long"), bound)
        got = {r.node: r.component for r in components.connected_components(links).collect()}
    finally:
        simhash.GROUP = held
    assert {i: got.get(i, i) for i in prints} == components_by_brute_force(prints, bound)


def test_one_large_group_of_near_fingerprints(spark):
    rng = np.random.default_rng(3)
    flips = (np.uint64(1) << rng.integers(0, 64, (20_000, 3), dtype=np.uint64))
    fps = np.unique(np.uint64(0x0123456789ABCDEF) ^ flips[:, 0] ^ flips[:, 1] ^ flips[:, 2])
    nodes = spark.createDataFrame(pd.DataFrame({"t": 0, "fp": fps.view(np.int64), "node": np.arange(len(fps))}), "t int, fp long, node long")
    links = simhash.near_links(nodes, 2)
    assert links.count() <= 3 * len(fps)  # forests, not pairs
    got = components.connected_components(links).groupBy("component").count().collect()
    assert [(r.component, r["count"]) for r in got] == [(0, len(fps))]


def test_simhash_edges(spark, edge):
    rows = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(edge, 3, 2).collect()]
    assert sorted(rows, key=str) == sorted([(None, None), (None, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 4)], key=str)
    assert simhash.near_duplicates(edge.limit(0)).count() == 0
    assert sorted(r.doc_id or -1 for r in simhash.keep_one(edge).collect()) == [-1, -1, 1, 3, 3, 4]


def test_near_duplicates_are_removed_by_their_shingles(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(60):
        words = ["v%d" % rnd.randint(0, 500) for _ in range(120)]
        edited = list(words)
        for j in rnd.sample(range(120), 2):  # two words in 120 are others: about 0.84 of the shingles stay
            edited[j] = "edit%d" % rnd.randint(0, 500)
        other = sorted(words)  # the same words, no shingle of the text
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(other)), (10 * i + 2, " ".join(edited)), (10 * i + 2, "alone %d" % i), (10 * i + 3, " ".join(words))]
    rows += [(9000, ""), (9001, " "), (None, rows[0][1])]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    kept = []
    for d, t in sorted((r for r in rows if r[0] is not None)):
        s = shingles(t)
        if not any(k < d and (len(s & x) / len(s | x) if s | x else 1.0) >= 0.8 for k, _, x in kept):
            kept.append((d, t, s))
    want = [(d, t) for d, t, _ in kept] + [(None, rows[0][1])]
    got = [(r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert not set(want) - set(got)  # no text without a near one goes
    assert len(set(got) - set(want)) <= 1  # candidates are found by fingerprints


def most_join_rows(spark, after):
    """The most rows that a join made in the SQL executions from number ``after`` on, and the number of the next execution."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most, n = 0, store.executionsCount()
    for i in range(n):
        at = store.executionsList().apply(i).executionId()
        if at < after:
            continue
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "Join" in node.name():
                for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    found = values.get(m.accumulatorId())
                    if m.name() == "number of output rows" and found.isDefined():
                        most = max(most, int(found.get().replace(",", "").split()[0]))
    return most, store.executionsList().apply(n - 1).executionId() + 1


def copies_of(template, n, part, rnd):
    """Copies of which each has its own words in up to ``part`` of the places."""
    out = []
    for _ in range(n):
        words = list(template)
        for j in rnd.sample(range(len(words)), int(rnd.random() * part * len(words))):
            words[j] = "own%d" % rnd.randint(0, 1 << 40)
        out.append(words)
    return out


def groups_by_all_pairs(texts, least=0.8, width=5):
    """For each text the first of its group: single linkage over every pair."""
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in texts]
    of = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if of[i] != of[j] and (len(sets[i] & sets[j]) >= least * union - 1e-9):
                a, b = sorted((of[i], of[j]))
                of = [a if x == b else x for x in of]
    return of


@pytest.mark.parametrize("slice_size", [simhash.SLICE, 400])
def test_no_link_between_candidates_is_lost(spark, monkeypatch, slice_size):
    rnd = random.Random(5)
    base = ["t%d" % i for i in range(120)]
    other = [w if i % 9 else "u%d" % i for i, w in enumerate(base)]  # another group, of the same words mostly
    texts = [["first", "of", "all"]] + copies_of(base, 60, 0.1, rnd) + copies_of(other, 60, 0.1, rnd) + [base[:k] for k in (60, 75, 94, 100, 115)] + [[], [" "]]
    texts += [x[:-1] + ["end%d" % i] for i, x in enumerate(texts[5:40])] + [["a", "b"], ["A", "b"], ["w%d" % rnd.randint(0, 9) for _ in range(80)]]
    rnd.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    # all are candidates: one component
    monkeypatch.setattr(simhash, "_components", lambda nodes, tables, bound: nodes.select("node", F.lit(0).cast("long").alias("component")))
    monkeypatch.setattr(simhash, "SLICE", slice_size)
    want = [i for i, x in enumerate(groups_by_all_pairs([" ".join(w).lower().split() for w in texts])) if i == x]
    assert 30 < len(want) < len(texts) - 30
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == want


def test_joins_follow_the_texts_and_not_their_pairs(spark):
    rnd = random.Random(6)
    base = ["t%d" % i for i in range(200)]
    texts = copies_of(base, 500, 0.06, rnd)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    _, at = most_join_rows(spark, 1 << 60)
    simhash.keep_one(docs).collect()
    most, _ = most_join_rows(spark, at)
    assert 0 < most < 60 * len(texts)


def test_components_read_a_large_group_s_links_once(spark):
    n = 2_000  # a path between two stars, each link given several times
    links = [(i, 0) for i in range(1, n)] + [(i, n) for i in range(n + 1, 2 * n)] + [(2 * n + i, 2 * n + i + 1) for i in range(40)] + [(n - 1, 2 * n), (2 * n + 40, 2 * n - 1)]
    df = spark.createDataFrame(links + [(b, a) for a, b in links], "a long, b long")
    _, at = most_join_rows(spark, 1 << 60)
    got = components.connected_components(df).groupBy("component").count().collect()
    most, _ = most_join_rows(spark, at)
    assert [tuple(r) for r in got] == [(0, 2 * n + 41)]
    assert 0 < most <= 1.1 * len(links)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (500, 500), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 400: 400, 500: 400}


# ---- 6


def test_warc_round_trip_with_magic_in_payloads(spark):
    rnd = random.Random(0)
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(i, "é".join(rnd.choice(["abc", "WARC/1.0\r\n", "\r\n\r\n", "x" * 200, fake, fake[:60]]) for _ in range(rnd.randint(0, 12)))) for i in range(150)]
    rows += [(1000 + i, rows[i][1]) for i in range(60)] + [(None, "n" * 150), (2000, None), (2001, ""), (2002, "q" * 120), (2002, "q" * 120), (2003, "s" * 50), (2004, "s" * 50)]
    first, used, want = {}, set(), []
    for p, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and p is not None:
            first[b] = min(first.get(b, p), p)
    for p, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        revisit = f is not None and (p != f or b in used)
        if p == f and f is not None:
            used.add(b)
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    pages = spark.createDataFrame([(p, "http://h/", h, 1) for p, h in rows], "page_id long, url string, html string, digest int").repartition(2)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        path = common.scratch(spark, "warc")
        warc.write_warc(pages.drop("digest"), path)
        got = [tuple(r) for r in warc.report(warc.read_warc(spark, path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_keeps_pages_with_very_long_urls(spark):
    rows = [(i, "http://h/" + "u" * (70_000 if i == 3 else 5), "page %d " % i + "x" * 200) for i in range(10)]
    path = common.scratch(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    got = {r.page_id: r.payload_digest for r in warc.report(warc.read_warc(spark, path)).collect()}
    assert got == {p: hashlib.sha256(h.encode()).hexdigest() for p, _, h in rows}


def read_back(spark, rows, **options):
    path = common.scratch(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    return {r.page_id: r for r in warc.report(warc.read_warc(spark, path, **options)).collect()}


def test_warc_urls_do_not_pass_for_headers(spark):
    urls = ["http://x/?q=Content-Length:7", "http://x/\u2028WARC-Payload-Digest: sha256:00", "a\r\nContent-Length: 3\r\n\r\n", "b\x85WARC-Type: revisit", "c d\te", None]
    got = read_back(spark, [(i, u, "page %d " % i + "y" * 300) for i, u in enumerate(urls)])
    assert {i: (r.payload_bytes, r.record_type) for i, r in got.items()} == {i: (307, "response") for i in range(len(urls))}
    assert read_back(spark, []) == {}


def test_warc_many_copies(spark):
    hot = "hot " * 50
    rows = [(i, "http://h/%d" % (i % 3), hot) for i in range(5, 300)] + [(5, "http://z/", hot)] * 3 + [(5, None, hot)] * 2 + [(None, "n", hot)] * 2 + [(400, "u", "x" * 200)] * 2
    path = common.scratch(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.report(warc.read_warc(spark, path)).collect())
    want = collections.Counter([(i, "revisit", 5, 200) for i in range(6, 300)] + [(5, "response", None, 200)] + [(5, "revisit", 5, 200)] * 5 + [(None, "revisit", 5, 200)] * 2 + [(400, "response", None, 200), (400, "revisit", 400, 200)])
    assert got == want


def test_warc_that_breaks_off_is_an_error(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_warc(spark.createDataFrame([(i, "u", "page %d " % i + "z" * 200) for i in range(20)], "page_id long, url string, html string").coalesce(1), path)
    part = next((tmp_path / "archive").glob("part-*"))
    data = part.read_bytes()
    for crc in (tmp_path / "archive").glob(".*.crc"):
        crc.unlink()
    part.write_bytes(data[:-100])
    with pytest.raises(warc.BrokenArchive):
        warc.read_warc(spark, path)
    assert sorted(r.page_id for r in warc.report(warc.read_warc(spark, path, strict=False)).collect()) == list(range(19))


# ---- 7


def test_lcs():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.randint(0, 4) for _ in range(rnd.randint(0, 20))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert decontamination.lcs_length(a, b) == row[-1]


def test_items_are_found_and_clean_texts_left_alone(spark, edge):
    rnd = random.Random(2)
    vocabulary = ["term%d" % i for i in range(2000)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [text(rnd.randint(12, 50)) for _ in range(20)]
    rows, want = [], {}
    for i in range(200):
        words = text(rnd.randint(30, 400))
        if i % 4 == 0:
            item = list(items[i // 4 % 20])
            if i % 8 == 0:  # a paraphrase: one word in eight is another
                item = [rnd.choice(vocabulary) if rnd.random() < 0.12 else w for w in item]
            at = rnd.randint(0, len(words))
            words[at:at] = item
            want[i] = i // 4 % 20
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(None, "x"), (99, None), (98, "")], "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontamination.contaminated(docs, bench).collect() if r.contaminated}
    assert got == {d: [i] for d, i in want.items()}
    assert {r.doc_id for r in decontamination.without_contaminated(docs, bench).collect()} == {d for d, _ in rows} - set(want)
    assert decontamination.contaminated(edge, bench).where("contaminated").count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0


def test_items_in_a_third_of_the_rows_are_found(spark):
    rnd = random.Random(12)
    vocabulary = ["term%d" % i for i in range(3000)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    hot, short, rows, want = text(30), text(3), [], set()
    for i in range(300):
        words = text(rnd.randint(30, 100))
        at = rnd.randint(0, len(words))
        if i % 3 == 0:
            words[at:at] = hot if i % 2 else [rnd.choice(vocabulary) if rnd.random() < 0.12 else w for w in hot]
            want.add((i, 0))
        elif i % 3 == 1:
            words[at:at] = short
            want.add((i, 1))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(hot)), (1, " ".join(short))], "item_id long, text string")
    got = {(r.doc_id, i) for r in decontamination.contaminated(docs, bench).collect() for i in r.item_ids}
    assert got == want
    assert {r.doc_id for r in decontamination.without_contaminated(docs, bench).collect()} == set(range(2, 300, 3))


def test_retrieval_finds_what_a_search_of_every_place_finds(spark):
    rnd = random.Random(21)
    vocabulary = ["term%d" % i for i in range(1500)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [text(rnd.randint(12, 40)) for _ in range(12)]
    rows = []
    for i in range(120):
        words = text(rnd.randint(20, 120))
        if i % 3:
            item, share = list(rnd.choice(items)), rnd.choice([0.1, 0.2, 0.3])
            item = [w for x in item for w in ([rnd.choice(vocabulary)] if rnd.random() < share else [x, rnd.choice(vocabulary)] if rnd.random() < 0.05 else [x])]
            at = rnd.randint(0, len(words))
            words[at:at] = item
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    idf, _ = decontamination.fit(docs)
    want = set()
    for i, item in enumerate(items):
        ids = decontamination.term_ids(decontamination.split([" ".join(item).encode()]).hashes())
        order = np.argsort(-idf[ids], kind="stable")
        telling = {item[j] for j in order[: max(1, len(item) // 3)]}
        scale = max(s for s in decontamination.SCALES if s <= len(item))
        for d, t in rows:
            words = t.split()
            for at in range(len(words)):
                around = words[max(0, at - len(item)) : at + scale + len(item)]
                if len(telling & set(around)) >= 0.5 * len(telling) and decontamination.lcs_length(item, around) >= 0.6 * len(item):
                    want.add((d, i))
                    break
    got = {(r.doc_id, i) for r in decontamination.contaminated(docs, bench).collect() for i in r.item_ids}
    assert got <= want and len(want) > 50 and len(got) / len(want) >= 0.9


# ---- 8


def test_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 16)).astype(np.float32)
    v[700:900] = v[0]  # one very common vector
    rows = [(i, [float(y) for y in x], "extra") for i, x in enumerate(v)] + [(5000, None, ""), (5050, [0.0] * 16, ""), (5100, [float("nan")] * 16, ""), (None, [1.0] * 16, ""), (5150, [], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string")
    vectors = common.materialize(hnsw.usable(df, "vec_id", "embedding"), "vectors")
    held, hnsw.SHARD_ROWS = hnsw.SHARD_ROWS, 500
    try:
        got = hnsw.search(hnsw.build(vectors, 5), vectors.where("id % 50 = 0"), 5).collect()
    finally:
        hnsw.SHARD_ROWS = held
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 1500, 50):
        c = u @ u[q]
        c[q] = -9
        want = sorted(range(1500), key=lambda j: (-round(c[j], 9), j))[:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(abs(s - c[i]) < 1e-9 for _, i, s in mine)
        hits, total = hits + len(set(want) & {i for _, i, _ in mine}), total + 5
    assert hits / total >= 0.95 and {r.query_id for r in got} == set(range(0, 1500, 50))


def test_neighbours_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in common.table(spark, sf, "embeddings").collect()]
    ids = np.array([i for i, _ in rows])
    u = np.array([v for _, v in rows], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    got = collections.defaultdict(set)
    for r in hnsw.op8_hnsw(spark, sf).collect():
        got[r.query_id].add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        c = u @ u[q]
        c[q] = -9
        want = sorted(range(len(ids)), key=lambda j: (-c[j], ids[j]))[:5]
        hits, total = hits + len(got[ids[q]] & {int(ids[j]) for j in want}), total + 5
    assert set(got) == set(ids[ids % 50 == 0].tolist()) and hits / total >= 0.9


def test_neighbours_edges(spark):
    shape = "vec_id long, embedding array<double>"
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (50, [1e300, 1e300]), (100, [1e-300, 0.0]), (150, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows, shape)
    held = hnsw.usable(vectors, "vec_id", "embedding")
    found = collections.defaultdict(list)
    for r in sorted(hnsw.search(hnsw.build(held, 5), held.where("id % 50 = 0"), 5).collect()):
        found[r.query_id].append((r["rank"], r.vec_id, round(r.score, 9)))
    # fewer candidates than asked for, ties to the smaller id; a vector of another length has none
    assert found[0] == [(1, 1, 1.0), (2, 3, 1.0), (3, 100, 1.0), (4, 50, 0.707106781), (5, 2, 0.0)]
    assert found[50] == [(1, 0, 0.707106781), (2, 1, 0.707106781), (3, 2, 0.707106781), (4, 3, 0.707106781), (5, 100, 0.707106781)] and 150 not in found
    empty = hnsw.usable(spark.createDataFrame([], shape), "vec_id", "embedding")
    assert hnsw.search(hnsw.build(empty, 5), empty, 5).count() == 0


# ---- 9


def test_scores_equal_slow_models(spark):
    rnd = random.Random(4)
    texts = [(i, " ".join(rnd.choice("abcdefgh" if i % 2 else "efghijkl") for _ in range(rnd.randint(0, 30)))) for i in range(60)] + [(None, "a b"), (70, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = lm_scoring.score(docs, docs.where("doc_id % 2 = 1").select("doc_id")).collect()
    size = lm_scoring.VOCABULARY

    def model(rows):
        pairs, first, second = collections.Counter(), collections.Counter(), collections.Counter()
        for t in rows:
            w = ["<s>", *(t or "").split()]
            for a, b in zip(w, w[1:]):
                pairs[a, b] += 1
                first[a] += 1
                second[b] += 1
        n = sum(second.values())

        def loss(a, b):
            uni = (second[b] + 0.5) / (n + 0.5 * size)
            k = lm_scoring.WEIGHT * first[a] / (first[a] + 1) if first[a] else 0
            return -np.log(k * (pairs[a, b] / first[a] if first[a] else 0) + (1 - k) * uni)

        return loss

    goal, ground = model([t for d, t in texts if d is not None and d % 2 == 1]), model([t for _, t in texts])
    want = []
    for d, t in texts:
        w = ["<s>", *(t or "").split()]
        diff = [goal(a, b) - ground(a, b) for a, b in zip(w, w[1:])]
        want.append((d, len(diff), round(float(np.mean(diff)), 4) if diff else None))
    assert sorted(((r.doc_id, r.n_tokens, None if r.score is None else round(r.score, 4)) for r in got), key=str) == sorted(want, key=str)


def test_rare_words_have_their_own_counts(spark):
    # 3,000 words, more than a fixed vocabulary of 2,048; the rarest are what the target differs by
    filler = [(i, " ".join("common%d" % (j % 2500) for j in range(50 * i, 50 * i + 50))) for i in range(200)]
    docs = spark.createDataFrame(filler + [(1000 + i, "rare%d topic%d" % (i % 250, i % 250)) for i in range(500)] + [(2000, "")], "doc_id long, text string")
    held, lm_scoring.BATCH_BYTES, lm_scoring.BUCKET_BYTES = (getattr(lm_scoring, "BATCH_BYTES", 0), getattr(lm_scoring, "BUCKET_BYTES", 0)), 3_000, 20_000
    try:
        got = {r.doc_id: r for r in lm_scoring.score(docs, docs.where("doc_id >= 1000 and doc_id % 250 < 125")).collect()}
    finally:
        lm_scoring.BATCH_BYTES, lm_scoring.BUCKET_BYTES = held
    assert len(got) == 701 and got[2000].score is None and got[2000].n_tokens == 0
    inside, outside = got[1000], got[1200]  # alike but for their words; only the first kind is in the target
    assert inside.score < -0.5 and outside.score > 0.5

    size, k = 3_001, lm_scoring.WEIGHT

    def loss(n, second, first, pair):
        w = k * first / (first + 1)
        return -np.log((w * pair / first if first else 0) + (1 - w) * (second + 0.5) / (n + 0.5 * size))

    # of 11,000 words: 2 of each rare word, 2 bigrams; 700 documents have a first word
    want = (loss(11_000, 2, 700, 2) + loss(11_000, 2, 2, 2)) / 2
    assert abs(inside.background_loss - want) < 1e-9 and abs(outside.background_loss - want) < 1e-9


def test_scores_of_edges(spark, edge):
    none = spark.createDataFrame([], "doc_id long")
    named = edge.withColumnRenamed("n_words", "score").withColumn("s", F.lit(1)).withColumn("data", F.lit("x"))
    got = sorted(((r.doc_id, r.n_tokens, r.score is None) for r in lm_scoring.score(named, spark.createDataFrame([(3,), (3,), (None,)], "doc_id long")).collect()), key=str)
    assert got == sorted([(d, len((t or "").split()), not (t or "").split()) for d, t, _ in EDGE], key=str)
    assert lm_scoring.score(edge, none).count() == len(EDGE)  # the target is the uniform model
    assert lm_scoring.score(edge.limit(0), none).count() == 0


# ---- 10


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBPE(byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def test_encoding_equals_the_library(bpe):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rnd = random.Random(1)
    alphabet = "ab \n\t'sé漢😀１²Ⅷ\x1c\x85\xa0  .,!0129tre"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)] + ["a" * 5000, " " * 4000, "aaaab" * 2000, "", "don't  'll"]
    for t in texts:
        ids = library.encode_ordinary(t)
        assert bpe.encode(t) == ids and bpe.decode(ids) == t.encode()
        assert bpe.digest(t) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_encoding_of_new_words(bpe, monkeypatch):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rnd = random.Random(2)
    words = ["".join(rnd.choice("the an er ou qu é èa st in ng Sh'd , 漢".split(" ")) for _ in range(rnd.randint(1, 9))) for _ in range(1500)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 80))) + "\n" for _ in range(60)] + ["".join(words), "ab\0c\0 \0", "-" * 700 + " " + "=" * 3000]
    wanted = [library.encode_ordinary(t) for t in texts]
    fresh = byte_bpe.ByteBPE(bpe.ranks, public_tokenizers.PATTERN)
    merged = []
    monkeypatch.setattr(fresh, "merge", lambda data: merged.append(data) or bpe.merge(data))
    assert [fresh.encode(t) for t in texts] == wanted
    assert not merged  # neighbours are judged by what is known of each, not by merging both anew
    for held in (None, 40):
        if held:  # everything is dropped and made anew all the time, texts go in many parts
            for name in ("HELD_PAIRS", "HELD_UNITS", "HELD_IDS", "PART_UNITS"):
                monkeypatch.setattr(byte_bpe, name, held)
        for t, ids in zip(texts, wanted):
            kept = []
            assert fresh.digest(t, kept) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
            assert [int(i) for part in kept for i in part] == ids


def test_encoding_by_any_ranks():
    import weakref

    rnd = random.Random(3)
    for _ in range(60):
        tokens = {"".join(rnd.choices("abc", k=rnd.randint(2, 5))).encode() for _ in range(rnd.randint(1, 25))}
        ranks = {t: i for i, t in enumerate([b"a", b"b", b"c", *rnd.sample(sorted(tokens), len(tokens))])}
        own = byte_bpe.ByteBPE(ranks, public_tokenizers.PATTERN)
        for _ in range(100):
            data = "".join(rnd.choices("abc", k=rnd.randint(1, 40))).encode()
            assert own.encode_bytes(data) == ([ranks[data]] if data in ranks else own.merge(data))
        pairs = [(a, b) for a in own.tokens for b in own.tokens]
        assert [own.compatible(*p) for p in pairs] == [own.merge(own.tokens[a] + own.tokens[b]) == [a, b] for a, b in pairs]
    seen = weakref.ref(own)
    own.digest("abca")
    del own
    assert seen() is None


def test_encoding_of_documents(spark, edge, bpe):
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = byte_bpe.digest_documents(edge, *args).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in rows) == sorted((d or -1, len(bpe.encode(t or ""))) for d, t, _ in EDGE)
    assert all(r.decoded.decode() == (r.text or "") for r in byte_bpe.decode_ids(byte_bpe.encode_documents(edge, *args), *args).collect())
    assert byte_bpe.digest_documents(edge.limit(0), *args).count() == 0


def test_ids_of_documents(spark, edge, bpe):
    docs = edge.withColumn("lang", F.lit("en")).withColumn("source", F.col("text"))
    rows = byte_bpe.tokenize_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        assert r.ids == bpe.encode(r.source or "") and (r.n_tokens, r.ids_sha256, r.decoded_sha256) == bpe.digest(r.source or "")

"""Removal of word passages that an earlier document already has, by a log-structured index.

The index holds what past batches contained, as sorted immutable runs:

* anchor runs: each window of WINDOW words is represented by the smallest hash
  among its shingles of SHINGLE words, its anchor.  Equal windows have equal
  anchors, and neighbouring windows mostly share theirs, so a document has about
  one anchor for 18 windows.  A run has one row for each anchor: the smallest and
  largest content key that holds it and the first document with it;
* window runs: 128-bit hashes of the words of whole windows, each with its first owner,
  for the windows under anchors that more than one text holds;
* content runs: the first document of each word sequence, under its SHA-256.

A new batch is merge-joined with the runs on the anchor.  Anchors held by one text
only end there.  For the others, windows are verified by the hash of their very words,
of the batch's texts and of the one past text that had the anchor alone until
now.  Then the batch's runs are written; before the next batch, when there are more than
``fanout`` runs of a kind, they are merged into one (compaction).  Documents whose whole word
sequence was seen before are decided by the content runs and verified no further.
`FingerprintIndex.save` writes which runs there are, so that a later session can go on.

A window belongs to the document with the smallest (batch, doc_id); batches in the
order of doc_id therefore give what one batch over everything gives.

Defined cases: a null text has no words; a document with fewer than WINDOW words
loses nothing; a row with a null doc_id is returned whole and is never an owner;
rows with the same doc_id never take words from each other; repeated rows give
one result row each; an empty table gives no rows; columns besides doc_id and text
are ignored (removals) or carried through (`without_repeats`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, flat

WINDOW, SHINGLE = 50, 16
#: Batches of the query and of the stage, and runs of a kind above which they are compacted.
BATCHES, FANOUT = 3, 1

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


# ---- hashes of one document


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _K[0]) ^ (b + (a >> np.uint64(31)))
    x *= _K[1]
    x ^= x >> np.uint64(29)
    x *= _K[2]
    x ^= x >> np.uint64(32)
    return x


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive entries: runs of powers of two are doubled, then joined."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, width = None, 0, h, 1
    rest = size
    while rest:
        if rest & 1:
            out = power if out is None else _mix(power[: len(h) - done - width + 1], out[width:][: len(h) - done - width + 1])
            done += width
        rest >>= 1
        if rest:
            power = _mix(power[:-width], power[width:])
            width *= 2
    return out[:n]


def anchors(h: np.ndarray) -> np.ndarray:
    """The anchor of every window, by the place where the window starts."""
    m = gram_hashes(h, SHINGLE)
    if len(h) < WINDOW:
        return m[:0]
    span, width = WINDOW - SHINGLE + 1, 1
    while width * 2 <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(m) - (span - width)], m[span - width :])


def spaced(text: bytes, words: flat.Words, i: int) -> bytes:
    """The words of text ``i`` joined by single spaces."""
    a, b = int(words.first[i]), int(words.first[i + 1])
    if a == b:
        return b""
    starts, ends = words.starts[a:b], words.ends[a:b]
    if ends[-1] - starts[0] == len(text) and text.count(b" ") == b - a - 1 and (starts[1:] == ends[:-1] + 1).all():
        return text
    return b" ".join(text.split())


def content(text: Column) -> Column:
    """A number for the word sequence of a text: of the SHA-256 of its words joined by spaces."""
    return F.xxhash64(F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, sha256, anchors, content) of every row."""
    common.arrow_rows(docs.sparkSession)

    @common.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words = flat.Words(texts)
            h, first = words.hashes(), words.first.tolist()
            sha = [hashlib.sha256(spaced(text, words, i)).hexdigest() for i, text in enumerate(texts)]
            found = [np.unique(anchors(h[a:b])).view(np.int64) if b - a >= WINDOW else np.empty(0, np.int64) for a, b in zip(first, first[1:])]
            offsets = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
            values = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words.counts, pa.int64()), pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(offsets), values)],
                ["doc_id", "n_words", "sha256", "anchors"],
            )

    signed = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_words long, sha256 string, anchors array<long>")
    return signed.withColumn("content", F.xxhash64("sha256"))


def windows(texts: DataFrame, every: bool) -> DataFrame:
    """(h1, h2, doc_id, content, at): the windows under the given anchors of (doc_id, content, text, anchors).

    h1 and h2 are the XXH3-128 of the window's words joined by spaces.  With ``every`` a
    row per place, else a row per different window of a document.
    """

    @common.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, keys, texts, wanted = (c.to_pylist() for c in batch.columns)
            texts = [b" ".join(t.split()) for t in texts]
            words = flat.Words(texts)
            h, first = words.hashes(), words.first.tolist()
            view, starts, ends = memoryview(words.data), words.starts, words.ends
            sizes, places, hashed = [], [], []
            for a, b, held in zip(first, first[1:], wanted):
                at = np.flatnonzero(np.isin(anchors(h[a:b]), np.array(held, np.int64).view(np.uint64)))
                found = np.frombuffer(b"".join([digest(view[x:y]) for x, y in zip(starts[a + at].tolist(), ends[a + at + WINDOW - 1].tolist())]), np.int64).reshape(-1, 2)
                if not every and len(at):
                    _, once = np.unique(found, axis=0, return_index=True)
                    at, found = at[once], found[once]
                sizes.append(len(at))
                places.append(at)
                hashed.append(found)
            if sizes:
                h1, h2 = (np.ascontiguousarray(c) for c in np.concatenate(hashed).T)
                columns = h1, h2, np.repeat(np.array(ids, np.int64), sizes), np.repeat(np.array(keys, np.int64), sizes), np.concatenate(places).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h1", "h2", "doc_id", "content", "at"])

    return texts.select("doc_id", "content", F.col("text").cast("binary").alias("text"), "anchors").mapInArrow(run, "h1 long, h2 long, doc_id long, content long, at int")


def holders(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, content, ...) with the text; only texts that may be wanted are shuffled.

    The shuffle parts the filter's Python workers from those of what follows.
    """
    asked = common.member(wanted, "doc_id")
    some = source.where(asked(F.col("doc_id"))).withColumn("content", content(F.col("text")))
    return some.join(wanted.hint("merge"), ["doc_id", "content"])


def kept_words(words: list[bytes], starts: list[int]) -> list[bytes]:
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.array(starts, np.int64), 1)
    np.add.at(edge, np.array(starts, np.int64) + WINDOW, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


# ---- the index


class FingerprintIndex:
    """The runs, and the batches taken in so far."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark = spark
        self.fanout = fanout
        self.batches = self.compactions = 0
        self.runs: dict[str, list[DataFrame]] = {"anchor": [], "window": [], "content": []}
        self.sources: list[DataFrame] = []  # where the texts of past batches are

    # an owner is the first document: the smallest (batch, doc_id)
    _merge = {
        "anchor": (["anchor"], ["min(low) as low", "max(high) as high", "min(owner) as owner"]),
        "window": (["h1", "h2"], ["min(owner) as owner"]),
        "content": (["sha256"], ["min(owner) as owner"]),
    }

    def save(self, path: str) -> None:
        """Write which runs there are; the runs themselves stay where they are, with the shared folder."""
        rows = [(self.batches, kind, t._scratch_path) for kind, tables in self.runs.items() for t in tables]
        self.spark.createDataFrame(rows, "batches int, kind string, path string").coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, sources: list[DataFrame], fanout: int = FANOUT) -> "FingerprintIndex":
        """The index that was saved; ``sources``: the documents of its batches, in order."""
        out = cls(spark, fanout)
        for r in sorted(spark.read.json(path).collect()):
            table = spark.read.parquet(r.path)
            table._scratch_path = r.path
            out.runs[r.kind].append(table)
            out.batches = r.batches
        out.sources = [_source(docs) for docs in sources]
        return out

    def merged(self, kind: str, *more: DataFrame) -> DataFrame | None:
        tables = [*self.runs[kind], *more]
        if not tables:
            return None
        keys, aggregates = self._merge[kind]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out if len(tables) == 1 else out.groupBy(*keys).agg(*map(F.expr, aggregates))

    def append(self, kind: str, run: DataFrame) -> None:
        """Write a run in key order."""
        keys, _ = self._merge[kind]
        self.runs[kind].append(common.materialize(run.sortWithinPartitions(*keys), f"{kind}-run"))

    def compact(self) -> None:
        """Merge the runs of each kind of which there are too many."""
        for kind, old in self.runs.items():
            if len(old) > self.fanout:
                self.compactions += 1
                merged, self.runs[kind] = self.merged(kind), []
                self.append(kind, merged)
                common.discard(self.spark, *old)

    def add(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Take in a batch.  Returns its signatures and (doc_id, content, starts): the windows to remove.

        A document whose word sequence has an earlier owner has ``starts`` null.
        """
        self.compact()
        batch = self.batches
        self.batches += 1
        source = _source(docs)
        signed = common.materialize(signatures(source), "signatures")
        named = signed.where(f"doc_id is not null and n_words >= {WINDOW}")
        owner = F.struct(F.lit(batch).alias("batch"), F.col("doc_id")).alias("owner")

        # whole word sequences: all but their first document are decided
        contents = common.materialize(named.groupBy("sha256").agg(F.min("doc_id").alias("doc_id")).select("sha256", owner), "contents")
        first = self.merged("content", contents)
        earlier = (F.col("owner.batch") < batch) | (F.col("owner.doc_id") < F.col("doc_id"))
        known = named.select("doc_id", "content", "sha256").distinct().join(first, "sha256")
        known = common.materialize(known.select("doc_id", "content", earlier.alias("copy")), "known")
        copies = known.where("copy").select("doc_id", "content", F.lit(None).cast("array<int>").alias("starts"))
        mine = known.where("not copy").select("doc_id", "content")

        # merge-join of the anchors: those that more than one text holds
        held = named.select("doc_id", "content", F.explode("anchors").alias("anchor"))
        fresh = held.groupBy("anchor").agg(F.min("content").alias("low"), F.max("content").alias("high"), F.min("doc_id").alias("doc_id"))
        fresh = common.materialize(fresh.select("anchor", "low", "high", owner), "fresh")
        past = self.merged("anchor")
        if past is None:
            shared = fresh.where("low <> high").select("anchor")
            newly = None
        else:
            p = past.select("anchor", F.col("low").alias("p_low"), F.col("high").alias("p_high"), F.col("owner").alias("p_owner"))
            met = fresh.join(p, "anchor", "left")
            both = common.materialize(
                met.where(F.least("low", "p_low") != F.greatest("high", "p_high")).select("anchor", "p_low", "p_high", "p_owner"), "shared"
            )
            shared = both.select("anchor")
            # one past text had the anchor alone: its windows are not in the window runs yet
            newly = both.where("p_low = p_high").select(F.col("p_owner.batch").alias("batch"), F.col("p_owner.doc_id").alias("doc_id"), F.col("p_low").alias("content"), "anchor")

        # windows under shared anchors, of the first document of each word sequence
        wanted = (
            held.join(shared, "anchor").groupBy("doc_id", "content").agg(F.collect_list("anchor").alias("anchors"))
            .join(mine, ["doc_id", "content"])
        )
        wanted = common.materialize(wanted, "wanted")
        texts = common.materialize(holders(source, wanted).select("doc_id", "content", "text", "anchors"), "candidates")
        found = windows(texts, every=True)
        new_windows = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).select("h1", "h2", owner)
        lists = None
        if newly is not None:
            lists = common.materialize(newly.groupBy("batch", "doc_id", "content").agg(F.collect_list("anchor").alias("anchors")), "newly")
            for b, past_source in enumerate(self.sources):
                had = windows(holders(past_source, lists.where(F.col("batch") == b).drop("batch")), every=False)
                new_windows = new_windows.unionByName(had.select("h1", "h2", F.struct(F.lit(b).alias("batch"), F.col("doc_id")).alias("owner")))
        new_windows = common.materialize(new_windows.groupBy("h1", "h2").agg(F.min("owner").alias("owner")), "windows")
        # a written table, so that a very common window is split where it is joined
        owned = common.materialize(self.merged("window", new_windows), "owned") if self.runs["window"] else new_windows
        repeated = found.join(owned, ["h1", "h2"]).where(earlier).groupBy("doc_id", "content").agg(F.sort_array(F.collect_set("at")).alias("starts"))
        decided = common.materialize(repeated.unionByName(copies), "decided")

        self.append("anchor", fresh)
        self.append("window", new_windows)
        self.append("content", contents)
        self.sources.append(source)
        common.discard(self.spark, contents, known, fresh, wanted, texts, new_windows, owned, *([both, lists] if lists is not None else []))
        return signed, decided


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def in_batches(docs: DataFrame, batches: int) -> list[DataFrame]:
    """Batches by ranges of doc_id; rows without a doc_id come last."""
    if batches < 2:
        return [docs]
    edges = docs.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10_000).alias("e")).first().e or []
    edges = sorted(set(edges))
    out, low = [], None
    for edge in edges:
        out.append(docs.where(F.col("doc_id") <= edge) if low is None else docs.where((F.col("doc_id") > low) & (F.col("doc_id") <= edge)))
        low = edge
    out.append(docs if low is None else docs.where((F.col("doc_id") > low) | F.col("doc_id").isNull()))
    return out


def deduplicate(docs: DataFrame, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """Take ``docs`` in batch by batch: all signatures, and all (doc_id, content, starts)."""
    index = FingerprintIndex(docs.sparkSession)
    signed, decided = zip(*(index.add(part) for part in in_batches(docs, batches)))
    for kind in index.runs.values():
        common.discard(docs.sparkSession, *kind)

    def union(tables):
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    return union(signed), union(decided)


def removals(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs``."""
    signed, decided = deduplicate(docs, batches)

    @common.tidied
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            removed, kept = [], []
            for text, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.split()
                left = kept_words(words, starts)
                removed.append(len(words) - len(left))
                kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "content", "n_removed", "kept"])

    changed = holders(_source(docs), decided.where("starts is not null")).select("doc_id", "content", F.col("text").cast("binary").alias("text"), "starts")
    changed = changed.mapInArrow(run, "doc_id long, content long, n_removed long, kept string").distinct()
    whole = decided.where("starts is null").select("doc_id", "content", F.lit(-1).cast("long").alias("n_removed"), F.lit(hashlib.sha256().hexdigest()).alias("kept"))
    return (
        signed.drop("anchors").join(changed.unionByName(whole), ["doc_id", "content"], "left")
        .select(
            "doc_id",
            "n_words",
            F.when(F.col("n_removed") < 0, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.coalesce("kept", "sha256").alias("kept_sha256"),
        )
    )


def without_repeats(docs: DataFrame, batches: int = BATCHES, text: str = "text") -> DataFrame:
    """``docs`` with the removed words taken out of the texts; other texts stay as they are."""
    _, decided = deduplicate(docs, batches)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series(["" if s is None else b" ".join(kept_words(t.encode().split(), list(s))).decode() for t, s in zip(texts, starts)], dtype=object)

    # only the texts that may change are shuffled; x and y part columns of the same name
    asked = common.member(decided, "doc_id")
    old = F.coalesce(F.col(f"x.{text}").cast("string"), F.lit(""))
    some = docs.where(asked(F.col("doc_id").cast("long"))).alias("x")
    same = (F.col("x.doc_id").cast("long") == F.col("y.doc_id")) & (content(old) == F.col("y.content"))
    joined = some.join(decided.hint("merge").alias("y"), same, "left")
    new = F.when(F.col("y.content").isNotNull(), cut(old, F.col("y.starts"))).otherwise(F.col(f"x.{text}"))
    changed = joined.select(*[new.alias(c) if c == text else F.col(f"x.`{c}`") for c in docs.columns])
    return docs.where(~asked(F.col("doc_id").cast("long"))).unionByName(changed)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.finished(spark, lambda: removals(common.table(spark, sf_dir, "documents")))


#: The same in SQL: windows are told apart by their words.
ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT r, doc_id, ws, unnest(range(1, len(ws) - {WINDOW} + 2)) AS i FROM t WHERE len(ws) >= {WINDOW} AND doc_id IS NOT NULL),
win AS (SELECT r, doc_id, i, array_to_string(list_slice(ws, i, i + {WINDOW} - 1), ' ') AS w FROM starts),
owned AS (SELECT r, i, min(doc_id) OVER (PARTITION BY w) < doc_id AS gone FROM win),
hit AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM owned WHERE gone),
word AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t),
kept AS (SELECT word.r, string_agg(w, ' ' ORDER BY word.i) AS words, count(*) AS n FROM word ANTI JOIN hit ON word.r = hit.r AND word.i = hit.i GROUP BY word.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM t LEFT JOIN kept ON t.r = kept.r
"""

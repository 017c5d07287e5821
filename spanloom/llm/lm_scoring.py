"""Cross-entropy difference of matched target and background bigram models.

Both models have one vocabulary, one form and one smoothing, so that the difference
of their losses comes from the texts they were counted on.  The vocabulary is every
word of the documents; a model is an interpolated bigram model with add-half
unigrams over as many entries as there are words, `VOCABULARY` at least.  The
background counts cover all documents, the target counts all documents that are
labelled good; nothing is sampled, capped or left out.

A document's score is the mean over its words of target loss minus background loss (natural
logarithm): the lower, the more like the target.

The models are tables in the cluster that grow with the input:

1. Documents are packed in batches of about `BATCH_BYTES` of text, written to the
   shared folder.  The labels meet the batches as one bit for each document.
2. Every batch counts its words, its last words and its bigrams, over all and over the
   good documents, each under a 63-bit hash and its kind, and sends the sorted keys
   with their counts to the buckets that part the range of hashes.  A key comes once
   from a batch, so a hot one is no more than a row of each batch.
3. A bucket adds the counts of its keys up and answers every batch with the sums,
   in the order in which the batch asked.
4. The batches' texts meet their answers and are scored.

Sorted keys travel as differences and counts as planes of bytes, compressed.  A batch
has a row for each bucket that it asks, so rows grow with batches times buckets
until a row holds few keys (about 100 TB of text), and with the keys from there on.

The driver gets the sums of four numbers.

Defined cases: a null text or one without words has n_tokens 0 and null scores; a
null doc_id is scored, never labelled; repeated labels count once; with no labelled document the
target is the smoothed uniform model; repeated rows are scored one by one; extra
columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, flat

VOCABULARY, WEIGHT = 2_048, 0.7
#: Text of one batch, and text for which there is one bucket of keys.
BATCH_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: Kinds of keys, the lowest bit: a word, a bigram.  START is the word before the first one.
WORD, PAIR = 0, 1
START = np.uint64(0xFEDCBA9876543210)
LEVEL = 3


# ---- numbers on the way


def pack(x: np.ndarray) -> bytes:
    """Numbers of 0 or more as planes of bytes, compressed."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences: five low bytes as they are, as nothing compresses them, the rest compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return steps[:, :5].tobytes() + zstandard.compress(np.ascontiguousarray(steps[:, 5:].T).tobytes(), 1)


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    steps = np.empty((n, 8), np.uint8)
    steps[:, :5] = np.frombuffer(data, np.uint8, 5 * n).reshape(n, 5)
    steps[:, 5:] = np.frombuffer(zstandard.decompress(data[5 * n :]), np.uint8).reshape(3, n).T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


# ---- the keys of a batch


class Counted:
    """The distinct keys of a batch of texts, sorted, and what its words say of them."""

    def __init__(self, texts: list[bytes]):
        words = flat.Words([t.translate(flat.LOWER) for t in texts])
        self.sizes = words.counts
        h = words.hashes()
        n = len(h)
        starts = words.first[:-1][self.sizes > 0]
        last = np.zeros(n, bool)
        last[(words.first[1:] - 1)[self.sizes > 0]] = True
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[starts] = START
        pair = flat.mixed((before * np.uint64(0x9E3779B97F4A7C15) ^ (before >> np.uint64(29))) + h) | np.uint64(PAIR)
        del before
        one, word = np.unique(np.append(h & ~np.uint64(1), START), return_inverse=True)
        two, pair = np.unique(pair, return_inverse=True)
        keys = np.concatenate([one, two])
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.keys = keys[order]
        #: Places of each word's key, of the key of the word before and of the bigram's key.
        self.second, start, self.pair = place[word[:n]], place[word[n]], place[len(one) + pair]
        self.first = np.empty_like(self.second)
        self.first[1:] = self.second[:-1]
        self.first[starts] = start
        self._start, self._last = start, last

    def counts(self, of: np.ndarray) -> np.ndarray:
        """(2, keys): how often each key occurs, and how often as a last word, in the texts that ``of`` marks."""
        mark = np.repeat(of, self.sizes)
        n = np.bincount(self.second[mark], minlength=len(self.keys)) + np.bincount(self.pair[mark], minlength=len(self.keys))
        n[self._start] = (of & (self.sizes > 0)).sum()
        return np.array([n, np.bincount(self.second[mark & self._last], minlength=len(self.keys))])

    def cuts(self, buckets: int) -> list[tuple[int, int, int]]:
        """(bucket, from, to) for the buckets that have keys: each bucket has a range of hashes."""
        where = ((self.keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        edges = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1, [len(where)]])
        return [(int(where[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]


# ---- batches, questions and answers


def packed(docs: DataFrame) -> DataFrame:
    """(s, ids, bytes, data): batches of the documents, data their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, nth = TaskContext.get().partitionId() << 32, 0
        ids, texts, size = [], [], 0

        def batch():
            data = zstandard.compress(pickle.dumps(texts), LEVEL)
            return pa.RecordBatch.from_arrays([pa.array([base + nth], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["s", "ids", "bytes", "data"])

        for rows in batches:
            for i, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t) + 16
                if size >= BATCH_BYTES:
                    yield batch()
                    ids, texts, size, nth = [], [], 0, nth + 1
        if ids:
            yield batch()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8("text").alias("text"))
    return narrow.mapInArrow(run, "s long, ids array<long>, bytes long, data binary")


def texts_of(data: bytes) -> list[bytes]:
    return pickle.loads(zstandard.decompress(data))


def flags(batches: DataFrame, good: DataFrame) -> DataFrame:
    """(s, good): a bit for each document of the batches that have a good one."""
    placed = batches.select("s", F.posexplode("ids").alias("i", "doc_id"))
    bits = (
        placed.join(good.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id")
        .groupBy("s", F.expr("bitmap_bucket_number(cast(i + 1 as long))").alias("part"))
        .agg(F.bitmap_construct_agg(F.expr("bitmap_bit_position(cast(i + 1 as long))")).alias("bits"))
    )
    return bits.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("part", "bits"))).alias("good"))


def _marks(parts, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for part in parts if parts is not None else ():
        low = (part["part"] - 1) * 32_768
        bits = np.unpackbits(np.frombuffer(bytes(part["bits"]), np.uint8), bitorder="little")[: max(0, n - low)]
        out[low : low + len(bits)] = bits
    return out


def ask(batches: DataFrame, buckets: int) -> DataFrame:
    """(bucket, s, size, keys, counts): what every batch (s, data, good) asks of every bucket, and adds to it."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for s, data, good in zip(*(part.column(c) for c in ("s", "data", "good"))):
                texts = texts_of(data.as_py())
                n = len(texts)
                found = Counted(texts)
                del texts
                counts = np.concatenate([found.counts(np.ones(n, bool)), found.counts(_marks(good.as_py(), n))])
                cuts = found.cuts(buckets)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b for b, _, _ in cuts], pa.int32()), pa.array([s.as_py()] * len(cuts), pa.int64()), pa.array([y - x for _, x, y in cuts], pa.int64()),
                        pa.array([pack_keys(found.keys[x:y]) for _, x, y in cuts], pa.binary()), pa.array([pack(counts[:, x:y].ravel()) for _, x, y in cuts], pa.binary()),
                    ],
                    ["bucket", "s", "size", "keys", "counts"],
                )

    return batches.select("s", "data", "good").mapInArrow(run, "bucket int, s long, size long, keys binary, counts binary")


def answer(asked: DataFrame) -> DataFrame:
    """(s, bucket, data, words, background, target): the sums, in the order asked; for s = -1 the bucket's totals."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("s")
        sizes = group["size"].tolist()
        distinct, inverse = np.unique(np.concatenate([unpack_keys(k, n) for k, n in zip(group["keys"], sizes)]), return_inverse=True)
        sums, at = np.zeros((4, len(distinct)), np.int64), 0
        for n, counts in zip(sizes, group["counts"]):
            sums[:, inverse[at : at + n]] += unpack(counts).astype(np.int64).reshape(4, n)  # a batch has a key once
            at += n
        word = ((distinct & np.uint64(1)) == WORD) & (distinct != START)
        bucket = int(group["bucket"].iloc[0])
        out, at = [(-1, bucket, b"", int(word.sum()), int(sums[0, word].sum()), int(sums[2, word].sum()))], 0
        for s, n in zip(group["s"].tolist(), sizes):
            out.append((s, bucket, pack(sums[:, inverse[at : at + n]].ravel()), 0, 0, 0))
            at += n
        return pd.DataFrame(out, columns=["s", "bucket", "data", "words", "background", "target"])

    return asked.groupBy("bucket").applyInPandas(run, "s long, bucket int, data binary, words long, background long, target long")


def losses(found: Counted, n: np.ndarray, last: np.ndarray, total: int, size: int) -> np.ndarray:
    """Negative log-probability of every word under the interpolated model of these counts."""
    second, pair = n[found.second].astype(np.float64), n[found.pair].astype(np.float64)
    first = (n - last)[found.first].astype(np.float64)  # of a word that another follows
    unigram = (second + 0.5) / (total + 0.5 * size)
    weight = WEIGHT * first / (first + 1.0)
    return -np.log(weight * pair / np.maximum(first, 1.0) + (1.0 - weight) * unigram)


def score(docs: DataFrame, good: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row of ``docs``; ``good`` has the doc_ids of the target."""
    spark = docs.sparkSession
    common.arrow_rows(spark)
    batches = common.materialize(packed(docs), "batches")
    buckets = int(batches.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES + 1
    marked = batches.select("s", "data").join(common.materialize(flags(batches, good), "flags"), "s", "left")
    answers = common.materialize(answer(ask(marked, buckets)), "answers")
    totals = answers.where("s = -1").agg(F.sum("words"), F.sum("background"), F.sum("target")).first()
    words, n_background, n_target = (int(x or 0) for x in totals)
    size = max(VOCABULARY, words + 1)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = (group["bucket"] < 0).to_numpy()
        row = group[own].iloc[0]
        found = Counted(texts_of(row["data"]))
        sums = [unpack(x).reshape(4, -1) for x in group[~own].sort_values("bucket")["data"]]
        sums = np.concatenate(sums, axis=1).astype(np.int64) if sums else np.zeros((4, 0), np.int64)
        documents, some = np.repeat(np.arange(len(found.sizes)), found.sizes), found.sizes > 0
        b, t = (
            np.bincount(documents, weights=losses(found, sums[i], sums[i + 1], n, size), minlength=len(some)) / np.maximum(found.sizes, 1)
            for i, n in ((0, n_background), (2, n_target))
        )
        columns = {name: pd.Series(np.where(some, x, 0.0)).astype("Float64").where(some) for name, x in (("target_loss", t), ("background_loss", b), ("score", t - b))}
        ids = pd.array([None if pd.isna(i) else int(i) for i in row["ids"]], "Int64")
        return pd.DataFrame({"doc_id": ids, "n_tokens": found.sizes, **columns})

    rows = batches.select("s", F.lit(-1).alias("bucket"), "ids", "data").unionByName(answers.where("s >= 0").select("s", "bucket", F.lit(None).cast("array<long>").alias("ids"), "data"))
    return rows.groupBy("s").applyInPandas(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run() -> DataFrame:
        good = common.table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
        scored = score(common.table(spark, sf_dir, "documents"), good)
        return scored.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])

    return common.finished(spark, run)


#: The same in SQL.
ORACLE = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') AS ws FROM documents),
split AS (SELECT r, doc_id, list_filter(ws, lambda x: x <> '') AS ws FROM texts),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
flat AS (SELECT r, s.doc_id, g.doc_id IS NOT NULL AS good, unnest(ws) AS b, generate_subscripts(ws, 1) AS i FROM split s LEFT JOIN good g ON s.doc_id = g.doc_id),
tokens AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY i), '') AS a FROM flat),
second AS (SELECT b, count(*) AS n, count(*) FILTER (good) AS t FROM tokens GROUP BY b),
first AS (SELECT a, count(*) AS n, count(*) FILTER (good) AS t FROM tokens GROUP BY a),
pair AS (SELECT a, b, count(*) AS n, count(*) FILTER (good) AS t FROM tokens GROUP BY a, b),
totals AS (SELECT greatest({VOCABULARY}, count(*) + 1) AS size, sum(n) AS n, sum(t) AS t FROM second),
loss AS (SELECT k.r,
  -ln({WEIGHT} * f.n / (f.n + 1.0) * p.n / greatest(f.n, 1) + (1 - {WEIGHT} * f.n / (f.n + 1.0)) * (s.n + 0.5) / (z.n + 0.5 * z.size)) AS ground,
  -ln({WEIGHT} * f.t / (f.t + 1.0) * p.t / greatest(f.t, 1) + (1 - {WEIGHT} * f.t / (f.t + 1.0)) * (s.t + 0.5) / (z.t + 0.5 * z.size)) AS goal
  FROM tokens k JOIN second s ON k.b = s.b JOIN first f ON k.a = f.a JOIN pair p ON k.a = p.a AND k.b = p.b CROSS JOIN totals z),
means AS (SELECT r, avg(goal) AS goal, avg(ground) AS ground FROM loss GROUP BY r)
SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, round(goal, 6) AS target_loss, round(ground, 6) AS background_loss, round(goal - ground, 6) AS score
FROM split s LEFT JOIN means m ON s.r = m.r
"""

"""Benchmark decontamination by latent semantic retrieval.

1. TF-IDF over passages: documents are cut in passages of `PASSAGE` words, words are
   hashed to `TERMS` features; document frequencies are counted over all passages.
2. Randomised SVD: every passage is added with a random sign to one of `SKETCH` rows
   (a sparse random projection of the passage side).  The sketch is summed over all
   tasks; the SVD of its SKETCH x TERMS matrix gives the right singular vectors,
   `LATENT` of which fold words into the latent space.  The inverse frequencies scale
   the columns, so one pass over the documents gives both counts and sketch.
3. Candidate search: every document is swept by half-overlapping windows no longer
   than the items; windows with a cosine to an item of at least ``cosine`` in latent
   space are candidates.  So are, whatever the weights, the places that share
   `GRAM` successive words with an item: an item that stands in many passages
   makes its own words common, and they lose their weight.
4. Verification: the longest common subsequence of the item's words with the words
   around the window must cover ``least`` of the item; and the answer check: of the
   item's most telling third of words (highest IDF; they stand for the answer) the share
   ``answer`` must occur there.  That admits paraphrases and turns down texts that only share
   phrases with an item.

The model's size is fixed by TERMS, SKETCH and LATENT; a task's share of it is summed in
two steps, so that no group holds a row of every task.  The benchmark is gathered
on the driver and broadcast with the model: its items are a query set; one with more
than `MAX_ITEMS` items is taken in blocks of that many.

Defined cases: a null text has no words; a null doc_id is carried through; items
without words match nothing; an item that a document holds twice is listed once; repeated rows
give a row each; an empty benchmark or table gives no matches; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, flat

PASSAGE, TERMS, SKETCH, LATENT = 64, 8_192, 256, 128
MAX_ITEMS = 4_096
#: Terms in over this share of the passages (and in so many at least) say nothing and have no weight.
COMMON, COMMON_LEAST = 0.03, 50
#: Window lengths; an item is looked for with the longest that it fills.
SCALES = (6, 12, 24, 48, 96, 192)
#: Successive words that make a place a candidate without the model; a shorter item must be there whole.
GRAM = 4
#: Words that are summed at once while fitting, and blocks of the shortest half window that are compared at once.
FIT_WORDS, PIECE = 1 << 20, 4_096
#: Tasks whose sums are added in one group of the first step.
TREE = 32

# ASCII punctuation separates words, save the apostrophe and the hyphen; A-Z become a-z.
_BREAKS = "!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~"
_SPLIT = flat.SPACES.copy()
_SPLIT[[ord(c) for c in _BREAKS]] = True


def words_of(text: str) -> list[bytes]:
    w = split([text.encode()])
    return [w.data[a:b] for a, b in zip(w.starts.tolist(), w.ends.tolist())]


def split(texts: list[bytes]) -> flat.Words:
    return flat.Words([t.translate(flat.LOWER) for t in texts], _SPLIT)


def term_ids(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(TERMS - 1)).astype(np.int64)


# ---- the model


def _reduced(docs: DataFrame, per_task) -> dict[int, np.ndarray]:
    """Sum, over all tasks, the float32 rows {key: vector} that ``per_task(batches of texts)`` returns."""

    @common.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() // TREE
        rows = per_task(batch.column(0).to_pylist() for batch in batches)
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in rows.values()], pa.binary())], ["key", "part", "row"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(group.row.iloc[0]) // 4, np.float64)
        for row in group.row:
            total += np.frombuffer(row, np.float32)
        return pd.DataFrame({"key": group.key.iloc[:1], "row": [total.astype(np.float32).tobytes()]})

    parts = docs.select(common.utf8("text").alias("text")).mapInArrow(run, "key int, part int, row binary")
    for keys in (["key", "part"], ["key"]):
        parts = parts.groupBy(*keys).applyInPandas(add, "key int, row binary")
    return {r.key: np.frombuffer(r.row, np.float32) for r in parts.collect()}  # as many rows as the model has


def fit(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(idf, TERMS x LATENT): what folds words into the latent space; common terms have the zero vector there.

    The right singular vectors are divided by the singular values, so that the
    words that all passages share do not drown the others.
    """

    def per_task(batches):
        df = np.zeros(TERMS + 1)
        sketch = np.zeros(SKETCH * TERMS)

        def take(ids, passage, row, sign):
            ids, passage = np.concatenate(ids), np.concatenate(passage)
            row, sign = np.concatenate(row), np.concatenate(sign)
            np.add(sketch, np.bincount(row[passage] * TERMS + ids, weights=sign[passage], minlength=SKETCH * TERMS), out=sketch)
            once = np.sort(passage * TERMS + ids)
            once = once[np.append(True, once[1:] != once[:-1])]
            df[:TERMS] += np.bincount(once & (TERMS - 1), minlength=TERMS)
            df[TERMS] += len(row)

        held: list[list] = [[], [], [], []]
        words = passages = 0
        for texts in batches:
            w = split(texts)
            n = -(-w.counts // PASSAGE)
            total = int(n.sum())
            if not total:
                continue
            begin = np.cumsum(n) - n
            passage = np.repeat(begin, w.counts) + (np.arange(len(w.starts)) - np.repeat(w.first[:-1], w.counts)) // PASSAGE
            keys = np.fromiter((xxhash.xxh3_64_intdigest(t) >> 1 for t in texts), np.uint64, len(texts))
            draw = np.repeat(keys, n) + (np.arange(total) - np.repeat(begin, n)).astype(np.uint64)
            draw = (draw * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
            new = term_ids(w.hashes()), passages + passage, (draw % np.uint64(SKETCH)).astype(np.int64), np.where((draw >> np.uint64(12)) & np.uint64(1), 1.0, -1.0)
            for column, x in zip(held, new):
                column.append(x)
            words, passages = words + len(w.starts), passages + total
            if words > FIT_WORDS:
                take(*held)
                held, words, passages = [[], [], [], []], 0, 0
        if words:
            take(*held)
        return dict(enumerate(sketch.reshape(SKETCH, TERMS))) | {-1: df}

    rows = _reduced(docs, per_task)
    df = rows.pop(-1, np.zeros(TERMS + 1)).astype(np.float64)
    idf = np.log((df[TERMS] + 2.0) / (df[:TERMS] + 1.0))
    common_terms = df[:TERMS] > max(COMMON_LEAST, COMMON * df[TERMS])
    if not rows:
        return idf, np.zeros((TERMS, LATENT), np.float32)
    _, size, right = np.linalg.svd(np.array([rows[k] for k in sorted(rows)]) * np.where(common_terms, 0.0, idf), full_matrices=False)
    size = np.maximum(size[:LATENT], 1e-6 * max(size[0], 1e-6))
    latent = np.ascontiguousarray((right[:LATENT] / size[:, None]).T, np.float32)
    latent[common_terms] = 0.0
    return idf, latent


# ---- verification


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = at.get(y)
        if m is not None:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` <= GRAM successive term ids from every place, as one number each."""
    out = ids[: max(0, len(ids) - n + 1)].copy()
    for i in range(1, n):
        out = out * (TERMS + 1) + ids[i : len(ids) - n + 1 + i]
    return out


def _slot(gram: np.ndarray) -> np.ndarray:
    return (gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


class Items:
    """The benchmark's items in the form in which a task uses them."""

    def __init__(self, items: list[tuple[int, str]], idf: np.ndarray, latent: np.ndarray):
        # the last row stands for the padding
        self.weighted = np.vstack([latent * idf[:, None], np.zeros((1, latent.shape[1]))]).astype(np.float32)
        by_scale: dict[int, list] = {}
        # per length of gram: gram to (item, its place there), and a small table that most other grams fail
        self.grams: dict[int, tuple[dict, np.ndarray]] = {}
        for item_id, text in items:
            words = split([text.encode()]).hashes()
            if not len(words):
                continue
            ids = term_ids(words)
            scale = max([s for s in SCALES if s <= len(words)], default=SCALES[0])
            order = np.argsort(-idf[ids], kind="stable")
            telling = frozenset(words[order[: max(1, len(words) // 3)]].tolist())
            item = item_id, words.tolist(), telling
            by_scale.setdefault(scale, []).append((item, self.weighted[ids].sum(axis=0)))
            n = min(GRAM, len(words))
            at, may = self.grams.setdefault(n, ({}, np.zeros(1 << 20, bool)))
            found = grams(ids, n)
            may[_slot(found)] = True
            for i, gram in enumerate(found.tolist()):
                at.setdefault(gram, []).append((item, i))
        self.groups: dict[int, tuple[list, np.ndarray]] = {}
        for scale, found in sorted(by_scale.items()):
            vectors = np.array([v for _, v in found], np.float32)
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            self.groups[scale] = [item for item, _ in found], np.ascontiguousarray(vectors.T)
        self.step = min(self.groups, default=SCALES[0]) // 2
        self.longest = max(self.groups, default=SCALES[0])

    def matches(self, texts: list[bytes], cosine: float, least: float, answer: float) -> list[list[tuple[int, float]]]:
        """For every text (item_id, share of the item's words in the common subsequence), best per item."""
        words = split(texts)
        best: list[dict[int, float]] = [{} for _ in texts]
        if not self.groups or not len(words.starts):
            return [[] for _ in texts]
        hashes, counts = words.hashes(), words.counts
        # all texts in one row of terms, with gaps that no window bridges
        room = -(-counts // self.step) * self.step + self.longest
        begin = np.cumsum(room) - room
        terms = np.full(int(room.sum()), TERMS)
        terms[np.repeat(begin - words.first[:-1], counts) + np.arange(len(hashes))] = term_ids(hashes)

        def verify(item, at: int, length: int) -> None:
            """``at``: the window's place in the row of terms; a window in a gap belongs to the text after it."""
            t = int(np.searchsorted(begin, at, "right")) - 1
            if t < 0 or at - begin[t] >= counts[t]:
                t += 1
                if t == len(texts) or at + length <= begin[t]:
                    return
            item_id, held, telling = item
            if best[t].get(item_id, 0.0) >= 1.0:
                return
            start, low, high = int(at - begin[t]), int(words.first[t]), int(words.first[t + 1])
            around = hashes[low + max(0, start - len(held)) : min(high, low + start + length + len(held))].tolist()
            if len(telling.intersection(around)) >= answer * len(telling):
                share = lcs_length(held, around) / len(held)
                if share >= least and share > best[t].get(item_id, 0.0):
                    best[t][item_id] = share

        step = self.step
        piece = step * PIECE
        for low in range(0, len(terms), piece):  # pieces overlap by the longest window
            part = terms[low : low + piece + self.longest]
            for n, (held, may) in self.grams.items():
                found = grams(part, n)
                seen = set()  # the grams of one copy all say where the item begins
                for at in np.flatnonzero(may[_slot(found)]).tolist():
                    for item, i in held.get(int(found[at]), ()):
                        if (item[0], at - i) not in seen:
                            seen.add((item[0], at - i))
                            verify(item, low + at - i, len(item[1]))
            blocks = np.full((-(-len(part) // step), step), TERMS)
            blocks.ravel()[: len(part)] = part
            sums = self.weighted[blocks[:, 0]]
            for i in range(1, step):
                sums += self.weighted[blocks[:, i]]
            width = step
            for scale, (held, vectors) in self.groups.items():
                # block sums of half a window; two of them are a window
                while width < scale // 2:
                    if len(sums) % 2:
                        sums = np.vstack([sums, np.zeros((1, sums.shape[1]), np.float32)])
                    sums, width = sums[::2] + sums[1::2], width * 2
                w = sums.copy()
                w[:-1] += sums[1:]
                near = w @ vectors
                hits = np.nonzero(near >= cosine * np.maximum(np.sqrt(np.einsum("ij,ij->i", w, w)), 1e-12)[:, None])
                for at, i in zip(*(h.tolist() for h in hits)):
                    verify(held[i], low + at * width, scale)
        return [sorted(b.items()) for b in best]


def contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.45, least: float = 0.6, answer: float = 0.5) -> DataFrame:
    """(doc_id, item_ids, overlap, contaminated) of every row of ``docs``.

    item_ids are the items found, in order; overlap the largest share of an item's
    words in the longest common subsequence (0 if no item is found).
    """
    find = matcher(docs, benchmark, cosine, least, answer)

    @common.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int64())),
                    pa.array([max((s for _, s in f), default=0.0) for f in found], pa.float64()),
                    pa.array([bool(f) for f in found], pa.bool_()),
                ],
                ["doc_id", "item_ids", "overlap", "contaminated"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8("text").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, item_ids array<long>, overlap double, contaminated boolean")


def matcher(docs: DataFrame, benchmark: DataFrame, cosine: float, least: float, answer: float):
    """Fit the model on ``docs`` and return texts -> matches of each."""
    common.arrow_rows(docs.sparkSession)
    items = [(r.item_id, r.text) for r in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().collect()]
    idf, latent = fit(docs)
    # the model has a fixed size, and a block holds MAX_ITEMS items at most
    blocks = [docs.sparkSession.sparkContext.broadcast(Items(items[i : i + MAX_ITEMS], idf, latent)) for i in range(0, len(items), MAX_ITEMS)]

    def find(texts: list[bytes]) -> list[list[tuple[int, float]]]:
        found = [block.value.matches(texts, cosine, least, answer) for block in blocks]
        return [sorted(m for matches in of_text for m in matches) for of_text in zip(*found)] if found else [[] for _ in texts]

    return find


def without_contaminated(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.45, least: float = 0.6, answer: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text holds no item."""
    find = matcher(docs, benchmark, cosine, least, answer)

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not found for found in find(texts.tolist())], dtype=bool)

    return docs.where(clean(common.utf8("text")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))

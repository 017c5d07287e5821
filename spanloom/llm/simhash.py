"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints are taken over word shingles.  Distinct fingerprints are sorted by
Gray rank (the rank of a value in the reflected Gray code), in which neighbours
share long bit patterns.  The index is a hierarchy over that order: an upper node
holds the bit pattern that all fingerprints below it share under its mask, and a
search adds up the differences on its way down and leaves a whole group as soon
as they pass the bound.

Distributed form: the masks of the uppermost nodes are the ``bound`` + 1 blocks that
part the 64 bits.  Fingerprints within the bound agree in at least one whole block, so
every fingerprint goes to one uppermost node per block, whatever the size of
the input; nodes are dealt to groups of about `GROUP` fingerprints, and each group
builds the hierarchy below its nodes, with the block's bits turned to the front,
and is searched there.  No pair within the bound is lost.  Equal fingerprints are one
node from the start, pairs are folded into a union-find block of queries by block of
queries, and each group returns a spanning forest of the pairs that it finds.  The
different fingerprints that share one block's bits are one task's work, in bounded
memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, flat
from .components import connected_components

#: Fingerprints of a group; steps of a search that are held at once.
GROUP, HELD = 65_536, 1 << 20
SEGMENT = 4  # bits that one level of the lower part looks at


# ---- fingerprints


def shingle_hashes(data: bytes, words: int, seed: int = 42) -> np.ndarray:
    w = data.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    parts = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, seed) for p in parts), np.uint64)


def fingerprint(data: bytes, words: int, seed: int = 42) -> int:
    """Bit b is 1 if it is set in over half of the shingle hashes; 0 for a text without words."""
    h = shingle_hashes(data, words, seed)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 32_640):
        block = np.unpackbits(h[at : at + 32_640].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        full = len(block) // 255 * 255  # sums of 255 bits fit a byte
        if full:
            counts += np.add.reduce(block[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += np.add.reduce(block[full:], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """Return (doc_id, fp), fp the fingerprint as a signed long."""
    common.arrow_rows(docs.sparkSession)

    @common.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.utf8("text").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---- the index


def gray_rank(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def turned(x: np.ndarray, by: int) -> np.ndarray:
    """The bits of each value turned left."""
    return x if not by else (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def blocks(bound: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the bound + 1 blocks."""
    edges = [64 * i // (bound + 1) for i in range(bound + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


class GrayIndex:
    """Distinct fingerprints in Gray order under nodes of shared patterns; the first ``exact`` bits must agree."""

    def __init__(self, fps: np.ndarray, exact: int = 0, small: int = 4):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        self.exact, self.small = exact, small
        key = self.fps >> np.uint64(64 - exact) if exact else np.zeros(len(fps), np.uint64)
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(fps) else np.empty(0, np.int64)
        self.top = key[starts]
        self.by_top = np.argsort(self.top)
        self.levels = []  # for each: where nodes start, their sizes, the first child of each, the children's patterns in the segment
        depth = exact
        while depth < 64 and len(starts):
            sizes = np.diff(np.append(starts, len(self.fps)))
            if (sizes <= small).all():
                break
            width = min(SEGMENT, 64 - depth)
            key = self.fps >> np.uint64(64 - depth - width)
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            first_child = np.searchsorted(cut, np.append(starts, len(self.fps)))
            self.levels.append((starts, sizes, first_child, (key[cut] & np.uint64((1 << width) - 1)).astype(np.uint8), depth + width, width))
            starts, depth = cut, depth + width
        self.last = starts, np.diff(np.append(starts, len(self.fps)))

    def _compare(self, queries, bound, q, start, size):
        n = int(size.sum())
        qq = np.repeat(q, size)
        ff = np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(n)
        near = np.bitwise_count(queries[qq] ^ self.fps[ff]) <= bound
        return qq[near], ff[near]

    def pairs(self, queries: np.ndarray, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, place in self.fps) for all that differ in at most ``bound`` bits, part by part."""
        if not len(self.fps) or not len(queries):
            return
        key = queries >> np.uint64(64 - self.exact) if self.exact else np.zeros(len(queries), np.uint64)
        at = np.minimum(np.searchsorted(self.top[self.by_top], key), len(self.top) - 1)
        node = self.by_top[at]
        q = np.flatnonzero(self.top[node] == key)
        todo = [(0, q, node[q], np.zeros(len(q), np.uint8))]
        while todo:  # depth first, in parts of which each level holds about HELD steps
            level, q, node, apart = todo.pop()
            starts, sizes = self.levels[level][:2] if level < len(self.levels) else self.last
            few = sizes[node] <= self.small if level < len(self.levels) else np.ones(len(q), bool)
            steps = np.where(few, sizes[node], 0 if level == len(self.levels) else 1 << SEGMENT)
            if len(q) > 1 and steps.sum() > HELD:
                half = len(q) // 2
                todo += [(level, x[0], x[1], x[2]) for x in ((q[:half], node[:half], apart[:half]), (q[half:], node[half:], apart[half:]))]
                continue
            if few.any():
                yield self._compare(queries, bound, q[few], starts[node[few]], sizes[node[few]])
                q, node, apart = q[~few], node[~few], apart[~few]
            if not len(q):
                continue
            _, _, first_child, patterns, upto, width = self.levels[level]
            children = first_child[node + 1] - first_child[node]
            at = np.repeat(first_child[node] - np.append(0, np.cumsum(children)[:-1]), children) + np.arange(int(children.sum()))
            q, apart = np.repeat(q, children), np.repeat(apart, children)
            segment = ((queries[q] >> np.uint64(64 - upto)) & np.uint64((1 << width) - 1)).astype(np.uint8)
            apart = apart + np.bitwise_count(segment ^ patterns[at])
            keep = apart <= bound
            todo.append((level + 1, q[keep], at[keep], apart[keep]))


class Forest:
    """Union-find over n places, fed with arrays of pairs; keeps one pair for each join."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.root[a], self.root[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return
        x, y = x[apart], y[apart]
        low, high = np.minimum(x, y), np.maximum(x, y)
        _, first = np.unique(low * len(self.root) + high, return_index=True)
        root = self.root
        for i in first.tolist():
            u, v = int(low[i]), int(high[i])
            while root[u] != u:
                u = root[u]
            while root[v] != v:
                v = root[v]
            if u != v:
                root[max(u, v)] = min(u, v)
                self.kept.append((int(a[apart[i]]), int(b[apart[i]])))
        while True:  # every place points to its root again
            above = root[root]
            if (above == root).all():
                return
            root[:] = above


def near_links(nodes: DataFrame, bound: int) -> DataFrame:
    """Links (a, b) between the rows of (t, fp, node), fp distinct in each t, whose fingerprints differ in at most ``bound`` bits.

    A spanning forest per group: the components are those of all pairs within the bound.
    """
    most = nodes.groupBy("t").count().agg(F.max("count")).first()[0] or 0
    parts = np.uint64(max(1, -(-most // GROUP)))
    cuts = blocks(bound)

    @common.tidied
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(1).to_numpy().view(np.uint64)
            for i, (first, bits) in enumerate(cuts):
                top = turned(fp, first) >> np.uint64(64 - bits)
                part = (flat.mixed(top + np.uint64(1)) % parts).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(fp), i, np.int32)), pa.array(part), batch.column(1), batch.column(2)], ["t", "block", "part", "fp", "node"])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        first, bits = cuts[int(group.block.iloc[0])]
        fp, node = turned(group.fp.to_numpy().view(np.uint64), first), group.node.to_numpy()
        index = GrayIndex(fp, bits)
        forest = Forest(len(fp))
        for q, f in index.pairs(index.fps, bound):
            forest.add(q, f)
        held = node[index.order]
        if len(fp) > GROUP // 8:
            common.give_back()
        a, b = np.array(forest.kept, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"a": held[a], "b": held[b]})

    routed = nodes.select("t", "fp", "node").mapInArrow(route, "t int, block int, part int, fp long, node long")
    return routed.groupBy("t", "block", "part").applyInPandas(search, "a long, b long")


def _components(nodes: DataFrame, tables: list[str], bound: int) -> DataFrame:
    """(node, component) of nodes with one fingerprint per table: a link in any table is a link."""
    held = nodes.select(F.posexplode(F.array(*tables)).alias("t", "fp"), "node")
    firsts = common.materialize(held.groupBy("t", "fp").agg(F.min("node").alias("node")), "nodes")
    links = near_links(firsts, bound)
    if len(tables) > 1:  # several nodes may have the fingerprint: each is linked to the first
        links = links.unionByName(held.join(firsts.withColumnRenamed("node", "b"), ["t", "fp"]).where("node <> b").select(F.col("node").alias("a"), "b"))
    out = connected_components(links)
    common.discard(nodes.sparkSession, firsts)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, bound: int = 3) -> DataFrame:
    """Return (doc_id, fingerprint, component_id), one row per row of ``docs``.

    component_id is the smallest doc_id that links of at most ``bound`` differing
    bits reach.  Defined cases: a null or empty text has fingerprint zero and is
    linked like any other; rows with a null doc_id are returned, share
    fingerprints, but never name a component (component_id is null if no doc_id is
    reached); repeated rows give one row each; an empty table gives no rows;
    columns besides doc_id and text are ignored.
    """
    prints = common.materialize(fingerprints(docs, words), "fingerprints")
    # fingerprints held by rows without a doc_id only still carry links: they get a node above all doc_ids
    nameless = F.lit(1 << 62) + (F.xxhash64("fp").bitwiseAND(F.lit((1 << 61) - 1)))
    named = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).select("fp", F.coalesce("node", nameless).alias("node")), "nodes")
    components = _components(named, ["fp"], bound)
    final = named.join(components, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(final, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component_id") < F.lit(1 << 62), F.col("component_id")).alias("component_id"),
    )


#: Tables of `keep_one`: seeds of the word hashes.
SEEDS = tuple(range(42, 54))
#: Copies of the first text of a component to which its other texts are joined, where there are many.
SALTS, MANY = 16, 2_048
#: Shingles of a component that one task counts, and most tasks that share a component's.
SLICE, SLICES = 1 << 18, 64


#: A byte to eight bytes, one for each of its bits: sums of 255 of them do not run over.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def majorities(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For successive groups of hashes the value whose bits are set in over half of the group; 0 for an empty one."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    sizes = sizes[some]
    pieces = -(-sizes // 255)
    first = np.cumsum(pieces) - pieces
    cuts = np.repeat(np.cumsum(sizes) - sizes, pieces) + 255 * (np.arange(int(pieces.sum())) - np.repeat(first, pieces))
    bits = _SPREAD[h.astype(">u8").view(np.uint8).reshape(-1, 8)]
    sums = np.ascontiguousarray(np.add.reduceat(bits, cuts, axis=0)).view(np.uint8).reshape(len(cuts), 64)
    counts = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
    out[some] = np.packbits(counts * 2 > sizes[:, None], axis=1).view(">u8").ravel()
    return out


def word_set_fingerprints(docs: DataFrame, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """(doc_id, text_key, f0, f1, ...): per seed the fingerprint of the text's set of words."""
    common.arrow_rows(docs.sparkSession)
    names = [f"f{i}" for i in range(len(seeds))]
    salts = [np.uint64(xxhash.xxh64_intdigest(b"", s)) for s in seeds]

    @common.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = flat.Words([t.translate(flat.LOWER) for t in batch.column(2).to_pylist()])
            h = words.hashes()
            owner = np.repeat(np.arange(batch.num_rows), words.counts)
            order = np.lexsort((h, owner))
            h, owner = h[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, sizes = h[new], np.bincount(owner[new], minlength=batch.num_rows)
            found = [majorities(flat.mixed(h ^ s), sizes) for s in salts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x.view(np.int64)) for x in found]], ["doc_id", "text_key", *names])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), common.utf8("text").alias("text"))
    return narrow.mapInArrow(run, ", ".join(["doc_id long", "text_key binary", *[f"{n} long" for n in names]]))


def text_key(text: str = "text"):
    """128 bits that stand for the text."""
    return F.unhex(F.md5(common.utf8(text)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct values; 1 for two empty ones."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """``texts`` with the sorted hashes of its distinct shingles, ``shingles``, and their number, ``size``, for its text."""

    @common.tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                h = flat.Words([text.translate(flat.LOWER)]).hashes()
                width = min(words, len(h))
                grams = h[: len(h) - width + 1].copy() if width else h
                for i in range(1, width):
                    grams = flat.mixed(grams * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
                found.append(np.unique(grams).tobytes())
            sizes = pa.array([len(x) // 8 for x in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary()), sizes], [*batch.schema.names[:-1], "shingles", "size"])

    names = [c for c in texts.columns if c != "text"]
    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in names)
    return texts.select(*names, "text").mapInArrow(run, f"{kinds}, shingles binary, size int")


def prefix(sizes: np.ndarray, least: float) -> np.ndarray:
    """How many shingles of a set of each size, the first in any order, are enough to meet every set at ``least``."""
    return sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1


def rare_shingles(texts: DataFrame, least: float) -> DataFrame:
    """(component, h, text_key, group, size, p): the rarest shingles of each text, without those that no other of its component holds.

    ``texts``: (component, text_key, group, size, total, shingles), total the shingles of
    the component.  p is a shingle's place among those of its text, in the order of (texts of
    the component that hold it, h); those whose place is too late for a link at ``least`` have
    no row.  Components of one group have none.  A large component's shingles are dealt to
    several tasks, each of which counts some of them.
    """
    names = ["component", "text_key", "group", "size"]
    kinds = "component long, text_key binary, group binary, size int"

    @common.tidied
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, slices, parts = [], [], []
            for row, (slice_count, data) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                h = _set(data) if data else np.zeros(1, np.uint64)  # texts without words share one
                of = flat.mixed(h) % np.uint64(slice_count)
                for i in np.unique(of).tolist():
                    rows.append(row)
                    slices.append(i)
                    parts.append(h[of == i].tobytes())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(4)), pa.array(slices, pa.int32()), pa.array(parts, pa.binary())], [*names, "slice", "part"])

    def count(found: pa.Table) -> pa.Table:
        if len(found["group"].unique()) < 2:
            found = found.slice(0, 0)
        sets = [_set(x) for x in found["part"].to_pylist()]
        h = np.concatenate([np.empty(0, np.uint64), *sets])
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        _, at, held = np.unique(h, return_inverse=True, return_counts=True)
        held = held[at]
        order = np.lexsort((h, held, owner))
        h, owner, held = h[order], owner[order], held[order]
        place = np.arange(len(h)) - np.searchsorted(owner, np.arange(len(sets)))[owner]
        kept = (held > 1) & (place < prefix(np.maximum(found["size"].to_numpy(), 1).astype(np.int64), least)[owner])
        cuts = np.searchsorted(owner[kept], np.arange(len(sets) + 1)).tolist()
        h, many = h[kept], held[kept]
        parts = [(h[a:b].tobytes(), many[a:b].astype(np.int64).tobytes()) for a, b in zip(cuts, cuts[1:])]
        alone = np.bincount(owner[held == 1], minlength=len(sets)).astype(np.int32)
        return pa.table([*(found[n] for n in names), pa.array(alone), pa.array([x for x, _ in parts], pa.binary()), pa.array([x for _, x in parts], pa.binary())], [*names, "alone", "h", "held"])

    @common.tidied
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, at = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            sizes = np.maximum(batch.column(3).to_numpy(), 1).astype(np.int64)
            for row, (alone, parts, most) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), prefix(sizes, least).tolist())):
                h = np.concatenate([_set(x["h"]) for x in parts])
                order = np.lexsort((h, np.concatenate([np.frombuffer(x["held"], np.int64) for x in parts])))[: max(0, most - alone)]
                rows.append(np.full(len(order), row))
                hashes.append(h[order].view(np.int64))
                at.append(alone + np.arange(len(order)))
            row = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
            component, key, group, _ = (batch.column(i).take(row) for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [component, pa.array(np.concatenate(hashes)), key, group, pa.array(sizes.astype(np.int32)).take(row), pa.array(np.concatenate(at).astype(np.int32))], ["component", "h", "text_key", "group", "size", "p"]
            )

    slices = F.least(F.lit(SLICES), F.floor(F.col("total") / F.lit(SLICE)) + 1).cast("int")
    dealt = texts.select(*names, slices.alias("slices"), "shingles").mapInArrow(deal, f"{kinds}, slice int, part binary")
    counted = dealt.groupBy("component", "slice").applyInArrow(count, f"{kinds}, alone int, h binary, held binary")
    whole = counted.groupBy(*names).agg(F.sum("alone").cast("int").alias("alone"), F.collect_list(F.struct("h", "held")).alias("parts"))
    return whole.mapInArrow(places, "component long, h long, text_key binary, group binary, size int, p int")


def keep_one(docs: DataFrame, bound: int = 3, seeds: tuple[int, ...] = SEEDS, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group of linked texts the one with the smallest doc_id stays.

    Texts are linked whose sets of ``words``-word shingles have a Jaccard similarity
    of ``least`` or more; no row goes without such links.  Candidates are the texts of one
    component of the index: fingerprints of shingles differ too much at that
    similarity to be found within three bits, so they are those of the sets of
    words, and several tables, each with its own hashes, make up for the chance in one.

    Every candidate is compared, by the shingles themselves, with the first text of its
    component; the texts near to it are one group, each other text is its own.  Then
    texts of different groups are compared that share one of their rarest shingles of
    the component, if its place in both and their sizes allow the similarity: first each
    with one text for a shingle, and after the groups have been joined, every pair that is
    left, so no link between groups is lost and none is looked for inside a group.  The
    groups in the end are the components of these verified links.

    Rows without a doc_id stay; rows with the same doc_id never remove each other;
    texts without words are equal to each other; an empty table gives no rows; other
    columns are carried through.
    """
    spark = docs.sparkSession
    named = docs.where("doc_id is not null")
    prints = common.materialize(word_set_fingerprints(named, seeds), "fingerprints")
    tables = [c for c in prints.columns if c not in ("doc_id", "text_key")]
    # texts with the same fingerprints in all tables are one node
    nodes = common.materialize(prints.groupBy(*tables).agg(F.min("doc_id").alias("node")), "nodes")
    components = _components(nodes, tables, bound)
    first = nodes.join(components, "node", "left").select(*tables, F.coalesce("component", "node").alias("component"))
    texts = common.materialize(prints.groupBy("text_key", *tables).agg(F.min("doc_id").alias("doc_id")).join(first, tables).select("component", "doc_id", "text_key"), "texts")
    sizes = texts.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key")).alias("f")).where("n > 1")
    sizes = common.materialize(sizes.select("component", "n", F.col("f.text_key").alias("first_key")), "sizes")
    # only texts that have a candidate are shuffled
    asked = common.materialize(texts.join(sizes, "component"), "asked")
    wanted = common.member(asked, "text_key")
    held = named.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), common.utf8("text").alias("text")).where(wanted(F.col("text_key")))
    # a text that a doc_id has twice is taken twice; that does no harm
    sets = common.materialize(shingle_sets(held.join(asked.hint("merge"), ["doc_id", "text_key"]).select("component", "doc_id", "text_key", "n", "first_key", "text"), words), "shingles")

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(_set(x), _set(y)) >= least for x, y in zip(a, b)], dtype=bool)

    totals = sets.groupBy("component").agg(F.sum("size").alias("total"))
    salt = F.when(F.col("n") > MANY, F.pmod(F.xxhash64("text_key"), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("n") > MANY, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    heads = sets.where("text_key = first_key").dropDuplicates(["component"]).join(totals, "component").select("component", "total", F.explode(salts).alias("salt"), F.col("shingles").alias("first_shingles"))
    # the first is near to itself
    joined = sets.withColumn("salt", salt).join(heads, ["component", "salt"])
    group = F.when((F.col("text_key") == F.col("first_key")) | near("shingles", "first_shingles"), F.col("first_key")).otherwise(F.col("text_key"))
    compared = common.materialize(joined.select("component", "text_key", group.alias("group"), "size", "total", "shingles"), "compared")
    common.discard(spark, asked, sizes, sets)
    links = compared.where("text_key <> group").select(F.col("text_key").alias("a"), F.col("group").alias("b"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = common.materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        wanted = common.member(pairs.select(F.explode(F.array("a", "b")).alias("text_key")), "text_key")
        known = compared.where(wanted(F.col("text_key"))).select("text_key", "shingles").dropDuplicates(["text_key"])
        known = common.materialize(known, "known")
        out = common.materialize(pairs.join(known.toDF("a", "of_a"), "a").join(known.toDF("b", "of_b"), "b").where(near("of_a", "of_b")).select("a", "b"), "verified")
        common.discard(spark, pairs, known)
        return out

    #: Whether texts whose first common shingle has these places can reach the similarity.
    reach = F.least(F.col("size") - F.col("p"), F.col("size_b") - F.col("p_b")) >= F.lit(least / (1 + least)) * (F.col("size") + F.col("size_b")) - F.lit(1e-9)
    at = ["component", "h"]
    rare = common.materialize(rare_shingles(compared, least), "rare")
    # each text with the one of its shingle that has the fewest shingles of its own
    pivot = rare.groupBy(*at).agg(F.min("group").alias("low"), F.max("group").alias("high"), F.min(F.struct("p", "size", "text_key", "group")).alias("y")).where("low <> high")
    pivot = pivot.select(*at, F.col("y.p").alias("p_b"), F.col("y.size").alias("size_b"), F.col("y.text_key").alias("b"), F.col("y.group").alias("group_b"))
    met = verified(rare.join(pivot, at).where((F.col("group") != F.col("group_b")) & reach).select(F.col("text_key").alias("a"), "b"))
    links = common.materialize(links.unionByName(met), "links")
    groups = connected_components(links)
    # then each text that is not in its shingle's largest group with all texts of other groups
    rare = rare.join(groups.toDF("text_key", "joined"), "text_key", "left").withColumn("group", F.coalesce("joined", "group")).drop("joined")
    main = rare.groupBy(*at, "group").count().groupBy(*at).agg(F.max_by("group", F.struct("count", "group")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    rare = common.materialize(rare.join(main, at).select(*rare.columns, (F.col("group") != F.col("main")).alias("beside")), "rare")
    of = rare.select(*at, F.col("p").alias("p_b"), F.col("size").alias("size_b"), F.col("text_key").alias("b"), F.col("group").alias("group_b"))
    last = verified(rare.where("beside").join(of, at).where((F.col("group") != F.col("group_b")) & reach).select(F.col("text_key").alias("a"), "b"))
    if last.limit(1).count():
        groups = connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(last))

    # the first text of each group stays
    grouped = texts.join(groups.select(F.col("node").alias("text_key"), F.col("component").alias("in_group")), "text_key")
    stays = grouped.groupBy("in_group").agg(F.min("doc_id").alias("kept"))
    gone = grouped.join(stays, "in_group").where("doc_id > kept").select("text_key", F.lit(True).alias("gone"))
    known = texts.select("text_key", F.col("doc_id").alias("owner")).join(gone, "text_key", "left")
    extra = prints.select("doc_id", "text_key").join(known, "text_key").where("gone or doc_id <> owner").select("doc_id", "text_key").distinct()
    extra = common.materialize(extra, "extra")
    common.discard(spark, compared, nodes, texts, prints)
    same = (F.col("x.doc_id") == F.col("y.doc_id")) & (text_key("x.text") == F.col("y.text_key"))
    return docs.alias("x").join(extra.alias("y"), same, "left_anti").select(docs.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.finished(spark, lambda: near_duplicates(common.table(spark, sf_dir, "documents"), words=3, bound=2))

"""Byte-level BPE encoding and decoding, in time linear in the text.

Every byte is mapped to the Latin-1 character of its value, so that an
Aho-Corasick automaton over strings finds the longest vocabulary token at every
position that is entered.  From there the encoder steps forward, keeps a token
only if it is compatible with the one before (the merges applied to their joined
bytes give just these two), tries the next shorter match otherwise, and steps
back when none is left.  A position that failed once is never entered again, so
a piece costs time linear in its length.  Adjacent-token compatibility is
memoised.  The result equals the one of the rank-ordered merges.

Ids of runs between white space are memoised in one array; a text's ids, and
their decimals, are gathered from arrays.

Defined cases: a null text counts as the empty one (no ids; SHA-256 of nothing);
a null or repeated ``doc_id`` is carried through, one output row per input row;
texts of any length are encoded whole; columns besides ``doc_id`` and ``text``
are ignored by ``encode_documents``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import weakref
from array import array
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pairs of tokens, runs and ids of runs that are held; with more, all are made anew.
HELD_PAIRS, HELD_UNITS, HELD_IDS = 500_000, 500_000, 8_000_000
#: Most bytes of a token that is decoded by rows of one width.
WIDTH = 16
#: Runs that are gathered at once; a text of more is done part by part.
PART_UNITS = 65_536


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Units(dict):
    """From a run to its place in ``ids``: the ids of the run at place p are ids[ends[p]:ends[p + 1]]."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = weakref.proxy(bpe)  # no cycle: a tokenizer that is let go is freed at once
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.ids, self.ends = array("i"), array("q", [0])

    def __missing__(self, unit: str) -> int:
        self.ids.extend(self.bpe.encode(unit))
        place = len(self.ends) - 1
        self.ends.append(len(self.ids))
        if len(unit) <= 64:
            self[unit] = place
        return place

    def gather(self, units: list[str]) -> np.ndarray:
        """The ids of the runs, one after another."""
        if len(self.ends) > HELD_UNITS or len(self.ids) > HELD_IDS:
            self.reset()
        places = np.fromiter(map(self.__getitem__, units), np.intp, len(units))
        ids, ends = np.frombuffer(self.ids, np.intc), np.frombuffer(self.ends, np.int64)
        first = ends[places]
        sizes = ends[places + 1] - first
        upto = np.cumsum(sizes)
        return ids[np.repeat(first - upto + sizes, sizes) + np.arange(upto[-1])]


class ByteBPE:
    """Encoder and decoder for one rank table and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        # a run of characters that are not white space, with the space before it; white space as the pattern cuts it
        self.units = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+").findall
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.span = max(ranks.values(), default=0) + 1
        # of every id, and last of -1 (the start of a piece): whether an id may follow it
        self.after: list[dict[int, bool]] = [{} for _ in range(self.span + 1)]
        self.n_pairs = 0
        self.traces: dict[int, tuple[list[int], list[bytes], list[bytes]] | None] = {}
        # of every id: its length, and the longest shorter token that begins it, or -1
        self.sizes, self.shorter = [0] * self.span, [-1] * self.span
        for t, i in ranks.items():
            self.sizes[i] = len(t)
            self.shorter[i] = next((r for n in range(len(t) - 1, 0, -1) if (r := ranks.get(t[:n])) is not None), -1)
        self.widest = max(map(len, ranks), default=1)
        # every id in decimal after a space, and every token, filled up with zero bytes; tokens that this would change are odd
        self.decimals = np.array([b" %d" % i for i in range(self.span)], "S")
        rows = [self.tokens.get(i, b"") for i in range(self.span)]
        self.odd = np.array([len(t) > WIDTH or b"\0" in t or not t for t in rows])
        self.rows = np.array([b"" if o else t for t, o in zip(rows, self.odd)], f"S{WIDTH}")
        self.held = Units(self)
        self.unit_safe = _cuts_at_spaces(pattern)
        self.one_piece = re.compile(" ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+").fullmatch if _keeps_words(pattern) else None

    def _step(self, parts: list[bytes]) -> int | None:
        """Make the merge of the smallest rank, the leftmost of equal ones, in place; its rank, or None if there is none."""
        rank, at, best = self.ranks.get, -1, None
        for i in range(len(parts) - 1):
            r = rank(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                at, best = i, r
        if best is not None:
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return best

    def merge(self, data: bytes) -> list[int]:
        """The ids that rank-ordered merging gives; quadratic, for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while self._step(parts) is not None:
            pass
        return [self.ranks[p] for p in parts]

    def trace(self, token: int) -> tuple[list[int], list[bytes], list[bytes]] | None:
        """How merging the token's own bytes gives it: the rank of every merge, and the first and the last part
        before each and at the end.  None if merging does not give the token.
        """
        found = self.traces.get(token, False)
        if found is False:
            parts = [bytes([b]) for b in self.tokens[token]]
            steps, first, last = [], [parts[0]], [parts[-1]]
            while (step := self._step(parts)) is not None:
                steps.append(step)
                first.append(parts[0])
                last.append(parts[-1])
            found = self.traces[token] = (steps, first, last) if len(parts) == 1 else None
        return found

    def _meet(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives just these two.

        Until a merge crosses the border, each side goes its own way; of equal ranks the leftmost is merged first.
        """
        if (a := self.trace(left)) is None or (b := self.trace(right)) is None:
            return False
        (steps, _, ends), (others, begins, _) = a, b
        i, j, n, m, rank, never = 0, 0, len(steps), len(others), self.ranks.get, self.span
        while True:
            here, there = steps[i] if i < n else never, others[j] if j < m else never
            across = rank(ends[i] + begins[j], never)
            if across < here and across <= there:
                return False
            if here == there == never:
                return True
            if here <= there:
                i += 1
            else:
                j += 1

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``; -1 on the left is the start of a piece."""
        found = self.after[left].get(right)
        if found is None:
            if self.n_pairs >= HELD_PAIRS:
                self.n_pairs = 0
                for held in self.after:
                    held.clear()
            found = self.after[left][right] = self.trace(right) is not None if left < 0 else self._meet(left, right)
            self.n_pairs += 1
        return found

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        if not data:
            return []
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, n = data.decode("latin-1"), len(data)
        longest, sizes, shorter, widest = self.automaton.iter_long, self.sizes, self.shorter, self.widest
        compatible, after = self.compatible, self.after
        out: list[int] = []
        last, at = -1, 0  # the last kept token, and where it ends
        dead: set[int] = set()  # positions from which no encoding goes on
        while at < n:
            begin, edge, token = at, at + 4 * widest, -1
            sure = n if edge >= n else edge - widest  # up to here, the edge cuts no match
            for end, token in longest(text[begin:edge]):  # longest matches, one after another
                end += begin + 1
                if at > sure:
                    token = -1
                    break
                if at + sizes[token] != end:
                    return self.merge(data)  # a byte that is no token
                try:
                    fits = after[last][token]
                except KeyError:
                    fits = compatible(last, token)
                if not fits or end in dead:
                    break
                out.append(token)
                last, at = token, end
            else:
                token = -1
                if at == begin:
                    return self.merge(data)
            if token < 0:
                continue
            while True:  # the next shorter match, or a step back
                token = shorter[token]
                while token < 0:
                    if not out:
                        return self.merge(data)
                    dead.add(at)
                    token = out.pop()
                    at -= sizes[token]
                    last = out[-1] if out else -1
                    token = shorter[token]
                end = at + sizes[token]
                try:
                    fits = after[last][token]
                except KeyError:
                    fits = compatible(last, token)
                if fits and end not in dead:
                    out.append(token)
                    last, at = token, end
                    break
        return out

    def encode(self, text: str) -> list[int]:
        if self.one_piece is not None and self.one_piece(text):
            return self.encode_bytes(text.encode())
        out: list[int] = []
        encode = self.encode_bytes
        for piece in self.split(text):
            out += encode(piece.encode())
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def _decode_array(self, ids: np.ndarray) -> bytes:
        if self.odd[ids].any():
            return self.decode(ids.tolist())
        return self.rows[ids].tobytes().translate(None, b"\0")

    def parts(self, text: str) -> Iterator[np.ndarray]:
        """The ids of the text, part by part."""
        if not self.unit_safe:
            yield np.array(self.encode(text), np.intc)
            return
        units = self.units(text)
        for at in range(0, len(units), PART_UNITS):
            yield self.held.gather(units[at : at + PART_UNITS])

    def digest(self, text: str, keep: list[np.ndarray] | None = None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids joined by spaces, SHA-256 of the decoded bytes; ``keep`` gets the ids."""
        n, ids_sha, data_sha = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.parts(text):
            decimal = self.decimals[ids].tobytes().translate(None, b"\0")
            ids_sha.update(decimal if n else decimal[1:])
            data_sha.update(self._decode_array(ids))
            n += len(ids)
            if keep is not None:
                keep.append(ids)
        return n, ids_sha.hexdigest(), data_sha.hexdigest()


# The characters with the Unicode property White_Space, as ranges.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"


def _cuts_at_spaces(pattern: str) -> bool:
    """Whether the pattern never joins characters across the end of a run of non-white characters.

    Only then may runs be encoded one by one and memoised.  This holds for
    patterns whose alternatives begin with an optional space and go on with
    non-white classes, and which end in the two usual white-space alternatives.
    """
    head, _, tail = pattern.partition(r"|\s+(?!\S)|\s+")
    return tail == "" and head != pattern and r"\s+" not in head and r"\s*" not in head and r"[\r\n]" not in head


def _keeps_words(pattern: str) -> bool:
    """Whether letters, with the space before them, are one piece: only an apostrophe begins the alternatives before theirs."""
    before, found, _ = pattern.partition(r"| ?\p{L}+|")
    return found != "" and all(re.fullmatch("'[a-z]+", a) for a in before.split("|"))


_loaded: dict[tuple[str, str], ByteBPE] = {}


def tokenizer(path: str, pattern: str) -> ByteBPE:
    """One encoder for each Python process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(load_ranks(path), pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Return every row of ``docs`` with ``ids`` (array<int>) added."""
    common.arrow_rows(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(texts):
        bpe = tokenizer(path, pattern)
        return texts.map(lambda t: bpe.encode(t or ""))

    return docs.withColumn("ids", ids(F.coalesce(F.col(text), F.lit(""))))


def decode_ids(docs: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Return every row of ``docs`` with ``decoded`` (binary) added; null ids decode to nothing."""
    common.arrow_rows(docs.sparkSession)

    @F.pandas_udf("binary")
    def decoded(values):
        bpe = tokenizer(path, pattern)
        return values.map(lambda v: bpe.decode([] if v is None else map(int, v)))

    return docs.withColumn("decoded", decoded(F.col(ids)))


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode every text whole; return counts and digests per document."""
    common.arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            done = [bpe.digest(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenize_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256) of every row of ``docs``."""
    common.arrow_rows(docs.sparkSession)
    names = ["doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            ids: list[np.ndarray] = []
            done = [bpe.digest(text, ids) for text in batch.column(3).to_pylist()]
            ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            offsets = np.cumsum([0] + [d[0] for d in done]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array([d[0] for d in done], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array([d[1] for d in done], pa.string()), pa.array([d[2] for d in done], pa.string())],
                names,
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, lang string, source string, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

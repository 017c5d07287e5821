"""WARC archives: writing, and reading by boundary-chain verification.

Writing: one record per page.  Of records with equal payloads of at least
`REVISIT_LEAST` bytes, the one with the smallest page_id is a response and the others
are revisits, which name the response and have no payload.  Spark's text sink
writes the records: a record is a row, and the line separator is the two CRLF
that end a WARC record, so the part files are plain WARC files of any size.

Which record is a revisit is decided on ids and digests; a revisit's payload is
dropped where it lies, and only single payloads of rows that come more than once are shuffled.

Reading: Spark's text reader cuts the files at the magic ``WARC/1.0`` CRLF, in
splits that different tasks read.  A piece between two magics is a candidate
record; payloads may hold the magic, so not every candidate is a record.
1. Each task walks its splits and emits, per candidate, its length and what its
   header says: where the next record must begin.
2. Sums of lengths per split, then over the splits of a file, give exact offsets.
3. In each split, the chain from every candidate is followed to the first offset
   beyond the split.  Pointer jumping over these exits (each round doubles the
   length of the known jumps) finds the entries reachable from the file's start.
4. Walking from the reachable entry of each split marks the true records.
   Candidates off the chain are parts of payloads; a record whose payload was cut
   is joined together from its pieces, in order.
A chain that ends before its file does is an error (`BrokenArchive`), so no record is lost
unsaid; only with ``strict`` off the records before the break are returned.

Defined cases: null html is the empty payload; empty payloads are responses; a null page_id
is written without an id and reads back as null, and as such never is the
response of others (equal payloads without any id are all responses); repeated
rows revisit the first; urls and headers may have any length, white space in a url is
percent-encoded; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

REVISIT_LEAST = 100
MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"

# White space that may not stand in a header line, and its percent-encoding.
_ENCODED = {"\r": "%0D", "\n": "%0A", "\t": "%09", "\x0b": "%0B", "\x0c": "%0C", " ": "%20"}


class BrokenArchive(RuntimeError):
    """The chain of records ends before the file does, or records are missing."""


# ---- writing


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, bytes, html, first): of revisits ``first`` is the response, of responses null."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"), html.alias("html")
    ).withColumn("k", F.xxhash64("digest", "page_id"))
    keys = rows.drop("html")
    big = keys.where(F.col("bytes") >= REVISIT_LEAST)
    first = big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").drop("copies")
    # rows that revisit another, and rows of which the response has several
    roles = big.join(first, "digest").groupBy("k", "digest", "page_id", "first").agg(F.count("*").alias("n"), F.min("url").alias("least_url")).where("not (page_id <=> first) or n > 1")
    roles = common.materialize(roles, "roles")
    special = common.member(roles, "k")
    plain = rows.where(~special(F.col("k"))).select("page_id", "url", "digest", "bytes", "html", F.lit(None).cast("long").alias("first"))

    others = keys.where(special(F.col("k"))).alias("x").join(roles.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.digest") == F.col("y.digest")) & F.col("x.page_id").eqNullSafe(F.col("y.page_id")), "left")
    others = common.materialize(others.select("x.*", "first", "n", "least_url"), "others")
    bare = ["page_id", "url", "digest", "bytes", F.lit(None).cast("string").alias("html"), "first"]
    revisits = others.where("first is not null and not (page_id <=> first)").select(*bare)
    # of repeated rows of a response all but one revisit it
    again = others.where("page_id = first").groupBy("page_id", "url", "digest", "bytes", "first", "least_url").agg(F.count("*").alias("n"))
    again = again.withColumn("n", F.col("n") - F.col("url").eqNullSafe(F.col("least_url")).cast("long")).where("n > 0")
    again = again.withColumn("one", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(*bare)
    # payloads of responses with repeated rows, and of rows that the filter let through
    wanted = others.where("first is null or page_id = first").select("k", "digest", F.col("page_id").alias("of"), "first").distinct()
    wanted = common.materialize(wanted, "wanted")
    asked = common.member(wanted, "k")
    held = rows.where(special(F.col("k"))).where(asked(F.col("k"))).join(wanted, ["k", "digest"]).where(F.col("page_id").eqNullSafe(F.col("of")))
    once = held.where("first is not null").groupBy("page_id", "digest", "bytes").agg(F.min("url").alias("url"), F.first("html").alias("html"))
    strays = held.where("first is null")
    out = plain.unionByName(revisits).unionByName(again)
    for part in (once, strays):
        out = out.unionByName(part.select("page_id", "url", "digest", "bytes", "html", F.lit(None).cast("long").alias("first")))
    return out


def write_warc(pages: DataFrame, path: str) -> None:
    """Write the archive of (page_id, url, html) under ``path``."""
    rows = plan_records(pages)
    revisit = F.col("first").isNotNull()
    url = F.coalesce("url", F.lit(""))
    for raw, encoded in _ENCODED.items():
        url = F.replace(url, F.lit(raw), F.lit(encoded))
    crlf = "\r\n"
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(crlf + "WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">" + crlf + "WARC-Date: 1970-01-01T00:00:00Z" + crlf),
        F.lit("WARC-Target-URI: "), url,
        F.lit(crlf + "WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(crlf + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + crlf + "WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit(crlf + "Content-Type: text/html; charset=utf-8" + crlf + "Content-Length: "),
        F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string")),
        F.lit(crlf + crlf),
        F.coalesce("html", F.lit("")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END.decode()).option("compression", "none").text(path)


# ---- reading


def _header(piece: bytes) -> tuple[int, int, dict[bytes, bytes]]:
    """(bytes up to the payload, payload bytes, fields) of a piece without its magic; (-1, -1, {}) if it has no header."""
    end = piece.find(END)
    if end < 0:
        return -1, -1, {}
    fields: dict[bytes, bytes] = {}
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    length = fields.get(b"content-length", b"")
    return (end + len(END), int(length), fields) if length.isdigit() else (-1, -1, {})


FIELDS = "page_id long, type string, refers_to long, stated string"


def _fields(found: dict[bytes, bytes]) -> tuple:
    def number(name):
        value = found.get(name, b"").removeprefix(b"<urn:page:").removesuffix(b">")
        return int(value) if value.removeprefix(b"-").isdigit() and abs(int(value)) < 1 << 63 else None

    return number(b"warc-record-id"), found.get(b"warc-type", b"").decode("utf-8", "replace"), number(b"warc-refers-to"), found.get(b"warc-payload-digest", b"").removeprefix(b"sha256:").decode("utf-8", "replace")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, nth, size, next, FIELDS, bytes, digest, piece): every piece between two magics.

    size counts the piece and the magic before it; ``next`` is where the record
    would end, counted from its own start; ``piece`` is kept only where the record is not complete in itself.
    """
    raw = spark.read.option("lineSep", MAGIC.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))
    common.arrow_rows(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, nth = None, 0
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            for file, split, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, split) != place:
                    place, nth = (file, split), 0
                head, payload, fields = _header(piece)
                whole = head >= 0 and len(piece) == head + payload + len(END) and piece.endswith(END)
                row = nth, len(piece) + len(MAGIC), len(MAGIC) + head + payload + len(END) if head >= 0 else -1, *(_fields(fields) if whole else (None,) * 4), payload, hashlib.sha256(piece[head : head + payload]).hexdigest() if whole else None, None if whole else piece
                for column, x in zip(out, row):
                    column.append(x)
                nth += 1
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(out, types)]], ["file", "split", "nth", "size", "next", "page_id", "type", "refers_to", "stated", "bytes", "digest", "piece"])

    return raw.mapInArrow(run, f"file string, split long, nth long, size long, next long, {FIELDS}, bytes long, digest string, piece binary")


def _exits(start: list[int], succ: list[int], end: int) -> list[int]:
    """For every candidate, the first offset at or beyond ``end`` on its chain; -1 if the chain breaks."""
    out = dict()
    for s, n in zip(reversed(start), reversed(succ)):
        out[s] = n if n >= end else out.get(n, -1) if n > s else -1
    return [out[s] for s in start]


def read_warc(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(FIELDS, digest, bytes, payload) of every true record; payload only where it was cut by the magic, else null."""
    found = common.materialize(candidates(spark, path), "candidates")
    sums = found.groupBy("file", "split").agg(F.sum("size").alias("bytes"))
    # a file has few splits: its running sums are small
    order = Window.partitionBy("file").orderBy("split")
    bases = sums.withColumn("base", F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("last", F.lead("split").over(order).isNull())
    # a piece is preceded by its magic, which the piece before it was counted with
    inside = Window.partitionBy("file", "split").orderBy("nth")
    narrow = found.select("file", "split", "nth", "size", "next").join(bases, ["file", "split"])
    offset = F.col("base") - len(MAGIC) + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = narrow.withColumn("at", offset).withColumn("end", F.col("base") - len(MAGIC) + F.col("bytes"))
    placed = common.materialize(placed.where("at >= 0").select("file", "split", "nth", "at", "end", F.when(F.col("next") > 0, F.col("at") + F.col("next")).otherwise(-1).alias("succ")), "placed")

    def exits(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("at")
        return pd.DataFrame({"file": g.file, "at": g["at"], "jump": _exits(g["at"].tolist(), g.succ.tolist(), int(g.end.iloc[0]))})

    jumps = common.materialize(placed.groupBy("file", "split").applyInPandas(exits, "file string, at long, jump long"), "jumps")
    # only offsets at which some split is entered matter for the jumping
    entered = jumps.select("file", F.col("jump").alias("at")).where("at >= 0").distinct()
    hops = common.materialize(jumps.join(entered, ["file", "at"], "left_semi").unionByName(jumps.where("at = 0")).distinct(), "hops")
    reached = common.materialize(jumps.where("at = 0").select("file", "at").distinct(), "reached")
    while True:
        after = common.materialize(
            reached.unionByName(reached.join(hops, ["file", "at"]).where("jump >= 0").select("file", F.col("jump").alias("at"))).distinct(), "reached"
        )
        longer = hops.alias("a").join(hops.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.jump") == F.col("b.at"))).select("a.file", "a.at", F.col("b.jump").alias("jump")).where("jump >= 0")
        longer = common.materialize(longer, "hops")
        common.discard(spark, hops, reached)
        hops, reached = longer, after
        if hops.limit(1).count() == 0:
            break

    entries = common.materialize(reached.join(placed.select("file", "at", "split"), ["file", "at"]), "entries")

    def walk(g: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        """The records of a split, and to which record each later candidate belongs."""
        g = g.sort_values("at")
        succ = dict(zip(g["at"].tolist(), g.succ.tolist()))
        true = set()
        for at in sorted(start["at"].tolist()):
            while at in succ and at not in true:
                true.add(at)
                at = succ[at]
        return pd.DataFrame({"file": g.file, "split": g.split, "nth": g.nth, "at": g["at"], "succ": g.succ, "real": [a in true for a in g["at"].tolist()]})

    marked = placed.groupBy("file", "split").cogroup(entries.groupBy("file", "split")).applyInPandas(walk, "file string, split long, nth long, at long, succ long, real boolean")
    marked = common.materialize(marked, "marked")
    # every chain must end where its file does
    ends = placed.groupBy("file").agg(F.max("end").alias("end")).join(marked.where("real").groupBy("file").agg(F.max("succ").alias("upto")), "file", "left")
    broken_off = ends.where("not (end <=> upto)").limit(3).collect() if strict else []
    if broken_off:
        raise BrokenArchive(f"the chain of records ends before the file does: {broken_off}")
    kept = ["page_id", "type", "refers_to", "stated", "digest", "bytes"]
    whole = found.where("piece is null").join(marked.where("real").select("file", "split", "nth"), ["file", "split", "nth"]).select(*kept, F.lit(None).cast("binary").alias("payload"))

    # records that the magic cut: a broken piece, and all candidates up to the record's end
    broken = marked.where("real").join(found.where("piece is not null").select("file", "split", "nth"), ["file", "split", "nth"])
    pieces = found.where("piece is not null").select("file", "split", "nth", "piece")
    spans = broken.select("file", F.col("at").alias("start"), "succ")
    # parts are not real records themselves; the record they are in begins at the last real record before
    parts = marked.select("file", "split", "nth", "at", "real").join(spans.select("file").distinct(), "file", "left_semi")
    # the last one in the split, or in the splits before: a file has few splits
    carried = marked.where("real").groupBy("file", "split").agg(F.max("at").alias("last")).join(spans.select("file").distinct(), "file", "left_semi")
    carried = bases.select("file", "split").join(carried, ["file", "split"], "left").select("file", "split", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    last_real = F.max(F.when(F.col("real"), F.col("at"))).over(Window.partitionBy("file", "split").orderBy("at"))
    parts = parts.withColumn("here", last_real).join(carried, ["file", "split"]).withColumn("start", F.coalesce("here", "carried"))
    parts = parts.join(spans, ["file", "start"]).where("at < succ").select("file", "start", "succ", "at", "split", "nth")
    texts = parts.join(_piece_bytes(spark, path, pieces, parts), ["file", "split", "nth"])

    def join(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("at")
        data = MAGIC.join(g.piece.tolist())
        head, payload, fields = _header(data)
        if head < 0 or len(data) < head + payload or len(MAGIC) + head + payload + len(END) != int(g.succ.iloc[0] - g.start.iloc[0]):
            if strict:
                raise BrokenArchive(f"the pieces of a record do not make it up: {g.file.iloc[0]} at {g.start.iloc[0]}")
            rows = []
        else:
            body = data[head : head + payload]
            rows = [(*_fields(fields), hashlib.sha256(body).hexdigest(), payload, body)]
        columns = zip(*rows) if rows else [()] * 7
        return pd.DataFrame({c: pd.Series(list(x), dtype="Int64" if c in ("page_id", "refers_to", "bytes") else object) for c, x in zip([*kept, "payload"], columns)})

    cut = texts.groupBy("file", "start").applyInPandas(join, f"{FIELDS}, digest string, bytes long, payload binary")
    return whole.unionByName(cut)


def _piece_bytes(spark: SparkSession, path: str, pieces: DataFrame, parts: DataFrame) -> DataFrame:
    """The bytes of the parts; a part that looks like a record in itself was not kept and is read again."""
    lost = parts.join(pieces.select("file", "split", "nth"), ["file", "split", "nth"], "left_anti").select("file", "split", "nth")
    if lost.limit(1).count() == 0:
        return pieces
    raw = spark.read.option("lineSep", MAGIC.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("piece"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, nth = None, 0
        for batch in batches:
            out = []
            for file, split in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (file, split) != place:
                    place, nth = (file, split), 0
                out.append(nth)
                nth += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64()), batch.column(2)], ["file", "split", "nth", "piece"])

    again = raw.mapInArrow(number, "file string, split long, nth long, piece binary")
    return pieces.unionByName(again.join(lost, ["file", "split", "nth"], "left_semi"))


def report(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of what `read_warc` returns."""
    responses = records.where("type = 'response'")
    # the digest of a response is that of the bytes read; a mismatch with the header is an error of the archive
    checked = F.when(F.col("digest") == F.col("stated"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("payload digest differs from the header: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("without id")))))
    responses = responses.withColumn("digest", checked)
    revisits = records.where("type = 'revisit'").select("page_id", "type", "refers_to", F.col("stated").alias("digest"))
    asked = revisits.select(F.col("refers_to").alias("asked")).distinct()
    known = responses.join(asked, F.col("page_id") == F.col("asked"), "left_semi").select(F.col("page_id").alias("of"), F.col("digest").alias("same"), F.col("bytes"))
    known = known.groupBy("of", "same").agg(F.max("bytes").alias("bytes"))
    revisits = revisits.join(known, (F.col("refers_to") == F.col("of")) & (F.col("digest") == F.col("same")))
    columns = ["page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"]
    return responses.select(*columns).unionByName(revisits.select(*columns))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    path = common.scratch(spark, "warc")

    def run() -> DataFrame:
        write_warc(pages, path)
        return report(read_warc(spark, path))

    out = common.finished(spark, run)
    common.discard(spark, path)
    found, written = out.count(), pages.count()
    if found != written:
        raise BrokenArchive(f"{found} records were read back of {written}")
    return out


#: The same in SQL.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= {REVISIT_LEAST} GROUP BY h)
SELECT page_id, n AS payload_bytes, sha256(p.h) AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""

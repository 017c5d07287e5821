"""Turning payloads of several formats into records of text."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def detect_format(content: Column, name: Column | None = None, media_type: Column | None = None) -> Column:
    """The parser for a text payload: pdf, html, json, csv, markdown or plaintext."""
    head = F.substring(content, 1, 4096)
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)) if name is not None else F.lit("")
    media = F.lower(F.coalesce(media_type, F.lit(""))) if media_type is not None else F.lit("")
    trimmed = F.ltrim(content)
    first = F.split(content, "\n")
    commas = lambda line: F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
    table = (F.size(first) > 1) & (commas(F.element_at(first, 1)) > 0) & F.forall(F.slice(F.filter(first, lambda x: F.length(F.trim(x)) > 0), 1, 20), lambda x: commas(x) == commas(F.element_at(first, 1)))
    return (
        F.when(F.startswith(content, F.lit("%PDF-")), "pdf")
        .when(head.rlike(r"(?i)<html|<!doctype\s+html"), "html")
        .when(trimmed.rlike(r"^[\[{]") & F.try_parse_json(content).isNotNull(), "json")
        .when(table, "csv")
        .when(ext.isin("md", "markdown"), "markdown").when(ext.isin("htm", "html"), "html").when(ext.isin("json", "ndjson", "jsonl"), "json").when(ext == "csv", "csv").when(ext == "pdf", "pdf")
        .when(F.contains(media, F.lit("markdown")), "markdown").when(F.contains(media, F.lit("html")), "html").when(F.contains(media, F.lit("json")), "json").when(F.contains(media, F.lit("csv")), "csv")
        .otherwise("plaintext")
    )


def decoded(payload: Column) -> Column:
    """Bytes as UTF-8 text; what is no UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(payload.cast("string"))


# The marks of Markdown and what is left of them, in the order in which they go.
MARKDOWN_MARKS = (
    (r"(?m)^#{1,6}\s+", ""), (r"`([^`]*)`", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"),
    (r"!\[([^\]]*)\]\([^)]+\)", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?m)^\s*[-*+]\s+", ""),
)


def markdown_text(text: Column) -> Column:
    """Markdown without its marks."""
    for pattern, by in MARKDOWN_MARKS:
        text = F.regexp_replace(text, pattern, by)
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.trim(F.array_join(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), "\n"))


@F.pandas_udf(StringType())
def _references_decoded(text: pd.Series) -> pd.Series:
    return text.map(unescape, na_action="ignore")


CLOSED_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)")


@F.pandas_udf(StringType())
def _closed_references_decoded(text: pd.Series) -> pd.Series:
    def one(m: re.Match) -> str:
        return unescape(m[0]) if m[1][0] == "#" or m[1] in html5 else m[0]

    return text.map(lambda t: CLOSED_REFERENCE.sub(one, t), na_action="ignore")


def html_text(html: Column, closed: bool = False) -> Column:
    """The text of all nodes but scripts and styles, character references decoded, each trimmed, joined by a space.

    Browsers also decode some references without their semicolon (``&amp``); with
    ``closed`` these stay as they are written.
    """
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    decoded_references = _closed_references_decoded if closed else _references_decoded
    nodes = F.split(decoded_references(F.regexp_replace(bare, r"<[^>]*>", "\u0001")), "\u0001")
    trimmed = F.transform(nodes, lambda x: F.regexp_replace(x, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return F.array_join(F.filter(trimmed, lambda x: F.length(x) > 0), " ")


def row_text(df: DataFrame, columns: list[str]) -> Column:
    """``col: value | col: value`` of the columns that are not empty."""
    parts = [F.when(F.length(F.trim(F.col(c).cast("string"))) > 0, F.concat(F.lit(f"{c}: "), F.trim(F.col(c).cast("string")))) for c in columns]
    return F.concat_ws(" | ", *parts)


def ndjson_lines(docs: DataFrame, content: str) -> DataFrame:
    """One row per non-blank line, with its place."""
    keep = [c for c in docs.columns if c != content]
    return docs.select(*keep, F.posexplode(F.split(content, "\n")).alias("line", content)).where(F.length(F.trim(content)) > 0)


def flatten_json_text(content: Column) -> Column:
    """``path: value`` lines of one level of a JSON object, in the object's order."""
    entries = F.map_entries(F.from_json(content, "map<string,string>"))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))), "\n")


def flat_lines(value) -> str:
    """``path: value`` lines of a JSON value of any depth, in its order."""
    lines, todo = [], [("", value)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            children = [(f"{path}.{key}".lstrip("." if not path else ""), child) for key, child in value.items()]
        elif isinstance(value, list) and value:
            children = [(f"{path}[{i}]", child) for i, child in enumerate(value)]
        else:
            lines.append(f"{path}: {value}" if path else f"{value}")
            continue
        todo.extend(reversed(children))
    return "\n".join(lines)


def json_items(content: str) -> Iterator[tuple[str, int, int]]:
    """(text, start, end) of the records of a JSON payload, with their places in it.

    Records are the lines of a payload of several lines that all start with a brace, the
    items of a list, or the one value.
    """
    decoder = json.JSONDecoder()
    lines = [m for m in re.finditer(r"[^\n]*\S[^\n]*", content)]
    if len(lines) > 1 and all(m[0].lstrip().startswith("{") for m in lines):
        for m in lines:
            yield flat_lines(json.loads(m[0])), m.start(), m.start() + len(m[0].rstrip("\r"))
        return
    space = re.compile(r"\s*")
    at = space.match(content).end()
    if not content.startswith("[", at):
        value, end = decoder.raw_decode(content, at)
        if content[end:].strip():
            raise ValueError(f"more than one value, at {end}")
        yield flat_lines(value), at, end
        return
    at = space.match(content, at + 1).end()
    while not content.startswith("]", at):
        value, end = decoder.raw_decode(content, at)
        yield flat_lines(value), at, end
        at = space.match(content, end).end()
        if content.startswith(",", at):
            at = space.match(content, at + 1).end()
        elif not content.startswith("]", at):
            raise ValueError(f"a comma or the end of the list is missing, at {at}")
    if content[at + 1 :].strip():
        raise ValueError(f"more after the list, at {at + 1}")


def csv_items(content: str) -> Iterator[tuple[str, int, int, int]]:
    """(text, start, end, row number) of the rows of a CSV payload; the header is row 1, places are those of physical lines."""
    ends = [m.end() for m in re.finditer(r"[^\n]*(?:\n|$)", content)]
    reader = csv.DictReader(io.StringIO(content, newline=""))
    for row in reader:
        cells = ((name, row[name]) for name in reader.fieldnames or () if row[name] and row[name].strip())
        text = " | ".join(f"{name.strip()}: {value.strip()}" for name, value in cells)
        last = min(reader.line_num, len(ends))
        if text:
            start = ends[last - 2] if last > 1 else 0
            yield text, start, start + len(content[start : ends[last - 1]].rstrip("\r\n")), reader.line_num


def parse_documents(docs: DataFrame) -> DataFrame:
    """(source_id, ordinal, parser, text, row_number, start, end, error) of (source_id, name, media_type, content).

    A column parser_name, where it is not null, forces the parser.  start and end say
    where a record stands in its payload, null where the text is made anew.  A payload that
    its parser cannot read gives one row with ``error``, and its rows before the error.
    """
    if dict(docs.dtypes)["content"] == "binary":
        docs = docs.withColumn("content", decoded(F.col("content")))
    parser = detect_format(F.col("content"), F.col("name"), F.col("media_type"))
    if "parser_name" in docs.columns:
        parser = F.coalesce("parser_name", parser)
    typed = docs.withColumn("parser", parser)

    def blobs(batches):
        for pdf in batches:
            out = []
            for source, kind, content in zip(pdf.source_id, pdf.parser, pdf.content):
                n = 0
                try:
                    for text, start, end, *number in csv_items(content) if kind == "csv" else json_items(content):
                        out.append((source, n, kind, text, number[0] if number else None, start, end, None))
                        n += 1
                except (ValueError, csv.Error, RecursionError) as e:
                    out.append((source, n, kind, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["source_id", "ordinal", "parser", "text", "row_number", "start", "end", "error"]).astype({"row_number": "Int64", "start": "Int64", "end": "Int64"})

    schema = "source_id string, ordinal long, parser string, text string, row_number long, start long, end long, error string"
    blob = typed.where(F.col("parser").isin("json", "csv") & F.col("content").isNotNull()).select("source_id", "parser", "content").mapInPandas(blobs, schema)
    text = F.when(F.col("parser") == "markdown", markdown_text(F.col("content"))).when(F.col("parser") == "html", html_text(F.col("content"))).otherwise(F.col("content"))
    as_is = F.col("parser") == "plaintext"
    plain = typed.where(~F.col("parser").isin("json", "csv")).select(
        "source_id", F.lit(0).cast("long").alias("ordinal"), "parser", text.alias("text"), F.lit(None).cast("long").alias("row_number"),
        F.when(as_is, F.lit(0)).cast("long").alias("start"), F.when(as_is, F.length("content")).cast("long").alias("end"), F.lit(None).cast("string").alias("error"),
    )
    return plain.unionByName(blob).where((F.length(F.trim("text")) > 0) | F.col("error").isNotNull())


SECRET = "token|secret|password|key|credential"


def without_secrets(metadata: Column) -> Column:
    """A map without the entries whose key names a secret."""
    return F.map_filter(metadata, lambda k, v: ~F.lower(k).rlike(SECRET))


@F.pandas_udf(StringType())
def json_without_secrets(metadata: pd.Series) -> pd.Series:
    """JSON without the entries, at any depth, whose key names a secret; what is no JSON becomes null."""
    secret = re.compile(SECRET, re.I)

    def clean(value):
        if isinstance(value, dict):
            return {k: clean(v) for k, v in value.items() if not secret.search(k)}
        return [clean(v) for v in value] if isinstance(value, list) else value

    def one(text):
        try:
            return json.dumps(clean(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return metadata.map(one, na_action="ignore")

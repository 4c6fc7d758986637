"""WARC derivatives: each response becomes a metadata record and a plain-text conversion record that refer to it.

A response row has record_id, target_uri, date, http_header and payload. Both derivatives name its record in
WARC-Refers-To (with its uri and date), carry digests of their own block and of the response's payload, and the metadata
record keeps the response's HTTP header lines, title, language and outlinks. Record ids are derived from the response's
id and the kind of record, so a task that runs twice writes the same records.

The conversion is one pass without a shuffle; `write_warc` writes each partition as a WARC file of text records.

Defined results: a null payload is an empty one; a null uri, date or record id leaves out the headers that would carry
it, and records without a source id are named by uri, date and payload digest; line breaks in a uri are percent-encoded;
payloads are taken whole; repeated rows give repeated records; extra columns listed in `keep` are carried to both records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiloom.llm.common import documents, in_batches, slices
from apiloom.llm.html_dom import Tree, attributes, block_text, parse

CRLF = "\r\n"
_FIELDS = ["record_type", "record_id", "refers_to", "content_type", "block_digest", "payload_digest", "content_length", "headers", "block"]


def digest(data: bytes) -> str:
    """A labelled digest as WARC files carry it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {source}')}>"


def plain_text(tree: Tree) -> str:
    """All visible text of a page, one block a line."""
    return "\n".join(t for _, pieces in tree.blocks if (t := block_text(pieces)))


def metadata_fields(page: str, http_header: str, payload_digest: str, tree: Tree | None = None) -> list[tuple[str, str]]:
    """What the metadata record says of a response, as ordered (name, value) lines. Language and outlinks come from the
    elements of the page: what stands in scripts, comments or templates is no element."""
    tree = tree or parse(page)
    title = next((block_text(p) for node, p in tree.blocks if tree.tags[node] == "title"), "")
    head = tree.attributes[tree.tags.index("html")] if "html" in tree.tags else ""
    fields = [("payload-digest", payload_digest), ("payload-length", str(len(page.encode("utf-8", "surrogatepass"))))]
    fields += [("http-status" if i == 0 else "http-header", line) for i, line in enumerate(http_header.strip().splitlines()) if line]
    if title:
        fields.append(("title", title))
    if lang := attributes(head).get("lang"):
        fields.append(("language", lang))
    for inside in tree.anchors:
        if href := attributes(inside).get("href"):
            fields.append(("outlink", " ".join(href.split())))
    return fields


def derivatives(record_id: str | None, uri: str | None, date: str | None, http_header: str, page: str) -> list[tuple]:
    """The two records of one response, each in the order of _FIELDS."""
    source_digest = digest(page.encode("utf-8", "surrogatepass"))
    named = record_id if record_id is not None else f"{uri} {date} {source_digest}"
    target = uri.replace("\r", "%0D").replace("\n", "%0A") if uri is not None else None
    tree = parse(page)
    fields = metadata_fields(page, http_header, source_digest, tree)
    blocks = [
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}{CRLF}" for k, v in fields)),
        ("conversion", "text/plain; charset=utf-8", plain_text(tree)),
    ]
    out = []
    for kind, content_type, block in blocks:
        data = block.encode("utf-8", "surrogatepass")
        own = derived_id(named, kind)
        lines = [
            ("WARC-Type", kind),
            ("WARC-Target-URI", target),
            ("WARC-Date", date),
            ("WARC-Record-ID", own),
            ("WARC-Refers-To", record_id),
            ("WARC-Refers-To-Target-URI", target),
            ("WARC-Refers-To-Date", date),
            ("WARC-Block-Digest", digest(data)),
            ("WARC-Payload-Digest", source_digest),
            ("Content-Type", content_type),
            ("Content-Length", str(len(data))),
        ]
        headers = "WARC/1.1" + CRLF + "".join(f"{k}: {v}{CRLF}" for k, v in lines if v is not None)
        out.append((kind, own, record_id, content_type, digest(data), source_digest, len(data), headers, block))
    return out


def build_derivatives(responses: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """Two rows for each response: `keep` columns, target_uri, then the fields of the record and its block."""
    keep = list(keep or [])
    rows = responses.select(
        *keep, "target_uri", "record_id", F.col("date").cast("string").alias("__date"), F.coalesce("http_header", F.lit("")).alias("__http"), F.coalesce("payload", F.lit("")).alias("__page")
    )
    kept = [f for f in rows.schema if f.name in keep]
    kinds = [pa.int64() if f == "content_length" else pa.string() for f in _FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__page"):
            get = lambda name: batch.column(name).to_pylist()  # noqa: B023, E731
            made = [x for r in zip(get("record_id"), get("target_uri"), get("__date"), get("__http"), get("__page"), strict=True) for x in derivatives(*r)]
            twice = pa.array([i for i in range(batch.num_rows) for _ in (0, 1)])
            columns = [batch.column(f.name).take(twice) for f in kept] + [batch.column("target_uri").take(twice)]
            columns += [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["target_uri", *_FIELDS])

    declared = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["target_uri string"]
    declared += [f"{f} {'long' if f == 'content_length' else 'string'}" for f in _FIELDS]
    return in_batches(rows, run, ", ".join(declared))


def write_warc(records: DataFrame, path: str) -> None:
    """Write derivative records as WARC text files, one for each partition."""
    record = F.concat("headers", F.lit(CRLF), "block")
    records.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).text(path)


def responses_of_pages(pages: DataFrame, *, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response rows of a table of pages: its ids are name-based, its HTTP header states type and length."""
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n"))
    name = F.sha1(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))))
    part = lambda a, n: F.substring(name, a, n)
    record_id = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.lit("8"), part(18, 3)), part(21, 12)), F.lit(">"))
    return pages.select("page_id", record_id.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), header.alias("http_header"), F.col("html").alias("payload"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return build_derivatives(responses_of_pages(documents(spark, sf_dir, "pages")), keep=["page_id"])

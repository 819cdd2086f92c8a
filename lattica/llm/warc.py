"""WARC archives: written as text records, read back by verified boundary chains.

A file is cut at every ``WARC/``; each piece is a candidate record that names, by its own
headers, the offset where its successor must start.  Per file, pointer jumping from offset
0 keeps the candidates that the chain reaches, so magic inside payloads never starts a
record.  Payloads stay where they were read: only pieces of a record that was cut are
put together.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm import common as C

MAGIC = "WARC/"
END = "\r\n\r\n"
LEAST_BYTES = 100
"""Smaller payloads are always stored whole."""


def _clean(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def archive(pages: DataFrame, least: int = LEAST_BYTES, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id",
            url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(value): one WARC/1.1 record per row, without the closing empty lines.

    Of equal payloads of at least ``least`` bytes the rows with the smallest id are
    responses and the others revisit it; a null id comes after all others.  Null
    payloads are empty; a null address has no header.
    """
    src = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("body"))
    src = src.withColumn("size", F.octet_length("body")).withColumn("digest", F.sha2("body", 256))
    firsts = src.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = src.join(firsts, "digest", "left")  # a crowded digest is a skewed key that adaptive execution splits
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, F.col("body")))
    length = F.octet_length(http) + F.when(again, 0).otherwise(F.col("size"))
    line = lambda key, c: F.concat(F.lit(f"{key}: "), c, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("id"))), F.coalesce(line("WARC-Target-URI", _clean(F.col("url"))), F.lit("")),
        line("WARC-Date", F.lit(date)), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", name(F.col("first"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")), F.lit("\r\n"))
    return joined.select(F.concat(head, block).alias("value"))


def write_archives(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Files of records, each followed by two empty lines; one compressed stream per file."""
    records.write.option("lineSep", END).option("compression", compression).text(path)


HEAD = re.compile(rb"1\.[01]\r\n")
FIELDS = {"type": b"warc-type", "record_id": b"warc-record-id", "uri": b"warc-target-uri", "refers_to": b"warc-refers-to",
          "stated_digest": b"warc-payload-digest"}
DESCRIBED = "type string, record_id string, uri string, refers_to string, stated_digest string, http_length bigint, payload_bytes bigint, payload_digest string"


def _headers(block: bytes) -> dict[bytes, bytes]:
    pairs = (x.partition(b":") for x in block.split(b"\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, colon, v in pairs if colon}


def _number(raw: bytes | None) -> int | None:
    return int(raw) if raw is not None and raw.isdigit() and len(raw) < 19 else None


def span_of(piece: bytes) -> int | None:
    """Bytes from after the magic to the record's end, as its headers say; None if it is no record."""
    if not HEAD.match(piece):
        return None
    head, end, _ = piece.partition(END.encode())
    n = _number(_headers(head).get(b"content-length")) if end else None
    return None if n is None else len(head) + n + 2 * len(END)


def describe(piece: bytes) -> dict:
    """Fields of a record given from after its magic; the payload is what follows the HTTP header, if any."""
    head, _, rest = piece.partition(END.encode())
    h = _headers(head)
    block = rest[:_number(h.get(b"content-length")) or 0]
    http_length, body = None, block
    if h.get(b"content-type", b"").lower().startswith(b"application/http"):
        http, _, body = block.partition(END.encode())
        http_length = _number(_headers(http).get(b"content-length"))
    text = {k: h[v].decode("utf-8", "replace") if v in h else None for k, v in FIELDS.items()}
    return text | {"http_length": http_length, "payload_bytes": len(body), "payload_digest": hashlib.sha256(body).hexdigest()}


def _fields_of(rows: list[dict]) -> dict[str, pa.Array]:
    kinds = {n: pa.int64() if t == "bigint" else pa.string() for n, t in (x.split() for x in DESCRIBED.split(", "))}
    return {k: pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()}


def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Describe each piece and drop the bytes of those that are a whole record for sure.

    Within a split the chain is followed as far as it is known.  Pieces of a cut record, pieces
    after a break and all pieces of a later split, which may begin inside a payload, keep their bytes.
    """
    at, sure, open_left = None, False, 0
    for b in batches:
        spans, rows, kept = [], [], []
        for file, split, piece in zip(b.column("file").to_pylist(), b.column("split").to_pylist(), b.column("value").to_pylist()):
            first = at != (file, split)
            if first:
                at, sure, open_left = (file, split), split == 0, 0
            span = span_of(piece)
            loose = True
            if first and sure:
                loose, sure = False, not piece  # what precedes the first magic
            elif open_left:
                open_left -= len(piece) + len(MAGIC)
                sure, open_left = sure and open_left >= 0, max(open_left, 0)
            elif sure and span == len(piece):
                loose = False
            elif sure and span is not None and span > len(piece):
                open_left = span - len(piece)
            else:
                sure = False
            spans.append(span)
            rows.append(describe(piece) if span == len(piece) else {})
            kept.append(piece if loose else None)
        yield pa.record_batch({"file": b.column("file"), "split": b.column("split"), "mid": b.column("mid"), "size": b.column("size"),
                               "span": pa.array(spans, pa.int64()), "value": pa.array(kept, pa.binary()), **_fields_of(rows)})


def rejoin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Describe records put together from their pieces."""
    for b in batches:
        rows = [describe(MAGIC.encode().join(p["value"] for p in ps)) for ps in b.column("pieces").to_pylist()]
        yield pa.record_batch({"file": b.column("file"), "off": b.column("off"), **_fields_of(rows)})


def reachable(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one file's candidates: those on the chain of successors from offset 0."""
    off = np.sort(pdf["off"].to_numpy())
    succ = pdf.sort_values("off")["succ"].to_numpy()
    n = len(off)
    at = np.minimum(np.searchsorted(off, succ), n - 1)
    jump = np.r_[np.where(off[at] == succ, at, n), n]  # n: the end, or a broken chain
    seen = np.zeros(n + 1, bool)
    seen[0] = n > 0 and off[0] == 0
    while True:  # each round doubles how far jumps go and how much of the chain is seen
        more = seen.copy()
        more[jump[seen]] = True
        jump = jump[jump]
        if (more == seen).all() and (jump[seen] == n).all():
            break
        seen = more
    hit = seen[:n]
    return pd.DataFrame({"file": pdf["file"].iloc[0], "off": off[hit], "end": succ[hit]})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per reachable record of the WARC files below ``path``.

    (file, off, type, record_id, uri, refers_to, stated_digest, http_length, payload_bytes, payload_digest,
    intact).  Payload columns describe the bytes stored in the record; ``intact`` says whether a
    response's bytes match its stated digest.  Empty files give no rows; what follows a broken
    chain is not reached.
    """
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("mid"), F.octet_length("value").cast("bigint").alias("size"), F.col("value").cast("binary").alias("value"))
    seen = raw.mapInArrow(trim, f"file string, split bigint, mid bigint, size bigint, span bigint, value binary, {DESCRIBED}")
    # offsets: pieces before in the split, and splits before in the file
    sums = seen.groupBy("file", "split").agg(F.sum(F.col("size") + len(MAGIC)).alias("total"))
    base = sums.select("file", "split", F.coalesce(F.sum("total").over(
        Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "split").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    placed = seen.withColumn("in", F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(inside), F.lit(0))).join(base, ["file", "split"]).withColumn(
        "off", F.col("base") + F.col("in") - len(MAGIC))  # of the magic that the piece follows
    placed = C.settle(placed.where("off >= 0").drop("base", "in", "split", "mid"))
    links = placed.where(F.col("span").isNotNull()).select("file", "off", (F.col("off") + len(MAGIC) + F.col("span")).alias("succ"))
    chain = links.groupBy("file").applyInPandas(reachable, "file string, off bigint, end bigint")
    fields = [x.split()[0] for x in DESCRIBED.split(", ")]
    own = placed.where("span = size").join(chain, ["file", "off"]).select("file", "off", *fields)
    # records that a magic in their payload has cut: their pieces, in order, are the text again
    starts = placed.where("value is not null").select("file", "off", "value", (F.col("span") == F.col("size")).alias("whole")).join(
        chain, ["file", "off"], "left").withColumn("first", F.when(F.col("end").isNotNull(), F.struct(F.col("off").alias("start"), "end", "whole")))
    at = starts.withColumn("first", F.last("first", ignorenulls=True).over(Window.partitionBy("file").orderBy("off"))).where(
        "not coalesce(first.whole, true) and off < first.end")
    pieces = at.groupBy("file", F.col("first.start").alias("off")).agg(F.array_sort(F.collect_list(F.struct(F.col("off").alias("at"), "value"))).alias("pieces"))
    both = own.unionByName(pieces.mapInArrow(rejoin, f"file string, off bigint, {DESCRIBED}"))
    return both.withColumn("intact", (F.col("type") != "response") | F.col("stated_digest").eqNullSafe(F.concat(F.lit("sha256:"), F.col("payload_digest"))))


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")


def round_trip(pages: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write the pages as archives in the shared folder and read every record back.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, intact); size and digest of a
    revisit are those its headers state for the full payload.
    """
    spark = pages.sparkSession
    path = path or f"{C.checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(archive(pages, **how), path)
    got = read_archives(spark, path)
    again = F.col("type") == "revisit"
    return got.select(
        page_of(F.col("record_id")).alias("page_id"), F.when(again, F.col("http_length")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.substring_index("stated_digest", ":", -1)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(again, page_of(F.col("refers_to"))).alias("refers_to"), "intact")

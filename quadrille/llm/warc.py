"""WARC archives: writing captures, reading records back, and assembling transactions.

Each page becomes three records that name each other through WARC-Concurrent-To: a request, a
response (or a revisit of the response with the same payload) and a metadata record. Which pages revisit
is settled on slim rows, so payloads go from the scan into the files unless the digests that pages share are too many to
broadcast. Spark's own writer makes the files (records end in CRLF CRLF, which is the writer's line separator),
so attempts of lost executors leave nothing behind, and any store that Spark writes will do; an archive is one gzip member.

Reading streams archives (gzip of one or many members) as the pieces between CRLF CRLF and puts
records together by their stated length, so no archive is held whole. Plain archives (*.warc) are read a file at a time.

Assembly: records are linked by concurrent-to in whatever direction they name each other, and each connected
group is one capture, one nested row. Where all records name the one that names none, the group is that one's
identifier; other archives take connected components. Revisits then take payload facts from the response they refer to.

Defined results: null payload counts as empty; of equal payloads of at least `revisit_from` bytes
the largest page_id responds, ties of repeated rows respond too; null urls are
written as an empty target; a null page_id responds and stays null; records without a partner form a capture
of their own; warcinfo records are in no capture; a record without a valid length, and one that its file
cuts short, is left out up to the next that starts with a version line; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, frugal, if_small, new_path, ship, stored
from .jaccard import components

#: Shared digests that may be broadcast; beyond it pages are joined with them.
BROADCAST_DIGESTS = 500_000
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's UTF-8 bytes: four groups of 40 bits in base 32."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _id(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.lit(kind), *[p.cast("string") for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column | str, record_id: Column, uri: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    named = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri), *fields]
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in named]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, size), F.lit(END), block)


def numbered(rows: DataFrame) -> DataFrame:
    """rows(page_id, digest, ...) with `copy`: 0, but different numbers for rows of one page_id and digest, the least 0."""
    again = checkpoint(rows.groupBy("page_id").count().filter("count > 1").select(F.col("page_id").alias("their_id")))
    if again.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    same = F.col("page_id").eqNullSafe(F.col("their_id"))
    again = if_small(again)
    once = rows.join(again, same, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    # numbers are stored with the rows before they are read twice; no group is brought together
    more = stored(rows.join(again, same, "left_semi").withColumn("number", F.monotonically_increasing_id()), "repeated")
    least = more.groupBy(F.col("page_id").alias("their_id"), F.col("digest").alias("their_digest")).agg(F.min("number").alias("least"))
    more = more.join(if_small(least), same & (F.col("digest") == F.col("their_digest"))).withColumn("copy", F.col("number") - F.col("least"))
    return once.unionByName(more.select(once.columns))


def write_archives(pages: DataFrame, path: str, revisit_from: int = 0) -> None:
    """Write pages(page_id, url, html) as gzipped WARC files under path."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    shared = checkpoint(
        rows.filter(F.col("size") >= revisit_from).groupBy("digest")
        .agg(F.min("page_id").alias("least"), F.max("page_id").alias("first_id")).filter("least < first_id").select("digest", "first_id")
    )
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_DIGESTS else shared
    rows = numbered(rows).join(shared, "digest", "left").withColumn("first_id", F.coalesce("first_id", "page_id"))
    revisits = F.col("page_id") != F.col("first_id")
    own = _id("response", F.col("page_id"), F.col("digest"), F.col("copy"))
    source = _id("response", F.col("first_id"), F.col("digest"), F.lit(0))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    uri = F.regexp_replace("url", "[\\x00-\\x20]", "%20")
    answer = _record(
        F.when(revisits, "revisit").otherwise("response"), own, uri,
        [
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisits, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(revisits, source)),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.when(revisits, http).otherwise(F.concat(http, F.col("payload"))),
    )
    partner = [("WARC-Concurrent-To", own)]
    request = _record(
        "request", _id("request", F.col("page_id"), F.col("digest"), F.col("copy")), uri,
        [*partner, ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET / HTTP/1.1\r\nAccept: text/html"), F.lit(END)),
    )
    facts = _record(
        "metadata", _id("metadata", F.col("page_id"), F.col("digest"), F.col("copy")), uri,
        [*partner, ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")),
    )
    records = rows.select(F.explode(F.array(request, answer, facts)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 30_000).text(path)


class Assembler:
    """Records out of the pieces between CRLF CRLF, fed one after another."""

    def __init__(self) -> None:
        self.fields: dict[str, list[str]] | None = None
        self.size = self.have = 0
        self.parts: list[bytes] = []

    def feed(self, piece: bytes) -> tuple[dict[str, list[str]], bytes] | None:
        """The record that this piece completes."""
        if self.fields is None:
            text = piece.lstrip(b"\r\n")
            if not text.startswith(b"WARC/"):
                return None
            fields: dict[str, list[str]] = {}
            for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
                key, _, value = line.partition(":")
                fields.setdefault(key.strip().lower(), []).append(value.strip())
            size = fields.get("content-length", [""])[0]
            if size.isascii() and size.isdigit():
                self.fields, self.size, self.have, self.parts = fields, int(size), 0, []
            return None
        self.parts += [piece, END.encode()]
        self.have += len(piece) + len(END)
        need = self.size + len(END)
        if self.have < need:
            return None
        fields, self.fields, found = self.fields, None, b"".join(self.parts)
        if self.have > need:  # the block ended in line ends that were taken for the separator; the next head came with it
            self.feed(found[need : -len(END)])
        return fields, found[: need - len(END)]


def pieces(content: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(content):
        end = content.find(END.encode(), at)
        end = len(content) if end < 0 else end
        yield content[at:end]
        at = end + len(END)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


RECORD = "kind string, record_id string, partners array<string>, refers_to string, uri string, date string, digest string, payload_bytes long, payload_digest string, block binary"
_KINDS = {"payload_bytes": pa.int64(), "partners": pa.list_(pa.string()), "block": pa.binary()}


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row a record of the archives under path. block: a response's payload (if asked for), the other records' blocks."""
    ship(spark)
    names = [c.split()[0] for c in RECORD.split(", ")]

    def row(f: dict[str, list[str]], block: bytes) -> tuple:
        kind = f.get("warc-type", [None])[0]
        size = said = None
        if kind == "response":
            block = block.partition(END.encode())[2]
            size, said = len(block), digest_of(block)
            block = block if with_payload else None
        first = lambda k: f.get("warc-" + k, [None])[0]
        partners = sorted(set(f.get("warc-concurrent-to", [])))
        return kind, first("record-id"), partners, first("refers-to"), first("target-uri"), first("date"), first("payload-digest"), size, said, block

    def sent(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, _KINDS.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

        for r in found:
            rows.append(r)
            held += 200 + len(r[-1] or b"")
            if held > 1 << 21:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            file, assembler = None, Assembler()
            for batch in batches:
                for name, piece in zip(batch.column(0), batch.column(1), strict=True):
                    name = name.as_py()
                    if name != file:
                        file, assembler = name, Assembler()
                    if record := assembler.feed(piece.as_py()):
                        yield row(*record)

        return sent(found())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for batch in batches:
                for content in batch.column(0):
                    assembler = Assembler()
                    for piece in pieces(content.as_py()):
                        if record := assembler.feed(piece):
                            yield row(*record)

        return sent(found())

    gzipped = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path).select(F.col("_metadata.file_path"), F.col("value").cast("binary"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(path).select("content")
    return gzipped.mapInArrow(frugal(streamed), RECORD).unionByName(plain.mapInArrow(frugal(whole), RECORD))


def assemble(records: DataFrame) -> DataFrame:
    """One row a capture: capture_id and the nested requests, responses (revisits and resources too), metadata
    and other records, each in the order of their identifiers. records are read several times: store them first."""
    records = records.filter("kind is null or kind <> 'warcinfo'")
    named = records.select("record_id", F.explode("partners").alias("partner")).distinct()
    middle = named.join(named.select(F.col("partner").alias("record_id")).distinct(), "record_id", "left_semi")
    if records.filter(F.size("partners") > 1).isEmpty() and middle.isEmpty():
        grouped = records.withColumn("capture_id", F.coalesce(F.try_element_at("partners", F.lit(1)), "record_id"))
    else:
        root = components(named.select(F.col("record_id").alias("x"), F.col("partner").alias("y")))
        grouped = records.join(root, F.col("record_id") == F.col("node"), "left").withColumn("capture_id", F.coalesce("root", "record_id"))
    record = F.struct("record_id", *[c.split()[0] for c in RECORD.split(", ") if not c.startswith("record_id")])
    answers = ("response", "revisit", "resource")
    part = lambda test: F.array_sort(F.collect_list(F.when(test, record)))
    kind = F.coalesce("kind", F.lit(""))
    return grouped.groupBy("capture_id").agg(
        part(kind == "request").alias("requests"), part(kind.isin(*answers)).alias("responses"), part(kind == "metadata").alias("metadata"),
        part(~kind.isin("request", "metadata", *answers)).alias("others"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives, read them back, assemble captures and resolve revisits."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    captures = assemble(stored(read_records(spark, path, with_payload=False), "records", "zstd"))
    response, facts = F.col("responses")[0], F.col("metadata")[0]
    flat = captures.select(
        F.regexp_extract(facts["block"].cast("string"), "page-id: (-?[0-9]+)", 1).try_cast("long").alias("page_id"), response["record_id"].alias("record_id"), response["kind"].alias("record_type"),
        response["refers_to"].alias("source"), response["payload_bytes"].alias("bytes"), response["payload_digest"].alias("digest"),
    )
    flat = checkpoint(flat)  # slim rows; from here the join may split a response that many revisits share
    whole = flat.filter("record_type = 'response'").select(F.col("record_id").alias("source"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("their_bytes"), F.col("digest").alias("their_digest"))
    return flat.join(whole, "source", "left").select(
        "page_id", F.coalesce("bytes", "their_bytes").alias("payload_bytes"), F.coalesce("digest", "their_digest").alias("payload_digest"), "record_type", "refers_to"
    )

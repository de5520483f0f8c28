"""WARC archives whose repeated payloads are revisit records.

Only headers are shuffled by payload digest: the first capture of each digest is found by
aggregation, and the captures that repeat it are joined to it. Every record is then written with
fresh headers, a repeat as a revisit record without its payload. Spark's text sink writes the records
one after the other, gzipped, so the archives are plain WARC files in any file system Spark
reaches. Payloads are bytes throughout; the sink does not interpret them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from specgrade.session import materialise

# A capture with a shorter payload is always stored whole.
LEAST_BYTES = 100
MAX_RECORDS_PER_FILE = 20_000
READ_SCHEMA = (
    "record_id string, record_type string, target_uri string, record_key string, payload_digest string, payload_bytes long, "
    "refers_to string, payload_ok boolean"
)


def resolve(captures: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Add record_type ('response' or 'revisit') and refers_to to captures.

    ``captures`` has record_key (orderable), payload_digest and payload_bytes. Of the captures with
    equal digests of at least ``least_bytes``, those with the smallest key are responses; the others
    revisit it. A null key is larger than any other. Captures that repeat a key and a payload
    have one type. Other columns stay.
    """
    large = captures.where(F.col("payload_bytes") >= least_bytes)
    firsts = materialise(
        large.groupBy("payload_digest").agg(F.min("record_key").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null").drop("_n"),
        "firsts",
    )
    repeats = (F.col("payload_bytes") >= least_bytes) & F.col("_first").isNotNull() & ~F.col("record_key").eqNullSafe(F.col("_first"))
    return captures.join(firsts, "payload_digest", "left").select(
        *captures.columns, F.when(repeats, "revisit").otherwise("response").alias("record_type"), F.when(repeats, F.col("_first")).alias("refers_to")
    )


def _one_line(value) -> F.Column:
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\r\n]+", " ")


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One WARC record for each page, as bytes in the column ``record``; without its final line end.

    Null payloads are empty. Null urls are empty targets; line breaks in a url become spaces.
    The record key is kept in the field X-Record-Key (absent if null). Pages that repeat a row are
    records of their own.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary"))
    named = pages.select(F.col(f"`{key}`").alias("record_key"), F.col(f"`{url}`").alias("url"), body.alias("body"))
    sized = named.select("record_key", "url", "body", F.sha2("body", 256).alias("payload_digest"), F.octet_length("body").cast("long").alias("payload_bytes"))
    kinds = resolve(sized.select("record_key", "payload_digest", "payload_bytes")).where("record_type = 'revisit'").select("record_key", "payload_digest", "refers_to")
    # Only the keys of revisits meet the payloads again.
    revisits = materialise(kinds.distinct(), "revisits").withColumnsRenamed({"record_key": "_key", "payload_digest": "_digest"})
    joined = sized.join(revisits, sized["record_key"].eqNullSafe(F.col("_key")) & (sized["payload_digest"] == F.col("_digest")), "left")
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n")
    )
    identity = lambda k: F.concat(F.lit("<urn:x-capture:"), F.coalesce(_one_line(k), F.lit("")), F.lit(":"), F.substring("payload_digest", 1, 32), F.lit(">"))
    length = F.length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", identity(F.col("record_key"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", _one_line(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(F.col("record_key").isNull(), "").otherwise(line("X-Record-Key", _one_line(F.col("record_key")))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                line("WARC-Refers-To", identity(F.col("refers_to"))), line("X-Refers-To-Key", _one_line(F.col("refers_to"))),
            ),
        ).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length.cast("string")), F.lit("\r\n"), http,
    )
    block = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("body"))
    return joined.select(F.concat(head.cast("binary"), block, F.lit("\r\n").cast("binary")).alias("record"))


def write(recorded: DataFrame, path: str) -> None:
    """Write the records as gzipped archives below ``path``."""
    recorded.select(F.col("record").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", MAX_RECORDS_PER_FILE
    ).text(path)


class _Stream:
    """Bytes of a gzipped archive, inflated as they are needed."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.ready, self.inflate = data, 0, bytearray(), zlib.decompressobj(31)

    def _more(self) -> bool:
        while self.at < len(self.data):
            chunk = self.data[self.at : self.at + 65536]
            self.at += len(chunk)
            self.ready += self.inflate.decompress(chunk)
            if self.inflate.eof:  # the next member
                self.at -= len(self.inflate.unused_data)
                self.inflate = zlib.decompressobj(31)
            if chunk:
                return True
        return False

    def until(self, end: bytes) -> bytes | None:
        start = 0
        while (i := self.ready.find(end, start)) < 0:
            start = max(0, len(self.ready) - len(end))
            if not self._more():
                return None
        out = bytes(self.ready[:i])
        del self.ready[: i + len(end)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self._more():
                raise ValueError("archive ends inside a record")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a gzipped archive: fields by lower-case name, and the block."""
    stream = _Stream(data)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield fields, stream.take(int(fields["content-length"]))
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``: headers, and what the payload shows.

    Size and digest of a response come from its payload; payload_ok tells whether its header agrees. A
    revisit has the size of the full payload from its HTTP header, and the digest from its own.
    One archive is in memory at a time; ``write`` bounds its records.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out = []
                for fields, block in parse(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    told = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    response = fields["warc-type"] == "response"
                    sizes = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    digest = hashlib.sha256(payload).hexdigest() if response else told
                    out.append(
                        (
                            fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"), fields.get("x-record-key"), digest,
                            len(payload) if response else int(sizes[0]) if sizes else None, fields.get("x-refers-to-key"), digest == told,
                        )
                    )
                names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
                kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(rows, READ_SCHEMA)

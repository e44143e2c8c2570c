"""WARC archives as chunked record tables.

A record's payload is cut into rows (record id, chunk number) of bounded size, and
written and read as a stream of such rows: longer payloads become a first segment
and ``continuation`` records. SHA-1 digests are carried from chunk to chunk, so no
second copy of a whole payload is ever built. Archives are gzipped WARC/1.1 files
that Spark's own readers and writers produce, on any file system that Spark knows:
every row of the text writer is one record, and the line separator is the CRLF CRLF
that ends a record.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.rows import Columns, map_rows
from quern.llm.skew import common_keys, dealt_join
from quern.storage import Scratch

#: Code points of a chunk.
CHUNK_CHARS = 1 << 18
DATE = "2024-01-01T00:00:00Z"
_CHUNKED = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "parts", "chunk", "part")
#: Payloads of at least this many bytes are stored once.
LEAST_BYTES = 1000
#: Up to so many payloads that have copies, their digests are broadcast.
BROADCAST_COPIES = 100_000
END = "\r\n\r\n"


def payload_columns(html: Column) -> list[Column]:
    payload = F.coalesce(html, F.lit(""))
    return [payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest")]


def plan_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Of rows with equal payloads of ``least_bytes`` or more, those with the largest
    page_id are responses and the others revisit it. Null page_ids come before all
    others; a null html is an empty payload. Columns besides page_id, url and html are
    not used; repeated rows stay; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", *payload_columns(F.col("html")))
    first = (
        rows.select("page_id", "payload_bytes", "payload_digest")
        .where(F.col("payload_bytes") >= least_bytes)
        .groupBy(F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
        .agg(F.max("page_id").alias("_keeper"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    first = scratch.save(first, "copies")
    counts = first.select(F.col("_digest").alias("payload_digest"), F.col("_bytes").alias("payload_bytes"), "_n")
    total = first.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    common = common_keys(counts, ["payload_digest", "payload_bytes"], "_n", total)
    on = [("payload_digest", "_digest"), ("payload_bytes", "_bytes")]
    if first.count() <= BROADCAST_COPIES:  # payloads stay where they are
        joined = rows.join(F.broadcast(first.drop("_n")), (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes")), "left")
    else:
        joined = dealt_join(rows, first.drop("_n").hint("shuffle_hash"), on, common, ["page_id", "url"], "left")
    revisit = F.col("_keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keeper"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_keeper")).alias("refers_to"),
    )


def _field(value: str) -> str:
    """A header value on one line: control characters as %XX."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def _record(kind: str, fields: list[tuple[str, object]], block: str) -> str:
    head = [("WARC-Type", kind), *fields, ("Content-Length", len(block.encode()))]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n" + block


def chunked(records: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``plan_records`` as rows (record, chunk from 0): ``part`` in place of ``payload``, and how many ``parts`` there are.

    Chunks of a record follow each other within a partition. A revisit has one chunk,
    empty. A long payload is cut in one pass from its start to its end.
    """
    payload = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    # Bytes bound code points from above, so short payloads are not even counted.
    short = (F.col("payload_bytes") <= chunk_chars) | (F.col("record_type") != "response")
    cut = F.when(short, F.array(payload)).otherwise(F.regexp_extract_all(payload, F.lit(f"(?s).{{1,{chunk_chars}}}"), F.lit(0)))
    rows = records.withColumn("_parts", cut).drop("payload")
    rows = rows.select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", F.size("_parts").alias("parts"), F.posexplode("_parts").alias("chunk", "part"))
    return rows.select(*_CHUNKED)


_INFO = "software: chunked record tables\r\nformat: WARC File Format 1.1\r\n"


def record_rows(batches: Iterator[Columns], chunk_chars: int = CHUNK_CHARS) -> Iterator[list[tuple]]:
    """Rows of the text writer: warcinfo, then a record for each chunk, with the digest of the payload up to its end."""
    told, running, total = False, None, 0
    for batch in batches:
        out, held = [], 0
        if not told:
            told = True
            out.append((_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], _INFO),))
        for page, url, size, digest, kind, refers, parts, chunk, part in zip(*(batch[c] for c in _CHUNKED), strict=True):
            name = "urn:page:none" if page is None else f"urn:page:{page}"
            fields = [
                ("WARC-Record-ID", f"<{name}>"),
                ("WARC-Date", DATE),
                ("WARC-Target-URI", None if url is None else _field(url)),
                ("WARC-Payload-Digest", f"sha1:{digest}"),
                ("X-Payload-Length", size),
                ("Content-Type", "text/html; charset=utf-8"),
            ]
            if kind == "revisit":
                fields += [
                    ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", f"<urn:page:{refers}>"),
                ]
                out.append((_record("revisit", fields, ""),))
            elif parts == 1:
                out.append((_record("response", fields, part),))
            else:
                if chunk == 0:
                    running, total = hashlib.sha1(), 0
                data = part.encode()
                running.update(data)
                total += len(data)
                own = fields if chunk == 0 else [("WARC-Record-ID", f"<{name}:{chunk + 1}>"), ("WARC-Segment-Origin-ID", f"<{name}>"), ("WARC-Date", DATE)]
                last = []
                if chunk + 1 == parts:
                    if (f"{running.hexdigest()}", total) != (digest, size):
                        raise ValueError(f"chunks of {name} are not its payload")
                    last = [("WARC-Segment-Total-Length", size)]
                more = [("WARC-Segment-Number", chunk + 1), ("X-Running-Digest", f"sha1:{running.hexdigest()}"), *last]
                out.append((_record("response" if chunk == 0 else "continuation", own + more, part),))
            held += len(out[-1][0])
            if held > 8 * chunk_chars:
                yield out
                out, held = [], 0
        yield out


def write_archives(records: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS) -> None:
    """Write ``plan_records`` as gzipped WARC files below ``path``, one for each partition, over what is there.

    Payloads are cut into chunk rows before Python sees them, so a task there holds a
    batch of chunks, never a whole long payload. Null urls have no target header, null
    page_ids the name ``none``; repeated rows are repeated records; no rows give an
    archive without records.
    """
    rows = map_rows(chunked(records, chunk_chars), lambda it: record_rows(it, chunk_chars), "value string")
    rows.write.mode("overwrite").option("lineSep", END).option("compression", "gzip").text(path)


class _Reader:
    """Parses the lines of one archive; keeps one chunk at most."""

    def __init__(self):
        self.fields: dict[str, str] | None = None
        self.left = 0  # bytes of the block that are still to come
        self.state, self.digest, self.size, self.chunk = "start", hashlib.sha1(), 0, 0
        self.parts: list[bytes] = []

    def feed(self, line: bytes) -> Iterator[tuple]:
        if self.state == "start":
            if line == b"WARC/1.1\r":
                self.fields, self.state = {}, "head"
            elif line not in (b"", b"\r"):
                raise ValueError(f"no WARC record where one should begin: {line[:40]!r}")
        elif self.state == "head":
            if line != b"\r":
                key, _, value = line.rstrip(b"\r").partition(b": ")
                self.fields[key.decode()] = value.decode()
                return
            self.left = int(self.fields["Content-Length"])
            if self.fields["WARC-Type"] == "continuation":
                self.chunk += 1
            else:
                self.digest, self.size, self.chunk, self.first = hashlib.sha1(), 0, 0, self.fields
            self.parts, self.state = [], "block"
            if not self.left:
                yield from self.closed()
        else:
            data = line + b"\n"
            self.parts.append(data[: self.left])
            self.left -= min(self.left, len(data))
            if not self.left:
                yield from self.closed()

    def closed(self) -> Iterator[tuple]:
        row = self.close()
        if row[5] != "warcinfo":
            yield row

    def close(self) -> tuple:
        data, self.parts, self.state = b"".join(self.parts), [], "start"
        self.digest.update(data)
        self.size += len(data)
        told = self.fields.get("X-Running-Digest")
        if told and told != f"sha1:{self.digest.hexdigest()}":
            raise ValueError(f"digest of {self.fields['WARC-Record-ID']} does not match")
        head, more = self.first, self.fields
        total = more.get("WARC-Segment-Total-Length")
        last = "WARC-Segment-Number" not in more or total is not None
        page, refers = (head.get(k, "").removeprefix("<urn:page:").removesuffix(">") for k in ("WARC-Record-ID", "WARC-Refers-To"))
        kind = head["WARC-Type"]
        digest = self.digest.hexdigest()
        if last and kind == "response" and (f"sha1:{digest}" != head["WARC-Payload-Digest"] or self.size != int(head["X-Payload-Length"])):
            raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
        return (
            int(page) if page not in ("", "none") and kind != "warcinfo" else None,
            self.chunk,
            data,
            head["WARC-Payload-Digest"].removeprefix("sha1:") if kind == "revisit" else digest,
            int(head["X-Payload-Length"]) if kind == "revisit" else self.size,
            kind,
            int(refers) if refers else None,
            last,
            head.get("WARC-Target-URI"),
        )


CHUNKS = (
    "page_id long, chunk int, data binary, running_digest string, running_bytes long,"
    " record_type string, refers_to long, last boolean, url string"
)


def chunk_rows(batches: Iterator[Columns], payloads: bool = True) -> Iterator[list[tuple]]:
    file, reader = None, None
    for batch in batches:
        out, held = [], 0
        for at, line in zip(batch["file"], batch["value"], strict=True):
            if at != file:
                file, reader = at, _Reader()
            for row in reader.feed(line):
                held += len(row[2])
                out.append(row if payloads else (*row[:2], None, *row[3:]))
                if held > 8 * CHUNK_CHARS and payloads:
                    yield out
                    out, held = [], 0
        yield out


def read_chunks(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The chunked record table of the archives below ``path``: see ``CHUNKS``.

    A file is read by one task from its start (gzip does not split); its lines pass
    through a parser that holds one chunk. The digest and the number of bytes run on
    over the chunks of a record and are compared with its header at the last one; a
    record that does not match is an error. warcinfo records are passed over. Page ids
    and urls that the records do not have are null; without ``payloads`` data is null.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")
    )
    return map_rows(lines, lambda it: chunk_rows(it, payloads), CHUNKS)


def records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives, of what its last chunk carries.

    page_id and refers_to are null where the record names none; archives without
    records give an empty result; repeated records are repeated.
    """
    return read_chunks(spark, path, payloads=False).where("last").select(
        "page_id",
        F.col("running_bytes").alias("payload_bytes"),
        F.col("running_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )

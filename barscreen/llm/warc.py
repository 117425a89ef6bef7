"""WARC archives: a writer of one gzip member per record, and a reader that is split by byte ranges.

Writing. Payloads are told apart by SHA-256. Of equal payloads of `least_bytes` or more one record is a response, the
others are revisits, which hold the HTTP header alone and name the response. Only digests, sizes and ids are shuffled to
find them. Members go through Spark's text sink, that is through its file systems and its commit of whole tasks: a task
that is run again leaves no half of a file. The sink ends each row with one byte; it gets a zero, which is the last byte
of any member of less than 16 MiB (the top of its length field), and is zero padding behind a larger one.

Reading. Spark's text source cuts the byte ranges of an archive at each gzip magic: a task gets the pieces that start in
its ranges, whole, the last one from beyond the range if need be. A piece that doesn't decode to `WARC/` is no member's
start; a member whose bytes happen to hold the magic goes on in the next piece. If such a member lies across the end of
a range, neither task can settle it alone: archives in which that happens are decoded again from their start, as a stream
in the order of their bytes. Records inside one member may be many.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barscreen.llm.common import narrow, small_batches, written
from barscreen.sources.shared import shared_folder

LEAST_BYTES = 100
MAGIC = b"\x1f\x8b\x08"
RECORDS = (
    "path string, kind string, record_id string, target_uri string, refers_to string, date string, "
    "payload_bytes bigint, payload_sha256 string, intact boolean, payload binary, block bigint"
)
#: Hadoop decodes files by the ends of their names, and a file that it decodes isn't split. It looks at the registered end
#: that comes last before a file's name in the order of their letters from behind: with one more end there, that no archive
#: has, names like x.warc.gz have none, and their bytes are read, and split, as they are.
AS_IT_IS = {
    "io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec",
    "io.compress.passthrough.extension": ".!.gz",
    "org.apache.hadoop.shaded.io.compress.passthrough.extension": ".!.gz",  # the same in Hadoop's shaded client
}
#: Shared payloads up to so many are broadcast (some 120 bytes each); beyond that the join shuffles.
BROADCAST_SHARED = 200_000


def record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), F.substring(digest, 1, 16), F.lit(">"))


def page_of(record: Column) -> Column:
    """The page_id that a record's id names; null for none."""
    return F.nullif(F.regexp_extract(record, r"^<urn:page:(-?\d*):", 1), F.lit("")).cast("bigint")


def planned(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, bytes, refers_to, record_id): a row for each record that is to be written.

    payload is null in revisits. Of equal payloads the response is the smallest page_id's, nulls last; of repeated rows
    of that page_id the smallest url's, and of equal ones any.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    page = narrow(pages, "page_id", "url", "html").select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("bigint").alias("bytes"))
    order = F.struct(F.col("page_id").isNull(), "page_id")
    sizes = page.filter(F.col("bytes") >= least_bytes).groupBy("digest", "page_id").agg(F.count("*").alias("rows"))
    least = sizes.groupBy("digest").agg(F.sum("rows").alias("rows"), F.min_by(F.struct("page_id", "rows"), order).alias("least")).filter("rows > 1")
    shared = written(least.select("digest", F.col("least.page_id").alias("first_id"), F.col("least.rows").alias("first_rows")), "shared-payloads")
    small = shared.count() <= BROADCAST_SHARED
    found = page.join(F.broadcast(shared) if small else shared, "digest", "left")
    own = F.col("first_rows").isNull() | (F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("first_rows") == 1))
    repeated = F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("first_rows") > 1)
    nth = F.monotonically_increasing_id().cast("string")
    ids = record_id(F.col("page_id"), F.col("digest"))
    numbered = F.concat(F.regexp_replace(ids, ">$", ":"), nth, F.lit(">"))
    refers_to = record_id(F.col("first_id"), F.col("digest"))
    columns = ("page_id", "url", "payload", "digest", "bytes", "refers_to", "record_id")
    alone = found.filter(F.coalesce(own | ~repeated, F.lit(True))).select(
        "page_id",
        "url",
        F.when(own, F.col("payload")).alias("payload"),
        "digest",
        "bytes",
        F.when(~own, refers_to).alias("refers_to"),
        F.when(own & (F.col("bytes") >= least_bytes), ids).otherwise(numbered).alias("record_id"),
    )
    if shared.filter("first_rows > 1").isEmpty():
        return alone.select(*columns)
    # One page_id has the same payload more than once: one of its rows is the response, the rest are counted, not moved.
    rows = found.filter(F.coalesce(repeated, F.lit(False)))
    first = rows.groupBy("digest").agg(F.first("page_id").alias("page_id"), F.min("url").alias("url"), F.first("payload").alias("payload"), F.first("bytes").alias("bytes"))
    again = rows.groupBy("digest", "page_id", "url", "bytes").agg(F.count("*").alias("rows"))
    at = Window.partitionBy("digest").orderBy(F.col("url").asc_nulls_last())
    again = again.withColumn("nth", F.row_number().over(at)).withColumn("rows", F.col("rows") - F.when(F.col("nth") == 1, 1).otherwise(0)).filter("rows > 0")
    again = again.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    first = first.withColumns({"refers_to": F.lit(None).cast("string"), "record_id": ids})
    again = again.withColumns({"payload": F.lit(None).cast("binary"), "refers_to": ids, "record_id": numbered})
    return alone.select(*columns).unionByName(first.select(*columns)).unionByName(again.select(*columns))


def member(record: bytes) -> bytes:
    """A gzip member without a name or a time: the same record gives the same bytes."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def record(kind: str, key: str, date: str, block: bytes, content_type: str, **named: str | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {key}", f"WARC-Date: {date}"]
    lines += [f"{name.replace('_', '-')}: {value}" for name, value in named.items() if value]
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def escaped_uri(url: str | None) -> str | None:
    """No blank or control character may come into a header."""
    return url and re.sub(r"[\x00-\x20\x7f-\x9f\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", least_bytes: int = LEAST_BYTES) -> None:
    """WARC files in the folder path, a record for each row of pages (page_id, url, html; other columns are ignored).

    A null html is an empty payload, a null url leaves its header out, a null page_id stays null. A record must fit a
    task; payloads of any length are whole. An empty table gives archives without records.
    """
    small_batches(pages.sparkSession)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        about = b"software: barscreen\r\nformat: WARC File Format 1.1\r\n"
        first = True
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if first:
                    out.append(member(record("warcinfo", f"<urn:info:{r.record_id[1:-1]}>", date, about, "application/warc-fields")))
                    first = False
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.bytes}\r\n\r\n".encode()
                named = {"WARC_Target_URI": escaped_uri(r.url), "WARC_Payload_Digest": f"sha256:{r.digest}"}
                if r.payload is None:
                    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    named |= {"WARC_Profile": profile, "WARC_Refers_To": r.refers_to, "WARC_Truncated": "length"}
                kind = "response" if r.payload is not None else "revisit"
                out.append(member(record(kind, r.record_id, date, head + (r.payload or b""), "application/http;msgtype=response", **named)))
            yield pd.DataFrame({"value": [m[:-1] if m[-1] == 0 else m for m in out]})

    made = planned(pages, least_bytes).mapInPandas(members, "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


class Members:
    """Decodes members out of the pieces between magics, fed in the order of their bytes."""

    def __init__(self, from_start: bool):
        self.from_start, self.open, self.text = from_start, None, []
        self.unsettled = False  # whether what came first or last belongs to a member that isn't all here
        self.begun = from_start

    def feed(self, piece: bytes) -> Iterator[bytes | None]:
        """What a piece completes: a member's content, or None for bytes that are no member."""
        if self.open is None:
            self.open, self.text = zlib.decompressobj(31), []
        try:
            self.text.append(self.open.decompress(MAGIC + piece))
        except zlib.error:
            self.open = None
            yield from self._no_member()
            return
        if self.open.eof:
            content, rest = b"".join(self.text), self.open.unused_data
            self.open = None
            if content.startswith(b"WARC/"):
                self.begun = True
                yield content
                if rest.strip(b"\0"):
                    yield None
            else:
                yield from self._no_member()

    def _no_member(self) -> Iterator[None]:
        if self.begun:
            yield None
        self.unsettled |= not self.begun

    def close(self) -> bool:
        """True if all that was fed is settled."""
        return not self.unsettled and self.open is None


def headers_of(text: bytes) -> dict[str, str]:
    fields = (line.partition(":") for line in text.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in fields}


def records_in(content: bytes, path: str, keep_payload: bool) -> Iterator[tuple]:
    """Rows of RECORDS for the records in a member's content."""
    at = 0
    while content.startswith(b"WARC/", at):
        end = content.find(b"\r\n\r\n", at)
        named = headers_of(content[at:end]) if end >= 0 else {}
        length = named.get("content-length", "")
        if not length.isdigit() or len(content) < end + 4 + int(length):
            yield damaged(path)
            return
        block = content[end + 4 : end + 4 + int(length)]
        at = end + 4 + int(length)
        while content.startswith(b"\r\n", at):
            at += 2
        kind, payload = named.get("warc-type", ""), block
        size = None
        if named.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            told = headers_of(head).get("content-length", "")
            size = int(told) if told.isdigit() and kind == "revisit" else None
        told = named.get("warc-payload-digest", "").removeprefix("sha256:")
        if kind == "revisit":
            digest, intact = told, True
        else:
            digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
            intact = not re.fullmatch("[0-9a-f]{64}", told) or told == digest
        kept = payload if keep_payload and kind != "revisit" else None
        yield path, kind, named.get("warc-record-id"), named.get("warc-target-uri"), named.get("warc-refers-to"), named.get("warc-date"), size, digest, intact, kept, None
    if content[at:]:
        yield damaged(path)


def damaged(path: str) -> tuple:
    return path, "damaged", None, None, None, None, None, None, False, None, None


def unsettled(path: str, block: int) -> tuple:
    return path, "unsettled", None, None, None, None, None, None, None, None, block


def read_archives(spark: SparkSession, path: str, payload: bool = True, glob: str = "*") -> DataFrame:
    """(path, kind, record_id, target_uri, refers_to, date, payload_bytes, payload_sha256, intact, payload) of all records.

    Bytes that are no record give a row of kind `damaged`. intact is false where a payload isn't what its digest says.
    payload is null unless asked for, and in revisits, whose size and digest are those of the payload they stand for. The
    records are written once to the shared folder. A compressed member must be under 2 GB. A folder without archives
    gives no rows.
    """
    small_batches(spark)
    pieces = spark.read.options(**AS_IT_IS).option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").option("pathGlobFilter", glob).text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))

    def decoded(batches: Iterator[pd.DataFrame], sequential: bool) -> Iterator[pd.DataFrame]:
        """Pieces of one range after the other; sequential: of one archive after the other."""
        where, members = None, None

        def ended() -> list[tuple]:
            if members is None or members.close():
                return []
            return [damaged(where[0])] if sequential else [unsettled(*where)]

        for rows in batches:
            out: list[tuple] = []
            for r in rows.itertuples(index=False):
                now = (r.path, 0 if sequential else r.block)
                if now != where:
                    out += ended()
                    where, members = now, Members(now[1] == 0)
                    if now[1] == 0:  # what is before the first magic
                        out += [damaged(r.path)] if r.piece.strip(b"\0") else []
                        continue
                for content in members.feed(r.piece):
                    out += [damaged(r.path)] if content is None else list(records_in(content, r.path, payload))
            yield pd.DataFrame(out, columns=COLUMNS)
        yield pd.DataFrame(ended(), columns=COLUMNS)

    first = written(pieces.mapInPandas(lambda b: decoded(b, False), RECORDS), "warc-records")
    again = first.filter("kind = 'unsettled'").select("path").distinct()
    if again.isEmpty():
        return first.drop("block")
    ordered = pieces.withColumn("nth", F.monotonically_increasing_id()).join(again, "path", "left_semi")
    ordered = ordered.repartition("path").sortWithinPartitions("path", "block", "nth").drop("nth")
    redone = ordered.mapInPandas(lambda b: decoded(b, True), RECORDS)
    return first.join(again, "path", "left_anti").select(*COLUMNS).unionByName(redone.select(*COLUMNS)).drop("block")


COLUMNS = [c.split()[0] for c in RECORDS.split(", ")]


def read_back(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact, archive) of archives written from pages."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, least_bytes=least_bytes)
    found = read_archives(spark, folder, payload=False).filter(F.col("kind").isin("response", "revisit"))
    return found.select(
        page_of(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        F.col("payload_sha256").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        page_of(F.col("refers_to")).alias("refers_to"),
        "intact",
        F.col("path").alias("archive"),
    )

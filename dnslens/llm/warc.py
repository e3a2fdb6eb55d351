"""WARC archives: write, normalise, read back.

Pages become WARC records in archives that are one gzip stream each, as crawlers often leave
them. The normaliser inflates such a stream once, front to back in small steps, writes
every record anew as a gzip member of its own, and beside each archive an index of offsets. With
the index, records are read one by one, and the parts of a large archive by several tasks.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, spread, stored

LEAST_COPY_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
STEP = 1 << 20
LEVEL = 6
READ_SPAN = 32 << 20
# Fixed value: name of the revisit profile in the WARC 1.1 standard.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = re.compile(rb"([^:\r\n]+): *([^\r\n]*)\r\n")


def copies(pages: DataFrame, least_bytes: int = LEAST_COPY_BYTES) -> DataFrame:
    """``page_id, refers_to`` of pages whose payload another page with a larger id also has.

    Only digests move. Payloads under ``least_bytes`` are never copies; a null payload is empty, and
    a null id is never referred to, nor are the rows that repeat the largest id copies of it.
    """
    html = F.coalesce("html", F.lit(""))
    digests = pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    digests = stored(digests.filter(F.col("size") >= least_bytes).select("page_id", "digest"), "digests")
    last = digests.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    last = last.filter("n > 1 and refers_to is not null").drop("n")
    both = digests.join(last, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return stored(both.select("page_id", "refers_to").distinct(), "copies")


def record(page_id: Column, url: Column, html: Column, refers_to: Column) -> Column:
    """Text of one WARC record without its last line feed; a revisit has no payload."""
    payload = F.coalesce(html, F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    block = F.when(refers_to.isNull(), F.concat(http, payload)).otherwise(http)
    name = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("null")), F.lit(">\r\n"))
    revisit = F.concat(F.lit(f"WARC-Profile: {SAME_PAYLOAD}\r\nWARC-Refers-To: "), name(refers_to))
    kind = F.when(refers_to.isNull(), "response").otherwise("revisit")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), name(page_id),
        F.lit(f"WARC-Date: {DATE}\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20]", ""), F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.sha1(payload), F.lit("\r\n"), F.when(refers_to.isNull(), "").otherwise(revisit),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"),
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """One record per page (``page_id, url, html``) into gzip files, each one stream."""
    repeated = copies(pages)
    known = repeated.select(F.col("page_id").alias("copy_id"), "refers_to")
    joined = pages.select("page_id", "url", "html").join(known, F.col("page_id").eqNullSafe(F.col("copy_id")), "left")
    lines = joined.select(record(F.col("page_id"), F.col("url"), F.col("html"), F.col("refers_to")).alias("value"))
    lines.write.option("compression", "gzip").option("lineSep", "\n").text(path)


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path.replace("s3a://", "s3://", 1)))


def _inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, in steps of at most ``STEP``, however well they compress."""
    inflate = zlib.decompressobj(31)
    while data := stream.read(STEP):
        while data:
            yield inflate.decompress(data, STEP)
            data = inflate.unconsumed_tail or inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)


def records(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Cuts a stream of WARC records by their headers' lengths."""
    held, need = bytearray(), None
    for part in parts:
        held += part
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                head = dict(_HEAD.findall(bytes(held[: end + 2])))
                need = end + 4 + int(head[b"Content-Length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError(f"archive ends within a record, {len(held)} bytes are left over")


def normalise_file(source: str, target: str) -> tuple[int, int]:
    """Rewrites one archive; returns its records and bytes. ``target`` appears only when complete."""
    fs, path = _file_system(source)
    out_fs, out = _file_system(target)
    lines, at, draft = [], 0, f"{out}.{uuid.uuid4().hex}"
    with fs.open_input_stream(path, compression=None) as stream, out_fs.open_output_stream(draft, compression=None) as sink:
        for item in records(_inflated(stream)):
            member = gzip.compress(item, LEVEL, mtime=0)
            sink.write(member)
            lines.append(f"{at} {len(member)}\n")
            at += len(member)
    with out_fs.open_output_stream(f"{draft}.idx", compression=None) as sink:
        sink.write("".join(lines).encode())
    out_fs.move(f"{draft}.idx", f"{out}.idx")
    out_fs.move(draft, out)
    return len(lines), at


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """``file, records, bytes`` of the archives below ``source``, rewritten below ``target``.

    Each archive is read by one task as a stream. A task that runs again writes the same bytes to the same
    names. The target's folder must be one that all executors reach.
    """
    fs, folder = _file_system(target)
    fs.create_dir(folder, recursive=True)

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                name = f"{target}/{path.rsplit('/', 1)[1].removesuffix('.txt.gz').removesuffix('.warc.gz')}.warc.gz"
                yield pd.DataFrame([(name, *normalise_file(path, name))], columns=["file", "records", "bytes"])

    files = spark.read.format("binaryFile").load(source).select("path")
    files = files.repartition(spread(spark, 2), "path")
    return stored(files.mapInPandas(rewrite, "file string, records long, bytes long"), "archives")


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """``file, at, size`` of every record, from the index files."""
    lines = spark.read.text(f"{target}/*.idx").select(F.input_file_name().alias("file"), F.split("value", " ").alias("v"))
    file = F.regexp_replace("file", r"\.idx$", "")
    return lines.select(file.alias("file"), F.col("v")[0].cast("long").alias("at"), F.col("v")[1].cast("long").alias("size"))


def parse(item: bytes) -> tuple:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of a record.

    A response's figures come from its payload, a revisit's from its headers.
    """
    head, _, block = item.partition(b"\r\n\r\n")
    fields = {k.decode(): v.decode() for k, v in _HEAD.findall(head + b"\r\n")}
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    page, refers, kind = number("WARC-Record-ID"), number("WARC-Refers-To"), fields["WARC-Type"]
    if kind == "revisit":
        size = int(dict(_HEAD.findall(http + b"\r\n"))[b"Content-Length"])
        return page, size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind, refers
    payload = payload[:-4]
    return page, len(payload), hashlib.sha1(payload).hexdigest(), kind, refers


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(spark: SparkSession, target: str) -> DataFrame:
    """A row for each record of the normalised archives, found through their indexes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in RECORD.split(", ")]
        for batch in batches:
            rows = []
            for path, group in batch.sort_values(["file", "at"]).groupby("file"):
                fs, name = _file_system(path)
                with fs.open_input_file(name) as archive:
                    for at, size in zip(group["at"], group["size"]):
                        archive.seek(int(at))
                        rows.append(parse(gzip.decompress(archive.read(int(size)))))
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    index = read_index(spark, target)
    dealt = index.repartition(spread(spark), "file", F.expr(f"at DIV {READ_SPAN}"))
    return dealt.mapInPandas(read, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives, normalises them, and reads every record back.

    An empty table gives an empty result. Columns other than ``page_id, url, html`` are ignored.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_archives(pages, f"{folder}/raw")
    done = normalise(spark, f"{folder}/raw", f"{folder}/warc")
    if not done.agg(F.sum("records").alias("n")).first().n:
        return spark.createDataFrame([], RECORD)
    return read_records(spark, f"{folder}/warc")

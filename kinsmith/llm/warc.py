"""Content-addressed WARC archive.

An archive is a folder of two tables. `payloads` has each distinct payload once, by its SHA-256; `records` has every
record's exact header bytes, its place and its payload's digest. reading joins them, checks each payload against the
digests, and gives back the original records byte for byte. Everything is built-in functions, so texts stay in the JVM.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinsmith.llm.common import materialize, require, shared_dir

#: The digits of base 32 by value, as Spark's conv() and as RFC 4648 write them.
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Size bound of the broadcast that tells payloads which occur once.
HASH_BUCKETS = 1 << 20
#: Date of all records, as archives have to be the same whenever they are written.
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits are four of base 32."""
    digest = F.upper(F.sha1(payload))
    groups = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*groups), _DIGITS, _BASE32)


def _utf8(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record for each row of pages(page_id, url, html) to the folder `path`.

    Of records with equal payloads of at least min_bytes bytes that with the largest page_id is a response, and the others
    are revisits that name it. A null html is an empty payload; a null url has an empty target; rows that repeat a page_id
    with the same payload are all responses if that page is; a null page_id is less than any other, is written as an empty
    number, and a group of such rows only is all responses. Line ends in a url are percent-encoded, as a header can't hold
    them. Pages of any length are taken whole. An empty table gives an empty archive. Other columns are ignored.
    """
    require(pages, "page_id", "url", "html")
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), _utf8(F.coalesce("html", F.lit(""))).alias("payload"))
    page = page.select("*", F.unhex(F.sha2("payload", 256)).alias("sha256"), F.length("payload").cast("long").alias("bytes"))
    # digests only are gathered to choose
    chosen = materialize(page.select("page_id", "sha256").groupBy("sha256").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")), "digests")
    narrow = page.select("page_id", "url", "sha256", "bytes", base32_sha1(F.col("payload")).alias("sha1")).join(chosen.drop("n"), "sha256")
    equal = (F.col("bytes") >= min_bytes) & F.col("owner").isNotNull()
    revisit = equal & ~F.col("page_id").eqNullSafe(F.col("owner"))
    refers_to = F.when(revisit, F.col("owner"))
    identity = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), identity),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers_to.cast("string"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    ]
    header = _utf8(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")))
    narrow.select(header.alias("header"), "sha256").write.parquet(f"{path}/records")
    # payloads of digests that occur once stay where they are, told by a bounded broadcast; the others move by page, so
    # no digest's rows meet in one place
    again = chosen.where("n > 1")
    hashed = F.pmod(F.xxhash64("sha256"), F.lit(HASH_BUCKETS))
    some = F.broadcast(again.select(hashed.alias("bucket")).distinct())
    once = page.join(some, hashed == F.col("bucket"), "left_anti").select("sha256", "payload")
    # page ids as text, as null has to equal null
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    owners = chosen.select(F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("key"), "sha256")
    shared = page.join(some, hashed == F.col("bucket"), "left_semi").withColumn("key", key).join(owners, ["key", "sha256"], "left_semi")
    once.unionByName(shared.dropDuplicates(["key", "sha256"]).select("sha256", "payload")).write.parquet(f"{path}/payloads")


def _field(header: Column, name: str) -> Column:
    """The value of a header in the given text of headers, or null."""
    return F.when(header.contains(f"\r\n{name}: "), F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r]*)\r\n", 1))


def _page(header: Column, name: str) -> Column:
    """The page that an identity names, or null."""
    number = F.regexp_extract(_field(header, name), "<urn:page:(-?[0-9]*)>", 1)
    return F.when(number != "", number).cast("long")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload, record).

    `record` is the record's exact bytes; a revisit's block is empty, its payload that of the response. A payload that
    doesn't have the digests it is stored under is an error.
    """
    records, payloads = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    kept = payloads.select("sha256", "payload", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    kept = kept.withColumn("payload", F.when(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload differs from its digest")).cast("binary")))
    both = records.join(kept, "sha256", "left")
    header = F.decode("header", "UTF-8")
    digest = F.when(_field(header, "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("sha1")), F.col("sha1")).otherwise(F.raise_error(F.lit("a record's payload is missing or differs from its digest")).cast("string"))
    block = F.when(_field(header, "WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return both.select(
        _page(header, "WARC-Record-ID").alias("page_id"),
        _field(header, "WARC-Target-URI").alias("url"),
        _field(header, "WARC-Type").alias("record_type"),
        _page(header, "WARC-Refers-To").alias("refers_to"),
        digest.alias("payload_digest"),
        "payload_bytes",
        "payload",
        F.concat(F.col("header"), block, F.lit(b"\r\n\r\n")).alias("record"),
    )


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages to an archive, by default in the shared folder, read it, and return what the records' bytes say of each page.

    Each rebuilt record is cut into headers and block as a reader of WARC files does; a record that isn't as long as it says
    is an error. A revisit's payload is that of its response. A row for each page, as write_archive() defines them.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/kinsmith/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    # a character for each byte, so that places in the text are places in the record
    end = F.instr(F.decode("record", "ISO-8859-1"), "\r\n\r\n")
    cut = read_archive(spark, path).select("record", "payload", end.alias("end"), F.decode(F.substring("record", F.lit(1), end + F.lit(1)), "UTF-8").alias("header"))
    header, size = F.col("header"), _field(F.col("header"), "Content-Length").cast("int")
    whole = (F.col("end") > 0) & (F.length("record") == F.col("end") + size + 7) & header.startswith("WARC/")
    block = F.when(whole, F.substring("record", F.col("end") + 4, size)).otherwise(F.raise_error(F.lit("a record is cut off")).cast("binary"))
    read = cut.select("header", F.when(_field(header, "WARC-Type") == "revisit", F.when(F.length(block) == 0, F.col("payload"))).otherwise(block).alias("body"))
    return read.select(
        _page(header, "WARC-Record-ID").alias("page_id"),
        F.length("body").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("body")).alias("payload_digest"),
        _field(header, "WARC-Type").alias("record_type"),
        _page(header, "WARC-Refers-To").alias("refers_to"),
    )


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed WARC file; a file that is cut off is an error."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8").split("\r\n")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start, size = end + 4, int(headers["content-length"])
        if len(data) < start + size + 4:
            raise ValueError("the last record is cut off")
        yield headers, data[start : start + size]
        at = start + size + 4


def scan_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of .warc or .warc.gz files: (file, record_type, record_id, url, payload_digest, block)."""
    import gzip

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for h, block in parse_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    row = {"file": name, "record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "url": h.get("warc-target-uri"), "payload_digest": h.get("warc-payload-digest"), "block": block}
                    yield pa.RecordBatch.from_pylist([row], schema=pa.schema([(k, pa.binary() if k == "block" else pa.string()) for k in row]))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, record_type string, record_id string, url string, payload_digest string, block binary")

"""Content-addressed WARC archive.

The archive has two tables. `payloads` holds the bytes of each distinct payload once, under its SHA-256 digest. `headers`
holds the exact header bytes of each record (WARC and HTTP header), with the digest of its payload. Of records with
equal payloads that with the smallest page_id is the response, which owns the payload; others are revisits of it.
Reading joins the two, after every stored payload's digest has been computed anew and compared; records() gives each
record's original bytes.

Payloads that occur once, nearly all, are written where they are read: a bitmap of the digests that occur more than once, of
bounded size, tells them from the others, so no join and no shuffle moves them. The others are shuffled after a map-side
reduction to one per digest and task, so a payload that a third of all pages share moves once for each task. All other joins
move digests and headers only. Only records(), which gives the original bytes back, joins payloads to headers.

Defined results: null html is an empty payload; equal payloads shorter than `least` bytes are responses all; rows that
repeat a page_id and its payload are the same record, so both are responses; a null page_id is never referred to while
its payload has another; a null url gives no target line, and line ends in a url become spaces.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Workspace, drop

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexadecimal: Column) -> Column:
    """Base 32 of 40 hexadecimal digits."""
    out = []
    for i in range(8):
        v = F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _record_id(page: Column, key: Column) -> Column:
    h = F.md5(F.concat_ws(" ", page.cast("string"), key).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


@dataclass(frozen=True)
class Archive:
    """root: where the tables are. least: smallest payload that is stored once. bits: log2 of the most bits of the bitmap
    that lets other payloads pass (16 MB). date: of the records."""

    root: str
    least: int = 0
    bits: int = 27
    date: str = "2024-01-01T00:00:00Z"

    def write(self, pages: DataFrame) -> Archive:
        """pages has page_id, url and html."""
        spark = pages.sparkSession
        payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
        rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("key", F.sha2("payload", 256))
        rows.select("page_id", "url", "key", F.length("payload").cast("long").alias("n"), base32(F.sha1("payload")).alias("sha1")).write.parquet(f"{self.root}/facts")
        facts = spark.read.parquet(f"{self.root}/facts")
        repeated = facts.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
        repeated.write.parquet(f"{self.root}/repeated")
        repeated = spark.read.parquet(f"{self.root}/repeated")

        once, more = self._apart(rows.select("key", "payload"), repeated)
        once.write.option("compression", "zstd").parquet(f"{self.root}/payloads")
        if more is not None:
            more.dropDuplicates(["key"]).write.mode("append").option("compression", "zstd").parquet(f"{self.root}/payloads")

        other = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
        r = facts.join(repeated, "key", "left").withColumn("revisit", other & (F.col("n") >= self.least))
        url = F.regexp_replace("url", r"[\r\n]+", " ")
        http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
        lines = [
            F.lit("WARC/1.1"),
            F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
            F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("key"))),
            F.concat(F.lit("WARC-Date: "), F.lit(self.date)),
            F.concat(F.lit("WARC-Target-URI: "), url),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
            F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), _record_id(F.col("first"), F.col("key")), F.lit("\r\nX-Refers-To-Page: "), F.col("first").cast("string"))),
            F.lit("Content-Type: application/http; msgtype=response"),
            F.concat(F.lit("Content-Length: "), (F.length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("n"))).cast("string")),
        ]
        header = F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), http)
        r.select("page_id", "key", F.encode(header, "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{self.root}/headers")
        for name in ("facts", "repeated"):
            drop(spark, f"{self.root}/{name}")
        return self

    def _apart(self, rows: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Rows whose key certainly occurs once, and the others: all of repeated keys, and a few more. A bitmap tells, with
        16 bits for each repeated key, but not above 2 ** `bits`; it is broadcast in pieces of 4 kB."""
        n = repeated.count()
        if not n:
            return rows, None
        size = min(self.bits, max(16, (16 * n).bit_length()))
        slot = F.xxhash64("key").bitwiseAND((1 << size) - 1)
        piece, bit = F.shiftright(slot, 15), slot.bitwiseAND(32767)
        bitmap = repeated.select(slot.alias("slot")).distinct().groupBy(F.shiftright("slot", 15).alias("piece")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(32767)).alias("on"))
        byte = F.conv(F.hex(F.substr("on", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        on = F.floor(byte / F.pow(F.lit(2), bit.bitwiseAND(7))) % 2
        both = rows.withColumn("piece", piece).join(F.broadcast(bitmap), "piece", "left").withColumn("again", F.coalesce(on == 1, F.lit(False)))
        return both.filter("not again").select("key", "payload"), both.filter("again").select("key", "payload")

    def headers(self, spark: SparkSession) -> DataFrame:
        """page_id, key, header, and record_type and refers_to as the header says."""
        text = F.decode("header", "UTF-8")
        refers = F.regexp_extract(text, r"\r\nX-Refers-To-Page: ([^\r]*)\r\n", 1)
        kind = F.regexp_extract(text, r"\r\nWARC-Type: ([^\r]*)\r\n", 1)
        t = spark.read.parquet(f"{self.root}/headers")
        return t.select("page_id", "key", "header", kind.alias("record_type"), F.when(kind == "revisit", refers).cast(t.schema["page_id"].dataType).alias("refers_to"), F.regexp_extract(text, r"\r\nWARC-Payload-Digest: sha1:([^\r]*)\r\n", 1).alias("stated"))

    def payloads(self, spark: SparkSession) -> DataFrame:
        """key and payload; an error if bytes don't have their digest."""
        found = spark.read.parquet(f"{self.root}/payloads")
        fails = F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("key")))
        return found.select("key", F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload")).otherwise(fails.cast("binary")).alias("payload"))

    def records(self, spark: SparkSession) -> DataFrame:
        """page_id, record_type and record: the record's original bytes. A revisit has a header only."""
        headers = self.headers(spark)
        own = headers.filter("record_type = 'response'").join(self.payloads(spark), "key").select("page_id", "record_type", "header", "payload")
        rest = headers.filter("record_type <> 'response'").select("page_id", "record_type", "header", F.lit(b"").alias("payload"))
        return own.unionByName(rest).select("page_id", "record_type", F.concat("header", "payload", F.lit(b"\r\n\r\n")).alias("record"))

    def read(self, spark: SparkSession) -> DataFrame:
        """page_id, payload_bytes, payload_digest (of the payload as read), record_type and refers_to of each record."""
        stored = self.payloads(spark).select("key", F.length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
        joined = self.headers(spark).drop("header").join(stored, "key")
        right = F.when(F.col("stated") == F.col("payload_digest"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its header "), F.col("stated"))))
        return joined.select("page_id", "payload_bytes", right.alias("payload_digest"), "record_type", "refers_to")


def archived(pages: DataFrame) -> DataFrame:
    """Write an archive of pages in the shared folder and read it back."""
    return Archive(Workspace(pages.sparkSession, "warc").root).write(pages).read(pages.sparkSession)


SQL = f"""
WITH r AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS n, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM r)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}',
           CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f"""

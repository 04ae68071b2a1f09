r"""A content-addressed web archive: payload bytes once, exact record headers apart.

``write_archive`` writes two tables into a folder:

* ``payloads``: each distinct payload once, under its SHA-256, with length and SHA-1;
* ``headers``: one row for each record: its WARC header and its HTTP header, byte for byte
  as they stand in a WARC file, and the digest that leads to the payload.

``read_archive`` joins both to the records again. It takes nothing on trust: every payload
is hashed anew, and a payload that doesn't give its digest, has another length than a header
says, or is missing, is an error. ``write_warc`` writes the records as WARC files.

Of records with equal payloads of at least ``min_bytes`` the one with the smallest id is a
``response``, the others are ``revisit`` records: they refer to it and hold no payload, and
the join gives them theirs. Smaller payloads are written with each response by reference
to the same stored bytes.

Ids, lengths and digests are written once as narrow rows; the smallest id of a digest is an
aggregate, combined in each task, so a payload that a third of the records share sends one row for
each task; it meets the records in a join that adaptive execution splits. Payload bytes are
shuffled once, after each task has dropped its repeats.

Edge cases: a null payload is empty; an empty one has a digest like any other; a null id comes
after all others and is null again when read; of repeated rows one is the response; a null URL
gives no ``WARC-Target-URI``; control characters and spaces in a URL are percent-encoded, so that
a header keeps its lines; an empty table gives an archive without records. Further columns
aren't archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.registry import query, table
from corpusloom.storage import new_path, stage

MIN_BYTES = 0
DATE = "1970-01-01T00:00:00Z"
_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(raw: Column) -> Column:
    """The SHA-1 of bytes as 32 base-32 digits: four for each five hexadecimal ones."""
    digest = F.sha1(raw)
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0"),
                                  _DIGITS, _BASE32) for i in range(8)])


def _bytes(payload: str) -> Column:
    return F.coalesce(F.col(payload).cast("binary"), F.lit(b""))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))


def _uri(url: Column) -> Column:
    """The URL without control characters and spaces."""
    for code in [*range(0x21), 0x7F]:
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def _name(key: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(F.url_encode(key.cast("string")), F.lit("")),
                    F.lit(":"), row.cast("string"), F.lit(">"))


def _field(header: Column, name: str) -> Column:
    """The value of a header line; null where there is none."""
    return F.nullif(F.regexp_extract(header, rf"(?:^|\n){name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url",
                  payload: str = "html", min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Write the records of ``pages`` to the folder ``path``, which must not hold an archive."""
    raw = _bytes(payload)
    # Row numbers name records; written once, so that all that follows sees the same ones.
    narrow = stage(pages.select(
        F.col(key).alias("_key"), F.col(url).cast("string").alias("_url"), F.sha2(raw, 256).alias("digest"),
        base32_sha1(raw).alias("_sha1"), F.octet_length(raw).cast("long").alias("_n"),
        F.monotonically_increasing_id().alias("_row")))
    one = pages.select(F.sha2(raw, 256).alias("digest"), raw.alias("payload")).dropDuplicates(["digest"])
    one.write.mode("errorifexists").parquet(f"{path}/payloads")
    place = F.struct(F.col("_key").isNull().alias("_no"), "_key", "_row", "_url")
    firsts = narrow.where(F.col("_n") >= min_bytes).groupBy("digest").agg(F.min(place).alias("_first"))
    records = narrow.join(firsts, "digest", "left")
    again = F.col("_first").isNotNull() & (F.col("_first._row") != F.col("_row"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "),
                    F.col("_n").cast("string"), F.lit(_END + _END))
    block = F.octet_length(http) + F.when(again, 0).otherwise(F.col("_n"))
    header = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _name(F.col("_key"), F.col("_row"))), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _uri(F.col("_url"))),
        _line("WARC-Profile", F.when(again, _PROFILE)),
        _line("WARC-Refers-To", F.when(again, _name(F.col("_first._key"), F.col("_first._row")))),
        _line("WARC-Refers-To-Target-URI", F.when(again, _uri(F.col("_first._url")))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha1"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")), F.lit(_END))
    records.select(F.col("_key").alias("key"), "digest", header.alias("header"), http.alias("http")).write.mode(
        "errorifexists").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive, payloads verified.

    ``key``, record_type, refers_to (key of the response of a revisit), payload_bytes,
    payload_digest (base-32 SHA-1), payload (of revisits as well) and record: the bytes of the
    WARC record without the two line ends that close it.
    """
    headers = spark.read.parquet(f"{path}/headers")
    stored = spark.read.parquet(f"{path}/payloads")
    raw = F.col("payload")
    bodies = stored.select(
        F.col("digest").alias("_d"), raw, F.octet_length(raw).cast("long").alias("_n"),
        F.when(F.sha2(raw, 256) == F.col("digest"), base32_sha1(raw)).otherwise(
            F.raise_error(F.concat(F.lit("stored bytes don't give the digest "), "digest"))).alias("_sha1"))
    joined = headers.join(bodies, F.col("digest") == F.col("_d"), "left")
    claimed = _field(F.col("header"), "WARC-Payload-Digest")
    says = F.regexp_extract("http", r"Content-Length: (\d+)", 1).cast("long")
    true = F.coalesce((claimed == F.concat(F.lit("sha1:"), F.col("_sha1"))) & (says == F.col("_n")), F.lit(False))
    name = F.regexp_extract(_field(F.col("header"), "WARC-Refers-To"), r"^<urn:record:([^:]*):", 1)
    kind = _field(F.col("header"), "WARC-Type")
    return joined.select(
        "key", kind.alias("record_type"),
        F.url_decode(F.nullif(name, F.lit(""))).cast(headers.schema["key"].dataType).alias("refers_to"),
        F.col("_n").alias("payload_bytes"),
        F.when(true, F.col("_sha1")).otherwise(F.raise_error(F.concat(
            F.lit("no payload as the header says under "), "digest"))).alias("payload_digest"),
        raw, F.concat(F.col("header").cast("binary"), F.col("http").cast("binary"),
                      F.when(kind == "response", raw).otherwise(F.lit(b""))).alias("record"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write ``record`` of ``read_archive`` as WARC files, one for each task."""
    records.select(F.col("record").cast("string")).write.mode("errorifexists").option(
        "lineSep", _END + _END).text(path)


_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, row_number() OVER () AS rid FROM pages),
d AS (SELECT *, strlen(html)::BIGINT AS n, sha1(html) AS h,
    row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST, rid) AS place,
    first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST, rid) AS first FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', 1 +
    ((('0x' || substr(h, 5 * (i // 4)::INTEGER + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), '')
    AS payload_digest,
  CASE WHEN n >= {MIN_BYTES} AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {MIN_BYTES} AND place > 1 THEN first END AS refers_to
FROM d"""


@query("op11_warc_archive", _SQL)
def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark)
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")

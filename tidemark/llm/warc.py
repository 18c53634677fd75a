"""WARC archives: written with Spark's text writer, read back by boundary-chain verification.

Writing: a record per page; of equal payloads of ``least`` bytes or more the largest page_id
is the response, the others are revisits that refer to it and hold no payload.

Reading: a task sees its part of an archive cut at every occurrence of the record magic.
Each piece is a candidate record: its header, if it has one, gives the offset where the
next record must begin. Prefix sums of the pieces' lengths give the candidates' offsets,
and pointer jumping over the candidate-to-successor offsets from the start of the file
(log2 n rounds) keeps the records that can be reached. A magic inside a payload starts a
candidate that no chain reaches, whatever it looks like. Payload bytes never leave the scan,
but for records with a magic inside, which are put together in a second pass.

Defined cases: a null html is an empty payload; a null page_id is written as 'null' and read
as null, and counts as least among equal payloads; a null url is left out; line breaks
in a url are percent-encoded; repeated rows get a record each, equal rows at the largest
page_id are all responses; an archive that does not start with a record has none; an empty
table gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations


import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.runtime import Scratch

MAGIC = "WARC/1.1\r\n"
_CRLF = "\r\n"
_END = "\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_HTTP = f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_END}"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))


def records(pages: DataFrame, scratch: Scratch, least: int = 1000) -> DataFrame:
    """The WARC record of each page, without the blank lines that end it.

    The groups of equal payloads are written first, so that the join knows their size: few
    of them are broadcast (under Spark's own limit), and pages are shuffled only for many.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    rows = rows.withColumn("n", F.octet_length("html")).withColumn("digest", F.sha1("html"))
    heads = scratch.table(rows.filter(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("head"), F.count("*").alias("copies")).filter("copies > 1").select(F.col("digest").alias("d"), F.col("n").alias("m"), "head"))
    told = rows.join(heads, (F.col("digest") == F.col("d")) & (F.col("n") == F.col("m")), "left")
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    body = F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), F.col("html")))
    head = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))),
        _line("WARC-Date", F.lit(_DATE)),
        F.coalesce(_line("WARC-Target-URI", F.col("url")), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(_line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("head").cast("string"), F.lit(">")))),
        ).otherwise(""),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(body).cast("string")),
        F.lit(_CRLF),
    )
    return told.select(F.concat(head, body).alias("value"))


def write(pages: DataFrame, path: str, scratch: Scratch, least: int = 1000, per_archive: int = 20_000) -> None:
    """Archives of at most ``per_archive`` records under ``path``."""
    records(pages, scratch, least).write.option("lineSep", _END).option("maxRecordsPerFile", per_archive).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at the magic: file, place in the file's order, and the piece that follows a magic."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value"
    )


def _field(name: str) -> Column:
    found = F.regexp_extract("header", rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1)
    return F.when(found != "", found)


def _parsed(pieces: DataFrame) -> DataFrame:
    """What each piece says if it is a record; payload figures where the piece holds the whole record."""
    raw, cut = F.col("value").cast("binary"), F.col("head_bytes") - len(MAGIC)
    said = (
        pieces.withColumn("header", F.substring_index("value", _END, 1))
        .withColumn("bytes", F.octet_length("value").cast("long"))
        .withColumn("head_bytes", (F.octet_length("header") + len(_END) + len(MAGIC)).cast("long"))
        .withColumn("length", F.expr(r"try_cast(regexp_extract(header, '(?i)(?:^|\r\n)Content-Length: *([0-9]+) *(?:\r\n|$)', 1) as bigint)"))
        .withColumn("whole", (F.col("bytes") == cut + F.col("length") + len(_END)) & F.col("length").isNotNull())
    )
    block = F.when(F.col("whole"), F.substring(raw, (cut + 1).cast("int"), F.col("length").cast("int")))
    said = said.withColumn("block_bytes", block).withColumn("http", F.locate(_END, F.col("block_bytes").cast("string")))
    payload = F.when(F.col("http") > 0, F.substring("block_bytes", F.col("http") + len(_END), F.col("length").cast("int"))).otherwise(F.col("block_bytes"))
    return said.select(
        "file",
        "block",
        "place",
        "bytes",
        "head_bytes",
        "length",
        "whole",
        _field("WARC-Record-ID").alias("record"),
        _field("WARC-Type").alias("type"),
        _field("WARC-Refers-To").alias("refers"),
        F.regexp_extract("header", r"(?i)\r\nWARC-Payload-Digest: *sha1:([0-9a-f]{40})", 1).alias("digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload).alias("payload_digest"),
    )


def reachable(offset: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which candidates a chain from the first one (at offset 0) reaches, by pointer jumping.

    ``offset`` ascends; ``following`` has the offset at which a candidate's successor must begin, or -1.
    """
    n = len(offset)
    reached = np.zeros(n + 1, bool)
    if not n or offset[0] != 0:
        return reached[:n]
    at = np.minimum(np.searchsorted(offset, following), n - 1)
    jump = np.append(np.where(offset[at] == following, at, n), n)
    reached[0] = True
    for _ in range(max(1, int(n).bit_length())):
        reached[jump[reached]] = True
        jump = jump[jump]
    return reached[:n]


def _chain(table: pa.Table) -> pa.Table:
    """The reachable records of one archive, in order, with their offsets."""
    table = table.sort_by([("block", "ascending"), ("place", "ascending")])
    size = table.column("bytes").to_numpy()
    # The first piece stands before the first magic.
    offset = np.concatenate([[-len(MAGIC)], np.cumsum(size + len(MAGIC))[:-1] - len(MAGIC)])
    length = table.column("length").fill_null(-1).to_numpy()
    following = np.where(length >= 0, offset + table.column("head_bytes").to_numpy() + length + len(_END), -1)
    end = offset[-1] + len(MAGIC) + size[-1]
    kept = np.flatnonzero(reachable(offset[1:], following[1:])) + 1
    # A record whose block would pass the end of the archive is cut off.
    kept = kept[(length[kept] >= 0) & (following[kept] <= end)]
    out = table.take(pa.array(kept)).append_column("offset", pa.array(offset[kept])).append_column("following", pa.array(following[kept]))
    return out.drop_columns(["bytes", "head_bytes", "length"])


_CHAIN = "file string, block long, place long, whole boolean, record string, type string, refers string, digest string, payload_bytes long, payload_digest string, offset long, following long"


def read(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """The records of the archives under ``path``: page_id, payload figures, type, refers_to, and whether the digest holds."""
    found = scratch.table(_parsed(_pieces(spark, path)).groupBy("file").applyInArrow(_chain, _CHAIN))
    whole = found.filter("whole")
    long = scratch.table(found.filter("not whole"))
    if not long.isEmpty():
        whole = whole.unionByName(_put_together(spark, path, long), allowMissingColumns=True)
    page = F.expr(r"try_cast(regexp_extract(record, '<urn:page:(-?[0-9]+)>', 1) as bigint)")
    refers = F.expr(r"try_cast(regexp_extract(refers, '<urn:page:(-?[0-9]+)>', 1) as bigint)")
    told = whole.select(page.alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), refers.alias("refers_to"), "digest")
    response = told.filter("record_type = 'response'")
    sources = scratch.table(response.groupBy(F.col("page_id").alias("r_page"), F.col("payload_digest").alias("r_digest")).agg(F.max("payload_bytes").alias("r_bytes")))
    revisits = scratch.table(told.filter("record_type = 'revisit'").select("page_id", "refers_to", "digest"))
    back = revisits.join(sources, (F.col("refers_to") == F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left").select(
        "page_id", F.col("r_bytes").alias("payload_bytes"), F.col("r_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to", F.col("r_digest").isNotNull().alias("verified")
    )
    own = response.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), (F.col("payload_digest") == F.col("digest")).alias("verified"))
    return own.unionByName(back)


def _put_together(spark: SparkSession, path: str, long: DataFrame) -> DataFrame:
    """Payload figures of the records that have a magic inside, from all their pieces."""
    files = long.select(F.col("file").alias("f")).distinct()
    pieces = _pieces(spark, path).join(files, F.col("file") == F.col("f"), "left_semi")
    order = W.partitionBy("file").orderBy("block", "place")
    sized = pieces.withColumn("at", F.sum(F.octet_length("value") + len(MAGIC)).over(order) - F.octet_length("value") - 2 * len(MAGIC))
    starts = long.select(F.col("file").alias("f"), F.col("offset"), "following", "record", "type", "refers", "digest")
    marked = sized.join(starts, (F.col("file") == F.col("f")) & (F.col("at") == F.col("offset")), "left")
    own = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    owned = marked.select("file", "at", "value", F.when(F.col("offset").isNotNull(), F.struct("offset", "following", "record", "type", "refers", "digest")).alias("o")).withColumn("o", F.last("o", ignorenulls=True).over(own))
    return owned.filter(F.col("at") < F.col("o.following")).select("file", "at", "value", "o.*").groupBy("file", "offset").applyInArrow(_joined, "record string, type string, refers string, digest string, payload_bytes long, payload_digest string")


def _joined(table: pa.Table) -> pa.Table:


    table = table.sort_by("at")
    whole = MAGIC.encode().join([b"", *table.column("value").cast(pa.binary()).to_pylist()])
    end = table.column("following")[0].as_py() - table.column("offset")[0].as_py() - len(_END)
    head = whole.index(_END.encode()) + len(_END)
    block = whole[head:end]
    http = block.find(_END.encode())
    payload = block[http + len(_END) :] if http >= 0 else block
    one = {c: [table.column(c)[0].as_py()] for c in ("record", "type", "refers", "digest")}
    return pa.table({**one, "payload_bytes": [len(payload)], "payload_digest": [hashlib.sha1(payload).hexdigest()]}, schema=pa.schema([(c, pa.string()) for c in one] + [("payload_bytes", pa.int64()), ("payload_digest", pa.string())]))


def archive_and_read(spark: SparkSession, pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write ``pages`` as WARC archives to the shared folder and return what reading them gives."""
    with Scratch(spark, "warc") as scratch:
        path = scratch.path("archives")
        write(pages, path, scratch, least)
        return scratch.result(read(spark, path, scratch))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS head FROM p),
r AS (SELECT *, strlen(payload) >= 1000 AND page_id IS DISTINCT FROM head AND head IS NOT NULL AS again FROM h)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN head END AS refers_to, true AS verified
FROM r
"""

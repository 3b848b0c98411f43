"""WARC archives written by Spark's own writer and read back by verified chains.

Writing: each page is one record and one line of a text file whose line ending
is the record's ``CRLF CRLF``, so Spark's committer keeps archives whole when
executors are lost. Pages with equal payloads of at least ``min_bytes`` bytes
give one response, of the smallest id, and revisits of it.

Reading: tasks scan byte ranges for the magic and emit each *candidate* record
with the offset of its successor. A payload may hold the magic too, so a
candidate counts only if a chain of successors leads to it from the start of
its file: each range follows its own chains to where they leave it, and pointer
jumping over those exits, doubling each round, finds the one true entry of
every range. Then the reachable records are read and their digests verified.

Payloads are UTF-8 text of any length, URLs and headers too; null counts as
empty. Rows with equal ids and payloads of which that id is the smallest are all
responses; a null id is never the smallest unless all are null. Blanks and
control signs are left out of URLs; a null URL becomes ``urn:page``. Extra
columns are passed by; an empty table gives archives without records. Archives
are read through ``pyarrow.fs``, so their folder is on a local-like mount, HDFS,
S3 (also as ``s3a``) or GCS.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernis.llm.bits import KeyFilter
from quernis.llm.scratch import Scratch

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive that one task scans.
RANGE = 16 << 20
READ = 4 << 20
#: Bytes in which the end of a header is first looked for; it may lie anywhere in the file.
HEADER = 1 << 16


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hexadecimal SHA-1."""
    part = lambda g: F.translate(F.lpad(F.conv(F.substring(hex_digest, 5 * g + 1, 5), 16, 32), 4, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[part(g) for g in range(8)])


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(pages: DataFrame, payload: str = "html", page_id: str = "page_id", url: str = "url", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """``(record)``: the text of each page's record without its closing ``CRLF CRLF``."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.coalesce(F.regexp_replace(F.col(url).cast("string"), r"[\x00-\x20\x7f]", ""), F.lit("urn:page")).alias("url"), body.alias("body"), F.octet_length(body).cast("bigint").alias("bytes"), base32(F.sha1(body)).alias("digest"))
    # Only payloads that occur twice matter, and only a digest, a size and an id of each.
    twice = rows.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    scratch = Scratch(pages.sparkSession, "digests")
    twice = scratch.put("twice", twice)
    pick = KeyFilter(twice.select(F.xxhash64("digest", "bytes").alias("k")), "k", twice.count())

    def sift(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pick.may_hold(b.column(b.num_columns - 1).to_numpy()))], [*b.schema.names[:-1], "may"])

    # Only payloads that may occur twice are moved to be told exactly.
    fields = "page_id bigint, url string, body string, bytes bigint, digest string"
    rows = rows.withColumn("k", F.xxhash64("digest", "bytes")).mapInArrow(sift, f"{fields}, may boolean")
    told = rows.where("may").drop("may").join(twice, ["digest", "bytes"], "left").select("page_id", "url", "body", "bytes", "digest", "first")
    rows = rows.where("not may").drop("may").withColumn("first", F.lit(None).cast("bigint")).union(told)
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("body")))
    head = F.concat(
        F.lit(MAGIC.decode()),
        F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest")),
        F.lit("\r\nWARC-Target-URI: "), F.col("url"), F.lit(f"\r\nWARC-Date: {date}\r\nX-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _record_id(F.col("first"), F.col("digest")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    return rows.select(F.concat(head, block).alias("record"))


def write_archives(rows: DataFrame, folder: str) -> None:
    """Uncompressed archives, one for each task, in ``folder``."""
    rows.select("record").write.option("lineSep", END).text(folder)


def _open(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", path)))
    return store.open_input_file(at)


def _tasks(spark: SparkSession, folder: str) -> int:
    """One task for each ``RANGE`` bytes of archives, whatever few bytes of offsets Spark sees."""
    parts = spark.read.format("binaryFile").load(folder).select(F.sum(F.ceil(F.col("length") / RANGE))).first()[0]
    return int(parts or 0) + 1


def _read(f, begin: int, n: int) -> bytes:
    f.seek(begin)
    return f.read(n)


def _end(f, begin: int, stop: int) -> int:
    """Where the first end of a header from ``begin`` on lies; -1 if none lies before ``stop``."""
    n = HEADER
    while begin < stop:
        raw = _read(f, begin, min(n, stop - begin))
        if (k := raw.find(END.encode())) >= 0:
            return begin + k
        if begin + len(raw) >= stop or len(raw) < len(END):
            return -1
        begin, n = begin + len(raw) - len(END) + 1, READ
    return -1


def _header(raw: bytes) -> tuple[dict[str, str], int] | None:
    end = raw.find(END.encode())
    if end < 0:
        return None
    fields = {}
    for line in raw[len(MAGIC) : end].decode("utf-8", "replace").split("\r\n"):
        name, sep, value = line.partition(":")
        if not sep:
            return None
        fields[name.strip().lower()] = value.strip()
    return (fields, end + 4) if fields.get("content-length", "").isdigit() else None


def candidates(spark: SparkSession, folder: str, span: int = RANGE) -> DataFrame:
    """``(path, size, part, offset, next, exit)``: every magic with a well-formed header whose record fits its file.

    ``next`` is the successor's offset, ``exit`` where the chain from here leaves the range of ``span`` bytes.
    """
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", F.col("length").alias("size"))
    parts = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(size - 1) div {span}"))).alias("part"))
    parts = parts.repartition(_tasks(spark, folder), "path", "part")

    def scan(frames):
        for frame in frames:
            for path, size, part in frame.itertuples(index=False):
                rows = {}
                with _open(path) as f:
                    stop = min((part + 1) * span, size)
                    # The first end from ``sought`` on: it serves every candidate before it.
                    sought, end = 0, -2
                    for at in range(part * span, stop, READ):
                        raw = _read(f, at, READ + len(MAGIC) - 1)
                        for m in re.finditer(re.escape(MAGIC), raw):
                            p = at + m.start()
                            if p >= stop:
                                continue
                            head = raw[m.start() : m.start() + HEADER]
                            if head.find(END.encode()) < 0:
                                if end == -2 or (end >= 0 and not sought <= p <= end):
                                    sought, end = p, _end(f, p, size)
                                if end < 0:
                                    continue
                                head = _read(f, p, end + len(END) - p)
                            if (got := _header(head)) and (after := p + got[1] + int(got[0]["content-length"]) + 4) <= size:
                                rows[p] = after
                exits = {}
                for p in sorted(rows, reverse=True):
                    exits[p] = exits.get(rows[p], rows[p])
                for p, after in rows.items():
                    yield path, size, part, p, after, exits[p]

    def batches(frames):
        out = []
        for row in scan(frames):
            out.append(row)
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=["path", "size", "part", "offset", "next", "exit"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["path", "size", "part", "offset", "next", "exit"])

    return parts.mapInPandas(batches, "path string, size bigint, part bigint, offset bigint, next bigint, exit bigint")


def reachable_entries(scratch: Scratch, found: DataFrame) -> DataFrame:
    """``(path, entry)``: the offsets at which true chains enter ranges, by pointer jumping from each file's start."""
    targets = found.select("path", F.col("exit").alias("offset")).distinct()
    links = found.select("path", "offset", "exit")
    jump = links.join(targets, ["path", "offset"], "left_semi").union(links.where("offset = 0")).distinct()
    jump = scratch.put("jump", jump)
    reached = scratch.put("reached", jump.where("offset = 0").select("path", F.col("offset").alias("entry")))
    n = reached.count()
    while True:
        ahead = reached.join(jump.withColumnRenamed("offset", "entry"), ["path", "entry"]).select("path", F.col("exit").alias("entry"))
        new = scratch.put("reached", reached.union(ahead).distinct())
        grown = new.count()
        scratch.drop(reached)
        reached = new
        if grown == n:
            return reached
        n = grown
        # Twice as far: the exit of the exit. A chain that has ended stays where it is.
        then = jump.select("path", F.col("offset").alias("exit"), F.col("exit").alias("further"))
        longer = scratch.put("jump", jump.join(then, ["path", "exit"], "left").select("path", "offset", F.coalesce("further", "exit").alias("exit")))
        scratch.drop(jump)
        jump = longer


RECORDS = "path string, offset bigint, length bigint, type string, record_id string, refers_to string, page_id bigint, url string, payload_bytes bigint, payload_digest string, digest_ok boolean"


def read_archives(spark: SparkSession, folder: str, span: int = RANGE, scratch: Scratch | None = None) -> DataFrame:
    """The true records of all archives in ``folder``: see ``RECORDS``.

    ``payload_digest`` is as the header states it; ``digest_ok`` whether the
    payload of a response has it. A revisit has no payload of its own.
    """
    scratch = scratch or Scratch(spark, "warc")
    found = scratch.put("candidates", candidates(spark, folder, span))
    entries = reachable_entries(scratch, found)
    true_from = entries.join(found.select("path", F.col("offset").alias("entry"), "part"), ["path", "entry"])
    rows = found.join(true_from.select("path", "part", "entry"), ["path", "part"]).select("path", "part", "offset", "next", "entry")

    def walk(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        after = dict(zip(frame["offset"], frame["next"], strict=True))
        out = []
        with _open(key[0]) as f:
            # One entry in a sound file; chains that meet are walked once.
            seen = set()
            for at in sorted(set(frame["entry"])):
                while at in after and at not in seen:
                    seen.add(at)
                    out.append(_record(f, key[0], at, after[at]))
                    at = after[at]
        return pd.DataFrame(out, columns=[c.split()[0] for c in RECORDS.split(", ")])

    return rows.repartition(_tasks(spark, folder), "path", "part").groupBy("path", "part").applyInPandas(walk, RECORDS)


def whole(spark: SparkSession, folder: str, read: DataFrame) -> DataFrame:
    """``read``, the records of ``folder``; fails if an archive's chain does not reach the end of its file."""
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", F.col("length").alias("size"))
    ends = read.groupBy("path").agg(F.max(F.col("offset") + F.col("length")).alias("end"))
    torn = files.join(ends, "path", "left").where(~F.col("end").eqNullSafe(F.col("size"))).select("path", "end").limit(5).collect()
    if torn:
        raise ValueError("archives are not read to their end: " + ", ".join(f"{r.path} at {r.end or 0}" for r in torn))
    return read


def _record(f, path: str, at: int, after: int) -> tuple:
    fields, skip = _header(_read(f, at, _end(f, at, after) + len(END) - at))
    digest, n, ok = fields.get("warc-payload-digest", "").removeprefix("sha1:"), None, None
    if fields.get("warc-type") == "response":
        begin, end = at + skip, after - 4
        http = _end(f, begin, end)
        begin = http + len(END) if http >= 0 else begin
        n, sha = end - begin, hashlib.sha1()
        for k in range(begin, end, READ):
            sha.update(_read(f, k, min(READ, end - k)))
        ok = base64.b32encode(sha.digest()).decode() == digest
    page = fields.get("x-page-id", "null")
    return path, at, after - at, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-refers-to"), int(page) if re.fullmatch(r"-?\d+", page) else None, fields.get("warc-target-uri"), n, digest, ok


def resolved(read: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)``: revisits take size and id of their response."""
    revisits = read.where("type = 'revisit'").select("page_id", "payload_digest", "refers_to")
    first = read.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.first("payload_bytes").alias("payload_bytes"), F.first("page_id").alias("first"))
    again = revisits.join(first, "refers_to").select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), F.col("first").alias("refers_to"))
    own = read.where("type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    return own.union(again)

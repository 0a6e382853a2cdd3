"""WARC archives: writing with revisit records, reading by boundary-chain verification.

Writing. Records are strings; Spark's text writer, with the record separator as
its line separator, turns them into WARC/1.1 files of bounded record number in
any store that Spark writes. Of pages with equal payloads the one with the
smallest page_id carries the payload, the others revisit it.

Reading. A payload may contain the magic of a record. Spark's text reader, with
the magic as its line separator, deals files out in byte ranges, so each line is
what follows one occurrence of the magic, and no file or range is held whole.

1. `candidates`: tasks emit, for every line that can be a record, its offset and
   that of its successor. Within a range the chain is shortened at once: an
   offset points to where its chain leaves the range.
2. `chain`: pointer jumping from the file start, which doubles the jump twice a
   round, finds the offset at which the chain enters each range. It takes rounds
   only where files have many ranges.
3. `read_archives` walks each range from there. What lies between is payload. A
   record that crosses ranges is put together from its parts.

Offsets in a range start with the range's first line; the lengths of all ranges
before it, a number each, give their place in the file.

Defined results: a null html is an empty payload; a null url is written empty;
pages with a null page_id are responses unless another page with the payload
has an id; rows that repeat a page are each written, all as what that page is;
an empty table gives an empty table; extra columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut, fresh_path, table

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
#: Duplicated payloads (a digest and an id each) are broadcast up to this number, joined with a salted shuffle beyond.
BROADCAST_ROWS = 200_000
SALTS = 16
# The base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(sha: Column) -> Column:
    """A hexadecimal SHA-1 in bare upper-case base32: 160 bits are four groups of 40, eight letters each."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda g: F.conv(F.substring(sha, g * 10 + 1, F.lit(10)), 16, 10).cast("long"))
    letter = lambda v, k: F.substring(F.lit(BASE32), F.lit(1) + F.pmod(F.floor(v / F.lit(1 << (35 - 5 * k))), F.lit(32)).cast("int"), F.lit(1))
    return F.array_join(F.transform(groups, lambda v: F.concat(*(letter(v, k) for k in range(8)))), "")


def plan_records(pages: DataFrame) -> DataFrame:
    """`pages` (page_id, url, html) with payload, digest, record_type and refers_to."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("__w_sha", F.sha1("payload"))
    twice = rows.groupBy("__w_sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    twice = cut(twice, "payloads")
    if twice.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(twice), "__w_sha", "left")
    else:
        salted = twice.withColumn("__w_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__w_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["__w_sha", "__w_salt"], "left")
    revisit = F.coalesce(F.col("first") < F.col("page_id"), F.col("first").isNotNull() & F.col("page_id").isNull())
    return rows.select(
        "page_id",
        "url",
        "payload",
        base32(F.col("__w_sha")).alias("digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, path: str, per_file: int = 1024, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per page below `path`, at most `per_file` records a file."""
    rows = plan_records(pages)
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(END),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    rows = rows.withColumn("block", http)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), urn("page_id"),
        F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " "),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn("refers_to"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"),
        F.lit(END), F.col("block"),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


CANDIDATE = "path string, block long, off long, succ long, total long"
RECORD = "path string, off long, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, intact boolean"
PART = RECORD + ", need long, at long, part binary"
_CANDIDATE = pa.schema([("path", pa.string()), ("block", pa.int64()), ("off", pa.int64()), ("succ", pa.int64()), ("total", pa.int64())])
_RECORD = [
    ("path", pa.string()), ("off", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()),
]
_PART = pa.schema([*_RECORD, ("need", pa.int64()), ("at", pa.int64()), ("part", pa.binary())])
_MARK = len(MAGIC)
#: Ranges whose entries are broadcast at once; files with more are read a share at a time.
BROADCAST_RANGES = 200_000


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n") if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def _page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def _head(line: bytes) -> tuple[dict[str, str], int, int] | None:
    """(fields, where the block begins in the line, its length) of a line that can be a record, None of others."""
    end = line.find(b"\r\n\r\n")
    fields = _fields(line[:end]) if end >= 0 else {}
    return (fields, end + 4, int(fields["content-length"])) if fields.get("content-length", "").isdecimal() else None


def _record(path: str, off: int, fields: dict[str, str], block: bytes) -> tuple:
    """The columns of RECORD of a record and its whole block."""
    digest, size, intact = fields.get("warc-payload-digest", "").removeprefix("sha1:"), None, None
    end = block.find(b"\r\n\r\n")
    if end >= 0:
        length = _fields(block[:end]).get("content-length", "")
        size = int(length) if length.isdecimal() else None
        if fields.get("warc-type") != "revisit":
            payload = block[end + 4 :]
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            intact, size, digest = found == digest and size == len(payload), len(payload), found
    return path, off, _page(fields.get("warc-record-id")), fields.get("warc-type"), _page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), size, digest, intact


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, path, block, size): what follows each magic of the files below `path`, in order within a range; a file's first line is what stands before its first magic."""
    text = spark.read.option("lineSep", MAGIC.decode()).option("recursiveFileLookup", "true").text(path)
    meta = F.col("_metadata")
    return text.select(F.col("value").cast("binary").alias("value"), meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"))


def _ranges(batches, columns: int):
    """(key, offset in the range, line) of lines; the key holds all other columns. At the end of a range the line is None and the offset its length."""
    key, at = None, 0
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in range(1, columns)), strict=True))
        for line, now in zip(batch.column(0), rows, strict=True):
            if now != key:
                if key is not None:
                    yield key, at, None
                key, at = now, 0
            line = line.as_py()
            yield key, at, line
            at += len(line) + _MARK
    if key is not None:
        yield key, at, None


def _emit(batches):
    offs: list[int] = []
    succs: list[int] = []
    for (path, block, _), at, line in _ranges(batches, 4):
        if line is not None:
            if (at or block) and (head := _head(line)):
                offs.append(at - _MARK)
                succs.append(at + head[1] + head[2] + 4)
            continue
        off, succ = np.array(offs, np.int64), np.array(succs, np.int64)
        place = np.searchsorted(off, succ)
        inside = (place < len(off)) & (off[np.minimum(place, len(off) - 1)] == succ) if len(off) else np.zeros(0, bool)
        jump = np.where(inside, place, np.arange(len(off)))
        while len(jump) and not np.array_equal(then := jump[jump], jump):
            jump = then
        yield pa.RecordBatch.from_arrays([pa.array([path] * (len(off) + 1)), pa.array([block] * (len(off) + 1), pa.int64()), pa.array([*off.tolist(), None], pa.int64()), pa.array([*(succ[jump].tolist() if len(off) else []), None], pa.int64()), pa.array([None] * len(off) + [at], pa.int64())], schema=_CANDIDATE)
        offs, succs = [], []


def candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((path, block, off, succ) of every place where a record may start, succ being where its chain leaves the range; (path, block, base) of the ranges)."""
    found = cut(lines(spark, path).mapInArrow(_emit, CANDIDATE), "candidates")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the magic before a range's first line is the last thing of the range before, except at the start of a file
    ranges = cut(found.where("off is null").select("path", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "ranges")
    placed = found.where("off is not null").join(ranges, ["path", "block"])
    return placed.select("path", "block", (F.col("off") + F.col("base")).alias("off"), (F.col("succ") + F.col("base")).alias("succ")), ranges


def chain(found: DataFrame) -> DataFrame:
    """(path, off) of the candidates that are reachable from the start of their file.

    A round joins the jumps with themselves twice, so it advances four times as
    far as the round before; what a round gives is written, so plans stay small.
    """
    jumps = found.select("path", F.col("off").alias("a"), F.col("succ").alias("b"))
    # most jumps leave their file; only those that land on a candidate go on
    jumps = cut(jumps.join(found.select("path", F.col("off").alias("b")), ["path", "b"], "left_semi").select("path", "a", "b"), "jumps")
    reached = found.where("off = 0").select("path", F.col("off").alias("a"))

    def then(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(y.select("path", F.col("a").alias("b"), F.col("b").alias("c")), ["path", "b"]).select("path", "a", F.col("c").alias("b"))

    def go(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(y, ["path", "a"]).select("path", F.col("b").alias("a"))

    while not jumps.isEmpty():
        two = cut(then(jumps, jumps), "jumps2")
        reached = cut(reached.unionByName(go(reached, jumps)).unionByName(go(reached, two)).unionByName(go(go(reached, jumps), two)), "reached")
        jumps = cut(then(two, two), "jumps4")
    return reached.withColumnRenamed("a", "off")


def _walk(batches):
    """Records of ranges, given where the chain enters each; of a record that leaves its range the head, of one that came in the tail."""
    rows: list[tuple] = []
    held: list[bytes] = []  # the block so far
    open_, need, size_held, fresh, begin = None, 0, 0, True, None  # open_: (off, fields)

    def put(row, at=None, part=None, need=None):
        rows.append((*row, need, at, part))

    def batch():
        nonlocal rows
        out, rows = rows, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PART, strict=True)], schema=_PART)

    for (path, block, size, base, entry), at, line in _ranges(batches, 6):
        if fresh:
            next_, fresh = entry, False
        if line is None:
            if open_:
                off, fields = open_
                put(_record(path, off, fields, b""), at=begin, part=b"".join(held), need=need)
            elif held:
                put((path, *[None] * 8), at=begin, part=b"".join(held))
            held, open_, fresh, size_held = [], None, True, 0
            if rows:
                yield batch()
            continue
        first = not at and not block  # what stands before the first magic of a file
        off = base + at - _MARK
        if open_:
            held.append(MAGIC + line)
            size_held += _MARK + len(line)
        elif not first and off == next_ and (head := _head(line)):
            fields, start, need = head
            if held:  # what came in from the ranges before
                put((path, *[None] * 8), at=begin, part=b"".join(held))
            open_, held, begin = (off, fields), [line[start:]], base + at + start
            size_held = len(line) - start
            next_ = begin + need + 4
        elif not first and (next_ is None or off < next_) and (entry is None or off < entry):
            begin = off if not held else begin
            held.append(MAGIC + line)
        if open_ and size_held >= need:
            if next_ <= size:
                put(_record(path, open_[0], open_[1], b"".join(held)[:need]))
            held, open_, size_held = [], None, 0
            if len(rows) >= 2048:
                yield batch()
    if rows:
        yield batch()


def _joined(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            data = b"".join(x["part"] for x in sorted(r["parts"], key=lambda x: x["at"]))
            if len(data) >= r["need"]:
                fields = {"warc-type": r["record_type"], "warc-payload-digest": r["payload_digest"], "warc-target-uri": r["url"]}
                got = _record(r["path"], r["off"], {k: v or "" for k, v in fields.items()}, data[: r["need"]])
                out.append((r["path"], r["off"], r["page_id"], r["record_type"], r["refers_to"], r["url"], *got[6:]))
        if out:
            schema = pa.schema(_RECORD)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The verified records below `path`, one row each (columns of RECORD)."""
    found, ranges = candidates(spark, path)
    entered = chain(found).join(found.select("path", "block", "off"), ["path", "off"]).groupBy("path", "block").agg(F.min("off").alias("entry"))
    entries = cut(ranges.join(entered, ["path", "block"], "left"), "entries")
    shares = -(-entries.count() // BROADCAST_RANGES) or 1
    share = F.pmod(F.xxhash64("path"), F.lit(shares))
    walked = []
    for k in range(shares):
        rows = lines(spark, path).where(share == k).join(F.broadcast(entries.where(share == k)), ["path", "block"])
        walked.append(rows.select("value", "path", "block", "size", "base", "entry").mapInArrow(_walk, PART))
    rows = cut(reduce(DataFrame.unionByName, walked), "walked")
    names = [n for n, _ in _RECORD]
    # of a part, the record is the last head at or before it
    parts = rows.where("at is not null").withColumn("owner", F.max(F.when(F.col("need").isNotNull(), F.col("off"))).over(Window.partitionBy("path").orderBy("at")))
    first = lambda n: F.max(F.when(F.col("need").isNotNull(), F.col(n))).alias(n)
    crossing = parts.where("owner is not null").groupBy("path", "owner").agg(*(first(n) for n in names[1:]), F.max("need").alias("need"), F.collect_list(F.struct("at", "part")).alias("parts"))
    return rows.where("at is null").select(names).unionByName(crossing.select("path", *names[1:], "need", "parts").mapInArrow(_joined, RECORD))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha1(t) AS x FROM p),
d AS (SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY x) AS f,
      array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (1 + ((('0x' || substr(x, ((i // 8) * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31))::INT, 1)), '') AS payload_digest FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to, CASE WHEN page_id = f THEN true END AS intact
FROM d
"""

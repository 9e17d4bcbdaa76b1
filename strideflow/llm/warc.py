"""WARC archives: written as text rows whose separator ends a record, read back by verified record chains."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, mapped, store

MAGIC, GAP = "WARC/1.0\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
#: Payloads of fewer bytes are never replaced by a reference.
LEAST_BYTES = 0


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: 160 bits are 8 groups of 4 letters."""
    digits = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write a record per row of (page_id, url, html) to uncompressed archives, one file per task.

    Of equal payloads of at least ``least_bytes`` the one with the smallest page_id is a response, the
    others are revisits that refer to it and hold no payload.  Null html is an empty payload, null url is
    left out, rows without a page_id are responses.  The text writer ends each row with the blank lines
    that end a record, so the files are plain archives on any file system Spark can write.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload")).withColumn("digest", sha1_base32(F.col("payload").cast("binary")))
    first = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # only payloads that come twice: where they are few, the pages themselves are not shuffled
    first = store(first.filter("n > 1").select(F.col("digest").alias("_digest"), F.col("bytes").alias("_bytes"), "first"), "warc-first")
    rows = rows.join(bounded(first), (F.col("digest") == F.col("_digest")) & (F.col("bytes") == F.col("_bytes")), "left")
    again = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def name(page: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(GAP))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    record = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        F.coalesce(line("WARC-Record-ID", name(F.col("page_id"))), F.lit("")), line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "")), F.lit("")),
        F.when(again, line("WARC-Refers-To", name(F.col("first")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block,
    )
    rows.select(record.alias("value")).write.option("lineSep", GAP).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at the magic: the rows of a (file, block) come in order and all in one task."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), "value",
    )


def _head(value: Column) -> Column:
    return F.substring_index(value, GAP, 1)


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", F.trim(found))


def _needed(value: Column) -> Column:
    """Bytes from the end of the magic to the end of the record; null if that can't be read."""
    length = F.regexp_extract(_head(value), r"(?i)(?:^|\r\n)Content-Length:[ \t]*(\d{1,17})[ \t]*(?:\r\n|$)", 1)
    length = F.when(length != "", length.cast("long"))
    return F.octet_length(_head(value)) + 2 * len(GAP) + length


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Consecutive batches of one (file, block)."""
    held, key = [], None
    for batch in batches:
        file, block = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
        for first, last in zip([0, *cuts], [*cuts, len(file)]):
            if first == last:
                continue
            if key != (file[first], block[first]):
                if held:
                    yield key, held
                held, key = [], (file[first], block[first])
            held.append(batch.slice(first, last - first))
    if held:
        yield key, held


_LINKS = "file long, block long, at long, length long, next long, leaves long"


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of each block with their successors, and where the chain from each leaves the block.

    Places are relative to the block.  ``length`` is what the segment takes with its magic; ``next`` is
    null for the piece in front of the first magic of a file; ``leaves`` is null where the chain breaks.
    """
    magic = len(MAGIC)
    for (file, block), parts in _blocks(batches):
        bytes_, needed = (np.concatenate([p.column(i).fill_null(-1).to_numpy(zero_copy_only=False) for p in parts]) for i in (2, 3))
        length = bytes_ + magic
        at = np.concatenate([[0], np.cumsum(length)[:-1]]) - magic
        candidate = needed >= 0
        if block == 0:
            candidate[0] = False
        nxt = np.where(candidate, at + magic + needed, -1)
        place = {int(a): i for i, a in enumerate(at) if candidate[i]}
        end, leaves = int(at[-1]) + int(length[-1]), np.full(len(at), -1)
        for i in range(len(at) - 1, -1, -1):
            if candidate[i]:
                n = int(nxt[i])
                leaves[i] = n if n >= end else leaves[place[n]] if n in place else -1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(at), file)), pa.array(np.full(len(at), block)), pa.array(at), pa.array(length),
                pa.array(nxt, mask=~candidate), pa.array(leaves, mask=leaves < 0),
            ],
            [f.split()[0] for f in _LINKS.split(", ")],
        )


def _walk(key: tuple, table: pa.Table) -> pa.Table:
    """Marks the records of one block from its entry on; the others get the record they lie in, if it begins here."""
    table = table.sort_by("at")
    at, nxt, entry = (table.column(c).to_pylist() for c in ("at", "next", "entry"))
    here, owner = entry[0], [None] * len(at)
    inside = None
    for i, a in enumerate(at):
        if here is not None and a == here and nxt[i] is not None:
            inside, here = a, nxt[i]
        owner[i] = inside
    n = len(at)
    return pa.table({"file": pa.array([key[0].as_py()] * n, pa.int64()), "block": pa.array([key[1].as_py()] * n, pa.int64()), "at": pa.array(at, pa.int64()), "owner": pa.array(owner, pa.int64())})


def record_places(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All candidates with the record that each belongs to, and the first byte of each block.

    Tasks emit the candidates of their block with the offset of the successor.  Inside a block a chain is
    followed at once; between blocks pointer jumping from the start of each file doubles its reach every
    round.  A magic inside a payload is no successor of anything reachable, so it is part of its record.
    The first table has ``file``, ``block``, ``at``, ``owner`` (both absolute) and ``needed``.
    """
    value = F.col("value")
    narrow = _segments(spark, path).select("file", "block", F.octet_length(value).cast("long").alias("bytes"), _needed(value).alias("needed"))
    table = store(narrow.mapInArrow(_link, _LINKS), "warc-links")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = table.groupBy("file", "block").agg(F.sum("length").alias("_n"))
    bases = store(totals.select("file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("base")), "warc-blocks")
    placed = table.join(bounded(bases), ["file", "block"])
    jumps = placed.filter("leaves is not null").select("file", (F.col("base") + F.col("at")).alias("place"), (F.col("base") + F.col("leaves")).alias("to"))
    reached = placed.filter("next is not null and base + at = 0").select("file", F.lit(0).cast("long").alias("place"))
    known = reached = store(reached, "warc-reached")
    count = known.count()
    nodes = placed.filter("next is not null").select("file", (F.col("base") + F.col("at")).alias("place"))
    while True:
        steps = known.join(jumps, ["file", "place"]).select("file", F.col("to").alias("place")).join(nodes, ["file", "place"], "left_semi")
        known = store(known.union(steps).distinct(), "warc-reached")
        more = known.count()
        if more == count:
            break
        count = more
        far = jumps.select("file", F.col("place").alias("to"), F.col("to").alias("_far"))
        jumps = store(jumps.join(far, ["file", "to"]).select("file", "place", F.col("_far").alias("to")), "warc-jumps")
    entries = known.withColumnRenamed("place", "entry")
    blocks = placed.select("file", "block", "base", "at", F.when(F.col("next").isNotNull(), F.col("base") + F.col("next")).alias("next"))
    blocks = blocks.withColumn("at", F.col("base") + F.col("at"))
    entered = blocks.join(entries, (blocks.file == entries.file) & (blocks.at == entries.entry)).groupBy(blocks.file, "block").agg(F.min("entry").alias("entry"))
    walked = blocks.join(bounded(entered), ["file", "block"], "left").groupBy("file", "block").applyInArrow(_walk, "file long, block long, at long, owner long")
    walked = store(walked, "warc-walked")
    carried = walked.groupBy("file", "block").agg(F.max("owner").alias("_last"))
    carried = carried.select("file", "block", F.last("_last", True).over(before).alias("_carry"))
    owned = walked.join(bounded(carried), ["file", "block"], "left").select("file", "at", F.coalesce("owner", "_carry").alias("owner"))
    return owned, bases


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under ``path``: ``type``, ``record_id``, ``target_uri``, ``date``, ``refers_to``, ``digest``, ``payload`` (binary) and ``payload_length`` as its HTTP header says.

    Files are split anywhere; a record may span splits.  Bytes that no chain from the start of a file
    reaches are left out, as is a last record that the file cuts short.  An empty folder gives no rows.
    """
    owned, bases = record_places(spark, path)
    magic = len(MAGIC)
    odd = owned.filter("owner is null or owner <> at")
    several = odd.filter("owner is not null").select("file", F.col("owner").alias("at")).distinct().withColumn("owner", F.col("at"))
    special = store(odd.union(several.select("file", "at", "owner")).select("file", F.col("at").alias("_at"), "owner"), "warc-odd")

    def positioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at = None, 0
        for batch in batches:
            file, block, bytes_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            place = np.zeros(len(file), np.int64)
            cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
            for first, last in zip([0, *cuts], [*cuts, len(file)]):
                if first == last:
                    continue
                if key != (file[first], block[first]):
                    key, at = (file[first], block[first]), -magic
                run = np.cumsum(bytes_[first:last] + magic)
                place[first:last] = at + run - bytes_[first:last] - magic
                at += int(run[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(place)], ["file", "block", "size", "value", "at"])

    rows = _segments(spark, path).select("file", "block", F.octet_length("value").cast("long").alias("bytes"), "size", F.col("value").cast("binary").alias("value"))
    rows = mapped(rows, positioned, "file long, block long, size long, value binary, at long").withColumn("value", F.col("value").cast("string"))
    rows = rows.join(bounded(bases), ["file", "block"]).select("file", (F.col("base") + F.col("at")).alias("at"), "size", "value").filter("at >= 0")
    if special.isEmpty():
        whole = rows
    else:
        marked = rows.join(bounded(special), (rows.file == special.file) & (rows.at == F.col("_at")), "left").select(rows.file, "at", "size", "value", "_at", "owner")
        parts = marked.filter("owner is not null").groupBy("file", "owner").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("at", "value"))).alias("_parts"))
        joined = F.array_join(F.transform("_parts", lambda x: x["value"]), MAGIC)
        whole = marked.filter("_at is null").select("file", "at", "size", "value").union(parts.select("file", F.col("owner").alias("at"), "size", joined.alias("value")))
    head, value = _head(F.col("value")), F.col("value")
    whole = whole.filter(F.col("at") + magic + _needed(value) <= F.col("size"))
    block = F.substring(value.cast("binary"), F.octet_length(head) + len(GAP) + 1, (_needed(value) - F.octet_length(head) - 2 * len(GAP)).cast("int"))
    whole = whole.select(head.alias("head"), block.cast("string").alias("block"))
    http = _head(F.col("block"))
    return whole.select(
        _field(F.col("head"), "WARC-Type").alias("type"), _field(F.col("head"), "WARC-Record-ID").alias("record_id"),
        _field(F.col("head"), "WARC-Target-URI").alias("target_uri"), _field(F.col("head"), "WARC-Date").alias("date"),
        _field(F.col("head"), "WARC-Refers-To").alias("refers_to"), _field(F.col("head"), "WARC-Payload-Digest").alias("digest"),
        F.substring(F.col("block").cast("binary"), F.octet_length(http) + len(GAP) + 1, F.octet_length("block")).alias("payload"),
        _field(http, "Content-Length").cast("long").alias("payload_length"),
    )

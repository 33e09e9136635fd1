"""WARC archives: writing, and reading by boundary-chain verification.

Archives are read as splittable text with the record magic as line separator,
so every task sees the pieces between magics of its file blocks.  Each piece
that parses as a record header is a candidate and names the offset of its
successor.  Inside a block the candidate chains are followed at once to where
they leave the block; between blocks, pointer jumping from the file start
finds the entry of every block.  Only candidates on the chain from offset 0
are records; magic inside payloads is rejected and its pieces are put back
into the payload that holds them.

A payload is written once, as the response of the smallest page_id that has
it; its other pages are revisit records without a body, which name that page
and state the length and digest of the whole payload.

Defined results: a null payload is empty; a null URL is written as an empty
target; line breaks in a URL become spaces; repeated rows give repeated
records; rows without a numeric page_id are always responses; an empty table gives no records; other columns are ignored.  A file
whose first record does not parse yields nothing, and a broken chain ends the
file's records there.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codesift.session import ensure_checkpoint_dir

from .common import columns, texts_of, written

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
# Bits of the bitmap that keeps payloads of one page out of the shuffle (4 MiB).
MARKS = 1 << 25
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                   date: str = "2024-01-01T00:00:00Z", records_per_file: int = 20_000) -> None:
    """One record per row, in files of at most ``records_per_file`` records: a
    response for the smallest page_id of each payload, else a revisit."""
    d = columns(pages, page_id=page_id, url=url, payload=payload)
    body = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    clean = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", " ")
    d = d.select(F.col("page_id").cast("string").alias("page_id"), F.expr("try_cast(page_id as bigint)").alias("number"), clean.alias("url"),
                 body.alias("body"), F.sha1(body.cast("binary")).alias("digest"))
    # only payloads of several pages, and a few that share a mark with them, are moved to be looked up
    first = d.groupBy("digest").agg(F.min("number").alias("first"), F.max("number").alias("last")) \
        .filter("first < last").select("digest", "first")
    first = written(first, "first")
    marked = _marked(first)
    alone = d.filter(~marked("digest")).withColumn("first", F.lit(None).cast("long"))
    d = d.filter(marked("digest")).join(first.hint("shuffle_hash"), "digest", "left").unionByName(alone) \
        .withColumn("again", F.coalesce(F.col("number") != F.col("first"), F.lit(False)))
    common = F.concat(
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce("page_id", F.lit("")), F.lit(">\r\nWARC-Target-URI: "), "url",
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), "digest")
    length = F.octet_length("body").cast("string")
    response = F.concat(F.lit(f"{MAGIC}WARC-Type: response"), common,
                        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), length, F.lit(END), "body")
    revisit = F.concat(F.lit(f"{MAGIC}WARC-Type: revisit"), common, F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"),
                       F.col("first").cast("string"), F.lit(">\r\nWARC-Payload-Length: "), length, F.lit(f"\r\nContent-Length: 0{END}"))
    d.select(F.when(F.col("again"), revisit).otherwise(response).alias("value")).write.option("lineSep", END) \
        .option("maxRecordsPerFile", records_per_file).text(path)


def _marked(keys: DataFrame):
    """A test that holds for every digest in ``keys`` and few others, by a
    bitmap of bounded size."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
    set_words = keys.select(place("digest").alias("at")).groupBy(F.shiftright("at", 6).alias("word")) \
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(MARKS // 64, np.int64)
    bitmap[set_words.column("word").to_numpy()] = set_words.column("bits").to_numpy()

    @F.arrow_udf("boolean")
    def test(at: pa.Array) -> pa.Array:
        at = at.to_numpy(zero_copy_only=False)
        return pa.array((bitmap[at >> 6] >> (at & 63)) & 1 == 1)

    return lambda c: test(place(c))


HEADER = re.compile(rb"((?:[A-Za-z0-9\-]+:[^\r\n]*\r\n)*?(?:[A-Za-z0-9\-]+:[^\r\n]*))\r\n\r\n")


def parse_header(piece: bytes) -> tuple[dict, int] | None:
    """Header fields and the length of the header with its blank line."""
    m = HEADER.match(piece)
    if m is None:
        return None
    fields = {}
    for line in m.group(1).split(b"\r\n"):
        k, _, v = line.partition(b":")
        fields[k.strip().lower()] = v.strip()
    if not re.fullmatch(rb"\d+", fields.get(b"content-length", b"")):
        return None
    return fields, m.end()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def stated_payload(fields: dict) -> tuple[str | None, int | None]:
    """Payload digest (base32) and length that a revisit record states."""
    algorithm, _, value = fields.get(b"warc-payload-digest", b"").partition(b":")
    digest = None
    if algorithm.lower() == b"sha1":
        if re.fullmatch(rb"[0-9A-Fa-f]{40}", value):
            digest = base64.b32encode(bytes.fromhex(value.decode())).decode()
        elif re.fullmatch(rb"[A-Za-z2-7]{32}", value):
            digest = value.decode().upper()
    length = fields.get(b"warc-payload-length", b"")
    return digest, int(length) if re.fullmatch(rb"\d+", length) else None


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.col("value").cast("binary").alias("value")))


SEP = len(MAGIC)


def _placed(it):
    """(file, block, place in the block, piece) with places counted from the
    block's first piece."""
    at = {}
    for batch in it:
        for file, block, value in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(),
                                      texts_of(batch.column("value"))):
            rel = at.get((file, block), 0)
            if not rel:
                at.clear()                     # a task reads one block after another
            at[file, block] = rel + len(value) + SEP
            yield file, block, rel, value


CANDIDATES = ("file string, block bigint, rel bigint, size bigint, head bigint, length bigint, succ bigint,"
              " leaves bigint, record_id string, digest string, declared string, type string, uri string,"
              " refers_to string, stated_digest string, stated_length bigint")


def _candidates(it):
    """Pieces of each block with what their header says and where the chain
    that starts at them leaves the block (relative to the block's start)."""
    names = [c.strip().split()[0] for c in CANDIDATES.split(",")]

    def flush(rows):
        where = {r["rel"] - SEP: i for i, r in enumerate(rows) if r["succ"] is not None}
        end = rows[-1]["rel"] + rows[-1]["size"]
        for r in reversed(rows):
            if r["succ"] is None:
                r["leaves"] = None
            elif r["succ"] in where:
                r["leaves"] = rows[where[r["succ"]]]["leaves"]
            else:
                r["leaves"] = r["succ"] if r["succ"] >= end else None    # else: inside, but no record there
        return pa.RecordBatch.from_pylist(rows, SCHEMA)

    kinds = {"string": pa.string(), "bigint": pa.int64()}
    SCHEMA = pa.schema([(c.strip().split()[0], kinds[c.strip().split()[1]]) for c in CANDIDATES.split(",")])
    rows, here = [], None
    for file, block, rel, value in _placed(it):
        if rows and here != (file, block):
            yield flush(rows)
            rows = []
        here = (file, block)
        row = dict.fromkeys(names) | {"file": file, "block": block, "rel": rel, "size": len(value)}
        # the first piece of a file has no magic before it
        parsed = None if block == 0 and rel == 0 else parse_header(value)
        if parsed:
            fields, head = parsed
            n = int(fields[b"content-length"])
            row |= {"head": head, "length": n, "succ": rel + head + n + len(END),
                    "declared": fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace"),
                    "type": fields.get(b"warc-type", b"").decode("utf-8", "replace"),
                    "uri": fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"),
                    "record_id": fields.get(b"warc-record-id", b"").decode("utf-8", "replace")}
            if row["type"] == "revisit":
                row["refers_to"] = fields.get(b"warc-refers-to", b"").decode("utf-8", "replace")
                row["stated_digest"], row["stated_length"] = stated_payload(fields)
            if head + n <= len(value):
                row["digest"] = payload_digest(value[head:head + n])
        rows.append(row)
    if rows:
        yield flush(rows)


def _entries(cands: DataFrame) -> DataFrame:
    """(file, off) of the first true record of every block, by pointer jumping
    over the offsets at which chains leave their blocks."""
    nodes = cands.filter("leaves_at is not null").select("file", "off", F.col("leaves_at").alias("to"))
    start = nodes.filter("off = 0").select("file", "off")
    # only offsets that some chain leaves to (and file starts) can be entries
    targets = nodes.select("file", F.col("to").alias("off")).union(start).distinct()
    jump = written(nodes.join(targets, ["file", "off"], "left_semi"), "jump")
    reached = start
    while True:
        step = reached.join(jump, ["file", "off"]).select("file", F.col("to").alias("off"))
        nxt = written(reached.union(step).distinct(), "reached")
        if nxt.count() == reached.count():
            return nxt
        reached = nxt
        a, b = jump.alias("a"), jump.alias("b")
        jump = written(a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.off")), "left")
                       .select(F.col("a.file").alias("file"), F.col("a.off").alias("off"),
                               F.coalesce(F.col("b.to"), F.col("a.to")).alias("to")), "jump")


def _walk(pdf):
    """Follow the block's chain from its entry: the record that each piece
    belongs to (null: to a record of an earlier block)."""
    pdf = pdf.sort_values("off")
    pos = pdf["off"].tolist()
    succ = dict(zip(pos, pdf["succ_at"].tolist()))
    entry = pdf["entry"].dropna()
    on = set()
    at = entry.iloc[0] if len(entry) else None
    while at in succ and succ[at] == succ[at] and succ[at] is not None:
        on.add(at)
        at = succ[at]
    owner, out = None, []
    for p in pos:
        owner = p if p in on else owner
        out.append(owner)
    return pdf[["file", "block", "off"]].assign(owner=out).astype({"owner": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``: file, offset, record_id,
    type, uri, payload_bytes, payload_digest (base32 SHA-1 of the payload; of a
    revisit both are those it states) and refers_to (record id; null but for
    revisits)."""
    cands = written(_pieces(spark, path).mapInArrow(_candidates, CANDIDATES), "candidates")
    totals = cands.groupBy("file", "block").agg(F.sum(F.col("size") + SEP).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    cands = written(cands.join(base, ["file", "block"]).select(
        "*", (F.col("base") + F.col("rel") - SEP).alias("off"), (F.col("base") + F.col("succ")).alias("succ_at"),
        (F.col("base") + F.col("leaves")).alias("leaves_at")).drop("base", "leaves", "succ"), "placed")
    entries = _entries(cands).withColumn("entry", F.col("off"))
    chain = (cands.select("file", "block", "off", "succ_at").join(entries, ["file", "off"], "left")
             .groupBy("file", "block").applyInPandas(_walk, "file string, block bigint, off bigint, owner bigint"))
    chain = written(chain, "chain")
    records = cands.join(chain.filter("owner = off").select("file", "off"), ["file", "off"])
    whole = records.filter("digest is not null")
    again = F.col("type") == "revisit"
    out = ["file", F.col("off").alias("offset"), "record_id", "type", "uri", "declared",
           F.when(again, F.col("stated_length")).otherwise(F.col("length")).alias("payload_bytes"),
           F.when(again, F.col("stated_digest")).otherwise(F.col("digest")).alias("payload_digest"), "refers_to"]
    broken = records.filter("digest is null").select("file", "off", "head", "length")
    if broken.isEmpty():
        return whole.select(*out)
    return whole.select(*out).unionByName(_reassembled(spark, path, cands, chain, records).select(*out))


def _reassembled(spark, path, cands, chain, records):
    """Records whose payload holds the magic, put together from their pieces."""
    # pieces before a block's first record belong to the last record before the block
    blocks = chain.groupBy("file", "block").agg(F.max("owner").alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select("file", "block", F.last("last", ignorenulls=True).over(earlier).alias("carry"))
    split = records.filter("digest is null").select("file", F.col("off").alias("owner"), "head", "length")
    parts = (chain.join(carry, ["file", "block"]).withColumn("owner", F.coalesce("owner", "carry")).drop("carry")
             .join(split, ["file", "owner"])
             .join(cands.select("file", "block", "off", "rel"), ["file", "block", "off"]))

    def bodies(it):
        for file, block, rel, value in _placed(it):
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "rel": rel, "body": value}],
                                             pa.schema([("file", pa.string()), ("block", pa.int64()),
                                                        ("rel", pa.int64()), ("body", pa.binary())]))

    text = _pieces(spark, path).mapInArrow(bodies, "file string, block bigint, rel bigint, body binary")
    joined = (parts.join(text, ["file", "block", "rel"]).groupBy("file", "owner")
              .agg(F.sort_array(F.collect_list(F.struct("off", "body"))).alias("p"),
                   F.first("head").alias("head"), F.first("length").alias("length")))

    @F.arrow_udf("string")
    def digest(ps: pa.Array, heads: pa.Array, lengths: pa.Array) -> pa.Array:
        out = []
        for p, h, n in zip(ps.to_pylist(), heads.to_pylist(), lengths.to_pylist()):
            piece = MAGIC.encode().join(x["body"] for x in p)
            # cut short at the end of a file: not a record
            out.append(payload_digest(piece[h:h + n]) if len(piece) >= h + n else None)
        return pa.array(out, pa.string())

    done = joined.select("file", F.col("owner").alias("off"), digest("p", "head", "length").alias("digest")) \
        .filter("digest is not null")
    return records.drop("digest").join(done, ["file", "off"])


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back:
    one row per page with its payload's size and digest, and which page it
    revisits (the smallest page_id with an equal payload)."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, page_id, url, payload)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read_archives(spark, path).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest",
                                             F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))

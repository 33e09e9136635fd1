"""Token ids as one wavelet matrix per shard.

Documents are ordered by doc_id over the whole table and encoded in that order;
runs of whole documents of about ``SHARD_IDS`` ids become shards, and every
shard is one file.  A shard file holds

    magic, a header of 8-byte little-endian numbers (see ``HEADER``),
    the documents' ids and lengths, deflated,
    for every bit of the ids, the highest first, one bit-plane.

Plane by plane the ids are split stably into those with a 0 and those with a 1
bit, so a token is followed through the planes by rank, and back by select.  A
plane is cut into blocks of ``BLOCK_BITS`` bits; each is kept deflated where
that is smaller, and a directory holds every block's place and the number of
ones before it.  So access, counting and occurrence lookup inflate only the
blocks they touch.

Files are written by tasks through Spark's committer, and read back through
Spark's file reader, so both may be on any file system that Spark knows, and a
lost executor's files are written anew.

Defined results: a null or empty text is a document of the closing id alone;
special strings in a text are the library's special ids; repeated rows are
documents of their own, equal doc_ids in the order of their texts; rows without
doc_id come first; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.session import ensure_checkpoint_dir

from .common import batches, columns, tidy, written
from .pretokens import range_hashes

# A shard is closed when it has this many ids; a document is never cut.
SHARD_IDS = 1 << 20
BLOCK_BITS = 1 << 15
MAGIC = b"WMTX0001"
# Numbers of the header, in this order.
HEADER = ("part", "number", "before", "ids", "documents", "planes", "doc_bytes")

# White space as the tokenizer file's pattern treats it; what lies between is
# encoded unit by unit.
UNITS = re.compile(rb" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")
# Other white space and control characters: left to the library as a whole.
RARE = re.compile(rb"[\x00-\x08\x0e-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
SIGNS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")  # of a rare text
# A blank, or a line end, before a word is the only white space of an even text.
CONTROL = bytes(b for b in range(32) if b != 10)
UNEVEN = (b"  ", b" \n", b"\n ", b"\n\n\n")
# Text cut at once (a larger batch repeats more of its words), units of one call
# of the library, and bytes of known ids kept by one worker.
BATCH_BYTES = 4 << 20
LEARN = 512
KNOWN_BYTES = 64 << 20

ALPHA = np.zeros(256, bool)
ALPHA[[*range(65, 91), *range(97, 123)]] = True
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
# Characters that a byte-level file has for the bytes; the others follow from 256 on.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = np.arange(256, dtype="<u4")
BYTE_CHARS[sorted(set(range(256)) - set(SHOWN))] = np.arange(256, 512 - len(SHOWN))
STOPS = np.zeros(256, bool)
STOPS[list(b".,;:?!")] = True


def units(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what even texts, each followed by a zero byte, are
    made of: line ends, words with the blank before them, and a stop that ends
    a word after an ASCII letter or digit or a letter of UTF-8 lead byte C3,
    with which it is never one token."""
    a = np.frombuffer(buf, np.uint8)
    gap = (a == 32) | (a == 10) | (a == 0)
    before = np.r_[True, gap[:-1]]
    stop = np.flatnonzero(STOPS[a[:-1]] & gap[1:])
    stop = stop[stop > 1]
    last, lead = a[stop - 1], a[stop - 2]
    stop = stop[ALNUM[last] | ((lead == 0xC3) & (last != 0x97) & (last != 0xB7))]
    begins = (~gap & before) | (a == 10)
    begins[stop] = True
    starts = np.flatnonzero(begins)
    closes = gap & ~before                   # the byte after a word
    closes[stop] = True
    ends = starts + 1
    word = a[starts] != 10
    ends[word] = np.flatnonzero(closes)
    blank = (starts > 0) & word
    blank[blank] = a[starts[blank] - 1] == 32
    return starts - blank, ends


def lettered(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which ranges, but for their first byte, are ASCII letters or letters of
    UTF-8 lead byte C3: with a blank before them one piece of the file's pattern."""
    a = np.frombuffer(buf, np.uint8)
    lead = a[:-1] == 0xC3
    lead &= (a[1:] != 0x97) & (a[1:] != 0xB7)
    other = ~ALPHA[a]
    other[:-1] &= ~lead
    other[1:] &= ~lead
    before = np.cumsum(other, dtype=np.int32)
    return before[ends - 1] == before[starts]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, ascending, a place of each, and which of them every key is."""
    # told apart by hashing, so that only the distinct ones are sorted
    coded = pc.dictionary_encode(pa.array(keys))
    found, of = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    first = np.empty(len(found), np.int64)
    first[of[::-1]] = np.arange(len(keys) - 1, -1, -1)
    order = np.argsort(found)
    rank = np.empty(len(found), np.int32)
    rank[order] = np.arange(len(found), dtype=np.int32)
    return found[order], first[order], rank[of]


class Encoder:
    """Ids of texts as the tokenizers library gives them for a byte-level file.
    Its pattern never joins characters across white space but for one leading
    blank, so texts are cut there and each distinct unit is encoded once.

    The units of many even texts are found and told apart by numpy.  New ones
    of a blank and letters are one piece of the pattern and go to the library's
    model at once, the others many at a time, those after a blank as one text whose tokens
    show where a blank begins, the others as lines.  What is known is kept for
    the worker's next tasks, as arrays: hashes in ascending order, and where
    the ids of each lie in one row of ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark runs the tasks in parallel
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        pattern = self.tok.pre_tokenizer
        self.pieces = (self.tok.normalizer is None and isinstance(pattern, pre_tokenizers.ByteLevel) and pattern.use_regex
                       and not pattern.add_prefix_space)
        self.model = self.tok.model
        self.special = tuple(t.content.encode() for t in self.tok.get_added_tokens_decoder().values())
        vocabulary = self.tok.get_vocab()
        self.blank = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.blank[i] = token.startswith("\u0120")
        self.line = np.frombuffer(self._whole([b"\n"])[0], "<u4")
        self._forget()

    def _forget(self) -> None:
        self.keys, self.starts, self.lens = np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.ids = np.empty(0, "<u4")

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.tok.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _cut(self, part: list[bytes], blank: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units that all begin with a blank, or all with none and hold no
        line end, one after the other, and their numbers."""
        ids = np.frombuffer(self._whole([b"".join(part) if blank else b"\n".join(part) + b"\n"])[0], "<u4")
        if blank:
            lens = np.diff(np.flatnonzero(self.blank[ids]), append=len(ids))
        else:
            end = ids == self.line[0]
            lens = np.diff(np.flatnonzero(end), prepend=-1) - 1
            ids = ids[~end]
        if len(lens) != len(part) or lens.sum() != len(ids):
            raise ValueError("this tokenizer file joins characters across white space")
        return ids, lens

    def _words(self, part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_cut``, of units of a blank and letters."""
        ids, lens, tokens = [], [], self.model.tokenize
        for word in BYTE_CHARS[np.frombuffer(b"".join(part), np.uint8)].tobytes().decode("utf-32-le").split("\u0120")[1:]:
            found = tokens("\u0120" + word)
            lens.append(len(found))
            ids += [t.id for t in found]
        return np.array(ids, "<u4"), np.array(lens, np.int64)

    def _learn(self, buf: bytes, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Add units, given by their ascending hashes and their places in ``buf``."""
        new, first = [buf[x:y] for x, y in zip(starts.tolist(), ends.tolist())], np.frombuffer(buf, np.uint8)[starts]
        lines = np.flatnonzero(first == 10)
        order, found = [lines], [(np.tile(self.line, len(lines)), np.full(len(lines), len(self.line)))]
        blank = first == 32
        upto = np.cumsum(ends - starts)
        words = blank & lettered(b"".join(new), upto - (ends - starts), upto) if self.pieces else np.zeros(len(first), bool)
        for encode, mine in ((self._words, words), (lambda u: self._cut(u, True), blank & ~words), (lambda u: self._cut(u, False), ~blank & (first != 10))):
            mine = np.flatnonzero(mine)
            for a in range(0, len(mine), LEARN):
                part = mine[a:a + LEARN]
                order.append(part)
                found.append(encode([new[i] for i in part.tolist()]))
        order, ids, lens = np.concatenate(order), [i for i, _ in found], np.concatenate([n for _, n in found])
        at = np.empty((2, len(keys)), np.int32)
        at[:, order] = len(self.ids) + np.cumsum(lens) - lens, lens
        place = np.searchsorted(self.keys, keys) + np.arange(len(keys))
        old = np.ones(len(self.keys) + len(keys), bool)
        old[place] = False

        def merged(was, more):
            out = np.empty(len(old), was.dtype)
            out[old], out[place] = was, more
            return out

        self.keys, self.starts, self.lens = merged(self.keys, keys), merged(self.starts, at[0]), merged(self.lens, at[1])
        self.ids = np.concatenate([self.ids, *ids])

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """Where the hashes stand among the known ones; -1 for others."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def _even(self, texts: list[bytes]) -> list[bytes]:
        buf = b"\0".join(texts) + b"\0"
        starts, ends = units(buf)
        keys, first, which = distinct(range_hashes(buf, starts, ends))
        if self.keys.nbytes + self.starts.nbytes + self.lens.nbytes + self.ids.nbytes > KNOWN_BYTES:
            self._forget()
        at = self._places(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            self._learn(buf, keys[new], starts[first[new]], ends[first[new]])
            at = self._places(keys)
        lens = self.lens[at][which].astype(np.int64)
        upto = np.r_[0, np.cumsum(lens)]
        ids = self.ids[np.arange(upto[-1]) + np.repeat(self.starts[at][which] - upto[:-1], lens)]
        closes = np.cumsum([len(t) + 1 for t in texts])
        flat, cut = ids.tobytes(), [0, *(4 * upto[np.searchsorted(starts, closes)]).tolist()]
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def __call__(self, texts: list) -> list[bytes]:
        out, even, uneven = [b""] * len(texts), [], []
        # of what sets a text apart, only what any of them has is looked for in each
        everything = b"".join([t + b"\0" for t in texts if t])
        special, signs, breaks = ([x for x in xs if x in everything] for xs in (self.special, SIGNS, UNEVEN))
        controls = len(everything.translate(None, CONTROL)) + sum(map(bool, texts)) != len(everything)
        for i, t in enumerate(texts):
            if not t:
                continue
            if any(x in t for x in special) or (signs and any(s in t for s in signs) and RARE.search(t)):
                out[i] = self._whole([t])[0]
            elif not (t[:1] in (b" ", b"\n") or t[-1:] in (b" ", b"\n") or any(u in t for u in breaks)
                      or (controls and len(t.translate(None, CONTROL)) != len(t))):
                even.append(i)
            elif RARE.search(t):
                out[i] = self._whole([t])[0]
            else:
                uneven.append((i, UNITS.findall(t)))
        if even:
            for i, ids in zip(even, self._even([texts[i] for i in even])):
                out[i] = ids
        words = list(set().union(*(u for _, u in uneven)))
        ids = {}
        for a in range(0, len(words), LEARN):
            ids.update(zip(words[a:a + LEARN], self._whole(words[a:a + LEARN])))
        for i, u in uneven:
            out[i] = b"".join(map(ids.__getitem__, u))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _blocks(packed: bytes) -> tuple[list[bytes], np.ndarray]:
    """The blocks of a plane, deflated where few or most bits are ones and
    that is smaller, and the ones of each."""
    step = BLOCK_BITS // 8
    counts = np.bitwise_count(np.frombuffer(packed, np.uint8))
    ones = np.add.reduceat(counts, np.arange(0, len(packed), step), dtype=np.int64)
    out = []
    for a, n in zip(range(0, len(packed), step), ones.tolist()):
        raw = packed[a:a + step]
        rare = 2 * min(n, 8 * len(raw) - n) < len(raw)
        out.append(min(raw, zlib.compress(raw, 1), key=len) if rare else raw)
    return out, ones


def _plane(packed: bytes) -> bytes:
    """One bit-plane: ones before every block and the blocks' places, then the blocks."""
    blocks, ones = _blocks(packed)
    directory = np.concatenate([[0], np.cumsum(ones), [0], np.cumsum([len(b) for b in blocks], dtype=np.int64)]).astype("<i8")
    return directory.tobytes() + b"".join(blocks)


def build(ids: np.ndarray, doc_ids: list, lengths: list[int], part: int = 0, number: int = 0, before: int = 0) -> bytes:
    """A shard file of ``ids``, the concatenated ids of the documents."""
    n, n_planes = len(ids), int(ids.max()).bit_length() if len(ids) else 0
    kind = np.uint16 if n_planes <= 16 else np.uint32
    cur, planes = np.ascontiguousarray(ids, kind), []
    for shift in range(n_planes - 1, -1, -1):
        bits = (cur & kind(1 << shift)) != 0
        packed = np.packbits(bits, bitorder="little").tobytes()
        planes.append(_plane(packed))
        cur = np.concatenate([cur.take(np.flatnonzero(~bits)), cur.take(np.flatnonzero(bits))])
    known = np.array([i is not None for i in doc_ids], np.uint8)
    docs = zlib.compress(known.tobytes() + np.array([i or 0 for i in doc_ids], "<i8").tobytes() + np.array(lengths, "<i8").tobytes(), 1)
    head = struct.pack(f"<{len(HEADER)}q", part, number, before, n, len(doc_ids), n_planes, len(docs))
    sizes = np.array([len(p) for p in planes], "<i8").tobytes()
    return MAGIC + head + sizes + docs + b"".join(planes)


class _Plane:
    """Rank and select over one plane of a file; blocks are inflated when touched."""

    def __init__(self, data: memoryview, n: int):
        self.n, blocks = n, -(-n // BLOCK_BITS)
        both = np.frombuffer(data[:16 * (blocks + 1)], "<i8")
        self.ones, self.places = both[:blocks + 1], both[blocks + 1:]
        self.body, self.held = data[16 * (blocks + 1):], {}
        self.zeros = n - int(self.ones[-1])

    def block(self, k: int) -> np.ndarray:
        """The bits of block k."""
        if k not in self.held:
            raw = bytes(self.body[self.places[k]:self.places[k + 1]])
            n = min(BLOCK_BITS, self.n - k * BLOCK_BITS)
            raw = raw if len(raw) == -(-n // 8) else zlib.decompress(raw)
            self.held[k] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n, bitorder="little")
        return self.held[k]

    def bits(self) -> np.ndarray:
        return np.concatenate([self.block(k) for k in range(len(self.ones) - 1)]) if self.n else np.empty(0, np.uint8)

    def bit(self, i: int) -> int:
        return int(self.block(i // BLOCK_BITS)[i % BLOCK_BITS])

    def rank(self, i: int, bit: int) -> int:
        """Number of ``bit`` before place i."""
        k = min(i // BLOCK_BITS, len(self.ones) - 2)
        ones = int(self.ones[k] + np.count_nonzero(self.block(k)[:i - k * BLOCK_BITS]))
        return ones if bit else i - ones

    def select(self, ranks: np.ndarray, bit: int) -> np.ndarray:
        """Places of the ``bit`` with so many like it before, for ascending ranks."""
        before = self.ones if bit else np.minimum(np.arange(len(self.ones)) * BLOCK_BITS, self.n) - self.ones
        of = np.searchsorted(before, ranks, side="right") - 1
        out = np.empty(len(ranks), np.int64)
        for k in np.unique(of).tolist():
            mine = of == k
            out[mine] = np.flatnonzero(self.block(k) == bit)[ranks[mine] - before[k]] + k * BLOCK_BITS
        return out


class Shard:
    """One shard file, queried where it lies."""

    def __init__(self, content: bytes):
        if content[:len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet shard")
        at = len(MAGIC) + 8 * len(HEADER)
        fields = dict(zip(HEADER, struct.unpack(f"<{len(HEADER)}q", content[len(MAGIC):at])))
        self.part, self.number, self.before, self.n = (fields[k] for k in HEADER[:4])
        sizes = np.frombuffer(content, "<i8", fields["planes"], at)
        at += sizes.nbytes
        n, docs = fields["documents"], zlib.decompress(content[at:at + fields["doc_bytes"]])
        known, ids = np.frombuffer(docs, np.uint8, n), np.frombuffer(docs, "<i8", n, n)
        self.doc_ids = [i if k else None for k, i in zip(known.tolist(), ids.tolist())]
        self.lengths = np.frombuffer(docs, "<i8", n, 9 * n)
        self.starts = np.cumsum(self.lengths) - self.lengths
        at += fields["doc_bytes"]
        view, self.planes = memoryview(content), []
        for size in sizes.tolist():
            self.planes.append(_Plane(view[at:at + size], self.n))
            at += size

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for shift, plane in enumerate(reversed(self.planes)):
            one = plane.bits().view(bool)
            up = np.empty_like(cur)
            zeros, ones = ~one, one
            # where equal bits lie together masks are quicker than places
            if 6 * np.count_nonzero(one[1:] != one[:-1]) >= len(one):
                zeros, ones = np.flatnonzero(zeros), np.flatnonzero(ones)
            up[zeros] = cur[:plane.zeros]
            up[ones] = cur[plane.zeros:] | kind(1 << shift)
            cur = up
        return cur.astype("<u4")

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for plane in self.planes:
            bit = plane.bit(i)
            value = 2 * value + bit
            i = plane.rank(i, bit) + (plane.zeros if bit else 0)
        return value

    def _interval(self, token: int, a: int, b: int) -> tuple[int, int]:
        """Where the ``token``s of places a to b lie after the last plane."""
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for k, plane in enumerate(self.planes):
            if a >= b:
                return 0, 0
            bit = token >> (len(self.planes) - 1 - k) & 1
            shift = plane.zeros if bit else 0
            a, b = plane.rank(a, bit) + shift, plane.rank(b, bit) + shift
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """How often ``token`` stands at places a to b."""
        lo, hi = self._interval(token, a, self.n if b is None else b)
        return hi - lo

    def occurrences(self, token: int) -> np.ndarray:
        """All places of ``token``, ascending."""
        lo, hi = self._interval(token, 0, self.n)
        at = np.arange(lo, hi, dtype=np.int64)
        for k in range(len(self.planes) - 1, -1, -1):
            if not len(at):
                break
            plane, bit = self.planes[k], token >> (len(self.planes) - 1 - k) & 1
            at = plane.select(at - (plane.zeros if bit else 0), bit)
        return at


def write_shards(docs: DataFrame, path: str, tokenizer: str, closing_id: int = 0, shard_ids: int = SHARD_IDS,
                 doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` in ascending doc_id order and write a file per shard."""
    closing = np.array([closing_id], "<u4").tobytes()
    d = columns(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))

    def encode(it):
        part, number, before = TaskContext.get().partitionId(), 0, 0
        enc, held, owners = None, [], []

        def close():
            nonlocal number, before, held, owners
            ids = np.frombuffer(b"".join(held), "<u4")
            file = build(ids, owners, [len(h) // 4 for h in held], part, number, before)
            number, before, held, owners = number + 1, before + len(ids), [], []
            return pa.record_batch([pa.array([file], pa.binary())], ["file"])

        size = 0
        for batch, texts in batches(it, limit=BATCH_BYTES):
            enc = enc or encoder(tokenizer)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc(texts)):
                held.append(ids + closing)
                owners.append(doc)
                size += len(held[-1]) // 4
                if size >= shard_ids:
                    yield close()
                    size = 0
        if held:
            yield close()

    ordered = d.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    # a string column of the files' bytes: the text writer writes them as they are
    ordered.mapInArrow(tidy(encode), "file binary").select(F.col("file").cast("string").alias("value")) \
        .write.option("maxRecordsPerFile", 1).text(path)


def shard_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content").filter(F.length("content") >= len(MAGIC))


def _per_shard(spark: SparkSession, path: str, rows_of, schema: str) -> DataFrame:
    def run(it):
        for batch in it:
            for content in batch.column("content"):
                yield rows_of(Shard(content.as_py()))
    return shard_files(spark, path).mapInArrow(tidy(run), schema)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards under ``path``: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32."""
    def rows(shard):
        flat, cut = shard.decode().tobytes(), (4 * np.append(shard.starts, shard.n)).tolist()
        return pa.record_batch([pa.array(np.full(len(shard.starts), shard.part)), pa.array(shard.doc_ids, pa.int64()),
                                pa.array(shard.before + shard.starts), pa.array(shard.lengths),
                                pa.array([zlib.crc32(flat[a:b]) for a, b in zip(cut, cut[1:])], pa.int64())],
                               ["part", "doc_id", "within", "n_tokens", "ids_crc32"])

    found = written(_per_shard(spark, path, rows, "part bigint, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint"), "ids")
    # one row per range partition of the writing job
    sums = sorted((r.part, r.n) for r in found.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base = np.cumsum([0, *(n for _, n in sums)]).tolist()
    bases = spark.createDataFrame([(p, b) for (p, _), b in zip(sums, base)], "part bigint, base bigint")
    return found.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of a few tokens stands in all shards."""
    def rows(shard):
        return pa.record_batch([pa.array(tokens, pa.int64()), pa.array([shard.count(t) for t in tokens], pa.int64())], ["token", "n"])
    return _per_shard(spark, path, rows, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def token_places(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, place): every occurrence of ``token``, by its place in its document."""
    def rows(shard):
        at = shard.occurrences(token)
        of = np.searchsorted(shard.starts, at, side="right") - 1
        return pa.record_batch([pa.array([shard.doc_ids[k] for k in of.tolist()], pa.int64()), pa.array(at - shard.starts[of])], ["doc_id", "place"])
    return _per_shard(spark, path, rows, "doc_id bigint, place bigint")


def round_trip(docs: DataFrame, tokenizer: str, closing_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as shards in the shared folder and read them back."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, tokenizer, closing_id, doc_id=doc_id, text=text)
    return read_documents(spark, path)

"""Sequence packing by Karmarkar-Karp multiway differencing.

Every document's token ids (and the closing id) are cut into full windows of
the maximum length and a remainder, and the remainder into parts of at most
``part`` tokens.  Full windows are sequences by themselves.  The parts are
dealt evenly into groups; in each group multiway differencing keeps a heap of
partial partitions and repeatedly merges the two of greatest imbalance, the
largest sums of one with the smallest of the other, which leaves windows of
nearly equal sums.  If the fullest window is over capacity, the window count
is raised and the group is partitioned again.

Defined results: a null or empty text is a document of the closing id alone;
repeated rows are packed one by one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, batches, columns, tidy, written
from .pretokens import gather, is_plain, lowered, range_hashes, ranges

MAX_LENGTH = 2048
# Longest part of a remainder: at least four parts fit a window, so sums even out.
PART = 512
# Text encoded at once: a larger batch repeats more of its words.
BATCH_BYTES = 4 << 20
# Parts per differencing group; a group's padding is below one window.
GROUP_PARTS = 600

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window number of each item, by multiway differencing into ``windows``."""
    if windows == 1:
        return np.zeros(len(sizes), np.int64)
    # A partial partition: sums in descending order (less their minimum) and,
    # per slot, the merge tree of its items.
    heap = []
    order = np.argsort(-sizes, kind="stable")
    for tie, i in enumerate(order.tolist()):
        sums = np.zeros(windows, np.int64)
        sums[0] = sizes[i]
        slots = [None] * windows
        slots[0] = i
        heap.append((-int(sizes[i]), tie, sums, slots))
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        _, _, a, at = heapq.heappop(heap)
        _, _, b, bt = heapq.heappop(heap)
        sums = a + b[::-1]
        slots = [x if y is None else y if x is None else (x, y) for x, y in zip(at, reversed(bt))]
        rank = np.argsort(-sums, kind="stable")
        sums = sums[rank] - sums[rank[-1]]
        heapq.heappush(heap, (-int(sums[0]), tie, sums, [slots[k] for k in rank.tolist()]))
        tie += 1
    out = np.empty(len(sizes), np.int64)
    for w, tree in enumerate(heap[0][3]):
        stack = [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            elif x is not None:
                out[x] = w
    return out


def pack_group(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item; sums are at most ``capacity`` and nearly equal."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        of = difference(sizes, windows)
        if np.bincount(of, sizes, windows).max() <= capacity:
            return of
        windows += 1


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, by the
    tokenizers library.

    The pre-tokens of ordinary texts are found for a whole batch at once, and
    each distinct one is encoded once per task, all new ones of a batch in one
    call; any other text goes through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark runs the tasks in parallel
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        # the same model for words that are normalised and split already
        self.words = Tokenizer(self.tok.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.cache: dict[int, bytes] = {}

    def _ids(self, text: str, tok=None) -> np.ndarray:
        return np.array((tok or self.tok).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, keys: list[int], words: list[bytes]) -> None:
        ids = self._ids(b" ".join(words).decode("utf-8"), self.words)
        # a pre-token ends with a token that ends a word
        at = [0, *(np.flatnonzero(self.last[ids]) + 1).tolist()]
        if len(at) != len(words) + 1 or at[-1] != len(ids):
            raise ValueError("this tokenizer file does not end its words with </w>")
        flat = ids.tobytes()
        self.cache.update((k, flat[4 * a:4 * b]) for k, a, b in zip(keys, at, at[1:]))

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        buf = lowered(texts)
        starts, ends = ranges(buf)
        if not len(starts):
            return [b""] * len(texts)
        keys, first, which = np.unique(range_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.cache) > 2 * CACHE_WORDS:
            self.cache = {}
        keys = keys.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.cache]
        if new:
            a, b = starts[first[new]].tolist(), ends[first[new]].tolist()
            self._learn([keys[i] for i in new], [buf[x:y] for x, y in zip(a, b)])
        known = [self.cache[k] for k in keys]
        offsets = np.cumsum([0, *map(len, known)]) // 4
        ids, lens = gather(np.frombuffer(b"".join(known), "<u4"), offsets, which)
        # where each text's ids end: texts are followed by one blank each
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        n_words = np.searchsorted(starts, text_ends)
        upto = np.r_[0, np.cumsum(lens)][n_words]
        flat, cut = ids.tobytes(), [0, *(4 * upto).tolist()]
        return [flat[a:b] for a, b in zip(cut, cut[1:])]

    def __call__(self, texts: list) -> list[bytes]:
        out = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if t and is_plain(t)]
        for i, ids in zip(plain, self._plain([texts[i] for i in plain]) if plain else []):
            out[i] = ids
        for i in set(range(len(texts))).difference(plain):
            if texts[i]:
                out[i] = self._ids(texts[i].decode("utf-8")).tobytes()
        return out


def cut(docs: DataFrame, tokenizer: str, closing_id: int = 1, max_length: int = MAX_LENGTH, part: int = PART) -> DataFrame:
    """Pieces of every document (columns ``doc_id``, ``text``)."""
    closing = np.array([closing_id], "<u4").tobytes()

    def pieces(it):
        enc = None
        for batch, texts in batches(it, limit=BATCH_BYTES):
            enc = enc or Encoder(tokenizer)
            cols = ([], [], [], [], [])
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc(texts)):
                ids += closing
                n = len(ids) // 4
                full = n - n % max_length
                cuts = [*range(0, full, max_length), *range(full, n, part), n]
                for a, b in zip(cuts, cuts[1:]):
                    for c, v in zip(cols, (doc, a, b - a, zlib.crc32(ids[4 * a:4 * b]), n)):
                        c.append(v)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols],
                                  ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.mapInArrow(tidy(pieces), PIECES)


def pack(docs: DataFrame, tokenizer: str, closing_id: int = 1, max_length: int = MAX_LENGTH, part: int = PART,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with their sequence and their offset in it.

    Only the small piece rows are shuffled, round robin, so neither a hot
    document nor repeated rows crowd a group.
    """
    d = columns(docs, doc_id=doc_id, text=text)
    # a row without doc_id or with a non-integer one keeps its place as null
    pieces = written(cut(d.withColumn("doc_id", F.col("doc_id").cast("long")), tokenizer, closing_id, max_length, part),
                     "pieces")
    groups = max(1, -(-pieces.count() // (16 * GROUP_PARTS)))

    def assign(it):
        rows = pa.Table.from_batches(list(it), SCHEMA)   # about 16 * GROUP_PARTS rows of 40 bytes
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32")])
        sizes = rows.column("length").to_numpy().astype(np.int64)
        base = np.int64(TaskContext.get().partitionId()) << np.int64(32)
        seq = np.empty(len(sizes), np.int64)
        whole = np.flatnonzero(sizes == max_length)
        seq[whole] = np.arange(len(whole))
        used = len(whole)
        rest = np.flatnonzero(sizes != max_length)
        n_groups = max(1, -(-len(rest) // GROUP_PARTS))
        for g in range(n_groups):
            mine = rest[g::n_groups]
            if len(mine):
                of = pack_group(sizes[mine], max_length)
                seq[mine] = used + of
                used += int(of.max()) + 1
        order = np.argsort(seq, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.r_[True, seq[order][1:] != seq[order][:-1]] if len(order) else np.empty(0, bool)
        offset = np.empty(len(sizes), np.int64)
        offset[order] = before - before[first][np.cumsum(first) - 1] if len(order) else 0
        out = rows.append_column("sequence_id", pa.array(base + seq, pa.int64())) \
            .append_column("offset", pa.array(offset, pa.int64()))
        yield from out.to_batches()

    SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])
    return pieces.repartition(groups).mapInArrow(assign, PIECES + ", sequence_id bigint, offset bigint")

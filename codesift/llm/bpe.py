"""Token counts by rank-synchronous merging.

Pre-tokens are held as ragged numpy arrays of symbol ids.  In every round each
sequence finds its lowest-rank adjacent pair and merges all occurrences of it
at once; sequences without a known pair are finished.  The surviving symbols
are the tokens.  A sequence of over ``LONG`` bytes is merged by itself, with its
symbols linked and the places of every pair kept by rank, so a round touches
only the places of its rank and their neighbours.  Each distinct pre-token is merged once per task (bounded
cache).

Works with the files that hold a BPE model with word ends over byte symbols.
Normalising and splitting follow the file: ordinary Latin-1 text goes through
one compiled pattern, any other text through the library's own normaliser and
pre-tokeniser.

Defined results: a null or empty text has no tokens; special strings in a text
count as one token each, as the library does by default; repeated rows are
counted one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_WORDS, columns, text_slices

# Text whose normal form is its lower-case form and whose characters the
# pattern below classifies as the tokeniser file does.
PLAIN = r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*"
LATIN = "a-zA-Z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
DIGIT = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
SPLIT = f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[{DIGIT}]|[^\\s{LATIN}{DIGIT}]+"


# Longer sequences are merged by themselves.
LONG = 512
# In place of a symbol that was merged into the one before it.
GONE = -2


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the rest for code points from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = {b: chr(b) for b in own}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(own))
    return [out[b] for b in range(256)]


class RankMerger:
    """Counts BPE symbols of many byte strings at a time."""

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab = model["vocab"]
        end = model["end_of_word_suffix"]
        sym = byte_symbols()
        self.inner = np.array([vocab.get(s, -1) for s in sym], np.int64)
        self.last = np.array([vocab.get(s + end, -1) for s in sym], np.int64)
        self.size = len(vocab)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        self.rank_of: dict[int, int] = {}

    def linked_symbols(self, word: bytes) -> list[int]:
        """Surviving symbol ids of one long word."""
        if not self.rank_of:
            self.rank_of = dict(zip(self.key.tolist(), self.rank.tolist()))
            at = np.argsort(self.rank, kind="stable")
            self.merge_of = list(zip((self.key[at] // self.size).tolist(), (self.key[at] % self.size).tolist(), self.made[at].tolist()))
        flat = np.frombuffer(word, np.uint8)
        ids = self.inner[flat]
        ids[-1] = self.last[flat[-1]]
        ids, n, rank_of, size = ids.tolist(), len(flat), self.rank_of, self.size
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        places: dict[int, list[int]] = {}
        for i in range(n - 1):
            rank = rank_of.get(ids[i] * size + ids[i + 1])
            if rank is not None:
                places.setdefault(rank, []).append(i)
        ranks = list(places)
        heapq.heapify(ranks)
        while ranks:
            rank = heapq.heappop(ranks)
            left, right, made = self.merge_of[rank]
            for p in sorted(places.pop(rank)):
                q = after[p]
                if ids[p] != left or q < 0 or ids[q] != right:     # merged meanwhile
                    continue
                ids[p], ids[q], end = made, GONE, after[q]
                after[p] = end
                if end >= 0:
                    before[end] = p
                for a, b in ((before[p], p), (p, end)):
                    if a >= 0 and b >= 0:
                        r = rank_of.get(ids[a] * size + ids[b])
                        if r is None:
                            continue
                        if r in places:
                            places[r].append(a)
                        else:
                            places[r] = [a]
                            heapq.heappush(ranks, r)
        return [i for i in ids if i != GONE]

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbol ids of all (non-empty) words, flat, and each word's count."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ids = self.inner[flat]
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.last[flat[ends]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_owner = [], []
        none = len(self.key)
        while len(ids):
            pair = ids[:-1] * self.size + ids[1:]
            at = np.minimum(np.searchsorted(self.key, pair), none - 1)
            known = (self.key[at] == pair) & (owner[:-1] == owner[1:])
            rank = np.append(np.where(known, self.rank[at], none), none)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            lens = np.diff(np.r_[starts, len(ids)])
            best_here = np.repeat(best, lens)
            finished = best_here == none
            if finished.any():
                done_ids.append(ids[finished])
                done_owner.append(owner[finished])
            merge = (rank == best_here) & ~finished
            # of overlapping matches (runs of one symbol) every second one counts
            idx = np.flatnonzero(merge)
            if len(idx):
                run_start = np.r_[True, np.diff(idx) != 1]
                first = idx[run_start][np.cumsum(run_start) - 1]
                idx = idx[(idx - first) % 2 == 0]
                ids[idx] = self.made[at[idx]]
            keep = ~finished
            keep[idx + 1] = False
            ids, owner = ids[keep], owner[keep]
        all_ids, all_owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(all_owner, kind="stable")
        return all_ids[order], np.bincount(all_owner, minlength=len(words))

    def counts(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        out[short] = self.symbols([words[i] for i in short])[1]
        for i in set(range(len(words))).difference(short):
            out[i] = len(self.linked_symbols(words[i]))
        return out


class TokenCounter:
    """Token counts of texts for one tokeniser file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # Spark runs the tasks in parallel
        from tokenizers import Tokenizer

        self.merger = RankMerger(path)
        tok = Tokenizer.from_file(path)
        self.normalizer, self.pre = tok.normalizer, tok.pre_tokenizer
        special = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.plain, self.split = re.compile(PLAIN), re.compile(SPLIT)
        self.back = {c: b for b, c in enumerate(byte_symbols())}
        self.cache: dict[str, int] = {}        # of parts
        self.counts: dict[bytes, int] = {}     # of pre-tokens

    def parts(self, text: str) -> tuple[list[str], int]:
        """Parts between white space, normalised, and the number of special
        tokens.  No token spans white space."""
        if self.plain.fullmatch(text) and "<|" not in text:
            return text.lower().split(), 0
        rest = self.special.split(text) if self.special else [text]
        out = []
        for part in rest:
            out += self.normalizer.normalize_str(part).split(" ")
        return out, len(rest) - 1

    def pieces(self, part: str) -> list[bytes]:
        """Pre-tokens of a part as UTF-8 bytes."""
        if self.plain.fullmatch(part):
            return list(map(str.encode, self.split.findall(part)))
        return [bytes(self.back[c] for c in piece) for piece, _ in self.pre.pre_tokenize_str(part)] if part else []

    def __call__(self, texts: list) -> np.ndarray:
        split = [self.parts(t.decode("utf-8")) if t else ([], 0) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        new = {p for parts, _ in split for p in parts}
        if len(self.counts) > CACHE_WORDS:
            self.counts = {}
        new.difference_update(self.cache)
        if new:
            parts = list(new)
            pieces = list(map(self.pieces, parts))
            words = list(set(chain.from_iterable(pieces)).difference(self.counts))
            self.counts.update(zip(words, self.merger.counts(words).tolist()))
            count = self.counts.__getitem__
            self.cache.update((p, sum(map(count, ws))) for p, ws in zip(parts, pieces))
        get = self.cache.__getitem__
        return np.array([sum(map(get, parts)) + n for parts, n in split], np.int64)


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                 limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    @F.arrow_udf("bigint")
    def tokens(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = None
        for column in it:
            counter = counter or TokenCounter(tokenizer)
            out = [counter(texts) for _, texts in text_slices(column, 4 << 20)]
            yield pa.array(np.concatenate(out) if out else np.empty(0, np.int64), pa.int64())

    d = columns(docs, doc_id=doc_id, text=text)
    return d.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                    tokens("text").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)

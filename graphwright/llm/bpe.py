"""Byte-level BPE, two-tier: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the others.

A text is split by the tokenizer's pattern. A pre-token that stands in the vocabulary is one id, found by a minimal perfect
hash over the vocabulary's byte strings (hash and displace: a bucket's displacement sends each of its keys to a slot of its own;
buckets of one key hold the slot itself), checked by its bytes. Any other is cut into bytes linked as a list; a heap
holds the ranks of linked pairs, and the least (leftmost on ties) is merged until none is in the vocabulary. Results of either
tier are memoised per task, a bounded number (2 * MEMO). Decoding joins the ids' bytes.

The vocabulary file's path is a parameter; the file is shipped with the job only as this path, so it has to be installed on
every executor. Contract: whole texts; null is the empty text; no special tokens; other columns pass through; rows are
independent of each other.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import release

MEMO = 1 << 18
#: Whole pre-tokens over this length are looked up and merged like others, but not memoised.
MEMO_LENGTH = 48

# The classes of the published pattern, for texts of ASCII only.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: get(key) is the key's place among them, or -1."""

    def __init__(self, keys: list[bytes], per_bucket: int = 3):
        self.n, self.m = len(keys), max(1, len(keys) // per_bucket)
        self.keys: list[bytes | None] = [None] * self.n
        self.values = [-1] * self.n
        self.moves = [0] * self.m
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            buckets[h % self.m].append(i)
        free, taken, n = set(range(self.n)), bytearray(self.n), self.n
        for b in sorted(range(self.m), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if len(own) == 1:
                slots = [free.pop()]
                self.moves[b] = -slots[0] - 1
            elif own:
                move, mixed = 0, [hashes[i] for i in own]
                while True:
                    slots = []
                    for h in mixed:
                        s = (((h ^ move * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 24) % n
                        if taken[s] or s in slots:
                            break
                        slots.append(s)
                    else:
                        break
                    move += 1
                free.difference_update(slots)
                self.moves[b] = move
            for i, s in zip(own, slots if own else (), strict=True):
                self.keys[s], self.values[s], taken[s] = keys[i], i, 1

    def slot(self, h: int, move: int) -> int:
        return (((h ^ move * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF) >> 24) % self.n

    def get(self, key: bytes) -> int:
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        move = self.moves[h % self.m]
        s = -move - 1 if move < 0 else self.slot(h, move)
        return self.values[s] if self.keys[s] == key else -1


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        words = sorted(self.ranks, key=self.ranks.get)
        self.ids = [self.ranks[w] for w in words]
        self.whole = PerfectHash(words)
        if missing := [i for i in range(256) if bytes([i]) not in self.ranks]:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.singles = [self.ranks[bytes([i])] for i in range(256)]
        # which id two linked parts merge into
        self.bits = max(self.ids).bit_length()
        get, self.pairs = self.ranks.get, {}
        for w, r in self.ranks.items():
            for k in range(1, len(w)):
                a, b = get(w[:k]), get(w[k:])
                if a is not None and b is not None:
                    self.pairs[a << self.bits | b] = r
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        import public_tokenizers

        self.split_ascii = re.compile(ASCII_PATTERN).findall if pattern == public_tokenizers.PATTERN else self.split
        # decoding: all strings in one array of bytes
        self.lengths = np.zeros(max(self.ids, default=0) + 1, np.int64)
        self.lengths[self.ids] = [len(w) for w in words]
        self.places = np.zeros(len(self.lengths), np.int64)
        self.places[self.ids] = np.cumsum(self.lengths[self.ids]) - self.lengths[self.ids]
        self.pool = np.frombuffer(b"".join(words), np.uint8)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        """Drops what was memoised: an idle worker holds the vocabulary alone."""
        self.memo, self.older = {}, {}
        release()

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token by merging, least rank first."""
        n, bits = len(token), self.bits
        get, width = self.pairs.get, n.bit_length()
        low = (1 << width) - 1
        ids = [self.singles[x] for x in token]  # of the part that starts here; -1: merged into another
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # a heap entry: rank of a pair of linked parts and where it starts, in one integer
        heap = [r << width | i for i in range(n - 1) if (r := get(ids[i] << bits | ids[i + 1])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i, r = top & low, top >> width
            if ids[i] < 0:
                continue
            mid = after[i]
            if mid >= n or get(ids[i] << bits | ids[mid]) != r:
                continue
            ids[i], ids[mid] = r, -1
            after[i] = e = after[mid]
            if e < n:
                before[e] = i
                if (q := get(r << bits | ids[e])) is not None:
                    push(heap, q << width | i)
            if i:
                b = before[i]
                if (q := get(ids[b] << bits | r)) is not None:
                    push(heap, q << width | b)
        return [x for x in ids if x >= 0]

    def encode_token(self, token: str) -> bytes:
        out = self.older.get(token)
        if out is None:
            data = token.encode()
            at = self.whole.get(data)
            out = array("I", [self.ids[at]] if at >= 0 else self.merge(data)).tobytes()
        if len(token) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[token] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, slow = self.memo.get, self.encode_token
        return b"".join([get(t) or slow(t) for t in (self.split_ascii if text.isascii() else self.split)(text)])

    def decode(self, ids: bytes) -> bytes:
        x = np.frombuffer(ids, "<u4")
        sizes = self.lengths[x]
        if not sizes.all():
            raise ValueError("an id outside the vocabulary")
        ends = np.cumsum(sizes)
        return self.pool[np.arange(ends[-1] if len(x) else 0) + np.repeat(self.places[x] - (ends - sizes), sizes)].tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One per Python worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


#: Ids in a batch that leaves a worker, unless one text has more.
BATCH_IDS = 1 << 24


def mapped(docs: DataFrame, text: str, make: Callable, extra: list[pa.Field], schema: str, keep: list[str]) -> DataFrame:
    """make(text) gives the values of the extra columns. Columns travel by place, the text last, so that no column's name matters."""
    names = [*keep, *(f.name for f in extra)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.columns[-1]

            def out(low: int, high: int, rows: list[tuple], columns: list = batch.columns[:-1]) -> pa.RecordBatch:
                values = zip(*rows, strict=True) if rows else [[]] * len(extra)
                return pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in columns), *(pa.array(v, f.type) for v, f in zip(values, extra, strict=True))], names=names)

            rows, low, held = [], 0, 0
            for i in range(batch.num_rows):
                size, row = make(texts[i].as_py())
                rows.append(row)
                held += size
                if held > BATCH_IDS:
                    yield out(low, i + 1, rows)
                    rows, low, held = [], i + 1, 0
            yield out(low, batch.num_rows, rows)
        for c in _codecs.values():
            c.forget()

    sent = [F.col(f"`{c}`") for c in keep] + [F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))]
    return docs.select(*(c.alias(f"__in_{i}") for i, c in enumerate(sent))).mapInArrow(run, schema)


def _ddl(docs: DataFrame, keep: list[str]) -> list[str]:
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return [f"`{c}` {kinds[c]}" for c in keep]


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all but those that clash), with ids array<int> and n_tokens."""
    keep = [c for c in docs.columns if c not in ("ids", "n_tokens")] if keep is None else keep

    def make(t: str) -> tuple[int, tuple]:
        ids = codec(path, pattern).encode(t)
        return len(ids) // 4, (np.frombuffer(ids, np.int32), len(ids) // 4)

    fields = [pa.field("ids", pa.list_(pa.int32())), pa.field("n_tokens", pa.int64())]
    return mapped(docs, text, make, fields, ", ".join([*_ddl(docs, keep), "ids array<int>", "n_tokens long"]), keep)


def decode(encoded: DataFrame, path: str, pattern: str, *, ids: str = "ids") -> DataFrame:
    """The table with `decoded` (binary) beside the ids; null ids give null."""
    keep = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            values, at, out = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), []
            for i, there in enumerate(column.is_valid().to_pylist()):
                out.append(c.decode(values[at[i] : at[i + 1]].astype("<u4").tobytes()) if there else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.select(*(F.col(f"`{x}`") for x in keep)).mapInArrow(run, ", ".join([*_ddl(encoded, keep), "decoded binary"]))


def encode_verified(docs: DataFrame, path: str, pattern: str, *, text: str = "text", keep: list[str]) -> DataFrame:
    """The columns in keep with ids, n_tokens and decoded_sha256 (of the bytes that the ids decode to), in one pass and one worker a task."""

    def make(t: str) -> tuple[int, tuple]:
        c = codec(path, pattern)
        ids = c.encode(t)
        return len(ids) // 4, (np.frombuffer(ids, np.int32), len(ids) // 4, hashlib.sha256(c.decode(ids)).hexdigest())

    fields = [pa.field("ids", pa.list_(pa.int32())), pa.field("n_tokens", pa.int64()), pa.field("decoded_sha256", pa.string())]
    return mapped(docs, text, make, fields, ", ".join([*_ddl(docs, keep), "ids array<int>", "n_tokens long", "decoded_sha256 string"]), keep)


def round_trip(docs: DataFrame, path: str, pattern: str, *, text: str = "text", keep: list[str]) -> DataFrame:
    """The columns in keep with n_tokens, ids_sha256 and decoded_sha256: texts are encoded, and the ids decoded, in one pass."""

    def make(t: str) -> tuple[int, tuple]:
        c = codec(path, pattern)
        ids = c.encode(t)
        return len(ids) // 4, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest())

    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    return mapped(docs, text, make, fields, ", ".join([*_ddl(docs, keep), "n_tokens long", "ids_sha256 string", "decoded_sha256 string"]), keep)

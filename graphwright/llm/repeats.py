"""Exact search for windows that also start in an earlier document.

Every text is a sequence of symbols (bytes or words). A window is `width` symbols of one text. The window's
trigger is the `gram`-symbol string of least rolling hash inside it (leftmost on ties), so it depends on the window's
content only, and every window has one. A phrase is a maximal run of windows with one trigger, with all
bytes these cover: texts become a parse, a sequence of phrases, over a dictionary of distinct phrases. Equal
passages have equal phrases but for those at their edges. Three exchanges settle each window exactly:

1. Phrases, counted by (trigger, phrase) fingerprint: a phrase that an earlier document has is covered whole.
2. A trigger with several distinct phrases may stand in windows that only some of them share. Those phrases travel with their bytes
   and become a dictionary, each once. The suffix array of the dictionary, by letter and to a depth of `width` bytes, puts equal windows
   side by side; the parse says which documents have each phrase. A window never leaves its phrase, so of the parse's own order
   only the earliest document of each phrase is asked: the least one over a run of equal windows decides for all of the run.
3. The verdicts return to the block of documents that asked; runs of covered symbols merge into maximal spans.

Equal windows have equal triggers, so the dictionary is dealt by trigger. A trigger with over HOT distinct phrases (the edge of a passage
that a large part of all documents has) has its windows dealt singly instead, by their own hash, so that they spread over all tasks;
they are ordered by the same code with the same result.

Phrases are told apart by bucket number and 48 bits each of trigger and phrase hashes (n phrases match falsely at a chance of about n^2 / 2^97);
windows of the dictionary are compared by their bytes. Rows that travel are blobs of one block for one bucket, with each phrase
once per block, so a passage that a third of all documents share brings one entry a block for each phrase inside it; its edges bring 20
bytes a block for each distinct phrase to one bucket. Nothing is broadcast. Documents are dealt once by block; the same exchange serves all passes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import BYTE_SYMBOLS, U64, Rolling, mix, sliding_min, word_hashes, word_spans

CHUNK = 1 << 17
POSITION_BITS = 22
NO_ID = (1 << 63) - 1
#: Bytes of text in a block; a block is what one Python task holds at a time.
BLOCK_BYTES = 3 << 20
MIN_BLOCKS = 48
#: Distinct phrases of a trigger up to which its dictionary is sorted in one task.
HOT = 1 << 14


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]


DEALT = "block int, body binary"


def packed_docs(n: int) -> Callable:
    """Batches of (doc_id, text) to one compressed packet for each block that they touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            block = (mix(np.array(b.column(0)).astype(np.int64).view(U64)) % U64(n)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            ends = np.flatnonzero(np.diff(block[order])) + 1
            to, bodies = [], []
            for rows in np.split(order, ends) if len(order) else ():
                sink = pa.BufferOutputStream()
                part = b.take(pa.array(rows))
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_batch(part)
                to.append(int(block[rows[0]]))
                bodies.append(press.compress(sink.getvalue()))
                del part, sink
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(bodies, pa.binary())], names=["block", "body"])

    return run


def plain_docs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text): a null id counts as the largest, a null text as empty."""
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def dealt(docs: DataFrame, doc_id: str, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, body) packets of documents, dealt by hash of the id, and how many blocks there are. Rows of one id share a block."""
    n = max(MIN_BLOCKS, math.ceil(text_bytes(docs, text) / block_bytes))
    return plain_docs(docs, doc_id, text).mapInArrow(packed_docs(n), DEALT), n


def ordered(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Ids and texts of a block's packets in the order of ids, then of texts, so that every pass sees one order."""
    press = zstandard.ZstdDecompressor()
    parts = [pa.ipc.open_stream(press.decompress(body.as_buffer())).read_all() for body in table["body"]]
    if not parts:
        return np.zeros(0, np.int64), pa.array([], pa.string())
    return by_id(pa.concat_tables(parts))


def by_id(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    table = table.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return table["doc_id"].to_numpy(), table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string())


def raw(texts: pa.Array, i: int) -> np.ndarray:
    return np.frombuffer(texts[i].as_buffer(), np.uint8)


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return data


def word_symbols(data: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    starts, ends = word_spans(data)
    if len(data) <= piece:
        return word_hashes(data, starts, ends)
    parts, i = [], 0
    while i < len(starts):  # pieces end at words, however long the text is
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + piece)))
        low = starts[i]
        parts.append(word_hashes(data[low : ends[j - 1]], starts[i:j] - low, ends[i:j] - low))
        i = j
    return np.concatenate(parts) if parts else np.zeros(0, U64)


def chunks(texts: pa.Array, symbols: Callable, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols, pieces): short texts put together, long ones cut with an overlap of width - 1. pieces: rows of text, place in
    the text, place in the chunk, windows."""
    held, pieces, size = [], [], 0
    for i in range(len(texts)):
        all_of = symbols(raw(texts, i))
        for at in range(0, len(all_of) - width + 1, CHUNK):
            part = all_of[at : at + CHUNK + width - 1]
            if size and size + len(part) > CHUNK + width:
                yield np.concatenate(held), np.array(pieces, np.int64)
                held, pieces, size = [], [], 0
            held.append(part)
            pieces.append((i, at, size, len(part) - width + 1))
            size += len(part)
    if held:
        yield np.concatenate(held), np.array(pieces, np.int64)


def as_u64(symbols: np.ndarray) -> np.ndarray:
    return BYTE_SYMBOLS[symbols] if symbols.dtype == np.uint8 else symbols


def within(pieces: np.ndarray) -> np.ndarray:
    """All starts of windows of a chunk."""
    counts = pieces[:, 3]
    out = np.ones(counts.sum(), np.int64)
    out[0] = pieces[0, 2]
    at = np.cumsum(counts)[:-1]
    out[at] = pieces[1:, 2] - (pieces[:-1, 2] + counts[:-1] - 1)
    return np.cumsum(out)


class Phrases:
    """The parse of a block: doc (row), start, count of windows, trigger and phrase fingerprints of every phrase."""

    def __init__(self, texts: pa.Array, symbols: Callable, width: int, gram: int):
        found = [self.of(as_u64(x), pieces, width, gram) for x, pieces in chunks(texts, symbols, width)]
        kinds = (np.int32, np.int64, np.int32, U64, U64)
        self.doc, self.start, self.count, self.trigger, self.phrase = (
            [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, k) for k in kinds]
        )

    @staticmethod
    def of(x: np.ndarray, pieces: np.ndarray, width: int, gram: int) -> tuple:
        rolling = Rolling(x, width)
        value = rolling.at(gram)
        mix(value, value)
        low = U64((1 << POSITION_BITS) - 1)
        least = sliding_min((value & ~low) | np.arange(len(value), dtype=U64), width - gram + 1)
        windows = within(pieces)
        trigger = (least[windows] & low).astype(np.int64)
        first = np.ones(len(windows), bool)
        first[1:] = (trigger[1:] != trigger[:-1]) | (windows[1:] != windows[:-1] + 1)
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(windows)) - 1
        s1, s2 = windows[at], windows[last]
        print_ = rolling.at(width, s1)
        mix(print_, print_)
        print_ += rolling.at(width, s2) * U64(0xC2B2AE3D27D4EB4F) + (s2 - s1).astype(U64)
        mix(print_, print_)
        row = np.searchsorted(pieces[:, 2], s1, side="right") - 1
        return (
            pieces[row, 0].astype(np.int32),
            s1 - pieces[row, 2] + pieces[row, 1],
            (s2 - s1 + 1).astype(np.int32),
            mix(value[trigger[at]]),  # least hashes are small: mixed again, they spread over all buckets
            print_,
        )


def distinct(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first row of each distinct key (a, b), and each row's number among the distinct keys."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(a, kind="stable") if b is None else np.lexsort((b, a))
    new = np.ones(len(a), bool)
    new[1:] = a[order[1:]] != a[order[:-1]]
    if b is not None:
        new[1:] |= b[order[1:]] != b[order[:-1]]
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int32)


def planes(x: np.ndarray) -> bytes:
    """64-bit integers by byte planes, so that Spark's compression removes the empty ones."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).view("<i8").ravel()


def low48(x: np.ndarray) -> bytes:
    return x.astype("<u4").tobytes() + (x >> U64(32)).astype("<u2").tobytes()


def of48(data: memoryview, n: int) -> np.ndarray:
    return np.frombuffer(data[: 4 * n], "<u4").astype(U64) | np.frombuffer(data[4 * n : 6 * n], "<u2").astype(U64) << U64(32)


#: Rows between passes: where they go, from which block, what they are, and arrays.
PACKET = "dest int, block int, kind int, n int, body binary"
_SCHEMA = pa.schema([("dest", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])
ASK_PHRASE, ASK_WINDOW, COVERED, PENDING, SHARED, SINGLY = range(6)


def packets(rows: list[tuple]) -> pa.Table:
    pa.default_memory_pool().release_unused()
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)


def spread(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows), rows in their own order within a bucket."""
    to = bucket_of(key, buckets)
    order = np.argsort(to, kind="stable")
    ends = np.flatnonzero(np.diff(to[order])) + 1
    for rows in np.split(order, ends) if len(order) else ():
        yield int(to[rows[0]]), rows


def phrase_order(parse: Phrases, first: np.ndarray, doc: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, distinct phrases in the order in which the bucket's packet has them)."""
    for to, rows in spread(parse.trigger[first], buckets):
        yield to, rows[np.argsort(doc[rows], kind="stable")]


def ask_phrases(width: int, gram: int, buckets: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        ids, texts = ordered(table)
        parse = Phrases(texts, byte_symbols, width, gram)
        first, _ = distinct(parse.trigger, parse.phrase)
        block, out = table["block"][0].as_py(), []
        doc = ids[parse.doc[first]]
        for to, rows in phrase_order(parse, first, doc, buckets):
            t, p = parse.trigger[first[rows]], parse.phrase[first[rows]]
            out.append((to, block, ASK_PHRASE, len(rows), low48(t) + low48(p) + planes(np.diff(doc[rows], prepend=0))))
        return packets(out)

    return run


def gathered(table: pa.Table) -> tuple:
    """Both fingerprints, id, packet and place in it of all that packets ask."""
    columns: list[list] = [[] for _ in range(5)]
    for i, (n, body) in enumerate(zip(table["n"].to_pylist(), table["body"], strict=True)):
        view = memoryview(body.as_buffer())
        for c, x in zip(columns, (of48(view, n), of48(view[6 * n :], n), np.cumsum(unplanes(view[12 * n : 20 * n], n)), np.full(n, i, np.int32), np.arange(n)), strict=True):
            c.append(x)
    return tuple(np.concatenate(c) for c in columns)


def grouped(source: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of each packet."""
    order = np.argsort(source, kind="stable")
    return iter(np.split(order, np.flatnonzero(np.diff(source[order])) + 1) if len(order) else ())


def settle_phrases(hot: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        """For each asked phrase: whether an earlier document has it; whether its windows must be compared, and whether singly. Replies name the bucket and places in its packet."""
        table = table.combine_chunks()
        trigger, phrase, doc, source, place = gathered(table)
        blocks, bucket = table["block"].to_numpy(), table["dest"][0].as_py()
        order = np.lexsort((doc, phrase, trigger))
        t, p, d = trigger[order], phrase[order], doc[order]
        new_t = np.ones(len(t), bool)
        new_t[1:] = t[1:] != t[:-1]
        new_p = new_t.copy()
        new_p[1:] |= p[1:] != p[:-1]
        heads = np.flatnonzero(new_p)
        least = d[heads]  # the earliest document of each phrase
        number = np.cumsum(new_p) - 1
        covered = d > least[number]
        of_trigger = np.flatnonzero(new_t[heads])
        low, high = np.minimum.reduceat(least, of_trigger), np.maximum.reduceat(least, of_trigger)
        size = np.diff(np.append(of_trigger, len(heads)))
        opened, many = heads[np.repeat(low < high, size)], heads[np.repeat((low < high) & (size > hot), size)]
        out = []
        for kind, rows in ((COVERED, order[covered]), (PENDING, order[opened]), (SINGLY, order[many])):
            for k in grouped(source[rows]):
                block = int(blocks[source[rows[k[0]]]])
                out.append((block, bucket, kind, len(k), np.sort(place[rows[k]]).astype("<u4").tobytes()))
        return packets(out)

    return run


def expand(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... count numbers of each."""
    if not len(start):
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(ends[-1]) + np.repeat(start - (ends - count), count)


def open_phrases(width: int, gram: int, buckets: int) -> Callable:
    def run(key: tuple, table: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not table.num_rows:
            return packets([])
        block, (ids, texts) = table["block"][0].as_py(), ordered(table)
        parse = Phrases(texts, byte_symbols, width, gram)
        first, number = distinct(parse.trigger, parse.phrase)
        orders = dict(phrase_order(parse, first, ids[parse.doc[first]], buckets))
        flags = {k: np.zeros(len(first), bool) for k in (COVERED, PENDING, SINGLY)}
        for bucket, kind, body in zip(*(verdicts[c].to_pylist() for c in ("block", "kind", "body")), strict=True):
            flags[kind][orders[bucket][np.frombuffer(body, "<u4")]] = True
        doc = ids[parse.doc]
        covered = flags[COVERED][number] | (doc > doc[first][number])
        spans = merged(parse.doc[covered], parse.start[covered], parse.count[covered].astype(np.int64) + width - 1)
        out, home = [], block % buckets
        if len(spans[0]):
            out.append((home, block, SHARED, len(spans[0]), b"".join(planes(np.diff(x, prepend=0)) for x in spans)))
        asked = flags[PENDING] & ~flags[COVERED]
        # a phrase asks from its first place; its other places in that document follow
        others = np.flatnonzero(asked[number] & ~covered)
        others = others[others != first[number[others]]]
        if len(others):
            origin, each = first[number[others]], np.where(flags[SINGLY][number[others]], parse.count[others], 1)
            step = expand(np.zeros(len(others), np.int64), each)
            again = [np.repeat(x, each) for x in (parse.doc[origin], parse.start[origin], parse.doc[others], parse.start[others])]
            out.append((home, block, PENDING, len(step), planes(again[0]) + planes(again[1] + step) + planes(again[2]) + planes(again[3] + step)))
        for singly in (False, True):
            p = first[asked & (flags[SINGLY] == singly)]
            for part in np.array_split(p, 1 + len(p) // (1 << 14)) if singly else [p]:
                out += asked_windows(block, ids, texts, parse, part, width, buckets, singly)
        return packets(out)

    return run


def asked_windows(block: int, ids: np.ndarray, texts: pa.Array, parse: Phrases, asked: np.ndarray, width: int, buckets: int, singly: bool) -> list[tuple]:
    """Packets of phrases (singly: of each of their windows) with id, row and place, count of windows, and bytes."""
    if not len(asked):
        return []
    row, at, count = parse.doc[asked].astype(np.int64), parse.start[asked], parse.count[asked].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    begin = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset :][row] + at
    if singly:
        size = count + width - 1
        keys = Rolling(as_u64(data[expand(begin, size)]), width).at(width, expand(np.cumsum(size) - size, count))
        keys = mix(keys, keys)
        row, at, begin, count = np.repeat(row, count), expand(at, count), expand(begin, count), np.ones(len(keys), np.int64)
    else:
        keys = parse.trigger[asked]
    out = []
    for to, rows in spread(keys, buckets):
        rows = rows[np.lexsort((at[rows], row[rows]))]
        body = b"".join(planes(np.diff(x[rows], prepend=0)) for x in (ids[row], row, at)) + planes(count[rows])
        out.append((to, block, ASK_WINDOW, len(rows), body + data[expand(begin[rows], count[rows] + width - 1)].tobytes()))
    return out


def suffix_array(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of starts in the order of the `depth` bytes there, by letter, and whether each differs from the one before.

    Suffixes are sorted by eight bytes at a time, read as a number; those still tied go on to the next eight.
    """
    step = min(8, depth)
    word, padded = np.zeros(len(data), U64), np.append(data, np.zeros(step, np.uint8))
    for k in range(step):
        word = word << U64(8) | padded[k : k + len(data)]
    key = word[starts]
    order = np.argsort(key, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    for offset in [*range(step, depth - step + 1, step), *([depth - step] if depth % step else [])]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        key = word[starts[order[at]] + offset]
        by = np.lexsort((key, np.cumsum(new)[at]))
        order[at], key = order[at[by]], key[by]
        new[at[1:]] |= key[1:] != key[:-1]
    return order, new


def settle_windows(width: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        """For each asked phrase: the runs of its windows that an earlier document has. Other packets pass."""
        table = table.combine_chunks()
        kinds = table["kind"].to_numpy()
        passed = table.filter(pa.array(kinds != ASK_WINDOW))
        passed = passed.set_column(0, "dest", passed["block"]).cast(_SCHEMA)
        asked = table.filter(pa.array(kinds == ASK_WINDOW))
        if not asked.num_rows:
            return passed
        numbers: dict[bytes, int] = {}  # the dictionary
        columns: list[list] = [[] for _ in range(5)]
        parse: list[int] = []
        for i, (n, body) in enumerate(zip(asked["n"].to_pylist(), asked["body"].to_pylist(), strict=True)):
            x = [unplanes(body[8 * k * n : 8 * (k + 1) * n], n) for k in range(4)]
            for c, y in zip(columns, (*map(np.cumsum, x[:3]), x[3], np.full(n, i, np.int32)), strict=True):
                c.append(y)
            ends = (32 * n + np.cumsum(x[3] + width - 1)).tolist()
            parse += [numbers.setdefault(body[s:e], len(numbers)) for s, e in zip([32 * n, *ends[:-1]], ends, strict=True)]
        doc, row, at, count, source = (np.concatenate(c) for c in columns)
        phrase = np.array(parse)
        least = np.full(len(numbers), NO_ID)
        np.minimum.at(least, phrase, doc)
        size = np.array([len(x) for x in numbers])
        windows = size - width + 1
        order, new = suffix_array(np.frombuffer(b"".join(numbers), np.uint8), expand(np.cumsum(size) - size, windows), width)
        of = np.repeat(least, windows)
        earliest = np.empty(len(of), np.int64)
        earliest[order] = np.minimum.reduceat(of[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        owner, offset = np.repeat(np.arange(len(doc)), count), expand(np.zeros(len(doc), np.int64), count)
        hit = earliest[(np.cumsum(windows) - windows)[phrase][owner] + offset] < doc[owner]
        apart = np.append(owner[1:] != owner[:-1], True)
        begin, end = hit.copy(), hit & (apart | ~np.append(hit[1:], False))
        begin[1:] &= apart[:-1] | ~hit[:-1]
        begin, end = np.flatnonzero(begin), np.flatnonzero(end)
        p, offset, runs = owner[begin], offset[begin], end - begin + 1
        blocks, out = asked["block"].to_numpy(), []
        for k in grouped(source[p]):
            block = int(blocks[source[p[k[0]]]])
            out.append((block, block, COVERED, len(k), b"".join(planes(np.diff(x[p[k]], prepend=0)) for x in (row, at)) + planes(offset[k]) + planes(runs[k])))
        return pa.concat_tables([passed, packets(out)])

    return run


def merged(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans (row of text, start, end) of all symbols covered; spans that touch are one."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((start, doc))
    doc, start, end = doc[order].astype(np.int64), start[order].astype(np.int64), (start + count)[order].astype(np.int64)
    big = int(end.max()) + 1
    low, high = doc * big + start, np.maximum.accumulate(doc * big + end)
    new = np.ones(len(doc), bool)
    new[1:] = low[1:] > high[:-1]
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], low[at] - doc[at] * big, high[last] - doc[at] * big


def spans_of(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal covered spans of a block from its packets."""
    found, again, hits = [], [], []
    for kind, n, body in zip(table["kind"].to_pylist(), table["n"].to_pylist(), table["body"], strict=True):
        view = memoryview(body.as_buffer())
        x = [unplanes(view[8 * k * n : 8 * (k + 1) * n], n) for k in range(len(view) // (8 * n))]
        if kind == PENDING:
            again.append(np.array(x))
            continue
        x[:2] = [np.cumsum(c) for c in x[:2]]
        if kind == SHARED:
            found.append((x[0], x[1], np.cumsum(x[2]) - x[1]))
        else:
            hits.append(np.array(x))
            found.append((x[0], x[1] + x[2], x[3] + width - 1))
    if again and hits:
        a, h = np.concatenate(again, axis=1), np.concatenate(hits, axis=1)
        big = max(a[1].max(), h[1].max()) + 1
        h = h[:, np.argsort(h[0] * big + h[1], kind="stable")]
        low, high = (np.searchsorted(h[0] * big + h[1], a[0] * big + a[1], side=x) for x in ("left", "right"))
        to, of = np.repeat(np.arange(len(low)), high - low), expand(low, high - low)
        found.append((a[2][to], a[3][to] + h[2][of], h[3][of] + width - 1))
    return merged(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else merged(*[np.zeros(0, np.int64)] * 3)


def remove_repeats(docs: DataFrame, finish: Callable, schema: str, *, width: int, gram: int, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """finish(ids, texts, spans) makes the rows of a block; spans(i) gives starts and ends of covered symbols of row i."""
    blocks, n = dealt(docs, doc_id, text, block_bytes)
    by_block = blocks.groupBy("block")

    def final(key: tuple, table: pa.Table, verdicts: pa.Table) -> pa.Table:
        ids, texts = ordered(table)
        doc, start, end = spans_of(verdicts.combine_chunks(), width)
        edge = np.searchsorted(doc, np.arange(len(ids) + 1))
        return finish(ids, texts, lambda i: (start[edge[i] : edge[i + 1]], end[edge[i] : edge[i + 1]]))

    asked = by_block.applyInArrow(ask_phrases(width, gram, n), PACKET)
    first = asked.groupBy("dest").applyInArrow(settle_phrases(hot), PACKET)
    opened = by_block.cogroup(first.groupBy("dest")).applyInArrow(open_phrases(width, gram, n), PACKET)
    second = opened.groupBy("dest").applyInArrow(settle_windows(width), PACKET)
    return by_block.cogroup(second.groupBy("dest")).applyInArrow(final, schema)

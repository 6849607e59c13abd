"""Language-model scores from Brown classes: class transitions times word emissions.

Tokens: lower-cased (A-Z) words `[^\\x20\\x09-\\x0D]+`, then one end of text. Training rows are those whose
crc32(doc_id as text) modulo `folds` is not 0.

Classes. The `frequent` most frequent words (ties by hash) are clustered by exchange: each word in turn moves to the class that raises
the likelihood of their bigrams most, from a start that deals them out by frequency, until a sweep moves none
or `sweeps` are done. Every other training word is then placed in one of these classes by the exchange's gain (ties: the first) over all its bigrams
in training, whose other words stand for their classes: the exchange's, the end's, or one for all words that aren't frequent. All words are placed by one
table, so that no order matters. Unseen words are one more word of the class that has the most words. The end has a class of its own.
P(w | v) = P(class w | class v) P(w | class w), both smoothed: transitions by adding `prior` times the class's unigram share,
emissions by adding 0.1 to each count (one more for the unseen). A text starts after an end.

Work at scale: a block of documents sends the counts of its distinct words to their buckets once, by hash, and the bigrams of its other words; a bucket
answers each block with corpus counts and classes in the block's own order. Nothing of the vocabulary goes to the driver but the frequent words and the table
of their bigrams, nor is it broadcast. Each text's class transitions are kept, so that the model's are added up and applied without reading texts again.
Words are told apart by 64-bit hashes.

Contract of score(): whole texts (null: empty, so the end alone); one row per input row; null ids score as held in
training under the text "null"; other columns aren't read; an empty training set gives finite scores; an empty table an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import settled, tidy
from .hashing import LOWER, U64, mix, release
from .repeats import BLOCK_BYTES, NO_ID, dealt, expand, ordered, plain_docs, raw, spread, word_symbols

FREQUENT = 1000
CLASSES = 48
SWEEPS = 4
FOLDS = 10
PRIOR = 2.0
#: Tokens whose bigrams are sorted at once.
CHUNK_TOKENS = 1 << 20
END = U64(0xE7037ED1A0B428DB)
#: Rows between blocks of documents and buckets of words: where they go, where from, and arrays.
ROW = "dest int, block int, n int, body binary"
_ROW = pa.schema([("dest", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(ids: np.ndarray, folds: int) -> np.ndarray:
    return np.array([zlib.crc32(b"null" if i == NO_ID else str(i).encode()) % folds == 0 for i in ids.tolist()], bool)


class Tokens:
    """Token hashes of texts end to end, and which of them are in training."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, folds: int):
        parts = []
        for i in range(len(texts)):
            parts += [word_symbols(LOWER[raw(texts, i)]), np.array([END])]
        self.ids, self.tokens = ids, np.concatenate(parts) if parts else np.zeros(0, U64)
        self.sizes = np.array([len(a) + 1 for a in parts[::2]], np.int64)
        self.held = held_out(ids, folds)
        self.train = np.repeat(~self.held, self.sizes)


class Block(Tokens):
    """With the distinct words in the order of hashes, and each token's place among them."""

    def __init__(self, table: pa.Table, folds: int):
        super().__init__(*ordered(table), folds)
        self.words, self.number = np.unique(self.tokens, return_inverse=True)


def pieces(batches: Iterator[pa.RecordBatch], folds: int) -> Iterator[Tokens]:
    """Tokens of (doc_id, text) rows in any order, some CHUNK_TOKENS at a time."""
    for batch in batches:
        low, size = 0, 0
        for i, x in enumerate(batch.column(1)):
            size += len(x.as_buffer())
            if size > 4 * CHUNK_TOKENS or i + 1 == batch.num_rows:
                part = batch.slice(low, i + 1 - low)
                yield Tokens(np.array(part.column(0)), part.column(1), folds)
                low, size = i + 1, 0


def rows_of(rows: list[tuple]) -> pa.Table:
    release()
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)


def ask(buckets: int, folds: int) -> Callable:
    """Distinct words of a block with their counts in training, to their buckets."""

    def run(table: pa.Table) -> pa.Table:
        b = Block(table, folds)
        counts = np.bincount(b.number[b.train], minlength=len(b.words))
        out = []
        for to, rows in spread(mix(b.words), buckets):
            out.append((to, table["block"][0].as_py(), len(rows), b.words[rows].astype("<u8").tobytes() + counts[rows].astype("<u4").tobytes()))
        return rows_of(out)

    return run


class Asked:
    """What blocks ask of a bucket: its distinct words, their counts in training, and the place of each asked word among them."""

    def __init__(self, table: pa.Table):
        words, counts, self.sizes = [], [], table["n"].to_pylist()
        for n, body in zip(self.sizes, table["body"], strict=True):
            view = memoryview(body.as_buffer())
            words.append(np.frombuffer(view[: 8 * n], "<u8"))
            counts.append(np.frombuffer(view[8 * n : 12 * n], "<u4"))
        self.words, self.number = np.unique(np.concatenate(words), return_inverse=True)
        self.counts = np.bincount(self.number, np.concatenate(counts), len(self.words)).astype(np.int64)
        self.blocks, self.bucket = table["block"].to_pylist(), table["dest"][0].as_py()


FACT = "kind int, a long, b long"


def fact_rows(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])


def totals_of(frequent: int) -> Callable:
    """Rows (0, distinct words, tokens) of a bucket, and (1, word, count) of its most frequent words, so that Spark adds and ranks them."""

    def run(table: pa.Table) -> pa.Table:
        asked = Asked(table.combine_chunks())
        best = np.lexsort((asked.words.view(np.int64), -asked.counts))[:frequent]
        best = best[asked.counts[best] > 0]
        return fact_rows(np.append(0, np.ones(len(best))), np.append((asked.counts > 0).sum(), asked.words[best].view(np.int64)), np.append(asked.counts.sum(), asked.counts[best]))

    return run


def exchange(bigrams: np.ndarray, counts: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of each word by the exchange algorithm over a square table of bigram counts of words ordered by frequency."""
    n = len(counts)
    classes = max(1, min(classes, n))
    label = np.arange(n) % classes
    xlogx = lambda x: x * np.log(np.maximum(x, 1))
    off = bigrams.astype(float)
    own = off.diagonal().copy()
    np.fill_diagonal(off, 0)
    to = np.zeros((n, classes))  # from each word to each class, without itself
    fro = np.zeros((n, classes))
    for c in range(classes):
        to[:, c], fro[:, c] = off[:, label == c].sum(1), off[label == c].sum(0)
    table = np.zeros((classes, classes))
    np.add.at(table, label, to)
    np.add.at(table, (label, label), own)
    left, right = table.sum(1), table.sum(0)
    eye = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            a, o, i, s = label[w], to[w], fro[w], own[w]
            table[a] -= o
            table[:, a] -= i
            table[a, a] -= s
            wo, wi = o.sum() + s, i.sum() + s
            left[a] -= wo
            right[a] -= wi
            # the change of sum(t log t) - sum(left log left) - sum(right log right) if w joins each class
            row, col = table + o, table + i[:, None]
            gain = (xlogx(row) - xlogx(table)).sum(1) + (xlogx(col) - xlogx(table)).sum(0)
            d = table[eye, eye]
            gain += xlogx(d + o + i + s) - xlogx(d + o) - xlogx(d + i) + xlogx(d)
            gain -= xlogx(left + wo) - xlogx(left) + xlogx(right + wi) - xlogx(right)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += o
            table[:, b] += i
            table[b, b] += s
            left[b] += wo
            right[b] += wi
            if b != a:
                moved += 1
                label[w] = b
                to[:, a] -= off[:, w]
                to[:, b] += off[:, w]
                fro[:, a] -= off[w]
                fro[:, b] += off[w]
        if not moved:
            break
    return label


class Model:
    """What of the model is the same for every block, bounded by the numbers of frequent words and of classes."""

    def __init__(self, tokens: int, vocabulary: int, words: np.ndarray, counts: np.ndarray):
        """words, counts: the most frequent of all, the end among them or not."""
        self.tokens, self.vocabulary = tokens, vocabulary
        keep = words != END
        order = np.argsort(words[keep])
        self.words, self.counts = words[keep][order], counts[keep][order]

    def index(self, words: np.ndarray) -> np.ndarray:
        """Place among the frequent words; after these, that of the end, and one for all others."""
        n = len(self.words)
        at = np.minimum(np.searchsorted(self.words, words), max(0, n - 1))
        known = self.words[at] == words if n else np.zeros(len(words), bool)
        return np.where(known, at, np.where(words == END, n, n + 1))

    def set_classes(self, label: np.ndarray, bigrams: np.ndarray) -> None:
        """By place: 0 the end, then the exchange's classes, then one for all other words. bigrams: by place."""
        self.classes = 1 + max(1, int(label.max()) + 1 if len(label) else 0)
        self.label = np.concatenate([label + 1, [0, self.classes]])
        self.table = np.zeros((self.classes + 1, self.classes + 1))
        np.add.at(self.table, (self.label[:, None], self.label[None]), bigrams)

    def set_sizes(self, size: np.ndarray, mass: np.ndarray) -> None:
        """Words and tokens of each class."""
        self.size, self.mass = size.astype(float), mass.astype(float)
        self.unseen = 1 + int(np.argmax(self.size[1:]))
        self.size[self.unseen] += 1

    def emission(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.mass[classes] + 0.1 * self.size[classes]))

    def set_transitions(self, table: np.ndarray, prior: float) -> None:
        share = (table.sum(0) + 0.01) / (table.sum() + 0.01 * self.classes)
        self.steps = np.log10((table + prior * share) / (table.sum(1, keepdims=True) + prior))


CELL = "cell long, n long"


def cell_rows(total: np.ndarray) -> pa.RecordBatch:
    cell = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(total[cell], pa.int64())], names=["cell", "n"])


def pairs_of_words(folds: int, model: Model) -> Callable:
    """Bigrams in training by the places of their words."""
    n = len(model.words) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for b in pieces(batches, folds):
            place = model.index(b.tokens)
            cell, count = np.unique((np.append(n - 2, place[:-1]) * n + place)[b.train], return_counts=True)
            total[cell] += count
        yield cell_rows(total)
        del total
        release()

    return run


def contexts(buckets: int, folds: int, model: Model) -> Callable:
    """To each bucket: words that aren't frequent, and the classes before and after them in training. Neighbours that aren't frequent either are what is left of a word's count."""
    k = model.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, folds):
            c = model.label[model.index(b.tokens)]
            rare = b.train & (c == k)
            before, after = np.append(0, c[:-1]), np.append(c[1:], 0)
            word = np.concatenate([b.tokens[rare & (before < k)], b.tokens[rare & (after < k)]])
            code = np.concatenate([before[rare & (before < k)], k + after[rare & (after < k)]])
            words, number = np.unique(word, return_inverse=True)
            cell, tokens = np.unique(number * (2 * k) + code, return_counts=True)
            edge, rows = np.searchsorted(cell, np.arange(len(words) + 1) * 2 * k), []
            for to, at in spread(mix(words), buckets):
                n = np.diff(edge)[at]
                take = expand(edge[at], n)
                body = words[at].astype("<u8").tobytes() + n.astype("<u4").tobytes() + (cell[take] % (2 * k)).astype("<u2").tobytes() + tokens[take].astype("<u4").tobytes()
                rows.append((to, -1, len(at), zstandard.compress(body, 1)))
            yield from rows_of(rows).to_batches()

    return run


def gains(model: Model, word: np.ndarray, cell: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    """The exchange's gain for each of n words and each class but the end's. word: rising; cell: class before, or the number of all classes plus that after."""
    k, xlogx = model.classes + 1, lambda x: x * np.log(np.maximum(x, 1))
    # by side and neighbour, then class: what a class has with the neighbour so far
    own = np.concatenate([model.table, model.table.T])[:, 1 : k - 1]
    total = np.array([model.table.sum(0), model.table.sum(1)])[:, 1 : k - 1]
    once = xlogx(own + 1) - xlogx(own)
    out, mass = np.zeros((n, k - 2)), np.zeros((n, 2))
    np.add.at(mass, (word, (cell >= k).astype(int)), tokens)
    for side in range(2):
        out -= xlogx(total[side] + mass[:, side, None]) - xlogx(total[side])
    for at in range(0, len(word), 1 << 13):
        part = slice(at, at + (1 << 13))
        value, more = once[cell[part]], np.flatnonzero(tokens[part] > 1)
        held = own[cell[part][more]]
        value[more] = xlogx(held + tokens[part][more, None]) - xlogx(held)
        first = np.flatnonzero(np.append(True, np.diff(word[part]) > 0))
        out[word[part][first]] += np.add.reduceat(value, first)
    return out


def place_words(model: Model) -> Callable:
    """To every block: counts and classes of the words that it asked for, in its order (class 0 of words out of training: unseen). To dest -1: words and tokens of each class."""
    k = model.classes

    def run(key: tuple, table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rows_of([])
        asked = Asked(table.combine_chunks())
        label = model.label[model.index(asked.words)]
        words, cells, tokens = [], [], []
        for n, body in zip(found["n"].to_pylist(), found["body"].to_pylist(), strict=True):
            view = memoryview(zstandard.decompress(body))
            m = np.frombuffer(view[8 * n : 12 * n], "<u4").astype(np.int64)
            e = int(m.sum())
            words.append(np.repeat(np.frombuffer(view[: 8 * n], "<u8"), m))
            cells.append(np.frombuffer(view[12 * n : 12 * n + 2 * e], "<u2").astype(np.int64))
            tokens.append(np.frombuffer(view[12 * n + 2 * e :], "<u4").astype(np.int64))
        rare = np.flatnonzero((label == k) & (asked.counts > 0))
        known = np.zeros((len(rare), 2), np.int64)
        place = np.full(len(asked.words), -1)
        place[rare] = np.arange(len(rare))
        pair, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if words:
            # codes of the second side come after the class of all other words
            code = np.concatenate(cells)
            code += code >= k
            pair, where = np.unique(place[np.searchsorted(asked.words, np.concatenate(words))] * (2 * k + 2) + code, return_inverse=True)
            count = np.bincount(where, np.concatenate(tokens), len(pair)).astype(np.int64)
            np.add.at(known, (pair // (2 * k + 2), (pair % (2 * k + 2) > k).astype(int)), count)
        rest = asked.counts[rare, None] - known
        i, side = np.nonzero(rest)
        pair, count = np.append(pair, i * (2 * k + 2) + k + side * (k + 1)), np.append(count, rest[i, side])
        order = np.argsort(pair)
        pair, count = pair[order], count[order]
        edge = np.searchsorted(pair, np.arange(len(rare) + 1) * (2 * k + 2))
        for at in range(0, len(rare), 1 << 13):
            to = min(at + (1 << 13), len(rare))
            r = slice(edge[at], edge[to])
            label[rare[at:to]] = 1 + np.argmax(gains(model, pair[r] // (2 * k + 2) - at, pair[r] % (2 * k + 2), count[r], to - at), 1)
        label[(label == k) | ((asked.counts == 0) & (label > 0))] = 0
        edges = np.cumsum([0, *asked.sizes])
        out = []
        for i, (block, n) in enumerate(zip(asked.blocks, asked.sizes, strict=True)):
            each = asked.number[edges[i] : edges[i + 1]]
            out.append((block, asked.bucket, n, zstandard.compress(asked.counts[each].astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() + label[each].astype("<u2").tobytes(), 1)))
        seen = asked.counts > 0
        size, mass = np.bincount(label[seen], minlength=k), np.bincount(label[seen], asked.counts[seen], k)
        out.append((-1, asked.bucket, k, size.astype("<i8").tobytes() + mass.astype("<i8").tobytes()))
        return rows_of(out)

    return run


def class_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for n, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.frombuffer(body, "<i8")
            yield from fact_rows(np.arange(n), x[:n], x[n:]).to_batches()


#: A text's class transitions: cells (class before, class) as 32-bit integers, then counts, compressed.
CLASSED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emissions double, steps binary"
_CLASSED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("emissions", pa.float64()), ("steps", pa.binary())])


def classed(buckets: int, folds: int, model: Model) -> Callable:
    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _CLASSED.empty_table()
        b = Block(table, folds)
        got = {d: body for d, body in zip(answers["block"].to_pylist(), answers["body"].to_pylist(), strict=True)}
        counts, label = np.zeros(len(b.words), np.int64), np.zeros(len(b.words), np.int64)
        for to, rows in spread(mix(b.words), buckets):
            n, body = len(rows), memoryview(zstandard.decompress(got[to]))
            counts[rows] = np.ascontiguousarray(np.frombuffer(body[: 8 * n], np.uint8).reshape(8, n).T).view("<i8").ravel()
            label[rows] = np.frombuffer(body[8 * n :], "<u2")
        label[(label == 0) & (b.words != END)] = model.unseen
        c = label[b.number]
        starts, row = np.cumsum(b.sizes) - b.sizes, np.repeat(np.arange(len(b.ids)), b.sizes)
        pair, times = np.unique(row * model.classes**2 + np.append(0, c[:-1]) * model.classes + c, return_counts=True)
        edge, cell = np.searchsorted(pair, np.arange(len(b.ids) + 1) * model.classes**2), pair % model.classes**2
        press = zstandard.ZstdCompressor(level=1)
        steps = [press.compress(cell[i:j].astype("<u4").tobytes() + times[i:j].astype("<u4").tobytes()) for i, j in zip(edge[:-1], edge[1:], strict=True)]
        total = lambda x: np.add.reduceat(x[b.number], starts)
        base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.vocabulary + 1)))
        columns = [b.ids, b.held, b.sizes, total((counts > 0).astype(np.int64)), total(base), total(model.emission(label, counts)), steps]
        del c, row, pair
        release()
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, _CLASSED, strict=True)], schema=_CLASSED)

    return run


def steps_of(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(zstandard.decompress(body), "<u4").astype(np.int64).reshape(2, -1))


def pairs_of_classes(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(model.classes**2, np.int64)
        for batch in batches:
            for body in batch.column(0).to_pylist():
                cell, n = steps_of(body)
                total[cell] += n
        yield cell_rows(total)

    return run


def scored(model: Model) -> Callable:
    flat = model.steps.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moves = np.array([flat[cell] @ n for cell, n in map(steps_of, batch.column(6).to_pylist())], float)
            score = pa.array(np.array(batch.column(5)) + moves)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.full(batch.num_rows, model.tokens)), batch.column(4), score], names=[x.split()[0] for x in SCORES.split(", ")])

    return run


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", folds: int = FOLDS, frequent: int = FREQUENT, classes: int = CLASSES, sweeps: int = SWEEPS, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed unigrams), score (log10 probability)."""
    blocks, n = dealt(docs, doc_id, text, block_bytes)
    by_block, plain = blocks.groupBy("block"), plain_docs(docs, doc_id, text)

    def added(cells: DataFrame, size: int) -> np.ndarray:
        """A square table of so many rows, whose cells were counted in parts."""
        table = np.zeros(size * size)
        with tidy(docs.sparkSession):
            found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        table[found["cell"].to_numpy()] = found["n"].to_numpy()
        return table.reshape(size, size)

    # words are sent to their buckets once, and kept: they are ranked first, and placed and answered when the classes are known
    asked = settled(by_block.applyInArrow(ask(n, folds), ROW))
    facts = settled(asked.groupBy("dest").applyInArrow(totals_of(frequent), FACT))
    words_in_all, tokens = facts.where("kind = 0").agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    best = facts.where("kind = 1").orderBy(F.desc("b"), "a").limit(frequent).collect()
    model = Model(tokens, words_in_all, np.array([r.a for r in best], np.int64).view(U64), np.array([r.b for r in best], np.int64))
    bigrams = added(plain.mapInArrow(pairs_of_words(folds, model), CELL), len(model.words) + 2)
    by_count = np.lexsort((model.words, -model.counts))
    label = np.empty(len(by_count), np.int64)
    label[by_count] = exchange(bigrams[np.ix_(by_count, by_count)], model.counts[by_count], classes, sweeps)
    model.set_classes(label, bigrams)
    sent = plain.mapInArrow(contexts(n, folds, model), ROW)
    placed = settled(asked.groupBy("dest").cogroup(sent.groupBy("dest")).applyInArrow(place_words(model), ROW))
    size, mass = np.zeros(model.classes, np.int64), np.zeros(model.classes, np.int64)
    for c, words, count in placed.where("dest = -1").select("n", "body").mapInArrow(class_facts, FACT).groupBy("kind").agg(F.sum("a"), F.sum("b")).collect():
        size[c], mass[c] = words, count
    model.set_sizes(size, mass)
    known = settled(by_block.cogroup(placed.where("dest >= 0").groupBy("dest")).applyInArrow(classed(n, folds, model), CLASSED))
    model.set_transitions(added(known.where("not held_out").select("steps").mapInArrow(pairs_of_classes(model), CELL), model.classes), prior)
    out = known.mapInArrow(scored(model), SCORES)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))

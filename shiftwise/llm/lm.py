"""N-gram scoring with Elias-Fano tries.

Texts are tokenised once into blocks (up to ``BLOCK_BYTES`` of text): word numbers inside the block and hashes of its distinct words,
written to the shared folder. Counts then travel as packed arrays, one entry per block and distinct n-gram, so neither a frequent word nor a
frequent n-gram makes a hot key:

1. Word shards add up the training counts and number the words; the counts go back to the blocks.
2. Order by order from two up, blocks send their distinct (context, word) pairs to pair shards; a context is a learned n-gram of the order
   below, by its number. A shard builds a trie level of its training pairs and returns one byte per pair to each block, and for the next
   order the numbers and counts of the learned pairs. Pairs are exchanged a portion of the shards at a time, and a portion's shuffle
   files go before the next one starts.
3. Blocks add up the scores of their documents.

Smoothing is by a Dirichlet prior, p(w | h) = (c(hw) + prior * p(w | h')) / (c(h) + prior), where h' is h without its first word, with the
add-half unigram p(w) below; it sums to 1 over the vocabulary and one unknown word. A text begins with ``order - 1`` starts. After a context
that was never learned p(w | h) = p(w | h'), so nothing is sent for it. A trie level has Elias-Fano contexts, monotone Elias-Fano pointers to their
successors, Elias-Fano successors, stored relative to their context, and a byte of quantised log-probability per pair, all in one
memory-mapped file that is gone with its task. A pair is found by successor search inside the range its context points to, which decodes
the stretches it needs; for pairs that aren't there the block backs off to ``prior * p(w | h') / (c(h) + prior)`` itself.
"""

from __future__ import annotations

import tempfile
from contextlib import contextmanager
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftwise.llm import words
from shiftwise.llm.bpe import chunks
from shiftwise.llm.langid import fold
from shiftwise.session import work_path

BLOCK_BYTES = 12 << 20
WORDS_PER_SHARD, PAIRS_PER_SHARD = 1_000_000, 1_500_000
ORDER = 3  # of the query
PORTIONS = 1  # in which an order's pairs are exchanged
PRIOR = 100.0
STEP = 0.04  # of the quantised log10 probabilities
ABSENT = 255
BEGIN = 1  # number of the context that holds starts only; 0 is one that was not learned
END, START = np.uint64(1), np.uint64(2)  # take the place of hashes


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers in the smallest type that holds them, all lowest bytes first, then the next ones, compressed."""
    out = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        kind = next(t for t in ("<u1", "<u2", "<u4", "<u8") if top < 1 << (8 * int(t[2])))
        body = a.astype(kind).view("u1").reshape(len(a), int(kind[2])).T.tobytes()
        out += [kind.encode(), len(body).to_bytes(8, "little"), body]
    return zstandard.compress(b"".join(out), 1)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    while at < len(raw):
        kind, size = raw[at : at + 3].decode(), int.from_bytes(raw[at + 3 : at + 11], "little")
        width = int(kind[2])
        planes = np.frombuffer(raw, "u1", size, at + 11).reshape(width, size // width)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += 11 + size
    return out


def gaps(a: np.ndarray) -> np.ndarray:
    """Steps of an ascending sequence, the first value in front: small numbers, which pack well. ``np.cumsum`` undoes it."""
    return np.diff(a.astype(np.int64), prepend=0)


def after_gaps(steps: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Sequences one after the other, each from its own steps."""
    total = np.cumsum(steps, dtype=np.int64)
    first = np.cumsum(runs, dtype=np.int64) - runs
    return total - np.repeat(total[first] - steps[first].astype(np.int64), runs)


class EliasFano:
    """Monotone sequence: the low bits packed, the high bits in unary; ``store`` places an array in the trie's file."""

    def __init__(self, values: np.ndarray, store):
        values = values.astype(np.int64)
        self.n = len(values)
        top = int(values[-1]) + 1 if self.n else 1
        self.low_bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        low = values & ((1 << self.low_bits) - 1)
        bits = (low[:, None] >> np.arange(self.low_bits)) & 1 if self.low_bits else np.zeros((self.n, 0), np.int64)
        self.low = store(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
        ones = (values >> self.low_bits) + np.arange(self.n)
        high = np.zeros(int(ones[-1]) + 1 if self.n else 0, np.uint8)
        high[ones] = 1
        self.high = store(np.packbits(high, bitorder="little"))
        # Every CHUNK-th value and the place of its bit: a search goes to the stretch it needs.
        self.marks, self.firsts = ones[:: self.CHUNK].copy(), values[:: self.CHUNK].copy()

    CHUNK = 1 << 13

    def chunk(self, i: int) -> np.ndarray:
        """Values ``i * CHUNK`` and following, decoded."""
        first, last = i * self.CHUNK, min(self.n, (i + 1) * self.CHUNK)
        if first >= last:
            return np.zeros(0, np.int64)
        start = int(self.marks[i]) >> 3
        stop = (int(self.marks[i + 1]) >> 3) + 1 if i + 1 < len(self.marks) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[start:stop], bitorder="little")) + 8 * start
        ones = ones[ones >= self.marks[i]][: last - first]
        at = first * self.low_bits
        bits = np.unpackbits(self.low[at >> 3 : -(-last * self.low_bits // 8)], bitorder="little")[at & 7 :]
        bits = bits[: (last - first) * self.low_bits].reshape(last - first, self.low_bits).astype(np.int64)
        low = (bits << np.arange(self.low_bits)).sum(axis=1)
        return (ones - np.arange(first, last) << self.low_bits) | low

    def all(self) -> np.ndarray:
        parts = [self.chunk(i) for i in range(len(self.marks))]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at these places; only the chunks that hold them are decoded."""
        out, of = np.empty(len(at), np.int64), at // self.CHUNK
        order = np.argsort(of, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(at) else ():
            i = int(of[rows[0]])
            out[rows] = self.chunk(i)[at[rows] - i * self.CHUNK]
        return out

    def successors(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted keys, the place of the first value not below each, and the value (-1 beyond the last); chunks that no key falls into
        aren't decoded."""
        place, value = np.full(len(asked), self.n), np.full(len(asked), -1)
        of = np.maximum(np.searchsorted(self.firsts, asked, "right") - 1, 0)
        for rows in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(of)) + 1) if len(asked) and self.n else ():
            i = int(of[rows[0]])
            v = self.chunk(i)
            p = np.searchsorted(v, asked[rows])
            place[rows] = i * self.CHUNK + p
            inside = p < len(v)
            value[rows[inside]] = v[p[inside]]
            beyond = rows[~inside]  # the next chunk's first value
            if len(beyond) and i + 1 < len(self.firsts):
                value[beyond] = self.firsts[i + 1]
        return place, value


class Trie:
    """Contexts and their successors with quantised log-probabilities, in one memory-mapped file without a name."""

    def __init__(self, context: np.ndarray, word: np.ndarray, log10: np.ndarray):
        """Pairs sorted by context and word, no repeats."""
        self.file = tempfile.TemporaryFile()
        heads, first = np.unique(context, return_index=True)
        ends = np.append(first[1:], len(word))
        widths = word[ends - 1] + 1 if len(word) else np.zeros(0, np.int64)
        base = np.cumsum(widths) - widths
        self.contexts = EliasFano(heads, self._store)
        self.bases = EliasFano(base, self._store)
        self.pointers = EliasFano(np.append(first, len(word)), self._store)
        self.words = EliasFano(np.repeat(base, ends - first) + word, self._store)
        self.codes = self._store(np.clip(np.rint(-log10 / STEP), 0, ABSENT - 1).astype(np.uint8))

    def _store(self, a: np.ndarray) -> np.ndarray:
        if not len(a):
            return a
        at = self.file.seek(0, 2)
        self.file.write(a.tobytes())
        self.file.flush()
        return np.memmap(self.file, a.dtype, "r", at, len(a))

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of pairs in any order, ``ABSENT`` for those that aren't there, and their places among the trie's pairs (-1)."""
        out, at = np.full(len(word), ABSENT, np.uint8), np.full(len(word), -1)
        if not self.contexts.n or not len(word):
            return out, at
        asked, of = np.unique(context, return_inverse=True)
        h, value = self.contexts.successors(asked)
        known = np.flatnonzero(value == asked)
        place = np.full(len(asked), -1)
        place[known] = np.arange(len(known))
        h = h[known]
        first, end, base = self.pointers.get(h), self.pointers.get(h + 1), self.bases.get(h)
        last = self.words.get(end - 1) - base
        # Inside its context a word is looked for up to the largest successor; beyond, the next context's range begins.
        rows = np.flatnonzero(place[of] >= 0)
        mine = place[of[rows]]
        fits = word[rows] <= last[mine]
        rows, mine = rows[fits], mine[fits]
        key = base[mine] + word[rows]
        order = np.argsort(key, kind="stable")
        rows, mine, key = rows[order], mine[order], key[order]
        found, value = self.words.successors(key)
        hit = (value == key) & (found >= first[mine]) & (found < end[mine])
        out[rows[hit]], at[rows[hit]] = self.codes[found[hit]], found[hit]
        return out, at


BLOCK = (
    "block long, ids array<long>, sizes binary, train binary, codes binary, order binary, hashes binary, counts binary, n_words long, n_pairs long, kind string"
)


def tokenised(df: DataFrame, text: str, ident: str, train: str) -> DataFrame:
    """Two rows a block, by ``kind``: the ``text`` of its documents, with the numbers of words and pairs for sizing the shards, and its
    ``words``, hashes in order with training counts (starts count once a document), which are needed only until they are counted."""
    slim = df.select(F.col(ident).alias("id"), F.col(text).alias("text"), F.col(train).alias("train"))

    def run(batches):
        made = 0
        for batch in batches:
            for a, b in chunks(batch.column("text"), BLOCK_BYTES):
                part = batch.slice(a, b - a)
                code, offsets, distinct = words.tokenise(part.column("text"))
                hashed = np.concatenate([[END, START], words.hashes(distinct)])
                sizes = np.diff(offsets)
                seq = np.insert(code + 2, offsets[1:], 0)  # an end after every text
                # Numbers by falling frequency compress well.
                count = np.bincount(seq, minlength=len(hashed))
                rank = np.empty(len(hashed), np.int64)
                by = np.argsort(-count, kind="stable")
                rank[by] = np.arange(len(by))
                hashed = hashed[by]
                order = np.argsort(hashed)
                learn = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                times = np.bincount(seq[np.repeat(learn, sizes + 1)], minlength=len(hashed))
                times[1] = learn.sum()
                number = (TaskContext.get().partitionId() << 32) + made
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number, number], pa.int64()), pa.array([part.column("id").to_pylist(), None], pa.list_(pa.int64())),
                        *(pa.array([packed(a), None], pa.binary()) for a in (sizes, learn, rank[seq], order)),
                        *(pa.array([None, packed(a)], pa.binary()) for a in (hashed[order], times[by][order])),
                        pa.array([len(hashed), None], pa.int64()), pa.array([len(seq), None], pa.int64()), pa.array(["text", "words"]),
                    ],
                    names=["block", "ids", "sizes", "train", "codes", "order", "hashes", "counts", "n_words", "n_pairs", "kind"],
                )
                made += 1

    return slim.mapInArrow(words.tidy(run), BLOCK)


def one_by_one(batches):
    """A block is large: one at a time is turned into Python objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def small(a: np.ndarray) -> np.ndarray:
    """Whole numbers in 32 bits where they fit: a block holds several arrays with an entry per token."""
    return a.astype(np.int32) if not len(a) or int(a.max()) < 1 << 31 else a


class Block:
    """A block's sequence of word numbers, every text closed by an end, and what is known of its words."""

    def __init__(self, row: dict):
        self.sizes, = unpacked(row["sizes"])
        self.train = unpacked(row["train"])[0].astype(bool)
        seq, = unpacked(row["codes"])
        self.order, = unpacked(row["order"])
        self.seq = small(seq)
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes.astype(np.int64) + 1)
        self.learned = self.train[self.doc]

    def numbered(self, answers: list, shards: int) -> None:
        """Global word numbers and training counts, from the word shards' answers."""
        self.number, self.count = np.empty(len(self.order), np.int64), np.empty(len(self.order), np.int64)
        got = [(s["shard"], *unpacked(s["answer"])) for s in sorted(answers, key=lambda s: s["shard"])]
        self.number[self.order] = np.concatenate([np.cumsum(place, dtype=np.int64) * shards + shard for shard, place, _ in got])
        self.count[self.order] = np.concatenate([count.astype(np.int64) for _, _, count in got])

    def climb(self, prior: float, tokens: int, types: int) -> None:
        """Order one: each token's log-probability, and the number and count of the n-gram that ends there."""
        self.prior = prior
        self.begins = int(self.count[self.order[1]])  # the start's hash is the second smallest
        self.log10 = np.log10(unigram(self.count, tokens, types)).astype(np.float32)[self.seq]
        self.gram, self.numbers = self.seq, np.where(self.count > 0, self.number + BEGIN + 1, 0)
        self.times = small(self.count)[self.seq]

    def pairs(self, shards: int):
        """Distinct pairs of a learned context and a word, ordered by shard, context and the word's number; the first place of each shard."""
        size = len(self.order)
        by_number = np.argsort(self.number, kind="stable")
        place = np.empty(size, np.int32)
        place[by_number] = np.arange(size, dtype=np.int32)
        first = np.cumsum(self.sizes.astype(np.int64) + 1) - self.sizes.astype(np.int64) - 1
        heads, rank = np.unique(np.append(self.numbers, BEGIN if self.begins else 0), return_inverse=True)
        rank = small(rank)
        context, self.above = np.roll(rank[self.gram], 1), np.roll(self.times, 1)
        context[first], self.above[first] = rank[-1], self.begins
        self.rows = small(np.flatnonzero(heads[context]))  # tokens after a learned context
        h = context[self.rows].astype(np.int64)
        del context
        h *= size
        h += place[self.seq[self.rows]]
        key, at = np.unique(h, return_inverse=True)
        del h
        at = small(at)
        one = np.empty(len(key), np.int32)
        one[at] = np.arange(len(at), dtype=np.int32)  # a token of each pair: they share what is known of the pair
        h, w = heads[key // size], by_number[key % size]
        mixed = words.mix(words.mix(h.astype(np.uint64)) + self.number[w].astype(np.uint64))
        shard = words.part_of(mixed, shards)
        by = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        self.at = place[at]
        return h[by], w[by], self.rows[one[by]], np.searchsorted(shard[by], np.arange(shards + 1))

    def answered(self, answers: list, shards: int) -> None:
        """The next order's log-probabilities, numbers and counts from the shards' answers to ``pairs``; at the top order only the first."""
        got = []
        for s in sorted(answers or [], key=lambda s: s["shard"]):
            code, *more = unpacked(s["answer"])
            if more:  # of the learned pairs
                found, place, total = code != ABSENT, *more
                number, times = np.zeros(len(code), np.int64), np.zeros(len(code), total.dtype)
                number[found] = np.cumsum(place, dtype=np.int64) * shards + s["shard"] + BEGIN + 1
                times[found] = total
                more = number, times
            got.append((code, *more))
        self.gram, self.times, self.numbers = np.zeros(len(self.seq), np.int32), np.zeros(len(self.seq), np.int32), np.zeros(1, np.int64)
        if not got:
            return
        code, *more = (np.concatenate(x) for x in zip(*got))
        code = code[self.at]
        backed = np.log10(self.prior) + self.log10[self.rows] - np.log10(self.above[self.rows] + self.prior)
        self.log10[self.rows] = np.where(code == ABSENT, backed, -STEP * code.astype(np.float32))
        if more:
            number, times = more
            self.times = self.times.astype(np.int64) if times.dtype.itemsize > 4 else self.times
            self.numbers = np.append(0, number)  # place 0 is for tokens that end no pair
            self.gram[self.rows], self.times[self.rows] = self.at + 1, times[self.at]


def climbed(row: dict, level: int, word_shards: int, shards: int, prior: float, tokens: int, types: int) -> Block:
    """A block that knows all orders up to ``level``."""
    b = Block(row)
    b.numbered(row["known"], word_shards)
    b.climb(prior, tokens, types)
    for k in range(2, level + 1):
        b.pairs(shards)
        b.answered(row[f"found{k}"], shards)
    return b


def sent_words(shards: int, batches):
    for row in one_by_one(batches):
        (hashed,), (counts,) = unpacked(row["hashes"]), unpacked(row["counts"])
        cut = np.searchsorted(words.part_of(hashed, shards), np.arange(shards + 1))
        at = np.flatnonzero(np.diff(cut))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(at, pa.int32()), pa.array([row["block"]] * len(at), pa.int64()),
                pa.array([packed(hashed[cut[s] : cut[s + 1]], counts[cut[s] : cut[s + 1]]) for s in at], pa.binary()),
            ],
            names=["shard", "block", "data"],
        )


def counted_words(key, table):
    """Each block gets its words' places in the shard and their counts; ``place * shards + shard`` is a word's number."""
    shard = key[0].as_py()
    blocks = table.column("block").to_pylist()
    data = [unpacked(d) for d in table.column("data").to_pylist()]
    distinct, at = np.unique(np.concatenate([d[0].astype(np.uint64) for d in data]), return_inverse=True)
    total = np.bincount(at, np.concatenate([d[1] for d in data]).astype(float), len(distinct)).astype(np.int64)
    cuts = np.cumsum([0, *(len(d[0]) for d in data)])
    ordinary = distinct != START
    answers = [packed(gaps(at[a:b]), total[at[a:b]]) for a, b in zip(cuts, cuts[1:])]
    n = len(blocks)
    once = lambda v: pa.array([int(v)] + [0] * (n - 1), pa.int64())
    return pa.table({
        "shard": pa.array([shard] * n, pa.int32()), "block": pa.array(blocks, pa.int64()), "answer": pa.array(answers, pa.binary()),
        "types": once((total[ordinary] > 0).sum()), "tokens": once(total[ordinary].sum()),
    })


def unigram(count: np.ndarray, tokens: int, types: int) -> np.ndarray:
    return (count + 0.5) / (tokens + 0.5 * (types + 1))


def sent_pairs(level: int, first: int, last: int, word_shards: int, shards: int, prior: float, tokens: int, types: int, batches):
    """The pairs of shards ``first`` up to before ``last``."""
    for row in one_by_one(batches):
        b = climbed(row, level - 1, word_shards, shards, prior, tokens, types)
        h, w, one, cut = b.pairs(shards)
        seen = np.bincount(b.at[b.learned[b.rows]], minlength=len(h))
        lower = np.where(seen > 0, coded(b.log10[one]), 0)
        kept = np.flatnonzero(np.diff(cut))
        kept = kept[(kept >= first) & (kept < last)]
        out = []
        for s in kept:
            part = slice(cut[s], cut[s + 1])
            change = np.flatnonzero(np.diff(h[part], prepend=-1))
            runs = np.diff(np.append(change, cut[s + 1] - cut[s]))
            number = b.number[w[part]]
            step = gaps(number)
            step[change] = number[change]  # every context begins afresh
            out.append(packed(gaps(h[part][change]), runs, b.above[one[part]][change], step, seen[part], lower[part]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept, pa.int32()), pa.array([row["block"]] * len(kept), pa.int64()), pa.array(out, pa.binary())],
            names=["shard", "block", "data"],
        )


def coded(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / STEP), 0, ABSENT - 1).astype(np.int64)


def scored_pairs(last: bool, prior: float, key, table):
    """Each block gets its pairs' codes and, below the top order, the places and counts of the learned ones; ``place * shards + shard``,
    after the numbers taken, is a learned pair's number."""
    shard = key[0].as_py()
    blocks = table.column("block").to_pylist()
    data = [unpacked(d) for d in table.column("data").to_pylist()]
    cat = lambda i: np.concatenate([d[i] for d in data]).astype(np.int64)
    runs = cat(1)
    heads = np.concatenate([np.cumsum(d[0], dtype=np.int64) for d in data])
    context, above, word, seen = np.repeat(heads, runs), np.repeat(cat(2), runs), after_gaps(cat(3), runs), cat(4)
    lower = 10 ** (-STEP * cat(5))
    learned = np.flatnonzero(seen > 0)
    learned = learned[np.lexsort((word[learned], context[learned]))]
    fresh = np.append(True, (np.diff(context[learned]) != 0) | (np.diff(word[learned]) != 0))[: len(learned)]
    first = np.flatnonzero(fresh)
    total = np.add.reduceat(seen[learned], first) if len(first) else np.zeros(0, np.int64)
    one = learned[first]
    trie = Trie(context[one], word[one], np.log10((total + prior * lower[one]) / (above[one] + prior)))
    codes, place = trie.find(context, word)
    cuts = np.cumsum([0, *(len(d[3]) for d in data)])
    answers = []
    for a, b in zip(cuts, cuts[1:]):
        found = place[a:b][place[a:b] >= 0]
        answers.append(packed(codes[a:b]) if last else packed(codes[a:b], gaps(found), total[found]))
    return pa.table({
        "shard": pa.array([shard] * len(blocks), pa.int32()), "block": pa.array(blocks, pa.int64()), "answer": pa.array(answers, pa.binary()),
    })


SCORES = "id long, n_tokens long, n_known long, base_score double, score double"


def document_scores(order: int, word_shards: int, shards: int, prior: float, tokens: int, types: int, batches):
    for row in one_by_one(batches):
        b = climbed(row, order, word_shards, shards, prior, tokens, types)
        p = unigram(b.count, tokens, types)
        n = len(b.sizes)
        add = lambda v: np.bincount(b.doc, v, n)  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(row["ids"], pa.int64()), pa.array(b.sizes.astype(np.int64) + 1),
                pa.array(add(b.count[b.seq] > 0).astype(np.int64)), pa.array(add(np.log10(p)[b.seq])), pa.array(add(b.log10)),
            ],
            names=["id", "n_tokens", "n_known", "base_score", "score"],
        )


@contextmanager
def shuffles_dropped(spark):
    """Within, the shuffle files of a query go when it ends: each writes its result down, so nothing asks for them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def emptied(spark, path: str) -> None:
    """A table that nothing reads any more gives its disk back."""
    spark.range(0).write.mode("overwrite").parquet(path)


def by_block(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("block").agg(F.collect_list(F.struct("shard", "answer")).alias(name))


def score_texts(
    df: DataFrame, train, text: str = "text", ident: str = "doc_id", prior: float = PRIOR,
    words_per_shard: int = WORDS_PER_SHARD, pairs_per_shard: int = PAIRS_PER_SHARD, order: int = 2,
    portions: int = PORTIONS,
) -> DataFrame:
    """``(<ident>, train_tokens, n_tokens, n_known, base_score, score)`` for every row; the model learns from rows where ``train`` holds, n-grams of up to
    ``order`` words.

    A null text is empty: it has the end token only. A null id stays null; a null ``train`` counts as false; repeated rows count as often as
    they occur; other columns are ignored; an empty table gives no rows; without training rows every
    token has the unknown word's probability. Intermediate tables go to the session's shared folder.
    """
    spark = df.sparkSession
    root = work_path(spark, "lm")
    flagged = df.select(ident, text, F.coalesce(train, F.lit(False)).alias("_train"))
    with shuffles_dropped(spark):
        tokenised(flagged, text, ident, "_train").write.partitionBy("kind").parquet(f"{root}/blocks")
        made = spark.read.schema(BLOCK).parquet(f"{root}/blocks")
        blocks = made.where("kind = 'text'").drop("kind", "hashes", "counts")
        total = blocks.agg(F.sum("n_words"), F.sum("n_pairs")).first()
        word_shards = max(1, -(-(total[0] or 0) // words_per_shard))
        pair_shards = max(1, -(-(total[1] or 0) // pairs_per_shard))
        keyed = "shard int, block long, data binary"
        sent = made.where("kind = 'words'").select("block", "hashes", "counts").mapInArrow(words.tidy(partial(sent_words, word_shards)), keyed)
        counted = sent.groupBy("shard").applyInArrow(
            counted_words, "shard int, block long, answer binary, types long, tokens long"
        )
        counted.write.parquet(f"{root}/words")
        emptied(spark, f"{root}/blocks/kind=words")
        counted = spark.read.parquet(f"{root}/words")
        types, tokens = (int(x or 0) for x in counted.agg(F.sum("types"), F.sum("tokens")).first())
        known = blocks.select("block", "ids", "sizes", "train", "codes", "order").join(by_block(counted, "known"), "block")
        how = (word_shards, pair_shards, prior, tokens, types)
        for level in range(2, order + 1):
            # Portions of the shards one after the other: only one portion's pairs are on disk as shuffle files.
            bounds = [pair_shards * i // portions for i in range(portions + 1)]
            for first, last in zip(bounds, bounds[1:]):
                if first < last:
                    sent = known.drop("ids").mapInArrow(words.tidy(partial(sent_pairs, level, first, last, *how)), keyed)
                    found = sent.groupBy("shard").applyInArrow(partial(scored_pairs, level == order, prior), "shard int, block long, answer binary")
                    found.write.mode("append").parquet(f"{root}/pairs{level}")
            # A block without a learned context has no answers.
            known = known.join(by_block(spark.read.parquet(f"{root}/pairs{level}"), f"found{level}"), "block", "left")
        known.mapInArrow(words.tidy(partial(document_scores, order, *how)), SCORES).write.parquet(f"{root}/scores")
    for table in ("blocks", "words", *(f"pairs{level}" for level in range(2, order + 1))):
        emptied(spark, f"{root}/{table}")
    scores = spark.read.parquet(f"{root}/scores")
    return scores.select(F.col("id").alias(ident), F.lit(tokens).cast("long").alias("train_tokens"), "n_tokens", "n_known", "base_score", "score")


def op2_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = fold("doc_id", 5, 1)
    out = score_texts(docs, ~held & F.col("doc_id").isNotNull(), order=ORDER)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""BPE encoding and decoding with a pair occurrence index.

A task collects the distinct words of its texts and encodes the new ones together (normalising and splitting a word are
left to the ``tokenizers`` library, merging is done here). Their symbols lie in one flat linked
list; an index maps every mergeable adjacent pair to all its positions. Active ranks are taken in ascending order, all
positions of the pair are merged, left to right, and the lists of the pairs that vanish or appear are updated. Words are
independent of each other, so this gives what merging word by word gives. Where a merge makes a pair of a lower rank, the
rest of that word waits until the lower rank is done.

The vocabulary file is a parameter: a JSON file of the ``tokenizers`` library with an NFC, white-space and lower-case
normaliser, a regular-expression splitter, byte-level symbols and a word-end suffix.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from shiftwise.llm.words import tidy

CHUNK_CHARS = 2_000_000  # texts handled together
WORDS_KEPT = 1_000_000  # encoded words a worker remembers; beyond, it forgets all and goes on
WORDS_MERGED = 30_000  # distinct words in one pair index, which takes some hundred bytes a symbol


class Bpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splitter, level = spec["pre_tokenizer"]["pretokenizers"]
        known = (
            kinds == ["NFC", "Replace", "Lowercase"] and splitter["behavior"] == "Removed" and splitter["invert"]
            and level["type"] == "ByteLevel" and not level["add_prefix_space"] and spec["decoder"] is None
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        )
        if not known:
            raise ValueError(f"{path}: not a word BPE of the supported form")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.size = max(vocab.values()) + 1
        self.merges: list[tuple[int, int, int]] = []
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(model["merges"]):
            self.merges.append((vocab[a], vocab[b], vocab[a + b]))
            self.rank.setdefault(vocab[a] * self.size + vocab[b], r)
        self.vocab, self.end = vocab, end
        self.splits = regex.compile(splitter["pattern"]["Regex"])
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer, library.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, longest))) if longest else None
        named = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = pa.array([named.get(i) for i in range(max(named) + 1)], pa.large_string())
        self.kept = WORDS_KEPT
        self._forget()

    def _forget(self) -> None:
        """A word's ids are ``flat[start[k] : start[k] + count[k]]`` for its number k."""
        self.number: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self._store([" " + s for s in self.special], [[i] for i in self.special.values()])

    def _store(self, words: list[str], ids: list[list[int]]) -> None:
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = len(self.flat) + np.cumsum(counts) - counts
        for w in words:
            self.number[w] = len(self.number)
        joined = np.fromiter((i for x in ids for i in x), np.int32, int(counts.sum()))
        self.flat = np.concatenate([self.flat, joined])
        self.start, self.count = np.concatenate([self.start, starts]), np.concatenate([self.count, counts])

    @cached_property
    def ranked_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All mergeable pairs, sorted, and their ranks."""
        pairs = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(pairs)
        return pairs[order], np.fromiter(self.rank.values(), np.int64, len(pairs))[order]

    def _places(self, sym: np.ndarray, ends: np.ndarray) -> dict[int, list[int]]:
        """The index to begin with: the rank of every mergeable adjacent pair, and its positions in order."""
        pairs, ranks = self.ranked_pairs
        if len(sym) < 2 or not len(pairs):
            return {}
        inside = np.ones(len(sym), bool)
        inside[ends - 1] = False
        at = np.flatnonzero(inside)
        pair = sym[at] * self.size + sym[at + 1]
        found = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        hit = pairs[found] == pair
        at, rank = at[hit], ranks[found[hit]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order].tolist(), rank[order]
        starts = np.flatnonzero(np.diff(rank, prepend=-1))
        cuts = [*starts.tolist(), len(at)]
        return {r: at[x:y] for r, x, y in zip(rank[starts].tolist(), cuts, cuts[1:])}

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of many distinct words, given in byte-level symbols."""
        sym: list[int] = []
        ends: list[int] = []
        for w in words:
            sym.extend(map(self.vocab.__getitem__, w[:-1]))
            sym.append(self.vocab[w[-1] + self.end])
            ends.append(len(sym))
        n = len(sym)
        following, before, word = list(range(1, n + 1)), list(range(-1, n - 1)), [0] * n
        at = 0
        for k, e in enumerate(ends):
            before[at], following[e - 1] = -1, -1
            word[at:e] = [k] * (e - at)
            at = e
        rank_of, size = self.rank.get, self.size
        places = self._places(np.array(sym, np.int64), np.array(ends, np.int64))
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b, made = self.merges[rank]
            waiting: set[int] = set()
            later: list[int] = []
            for p in sorted(places.pop(rank)):
                q = following[p]
                if sym[p] != a or q < 0 or sym[q] != b:
                    continue  # one of the two was merged meanwhile
                if word[p] in waiting:
                    later.append(p)
                    continue
                sym[p], sym[q] = made, -1
                right = following[p] = following[q]
                left = before[p]
                for x, pair in ((left, left >= 0 and sym[left] * size + made), (p, right >= 0 and made * size + sym[right])):
                    if pair is False or (r := rank_of(pair)) is None:
                        continue
                    if r not in places:
                        places[r] = []
                        heapq.heappush(active, r)
                    places[r].append(x)
                    if r < rank:
                        waiting.add(word[p])
                if right >= 0:
                    before[right] = p
            if later:
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(active, rank)
                places[rank].extend(later)
        out, at = [], 0
        for e in ends:
            out.append([s for s in sym[at:e] if s >= 0])
            at = e
        return out

    def _symbols(self, word: str) -> list[str]:
        """What the normaliser and the splitter make of a stretch without white space, in byte-level symbols."""
        if word.isascii() and word.isprintable():
            return self.splits.findall(word.lower())
        return [s for s, _ in self.split.pre_tokenize_str(self.normal.normalize_str(word))]

    def _learn(self, words: list[str]) -> None:
        """Encode new stretches: their distinct words go through the pair index together, ``WORDS_MERGED`` at a time."""
        found: list[list[int]] = []
        for at in range(0, len(words), WORDS_MERGED):
            parts = [self._symbols(w) for w in words[at : at + WORDS_MERGED]]
            distinct = sorted(set(chain.from_iterable(parts)))
            ids = dict(zip(distinct, self.merge(distinct)))
            found.extend(list(chain.from_iterable(map(ids.__getitem__, p))) for p in parts)
        self._store(words, found)

    def words(self, text: str) -> Iterator[list[str]]:
        """The stretches between white space, in lists of bounded length; special tokens carry a space in front."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield from map(stretches, pieces(text[at : m.start()]))
            yield [" " + m[0]]
            at = m.end()
        yield from map(stretches, pieces(text[at:] if at else text))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)``: the ids of all texts one after the other, and their number per text."""
        owner, parts = [], []
        for k, text in enumerate(texts):
            for words in self.words(text):
                owner.append(k)
                parts.append(words)
        if len(self.number) > self.kept:
            self._forget()
        if new := set().union(*parts).difference(self.number):
            self._learn(sorted(new))
        numbers = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64)
        lens = self.count[numbers]
        upto = np.cumsum(lens)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.flat[np.repeat(self.start[numbers] - (upto - lens), lens) + np.arange(total)]
        ends = np.concatenate([[0], upto])[np.cumsum([len(p) for p in parts])] if parts else np.zeros(0, np.int64)
        per_part = np.diff(ends, prepend=0)
        return ids, np.bincount(np.array(owner, np.int64), per_part, len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of many lists of ids: list ``k`` is ``ids[ends[k] : ends[k + 1]]``; a space between two tokens."""
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), self.tokens.take(pa.array(ids, pa.int64())))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def pieces(text: str, most: int = 1_000_000) -> Iterator[str]:
    """Cuts before white space, which no word and no composed character reaches over."""
    at = 0
    while len(text) - at > most:
        m = WHITE.search(text, at + most)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


WHITE = regex.compile(r"[ \t\n\r]")
SPACE = regex.compile(r"\p{White_Space}+")
SEPARATORS = "\x1c", "\x1d", "\x1e", "\x1f"  # white space to Python's split, not to the vocabulary's splitter


def stretches(text: str) -> list[str]:
    if any(s in text for s in SEPARATORS):
        return [w for w in SPACE.split(text) if w]
    return text.split()


@lru_cache(1)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def chunks(values: pa.Array, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts add up to about ``most`` bytes; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    at = held = 0
    for k, s in enumerate(sizes):
        if k > at and held + s > most:
            yield at, k
            at, held = k, 0
        held += int(s)
    if at < len(sizes):
        yield at, len(sizes)


def encode_texts(
    df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, words_kept: int = WORDS_KEPT,
    keep: list[str] | None = None,
) -> DataFrame:
    """``keep`` (default: all columns) plus ``ids`` (``array<int>``) and, if named, the text decoded from the ids.

    The vocabulary file must be readable under the same path on every executor. A null text counts as empty and has no
    ids; strings of special tokens in a text are special tokens; a text of any length is encoded whole; an
    empty table gives no rows; repeated rows are encoded alike. ``words_kept`` trades a worker's memory (some 250 bytes a word)
    for time and changes no result. ``ids`` and ``decoded`` must not be columns of ``df``.
    """
    kept = df.columns if keep is None else keep
    slim = df.select(*kept, *([] if text in kept else [text]))
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        added.append(T.StructField(decoded, T.StringType(), False))
    if clash := {f.name for f in added} & set(slim.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")

    def encode(batches):
        bpe = loaded(path)
        bpe.kept = words_kept
        for batch in batches:
            values = batch.column(text)
            for a, b in chunks(values):
                found, counts = bpe.encode([t or "" for t in values.slice(a, b - a).to_pylist()])
                ends = np.concatenate([[0], np.cumsum(counts)])
                cols = [batch.column(c).slice(a, b - a) for c in range(len(kept))]
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32())))
                names = [*kept, ids]
                if decoded:
                    cols.append(bpe.decode(found, ends))
                    names.append(decoded)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return slim.mapInArrow(tidy(encode), T.StructType([*slim.schema.fields[: len(kept)], *added]))


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"), decoded="decoded", keep=["doc_id"])
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

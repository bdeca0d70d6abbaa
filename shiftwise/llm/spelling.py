"""Spelling variants among the words of a corpus: Bloom-guided neighbourhoods.

Every word generates its edits: each letter left out, each letter replaced by a later one of the alphabet (the earlier ones are found
from the other word, and so are insertions). Nobody writes the edited words down: a polynomial hash of an edit follows from the
word's prefix sums, and the hash is probed against Bloom filters of the vocabulary, one or more for each word length, blocked so that
a probe touches 64 bytes. Only positives are shuffled, as ``(hash of the edit, hash of the word, place, letter)``; they meet the
vocabulary by an exact join, and the two words are compared, so false positives and equal hashes go.

The filters are broadcast ``ROUND_BYTES`` at a time at most; a larger vocabulary takes more rounds over its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftwise.llm.decontaminate import lowered
from shiftwise.llm.words import mix, part_of, tidy
from shiftwise.session import work_path

#: letters of a word after lower-casing A-Z
LETTERS = np.array([*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)], np.uint32)
GAP = r"[^a-zÀ-ÿ]+"

FACTOR = 0x9E3779B97F4A7C15
UNDO = pow(FACTOR, -1, 1 << 64)
BITS_A_WORD = 16
PROBES = 6
SHARD_WORDS = 2 << 20  # 4 MB of filter
ROUND_BYTES = 32 << 20
LONG = 64  # words of this length and above share filters
EDITS_A_STEP = 1 << 21
CHUNK = 1 << 13  # 64-bit words of a filter in a row


def typed_words(docs: DataFrame, ident: str = "doc_id", text: str = "text", every: int = 199, least: int = 6) -> DataFrame:
    """``(word)`` per run of letters: A-Z lowered, and where ``every`` divides crc32(``<id>:<run>``) without the letter at crc32 modulo
    length. Shorter results than ``least`` letters are left out. A null text has no runs; a null id counts as the empty text."""
    # An outer explode, since Spark infers a filter from the inner one and would cut the text twice.
    runs = docs.select(F.coalesce(F.col(ident).cast("string"), F.lit("")).alias("id"), F.explode_outer(F.split(lowered(F.col(text)), GAP)).alias("run"))
    long = runs.where(F.char_length("run") >= least).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return long.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least)


def _codes(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(places, letters)`` for each length: the words of that length as a matrix of code points."""
    texts = words.to_pylist()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        joined = "".join(texts[i] for i in at)
        yield at, np.frombuffer(joined.encode("utf-32-le"), "<u4").reshape(len(at), n)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, FACTOR, np.uint64))]).astype(np.uint64)[:n]


def _sums(letters: np.ndarray) -> np.ndarray:
    """Prefix sums of letter * FACTOR^place modulo 2^64, from 0 on."""
    out = np.zeros((letters.shape[0], letters.shape[1] + 1), np.uint64)
    np.cumsum(letters.astype(np.uint64) * _powers(letters.shape[1]), axis=1, out=out[:, 1:])
    return out


def _hashed(vocabulary: DataFrame) -> DataFrame:
    """``(word, n, shard, h)``."""

    def run(batches):
        for b in batches:
            h, shard = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int32)
            for at, letters in _codes(b.column(0)):
                h[at] = mix(_sums(letters)[:, -1])
                shard[at] = min(letters.shape[1], LONG)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shard), pa.array(h.view(np.int64))], names=["word", "n", "shard", "h"])

    return vocabulary.select("word", "n").mapInArrow(tidy(run), "word string, n long, shard int, h long")


def _bits(h: np.ndarray, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The 64-bit word and the bit in it of each probe of a hash."""
    block, inside = part_of(h, blocks), mix(h ^ np.uint64(FACTOR))
    for k in range(PROBES):
        bit = (inside >> np.uint64(9 * k)) & np.uint64(511)
        yield block * 8 + (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)


class Shards:
    """The filters: for each shard (word length) its slices, and how large each is. Figures only, at most ``LONG`` entries."""

    def __init__(self, counts: dict[int, int], shard_words: int = SHARD_WORDS):
        self.slices = {s: -(-n // shard_words) for s, n in counts.items()}
        self.blocks = {s: max(1, -(-(n // self.slices[s] + 1) * BITS_A_WORD // 512)) for s, n in counts.items()}

    def rounds(self, most: int) -> list[list[tuple[int, int]]]:
        """Filters in groups of at most ``most`` bytes (a single larger one doesn't occur at the defaults)."""
        out, used = [[]], 0
        for s in sorted(self.slices):
            for i in range(self.slices[s]):
                size = self.blocks[s] * 64
                if out[-1] and used + size > most:
                    out.append([])
                    used = 0
                out[-1].append((s, i))
                used += size
        return out

    def slice_of(self, shard: int, h: np.ndarray) -> np.ndarray:
        return part_of(mix(h + np.uint64(1)), self.slices[shard])


def _filters(hashed: DataFrame, shards: Shards, wanted: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The wanted filters, built where the words are; their bytes reach the driver in pieces, ``ROUND_BYTES`` at most."""

    def mark(batches):
        for b in batches:
            shard, h = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for s in np.unique(shard):
                mine = h[shard == s]
                part = shards.slice_of(int(s), mine)
                for i in np.unique(part):
                    if (int(s), int(i)) in keep:
                        for at, bit in _bits(mine[part == i], shards.blocks[int(s)]):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(at), s, np.int32)), pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array((np.uint64(1) << bit).view(np.int64))],
                                names=["shard", "slice", "at", "bits"],
                            )

    def join(key, table):
        piece = np.zeros(CHUNK, np.uint64)
        piece[table.column("at").to_numpy() % CHUNK] = table.column("bits").to_numpy().view(np.uint64)
        return pa.table({"shard": [key[0].as_py()], "slice": [key[1].as_py()], "piece": [key[2].as_py()], "words": [piece.tobytes()]},
                        schema=pa.schema([("shard", pa.int32()), ("slice", pa.int32()), ("piece", pa.int64()), ("words", pa.binary())]))

    keep = set(wanted)
    marked = hashed.where(F.col("shard").isin(sorted({s for s, _ in wanted}))).select("shard", "h").mapInArrow(mark, "shard int, slice int, at long, bits long")
    words = marked.groupBy("shard", "slice", "at").agg(F.bit_or("bits").alias("bits")).withColumn("piece", F.floor(F.col("at") / CHUNK))
    pieces = words.groupBy("shard", "slice", "piece").applyInArrow(join, "shard int, slice int, piece long, words binary")
    out = {(s, i): np.zeros(-(-shards.blocks[s] * 8 // CHUNK) * CHUNK, np.uint64) for s, i in wanted}
    for r in pieces.toLocalIterator():
        out[r.shard, r.slice][r.piece * CHUNK : (r.piece + 1) * CHUNK] = np.frombuffer(r.words, np.uint64)
    return out


def _edits(letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(length, row, place, letter, hash)`` of edits in bounded portions; letter 0: left out.

    Of equal letters in a row only the first is left out, and letters are replaced by later ones only.
    """
    rows, n = letters.shape
    sums, powers = _sums(letters), _powers(n)
    wide = max(1, EDITS_A_STEP // max(1, rows * len(LETTERS)))
    for lo in range(0, n, wide):
        here = letters[:, lo : lo + wide]
        before = letters[:, lo - 1 : lo + wide - 1] if lo else np.pad(letters[:, : wide - 1], ((0, 0), (1, 0)))[:, : here.shape[1]]
        row, place = np.nonzero(here != before)
        place += lo
        yield n - 1, row, place, np.zeros(len(row), np.uint32), sums[row, place] + (sums[row, -1] - sums[row, place + 1]) * np.uint64(UNDO)
        row, place, letter = np.nonzero(here[:, :, None] < LETTERS)
        new = LETTERS[letter]
        change = (new.astype(np.uint64) - letters[row, place + lo].astype(np.uint64)) * powers[place + lo]
        yield n, row, place + lo, new, sums[row, -1] + change


def _positives(hashed: DataFrame, shards: Shards, filters) -> DataFrame:
    """``(edit, h, place, letter)`` of the edits that the broadcast filters let pass."""

    def run(batches):
        held = filters.value
        for b in batches:
            own = b.column(1).to_numpy()
            for at, letters in _codes(b.column(0)):
                step = max(1, EDITS_A_STEP // (len(LETTERS) * min(letters.shape[1], 32)))
                for lo in range(0, len(at), step):
                    for n, row, place, letter, h in _edits(letters[lo : lo + step]):
                        s = min(n, LONG)
                        if s not in shards.slices:
                            continue
                        h = mix(h)
                        part = shards.slice_of(s, h)
                        for i in range(shards.slices[s]):
                            if (s, i) not in held:
                                continue
                            left = np.flatnonzero(part == i) if shards.slices[s] > 1 else np.arange(len(h))
                            for k in range(PROBES):  # most edits fall at the first probes
                                for j, (word, bit) in enumerate(_bits(h[left], shards.blocks[s])):
                                    if j == k:
                                        left = left[(held[s, i][word] >> bit) & np.uint64(1) == 1]
                                        break
                            if len(left):
                                named = [chr(c) if c else "" for c in letter[left]]
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(h[left].view(np.int64)), pa.array(own[at[lo + row[left]]]), pa.array(place[left].astype(np.int32)), pa.array(named, pa.string())],
                                    names=["edit", "h", "place", "letter"],
                                )

    return hashed.select("word", "h").mapInArrow(tidy(run), "edit long, h long, place int, letter string")


def near_words(vocabulary: DataFrame, shard_words: int = SHARD_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``(a, n_a, b, n_b)``: the pairs of words of ``vocabulary (word, n)``, each once, that differ by one letter inserted, deleted or
    replaced. Words are distinct, not null and made of ``LETTERS``. Written to the shared folder."""
    spark = vocabulary.sparkSession
    path = work_path(spark, "spelling-words")
    _hashed(vocabulary).write.parquet(path)
    hashed = spark.read.parquet(path)
    shards = Shards({r.shard: r.n for r in hashed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}, shard_words)
    found = []
    for wanted in shards.rounds(round_bytes):
        filters = spark.sparkContext.broadcast(_filters(hashed, shards, wanted))
        path = work_path(spark, "spelling-positives")
        _positives(hashed, shards, filters).write.parquet(path)
        filters.unpersist()
        found.append(spark.read.parquet(path))
    positives = reduce(DataFrame.unionByName, found)
    other = hashed.select(F.col("h").alias("edit"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    own = hashed.select("h", F.col("word").alias("a"), F.col("n").alias("n_a"))
    edited = F.concat(F.substring("a", F.lit(1), F.col("place")), "letter", F.substring("a", F.col("place") + 2, F.char_length("a")))
    pairs = positives.join(other, "edit").join(own, "h").where(edited == F.col("b")).select("a", "n_a", "b", "n_b").distinct()
    path = work_path(spark, "spelling-pairs")
    pairs.write.parquet(path)
    return spark.read.parquet(path)


def spelling_forms(vocabulary: DataFrame, times: int = 5, **sizes: int) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for every row of ``vocabulary (word, n)``.

    ``form`` is the near word of largest ``n`` (ties: the smallest word) if that is ``times`` the word's own ``n`` at least, else null;
    ``root`` follows forms to the last. Counts grow from form to form, so chains are short: they are followed by doubling steps, as
    many as the largest count allows. An empty vocabulary gives no rows.
    """
    spark = vocabulary.sparkSession
    path = work_path(spark, "spelling-vocabulary")
    vocabulary.select("word", F.col("n").cast("long").alias("n")).write.parquet(path)
    vocabulary = spark.read.parquet(path)
    largest = vocabulary.agg(F.max("n")).first()[0] or 0
    pairs = near_words(vocabulary, **sizes)
    one, two = F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n"))
    both = pairs.select(F.inline(F.array(one, two)))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    large = -F.col("best.less") >= times * F.col("n")
    joined = vocabulary.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n")
    )
    path = work_path(spark, "spelling-forms")
    joined.write.parquet(path)
    forms = spark.read.parquet(path)
    jumps = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    longest = max(1, int(math.log(max(largest, 1), times)) + 1)
    for _ in range(max(0, longest - 1).bit_length()):
        later = jumps.select(F.col("word").alias("root"), F.col("root").alias("later"))
        path = work_path(spark, "spelling-roots")
        jumps.join(later, "root", "left").select("word", F.coalesce("later", "root").alias("root")).write.parquet(path)
        jumps = spark.read.parquet(path)
    return forms.join(jumps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = typed_words(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    return spelling_forms(counted).select("word", "form", "root", "n", "n_near", "form_n")


#: list of the 256 steps of crc32, made from its polynomial
CRC_SQL = """
crc AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
  FROM range(256) r(i)))"""

OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL},
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents),
counted AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(id || ':' || run, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS b FROM counted),
hashed AS (SELECT id, run, k, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) AS h
  FROM bytes, crc),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k
  FROM hashed),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
gone AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (
  SELECT DISTINCT g.word, w.word AS other, w.n FROM gone g JOIN v w ON g.rest = w.word
  UNION SELECT DISTINCT w.word, g.word, g.n FROM gone g JOIN v w ON g.rest = w.word
  UNION SELECT DISTINCT g.word, w.word, w.n FROM gone g JOIN gone w ON g.rest = w.rest AND g.i = w.i AND g.word <> w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS most FROM near GROUP BY word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * v.n THEN other END AS form, CASE WHEN most >= 5 * v.n THEN most END AS form_n
  FROM v LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""

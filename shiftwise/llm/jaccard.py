"""Jaccard join of documents on word shingles by parity sketches.

Every shingle of a document is XOR-hashed into one piece of a sketch. Two sets that differ in d shingles differ in at most d
pieces: the number of unequal pieces is a lower bound of the symmetric difference. A pair with Jaccard similarity t or more
differs in at most D = (1-t)/(1+t) * (|A|+|B|) shingles, so with D+1 pieces one piece at least is equal. D depends on the sizes:
documents are compared per size band, and each goes to every band that a larger partner could be in.

Equal pieces are found by one shuffle of (piece key, document). Empty pieces make no keys: with up to ``SMALL`` pieces a
document that has one adds another, independent sketch, up to ``LEVELS`` (there the empty ones count). With more pieces
there are so many equal ones that pieces of one shingle, which unrelated documents share, are left out as well; the chance
that a pair has no other equal piece is below 1e-11, and far less away from the threshold.

Candidates are never all pairs of a group:

1. Documents with equal sets become one; only one of them goes on.
2. Every document is paired with the first member of one of its groups, the one it shares most groups with. Pairs that pass the size
   bound and the bound of a 512-bit parity sketch are verified on the whole sets. The links give first components.
3. In each group only pairs from different components are left to try, and of these only those that pass the two bounds leave the
   task. A group of more than ``GROUP`` members is split first: its members get the keys of the next, independent sketch inside
   the group, in which any true pair meets again. The last level compares whatever is left.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwise.llm import words
from shiftwise.llm.bpe import chunks
from shiftwise.llm.components import components
from shiftwise.session import work_path

CHUNK_BYTES = 2 << 20
SMALL, LEVELS = 32, 6
GROUP = 4096  # members of a group that a task compares by their sketches; larger groups are split first
BUFFER = 100_000  # rows read at a time
SPLITS = 4  # times a group can be split
BITS = 512
U = np.uint64


class Bands:
    """Size bands and their number of pieces, for a similarity of ``percent`` / 100 or more."""

    def __init__(self, percent: int):
        self.percent, self.first = percent, [1]

    def _grow(self, size: int) -> None:
        while self.first[-1] <= size:
            self.first.append(max(self.first[-1] + 1, self.first[-1] * 7 // 5))

    def band(self, size: int) -> int:
        self._grow(size)
        return int(np.searchsorted(self.first, size, "right")) - 1

    def bands(self, size: int) -> range:
        """Bands of the document itself and of its larger partners."""
        return range(self.band(size), self.band(size * 100 // self.percent) + 1)

    def pieces(self, band: int) -> int:
        while len(self.first) < band + 2:
            self._grow(self.first[-1])
        largest = self.first[band + 1] - 1
        return 2 * largest * (100 - self.percent) // (100 + self.percent) + 1


def shingle_sets(texts: pa.Array, width: int):
    """Sorted distinct 64-bit shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    code, offsets, distinct = words.tokenise(texts)
    h = words.mix(words.hashes(distinct))[code]
    n = len(h)
    whole = np.zeros(max(0, n - width + 1), U)
    for i in range(width):
        whole = words.mix(whole * U(0x9E3779B97F4A7C15) + h[i : n - width + 1 + i] + U(1))
    for a, b in zip(offsets, offsets[1:]):
        if b - a >= width:
            yield np.unique(whole[a : b - width + 1])
        elif b > a:
            s = np.array([b - a], U)
            for i in range(a, b):
                s = words.mix(s * U(0x9E3779B97F4A7C15) + h[i : i + 1] + U(1))
            yield s
        else:
            yield np.zeros(0, U)


def piece_keys(shingles: np.ndarray, band: int, pieces: int, level: int, empties: bool) -> tuple[np.ndarray, bool]:
    """Keys of the pieces that count (of all pieces with ``empties``), and whether one doesn't."""
    x = np.sort(words.mix(shingles ^ words.mix(np.array([level * 1_000_003 + 7], U))))
    at = words.part_of(x, pieces)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    name = at[first]
    content = np.bitwise_xor.reduceat(words.mix(x + U(0x51ED)), first)
    if pieces > SMALL:
        full = np.diff(np.append(first, len(x))) > 1
        name, content = name[full], content[full]
    if empties and len(name) < pieces:
        full = np.zeros(pieces, U)
        full[name] = content
        name, content = np.arange(pieces), full
    salt = words.mix(U(band) * U(0x1000003) + U(level) * U(0x10001) + (name.astype(U) << U(24)))
    return words.mix(content ^ salt), len(name) < pieces


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bits: the Hamming distance of two sketches is at most the symmetric difference of the sets."""
    bits = np.bincount((shingles & U(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


ROW = "key long, kind byte, id long, n long, rep long, band int, sketch array<long>"
META, MEMBER, COPY = 0, 1, 2


def emitted(width: int, percent: int, batches):
    """Rows for the grouping shuffle: one META or COPY row per document, MEMBER rows of every first of equal sets."""
    bands = Bands(percent)
    names = ["key", "kind", "id", "n", "rep", "band", "sketch"]

    def batch_of(key, kind, ids, n, rep, band, sketches):
        size = len(key)
        same = lambda v, t: pa.array([v] * size, t) if not isinstance(v, (list, np.ndarray)) else pa.array(v, t)
        cols = [pa.array(np.asarray(key, U).view(np.int64)), same(kind, pa.int8()), same(ids, pa.int64()), same(n, pa.int64())]
        cols += [same(rep, pa.int64()), same(band, pa.int32()), same(sketches, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    for batch in batches:
        for a, b in chunks(batch.column("text"), CHUNK_BYTES):
            ids = batch.column("id").slice(a, b - a).to_pylist()
            sets, sizes, firsts = [], [], {}
            for i, s in zip(ids, shingle_sets(batch.column("text").slice(a, b - a), width)):
                total = int(np.bitwise_xor.reduce(words.mix(s))) if len(s) else 0
                name = (total, len(s)) if len(s) and i is not None else None
                sizes.append((i, len(s), name))
                if name is not None and (name not in firsts or i < firsts[name][0]):
                    firsts[name] = (i, s)
                sets.append(None)
            copies = [(i, n, i if name is None else firsts[name][0]) for i, n, name in sizes if name is None or firsts[name][0] != i]
            # Rows that repeat an id with the same set are copies of it, too.
            told: set = set()
            for i, n, name in sizes:
                if name is not None and firsts[name][0] == i:
                    if name in told:
                        copies.append((i, n, i))
                    told.add(name)
            if copies:
                ci, cn, cr = map(list, zip(*copies))
                yield batch_of(words.mix(np.array([x or 0 for x in ci], np.int64).view(U)), COPY, ci, cn, cr, None, None)
            if not firsts:
                continue
            tops = list(firsts.items())
            total = words.mix(np.array([t for (t, _), _ in tops], U) + np.array([n for (_, n), _ in tops], U))
            yield batch_of(
                total, META, [i for _, (i, _) in tops], [n for (_, n), _ in tops], None, None, [sketch(s) for _, (_, s) in tops]
            )
            keys, owner, of_band, held = [], [], [], 0
            for (_, n), (i, s) in tops:
                for band in bands.bands(n):
                    pieces = bands.pieces(band)
                    for level in range(LEVELS if pieces <= SMALL else 1):
                        k, hollow = piece_keys(s, band, pieces, level, pieces <= SMALL and level == LEVELS - 1)
                        keys.append(k), owner.append(np.full(len(k), i)), of_band.append(np.full(len(k), band))
                        held += len(k)
                        if not hollow:
                            break
                if held > 100_000:
                    yield batch_of(np.concatenate(keys), MEMBER, np.concatenate(owner), None, None, np.concatenate(of_band), None)
                    keys, owner, of_band, held = [], [], [], 0
            if keys:
                yield batch_of(np.concatenate(keys), MEMBER, np.concatenate(owner), None, None, np.concatenate(of_band), None)


def grouped(batches):
    """From rows sorted by key, kind and id: META and COPY rows, META with the smallest id of its key; MEMBER rows that share their key.

    Only the last row of a batch is held back.
    """
    first = (None, None)
    last, shared = None, False
    for batch in batches:
        key, kind = batch.column("key").to_numpy(), batch.column("kind").to_numpy()
        ids = batch.column("id")
        meta = np.flatnonzero(kind == META)
        if len(meta):
            k, own = key[meta], ids.take(pa.array(meta)).to_numpy()
            start = np.append(True, k[1:] != k[:-1])
            reps = own[np.flatnonzero(start)]
            if k[0] == first[0]:
                reps[0] = first[1]
            rep = reps[np.cumsum(start) - 1]
            first = (k[-1], rep[-1])
            out = batch.take(pa.array(meta))
            yield out.set_column(4, "rep", pa.array(rep, pa.int64()))
        copies = np.flatnonzero(kind == COPY)
        if len(copies):
            yield batch.take(pa.array(copies))
        rows = batch.take(pa.array(np.flatnonzero(kind == MEMBER)))
        if not rows.num_rows:
            continue
        if last is not None:
            rows = pa.Table.from_batches([last, rows]).combine_chunks().to_batches()[0]
        k = rows.column("key").to_numpy()
        like_next = np.append(k[1:] == k[:-1], False)
        like_before = np.append(shared, like_next[:-1])
        kept = (like_next | like_before)[:-1]
        yield rows.take(pa.array(np.flatnonzero(kept)))
        last, shared = rows.slice(len(k) - 1), bool(like_before[-1])
    if last is not None and shared:
        yield last


def runs(batches, differ: str):
    """``(key, rows as a dict of arrays)`` of tables sorted by key and ``differ``, in stretches of at most ``BUFFER`` rows; and whether the
    run is over. Runs with one value of ``differ`` are left out unless they are longer."""
    held, open_key = None, None
    for batch in batches:
        table = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
        if not table.num_rows:
            continue
        key = table.column("key").to_numpy()
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        cols = {c: table.column(c).to_numpy() for c in table.column_names}
        ends = np.append(cuts[1:], len(key))[:-1]
        value = cols[differ]
        several = np.flatnonzero((value[cuts[:-1]] != value[ends - 1]) | (key[cuts[:-1]] == open_key))
        for x, y in zip(cuts[several], ends[several]):
            yield key[x], {c: v[x:y] for c, v in cols.items()}, True
        x = cuts[-1]
        while len(key) - x > BUFFER:
            yield key[x], {c: v[x : x + BUFFER] for c, v in cols.items()}, False
            x, open_key = x + BUFFER, key[x]
        held = table.slice(x).to_batches()
        held = held[0] if held else None
    if held is not None and held.num_rows:
        yield held.column("key")[0].as_py(), {c: held.column(c).to_numpy() for c in held.schema.names}, True


def stars(batches):
    """Each member with the first member of its group; rows sorted by key and id."""
    at, centre = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
        start = np.append(key[0] != at, key[1:] != key[:-1])
        firsts = np.append(centre if centre is not None else ids[0], ids[start])
        own = firsts[np.cumsum(start)]
        at, centre = key[-1], own[-1]
        other = own != ids
        yield pa.RecordBatch.from_arrays([pa.array(own[other]), pa.array(ids[other])], names=["a", "b"])


TRY = "a long, b long, key long, band int"


def close_pairs(n: np.ndarray, bits: np.ndarray, component: np.ndarray, percent: int):
    """Positions ``(i, j)``, i < j, of rows from different components that pass the size bound and the sketch bound."""
    step = max(1, 1_000_000 // len(n))
    for at in range(0, len(n) - 1, step):
        i = slice(at, at + step)
        sizes = n[i, None] + n[None]
        fits = (component[i, None] != component[None]) & (np.minimum(n[i, None], n[None]) * 100 >= np.maximum(n[i, None], n[None]) * percent)
        fits &= np.arange(len(n))[i, None] < np.arange(len(n))
        x, y = np.nonzero(fits)
        unequal = np.bitwise_count(bits[x + at] ^ bits[y]).sum(axis=1)
        good = unequal.astype(np.int64) * (100 + percent) <= sizes[x, y] * (100 - percent)
        yield x[good] + at, y[good]


def crossing(percent: int, last: bool, batches):
    """Close pairs ``(a, b)`` from different components of a group, or the members ``(a, null, key, band)`` of a group of more than
    ``GROUP`` rows. Rows are sorted by key, component and id. The last level has no such limit."""
    parts: list = []
    wide = None  # key of a group whose members are passed on

    def out(a, b, key, band):
        none = [None] * len(a)
        cols = [pa.array(a, pa.int64()), pa.array(none if b is None else b, pa.int64())]
        cols += [pa.array(none if b is not None else np.full(len(a), key), pa.int64()), pa.array(none if b is not None else band, pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "key", "band"])

    for key, rows, over in runs(batches, "component"):
        if wide == key:
            yield out(rows["id"], None, key, rows["band"])
        else:
            parts.append(rows)
            if sum(len(p["id"]) for p in parts) > GROUP and not last:
                for p in parts:
                    yield out(p["id"], None, key, p["band"])
                parts, wide = [], key
            elif over:
                all_of = {c: np.concatenate([p[c] for p in parts]) for c in rows} if len(parts) > 1 else rows
                bits = np.stack([all_of[f"s{i}"] for i in range(BITS // 64)], axis=1).view(U)
                for x, y in close_pairs(all_of["n"], bits, all_of["component"], percent):
                    if len(x):
                        yield out(all_of["id"][x], all_of["id"][y], None, None)
        if over:
            parts, wide = [], None


def split(percent: int, level: int, batches):
    """Members of a wide group under the keys of the next sketch: ``(key, id, band, component)``."""
    bands = Bands(percent)
    for batch in batches:
        for key, i, band, component, s in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "band", "component", "shingles"))):
            keys, _ = piece_keys(np.array(s, np.int64).view(U), band, bands.pieces(band), level, True)
            inside = words.mix(keys + words.mix(np.array([key], np.int64).view(U)))
            n = len(inside)
            yield pa.RecordBatch.from_arrays(
                [pa.array(inside.view(np.int64)), pa.array(np.full(n, i)), pa.array(np.full(n, band), pa.int32()), pa.array(np.full(n, component))],
                names=["key", "id", "band", "component"],
            )


def with_shingles(width: int, batches):
    for batch in batches:
        for a, b in chunks(batch.column("text"), CHUNK_BYTES):
            sets = [s.view(np.int64) for s in shingle_sets(batch.column("text").slice(a, b - a), width)]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])


def _sorted(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition("key").sortWithinPartitions("key", *by)


FILTER_WORDS = 1 << 17


def marked(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds ``_maybe``: false only where the id is not in ``ids``; so the exact join that follows shuffles few other rows.

    A bit per hash of the id, in at most ``FILTER_WORDS`` rows of 64 bits: this bounds what is broadcast. A full filter marks all rows.
    """
    at = lambda: F.xxhash64(F.col("id"), F.lit(3))
    word, bit = F.pmod(at(), F.lit(FILTER_WORDS)), F.pmod(F.shiftright(at(), 20), F.lit(64)).cast("int")
    bits = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    both = df.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(bits), "_word", "left")
    return both.select(*df.columns, F.expr("coalesce(getbit(_bits, _bit) = 1, false)").alias("_maybe"))


def within(df: DataFrame, ids: DataFrame) -> DataFrame:
    return marked(df, ids).where("_maybe").drop("_maybe").join(ids, "id", "left_semi")


def without(df: DataFrame, ids: DataFrame) -> DataFrame:
    rows = marked(df, ids)
    return rows.where("NOT _maybe").drop("_maybe").unionByName(rows.where("_maybe").drop("_maybe").join(ids, "id", "left_anti"))


def similar_enough(pairs: DataFrame, meta: DataFrame, percent: int) -> DataFrame:
    """Pairs within the size bound whose parity sketches differ in no more bits than the sets may."""
    side = lambda c: meta.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    unequal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fits = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (unequal * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))
    return both.where(fits).select("a", "b", "na", "nb")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda c: sets.select(F.col("id").alias(c), F.col("shingles").alias(f"s{c}"))
    common: Column = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(side("b"), "b").join(side("a"), "a").where(common * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def jaccard_components(
    df: DataFrame, text: str = "text", ident: str = "doc_id", width: int = 5, percent: int = 80,
) -> DataFrame:
    """``(<ident>, n_shingles, component_id)`` for every row: sets of ``width``-word shingles whose Jaccard similarity is ``percent`` / 100 or
    more are linked, a component is named after its smallest id.

    A text of fewer words is one shingle; a null text or one without words has no shingles and no links: it is its own component.
    A row with a null id is linked with nothing and has a null component. Rows that share an id are one document with several
    texts. An empty table gives no rows; other columns are ignored. Intermediate tables go to the session's shared folder.
    """
    spark = df.sparkSession
    root = work_path(spark, "jaccard")

    def stored(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    slim = df.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    rows = slim.mapInArrow(words.tidy(partial(emitted, width, percent)), ROW)
    found = stored(_sorted(rows, "kind", "id").mapInArrow(words.tidy(grouped), ROW), "groups")
    meta = found.where(F.col("kind") == META).select("id", "n", "rep", "sketch")
    one = meta.select("id", "rep")
    members = found.where(F.col("kind") == MEMBER).select("key", "id", "band")
    # Equal sets that met only in the shuffle have the same keys: all but the first are left out.
    members = stored(without(members, one.where("id <> rep").select("id").distinct()), "members")
    firsts = meta.groupBy(F.col("rep").alias("id")).agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))

    # One pair per document, with the centre that it shares most keys with.
    shared = _sorted(members, "id").mapInArrow(words.tidy(stars), "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("keys"))
    pairs = shared.groupBy("b").agg(F.max(F.struct("keys", (-F.col("a")).alias("a"))).alias("best"))
    pairs = stored(similar_enough(pairs.select((-F.col("best.a")).alias("a"), "b"), firsts, percent), "stars")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        texts = within(slim, ids)
        return stored(texts.mapInArrow(words.tidy(partial(with_shingles, width)), "id long, shingles array<long>"), name)

    sets = sets_of(wanted, "sets")
    links = stored(verified(pairs, sets, percent), "links")
    left, tried = members, pairs.select("a", "b")
    bits = [F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(BITS // 64)]
    for level in range(SPLITS + 1):
        known = components(links)
        now = left.drop("component").join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
        # In a group of one component nothing is left to try.
        mixed = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
        now = now.join(mixed, "key", "left_semi").join(firsts.select("id", "n", *bits), "id")
        out = stored(_sorted(now, "component", "id").mapInArrow(words.tidy(partial(crossing, percent, level == SPLITS)), TRY), f"crossing{level}")
        fresh = out.where("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        size = lambda c: firsts.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"))
        fresh = stored(fresh.join(tried, ["a", "b"], "left_anti").join(size("a"), "a").join(size("b"), "b"), f"pairs{level}")
        wide = out.where("b IS NULL").select("key", F.col("a").alias("id"), "band")
        needed = fresh.select(F.explode(F.array("a", "b")).alias("id")).unionByName(wide.select("id")).distinct()
        if not needed.isEmpty():
            sets = sets.unionByName(sets_of(needed.join(sets.select("id"), "id", "left_anti"), f"sets{level}"))
        if not fresh.isEmpty():
            tried = tried.unionByName(fresh.select("a", "b"))
            links = links.unionByName(stored(verified(fresh, sets, percent), f"links{level}"))
        if wide.isEmpty():
            break
        wide = wide.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
        left = wide.join(sets, "id").select("key", "id", "band", "component", "shingles").mapInArrow(
            partial(split, percent, LEVELS + level), "key long, id long, band int, component long"
        )
    known = components(links)
    copies = found.where(F.col("kind") == COPY).select("id", "n", F.col("rep").alias("first"))
    nodes = meta.select("id", "n", F.col("id").alias("first")).unionByName(copies)
    named = nodes.join(one.distinct().withColumnRenamed("id", "first"), "first", "left").withColumn("rep", F.coalesce("rep", "first"))
    named = named.join(known.withColumnRenamed("id", "rep"), "rep", "left")
    return named.select(F.col("id").alias(ident), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs, width=4, percent=85)

"""Merkle manifest of a dataset, its leaves placed by bitmap rank.

Each group (source) is a tree over its rows in the order of an integer key. Nobody sorts the rows: per group, the keys form a
bitmap in chunks of 4096, of which only the 64-bit words with a bit are kept, each with the number of rows before it (the popcount
directory). Bits and counts combine before the shuffle; running totals over the chunks give each chunk's start. A row's place is then
a rank query: chunk start + rows before the word + bits below its own.

Nodes are keyed by (group, place), and 3^``LEVELS`` of them fill a slot array, which reduces that many levels at once; the results are
the nodes of the next tier, a few tiers in all. The groups' roots are the nodes of one more tree. Going down again, every block hands
its slots the siblings above them, so a leaf's whole path is known where its block is, without a shuffle of proofs.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwise.llm.words import tidy
from shiftwise.operators.ordered import index_rows, prefix_sums
from shiftwise.session import work_path

ARITY = 3
LEVELS = 6  # of a slot array
#: word of rows whose key is null: before the word of any 64-bit key
NULL_WORD = -(1 << 60)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_hash(columns: dict[str, Column]) -> Column:
    """sha256 (hex) of the columns in turn: ``-`` for null, else UTF-8 length, ``:`` and value."""
    parts = []
    for c in columns.values():
        c = c.cast("string")
        parts.append(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)))
    return F.sha2(F.concat(*parts), 256)


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, f"manifest-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _word(key: Column) -> Column:
    return F.coalesce(F.shiftright(key, 6), F.lit(NULL_WORD))


def bitmap_directory(rows: DataFrame) -> DataFrame:
    """``(g, chunk, n, start, ws, bits, before, repeated)`` from ``(g, key)``: per chunk the numbers of its words, their bits, the rows
    before each, and whether a key repeats in it; ``n`` are the group's rows and ``start`` those in earlier chunks."""
    bit = F.coalesce(F.col("key").bitwiseAND(63), F.lit(0).cast("long"))
    keyed = rows.select("g", _word(F.col("key")).alias("word"), F.element_at(F.lit([1 << i for i in range(63)] + [-(1 << 63)]).cast("array<long>"), (bit + 1).cast("int")).alias("bit"))
    words = keyed.groupBy("g", "word").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("rows"))
    entry = F.struct(F.col("word").bitwiseAND(63).cast("byte").alias("w"), "bits", "rows")
    chunks = words.groupBy("g", F.shiftright("word", 6).alias("chunk")).agg(F.sort_array(F.collect_list(entry)).alias("e"), F.sum("rows").alias("rows"))
    placed = prefix_sums(_kept(chunks, "chunks"), ["g"], ["chunk"], {"rows": F.col("rows")})
    # 64 words a chunk at most
    before = F.transform(F.sequence(F.lit(0), F.size("e") - 1), lambda i: F.aggregate(F.slice("e.rows", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    return placed.select(
        "g", "chunk", F.col("rows_total").alias("n"), (F.col("rows_upto") - F.col("rows")).alias("start"), F.col("e.w").alias("ws"), F.col("e.bits").alias("bits"),
        before.alias("before"), F.transform("e", lambda x: x["rows"] > F.bit_count(x["bits"])).alias("repeated"),
    )


def leaf_places(rows: DataFrame) -> DataFrame:
    """``(g, n, place, key, leaf, other)`` from ``(g, key, leaf, other)``: the place of each row by ascending key within its group, from 0.

    Rows that share a key follow each other by leaf; a null key comes first.
    """
    directory = bitmap_directory(rows.select("g", "key"))
    keyed = rows.select("*", _word(F.col("key")).alias("word")).withColumn("chunk", F.shiftright("word", 6))
    at = F.array_position("ws", F.col("word").bitwiseAND(63).cast("byte")).cast("int")
    below = F.coalesce(F.col("key").bitwiseAND(63), F.lit(0).cast("long")).cast("int")
    masks = F.lit([(1 << i) - 1 for i in range(64)]).cast("array<long>")
    ranked = keyed.join(directory.hint("shuffle_hash"), ["g", "chunk"]).withColumn("at", at).select(
        "g", "n", "key", "leaf", "other", "word", F.element_at("repeated", F.col("at")).alias("repeated"), (F.col("start") + F.element_at("before", F.col("at"))).alias("base"),
        F.bit_count(F.element_at("bits", F.col("at")).bitwiseAND(F.element_at(masks, below + 1))).alias("rank"),
    )
    ranked = _kept(ranked, "ranked")
    single = ranked.where("NOT repeated").select("g", "n", (F.col("base") + F.col("rank")).alias("place"), "key", "leaf", "other")
    alike = ranked.where("repeated").groupBy("g", "n", "word", "base", "key", "leaf").agg(F.min("other").alias("other"), F.count(F.lit(1)).alias("c"))
    several = prefix_sums(_kept(alike, "repeated"), ["g", "word"], ["key", "leaf"], {"c": F.col("c")})
    first = F.col("base") + F.col("c_upto") - F.col("c")
    each = several.select("g", "n", F.explode(F.sequence(first, first + F.col("c") - 1)).alias("place"), "key", "leaf", "other")
    return single.unionByName(each)


def _levels(slots: list[str], n: int, levels: int) -> list[list[str]]:
    """Level by level: up to one node if the block has all ``n`` nodes of its tier, else up by ``levels``."""
    out = [slots]
    while (len(out[-1]) > 1) if n <= ARITY**levels else (len(out) <= levels):
        last = out[-1]
        out.append([digest("".join(last[i : i + ARITY])) for i in range(0, len(last), ARITY)])
    return out


def _siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Per level the digests before and after the node's own in its run."""
    out = []
    for level in levels[:-1]:
        first = at - at % ARITY
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + ARITY])))
        at //= ARITY
    return out


def _fold(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = digest(before + node + after)
    return node


def _written(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{a}|{b}" for a, b in path)


def _read(path: str) -> list[tuple[str, str]]:
    return [tuple(p.split("|")) for p in path.split(";")] if path else []


def _slot_array(slots: list[dict], name: str) -> list[str]:
    out = [""] * len(slots)
    for s in slots:
        out[s["slot"]] = s[name].hex()
    return out


def _tiers(blocks: DataFrame, most: int, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of blocks ``(g, n, b, slots)``, one per tier, and ``(g, digest)`` of each group's root; ``n`` counts the nodes of a tier."""

    def run(batches):
        for batch in batches:
            rows = [(r["g"], r["n"], r["b"], _levels(_slot_array(r["slots"], "leaf"), r["n"], depth)[-1][0]) for r in batch.to_pylist()]
            g, n, b, d = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(g, pa.string()), pa.array(n, pa.int64()), pa.array(b, pa.int64()), pa.array([bytes.fromhex(x) for x in d], pa.binary())], names=["g", "n", "place", "leaf"]
            )

    block, tiers, roots = ARITY**depth, [blocks], None
    while True:
        nodes = _kept(tiers[-1].select("g", "n", "b", F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), s["leaf"].alias("leaf"))).alias("slots"))
                      .mapInArrow(tidy(run), "g string, n long, place long, leaf binary"), "nodes")
        done = nodes.where(F.col("n") <= block).select("g", F.col("leaf").alias("digest"))
        roots = done if roots is None else roots.unionByName(done)
        if most <= block:
            return tiers, roots
        more = nodes.where(F.col("n") > block).withColumn("n", F.ceil(F.col("n") / block))
        tiers.append(_blocks(more, depth, "leaf"))
        most = -(-most // block)


def _blocks(nodes: DataFrame, depth: int, *carried: str) -> DataFrame:
    """Nodes ``(g, n, place, ...)`` in slot arrays."""
    block = ARITY**depth
    slot = F.struct((F.col("place") % block).cast("int").alias("slot"), *carried)
    return _kept(nodes.groupBy("g", "n", F.floor(F.col("place") / block).alias("b")).agg(F.collect_list(slot).alias("slots")), "blocks")


def _handed_down(tiers: list[DataFrame], tops: DataFrame, depth: int) -> DataFrame:
    """``(g, n, b, slots, path, subroot, root)``: the blocks of the lowest tier with the path above them; ``tops (g, path, subroot, root)``
    has what lies above each group's root."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                slots = _slot_array(r["slots"], "leaf")
                levels = _levels(slots, r["n"], depth)
                paths = [";".join(filter(None, [_written(_siblings(levels, i)), r["path"]])) for i in range(len(slots))]
                m = len(slots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["g"]] * m, pa.string()), pa.array([r["b"] * block + i for i in range(m)], pa.int64()), pa.array(paths, pa.string()),
                     pa.array([r["subroot"]] * m, pa.string()), pa.array([r["root"]] * m, pa.string())], names=["g", "b", "path", "subroot", "root"],
                )

    block, above = ARITY**depth, None
    for blocks in reversed(tiers):
        known = blocks.where(F.col("n") <= block).join(tops, "g")
        if above is not None:
            known = known.unionByName(blocks.where(F.col("n") > block).join(above, ["g", "b"]))
        if blocks is tiers[0]:
            return known
        above = _kept(known.mapInArrow(tidy(run), "g string, b long, path string, subroot string, root string"), "paths")
    raise AssertionError("no tiers")


def merkle_proofs(rows: DataFrame, group: str, key: str, leaf: str, other: str, depth: int = LEVELS) -> DataFrame:
    """``(group, key, place, leaf, subroot, root, proof, folded_root)`` per row of ``rows``.

    ``leaf`` and ``other`` are hex digests; ``other`` may be null and then stands for the leaf itself. ``proof`` has the siblings of
    every level up to the root, joined; ``folded_root`` is what the siblings make of ``other``. A node is the hash of up to three;
    a tree of one leaf is that leaf. Groups are ordered by their UTF-8 bytes, null first. Null keys come first in their
    group; rows that share a key follow each other by leaf, and equal rows all come back. An empty table gives no rows. Other
    columns play no part. Only counts reach the driver.
    """
    g = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit(":"), F.col(group).cast("string")))
    named = rows.select(g.alias("g"), F.col(key).cast("long").alias("key"), F.unhex(leaf).alias("leaf"), F.unhex(other).alias("other"))
    blocks = _blocks(leaf_places(named), depth, "key", "leaf", "other")
    block = ARITY**depth
    most = blocks.agg(F.max("n")).first()[0] or 0
    tiers, roots = _tiers(blocks, most, depth)
    subroots = _kept(index_rows(roots, ["g"], name="place"), "subroots")
    count = subroots.count()
    top_nodes = subroots.select(F.lit("").alias("g"), F.lit(count).cast("long").alias("n"), "place", F.col("digest").alias("leaf"))
    top_tiers, tops = _tiers(_blocks(top_nodes, depth, "leaf"), count, depth)
    root = tops.select(F.lit("").alias("g"), F.lit("").alias("path"), F.lit("").alias("subroot"), F.lower(F.hex("digest")).alias("root"))

    def slots_of(batches):
        for batch in batches:
            for r in batch.to_pylist():
                slots = _slot_array(r["slots"], "leaf")
                levels = _levels(slots, r["n"], depth)
                m = len(slots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["b"] * block + i for i in range(m)], pa.int64()), pa.array([";".join(filter(None, [_written(_siblings(levels, i)), r["path"]])) for i in range(m)], pa.string()),
                     pa.array([r["root"]] * m, pa.string())], names=["place", "path", "root"],
                )

    by_place = _handed_down(top_tiers, root, depth).mapInArrow(tidy(slots_of), "place long, path string, root string")
    over = subroots.join(by_place, "place").select("g", "path", F.lower(F.hex("digest")).alias("subroot"), "root")

    def leaves_of(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                m = len(r["slots"])
                slots = _slot_array(r["slots"], "leaf")
                levels = _levels(slots, r["n"], depth)
                above = _read(r["path"])
                tail = "".join(a + b for a, b in above)
                folded = {}
                keys, proofs, roots = [None] * m, [""] * m, [""] * m
                for s in r["slots"]:
                    i = s["slot"]
                    mine = _siblings(levels, i)
                    top = _fold(s["other"].hex() if s["other"] is not None else slots[i], mine)
                    if top not in folded:
                        folded[top] = _fold(top, above)
                    keys[i], proofs[i], roots[i] = s["key"], "".join(a + b for a, b in mine) + tail, folded[top]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["g"][1:] if r["g"] else None] * m, pa.string()), pa.array(keys, pa.int64()), pa.array([r["b"] * block + i for i in range(m)], pa.int64()),
                     pa.array(slots, pa.string()), pa.array([r["subroot"]] * m, pa.string()), pa.array([r["root"]] * m, pa.string()), pa.array(proofs, pa.string()), pa.array(roots, pa.string())],
                    names=[group, key, "place", "leaf", "subroot", "root", "proof", "folded_root"],
                )

    schema = f"`{group}` string, `{key}` long, place long, leaf string, subroot string, root string, proof string, folded_root string"
    return _handed_down(tiers, over, depth).mapInArrow(tidy(leaves_of), schema)


def op11_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    changed = F.replace("text", F.lit("\n"), F.lit(""))
    tampers = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    leaves = docs.select("doc_id", "source", leaf_hash(columns).alias("leaf"), F.when(tampers, leaf_hash({**columns, "text": changed})).alias("other"))
    return merkle_proofs(leaves, "source", "doc_id", "leaf", "other").select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


OP11_SQL = """
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
  FROM range(256) r(i))),
fields AS (SELECT doc_id, source,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END ||
    CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END ||
    CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END ||
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
    text, replace(text, chr(10), '') AS bare,
    xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))),
      lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)]))) % 2 = 0 AS tampered
  FROM documents, crc),
leaves AS (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    CASE WHEN tampered AND text IS NOT NULL THEN sha256(head || strlen(bare) || ':' || bare) END AS other FROM fields),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
nodes AS (
  SELECT source, 0 AS level, place, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM placed
  UNION ALL
  SELECT source, level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, level, place // 3),
subroots AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place, subroot AS node, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, place // 3),
runs AS (SELECT source, level, place // 3 AS up, list({'place': place, 'node': node} ORDER BY place) AS run FROM nodes WHERE n > 1 GROUP BY ALL),
top_runs AS (SELECT level, place // 3 AS up, list({'place': place, 'node': node} ORDER BY place) AS run FROM tops WHERE n > 1 GROUP BY ALL),
walk AS (
  SELECT doc_id, source, place AS leaf_place, 0 AS level, place, '' AS proof, coalesce(other, leaf) AS folded FROM placed
  UNION ALL
  SELECT doc_id, w.source, leaf_place, w.level + 1, w.place // 3,
    proof || list_aggregate(list_transform(run, lambda r: CASE WHEN r.place = w.place THEN '' ELSE r.node END), 'string_agg', ''),
    sha256(list_aggregate(list_transform(run, lambda r: CASE WHEN r.place = w.place THEN folded ELSE r.node END), 'string_agg', ''))
  FROM walk w JOIN runs r ON w.source IS NOT DISTINCT FROM r.source AND w.level = r.level AND w.place // 3 = r.up),
ended AS (SELECT w.*, subroot, s.place AS top_place FROM walk w JOIN subroots s ON w.source IS NOT DISTINCT FROM s.source
  JOIN (SELECT source, max(level) AS top FROM nodes GROUP BY source) h ON w.source IS NOT DISTINCT FROM h.source WHERE w.level = h.top),
climb AS (
  SELECT source, leaf_place, 0 AS level, top_place AS place, proof, folded FROM ended
  UNION ALL
  SELECT source, leaf_place, c.level + 1, c.place // 3,
    proof || list_aggregate(list_transform(run, lambda r: CASE WHEN r.place = c.place THEN '' ELSE r.node END), 'string_agg', ''),
    sha256(list_aggregate(list_transform(run, lambda r: CASE WHEN r.place = c.place THEN folded ELSE r.node END), 'string_agg', ''))
  FROM climb c JOIN top_runs r ON c.level = r.level AND c.place // 3 = r.up)
SELECT p.doc_id, p.leaf, e.subroot, root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = root AS verified
FROM climb c JOIN (SELECT max(level) AS top FROM tops) h ON c.level = h.top
JOIN placed p ON p.source IS NOT DISTINCT FROM c.source AND p.place = c.leaf_place
JOIN ended e ON e.source IS NOT DISTINCT FROM c.source AND e.leaf_place = c.leaf_place
CROSS JOIN (SELECT node AS root FROM tops WHERE n = 1)
"""

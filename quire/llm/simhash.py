"""SimHash near-duplicates: fingerprints, links by pigeonhole blocks, connected components.

Fingerprints are cut into blocks.  Two that differ in at most ``distance`` bits agree in all
but ``distance`` blocks, so they meet in a bucket for one choice of agreeing blocks.  Small
buckets are joined with themselves and the Hamming distance is verified.  In a large bucket
every fingerprint is also listed under its one-bit changes: two that differ in two bits share
one of these, and a list holds at most one fingerprint per bit, so the work stays in
proportion to the bucket and no link is lost.

Only distinct fingerprints are linked; copies follow by their fingerprint.  Null and empty
texts have fingerprint zero and are linked like any other.  A null id never is the smallest
one; a group without any id has a null component.  Rows repeat as given.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import column_function, cut, map_batches

BITS = 64
SHINGLE = 3
SEED = 42


def fingerprint(text: str | None) -> int:
    """The SimHash of the 3-word shingles of a text, as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    span = min(SHINGLE, len(words)) - 1
    first, last = (ends - size)[: len(words) - span], ends[span:]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(BITS, dtype=np.int64), len(first)
    for at in range(0, n, 65_536):
        pairs = zip(first[at : at + 65_536].tolist(), last[at : at + 65_536].tolist(), strict=True)
        hashes = np.array([digest(data[a:b], SEED) for a, b in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, fp bigint"
    return map_batches(
        docs.select(F.col(id_col), F.col(text_col)),
        schema,
        lambda: lambda ids, texts: (ids, list(map(fingerprint, texts))),
    )


def hex_of(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_masks(blocks: int, distance: int) -> list[int]:
    """One mask for every choice of blocks that two close fingerprints can agree in."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def links(fps: DataFrame, distance: int = 2, blocks: int = 4, paired: int = 64) -> DataFrame:
    """(a, b) of distinct fingerprints, each link verified; every close pair is connected by them.

    ``fps`` has distinct values ``fp``.  Buckets of up to ``paired`` fingerprints give all their
    close pairs; larger ones give, for every list of one-bit changes, the links to its smallest
    member, which is close to all others.  ``distance`` is 1 or 2.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    masks = [_signed(m) for m in block_masks(blocks, distance)]
    keys = F.array(*[F.struct(F.lit(i).alias("no"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)])
    buckets = fps.select("fp", F.inline(keys))
    sizes = buckets.groupBy("no", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut(buckets.join(sizes, ["no", "part"]))

    def close(a: Column, b: Column) -> Column:
        return F.bit_count(a.bitwiseXOR(b)) <= distance

    small = shared.filter(F.col("n") <= paired).select("no", "part", "fp")
    x, y = small.withColumnRenamed("fp", "a"), small.withColumnRenamed("fp", "b")
    pairs = x.join(y, ["no", "part"]).filter((F.col("a") < F.col("b")) & close(F.col("a"), F.col("b")))

    free = [[b for b in range(BITS) if not (m >> b) & 1] for m in block_masks(blocks, distance)]
    flips = F.array(*[F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << b)) for b in bits]) for bits in free])
    change = F.explode(F.element_at(flips, F.col("no") + 1)).alias("flip")
    lists = shared.filter(F.col("n") > paired).select("no", "part", "fp", change)
    lists = lists.groupBy("no", "part", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
    stars = lists.agg(F.min("fp").alias("a"), F.collect_set("fp").alias("members")).filter(F.size("members") > 1)
    stars = stars.select("a", F.explode("members").alias("b")).filter((F.col("a") < F.col("b")) & close(F.col("a"), F.col("b")))
    return pairs.select("a", "b").union(stars)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b); the root is the smallest node reachable.

    Alternates the large-star and small-star steps until the edges no longer change, which
    takes a number of rounds logarithmic in the longest path.  A node's smallest neighbour is
    pre-aggregated; each round is written to the checkpoint folder.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = cut(e.distinct())
    last, now = None, state(e)
    while now != last:
        both = e.union(e.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")
        )
        e = cut(small.filter("u <> v").distinct())
        last, now = now, state(e)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select("v", "v").distinct())


def groups(prints: DataFrame, distance: int = 2, blocks: int = 4, id_col: str = "doc_id") -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of (id, fp)."""
    fps = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    roots = components(links(fps.select("fp"), distance, blocks)).withColumnRenamed("node", "fp")
    placed = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, distance: int = 2, blocks: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document ``fingerprint`` and ``component_id``.

    With ``blocks`` of 6 a bucket fixes 42 bits or more: use it from billions of fingerprints.
    The copies of one text meet by their fingerprint in one join, which Spark splits where a
    fingerprint is frequent.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    found = cut(groups(prints, distance, blocks, id_col).select("fp", "component_id"))
    return prints.join(found, "fp").select(id_col, hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(
    docs: DataFrame, distance: int = 2, blocks: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One document of each group, the one of the smallest id, with all its columns.

    Rows that repeat both an id and a fingerprint count as one document.  Of a group without
    ids one row stays.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    found = cut(groups(prints, distance, blocks, id_col))
    own = prints.distinct().join(found, "fp").filter(F.col(id_col).eqNullSafe(F.col("component_id")))
    id_type = docs.schema[id_col].dataType

    def key(c: Column) -> list[Column]:
        return [c.isNull().alias("_no_id"), F.coalesce(c, F.lit(0).cast(id_type)).alias("_id")]

    keep = own.groupBy("root").agg(F.min(F.struct(F.col(id_col), F.col("fp"))).alias("k"))
    keep = keep.select(*key(F.col(f"k.{id_col}")), F.col("k.fp").alias("_fp"))
    printed = docs.select("*", *key(F.col(id_col)), column_function("bigint", lambda: lambda t: list(map(fingerprint, t)))(F.col(text_col)).alias("_fp"))
    names = ["_no_id", "_id", "_fp"]
    return printed.join(keep, names, "left_semi").dropDuplicates(names).drop(*names)

"""SimHash for near copies: long fingerprints in pigeonhole blocks, links verified exactly.

Two documents are near copies if their sets of 5-word shingles have a Jaccard similarity of at
least ``similarity``.  The fingerprint of a set is long: of a pair at the bound a known share of
all bits differs, and blocks are as many as make it agree in one of them with probability
``recall`` (pairs above the bound agree more often).  The width of a block follows the number of
documents, so that unlike documents seldom share one and work stays nearly in proportion.

Documents of a shared block are candidates if 64 further bits of theirs are close too; what is
linked is then decided by the shingles themselves.  At first each document is verified against
its nearest candidate and the one of smallest name only.  Blocks whose candidates these links
leave in different components are then compared whole, chunk by chunk: the sets of documents that
are close in still more bits meet in one task for each two chunks, which gives no list of pairs
but the links that join components, fewer than its documents.  So rows stay in proportion to the
documents of a block, however many of its pairs are close, and no component is lost.

Words are lower-cased in A-Z.  A text of fewer words than a shingle is one shingle; texts without
words (null and empty ones) are copies of each other.  Equal sets have equal fingerprints and
count as one; so do sets whose long fingerprints are equal, which are far closer than the bound.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bound_batches, cut, map_batches
from quire.llm.simhash import components

SHINGLE = 5
SEED = 42
SKETCH = 64
#: Nodes of a block value that give all their pairs at once.
PAIRED = 32
#: Nodes of a chunk of a larger one.
CHUNK = 256
#: Rows of a list of block values or nodes that is small enough to be broadcast.
LISTED = 100_000


@dataclass(frozen=True)
class Blocks:
    """How fingerprints are cut: ``count`` blocks of ``width`` bits, sketches within ``near`` bits."""

    count: int
    width: int
    near: int


def plan_blocks(documents: int, similarity: float = 0.8, recall: float = 0.95) -> Blocks:
    """The blocks for a number of documents.

    A bit of two sets of cosine c differs with probability arccos(c) / pi, where c is 2J / (1 + J)
    for sets of one size and Jaccard similarity J.
    """
    differ = _differ(similarity)
    width = max(8, math.ceil(math.log2(max(documents, 1))) - 1)
    count = math.ceil(math.log(1 - recall) / math.log1p(-((1 - differ) ** width)))
    return Blocks(count, width, _reach(SKETCH, similarity))


def _differ(similarity: float) -> float:
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _reach(bits: int, similarity: float) -> int:
    """How many of so many bits a pair at the bound differs in, hardly ever more."""
    differ = _differ(similarity)
    return math.ceil(bits * differ + 3.5 * math.sqrt(bits * differ * (1 - differ)))


def shingle_set(text: str | None) -> np.ndarray:
    """The XXH64 values of a text's distinct shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    data = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    span = min(SHINGLE, len(words)) - 1
    first, last = (ends - size)[: len(words) - span], ends[span:]
    digest = xxhash.xxh64_intdigest
    hashes = (digest(data[a:b], SEED) for a, b in zip(first.tolist(), last.tolist(), strict=True))
    return np.unique(np.fromiter(hashes, dtype=np.uint64, count=len(first)))


def long_fingerprint(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The SimHash of a set in ``bits`` bits, as zeros and ones.

    Each hash is spread to as many words of 64 bits as needed by a mixer of its value and place.
    """
    words = -(-bits // 64)
    ones = np.zeros(64 * words, dtype=np.int64)
    place = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 2040):
        x = hashes[at : at + 2040, None] + place
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        spread = np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1)
        for row in range(0, len(spread), 255):  # as many as one byte can count
            ones += spread[row : row + 255].sum(0, dtype=np.uint8)
    return (2 * ones > len(hashes)).astype(np.uint8)[:bits]


def fingerprints(docs: DataFrame, blocks: Blocks, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, node, sketch, parts) of every document.

    ``node`` names the fingerprint, ``parts`` are its blocks' values with their numbers in the
    bits from 40 on.  ``text_key`` is a hash of the text as it is, to find the row again.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, text_key bigint, node bigint, sketch bigint, parts array<bigint>"
    power = np.int64(1) << np.arange(blocks.width, dtype=np.int64)
    number = np.arange(blocks.count, dtype=np.int64) << 40

    def one(text: str | None) -> tuple[int, int, np.ndarray]:
        bits = long_fingerprint(shingle_set(text), SKETCH + blocks.count * blocks.width)
        sketch = int(np.packbits(bits[:SKETCH]).view("<i8")[0])
        parts = bits[SKETCH:].reshape(blocks.count, blocks.width) @ power + number
        node = xxhash.xxh64_intdigest(np.packbits(bits).tobytes())
        return node - (1 << 64) if node >> 63 else node, sketch, parts

    def start():
        def step(ids: list, keys: list, texts: list) -> tuple:
            made = [one(t) for t in texts]
            return ids, keys, [m[0] for m in made], [m[1] for m in made], [m[2] for m in made]

        return step

    return map_batches(docs.select(F.col(id_col), text_key(text_col), F.col(text_col)), schema, start)


def text_key(text_col: str) -> Column:
    return F.xxhash64(text_col).alias("text_key")


def _members(nodes: DataFrame) -> tuple[DataFrame, Column]:
    """(part, node, sketch, n) of the nodes that share a block, n of them, and their struct."""
    rows = nodes.select(F.explode("parts").alias("part"), "node", "sketch")
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(sizes, "part"), F.struct("node", "sketch")


def close_groups(nodes: DataFrame, near: int, paired: int = PAIRED) -> DataFrame:
    """(part, all): the nodes of each block of up to ``paired`` that have a close one there."""
    shared, member = _members(nodes)
    small = shared.filter(F.col("n") <= paired).groupBy("part").agg(F.collect_list(member).alias("all"))

    def other(x: Column) -> Column:
        return F.exists("all", lambda y: (x.node != y.node) & _close(x.sketch, y.sketch, near))

    return small.select("part", F.filter("all", other).alias("all")).filter(F.size("all") > 1)


def close_pairs(nodes: DataFrame, groups: DataFrame, near: int, paired: int = PAIRED) -> DataFrame:
    """(a, b, apart) with a < b of nodes (node, sketch, parts) that share a block; ``apart`` of their sketches' bits differ.

    ``groups``, those of blocks of up to ``paired`` nodes, give all their close pairs, larger blocks
    pairs with their smallest node and with the smallest of each beginning of the sketch.
    """
    x = groups.select("all", F.explode("all").alias("x"))
    small = x.select("x", F.explode(F.filter("all", lambda y: (F.col("x.node") < y.node) & _close(F.col("x.sketch"), y.sketch, near))).alias("y"))

    shared, member = _members(nodes)
    begin = F.explode(F.array(F.lit(-1).cast("bigint"), F.shiftrightunsigned("sketch", 58))).alias("begin")
    large = shared.filter(F.col("n") > paired).select("part", "node", "sketch", begin)
    hubs = large.groupBy("part", "begin").agg(F.min(member).alias("x"))
    large = large.join(hubs, ["part", "begin"]).filter((F.col("x.node") < F.col("node")) & _close(F.col("x.sketch"), F.col("sketch"), near))
    pairs = small.union(large.select("x", member.alias("y")))
    apart = F.bit_count(F.col("x.sketch").bitwiseXOR(F.col("y.sketch")))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), apart.alias("apart")).distinct()


def candidates(nodes: DataFrame, near: int, paired: int = PAIRED) -> DataFrame:
    """(a, b) of ``close_pairs``."""
    return close_pairs(nodes, close_groups(nodes, near, paired), near, paired).select("a", "b")


def nearest(pairs: DataFrame) -> DataFrame:
    """(a, b): of the pairs (a, b, apart), each node's with its nearest and with its smallest other one."""
    sides = F.array(
        F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "apart"),
        F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "apart"),
    )
    best = pairs.select(F.inline(sides)).groupBy("node").agg(F.min(F.struct("apart", "other")).alias("near"), F.min("other").alias("least"))
    best = best.select("node", F.explode(F.array("near.other", "least")).alias("other"))
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _close(a: Column, b: Column, near: int) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= near


def unpaired(
    nodes: DataFrame, found: DataFrame, blocks: Blocks, similarity: float, paired: int = PAIRED, chunk: int = CHUNK
) -> DataFrame:
    """(a, b) with a < b: all close pairs of larger blocks whose nodes (node, root) of ``found`` keep apart."""
    meet = meetings(large_blocks(nodes, found, blocks, paired, chunk))
    return _close_members(meet, blocks, similarity).distinct()


def large_blocks(nodes: DataFrame, found: DataFrame, blocks: Blocks, paired: int = PAIRED, chunk: int = CHUNK) -> DataFrame:
    """(part, only, place, m): blocks of more than ``paired`` nodes that hold several components of ``found``, dealt.

    A block is dealt into chunks of about ``chunk`` nodes, those of a large component by
    themselves, and every chunk meets every other, but not one of the same component.  A block
    that is one component is left out.  Sketches that are close are compared in more bits.
    """
    rows = nodes.select(F.explode("parts").alias("part"), "node", "sketch", _more_bits(blocks).alias("bits"))
    big = cut(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > paired).select("part"))
    if big.count() <= LISTED:
        big = F.broadcast(big)
    large = rows.join(big, "part").join(found, "node", "left")
    large = large.select("part", "node", "sketch", "bits", F.coalesce("root", "node").alias("root"))
    apart = large.groupBy("part").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    large = cut(large.join(apart.select("part"), "part"))

    share = large.groupBy("part", "root").agg(F.count(F.lit(1)).alias("alike"))
    size = share.groupBy("part").agg(F.sum("alike").alias("n"))
    dealt = large.join(share, ["part", "root"]).join(size, "part")
    own = F.col("alike") >= chunk
    only = F.when(own, F.col("root"))
    place = F.when(own, F.pmod(F.xxhash64("node"), F.ceil(F.col("alike") / chunk))).otherwise(
        F.pmod(F.xxhash64("root"), F.ceil(F.col("n") / chunk))
    )
    return dealt.select("part", only.alias("only"), place.alias("place"), F.struct("node", "sketch", "root", "bits").alias("m"))


def small_blocks(nodes: DataFrame, groups: DataFrame, found: DataFrame, blocks: Blocks) -> DataFrame:
    """(part, only, place, m) of ``groups`` that hold several components of ``found``, each one chunk."""
    rows = groups.select("part", F.explode("all.node").alias("node")).join(found, "node", "left")
    rows = rows.withColumn("root", F.coalesce("root", "node"))
    apart = rows.groupBy("part").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
    rows = rows.join(apart.select("part"), "part").join(nodes.select("node", "sketch", _more_bits(blocks).alias("bits")), "node")
    none, member = F.lit(None).cast("bigint").alias("only"), F.struct("node", "sketch", "root", "bits").alias("m")
    return rows.select("part", none, F.lit(0).cast("bigint").alias("place"), member)


def meetings(dealt: DataFrame) -> DataFrame:
    """The members of every two chunks of a block, and of every one with itself, but not of one component."""
    chunks = cut(dealt.groupBy("part", "only", "place").agg(F.collect_list("m").alias("m")))
    chunks = chunks.withColumn("no", F.monotonically_increasing_id())

    x, y = (chunks.select("part", F.col("no").alias(f"{e}no"), F.col("only").alias(f"{e}only")) for e in "xy")
    meet = x.join(y, "part").filter((F.col("xno") <= F.col("yno")) & ~F.coalesce(F.col("xonly") == F.col("yonly"), F.lit(False)))
    meet = meet.select("xno", "yno")
    for e in "xy":
        members = [F.col(f"m.{n}").alias(e + n) for n in ("node", "sketch", "root")]
        meet = meet.join(chunks.select(F.col("no").alias(f"{e}no"), *members, F.flatten("m.bits").alias(f"{e}bits")), f"{e}no")
    return meet


#: Words of a node beside its sketch, two blocks' bits each.
_WORDS = 8


def _more_bits(blocks: Blocks) -> Column:
    def own(i: int) -> Column:
        return F.col("parts")[i].bitwiseAND(F.lit((1 << blocks.width) - 1))

    words = [F.shiftleft(own(2 * i), 32).bitwiseOR(own(2 * i + 1)) for i in range(min(_WORDS, blocks.count // 2))]
    return F.array(*words).cast("array<bigint>")


def _close_members(meet: DataFrame, blocks: Blocks, similarity: float, pairs_of: bool = True) -> DataFrame:
    """The close pairs between the members of each row's two chunks that are of different components.

    Without ``pairs_of`` only the members that have such a pair, (xno, yno, node, root).
    """
    near, words = blocks.near, min(_WORDS, blocks.count // 2)
    reach = _reach(SKETCH + 2 * words * blocks.width, similarity)
    bound_batches(meet.sparkSession)

    def pairs(row: dict[str, np.ndarray], same: bool) -> tuple[np.ndarray, np.ndarray]:
        bits = np.bitwise_count(row["xsketch"][:, None] ^ row["ysketch"])
        close = (bits <= near) & (row["xroot"][:, None] != row["yroot"])
        i, j = np.nonzero(np.triu(close) if same else close)
        if words:
            xs, ys, kept = row["xbits"].reshape(-1, words), row["ybits"].reshape(-1, words), np.empty(len(i), dtype=bool)
            for at in range(0, len(i), 65_536):
                a, b = i[at : at + 65_536], j[at : at + 65_536]
                kept[at : at + 65_536] = np.bitwise_count(xs[a] ^ ys[b]).sum(1, dtype=np.int64) + bits[a, b] <= reach
            i, j = i[kept], j[kept]
        return i, j

    def out(row: dict[str, np.ndarray], xno: int, yno: int) -> list[np.ndarray]:
        i, j = pairs(row, xno == yno)
        if pairs_of:
            a, b = row["xnode"][i], row["ynode"][j]
            return [np.minimum(a, b), np.maximum(a, b)]
        i, j = (np.union1d(i, j), i[:0]) if xno == yno else (np.unique(i), np.unique(j))
        node, root = (np.concatenate([row["x" + n][i], row["y" + n][j]]) for n in ("node", "root"))
        return [np.full(len(node), xno), np.full(len(node), yno), node, root]

    names = ["a", "b"] if pairs_of else ["xno", "yno", "node", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at] for n in batch.schema.names}
                no = row["xno"].as_py(), row["yno"].as_py()
                lists = {n: v.values.to_numpy().view(np.uint64) if n[1:] in ("sketch", "bits") else v.values.to_numpy() for n, v in row.items() if n[1:] != "no"}
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out(lists, *no)], names)

    return meet.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def links_of(sets: list[np.ndarray], root: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places of similar sets of different components, as few as join what all such pairs would."""
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    shingle, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, wide = np.repeat(np.arange(len(sets)), size), often > 1
    place = np.cumsum(wide) - 1  # of the shingles of several sets
    kept = wide[column]
    owner, column = owner[kept], place[column[kept]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.int64)
    for low in range(0, int(wide.sum()), 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        has = np.zeros((len(sets), 4096), dtype=np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        common += (has @ has.T).astype(np.int64)
    alike = (common >= similarity * (size[:, None] + size - common)) & (root[:, None] != root)

    names, at = np.unique(root, return_inverse=True)
    up = list(range(len(names)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    links = []
    for i, j in zip(*(p.tolist() for p in np.nonzero(np.triu(alike))), strict=True):
        x, y = top(at[i]), top(at[j])
        if x != y:
            up[x] = y
            links.append((i, j))
            if len(links) == len(names) - 1:
                break
    return links


def linked(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between the members (xno, yno, node, root) of each meeting whose sets (node, shingles) are similar.

    A meeting is one group of at most two chunks.
    """

    def run(meeting: pa.Table) -> pa.Table:
        meeting = meeting.combine_chunks()
        node, root = (meeting.column(n).to_numpy() for n in ("node", "root"))
        shingles = meeting.column("shingles")
        flat = pc.list_flatten(shingles).to_numpy()
        ends = np.cumsum(pc.list_value_length(shingles).to_numpy())
        ij = links_of(np.split(flat, ends[:-1]), root, similarity)
        a, b = (node[[p[e] for p in ij]] if ij else node[:0] for e in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = members.join(sets, "node").select("xno", "yno", "node", "root", "shingles")
    return rows.groupBy("xno", "yno").applyInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, shingles) are similar enough.

    The set of ``b`` travels to that of ``a``, which may be the smallest node of many pairs: that
    join splits where it is skewed.
    """
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    every = F.size("sa") + F.size("sb") - common
    return both.filter(common >= F.lit(similarity) * every).select("a", "b")


def shingle_sets(docs: DataFrame, prints: DataFrame, wanted: DataFrame, id_col: str, text_col: str, few: bool = False) -> DataFrame:
    """(node, shingles) of every node of ``wanted``; if they may be ``few``, texts of others stay where they are."""
    found = prints.join(wanted.select("node").distinct(), "node").groupBy("node").agg(F.min(F.struct(*_row(prints, id_col, F.col("text_key")))).alias("row"))
    names = [f"_{n}" for n in ROW]
    found = found.select("node", *[F.col(f"row.{r}").alias(n) for r, n in zip(ROW, names, strict=True)])
    if few:
        found = cut(found)
        found = F.broadcast(found) if found.count() <= LISTED else found
    texts = docs.select(*_row(docs, id_col, text_key(text_col), names), F.col(text_col).alias("text")).join(found, names)
    texts = texts.dropDuplicates(names)  # by the keys of the join: no exchange more

    def start():
        return lambda ids, texts: (ids, [shingle_set(t).view(np.int64) for t in texts])

    return cut(map_batches(texts.select("node", "text"), "node bigint, shingles array<bigint>", start))


def roots(docs: DataFrame, prints: DataFrame, blocks: Blocks, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(node, root) of every node that has a near copy."""
    nodes = cut(prints.groupBy("node").agg(F.min(F.struct("sketch", "parts")).alias("p")).select("node", "p.*"))
    groups = cut(close_groups(nodes, blocks.near))
    pairs = cut(nearest(close_pairs(nodes, groups, blocks.near)))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    links = cut(verified(pairs, shingle_sets(docs, prints, wanted, id_col, text_col), similarity))
    found = cut(components(links))
    dealt = large_blocks(nodes, found, blocks).union(small_blocks(nodes, groups, found, blocks))
    members = cut(_close_members(meetings(dealt), blocks, similarity, pairs_of=False))
    if members.isEmpty():
        return found
    more = linked(members, shingle_sets(docs, prints, members, id_col, text_col, few=True), similarity)
    return components(cut(more).union(found.select(F.col("root"), F.col("node"))))


def drop_near_copies(
    docs: DataFrame, similarity: float = 0.8, recall: float = 0.95, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id, with all its columns.

    Groups are connected by links between near copies.  A null id never is the smallest one; of a
    group without ids one row stays.  Rows that repeat both an id and a text count as one.
    Fingerprints are made once; rows are found again by their id and a hash of their text.
    """
    blocks = plan_blocks(docs.count(), similarity, recall)
    prints = cut(fingerprints(docs, blocks, id_col, text_col))
    found = cut(roots(docs, prints, blocks, similarity, id_col, text_col))
    placed = prints.select(id_col, "text_key", "node").join(found, "node", "left")
    row = F.struct(*_row(docs, id_col, F.col("text_key")))
    keep = placed.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(row).alias("k"))
    taken, mark = {c.lower() for c in docs.columns}, "_"
    while any(mark + n in taken for n in ROW):
        mark += "_"
    names = [mark + n for n in ROW]
    keyed = docs.select("*", *_row(docs, id_col, text_key(text_col), names))
    keep = keep.select(*[F.col(f"k.{r}").alias(n) for r, n in zip(ROW, names, strict=True)])
    return keyed.join(keep, names, "left_semi").dropDuplicates(names).drop(*names)


ROW = ("no_id", "id", "key")


def _row(docs: DataFrame, id_col: str, key: Column, names: list[str] | tuple[str, ...] = ROW) -> list[Column]:
    """What tells a row: whether it has an id, the id, a hash of the text; rows without an id come last."""
    zero = F.lit(0).cast(docs.schema[id_col].dataType)
    values = F.col(id_col).isNull(), F.coalesce(F.col(id_col), zero), key
    return [v.alias(n) for v, n in zip(values, names, strict=True)]

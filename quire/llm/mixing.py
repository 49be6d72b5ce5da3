"""Mixing sources to target weights, in DataFrame expressions only.

The words of each source are packed into blocks of a fixed length, documents laid end to end.
A source's target fixes how many slots of the mix it fills; each slot falls into an output
shard at random, so the counts of a source over the shards are a multinomial draw with a given
total.  Slot k of a source reads the block at index ``permute(k mod blocks)``, a pseudorandom
permutation of the block indices, so no block is read again before all others were, and slots
meet their blocks in a join on the index.  The last slot is cut to make the total exact.

Targets: sources by code point, null last, get the weights in turn and share ``share`` of all
words; no target exceeds ``most`` times its source, and the excess is shared again by weight.
In order of size by weight, the level ``(total - capped) / remaining weight`` grows as long as
sources are capped and falls afterwards, so its maximum is the level at which the sharing ends.

Null and empty texts have size 0 and give nothing.  Rows that repeat are mixed each by itself;
null ids and null sources are allowed, a null source is a source of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, WORD_AND_GAP, cut

_PRIME = 2147483647
_ROUNDS = 12


@dataclass(frozen=True)
class Mix:
    """Parameters: weights in turn, the share of all words, the cap, and sizes of the parts.

    ``buckets`` is the number of parts a source is cut into for its running word count,
    ``chunk`` the number of slots that one row is unfolded into.
    """

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    block_words: int = 256
    shard_words: int = 1 << 20
    buckets: int = 1024
    chunk: int = 1 << 14
    seed: int = 1


def size_of(text: Column) -> Column:
    """The number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _key(round_: Column, rank: Column, step: int, mix: Mix) -> Column:
    return ((rank + 1) * 2654435 + (round_ + 1) * step + mix.seed) % _PRIME


def permute(x: Column, n: Column, rank: Column, mix: Mix, inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0..n-1, another one for each ``rank``.

    Each round pairs x with ``key - x`` modulo n and swaps the pair or not, by a bit that both
    of the pair give.  A round is its own inverse, so the inverse takes the rounds backwards.
    """
    rounds = [F.lit(r).cast("bigint") for r in range(_ROUNDS)]

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(_key(r, rank, 40503211, mix) - x, n)
        mixed = (F.greatest(x, partner) % _PRIME * _key(r, rank, 69069069, mix) + 12345) % _PRIME
        return F.when(F.floor(mixed * mixed % _PRIME / 65536) % 2 == 1, partner).otherwise(x)

    return F.aggregate(F.array(*(reversed(rounds) if inverse else rounds)), x, swap)


def sources(bucket_sizes: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: its rank, size, target, blocks and slots, from its buckets' sizes.

    The windows run over one row per source.
    """
    per = bucket_sizes.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    per = per.withColumn("rank", (F.row_number().over(by_name) - 1).cast("bigint"))
    weights = F.array(*[F.lit(w) for w in mix.weights])
    per = per.withColumn("weight", F.element_at(weights, (F.col("rank") % len(mix.weights) + 1).cast("int")))
    cap = F.col("source_size") * mix.most
    in_turn = Window.orderBy(cap / F.col("weight"), "rank")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum(cap).over(in_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(in_turn.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("total", F.sum("source_size").over(everything) * F.lit(mix.share))
    per = per.withColumn("level", (F.col("total") - capped) / rest)
    level = F.max("level").over(everything)
    per = per.withColumn("target", F.least(cap.cast("double"), level * F.col("weight")))
    per = per.withColumn("shards", F.greatest(F.ceil(F.col("total") / mix.shard_words), F.lit(1)))
    per = per.withColumn("want", F.floor(F.col("target") + 0.5).cast("bigint"))
    return per.withColumn("blocks", F.ceil(F.col("source_size") / mix.block_words)).drop("total", "level", "weight")


def place(sized: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """The source table, and the rows of (id, source, size, nth) with the place of their first word.

    Words are counted along each of the buckets of a source, and the buckets' totals along the
    source, so no task sees more than one bucket or one row per bucket.  Both are written once.
    """
    spread = F.pmod(F.coalesce("id", F.lit(0)) + F.col("size"), F.lit(mix.buckets))
    rows = cut(sized.withColumn("bucket", spread))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut(totals.withColumn("before", F.coalesce(F.sum("bucket_size").over(along), F.lit(0))))
    table = cut(sources(totals, mix))
    totals = totals.alias("t").join(table.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source")))
    totals = totals.select("t.source", "bucket", "before", "rank", "source_size", "target")
    within = Window.partitionBy("source", "bucket").orderBy("id", "size", "nth")
    first = F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("first", first).alias("r")
    same = F.col("r.source").eqNullSafe(F.col("t.source")) & (F.col("r.bucket") == F.col("t.bucket"))
    placed = rows.join(totals.alias("t"), same).select(
        "id", "r.source", "size", "nth", "rank", "source_size", "target", (F.col("first") + F.col("before")).alias("first")
    )
    return table, cut(placed)


def slots(table: DataFrame, mix: Mix) -> DataFrame:
    """(rank, slot, shard, copy, block, words): what each slot of the mix reads.

    Sources are unfolded in chunks that are dealt over the cluster first.
    """
    n, words = F.col("blocks"), mix.block_words
    last = F.col("source_size") - (n - 1) * words
    rows = table.filter("want > 0").withColumn("last", last)
    rows = rows.withColumn("at", permute(n - 1, n, F.col("rank"), mix, inverse=True))
    upto = F.least(F.ceil(F.col("want") / words) + mix.most, n * mix.most)
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((upto - 1) / mix.chunk))))
    rows = rows.withColumn("upto", F.least(upto, (F.col("chunk") + 1) * mix.chunk))
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "rank", "chunk")
    rows = rows.withColumn("slot", F.explode(F.sequence(F.col("chunk") * mix.chunk, F.col("upto") - 1)))
    # Words in all slots before this one: the last block of a source is shorter than the others.
    short = F.floor((F.col("slot") + n - 1 - F.col("at")) / n)
    before = F.col("slot") * words - short * (F.lit(words) - F.col("last"))
    own = F.when(F.col("slot") % n == F.col("at"), F.col("last")).otherwise(F.lit(words))
    rows = rows.withColumn("words", F.least(own, F.col("want") - before)).filter("words > 0")
    return rows.select(
        "rank",
        "slot",
        F.pmod(F.xxhash64("rank", "slot", F.lit(mix.seed)), F.col("shards")).alias("shard"),
        F.floor(F.col("slot") / n).cast("int").alias("copy"),
        permute(F.col("slot") % n, n, F.col("rank"), mix).alias("block"),
        "words",
    )


def shard_counts(slots: DataFrame) -> DataFrame:
    """The draw: how many slots each source fills in each output shard."""
    return slots.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("slots"), F.sum("words").alias("words"))


def spans(placed: DataFrame, slots: DataFrame, mix: Mix, how: str) -> DataFrame:
    """The placed rows per block they reach into, with the words [low, high) that slots read."""
    words = mix.block_words
    end = F.col("first") + F.col("size")
    blocks = F.sequence(F.floor(F.col("first") / words), F.floor((end - 1) / words))
    parts = placed.filter("size > 0").withColumn("block", F.explode(blocks))
    start = F.col("block") * words
    parts = parts.withColumns({"a": F.greatest(F.col("first"), start), "b": F.least(end, start + words)})
    # Spark can't foresee how many slots a source unfolds to, so it must not choose a broadcast.
    read = parts.join(slots.hint("merge"), ["rank", "block"], how)
    low, high = F.col("a"), F.least(F.col("b"), start + F.coalesce("words", F.lit(0)))
    return read.withColumns({"low": low - F.col("first"), "high": F.greatest(low, high) - F.col("first")})


def mix_counts(
    docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Per document ``size``, ``source_size``, ``target`` and ``taken``, its words in the mix."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"))
    table, placed = place(sized.withColumn("nth", F.lit(0).cast("bigint")), mix)
    read = spans(placed, slots(table, mix), mix, "left")
    row = ["id", "size", "source_size", "target"]
    taken = read.groupBy("rank", "first", *row).agg(F.coalesce(F.sum(F.col("high") - F.col("low")), F.lit(0)).alias("taken"))
    empty = placed.filter("size = 0").select(*row, F.lit(0).cast("bigint").alias("taken"))
    return taken.select(*row, "taken").union(empty).withColumnRenamed("id", id_col)


def mix_documents(
    docs: DataFrame,
    mix: Mix = Mix(),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    chars_col: str | None = "n_chars",
) -> DataFrame:
    """The mixed documents with all their columns: the words taken, in their order.

    A document that the mix reads twice gives up to two rows, one for each time.  A document
    that is read whole keeps its text as it is; else the text is what the slots read, with the
    white space that follows each word.  ``chars_col``, if the table has it, is counted anew.
    """
    names = ["_no_id", "_id", "_no_source", "_source", "_size", "_nth"]
    i, s = F.col(id_col), F.col(source_col)
    rows = docs.select(
        "*",
        i.isNull().alias("_no_id"),
        F.coalesce(i, F.lit(0)).alias("_id"),
        s.isNull().alias("_no_source"),
        F.coalesce(s, F.lit("")).alias("_source"),
        size_of(F.col(text_col)).alias("_size"),
        F.xxhash64(text_col).alias("_hash"),
    )
    same = Window.partitionBy(*names[:5]).orderBy("_hash")
    rows = rows.withColumn("_nth", F.row_number().over(same).cast("bigint"))
    table, placed = place(rows.select(i.alias("id"), s.alias("source"), F.col("_size").alias("size"), F.col("_nth").alias("nth")), mix)
    read = spans(placed, slots(table, mix), mix, "inner").filter("high > low")
    key = [
        F.col("id").isNull().alias("_no_id"),
        F.coalesce("id", F.lit(0)).alias("_id"),
        F.col("source").isNull().alias("_no_source"),
        F.coalesce("source", F.lit("")).alias("_source"),
        F.col("size").alias("_size"),
        F.col("nth").alias("_nth"),
    ]
    # A document's spans are at most its own blocks.
    parts = read.groupBy(*key, F.col("copy").alias("_copy")).agg(
        F.sort_array(F.collect_list(F.struct("low", "high"))).alias("_parts"), F.sum(F.col("high") - F.col("low")).alias("_words")
    )
    mixed = rows.join(parts, names)
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(WORD_AND_GAP), F.lit(0))

    def cut_out(words: Column) -> Column:
        return F.array_join(F.flatten(F.transform("_parts", lambda p: F.slice(words, p["low"].cast("int") + 1, (p["high"] - p["low"]).cast("int")))), "")

    text = F.when(F.col("_words") == F.col("_size"), F.col(text_col)).otherwise(F.get(F.transform(F.array(pieces), cut_out), F.lit(0)))
    mixed = mixed.withColumn(text_col, text)
    if chars_col in docs.columns:
        mixed = mixed.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return mixed.select(*docs.columns)


def sql(mix: Mix = Mix()) -> str:
    """:func:`mix_counts` over the table ``documents``, for a database with recursive-free SQL."""
    words, n = mix.block_words, len(mix.weights)

    def key(r: int, step: int) -> str:
        return f"(((rank + 1) * 2654435 + {(r + 1) * step} + {mix.seed}) % {_PRIME})"

    rounds, previous = [], "p0"
    for r in range(_ROUNDS):
        rounds.append(f"""
q{r} as (select *, (({key(r, 40503211)} - x) % blocks + blocks) % blocks as partner from {previous}),
h{r} as (select *, (greatest(x, partner) % {_PRIME} * {key(r, 69069069)} + 12345) % {_PRIME} as m from q{r}),
p{r + 1} as (select rank, blocks, p, case when (m * m % {_PRIME}) // 65536 % 2 = 1 then partner else x end as x from h{r}),""")
        previous = f"p{r + 1}"
    return f"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size
  from documents
), s0 as (
  select source, cast(sum(size) as bigint) as source_size,
         row_number() over (order by source nulls last) - 1 as rank
  from sized group by source
), s1 as (select *, {list(mix.weights)}[1 + rank % {n}] as weight from s0),
s2 as (
  select *, cast(sum(source_size) over () as bigint) * {mix.share} as total,
         coalesce(cast(sum({mix.most} * source_size) over (
           order by {mix.most} * source_size / cast(weight as double), rank
           rows between unbounded preceding and 1 preceding) as bigint), 0) as capped,
         cast(sum(weight) over (
           order by {mix.most} * source_size / cast(weight as double), rank
           rows between current row and unbounded following) as bigint) as rest
  from s1
), s3 as (select *, max((cast(total as double) - capped) / rest) over () as level from s2),
s4 as (
  select *, least(cast({mix.most} * source_size as double), level * weight) as target,
         cast(ceil(source_size / {words}.0) as bigint) as blocks
  from s3
), s as (select *, cast(floor(target + 0.5) as bigint) as want, source_size - (blocks - 1) * {words} as last from s4),
placed as (
  select doc_id, size, rank, source_size, target,
         cast(coalesce(sum(size) over (
           partition by sized.source
           order by ((coalesce(doc_id, 0) + size) % {mix.buckets} + {mix.buckets}) % {mix.buckets}, doc_id nulls first, size
           rows between unbounded preceding and 1 preceding), 0) as bigint) as first
  from sized join s on sized.source is not distinct from s.source
), p0 as (select rank, blocks, p, p as x from (select rank, blocks, unnest(range(0, blocks)) as p from s where want > 0)),
{"".join(rounds)}
slot as (
  select rank, blocks, p, x as block, unnest(range(0, {mix.most})) * blocks + p as k from {previous}
), slots as (
  select rank, block, least(case when block = s.blocks - 1 then last else {words} end,
           want - (k * {words} - ((k + s.blocks - 1 - pos) // s.blocks) * ({words} - last))) as words
  from slot join s using (rank)
  join (select rank, p as pos from slot where block = blocks - 1 group by rank, p) using (rank)
), spans as (
  select rank, first, size, unnest(range(first // {words}, (first + size - 1) // {words} + 1)) as block
  from placed where size > 0
), taken as (
  select rank, first, sum(greatest(0, least(first + size, block * {words} + words) - greatest(first, block * {words}))) as taken
  from spans join slots using (rank, block) where words > 0 group by rank, first
)
select doc_id, size, source_size, target, cast(coalesce(taken, 0) as bigint) as taken
from placed left join taken on placed.rank = taken.rank and placed.first = taken.first and size > 0
"""

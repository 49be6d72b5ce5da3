"""Importance resampling: draw the documents that look most like a target text collection.

Texts are lower-cased in A-Z only and split by an untrained pre-tokeniser, which returns words
with their offsets.  A window over 1 to ``runs`` neighbouring offset pairs is a feature, its words
joined by one space, and the CRC of its bytes chooses a bucket.  Two histograms, of the documents
and of the target, give every bucket a gain: the log ratio of its smoothed shares.  A document's
weight is the floored mean of the gains of its features; with Gumbel noise from a hash of its id
the highest scores are a sample without replacement that follows the weights.

Histograms are added up in the tasks before they meet, and hold ``buckets`` rows at most; only
they and the gains reach the driver.  The drawn documents are ranked by ranges of their scores,
so no task holds all of them.

Null and empty texts have no features and weight 0.  A null id counts as empty text in the noise
and comes last among equal scores.  Rows repeat as given; each is drawn for itself.  Without
documents of enough words none is drawn.  An empty target has no share of any bucket.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from quire.llm.common import cut, map_batches, numbered

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(_UPPER, _UPPER.lower())


class Features:
    """Buckets of the features of a text; ``part`` characters of a long text are split at a time."""

    def __init__(self, runs: int = 1, buckets: int = 10_000, part: int = 1 << 18):
        self.runs, self.buckets, self.part = runs, buckets, part
        self.split = pre_tokenizers.Split(Regex(WORDS), "removed", invert=True)

    def _parts(self, text: str):
        """The text in parts that end at a space, and the place of each."""
        at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= self.part else text.find(" ", at + self.part)
            end = len(text) if end < 0 else end
            yield at, text[at:end]
            at = end

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Begin and end of each word."""
        found = []
        for at, part in self._parts(text):
            found += [(at + a, at + b) for _, (a, b) in self.split.pre_tokenize_str(part)]
        return found

    def __call__(self, text: str | None) -> tuple[int, np.ndarray]:
        """The number of words, and the bucket of each feature."""
        text = (text or "").translate(_LOWER)
        words = [text[a:b].encode("utf-8", "replace") for a, b in self.offsets(text)]
        last = [zlib.crc32(w) for w in words]
        found = list(last)
        for n in range(1, self.runs):  # windows of n + 1 offset pairs, from those of n
            last = [zlib.crc32(b" " + w, c) for c, w in zip(last, words[n:])]
            found += last
        return len(words), np.array(found, dtype=np.int64) % self.buckets


def features(docs: DataFrame, runs: int, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_features, buckets) of every document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def start():
        of = Features(runs, buckets)

        def step(ids, texts):
            found = [of(t) for t in texts]
            return ids, [n for n, _ in found], [len(b) for _, b in found], [b.astype(kind).tobytes() for _, b in found]

        return step

    schema = f"`{id_col}` {id_type}, n_words bigint, n_features bigint, buckets binary"
    return map_batches(docs.select(F.col(id_col), F.col(text_col)), schema, start)


def histogram(found: DataFrame, buckets: int) -> np.ndarray:
    """How many features lie in each bucket; each task adds up its own first."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    parts = found.select("buckets").mapInArrow(run, "bucket bigint, n bigint")
    out = np.zeros(buckets, dtype=np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """Per bucket the floored, scaled log ratio of the target's share to the source's, each plus one."""
    all_source, all_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(scale * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target))) for s, t in pairs], dtype=np.int64)


def noise(doc_id, seed: int, scale: int = 1000) -> int:
    """Floored, scaled Gumbel noise from the first 32 bits of a digest of seed and id."""
    key = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-scale * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: int = 10,
    runs: int = 1,
    buckets: int = 10_000,
    least_words: int = 20,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    step: int = 100,
) -> DataFrame:
    """Every document's ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn).

    Of the documents with ``least_words`` words, ``share`` percent are drawn.  Scores are counted
    in steps of ``step``, and only documents from the step of the last one drawn are ranked.
    """
    found = cut(features(docs, runs, buckets, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()))
    ideal = features(target.select(F.lit(None).cast("bigint").alias("id"), F.col(target_col).alias("text")), runs, buckets, "id", "text")
    gain = gains(histogram(found, buckets), histogram(ideal, buckets))
    kind = "<u2" if buckets <= 1 << 16 else "<u4"
    id_type = docs.schema[id_col].dataType.simpleString()

    def start():
        def weigh(ids, words, numbers, rows, all_buckets):
            weights = [int(gain[np.frombuffer(b, kind)].sum()) // n if n else 0 for n, b in zip(numbers, all_buckets, strict=True)]
            scores = [w + noise(i, seed) for i, w in zip(ids, weights, strict=True)]
            return ids, words, numbers, weights, scores, rows

        return weigh

    schema = f"`{id_col}` {id_type}, n_words bigint, n_features bigint, weight bigint, score bigint, _row bigint"
    scored = cut(map_batches(found.select(id_col, "n_words", "n_features", "_row", "buckets"), schema, start))
    eligible = F.col("n_words") >= least_words
    at = F.floor(F.col("score") / step).alias("at")
    steps = {r.at: r.n for r in scored.filter(eligible).groupBy(at).agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = share * sum(steps.values()) // 100
    lowest, above = max(steps, default=0) + 1, 0
    while above < draw:
        lowest -= 1
        above += steps.get(lowest, 0)
    high = eligible & (F.col("score") >= step * lowest)
    names = [id_col, "n_features", "weight", "score"]
    order = [F.desc("score"), F.asc_nulls_last(id_col), F.asc("_row")]
    ranked = numbered(scored.filter(high).select(*names, "_row"), order, "rank")
    ranked = ranked.select(*names, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return ranked.union(scored.filter(~high).select(*names, F.lit(None).cast("bigint").alias("rank")))


def drawn(docs: DataFrame, resampled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that were drawn, with all their columns; ids of documents are distinct."""
    ids = resampled.filter("rank is not null").select(id_col)
    return docs.join(ids, docs[id_col].eqNullSafe(ids[id_col]), "left_semi")


def sql(buckets: int = 10_000, share: int = 10, least_words: int = 20, seed: int = 2024) -> str:
    """The result over ``documents`` and ``benchmark`` as DuckDB SQL, for runs of one word."""
    hexes = "list_transform(string_split({x}, ''), lambda d: cast(instr('0123456789abcdef', d) - 1 as bigint))"
    digits = hexes.format(x="lower(hex(encode(word)))")
    pairs = "list_transform(range(1, len(d), 2), lambda i: 16 * d[i] + d[i + 1])"
    number = f"list_reduce({hexes.format(x=f'''substr(sha256('{seed}:' || coalesce(cast(doc_id as varchar), '')), 1, 8)''')}, lambda a, d: 16 * a + d)"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{WORDS}')"
    return f"""
with codes as (
  select list(c order by n) as code from (
    select n, list_reduce([n] || range(8), lambda c, i: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as c
    from range(256) r(n))
), docs as (select row_number() over () as no, doc_id, {words} as words from documents
), wanted as (select unnest({words}) as word from benchmark
), used as (select no, unnest(words) as word from docs
), known as (
  select word, {digits} as d from (select word from used union select word from wanted)
), buckets as (
  select word, xor(4294967295, list_reduce([4294967295] || {pairs},
    lambda c, b: xor(c >> 8, code[(xor(c, b) & 255) + 1]))) % {buckets} as bucket
  from known, codes
), s as (select bucket, count(*) as s from used join buckets using (word) group by bucket
), t as (select bucket, count(*) as t from wanted join buckets using (word) group by bucket
), sums as (select (select coalesce(sum(s), 0) from s) as all_s, (select coalesce(sum(t), 0) from t) as all_t
), gain as (
  select bucket, cast(floor(1000 * ln(cast(coalesce(t, 0) + 1 as double) * cast(all_s + {buckets} as double)
    / (cast(coalesce(s, 0) + 1 as double) * cast(all_t + {buckets} as double)))) as bigint) as gain
  from s full join t using (bucket) cross join sums
), means as (
  select no, cast(floor(cast(sum(gain) as double) / count(*)) as bigint) as weight
  from used join buckets using (word) join gain using (bucket) group by no
), scored as (
  select no, doc_id, len(words) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln(({number} + 0.5) / 4294967296))) as bigint) as score
  from docs left join means using (no)
), eligible as (
  select no, row_number() over (order by score desc, doc_id nulls last, no) as rank, count(*) over () as n
  from scored where n_features >= {least_words}
)
select doc_id, cast(n_features as bigint) as n_features, weight, score,
  case when rank <= {share} * n // 100 then cast(rank as bigint) end as rank
from scored left join eligible using (no)
"""

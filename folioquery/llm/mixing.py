"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

Sizes are words per document. Each source gets a token target from its weight; targets stop at
`max_epochs` times the source's size and the excess is shared again by weight (water filling in
closed form). The total is cut into equal-token blocks, which the divisor method of Sainte-Laguë
deals to sources, and each source's blocks to its shards by shard size. Inside a shard documents
stand in a seeded order and the first `quota` blocks of that order, going round again when it ends,
are taken; so a document is taken between 0 and `max_epochs` times its size.

Rows: a null text has size 0; a null source is a source of its own, last in order; tied or repeated
rows each count and are told apart only by their own values; empty tables give no rows. Extra
columns of the input, whatever their names, are not read by `mix_targets`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stored, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: About how many blocks the whole mix has, and the most tokens that a block may have.
BLOCKS, BLOCK_TOKENS = 1_000_000, 256
#: Tokens a shard should have.
SHARD_TOKENS = 2_000_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(votes: DataFrame, group: list[str], vote: str, seats: str, order: list[str]) -> DataFrame:
    """Adds `quota`: `seats` (a column, constant in each group) dealt to the rows of the group by the
    highest quotients vote / (2 j - 1), ties to the first in `order`.

    With total vote V and k rows, the divisor V / (seats - k/2) deals too few or just enough seats
    and V / (seats + k/2) enough or too many. Rows keep what the former gives, and only the O(k)
    seats between the two are ranked, so the work doesn't depend on the number of seats.
    """
    g = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    total, k, n = F.sum(vote).over(g), F.count(F.lit(1)).over(g), F.col(seats)
    v = F.col(vote).cast("double")
    shares = votes.withColumn("_t", total.cast("double")).withColumn("_k", k)
    low = F.floor(v * (n - F.col("_k") / 2.0) / F.col("_t") + 0.5) - 1
    high = F.floor(v * (n + F.col("_k") / 2.0) / F.col("_t") + 0.5) + 1
    shares = shares.withColumn("_low", F.when(F.col("_t") > 0, F.greatest(F.lit(0), low)).otherwise(F.lit(0)).cast("long"))
    shares = shares.withColumn("_high", F.when(F.col("_t") > 0, F.greatest(F.lit(0), high)).otherwise(F.lit(0)).cast("long"))
    shares = shares.withColumn("_rest", n - F.sum("_low").over(g))
    keys = [*group, *order]
    seat = shares.where((v > 0) & (F.col("_high") > F.col("_low"))).select(*keys, v.alias("_v"), "_rest", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_j"))
    by = [(F.col("_v") / (2 * F.col("_j") - 1)).desc(), *[F.col(c).asc_nulls_last() for c in order], F.col("_j")]
    ranked = seat.withColumn("_rank", F.row_number().over((W.partitionBy(*group) if group else W.partitionBy(F.lit(0))).orderBy(*by)))
    won = ranked.where(F.col("_rank") <= F.col("_rest")).groupBy(*[F.col(c).alias(f"_{c}_won") for c in keys]).agg(F.count(F.lit(1)).alias("_won"))
    joined = shares.join(won, [F.col(c).eqNullSafe(F.col(f"_{c}_won")) for c in keys], "left")
    return joined.select(*votes.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs, total, target): one row a source. The level L at which
    sum(min(max_epochs * size, L * weight)) is the total is found by sorting sources by the level at
    which they are full, so no iteration is needed."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    one = W.partitionBy(F.lit(0))
    at = F.pmod(F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    per = per.withColumn("total", F.sum("source_size").over(one)).withColumn("full_at", F.col("cap") / F.col("weight"))
    before = one.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    after = one.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(0, W.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # rises while the sources before it fill up, falls after; the true level is the highest
    per = per.withColumn("_level", level).withColumn("_level", F.max("_level").over(one))
    return per.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "n_docs", "total", "target")


def _digest(seed: str, keep: list[str]) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), *[F.concat(F.lit("row/"), F.col(k).cast("string")) for k in keep], F.lit(""))))


def _shard(key: str, shards: str) -> Column:
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), F.col(shards))


def mix_targets(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, blocks: int = BLOCKS, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: str = SEED, row: str | None = None) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken; and `row`,
    a column of distinct keys, if given, by which rows of null or equal ids are told apart."""
    keep = [row] if row else []
    return _dealt(docs, weights, max_epochs, blocks, block_tokens, shard_tokens, seed, keep).select("doc_id", *keep, "source", "size", "source_size", "target", "taken")


def whole_copies(docs: DataFrame, row: str, seed: str = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes its words, to the nearest number of copies; rows without
    words aren't taken. In a shard the first rows in order get one copy more than the others, so a row a shard (of
    about SHARD_TOKENS words) says where they end; these are broadcast, and texts aren't shuffled."""
    rows = _dealt(docs, WEIGHTS, MAX_EPOCHS, BLOCKS, BLOCK_TOKENS, SHARD_TOKENS, seed, [row]).where("size > 0")
    more = F.floor(F.col("taken") / F.col("size") + 0.5) > F.col("_full")
    at = F.struct(F.col("_key").alias("key"), F.struct("doc_id", "size", F.col(row).alias("row")).alias("rest"))
    cuts = rows.groupBy(F.col("_source").alias("_s"), F.col("shard").alias("_sh")).agg(F.first("shards").alias("_shards"), F.first("_full").cast("int").alias("_full"), F.max(F.when(more, at)).alias("_last"))
    cuts = stored(cuts, "mix-cuts")
    shards = cuts.groupBy(F.col("_s").alias("_source")).agg(F.first("_shards").alias("_shards"))
    found = docs.where(F.col("text").rlike(WORD)).withColumn("_key", _digest(seed, [row]))
    found = found.join(F.broadcast(shards), F.col("source").eqNullSafe(F.col("_source"))).withColumn("_shard", _shard("_key", "_shards"))
    found = found.join(F.broadcast(cuts.drop("_shards")), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_sh")))
    # keys are equal where ids are; only there words are counted again
    rest = F.struct("doc_id", word_count(F.col("text")).alias("size"), F.col(row).alias("row"))
    first = (F.col("_key") < F.col("_last.key")) | ((F.col("_key") == F.col("_last.key")) & (rest <= F.col("_last.rest")))
    copies = F.col("_full") + F.when(first, 1).otherwise(0)
    found = found.withColumn("_copies", copies).where("_copies > 0")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)


def _dealt(docs: DataFrame, weights, max_epochs: int, blocks: int, block_tokens: int, shard_tokens: int, seed: str, keep: list[str]) -> DataFrame:
    """The columns of mix_targets, and _source, shard, shards, _key and _full: how often all of the shard is taken."""
    sizes = stored(docs.select("doc_id", *keep, "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sizes, weights, max_epochs)
    block = F.greatest(F.lit(1), F.least(F.lit(block_tokens), F.floor(F.col("total") / blocks))).cast("long")
    targets = targets.withColumn("block", block).withColumn("n_blocks", F.round(F.col("total") / F.col("block")).cast("long"))
    quotas = sainte_lague(targets, [], "target", "n_blocks", ["source"]).withColumnRenamed("quota", "source_quota")
    quotas = stored(quotas.withColumn("shards", F.ceil(F.col("source_size") / shard_tokens).cast("long")).withColumn("shards", F.greatest("shards", F.lit(1))), "mix-quotas")
    q = quotas.select(F.col("source").alias("_source"), "source_size", "target", "block", "source_quota", "shards")
    # one row a source: the build side has as many rows as there are sources, and AQE chooses the join
    rows = sizes.join(q, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("_key", _digest(seed, keep))
    rows = rows.withColumn("shard", _shard("_key", "shards"))
    shards = rows.groupBy("_source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"), F.first("block").alias("block"))
    dealt = sainte_lague(shards, ["_source"], "shard_size", "source_quota", ["shard"])
    dealt = dealt.select(F.col("_source").alias("_s"), F.col("shard").alias("_sh"), "shard_size", F.least(F.col("quota") * F.col("block"), F.col("shard_size") * max_epochs).alias("_take"))
    rows = rows.join(dealt, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_sh")), "left")
    order = W.partitionBy("_source", "shard").orderBy("_key", F.col("doc_id"), "size", *keep).rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum("size").over(order)
    rows = rows.withColumn("_end", end).withColumn("_full", F.when(F.col("shard_size") > 0, F.floor(F.col("_take") / F.col("shard_size"))).otherwise(F.lit(0)))
    rest = F.col("_take") - F.col("_full") * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("_end") - F.col("size"))))
    return rows.withColumn("taken", (F.col("size") * F.col("_full") + part).cast("long"))


def op8_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_targets(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = f"""
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), p AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight,
         sum(sum(size)) OVER ()::BIGINT AS total
  FROM s GROUP BY source
), f AS (
  SELECT *, source_size::DOUBLE * {MAX_EPOCHS} AS cap, source_size::DOUBLE * {MAX_EPOCHS} / weight AS full_at FROM p
), l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM f
), t AS (
  SELECT source, source_size, total, greatest(1, least({BLOCK_TOKENS}, total // {BLOCKS})) AS block,
         least(cap, coalesce(max(lev) OVER (), 0) * weight) AS target FROM l
), n AS (
  SELECT *, round(total / block)::BIGINT AS n_blocks, sum(target) OVER () AS votes, count(*) OVER () AS k FROM t
), b AS (
  SELECT *, greatest(0, floor(target * (n_blocks - k / 2.0::DOUBLE) / votes + 0.5) - 1)::BIGINT AS low,
            greatest(0, floor(target * (n_blocks + k / 2.0::DOUBLE) / votes + 0.5) + 1)::BIGINT AS high FROM n
), e AS (
  SELECT source, target, n_blocks - (SELECT sum(low) FROM b) AS rest, unnest(range(low + 1, high + 1)) AS j FROM b WHERE target > 0
), r AS (
  SELECT *, row_number() OVER (ORDER BY target / (2 * j - 1) DESC, source NULLS LAST, j) AS rank FROM e
), q AS (
  SELECT b.*, low + (SELECT count(*) FROM r WHERE r.source IS NOT DISTINCT FROM b.source AND rank <= rest) AS quota,
         greatest(1, ceil(source_size / {SHARD_TOKENS}))::BIGINT AS shards FROM b
), d AS (
  SELECT s.*, q.source_size, q.target, q.block, q.quota, md5('{SEED}/' || coalesce(doc_id::VARCHAR, '')) AS key,
         ('0x' || substr(md5('{SEED}/' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % shards AS shard
  FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source
), h AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard)::BIGINT AS shard_size,
         sum(size) OVER (PARTITION BY source, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS fin FROM d
), v AS (
  SELECT source, shard, shard_size, any_value(quota) AS quota, any_value(block) AS block,
         sum(shard_size) OVER (PARTITION BY source) AS votes, count(*) OVER (PARTITION BY source) AS k FROM h GROUP BY source, shard, shard_size
), vb AS (
  SELECT *, greatest(0, floor(shard_size::DOUBLE * (quota - k / 2.0::DOUBLE) / votes + 0.5) - 1)::BIGINT AS low,
            greatest(0, floor(shard_size::DOUBLE * (quota + k / 2.0::DOUBLE) / votes + 0.5) + 1)::BIGINT AS high FROM v
), ve AS (
  SELECT source, shard, shard_size, quota - low_all AS rest, unnest(range(low + 1, high + 1)) AS j
  FROM (SELECT *, sum(low) OVER (PARTITION BY source) AS low_all FROM vb) WHERE shard_size > 0
), vr AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY shard_size::DOUBLE / (2 * j - 1) DESC, shard, j) AS rank FROM ve
), w AS (
  SELECT vb.source, vb.shard, least((low + (SELECT count(*) FROM vr WHERE vr.source IS NOT DISTINCT FROM vb.source AND vr.shard = vb.shard AND rank <= rest)) * block, {MAX_EPOCHS} * shard_size)::BIGINT AS take FROM vb
), z AS (
  SELECT h.*, take, CASE WHEN shard_size > 0 THEN take // shard_size ELSE 0 END AS full_times
  FROM h JOIN w ON h.source IS NOT DISTINCT FROM w.source AND h.shard = w.shard
)
SELECT doc_id, size, source_size, target,
       (size * full_times + greatest(0, least(size, take - full_times * shard_size - (fin - size))))::BIGINT AS taken
FROM z
"""

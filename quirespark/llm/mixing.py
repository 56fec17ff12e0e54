"""Mixing sources to target weights.

Words are summed per source; the sources' table, small beside the documents, gets a target by weight that
stops at a multiple of the source's size; the repetition rate is target / size. Each document then comes
floor(rate) times, and once more if a number drawn from its id and the seed lies below the fraction. Documents
meet their rate in a broadcast if the sources are few enough, which is counted first, else in a join salted on
both sides, so that a hot source is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirespark.llm.common import SPACE, fresh, settled, small_enough, table, text_of, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"
#: A table of so many sources (a name, two longs, three doubles each) is a few MB and may be broadcast.
BROADCAST_SOURCES = 20_000
SALTS = 64
#: Draws are whole numbers below 16 ** 13, exact as doubles.
DIGITS = 13


def size_of(text: Column) -> Column:
    return F.size(words_of(text_of(text))).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("/" + seed)))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, rate) from (source, size) rows.

    Weights repeat over the sources in code-point order, null last. All targets together are ``share`` of all
    sizes; none is above ``most`` times its source's size, and what is cut off goes to the others by weight
    until none is above. That is the level at which the sources with the least room per weight are full: in
    that order, the first k are full for the least k whose next source has room for its share of the rest.
    With ``share`` over ``most``, all are full. A source without words has target and rate 0.

    The windows run over one row a source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = total.withColumn("weight", weight).withColumn("room", F.col("source_size") * F.lit(most) / F.col("weight"))
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    after = by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rest = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(most)
    levels = ranked.withColumn("level", rest / F.sum("weight").over(after))
    # Of the levels at which the source fits, the first in this order is the answer; later ones stay the same or lower.
    found = levels.withColumn("level", F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", F.col("source").isNull(), "source", "level"))).over(everything)["level"])
    target = F.when(F.col("level").isNull() | (F.col("room") <= F.col("level")), F.col("source_size") * F.lit(most)).otherwise(F.col("level") * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return found.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def with_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, prefix: str = "_mix_", **weighing) -> DataFrame:
    """``docs`` with ``<prefix>size``, ``source_size``, ``target`` and ``copies``: how often the mix takes the row.

    A null text has size 0, a very long one is counted whole; rows without an id draw as one; rows that repeat an id
    draw alike; rows without a source are a source of their own. Reruns agree. Columns of these four names are
    replaced, all others stay.
    """
    new = [prefix + x for x in ("size", "source_size", "target", "copies")]
    own = [c for c in docs.columns if c.lower() not in {n.lower() for n in new}]
    size, salt, rate = (fresh([*docs.columns, *new], f"{prefix}{x}") for x in ("words", "salt", "rate"))
    at, place = (fresh([*docs.columns, *new], f"{prefix}{x}") for x in ("source", "place"))
    counted = docs.select(*own).withColumn(size, size_of(F.col(text)))
    plan = settled(targets(counted.select(F.col(source).alias("source"), F.col(size).alias("size")), **weighing))
    plan = plan.select(F.col("source").alias(at), F.col("source_size").alias(new[1]), F.col("target").alias(new[2]), F.col("rate").alias(rate))
    if small_enough(plan, BROADCAST_SOURCES):
        joined = counted.join(F.broadcast(plan), F.col(source).eqNullSafe(F.col(at)))
    else:
        counted = counted.withColumn(salt, F.pmod(F.xxhash64(doc_id, text), F.lit(SALTS)))
        plan = plan.withColumn(place, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        joined = counted.join(plan, F.col(source).eqNullSafe(F.col(at)) & (F.col(salt) == F.col(place)))
    over = F.col(rate) - F.floor(rate)
    copies = F.floor(rate) + (draw(F.col(doc_id), seed) < over).cast("long")
    return joined.select(*own, F.col(size).alias(new[0]), new[1], new[2], copies.alias(new[3]))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix: the rows of ``docs``, each as often as it is taken, with all their own columns."""
    prefix = "_mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    counted = with_copies(docs, prefix=prefix, **options)
    times = F.explode(F.sequence(F.lit(1), F.col(f"{prefix}copies")))
    return counted.filter(F.col(f"{prefix}copies") > 0).select(*docs.columns, times.alias(f"{prefix}copy")).select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * F.col("_mix_copies")).alias("taken"),
    )


def mix_sql(docs: str) -> str:
    """Every column of ``docs`` with size, source_size, target and copies."""
    return f"""
WITH s AS (SELECT *, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE.replace(chr(92) + 'x20', ' ')}+'), lambda x: x <> ''))::BIGINT AS size FROM {docs}),
t AS (SELECT source, sum(size)::BIGINT AS n FROM s GROUP BY source),
k AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM t),
r AS (SELECT *, n * 2.0::DOUBLE / weight AS room FROM k),
v AS (SELECT *, (sum(n) OVER () * 1.5::DOUBLE - coalesce(sum(n) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
             / sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
             row_number() OVER (ORDER BY room, source NULLS LAST) AS i FROM r),
f AS (SELECT *, (SELECT arg_min(level, i) FROM v WHERE level <= room) AS lvl FROM v),
p AS (SELECT source, n AS source_size, CASE WHEN lvl IS NULL OR room <= lvl THEN n * 2.0::DOUBLE ELSE lvl * weight END AS target FROM f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM p)
SELECT s.*, q.source_size, q.target,
       (floor(rate) + CASE WHEN ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/{SEED}'), 1, {DIGITS}))::BIGINT::DOUBLE / {16**DIGITS}::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source"""


SQL = f"SELECT doc_id, size, source_size, target, size * copies AS taken FROM ({mix_sql('documents')})"

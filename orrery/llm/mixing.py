"""Mixing sources to target weights, with DataFrame operations only.

Words are added up per source, a repetition rate is derived for each, and every document is taken floor(rate) times plus once
more if its hash-seeded uniform number reaches 1 minus the rate's fraction: a Bernoulli copy whose probability is the fraction.
Independent numbers would leave a source of a few documents of unlike length far from its target, so the numbers of one source
are spread: v = frac(place * fraction + u), u being the source's own hash number and place the document's in the order of sizes.
Over the seeds v is uniform for every document, so the probabilities stay as they are; but of documents that follow one another in
size the share that is taken is the fraction, so the words come near the target. Place is the number of smaller documents, which
a histogram of sizes tells (7 leading bits: at most some 1400 rows a source), plus a hashed place among those of its size. Draws are reproducible and independent of partitioning.

Targets: weights repeat over the sources in code-point order (null last); together the sources take ``share`` times all words;
a target stops at ``cap`` times its source's size and the excess goes to the others by weight. That is filling water to one
level: target = least(cap * size, level * weight), and the level follows from sums over the sources sorted by cap * size /
weight. Only tables with one row per source are sorted by one task.

Edge cases: a null text has size 0; null sources are one source; documents without words are never missed (their copies count
nothing); repeated rows with one doc_id draw alike; an empty table gives no rows; other columns are ignored or carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import WORD, cut, read

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
#: A histogram up to this many rows (about 60 bytes each) is broadcast; a longer one is joined by shuffling.
BROADCAST_ROWS = 200_000


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: str = "size") -> Column:
    """The size without what lies behind its 7 leading bits."""
    behind = F.expr(f"shiftleft(1L, greatest(length(bin({size})) - 7, 0))")
    return F.col(size) - F.col(size) % behind


def _uniform(seed: str, of: Column) -> Column:
    """The number in [0, 1) of a string."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), of).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row per source: source, source_size, target, rate. ``sized`` has source and size."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    by_ratio = Window.orderBy(cap * F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = sources.withColumns(
        {
            "below": F.coalesce(F.sum("source_size").over(by_ratio), F.lit(0)).cast("double"),
            "weight_below": F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)),
            "all_size": F.sum("source_size").over(everything).cast("double"),
            "all_weight": F.sum("weight").over(everything),
        }
    )
    level = (share * F.col("all_size") - cap * F.col("below")) / (F.col("all_weight") - F.col("weight_below"))
    open_level = F.when(cap * F.col("source_size") / F.col("weight") >= level, level)
    sources = sources.withColumn("level", open_level).withColumn("level", F.max("level").over(everything))
    target = F.round(F.least(cap * F.col("source_size"), F.coalesce(F.col("level") * F.col("weight"), cap * F.col("source_size"))), 6)
    sources = sources.withColumn("target", target)
    return sources.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def mixing_plan(sized: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """One row per source and class of sizes: source, sizes, source_size, target, rate, u (the source's number), before and n
    (documents of smaller classes, and of this one). ``sized`` has source and size."""
    counts = cut(sized.groupBy("source", size_class().alias("sizes")).agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    sources = source_targets(counts, **options).withColumn("u", _uniform(seed, F.concat(F.lit("source:"), F.coalesce("source", F.lit("")))))
    smaller = Window.partitionBy("source").orderBy("sizes").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(smaller), F.lit(0))).drop("size")
    sources = sources.withColumnRenamed("source", "of_source")
    return cut(counts.join(sources, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source"))


def mixed(sized: DataFrame, plan: DataFrame, seed: str = SEED) -> DataFrame:
    """``sized`` (source, size and others) with the struct ``_mix`` of the plan's columns and copies, how often a row is taken."""
    found = plan.select(F.struct("source", "sizes").alias("_of"), F.struct(*[c for c in plan.columns if c not in ("source", "sizes")]).alias("_plan"))
    found = F.broadcast(found) if plan.count() <= BROADCAST_ROWS else found
    joined = sized.join(found, F.struct("source", size_class().alias("sizes")).eqNullSafe(F.col("_of")), "left")
    at = lambda name: F.col(f"_plan.{name}")
    fraction = at("rate") - F.floor(at("rate"))
    own = _uniform(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    place = (at("before") + F.floor(at("n").cast("double") * own)).cast("double") * fraction + at("u")
    taken = F.floor(at("rate")) + (place - F.floor(place) >= F.lit(1.0) - fraction).cast("long")
    return joined.withColumn("_mix", F.struct("_plan.*", taken.cast("long").alias("copies"))).drop("_of", "_plan")


def mix_digest(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    sized = cut(docs.select("doc_id", "source", word_count().alias("size")))
    out = mixed(sized, mixing_plan(sized, seed, **options), seed)
    return out.select("doc_id", "size", "_mix.source_size", "_mix.target", (F.col("_mix.copies") * F.col("size")).alias("taken"), "_mix.copies")


def mix_documents(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; columns as given."""
    plan = mixing_plan(docs.select("source", word_count().alias("size")), seed, **options)
    whole = docs.select("doc_id", "source", word_count().alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    repeated = mixed(whole, plan, seed).withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_mix.copies").cast("int"))))
    return repeated.select("_row.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_digest(read(spark, sf_dir, "documents")).drop("copies")


OP5_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY source
), sums AS (
  SELECT *, coalesce(sum(source_size) OVER w, 0)::DOUBLE AS below, coalesce(sum(weight) OVER w, 0)::DOUBLE AS weight_below,
         sum(source_size) OVER ()::DOUBLE AS all_size, sum(weight) OVER () AS all_weight
  FROM sources
  WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (1.5::DOUBLE * all_size - 2.0::DOUBLE * below) / (all_weight - weight_below) AS lv FROM sums
), targets AS (
  SELECT source, source_size, weight,
         round(least(2.0::DOUBLE * source_size, coalesce(max(CASE WHEN 2.0::DOUBLE * source_size / weight >= lv THEN lv END) OVER () * weight, 2.0::DOUBLE * source_size)), 6) AS target
  FROM levels
), rated AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), counts AS (
  SELECT source, size - size % (1::BIGINT << greatest(length(bin(size)) - 7, 0)) AS sizes, count(*) AS n FROM sized GROUP BY ALL
), placed AS (
  SELECT source, sizes, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY sizes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts
), numbered AS (
  SELECT r.*, rate - floor(rate) AS fraction,
         CAST('0x' || substr(md5('{SEED}:source:' || coalesce(r.source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u,
         p.before::DOUBLE + floor(p.n::DOUBLE * (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)) AS place
  FROM rated r JOIN placed p ON r.source IS NOT DISTINCT FROM p.source AND r.size - r.size % (1::BIGINT << greatest(length(bin(r.size)) - 7, 0)) = p.sizes
)
SELECT doc_id, size, source_size, target,
       CAST(size * (CAST(floor(rate) AS BIGINT) + CAST(place * fraction + u - floor(place * fraction + u) >= 1.0::DOUBLE - fraction AS BIGINT)) AS BIGINT) AS taken
FROM numbered
"""

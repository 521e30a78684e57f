"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each document of a source is expected ``rate = target / source size`` times. In the order of
(size, id) the expected copies are summed up, one random offset per source is added, and
a document is emitted once for each integer that the sum crosses. Ordering by size keeps
what a source gives within about its largest document of its target. The order is the same at every
size of input: rows are cut into ranges of it, and the counts of earlier ranges are added.
Rates are held as multiples of 2**-24, so that sums are exact whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackflux.llm.frames import positioned, running, small, staged

WEIGHTS = (5, 2, 1)
MOST = 3
BITS = 24
ONE = 1 << BITS
#: Rows that one range of the order holds on average.
CELL_ROWS = 10_000
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _draw(value: Column, digits: int) -> Column:
    """A number below 16**digits from the hash of a string."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, digits), 16, 10).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Sources in code point order, null last, weigh ``weights`` over and over and share the sum of
    all sizes. No target is above ``most`` times its source's size: sorted by that bound per weight, the sources that
    reach theirs come first, and the others share the rest by weight.
    """
    ranked = running(sources.withColumn("_one", F.lit(1)), ["source"], {"n": F.col("_one").cast("bigint")}, "source-ranks")
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.col("n_before") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight).select("source", "source_size", "weight", (F.col("source_size") * most / F.col("weight")).alias("bound"))
    ordered = staged(running(weighed, ["bound", "source"], {"cap": F.col("source_size") * most, "w": F.col("weight")}, "source-bounds"), "source-shares")
    total = ordered.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    # the level at which this source would be the first that is below its bound
    level = (F.lit(total["size"]) - F.col("cap_before")) / (F.lit(total["weight"]) - F.col("w_before"))
    first = ordered.withColumn("level", level).where("level <= bound").agg(F.min(F.struct("bound", F.col("source").isNull(), "source", "level")).alias("m")).first()
    water = first["m"]["level"] if first["m"] else 0.0
    return ordered.select(
        "source", "source_size", "weight",
        F.least((F.col("source_size") * most).cast("double"), F.lit(water) * F.col("weight")).alias("target"))


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS,
           most: int = MOST, seed: str = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, row_key, source, size, source_size, target, copies) for each row.

    A null text has no words, a null source is a source of its own. Sources without a word have the target 0. Repeated rows
    are documents of their own. An empty table gives no row.
    """
    sized = staged(docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(doc_id).cast("bigint"), F.col(text)).alias("row_key"),
        F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"),
        F.monotonically_increasing_id().alias("row")), "sizes")
    sources = staged(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") * ONE / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    offset = _draw(F.concat(F.coalesce("source", F.lit("")), F.lit(f"|{seed}")), BITS // 4)
    goals = small(staged(targets(sources, weights, most).select("*", rate.alias("rate"), offset.alias("offset")), "targets"))
    # ranges of (source, size, id); the row number only parts rows that are alike, so that these can be cut too
    order = ["source", "size", "doc_id", "row_key", "row"]
    ranges = max(1, -(-sized.count() // cell_rows))
    dealt = staged(sized.repartitionByRange(ranges, *[F.asc_nulls_first(c) for c in order]).withColumn("part", F.spark_partition_id()), "parts")
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = staged(dealt.groupBy("source", "part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))), "ranks")
    inside = Window.partitionBy("source", "part").orderBy(*[F.asc_nulls_first(c) for c in order[1:]])
    here = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("part") == F.col("b_part"))
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(
        small(base.select(F.col("source").alias("b_source"), F.col("part").alias("b_part"), "before")), here)
    mixed = ranked.withColumnRenamed("source", "d_source").join(goals, F.col("d_source").eqNullSafe(F.col("source")))
    at = (F.col("before") + F.col("rank")) * F.col("rate") + F.col("offset")
    crossed = F.shiftright(at + F.col("rate"), BITS) - F.shiftright(at, BITS)
    return mixed.select("doc_id", "row_key", "source", "size", "source_size", "target", crossed.alias("copies"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns, whatever they are called.

    Nulls, empty texts, ties, repeated rows and empty tables as in ``copies``.
    """
    names = docs.columns
    docs, doc_id, text, source = positioned(docs, doc_id, text, source)
    taken = staged(copies(docs, doc_id, text, source, **settings).groupBy("doc_id", "row_key").agg(F.collect_list("copies").alias("times")), "taken")
    keyed = docs.withColumn("_key", F.xxhash64(F.col(doc_id).cast("bigint"), F.col(text)))
    taken = small(taken.select(F.col("doc_id").alias("_t_id"), F.col("row_key").alias("_t_key"), F.expr("aggregate(times, 0L, (a, x) -> a + x)").alias("_sum"), F.size("times").alias("_rows")))
    found = keyed.join(taken, F.col(doc_id).cast("bigint").eqNullSafe(F.col("_t_id")) & (F.col("_key") == F.col("_t_key")))
    one = found.where("_rows = 1 and _sum > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_sum").cast("int"))))
    # repeated rows share what their repeats take: one of them stands for all
    many = found.where("_rows > 1 and _sum > 0").dropDuplicates(["_t_id", "_t_key"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_sum").cast("int"))))
    return one.select(*docs.columns).unionByName(many.select(*docs.columns)).toDF(*names)


#: The same mix in SQL.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::BIGINT AS weight FROM src),
bounds AS (SELECT *, (source_size * 3)::DOUBLE / weight AS bound FROM weighed),
shares AS (
  SELECT *, coalesce(sum(source_size * 3) OVER before, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER before, 0)::BIGINT AS w_before,
    sum(source_size) OVER ()::BIGINT AS all_size, sum(weight) OVER ()::BIGINT AS all_weight
  FROM bounds WINDOW before AS (ORDER BY bound, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (all_size - cap_before)::DOUBLE / (all_weight - w_before) AS level FROM shares),
water AS (SELECT level AS water FROM levels WHERE level <= bound ORDER BY bound, source NULLS LAST LIMIT 1),
goals AS (
  SELECT source, source_size, least((source_size * 3)::DOUBLE, coalesce((SELECT water FROM water), 0.0) * weight) AS target,
    ('0x' || substr(md5(coalesce(source, '') || '|mix-1'), 1, 6))::BIGINT AS u FROM shares),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target * 16777216 / source_size)::BIGINT ELSE 0 END AS rate FROM goals),
ranked AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS k FROM sized)
SELECT r.doc_id, r.size, g.source_size, g.target,
  ((((r.k + 1) * g.rate + g.u) >> 24) - ((r.k * g.rate + g.u) >> 24)) * r.size AS taken
FROM ranked r JOIN rated g ON r.source IS NOT DISTINCT FROM g.source
"""

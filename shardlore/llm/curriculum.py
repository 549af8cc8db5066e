r"""Mixing sources to target weights along a time-varying curriculum.

A source's *share* fixes how many words the mix takes from it; its *schedule*
fixes when.  The schedule is linear, ``f(t) = 1 + slope * (2t - 1)`` on training
time t in [0, 1], so the cumulative demand ``F(t) = (1 - slope) t + slope t^2``
is inverted in closed form: the word at fraction u of a source's target is
trained at ``t = 2u / (1 - slope + sqrt((1 - slope)^2 + 4 slope u))``.

Targets: sources in code point order (null last) weigh 1, 2, 3, 1, 2, 3, ...
and share all words; a target stops at ``max_epochs`` times its source's size
and the excess is shared again by weight until none is above.  The shares come
from prefix sums over the sources ordered by saturation point, in integers up
to one last division, so reruns agree.

Documents of a source stand in the order of md5(doc_id); epoch e of a document
starts at (words before it) + e * (words of its source), and is taken if its
middle is within the target.  Prefix sums over documents are two-level: sums
per (source, key range), a window over those sums, and a window within each
range, so a source with a third of all rows is many small windows.

Schedules are a parameter: :class:`Schedule` takes any positive weights on
equal parts of training time, of which the linear ones above are the default's
closed form, and inverts their integral part by part.

Edge cases: a null or wordless text has size 0 and takes 0.  A null source is a
source.  Every row is mixed on its own: rows of a repeated doc_id stand one
after the other (ties in the order go by size), rows without one in the order
of md5(text).  Empty tables give an empty result.  Extra columns of any name
are carried by :func:`mixed_rows`; where the table has columns ``epoch`` or
``position``, those that it adds are called ``mix_epoch`` and ``mix_position``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import once_each, read_table, row_hash, staged, whole_row

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Slope of the schedule by the source's rank: early, even, late.
SLOPES = (-0.5, 0.0, 0.5)
#: Documents per key range, about.
RANGE_ROWS = 20_000


def word_count(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> also weight, slope, target. One row per source is sorted in one task."""
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("place"))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    ranked = sizes.withColumn("place", (F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", pick(WEIGHTS).cast("long")).withColumn("slope", pick(SLOPES))
    # saturation point: where max_epochs * size / weight is small, the cap binds first; 6 / weight is whole
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.expr("source_size * (6 div weight)"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    full = F.col("source_size") * max_epochs
    ranked = ranked.withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0)))
    ranked = ranked.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("capped", full * F.col("left_weight") < F.col("left_size") * F.col("weight"))
    rest_size = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("capped"), full)).over(everything), F.lit(0))
    rest_weight = F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything), F.lit(1))
    target = F.when(F.col("capped"), full.cast("double")).otherwise((rest_size * F.col("weight")).cast("double") / rest_weight)
    return ranked.select("source", "source_size", "weight", "slope", target.alias("target"))


def training_time(u, slope) -> F.Column:
    """Inverse of the cumulative demand of a linear schedule."""
    return 2 * u / (1 - slope + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u))


class Schedule:
    """Weights on equal parts of training time, integrated to the cumulative demand, which is inverted part by part."""

    def __init__(self, weights: tuple[float, ...]) -> None:
        if not weights or min(weights) < 0 or max(weights) <= 0:
            raise ValueError("a schedule needs weights that aren't negative, and one that is positive")
        total = float(sum(weights))
        self.parts = [(sum(weights[:k]) / total, w / total) for k, w in enumerate(weights)]

    def time(self, u: F.Column) -> F.Column:
        """Training time at which the fraction u of the demand is met."""
        n = len(self.parts)
        out = F.lit(1.0)
        for k in range(n - 1, -1, -1):
            before, share = self.parts[k]
            if share > 0:
                out = F.when(u <= before + share, (k + (u - before) / share) / n).otherwise(out)
        return out


def _when_trained(u: F.Column, schedules: dict[str, Schedule]) -> F.Column:
    out = training_time(u, F.col("slope"))
    for source, schedule in schedules.items():
        out = F.when(F.col("source").eqNullSafe(F.lit(source)), schedule.time(u)).otherwise(out)
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS, row: F.Column | None = None, schedules: dict[str, Schedule] | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, positions): one row per document.

    row: a hash of the row, which orders documents of equal id and size and is returned as well.
    schedules: those of some sources, instead of the linear ones.
    """
    n = docs.count()
    ranges = max(1, -(-n // RANGE_ROWS))
    ident = F.col(id_col).cast("long")
    key = F.md5(F.coalesce(ident.cast("string"), F.col(text_col), F.lit("")))
    own = [] if row is None else [row.alias("number")]
    rows = docs.select(ident.alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key"), *own)
    part = F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * ranges / 2**28).cast("long")
    rows = staged(rows.withColumn("part", part), "mix-sizes")
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), max_epochs)
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)))
    sums = sums.join(targets, sums["source"].eqNullSafe(targets["source"])).select(sums["source"].alias("s"), F.col("part").alias("p"), "ahead", "source_size", "target", "slope")
    inner = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", *(["number"] if own else [])).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    start = lambda e: F.col("ahead") + F.col("inside") + F.col("source_size") * e
    at = lambda e: (2 * start(e) + F.col("size")) / (2 * F.col("target"))
    chosen = [F.when((F.col("size") > 0) & (2 * start(e) + F.col("size") <= 2 * F.col("target")), _when_trained(at(e), schedules or {})) for e in range(max_epochs)]
    rows = rows.withColumn("positions", F.array_compact(F.array(*chosen)))
    taken = F.col("size") * F.size("positions")
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "positions", *(["number"] if own else []))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range-sorted by first training time; documents that the mix leaves out stand last."""
    mixed = mix(read_table(spark, sf_dir, "documents"))
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", F.try_element_at("positions", F.lit(1)).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", schedules: dict[str, Schedule] | None = None) -> DataFrame:
    """docs, a row for each time the mix takes one, with epoch and training time, range-sorted by it.

    Rows meet their positions by a hash of all their columns.  Equal rows are
    each mixed, and one of them stands for all their positions.
    """
    number = row_hash(docs)
    plan = staged(mix(docs, id_col, row=number, schedules=schedules).select("number", "positions"), "mix-plan")
    repeated = staged(plan.groupBy("number").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("number"), "mix-repeated")
    rows = once_each(docs.select(number.alias("number"), whole_row(docs)), "number", repeated)
    slots = plan.select("number", F.posexplode("positions").alias("epoch", "position"))
    taken = {c.lower() for c in docs.columns}
    names = [n if n not in taken else f"mix_{n}" for n in ("epoch", "position")]
    out = rows.join(slots, "number").orderBy("position", f"row.`{id_col}`", "number")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("epoch").alias(names[0]), F.col("position").alias(names[1]))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: doc_id, text and the other columns, epoch, position."""
    return mixed_rows(docs)


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS k,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM d GROUP BY source
), o AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0) AS left_size, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS left_weight FROM s
  WINDOW w AS (ORDER BY source_size * (6 // weight), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, 3 * source_size * left_weight < left_size * weight AS capped FROM o),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE
    CAST((sum(source_size) OVER () - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0)) * weight AS DOUBLE) / coalesce(sum(weight) FILTER (NOT capped) OVER (), 1) END AS target FROM c
), p AS (
  SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  size * CAST((2 * start + size <= 2 * target)::INT + (2 * (start + source_size) + size <= 2 * target)::INT + (2 * (start + 2 * source_size) + size <= 2 * target)::INT AS BIGINT) AS taken
FROM p
"""

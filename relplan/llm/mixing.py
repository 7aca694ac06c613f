"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document is a packet with a virtual finish time: the words of its
source up to and with that copy, in a shuffled order, divided by the source's
target.  The mix is the prefix of all packets, sorted by that time, at which the
total budget is spent.  A copy that runs over its source's target is sent as two
packets, so the budget ends between packets and every source takes its target.

No task ever holds a source: sizes are added up per (source, hash prefix), the
running sums over prefixes are small, and only the documents of one prefix are
sorted together.  The prefix grows with the table.  Running sums over all sources
and over all packets go by ranges: rows are dealt into ranges of the order, and
each range starts from the sum of those before.

Defined cases: a null text has size 0; a null source is a source of its own,
sorted last; documents of size 0 take 0; rows without id are shuffled by their
text; an empty table gives an empty mix; repeated rows each count; extra columns
are carried by :func:`schedule` only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relplan.operators.relational import row_number
from relplan.sources import shared

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def word_count(text: Column) -> Column:
    """Number of words between blanks; 0 for null."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def running(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """``df`` with ``v_upto`` for each value v: its sum over all rows up to this one in a total order of the columns ``order``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = shared.keep(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    whole = table.groupBy("_range").agg(*[F.sum(v).alias(v) for v in values])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = whole.select("_range", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_before") for v in values])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = table.join(F.broadcast(offsets), "_range")
    return joined.withColumns({f"{v}_upto": F.col(f"{v}_before") + F.sum(v).over(within) for v in values}).drop("_range", *[f"{v}_before" for v in values])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) with each source's share of all words.

    Shares follow the weights, dealt in the order of names; a source stops at
    ``most`` times its size and the excess goes to the others by weight.  That
    level is found in closed form over the sources sorted by size / weight.
    """
    numbered = row_number(["unnamed", "source"])(sources.select(F.col("source").isNull().alias("unnamed"), "source", "source_size"))
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("row_number") % len(weights) + 1).cast("int"))
    ceiling = F.col("row.source_size") * most
    capped = numbered.select((ceiling / cycle).alias("ratio"), "row.*", cycle.cast("long").alias("weight"), ceiling.alias("ceiling"))
    table = shared.keep(running(capped, ["ratio", "unnamed", "source"], ["ceiling", "weight"]), "sources")
    words, weight = table.agg(F.sum("source_size"), F.sum("weight")).first()
    if words is None:
        return table.select("source", "source_size", F.lit(0.0).alias("target"))
    level = (F.lit(words) - (F.col("ceiling_upto") - F.col("ceiling"))) / (F.lit(weight) - F.col("weight_upto") + F.col("weight"))
    found = table.withColumn("level", level)
    # the first source whose ceiling isn't below its level fixes the level of all after it
    water = found.where(F.col("ratio") >= F.col("level")).agg(F.min(F.struct("ratio", "unnamed", "source", "level"))["level"]).first()[0]
    return found.select("source", "source_size", F.when(F.col("ratio") < F.lit(water), F.col("ceiling").cast("double")).otherwise(F.lit(water) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, rows_per_bucket: int = 20_000) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, hash, virtual_finish) for every row of ``docs``.

    ``taken`` counts words over at most three copies.  ``virtual_finish`` is that of the first copy.
    """
    shuffled = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), "text"), F.lit("")))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"), shuffled.alias("shuffled"))
    sized = shared.keep(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
    most = sized.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    digits = max(1, math.ceil(math.log(max(1, most / rows_per_bucket), 16)))
    sized = sized.withColumn("bucket", F.substring("shuffled", 1, digits))
    by_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    goals = shared.keep(targets(by_bucket.groupBy("source").agg(F.sum("words").alias("source_size"))), "targets")
    budget = goals.agg(F.sum(F.floor("target"))).first()[0] or 0
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    g, o = goals.alias("g"), offsets.alias("o")
    plan = o.join(g, F.col("o.source").eqNullSafe(F.col("g.source"))).select("o.source", "o.bucket", "o.offset", "g.source_size", "g.target")
    s, p = sized.alias("s"), plan.alias("p")
    rows = s.join(p, F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.bucket") == F.col("p.bucket"))).select("s.*", "p.offset", "p.source_size", "p.target")
    within = Window.partitionBy("source", "bucket").orderBy("shuffled", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = shared.keep(rows.withColumn("end", F.col("offset") + F.sum("size").over(within)).drop("offset", "bucket"), "queued")
    # a source's queue holds as many copies of it as its target reaches into
    copies = rows.where("size > 0 and target > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("target") / F.col("source_size")).cast("int") - 1)))
    copies = copies.select("row", "copy", "shuffled", "target", "size", (F.col("end") + F.col("copy") * F.col("source_size")).alias("to"))
    start, stop = F.col("to") - F.col("size"), F.floor("target")
    two = F.array(F.struct(start.alias("from"), stop.alias("to")), F.struct(stop.alias("from"), F.col("to")))
    packet = F.explode(F.when((start < stop) & (stop < F.col("to")), two).otherwise(F.array(F.struct(start.alias("from"), F.col("to")))))
    packets = copies.select("row", "copy", "shuffled", "target", packet.alias("x")).select((F.col("x.to") / F.col("target")).alias("finish"), "shuffled", "row", "copy", (F.col("x.to") - F.col("x.from")).alias("words"))
    sorted_ = running(packets, ["finish", "shuffled", "row", "copy"], ["words"])
    cut = F.least(F.col("words"), F.greatest(F.lit(0), F.lit(budget) - F.col("words_upto") + F.col("words")))
    taken = sorted_.where(F.col("words_upto") - F.col("words") < budget).groupBy("row").agg(F.sum(cut).alias("taken"))
    finish = F.when(F.col("target") > 0, F.col("end") / F.col("target"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "hash", finish.alias("virtual_finish"))


def _fresh(names: list[str], taken: list[str]) -> list[str]:
    """The names, with as many underscores behind as set them apart from those taken."""
    low = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name += "_"
        out.append(name)
    return out


def schedule(docs: DataFrame) -> DataFrame:
    """One row per copy that the mix reads, all columns of ``docs`` first, range-sorted by virtual finish time.

    ``copy`` counts from 0 and ``words`` is how much of that copy is read; where
    ``docs`` has a column of such a name, ours ends in an underscore.  Rows are
    found again by id, source, size and a hash of their text.
    """
    spread = mix(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.select(row.alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("hash"))
    alike = ["doc_id", "source", "size", "hash"]
    left = marked.withColumn("nth", F.row_number().over(Window.partitionBy(*alike).orderBy("size"))).alias("d")
    right = spread.withColumn("nth", F.row_number().over(Window.partitionBy(*alike).orderBy("virtual_finish"))).alias("m")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").eqNullSafe(F.col("m.source")) & (F.col("d.size") == F.col("m.size")) & (F.col("d.hash") == F.col("m.hash")) & (F.col("d.nth") == F.col("m.nth"))
    joined = left.join(right, same).where("m.taken > 0").select("d.row", "m.doc_id", "m.taken", "m.size", "m.virtual_finish", "m.source_size", "m.target")
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    words = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    finish = F.col("virtual_finish") + F.col("copy") * F.col("source_size") / F.col("target")
    sorted_ = copies.select("row", "copy", words.alias("words"), finish.alias("finish"), "doc_id").orderBy("finish", "doc_id", "copy")
    names = _fresh(["copy", "words", "virtual_finish"], docs.columns)
    return sorted_.select(*[F.col("row")[c].alias(c) for c in docs.columns], *[F.col(c).alias(n) for c, n in zip(("copy", "words", "finish"), names, strict=True)])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(CAST(doc_id AS VARCHAR)) AS shuffled FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight, 3 * source_size AS ceiling FROM s),
l AS (SELECT *, row_number() OVER o AS k, ceiling / weight AS ratio,
        ((SELECT sum(source_size) FROM s) - coalesce(sum(ceiling) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY ceiling / weight, source NULLS LAST)),
f AS (SELECT level AS water FROM l WHERE ratio >= level ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN ratio < water THEN CAST(ceiling AS DOUBLE) ELSE water * weight END AS target FROM l, f),
c AS (SELECT z.doc_id, z.size, t.source_size, t.target,
        CAST(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.shuffled, z.doc_id, z.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - z.size AS start
      FROM sized z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size))
     + greatest(0, least(size, floor(target) - start - 2 * source_size)) AS BIGINT) AS taken
FROM c
"""

"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected target / source_size times in the mix. The documents of a source are ordered by
size and identifier, their expected copies are summed along that order, one random offset is added, and a document is
emitted once for each integer that its stretch of the sum crosses. Ordering by size keeps the words that are taken
near the target. The rank within a source comes from a range partition of the whole table (its splitters end with the
identifier and a stored row number, so a hot source and a row that repeats spread over many ranges) plus the counts of
the ranges before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, fresh, numbered

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 20240229
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """sizes: source, source_size (one row a source). Adds target.

    Sources by code point, null last, take the weights in turn; share times all words are given out by weight, no source
    gets more than most times its own, and what it can't take goes to the others by weight. Ordered by the words a unit
    of weight can take, the sources that reach their limit come first; level is what a unit of weight gets if exactly the
    sources before a row are at their limit, and the first row that stays below its limit has the final level. All sources
    pass through one task, a row of three numbers each: this is meant for sources by the million, not for one a document.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.pmod(place - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")).cast("long")
    weighed = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    filled = (
        weighed.withColumn("given", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("given") - F.col("cap_before")) / F.col("weight_left"))
    )
    below = F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))
    final = filled.withColumn("level", F.min(below).over(whole)["level"])
    return final.select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def _plan(rows: DataFrame, store: Scratch, id_col: str, text_col: str, source_col: str, places: Sequence[str], weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """What mix_plan returns, with the columns places of rows."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    given = [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size")]
    sized = store.keep(rows.select(*given, *[F.col(p).alias(f"place{i}") for i, p in enumerate(places)], F.monotonically_increasing_id().alias("number")))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    dealt = store.keep(sized.repartitionByRange("source", "size", "doc_id", "number").sortWithinPartitions("source", "size", "doc_id", "number").drop("number").withColumn("at", F.monotonically_increasing_id()))
    span = F.shiftright("at", 33).alias("span")
    spans = dealt.groupBy("source", span).agg(F.min("at").alias("low"), F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    base = spans.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    facts = base.join(targets.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).select(F.col("source").alias("from"), F.col("span").alias("part"), "low", "base", "source_size", "target")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rows = dealt.withColumn("here", F.shiftright("at", 33)).join(store.keep(facts), F.col("source").eqNullSafe(F.col("from")) & (F.col("here") == F.col("part")))
    rank = (F.col("base") + F.col("at") - F.col("low") + 1).cast("double")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(rank * F.col("each") + F.col("offset")) - F.floor((rank - 1) * F.col("each") + F.col("offset"))
    store.drop(sized)
    return (
        rows.withColumn("each", each)
        .withColumn("offset", offset)
        .withColumn("copies", F.least(crossed, F.lit(most).cast("long")))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[f"place{i}" for i in range(len(places))])
    )


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken; the same on every run.

    how: weights, share, most and seed. Size is the number of words between ASCII white space; a null or empty text has
    none. A null source is a source of its own. Rows tied in size take ranks by identifier, repeated rows neighbouring
    ranks. A very long text counts all its words. Extra columns are not read; an empty table gives no rows.
    """
    return _plan(docs, Scratch(docs.sparkSession), id_col, text_col, source_col, (), **how)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs with every row as often as mix_plan takes it (not at all, once or more); all columns stay.

    A row is known by its place in the table, so repeated rows are rows of their own. Null and empty texts have size 0 and
    are taken as their source's other rows are; very long ones count whole. An empty table gives no rows.
    """
    store, (file, row, times, one) = Scratch(docs.sparkSession), fresh(docs, "__file", "__row", "__times", "__one")
    rows = numbered(docs, store, file, row)
    plan = _plan(rows, store, id_col, text_col, source_col, (file, row), **how)
    due = plan.filter("copies > 0").select(F.col("place0").alias(file), F.col("place1").alias(row), F.col("copies").cast("int").alias(times))
    placed = rows.join(due, [file, row])
    return placed.withColumn(one, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Mixing sources to target weights by entropy balancing.

For each source the document rates r that lie closest to 1 in relative entropy, meet the source's token
target sum(r * size) = target and stay within [0, 2], are r = min(2, exp(tilt * size)).  The dual in the one
tilt per source is convex and is solved by Newton steps, safeguarded by a bracket; each step is one grouped
sum over (source, size) counts, which are sufficient for it and far fewer than the documents.  All sums are
of integers (rates are multiples of 2**-30), so the order of rows and tasks cannot change a result.

Rates become whole copies by cumulative rounding over the sizes of a source from large to small; the words
still missing or in excess are then made up from the largest documents that fit, three times, and at last
from the smallest on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliarc.llm.common import forget, prepare, quoted, whole_row, written

ONE = 2**30
WORD = r"[^\x20\x09-\x0D]+"
BIG = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and the controls 9 to 13; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code-point order, null last, weigh ``weights`` repeating and share budget times all sizes; a
    target stops at most times its source's size and the excess is shared again by weight until none is
    above.  The level at which that ends follows in closed form from running sums over the sources ordered
    by how soon they stop: one row a source is all that meets in one task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    s = per.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("left", budget * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    stops = F.col("cap") <= F.col("left") / F.col("rest") * F.col("w")
    level = F.coalesce(F.first(F.when(~stops, F.col("left") / F.col("rest")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(float("inf")))
    return s.withColumn("target", F.least("cap", level * F.col("w"))).select("source", "source_size", "target")


def _tilts(cells: DataFrame, targets: DataFrame, most: int = 2, steps: int = 60) -> DataFrame:
    """(source, tilt) with the tilt per word; null where every document is taken ``most`` times or none at all."""
    mean = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), (F.sum(F.col("size") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    lam = targets.alias("t").join(mean.alias("m"), F.col("t.source").eqNullSafe(F.col("m.source"))).select(
        "t.source", "mean", F.round(F.col("target") * F.lit(float(ONE))).cast(BIG).alias("goal"),
        ((F.col("words") > 0) & (F.col("target") < most * F.col("words"))).alias("open"))
    lam = lam.select("*", F.lit(0.0).alias("x"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))
    lam = written(lam, "mix-tilts")
    for _ in range(steps):
        now = cells.alias("c").join(lam.where("open").alias("l"), F.col("c.source").eqNullSafe(F.col("l.source"))).select("c.source", "size", "n", "x", "mean")
        tilt = F.col("x") * F.col("size") / F.col("mean")
        rate = F.floor(F.least(F.exp(F.least(tilt, F.lit(1.0))), F.lit(float(most))) * ONE).cast(BIG)
        free = F.exp(F.least(tilt, F.lit(1.0))) < most
        amount = rate * (F.col("n") * F.col("size")).cast("decimal(20,0)")
        now = now.groupBy("source").agg(F.sum(amount).alias("got"), F.sum(F.when(free, amount * F.col("size").cast("decimal(12,0)")).otherwise(F.lit(0).cast(BIG))).alias("slope"))
        was = lam.alias("was").join(now.alias("now"), F.col("was.source").eqNullSafe(F.col("now.source")), "left")
        gap = (F.col("now.got") - F.col("was.goal")).cast("double")
        high = gap > 0
        lo, hi = F.when(~high, F.col("was.x")).otherwise(F.col("was.lo")), F.when(high, F.col("was.x")).otherwise(F.col("was.hi"))
        was = was.select("was.source", "was.mean", "was.goal", "was.open", F.col("was.x").alias("x0"), gap.alias("gap"), (F.col("now.slope").cast("double") / F.col("was.mean")).alias("slope"), lo.alias("lo"), hi.alias("hi"))
        newton = F.col("x0") - F.try_divide(F.col("gap"), F.col("slope"))
        inside = (newton > F.coalesce("lo", F.lit(float("-inf")))) & (newton < F.coalesce("hi", F.lit(float("inf"))))
        middle = F.when(F.col("lo").isNull(), F.col("hi") * 2 - 1).when(F.col("hi").isNull(), F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        narrow = F.coalesce(F.col("hi") - F.col("lo") < 1e-14, F.lit(False))  # never while the bracket is open on one side
        done = ~F.col("open") | (F.abs("gap") <= F.greatest(F.col("goal").cast("double") * 1e-9, F.lit(float(ONE)) / 8)) | narrow
        now = was.select("source", "mean", "goal", (~F.coalesce(done, F.lit(True))).alias("open"), F.when(F.coalesce(done, F.lit(True)), F.col("x0")).when(inside, newton).otherwise(middle).alias("x"), "lo", "hi")
        was, lam = lam, written(now, "mix-tilts")
        forget(was)
        if lam.where("open").isEmpty():
            break
    return lam.select("source", (F.col("x") / F.col("mean")).alias("tilt"))


def _cell(source: Column, size: Column, salt: Column) -> Column:
    """Documents that are alike for the mix, as one key; a null source is a value of its own."""
    return F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("source"), size.alias("size"), salt.alias("salt"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, salts: int) -> list[Column]:
    text = F.col(quoted(text_col))
    salt = F.pmod(F.xxhash64(F.col(quoted(id_col)), text), F.lit(salts)).cast("int")
    return [F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).cast("string").alias("source"), word_count(text).alias("size"), salt.alias("salt")]


def _dealt(rows: DataFrame, weights: tuple, budget: float) -> DataFrame:
    """(cell, n, copies, source_size, target): how many copies the n rows of a cell get together.

    Rounding and making up run over the sizes of a source, of which there are as many as documents differ in
    length, whatever their number; a size's copies are then dealt to its salts in proportion.
    """
    cells = written(rows.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "mix-cells")
    sizes = written(cells.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-counts")
    targets = written(source_targets(sizes.select("source", (F.col("size") * F.col("n")).alias("size")), weights, budget), "mix-targets")
    tilts = _tilts(sizes, targets)

    known = targets.alias("t").join(tilts.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source"))).select("t.source", "t.source_size", "t.target", "l.tilt")
    full = F.col("target") >= 2 * F.col("source_size")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(full, F.lit(2.0)).otherwise(F.least(F.exp(F.least(F.col("tilt") * F.col("size"), F.lit(1.0))), F.lit(2.0)))
    c = sizes.alias("c").join(known.alias("k"), F.col("c.source").eqNullSafe(F.col("k.source"))).select("c.source", "size", "n", "source_size", "target", (F.floor(rate * ONE).cast(BIG) * F.col("n").cast("decimal(12,0)")).cast(BIG).alias("want"))

    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("want").over(down)
    at = lambda x: F.floor((x + ONE // 2) / ONE).cast("long")
    c = c.select("*", upto.alias("upto")).select("source", "size", "n", "source_size", "target", F.greatest(F.lit(0), F.least(2 * F.col("n"), at(F.col("upto").cast("double")) - at((F.col("upto") - F.col("want")).cast("double")))).alias("copies"))
    c = c.withColumn("copies", F.when(F.col("size") == 0, F.col("n")).otherwise(F.col("copies")))
    for order in (F.col("size").desc(),) * 3 + (F.col("size").asc(),):
        lack = F.col("target") - F.sum(F.col("copies") * F.col("size")).over(Window.partitionBy("source"))
        c = c.withColumn("lack", lack)
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("lack"))
        c = c.withColumn("room", F.when(~fits, F.lit(0)).when(F.col("lack") > 0, 2 * F.col("n") - F.col("copies")).otherwise(F.col("copies")))
        before = Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        c = c.withColumn("used", F.coalesce(F.sum(F.col("room") * F.col("size")).over(before), F.lit(0)))
        more = F.greatest(F.lit(0), F.least(F.col("room"), F.floor(F.try_divide(F.abs("lack") - F.col("used"), F.col("size")))))
        c = c.withColumn("copies", F.col("copies") + F.when(F.col("room") > 0, F.signum("lack").cast("long") * more).otherwise(0))
    same = (F.col("c.source").eqNullSafe(F.col("s.source"))) & (F.col("c.size") == F.col("s.size"))
    c = cells.alias("s").join(c.alias("c"), same).select("s.source", "s.size", "s.salt", "s.n", F.col("c.n").alias("all"), "copies", "source_size", "target")
    salts = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda x: F.floor(F.col("copies").cast(BIG) * x.cast("decimal(18,0)") / F.col("all").cast("decimal(18,0)")).cast("long")
    c = c.withColumn("upto", F.sum("n").over(salts))
    c = c.select(_cell(F.col("source"), F.col("size"), F.col("salt")).alias("cell"), "n", (share(F.col("upto")) - share(F.col("upto") - F.col("n"))).alias("copies"), "source_size", "target")
    return written(c, "mix-plan")


def _each(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with id, source, size, salt) with source_size, target and copies: a cell's copies are dealt by rank of id."""
    rank = F.row_number().over(Window.partitionBy("cell").orderBy("id")).cast("long")
    r = rows.withColumn("cell", _cell(F.col("source"), F.col("size"), F.col("salt"))).withColumn("k", rank)
    mine = F.expr("k * copies div n - (k - 1) * copies div n")
    p = plan.withColumnRenamed("cell", "cell2").hint("merge")  # grows with the documents: never broadcast
    return r.join(p, F.col("cell") == F.col("cell2")).withColumn("copies", mine).drop("cell", "cell2", "k", "n")


def _salts(docs: DataFrame, salts: int | None) -> int:
    """So many that a source's documents of one size lie in cells of about a million at most."""
    return salts or max(256, math.ceil(docs.count() / 1_000_000))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), budget: float = 1.5, salts: int | None = None) -> DataFrame:
    """Say for every row of docs how often the mix takes it.

    Returns one row per row of docs: ``id_col``, ``source_col``, size, source_size, target, copies (0 to 2),
    taken (copies * size).  A null or empty text has size 0 and takes part with one copy; a null source is a
    source of its own; rows that repeat an id are separate documents; an empty table gives no rows.  Other
    columns are not read.  Each source's taken words differ from its target by less than its smallest
    document that could still be added or left out.

    Documents of one source and size are alike up to hash cells of id and text, in each of which copies are
    dealt by rank of id, so neither a hot source nor thousands of equal texts meet in one task.
    """
    prepare(docs.sparkSession)
    rows = written(docs.select(*_sized(docs, id_col, text_col, source_col, _salts(docs, salts))), "mix-sizes")
    out = _each(rows, _dealt(rows, weights, budget))
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), budget: float = 1.5, salts: int | None = None) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs.

    Null ids are dealt by their texts.  Rows alike in id, text and source count as alike: which of them is
    repeated where a cell's copies do not divide evenly is not stated.
    """
    prepare(docs.sparkSession)
    sized = _sized(docs, id_col, text_col, source_col, _salts(docs, salts))
    plan = _dealt(docs.select(*sized), weights, budget)
    out = _each(docs.select(*sized, whole_row(docs).alias("row")), plan)
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")

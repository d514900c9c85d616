"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

A document's rate is how often the mix takes it. Among all rates between 0 and ``cap`` that give each source its
target of words, the chosen ones are nearest to "every document once" in relative entropy. Their form is an
exponential tilt, ``rate = min(cap, exp(lambda * size / mean size))`` with one multiplier for each source, and the
multipliers are the maximum of a convex dual. Newton steps (on the logarithm of the words taken, kept inside a bracket)
find them: each one is an aggregation over *cells*, the documents of one source and size, which have equal rates.

Rates become whole copies in three exact steps. Along the sizes of a source the running sum of ideal copies is rounded,
which leaves each source less than about one document from its target. Rounds of corrections then add or take back
copies of the largest size that still fits. Inside a cell the copies go to documents by a hash of their id.

Sums are decimals, so reruns give the same result whatever the order of rows. A source with a third of all documents
is summed before it is shuffled; a cell is ranked in parts of about 200 documents.

Defined cases: a null text has size 0; a document of size 0 is taken once; a null source is a source, the last one; a
row is a document even if its id repeats or is null. An empty table, or one without words, gives targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import fresh, stored

WEIGHTS = (5, 2, 1)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
TOLERANCE = 1e-7
RANKED = 200


def _total(x: Column) -> Column:
    return F.sum(x.cast("decimal(30,9)"))


def source_targets(cells: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(s, source, docs, source_size, target): one row for each source; ``s`` numbers them by code point, null last."""
    sources = cells.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    numbered = sources.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("s") - 1) % len(weights) + 1).cast("int"))
    capped = numbered.withColumn("w", weight).withColumn("most", F.col("source_size") * float(cap))
    # sources reach their cap in the order of cap / weight: each prefix of that order leaves one level for the others
    order = Window.orderBy(F.col("most") / F.col("w"), "s")
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    used = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    levels = capped.withColumn("level", (whole - used) / rest)
    ranked = levels.withColumn("at", F.row_number().over(order))
    settled = ranked.withColumn("first", F.min(F.when(F.col("most") >= F.col("w") * F.col("level"), F.struct("at", "level"))).over(Window.partitionBy()))
    target = F.when(F.col("at") < F.col("first.at"), F.col("most")).otherwise(F.least(F.col("most"), F.col("w") * F.col("first.level")))
    return settled.select("s", "source", "docs", "source_size", target.alias("target"))


def _rate(cap: int) -> Column:
    """The tilted rate; the exponent is cut where the rate is at its cap anyway."""
    return F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), F.col("lam") * F.col("size") / F.col("mean"))))


def _newton(cells: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """One step for every source that isn't settled."""
    x, rate = F.col("size") / F.col("mean"), _rate(cap)
    words = F.col("n") * F.col("size") * rate
    at = cells.join(state.select("s", "lam", "mean"), "s").groupBy("s").agg(_total(words).alias("words"), _total(F.when(rate < cap, words * x).otherwise(0.0)).alias("slope"))
    moved = state.drop("gap").join(at, "s").withColumn("words", F.col("words").cast("double")).withColumn("slope", F.col("slope").cast("double"))
    gap = F.when(F.col("target") > 0, F.abs(F.col("words") / F.col("target") - 1)).otherwise(0.0)
    low = F.when(F.col("words") < F.col("target"), F.col("lam")).otherwise(F.col("low"))
    high = F.when(F.col("words") > F.col("target"), F.col("lam")).otherwise(F.col("high"))
    moved = moved.withColumn("gap", gap).withColumn("low", low).withColumn("high", high)
    step = F.col("lam") + F.log(F.col("target") / F.col("words")) * F.col("words") / F.col("slope")
    inside = (F.col("slope") > 0) & (F.col("words") > 0) & (step > F.col("low")) & (step < F.col("high"))
    lam = F.when(F.col("gap") <= TOLERANCE, F.col("lam")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2)
    return moved.withColumn("lam", lam).drop("words", "slope")


def balanced(cells: DataFrame, targets: DataFrame, cap: int = CAP, most_steps: int = 60) -> DataFrame:
    """(s, source, docs, source_size, target, mean, lam): ``cells`` has s, size, n."""
    words = targets.where("source_size > 0")
    least = cells.where("size > 0").groupBy("s").agg(F.min("size").alias("least"))
    mean = F.col("source_size") / F.col("docs")
    full = F.col("target") >= F.col("source_size") * float(cap)
    top = F.log(F.lit(float(cap))) * mean / F.col("least")
    state = words.join(least, "s").select(
        "s", "target", mean.alias("mean"), F.when(full, top).otherwise(0.0).alias("lam"),
        (F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) * mean / F.col("least")) - 1e-9).alias("low"), (top + 1e-9).alias("high"), F.lit(1.0).alias("gap"),
    )
    state = stored(state.coalesce(1), "multipliers")  # a row for each source
    for _ in range(most_steps):
        state = stored(_newton(cells, state, cap).coalesce(1), "multipliers")  # a row for each source
        if (state.agg(F.max("gap")).first()[0] or 0.0) <= TOLERANCE:
            break
    return targets.join(state.select("s", "mean", "lam"), "s", "left").select("s", "source", "docs", "source_size", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"), F.coalesce("lam", F.lit(0.0)).alias("lam"))


def _rounded(cells: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """(s, size, n, copies): whole copies of each cell."""
    band = F.floor(F.log2(F.col("size") + 1) * 4)
    ideal = cells.join(sources.select("s", "mean", "lam"), "s").select("s", "size", "n", band.alias("band"), (F.col("n") * _rate(cap)).cast("decimal(28,9)").alias("ideal"))
    along = Window.partitionBy("s").orderBy(F.col("band").desc())
    bands = ideal.groupBy("s", "band").agg(F.sum("ideal").alias("all"))
    before = bands.select("s", "band", F.coalesce(F.sum("all").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("decimal(38,9)").alias("before"))
    inside = Window.partitionBy("s", "band").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = ideal.withColumn("upto", F.sum("ideal").over(inside)).join(before, ["s", "band"])
    upto = (F.col("before") + F.col("upto") + F.lit(0.5).cast("decimal(2,1)")).cast("decimal(38,9)")
    whole = F.floor(upto).cast("long") - F.floor((upto - F.col("ideal")).cast("decimal(38,9)")).cast("long")
    return run.select("s", "size", "n", F.greatest(F.lit(0), F.least(F.col("n") * cap, whole)).cast("long").alias("copies"))


def _corrected(cells: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """One round: each source changes the copies of the largest size that fits what it lacks, or what it has too much."""
    lack = cells.groupBy("s").agg(F.sum(F.col("copies") * F.col("size")).alias("words")).join(targets.select("s", "target"), "s").select("s", (F.col("target") - F.col("words")).alias("lack"))
    near = cells.join(lack, "s")
    room = F.when(F.col("lack") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies"))
    fits = near.where((F.col("size") > 0) & (room > 0) & (F.col("size") <= F.abs("lack")))
    pick = fits.groupBy("s").agg(F.max(F.struct(F.col("size"), F.least(room, F.floor(F.abs("lack") / F.col("size"))).cast("long").alias("by"), F.signum("lack").cast("long").alias("sign"))).alias("p"))
    more = F.when(F.col("size") == F.col("p.size"), F.col("p.by") * F.col("p.sign")).otherwise(0)
    return cells.join(pick, "s", "left").select("s", "size", "n", (F.col("copies") + F.coalesce(more, F.lit(0))).alias("copies"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, rounds: int = 8) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every row."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    base = stored(docs.select("doc_id", F.col(source).alias("source"), size.alias("size")), "sizes")
    counted = stored(base.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    targets = stored(source_targets(counted, weights, cap), "targets")
    same = counted["source"].eqNullSafe(targets["source"])
    cells = stored(counted.join(targets, same).select("s", "size", "n"), "cells")
    sources = stored(balanced(cells, targets, cap), "sources")
    made = stored(_rounded(cells, sources, cap), "copies")
    for _ in range(rounds):
        made = stored(_corrected(made, targets, cap), "copies")
    known = stored(made.join(sources.select("s", "source", "source_size", "target"), "s").select(F.col("source").alias("of"), F.col("size").alias("long"), "s", "n", "copies", "source_size", "target"), "known")
    parts = F.ceil(F.col("n") / RANKED)
    rows = base.join(known, base["source"].eqNullSafe(known["of"]) & (base["size"] == known["long"]))
    rows = rows.withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.pmod(F.col("h"), parts))
    counts = base.select("source", "size", "doc_id").join(known, base["source"].eqNullSafe(known["of"]) & (base["size"] == known["long"])).groupBy("s", "size", F.pmod(F.xxhash64("doc_id"), parts).alias("part")).agg(F.count("*").alias("here"))
    first = counts.select(F.col("s").alias("s2"), F.col("size").alias("size2"), F.col("part").alias("part2"), F.coalesce(F.sum("here").over(Window.partitionBy("s", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("s", "size", "part").orderBy("h", "doc_id")))
    ranked = ranked.join(first, (F.col("s") == F.col("s2")) & (F.col("size") == F.col("size2")) & (F.col("part") == F.col("part2")))
    extra = (F.col("before") + F.col("rank") <= F.col("copies") % F.col("n")).cast("long")
    copies = F.floor(F.col("copies") / F.col("n")).cast("long") + extra
    return ranked.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken. Rows that share an id share the largest number."""
    copies, same, turn = (fresh(x, docs.columns) for x in ("_copies", "_same", "_turn"))
    taken = mix(docs.select("doc_id", text, source), text, source).groupBy(F.col("doc_id").alias(same)).agg(F.max("copies").alias(copies))
    joined = docs.join(taken, docs["doc_id"].eqNullSafe(taken[same])).where(F.col(copies) > 0)
    return joined.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])

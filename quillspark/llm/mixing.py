"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

The rates r of documents are as near as possible (in relative entropy) to their
base rate 1 under the constraint that the words of each source add up to its target;
the solution is an exponential tilt by what the constraint counts, the words z of a
document: r = min(cap, exp(lambda_source * z)). The dual is convex in lambda and
separates by source. Documents of one source and size have one rate, so the dual needs
only (source, size) cells with their counts, summed before anything is shuffled.
Newton's method solves it: every iteration adds up the tilted words and their
derivative by source over the cells, again with partial sums, all sources at once; a
bracket around each lambda, halved where a step would leave it, makes it safe at the
caps. A source whose target is its cap has every document at the cap.

Rounding. A document is copied floor(r) times, and once more for a part of each cell:
within a source, in order of size, every position of the running sum of fractions that
crosses a whole number gives its cell one more copy. The words that a source then misses,
or has too many, are worked off on cells too: from the largest size down the nearest whole
number of copies is added or dropped. The documents of a cell that get the copy are those with the least hashes of
their contents. Cells of more than ``STRATUM_ROWS`` documents are dealt into slices by
the hash, each with its share, so that a source or a size with a third of all rows is
many groups; what leads back to the documents is a threshold for each slice.

Nothing depends on the order of rows or partitions: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from .workspace import bounded_broadcast, discard, materialize

#: Documents of a slice of a cell, about.
STRATUM_ROWS = 400
#: Cells that a size class (a binary order) of a source offers for working off the rest.
SPARE = 8
NEWTON_STEPS = 80
TOLERANCE = 1e-9
#: Newton steps between two written states.
STEPS_A_WRITE = 4
#: Fractions of copies are counted in millionths.
_UNIT = 1_000_000


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """(source, source_size, target): each source's words and target.

    Sources in order of code points, null last, have the ``weights``, repeating. They
    share ``share`` times all words by weight; no target exceeds ``cap`` times its
    source's words, and what is above is shared again by weight until none is above.
    ``sizes`` has the columns source and size.

    With ratios t = cap * words / weight in order, the sources up to some t are capped
    and the rest share what is left: one running sum finds how many, no iteration.
    """
    # one row a source from here on
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("t", F.col("source_size") * F.lit(float(cap)) / F.col("weight"))
    running = Window.orderBy("t", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy(F.lit(1))
    per = per.withColumn("below", F.sum(F.col("source_size")).over(running)).withColumn("weight_to", F.sum("weight").over(running))
    per = per.withColumn("all_size", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    # the share a unit of weight gets if exactly the sources before this one are capped
    level = (F.col("all_size") * F.lit(float(share)) - (F.col("below") - F.col("source_size")) * F.lit(float(cap))) / (F.col("all_weight") - F.col("weight_to") + F.col("weight"))
    per = per.withColumn("level", F.when(level <= F.col("t"), level))
    # capping a source too many lowers the level: the right one is the highest
    final = F.max("level").over(every)
    at = F.least(F.col("source_size") * F.lit(float(cap)), F.coalesce(final * F.col("weight"), F.col("source_size") * F.lit(float(cap))))
    return per.select("source", "source_size", at.cast("double").alias("target"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def entropy_rates(cells: DataFrame, targets: DataFrame, cap: float = 2.0) -> DataFrame:
    """(source, target, lambda, full) that balances the cells (source, size, docs) to the targets (source, target).

    Rates are min(cap, exp(lambda * size)). ``full``: the target is the cap of all words,
    every document with words has the cap; a source without words keeps 0. Stops when no source's words differ
    from its target by more than ``TOLERANCE`` of it.
    """
    per = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("words"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    own = targets.select(F.col("source").alias("s"), "target")
    state = own.join(per, _same("s", "source")).select("s", "target", ((F.col("words") > 0) & (F.col("target") >= F.col("words") * F.lit(cap * (1 - 1e-12)))).alias("full"), (F.col("words") > 0).alias("open"), (F.lit(60.0) / F.coalesce("least", F.lit(1))).alias("hi"))
    # at the ends of the bracket the smallest document has the rate exp(60), or all but none
    state = materialize(state.select("s", "target", "full", F.lit(0.0).alias("lam"), (-F.col("hi")).alias("lo"), "hi", (F.col("open") & ~F.col("full")).alias("open")), "mix-state")
    few = state.count()
    for _ in range(NEWTON_STEPS // STEPS_A_WRITE):
        if not state.where("open").limit(1).count():
            break
        nxt = state.where("open")
        for _ in range(STEPS_A_WRITE):
            nxt = _newton_step(cells, nxt, cap, few)
        nxt = materialize(nxt.union(state.where("NOT open")), "mix-state")
        discard(state)
        state = nxt
    return state.select(F.col("s").alias("source"), "target", F.col("lam").alias("lambda"), "full")


def _newton_step(cells: DataFrame, state: DataFrame, cap: float, few: int) -> DataFrame:
    """The state (s, target, full, lam, lo, hi, open) of unbalanced sources after one step."""
    rate = F.exp(F.col("lam") * F.col("size"))
    words = F.sum(F.col("docs") * F.col("size") * F.least(rate, F.lit(float(cap)))).alias("words")
    slope = F.sum(F.when(rate < cap, F.col("docs") * F.col("size") * F.col("size") * rate).otherwise(0.0)).alias("slope")
    keys = ["s", "target", "full", "lam", "lo", "hi"]
    summed = cells.where("size > 0").join(bounded_broadcast(state, few), _same("source", "s")).groupBy(*keys).agg(words, slope)
    gap = F.col("words") - F.col("target")
    lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
    step = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
    nxt = F.when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2)
    open_ = F.abs(gap) > F.col("target") * TOLERANCE
    return summed.select("s", "target", "full", F.when(open_, nxt).otherwise(F.col("lam")).alias("lam"), lo.alias("lo"), hi.alias("hi"), open_.alias("open"))


def mix(sizes: DataFrame, targets: DataFrame, cap: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of the rows (source, size, h): cells (s, z, docs, floor, extra, slices) and cuts (s, z, slice, t, need, ties).

    ``h`` is a hash of a row's contents. Each of a cell's ``docs`` rows is copied ``floor`` times
    and ``extra`` of them once more: by slice (h modulo ``slices``) the rows whose h is below
    ``t``, and ``need`` of the ``ties`` rows that have it. Null sources are a source. Copies
    never exceed ``cap``, a whole number.
    """
    cells = materialize(sizes.groupBy("source", "size").agg(F.count("*").alias("docs")), "mix-cells")
    lam = entropy_rates(cells, targets, cap)
    lam = lam.select(F.col("source").alias("s"), "target", "lambda", "full")
    # rates are rounded so that the order in which doubles were added cannot show
    rate = F.round(F.when(F.col("full") & (F.col("size") > 0), F.lit(float(cap))).otherwise(F.least(F.exp(F.col("lambda") * F.col("size")), F.lit(float(cap)))), 6)
    rated = cells.join(bounded_broadcast(lam, lam.count()), _same("source", "s")).withColumn("floor", F.floor(rate))
    rated = rated.withColumn("part", F.round((rate - F.col("floor")) * F.lit(float(_UNIT))).cast("long") * F.col("docs"))
    upto = F.sum("part").over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.lit(_UNIT // 2)
    extra = F.floor(upto / F.lit(_UNIT)) - F.floor((upto - F.col("part")) / F.lit(_UNIT))
    first = materialize(rated.select("source", "size", "docs", "floor", extra.alias("extra"), "target"), "mix-first")
    done = materialize(_work_off(first, cap), "mix-second")
    discard(cells, first)
    plan = _cuts(sizes, done)
    discard(done)
    return plan


def _work_off(cells: DataFrame, cap: float) -> DataFrame:
    """``cells`` (source, size, docs, floor, extra, target) with the words that a source misses, or has too many, worked off.

    The ``SPARE`` largest sizes of each binary order are offered; from the largest down the
    nearest whole number of copies is added or dropped. No step leaves more than there was.
    """
    copies = F.col("docs") * F.col("floor") + F.col("extra")
    rest = F.round(F.col("target") - F.sum(F.col("size") * copies).over(Window.partitionBy("source"))).cast("long")
    cells = cells.withColumn("copies", copies.cast("long")).withColumn("rest", rest)
    offers = cells.where((F.col("size") > 0) & (F.col("size") <= 2 * F.abs("rest")))
    best = Window.partitionBy("source", F.floor(F.log2("size"))).orderBy(F.desc("size"))
    offers = offers.withColumn("n", F.row_number().over(best)).where(F.col("n") <= SPARE).withColumn("most", (F.col("docs") * F.floor(F.lit(float(cap)))).cast("long"))
    listed = offers.groupBy("source", "rest").agg(F.sort_array(F.collect_list(F.struct("size", "copies", "most")), asc=False).alias("list"))
    start = F.struct(F.col("rest").alias("left"), F.expr("CAST(array() AS array<struct<size:bigint,more:bigint>>)").alias("use"))

    def take(acc, x):
        more = F.greatest(F.least(F.round(acc["left"] / x["size"]).cast("long"), x["most"] - x["copies"]), -x["copies"])
        return F.struct((acc["left"] - more * x["size"]).alias("left"), F.concat(acc["use"], F.array(F.struct(x["size"].alias("size"), more.alias("more")))).alias("use"))

    used = listed.select(F.col("source").alias("s"), F.explode(F.aggregate("list", start, take)["use"]).alias("u"))
    used = used.select("s", F.col("u.size").alias("z"), F.col("u.more").alias("more"))
    out = cells.join(used, _same("source", "s") & (F.col("size") == F.col("z")), "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0)))
    return out.select("source", "size", "docs", F.expr("copies DIV docs").alias("floor"), F.pmod("copies", "docs").alias("extra"))


def _cuts(sizes: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan of :func:`mix` from the cells (source, size, docs, floor, extra)."""
    cells = materialize(cells.select(F.col("source").alias("s"), F.col("size").alias("z"), "docs", "floor", "extra", F.ceil(F.col("docs") / F.lit(STRATUM_ROWS)).alias("slices")), "mix-plan")
    some = cells.where("extra > 0 AND extra < docs")
    count, most = some.agg(F.count("*"), F.max("slices")).first()
    rows = sizes.join(bounded_broadcast(some, count), _same("source", "s") & (F.col("size") == F.col("z")))
    rows = rows.select("s", "z", "h", "docs", "extra", F.pmod("h", "slices").alias("slice"))
    if most and most > 1:
        # a slice's share of its cell's copies: whole crossings of the running share
        dealt = rows.where(F.col("docs") > STRATUM_ROWS).groupBy("s", "z", "docs", "extra", "slice").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("s", "z").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        part = lambda at: F.floor(at.cast("decimal(19,0)") * F.col("extra") / F.col("docs")).cast("long")
        dealt = dealt.withColumn("upto", upto).select(F.col("s").alias("s2"), F.col("z").alias("z2"), F.col("slice").alias("slice2"), (part(F.col("upto")) - part(F.col("upto") - F.col("n"))).alias("quota"))
        dealt = materialize(dealt, "mix-slices")
        rows = rows.join(bounded_broadcast(dealt, dealt.count()), _same("s", "s2") & (F.col("z") == F.col("z2")) & (F.col("slice") == F.col("slice2")), "left")
        rows = rows.withColumn("quota", F.coalesce("quota", "extra"))
    else:
        rows = rows.withColumn("quota", F.col("extra"))
    stratum = Window.partitionBy("s", "z", "slice").orderBy("h")
    ranked = rows.withColumn("n", F.row_number().over(stratum)).withColumn("rank", F.rank().over(stratum)).withColumn("ties", F.count("*").over(stratum.rangeBetween(Window.currentRow, Window.currentRow)))
    cuts = ranked.where(F.col("n") == F.col("quota")).select("s", "z", "slice", F.col("h").alias("t"), (F.col("quota") - F.col("rank") + 1).cast("long").alias("need"), "ties")
    return cells, materialize(cuts, "mix-cuts")


def with_copies(rows: DataFrame, plan: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``rows`` (source, size, h and others) with ``copies``, by the plan of :func:`mix`.

    Joins with a row for each source and size, then for each slice that is copied in part. Rows of one
    hash stand for each other: where only a part of them gets a copy, any do.
    """
    cols = rows.columns
    cells, cuts = plan
    cuts = cuts.select(F.col("s").alias("s2"), F.col("z").alias("z2"), F.col("slice").alias("slice2"), "t", "need", "ties")
    count, tied = cuts.agg(F.count("*"), F.count_if(F.col("need") < F.col("ties"))).first()
    joined = rows.join(bounded_broadcast(cells, cells.count()), _same("source", "s") & (F.col("size") == F.col("z")))
    joined = joined.join(bounded_broadcast(cuts, count), _same("source", "s2") & (F.col("size") == F.col("z2")) & (F.pmod("h", "slices") == F.col("slice2")), "left")
    more = F.when(F.col("extra") >= F.col("docs"), 1).when(F.col("h") <= F.col("t"), 1).otherwise(0)
    copies = (F.col("floor") + more).cast("long").alias("copies")
    if not tied:
        return joined.select(*cols, copies)
    split = F.coalesce((F.col("h") == F.col("t")) & (F.col("need") < F.col("ties")), F.lit(False))
    same = Window.partitionBy("source", "size", "h").orderBy(F.lit(1))
    some_of = joined.where(split).withColumn("n", F.row_number().over(same))
    some_of = some_of.select(*cols, (F.col("floor") + (F.col("n") <= F.col("need")).cast("int")).cast("long").alias("copies"))
    return joined.where(~split).select(*cols, copies).union(some_of)


def _plain(kind: t.DataType) -> bool:
    """Types that can be hashed."""
    if isinstance(kind, t.ArrayType):
        return _plain(kind.elementType)
    if isinstance(kind, t.StructType):
        return all(_plain(f.dataType) for f in kind.fields)
    return not isinstance(kind, (t.MapType, t.VariantType))


def _content(docs: DataFrame, cols: list[str]) -> Column:
    return F.xxhash64(*(F.col(f"`{c}`") for c in cols if _plain(docs.schema[c].dataType)))


def mixture(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each row.

    A null text has size 0, null sources are one source, the last. Rows that repeat a
    doc_id, or have none, are mixed each by its own text; of rows that are alike in id,
    source and text any may get a copy. An empty table gives an empty table; other
    columns are ignored.
    """
    h = F.xxhash64(F.col("doc_id").cast("long"), "source", "text")
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), h.alias("h")), "mix-sizes")
    targets = materialize(source_targets(sized), "mix-targets")
    mixed = with_copies(sized, mix(sized, targets))
    per = bounded_broadcast(targets.withColumnRenamed("source", "s"), targets.count())
    return mixed.join(per, _same("source", "s")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: 150 % of all words, weights 3, 1, 2, at most two copies. Odd rows as in :func:`mixture`."""
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it, in the columns of documents.

    Whether a row is copied follows from a hash of all its columns, so rows with null or
    repeated ids are mixed each on its own; documents without words keep one copy. Columns of any name are kept as they are.
    """
    cols = docs.columns
    rows = docs.select("source", word_count(F.col("text")).alias("size"), _content(docs, cols).alias("h"), F.struct(*(F.col(f"`{c}`") for c in cols)).alias("row"))
    sized = materialize(rows.select("source", "size", "h"), "mix-sizes")
    plan = mix(sized, materialize(source_targets(sized), "mix-targets"))
    discard(sized)
    taken = with_copies(rows, plan).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")

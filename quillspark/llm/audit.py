"""Filter interactions: what each filter of a chain removes, in any order, from joint-failure counts.

The corpus is read once. For each part and each set S of filters the rows that fail
all of S are counted, J(S): a sum of flag products, mergeable and combined before the
shuffle. Everything else follows from these 2^k numbers of a part:

* rows that fail none of Q, by inclusion and exclusion over the subsets of Q:
  ``kept(Q) = sum (-1)^|S| J(S)``; a filter i after those of P removes
  ``kept(P) - kept(P + i)`` and finds ``J(i)`` less that already gone;
* rows that fail exactly T, by Moebius inversion over the supersets of T;
* the Shapley value of "rows removed": the dividend (Harsanyi) of S is
  ``(-1)^(|S|+1) J(S)``, shared equally by its members.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import bounded_broadcast

#: Characters that apart from letters part words (fixed values), as a class of a pattern.
_WORD = r"[^\x20\x09-\x0D]+"
#: Keys over which rows without an id are spread in the join with the labels.
_SPREAD = 4096


def joint_failures(cells: DataFrame, k: int, counts: list[str], part: str = "part") -> DataFrame:
    """A row for each part: for each of ``counts`` an array of J(S) for S = 0 .. 2^k - 1.

    ``cells``: (part, fails, *counts), ``fails`` the bits of the failed filters. Equal cells
    add up; a null count is 0.
    """
    small = cells.groupBy(part, "fails").agg(*(F.sum(c).alias(c) for c in counts))
    sets = small.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1))))
    # the product of the flags of all filters of s
    product = (F.col("fails").bitwiseAND(F.col("s")) == F.col("s")).cast("long")
    sums = sets.groupBy(part, "s").agg(*(F.coalesce(F.sum(F.col(c) * product), F.lit(0)).alias(c) for c in counts))
    # exactly 2^k rows of a part meet here
    rows = sums.groupBy(part).agg(F.array_sort(F.collect_list(F.struct("s", *counts))).alias("all"))
    return rows.select(part, *(F.col(f"all.{c}").alias(c) for c in counts))


def interactions(cells: DataFrame, filters: str, part: str = "part", lost: dict[str, str] | None = None) -> DataFrame:
    """Every order of the filters, step by step, for each part.

    ``cells``: (part, fails, n, ...), the number of rows of a part for each set of failed
    filters; ``filters``: a letter for each bit of ``fails``; ``lost``: more counts of ``cells``
    and the columns in which their removed rows are returned. Columns: part, filter_order,
    step, kept, removed, redundant, unique_fails, those of ``lost``, shapley (over all
    orders: k! times the mean), filter. A part without rows has no lines; no cells, no lines.
    """
    k, lost = len(filters), lost or {}
    sets = F.sequence(F.lit(0), F.lit((1 << k) - 1))

    def total(term) -> Column:
        """The sum of a term over all sets of filters."""
        return F.aggregate(sets, F.lit(0).cast("long"), lambda acc, s: acc + term(s))

    def sign(s: Column) -> Column:
        return 1 - 2 * (F.bit_count(s) % 2)

    def within(s: Column, q: Column) -> Column:
        return s.bitwiseAND(q) == s

    def kept(c: str) -> Column:
        """For each set the rows that fail none of it."""
        return F.transform(sets, lambda q: total(lambda s: F.when(within(s, q), sign(s) * F.col(c)[s]).otherwise(0)))

    def of_filter(weight) -> Column:
        """For each filter a weighted sum over the sets that hold it."""
        return F.transform(F.array(*(F.lit(1 << i) for i in range(k))), lambda bit: total(lambda s: F.when(within(bit, s), weight(s) * F.col("n")[s]).otherwise(0)))

    facts = joint_failures(cells, k, ["n", *lost], part).select(
        part,
        *(kept(c).alias(f"kept_{c}") for c in ("n", *lost)),
        F.transform(F.array(*(F.lit(1 << i) for i in range(k))), lambda bit: F.col("n")[bit]).alias("fail"),
        of_filter(lambda s: -sign(s)).alias("only"),
        # each dividend times k!, in equal shares
        of_filter(lambda s: -sign(s) * F.floor(F.lit(factorial(k)) / F.bit_count(s))).alias("share"),
    )
    orders = ["".join(p) for p in permutations(filters)]
    steps = facts.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.array(*(F.lit(i + 1) for i in range(k)))))
    before = F.lit(0)
    for i, letter in enumerate(filters):
        before = before + F.when(F.instr("filter_order", letter) < F.col("step"), 1 << i).otherwise(0)
    steps = steps.withColumn("filter", F.expr("substring(filter_order, step, 1)")).withColumn("before", before)
    steps = steps.withColumn("i", F.instr(F.lit(filters), F.col("filter")) - 1).withColumn("after", F.col("before") + F.expr("shiftleft(1, i)"))

    def gone(c: str) -> Column:
        """Rows that fail the filter and none before it."""
        return F.col(f"kept_{c}")[F.col("before")] - F.col(f"kept_{c}")[F.col("after")]

    return steps.select(
        part,
        "filter_order",
        "step",
        F.col("kept_n")[F.col("after")].alias("kept"),
        gone("n").alias("removed"),
        (F.col("fail")[F.col("i")] - gone("n")).alias("redundant"),
        F.col("only")[F.col("i")].alias("unique_fails"),
        *(gone(c).alias(name) for c, name in lost.items()),
        F.col("share")[F.col("i")].alias("shapley"),
        "filter",
    )


def document_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, good, toxic): documents of each part by the filters ABCDE that they fail.

    Bits of ``fails``: 1 under 200 words; 2 fewer distinct words than half of the words;
    4 over 2 % of A-Z; 8 one of ``#$%&*|``; 16 a text that a smaller doc_id has too.
    A null text or source is empty. Rows without an id are smaller than none and have no
    smaller one; repeated rows count each. ``good`` and ``toxic`` count documents for which
    any label row says 1; labels without an id say nothing.

    Rows of a text are brought together only as counts: a text that a third of the corpus
    repeats is a line for each part and task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)).alias("words"))
    n, t = F.size("words"), F.col("text")
    fails = (
        F.when(n < 200, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct("words")) < 50 * n, 2).otherwise(0)
        + F.when(100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long") > 2 * F.length(t).cast("long"), 4).otherwise(0)
        + F.when(t.rlike(r"[#$%&*|]"), 8).otherwise(0)
    )
    rows = words.select("doc_id", "part", fails.alias("fails"), F.unhex(F.sha2(t, 256)).alias("digest"))

    said = labels.where(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
    said = said.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    said = bounded_broadcast(said, labels.count())
    # rows without an id find no label: they are spread, not gathered at the null key
    spread = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(_SPREAD)) + 1).otherwise(0)
    rows = rows.withColumn("spread", spread).join(said.withColumn("spread", F.lit(0).cast("long")).withColumnRenamed("label_id", "doc_id"), ["doc_id", "spread"], "left")
    rows = rows.select("digest", "part", "fails", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "doc_id")

    one = ["digest", "part", "fails", "good", "toxic"]
    by_id = rows.groupBy(*one, "doc_id").agg(F.count("*").alias("n"))
    groups = by_id.groupBy(*one).agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
    )
    # of a text there are at most four groups a part here
    groups = groups.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("digest")))
    new = F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = groups.withColumn("new", new).select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("fails"), F.col("new").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("new")).alias("n")))).alias("x"))
    return both.select("part", "x.fails", "x.n", (F.col("x.n") * F.col("good")).alias("good"), (F.col("x.n") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The 120 orders of the filters of :func:`document_cells`, a row for each part, order and step.

    Columns as in :func:`interactions`, with good_lost and toxic_lost. An empty table of
    documents gives no rows; other columns of either table are ignored.
    """
    return interactions(document_cells(docs, labels), "ABCDE", lost={"good": "good_lost", "toxic": "toxic_lost"})


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with ``labels``. Odd rows as in :func:`audit`."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE_OP13 = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(said.good, 0) AS good, coalesce(said.toxic, 0) AS toxic,
  CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
  + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN w.doc_id > first_id THEN 16 ELSE 0 END AS fails
  FROM w LEFT JOIN said ON w.doc_id = said.doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT o, s, substr(o, s, 1) AS filter, list_sum(list_transform(string_split(substr(o, 1, s - 1), ''), lambda x: CASE x WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 WHEN 'E' THEN 16 ELSE 0 END))::BIGINT AS before FROM orders, range(1, 6) r(s)),
bits AS (SELECT *, (1 << (ascii(filter) - 65))::BIGINT AS bit FROM steps),
per AS (SELECT part, o, s, filter,
  sum(n) FILTER (fails & (before | bit) = 0) AS kept,
  sum(n) FILTER (fails & before = 0 AND fails & bit > 0) AS removed,
  sum(n) FILTER (fails & before > 0 AND fails & bit > 0) AS redundant,
  sum(n) FILTER (fails = bit) AS unique_fails,
  sum(good) FILTER (fails & before = 0 AND fails & bit > 0) AS good_lost,
  sum(toxic) FILTER (fails & before = 0 AND fails & bit > 0) AS toxic_lost
  FROM cells, bits GROUP BY part, o, s, filter)
SELECT part, o AS filter_order, s::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, filter), 0)::BIGINT AS shapley, filter FROM per"""

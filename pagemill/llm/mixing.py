"""Mixing sources to target weights by hierarchical budgets.

Rows hang on leaves of a tree of columns (domain, language, source).  The token
budget goes down from the root: a node's children share it by weight, a child
takes at most its capacity (its tokens times MAX_EPOCHS), and what it can't
take goes to its siblings by weight.  As no node is given more than its whole
subtree holds, a shortage leaves a family only when all of it is full, and is
then made up by the nearest ancestor's other children.  Nodes stay tables: a
level at a time, a family is one window over its children's rows.

A leaf with budget b takes all its rows for each full epoch, and of the last
one the rows, in an order seeded by (seed, epoch, doc_id), whose running
sum of tokens is within what is left.  The order is that of 60 bits of an MD5,
then doc_id, then tokens, whatever the size of the leaf.  Where it is cut is
found digit by digit, ten bits at a time: sums of a leaf's 1,024 first digits,
then of the second ones under the digit that holds the cut, then the rows
under both, about one in 2 ** 20 of the leaf's.

Null or missing levels are the value ''.  Null text has no tokens; rows
without tokens come with each epoch that reaches them.  Rows of the same
doc_id, levels and tokens are one row with a count until the end, so many of
them (a null id, repeated rows) are never many rows of one task; how many of
them the cut lets through is worked out.  Very long texts only count.  Ties in
the order stand by doc_id (null first), then tokens.  Weights default to 1 for
nodes not named; a node of weight 0 only takes what its siblings can't.  An
empty table gives no rows.  Input columns besides doc_id, text and the levels
don't matter, whatever they are called.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, spread_join, table, written

LEVELS = ("domain", "lang", "source")
#: Of the tokens there are; and how often a row may come at most.
BUDGET_SHARE, MAX_EPOCHS, SEED = 0.6, 3, 20240601
#: Copies of a row that one step writes out.
COPIES = 1 << 16
#: (path of names) -> weight among its siblings
WEIGHTS: dict[tuple[str, ...], float] = {("web",): 3.0, ("books",): 4.0, ("forum",): 2.0, ("reference",): 1.0, ("web", "en"): 2.0, ("books", "en"): 2.0}
DOMAINS = ("web", "books", "forum", "reference")


def domain_of(source: Column) -> Column:
    """Stands in for a catalogue of sources: by the number in a source's name, modulo four."""
    n = F.coalesce(F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS bigint)"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), (n % len(DOMAINS) + 1).cast("int"))


def n_tokens(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def _weight(path: list[str], weights: dict[tuple[str, ...], float]) -> Column:
    named = [(k, v) for k, v in weights.items() if len(k) == len(path)]
    out = F.lit(1.0)
    for names, value in named:
        out = F.when(reduce(and_, (F.col(c) == n for c, n in zip(path, names, strict=True))), F.lit(float(value))).otherwise(out)
    return out


def shared_out(children: DataFrame, family: list[str], names: list[str]) -> DataFrame:
    """children (family, names, weight, capacity, budget of the family) with part: by weight, none above its capacity.

    In the order of capacity by weight the children that are filled come first; the rest share what is left.  Children
    without weight follow behind all others, as equals.
    """
    zero = (F.col("weight") <= 0).cast("int")
    rows = children.withColumn("_last", zero).withColumn("_w", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0))
    rows = rows.withColumn("_ratio", F.col("capacity") / F.col("_w"))
    of = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    kind = Window.partitionBy(*family, "_last")
    before = F.coalesce(F.sum("capacity").over(of.orderBy("_last", "_ratio", *names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("_left", F.col("budget") - before)
    rows = rows.withColumn("_rest", F.sum("_w").over(kind.orderBy("_ratio", *names).rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("_full", F.col("capacity") <= F.col("_left") * F.col("_w") / F.col("_rest"))
    # it falls from one child that is not filled to the next: the first one's counts
    level = F.max(F.when(~F.col("_full"), F.col("_left") / F.col("_rest"))).over(kind)
    part = F.when(F.col("_full"), F.col("capacity")).otherwise(F.greatest(F.lit(0.0), level * F.col("_w")))
    return rows.withColumn("part", part).drop("_last", "_w", "_ratio", "_left", "_rest", "_full")


def budgets(leaves: DataFrame, levels: tuple[str, ...], share: float, weights: dict[tuple[str, ...], float], epochs: int) -> DataFrame:
    """leaves (levels, tokens) with goal: the tokens that each is to give."""
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    above, known = None, []
    for depth in range(1, len(levels) + 1):
        names = list(levels[:depth])
        nodes = leaves.groupBy(*names).agg((F.sum("tokens") * float(epochs)).alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(names, weights))
        nodes = nodes.withColumn("budget", F.lit(float(min(share, epochs) * total))) if above is None else nodes.join(above, known)
        # a table a level: the driver plans one level at a time
        above = written(shared_out(nodes, known, names).select(*names, F.col("part").alias("budget")), "level")
        known = names
    return leaves.join(above.withColumnRenamed("budget", "goal"), list(levels))


def _cut(rows: DataFrame, levels: tuple[str, ...], digit: str, reached: Column) -> DataFrame:
    """(levels, cut, before): of each leaf the digit in which the running sum of tokens passes rest, and the sum before it."""
    sums = rows.groupBy(*levels, F.col(digit).alias("cut")).agg(F.sum("weight").alias("sum"), F.first("rest").alias("rest"), F.first(reached).alias("reached"))
    before = F.col("reached") + F.sum("sum").over(Window.partitionBy(*levels).orderBy("cut")) - F.col("sum")
    return sums.withColumn("before", before).where("before <= rest AND before + sum > rest").select(*levels, "cut", "before")


def _copied(rows: DataFrame, n: str) -> DataFrame:
    """rows, each as often as its column n says, which goes."""
    some = rows.where(F.col(n) > 0).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / COPIES))))
    return some.withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col(n) - F.col("_i") * COPIES)))).drop("_i", "_j", n)


def order_of(seed: int, epoch: Column, doc_id: Column) -> Column:
    """The place of a row in an epoch: 60 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), epoch, F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")


def mixed(docs: DataFrame, levels: tuple[str, ...] = LEVELS, weights: dict[tuple[str, ...], float] | None = None, share: float = BUDGET_SHARE, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, the levels, epoch, n_tokens: a row for each time that a document is taken."""
    level = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels]
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *level, n_tokens(F.col("text")).alias("n_tokens"))
    rows = written(small.groupBy("doc_id", *levels, "n_tokens").agg(F.count(F.lit(1)).alias("copies")), "mix")
    leaves = written(rows.groupBy(*levels).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("rows")), "leaves")
    goal = budgets(leaves, levels, share, WEIGHTS if weights is None else weights, epochs)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("goal") / F.col("tokens"))).otherwise(0)
    plan = goal.withColumn("full", full.cast("int")).withColumn("rest", F.floor(F.col("goal") - F.col("full") * F.col("tokens")).cast("long"))
    plan = written(plan.select(F.array(*levels).alias("leaf"), "full", "rest", "rows"), "plan")
    # a leaf may hold a third of all rows: its row of the plan goes to them
    marked = written(spread_join(rows.withColumn("leaf", F.array(*levels)), plan, "leaf", "rows").drop("rows"), "marked")
    forget(rows)
    every = _copied(marked.where("full > 0"), "copies").select("doc_id", *levels, F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"), "n_tokens")

    partial = marked.where("rest > 0").withColumn("h", order_of(seed, F.col("full"), F.col("doc_id"))).withColumn("weight", F.col("n_tokens") * F.col("copies"))
    partial = partial.withColumn("d1", F.shiftright("h", 50)).withColumn("d2", F.shiftright("h", 40).bitwiseAND(F.lit(1023)))
    one = written(_cut(partial, levels, "d1", F.lit(0).cast("long")).select(F.array(*levels).alias("leaf"), F.col("cut").alias("c1"), F.col("before").alias("b1")).join(plan.select("leaf", "rows"), "leaf"), "cut")
    under = spread_join(partial, one, "leaf", "rows").drop("rows")
    two = written(_cut(under.where("d1 = c1"), levels, "d2", F.col("b1")).select(F.array(*levels).alias("leaf"), F.col("cut").alias("c2"), F.col("before").alias("b2")).join(one, "leaf"), "cut")
    # stored, as the rows before the cut and those at it are two reads of it
    placed = written(spread_join(partial, two, "leaf", "rows").drop("leaf", "rows"), "placed")
    before = F.col("b2") + F.sum("weight").over(Window.partitionBy(*levels).orderBy("h", "doc_id", "n_tokens")) - F.col("weight")
    room = F.when(F.col("n_tokens") > 0, F.floor((F.col("rest") - F.col("before")) / F.col("n_tokens"))).otherwise(F.when(F.col("before") <= F.col("rest"), F.col("copies")).otherwise(0))
    last = placed.where("d1 = c1 AND d2 = c2").withColumn("before", before).withColumn("copies", F.least(F.col("copies"), room))
    sure = placed.where("d1 < c1 OR (d1 = c1 AND d2 < c2)")
    out = ("doc_id", *levels, F.col("full").alias("epoch"), "n_tokens", "copies")
    return every.unionByName(_copied(sure.select(*out).unionByName(last.select(*out)), "copies"))


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixed(docs.withColumn("domain", domain_of(F.col("source"))))


def _sql_level(names: list[str], known: list[str]) -> str:
    """One level of the budget: shares by weight, capped, shortages to siblings."""
    weight = " ".join(f"WHEN {' AND '.join(f"{c} = '{n}'" for c, n in zip(names, k, strict=True))} THEN {v}e0" for k, v in WEIGHTS.items() if len(k) == len(names))
    d, family = len(names), ", ".join(known) or "1"
    path = ", ".join(names)
    of = f"OVER (PARTITION BY {family} ORDER BY ratio, {path}"
    source = f"FROM nodes{d} JOIN part{d - 1} USING ({', '.join(known)})" if known else f"FROM nodes{d}, part0"
    return f"""
nodes{d} AS (SELECT {path}, sum(tokens) * {MAX_EPOCHS}.0e0 AS capacity, CASE {weight or 'WHEN false THEN 0'} ELSE 1.0e0 END AS weight FROM leaves GROUP BY ALL),
ranked{d} AS (SELECT *, capacity / weight AS ratio {source}),
sized{d} AS (SELECT *, budget - coalesce(sum(capacity) {of} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining, sum(weight) {of} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others FROM ranked{d}),
filled{d} AS (SELECT *, capacity <= remaining * weight / others AS filled FROM sized{d}),
part{d} AS (SELECT {path}, CASE WHEN filled THEN capacity ELSE greatest(0, weight * max(CASE WHEN NOT filled THEN remaining / others END) OVER (PARTITION BY {family})) END AS budget FROM filled{d})"""


#: All weights are positive here.
OP3_SQL = f"""
WITH docs AS (SELECT doc_id, {list(DOMAINS)}[coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS BIGINT), 0) % {len(DOMAINS)} + 1] AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM docs GROUP BY ALL),
part0 AS (SELECT sum(tokens) * {BUDGET_SHARE}e0 AS budget FROM leaves),
{",".join(_sql_level(list(LEVELS[:d]), list(LEVELS[: d - 1])) for d in range(1, len(LEVELS) + 1))},
plan AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(floor(budget / tokens) AS INT) ELSE 0 END AS reach FROM leaves JOIN part{len(LEVELS)} USING (domain, lang, source)),
marked AS (SELECT docs.*, reach, floor(budget - reach * tokens) AS rest, substring(md5('{SEED}:' || reach || ':' || doc_id), 1, 15) AS h FROM docs JOIN plan USING (domain, lang, source)),
cut AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS running FROM marked WHERE rest > 0)
SELECT doc_id, domain, lang, source, CAST(unnest(range(reach)) AS INT) AS epoch, n_tokens FROM marked WHERE reach > 0
UNION ALL SELECT doc_id, domain, lang, source, reach, n_tokens FROM cut WHERE running <= rest
"""

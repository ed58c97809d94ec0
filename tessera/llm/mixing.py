"""Mixing sources to target weights by hierarchical budgeting.

Sources form a tree: domain, language, source. The token budget goes down the tree by
weight. A node that can't use its share gives the rest to its siblings; only what all of
them can't use reaches other branches, as a node's capacity already counts all below it.
Each leaf turns its budget into whole epochs and a token-prefix of one more, in an order
seeded for leaf and epoch.

A prefix is found without sorting a leaf: its tokens are summed by 256 ranges of the order
key, then by 256 ranges of the one where the budget ends, and only the documents in that
1/65536 are ordered. What remains per leaf is one cut-off key, so documents are then
selected where they are, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise
from .skew import attach

LEVELS = ("domain", "lang", "source")
#: Weights of nodes by their path; 1 for others.
WEIGHTS = {("curated",): 2.0, ("web",): 1.0, ("curated", "en"): 2.0, ("web", "en"): 2.0}


def domain_of(source: Column) -> Column:
    """The table has no domain: sources are dealt to two by digest."""
    return F.when(F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1) < "8", F.lit("curated")).otherwise(F.lit("web"))


def word_count(text: Column) -> Column:
    """Words as spaces plus one; 0 for null or empty."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60 bits of MD5 over seed, epoch and id."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def _weight(columns: list[str], weights: dict) -> Column:
    out = F.lit(1.0)
    for path, w in weights.items():
        if len(path) == len(columns):
            match = F.lit(True)
            for c, value in zip(columns, path, strict=True):
                match = match & (F.col(c) == value)
            out = F.when(match, F.lit(float(w))).otherwise(out)
    return out


def _fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Share ``budget`` (the parent's, at most its capacity) among siblings by ``weight`` up to ``capacity``.

    In order of capacity per weight, siblings saturate as long as an equal level for those
    left reaches their capacity; the first that doesn't sets the level of all others.
    """
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    before = group.orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
    used, weights = F.coalesce(F.sum("capacity").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    out = out.withColumn("left", F.sum("weight").over(group) - weights)
    out = out.withColumn("level", F.when(F.col("left") > 0, (F.col("budget") - used) / F.col("left")).otherwise(F.lit(0.0)))
    out = out.withColumn("full", F.col("ratio") <= F.col("level") * (1 + 1e-12))
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(group)
    return out.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.col("weight") * common)).drop("ratio", "left", "level", "full")


def leaf_budgets(leaves: DataFrame, budget: int, weights: dict, max_epochs: int) -> DataFrame:
    """``leaves`` (LEVELS, n_docs, tokens) plus ``epochs`` and ``rest``: whole epochs, and tokens of one more."""
    path = list(LEVELS)
    nodes = leaves.withColumn("capacity", F.when(_weight(path, weights) > 0, F.col("tokens") * max_epochs).otherwise(0).cast("double"))
    levels = [nodes.groupBy(*path[: k + 1]).agg(F.sum("capacity").alias("capacity")) for k in range(len(path))]
    # A node of weight 0 takes nothing, so its capacity doesn't count above it either.
    for k in range(len(path) - 1, -1, -1):
        w = _weight(path[: k + 1], weights)
        levels[k] = levels[k].withColumn("weight", w).withColumn("capacity", F.when(w > 0, F.col("capacity")).otherwise(0.0))
        if k:
            levels[k - 1] = levels[k].groupBy(*path[:k]).agg(F.sum("capacity").alias("capacity"))
    everything = F.sum("capacity").over(Window.partitionBy(F.lit(0)))
    done = _fill(levels[0].withColumn("budget", F.least(F.lit(float(budget)), everything)), [], path[0])
    for k in range(1, len(path)):
        done = _fill(levels[k].join(done.select(*path[:k], "budget"), path[:k]), path[:k], path[k])
    out = leaves.join(done.select(*path, F.floor(F.col("budget") + 1e-6).alias("budget")), path)
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    return out.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))


def _boundary(sums: DataFrame) -> DataFrame:
    """``leaf, bucket, before``: the first bucket that the leaf's ``rest`` doesn't hold, and the tokens before it."""
    order = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("through", F.sum("tokens").over(order)).where("through > rest").groupBy("leaf").agg(F.min("bucket").alias("bucket"), F.min(F.col("through") - F.col("tokens")).alias("before"))


def mix(docs: DataFrame, share: float = 0.9, weights: dict | None = None, max_epochs: int = 4, seed: int = 11, id_col: str = "doc_id", domain: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """All rows of ``docs`` plus ``domain, tokens, epochs, copies, cut_tokens``.

    The budget is ``share`` of all tokens. ``copies`` counts how often the whole document is
    selected: ``epochs`` passes over its leaf and one more if it lies in the prefix. The
    prefix of tokens may end inside a document; there ``cut_tokens`` is how many of its
    first tokens are selected once more (0 for all others), so that ``copies * tokens +
    cut_tokens`` over all rows is the budget.

    A leaf of unknown domain, language or source counts under the empty name. Documents
    without tokens (null or empty texts) take none and follow their place in the order;
    equal keys go by id, null ids first. Rows that repeat an id are selected together, and
    none of them is cut. Texts of any length count whole. An empty table gives an empty
    result. Input columns with the name of a result column are replaced, except ``domain``
    if it is given; other names are free but for those that begin with two underscores.
    """
    weights = WEIGHTS if weights is None else weights
    domain = domain_of(F.col("source")) if domain is None else domain
    tokens = word_count(F.col("text")) if tokens is None else tokens
    results = ["domain", "tokens", "epochs", "copies", "cut_tokens"]
    keep = [c for c in docs.columns if c not in results]
    name = lambda c: F.coalesce(c, F.lit(""))
    path = {"domain": name(domain), "lang": name(F.col("lang")), "source": name(F.col("source"))}
    leaf = F.struct(*[path[c].alias(c) for c in LEVELS])
    narrow = materialise(docs.select(F.col(id_col).alias("id"), leaf.alias("leaf"), tokens.alias("tokens")))
    leaves = materialise(narrow.groupBy("leaf").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("tokens")).select("leaf.*", "n_docs", "tokens"))
    total = leaves.agg(F.sum("tokens").alias("n"), F.sum("n_docs").alias("docs")).first()
    n_docs = total["docs"] or 0
    plan = leaf_budgets(leaves, int(share * (total["n"] or 0)), weights, max_epochs)
    plan = materialise(plan.select(F.struct(*LEVELS).alias("leaf"), "n_docs", "epochs", "rest"))
    keyed = attach(narrow, plan, "leaf", "n_docs", n_docs).withColumn("key", order_key(seed, F.col("epochs"), F.col("id")))
    keyed = materialise(keyed.where("rest > 0").select("id", "leaf", "tokens", "rest", "key"))
    high, low = F.shiftright("key", 52), F.shiftright("key", 44).bitwiseAND(255)
    one = _boundary(keyed.groupBy("leaf", high.alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest")))
    one = materialise(plan.select("leaf", "n_docs").join(one.select("leaf", F.col("bucket").alias("b1"), F.col("before").alias("t1")), "leaf"))
    inside = attach(keyed, one, "leaf", "n_docs", n_docs).where(high == F.col("b1")).withColumn("rest", F.col("rest") - F.col("t1"))
    inside = materialise(inside.select("id", "leaf", "tokens", "rest", "key", "b1"))
    two = _boundary(inside.groupBy("leaf", low.alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest")))
    # Documents of the last range, in order, rows of one id together; the budget ends in one of them.
    last = inside.join(two.select("leaf", F.col("bucket").alias("b2"), F.col("before").alias("t2")), "leaf").where(low == F.col("b2"))
    last = last.groupBy("leaf", "b1", "b2", "key", "id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"), F.first(F.col("rest") - F.col("t2")).alias("room"))
    last = last.withColumn("through", F.sum("tokens").over(Window.partitionBy("leaf").orderBy("key", "id")))
    fits, left = F.col("through") <= F.col("room"), F.col("room") - F.col("through") + F.col("tokens")
    ends = F.struct("key", "id", F.when(F.col("rows") == 1, left).otherwise(0).alias("tokens"))
    cut = last.groupBy("leaf", "b1", "b2").agg(F.max(F.when(fits, F.struct("key", "id"))).alias("last"), F.min(F.when(~fits, ends)).alias("end"))
    start = (F.shiftleft(F.col("b1"), 52) + F.shiftleft(F.col("b2"), 44)).cast("long")
    cut = cut.select("leaf", F.coalesce(F.col("last.key"), start - 1).alias("cut_key"), F.col("last.id").alias("cut_id"), "end")
    plan = plan.join(cut, "leaf", "left").select(F.col("leaf").alias("__leaf"), F.col("n_docs").alias("__n"), F.struct("epochs", "rest", "cut_key", "cut_id", "end").alias("__plan"))
    plan = materialise(plan)

    rows = docs.select(*keep, leaf.alias("__leaf"), tokens.alias("__tokens"))
    of = lambda c: F.col(f"__plan.{c}")
    rows = attach(rows, plan, "__leaf", "__n", n_docs).withColumn("__order", order_key(seed, of("epochs"), F.col(id_col)))
    key = F.col("__order")
    within = (key < of("cut_key")) | ((key == of("cut_key")) & F.coalesce(F.col(id_col) <= of("cut_id"), F.lit(True)))
    copies = of("epochs") + F.when((of("rest") > 0) & F.coalesce(within, F.lit(True)), 1).otherwise(0)
    ended = (of("rest") > 0) & (key == of("end.key")) & F.col(id_col).eqNullSafe(of("end.id"))
    cut_tokens = F.when(ended, of("end.tokens")).otherwise(0).cast("long")
    return rows.select(*keep, F.col("__leaf.domain").alias("domain"), F.col("__tokens").alias("tokens"), of("epochs").alias("epochs"), copies.cast("long").alias("copies"), cut_tokens.alias("cut_tokens"))

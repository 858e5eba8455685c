"""Mixing sources to target weights (operator 8): hierarchical budgeting.

Sources form a tree: domain, language, source. A total token budget flows down from the root
by the nodes' weights. A child cannot take more than its supply (its documents' tokens times
max_epochs); what it leaves goes to its siblings by their weights. Only what all siblings
together cannot take goes to the parent's siblings: a parent's share is limited by the sum of
its children's supply. All shares are whole numbers in exact integer arithmetic; a node's
undividable rest (under one token for each child) is left.

A leaf whose budget is b and whose documents have s tokens takes b div s whole epochs, then
a prefix of the next epoch: documents in the order of md5(seed, epoch, doc_id) while their
running sum stays within the rest. The prefix is found without ordering a leaf in one place:
token sums by the first three digits of the md5 (4096 bins a leaf), then an ordered sum inside the
one bin that the budget ends in.

DataFrame functions only. Defined cases: a null domain, lang or source is the node
'unknown'; null and empty texts have no tokens (they are taken when their key lies in the
prefix); a leaf without tokens has no budget; rows of one doc_id in a leaf are taken
together; an empty table gives no rows; an unlisted node weighs 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalog_engine.llm.common import stored

LEVELS = ("domain", "lang", "source")
BIN_DIGITS = 3
BROADCAST_ROWS = 50_000
"""A plan of so many leaves at most (some MB) is broadcast; a longer one is joined by shuffle."""

# Production parameters of the registered query: node path -> weight.
WEIGHTS = {("web",): 5, ("books",): 3, ("forum",): 2,
           ("web", "en"): 6, ("web", "de"): 2, ("books", "en"): 4, ("forum", "en"): 5, ("forum", "fr"): 2,
           ("web", "en", "src0"): 3}
SEED, SHARE_PERCENT, MAX_EPOCHS = 17, 60, 3


def domain_of(source: Column) -> Column:
    """A stand-in domain: three groups of sources by the last character of their name."""
    group = F.pmod(F.ascii(F.right(source, F.lit(1))), F.lit(3))
    return F.when(source.isNull() | (source == ""), "unknown").when(group == 0, "web").when(group == 1, "books").otherwise("forum")


def _levels(domain: Column | None) -> list[Column]:
    """The path of a row in the tree."""
    domain = domain_of(F.col("source")) if domain is None else domain
    return [F.coalesce(c.cast("string"), F.lit("unknown")).alias(n)
            for n, c in zip(LEVELS, (domain, F.col("lang"), F.col("source")), strict=True)]


def token_table(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens): tokens are runs without ASCII white space."""
    tokens = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("[^ \\t-\\r]+"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_levels(domain), tokens.cast("long").alias("n_tokens"))


def _weight(weights: dict[tuple, int], depth: int) -> Column:
    """Weight of the node that a row's first depth levels name."""
    out = F.lit(1)
    for path, weight in sorted(weights.items(), reverse=True):
        if len(path) == depth:
            same = F.lit(True)
            for level, name in zip(LEVELS, path, strict=False):
                same = same & (F.col(level) == name)
            out = F.when(same, weight).otherwise(out)
    return out.cast("long")


def _fill(children: DataFrame, parent: list[str], weights: dict[tuple, int]) -> DataFrame:
    """Deal each parent's budget among its children: children full at the common level get
    their supply, the others share the rest by weight. Children are few: nodes of a tree."""
    depth = len(parent) + 1
    key = [F.col(c) for c in parent] or [F.lit(0)]
    w = children.withColumn("_w", _weight(weights, depth))
    order = Window.partitionBy(*key).orderBy(F.col("_cap") / F.col("_w"), LEVELS[depth - 1])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_children = Window.partitionBy(*key)
    left = F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    w = w.withColumn("_left", left).withColumn("_weights", F.sum("_w").over(rest))
    w = w.withColumn("_full", F.col("_cap") * F.col("_weights") <= F.col("_w") * F.col("_left"))
    open_left = F.col("_budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(all_children), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("_w"))).over(all_children)
    w = w.withColumn("_open_left", open_left).withColumn("_open_weight", open_weight)
    share = F.when(F.col("_full"), F.col("_cap")).otherwise(F.expr("(_w * _open_left) div _open_weight"))
    return w.withColumn("_share", share).select(*LEVELS[:depth], "_cap", F.col("_share").alias("_budget"))


def leaf_budgets(tokens: DataFrame, weights: dict[tuple, int], share_percent: int, max_epochs: int) -> DataFrame:
    """(domain, lang, source, n_docs, supply, budget) of every leaf; the total budget is
    share_percent of all tokens."""
    leaves = tokens.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("supply"))
    leaves = stored(leaves, "mixing-leaves")  # a row for each source: later steps are small
    capped = leaves.withColumn("_cap", F.col("supply") * max_epochs)
    total = leaves.agg(F.expr(f"(coalesce(sum(supply), 0) * {int(share_percent)}) div 100").alias("_budget"))
    budget = F.broadcast(total)  # one row
    out = None
    for depth in range(1, len(LEVELS) + 1):
        parent = list(LEVELS[:depth - 1])
        nodes = capped.groupBy(*LEVELS[:depth]).agg(F.sum("_cap").alias("_cap"))
        if out is None:
            root_cap = nodes.agg(F.sum("_cap").alias("_root"))
            budget = budget.join(F.broadcast(root_cap)).select(F.least("_budget", "_root").alias("_budget"))
            with_budget = nodes.join(F.broadcast(budget))
        else:
            with_budget = nodes.join(out.select(*parent, "_budget"), parent)
        out = _fill(with_budget, parent, weights)
    return leaves.join(out.select(*LEVELS, F.col("_budget").alias("budget")), list(LEVELS))


def join_plan(rows: DataFrame, plan: DataFrame, on: list[str]) -> DataFrame:
    """Join rows with a stored plan: broadcast while its checked size allows, else by
    shuffle, where adaptive execution splits a hot leaf."""
    small = plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(plan) if small else plan, on)


def epoch_key(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("doc_id").cast("string")).cast("binary"))


def cutoffs(tokens: DataFrame, weights: dict[tuple, int], seed: int, share_percent: int, max_epochs: int) -> DataFrame:
    """(domain, lang, source, epochs, end_bin, last_key) of every leaf: its whole epochs, and
    where its prefix of the next one ends."""
    plan = stored(leaf_budgets(tokens, weights, share_percent, max_epochs).select(
        *LEVELS, F.expr("if(supply > 0, budget div supply, 0)").alias("epochs"),
        F.expr("if(supply > 0, budget % supply, 0)").alias("rest")), "mixing-plan")
    keyed = join_plan(tokens, plan, list(LEVELS)).withColumn("key", epoch_key(seed)).withColumn("bin", F.left("key", F.lit(BIN_DIGITS)))
    bins = keyed.groupBy(*LEVELS, "rest", "bin").agg(F.sum("n_tokens").alias("in_bin"))
    running = Window.partitionBy(*LEVELS).orderBy("bin")  # at most 4096 rows for each leaf
    bins = bins.withColumn("upto", F.sum("in_bin").over(running))
    # the first bin that the rest does not cover; leaves whose rest covers all have none
    ends = stored(bins.where(F.col("upto") > F.col("rest")).groupBy(*LEVELS).agg(
        F.min("bin").alias("end_bin"), F.min_by(F.col("upto") - F.col("in_bin"), "bin").alias("before")), "mixing-ends")
    last = join_plan(keyed, ends, list(LEVELS)).where(F.col("bin") == F.col("end_bin"))
    by_key = last.groupBy(*LEVELS, "rest", "before", "key").agg(F.sum("n_tokens").alias("in_key"))
    within = Window.partitionBy(*LEVELS).orderBy("key")  # one bin of 4096
    cut = by_key.withColumn("upto", F.col("before") + F.sum("in_key").over(within)).where(F.col("upto") <= F.col("rest"))
    return stored(plan.join(ends, list(LEVELS), "left").join(
        cut.groupBy(*LEVELS).agg(F.max("key").alias("last_key")), list(LEVELS), "left")
        .select(*LEVELS, "epochs", "end_bin", F.coalesce("last_key", F.lit("")).alias("last_key")), "mixing-cuts")


def _copies(seed: int) -> Column:
    """Epochs in which a row (doc_id, joined with its leaf's cut-off) is taken."""
    key = epoch_key(seed)
    in_prefix = F.col("end_bin").isNull() | (F.left(key, F.lit(BIN_DIGITS)) < F.col("end_bin")) | (key <= F.col("last_key"))
    return F.col("epochs") + in_prefix.cast("long")


def selection(docs: DataFrame, weights: dict[tuple, int] = WEIGHTS, seed: int = SEED,
              share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS, domain: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, copies) of every row: in how many epochs it is taken."""
    tokens = stored(token_table(docs, domain), "mixing-tokens")
    cuts = cutoffs(tokens, weights, seed, share_percent, max_epochs)
    return join_plan(tokens, cuts, list(LEVELS)).select("doc_id", *LEVELS, "n_tokens", _copies(seed).alias("copies"))


def take(docs: DataFrame, weights: dict[tuple, int] = WEIGHTS, seed: int = SEED,
         share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS, domain: Column | None = None) -> DataFrame:
    """The rows of docs, each as often as selection() takes it. Rows find their leaf's cut-off
    by a join with the small table of leaves, so texts aren't shuffled."""
    tokens = stored(token_table(docs, domain), "mixing-tokens")
    cuts = cutoffs(tokens, weights, seed, share_percent, max_epochs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), *_levels(domain))
    chosen = join_plan(rows, cuts, list(LEVELS)).withColumn("_copies", _copies(seed)).where("_copies > 0")
    return chosen.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def oracle(weights: dict[tuple, int] = WEIGHTS, seed: int = SEED, share_percent: int = SHARE_PERCENT, max_epochs: int = MAX_EPOCHS) -> str:
    """The selection in DuckDB SQL."""

    def weight(depth: int) -> str:
        cases = "".join(
            f" WHEN {' AND '.join(f'{level} = {name!r}' for level, name in zip(LEVELS, path, strict=False))} THEN {w}"
            for path, w in sorted(weights.items()) if len(path) == depth)
        return f"CAST(CASE{cases} ELSE 1 END AS BIGINT)" if cases else "CAST(1 AS BIGINT)"

    steps = [f"""t AS (SELECT doc_id,
        CASE WHEN source IS NULL OR source = '' THEN 'unknown'
             WHEN ascii(right(source, 1)) % 3 = 0 THEN 'web' WHEN ascii(right(source, 1)) % 3 = 1 THEN 'books' ELSE 'forum' END AS domain,
        coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS n_tokens FROM documents)""",
             "leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply FROM t GROUP BY ALL)",
             f"""root AS (SELECT least((CAST(coalesce(sum(supply), 0) AS BIGINT) * {share_percent}) // 100,
        CAST(sum(supply) AS BIGINT) * {max_epochs}) AS budget FROM leaves)"""]
    for depth in (1, 2, 3):
        own, parent = ", ".join(LEVELS[:depth]), ", ".join(LEVELS[:depth - 1])
        part = f"PARTITION BY {parent}" if parent else ""
        steps += [
            f"""n{depth} AS (SELECT {own}, CAST(sum(supply) AS BIGINT) * {max_epochs} AS cap, {weight(depth)} AS w FROM leaves GROUP BY ALL)""",
            f"""o{depth} AS (SELECT *, budget - coalesce(CAST(sum(cap) OVER ({part} ORDER BY cap / w, {LEVELS[depth - 1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS lft,
        CAST(sum(w) OVER ({part} ORDER BY cap / w, {LEVELS[depth - 1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ws
        FROM n{depth} {f'JOIN b{depth - 1} USING ({parent})' if parent else 'CROSS JOIN root'})""",
            f"f{depth} AS (SELECT *, cap * ws <= w * lft AS full_ FROM o{depth})",
            f"""b{depth} AS (SELECT {own}, CASE WHEN full_ THEN cap ELSE
        (w * (budget - coalesce(CAST(sum(cap) FILTER (full_) OVER ({part}) AS BIGINT), 0))) // CAST(sum(w) FILTER (NOT full_) OVER ({part}) AS BIGINT) END AS budget FROM f{depth})"""]
    steps += ["plan AS (SELECT *, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS epochs, CASE WHEN supply > 0 THEN budget % supply ELSE 0 END AS rest FROM leaves JOIN b3 USING (domain, lang, source))",
              f"keyed AS (SELECT t.*, epochs, rest, md5(concat_ws('|', '{seed}', CAST(epochs AS VARCHAR), CAST(doc_id AS VARCHAR))) AS key FROM t JOIN plan USING (domain, lang, source))",
              "sums AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed)"]
    return ("WITH " + ",\n".join(steps) +
            "\nSELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM sums")

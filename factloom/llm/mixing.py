"""Mixing sources to target weights by hierarchical budgets.

The tree is domain - language - source. Capacities (a leaf's tokens times max_epochs; none with weight 0) are summed
upwards; the budget goes downwards. At each node the children share in proportion to their weights; a child that
cannot hold its share gets its capacity, and its siblings share what it leaves. A node that is short as a whole got
only its capacity in the first place, so its shortage went to its own siblings: siblings before ancestors. All in
whole tokens.

A leaf's budget buys whole epochs and then a token-prefix of one more: the texts of an epoch are in the order of
sha256(seed:epoch:id), and the prefix is what fits. The prefix is found without sorting a leaf in one place: token
sums of slices of the hash give the slice where the budget ends, and only that slice is sorted, which yields one cut
hash per leaf. Rows then pass by comparing hashes: no row, text or sort of a leaf is ever gathered. Leaf tables are
joined by Catalyst's own choice, which checks their size.

Tokens are estimated as a quarter of the UTF-8 bytes, rounded up.

Defined results: a null text has no tokens; null source and language are named ''; ids that tie on the hash (repeated
rows, null ids) stay or go together; texts without tokens go with the prefix they stand in; a budget above all
capacities takes all capacities; an empty table gives an empty result; mix_rows keeps all columns of the input.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.storage import materialize

WIDE = "decimal(38,0)"
#: Rows that one slice of a leaf's hashes should hold.
SLICE_ROWS = 20_000
LEAF = ("domain", "lang", "source")


@dataclass(frozen=True)
class Plan:
    """Whole numbers throughout. domains maps sources to domains; weights of unnamed nodes are the defaults."""

    share: tuple[int, int] = (1, 2)  # of all tokens, the budget: numerator, denominator
    max_epochs: int = 2
    seed: int = 42
    domains: Mapping[str, str] = field(default_factory=dict)
    other: str = "other"
    domain_weights: Mapping[str, int] = field(default_factory=dict)
    lang_weights: Mapping[str, int] = field(default_factory=dict)
    source_weights: Mapping[str, int] = field(default_factory=dict)
    default_weight: int = 1


def _lookup(values: Mapping[str, object], key: Column, default: object) -> Column:
    if not values:
        return F.lit(default)
    return F.coalesce(F.element_at(F.create_map(*map(F.lit, chain.from_iterable(values.items()))), key), F.lit(default))


def tokens(text: Column) -> Column:
    return F.floor((F.octet_length(F.coalesce(text, F.lit(""))) + 3) / 4).cast("long")


def order(seed: int, epoch: Column, identifier: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(identifier.cast("string"), F.lit(""))), 256)


def _share_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """children (parent columns, name, cap, weight, budget of the parent) -> the same with `given`."""
    node = Window.partitionBy(*(parent or [F.lit(0)]))
    rising = node.orderBy((F.col("cap") / F.col("weight")).cast("double"), "name").rowsBetween(Window.unboundedPreceding, 0)
    seen = children.where("weight > 0").select("*", F.sum("cap").over(rising).cast(WIDE).alias("caps"), F.sum("weight").over(rising).cast(WIDE).alias("weights"), F.sum("weight").over(node).cast(WIDE).alias("all_weights"))
    full = seen.withColumn("full", F.col("weight").cast(WIDE) * (F.col("budget") - F.col("caps")) >= F.col("cap").cast(WIDE) * (F.col("all_weights") - F.col("weights")))
    left = F.col("budget").cast(WIDE) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(node), F.lit(0)).cast(WIDE)
    open_weight = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(node), F.lit(1)).cast(WIDE)
    shared = full.select("*", left.alias("left"), open_weight.alias("open_weight"))
    given = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("cast(left * weight as decimal(38,0)) div open_weight"))
    return shared.withColumn("given", given.cast("long")).drop("caps", "weights", "all_weights", "full", "left", "open_weight")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """leaves (domain, lang, source, n_tokens, n_rows) -> the same with `budget`, for leaves with any weight."""
    weighed = leaves.select(
        "*", _lookup(plan.domain_weights, F.col("domain"), plan.default_weight).alias("dw"), _lookup(plan.lang_weights, F.col("lang"), plan.default_weight).alias("lw"),
        _lookup(plan.source_weights, F.col("source"), plan.default_weight).alias("sw"),
    ).where("dw > 0 and lw > 0 and sw > 0").withColumn("cap", F.col("n_tokens") * plan.max_epochs)
    langs = weighed.groupBy("domain", "dw", "lang", "lw").agg(F.sum("cap").alias("cap"))
    domains = langs.groupBy("domain", "dw").agg(F.sum("cap").alias("cap"))
    everything = leaves.agg(F.sum("n_tokens").alias("n")).select(F.expr(f"cast(n as decimal(38,0)) * {plan.share[0]} div {plan.share[1]}").alias("wanted"))
    total = domains.agg(F.sum("cap").alias("most")).crossJoin(everything).select(F.least("wanted", "most").cast("long").alias("budget"))  # one row each
    top = _share_out(domains.select("domain", F.col("domain").alias("name"), "cap", F.col("dw").alias("weight")).crossJoin(total), [])
    middle = langs.select("domain", "lang", F.col("lang").alias("name"), "cap", F.col("lw").alias("weight")).join(top.select("domain", F.col("given").alias("budget")), "domain")
    middle = _share_out(middle, ["domain"])
    bottom = weighed.select(*LEAF, "n_tokens", "n_rows", F.col("source").alias("name"), "cap", F.col("sw").alias("weight")).join(middle.select("domain", "lang", F.col("given").alias("budget")), ["domain", "lang"])
    return _share_out(bottom, ["domain", "lang"]).select(*LEAF, "n_tokens", "n_rows", F.col("given").alias("budget"))


def _named(docs: DataFrame, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    source = F.coalesce(docs["source"], F.lit(""))
    return docs.select(docs[id_col].alias("id"), _lookup(plan.domains, source, plan.other).alias("domain"), F.coalesce(docs["lang"], F.lit("")).alias("lang"), source.alias("source"), tokens(docs[text_col]).alias("n_tokens"))


def leaf_plans(rows: DataFrame, plan: Plan) -> DataFrame:
    """Per leaf: full (whole epochs) and cut (the largest hash taken of the next one, '' for none)."""
    leaves = materialize(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows")), "mix-leaves")
    most = leaves.agg(F.max("n_rows")).first()[0] or 1
    digits = max(1, math.ceil(math.log(max(1, most / SLICE_ROWS), 16)))
    whole = F.when(F.col("n_tokens") > 0, F.least(F.expr("budget div greatest(n_tokens, 1)"), F.lit(plan.max_epochs))).otherwise(F.lit(0)).cast("int")
    bought = budgets(leaves, plan).withColumn("full", whole).withColumn("rest", F.when(F.col("full") < plan.max_epochs, F.col("budget") - F.col("full") * F.col("n_tokens")).otherwise(0))
    bought = materialize(bought.select(*LEAF, "full", "rest"), "mix-bought")
    hashed = rows.join(bought.where("rest > 0"), list(LEAF)).withColumn("h", order(plan.seed, F.col("full"), F.col("id"))).withColumn("slice", F.substring("h", 1, digits))
    slices = hashed.groupBy(*LEAF, "slice").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*LEAF).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = slices.select(*LEAF, "slice", "rest", before.alias("before")).where("before <= rest").groupBy(*LEAF).agg(F.max(F.struct("slice", "before")).alias("last")).select(*LEAF, F.col("last.slice").alias("slice"), F.col("last.before").alias("before"))
    inside = hashed.join(last, [*LEAF, "slice"]).groupBy(*LEAF, "slice", "h", "rest", "before").agg(F.sum("n_tokens").alias("n"))
    reached = F.col("before") + F.sum("n").over(Window.partitionBy(*LEAF, "slice").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    cut = inside.select(*LEAF, "h", "rest", reached.alias("reached")).where("reached <= rest").groupBy(*LEAF).agg(F.max("h").alias("cut"))
    # where nothing of the last slice fits, the prefix ends with the slice before it
    return materialize(bought.join(last, list(LEAF), "left").join(cut, list(LEAF), "left").select(*LEAF, "full", F.coalesce("cut", "slice", F.lit("")).alias("cut")), "mix-plans")


def _taken(plan: Plan) -> Column:
    """Epochs in which a row with columns id, full and cut is taken."""
    partial = order(plan.seed, F.col("full"), F.col("id")) <= F.col("cut")
    last = F.when((F.col("full") < plan.max_epochs) & partial, F.col("full")).otherwise(F.col("full") - 1)
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def mix(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text and epoch taken: id, epoch, domain, lang, source, n_tokens."""
    rows = _named(docs, plan, id_col, text_col)
    planned = rows.join(leaf_plans(rows, plan), list(LEAF))
    return planned.select("id", F.explode(_taken(plan)).alias("epoch"), *LEAF, "n_tokens")


def mix_rows(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are taken, once per epoch, with their own columns only."""
    plans = leaf_plans(_named(docs, plan, id_col, text_col), plan).select(*(F.col(c).alias(f"__{c}") for c in LEAF), "full", "cut")
    source = F.coalesce(docs["source"], F.lit(""))
    own = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    named = docs.select(own, docs[id_col].alias("id"), _lookup(plan.domains, source, plan.other).alias("__domain"), F.coalesce(docs["lang"], F.lit("")).alias("__lang"), source.alias("__source"))
    return named.join(plans, [f"__{c}" for c in LEAF]).select("row", F.explode(_taken(plan)).alias("epoch")).select("row.*")


def sql(plan: Plan, documents: str = "documents") -> str:
    """DuckDB SQL for mix(), with the leaf's order as one window: columns id, epoch, domain, lang, source, n_tokens."""
    case = lambda values, key, default: "CASE " + "".join(f"WHEN {key} = '{k}' THEN {v!r} " for k, v in values.items()) + f"ELSE {default!r} END" if values else repr(default)

    def share(name: str, children: str, parent: str) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        return f"""{name}_s AS (SELECT *, sum(cap) OVER r AS caps, sum(weight) OVER r AS weights, sum(weight) OVER ({by}) AS all_weights FROM ({children}) c
          WINDOW r AS ({by} ORDER BY CAST(cap AS DOUBLE) / weight, name ROWS UNBOUNDED PRECEDING)),
        {name}_f AS (SELECT *, CAST(weight AS HUGEINT) * (budget - caps) >= CAST(cap AS HUGEINT) * (all_weights - weights) AS full_ FROM {name}_s),
        {name} AS (SELECT *, CAST(CASE WHEN full_ THEN cap ELSE CAST(budget - coalesce(sum(CASE WHEN full_ THEN cap END) OVER ({by}), 0) AS HUGEINT) * weight // coalesce(sum(CASE WHEN NOT full_ THEN weight END) OVER ({by}), 1) END AS BIGINT) AS given FROM {name}_f)"""

    return f"""WITH rows_ AS (SELECT doc_id AS id, {case(plan.domains, "coalesce(source, '')", plan.other)} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST((strlen(coalesce(text, '')) + 3) // 4 AS BIGINT) AS n_tokens FROM {documents}),
        leaves AS (SELECT domain, lang, source, sum(n_tokens) AS n_tokens FROM rows_ GROUP BY ALL),
        weighed AS (SELECT *, {case(plan.domain_weights, "domain", plan.default_weight)} AS dw, {case(plan.lang_weights, "lang", plan.default_weight)} AS lw, {case(plan.source_weights, "source", plan.default_weight)} AS sw, n_tokens * {plan.max_epochs} AS cap FROM leaves),
        langs AS (SELECT domain, dw, lang, lw, sum(cap) AS cap FROM weighed WHERE dw > 0 AND lw > 0 AND sw > 0 GROUP BY ALL),
        doms AS (SELECT domain, dw, sum(cap) AS cap FROM langs GROUP BY ALL),
        total AS (SELECT least((SELECT sum(n_tokens) * {plan.share[0]} // {plan.share[1]} FROM leaves), (SELECT sum(cap) FROM doms)) AS budget),
        {share("top_", "SELECT domain, domain AS name, cap, dw AS weight, budget FROM doms, total", "")},
        {share("mid_", "SELECT l.domain, l.lang, l.lang AS name, l.cap, l.lw AS weight, t.given AS budget FROM langs l JOIN top_ t USING (domain)", "domain")},
        {share("low_", "SELECT w.domain, w.lang, w.source, w.n_tokens, w.source AS name, w.cap, w.sw AS weight, m.given AS budget FROM weighed w JOIN mid_ m USING (domain, lang) WHERE w.dw > 0 AND w.lw > 0 AND w.sw > 0", "domain, lang")},
        bought AS (SELECT domain, lang, source, CAST(CASE WHEN n_tokens > 0 THEN least(given // greatest(n_tokens, 1), {plan.max_epochs}) ELSE 0 END AS INT) AS full_epochs, given, n_tokens AS leaf_tokens FROM low_),
        hashed AS (SELECT r.*, b.full_epochs, given - full_epochs * leaf_tokens AS rest, sha256('{plan.seed}:' || full_epochs || ':' || coalesce(CAST(id AS VARCHAR), '')) AS h FROM rows_ r JOIN bought b USING (domain, lang, source)),
        reached AS (SELECT *, full_epochs < {plan.max_epochs} AND rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE UNBOUNDED PRECEDING) <= rest AS part FROM hashed)
        SELECT id, CAST(e.epoch AS INT) AS epoch, domain, lang, source, n_tokens FROM reached JOIN (SELECT unnest(range({plan.max_epochs})) AS epoch) e ON e.epoch < full_epochs OR (part AND e.epoch = full_epochs)"""

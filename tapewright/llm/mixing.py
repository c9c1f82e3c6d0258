"""Mixing sources to target weights over a tree of domains, languages and sources.

The token budget is handed down the tree.  A node gives its children shares in proportion
to their weights, but none more than its subtree can supply; what a short child leaves
goes to its siblings, and only if all of them are short is the node itself short and its
own siblings get the rest.  Each leaf then takes a prefix of its documents in a seeded
order that differs from epoch to epoch; whole epochs come first.

Only DataFrame and SQL functions are used.  A leaf's order is by hash, so a leaf is cut by
summing tokens over hash ranges first; only the rows of the one range in which the budget
ends are ordered, whatever the size of the leaf.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import deleted, new_path, written

LEAF = ("domain", "language", "origin")
#: The domains to which sources belong, by the number that ends their name.
DOMAINS = ("web", "books", "code", "forum")
#: Up to so many leaves are broadcast; so many rows of a leaf or fewer are ordered at once.
FEW, RANGE = 100_000, 20_000


@dataclass(frozen=True)
class Plan:
    """Weights by name (1 for all others), the budget as a share of all tokens, epochs at most, and a seed."""

    domains: dict[str, float] = field(default_factory=dict)
    languages: dict[str, float] = field(default_factory=dict)
    sources: dict[str, float] = field(default_factory=dict)
    budget: float = 0.5
    epochs: int = 2
    seed: int = 17


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(source, r"(\d{1,9})$", 1)
    return F.when(F.coalesce(number, F.lit("")) == "", "other").otherwise(F.element_at(F.array(*map(F.lit, DOMAINS)), (number.try_cast("int") % len(DOMAINS) + 1)))


def n_tokens(text: Column) -> Column:
    """Words between spaces: an estimate that needs no tokenizer; 0 for a null or empty text."""
    return F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).otherwise(0).cast("long")


def _weight(name: Column, weights: dict[str, float]) -> Column:
    if not weights:
        return F.lit(1.0)
    listed = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    return F.coalesce(F.try_element_at(listed, name), F.lit(1.0)).cast("double")


def shared_out(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children`` (with ``supply``, ``weight`` and their parent's ``budget``) with their own ``given``.

    In the order of supply over weight the short children come first: each is given all it
    has if an equal share by weight of what is left would be more.
    """
    ratio = F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")).otherwise(F.lit(float("inf")))
    ordered = Window.partitionBy(*parent).orderBy(ratio, name)
    every = Window.partitionBy(*parent)
    before = F.coalesce(F.sum("supply").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing))
    marked = children.select("*", before.alias("before"), weight_left.alias("weight_left"))
    short = F.col("supply") * F.col("weight_left") <= F.col("weight") * F.greatest(F.col("budget") - F.col("before"), F.lit(0))
    marked = marked.withColumn("short", short)
    rest = F.col("budget") - F.sum(F.when(F.col("short"), F.col("supply")).otherwise(0)).over(every)
    weights = F.sum(F.when(F.col("short"), 0.0).otherwise(F.col("weight"))).over(every)
    marked = marked.select("*", rest.alias("rest"), weights.alias("weights"))
    share = F.when(F.col("weights") > 0, F.floor(F.col("rest") * F.col("weight") / F.col("weights"))).otherwise(0)
    given = F.when(F.col("short"), F.col("supply")).otherwise(F.least(share, F.col("supply"))).cast("long")
    return marked.withColumn("given", given).drop("before", "weight_left", "short", "rest", "weights", "budget")


def leaf_budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """(domain, language, origin, tokens, n, given) from leaves' token and document counts.

    The tables here have a row per node of the tree.
    """
    leaves = leaves.withColumn("supply", F.col("tokens") * plan.epochs)
    langs = leaves.groupBy("domain", "language").agg(F.sum("supply").alias("supply"))
    domains = langs.groupBy("domain").agg(F.sum("supply").alias("supply"))
    all_tokens = F.sum("supply").over(Window.partitionBy("root")) / plan.epochs
    domains = domains.withColumn("root", F.lit(0)).withColumn("weight", _weight(F.col("domain"), plan.domains)).withColumn("budget", F.floor(all_tokens * plan.budget))
    domains = shared_out(domains, ["root"], "domain").select("domain", F.col("given").alias("budget"))
    langs = langs.join(domains, "domain").withColumn("weight", _weight(F.col("language"), plan.languages))
    langs = shared_out(langs, ["domain"], "language").select("domain", "language", F.col("given").alias("budget"))
    leaves = leaves.join(langs, ["domain", "language"]).withColumn("weight", _weight(F.col("origin"), plan.sources))
    return shared_out(leaves, ["domain", "language"], "origin").select(*LEAF, "tokens", "n", "given")


def _beside(table: DataFrame, few: bool) -> DataFrame:
    """A table with a row for each leaf, broadcast if there are few enough; AQE splits hot leaves otherwise."""
    return F.broadcast(table) if few else table


def _cuts(ordered: DataFrame, budgets: DataFrame, most: int, few: bool) -> DataFrame:
    """Where each leaf's budget ends in its order: ``budgets`` with cut, cut_tokens and k.

    Rows with (order, tokens) before (cut, cut_tokens) are taken, and ``k`` of those equal to
    it; cut is null if the budget covers the leaf.  Tokens are summed over ranges of the order,
    each of which is split into 4096 until one holds few of the largest leaf's ``most`` rows.
    """
    at = budgets.withColumn("prefix", F.lit("")).withColumn("start", F.lit(0).cast("long"))
    digits, size = 0, most
    along = Window.partitionBy(*LEAF)
    while True:
        rows = ordered.join(_beside(at.select(*LEAF, "prefix"), few), [*LEAF]).filter(F.substring("order", 1, digits) == F.col("prefix")).drop("prefix")
        last = size <= RANGE
        digits += 3
        keys = ["order", "tokens"] if last else [F.substring("order", 1, digits).alias("order"), F.lit(0).alias("tokens")]
        sums = rows.groupBy(*LEAF, *keys).agg(F.sum(rows["tokens"]).alias("sum"))
        sums = sums.withColumn("end", F.sum("sum").over(along.orderBy("order", "tokens")))
        over = sums.join(_beside(at.select(*LEAF, "left", "start"), few), [*LEAF]).filter(F.col("start") + F.col("end") > F.col("left"))
        first = over.groupBy(*LEAF).agg(F.min(F.struct("order", "tokens", "sum", "end")).alias("x")).select(*LEAF, "x.*")
        at = at.join(_beside(first, few), [*LEAF], "left").withColumn("before", F.col("start") + F.col("end") - F.col("sum"))
        if last:
            k = F.when(F.col("tokens") > 0, F.floor((F.col("left") - F.col("before")) / F.col("tokens"))).otherwise(0).cast("long")
            return at.select(*budgets.columns, F.col("order").alias("cut"), F.col("tokens").alias("cut_tokens"), k.alias("k"))
        # a leaf that is covered has no prefix any more and no rows from here on
        at = written(at.select(*budgets.columns, F.col("order").alias("prefix"), F.coalesce("before", "start").alias("start")), "mixing-ranges")
        size //= 4096


def mix(docs: DataFrame, plan: Plan, keep: list[str], domain: Callable[[Column], Column] = domain_of, tokens: Callable[[Column], Column] = n_tokens) -> DataFrame:
    """The documents that the plan takes: columns ``keep`` with domain, tokens and epoch.

    ``domain`` gives a source's domain and ``tokens`` a text's tokens, by default by words.
    A row is taken once an epoch: in each whole epoch that its leaf's budget covers, and in
    the next one if it lies in the seeded prefix whose tokens fit what is left.  A null lang
    or source is a leaf of its own; documents without text cost nothing and are taken while
    their leaf's prefix lasts; repeated rows stand side by side in the order and count each.
    Rows that share a doc_id are ordered by tokens.  An empty table gives an empty result.

    Documents don't move: they are read twice, once for a narrow table from which each leaf's
    end is found, and once to be filtered by it.
    """
    spark = docs.sparkSession
    named = [domain(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("-")).alias("language"), F.coalesce("source", F.lit("-")).alias("origin")]
    rows = docs.select(*[F.col(c).alias(f"keep_{c}") for c in keep], F.col("doc_id").cast("string").alias("id"), *named, tokens(F.col("text")).alias("tokens"))
    where = new_path(spark, "mixing-rows")
    rows.select(*LEAF, "id", "tokens").write.parquet(where)
    narrow = spark.read.parquet(where)
    leaves = narrow.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    budgets = leaf_budgets(leaves, plan)
    whole = F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(0).cast("int")
    budgets = budgets.filter((F.col("given") > 0) | (F.col("tokens") == 0)).select(*LEAF, "n", whole.alias("whole"), (F.col("given") - whole * F.col("tokens")).alias("left"))
    budgets = written(budgets, "mixing-budgets")
    size = budgets.agg(F.count(F.lit(1)).alias("leaves"), F.max("n").alias("n")).first()
    few = size["leaves"] <= FEW

    def ordered(some: DataFrame, ends: DataFrame) -> DataFrame:
        order = F.md5(F.concat_ws(":", F.lit(str(plan.seed)), F.col("whole").cast("string"), F.coalesce("id", F.lit("-"))))
        return some.join(_beside(ends, few), [*LEAF]).withColumn("order", order)

    partial = budgets.filter(F.col("whole") < plan.epochs)
    lined = ordered(narrow, partial.select(*LEAF, "whole")).select(*LEAF, "order", "tokens")
    cuts = _cuts(lined, partial, size["n"] or 0, few).select(*LEAF, "cut", "cut_tokens", "k")
    ends = written(budgets.join(_beside(cuts, few), [*LEAF], "left"), "mixing-ends")
    deleted(spark, where)

    out = [*(F.col(f"keep_{c}").alias(c) for c in keep), "domain", "tokens"]
    placed = ordered(rows, ends)
    before = F.col("cut").isNull() | (F.col("order") < F.col("cut")) | (F.col("order") == F.col("cut")) & (F.col("tokens") < F.col("cut_tokens"))
    first = F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<int>"))
    epochs = F.concat(first, F.when((F.col("whole") < plan.epochs) & before, F.array("whole")).otherwise(F.array().cast("array<int>")))
    taken = placed.select(*out, F.explode(epochs).alias("epoch"))
    if ends.filter("k > 0").isEmpty():
        return taken
    # some, not all, of rows that are alike to the order: equal ones are counted and given out again, others go by their hash
    told = [F.to_json(F.struct(c)) if "map<" in placed.select(c).dtypes[0][1] else c for c in [*(F.col(f"keep_{c}") for c in keep), F.col("domain"), F.col("tokens")]]
    alike = placed.filter((F.col("order") == F.col("cut")) & (F.col("tokens") == F.col("cut_tokens")) & (F.col("k") > 0))
    hashed = alike.select(*LEAF, "whole", "k", F.struct(*out).alias("row"), F.struct(F.xxhash64(*told), F.xxhash64(F.lit(1), *told)).alias("h"))
    equal = hashed.groupBy(*LEAF, "h").agg(F.first("row").alias("row"), F.first("whole").alias("whole"), F.first("k").alias("k"), F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("h")) - F.col("n")
    most = equal.withColumn("most", F.least("n", F.col("k") - earlier)).filter("most > 0")
    some = most.select(F.explode(F.array_repeat("row", F.col("most").cast("int"))).alias("row"), "whole").select("row.*", F.col("whole").alias("epoch"))
    return taken.unionByName(some)


def mix_sql(plan: Plan) -> str:
    """The same documents in DuckDB SQL over the table ``documents``: doc_id, domain, tokens, epoch."""

    def weight(name: str, weights: dict[str, float]) -> str:
        listed = " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in weights.items())
        return f"CASE {name} {listed} ELSE 1.0::DOUBLE END" if listed else "1.0::DOUBLE"

    def level(source: str, parent: str, name: str) -> str:
        window = f"PARTITION BY {parent} ORDER BY supply / weight, {name}"
        return f"""SELECT *, CASE WHEN short THEN supply ELSE least(supply, CAST(CASE WHEN sum(CASE WHEN short THEN 0 ELSE weight END) OVER p > 0
            THEN floor((budget - sum(CASE WHEN short THEN supply ELSE 0 END) OVER p) * weight / sum(CASE WHEN short THEN 0 ELSE weight END) OVER p) ELSE 0 END AS BIGINT)) END AS given
          FROM (SELECT *, supply * sum(weight) OVER ({window} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
              <= weight * greatest(budget - coalesce(sum(supply) OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS short FROM ({source}))
          WINDOW p AS (PARTITION BY {parent})"""

    domains = ", ".join(f"'{d}'" for d in DOMAINS)
    return f"""WITH named AS (SELECT doc_id, coalesce(lang, '-') AS language, coalesce(source, '-') AS origin,
        CASE WHEN coalesce(regexp_extract(source, '(\\d{{1,9}})$', 1), '') = '' THEN 'other'
          ELSE list_extract([{domains}], CAST(regexp_extract(source, '(\\d{{1,9}})$', 1) AS INTEGER) % {len(DOMAINS)} + 1) END AS domain,
        CASE WHEN length(text) > 0 THEN length(text) - length(replace(text, ' ', '')) + 1 ELSE 0 END AS tokens FROM documents),
      leaves AS (SELECT domain, language, origin, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {plan.epochs} AS BIGINT) AS supply FROM named GROUP BY ALL),
      langs AS (SELECT domain, language, CAST(sum(supply) AS BIGINT) AS supply FROM leaves GROUP BY ALL),
      doms AS (SELECT domain, CAST(sum(supply) AS BIGINT) AS supply FROM langs GROUP BY ALL),
      d AS ({level(f"SELECT *, 0 AS root, {weight('domain', plan.domains)} AS weight, floor((SELECT sum(supply) FROM doms) / {plan.epochs} * {plan.budget}::DOUBLE) AS budget FROM doms", "root", "domain")}),
      l AS ({level(f"SELECT langs.*, {weight('language', plan.languages)} AS weight, d.given AS budget FROM langs JOIN d USING (domain)", "domain", "language")}),
      s AS ({level(f"SELECT leaves.*, {weight('origin', plan.sources)} AS weight, l.given AS budget FROM leaves JOIN l USING (domain, language)", "domain, language", "origin")}),
      shares AS (SELECT domain, language, origin, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS whole,
        CASE WHEN tokens > 0 THEN given - given // tokens * tokens ELSE given END AS remains FROM s WHERE given > 0 OR tokens = 0),
      dealt AS (SELECT named.*, whole, remains FROM named JOIN shares USING (domain, language, origin)),
      lined AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, origin
        ORDER BY md5('{plan.seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), '-')), tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until FROM dealt)
      SELECT doc_id, domain, CAST(tokens AS BIGINT) AS tokens, CAST(epoch AS INTEGER) AS epoch FROM (
        SELECT doc_id, domain, tokens, unnest(range(whole)) AS epoch FROM dealt
        UNION ALL SELECT doc_id, domain, tokens, whole AS epoch FROM lined WHERE whole < {plan.epochs} AND until <= remains)"""

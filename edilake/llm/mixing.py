"""Mixing sources to target weights: budgets over a domain-language-source tree.

A leaf's capacity is its tokens times ``max_epochs``; a node's is the sum of
its children's. The budget goes down the tree: children share their parent's
in proportion to their weights, and those that can't use their share leave the
rest to their siblings, in proportion again. As a parent never gets more than
its children hold, a shortage reaches a node's own siblings only when all below
it is used up. All arithmetic is in whole tokens.

A leaf takes whole epochs, then the longest prefix of one more epoch that its
budget allows. The order of an epoch is that of md5(seed:epoch:doc_id), then of
the id. The prefix's end is found without ordering a leaf: token sums of 256
slots of the hash, of 256 parts of the slot where the budget ends, and an
ordering of that part alone. What is selected is then a filter with one row for
each leaf.

Defined cases: a null or empty text has 0 tokens; nulls in a level are a child
named ``und``; children without a weight have weight 1, those of weight 0 get
nothing while siblings can take it, and nothing after; a leaf without tokens is
taken once; rows that repeat an id are all taken or none, where they end a
budget; an empty table gives none; other columns stay, and the epoch's column
gets underscores until its name is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, free, table

SEED = 17
LEVELS = ("domain", "language", "origin")
#: The query's target: weights by level, the budget as a share of all tokens, and how often a text may come.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "language": {"en": 5, "de": 2, "fr": 2, "es": 1}, "origin": {}}
MAX_EPOCHS = 2


def budgets(leaves: DataFrame, budget: float | int, weights: dict, names: list[str], max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """leaves (names, t) with the tokens to take of each, level by level from the root.

    Children in order of capacity over weight take all they have while each
    one's capacity is at most its share of what is left; the others share the
    rest. Sums over that order say so without a loop. The windows see one row
    for each child of a node.
    """
    whole = lambda c: c.cast("decimal(38,0)")
    levels = [f"level{k}_" for k in range(len(names))]
    plain = leaves.select(*(F.col(n).alias(x) for n, x in zip(names, levels)), F.col("t").alias("t_"))
    total = int(plain.agg(F.sum(whole(F.col("t_")))).first()[0] or 0)
    goal = min(budget if isinstance(budget, int) else int(total * budget), total * max_epochs)
    above = None
    for k, name in enumerate(levels):
        parents = levels[:k]
        own = weights.get(names[k], {})
        weight = F.create_map(*(F.lit(x) for pair in own.items() for x in pair))[F.col(name)] if own else F.lit(None).cast("int")
        nodes = plain.groupBy(*parents, name).agg((F.sum(whole(F.col("t_"))) * max_epochs).alias("c_")).withColumn("w_", F.coalesce(weight, F.lit(1)).cast("decimal(10,0)"))
        nodes = nodes.join(above, parents) if parents else nodes.withColumn("b_", F.lit(str(goal)).cast("decimal(38,0)"))
        order = W.partitionBy(*parents).orderBy((F.col("w_") <= 0).cast("int"), F.try_divide(F.col("c_").cast("double"), F.col("w_").cast("double")), name)
        before = F.coalesce(whole(F.sum("c_").over(order.rowsBetween(W.unboundedPreceding, -1))), whole(F.lit(0)))
        nodes = nodes.withColumns({"before_": before, "left_": F.sum("w_").over(order.rowsBetween(0, W.unboundedFollowing))})
        nodes = nodes.withColumn("full_", (F.col("w_") > 0) & (F.col("c_") * F.col("left_") <= (F.col("b_") - F.col("before_")) * F.col("w_")))
        some = lambda c, f: F.coalesce(whole(F.sum(F.when(f, F.col(c))).over(W.partitionBy(*parents))), whole(F.lit(0)))
        nodes = nodes.withColumns({"c_full_": some("c_", F.col("full_")), "w_open_": some("w_", ~F.col("full_"))})
        got = F.when(F.col("full_"), F.col("c_")).when(F.col("w_") > 0, F.expr("cast(floor((b_ - c_full_) * w_ / w_open_) as decimal(38,0))")).otherwise(F.lit(0))
        above = nodes.select(*parents, name, whole(got).alias("b_"))
    out = plain.join(above, levels)
    return out.select(*(F.col(x).alias(n) for n, x in zip(names, levels)), F.col("t_").alias("t"), F.col("b_").cast("long").alias("budget"))


def words_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def plan(docs: DataFrame, levels: dict[str, Column], weights: dict, budget: float | int, seed: int = SEED, max_epochs: int = MAX_EPOCHS, tokens: Column | None = None, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The leaves' plan, one row each: whole epochs, and the last (key, id) of the partial one; and (id, levels, n_tokens)."""
    names = list(levels)
    count = tokens if tokens is not None else words_count(F.col("text"))
    rows = cut(docs.select(F.col(doc_id).alias("id"), *(F.coalesce(c.cast("string"), F.lit("und")).alias(n) for n, c in levels.items()), count.alias("n_tokens")), "tokens")
    kind = docs.schema[doc_id].dataType.simpleString()
    leaves = cut(rows.groupBy(*names).agg(F.sum("n_tokens").alias("t")), "leaves")
    part = lambda x: F.when(F.col("t") > 0, F.expr(x)).otherwise(F.lit(0)).cast("long")
    own = budgets(leaves, budget, weights, names, max_epochs)
    of_leaf = cut(own.select(*names, part("budget div t").alias("epochs"), part("budget % t").alias("rest"), "budget"), "leaf")
    # Joins with a row for each leaf: by broadcast where that is small, as its table's size tells.
    keyed = cut(rows.join(of_leaf, names).withColumn("key", _key(seed, F.col("epochs"), F.col("id"))).select(*names, "id", "key", "n_tokens", "rest"), "keys")

    def ends(at: DataFrame, slot: Column, base: str) -> DataFrame:
        """The slot of each leaf in which its budget ends, and the tokens before it."""
        sums = at.groupBy(*names, "rest", *([base] if base else []), slot.alias("slot")).agg(F.sum("n_tokens").alias("t"))
        upto = F.sum("t").over(W.partitionBy(*names).orderBy("slot").rowsBetween(W.unboundedPreceding, 0)) + (F.col(base) if base else F.lit(0))
        found = sums.withColumn("upto", upto).where("upto > rest and upto - t <= rest")
        return found.select(*names, "slot", (F.col("upto") - F.col("t")).alias("base"))

    # A leaf has at most one such slot, so these have no more rows than the tree has leaves.
    one = cut(ends(keyed, F.substring("key", 1, 2), ""), "slot").withColumnRenamed("slot", "s1")
    inside = keyed.join(one, names).where("substring(key, 1, 2) = s1")
    two = cut(ends(inside, F.substring("key", 3, 2), "base").withColumnRenamed("slot", "s2"), "part")
    both = one.drop("base").join(two, names)
    last = keyed.join(both, names).where("substring(key, 1, 4) = concat(s1, s2)")
    upto = F.sum("n_tokens").over(W.partitionBy(*names).orderBy("key", "id").rangeBetween(W.unboundedPreceding, 0)) + F.col("base")
    taken = last.withColumn("upto", upto).where("upto <= rest").groupBy(*names).agg(F.max(F.struct("key", F.col("id").alias("last_id"))).alias("last"))
    # No end: all of the epoch is taken. '~' follows all hexadecimal digits.
    edge = of_leaf.join(both.drop("base"), names, "left").join(taken, names, "left").select(
        *of_leaf.columns, F.coalesce(F.concat("s1", "s2"), F.lit("~")).alias("below"), F.col("last.key").alias("last_key"), F.col("last.last_id").cast(kind).alias("last_id")
    )
    return cut(edge, "plan"), rows


def select(rows: DataFrame, edge: DataFrame, levels: dict[str, Column], seed: int = SEED, doc_id: str = "doc_id", epoch: str = "epoch") -> DataFrame:
    """rows once for each epoch that takes them, with that epoch's number: no shuffle, a filter by leaf."""
    taken = [*rows.columns, epoch, *edge.columns]
    names = [free(f"{n}_", taken) for n in levels]
    mark, key_, last_key, last_id, below, epochs, rest = (free(x, [*taken, *names]) for x in ("mark_", "key_", "last_key_", "last_id_", "below_", "epochs_", "rest_"))
    of = edge.select(*(F.col(n).alias(x) for n, x in zip(levels, names)), F.col("epochs").alias(epochs), F.col("rest").alias(rest), F.col("below").alias(below), F.col("last_key").alias(last_key), F.col("last_id").alias(last_id))
    named = rows.withColumns({x: F.coalesce(c.cast("string"), F.lit("und")) for x, c in zip(names, levels.values())})
    at = named.join(of, names).withColumn(key_, _key(seed, F.col(epochs), F.col(doc_id)))
    k = F.col(key_)
    more = F.coalesce((k < F.col(below)) | (k < F.col(last_key)) | ((k == F.col(last_key)) & (F.coalesce(F.col(doc_id) <= F.col(last_id), F.lit(True)))), F.lit(False))
    # After whole epochs with nothing left, texts without tokens don't begin another.
    more = more & ((F.col(rest) > 0) | (F.col(epochs) == 0))
    times = F.col(epochs) + more.cast("long")
    new = free(epoch, rows.columns)
    return at.where(times > 0).withColumn(mark, F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).select(*rows.columns, F.col(mark).alias(new))


def domain(source: Column) -> Column:
    """The query's domains: by the number that ends a source's name."""
    number = F.regexp_extract(source, r"(\d+)$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (F.try_to_number(number, F.lit("999999999")) % 4).cast("int").cast("string"))).otherwise(F.lit("other"))


def tree() -> dict[str, Column]:
    return {"domain": domain(F.col("source")), "language": F.col("lang"), "origin": F.col("source")}


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    edge, rows = plan(docs, tree(), WEIGHTS, 1.0)
    plain = {n: F.col(n) for n in LEVELS}
    return select(rows.withColumnRenamed("id", "doc_id"), edge, plain).select("doc_id", "domain", "language", "origin", "n_tokens", "epoch")


def _level_sql(here: str, above: str, parent: str, weight: str) -> str:
    """One level of the tree: each node's budget from its parent's, by the closed form of the filling."""
    keys = f"{above}, " if above else ""
    over = f"partition by {above}" if above else ""
    return f"""
    {here}_c as (select {keys}{here}, sum(t) * {MAX_EPOCHS} as c, {weight} as w from leaf group by {keys}{here}),
    {here}_b as (select {here}_c.*, p.b as pb from {here}_c join {parent} p {f'using ({above})' if above else 'on true'}),
    {here}_s as (select *, c * sum(w) over ({over} order by c / w desc, {here} desc rows unbounded preceding)
            <= (pb - coalesce(sum(c) over ({over} order by c / w, {here} rows between unbounded preceding and 1 preceding), 0)) * w as full_ from {here}_b),
    {here}_r as (select *, pb - coalesce(sum(c) filter (where full_) over ({over}), 0) as rb, sum(w) filter (where not full_) over ({over}) as rw from {here}_s),
    {here}_x as (select {keys}{here}, case when full_ then c else (rb * w) // rw end as b from {here}_r)"""


def _case(weights: dict, column: str) -> str:
    return "case " + " ".join(f"when {column} = '{k}' then {v}" for k, v in weights.items()) + " else 1 end" if weights else "1"


def oracle() -> str:
    dom = "case when regexp_matches(source, '[0-9]+$') then 'd' || (cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 4) else 'other' end"
    return f"""
with d as (select doc_id, {dom} as domain, coalesce(lang, 'und') as language, coalesce(source, 'und') as origin,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens from documents),
    leaf as (select domain, language, origin, sum(n_tokens)::hugeint as t from d group by all),
    root as (select sum(t) as b from leaf),
    {_level_sql('domain', '', 'root', _case(WEIGHTS['domain'], 'domain'))},
    {_level_sql('language', 'domain', 'domain_x', _case(WEIGHTS['language'], 'language'))},
    {_level_sql('origin', 'domain, language', 'language_x', '1')},
    plan as (select domain, language, origin, case when t > 0 then b // t else 0 end as epochs, case when t > 0 then b % t else 0 end as rest from origin_x join leaf using (domain, language, origin)),
    k as (select d.*, epochs, rest, md5('{SEED}:' || epochs || ':' || doc_id) as key from d join plan using (domain, language, origin)),
    o as (select *, sum(n_tokens) over (partition by domain, language, origin order by key, doc_id) as upto from k)
select doc_id, domain, language, origin, n_tokens, unnest(range(cast(epochs + case when upto <= rest and (rest > 0 or epochs = 0) then 1 else 0 end as bigint))) as epoch from o
"""

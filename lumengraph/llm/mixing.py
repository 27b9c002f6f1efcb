"""Mixing sources to target weights by hierarchical budgeting; DataFrame functions only.

A token budget flows down the tree domain, language, source. Each node deals its budget to
its children in proportion to their weights; a child whose documents cannot fill its share
takes what it can, and the shortage goes to its siblings first. Only when all of them are
full does the node itself fall short, and its own siblings get the rest, up to the root. A
leaf reads its documents in a seeded order, as many whole epochs as its budget holds, and
then a prefix of the next epoch's order whose tokens fit.

A prefix of a leaf is found without ordering the leaf: documents fall into buckets by their
seeded key, sums of buckets say in which bucket the budget ends, and only that bucket's rows
are ordered. A leaf may thus hold any share of all rows.

Null languages and sources are leaves of their own, named ``(none)``. Null or empty text has
no tokens; such a document is taken when its place in the order is in the prefix. Repeated
rows count each. A weight of 0 takes nothing; names without a weight have weight 1. An empty
table gives no rows. ``domain`` of a source is one of four by its number, unless given.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumengraph.session import cut

LEVELS = ("domain", "lang", "source")
NONE = "(none)"
#: Target weights of the production query; what is not named has weight 1.
WEIGHTS: dict[str, dict[str, float]] = {"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}, "source": {"src0": 2.0}}
#: The budget as a share of all tokens, and how often a leaf may be read.
SHARE, EPOCHS, SEED = 0.5, 2, 17
#: Rows of a leaf that share a bucket, on average.
BUCKET_ROWS = 4000


def domain_of(source: Column) -> Column:
    """d0 to d3 by the number in a source's name; d0 without one."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})", 1).try_cast("int")
    return F.concat(F.lit("d"), (F.coalesce(number, F.lit(0)) % 4).cast("string"))


def _key(epoch: Column, doc_id: Column, seed: int) -> Column:
    """The place of a document in an epoch's order: 60 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(NONE)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _weight(level: str, name: Column, weights: Mapping[str, Mapping[str, float]]) -> Column:
    named = weights.get(level) or {}
    pairs = [F.lit(x) for kv in named.items() for x in (kv[0], float(kv[1]))]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), F.lit(1.0)) if pairs else F.lit(1.0)


def allocate(leaves: DataFrame, weights: Mapping[str, Mapping[str, float]], share: float, epochs: int) -> DataFrame:
    """``leaves`` (LEVELS, tokens, docs) with ``budget``, a whole number of tokens.

    Level by level: children sorted by capacity over weight; those that fill up at the level
    of the others are a prefix of that order, found from running sums.
    """
    capacity = leaves.withColumn("cap", (F.col("tokens") * epochs).cast("double"))
    parent = capacity.groupBy().agg((F.least(F.sum("cap"), F.floor(F.sum("tokens") * share).cast("double"))).alias("given"))
    above: list[str] = []
    for level in LEVELS:
        names = [*above, level]
        nodes = capacity.groupBy(*names).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(level, F.col(level), weights))
        nodes = nodes.join(parent, above) if above else nodes.join(F.broadcast(parent), how="inner", on=F.lit(True))
        family = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        full = F.when(F.col("w") > 0, F.col("cap") / F.col("w"))
        order = family.orderBy(full.asc_nulls_last(), level)
        nodes = nodes.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        nodes = nodes.withColumn("open", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        nodes = nodes.withColumn("filled", (F.col("w") > 0) & (F.col("cap") * F.col("open") <= (F.col("given") - F.col("before")) * F.col("w")))
        room = F.col("given") - F.sum(F.when(F.col("filled"), F.col("cap")).otherwise(0.0)).over(family)
        others = F.sum(F.when(F.col("filled"), 0.0).otherwise(F.col("w"))).over(family)
        dealt = F.when(F.col("filled"), F.col("cap")).when(F.col("w") > 0, F.least("cap", room * F.col("w") / others)).otherwise(0.0)
        parent = nodes.select(*names, dealt.alias("given"))
        above = names
    out = leaves.join(parent, list(LEVELS))
    return out.withColumn("budget", F.floor(F.col("given") + 1e-6).cast("long")).drop("given")


def _rows(docs: DataFrame) -> list[Column]:
    """doc_id and the levels of each row of ``docs``."""
    lang, source = (F.coalesce(docs[c].cast("string"), F.lit(NONE)) for c in ("lang", "source"))
    return [docs["doc_id"].cast("long").alias("doc_id"), domain_of(docs["source"]).alias("domain"), lang.alias("lang"), source.alias("source")]


def _bucket(key: Column, buckets: Column) -> Column:
    return F.shiftright(F.shiftright(key, 30) * buckets, 30)


def leaf_plan(rows: DataFrame, weights: Mapping[str, Mapping[str, float]], share: float, epochs: int, seed: int) -> DataFrame:
    """For each leaf: whole epochs, number of buckets, the bucket where its prefix ends, and the tokens left there.

    ``rows`` (doc_id, LEVELS, n_tokens) is read twice; it should be a written table.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    leaves = allocate(leaves, weights, share, epochs)
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")
    leaves = cut(
        leaves.withColumn("epochs", whole)
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
        .withColumn("buckets", 1 + F.floor(F.col("docs") / BUCKET_ROWS))
    )
    keyed = rows.join(leaves, list(LEVELS)).select(*LEVELS, "rest", "n_tokens", _bucket(_key(F.col("epochs") + 1, F.col("doc_id"), seed), F.col("buckets")).alias("bucket"))
    sums = keyed.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    running = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("upto", F.sum("n").over(running))
    # whole buckets fit up to the first whose end is past the rest
    ends = sums.where("upto > rest").groupBy(*LEVELS).agg(F.min("bucket").alias("edge"), F.min_by(F.col("rest") - F.col("upto") + F.col("n"), "bucket").alias("there"))
    # a row for each leaf, written so that joins see its size: a small one is broadcast
    return cut(leaves.join(ends, list(LEVELS), "left"))


def select_rows(keyed: DataFrame, n_tokens: Column, seed: int) -> DataFrame:
    """Rows with the columns of `leaf_plan`, and ``copies``: how often each is read.

    Only the rows of each leaf's last bucket are shuffled.
    """
    key = _key(F.col("__epochs") + 1, F.col("__id"), seed)
    keyed = keyed.withColumn("__key", key).withColumn("__bucket", _bucket(F.col("__key"), F.col("__buckets")))
    inside = F.col("__rest").isNotNull() & (F.col("__edge").isNull() | (F.col("__bucket") < F.col("__edge")))
    inside = inside & (F.col("__rest") > 0)
    plain = keyed.where(F.col("__edge").isNull() | (F.col("__bucket") != F.col("__edge")))
    plain = plain.withColumn("__copies", F.col("__epochs") + F.when(inside, 1).otherwise(0))
    order = Window.partitionBy("__domain", "__lang", "__source", "__bucket").orderBy("__key", "__id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = keyed.where(F.col("__bucket") == F.col("__edge")).withColumn("__sum", F.sum(n_tokens).over(order))
    last = last.withColumn("__copies", F.col("__epochs") + F.when((F.col("__rest") > 0) & (F.col("__sum") <= F.col("__there")), 1).otherwise(0)).drop("__sum")
    return plain.unionByName(last).where("__copies > 0")


def _with_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` with the plan of their leaves; all added names start with two underscores."""
    doc_id, domain, lang, source = _rows(docs)
    named = docs.withColumns({"__id": doc_id, "__domain": domain, "__lang": lang, "__source": source})
    plan = plan.select(*(F.col(c).alias(f"__{c}") for c in (*LEVELS, "budget", "epochs", "buckets", "rest", "edge", "there")))
    return named.join(plan, [f"__{c}" for c in LEVELS])


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, LEVELS and n_tokens (words between white space) of each row, written once."""
    words = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return cut(docs.select(*_rows(docs), words.alias("n_tokens")))


def mix(docs: DataFrame, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies and the leaf's budget of each document that is read."""
    rows = counted(docs)
    plan = leaf_plan(rows, weights, share, epochs, seed)
    keyed = rows.select("doc_id", *LEVELS, "n_tokens").join(plan.drop("tokens", "docs"), list(LEVELS))
    keyed = keyed.select(F.col("doc_id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in (*LEVELS, "budget", "epochs", "buckets", "rest", "edge", "there")), "n_tokens")
    out = select_rows(keyed, F.col("n_tokens"), seed)
    return out.select(F.col("__id").alias("doc_id"), *(F.col(f"__{c}").alias(c) for c in LEVELS), "n_tokens", F.col("__copies").alias("copies"), F.col("__budget").alias("budget"))


def mix_documents(docs: DataFrame, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` of one epoch's mix, each at most once, with all their columns."""
    plan = leaf_plan(counted(docs), weights, share, 1, seed)
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return select_rows(_with_plan(docs, plan), words, seed).select(*docs.columns)


_SIZE = "len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def mix_sql(source: str, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> str:
    """The mix as a chain of DuckDB table expressions; the last, ``mixed``, has the columns of `mix`."""

    def weight(level: str) -> str:
        named = "".join(f" WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in (weights.get(level) or {}).items())
        return f"(CASE {level}{named} ELSE 1.0::DOUBLE END)" if named else "1.0::DOUBLE"

    parts = [
        f"""sized AS (SELECT doc_id, 'd' || CAST(coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})', 1) AS INT), 0) % 4 AS VARCHAR) AS domain,
  coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source, CAST({_SIZE} AS BIGINT) AS n_tokens FROM {source})""",
        f"leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {epochs} AS DOUBLE) AS cap FROM sized GROUP BY 1, 2, 3)",
        f"g0 AS (SELECT least(sum(cap), CAST(floor(sum(tokens) * {share}::DOUBLE) AS DOUBLE)) AS given, 0 AS root FROM leaves)",
    ]
    above: list[str] = []
    for n, level in enumerate(LEVELS, 1):
        names, family = ", ".join([*above, level]), "PARTITION BY " + (", ".join(above) or "root")
        on = " AND ".join(f"k.{c} = p.{c}" for c in above) or "true"
        parts += [
            f"k{n} AS (SELECT {names}, sum(cap) AS cap, {weight(level)} AS w FROM leaves GROUP BY {names})",
            f"f{n} AS (SELECT {', '.join(f'k.{c}' for c in [*above, level])}, k.cap, k.w, p.given, 0 AS root FROM k{n} k JOIN g{n - 1} p ON {on})",
            f"""s{n} AS (SELECT *, coalesce(sum(cap) OVER ({family} ORDER BY cap / nullif(w, 0) ASC NULLS LAST, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER ({family} ORDER BY cap / nullif(w, 0) ASC NULLS LAST, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM f{n})""",
            f"t{n} AS (SELECT *, w > 0 AND cap * open <= (given - before) * w AS filled FROM s{n})",
            f"""g{n} AS (SELECT {names}, root, CASE WHEN filled THEN cap WHEN w > 0 THEN least(cap, (given - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({family})) * w
  / nullif(sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({family}), 0)) ELSE 0 END AS given FROM t{n})""",
        ]
        above.append(level)
    parts += [
        "b AS (SELECT l.domain, l.lang, l.source, l.tokens, CAST(floor(g.given + 1e-6::DOUBLE) AS BIGINT) AS budget FROM leaves l JOIN g3 g ON l.domain = g.domain AND l.lang = g.lang AND l.source = g.source)",
        "e AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(budget // tokens AS INT) ELSE 0 END AS epochs FROM b)",
        f"""o AS (SELECT z.*, e.budget, e.epochs, e.budget - e.epochs * e.tokens AS rest,
  sum(z.n_tokens) OVER (PARTITION BY z.domain, z.lang, z.source ORDER BY substr(md5('{seed}:' || CAST(e.epochs + 1 AS VARCHAR) || ':' || CAST(z.doc_id AS VARCHAR)), 1, 15), z.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized z JOIN e ON z.domain = e.domain AND z.lang = e.lang AND z.source = e.source)""",
        """mixed AS (SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS INT) AS copies, budget FROM o
  WHERE epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END > 0)""",
    ]
    return ",\n".join(parts)

"""Mixing sources to target weights, with budgets handed down a domain-language-source tree.

The token budget of a node goes to its children by weight. A child that holds
less than its share keeps what it has, and the rest goes to its siblings by
their weights; only what a whole subtree can't hold is shared out among the
siblings one level up. In closed form, with the children of a node in the order
of capacity per weight, those before the water level are full and the others get
the level times their weight, so three window passes over the table of leaves
settle the tree. A leaf's capacity is its tokens times ``epochs``.

A leaf then takes whole epochs while its budget lasts, and of the last one the
longest prefix, in the order of a seeded hash of (epoch, id), whose tokens the
budget covers. The prefix's end is found digit by digit: sums over the sixteen
hash ranges of a leaf, then over those of the one range that holds the end, until
few rows are left there, so however many rows a leaf has, no task sorts them and
all rounds after the first read a fifteenth of its rows. Everything is DataFrame operations.

Cases: null texts have no tokens; a null language or source is the empty one; a
null id is hashed as empty text; rows that share an id are taken or left
together (whoever ties in the hash too); a weight of zero gives nothing, and what a
node has under such a weight counts for no capacity; documents without tokens go with
the leaf's prefix; without any tokens, or rows, nothing is taken; very long texts are
only counted, without splitting them; other columns pass through, whatever their names
(but for those that begin with ``__mix_``; ``_domain`` and ``_epoch`` are replaced).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import stage

LEVELS = ("domain", "lang", "source")
_EPS = 1e-6
_FEW = 64  # rows of a leaf that are summed up one by one


@dataclass(frozen=True)
class Target:
    """Weights by name for each level (``rest`` for names not listed), the budget, and the epochs allowed."""

    domain: dict[str, float] = field(default_factory=lambda: {"crawl": 0.4, "forum": 0.2, "library": 0.4})
    lang: dict[str, float] = field(default_factory=lambda: {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1})
    source: dict[str, float] = field(default_factory=lambda: {"src0": 2.0})
    rest: tuple[float, float, float] = (0.1, 0.1, 1.0)
    fraction: float = 0.8
    epochs: int = 3
    seed: int = 7

    def weight(self, level: int) -> Column:
        named, out = getattr(self, LEVELS[level]), None
        for k, v in named.items():
            hit = F.col(LEVELS[level]) == k
            out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
        return F.lit(self.rest[level]) if out is None else out.otherwise(F.lit(self.rest[level]))


def domain_of(source: Column) -> Column:
    """The domain of the synthetic corpus's sources."""
    return F.when(source.rlike("^src[0-4]$"), "crawl").when(source.rlike("^src[5-9]$"), "forum").otherwise("library")


def token_count(text: Column) -> Column:
    """Words between ASCII white space; none in a null text. Counted by their first characters, without a list of them."""
    spaced = F.concat(F.lit(" "), F.translate(text, "\t\n\x0b\x0c\r", "     "))
    starts = F.regexp_replace(spaced, r" [^ ]", "")  # two characters less for each word
    return F.coalesce((F.length(spaced) - F.length(starts)) / 2, F.lit(0)).cast("long")


def _share(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Water-filling of the column ``given`` (the parent's budget) among the children; adds ``budget``."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    order = family.orderBy(F.col("cap") / F.col("w"), F.col(child))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    held = children.where("w > 0").withColumns({
        "_cap": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "_w": F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        "_all": F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    held = held.withColumn("_full", F.expr(f"_cap + cap / w * (_all - _w) <= given + {_EPS}"))
    full_cap = F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0.0)).over(family)
    part_w = F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("w"))).over(family)
    held = held.withColumns({"_level": (F.col("given") - full_cap) / F.when(part_w > 0, part_w)})
    budget = F.when(F.col("_full"), F.col("cap")).otherwise(F.greatest(F.lit(0.0), F.col("w") * F.col("_level")))
    return held.withColumn("budget", budget).drop("_cap", "_w", "_all", "_full", "_level", "given")


def budgets(leaves: DataFrame, target: Target) -> DataFrame:
    """``(domain, lang, source, tokens, budget)`` from ``leaves(domain, lang, source, tokens)``.

    Leaves with a weight of zero anywhere on their path get nothing and lend their node no capacity.
    """
    weighed = leaves.withColumn("cap", F.col("tokens") * F.lit(float(target.epochs)))
    for level in range(len(LEVELS)):
        weighed = weighed.where(target.weight(level) > 0)
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    given, parent = None, []
    for level, child in enumerate(LEVELS):
        keys = [*LEVELS[: level + 1]]
        nodes = weighed.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("w", target.weight(level))
        nodes = nodes.join(given, parent) if parent else nodes.withColumn("given", F.lit(total * target.fraction))
        shared = _share(nodes, parent, child)
        given, parent = shared.select(*keys, F.col("budget").alias("given")), keys
    return weighed.drop("cap").join(given.withColumnRenamed("given", "budget"), list(LEVELS))


def _key(target: Target, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(target.seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def plan(docs: DataFrame, target: Target) -> DataFrame:
    """A row for each leaf: ``full`` epochs that it takes whole, and ``last``, the largest key taken of the next (or null)."""
    each = stage(docs.select("doc_id", *LEVELS, token_count(F.col("text")).alias("tokens")), "tokens")
    leaves = each.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    settled = budgets(leaves, target).where("tokens > 0")
    settled = settled.withColumn("full", F.least(F.floor((F.col("budget") + _EPS) / F.col("tokens")), F.lit(target.epochs)))
    settled = stage(settled.withColumn("left", F.when(F.col("full") < target.epochs, F.col("budget") - F.col("full") * F.col("tokens")).otherwise(-1.0)), "leaves")
    most = settled.agg(F.max("n")).first()[0] or 0
    keyed = each.join(settled.drop("tokens"), list(LEVELS)).withColumn("_key", _key(target, F.col("full")))
    rows, edge, below = keyed.select(*LEVELS, "left", "tokens", "_key"), None, None
    inside = f"before <= left + {_EPS} and upto > left + {_EPS}"
    digits = 0
    while most > _FEW and digits < 32:  # each round leaves a sixteenth of the rows, those of the range that holds the edge
        digits, most = digits + 1, most // 16
        ranges = rows.groupBy(*LEVELS, "left", F.substring("_key", 1, digits).alias("_range")).agg(F.sum("tokens").alias("tokens"))
        ranges = ranges.join(edge.select(*LEVELS, F.col("before").alias("_from")), list(LEVELS)) if edge is not None else ranges.withColumn("_from", F.lit(0).cast("long"))
        running = Window.partitionBy(*LEVELS).orderBy("_range")
        ranges = ranges.withColumn("upto", F.col("_from") + F.sum("tokens").over(running)).withColumn("before", F.col("upto") - F.col("tokens"))
        ranges = stage(ranges, "ranges")
        taken = ranges.where(f"upto <= left + {_EPS}").select(*LEVELS, F.concat("_range", F.lit("g")).alias("_below"))
        below = taken if below is None else below.unionByName(taken)
        edge = ranges.where(inside).select(*LEVELS, "_range", "before")
        held = edge.select(*LEVELS, F.col("_range").alias("_held"))
        rows = rows.join(held, list(LEVELS)).where(F.substring("_key", 1, digits) == F.col("_held")).drop("_held")
        rows = stage(rows, "edge")
    start = F.lit(0) if edge is None else F.col("before")
    rows = rows if edge is None else rows.join(edge.select(*LEVELS, "before"), list(LEVELS))
    # rows that share an id come in together
    rows = rows.groupBy(*LEVELS, "left", "_key", *([] if edge is None else ["before"])).agg(F.sum("tokens").alias("tokens"))
    by_key = Window.partitionBy(*LEVELS).orderBy("_key")
    rows = rows.withColumn("_sum", start + F.sum("tokens").over(by_key)).where(f"_sum <= left + {_EPS}")
    # "g" sorts after every hexadecimal digit: all keys that begin with a range that is taken whole are taken
    last = rows.select(*LEVELS, F.col("_key").alias("_last"))
    last = last if below is None else last.unionByName(below.withColumnRenamed("_below", "_last"))
    out = settled.join(last.groupBy(*LEVELS).agg(F.max("_last").alias("last")), list(LEVELS), "left")
    return stage(out.select(*LEVELS, "full", "last"), "plan")


def mix(docs: DataFrame, target: Target = Target(), domain: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that the target takes, once for each ``epoch`` (from 0) that takes them.

    The columns of ``docs`` come back as they are, with ``_domain`` and ``_epoch`` added (or in place of its own of these names).
    """
    domain = domain_of(F.col("source")) if domain is None else domain
    docs = docs.drop("_domain", "_epoch")
    leaf = {"domain": F.coalesce(domain, F.lit("")), "lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))}
    slim = docs.select("doc_id", "text", *[v.alias(k) for k, v in leaf.items()])
    own = "__mix_"  # begins the names of columns that stand beside the input's own
    chosen = plan(slim, target)
    chosen = chosen.select(*[F.col(c).alias(own + c) for c in chosen.columns])
    rows = docs.withColumns({f"{own}own_{k}": v for k, v in leaf.items()})
    on = [F.col(f"{own}own_{k}") == F.col(own + k) for k in LEVELS]
    rows = rows.join(chosen, on[0] & on[1] & on[2])
    partly = F.col(own + "last").isNotNull() & (_key(target, F.col(own + "full")) <= F.col(own + "last"))
    rows = rows.withColumn(own + "taken", (F.col(own + "full") + F.when(partly, 1).otherwise(0)).cast("int")).where(F.col(own + "taken") > 0)
    epochs = F.explode(F.sequence(F.lit(0), F.col(own + "taken") - 1))
    return rows.select(*docs.columns, F.col(own + "domain").alias("_domain"), epochs.alias("_epoch"))


def oracle(target: Target = Target()) -> str:
    """The registered query's result by DuckDB SQL, with one running sum for each leaf in place of hash ranges."""

    def weight(level: int) -> str:
        whens = " ".join(f"when {LEVELS[level]} = '{k}' then {v!r}::double" for k, v in getattr(target, LEVELS[level]).items())
        return f"case {whens} else {target.rest[level]!r}::double end" if whens else f"{target.rest[level]!r}::double"

    steps, parent = [], []
    for level, child in enumerate(LEVELS):
        keys = [*LEVELS[: level + 1]]
        given = "(select given from total)" if level == 0 else "max(p.budget)"
        source = "caps c" if level == 0 else f"caps c join share{level - 1} p using ({', '.join(parent)})"
        part = f"partition by {', '.join(parent)}" if parent else ""
        order = f"{part} order by cap / w, {child}"
        steps.append(f"""
    node{level} as (select {', '.join(keys)}, sum(c.cap) as cap, {weight(level)} as w, {given} as given from {source} group by {', '.join(keys)}),
    run{level} as (
      select *, coalesce(sum(cap) over ({order} rows between unbounded preceding and 1 preceding), 0) as c0,
        coalesce(sum(w) over ({order} rows between unbounded preceding and 1 preceding), 0) as w0,
        sum(w) over ({order} rows between unbounded preceding and unbounded following) as w1
      from node{level} where w > 0),
    full{level} as (select *, c0 + cap / w * (w1 - w0) <= given + {_EPS} as held from run{level}),
    share{level} as (
      select *, case when held then cap else greatest(0, w * (given - sum(case when held then cap else 0 end) over ({part}))
        / nullif(sum(case when held then 0 else w end) over ({part}), 0)) end as budget
      from full{level})""")
        parent = keys
    leaf = ", ".join(LEVELS)
    return rf"""
    with each as (
      select doc_id, lang as lang0, source as source0, coalesce(lang, '') as lang, coalesce(source, '') as source,
        case when regexp_matches(source, '^src[0-4]$') then 'crawl' when regexp_matches(source, '^src[5-9]$') then 'forum' else 'library' end as domain,
        len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) as tokens
      from documents),
    leaves as (select {leaf}, sum(tokens)::double as tokens from each group by {leaf}),
    caps as (select *, tokens * {float(target.epochs)} as cap from leaves where {" and ".join(f"{weight(k)} > 0" for k in range(len(LEVELS)))}),
    total as (select coalesce(sum(tokens), 0) * {target.fraction} as given from leaves),
    {','.join(steps)},
    plan as (
      select l.*, s.budget, least(floor((s.budget + {_EPS}) / l.tokens), {target.epochs})::bigint as whole
      from leaves l join share2 s using ({leaf}) where l.tokens > 0),
    cut as (select * exclude (tokens), case when whole < {target.epochs} then budget - whole * tokens else -1 end as rest from plan),
    run as (
      select e.*, c.whole, c.rest, sum(e.tokens) over (partition by {leaf}
        order by md5('{target.seed}:' || c.whole::varchar || ':' || coalesce(e.doc_id::varchar, ''))) as upto
      from each e join cut c using ({leaf}))
    select doc_id, domain, lang0 as lang, source0 as source, unnest(range(0, whole + case when upto <= rest + {_EPS} then 1 else 0 end))::int as epoch
    from run
    """

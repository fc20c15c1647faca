"""Quality rules: a decision list learnt by sequential covering, run as one Spark conditional expression.

Statistics of the whole text come from built-in functions only. The learner
binds each feature to its quantile bins, then grows one conjunction of threshold
conditions at a time by information gain on two thirds of the labelled rows,
prunes it from its end on the other third, and covers what it matches before it
grows the next. Every step is one aggregation to counts by (feature, bin); what
reaches the driver are at most ``features x bins`` counts, whatever the input's
size. A rule is kept only if it is precise on both parts, so documents that look
clean stay.

Cases: a null text has no words and fails the base rules; without labels (or
rows) the list is empty and whatever passes the base rules is kept; repeated rows each get
their row; a document labelled twice counts once, with its largest label; a null id has no
label and is judged like others; of conditions that gain alike, the earlier feature, "above", and the
middle threshold are taken; very long texts are read whole, as an array of their words in one task; other
columns pass through ``stats`` only if asked for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.labelled import held_out
from quarry.session import stage

_WS = r"[\x20\x09-\x0D]+"
_WS_CHARS = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_lines", "n_upper", "n_marks")


def _count(text: Column, chars: str) -> Column:
    """How many of the characters of a class there are. Runs of others are taken out at once, faster than ``translate`` goes by characters."""
    return F.length(F.regexp_replace(text, F.lit(f"[^{chars}]+"), F.lit("")))


def stats(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs``, then ``COUNTS`` and ``EXTRA`` of its ``text``, all long."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(text, F.lit(_WS_CHARS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _WS))

    def windows(w: Column) -> Column:
        return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        )

    def repeated(h: Column) -> Column:
        """Words in windows whose hash is there twice: sorted with their places, equal ones are neighbours."""
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            n = F.size(s)
            same = lambda a, b: F.get(s, a)["h"] == F.get(s, b)["h"]
            again = F.filter(s, lambda x, k: ((k > 0) & F.coalesce(same(k - 1, k), F.lit(False))) | ((k < n - 1) & F.coalesce(same(k, k + 1), F.lit(False))))
            return F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        # the one-element arrays bind a value once for the functions inside
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(F.get(F.transform(F.array(pairs), places), 0))

    def of_words(w: Column) -> Column:
        found = F.get(F.transform(F.array(windows(w)), repeated), 0)
        return F.struct(F.size(w).alias("n_words"), F.length(F.concat_ws("", w)).alias("word_chars"), found.alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_WS_CHARS)) != "")
    found = docs.select(
        *keep,
        F.get(F.transform(F.array(words), of_words), 0).alias("_w"),
        F.get(F.transform(F.array(lines), of_lines), 0).alias("_l"),
        _count(text, "#*$%&|<>").alias("n_symbols"),
        _count(text, "A-Z").alias("n_upper"),
        _count(text, "!").alias("n_marks"),
    )
    at = {"n_words": "_w.n_words", "word_chars": "_w.word_chars", "n_repeat_words": "_w.n_repeat_words", "n_lines": "_l.n_lines", "n_dup_lines": "_l.n_dup_lines"}
    return found.select(*keep, *[F.col(at.get(c, c)).cast("long").alias(c) for c in (*COUNTS, *EXTRA)])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _per(a: str, b: str) -> str:
    return f"{a} / greatest({b}, 1)"


#: What rules may speak of: SQL over the statistics.
FEATURES = {
    "words": "cast(n_words as double)",
    "word_length": _per("word_chars", "n_words"),
    "symbols": _per("n_symbols", "word_chars"),
    "dup_lines": _per("n_dup_lines", "n_lines"),
    "repeats": _per("n_repeat_words", "n_words"),
    "line_words": _per("n_words", "n_lines"),
    "upper": _per("n_upper", "word_chars"),
    "marks": _per("n_marks", "word_chars"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # over the threshold, or else at most it
    threshold: float
    bin: int

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold

    def binned(self) -> Column:
        b = F.get(F.col("bins"), list(FEATURES).index(self.feature))
        return b > self.bin if self.above else b <= self.bin

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Settings:
    bins: int = 32
    most_conditions: int = 4
    most_rules: int = 12
    precision: float = 0.9
    least_rows: int = 5


Rule = tuple[Condition, ...]


def _all(conditions, form) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & form(c)
    return out


def _counts(rows: DataFrame) -> dict[tuple[int, int, bool], tuple[int, int]]:
    """Bad and good rows by (feature, bin, part)."""
    flat = rows.select("bad", "grow", F.posexplode("bins").alias("f", "b"))
    got = flat.groupBy("f", "b", "grow").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    return {(r.f, r.b, r.grow): (r.p, r.n) for r in got}


def _splits(counts, feature: int, grow: bool, bins: int) -> list[tuple[int, bool, int, int]]:
    """(bin, above, bad, good) on one part for each threshold of a feature."""
    each = [counts.get((feature, b, grow), (0, 0)) for b in range(bins)]
    p_all, n_all = sum(p for p, _ in each), sum(n for _, n in each)
    out, p, n = [], 0, 0
    for b, (dp, dn) in enumerate(each[:-1]):
        p, n = p + dp, n + dn
        out += [(b, False, p, n), (b, True, p_all - p, n_all - n)]
    return out


def _grow(rows: DataFrame, edges: list[list[float]], s: Settings) -> tuple[Rule, list[tuple[int, int, int, int]]]:
    """One conjunction, and after each condition its (bad, good) on the growing and the pruning part."""
    names, rule, history = list(FEATURES), [], []
    while len(rule) < s.most_conditions:
        counts = _counts(rows.where(_all(rule, Condition.binned)))
        on = lambda grow: tuple(map(sum, zip(*[counts.get((0, b, grow), (0, 0)) for b in range(s.bins)])))
        p0, n0 = on(True)
        if not p0 or not n0:
            break
        old, found = math.log2(p0 / (p0 + n0)), []
        for f in range(len(names)):
            for b, above, p, n in _splits(counts, f, True, s.bins):
                if p >= s.least_rows and b < len(edges[f]):
                    found.append((p * (math.log2(p / (p + n)) - old), f, above, b, p, n))
        best = max(found, key=lambda x: (x[0], -x[1], x[2], -x[3]), default=None)
        if best is None or best[0] <= 1e-9:
            break
        # of thresholds that part the rows alike, the one in the middle leaves both sides a margin
        alike = [x for x in found if x[1:3] == best[1:3] and x[4:] == best[4:]]
        _, f, above, b, p, n = alike[len(alike) // 2]
        pruned = next((x[2:] for x in _splits(counts, f, False, s.bins) if x[:2] == (b, above)), (0, 0))
        rule.append(Condition(names[f], above, edges[f][b], b))
        history.append((p, n, *pruned))
    return tuple(rule), history


def _between(cuts: list[float]) -> list[float]:
    """The cuts and the middles of their gaps, so that a threshold need not lie at a value that rows have."""
    return sorted({*cuts, *((a + b) / 2 for a, b in zip(cuts, cuts[1:]))})


def edges_of(rows: DataFrame, s: Settings) -> list[list[float]]:
    """The thresholds of each feature of ``rows(bad, <features>)``.

    Quantiles of the bad and of all rows: features that tell the classes apart need cuts where the bad ones are.
    """
    names, cuts = list(FEATURES), [i / s.bins for i in range(1, s.bins)]
    every = [F.percentile_approx(F.col(n), cuts).alias(n) for n in names]
    bad = [F.percentile_approx(F.when(F.col("bad") == 1, F.col(n)), cuts[1::4]).alias(f"_{n}") for n in names]
    found = rows.agg(*every, *bad).first()
    return [_between(sorted({*(found[n] or []), *(found[f"_{n}"] or [])})) for n in names]


def learn(labelled: DataFrame, settings: Settings = Settings()) -> list[Rule]:
    """Rules for bad rows, in order, from ``labelled(bad, key, <statistics>)``; ``key`` deals rows to the two parts."""
    s, names = settings, list(FEATURES)
    rows = labelled.select("bad", (F.pmod(F.xxhash64("key"), F.lit(3)) != 0).alias("grow"), *[F.expr(v).alias(k) for k, v in FEATURES.items()])
    edges = edges_of(rows, s)
    s = Settings(max(map(len, edges), default=0) + 1, s.most_conditions, s.most_rules, s.precision, s.least_rows)

    def bin_of(name: str, cut: list[float]) -> Column:
        return sum((F.when(F.col(name) > t, 1).otherwise(0) for t in cut), F.lit(0))

    bins = [bin_of(n, e) for n, e in zip(names, edges)]
    left = rows = stage(rows.select("bad", "grow", F.array(*bins).alias("bins")), "bins")
    rules: list[Rule] = []
    while len(rules) < s.most_rules:
        rule, history = _grow(left, edges, s)
        if not rule:
            break
        worth = [(q - m) / (q + m) if q + m else (p - n) / (p + n) for p, n, q, m in history]
        keep = max(range(len(rule)), key=lambda i: (worth[i], -i))
        p, n, q, m = history[keep]
        if p + q < s.precision * (p + q + n + m) or (q + m and q < s.precision * (q + m)):
            break
        rules.append(rule[: keep + 1])
        left = left.where(~_all(rules[-1], Condition.binned))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The first rule that matches, as text; null where none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(_all(rule, Condition.column), F.lit(" and ".join(map(str, rule)))).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``COUNTS``, ``base_failed``, ``kept``, and ``rule``, the learnt rule that matches."""
    every = stage(stats(docs.select(F.col("doc_id"), "text"), "doc_id"), "stats")
    marked = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("_q"))
    known = every.join(marked.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id")).where(~base_failed())
    rules = learn(known.withColumn("bad", (F.col("_q") <= 0).cast("int")).withColumn("key", F.col("doc_id")), settings)
    out = every.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")

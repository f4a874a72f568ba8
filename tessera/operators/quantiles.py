"""Exact quantiles by sketch bracketing: mergeable sketches say where, counts decide.

A KLL sketch a group (one small buffer a task, merged) gives some values around
every quantile. One more scan finds each row's place between those values by binary
search and counts the rows of every such cell, with its smallest and largest value: one
plain aggregate of numbers. The counts give each cell's exact ranks, so a sketch never decides
a result, and a quantile that falls on a repeated value or at a cell's end is known at once.
While the cell of another holds more than ``GATHER`` rows, a sketch of what is inside
cuts it again. At last the values inside are grouped, and the exact rank is read there.
What is shuffled is sketches, counts and at most about ``GATHER`` values per quantile (a
hot value is one counted row a task), however many distinct values the table has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .joins import lookup

#: Size of a sketch, and how far from a quantile its values are cut finely, as a share of the rows.
SKETCH_K, MARGIN = 2048, 0.005
#: Rows of a cell whose values are gathered.
GATHER = 100_000
#: Values around a quantile, and over all the rows, at which cells are cut.
FINE, COARSE = 64, 16
#: Quantiles of a bracket's own sketch, of which those near the wanted one cut it.
STEPS = 1024
#: Groups and brackets that are compared as constants, not joined.
FEW = 32
#: Scans after which a cell is gathered whatever it holds.
ROUNDS = 12


def _sketch(x: Column) -> Column:
    return F.kll_sketch_agg_double(x, F.lit(SKETCH_K))


def _at(sketch: Column, ranks: list[float]) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(float(r)) for r in ranks]))


def _first(rows: DataFrame, group: list[str], probs, gather: int) -> DataFrame:
    """Per group: n, finite (rows that are not NaN), one bracket per probability and ``__p``, where to cut next."""
    real = F.when(~F.isnan("__x"), F.col("__x"))
    s = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__n"), F.count(real).alias("__finite"), F.min(real).alias("__min"),
        F.max(real).alias("__max"), _sketch(real).alias("__s"))
    ranks = {i / COARSE for i in range(COARSE + 1)}
    ranks |= {min(max(p + MARGIN * (2 * i / FINE - 1), 0.0), 1.0) for p in probs for i in range(FINE + 1)}
    cuts = F.when(F.col("__finite") > gather, F.array_sort(F.array_distinct(_at(F.col("__s"), sorted(ranks)))))
    brackets = []
    for p in probs:
        spot = F.lit(float(p)) * (F.col("__n") - 1)
        last = F.greatest(F.col("__finite") - 1, F.lit(0))
        brackets.append(_bracket(
            spot, F.least(F.floor(spot), last), F.least(F.ceil(spot), last), F.col("__min"), F.col("__max"),
            F.lit(0).cast("long"), F.col("__finite"), none := F.lit(None).cast("double"), none,
            # With few rows the bracket is the group and needs no counting.
            F.col("__finite") <= gather))
    return s.select(*group, "__n", "__finite", F.array(*brackets).alias("__b"), cuts.alias("__p"))


def _bracket(*parts: Column) -> Column:
    """``inside`` rows from ``lo`` to ``hi``, ``below`` under them; ``at_low`` and ``at_high``: the values, once known."""
    names = ("spot", "low", "high", "lo", "hi", "below", "inside", "at_low", "at_high", "done")
    return F.struct(*[c.alias(n) for c, n in zip(parts, names, strict=True)])


def _same(group: list[str], prefix: str) -> Column:
    """Null-safe match of a group with its renamed columns."""
    cond = F.lit(True)
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"{prefix}{i}"))
    return cond


def _beside(rows: DataFrame, state: DataFrame, group: list[str], column: str) -> DataFrame:
    """Rows with ``column`` of their group's state: its brackets, or cuts if there are groups."""
    if not group:
        row = state.select(F.transform(column, lambda b: F.struct(b["lo"].alias("lo"), b["hi"].alias("hi")))).first()  # one row of bounds
        bounds = [(None, None) if b is None else (b["lo"], b["hi"]) for b in row[0] or []]
        return rows.withColumn(column, F.array(*[F.struct(F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"))
                                                 for lo, hi in bounds]))
    # The state is stored, so its size is known: few groups are broadcast, many joined with hot ones salted.
    return lookup(rows, state.select(*group, "__n", column), group, count_col="__n", bound=state.count()).drop("__n")


def _with_cuts(rows: DataFrame, state: DataFrame, group: list[str]) -> DataFrame:
    """Rows of open groups with their group's cuts ``__p``; for few groups of plain keys without a join."""
    opened = state.filter("__p is not null")
    if all(isinstance(rows.schema[g].dataType, (T.StringType, T.IntegralType)) for g in group):
        few = opened.select(*group, "__p").limit(FEW + 1).collect()
        if few and (not group or len(few) <= FEW):
            cuts = None
            for r in few:
                same = F.lit(True)
                for g in group:
                    same = same & F.col(g).eqNullSafe(F.lit(r[g]))
                cuts = (F if cuts is None else cuts).when(same, F.array(*[F.lit(float(v)) for v in r["__p"]]))
            return rows.withColumn("__p", cuts).filter("__p is not null")
    return _beside(rows, state, group, "__p").filter("__p is not null")


def _near(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows that may lie in a bracket whose values are unknown: few brackets are compared before any join."""
    asked = state.select(F.explode("__b").alias("b")).filter("b.at_low is null and b.inside > 0")
    few = asked.select("b.lo", "b.hi").distinct().limit(FEW + 1).collect()
    if len(few) > FEW:
        return rows
    some = F.lit(False)
    for r in few:
        some = some | F.col("__x").between(F.lit(float(r["lo"])), F.lit(float(r["hi"])))
    return rows.filter(some)


def _cells(rows: DataFrame, state: DataFrame, group: list[str], most: int) -> DataFrame:
    """(group, cell, c, least, largest) of the rows between and at the cuts ``__p``, at most ``most``, of open groups."""
    met = _with_cuts(rows.filter(~F.isnan("__x")), state, group)
    met = met.withColumn("__i", F.lit(0))  # how many cuts are at or below the value
    for k in range(most.bit_length() - 1, -1, -1):
        reach = F.get("__p", F.col("__i") + F.lit((1 << k) - 1))
        met = met.withColumn("__i", F.col("__i") + F.when(reach <= F.col("__x"), F.lit(1 << k)).otherwise(F.lit(0)))
    at = F.when(F.get("__p", F.col("__i") - F.lit(1)) == F.col("__x"), F.lit(1)).otherwise(F.lit(0))
    # A value equal to a cut has a cell of its own, so a hot one is no cell's content.
    return met.select(*group, (F.col("__i") * F.lit(2) - at).alias("__cell"), "__x").groupBy(*group, "__cell").agg(
        F.count(F.lit(1)).alias("__c"), F.min("__x").alias("__least"), F.max("__x").alias("__largest"))


def _cuts(rows: DataFrame, state: DataFrame, group: list[str], probs) -> DataFrame:
    """State with ``__p`` anew: values of sketches of what every open bracket holds."""
    some = F.exists("__b", lambda b: ~b["done"])
    opened = F.when(some, F.transform("__b", lambda b: F.when(~b["done"], F.struct(b["lo"].alias("lo"), b["hi"].alias("hi")))))
    met = _beside(_near(rows.filter(~F.isnan("__x")), state), state.withColumn("__o", opened), group, "__o")
    x, bounds = F.col("__x"), [F.col("__o")[k] for k in range(len(probs))]
    inside = [F.coalesce((x >= b["lo"]) & (x <= b["hi"]), F.lit(False)) for b in bounds]
    any_of = F.lit(False)
    for c in inside:  # plain comparisons first: few rows are in any bracket
        any_of = any_of | c
    held = met.filter("__o is not null").filter(any_of).select(
        *group, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(inside)]))).alias("__k"), "__x")
    sketches = held.groupBy(*group, "__k").agg(_sketch(F.col("__x")).alias("__s"))
    asked = state.select(*[F.col(g).alias(f"__a_{i}") for i, g in enumerate(group)], F.posexplode("__b").alias("__ak", "b"))
    both = sketches.join(asked, (F.col("__k") == F.col("__ak")) & _same(group, "__a_"))
    share = (F.col("b.low") - F.col("b.below")) / F.greatest(F.col("b.inside") - 1, F.lit(1))
    near = lambda v, i: (F.abs(i / STEPS - share) <= F.lit(abs(MARGIN) + 1 / STEPS)) | (i % (STEPS // COARSE) == 0)
    values = F.filter(_at(F.col("__s"), [i / STEPS for i in range(STEPS + 1)]), near)
    cuts = both.select(*group, values.alias("__v")).groupBy(*group).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__v")))).alias("__p"))
    renamed = cuts.withColumnsRenamed({g: f"__c_{i}" for i, g in enumerate(group)})
    return state.drop("__p").join(renamed, _same(group, "__c_"), "left").drop(*[f"__c_{i}" for i in range(len(group))])


def _narrowed(rows: DataFrame, state: DataFrame, group: list[str], probs, gather: int) -> DataFrame:
    """Every open bracket becomes the cell that holds its ranks, or its values if the cells' ends tell them.

    Without cuts (after the first round) sketches of the brackets' rows give them: one scan, and one to count.
    """
    if "__p" not in state.columns:
        state = materialize(_cuts(rows, state, group, probs))
    most = state.agg(F.max(F.size("__p"))).first()[0]
    cells = _cells(rows, state, group, most)
    renamed = cells.withColumnsRenamed({g: f"__c_{i}" for i, g in enumerate(group)})
    # At most a few hundred cells a group.
    order = Window.partitionBy(*[f"__c_{i}" for i in range(len(group))]).orderBy("__cell")
    placed = renamed.withColumn("__to", F.sum("__c").over(order))
    asked = state.filter("__p is not null").select(*group, F.posexplode("__b").alias("__k", "b"))
    both = asked.join(placed, _same(group, "__c_"))
    begin = F.col("__to") - F.col("__c")

    def of(rank):  # the cell that holds a rank, and its value where that is an end of the cell
        r = F.col(f"b.{rank}")
        value = F.when(r == begin, F.col("__least")).when(r == F.col("__to") - 1, F.col("__largest")).when(
            F.col("__least") == F.col("__largest"), F.col("__least"))
        cell = F.struct(begin.alias("below"), F.col("__c").alias("inside"), F.col("__least").alias("lo"),
                        F.col("__largest").alias("hi"), (value + F.lit(0.0)).alias("value"))
        return F.max(F.when((begin <= r) & (r < F.col("__to")), cell)).alias(f"__{rank}")

    found = both.groupBy(*group, "__k").agg(of("low"), of("high")).groupBy(*group).agg(
        F.map_from_entries(F.collect_list(F.struct("__k", F.struct("__low", "__high")))).alias("__found"))
    renamed = found.withColumnsRenamed({g: f"__c_{i}" for i, g in enumerate(group)})
    joined = state.join(renamed, _same(group, "__c_"), "left")
    brackets = []
    for k in range(len(probs)):
        b, low, high = F.col("__b")[k], F.col("__found")[k]["__low"], F.col("__found")[k]["__high"]
        known = low["value"].isNotNull() & high["value"].isNotNull()
        # Two ranks in different cells are at the ends of both, so else one cell holds both.
        none = F.lit(None).cast("double")
        brackets.append(F.when(b["done"], b).otherwise(_bracket(
            b["spot"], b["low"], b["high"], F.when(~known, low["lo"]), F.when(~known, low["hi"]), low["below"],
            F.when(known, F.lit(0)).otherwise(low["inside"]), F.when(known, low["value"]).otherwise(none),
            F.when(known, high["value"]).otherwise(none), known | (low["inside"] <= gather))))
    return joined.select(*group, "__n", "__finite", F.array(*brackets).alias("__b"))


def _read(rows: DataFrame, state: DataFrame, group: list[str], many: int) -> DataFrame:
    """(group, k, low, high): the values at both ranks of each of ``many`` quantiles, from the gathered brackets."""
    bounds = [F.col("__b")[k] for k in range(many)]
    some = F.lit(False)
    for b in bounds:  # plain comparisons first: few rows are in any bracket
        some = some | ((F.col("__x") >= b["lo"]) & (F.col("__x") <= b["hi"]))
    near = F.filter(F.transform(F.col("__b"), lambda b, k: F.when(
        (F.col("__x") >= b["lo"]) & (F.col("__x") <= b["hi"]), k)), lambda k: k.isNotNull())
    held = (_beside(_near(rows.filter(~F.isnan("__x")), state), state, group, "__b").filter(some).select(*group, F.explode(near).alias("k"), "__x")
            .groupBy(*group, "k", "__x").agg(F.count(F.lit(1)).alias("c")))
    until = Window.partitionBy(*group, "k").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    placed = held.withColumn("to", F.sum("c").over(until))
    asked = state.select(*[F.col(g).alias(f"__a_{i}") for i, g in enumerate(group)], F.posexplode("__b").alias("__k", "b"))
    cond = F.col("k") == F.col("__k")
    for i, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"__a_{i}"))
    both = placed.join(asked, cond)

    def value(rank):
        at = F.col(f"b.{rank}") - F.col("b.below")
        return F.max(F.when((F.col("to") - F.col("c") <= at) & (at < F.col("to")), F.col("__x"))).alias(rank)

    return both.groupBy(*group, "k").agg(value("low"), value("high"))


def exact_quantiles(df: DataFrame, value: str, probs, group: list[str] | None = None, names: list[str] | None = None,
                    with_n: bool = False, gather: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles (``quantile_cont`` / ``percentile``), exact.

    One row per group with one column per probability: position p (n - 1) between the
    values at ranks floor and ceil of it. Nulls do not count; NaN is larger than
    any number. A group without values has no row; without ``group`` there is one row,
    of nulls if there are no values. ``with_n`` adds the group's count ``n``.
    """
    group, gather = group or [], GATHER if gather is None else gather
    names = names or [f"p{int(round(p * 100))}" for p in probs]
    rows = df.select(*group, F.col(value).cast("double").alias("__x")).filter("__x is not null")
    state = materialize(_first(rows, group, probs, gather))
    for _ in range(ROUNDS):
        if state.filter(F.exists("__b", lambda b: ~b["done"])).isEmpty():
            break
        state = materialize(_narrowed(rows, state, group, probs, gather))
    found = _read(rows, state, group, len(names))
    wide = found.groupBy(*group).agg(*[F.max(F.when(F.col("k") == k, F.struct("low", "high"))).alias(f"__v{k}")
                                       for k in range(len(names))])
    # Null-safe: a null group keeps its row, and a group of NaN alone has no values.
    renamed = wide.withColumnsRenamed({g: f"__w_{i}" for i, g in enumerate(group)})
    if group:
        cond = None
        for i, g in enumerate(group):
            e = F.col(g).eqNullSafe(F.col(f"__w_{i}"))
            cond = e if cond is None else cond & e
        joined = state.join(renamed, cond, "left")
    else:
        row = wide.select(F.struct(*[f"__v{k}" for k in range(len(names))]).alias("v")).scalar()
        joined = state.withColumn("v", row).select("*", "v.*")
    outs = []
    for k, name in enumerate(names):
        spot = F.col("__b")[k]["spot"]
        nan = F.lit(float("nan"))
        low, high = (F.coalesce(F.col("__b")[k][f"at_{end}"], F.col(f"__v{k}")[end]) for end in ("low", "high"))
        lo = F.when(F.floor(spot) >= F.col("__finite"), nan).otherwise(low)
        hi = F.when(F.ceil(spot) >= F.col("__finite"), nan).otherwise(high)
        part = spot - F.floor(spot)
        # Equal neighbours (infinite ones too) are the quantile itself.
        between = F.when((part == 0) | (lo == hi), lo).otherwise(lo + part * (hi - lo))
        outs.append(F.when(F.col("__n") > 0, between).alias(name))
    return joined.select(*group, *outs, *([F.col("__n").alias("n")] if with_n else []))


def rank_errors(df: DataFrame, value: str, answers: DataFrame, names: list[str], probs, group: str) -> DataFrame:
    """(group, name_rank_error...): how far each answer's rank is from p n, as a share of the group's n values.

    An answer that equals several values has the nearest of their ranks. ``answers`` has one row
    a group with a column per name; groups must be few (they are matched by a size-checked join).
    """
    x = F.col("__x")
    rows = df.select(group, F.col(value).cast("double").alias("__x")).filter("__x is not null")
    met = rows.join(answers.select(group, *names), group)
    counts = met.groupBy(group).agg(
        F.count(F.lit(1)).alias("__n"), *[F.count_if(x < F.col(c)).alias(f"__b_{c}") for c in names],
        *[F.count_if(x <= F.col(c)).alias(f"__u_{c}") for c in names])
    n = F.col("__n")
    away = [F.greatest(F.col(f"__b_{c}") - n * F.lit(float(p)), n * F.lit(float(p)) - F.col(f"__u_{c}"), F.lit(0.0)) / n
            for c, p in zip(names, probs)]
    return counts.select(group, *[a.alias(f"{c}_rank_error") for a, c in zip(away, names)])

"""Registered queries: one per operator family of the survey's inventory.

Each query takes (spark, sf_dir) and returns a lazy DataFrame over the
driver's tables; where the result is SQL-expressible, ``ORACLE[name]`` holds
the same computation as ANSI SQL (DuckDB dialect) over the same tables.
Doubles are rounded to 6 places on both sides so the comparison does not
depend on summation order.

Role mapping (the reference's movie tables are not available):
documents (text = description, source = genre, lang = country,
n_chars = duration) with labels (quality = target); orders
(o_custkey = director, o_orderpriority = genre, year(o_orderdate) = year,
o_totalprice = target).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as H
from ..functions import text as M
from ..operators import clean, encode, evaluate, joins, profile, split, topk, audit
from ..operators import text as text_ops
from ..sources.sinks import spread_if_asked
from ..sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

R = 6  # decimal places kept for doubles on both sides


def _snap_rounding(sql: str) -> str:
    """Give every ``round(x, d)`` of an oracle string the Spark-side rounding.

    ``round(x, d)`` becomes ``round(try_cast((x) as decimal(38,10)), d)::double``
    or x itself where it does not fit, as ``functions.scalars.round_half_up`` does.
    """
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + len(key)])
            i = j + len(key)
            continue
        depth, k, comma = 1, j + len(key), None
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = _snap_rounding(sql[j + len(key):comma])
        digits = sql[comma + 1:k - 1].strip()
        out.append(sql[i:j])
        out.append(f"coalesce(round(try_cast(({inner}) as decimal(38,10)), {digits})::double, ({inner})::double)")
        i = k


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = _snap_rounding(sql.strip())
        return fn
    return deco


def rnd(c, d: int = R):
    return H.round_half_up(F.col(c) if isinstance(c, str) else c, d)


# ---------------------------------------------------------------------------
# Flagship: J2 P6 A4 E2f T1

def flagship(spark: SparkSession, sf_dir: str, top_n: int = 5) -> DataFrame:
    """Mean target and smoothed target encoding of the top-N categories."""
    docs = load(spark, sf_dir, "documents", "doc_id", "source")
    labels = load(spark, sf_dir, "labels", "doc_id", "quality")
    rows = clean.drop_nulls(joins.join_on_key(docs, labels, "doc_id", "inner"),
                            ["source", "quality"])
    enc, mean = encode.fit_many(rows, [("source", "target"), ("source", "mean")], "quality")
    table = enc.table.join(mean.table.select("source", F.col("value").alias("mean_target")), on="source", how="inner")
    top = topk.top_rows(table, "n", top_n, tie=["source"])
    return top.select("source", "n", rnd("mean_target").alias("mean_target"),
                      rnd("value").alias("encoded"))


query("flagship_top_categories", """
with j as (
  select d.source, l.quality from documents d join labels l using (doc_id)
  where d.source is not null and l.quality is not null),
mu as (select avg(quality) as m from j),
g as (select source, count(*) as n, avg(quality) as mean_target from j group by source)
select source, n, round(mean_target, 6) as mean_target,
       round((mean_target * n + (select m from mu) * 10) / (n + 10), 6) as encoded
from g order by n desc, source limit 5
""")(flagship)


# ---------------------------------------------------------------------------
# Shared SQL fragments for the oracle side

def _bucket_sql(key: str, mod: int = 100, seed: int = 42) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::bigint % {mod})"


def _pct_sql(x: str, n: str) -> str:
    return f"round(100.0::double * ({x}) / ({n}), 2)"


# ---------------------------------------------------------------------------
# Validation entry point - left join, loss accounting, verdict

@query("left_join_usable", f"""
with j as (select d.doc_id, d.text, d.source, l.quality
           from documents d left join labels l using (doc_id)),
a as (select count(*) as original,
             count(*) filter (where quality is not null and text is not null and text <> ''
                              and source is not null and source <> '') as kept from j)
select original, kept, original - kept as removed, {_pct_sql('original - kept', 'original')} as pct_lost,
       {_pct_sql('kept', 'original')} as pct_usable,
       case when kept > 10000 then 'sufficient' when kept > 5000 then 'caution'
            else 'insufficient' end as verdict
from a
""")
def left_join_usable(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "source")
    labels = load(spark, sf_dir, "labels", "doc_id", "quality")
    j = joins.join_on_key(docs, labels, "doc_id", "left")
    keep = clean.keep_predicate(j, not_null=["quality"], not_empty=["text", "source"])
    return clean.sufficiency(clean.loss_accounting(j, keep))


# Inner join on the key, narrow projection with a rename to label

@query("inner_join_project", """
select o.o_orderkey, o.o_custkey, c.c_name, c.c_mktsegment, o.o_orderpriority,
       cast(year(o.o_orderdate) as integer) as year, o.o_totalprice as label
from orders o join customer c on o.o_custkey = c.c_custkey
""")
def inner_join_project(spark, sf_dir):
    orders = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority",
                  "o_orderdate", "o_totalprice")
    cust = load(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment") \
        .withColumnRenamed("c_custkey", "o_custkey")
    j = joins.join_on_key(orders, cust, "o_custkey", "inner")
    return j.select("o_orderkey", "o_custkey", "c_name", "c_mktsegment", "o_orderpriority",
                    F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("label"))


# Null profile of the left-joined validation table

_PROFILE_COLS = [("doc_id", False), ("text", True), ("lang", True), ("source", True),
                 ("n_chars", False), ("quality", False), ("toxic", False)]


def _profile_input(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    labels = load(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return joins.join_on_key(docs, labels, "doc_id", "left")


def _null_profile_sql() -> str:
    parts = []
    for c, is_text in _PROFILE_COLS:
        cond = f"{c} is null" + (f" or {c} = ''" if is_text else "")
        parts.append(f"select '{c}' as column_name, count(*) filter (where {cond}) as nulls, "
                     f"{_pct_sql(f'count(*) filter (where {cond})', 'count(*)')} as pct from j")
    return ("with j as (select d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
            "from documents d left join labels l using (doc_id))\n" + "\nunion all\n".join(parts))


@query("null_profile", _null_profile_sql())
def null_profile(spark, sf_dir):
    return profile.null_profile(_profile_input(spark, sf_dir))


@query("null_report", "select * from (" + _null_profile_sql()
       + ") order by nulls desc, column_name limit 15")
def null_report(spark, sf_dir):
    return profile.null_report(_profile_input(spark, sf_dir), top=15)


# Fully duplicated rows

@query("dedup_rows", """
select 'conversations' as source_table, cast(sum(c) as bigint) as n_rows,
       count(*) as distinct_rows, cast(sum(c - 1) as bigint) as duplicate_rows
from (select conv_id, turn, role, text, count(*) as c from conversations group by all)
union all
select 'documents.text', cast(sum(c) as bigint), count(*), cast(sum(c - 1) as bigint)
from (select text, count(*) as c from documents group by all)
""")
def dedup_rows(spark, sf_dir):
    conv = profile.duplicates(load(spark, sf_dir, "conversations"))
    docs = profile.duplicates(load(spark, sf_dir, "documents", "text"))
    def shape(df, name):
        return df.select(F.lit(name).alias("source_table"), F.col("rows").alias("n_rows"),
                         "distinct_rows", "duplicate_rows")
    return shape(conv, "conversations").unionByName(shape(docs, "documents.text"))


# Describe the target

@query("describe_target", """
select count(o_totalprice) as "count", round(avg(o_totalprice), 4) as mean,
       round(stddev_samp(o_totalprice), 4) as stddev, min(o_totalprice) as "min",
       max(o_totalprice) as "max"
from orders
""")
def describe_target(spark, sf_dir):
    d = profile.describe(load(spark, sf_dir, "orders", "o_totalprice"), "o_totalprice")
    return d.select("count", rnd("mean", 4).alias("mean"), rnd("stddev", 4).alias("stddev"),
                    "min", "max")


# Extremes and wide statistics of numeric columns

_WIDE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _long_sql(table: str, cols: list[str]) -> str:
    return " union all ".join(
        f"select '{c}' as column_name, cast({c} as double) as v from {table}" for c in cols)


@query("extremes", f"""
select column_name, min(v) + 0.0 as "min", max(v) + 0.0 as "max"
from ({_long_sql('lineitem', _WIDE_COLS)}) group by column_name
""")
def extremes(spark, sf_dir):
    e = profile.extremes(load(spark, sf_dir, "lineitem", *_WIDE_COLS), _WIDE_COLS)
    return e.select("column_name", (F.col("min") + 0.0).alias("min"), (F.col("max") + 0.0).alias("max"))


_W = 4  # decimals for the wide table (values up to 1e5)


def _wide_sql() -> str:
    qs = ", ".join(f"round(quantile_cont(v, {p}), {_W}) + 0.0 as p{int(round(p * 100))}"
                   for p in profile.WIDE_PROBS)
    m2 = "avg(power(v - mu, 2))"
    g1 = f"(avg(power(v - mu, 3)) / power({m2}, 1.5))"
    g2 = f"(avg(power(v - mu, 4)) / power({m2}, 2) - 3)"
    n = "count(v)::double"
    return f"""
with s as ({_long_sql('lineitem', _WIDE_COLS)}),
m as (select column_name, avg(v) as mu from s group by column_name)
select column_name, count(v) as "count", round(avg(v), {_W}) + 0.0 as mean,
       round(stddev_samp(v), {_W}) + 0.0 as std, round(min(v), {_W}) + 0.0 as "min", {qs},
       round(max(v), {_W}) + 0.0 as "max",
       round({g1}, {_W}) + 0.0 as skew_pop,
       round({g1} * sqrt({n} * ({n} - 1)) / ({n} - 2), {_W}) + 0.0 as skew_samp,
       round({g2}, {_W}) + 0.0 as kurt_pop,
       round((({n} + 1) * {g2} + 6) * ({n} - 1) / (({n} - 2) * ({n} - 3)), {_W}) + 0.0 as kurt_samp
from s join m using (column_name) group by column_name
"""


@query("wide_stats", _wide_sql())
def wide_stats(spark, sf_dir):
    w = profile.wide_stats(load(spark, sf_dir, "lineitem", *_WIDE_COLS), _WIDE_COLS)
    return w.select("column_name", "count",
                    *[(rnd(c, _W) + 0.0).alias(c) for c in w.columns if c not in ("column_name", "count")])


# Target summary

@query("target_shape", """
with m as (select avg(o_totalprice) as mu from orders),
s as (select avg(power(o_totalprice - mu, 3)) / power(avg(power(o_totalprice - mu, 2)), 1.5) as sk
      from orders, m)
select round((select mu from m), 4) as mean, round(median(o_totalprice), 4) as median,
       round((select sk from s), 6) as skewness,
       case when (select sk from s) < 0 then 'left' when (select sk from s) > 0 then 'right'
            else 'symmetric' end as direction
from orders
""")
def target_shape(spark, sf_dir):
    t = profile.target_shape(load(spark, sf_dir, "orders", "o_totalprice"), "o_totalprice")
    return t.select(rnd("mean", 4).alias("mean"), rnd("median", 4).alias("median"),
                    rnd("skewness").alias("skewness"), "direction")


# Text length against the target

@query("text_length_corr", """
select round(corr(length(d.text)::double, l.quality::double), 6) as r,
       case when abs(corr(length(d.text)::double, l.quality::double)) < 0.1 then 'close to zero'
            else 'not negligible' end as strength
from documents d join labels l using (doc_id)
""")
def text_length_corr(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    labels = load(spark, sf_dir, "labels", "doc_id", "quality")
    r = profile.length_correlation(joins.join_on_key(docs, labels, "doc_id"), "text", "quality")
    return r.select(rnd("r").alias("r"), "strength")


# Mean target per year

@query("mean_by_year", """
select cast(year(o_orderdate) as integer) as year, round(avg(o_totalprice), 4) as mean_target,
       count(*) as n
from orders group by 1
""")
def mean_by_year(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_orderdate", "o_totalprice")
    m = profile.mean_by(o, F.year("o_orderdate"), "o_totalprice", name="year")
    return m.select("year", rnd("mean_target", 4).alias("mean_target"), "n")


# Mean per labelled duration bin (events.value plays duration)

def _bin_sql(x: str) -> str:
    edges, labels = H.DURATION_BIN_EDGES, H.DURATION_BIN_LABELS
    arms = " ".join(f"when {x} < {e} then '{lab}'" for e, lab in zip(edges, labels))
    return f"case when {x} is null then null {arms} else '{labels[-1]}' end"


@query("mean_by_bin", f"""
select {_bin_sql('value')} as duration_bin, round(avg(value), 6) as mean_target, count(*) as n
from events group by 1
""")
def mean_by_bin(spark, sf_dir):
    e = load(spark, sf_dir, "events", "value")
    m = profile.mean_by(e, H.duration_bin("value"), "value", name="duration_bin", order_desc=True)
    return m.select("duration_bin", rnd("mean_target").alias("mean_target"), "n")


# Box-plot summaries, overall and per group

def _box_sql(group: str | None) -> str:
    g = f"{group}, " if group else ""
    on = f"using ({group})" if group else "on true"
    gb = f"group by {group}" if group else ""
    return f"""
with q as (select {g}quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
                  quantile_cont(value, 0.75) as q3 from events {gb}),
f as (select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lo_fence, q3 + 1.5 * (q3 - q1) as hi_fence from q),
c as (select {('e.' + group + ', ') if group else ''}count(e.value) as n,
             count(*) filter (where e.value < f.lo_fence or e.value > f.hi_fence) as outliers,
             min(case when e.value >= f.lo_fence then e.value end) as whisker_lo,
             max(case when e.value <= f.hi_fence then e.value end) as whisker_hi
      from events e join f {on} {('group by e.' + group) if group else ''})
select {g}round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, round(iqr, 6) as iqr,
       round(lo_fence, 6) as lo_fence, round(hi_fence, 6) as hi_fence,
       whisker_lo, whisker_hi, n, outliers
from f join c {on}
"""


def _box_round(df):
    return df.select(*[rnd(c).alias(c) if c in ("q1", "median", "q3", "iqr", "lo_fence", "hi_fence")
                       else F.col(c) for c in df.columns])


@query("boxplot_overall", _box_sql(None))
def boxplot_overall(spark, sf_dir):
    return _box_round(profile.boxplot(load(spark, sf_dir, "events", "value"), "value"))


@query("boxplot_by_group", _box_sql("event_type"))
def boxplot_by_group(spark, sf_dir):
    e = load(spark, sf_dir, "events", "event_type", "value")
    return _box_round(profile.boxplot(e, "value", group="event_type"))


# histograms

@query("histogram_tenths", """
select floor(round(value * 10, 6)) / 10.0 as bin, count(*) as n from events group by 1
""")
def histogram_tenths(spark, sf_dir):
    return profile.histogram_tenths(load(spark, sf_dir, "events", "value"), "value")


@query("histogram_width", """
select cast(floor((value - 0.0) / 25.0) as bigint) as bin, count(*) as n,
       cast(0.0 + cast(floor((value - 0.0) / 25.0) as bigint) * 25.0 as double) as bin_lo
from events where value is not null group by 1
""")
def histogram_width(spark, sf_dir):
    return profile.histogram_width(load(spark, sf_dir, "events", "value"), "value", 0.0, 25.0)


# Shape and type inventory (metadata; rows-only check)

@query("dtype_inventory", """
select (row_number() over () - 1)::integer as position, column_name as "column",
       case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double'
            when 'VARCHAR' then 'string' when 'DATE' then 'date' when 'TIMESTAMP' then 'timestamp_ntz'
            when 'TIMESTAMP WITH TIME ZONE' then 'timestamp'
            else lower(column_type) end as type,
       (select count(*) from lineitem) as n_rows, (select count(*) from (describe lineitem))::integer as n_cols
from (describe lineitem)
""")
def dtype_inventory(spark, sf_dir):
    return profile.dtype_inventory(load(spark, sf_dir, "lineitem"))


# Year parsing, digits-only and strict

@query("year_parse", """
select doc_id, source,
       try_cast(regexp_replace(source, '[^0-9]', '', 'g') as integer) as year_digits,
       try_cast(source as integer) as year_strict
from documents
""")
def year_parse(spark, sf_dir):
    d = load(spark, sf_dir, "documents", "doc_id", "source")
    return d.select("doc_id", "source", H.year_digits("source").alias("year_digits"),
                    H.year_strict("source").alias("year_strict"))


@query("year_parse_brand", """
select p_partkey, try_cast(regexp_replace(p_brand, '[^0-9]', '', 'g') as integer) as year_digits,
       try_cast(p_brand as integer) as year_strict
from part
""")
def year_parse_brand(spark, sf_dir):
    p = load(spark, sf_dir, "part", "p_partkey", "p_brand")
    return p.select("p_partkey", H.year_digits("p_brand").alias("year_digits"),
                    H.year_strict("p_brand").alias("year_strict"))


# H3 H4 H5 H6: derived columns

@query("derived_years", """
select o_orderkey, cast(year(o_orderdate) as integer) as year,
       cast((year(o_orderdate) // 10) * 10 as integer) as decade,
       case when year(o_orderdate) >= 2015 then 1.0 else 0.0 end::double as is_recent,
       case when year(o_orderdate) <= 1980 then 1.0 else 0.0 end::double as is_old_classic
from orders
""")
def derived_years(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    y = F.year("o_orderdate")
    return o.select("o_orderkey", y.alias("year"), H.decade(y).alias("decade"),
                    H.is_recent(y).alias("is_recent"), H.is_old_classic(y).alias("is_old_classic"))


@query("derived_duration", """
select doc_id, n_chars,
       case when n_chars <= 90 then 'short' when n_chars <= 120 then 'medium' else 'long' end
         as duration_category
from documents
""")
def derived_duration(spark, sf_dir):
    d = load(spark, sf_dir, "documents", "doc_id", "n_chars")
    return d.select("doc_id", "n_chars", H.duration_category("n_chars").alias("duration_category"))


# H7 H8 H9: ratio columns (lineitem values are positive: no zero divisors)

@query("ratio_columns", """
select l_orderkey, l_linenumber,
       round(l_extendedprice / (l_quantity + l_linenumber + 1), 6) as votes_per_review,
       round(l_quantity / (l_linenumber + 1), 6) as review_ratio,
       round(ln(1 + l_extendedprice), 6) as log_votes
from lineitem
""")
def ratio_columns(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return li.select(
        "l_orderkey", "l_linenumber",
        rnd(H.votes_per_review("l_extendedprice", "l_quantity", "l_linenumber")).alias("votes_per_review"),
        rnd(H.review_ratio("l_quantity", "l_linenumber")).alias("review_ratio"),
        rnd(H.log_votes("l_extendedprice")).alias("log_votes"))


# Null drop then non-empty filter

@query("null_drop_filter", """
select d.doc_id, d.source, l.quality
from documents d left join labels l using (doc_id)
where l.quality is not null and d.source is not null and d.text is not null
  and d.text <> '' and d.source <> ''
""")
def null_drop_filter(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "source")
    labels = load(spark, sf_dir, "labels", "doc_id", "quality")
    j = joins.join_on_key(docs, labels, "doc_id", "left")
    kept = clean.nonempty(clean.drop_nulls(j, ["quality", "source", "text"]), ["text", "source"])
    return kept.select("doc_id", "source", "quality")


# ---------------------------------------------------------------------------
# splits

_B = _bucket_sql("o_orderkey")


@query("hash_split_counts", f"""
select case when {_B} < 80 then 'train' else 'test' end as side, count(*) as n,
       cast(sum(o_orderkey) as bigint) as key_sum
from orders group by 1
""")
def hash_split_counts(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_orderkey")
    s = split.with_side(o, "o_orderkey")
    return s.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


# What a random split promises: every row on one side, and a share near the asked one
# (within five standard deviations of a Bernoulli draw).

@query("random_split_counts", """
select count(*) as n_rows, count(distinct o_orderkey) as n_keys, 0::bigint as on_both_sides, true as share_fits from orders
""")
def random_split_counts(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_orderkey")
    train, test = split.random_split(o)
    sides = train.select("o_orderkey", F.lit(1).alias("t")).unionByName(test.select("o_orderkey", F.lit(0).alias("t")))
    by_key = sides.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"))
    sums = by_key.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"),
                      F.count_if((F.col("t") > 0) & (F.col("t") < F.col("n"))).alias("on_both_sides"),
                      F.sum("t").alias("n_train"))
    share = split.TRAIN_PCT / 100
    fits = F.abs(F.col("n_train") - F.col("n_rows") * share) <= 5 * F.sqrt(F.col("n_rows") * (share * (1 - share)))
    return sums.select("n_rows", "n_keys", "on_both_sides", fits.alias("share_fits"))


# ---------------------------------------------------------------------------
# Encoders (orders: o_custkey plays director,
# o_totalprice in thousands plays the target)

def _orders_xy(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority",
             "o_orderdate", "o_totalprice")
    return o.withColumn("y", F.col("o_totalprice") / 1000.0).drop("o_totalprice")


_SPLIT_SQL = f"""
b as (select *, o_totalprice / 1000.0 as y, {_B} as bucket from orders),
tr as (select * from b where bucket < 80),
te as (select * from b where bucket >= 80)"""


@query("freq_encode", f"""
with {_SPLIT_SQL},
nt as (select count(*)::double as nt from tr),
f as (select o_custkey, count(*) as n from tr group by o_custkey)
select te.o_orderkey,
       coalesce(f.n / (select nt from nt), 1.0::double / (select nt from nt)) as o_custkey_freq
from te left join f using (o_custkey)
""")
def freq_encode(spark, sf_dir):
    train, test = split.hash_split(_orders_xy(spark, sf_dir), "o_orderkey")
    enc = encode.fit_frequency(train, "o_custkey")
    out = enc.apply(test.select("o_orderkey", "o_custkey"), salt_by=["o_orderkey"])
    return out.select("o_orderkey", "o_custkey_freq")  # one division: exact, whatever the size


@query("frequency_table", """
with nt as (select count(*)::double as nt from documents)
select lang, count(*) as n, count(*) / (select nt from nt) as freq
from documents group by lang
""")
def frequency_table(spark, sf_dir):
    t = encode.frequency_table(load(spark, sf_dir, "documents", "lang"), "lang")
    return t.select("lang", "n", "freq")


@query("target_encode", f"""
with {_SPLIT_SQL},
mu as (select avg(y) as m from tr),
g as (select o_custkey, avg(y) as mean, count(*) as n from tr group by o_custkey)
select te.o_orderkey,
       round(coalesce((g.mean * g.n + (select m from mu) * 10) / (g.n + 10), (select m from mu)), 6)
         as o_custkey_encoded
from te left join g using (o_custkey)
""")
def target_encode(spark, sf_dir):
    train, test = split.hash_split(_orders_xy(spark, sf_dir), "o_orderkey")
    enc = encode.fit_target(train, "o_custkey", "y")
    out = enc.apply(test.select("o_orderkey", "o_custkey"), salt_by=["o_orderkey"])
    return out.select("o_orderkey", rnd("o_custkey_encoded").alias("o_custkey_encoded"))


def _with_unknown_targets(spark, sf_dir):
    """Orders whose target is null where the key is divisible by seven."""
    return _orders_xy(spark, sf_dir).select("o_orderkey", "o_custkey",
                                            F.when(F.col("o_orderkey") % 7 != 0, F.col("y")).alias("y"))


@query("loo_encode", """
with b as (select o_orderkey, o_custkey, case when o_orderkey % 7 <> 0 then o_totalprice / 1000.0 end as y
           from orders),
mu as (select avg(y) as m from b)
select o_orderkey,
       round(coalesce(((sum(y) over w) - coalesce(y, 0)) / nullif((count(y) over w) - (y is not null)::int, 0),
                      (select m from mu)), 6) as o_custkey_loo
from b window w as (partition by o_custkey)
""")
def loo_encode(spark, sf_dir):
    o = _with_unknown_targets(spark, sf_dir)
    out = encode.loo_encode(o, "o_custkey", "y", salt_by=["o_orderkey"])
    return out.select("o_orderkey", rnd("o_custkey_loo").alias("o_custkey_loo"))


@query("kfold_encode", f"""
with b as (select o_orderkey, o_custkey, case when o_orderkey % 7 <> 0 then o_totalprice / 1000.0 end as y,
                  {_bucket_sql('o_orderkey', 5)} as fold
           from orders),
mu as (select avg(y) as m from b),
c as (select o_custkey, sum(y) as s, count(y) as n from b group by o_custkey),
cf as (select o_custkey, fold, sum(y) as s, count(y) as n from b group by o_custkey, fold)
select b.o_orderkey,
       round(coalesce((c.s - coalesce(cf.s, 0)) / nullif(c.n - cf.n, 0), (select m from mu)), 6) as o_custkey_kfold
from b join c using (o_custkey) join cf using (o_custkey, fold)
""")
def kfold_encode(spark, sf_dir):
    o = _with_unknown_targets(spark, sf_dir)
    out = encode.kfold_encode(o, "o_custkey", "y", key="o_orderkey", k=5)
    return out.select("o_orderkey", rnd("o_custkey_kfold").alias("o_custkey_kfold"))


@query("time_encode", """
select event_id,
       round(avg(value) over w, 6) as event_type_past_mean,
       count(*) over w as event_type_past_mean_n
from events
window w as (partition by event_type order by epoch_us(ts)
             range between unbounded preceding and 1 preceding)
""")
def time_encode(spark, sf_dir):
    e = load(spark, sf_dir, "events", "event_id", "event_type", "ts", "value")
    out = encode.time_encode(e, "event_type", "value", "ts", salt_by=["event_id"])
    return out.select("event_id", rnd("event_type_past_mean").alias("event_type_past_mean"),
                      "event_type_past_mean_n")


@query("time_encode_user", """
select event_id,
       round(avg(value) over w, 6) as user_id_past_mean,
       count(*) over w as user_id_past_mean_n
from events
window w as (partition by user_id order by epoch_us(ts)
             range between unbounded preceding and 1 preceding)
""")
def time_encode_user(spark, sf_dir):
    e = load(spark, sf_dir, "events", "event_id", "user_id", "ts", "value")
    out = encode.time_encode(e, "user_id", "value", "ts", salt_by=["event_id"])
    return out.select("event_id", rnd("user_id_past_mean").alias("user_id_past_mean"),
                      "user_id_past_mean_n")


@query("reduce_cardinality", f"""
with b as (select doc_id, source, {_bucket_sql('doc_id')} as bucket from documents),
top as (select source from b where bucket < 80 group by source order by count(*) desc, source limit 5)
select doc_id, case when source in (select source from top) then source else 'Other' end as source
from b
""")
def reduce_cardinality(spark, sf_dir):
    d = load(spark, sf_dir, "documents", "doc_id", "source")
    train, _ = split.hash_split(d, "doc_id")
    top = encode.fit_top_n(train, "source", 5)
    return encode.reduce_cardinality(d, "source", top, n=5)


@query("reduce_cardinality_part", f"""
with b as (select p_partkey, p_name, {_bucket_sql('p_partkey')} as bucket from part),
top as (select p_name from b where bucket < 80 group by p_name order by count(*) desc, p_name limit 30)
select p_partkey, case when p_name in (select p_name from top) then p_name else 'Other' end as p_name
from b
""")
def reduce_cardinality_part(spark, sf_dir):
    p = load(spark, sf_dir, "part", "p_partkey", "p_name")
    train, _ = split.hash_split(p, "p_partkey")
    top = encode.fit_top_n(train, "p_name", encode.TOP_N)
    return encode.reduce_cardinality(p, "p_name", top, n=encode.TOP_N)


# ---------------------------------------------------------------------------
# M1 M2 M4: token statistics in SQL form (whole texts)

def _tokens_sql() -> str:
    stop = M.stop_words_sql_list()
    return (f"list_filter(list_filter(regexp_split_to_array(lower(text), '\\W+'), "
            f"lambda w: length(w) >= 3), lambda w: not list_contains({stop}, w))")


@query("token_counts", f"""
with t as (select doc_id, unnest({_tokens_sql()}) as term from documents)
select term, count(*) as n, count(distinct doc_id) as docs from t group by term
""")
def token_counts(spark, sf_dir):
    d = spread_if_asked(load(spark, sf_dir, "documents", "text"))
    return text_ops.term_counts(d, "text")


@query("tfidf_terms", f"""
with m as (select count(*)::double as m from documents),
t as (select doc_id, unnest(list_distinct({_tokens_sql()})) as term from documents)
select term, count(*) as df, round(ln(((select m from m) + 1) / (count(*) + 1)), 6) as idf
from t group by term
""")
def tfidf_terms(spark, sf_dir):
    t = text_ops.idf_terms(spread_if_asked(load(spark, sf_dir, "documents", "text")), "text")
    return t.select("term", "df", rnd("idf").alias("idf"))


# ---------------------------------------------------------------------------
# Money parsing and multi-valued strings

@query("money_parse", """
select o_orderkey, case when o_orderpriority like '1%' then 'USD' else '$' end as currency,
       cast(o_totalprice as decimal(18, 2)) as amount
from orders
""")
def money_parse(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    money = F.concat(F.when(F.col("o_orderpriority").startswith("1"), F.lit("USD "))
                     .otherwise(F.lit("$ ")), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    m = o.select("o_orderkey", money.alias("money"))
    return m.select("o_orderkey", H.money_currency("money").alias("currency"),
                    H.money_amount("money").alias("amount"))


@query("split_multivalue", """
select item, count(*) as n from (select unnest(string_split(p_name, ' ')) as item from part)
where item <> '' group by item
""")
def split_multivalue(spark, sf_dir):
    p = load(spark, sf_dir, "part", "p_name")
    items = p.select(F.explode(H.split_multi("p_name", r"\s+")).alias("item"))
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------
# Evaluation of three fitted predictors
# on the held-out orders (global mean, priority mean, smoothed customer code)

def _predictions(spark, sf_dir):
    o = _orders_xy(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderpriority", "y")
    train, test = split.hash_split(o, "o_orderkey")
    # Both category tables and the global mean from one scan of the training rows.
    pri, cus = encode.fit_many(train, [("o_orderpriority", "mean"), ("o_custkey", "target")], "y")
    mu = pri.default
    p = pri.apply(test, drop=False, salt_by=["o_orderkey"])
    p = cus.apply(p, drop=False, salt_by=["o_orderkey"])
    return p.select("o_orderkey", F.col("y").alias("label"), mu.alias("p_global"),
                    F.col("o_orderpriority_mean").alias("p_priority"),
                    F.col("o_custkey_encoded").alias("p_customer"))


_PRED_SQL = f"""
with {_SPLIT_SQL},
mu as (select avg(y) as m from tr),
gp as (select o_orderpriority, avg(y) as p from tr group by o_orderpriority),
gc as (select o_custkey, avg(y) as mean, count(*) as n from tr group by o_custkey),
p as (select te.o_orderkey, te.y as label, (select m from mu) as p_global,
             coalesce(gp.p, (select m from mu)) as p_priority,
             coalesce((gc.mean * gc.n + (select m from mu) * 10) / (gc.n + 10), (select m from mu))
               as p_customer
      from te left join gp using (o_orderpriority) left join gc using (o_custkey))"""


def _metrics_sql(pred: str) -> str:
    return f"""
select round(sqrt(avg(power(label - {pred}, 2))), 6) as rmse,
       round(avg(abs(label - {pred})), 6) as mae,
       round(1 - sum(power(label - {pred}, 2)) / sum(power(label - (select avg(label) from p), 2)), 6) as r2,
       round(avg(power(label - {pred}, 2)), 6) as mse, count(*) as n
from p"""


def _round_metrics(m):
    return m.select(*[rnd(c).alias(c) if c in ("rmse", "mae", "r2", "mse") else F.col(c)
                      for c in m.columns])


@query("metrics_baseline", _PRED_SQL + _metrics_sql("p_priority"))
def metrics_baseline(spark, sf_dir):
    p = _predictions(spark, sf_dir)
    return _round_metrics(evaluate.metrics(p, "label", "p_priority"))


@query("worst_predictions", _PRED_SQL + """
select o_orderkey, round(label, 6) as label, round(p_priority, 6) as prediction,
       round(abs(label - p_priority), 6) as error
from p order by abs(label - p_priority) desc, o_orderkey limit 20
""")
def worst_predictions(spark, sf_dir):
    p = _predictions(spark, sf_dir).withColumnRenamed("p_priority", "prediction")
    w = evaluate.worst_predictions(p, "o_orderkey", 20, label="label", prediction="prediction")
    return w.select("o_orderkey", *[rnd(c).alias(c) for c in ("label", "prediction", "error")])


_MODELS = (("global_mean", "p_global"), ("priority_mean", "p_priority"),
           ("customer_encoded", "p_customer"))


def _long_predictions(p):
    return p.select("o_orderkey", "label", F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(c).alias("prediction")) for m, c in _MODELS])))


def _board_sql() -> str:
    long = " union all ".join(f"select '{m}' as model, label, {c} as prediction from p" for m, c in _MODELS)
    return _PRED_SQL + f""",
l as ({long}),
board as (select model, sqrt(avg(power(label - prediction, 2))) as rmse,
             avg(abs(label - prediction)) as mae,
             1 - sum(power(label - prediction, 2))
                 / (sum(label * label) - sum(label) * sum(label) / count(*)) as r2
      from l group by model)"""


@query("leaderboard", _board_sql() + """
select model, round(rmse, 6) as rmse, round(mae, 6) as mae, round(r2, 6) as r2,
       null::double as minutes,
       case when r2 < 0.4 then 'realistic' when r2 < 0.6 then 'acceptable'
            else 'suspect leakage' end as verdict
from board order by rmse
""")
def leaderboard(spark, sf_dir):
    board = evaluate.metrics_by(_long_predictions(_predictions(spark, sf_dir)), "model")
    lb = evaluate.leaderboard(board)
    return lb.select("model", *[rnd(c).alias(c) for c in ("rmse", "mae", "r2")], "minutes",
                     evaluate.r2_verdict(F.col("r2")).alias("verdict"))


@query("best_model", _board_sql() + """
select arg_min(model, rmse) as model, round(min(rmse), 6) as rmse from board
""")
def best_model(spark, sf_dir):
    board = evaluate.metrics_by(_long_predictions(_predictions(spark, sf_dir)), "model")
    return topk.best_model(board).select("model", rnd("rmse").alias("rmse"))


@query("improvement", _board_sql() + """
select model, round(rmse, 6) as rmse, round(r2, 6) as r2,
       round((base.brmse - rmse) / base.brmse * 100, 6) as rmse_improvement_pct,
       round((r2 - base.br2) / abs(base.br2) * 100, 6) as r2_improvement_pct
from board, (select rmse as brmse, r2 as br2 from board where model = 'priority_mean') as base
""")
def improvement(spark, sf_dir):
    board = evaluate.metrics_by(_long_predictions(_predictions(spark, sf_dir)), "model")
    imp = evaluate.improvement(board, "priority_mean")
    return imp.select("model", *[rnd(c).alias(c) for c in
                                 ("rmse", "r2", "rmse_improvement_pct", "r2_improvement_pct")])


@query("blend", _PRED_SQL.replace(
    "from te left join gp using (o_orderpriority) left join gc using (o_custkey))",
    "from te left join gp using (o_orderpriority) left join gc using (o_custkey)),"
    "\nq as (select *, 0.2 * p_global + 0.3 * p_priority + 0.5 * p_customer as prediction from p)")
    + _metrics_sql("prediction").replace("from p", "from q").replace(
        "(select avg(label) from q)", "(select avg(label) from q)"))
def blend(spark, sf_dir):
    p = evaluate.blended(_predictions(spark, sf_dir), ["p_global", "p_priority", "p_customer"])
    return _round_metrics(evaluate.metrics(p, "label", "prediction"))


# K1 with regParam 0 on one feature: closed form, equal to regr_slope / intercept

@query("ols_one_feature", """
select round(regr_slope(o_totalprice / 1000.0, o_custkey / 1000.0), 6) as slope,
       round(regr_intercept(o_totalprice / 1000.0, o_custkey / 1000.0), 6) as intercept
from orders
""")
def ols_one_feature(spark, sf_dir):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    o = load(spark, sf_dir, "orders", "o_custkey", "o_totalprice").select(
        (F.col("o_custkey") / 1000.0).alias("x"), (F.col("o_totalprice") / 1000.0).alias("label"))
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(o)
    model = LinearRegression(regParam=0.0, solver="normal").fit(data)
    coef = model.coefficients[0]
    return spark.range(1).select(rnd(F.lit(float(coef))).alias("slope"),
                                 rnd(F.lit(float(model.intercept))).alias("intercept"))


def _vectors(df, columns):
    """``df`` with the columns as an ML vector under the name that the model registry reads."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(columns), outputCol="scaled_features").transform(df)


def _linear_rows(spark, sf_dir):
    o = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return o.select("o_orderkey", (F.col("o_custkey") / 1000.0).alias("customer"),
                    F.month("o_orderdate").cast("double").alias("month"), (F.col("o_totalprice") / 1000.0).alias("y"))


_LINEAR_SQL = """
with r as (select o_orderkey, o_custkey / 1000.0 as customer, month(o_orderdate)::double as month,
                  o_totalprice / 1000.0 as y from orders)"""


# K1 K9 at regParam 0.1 on two features: the ML solvers and the closed form against the normal equations

@query("ridge_two_features", _LINEAR_SQL + """,
m as (select avg(customer) as m1, avg(month) as m2, avg(y) as my, var_pop(customer) as s11, var_pop(month) as s22,
             covar_pop(customer, month) as s12, covar_pop(customer, y) as c1, covar_pop(month, y) as c2,
             stddev_pop(y) as sy from r),
a as (select *, s11 * (1 + 0.1 / sy) as a11, s22 * (1 + 0.1 / sy) as a22 from m),
b as (select *, (a22 * c1 - s12 * c2) / (a11 * a22 - s12 * s12) as b1,
             (a11 * c2 - s12 * c1) / (a11 * a22 - s12 * s12) as b2 from a),
c as (select 'customer' as feature, b1 as v from b union all select 'month', b2 from b
      union all select '(intercept)', my - b1 * m1 - b2 * m2 from b)
select model, feature, round(v, 6) as coefficient from c, (select unnest(['ridge', 'glm', 'closed_form']) as model)
""")
def ridge_two_features(spark, sf_dir):
    from ..operators import linear
    from . import models

    rows = _linear_rows(spark, sf_dir)
    features = ["customer", "month"]
    data, specs = _vectors(rows, features), models.registry()
    out = linear.ridge(rows, features, "y", 0.1).withColumn("model", F.lit("closed_form"))
    for name in ("ridge", "glm"):
        fit = specs[name].build("scaled_features", "y", "prediction").fit(data)
        values = [*zip(features, map(float, fit.coefficients)), (linear.INTERCEPT, float(fit.intercept))]
        out = out.unionByName(spark.createDataFrame(values, "feature string, coefficient double")
                              .withColumn("model", F.lit(name)))
    return out.select("model", "feature", rnd("coefficient").alias("coefficient"))


# K1 K5 K6 K11 on one feature: the nine points of the ridge grid (0.1 with 0, 1 and 0.5
# are the ridge, the lasso and the elastic net), solved by ML and by the soft threshold

_GRID_SQL = """(select unnest([0.01, 0.1, 0.5]) as reg), (select unnest([0.0, 0.5, 1.0]) as elastic)"""


def _shrunk_sql(rows: str) -> str:
    """Coefficient and intercept of every grid point, from the rows of a table."""
    r = "(s.c / (s.sx * s.sy))"
    return f"""
select reg::double as reg, elastic::double as elastic, s.mx, s.my,
       sign({r}) * greatest(abs({r}) - reg * elastic / s.sy, 0) / (1 + reg * (1 - elastic) / s.sy) * s.sy / s.sx as coefficient
from (select avg(x) as mx, avg(y) as my, stddev_pop(x) as sx, stddev_pop(y) as sy, covar_pop(x, y) as c from {rows}) s,
     {_GRID_SQL}"""


@query("shrinkage_one_feature", _LINEAR_SQL + f""",
xy as (select month as x, y from r),
p as ({_shrunk_sql('xy')})
select solver, reg, elastic, round(coefficient, 6) as coefficient, round(my - coefficient * mx, 6) as intercept
from p, (select unnest(['ml', 'closed_form']) as solver)
""")
def shrinkage_one_feature(spark, sf_dir):
    from ..operators import linear
    from . import models, tune

    rows = _linear_rows(spark, sf_dir)
    data = _vectors(rows, ["month"])
    points = [(p["regParam"], p["elasticNetParam"]) for p in tune.points_of(tune.RIDGE_GRID)]
    fitted = []
    for reg, elastic in points:
        est = models.registry()["ridge"].build("scaled_features", "y", "prediction")
        fit = est.setRegParam(reg).setElasticNetParam(elastic).fit(data)
        fitted.append((reg, elastic, float(fit.coefficients[0]), float(fit.intercept)))
    ml = spark.createDataFrame(fitted, "reg double, elastic double, coefficient double, intercept double")
    both = ml.withColumn("solver", F.lit("ml")).unionByName(
        linear.shrunk(rows, "month", "y", points).withColumn("solver", F.lit("closed_form")))
    return both.select("solver", "reg", "elastic", rnd("coefficient").alias("coefficient"), rnd("intercept").alias("intercept"))


# The ridge grid's whole search on one feature - inner split, nine validation
# errors, the winner and its test metrics

@query("grid_search_one_feature", _LINEAR_SQL + f""",
t as (select month as x, y, {_bucket_sql('o_orderkey')} as outside, {_bucket_sql('o_orderkey', seed=43)} as inside from r),
train as (select x, y from t where outside < 80), test as (select x, y from t where outside >= 80),
fit as (select x, y from t where outside < 80 and inside < 80),
valid as (select x, y from t where outside < 80 and inside >= 80),
p as ({_shrunk_sql('fit')}),
e as (select reg, elastic, sqrt(avg(power(y - (my + coefficient * (x - mx)), 2))) as rmse from p, valid group by reg, elastic),
best as (select reg, elastic, rmse from e order by rmse, reg, elastic limit 1),
again as (select * from ({_shrunk_sql('train')}) join best using (reg, elastic)),
scored as (select y, my + coefficient * (x - mx) as yhat from again, test),
m as (select sqrt(avg(power(y - yhat, 2))) as rmse, avg(abs(y - yhat)) as mae,
             1 - sum(power(y - yhat, 2)) / sum(power(y - mu, 2)) as r2
      from scored, (select avg(y) as mu from scored))
select e.reg as "regParam", e.elastic as "elasticNetParam", round(e.rmse, 6) as rmse, best.reg is not null as is_best,
       case when best.reg is not null then round((select rmse from m), 6) end as test_rmse,
       case when best.reg is not null then round((select mae from m), 6) end as test_mae,
       case when best.reg is not null then round((select r2 from m), 6) end as test_r2
from e left join best on best.reg = e.reg and best.elastic = e.elastic
""")
def grid_search_one_feature(spark, sf_dir):
    from . import tune
    from .features import FeatureSpec, Prepared

    data = _vectors(_linear_rows(spark, sf_dir).select("o_orderkey", "month", "y"), ["month"])
    train, test = split.hash_split(data, "o_orderkey")
    spec = FeatureSpec(key="o_orderkey", label="y", text=None, hashed=[], reduce=[], encoders=[], numeric=["month"], indexed=[])
    res = tune.report(tune.search(Prepared(train, test, None, spec), "ridge"))
    return res.select("regParam", "elasticNetParam", rnd("rmse").alias("rmse"), "is_best",
                      *[rnd(c).alias(c) for c in ("test_rmse", "test_mae", "test_r2")])


# K8: isotonic regression over distinct values against the max-min formula

@query("isotonic_fit", """
with r as (select (year(o_orderdate) * 12 + month(o_orderdate))::double as x, o_totalprice / 1000.0 as y from orders),
g as (select x, count(*) as n, sum(y) as s from r group by x),
c as (select x, n, row_number() over (order by x) as i, sum(n) over (order by x) as cn, sum(s) over (order by x) as cs from g),
pairs as (select a.i as a, b.i as b, (b.cs - coalesce(p.cs, 0)) / (b.cn - coalesce(p.cn, 0)) as mean
          from c a join c b on b.i >= a.i left join c p on p.i = a.i - 1),
low as (select a, b as i, min(mean) over (partition by a order by b rows between current row and unbounded following) as m from pairs)
select c.x, c.n, round(max(low.m), 6) as fitted from low join c on c.i = low.i group by c.x, c.n
""")
def isotonic_fit(spark, sf_dir):
    from . import models

    o = load(spark, sf_dir, "orders", "o_orderdate", "o_totalprice")
    rows = o.select((F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("double").alias("x"),
                    (F.col("o_totalprice") / 1000.0).alias("y"))
    points = models.isotonic_points(_vectors(rows, ["x"]), 0, "y")
    est = models.registry()["isotonic"].build("scaled_features", "y", "prediction").setWeightCol("weight")
    fit = est.fit(points)
    return fit.transform(points).select(F.col("scaled_features").alias("x"), F.col("weight").cast("long").alias("n"),
                                        rnd("prediction").alias("fitted"))


# The gain of every cut, and a depth-1 tree's cut, gain and importance

_SPLIT_FEATURES = ["quantity", "l_discount", "l_tax", "l_linenumber"]


def _split_rows(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem", "l_quantity", "l_discount", "l_tax", "l_linenumber", "l_extendedprice")
    return li.select(F.floor(F.col("l_quantity") / 2).cast("double").alias("quantity"), "l_discount", "l_tax",
                     F.col("l_linenumber").cast("double").alias("l_linenumber"), (F.col("l_extendedprice") / 1000.0).alias("y"))


_GAIN_SQL = """
with r as (select floor(l_quantity / 2)::double as quantity, l_discount, l_tax, l_linenumber::double as l_linenumber,
                  l_extendedprice / 1000.0 as y from lineitem),
long as (""" + " union all ".join(f"select '{c}' as feature, {c}::double as value, y from r" for c in _SPLIT_FEATURES) + """),
g as (select feature, value, count(*) as n, sum(y) as s from long group by 1, 2),
w as (select feature, value, lead(value) over f as following, sum(n) over f as nl, sum(s) over f as sl,
             sum(n) over (partition by feature) as n, sum(s) over (partition by feature) as s
      from g window f as (partition by feature order by value)),
cuts as (select feature, (value + following) / 2 as threshold, nl::bigint as n_left, (n - nl)::bigint as n_right,
                nl::double * (n - nl) / (n::double * n) * power(sl / nl - (s - sl) / (n - nl), 2) as gain
         from w where following is not null)"""


@query("split_gains", _GAIN_SQL + """
select feature, round(threshold, 6) as threshold, n_left, n_right, round(gain, 6) as gain from cuts
""")
def split_gains(spark, sf_dir):
    from ..operators import splits

    gains = splits.split_gains(_split_rows(spark, sf_dir), _SPLIT_FEATURES, "y")
    return gains.select("feature", rnd("threshold").alias("threshold"), "n_left", "n_right", rnd("gain").alias("gain"))


# Rows of a partition that the tree fits over lineitem read: a task holds its partition's
# binned rows and errors, so this bounds it whatever the files' splits and row groups are.
_ROWS_PER_FIT_TASK = 500_000


def _split_vectors(spark, sf_dir):
    rows = _split_rows(spark, sf_dir)
    n = -(-rows.count() // _ROWS_PER_FIT_TASK)
    return _vectors(rows.repartition(n) if n > 1 else rows, _SPLIT_FEATURES)


@query("tree_first_split", _GAIN_SQL + """
select feature, round(threshold, 6) as threshold, round(gain, 6) as gain, 1.0::double as importance
from cuts where n_left >= 20 and n_right >= 20 order by gain desc, feature, threshold limit 1
""")
def tree_first_split(spark, sf_dir):
    from . import models

    data = _split_vectors(spark, sf_dir)
    tree = models.registry()["decision_tree"].build("scaled_features", "y", "prediction", maxDepth=1).fit(data)
    root = tree._java_obj.rootNode()
    at = root.split().featureIndex()
    top = models.importances(tree, _SPLIT_FEATURES).filter(F.col("feature") == _SPLIT_FEATURES[at])
    return top.select("feature", rnd(F.lit(float(root.split().threshold()))).alias("threshold"),
                      rnd(F.lit(float(root.gain()))).alias("gain"), rnd("importance").alias("importance"))


@query("forest_first_split", _GAIN_SQL + """
select feature, round(threshold, 6) as threshold, round(gain, 6) as gain, 1.0::double as importance, 30::bigint as n_trees
from cuts where n_left >= 10 and n_right >= 10 order by gain desc, feature, threshold limit 1
""")
def forest_first_split(spark, sf_dir):
    """K2 without its random draws (every row and feature in each tree): how many trees make which first cut."""
    from . import models

    data = _split_vectors(spark, sf_dir)
    forest = models.registry()["random_forest"].build("scaled_features", "y", "prediction", maxDepth=1, **_WHOLE_FOREST).fit(data)
    roots = [t._java_obj.rootNode() for t in forest.trees]
    cuts = spark.createDataFrame([(_SPLIT_FEATURES[r.split().featureIndex()], float(r.split().threshold()), float(r.gain()))
                                  for r in roots], "feature string, threshold double, gain double")
    cuts = cuts.select("feature", rnd("threshold").alias("threshold"), rnd("gain").alias("gain"))
    cuts = cuts.groupBy("feature", "threshold", "gain").agg(F.count(F.lit(1)).alias("n_trees"))
    return cuts.join(models.importances(forest, _SPLIT_FEATURES), "feature").select(
        "feature", "threshold", "gain", rnd("importance").alias("importance"), "n_trees")


# Boosted depth-1 trees without subsampling, step by step. Squared error's
# gradient is twice the residual, the first tree counts whole and the others by the step size.

_WHOLE_FOREST = {"subsamplingRate": 1.0, "bootstrap": False, "featureSubsetStrategy": "all"}
_BOOST_STEPS, _BOOST_RATE = 4, 0.1
_WHOLE_BOOST = {"subsamplingRate": 1.0, "maxDepth": 1, "maxIter": _BOOST_STEPS}


def _stump_sql(rows: str, target: str, features: list[str], least: int = 1) -> str:
    """The best cut of the rows for a target: feature, threshold, gain and the mean on either side."""
    long = " union all ".join(f"select '{c}' as feature, {c}::double as value, {target} as t from {rows}" for c in features)
    return f"""(select feature, (value + following) / 2 as threshold, sl / nl as low, (s - sl) / (n - nl) as high,
        nl::double * (n - nl) / (n::double * n) * power(sl / nl - (s - sl) / (n - nl), 2) as gain
 from (select feature, value, lead(value) over f as following, sum(n) over f as nl, sum(s) over f as sl,
              sum(n) over (partition by feature) as n, sum(s) over (partition by feature) as s
       from (select feature, value, count(*) as n, sum(t) as s from ({long}) group by 1, 2)
       window f as (partition by feature order by value))
 where following is not null and nl >= {least} and n - nl >= {least} order by gain desc, feature, threshold limit 1)"""


def _side_sql(features: list[str], cut: str) -> str:
    """What a cut predicts for a row."""
    value = " ".join(f"when '{c}' then {c}::double" for c in features)
    return f"case when case {cut}.feature {value} end <= {cut}.threshold then {cut}.low else {cut}.high end"


def _boost_sql(rows: str, features: list[str]) -> str:
    """CTEs ending in ``steps`` (tree, weight, cut): the boosting path over the rows' column y."""
    ctes = [f"f1 as (select *, 0.0::double as f, y as t from {rows})"]
    for k in range(1, _BOOST_STEPS + 1):
        weight = 1.0 if k == 1 else _BOOST_RATE
        ctes.append(f"c{k} as (select {k}::bigint as tree, {weight}::double as weight, c.* from {_stump_sql(f'f{k}', 't', features)} c)")
        if k < _BOOST_STEPS:
            ctes.append(f"p{k} as (select f{k}.* exclude (f, t), f + weight * {_side_sql(features, f'c{k}')} as f from f{k}, c{k})")
            ctes.append(f"f{k + 1} as (select *, 2 * (y - f) as t from p{k})")
    ctes.append("steps as (" + " union all ".join(f"select * from c{k}" for k in range(1, _BOOST_STEPS + 1)) + ")")
    return ",\n".join(ctes)


def _boosted(spark, sf_dir):
    from . import models

    data = _split_vectors(spark, sf_dir)
    return models.registry()["gbt"].build("scaled_features", "y", "prediction", **_WHOLE_BOOST).fit(data)


_BOOST_SQL = _GAIN_SQL.split(",\nlong as")[0] + ",\n" + _boost_sql("r", _SPLIT_FEATURES)


@query("boosted_stumps", _BOOST_SQL + """
select tree, weight, feature, round(threshold, 6) as threshold, round(gain, 6) as gain,
       round(low, 6) as low, round(high, 6) as high
from steps
""")
def boosted_stumps(spark, sf_dir):
    model = _boosted(spark, sf_dir)
    rows = []
    for k, (tree, weight) in enumerate(zip(model.trees, model.treeWeights), 1):
        root = tree._java_obj.rootNode()
        rows.append((k, float(weight), _SPLIT_FEATURES[root.split().featureIndex()], float(root.split().threshold()),
                     float(root.gain()), float(root.leftChild().prediction()), float(root.rightChild().prediction())))
    steps = spark.createDataFrame(rows, "tree long, weight double, feature string, threshold double, gain double, low double, high double")
    return steps.select("tree", "weight", "feature", *[rnd(c).alias(c) for c in ("threshold", "gain", "low", "high")])


@query("boosted_importances", _BOOST_SQL + """,
i as (select feature, coalesce(sum(gain), 0) / (select sum(gain) from steps) as importance
      from (select unnest([""" + ", ".join(f"'{c}'" for c in _SPLIT_FEATURES) + """]) as feature) left join steps using (feature)
      group by feature)
select feature, round(importance, 6) as importance, round(importance, 6) as share, importance > 0.3 as dominant
from i order by importance desc, feature limit 10
""")
def boosted_importances(spark, sf_dir):
    """A path's trees weigh by the variance that their cuts remove."""
    from . import models

    top = topk.top_importances(audit.dominance_audit(models.importances(_boosted(spark, sf_dir), _SPLIT_FEATURES)), 10)
    return top.select("feature", rnd("importance").alias("importance"), rnd("share").alias("share"), "dominant")


# Ridge, forest and boosted trees on one feature, fitted, scored and blended
# by the runs' own code, against their closed forms

_ENSEMBLE_SQL = _LINEAR_SQL + f""",
t as (select o_orderkey, month, y, {_bucket_sql('o_orderkey')} as bucket from r),
train as (select * from t where bucket < 80), test as (select * from t where bucket >= 80),
shrunk as (select * from ({_shrunk_sql('(select month as x, y from train)')}) where reg = 0.1 and elastic = 0),
stump as {_stump_sql('train', 'y', ['month'], 10)},
{_boost_sql('train', ['month'])},
single as (select o_orderkey, y as label, my + coefficient * (month - mx) as p_ridge, {_side_sql(['month'], 'stump')} as p_rf
           from test, shrunk, stump),
boosted as (select o_orderkey, sum(weight * {_side_sql(['month'], 'steps')}) as p_gbt from test, steps group by o_orderkey),
wide as (select *, 0.2 * p_ridge + 0.3 * p_rf + 0.5 * p_gbt as blend from single join boosted using (o_orderkey)),
p as (""" + " union all ".join(f"select '{m}' as model, o_orderkey, label, {c} as prediction from wide" for m, c in (
    ("ridge", "p_ridge"), ("random_forest", "p_rf"), ("gbt", "p_gbt"), ("ensemble", "blend"))) + ")"


def _ensemble_fit(spark, sf_dir):
    """(fit of the three models, the ensemble's predictions)."""
    from . import models
    from .features import FeatureSpec, Prepared

    data = _vectors(_linear_rows(spark, sf_dir).select("o_orderkey", "month", "y"), ["month"])
    train, test = split.hash_split(data, "o_orderkey")
    spec = FeatureSpec(key="o_orderkey", label="y", text=None, hashed=[], reduce=[], encoders=[], numeric=["month"], indexed=[])
    prep = Prepared(train, test, None, spec)
    fit = models.fit_all(prep, ("ridge", "random_forest", "gbt"), specs=models.registry(),
                         overrides={"random_forest": {"maxDepth": 1, **_WHOLE_FOREST}, "gbt": _WHOLE_BOOST})
    return fit, models.ensemble(prep, *[fit.models[m] for m in ("ridge", "random_forest", "gbt")])


@query("ensemble_one_feature", _ENSEMBLE_SQL + """
select model, round(sqrt(avg(power(label - prediction, 2))), 6) as rmse, round(avg(abs(label - prediction)), 6) as mae,
       round(1 - sum(power(label - prediction, 2)) / sum(power(label - mu, 2)), 6) as r2, count(*) as n
from p, (select avg(label) as mu from wide) group by model
""")
def ensemble_one_feature(spark, sf_dir):
    fit, ensemble = _ensemble_fit(spark, sf_dir)
    board = fit.board.drop("seconds").unionByName(
        evaluate.metrics(ensemble, label="y", prediction="prediction").withColumn("model", F.lit("ensemble")))
    return board.select("model", *[rnd(c).alias(c) for c in ("rmse", "mae", "r2")], "n")


@query("worst_ensemble_predictions", _ENSEMBLE_SQL + """,
e as (select *, abs(label - prediction) as error from p),
o as (select *, row_number() over (partition by model order by error desc, o_orderkey) as place from e)
select model, o_orderkey, round(label, 6) as label, round(prediction, 6) as prediction, round(error, 6) as error
from o where place <= 20
""")
def worst_ensemble_predictions(spark, sf_dir):
    from . import models

    fit, ensemble = _ensemble_fit(spark, sf_dir)
    worst = models.worst(fit, "o_orderkey", "y", 20).unionByName(
        evaluate.worst_predictions(ensemble, "o_orderkey", 20, label="y").withColumn("model", F.lit("ensemble")))
    return worst.select("model", "o_orderkey", rnd("y").alias("label"), *[rnd(c).alias(c) for c in ("prediction", "error")])


# Leakage audit of four encodings of o_custkey against the target

@query("leakage_audit", f"""
with b as (select o_orderkey, o_custkey, o_totalprice / 1000.0 as y,
                  {_bucket_sql('o_orderkey', 5)} as fold from orders),
mu as (select avg(y) as m from b),
nt as (select count(*)::double as nt from b),
c as (select o_custkey, sum(y) as s, count(*) as n, avg(y) as mean from b group by o_custkey),
cf as (select o_custkey, fold, sum(y) as s, count(*) as n from b group by o_custkey, fold),
e as (select b.y,
             (c.mean * c.n + (select m from mu) * 10) / (c.n + 10) as o_custkey_encoded,
             coalesce((c.s - b.y) / nullif(c.n - 1, 0), (select m from mu)) as o_custkey_loo,
             coalesce((c.s - cf.s) / nullif(c.n - cf.n, 0), (select m from mu)) as o_custkey_kfold,
             c.n / (select nt from nt) as o_custkey_freq
      from b join c using (o_custkey) join cf using (o_custkey, fold)),
r as (select 'o_custkey_encoded' as column_name, corr(o_custkey_encoded, y) as r from e
      union all select 'o_custkey_loo', corr(o_custkey_loo, y) from e
      union all select 'o_custkey_kfold', corr(o_custkey_kfold, y) from e
      union all select 'o_custkey_freq', corr(o_custkey_freq, y) from e)
select column_name, round(r, 6) as r, round(abs(r), 6) as abs_r,
       case when abs(r) > 0.9 then 'leak' when abs(r) < 0.3 then 'fine' else 'review' end as verdict
from r
""")
def leakage_audit(spark, sf_dir):
    o = _orders_xy(spark, sf_dir).select("o_orderkey", "o_custkey", "y")
    # E2, X1, X2, E1 of the same column from one fit and two lookups.
    e = encode.encodings(o, "o_custkey", "y", kinds=("target", "loo", "kfold", "frequency"),
                         key="o_orderkey", k=5)
    cols = ["o_custkey_encoded", "o_custkey_loo", "o_custkey_kfold", "o_custkey_freq"]
    a = audit.correlation_audit(e, cols, "y")
    return a.select("column_name", rnd("r").alias("r"), rnd("abs_r").alias("abs_r"), "verdict")


# CSV round trips through the session's shared checkpoint folder

def _scratch(spark, name):
    import uuid

    from ..session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("csv_roundtrip_part", "select * from part")
def csv_roundtrip_part(spark, sf_dir):
    from ..sources import csv as S

    p = load(spark, sf_dir, "part")
    path = _scratch(spark, "csv-part")
    S.write_csv(p, path, quote_escape=False)
    return S.read_csv(spark, path, p.schema)


@query("csv_roundtrip_documents", "select * from documents")
def csv_roundtrip_documents(spark, sf_dir):
    from ..sources import csv as S

    d = load(spark, sf_dir, "documents")
    path = _scratch(spark, "csv-docs")
    S.write_csv(d, path, quote_escape=True)
    return S.read_csv(spark, path, d.schema, quote_escape=True, multiline=True)


# ---------------------------------------------------------------------------
# Feature plan, models, tuning (rows-only checks).
# documents + labels play the movie table: text = description, source =
# genre, lang = director, n_chars = duration, quality = target.

def _doc_spec(kind: str = "frequency", extra_numeric=()):
    from .features import FeatureSpec

    return FeatureSpec(key="doc_id", label="quality", text="text", hashed=["source"],
                       reduce=["source"], encoders=[("lang", kind)],
                       numeric=["n_chars", *extra_numeric], indexed=["duration_category"])


def _doc_prepared(spark, sf_dir, kind: str = "frequency"):
    from .features import prepare

    docs = spread_if_asked(load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source",
                                 "n_chars"))
    labels = load(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    rows = clean.drop_nulls(joins.join_on_key(docs, labels, "doc_id", "inner"),
                            ["text", "lang", "source", "n_chars", "quality"])
    rows = rows.withColumns({"quality": F.col("quality").cast("double"),
                             "duration_category": H.duration_category("n_chars"),
                             "log_chars": H.log_votes("n_chars")})
    train, test = split.hash_split(rows, "doc_id")
    extra = ("log_chars",) if kind == "target" else ()
    return prepare(train, test, _doc_spec(kind, extra))


def _on_prepared(spark, sf_dir, body, kind: str = "frequency") -> DataFrame:
    """Run ``body(prep)`` on one shared feature fit; return its result checkpointed.

    The result no longer depends on the cached train/test tables, which are
    released in ``finally`` (S7), so a session running many queries does not
    keep every prepared table in executor memory.
    """
    from ..session import materialize

    prep = _doc_prepared(spark, sf_dir, kind)
    try:
        return materialize(body(prep))
    finally:
        prep.release()


def _rotl(x: str, r: int) -> str:
    return f"((({x}) << {r}) | (({x}) >> {32 - r})) & 4294967295"


def _mixed(k: str) -> list[str]:
    """Steps that mix one 32-bit block of murmur3, each over the one before (as ``k``)."""
    return [f"({k} * 3432918353::ubigint) & 4294967295", _rotl("k", 15), "(k * 461845907::ubigint) & 4294967295"]


def _murmur_sql(name: str, source: str, column: str) -> str:
    """CTEs ending in ``name`` (column, h): murmur3 (32 bits, seed 42) of the UTF-8 bytes, signed.

    Public algorithm with its public constants: blocks of four bytes, little-endian, then
    the rest, the length and the final mix.
    """
    byte = lambda i: f"x[({i}) * 2 + 1:({i}) * 2 + 2]"
    first, second, third = _mixed("k")
    mixed = f"[{third} for k in [{second} for k in [{first} for k in blocks]]]"
    tail = f"list_reduce([[{third} for k in [{second} for k in [{first} for k in [rest]]]][1]], lambda a, b: a)"
    turn = _rotl("xor(h, k)", 13)
    return f"""
{name}_hex as (select distinct {column}, hex(encode({column})) as x, octet_length(encode({column})) as len from {source}),
{name}_blocks as (
  select {column}, len, [('0x' || {byte('4 * i + 3')} || {byte('4 * i + 2')} || {byte('4 * i + 1')} || {byte('4 * i')})::ubigint
                         for i in range(0, len // 4)] as blocks,
         coalesce(('0x' || case when len % 4 > 2 then {byte('len // 4 * 4 + 2')} else '' end
                        || case when len % 4 > 1 then {byte('len // 4 * 4 + 1')} else '' end
                        || case when len % 4 > 0 then {byte('len // 4 * 4')} else '0' end)::ubigint, 0::ubigint) as rest
  from {name}_hex),
{name}_body as (
  select {column}, len, list_reduce([42::ubigint] || {mixed},
                                    lambda h, k: ((({turn}) * 5) + 3864292196::ubigint) & 4294967295) as h,
         case when len % 4 > 0 then {tail} else 0::ubigint end as t from {name}_blocks),
{name}_f1 as (select {column}, xor(xor(h, t), len::ubigint) as h from {name}_body),
{name}_f2 as (select {column}, (xor(h, h >> 16) * 2246822507::ubigint) & 4294967295 as h from {name}_f1),
{name}_f3 as (select {column}, (xor(h, h >> 13) * 3266489909::ubigint) & 4294967295 as h from {name}_f2),
{name}_f4 as (select {column}, xor(h, h >> 16)::bigint as h from {name}_f3),
{name} as (select {column}, case when h >= 2147483648 then h - 4294967296 else h end as h from {name}_f4)"""


def _slot_sql(h: str, n: int) -> str:
    return f"((({h} % {n}) + {n}) % {n})"


# M3 M5: the hashed slots of every document's words and of its source, whole texts

@query("hashed_slots", f"""
with words as (select doc_id, unnest({_tokens_sql()}) as term from documents),
{_murmur_sql('hashed', 'words', 'term')},
genres as (select doc_id, 'source=' || source as term from documents where source is not null),
{_murmur_sql('hashed_genres', 'genres', 'term')}
select doc_id, 'text' as part, {_slot_sql('h', 100)}::integer as slot, count(*)::double as value
from words join hashed using (term) group by all
union all
select doc_id, 'genre', {_slot_sql('h', 16)}::integer, 1.0::double from genres join hashed_genres using (term)
""")
def hashed_slots(spark, sf_dir):
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    from .features import transform_stages

    d = spread_if_asked(load(spark, sf_dir, "documents", "doc_id", "text", "source"))
    d = d.withColumn("text", F.coalesce("text", F.lit("")))
    out = PipelineModel(stages=transform_stages(_doc_spec())).transform(d)
    parts = [out.select("doc_id", F.lit(name).alias("part"), F.posexplode(vector_to_array(column)).alias("slot", "value"))
             for name, column in (("text", "text_tf"), ("genre", "hashed_features"))]
    return parts[0].unionByName(parts[1]).filter("value <> 0")


@query("hashed_features")
def hashed_features(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    def body(prep):
        both = prep.train.withColumn("side", F.lit("train")).unionByName(
            prep.test.withColumn("side", F.lit("test")))
        arr = vector_to_array("scaled_features")
        return both.select("doc_id", "side", "quality", F.size(arr).alias("n_features"),
                           F.size(F.filter(arr, lambda v: v != 0)).alias("nnz"))
    return _on_prepared(spark, sf_dir, body)


@query("model_comparison")
def model_comparison(spark, sf_dir):
    """K1-K9 on one feature fit: the leaderboard of all nine models."""
    from . import models

    return _on_prepared(spark, sf_dir,
                        lambda prep: models.report(models.fit_all(prep, models.ALL_MODELS)))


@query("target_encoded_run")
def target_encoded_run(spark, sf_dir):
    """The target-encoded run: nine models plus the weighted ensemble."""
    from . import models

    def body(prep):
        fit = models.fit_all(prep, models.LEAK_RUN)
        ens = models.ensemble(prep, fit.models["ridge"], fit.models["random_forest"],
                              fit.models["gbt"])
        em = evaluate.metrics(ens, "quality", "prediction").select(
            F.lit("ensemble").alias("model"), "rmse", "mae", "r2", "mse", "n",
            F.lit(None).cast("double").alias("seconds"))
        board = fit.board.unionByName(em)
        gain = evaluate.improvement(board, "ridge").select(
            "model", "rmse_improvement_pct", "r2_improvement_pct")
        lb = evaluate.leaderboard(board).withColumn("verdict", evaluate.r2_verdict(F.col("r2")))
        return lb.join(gain, on="model", how="left").orderBy("rmse", "model")
    return _on_prepared(spark, sf_dir, body, kind="target")


@query("worst_model_predictions")
def worst_model_predictions(spark, sf_dir):
    from . import models

    def body(prep):
        fit = models.fit_all(prep, ("ridge", "random_forest", "gbt"))
        ens = models.ensemble(prep, fit.models["ridge"], fit.models["random_forest"],
                              fit.models["gbt"])
        # The ensemble's listing goes through the same sorted top-20 path.
        ens_worst = evaluate.worst_predictions(ens, "doc_id", 20, label="quality") \
            .withColumn("model", F.lit("ensemble"))
        return models.worst(fit, "doc_id", "quality", 20).unionByName(ens_worst)
    return _on_prepared(spark, sf_dir, body, kind="target")


@query("grid_search")
def grid_search(spark, sf_dir):
    from . import tune

    return _on_prepared(spark, sf_dir, lambda prep: tune.report(tune.search(prep, "random_forest")))


@query("feature_importances")
def feature_importances(spark, sf_dir):
    from . import models

    def body(prep):
        return models.all_importances(models.fit_all(prep, models.TREE_MODELS), prep.feature_names(), 10)
    return _on_prepared(spark, sf_dir, body)


# ---------------------------------------------------------------------------
# Entry point 1 on the documents mapping: preview (T7) and label histogram

def _validation(spark, sf_dir):
    from .validation import validation_report

    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    labels = load(spark, sf_dir, "labels", "doc_id", "quality")
    cols = ("doc_id", "text", "lang", "source", "n_chars")
    return validation_report(docs, labels, key="doc_id", target="quality", columns=cols,
                             profiled=("label", "text", "lang", "source", "n_chars"),
                             not_null=("label", "text", "source", "n_chars"),
                             not_empty=("text", "source"), preview=("source", "n_chars", "label"),
                             year=None)


_VALID_SQL = """
with c as (select d.doc_id, d.source, d.n_chars, l.quality as label
           from documents d left join labels l using (doc_id)
           where l.quality is not null and d.text is not null and d.source is not null
             and d.n_chars is not null and d.text <> '' and d.source <> '')"""


@query("validation_preview", _VALID_SQL + """
select doc_id, source, n_chars, label from c order by doc_id limit 5
""")
def validation_preview(spark, sf_dir):
    return _validation(spark, sf_dir)["preview"]


@query("validation_histogram", _VALID_SQL + """
select floor(round(label * 10, 6)) / 10.0 as bin, count(*) as n from c group by 1
""")
def validation_histogram(spark, sf_dir):
    return _validation(spark, sf_dir)["label_histogram"]


# ---------------------------------------------------------------------------
# Typed load from text - every orders column written as text, read back
# as strings, coerced with try_cast / try_to_timestamp (bad values -> null)

@query("typed_coercion", """
select o_orderkey, o_custkey, o_totalprice, cast(o_orderdate as date) as o_orderdate,
       o_orderpriority
from orders
""")
def typed_coercion(spark, sf_dir):
    from pyspark.sql import types as T

    from ..sources import csv as S

    o = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate",
             "o_orderpriority")
    text = o.select("o_orderkey", "o_custkey", "o_totalprice",
                    F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderpriority")
    path = _scratch(spark, "csv-orders")
    S.write_csv(text, path)
    raw = S.read_csv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in text.columns]))
    return S.coerce(raw, {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double",
                          "o_orderdate": "date"}, date_formats={"o_orderdate": "yyyy-MM-dd"})


# Report and prediction sinks, read back from the shared folder

@query("leaderboard_sink", _board_sql() + """
select model, round(rmse, 6) as rmse, round(mae, 6) as mae, round(r2, 6) as r2 from board
""")
def leaderboard_sink(spark, sf_dir):
    from ..sources import sinks

    board = evaluate.metrics_by(_long_predictions(_predictions(spark, sf_dir)), "model")
    path = _scratch(spark, "report")
    sinks.write_report(evaluate.leaderboard(board).select(
        "model", *[rnd(c).alias(c) for c in ("rmse", "mae", "r2")]), path)
    return spark.read.schema("model string, rmse double, mae double, r2 double").json(path)


@query("worst_predictions_sink", _PRED_SQL + """
select o_orderkey, round(label, 6) as label, round(p_priority, 6) as prediction,
       round(abs(label - p_priority), 6) as error
from p order by abs(label - p_priority) desc, o_orderkey limit 20
""")
def worst_predictions_sink(spark, sf_dir):
    from ..sources import sinks

    path = _scratch(spark, "worst")
    sinks.write_predictions(worst_predictions(spark, sf_dir), path)
    return spark.read.parquet(path)


# Values that do not parse as a year, under both rules

@query("unparsed_years", """
select count(*) filter (where try_cast(source as integer) is null) as strict_unparsed,
       count(*) filter (where try_cast(regexp_replace(source, '[^0-9]', '', 'g') as integer) is null)
         as digits_unparsed,
       count(*) as n_rows
from documents
""")
def unparsed_years(spark, sf_dir):
    d = load(spark, sf_dir, "documents", "source")
    return d.agg(F.count_if(H.year_strict("source").isNull()).alias("strict_unparsed"),
                 F.count_if(H.year_digits("source").isNull()).alias("digits_unparsed"),
                 F.count(F.lit(1)).alias("n_rows"))


# Size of a fitted encoder, including its default entry

@query("encoder_size", f"""
with {_SPLIT_SQL}
select count(distinct o_custkey) + 1 as entries from tr
""")
def encoder_size(spark, sf_dir):
    train, _ = split.hash_split(_orders_xy(spark, sf_dir), "o_orderkey")
    return profile.distinct_count(encode.fit_frequency(train, "o_custkey").table)


# A11 at scale: one-pass sketch quantiles, their rank error checked

_APPROX_SQL = f"""
with s as ({_long_sql('lineitem', _WIDE_COLS)})
select column_name, count(v) as "count", round(avg(v), {_W}) + 0.0 as mean, round(min(v), {_W}) + 0.0 as "min",
       round(max(v), {_W}) + 0.0 as "max", count(v) > 0 as within
from s group by column_name
"""


@query("approx_wide_stats", _APPROX_SQL)
def approx_wide_stats(spark, sf_dir):
    """Moments beside whether every sketched percentile's exact rank keeps the promised error."""
    w = profile.approx_wide_stats(load(spark, sf_dir, "lineitem", *_WIDE_COLS), _WIDE_COLS)
    return w.select("column_name", "count", *[(rnd(c, _W) + 0.0).alias(c) for c in ("mean", "min", "max")], "within")


# The ridge and boosted-tree searches the reference defines

@query("grid_search_ridge")
def grid_search_ridge(spark, sf_dir):
    from . import tune

    return _on_prepared(spark, sf_dir, lambda prep: tune.report(tune.search(prep, "ridge")))


@query("grid_search_gbt")
def grid_search_gbt(spark, sf_dir):
    from . import tune

    return _on_prepared(spark, sf_dir, lambda prep: tune.report(tune.search(prep, "gbt")))


# Key uniqueness as an expectation (rows whose key repeats)

@query("key_uniqueness", """
select l_orderkey, l_linenumber, count(*) as n from lineitem
group by l_orderkey, l_linenumber having count(*) > 1
""")
def key_uniqueness(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    return joins.unique_keys(li, ["l_orderkey", "l_linenumber"])


# Entry points 1 to 3 whole, over the given tables in the movie schema

def _movies(spark, sf_dir):
    """documents and labels as the movie and rating sources (names and types of the runs)."""
    d = spread_if_asked(load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars"))
    o = load(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    o = o.select(F.col("o_orderkey").alias("k"), "o_custkey", "o_totalprice",
                 F.year("o_orderdate").cast("string").alias("year"))
    return d.join(o, F.col("doc_id") == F.col("k")).select(
        F.col("doc_id").alias("imdb_title_id"), F.substring("text", 1, 40).alias("title"), "year",
        F.col("source").alias("genre"), F.pmod("n_chars", F.lit(240)).cast("int").alias("duration"),
        F.col("o_custkey").cast("string").alias("director"), F.col("source").alias("writer"),
        F.concat_ws(", ", "lang", "source").alias("actors"), F.col("lang").alias("production_company"),
        F.col("text").alias("description"), (F.col("o_totalprice") / 1000.0).alias("avg_vote"),
        F.col("n_chars").cast("long").alias("votes"),
        F.pmod("n_chars", F.lit(97)).cast("double").alias("reviews_from_users"),
        F.pmod("n_chars", F.lit(31)).cast("double").alias("reviews_from_critics"))


def _run(spark, sf_dir, config, names, part):
    from . import runs

    movies = _movies(spark, sf_dir)
    ratings = load(spark, sf_dir, "labels", "doc_id").select(F.col("doc_id").alias("imdb_title_id"))
    return runs.train_and_compare(movies, ratings, config, model_names=names)[part]


@query("clean_run")
def clean_run(spark, sf_dir):
    """Entry point 2, clean configuration: leaderboard of all its models on a continuous label."""
    from . import models, runs

    return _run(spark, sf_dir, runs.CLEAN, models.CLEAN_RUN, "leaderboard")


# Both runs' assembled vectors, slot by slot. The SQL repeats the whole
# preparation: join, split, derived columns, top genres, encoders, hashed words with idf,
# the category's frequency rank, and scaling by the training rows' sample deviation.

def _movie_slots_sql(target: bool) -> str:
    numeric = (["duration", "votes", "log_votes", "reviews_from_users", "reviews_from_critics", "year_clean", "decade",
                "votes_per_review", "review_ratio", "is_recent", "is_old_classic"] if target else
               ["duration", "year_clean", "decade", "is_recent", "is_old_classic"])
    extra = " and votes is not null and users is not null and critics is not null" if target else ""
    value, unseen = (("(avg(avg_vote) * count(*) + (select avg(avg_vote) from train) * 10) / (count(*) + 10)",
                      "(select avg(avg_vote) from train)") if target else
                     ("count(*) / (select count(*) from train)::double", "1.0 / (select count(*) from train)"))
    suffix = "encoded" if target else "freq"
    column = {"reviews_from_users": "users", "reviews_from_critics": "critics"}
    cells = [f"select k, side, '{c}' as slot, {column.get(c, c)}::double as value from rows" for c in numeric]
    cells += [f"select rows.k, side, '{c}_{suffix}', coalesce(e.v, {unseen}) from rows left join "
              f"(select {c} as c, {value} as v from train group by 1) e on e.c is not distinct from rows.{c}"
              for c in ("director", "actors")]
    return f"""
with movies as (
  select d.doc_id as k, coalesce(d.text, '') as text, d.source as genre, (d.n_chars % 240)::integer as duration,
         o.o_custkey::varchar as director, concat_ws(', ', d.lang, d.source) as actors, o.o_totalprice / 1000.0 as avg_vote,
         d.n_chars::bigint as votes, (d.n_chars % 97)::double as users, (d.n_chars % 31)::double as critics,
         year(o.o_orderdate) as year_clean
  from documents d join orders o on d.doc_id = o.o_orderkey join labels l on l.doc_id = d.doc_id
  where d.text is not null and d.source is not null and d.n_chars is not null and o.o_custkey is not null
    and o.o_totalprice is not null and o.o_orderdate is not null{extra}),
rows as (
  select *, case when {_bucket_sql('k')} < 80 then 'train' else 'test' end as side, year_clean // 10 * 10 as decade,
         case when year_clean >= 2015 then 1.0 else 0.0 end as is_recent,
         case when year_clean <= 1980 then 1.0 else 0.0 end as is_old_classic, ln(1 + votes::double) as log_votes,
         votes::double / (users + critics + 1) as votes_per_review, users / (critics + 1) as review_ratio,
         case when duration <= 90 then 'short' when duration <= 120 then 'medium' else 'long' end as category
  from movies),
train as (select * from rows where side = 'train'),
top as (select genre from train group by genre order by count(*) desc, genre limit 30),
genres as (select k, side, 'genre=' || case when genre in (select genre from top) then genre else 'Other' end as term from rows),
{_murmur_sql('hashed_genres', 'genres', 'term')},
words as (select k, side, unnest({_tokens_sql()}) as term from rows),
{_murmur_sql('hashed', 'words', 'term')},
tf as (select k, side, {_slot_sql('h', 100)} as slot, count(*) as n from words join hashed using (term) group by all),
idf as (select slot, ln(((select count(*) from train) + 1.0) / (count(*) + 1.0)) as idf from tf where side = 'train' group by slot),
ranks as (select category, row_number() over (order by count(*) desc, category) - 1 as r from train group by category),
cells as (
  select k, side, 'text_features_' || tf.slot as slot,
         n * coalesce(idf, ln((select count(*) from train) + 1.0)) as value from tf left join idf using (slot)
  union all select k, side, 'hashed_features_' || {_slot_sql('h', 16)}, 1.0 from genres join hashed_genres using (term)
  union all {' union all '.join(cells)}
  union all select k, side, 'duration_category_indexed', coalesce(r, (select count(*) from ranks))::double
            from rows left join ranks using (category)),
size as (select count(*)::double as n from train),
spread as (
  select slot, sqrt(sum(power(value - mu, 2)) + (n - count(*)) * any_value(mu * mu)) / sqrt(n - 1) as sd
  from (select slot, value, n, sum(value) over (partition by slot) / n as mu from cells, size where side = 'train')
  group by slot, n)
select k as imdb_title_id, side, slot, round(value, 6) as value,
       round(case when coalesce(sd, 0) > 0 then value / sd else 0.0 end, 6) as scaled
from cells left join spread using (slot) where value <> 0
"""


def _movie_slots(spark, sf_dir, config):
    from . import runs

    ratings = load(spark, sf_dir, "labels", "doc_id").select(F.col("doc_id").alias("imdb_title_id"))
    v = runs.vectors(_movies(spark, sf_dir), ratings, config)
    return v.select("imdb_title_id", "side", "slot", rnd("value").alias("value"), rnd("scaled").alias("scaled"))


@query("clean_run_slots", _movie_slots_sql(False))
def clean_run_slots(spark, sf_dir):
    from . import runs

    return _movie_slots(spark, sf_dir, runs.CLEAN)


@query("target_run_slots", _movie_slots_sql(True))
def target_run_slots(spark, sf_dir):
    from . import runs

    return _movie_slots(spark, sf_dir, runs.TARGET_ENCODED)


def _movie_validation(spark, sf_dir):
    """Entry point 1 as it is called: every movie column, the year parsed strictly."""
    from .validation import validation_report

    labels = load(spark, sf_dir, "labels", "doc_id", "quality").select(
        F.col("doc_id").alias("imdb_title_id"), F.col("quality").alias("quality"))
    movies = _movies(spark, sf_dir)
    # Every third year is dirty text, so the strict parse has something to refuse.
    dirty = F.when(F.col("imdb_title_id") % 3 == 0, F.concat(F.lit("TV "), F.col("year"))).otherwise(F.col("year"))
    return validation_report(movies.withColumn("year", dirty).drop("avg_vote"), labels, target="quality")


_MOVIE_SQL = """
with m as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality as label, o.o_custkey,
         case when d.doc_id % 3 = 0 then 'TV ' || year(o.o_orderdate) else year(o.o_orderdate)::varchar end as year
  from documents d join orders o on d.doc_id = o.o_orderkey left join labels l on d.doc_id = l.doc_id),
c as (select *, try_cast(year as integer) as year_clean from m),
k as (select *, label is not null and source is not null and source <> '' and text is not null and text <> ''
                and n_chars is not null and year_clean is not null and concat_ws(', ', lang, source) <> '' as ok
      from c)
"""


@query("validation_accounting", _MOVIE_SQL + f"""
, a as (select count(*) as original, count(*) filter (where ok) as kept from k)
select original, kept, original - kept as removed, {_pct_sql('original - kept', 'original')} as pct_lost,
       {_pct_sql('kept', 'original')} as pct_usable,
       case when kept > 10000 then 'sufficient' when kept > 5000 then 'caution'
            else 'insufficient' end as verdict
from a
""")
def validation_accounting(spark, sf_dir):
    return _movie_validation(spark, sf_dir)["accounting"]


@query("validation_unparsed_years", _MOVIE_SQL + """
select count(*) filter (where year_clean is null) as unparsed from k
""")
def validation_unparsed_years(spark, sf_dir):
    return _movie_validation(spark, sf_dir)["unparsed_years"]


@query("validation_null_profile", _MOVIE_SQL + """
, p as (select count(*) as n, count(*) filter (where label is null) as label,
               count(*) filter (where source is null or source = '') as genre,
               count(*) filter (where year is null or year = '') as year,
               count(*) filter (where text is null or text = '') as description from k)
select column_name, nulls, """ + _pct_sql("nulls", "n") + """ as pct
from (unpivot p on label, genre, year, description into name column_name value nulls)
""")
def validation_null_profile(spark, sf_dir):
    return _movie_validation(spark, sf_dir)["null_profile"].filter(
        F.col("column_name").isin("label", "genre", "year", "description"))


@query("validation_label_summary", _MOVIE_SQL + """
select count(*) as count, round(avg(label), 4) as mean, round(stddev_samp(label), 4) as stddev,
       min(label)::double as min, max(label)::double as max
from k where ok
""")
def validation_label_summary(spark, sf_dir):
    d = _movie_validation(spark, sf_dir)["label_summary"]
    return d.select("count", rnd("mean", 4).alias("mean"), rnd("stddev", 4).alias("stddev"), "min", "max")


@query("plausible_years", """
select doc_id, case when y between 1870 and 2100 then y end as year
from (select doc_id, try_cast(regexp_replace(source || doc_id, '[^0-9]', '', 'g') as integer) as y from documents)
""")
def plausible_years(spark, sf_dir):
    """H1 with the D14 range check."""
    d = load(spark, sf_dir, "documents", "doc_id", "source")
    text = F.concat("source", F.col("doc_id").cast("string"))
    return d.select("doc_id", H.in_range(H.year_digits(text)).alias("year"))


@query("surrogate_keys", """
select source, count(*) as n, count(*) as distinct_ids from documents group by source
""")
def surrogate_keys(spark, sf_dir):
    """A row number that is unique within the plan that makes it."""
    d = load(spark, sf_dir, "documents", "source").withColumn("row_id", H.row_id())
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("distinct_ids"))

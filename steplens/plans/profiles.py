"""Aggregation and profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steplens.operators import profile as P
from steplens.operators import rows
from steplens.plans.registry import query
from steplens.sources.tables import Tables

_F = [f"f{i}" for i in range(8)]
_V = [*_F, "f_mono"]


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def sql_unpivot(columns: list[str], keep: str = "", source: str = "vec") -> str:
    return " union all ".join(f"select {keep}'{c}' feature, {c} value from {source}" for c in columns)


def sql_pairs(columns: list[str], digits: int = 6) -> str:
    return " union all ".join(f"select '{a}' a, '{b}' b, round(corr({a}, {b}), {digits}) r from vec" for i, a in enumerate(columns) for b in columns[i + 1 :])


@query("class_distribution", """with c as (select count(*) total, count(*) filter (where cls = 1) p, count(*) filter (where cls = 2) q from tx)
    select k cls, (select count(*) from tx where cls = k) n, round(100.0 * (select count(*) from tx where cls = k) / total, 6) percent, round(q / p, 6) negatives_per_positive from c, (values (1), (2), (3)) v(k)""")
def class_distribution(t: Tables) -> DataFrame:
    return rounded(P.class_distribution(t.tx), ["percent", "negatives_per_positive"])


@query("step_label_counts", """select step, count(tx_id) total, count(y) labelled, count(*) filter (where y = 1) positive, count(*) filter (where y = 0) negative, count(*) filter (where tx_id is not null and y is null) as "unknown"
    from spine left join (select * from tx where step not in (7, 8)) using (step) group by step""")
def step_label_counts(t: Tables) -> DataFrame:
    return P.step_label_counts(t.tx.where("step NOT IN (7, 8)"), t.spine())


@query("temporal_summary", """with s as (select step, count(*) total, count(y) labelled, count(*) filter (where y = 1) positive from tx group by step)
    select 'total' "column", min(total) least, quantile_cont(total, 0.5) median, max(total) greatest from s union all select 'labelled', min(labelled), quantile_cont(labelled, 0.5), max(labelled) from s
    union all select 'positive', min(positive), quantile_cont(positive, 0.5), max(positive) from s""")
def temporal_summary(t: Tables) -> DataFrame:
    return P.temporal_summary(P.step_label_counts(t.tx, t.spine()), ["total", "labelled", "positive"])


@query("window_label_counts", """select "window", count(*) total, count(y) labelled, sum(y)::bigint positive, round(100.0 * count(y) / count(*), 6) labelled_percent from tx join windows on step between lo and hi group by 1""")
def window_label_counts(t: Tables) -> DataFrame:
    by = rows.window_mask(t.tx.select("step", "y"), t.windows()).groupBy("window")
    return by.agg(F.count("*").alias("total"), F.count("y").alias("labelled"), F.sum("y").alias("positive"), F.round(100.0 * F.count("y") / F.count("*"), 6).alias("labelled_percent"))


@query("column_profile", f"""with u as ({sql_unpivot(["price", "score"], "", "tx")}), v as (select feature, case when feature = 'score' and value > 0.5 then null else value end value from u)
    select feature "column", count(value) n, count(*) - count(value) missing, 0::bigint infinite, round(avg(value), 4) mean, round(stddev_pop(value), 4) std, round(min(value), 4) least, round(max(value), 4) greatest,
    round(100.0 * count(*) filter (where value = 0) / count(value), 4) zero_percent, round(100.0 * count(*) filter (where value < 0) / count(value), 4) negative_percent, max(value) = min(value) constant, stddev_pop(value) < 1e-6 near_constant from v group by 1""")
def column_profile(t: Tables) -> DataFrame:
    df = t.tx.selectExpr("price", "CASE WHEN score > 0.5 THEN NULL ELSE score END AS score")
    return rounded(P.column_profile(df, ["price", "score"]), ["mean", "std", "least", "greatest", "zero_percent", "negative_percent"], 4)


@query("label_conditional_moments", f"""with u as ({sql_unpivot(["price", "score"], "y, ", "tx")}) select feature, y, count(*) n, round(sum(value), 2) total, round(sum(value * value) / count(*), 2) mean_square from u where y is not null group by 1, 2""")
def label_conditional_moments(t: Tables) -> DataFrame:
    m = P.label_moments(t.tx, ["price", "score"])
    return m.select("feature", "y", "n", F.round("total", 2).alias("total"), F.round(F.col("squares") / F.col("n"), 2).alias("mean_square"))


@query("point_biserial", """select 'price' feature, round(corr(price, y), 6) r from tx where y is not null union all select 'score', round(corr(score, y), 6) from tx where y is not null""")
def point_biserial(t: Tables) -> DataFrame:
    return rounded(P.point_biserial(t.tx, ["price", "score"]), ["r"])


@query("early_late_shift", " union all ".join(f"select '{c}' feature, round(avg({c}) filter (where step <= 34), 6) early, round(avg({c}) filter (where step > 34), 6) late, round((avg({c}) filter (where step > 34) - avg({c}) filter (where step <= 34)) / stddev_pop({c}), 6) shift from vec" for c in _V))
def early_late_shift(t: Tables) -> DataFrame:
    return rounded(P.early_late_shift(t.vec, _V), ["early", "late", "shift"])


@query("systematic_sample", "select tx_id, step from (select *, row_number() over (order by tx_id) - 1 r from tx) where r % 60 = 0")
def systematic_sample(t: Tables) -> DataFrame:
    return P.systematic_sample(t.tx.select("tx_id", "step"), "tx_id", 60)


@query("sample_quantiles", " union all ".join(f"select '{c}' feature, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) {a}" for a, q in (("p1", 0.01), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p99", 0.99))) + f", round(skewness({c}), 6) skew from vec" for c in _V))
def sample_quantiles(t: Tables) -> DataFrame:
    return rounded(P.sample_quantiles(t.vec, _V), ["p1", "p25", "p50", "p75", "p99", "skew"])


@query("corr_matrix", sql_pairs(_V))
def corr_matrix(t: Tables) -> DataFrame:
    return rounded(P.corr_matrix(t.vec, _V), ["r"]).select("a", "b", "r")


@query("redundant_pairs", f"select a, b, r, b as drop from ({sql_pairs(_V)}) where abs(r) >= 0.1")
def redundant_pairs(t: Tables) -> DataFrame:
    return P.redundant_pairs(rounded(P.corr_matrix(t.vec, _V), ["r"]), 0.1)


@query("best_match_column", f"""with m as ({sql_pairs(_V)}), b as (select a target, b other, r from m union all select b, a, r from m)
    select target, other, r from b where target in ('f0', 'f1', 'f_mono') and other not in ('f0', 'f1', 'f_mono') qualify row_number() over (partition by target order by abs(r) desc, other) = 1""")
def best_match_column(t: Tables) -> DataFrame:
    return P.best_match_column(rounded(P.corr_matrix(t.vec, _V), ["r"]), ["f0", "f1", "f_mono"])


@query("collinear_partners", f"""with m as ({sql_pairs(_V)}), b as (select a focal, b partner, r from m union all select b, a, r from m)
    select focal, partner, r, case when abs(r) >= 0.12 then 'strong' when abs(r) >= 0.08 then 'some' else 'weak' end tier, row_number() over (partition by focal order by abs(r) desc, partner) as rank
    from b where focal in ('f0', 'f2') qualify row_number() over (partition by focal order by abs(r) desc, partner) <= 3""")
def collinear_partners(t: Tables) -> DataFrame:
    return P.collinear_partners(rounded(P.corr_matrix(t.vec, _V), ["r"]), ["f0", "f2"], 0.12, 0.08)


@query("single_feature_auc", f"""with u as ({sql_unpivot(_V, "cast(side as int) y, ")}), r as (select feature, y, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2 k from u),
    s as (select feature, sum(k) filter (where y = 1) k, count(*) filter (where y = 1) p, count(*) filter (where y = 0) q from r group by 1)
    select feature, round((k - p * (p + 1) / 2) / (p * q), 6) auc, round(abs((k - p * (p + 1) / 2) / (p * q) - 0.5), 6) strength from s""")
def single_feature_auc(t: Tables) -> DataFrame:
    return rounded(P.single_feature_auc(t.vec.withColumn("y", F.col("side").cast("int")), _V), ["auc", "strength"])


@query("variance_signature", f"""with u as ({sql_unpivot(_V, "step, ")}), b as (select feature, step, count(*) n, avg(value) m, var_pop(value) v from u group by 1, 2),
    r as (select *, rank() over (partition by feature order by round(m, 9)) km, rank() over (partition by feature order by step) ks, sum(n) over (partition by feature) total, sum(n * m) over (partition by feature) / sum(n) over (partition by feature) g from b),
    s as (select feature, sum(n * v / total) w, sum(n * (m - g) * (m - g) / total) bt, corr(km, ks) rho from r group by 1)
    select feature, round(w, 6) within_var, round(bt, 6) between_var, round(rho, 6) rho, round(bt / (bt + w), 6) eta2, case when abs(rho) >= 0.9 and bt / (bt + w) >= 0.5 then 'clock' when bt / (bt + w) >= 0.5 then 'regime' else 'stationary' end verdict from s""")
def variance_signature(t: Tables) -> DataFrame:
    return rounded(P.variance_signature(t.vec, _V), ["within_var", "between_var", "rho", "eta2"])


@query("rank_table", "select step, n, row_number() over (order by n desc, step) as rank from (select step, count(*) n from tx group by step) qualify row_number() over (order by n desc, step) <= 10")
def rank_table(t: Tables) -> DataFrame:
    return P.rank_table(t.tx.groupBy("step").agg(F.count("*").alias("n")), "n", "step", 10)

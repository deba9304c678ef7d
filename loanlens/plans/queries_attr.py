"""Registered queries: TreeSHAP attribution of the fixed leaf-table ensemble
over the whole book, base value / additivity, ranked and packed factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens import schemas as S
from loanlens.operators import ensemble as E
from loanlens.plans import book
from loanlens.plans import oracle_sql as O
from loanlens.plans.catalog import query

TOP_K = 6
CHART_K = 10


def book_shap(spark, sf):
    feats, _ = book.book_features(spark, sf)
    return E.tree_shap(feats, E.fixed_ensemble())


@query("tree_shap", O.shap_ctes() + "SELECT SK_ID_CURR, feature, feature_pos, shap_value FROM shap",
       doubles=["shap_value"])
def tree_shap(spark, sf):
    """K1: SHAP value of every applicant and feature (long table)."""
    return E.shap_long(book_shap(spark, sf))


@query("shap_base_value", O.shap_ctes(O.SCORES) + f"""SELECT s.SK_ID_CURR, {O._sql_num(E.base_value(E.fixed_ensemble()))} AS base_value,
  sum(s.shap_value) AS shap_sum, max(m.margin) AS margin
FROM shap s JOIN scores m ON s.SK_ID_CURR = m.SK_ID_CURR GROUP BY s.SK_ID_CURR""",
       doubles=["base_value", "shap_sum", "margin"])
def shap_base_value(spark, sf):
    """K2: base value, and per applicant the SHAP sum and the margin
    (base + sum = margin)."""
    feats, _ = book.book_features(spark, sf)
    ens = E.fixed_ensemble()
    shap = E.tree_shap(feats, ens).select(
        "SK_ID_CURR", F.aggregate("shap", F.lit(0.0), lambda a, s: a + s["shap_value"]).alias("shap_sum"))
    margin = E.score(feats, ens).select("SK_ID_CURR", "margin")
    return shap.join(margin, "SK_ID_CURR").select("SK_ID_CURR", F.lit(E.base_value(ens)).alias("base_value"),
                                                   "shap_sum", "margin")


@query("top_factors", O.shap_ctes(O.DISPLAY, O.TOP_FACTORS) + """SELECT SK_ID_CURR, CAST(rank AS INTEGER) AS rank,
  feature, display_name, shap_value, direction, description FROM top_factors""", doubles=["shap_value"])
def top_factors(spark, sf):
    """H6, K3, K4, K5: top-6 factors per applicant with direction and text."""
    packed = E.top_factors(book_shap(spark, sf), TOP_K)
    return packed.select("SK_ID_CURR", F.posexplode("top_risk_factors").alias("pos", "f")).select(
        "SK_ID_CURR", (F.col("pos") + 1).cast("int").alias("rank"), "f.feature", "f.display_name",
        "f.shap_value", "f.direction", "f.description")


@query("chart_factors", O.shap_ctes() + f"""SELECT SK_ID_CURR, CAST(rank AS INTEGER) AS rank, feature, shap_value FROM (
  SELECT SK_ID_CURR, feature, shap_value,
    row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY abs(shap_value) DESC, feature_pos) AS rank FROM shap)
WHERE rank <= {CHART_K}""", doubles=["shap_value"])
def chart_factors(spark, sf):
    """H7: the top-10 factors behind the explanation chart."""
    packed = E.top_factors(book_shap(spark, sf), CHART_K)
    return packed.select("SK_ID_CURR", F.posexplode("top_risk_factors").alias("pos", "f")).select(
        "SK_ID_CURR", (F.col("pos") + 1).cast("int").alias("rank"), "f.feature", "f.shap_value")


@query("pack_factors", O.shap_ctes(O.DISPLAY, O.TOP_FACTORS) + """SELECT SK_ID_CURR, CAST(count(*) AS INTEGER) AS n_factors,
  24 AS total_features_analyzed, string_agg(feature, ',' ORDER BY rank) AS factor_features
FROM top_factors GROUP BY SK_ID_CURR""")
def pack_factors(spark, sf):
    """K6: the packed factor array per applicant and the feature total."""
    packed = E.top_factors(book_shap(spark, sf), TOP_K)
    return packed.select("SK_ID_CURR", F.size("top_risk_factors").alias("n_factors"), "total_features_analyzed",
                         F.array_join(F.transform("top_risk_factors", lambda f: f["feature"]), ",").alias("factor_features"))


@query("factor_display_names", O.shap_ctes(O.DISPLAY, O.TOP_FACTORS) + """SELECT s.feature,
  coalesce(d.display_name, s.feature) AS display_name, avg(abs(s.shap_value)) AS mean_abs_shap,
  count_if(t.SK_ID_CURR IS NOT NULL) AS n_in_top
FROM shap s LEFT JOIN display_names d ON s.feature = d.feature
LEFT JOIN top_factors t ON t.SK_ID_CURR = s.SK_ID_CURR AND t.feature = s.feature
GROUP BY s.feature, d.display_name""", doubles=["mean_abs_shap"])
def factor_display_names(spark, sf):
    """E5, K4: display name of every feature (raw name when none), its mean
    |SHAP| and how often it is among an applicant's top factors."""
    shap = book_shap(spark, sf)
    long = E.shap_long(shap)
    top = E.top_factors(shap, TOP_K).select("SK_ID_CURR", F.explode("top_risk_factors.feature").alias("feature"))
    top = top.withColumn("in_top", F.lit(True))
    names = F.create_map(*[x for f, n in S.DISPLAY_NAMES.items() for x in (F.lit(f), F.lit(n))])
    j = long.join(top, ["SK_ID_CURR", "feature"], "left")
    return j.groupBy("feature").agg(
        F.coalesce(names[F.col("feature")], F.col("feature")).alias("display_name"),
        F.avg(F.abs("shap_value")).alias("mean_abs_shap"),
        F.count_if(F.col("in_top").isNotNull()).alias("n_in_top"))

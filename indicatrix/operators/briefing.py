"""Briefing data: classes and numbers per indicator, relations between indicators, and the document that holds them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from indicatrix.functions.bands import band
from indicatrix.functions.numeric import rounded

Bands = tuple[list[tuple[str, float, str]], str]

# Headline class of each primary indicator, on its latest growth (output) or latest level (the others).
HEADLINES: dict[str, tuple[str, Bands]] = {
    "real_gdp": ("latest_growth", ([(">", 3, "robust expansion"), (">", 1, "moderate growth"), (">", 0, "fading growth")], "contraction")),
    "unemployment_rate": ("latest_value", ([("<", 7, "strong labour market"), ("<", 10, "moderate"), ("<", 14, "elevated")], "critical")),
    "ecb_main_refinancing_rate": ("latest_value", ([("<", 1, "ultra-low"), ("<", 3, "normalising"), (">", 5, "elevated")], "tightening")),
    "hicp": ("latest_value", ([(">", 5, "surge"), (">", 3, "above target"), (">", 1.5, "near target"), (">", 0, "low")], "deflation risk")),
}
# Risk class on the latest level.
LEVEL_RISKS: dict[str, Bands] = {
    "unemployment_rate": ([(">", 12, "HIGH"), (">", 8, "ELEVATED")], "MODERATE"),
    "ecb_main_refinancing_rate": ([(">", 4, "HIGH"), (">", 2, "ELEVATED")], "MODERATE"),
    "hicp": ([(">", 5, "HIGH"), (">", 3, "ELEVATED"), ("<", 0.5, "ELEVATED")], "LOW-TO-MODERATE"),
    "debt_to_gdp_ratio": ([(">", 120, "HIGH"), (">", 90, "ELEVATED")], "MODERATE"),
}
MOMENTUM: Bands = ([(">", 1, "above trend"), ("<", -1, "below trend")], "near trend")
GROWTH_MODE = ("real_gdp", "total_credit")


def _by_indicator(choices: dict[str, Column], default: Column) -> Column:
    out = None
    for name, expression in choices.items():
        test = F.col("indicator") == name
        out = F.when(test, expression) if out is None else out.when(test, expression)
    return out.otherwise(default)


def headline(summary: DataFrame) -> DataFrame:
    """Headline class, risk class and momentum of each series of ``operators.summaries.summarise``."""
    growth, recent, trend = F.col("latest_growth"), F.col("recent_avg_growth"), F.col("trend")
    output_risk = F.when(F.coalesce(growth, F.lit(0.0)) < 0, "HIGH").when(recent < 1, "ELEVATED").when(recent > 3, "LOW").otherwise("MODERATE")
    credit_risk = (F.when((trend == "decreasing") & (recent.isNull() | (recent < 0)), "HIGH").when(trend == "decreasing", "ELEVATED").otherwise("MODERATE"))
    risks = {c: band("latest_value", b) for c, b in LEVEL_RISKS.items()} | {"real_gdp": output_risk, "total_credit": credit_risk}
    heads = {c: band(source, b) for c, (source, b) in HEADLINES.items()}
    return summary.withColumns({
        "headline": _by_indicator(heads, F.concat(F.lit("trend "), trend)), "risk_level": _by_indicator(risks, F.lit("UNASSESSED")),
        "direction": F.when(F.col("overall_change_pct") > 0, "expansion").otherwise("contraction"),
        "momentum": band("momentum_gap", MOMENTUM, null_label="insufficient data")})


def crisis_impact(summary: DataFrame) -> DataFrame:
    """Class of each labelled window: growth against the long run, or level for rates and ratios."""
    rows = summary.select("entity", "indicator", "longrun_avg_growth", "mean", F.inline("crisis_impacts"))
    growth, longrun = F.col("mean_growth"), F.col("longrun_avg_growth")
    by_growth = (F.when(growth < 0, "significant economic stress").when(growth > longrun + 0.5, "resilience").when(growth < longrun - 0.5, "significant stress")
                 .otherwise("in line"))
    by_level = F.when(F.col("mean_value") > F.col("mean") + 1, "significant stress").when(F.col("mean_value") < F.col("mean") - 1, "resilience").otherwise("in line")
    impact = F.when(F.col("indicator").isin(*GROWTH_MODE), by_growth).otherwise(by_level)
    return rows.where(F.col("mean_value").isNotNull()).select("entity", "indicator", "label", rounded("mean_value", 4).alias("mean_value"),
                                                              rounded(growth, 4).alias("mean_growth"), impact.alias("impact"))


def secondary_findings(report: DataFrame, keywords: Sequence[tuple[str, str]], limit: int | None = None) -> DataFrame:
    """Latest-value rows of indicators whose name holds a keyword, first keyword first, numbered per entity; ``limit`` is a report's own cap."""
    rank = None
    label = None
    for i, (word, name) in enumerate(keywords):
        test = F.col("indicator").contains(word)
        rank = F.when(test, i) if rank is None else rank.when(test, i)
        label = F.when(test, name) if label is None else label.when(test, name)
    kept = report.withColumn("_r", rank).withColumn("topic", label).where("_r is not null")
    order = Window.partitionBy("entity").orderBy("_r", "indicator")
    numbered = kept.withColumn("position", F.row_number().over(order)).drop("_r")
    return numbered if limit is None else numbered.where(F.col("position") <= limit)


def relations(summary: DataFrame) -> DataFrame:
    """Four relations between the indicators of an entity, from trend, momentum and level."""
    def of(indicator: str, c: str) -> Column:
        return F.max(F.when(F.col("indicator") == indicator, F.col(c)))
    one = summary.groupBy("entity").agg(
        of("real_gdp", "recent_avg_growth").alias("g"), of("unemployment_rate", "trend").alias("ut"), of("ecb_main_refinancing_rate", "trend").alias("rt"),
        of("total_credit", "trend").alias("ct"), of("hicp", "latest_value").alias("h"), of("ecb_main_refinancing_rate", "latest_value").alias("r"),
        of("debt_to_gdp_ratio", "trend").alias("dt"))
    g, h, r = F.col("g"), F.col("h"), F.col("r")
    okun = F.when((g > 2) & (F.col("ut") == "decreasing"), "strong").when((g > 0) & (F.col("ut") != "decreasing"), "weak").otherwise("consistent_weakness")
    falling = F.col("rt") == "decreasing"
    policy = (F.when(falling & (F.col("ct") == "increasing"), "strong").when(falling, "impaired")
              .when((F.col("rt") == "increasing") & (F.col("ct") == "decreasing"), "strong").otherwise("atypical"))
    stance = (F.when((h > 3) & (r > h), "restrictive").when((h > 3) & (r < h), "insufficiently restrictive").when((h < 1) & (r < 1), "disinflationary").otherwise("neutral"))
    debt = F.when((g > 2) & (F.col("dt") == "decreasing"), "favourable").when((g < 1) & (F.col("dt") == "increasing"), "adverse").otherwise("transitional")
    rows = F.array(*[F.struct(F.lit(n).alias("relation"), e.alias("relationship")) for n, e in (
        ("growth_unemployment", okun), ("rates_credit", policy), ("inflation_policy", stance), ("debt_growth", debt))])
    return one.select("entity", rows.alias("_r")).select("entity", F.inline("_r"))


def overall_tone(headlines: DataFrame) -> DataFrame:
    """Counts of risk classes and the overall tone of each entity."""
    counts = headlines.groupBy("entity").agg(F.count_if(F.col("risk_level") == "HIGH").alias("n_high"), F.count_if(F.col("risk_level") == "ELEVATED").alias("n_elevated"))
    high, elevated = F.col("n_high"), F.col("n_elevated")
    tone = (F.when(high >= 2, "CONCERNING").when((high >= 1) | (elevated >= 2), "CAUTIOUS").when(elevated >= 1, "BALANCED WITH CAVEATS").otherwise("CAUTIOUSLY OPTIMISTIC"))
    return counts.withColumn("tone", tone)


def document(headlines: DataFrame, related: DataFrame, tone: DataFrame) -> DataFrame:
    """One nested row per entity: the indicators and relations are fixed lists, so the arrays stay short."""
    insights = headlines.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("indicator", "headline", "risk_level", "trend", "momentum", "latest_value"))).alias("pillar_insights"))
    links = related.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("relation", "relationship"))).alias("cross_pillar_insights"))
    return insights.join(links, "entity").join(tone, "entity")

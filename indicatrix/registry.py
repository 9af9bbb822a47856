"""Pillars, indicators, bounds, band sets, periods, alert rules and model parameters.

Everything here is plain configuration. It holds a few dozen rows at most and never grows with the data, which is
why operators may broadcast tables built from it.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Indicator:
    """One measured column of a pillar."""

    name: str
    clip_low: float | None = None
    clip_high: float | None = None
    plausible_low: float | None = None
    plausible_high: float | None = None
    agg_rule: str = "avg"  # how months roll up to longer periods: sum, avg or last
    lower_is_better: bool = False


@dataclass(frozen=True)
class Pillar:
    """Schema and cleaning rules of one fact table."""

    key: str
    table: str
    grain: str  # "quarter" or "month"
    primary: str
    decimals: int
    indicators: tuple[Indicator, ...]
    rename: dict[str, str] = field(default_factory=dict)
    required_raw: tuple[str, ...] = ()
    source_name: str = ""
    extra_columns: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [i.name for i in self.indicators]


# Raw column names, schema names, clip bounds, plausible ranges.
PILLARS: dict[str, Pillar] = {
    "gdp": Pillar(
        key="gdp", table="fact_gdp", grain="quarter", primary="real_gdp", decimals=2, source_name="INE",
        indicators=(
            Indicator("nominal_gdp", 0, None, 20000, 80000, "sum"),
            Indicator("real_gdp", 0, None, None, None, "sum"),
            Indicator("gdp_growth_yoy", None, None, -16, 18),
            Indicator("gdp_growth_qoq", None, None, -16, 18),
            Indicator("gdp_per_capita", 0, None, 10000, 35000),
        ),
        rename={
            "nominal_gdp_eur_millions": "nominal_gdp",
            "real_gdp_eur_millions": "real_gdp",
            "nominal_gdp_growth_rate_yoy": "gdp_growth_yoy",
            "nominal_gdp_growth_rate_qoq": "gdp_growth_qoq",
            "gdp_growth_rate_yoy": "gdp_growth_yoy",
            "gdp_growth_rate_qoq": "gdp_growth_qoq",
            "gdp_per_capita_eur": "gdp_per_capita",
        },
        required_raw=("date", "year", "quarter", "nominal_gdp_eur_millions", "real_gdp_eur_millions",
                      "nominal_gdp_growth_rate_yoy", "gdp_per_capita_eur"),
    ),
    "unemployment": Pillar(
        key="unemployment", table="fact_unemployment", grain="month", primary="unemployment_rate", decimals=1,
        source_name="Eurostat",
        indicators=(
            Indicator("unemployment_rate", 0, 100, 0, 20, lower_is_better=True),
            Indicator("youth_unemployment_rate", 0, 100, 0, 60, lower_is_better=True),
            Indicator("long_term_unemployment_rate", 0, 100, 0, 30, lower_is_better=True),
            Indicator("labour_force_participation_rate", 0, 100, 40, 100),
        ),
        required_raw=("date", "unemployment_rate", "youth_unemployment_rate", "long_term_unemployment_rate",
                      "labour_force_participation_rate"),
    ),
    "credit": Pillar(
        key="credit", table="fact_credit", grain="month", primary="total_credit", decimals=2,
        source_name="Banco de Portugal",
        indicators=(
            Indicator("total_credit", 0, None, 500000, 1000000),
            Indicator("credit_nfc", 0, None),
            Indicator("credit_households", 0, None),
            Indicator("npl_ratio", 0, 100, 0, 20, lower_is_better=True),
        ),
        rename={
            "total_credit_eur_millions": "total_credit",
            "nfc_credit_eur_millions": "credit_nfc",
            "household_credit_eur_millions": "credit_households",
        },
        required_raw=("date", "total_credit_eur_millions", "nfc_credit_eur_millions",
                      "household_credit_eur_millions", "npl_ratio"),
    ),
    "interest_rates": Pillar(
        key="interest_rates", table="fact_interest_rates", grain="month", primary="ecb_main_refinancing_rate",
        decimals=3, source_name="ECB",
        indicators=(
            Indicator("ecb_main_refinancing_rate", -2, 20, -1, 6, lower_is_better=True),
            Indicator("euribor_3m", -2, 20, -1, 6, lower_is_better=True),
            Indicator("euribor_6m", -2, 20, lower_is_better=True),
            Indicator("euribor_12m", -2, 20, lower_is_better=True),
            Indicator("portugal_10y_bond_yield", -2, 20, -1, 18, lower_is_better=True),
        ),
        required_raw=("date", "ecb_main_refinancing_rate", "euribor_3m", "euribor_6m", "euribor_12m",
                      "portugal_10y_bond_yield"),
    ),
    "inflation": Pillar(
        key="inflation", table="fact_inflation", grain="month", primary="hicp", decimals=2, source_name="Eurostat",
        indicators=(
            Indicator("hicp", -5, 30, -2, 12, lower_is_better=True),
            Indicator("cpi_estimated", -5, 30, -2, 12, lower_is_better=True),
            Indicator("core_inflation", -5, 30, -2, 10, lower_is_better=True),
        ),
        rename={
            "hicp_annual_rate": "hicp",
            "cpi_annual_rate": "cpi_estimated",
            "core_inflation_rate": "core_inflation",
        },
        required_raw=("date", "hicp_annual_rate", "cpi_annual_rate", "core_inflation_rate"),
        extra_columns=("cpi_is_estimated",),
    ),
    "public_debt": Pillar(
        key="public_debt", table="fact_public_debt", grain="quarter", primary="debt_to_gdp_ratio", decimals=2,
        source_name="Banco de Portugal",
        indicators=(
            Indicator("total_debt", 0, None),
            Indicator("debt_to_gdp_ratio", 0, 300, 50, 160, lower_is_better=True),
            Indicator("budget_deficit", -25, 10, -25, 10),
            Indicator("budget_deficit_annual", None, None, -15, 5),
            Indicator("external_debt_share_estimated", 0, 100, 20, 80, lower_is_better=True),
        ),
        rename={
            "total_debt_eur_millions": "total_debt",
            "budget_balance_pct_gdp": "budget_deficit",
            "external_debt_share": "external_debt_share_estimated",
        },
        required_raw=("date", "year", "quarter", "total_debt_eur_millions", "debt_to_gdp_ratio",
                      "budget_balance_pct_gdp"),
    ),
}

# Publication lag in months, by grain.
PROVISIONAL_LAG_MONTHS = {"quarter": 6, "month": 4}

# Data sources.
SOURCES = [
    ("INE", "https://www.ine.pt"),
    ("Banco de Portugal", "https://bpstat.bportugal.pt"),
    ("PORDATA", "https://www.pordata.pt"),
    ("Eurostat", "https://ec.europa.eu/eurostat"),
    ("ECB", "https://www.ecb.europa.eu/stats"),
]

# Labelled year ranges (label, first year, last year).
ECONOMIC_PERIODS = [
    ("1. Pre-crisis", 2010, 2011),
    ("2. Troika", 2012, 2014),
    ("3. Recovery", 2015, 2019),
    ("4. COVID", 2020, 2020),
    ("5. Post-COVID", 2021, 2025),
]
CRISIS_WINDOWS = [
    ("Sovereign Debt Crisis", 2011, 2014),
    ("COVID-19 Pandemic", 2020, 2021),
    ("Energy and Inflation Crisis", 2022, 2023),
]
PHILLIPS_PERIODS = [
    ("pre_crisis", 2010, 2011),
    ("troika", 2011, 2014),
    ("recovery", 2015, 2019),
    ("covid", 2020, 2021),
    ("post_covid", 2022, 2025),
]
BREAK_YEARS = [("troika_2012", 2012), ("covid_2020", 2020)]

# Band sets. Each is (rows, fallback label); a row is (comparison, bound, label) and the first match wins.
BANDS: dict[str, tuple[list[tuple[str, float, str]], str | None]] = {
    "growth_class": ([(">", 3, "Strong expansion"), (">", 0, "Moderate growth"), (">", -1, "Stagnation")],
                     "Contraction"),
    "npl_class": ([("<", 3, "Healthy"), ("<", 7, "Warning")], "Critical"),
    "rate_environment": ([("<=", 0, "Zero / Negative"), ("<=", 1, "Low"), ("<=", 2.5, "Medium"),
                          ("<=", 4, "High")], "Very high"),
    "spread_stress": ([(">", 5, "Extreme stress"), (">", 3, "High stress"), (">", 1.5, "Elevated")], "Normal"),
    "policy_direction": ([(">", 0, "Tightening"), ("<", 0, "Easing")], "Unchanged"),
    "inflation_regime": ([("<", 0, "Deflation"), ("<", 1, "Low inflation"), ("<", 2.5, "Target range"),
                          ("<", 5, "High inflation")], "Very high inflation"),
    "energy_food_impact": ([(">", 1, "Energy/food driving inflation up"),
                            ("<", -1, "Energy/food pulling inflation down")], "Aligned"),
    "monetary_stance": ([("<", -1, "Very accommodative"), ("<", 0, "Accommodative"), ("<", 1, "Neutral")],
                        "Restrictive"),
    "momentum": ([(">", 0.3, "Rapid acceleration"), (">", 0, "Mild acceleration"), (">", -0.3, "Mild deceleration")],
                 "Rapid deceleration"),
    "debt_light": ([("<", 60, "Green (< 60%)"), ("<", 90, "Yellow (60-90%)"), ("<", 120, "Orange (90-120%)")],
                   "Red (>= 120%)"),
    "trend_direction": ([("<", 0, "Improving"), (">", 0, "Deteriorating")], "Stable"),
    "fiscal_status": ([(">=", 0, "Surplus"), (">=", -3, "Moderate deficit")], "Excessive deficit"),
    "stress_class": ([(">=", 3, "Severe stress"), (">=", 2, "Moderate stress"), (">=", 1, "Mild stress")],
                     "No stress"),
}

# Stress thresholds of the crisis timeline (indicator, comparison, bound).
STRESS_RULES = [
    ("unemployment_rate", ">", 12.0),
    ("hicp", "outside", (0.0, 4.0)),
    ("npl_ratio", ">", 7.0),
    ("portugal_10y_bond_yield", ">", 6.0),
]

# Alert rules (indicator, description, severity, side, threshold).
ALERT_RULES = [
    ("gdp_growth_yoy", "GDP YoY Growth Rate (%)", "warning", "below", -1.0),
    ("gdp_growth_yoy", "GDP YoY Growth Rate (%)", "critical", "below", -3.0),
    ("unemployment_rate", "Unemployment Rate (%)", "warning", "above", 8.0),
    ("unemployment_rate", "Unemployment Rate (%)", "critical", "above", 12.0),
    ("hicp", "HICP Inflation YoY (%)", "warning", "above", 4.0),
    ("hicp", "HICP Inflation YoY (%)", "warning", "below", -0.5),
    ("hicp", "HICP Inflation YoY (%)", "critical", "above", 8.0),
    ("hicp", "HICP Inflation YoY (%)", "critical", "below", -1.0),
    ("debt_to_gdp_ratio", "Debt-to-GDP Ratio (%)", "warning", "above", 100.0),
    ("debt_to_gdp_ratio", "Debt-to-GDP Ratio (%)", "critical", "above", 130.0),
    ("npl_ratio", "Non-Performing Loan Ratio (%)", "warning", "above", 5.0),
    ("npl_ratio", "Non-Performing Loan Ratio (%)", "critical", "above", 10.0),
    ("portugal_10y_bond_yield", "Portugal 10Y Bond Yield (%)", "warning", "above", 4.0),
    ("portugal_10y_bond_yield", "Portugal 10Y Bond Yield (%)", "critical", "above", 7.0),
]

# Scenario priors and rules of thumb.
SCENARIO_PRIORS = {
    "okun": -0.4,
    "fiscal_multiplier": 0.7,
    "npl_gdp_elasticity": -2.5,
    "credit_rate_semi_elasticity": -3.0,
    "tax_revenue_gdp_elasticity": 1.1,
    "tax_share_of_gdp": 0.42,
    "average_mortgage": 120000.0,
    "median_monthly_wage": 1100.0,
    "spread_pass_through": 0.4,
    "nominal_growth": 0.02,
    "debt_target": 60.0,
}

# Peer-benchmark indicators and whether a lower value ranks better.
BENCHMARK_INDICATORS = [
    ("gdp_growth", "GDP Growth (% YoY)", False),
    ("unemployment", "Unemployment Rate (%)", True),
    ("inflation", "Inflation HICP (%)", True),
    ("debt_to_gdp", "Debt-to-GDP (%)", True),
    ("interest_rate_10y", "10Y Bond Yield (%)", True),
]


def agg_rules() -> dict[str, str]:
    """Roll-up rule of every registered indicator."""
    return {i.name: i.agg_rule for p in PILLARS.values() for i in p.indicators}

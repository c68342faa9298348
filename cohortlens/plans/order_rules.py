"""Stand-in decision rules for the order profile (same shapes as the employee rules:
flag, flag with population rate, ordinal threshold, group-median comparison,
two-condition rules, and one rule that maps to no action)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.operators.decisions import RiskRule, pct0

# Fixed values of the stand-in scorer: intercept, weights on standardised inputs, flag weight.
SCORE_INTERCEPT = -1.4
SCORE_COEF = {"o_totalprice": 0.10, "c_acctbal": -0.05, "n_lines": 0.20, "qty_sum": 0.15,
              "disc_avg": -0.10, "tax_avg": 0.05, "returned_lines": 0.25}
SCORE_FLAG_OPEN = 0.3


def rate_conditions() -> dict[str, Column]:
    c = F.col
    return {"open": c("o_orderstatus") == "O", "not_open": c("o_orderstatus") != "O",
            "building": c("c_mktsegment") == "BUILDING", "few_lines": c("n_lines") <= 2,
            "low_disc": c("disc_avg") <= 0.02, "low_tax": c("tax_avg") <= 0.02,
            "zero_ret": c("returned_lines") == 0, "asia": c("r_name") == "ASIA",
            "low_qty": c("qty_sum") <= 50}


def _t(*parts):
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def rules() -> list[RiskRule]:
    c = F.col
    return [
        RiskRule("OpenStatus", "high", lambda s: c("o_orderstatus") == "O", lambda s: F.lit("Open order"),
                 lambda s: _t(pct0(s["open"]), "% urgent vs ", pct0(s["not_open"]), "% otherwise")),
        RiskRule("Segment", "medium", lambda s: c("c_mktsegment") == "BUILDING",
                 lambda s: F.lit("Building segment"),
                 lambda s: _t(pct0(s["building"]), "% urgent in this segment")),
        RiskRule("FewLines", "high", lambda s: c("n_lines") <= 2,
                 lambda s: _t("Few lines (", c("n_lines").cast("string"), "/7)"),
                 lambda s: _t(pct0(s["few_lines"]), "% urgent when lines <= 2")),
        RiskRule("LowDiscount", "high", lambda s: c("disc_avg") <= 0.02, lambda s: F.lit("Low discount"),
                 lambda s: _t(pct0(s["low_disc"]), "% urgent when discount <= 2%")),
        RiskRule("LowTax", "high", lambda s: c("tax_avg") <= 0.02, lambda s: F.lit("Low tax"),
                 lambda s: _t(pct0(s["low_tax"]), "% urgent when tax <= 2%")),
        RiskRule("LowPrice", "high", lambda s: c("o_totalprice") < c("median_o_totalprice") * 0.8,
                 lambda s: _t("Below-median price for region ", c("r_name")),
                 lambda s: _t("$", F.format_number(F.round(c("o_totalprice")), 0), " vs median $",
                              F.format_number(F.round(c("median_o_totalprice")), 0))),
        RiskRule("ManyReturns", "medium", lambda s: (c("returned_lines") >= 2) & (c("n_lines") >= 5),
                 lambda s: _t(c("returned_lines").cast("string"), " returned lines"),
                 lambda s: F.lit("Repeated returns on large orders")),
        RiskRule("SmallAccount", "medium", lambda s: (c("c_acctbal") <= 1000) & (c("n_lines") <= 2),
                 lambda s: F.lit("Small account, small order"),
                 lambda s: F.lit("Low-balance customers with small orders")),
        RiskRule("NoReturns", "medium", lambda s: c("returned_lines") == 0, lambda s: F.lit("No returned lines"),
                 lambda s: _t(pct0(s["zero_ret"]), "% urgent with no returns")),
        RiskRule("Asia", "medium", lambda s: c("r_name") == "ASIA", lambda s: F.lit("Ships to ASIA"),
                 lambda s: _t(pct0(s["asia"]), "% urgent for ASIA")),
        RiskRule("LowQuantity", "medium", lambda s: c("qty_sum") <= 50,
                 lambda s: _t("Low quantity (", c("qty_sum").cast("long").cast("string"), ")"),
                 lambda s: _t(pct0(s["low_qty"]), "% urgent when quantity <= 50")),
    ]


ACTIONS = [
    (["OpenStatus"], "clock", "Review the open order backlog."),
    (["FewLines", "LowDiscount"], "tag", "Offer bundle pricing."),
    (["LowTax"], "file", "Check the tax classification."),
    (["LowPrice"], "dollar-sign", "Review pricing against the regional median."),
    (["ManyReturns"], "undo", "Investigate returns on large orders."),
    (["SmallAccount"], "user", "Assign an account manager."),
    (["NoReturns"], "check", "Keep standard handling."),
    (["Asia"], "ship", "Review regional shipping capacity."),
    (["LowQuantity"], "boxes", "Suggest minimum order quantities."),
]
FALLBACK = ("check-circle", "No specific risk factors detected.")

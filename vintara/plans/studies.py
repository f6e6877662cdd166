"""Studies: a control that has to come out right first, then the population, then a registered trial and a card."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vintara.operators import backtest, corpus, features, panel
from vintara.plans.ledgers import EvidenceCard, TrialLedger, verdict


def restatement_study(facts: DataFrame, control: DataFrame, expected: tuple[int, int], ledger: TrialLedger, code_version: str, folder: str | Path) -> EvidenceCard:
    """Refuses to measure the population if the control slice does not have the expected (facts, restated facts)."""
    seen = corpus.tally(control).first()
    if (seen["facts"], seen["restated_facts"]) != expected:
        raise AssertionError(f"control gives {seen['facts']} facts, {seen['restated_facts']} restated; expected {expected}")
    found = corpus.tally(facts).first().asDict()
    rows = corpus.restated_rows(facts).first().asDict()
    quantiles = {f"change_p{round(r['quantile'] * 100)}": r["change"] for r in corpus.change_quantiles(facts).collect()}
    vintage = facts.agg(F.max("filed_at")).first()[0]
    ledger.register("restatement", {"expected": list(expected), "code": code_version})
    card = EvidenceCard("restatement", "How much of the corpus was restated", str(vintage), code_version, ledger.configurations("restatement"), {**found, **rows, **quantiles, "verdict": verdict(found["restated_share"])})
    card.write(folder)
    return card


def vintage_backtest(facts: DataFrame, entities: DataFrame, identifiers: DataFrame, prices: DataFrame, formations: list[str], spec: features.AccrualsSpec, plan: backtest.Plan) -> dict[str, dict[str, DataFrame]]:
    """For each vintage arm the positions, periods and exclusions of the same strategy on the same names."""
    names = panel.universe(entities, identifiers).where("drop_reason is null").select("cik", "symbol")
    rows = features.accruals(facts, spec).where("taxonomy = 'us-gaap'").drop("taxonomy")
    picked = panel.common_universe(panel.pick_freshest(rows, formations), len(features.ARMS)).join(names, "cik")
    out = {}
    for arm in features.ARMS:
        quoted = backtest.quotes(picked.where(F.col("arm") == arm).drop("arm", "period_end"), prices, plan)
        every = backtest.positions(quoted, plan, every=True)
        out[arm] = {"positions": every.where("weight is not null"), "periods": backtest.periods(every), "exclusions": backtest.exclusions(quoted)}
    return out

"""SQL of the views that the catalogue's queries start from, for engines that read the same tables."""

from __future__ import annotations

from vintara.sources.projection import SQL as PROJECTED

GRAIN = "cik, taxonomy, concept, unit, period_start, period_end"
_ORDER = "knowledge_date, accn, value"
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {name: ((), body) for name, body in PROJECTED.items()}
VIEWS["filing_filers"] = (("filings",), PROJECTED["filing_filers"])
VIEWS |= {
    "filings_pit": (("filings",), """
      SELECT *, greatest(filed_at, coalesce(disseminated_at, filed_at)) AS knowledge_date,
             coalesce(disseminated_at > filed_at, false) AS was_disseminated_late,
             CAST(coalesce(date_diff('day', filed_at, disseminated_at), 0) AS BIGINT) AS dissemination_lag_days
      FROM filings"""),
    "company_filings": (("filings_pit", "filing_filers"), """
      SELECT f.* EXCLUDE (cik), l.cik, l.is_primary FROM filings_pit f JOIN filing_filers l ON f.accn = l.accn"""),
    "facts_pit": (("facts",), f"""
      SELECT f.*, row_number() OVER o AS report_seq, first_value(value) OVER o IS DISTINCT FROM value AS differs_from_first_report,
             count(DISTINCT value) OVER (PARTITION BY {GRAIN}) AS period_distinct_values
      FROM facts f WINDOW o AS (PARTITION BY {GRAIN} ORDER BY {_ORDER})"""),
    "fact_revisions": (("facts_pit",), f"""
      SELECT *, lag(value) OVER o AS prior_value, lag(knowledge_date) OVER o AS prior_knowledge_date,
             lag(filed_at) OVER o AS prior_filed_at, lag(accn) OVER o AS prior_accn
      FROM facts_pit WINDOW o AS (PARTITION BY {GRAIN} ORDER BY {_ORDER})"""),
    "measured_revisions": (("fact_revisions",), """
      SELECT *, CASE WHEN prior_value <> 0 THEN (CAST(value AS DOUBLE) - CAST(prior_value AS DOUBLE)) / CAST(prior_value AS DOUBLE) END AS relative_change,
             CAST(value AS DOUBLE) - CAST(prior_value AS DOUBLE) AS absolute_change,
             CAST(date_diff('day', prior_knowledge_date, knowledge_date) AS BIGINT) AS days_between
      FROM fact_revisions WHERE value <> prior_value"""),
    "per_fact": (("facts",), f"""
      SELECT *, n_values >= 2 AS restated,
             CASE WHEN greatest(abs(first_value), abs(latest_value)) = 0 THEN NULL
                  ELSE abs(latest_value - first_value) / greatest(abs(first_value), abs(latest_value)) END AS relative_change,
             sign(first_value) <> sign(latest_value) AND first_value <> 0 AND latest_value <> 0 AS is_sign_flip
      FROM (SELECT {GRAIN}, count(*) AS n_reports, count(DISTINCT value) AS n_values,
                   CAST(arg_min(value, row(knowledge_date, accn, value)) AS DOUBLE) AS first_value,
                   CAST(arg_max(value, row(knowledge_date, accn, value)) AS DOUBLE) AS latest_value
            FROM facts GROUP BY ALL)"""),
    "last_filed": (("facts",), "SELECT cik, max(filed_at) AS last_filed_at FROM facts GROUP BY cik"),
    "lags": (("company_filings",), """
      SELECT *, CAST(date_diff('day', period_of_report, knowledge_date) AS DOUBLE) AS lag_days,
             date_diff('day', DATE '1970-01-01', knowledge_date) AS d FROM company_filings"""),
    "habits": (("lags",), """
      SELECT *, count(lag_days) OVER w AS n_priors, avg(lag_days) OVER w AS mean_lag, stddev_samp(lag_days) OVER w AS sd_lag
      FROM lags WINDOW w AS (PARTITION BY cik, form ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
    "flagged": (("habits",), """
      SELECT *, CASE WHEN non_reliance THEN 'CONFESSED' WHEN n_flags > 1 OR score >= 3 THEN 'STRONG' WHEN score >= 2 THEN 'MODERATE'
                     WHEN score > 0 THEN 'WEAK' ELSE 'NONE' END AS confidence
      FROM (SELECT *, n_base + CAST(departure AS INTEGER) AS n_flags,
                   5.0::DOUBLE * CAST(non_reliance AS INTEGER) + 3.0 * CAST(auditor AS INTEGER) + 2.0 * CAST(late AS INTEGER) + 1.0 * CAST(amended AS INTEGER)
                     + 1.5 * CAST(unusual_lag AS INTEGER) + 1.0 * CAST(departure AS INTEGER) AS score
            FROM (SELECT *, has_departure AND n_base > 0 AS departure
                  FROM (SELECT *, CAST(non_reliance AS INTEGER) + CAST(auditor AS INTEGER) + CAST(late AS INTEGER) + CAST(amended AS INTEGER) + CAST(unusual_lag AS INTEGER) AS n_base
                        FROM (SELECT *, len(list_filter(items, lambda x: starts_with(x, '4.02'))) > 0 AS non_reliance,
                                     len(list_filter(items, lambda x: starts_with(x, '4.01'))) > 0 AS auditor,
                                     len(list_filter(items, lambda x: starts_with(x, '5.02'))) > 0 AS has_departure,
                                     form IN ('NT 10-K', 'NT 10-Q', 'NT 20-F') AS late, form IN ('10-K/A', '10-Q/A', '20-F/A') AS amended,
                                     coalesce(form IN ('10-K', '10-Q', '20-F') AND n_priors >= 4 AND
                                       CASE WHEN sd_lag > 0 THEN lag_days > mean_lag + 2 * sd_lag ELSE lag_days > mean_lag + 5 END, false) AS unusual_lag
                              FROM habits))))"""),
    "arms": (("facts",), f"""
      SELECT arm, {GRAIN}, CASE WHEN arm = 'first_reported' THEN fv ELSE lv END AS value,
             CASE WHEN arm = 'naive_vendor' THEN period_end ELSE fk END AS knowledge_date, lv <> fv AND arm <> 'first_reported' AS is_restated
      FROM (SELECT {GRAIN}, arg_min(value, row(knowledge_date, accn, value)) AS fv, arg_max(value, row(knowledge_date, accn, value)) AS lv, min(knowledge_date) AS fk
            FROM facts GROUP BY ALL) CROSS JOIN (VALUES ('first_reported'), ('restated_values'), ('naive_vendor')) AS a(arm)"""),
    "features": (("arms",), """
      SELECT *, CASE WHEN drop_reason IS NULL THEN (CAST(iv AS DOUBLE) - CAST(cv AS DOUBLE)) / ((CAST(e1 AS DOUBLE) + CAST(e0 AS DOUBLE)) / 2) END AS value,
             CASE WHEN drop_reason IS NULL THEN greatest(ik, ck, k1, k0) END AS knowledge_date,
             CASE WHEN drop_reason IS NULL THEN ir OR cr OR r1 OR r0 END AS uses_restated_input
      FROM (SELECT y.*, a1.value AS e1, a1.knowledge_date AS k1, a1.is_restated AS r1, a0.value AS e0, a0.knowledge_date AS k0, a0.is_restated AS r0,
                   CASE WHEN opening IS NULL THEN 'NO_PRIOR_YEAR' WHEN date_diff('day', opening, y.period_end) NOT BETWEEN 20 AND 40 THEN 'GAP'
                        WHEN cv IS NULL OR a1.value IS NULL OR a0.value IS NULL THEN 'MISSING_INPUT'
                        WHEN (CAST(a1.value AS DOUBLE) + CAST(a0.value AS DOUBLE)) / 2 <= 0 THEN 'NON_POSITIVE_ASSETS' END AS drop_reason
            FROM (SELECT *, lag(period_end) OVER (PARTITION BY arm, cik, taxonomy ORDER BY period_end, period_start) AS opening
                  FROM (SELECT arm, cik, taxonomy, period_start, period_end,
                               max(CASE WHEN concept = 'A' THEN value END) AS iv, max(CASE WHEN concept = 'A' THEN knowledge_date END) AS ik, bool_or(concept = 'A' AND is_restated) AS ir,
                               max(CASE WHEN concept = 'N' THEN value END) AS cv, max(CASE WHEN concept = 'N' THEN knowledge_date END) AS ck, bool_or(concept = 'N' AND is_restated) AS cr
                        FROM arms WHERE unit = 'USD' AND date_diff('day', period_start, period_end) BETWEEN 60 AND 120 GROUP BY ALL)
                  WHERE iv IS NOT NULL) y
            LEFT JOIN (SELECT * FROM arms WHERE concept = 'R' AND unit = 'USD' AND period_start IS NULL) a1
              ON y.arm = a1.arm AND y.cik = a1.cik AND y.taxonomy = a1.taxonomy AND y.period_end = a1.period_end
            LEFT JOIN (SELECT * FROM arms WHERE concept = 'R' AND unit = 'USD' AND period_start IS NULL) a0
              ON y.arm = a0.arm AND y.cik = a0.cik AND y.taxonomy = a0.taxonomy AND y.opening = a0.period_end)"""),
    "formations": ((), "SELECT CAST(d AS DATE) AS formation_date FROM (VALUES ('1996-12-31'), ('1998-06-30'), ('2000-06-30'), ('2001-12-31')) AS t(d)"),
    "full_years": (("features",), """
      SELECT * FROM (SELECT *, count(value) OVER (PARTITION BY cik, taxonomy, period_start, period_end) = 3 AS in_all_arms FROM features)"""),
    "company_years": (("full_years",), """
      SELECT *, count(*) OVER (PARTITION BY cik, taxonomy) AS n, count(*) FILTER (WHERE in_all_arms) OVER (PARTITION BY cik, taxonomy) AS n_full
      FROM (SELECT cik, taxonomy, period_start, period_end, bool_and(in_all_arms) AS in_all_arms, min(drop_reason) AS reason FROM full_years GROUP BY 1, 2, 3, 4)"""),
    "picked": (("full_years", "formations"), """
      SELECT w.arm, w.cik, w.taxonomy, w.formation_date, max(row(knowledge_date, period_end, value)) AS p
      FROM (SELECT DISTINCT arm, cik, taxonomy, formation_date FROM full_years, formations WHERE in_all_arms) w
      LEFT JOIN full_years f ON f.in_all_arms AND w.arm = f.arm AND w.cik = f.cik AND w.taxonomy = f.taxonomy AND f.knowledge_date <= w.formation_date
      GROUP BY ALL"""),
    "signals": (("prices",), """
      SELECT symbol, CAST(d AS DATE) AS formation_date, CAST(sum((event_id * 7919) % 101) % 1000 AS DOUBLE) / 1000 AS value, CAST(d AS DATE) - 1 AS knowledge_date
      FROM (SELECT 'S' || CAST(user_id % 20 AS VARCHAR) AS symbol, event_id, CAST(ts AS DATE) AS day FROM events), (VALUES ('2024-01-08'), ('2024-01-14'), ('2024-01-20'), ('2024-01-26')) AS t(d)
      WHERE day < CAST(d AS DATE) GROUP BY 1, 2"""),
    "pairs": (("prices",), """
      SELECT *, coalesce(adj_close, close) AS mark, ph IS NOT NULL AS is_pair,
             CASE WHEN least(low, pl, high, ph) > 0 THEN 2.0 * (exp(alpha) - 1.0) / (1.0 + exp(alpha)) END AS pair_spread,
             CASE WHEN pm > 0 AND coalesce(adj_close, close) > 0 THEN ln(coalesce(adj_close, close) / pm) END AS log_return
      FROM (SELECT *, CASE WHEN least(low, pl, high, ph) > 0 THEN (sqrt(2.0 * beta) - sqrt(beta)) / (3.0 - 2.0 * sqrt(2.0)) - sqrt(gamma / (3.0 - 2.0 * sqrt(2.0))) END AS alpha
            FROM (SELECT *, CASE WHEN least(low, pl, high, ph) > 0 THEN pow(ln(ph / pl), 2) + pow(ln(high / low), 2) END AS beta,
                         CASE WHEN least(low, pl, high, ph) > 0 THEN pow(ln(greatest(high, ph) / least(low, pl)), 2) END AS gamma
                  FROM (SELECT *, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(coalesce(adj_close, close)) OVER w AS pm FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY bar_date))))"""),
    "quotes": (("signals", "prices", "pairs"), """
      SELECT *, CASE WHEN n_forward = 0 THEN 'NO_PRICE_HISTORY' WHEN n_bars < 6 THEN 'INSUFFICIENT_HISTORY' WHEN entry IS NULL THEN 'NO_ENTRY_BAR'
                     WHEN exit IS NULL THEN 'NO_EXIT_BAR' WHEN entry.price <= 0 OR exit.price <= 0 THEN 'NON_POSITIVE_PRICE' END AS exclusion
      FROM (SELECT s.symbol, s.formation_date, s.exit_formation, s.value,
               count(*) FILTER (WHERE bar_date <= formation_date) AS n_bars,
               count(*) FILTER (WHERE bar_date BETWEEN formation_date AND exit_formation) AS n_forward,
               arg_min({'price': mark, 'day': bar_date}, bar_date) FILTER (WHERE bar_date >= formation_date + 1 AND bar_date <= exit_formation) AS entry,
               arg_min({'price': mark, 'day': bar_date}, bar_date) FILTER (WHERE bar_date >= exit_formation + 1) AS exit,
               coalesce(greatest(0.0, avg(pair_spread) FILTER (WHERE bar_date <= formation_date AND is_pair)), 0.0) AS spread,
               CASE WHEN count(log_return) FILTER (WHERE bar_date <= formation_date) >= 2 THEN stddev_samp(log_return) FILTER (WHERE bar_date <= formation_date) ELSE 0.0 END AS daily_volatility,
               coalesce(quantile_cont(mark * volume, 0.5) FILTER (WHERE bar_date <= formation_date AND volume > 0), 0.0) AS dollar_volume
            FROM (SELECT s.*, n.exit_formation FROM signals s
                  JOIN (SELECT formation_date, lead(formation_date) OVER (ORDER BY formation_date) AS exit_formation FROM (SELECT DISTINCT formation_date FROM signals)) n
                    ON s.formation_date = n.formation_date WHERE n.exit_formation IS NOT NULL) s
            LEFT JOIN pairs p ON s.symbol = p.symbol AND p.bar_date BETWEEN s.formation_date - 60 AND s.exit_formation + 30
            GROUP BY ALL)"""),
    "sides": (("quotes",), """
      SELECT *, CASE WHEN n_ranked < 8 THEN 0 WHEN rank > n_ranked - bucket THEN -1 WHEN rank <= bucket THEN 1 ELSE 0 END AS side
      FROM (SELECT *, CAST(floor(n_ranked / 4) AS BIGINT) AS bucket
            FROM (SELECT *, row_number() OVER (PARTITION BY formation_date ORDER BY value, symbol) AS rank, count(*) OVER (PARTITION BY formation_date) AS n_ranked
                  FROM quotes WHERE exclusion IS NULL))"""),
    "positions": (("sides",), """
      SELECT *, gross_return - side * cost AS net_return
      FROM (SELECT *, 2 * (spread / 2 + 0.1 * daily_volatility * sqrt(least(participation_rate, 1.0))) AS cost
            FROM (SELECT *, CAST(side AS DOUBLE) / bucket AS weight, exit.price / entry.price - 1 AS gross_return,
                         CASE WHEN dollar_volume > 0 THEN abs(CAST(side AS DOUBLE) / bucket) * 1e7 / dollar_volume ELSE 'inf'::DOUBLE END AS participation_rate
                  FROM sides WHERE side <> 0))"""),
    "periods": (("positions", "quotes"), """
      SELECT q.formation_date, coalesce(min(p.entry.day), q.formation_date) AS entry_date, coalesce(max(p.exit.day), max(q.exit_formation)) AS exit_date, count(p.symbol) AS n_positions,
             count(*) FILTER (WHERE q.exclusion IS NULL) AS n_ranked, count(*) FILTER (WHERE q.exclusion IS NOT NULL) AS n_excluded, count(*) FILTER (WHERE q.exclusion IS NOT NULL) / count(*)::DOUBLE AS exclusion_rate,
             coalesce(sum(weight * gross_return), 0.0) AS gross_return, coalesce(sum(weight * net_return), 0.0) AS net_return, coalesce(sum(abs(weight) * cost), 0.0) AS cost, coalesce(2 * sum(abs(weight)), 0.0) AS turnover
      FROM quotes q LEFT JOIN positions p ON q.symbol = p.symbol AND q.formation_date = p.formation_date GROUP BY 1"""),
    "returns": ((), """
      SELECT CAST(l_suppkey % 10 AS INTEGER) AS strategy, CAST(l_partkey % 40 AS BIGINT) AS obs,
             sum(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 2001 - 1000 AS BIGINT)) / 1000000.0::DOUBLE AS ret
      FROM lineitem GROUP BY 1, 2"""),
}

#: The same quotes over the bars of listed days only.
VIEWS["listed_prices"] = (("prices",), """
  SELECT * FROM prices
  WHERE CASE WHEN symbol IN ('S3', 'S8') THEN bar_date < DATE '2024-01-15' WHEN symbol IN ('S5', 'S11', 'S17') THEN bar_date >= DATE '2024-01-11' ELSE true END
    AND (symbol <> 'S2' OR bar_date NOT BETWEEN DATE '2024-01-09' AND DATE '2024-01-14')""")  # fmt: skip
VIEWS["listed_pairs"] = (("listed_prices",), VIEWS["pairs"][1].replace("FROM prices", "FROM listed_prices"))
VIEWS["listed_quotes"] = (("signals", "listed_pairs"), VIEWS["quotes"][1].replace("JOIN pairs", "JOIN listed_pairs"))


def sql(body: str, *views: str) -> str:
    """``body`` with the views it names, and those they name, as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for below in VIEWS[name][0]:
            add(below)
        if name not in order:
            order.append(name)

    for name in views:
        add(name)
    parts = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in order)
    return f"WITH {parts}\n{body}" if order else body

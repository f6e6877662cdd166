"""Two gates: results that hang on the cluster's shape are caught, and so are mistakes put into the code on purpose."""

import inspect
import sys
import textwrap
from dataclasses import dataclass

import duckdb
import pytest
from pyspark.errors import PySparkException

from tests.test_catalog import SF, TABLES, rows
from vintara.operators import asof, backtest, corpus, joins, panel, selection, statistics, store, views
from vintara.plans import catalog, determinism
from vintara.sources import landing

# Determinism

STABLE = ["asof_triple", "company_filings", "exclusions", "first_reported_of_one_period", "forensic_flags", "macro_windows", "payload_differences", "unit_class", "universe_digests"]


def test_queries_do_not_hang_on_the_cluster_and_the_control_is_caught(spark):
    assert determinism.unstable(spark, SF, {n: catalog.QUERIES[n] for n in STABLE}) == {}
    assert set(determinism.unstable(spark, SF, {"poisoned": determinism.poisoned})) == {"poisoned"}


def test_fingerprints_are_of_multisets(spark):
    make = lambda rows: spark.createDataFrame(rows, "a int, b double, c array<string>")
    base = [(1, 0.1 + 0.2, ["x"]), (2, None, []), (2, None, [])]
    one = determinism.fingerprint(make(base))
    assert one == determinism.fingerprint(make(base[::-1]).repartition(3)) == determinism.fingerprint(make([(1, 0.3, ["x"]), *base[1:]]).select("c", "b", "a"))
    for other in (base[:2], [*base, base[0]], [(1, 0.30001, ["x"]), *base[1:]], [(1, 0.3, ["y"]), *base[1:]], [(1, 0.3, None), *base[1:]]):
        assert determinism.fingerprint(make(other)) != one
    assert determinism.fingerprint(make([]))[0] == 0


# Mutants


@dataclass(frozen=True)
class Mutant:
    """One mistake: in ``where`` a text is replaced by another; ``check`` names a query or a function that has to notice."""

    label: str
    owner: object
    name: str
    old: str
    new: str
    check: object


def several_periods_raise(spark):
    from tests.test_windows_and_guards import QUARTER, YEAR, date, facts

    with pytest.raises(PySparkException):
        asof.AsOf(facts(spark, (YEAR, QUARTER)), date(2016, 1, 1)).first_reported(1, "Income", period_end=date(2015, 9, 26)).collect()


def gaps_stay_apart(spark):
    from tests.test_windows_and_guards import test_gaps_and_overlaps_are_rejects

    test_gaps_and_overlaps_are_rejects(spark)


def sets_are_compared(spark):
    from tests.test_windows_and_guards import test_universes_are_compared_as_sets

    test_universes_are_compared_as_sets(spark)


def ranks_are_right(spark):
    from pyspark.sql import functions as F

    df = spark.range(9000).selectExpr("cast(id * 7919 % 9000 as double) as v")
    assert selection.exact_quantiles(df, {"v": F.col("v")}, [0.25, 0.9])["v"] == [2249.75, 8099.1]


MUTANTS = [
    Mutant("knowledge is the filing date", views, "filings_pit", 'F.greatest("filed_at", shown)', 'F.col("filed_at")', "filings_knowledge_date"),
    Mutant("differs from the report before", views, "facts_pit", '~F.first("value").over(ordered)', '~F.lag("value").over(ordered)', "facts_pit_chain"),
    Mutant("the first report known", asof, "latest_per_grain", 'F.desc("knowledge_date")', 'F.asc("knowledge_date")', "asof_facts"),
    Mutant("restated is first against last", corpus, "_per_fact_columns", 'F.min("value") != F.max("value")', 'F.min_by("value", order) != F.max_by("value", order)', "contamination_tally"),
    Mutant("equal values are one run", store, "merge_unrevised_runs", '.withColumn("_run", F.sum("_c").over(w))', '.withColumn("_run", F.col("value"))', "macro_merge_runs"),
    Mutant("latest dissemination", store, "record_dissemination", 'F.least("disseminated_at", "_disseminated_at")', 'F.greatest("disseminated_at", "_disseminated_at")', "dissemination_least"),
    Mutant("links by accession only", store, "missing_links", '["accn", "cik"]', '["accn"]', "backfill_links_of_joint_filings"),
    Mutant("as-of excludes its day", joins, "asof_backward", '.orderBy("t", "side", "tie")', '.orderBy("t", F.desc("side"), "tie")', "last_known_bar"),
    Mutant("nothing purged after a test block", statistics, "split_roles", 'o < b["b"] + horizon', 'o < b["b"]', "combinatorial_purged_splits"),
    Mutant("wrong scale of the spread", backtest, "pair_spread", "3.0 - 2.0 * math.sqrt(2.0)", "3.0 - 1.9 * math.sqrt(2.0)", "corwin_schultz"),
    Mutant("a short history counts", backtest, "quotes", 'F.col("n_bars") < plan.least_bars', 'F.col("n_bars") < 1', "exclusions"),
    Mutant("a year in one arm only", panel, "common_universe", 'F.col("n_arms") == n_arms', 'F.col("n_arms") >= 1', "panel_common_universe"),
    Mutant("periods that end together", asof, "one_period", 'F.col("_least") == F.col("_greatest")', 'F.col("_least") <= F.col("_greatest")', several_periods_raise),
    Mutant("runs go over gaps", landing, "union_windows", '(F.row_number().over(own) > 1) & ~F.col("_gap")', "(F.row_number().over(own) > 1)", gaps_stay_apart),
    Mutant("universes by their size", panel, "same_universe", '.select("n", "digest", "total")', '.select("n")', sets_are_compared),
    Mutant("ties counted below", selection, "_narrowed", 'found[f"at{k}_{j}"]', "0", ranks_are_right),
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def holds(spark, duck, check) -> bool:
    """Whether the named query equals its SQL, or the function finds no fault."""
    if not isinstance(check, str):
        try:
            check(spark)
        except (Exception, pytest.fail.Exception):  # noqa: BLE001  whatever it is, the fault was noticed
            return False
        return True
    result = duck.execute(catalog.SQL[check])
    names = [c[0] for c in result.description]
    want = rows(names, result.fetchall())
    try:
        df = catalog.QUERIES[check](spark, SF)
        return rows(df.columns, df.collect()) == want
    except PySparkException:
        return False


@pytest.mark.parametrize("mutant", MUTANTS, ids=lambda m: m.label)
def test_mutants_are_noticed(spark, duck, monkeypatch, mutant):
    original = getattr(mutant.owner, mutant.name)
    source = textwrap.dedent(inspect.getsource(original))
    assert source.count(mutant.old) == 1, "the mutant no longer fits the code"
    made: dict = {}
    exec(compile(source.replace(mutant.old, mutant.new), mutant.name, "exec"), mutant.owner.__dict__, made)  # noqa: S102
    for module in [m for n, m in sys.modules.items() if n.startswith("vintara") and getattr(m, mutant.name, None) is original]:
        monkeypatch.setattr(module, mutant.name, made[mutant.name])
    assert not holds(spark, duck, mutant.check)
    monkeypatch.undo()
    assert holds(spark, duck, mutant.check)


# Imports


def reached(module: str) -> set[str]:
    """All modules of the package that importing ``module`` leads to, by way of others too."""
    import ast
    from pathlib import Path

    import vintara

    root, seen, left = Path(vintara.__file__).parent, set(), [module]
    while left:
        name = left.pop()
        path = root.joinpath(*name.split(".")[1:])
        path = path / "__init__.py" if path.is_dir() else path.with_suffix(".py")
        if name in seen or not path.exists():
            continue
        seen.add(name)
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Import):
                left += [a.name for a in node.names if a.name.startswith("vintara")]
            elif isinstance(node, ast.ImportFrom) and (node.module or "").startswith("vintara"):
                left += [node.module, *(f"{node.module}.{a.name}" for a in node.names)]
    return seen


@pytest.mark.parametrize("module", ["asof", "views", "features", "panel", "backtest", "joins", "forensics"])
def test_what_sees_later_reports_is_out_of_reach_of_research(module):
    found = reached(f"vintara.operators.{module}")
    assert f"vintara.operators.{module}" in found
    assert not found & {"vintara.operators.corpus", "vintara.operators.store", "vintara.plans.service", "vintara.plans.ingest"} and not [n for n in found if n.startswith("vintara.llm")]
    assert "vintara.operators.corpus" in reached("vintara.plans.service")  # the search does find what is there

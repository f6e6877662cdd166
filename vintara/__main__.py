"""``python -m vintara --warehouse PATH status | asof | revisions | ingest …``"""

from __future__ import annotations

import argparse
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from vintara import schemas
from vintara.functions import scalars
from vintara.operators.asof import AsOf
from vintara.operators.store import Warehouse
from vintara.plans import service
from vintara.plans.ingest import Ingestor, tables


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vintara")
    p.add_argument("--warehouse", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("status")
    for name in ("asof", "revisions"):
        c = sub.add_parser(name)
        c.add_argument("ticker")
        c.add_argument("--concept", required=name == "asof")
        c.add_argument("--on", type=date.fromisoformat, required=True)
        c.add_argument("--limit", type=int, default=20)
        if name == "revisions":
            c.add_argument("--min-change", type=float, default=0.05)
    i = sub.add_parser("ingest").add_subparsers(dest="what", required=True)
    for what, more in (("tickers", ["observed_at"]), ("filings", []), ("facts", []), ("macro", ["series_id"]), ("prices", ["adjusted", "symbol", "source"]), ("delistings", ["observed_at", "source"]), ("daily", ["day"])):
        c = i.add_parser(what)
        for name in ("path", *more):
            c.add_argument(name)
    c = i.add_parser("company")
    for name, kind in (("cik", int), ("submissions", str), ("facts", str)):
        c.add_argument(name, type=kind)
    c = i.add_parser("universe")
    for name, kind in (("size", int), ("floor", float), ("seed", int), ("frames", str), ("submissions", str), ("facts", str)):
        c.add_argument(name, type=kind)
    c = sub.add_parser("search")
    c.add_argument("text")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    warehouse = Warehouse(spark, args.warehouse)
    if args.command == "status":
        for name in schemas.DDL:
            print(f"{name:20} {warehouse.count(name):>12,}")
        warehouse.read("ingest_runs").orderBy(F.desc("started_at")).limit(8).select("run_id", "source", "status", "rows_written", "started_at").show(truncate=False)
    elif args.command == "ingest":
        values = {k: v for k, v in vars(args).items() if k not in ("command", "what", "warehouse")}
        done = getattr(Ingestor(spark, warehouse), args.what)(*values.values())
        for one in done.values() if isinstance(done, dict) else [done]:
            print(one.run_id, one.written, one.skipped or "")
    elif args.command == "search":
        service.search(tables(warehouse), args.text).show(20, truncate=False)
    else:
        all_tables = tables(warehouse)
        cik = service.resolve(all_tables, args.ticker)
        if args.command == "asof":
            rows = AsOf(all_tables, args.on).marked_facts(cik, args.concept)
            label = scalars.period_label(F.col("period_start"), F.col("period_end")).alias("period")
            # What the same figure became later, for comparison only.
            last = Window.partitionBy(*schemas.GRAIN).orderBy(*[F.col(c).desc() for c in schemas.CHAIN_ORDER])
            today = all_tables["facts"].where((F.col("cik") == cik) & (F.col("concept") == args.concept)).withColumn("_r", F.row_number().over(last)).where("_r = 1")
            today = today.select(*[F.col(c).alias(f"_{c}") for c in schemas.GRAIN], F.col("value").alias("_today"))
            same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in schemas.GRAIN])
            rows = rows.join(today, same, "left").orderBy(F.desc("period_end"), F.desc("knowledge_date"))
            drift = F.when((F.col("value") != F.col("_today")) & (F.col("value") != 0), F.format_string("%+.2f %%", (F.col("_today") - F.col("value")).cast("double") / F.col("value").cast("double") * 100)).alias("difference")
            value = lambda c, n: scalars.abbreviated(F.col(c)).alias(n)
            rows.select(label, "unit", value("value", "value"), "mark", value("_today", "as it stands today"), drift, "knowledge_date", "report_seq", "accn").show(args.limit, truncate=False)
        else:
            n, rows = service.revisions(all_tables, cik, args.on, concept=args.concept, min_change=args.min_change, limit=args.limit)
            print(f"{n} revisions")
            rows.select("concept", "period_end", "prior_value", "value", "relative_change", "knowledge_date").show(args.limit, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

"""Evidence cards, the paper book and the trial ledger: append-only logs with chained hashes, one writer each.

A log is a file of JSON lines {entry, head}, each head hashing the one before it and the entry; entries are numbered from 1 on.
Appending reads the file's tail, however long the file is, and an entry is found by its number in a few reads. Verification
is a Spark job: byte ranges of the file are checked on their own, each with the head that stands before it.
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from datetime import date, datetime
from decimal import ROUND_HALF_EVEN, Decimal
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintara.functions.hashing import GENESIS, canonical_hash, canonical_json, chain_next
from vintara.operators.store import open_shared

#: Bytes read at a time when looking for a line's beginning, and bytes of a log that one task verifies.
BLOCK, RANGE = 4096, 32 << 20


def _line_before(f, at: int) -> tuple[int, bytes]:
    """Where the last whole line that ends at or before byte ``at`` starts, and the line; (0, b"") if there is none. Blank lines do not count."""
    tail = b""
    while at > 0:
        begin = max(0, at - BLOCK)
        f.seek(begin)
        tail = f.read(at - begin) + tail
        at = begin
        text = tail.rstrip()
        if text and (b"\n" in text or begin == 0):
            start = text.rfind(b"\n") + 1
            return begin + start, text[start:]
    return 0, b""


class ChainedLog:
    def __init__(self, path: str | Path):
        self.path = Path(path)

    def read(self) -> Iterator[dict]:
        """All lines, one after the other."""
        if self.path.exists():
            with self.path.open() as f:
                yield from (json.loads(line) for line in f if line.strip())

    def last(self) -> dict | None:
        """The last line, from the file's tail."""
        if not self.path.exists():
            return None
        with self.path.open("rb") as f:
            line = _line_before(f, f.seek(0, 2))[1]
        return json.loads(line) if line else None

    def head(self) -> str:
        last = self.last()
        return last["head"] if last else GENESIS

    def __len__(self) -> int:
        """Entries, as the last one's number says."""
        last = self.last()
        return last["entry"]["sequence"] if last else 0

    def entry(self, sequence: int) -> dict | None:
        """The entry with this number: halves of the file are left out, as numbers ascend."""
        if not self.path.exists():
            return None
        with self.path.open("rb") as f:
            low, high = 0, f.seek(0, 2)
            while low < high:
                start = max(low, _line_before(f, (low + high) // 2)[0])
                f.seek(start)
                line = f.readline()
                entry = json.loads(line)["entry"] if line.strip() else None
                if entry and entry["sequence"] == sequence:
                    return entry
                if entry and entry["sequence"] > sequence:
                    high = start
                else:
                    low = start + len(line)
        return None

    def append(self, entry: dict[str, Any]) -> str:
        """Number the entry, chain it to the last one and write it; its head."""
        last = self.last()
        entry = {"sequence": last["entry"]["sequence"] + 1 if last else 1} | entry
        head = chain_next(last["head"] if last else GENESIS, entry)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a") as f:
            f.write(json.dumps({"entry": json.loads(canonical_json(entry)), "head": head}, sort_keys=True) + "\n")
        return head

    def verify(self) -> int:
        """Index of the first entry that was changed, removed or moved; -1 for none. Reads line by line; :func:`verified` does so in many tasks."""
        head = GENESIS
        for k, row in enumerate(self.read()):
            head = chain_next(head, row["entry"])
            if head != row["head"]:
                return k
        return -1

    def frame(self, spark: SparkSession, schema: str) -> DataFrame:
        return spark.read.schema(f"entry STRUCT<{schema}>, head STRING").json(str(self.path)).select("entry.*", "head")


def _head(line: bytes) -> str:
    """A line's recorded head; empty, which nothing follows, for what is no entry."""
    try:
        return str(json.loads(line)["head"])
    except (ValueError, KeyError, TypeError):
        return ""


def _checked_range(f, start: int, end: int) -> tuple[int, int]:
    """Of the lines that start in the byte range: how many there are, and the place of the first that does not follow, -1 for none."""
    head, at = GENESIS, 0
    if start:
        before, line = _line_before(f, start)
        if line:  # it may go on into this range: the first line here starts after it
            f.seek(before)
            line = f.readline()
            head, at = _head(line), before + len(line)
    f.seek(at)
    n, broken = 0, -1
    while at < end and (line := f.readline()):
        at += len(line)
        if line.strip():
            try:
                follows = chain_next(head, json.loads(line)["entry"]) == _head(line)
            except (ValueError, KeyError, TypeError):
                follows = False
            if not follows and broken < 0:
                broken = n
            head, n = _head(line), n + 1
    return n, broken


def verified(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """By log (files that match ``path``): entries, and first_break, the index of the first entry that does not follow, -1 if all do.

    Each byte range is checked by a task that reads the head before its first line; a changed, removed or moved entry breaks the
    one it is in or the one after it. What comes back of a range is two numbers, summed up in the ranges' order.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {range_bytes}L)")).alias("start"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                system, at = open_shared(row["path"])
                with io.BufferedReader(system.open_input_file(at)) as f:
                    out.append((row["path"], row["start"], *_checked_range(f, row["start"], min(row["start"] + range_bytes, row["length"]))))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), *[pa.int64()] * 3))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "start", "n", "broken"])

    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = ranges.repartition(4 * partitions, "path", "start").mapInArrow(check, "path string, start long, n long, broken long")
    told = F.sort_array(F.collect_list(F.struct("start", "n", "broken"))).alias("r")
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("broken"))
    step = lambda a, r: F.struct((a["n"] + r["n"]).alias("n"), F.when((a["broken"] < 0) & (r["broken"] >= 0), a["n"] + r["broken"]).otherwise(a["broken"]).alias("broken"))
    summed = found.groupBy("path").agg(told).select("path", F.aggregate("r", nothing, step).alias("s"))
    return summed.select("path", F.col("s.n").alias("entries"), F.col("s.broken").alias("first_break"))


class PaperBook(ChainedLog):
    """Marks of a book: net asset value is cash and positions at their prices; dates only go forward."""

    def record(self, day: date, cash: Decimal, positions: list[tuple[str, Decimal, Decimal]], note: str = "", recorded_at: datetime | None = None) -> dict:
        """positions: (symbol, quantity, price), in any order: the entry has them by symbol. The caller says when it is recorded, so a replay gives the same book."""
        if not isinstance(cash, Decimal):
            raise TypeError("cash is a Decimal")
        last = self.last()
        if last and last["entry"]["day"] >= day.isoformat():
            raise ValueError(f"a mark for {last['entry']['day']} is in the book already")
        values = [q * p for _, q, p in positions]
        entry = {
            "sequence": len(self) + 1, "day": day.isoformat(), "recorded_at": recorded_at.isoformat() if recorded_at else "", "cash": str(cash),
            "positions": [[s, str(q), str(p), str(q * p)] for s, q, p in sorted(positions)], "note": note,
            "nav": str(cash + sum(values, Decimal(0))), "gross": str(sum(map(abs, values), Decimal(0))), "net": str(sum(values, Decimal(0))),
        }
        self.append(entry)
        return entry


class TrialLedger(ChainedLog):
    """Every configuration that was tried. Amendments and outcomes are entries too, and count as no trial."""

    def register(self, family: str, config: dict[str, Any], note: str = "", hypothesis: str = "", registered_at: str = "") -> str:
        """Before the trial is run: what it tries, what it is expected to show, when. Returns the entry's head."""
        if not family.strip():
            raise ValueError("a family names the trials that are corrected together")
        return self.append({"kind": "trial", "family": family.strip(), "hypothesis": hypothesis.strip(), "config": config, "config_hash": canonical_hash(config), "registered_at": registered_at, "note": note})

    def record_outcome(self, family: str, trial: int | str, outcome: dict[str, Any] | str) -> str:
        """What came of a trial, named by its number or, by way of a search, its head: a new entry, the old one is never changed."""
        if isinstance(trial, str):
            found = next((r["entry"] for r in self.read() if r["head"] == trial), None)
        else:
            found = self.entry(trial)
        if not found or found["kind"] != "trial" or found["family"] != family:
            raise KeyError(f"{trial} is no trial of {family}")
        body = {"note": outcome} if isinstance(outcome, str) else outcome
        return self.append({
            "kind": "outcome", "family": family, "hypothesis": f"[outcome of trial {found['sequence']}] {found['hypothesis']}".rstrip(),
            "config": {"amends": found["sequence"]}, "registered_at": found["registered_at"], "outcome": body,
        })

    def count(self, family: str | None = None) -> int:
        return sum(1 for r in self.read() if r["entry"]["kind"] == "trial" and family in (None, r["entry"]["family"]))

    def configurations(self, family: str) -> int:
        return len({r["entry"]["config_hash"] for r in self.read() if r["entry"]["kind"] == "trial" and r["entry"]["family"] == family})

    def by_family(self, spark: SparkSession) -> DataFrame:
        """Rows (family, trials, configurations, outcomes) of the whole ledger, counted by Spark."""
        rows = self.frame(spark, "kind STRING, family STRING, config_hash STRING")
        trial = F.col("kind") == "trial"
        return rows.groupBy("family").agg(F.count_if(trial).alias("trials"), F.countDistinct(F.when(trial, F.col("config_hash"))).alias("configurations"), F.count_if(F.col("kind") == "outcome").alias("outcomes"))


def fixed(x: float, places: int = 8) -> str | None:
    """A float on a card: a text of fixed places, half to even; None for what is no number."""
    if x is None or not math.isfinite(x):
        return None
    return str(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_EVEN))


@dataclass(frozen=True)
class Comparison:
    label: str
    left: float
    right: float

    @property
    def difference(self) -> float:
        return self.left - self.right

    @property
    def relative(self) -> float | None:
        return None if self.right == 0 else (self.left - self.right) / abs(self.right)


def _stated(value: Any) -> Any:
    """Floats as texts of fixed places, dates as ISO texts, comparisons with what follows from them; the rest as it is."""
    if isinstance(value, float):
        return fixed(value)
    if isinstance(value, Comparison):
        return _stated({"label": value.label, "left": value.left, "right": value.right, "difference": value.difference, "relative": value.relative})
    if isinstance(value, dict):
        return {k: _stated(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_stated(v) for v in value]
    return value.isoformat() if isinstance(value, (date, datetime)) else value


@dataclass(frozen=True)
class EvidenceCard:
    """A study's result; its hash covers everything but the time of writing.

    arms are the summaries of what was compared, comparisons their differences, provenance where data and universe come from; trials
    counts the attempts of the family in the ledger.
    """

    study_id: str
    title: str
    data_vintage: str
    code_version: str
    trials: int
    findings: dict[str, Any] = field(default_factory=dict)
    caveats: tuple[str, ...] = ()
    generated_at: str = ""
    hypothesis: str = ""
    verdict: str = ""
    trial_family: str = ""
    provenance: dict[str, Any] = field(default_factory=dict)
    arms: tuple[dict[str, Any], ...] = ()
    comparisons: tuple[Comparison, ...] = ()
    statistics: dict[str, Any] = field(default_factory=dict)

    def body(self) -> dict[str, Any]:
        return {f.name: _stated(getattr(self, f.name)) for f in fields(self) if f.name != "generated_at"}

    @property
    def repro_hash(self) -> str:
        return canonical_hash(self.body())

    def to_json(self) -> str:
        return json.dumps(self.body() | {"caveats": list(self.caveats), "generated_at": self.generated_at, "repro_hash": self.repro_hash}, sort_keys=True, indent=2)

    def to_markdown(self) -> str:
        lines = [f"# {self.title}", "", f"Data of {self.data_vintage}, {self.trials} trials, hash `{self.repro_hash}`.", "", "| finding | value |", "|---|---|"]
        body = self.body()
        lines += [f"| {k} | {v} |" for k, v in (body["findings"] | body["statistics"]).items()]
        lines += [f"| {c['label']} | {c['left']} against {c['right']}: {c['difference']} |" for c in body["comparisons"]]
        lines[2:2] = [x for x in (self.hypothesis, "", self.verdict, "") if x or self.hypothesis or self.verdict]
        return "\n".join([*lines, "", *(f"- {c}" for c in self.caveats), ""])

    def write(self, folder: str | Path) -> None:
        folder = Path(folder)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{self.study_id}.json").write_text(self.to_json())
        (folder / f"{self.study_id}.md").write_text(self.to_markdown())


def verdict(share: float, threshold: float = 0.01) -> str:
    """What a restatement share means for a study that ignores vintages."""
    if share >= threshold:
        return f"{share:.2%} of the facts were restated: above the threshold of {threshold:.0%}, vintages cannot be ignored"
    return f"{share:.2%} of the facts were restated: below the threshold of {threshold:.0%}"

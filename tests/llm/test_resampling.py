"""Importance resampling against plain Python, and against its SQL on a whole table."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import pytest

from tests.llm.data import LONG, ODD, SF, documents
from vintara.llm import queries, resampling

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, max_n):
    w = re.findall(resampling.WORD, (text or "").translate(ASCII))
    return w, [" ".join(w[k : k + n]) for n in range(1, max_n + 1) for k in range(len(w) - n + 1)]


def expected(rows, target, max_n=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(place, features(text, max_n)[1]))
    for text in target:
        t.update(map(place, features(text, max_n)[1]))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out, able = [], []
    for i, text in rows:
        w, f = features(text, max_n)
        weight = sum(gain[place(x)] for x in f)
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        row = [i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if len(w) >= min_words:
            able.append(row)
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = k + 1
    return sorted(map(tuple, out), key=str)


def target(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


@pytest.mark.parametrize("max_n,buckets", [(1, 10_000), (3, 97)])
def test_odd_documents_against_plain_python(spark, monkeypatch, max_n, buckets):
    monkeypatch.setattr(resampling, "PIECE_BYTES", 500)
    rows = [r[:2] for r in ODD] + [(100 + k, f"word{k % 7} some more {k} " * (k % 40)) for k in range(90)] + [(300, LONG + "rare")] * 3 + [(301, "a\x00b Ä_ö2 " * 12)]
    wanted = ["lorem ipsum dolor", None, "", "same Text word3", "some more rare ö2"]
    got = resampling.resample(documents(spark, rows), target(spark, wanted), max_n=max_n, buckets=buckets, percent=40)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, wanted, max_n, buckets, percent=40)


def test_empty_tables(spark):
    rows = [(k, f"alpha beta {k} " * 10) for k in range(30)]
    assert not resampling.resample(documents(spark, []), target(spark, ["a"])).count()
    got = resampling.resample(documents(spark, rows), target(spark, []).limit(0))
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, [])


def test_one_row_repeated_very_often(spark):
    rows = [(7, "the same words again and again " * 5)] * 400 + [(8, "others " * 25)]
    got = sorted(map(tuple, resampling.resample(documents(spark, rows), target(spark, ["words"])).collect()), key=str)
    assert got == expected(rows, ["words"]) and sum(r[4] is not None for r in got) == 40


def test_whole_table_against_its_sql(spark):
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    got = queries.op13_importance_resampling(spark, SF).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(db.sql(resampling.SQL).fetchall(), key=str)


def test_crc_is_asked_for_distinct_runs_only(monkeypatch):
    """The statement alone, as a task runs it."""
    seen = []

    def crc(grams):
        seen.extend(grams.to_pylist())
        return resampling._crc32(grams)

    with duckdb.connect(config=resampling.DUCKDB) as db:
        db.create_function("crc32", crc, ["VARCHAR"], "BIGINT", type="arrow")
        db.sql("CREATE TABLE texts AS SELECT * FROM (VALUES (0, 'b a b'), (1, ''), (2, 'a b')) t(row, text)")
        got = db.sql(resampling._statement(2, 1000)).fetchall()
    assert [r[:2] for r in got] == [(3, 5), (0, 0), (2, 3)] and sorted(seen) == ["a", "a b", "b", "b a"]

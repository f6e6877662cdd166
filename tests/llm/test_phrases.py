"""Phrase mining against plain Python, and against its SQL on a whole table."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tests.llm.data import LONG, ODD, SF, documents
from vintara.llm import phrases, queries

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, max_words=3, least=10, covered=50, top=2000):
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            f[lang].update(w[k : k + m] for m in range(1, max_words + 1) for k in range(len(w) - m + 1))
    for lang, counts in f.items():
        candidates, most, found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}, Counter(), []
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    most[p[k : k + m]] = max(most[p[k : k + m]], a)
        for p, a in candidates.items():
            if 100 * most[p] >= covered * a:
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def made(seed, n_docs=120):
    """Texts of few words, so that phrases overlap, repeat their rarest word, and tie."""
    rng, out = random.Random(seed), []
    for k in range(n_docs):
        words = [rng.choice(["a", "b", "B", "cc", "dé", "x\x00y", "　", f"r{rng.randrange(30)}"]) for _ in range(rng.randrange(60))]
        out.append((k, "".join(w + rng.choice([" ", " ", " ", "\t", ". ", "\n", ",", " \v"]) for w in words), rng.choice(["en", "fr", None, "und"])))
    return out


def check(spark, rows, **options):
    got = phrases.collocations(documents(spark, [(i, t, lang, "s") for i, t, lang in rows]), **options)
    want = expected([(lang, t) for _, t, lang in rows], options.get("max_words", 3), options.get("least", 10), options.get("covered_percent", 50), options.get("top", 2000))
    assert sorted(map(tuple, got.collect())) == want
    return want


@pytest.mark.parametrize("options", [{}, {"max_words": 5, "least": 3}, {"max_words": 2, "top": 3, "covered_percent": 100}])
def test_against_plain_python(spark, options):
    assert len(check(spark, made(len(options)), **options)) > 3


def test_hot_pivots_many_shards_and_buckets(spark, monkeypatch):
    """Pivots over several buckets, shards and flushes of a few texts each."""
    for name, value in (("SHARE", 20), ("FRAGMENTS", 50), ("SHARD_BYTES", 300), ("KEPT_FRAGMENTS", 100), ("BROADCAST_LANGUAGES", 1)):
        monkeypatch.setattr(phrases, name, value)
    hot = [(1000 + k, "of the of the same line again", "en") for k in range(200)]
    assert check(spark, made(7) + hot, max_words=4, least=5)


def test_odd_documents(spark):
    rows = [(r[0], r[1], r[2] if len(r) > 2 else None) for r in ODD] * 6 + [(77, LONG + "the end", "en")]
    assert check(spark, rows)
    assert not phrases.collocations(documents(spark, [])).count()
    assert not phrases.collocations(documents(spark, [(1, "only rare words", "en", "s"), (2, None, None, None)])).count()


def test_whole_table_against_its_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = db.sql(phrases.SQL).fetchall()
    assert len(want) > 20 and sorted(map(tuple, queries.op11_phrase_mining(spark, SF).collect())) == sorted(want)


def test_fragments_are_rewritten_for_their_pivot():
    """2 is more frequent than 5, 0 stands for infrequent words and ends of pieces."""
    at, rows = phrases.fragments(np.array([2, 5, 2, 5, 9, 0, 5, 2], np.uint32))
    assert dict(zip(at.tolist(), rows.tolist())) == {
        1: [0, 2, 5, 2, 5],  # its own word may stand to the right
        3: [0, 2, 5, 0, 0],  # but not to the left; 9 is rarer
        4: [2, 5, 9, 0, 0],
        6: [0, 0, 5, 2, 0],
    }


def test_scores_are_exact_beyond_64_bits(spark):
    big = [(999_999_999_999, 999_999_999_999, 1_000_000_000_003), (123_456_789_012, 987_654_321_098, 123_456_789_013), (3, 7, 9)]
    got = spark.createDataFrame(big, "a long, l long, r long").select(phrases._score("a", "l", "r")).collect()
    assert [r[0] for r in got] == [1_000_000 * a * a // (b * c) for a, b, c in big]


def test_numbers_too_wide_to_pack_are_counted_too():
    _, rows = phrases.fragments(np.random.default_rng(4).integers(0, 5, 900).astype(np.uint32))
    small = [{tuple(w): n for w, n in zip(p.tolist(), c.tolist())} for p, c in phrases.count_phrases(rows)]
    wide = np.where(rows > 0, rows + np.uint32(1 << 31), 0).astype(np.uint32)
    large = [{tuple(x - (1 << 31) for x in w): n for w, n in zip(p.tolist(), c.tolist())} for p, c in phrases.count_phrases(wide)]
    assert small == large and len(small[1]) > 5

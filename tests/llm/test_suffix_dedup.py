import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.data import ODD, SF, documents
from vintara.llm import suffix_dedup as sd
from vintara.llm.common import table


def brute(docs, length=50):
    """docs: (id, text); the expected rows, sorted."""
    first = {}
    for i, t in docs:
        raw = (t or "").encode()
        if i is not None:
            for k in range(len(raw) - length + 1):
                s = raw[k : k + length]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if i is not None:
            for k in range(len(raw) - length + 1):
                if first[raw[k : k + length]] < i:
                    gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for text in (b"a" * 300, b"ab" * 200, bytes(rng.choice(b"ab\x00") for _ in range(3000)), b"x", b"banana" * 30 + bytes(range(256))):
        raw = np.frombuffer(text, np.uint8)
        sa = sd.suffix_array(raw)
        assert sorted(sa.tolist()) == list(range(len(text)))
        suffixes = [text[k:] for k in sa]
        assert suffixes == sorted(suffixes)
        shared = sd.common_prefixes(raw, sa, lanes=7)
        for r in range(1, len(sa)):
            a, b = text[sa[r - 1] :], text[sa[r] :]
            n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[r] == min(50, n)


@pytest.mark.parametrize("piece", [200, 1000, 1 << 20])
@pytest.mark.parametrize("digests", [1 << 63, 5, 1])
def test_pieces_meet(monkeypatch, piece, digests):
    """Also if many different strings have one digest."""
    digest = sd._digest
    monkeypatch.setattr(sd, "_digest", lambda raw, at: (digest(raw, at).view(np.uint64) % np.uint64(digests)).view(np.int64))
    rng = random.Random(2)
    base = [bytes(rng.choice(b"abcd") for _ in range(300)) for _ in range(6)]
    segments, docs = [], []
    for k in range(60):
        b = rng.choice(base)
        a = rng.randrange(0, 200)
        segments.append(b[a : a + rng.randrange(50, 100)])
        docs.append(rng.randrange(20))
    least = {}
    for s, d in zip(segments, docs):
        for k in range(len(s) - 49):
            least[s[k : k + 50]] = min(least.get(s[k : k + 50], d), d)
    flags, strings = sd.smaller_elsewhere(segments, np.array(docs), piece)
    for s, d, f in zip(segments, docs, np.split(flags, np.cumsum(strings)[:-1])):
        assert f.tolist() == [least[s[k : k + 50]] < d for k in range(len(s) - 49)]


def test_whole_table(spark):
    docs = table(spark, SF, "documents")
    assert got(sd.remove_repeats(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_planted_passages(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (9, 12, 30, 200)] + ["z" * 49, "y" * 50, "z" * 130, "é" * 40]
    docs = []
    for k in range(150):
        parts = [" ".join(word() for _ in range(rng.randrange(1, 40)))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), word()]
        docs.append((rng.randrange(-5, 400), rng.choice(["", " "]).join(parts)))
    for options in ({}, {"sorted_bytes": 500}, {"shard_bytes": 700}, {"hot": 1}, {"hot": 3, "sorted_bytes": 300}):
        assert got(sd.remove_repeats(documents(spark, docs), **options)) == brute(docs)


def test_one_minimizer_in_very_many_segments(spark):
    """A line inside ever different text: all its strings have one name, and none is like another."""
    rng = random.Random(4)
    raw = np.frombuffer(bytes(rng.choice(b"abcdefghijklmnop") for _ in range(3000)), np.uint8)
    m = sd.minimizers(raw)
    k = int(m.argmin())  # the least hash of all: whatever stands around it, it is the minimizer
    line = next(raw[j : j + 24].tobytes() for j in range(k, k + 27) if (sd.minimizers(raw[max(0, j - 26) : j + 50]) == m[k]).all())
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    docs = [(i, word(40) + line.decode() + word(40)) for i in range(400)]
    docs += [(400 + i, docs[rng.randrange(400)][1][rng.randrange(20) :] + word(9)) for i in range(100)]
    for hot in (2, 20, 1 << 40):
        assert got(sd.remove_repeats(documents(spark, docs), hot=hot)) == brute(docs)
    shard = sd.Shard([d[0] for d in docs], [d[1].encode() for d in docs], 40)
    every = np.ones(len(shard.name), bool)
    rows = pa.Table.from_batches(list(sd.Candidates(shard, every, every, 1 << 20).rows(3)))
    assert len(set(rows.column("bin").to_pylist())) > 0.9 * len(rows) and set(map(len, rows.column("data").to_pylist())) == {50}


def test_rows_grow_with_the_text_not_with_the_shards():
    import pyarrow.parquet as pq

    docs = pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "text"]).to_pylist()

    def count(rows):
        shard = sd.Shard([r["doc_id"] for r in rows], [(r["text"] or "").encode() for r in rows], 40)
        every = np.ones(len(shard.name), bool)
        return sum(b.num_rows for b in sd.Candidates(shard, every, ~every, 1 << 20).rows(0))

    one, two = count(docs), count(docs[::2]) + count(docs[1::2])
    assert one <= two <= 1.2 * one
    assert one < sum(len((r["text"] or "").encode()) for r in docs) / 6


def test_odd_documents(spark):
    assert got(sd.remove_repeats(documents(spark, ODD))) == brute([(i, t) for i, t, *_ in ODD])
    assert not sd.remove_repeats(documents(spark, [])).count()
    kept = {r["doc_id"]: bytes(r["kept"]) for r in sd.remove_repeats(documents(spark, [(1, "q" * 60 + "one"), (2, "two" + "q" * 60)]), with_kept=True).collect()}
    assert kept == {1: b"q" * 60 + b"one", 2: b"two"}

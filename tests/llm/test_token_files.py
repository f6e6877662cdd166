"""Token files: the codec alone, and whole tables against the library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.data import LONG, ODD, SF, documents
from vintara.llm import queries, simple8b, token_files
from vintara.llm.common import table


def round_trip(ids):
    data, index = simple8b.encode(np.array(ids, np.uint64))
    lengths = np.minimum(simple8b.BLOCK, len(ids) - simple8b.BLOCK * np.arange(len(index)))
    assert simple8b.decode(data, index, lengths).tolist() == list(ids)
    return data, index


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1), st.sampled_from([2**60 - 1, 2**60 - 2, 2**32, 2**32 - 1])), max_size=300), st.integers(1, 9))
def test_any_ids_come_back(ids, times):
    round_trip(ids * times)


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 1023, 1024, 1025, 4096])
def test_block_borders(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 50_000, 2**63):
        round_trip(rng.integers(0, top, n, dtype=np.uint64).tolist())


def test_few_large_ids_are_escaped_and_cost_little():
    rng = np.random.default_rng(2)
    small = rng.integers(0, 14, 50_000, dtype=np.uint64)
    plain, _ = round_trip(small.tolist())
    small[::100] = 2**50
    mixed, index = round_trip(small.tolist())
    assert index["escapes"].sum() == 500 and len(mixed) < len(plain) + 500 * 8 + 300 * 8


def test_words_are_as_full_as_they_can_be():
    data, index = round_trip([0] * 1024)
    assert index["words"].tolist() == [18]  # 17 words of 60 and one of what is left
    _, index = round_trip([40_000] * 1024)
    assert index["words"].tolist() == [342]  # three ids of 20 bits


def expected(rows, end=2):
    """rows: (id, text) in any order; by id, null first. Rows of one id are told apart by nothing but their texts' digest."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def check_starts(rows):
    """rows (doc_id, start, n_tokens, ...): starts go on without a gap and ids ascend."""
    at = 0
    for i, start, n, *_ in rows:
        assert start == at
        at += n
    ids = [(r[0] is not None, r[0] or 0) for r in rows]
    assert ids == sorted(ids)


def test_whole_table_against_the_library(spark):
    docs = table(spark, SF, "documents")
    got = sorted(map(tuple, queries.op12_token_files(spark, SF).collect()), key=lambda r: r[1])
    want = expected([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    check_starts(got)
    assert [(i, n, c) for i, _, n, c in got] == want


def test_odd_documents_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_CHUNKS", 20)
    rows = [(*r, None)[:2] for r in ODD] + [(5, "other text of 5"), (20, LONG * 3), (21, "İstanbul ŉa ǅ Ω ﬃ á b\x1cc"), (-7, "negative")] + [(None, "hot")] * 40
    got = [tuple(r) for r in token_files.token_round_trip(documents(spark, rows)).collect()]
    got.sort(key=lambda r: r[1])
    check_starts(got)
    assert all(len(raw) == 4 * n for _, _, n, raw in got)
    assert sorted([(i, n, zlib.crc32(raw)) for i, _, n, raw in got], key=str) == sorted(expected(rows), key=str)
    assert not token_files.token_round_trip(documents(spark, [])).count()
    with pytest.raises(TypeError):
        token_files.token_round_trip(documents(spark, rows), id_col="text")


def test_stretches_of_a_file(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "PIECE", 2 * simple8b.BLOCK)
    monkeypatch.setattr(token_files, "STRETCH", 4 * simple8b.BLOCK)
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 2**32, n).astype("<u4") for n in (1, 5000, 3, 1024, 1023, 9000, 2, 700)]
    writer = token_files.Writer(f"{tmp_path}/a.tokens")
    for k, x in enumerate(ids):
        writer.add([k if k else None], [x.tobytes()])
    found = []
    stretches = list(token_files._stretches(writer.close()["end"].astype(np.int64)))
    assert len(stretches) > 3
    for stretch in stretches:
        docs, got = token_files.read_stretch(f"{tmp_path}/a.tokens", *stretch)
        ends = docs["end"].astype(np.int64) - stretch[2]
        found += [got[a:b].tolist() for a, b in zip([0, *ends], ends)]
    assert found == [x.tolist() for x in ids]


def test_a_tokenizer_that_keeps_white_space(spark):
    rows = [(1, "a  b\n c"), (2, " a"), (3, "")]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = token_files.token_round_trip(documents(spark, rows), model="byte_bpe_50k.json", end_id=50256).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got} == {i: [*library.encode(t).ids, 50256] for i, t in rows}

"""Properties of the parts that run inside tasks, without Spark."""

from functools import lru_cache

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_small_operators import plain_measures
from vintara.llm import pieces, quality, simhash, suffix_dedup, token_counts, warc

TEXT = st.text(st.sampled_from(list("aAbé ▁\n\t\r\x00\x0b\x1c '.<|>1ſΣﬁ́　😀")), max_size=60)
fast = settings(max_examples=150, deadline=None)


@lru_cache
def model():
    from sentencepiece import SentencePieceProcessor

    return pieces.WordTable(public_tokenizers.path(pieces.MODEL)), SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))


@lru_cache
def counter():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_counts.MODEL)
    return token_counts.PrefixCounter(path), Tokenizer.from_file(path)


@fast
@given(TEXT)
def test_marked_words_join_to_the_library(text):
    table, library = model()
    assert table.separate
    ids = library.encode(text)
    assert table.encode(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


@fast
@given(TEXT, st.integers(0, 20))
def test_prefix_counts(text, budget):
    own, library = counter()
    table = own.table(text)
    encoded = library.encode(text, add_special_tokens=False)
    assert (table[1][-1] if table[1] else 0) == len(encoded.ids)
    for k in range(len(text) + 1):
        assert own.tokens_of_prefix(table, len(text[:k].encode())) == len(library.encode(text[:k], add_special_tokens=False).ids)
    if len(encoded.ids) > budget:
        chunks = text.encode().split()
        end = own.truncation_point(text.encode(), chunks, budget)
        assert end == (len(text[: encoded.offsets[budget - 1][1]].encode()) if budget else 0)


@fast
@given(TEXT)
def test_measures(text):
    assert quality.measure_text(text)[:5] == plain_measures(text)


@fast
@given(st.integers(1, 400), st.data())
def test_more_rejections_are_less_likely_to_be_proven(n, data):
    k = data.draw(st.integers(0, n))
    assert quality.binomial_cdf(k, n, 0.1) >= quality.binomial_cdf(max(0, k - 1), n, 0.1) - 1e-12
    assert quality.binomial_cdf(k, n, 0.1) >= quality.binomial_cdf(k, n, 0.2) - 1e-12


@fast
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12), st.lists(st.tuples(st.integers(0, 11), st.integers(0, 63), st.integers(0, 63)), max_size=40))
def test_bucket_links_connect_what_is_connected(seeds, changes):
    values = list(seeds)
    for k, a, b in changes:
        values.append(values[k % len(values)] ^ (1 << a) ^ (1 << b))
    values = sorted(set(values))
    links: list = []
    old, simhash.LARGE = simhash.LARGE, 4
    try:
        simhash._near(np.array(values, np.uint64), 4, links)
    finally:
        simhash.LARGE = old
    assert all((a ^ b).bit_count() <= 4 for a, b in links)

    def groups(pairs):
        root = {v: v for v in values}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        out = {}
        for v in values:
            out.setdefault(find(v), set()).add(v)
        return sorted(map(sorted, out.values()))

    assert groups(links) == groups([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4])


@fast
@given(st.binary(max_size=300), st.integers(1, 50))
def test_common_prefixes_of_any_bytes(data, lanes):
    raw = np.frombuffer(bytes(b % 3 for b in data) * 2, np.uint8)
    if len(raw):
        sa = suffix_dedup.suffix_array(raw)
        text = raw.tobytes()
        assert [text[k:] for k in sa] == sorted(text[k:] for k in range(len(text)))
        for r, n in enumerate(suffix_dedup.common_prefixes(raw, sa, lanes=lanes)[1:], 1):
            a, b = text[sa[r - 1] :], text[sa[r] :]
            assert n == min(50, next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


@fast
@given(st.binary(min_size=0, max_size=400), st.binary(min_size=100, max_size=400), st.binary(max_size=100))
def test_minimizers_depend_on_the_string_only(before, inside, after):
    shared = suffix_dedup.minimizers(np.frombuffer(inside, np.uint8))
    whole = suffix_dedup.minimizers(np.frombuffer(before + inside + after, np.uint8))
    assert (whole[len(before) : len(before) + len(shared)] == shared).all() and len(shared) == len(inside) - 49


@fast
@given(st.lists(st.binary(max_size=200), max_size=8), st.integers(1, 300))
def test_every_record_is_read_once(payloads, size):
    from io import BytesIO

    data = b"".join(warc.record(k, "u", p, None) for k, p in enumerate(payloads))
    got = [warc.parse(r)[6] for a in range(0, len(data), size) for r in warc.records_in(BytesIO(data), a, min(a + size, len(data)), len(data), ahead=64)]
    assert got == payloads

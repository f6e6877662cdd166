"""Operators of one row at a time, and the rules around them, against plain Python and the libraries."""

import re
from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.data import LONG, ODD, SF, documents
from vintara.llm import language, pieces, quality, token_counts
from vintara.llm.common import table

SPACE = r"[\x20\x09-\x0D]"


def rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


# quality


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    many = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if many[w] > 1 for j in range(8)}
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@pytest.mark.parametrize("text", [r[1] for r in ODD] + ["a b c d e f g h " * 3, "a\na\n \n\nb\na", "# | <p> a b c d e f g h x a b c d e f g h a b c d e f g h"])
def test_measures(text):
    assert quality.measure_text(text)[:5] == plain_measures(text)


def test_measures_of_the_table(spark):
    docs = table(spark, SF, "documents")
    got = rows(quality.judge(docs, table(spark, SF, "labels")), "doc_id")
    for doc in docs.collect():
        want = plain_measures(doc["text"])
        r = got[doc["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_odd_documents_and_labels(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (99, 1), (5, None)], "doc_id long, quality int")
    got = quality.judge(documents(spark, ODD), labels).collect()
    assert len(got) == len(ODD)
    assert not quality.judge(documents(spark, []), labels.where("false")).count()


def test_binomial_cdf():
    from math import comb

    for n, k, p in ((10, 3, 0.2), (200, 0, 0.01), (500, 30, 0.05), (7, 7, 0.5), (1, 0, 0.3)):
        want = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert quality.binomial_cdf(k, n, p) == pytest.approx(want, rel=1e-9)


def test_cutoffs_keep_the_risk():
    n = 20_000
    good = {0: n - 60, 50: 40, 150: 20}
    assert quality.best_cutoff(good, {100: 5}, 0.005, 0.001) == 100
    assert quality.best_cutoff(good, {40: 5}, 0.005, 0.001) == 40
    assert quality.binomial_cdf(60, n, 0.005) <= 0.001
    assert quality.best_cutoff(good, {0: 5}, 0.005, 0.001) is None  # no bad document to catch
    assert quality.best_cutoff({0: 50}, {100: 5}, 0.005, 0.001) is None  # too few to prove anything
    assert quality.best_cutoff({0: 10_000, 100: 500}, {50: 5, 150: 1}, 0.005, 0.001) == 150


def test_a_rule_is_learned_and_spares_good_documents(spark):
    good = [(k, f"plain words of a good{k} text that says{k} something a{k} b{k} c{k} " * 3) for k in range(3000)]
    bad = [(k, f"### $$$ %%% *** words &&& ||| <<< >>> ### bad text{k} here now it goes on and on to the end") for k in range(3000, 3100)]
    labels = spark.createDataFrame([(k, int(k < 3000)) for k in range(3050)], "doc_id long, quality int")
    got = rows(quality.judge(documents(spark, good + bad), labels, risk=0.01), "doc_id")
    assert all("symbols" in got[k]["rejected_by"] and not got[k]["kept"] for k in range(3000, 3100))
    assert not any(got[k]["rejected_by"] for k in range(3000))


def plain_verdicts(docs, labels, risk, error):
    """What judge() should say, from its description, in plain Python: rejected_by by id."""
    from math import ceil, comb

    from xxhash import xxh64_intdigest

    def steps(text):
        n, chars, symbols, dup, repeat = plain_measures(text)
        lines = sum(1 for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
        if not n:
            return n, dict.fromkeys(quality.RULES, 0)
        values = {
            "symbols": symbols / chars,
            "dup_lines": dup / lines,
            "repeat_words": repeat / n,
            "upper": sum(c.isupper() for c in text) / chars,
            "long_words": 1 - min(1, 4 * n / chars),
            "short_words": 1 - min(1, chars / (4 * n)),
        }
        return n, {r: min(200, ceil(v * 200)) for r, v in values.items()}

    def is_tuning(i):
        h = xxh64_intdigest(b"tuning", xxh64_intdigest(str(i).encode(), 42))
        return (h - (1 << 64) if h >> 63 else h) % 3 == 0

    found = {i: steps(t) for i, t in docs}
    stratum = {i: sum(n >= x for x in (50, 200, 1000)) for i, (n, _) in found.items()}
    levels = {}
    for s in range(4):
        part = {g: [found[i][1] for i, q in labels.items() if q == g and stratum[i] == s and is_tuning(i)] for g in (0, 1)}
        levels[s] = [{} for _ in quality.LEVELS]
        for rule in quality.RULES if part[0] and part[1] else ():
            tail = {g: [sum(x[rule] >= k for x in part[g]) / len(part[g]) for k in range(202)] for g in (0, 1)}
            if max(tail[0][k] - tail[1][k] for k in range(1, 202)) >= quality.LEAST_LIFT:
                for level, share in zip(levels[s], quality.LEVELS):
                    level[rule] = next(k for k in range(1, 202) if tail[1][k] <= share + 1e-12)
    held = {s: {g: [found[i][1] for i, q in labels.items() if q == g and stratum[i] == s and not is_tuning(i)] for g in (0, 1)} for s in range(4)}
    tested = [s for s in range(4) if any(levels[s])]
    while any((1 - risk) ** len(held[s][1]) > error / len(tested) for s in tested):
        tested = [s for s in tested if (1 - risk) ** len(held[s][1]) <= error / len(tested)]
    chosen = {}
    for s in tested:
        gain = 0
        for level in levels[s]:
            out = {g: sum(any(x[r] >= c for r, c in level.items()) for x in held[s][g]) for g in (0, 1)}
            n, m = len(held[s][1]), len(held[s][0])
            if sum(comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(out[1] + 1)) > error / len(tested):
                break
            if m and out[0] / m - out[1] / n > gain + 1e-12:
                chosen[s], gain = level, out[0] / m - out[1] / n
    return {i: {r for r, c in chosen.get(stratum[i], {}).items() if found[i][1][r] >= c} for i in found}, chosen


def test_repeated_documents_count_once_in_the_bound(spark):
    """The same verdicts with every labelled row many times, under its id and as copies under others."""
    good = [(k, f"plain words of a good{k} text that says{k} something a{k} b{k} c{k} " * 3) for k in range(700)]
    bad = [(k, f"### $$$ %%% *** words &&& ||| <<< >>> ### bad text{k} here now it goes on and on to the end") for k in range(700, 780)]
    good[7] = (7, bad[0][1] + " 7")
    labels = [(k, int(k < 700)) for k in range(760)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    once = quality.risk_controlled_cutoffs(quality.measure(documents(spark, good + bad)), frame(labels).selectExpr("doc_id as id", "quality = 1 as good"))
    copies = [(k + 10_000, t) for k, t in good + bad for _ in range(3)]
    more = quality.risk_controlled_cutoffs(
        quality.measure(documents(spark, (good + bad) * 4 + copies + [(3, "zz other text of 3")])), frame(labels * 2 + [(k + 10_000, q) for k, q in labels]).selectExpr("doc_id as id", "quality = 1 as good")
    )
    assert once and more == once
    # Seven good documents stand for themselves only: no number of copies proves a cutoff.
    few = quality.measure(documents(spark, [(k, t) for k, t in good[:7] + bad for _ in range(60)]))
    assert quality.risk_controlled_cutoffs(few, frame(labels).selectExpr("doc_id as id", "quality = 1 as good")) == {}


def test_verdicts_against_plain_python_with_cutoffs_in_all_strata(spark):
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9)))
    docs, labels = [], {}
    for k in range(1600):
        bad, n = k % 8 == 0, rng.choice((30, 80, 300, 1100))
        words = [word() for _ in range(n)]
        if bad or rng.random() < 0.001:
            for _ in range(n // rng.randrange(2, 5)):
                words[rng.randrange(n)] = rng.choice(["###", "$%", "|<>|", "UPPER", "LOUD"])
        docs.append((k, " ".join(words)))
        if k % 16 != 8:
            labels[k] = int(not bad)
    want, chosen = plain_verdicts(docs, labels, 0.03, 0.05)
    assert set(chosen) == {0, 1, 2, 3}
    df = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    got = rows(quality.judge(documents(spark, docs), df), "doc_id")
    for i, t in docs:
        assert set(got[i]["rejected_by"]) == want[i], i
        assert got[i]["kept"] == (not want[i] and not got[i]["base_failed"])
    good = [i for i, q in labels.items() if q]
    assert sum(bool(want[i]) for i in good) <= 0.03 * len(good) and sum(bool(want[i]) for i, _ in docs if i % 8 == 0) > 150


def test_a_very_long_text_of_one_window():
    text = "a b c d e f g h " * 200_000
    assert quality.measure_text(text)[4] == 1_600_000


# tokens


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(token_counts.MODEL))


def test_token_counts(spark):
    tok, docs = library(), table(spark, SF, "documents")
    got = rows(token_counts.count_tokens(docs, limit=300), "doc_id")
    for doc in docs.collect():
        encoded = tok.encode(doc["text"] or "", add_special_tokens=False)
        r = got[doc["doc_id"]]
        assert r["n_tokens"] == len(encoded.ids) and r["n_bytes"] == len((doc["text"] or "").encode())
        assert r["over_limit"] == (r["n_tokens"] > 300)
        end = len(doc["text"][: encoded.offsets[299][1]].encode()) if r["over_limit"] else r["n_bytes"]
        assert r["limit_bytes"] == end


def test_token_counts_of_odd_documents(spark):
    tok = library()
    for r in token_counts.count_tokens(documents(spark, [(k, t) for k, (_, t, *_) in enumerate(ODD)])).collect():
        assert r["n_tokens"] == len(tok.encode(ODD[r["doc_id"]][1] or "", add_special_tokens=False).ids)
    assert not token_counts.count_tokens(documents(spark, [])).count()


def test_every_prefix():
    tok, counter = library(), token_counts.PrefixCounter(public_tokenizers.path(token_counts.MODEL))
    text = "It's  the cats'\n\nwe'll É running<|endoftext|>runs 123 ... ok "
    t = counter.table(text)
    for k in range(len(text) + 1):
        assert counter.tokens_of_prefix(t, len(text[:k].encode())) == len(tok.encode(text[:k], add_special_tokens=False).ids), text[:k]


def test_tables_answer_any_prefix_and_budget(spark):
    tok = library()
    texts = [t for _, t, *_ in ODD if len(t or "") < 1000] + ["Straße ÀÉÎ running, unrelated. 1\u3000 x" + "y" * 90]
    docs = documents(spark, list(enumerate(texts)))
    at = F.explode(F.sequence(F.lit(0), F.length("text"))).alias("k")
    prefix = F.octet_length(F.expr("substring(text, 1, k)"))
    counted = token_counts.count_tokens(docs, tables=True).join(docs.select("doc_id", "text"), "doc_id").select("*", at)
    got = counted.select("doc_id", "k", token_counts.prefix_tokens(prefix).alias("n"), token_counts.budget_bytes(F.col("k")).alias("b")).collect()
    assert len(got) == sum(len(t) + 1 for t in texts if t is not None)
    for r in got:
        text = texts[r["doc_id"]] or ""
        offsets = tok.encode(text, add_special_tokens=False).offsets
        assert r["n"] == len(tok.encode(text[: r["k"]], add_special_tokens=False).ids)
        cut = len(text) if len(offsets) <= r["k"] else offsets[r["k"] - 1][1] if r["k"] else 0
        assert r["b"] == len(text[:cut].encode()), (text, r)


def test_tables_are_built_without_the_library(monkeypatch):
    counter = token_counts.PrefixCounter(public_tokenizers.path(token_counts.MODEL))
    tok = library()
    texts = [r["text"] for r in _sample()] + ["it's they're 'tis o'l don''t rock'n'roll 3.14%% ÀÉÎ straße"]

    def refuse(*_, **__):
        raise AssertionError("the library is asked")

    monkeypatch.setattr(counter, "_library_ends", refuse)
    monkeypatch.setattr(counter, "_library_counts", refuse)
    counter._library_ends = lambda texts: refuse() if texts else []
    for text in texts:
        counts = counter.table(text)[2]
        raw = text.encode()
        ends = counter.token_ends(raw, counter.chunks(raw)).tolist()
        encoded = tok.encode(text, add_special_tokens=False)
        assert ends == [len(text[:b].encode()) for _, b in encoded.offsets]
        for k in range(0, len(text), 1 + len(text) // 60):
            assert counts[len(text[:k].encode())] == len(tok.encode(text[:k], add_special_tokens=False).ids)


def _sample():
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return [r for r in rows if r["text"] and max(r["text"]) < "\u0180"][:60]


def test_pairs_meet_as_the_merges_say():
    import random

    tables = token_counts.PrefixCounter(public_tokenizers.path(token_counts.MODEL)).merges
    rng, every = random.Random(1), sorted(tables.tokens)
    inner = [t for t in every if not t.endswith(token_counts.END)]
    short = [t for t in every if len(t.removesuffix(token_counts.END)) < 4]
    refused = 0
    for k in range(4000):
        a, b = rng.choice(inner), rng.choice(short if k % 2 else every)
        plain = b.removesuffix(token_counts.END)
        want = tables.merged([*a, *plain[:-1], plain[-1] + b[len(plain) :]]) == [a, b]
        assert tables._meet(a, b) == want
        refused += not want
    assert 100 < refused < 3900


def test_small_caches_change_nothing(monkeypatch):
    tok = library()
    for name in ("CACHED_CHUNKS", "CACHED_PREFIXES", "CACHED_PAIRS", "CACHED_INSIDE"):
        monkeypatch.setattr(token_counts, name, 50)
    counter = token_counts.PrefixCounter(public_tokenizers.path(token_counts.MODEL))
    for r in _sample()[:20]:
        assert counter.table(r["text"])[2][-1] == len(tok.encode(r["text"], add_special_tokens=False).ids)


def test_a_tokenizer_that_keeps_white_space(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Hello World  Again\n\nMore TEXT", "", None, " ", "é 　 ﬁ<|endoftext|> x", "a  b   c\n \n d's 123 " * 20]
    got = rows(token_counts.count_tokens(documents(spark, list(enumerate(texts))), model="byte_bpe_50k.json", limit=9, tables=True), "doc_id")
    assert got[0]["n_tokens"] == 8
    for k, text in enumerate(texts):
        encoded = tok.encode(text or "", add_special_tokens=False)
        assert got[k]["n_tokens"] == len(encoded.ids) and got[k]["over_limit"] == (len(encoded.ids) > 9)
        for j in range(len(text or "") + 1):
            assert got[k]["prefix_counts"][len((text or "")[:j].encode())] == len(tok.encode((text or "")[:j], add_special_tokens=False).ids)


# pieces


def test_pieces(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    docs = [(k, t) for k, (_, t, *_) in enumerate(ODD)] + [(100, "  a"), (101, "a  b   "), (102, " "), (103, "\n a b"), (104, LONG[:1000].replace(" ", ""))]
    docs += [(200 + r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = rows(pieces.encode_decode(documents(spark, docs), with_text=True), "doc_id")
    for k, text in docs:
        ids = model.encode(text or "")
        assert got[k]["ids"] == ids and got[k]["n_tokens"] == len(ids)
        assert got[k]["decoded"] == model.decode(ids)
        assert got[k]["ids_sha256"] == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == sha256(model.decode(ids).encode()).hexdigest()
    assert not pieces.encode_decode(documents(spark, [])).count()


# language


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language.classify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def plain_model(sample, landmarks, ridge):
    """The classifier in plain terms: the kernel from sets of n-grams, whitened on the landmarks, ridge regression with classes of equal weight."""
    import numpy as np

    def grams(text):
        signs = [c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text]
        kept = [" "]
        for k, c in enumerate(signs):
            if not (k and c == " " and signs[k - 1] == " "):
                kept.append(c)
        kept.append(" ")
        return {tuple(kept[k : k + n]) for n in (1, 2, 3) for k in range(len(kept) - n + 1)}

    kernel = lambda a, b: len(a & b) / (len(a) * len(b)) ** 0.5
    languages = sorted({lang for lang, _ in sample})
    sets = [grams(t) for _, t in sample]
    marks, taken = [], Counter()
    for s, (lang, _) in zip(sets, sample):
        taken[lang] += 1
        if taken[lang] <= landmarks:
            marks.append(s)
    inner = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(inner)
    keep = values > 1e-8 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    features = np.array([[kernel(a, b) for b in marks] for a in sets]) @ whiten
    count = Counter(lang for lang, _ in sample)
    weight = np.array([1 / count[lang] for lang, _ in sample])[:, None]
    target = np.array([[1 if lang == x else -1 for x in languages] for lang, _ in sample])
    solved = np.linalg.solve(features.T @ (features * weight) + ridge * np.eye(features.shape[1]), features.T @ (target * weight))
    score = lambda text: (np.array([kernel(grams(text), b) for b in marks]) @ whiten) @ solved
    return languages, score


def test_scores_against_the_plain_kernel(spark):
    import numpy as np

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    held_apart = docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    drawn = language.labelled_sample(held_apart, "doc_id", "text", "lang", 12)
    texts = {language._codes(r["text"]).tobytes(): r["text"] for r in held_apart.collect() if r["text"]}
    sample = [(lang, texts[codes.tobytes()]) for lang, codes in drawn]  # whole texts, however long
    assert {lang for lang, _ in sample} == {r["lang"] for r in docs.where("lang is not null").select("lang").distinct().collect()}
    model, (languages, score) = language.fit(sample, 5), plain_model(sample, 5, language.RIDGE)
    texts = [r["text"] for r in docs.limit(40).collect() if r["text"]] + ["ΑΣ Σ x\x1cy", "İi ǅ", "日本語 テキスト"]
    got = model.scores(texts)
    assert model.languages == languages
    for text, row in zip(texts, got):
        assert np.allclose(row, score(text), atol=2e-4)
    small = language.BLOCK
    try:
        language.BLOCK = 7
        assert np.allclose(language.fit(sample, 5).scores(texts), got, atol=2e-4)
    finally:
        language.BLOCK = small


def test_many_scripts_and_languages_are_told_apart(spark):
    """Each language has letters of its own; one is labelled on very long texts only."""
    letters = [chr(p) for first in (0x4E00, 0xAC00) for p in range(first, first + 5 * 125)]
    texts = {f"l{k:03}": letters[5 * k : 5 * k + 5] for k in range(250)}
    docs = []
    for name, own in texts.items():
        for k in range(6):
            word = "".join(own[(j * (k + 1)) % 5] for j in range(5))
            text = f"{word} {own[k % 5]}{own[(k + 2) % 5]} {word[::-1]} "
            docs.append((len(docs), text * (3000 if name == "l007" else 1), name))
    got = language.classify(documents(spark, docs)).collect()
    assert all(r["lang_pred"] == docs[r["doc_id"]][2] for r in got)


def test_odd_languages(spark):
    got = language.classify(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert {by[k][0]["lang_pred"] for k in (1, 2, 3, 13)} == {"und"}
    assert by[5][0]["lang_pred"] in {"en", "fr", "de", "el"}
    assert not language.classify(documents(spark, [])).count()
    assert language.classify(documents(spark, [(1, "no label here")])).first()["lang_pred"] == "und"

"""Operators over whole tables, and the pipeline, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tests.llm.data import ODD, SF, documents
from vintara.llm import common, components, exact_dedup, language, mixing, simhash, url_filter, warc
from vintara.llm.common import table

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# exact dedup


def equal_groups(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[(t or "").translate(ASCII)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            out.append((i, keep, len(ids), i == keep and not kept, sha256(text.encode()).hexdigest()))
            kept |= i == keep
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"block_chars": 7, "head_chars": 3}])
def test_exact_dedup(spark, options):
    rng = random.Random(5)
    docs = [(i, t) for i, t, *_ in ODD] + [(100 + k, "abc" + "".join(rng.choice("aB") for _ in range(rng.randrange(12)))) for k in range(200)]
    if options:  # one level per doubling of seven characters
        docs = [x for x in docs if len(x[1] or "") < 1000]
    docs += [(400 + k, "same beginning " * 10 + str(k % 7) * 30 + "same end" * (k % 3)) for k in range(60)]
    got = sorted(map(tuple, exact_dedup.exact_dedup(documents(spark, docs), **options).collect()), key=str)
    assert got == equal_groups(docs)
    kept = sorted([(r["doc_id"], r["text"]) for r in exact_dedup.keep_one_of_equals(documents(spark, docs)).collect()], key=str)
    assert [k[0] for k in kept] == sorted([g[0] for g in equal_groups(docs) if g[3]], key=str)
    assert not exact_dedup.exact_dedup(documents(spark, [])).count()


def test_names_are_the_same_on_every_run(spark):
    rows = [(f"block {k % 900}", k % 7) for k in range(3000)]
    df = spark.createDataFrame(rows, "l string, r int")
    first = {(r["l"], r["r"]): r["name"] for r in exact_dedup._named(df, "t").collect()}
    assert sorted(first.values()) == list(range(1, len(set(rows)) + 1)) and set(first) == set(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        again = exact_dedup._named(df.repartition(5).orderBy("r"), "t")
        assert {(r["l"], r["r"]): r["name"] for r in again.collect()} == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# near duplicates


def plain_fingerprint(text):
    ws = words((text or "").translate(ASCII))
    shingles = [" ".join(ws[k : k + 4]) for k in range(len(ws) - 3)] or ([" ".join(ws)] if ws else [])
    hs = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints):
    """prints: (id, fingerprint) with ids; smallest id by id."""
    parent = {f: f for _, f in prints}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    distinct = sorted(parent)
    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for i, f in prints:
        least[root(f)].append(i)
    return {f: min(least[root(f)]) for f in distinct}


def test_every_near_pair_meets():
    rng, masks = random.Random(6), simhash.masks()
    assert len(masks) == 31
    for _ in range(3000):
        change = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
        assert any(not change & m for m in masks)


def test_near_duplicates_of_the_table(spark):
    docs = table(spark, SF, "documents")
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    want = plain_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{f:016x}", want[f]) for i, f in prints}
    assert len(set(want.values())) < len(want)


def test_links_in_large_groups(spark):
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(200)}
    center = rng.getrandbits(64)
    for _ in range(3000):  # one dense cloud, and a chain that leaves it
        prints.add(center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    x = center
    for k in range(0, 40, 4):
        x ^= 0b1111 << k
        prints.add(x)
    want = plain_components([(f, f) for f in prints])
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in prints], "fp long")
    links = simhash.near_links(df)
    rows = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in rows)
    found = {r["node"] % (1 << 64): r["component"] for r in components.components(links).collect()}
    groups = defaultdict(set)
    for f in prints:
        groups[want[f]].add(found.get(f, signed(f)))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_path(spark):
    nodes = list(range(60))
    random.Random(8).shuffle(nodes)
    df = spark.createDataFrame(list(zip(nodes, nodes[1:])) + [(100, 101), (100, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == {**{k: 0 for k in range(60)}, 100: 100, 101: 100}


def test_odd_near_duplicates(spark):
    got = simhash.near_duplicates(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == "0" * 16 and by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[10]["component_id"] == by[8]["component_id"] == 8
    assert not simhash.near_duplicates(documents(spark, [])).count()
    kept = [r["doc_id"] for r in simhash.keep_representatives(documents(spark, ODD)).collect()]
    assert len(kept) == len(set(kept)) and 8 in kept and 10 not in kept and 1 in kept


def test_unrelated_texts_with_null_or_repeated_ids_stay(spark):
    texts = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(40)]
    docs = [(None, t) for t in texts[:20]] + [(7, t) for t in texts[20:]]
    near = [(None, texts[0].upper()), (7, texts[1]), (7, texts[1]), (3, texts[30])]
    kept = simhash.keep_representatives(documents(spark, docs + near)).collect()
    assert sorted(r["text"].lower() for r in kept) == sorted(texts)
    ids = {r["text"].lower(): r["doc_id"] for r in kept}
    assert ids[texts[0]] is None and ids[texts[1]] == 7 and ids[texts[30]] == 3 and ids[texts[31]] == 7


# mixing


def plain_mix(docs):
    sizes = Counter()
    for _, t, s in docs:
        sizes[s] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / (sum(weight[s] for s in free) or 1)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else level * weight[s] for s in order}, sizes
        capped |= over


def test_targets_and_taken(spark):
    docs = [(i, t, s) for i, t, _, s in [(*r, *(None,) * (4 - len(r))) for r in ODD]] + [(50 + k, "one two three four " * (k % 9), f"s{k % 5}") for k in range(300)]
    got = mixing.mix(documents(spark, [(i, t, None, s) for i, t, s in docs])).collect()
    assert len(got) == len(docs)
    targets, sizes = plain_mix(docs)
    source = {}
    for i, t, s in docs:
        source.setdefault((i, len(words(t))), s)
    taken = Counter()
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0) and (r["position"] is None or 0 <= r["position"] <= 1)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in targets)
    positions = [r["position"] for r in got if r["position"] is not None]
    assert positions == sorted(positions)
    assert not mixing.mix(documents(spark, [])).count()


def test_order_within_a_source(spark):
    docs = [(k, "w " * (1 + k % 4), None, "s") for k in range(100)]
    got = [r["doc_id"] for r in mixing.mix(documents(spark, docs)).collect()]
    text = lambda k: "w " * (1 + k % 4)
    digest = lambda k: md5(f"{k}:{md5(text(k).encode()).hexdigest()}".encode()).hexdigest()
    assert got == sorted(range(100), key=digest)
    few = mixing.mix(documents(spark, docs), bucket_rows=2).collect()
    assert [r["doc_id"] for r in few] == got


def test_stream(spark):
    docs = [(k, f" a{k}  b\tc\nd ", None, s) for k, s in enumerate("aab" + "c" * 40)] + [(90, "", None, "a"), (91, None, None, None)]
    decided = {r["doc_id"]: r for r in mixing.mix(documents(spark, docs)).collect()}
    stream = mixing.training_stream(documents(spark, docs))
    assert stream.columns == documents(spark, docs).columns
    text = {d[0]: d[1] for d in docs}
    got = Counter()
    for r in stream.collect():
        assert r["text"] == text[r["doc_id"]]
        got[r["doc_id"]] += 1
    for i, r in decided.items():
        assert got[i] == (int(r["taken"] / r["size"] + 0.5) if r["size"] else 0)


def test_null_and_repeated_ids_are_mixed_apart(spark):
    docs = [(None, f"text number {k} of a null id", None, "a") for k in range(60)] + [(1, f"other text {k} of one id", None, "b") for k in range(60)]
    decided = mixing.mix(documents(spark, docs), bucket_rows=5).collect()
    assert len(decided) == 120 and len({r["position"] for r in decided if r["doc_id"] is None}) > 30
    targets, _ = plain_mix([(i, t, s) for i, t, _, s in docs])
    got = Counter(r["text"] for r in mixing.training_stream(documents(spark, docs)).collect())
    for s, size in (("a", 7), ("b", 6)):
        uses = sum(n for t, n in got.items() if (t.startswith("text")) == (s == "a"))
        assert abs(uses * size - targets[s]) <= size
    assert not mixing.training_stream(documents(spark, [])).count()


@pytest.mark.parametrize("repeat", ["over sources", "within a source", "all in one source"])
def test_repeated_rows_have_uses_of_their_own(spark, tmp_path, repeat):
    """Each source within half a document of its target, whatever rows repeat."""
    text = lambda k: f"word{k} " * 100
    docs = [(k, text(k), None, "a" if k < 10 else "b") for k in range(20)]
    if repeat == "over sources":
        docs += [(50, text(50), None, "a"), (50, text(50), None, "b")]
    elif repeat == "within a source":
        docs += [(5, text(5), None, "a")] * 6 + [(15, text(15), None, "b")] * 2
    else:
        docs = [(1, text(1), None, "a")] * 9 + [(1, text(1), None, "b")] * 30
    targets, _ = plain_mix([(i, t, s) for i, t, _, s in docs])
    got = Counter(r["source"] for r in mixing.training_stream(documents(spark, docs)).collect())
    for s in ("a", "b"):
        assert abs(100 * got[s] - targets[s]) <= 50, (s, got, targets)
    # Of files, rows are told apart by their places there; a column may have the name of what says so.
    documents(spark, docs).withColumn("_metadata", F.lit("x")).repartition(3).write.parquet(str(tmp_path / "docs"))
    files = mixing.training_stream(spark.read.parquet(str(tmp_path / "docs")))
    assert Counter(r["source"] for r in files.collect()) == got and "_metadata" in files.columns


# Stages keep their rows and columns, whatever these are called


INNER = "row id sha kept_id kept_sha k number own digest m use position uses source size start quota schedule taken target bucket s b n t l r i c name fp least component component_id key head table lang of d text_sha256 keep_id _lang_pred _score _id _sha _own _k _use _position x left".split()
STAGES = [language.keep_identified, exact_dedup.keep_one_of_equals, simhash.keep_representatives, mixing.training_stream]


@pytest.mark.parametrize("stage", STAGES, ids=lambda s: s.__name__)
def test_any_column_names(spark, stage):
    rows = [(k, "ein wort und noch ein wort " * 3 if k % 2 else f"one two three four number {k} and so on", "de" if k % 2 else "en", "a") for k in range(30)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = [n for n in INNER if n not in plain.columns]
    clashing = plain.select("*", *[F.lit(n).alias(n) for n in extra], F.lit(1).alias("a.b"), F.array(F.lit(1)).alias("list"))
    want = sorted((tuple(r) for r in stage(plain).collect()), key=str)
    got = stage(clashing)
    assert got.columns == clashing.columns
    found = got.collect()
    assert sorted((tuple(r)[:4] for r in found), key=str) == want and want
    assert all(tuple(r)[4:] == (*extra, 1, [1]) for r in found)


@pytest.mark.parametrize("stage", STAGES, ids=lambda s: s.__name__)
def test_stages_on_odd_tables(spark, stage):
    assert not stage(documents(spark, [])).count()
    nulls = stage(documents(spark, [(None, None), (None, None), (None, "a text here"), (None, "another text there")])).collect()
    assert {r["text"] for r in nulls} <= {None, "a text here", "another text there"}
    if stage in (exact_dedup.keep_one_of_equals, simhash.keep_representatives):
        assert sorted(str(r["text"]) for r in nulls) == ["None", "a text here", "another text there"]
    same = stage(documents(spark, [(7, f"text of one id {'abc'[k % 3] * 9} {k % 3} and more words", "en", "a") for k in range(6)])).collect()
    assert len(same) == (3 if stage in (exact_dedup.keep_one_of_equals, simhash.keep_representatives) else 6)


def test_a_shared_folder_is_asked_for(spark, monkeypatch):
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda *_: None)
    far = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(far)
    far.sparkContext.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(far)


# URLs

URLS = [
    ("http://example.com/en/x", "example.com", "/en/x", "example.com/en/", "block"),
    ("https://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://other.com/en/", "other.com", "/en/", "com/", "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net/de/1", "x.net", "/de/1", None, "block"),
    ("http://www.x.net/de/1/?utm_source=a", "www.x.net", "/de/1/", None, "block"),
    ("http://www.x.net/de/1/?page=2", "www.x.net", "/de/1/", None, "allow"),
    ("http://x.net/de/12", "x.net", "/de/12", None, "allow"),
    ("http://notcom/es/", "notcom", "/es/", None, "allow"),
    ("HTTP://É.Org?x=://y", "É.org", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, (u, *_) in enumerate(URLS)] + [(None, "http://x.net/de/1", "x", "y")], "page_id long, url string, host string, word string")
    listed = spark.createDataFrame([("https://x.net/de/1",), (None,), ("",), ("https://www.x.net/de/1/#top",)], "url string")
    got = url_filter.filter_urls(pages, listed).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == URLS[r["page_id"]][1:]
    assert not url_filter.filter_urls(pages.where("false"), listed).count()
    assert url_filter.filter_urls(pages, listed.where("false")).where("verdict = 'block'").count() == 2


CANONICAL = {
    "https://user:pw@WWW.Example.org:443/a/./b/../c//?b=2&utm_source=x&a=1#top": "example.org/a/c?a=1&b=2",
    "http://example.org:80/a/c?a=1&b=2": "example.org/a/c?a=1&b=2",
    "http://example.org./a%2fb%e9?gclid=1": "example.org/a%2Fb%E9",
    "http://example.org/a%2Fb%E9/": "example.org/a%2Fb%E9",
    "http://example.org/?page=2": "example.org?page=2",
    "http://example.org/../..": "example.org",
    "http://example.org:8080": "example.org:8080",
    "http://www.:80/": "www",
    "http://example.org/x?id=1": "example.org/x?id=1",
    "http://example.org/x?id=2": "example.org/x?id=2",
    "http://example.org/x?utm_medium=a&&utm_x": "example.org/x",
    "ftp://h/100%/%zz?%": "h/100%/%zz?%",
    "no scheme": None,
    "": None,
    None: None,
}


def test_canonical_urls(spark):
    import duckdb

    df = spark.createDataFrame([(k, u) for k, u in enumerate(CANONICAL)], "page_id long, url string")
    got = [r["c"] for r in df.select("page_id", url_filter.canonical(F.col("url")).alias("c")).orderBy("page_id").collect()]
    assert got == [c if c != "" else None for c in CANONICAL.values()]
    pages = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("pages", pages)
    keys = con.execute(url_filter.SQL.partition(",\nlisted AS")[0] + " SELECT key FROM keys ORDER BY page_id").fetchall()
    assert [k[0] for k in keys] == got


def test_false_positives_are_removed(spark):
    pages = spark.range(20000).selectExpr("id as page_id", "concat('http://h.org/', id) as url")
    got = url_filter.filter_urls(pages, pages.where("page_id % 10 = 0").select("url"), max_words=1)
    assert {r["page_id"] for r in got.where("verdict = 'block'").collect()} == set(range(0, 20000, 10))


# WARC


def test_records_are_owned_once():
    rng = random.Random(9)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(2000))) for _ in range(60)] + [warc.MAGIC * 50, b"WARC/1.1\r\n" + warc.MAGIC]
    members = [warc.record(k, "http://x/ y\r\nz", p, None) for k, p in enumerate(payloads)]
    data = b"".join(members)
    from io import BytesIO

    for size in (1, 100, 3000, len(data)):
        got = []
        for start in range(0, len(data), size):
            got += [warc.parse(r) for r in warc.records_in(BytesIO(data), start, min(start + size, len(data)), len(data), ahead=512)]
        assert [(g[0], g[6]) for g in got] == [(f"{warc._ID}{k}", p) for k, p in enumerate(payloads)]
    with pytest.raises(EOFError):
        list(warc.records_in(BytesIO(data[:-5]), 0, len(data) - 5, len(data) - 5))


def test_round_trip(spark):
    pages = [(k, f"http://x/{k}", h) for k, h in enumerate([None, "", "a", "a", "b" * 5000, "c", "a", "b" * 5000, "é"])] + [(3, "u", "a"), (None, None, "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as sha", "'y' as keep", "1 as path")
    largest = {}
    for i, _, h in pages:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        same = i == largest[h or ""]
        want.append((i, len(raw), warc.payload_digest(raw), "response" if same else "revisit", None if same else largest[h or ""]))
    assert sorted(map(tuple, warc.archive_round_trip(df, range_bytes=64).collect()), key=str) == sorted(want, key=str)
    few = warc.archive_round_trip(df, min_revisit=2).collect()
    assert Counter(r["record_type"] for r in few) == {"response": 10, "revisit": 1}
    assert not warc.archive_round_trip(df.where("false")).count()


@pytest.mark.parametrize("range_bytes", [3000, 20_000, 1 << 22])
def test_an_archive_inside_a_payload_is_no_record(spark, tmp_path, range_bytes):
    """The inner archive is longer than several ranges, and its bytes stand in the outer one as they are."""
    rng = random.Random(12)
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    inner = b"".join(warc.record(900 + k, "http://inner/", noise(2500), None) for k in range(30))
    outer = [warc.record(1, "http://a/", noise(5000), None), warc.record(2, "http://b/", inner, None), warc.record(3, "http://c/", noise(5000), None), warc.record(4, "http://d/", b"end", None)]
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)  # not packed: the inner members stand as they are
    outer[1] = stored.compress(zlib.decompress(outer[1], 31)) + stored.flush()
    data = b"".join(outer)
    assert data.count(warc.MAGIC) >= 30
    (tmp_path / "x.warc.gz").write_bytes(data)
    manifest = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", len(data))], "path string, bytes long")
    got = warc.read_archives(manifest, range_bytes).collect()
    assert sorted(r["record_id"] for r in got) == [f"{warc._ID}{k}" for k in (1, 2, 3, 4)]
    assert {r["record_id"]: bytes(r["payload"]) for r in got}[f"{warc._ID}2"] == inner
    (tmp_path / "cut.warc.gz").write_bytes(data[:-7])
    cut = spark.createDataFrame([(f"file://{tmp_path}/cut.warc.gz", len(data) - 7)], "path string, bytes long")
    with pytest.raises(Exception, match="cut off"):
        warc.read_archives(cut, range_bytes).collect()


def test_headers_of_a_record():
    whole = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert warc.headers(whole)[1] == len(whole) - 7
    for field in (b"WARC-Type: response\r\n", b"WARC-Record-ID: <x>\r\n", b"Content-Length: 3\r\n", b"WARC/1.1"):
        assert warc.headers(whole.replace(field, b"")) is None


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append(docs.collect())
    start, spoken, single, apart, stream, encoded = seen
    assert {r["doc_id"] for r in start} - {r["doc_id"] for r in spoken} <= {r["doc_id"] for r in start if not re.search(r"[^\W\d_]{2}", r["text"] or "")}
    want = {i for i, _, _, kept, _ in equal_groups([(r["doc_id"], r["text"]) for r in spoken]) if kept}
    assert sorted(r["doc_id"] for r in single) == sorted(want)
    prints = [(r["doc_id"], plain_fingerprint(r["text"])) for r in single]
    assert sorted(r["doc_id"] for r in apart) == sorted(set(plain_components(prints).values()))
    targets, _ = plain_mix([(r["doc_id"], r["text"], r["source"]) for r in apart])
    taken, longest = Counter(), Counter()
    for r in apart:
        longest[r["source"]] = max(longest[r["source"]], len(words(r["text"])))
    for r in stream:
        taken[r["source"]] += len(words(r["text"]))
    assert all(abs(taken[s] - targets[s]) <= longest[s] / 2 + 1 for s in targets)
    assert {(r["doc_id"], r["text"]) for r in stream} <= {(r["doc_id"], r["text"]) for r in apart}
    assert Counter(r["doc_id"] for r in encoded) == Counter(r["doc_id"] for r in stream)
    assert corpus_pipeline.run(spark, SF).count() == len(encoded)

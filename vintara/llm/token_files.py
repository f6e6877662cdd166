"""Token ids of documents in binary files, in ascending order of the documents' ids, and reading them back.

Documents are dealt into ranges of their ids; a task encodes a range and writes one file:

    magic, blocks of ids (Simple-8b with escapes, see :mod:`simple8b`), index, documents, footer

The index says for each block where its bytes begin and how many words and escapes it has; as a block has a fixed number of
ids, any range of ids is decoded alone, many blocks at once. The documents are rows (id, whether it is null, end): the
number of ids up to the document's end. The footer says where these begin.

The manifest, written once, has rows (path, part, first_doc, n_docs, first_id, n_ids): stretches of a file that one reading
task takes. Files of failed or repeated attempts are in no manifest and are never read. A document's start in the whole
corpus is its start in the file and the ids of all files before, which are summed up over the manifest.

Ids are those of the library. Where the tokenizer cuts at white space, a Python worker keeps a table of the distinct chunks
that it has met in all its tasks, so that the library encodes new ones only; else texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, count
from operator import not_

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simple8b
from .common import filesystem, materialize, partitions, shared_dir, totals_before
from .token_counts import END, _is_covered, byte_signs

MODEL = "word_bpe_49k.json"
END_ID = 2
MAGIC = b"VTOKENS1"
DOCS = np.dtype([("id", "<i8"), ("null", "u1"), ("end", "<u8")])
FOOTER = np.dtype([("ids", "<u8"), ("blocks", "<u8"), ("docs", "<u8"), ("index_at", "<u8"), ("docs_at", "<u8"), ("magic", "S8")])
#: Ids that are coded together, and ids of a stretch that one reading task decodes; both are multiples of a block.
PIECE, STRETCH = 1024 * simple8b.BLOCK, 2048 * simple8b.BLOCK
#: Chunks kept by a Python worker, none longer than this many bytes; chunks of letters encoded together; texts looked at together.
KEPT_CHUNKS, KEPT_BYTES, TOGETHER, TEXTS = 2_000_000, 64, 256, 512
#: Latin letters come before this character. Marks of ASCII that stand behind words; runs of them are one part.
LATIN, MARKS = 0x180, b".,;:!?)"
MANIFEST = "path string, part int, first_doc long, n_docs long, first_id long, n_ids long"


class IdTable:
    """Texts to their ids, as consecutive little-endian unsigned 32-bit integers.

    A chunk of Latin letters is one part of the text, and so is a run of marks behind it. Such parts are lower-cased and spelled in
    the vocabulary's signs here, so that the library need only merge: it gets many words at once, without its own normalising and
    cutting. Each has one token that ends a part, at which the ids are cut again. All other chunks go to the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        setup = json.loads(self.tokenizer.to_str())
        self.separate = _is_covered(setup)
        vocabulary = self.tokenizer.get_vocab(True)
        self.ends_part = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_part[[k for t, k in vocabulary.items() if t.endswith(END)]] = True
        self.known: dict[bytes, bytes] = {}
        if self.separate:
            self.merges = Tokenizer.from_str(json.dumps(setup | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}))
            self.signs = dict(enumerate(byte_signs())) | {0x20: " "}
            letters = [c for c in map(chr, range(0x41, LATIN)) if c.isalpha() and len(c.lower()) == 1]
            probe = [f"{a}{b}" for a, b in zip(letters, letters[5:])]
            same = [self._encoded([t])[0] for t in letters] + self._encoded(probe) == [x for _, x in self._letters([t.encode() for t in letters + probe])]
            self.latin = frozenset(letters) if same else frozenset()

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _letters(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words of Latin letters with their ids."""
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            spelled = b" ".join(some).decode().lower().encode().decode("latin-1").translate(self.signs)
            ids = np.array(self.merges.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, "<u4")
            raw, cuts = ids.tobytes(), 4 * (np.flatnonzero(self.ends_part[ids]) + 1)
            cuts = [0, *cuts.tolist()]
            yield from zip(some, [raw[a:b] for a, b in zip(cuts, cuts[1:])], strict=True)

    def _learn(self, new: set[bytes]) -> None:
        known, latin = self.known, self.latin.issuperset
        words = [c for c in new if c.isalpha()]
        stems, marked, others = set(), [], []
        for c in new.difference(words):
            w = c.rstrip(MARKS)
            if not w or not (w.isalpha() or latin(w.decode())):
                others.append(c)
            elif w is c:
                words.append(c)
            else:
                marked.append((c, w))
                stems.add(w)
        known.update(self._letters([*words, *[w for w in stems if w not in known and w not in new]]))
        others += {c[len(w) :] for c, w in marked}.difference(known, others)
        known.update(zip(others, self._encoded([c.decode() for c in others])))
        for c, w in marked:
            known[c] = known[w] + known[c[len(w) :]]

    def encode(self, raws: list[bytes]) -> list[bytes]:
        if not self.separate:
            return self._encoded([r.decode() for r in raws])
        if len(self.known) > KEPT_CHUNKS:
            self.known.clear()
        texts = [r.split() for r in raws]
        found = [list(map(self.known.get, chunks)) for chunks in texts]
        new = set().union(*[compress(chunks, map(not_, ids)) for chunks, ids in zip(texts, found)])
        self._learn(new)
        out = []
        for chunks, ids in zip(texts, found):
            for k in compress(count(), map(not_, ids)):
                ids[k] = self.known[chunks[k]]
            out.append(b"".join(ids))
        for c in [c for c in new if len(c) > KEPT_BYTES]:
            del self.known[c]
        return out


@lru_cache(1)
def _table(path: str) -> IdTable:
    """One per Python worker, which keeps it over the tasks that it runs."""
    return IdTable(path)


class Writer:
    """One file: ids go out piece by piece, the documents' table is kept until the end."""

    def __init__(self, path: str):
        system, at = filesystem(path)
        system.create_dir(at.rpartition("/")[0], recursive=True)
        self.path, self.out = path, system.open_output_stream(at, compression=None)
        self.out.write(MAGIC)
        self.at, self.n_ids, self.waiting, self.waits = len(MAGIC), 0, [], 0
        self.index: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []

    def add(self, doc_ids: list[int | None], ids: list[bytes]) -> None:
        rows = np.zeros(len(ids), DOCS)
        rows["id"] = [i or 0 for i in doc_ids]
        rows["null"] = [i is None for i in doc_ids]
        rows["end"] = self.n_ids + np.cumsum([len(x) // 4 for x in ids])
        self.docs.append(rows)
        self.n_ids = int(rows["end"][-1])
        self.waiting += ids
        self.waits += sum(map(len, ids)) // 4
        if self.waits >= PIECE:
            self._flush(self.waits // PIECE * PIECE)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        for at in range(0, n, PIECE):
            data, index = simple8b.encode(ids[at : min(at + PIECE, n)], self.at)
            self.out.write(data)
            self.at += len(data)
            self.index.append(index)
        self.waiting, self.waits = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> np.ndarray:
        """Write what is left and the tables; the documents' table."""
        self._flush(self.waits)
        index, docs = np.concatenate([np.zeros(0, simple8b.INDEX), *self.index]), np.concatenate([np.zeros(0, DOCS), *self.docs])
        footer = np.array([(self.n_ids, len(index), len(docs), self.at, self.at + index.nbytes, MAGIC)], FOOTER)
        for table in (index, docs, footer):
            self.out.write(table.tobytes())
        self.out.close()
        return docs


def _stretches(ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Cut documents with these ends into (first_doc, n_docs, first_id, n_ids) of about STRETCH ids each, a document whole."""
    first = 0
    while first < len(ends):
        begin = int(ends[first - 1]) if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, begin + STRETCH, "right")))
        yield first, stop - first, begin, int(ends[stop - 1]) - begin
        first = stop


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all texts, each followed by ``end_id``, to files below ``folder`` (shared); the manifest.

    File by file documents stand in ascending order of ids, which are integers; null comes first, rows that repeat an id are in
    order of a digest of their texts. So many rows with one id are dealt into several ranges like any others.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} is not a column of integers")
    path = public_tokenizers.path(model)
    end = int(end_id).to_bytes(4, "little")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, writer, part = _table(path), None, TaskContext.get().partitionId()
        for batch in batches:
            if writer is None and len(batch):
                writer = Writer(f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tokens")
            for at in range(0, len(batch), TEXTS):
                some = batch.slice(at, TEXTS)
                raws = [r or b"" for r in some.column("text").cast(pa.binary()).to_pylist()]
                writer.add(some.column("id").to_pylist(), [x + end for x in table.encode(raws)])
        if writer is not None:
            rows = [(writer.path, part, *r) for r in _stretches(writer.close()["end"].astype(np.int64))]
            kinds = (pa.string(), pa.int32(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in MANIFEST.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("place")]
    rows = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(rows.select("id", "text").mapInArrow(written, MANIFEST), "tokens")


def _read(f, at: int, kind: np.dtype, n: int) -> np.ndarray:
    f.seek(at)
    return np.frombuffer(f.read(n * kind.itemsize), kind)


def read_stretch(path: str, first_doc: int, n_docs: int, first_id: int, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of DOCS and the ids of these documents."""
    system, at = filesystem(path)
    with system.open_input_file(at) as f:
        footer = _read(f, f.size() - FOOTER.itemsize, FOOTER, 1)[0]
        if footer["magic"] != MAGIC:
            raise ValueError(f"{path} is no file of tokens")
        docs = _read(f, int(footer["docs_at"]) + first_doc * DOCS.itemsize, DOCS, n_docs)
        ids, size = np.zeros(n_ids, "<u4"), simple8b.BLOCK
        for begin in range(first_id // size * size, first_id + n_ids, PIECE):
            stop = min(begin + PIECE, first_id + n_ids)
            first, last = begin // size, -(-stop // size)
            index = _read(f, int(footer["index_at"]) + first * simple8b.INDEX.itemsize, simple8b.INDEX, last - first)
            tail = index[-1]
            n_bytes = int(tail["at"] + 8 * np.uint64(tail["words"]) + np.uint64(tail["escapes"]) * np.uint64(tail["escape_bytes"]) - index[0]["at"])
            f.seek(int(index[0]["at"]))
            lengths = np.minimum(size, int(footer["ids"]) - size * np.arange(first, last))
            found = simple8b.decode(f.read(n_bytes), index, lengths)
            a, b = max(begin, first_id), stop
            ids[a - first_id : b - first_id] = found[a - begin : b - begin]
    return docs, ids


def read_tokens(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per document of the files: the id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers)."""
    spark = manifest.sparkSession
    before = totals_before(manifest.groupBy("part").agg(F.sum("n_ids").alias("n")), "part", "n")
    rows = manifest.join(before, "part").select("path", "first_doc", "n_docs", "first_id", "n_ids", "before")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *stretch, before in zip(*(c.to_pylist() for c in batch.columns)):
                docs, ids = read_stretch(*stretch)
                ends = docs["end"].astype(np.int64) - stretch[3]
                starts = np.concatenate(([0], ends[:-1]))
                raw = memoryview(ids.tobytes())
                for at in range(0, len(docs), TEXTS):
                    some = slice(at, at + TEXTS)
                    parts = [bytes(raw[4 * a : 4 * b]) for a, b in zip(starts[some].tolist(), ends[some].tolist())]
                    columns = [
                        pa.array(docs["id"][some], pa.int64(), mask=docs["null"][some] == 1),
                        pa.array(before + stretch[3] + starts[some], pa.int64()),
                        pa.array((ends - starts)[some], pa.int64()),
                        pa.array(parts, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "start", "n_tokens", "ids"])

    spread = rows.repartition(4 * partitions(spark), "path", "first_doc")
    return spread.mapInArrow(read, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def token_round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all texts and read them back: the rows of :func:`read_tokens`, one per row of ``docs``.

    A null or empty text has the end id alone. Null ids come first; rows that repeat an id are documents of their own, next to each
    other. Very long texts are single rows of a file. Other columns are ignored; an empty table gives no files and no rows.
    """
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex[:12]}"
    return read_tokens(write_tokens(docs, folder, id_col, text_col, model, end_id), id_col)

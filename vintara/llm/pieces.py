"""SentencePiece encoding and decoding with a table of distinct marked words.

The model marks a space as U+2581. None of its pieces has a mark after another character, so no piece crosses from one
marked word (marks, then other characters) into the next, and each marked word is segmented on its own. A Python worker
keeps a table of the distinct marked words that it has met in all its tasks, with their ids and their decoded text; a
document is its marked words' entries joined by position. Models whose pieces do cross are encoded and decoded text by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Marked words kept by a worker: at most so many, none longer than this many characters.
KEPT_WORDS, KEPT_CHARS = 500_000, 64
_MARKED = re.compile(" +[^ ]*")


class WordTable:
    """Marked word to (number of ids, ids joined by commas, decoded text)."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(k) for k in range(self.model.get_piece_size()))
        # A leading mark is added and spaces are kept as they stand, as two encodings show.
        plain = self.model.encode("a  a ", out_type=str)
        self.separate = not any(MARK in p.lstrip(MARK) for p in pieces) and "".join(plain) == f"{MARK}a{MARK * 2}a{MARK}"
        self.words: dict[str, tuple[int, str, str]] = {}

    def _entry(self, word: str) -> tuple[int, str, str]:
        """word starts with a space, which stands for the mark that the model puts first."""
        ids = self.model.encode(word[1:]) if len(word) > 1 else [self.model.piece_to_id(MARK)]
        entry = len(ids), ",".join(map(str, ids)), word[0] + self.model.decode(ids)
        if len(word) <= KEPT_CHARS:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = entry
        return entry

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids joined by commas, and decode(ids)."""
        if not text:
            return 0, "", self.model.decode([])
        if not self.separate:
            ids = self.model.encode(text)
            return len(ids), ",".join(map(str, ids)), self.model.decode(ids)
        known = self.words.get
        found = [known(w) or self._entry(w) for w in _MARKED.findall(" " + text.replace(MARK, " "))]
        return sum(e[0] for e in found), ",".join([e[1] for e in found]), "".join([e[2] for e in found])[1:]


@lru_cache(1)
def _table(path: str) -> WordTable:
    """One per Python worker, which keeps it over the tasks that it runs."""
    return WordTable(path)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, n_tokens, ids_sha256, decoded_sha256; with_text adds ids and decoded.

    Ids and decoded text are those of the sentencepiece library for the whole text, without begin or end ids. Null
    counts as empty: no ids, empty text. Rows that repeat are encoded each; other columns are ignored; an empty table
    gives no rows.
    """
    path = public_tokenizers.path(model)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _table(path)
        for batch in batches:
            n, ids, texts, id_sums, text_sums = [], [], [], [], []
            for value in batch.column("text"):
                count, joined, decoded = words.encode(value.as_py() or "")
                n.append(count)
                id_sums.append(sha256(joined.encode()).hexdigest())
                text_sums.append(sha256(decoded.encode()).hexdigest())
                if with_text:
                    ids.append([int(x) for x in joined.split(",")] if joined else [])
                    texts.append(decoded)
            columns = {"id": batch.column("id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(id_sums, pa.string()), "decoded_sha256": pa.array(text_sums, pa.string())}
            if with_text:
                columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_text else ""
    out = rows.mapInArrow(encoded, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumnRenamed("id", id_col)

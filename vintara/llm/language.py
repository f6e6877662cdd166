"""Language identification with a string kernel.

The kernel of two texts counts the n-grams (n = 1, 2, 3 together: the blended spectrum) that both contain, presence
only, divided by the geometric mean of the two texts' own numbers of n-grams. A bounded sample of labelled texts is drawn
per language; some of it serve as Nyström landmarks, and a ridge regression per language, one against the rest, is fitted
on the landmark kernels. To score a text only the landmarks' n-grams matter, and
a batch of texts is one matrix product with (landmark presence x coefficients), a table of n-grams by languages.

Letters are folded to lower case and everything that is no letter is one boundary sign. Letters of all scripts stand for
themselves: an n-gram's code is its code points in one 64-bit number, looked up in the landmarks' sorted n-grams, of
which there are as many as the bounded sample has.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, whole_row

UNDETERMINED = "und"
#: Bits of a code point; three of them are one n-gram.
POINT = 21
#: The fit sees at most about so many texts of a language, and so many of them are landmarks.
SAMPLE, LANDMARKS = 400, 48
RIDGE = 1e-3
#: A filter drops texts whose best language scores less (0.5: as near to that language as to the rest).
LEAST_SCORE = 0.3
#: N-grams that are looked at together, texts that are scored together, and languages up to which counts are broadcast.
BLOCK, TOGETHER, BROADCAST_LANGUAGES = 4096, 64, 10_000


@lru_cache(1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and the code point it is folded to."""
    points = range(0x110000)
    letter = np.fromiter((not 0xD800 <= p < 0xE000 and chr(p).isalpha() for p in points), bool, 0x110000)
    folded = np.arange(0x110000, dtype=np.uint32)
    for p in np.flatnonzero(letter):
        low = chr(p).lower()
        if len(low) == 1:
            folded[p] = ord(low)
    return letter, folded


def _codes(text: str) -> np.ndarray:
    """Codes of the distinct n-grams of a text, sorted: the code points of its letters, one 0 for a run of other signs, in 64 bits."""
    letter, folded = _letters()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    signs = np.where(letter[points], folded[points], 0).astype(np.int64)
    signs = signs[np.concatenate(([True], (signs[1:] > 0) | (signs[:-1] > 0)))] if len(signs) else signs
    signs = np.concatenate(([0], signs, [0]))
    # One more than the code point, so that shorter n-grams have codes of their own.
    signs += 1
    two = signs[:-1] << POINT | signs[1:]
    three = two[:-1] << POINT | signs[2:]
    return np.unique(np.concatenate((signs, two, three)))


class Model:
    """Scores by language: presence @ weights / sqrt(number of n-grams), then a squeeze to 0..1."""

    def __init__(self, languages: list[str], vocabulary: np.ndarray, weights: np.ndarray):
        self.languages, self.vocabulary, self.weights = languages, vocabulary, weights

    def scores(self, texts: list[str]) -> np.ndarray:
        """A row for each text: blocks of texts, presence of the n-grams that any of them has, times these n-grams' weights."""
        out = np.zeros((len(texts), len(self.languages)))
        for first in range(0, len(texts), TOGETHER):
            some = [_codes(t) for t in texts[first : first + TOGETHER]]
            lengths = np.array(list(map(len, some)))
            at, found = _places(np.concatenate(some), self.vocabulary)
            used, column = np.unique(at, return_inverse=True)
            row = np.repeat(np.arange(len(some)), lengths)[found]
            block = np.zeros((len(some), len(self.languages)))
            for low in range(0, len(used), BLOCK):
                inside = (column >= low) & (column < low + BLOCK)
                presence = np.zeros((len(some), min(BLOCK, len(used) - low)))
                presence[row[inside], column[inside] - low] = 1
                block += presence @ self.weights[used[low : low + BLOCK]].astype(float)
            out[first : first + len(some)] = block / np.sqrt(lengths)[:, None]
        # The order of sums hangs on the block; equal texts have equal scores.
        return out.round(9)


def _places(codes: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the codes that the sorted vocabulary has stand in it, and which of ``codes`` these are."""
    at = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
    found = vocabulary[at] == codes
    return at[found], found


def fit(rows: list[tuple[str, str | np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """rows: (language, text or its n-grams), in a fixed order. None if there is nothing to learn from."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    sets = [_codes(t) if isinstance(t, str) else t for _, t in rows]
    taken: Counter = Counter()
    marks = []
    for k, (lang, _) in enumerate(rows):
        taken[lang] += 1
        if taken[lang] <= landmarks:
            marks.append(k)
    vocabulary = np.unique(np.concatenate([sets[k] for k in marks]))
    own = np.sqrt([len(s) for s in sets])
    at, found = _places(np.concatenate(sets), vocabulary)
    rows_at = np.repeat(np.arange(len(sets)), list(map(len, sets)))[found]
    order = np.argsort(at, kind="stable")
    at, rows_at = at[order], rows_at[order]

    def slices() -> Iterator[tuple[int, np.ndarray]]:
        """Presence of BLOCK n-grams in all texts at a time: the whole table need not fit the driver."""
        for first in range(0, len(vocabulary), BLOCK):
            a, b = np.searchsorted(at, (first, first + BLOCK))
            part = np.zeros((len(sets), min(BLOCK, len(vocabulary) - first)), np.float32)
            part[rows_at[a:b], at[a:b] - first] = 1
            yield first, part

    common = np.zeros((len(sets), len(marks)), np.float32)
    for _, part in slices():
        common += part @ part[marks].T
    kernel = common.astype(float) / own[:, None] / own[marks]
    values, vectors = np.linalg.eigh(kernel[marks])
    keep = values > 1e-8 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ whiten
    target = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _ in rows])
    count = Counter(lang for lang, _ in rows)
    weight = np.array([1 / count[lang] for lang, _ in rows])[:, None]
    gram = features.T @ (features * weight) + ridge * np.eye(features.shape[1])
    coefficients = whiten @ np.linalg.solve(gram, features.T @ (target * weight))
    coefficients = (coefficients / own[marks][:, None]).astype(np.float32)
    return Model(languages, vocabulary, np.concatenate([part[marks].T @ coefficients for _, part in slices()]))


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> list[tuple[str, np.ndarray]]:
    """Rows (language, distinct n-grams of the whole text) to fit on, in a fixed order: about ``sample`` texts of each language, drawn by a digest of id and text.

    Every labelled row counts towards a language's number of rows, from which its share is fixed; so no language meets in
    one task, and the driver holds the n-grams of about languages x sample texts, each once, made where the text is. All
    languages are drawn from; the row with the least digest is always
    taken. Rows that repeat are drawn once; rows without a language and blank texts are not drawn.
    """
    name = F.concat_ws(":", F.lit("sample"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(text_col).cast("string"))
    rows = docs.where(F.col(lang_col).isNotNull() & (F.trim(text_col) != ""))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), (F.crc32(name) / F.lit(2.0**32)).alias("d"))
    counts = rows.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"), F.min("d").alias("least"))
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))
    counts = materialize(counts, "languages")
    # A row for each language; more than could be broadcast safely meet by language, and Spark splits large ones.
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_LANGUAGES else counts
    drawn = rows.join(counts, F.col("lang") == F.col("of")).where((F.col("d") < share) | (F.col("d") == F.col("least")))
    picked = drawn.groupBy("lang", "d").agg(F.min("text").alias("text"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [_codes(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("d"), pa.array(codes, pa.binary())], ["lang", "d", "codes"])

    kept = picked.mapInArrow(grams, "lang string, d double, codes binary")
    return [(r["lang"], np.frombuffer(r["codes"], np.int64)) for r in kept.orderBy("d", "lang").collect()]


def _predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    known = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if model else []
    if known:
        values = model.scores([texts[k] for k in known])
        for k, row, b in zip(known, values, values.argmax(axis=1)):
            langs[k] = model.languages[b]
            scores[k] = float(min(1.0, max(0.0, (row[b] + 1) / 2)))
    return langs, scores


def identify(rows: DataFrame, model: Model | None, text_col: str) -> DataFrame:
    """``rows``, whose one column is the struct ``row``, with the columns _lang_pred and _score added, without a shuffle; see :func:`classify`."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _predict(model, batch.column("row").field(text_col).to_pylist())
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_lang_pred", "_score"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_lang_pred", T.StringType()), T.StructField("_score", T.DoubleType())])
    return rows.mapInArrow(scored, schema)


def learned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, sample: int = SAMPLE) -> tuple[Model | None, Column]:
    """The model of the documents that are not held out, and the condition by which documents are held out."""
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0
    return fit(labelled_sample(docs.where(~held), id_col, text_col, lang_col, sample)), held


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language can be told: not ``und``, and a score of at least ``least_score``.

    Null texts and those without a letter go; of rows that repeat each stays. If no row has a language, nothing can be
    learned and every row goes. Columns may have any names; an empty table gives no rows.
    """
    model, _ = learned(docs, id_col, text_col, lang_col)
    out = identify(docs.select(whole_row(docs)), model, text_col).where((F.col("_lang_pred") != UNDETERMINED) & (F.col("_score") >= least_score))
    return out.select("row.*")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: the id, held_out, lang_pred, score.

    Documents whose crc32 of the id as text is divisible by ``folds`` are held out; the others with a language are
    learned from, at most about ``sample`` texts of each, every language. lang_pred is a learned language, ``und`` for texts that are
    null or have no letter, or if nothing can be learned. score is the ridge regression's value for that language
    (-1..1) as 0..1, 0 for ``und``. Predictions see the text only, so equal texts have equal ones. A null id counts
    as the empty text. Other columns are ignored; an empty table gives no rows.
    """
    model, held = learned(docs, id_col, text_col, lang_col, folds, sample)
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held_out")).alias("row"))
    return identify(rows, model, "text").select(F.col("row.id").alias(id_col), "row.held_out", F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))

"""Token counts of every prefix of a text, by dynamic programming over the merges.

The tokenizer drops white space and never joins what stands on both sides of it, and it cuts what is left into parts (letters,
one digit, other signs) that it never joins either. So a text's tokens are those of its parts, and what is needed of a part
is stored for every prefix of every part, once for all parts that begin so:

    inner   the last token of the prefix, taken as the beginning of a longer part
    count   the exact number of tokens of the prefix, taken as a part of its own

Both come from the entries of shorter prefixes: a row of tokens is what the merges make of its bytes exactly when that holds for every two
neighbours in it. So token t is inner if the last token before it and t are what the merges make of the two together, and
there is exactly one such t; count is the same with the token that ends a part. Two tables of a text follow:

    end[i]    the byte at which token i ends: start of its chunk + the token's end inside the chunk
    count[j]  the tokens of the first j bytes taken alone: tokens of the chunks before + tokens(chunk[:rest])

The first is built for every text and gives the number of tokens, whether the text exceeds a limit, and where any budget
of tokens ends. The second, built if asked for, gives the exact count of any prefix. Neither encodes anything again.

The library encodes what the tables do not cover: chunks with characters beyond Latin ones, with white space outside ASCII
or with special tokens, and whole texts for tokenizers that work in another way, which is seen when they are loaded.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL = "word_bpe_49k.json"
LIMIT = 2048
#: How a tokenizer must be set up for the tables to hold. The vocabulary marks tokens that end a part.
END = "</w>"
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": PARTS}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Characters below this one, if upper and lower case have one length, are covered by the tables.
COVERED = 0x180
#: Chunks, prefixes and pairs of tokens kept by a Python worker at most.
CACHED_CHUNKS, CACHED_PREFIXES, CACHED_PAIRS = 1_000_000, 1_000_000, 500_000
#: A chunk of more bytes is left to the library: a table of prefixes written out takes the square of the length.
LONGEST_CHUNK = 400
#: Chunks outside the tables of which the counts of all prefixes are kept.
CACHED_INSIDE = 200_000
#: Texts whose new chunks are looked at together.
TEXTS = 256
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def byte_signs() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies: itself where printable, else the next free one from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(free)) for b in range(256)]


class MergeTables:
    """The tables of parts for one vocabulary; caches are bounded and local to a Python worker."""

    def __init__(self, model: dict):
        self.tokens = set(model["vocab"])
        #: By last two signs the length of the longest token, for tokens inside a part and at its end.
        self.inside: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for t in self.tokens:
            plain = t.removesuffix(END)
            reach = self.inside if plain == t else self.final
            reach[plain[-2:]] = max(reach.get(plain[-2:], 1), len(plain))
        merges = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        self.rank = {m: k for k, m in enumerate(merges)}
        self.splits: dict[str, tuple[str, str] | bool] = {}
        self.edges: tuple[dict, dict] = {}, {}
        self.ordered = self._is_ordered()
        self.signs = {b: s for b, s in enumerate(byte_signs())}
        self.pairs: dict[tuple[str, str], bool] = {}
        #: By prefix: length of its last token inside a part, number of tokens inside a part, exact count, length of the last token of a part.
        self.prefixes: dict[str, tuple[int, int, int, int]] = {"": (0, 0, 0, 0)}
        self.shared: dict[tuple, tuple] = {}

    def _is_ordered(self) -> bool:
        """Whether every merge comes after those that make its two sides; tokens that the merges do not make are left out."""
        made: set[str] = set()
        for left, right in self.rank:
            if any(len(x.removesuffix(END)) > 1 and x not in made for x in (left, right)):
                return False
            made.add(left + right)
        signs = {t for t in self.tokens if len(t.removesuffix(END)) == 1}
        self.tokens &= made | signs
        return True

    def merged(self, symbols: list[str], steps: int = -1) -> list[str]:
        """What the merges make of the symbols: always the pair of least rank, from the left; at most so many ``steps``."""
        symbols = list(symbols)
        rank, none = self.rank.get, len(self.rank)
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]
        while steps and ranks and (best := min(ranks)) < none:
            steps -= 1
            k = ranks.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((symbols[k - 1], symbols[k]), none)
            if k < len(ranks):
                ranks[k] = rank((symbols[k], symbols[k + 1]), none)
        return symbols

    def _split(self, token: str) -> tuple[str, str] | bool:
        """The two symbols from which the merges make the token last; True for single signs, False for what they do not make."""
        if token not in self.splits:
            plain = token.removesuffix(END)
            symbols = [*plain[:-1], plain[-1] + token[len(plain) :]]
            while len(symbols) > 2 and len(shorter := self.merged(symbols, 1)) < len(symbols):
                symbols = shorter
            self.splits[token] = len(plain) == 1 or (tuple(symbols) in self.rank and tuple(symbols))
        return self.splits[token]

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The symbols that stand at the token's left (0) or right (1) end while it is made, with the rank of the merge that takes each."""
        if token not in self.edges[side]:
            out = [(token, len(self.rank))]
            while isinstance(pair := self._split(out[-1][0]), tuple):
                out.append((pair[side], self.rank[pair]))
            self.edges[side][token] = out
        return self.edges[side][token]

    def _meet(self, before: str, token: str) -> bool:
        """Whether the merges leave these two tokens side by side; ``before`` may be empty.

        Merges go on in order of rank, so a pair across the border is merged if its rank comes before those of the merges
        that take its two sides, the left one's also at the same rank, as merging goes from the left.
        """
        found = self._split(token) is not False
        for x, taken in self._edge(before, 1) if before else ():
            for y, gone in self._edge(token, 0):
                r = self.rank.get((x, y))
                if r is not None and r < taken and r <= gone:
                    found = False
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[before, token] = found
        return found

    def _extend(self, part: str) -> tuple[str, bytes]:
        """Make sure that the prefixes of the part have entries; the part in the vocabulary's signs and in bytes."""
        raw = part.encode()
        signs = raw.decode("latin-1").translate(self.signs)
        known = self.prefixes
        if signs in known:
            return signs, raw
        if len(known) + len(raw) > CACHED_PREFIXES:
            known.clear()
            known[""] = 0, 0, 0, 0
        n, tokens, pairs, meet, inside, final = len(raw), self.tokens, self.pairs, self._meet, self.inside, self.final
        done = n - 1
        while done and signs[:done] not in known:
            done -= 1
        for k in range(done + 1, n + 1):
            two = signs[k - 2 if k > 1 else 0 : k]
            # The last token as the end of a part; the longest that fits is mostly it.
            if k == n or raw[k] & 0xC0 != 0x80:
                reach = final.get(two, 1)
                for a in range(k - reach if k > reach else 0, k):
                    token = signs[a:k] + END
                    if token in tokens:
                        entry = known[signs[:a]]
                        key = signs[a - entry[0] : a], token
                        if pairs[key] if key in pairs else meet(*key):
                            count, closing = entry[1] + 1, k - a
                            break
            else:  # inside a character the count is that of the characters before it
                count, closing = known[signs[: k - 1]][2], 0
            reach = inside.get(two, 1)
            for a in range(k - reach if k > reach else 0, k):
                token = signs[a:k]
                if token in tokens:
                    entry = known[signs[:a]]
                    key = signs[a - entry[0] : a], token
                    if pairs[key] if key in pairs else meet(*key):
                        new = k - a, entry[1] + 1, count, closing
                        break
            known[signs[:k]] = self.shared.setdefault(new, new)
        return signs, raw

    def counts(self, part: str) -> list[int]:
        """The exact counts of the part's first 1, 2, ... bytes taken as parts; inside a character that of the characters before it."""
        signs, _ = self._extend(part)
        return [self.prefixes[signs[:k]][2] for k in range(1, len(signs) + 1)]

    def ends(self, part: str) -> tuple[int, ...]:
        """The bytes at which the part's tokens end; a token that ends inside a character counts as ending after it."""
        signs, raw = self._extend(part)
        n = len(raw)
        out, at = [n], n - self.prefixes[signs][3]
        while at:
            end = at
            while end < n and raw[end] & 0xC0 == 0x80:
                end += 1
            out.append(end)
            at -= self.prefixes[signs[:at]][0]
        return tuple(out[::-1])


class PrefixCounter:
    """Counts for one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        setup = json.loads(self.tokenizer.to_str())
        #: Whether the tables hold for this tokenizer; otherwise texts are encoded whole.
        covered = _is_covered(setup)
        self.merges = MergeTables(setup["model"]) if covered else None
        self.tabled = covered and self.merges.ordered
        self.special = re.compile(b"|".join(re.escape(t["content"].encode()) for t in setup["added_tokens"]) or b"(?!)")
        plain = [c for c in map(chr, range(0x21, COVERED)) if not c.isspace() and len(c.lower()) == 1 and len(c.lower().encode()) == len(c.encode())]
        self.covered = regex.compile(f"[{regex.escape(''.join(plain), special_only=False)}]+")
        self.split = regex.compile(PARTS)
        #: The bytes at which the chunk's tokens end; equal tuples are kept once.
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.shared: dict[tuple[int, ...], tuple[int, ...]] = {}
        #: The exact counts of the chunk's first 1, 2, ... bytes.
        self.inside: dict[bytes, np.ndarray] = {}
        if self.tabled:
            probe = [c.encode() for c in plain] + [f"{a}{b}".encode() for a, b in zip(plain, plain[7:])]
            own = [len(self._tabled_ends(self._parts(c))) for c in probe]
            self.tabled = own == [len(e.ids) for e in self.tokenizer.encode_batch([c.decode() for c in probe], add_special_tokens=False)]

    def _parts(self, chunk: bytes) -> list[str] | None:
        """The parts of a chunk that the tables cover, else None."""
        if len(chunk) > LONGEST_CHUNK:
            return None
        if chunk.isalpha():  # letters of ASCII only
            return [chunk.lower().decode()]
        text = chunk.decode("utf-8", "replace")
        if not self.covered.fullmatch(text) or self.special.search(chunk):
            return None
        return [text.lower()] if text.isalpha() else self.split.findall(text.lower())

    def _tabled_ends(self, parts: list[str]) -> tuple[int, ...]:
        if len(parts) == 1:
            return self.merges.ends(parts[0])
        out, at = [], 0
        for part in parts:
            ends = self.merges.ends(part)
            out += [at + x for x in ends]
            at += ends[-1]
        return tuple(out)

    def _library_ends(self, texts: list[str]) -> list[tuple[int, ...]]:
        out = []
        for text, e in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            at = list(accumulate((len(x.encode("utf-8", "replace")) for x in text), initial=0))
            out.append(tuple(at[b] for _, b in e.offsets))
        return out

    def prepare(self, texts: list[list[bytes]]) -> None:
        """Make sure that the cache holds the ends of these texts' chunks; chunks outside the tables are encoded in one batch."""
        if not self.tabled:  # whole texts are not kept
            self.known, self.shared = {}, {}
        new = set().union(*texts).difference(self.known)
        if len(self.known) + len(new) > CACHED_CHUNKS:
            self.known.clear()
            self.shared.clear()
            new = set().union(*texts)
        others = []
        for c in new:
            parts = self._parts(c) if self.tabled else None
            if parts is None:
                others.append(c)
            else:
                ends = self._tabled_ends(parts)
                self.known[c] = self.shared.setdefault(ends, ends)
        self.known.update(zip(others, self._library_ends([c.decode("utf-8", "replace") for c in others])))

    def prepare_inside(self, texts: list[list[bytes]]) -> None:
        """Make sure that ``inside`` holds the chunks of these texts."""
        if not self.tabled:
            self.inside = {}
        new = set().union(*texts).difference(self.inside)
        if len(self.inside) + len(new) > CACHED_INSIDE:
            self.inside.clear()
            new = set().union(*texts)
        for c in new:
            parts = self._parts(c) if self.tabled else None
            self.inside[c] = self._library_counts(c) if parts is None else self._tabled_counts(c, parts)

    def _tabled_counts(self, chunk: bytes, parts: list[str]) -> np.ndarray:
        out, total = [], 0
        for part in parts:
            counts = self.merges.counts(part)
            out += [total + x for x in counts]
            total += counts[-1]
        if b"'" in chunk:  # what follows an apostrophe decides whether it is a part of its own
            text = chunk.decode().lower()
            for k in range(1, len(text)):
                if "'" in text[max(0, k - 2) : k]:
                    at = len(text[:k].encode())
                    out[at - 1] = sum(self.merges.counts(p)[-1] for p in self.split.findall(text[:k]))
                    wide = len(text[k].encode())
                    out[at : at + wide - 1] = [out[at - 1]] * (wide - 1)
        return np.array(out, np.int64)

    def _library_counts(self, chunk: bytes) -> np.ndarray:
        text, counts = chunk.decode("utf-8", "replace"), []
        for k in range(1, len(text) + 1, TEXTS):
            part = [text[:j] for j in range(k, min(k + TEXTS, len(text) + 1))]
            counts += [len(e.ids) for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]
        # Inside a character the count is that of the characters before it.
        width = [len(x.encode("utf-8", "replace")) for x in text]
        return np.repeat([0, *counts], [width[0] - 1, *width[1:], 1])

    def chunks(self, raw: bytes) -> list[bytes]:
        """What tables are kept for: a text's chunks between white space, or the text itself."""
        return raw.split() if self.tabled else [raw] if raw else []

    def token_ends(self, raw: bytes, chunks: list[bytes]) -> np.ndarray:
        """The byte at which each token of the text ends; the chunks are prepared."""
        inner = list(map(self.known.__getitem__, chunks))
        lengths = np.fromiter(map(len, inner), np.int64, len(inner))
        return np.repeat(self._starts(raw), lengths) + np.fromiter(chain.from_iterable(inner), np.int64, int(lengths.sum()))

    def prefix_counts(self, raw: bytes, chunks: list[bytes]) -> np.ndarray:
        """The exact count of the first 0, 1, ... bytes; the chunks are prepared inside."""
        at = np.zeros(len(raw) + 1, np.int64)
        if chunks and not self.tabled:
            at[1:] = self.inside[raw]
        elif chunks:
            inner = [self.inside[c] for c in chunks]
            lengths = np.fromiter(map(len, inner), np.int64, len(inner))
            before = np.concatenate(([0], np.cumsum([x[-1] for x in inner])))
            space = _SPACE[np.frombuffer(raw, np.uint8)]
            at[1:][~space] = np.concatenate(inner) + np.repeat(before[:-1], lengths)
            ended = np.searchsorted(self._starts(raw) + lengths, np.flatnonzero(space), "right")
            at[1:][space] = before[ended]
        return at

    def table(self, text: str | None) -> tuple[list[int], list[int], np.ndarray]:
        """Byte offsets at which chunks end, tokens up to there, and the counts of all prefixes."""
        raw = (text or "").encode("utf-8", "replace")
        chunks = self.chunks(raw)
        self.prepare_inside([chunks])
        self.prepare([chunks])
        counts = self.prefix_counts(raw, chunks)
        ends = (self._starts(raw) + np.fromiter(map(len, chunks), np.int64, len(chunks))).tolist()
        return ends, counts[ends].tolist(), counts

    def tokens_of_prefix(self, table: tuple[list[int], list[int], np.ndarray], n_bytes: int) -> int:
        """Tokens of the first ``n_bytes`` bytes, which end between characters."""
        return int(table[2][n_bytes])

    def truncation_point(self, raw: bytes, chunks: list[bytes], budget: int) -> int:
        """Byte at which token number ``budget`` ends; the whole length for texts with no more tokens than that."""
        return _cut(self.token_ends(raw, chunks), len(raw), budget)

    def _starts(self, raw: bytes) -> np.ndarray:
        if not self.tabled:
            return np.zeros(min(1, len(raw)), np.int64)
        space = np.concatenate(([True], _SPACE[np.frombuffer(raw, np.uint8)]))
        return np.flatnonzero(space[:-1] & ~space[1:])


def _is_covered(setup: dict) -> bool:
    model, normal, split = (setup[k] or {} for k in ("model", "normalizer", "pre_tokenizer"))
    fixed = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": END, "byte_fallback": False, "ignore_merges": False}
    added = [t["content"].split() == [t["content"]] and not (t["single_word"] or t["lstrip"] or t["rstrip"]) for t in setup["added_tokens"]]
    return all(model.get(k) == v for k, v in fixed.items()) and normal.get("normalizers") == NORMALIZERS and split.get("pretokenizers") == SPLITTERS and all(added)


def _cut(ends: np.ndarray, n_bytes: int, budget: int) -> int:
    return n_bytes if len(ends) <= budget else int(ends[budget - 1]) if budget else 0


def _nested(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts), pa.int64()))


@lru_cache(1)
def _counter(path: str) -> PrefixCounter:
    """One per Python worker, which keeps its cache over the tasks that it runs."""
    return PrefixCounter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, limit: int = LIMIT, tables: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes, n_tokens, over_limit, limit_bytes.

    n_tokens is what the tokenizers library gives for the whole text without added special tokens; limit_bytes is the
    byte at which token number ``limit`` ends, where a truncated text stops; n_bytes for texts within the limit. Null counts as empty:
    no bytes, no tokens. Rows that repeat are counted each; other columns are ignored; an empty table gives no rows.

    With ``tables`` come two arrays, from which :func:`budget_bytes` and :func:`prefix_tokens` answer for any budget and
    any prefix: token_ends, the byte at which each token ends, and prefix_counts, the tokens of the first 0, 1, ... n_bytes
    bytes taken alone. For what the library has to encode (see above) these take time in the square of a chunk's length,
    or of the text's for tokenizers that work in another way.
    """
    path = public_tokenizers.path(model)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for whole in batches:
            for at in range(0, len(whole), TEXTS):
                batch = whole.slice(at, TEXTS)
                raws = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
                chunks = list(map(counter.chunks, raws))
                if tables:
                    counter.prepare_inside(chunks)
                counter.prepare(chunks)
                ends = list(map(counter.token_ends, raws, chunks))
                tokens = list(map(len, ends))
                cuts = [_cut(e, len(r), limit) for r, e in zip(raws, ends)]
                columns = [pa.array(x, pa.int64()) for x in (list(map(len, raws)), tokens, cuts)]
                over = pa.array([n > limit for n in tokens], pa.bool_())
                columns = [batch.column("id"), *columns[:2], over, columns[2]]
                if tables:
                    columns += [_nested(ends), _nested(list(map(counter.prefix_counts, raws, chunks)))]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "n_bytes", "n_tokens", "over_limit", "limit_bytes", *(["token_ends", "prefix_counts"] if tables else [])]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    more = ", token_ends array<long>, prefix_counts array<long>" if tables else ""
    out = rows.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, limit_bytes long{more}")
    return out.withColumnRenamed("id", id_col)


def budget_bytes(budget: Column) -> Column:
    """From the tables: the byte at which token number ``budget`` ends; n_bytes for texts with no more tokens than that."""
    end = F.when(budget > 0, F.get("token_ends", (budget - 1).cast("int"))).otherwise(0)
    return F.when(F.col("n_tokens") <= budget, F.col("n_bytes")).otherwise(end)


def prefix_tokens(n_bytes: Column) -> Column:
    """From the tables: the exact number of tokens of the text's first ``n_bytes`` bytes, which end between characters; null beyond the text."""
    return F.get("prefix_counts", n_bytes.cast("int"))

"""Removal of repeated passages with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a smaller id. Documents are dealt
into shards, and the shards and the rest of the plan exchange rows, whose number grows with the bytes of text and
does not depend on how many shards there are:

1. Every string of LENGTH bytes is named by its minimizer, the smallest hash among its substrings of ANCHOR bytes. Each
   shard sends a row per distinct name; sorted by name, they show which names several shards have. This only spares work:
   equal strings have equal minimizers, so none is lost, and what no other document has is not sorted.
2. A shard joins all runs of strings whose name is shared to a text and builds its suffix array (Larsson-Sadakane
   refinement: sort by eight bytes, then double the sorted length within unsorted groups), gets the common prefixes by
   Kasai's scan, and so its distinct strings with the smallest document of each. A larger text takes several arrays,
   merged by binary search of each one's strings in the others.
3. Of the distinct strings whose name another shard has, neighbours with one name are sent as a segment, a row with the
   smallest document. Rows meet by name; their strings are put in order of digests, in pieces of bounded size, which are
   merged by binary search. The answer is a bit per string: another shard has it in a smaller document. So a passage of very many
   documents is a row per shard, and a name that very many different strings share is dealt out string by string (``hot``).
4. With the segments travels what a shard's suffix arrays say of its own strings, in stretches of neighbours: which of them a smaller
   document of the shard has, and which are further copies of an asked one. It comes back with the answers, so the marking
   sorts nothing: it flags the places of such strings, goes over the bytes under them and hashes what is left.

Texts travel packed: the documents that a task has for a shard are one row, so there are never more rows than documents.

A task takes a shard, or a share of the names or segments whose size the number of partitions keeps in bounds, and numpy
arrays over a few megabytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

LENGTH, ANCHOR = 50, 24
#: Text of a shard, bytes of a piece of text that is hashed at once, and of a piece whose suffixes are sorted.
SHARD_BYTES, PIECE, SORTED = 10 << 20, 1 << 20, 4 << 20
#: A name of more runs, over all shards, is hot.
HOT = 4096
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Where the eight-byte words of a string begin; the last overlaps the one before it.
_OFFSETS = [*range(0, LENGTH - 7, 8), *([LENGTH - 8] if LENGTH % 8 else [])]


def _words(raw: np.ndarray, order: str = "<u8") -> np.ndarray:
    """At each byte the number that it and the next seven bytes make; zeros follow the end."""
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    return np.ndarray((len(raw),), order, padded, 0, (1,)).astype(np.uint64)


def minimizers(raw: np.ndarray) -> np.ndarray:
    """For each string of LENGTH bytes its smallest anchor hash."""
    w = _words(raw)
    n = len(raw) - ANCHOR + 1
    h = w[:n] * _A
    h ^= (w[8 : n + 8] * _B) >> np.uint64(7)
    h += w[ANCHOR - 8 : n + ANCHOR - 8] * _C
    h ^= h >> np.uint64(32)
    h *= _B
    h ^= h >> np.uint64(29)
    width, span = LENGTH - ANCHOR + 1, 1
    while 2 * span <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.minimum(h[: len(h) - (width - span)], h[width - span :]) if width > span else h


class Documents:
    """A shard's documents in order of id."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None]):
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k] or b""))
        self.ids = [ids[k] for k in order]
        self.numbers = np.array([i or 0 for i in self.ids], np.int64)
        self.texts = [texts[k] or b"" for k in order]
        #: Where each text would begin if they were joined.
        self.begin = np.cumsum([0, *map(len, self.texts)])


class Shard(Documents):
    """A shard's documents, and the runs of neighbouring strings with one minimizer."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None], bits: int):
        super().__init__(ids, texts)
        found = list(self._runs(np.uint64(64 - bits)))
        empty = np.zeros(0, np.int64)
        #: By run its name, document, place in it and number of strings; in order of document and place.
        self.name, self.doc, self.place, self.count = (np.concatenate(x) for x in zip(*found)) if found else [empty] * 4

    def _pieces(self) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
        """Bytes, and the parts (start, end, document, place in it) of which they consist; longer texts are cut with an overlap."""
        data, parts, size = [], [], 0
        for k, (doc, text) in enumerate(zip(self.ids, self.texts)):
            if doc is None:
                continue
            at = 0
            while len(text) - at >= LENGTH:
                piece = text[at : at + PIECE + LENGTH - 1]
                data.append(piece)
                parts.append((size, size + len(piece), k, at))
                size, at = size + len(piece), at + PIECE
                if size >= PIECE:
                    yield b"".join(data), parts
                    data, parts, size = [], [], 0
        if data:
            yield b"".join(data), parts

    def _runs(self, spare: np.uint64) -> Iterator[tuple[np.ndarray, ...]]:
        for data, parts in self._pieces():
            m = minimizers(np.frombuffer(data, np.uint8))
            begin, end, doc, place = (np.array(x, np.int64) for x in zip(*parts))
            change = np.empty(len(m), bool)
            change[0] = True
            np.not_equal(m[1:], m[:-1], out=change[1:])
            last = end - LENGTH + 1
            change[begin] = True
            change[last[last < len(m)]] = True
            starts = np.flatnonzero(change)
            counts = np.diff(starts, append=len(m))
            part = np.searchsorted(begin, starts, "right") - 1
            inside = starts < last[part]
            starts, counts, part = starts[inside], counts[inside], part[inside]
            # Minima are small numbers; spread them, and keep as many bits as tell the corpus's names apart.
            names = ((m[starts] * _A) >> spare).astype(np.int64)
            yield names, doc[part], place[part] + starts - begin[part], counts

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct names, sorted, and their numbers of runs."""
        return np.unique(self.name, return_counts=True)

    def several(self) -> np.ndarray:
        """By run whether two documents of the shard have its name."""
        order = np.argsort(self.name)
        first = np.flatnonzero(np.diff(self.name[order], prepend=-1))
        number = self.numbers[self.doc[order]]
        own = np.minimum.reduceat(number, first) != np.maximum.reduceat(number, first) if len(first) else np.zeros(0, bool)
        out = np.empty(len(order), bool)
        out[order] = np.repeat(own, np.diff(np.append(first, len(order))))
        return out


# Suffix arrays


def suffix_array(raw: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in sorted order, to their ends: Kasai's scan relies on the order of long repeats too."""
    n = len(raw)
    key = _words(raw, ">u8")
    sa = np.argsort(key).astype(np.int32)
    key = key[sa]
    # A group's number is the place of its last suffix; groups of one are done.
    group = np.empty(n + 1, np.int64)
    group[n] = -1

    def number(places: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Gives the suffixes at these places their groups, where ``new`` marks a group's first; returns the places still unsorted."""
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(places)) - 1
        sizes = last - first + 1
        group[sa[places]] = np.repeat(places[last], sizes)
        return places[np.repeat(sizes > 1, sizes)]

    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    unsorted, sorted_to = number(np.arange(n), new), 8
    while len(unsorted):
        suffixes = sa[unsorted]
        # A suffix that has ended comes before those it is the beginning of; zeros after the text's end are no bytes.
        rest = n - suffixes.astype(np.int64) - sorted_to
        beyond = np.where(rest >= 0, group[n - np.maximum(rest, 0)], rest - 1)
        key = (group[suffixes] << 32) + beyond + n + 1
        order = np.argsort(key)
        sa[unsorted] = suffixes[order]
        key = key[order]
        unsorted = number(unsorted, np.diff(key, prepend=-1) != 0)
        sorted_to *= 2
    return sa


def common_prefixes(raw: np.ndarray, sa: np.ndarray, most: int = LENGTH, lanes: int = 0) -> np.ndarray:
    """Kasai's scan: by place in ``sa`` the bytes that the suffix shares with the one before it, counted up to ``most``.

    Going on by one byte in the text, a suffix and its predecessor share at least one byte less than before. The text
    is scanned in stretches side by side, eight bytes a step.
    """
    n = len(raw)
    lanes = lanes or max(4096, n // 32)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    words = _words(np.concatenate((raw, np.zeros(most + 8, np.uint8))))
    stretch = -(-n // lanes)
    base = np.arange(0, n, stretch)
    shared = np.zeros(len(base), np.int64)
    by_place = np.zeros(n, np.int16)
    for step in range(stretch):
        at = base + step
        if at[-1] >= n:
            base, shared, at = base[:-1], shared[:-1], at[:-1]
            if not len(at):
                break
        other = before[at]
        shared = np.where(other >= 0, np.maximum(shared - 1, 0), 0)
        open_ = np.flatnonzero((other >= 0) & (shared < most))
        while len(open_):
            x = words[at[open_] + shared[open_]] ^ words[other[open_] + shared[open_]]
            more = np.where(x == 0, 8, np.bitwise_count((x & -x) - np.uint64(1)) >> 3).astype(np.int64)
            shared[open_] += more
            open_ = open_[(more == 8) & (shared[open_] < most)]
        # Two suffixes share no byte beyond the text's end.
        shared = np.minimum(shared, np.minimum(most, n - np.maximum(at, other)))
        by_place[at] = shared
    return by_place[sa]


class SortedStrings:
    """Distinct strings in order, with the smallest document of each, as what is merged by binary search.

    heads: a place of each in ``raw``; least: its smallest document; group: by string given, which of the distinct ones it is;
    by_digest: whether the order is that of digests, and only then that of the strings.
    """

    def __init__(self, raw: np.ndarray, heads: np.ndarray, least: np.ndarray, group: np.ndarray, by_digest: bool = False):
        self.by_digest = by_digest
        self.raw, self.heads, self.least, self.group = raw, heads.astype(np.int32), least, group.astype(np.int32)
        #: For strings that an earlier piece has: that piece's number and the string's place there.
        self.origin = np.full((2, len(heads)), -1, np.int32)

    def keys(self) -> Iterator[np.ndarray]:
        """What the strings are ordered by, one key after the other: they take more room than all the rest and are not kept."""
        if self.by_digest:
            yield _digest(self.raw, self.heads)
        words = _words(self.raw, ">u8")
        for k in _OFFSETS:
            yield words[self.heads + k]

    def meet(self, other: SortedStrings, number: int = 0) -> None:
        """Strings that both pieces have get the smaller of their documents in both: a binary search, word by word.

        ``other`` is the later one and remembers where this one, piece ``number``, has them.
        """
        levels = zip(self.keys(), other.keys())
        own, wanted = next(levels)
        lo, hi = np.searchsorted(own, wanted, "left"), np.searchsorted(own, wanted, "right")
        query = np.flatnonzero(lo < hi)
        lo, hi = lo[query], hi[query]
        for own, wanted in levels:
            wanted = wanted[query]
            lo, hi = _bound(own, lo, hi, wanted, False), _bound(own, lo, hi, wanted, True)
            found = lo < hi
            query, lo, hi = query[found], lo[found], hi[found]
        least = np.minimum(self.least[lo], other.least[query])
        self.least[lo], other.least[query] = least, least
        new = other.origin[0, query] < 0
        other.origin[0, query[new]], other.origin[1, query[new]] = number, lo[new]


def sorted_piece(segments: list[bytes], docs: np.ndarray) -> SortedStrings:
    """The strings of the segments, joined to one text and sorted by its suffix array; groups by segment and place in it."""
    raw = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments], np.int64)
    begin = np.cumsum(sizes) - sizes
    sa = suffix_array(raw)
    group = np.cumsum(common_prefixes(raw, sa) < LENGTH, dtype=np.int32) - 1
    own = np.repeat(np.arange(len(segments), dtype=np.int32), sizes)
    whole = np.arange(len(raw)) <= (begin + sizes - LENGTH)[own]
    keep = whole[sa]
    sa, group = sa[keep], group[keep]
    first = np.flatnonzero(np.diff(group, prepend=-1) != 0)
    of_start = np.empty(len(raw), np.int32)
    of_start[sa] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(sa))))
    return SortedStrings(raw, sa[first], np.minimum.reduceat(docs[own[sa]], first), of_start[whole])


def sorted_strings(raw: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> SortedStrings:
    """The strings at these places in order of their digests. Equal digests are looked into, so that strings are only equal if all their bytes are."""
    digest, words = _digest(raw, starts), _words(raw, ">u8")
    order = np.argsort(digest)
    key = digest[order]
    again = np.flatnonzero(key[1:] == key[:-1])
    same = [words[starts[order[again]] + k] == words[starts[order[again + 1]] + k] for k in _OFFSETS]
    new = np.ones(len(order), bool)
    new[again + 1] = False
    if not all(x.all() for x in same):  # different strings with one digest
        levels = [digest, *(words[starts + k] for k in _OFFSETS)]
        order = np.lexsort(levels[::-1])
        new[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in levels], axis=0)
    first = np.flatnonzero(new)
    group = np.empty(len(starts), np.int32)
    group[order] = np.cumsum(new, dtype=np.int32) - 1
    return SortedStrings(raw, starts[order[first]], np.minimum.reduceat(docs[order], first), group, by_digest=True)


def _bound(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """By query the first place in [lo, hi) of a key not below (``after``: above) the wanted one."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        middle = (lo[open_] + hi[open_]) >> 1
        key = keys[middle]
        right = key <= wanted[open_] if after else key < wanted[open_]
        lo[open_] = np.where(right, middle + 1, lo[open_])
        hi[open_] = np.where(right, hi[open_], middle)
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def smaller_elsewhere(segments: list[bytes], docs: np.ndarray, piece_bytes: int = SORTED) -> tuple[np.ndarray, np.ndarray]:
    """For each string of each segment whether a document smaller than the segment's own has it; strings by segment."""
    sizes = np.array([len(s) for s in segments], np.int64)
    strings = sizes - LENGTH + 1
    piece = np.cumsum(sizes) // piece_bytes
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(segments)]
    pieces = []
    for a, b in zip(cuts, cuts[1:]):
        starts = _ranges(np.cumsum(sizes[a:b]) - sizes[a:b], strings[a:b])
        pieces.append(sorted_strings(np.frombuffer(b"".join(segments[a:b]), np.uint8), starts, np.repeat(docs[a:b], strings[a:b])))
    _meet_all(pieces)
    smallest = np.concatenate([p.least[p.group] for p in pieces])
    return smallest < np.repeat(docs, strings), strings


def _meet_all(pieces: list[SortedStrings]) -> None:
    for k, later in enumerate(pieces):
        for j, earlier in enumerate(pieces[:k]):
            earlier.meet(later, j)


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] numbers), begin[1], ..."""
    at = np.cumsum(count) - count
    out = np.arange(int(count.sum()))
    out += np.repeat(begin - at, count)
    return out


# The tasks' parts


class Candidates:
    """Runs of a shard whose strings another document may have, and the sorted pieces of their text.

    Of the strings of ``across`` (by run) the other shards are asked, one by one where the run is ``hot``.
    """

    def __init__(self, shard: Shard, across: np.ndarray, hot: np.ndarray, sorted_bytes: int):
        runs = np.flatnonzero(across | shard.several())
        self.shard, self.runs, self.across, self.hot = shard, runs, across[runs], hot[runs]
        doc, place, count = shard.doc[runs], shard.place[runs], shard.count[runs]
        new = np.empty(len(runs), bool)
        new[:1] = True
        np.logical_or(doc[1:] != doc[:-1], place[1:] != place[:-1] + count[:-1], out=new[1:])
        piece = np.cumsum(count + new * (LENGTH - 1)) // sorted_bytes
        new[1:] |= piece[1:] != piece[:-1]
        cuts = np.flatnonzero(np.diff(piece, prepend=-1, append=-1)) if len(runs) else np.zeros(1, np.int64)
        self.pieces: list[SortedStrings] = []
        #: By piece its runs, and by interval of neighbouring runs its strings.
        self.parts: list[slice] = []
        self.strings_in: list[np.ndarray] = []
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            first = np.flatnonzero(new[a:b])
            n = np.add.reduceat(count[a:b], first) + LENGTH - 1
            begin = place[a:b][first]
            texts = [shard.texts[d][p : p + m] for d, p, m in zip(doc[a:b][first].tolist(), begin.tolist(), n.tolist())]
            self.pieces.append(sorted_piece(texts, shard.numbers[doc[a:b][first]]))
            self.parts.append(slice(a, b))
            self.strings_in.append(n - LENGTH + 1)
        _meet_all(self.pieces)

    def strings(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """By string of piece ``k`` its run, counted from the piece's first, and whether it is asked about: the shard's first of its kind."""
        part, piece = self.parts[k], self.pieces[k]
        run = np.repeat(np.arange(part.stop - part.start), self.shard.count[self.runs[part]])
        first = np.empty(len(piece.heads), np.int64)
        first[piece.group[::-1]] = np.arange(len(run))[::-1]
        asked = np.zeros(len(run), bool)
        asked[first[piece.origin[0] < 0]] = True
        return run, asked & self.across[part][run]

    def segments(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By piece: for each segment its first string, number of strings and run."""
        for k, part in enumerate(self.parts):
            run, asked = self.strings(k)
            new = asked.copy()
            new[1:] &= ~asked[:-1] | (run[1:] != run[:-1]) | self.hot[part][run[1:]]
            start = np.flatnonzero(new)
            number = np.cumsum(new)[asked]
            yield start, np.bincount(number, minlength=len(start) + 1)[1:], run[start]

    def rows(self, number: int, bins: int = 1 << 62) -> Iterator[pa.RecordBatch]:
        """The segments as rows of _SEND, dealt into bins by name; ``number`` is the shard's."""
        for k, (start, count, run) in enumerate(self.segments()):
            part, raw = self.parts[k], self.pieces[k].raw
            # Each interval of the piece's text has LENGTH - 1 bytes more than strings.
            ends = np.cumsum(self.strings_in[k])
            at = start + (LENGTH - 1) * np.searchsorted(ends, start, "right")
            key = self.shard.name[self.runs[part]][run]
            hot = self.hot[part][run]
            key[hot] = _digest(raw, at[hot])
            key = ((key.view(np.uint64) * _B >> np.uint64(1)) % np.uint64(bins)).view(np.int64)
            own = self.runs[part]
            doc = self.shard.doc[own]
            before = np.cumsum(self.shard.count[own]) - self.shard.count[own]
            place = (self.shard.begin[doc] + self.shard.place[own])[run] + start - before[run]
            doc = self.shard.numbers[doc][run]
            ref = (number << _PLACE) + place
            for j in range(0, len(start), 1 << 13):  # the places of the bytes take eight times the bytes
                own = slice(j, j + (1 << 13))
                sizes = count[own] + LENGTH - 1
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                data = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw[_ranges(at[own], sizes)])])
                yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(ref[own]), pa.array(doc[own]), data, pa.array(np.zeros(len(sizes), bool))], schema=_SEND)

    def state(self) -> bytes:
        """What the marking needs to know of the sorted pieces: the strings that a smaller document of the shard has, and of the others
        those that are not the first of their kind, whose answer is that of the first. Both come in stretches of neighbours."""
        kind = np.int32 if self.shard.begin[-1] < 1 << 31 else np.int64
        hits: list[np.ndarray] = []
        copies: list[np.ndarray] = []
        firsts: list[np.ndarray] = []
        for k, piece in enumerate(self.pieces):
            runs = self.runs[self.parts[k]]
            n, doc = self.shard.count[runs], self.shard.doc[runs]
            at = _ranges(self.shard.begin[doc] + self.shard.place[runs], n).astype(kind)
            smaller = np.repeat(self.shard.numbers[doc], n) > piece.least[piece.group]
            first = np.empty(len(piece.heads), kind)
            first[piece.group[::-1]] = at[::-1]
            for j, earlier in enumerate(firsts):
                known = piece.origin[0] == j
                first[known] = earlier[piece.origin[1, known]]
            firsts.append(first)
            hits.append(_stretches(at[smaller]))
            rest = np.flatnonzero(~smaller & np.repeat(self.across[self.parts[k]], n))
            rest = rest[first[piece.group[rest]] != at[rest]]
            copies.append(_stretches(at[rest], first[piece.group[rest]]))
        both = [np.concatenate(x, axis=1) if x else np.zeros((w, 0), np.int64) for x, w in ((hits, 2), (copies, 3))]
        return zstandard.compress(np.array([x.shape[1] for x in both], "<i8").tobytes() + b"".join(x.astype("<i8").tobytes() for x in both), 1)


def _stretches(at: np.ndarray, source: np.ndarray | None = None) -> np.ndarray:
    """Ascending places as rows (first, how many), with a third for where their sources begin, which go along with them."""
    new = np.ones(len(at), bool)
    new[1:] = np.diff(at) != 1
    if source is not None:
        new[1:] |= np.diff(source) != 1
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(at)))
    return np.stack([at[first].astype(np.int64), counts, *([] if source is None else [source[first].astype(np.int64)])])


def covered(length: int, told: np.ndarray, state: bytes) -> np.ndarray:
    """By byte of the joined texts whether it goes. told: places of the first strings of their kind that other shards have in smaller documents."""
    raw = np.frombuffer(zstandard.decompress(state), "<i8")
    n_hits = int(raw[0])
    hits, copies = raw[2 : 2 + 2 * n_hits].reshape(2, -1), raw[2 + 2 * n_hits :].reshape(3, -1)
    flagged = np.zeros(length, bool)
    flagged[told] = True
    at = _ranges(copies[0], copies[1])
    again = at[flagged[_ranges(copies[2], copies[1])]]
    flagged[again] = True
    others = _stretches(np.flatnonzero(flagged))
    steps = np.zeros(length + 1, np.int32)
    for first, n in (hits, others):
        steps[first] += 1  # stretches are apart, so are their ends
        steps[first + n + LENGTH - 1] -= 1
    return np.cumsum(steps[:-1]) > 0


def _digest(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the strings that start at these places."""
    words = _words(raw)
    h = np.zeros(len(at), np.uint64)
    for k in _OFFSETS:
        h = (h ^ words[at + k]) * _B
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


_NAMES = pa.schema([("name", pa.int64()), ("tag", pa.int64())])
_SHARED = pa.schema([("shard", pa.int32()), ("name", pa.int64()), ("hot", pa.bool_())])
_TOLD = pa.schema([("shard", pa.int32()), ("place", pa.int64()), ("bits", pa.binary()), ("state", pa.bool_())])
_PACKED = pa.schema([("shard", pa.int32()), ("pack", pa.binary())])
_TEXTS = pa.schema([("id", pa.int64()), ("text", pa.string())])
_SEND = pa.schema([("bin", pa.int64()), ("ref", pa.int64()), ("doc", pa.int64()), ("data", pa.binary()), ("state", pa.bool_())])
_OUT = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
#: A row's tag is the shard's number and, in so many bits, its runs of the name.
_RUNS = 20
#: A segment's reference is the shard's number and, in so many bits, its place in the shard's joined texts.
_PLACE = 38


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By shard and batch of rows one row, compressed."""
    for batch in batches:
        shard = batch.column("shard").to_numpy()
        order = np.argsort(shard, kind="stable")
        rows = batch.select(["id", "text"]).take(pa.array(order)).cast(_TEXTS)
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist()
        packs = []
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _TEXTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                # Copied, so that a slice does not carry the bytes around it.
                writer.write_batch(rows.take(pa.array(np.arange(a, b))))
            packs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(shard[order][cuts], pa.int32()), pa.array(packs, pa.binary())], schema=_PACKED)


def _unpacked(rows: pa.Table) -> tuple[list[int | None], list[bytes | None]]:
    ids, texts = [], []
    for pack in rows.column("pack"):
        table = pa.ipc.open_stream(pack.as_buffer()).read_all()
        ids += table.column("id").to_pylist()
        texts += table.column("text").cast(pa.binary()).to_pylist()
    return ids, texts


def _name(bits: int):
    def name(rows: pa.Table) -> pa.Table:
        names, runs = Shard(*_unpacked(rows), bits).names()
        tags = (rows.column("shard")[0].as_py() << _RUNS) + np.minimum(runs, (1 << _RUNS) - 1)
        return pa.Table.from_arrays([pa.array(names), pa.array(tags)], schema=_NAMES)

    return name


def _gathered(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([b.cast(schema) for b in batches], schema=schema)


def _share(most: int):
    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition has all rows of its names; those that several shards have go back to these."""
        rows = _gathered(batches, _NAMES)
        names, tags = (rows.column(c).to_numpy() for c in ("name", "tag"))
        order = np.argsort(names)
        names, tags = names[order], tags[order]
        first = np.flatnonzero(np.diff(names, prepend=-1))
        shards = np.diff(np.append(first, len(names)))
        hot = np.add.reduceat(tags & ((1 << _RUNS) - 1), first) > most if len(first) else np.zeros(0, bool)
        shared = np.repeat(shards > 1, shards)
        names, tags, hot = names[shared], tags[shared], np.repeat(hot, shards)[shared]
        for k in range(0, len(names), 1 << 16):
            part = slice(k, k + (1 << 16))
            columns = [pa.array((tags[part] >> _RUNS).astype(np.int32)), pa.array(names[part]), pa.array(hot[part])]
            yield pa.RecordBatch.from_arrays(columns, schema=_SHARED)

    return share


def across(shard: Shard, shared: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By run whether several shards have its name, and whether that is hot; shared: such names, in any order."""
    order = np.argsort(shared)
    shared, hot = np.append(shared[order], -1), np.append(hot[order], False)
    at = np.searchsorted(shared[:-1], shard.name)
    found = shared[at] == shard.name
    return found, found & hot[at]


def _send(bits: int, sorted_bytes: int, bins: int):
    def send(rows: pa.Table, said: pa.Table) -> pa.Table:
        """The segments that the others are asked about, and the shard's own state, which comes back with the answers."""
        if not len(rows):
            return _SEND.empty_table()
        shard, number = Shard(*_unpacked(rows), bits), rows.column("shard")[0].as_py()
        found = Candidates(shard, *across(shard, said.column("name").to_numpy(), said.column("hot").to_numpy()), sorted_bytes)
        state = pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((number % bins, number << _PLACE, 0, found.state(), True), _SEND)], schema=_SEND)
        return pa.Table.from_batches([state, *found.rows(number, bins)], schema=_SEND)

    return send


def _sort(sorted_bytes: int):
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition has all segments of its keys; back go those of which another shard has a string in a smaller document."""
        rows = _gathered(batches, _SEND)
        states = rows.filter(rows.column("state"))
        for k in range(len(states)):
            own = states.slice(k, 1)
            columns = [pa.array([own.column("ref")[0].as_py() >> _PLACE], pa.int32()), pa.array([0], pa.int64()), own.column("data").combine_chunks(), pa.array([True])]
            yield pa.RecordBatch.from_arrays(columns, schema=_TOLD)
        rows = rows.filter(pc.invert(rows.column("state")))
        if not len(rows):
            return
        flags, strings = smaller_elsewhere(rows.column("data").to_pylist(), rows.column("doc").to_numpy(), sorted_bytes)
        ref = rows.column("ref").to_numpy()
        ends = np.cumsum(strings)
        told = np.flatnonzero(np.add.reduceat(flags, ends - strings))
        for k in range(0, len(told), 1 << 14):
            part = told[k : k + (1 << 14)]
            bits = [np.packbits(flags[a:b]).tobytes() for a, b in zip((ends - strings)[part].tolist(), ends[part].tolist())]
            own = ref[part]
            columns = [pa.array((own >> _PLACE).astype(np.int32)), pa.array(own & ((1 << _PLACE) - 1)), pa.array(bits, pa.binary()), pa.array(np.zeros(len(bits), bool))]
            yield pa.RecordBatch.from_arrays(columns, schema=_TOLD)

    return sort


def _told(places: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """The places of the strings that other shards have in smaller documents."""
    n = np.fromiter(map(len, bits), np.int64, len(bits)) * 8
    said = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8)).astype(bool)
    return _ranges(places, n)[said]


def _remove(schema: pa.Schema, with_kept: bool):
    def remove(rows: pa.Table, said: pa.Table) -> pa.Table:
        out = []
        if len(rows):
            docs, answers = Documents(*_unpacked(rows)), said.filter(pc.invert(said.column("state")))
            state = said.filter(said.column("state")).column("bits")[0].as_py()
            gone_at = covered(int(docs.begin[-1]), _told(answers.column("place").to_numpy(), answers.column("bits").to_pylist()), state)
            for k, (own, text) in enumerate(zip(docs.ids, docs.texts)):
                gone = gone_at[docs.begin[k] : docs.begin[k + 1]]
                removed = int(np.count_nonzero(gone))
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if removed else 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if removed else text
                row = (own, len(text), removed, spans, sha256(kept).hexdigest())
                out.append((*row, kept) if with_kept else row)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    return remove


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, sorted_bytes: int = SORTED, hot: int = HOT, with_kept: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id (an integer), n_bytes, n_removed, n_spans, kept_sha256; with_kept adds kept (binary).

    Texts are taken as UTF-8 bytes, null as empty. Every byte is removed that a string of 50 bytes covers which also
    starts in a document with a smaller id; strings are those of the input, and never cross documents. n_spans counts
    the maximal removed runs. Rows that repeat an id are one document for that, and each has its row. A row with a null
    id is left as it is and counts for no other. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(partitions(spark), -(-total // shard_bytes))
    # So many names that two different ones are rarely equal; that only costs work.
    bits = min(62, (total // 10).bit_length() + 8)
    # By id and text: rows of one id need not meet, so null or repeated ids fill no shard of their own.
    shard = F.pmod(F.xxhash64("id", "text"), F.lit(shards)).cast("int").alias("shard")
    texts = rows.select(shard, "id", "text").mapInArrow(_pack, _ddl(_PACKED))
    named = texts.groupBy("shard").applyInArrow(_name(bits), _ddl(_NAMES))
    shared = named.repartition(shards, "name").mapInArrow(_share(hot), _ddl(_SHARED))
    sent = texts.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(_send(bits, sorted_bytes, 32 * shards), _ddl(_SEND))
    told = sent.repartition(2 * shards, "bin").mapInArrow(_sort(2 * sorted_bytes), _ddl(_TOLD))
    schema = pa.schema([("id", pa.int64()), *_OUT, *([("kept", pa.binary())] if with_kept else [])])
    out = texts.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_remove(schema, with_kept), _ddl(schema))
    return out.withColumnRenamed("id", id_col)

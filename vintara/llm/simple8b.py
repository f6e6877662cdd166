"""Simple-8b: ids packed into words of 64 bits, four bits of which say how many ids of which width follow.

Ids are coded in blocks of ``BLOCK``. A word takes as many of the next ids as fit, as in Simple-8b. A few large ids would
spoil the words around them, so a block may have escapes: a slot of ones stands for an id that is written behind the
block's words. Which ids are escaped is decided for each block by the size that its widths come to; ids of 2^60 - 1 and more
always are. Selectors 0 and 1 (runs of zeros elsewhere) are not used: ids are not zero for long.

Both directions work on many blocks at once: the encoder walks through all blocks in step, a word of each at a time, and the
decoder shifts all words of one selector together.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: By selector from 2 on, the bits of an id and the ids of a word.
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNTS = 60 // WIDTHS
FIRST_SELECTOR = 2
#: Of a block: where its bytes begin, its words, its escapes, the bytes of an escape.
INDEX = np.dtype([("at", "<u8"), ("words", "<u4"), ("escapes", "<u4"), ("escape_bytes", "<u4")])
_ONES = (np.uint64(1) << WIDTHS.astype(np.uint64)) - np.uint64(1)
#: The largest id of each width; ones are left for escapes.
_MOST = _ONES - np.uint64(1)
#: Bytes of words that four ids take in slots of a width.
_BYTES = (4 * 8 / COUNTS).astype(np.float32)
_SMALL = np.searchsorted(_MOST, np.arange(1 << 16, dtype=np.uint64)).astype(np.uint8)


def encode(ids: np.ndarray, at: int = 0) -> tuple[bytes, np.ndarray]:
    """The blocks of the unsigned ids, and an INDEX row for each; ``at``: where the bytes will stand."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n_blocks = -(-len(ids) // BLOCK)
    index = np.zeros(n_blocks, INDEX)
    if not n_blocks:
        return b"", index
    # Behind each block as many zeros as a word may hold: they fit any slot.
    values = np.zeros((n_blocks, BLOCK + int(COUNTS[0])), np.uint64)
    filled = np.zeros(n_blocks * BLOCK, np.uint64)
    filled[: len(ids)] = ids
    values[:, :BLOCK] = filled.reshape(n_blocks, BLOCK)
    lengths = np.minimum(BLOCK, len(ids) - BLOCK * np.arange(n_blocks))

    kind = _kinds(values)
    wide = np.zeros(n_blocks, bool)
    if len(ids) and int(ids.max()) >> 32:
        wide = (values[:, :BLOCK] >> np.uint64(32)).any(1)
    escaped = kind > _escape_above(kind[:, :BLOCK], wide)[:, None]
    any_escaped = bool(escaped.any())
    kind[escaped] = 0
    at_word, chosen = _words(kind, lengths)

    flat, flat_escaped = values.ravel(), escaped.ravel()
    words = np.zeros(len(at_word), np.uint64)
    for k in np.flatnonzero(np.bincount(chosen)).tolist():
        here = np.flatnonzero(chosen == k)
        packed = np.full(len(here), (k + FIRST_SELECTOR) << 60, np.uint64)
        for j in range(int(COUNTS[k])):
            place = at_word[here] + j
            slot = flat[place]
            if any_escaped:
                slot[flat_escaped[place]] = _ONES[k]
            packed |= slot << np.uint64(WIDTHS[k] * j)
        words[here] = packed

    lane = at_word // values.shape[1]
    index["words"] = np.bincount(lane, minlength=n_blocks)
    index["escapes"] = escaped.sum(1)
    index["escape_bytes"] = np.where(wide, 8, 4)
    sizes = 8 * index["words"].astype(np.int64) + index["escapes"].astype(np.int64) * index["escape_bytes"]
    index["at"] = at + np.concatenate(([0], np.cumsum(sizes)[:-1]))
    own, ends = words.astype("<u8").tobytes(), np.cumsum(index["words"].astype(np.int64)) * 8
    if not index["escapes"].any():
        return own, index
    parts, before = [], 0
    for b, end in enumerate(ends.tolist()):
        parts.append(own[before:end])
        if index["escapes"][b]:
            parts.append(values[b][escaped[b]].astype("<u8" if wide[b] else "<u4").tobytes())
        before = end
    return b"".join(parts), index


def _kinds(values: np.ndarray) -> np.ndarray:
    """By id the place of the narrowest width that holds it, len(WIDTHS) for none."""
    out = _SMALL[values & np.uint64(len(_SMALL) - 1)]
    large = values >= np.uint64(len(_SMALL))
    if large.any():
        out[large] = np.searchsorted(_MOST, values[large])
    return out


def _escape_above(kind: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """By block the largest kind of id that is not escaped: of the widest four the one for which words and escapes come to the fewest bytes.

    Four ids next to each other are taken to stand in slots of the widest of them.
    """
    kinds = len(WIDTHS)
    tally = np.bincount(kind.ravel(), minlength=kinds + 1)
    present = np.flatnonzero(tally[:kinds])[-4:].tolist() or [0]
    # The four ids of a group one under the other.
    rows = np.ascontiguousarray(kind.reshape(-1, 4).T)
    sizes = []
    for k in present:
        over = rows > k
        left = rows * ~over
        slots = np.maximum(np.maximum(left[0], left[1]), np.maximum(left[2], left[3])).reshape(len(kind), -1)
        n_over = over.sum(0, dtype=np.uint8).reshape(len(kind), -1).sum(1)
        sizes.append(_BYTES[slots].sum(1) + n_over * np.where(wide, 8, 4))
    # Escapes have to save a twentieth at least.
    sizes[-1] = sizes[-1] * 0.95
    best = len(present) - 1 - np.argmin(sizes[::-1], 0)
    return np.array(present)[best]


def _words(kind: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, as places in ``kind`` read row by row, and of each the place in COUNTS of the longest word that fits there."""
    width = kind.shape[1]
    best = np.full((len(kind), width), len(COUNTS) - 1, np.uint8)
    most, n = kind, 1
    for k in range(len(COUNTS) - 2, -1, -1):
        step = int(COUNTS[k]) - n
        most, n = np.maximum(most[:, :-step], most[:, step:]), int(COUNTS[k])
        fits = most[:, :BLOCK] <= k
        if not fits.any():  # then no longer word fits either
            break
        np.copyto(best[:, :BLOCK], np.uint8(k), where=fits)
    flat = best.ravel()
    starts = np.zeros(len(flat), bool)
    at = np.arange(len(kind)) * width
    end = at + lengths
    while len(at):
        starts[at] = True
        at = at + COUNTS[flat[at]]
        going = at < end
        if not going.all():
            at, end = at[going], end[going]
    at = np.flatnonzero(starts)
    return at, flat[at]


def decode(data: bytes, index: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks, whose bytes are ``data``; lengths: how many ids each has."""
    if not len(index):
        return np.zeros(0, np.uint64)
    at = (index["at"] - index["at"][0]).astype(np.int64)
    counts, has_escapes = index["words"].astype(np.int64), bool(index["escapes"].any())
    if has_escapes:
        words = np.concatenate([np.frombuffer(data, "<u8", n, a) for a, n in zip(at.tolist(), counts.tolist())])
    else:
        words = np.frombuffer(data, "<u8", int(counts.sum()), 0)
    kind = (words >> np.uint64(60)).astype(np.int64) - FIRST_SELECTOR
    if len(kind) and kind.min() < 0:
        raise ValueError("a word has a selector that is not in use")
    taken = COUNTS[kind]
    begin = np.cumsum(taken) - taken
    # Blocks stand apart by as many places as a block's last word may reach beyond its end.
    wide, first = int(max(lengths.max(), 0) + COUNTS[0]), np.cumsum(counts) - counts
    begin += np.repeat(wide * np.arange(len(index)) - begin[first], counts)
    spread, ones = np.zeros(wide * len(index), np.uint64), []
    for k in np.flatnonzero(np.bincount(kind)).tolist():
        here = kind == k
        held, place = words[here], begin[here]
        for j in range(int(COUNTS[k])):
            slot = (held >> np.uint64(WIDTHS[k] * j)) & _ONES[k]
            spread[place + j] = slot
            if has_escapes:
                ones.append(place[slot == _ONES[k]] + j)
    real = np.arange(wide) < lengths[:, None]
    out = spread.reshape(len(index), wide)[real]
    if has_escapes:
        escaped = np.zeros(len(spread), bool)
        escaped[np.concatenate(ones)] = True
        escaped = escaped.reshape(len(index), wide)[real]
        parts = []
        for a, w, n, size in zip(at.tolist(), counts.tolist(), index["escapes"].tolist(), index["escape_bytes"].tolist()):
            if n:
                parts.append(np.frombuffer(data, f"<u{size}", n, a + 8 * w).astype(np.uint64))
        out[escaped] = np.concatenate(parts)
    return out

"""Operator 6: removal of byte strings that occur earlier, by hash-compared suffix sorting.

Of every 100-byte string that has an earlier copy, all bytes go. Strings are compared as
prefixes of suffixes: suffixes are merge-sorted, two of them being compared by a binary search
over prefix polynomial hashes for their common extension, and every neighbourhood of the sorted
order is then verified on the bytes.

Only suffixes that can repeat are sorted. Winnowing picks anchors, 20-byte grams whose hash is
the least of some run of 81, so every 100-byte string holds an anchor that its copies hold at
the same place. An anchor seen once has no copies; the others go with the bytes around them to
the task of their hash. Anchors with very many places would fill that task, so theirs go on as
single 100-byte strings: of these again only repeated ones move, one of each group of documents,
to the task of the string's hash, where they are sorted and verified like any other suffix.
Texts move once, to groups of documents, and four steps read that one shuffle: finding anchors,
finding the strings of frequent ones, cutting out what is repeated, removing bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm.common import partitions, whole

LENGTH, GRAM = 100, 20
BEFORE = LENGTH - GRAM
WIDTH = BEFORE + LENGTH
#: Bytes of text in a group of documents, and least bytes when there are few.
GROUP_BYTES, LEAST_BYTES = 4 << 20, 64 << 10
#: Groups of documents for each task that compares surroundings, at most.
GROUPS_A_TASK = 4
#: Anchors with more surroundings than this are dealt by their 100-byte strings.
HOT = 16_384
#: Surroundings that are cut out at a time.
SLICE = 16_384
#: Positions that are hashed at a time.
STEP = 1 << 20
NO_ID = -(1 << 63)
# Odd multipliers of the hashes; any would do.
M1, M2, M3, M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
BASES = (np.uint64(0x5851F42D4C957F2D), np.uint64(0xDA942042E4DD58B5))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 20 bytes from each position."""
    n = len(data) - GRAM + 1
    words = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    h = words[:n] * M1
    h ^= h >> np.uint64(29)
    h += words[8 : 8 + n] * M2
    h ^= words[GRAM - 8 : GRAM - 8 + n] * M3
    h ^= h >> np.uint64(31)
    h *= M4
    h ^= h >> np.uint64(32)
    return h


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each `width` neighbours."""
    span = 1
    while 2 * span <= width:
        values = pick(values[: len(values) - span], values[span:])
        span *= 2
    rest = width - span
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that winnowing picks; none crosses a document's end."""
    found, hashes, run = [], [], BEFORE + 1
    never = np.uint32(0xFFFFFFFF)
    for a in range(0, len(data), STEP):
        low, high = max(0, a - BEFORE), min(len(data), a + STEP + BEFORE + GRAM - 1)
        if high - low < GRAM:
            continue
        h = gram_hashes(np.ascontiguousarray(data[low:high]))
        order = (h >> np.uint64(32)).astype(np.uint32)
        np.minimum(order, never - 1, out=order)
        inner = ends[np.searchsorted(ends, low, "right") : np.searchsorted(ends, high, "right")]
        for back in range(1, GRAM):
            at = inner - back - low
            order[at[(at >= 0) & (at < len(order))]] = never
        edge = np.full(BEFORE, never, np.uint32)
        least = sliding(np.concatenate((edge, order, edge)), run, np.minimum)
        least[least == never] = 0
        chosen = (sliding(least, run, np.maximum) == order) & (order != never)
        at = np.flatnonzero(chosen[a - low : a - low + STEP]) + (a - low)
        found.append(at + low)
        hashes.append(h[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(found), np.concatenate(hashes)


class Docs:
    """The documents of one group as one run of bytes."""

    def __init__(self, table: pa.Table) -> None:
        texts = table.column("_text").combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if len(texts) else None
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.bounds = offsets - offsets[0]
        self.starts, self.ends = self.bounds[:-1], self.bounds[1:]
        numbers = lambda name: table.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
        # Documents stand in the order of id, hash of the text and row.
        self.ids, self.hashes, self.rows = (numbers(c) for c in ("_order", "_hash", "_row"))

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, behind each other."""
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(payloads: list[bytes], *kinds: tuple[str, int]) -> list[np.ndarray]:
    """The arrays of packed payloads, joined; a kind is a dtype and a row's width."""
    row = sum(np.dtype(k).itemsize * w for k, w in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for p in payloads:
        n, at = len(p) // row, 0
        for i, (k, w) in enumerate(kinds):
            a = np.frombuffer(p, k, n * w, at)
            out[i].append(a.reshape(n, w) if w > 1 else a)
            at += a.nbytes
    return [np.concatenate(x) if x else np.zeros((0, w) if w > 1 else 0, k) for x, (k, w) in zip(out, kinds, strict=True)]


ANCHOR = (("<u8", 1), ("<u2", 1))
#: id, hash and row of the document, place in it, then bytes before and behind the place and all of them.
CONTEXT = (("<i8", 1), ("<i8", 1), ("<i8", 1), ("<i4", 1), ("u1", 1), ("u1", 1), ("u1", WIDTH))
STRING = (("<i8", 1), ("<i8", 1), ("<i8", 1), ("<i4", 1), ("u1", LENGTH))
#: Row, start and end.
SPAN = (("<i8", 1), ("<i4", 1), ("<i4", 1))
ROWS = "_to int, _group int, _kind int, _payload binary"
ROWS_ARROW = pa.schema([("_to", pa.int32()), ("_group", pa.int32()), ("_kind", pa.int32()), ("_payload", pa.binary())])


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ROWS_ARROW)], schema=ROWS_ARROW)


def _by(key: np.ndarray, *arrays: np.ndarray):
    """(value, arrays' rows) for each value of key."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    cuts = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))
    for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
        yield int(sorted_[a]), [x[order[a:b]] for x in arrays]


def find_anchors(docs: Docs, group: int, tasks: int) -> list[tuple]:
    """Distinct anchors of a group of documents with their counts, packed for the tasks of their hashes."""
    _, h = anchors(docs.data, docs.ends)
    h, n = np.unique(h, return_counts=True)
    n = np.minimum(n, 65535).astype(np.uint16)
    return [(to, group, 0, pack(a, b)) for to, (a, b) in _by((h % np.uint64(tasks)).astype(np.int64), h, n)]


def repeated_anchors(groups: list[int], payloads: list[bytes], most: int) -> list[tuple]:
    """For each group the anchors that other groups have too; marked with 1 if they are hot, with more than `most` places."""
    h, n = unpack(payloads, *ANCHOR)
    group = np.repeat(groups, [len(p) // 10 for p in payloads])
    order = np.argsort(h, kind="stable")
    h, n, group = h[order], n[order].astype(np.int64), group[order]
    first = np.concatenate(([True], h[1:] != h[:-1]))
    number = np.cumsum(first) - 1
    seen, total = np.bincount(number), np.bincount(number, n)
    many = (seen[number] > 1) | (total[number] > most)
    hot = (total[number] > most).astype(np.uint16)
    return [(to, to, 0, pack(a, b)) for to, (a, b) in _by(group[many], h[many], hot[many])]


def same_bytes(rows: np.ndarray) -> np.ndarray:
    """For each row of bytes the number of the first row that equals it."""
    _, first, back = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}")[:, 0], return_index=True, return_inverse=True)
    return first[back]


class Contexts:
    """Distinct surroundings of anchors, those of the earliest documents, and the spans of all others."""

    def __init__(self, docs: Docs, at: np.ndarray, h: np.ndarray) -> None:
        doc = docs.doc_of(at)
        left, right = np.minimum(BEFORE, at - docs.starts[doc]), np.minimum(LENGTH, docs.ends[doc] - at)
        long = left + right >= LENGTH
        at, h, doc, left, right = (x[long] for x in (at, h, doc, left, right))
        order = np.lexsort((at, docs.rows[doc], docs.hashes[doc], docs.ids[doc]))
        at, self.h, doc, self.left, self.right = (x[order] for x in (at, h, doc, left, right))
        self.doc, self.place = doc, (at - docs.starts[doc]).astype(np.int32)
        parts, chosen = [], []
        span = np.arange(-BEFORE, LENGTH)
        for a in range(0, len(at), SLICE):
            where = at[a : a + SLICE, None] + span
            inside = (span >= -self.left[a : a + SLICE, None]) & (span < self.right[a : a + SLICE, None])
            part = np.zeros((len(where), WIDTH + 2), np.uint8)
            part[:, :WIDTH] = np.where(inside, docs.data[np.clip(where, 0, len(docs.data) - 1)], 0)
            part[:, WIDTH], part[:, WIDTH + 1] = self.left[a : a + SLICE], self.right[a : a + SLICE]
            own = np.flatnonzero(same_bytes(part) == np.arange(len(part)))
            parts.append(part[own])
            chosen.append(own + a)
        self.bytes = np.concatenate(parts) if parts else np.zeros((0, WIDTH + 2), np.uint8)
        kept = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        if len(parts) > 1:
            own = same_bytes(self.bytes) == np.arange(len(kept))
            self.bytes, kept = self.bytes[own], kept[own]
        later = np.ones(len(at), bool)
        later[kept] = False
        self.spans = (docs.rows[doc[later]], (self.place - self.left)[later], (self.place + self.right)[later])
        self.h, self.doc, self.left, self.right, self.place = (x[kept] for x in (self.h, self.doc, self.left, self.right, self.place))

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the 100-byte strings in the chosen surroundings: number of the surroundings, offset in them, hash; in order of time."""
        out = []
        top = np.uint64(pow(int(BASES[1]), LENGTH, 1 << 64))
        for a in range(0, len(which), SLICE):
            w = which[a : a + SLICE]
            h = np.zeros((len(w), WIDTH + 1), np.uint64)
            for j in range(WIDTH):
                h[:, j + 1] = h[:, j] * BASES[1] + self.bytes[w, j] + np.uint64(1)
            h = h[:, LENGTH:] - h[:, : WIDTH + 1 - LENGTH] * top
            offset = np.arange(BEFORE + 1)
            i, o = np.nonzero((offset >= BEFORE - self.left[w, None]) & (offset - BEFORE + LENGTH <= self.right[w, None]))
            out.append((w[i], o, h[i, o]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def cut(self, i: np.ndarray, o: np.ndarray) -> np.ndarray:
        """The bytes of strings."""
        return self.bytes.reshape(-1)[(i * (WIDTH + 2) + o)[:, None] + np.arange(LENGTH)]


def find_strings(docs: Docs, group: int, tasks: int, hot: np.ndarray) -> list[tuple]:
    """Distinct hashes of the strings around frequent anchors with their counts, packed for the tasks of the hashes."""
    if not len(hot):
        return []
    at, h = anchors(docs.data, docs.ends)
    chosen = np.isin(h, hot)
    found = Contexts(docs, at[chosen], h[chosen])
    h, n = np.unique(found.strings(np.arange(len(found.h)))[2], return_counts=True)
    n = np.minimum(n, 65535).astype(np.uint16)
    return [(to, group, 0, pack(a, b)) for to, (a, b) in _by((h % np.uint64(tasks)).astype(np.int64), h, n)]


def cut_contexts(docs: Docs, group: int, tasks: int, known: np.ndarray, hot: np.ndarray, strings: np.ndarray) -> list[tuple]:
    """Surroundings of repeated anchors, and repeated strings of hot ones. Copies within the group are settled here: the later ones become spans at once."""
    at, h = anchors(docs.data, docs.ends)
    _, back, n = np.unique(h, return_inverse=True, return_counts=True)
    chosen = (n[back] > 1) | np.isin(h, known)
    found = Contexts(docs, at[chosen], h[chosen])
    name = lambda doc: (docs.ids[doc], docs.hashes[doc], docs.rows[doc])
    spans, out = [found.spans], []
    warm = np.isin(found.h, hot)
    if warm.any():
        i, o, h = found.strings(np.flatnonzero(warm))
        _, back, n = np.unique(h, return_inverse=True, return_counts=True)
        elsewhere = np.isin(h, strings)
        few = np.flatnonzero((n[back] > 1) | elsewhere)
        few = few[np.lexsort((found.place[i[few]] + o[few], docs.rows[found.doc[i[few]]], docs.hashes[found.doc[i[few]]], docs.ids[found.doc[i[few]]]))]
        i, o, h, elsewhere = (x[few] for x in (i, o, h, elsewhere))
        begin, row = (found.place[i] + o - BEFORE).astype(np.int32), docs.rows[found.doc[i]]
        first, order = np.arange(len(i)), np.argsort(h, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1]))) if len(h) else np.zeros(0, np.int64)
        cuts = [0]
        for a in new[1:].tolist():  # whole runs of one hash, some at a time
            if a - cuts[-1] >= SLICE:
                cuts.append(a)
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            w = order[a:b]
            if len(w):
                by_time = np.sort(w)
                first[by_time] = by_time[same_bytes(found.cut(i[by_time], o[by_time]))]
        # A string may have several anchors; in its own place it is no copy.
        copy = (row != row[first]) | (begin != begin[first])
        spans.append((row[copy], begin[copy], begin[copy] + LENGTH))
        sent = np.flatnonzero((first == np.arange(len(i))) & elsewhere)
        for to, (w,) in _by((h[sent] % np.uint64(tasks)).astype(np.int64), sent):
            for a in range(0, len(w), 16 * SLICE):
                part = w[a : a + 16 * SLICE]
                out.append((to, group, 2, pack(*name(found.doc[i[part]]), begin[part], found.cut(i[part], o[part]))))
    cold = np.flatnonzero(~warm)
    for to, (w,) in _by((found.h[cold] % np.uint64(tasks)).astype(np.int64), cold):
        out.append((to, group, 0, pack(*name(found.doc[w]), found.place[w], found.left[w].astype(np.uint8), found.right[w].astype(np.uint8), found.bytes[w, :WIDTH])))
    rows, begin, end = (np.concatenate(x) for x in zip(*spans, strict=True))
    if len(rows):
        out.append((group % tasks, group, 1, pack(rows, begin.astype(np.int32), end.astype(np.int32))))
    return out


class HashedSuffixes:
    """Equally long byte rows that are compared by their common extension."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.hashes = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        for j in range(rows.shape[1]):
            self.hashes[:, j + 1] = self.hashes[:, j] * BASES[0] + rows[:, j] + np.uint64(1)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common start of rows a and b: a binary search over prefix hashes."""
        flat, wide = self.hashes.reshape(-1), self.hashes.shape[1]
        a, b = a * wide, b * wide
        low, step = np.zeros(len(a), np.int64), 1
        most = wide - 1
        while 2 * step <= most:
            step *= 2
        while step:
            tried = low + step
            ok = tried <= most
            tried = np.where(ok, tried, 0)
            low = np.where(ok & (flat[a + tried] == flat[b + tried]), tried, low)
            step //= 2
        return low

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether row a stands before row b."""
        n = self.extension(a, b)
        at = np.minimum(n, self.rows.shape[1] - 1)
        x, y = self.rows[a, at], self.rows[b, at]
        return (x < y) | ((x == y) & or_equal)

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted order and the extension of each row to the one before (0 for the first).

        A merge sort from below; all pairs of runs of one round are merged at once, each
        element finding its place in the other run by binary search.
        """
        n = len(self.rows)
        order, run = np.arange(n), 1
        place = np.arange(n)
        while run < n:
            base = place // (2 * run) * (2 * run)
            right = place - base >= run
            start = np.where(right, base, np.minimum(base + run, n))
            end = np.where(right, base + run, np.minimum(base + 2 * run, n))
            low, high = start.copy(), end.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                # Elements of the left run go before equals of the right one.
                before = self.less(order[mid], order[open_], right[open_])
                low[open_[before]] = mid[before] + 1
                high[open_[~before]] = mid[~before]
            to = place - np.where(right, run, 0) + (low - start)
            merged = np.full(n, -1)
            merged[to] = order
            if (merged < 0).any():
                break  # colliding hashes contradict each other
            order, run = merged, 2 * run
        shared = np.zeros(n, np.int64)
        if n > 1:
            shared[1:] = self.extension(order[1:], order[:-1])
            if not self.verified(order, shared):
                order = np.argsort(self.rows.copy().view(f"V{self.rows.shape[1]}")[:, 0], kind="stable")
                shared[1:] = (np.cumprod(self.rows[order[1:]] == self.rows[order[:-1]], axis=1)).sum(axis=1)
        return order, shared

    def verified(self, order: np.ndarray, shared: np.ndarray) -> bool:
        """Whether bytes bear out every neighbours' extension and order."""
        for a in range(1, len(order), 16384):
            up, low, n = self.rows[order[a - 1 : a + 16383][: len(order) - a]], self.rows[order[a : a + 16384]], shared[a : a + 16384]
            up = up[: len(low)]
            differs = up != low
            first = np.where(differs.any(axis=1), differs.argmax(axis=1), self.rows.shape[1])
            if not (first == n).all():
                return False
            at = np.minimum(first, self.rows.shape[1] - 1)[:, None]
            if not (np.take_along_axis(up, at, 1) <= np.take_along_axis(low, at, 1)).all():
                return False
        return True


def compared_contexts(groups: np.ndarray, ids, hashes, rows, place, left, right, context) -> tuple[np.ndarray, ...]:
    """Spans of contexts' strings that an earlier context has too: (group, row, start, end)."""
    left, right = left.astype(np.int64), right.astype(np.int64)
    time = np.lexsort((place, rows, hashes, ids))  # contexts from the earliest on
    groups, rows, place, left, right, context = (x[time] for x in (groups, rows, place, left, right, context))
    marked = np.concatenate((context, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)), axis=1)
    first = same_bytes(marked) == np.arange(len(rows))
    whole_ = tuple(x[~first] for x in (groups, rows, place - left, place + right))
    # Anchors with one context have no more copies.
    anchor = same_bytes(context[:, BEFORE:LENGTH])
    several = np.bincount(anchor[first], minlength=len(anchor))[anchor] > 1
    few = np.flatnonzero(first & several)
    if not len(few):
        return whole_
    found = _distinct_contexts(*(x[few] for x in (groups, rows, place, left, right, context)))
    return tuple(np.concatenate(x) for x in zip(whole_, found, strict=True))


def _distinct_contexts(groups, rows, place, left, right, context) -> tuple[np.ndarray, ...]:
    """compared_contexts for contexts in order of time that all differ, of anchors with more than one."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    order, shared = HashedSuffixes(np.ascontiguousarray(context[:, BEFORE:])).sorted()
    run = np.cumsum(shared < GRAM)
    keep = np.bincount(run)[run] > 1
    if not keep.any():
        return none
    kept = np.zeros(len(rows), bool)
    kept[order[keep]] = True
    at = np.flatnonzero(keep)
    shared_kept = shared[at]
    shared_kept[np.flatnonzero(np.diff(at) > 1) + 1] = 0  # what lay between was another anchor
    number = np.cumsum(kept) - 1
    right_order = number[order[keep]]
    groups, rows, place, left, right, context = (x[kept] for x in (groups, rows, place, left, right, context))
    left_order, left_shared = HashedSuffixes(np.ascontiguousarray(context[:, :BEFORE][:, ::-1])).sorted()
    n = len(rows)
    time = np.arange(n)
    most, least = np.full(n, -1), np.full(n, LENGTH)
    by_right, by_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for back in range(BEFORE + 1):
        by_right[right_order] = np.cumsum(shared_kept < LENGTH - back)
        by_left[left_order] = np.cumsum(left_shared < back) if back else 0
        fits = time[(left[time] >= back) & (right[time] >= LENGTH - back)]
        if len(fits) < 2:
            continue
        _, first = np.unique(by_right[fits] * (n + 1) + by_left[fits], return_index=True)
        later = np.ones(len(fits), bool)
        later[first] = False
        fits = fits[later]
        most[fits] = np.maximum(most[fits], back)
        least[fits] = np.minimum(least[fits], back)
    hit = most >= 0
    return groups[hit], rows[hit], (place - most)[hit], (place - least + LENGTH)[hit]


def compared_strings(groups: np.ndarray, ids, hashes, rows, begin, strings) -> tuple[np.ndarray, ...]:
    """Spans of the strings that have an earlier copy: (group, row, start, end)."""
    time = np.lexsort((begin, rows, hashes, ids))
    groups, rows, begin, strings = (x[time] for x in (groups, rows, begin, strings))
    order, shared = HashedSuffixes(strings).sorted()
    run = np.cumsum(shared < LENGTH) - 1
    first = np.full(len(order), len(order))
    np.minimum.at(first, run, order)
    copy = order[order != first[run]]
    return groups[copy], rows[copy], begin[copy], begin[copy] + LENGTH


def compare(groups: list[int], kinds: list[int], payloads: list[bytes]) -> list[tuple]:
    """Spans, packed for the groups of their documents, from all that came to one task."""
    by_kind = {k: [(g, p) for g, kind, p in zip(groups, kinds, payloads, strict=True) if kind == k] for k in (0, 1, 2)}
    out = [(g, g, 1, p) for g, p in by_kind[1]]
    size = lambda spec: sum(np.dtype(k).itemsize * w for k, w in spec)
    spans = []
    if by_kind[0]:
        group = np.repeat([g for g, _ in by_kind[0]], [len(p) // size(CONTEXT) for _, p in by_kind[0]])
        spans.append(compared_contexts(group, *unpack([p for _, p in by_kind[0]], *CONTEXT)))
    if by_kind[2]:
        group = np.repeat([g for g, _ in by_kind[2]], [len(p) // size(STRING) for _, p in by_kind[2]])
        spans.append(compared_strings(group, *unpack([p for _, p in by_kind[2]], *STRING)))
    if spans:
        group, rows, begin, end = (np.concatenate(x) for x in zip(*spans, strict=True))
        for g, arrays in _by(group, rows.astype(np.int64), begin.astype(np.int32), end.astype(np.int32)):
            out.append((g, g, 1, pack(*arrays)))
    return out


def remove_spans(docs: Docs, payloads: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Which bytes of the group's run go, and each document's rest."""
    rows, begin, end = unpack(payloads, *SPAN)
    change = np.zeros(len(docs.data) + 1, np.int32)
    if len(rows):
        own = np.argsort(docs.rows)
        doc = own[np.searchsorted(docs.rows, rows, sorter=own)]
        np.add.at(change, docs.starts[doc] + begin, 1)
        np.add.at(change, docs.starts[doc] + end, -1)
    gone = np.cumsum(change[:-1]) > 0
    return gone, [docs.data[a:b][~gone[a:b]].tobytes() for a, b in zip(docs.starts, docs.ends, strict=True)]


def task_count(n_groups: int, own: int) -> int:
    """Tasks of anchors: two for each shuffle partition, and so many that what comes to one doesn't grow with the input."""
    return max(1, min(2 * own, n_groups), -(-n_groups // GROUPS_A_TASK))


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot_places: int = HOT) -> DataFrame:
    """One row for each row of df: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay).

    A 100-byte string is a copy if it starts earlier too: in a smaller id, or further ahead in
    the same document. Null ids are the smallest; rows with one id follow each other in the
    order of their texts' 64-bit hashes, equal rows as they are read. Null counts as empty; texts
    under 100 bytes lose nothing, very long ones are worked on whole, by the worker that has their
    group. Ids are integers. An empty table gives an empty table; other columns don't matter.
    hot_places changes where strings are compared, not the result.
    """
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be an integer: the order of documents decides what is kept")
    spark = df.sparkSession
    own = partitions(spark)
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n_groups = max(-(-total // GROUP_BYTES), min(own, -(-total // LEAST_BYTES)), 1)
    tasks = task_count(n_groups, own)
    id_, row = F.col(id_col).cast("long"), F.monotonically_increasing_id()
    texts = df.select(id_.alias("_id"), F.coalesce(id_, F.lit(NO_ID)).alias("_order"), F.xxhash64(whole(text_col)).alias("_hash"), row.alias("_row"), whole(text_col).cast("binary").alias("_text"))
    texts = texts.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(n_groups)).cast("int"))

    def step1(table: pa.Table) -> pa.Table:
        return _rows(find_anchors(Docs(table), table.column("_group")[0].as_py(), tasks))

    def step2(table: pa.Table) -> pa.Table:
        return _rows(repeated_anchors(table.column("_group").to_pylist(), table.column("_payload").to_pylist(), hot_places))

    def find_frequent(table: pa.Table, lists: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([])
        known, hot = unpack(lists.column("_payload").to_pylist(), *ANCHOR)
        return _rows(find_strings(Docs(table), table.column("_group")[0].as_py(), tasks, known[hot == 1]))

    def cut_out(table: pa.Table, lists: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows([])
        by_kind = [[p for k, p in zip(lists.column("_kind").to_pylist(), lists.column("_payload").to_pylist(), strict=True) if k == kind] for kind in (0, 3)]
        (known, hot), (strings, _) = (unpack(p, *ANCHOR) for p in by_kind)
        return _rows(cut_contexts(Docs(table), table.column("_group")[0].as_py(), tasks, known, known[hot == 1], strings))

    def step4(table: pa.Table) -> pa.Table:
        return _rows(compare(table.column("_group").to_pylist(), table.column("_kind").to_pylist(), table.column("_payload").to_pylist()))

    def step5(table: pa.Table, lists: pa.Table) -> pa.Table:
        docs = Docs(table)
        gone, rest = remove_spans(docs, lists.column("_payload").to_pylist())
        counts = []
        for a, b in zip(docs.starts, docs.ends, strict=True):
            own_gone = gone[a:b]
            begins = own_gone & ~np.concatenate(([False], own_gone[:-1])) if b > a else own_gone
            counts.append((b - a, int(own_gone.sum()), int(begins.sum())))
        columns = [table.column("_id").combine_chunks(), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array([hashlib.sha256(r).hexdigest() for r in rest], pa.string())]
        names = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns.append(pa.array(rest, pa.binary()))
            names.append("kept")
        return pa.table(columns, names=names)

    by_group = texts.groupBy("_group")
    found = by_group.applyInArrow(step1, ROWS)
    lists = found.groupBy("_to").applyInArrow(step2, ROWS).drop("_group").withColumnRenamed("_to", "_group")
    strings = by_group.cogroup(lists.groupBy("_group")).applyInArrow(find_frequent, ROWS)
    repeated = strings.groupBy("_to").applyInArrow(step2, ROWS).drop("_group").withColumnRenamed("_to", "_group").withColumn("_kind", F.lit(3))
    cut = by_group.cogroup(lists.unionByName(repeated).groupBy("_group")).applyInArrow(cut_out, ROWS)
    spans = cut.groupBy("_to").applyInArrow(step4, ROWS).drop("_group").withColumnRenamed("_to", "_group")
    schema = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    out = by_group.cogroup(spans.groupBy("_group")).applyInArrow(step5, schema)
    return out.withColumnRenamed("_id", id_col)

"""External induced suffix sorting with common-prefix values, in bulk.

A text of bytes (fragments with a terminator after each) is sorted by its suffixes as induced sorting does:
suffixes are of type S or L; the S* suffixes (S after L) are sorted first, by naming the substrings between
them and recursing on the names; all L suffixes are then induced in ascending order and all S suffixes in
descending order. Induction runs through priority queues whose key is the first symbol and whose order within
a key is that of insertion, so a tuple (position, common prefix with the tuple before it in the same key) is
pushed when its successor suffix is popped, and never searched for. Common-prefix values are carried along: two
tuples that follow each other in a key share one symbol more than the least value between their successors.

The queues keep ``memory`` tuples in memory and spill their longest keys' runs to files of the task's own
temporary folder, which are deleted as they are read, like Spark's own spill. The recursion on names doubles
the length compared in each level and ends when ``depth`` symbols are compared, since nobody asks for more.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

NEVER = np.iinfo(np.int16).max
SYMBOLS = 258  # 0 ends the text, 1 ends a fragment, byte b is b + 2


class BulkQueue:
    """A disk-backed priority queue of (position, common prefix) tuples by symbol, popped a key at a time."""

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0
        self.runs: list[list[tuple[np.ndarray, np.ndarray] | str]] = [[] for _ in range(SYMBOLS)]
        self.sizes = [0] * SYMBOLS
        self.folder: tempfile.TemporaryDirectory | None = None
        self.files = 0

    def push(self, key: int, position: np.ndarray, common: np.ndarray) -> None:
        self.runs[key].append((position, common))
        self.sizes[key] += len(position)
        self.held += len(position)
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        """Write the longest key's runs out as one run."""
        key = max(range(SYMBOLS), key=self.sizes.__getitem__)
        kept = [r for r in self.runs[key] if not isinstance(r, str)]
        if self.sizes[key] < 1024 or not kept:
            return
        self.folder = self.folder or tempfile.TemporaryDirectory()
        path = os.path.join(self.folder.name, f"{self.files}.npy")
        self.files += 1
        np.save(path, np.stack([np.concatenate([r[0] for r in kept]), np.concatenate([r[1] for r in kept]).astype(np.int32)]))
        at = next(i for i, r in enumerate(self.runs[key]) if not isinstance(r, str))
        self.runs[key] = [*self.runs[key][:at], path]
        self.held -= self.sizes[key]
        self.sizes[key] = 0

    def pop(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples of a key, those pushed meanwhile too, in order of insertion."""
        while self.runs[key]:
            run = self.runs[key].pop(0)
            if isinstance(run, str):
                both = np.load(run)
                os.remove(run)
                yield both[0], both[1].astype(np.int16)
            else:
                self.held -= len(run[0])
                self.sizes[key] = max(0, self.sizes[key] - len(run[0]))
                yield run

    def close(self) -> None:
        if self.folder:
            self.folder.cleanup()


class Induction:
    """One scan: pops sources in order and pushes their predecessors with common-prefix values.

    ``carry`` False leaves the values out, where only the order is asked for.
    """

    def __init__(self, text: np.ndarray, memory: int, carry: bool):
        self.text, self.queue, self.carry = text, BulkQueue(memory), carry
        self.low = np.full(SYMBOLS, NEVER, np.int16)  # least common prefix since a key's last push
        self.pushed = np.zeros(SYMBOLS, bool)

    def feed(self, common: np.ndarray, position: np.ndarray, induces: np.ndarray) -> None:
        """``common``: each popped tuple's common prefix with the one popped before it."""
        at = np.flatnonzero(induces)
        if not self.carry:
            keys = self.text[position[at] - 1]
            order = np.argsort(keys, kind="stable")
            for key, mine in self.by_key(keys[order], at[order]):
                self.queue.push(key, position[mine] - 1, common[: len(mine)])
            return
        if len(position) <= 4:  # long runs of one symbol come a few tuples at a time
            for k in range(len(position)):
                np.minimum(self.low, common[k], out=self.low)
                if induces[k]:
                    key = int(self.text[position[k] - 1])
                    least = self.low[key] + 1 if self.pushed[key] else 0
                    self.queue.push(key, position[k : k + 1] - 1, np.array([least], np.int16))
                    self.low[key], self.pushed[key] = NEVER, True
            return
        keys = self.text[position[at] - 1]
        order = np.argsort(keys, kind="stable")
        before = self.low.copy()
        np.minimum(self.low, common.min(), out=self.low)  # for keys without a push here
        for key, mine in self.by_key(keys[order], at[order]):
            least = np.empty(len(mine), np.int16)
            least[0] = min(before[key], common[: mine[0] + 1].min()) + 1 if self.pushed[key] else 0
            if len(mine) > 1:
                least[1:] = np.minimum.reduceat(common[: mine[-1] + 1], mine[:-1] + 1) + 1
            self.queue.push(key, position[mine] - 1, least)
            rest = common[mine[-1] + 1 :]
            self.low[key], self.pushed[key] = rest.min() if len(rest) else NEVER, True

    @staticmethod
    def by_key(keys: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if len(keys):
            edge = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for part, key in zip(np.split(at, edge), keys[np.concatenate([[0], edge])].tolist(), strict=True):
                yield key, part


def common_prefix(text: np.ndarray, a: int, b: int, depth: int) -> int:
    """Symbols that two suffixes share, up to ``depth``."""
    n = min(depth, len(text) - max(a, b))
    differ = np.flatnonzero(text[a : a + n] != text[b : b + n])
    return int(differ[0]) if len(differ) else n


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """The same for many pairs, four symbols at a time. The only 0 ends the text, so no pair runs past it."""
    out = np.zeros(len(a), np.int16)
    padded = np.concatenate([text, np.zeros(8, text.dtype)])
    four = np.ndarray((len(text) + 4,), np.uint64, padded, 0, (2,))
    live = np.arange(len(a))
    for k in range(0, depth, 4):
        x = four[a[live] + k] ^ four[b[live] + k]
        same = x == 0
        rest = x[~same]
        # The lowest set bit lies in the first symbol that differs.
        out[live[~same]] = k + (np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)) >> 4)
        live = live[same]
        if not len(live):
            break
    out[live] = depth
    return np.minimum(out, depth)


def types(text: np.ndarray) -> np.ndarray:
    """True for S: smaller than the next suffix. A run of equal symbols has the type of its last one."""
    n = len(text)
    s = np.zeros(n, bool)
    s[-1] = True
    step = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]]))  # last of each run
    kind = np.concatenate([text[step[:-1]] < text[step[1:]], [True]])
    return np.repeat(kind, np.diff(np.concatenate([[-1], step])))


def induce(text: np.ndarray, s: np.ndarray, star: np.ndarray, star_common: np.ndarray | None, depth: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, with common prefixes (up to ``depth``), from the S* suffixes in order.

    Without ``star_common`` only the order counts.
    """
    carry = star_common is not None
    star_common = star_common if carry else np.zeros(len(star), np.int16)
    start = np.searchsorted(text[star], np.arange(SYMBOLS + 1))
    shared = lambda a, b: common_prefix(text, a, b, depth) if carry and a >= 0 else 0
    up = Induction(text, memory, carry)
    large: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(SYMBOLS)]
    for key in range(SYMBOLS):
        last = -1
        for position, common in up.queue.pop(key):
            common = np.minimum(common, depth)
            if last < 0:
                common[0] = 0
            large[key].append((position, common))
            last = int(position[-1])
            up.feed(common, position, (position > 0) & (text[position - 1] >= key))
        mine = star[start[key] : start[key + 1]]
        if len(mine):
            common = star_common[start[key] : start[key + 1]].copy()
            common[0] = shared(last, int(mine[0]))
            up.feed(common, mine, mine > 0)
    up.queue.close()
    down = Induction(text, memory, carry)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for key in range(SYMBOLS - 1, -1, -1):
        last = -1
        for position, common in down.queue.pop(key):
            common = np.minimum(common, depth)
            if last < 0:
                common[0] = 0
            parts.append((position, common))
            last = int(position[-1])
            down.feed(common, position, (position > 0) & (text[position - 1] <= key) & s[position - 1])
        if key == 0:  # the end of the text, which no suffix follows
            parts.append((np.array([len(text) - 1], np.int32), np.zeros(1, np.int16)))
        if large[key]:
            position = np.concatenate([x[0] for x in large[key]])[::-1]
            common = np.concatenate([x[1] for x in large[key]])
            # Descending: each value belongs to the pair with the tuple after it.
            back = np.concatenate([common[:1], common[1:][::-1]])
            back[0] = shared(last, int(position[0]))
            large[key] = []
            down.feed(back, position, (position > 0) & s[position - 1])
            parts.append((position, back))
    down.queue.close()
    order = np.concatenate([p[0] for p in parts])[::-1]
    common = np.concatenate([p[1] for p in parts])[::-1]
    # Descending values pair each suffix with the larger one before it in that scan; shift to the smaller one.
    return order, np.concatenate([np.zeros(1, np.int16), common[:-1]])


def sort_stars(text: np.ndarray, star: np.ndarray, s: np.ndarray, depth: int, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """S* suffixes in order (up to ``depth`` symbols), with common prefixes."""
    if len(star) < 2:
        return star, np.zeros(len(star), np.int16)
    # Sorting by first symbol alone and inducing sorts the substrings between S* suffixes.
    order, _ = induce(text, s, star[np.argsort(text[star], kind="stable")], None, 1, memory)
    is_star = np.zeros(len(text), bool)
    is_star[star] = True
    ranked = order[is_star[order]]
    del order, is_star
    end = np.full(len(text), len(text), np.int32)
    end[star] = np.concatenate([star[1:], [len(text) - 1]])
    a, b = ranked[:-1], ranked[1:]
    span = end[a] - a + 1
    # Substrings longer than ``depth`` need no more than that compared.
    need = np.minimum(span, depth)
    same = ((span == end[b] - b + 1) | (need == depth)) & (common_prefixes(text, a, b, depth) >= need)
    names = np.zeros(len(text), np.int32)
    names[ranked] = np.concatenate([[0], np.cumsum(~same)])
    rank = names[star].astype(np.int64) + 1
    del end, names, a, b, span, need, same
    reach = 1
    while rank.max() < len(star) and reach < depth:
        pair = rank * (len(star) + 2) + np.concatenate([rank[reach:], np.zeros(min(reach, len(star)), np.int64)])[: len(star)]
        by = np.argsort(pair, kind="stable")
        new = np.empty(len(star), np.int64)
        new[by] = np.cumsum(np.concatenate([[True], pair[by][1:] != pair[by][:-1]]))
        rank, reach = new, reach * 2
    order = star[np.argsort(rank, kind="stable")]
    return order, np.concatenate([np.zeros(1, np.int16), common_prefixes(text, order[:-1], order[1:], depth)])


def suffix_order(text: np.ndarray, depth: int, memory: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before it), both exact up to ``depth`` symbols.

    ``text`` holds symbols 1 to 257 as int16 and ends with its only 0.
    """
    s = types(text)
    star = np.flatnonzero(s & ~np.concatenate([[True], s[:-1]])).astype(np.int32)
    order, common = sort_stars(text, star, s, depth, memory)
    return induce(text, s, order, common, depth, memory)

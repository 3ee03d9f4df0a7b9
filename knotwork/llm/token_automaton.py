"""Byte-pair merges compiled into a deterministic automaton.

Merge gadgets. Start with one state in which every base symbol loops. Applying a merge (u, v) -> w in order of
rank adds one gadget: the target of the u-arcs is copied without its v-arc, all u-arcs go to the copy, and
every state that has a u-arc gets a w-arc to the old target of v. A token sequence is the encoding of its text
if and only if the automaton accepts it. Each merge adds one state, and all arcs of a token lead to one state,
so the automaton is kept as its gadgets: when a token was made, from which two, and when a pair was merged.
``arc`` reads off whether a token has an arc after another; answers that were asked for are kept in a table.

Determinization. Over base symbols the automaton is unambiguous: of all ways to cut a prefix into tokens
exactly one is accepted. The subset construction follows the live ways at once. A state is the set of (place
in the token trie, token before it, tokens so far); its root entry names the last token of the encoding of the
prefix read, and a transition is annotated with the change in the number of tokens. States and transitions are
made when first needed, as lazy regex automata do, and the table is dropped when it reaches ``max_states``, in the
middle of a word too, so memory is bounded whatever the texts hold.
"""

from __future__ import annotations

from collections.abc import Iterable

NONE, UNKNOWN = -1, -2
BIAS = 1 << 15


def pack(node: int, before: int, count: int) -> int:
    """An entry of a state as one number, which keeps the table small."""
    return node << 38 | (before + 2) << 16 | (count + BIAS)


def unpack(entry: int) -> tuple[int, int, int]:
    return entry >> 38, (entry >> 16 & 0x3FFFFF) - 2, (entry & 0xFFFF) - BIAS


class MergeAutomaton:
    """Tokens are numbered by the caller; ``base`` maps base symbols (small ints) to their tokens."""

    def __init__(self, base: dict[int, int], merges: Iterable[list[tuple[int, int, int]]], spelling: dict[int, list[int]], max_states: int = 300_000):
        """``merges``: by rank, all (left, right, product) of that rank. ``spelling``: a token's base symbols."""
        self.made: dict[int, int] = {t: -1 for t in base.values()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.merged: dict[int, int] = {}
        for rank, group in enumerate(merges):
            usable = [(u, v, w) for u, v, w in group if u in self.made and v in self.made]
            fresh = [(u, v, w) for u, v, w in usable if w not in self.made and self.arc(u, v, rank)]
            for u, v, _ in usable:
                self.merged.setdefault(u << 21 | v, rank)
            for u, v, w in fresh:
                if w not in self.made:
                    self.made[w], self.left[w], self.right[w] = rank, u, v
        self.trie: dict[int, int] = {}
        self.token_at: list[int] = [NONE]
        self.inner: set[int] = set()
        for token in self.made:
            node = 0
            for symbol in spelling[token]:
                child = self.trie.get(node << 21 | symbol)
                if child is None:
                    child = self.trie[node << 21 | symbol] = len(self.token_at)
                    self.token_at.append(NONE)
                    self.inner.add(node)
                node = child
            self.token_at[node] = token
        self.table: dict[int, bool] = {}
        self.max_states = max_states
        self.reset()

    def arc(self, a: int, b: int, time: float = float("inf")) -> bool:
        """Whether token ``b`` has an arc after token ``a`` once all merges before ``time`` are applied."""
        made, merged = self.made, self.merged
        while True:
            rank = merged.get(a << 21 | b)
            if rank is not None and rank < time:
                return False
            ta, tb = made[a], made[b]
            if ta < 0 and tb < 0:
                return True
            if a == b:
                a, b, time = self.right[a], self.left[b], ta
            elif ta > tb:
                a, time = self.right[a], ta
            else:
                b, time = self.left[b], tb + 1

    def accepts(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        key = a << 21 | b
        known = self.table.get(key)
        if known is None:
            if len(self.table) > 2 * self.max_states:
                self.table.clear()
            known = self.table[key] = self.arc(a, b)
        return known

    def reset(self) -> None:
        """Drop the determinized table; state 0 is the start."""
        self.entries: list[tuple[int, ...]] = [(pack(0, NONE, 0),)]
        self.last: list[int] = [NONE]
        self.number: dict[tuple[int, ...], int] = {self.entries[0]: 0}
        self.next: dict[int, int] = {}

    def step(self, state: int, symbol: int, unknown_width: int = 1) -> int:
        """The move on one more symbol, ``next state << 16 | change in the number of tokens + BIAS``; fills the table."""
        live: list[tuple[int, int, int]] = []
        last, change = NONE, 0
        for entry in self.entries[state]:
            node, before, count = unpack(entry)
            child = self.trie.get(node << 21 | symbol)
            if child is None:
                continue
            if child in self.inner:
                live.append((child, before, count))
            token = self.token_at[child]
            if token >= 0 and last < 0 and self.accepts(before, token):
                last, change = token, count + 1
        if last < 0:  # a symbol that no token holds
            last, change, live = UNKNOWN, unknown_width, []
        key = (*sorted(pack(n, b, c - change) for n, b, c in live), pack(0, last, 0))
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.entries)
            self.entries.append(key)
            self.last.append(last)
        move = self.next[state << 21 | symbol] = at << 16 | (change + BIAS)
        return move

    def restart(self, state: int) -> int:
        """Drop the table in the middle of a word; the state one is in is carried over, under its new number."""
        entry, last = self.entries[state], self.last[state]
        self.reset()
        if entry in self.number:
            return self.number[entry]
        self.number[entry] = len(self.entries)
        self.entries.append(entry)
        self.last.append(last)
        return self.number[entry]

    def full(self) -> bool:
        return len(self.entries) >= self.max_states

    def encode(self, symbols: list[int], length: dict[int, int]) -> list[int]:
        """Tokens of one word by table-driven transitions; ``length``: symbols of a token."""
        state, lasts = 0, []
        moves, last = self.next, self.last
        for s in symbols:
            move = moves.get(state << 21 | s)
            if move is None:
                if self.full():
                    state = self.restart(state)
                    moves, last = self.next, self.last
                move = self.step(state, s)
            state = move >> 16
            lasts.append(last[state])
        out, at = [], len(symbols)
        while at:
            token = lasts[at - 1]
            out.append(token)
            at -= length[token]
        return out[::-1]

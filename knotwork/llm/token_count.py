"""Token counts by a compiled finite-state transducer, for sentencepiece BPE models with byte fallback.

The model's pieces are compiled by :mod:`token_automaton`; a transition is annotated with the change in the
number of tokens that its character causes. No piece has a space mark after another character, so wherever a
space follows a non-space the transducer returns to its start state, whatever it has read. The map that a chunk
of text applies to a state is therefore small: up to its first such place it depends on the entry state (the
``head``, kept as text), after it on nothing: a count and an exit state. Such maps compose associatively, so
the chunks of a long text are mapped independently and combined by a prefix scan (a balanced reduction, since
only the last prefix is asked for). Words repeat, so the map of a whole word from the start state is kept in a
bounded table.

Runs of spaces: pieces of several space marks all have the same, lowest score, so a run is merged after all
else and from its left: pieces of the greatest length, then what the rest merges into.

Defined results: null and empty texts have no tokens; texts of any length are counted whole; every row gives
one row; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_text, texts
from .token_automaton import BIAS, MergeAutomaton

MARK = "▁"
CHUNK = 1 << 16
MAX_WORDS, LONG_WORD = 200_000, 64  # words kept, and the longest one that is


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does: ``head`` is read from the entry state; then, if ``count`` is not None, that many
    tokens follow and the transducer has read ``spaces`` marks and ``tail`` since its start state."""

    head: str
    count: int | None = None
    spaces: int = 0
    tail: str = ""


class CountingTransducer:
    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        special = lambda i: sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i)
        pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not special(i)}
        runs = {p for p in pieces if len(p) > 1 and not p.strip(MARK)}
        if any(MARK in p.lstrip(MARK) for p in pieces) or any(p.startswith(MARK * 2) for p in pieces if p not in runs):
            raise ValueError("a piece has a space mark after another character")
        self.run_sizes = {len(p) for p in runs}
        self.longest_run = max(self.run_sizes, default=1)
        words = [p for p in pieces if p not in runs]
        ranked = sorted((p for p in words if len(p) > 1), key=lambda p: -sp.get_score(pieces[p]))
        groups, last = [], None
        for p in ranked:
            if (score := sp.get_score(pieces[p])) != last:
                groups.append([])
                last = score
            groups[-1] += [(pieces[p[:k]], pieces[p[k:]], pieces[p]) for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces]
        spelling = {pieces[p]: [ord(c) for c in p] for p in words}
        self.automaton = MergeAutomaton({ord(p): pieces[p] for p in words if len(p) == 1}, groups, spelling)
        self.mark = pieces[MARK]
        self.words: dict[str, int] = {}
        self.bare: dict[str, bool] = {}

    def step(self, state: int, c: int) -> int:
        """A move that the table lacks; a character that no piece holds falls back to its UTF-8 bytes."""
        return self.automaton.step(state, c, 1 if c < 0x80 else 2 if c < 0x800 else 3 if c < 0x10000 else 4)

    def word(self, word: str) -> int:
        """Tokens of a space mark and a word, from the start state."""
        known = self.words.get(word)
        if known is None:
            a = self.automaton
            state = known = 0
            moves = a.next
            for c in chain((0x2581,), map(ord, word)):
                move = moves.get(state << 21 | c)
                if move is None:
                    if a.full():
                        state = a.restart(state)
                        moves = a.next
                    move = self.step(state, c)
                state = move >> 16
                known += (move & 0xFFFF) - BIAS
            if len(word) <= LONG_WORD:
                if len(self.words) >= MAX_WORDS:
                    self.words.clear()
                self.words[word] = known
        return known

    def starts_bare(self, word: str) -> bool:
        """Whether the mark before a word stays a token of its own."""
        known = self.bare.get(word)
        if known is None:
            a = self.automaton
            symbols = [0x2581, *map(ord, word)]
            state, lasts = 0, []
            for s in symbols:
                move = a.next.get(state << 21 | s)
                if move is None:
                    if a.full():
                        state = a.restart(state)
                    move = self.step(state, s)
                state = move >> 16
                lasts.append(a.last[state])
            at = len(symbols)
            while at > 1:
                at -= len(self.piece(lasts[at - 1]))
            known = at == 1
            if len(word) <= LONG_WORD:
                if len(self.bare) >= MAX_WORDS:
                    self.bare.clear()
                self.bare[word] = known
        return known

    def piece(self, token: int) -> list[int]:
        if not hasattr(self, "spelled"):
            a = self.automaton
            self.spelled = {}
            stack = [(0, [])]
            children: dict[int, list[tuple[int, int]]] = {}
            for edge, child in a.trie.items():
                children.setdefault(edge >> 21, []).append((edge & 0x1FFFFF, child))
            while stack:
                node, path = stack.pop()
                if a.token_at[node] >= 0:
                    self.spelled[a.token_at[node]] = path
                stack += [(child, [*path, symbol]) for symbol, child in children.get(node, [])]
        return self.spelled.get(token, [0])

    def run(self, n: int) -> int:
        """Tokens of a run of ``n`` marks: whole longest pieces from the left, then the merges of the rest."""
        whole, rest = divmod(n, self.longest_run)
        sizes = [1] * rest
        at = 0
        while at + 1 < len(sizes):  # the leftmost pair that is a piece merges first
            if sizes[at] + sizes[at + 1] in self.run_sizes:
                sizes[at : at + 2] = [sizes[at] + sizes[at + 1]]
                at = max(0, at - 1)
            else:
                at += 1
        return whole + len(sizes)

    def closed(self, spaces: int, word: str) -> int:
        """Tokens of ``spaces`` marks and a word (which may be empty) between two returns to the start state."""
        if not word:
            return self.run(spaces)
        if spaces == 1:
            return self.word(word)
        return self.word(word) + (self.run(spaces) - 1 if self.starts_bare(word) else self.run(spaces - 1))

    def chunk_map(self, chunk: str) -> ChunkMap:
        at = 0
        while True:  # the first space after a non-space
            at = chunk.find(" ", at + 1)
            if at < 0:
                return ChunkMap(chunk)
            if chunk[at - 1] != " ":
                break
        parts = chunk[at + 1 :].split(" ")
        tail = parts.pop()
        get = self.words.get
        count, spaces = 0, 1
        found = [get(w) for w in parts]
        if None not in found and "" not in parts:
            count = sum(found)
        else:
            for w in parts:
                if w:
                    count += self.closed(spaces, w)
                    spaces = 1
                else:
                    spaces += 1
        return ChunkMap(chunk[:at], count, spaces, tail)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First ``a``, then ``b``."""
        if a.count is None:
            return ChunkMap(a.head + b.head, b.count, b.spaces, b.tail) if not self.joins(a.head, b.head) else self.rejoin(a.head, b)
        spaces, tail, count = a.spaces, a.tail, a.count
        for k, w in enumerate(b.head.split(" ")):
            if k:
                if tail:
                    count += self.closed(spaces, tail)
                    spaces, tail = 1, ""
                else:
                    spaces += 1
            tail += w
        if b.count is None:
            return ChunkMap(a.head, count, spaces, tail)
        return ChunkMap(a.head, count + self.closed(spaces, tail) + b.count, b.spaces, b.tail)

    @staticmethod
    def joins(head: str, more: str) -> bool:
        """Whether two heads put together hold a space after a non-space, at the seam."""
        return bool(head) and head[-1] != " " and more[:1] == " "

    def rejoin(self, head: str, b: ChunkMap) -> ChunkMap:
        return self.compose(ChunkMap(head, 0, 1, ""), ChunkMap(b.head[1:], b.count, b.spaces, b.tail))

    def count(self, text: str) -> int:
        if not text:
            return 0
        line = text.replace(MARK, " ") if MARK in text else text
        maps = [self.chunk_map(line[a : a + CHUNK]) for a in range(0, len(line), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        whole = self.compose(ChunkMap("", 0, 1, ""), maps[0])  # from the start state, after the mark put before a text
        return whole.count + self.closed(whole.spaces, whole.tail)


@cache
def transducer(model_file: str) -> CountingTransducer:
    """Compiled once in each worker."""
    return CountingTransducer(model_file)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def one(text: bytes | None) -> tuple[int, int, bool]:
        n = transducer(model_file).count(text.decode()) if text else 0
        return len(text or b""), n, n > limit

    return texts(docs).mapInArrow(per_text(one, schema), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""BPE encoding and decoding with a tokenization automaton.

The merges of a word-level BPE tokenizer file (byte-level alphabet, end-of-word marks, lower case, white space
dropped) are compiled by :mod:`token_automaton`. Texts are split as the file says: added tokens first, then
normalization, then words; each word is encoded by table-driven transitions over its bytes (the last byte
carries the end-of-word mark), and decoding emits the arcs' labels.

Texts whose characters all lie below U+0250 are normalized and split here; for others the tokenizer file's own
normalizer and word splitter are called, since their Unicode tables decide.

Defined results: null and empty texts have no ids and decode to an empty text; special strings in a text
become their added tokens; every row gives one row; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import per_text, sha256_hex, texts
from .token_automaton import MergeAutomaton

SPACES = r" \t\n\v\f\r\x85\xa0"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
ASCII_WORDS = re.compile(rf"{CONTRACTIONS}|[a-z]+|[0-9]|[^ \t\n\v\f\ra-z0-9]+")
LATIN_WORDS = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")
MAX_WORDS, LONG_WORD = 150_000, 64  # words kept, and the longest one that is


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [""] * 256, 0
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + spare)
            spare += 1
    return letters


class BpeCodec:
    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_at = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        library = Tokenizer.from_file(tokenizer_file)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        letters = byte_letters()
        self.of_letter = {c: b for b, c in enumerate(letters)}
        base = {b: vocab[c] for b, c in enumerate(letters)} | {256 + b: vocab[c + self.suffix] for b, c in enumerate(letters)}
        merges = [[(vocab[u], vocab[v], vocab[u + v])] for u, v in model["merges"]]
        spelling = {i: self.spell(t) for t, i in vocab.items()}
        self.length = {i: len(s) for i, s in spelling.items()}
        self.automaton = MergeAutomaton(base, merges, spelling)
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.labels = [""] * size
        for t, i in [*vocab.items(), *self.added.items()]:
            self.labels[i] = t
        self.names = [str(i) for i in range(size)]
        self.words: dict[str, tuple[int, ...]] = {}
        self.max_words = MAX_WORDS
        self.ids = list(range(size))  # one object for each id

    def release(self) -> None:
        """Empty the tables that grow with texts."""
        self.words.clear()
        self.automaton.table.clear()
        self.automaton.reset()

    def spell(self, token: str) -> list[int]:
        last = token.endswith(self.suffix)
        letters = [self.of_letter[c] for c in (token[: -len(self.suffix)] if last else token)]
        return [*letters[:-1], 256 + letters[-1]] if last and letters else letters

    def word(self, word: str, letters: bytes | None = None) -> tuple[int, ...]:
        known = self.words.get(word)
        if known is None:
            symbols = list(word.encode() if letters is None else letters)
            symbols[-1] += 256
            known = tuple([self.ids[i] for i in self.automaton.encode(symbols, self.length)])
            if len(word) <= LONG_WORD:
                if len(self.words) >= self.max_words:
                    self.words.clear()
                self.words[word] = known
        return known

    def section(self, text: str, out: list[int]) -> None:
        """Ids of a text without added tokens."""
        if text.isascii():
            found = ASCII_WORDS.findall(text.lower())
        elif max(text) < "ɐ":
            found = LATIN_WORDS.findall(text.lower())
        else:
            of = self.of_letter
            for piece, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text)):
                raw = bytes([of[c] for c in piece])
                out += self.word(raw.decode(errors="surrogateescape"), raw)
            return
        get = self.words.get
        for w in found:
            out += get(w) or self.word(w)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.added_at.finditer(text) if self.added_at else ():
            if m.start() > at:
                self.section(text[at : m.start()], out)
            out.append(self.added[m[0]])
            at = m.end()
        if at < len(text):
            self.section(text[at:] if at else text, out)
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so labels stand side by side with a space between."""
        labels = self.labels
        return " ".join([labels[i] for i in ids])

    def text_of(self, ids: list[int]) -> str:
        """Readable text: labels back to bytes, end-of-word marks to spaces."""
        out = bytearray()
        special = set(self.added.values())
        for i in ids:
            if i in special:
                out += self.labels[i].encode() + b" "
                continue
            for s in self.spell(self.labels[i]):
                out.append(s & 0xFF)
                if s > 255:
                    out += b" "
        return out.decode(errors="replace").rstrip(" ")


@cache
def codec(tokenizer_file: str) -> BpeCodec:
    """Compiled once in each worker."""
    return BpeCodec(tokenizer_file)


def encode(docs: DataFrame, tokenizer_file: str, max_states: int = 300_000, max_words: int = MAX_WORDS, keep_tables: bool = True) -> DataFrame:
    """doc_id and ids (array of int).

    ``max_states`` and ``max_words`` bound the tables of a worker; with ``keep_tables`` False a task empties them
    when it ends, which leaves their memory to whatever the worker does next.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    one = lambda text: (codec(tokenizer_file).encode(text.decode()) if text else [],)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = codec(tokenizer_file)
        tables.max_words, tables.automaton.max_states = max_words, max_states
        yield from per_text(one, schema, 128)(batches)
        if not keep_tables:
            tables.release()

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id and text, from the output of :func:`encode`."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.string())])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                ids = batch.column(1).slice(a, 128).to_pylist()
                out = [None if x is None else codec(tokenizer_file).decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 128), pa.array(out, type=pa.string())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string")


def round_trip(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded again in one pass."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def one(text: bytes | None) -> tuple[int, str, str]:
        c = codec(tokenizer_file)
        ids = c.encode(text.decode()) if text else []
        names = c.names
        return len(ids), sha256_hex(" ".join([names[i] for i in ids]).encode()), sha256_hex(c.decode(ids).encode())

    return texts(docs).mapInArrow(per_text(one, schema), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from knotwork.llm import bpe, token_automaton, token_count

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["abc", "  ", "é", "ß", "Σς", "中文", "\n\t", "'s", "'LL", "12", "½", "<|endoftext|>", "<|startoftext|>", "!!", "\x1c", "\x85", "\xa0", "İ", "🎉", "é", "▁", "</s>", "<0x0A>", "the ", "q", "zzz", "aaaa", "   ", "ª²", "ﬁ", "K", "don't"]


@pytest.fixture(scope="module")
def fuzz():
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(800)]
    texts += ["".join(rng.choice("aeinrst ") for _ in range(60)) for _ in range(400)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x250), rng.randrange(0x370, 0x530)])) for _ in range(30)) for _ in range(400)]
    return texts + [" " * k + "x" + " " * (k // 2) for k in range(70)] + [" " * k + "中" + " " * k for k in range(40)] + ["a" * 5000, ""]


def test_encode_and_decode_equal_the_library(fuzz):
    library, mine = Tokenizer.from_file(WORDS), bpe.BpeCodec(WORDS)
    for text, e in zip(fuzz, library.encode_batch(fuzz, add_special_tokens=False), strict=True):
        assert mine.encode(text) == e.ids, text
        assert mine.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)


def test_counts_equal_the_library_for_any_cut(fuzz, monkeypatch):
    library, mine = sentencepiece.SentencePieceProcessor(model_file=MODEL), token_count.CountingTransducer(MODEL)
    expected = [len(library.encode(t)) for t in fuzz]
    for chunk in (1 << 16, 13, 1):
        monkeypatch.setattr(token_count, "CHUNK", chunk)
        assert [mine.count(t) for t in fuzz] == expected


def test_chunk_maps_compose_in_any_grouping(fuzz):
    t = token_count.CountingTransducer(MODEL)
    for text in fuzz[:150]:
        line = text.replace("▁", " ")
        a, b, c = (t.chunk_map(x) for x in (line[:7], line[7:20], line[20:]))
        start = token_count.ChunkMap("", 0, 1, "")
        assert t.compose(t.compose(start, a), t.compose(b, c)) == t.compose(t.compose(t.compose(start, a), b), c)


def test_small_state_table_changes_nothing(fuzz):
    small, large = bpe.BpeCodec(WORDS), bpe.BpeCodec(WORDS)
    small.automaton.max_states = 8
    for text in fuzz[:200]:
        assert small.encode(text) == large.encode(text)


def test_small_state_table_changes_no_count(fuzz):
    library, small = sentencepiece.SentencePieceProcessor(model_file=MODEL), token_count.CountingTransducer(MODEL)
    small.automaton.max_states = 8
    rare = [c for c in map(chr, [*range(0xA1, 0x2000), *range(0x10400, 0x10500)]) if c.isalpha() and library.piece_to_id(c) == library.unk_id()][::40]
    # A word that is known, a new one that fills the table, the known one after two spaces, a new one with its character.
    texts = [f"x {c}a filler{k}words  {c}a {c}b {c}{c} y" for k, c in enumerate(rare)] + [f"b {c}{c}  {c}a   {c}b" for c in rare]
    for text in texts + fuzz[:400]:
        assert small.count(text) == len(library.encode(text)), text


def test_gadgets_accept_exactly_the_encodings():
    """All token strings over a tiny vocabulary against merging by hand."""
    names = ["a", "b", "aa", "ab", "aab", "ba"]
    merges = [[(0, 0, 2)], [(0, 1, 3)], [(2, 1, 4)], [(1, 0, 5)]]
    spelling = {i: ["ab".index(c) for c in n] for i, n in enumerate(names)}
    m = token_automaton.MergeAutomaton({0: 0, 1: 1}, merges, spelling)
    length = {i: len(n) for i, n in enumerate(names)}

    def by_hand(s):
        t = list(s)
        for (u, v, w), in merges:
            k = 0
            while k + 1 < len(t):
                if (t[k], t[k + 1]) == (u, v):
                    t[k : k + 2] = [w]
                k += 1
        return t

    for n in range(1, 11):
        for bits in range(1 << n):
            s = [bits >> k & 1 for k in range(n)]
            assert m.encode(s, length) == by_hand(s)


def test_operators(spark, docs_of, odd_texts):
    library = Tokenizer.from_file(WORDS)
    docs = docs_of(odd_texts)
    got = {r.doc_id: r for r in bpe.round_trip(docs, WORDS).collect()}
    counts = {r.doc_id: r for r in token_count.count_tokens(docs, MODEL).collect()}
    pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, t in enumerate(odd_texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        n = len(pieces.encode(t or ""))
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len((t or "").encode()), n, n > 4096)
    encoded = bpe.encode(docs, WORDS)
    assert {r.doc_id: r.decoded for r in bpe.decode(encoded, WORDS).collect()}[5] == library.decode(library.encode(odd_texts[5], add_special_tokens=False).ids, skip_special_tokens=False)
    assert bpe.codec(WORDS).text_of(bpe.codec(WORDS).encode("Same words")) == "same words"
    assert bpe.round_trip(docs_of([]), WORDS).count() == token_count.count_tokens(docs_of([]), MODEL).count() == 0
    assert bpe.round_trip(docs_of(["a", "a"], [None, 1]), WORDS).count() == 2


def test_a_word_of_any_length_keeps_the_tables_small():
    """One spaceless text neither becomes a key of a table nor passes the limit of states."""
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß中") for _ in range(60_000))
    counter, codec = token_count.CountingTransducer(MODEL), bpe.BpeCodec(WORDS)
    counter.automaton.max_states = codec.automaton.max_states = 2000
    assert counter.count(text) == len(sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text))
    assert codec.encode(text) == Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    for a in (counter.automaton, codec.automaton):
        assert len(a.entries) <= 2001
    assert max(map(len, [*counter.words, *counter.bare, *codec.words]), default=0) <= token_count.LONG_WORD

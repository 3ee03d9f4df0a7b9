import random
import re

import corpus_pipeline as p
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from knotwork.llm import queries
from knotwork.llm.common import read
from knotwork.llm.simhash import text_mark
from test_decontaminate import WORD, brute
from test_simhash import brute_fingerprint, components


def test_stages_keep_clean_documents_and_act(spark, docs_of, sf_dir):
    rng = random.Random(0)
    words = "the of and to in is was for with that this from by are on as at".split()
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "er", "ing"]) for _ in range(n)).capitalize() + "."
    item = read(spark, sf_dir, "benchmark").first().text
    clean = [prose(80) for _ in range(40)]
    texts = [*clean, clean[0], clean[1] + " ", prose(30) + " " + item, prose(40) + " password=abc123def " + prose(10), "123 456", None]
    docs = docs_of(texts)
    kept = docs
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == list(p.DOCUMENT), name
    kept = kept.cache()
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(40)) <= ids and not ids & {40, 41, 42, 44, 45} and 43 in ids
    row = kept.where("doc_id = 43").first()
    assert "[SECRET]" in row.text and "abc123def" not in row.text and row.n_chars == len(row.text)
    assert kept.where("doc_id < 40 and text is not null").count() == 40
    last = {r.doc_id: r for r in p.STAGES[-1][1](spark, kept, sf_dir).collect()}
    library = Tokenizer.from_file(public_tokenizers.path(p.TOKENIZER))
    assert last[3].ids == library.encode(clean[3], add_special_tokens=False).ids and last[3].n_tokens == len(last[3].ids)


WORDS = "the of and to in is was for with that this from by are on as at which there their more when who will been would out up into time has two like him see other could people than first".split()


def test_stages_against_brute_force(spark, docs_of, sf_dir):
    """The rows and ids that plain Python gives, with null, repeated and clashing ids, copies, passages and secrets."""
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "er", "ing"]) for _ in range(n)).capitalize() + "."
    items = [(r.item_id, r.text) for r in read(spark, sf_dir, "benchmark").collect()]
    long = [t for _, t in items if len(WORD.findall(t)) >= 10]
    base = [prose(rng.randrange(60, 120)) for _ in range(24)]
    near = [b + rng.choice([" ", " the", "\n"]) for b in base[:8]] + [base[9].upper()]
    leaks = [prose(20) + " " + long[k] for k in range(3)] + [prose(20) + " " + " ".join(long[3].split()[:8])]
    secrets = [f"{prose(30)} password={'x' * 5}{k}1 {prose(20)}" for k in range(3)] + [f"{prose(20)} {'0a1b' * 7}"]
    texts = [*base, *near, *leaks, *secrets, base[3], None, "", "12 34", base[5]]
    ids: list = list(range(len(texts)))
    ids[2], ids[4], ids[6], ids[-1], ids[25] = None, None, 7, None, 9
    kept = docs_of(texts, ids)
    for _, stage in p.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
    got = {(r.doc_id, r.text) for r in kept.collect()}
    assert kept.count() == len(got)
    # Language: what has letters stays. Near-dedup: the smallest id of each component, null ids last.
    rows = [(i, t) for i, t in zip(ids, texts, strict=True) if t and any(c.isalpha() for c in t)]
    group = components([brute_fingerprint(" ".join(t.split())) for _, t in rows])
    want = {}
    for g, (i, t) in zip(group, rows, strict=True):
        key = (i is None, i or 0, text_mark(t.encode()))
        if g not in want or key < want[g][0]:
            want[g] = (key, i, t)
    left = [(i, t) for _, i, t in want.values()]
    hit = brute([t for _, t in left], items, 10)
    secret = re.compile(r"""((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|[0-9a-f]{24,})""", re.I)
    assert got == {(i, secret.sub("[SECRET]", t)) for (i, t), h in zip(left, hit, strict=True) if not h[3]}
    assert len(got) < len(left) < len(rows) and any("[SECRET]" in t for _, t in got)
    library = Tokenizer.from_file(public_tokenizers.path(p.TOKENIZER))
    last = sorted((r.doc_id or -1, r.ids, r.n_tokens) for r in p.STAGES[-1][1](spark, kept, sf_dir).collect())
    assert last == sorted((i or -1, e, len(e)) for i, e in ((i, library.encode(t, add_special_tokens=False).ids) for i, t in got))


def test_empty_and_repeated_rows(spark, docs_of, sf_dir):
    for docs in (docs_of([]), docs_of(["the same words of this text", "the same words of this text"], [7, 7])):
        n = docs.count()
        for _, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
        assert docs.count() == min(n, 1)


def test_run_and_queries(spark, sf_dir):
    out = p.run(spark, sf_dir)
    assert 0 < out.count() <= read(spark, sf_dir, "documents").count()
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0
    for name, fn in queries.QUERIES.items():
        table, key = {"op5_media": ("embeddings", "vec_id"), "op6_chat_format": ("conversations", "conv_id")}.get(name, ("documents", "doc_id"))
        df = fn(spark, sf_dir)
        expected = read(spark, sf_dir, table).select(key).distinct().count() + (name == "op6_chat_format")
        assert df.count() == expected, name

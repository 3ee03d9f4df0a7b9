import base64
import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import language_id, toxicity
from knotwork.llm.common import read


def test_language_on_held_out_rows(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right >= 0.97


def test_language_edges(spark, docs_of, odd_texts):
    texts = [*odd_texts, "123 456 !!", "ßß", "中文" * 30]
    docs = docs_of(texts).withColumn("lang", F.when(F.col("doc_id") < 9, F.col("lang")))
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert len(got) == len(texts)
    assert all((got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True) for i in (0, 1, 2, 7))
    assert got[9].rejected and all(0 <= r.score <= 1 for r in got.values())
    assert not got[5].rejected and got[5].lang_pred == "en"
    nothing = docs_of(["some text"]).withColumn("lang", F.lit(None).cast("string"))
    assert language_id.identify(nothing).first().lang_pred == "und"
    assert language_id.identify(docs_of([])).count() == 0


def test_numerals_are_no_letters(spark, docs_of):
    """Letters are what Python calls so, and those that its Unicode tables do not know yet."""
    marks = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]) if bool(language_id.LETTER.search(c)) != c.isalpha()]
    assert {unicodedata.category(c) for c in marks} <= {"Cn"}
    got = {r.doc_id: r for r in language_id.identify(docs_of(["²", "½ ①", "Ⅷ", "x²"] + ["some words here"] * 8, [0, 1, 2, 3, *range(11, 19)])).collect()}
    assert [got[i].lang_pred for i in range(4)] == ["und", "und", "und", "en"] and got[0].score == 0.0


def brute_language(rows, texts, dims, clusters):
    """Nearest centroid by plain loops: dictionaries of hashed n-grams, TF-IDF, farthest-first seeds, spherical k-means."""
    def grams(t):
        c = [ord(x) for x in " " + t.lower() + " "]
        c = [x if x >= 128 or chr(x).islower() else 32 for x in c]
        c = [x for k, x in enumerate(c) if not (k and x == 32 and c[k - 1] == 32)]
        m, full, shift = [int(x) for x in language_id.MULTIPLIERS], (1 << 32) - 1, 32 - (dims.bit_length() - 1)
        out = {}
        one = [x * m[0] & full for x in c]
        two = [(a ^ (b + 0x165667B1 & full)) * m[1] & full for a, b in zip(one, c[1:], strict=False)]
        for h in [*one, *two, *((a ^ (b + 0x27D4EB2F & full)) * m[2] & full for a, b in zip(two, c[2:], strict=False))]:
            out[h >> shift] = out.get(h >> shift, 0) + 1
        return out

    known = [(grams(t), lang) for t, lang in rows]
    df = {}
    for g, _ in known:
        for k in g:
            df[k] = df.get(k, 0) + 1
    def unit(g):
        v = {k: math.log1p(n) * (math.log((1 + len(known)) / (1 + df.get(k, 0))) + 1) for k, n in g.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {k: x / size for k, x in v.items()}
    dot = lambda a, b: sum(x * b.get(k, 0.0) for k, x in a.items())
    def mean(vs):
        out = {}
        for v in vs:
            for k, x in v.items():
                out[k] = out.get(k, 0.0) + x / len(vs)
        size = math.sqrt(sum(x * x for x in out.values())) or 1
        return {k: x / size for k, x in out.items()}
    centers = []
    for lang in sorted({lang for _, lang in known}):
        x = [unit(g) for g, n in known if n == lang]
        middle = mean(x)
        seeds = [max(range(len(x)), key=lambda i: dot(x[i], middle))]
        while len(seeds) < min(clusters, len(x)):
            far = [max(dot(v, x[j]) for j in seeds) for v in x]
            if min(far) > 1 - 1e-6:
                break
            seeds.append(far.index(min(far)))
        c = [x[j] for j in seeds]
        for _ in range(12):
            near = [max(range(len(c)), key=lambda j: dot(v, c[j])) for v in x]
            c = [mean([v for v, n in zip(x, near, strict=True) if n == j]) if j in near else c[j] for j in range(len(c))]
        centers += [(lang, v) for v in c]
    out = []
    for t in texts:
        v = unit(grams(t))
        out.append(max((dot(v, c), lang) for lang, c in centers))
    return out


def test_language_against_brute_force(spark, docs_of):
    rng = random.Random(13)
    stems = {"en": ["the", "house", "with", "which"], "de": ["und", "häuser", "nicht", "straße"], "fr": ["les", "maisons", "être", "où"]}
    langs = [rng.choice(list(stems)) for _ in range(60)]
    texts = [" ".join(rng.choice(stems[lang]) + rng.choice(["", "s", "en"]) for _ in range(rng.randrange(5, 25))) for lang in langs]
    docs = docs_of(texts).withColumn("lang", F.element_at(F.array(*map(F.lit, langs)), (F.col("doc_id") + 1).cast("int")))
    learnable = {r.doc_id for r in docs.where(~language_id.held_out(F.col("doc_id"))).collect()}
    want = brute_language([(texts[i], langs[i]) for i in sorted(learnable)], texts, 8192, 3)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert {i for i, r in got.items() if not r.held_out} == learnable
    for i, (score, lang) in enumerate(want):
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-4)


def test_language_learns_from_every_row(spark, docs_of):
    """Centroids of more rows than a sample of 240 for each language, and limits that one odd row of each half lowers."""
    rng = random.Random(14)
    stems = ["the", "house", "with", "which", "garden", "river"]
    texts = [" ".join(rng.choice(stems) + rng.choice(["", "s", "en"]) for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    rows = docs_of(texts).withColumn("lang", F.lit("en"))
    model = language_id.fit(rows)
    want = brute_language([(t, "en") for t in texts], texts[:50], 8192, 3)
    got = {r.doc_id: r.score for r in language_id.predict(rows, model).collect()}
    assert max(abs(got[i] - score) for i, (score, _) in enumerate(want)) < 1e-4
    odd = language_id.fit(docs_of([*texts, "zyx wvu", "qqq jjj"]).withColumn("lang", F.lit("en")))
    assert odd.limits.min() < model.limits.min()


def test_language_rejects_junk_and_keeps_labelled_texts(spark, docs_of):
    docs = read(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text", "lang")
    rng = random.Random(4)
    noise = {
        "base64": base64.b64encode(rng.randbytes(600)).decode(),
        "finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "cyrillic": "".join(rng.choice("абвгдежзиклмнопрстуфхцчшщэюя ") for _ in range(800)),
        "unicode": "".join(chr(rng.randrange(0x100, 0x3000)) for _ in range(800)),
    }
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    got = {r.doc_id: r.rejected for r in language_id.predict(docs_of(list(noise.values())), model).collect()}
    assert [name for k, name in enumerate(noise) if not got[k]] == []
    lost = language_id.predict(docs, model).where("rejected").join(docs, "doc_id")
    assert [r.text for r in lost.collect() if r.text and language_id.LETTER.search(r.text)] == []


FINNISH = "Suomen kieli on uralilaisten kielten itämerensuomalaiseen ryhmään kuuluva kieli jota puhuvat pääosin suomalaiset ja sitä puhutaan myös ruotsissa norjassa sekä virossa ja venäjällä monet vanhat sanat ovat säilyneet nykyaikaan asti hyvin samanlaisina vaikka maailma ympärillä on muuttunut paljon viime vuosisatojen aikana"


def test_one_rejection_rule_at_every_size(spark, docs_of):
    """Models of a thousand and of ten thousand rows reject another language and another script, and no document of their own.

    Random base64 lies near the limit of the smaller one: there most of it is rejected, by the larger one all.
    """
    rng = random.Random(5)
    strange = [FINNISH, *("".join(chr(rng.randrange(0x430, 0x450)) for _ in range(200)) for _ in range(5))]
    noise = [base64.b64encode(bytes(rng.randrange(256) for _ in range(450))).decode() for _ in range(20)]
    for size, least in (("0.01", 8), ("0.1", 20)):
        docs = spark.read.parquet(f"/root/testdata/sf{size}/documents.parquet")
        model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
        assert all(r.rejected for r in language_id.predict(docs_of(strange), model).collect())
        assert language_id.predict(docs_of(noise), model).where("rejected").count() >= least
        assert language_id.predict(docs, model, ("text",)).where(F.col("rejected") & F.col("text").rlike("[a-zA-Z]")).count() == 0


def test_language_limits_follow_length():
    rng = np.random.default_rng(0)
    length = np.repeat([10, 16], 200)
    cosine = np.where(length == 10, 0.4, 0.8) + rng.uniform(-0.1, 0.1, 400)
    limits = language_id.length_limits(length, cosine)
    assert limits[10] == cosine[:200].min() / 2 and limits[16] == cosine[200:].min() / 2
    assert limits[6] == pytest.approx(limits[10] / 2) and limits[24] == limits[16]


def test_language_ignores_other_columns(spark, docs_of):
    texts = [f"the quick brown fox number {i}" for i in range(20)]
    docs = docs_of(texts)
    other = docs.withColumn("source", F.lit("zz")).withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "de").otherwise(F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(d).collect()} for d in (docs, other))
    assert a == b


def test_cluster_separates():
    x = np.array([[1, 0.1, 0], [1, 0, 0.1], [0, 1, 0.1], [0.1, 1, 0]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, near = language_id.cluster(x, 2)
    assert len(c) == 2 and near[0] == near[1] != near[2] == near[3]


def test_boosting_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    start, trees = toxicity.boost(x, y)
    model = toxicity.ToxicityModel({}, start, trees)
    model.knots, model.values = toxicity.isotonic(model.raw(x), y)
    s = model.score(x)
    assert ((s >= 0.5) == (y > 0)).mean() > 0.95 and (np.diff(model.values) >= 0).all()
    knots, values = toxicity.isotonic(np.array([1.0, 2, 3, 3, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(values) >= 0).all() and values[0] == 0 and values[-1] == 1 and (np.diff(knots) >= 0).all()


def test_scores_of_the_whole_query_against_plain_python(spark, docs_of):
    """A model's score, tree by tree and step by step of the calibration, for every row of the query."""
    texts, rows = planted(random.Random(4), 600)
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    docs = docs_of(texts)
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    make = toxicity.Featurizer(model.lexicon)

    def margin(x):
        total = model.start
        for tree in model.trees:
            node = 0
            while node < len(tree.feature):
                node = 2 * node + 1 + int(x[tree.feature[node]] > tree.threshold[node])
            total += tree.value[node - len(tree.feature)]
        return total

    def calibrated(raw):
        knots, values = model.knots.tolist(), model.values.tolist()
        if raw <= knots[0]:
            return values[0]
        for a, b, u, v in zip(knots, knots[1:], values, values[1:], strict=False):
            if raw < b:
                return u if b == a else u + (v - u) * (raw - a) / (b - a)
        return values[-1]

    got = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    for i, t in enumerate(texts):
        want = calibrated(margin(make(t)))
        assert got[i].score == pytest.approx(want, abs=1e-9) and got[i].predicted == int(got[i].score >= 0.3)


def brute_isotonic(y):
    """The least-squares ascending fit, by the max-min formula over all averages."""
    n = len(y)
    return [max(min(sum(y[a:b]) / (b - a) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)]


def test_isotonic_against_the_formula():
    rng = random.Random(9)
    for _ in range(20):
        y = [float(rng.random() < 0.1 + k / 50) for k in range(30)]
        raw = sorted(rng.sample(range(1000), 30))
        knots, values = toxicity.isotonic(np.array(raw, float), np.array(y))
        assert np.interp(raw, knots, values).tolist() == pytest.approx(brute_isotonic(y))


def planted(rng, n):
    clean = ["wood", "river", "stone", "cloud", "light", "paper", "table", "house", "green", "water"]
    bad = ["vilestor", "vilestan", "wretchu", "wretcho"]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(20, 60))]
        toxic = i % 5 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "x", "yy"]))
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    return texts, labels


def test_toxicity_finds_planted_words(spark, docs_of):
    texts, rows = planted(random.Random(2), 900)
    labels = spark.createDataFrame([*rows, rows[0], (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.judge(docs_of(texts), labels).collect()
    held = [r for r in got if r.held_out]
    right = sum(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert len(got) == 900 and len(held) > 150 and right / len(held) > 0.95
    assert all((r.predicted == 1) == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_toxicity_edges(spark, docs_of, odd_texts):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(docs_of(odd_texts), none).collect()}
    assert len(got) == len(odd_texts) and {r.score for r in got.values()} == {0.5}
    one_kind = spark.createDataFrame([(i, 1, 0) for i in range(7)], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.judge(docs_of(odd_texts), one_kind).collect()} == {0.0}
    assert toxicity.judge(docs_of([]), none).count() == 0
    texts, rows = planted(random.Random(3), 200)
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    ids = [*range(200), *range(1000, 1007)]
    scored = {r.doc_id: r for r in toxicity.judge(docs_of([*texts, *odd_texts], ids), labels).collect()}
    assert len(scored) == 207 and scored[1005].score == scored[1006].score


def test_features():
    f = toxicity.Featurizer({"idiot": 3.0, "mor*": 2.5})
    x = f("You 1di0t! MORON you f#o")
    assert x[3] == 1.0 and x[1] == 3.0 and x[7] == 1.0
    assert x[13] > 0 and x[9] > 0 and f("") == f(None) == [0.0] * toxicity.N_FEATURES
    assert toxicity.keys_of("moronic") == ["moronic", "moro*", "moron*", "moroni*"]
    assert toxicity.clean("(Idiot!)") == "idiot" and toxicity.clean("m0r0n") == "moron" and toxicity.clean("123") == "123"


@pytest.mark.parametrize("text", ["a" * 100_000, "!" * 5000, "ÄÖ " * 1000])
def test_features_are_finite(text):
    assert all(np.isfinite(toxicity.Featurizer({})(text)))

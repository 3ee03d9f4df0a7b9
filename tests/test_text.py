"""Text functions and table rules on literal rows, with results worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from knotwork.functions import similarity, text
from knotwork.operators import tables
from knotwork.sources import readers


def one(spark, fn, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(fn(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]


@pytest.mark.parametrize(
    ("fn", "value", "expected"),
    [
        (text.squash, "  a  b\x1cc\n", "a b c"),
        (text.entity_name, " Ёж  ЛЕС ", "ёж лес"),
        (text.normalize, None, ""),
        (text.canonical, '"Ёж"﻿ 1,5 и 2,3,4', "еж 1.5 и 2.3.4"),
        (text.cell_text, ' "a" b ', "a b"),
        (text.strip_units, "Высота, мм", "Высота"),
        (text.strip_units, "5 КГ", "5"),
        (text.strip_units, "Длина, шт.", "Длина"),
        (text.strip_units, "Длина, очень длинная часть", "Длина, очень длинная часть"),
        (text.strip_units, "сорт", "сорт"),
        (text.strip_units, "25 ", "25"),
        (lambda c: text.shorten(c, 28), "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0…"),
        (text.escape_dot, 'a"b\\', 'a\\"b\\\\'),
        (lambda c: text.identifier(c, "x"), "Связь", "x"),
        (lambda c: text.identifier(c, "x"), "1 b-c", "x_1_b_c"),
        (text.relation_type, "links to", "LINKS_TO"),
        (text.null_like, " NaN ", True),
        (text.null_like, "Unnamed: 3", True),
        (text.null_like, "0", False),
        (text.is_marker, "а)", True),
        (text.is_marker, "№ п/п", True),
        (text.is_marker, "abc", False),
    ],
)
def test_scalar(spark, fn, value, expected):
    assert one(spark, fn, value) == expected


def test_tokens_and_ngrams(spark):
    assert one(spark, text.tokens, "Труба a 12-B x, Ёж") == ["труба", "12-b", "ёж"]
    assert one(spark, text.char_ngrams, "ab") == [" a", "ab", "b ", " ab", "ab ", " ab "]
    assert one(spark, text.char_ngrams, "  ") == []


def test_labels(spark):
    row = spark.sql("select 7L id, '' s, 'p' p, cast(null as string) o, ' long  sentence ' t")
    got = row.select(text.triplet_label(F.col("id"), F.col("s"), F.col("p"), F.col("o"), F.col("t")), text.concept_label(F.lit("N"), F.lit("n"), F.lit(1), F.lit(2), F.lit(3))).first()
    assert list(got) == ["7 | [пустой субъект] -[p]-> [пустой объект] | long sentence", "N | norm=n | in=1 out=2 frame=3"]


def test_similarity_edges(spark):
    row = spark.sql("select array(1.0D, 0.0D) a, array(0.0D, 0.0D) z, cast(array() as array<double>) e, array('x','y') s, array('y') t, cast(array() as array<string>) n")
    got = row.select(
        similarity.cosine(F.col("a"), F.col("z")), similarity.cosine(F.col("a"), F.col("e")), similarity.cosine(F.col("a"), F.col("a")), similarity.jaccard(F.col("s"), F.col("t")), similarity.jaccard(F.col("n"), F.col("n")), similarity.l2_normalize(F.col("z"))
    ).first()
    assert list(got) == [0.0, 0.0, 1.0, 0.5, 0.0, [0.0, 0.0]]


def test_hashed_embedding_is_normalised_and_repeatable(spark):
    rows = spark.createDataFrame([("труба",), ("труба",), ("",), (None,)], "name string")
    out, info = similarity.encode_texts(rows, F.col("name"))
    got = [r.embedding for r in out.collect()]
    assert info["backend"] == "hashed_ngrams" and info["warning"]
    assert got[0] == got[1] and abs(sum(x * x for x in got[0]) - 1) < 1e-9
    assert not any(got[2]) and not any(got[3])
    with pytest.raises(ValueError, match="backend"):
        similarity.encode_texts(rows, F.col("name"), "other")
    with pytest.raises(RuntimeError):
        similarity.encode_texts(rows, F.col("name"), "encoder")


def test_encoder_batches_prefix_and_pooling(spark):
    def tokens(texts):
        assert len(texts) <= 3
        return [[[3.0, 0.0], [3.0, 8.0]] if t.startswith("q: a") else [[0.0, 2.0]] for t in texts]

    def whole(texts):
        return [[0.0, float(len(t))] for t in texts]

    rows = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(20)], "id int, name string")
    out, info = similarity.encode_texts(rows, F.col("name"), encoder=tokens, prefix="q: ", batch_size=3)
    assert info == {"backend": "encoder", "warning": None}
    assert {(r.id % 2, tuple(round(x, 9) for x in r.embedding)) for r in out.collect()} == {(1, (0.6, 0.8)), (0, (0.0, 1.0))}
    out, _ = similarity.encode_texts(rows, F.col("name"), "encoder", whole)
    assert {tuple(r.embedding) for r in out.collect()} == {(0.0, 1.0)}
    assert similarity.encode_texts(rows, F.col("name"), "fallback", whole)[1]["backend"] == "hashed_ngrams"


def triplets(df):
    return [(r.row_idx, r.subject, r.predicate, r.object) for r in df.orderBy("table_file", "row_idx", "col_idx").collect()]


def test_ordinary_keeps_empty_predicates_and_skips_blank_rows(spark):
    raw = readers.tables_from_rows(spark, {"x.csv": [["name", "a", "b"], ["", "", ""], ["p", "1", "2"], ["q", "", "4"], ["", "7", "8"]]})
    assert triplets(tables.table_triplets(raw)) == [(2, "p", "1", "a"), (2, "p", "2", "b"), (3, "q", "", "a"), (3, "q", "4", "b")]


def test_decimal_commas_are_rejoined(spark):
    raw = readers.tables_from_rows(spark, {"x.csv": [["name", "a", "b"], ["p", "1", "5", "7"], ["q", "-1", "2", "3", "4"], ["r", "x", "1", "2"]]})
    assert triplets(tables.table_triplets(raw)) == [(2, "p", "1,5", "a"), (2, "p", "7", "b"), (3, "q", "-1,2", "a"), (3, "q", "3,4", "b"), (4, "r", "x", "a"), (4, "r", "1,2", "b")]


def test_name_value_tables(spark):
    raw = readers.tables_from_rows(spark, {"t1.7.csv": [["w", "h", "d"], ["10", "20"]]})
    assert triplets(tables.table_triplets(raw)) == [(2, "w", "10", ""), (2, "h", "20", ""), (2, "d", "", "")]
    assert triplets(tables.vertical_triplets(readers.tables_from_rows(spark, {"v.csv": [["w", "10"], ["h"]]}))) == [(1, "w", "10", ""), (2, "h", "", "")]


def test_comparison_rows_continue(spark):
    raw = readers.tables_from_rows(spark, {"c.csv": [["kind", "m1", "m2"], ["speed", "10-", "30-"], ["", "20", "40"], ["mass", "5", "-"]]})
    assert triplets(tables.comparison_triplets(raw)) == [(2, "speed", "10-20", "m1"), (2, "speed", "30-40", "m2"), (4, "mass", "5", "m1")]


def test_rules_drop_markers_indices_and_null_cells(spark):
    raw = readers.tables_from_rows(spark, {"r.csv": [["0", "1", "2"], ["№", "Сталь", "Cu"], ["1", "ABC", "0.1"], ["2", "type2", "-"], ["3", "7", "0.3"]]})
    assert triplets(tables.rule_triplets(raw)) == [(2, "ABC", "0.1", "Cu"), (4, "Сталь 7", "0.3", "Cu")]


def test_rule_follows_the_shape(spark):
    raw = readers.tables_from_rows(
        spark,
        {
            "matrix": [["0", "1", "2"], ["№", "Сталь", "Cu"], ["1", "ABC", "0.1"], ["2", "type2", "-"], ["3", "7", "0.3"]],
            "entity": [["0", "effect", "state"], ["1", "finer grain", "NbCy"], ["2", "slower growth", "NbC"]],
            "one": [["steel", "Cu"], ["ABC", "0.1"]],
            "across": [["width", "height", "note"], ["10", "20", "-"]],
            "whole": [["width", "height"], ["10", "20"]],
            "x1.7": [["w", "h"], ["wide", "high"]],
            "down": [["1", "width", "10"], ["2", "height", "5-7"]],
            "compared": [["kind", "m1", "m2"], ["speed", "10-", "30-"], ["", "20", "40"], ["mass", "5", "-"]],
            "two rows": [["steel", "content", ""], ["", "Cu", "Mg"], ["ABC", "0.1", "0.2"], ["DEF", "0.3", "."]],
            "corner": [["", "a", "b"], ["x", "red", "blue"], ["y", "green", "grey"]],
            "empty": [["", ""]],
        },
    )
    kinds = {r.table_file: r.kind for r in tables.table_kinds(raw).select("table_file", "kind").distinct().collect()}
    matrix = {"matrix", "entity", "one", "two rows", "corner"}
    assert kinds == {k: "matrix" for k in matrix} | {k: "horizontal" for k in ("across", "whole", "x1.7")} | {"down": "vertical", "compared": "comparison"}
    out = {}
    for r in sorted(tables.extract_triplets(raw).collect()):
        out.setdefault(r.table_file, []).append((r.subject, r.predicate, r.object))
    assert out == {
        "matrix": [("ABC", "0.1", "Cu"), ("Сталь 7", "0.3", "Cu")],
        "entity": [("finer grain", "NbCy", "state"), ("slower growth", "NbC", "state")],
        "one": [("ABC", "0.1", "Cu")],
        "across": [("width", "10", ""), ("height", "20", "")],
        "whole": [("width", "10", ""), ("height", "20", "")],
        "x1.7": [("w", "wide", ""), ("h", "high", "")],
        "down": [("width", "10", ""), ("height", "5-7", "")],
        "compared": [("speed", "10-20", "m1"), ("speed", "30-40", "m2"), ("mass", "5", "m1")],
        "two rows": [("ABC", "0.1", "Cu content"), ("ABC", "0.2", "Mg content"), ("DEF", "0.3", "Cu content")],
        "corner": [("x", "red", "a"), ("x", "blue", "b"), ("y", "green", "a"), ("y", "grey", "b")],
    }
    assert tables.extract_triplets(raw.where("false")).count() == 0


def test_shapes_take_one_shuffle_of_the_rows(spark, monkeypatch):
    """Odd tables by shape: as by the operators step by step, with the rows dealt out once and once more for runs."""
    rng = random.Random(3)
    pool = ["", "", "a", "b b", "1", "2,5", "35", "-", "null", "№ 1", "a)", "2.", "Unnamed: 3", "3-5", "+", " x ", '"', None, "≤ 4", "name"]
    rows = []
    for t in range(150):
        width, numbered = rng.choice([1, 2, 2, 3, 4, 6]), rng.random() < 0.4
        for r in range(rng.choice([1, 2, 2, 3, 4, 5, 8])):
            cells = [rng.choice(pool) for _ in range(max(0, width + rng.choice([0, 0, 0, 1, -1])))]
            rows.append((f"t{t}{'-1.7' if t % 9 == 0 else ''}.csv", r * 3, [rng.choice(["1", "2)", "№"]), *cells] if numbered and r else cells))
    rng.shuffle(rows)
    table = tables.materialize(spark.createDataFrame(rows, "table_file string, row_idx long, cells array<string>"))

    kinds = tables.materialize(tables.table_kinds(table))
    of = lambda kind: kinds.where(F.col("kind") == kind).drop("kind")
    full = lambda found: found.where(~text.null_like(F.col("subject")) & ~text.null_like(F.col("predicate")))
    flat = of("horizontal").select("table_file").distinct()
    rest = tables.drop_technical(tables.merge_headers(tables.clean_rows(table).join(flat, "table_file", "left_anti")), True)
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(kinds.where("kind <> 'horizontal'").select("table_file", "row_idx", "cells")) == key(rest.select("table_file", "row_idx", "cells"))
    want = tables._matrix_rule(of("matrix")).unionByName(full(tables.horizontal_triplets(of("horizontal")))).unionByName(full(tables.vertical_triplets(of("vertical")))).unionByName(tables.comparison_triplets(of("comparison")))

    plans, store = [], tables.materialize
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(tables, "materialize", lambda df, *a: plans.append(plan(df)) or store(df, *a))
    got = tables.triplets_by_shape(table)
    assert key(got.select(want.columns)) == key(want) and len({r.kind for r in kinds.collect()}) == 4
    assert sum(p.count("Exchange hashpartitioning") for p in [*plans, plan(got)]) == 2


def test_headers(spark):
    df = spark.createDataFrame([(["x", "y", "1"],), (["1", "2,5", "x"],), ([],), (None,), (["≤ 5", "-", "Unnamed: 4"],)], "second array<string>")
    assert [r[0] for r in df.select(tables.header_rows(F.col("second"))).collect()] == [2, 1, 2, 1, 1]
    top = spark.createDataFrame([("t", 0, "name", ""), ("t", 1, "size", "w"), ("t", 2, "Unnamed: 2", "h"), ("t", 3, "", "Unnamed: 3")], "table_file string, col_idx int, top string, bottom string")
    assert [r.name for r in tables.flatten_header(top).orderBy("col_idx").collect()] == ["name", "w size", "h size", "size"]
    fit = spark.range(1).select(tables.fit_width(F.array(F.lit("a")), F.lit(3)), tables.fit_width(F.array(F.lit("a"), F.lit("b")), F.lit(1))).first()
    assert list(fit) == [["a", "", ""], ["a"]]


def test_prompt_text(spark):
    raw = readers.tables_from_rows(spark, {"p.csv": [["0", "1", "2"], ["a-  b", "", "x\ny"], ["", "", ""], ["c", "", "d"]]})
    assert tables.prompt_tables(raw).first().prompt == "ab;x y\nc;d"
    hyphen = readers.tables_from_rows(spark, {"p.csv": [["пара- метр", "зна"], ["c", "d"]]})
    assert tables.prompt_tables(hyphen).first().prompt == "параметр;зна\nc;d"


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name; a;b\n"p;q"; 1;2\n', encoding="utf-8-sig")
    (tmp_path / "b 1.7.csv").write_bytes("вес,рост\n1,2\n".encode("cp1251"))
    got = triplets(tables.table_triplets(readers.read_tables(spark, str(tmp_path))))
    assert got == [(2, "p;q", "1", "a"), (2, "p;q", "2", "b"), (2, "вес", "1", ""), (2, "рост", "2", "")]


@pytest.mark.parametrize("encoding, header, cell", [("utf-8-sig", "имя", "насос ё"), ("cp1251", "имя", "насос ё"), ("latin-1", "a", "é\x98"), ("utf-8", "a", "plain")])
def test_csv_encodings(spark, tmp_path, encoding, header, cell):
    (tmp_path / "t.csv").write_bytes(f"{header};b.c\n{cell};10\n;20\n".encode(encoding))
    got = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert got.columns == [header, "b.c"]
    assert [tuple(r) for r in got.collect()] == [(cell, "10"), (None, "20")]
    if not encoding.startswith("utf-8"):
        assert readers.read_csv(spark, str(tmp_path / "t.csv"), encoding=encoding).columns == got.columns


def test_csv_empty(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b"")
    assert readers.csv_encoding(spark, str(tmp_path)) == "utf-8"


def test_units_and_frames(spark):
    t = spark.createDataFrame([("Высота, мм", "5 мм", "м, 3")], "subject string, predicate string, object string")
    assert tables.strip_triplet_units(t).first() == ("Высота", "5 мм", "м")
    assert tables.as_frames(t).first().subject.text == "Высота, мм"

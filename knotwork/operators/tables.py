"""Tables to triplets. A raw table is (table_file, row_idx, cells): ragged rows of string cells.

Everything is set-based over many tables at once: the key of a table is ``table_file``, and no operator
gathers a table in one task unless a window over its rows is the operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cell_text, is_marker, null_like, prefix_numeric, squash, strip_units
from ..session import materialize

HORIZONTAL_MARK = "1.7"
#: Digits with marks of ranges, signs and comparisons.
DATA = "^(?=.*\\d)[\\d,.\\s\\-–±≤≥<>×]+$"


def repair_decimal_commas(cells: Column, width: Column) -> Column:
    """Cells of a too long row with ``1``, ``35`` rejoined to ``1,35``, leftmost first, as often as it is too long.

    A pair is a signed integer followed by an integer, from the second cell on; a joined cell joins no more.
    """
    state = "struct<out:array<string>,spare:int>"

    def step(acc: Column, cell: Column) -> Column:
        last = F.try_element_at(acc["out"], F.lit(-1))
        joins = (acc["spare"] > 0) & (F.size(acc["out"]) > 1) & last.rlike("^[+-]?\\d+$") & cell.rlike("^\\d+$")
        joined = F.concat(F.slice(acc["out"], F.lit(1), F.greatest(F.size(acc["out"]) - 1, F.lit(0))), F.array(F.concat(last, F.lit(","), cell)))
        return F.struct(
            F.when(F.coalesce(joins, F.lit(False)), joined).otherwise(F.concat(acc["out"], F.array(cell))).alias("out"),
            F.when(F.coalesce(joins, F.lit(False)), acc["spare"] - 1).otherwise(acc["spare"]).alias("spare"),
        ).cast(state)

    trimmed = F.transform(cells, lambda c: F.trim(c))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.greatest(F.size(cells) - width, F.lit(0)).alias("spare")).cast(state)
    return F.when(F.size(cells) > width, F.aggregate(trimmed, start, step)["out"]).otherwise(cells)


def clean_rows(table: DataFrame) -> DataFrame:
    """Blank rows dropped, cells cleaned, rows renumbered from 1 within each table."""
    cells = table.select("table_file", "row_idx", F.transform("cells", cell_text).alias("cells")).where(F.exists("cells", lambda c: c != ""))
    order = Window.partitionBy("table_file").orderBy("row_idx")
    return cells.select("table_file", F.row_number().over(order).alias("row_idx"), "cells")


def ordinary_triplets(table: DataFrame) -> DataFrame:
    """Matrix tables: subject the first cell, object the header, predicate the cell.

    An empty subject gives nothing; an empty predicate is kept if its header is not empty. Row numbers count
    the header as 1, after blank rows are gone.
    """
    rows = clean_rows(table)
    header = rows.where("row_idx = 1").select("table_file", F.col("cells").alias("header"))
    return _crossed(rows.where("row_idx > 1").join(header, "table_file"))


def _crossed(body: DataFrame, *keep: str) -> DataFrame:
    """Rows below a header (table_file, row_idx, cells, header) as triplets; columns in ``keep`` go along."""
    body = body.withColumn("cells", repair_decimal_commas(F.col("cells"), F.size("header")))
    pairs = F.arrays_zip(F.slice("header", 2, F.greatest(F.least(F.size("header"), F.size("cells")) - 1, F.lit(0))).alias("object"), F.slice("cells", 2, F.greatest(F.least(F.size("header"), F.size("cells")) - 1, F.lit(0))).alias("predicate"))
    flat = body.select("table_file", "row_idx", F.get("cells", F.lit(0)).alias("subject"), F.posexplode(pairs).alias("col_idx", "p"), *keep)
    return flat.where((F.col("subject") != "") & ((F.col("p.predicate") != "") | (F.col("p.object") != ""))).select(
        "table_file", "row_idx", (F.col("col_idx") + 1).alias("col_idx"), "subject", F.col("p.predicate").alias("predicate"), F.col("p.object").alias("object"), *keep
    )


def horizontal_triplets(table: DataFrame) -> DataFrame:
    """Name-value tables on two rows: names above values, object empty; a missing value is empty."""
    rows = clean_rows(table)
    names = rows.where("row_idx = 1").select("table_file", F.posexplode("cells").alias("col_idx", "subject"))
    values = rows.where("row_idx = 2").select("table_file", F.posexplode("cells").alias("col_idx", "predicate"))
    return names.join(values, ["table_file", "col_idx"], "left").where("subject <> ''").select("table_file", F.lit(2).alias("row_idx"), "col_idx", "subject", F.coalesce("predicate", F.lit("")).alias("predicate"), F.lit("").alias("object"))


def vertical_triplets(table: DataFrame) -> DataFrame:
    """Name-value tables in two columns."""
    rows = clean_rows(table)
    return rows.select("table_file", "row_idx", F.lit(1).alias("col_idx"), F.get("cells", F.lit(0)).alias("subject"), F.coalesce(F.get("cells", F.lit(1)), F.lit("")).alias("predicate"), F.lit("").alias("object")).where("subject <> ''")


def table_triplets(tables: DataFrame) -> DataFrame:
    """Each table by its rule: files named with the horizontal mark are name-value tables."""
    flat = F.contains(F.col("table_file"), F.lit(HORIZONTAL_MARK))
    return ordinary_triplets(tables.where(~flat)).unionByName(horizontal_triplets(tables.where(flat)))


def unpivot_triplets(df: DataFrame, subject: str, columns: list[str], ids: list[str]) -> DataFrame:
    """A wide typed table as triplets: one per value column, its name the object."""
    wide = df.select(*ids, F.col(subject).alias("subject"), *(F.col(c).cast("string").alias(c) for c in columns))
    return wide.unpivot([*ids, "subject"], columns, "object", "predicate")


def header_rows(second: Column) -> Column:
    """How many rows a header has: 2 if under 40 % of the second row's named cells are data, else 1.

    Data are digits with marks of ranges, signs and comparisons; a table of one row (null) has one header row,
    and a second row without named cells counts as a header.
    """
    full = F.filter(second, lambda c: (F.trim(F.coalesce(c, F.lit(""))) != "") & ~F.trim(c).rlike("^Unnamed: \\d{1,2}$"))
    data = F.filter(full, lambda c: F.trim(c).rlike("^[\\d,.\\s\\-–±≤≥<>×]+$") & ~F.trim(c).isin("-", "—", "–", "+", "±"))
    share = F.when(F.size(full) == 0, F.lit(0.0)).otherwise(F.size(data) / F.greatest(F.size(full), F.lit(1)))
    return F.when(second.isNull(), 1).when(share < 0.4, 2).otherwise(1)


def flatten_header(top: DataFrame) -> DataFrame:
    """(table_file, col_idx, top, bottom) to one name per column.

    Empty and generated (``Unnamed: n``) names of the top row take the name to their left; the parts are
    joined as ``bottom top``.
    """
    named = lambda c: F.when((F.trim(F.coalesce(c, F.lit(""))) != "") & ~F.coalesce(c, F.lit("")).startswith("Unnamed"), F.trim(c))
    left = Window.partitionBy("table_file").orderBy("col_idx").rowsBetween(Window.unboundedPreceding, 0)
    filled = top.withColumn("top", F.last(named(F.col("top")), ignorenulls=True).over(left)).withColumn("bottom", named(F.col("bottom")))
    return filled.select("table_file", "col_idx", F.concat_ws(" ", "bottom", "top").alias("name"))


def fit_width(cells: Column, width: Column) -> Column:
    """Cells padded with empty ones, or cut, to the header's width."""
    pad = F.when(width > F.size(cells), F.array_repeat(F.lit(""), width - F.size(cells))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(cells, pad), F.lit(1), width)


def continue_rows(rows: DataFrame, key: str, order: str, first: str, values: list[str], group: str | None = None) -> DataFrame:
    """Rows with an empty first cell continue the row above: their values are put together in order.

    ``group`` names the column whose rows belong together (a table); without it the input is one table.
    """
    over = Window.partitionBy(group).orderBy(order) if group else Window.orderBy(order)
    filled = F.coalesce(F.col(first), F.lit("")) != ""
    marked = rows.withColumn("_run", F.sum(filled.cast("int")).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    sorted_values = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.coalesce(F.col(c), F.lit("")).alias("v")))), lambda x: x["v"]), "")
    keys = [group, "_run"] if group else ["_run"]
    return marked.groupBy(*keys).agg(F.min(key).alias(key), F.min_by(first, order).alias(first), *(sorted_values(c).alias(c) for c in values)).drop("_run")


def comparison_triplets(table: DataFrame) -> DataFrame:
    """Comparison tables: objects in the header, parameters in the first column, continued rows joined."""
    rows = clean_rows(table)
    header = rows.where("row_idx = 1").select("table_file", F.col("cells").alias("header"))
    long = rows.where("row_idx > 1").select("table_file", "row_idx", F.get("cells", F.lit(0)).alias("subject"), F.posexplode(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))).alias("col_idx", "value"))
    over = Window.partitionBy("table_file").orderBy("row_idx").rangeBetween(Window.unboundedPreceding, 0)
    subject = F.when(null_like(F.col("subject")), "").otherwise(F.col("subject"))
    marked = long.withColumn("subject", subject).withColumn("run", F.max(F.when(F.col("subject") != "", F.col("row_idx"))).over(over))
    joined = marked.groupBy("table_file", "run", "col_idx").agg(
        F.min_by("subject", "row_idx").alias("subject"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "value"))), lambda x: x["value"]), "").alias("predicate")
    )
    named = joined.join(header, "table_file").select("table_file", F.col("run").alias("row_idx"), (F.col("col_idx") + 1).alias("col_idx"), "subject", "predicate", F.coalesce(F.get("header", F.col("col_idx") + 1), F.lit("")).alias("object"))
    return named.where(~null_like(F.col("predicate")) & (F.col("subject") != ""))


def drop_technical(table: DataFrame, keep_continued: bool = False) -> DataFrame:
    """Rows of bare indices go, and so does a first column of enumeration markers.

    ``keep_continued`` keeps rows of numbers whose first cell is empty, from the third row on: they continue a row.
    """
    bare = F.forall("cells", lambda c: F.trim(c).rlike("^\\d*$")) & F.exists("cells", lambda c: F.trim(c) != "")
    if keep_continued:
        table = clean_rows(table)
        bare = bare & ((F.col("row_idx") < 3) | (F.get("cells", F.lit(0)) != ""))
    rows = table.where(~bare)
    numbered = clean_rows(rows)
    marks = numbered.groupBy("table_file").agg(F.bool_and((F.col("row_idx") == 1) | is_marker(F.get("cells", F.lit(0)))).alias("marked"), F.count("*").alias("n"))
    return numbered.join(marks, "table_file").select("table_file", "row_idx", F.when(F.col("marked") & (F.col("n") > 1), F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))).otherwise(F.col("cells")).alias("cells"))


def rule_triplets(table: DataFrame) -> DataFrame:
    """Deterministic extraction: technical rows and columns out, matrix rule, null-like cells out, numbers named."""
    return _matrix_rule(drop_technical(table))


def _matrix_rule(rows: DataFrame) -> DataFrame:
    corner = rows.where("row_idx = 1").select("table_file", F.get("cells", F.lit(0)).alias("corner"))
    return _named(ordinary_triplets(rows).join(corner, "table_file", "left"))


def _named(found: DataFrame) -> DataFrame:
    """Triplets (with the corner of their table) without null-like slots, bare numbers named after the corner."""
    obj = F.when(null_like(F.col("object")), "").otherwise(F.col("object"))
    return found.where(~null_like(F.col("predicate")) & ~null_like(F.col("subject"))).select("table_file", "row_idx", "col_idx", prefix_numeric(F.col("subject"), F.col("corner")).alias("subject"), "predicate", obj.alias("object"))


def merge_headers(table: DataFrame) -> DataFrame:
    """Headers of two rows become one row; the other rows are numbered on.

    A header has two rows if its first leaves a cell after the corner empty (or generated), as a name over several
    columns does, its second holds few data (``header_rows``), and a row follows.
    """
    rows = clean_rows(table)
    at = lambda n: F.max(F.when(F.col("row_idx") == n, F.col("cells")))
    spread = F.exists(F.slice("top", 2, F.greatest(F.size("top") - 1, F.lit(0))), lambda c: (c == "") | c.startswith("Unnamed"))
    heads = rows.groupBy("table_file").agg(at(1).alias("top"), at(2).alias("bottom"), F.max("row_idx").alias("n")).where((F.col("n") > 2) & (F.size("top") > 1) & spread & (header_rows(F.col("bottom")) == 2))
    cells = heads.select("table_file", F.posexplode(F.arrays_zip("top", "bottom")).alias("col_idx", "c")).select("table_file", "col_idx", "c.top", "c.bottom")
    names = flatten_header(cells).groupBy("table_file").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "name"))), lambda x: x["name"]).alias("header"))
    merged = rows.join(names, "table_file", "left").where(F.col("header").isNull() | (F.col("row_idx") != 2))
    return clean_rows(merged.select("table_file", "row_idx", F.when(F.col("row_idx") == 1, F.coalesce("header", "cells")).otherwise(F.col("cells")).alias("cells")))


def _merged_header(top: Column, bottom: Column) -> Column:
    """Two header rows as one, by the rule of :func:`flatten_header`."""
    named = lambda c: F.when((F.trim(F.coalesce(c, F.lit(""))) != "") & ~F.coalesce(c, F.lit("")).startswith("Unnamed"), F.trim(c))
    state = "struct<out:array<string>,left:string>"

    def step(acc: Column, c: Column) -> Column:
        left = F.coalesce(named(c["top"]), acc["left"])
        return F.struct(F.concat(acc["out"], F.array(F.concat_ws(" ", named(c["bottom"]), left))).alias("out"), left.alias("left")).cast(state)

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("left")).cast(state)
    return F.aggregate(F.arrays_zip(top.alias("top"), bottom.alias("bottom")), start, step)["out"]


def _shaped(table: DataFrame) -> DataFrame:
    """(table_file, position, row_idx, cells, kind, values) of :func:`table_kinds`, with all of a table in one task.

    Rows are dealt out by their table and sorted once; every fact about a table is a window over that order, so there
    is one shuffle whatever the number of steps. ``values`` is the second row of a horizontal table.
    """
    order = Window.partitionBy("table_file").orderBy("position")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_data = lambda c: F.trim(c).rlike(DATA)
    first = lambda c: F.get(c, F.lit(0))
    tail = lambda c: F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))
    filled = F.exists("cells", lambda c: c != "")
    a, b, n = F.col("a"), F.col("b"), F.col("n")

    rows = table.select("table_file", F.col("row_idx").alias("position"), F.transform("cells", cell_text).alias("cells")).where(filled)
    rows = rows.withColumns({"at": F.row_number().over(order), "n": F.count("*").over(whole), "a": F.first("cells").over(whole), "b": F.nth_value("cells", 2).over(whole)})
    named = (n == 2) & (F.size(a) > 1) & is_data(F.coalesce(first(b), F.lit(""))) & ~F.exists(a, is_data)
    rows = rows.withColumn("flat", F.coalesce(F.contains("table_file", F.lit(HORIZONTAL_MARK)) | F.coalesce(named, F.lit(False)), F.lit(False)))
    spread = F.exists(tail(a), lambda c: (c == "") | c.startswith("Unnamed"))
    two = ~F.col("flat") & (n > 2) & (F.size(a) > 1) & spread & (header_rows(b) == 2)
    rows = rows.withColumn("two", (F.col("at") <= 2) & two).where(~F.col("two") | (F.col("at") == 1))
    rows = rows.select("table_file", "position", "flat", F.when(F.col("flat") & (F.col("at") == 1), b).alias("values"), F.when(F.col("two"), _merged_header(a, b)).otherwise(F.col("cells")).alias("cells"))

    rows = rows.where(filled).withColumn("at", F.row_number().over(order))
    bare = F.forall("cells", lambda c: F.trim(c).rlike("^\\d*$")) & ((F.col("at") < 3) | (first("cells") != ""))
    rows = rows.where(F.col("flat") | ~bare)
    other = (~is_marker(first("cells"))).cast("int")
    rows = rows.withColumns({"row_idx": F.row_number().over(order), "n": F.count("*").over(whole), "others": F.sum(other).over(whole) - F.first(other).over(whole)})
    cut = ~F.col("flat") & (F.col("others") == 0) & (n > 1)
    rows = rows.select("table_file", "position", "row_idx", "flat", "values", F.when(cut, tail("cells")).otherwise(F.col("cells")).alias("cells"))
    continues = (F.col("row_idx") > 1) & null_like(first("cells")) & F.exists(tail("cells"), lambda c: ~null_like(c))
    rows = rows.withColumns({"width": F.max(F.size("cells")).over(whole), "a": F.first("cells").over(whole), "continued": F.bool_or(continues).over(whole)})
    upright = (F.col("width") == 2) & is_data(F.coalesce(F.get("a", F.lit(1)), F.lit("")))
    kind = F.when(F.col("flat"), "horizontal").when(upright, "vertical").when(F.col("continued"), "comparison").otherwise("matrix")
    return rows.select("table_file", "position", "row_idx", "cells", kind.alias("kind"), "values")


def table_kinds(table: DataFrame) -> DataFrame:
    """(table_file, row_idx, cells, kind): each table's rows under the rule that its shape asks for.

    ``horizontal``: names over one row of values, that is, two rows of which the second starts with data and the first
    has none, or a file with the horizontal mark. Of the others, without technical rows and columns and with merged
    headers: ``vertical`` where no row has over two cells and the first row's second is data, so there is no header;
    ``comparison`` where a row without a first cell continues the row above; else ``matrix``, which also covers an entity
    with its properties. A table without a filled cell has no row.
    """
    return _shaped(table).select("table_file", "row_idx", "cells", "kind")


def triplets_by_shape(tables: DataFrame) -> DataFrame:
    """Tables of all kinds at once, each by the rule of its kind; null-like slots but the object give nothing.

    The results are those of the operators above, table by table; what they look up by joins comes along in columns here.
    """
    order = Window.partitionBy("table_file").orderBy("position")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c: F.get(c, F.lit(0))
    blank = F.forall("cells", lambda c: c == "")
    number = F.col("row_idx") - F.sum(blank.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = _shaped(tables).withColumns({"number": number.cast("int"), "header": F.first(F.when(~blank, F.col("cells")), ignorenulls=True).over(whole), "corner": first(F.first("cells").over(whole))}).where(~blank)
    subject = F.when(null_like(first("cells")), "").otherwise(first("cells"))
    starts = (F.col("number") > 1) & (F.size("cells") > 1) & (subject != "")
    rows = rows.withColumn("run", F.max(F.when(starts, F.col("number"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    headed = F.col("kind").isin("matrix", "comparison")
    rows = materialize(rows.select("table_file", F.col("number").alias("row_idx"), "cells", "kind", "values", F.when(headed, F.col("header")).alias("header"), F.when(F.col("kind") == "matrix", F.col("corner")).alias("corner"), F.when(F.col("kind") == "comparison", F.col("run")).alias("run")), "shapes")

    of = lambda kind: rows.where(F.col("kind") == kind)
    full = lambda found: found.where(~null_like(F.col("subject")) & ~null_like(F.col("predicate")))
    names = of("horizontal").where("row_idx = 1").select("table_file", F.lit(2).alias("row_idx"), F.posexplode("cells").alias("col_idx", "subject"), "values")
    level = names.where("subject <> ''").select("table_file", "row_idx", "col_idx", "subject", F.coalesce(F.get("values", F.col("col_idx")), F.lit("")).alias("predicate"), F.lit("").alias("object"))
    upright = of("vertical").select("table_file", "row_idx", F.lit(1).alias("col_idx"), first("cells").alias("subject"), F.coalesce(F.get("cells", F.lit(1)), F.lit("")).alias("predicate"), F.lit("").alias("object"))
    return _named(_crossed(of("matrix").where("row_idx > 1"), "corner")).unionByName(full(level)).unionByName(full(upright)).unionByName(_continued(of("comparison").where("row_idx > 1 and size(cells) > 1 and run is not null")))


def _continued(rows: DataFrame) -> DataFrame:
    """Rows of comparisons (table_file, row_idx, cells, header, run), those of a run joined cell by cell.

    Only a run's first row has a subject, so its columns are those that give triplets.
    """
    runs = rows.groupBy("table_file", "run").agg(F.array_sort(F.collect_list(F.struct("row_idx", "cells"))).alias("rows"), F.any_value("header").alias("header"))
    at = F.get("rows", F.lit(0))["cells"]
    joined = lambda k: F.array_join(F.transform(F.filter("rows", lambda r: F.size(r["cells"]) > k), lambda r: F.get(r["cells"], k)), "")
    cells = runs.select("table_file", F.col("run").alias("row_idx"), F.get(at, F.lit(0)).alias("subject"), "header", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(at) - 1), joined)).alias("col_idx", "predicate"))
    return cells.where(~null_like(F.col("predicate"))).select("table_file", "row_idx", (F.col("col_idx") + 1).alias("col_idx"), "subject", "predicate", F.coalesce(F.get("header", F.col("col_idx") + 1), F.lit("")).alias("object"))


def extract_triplets(tables: DataFrame, backend=None) -> DataFrame:
    """Triplets of tables by a pluggable backend: a mapInPandas function over (table_file, prompt), which gives
    (table_file, row_idx, col_idx, subject, predicate, object). Without one the rule of each table's shape applies."""
    if backend is None:
        return triplets_by_shape(tables)
    return prompt_tables(tables).mapInPandas(backend, "table_file string, row_idx int, col_idx int, subject string, predicate string, object string")


def prompt_tables(table: DataFrame, separator: str = ";") -> DataFrame:
    """A table as CSV text for a prompt: empty rows and columns out, line breaks and hyphenation removed.

    A column is empty if it holds nothing below the header; a header that only counts from 0 is left out.
    """
    counting = F.transform(F.sequence(F.lit(0), F.greatest(F.size("cells") - 1, F.lit(0))), lambda i: i.cast("string"))
    first = Window.partitionBy("table_file").orderBy("row_idx")
    numbered = table.withColumn("n", F.row_number().over(first)).where(~((F.col("n") == 1) & (F.transform("cells", lambda c: F.trim(c)) == counting)))
    flat = numbered.select("table_file", "row_idx", "n", F.posexplode("cells").alias("col_idx", "cell")).withColumn("cell", squash(F.coalesce("cell", F.lit(""))))
    kept = flat.groupBy("table_file", "col_idx").agg(F.bool_or((F.col("n") > 1) & (F.col("cell") != "")).alias("full")).where("full").drop("full")
    cells = flat.join(kept, ["table_file", "col_idx"], "left_semi")
    ordered = lambda key, of: F.transform(F.array_sort(F.collect_list(F.struct(key, of))), lambda x: x[of])
    lines = cells.groupBy("table_file", "row_idx").agg(F.array_join(ordered("col_idx", "cell"), separator).alias("line")).where(F.replace("line", F.lit(separator), F.lit("")) != "")
    shown = lines.withColumn("n", F.row_number().over(first)).withColumn("line", F.when(F.col("n") == 1, F.regexp_replace("line", "-\\s+", "")).otherwise(F.col("line")))
    return shown.groupBy("table_file").agg(F.array_join(ordered("row_idx", "line"), "\n").alias("prompt"))


def strip_triplet_units(triplets: DataFrame) -> DataFrame:
    """Measurement units leave subjects and objects, not predicates."""
    return triplets.withColumns({c: strip_units(F.col(c)) for c in ("subject", "object")})


def as_frames(triplets: DataFrame) -> DataFrame:
    """Flat slots to ``{text, frame: []}`` structs."""
    slot = lambda c: F.struct(F.coalesce(F.col(c), F.lit("")).alias("text"), F.array().cast("array<string>").alias("frame"))
    return triplets.withColumns({c: slot(c) for c in ("subject", "predicate", "object")})

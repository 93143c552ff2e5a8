"""What a layout library holds: histograms and label lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netframe.operators.classify import layer_stack


def layer_histogram(shapes: DataFrame) -> DataFrame:
    """(layer, datatype, n, role, name) of all layers, by key."""
    counts = shapes.groupBy("layer", "datatype").agg(F.count("*").alias("n"))
    return counts.join(layer_stack(shapes.sparkSession), ["layer", "datatype"], "left").select("layer", "datatype", "n", "role", "name").orderBy("layer", "datatype")


def element_totals(**tables: DataFrame) -> DataFrame:
    """(kind, n) of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def reference_histogram(refs: DataFrame) -> DataFrame:
    """(child, n): copies placed, arrays counted in full."""
    return refs.groupBy("child").agg(F.sum(F.greatest("n_rows", F.lit(1).cast("long")) * F.greatest("n_cols", F.lit(1).cast("long"))).alias("n")).orderBy(F.desc("n"), "child")


def labels_per_cell(labels: DataFrame) -> DataFrame:
    """(cell, n, names): distinct labels of a cell, in order."""
    return labels.groupBy("cell").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("value")), " ").alias("names"))


def labels_listed(texts: DataFrame) -> DataFrame:
    """(path, cell, seq, label): every label as value@layer/type, repeats too, in the order of the stream."""
    return texts.select("path", "cell", "seq", F.format_string("%s@%d/%d", "value", "layer", "texttype").alias("label")).orderBy("path", "cell", "seq")


def library_summary(library: DataFrame, cells: DataFrame, refs: DataFrame) -> DataFrame:
    """(path, lib, user_unit, db_unit_m, n_cells, tops): one row for each library."""
    tops = cells.join(refs, [cells.cell == refs.child, cells.path == refs.path], "left_anti").groupBy("path").agg(F.array_sort(F.collect_set("cell")).alias("tops"))
    return library.join(cells.groupBy("path").agg(F.count("*").alias("n_cells")), "path", "left").join(tops, "path", "left")

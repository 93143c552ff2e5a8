"""Electrical nets: rectangles that touch on a level, or that a cut ties across levels, and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netframe.functions.geometry import bounding_box
from netframe.operators.components import joined
from netframe.operators.spatial import points_bound
from netframe.operators.squares import labelled_trees, square_trees


def rect_nets(rects: DataFrame, cuts: DataFrame | None = None, n_levels: int = 4) -> DataFrame:
    """(rect_id, net): every rectangle with the smallest rectangle of its net."""
    return wired(rects, cuts, n_levels).select("rect_id", "net")


def wired(rects: DataFrame, cuts: DataFrame | None = None, n_levels: int = 4) -> DataFrame:
    """rects with net, the smallest rectangle of their net. Pairs that touch are many times as many as rectangles where these lie over each other, and are never rows: a task joins what lies in its square."""
    parts = joined(square_trees(rects, cuts, n_levels))
    return rects.join(parts, rects.rect_id == parts.node, "left").select(*rects.columns, F.coalesce("component", "rect_id").alias("net"))


def wired_labels(rects: DataFrame, cuts: DataFrame | None, labels: DataFrame, n_levels: int) -> tuple[DataFrame, DataFrame]:
    """wired(), and (text_id, net) of labels (text_id from 0 on, level, x, y): the net of the metal under each, null where there is none.

    Labels are bound where the rectangles are joined. Which net a node is in is written once, by trees; either result looks up its own nodes only."""
    trees, first = labelled_trees(rects, cuts, n_levels, labels)
    parts = joined(trees)
    own = parts.where(F.col("node") < first)
    held = rects.join(own, rects.rect_id == own.node, "left").select(*rects.columns, F.coalesce("component", "rect_id").alias("net"))
    return held, parts.where(F.col("node") >= first).select((F.col("node") - first).alias("text_id"), F.when(F.col("component") < first, F.col("component")).alias("net"))


def net_boxes(rects: DataFrame) -> DataFrame:
    """(net, n_rects, bounding box) of rectangles with their net."""
    return rects.groupBy("net").agg(F.count("*").alias("n_rects"), *bounding_box())


def bind_labels(labels: DataFrame, rects: DataFrame) -> DataFrame:
    """labels (text_id and more) with the net under each, null where there is no metal. rects have their net; all of them under a label share it, so the least is theirs."""
    return points_bound(labels, rects, "text_id")


def net_labels(bound: DataFrame) -> DataFrame:
    """(net, name, n_names): the first label names a net; more than one different label is a conflict."""
    return bound.where("net is not null").groupBy("net").agg(F.min_by("value", "text_id").alias("name"), F.count_distinct("value").alias("n_names"))

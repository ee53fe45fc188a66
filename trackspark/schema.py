"""Table schemas and the fixed values of the scoring rules."""

from __future__ import annotations

from pyspark.sql import types as T

# Voxel size in micrometres (z, y, x), scoring weights, match cutoff.
DEFAULT_SCALE = (1.625, 0.40625, 0.40625)
BUDGET_ALPHA = 0.1
DIVISION_WEIGHT = 0.1
MATCH_RADIUS_UM = 7.0
LINK_RADIUS_UM = 9.0

NODES = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("node_id", T.LongType()),
    T.StructField("t", T.LongType()),
    T.StructField("z", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("x", T.DoubleType()),
])

EDGES = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("edge_id", T.LongType()),
    T.StructField("source_id", T.LongType()),
    T.StructField("target_id", T.LongType()),
])

VOXELS = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("t", T.LongType()),
    T.StructField("z", T.IntegerType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("x", T.IntegerType()),
    T.StructField("v", T.DoubleType()),
])

# Column order of the flat submission table.
SUBMISSION_COLUMNS = (
    "id", "dataset", "row_type", "node_id", "t", "z", "y", "x", "source_id", "target_id",
)
SUBMISSION = T.StructType([
    T.StructField(name, T.StringType() if name in ("dataset", "row_type") else T.LongType())
    for name in SUBMISSION_COLUMNS
])

METRIC_ROWS = T.StructType(
    [T.StructField("arm", T.StringType()), T.StructField("dataset", T.StringType())]
    + [T.StructField(name, T.LongType()) for name in (
        "edge_tp", "edge_fp", "edge_fn", "division_tp", "division_fp", "division_fn",
        "num_pred_nodes")]
    + [T.StructField(name, T.DoubleType()) for name in (
        "node_recall", "total_node_ratio", "edge_jaccard", "adj_edge_jaccard")]
)

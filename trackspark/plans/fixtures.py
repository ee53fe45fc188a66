"""Tracking tables derived from the driver's tables.

Each derivation is one SELECT over a driver table in integer arithmetic, written once
and used on both sides: Spark runs it through ``spark.sql`` and the oracle prepends it
as a CTE. ``~/`` stands for integer division, the one operator the two dialects spell
differently. Recordings hold at most 4,000 cells, so their number grows with the data.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from trackspark.session import ship_package

_TABLES = {
    # name: (tables it reads, SELECT)
    "cells": (("events",), """
        SELECT event_id AS node_id, cell, t,
               concat(CASE WHEN cell % 8 < 3 THEN '44b6' ELSE '6bba' END, '_',
                      CAST(cell % 8 AS STRING), '_', CAST(cell ~/ 4000 AS STRING)) AS dataset,
               CAST((cell * 37) % 31 AS DOUBLE) AS z,
               CAST((cell * 101) % 121 + (cell % 5 - 2) * t AS DOUBLE) AS y,
               CAST((cell * 197) % 119 + (cell % 7 - 3) * t AS DOUBLE) AS x,
               value
        FROM (SELECT event_id, event_id ~/ 20 AS cell, event_id % 20 AS t, value FROM events) e"""),
    "pred": (("cells",), """
        SELECT dataset, node_id, t, z, y + (node_id % 3 - 1) AS y,
               x + ((node_id * 7) % 5 - 2) AS x, value AS score
        FROM cells WHERE (cell * 3 + t * 5) % 7 <> 0"""),
    "gt": (("cells",), """
        SELECT dataset, node_id, t, z, y, x FROM cells WHERE (cell ~/ 8) % 4 = 0"""),
    # The true points as detections, of their own strength.
    "graded": (("cells",), """
        SELECT dataset, node_id, t, z, y, x, value AS score FROM cells WHERE (cell ~/ 8) % 4 = 0"""),
    "gt_edges": (("gt",), """
        SELECT dataset, node_id AS edge_id, node_id AS source_id, node_id + 1 AS target_id
        FROM gt WHERE t < 19"""),
    # Links of the same cell, plus a few of every malformation: a skipped frame, a
    # self-loop, a repeat, a merge, a division and a third child.
    "raw_edges": (("cells",), """
        SELECT dataset, edge_id, source_id, target_id, edge_prob FROM (
          SELECT dataset, node_id * 4 AS edge_id, node_id AS source_id,
                 node_id + 1 AS target_id, value / 500 AS edge_prob
          FROM cells WHERE t < 19
          UNION ALL
          SELECT dataset, node_id * 4 + 1,
                 CASE WHEN node_id % 97 = 4 THEN node_id - 160 ELSE node_id END,
                 CASE node_id % 97 WHEN 1 THEN node_id + 2 WHEN 2 THEN node_id
                      WHEN 5 THEN node_id - 159 ELSE node_id + 1 END,
                 value / 400
          FROM cells WHERE t < 18 AND node_id % 97 BETWEEN 1 AND 5
            AND node_id % 80000 >= 160
          UNION ALL
          SELECT dataset, node_id * 4 + 2, node_id, node_id - 159, value / 300
          FROM cells WHERE t < 18 AND node_id % 97 IN (3, 5) AND node_id % 80000 >= 160) r
        WHERE ((source_id ~/ 20) * 3 + (source_id % 20) * 5) % 7 <> 0
          AND ((target_id ~/ 20) * 3 + (target_id % 20) * 5) % 7 <> 0"""),
    "matches": (("cells",), """
        SELECT dataset, node_id AS pred_id, node_id AS gt_id FROM cells
        WHERE (cell * 3 + t * 5) % 7 <> 0 AND (cell ~/ 8) % 4 = 0 AND node_id % 11 <> 0"""),
    "budgets": (("cells",), """
        SELECT dataset, CAST(count(*) AS DOUBLE) AS est_total FROM cells GROUP BY dataset"""),
    # Fork-free links of the same cell between surviving detections.
    "clean_edges": (("cells",), """
        SELECT dataset, node_id AS edge_id, node_id AS source_id, node_id + 1 AS target_id,
               value / 500 AS edge_prob
        FROM cells WHERE t < 19 AND (cell * 3 + t * 5) % 7 <> 0
          AND (cell * 3 + (t + 1) * 5) % 7 <> 0"""),
    # The same links with the weak ones lost: tracks break, some nodes stand alone.
    "lossy_edges": (("clean_edges",), """
        SELECT dataset, edge_id, source_id, target_id, edge_prob FROM clean_edges
        WHERE edge_prob > 0.08"""),
    # Cells on a lattice wide enough that whatever belongs together has no competitor: the
    # optimum of every assignment on them is known. In all frames; and with frames missing.
    "apart": (("cells",), """
        SELECT dataset, node_id, cell, t, z,
               CAST(((cell % 4000) ~/ 8) % 25 * 140 + (cell % 5 - 2) * t + node_id % 3 - 1 AS DOUBLE) AS y,
               CAST(((cell % 4000) ~/ 8) ~/ 25 * 180 + (cell % 7 - 3) * t + (node_id * 7) % 5 - 2 AS DOUBLE) AS x
        FROM cells"""),
    "apart_some": (("apart",), """
        SELECT * FROM apart WHERE (cell * 3 + t * 5) % 7 <> 0"""),
    # A lone detection in some of the missing frames.
    "apart_lone": (("apart",), """
        SELECT * FROM apart WHERE (cell * 3 + t * 5) % 7 <> 0 OR cell % 3 = 0"""),
    # A second detection beside every third cell, never as far from the true point as the first.
    "apart_twins": (("apart_some",), """
        SELECT dataset, node_id, t, z, y, x FROM apart_some
        UNION ALL
        SELECT dataset, node_id + 10000000000, t, z + 0.3, y + (node_id * 11 % 7 - 3) * 0.5, x + (node_id * 5 % 9 - 4) * 0.5
        FROM apart_some WHERE cell % 3 = 0"""),
    "apart_gt": (("apart",), """
        SELECT dataset, node_id, t, z, y - (node_id % 3 - 1) AS y, x - ((node_id * 7) % 5 - 2) AS x
        FROM apart WHERE (cell ~/ 8) % 4 = 0"""),
    "voxels": (("embeddings",), """
        SELECT CAST(label AS STRING) AS dataset, vec_id AS t,
               CAST(p ~/ 16 AS INT) AS z, CAST((p ~/ 4) % 4 AS INT) AS y, CAST(p % 4 AS INT) AS x,
               CAST(v AS DOUBLE) AS v
        FROM {elements} e"""),
    "metric_base": (("lineitem",), """
        SELECT l_returnflag AS arm,
               concat(CASE WHEN l_suppkey % 2 = 0 THEN '44b6' ELSE '6bba' END, '_',
                      CAST(l_suppkey AS STRING)) AS dataset,
               CAST(sum(CASE WHEN l_discount < 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS edge_tp,
               CAST(sum(CASE WHEN l_discount >= 0.05 AND l_tax < 0.04 THEN 1 ELSE 0 END) AS BIGINT) AS edge_fp,
               CAST(sum(CASE WHEN l_discount >= 0.05 AND l_tax >= 0.04 THEN 1 ELSE 0 END) AS BIGINT) AS edge_fn,
               CAST(sum(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) AS BIGINT) AS division_fn,
               CAST(count(*) AS BIGINT) AS num_pred_nodes,
               CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS num_matched_nodes,
               CAST(count(*) AS BIGINT) AS num_gt_nodes,
               CAST(count(DISTINCT l_partkey) AS DOUBLE) AS est_total
        FROM lineitem GROUP BY l_returnflag, l_suppkey"""),
    "metric_rows": (("metric_base",), """
        SELECT arm, dataset, edge_tp, edge_fp, edge_fn, CAST(0 AS BIGINT) AS division_tp,
               CAST(0 AS BIGINT) AS division_fp, division_fn, num_pred_nodes, node_recall,
               total_node_ratio, edge_jaccard,
               greatest(CAST(0 AS DOUBLE), edge_jaccard * (CAST(1 AS DOUBLE) - CAST(0.1 AS DOUBLE) * total_node_ratio)) AS adj_edge_jaccard
        FROM (SELECT *, CAST(num_matched_nodes AS DOUBLE) / num_gt_nodes AS node_recall,
                     (num_pred_nodes - est_total) / est_total AS total_node_ratio,
                     CAST(edge_tp AS DOUBLE) / (edge_tp + edge_fp + edge_fn) AS edge_jaccard
              FROM metric_base) b"""),
    "folds": (("supplier",), """
        SELECT concat(CASE WHEN s_suppkey % 2 = 0 THEN '44b6' ELSE '6bba' END, '_',
                      CAST(s_suppkey AS STRING)) AS dataset, CAST(s_suppkey % 2 AS BIGINT) AS fold
        FROM supplier"""),
    "names": (("supplier",), """
        SELECT concat(CASE WHEN s_suppkey % 3 = 0 THEN '44b6' ELSE '6bba' END, '_',
                      CAST(s_suppkey AS STRING)) AS dataset, s_suppkey
        FROM supplier"""),
    # Image statistics per recording: counts by order class, intensity-like means.
    "features": (("orders",), """
        SELECT concat(CASE WHEN o_custkey % 2 = 0 THEN '44b6' ELSE '6bba' END, '_',
                      CAST(o_custkey ~/ 25 AS STRING), '_', CAST(o_custkey % 2 AS STRING)) AS dataset,
               CAST(sum(CASE WHEN o_orderpriority < '2' THEN 1 ELSE 0 END) AS DOUBLE) AS n_sep4,
               CAST(sum(CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END) AS DOUBLE) AS n_sep8,
               CAST(sum(CASE WHEN o_orderpriority < '5' THEN 1 ELSE 0 END) AS DOUBLE) AS n_sep16,
               CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS nstrong_sep4,
               CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS DOUBLE) AS nstrong_sep8,
               CAST(sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS DOUBLE) AS nstrong_sep16,
               avg(o_totalprice) / 500000 AS mean_int,
               CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS frac_fg,
               CAST(20 AS DOUBLE) AS t_frames,
               CAST(count(*) AS DOUBLE) * 20 + sum(CAST(o_orderkey % 50 AS DOUBLE)) AS est_total
        FROM orders GROUP BY o_custkey ~/ 25, o_custkey % 2"""),
}

# The float array becomes rows by each engine's own positional unnest.
_ELEMENTS = {
    "spark": "(SELECT label, vec_id, CAST(pos AS BIGINT) AS p, el AS v FROM embeddings "
             "LATERAL VIEW posexplode(embedding) u AS pos, el)",
    "duckdb": "(SELECT label, vec_id, unnest(range(0, len(embedding))) AS p, "
              "unnest(embedding) AS v FROM embeddings)",
}


def _text(name: str, dialect: str) -> str:
    text = _TABLES[name][1].replace("{elements}", _ELEMENTS[dialect])
    return text.replace("~/", "div" if dialect == "spark" else "//")


def ctes(*names: str) -> str:
    """``WITH`` prefix for DuckDB defining the named tables and what they read."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in _TABLES and name not in ordered:
            for parent in _TABLES[name][0]:
                visit(parent)
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_text(n, 'duckdb')})" for n in ordered)


class Inputs:
    """The driver's tables and their derivations, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship_package(spark)
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            if name in _TABLES:
                sources = {p: getattr(self, p) for p in _TABLES[name][0]}
                text = _text(name, "spark")
                # spark.sql resolves {name} to the DataFrame passed under that name.
                for p in sources:
                    text = text.replace(f"FROM {p}", "FROM {" + p + "}")
                self._built[name] = self.spark.sql(text, **sources)
            else:
                self._built[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._built[name]

    @cached_property
    def dims(self) -> tuple[int, int, int]:
        return (31, 121, 119)

"""End-to-end plans and streaming, run over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.functions.geometry import with_um
from trackspark.operators import assign, score
from trackspark.plans import predict as P
from trackspark.plans.fixtures import Inputs, ctes
from trackspark.plans.registry import query, r6
from trackspark.plans.spatial_queries import nearest_sql
from trackspark.session import cut_lineage, shared_dir
from trackspark.streaming import online

SCALE = (1.625, 1.625, 1.625)


def _meta(i: Inputs):
    return i.voxels.groupBy("dataset").agg(
        F.lit(-0.25).alias("q_lo"), F.lit(0.25).alias("q_hi"), (F.max("t") + 1).alias("n_t"),
        (F.count(F.lit(1)) / 20).alias("est_total"))


@query("g2_predicted_graph", "G2 G1 T2 P2")
def predicted_graph(i: Inputs):
    arm = P.Arm(P.Finder("bands", (1, 1, 1), 3.5), P.Room(fill=1.0))
    nodes, edges = P.predict(i.voxels, _meta(i), SCALE, arm)
    return nodes.groupBy("dataset").agg(F.count(F.lit(1)).alias("nodes")).join(
        edges.groupBy("dataset").agg(F.count(F.lit(1)).alias("edges")), "dataset", "left").fillna(0)


@query("s9_submission_from_voxels", "S8 S9")
def submission_from_voxels(i: Inputs):
    arm = P.Arm(P.Finder("peaks", (1, 1, 1), 5.0, floor=0.8))
    rows, _ = P.submit(i.voxels, _meta(i), SCALE, arm)
    return rows


@query("x3_radius_sweep", "X3 X1 J19")
def radius_sweep(i: Inputs):
    """Arms that differ in the link radius: one assignment, one cut per radius."""
    nodes = cut_lineage(i.pred, "nodes")
    links = cut_lineage(assign.link_optimal(with_um(nodes), 9.0), "links")
    matches = cut_lineage(assign.match_nodes(nodes, i.gt), "matches")
    out = None
    for radius in (9.0, 7.0, 5.0, 4.0):
        edges = links.where(F.col("d") <= radius).select(
            "dataset", F.col("source_id").alias("edge_id"), "source_id", "target_id")
        rows = score.metric_rows(score.edge_counts(nodes, edges, matches, i.gt, i.gt_edges), i.budgets)
        arm = rows.withColumn("arm", F.lit(f"r{radius:g}"))
        out = arm if out is None else out.unionByName(arm)
    return score.summarise(out, ["arm"])


@query("f18_projected_run_time", "F18", """
SELECT CAST(round((40 + count(*)) * 9 * 1.3 + count(*) * 45.0, 6) AS DOUBLE) AS seconds FROM supplier""")
def projected_run_time(i: Inputs):
    return P.projected_seconds(i.supplier, 40, 9).select(r6("seconds"))


@query("a20_predicted_budgets", "A20")
def predicted_budgets(i: Inputs):
    from trackspark.functions.scalars import embryo
    train = i.features.where(embryo(F.col("dataset")) == "44b6")
    test = i.features.where(embryo(F.col("dataset")) == "6bba")
    return P.predicted_budgets(train, test)


# -- streaming -------------------------------------------------------------------

def _out(i: Inputs, name: str) -> str:
    import uuid
    return f"{shared_dir(i.spark)}/streams/{name}-{uuid.uuid4().hex}"


def _stream(i: Inputs, table: str):
    schema = getattr(i, table).schema
    files = i.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(i.sf_dir)
    # Event times need an instant; zoneless times are read as UTC whatever the session zone.
    if dict(i.events.dtypes)["ts"] == "timestamp_ntz":
        files = files.withColumn("ts", F.timestamp_micros(F.expr(
            "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")))
    return files


def _zoneless(name: str):
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({name}), TIMESTAMP_NTZ'1970-01-01 00:00:00')").alias(name)


def _ended(events, key: str, marker):
    """The events, plus a few markers far beyond them that let the watermark pass the last ones."""
    rows = F.when(F.col("event_id") % 1000 == 0, F.array(
        F.struct(F.col(key).alias(key), "ts"),
        F.struct(marker.alias(key), (F.col("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"))))
    return events.select(F.explode(F.coalesce(rows, F.array(F.struct(key, "ts")))).alias("r")).select("r.*")


@query("st4_windowed_counts", "ST4", """
SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01 00:00:00') AS start, event_type, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY 1, 2""")
def windowed_counts(i: Inputs):
    path = _out(i, "counts")
    events = _ended(_stream(i, "events"), "event_type", F.lit("~"))
    online.run_available(online.windowed_counts(events, "ts", ["event_type"], "6 hours", "1 hour"), path)
    return i.spark.read.parquet(path).where("event_type <> '~'").select(_zoneless("start"), "event_type", "n")


@query("st4_sessions", "ST4", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def sessions(i: Inputs):
    path = _out(i, "sessions")
    events = _ended(_stream(i, "events"), "user_id", F.lit(-1).cast(dict(i.events.dtypes)["user_id"]))
    online.run_available(online.activity_sessions(events, "ts", ["user_id"], "12 hours", "1 hour"), path)
    return i.spark.read.parquet(path).where("user_id <> -1").select("user_id", _zoneless("start"), "n")


@query("st5_drop_repeats", "ST5", """
SELECT DISTINCT event_id FROM events""")
def drop_repeats(i: Inputs):
    path = _out(i, "repeats")
    # Every event arrives twice in the stream.
    twice = _stream(i, "events").select("event_id", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    online.run_available(online.drop_repeats(twice, "ts", ["event_id"], "1 hour"), path)
    return i.spark.read.parquet(path).select("event_id")


def _detections(events):
    cell, t = F.floor(F.col("event_id") / 20), F.col("event_id") % 20
    name = F.concat(F.when(cell % 8 < 3, "44b6").otherwise("6bba"), F.lit("_"), (cell % 8).cast("string"),
                    F.lit("_"), F.floor(cell / 4000).cast("string"))
    e = events.select(
        name.alias("dataset"), F.col("event_id").alias("node_id"), t.alias("t"),
        ((cell * 37) % 31).cast("double").alias("z"),
        ((cell * 101) % 121 + (cell % 5 - 2) * t + F.col("event_id") % 3 - 1).cast("double").alias("y"),
        ((cell * 197) % 119 + (cell % 7 - 3) * t + (F.col("event_id") * 7) % 5 - 2).cast("double").alias("x"),
        F.timestamp_seconds(F.lit(1_704_067_200) + t).alias("ts"), cell.alias("cell"))
    return e.where((F.col("cell") * 3 + F.col("t") * 5) % 7 != 0).drop("cell")


def _closing(detections):
    """The detections, plus a marker a day later after each last frame.

    A marker belongs to no recording and links to nothing; it lets the watermark pass
    the last frames, as the next recording would in a stream that goes on.
    """
    marker = F.struct(F.concat(F.lit("~"), "dataset").alias("dataset"), F.lit(-2).cast("bigint").alias("t"),
                      (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    own = F.struct("dataset", "t", "ts")
    rows = F.when(F.col("t") == 19, F.array(own, marker)).otherwise(F.array(own))
    return (detections.withColumn("_r", F.explode(rows)).drop("dataset", "t", "ts")
            .select("node_id", "z", "y", "x", "_r.*"))


@query("st2_online_links", "ST2", ctes("pred") + f"""
SELECT dataset, t, source_id, target_id, round(d, 6) AS d FROM ({nearest_sql('pred', 9)}) n""")
def online_links(i: Inputs):
    from trackspark.streaming.linker import rocks_state
    path = _out(i, "links")
    links = online.online_nearest_links(
        _closing(_detections(_stream(i, "events"))), _closing(_detections(_stream(i, "events"))), 9.0)
    with rocks_state(i.spark):
        online.run_available(links, path)
    return i.spark.read.parquet(path).select("dataset", "t", "source_id", "target_id", r6("d"))


#: Events for which a step of the split stream is written and read as one more file.
_FILE_EVENTS = 500_000


def _split_files(i: Inputs, name: str) -> tuple[str, int, int]:
    """The detections as five steps of frames that overlap, the instant of frame 0, and the files a step.

    Odd nodes of every fifth frame are in the step after the even ones, so frames are split over
    the batches of a stream that reads one step at a time. The last step only moves the watermark.
    Every step but that is written as the same number of files, which grows with the events: rows are
    dealt in turn, so no file is left out.
    """
    path = _out(i, name)
    files = int(max(1, min(i.spark.sparkContext.defaultParallelism, i.events.count() // _FILE_EVENTS)))
    rows = _detections(i.events).withColumn("_file", F.floor((F.col("t") + F.col("node_id") % 2) / 5).cast("int"))
    start = 1_704_067_200
    end = i.spark.range(1).select(
        F.lit("~").alias("dataset"), F.lit(-1).cast("bigint").alias("node_id"), F.lit(-2).cast("bigint").alias("t"),
        *[F.lit(0.0).alias(a) for a in "zyx"], F.timestamp_seconds(F.lit(start + 86_400)).alias("ts"))
    for k in range(6):
        part = rows.where(F.col("_file") == k).drop("_file") if k < 5 else end
        part = part.select(*end.columns)
        dealt = part.coalesce(1) if files == 1 or k == 5 else part.repartition(files)
        dealt.write.mode("append").parquet(path)
    return path, start * 1000, files


def _linked_in_batches(i: Inputs, name: str):
    from trackspark.streaming.linker import online_links, run_stateful
    source, start, files = _split_files(i, f"{name}-files")
    stream = (i.spark.readStream.schema(i.spark.read.parquet(source).schema).option("maxFilesPerTrigger", files)
              .parquet(source))
    path = _out(i, name)
    batches = run_stateful(online_links(stream, 9.0, start), path)
    return source, i.spark.read.parquet(f"{path}/batch=*"), batches


@query("st2_stateful_links", "ST2", ctes("pred") + f"""
SELECT dataset, t, source_id, target_id, round(d, 6) AS d, true AS in_batches FROM ({nearest_sql('pred', 9)}) n""")
def stateful_links(i: Inputs):
    """The same links from frames that are split over the batches of a stream."""
    _, links, batches = _linked_in_batches(i, "stateful")
    return links.select("dataset", "t", "source_id", "target_id", r6("d"), F.lit(batches >= 6).alias("in_batches"))


@query("st1_stateful_rows", "ST1", ctes("pred") + f"""
SELECT dataset, 'node' AS row_type, node_id, t, CAST(round_even(z, 0) AS BIGINT) AS z, CAST(round_even(y, 0) AS BIGINT) AS y,
  CAST(round_even(x, 0) AS BIGINT) AS x, CAST(-1 AS BIGINT) AS source_id, CAST(-1 AS BIGINT) AS target_id FROM pred
UNION ALL SELECT dataset, 'edge', -1, -1, -1, -1, -1, source_id, target_id FROM ({nearest_sql('pred', 9)}) n""")
def stateful_rows(i: Inputs):
    """Submission rows of a stream; links across batches are there as well."""
    from trackspark.operators.submission import flat_rows
    source, links, _ = _linked_in_batches(i, "stateful-rows")
    nodes = i.spark.read.parquet(source).where("t >= 0").select("dataset", "node_id", "t", "z", "y", "x")
    edges = links.select("dataset", F.col("source_id").alias("edge_id"), "source_id", "target_id")
    return flat_rows(nodes, edges).drop("_kind", "_ord")


@query("st3_online_motion_links", "ST3")
def online_motion_links(i: Inputs):
    path = _out(i, "motion")
    linker = online.MotionLinker(path, f"{path}-state")
    (_detections(_stream(i, "events")).writeStream.foreachBatch(linker).trigger(availableNow=True)
     .option("checkpointLocation", f"{path}-checkpoint").start().awaitTermination())
    return i.spark.read.parquet(path).select("dataset", "source_id", "target_id", r6("motion_um"))


@query("st1_streamed_rows", "ST1", ctes("pred") + f"""
SELECT dataset, 'node' AS row_type, node_id, t, CAST(round_even(z, 0) AS BIGINT) AS z, CAST(round_even(y, 0) AS BIGINT) AS y,
  CAST(round_even(x, 0) AS BIGINT) AS x, CAST(-1 AS BIGINT) AS source_id, CAST(-1 AS BIGINT) AS target_id FROM pred
UNION ALL SELECT dataset, 'edge', -1, -1, -1, -1, -1, source_id, target_id FROM ({nearest_sql('pred', 9)}) n""")
def streamed_rows(i: Inputs):
    from trackspark.operators.spatial import nearest_links
    from trackspark.schema import SUBMISSION
    path = _out(i, "rows")

    def build(batch):
        nodes = cut_lineage(batch.select("dataset", "node_id", "t", "z", "y", "x"), "batch")
        links = nearest_links(with_um(nodes), 9.0)
        return nodes, links.select("dataset", F.col("source_id").alias("edge_id"), "source_id", "target_id")

    (_detections(_stream(i, "events")).writeStream.foreachBatch(online.SubmissionWriter(build, path))
     .trigger(availableNow=True).option("checkpointLocation", f"{path}-checkpoint").start().awaitTermination())
    fields = [f for f in SUBMISSION.fields if f.name != "id"]
    return i.spark.read.schema(SUBMISSION.__class__(fields)).option("header", "true").csv(f"{path}/batch=*")


@query("s10_missing_results", "S10", ctes("metric_rows") + """
SELECT arm, dataset FROM metric_rows WHERE edge_jaccard <= 0.45""")
def missing(i: Inputs):
    from trackspark.sources.results import missing_results, read_results, write_results
    path = _out(i, "results")
    write_results(i.metric_rows.where("edge_jaccard > 0.45"), path)
    return missing_results(i.metric_rows, read_results(i.spark, path))

"""Metadata documents, discussion threads, indexes and frozen frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackspark.functions import scalars
from trackspark.functions.geometry import with_um
from trackspark.operators import extras, threads
from trackspark.plans.fixtures import Inputs, ctes
from trackspark.plans.registry import query, r6
from trackspark.plans.spatial_queries import _D
from trackspark.sources import metadata


def _docs(i: Inputs):
    """A metadata document per supplier in one of four layouts."""
    n = F.col("s_suppkey")
    budget = (n * 37 % 5000).cast("string")
    layouts = [
        F.concat(F.lit('{"extra":{"notes":[1,{"estimated_number_of_nodes":'), budget, F.lit('}]},"k":2}')),
        F.concat(F.lit('{"a":{"estimated_number_of_nodes":7},"estimated_number_of_nodes":'), budget, F.lit("}")),
        F.concat(F.lit('{"multiscales":[{"datasets":[{"coordinateTransformations":[{"type":"scale","scale":[1,1,2.0,'),
                 (n % 3 + 1).cast("string"), F.lit(',0.5]}]}]}],"image_statistics":{"quantiles":{"0.001":'),
                 budget, F.lit(',"0.999":9000}}}')),
        F.lit('{"nothing":[[],{}]}'),
    ]
    doc = F.when(n % 4 == 0, layouts[0]).when(n % 4 == 1, layouts[1]).when(n % 4 == 2, layouts[2]).otherwise(layouts[3])
    return i.names.select("dataset", doc.alias("attrs"))


@query("s2_node_budget", "S2 F6 D3", ctes("names") + """
SELECT dataset, CASE WHEN s_suppkey % 4 < 2 THEN CAST(s_suppkey * 37 % 5000 AS DOUBLE) END AS est_total FROM names""")
def node_budget(i: Inputs):
    return metadata.node_budget(_docs(i), ["attrs"])


@query("s3_voxel_scale", "S3 S4", ctes("names") + """
SELECT dataset, CASE WHEN s_suppkey % 4 = 2 THEN 2.0::DOUBLE ELSE 1.625::DOUBLE END AS sz,
  CASE WHEN s_suppkey % 4 = 2 THEN CAST(s_suppkey % 3 + 1 AS DOUBLE) * 4 ELSE 0.40625::DOUBLE * 4 END AS vy,
  CASE WHEN s_suppkey % 4 = 2 THEN CAST(s_suppkey * 37 % 5000 AS DOUBLE) ELSE 0::DOUBLE END AS q_lo FROM names""")
def voxel_scale(i: Inputs):
    m = metadata.movie_table(_docs(i), "attrs")
    return m.select("dataset", F.col("scale")[0].alias("sz"), F.col("voxel_um")[1].alias("vy"), "q_lo")


_TREE = """WITH RECURSIVE c AS (SELECT conv_id AS topic, turn AS comment,
  CASE WHEN role = 'assistant' AND turn > 0 THEN turn - 1 END AS parent, role, text FROM conversations),
f(topic, comment, depth, path) AS (SELECT topic, comment, 0, [comment] FROM c WHERE parent IS NULL
  UNION ALL SELECT c.topic, c.comment, f.depth + 1, list_append(f.path, c.comment) FROM c
  JOIN f ON f.topic = c.topic AND f.comment = c.parent)
"""


def _comments(i: Inputs):
    parent = F.when((F.col("role") == "assistant") & (F.col("turn") > 0), F.col("turn") - 1)
    return i.conversations.select(F.col("conv_id").alias("topic"), F.col("turn").alias("comment"),
                                  parent.alias("parent"), F.col("role").alias("author"), F.col("text").alias("body"))


@query("f11_reply_tree", "F11 D12 S13", _TREE + """
SELECT topic, comment, depth, array_to_string(path, '/') AS path FROM f""")
def reply_tree(i: Inputs):
    return threads.flatten_parents(_comments(i)).withColumn(
        "path", F.array_join(F.transform("path", lambda p: p.cast("string")), "/"))


@query("f12_rendered_comments", "F12", _TREE + """
SELECT f.topic, f.comment, concat(chr(10), CASE WHEN depth = 0 THEN '### ' ELSE '#### ' END, repeat('↳ ', least(depth, 3)), role, ' — ',
  chr(10), chr(10), repeat('> ', depth), replace(CASE WHEN rtrim(text, chr(10) || ' ' || chr(9) || chr(13)) = '' THEN '*(empty)*'
   ELSE rtrim(text, chr(10) || ' ' || chr(9) || chr(13)) END, chr(10), concat(chr(10), repeat('> ', depth)))) AS block
FROM f JOIN c USING (topic, comment)""")
def rendered_comments(i: Inputs):
    c = _comments(i)
    flat = threads.flatten_parents(c).join(c.drop("parent"), ["topic", "comment"]).withColumns({
        "tier": F.lit(""), "posted": F.lit(""), "votes": F.lit(0)})
    blocks = threads.render_comments(flat)
    return blocks.select("topic", F.element_at("path", -1).alias("comment"), "block")


@query("f12_rendered_threads", "F12", _TREE + """,
b AS (SELECT f.topic, f.path, concat(chr(10), CASE WHEN depth = 0 THEN '### ' ELSE '#### ' END, repeat('↳ ', least(depth, 3)), role, ' — ',
  chr(10), chr(10), repeat('> ', depth), replace(CASE WHEN rtrim(text, chr(10) || ' ' || chr(9) || chr(13)) = '' THEN '*(empty)*'
   ELSE rtrim(text, chr(10) || ' ' || chr(9) || chr(13)) END, chr(10), concat(chr(10), repeat('> ', depth)))) AS block
FROM f JOIN c USING (topic, comment))
SELECT topic, CAST(count(*) AS BIGINT) AS n, sha1(string_agg(block, chr(10) ORDER BY path)) AS digest FROM b GROUP BY topic""")
def rendered_threads(i: Inputs):
    c = _comments(i)
    flat = threads.flatten_parents(c).join(c.drop("parent"), ["topic", "comment"]).withColumns({
        "tier": F.lit(""), "posted": F.lit(""), "votes": F.lit(0)})
    topics = c.groupBy("topic").agg(F.lit("t").alias("title"), F.lit("a").alias("author"), F.lit("").alias("posted"),
                                    F.lit(0).alias("votes"), F.lit("x").alias("body"))
    text = threads.render_threads(flat, topics)
    body = F.regexp_extract("markdown", r"(?s)## Comments \(\d+\)\n(.*)\n$", 1)
    return text.select("topic", F.regexp_extract("markdown", r"## Comments \((\d+)\)\n", 1).cast("bigint").alias("n"),
                       F.sha1(body).alias("digest"))


@query("f9_slugs", "F9", """
SELECT doc_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (
  SELECT doc_id, regexp_replace(left(regexp_replace(regexp_replace(lower(concat(source, ' ', text)), '[^a-z0-9]+', '-', 'g'),
    '^-+|-+$', '', 'g'), 60), '-+$', '') AS s FROM documents) q""")
def slugs(i: Inputs):
    return i.documents.select("doc_id", scalars.slugify(F.concat("source", F.lit(" "), F.col("text"))).alias("slug"))


@query("f10_author_and_votes", "F10", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE CASE WHEN page_id % 3 = 1 THEN 'flat' ELSE 'unknown' END END AS author,
  CAST(CASE page_id % 4 WHEN 0 THEN page_id WHEN 1 THEN page_id * 2 ELSE 0 END AS BIGINT) AS votes FROM pages""")
def author_and_votes(i: Inputs):
    p = F.col("page_id")
    nested = F.when(p % 3 == 0, F.col("url"))
    flat = F.when(p % 3 == 1, F.lit("flat"))
    votes = (F.when(p % 4 == 0, p.cast("string"))
             .when(p % 4 == 1, F.concat(F.lit('{"totalVotes":'), (p * 2).cast("string"), F.lit("}")))
             .when(p % 4 == 2, F.lit('{"other":1}')))
    return i.pages.select("page_id", threads.author_name(nested, flat).alias("author"),
                          threads.vote_count(votes).alias("votes"))


@query("f14_index_rows", "F14 T7", """
SELECT page_id, concat('| ', page_id % 17, ' | ', page_id % 5, ' | 2024-01-01 | ', CASE WHEN page_id % 10 = 0 THEN '📌 ' ELSE '' END,
  '[', replace(html, '|', '\\|'), '](threads/', page_id, '.md) | ', url, ' |') AS line,
  CAST(row_number() OVER (ORDER BY page_id % 10 = 0 DESC, page_id % 17 DESC, page_id) AS BIGINT) AS pos FROM pages""")
def index_rows(i: Inputs):
    from trackspark.operators.ordering import rank_rows
    p = F.col("page_id")
    rows = i.pages.select("page_id", (p % 17).alias("votes"), (p % 5).alias("comments"), F.lit("2024-01-01").alias("posted"),
                          (p % 10 == 0).alias("pinned"), F.col("html").alias("title"),
                          F.concat(p.cast("string"), F.lit(".md")).alias("file"), F.col("url").alias("author"))
    ranked = rank_rows(rows.withColumn("_pin", F.col("pinned").cast("int")), [], ["-_pin", "-votes", "page_id"], "pos")
    return ranked.select("page_id", threads.index_row("title", "file").alias("line"), "pos")


@query("u6_first_seen_topic", "U6 S13", """
SELECT conv_id AS id, min(turn) AS page FROM conversations GROUP BY conv_id""")
def first_seen(i: Inputs):
    listing = i.conversations.select(F.col("conv_id").alias("id"), F.col("turn").alias("page"), F.lit(0).alias("pos"), "role")
    return threads.first_seen(listing).select("id", "page")


@query("a28_comment_totals", "A28", """
SELECT conv_id AS topic, CAST(max(turn) + 1 AS BIGINT) AS declared,
  CAST(count(*) AS BIGINT) AS fetched, (count(*) < max(turn) + 1) AS incomplete FROM conversations GROUP BY conv_id""")
def comment_totals(i: Inputs):
    topics = i.conversations.groupBy(F.col("conv_id").alias("topic")).agg((F.max("turn") + 1).alias("declared"))
    return threads.comment_totals(topics, _comments(i))


@query("a29_score_table", "A29", """
SELECT CAST(count(*) AS BIGINT) AS teams, round(max(s_acctbal), 6) AS top, round(quantile_cont(s_acctbal, 0.5), 6) AS median,
  CAST(sum(CASE WHEN s_acctbal >= 5000 THEN 1 ELSE 0 END) AS BIGINT) AS above FROM supplier""")
def score_table(i: Inputs):
    scores = i.supplier.select(F.col("s_acctbal").cast("string").alias("display"))
    return extras.leaderboard_summary(scores, "display", 5000.0).select("teams", r6("top"), r6("median"), "above")


@query("n1_frozen_frames", "N1", ctes("voxels") + """,
f AS (SELECT dataset, t, string_agg(CAST(round(v * 2) AS INT) || '', ',' ORDER BY z, y, x) AS s FROM voxels GROUP BY 1, 2),
l AS (SELECT dataset, t, s, lag(s) OVER (PARTITION BY dataset ORDER BY t) AS p FROM f)
SELECT dataset, CAST(sum(CASE WHEN s = p THEN 1 ELSE 0 END) AS BIGINT) AS frozen, CAST(count(*) AS BIGINT) AS frames FROM l GROUP BY dataset""")
def frozen_frames(i: Inputs):
    # Frames of a recording are those listed for it, numbered in order.
    coarse = i.voxels.withColumn("v", F.round(F.col("v") * 2))
    return extras.frozen_frames(coarse, by="dataset")


@query("n3_bulk_motion", "N3", ctes("gt_edges") + """,
m AS (SELECT e.dataset, s.t, d.z-s.z AS dz, d.y-s.y AS dy, d.x-s.x AS dx FROM gt_edges e
  JOIN gt s ON s.dataset=e.dataset AND s.node_id=e.source_id JOIN gt d ON d.dataset=e.dataset AND d.node_id=e.target_id)
SELECT dataset, t, round(quantile_cont(dz, 0.5), 6) AS mz, round(quantile_cont(dy, 0.5), 6) AS my,
  round(quantile_cont(dx, 0.5), 6) AS mx FROM m GROUP BY 1, 2""")
def bulk_motion(i: Inputs):
    return extras.bulk_motion(i.gt, i.gt_edges).select("dataset", "t", r6("mz"), r6("my"), r6("mx"))


@query("n4_motion_outliers", "N4", ctes("gt_edges") + """,
m AS (SELECT e.dataset, s.t, e.edge_id, s.z, s.y, s.x, d.z-s.z AS dz, d.y-s.y AS dy, d.x-s.x AS dx FROM gt_edges e
  JOIN gt s ON s.dataset=e.dataset AND s.node_id=e.source_id JOIN gt d ON d.dataset=e.dataset AND d.node_id=e.target_id),
n AS (SELECT a.dataset, a.edge_id, a.dz, a.dy, a.dx, quantile_cont(b.dz, 0.5) AS mz, quantile_cont(b.dy, 0.5) AS my, quantile_cont(b.dx, 0.5) AS mx
  FROM m a JOIN m b ON a.dataset=b.dataset AND a.t=b.t AND a.edge_id<>b.edge_id
   AND sqrt((a.z-b.z)*1.625*((a.z-b.z)*1.625)+(a.y-b.y)*0.40625*((a.y-b.y)*0.40625)+(a.x-b.x)*0.40625*((a.x-b.x)*0.40625)) <= 20
  GROUP BY 1, 2, 3, 4, 5)
SELECT dataset, edge_id, round(sqrt((dz-mz)*1.625*((dz-mz)*1.625)+(dy-my)*0.40625*((dy-my)*0.40625)+(dx-mx)*0.40625*((dx-mx)*0.40625)), 6) AS residual FROM n""")
def motion_outliers(i: Inputs):
    return extras.motion_residuals(i.gt, i.gt_edges, 20.0).select("dataset", "edge_id", r6("residual"))


@query("n2_merged_detections", "N2", ctes("pred", "gt") + f""",
dets AS (SELECT dataset, t, node_id, z, y, x, score FROM pred UNION ALL
  SELECT dataset, t, node_id + 10000000000, z, y, x, CAST(1 AS DOUBLE) FROM gt),
rk AS (SELECT *, row_number() OVER (PARTITION BY dataset, t ORDER BY score DESC, node_id) AS k FROM dets),
nb AS (SELECT a.dataset, a.t, a.k, list(b.k) AS stronger FROM rk a JOIN rk b ON a.dataset = b.dataset AND a.t = b.t AND b.k < a.k
  WHERE {_D} <= 2 GROUP BY ALL),
walk(dataset, t, k, node_id, took, kept) AS (
  SELECT DISTINCT dataset, t, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), false, CAST([] AS BIGINT[]) FROM rk
  UNION ALL
  SELECT w.dataset, w.t, r.k, r.node_id, NOT list_has_any(w.kept, coalesce(n.stronger, [])),
    CASE WHEN list_has_any(w.kept, coalesce(n.stronger, [])) THEN w.kept ELSE list_append(w.kept, r.k) END
  FROM walk w JOIN rk r ON r.dataset = w.dataset AND r.t = w.t AND r.k = w.k + 1
  LEFT JOIN nb n ON n.dataset = r.dataset AND n.t = r.t AND n.k = r.k)
SELECT dataset, node_id FROM walk WHERE took""")
def merged_detections(i: Inputs):
    other = i.gt.withColumn("score", F.lit(1.0))
    both = i.pred.unionByName(other.withColumn("node_id", F.col("node_id") + 10_000_000_000))
    return extras.merge_detections(with_um(both), 2.0).select("dataset", "node_id")

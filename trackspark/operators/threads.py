"""Discussion threads: reply trees, rendering, indexes and score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackspark.functions.scalars import escape_pipes
from trackspark.session import cut_lineage, is_empty


def author_name(nested: Column, flat: Column) -> Column:
    return F.coalesce(nested, flat, F.lit("unknown"))


def author_tier(nested: Column, flat: Column) -> Column:
    return F.coalesce(nested, flat, F.lit("")).cast("string")


def vote_count(votes: Column) -> Column:
    """Votes arrive as a number or as an object with ``totalVotes`` (JSON text)."""
    nested = F.get_json_object(votes, "$.totalVotes").try_cast("bigint")
    return F.coalesce(votes.try_cast("bigint"), nested, F.lit(0).cast("bigint"))


def flatten_nested(comments: DataFrame) -> DataFrame:
    """Unroll ``comments array<struct<…, replies>>`` per topic to rows with depth and path.

    ``path`` orders rows depth first. Levels go on for as long as the column type nests.
    """
    level = comments.select("topic", F.posexplode("comments").alias("_i", "_c")).select(
        "topic", F.lit(0).alias("depth"), F.array("_i").alias("path"), "_c")
    out = None
    while True:
        fields = level.schema["_c"].dataType.names
        rows = level.select("topic", "depth", "path",
                            *[F.col(f"_c.{f}").alias(f) for f in fields if f != "replies"])
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        if "replies" not in fields:
            return out
        level = level.select("topic", "depth", "path", F.posexplode("_c.replies").alias("_i", "_r")).select(
            "topic", (F.col("depth") + 1).alias("depth"),
            F.concat("path", F.array("_i")).alias("path"), F.col("_r").alias("_c"))


def flatten_parents(comments: DataFrame) -> DataFrame:
    """Depth and depth-first path of comments given as (topic, comment, parent) rows.

    One join per level; the loop ends when a level is empty, so any depth works. A comment
    whose parent is not there is a root of its own.
    """
    known = comments.select("topic", F.col("comment").alias("parent"), F.lit(True).alias("_known")).distinct()
    step = (comments.select("topic", "comment", "parent").join(known, ["topic", "parent"], "left")
            .withColumn("parent", F.when(F.col("_known"), F.col("parent"))).drop("_known"))
    level = cut_lineage(
        step.where("parent IS NULL")
        .select("topic", "comment", F.lit(0).alias("depth"), F.array("comment").alias("path")),
        "level")
    out = level
    while True:
        level = cut_lineage(
            step.join(level.select("topic", F.col("comment").alias("parent"), "depth", "path"),
                      ["topic", "parent"])
            .select("topic", "comment", (F.col("depth") + 1).alias("depth"),
                    F.concat("path", F.array("comment")).alias("path")), "level")
        if is_empty(level):
            return out
        out = out.unionByName(level)


def render_comments(flat: DataFrame) -> DataFrame:
    """One Markdown heading-plus-body block per comment, quoted to its depth.

    ``flat`` has topic, depth, path, author, tier, posted, votes, body.
    """
    quote = F.repeat(F.lit("> "), F.col("depth"))
    arrows = F.repeat(F.lit("↳ "), F.least("depth", F.lit(3)))
    head = F.concat(
        F.when(F.col("depth") == 0, F.lit("### ")).otherwise(F.lit("#### ")), arrows,
        F.col("author"), F.when(F.col("tier") != "", F.concat(F.lit(" ("), "tier", F.lit(")")))
        .otherwise(""), F.lit(" — "), F.coalesce("posted", F.lit("")),
        F.when(F.col("votes") != 0, F.concat(F.lit(" — "), F.col("votes").cast("string"),
                                             F.lit(" votes"))).otherwise(""))
    text = F.regexp_replace(F.coalesce("body", F.lit("")), "\\s+$", "")
    shown = F.when(text == "", F.lit("*(empty)*")).otherwise(text)
    body = F.array_join(F.transform(F.split(shown, "\n"), lambda ln: F.concat(quote, ln)), "\n")
    return flat.select("topic", "path", F.concat(
        F.lit("\n"), head, F.lit("\n\n"), body).alias("block"))


def render_threads(flat: DataFrame, topics: DataFrame) -> DataFrame:
    """A thread as one Markdown text per topic.

    The text of a topic is the output value itself, so its comments meet in one row.
    ``topics`` has topic, title, author, posted, votes, body.
    """
    blocks = render_comments(flat).groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "block"))),
                                 lambda s: s["block"]), "\n").alias("text"))
    joined = topics.join(blocks, "topic", "left").fillna(0, ["n"])
    return joined.select("topic", F.concat(
        F.lit("# "), "title", F.lit("\n\n- **Topic id**: "), F.col("topic").cast("string"),
        F.lit("\n- **Author**: "), "author", F.lit("\n- **Posted**: "), "posted",
        F.lit("\n- **Votes**: "), F.col("votes").cast("string"),
        F.lit("\n- **Comments**: "), F.col("n").cast("string"),
        F.lit("\n\n---\n\n## Opening post\n\n"),
        F.when(F.coalesce("body", F.lit("")) == "", "*(no body)*").otherwise(F.col("body")),
        F.lit("\n\n---\n\n## Comments ("), F.col("n").cast("string"), F.lit(")\n"),
        F.coalesce("text", F.lit("\n*(none)*")), F.lit("\n")).alias("markdown"))


def index_row(title: str, file: str) -> Column:
    """One Markdown table row of the thread index."""
    pin = F.when(F.col("pinned"), F.lit("📌 ")).otherwise("")
    return F.concat(F.lit("| "), F.col("votes").cast("string"), F.lit(" | "),
                    F.col("comments").cast("string"), F.lit(" | "), F.col("posted"),
                    F.lit(" | "), pin, F.lit("["), escape_pipes(F.col(title)),
                    F.lit("](threads/"), F.col(file), F.lit(") | "), F.col("author"), F.lit(" |"))


def first_seen(topics: DataFrame) -> DataFrame:
    """One row per topic id over several pages: the first by (page, position)."""
    rest = [c for c in topics.columns if c not in ("id", "page", "pos")]
    return (topics.groupBy("id").agg(F.min(F.struct("page", "pos", *rest)).alias("_t"))
            .select("id", "_t.*"))


def comment_totals(topics: DataFrame, comments: DataFrame) -> DataFrame:
    """Fetched against declared comment counts per topic."""
    got = comments.groupBy("topic").agg(F.count(F.lit(1)).alias("fetched"))
    return (topics.join(got, "topic", "left").fillna(0, ["fetched"])
            .select("topic", "declared", "fetched",
                    (F.col("fetched") < F.col("declared")).alias("incomplete")))

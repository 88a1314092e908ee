"""Shares of water sources that reach a zone through a weighted flow graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shizuku.sources.stored import checkpoints

# Bases and confidences from the strongest to the weakest.
BASES = ["measured", "published", "derived", "estimated", "assumed", "unknown"]
CONFIDENCES = ["high", "medium", "low"]


def active(as_of: str) -> Column:
    """Validity [valid_from, valid_to) at a day; open ends are null."""
    day = F.lit(as_of)
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (day < F.col("valid_to")))


def _rank(c: Column, names: list[str]) -> Column:
    """Place in names, weakest last; what isn't there is weakest."""
    at = F.array_position(F.array(*map(F.lit, names)), c).cast("int")
    return F.when(c.isNull() | (at == 0), len(names)).otherwise(at - 1)


def compose(assignments: DataFrame, edges: DataFrame, sources: DataFrame, as_of: str, depth: int = 32) -> tuple[DataFrame, DataFrame]:
    """(zone, source_id, share, confidence, basis) and (zone, unresolved).

    Water is followed upstream from each zone's facilities, one join a step, until it reaches a source; shares multiply on the
    way and add up at the source. What stands at a node after a step is added up there, so graphs whose arms part and meet again
    cost one row a zone and node, not one a path; only nodes that may lie on a cycle are remembered by what has passed them.
    A way over an edge of unknown basis has no share, and then no source of that zone has one. What runs into a node
    without inflow, into a cycle or further than `depth` edges is unresolved. Without assignments both tables are empty.
    """
    ids = sources.select(F.col("source_id").alias("node")).withColumn("is_source", F.lit(True))
    links = edges.filter(active(as_of)).select(F.col("to_id").alias("node"), "from_id", F.when(F.col("basis") != "unknown", F.coalesce("share", F.lit(0.0))).alias("edge_share"), (F.col("basis") == "unknown").alias("edge_unknown"), _rank(F.col("basis"), BASES).alias("edge_basis"))
    paths = assignments.filter(active(as_of)).select("zone", F.col("facility_id").alias("node"), F.coalesce("share", F.lit(0.0)).alias("share"), F.lit(False).alias("unknown"), _rank(F.col("confidence"), CONFIDENCES).alias("confidence"), F.lit(0).alias("basis"))
    arrived = lost = None
    checkpoints(edges.sparkSession)
    cyclic = _may_cycle(links, depth).withColumn("on_cycle", F.lit(True))
    none = F.array().cast("array<string>")
    paths = paths.withColumn("seen", none)
    for _ in range(depth + 1):
        # Nodes are remembered where a cycle can come back to them.
        noted = paths.join(cyclic, "node", "left").withColumn("seen", F.when(F.col("on_cycle"), F.array_sort(F.concat("seen", F.array(F.col("node").cast("string"))))).otherwise(F.col("seen")))
        folded = noted.groupBy("zone", "node", "seen").agg(F.sum("share").alias("share"), F.max("unknown").alias("unknown"), F.max("confidence").alias("confidence"), F.max("basis").alias("basis"))
        at = folded.join(ids, "node", "left").checkpoint()
        if at.isEmpty() and arrived is not None:
            break
        done = at.filter("is_source").drop("is_source", "seen")
        onward = at.filter("is_source IS NULL").drop("is_source").join(links, "node", "left")
        dead = onward.filter("from_id IS NULL OR array_contains(seen, CAST(from_id AS STRING))")
        stopped = dead.select("zone", (F.col("share") * F.when(F.col("from_id").isNull(), 1.0).otherwise(F.coalesce("edge_share", F.lit(1.0)))).alias("lost"))
        arrived = done if arrived is None else arrived.unionByName(done)
        lost = stopped if lost is None else lost.unionByName(stopped)
        paths = onward.filter("from_id IS NOT NULL AND NOT array_contains(seen, CAST(from_id AS STRING))").select(
            "zone", F.col("from_id").alias("node"), (F.col("share") * F.coalesce("edge_share", F.lit(1.0))).alias("share"), (F.col("unknown") | F.col("edge_unknown")).alias("unknown"), "confidence", F.greatest("basis", "edge_basis").alias("basis"), "seen",
        )
    # One edge more may still end at a source; all else has come too far.
    ahead = paths.join(ids, "node", "left").checkpoint()
    arrived = arrived.unionByName(ahead.filter("is_source").drop("is_source", "seen"))
    lost = lost.unionByName(ahead.filter("is_source IS NULL").select("zone", F.col("share").alias("lost")))
    mixed = arrived.groupBy("zone").agg(F.max("unknown").alias("mixed"))
    rows = arrived.groupBy("zone", F.col("node").alias("source_id")).agg(F.sum("share").alias("s"), F.max("confidence").alias("c"), F.max("basis").alias("b")).join(mixed, "zone")
    name = lambda c, names: F.get(F.array(*map(F.lit, names)), F.least(F.col(c), F.lit(len(names) - 1)))
    rows = rows.filter("mixed OR s > 0").select("zone", "source_id", F.when(~F.col("mixed"), F.round("s", 6)).alias("share"), name("c", CONFIDENCES).alias("confidence"), name("b", BASES).alias("basis"))
    return rows, lost.groupBy("zone").agg(F.round(F.sum("lost"), 6).alias("unresolved")).filter("unresolved > 0")


def _may_cycle(links: DataFrame, rounds: int) -> DataFrame:
    """node: those left when edges from nodes without inflow and to nodes without outflow are taken away, again and again; at most `rounds` times, so too many may be left, never too few."""
    core = links.filter("from_id IS NOT NULL").select("node", "from_id").distinct().checkpoint()
    n = core.count()
    for _ in range(rounds):
        if not n:
            break
        fed, feeding = core.select(F.col("node").alias("from_id")).distinct(), core.select(F.col("from_id").alias("node")).distinct()
        core = core.join(fed, "from_id", "left_semi").join(feeding, "node", "left_semi").checkpoint()
        before, n = n, core.count()
        if n == before:
            break
    return core.select("node").distinct()


def share_sums(rows: DataFrame, keys: list[str], tolerance: float = 0.005) -> DataFrame:
    """Groups whose shares don't add up to 1."""
    return rows.groupBy(*keys).agg(F.sum("share").alias("total")).filter(F.abs(F.col("total") - 1) > tolerance)


def expand_rules(rules: DataFrame, keys: DataFrame, explicit: DataFrame) -> DataFrame:
    """key, facility_id: rules by city, by prefix of the name or of the key; a key that is assigned explicitly takes no rule.

    rules: kind ('city_exact', 'prefix', 'key_prefix'), city, pattern, facility_id. keys: key, city, name.
    """
    hit = (F.col("r.kind") == "city_exact") | ((F.col("r.kind") == "prefix") & F.col("k.name").startswith(F.col("r.pattern"))) | ((F.col("r.kind") == "key_prefix") & F.col("k.key").startswith(F.col("r.pattern")))
    by_rule = keys.alias("k").join(rules.alias("r"), (F.col("k.city") == F.col("r.city")) & hit).select("k.key", "r.facility_id").distinct()
    return explicit.select("key", "facility_id").unionByName(by_rule.join(explicit.select("key"), "key", "left_anti"))

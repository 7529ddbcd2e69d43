"""Edges and where things come from: citations, delegations, provenance chains, surface graphs and their lints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reverse_citations(edges: DataFrame, target: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges into a node, by source."""
    return edges.filter(F.col(dst) == target).orderBy(src)


def delegation_chain(edges: DataFrame, statute: str, section: str | None = None) -> DataFrame:
    """Delegations of a statute, or of one of its sections."""
    mine = F.col("statute") == statute
    return edges.filter(mine if section is None else mine & (F.col("section") == section)).orderBy("section", "decree")


def provenance(provisions: DataFrame, amendments: DataFrame, proposals: DataFrame, preparatory: DataFrame) -> DataFrame:
    """Provision → amendment → proposal → preparatory references, as chained left joins; a broken chain keeps what it has."""
    refs = preparatory.groupBy("proposal").agg(F.array_join(F.array_sort(F.collect_set("ref")), ",").alias("refs"))
    return provisions.join(amendments, "provision", "left").join(proposals, "amendment", "left").join(refs, "proposal", "left")


def surface_graph(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(node, lens, key): the nodes of several lenses (each a table with a column key), with ids that only depend on both."""
    out = None
    for lens, df in parts:
        rows = df.select(F.col("key").cast("string").alias("key")).distinct().select(F.md5(F.concat_ws("\x1f", F.lit(lens), "key")).alias("node"), F.lit(lens).alias("lens"), "key")
        out = rows if out is None else out.unionByName(rows)
    return out


def lints(nodes: DataFrame, edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """(src, dst, lint): edges to unknown nodes, repeated edges, and edges between kinds of nodes that ``allowed`` does not list."""
    known = nodes.select(F.col("node").alias("dst"))
    dangling = edges.join(known, "dst", "left_anti").select("src", "dst", F.lit("dangling").alias("lint"))
    repeated = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("src", "dst", F.lit("duplicate").alias("lint"))
    typed = edges.select("src", "dst").distinct().join(nodes.select(F.col("node").alias("src"), F.col("kind").alias("src_kind")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("kind").alias("dst_kind")), "dst")
    mismatch = typed.join(allowed, ["src_kind", "dst_kind"], "left_anti").select("src", "dst", F.lit("type_mismatch").alias("lint"))
    return dangling.unionByName(repeated).unionByName(mismatch)


def dangling_causes(cited: DataFrame, notes: DataFrame) -> DataFrame:
    """Cited sections (act, number, suffix) with a cause: 'repealed' if a note's range of the act covers them, else 'unknown'."""
    at = F.struct(F.col("number"), F.coalesce("suffix", F.lit("")))
    joined = cited.join(notes.select("act", "from_number", "from_suffix", "to_number", "to_suffix"), "act", "left")
    hit = (at >= F.struct("from_number", F.coalesce("from_suffix", F.lit("")))) & (at <= F.struct("to_number", F.coalesce("to_suffix", F.lit("~"))))
    return joined.groupBy("act", "number", "suffix").agg(F.max(F.coalesce(hit, F.lit(False))).alias("hit")).select("act", "number", "suffix", F.when(F.col("hit"), "repealed").otherwise("unknown").alias("cause"))


def mine_bindings(rows: DataFrame, name: str, target: str, registry: DataFrame, least: int = 2) -> DataFrame:
    """(name, target, n, status): what a name is bound to, against a registry: 'known', 'conflict', 'new', or 'rare' under ``least``."""
    bound = rows.groupBy(F.lower(F.trim(F.col(name))).alias("name"), F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("n"))
    held = registry.select(F.lower(F.trim(F.col(name))).alias("name"), F.col(target).alias("held"))
    status = F.when(F.col("held").eqNullSafe(F.col("target")), "known").when(F.col("held").isNotNull(), "conflict").when(F.col("n") >= least, "new").otherwise("rare")
    return bound.join(held, "name", "left").select("name", "target", "n", status.alias("status"))

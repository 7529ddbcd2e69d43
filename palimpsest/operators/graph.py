"""Graph operators over edge tables. Traversals are loops of joins; each hop is checkpointed reliably, in the folder of
``spark.checkpoint.dir``, so lineage stays short and lost executors cost a re-read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this application; where the session names none, a local master gets one of our own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="palimpsest-graph-"))
    return str(context._jsc.sc().getCheckpointDir().get())


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: A frontier of at most so many rows goes to where the edges are; beyond that both sides are dealt by key. Edges are never broadcast.
FRONTIER_ROWS = 100_000
#: Rows of an edge table to a bucket, as far as the session's shuffle partitions go.
BUCKET_ROWS = 200_000


class Layers:
    """The layers of a traversal as one Parquet table in the shared folder, each written once: (columns, layer)."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, f"{shared_folder(spark)}/layers-{uuid.uuid4().hex}"
        self.schema = None

    def add(self, df: DataFrame, layer: int) -> DataFrame:
        self.schema = self.schema or df.schema
        df.write.parquet(f"{self.path}/layer={layer}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/layer={layer}")

    def drop(self) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def all(self) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        return self.spark.read.schema(f"{fields}, layer int").parquet(self.path)


class DealtEdges:
    """Distinct edges, written once to the shared folder as a table bucketed and sorted by ``key``, so that no hop deals them again.
    ``most_rows`` bounds their number."""

    def __init__(self, edges: DataFrame, key: str, most_rows: int) -> None:
        self.spark, self.key = edges.sparkSession, key
        most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(1, min(most, most_rows // BUCKET_ROWS + 1))
        self.name, self.path = f"edges_{uuid.uuid4().hex}", f"{shared_folder(self.spark)}/edges-{uuid.uuid4().hex}"
        edges.repartition(buckets, key).distinct().write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", self.path).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def of(self, frontier: DataFrame, n: int) -> DataFrame:
        """The edges whose key is in ``frontier`` (that column, ``n`` distinct rows)."""
        near = F.broadcast(frontier) if n <= FRONTIER_ROWS else frontier.hint("merge")
        return self.rows.join(near, self.key)

    def drop(self) -> None:
        """Once no plan reads them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def breadth_first(edges: DataFrame, starts: DataFrame, depth: int, direction: str = "forward", src: str = "src", dst: str = "dst", limit: int | None = None) -> DataFrame:
    """(node, hops): nodes within ``depth`` hops of ``starts`` (column node), each at its smallest distance."""
    forward = edges.select(F.col(src).alias("node"), F.col(dst).alias("next"))
    backward = edges.select(F.col(dst).alias("node"), F.col(src).alias("next"))
    steps = {"forward": forward, "reverse": backward, "both": forward.unionByName(backward)}[direction]
    seen = cut_lineage(starts.select("node").distinct().withColumn("hops", F.lit(0)))
    frontier = seen
    for hop in range(1, depth + 1):  # each hop is a table of its own: what was seen before is not written again
        reached = frontier.select("node").join(steps, "node").select(F.col("next").alias("node")).filter("node is not null").distinct()
        frontier = cut_lineage(reached.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen if limit is None else seen.orderBy("hops", "node").limit(limit)


def reachable(edges: DataFrame, starts: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """All nodes reachable over edges of the given kinds; starts count as reachable."""
    used = edges if kinds is None else edges.filter(F.col("kind").isin(*kinds))
    steps = used.filter("src is not null").select(F.col("src").alias("node"), F.col("dst").alias("next"))
    starts, steps = of_one_type(starts.select("node"), steps)
    dealt = DealtEdges(steps, "node", used.count())
    layers, hop = Layers(edges.sparkSession), 0
    frontier = layers.add(starts.distinct(), 0)
    while n := frontier.count():
        hop += 1
        reached, seen = dealt.of(frontier, n).select(F.col("next").alias("node")).distinct(), layers.all().select(F.col("node").alias("seen"))
        frontier = layers.add(reached.join(seen.hint("merge"), reached["node"].eqNullSafe(seen["seen"]), "left_anti"), hop)
    dealt.drop()
    return layers.all().select("node")


def of_one_type(starts: DataFrame, steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node) and (node, next) with all nodes of the type that holds them."""
    kind = starts.union(steps.select("node")).union(steps.select("next")).schema["node"].dataType
    return starts.select(F.col("node").cast(kind)), steps.select(F.col("node").cast(kind), F.col("next").cast(kind))


def follow_renames(addresses: DataFrame, migrations: DataFrame) -> DataFrame:
    """(addr, final): each address after all renames (from_addr, to_addr); of several renames of an address the smallest
    target counts. Chains are halved by pointer doubling; addresses that lead into a cycle keep its smallest address.

    After k rounds a pointer spans 2 ** k renames, and ``low`` is the smallest address on the way; once that exceeds the
    number of renames, whatever still points to an address that is renamed has been round a cycle."""
    once = migrations.filter("from_addr <> to_addr").groupBy(F.col("from_addr").alias("addr")).agg(F.min("to_addr").alias("final"))
    now = cut_lineage(once.withColumn("low", F.col("final")))
    renamed = now.select(F.col("addr").alias("final"))
    open_, spans, n = now.join(renamed, "final", "left_semi"), 1, now.count()
    while spans <= n and not open_.isEmpty():
        ahead = now.select(F.col("addr").alias("final"), F.col("final").alias("later"), F.col("low").alias("low_later"))
        stepped = now.join(ahead, "final", "left")
        now = cut_lineage(stepped.select("addr", F.coalesce("later", "final").alias("final"), F.when(F.col("later").isNull(), F.col("low")).otherwise(F.least("low", "low_later")).alias("low")))
        open_, spans = now.join(renamed, "final", "left_semi"), 2 * spans
    # on a cycle ``low`` has seen all of it; what leads into one takes the low of where it has come to
    around = now.join(renamed, "final", "left_semi").select("addr", "final")
    lows = now.select(F.col("addr").alias("final"), F.col("low").alias("cycle_low"))
    settled = around.join(lows, "final").select("addr", "cycle_low")
    ends = now.join(settled, "addr", "left").select("addr", F.coalesce("cycle_low", "final").alias("final"))
    return addresses.select("addr").join(ends, "addr", "left").select("addr", F.coalesce("final", "addr").alias("final"))


def silent_breakage(citations: DataFrame, versions: DataFrame, changed: DataFrame, day: str) -> DataFrame:
    """Citations of changed sections whose citing provision is in force: (…, state), 'ambiguous' where several versions of the
    same label disagree, 'active' otherwise."""
    live = versions.filter((F.col("effective") <= day) & (F.col("expires").isNull() | (F.col("expires") > day)))
    state = live.groupBy(F.col("addr").alias("src")).agg(F.count_distinct("content").alias("n"))
    return citations.join(changed.select("dst").distinct(), "dst", "left_semi").join(state, "src").withColumn("state", F.when(F.col("n") > 1, "ambiguous").otherwise("active")).drop("n")


def retraction_taint(consumed: DataFrame, retracted: DataFrame) -> DataFrame:
    """(build, retraction): builds with a retracted input, one hop; the smallest retraction is reported."""
    return consumed.join(retracted.select("subject", "retraction"), "subject").groupBy("build").agg(F.min("retraction").alias("retraction"))


def build_status(builds: DataFrame, edges: DataFrame, taint: DataFrame) -> DataFrame:
    """Status of each build, in this order: unknown, uninstrumented, invalid, clean if it declares nothing, tainted, clean."""
    n = edges.groupBy("build").agg(F.count(F.lit(1)).alias("n_edges"))
    joined = builds.join(n, "build", "left").join(taint, "build", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    case = F.when(~F.col("known"), "BUILD_UNKNOWN").when(~F.coalesce(F.col("instrumented"), F.lit(False)), "BUILD_CONSUMPTION_UNINSTRUMENTED").when(F.col("n_edges") != F.col("declared"), "INVALID_CONSUMPTION").when(F.col("declared") == 0, "CLEAN").when(F.col("retraction").isNotNull(), "TAINTED")
    return joined.withColumn("status", case.otherwise("CLEAN"))


def relation_violations(edges: DataFrame, legal: DataFrame) -> DataFrame:
    """Edges whose (authority, evidence) pair is not in the table of legal pairs."""
    return edges.join(legal, ["authority", "evidence"], "left_anti")


def work_citations(texts: DataFrame, key: str, text: str, pattern: str, leaves: DataFrame, leaf: str) -> DataFrame:
    """(key, cited, resolved): references by pattern, resolved against leaf addresses."""
    found = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))).alias("cited"))
    known = leaves.select(F.col(leaf).alias("cited")).distinct().withColumn("known", F.lit(True))
    return found.join(known, "cited", "left").select(key, "cited", F.coalesce("known", F.lit(False)).alias("resolved"))

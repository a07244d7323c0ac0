"""Shared pieces: written intermediate tables, joins without hot keys, connected components, text batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where a session names none and runs in one process (``local`` masters,
    as in tests) is one made and set; on a cluster a folder of one machine would
    lose rows, so there a missing setting is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spool-shared-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; concurrent runs never meet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables written and not dropped yet; a result that is read later may still need them.
_standing: list[Written] = []


#: Whether Spark drops the shuffle files of a query when it ends.
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Written:
    """A table written to the shared folder and read back.

    It cuts lineage, survives lost executors, and keeps column pruning, which an
    RDD checkpoint does not. The shuffles that its write made go with the write,
    as else they stay until the driver happens to collect its garbage. Operators
    drop what their result does not read; ``scratch`` drops the rest once a
    result has been written.
    """

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        before = self.spark.conf.get(_CLEAN_SHUFFLES, "false")
        self.spark.conf.set(_CLEAN_SHUFFLES, "true")
        try:
            df.write.parquet(self.path)
        finally:
            self.spark.conf.set(_CLEAN_SHUFFLES, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _standing.append(self)

    def drop(self) -> None:
        """Deletes the files; only once nothing reads them any more."""
        if self in _standing:
            _standing.remove(self)
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(keep: list[Written] | None = None) -> Iterator[None]:
    """Drops the tables written inside, but those in ``keep``, when the block ends; its results must be written or read by then."""
    before = list(_standing)
    try:
        yield
    finally:
        for table in [t for t in _standing if t not in before and t not in (keep or [])]:
            table.drop()


#: A key with more than one in so many of a table's rows is hot, so there are fewer hot keys than this.
HOT_KEYS = 1000


def join_counted(rows: DataFrame, counts: DataFrame, on: list[str], size: str, spread: str, total: int | None = None) -> DataFrame:
    """``rows`` left-joined by value (null equals null) with ``counts``, which has one row per key of ``on`` and its ``size``.

    A key that more than one in ``HOT_KEYS`` of ``total`` rows have, or of the
    counted ones where no total is given, is hot. Hot
    keys are fewer than ``HOT_KEYS`` whatever the table, so they are broadcast;
    the rows that they meet are spread by the column ``spread`` over the shuffle
    by which the others are joined. So no key brings its rows to one task. Where
    all keys are hot nothing is shuffled. ``counts`` is read several times, so it
    should be a written table.
    """
    names = [c for c in counts.columns if c not in on]
    hot_at = F.col(size) * HOT_KEYS > ((counts.agg(F.sum(size)).first()[0] or 0) if total is None else total)
    few = F.broadcast(counts.where(hot_at).select(*(F.col(c).alias(f"hot_{c}") for c in counts.columns)))
    same = lambda a, b: [F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}")) for c in on]
    met = rows.join(few, same("", "hot_"), "left")
    cold = counts.where(~hot_at)
    if cold.isEmpty():
        return met.select(*rows.columns, *(F.col(f"hot_{c}").alias(c) for c in names))
    turn = F.when(F.col(f"hot_{size}").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 30)))
    others = cold.select(*(F.col(c).alias(f"cold_{c}") for c in counts.columns), F.lit(0).cast("long").alias("cold_turn"))
    met = met.withColumn("turn", turn.cast("long"))
    # Never broadcast, however few: the plan is the same at every size.
    met = met.join(others.hint("merge"), [*same("", "cold_"), F.col("turn") == F.col("cold_turn")], "left")
    return met.select(*rows.columns, *(F.coalesce(f"hot_{c}", f"cold_{c}").alias(c) for c in names))


#: Edges, each counted both ways, that one task finishes; more are contracted in rounds over the cluster.
FINISH_EDGES = 1 << 20


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each reaches) of an edge list, by hooking names to smaller ones and following them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    name = np.arange(len(nodes))
    while True:
        p, q = name[x], name[y]
        apart = p != q
        if not apart.any():
            return nodes, nodes[name]
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(name, np.maximum(p, q), np.minimum(p, q))
        while True:
            further = name[name]
            if (further == name).all():
                break
            name = further


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        nodes, least = least_reached(*(np.concatenate(side) for side in zip(*parts)))
        for i in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(least[i : i + 100_000])], names=["a", "to"])


def components(links: DataFrame) -> Written:
    """Connected components of ``links(a, b)``: a written table with one row ``(node, component)`` per node.

    ``component`` is the smallest node of the component. Each round renames every
    node to the smallest of its neighbours and itself and keeps the edges between
    new names. The largest name of a component is chosen by none, so every round
    ends some names. Once no more than ``FINISH_EDGES`` edges are left, which may
    be so at once, one task finishes them, as they fit it whatever the table's
    size. The first two rounds order names by value, which is all that stars
    need; before every second round after them the names are hashed anew, so the
    rounds grow with the logarithm of a path however its nodes are numbered.
    ``xxhash64`` of a long is one-to-one, so hashed names never meet, and the
    smallest node of each name is taken at the end. Rows are two longs, all steps
    are combinable aggregations and equi-joins, and each round is written, so a
    lost executor costs one round. Self links make a node known; null ends are
    ignored; an empty table gives an empty result.
    """
    ends = links.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    both = ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = Written(both, "edges")
    names: Written | None = None
    renames = False

    def follow(step: DataFrame, again: str = "component") -> Written:
        if names is None:
            return Written(step.select(F.col("a").alias("node"), F.col("to").alias("component")), "labels")
        joined = names.df.join(step, names.df.component == step.a, "left").select("node", F.coalesce("to", "component").alias("component"))
        return Written(joined.selectExpr("node", f"{again} AS component"), "labels")

    for turn in count(1):
        if edges.df.count() <= FINISH_EDGES:
            rest = edges.df.coalesce(1).mapInArrow(_finish, "a long, to long")
            final = follow(rest)
            break
        step = Written(edges.df.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to"), F.count("*").alias("degree")), "names")
        again = turn % 2 == 0 and names is not None  # names are hashed anew after this round
        fresh = f"xxhash64(%s, {turn})" if again else "%s"
        renames |= again
        following_names = follow(step.df, fresh % "component")
        if names is not None:
            names.drop()
        names = following_names
        # A node has as many edges as end in it as begin there, so its degree tells of both ends whether it is hot.
        one = step.df.select("a", F.col("to").alias("a2"), "degree")
        two = step.df.select(F.col("a").alias("b"), F.col("to").alias("b2"), "degree")
        half = join_counted(edges.df, one, ["a"], "degree", "b").drop("degree")
        renamed = join_counted(half, two, ["b"], "degree", "a").where("a2 <> b2").selectExpr(f"{fresh % 'a2'} AS a", f"{fresh % 'b2'} AS b").distinct()
        following = Written(renamed, "edges")
        edges.drop()
        step.drop()
        edges = following
    edges.drop()
    if names is not None:
        names.drop()
    if not renames:
        return final
    smallest = final.df.groupBy("component").agg(F.min("node").alias("smallest"))
    settled = Written(final.df.join(smallest, "component").select("node", F.col("smallest").alias("component")), "labels")
    final.drop()
    return settled


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows with about ``most_bytes`` of text.

    Yields (rows, UTF-8 bytes, offsets); null text counts as empty. A single
    longer document is a run of its own, so memory follows the longest document.
    """
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1)
        yield batch.slice(first, last - first), whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last

"""Connected components of many graphs at once, as DataFrame rounds.

Every graph is identified by its key columns (one graph per event time), and
all graphs advance together: each row is keyed by ``(*keys, vertex)``, so no
graph is ever gathered into one task. Rounds alternate *large-star* and
*small-star* (Kiveris, Lattanzi, Mirrokni, Rastogi, Vassilvitskii:
"Connected Components in MapReduce and Beyond", SoCC 2014); each is a
``groupBy`` min plus an equi-join on the same key, then ``distinct``. Road
graphs are long and thin, where plain min-label propagation needs about
diameter-many rounds; the star operations need a logarithmic number.

The edge set is kept oriented ``hi > lo``. It is final when it is a forest of
stars centred on their minimum: no vertex is both a centre and a leaf, and no
leaf has two centres. That test is exact (one aggregation per round). Each
round is written to the shared checkpoint folder, so lineage stays one round
long and a lost executor costs one re-read.

Rounds shrink. A leaf with one centre that is no centre itself is *settled*: it
is connected to the rest through its centre only, so its label is the
centre's, whatever that becomes. Settled vertices leave the edge set with a
pointer to their centre (a component that has become a star leaves as a whole),
and the pointers are followed back from the last round to the first once
the rounds are over.

With ``nearby=True`` pieces that lie inside runs of neighbouring edges are found
before the rounds (``trafficgraph.operators.runs``): every vertex points to the
smallest vertex of such a piece, and the rounds see only the vertices that lie
in several runs, linked to their pieces.

The component id is the smallest vertex id in the component, so results do
not depend on the order in which edges arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficgraph.operators.materialize import (DEFAULT_BROADCAST_MAX_BYTES, Size, broadcast_within, cached,
                                                drop_table, materialize, measured, write_table)
from trafficgraph.operators.runs import labelled_in_runs, sorts_alike
from trafficgraph.operators.skew import (DEFAULT_HOT_ROWS, hot_keys, hot_threshold,
                                         salted_join)


# Settled vertices leave the edge set when they are at least this share of a round's
# vertices, while those are at least the other share of the first round's: each such
# step costs a written table, which the last few edges do not repay.
SETTLE_SHARE = 0.4
SETTLE_FROM = 0.05


class ComponentsDidNotConverge(RuntimeError):
    pass


def _vertex_summary(o: DataFrame, k: list[str]) -> DataFrame:
    """Per vertex: smallest neighbour, and its roles in the oriented edge set.

    One aggregation serves both the large-star step (``_m``) and the exact
    convergence test: ``_cmin`` / ``_cmax`` are the smallest and largest
    neighbour below the vertex (its centres), ``_l`` whether it is the
    centre of some edge. All three ignore repeated edges, so the edge set
    needs no ``distinct`` between rounds. ``_nlo`` / ``_nhi`` count the rows
    the next large-star / small-star join meets on this vertex (hot keys).
    """
    both = (o.select(*k, F.col("_hi").alias("_u"), F.col("_lo").alias("_w"),
                     F.col("_lo").alias("_c"), F.lit(0).alias("_as_lo"))
            .unionByName(o.select(*k, F.col("_lo").alias("_u"), F.col("_hi").alias("_w"),
                                  F.lit(None).cast(o.schema["_lo"].dataType).alias("_c"),
                                  F.lit(1).alias("_as_lo"))))
    return both.groupBy(*k, "_u").agg(F.min("_w").alias("_m"), F.min("_c").alias("_cmin"),
                                      F.max("_c").alias("_cmax"), F.max("_as_lo").alias("_l"),
                                      F.sum("_as_lo").alias("_nlo"),
                                      F.sum(F.lit(1) - F.col("_as_lo")).alias("_nhi"))


def _settled() -> F.Column:
    """A vertex whose only neighbour below it is its centre, and that is no centre itself."""
    return (F.col("_cmin") == F.col("_cmax")) & (F.col("_l") == 0)


@dataclass(frozen=True)
class RoundStats:
    bad: int            # vertices that break the star-forest shape; 0 means done
    hot: int            # vertices whose rows make a join key hot
    hot_from: int       # the row count that makes them so
    rows: int           # edges
    vertices: int
    settled: int        # vertices that leave after this round
    mark: int           # fingerprint of the round


def _round_stats(summary: DataFrame, hot_rows: int) -> RoundStats:
    """One action over the per-vertex summary. Bad is a vertex that is both a centre
    and a leaf, or a leaf with two centres."""
    leaf = F.col("_cmin").isNotNull()
    bad = (F.col("_cmin") != F.col("_cmax")) | (leaf & (F.col("_l") == 1))
    hot = (F.col("_nlo") > F.lit(hot_rows)) | (F.col("_nhi") > F.lit(hot_rows))
    row = summary.agg(F.count(F.when(bad, 1)).alias("bad"), F.count(F.when(hot, 1)).alias("hot"),
                      F.sum("_nlo").alias("rows"), F.count(F.lit(1)).alias("vertices"),
                      F.count(F.when(_settled(), 1)).alias("settled"),
                      F.bit_xor(F.xxhash64(*summary.columns)).alias("mark")).first()
    rows = int(row["rows"] or 0)
    return RoundStats(int(row["bad"]), int(row["hot"]), hot_threshold(rows, hot_rows), rows,
                      int(row["vertices"]), int(row["settled"]), row["mark"])


def _large_star(o: DataFrame, summary: DataFrame, k: list[str],
                hot: DataFrame | None = None) -> DataFrame:
    # m(u) = min over u's closed neighbourhood; every larger neighbour v of u
    # is re-linked to m(u). A star centre meets all its leaves here: hot
    # centres are split by a salt on the leaf.
    return (salted_join(o.withColumnRenamed("_lo", "_u"), summary.select(*k, "_u", "_m"),
                        [*k, "_u"], hot, ["_hi"])
            .select(*k, F.col("_hi"), F.least(F.col("_u"), F.col("_m")).alias("_lo")))


def _small_star(o: DataFrame, k: list[str], hot: DataFrame | None = None) -> DataFrame:
    # m(u) = min over u and its smaller neighbours; u and those neighbours
    # are re-linked to m(u).
    m = o.groupBy(*k, "_hi").agg(F.min("_lo").alias("_m"))
    return (salted_join(o, m, [*k, "_hi"], hot, ["_lo"])
            .select(*k,
                    F.when(F.col("_lo") == F.col("_m"), F.col("_hi"))
                    .otherwise(F.col("_lo")).alias("_hi"),
                    F.col("_m").alias("_lo"))
            .distinct())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst",
                         keys: Sequence[str] = ("eventTime",), vertex: str = "vertexId",
                         component: str = "componentId",
                         hot_rows: int = DEFAULT_HOT_ROWS,
                         on_round: Callable[[RoundStats], None] | None = None,
                         nearby: bool = False) -> DataFrame:
    """Label the undirected connected components of each keyed graph.

    ``edges`` has the key columns plus ``src`` and ``dst`` of any orderable
    type (duplicates, both directions and self-loops allowed). Returns
    ``(*keys, vertex, component)`` with one row per distinct end point, where
    ``component`` is the smallest vertex of its component. Rows with a null
    end point are ignored. A vertex meeting more than ``hot_rows`` edges in a
    round's join is split over several tasks (``trafficgraph.operators.skew``).
    ``on_round`` is told the figures of every round. ``nearby`` tells that
    linked vertices mostly have close ids; it changes the cost, not the labels.
    """
    k = list(keys)
    e = (edges.select(*[F.col(c) for c in k], F.col(src).alias("_a"), F.col(dst).alias("_b"))
         .where(F.col("_a").isNotNull() & F.col("_b").isNotNull()))
    oriented = e.select(*k, F.greatest("_a", "_b").alias("_hi"), F.least("_a", "_b").alias("_lo")).distinct()
    if nearby and sorts_alike(oriented.schema["_lo"].dataType):
        return (_joined_runs(oriented, k, hot_rows, on_round)
                .select(*k, F.col("_u").alias(vertex), F.col("_label").alias(component)))
    # The input is read once: distinct oriented edges, self-loops included,
    # written to the checkpoint folder; rounds and the self-loop pass read it.
    base = materialize(oriented)
    cur, release = base.where(F.col("_hi") != F.col("_lo")), _chain()
    spent: list[str] = []      # round tables no frame reads once the next round is summarised
    levels: list[tuple[DataFrame, str, int]] = []   # (vertex, centre) of settled vertices, path, rows
    first = last = None
    while True:
        summary, release_summary = cached(_vertex_summary(cur, k))
        # The check caches the summary that the next round's joins read; each
        # round's edge set is a table in the checkpoint folder.
        stats = _round_stats(summary, hot_rows)
        if on_round:
            on_round(stats)
        release()
        while len(spent) > 1:
            drop_table(edges.sparkSession, spent.pop(0))
        if stats.bad == 0:
            break
        if (stats.rows, stats.vertices, stats.mark) == last:   # nothing moved: it would go on forever
            release_summary()
            raise ComponentsDidNotConverge(
                f"{stats.bad} vertices break the star forest and no edge moves")
        last = stats.rows, stats.vertices, stats.mark
        hot_lo = hot_keys(summary, [*k, "_u"], "_nlo", stats.hot_from) if stats.hot else None
        hot_hi = (hot_keys(summary, [*k, "_u"], "_nhi", stats.hot_from).withColumnRenamed("_u", "_hi")
                  if stats.hot else None)
        live = cur
        first = first or stats.vertices
        if (stats.settled >= SETTLE_SHARE * stats.vertices
                and stats.vertices >= SETTLE_FROM * first):
            # Settled leaves are larger than their centre: without them its smallest
            # neighbour stays what it was, so the summary holds for what is left.
            leaves = F.coalesce(_settled(), F.lit(False))
            settled = summary.where(leaves).select(*k, F.col("_u").alias("_v"), F.col("_cmin").alias("_c"))
            levels.append((*write_table(settled), stats.settled))
            left = summary.where(~leaves).select(*k, F.col("_u").alias("_hi"))
            live = salted_join(cur, left, [*k, "_hi"], hot_hi, ["_lo"], "left_semi")
        cur, path = write_table(_small_star(_large_star(live, summary, k, hot_lo), k, hot_hi))
        spent.append(path)
        release = release_summary
    # A star forest centred on minima: each vertex's label is the smaller of
    # itself and its smallest neighbour. Vertices seen only on self-loops
    # are their own component.
    labels = summary.select(*k, F.col("_u").alias("_v"), F.least(F.col("_u"), F.col("_m")).alias("_label"))
    if levels:
        labels = _followed(labels, levels, k, hot_rows)
        release_summary()
        for path in spent:
            drop_table(edges.sparkSession, path)
    labels = labels.select(*k, F.col("_v").alias(vertex), F.col("_label").alias(component))
    loops = (base.where(F.col("_hi") == F.col("_lo")).select(*k, F.col("_hi").alias(vertex))
             .join(labels.select(*k, vertex), [*k, vertex], "left_anti"))
    return labels.unionByName(loops.select(*k, vertex, F.col(vertex).alias(component)))


def _joined_runs(oriented: DataFrame, k: list[str], hot_rows: int,
                 on_round: Callable[[RoundStats], None] | None) -> DataFrame:
    """``(*k, _u, _label)``: the pieces of all runs, joined by the rounds where they share a vertex.

    A vertex of one run has the label of its piece's smallest vertex. A vertex of
    several runs is linked to the smallest vertex of each of its pieces, and only those
    links reach the rounds; a smallest vertex without such a link is its own label.
    """
    spark = oriented.sparkSession
    rows, path = write_table(labelled_in_runs(oriented, k))
    ends = (rows.select(*k, F.col("_hi").alias("_u"), F.col("_lo").alias("_w"), "_near", "_run")
            .unionByName(rows.where(F.col("_hi") != F.col("_lo"))
                         .select(*k, F.col("_lo").alias("_u"), F.col("_hi").alias("_w"), "_near", "_run")))
    vertices = materialize(
        ends.groupBy(*k, "_u").agg(F.min("_near").alias("_near"), F.count(F.lit(1)).alias("_rows"),
                                   (F.min("_run") != F.max("_run")).alias("_shared")))
    shared = vertices.where("_shared")
    found = shared.agg(F.count(F.lit(1)).alias("n"), F.sum("_rows").alias("rows"),
                       F.max("_rows").alias("most")).first()
    pieces = vertices.select(*k, "_u", "_near")
    if not found["n"]:
        drop_table(spark, path)
        return pieces.withColumnRenamed("_near", "_label")
    size = measured(vertices)
    few, hot = replace(size, rows=int(found["n"])), None
    meet = broadcast_within(shared.select(*k, "_u"), few, DEFAULT_BROADCAST_MAX_BYTES)
    hot_from = hot_threshold(int(found["rows"]), hot_rows)
    if found["most"] > hot_from:
        hot = hot_keys(shared, [*k, "_u"], "_rows", hot_from)
    links = materialize(
        salted_join(ends.where(F.col("_u") != F.col("_near")), meet, [*k, "_u"], hot, ["_w"], "left_semi")
        .select(*k, "_u", "_near").distinct())
    drop_table(spark, path)
    links_size = measured(links)
    joined = connected_components(links, "_u", "_near", k, vertex="_near", component="_label",
                                  hot_rows=hot_rows, on_round=on_round)
    # At most two vertices of a link have a label.
    width = max(links_size.widths["_u"], links_size.widths["_near"])
    known = broadcast_within(joined, Size(2 * links_size.rows, {**links_size.widths, "_near": width, "_label": width}),
                             DEFAULT_BROADCAST_MAX_BYTES)
    hot = None
    if known is joined and size.rows > hot_rows:
        load = pieces.groupBy(*k, "_near").agg(F.count(F.lit(1)).alias("_rows"))
        hot = hot_keys(load, [*k, "_near"], "_rows", hot_threshold(size.rows, hot_rows))
    return (salted_join(pieces, known, [*k, "_near"], hot, ["_u"], "left")
            .select(*k, "_u", F.coalesce("_label", "_near").alias("_label")))


def _followed(labels: DataFrame, levels: list[tuple[DataFrame, str, int]], k: list[str],
              hot_rows: int) -> DataFrame:
    """Labels of all vertices: pointers of settled vertices followed from the last round back.

    A centre without a label was left alone when its last leaf settled: it is the
    smallest vertex of its component, its own label, and gets its row here. Each
    level reads the labels after it twice, so they are written; only the last table stays.
    """
    spark, before = labels.sparkSession, None
    for level, level_path, rows in reversed(levels):
        known = labels.select(*k, F.col("_v").alias("_c"), "_label")
        hot = None
        if rows > hot_rows:
            load = level.groupBy(*k, "_c").agg(F.count(F.lit(1)).alias("_rows"))
            hot = hot_keys(load, [*k, "_c"], "_rows", hot_threshold(rows, hot_rows))
        pointed = (salted_join(level, known, [*k, "_c"], hot, ["_v"], "left")
                   .select(*k, "_v", F.coalesce("_label", "_c").alias("_label"), "_c",
                           F.col("_label").isNull().alias("_alone")))
        centres = (pointed.where("_alone").select(*k, F.col("_c").alias("_v"), F.col("_c").alias("_label"))
                   .distinct())
        labels, path = write_table(
            labels.unionByName(pointed.select(*k, "_v", "_label")).unionByName(centres))
        drop_table(spark, level_path)
        if before:
            drop_table(spark, before)
        before = path
    return labels


def _chain(*fns):
    def run() -> None:
        for fn in fns:
            fn()
    return run

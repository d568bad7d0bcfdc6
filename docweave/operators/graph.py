"""Document relationship graph on node and edge tables.

Edges: source_doc, target_doc, relationship_type, weight. Iterative jobs join a
small per-node state to the edges; edges of a hub are spread over salts, sums
and minima combine before the shuffle, and checkpoints keep plans short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.ranks import hot_keys, repeat_hot, salt_rows, skew_join, top_per_group
from docweave.operators.vectors import exact_topk
from docweave.session import cut_lineage, placed

RELATIONSHIP_TYPES = ["citation", "reference", "similarity", "hierarchy", "related"]


def checked_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of a known type, and the others."""
    known = F.coalesce(F.col("relationship_type").isin(RELATIONSHIP_TYPES), F.lit(False))
    return edges.where(known), edges.where(~known)


def similarity_edges(vectors: DataFrame, k: int, threshold: float) -> DataFrame:
    """Edges from every vector to its nearest others above a threshold."""
    queries = vectors.select(F.col("id").alias("query_id"), "embedding", *[c for c in vectors.columns if c == "collection"])
    hits = exact_topk(queries, vectors, k + 1)
    # the vector itself may be any of the k + 1 hits when others tie with it
    near = hits.where((F.col("id") != F.col("query_id")) & (F.col("score") >= threshold))
    ranked = top_per_group(near.drop("rank"), ["query_id"], [F.col("score").desc(), F.col("id").asc()], k)
    return ranked.select(
        F.col("query_id").alias("source_doc"),
        F.col("id").alias("target_doc"),
        F.lit("similarity").alias("relationship_type"),
        F.col("score").alias("weight"),
    )


def related(
    edges: DataFrame,
    asked: DataFrame,
    direction: str = "both",
    relationship_type: str | None = None,
    min_weight: float = 0.0,
    max_results: int = 10,
) -> DataFrame:
    """Neighbours of ``asked(doc_id)`` by weight (N3); ties by document."""
    wanted = edges.where(F.col("weight") >= min_weight)
    if relationship_type is not None:
        wanted = wanted.where(F.col("relationship_type") == relationship_type)
    sides = {
        "outgoing": [("source_doc", "target_doc")],
        "incoming": [("target_doc", "source_doc")],
        "both": [("source_doc", "target_doc"), ("target_doc", "source_doc")],
    }[direction]
    # both directions of an edge come from one row: the edges are computed once
    ends = F.array(*(F.struct(F.col(own).alias("doc_id"), F.col(other).alias("related_doc")) for own, other in sides))
    rows = wanted.select(F.explode(ends).alias("_end"), "relationship_type", "weight")
    rows = rows.select("_end.doc_id", "_end.related_doc", "relationship_type", "weight")
    found = rows.join(asked.select("doc_id").distinct(), "doc_id", "left_semi")
    best = found.groupBy("doc_id", "related_doc", "relationship_type").agg(F.max("weight").alias("weight"))
    order = [F.col("weight").desc(), F.col("related_doc").asc(), F.col("relationship_type").asc()]
    return top_per_group(best, ["doc_id"], order, max_results)


def _spread(pairs: DataFrame, degrees: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Links stored by their ``src``, and the hubs among those.

    Links of a hub carry salts, so that per-node state meets them in many tasks. The
    table is partitioned and sorted once; in every round only the state moves.
    """
    hubs = cut_lineage(hot_keys(degrees, ["src"], "n"))
    if hubs.isEmpty():
        return placed(pairs, "src"), None
    return placed(salt_rows(pairs, hubs, ["src"], ["dst"]), "src", "_salt"), hubs


def _links(edges: DataFrame, directed: bool) -> tuple[DataFrame, DataFrame | None]:
    """Distinct (src, dst) pairs, both ways when undirected, and the hubs among ``src``."""
    out = edges.select(F.col("source_doc").alias("src"), F.col("target_doc").alias("dst"))
    if not directed:
        out = out.union(out.select("dst", "src"))
    pairs = cut_lineage(out.where("src != dst").distinct())
    return _spread(pairs, pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n")))


def _along(state: DataFrame, links: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """State of ``src`` nodes next to each of their links."""
    if hubs is None:
        return state.join(links, "src")
    return repeat_hot(state, hubs, ["src"]).join(links, ["src", "_salt"]).drop("_salt")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int | None = None, directed: bool = False) -> DataFrame:
    """Fewest-hop path per ``pairs(pair_id, source_doc, target_doc)``.

    Breadth-first over all pairs at once, until every pair has met its target or has
    nowhere left to go; ``max_hops`` is a limit of the question, not of the search. A
    node keeps the smallest of its equally short paths. Pairs without a path have
    null results.
    """
    links, hubs = _links(edges, directed)
    frontier = pairs.select(
        "pair_id", F.col("source_doc").alias("node"), F.col("target_doc").alias("goal"), F.array("source_doc").alias("path")
    )
    frontier = cut_lineage(frontier)
    visited = frontier.select("pair_id", "node")
    done = frontier.where("node = goal")
    hops = 0
    while max_hops is None or hops < max_hops:
        hops += 1
        open_pairs = frontier.join(done.select("pair_id"), "pair_id", "left_anti")
        reached = (
            _along(open_pairs.withColumnRenamed("node", "src"), links, hubs)
            .select("pair_id", F.col("dst").alias("node"), "goal", F.array_append("path", F.col("dst")).alias("path"))
            .groupBy("pair_id", "node", "goal")
            .agg(F.min("path").alias("path"))
            .join(visited, ["pair_id", "node"], "left_anti")
        )
        frontier = cut_lineage(reached)
        if frontier.isEmpty():
            break
        visited = visited.union(frontier.select("pair_id", "node"))
        done = done.union(frontier.where("node = goal"))
        if hops % 8 == 0:  # long chains: keep the plans short
            visited, done = cut_lineage(visited), cut_lineage(done)
    found = done.select("pair_id", (F.size("path") - 1).cast("long").alias("hops"), "path")
    return pairs.join(found, "pair_id", "left")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: every node gets the smallest node of its component.

    Each round takes the smallest label among neighbours and then the label of
    that label, so the number of rounds grows with the logarithm of long chains
    in the usual case. Ends when nothing changes, which must come: labels only fall.
    """
    links, hubs = _links(edges, directed=False)
    labels = nodes.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label")).distinct()
    while True:
        offered = (
            _along(labels.withColumnRenamed("node", "src"), links, hubs)
            .groupBy(F.col("dst").alias("node"))
            .agg(F.min("label").alias("offer"))
        )
        lower = labels.join(offered, "node", "left").select(
            "node", F.col("label").alias("before"), F.least("label", F.coalesce("offer", "label")).alias("label")
        )
        lower = cut_lineage(lower)
        if lower.where("label != before").isEmpty():
            return lower.select(F.col("node").alias("doc_id"), F.col("label").alias("cluster"))
        # jump: the label of the label; one label may own most nodes
        crowded = hot_keys(lower.groupBy("label").agg(F.count(F.lit(1)).alias("n")), ["label"], "n")
        hop = lower.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        jumped = skew_join(lower, hop, ["label"], ["node"], crowded, "left")
        labels = cut_lineage(jumped.select("node", F.coalesce("jump", "label").alias("label")))


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Communities: each round a node takes its neighbours' most frequent label.

    All nodes change at once; of equally frequent labels the smallest wins, so
    every round has one result. Rounds end when no label changes, or when all labels are
    those of an earlier round (they would run in a circle for ever), or after ``rounds``.
    A round is known by its hash. Labels of a hub's neighbours are counted before the shuffle.
    """
    links, hubs = _links(edges, directed=False)
    labels = nodes.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label")).distinct()
    seen, step = set(), 0
    while rounds is None or step < rounds:
        step += 1
        votes = (
            _along(labels.withColumnRenamed("node", "src"), links, hubs)
            .groupBy(F.col("dst").alias("node"), "label")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        chosen = top_per_group(votes, ["node"], [F.col("n").desc(), F.col("label").asc()], 1)
        labels = labels.join(chosen.select("node", F.col("label").alias("vote")), "node", "left").select(
            "node", F.coalesce("vote", "label").alias("label")
        )
        if rounds is None or step < rounds:
            labels = cut_lineage(labels)
            state = labels.agg(F.sum(F.xxhash64("node", "label").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("label", "node"))).first()
            if state in seen:
                break
            seen.add(state)
    return labels.select(F.col("node").alias("doc_id"), F.col("label").alias("cluster"))


def clusters(nodes: DataFrame, edges: DataFrame, min_size: int = 3, method: str = "components") -> DataFrame:
    """Clusters with at least ``min_size`` documents and their sizes."""
    labels = {"components": components, "labels": label_propagation}[method](nodes, edges)
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    large = sizes.where(F.col("size") >= min_size)
    return skew_join(labels, large, ["cluster"], ["doc_id"], hot_keys(sizes, ["cluster"], "size")).select(
        "doc_id", "cluster", "size"
    )


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In and out degree, and their sum over the number of other nodes."""
    pairs = edges.select("source_doc", "target_doc").distinct()
    ends = pairs.select(F.col("source_doc").alias("doc_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        pairs.select("target_doc", F.lit(0), F.lit(1))
    )
    degree = ends.groupBy("doc_id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    n = nodes.agg(F.count(F.lit(1))).scalar()
    both = F.col("out_degree") + F.col("in_degree")
    return (
        nodes.select("doc_id")
        .join(degree, "doc_id", "left")
        .na.fill(0, ["out_degree", "in_degree"])
        .withColumn("centrality", F.when(n > 1, F.round(both / (n - 1), 6)).otherwise(F.lit(0.0)))
    )


def pagerank(
    nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 10, weighted: bool = True
) -> DataFrame:
    """PageRank after a fixed number of rounds.

    Rank of nodes without outgoing edges spreads evenly over all nodes.
    """
    strength = F.sum("weight") if weighted else F.lit(1.0)
    pairs = edges.groupBy(F.col("source_doc").alias("src"), F.col("target_doc").alias("dst")).agg(strength.alias("w"))
    pairs = cut_lineage(pairs)
    totals = cut_lineage(pairs.groupBy("src").agg(F.sum("w").alias("out"), F.count(F.lit(1)).alias("n")))
    shared = skew_join(pairs, totals.drop("n"), ["src"], ["dst"], hot_keys(totals, ["src"], "n"))
    links, hubs = _spread(shared.select("src", "dst", (F.col("w") / F.col("out")).alias("share")), totals)
    base = cut_lineage(
        nodes.select(F.col("doc_id").alias("node"))
        .distinct()
        .join(totals.select(F.col("src").alias("node"), F.lit(False).alias("dangling")), "node", "left")
        .na.fill(True, ["dangling"])
    )
    n = base.count()
    ranks = base.withColumn("rank", F.lit(1.0 / n if n else 0.0))
    for step in range(1, iterations + 1):
        received = (
            _along(ranks.select(F.col("node").alias("src"), "rank"), links, hubs)
            .groupBy(F.col("dst").alias("node"))
            .agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        )
        lost = F.coalesce(ranks.where("dangling").agg(F.sum("rank")).scalar(), F.lit(0.0))
        ranks = base.join(received, "node", "left").select(
            "node",
            "dangling",
            ((1.0 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("rank"),
        )
        # the rank feeds both the join and the dangling sum of the next round
        if step < iterations:
            ranks = cut_lineage(ranks)
    return ranks.select(F.col("node").alias("doc_id"), "rank")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, density, in total and per relationship type."""
    n = nodes.agg(F.count(F.lit(1))).scalar()
    per_type = edges.rollup("relationship_type").agg(F.count(F.lit(1)).alias("edges"))
    return per_type.select(
        F.coalesce("relationship_type", F.lit("(all)")).alias("relationship_type"),
        n.alias("nodes"),
        "edges",
        F.when(n > 1, F.round(F.col("edges") / (n * (n - 1)), 9)).otherwise(F.lit(0.0)).alias("density"),
    )

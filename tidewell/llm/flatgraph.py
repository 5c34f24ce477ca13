"""Near-duplicate embeddings over a robust-pruned flat graph.

Equal vectors are one node. Nodes are dealt into overlapping clusters: a node belongs to its nearest center and to every
center nearly as near (``margin``, at most ``probes``). A cluster of more than ``split`` nodes gets centers of its own, a
second level, fitted and assigned in tasks of bounded size; no two centers are nearer than ``APART``, so a dense group
stays in one cluster. A cluster of more than ``block`` nodes is cut into blocks by hash.

1. *Build*: each block links its nodes to near candidates thinned by robust pruning (a candidate goes if a chosen
   neighbour is ``ALPHA`` times nearer to it), adds reverse links and ties what the medoid can't reach to the rest.
2. *Union*: a node's adjacency lists of all its blocks are united.
3. *Search*: in each pair of blocks of a cluster every node is a query: a greedy search with a beam starts at the
   block's medoids (and at the node itself, in its own block), then expands whatever is in range until nothing new is.
4. *Verify*: only pairs whose cosine in double precision is at least ``least`` count, each in the first cluster that both
   share, so none counts twice. A task reports counts and a star for each local component, never pairs.
5. *Audit*: up to ``AUDIT`` nodes, half of them from all and half from those that link, spread over small and large
   numbers of links, are compared with all nodes by brute force. Recall is the mean over audited nodes that truly link, so
   a dense group doesn't outweigh the others. Below ``TARGET`` the index is built again with wider overlap; the recall of
   every round is logged, and a result under ``LEAST_RECALL`` is never returned: it is an error.

First-level centers are fitted on a sample of at most ``sample_rows`` nodes and ``SAMPLE_BYTES`` (documented bounds);
every node is indexed and searched. Vectors travel in the type that the table has, and are double in the comparisons.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
components of their own; vectors of different lengths don't link; equal vectors link; rows with equal vec_id are rows of
their own in one component if their vectors link; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm.common import connected_components, discard, map_columns, materialize

ALPHA, DEGREE, CANDIDATES, BEAM, STARTS, AUDIT, TARGET, LEAST_RECALL = 1.2, 24, 48, 24, 16, 256, 0.98, 0.9
SHARD = 512  # nodes wanted for each center
APART, SAMPLE_BYTES, MOST_CENTERS, GROUP = 0.9, 128 << 20, 1024, 8192
_LOG = logging.getLogger(__name__)


def unit(vectors: list) -> np.ndarray:
    """Rows scaled to length one in double precision, without overflow."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centers(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spaced rows of the sample."""
    k = max(1, min(k, len(sample)))
    centers = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds if k > 1 else 1):
        own = (sample @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centers)
    return centers


def apart(centers: np.ndarray) -> np.ndarray:
    """Centers of which no two are nearer than ``APART``; the first ones stay."""
    kept = np.zeros(len(centers), bool)
    for i in range(len(centers)):
        kept[i] = not kept.any() or (centers[kept] @ centers[i]).max() < APART
    return centers[kept]


def robust_prune(sims: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours [n, degree] (-1: none) chosen from candidates [n, c], which are sorted nearest first."""
    n, c = candidates.shape
    rows = np.arange(n)
    far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(sims, candidates, 1)))
    alive = candidates != rows[:, None]
    out = np.full((n, degree), -1, np.int64)
    for r in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        best = candidates[rows, alive.argmax(axis=1)]
        out[some, r] = best[some]
        between = np.sqrt(np.maximum(0, 2 - 2 * sims[best[:, None], candidates]))
        alive &= (alpha * between > far) & (candidates != best[:, None]) & some[:, None]
    return out


def build_graph(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency lists of a block; every node can be reached from the medoid."""
    n = len(x)
    if n == 1:
        return [np.zeros(0, np.int64)]
    sims = (x @ x.T).astype(np.float32)
    c = min(n - 1, CANDIDATES)
    near = np.argpartition(-sims, c, axis=1)[:, : c + 1]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
    chosen = robust_prune(sims, near)
    a, b = np.repeat(np.arange(n), chosen.shape[1]), chosen.ravel()
    a, b = a[b >= 0], b[b >= 0]
    edges = np.unique(np.concatenate([a * n + b, b * n + a]))
    lists = np.split(edges % n, np.searchsorted(edges // n, np.arange(1, n)))
    start, seen = medoid(x), np.zeros(n, bool)
    seen[start], front = True, np.array([start])
    while True:
        while len(front):
            front = np.unique(np.concatenate([lists[i] for i in front]))
            front = front[~seen[front]]
            seen[front] = True
        if seen.all():
            return lists
        out, inside = np.flatnonzero(~seen), np.flatnonzero(seen)
        part = sims[np.ix_(out, inside)]
        i, j = np.unravel_index(int(part.argmax()), part.shape)
        p, q = out[i], inside[j]
        lists[q], lists[p] = np.append(lists[q], p), np.append(lists[p], q)
        front = np.array([p])
        seen[p] = True


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def medoids(x: np.ndarray) -> np.ndarray:
    """Nodes nearest to the centers of up to ``STARTS`` groups of the block."""
    return np.unique((x @ fit_centers(x, min(STARTS, len(x)), 3).T).argmax(axis=0))


def range_search(asked: np.ndarray, x: np.ndarray, table: np.ndarray, least: float, own: np.ndarray | None = None) -> np.ndarray:
    """In-range nodes [queries, n] found for the vectors ``asked``, which are the nodes ``own`` if that is given.

    ``table``: adjacency [n, width], padded with n.
    """
    n, q = len(x), len(asked)
    sims = np.full((q, n + 1), -2.0)  # cosine of every node that was reached
    closed = np.zeros((q, n + 1), bool)
    closed[:, n] = True
    start = medoids(x)
    sims[:, start] = asked @ x[start].T
    if own is not None:
        sims[np.arange(q), own] = 1.0

    def reach(who: np.ndarray, nodes: np.ndarray) -> None:
        """Opens ``nodes`` for queries ``who`` and computes the cosines of their new neighbours."""
        closed[who, nodes] = True
        key = np.unique((who[:, None] * (n + 1) + table[nodes]).ravel())
        w, m = key // (n + 1), key % (n + 1)
        new = (m < n) & (sims[w, m] < -1.5)
        w, m = w[new], m[new]
        for k in range(0, len(w), 1 << 16):
            s = slice(k, k + (1 << 16))
            sims[w[s], m[s]] = np.einsum("ij,ij->i", asked[w[s]], x[m[s]])

    active, beam = np.arange(q), min(BEAM, n)
    for _ in range(n):
        now = np.where(closed[active], -3.0, sims[active])
        best = now.argmax(axis=1)
        value = now[np.arange(len(active)), best]
        worst = np.partition(sims[active], n + 1 - beam, axis=1)[:, n + 1 - beam]  # a beam's last place
        go = (value > -1.5) & (value >= worst)
        if not go.any():
            break
        active, best = active[go], best[go]
        reach(active, best)
    while True:
        who, nodes = np.nonzero((sims >= least) & ~closed)
        if not len(who):
            return sims[:, :n] >= least
        for k in range(0, len(who), 1 << 15):
            reach(who[k : k + (1 << 15)], nodes[k : k + (1 << 15)])


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each local component."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(before, root):
            break
    return root


def _table(ids: np.ndarray, lists: list) -> np.ndarray:
    """Adjacency in positions of ``ids``, which are sorted; padded with their number."""
    own = []
    for nbrs in lists:
        at = np.minimum(np.searchsorted(ids, nbrs), len(ids) - 1)
        own.append(at[ids[at] == nbrs])
    table = np.full((len(ids), max(1, max(map(len, own)))), len(ids), np.int64)
    for i, at in enumerate(own):
        table[i, : len(at)] = at
    return table


def search_blocks(rows: pd.DataFrame, least: float, cluster: int, i: int, j: int) -> pd.DataFrame:
    """(node, links, classes, root) of the nodes of one block (i = j), or of the links between two."""
    rows = rows.sort_values("node", ignore_index=True)
    ids, block = rows["node"].to_numpy(np.int64), rows["block"].to_numpy()
    x, n = unit(rows["v"].tolist()), len(rows)
    found_a, found_b = [], []
    for asking, asked in {(i, j), (j, i)}:
        own, at = np.flatnonzero(block == asking), np.flatnonzero(block == asked)
        if not len(own) or not len(at):
            continue
        table = _table(ids[at], rows["nbrs"].iloc[at].tolist())
        for k in range(0, len(own), 256):
            part = own[k : k + 256]
            hit = range_search(x[part], x[at], table, least, np.arange(k, k + len(part)) if i == j else None)
            p, q = np.nonzero(hit)
            found_a += [part[p], at[q]]
            found_b += [at[q], part[p]]  # found from either side
    key = np.unique(np.concatenate(found_a or [np.zeros(0, np.int64)]) * n + np.concatenate(found_b or [np.zeros(0, np.int64)]))
    a, b = key // n, key % n
    a, b = a[a != b], b[a != b]
    places = max(len(s) for s in rows["shards"])
    shards = np.array([[*s, *[-1] * (places - len(s))] for s in rows["shards"]])
    first = np.full(len(a), np.iinfo(np.int64).max)
    for i in range(places):
        for j in range(places):
            same = (shards[a, i] == shards[b, j]) & (shards[a, i] >= 0)
            first = np.where(same, np.minimum(first, shards[a, i]), first)
    root = _local_roots(n, a, b)
    own = first == cluster
    copies = rows["copies"].to_numpy(np.float64)
    links = np.bincount(a[own], copies[b[own]], n).astype(np.int64)
    return pd.DataFrame({"node": ids, "links": links, "classes": np.bincount(a[own], minlength=n), "root": ids[root]})


def _nodes(vectors: DataFrame) -> DataFrame:
    """(v, node, copies, smallest) of the distinct vectors that can link."""
    v = F.col("v")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    grouped = vectors.where(v.isNotNull() & F.coalesce(sound, F.lit(False))).groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("smallest"))
    return materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _assigned(nodes: DataFrame, centers: dict[int, np.ndarray], probes: int, margin: float) -> DataFrame:
    """``nodes`` with the clusters of each."""
    shared = nodes.sparkSession.sparkContext.broadcast(centers)  # at most sample_rows / 8 centers
    first, total = {}, 0
    for dim in sorted(centers):
        first[dim], total = total, total + len(centers[dim])

    def run(batches):
        for b in batches:
            dims = np.array([len(v) for v in b["w"]])
            out: list = [None] * len(dims)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                known = shared.value.get(dim)
                if known is None:  # a length that the sample lacks: one cluster, cut into blocks
                    for i in at.tolist():
                        out[i] = [total + dim]
                    continue
                sims = unit([b["w"][i] for i in at.tolist()]) @ known.T
                order = np.argsort(-sims, axis=1)[:, :probes]
                near = np.take_along_axis(sims, order, 1)
                keep = near >= near[:, :1] - margin
                for i, o, k in zip(at.tolist(), order + first[dim], keep):
                    out[i] = o[k].tolist()
            yield {"shards": out}

    keyed = nodes.select("node", "copies", "v", F.col("v").alias("w"))
    return map_columns(keyed, "shards array<long>", run, keep=("node", "copies", "v"))


def _split(placed: DataFrame, split: int, probes: int, margin: float) -> DataFrame:
    """``placed`` (node, copies, v, cluster) with clusters of over ``split`` nodes dealt over centers of their own."""
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > split)
    wanted = F.least(F.lit(MOST_CENTERS), F.ceil(F.col("n") / SHARD)).cast("int")
    # a row a first-level cluster, so it is as small as the table of centers
    large = materialize(sizes.select("cluster", wanted.alias("k"), F.ceil(F.col("n") / GROUP).alias("salts"), F.greatest(F.lit(1), F.floor(F.col("n") / (wanted * 32))).cast("int").alias("every")), "large")
    if large.isEmpty():
        return placed
    mine = placed.join(F.broadcast(large), "cluster")
    sample = mine.where(F.pmod(F.xxhash64("node", F.lit(3)), F.col("every")) == 0)  # about 32 nodes a center

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = apart(fit_centers(unit(rows["v"].tolist()), int(rows["k"].iloc[0])))
        return pd.DataFrame({"cluster": rows["cluster"].iloc[0], "salts": rows["salts"].iloc[0], "sub": np.arange(len(x)), "center": list(x)})

    centers = materialize(sample.groupBy("cluster").applyInPandas(fit, "cluster long, salts long, sub long, center array<double>"), "subcenters")
    salted = mine.select("node", "copies", "v", "cluster", F.pmod(F.xxhash64("node", F.lit(5)), F.col("salts")).alias("salt"))
    tables = centers.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))

    def assign(rows: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(table):
            return rows[["node", "copies", "v", "cluster"]]
        table = table.sort_values("sub")
        sims = unit(rows["v"].tolist()) @ np.array(table["center"].tolist()).T
        order = np.argsort(-sims, axis=1)[:, :probes]
        near = np.take_along_axis(sims, order, 1)
        i, j = np.nonzero(near >= near[:, :1] - margin)
        out = rows.iloc[i][["node", "copies", "v", "cluster"]].reset_index(drop=True)
        return out.assign(cluster=(out["cluster"] + 1) * (1 << 20) + table["sub"].to_numpy()[order[i, j]])

    kind = f"node long, copies long, v {placed.schema['v'].dataType.simpleString()}, cluster long"
    dealt = salted.groupBy("cluster", "salt").cogroup(tables.groupBy("cluster", "salt")).applyInPandas(assign, kind)
    rest = placed.join(F.broadcast(large.select("cluster")), "cluster", "left_anti").select("node", "copies", "v", "cluster")
    return rest.unionByName(dealt)


def _linked(nodes: DataFrame, centers: dict[int, np.ndarray], least: float, block: int, split: int, probes: int, margin: float) -> DataFrame:
    """(node, links, classes, root) by node and pair of blocks."""
    assigned = _assigned(nodes, centers, probes, margin)
    assigned = materialize(assigned.select("node", "copies", "v", F.explode("shards").alias("cluster")), "assigned")
    dealt = materialize(_split(assigned, split, probes, margin), "placed")
    discard(assigned)
    placed = dealt
    shards = placed.groupBy("node").agg(F.collect_list("cluster").alias("shards"))  # at most probes, or its square
    blocks = placed.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # a row a cluster
    placed = placed.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["node"].to_numpy(np.int64)
        return pd.DataFrame({"node": ids, "nbrs": [ids[own].tolist() for own in build_graph(unit(rows["v"].tolist()))]})

    parts = placed.select("cluster", "block", "node", "v").groupBy("cluster", "block").applyInPandas(build, "node long, nbrs array<long>")
    # one list for each block of a node
    united = parts.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = placed.join(united.join(shards, "node"), "node").select("*", other.alias("other")).select("node", "copies", "v", "shards", "nbrs", "cluster", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return search_blocks(rows, least, *key)

    found = paired.groupBy("cluster", "i", "j").applyInPandas(search, "node long, links long, classes long, root long")
    linked = materialize(found, "linked")
    discard(dealt)
    return linked


def _audit(nodes: DataFrame, linked: DataFrame, least: float) -> float:
    """Mean share of its links that was found of an audited node; brute force over all nodes."""
    found = linked.groupBy("node").agg(F.sum("classes").alias("found"))
    stratum = F.floor(F.log2("found")).cast("int")
    linking = found.where("found > 0").withColumn("stratum", stratum)
    spread = linking.withColumn("place", F.row_number().over(W.partitionBy("stratum").orderBy(F.xxhash64("node", F.lit(11)), "node"))).where("place <= 16")
    half = spread.orderBy("place", F.desc("stratum")).limit(AUDIT // 2).select("node")
    ids = nodes.orderBy(F.xxhash64("node", F.lit(7)), "node").limit(AUDIT // 2).select("node").union(half).distinct()
    asked = nodes.join(F.broadcast(ids), "node", "left_semi").select("node", "v").collect()  # at most AUDIT rows
    shared = nodes.sparkSession.sparkContext.broadcast([(r.node, list(r.v)) for r in asked])

    def run(batches):
        by_dim: dict[int, list] = {}
        for node, v in shared.value:
            by_dim.setdefault(len(v), []).append((node, v))
        for b in batches:
            own: dict[int, list] = {}
            for v in b["v"]:
                own.setdefault(len(v), []).append(v)
            for dim, rows in own.items():
                if dim in by_dim:
                    n = (unit([v for _, v in by_dim[dim]]) @ unit(rows).T >= least).sum(axis=1)
                    yield {"node": [k for k, _ in by_dim[dim]], "n": n.astype(np.int64)}

    true = map_columns(nodes.select("v"), "node long, n long", run).groupBy("node").agg((F.sum("n") - 1).alias("n")).where("n > 0")
    share = true.join(found, "node", "left").agg(F.avg(F.coalesce("found", F.lit(0)) / F.col("n"))).first()[0]
    return 1.0 if share is None else share  # no audited node links


def link_vectors(vectors: DataFrame, least: float = 0.95, block: int = 2048, sample_rows: int = 65536, split: int = 16384, probes: int = 4, margin: float = 0.1) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select("vec_id", F.col("embedding").cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("v"))
    nodes = _nodes(rows)
    total, widest = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    wanted = min(sample_rows // 8, -(-total // SHARD))
    most = max(1, min(sample_rows, SAMPLE_BYTES // (8 * (widest or 1)), max(1024, 32 * wanted)))
    taken = nodes.orderBy(F.xxhash64("node"), "node").limit(most).select("v").collect()
    by_dim: dict[int, list] = {}
    for r in taken:
        by_dim.setdefault(len(r.v), []).append(r.v)
    centers = {dim: apart(fit_centers(unit(own), -(-wanted * len(own) // len(taken)))) for dim, own in by_dim.items()}
    while True:
        linked = _linked(nodes, centers, least, block, split, probes, margin)
        recall = _audit(nodes, linked, least)
        _LOG.info("recall of the audited nodes: %.4f with %d clusters a node at most", recall, probes)
        if recall >= TARGET or probes >= 64:
            break
        discard(linked)
        probes, margin = probes * 2, margin * 2
    if recall < LEAST_RECALL:
        raise RuntimeError(f"links found: {recall:.3f} of the audited nodes' links, {LEAST_RECALL} wanted")
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(linked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    labelled = nodes.join(counts, "node").join(groups, "node", "left").select("v", "copies", "links", "smallest", F.coalesce("component", "node").alias("component"))
    labelled = materialize(labelled, "labelled")
    lowest = labelled.groupBy("component").agg(F.min("smallest").alias("lowest"))
    named = labelled.join(lowest, "component").select(F.xxhash64("v").alias("h"), F.col("v").alias("w"), (F.col("links") + F.col("copies") - 1).alias("n"), "lowest")
    keyed = rows.withColumn("h", F.xxhash64("v"))
    joined = keyed.join(named, (keyed["h"] == named["h"]) & (keyed["v"] == named["w"]), "left")
    component = F.coalesce("lowest", "vec_id")
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op4_flatgraph(spark, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS k, vec_id, CAST(embedding AS DOUBLE[]) AS v,
         embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS sound FROM embeddings),
l AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM e a JOIN e b ON a.k <> b.k AND a.sound AND b.sound AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT k AS a, k AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT r.a AS k, min(e.vec_id) AS component_id FROM r JOIN e ON e.k = r.b GROUP BY r.a),
n AS (SELECT a AS k, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, coalesce(e.vec_id = c.component_id, false) AS kept FROM e JOIN c USING (k) LEFT JOIN n USING (k)
"""

"""Community detection with pinned labels, and what follows from a partition.

Every connected component of the graph is a task of its own: seeded local moving from a queue, refinement of each
community into connected pieces, and the same again over the pieces, until nothing improves.  Vertices with a
label stay in their label's community, two labels never meet.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import discard, written

#: Most passes over all levels, each from single vertices on with the communities of the one before.
ITERATIONS = 4
#: Edges up to which the whole graph is one task; larger ones are cut into connected components first.
ONE_TASK = 1_000_000
METRICS = ("cpm", "modularity", "rbc", "rber", "significance", "surprise")


def initial_partition(vertices: DataFrame) -> DataFrame:
    """(id, comm, pinned) of (id, label): labels in order from 0, then a community for each other vertex by id.

    The other vertices are numbered by range partitions and counts of those before, not in one task.
    """
    names = sorted(r[0] for r in vertices.where("label is not null").select("label").distinct().collect())  # labels are few
    place = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("label")) - 1 if names else F.lit(0)
    known = vertices.where("label is not null").select("id", place.cast("long").alias("comm"), F.lit(True).alias("pinned"))
    held = vertices.where("label is null").select("id").repartitionByRange("id").withColumn("range", F.spark_partition_id())
    held = written(held, "ranges")
    sizes = held.groupBy("range").agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect()  # a row a partition
    before, total = [], len(names)
    for r in sizes:
        before.append((r["range"], total))
        total += r["n"]
    begins = vertices.sparkSession.createDataFrame(before, "range int, before long")
    rank = F.row_number().over(Window.partitionBy("range").orderBy("id"))
    free = held.join(F.broadcast(begins), "range").select("id", (F.col("before") + rank - 1).cast("long").alias("comm"), F.lit(False).alias("pinned"))
    return known.unionByName(free)


def partition_quality(edges: DataFrame, parts: DataFrame, metric: str = "cpm", resolution: float = 0.001) -> DataFrame:
    """(quality) of a partition (id, comm), with each edge once."""
    a, b = (parts.select(F.col("id").alias(x), F.col("comm").alias(f"comm_{x}")) for x in ("src", "dst"))
    joined = edges.join(a, "src").join(b, "dst")
    inner = joined.where("comm_src = comm_dst").groupBy(F.col("comm_src").alias("comm")).agg(F.count(F.lit(1)).alias("e"))
    degree = joined.select(F.explode(F.array("comm_src", "comm_dst")).alias("comm")).groupBy("comm").agg(F.count(F.lit(1)).alias("k"))
    size = parts.groupBy("comm").agg(F.count(F.lit(1)).alias("n"))
    table = size.join(inner, "comm", "left").join(degree, "comm", "left").na.fill(0)
    m, n = F.sum("k").over(Window.partitionBy()) / 2, F.sum("n").over(Window.partitionBy())
    pairs = F.col("n") * (F.col("n") - 1) / 2
    density = 2 * m / (n * (n - 1))

    def divergence(q: Column, p: Column) -> Column:
        return F.when(q > 0, q * F.log(q / p)).otherwise(0.0) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)

    if metric == "surprise":
        sums = table.agg(F.sum("e").alias("e"), (F.sum("k") / 2).alias("m"), F.sum(pairs).alias("pairs"), F.sum("n").alias("n"))
        every = F.col("n") * (F.col("n") - 1) / 2
        return sums.select(F.round(F.col("m") * divergence(F.col("e") / F.col("m"), F.col("pairs") / every), 6).alias("quality"))
    terms = {
        "significance": F.when(pairs > 0, pairs * divergence(F.col("e") / F.when(pairs > 0, pairs), density)).otherwise(0.0),
        "cpm": F.col("e") - resolution * pairs,
        "modularity": F.col("e") - F.col("k") ** 2 / (4 * m),
        "rbc": F.col("e") - resolution * F.col("k") ** 2 / (4 * m),
        "rber": F.col("e") - resolution * (2 * m / (n * (n - 1))) * pairs,
    }
    if metric not in terms:
        raise ValueError(f"metric must be one of {tuple(terms)}")
    return table.select(terms[metric].alias("q")).agg(F.round(F.sum("q"), 6).alias("quality"))


class _State:
    """Totals of communities: inner edges e, size n, degree k."""

    def __init__(self, metric: str, resolution: float, m: float, n: float):
        self.metric, self.r, self.m, self.n = metric, resolution, max(m, 1e-12), n
        self.p = 2 * m / (n * (n - 1)) if n > 1 else 0.0
        self.inner = self.pairs = 0.0  # over all communities, for surprise

    @staticmethod
    def _divergence(q: float, p: float) -> float:
        q, p = min(max(q, 0.0), 1.0), min(max(p, 1e-12), 1 - 1e-12)
        return (q * np.log(q / p) if q > 0 else 0.0) + ((1 - q) * np.log((1 - q) / (1 - p)) if q < 1 else 0.0)

    def term(self, e: float, n: float, k: float) -> float:
        pairs = n * (n - 1) / 2
        if self.metric == "cpm":
            return e - self.r * pairs
        if self.metric in ("modularity", "rbc"):
            return e - (self.r if self.metric == "rbc" else 1.0) * k * k / (4 * self.m)
        if self.metric == "rber":
            return e - self.r * self.p * pairs
        return pairs * self._divergence(e / pairs, self.p) if pairs else 0.0

    def surprise(self, e: float, pairs: float) -> float:
        every = self.n * (self.n - 1) / 2
        return self.m * self._divergence(e / self.m, pairs / every) if every else 0.0

    def gain(self, before: list[tuple], after: list[tuple]) -> float:
        if self.metric != "surprise":
            return sum(self.term(*c) for c in after) - sum(self.term(*c) for c in before)
        e = sum(c[0] for c in after) - sum(c[0] for c in before)
        pairs = sum(c[1] * (c[1] - 1) / 2 for c in after) - sum(c[1] * (c[1] - 1) / 2 for c in before)
        return self.surprise(self.inner + e, self.pairs + pairs) - self.surprise(self.inner, self.pairs)


class _Graph:
    """Weighted neighbours of nodes in rows: those of node v are at pointer[v]:pointer[v + 1]."""

    def __init__(self, n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, own: np.ndarray, size: np.ndarray, degree: np.ndarray):
        a, b, w = np.concatenate((src, dst)), np.concatenate((dst, src)), np.concatenate((weight, weight))
        order = np.lexsort((b, a))
        self.n, self.ends, self.weights = n, b[order].tolist(), w[order].tolist()
        self.pointer = np.searchsorted(a[order], np.arange(n + 1)).tolist()
        self.own, self.size, self.degree = own, size, degree

    @staticmethod
    def of(node: np.ndarray, src: np.ndarray, dst: np.ndarray) -> _Graph:
        """The graph of groups of vertices: ``node`` has each vertex's group."""
        n = int(node.max(initial=-1)) + 1
        x, y = node[src], node[dst]
        inner = x == y
        low, high = np.minimum(x, y)[~inner], np.maximum(x, y)[~inner]
        pairs, weight = np.unique(low * max(n, 1) + high, return_counts=True)
        own = np.bincount(x[inner], minlength=n).astype(float)
        return _Graph(n, pairs // max(n, 1), pairs % max(n, 1), weight.astype(float), own, np.bincount(node, minlength=n).astype(float), (np.bincount(x, minlength=n) + np.bincount(y, minlength=n)).astype(float))


def _move(graph: _Graph, fixed: np.ndarray, comm: np.ndarray, state: _State, rng, within: np.ndarray | None = None) -> bool:
    """Local moving of nodes in place, until no node in the queue gains by a move.

    ``within``: nodes stay in the parts it names, start alone, and move once, only while still alone
    (refinement); a part then splits into connected pieces.
    """
    n = graph.n
    own, size, degree = graph.own.tolist(), graph.size.tolist(), graph.degree.tolist()
    place = comm.tolist()
    e, s, k, members = [0.0] * n, [0.0] * n, [0.0] * n, [0] * n
    for v in range(n):
        c = place[v]
        s[c] += size[v]
        k[c] += degree[v]
        members[c] += 1
        e[c] += own[v] + sum(graph.weights[i] for i in range(graph.pointer[v], graph.pointer[v + 1]) if graph.ends[i] < v and place[graph.ends[i]] == c)
    state.inner, state.pairs = sum(e), sum(x * (x - 1) / 2 for x in s)
    ends, weights, pointer, term = graph.ends, graph.weights, graph.pointer, state.term
    alone = state.metric != "surprise"  # communities' terms add up, so each is worked out once until it changes
    terms = [term(*x) for x in zip(e, s, k)] if alone else []
    empty = [c for c in range(n) if not members[c]]
    part = within.tolist() if within is not None else None
    still = (~fixed).tolist()
    queue = [v for v in rng.permutation(n).tolist() if still[v]]
    queued = [bool(x) for x in still]
    begun = 0
    moved = False
    while begun < len(queue):
        v = queue[begun]
        begun += 1
        if begun > 1 << 16 and begun * 2 > len(queue):
            queue, begun = queue[begun:], 0
        queued[v] = False
        c = place[v]
        if part is not None and members[c] > 1:
            continue
        links: dict[int, float] = {}
        for i in range(pointer[v], pointer[v + 1]):
            u = ends[i]
            if part is None or part[u] == part[v]:
                links[place[u]] = links.get(place[u], 0.0) + weights[i]
        now = (e[c], s[c], k[c])
        left = (e[c] - own[v] - links.get(c, 0.0), s[c] - size[v], k[c] - degree[v])
        targets = sorted(x for x in links if x != c)
        if members[c] > 1 and part is None:
            targets.append(empty[-1])
        best, to = 1e-9, c
        rest = term(*left) if alone else 0.0
        for x in targets:
            got = (e[x] + own[v] + links.get(x, 0.0), s[x] + size[v], k[x] + degree[v])
            if alone:
                gain = (rest + term(*got)) - (terms[c] + terms[x])
            else:
                gain = state.gain([now, (e[x], s[x], k[x])], [left, got])
            if gain > best:
                best, to = gain, x
        if to == c:
            continue
        if not members[to]:
            empty.pop()
        state.inner -= e[c] + e[to]
        state.pairs -= (s[c] * (s[c] - 1) + s[to] * (s[to] - 1)) / 2
        e[to] += own[v] + links.get(to, 0.0)
        e[c], s[c], k[c] = left
        s[to] += size[v]
        k[to] += degree[v]
        if alone:
            terms[c], terms[to] = rest, term(e[to], s[to], k[to])
        state.inner += e[c] + e[to]
        state.pairs += (s[c] * (s[c] - 1) + s[to] * (s[to] - 1)) / 2
        members[c] -= 1
        members[to] += 1
        if not members[c]:
            empty.append(c)
        place[v] = to
        moved = True
        if part is None:
            for i in range(graph.pointer[v], graph.pointer[v + 1]):
                u = graph.ends[i]
                if still[u] and not queued[u] and place[u] != to:
                    queued[u] = True
                    queue.append(u)
    comm[:] = place
    return moved


def _numbered(parts: np.ndarray, first: int) -> np.ndarray:
    """The parts with numbers from ``first`` on closed up; those below it keep theirs."""
    out = parts.copy()
    free = parts >= first
    _, number = np.unique(parts[free], return_inverse=True)
    out[free] = first + number
    return out


def detect(ids: np.ndarray, labels: np.ndarray, src: np.ndarray, dst: np.ndarray, metric: str, resolution: float, seed: int, totals: tuple[int, int] | None = None) -> np.ndarray:
    """Community of each vertex: labels in order first, then the others by size (largest first) and smallest id.

    Each level moves nodes between communities, refines every community without a label from single nodes on
    into connected pieces, and goes on with the pieces as nodes, placed as their communities were.
    ``totals``: edges and vertices of the whole graph, where this is one component of it.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    order = np.argsort(ids, kind="stable")
    src, dst = (order[np.searchsorted(ids[order], x)] for x in (src, dst))
    names = sorted({x for x in labels if x is not None})
    number = {x: i for i, x in enumerate(names)}
    n, pinned = len(ids), len(names)
    node = np.array([number[x] if x is not None else -1 for x in labels], np.int64)
    free = node < 0
    node[free] = pinned + np.arange(free.sum())  # a label's vertices are one node from the start
    m, vertices = totals or (len(src), n)
    state = _State(metric, resolution, m, vertices)
    rng = np.random.default_rng(seed)
    single = node.copy()
    found = node.copy()  # the community of each vertex
    for _ in range(ITERATIONS if n else 0):
        before = found
        node, comm = single, found[np.unique(single, return_index=True)[1]]
        while True:
            graph = _Graph.of(node, src, dst)
            fixed = np.arange(graph.n) < pinned
            # Community numbers name nodes: each is that of its smallest node, so a label's stays.
            least = np.full(int(comm.max()) + 1, graph.n)
            np.minimum.at(least, comm, np.arange(graph.n))
            comm = least[comm]
            moved = _move(graph, fixed, comm, state, rng)
            groups = np.bincount(comm, minlength=graph.n)
            if not moved and groups.max() <= 1:
                break
            if moved:  # pieces of each community; what is with a label is one piece with it
                piece = np.where(comm < pinned, comm, np.arange(graph.n))
                _move(graph, comm < pinned, piece, state, rng, within=comm)
            else:
                piece = comm
            piece = _numbered(piece, pinned)
            if len(np.unique(piece)) == graph.n:
                piece = _numbered(comm, pinned)  # all single: whole communities go on
            after = np.zeros(int(piece.max()) + 1, np.int64)
            after[piece] = comm
            node, comm = piece[node], after
        found = _numbered(comm[node], pinned)
        if (found == before).all():
            break
    out = _connected(found, pinned, src, dst)
    groups = np.bincount(out, minlength=pinned)
    first = np.full(len(groups), np.iinfo(np.int64).max)
    np.minimum.at(first, out, ids)
    rank = np.lexsort((first[pinned:], -groups[pinned:]))
    renamed = np.concatenate((np.arange(pinned), np.empty(len(rank), np.int64)))
    renamed[pinned + rank] = pinned + np.arange(len(rank))
    return renamed[out]


def _connected(comm: np.ndarray, pinned: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The communities from ``pinned`` on cut into connected ones, numbers closed up."""
    root = np.arange(len(comm))
    inner = comm[src] == comm[dst]
    a, b = src[inner], dst[inner]
    while True:
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        least = least[least]
        if (least == root).all():
            break
        root = least
    return _numbered(np.where(comm < pinned, comm, pinned + root), pinned)


def graph_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, part): the smallest vertex that each vertex can reach; a label's vertices count as joined."""
    first = vertices.where("label is not null").groupBy("label").agg(F.min("id").alias("first"))
    joined = vertices.join(F.broadcast(first), "label").select(F.col("id").alias("src"), F.col("first").alias("dst"))
    links = edges.select("src", "dst").unionByName(joined).where("src <> dst")
    links = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    links = written(links, "links")
    parts = written(vertices.select("id", F.col("id").alias("part")), "parts")
    while True:
        near = links.join(parts.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("part").alias("near"))
        better = parts.join(near, "id", "left").select("id", F.least("part", F.coalesce("near", "part")).alias("part"))
        # Jump to the part of the part, so a path is halved each round.
        roots = better.select(F.col("id").alias("part"), F.col("part").alias("root"))
        jumped = written(better.join(roots, "part").select("id", F.col("root").alias("part")), "parts")
        changed = jumped.join(parts.withColumnRenamed("part", "was"), "id").where("part <> was").limit(1).count()
        discard(parts)
        parts = jumped
        if not changed:
            discard(links)
            return parts


def pinned_communities(edges: DataFrame, vertices: DataFrame, metric: str = "cpm", resolution: float = 0.001, seed: int = 0) -> DataFrame:
    """(id, comm) of vertices (id, label or null) and undirected edges (src, dst).

    The quality adds up over the connected components of the graph (a label's vertices joined) for all metrics
    but surprise, and no community that gains anything crosses them, so beyond ONE_TASK edges each component is
    a task of its own; for surprise the graph is one.  Communities are numbered over all components, labels first.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    every = sorted(r[0] for r in vertices.where("label is not null").select(F.col("label").cast("string")).distinct().collect())  # labels are few
    m, n = edges.count(), vertices.count()
    if metric == "surprise" or m <= ONE_TASK:
        parts = vertices.select("id", F.lit(0).cast("long").alias("part"))
    else:
        parts = graph_components(edges, vertices)
    nodes = vertices.join(parts, "id").select("part", F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), "id", F.col("label").cast("string").alias("label"))
    links = edges.join(parts.withColumnRenamed("id", "src"), "src").select("part", "src", "dst", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("label"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[pdf["id"].notna()].sort_values("id")
        e = pdf[pdf["id"].isna()].sort_values(["src", "dst"])
        ids = v["id"].to_numpy(np.int64)
        labels = np.array([None if pd.isna(x) else x for x in v["label"]], object)
        comm = detect(ids, labels, e["src"].to_numpy(np.int64), e["dst"].to_numpy(np.int64), metric, resolution, seed, (m, n))
        here = sorted({x for x in labels if x is not None})
        known = np.array([every.index(x) for x in here], np.int64)
        pinned = comm < len(here)
        size = np.bincount(comm)
        first = np.full(len(size), np.iinfo(np.int64).max)
        np.minimum.at(first, comm, ids)
        return pd.DataFrame({"id": ids, "known": np.where(pinned, np.append(known, 0)[np.minimum(comm, len(here))], -1), "size": size[comm], "first": first[comm]})

    found = nodes.unionByName(links).groupBy("part").applyInPandas(kernel, "id long, known long, size long, first long")
    found = written(found, "communities")
    # Free communities by size and smallest id: ranks within a size, and how many communities of larger sizes there are.
    free = found.where("known < 0").select("first", "size").distinct()
    within = free.withColumn("rank", F.row_number().over(Window.partitionBy("size").orderBy("first")))
    sizes = free.groupBy("size").agg(F.count(F.lit(1)).alias("n"))  # a row for each size there is
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbers = within.join(before, "size").select("first", (F.col("rank") + F.col("before") - 1 + len(every)).cast("long").alias("comm"))
    known = found.where("known >= 0").select("id", F.col("known").alias("comm"))
    return known.unionByName(found.where("known < 0").join(numbers, "first").select("id", "comm"))


def annotations(parts: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, annotation) of vertices without a label: a known label, or the number of a novel community."""
    known = vertices.where("label is not null").join(parts, "id").select("comm", F.col("label").alias("known")).distinct()
    new = vertices.where("label is null").select("id").join(parts, "id")
    return new.join(F.broadcast(known), "comm", "left").select("id", F.coalesce("known", F.col("comm").cast("string")).alias("annotation"), F.col("known").isNull().alias("novel"))


def agreement(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(n, agree, share) of (obs, annotation) against (obs, label): observations that are in both."""
    both = found.select("obs", "annotation").join(truth.where("label is not null").select("obs", "label"), "obs")
    agree = F.count(F.when(F.col("annotation") == F.col("label").cast("string"), 1))
    return both.agg(F.count(F.lit(1)).alias("n"), agree.alias("agree"), (agree / F.count(F.lit(1))).alias("share"))


def closest_labels(centres: DataFrame, clusters: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(cluster, label, dist) of label centres (label, v) and cluster members (cluster, v): the label nearest to each mean."""
    mean = clusters.select("cluster", F.posexplode("v").alias("pos", "x")).groupBy("cluster", "pos").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("v"))
    from tessera.operators.knn import nearest

    named = centres.withColumn("id", F.row_number().over(Window.orderBy("label")).cast("long"))
    # Clusters may be many: numbers in no order, without one task for all, and written so that they stay.
    numbered = written(mean.withColumn("id", -1 - F.monotonically_increasing_id()), "clusters")
    found = nearest(numbered, named, 1, metric)
    return found.join(numbered.select(F.col("id").alias("src"), "cluster"), "src").join(named.select(F.col("id").alias("dst"), "label"), "dst").select("cluster", "label", "dist")

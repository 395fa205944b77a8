"""Embedding near-dedup by hierarchical navigable small-world graphs, one per shard of a label's vectors."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from sievenet.llm.components import components
from sievenet.llm.tables import saved

SHARD = 4096  # vectors of a graph, about
DEGREE = 12  # neighbours on the upper layers; the lowest has twice as many
BEAM = 48  # first width of the search beam
STEP = 4  # nodes of a beam that are followed at once
QUERIES = 256  # searched at once
AUDITED = 64  # queries of a search that are compared with all vectors of the shard
RECALL = 0.97  # of the audited links; a search that finds less is repeated with a beam twice as wide
THRESHOLD = 0.98


class Graph:
    """A navigable small-world graph of unit vectors, built and searched for many vectors at once."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, seed: int = 7):
        self.vectors = vectors
        n = len(vectors)
        top = np.minimum(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(degree), 12).astype(int)
        order = np.argsort(-top, kind="stable")
        self.entry = int(order[0])
        self.layers: list[np.ndarray] = []  # from the top one; neighbours of each node, -1 where there are fewer
        for level in range(int(top.max()), -1, -1):
            self.layers.append(self._layer(order[: np.count_nonzero(top >= level)], degree * (1 if level else 2), beam))

    @classmethod
    def of(cls, vectors: np.ndarray, layers: list[np.ndarray], entry: int) -> Graph:
        """A graph that was built before."""
        made = cls.__new__(cls)
        made.vectors, made.layers, made.entry = vectors, layers, entry
        return made

    def _layer(self, members: np.ndarray, degree: int, beam: int) -> np.ndarray:
        """Neighbours on one layer: members join in batches of up to the number of those already there."""
        table = np.full((len(self.vectors), degree), -1, np.int32)
        there = np.zeros(len(self.vectors), bool)
        done = min(len(members), max(2, degree))
        first = members[:done]
        self._connect(table, first, np.repeat(first[None], done, 0))
        there[first] = True
        while done < len(members):
            new = members[done : done + min(done, 1024)]
            starts = self._descend(self.vectors[new], len(self.layers))
            starts = np.where(there[starts], starts, members[0])
            found = np.concatenate([self._search(table, self.vectors[new[i : i + QUERIES]], starts[i : i + QUERIES], beam)[0] for i in range(0, len(new), QUERIES)])
            near = self.vectors[new] @ self.vectors[new].T
            peers = new[np.argsort(-near, 1, kind="stable")[:, : min(len(new), beam // 2)]]
            self._connect(table, new, np.concatenate([found, peers], 1))
            there[new] = True
            done += len(new)
        return table

    def _select(self, nodes: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
        """For each node the nearest candidates that aren't nearer to one chosen before, then the nearest others."""
        own = candidates == nodes[:, None]
        candidates = np.where(own, -1, candidates)
        order = np.sort(candidates, 1)[:, ::-1]  # repeated ones go
        candidates = np.where(np.concatenate([np.zeros((len(order), 1), bool), order[:, 1:] == order[:, :-1]], 1), -1, order)
        near = np.einsum("bcd,bd->bc", self.vectors[candidates], self.vectors[nodes])
        near[candidates < 0] = -np.inf
        best = np.argsort(-near, 1, kind="stable")[:, : 2 * degree]
        candidates, near = np.take_along_axis(candidates, best, 1), np.take_along_axis(near, best, 1)
        held = self.vectors[candidates]
        among = held @ held.transpose(0, 2, 1)
        width = candidates.shape[1]
        chosen = np.zeros(candidates.shape, bool)
        closest = np.full(candidates.shape, -np.inf, np.float32)
        for j in range(width):
            take = (candidates[:, j] >= 0) & (near[:, j] > closest[:, j]) & (chosen.sum(1) < degree)
            chosen[:, j] = take
            closest = np.where(take[:, None], np.maximum(closest, among[:, :, j]), closest)
        rank = np.argsort(np.where(chosen, 0, width) + np.arange(width), 1)[:, :degree]
        out = np.full((len(nodes), degree), -1, np.int32)
        out[:, : rank.shape[1]] = np.take_along_axis(candidates, rank, 1)
        return out

    def _connect(self, table: np.ndarray, nodes: np.ndarray, candidates: np.ndarray) -> None:
        """Nodes take neighbours from their candidates and are offered to those in return."""
        degree = table.shape[1]
        for i in range(0, len(nodes), QUERIES):
            table[nodes[i : i + QUERIES]] = self._select(nodes[i : i + QUERIES], candidates[i : i + QUERIES], degree)
        source, target = np.repeat(nodes, degree), table[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        near = np.einsum("nd,nd->n", self.vectors[source], self.vectors[target])
        order = np.lexsort((-near, target))
        source, target = source[order], target[order]
        firsts = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, int)
        place = np.arange(len(target)) - np.repeat(firsts, np.diff(np.append(firsts, len(target))))
        fits = place < 2 * degree
        who = target[firsts]
        offered = np.full((len(who), 2 * degree), -1, np.int32)
        row = np.cumsum(np.isin(np.arange(len(target)), firsts)) - 1
        offered[row[fits], place[fits]] = source[fits]
        for i in range(0, len(who), QUERIES):
            part = who[i : i + QUERIES]
            table[part] = self._select(part, np.concatenate([table[part], offered[i : i + QUERIES]], 1), degree)

    def _descend(self, queries: np.ndarray, layers: int) -> np.ndarray:
        at = np.full(len(queries), self.entry)
        for table in self.layers[:layers]:
            for i in range(0, len(queries), QUERIES):
                at[i : i + QUERIES] = self._search(table, queries[i : i + QUERIES], at[i : i + QUERIES], STEP)[0][:, 0]
        return at

    def _search(self, table: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam of nearest nodes of each query and their cosines, nearest first; -1 where there are fewer."""
        q, n = len(queries), len(self.vectors)
        beam = min(beam, n)
        seen = np.zeros((q, n + 1), bool)
        rows = np.arange(q)
        nodes, near = np.full((q, beam), -1, np.int32), np.full((q, beam), -np.inf, np.float32)
        nodes[:, 0] = starts
        near[:, 0] = np.einsum("qd,qd->q", queries, self.vectors[starts])
        seen[rows, starts] = True
        open_ = nodes >= 0
        while True:
            live = np.flatnonzero(open_.any(1))
            if not len(live):
                return nodes, near
            pick = np.argsort(~open_[live], 1, kind="stable")[:, :STEP]
            followed = np.where(np.take_along_axis(open_[live], pick, 1), np.take_along_axis(nodes[live], pick, 1), -1)
            open_[live[:, None], pick] = False
            found = np.where(followed[:, :, None] >= 0, table[followed], -1).reshape(len(live), -1)
            found = np.sort(found, 1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[seen[live[:, None], found]] = -1
            seen[live[:, None], found] = True
            seen[:, n] = False  # the place of -1
            fresh = np.einsum("qkd,qd->qk", self.vectors[found], queries[live])
            fresh[found < 0] = -np.inf
            all_nodes, all_near = np.concatenate([nodes[live], found], 1), np.concatenate([near[live], fresh], 1)
            all_open = np.concatenate([open_[live], found >= 0], 1)
            best = np.argsort(-all_near, 1, kind="stable")[:, :beam]
            nodes[live], near[live] = np.take_along_axis(all_nodes, best, 1), np.take_along_axis(all_near, best, 1)
            open_[live] = np.take_along_axis(all_open, best, 1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        starts = self._descend(queries, len(self.layers) - 1)
        parts = [self._search(self.layers[-1], queries[i : i + QUERIES], starts[i : i + QUERIES], beam) for i in range(0, len(queries), QUERIES)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """In double precision, times a power of two that brings the largest number of each row near one: exact, and squares stay finite."""
    exact = vectors.astype(np.float64)
    return np.ldexp(exact, -np.frexp(np.abs(exact).max(axis=1, keepdims=True, initial=0.0))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    exact = _scaled(vectors)
    return exact / np.linalg.norm(exact, axis=1, keepdims=True)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = _scaled(a), _scaled(b)
    return np.einsum("nd,nd->n", a, b) / (np.sqrt(np.einsum("nd,nd->n", a, a)) * np.sqrt(np.einsum("nd,nd->n", b, b)))


def linked(graph: Graph, held: np.ndarray, queries: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with a cosine of threshold or more, each verified.

    Queries whose beam holds links only are searched again with a wider one; so are all, if too few
    of the audited queries' links were found.
    """
    units = _unit(queries).astype(np.float32)
    beam, n = BEAM, len(held)
    audited = np.unique(np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int))
    truth = (_unit(queries[audited]) @ _unit(held).T) >= threshold
    while True:
        todo, width, found = np.arange(len(queries)), beam, []
        while len(todo):
            nodes, near = graph.search(units[todo], width)
            enough = (near[:, -1] < threshold - 1e-3) | (nodes.shape[1] >= n)
            close = near[enough] >= threshold - 1e-3
            found.append(np.stack([np.repeat(todo[enough], close.sum(1)), nodes[enough][close]]))
            todo, width = todo[~enough], width * 4
        q, v = np.concatenate(found, 1)
        good = np.zeros(len(q), bool)
        for i in range(0, len(q), 1 << 16):
            good[i : i + (1 << 16)] = _cosines(queries[q[i : i + (1 << 16)]], held[v[i : i + (1 << 16)]]) >= threshold
        q, v = q[good], v[good]
        seen = np.zeros(truth.shape, bool)
        place = np.searchsorted(audited, q)
        mine = (place < len(audited)) & (audited[np.minimum(place, len(audited) - 1)] == q)
        seen[place[mine], v[mine]] = True
        if (seen & truth).sum() >= RECALL * truth.sum() or beam >= n:
            return q, v
        beam *= 2


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that links (a, b) reach: minima are passed on until none changes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors (vec_id, embedding, label).

    Vectors with equal labels link at a cosine of threshold or more.  Equal vectors are one node with a
    weight.  A label's nodes are dealt to shards by hash; each pair of shards meets in one task, one's
    vectors searching the other's graph.  A task returns sums and a spanning forest, never its links.
    n_links counts other rows; component_id is the smallest vec_id reached; kept marks that row.

    Rows with a null label, and vectors that are null, empty, zero or hold null or non-finite numbers, link
    with nothing, nor do vectors of different lengths.  Numbers are compared as given, floats or doubles.  A row without a vec_id links with nothing, has a
    null component and is kept.
    """
    kind = "float" if vectors.schema["embedding"].dataType.elementType == FloatType() else "double"
    e = F.col("embedding").cast(f"array<{kind}>")
    fit = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(e, lambda x: x != 0), F.lit(False)))
    rows = vectors.select("vec_id", "label", e.alias("embedding"), fit.alias("fit"))
    key = ["label", "length", "mark", "embedding"]
    valid = rows.where("fit").select("vec_id", "label", F.size("embedding").alias("length"), F.xxhash64("embedding").alias("mark"), "embedding")
    nodes = saved(valid.groupBy(*key).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies")), "nodes")
    counts = nodes.groupBy("label", "length").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    dealt = nodes.join(counts, ["label", "length"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))

    def build(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id", kind="stable")
        held = np.stack(own["embedding"].to_list()).astype(np.float32 if kind == "float" else np.float64)
        graph = Graph(_unit(held).astype(np.float32))
        packed = pickle.dumps((own["id"].to_numpy(), own["copies"].to_numpy(), held, graph.layers, graph.entry))
        return pd.DataFrame({"label": own["label"].iloc[:1], "length": own["length"].iloc[:1], "shards": own["shards"].iloc[:1], "shard": own["shard"].iloc[:1], "graph": [packed]})

    label = f"label {vectors.schema['label'].dataType.simpleString()}, "
    graphs = saved(dealt.groupBy("label", "length", "shard").applyInPandas(build, label + "length int, shards int, shard int, graph binary"), "graphs")
    # every shard is sent to each task that pairs it with another, or with itself
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    sent = graphs.select("*", other.alias("other")).select("label", "length", F.least("shard", "other").alias("low"), F.greatest("shard", "other").alias("high"), "shard", "graph")

    def meet(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("shard")
        ids, copies, held, layers, entry = pickle.loads(own["graph"].iloc[-1])
        graph = Graph.of(_unit(held).astype(np.float32), layers, entry)
        one = own["low"].iloc[0] == own["high"].iloc[0]
        if one:
            asking, weights, queries = ids, copies, held
        elif len(own) < 2:
            return pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
        else:
            asking, weights, queries, *_ = pickle.loads(own["graph"].iloc[0])
        q, v = linked(graph, held, queries, threshold)
        q, v = (q[q != v], v[q != v]) if one else (q, v)
        if one:  # each link once from either side, whichever search found it
            both = np.unique(np.stack([np.concatenate([q, v]), np.concatenate([v, q])], 1), axis=0)
            q, v = both[:, 0], both[:, 1]
            names, total = ids, np.bincount(q, copies[v], len(ids))
            root = _roots(q, v, len(ids))
        else:
            names = np.concatenate([asking, ids])
            total = np.concatenate([np.bincount(q, copies[v], len(asking)), np.bincount(v, weights[q], len(ids))])
            root = _roots(q, v + len(asking), len(names))
        some = total > 0
        return pd.DataFrame({"id": names[some], "links": total[some].astype(np.int64), "root": names[root[some]]})

    found = saved(sent.groupBy("label", "length", "low", "high").applyInPandas(meet, "id bigint, links bigint, root bigint"), "found")
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = nodes.join(links, "id", "left").join(joined, F.col("id") == F.col("node"), "left").select(*key, "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    all_rows = rows.select("vec_id", F.when(F.col("fit"), F.col("label")).alias("label"), F.size("embedding").alias("length"), F.xxhash64("embedding").alias("mark"), "embedding")
    out = all_rows.join(classes, key, "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

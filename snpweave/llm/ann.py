"""Approximate nearest neighbours: a graph by NN-descent, queries by greedy graph search.

Equal vectors are one node (the smallest vec_id) with its smallest ids, so a vector that a third of
all rows share is one row; partial window limits cut it before the shuffle.

The graph starts from blocks of ``BLOCK`` rows that lie next to each other in the order of random
hyperplane signs (a range sort by (signs, node), so no bucket can grow).  Lists hold ids, similarities and whether an
entry is new; vectors travel as one byte a component and only where two nodes meet.  An NN-descent round brings to each
node the vectors of its neighbours and those of the nodes that hold it; pairs of a holder and a neighbour of which either
edge is new are compared, and each holder gets the ids that beat its worst, as the node does.  Nodes around which nothing is new
send nothing.  A node that more than ``HUB`` others hold is dealt to several tasks.  Nothing is capped but the length of a
list, which is the graph's degree; rounds go on until at most a share ``settled`` of all entries is new.

Search walks edges both ways: forward ones, and back from a node to the ``4 * degree`` nearest that hold it (the index's
second degree).  A query is a row of the index and enters at its own node; each round expands the best open nodes of its
beam by a join with the graph, until none is open.  Answers are ranked again by the exact cosine in double precision.

Defined results
* vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
  length is not the most frequent one (ties: the larger); null ids take no part.
* rows that repeat a vec_id are separate rows of one id: the id stands once in an answer.
* ties go to the smaller vec_id; with fewer candidates than asked for, all of them are returned.
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .staging import drop_stage, stage

BLOCK, TREES, BITS = 256, 4, 24
HUB = 2048
#: rows of a broadcast list of hot nodes
FEW = 200_000


def _raw(batches):
    for rb in batches:
        ids, raws = [], []
        for i, v in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            x = np.array(v, np.float64) + 0.0
            ids.append(i)
            raws.append(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raws, pa.binary())], ["vec_id", "raw"])


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def pack(x: np.ndarray) -> list[bytes]:
    """Unit vectors as a scale and a byte for each component."""
    scale = (np.abs(x).max(axis=1, keepdims=True) / 127).astype(np.float32)
    q = np.rint(x / scale).astype(np.int8)
    return [a.tobytes() + b.tobytes() for a, b in zip(scale, q, strict=True)]


def unpack(vecs: list[bytes], dim: int) -> np.ndarray:
    both = np.frombuffer(b"".join(vecs), np.uint8).reshape(len(vecs), dim + 4)
    return both[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(both[:, :4]).view(np.float32)


def _signed(dim: int):
    def run(batches):
        planes = np.random.default_rng(17).normal(size=(dim, TREES * BITS)).astype(np.float32)
        for rb in batches:
            if not rb.num_rows:
                continue
            x = _unit(rb.column(1).to_pylist())
            bits = ((x @ planes) > 0).reshape(len(x), TREES, BITS).astype(np.int64)
            gray = np.bitwise_xor.accumulate(bits, axis=2)  # neighbours in the order differ in one sign
            code = (gray << np.arange(BITS - 1, -1, -1)).sum(axis=2) + (np.arange(TREES, dtype=np.int64) << 40)
            packed = pa.array(pack(x), pa.binary())
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array(code[:, t]), rb.column(0), packed], ["code", "node", "vec"])

    return run


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "float": pa.float32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    c = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, (_, t) in zip(c, fields, strict=True)], [n for n, _ in fields])


_LIST = "node long, vec binary, ids binary, sims binary, fresh binary"


def _row(node: int, vec, ids: np.ndarray, sims: np.ndarray, fresh: int) -> tuple:
    return node, vec, ids.astype(np.int64).tobytes(), sims.astype(np.float32).tobytes(), bytes([fresh]) * len(ids)


def _near_in_order(dim: int, degree: int):
    def solve(nodes, vecs):
        f, ids = unpack(vecs, dim), np.array(nodes, np.int64)
        s = f @ f.T
        np.fill_diagonal(s, -9)
        k = min(degree, len(nodes) - 1)
        best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(nodes), 0), np.int64)
        return _table([_row(nodes[i], vecs[i], ids[b], s[i, b], 1) for i, b in enumerate(best)], _LIST)

    def run(batches):
        tree, nodes, vecs = None, [], []
        for rb in batches:
            for c, n, v in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2).to_pylist(), strict=True):
                if nodes and (c >> 40 != tree or len(nodes) >= BLOCK):
                    yield solve(nodes, vecs)
                    nodes, vecs = [], []
                tree = c >> 40
                nodes.append(n)
                vecs.append(v)
        if nodes:
            yield solve(nodes, vecs)

    return run


def _by_key(batches):
    """(key, [row, ..]) of rows whose first column stands together; a key's rows come in lots of at most 64."""
    key, rows = None, []
    for rb in batches:
        for k, *r in zip(*(c.to_pylist() for c in rb.columns), strict=True):
            if k != key or len(rows) >= 64:
                if rows:
                    yield key, rows
                key, rows = k, []
            rows.append(r)
    if rows:
        yield key, rows


def _merge(degree: int):
    """Rows of one node stand together; keep the ``degree`` nearest of all their lists.  An id that was held before is not new."""

    def best(node, parts):
        vec = next((p[0] for p in parts if p[0] is not None), None)
        ids = np.frombuffer(b"".join(p[1] for p in parts), np.int64)
        sims = np.frombuffer(b"".join(p[2] for p in parts), np.float32)
        fresh = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
        order = np.lexsort((fresh, ids))
        first = np.flatnonzero(np.concatenate([[True], np.diff(ids[order]) != 0])) if len(ids) else np.zeros(0, np.int64)
        own = order[first]
        keep = own[np.lexsort((ids[own], -sims[own]))][:degree]
        return [vec, ids[keep].tobytes(), sims[keep].tobytes(), fresh[keep].tobytes()]

    def run(batches):
        node, held, out = None, [], []
        for k, parts in _by_key(batches):
            if k != node:
                if node is not None:
                    out.append((node, *best(node, held)))
                node, held = k, []
            held = [best(k, held + parts)]
            if len(out) > 2000:
                yield _table(out, _LIST)
                out = []
        if node is not None:
            out.append((node, *best(node, held)))
        yield _table(out, _LIST)

    return run


_EDGE = "a long, b long, sim float, worst float, fresh boolean"


def _edges(degree: int):
    """An edge for each entry of a list, with the list's worst similarity."""

    def run(batches):
        for rb in batches:
            for lo in range(0, rb.num_rows, 2000):
                node, _, ids, sims, fresh = (c.slice(lo, 2000).to_pylist() for c in rb.columns)
                to = [np.frombuffer(x, np.int64) for x in ids]
                s = [np.frombuffer(x, np.float32) for x in sims]
                n = np.array([len(x) for x in to], np.int64)
                worst = np.array([x.min() if len(x) >= degree else -2 for x in s], np.float32)
                flat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
                cols = [np.repeat(np.array(node, np.int64), n), flat(to, np.int64), flat(s, np.float32), np.repeat(worst, n), np.frombuffer(b"".join(fresh), np.uint8).astype(bool)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "sim", "worst", "fresh"])

    return run


_VISIT = "v long, lot int, kind int, u long, vec binary, sim float, worst float, fresh boolean"


def _meet(dim: int):
    """Rows of (v, lot): its neighbours (kind 0, with v's worst), then those that hold it (kind 1, with their own).  Better ids for both."""

    def run(batches):
        place, near, held, out = None, [], [], []

        def close():
            """Holders against the neighbours."""
            nonlocal held
            if not held:
                return []
            v, worst = place[0], near[0][3] if near else -2.0
            u = np.array([h[0] for h in held], np.int64)
            sim, own, fresh = (np.array([h[i] for h in held]) for i in (2, 3, 4))
            rows = []
            if near:
                ids, new = np.array([x[0] for x in near], np.int64), np.array([x[4] for x in near])
                s = unpack([h[1] for h in held], dim) @ unpack([x[1] for x in near], dim).T
                better = (s > own[:, None]) & (ids[None, :] != u[:, None]) & (fresh[:, None] | new[None, :])
                rows = [_row(int(u[i]), None, ids[b], s[i, b], 1) for i in np.flatnonzero(better.any(axis=1)) for b in [np.flatnonzero(better[i])]]
                known = np.isin(u, ids)
            else:
                known = np.zeros(len(u), bool)
            back = np.flatnonzero((sim > worst) & fresh & ~known)
            if len(back):
                rows.append(_row(v, None, u[back], sim[back], 1))
            held = []
            return rows

        for rb in batches:
            cols = [c.to_pylist() for c in rb.columns]
            for v, lot, kind, *x in zip(*cols, strict=True):
                if (v, lot) != place:
                    out += close()
                    place, near = (v, lot), []
                if kind == 0:
                    near.append(x)
                else:
                    held.append(x)
                    if len(held) >= 2048:
                        out += close()
            if len(out) > 2000:
                yield _table(out, _LIST)
                out = []
        out += close()
        yield _table(out, _LIST)

    return run


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _hot(rows: DataFrame, key: str, name: str) -> DataFrame:
    """(name, lots) of keys that more than ``HUB`` rows hold, staged; at most one row in ``HUB``."""
    return _few(stage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HUB).select(F.col(key).alias(name), F.ceil(F.col("n") / HUB).cast("int").alias("lots")), "hot"))


def _visits(graph: DataFrame, degree: int, n: int, active: bool) -> tuple[DataFrame, DataFrame]:
    """Both ends' vectors of every edge of ``n`` nodes, dealt to the other end, and the staged edges; with ``active`` only around new edges."""
    edges = stage(graph.mapInArrow(_edges(degree), _EDGE), "edges")
    vecs = graph.select(F.col("node").alias("n"), "vec")
    # kind 1: a, which holds b, goes to b; kind 0: b goes to a, which holds it
    asked = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(1).alias("kind"), "sim", "worst", "fresh").unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), F.lit(0).alias("kind"), "sim", "worst", "fresh"))
    if active:
        new = edges.filter("fresh")
        out, into = new.select(F.col("a").alias("v")).distinct().withColumn("out", F.lit(True)), new.select(F.col("b").alias("v")).distinct().withColumn("into", F.lit(True))
        asked = asked.join(out, "v", "left").join(into, "v", "left").filter("fresh or out or (kind = 0 and into)").drop("out", "into")
    if n <= HUB:  # no node can have more holders
        return asked.withColumn("lot", F.lit(0)).join(vecs.withColumnRenamed("n", "u"), "u").select("v", "lot", "kind", "u", "vec", "sim", "worst", "fresh"), edges
    hot, lots = _hot(edges, "b", "v"), F.coalesce("lots", F.lit(1))
    spread = F.when(F.col("kind") == 0, F.sequence(F.lit(0), lots - 1)).otherwise(F.array(F.pmod(F.xxhash64("u"), lots).cast("int")))
    asked = asked.join(hot, "v", "left").withColumn("lot", F.explode(spread)).drop("lots")
    # the vector of a node that many hold is asked for in lots as well
    many = hot.withColumnRenamed("v", "n")
    asked = asked.withColumn("n", F.col("u")).join(many, "n", "left").withColumn("of", F.pmod(F.xxhash64("v"), lots).cast("int")).drop("lots")
    copies = vecs.join(many, "n", "left").withColumn("of", F.explode(F.sequence(F.lit(0), lots - 1))).drop("lots")
    return asked.join(copies, ["n", "of"]).select("v", "lot", "kind", "u", "vec", "sim", "worst", "fresh"), edges


def _gather(lists: DataFrame, degree: int, parts: int) -> DataFrame:
    return lists.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(_merge(degree), _LIST)


def _aged(batches):
    for rb in batches:
        old = pa.array([bytes(len(x)) for x in rb.column(4).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*rb.columns[:4], old], rb.schema.names)


def build_graph(nodes: DataFrame, dim: int, degree: int = 20, settled: float = 0.05) -> DataFrame:
    """``nodes`` has (node, raw); the graph has each node's ``degree`` nearest found (node, vec, ids, sims, fresh)."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = stage(nodes.select("node", "raw").mapInArrow(_signed(dim), "code long, node long, vec binary"), "signs")
    start = order.repartitionByRange(parts, "code", "node").sortWithinPartitions("code", "node").mapInArrow(_near_in_order(dim, degree), _LIST)
    graph = stage(_gather(start, degree, parts), "graph")
    drop_stage(order)
    n = graph.count()
    first = True
    while n:
        seen, edges = _visits(graph, degree, n, not first)
        sent = seen.repartition(parts, "v", "lot").sortWithinPartitions("v", "lot", "kind").mapInArrow(_meet(dim), _LIST)
        new = stage(_gather(graph.mapInArrow(_aged, _LIST).unionByName(sent), degree, parts), "graph")
        drop_stage(graph, edges)
        graph, first = new, False
        changed = graph.agg(F.sum(F.length(F.translate(F.hex("fresh"), "0", "")))).first()[0] or 0
        if changed <= settled * n * degree:
            break
    return graph


def _chunks(batches):
    """Rows (node, u, vec) of one node stand together; lists of at most 64 of them."""
    schema, out = "node long, ids binary, vecs binary", []
    for node, rows in _by_key(batches):
        out.append((node, np.array([r[0] for r in rows], np.int64).tobytes(), b"".join(r[1] for r in rows)))
        if len(out) > 1000:
            yield _table(out, schema)
            out = []
    yield _table(out, schema)


def both_ways(graph: DataFrame, degree: int) -> DataFrame:
    """(node, ids, vecs): each node's neighbours, and the ``4 * degree`` nearest of the nodes whose neighbour it is."""
    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen, _ = _visits(graph, degree, graph.count(), False)
    near = F.row_number().over(Window.partitionBy("v", "kind").orderBy(F.desc("sim"), "u"))
    edges = seen.filter("kind = 1 or lot = 0").withColumn("place", near).filter(F.col("place") <= 4 * degree).select(F.col("v").alias("node"), "u", "vec")
    return edges.repartition(parts, "node").sortWithinPartitions("node", "u").mapInArrow(_chunks, "node long, ids binary, vecs binary")


_BEAM = "q long, vec binary, ids binary, sims binary, open binary"


def _enter(batches):
    for rb in batches:
        yield _table([(n, v, np.int64(n).tobytes() + i, np.float32(2).tobytes() + s, b"\x01" * (1 + len(i) // 8)) for n, v, i, s, _ in zip(*(c.to_pylist() for c in rb.columns), strict=True)], _BEAM)


def _ask(width: int):
    """The beam's best open nodes are asked for; the beam goes along with them closed."""

    def run(batches):
        for rb in batches:
            rows = []
            for q, v, ids, _, op in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                i, o = np.frombuffer(ids, np.int64), np.frombuffer(op, np.uint8)
                rows += [(int(w), q, v) for w in i[np.flatnonzero(o)[:width]]]
            yield _table(rows, "node long, q long, qvec binary")

    return run


def _close(width: int):
    def run(batches):
        for rb in batches:
            rows = []
            for q, v, ids, sims, op in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                o = np.frombuffer(op, np.uint8).copy()
                o[np.flatnonzero(o)[:width]] = 0
                rows.append((q, v, ids, sims, o.tobytes()))
            yield _table(rows, _BEAM)

    return run


def _expand(dim: int):
    def run(batches):
        for rb in batches:
            rows = []
            for q, qvec, ids, vecs in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                s = _many(vecs, dim) @ unpack([qvec], dim)[0]
                rows.append((q, qvec, ids, s.astype(np.float32).tobytes(), b"\x01" * len(s)))
            yield _table(rows, _BEAM)

    return run


def _many(vecs: bytes, dim: int) -> np.ndarray:
    return unpack([vecs[i : i + dim + 4] for i in range(0, len(vecs), dim + 4)], dim)


def _beam_merge(beam: int):
    def best(q, parts):
        ids = np.frombuffer(b"".join(p[1] for p in parts), np.int64)
        sims = np.frombuffer(b"".join(p[2] for p in parts), np.float32)
        op = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
        sims = np.where(ids == q, np.float32(2), sims)
        order = np.lexsort((op, ids, -sims))
        _, first = np.unique(ids[order], return_index=True)
        keep = order[np.sort(first)][:beam]
        return [parts[0][0], ids[keep].tobytes(), sims[keep].tobytes(), op[keep].tobytes()]

    def run(batches):
        q, held, out = None, [], []
        for k, parts in _by_key(batches):
            if k != q:
                if q is not None:
                    out.append((q, *best(q, held)))
                q, held = k, []
            held += parts
        if q is not None:
            out.append((q, *best(q, held)))
        yield _table(out, _BEAM)

    return run


def _from_hot(held: DataFrame, asks: DataFrame) -> DataFrame:
    hot = _hot(asks, "node", "node").drop("lots")
    cold = held.join(asks.join(hot, "node", "left_anti"), "node")
    busy = asks.join(_few(held.join(hot, "node", "left_semi")), "node")
    return cold.unionByName(busy)


def greedy_search(graph: DataFrame, queries: DataFrame, dim: int, degree: int = 20, beam: int = 512, width: int = 512) -> DataFrame:
    """``queries`` has (node) of query nodes; beams of (q, ids, ...) after the search, in which nothing is left open.

    A node is asked for once by a query at most, so the rounds end.  Nodes that more than ``HUB`` queries ask for at once send
    their lists to the queries instead (there can be none with fewer queries than that).
    """
    parts = int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt by node once for all rounds; a lost part comes again from the staged graph
    held = both_ways(graph, degree).repartition(parts, "node").persist(StorageLevel.DISK_ONLY)
    state = stage(graph.join(queries, "node", "left_semi").mapInArrow(_enter, _BEAM), "beam")
    few = state.count() <= HUB
    while True:
        asks = state.mapInArrow(_ask(width), "node long, q long, qvec binary")
        got = held.join(asks, "node") if few else _from_hot(held, asks)
        got = got.select("q", "qvec", "ids", "vecs").mapInArrow(_expand(dim), _BEAM)
        every = state.mapInArrow(_close(width), _BEAM).unionByName(got)
        new = stage(every.repartition(parts, "q").sortWithinPartitions("q").mapInArrow(_beam_merge(beam), _BEAM), "beam")
        drop_stage(state)
        state = new
        if state.filter(F.hex("open").contains("01")).limit(1).count() == 0:
            break
    held.unpersist()
    return state


def _exact(batches):
    for rb in batches:
        out = []
        for a, b in zip(rb.column("qraw").to_pylist(), rb.column("raw").to_pylist(), strict=True):
            x, y = np.frombuffer(a), np.frombuffer(b)
            out.append(float(np.dot(x, y) / (np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y)))))
        yield pa.RecordBatch.from_arrays([rb.column("q"), rb.column("ids"), pa.array(out, pa.float64())], ["q", "ids", "score"])


def _beam_ids(batches):
    for rb in batches:
        ids = [np.frombuffer(x, np.int64) for x in rb.column(1).to_pylist()]
        q = np.repeat(rb.column(0).to_numpy(), [len(x) for x in ids])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64))], ["q", "node"])


def nearest(embeddings: DataFrame, is_query, k: int = 5, degree: int = 20, beam: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row that ``is_query`` marks."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    e = e.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    common = e.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common["d"]
    rows = stage(e.filter(F.size("v") == dim).mapInArrow(_raw, "vec_id long, raw binary"), "vectors")
    # the k + 1 smallest ids of equal vectors: enough when a query leaves itself out
    place = F.row_number().over(Window.partitionBy("raw").orderBy("vec_id"))
    some = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    nodes = stage(some.groupBy("raw").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_set("vec_id")).alias("ids")), "nodes")
    asked = stage(rows.filter(is_query(F.col("vec_id"))).distinct().join(nodes.select("raw", "node"), "raw").select("vec_id", "node").withColumnRenamed("vec_id", "query_id"), "asked")
    graph = build_graph(nodes, dim, degree)
    found = greedy_search(graph, asked.select("node").distinct(), dim, degree, beam)
    pairs = found.select("q", "ids").mapInArrow(_beam_ids, "q long, node long")
    own = nodes.select(F.col("node").alias("q"), F.col("raw").alias("qraw"))
    scored = pairs.join(nodes, "node").join(own, "q").select("q", "ids", "qraw", "raw").mapInArrow(_exact, "q long, ids array<long>, score double")
    flat = scored.select("q", F.explode("ids").alias("vec_id"), "score")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    top = stage(flat.withColumn("p", best).filter(F.col("p") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("top")), "answers")
    drop_stage(rows, graph, found)
    out = asked.join(top, asked["node"] == top["q"]).select("query_id", F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("top"))
    return out.select("query_id", F.posexplode("top").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))

"""Approximate nearest neighbours by learned partitions.

On a bounded sample the inner-product neighbour graph is built and cut into balanced
parts; a small network learns to tell from a vector where its neighbours are. It then
places every vector in its likeliest part, and sends every query to several parts,
whose vectors are all compared with it in double precision. How many parts are asked
is the least number that finds ``TARGET`` of the true neighbours of vectors that were
held out of the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType
from pyspark.sql.window import Window

from quern.llm.skew import common_keys, dealt_join
from quern.storage import Scratch

#: Vectors that the model is fitted on, in expectation; every vector is indexed.
SAMPLE = 16_000
#: Vectors held out of the fit, a share of the sample, to choose how many parts are asked.
HELD_OUT = 0.15
#: Vectors of a part, about; parts of a table that has any; vectors of the sample in a part, at least.
PART_SIZE, LEAST_PARTS, SAMPLE_OF_PART = 1_500, 8, 32
#: Tables of fewer different vectors are one part.
LEAST_VECTORS = 256
#: Rows or queries of a block: no task holds more than one block of each.
BLOCK = 4_096
DEGREE = 20
TARGET = 0.96
HIDDEN, EPOCHS = 128, 25


def neighbour_graph(x: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Row i: the vectors with the largest inner products with vector i, itself left out."""
    n = len(x)
    degree = min(degree, n - 1)
    out = np.empty((n, degree), np.int32)
    for a in range(0, n, 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 1024] = np.argpartition(s, n - degree, axis=1)[:, n - degree :]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.1) -> np.ndarray:
    """A part for each vector, none over ``slack`` times its share, few graph edges cut.

    Starts from medians along principal axes and moves vectors to where most of their
    graph neighbours are, while there is room.
    """
    n = len(x)
    label = np.zeros(n, np.int32)
    todo, fresh = [(np.arange(n), parts)], 0
    while todo:
        rows, count = todo.pop()
        if count == 1:
            label[rows] = fresh
            fresh += 1
            continue
        centred = x[rows] - x[rows].mean(axis=0)
        axis = rng.normal(size=x.shape[1])
        for _ in range(12):
            axis = centred.T @ (centred @ axis)
            axis /= np.linalg.norm(axis) + 1e-30
        left = count // 2
        order = rows[np.argsort(centred @ axis, kind="stable")]
        cut = len(rows) * left // count
        todo += [(order[:cut], left), (order[cut:], count - left)]
    near: list[list[int]] = [[*row] for row in graph.tolist()]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            near[j].append(i)
    room = int(np.ceil(slack * n / parts))
    size = np.bincount(label, minlength=parts)
    for _ in range(12):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(label[near[i]], minlength=parts)
            own = label[i]
            votes[(size >= room) & (np.arange(parts) != own)] = -1
            best = int(votes.argmax())
            if votes[best] > votes[own]:
                size[own] -= 1
                size[best] += 1
                label[i] = best
                moved += 1
        if moved < n // 200:
            break
    return label


def _forward(model: dict, x: np.ndarray) -> np.ndarray:
    h = np.maximum(x @ model["w1"] + model["b1"], 0)
    z = h @ model["w2"] + model["b2"]
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(axis=1, keepdims=True)


def parts_of(vectors: int, sample: int) -> int:
    """Parts grow with the table, as far as the sample can teach them."""
    if vectors < LEAST_VECTORS:
        return 1
    return max(LEAST_PARTS, min(round(vectors / PART_SIZE), int(sample * (1 - HELD_OUT)) // SAMPLE_OF_PART))


def fit(x: np.ndarray, parts: int, seed: int = 3) -> dict:
    """The network, how many parts to ask, and the share of true neighbours that finds."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held = max(1, int(len(x) * HELD_OUT))
    queries, x = x[order[:held]], x[order[held:]]
    scale = float(np.sqrt((x**2).mean())) or 1.0
    graph = neighbour_graph(x)
    label = balanced_parts(x, graph, parts, rng)
    target = np.zeros((len(x), parts))
    for column in graph.T:
        np.add.at(target, (np.arange(len(x)), label[column]), 1.0)
    target /= target.sum(axis=1, keepdims=True)
    dim, inputs = x.shape[1], x / scale
    model = {
        "w1": rng.normal(size=(dim, HIDDEN)) * np.sqrt(2 / dim),
        "b1": np.zeros(HIDDEN),
        "w2": rng.normal(size=(HIDDEN, parts)) * np.sqrt(1 / HIDDEN),
        "b2": np.zeros(parts),
    }
    mean = {k: np.zeros_like(v) for k, v in model.items()}
    square = {k: np.zeros_like(v) for k, v in model.items()}
    step = 0
    for epoch in range(EPOCHS):
        rate = 3e-3 * (1 - epoch / EPOCHS) + 1e-4
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            step += 1
            h = np.maximum(inputs[rows] @ model["w1"] + model["b1"], 0)
            z = h @ model["w2"] + model["b2"]
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            dz = (p - target[rows]) / len(rows)
            dh = (dz @ model["w2"].T) * (h > 0)
            grads = {"w2": h.T @ dz, "b2": dz.sum(axis=0), "w1": inputs[rows].T @ dh, "b1": dh.sum(axis=0)}
            for k, g in grads.items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g**2 - square[k])
                model[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    home = _forward(model, inputs).argmax(axis=1)
    found = np.zeros(parts)  # true neighbours of held-out vectors in the m likeliest parts
    degree = min(DEGREE, len(x))
    for at in range(0, held, 512):
        few = queries[at : at + 512]
        near = np.argpartition(few @ x.T, len(x) - degree, axis=1)[:, len(x) - degree :]
        place = np.empty((len(few), parts), np.int64)
        np.put_along_axis(place, np.argsort(-_forward(model, few / scale), axis=1, kind="stable"), np.arange(parts)[None, :], axis=1)
        found += np.bincount(np.take_along_axis(place, home[near], axis=1).ravel(), minlength=parts)
    share = np.cumsum(found) / found.sum()
    asked = int(np.argmax(share >= min(TARGET, share[-1]))) + 1
    return model | {"scale": scale, "asked": asked, "recall": float(share[asked - 1])}


#: The model as a row: matrices as 64-bit floats, row by row.
MODEL = "w1 binary, b1 binary, w2 binary, b2 binary, scale double, asked int, recall double"


def _fit_task(batches: Iterator[pd.DataFrame], parts: int) -> Iterator[pd.DataFrame]:
    rows = pd.concat([*batches]).sort_values("key")
    model = fit(np.array(rows["embedding"].tolist(), np.float64), parts)
    yield pd.DataFrame({k: [v.astype("<f8").tobytes() if isinstance(v, np.ndarray) else v] for k, v in model.items()})


def _model(row) -> dict:
    arrays = {k: np.frombuffer(row[k], "<f8") for k in ("w1", "b1", "w2", "b2")}
    return arrays | {"w1": arrays["w1"].reshape(-1, HIDDEN), "w2": arrays["w2"].reshape(HIDDEN, -1), "scale": row["scale"], "asked": row["asked"]}


def _router(model: dict, asked: int):
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in series:
            x = np.array(batch.tolist(), np.float64) / model["scale"]
            order = np.argsort(-_forward(model, x), axis=1, kind="stable")[:, :asked]
            yield pd.Series([*order.astype(np.int32)])

    return F.pandas_udf(run, "array<int>", PandasUDFType.SCALAR_ITER)


#: Hits as (-score, vec_id), best first: one row for each query and block.
HIT = "part int, qkey long, hits array<struct<s:double,vec_id:long>>"


def _compare(queries: pd.DataFrame, rows: pd.DataFrame, keep: int) -> pd.DataFrame:
    """The ``keep`` best vec_ids of a block of rows for each query of a block."""
    out: list[tuple[int, int, list[dict]]] = []
    if len(queries) and len(rows):
        q, x = np.array(queries["embedding"].tolist(), np.float64), np.array(rows["embedding"].tolist(), np.float64)
        ids, keys, part = rows["ids"].tolist(), queries["qkey"].tolist(), int(queries["part"].iloc[0])
        first = np.array([i[0] for i in ids])
        norms = np.sqrt((x**2).sum(axis=1)).max() * np.sqrt((q**2).sum(axis=1))
        for at in range(0, len(q), 256):
            s = q[at : at + 256] @ x.T
            least = np.partition(s, max(0, s.shape[1] - keep), axis=1)[:, max(0, s.shape[1] - keep)]
            for i, row in enumerate(s):
                near = np.flatnonzero(row >= least[i] - 1e-12 * norms[at + i])
                score = np.zeros(len(near))
                for a, b in zip(x[near].T, q[at + i], strict=True):  # one order of summing for every pair
                    score += a * b
                best = np.lexsort((first[near], -score))[:keep]
                hits = sorted((-score[b], v) for b in best for v in ids[near[b]])[:keep]
                out.append((part, keys[at + i], [{"s": float(s_), "vec_id": int(v)} for s_, v in hits]))
    return pd.DataFrame(out, columns=["part", "qkey", "hits"])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of rows that take part.

    Null ids, and vectors that are null, empty, zero, or hold null, infinite or NaN
    components do not; nor do those of another length than most.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.where("vec_id is not null and size(embedding) > 0").where(sound).where(F.exists("embedding", lambda v: v != 0))
    sizes = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    dim = sizes.agg(F.max(F.struct("n", -F.col("dim")))).first()[0]
    return rows.where(F.size("embedding") == (-dim[1] if dim else 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all other rows for each query row.

    Both tables have vec_id and embedding; ``queries`` are rows of ``vectors``. Best is
    the largest inner product, ties to the smaller vec_id. Equal vectors are compared
    once: an index row holds the k + 1 least ids of its vector, and a query vector's
    k + 1 best serve all queries that have it. Fewer candidates give fewer ranks; no
    queries or no vectors give no rows. Repeated vec_ids are candidates of each other's
    vectors but not of their own id. See ``usable`` for rows that take no part.

    A query is compared with about asked / parts of the table. Parts grow with it up to
    what ``SAMPLE`` vectors can teach (425); beyond some 640,000 vectors parts grow
    instead, so the work of a query grows in proportion to the table from there on.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    keep = k + 1
    same = Window.partitionBy("embedding").orderBy("vec_id")
    index = usable(vectors).withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= keep)
    index = index.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    index = scratch.save(index.withColumn("key", F.col("ids")[0]), "index")
    asked_rows = scratch.save(usable(queries), "queries")
    asked = asked_rows.groupBy("embedding").agg(F.min("vec_id").alias("qkey"), F.count("*").alias("n"))
    asked = scratch.save(asked, "asked")
    common = common_keys(asked.withColumnRenamed("embedding", "_e"), ["_e"], "n", asked_rows.count())
    asked = asked.drop("n")

    count = index.count()
    parts = parts_of(count, min(count, SAMPLE))
    if parts == 1:
        index = index.withColumn("part", F.lit(0))
        asked = asked.withColumn("part", F.lit(0))
    else:
        unit = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        sample = index.where(unit < min(1.0, SAMPLE / count)).select("key", "embedding")
        fitted = sample.repartition(1).mapInPandas(partial(_fit_task, parts=parts), MODEL)
        model = _model(scratch.save(fitted, "model").first())
        home, routes = _router(model, 1), _router(model, model["asked"])
        index = scratch.save(index.withColumn("part", home("embedding")[0]), "placed")
        asked = scratch.save(asked.withColumn("part", F.explode(routes("embedding"))), "routed")

    def blocks(rows: DataFrame) -> dict[int, int]:
        return {r["part"]: -(-r["count"] // BLOCK) for r in rows.groupBy("part").count().collect()}

    def per_part(counts: dict[int, int]):
        return F.element_at(F.array(*(F.lit(counts.get(p, 1)) for p in range(parts))), F.col("part") + 1)

    row_blocks, query_blocks = blocks(index), blocks(asked)
    rows = index.select(
        "part",
        F.pmod(F.xxhash64("key"), per_part(row_blocks)).cast("int").alias("j"),
        F.explode(F.sequence(F.lit(0), per_part(query_blocks) - 1)).alias("i"),
        "embedding",
        "ids",
    )
    sent = asked.select(
        "part",
        F.pmod(F.xxhash64("qkey"), per_part(query_blocks)).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), per_part(row_blocks) - 1)).alias("j"),
        "embedding",
        "qkey",
    )
    keys = ["part", "i", "j"]
    hits = sent.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(lambda q, x: _compare(q, x, keep), HIT)

    def merged(rows: DataFrame, *by: str) -> DataFrame:
        """The ``keep`` best of several lists: first by part, whose blocks may be many, then by query."""
        return rows.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, keep).alias("hits"))

    lists = merged(merged(hits, "qkey", "part"), "qkey")
    keyed = scratch.save(asked.select("qkey", "embedding").dropDuplicates(["qkey"]).join(lists, "qkey"), "lists")
    found = dealt_join(asked_rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_e")), keyed, [("_e", "embedding")], common, ["query_id"])
    own = F.filter("hits", lambda h: h["vec_id"] != F.col("query_id"))
    ranked = found.select("query_id", F.posexplode(F.slice(F.array_sort(own), 1, k)).alias("pos", "hit"))
    done = ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
    scratch.drop("index", "asked", "model", "placed", "routed")
    return done

"""Near-duplicate vectors by product quantisation.

Distinct unit vectors are dealt to coarse inverted lists (k-means, and where there are more lists than one level of
MOST_CENTRES gives, again on the residuals, level after level, so that lists keep their size as the table grows); a
member's last residual is coded in subspaces. A query is compared in every list that is likely to hold a partner. A
vector within the radius r of the query can lie in the list of c only if the query is at most r beyond the plane between
c and its own centre; the part of a difference that points across that plane has a standard deviation of r / sqrt(dim),
and probes go as far as `sigmas` of them (infinite: as far as any partner can be, which loses nothing). On 51,282 vectors
of 64 components no true partner was further than 1.1, so that recall was 1 (brute force). In a list, asymmetric
distances from look-up tables leave those members within r plus the member's own coding error (without loss), whose
cosine is then worked out exactly. Lists with many rows are split into pairs of blocks; a block gives each query's number
of partners and a spanning set of links, never all pairs.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, written
from .components import connected_components

COSINE = 0.95
#: Vectors that the index is fitted on, at most; centres of a level; members that a list should have; subspaces; codes; rows of a block.
SAMPLE, MOST_CENTRES, LIST_SIZE, PARTS, CODES, BLOCK = 8192, 1024, 128, 8, 64, 1024
#: How far probes go, in standard deviations; rows of an Arrow batch that is handed on.
SIGMAS, HANDED = 2.4, 8192


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of x (Lloyd's rounds from evenly drawn rows; an empty centre stays where it is)."""
    c = x[np.random.default_rng(7).permutation(len(x))[: max(1, min(k, len(x)))]].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * (x @ c.T)).argmin(1)


def fitted(sample: np.ndarray, lists: int) -> dict:
    """Centres of each level (the product of their numbers is `lists` or a little more) and the codes of what is left."""
    levels, residual = [], sample
    while not levels or lists > 1:
        levels.append(kmeans(residual, min(MOST_CENTRES, lists)))
        residual = residual - levels[-1][nearest(residual, levels[-1])]
        lists = -(-lists // len(levels[-1])) if len(levels[-1]) > 1 else 1
    parts = np.array_split(np.arange(sample.shape[1]), min(PARTS, sample.shape[1]))
    return {"levels": levels, "parts": parts, "codes": [kmeans(residual[:, p], CODES) for p in parts]}


def centre(model, cell: int) -> np.ndarray:
    """Sum of the centres of a list's levels."""
    total = 0
    for c in reversed(model["levels"]):
        cell, at = divmod(cell, len(c))
        total = total + c[at]
    return total


def scaled(raw: np.ndarray) -> np.ndarray:
    """Rows times a power of two, exactly, such that squares neither overflow nor vanish."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(1))[1][:, None])


def _unit(column, dim: int) -> np.ndarray:
    x = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    start = column.offsets.to_numpy()
    x = scaled(x[start[0] : start[-1]].reshape(-1, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def probed(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, centre, whether it is the row's own) of every centre whose members may be near the row."""
    apart = np.sqrt(np.maximum((c**2).sum(1)[:, None] + (c**2).sum(1) - 2 * c @ c.T, 0))
    d = (c**2).sum(1) - 2 * x @ c.T
    home, n = d.argmin(1), np.arange(len(x))
    probe = d - d[n, home][:, None] <= 2 * reach * apart[home]
    probe[n, home] = True
    row, at = np.nonzero(probe)
    return row, at, at == home[row]


def _dealt(batches, model, dim, reach):
    """Rows (node, v, many) -> one row in each probed list, with codes and the coding error in its own."""
    import pyarrow as pa

    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            x = _unit(part.column(1), dim)
            row, cell, mine, residual = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool), x
            for c in model["levels"]:
                r, at, own = probed(residual, c, reach)
                row, cell, mine, residual = row[r], cell[r] * len(c) + at, mine[r] & own, residual[r] - c[at]
            home = np.flatnonzero(mine)  # one for each row, in order
            codes, coded = [], np.zeros_like(x)
            for p, k in zip(model["parts"], model["codes"]):
                own = nearest(residual[home][:, p], k)
                codes.append(own.astype(np.uint8))
                coded[:, p] = k[own]
            error = np.linalg.norm(residual[home] - coded, axis=1)
            codes = np.stack(codes, 1)
            for k in range(0, len(row), HANDED):
                r, pick = row[k : k + HANDED], pa.array(row[k : k + HANDED])
                own = pa.array([codes[i].tobytes() if m else None for i, m in zip(r, mine[k : k + HANDED])], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell[k : k + HANDED]), pa.array(mine[k : k + HANDED]), *[part.column(j).take(pick) for j in range(3)], own, pa.array(error[r])], ["list", "mine", "node", "v", "many", "codes", "error"])


def _compared(model, cosine, radius):
    def compare(key, group):
        import pandas as pd

        c = centre(model, int(key[0]))
        node, many = group["node"].to_numpy(), group["many"].to_numpy()
        raw = scaled(np.stack(group["v"].to_numpy()).astype(np.float64))
        norm = np.sqrt((raw * raw).sum(1))
        x = raw / norm[:, None]
        members, queries = np.flatnonzero(group["mine"].to_numpy() & (group["member_block"].to_numpy() == int(key[1]))), np.flatnonzero(group["query_block"].to_numpy() == int(key[2]))
        if not len(members) or not len(queries):
            return pd.DataFrame({"u": [], "v": [], "links": []}).astype("int64")
        codes = np.frombuffer(b"".join(group["codes"].iloc[members]), np.uint8).reshape(len(members), -1)
        limit = (radius + group["error"].to_numpy()[members] + 1e-6) ** 2
        left, links = queries, np.zeros(len(node), np.int64)
        found = np.zeros((len(queries), len(members)), bool)
        for i in range(0, len(left), 512):
            own = left[i : i + 512]
            residual, near = x[own] - c, np.zeros((len(own), len(members)))
            for j, (p, k) in enumerate(zip(model["parts"], model["codes"])):
                table = ((residual[:, p][:, None] - k[None]) ** 2).sum(2)
                near += table[:, codes[:, j]]
            a, b = np.nonzero(near <= limit)
            for s in range(0, len(a), 40_000):
                q, m = own[a[s : s + 40_000]], members[b[s : s + 40_000]]
                ok = (np.einsum("ij,ij->i", raw[q], raw[m]) / (norm[q] * norm[m]) >= cosine) & (node[q] != node[m])
                found[i + a[s : s + 40_000][ok], b[s : s + 40_000][ok]] = True
        links[queries] = found @ many[members]
        label = node.copy()
        while True:  # the least node of each connected part of this block
            before = label.copy()
            far = np.iinfo(np.int64).max
            for q, m in ((queries, members), (members, queries)):
                mat = found if q is queries else found.T
                rows = np.flatnonzero(mat.any(1))
                if len(rows):
                    low = np.where(mat[rows], label[m][None], far).min(1)
                    label[q[rows]] = np.minimum(label[q[rows]], low)
            if (label == before).all():
                break
        hit = np.flatnonzero((label != node) | (links > 0))
        return pd.DataFrame({"u": node[hit], "v": label[hit], "links": links[hit]})

    return compare


def _links(nodes: DataFrame, dim: int, kind: str, cosine: float, sigmas: float) -> DataFrame:
    """(u, v, links) of distinct vectors (node, v, many) of one length: partners of u, and a spanning set of links."""
    total = nodes.count()
    sample = scaled(np.array([r["v"] for r in nodes.select("node", "v").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()], np.float64))
    model = fitted(sample / np.linalg.norm(sample, axis=1, keepdims=True), max(1, total // LIST_SIZE))
    radius = float(np.sqrt(2 - 2 * cosine))
    reach = radius * min(1.0, sigmas / np.sqrt(dim)) + 1e-9
    dealt = written(nodes.select("node", "v", "many").mapInArrow(lambda b: _dealt(b, model, dim, reach), f"list long, mine boolean, node long, v {kind}, many long, codes binary, error double"), "lists")
    sizes = written(dealt.groupBy("list").agg(F.ceil(F.count_if("mine") / BLOCK).cast("int").alias("mb"), F.ceil(F.count("*") / BLOCK).cast("int").alias("qb")), "sizes")
    own = dealt.join(sizes.hint("merge"), "list").withColumns({"member_block": F.pmod(F.xxhash64("node"), F.greatest("mb", F.lit(1))).cast("int"), "query_block": F.pmod(F.xxhash64("node", F.lit(1)), "qb").cast("int")})
    every = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    as_query = F.transform(every(F.col("mb")), lambda m: F.struct(m.alias("m"), F.col("query_block").alias("q")))
    as_member = F.when(F.col("mine"), F.transform(every(F.col("qb")), lambda q: F.struct(F.col("member_block").alias("m"), q.alias("q")))).otherwise(F.array())
    blocks = own.withColumn("at", F.explode_outer(F.array_distinct(F.concat(as_query, as_member)))).select("list", F.col("at.m").alias("m"), F.col("at.q").alias("q"), "mine", "node", "v", "many", "codes", "error", "member_block", "query_block")
    return written(blocks.groupBy("list", "m", "q").applyInPandas(_compared(model, cosine, radius), "u long, v long, links long"), "links")


def embedding_near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, sigmas: float = SIGMAS) -> DataFrame:
    """(id, n_links, component, kept) for each row of vectors.

    Null and zero vectors and those with null or non-finite components have no link; vectors of different lengths have
    none with each other, and each length is searched by an index of its own. Equal vectors are compared once and link
    with each other; a null id is the smallest; rows that repeat an id are vectors of their own. No rows give no rows;
    other columns, labels too, are not looked at. sigmas: how far probes go (see above).
    """
    # Single precision is moved as it is; cosines are worked out in double.
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.coalesce(vectors[id_col].cast("long"), F.lit(NULL_ID)).alias("id"), vectors[vector_col].cast(kind).alias("v"))
    far = F.lit(float("inf"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < far)) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False))).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    nodes = written(rows.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("low"), F.first("v").alias("v"), F.count("*").alias("many")), "distinct")
    # A number for each distinct vector, since ids may repeat; the written table keeps it.
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    lengths = sorted(r[0] for r in nodes.select(F.size("v")).distinct().collect())
    if not lengths:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"), F.lit(True).alias("kept"))
    parts = [_links(nodes.where(F.size("v") == n), n, kind, cosine, sigmas) for n in lengths]
    found = reduce(DataFrame.union, parts)
    groups = connected_components(found.select("u", "v").where("u <> v")).withColumnRenamed("component", "top")
    counts = found.groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    ends = nodes.select("h1", "h2", "node", "low", "many").join(counts, "node", "left").join(groups, "node", "left").withColumn("top", F.coalesce("top", "node"))
    ends = written(ends.select("h1", "h2", "low", "top", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links")), "ends")
    least = written(ends.groupBy("top").agg(F.min("low").alias("component")), "least")
    ends = written(ends.join(least.hint("merge"), "top").select("h1", "h2", "links", "component"), "components")
    # n_links counts every copy. Very many copies of a vector are a large partition of a plain join, which Spark splits.
    joined = rows.select("id", "ok", "h1", "h2").join(ends.hint("merge"), ["h1", "h2"], "left")
    linked = F.col("ok") & F.col("component").isNotNull()
    joined = joined.select("id", F.when(linked, F.col("links")).otherwise(0).cast("long").alias("n_links"), F.when(linked, F.col("component")).otherwise(F.col("id")).alias("component"))
    return joined.withColumn("kept", F.col("id") == F.col("component"))

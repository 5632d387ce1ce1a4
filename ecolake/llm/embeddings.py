"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation learnt on a bounded sample turns vectors into balanced binary codes that keep
angles. Codes are cut into substrings of ``KEY_BITS`` bits, one table each; a code is filed
under each substring and under those that differ from it in one bit that is zero. Codes that
meet in a table and are near over their whole length become neighbours. The vectors of
connected codes then meet once, and the original vectors decide about every pair of them in
double precision, so the number of candidates never leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecolake.llm.common import bucket_edges, components, local_labels, whole_groups, written

CODE_BITS = 128
KEY_BITS = 16
TABLES = 4
NEAR_BITS = 26  # of 128; a cosine of 0.95 differs in 13 on average
SAMPLE_ROWS = 20_000
BLOCK = 2_048


def learn_rotations(sample: np.ndarray, bits: int = CODE_BITS, rounds: int = 30, seed: int = 3) -> np.ndarray:
    """Projection (d x bits) by iterative quantisation: signs and the rotation that fits them
    best, in turn, on the principal directions. The rotation spreads the variance evenly over
    the bits. The cosine is about the origin, so the vectors are not centred: in a table of
    one dense cone, centred codes would tell its noise apart. Vectors with fewer dimensions
    than bits get several rotations from different starts."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    axes = np.linalg.svd(sample, full_matrices=False)[2] if len(sample) >= d else np.eye(d)
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        width = min(d, bits - sum(p.shape[1] for p in parts))
        first = axes[:d].T
        v = sample @ first
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = (u @ wt).T
        parts.append((first @ r)[:, :width])
    return np.concatenate(parts, axis=1)


def binary_codes(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """(rows, bits/64) codes as signed longs."""
    bits = (x @ projection) >= 0
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<i8")


def near_codes(codes: np.ndarray, group: np.ndarray, most: int = NEAR_BITS, cells: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j, same group) of codes that differ in at most ``most`` bits."""
    n, codes = len(codes), codes.view(np.uint64)  # of signed numbers numpy counts the absolute value
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    after = ends - np.arange(n) - 1
    sums = np.cumsum(after)
    done = 0
    while done < n:
        upto = max(done + 1, int(np.searchsorted(sums, (sums[done - 1] if done else 0) + cells, "right")))
        i = np.repeat(np.arange(done, upto), after[done:upto])
        j = i + 1 + np.arange(len(i)) - np.repeat(sums[done:upto] - after[done:upto] - (sums[done - 1] if done else 0), after[done:upto])
        apart = np.zeros(len(i), np.int64)
        for k in range(codes.shape[1]):
            apart += np.bitwise_count(codes[i, k] ^ codes[j, k])
        hit = apart <= most
        yield i[hit], j[hit]
        done = upto


def _usable(vector: str):
    """Not null or empty, and every component a finite number, one of them not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def embedding_classes(df: DataFrame, threshold: float = 0.95, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors with a cosine of ``threshold`` or more), component_id (the
    smallest vec_id reachable) and kept (vec_id is component_id), for every row.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing.
    Vectors of different length are compared with their own kind only, with rotations of their
    own. Equal vectors are one class with a number of copies before any comparison. A null vec_id
    counts as a link but is never the smallest, and is kept if its component has no other id;
    rows of equal vec_id each count. Other columns play no part, an empty table gives none.
    """
    rows = written(df.select(F.col(id_col).alias("vec_id"), F.when(_usable(vector), F.col(vector)).alias("v")), "vectors")
    classes = rows.filter("v is not null").groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    widths = sorted(r[0] for r in classes.select(F.size("v")).distinct().collect())
    found = None
    for width in widths:
        part = _linked(classes.filter(F.size("v") == width), threshold, sample_rows)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found, "verified")
    sums = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    linked = components(found.filter("b is not null").select("a", "b"))
    lowest = linked.join(classes.select("class", "first"), linked["node"] == classes["class"]).select("node", "component", "first")
    lowest = lowest.join(lowest.groupBy("component").agg(F.min("first").alias("low")), "component").select("node", "low")
    labels = classes.join(sums, F.col("class") == F.col("a"), "left").join(lowest, F.col("class") == F.col("node"), "left")
    labels = labels.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("low", "first").alias("component_id"))
    joined = rows.join(labels.withColumnRenamed("v", "w"), F.col("v") == F.col("w"), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _linked(classes: DataFrame, threshold: float, sample_rows: int) -> DataFrame:
    """(a, b, links): per class the copies it is linked with (b null), summed over rows, and a
    spanning forest of the links (links null)."""
    spark = classes.sparkSession
    sample = classes.select("v").orderBy(F.xxhash64("v"), "class").limit(sample_rows).toArrow()
    projection = learn_rotations(_unit(_matrix(sample.column(0).combine_chunks())))
    names = [f"c{k}" for k in range(CODE_BITS // 64)]

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = binary_codes(_unit(_matrix(batch.column(1))), projection)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(codes[:, k]) for k in range(codes.shape[1]))], names=["class", *names])

    codes = written(classes.select("class", "v").mapInArrow(encode, "class long, " + ", ".join(f"{c} long" for c in names)), "codes")
    distinct = written(codes.groupBy(*names).agg(F.min("class").alias("id")), "distinct")
    own = [F.shiftrightunsigned(names[(t * KEY_BITS) // 64], (t * KEY_BITS) % 64).bitwiseAND(F.lit((1 << KEY_BITS) - 1)) for t in range(TABLES)]
    keys = []
    for t, key in enumerate(own):
        keys += [F.lit(t << KEY_BITS).cast("long") + key]
        keys += [F.when(key.bitwiseAND(F.lit(1 << bit)) == 0, F.lit((t << KEY_BITS) + (1 << bit)).cast("long") + key) for bit in range(KEY_BITS)]
    filed = distinct.select(F.explode(F.array_compact(F.array(*keys))).alias("bucket"), "id", *names)
    near = components(written(bucket_edges(filed, names, near_codes), "near"))
    same = distinct.join(near, F.col("id") == F.col("node"), "left").select(*names, F.coalesce("component", "id").alias("meet"))
    placed = codes.join(same, names).select("class", "meet")
    sizes = written(placed.groupBy("meet").count().filter("count > 1").withColumn("parts", F.ceil(F.col("count") / BLOCK).cast("int")), "meetings")
    placed = placed.join(sizes, "meet").select("class", "meet", "parts")
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    met = placed.join(classes.select("class", "copies", "v"), "class").select("class", "copies", "v", "meet", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.select("meet", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "class", "copies", "v", "part")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(n, "meet", "lo", "hi").sortWithinPartitions("meet", "lo", "hi")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, ids, cols, table in _with_vectors(batches):
            copies, part, mixed_pair = cols[:, 0], cols[:, 1], cols[:, 2] != cols[:, 3]
            x = _unit(_matrix(table))
            edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            for lo, hi in zip(edges, np.r_[edges[1:], len(group)]):
                if hi - lo < 2:
                    continue
                label, links = np.arange(hi - lo), np.zeros(hi - lo, np.int64)
                for k in range(lo, hi, 1024):
                    near = (x[k : min(k + 1024, hi)] @ x[lo:hi].T) >= threshold
                    if mixed_pair[lo]:  # pairs inside a part are counted where it meets itself
                        near &= part[k : min(k + 1024, hi), None] != part[None, lo:hi]
                    near[np.arange(len(near)), np.arange(k - lo, k - lo + len(near))] = False
                    links[k - lo : k - lo + len(near)] = near @ copies[lo:hi]
                    i, j = np.nonzero(near)
                    label = local_labels(hi - lo, i + k - lo, j, label)
                own = ids[lo:hi]
                at = np.flatnonzero(links)
                yield _out(own[at], None, links[at])
                at = np.flatnonzero(label != np.arange(hi - lo))
                yield _out(own[at], own[label[at]], None)

    return met.mapInArrow(verify, "a long, b long, links long")


def _out(a: np.ndarray, b: np.ndarray | None, links: np.ndarray | None) -> pa.RecordBatch:
    empty = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(a), empty if b is None else pa.array(b), empty if links is None else pa.array(links)], names=["a", "b", "links"])


def _with_vectors(batches: Iterable[pa.RecordBatch]):
    """Whole groups with their vectors, about 20,000 rows at once."""
    vectors: list[pa.Array] = []

    def watched():
        for batch in batches:
            vectors.append(batch.column(batch.schema.names.index("v")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.names.index(c)).cast(pa.int64()) for c in ("meet", "lo", "hi", "class", "copies", "part")], names=["meet", "lo", "hi", "class", "copies", "part"]
            )

    for group, ids, cols in whole_groups(watched(), ["meet", "lo", "hi"], "class", ["copies", "part", "lo", "hi"], rows=20_000):
        held = pa.concat_arrays(vectors)
        yield group, ids, cols, held.slice(0, len(group))
        vectors[:] = [held.slice(len(group))]

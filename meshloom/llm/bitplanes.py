"""Clustering around centroids with distances from counted bits.

A vector of whole numbers is stored as bit planes: plane j holds bit j (two's complement) of
all components, 64 components to one unsigned 64-bit word. The product of two vectors is

    sum over planes i, j of  w(i) * w(j) * popcount(plane_i AND plane_j),

with weight 2**j for plane j and -2**(b-1) for the last, so products, squared norms and
squared distances are exact. A centroid's new components come from the same planes: bits of
one place counted over a cluster's vectors.

The packed vectors are written once; each round is one pass over them whose tasks return at
most one row of sums per centroid, so what meets in the driver is k rows whatever the input.
A hot cluster costs no more than any other, since nothing is exchanged by cluster but those rows.

Start: the k vectors with the smallest SHA-256 of ``3:<vec_id>``; a null id counts as the
empty text, equal ids are ordered by their components. With fewer than k vectors each one
starts a centroid; an empty table gives an empty result. Vectors that are null, of another
width, or hold a null or non-finite component take no part, nor do those with a component
of 2**27 or more after scaling, whose squared distances would not fit a long. Repeated rows
count as often as they appear. Ties go to the smaller centroid; a centroid that loses all
vectors stays where it is. A sum of distances beyond a long is null. Texts play no part, and
further columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.shared import cut_lineage, table

CENTROIDS = 8
ROUNDS = 10
WIDTH = 64
SCALE = 1024.0
LIMIT = 2.0**27
WORD_BITS = 64


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", width: int = WIDTH, scale: float = SCALE) -> DataFrame:
    """vec_id and v, the whole numbers floor(scale * x), for the vectors that take part."""
    x = F.col(vector)
    fits = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) * scale < F.lit(LIMIT)))
    return vectors.filter(x.isNotNull() & (F.size(x) == width) & fits).select(
        F.col(vec_id).alias("vec_id"),
        F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(scale)).cast("long")).alias("v"),
    )


def weights(planes: int) -> np.ndarray:
    """What each plane of a two's complement number counts for."""
    out = np.left_shift(np.int64(1), np.arange(planes, dtype=np.int64))
    out[-1] = -out[-1]
    return out


def to_planes(values: np.ndarray, planes: int) -> np.ndarray:
    """Rows of whole numbers as an array (rows, words, planes) of unsigned 64-bit words."""
    rows, width = values.shape
    words = -(-width // WORD_BITS)
    padded = np.zeros((rows, words * WORD_BITS), np.int64)
    padded[:, :width] = values
    out = np.empty((rows, words, planes), np.uint64)
    for j in range(planes):
        bits = ((padded >> j) & 1).astype(np.uint8)
        out[:, :, j] = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(rows, words)
    return out


def products(planes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact products of every row of ``planes`` with one vector given as (words, planes)."""
    each = weights(planes.shape[2])
    total = np.zeros(len(planes), np.int64)
    for word in range(planes.shape[1]):
        for j, weight in enumerate(each.tolist()):
            common = np.bitwise_count(planes[:, word, :] & other[word, j])
            total += weight * (common.astype(np.int64) @ each)
    return total


def norms(planes: np.ndarray) -> np.ndarray:
    """Squared lengths of the rows."""
    each = weights(planes.shape[2])
    total = np.zeros(len(planes), np.int64)
    for word in range(planes.shape[1]):
        for j, weight in enumerate(each.tolist()):
            common = np.bitwise_count(planes[:, word, :] & planes[:, word, j : j + 1])
            total += weight * (common.astype(np.int64) @ each)
    return total


def nearest(planes: np.ndarray, lengths: np.ndarray, centroids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to each row's nearest centroid."""
    squares = np.stack([lengths + own[c] - 2 * products(planes, centroids[c]) for c in range(len(centroids))])
    number = squares.argmin(axis=0)
    return number, squares[number, np.arange(len(planes))]


def component_sums(planes: np.ndarray, width: int) -> np.ndarray:
    """Sums of each component over the rows, by counting bits of one place."""
    rows, words, count = planes.shape
    as_bytes = np.ascontiguousarray(planes).astype("<u8").view(np.uint8).reshape(rows, words * count * 8)
    bits = np.unpackbits(as_bytes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return (weights(count) @ bits.reshape(words, count, WORD_BITS)).reshape(-1)[:width]


def _block(batch: pa.RecordBatch, words: int, planes: int) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join(batch.column("planes").to_pylist())
    return np.frombuffer(raw, "<u8").reshape(batch.num_rows, words, planes), batch.column("length").to_numpy()


def packed(vectors: DataFrame, width: int, planes: int) -> DataFrame:
    """vec_id, planes (binary) and length (squared) of a (vec_id, v) table."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, width)
            rows = to_planes(values, planes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in rows.astype("<u8")], pa.binary()), pa.array(norms(rows))],
                names=["vec_id", "planes", "length"],
            )

    return vectors.select("vec_id", "v").mapInArrow(pack, f"vec_id {kind}, planes binary, length long")


def first_centroids(vectors: DataFrame, k: int) -> list[list[int]]:
    """The components of the k vectors with the smallest hashes."""
    name = F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [list(r["v"]) for r in vectors.select("v", F.sha2(name, 256).alias("hash")).orderBy("hash", "v").limit(k).collect()]


def moved(rows: DataFrame, centroids: list[list[int]], planes: int, width: int) -> list[list[int]]:
    """The centroids after one round over the packed table."""
    words = -(-width // WORD_BITS)
    targets = to_planes(np.array(centroids, np.int64), planes)
    own = norms(targets)

    def gather(batches):
        count = np.zeros(len(targets), np.int64)
        sums = np.zeros((len(targets), width), np.int64)
        for batch in batches:
            block, lengths = _block(batch, words, planes)
            number, _ = nearest(block, lengths, targets, own)
            for c in np.unique(number).tolist():
                some = block[number == c]
                count[c] += len(some)
                sums[c] += component_sums(some, width)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array(count[full]), pa.array(sums[full].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    parts = rows.mapInArrow(gather, "cluster int, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(width)))
    out = [list(c) for c in centroids]
    for row in totals.collect():  # at most one row per centroid
        out[row["cluster"]] = [row[f"s{d}"] // row["n"] for d in range(width)]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster and distance of every row of a (vec_id, v) table, and the centroids."""
    most = vectors.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0] or 0
    planes = int(most).bit_length() + 1
    rows = cut_lineage(packed(vectors, width, planes))
    centroids = first_centroids(vectors, k)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    for _ in range(rounds if centroids else 0):
        centroids = moved(rows, centroids, planes, width)
    words = -(-width // WORD_BITS)
    targets = to_planes(np.array(centroids, np.int64).reshape(len(centroids), width), planes)
    own = norms(targets)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            number, distance = nearest(*_block(batch, words, planes), targets, own)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return rows.mapInArrow(place, f"vec_id {kind}, cluster int, distance long"), centroids


def _long(value: int) -> int | None:
    return value if value < 2**63 else None


def with_inertia(placed: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256 to rows of (cluster, distance)."""
    placed = cut_lineage(placed)
    sums = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = _long(sum(sums.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    found = [(c, _long(sums.get(c, 0)), whole, digest) for c, digest in enumerate(digests)]
    known = placed.sparkSession.createDataFrame(found, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row per centroid.
    return placed.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clusters(spark, sf_dir):
    return with_inertia(*cluster(whole_vectors(table(spark, sf_dir, "embeddings"))))


def _oracle(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    floor_mean = "(s - ((s % n) + n) % n) // n"
    steps = [
        """WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x) AND abs(x::DOUBLE) * 1024 < 134217728)) = 64
)""",
        f"""c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS cluster, v AS c
  FROM (SELECT v, sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v ORDER BY h, v LIMIT {k})
)""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min_by(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT r, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i})
  GROUP BY r
)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT cluster, list({floor_mean} ORDER BY d)::BIGINT[] AS c
  FROM (SELECT cluster, d, sum(x)::BIGINT AS s, count(*) AS n
        FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM a{i} JOIN v USING (r)) GROUP BY cluster, d)
  GROUP BY cluster
), c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return (
        ",\n".join(steps)
        + f"""
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (cluster)
"""
    )


ORACLE = _oracle()

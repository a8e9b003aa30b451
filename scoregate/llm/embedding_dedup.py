"""Near-duplicate embeddings by product quantisation.

Method: a coarse quantiser deals the unit vectors into inverted lists; each vector's residual is coded in SUBSPACES
subspaces, and the length of what the code misses is kept beside it. A query probes every list that can hold a partner: a
partner x within distance r of q lies in the cell of centroid c only if (|q-c|^2 - |q-c0|^2) / (2 |c-c0|) <= r, c0 being
the query's own centroid, and only if |q-c| <= r + the distance from c of the farthest entry of the query's label in the cell
(and so only where the label has one). From COARSE lists on, each is cut again by centroids of the residuals, to which the
same bound applies, so that lists stay at about PER_LIST entries up to half a thousand million vectors of a label. In a list, asymmetric distances from lookup tables drop every entry whose coded distance exceeds
r plus what its code misses, which can't be a partner; the exact cosine in double precision decides the rest. Both bounds
hold for any centroids and codebooks, so no link is lost, whatever sample they were fitted on: recall is 1.

Quantiser and codebooks are fitted on at most SAMPLE vectors (a documented bound); every vector is indexed and is a query.
Equal vectors of a label are one entry with a multiplicity. Probes carry ids until the bounds have dropped what they can;
the rest fetch their vectors once for BLOCK // PER_LIST lists that lie together. These are compared in blocks of BLOCK entries
by BLOCK queries; a block gives each query's number of links and a spanning forest of its links, never all pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those of a null label, link
with nothing; vectors of different lengths never link; a row repeated links with its copy, and component_id is the smallest
non-null vec_id; further columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from scoregate.llm.common import Scratch, connected_components, ship, slices

COSINE = 0.98
SAMPLE, PER_LIST, COARSE, FINE = 20_000, 512, 1024, 1024
SUBSPACES, CODES, ROUNDS = 8, 64, 8
BLOCK, QUERIES_AT_ONCE, PROBES_AT_ONCE = 8192, 256, 4096
_SLACK = 1e-6


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)


def _centres(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from evenly spaced starting rows; an empty cell keeps its centre."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = _squares(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class Index:
    """The centres of the lists and the codebooks of the residuals, for vectors of one length. A list's number is its coarse
    centre's times the number of fine centres, plus its fine centre's."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = _centres(sample, max(1, min(COARSE, lists)))
        rest = sample - self.coarse[_squares(sample, self.coarse).argmin(1)]
        cuts = min(FINE, -(-lists // COARSE))
        self.fine = _centres(rest, cuts) if cuts > 1 else np.zeros((1, sample.shape[1]))
        rest = rest - self.fine[_squares(rest, self.fine).argmin(1)]
        self.cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.books = [_centres(rest[:, s], CODES) for s in self.cuts]
        self.between = [np.sqrt(_squares(c, c)) for c in (self.coarse, self.fine)]

    def centre(self, listed: np.ndarray | int) -> np.ndarray:
        return self.coarse[listed // len(self.fine)] + self.fine[listed % len(self.fine)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, distance to its centre, codes and the length that the code misses, of unit vectors."""
        own = _squares(x, self.coarse).argmin(1)
        listed = own * len(self.fine) + _squares(x - self.coarse[own], self.fine).argmin(1)
        residual = x - self.centre(listed)
        parts = list(zip(self.cuts, self.books, strict=True))
        codes = np.stack([_squares(residual[:, s], b).argmin(1) for s, b in parts], 1).astype(np.uint8)
        missed = np.sqrt(sum(((residual[:, s] - b[codes[:, m]]) ** 2).sum(1) for m, (s, b) in enumerate(parts)))
        return listed, np.sqrt((residual**2).sum(1)), codes, missed

    def _in_reach(self, x: np.ndarray, level: int, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, centre, distance) of each cell of a level that may hold a vector within the radius of x's row."""
        d = _squares(x, (self.coarse, self.fine)[level])
        own = d.argmin(1)
        near = d - d[np.arange(len(x)), own][:, None] <= 2 * (radius + _SLACK) * self.between[level][own] + _SLACK
        row, cell = np.nonzero(near)
        return row, cell, np.sqrt(d[row, cell])

    def probes(self, x: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, list, distance to its centre) of each list that may hold a vector within the radius, some rows at a time."""
        row, cell, away = self._in_reach(x, 0, radius)
        if len(self.fine) == 1:
            yield row, cell, away
            return
        for a in range(0, len(row), PROBES_AT_ONCE):
            r, c = row[a : a + PROBES_AT_ONCE], cell[a : a + PROBES_AT_ONCE]
            again, inner, away = self._in_reach(x[r] - self.coarse[c], 1, radius)
            yield r[again], c[again] * len(self.fine) + inner, away

    def table_distances(self, q: np.ndarray, listed: int, codes: np.ndarray) -> np.ndarray:
        """Distances of the queries to the coded entries of one list: sums of lookups."""
        residual = q - self.centre(listed)
        total = np.zeros((len(q), len(codes)))
        for m, (s, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            total += _squares(residual[:, s], b)[:, codes[:, m]]
        return np.sqrt(total)


def _matrix(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _usable(label, vector):
    """Whether a row can link at all."""
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & real & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label)."""
    spark = embeddings.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("vector"))
    rows = rows.withColumn("usable", _usable(F.col("label"), F.col("vector")))
    rows = rows.withColumn("node", F.when(F.col("usable"), F.xxhash64("label", "vector")))
    entries = rows.where("usable").groupBy("node", "label", "vector").agg(F.count(F.lit(1)).alias("copies"))
    entries = scratch.table(entries.withColumn("length", F.size("vector")), "entries")
    # Lists are shared by the labels; their number follows the largest label, so that its lists hold about PER_LIST entries.
    lengths = entries.groupBy("length", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("length").agg(F.max("n").alias("n")).collect()
    indexes = {}
    for row in lengths:
        some = entries.where(F.col("length") == row["length"]).orderBy("node").limit(sample).select("vector").toArrow()
        indexes[row["length"]] = Index(_matrix(some["vector"].combine_chunks()), row["n"] // PER_LIST)
    shared = spark.sparkContext.broadcast(indexes)

    fields = [("node", pa.int64()), ("label_text", pa.string()), ("length", pa.int64()), ("list", pa.int64())]
    fields += [("query", pa.bool_()), ("codes", pa.binary()), ("missed", pa.float64()), ("away", pa.float64())]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An entry row for the vector's own list and a query row for each list that it probes, without the vectors."""
        for batch in slices(batches):
            lengths = batch.column(3).to_numpy()
            for length in np.unique(lengths):
                own = batch.filter(pa.array(lengths == length))
                ids = [own.column(0), own.column(2), own.column(3)]
                index = shared.value[int(length)]
                x = _matrix(own.column(1))
                listed, away, codes, missed = index.encode(x)
                coded = pa.array([c.tobytes() for c in codes], pa.binary())
                columns = [*ids, pa.array(listed), pa.array(np.zeros(len(x), bool)), coded, pa.array(missed), pa.array(away)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))
                for row, probed, away in index.probes(x, radius):
                    none = [pa.nulls(len(row), pa.binary()), pa.nulls(len(row), pa.float64())]
                    columns = [c.take(pa.array(row)) for c in ids]
                    columns += [pa.array(probed), pa.array(np.ones(len(row), bool)), *none, pa.array(away)]
                    yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    read = entries.select("node", "vector", F.col("label").cast("string").alias("label_text"), F.col("length").cast("long"))
    dealt = read.mapInArrow(
        deal, "node long, label_text string, length long, list long, query boolean, codes binary, missed double, away double"
    )
    dealt = scratch.table(dealt, "dealt")
    # Probes that reach no entry of their label go; those of lists that lie together become one row.
    key = ["label_text", "length", "list"]
    reach = dealt.where(~F.col("query")).groupBy(*key).agg(F.max("away").alias("reach"))
    asking = dealt.where("query").join(reach, key).where(F.col("away") <= F.col("reach") + radius + _SLACK)
    part = F.expr(f"list div {max(1, BLOCK // PER_LIST)}").alias("part")
    asking = asking.groupBy("node", "label_text", "length", part).agg(F.collect_list("list").alias("lists"))
    asking = asking.withColumns({"query": F.lit(True), "codes": F.lit(None).cast("binary"), "missed": F.lit(None).cast("double")})
    told = dealt.where(~F.col("query")).select("node", "label_text", "length", part, F.array("list").alias("lists"), "query", "codes", "missed")
    met = scratch.table(told.unionByName(asking), "met")
    scratch.drop(dealt)
    place = ["label_text", "length", "part"]
    blocks = met.groupBy(*place).agg(
        F.ceil(F.count_if(~F.col("query")) / BLOCK).alias("entry_blocks"), F.ceil(F.count_if("query") / BLOCK).alias("query_blocks")
    )
    own, other = (F.when(F.col("query"), F.col(a)).otherwise(F.col(b)) for a, b in (("query_blocks", "entry_blocks"), ("entry_blocks", "query_blocks")))
    placed = met.join(blocks, place).withColumns({"mine": F.pmod(F.xxhash64("node"), own), "others": other})
    placed = placed.drop("entry_blocks", "query_blocks").join(entries.select("node", "vector", "copies"), "node")
    placed = placed.withColumn("theirs", F.explode(F.when(F.col("others") > 0, F.sequence(F.lit(0).cast("long"), F.col("others") - 1))))
    entry_block = F.when(F.col("query"), F.col("theirs")).otherwise(F.col("mine")).alias("entry_block")
    query_block = F.when(F.col("query"), F.col("mine")).otherwise(F.col("theirs")).alias("query_block")
    placed = placed.select(*place, entry_block, query_block, "node", "vector", "copies", "lists", "query", "codes", "missed")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        is_query = group["query"].to_numpy()
        e, q = group.filter(pa.array(~is_query)), group.filter(pa.array(is_query))
        nodes, links, roots = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if e.num_rows and q.num_rows:
            index = shared.value[e["length"][0].as_py()]
            all_x, all_copies, all_e = _matrix(e["vector"].combine_chunks()), e["copies"].to_numpy(), e["node"].to_numpy()
            all_missed = e["missed"].to_numpy()
            all_codes = np.frombuffer(b"".join(e["codes"].to_pylist()), np.uint8).reshape(e.num_rows, -1)
            listed, asked = e["lists"].combine_chunks().flatten().to_numpy(), q["lists"].combine_chunks()
            asker, asked = np.repeat(np.arange(q.num_rows), asked.value_lengths().to_numpy()), asked.flatten().to_numpy()
            all_q, all_node = _matrix(q["vector"].combine_chunks()), q["node"].to_numpy()
            for at in np.unique(listed):
                own, askers = listed == at, asker[asked == at]
                x, copies, e_node, missed, codes = all_x[own], all_copies[own], all_e[own], all_missed[own], all_codes[own]
                for a in range(0, len(askers), QUERIES_AT_ONCE):
                    some = askers[a : a + QUERIES_AT_ONCE]
                    y, node = all_q[some], all_node[some]
                    near = index.table_distances(y, int(at), codes) <= radius + missed[None] + _SLACK
                    near &= node[:, None] != e_node[None]
                    some = near.any(1)
                    if not some.any():
                        continue
                    y, node, near = y[some], node[some], near[some]
                    linked = near & (y @ x.T >= cosine)
                    n = linked @ copies
                    some = n > 0
                    linked, node, n = linked[some], node[some], n[some]
                    if len(node):
                        label = _forest(linked, node, e_node)
                        nodes += [node, e_node[linked.any(0)]]
                        links += [n, np.zeros(int(linked.any(0).sum()), np.int64)]
                        roots += [label[0], label[1][linked.any(0)]]
        return pa.table({"node": np.concatenate(nodes), "links": np.concatenate(links), "root": np.concatenate(roots)})

    found = placed.groupBy(*place, "entry_block", "query_block").applyInArrow(compare, "node long, links long, root long")
    found = scratch.table(found, "found")
    scratch.drop(met)
    components = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")), scratch)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = entries.select("node", "copies").join(links, "node", "left").join(components, "node", "left").select(
        "node", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")
    )
    out = rows.select("vec_id", "node").join(known, "node", "left")
    least = out.where("node is not null").groupBy("root").agg(F.min("vec_id").alias("least"))
    out = out.join(least, "root", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select(
        "vec_id",
        F.when(F.col("node").isNull(), F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest node that each row and each column reaches through the links of one block."""
    most = np.iinfo(np.int64).max
    a, b = left.copy(), np.full(len(right), most)
    while True:
        b_next = np.minimum(b, np.where(linked, a[:, None], most).min(0))
        b_next = np.where(linked.any(0), np.minimum(b_next, right), b_next)
        a_next = np.minimum(a, np.where(linked, b_next[None], most).min(1))
        if np.array_equal(a, a_next) and np.array_equal(b, b_next):
            return a, b
        a, b = a_next, b_next

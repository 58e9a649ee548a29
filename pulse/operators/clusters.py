"""K-means from several starts at once: one scan a round moves the centres of all of them.

A start is what `pyspark.ml`'s `KMeans(k, seed)` does: k-means|| with the same draws on the same
partitions, Lloyd's rounds until no centre moves by more than `TOLERANCE`, `MAX_ROUNDS` at most,
and the cost of the last round. There each start scans the vectors some 14 times on its own.
"""

import json
import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Spark's defaults
MAX_ROUNDS = 20
INIT_STEPS = 2
TOLERANCE = 1e-4
#: Numbers that a block of rows fills at once; more leave the processor's cache.
BLOCK_NUMBERS = 1 << 18
#: Rows with more than this share of the features are multiplied as a dense matrix.
DENSE = 0.02
#: Squared distances below are those of equal vectors: unit vectors cannot be told apart by their products there.
EQUAL = 1e-12
_MASK = (1 << 64) - 1


@dataclass
class Clustering:
    """Centres (cluster by feature) and cost of the best start."""

    centres: np.ndarray
    cost: float
    start: int


def _hashed(seed: int) -> int:
    """The first state of Spark's `XORShiftRandom`: MurmurHash3 of the seed's bytes, twice."""
    words = [int.from_bytes((seed & _MASK).to_bytes(8, "big")[i : i + 4], "little") for i in (0, 4)]

    def murmur(h):
        for k in words:
            k = k * 0xCC9E2D51 & 0xFFFFFFFF
            k = (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
            h ^= k
            h = ((h << 13 | h >> 19) & 0xFFFFFFFF) * 5 + 0xE6546B64 & 0xFFFFFFFF
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    low = murmur(0x3C074A61)
    return murmur(low) << 32 | low


def _after(state):
    """The state after `state`, a number or an array of them."""
    state = state ^ (state << 21 & _MASK)
    state ^= state >> 35
    return state ^ (state << 4 & _MASK)


def _draws(seed: int):
    """Doubles that `XORShiftRandom(seed)` draws one after another."""
    state = _hashed(seed)
    while True:
        high = _after(state)
        state = _after(high)
        yield (((high & (1 << 26) - 1) << 27) + (state & (1 << 27) - 1)) * 2.0**-53


def _signed(value: int, bits: int) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> bits - 1 else value


class _Stream:
    """`_draws` in blocks. A step is linear in the bits of the state, so a block comes from the one before by tables."""

    BLOCK = 1 << 13

    def __init__(self, tables: list, state: int):
        self.tables, self.state = tables, np.array([state], np.uint64)
        self.rest = np.empty(0)

    @staticmethod
    def jumps() -> list:
        """Tables of the jumps by 1, 2, 4, ... states, up to two blocks."""
        bits = [_after(1 << i) for i in range(64)]
        tables = []
        for _ in range(_Stream.BLOCK.bit_length() + 1):
            table = np.zeros((8, 256), np.uint64)
            for byte in range(8):
                for value in range(1, 256):
                    low = value & -value
                    table[byte, value] = table[byte, value ^ low] ^ np.uint64(bits[8 * byte + low.bit_length() - 1])
            tables.append(table)
            bits = [int(x) for x in _Stream.jump(table, np.array(bits, np.uint64))]
        return tables

    @staticmethod
    def jump(table, states):
        parts = states.view(np.uint8).reshape(-1, 8)  # little-endian
        found = table[0][parts[:, 0]]
        for byte in range(1, 8):
            found ^= table[byte][parts[:, byte]]
        return found

    def take(self, n: int) -> np.ndarray:
        parts = [self.rest]
        have = len(self.rest)
        while have < n:
            if len(self.state) == 1:  # the states after the first one
                states = self.jump(self.tables[0], self.state)
                for table in self.tables[:-1]:
                    states = np.append(states, self.jump(table, states))
                self.state = states
            else:
                self.state = self.jump(self.tables[-1], self.state)
            high, low = self.state[::2] & np.uint64((1 << 26) - 1), self.state[1::2] & np.uint64((1 << 27) - 1)
            parts.append(((high << np.uint64(27)) + low).astype(np.float64) * 2.0**-53)
            have += len(high)
        drawn = np.concatenate(parts)
        self.rest = drawn[n:]
        return drawn[:n]


class _Rows:
    """Sparse vectors of a batch."""

    def __init__(self, indices: pa.Array, values: pa.Array):
        self.sizes = indices.value_lengths().to_numpy()
        self.indices = indices.flatten().to_numpy()
        self.values = values.flatten().to_numpy()
        self.ends = np.cumsum(self.sizes)
        # Summed one by one and by way of the norm, as Spark does: vectors without a common feature are all equally far but for the last bit.
        owners = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.squares = np.sqrt(np.bincount(owners, self.values * self.values, len(self.sizes))) ** 2

    def __len__(self):
        return len(self.sizes)

    def _sums(self, products, begin=0, stop=None):
        """Sums of `products` by row of `begin` to `stop`."""
        sizes = self.sizes[begin:stop]
        sums = np.zeros((len(sizes), *products.shape[1:]))
        full = sizes > 0
        if full.any():
            starts = np.cumsum(sizes) - sizes
            sums[full] = np.add.reduceat(products, starts[full], axis=0)
        return sums

    def blocks(self, centres: int, width: int):
        """(begin, stop, dense) of blocks of rows, one row at least, that are multiplied at once."""
        if len(self.indices) > DENSE * width * len(self):
            rows = max(1, BLOCK_NUMBERS // max(width, centres))
            for begin in range(0, len(self), rows):
                yield begin, min(begin + rows, len(self)), True
            return
        limit, begin = max(1, BLOCK_NUMBERS // centres), 0
        while begin < len(self):
            before = self.ends[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(self.ends, before + limit, "right")))
            stop = min(stop, begin + limit)  # rows without values take room too
            yield begin, stop, False
            begin = stop

    def products(self, matrix: np.ndarray, begin: int, stop: int, dense: bool) -> np.ndarray:
        """Products of rows with `matrix` (feature by centre)."""
        part = slice(self.ends[begin] - self.sizes[begin], self.ends[stop - 1])
        if not dense:
            products = matrix[self.indices[part]]
            products *= self.values[part, None]
            return self._sums(products, begin, stop)
        block = np.zeros((stop - begin, len(matrix)))
        block[np.repeat(np.arange(stop - begin), self.sizes[begin:stop]), self.indices[part]] = self.values[part]
        return block @ matrix


class _Centres:
    """Centres of several starts side by side; start `s` has those from `borders[s]` to `borders[s + 1]`."""

    def __init__(self, centres: list):
        self.borders = np.cumsum([0, *map(len, centres)]).tolist()
        self.matrix = np.ascontiguousarray(np.concatenate(centres).T)
        self.squares = np.sqrt((self.matrix * self.matrix).cumsum(axis=0)[-1]) ** 2

    def closest(self, rows: _Rows):
        """(begin, stop, nearest centre within its start, squared distance) of blocks of rows, both by start."""
        for begin, stop, dense in rows.blocks(self.matrix.shape[1], len(self.matrix)):
            distances = self.squares + rows.squares[begin:stop, None]
            distances -= 2.0 * rows.products(self.matrix, begin, stop, dense)
            distances[distances < EQUAL] = 0.0
            ranges = [distances[:, low:high] for low, high in zip(self.borders, self.borders[1:])]
            nearest = [part.argmin(axis=1) for part in ranges]
            yield begin, stop, nearest, [part[np.arange(len(part)), at] for part, at in zip(ranges, nearest)]


def _vectors(df: DataFrame, features: str, *columns: str) -> DataFrame:
    vector = F.unwrap_udt(features)
    size, given = vector["size"], vector["values"]
    # a dense vector has no indices
    places = F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(given) - 1))
    return df.select(places.alias("_indices"), given.alias("_values"), F.coalesce(size, F.size(given)).alias("_size"), *columns)


def _rows(batches):
    for batch in batches:
        yield batch, _Rows(batch.column(0), batch.column(1))


def _partition() -> int:
    return TaskContext.get().partitionId()


def _numbers(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("start", pa.int32()), ("value", pa.float64())]))


def _totals(vectors: DataFrame, count) -> np.ndarray:
    """Sums by start of what `count` gives for rows: an array by start."""

    def add(batches):
        total = 0.0
        for _, rows in _rows(batches):
            total = total + count(rows)
        if np.ndim(total):
            yield _numbers([{"start": i, "value": float(x)} for i, x in enumerate(total)])

    found = vectors.mapInArrow(add, "start int, value double").groupBy("start").agg(F.sum("value")).orderBy("start")
    return np.array([value for _, value in found.collect()])


_POINT = "start int, partition int, place long, indices array<int>, values array<double>"


def _points(vectors: DataFrame, width: int, wanted) -> list:
    """Vectors that `wanted` names, for each start in their order. `wanted()` is a function of rows to arrays of places by start."""

    def pick(batches):
        choose, before, partition = wanted(_partition()), 0, _partition()
        for _, rows in _rows(batches):
            found = []
            for start, places in enumerate(choose(rows, before)):
                for place in places.tolist():
                    part = slice(rows.ends[place] - rows.sizes[place], rows.ends[place])
                    found.append((start, partition, before + place, rows.indices[part], rows.values[part]))
            before += len(rows)
            if found:
                types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()))
                columns = [pa.array(values, kind) for values, kind in zip(zip(*found), types)]
                yield pa.RecordBatch.from_arrays(columns, ["start", "partition", "place", "indices", "values"])

    points = {}
    for start, _, _, indices, values in vectors.mapInArrow(pick, _POINT).orderBy("start", "partition", "place").collect():
        point = np.zeros(width)
        point[indices] = values
        points.setdefault(start, []).append(point)
    return points


def _first_places(counts: list, seed: int, random) -> tuple:
    """(partition, place) of the row that `takeSample(False, 1, seed)` takes of partitions of `counts` rows."""
    n, rand = sum(counts), random(seed)
    gamma = -math.log(1e-4) / n
    fraction = min(1.0, max(1e-10, 1.0 / n + gamma + math.sqrt(gamma * gamma + 2.0 * gamma / n)))
    sample = []
    while not sample:
        seeds = random(rand.nextInt())
        for partition, count in enumerate(counts):
            draws = _draws(seeds.nextLong())
            if fraction >= 1.0:
                places = range(count)
            elif fraction > 0.4:
                places = [place for place in range(count) if next(draws) <= fraction]
            else:
                places, place, log = [], -1, math.log1p(-fraction)
                while True:
                    place += 1 + int(math.log(max(next(draws), 5e-11)) / log)
                    if place >= count:
                        break
                    places.append(place)
            sample += [(partition, place) for place in places]
    for i in range(len(sample) - 1, 0, -1):
        j = rand.nextInt(i + 1)
        sample[i], sample[j] = sample[j], sample[i]
    return sample[0]


def _distinct(points: list) -> np.ndarray:
    return np.array(list({point.tobytes(): point for point in points}.values()))


def _few(spark, candidates: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The `k` centres that Spark's own weighted k-means++ makes of the candidates."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    of, vectors = jvm.org.apache.spark.mllib.clustering, jvm.org.apache.spark.mllib.linalg.Vectors
    points = gateway.new_array(of.VectorWithNorm, len(candidates))
    shares = gateway.new_array(jvm.double, len(candidates))
    for i, candidate in enumerate(candidates):
        # as JSON: each value of an array would be a call of its own
        points[i] = of.VectorWithNorm(vectors.fromJson(json.dumps({"type": 1, "values": candidate.tolist()})))
        shares[i] = float(weights[i])
    chosen = of.LocalKMeans.kMeansPlusPlus(0, points, shares, k, 30)
    return np.array([json.loads(point.vector().toDense().toJson())["values"] for point in chosen])


def _first_centres(spark, vectors: DataFrame, width: int, k: int, seeds: list) -> list:
    """Centres of each start by k-means||."""
    def sizes(batches):
        count = sum(batch.num_rows for batch in batches)
        yield _numbers([{"start": _partition(), "value": float(count)}])

    found = {partition: int(n) for partition, n in vectors.mapInArrow(sizes, "start int, value double").collect()}
    counts = [found.get(partition, 0) for partition in range(max(found) + 1)]
    seeds = [_signed(_after(_hashed(seed)), 32) for seed in seeds]
    places = [_first_places(counts, seed, spark._jvm.java.util.Random) for seed in seeds]

    def first(partition):
        def choose(rows, before):
            for at, place in places:
                inside = at == partition and before <= place < before + len(rows)
                yield np.array([place - before] if inside else [], np.int64)

        return choose

    points = _points(vectors, width, first)
    chosen = [points[start] for start in range(len(seeds))]
    tables = _Stream.jumps()
    for step in range(INIT_STEPS):
        centres = _Centres([np.array(points) for points in chosen])

        def costs(rows, centres=centres):
            return sum(np.array([cost.sum() for cost in costs]) for *_, costs in centres.closest(rows))

        totals = _totals(vectors, costs)

        def near(partition, centres=centres, totals=totals, step=step):
            streams = [_Stream(tables, _hashed(seed ^ step << 16 ^ partition)) for seed in seeds]

            def choose(rows, before):
                drawn, taken = [stream.take(len(rows)) for stream in streams], [[] for _ in streams]
                for begin, stop, _, costs in centres.closest(rows):
                    for start, cost in enumerate(costs):
                        if totals[start] > 0.0:
                            hit = drawn[start][begin:stop] < 2.0 * cost * k / totals[start]
                            taken[start].append(begin + np.flatnonzero(hit))
                return [np.concatenate(places) if places else np.empty(0, np.int64) for places in taken]

            return choose

        for start, points in _points(vectors, width, near).items():
            chosen[start] = chosen[start] + points
    chosen = [_distinct(points) for points in chosen]
    many = [start for start, points in enumerate(chosen) if len(points) > k]
    if many:
        centres = _Centres([chosen[start] for start in many])

        def uses(rows):
            found = np.zeros(centres.borders[-1])
            for _, _, nearest, _ in centres.closest(rows):
                for low, at in zip(centres.borders, nearest):
                    np.add.at(found, low + at, 1.0)
            return found

        weights = _totals(vectors, uses)
        for i, start in enumerate(many):
            chosen[start] = _few(spark, chosen[start], weights[centres.borders[i] : centres.borders[i + 1]], k)
    return chosen


_PART = pa.schema([("cluster", pa.int32()), ("n", pa.float64()), ("cost", pa.float64()), ("sums", pa.binary())])


def _moved(vectors: DataFrame, centres: list) -> tuple:
    """A round of Lloyd's: the centres after it, and the cost of each start before it."""
    held = _Centres(centres)
    many, width = held.borders[-1], held.matrix.shape[0]

    def assign(batches):
        sums, n, cost = np.zeros(many * width), np.zeros(many), np.zeros(many)
        for _, rows in _rows(batches):
            parts = [[] for _ in centres]
            for _, _, nearest, costs in held.closest(rows):
                for start, (low, at, found) in enumerate(zip(held.borders, nearest, costs)):
                    parts[start].append(low + at)
                    cost[low] += found.sum()
            for clusters in parts:
                if clusters:
                    at = np.concatenate(clusters)
                    low, high = int(at.min()), int(at.max()) + 1
                    n += np.bincount(at, minlength=many)
                    places = np.repeat(at - low, rows.sizes) * width + rows.indices
                    sums[low * width : high * width] += np.bincount(places, rows.values, (high - low) * width)
        for cluster in np.flatnonzero((n > 0) | (cost > 0)).tolist():
            part = sums[cluster * width : (cluster + 1) * width].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((cluster, n[cluster], cost[cluster], part), _PART)], schema=_PART)

    def add(batches):
        whole = {}
        for batch in batches:
            for row in batch.to_pylist():
                old = whole.setdefault(row["cluster"], [0.0, 0.0, np.zeros(width)])
                old[0] += row["n"]
                old[1] += row["cost"]
                old[2] += np.frombuffer(row["sums"])
        for cluster, (n, cost, sums) in whole.items():
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((cluster, n, cost, sums.tobytes()), _PART)], schema=_PART)

    layout = "cluster int, n double, cost double, sums binary"
    parts = vectors.mapInArrow(assign, layout).repartition("cluster").mapInArrow(add, layout)
    moved, costs = [part.copy() for part in centres], np.zeros(len(centres))
    for cluster, n, cost, sums in parts.collect():
        start = int(np.searchsorted(held.borders, cluster, "right")) - 1
        costs[start] += cost
        if n:  # a cluster without rows stays where it is
            moved[start][cluster - held.borders[start]] = np.frombuffer(bytes(sums)) / n
    return moved, costs


def best_clustering(df: DataFrame, k: int, seeds: list, features: str = "features") -> Clustering:
    """The tightest clustering of the vectors in `features`, of one start for each seed; of equal ones the first.

    `df` must be persisted: each round reads its vectors, and the draws go by its partitions.
    """
    if k < 2:
        raise IllegalArgumentException(f"k must be 2 or more: {k}")
    spark, vectors = df.sparkSession, _vectors(df, features)
    width = vectors.select("_size").first()[0]
    vectors = vectors.drop("_size")
    centres = _first_centres(spark, vectors, width, k, seeds)
    costs, active = np.zeros(len(seeds)), list(range(len(seeds)))
    for _ in range(MAX_ROUNDS):
        if not active:
            break
        moved, found = _moved(vectors, [centres[start] for start in active])
        still = []
        for start, after, cost in zip(active, moved, found):
            far = ((after - centres[start]) ** 2).sum(axis=1) > TOLERANCE**2
            centres[start], costs[start] = after, cost
            if far.any():
                still.append(start)
        active = still
    best = min(range(len(seeds)), key=lambda start: (float(f"{costs[start]:.10g}"), start))
    return Clustering(centres[best], float(costs[best]), best)


def assigned(df: DataFrame, clustering: Clustering, key: str, into: str, features: str = "features") -> DataFrame:
    """(key, cluster) of each row."""
    centres = _Centres([clustering.centres])

    def nearest(batches):
        for batch, rows in _rows(batches):
            found = [at for _, _, (at,), _ in centres.closest(rows)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(np.concatenate(found), pa.int32())], [key, into])

    kind = df.schema[key].dataType.simpleString()
    return _vectors(df, features, key).mapInArrow(nearest, f"`{key}` {kind}, `{into}` int")

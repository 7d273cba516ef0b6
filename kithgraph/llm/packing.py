"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Documents are tokenised where they are read; only documents longer than a sequence are cut, with the
short piece first, so all their other pieces fill a sequence each. The remaining pieces are dealt at
random into problems of bounded size. Every problem evolves on several islands (one Spark group
each), whose first genomes differ: a genome is a set of bins, crossover injects whole bins of one parent
that are at least 99 % full into the other, removes what is now doubled, and best-fits the displaced
pieces. A mutation dissolves the worst-filled bins and a few others and fits their pieces again, each bin
by the set of pieces that fills it best. Between epochs each island's elite migrates to the next. A problem
ends early only at the number of bins that the sum of lengths asks for. Full bins and the fullest SETTLED
share of a problem's bins are settled; the others' pieces are dealt anew with those of all other problems
in a further level, so levels shrink by a fixed factor, and the last level is one problem.

Defined cases: a null or empty text is a piece with the end id alone; repeated rows are pieces of
their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.llm.common import table, written
from kithgraph.llm.token_ids import encoder, vocabulary

CAPACITY = 1024
END_ID = 2
PROBLEM = 16384
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 4
POPULATION = 4
#: The share of a problem's bins, the fullest, that are settled; the others go to the next level.
SETTLED = 0.75
#: Crossover takes over bins that are at least so full; a mutation dissolves so many of the bins with room.
WELL_FILLED, DISSOLVED = 0.99, 0.1


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if kept) of every piece."""
    name = tokenizer or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name)
        for rows in batches:
            owner, number, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(rows.column("text").to_pylist()):
                ids = np.append(encode(text).astype("<u4"), np.uint32(end_id))
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    piece = ids[a:b].tobytes()
                    owner.append(i)
                    number.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(piece))
                    if keep_ids:
                        kept.append(piece)
            columns = {"doc_id": rows.column("doc_id").take(pa.array(owner, pa.int64())), "piece": pa.array(number, pa.int32()), **{c: pa.array(v, pa.int64()) for c, v in (("start", start), ("length", length), ("ids_crc32", crc))}}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(kept, pa.binary())} if keep_ids else {}))

    columns = ["doc_id long", "piece int", "start long", "length long", "ids_crc32 long", *["ids binary"] * keep_ids]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(columns))


class Packer:
    """One problem: piece lengths and a capacity. A genome is a list of bins, each a list of pieces."""

    def __init__(self, lengths, capacity: int, seed: int):
        self.n, self.capacity, self.random = [int(x) for x in lengths], capacity, np.random.default_rng(seed)
        self.least = -(-sum(self.n) // capacity)

    def best_fit(self, bins: list[list[int]], loose: list[int]) -> list[list[int]]:
        """Puts each loose piece, in order, into the fullest bin that takes it. Bit r of a mask says that some bin has r left."""
        n, left, mask = self.n, {}, 0
        for b in bins:
            room = self.capacity - sum(map(n.__getitem__, b))
            left.setdefault(room, []).append(b)
            mask |= 1 << room
        for i in loose:
            fit = mask >> n[i]
            if fit:
                room = n[i] + (fit & -fit).bit_length() - 1
                b = left[room].pop()
                if not left[room]:
                    mask ^= 1 << room
            else:
                bins.append(b := [])
                room = self.capacity
            b.append(i)
            room -= n[i]
            mask |= 1 << room
            left.setdefault(room, []).append(b)
        return bins

    def born(self, noise: float) -> list[list[int]]:
        size = np.array(self.n) * (1 + noise * self.random.standard_normal(len(self.n)))
        return self.best_fit([], np.argsort(-size, kind="stable").tolist())

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins, then fuller ones."""
        n = self.n
        return -len(bins), sum((sum(map(n.__getitem__, b)) / self.capacity) ** 2 for b in bins)

    def _rooms(self, bins: list[list[int]]) -> np.ndarray:
        return np.array([self.capacity - sum(map(self.n.__getitem__, b)) for b in bins])

    def cross(self, host: list[list[int]], guest: list[list[int]]) -> list[list[int]]:
        """Half of the guest's well-filled bins go whole into the host; pieces that they displace are best-fitted."""
        rooms = self._rooms(guest)
        good = np.flatnonzero(rooms <= (1 - WELL_FILLED) * self.capacity)
        if not len(good):
            good = rooms.argsort(kind="stable")[:1]
        chosen = good[self.random.random(len(good)) < 0.5]
        take = [guest[i] for i in (chosen if len(chosen) else good[:1])]
        doubled = {i for b in take for i in b}
        kept = [list(b) for b in take] + [list(b) for b in host if doubled.isdisjoint(b)]
        loose = [i for b in host if not doubled.isdisjoint(b) for i in b if i not in doubled]
        return self.best_fit(kept, sorted(loose, key=lambda i: -self.n[i]))

    def mutate(self, genome: list[list[int]]) -> list[list[int]]:
        """The emptiest bins and a few others are dissolved, and their pieces fitted again in sets."""
        rooms = self._rooms(genome)
        worst = max(4, int((rooms > 0).sum() * DISSOLVED))
        gone = {*np.argsort(-rooms, kind="stable")[:worst].tolist(), *self.random.integers(0, len(genome), worst // 4).tolist()}
        return self.fit_sets([b for k, b in enumerate(genome) if k not in gone], [i for k in sorted(gone) for i in genome[k]])

    def fit_sets(self, bins: list[list[int]], loose: list[int]) -> list[list[int]]:
        """Opens bins with the largest piece left and the set of other pieces that fits its room best. Bit s of a number says that some set has the sum s."""
        n, loose = self.n, sorted(loose, key=self.n.__getitem__)
        while loose:
            first = loose.pop()
            room = self.capacity - n[first]
            order, reach = self.random.permutation(len(loose)).tolist(), [1]
            for k in order:
                if reach[-1] >> room:
                    break
                reach.append((reach[-1] | reach[-1] << n[loose[k]]) & (2 << room) - 1)
            left, taken = reach[-1].bit_length() - 1, set()
            for step in range(len(reach) - 1, 0, -1):
                if not reach[step - 1] >> left & 1:
                    taken.add(order[step - 1])
                    left -= n[loose[order[step - 1]]]
            bins.append([first, *[loose[k] for k in taken]])
            loose = [i for k, i in enumerate(loose) if k not in taken]
        return bins

    def evolve(self, genomes: list[list[list[int]]], generations: int, population: int, noise: float = 0.0) -> list[list[list[int]]]:
        """Best first; a new population starts around ``noise``. Ends early only when the best has as few bins as the sum of lengths allows."""
        genomes = list(genomes) or [self.born(noise)]
        while len(genomes) < population and min(map(len, genomes)) > self.least:
            genomes.append(self.born(noise + 0.05 * len(genomes)))
        ranked = sorted(((self.fitness(g), -k, g) for k, g in enumerate(genomes)), reverse=True)
        for number in range(generations):
            if len(ranked[0][2]) <= self.least:
                break
            child = ranked[0][2]
            if number % 2 == 0 and len(ranked) > 1:
                a, b = sorted(self.random.choice(len(ranked), 2, replace=False))
                child = self.cross(ranked[a][2], ranked[b][2])
            child = self.mutate(child)
            fit = self.fitness(child)
            if len(ranked) < population:
                ranked.append((fit, -len(genomes) - number, child))
            elif fit > ranked[-1][0]:
                ranked[-1] = (fit, -len(genomes) - number, child)
            ranked.sort(key=lambda r: r[:2], reverse=True)
        return [g for *_, g in ranked]


def _genomes(rows: pd.DataFrame) -> tuple[pd.DataFrame, list[list[list[int]]]]:
    """The pieces (in order of row), and the genome of each role that has been packed before."""
    rows = rows.sort_values(["role", "row"], kind="stable")
    first = rows[rows["role"] == rows["role"].iloc[0]].reset_index(drop=True)
    found = []
    for _, packed in rows.groupby("role"):
        if packed["bin"].iloc[0] >= 0:
            bins: dict[int, list[int]] = {}
            for i, b in enumerate(packed["bin"]):
                bins.setdefault(int(b), []).append(i)
            found.append(list(bins.values()))
    return first, found


def _with_bins(first: pd.DataFrame, genome: list[list[int]]) -> pd.DataFrame:
    number = np.empty(len(first), np.int32)
    for b, members in enumerate(genome):
        number[members] = b
    return first.assign(bin=number)


def _level(loose: DataFrame, level: int, problems: int, capacity: int, islands: int, epochs: int, generations: int, population: int) -> DataFrame:
    """row, length, problem, bin, settled of one level of packing."""
    columns = "row long, length long, problem long, island int, role int, bin int"

    def epoch(key, rows: pd.DataFrame) -> pd.DataFrame:
        first, genomes = _genomes(rows)
        packer = Packer(first["length"], capacity, hash((int(key[0]), int(key[1]), len(genomes))) & 0xFFFF)
        best = packer.evolve(genomes, generations, population, 0.05 * int(key[1]))[0]
        return _with_bins(first.assign(role=0), best)

    def last(key, rows: pd.DataFrame) -> pd.DataFrame:
        first, genomes = _genomes(rows.assign(role=rows["island"]))
        packer = Packer(first["length"], capacity, int(key[0]) & 0xFFFF)
        packed = _with_bins(first, packer.evolve(genomes, generations, population)[0])
        filled = np.bincount(packed["bin"], packed["length"])
        place = np.empty(len(filled), np.int64)
        place[np.argsort(-filled, kind="stable")] = np.arange(len(filled))
        packed["settled"] = ((filled >= capacity) | (place < SETTLED * len(filled)))[packed["bin"]]
        return packed[["row", "length", "problem", "bin", "settled"]]

    state = loose.select("row", "length", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(problems)).alias("problem"), F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), F.lit(0).alias("role"), F.lit(-1).alias("bin"))
    for number in range(epochs):
        if number:
            guests = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands))).withColumn("role", F.lit(1))
            state = state.unionByName(guests)
        state = state.groupBy("problem", "island").applyInPandas(epoch, columns)
        if number + 1 < epochs:
            state = written(state, "packing-epoch")  # the next epoch reads it twice
    return state.groupBy("problem").applyInPandas(last, "row long, length long, problem long, bin int, settled boolean")


def pack(cut: DataFrame, capacity: int = CAPACITY, problem: int = PROBLEM, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces with a unique column row."""
    whole = cut.where(F.col("length") == capacity).select("row", (-1 - F.col("row")).alias("sequence_id"))
    loose, placed, level = cut.where(F.col("length") < capacity).select("row", "length"), whole, 0
    count = loose.count()
    while count:
        problems = -(-count // problem)
        packed = written(_level(loose, level, problems, capacity, islands, epochs, generations, population), "packing")
        done = problems == 1
        settled = packed if done else packed.where("settled")
        number = (F.lit(level) * (1 << 56) + F.col("problem") * (1 << 24) + F.col("bin")).cast("long")
        placed = placed.union(settled.select("row", number.alias("sequence_id")))
        if done:
            break
        loose, level = packed.where("not settled").select("row", "length"), level + 1
        count = loose.count()
    before = W.partitionBy("sequence_id").orderBy("row").rowsBetween(W.unboundedPreceding, -1)  # at most a sequence's pieces
    return cut.join(placed, "row").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def packed_documents(docs: DataFrame, keep_ids: bool = False, **settings) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    capacity = settings.get("capacity", CAPACITY)
    cut = written(pieces(docs, capacity=capacity, keep_ids=keep_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(cut, **settings).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))

"""Packing of token sequences: best fit, then swap-based local search.

Pieces are dealt by hash into groups of about GROUP pieces, so no task holds more
than that however large the corpus is. Within a group the best-fit packing is improved
by moves, one-for-one and two-for-one exchanges (either side gives two) between
underfull bins that increase the sum of squared fills, until bins empty and nothing
improves. What the groups leave in their OPEN emptiest bins is then dealt anew and packed
again, and so on until one group holds it, so unused room doesn't add up over the groups.

Defined cases: a null or empty text is its end id alone; rows without doc_id are left
out; rows with the same doc_id are packed each, numbered in piece order per row; ties of
length go by doc_id and piece; texts of any length are encoded whole and cut into
pieces; an empty table gives no rows; other columns are not read.
"""

import zlib
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import common

CAPACITY = 2048
GROUP = 8192
#: Emptiest bins of a group that are packed again with those of other groups.
OPEN = 32
END_ID = 0


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `capacity` ids; only longer documents are cut."""

    def run(batches):
        bpe = common.word_bpe(path)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.doc_id, bpe.encode_many(list(batch.text)), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                rows += [(doc, k, at, len(part := ids[at : at + capacity]), zlib.crc32(part.tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.keyed_texts(docs).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of positions: longest first, each into the fullest bin with room."""
    bins: list[list[int]] = []
    open_bins: dict[int, list[int]] = {}
    rooms = 0  # bit r is set if a bin with room r is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - size
        if left:
            open_bins.setdefault(left, []).append(b)
            rooms |= 1 << left
    return bins


class LocalSearch:
    """Exchanges between underfull bins that increase the sum of squared fills.

    A bin gives nothing, one piece or two, and takes one piece from an emptier bin; or it
    gives nothing or one and takes two. Pieces of one size are alike, so a bin's sizes (at
    most 63 different ones add up to 2,048) stand for all its pieces, and of the bins
    that hold a size the emptiest other one stands for all: nothing is left untried.
    """

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.size = lengths.tolist()
        self.capacity = capacity
        self.done = [b for b in bins if sum(self.size[i] for i in b) >= capacity]
        self.bins = [b for b in bins if sum(self.size[i] for i in b) < capacity]
        self.fill = [sum(self.size[i] for i in b) for b in self.bins]
        self.where = {i: b for b, items in enumerate(self.bins) for i in items}
        self.holders: dict[int, list[tuple[int, int, int]]] = {}
        self.present = 0  # bit s is set if a piece of size s may be in a bin
        for b in range(len(self.bins)):
            self._note(b)

    def _note(self, b: int) -> None:
        for i in self.bins[b]:
            heappush(self.holders.setdefault(self.size[i], []), (self.fill[b], b, i))
            self.present |= 1 << self.size[i]

    def _emptiest(self, size: int, b: int) -> tuple[int, int, int] | None:
        """(fill, bin, piece) of the emptiest bin other than b that holds the size."""
        heap, own, found = self.holders[size], [], None
        while heap and found is None:
            fill, other, i = heap[0]
            if self.where[i] != other or self.fill[other] != fill:
                heappop(heap)
            elif other == b:
                own.append(heappop(heap))
            else:
                found = heap[0]
        for entry in own:
            heappush(heap, entry)
        if not heap:
            self.present &= ~(1 << size)
        return found

    def _kinds(self, b: int) -> tuple[list, list]:
        """What bin b may give, one of each kind: ((pieces), their size); nothing or one, and two."""
        by: dict[int, list[int]] = {}
        for i in self.bins[b]:
            by.setdefault(self.size[i], []).append(i)
        sizes = sorted(by)
        one = [((), 0)] + [((by[s][0],), s) for s in sizes]
        two = [((by[s][0], by[t][0]), s + t) for k, s in enumerate(sizes) for t in sizes[k + 1 :]]
        return one, two + [((held[0], held[1]), 2 * s) for s, held in by.items() if len(held) > 1]

    def _swap(self, b: int, gives: tuple, other: int, takes: tuple) -> None:
        for items, source, target in ((gives, b, other), (takes, other, b)):
            for i in items:
                self.bins[source].remove(i)
                self.bins[target].append(i)
                self.where[i] = target
                self.fill[source] -= self.size[i]
                self.fill[target] += self.size[i]
        self._note(b)
        self._note(other)

    def _take_one(self, b: int) -> bool:
        """The exchange for one piece that fills bin b most."""
        room, fill, best = self.capacity - self.fill[b], self.fill[b], None
        one, two = self._kinds(b)
        for gives, gone in one + two:
            size = min(room + gone, self.capacity)
            while size > gone + (best[0] if best else 0):
                size = (self.present & ((1 << (size + 1)) - 1)).bit_length() - 1
                gain = size - gone
                if gain <= (best[0] if best else 0):
                    break
                found = self._emptiest(size, b)
                if found and fill - found[0] + gain > 0:
                    best = (gain, gives, found[1], found[2])
                    break
                size -= 1
        if best:
            self._swap(b, best[1], best[2], (best[3],))
        return best is not None

    def _take_two(self, b: int, pairs: dict[int, list[tuple[int, int, tuple]]]) -> bool:
        """An exchange of nothing or one piece for two of another bin; pairs: by size (fill, bin, pieces), as at the pass's start."""
        room, fill = self.capacity - self.fill[b], self.fill[b]
        for gives, gone in self._kinds(b)[0]:
            for size in range(room + gone, gone, -1):
                for _, other, takes in pairs.get(size, ()):
                    if other != b and all(self.where[i] == other for i in takes) and fill - self.fill[other] + size - gone > 0:
                        self._swap(b, gives, other, takes)
                        return True
        return False

    def run(self, passes: int | None = None) -> list[list[int]]:
        """Bins when nothing improves (or after so many passes)."""
        while passes is None or passes > 0:
            passes = None if passes is None else passes - 1
            if sum(self.fill) > (sum(map(bool, self.bins)) - 1) * self.capacity:
                break
            pairs: dict[int, list] = {}
            for b in range(len(self.bins)):
                for takes, size in self._kinds(b)[1]:
                    pairs.setdefault(size, []).append((self.fill[b], b, takes))
            for held in pairs.values():
                held.sort()
            changed = 0
            for b in sorted(range(len(self.bins)), key=lambda b: -self.fill[b]):
                while self.bins[b] and self.fill[b] < self.capacity and (self._take_one(b) or self._take_two(b, pairs)):
                    changed += 1
            for heap in self.holders.values():  # what is out of date goes, so heaps stay as small as the bins
                heap[:] = [x for x in heap if self.where[x[2]] == x[1] and self.fill[x[1]] == x[0]]
                heapify(heap)
            if not changed:
                break
        return self.done + [items for items in self.bins if items]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return LocalSearch(lengths, best_fit(lengths, capacity), capacity).run() if len(lengths) else []


def _pack_groups(pieces: DataFrame, groups: int, level: int, capacity: int, most_tasks: int = 2048) -> DataFrame:
    """pieces with sequence_id, offset and whether their bin is open; each group is packed by itself."""
    columns = pieces.columns

    def one(g: int, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "piece"]).reset_index(drop=True)
        seq, offset, is_open = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=bool)
        lengths = part["length"].to_numpy()
        bins, given = sorted(pack_lengths(lengths, capacity), key=lambda b: int(lengths[b].sum())), 0
        for k, items in enumerate(bins):
            at = np.array(items)
            seq[at] = (level << 56) + (g << 24) + k
            offset[at] = np.cumsum(lengths[at]) - lengths[at]
            given += len(at)
            is_open[at] = lengths[at].sum() < capacity and (k == 0 or (k < OPEN and given <= len(part) // 8))
        return part[columns].assign(sequence_id=seq, offset=offset, is_open=is_open)

    def run(batches):
        held: list[pd.DataFrame] = []
        for batch in batches:
            for g, part in batch.groupby("g", sort=True):
                if held and held[0]["g"].iloc[0] != g:
                    yield one(int(held[0]["g"].iloc[0]), pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield one(int(held[0]["g"].iloc[0]), pd.concat(held))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(groups)).cast("int"))
    tasks = min(groups, most_tasks)
    return dealt.repartitionById(tasks, F.pmod("g", F.lit(tasks)).cast("int")).sortWithinPartitions("g").mapInPandas(run, f"{fields}, sequence_id long, offset long, is_open boolean")


def pack(spark: SparkSession, pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces (a written table) with sequence_id and offset."""
    out, level, left, n = [], 0, pieces, pieces.count()
    while (groups := max(1, -(-n // group))) > 1:
        packed, _ = common.saved(spark, _pack_groups(left, groups, level, capacity), f"packed-{level}")
        again = packed.where("is_open").select(*pieces.columns)
        rest = again.count()
        if 2 * rest > n:  # groups of a few pieces each, with nothing to gain
            return reduce(DataFrame.union, [*out, packed.drop("is_open")])
        out.append(packed.where("NOT is_open").drop("is_open"))
        left, n, level = again, rest, level + 1
    return reduce(DataFrame.union, [*out, _pack_groups(left, 1, level, capacity).drop("is_open")])


def pack_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    common.prepare(spark)
    return pack(spark, token_pieces(docs, common.tokenizer_path("word_bpe_49k.json")).checkpoint())


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, common.read_table(spark, sf_dir, "documents"))

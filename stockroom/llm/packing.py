"""Operator 6, best-fit packing after Martello-Toth dominance reduction.

Documents become token pieces of at most `capacity`; the plan is made on the histogram of piece lengths, which has
at most `capacity` entries however many pieces there are. Lengths are taken from the largest down. Where a set of
at most three pieces provably dominates every other set with that largest piece, it is fixed, as often as the counts
allow, and leaves the instance; best fit in decreasing order packs the remainder into the space that is left.
The plan then says, for the r-th piece of a length, its sequence and place.

Scale: encoding is a narrow map; counting combines before its shuffle; ranks within a length are taken in salted
groups, so that a length that a third of all pieces share is no hot group; the plan's size depends on `capacity` alone.

Edge cases: a null or empty text is the end token alone; null ids and repeated rows are packed like any other;
an empty table gives an empty result; texts are never cut but at the edge of a sequence, however long; extra columns
of pieces are left alone, one that bears the name of a result gives way to it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stockroom.llm import bpe, common

CAPACITY = 2048
END = 0
#: Pieces that one salted group of a length is meant to hold.
GROUP_ROWS = 100_000

#: length, first rank, pieces, pieces of this length in each sequence, first sequence, offset of the first of them.
PlanRow = tuple[int, int, int, int, int, int]


class Plan:
    """Sequences for a histogram of lengths, in runs of sequences that look alike."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.taken = np.zeros(capacity + 1, np.int64)
        self.rows: list[PlanRow] = []
        self.sequences = self.fixed = 0
        self.reduce()
        self.best_fit()

    def place(self, length: int, each: int, bins: int, first: int, offset: int) -> None:
        """`each` pieces of a length into each of `bins` sequences from `first` on."""
        n = each * bins
        self.rows.append((length, int(self.taken[length]), n, each, first, offset))
        self.taken[length] += n
        self.left[length] -= n

    def fix(self, members: list[int]) -> None:
        """The dominating set as often as the counts allow."""
        sizes, each = np.unique(members, return_counts=True)
        bins = int(min(self.left[s] // k for s, k in zip(sizes, each)))
        offset = 0
        for s, k in zip(sizes[::-1].tolist(), each[::-1].tolist()):
            self.place(s, k, bins, self.sequences, offset)
            offset += s * k
        self.sequences += bins
        self.fixed += bins

    def others(self, *out: int) -> np.ndarray:
        """The lengths left, ascending, without those in `out`; of each length at most three."""
        n = self.left.copy()
        for x in out:
            n[x] -= 1
        sizes = np.flatnonzero(n > 0)
        return np.repeat(sizes, np.minimum(n[sizes], 3))

    def dominating(self, j: int) -> list[int] | None:
        """A set with a piece of length j that dominates all others, or None."""
        rest, room = self.others(j), self.capacity - j
        fit = rest[rest <= room]
        if not len(fit):
            return [j]
        most = int(fit[-1])
        if most == room or len(rest) < 2 or rest[:2].sum() > room:
            return [j, most]
        if len(rest) >= 3 and rest[:3].sum() <= room:
            return None
        # at most two more fit: the fullest pair a >= b
        partner = np.searchsorted(fit, room - fit, side="right") - 1
        at = np.arange(len(fit))
        partner = np.minimum(partner, at - 1)
        total = np.where(partner >= 0, fit + fit[partner], 0)
        a_at = len(total) - 1 - int(np.argmax(total[::-1]))
        a, b = int(fit[a_at]), int(fit[partner[a_at]])
        if most >= a + b:
            return [j, most]
        above = rest[rest > b][:2]
        if a == most and (len(above) < 2 or above.sum() > room):
            return [j, a, b]  # no pair of two pieces over b fits, so any set has one within a and one within b
        return None

    def reduce(self) -> None:
        for j in range(self.capacity, 0, -1):
            while self.left[j] and (found := self.dominating(j)):
                self.fix(found)

    def best_fit(self) -> None:
        """Best fit decreasing; bins of equal room are kept as runs (first, bins, room filled so far)."""
        runs: dict[int, list[tuple[int, int]]] = {}
        for length in range(self.capacity, 0, -1):
            while n := int(self.left[length]):
                room = min((r for r in runs if r >= length), default=0)
                if room:
                    first, bins = runs[room].pop()
                    if not runs[room]:
                        del runs[room]
                else:
                    room, first = self.capacity, self.sequences
                    bins = -(-n // (room // length))
                    self.sequences += bins
                each = min(room // length, n)
                full = min(bins, n // each)
                self.place(length, each, full, first, self.capacity - room)
                if bins > full:
                    runs.setdefault(room, []).append((first + full, bins - full))
                if room > each * length:
                    runs.setdefault(room - each * length, []).append((first, full))


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): documents, each closed by the end token, cut where longer
    than a sequence; all pieces but the first are then full."""
    path = path or bpe.default_path()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text"))
    fields = T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids).fields
    end = END.to_bytes(4, "little")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "__text", bpe.PIECE_BYTES):
            rows: list[tuple[int, int, int, int, int]] = []
            arrays: list[list[int]] = []
            for k, ids in enumerate(bpe.codec(path).encode(batch.column("__text"))):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for piece, (s, e) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * s : 4 * e]
                    rows.append((k, piece, s, e - s, zlib.crc32(part)))
                    if with_ids:
                        arrays.append(np.frombuffer(part, "<u4").tolist())
            k, piece, start, length, crc = np.array(rows, np.int64).reshape(-1, 5).T
            columns = [batch.column("doc_id").take(pa.array(k)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(arrays, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return slim.mapInArrow(work, T.StructType([slim.schema["doc_id"], *fields]))


def pack(items: DataFrame, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY) -> DataFrame:
    """`items` with sequence_id and offset. Lengths lie between 1 and `capacity`."""
    spark = items.sparkSession
    items = common.without(items, "sequence_id", "offset")
    with common.small_batches(spark):
        items = common.cut(items)
    columns, items = items.columns, items.withColumn("__row", F.monotonically_increasing_id())  # tells repeated rows apart
    counts = {r["w"]: r["n"] for r in items.groupBy(F.col(length).alias("w")).agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = Plan(counts, capacity).rows
    plan = spark.createDataFrame(plan or [(0,) * 6], "__w long, __first long, __n long, __each long, __sequence long, __offset long")
    salts = 1 + sum(counts.values()) // GROUP_ROWS
    salted = items.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(salts)))
    before = Window.partitionBy("__l").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    groups = salted.groupBy(F.col(length).alias("__l"), F.col("__salt").alias("__s")).agg(F.count("*").alias("__k"))
    groups = groups.select("__l", "__s", F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__before"))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy(length, "__salt").orderBy(*order, "__row")) - 1)
    ranked = ranked.join(groups, (ranked[length] == groups["__l"]) & (ranked["__salt"] == groups["__s"])).withColumn("__rank", F.col("__rank") + F.col("__before"))
    at = F.col("__rank") - F.col("__first")
    placed = ranked.join(F.broadcast(plan), (ranked[length] == plan["__w"]) & at.between(0, F.col("__n") - 1))
    return placed.select(
        *columns,
        (F.col("__sequence") + F.floor(at / F.col("__each")).cast("long")).alias("sequence_id"),
        (F.col("__offset") + F.pmod(at, F.col("__each")) * F.col(length)).cast("long").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the token ids of whole sequences, from packed pieces with ids; each is one bounded group."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(common.read(spark, sf_dir, "documents")))

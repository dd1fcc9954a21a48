"""Near copies: the links of operator 2, and beside them exact Jaccard similarity of word shingles.

Fingerprints within the radius of operator 2 link by its ball hashing (`simhash.links`); what that leaves apart is linked
by similarity, so nothing that either finds is lost. Candidates for the second share a band of ROWS minima of hashes; a pair at similarity s shares one of BANDS bands with probability
1 - (1 - s^ROWS)^BANDS, which misses 3 in a million pairs at 0.8. Every linked pair is verified on its whole shingle sets.

Scale: texts with one shingle set collapse before anything is paired. Within a band's bucket all are compared with one
leader, in turn the one that shares buckets with most others and one by chance, and those that are linked by now are compared no more; so a large group of
near copies costs as many pairs as it has rows. Only buckets of more than FEW pairs a row take a leader; the many small ones are read once, at the end. What is left in the buckets after that is compared in blocks of at most about
BLOCK rows, each with each: a task holds two blocks of short sketches and sends only pairs that may be linked, so pairs are never
rows of a join, and no candidate pair goes untested. A sketch holds the parity of a set's shingles in each of 64 * SKETCH cells;
two sketches never differ in more bits than the sets in members, so what they rule out is certain.

Edge cases: texts without a word are copies of one another; a text of at most SHINGLE words is one shingle; null ids
come last; repeated rows are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stockroom.llm import common, simhash
from stockroom.llm.graph import components

SHINGLE, JACCARD = 5, 0.8
BANDS, ROWS = 24, 4
#: Rounds of leaders at most; and pairs for each place in a bucket under which it takes no leader, since all are compared at the end.
LEADERS, FEW = 6, 4
#: Rows in the buckets that took leaders for each link that a turn must find for another turn to follow; otherwise all that are left are compared.
PAYS = 64
#: Words of 64 bits of a sketch; and rows of a block of a bucket.
SKETCH, BLOCK = 16, 4096
#: Groups in which the pairs of one leader meet it, at most.
SALTS = 64
#: Shingles that are hashed side by side.
CHUNK = 1024
U64 = np.uint64

_rng = np.random.default_rng(17)
FLIP = _rng.integers(1, 2**63, BANDS * ROWS, dtype=U64)
ODD = _rng.integers(1, 2**63, BANDS * ROWS, dtype=U64) * U64(2) + U64(1)
PLACE = _rng.integers(1, 2**63, max(SHINGLE, ROWS), dtype=U64) * U64(2) + U64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(31))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE words, in lower case."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, U64)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 5)], U64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w, 5) for w in words], U64)
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, U64)
    for k in range(SHINGLE):
        total += h[k : k + n] * PLACE[k]
    return np.unique(mixed(total))


def signature(found: np.ndarray) -> tuple[int, list[int]]:
    """The set's own hash and one hash for each band, as signed longs."""
    own = np.array([xxhash.xxh64_intdigest(found.tobytes(), 7)], U64).view(np.int64)[0]
    if not len(found):
        return int(own), []
    least = np.full(BANDS * ROWS, 2**64 - 1, U64)
    for at in range(0, len(found), CHUNK):
        np.minimum(least, ((found[at : at + CHUNK, None] ^ FLIP) * ODD).min(axis=0), out=least)
    bands = mixed((mixed(least).reshape(BANDS, ROWS) * PLACE[:ROWS]).sum(axis=1, dtype=U64) + np.arange(BANDS, dtype=U64))
    return int(own), bands.view(np.int64).tolist()


def sketch(found: np.ndarray) -> np.ndarray:
    """Which cells an odd number of the set's shingles lie in."""
    odd = np.bincount((mixed(found) >> U64(32)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH) % 2
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def mapped(docs: DataFrame, text: str, keep: dict[str, str], of, fields: str) -> DataFrame:
    """The columns of `keep` under their new names, and what `of` makes of each batch's texts."""
    slim = docs.select(*(F.col(c).alias(n) for c, n in keep.items()), F.col(text).alias("__text"))
    added = T.StructType.fromDDL(fields).fields

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "__text"):
            columns = of(batch.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep.values()), *columns], [*keep.values(), *(f.name for f in added)])

    return slim.mapInArrow(work, T.StructType([*slim.drop("__text").schema.fields, *added]))


def signed(texts: list[str | None]) -> list[pa.Array]:
    found = [signature(shingles(t)) for t in texts]
    fps = simhash.fingerprint_of(texts).view(np.int64)
    return [pa.array([own for own, _ in found], pa.int64()), pa.array([bands for _, bands in found], pa.list_(pa.int64())), pa.array(fps)]


def with_sets(texts: list[str | None]) -> list[pa.Array]:
    sets = [shingles(t) for t in texts]
    own = [np.array([xxhash.xxh64_intdigest(s.tobytes(), 7)], U64).view(np.int64)[0] for s in sets]
    drawn = [pa.array(column, pa.int64()) for column in np.array([sketch(s) for s in sets], np.int64).reshape(-1, SKETCH).T]
    return [pa.array(own, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), *drawn]


WORDS = [f"s{k}" for k in range(SKETCH)]
SETS = "own long, hashes binary, size long, " + ", ".join(f"{w} long" for w in WORDS)


def may_link(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sketches don't rule out that they are linked."""
    side = lambda name: sets.select(F.col("own").alias(name), F.col("size").alias(f"size_{name}"), *(F.col(w).alias(f"{w}_{name}") for w in WORDS))
    apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in WORDS[1:]), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.where(apart <= F.expr(f"(size_a + size_b) * {(1 - JACCARD) / (1 + JACCARD)}D + 1e-6D")).select(*pairs.columns)


def in_blocks(open_: DataFrame, kinds: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (own, label, other, theirs) of different labels that share a bucket and may be linked.

    `kinds` says how many rows a bucket has; the rows of a large one are dealt to blocks by their hash, and every two blocks
    meet in one task."""
    k = F.ceil(F.col("n") / BLOCK).cast("int")
    mine, with_ = F.pmod(F.xxhash64("own"), F.col("k")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    rows = open_.join(kinds.select("bucket", k.alias("k")), "bucket").select("own", "bucket", "label", mine.alias("r"), with_.alias("s"))
    rows = rows.select("own", "bucket", "label", "r", F.least("r", "s").alias("i"), F.greatest("r", "s").alias("j")).join(sets.drop("hashes"), "own")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    share = (1 - JACCARD) / (1 + JACCARD)

    def compared(group: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        own, label, size, words = group["own"], group["label"], group["size"], group["words"]
        i, j = group["i"][0], group["j"][0]
        left, right = np.flatnonzero(group["r"] == i), np.flatnonzero(group["r"] == j)
        for at in range(0, len(left), 256):
            x = left[at : at + 256]
            apart = np.zeros((len(x), len(right)), np.int32)
            for w in words:
                apart += np.bitwise_count(w[x, None] ^ w[right])
            good = (apart <= (size[x, None] + size[right]) * share + 1e-6) & (label[x, None] != label[right])
            if i == j:
                good &= own[x, None] < own[right]
            a, b = np.nonzero(good)
            yield own[x[a]], label[x[a]], own[right[b]], label[right[b]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []  # the parts of the group that is not over yet

        def out() -> Iterator[pa.RecordBatch]:
            whole = {c: np.concatenate([h[c] for h in held], axis=-1) for c in held[0]}
            for columns in compared(whole):
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["own", "label", "other", "theirs"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c).to_numpy() for c in ("own", "bucket", "label", "r", "i", "j", "size")}
            columns["words"] = np.array([batch.column(w).to_numpy() for w in WORDS]).view(U64)
            new = np.zeros(batch.num_rows, bool)
            new[0] = bool(held) and any(held[-1][c][-1] != columns[c][0] for c in ("bucket", "i", "j"))
            for c in ("bucket", "i", "j"):
                new[1:] |= columns[c][1:] != columns[c][:-1]
            starts = [0, *np.flatnonzero(new[1:]) + 1, batch.num_rows]
            for start, end in zip(starts, starts[1:]):
                if new[start] and held:
                    yield from out()
                    held.clear()
                held.append({c: v[..., start:end] for c, v in columns.items()})
        if held:
            yield from out()

    return rows.mapInArrow(work, "own long, label long, other long, theirs long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, and the labels of both) whose shingle sets are at least JACCARD alike.

    A leader `b` that very many pairs share meets them in up to SALTS groups; the sets lie in buckets of their key."""
    columns = ["a", "b", "label_a", "label_b"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.intersect1d(x, y, assume_unique=True).size if min(len(x), len(y)) >= JACCARD * max(len(x), len(y)) else 0
                good.append(both >= JACCARD * (len(x) + len(y) - both))
            yield batch.select(columns).filter(pa.array(good, pa.bool_()))

    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    leaders = dealt.select("b", "salt").distinct().join(sets.select(F.col("own").alias("b"), F.col("hashes").alias("y")), "b")
    both = dealt.join(leaders, ["b", "salt"]).join(sets.select(F.col("own").alias("a"), F.col("hashes").alias("x")), "a")
    return both.select(*columns, "x", "y").mapInArrow(work, "a long, b long, label_a long, label_b long")


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Whole rows, stored once in buckets of a key that rows of one id and text share."""
    return common.bucketed(docs.withColumn("__key", F.xxhash64(doc_id, text)), "__key", "snappy")


def similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(id, own, bands) of every row, and (own, component) of the sets that are linked.

    Every set starts with a label of its own; a link gives the labels of both sides the smaller of the two. Sets that
    share a label are linked, so they aren't compared; components are taken once, from all links."""
    return linked(keyed(docs, text, doc_id), text, doc_id)


def fingerprinted(marked: DataFrame) -> DataFrame:
    """(own, least): the links of operator 2, from each set to the smallest one of those whose fingerprints it links.

    A set may have several fingerprints, since these count how often a shingle occurs."""
    found = common.stored(marked.select("own", "fp").distinct())
    joined = components(simhash.links(found.select("fp").distinct()), "a", "b").select(F.col("node").alias("fp"), "component")
    found = found.join(joined, "fp", "left").select("own", F.coalesce("component", "fp").alias("c")).distinct()
    least = found.groupBy("c").agg(F.min("own").alias("least"))
    return common.stored(found.join(least, "c").where("own != least").select("own", "least").distinct())


def leaders(open_: DataFrame, kinds: DataFrame, turn: int) -> DataFrame:
    """(bucket, other, theirs): the leader of each bucket and its label.

    In even turns whoever shares most buckets with most others leads: what copies were made from is nearer to each than they
    are. In odd turns chance decides, and nothing needs to be known of the buckets. A set has at most BANDS rows, so its weight
    is a sum over a window and no row meets another for it."""
    led, weight = open_, F.lit(0)
    if turn % 2 == 0:
        led = open_.join(kinds.select("bucket", "n"), "bucket").withColumn("weight", F.sum("n").over(Window.partitionBy("own")))
        weight = -F.col("weight")
    order = F.struct(weight.alias("w"), F.xxhash64("own", F.lit(turn)).alias("h"), "own", "label")
    other = led.groupBy("bucket").agg(F.min(order).alias("l"))
    return other.select("bucket", F.col("l.own").alias("other"), F.col("l.label").alias("theirs"))


def linked(rows: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """`similar` over `keyed` rows; (key, id, own, bands) of each. Shingle sets are kept for one row of each set that
    shares a bucket with another."""
    spark = rows.sparkSession
    with common.small_batches(spark):
        marked = common.stored(mapped(rows, text, {"__key": "key", doc_id: "id"}, signed, "own long, bands array<long>, fp long"))
    seeds = fingerprinted(marked)
    places = marked.groupBy("own").agg(F.first("bands").alias("bands")).select("own", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    first = seeds.groupBy("own").agg(F.min("least").alias("least"))
    state = common.stored(places.join(shared, "bucket").join(first, "own", "left").select("own", "bucket", F.coalesce("least", "own").alias("label")))
    one = marked.join(state.select("own").distinct(), "own", "left_semi").groupBy("own").agg(F.min("key").alias("__key")).select("__key")
    texts = rows.select("__key", F.col(text).alias("__t")).join(common.cut(one), "__key", "left_semi").groupBy("__key").agg(F.first("__t").alias("__t"))
    with common.small_batches(spark, 64):
        sets = common.bucketed(mapped(texts, "__t", {}, with_sets, SETS), "own")
        edges, known, pays = seeds.select(F.col("own").alias("a"), F.col("least").alias("b")), None, True
        for turn in range(LEADERS + 1):
            kinds = state.groupBy("bucket", "label").agg(F.count("*").alias("n"))
            kinds = kinds.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same")).where("n * n > same")
            kinds = common.cut(kinds)
            apart = (F.col("n") * F.col("n") - F.col("same")) / 2
            crowded = apart > FEW * F.col("n")
            size = kinds.agg(F.sum(apart), F.sum("n"), F.sum(F.when(crowded, F.col("n")))).first()
            if size[0] is None:
                break
            last = turn == LEADERS or not pays or size[0] <= FEW * size[1]
            if last:
                pairs = in_blocks(state, kinds, sets)
            else:
                large = kinds.where(crowded)
                open_ = common.stored(state.join(large.select("bucket"), "bucket", "left_semi"))
                other = leaders(open_, large, turn)
                pairs = open_.join(other, "bucket").where("label != theirs")
            pairs = pairs.select(F.col("own").alias("a"), F.col("other").alias("b"), F.col("label").alias("label_a"), F.col("theirs").alias("label_b"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).dropDuplicates(["lo", "hi"])
            pairs = pairs if known is None else pairs.join(known, ["lo", "hi"], "left_anti")
            pairs = common.stored(pairs if last else may_link(pairs, sets))
            known = pairs.select("lo", "hi") if known is None else known.union(pairs.select("lo", "hi"))
            new = common.stored(verified(pairs, sets))
            edges = edges.union(new.select("a", "b"))
            if last:
                break
            pays = PAYS * new.count() >= size[2]
            least = F.least("label_a", "label_b").alias("smaller")
            moved = new.select(F.col("label_a").alias("label"), least).union(new.select(F.col("label_b").alias("label"), least)).groupBy("label").agg(F.min("smaller").alias("smaller"))
            state = common.stored(state.join(common.cut(moved), "label", "left").select("own", "bucket", F.coalesce("smaller", "label").alias("label")))
    return marked, components(edges, "a", "b").select(F.col("node").alias("own"), "component")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each component: the one with the smallest id, null ids last; of rows that share it, the smallest text.

    Columns and their order stay. Only the rows' keys are shuffled; whole rows are stored once and read back by key."""
    names = docs.columns
    with common.freed_shuffles(docs.sparkSession):
        rows = keyed(docs, text, doc_id)
        marked, joined = linked(rows, text, doc_id)
        none = F.col("id").isNull().alias("none")
        least = marked.groupBy("own").agg(F.min(F.struct(none, "id")).alias("best"))
        least = least.join(joined, "own", "left").select("own", F.coalesce("component", "own").alias("component"), "best")
        chosen = least.groupBy("component").agg(F.min(F.struct("best.none", "best.id", "own")).alias("chosen")).select("component", "chosen.id", "chosen.own")
        keys = marked.select("key", F.col("own").alias("own_"), F.col("id").alias("id_")).distinct()
        keys = keys.join(chosen, (keys["own_"] == chosen["own"]) & keys["id_"].eqNullSafe(chosen["id"])).select(F.col("key").alias("__key"), F.col("component").alias("__component"))
        keys = common.cut(keys.distinct())
    kept = rows.join(keys, "__key")
    order = Window.partitionBy("__component").orderBy(F.col(text), F.to_json(F.struct(*names)))
    return kept.withColumn("__k", F.row_number().over(order)).where("__k = 1").select(*names)

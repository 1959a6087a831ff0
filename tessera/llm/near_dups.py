"""SimHash near-duplicates of true Jaccard similarity LEAST or more, found by Golay-code fuzzy hashing.

A document is its set of shingles of SHINGLE_WORDS words (64-bit hashes; a shorter text is one shingle). Its sketch is
a wide SimHash: for each of SEGMENTS x 23 places how far the ones and zeros of the shingles' hashes are apart. Each
segment is decoded to its NEAREST codewords of the Golay code, margins counted, and a key is made of the codewords of
every TOGETHER segments, so a set has several keys. Errors cannot be in all segments alike: of 14 segments two sets of similarity 0.8 share
the codeword of a quarter, and TOGETHER are enough. Expected recall is 0.93 at similarity 0.8, 0.97 at 0.85, 0.99 at 0.9 and 1.00
at 0.95; more segments or codewords raise it. Sketches of candidates are compared, then the shingle sets in full, so no pair below
LEAST is linked. A pair of similarity 0.8 has sketches of cosine 0.889 or more, give or take 0.012; ALIKE is seven times
that below.

Two sets of a large corpus can share a key by chance, and such pairs grow with the square of the corpus. So key rows carry OTHERS signs of
the sketch, of segments that are not in the key, and a row goes on only if another one under its key differs in APART signs or fewer and in size
by no more than LEAST allows: of pairs with a similarity of 0.8 19 signs differ, give or take 4 (24 of the smallest texts), of
strangers 64, give or take 6. Keys of more than MEETING sets go on whole.

Equal sets are one from the start. All sets that share a key and may be alike are candidates, but a pair is compared only if no links join
it already. First each set is compared with one other: of the sets that come first under its keys that with which it shares most
keys. Then it is compared with up to LEADERS sets of other groups, each key putting another set first, and that TURNS times. Last,
under each key of up to FEW sets those outside its largest group are compared with all that are in another group than their own. Sets
of more crowded keys meet at their rare shingles instead: in the order of how many of these sets have a shingle, similar sets share one among the
first ones, and have enough left after it. That loses no pair, and pages of one template, which share only what all of them have, are not compared at all. So groups are those of
all candidates, and a large group costs a few comparisons for each of its sets.

Texts without words are one group. Sets of three shingles or fewer are similar to equal ones only and have no keys. Rows
that share doc_id and text are one document; rows that share only doc_id are different ones. A group's first document is that
of smallest doc_id (null last), then of smallest text hash. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common, golay
from tessera.llm.chunks import pieces_of
from tessera.llm.components import components

SHINGLE_WORDS = 5
LEAST = 0.8
SEED = 42
SEGMENTS, NEAREST, TOGETHER = 14, 1, 2
PLACES = SEGMENTS * 23
ALIKE = 0.8
OTHERS, APART = 128, 50
MEETING = 256  # sets of a key that are held against each other by their signs
LEADERS, TURNS = 8, 1
FEW = 8  # sets of a key of which all pairs may be compared
FANOUT = 1000  # pairs of one set that are compared in one task
PIECE = 100_000  # bytes of text at once
ROWS = 512  # sketches at once
PARTS = 32
#: For each byte a word with its bits in eight lanes of a byte.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The different shingles' hashes, in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    whole = np.full(n, SEED, np.uint64)
    for i in range(min(width, len(words))):
        whole = (whole ^ hashes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        whole ^= whole >> np.uint64(29)
    return np.unique(whole)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of PLACES margins (-127 to 127) for each set: ones minus zeros among its hashes' bits, scaled down if need be."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros((len(sets), PLACES), np.float32)
    some = np.flatnonzero(sizes)
    if len(some):
        flat = np.concatenate(sets)
        ends = np.cumsum(sizes[some])
        # sums of up to 255 rows fit a lane; of those parts a few at a time are spread to lanes
        parts = [np.arange(e - n, e, 255) for e, n in zip(ends.tolist(), sizes[some].tolist())]
        starts = np.append(np.concatenate(parts), len(flat))
        ones = np.empty((len(starts) - 1, 64 * -(-PLACES // 64)), np.uint8)
        for one in range(0, len(ones), PARTS):
            last = min(len(ones), one + PARTS)
            rows = flat[starts[one] : starts[last]]
            words = np.stack([mixed(rows, i) for i in range(-(-PLACES // 64))], axis=1)
            ones[one:last] = np.add.reduceat(LANES[words.view(np.uint8)], starts[one:last] - starts[one], axis=0).view(np.uint8)
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))[:-1]])
        margins = 2 * np.add.reduceat(ones, first, axis=0, dtype=np.int64)[:, :PLACES] - sizes[some, None]
        out[some] = np.rint(margins * np.minimum(1, 127 / np.maximum(1, np.abs(margins).max(axis=1, keepdims=True))))
    return out.astype(np.int8)


def fuzzy_keys(margins: np.ndarray) -> np.ndarray:
    """A row of keys for each sketch: which segments, and a codeword for each."""
    at = golay.nearest(margins.reshape(-1, 23), NEAREST).reshape(len(margins), SEGMENTS, NEAREST)
    found = []
    for number, chosen in enumerate(combinations(range(SEGMENTS), TOGETHER)):
        keys = np.full((len(margins), 1), number, np.int64)
        for segment in chosen:
            keys = (keys[:, :, None] << 12 | at[:, segment, None, :]).reshape(len(margins), -1)
        found.append(keys)
    return np.concatenate(found, axis=1)


def other_signs(margins: np.ndarray) -> np.ndarray:
    """A row for each sketch, a pair of words for each of its keys: OTHERS signs of places outside the key's segments."""
    signs = margins > 0
    at = [np.setdiff1d(np.arange(PLACES), np.add.outer(np.array(chosen) * 23, np.arange(23)).ravel())[::2][:OTHERS] for chosen in combinations(range(SEGMENTS), TOGETHER)]
    every = np.repeat(np.stack(at), NEAREST**TOGETHER, axis=0)
    return np.packbits(signs[:, every], axis=2).view(np.int64)


def may_meet(s: np.ndarray, n: np.ndarray, signs: np.ndarray, least: float) -> np.ndarray:
    """Which rows, sorted by s, have another one of the same s that may be similar."""
    kept = np.zeros(len(s), bool)
    signs = signs.view(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    left = np.repeat(np.append(starts[1:], len(s)), np.diff(np.append(starts, len(s)))) - np.arange(len(s))  # rows from here to the run's end
    one = np.flatnonzero(left > 1)
    for lag in range(1, len(s)):
        one = one[left[one] > lag]
        if not len(one):
            break
        two = one + lag
        near = np.bitwise_count(signs[one] ^ signs[two]).sum(axis=1) <= APART
        near &= np.minimum(n[one], n[two]) >= np.maximum(n[one], n[two]) * least - 1e-6
        kept[one[near]] = kept[two[near]] = True
    return kept


def _meeting(least: float) -> Callable:
    """Rows (s, key, n, x, y) sorted by s: those that may meet another one, by runs of s. Of a run longer than MEETING every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = None, None  # rows of the run that is not at its end; the key of a run that goes on whole
        for whole in chain(batches, [None]):
            parts = [b for b in (held, whole) if b is not None and b.num_rows]
            if not parts:
                continue
            batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            s, n, x, y = (batch[c].to_numpy() for c in ("s", "n", "x", "y"))
            edges = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            many = np.repeat(np.diff(edges) > MEETING, np.diff(edges))
            if crowded is not None:
                many |= s == crowded
            end = len(s) if whole is None or many[-1] else int(edges[-2])
            crowded = s[-1] if many[-1] else None
            kept, few = many.copy(), np.flatnonzero(~many[:end])
            kept[few] = may_meet(s[few], n[few], np.stack([x[few], y[few]], axis=1), least)
            held = batch.slice(end) if end < len(s) else None
            yield batch.select(["s", "key", "n"]).filter(pa.array(kept))

    return run


def _sketched(width: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            pa.default_memory_pool().release_unused()
            for batch in pieces_of(whole, PIECE):
                sets = [shingles(t.as_py(), width) for t in batch["text"]]
                keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                sizes = pa.array(np.fromiter(map(len, sets), np.int32, len(sets)))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["t"], pa.array(keys), sizes, pa.array([m.tobytes() for m in sketches(sets)], pa.binary())], names=["doc_id", "t", "key", "n", "sketch"])

    return run


def _margins(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, PLACES)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (whole.slice(first, ROWS) for whole in batches for first in range(0, whole.num_rows, ROWS))


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        margins = _margins(batch["sketch"])
        found, signs = fuzzy_keys(margins), other_signs(margins).reshape(-1, 2)
        every = pa.array(np.repeat(np.arange(batch.num_rows), found.shape[1]))
        yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), batch["key"].take(every), batch["n"].take(every), pa.array(signs[:, 0]), pa.array(signs[:, 1])], names=["s", "key", "n", "x", "y"])


def _alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        x, y = _margins(batch["x"]).astype(np.float32), _margins(batch["y"]).astype(np.float32)
        cosine = (x * y).sum(axis=1) / np.maximum(1e-9, np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)))
        yield batch.select(["a", "b"]).filter(pa.array(cosine >= ALIKE))


def _sets(width: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of(whole, PIECE):
                sets = [shingles(t.as_py(), width).view(np.int64) for t in batch["text"]]
                yield pa.RecordBatch.from_arrays([batch["key"], pa.array(sets, pa.list_(pa.int64()))], names=["key", "value"])

    return run


def _both(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """a, b, x, y: pairs with the values of both sides' sets; values: key, value. Sets of more than FANOUT pairs, where there are such, are dealt over tasks."""
    met = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.ceil(F.count("*") / FANOUT).cast("int").alias("deals"))
    busy = met.where("deals > 1")
    if busy.isEmpty():
        return pairs.join(values.toDF("a", "x"), "a").join(values.toDF("b", "y"), "b").select("a", "b", "x", "y")
    busy = common.save(busy, "busy-sets")  # a set for FANOUT pairs at most
    deals = F.coalesce("deals", F.lit(1))
    for side, name in (("a", "x"), ("b", "y")):
        own = common.beside(busy).withColumnRenamed("key", side)
        dealt = pairs.join(own, side, "left").withColumn("deal", F.pmod(F.hash("a", "b"), deals)).drop("deals")
        owned = values.toDF(side, name).join(own, side, "left").select(side, F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"), name)
        pairs = dealt.join(owned, [side, "deal"]).drop("deal")
    return pairs.select("a", "b", "x", "y")


def linked(sets: DataFrame, shingled: Callable[[DataFrame], DataFrame], least: float) -> DataFrame:
    """(node, root) of the sets that are similar to another one, the components of all candidates. sets: key, n, sketch, each key once; shingled: key, value for a table of keys.

    Whatever the corpus, there are some dozens of queries here, and the driver plans each anew as its shuffles end. So what a step reads
    several times is saved, and groups are made anew only after links were found.
    """
    fuzzy = sets.where("n > 3").select("sketch", "key", "n").mapInArrow(_keyed, "s long, key long, n int, x long, y long")
    keyed = common.save(fuzzy.repartition("s").sortWithinPartitions("s").mapInArrow(_meeting(least), "s long, key long, n int"), "shared-keys")
    if keyed.isEmpty():
        return keyed.select(F.col("key").alias("node"), F.col("key").alias("root"))
    fits = (F.col("an") >= F.col("bn") * least - 1e-6) & (F.col("bn") >= F.col("an") * least - 1e-6)

    def verified(pairs: DataFrame) -> DataFrame:
        near = common.save(_both(pairs, sets.select("key", F.col("sketch").alias("value"))).mapInArrow(_alike, "a long, b long"), "alike-pairs")
        owned = common.save(shingled(near.select(F.explode(F.array("a", "b")).alias("key")).distinct()), "shingle-sets")
        shared_by_both = F.size(F.array_intersect("x", "y"))
        similar = shared_by_both + 1e-9 >= least * (F.size("x") + F.size("y") - shared_by_both)
        found = common.save(_both(near, owned).where(similar).select("a", "b"), "similar-pairs")
        common.drop_saved(near, owned)
        return found

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def to_leaders(rows: DataFrame, order, most: int) -> DataFrame:
        """Each set with some of other groups: of those that order puts first under its keys the ones with which it shares most of them."""
        leader = rows.groupBy("s").agg(F.min(F.struct(order.alias("o"), "key", "n", "root")).alias("l")).select("s", "l.*").drop("o")
        leader = leader.toDF("s", "a", "an", "aroot")
        met = rows.select("s", F.col("key").alias("b"), F.col("n").alias("bn"), "root").join(leader, "s").where(F.col("root") != F.col("aroot")).where(fits)
        counted = met.groupBy("a", "b").count()
        best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("count"), F.xxhash64("a", "b")))
        return counted.withColumn("at", best).where(F.col("at") <= most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def across_groups(rows: DataFrame, more: tuple[str, ...] = (), meet=F.lit(True)) -> DataFrame:
        """All pairs of a key's sets that are in different groups and meet: the sets outside the key's largest group with all others. rows: s, key, n, root and more."""
        largest = rows.groupBy("s", "root").count().groupBy("s").agg(F.max(F.struct("count", "root")).alias("l")).select("s", F.col("l.root").alias("main"))
        outside = rows.join(largest, "s").where(F.col("root") != F.col("main")).select("s", F.col("key").alias("a"), *(F.col(c).alias("a" + c) for c in ("n", "root", *more)))
        return ordered(outside.join(rows.select("s", F.col("key").alias("b"), F.col("n").alias("bn"), "root", *(F.col(c).alias("b" + c) for c in more)), "s").where((F.col("root") != F.col("aroot")) & meet & fits))

    def by_rare_shingles(rows: DataFrame) -> DataFrame:
        """Pairs of sets (key, n, root) in different groups that may be similar, by their rare shingles.

        A set's shingles are put in the order of how many of the sets have them. Two sets share no shingle before their first common one, at places
        i and j; so they share at most one and what both have after it, which for similar sets is enough. That
        shingle is among the first ones, one more than a similar set may lack.
        """
        each = common.save(shingled(rows.select("key")).select("key", F.size("value").alias("n"), F.explode("value").alias("s")), "shingles")
        shared = each.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
        known = each.join(shared, "s")  # those of one set alone come first and meet nothing
        place = F.row_number().over(Window.partitionBy("key").orderBy("df", "s"))
        alone = F.col("n") - F.count("*").over(Window.partitionBy("key"))
        most = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-6) + 1
        rare = known.withColumn("at", alone + place).where(F.col("at") <= most).select("s", "key", "n", "at")
        kept = common.save(rare.join(rows.select("key", "root"), "key"), "rare-shingles")
        common.drop_saved(each)
        after = F.least(F.col("an") - F.col("aat"), F.col("bn") - F.col("bat"))
        return across_groups(kept, ("at",), 1 + after + 1e-6 >= least / (1 + least) * (F.col("an") + F.col("bn")))

    def across(rows: DataFrame) -> DataFrame:
        """The pairs of keys of few sets; the sets of crowded keys meet at rare shingles, which unlike sets of one template don't share."""
        sized = rows.join(rows.groupBy("s").agg(F.count("*").alias("size")), "s")
        crowd = common.save(sized.where(F.col("size") > FEW).select("key", "n", "root").distinct(), "crowded-sets")
        few = sized.where(F.col("size") <= FEW).drop("size").join(crowd.select("key", F.lit(1).alias("crowded")), "key", "left").fillna(0, ["crowded"])
        pairs = across_groups(common.save(few, "few-sets"), ("crowded",), F.col("acrowded") + F.col("bcrowded") < 2)
        return pairs if crowd.isEmpty() else pairs.unionByName(by_rare_shingles(crowd))

    def grouped(roots: DataFrame) -> DataFrame:
        """s, key, n, root of the keys whose sets are in several groups."""
        rows = keyed.join(roots, F.col("key") == F.col("node"), "left").select("s", "key", "n", F.coalesce("root", "key").alias("root"))
        rows = common.save(rows, "grouped-sets")
        still = rows.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("s")
        opened = common.save(rows.join(still, "s"), "open-keys")
        common.drop_saved(rows)
        return opened

    tried = common.save(to_leaders(keyed.withColumn("root", F.col("key")), F.col("key"), 1), "compared-pairs")
    found = verified(tried)
    roots = components(found)
    rows = grouped(roots)
    by_turns = lambda turn: lambda rows: to_leaders(rows, F.xxhash64("key", "s", F.lit(turn)), LEADERS)
    for step in (*map(by_turns, range(TURNS)), across):
        if rows.isEmpty():
            break
        more = common.save(step(rows).join(tried, ["a", "b"], "left_anti"), "compared-pairs")
        if more.isEmpty():
            continue
        new, tried = verified(more), tried.unionByName(more)
        if not new.isEmpty():
            found = found.unionByName(new)
            roots = components(found)
            if step is not across:
                common.drop_saved(rows)
                rows = grouped(roots)
    common.drop_saved(keyed, rows)
    return roots


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, least: float = LEAST) -> DataFrame:
    """doc_id, t (xxhash64 of the text), copies (rows of that doc_id and text), is_first, and the group's first: first_id, first_t; one row a document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col("text").cast("string").alias("text"))
    rows = common.save(docs.mapInArrow(_sketched(width), "doc_id long, t long, key long, n int, sketch binary"), "sketches")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    groups = common.save(rows.groupBy("key").agg(F.min(place).alias("first"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "different-sets")

    def shingled(keys: DataFrame) -> DataFrame:
        wanted = common.save(groups.join(keys, "key").select("key", F.col("first.doc_id").alias("d"), F.col("first.t").alias("dt")), "wanted-texts")
        texts = docs.join(common.beside(wanted), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt"))).select("key", "text")
        return texts.mapInArrow(_sets(width), "key long, value array<long>").dropDuplicates(["key"])

    named = groups.join(linked(groups, shingled, least).withColumnRenamed("node", "key"), "key", "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    firsts = named.groupBy("root").agg(F.min("first").alias("of_group"))
    named = common.save(named.join(firsts, "root").select("key", "of_group"), "named-sets")
    each = rows.groupBy("doc_id", "t", "key").agg(F.count("*").alias("copies")).join(named, "key")
    first = F.col("doc_id").eqNullSafe(F.col("of_group.doc_id")) & (F.col("t") == F.col("of_group.t"))
    return each.select("doc_id", "t", "copies", first.alias("is_first"), F.col("of_group.doc_id").alias("first_id"), F.col("of_group.t").alias("first_t"))

"""Near copies by similarity: texts whose sets of five-word shingles overlap by 0.8 of their union or more. SimHash tiles find most; prefixes find what fingerprints miss."""

from __future__ import annotations

from collections.abc import Iterator, Sequence, Sized
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from quirefold.llm import simhash
from quirefold.llm.common import cut, discard, small
from quirefold.llm.graph import components

SHINGLE, SEED = 5, 42
#: Texts from which common shingles are learned. They are put last in the order of shingles, which changes the work and not the result.
SAMPLE, LISTED = 8000, 200_000
#: A set, or a part of it, is compared by so many bits, and parts have no more items than that on average.
BITS = 512
#: So many first items of a part's prefix go with each of its rows: parts that share one of them meet there.
FIRST = 4
#: Columns of the rows of an item, which a tile compares; n, pos, bits and first are those of the part.
CARRIED = ("fp", "n", "pos", "class", "bits", "first")


def hashes(raw: bytes | None) -> np.ndarray:
    """The hashes of the lower-cased words' shingles, repeats included; a text of fewer words is one shingle, and no words have none."""
    words = (raw or b"").decode("utf-8", "surrogateescape").lower().encode("utf-8", "surrogateescape").split()
    if not words:
        return np.zeros(0, np.uint64)
    found = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else iter([b" ".join(words)])
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64)


def shingles(raw: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(hashes(raw).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the intersection is 0.8 of the union at least."""
    least = 4 * (len(a) + len(b))
    if 9 * min(len(a), len(b)) < least:
        return False
    return 9 * (len(a) + len(b) - len(np.unique(np.concatenate([a, b])))) >= least


def _id(items: np.ndarray) -> int:
    return simhash._signed(xxhash.xxh64_intdigest(items.astype("<i8").tobytes(), SEED))


def _raw(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def set_id_of(text: Column) -> Column:
    """A hash of the text's set of shingles."""
    return F.arrow_udf(lambda texts: pa.array([_id(shingles(x.as_py())) for x in texts], pa.int64()), LongType())(_raw(text))


def prints_of(text: Column, common: np.ndarray, times: np.ndarray) -> Column:
    """A struct of the set's id fp, its SimHash sim, its size n, its bits, and its parts, with a prefix each: the first items in an order that all texts share.

    Sets that are similar share an item of the prefixes of a part, whatever the order (see _parts). Common items (sorted) come last, by their times.
    A bit tells whether an odd number of the items fall on it, so that sets differ in as many items as bits at least.
    """

    def one(raw: bytes | None) -> tuple[int, int, int, bytes, list[tuple]]:
        every = hashes(raw)
        items = np.unique(every.view(np.int64))
        ordered = items
        if len(items) and len(common):
            at = np.minimum(np.searchsorted(common, items), len(common) - 1)
            ordered = items[np.argsort(np.where(common[at] == items, times[at], 0), kind="stable")]
        return _id(items), simhash._signed(simhash.majority(every)), len(items), _parity(items, BITS).tobytes(), _parts(ordered)

    def prints(texts: pa.Array) -> pa.Array:
        fp, sim, n, bits, parts = zip(*[one(x.as_py()) for x in texts], strict=True) if len(texts) else ((),) * 5
        part, size, part_bits, first, prefix = zip(*[x for each in parts for x in each], strict=True) if any(parts) else ((),) * 5
        columns = [pa.array(part, pa.int32()), pa.array(size, pa.int32()), pa.array(part_bits, pa.binary()), pa.array(first, pa.binary())]
        columns.append(_lists(prefix, pa.array(np.concatenate([np.zeros(0, np.int64), *prefix]))))
        split = _lists(parts, pa.StructArray.from_arrays(columns, ["part", "n", "bits", "first", "prefix"]))
        return pa.StructArray.from_arrays([pa.array(fp, pa.int64()), pa.array(sim, pa.int64()), pa.array(n, pa.int32()), pa.array(bits, pa.binary()), split], ["fp", "sim", "n", "bits", "parts"])

    return F.arrow_udf(prints, "fp long, sim long, n int, bits binary, parts array<struct<part: int, n: int, bits: binary, first: binary, prefix: array<long>>>")(_raw(text))


def _lists(each: Sequence[Sized], flat: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), flat)


def _parts(ordered: np.ndarray) -> list[tuple[int, int, bytes, bytes, np.ndarray]]:
    """The parts of a set of ordered items: number, size, bits, the FIRST of the prefix as bytes, and the prefix.

    A set of over BITS items is cut by hash into a power of two of parts, so that bits tell parts apart however large sets are. If two sets differ in at most a ninth of their sizes' sum,
    so do their parts of some number: those are similar too, and share an item of their prefixes. Sets of similar sizes may be cut
    differently: one that is at most 5 : 4 above a step is cut as those below it are besides. Items of each way to cut are other items.
    """
    n, out = len(ordered), []
    level = (-(-n // BITS) - 1).bit_length() if n else 0
    for v in [level, level - 1] if level and 4 * n <= 5 * BITS << (level - 1) else [level]:
        of = (ordered >> 40) & ((1 << v) - 1)
        for b in np.unique(of):
            own = ordered[of == b]
            prefix = own[: len(own) - (4 * len(own) + 4) // 5 + 1] ^ simhash._signed(v * 0x9E3779B97F4A7C15 % (1 << 64))
            first = np.zeros(FIRST, "<i8")
            first[: len(prefix)] = prefix[:FIRST]
            out.append(((1 << v) + int(b), len(own), _parity(own, BITS).tobytes(), first.tobytes(), prefix))
    return out


def _parity(items: np.ndarray, n: int) -> np.ndarray:
    return np.packbits((np.bincount(items & (n - 1), minlength=n) & 1).astype(bool))


def parity(items: np.ndarray) -> np.ndarray:
    """A set's wide bits, packed: like those of prints_of(), but as many as a power of two from four times its size on."""
    return _parity(items, max(BITS, 1 << int(4 * len(items) - 1).bit_length()) if len(items) else BITS)


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """In how many wide bits two sets differ; the longer row of bits is folded to the length of the other."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) < len(y) else (y, x)
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def _items_of(text: Column) -> Column:
    """A struct of the set's id fp, its size n, its items as bytes and its wide bits."""

    def sets(texts: pa.Array) -> pa.Array:
        found = [shingles(x.as_py()) for x in texts]
        columns = [
            pa.array([_id(x) for x in found], pa.int64()),
            pa.array([len(x) for x in found], pa.int64()),
            pa.array([x.astype("<i8").tobytes() for x in found], pa.binary()),
            pa.array([parity(x).tobytes() for x in found], pa.binary()),
        ]
        return pa.StructArray.from_arrays(columns, ["fp", "n", "items", "wide"])

    return F.arrow_udf(sets, "fp long, n long, items binary, wide binary")(_raw(text))


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample by hash hold, in order, and how many do."""
    share = max(1, texts.count() // SAMPLE)
    each = F.arrow_udf(lambda found: pa.array([shingles(x.as_py()) for x in found], pa.list_(pa.int64())), "array<long>")(_raw(F.col("text")))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    counts = sample.select(F.explode(each).alias("item")).groupBy("item").agg(F.count("*").cast("int").alias("n"))
    counts = cut(counts.where("n > 2"))
    rows = counts.orderBy(F.desc("n"), "item").limit(LISTED).toArrow().sort_by("item")
    discard(counts)
    return rows["item"].to_numpy(), rows["n"].to_numpy()


def _few_bits(n: pa.Array, m: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """Whether sets of sizes n and m can be similar, by the number of their bits that differ."""
    one, two = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, BITS // 8) for v in (x, y))
    return pa.array(np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64) * 9 <= n.to_numpy().astype(np.int64) + m.to_numpy())


def _both(pairs: DataFrame, each: DataFrame) -> DataFrame:
    """pairs (a, b) with the columns of each (fp) for a, named a_ and so on, and for b."""
    one, two = (each.select(*[F.col(c).alias(f"{x}_{c}") for c in each.columns]) for x in "ab")
    return pairs.join(two, F.col("b") == F.col("b_fp")).join(one, F.col("a") == F.col("a_fp"))


def _verified(pairs: DataFrame, each: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b), a written table, whose sets are similar.

    Pairs that their wide bits don't tell apart are compared as sets, made again from texts (doc_id, text) of the keys in each (fp, key).
    """
    ids = pairs.select(F.col("a").alias("_fp")).union(pairs.select(F.col("b").alias("_fp"))).distinct()
    ids = cut(each.join(ids, each["fp"] == ids["_fp"]).select("_fp", F.col("key").alias("_key")))
    again = texts.join(small(ids.select("_key").distinct()), F.col("doc_id").eqNullSafe(F.col("_key")), "left_semi")
    made = again.select(_items_of(F.col("text")).alias("s")).select("s.*")
    sets = cut(made.join(small(ids), made["fp"] == ids["_fp"], "left_semi"))
    if sets.count() > ids.count():  # a key is repeated
        once = cut(sets.dropDuplicates(["fp"]))
        discard(sets)
        sets = once
    apart = F.arrow_udf(lambda x, y: pa.array([differing(np.frombuffer(p.as_py(), np.uint8), np.frombuffer(q.as_py(), np.uint8)) for p, q in zip(x, y, strict=True)], pa.int64()), LongType())
    left = cut(_both(pairs, sets.select("fp", "n", "wide")).where(apart("a_wide", "b_wide") * 9 <= F.col("a_n") + F.col("b_n")).select("a", "b"))
    near = F.arrow_udf(lambda x, y: pa.array([similar(np.frombuffer(p.as_py(), "<i8"), np.frombuffer(q.as_py(), "<i8")) for p, q in zip(x, y, strict=True)], pa.bool_()), BooleanType())
    found = cut(_both(left, sets.select("fp", "items")).where(near("a_items", "b_items")).select("a", "b"))
    discard(ids, left, sets)
    return found


def _fingerprint_pairs(each: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that connect all those whose SimHashes are linked by simhash.links(): each fingerprint's sets with the least of them, and linked fingerprints by their least sets."""
    least = cut(each.groupBy("sim").agg(F.min("fp").alias("least")))
    same = each.join(least, "sim").where("fp > least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    near = simhash.links(least.select(F.col("sim").alias("fp")))
    one, two = (least.select(F.col("sim").alias(f"_{x}"), F.col("least").alias(f"_{x}_least")) for x in "ab")
    near = near.join(one, near["a"] == one["_a"]).join(two, near["b"] == two["_b"])
    return same.union(near.select(F.least("_a_least", "_b_least").alias("a"), F.greatest("_a_least", "_b_least").alias("b")))


def _fitting(x: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs p[k], q[k] of an item's rows that can be similar by size, place of the item and bits, aren't connected yet and don't meet at an earlier item too; and the share of bits that differ."""
    apart = x["class"][p] != x["class"][q]
    p, q = p[apart], q[apart]
    both = x["n"][p] + x["n"][q]
    fits = np.minimum(x["n"][p] - x["pos"][p], x["n"][q] - x["pos"][q]) * 9 >= both * 4
    p, q, both = p[fits], q[fits], both[fits]
    differ = np.bitwise_count(x["bits"][p] ^ x["bits"][q]).sum(axis=1, dtype=np.int64)
    near = differ * 9 <= both
    p, q, share = p[near], q[near], differ[near] / both[near]
    met = np.zeros(len(p), bool)
    for i in range(FIRST):
        for j in range(FIRST):
            met |= (x["first"][p, i] == x["first"][q, j]) & (x["pos"][p] > i) & (x["pos"][q] > j)
    return p[~met], q[~met], share[~met]


def _nearest(x: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs between classes, a forest of the nearest: each class with the nearest other, then what they make with the nearest other, until all that pairs connect is connected."""
    order = np.argsort(share, kind="stable")
    p, q = p[order], q[order]
    one, two = (np.unique(x["class"], return_inverse=True)[1][v] for v in (p, q))
    root = np.arange(int(max(one.max(initial=0), two.max(initial=0))) + 1)
    chosen = [np.zeros(0, np.int64)]
    left = np.arange(len(p))
    while len(left := left[root[one[left]] != root[two[left]]]):
        best = np.full(len(root), len(p))
        np.minimum.at(best, root[one[left]], left)
        np.minimum.at(best, root[two[left]], left)
        chosen.append(np.unique(best[best < len(p)]))
        simhash._union(root, one[chosen[-1]], two[chosen[-1]])
    chosen = np.concatenate(chosen)
    return p[chosen], q[chosen]


def _in_tile(x: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """The fitting pairs of one large tile, by sub-tiles in the order of sizes; sub-tiles of distant sizes are passed over."""
    order, step = np.argsort(x["n"], kind="stable"), simhash.SUBTILE
    n, side = x["n"][order], x["side"][order]
    found = [(order[:0], order[:0], np.zeros(0))]
    for i in range(0, len(n), step):
        for j in range(i, len(n), step):
            if n[j] * 4 > n[min(i + step, len(n)) - 1] * 5:
                break
            a, b = np.meshgrid(np.arange(i, min(i + step, len(n))), np.arange(j, min(j + step, len(n))), indexing="ij")
            meet = (a < b) & (side[a] != side[b]) if side[0] else a < b
            found.append(_fitting(x, order[a[meet]], order[b[meet]]))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _pairs_of(x: dict[str, np.ndarray], every: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of whole tiles: all that fit, or a forest of the nearest."""
    tile = x["tile"]
    if not len(tile):
        return
    start = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    size = np.diff(np.r_[start, len(tile)])
    at = np.flatnonzero(np.repeat(size <= 64, size))
    found = [(at[:0], at[:0], np.zeros(0))]
    for d in range(1, 64):
        same = np.flatnonzero(tile[at[d:]] == tile[at[:-d]])
        if not len(same):
            break
        found.append(_fitting(x, at[same], at[same + d]))
    several = [tuple(np.concatenate(v) for v in zip(*found, strict=True))]
    for s, n in zip(start[size > 64], size[size > 64], strict=True):
        p, q, share = _in_tile({c: v[s : s + n] for c, v in x.items()})
        several.append((p + s, q + s, share))
    for p, q, share in several:
        p, q = (p, q) if every else _nearest(x, p, q, share)
        if len(p):
            a, b = x["fp"][p], x["fp"][q]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _compare(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """Whole tiles at a time, from batches sorted by tile."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        x = {c: batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fp", "n", "pos", "class", "side", "tile")}
        x["bits"] = np.frombuffer(b"".join(batch["bits"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
        x["first"] = np.frombuffer(b"".join(batch["first"].to_pylist()), "<i8").reshape(-1, FIRST)
        x = x if held is None else {c: np.concatenate([held[c], v]) for c, v in x.items()}
        last = int(np.searchsorted(x["tile"], x["tile"][-1])) if len(x["tile"]) else 0
        yield from _pairs_of({c: v[:last] for c, v in x.items()}, every)
        held = {c: v[last:] for c, v in x.items()}
    if held is not None:
        yield from _pairs_of(held, every)


def _item_pairs(rows: DataFrame, every: bool, tile: int = simhash.TILE) -> DataFrame:
    """Pairs (a, b) of the sets of an item that fit and are of different classes, from rows (CARRIED, item, hot): all, or a forest of the nearest.

    An item's rows are a tile. Those of a hot item are cut by size and hash, and the parts are compared in pairs, as simhash.links() does.
    """
    tiles = rows.where("NOT hot").select(*CARRIED, F.lit(0).cast("byte").alias("side"), F.col("item").alias("tile"))
    hot = rows.where("hot")
    if not hot.isEmpty():
        # sizes within 5 : 4 are in the same class of sizes or in neighbouring ones
        sized = hot.select(*CARRIED, F.col("item").alias("key"), F.floor(F.log(1.2501, F.col("n"))).cast("int").alias("pop"))
        tiles = tiles.union(simhash._split_tiles(sized, tile, 1, CARRIED))
    dealt = tiles.repartition("tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(partial(_compare, every=every), "a long, b long").distinct()


def links(each: DataFrame, texts: DataFrame, tile: int = simhash.TILE) -> DataFrame:
    """Links (a, b) that connect all similar sets of each (fp, sim, n, bits, parts, key), a written table of distinct sets, which are those of texts (doc_id, text). The table is discarded.

    Sets whose SimHashes are linked are compared first. Similar sets share an item of the prefixes of a part, and at the first that they share enough items of the part follow. The sets of an item
    that aren't connected yet are tiles, whose pairs are told apart by the part's bits where they are, and given by one item of the part instead of all that they share: first a forest of the nearest pairs is compared as sets, so that a large group of near copies
    is not compared pair by pair, and then all pairs that are still not connected. Every link given is of sets that were compared as a whole.
    """
    slim = cut(each.drop("parts"))
    split = F.explode("parts").alias("s")
    pieces = cut(each.select(F.col("fp").alias("_fp"), split).select("_fp", F.col("s.part").alias("_part"), "s.bits", "s.first"))
    few = F.arrow_udf(_few_bits, BooleanType())
    near = _both(_fingerprint_pairs(slim), slim.select("fp", "n", "bits")).where(few("a_n", "b_n", "a_bits", "b_bits")).select("a", "b")
    near = cut(near)
    found = _verified(near, slim, texts)
    discard(near)
    items = _classed(each.select("fp", "parts"), found).select("fp", "class", split).select("fp", "class", "s.part", "s.n", F.posexplode("s.prefix").alias("pos", "item"))
    shared = items.groupBy("item").agg(F.min("class").alias("_x"), F.max("class").alias("_y"), F.count("*").alias("_n")).where("_x < _y")
    shared = cut(shared.select(F.col("item").alias("_item"), (F.col("_n") > tile).alias("hot")))
    rows = cut(items.join(small(shared), items["item"] == shared["_item"]).select("item", "fp", "part", "n", "pos", "class", "hot"))
    discard(each, shared)
    wide = rows.join(pieces, (rows["fp"] == pieces["_fp"]) & (rows["part"] == pieces["_part"]))
    nearest = cut(_item_pairs(wide, False, tile))
    found = cut(found.union(_verified(nearest, slim, texts)))
    wide = _classed(wide.drop("class"), found)
    others = cut(_item_pairs(wide, True, tile).join(nearest, ["a", "b"], "left_anti"))
    out = cut(found.union(_verified(others, slim, texts)))
    discard(rows, slim, pieces, nearest, others)
    return out


def _classed(sets: DataFrame, found: DataFrame) -> DataFrame:
    """sets (fp, ...) with class: the component that the links found put them in, or themselves."""
    classed = components(found).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return sets.join(small(classed), sets["fp"] == classed["_node"], "left").select(*sets.columns, F.coalesce("_root", "fp").alias("class"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", tile: int = simhash.TILE) -> DataFrame:
    """One document of each component of similar documents, with the columns of docs: that of the smallest key. Blank texts are similar to each other."""
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    whole = cut(texts.select("doc_id", prints_of(F.col("text"), *_common(texts)).alias("s")))
    prints = cut(whole.select("doc_id", "s.fp"))
    each = whole.groupBy("s.fp").agg(*[F.first(f"s.{c}").alias(c) for c in ("sim", "n", "bits", "parts")], F.min("doc_id").alias("key"))
    each = cut(each)
    discard(whole)
    return simhash.first_of(docs, prints, simhash.classes(prints, lambda _: links(each, texts, tile)), set_id_of, key, text)

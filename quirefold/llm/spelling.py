"""Groups of spelling variants: words one edit apart, found by bands of letter parities."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import LOWER, UPPER, bind, cut, discard, fresh, small

SHORTEST, LEAST, TIMES, ONE_IN = 7, 2, 10, 31
#: Letters of words, after A-Z are lowered.
RUN = "[a-zÀ-ÿ]+"
LETTERS = [*LOWER, *map(chr, range(0xC0, 0x100))]
#: Three bands of so many bits make a mask of 63.
BAND = 21
FIRST = (1 << BAND) - 1
#: Larger tiles, by rows or by bytes of words, are cut into parts that are compared in pairs.
TILE, TILE_BYTES = 8192, 16_000_000
#: Longer words share the length of the key; their own lengths still decide.
LENGTHS = (1 << 18) - 1
_TILE_SCHEMA = "tile long, side byte, mask long, word string, n long"


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): runs of letters of all whole texts, A-Z lowered, one in 31 of them with a letter deleted by checksum; those of 7 letters and 2 occurrences at least.

    Null texts have none. Null keys count as empty in the checksum. Counts are summed map-side, so a word that is in every text is no burden.
    """
    (run,) = fresh("run")
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias(run))
    runs = runs.where(F.char_length(run) >= SHORTEST).withColumn("h", F.crc32(F.concat("key", F.lit(":"), F.col(run)).cast("binary")))
    at = (F.col("h") % F.char_length(run)).cast("int")
    cutout = F.concat(F.substring(F.col(run), F.lit(1), at), F.substring(F.col(run), at + 2, F.char_length(run)))
    found = runs.select(F.when(F.col("h") % ONE_IN == 0, cutout).otherwise(F.col(run)).alias("word"))
    return found.where(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


def bits_of_letters(listed: DataFrame) -> dict[str, int]:
    """A mask bit for each letter: bands in turn take the letters that split the words best, so each band tells as much apart. At most one row a letter is collected."""
    seen = listed.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).groupBy("letter").count().collect()
    total, counts = max((r["count"] for r in seen), default=0), {r["letter"]: r["count"] for r in seen}
    order = sorted(LETTERS, key=lambda x: (abs(2 * counts.get(x, 0) - total), x))
    return {x: [0, 1, 2, 2, 1, 0][i % 6] * BAND + i // 3 % BAND for i, x in enumerate(order)}


def masks(found: pa.Array, bits: dict[str, int]) -> np.ndarray:
    """For each word, the letters that it has an odd number of times. Letters may share a bit; one edit flips two bits at most in any case."""
    table = np.zeros(0x100, np.int64)
    for x, i in bits.items():
        table[ord(x)] = 1 << i
    text = found.to_pylist()
    sizes = np.fromiter(map(len, text), np.int64, len(text))
    codes = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32)
    return np.bitwise_xor.reduceat(table[codes], np.r_[0, np.cumsum(sizes)[:-1]]) if len(text) else np.zeros(0, np.int64)


def tile_rows(word: pa.Array, n: pa.Array, bits: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """The rows of words in their tiles.

    A replaced letter flips two bits, so one of the three bands at least stays, and the length: a tile for each band, its value and a length.
    A letter more flips one bit, so two bands stay: a tile for each two bands, their values and the lesser length, the shorter words on side 1, the longer on side 2.
    """
    mask = masks(word, bits)
    length = np.fromiter(map(len, word.to_pylist()), np.int64, len(word))
    band = [mask >> (BAND * b) & FIRST for b in range(3)]

    def rows(kind: int, value: np.ndarray, size: np.ndarray, side: int) -> pa.RecordBatch:
        key = kind | value << 3 | np.minimum(size, LENGTHS) << (3 + 2 * BAND)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), side, np.int8)), pa.array(mask), word, n], ["tile", "side", "mask", "word", "n"])

    for b in range(3):
        two = band[(b + 1) % 3] | band[(b + 2) % 3] << BAND
        yield rows(b, band[b], length, 0)
        yield rows(3 + b, two, length, 1)
        yield rows(3 + b, two, length - 1, 2)


def near_pairs(listed: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, na, b, nb): all pairs of words one inserted, deleted or replaced letter apart, each once, with their counts. listed (word, n) is read twice.

    Pairs of a tile are told apart by exclusive-or and bit counts of masks, skipping population counts that are too far; only pairs within an edit's
    bits are laid letter by letter beside each other, and only those one edit apart leave it. Large tiles are cut into parts by hash, of which each two are compared in a task of their own.
    """
    bits = bits_of_letters(listed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from tile_rows(b.column(0), b.column(1), bits)

    rows = listed.select("word", "n").mapInArrow(deal, _TILE_SCHEMA)
    parts = F.greatest(F.ceil(F.count("*") / tile), F.ceil(F.sum(F.octet_length("word")) / TILE_BYTES)).cast("int")
    hot = cut(rows.groupBy("tile").agg(parts.alias("parts")).where("parts > 1").withColumnRenamed("tile", "hot"))
    dealt = rows.join(small(hot), F.col("tile") == F.col("hot"), "left").select("*", F.coalesce("parts", F.lit(1)).alias("of")).drop("hot", "parts")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("word"), "of").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    dealt = dealt.select("tile", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "side", "mask", "word", "n")
    tiles = dealt.repartition("tile", "low", "high").sortWithinPartitions("tile", "low", "high")
    return tiles.mapInArrow(_compare, "a string, na long, b string, nb long")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole tiles at a time, from batches sorted by tile and parts; a task holds one batch and the tile that it ends in."""
    held: pa.Table | None = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
        starts = _starts(held)
        if len(starts) > 1:
            yield from _pairs(held.slice(0, starts[-1]), starts[:-1])
            held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield from _pairs(held, _starts(held))


def _starts(rows: pa.Table) -> np.ndarray:
    if not rows.num_rows:
        return np.zeros(0, np.int64)
    keys = [rows.column(c).to_numpy() for c in ("tile", "low", "high")]
    return np.r_[0, 1 + np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))]


def _pairs(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    mask, side, part = (rows.column(c).to_numpy() for c in ("mask", "side", "part"))
    kind = rows.column("tile").to_numpy() & 7
    cross = rows.column("low").to_numpy() != rows.column("high").to_numpy()
    sizes = np.diff(np.r_[starts, rows.num_rows])
    pop = np.bitwise_count(mask).astype(np.int16)
    pop = np.where(kind < 3, pop + (pop & 1) * 128, pop)  # pairs of equal length have population counts that are both odd or both even
    few = np.repeat(sizes <= 64, sizes)
    at = np.flatnonzero(few)
    tile = np.repeat(np.arange(len(starts)), sizes)
    words = rows.column("word").combine_chunks()
    codes, offset = _codes(words)
    found = [_near_small(at, tile, mask, pop)]
    for p, q in itertools.chain(found, *(_near_large(np.arange(s, s + n), mask, pop) for s, n in zip(starts, sizes, strict=True) if n > 64)):
        ok = _allowed(mask[p] ^ mask[q], kind[p], side[p] != side[q]) & (~cross[p] | (part[p] != part[q]))
        p, q = p[ok], q[ok]
        near = _one_edit(codes, offset, p, q)
        p, q = p[near], q[near]
        for k in range(0, len(p), 65536):
            a, b = (rows.select(["word", "n"]).take(pa.array(x[k : k + 65536])).combine_chunks() for x in (p, q))
            for x, y in zip(a.to_batches(), b.to_batches(), strict=True):
                yield pa.RecordBatch.from_arrays([*x.columns, *y.columns], ["a", "na", "b", "nb"])


def _codes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all words, a byte each, and where each word begins and the last ends."""
    text = words.to_pylist()
    return np.frombuffer("".join(text).encode("latin-1"), np.uint8), np.r_[0, np.cumsum(np.fromiter(map(len, text), np.int64, len(text)))]


def _one_edit(codes: np.ndarray, offset: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which pairs of words are exactly one replaced or one added letter apart; letters of pairs of equal lengths are laid side by side, a few MB at a time."""
    size = np.diff(offset)
    swap = size[p] > size[q]
    p, q = np.where(swap, q, p), np.where(swap, p, q)
    out = np.zeros(len(p), bool)
    more = size[q] - size[p]
    for length in np.unique(size[p]):
        for extra in (0, 1):
            group = np.flatnonzero((size[p] == length) & (more == extra))
            step = max(1, (1 << 20) // int(length + 1))
            for k in range(0, len(group), step):
                g = group[k : k + step]
                x, y = codes[offset[p[g], None] + np.arange(length)], codes[offset[q[g], None] + np.arange(length + extra)]
                differ = x != y[:, :length]
                if extra:
                    first = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
                    out[g] = ((x == y[:, 1:]) | (np.arange(length) < first[:, None])).all(axis=1)
                else:
                    out[g] = differ.sum(axis=1) == 1
    return out


def _allowed(flipped: np.ndarray, kind: np.ndarray, across: np.ndarray) -> np.ndarray:
    """Pairs of equal length with two bits flipped or none, in the first band that they share alone; pairs of the two sides with one bit flipped."""
    bits = np.bitwise_count(flipped)
    first = np.where(flipped & FIRST == 0, 0, np.where(flipped >> BAND & FIRST == 0, 1, 2))
    return np.where(kind < 3, (bits != 1) & (kind == first), across & (bits == 1))


def _near_small(at: np.ndarray, tile: np.ndarray, mask: np.ndarray, pop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small tiles side by side, in the order of pop: each row against the d-th after it in its tile, for all d."""
    at = at[np.lexsort((pop[at], tile[at]))]
    t, m, c = tile[at], mask[at], pop[at]
    p, q = [at[:0]], [at[:0]]
    for d in range(1, 64):
        same = np.flatnonzero((t[d:] == t[:-d]) & (c[d:] - c[:-d] <= 2)) if d < len(at) else []
        if not len(same):
            break
        near = same[np.bitwise_count(m[same] ^ m[same + d]) <= 2]
        p.append(at[near])
        q.append(at[near + d])
    return np.concatenate(p), np.concatenate(q)


def _near_large(at: np.ndarray, mask: np.ndarray, pop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A large tile in the order of pop: rows against those after them whose pop is within two, a block at a time."""
    at = at[np.argsort(pop[at], kind="stable")]
    m, c = mask[at], pop[at]
    for i in range(0, len(at), 64):
        last = min(i + 64, len(at))
        end = int(np.searchsorted(c, c[last - 1] + 2, "right"))
        x, y = np.divmod(np.flatnonzero(np.bitwise_count(m[i:last, None] ^ m[None, i:end]) <= 2), end - i)
        later = x < y
        yield at[i + x[later]], at[i + y[later]]


def forms(listed: DataFrame, times: int = TIMES, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for listed (word, n), whose words are distinct.

    form is the near word of the largest n (ties: the first by code points), if that is `times` the word's own n at least. As n grows tenfold by every form, forms make no circles, and a word's root is
    found by pointer jumping in a few rounds, over the words that have a form alone.
    """
    pairs = near_pairs(listed, tile)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("of"), F.col("b").alias("near"), F.col("nb").alias("m")), F.struct(F.col("b").alias("of"), F.col("a").alias("near"), F.col("na").alias("m")))).alias("p")).select("p.*")
    best = both.groupBy("of").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    best = best.select("of", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("m"))
    held = listed.join(best, listed["word"] == best["of"], "left")
    fits = F.col("m") >= times * F.col("n")
    held = cut(held.select("word", F.when(fits, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("m")).alias("form_n")))
    roots = held.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        up = roots.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        jumped = cut(roots.join(up, roots["root"] == up["_word"], "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_word").isNotNull().alias("moved")))
        if hasattr(roots, "_written_at"):
            discard(roots)
        if jumped.where("moved").isEmpty():
            break
        roots = jumped
    up = jumped.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
    return held.join(up, held["word"] == up["_word"], "left").select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_forms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of whole texts with their forms and roots: (word, form, root, n, n_near, form_n). Tables without words give no rows; other columns aren't read."""
    return forms(cut(words(docs, key, text)))

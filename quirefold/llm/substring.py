"""Substring dedup: recurring passages confirmed by hashes, located by sharded Aho-Corasick automata."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import cut, discard

WINDOW, GRAM = 35, 8
#: Bytes of passages that a shard has about, and how many passages of one anchor go to one part of it.
SHARD_BYTES, LEAST_SHARDS, PART = 2_000_000, 64, 10_000
_BASE = 0x9E3779B97F4A7C15 | 1
_VOCABULARY = 1_000_000


class _Hashes(dict):
    """64-bit hashes of words, kept for the words seen."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class _Powers:
    """Powers of the base and of its inverse modulo 2^64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 4096)
            self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Scanner:
    """Rolling hashes of the words of a text."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM) -> None:
        self.window, self.gram, self.hashes, self.powers = window, gram, _Hashes(), _Powers()

    def sums(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.hashes) > _VOCABULARY:
            self.hashes.clear()
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        self.powers.reach(len(words) + 1)
        return h, np.r_[np.uint64(0), np.cumsum(h * self.powers.up[: len(words)], dtype=np.uint64)]

    def span(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of words[start:end], the same wherever they stand."""
        return _mixed((sums[end] - sums[start]) * self.powers.down[start])

    def ranges(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """Runs of windows that share an anchor: (anchor hash, hash of all their words and places, first window, number of windows).

        A window's anchor is the leftmost of its word grams with the least hash, so equal windows have equal anchors in equal places.
        """
        n = len(words) - self.window + 1
        if n < 1:
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
        h, sums = self.sums(words)
        at = np.arange(len(words) - self.gram + 1)
        grams = self.span(sums, at, at + self.gram)
        views = np.lib.stride_tricks.sliding_window_view(grams, self.window - self.gram + 1)
        anchor = np.concatenate([views[i : i + 8192].argmin(axis=1) for i in range(0, n, 8192)]) + np.arange(n)
        start = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        count = np.diff(np.r_[start, n])
        place = anchor[start]
        whole = self.span(sums, start, start + count + self.window - 1)
        return grams[place], _mixed(whole + _mixed((place - start).astype(np.uint64) * np.uint64(1 << 32) + count.astype(np.uint64))), start, count


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.r_[0, np.cumsum([len(x) for x in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, kind.to_pandas_dtype())]).astype(kind.to_pandas_dtype())))


_SCANNED = "doc_id long, k1 long, k2 long, n_words long, sha string, m array<long>, c array<long>, s array<int>, n array<int>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        rows, found = [], []
        for x in batch.column(1):
            raw = x.as_py() or b""
            words = raw.split()
            rows.append((*text_key(raw), len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            m, c, s, n = scanner.ranges(words)
            found.append((m.view(np.int64), c.view(np.int64), s, n))
        k1, k2, n_words, sha = zip(*rows, strict=True) if rows else ((),) * 4
        m, c, s, n = zip(*found, strict=True) if found else ((),) * 4
        i64, i32 = pa.int64(), pa.int32()
        columns = [batch.column(0).cast(i64), pa.array(k1, i64), pa.array(k2, i64), pa.array(n_words, i64), pa.array(sha, pa.string()), _lists([*m], i64), _lists([*c], i64), _lists([*s], i32), _lists([*n], i32)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "n_words", "sha", "m", "c", "s", "n"])


def text_key(raw: bytes) -> tuple[int, int]:
    """What tells texts apart: XXH64, and CRC-32 with the length. key_columns() gives the same."""
    k1 = xxhash.xxh64_intdigest(raw, 42)
    k2 = ((zlib.crc32(raw) << 32) + len(raw)) & ((1 << 64) - 1)
    return k1 - (k1 >> 63 << 64), k2 - (k2 >> 63 << 64)


def key_columns(raw) -> list:
    return [F.xxhash64(raw).alias("k1"), (F.shiftleft(F.crc32(raw), 32) + F.octet_length(raw).cast("long")).alias("k2")]


def _arrow(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = [*zip(*rows, strict=True)] if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


_PASSAGES = "m long, c long, seen long, several boolean, words binary"


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of each range r of a text: those of all its windows."""
    i64 = pa.int64()
    for batch in batches:
        rows = []
        for raw, ranges in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            words = raw.split()
            rows += [(x["m"], x["c"], x["seen"], x["several"], b" ".join(words[x["s"] : x["s"] + x["n"] + WINDOW - 1])) for x in ranges]
        for at in range(0, len(rows), 20_000):
            yield _arrow(rows[at : at + 20_000], ["m", "c", "seen", "several", "words"], [i64, i64, i64, pa.bool_(), pa.binary()])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of a passage: its anchor, the passage and how often that was seen, the window's place in it and its hash."""
    scanner = Scanner()
    for batch in batches:
        m, c, seen = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        split = [x.as_py().split() for x in batch.column(3)]
        size = np.array([len(w) for w in split], np.int64)
        count = size - WINDOW + 1
        _, sums = scanner.sums([w for words in split for w in words])
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = np.repeat(np.cumsum(size) - size, count) + within
        w = scanner.span(sums, place, place + WINDOW).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, count)) for x in (m, c, seen)] + [pa.array(within.astype(np.int32)), pa.array(w)], ["m", "c", "seen", "pos", "w"])


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a passage's windows that recur in the same passages, as phrases: (m, parts, words)."""
    for batch in batches:
        rows = []
        for m, parts, raw, windows in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            words, run = raw.split(), []
            for x in [*sorted(windows, key=lambda x: x["pos"]), None]:
                if run and (x is None or x["pos"] != run[-1]["pos"] + 1 or x["held"] != run[-1]["held"]):
                    rows.append((m, parts, b" ".join(words[run[0]["pos"] : run[-1]["pos"] + WINDOW])))
                    run = []
                run.append(x)
        yield _arrow(rows, ["m", "parts", "words"], [pa.int64(), pa.int32(), pa.binary()])


class _Letters(dict):
    """A letter for each word, in the order first met."""

    def __missing__(self, word: bytes) -> str:
        i = len(self) + 1
        value = self[word] = chr(i if i < 0xD800 else i + 0x800)
        return value


class _Pairs(dict):
    """A pair of letters from two disjoint halves for each word, for more words than there are letters."""

    def __missing__(self, word: bytes) -> str:
        half = _VOCABULARY // 2
        high, low = divmod(len(self), half)
        letter = lambda i: chr(i if i < 0xD800 else i + 0x800)
        value = self[word] = letter(high + 1) + letter(half + low + 1)
        return value


def _spelled(split: dict) -> tuple[dict, int]:
    """Texts with words spelled as letters, and the letters of a word."""
    for width, letters in ((1, _Letters()), (2, _Pairs())):
        out = {}
        for k, words in split.items():
            out[k] = "".join(map(letters.__getitem__, words))
            if width == 1 and len(letters) > _VOCABULARY:
                break
        else:
            break
    return out, width


def locate(passages: dict, phrases: list[list[bytes]], window: int = WINDOW) -> dict:
    """Where phrases are in each passage: {key: list of (phrase's number, first window)}, from passages split in words.

    The automaton's letters are the shard's words, so that what it finds are whole words in sequence, exactly.
    """
    spelled, width = _spelled(passages | {("phrase", i): p for i, p in enumerate(phrases)})
    automaton = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        automaton.add_word(spelled["phrase", i], (i, len(p)))
    if not len(automaton):
        return {k: [] for k in passages}
    automaton.make_automaton()
    # Matches end on a word's last letter, as the letters of a pair are of two halves.
    return {k: [(i, (at + 1) // width - n) for at, (i, n) in automaton.iter(spelled[k])] for k in passages}


def _runs(covered: np.ndarray) -> list[dict]:
    """The runs of what is true."""
    edge = np.flatnonzero(np.diff(np.r_[False, covered, False])).tolist()
    return [{"pos": a, "n": b - a} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _left(words: list[bytes], gone: np.ndarray) -> bytes:
    """The words that aren't gone, by runs."""
    edge = np.flatnonzero(np.diff(np.r_[True, gone, True])).tolist()
    return b" ".join([w for a, b in zip(edge[::2], edge[1::2], strict=True) for w in words[a:b]])


def _locate_shard(passages: pa.Table, phrases: pa.Table) -> pa.Table:
    """One shard: its automaton is compiled from its phrases, each once, and all its passages run through it.

    Of anchors whose passages are all here, a phrase counts only if it is found twice, of the passages as often as they were seen.
    """
    split, seen = {}, {}
    for m, c, often, raw in zip(*(passages.column(x).to_pylist() for x in ("m", "c", "seen", "words")), strict=True):
        split[m, c], seen[m, c] = raw.split(), often
    listed: dict[bytes, bool] = {}
    for raw, parts in zip(*(phrases.column(x).to_pylist() for x in ("words", "parts")), strict=True):
        listed[raw] = listed.get(raw, False) or parts > 1
    words = [x.split() for x in listed]
    found = locate(split, words)
    times = [0] * len(words)
    for k, places in found.items():
        for i, _ in places:
            times[i] += seen[k]
    sure = [elsewhere or n > 1 for elsewhere, n in zip(listed.values(), times, strict=True)]
    rows = []
    for (m, c), places in found.items():
        covered = np.zeros(max(0, len(split[m, c]) - WINDOW + 1), bool)
        for i, at in places:
            if sure[i]:
                covered[at : at + len(words[i]) - WINDOW + 1] = True
        if covered.any():
            rows.append((m, c, _runs(covered)))
    return pa.Table.from_batches([_arrow(rows, ["m", "c", "runs"], [pa.int64(), pa.int64(), pa.list_(pa.struct([("pos", pa.int32()), ("n", pa.int32())]))])])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of the windows (first, number) that recur."""
    for batch in batches:
        rows = []
        for k1, k2, raw, ranges in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            words = raw.split()
            step = np.zeros(len(words) + 1, np.int64)
            np.add.at(step, [x["s"] for x in ranges], 1)
            np.add.at(step, [x["s"] + x["n"] + WINDOW - 1 for x in ranges], -1)
            gone = np.cumsum(step[:-1]) > 0
            rows.append((k1, k2, int(gone.sum()), hashlib.sha256(_left(words, gone)).hexdigest()))
        yield _arrow(rows, ["k1", "k2", "n_removed", "kept"], [pa.int64(), pa.int64(), pa.int64(), pa.string()])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256. Words in windows that recur anywhere are removed.

    Passages: a text's windows by their anchor; those of one anchor that are equal in all words are one passage, however many texts have it. A passage seen
    again, the only one of its anchor, recurs as a whole. Of an anchor with several passages the windows are counted one by one, by hash: each that recurs is taken from one passage, and runs
    of those are phrases. Locating: a shard's automaton is compiled from the phrases of its anchors, and all passages of these anchors, which is
    all of any document where they could be, are streamed through it; only what it finds, word by word, is removed. Anchors of very many passages are dealt to several parts, which
    get all their phrases. Documents that share no anchor with any other hold no phrase. Null and short texts lose nothing; keys are whole numbers. Hashes of
    128 bits tell passages and texts apart. Counts are taken map-side; keys
    that many rows share (anchors of common lines, copies) meet only in joins whose hot side Spark splits.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    scanned = cut(docs.select(F.col(key).cast("long").alias("doc_id"), raw.alias("text")).mapInArrow(_scan, _SCANNED))
    ranges = scanned.select("doc_id", "k1", "k2", F.inline(F.arrays_zip("m", "c", "s", "n")))
    kinds = ranges.groupBy("m", "c").agg(F.count("*").alias("seen"), *[F.first(x).alias(f"r_{x}") for x in ("k1", "k2", "s")], F.first("n").alias("windows"))
    anchors = kinds.groupBy("m").agg(F.sum("seen").alias("all"), F.count("*").alias("ways")).where(F.col("all") > 1)
    kinds = cut(kinds.join(anchors, "m").select("m", "c", "seen", "ways", "windows", "r_k1", "r_k2", "r_s"))
    here = (F.col("k1") == F.col("r_k1")) & (F.col("k2") == F.col("r_k2")) & (F.col("s") == F.col("r_s"))
    shown = F.struct("s", "n", "m", "c", "seen", (F.col("ways") > 1).alias("several"))
    open_ranges = ranges.join(kinds, ["m", "c"]).withColumn("r", F.when(here & (F.col("ways") > 1), shown)).groupBy("k1", "k2", "s").agg(*[F.first(x).alias(x) for x in ("n", "m", "c")], F.first("r", ignorenulls=True).alias("r"), F.min("doc_id").alias("doc_id"))
    open_ranges = cut(open_ranges)
    holders = open_ranges.groupBy("k1", "k2").agg(F.min("doc_id").alias("_doc"), F.collect_list("r").alias("r"))
    holders = holders.withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    texts = docs.select(F.col(key).cast("long").alias("_id"), raw.alias("text")).select("_id", "text", *key_columns(F.col("text")))
    texts = cut(texts.join(holders, (texts["k1"] == holders["_k1"]) & (texts["k2"] == holders["_k2"]) & texts["_id"].eqNullSafe(holders["_doc"])).select("k1", "k2", "text", "r"))
    passages = cut(texts.where(F.size("r") > 0).select("text", "r").mapInArrow(_passages, _PASSAGES))
    windows = passages.select("m", "c", "seen", "words").mapInArrow(_windows, "m long, c long, seen long, pos int, w long")
    recurring = windows.groupBy("m", "w").agg(F.sum("seen").alias("seen"), F.first("c").alias("c"), F.first("pos").alias("pos"), F.bit_xor(F.xxhash64("c")).alias("held")).where("seen > 1")
    runs = cut(recurring.groupBy("m", "c").agg(F.collect_list(F.struct("pos", "held")).alias("windows")))
    parts = cut(kinds.where("ways > 1").groupBy("m").agg(F.ceil(F.first("ways") / PART).cast("int").alias("parts")))
    phrases = runs.join(passages.select("m", "c", "words"), ["m", "c"]).join(parts, "m").select("m", "parts", "words", "windows").mapInArrow(_phrases, "m long, parts int, words binary")
    total = kinds.where("ways > 1").agg(F.sum((F.col("windows") + WINDOW) * 8)).first()[0] or 0
    shards = max(LEAST_SHARDS, -(-total // SHARD_BYTES))
    shard = lambda part: F.pmod(F.xxhash64("m", part), F.lit(shards)).alias("shard")
    dealt = passages.join(parts, "m").select("m", "c", "seen", "words", shard(F.pmod(F.xxhash64("c"), F.col("parts").cast("long")).cast("int")))
    spread = phrases.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("words", "parts", shard(F.col("part")))
    located = dealt.groupBy("shard").cogroup(spread.groupBy("shard")).applyInArrow(_locate_shard, "m long, c long, runs array<struct<pos: int, n: int>>")
    whole = kinds.where("ways = 1").select("m", "c", F.array(F.struct(F.lit(0).alias("pos"), F.col("windows").cast("int").alias("n"))).alias("runs"))
    found = cut(located).union(whole)
    covered = open_ranges.select("k1", "k2", "s", "m", "c").join(found, ["m", "c"]).select("k1", "k2", "s", F.inline("runs"))
    covered = covered.groupBy("k1", "k2").agg(F.collect_list(F.struct((F.col("s") + F.col("pos")).alias("s"), "n")).alias("ranges")).withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    left = texts.select("k1", "k2", "text").join(covered, (texts["k1"] == covered["_k1"]) & (texts["k2"] == covered["_k2"])).select("k1", "k2", "text", "ranges")
    left = cut(left.mapInArrow(_removed, "k1 long, k2 long, n_removed long, kept string").dropDuplicates(["k1", "k2"]))
    discard(texts, passages, runs, parts, kinds, open_ranges)
    return scanned.join(left, ["k1", "k2"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))

"""Benchmark decontamination: BM25 retrieval of test items by block-max WAND for every passage, then a check of question and answer."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from quirefold.llm.common import cut

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach, and of its question's 5-word shingles and answer's words that it must hold.
SCORE, OVERLAP, SHINGLE = 0.6, 0.8, 5
#: Items in one index, and bytes of their texts, which is what a task holds in memory; more items are searched index by index.
INDEX_ITEMS, INDEX_BYTES = 20_000, 8_000_000
BLOCKS, LEAST_STRIDE, SLACK = 256, 64, 0.15

HITS = ArrayType(StructType([StructField("item_id", LongType()), StructField("score", DoubleType()), StructField("question_overlap", DoubleType()), StructField("answer_overlap", DoubleType())]))

tokens = re.compile(r"\w+").findall
_sentence = re.compile(r"[.!?]+\s+|\n+")


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of a test item up to its last sentence, and of that; of a single sentence the last quarter is the answer."""
    parts = [x for x in map(tokens, _sentence.split(text.lower())) if x]
    if len(parts) > 1:
        return [w for x in parts[:-1] for w in x], parts[-1]
    words = parts[0] if parts else []
    cut = len(words) - max(1, len(words) // 4)
    return (words[:cut], words[cut:]) if cut > 0 else (words, words)


def _grams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def _block_max(items: list[int], weights: list[float], block: int) -> dict[int, float]:
    out: dict[int, float] = {}
    for i, x in zip(items, weights, strict=True):
        out[i // block] = max(x, out.get(i // block, 0.0))
    return out


@dataclass
class Figures:
    """What BM25 weights are made from: the number of items with words, all their words, and in how many items a word is."""

    items: int
    words: int
    df: Mapping[str, int]


def figures_of(texts: list[list[str]]) -> Figures:
    return Figures(sum(map(bool, texts)), sum(map(len, texts)), Counter(w for x in texts for w in set(x)))


def stride_of(n: int) -> int:
    """The words between the passages in which an item of n words is looked for: a power of two that is not below n."""
    return max(LEAST_STRIDE, 1 << (n - 1).bit_length())


class Index:
    """Items by the stride of their passages, so that how an item is looked for depends on its own length and on no other item's."""

    def __init__(self, items: list[tuple[int, str | None]], score: float = SCORE, overlap: float = OVERLAP, whole: Figures | None = None) -> None:
        kept = [(i, t, w) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0], x[1] or "")) if (w := tokens((t or "").lower()))]
        whole = whole or figures_of([w for _, _, w in kept])
        by: dict[int, list] = {}
        for item in kept:
            by.setdefault(stride_of(len(item[2])), []).append(item)
        self.classes = [Class(by[stride], stride, score, overlap, whole) for stride in sorted(by)]

    def search(self, text: str) -> list[dict]:
        """The items that the text holds, with their overlaps."""
        words = tokens(text.lower())
        return [hit for c in self.classes for hit in c.search(words)] if words else []


class Class:
    """An inverted index of items that are looked for in passages of one size. Weights are BM25 as shares of the item's score for its own text, so one threshold fits all.

    whole has the figures of all items, so that scores don't depend on which of them are here.
    """

    def __init__(self, kept: list[tuple[int, str, list[str]]], stride: int, score: float, overlap: float, whole: Figures) -> None:
        self.score, self.overlap, self.stride = score, overlap, stride
        self.items = [i for i, _, _ in kept]
        self.parts = [question_answer(t) for _, t, _ in kept]
        df, mean = whole.df, whole.words / max(1, whole.items)
        self.terms = {w: k for k, w in enumerate(sorted({w for _, _, words in kept for w in words}))}
        self.postings: list[tuple[list[int], list[float]]] = [([], []) for _ in self.terms]
        for at, (_, _, words) in enumerate(kept):
            own = {w: np.log(1 + (whole.items - df[w] + 0.5) / (df[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean)) for w, n in Counter(words).items()}
            total = sum(own.values())
            for w, x in own.items():
                self.postings[self.terms[w]][0].append(at)
                self.postings[self.terms[w]][1].append(float(x / total))
        self.block = max(1, -(-len(kept) // BLOCKS))
        self.most = [_block_max(at, x, self.block) for at, x in self.postings]
        self.top = [max(m.values()) for m in self.most]
        # Common terms, from the most frequent on, are left out of bounds as long as they make at most SLACK of any item's score.
        left = np.zeros(len(kept))
        self.essential = np.zeros(len(self.terms) + 1, bool)
        for k in sorted(range(len(self.terms)), key=lambda k: -len(self.postings[k][0])):
            at, x = self.postings[k]
            if not self.essential.any() and (left[at] + x).max() <= SLACK:
                left[at] += x
            else:
                self.essential[k] = True
        self.slack = float(left.max()) if len(kept) else 0.0
        self.count = np.array([*map(len, self.most), 0])
        self.begin = np.cumsum(self.count) - self.count
        self.blocks = np.array([b for m in self.most for b in m], np.int64)
        self.maxima = np.array([x for m in self.most for x in m.values()], float)

    def passages(self, ids: np.ndarray) -> list[int]:
        """Starts of the passages whose bound reaches the threshold in some block. A passage is two strides long, and one starts at every stride."""
        out, step = [], self.stride * max(1, 131_072 // self.stride)
        for a in range(0, len(ids), step):
            part = ids[a : a + step + self.stride]
            at = np.flatnonzero(self.essential[part])
            n = self.count[part[at]]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[part[at]], n)
            rows = -(-len(part) // self.stride)
            bound = np.bincount(np.repeat(at // self.stride, n) * BLOCKS + self.blocks[entry], self.maxima[entry], rows * BLOCKS).reshape(rows, BLOCKS)
            bound[:-1] += bound[1:].copy()
            found = a + self.stride * np.flatnonzero((bound >= self.score - self.slack - 1e-6).any(axis=1))
            out += found[found < a + step].tolist()
        return out

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items whose score for the distinct terms reaches the threshold, by block-max WAND."""
        found, end = [], len(self.items)
        cursors = [[self.postings[t][0][0], t, 0] for t in terms]  # item, term, place in the postings
        least = self.score - 1e-9

        def seek(c: list, item: int) -> None:
            at = self.postings[c[1]][0]
            c[2] = bisect_left(at, item, c[2])
            c[0] = at[c[2]] if c[2] < len(at) else end

        while True:
            cursors = sorted(c for c in cursors if c[0] < end)
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                bound += self.top[c[1]]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // self.block
            if sum(self.most[c[1]].get(block, 0.0) for c in cursors[: pivot + 1]) < least:
                beyond = cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end
                to = max(item + 1, min((block + 1) * self.block, beyond))
                for c in cursors[: pivot + 1]:
                    seek(c, to)
            elif cursors[0][0] == item:
                total = sum(self.postings[c[1]][1][c[2]] for c in cursors[: pivot + 1])
                if total >= least:
                    found.append((item, total))
                for c in cursors[: pivot + 1]:
                    seek(c, item + 1)
            else:
                for c in cursors[:pivot]:
                    seek(c, item)

    def search(self, words: list[str]) -> list[dict]:
        """The items that a text holds, with the score of the best of its passages and the overlaps there."""
        ids = np.fromiter((self.terms.get(w, len(self.terms)) for w in words), np.int64, len(words))
        best: dict[int, dict] = {}
        for at in self.passages(ids):
            part = slice(at, at + 2 * self.stride)
            terms = [int(t) for t in np.unique(ids[part]) if t < len(self.terms)]
            for item, score in self.wand(terms):
                question, answer = self.parts[item]
                grams, held = _grams(question), set(words[part])
                n = len(next(iter(grams)))
                here = {tuple(words[i : i + n]) for i in range(at, min(part.stop, len(words)) - n + 1)}
                q, a = len(grams & here) / len(grams), len(set(answer) & held) / len(set(answer))
                if q >= self.overlap and a >= self.overlap and score > best.get(item, {"score": 0})["score"]:
                    best[item] = {"item_id": self.items[item], "score": min(1.0, score), "question_overlap": q, "answer_overlap": a}
        return [best[k] for k in sorted(best)]


def _tokens(texts: pa.Array) -> pa.Array:
    return pa.array([tokens((x.as_py() or "").lower()) for x in texts], pa.list_(pa.string()))


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text") -> list:
    """Indexes of all items, each of at most about INDEX_ITEMS and INDEX_BYTES, dealt by hash, as broadcast variables.

    All have the figures of the whole table: words are counted in Spark, and an index gets those of its own words. The
    driver holds the items of one index at a time.
    """
    spark = items.sparkSession
    rows = cut(items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t"), F.arrow_udf(_tokens, "array<string>")(F.col(text)).alias("w")))
    total = rows.agg(F.count("*").alias("rows"), F.sum(F.octet_length("t")).alias("bytes"), F.sum((F.size("w") > 0).cast("long")).alias("items"), F.sum(F.size("w").cast("long")).alias("words")).first()
    shards = max(1, -(-total["rows"] // INDEX_ITEMS), -(-(total["bytes"] or 0) // INDEX_BYTES))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(shards)))
    seen = rows.select("shard", F.explode(F.array_distinct("w")).alias("word")).groupBy("shard", "word").agg(F.count("*").alias("n"))
    df = cut(seen.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list("shard").alias("shards")))  # a word is listed once for each shard
    out = []
    for k in range(shards):
        whole = Figures(total["items"] or 0, total["words"] or 0, {r["word"]: r["n"] for r in df.where(F.array_contains("shards", F.lit(k).cast("long"))).select("word", "n").collect()})
        out.append(spark.sparkContext.broadcast(Index([(r["i"], r["t"]) for r in rows.where(F.col("shard") == k).select("i", "t").collect()], whole=whole)))
    return out


def hits(text: Column, index) -> Column:
    """What a text holds of one broadcast index: an array of HITS' rows."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))

    def search(texts: pa.Array) -> pa.Array:
        return pa.array([index.value.search(x.as_py() or "") for x in texts], kind)

    return F.arrow_udf(search, HITS)(F.coalesce(text, F.lit("")))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document and test item that it holds: doc_id, item_id, score, question_overlap, answer_overlap.

    Every passage of every whole text is a query. Null and blank texts and items hold nothing; no items, no rows; repeated
    documents and items are found each. Keys and item ids are whole numbers. Documents stay where they are; an index is bounded by INDEX_ITEMS
    and INDEX_BYTES, and further items make further indexes, which the documents are read for again.
    """
    out = None
    for index in indexes(items):
        found = docs.select(F.col(key).alias("doc_id"), F.inline(hits(F.col(text), index)))
        out = found if out is None else out.union(found)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no test item, with their own columns."""
    for index in indexes(items):
        docs = docs.where(F.size(hits(F.col(text), index)) == 0)
    return docs

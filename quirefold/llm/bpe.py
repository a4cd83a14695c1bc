"""Byte-level BPE: ranked merges as a fold of higher-order functions, and decoding by joining pieces."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import bind, cut, fresh

#: White space, and the letters and numbers of Unicode 14 to 16, which the tables of older JVMs lack.
WHITE = r"\x09-\x0D\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LATE_LETTERS = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 "
    "105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 "
    "11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E "
    "1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"
)
LATE_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"

#: Words up to so many bytes are one fold; longer ones are folded by chunks of this size, which are then joined.
CHUNK = 62
#: Above all ranks, which stand less this number in the rank map.
RANKS = 1 << 24
#: So many places are tried at once when the rank map is made.
STEP = 1 << 14
#: The dictionary has so many slots, and holds words of at most so many bytes: some 150 MB as it is sent if all are taken, whatever the corpus.
SLOTS, SLOT_BYTES = 1 << 22, 24


def java_pattern(pattern: str) -> str:
    r"""A splitting pattern in which \s, \S, \p{L} and \p{N} mean what they mean in Unicode 16, for Java's regular expressions."""
    ranges = lambda text: "".join("-".join(rf"\x{{{end}}}" for end in x.split("-")) for x in text.split())
    late = lambda text: rf"[\x{{870}}-\x{{323AF}}&&[{ranges(text)}]]"  # noqa: E731 the range comes first, so that most characters are looked up no further
    sets = {r"\s": WHITE, r"\p{L}": r"\p{L}" + late(LATE_LETTERS), r"\p{N}": r"\p{N}" + late(LATE_NUMBERS)}
    inner = r"\\s|\\p\{[LN]\}"

    def one(m: re.Match) -> str:
        if m[0] == r"\S":
            return f"[^{WHITE}]"
        if m[0].startswith("[^"):
            return "[" + "&&".join(f"[^{sets.get(x, x)}]" for x in re.findall(rf"{inner}|\\.|.", m[0][2:-1])) + "]"
        return re.sub(inner, lambda x: sets[x[0]], m[0]) if m[0].startswith("[") else f"[{sets[m[0]]}]"

    return re.sub(rf"\[[^\]]*\]|\\S|{inner}", one, pattern)


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of pieces and the pattern that splits texts into words; the rank of a piece is its id."""

    ranks: dict[bytes, int]
    pattern: str = public_tokenizers.PATTERN

    @classmethod
    def read(cls, path: str, pattern: str = public_tokenizers.PATTERN) -> Vocabulary:
        """From a file with a base64 piece and its rank on each line. All single bytes must be pieces."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        if missing := [i for i in range(256) if bytes([i]) not in ranks]:
            raise ValueError(f"not a byte-level vocabulary: {len(missing)} single bytes have no rank")
        if max(ranks.values()) >= RANKS - 1:
            raise ValueError("ranks are to be below 2^24")
        return cls(ranks, pattern)

    @cached_property
    def split(self) -> str:
        return java_pattern(self.pattern)

    @cached_property
    def literal(self) -> str:
        """The rank map and the pieces as JSON.

        The rank of the pair (l, r) is rank[base[l] + r], if owner[base[l] + r] is l: the rows of all left ids are
        pushed together in one array, each to the first place where it hits no other, so a look-up is three reads.
        pieces are written with a character for each byte.
        """
        rows: dict[int, list[tuple[int, int]]] = {}
        for piece, rank in self.ranks.items():
            for i in range(1, len(piece)):
                left, right = self.ranks.get(piece[:i]), self.ranks.get(piece[i:])
                if left is not None and right is not None:
                    rows.setdefault(left, []).append((right, rank))
        size = max(self.ranks.values()) + 1
        base: list[int | None] = [None] * size
        taken, owner, rank_at = (np.full(4 * size, x) for x in (False, -1, -1))
        for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
            rights, ranks = np.array(sorted(row)).T
            at = 0
            while True:
                while at + STEP + rights[-1] >= len(taken):
                    taken, owner, rank_at = (np.concatenate([x, np.full(len(x), y)]) for x, y in ((taken, False), (owner, -1), (rank_at, -1)))
                free = at + np.flatnonzero(~taken[at + rights[0] : at + rights[0] + STEP])
                for r in rights[1:]:
                    free = free[~taken[free + r]]
                if len(free):
                    break
                at += STEP
            base[left] = int(free[0])
            taken[free[0] + rights], owner[free[0] + rights], rank_at[free[0] + rights] = True, left, ranks
        end = int(np.flatnonzero(taken).max()) + 1 if taken.any() else 0
        pieces: list[str | None] = [None] * size
        for piece, rank in self.ranks.items():
            pieces[rank] = piece.decode("latin-1")
        bytes_ = [self.ranks[bytes([i])] for i in range(256)]
        return json.dumps({"base": base, "owner": owner[:end].tolist(), "rank": (rank_at[:end] - RANKS).tolist(), "bytes": bytes_, "pieces": pieces})

    def held(self, body: Callable[[Column], Column]) -> Column:
        """body(t) with the rank map t as one literal of the plan."""
        return bind(F.from_json(F.lit(self.literal), "base array<int>, owner array<int>, rank array<int>, bytes array<int>, pieces array<string>"), body)

    def words_of(self, text: Column) -> Column:
        """The words that the pattern finds in a text; null: none."""
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.split), F.lit(0))


def _latin(raw: Column) -> Column:
    """Bytes as a string with a character for each of them."""
    return F.decode(raw, "ISO-8859-1")


def _byte_ids(t: Column, word: Column) -> Column:
    return F.transform(F.split(_latin(word.cast("binary")), ""), lambda c: F.get(t["bytes"], F.ascii(c)))


def _pair_rank(t: Column, left: Column, right: Column) -> Column:
    """The rank of the pair less RANKS, so below all ids; null if it has none."""
    at = F.get(t["base"], left) + right
    return F.when(F.get(t["owner"], at) == left, F.get(t["rank"], at))


def _fold(t: Column, ids: Column) -> Column:
    """The merges of ids, lowest rank first and leftmost among equals, one a step, until no pair has a rank.

    The state is one array: each id is followed by the rank of the pair that it begins, which is negative (null: none). Ends are marked by
    the id -1, which joins nothing. So the least cell is the rank to merge, and its first place is where.
    """
    ends = F.array(F.lit(-1))
    start = bind(F.flatten(F.array(ends, ids, ends)), lambda p: F.flatten(F.transform(p, lambda x, i: F.array(x, _pair_rank(t, x, F.get(p, i + 1))))))

    def merge(s: Column, one: Column, at: Column) -> Column:
        new = F.array(_pair_rank(t, F.get(s, at - 4), one), one, _pair_rank(t, one, F.get(s, at + 2)))
        return F.flatten(F.array(F.slice(s, 1, at - 3), new, F.slice(s, at + 3, F.size(s))))

    def step(s: Column, _: Column) -> Column:
        return bind(F.array_min(s), lambda low: F.when(low >= -1, s).otherwise(bind(F.array_position(s, low).cast("int"), lambda at: merge(s, low + RANKS, at))))

    return F.aggregate(F.sequence(F.lit(1), F.size(ids)), start, step, lambda s: F.filter(s, lambda x: x >= 0))


def _long_fold(t: Column, ids: Column) -> Column:
    """The same for a long word, chunk by chunk.

    Ids of two parts of a word are those of the whole if the two ids at the junction stay as they are when folded alone: no merge can
    cross a junction without crossing it there. Where they don't, the last ids of what is done are taken back and folded together with the chunk, more of them until it fits.
    """
    length = lambda found: F.aggregate(found, F.lit(0), lambda n, i: n + F.char_length(F.get(t["pieces"], i)))

    def attempt(done: Column, upto: Column, back: Column) -> Column:
        keep = F.slice(done, 1, F.greatest(F.size(done) - back, F.lit(0)))
        return bind(F.struct(keep.alias("keep"), length(keep).alias("at")), lambda k: bind(_fold(t, F.slice(ids, k["at"] + 1, upto - k["at"])), lambda new: F.when(fits(k, new), F.concat(k["keep"], new))))

    def fits(k: Column, new: Column) -> Column:
        last, first = F.get(k["keep"], F.size(k["keep"]) - 1), F.get(new, F.lit(0))
        size = lambda i: F.char_length(F.get(t["pieces"], i))
        return (F.size(k["keep"]) == 0) | (_fold(t, F.slice(ids, k["at"] - size(last) + 1, size(last) + size(first))) == F.array(last, first))

    def join(done: Column, upto: Column) -> Column:
        backs = F.array(*[F.lit(n) for n in (0, 2, 8, 32, 1 << 30)])
        return F.aggregate(backs, F.lit(None).cast("array<int>"), lambda found, back: F.coalesce(found, attempt(done, upto, back)))

    ends = F.transform(F.sequence(F.lit(1), F.ceil(F.size(ids) / CHUNK).cast("int")), lambda k: F.least(k * CHUNK, F.size(ids)))
    return F.aggregate(ends, F.array().cast("array<int>"), join)


def _word_ids(t: Column, word: Column) -> Column:
    return bind(_byte_ids(t, word), lambda ids: F.when(F.size(ids) <= CHUNK, _fold(t, ids)).otherwise(_long_fold(t, ids)))


def encoded_words(words: DataFrame, vocabulary: Vocabulary, word: str = "word", out: str = "ids") -> DataFrame:
    """words with the ids of each word in the column out."""
    return words.withColumn(out, vocabulary.held(lambda t: _word_ids(t, F.col(word))))


def frequent_words(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", slots: int = SLOTS) -> DataFrame:
    """(slot, word): of the words that all texts have twice or more and that hash to a slot, the most frequent one. Counts are summed map-side; at most `slots` rows."""
    words = docs.select(F.explode(vocabulary.words_of(F.col(text))).alias("word")).groupBy("word").count()
    slot = F.pmod(F.xxhash64("word"), F.lit(slots)).cast("int")
    return words.where((F.octet_length("word") <= SLOT_BYTES) & (F.col("count") > 1)).groupBy(slot.alias("slot")).agg(F.max_by("word", "count").alias("word"))


def _looked_up(words: Column, listed: DataFrame) -> Column:
    """For each word of an array its ids as listed (word, ids) has them, or null. listed is as small as the slots and is sent to each executor once.

    The listed words are looked up among a batch's distinct words, which are far fewer, so that no large hash table is made for each batch.
    """
    sent = listed.sparkSession.sparkContext.broadcast(listed.select("word", "ids").toArrow().combine_chunks())

    def of_batch(batch: pa.Array) -> pa.Array:
        known, ids = (sent.value[c].combine_chunks() for c in ("word", "ids"))
        coded = batch.flatten().dictionary_encode()
        at = pc.index_in(known.cast(batch.type.value_type), value_set=coded.dictionary)
        place = np.full(len(coded.dictionary), -1)
        place[at.drop_null().to_numpy()] = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        found = ids.take(pa.array(place, mask=place < 0).take(coded.indices))
        return pa.ListArray.from_arrays(pc.subtract(batch.offsets, batch.offsets[0]), found)

    return F.arrow_udf(of_batch, "array<array<int>>")(words)


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids", slots: int = SLOTS) -> DataFrame:
    """docs with the ids of each whole text in the column out (array<int>; null texts: empty), which replaces a column of that name.

    The distinct words that are frequent in these texts are folded once each, and texts look their ids up. Words that the dictionary doesn't hold, which are rare
    by count, are folded where they stand. Texts are neither shuffled nor cut, and a word's ids never depend on which way they came.
    """
    listed = cut(encoded_words(frequent_words(docs, vocabulary, text, slots), vocabulary))
    words, known = fresh("words", "known")
    split = docs.withColumn(words, vocabulary.words_of(F.col(text)))
    looked = split.withColumn(known, _looked_up(F.col(words), listed))
    found = vocabulary.held(lambda t: F.flatten(F.zip_with(words, known, lambda w, ids: F.coalesce(ids, _word_ids(t, w)))))
    return looked.withColumn(out, found).drop(words, known)


def decoded(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes of ids: their pieces, joined. Null ids give null, and ids that the vocabulary doesn't have give nothing."""
    return vocabulary.held(lambda t: F.encode(F.array_join(F.transform(ids, lambda i: F.get(t["pieces"], i)), ""), "ISO-8859-1"))


def digests(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the bytes that the ids decode to).

    Null and empty texts have no ids, and digests of nothing. Rows that repeat stay rows of their own; other columns of docs are not read.
    """
    ids, raw = fresh("ids", "raw")
    coded = encode(docs.select(F.col(key).alias("doc_id"), F.col(text).alias(raw)), vocabulary, raw, ids)
    joined = F.array_join(F.col(ids).cast("array<string>"), ",")
    return cut(coded.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(decoded(F.col(ids), vocabulary), 256).alias("decoded_sha256")))

"""Text functions, as columns."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Line boundaries; what str.strip() takes besides Unicode white space.
LINE_END = "\r\n|[\n\r\x0b\f\x1c\x1d\x1e\u0085  ]"
_SPACE = r"[\s\x1c-\x1f]"
_SPACES = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.btrim(c, F.lit(_SPACES))


#: White space at an end of one of the lines of a text.
_EDGE = r"(?:\A|\n)[SPACE]|[SPACE](?:\n|\z)".replace("SPACE", r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")


def strip_each(texts: Column) -> Column:
    """An array of texts, each as strip() leaves it. One look at all of them tells whether any needs it, which is cheaper than to try each."""
    return F.when(F.array_join(texts, "\n").rlike(_EDGE), F.transform(texts, strip)).otherwise(texts)


def is_blank(c: Column) -> Column:
    return c.rlike(rf"(?U)\A{_SPACE}*\z")


def split_lines(c: Column) -> Column:
    """All pieces between line boundaries, empty ones included."""
    return F.split(c, LINE_END, -1)


def fullwidth_to_halfwidth(c: Column) -> Column:
    """Full-width ASCII forms (U+FF01 to U+FF5E) and the ideographic space, to what they stand for."""
    wide = "　" + "".join(map(chr, range(0xFF01, 0xFF5F)))
    return F.translate(c, wide, " " + "".join(chr(ord(x) - 0xFEE0) for x in wide[1:]))


def circled_numbers(c: Column) -> Column:
    """$\\textcircled{n}$ for n from 1 to 20, to the circled number's character; texts without the command skip the replacements."""
    done = reduce(lambda x, n: F.regexp_replace(x, rf"(?U)\$\s*\\textcircled\{{0*{n}\}}\s*\$", chr(0x2460 + n - 1)), range(1, 21), c)
    return F.when(c.contains("\\textcircled{"), done).otherwise(c)


@cache
def _digit_class() -> str:
    """A class of all that str.isdigit() takes: decimals, and the other digit characters of the Unicode tables."""
    other = [i for i in range(sys.maxunicode + 1) if chr(i).isdigit() and not chr(i).isdecimal()]
    return r"[\p{Nd}" + "".join(rf"\x{{{i:X}}}" for i in other) + "]"


def is_digits(c: Column) -> Column:
    return c.rlike(rf"\A(?=[0-9\x{{B2}}-\x{{10FFFF}}]){_digit_class()}+\z")  # the long class is not tried on most letters


def is_decimals(c: Column) -> Column:
    return c.rlike(r"\A\p{Nd}+\z")


@cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose case folding is not their lower case, or whose lower case depends on what stands beside it (the capital sigma): to one character, and to several."""
    odd = {chr(i): chr(i).casefold() for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and (chr(i).casefold() != chr(i).lower() or chr(i) == "Σ")}
    return {k: v for k, v in odd.items() if len(v) == 1}, {k: v for k, v in odd.items() if len(v) > 1}


def _may_have(chars: Iterable[str]) -> str:
    """A class that takes the characters and some between them, as few ranges: few tests a character, and scripts without any of them take none."""
    spans: list[list[int]] = []
    for i in sorted(map(ord, chars)):
        if spans and i >= 0x130 and i - spans[-1][1] <= 0x400:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans) + "]"


def casefold(c: Column) -> Column:
    """As str.casefold(). The hundred or so characters that fold to several are replaced only in texts that may have one, and so are those that fold to one."""
    one, several = _folds()
    pairs = F.split(F.lit("|".join(k + v for k, v in several.items())), "[|]")
    spread = lambda x: F.aggregate(pairs, x, lambda y, p: F.replace(y, F.substring(p, 1, 1), F.substring(p, 2, 9)))
    when = lambda x, keys, done: F.when(x.rlike(_may_have(keys)), done(x)).otherwise(x)
    folded = lambda x: bind(when(x, several, spread), lambda y: when(y, one, lambda z: F.translate(z, "".join(one), "".join(one.values()))))
    return F.lower(bind(c, lambda x: when(x, [*one, *several], folded)))


def normalized(c: Column) -> Column:
    """Letters and numbers alone, case-folded."""
    return casefold(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", ""))


def has_text(c: Column) -> Column:
    """Whether normalized() leaves anything."""
    return F.coalesce(c.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def truncated(c: Column, chars: int) -> Column:
    return F.substring(c, 1, chars)


def raw_text(elements: Column, delimiter: str = "\n") -> Column:
    """The contents of a page in order; an empty page gives an empty string."""
    return F.coalesce(F.array_join(F.transform(elements, lambda e: e["content"]), delimiter), F.lit(""))


def formatted_pages(pages: Column) -> Column:
    """<page index="i">text</page> blocks of an array of structs (i, text), in order of i, line by line."""
    return F.array_join(F.transform(F.array_sort(pages), lambda p: F.concat(F.lit('<page index="'), p["i"].cast("string"), F.lit('">\n'), p["text"], F.lit("\n</page>"))), "\n")


def has_job_id_form(c: Column) -> Column:
    return c.rlike(r"\A[0-9a-f]{32}\z")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body names it."""
    return F.transform(F.array(value), body)[0]


#: So many characters are counted at once.
_COUNTED = 1 << 18


def _lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _cells(texts: pa.Array, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, place in the alphabet, times) of each character of the groups of texts, in that order, and the alphabet. A table of all cells is filled without sorting, where it isn't much larger than the texts."""
    codes = np.frombuffer("".join(texts.fill_null("").to_pylist()).encode("utf-32-le"), np.uint32)
    seen = np.bincount(codes)
    alphabet = np.flatnonzero(seen)
    width, place = max(1, len(alphabet)), np.cumsum(seen > 0) - 1
    key = np.repeat(group, _lengths(texts)) * width + place[codes]
    if groups * width <= 8 * len(codes) + (1 << 16):
        table = np.bincount(key, minlength=groups * width)
        at = np.flatnonzero(table)
        times = table[at]
    else:
        at, times = np.unique(key, return_counts=True)
    return at // width, at % width, times.astype(np.int64), alphabet


def _counted(texts: pa.Array) -> pa.Array:
    """For each text of a batch its characters with how often they occur; null texts give null."""
    row, letter, times, alphabet = _cells(texts, np.arange(len(texts)), len(texts))
    values = pa.StructArray.from_arrays([pa.array(list(map(chr, alphabet)), pa.string()).take(pa.array(letter)), pa.array(times)], ["c", "n"])
    offsets = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False)), values)


def _parts(texts: pa.Array) -> list[tuple[int, int]]:
    """Bounds of some texts at a time, so that a batch of long ones is no burden; a text is counted as a whole."""
    ends = np.cumsum(_lengths(texts))
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(_COUNTED, ends[-1], _COUNTED)) + 1, len(texts)]) if len(texts) else np.zeros(2, np.int64)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _counted_in_parts(texts: pa.Array) -> pa.Array:
    return pa.concat_arrays([_counted(texts[i:j]) for i, j in _parts(texts)])


def char_counts(text: Column) -> Column:
    """An array of (c, n): each character of a text with how often it occurs, so that a text is exploded by its alphabet and not its length. A batch of texts is counted at once."""
    return F.arrow_udf(_counted_in_parts, "array<struct<c: string, n: long>>")(text)


def _counted_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in _parts(batch.column(1)):
            keys = batch.column(0)[i:j].dictionary_encode(null_encoding="encode")
            groups = len(keys.dictionary)
            row, letter, times, alphabet = _cells(batch.column(1)[i:j], keys.indices.to_numpy().astype(np.int64), groups)
            every = np.arange(groups)
            chars = pa.array(["", *map(chr, alphabet)], pa.string())
            columns = [keys.dictionary.take(pa.array(np.r_[every, row])), chars.take(pa.array(np.r_[0 * every, letter + 1])), pa.array(np.r_[0 * every, times])]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "c", "n"])


def normal_counts(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, c, n): how often a key's texts have a character when normalized(), and a row of none ("", 0) for each key; one character may be in several rows.

    Rows of a key that stand together are counted together. Texts are counted as they are, and what occurs is normalised: no character's form depends on what stands beside it.
    """
    type_ = rows.schema[key].dataType.simpleString()
    counted = rows.select(F.col(key).alias("key"), text.alias("text")).mapInArrow(_counted_by_key, f"key {type_}, c string, n long")
    found = counted.select("key", normalized(F.col("c")).alias("c"), "n")
    letters = F.when(F.length("c") <= 1, F.array("c")).otherwise(F.transform(F.sequence(F.lit(1), F.length("c")), lambda i: F.substring("c", i, 1)))
    found = found.select("key", F.when(F.col("c") == "", 0).otherwise(F.col("n")).cast("long").alias("n"), F.explode_outer(letters).alias("c"))
    return found.select(F.col("key").alias(key), "c", "n")

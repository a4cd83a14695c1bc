"""Chat formatting: a hidden Markov model over speaker markers and line features recovers roles, and turns are rendered in one form."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import strip
from quirefold.llm.common import cut

ROLES = ("system", "user", "assistant")
#: How speakers are named.
SPEAKERS = {
    "system": ("system", "sys", "developer", "instruction", "context"),
    "user": ("user", "human", "customer", "prompter", "question", "q", "me", "input", "client"),
    "assistant": ("assistant", "ai", "bot", "gpt", "model", "agent", "answer", "a", "response", "chatbot"),
}
#: What is believed of chats beforehand: who speaks first, who follows whom (rows: before, columns: after), and the chance
#: that a speaker's marker is right and that there is none. Beliefs weigh TRUST times as much as what is counted, at every size.
FIRST = (0.25, 0.70, 0.05)
AFTER = ((0.05, 0.90, 0.05), (0.01, 0.03, 0.96), (0.01, 0.96, 0.03))
RIGHT, SILENT, TRUST = 0.95, 0.03, 4.0
#: Line features: half octaves of a text's length, whether it asks, and its lines (one, two or three, more).
LENGTHS, ASKS, LINES = 28, 2, 3
SYMBOLS = (len(ROLES) + 1) * LENGTHS * ASKS * LINES
BLOCK, ROUNDS, SETTLED = 512, 12, 1e-4
#: Chance that a transcript's unmarked line goes on with the turn before it.
GO_ON = 0.97
_UNIT = float(1 << 20)

_NAMED = {n: r for r, names in SPEAKERS.items() for n in names}
_MARK = rf"^\s*(?:#{{2,}}\s*|<\|(?:im_start\|>)?|\[|\*\*)?({'|'.join(sorted(_NAMED, key=len, reverse=True))})\s*(?:[:>\]]|\|>|\*\*:?|(?=\n))+[ \t]*"
_mark = re.compile(_MARK, re.I)


def _logs(counts: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = counts + smooth
    return np.log(counts / counts.sum(axis=-1, keepdims=True))


def _believed(counts: np.ndarray, belief: np.ndarray) -> np.ndarray:
    """Logarithms of the shares of counts and belief."""
    total = counts.sum(axis=-1, keepdims=True)
    return np.log(np.where(total > 0, (counts / np.maximum(total, 1e-300) + TRUST * belief) / (1 + TRUST), belief))


def _marker_belief() -> np.ndarray:
    """roles x markers; the first marker is none."""
    out = np.full((len(ROLES), len(ROLES) + 1), (1 - RIGHT - SILENT) / (len(ROLES) - 1))
    out[range(len(ROLES)), range(1, len(ROLES) + 1)] = RIGHT
    out[:, 0] = SILENT
    return out


@dataclass
class Model:
    """Logarithms of chances: of the first role, of a role after a role, of a role anywhere, and of markers and line features by role."""

    first: np.ndarray
    after: np.ndarray
    anywhere: np.ndarray
    marker: np.ndarray
    length: np.ndarray
    asks: np.ndarray
    lines: np.ndarray

    def emission(self) -> np.ndarray:
        """symbols x roles."""
        whole = self.marker[:, :, None, None, None] + self.length[:, None, :, None, None] + self.asks[:, None, None, :, None] + self.lines[:, None, None, None, :]
        return whole.reshape(len(ROLES), SYMBOLS).T


def model_of(first: np.ndarray, after: np.ndarray, symbols: np.ndarray) -> Model:
    """A model from (expected) counts: of first roles, of roles after roles, and of symbols by role (symbols x roles)."""
    table = symbols.T.reshape(len(ROLES), len(ROLES) + 1, LENGTHS, ASKS, LINES)
    return Model(
        _believed(first, np.array(FIRST)), _believed(after, np.array(AFTER)), _logs(symbols.sum(axis=0)), _believed(table.sum(axis=(2, 3, 4)), _marker_belief()),
        _logs(table.sum(axis=(1, 3, 4))), _logs(table.sum(axis=(1, 2, 4))), _logs(table.sum(axis=(1, 2, 3))),
    )


def untrained() -> Model:
    n = len(ROLES)
    return model_of(np.zeros(n), np.zeros((n, n)), np.zeros((SYMBOLS, n)))


def viterbi(first: np.ndarray, steps: np.ndarray, emit: np.ndarray, last: int | None = None) -> np.ndarray:
    """The likeliest roles: first is the score of each role at the start, steps[i] of a role after a role between i and i+1. Ties go to the earlier role."""
    n = len(emit)
    score, back = first + emit[0], np.zeros((n, emit.shape[1]), np.int64)
    for i in range(1, n):
        through = score[:, None] + steps[i - 1]
        back[i] = through.argmax(axis=0)
        score = through.max(axis=0) + emit[i]
    out = np.zeros(n, np.int64)
    out[-1] = score.argmax() if last is None else last
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i][out[i]]
    return out


def transfer(step: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """The best score from each role before a block to each role at its end."""
    out = step + emit[0]
    for e in emit[1:]:
        out = (out[:, :, None] + step[None]).max(axis=1) + e
    return out


def _at(begin: np.ndarray, count: np.ndarray, t: int) -> np.ndarray:
    """The rows that are the t-th of their sequences."""
    return begin[count > t] + t


def expected(model: Model, emit: np.ndarray, begin: np.ndarray, count: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of each row's role, and of roles after roles (rows x roles x roles; none for first rows), by forward and backward sums.

    Sequences begin at begin and have count rows; all are gone through at once, a row of each at a time. Those that open don't go on with one before.
    """
    n, step = len(ROLES), np.exp(model.after)
    seen = np.exp(emit - emit.max(axis=1, keepdims=True))
    ahead, behind, pairs = np.zeros_like(seen), np.ones_like(seen), np.zeros((len(seen), n, n))
    unit = lambda x: x / x.sum(axis=1, keepdims=True)
    ahead[begin] = unit(np.exp(np.where(opens[:, None], model.first, model.anywhere)) * seen[begin])
    longest = int(count.max(initial=0))
    for t in range(1, longest):
        i = _at(begin, count, t)
        ahead[i] = unit((ahead[i - 1] @ step) * seen[i])
    for t in range(longest - 1, 0, -1):
        i = _at(begin, count, t)
        behind[i - 1] = unit((seen[i] * behind[i]) @ step.T)
    later = np.ones(len(seen), bool)
    later[begin] = False
    i = np.flatnonzero(later)
    both = ahead[i - 1][:, :, None] * step[None] * (seen[i] * behind[i])[:, None, :]
    pairs[i] = both / both.sum(axis=(1, 2), keepdims=True)
    return unit(ahead * behind), pairs


def likeliest(start: np.ndarray, step: np.ndarray, emit: np.ndarray, begin: np.ndarray, count: np.ndarray, last: np.ndarray) -> np.ndarray:
    """viterbi() of many sequences at once: start has a row for each; last is the role at the end, or -1 where that is free."""
    score, back = emit.copy(), np.zeros(emit.shape, np.int8)
    score[begin] += start
    longest = int(count.max(initial=0))
    for t in range(1, longest):
        i = _at(begin, count, t)
        through = score[i - 1][:, :, None] + step[None]
        back[i] = through.argmax(axis=1)
        score[i] = through.max(axis=1) + emit[i]
    out = np.zeros(len(emit), np.int64)
    end = begin + count - 1
    out[end] = np.where(last >= 0, last, score[end].argmax(axis=1))
    for t in range(longest - 1, 0, -1):
        i = _at(begin, count, t)
        out[i - 1] = back[i, out[i]]
    return out


def symbol_of(text: Column, speaker: Column | None = None) -> Column:
    """The number of what is seen of a turn: the marker that begins its text (or the speaker's name, where one is given) and its line features."""
    name = F.lower(F.regexp_extract(text, f"(?i){_MARK}", 1))
    if speaker is not None:
        own = F.lower(F.btrim(F.coalesce(speaker, F.lit(""))))
        name = F.when(own.isin(*_NAMED), own).otherwise(name)
    marker = F.coalesce(*[F.when(name.isin(*SPEAKERS[r]), F.lit(i + 1)) for i, r in enumerate(ROLES)], F.lit(0))
    length = F.least(F.floor(F.log2(F.length(said_in(text)) + F.lit(1.0)) * 2), F.lit(LENGTHS - 1))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    lines = F.when(breaks == 0, 0).when(breaks < 3, 1).otherwise(2)
    return (((marker * LENGTHS + length) * ASKS + text.contains("?").cast("int")) * LINES + lines).cast("int")


def said_in(text: Column) -> Column:
    """A turn's text without the marker that begins it."""
    return F.regexp_replace(text, f"(?i){_MARK}", "")


def blocks_of(seen: DataFrame) -> DataFrame:
    """(conv_id, block, places) of seen (conv_id, turn, symbol): the places of at most BLOCK turn numbers in order, each with its symbols and how many rows have them.

    Rows are counted map-side by symbol first, so a place holds at most SYMBOLS entries and no hot conversation or turn is gathered row by row.
    """
    counted = seen.where("conv_id IS NOT NULL AND turn IS NOT NULL").groupBy("conv_id", "turn", "symbol").agg(F.count("*").alias("n"))
    places = counted.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("symbol", F.col("n").cast("double").alias("n")))).alias("seen"))
    block = F.floor(F.col("turn") / BLOCK).cast("long").alias("block")
    return places.groupBy("conv_id", block).agg(F.sort_array(F.collect_list(F.struct("turn", "seen"))).alias("places"))


def _entries(places: pa.Array) -> tuple[np.ndarray, ...]:
    """Of a column of blocks: where each begins and its number of places; of the places, where their entries begin; and the entries' symbols and numbers."""
    if isinstance(places, pa.ChunkedArray):
        places = places.combine_chunks()
    edge = places.offsets.to_numpy()
    seen = places.flatten().flatten()[1]
    inner = seen.offsets.to_numpy()
    symbol, n = (x.to_numpy(zero_copy_only=False) for x in seen.flatten().flatten())
    return edge[:-1] - edge[0], np.diff(edge), inner[:-1] - inner[0], symbol, n


def _emitted(table: np.ndarray, at: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The emission of each place: the sum over its rows, as they have one role."""
    return np.add.reduceat(table[symbol] * n[:, None], at, axis=0) if len(at) else np.zeros((0, len(ROLES)))


def _counts(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Expected counts of a task's blocks as (key, n), in whole units so that their sum doesn't depend on the order: first roles, roles after roles, symbols by role."""
    n = len(ROLES)
    first, after, symbols = np.zeros(n, np.int64), np.zeros((n, n), np.int64), np.zeros((SYMBOLS, n), np.int64)
    table = model.emission()
    for batch in batches:
        if not batch.num_rows:
            continue
        opens = batch.column(0).to_numpy(zero_copy_only=False)
        begin, count, at, symbol, times = _entries(batch.column(1))
        roles, pairs = expected(model, _emitted(table, at, symbol, times), begin, count, opens)
        first += np.rint(roles[begin[opens]] * _UNIT).astype(np.int64).sum(axis=0)
        after += np.rint(pairs * _UNIT).astype(np.int64).sum(axis=0)
        place = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(symbol)]))
        np.add.at(symbols, symbol, np.rint(roles[place] * times[:, None] * _UNIT).astype(np.int64))
    flat = np.r_[first, after.ravel(), symbols.ravel()]
    key = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(flat[key])], ["key", "n"])


def fit(blocks: DataFrame, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over the blocks of all conversations, from what is believed of chats; no roles are given.

    A round is one pass over the table of symbols, of which a few thousand sums come back whatever its size. A block that goes on with
    another is taken as a sequence of its own here; roles are found in whole conversations.
    """
    model, n = untrained(), len(ROLES)
    rows = blocks.select("opens", "places")
    for _ in range(rounds):
        now = model
        found = rows.mapInArrow(lambda batches, now=now: _counts(batches, now), "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()  # SYMBOLS x 3 rows and a few
        flat = np.zeros(n + n * n + SYMBOLS * n)
        for r in found:
            flat[r["key"]] = r["n"] / _UNIT
        model = model_of(flat[:n], flat[n : n + n * n].reshape(n, n), flat[n + n * n :].reshape(SYMBOLS, n))
        if max(np.abs(np.exp(model.emission()) - np.exp(now.emission())).max(), np.abs(np.exp(model.after) - np.exp(now.after)).max()) < SETTLED:
            break
    return model


def recover(rows: DataFrame, speaker: str | None = None) -> DataFrame:
    """One row per row: conv_id, turn, role and rendered, from rows (conv_id, turn, text); no column of roles is read.

    Roles are the likeliest sequence of a conversation's turn numbers, from the markers that begin texts and from line features. speaker
    may name a column of speakers' names, which then count as markers. A marker is not part of what is rendered. Rows that share a turn number have
    one role between them. A row without a conv_id or a turn has no neighbours and is judged alone; null and empty texts are empty turns; repeated rows are given
    each. Turns are numbers, conv_id is of any type. A conversation longer than BLOCK turn numbers is cut in blocks: each block's best scores from role to role are
    found apart, joined along the conversation, and the block's roles found again between the roles at its ends; this gives the likeliest
    sequence of the whole, and no task holds more than a block's turns of it.
    """
    spark = rows.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = rows.select("conv_id", "turn", said_in(text).alias("said"), symbol_of(text, F.col(speaker) if speaker else None).alias("symbol"))
    blocks = blocks_of(cut(turns.select("conv_id", "turn", "symbol")))
    ends = cut(blocks)
    least = cut(ends.groupBy("conv_id").agg(F.min("block").alias("b0"), F.max("block").alias("b1")).where("b0 < b1").withColumnRenamed("conv_id", "_c"))
    several = not least.isEmpty()
    if several:
        ends = cut(ends.join(least, ends["conv_id"] == least["_c"], "left").select("conv_id", "block", "places", F.coalesce(F.col("block") == F.col("b0"), F.lit(True)).alias("opens"), F.col("b0").isNotNull().alias("several")))
    else:
        ends = ends.select("conv_id", "block", "places", F.lit(True).alias("opens"), F.lit(False).alias("several"))
    model = fit(ends)
    table = model.emission()
    solo = (model.anywhere + table).argmax(axis=1)

    if several:
        kind = pa.struct([("best", pa.list_(pa.float64())), ("open", pa.list_(pa.float64())), ("rest", pa.list_(pa.float64()))])

        def sums(places: pa.Array) -> pa.Array:
            begin, count, at, symbol, n = _entries(places)
            emit, out = _emitted(table, at, symbol, n), []
            for b, c in zip(begin, count, strict=True):
                e = emit[b : b + c]
                out.append({"best": transfer(model.after, e).ravel().tolist(), "open": (model.first + e[0]).tolist(), "rest": _rest(model.after, e).ravel().tolist()})
            return pa.array(out, kind)

        found = ends.where("several").select("conv_id", "block", F.arrow_udf(sums, "best array<double>, open array<double>, rest array<double>")("places").alias("s"))
        chain = cut(found.select("conv_id", "block", "s.*")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "best", "open", "rest"))).alias("blocks"))
        joined = lambda x: pa.array([_chain(v.as_py()) for v in x], pa.list_(pa.struct([("block", pa.int64()), ("before", pa.int32()), ("last", pa.int32())])))
        joined.__annotations__ = {"x": pa.Array, "return": pa.Array}
        bound = cut(chain.select("conv_id", F.inline(F.arrow_udf(joined, "array<struct<block: long, before: int, last: int>>")("blocks")))).withColumnsRenamed({"conv_id": "_c", "block": "_b"})
        ends = ends.join(bound, (ends["conv_id"] == bound["_c"]) & (ends["block"] == bound["_b"]), "left").drop("_c", "_b")
    else:
        ends = ends.withColumns({"before": F.lit(-1), "last": F.lit(-1)})

    def decode(places: pa.Array, before: pa.Array, last: pa.Array) -> pa.Array:
        begin, count, at, symbol, n = _entries(places)
        prior, end = before.to_numpy(zero_copy_only=False), last.to_numpy(zero_copy_only=False)
        start = np.where((prior >= 0)[:, None], model.after[np.maximum(prior, 0)], model.first)
        roles = likeliest(start, model.after, _emitted(table, at, symbol, n), begin, count, end)
        return pa.ListArray.from_arrays(pa.array(np.r_[begin, len(roles)].astype(np.int32)), pa.array(roles.astype(np.int32)))

    udf = F.arrow_udf(decode, "array<int>")("places", F.coalesce("before", F.lit(-1)), F.coalesce("last", F.lit(-1)))
    roles = ends.select("conv_id", F.col("places.turn").alias("turns"), udf.alias("roles"))
    roles = cut(roles.select(F.col("conv_id").alias("_c"), F.inline(F.arrays_zip(F.col("turns").alias("_t"), F.col("roles").alias("_r")))))
    alone = spark.createDataFrame([(i, int(r)) for i, r in enumerate(solo)], "_s int, _alone int")  # SYMBOLS rows
    named = turns.join(roles, (turns["conv_id"] == roles["_c"]) & (turns["turn"] == roles["_t"]), "left").join(F.broadcast(alone), turns["symbol"] == alone["_s"])
    role = F.element_at(F.array(*map(F.lit, ROLES)), F.coalesce("_r", "_alone") + 1)
    return named.select("conv_id", "turn", role.alias("role"), rendered(role, F.col("said")).alias("rendered"))


def _rest(step: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """The best score from each role at a block's first turn to each role at its end, without the first turn's own."""
    n = len(step)
    same = np.where(np.eye(n, dtype=bool), 0.0, -np.inf)
    return transfer(step, emit[1:]) if len(emit) > 1 else same


def _chain(blocks: list[dict]) -> list[dict]:
    """For each block of a conversation, in order: the role before it (-1: none) and the role at its end."""
    n = len(ROLES)
    score = (np.array(blocks[0]["open"])[:, None] + np.array(blocks[0]["rest"]).reshape(n, n)).max(axis=0)
    back = []
    for b in blocks[1:]:
        through = score[:, None] + np.array(b["best"]).reshape(n, n)
        back.append(through.argmax(axis=0))
        score = through.max(axis=0)
    last = [int(score.argmax())]
    for k in reversed(back):
        last.append(int(k[last[-1]]))
    last = last[::-1]
    return [{"block": b["block"], "before": last[i - 1] if i else -1, "last": last[i]} for i, b in enumerate(blocks)]


def rendered(role: Column, text: Column) -> Column:
    """render() as a column."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), strip(text), F.lit("\n<|end|>\n"))


def render(role: str, text: str) -> str:
    """A turn in the one form that all are given: its role's tag, the text without space at its ends, and an end tag."""
    return f"<|{role}|>\n{text.strip()}\n<|end|>\n"


def parse_transcript(text: str | None, model: Model) -> list[tuple[str, str]]:
    """The turns (role, text) of a plain transcript: Viterbi over its lines, of which some begin with a speaker's marker.

    A marked line, or one after a blank line, may begin a turn; any other line mostly goes on with the one before.
    Null and blank transcripts have no turns.
    """
    lines, opens, marks, gap = [], [], [], True
    for line in (text or "").split("\n"):
        if not line.strip():
            gap = True
            continue
        found = _mark.match(line + "\n")
        marks.append(1 + ROLES.index(_NAMED[found[1].lower()]) if found else 0)
        lines.append(line[found.end() :] if found else line)
        opens.append(bool(found) or gap)
        gap = False
    if not lines:
        return []
    n = len(ROLES)
    stay = np.log(np.where(np.eye(n, dtype=bool), GO_ON, (1 - GO_ON) / (n - 1)))
    steps = np.array([model.after if o else stay for o in opens[1:]]).reshape(-1, n, n)
    sizes = np.array([min(int(2 * np.log2(len(x) + 1)), LENGTHS - 1) for x in lines])
    asks = np.array(["?" in x for x in lines], np.int64)
    emit = model.marker[:, marks].T + model.length[:, sizes].T + model.asks[:, asks].T
    roles = viterbi(model.first, steps, emit)
    keys = [0]
    for i in range(1, len(lines)):
        keys.append(keys[-1] + (roles[i] != roles[i - 1] or marks[i] > 0))
    out = []
    for _, group in groupby(range(len(lines)), key=lambda i: keys[i]):
        mine = [*group]
        out.append((ROLES[roles[mine[0]]], "\n".join(lines[i] for i in mine).strip()))
    return out


def parse_transcripts(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per recovered turn of each plain transcript: the key, turn (from 0), role and rendered."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("rendered", pa.string())]))

    def parse(texts: pa.Array) -> pa.Array:
        return pa.array([[{"turn": i, "role": r, "rendered": render(r, s)} for i, (r, s) in enumerate(parse_transcript(x.as_py(), held.value))] for x in texts], kind)

    return docs.select(F.col(key), F.inline(F.arrow_udf(parse, "array<struct<turn: long, role: string, rendered: string>>")(F.col(text))))

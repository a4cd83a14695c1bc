"""Quality rules with host verdicts, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import SPACE_CLASS, bind, cut, fresh, small, words_of

#: The characters that count as symbols.
SYMBOL_CLASS = "[#*$%&|<>]"
WINDOW = 5


def _repeat_words(words: Column, window: int) -> Column:
    """Words covered by windows that occur twice or more. Most texts have none, which a hash set shows; only the others are sorted."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = bind(placed, lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        zero = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(starts, zero, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(window), p - a["last"])).alias("n")), lambda a: a["n"])

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(*[words[i + j] for j in range(window)]))
    some = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(some)


def rule_values(text: Column, window: int = WINDOW) -> Column:
    """A struct of the base figures of a text and base_failed. A null text counts as empty and so fails.

    Repeated windows are told by 64-bit hashes of their words, compared within one text only.
    """
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS[1:-1]}]"))
    part = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w, window).alias("n_repeat_words"),
    )
    return bind(
        F.struct(
            bind(words_of(text), part).alias("w"),
            (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOL_CLASS, ""))).cast("long").alias("n_symbols"),
            bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        ),
        lambda v: F.struct(
            v["w"]["n_words"].alias("n_words"),
            v["w"]["word_chars"].alias("word_chars"),
            v["n_symbols"].alias("n_symbols"),
            v["n_dup_lines"].alias("n_dup_lines"),
            v["w"]["n_repeat_words"].alias("n_repeat_words"),
            ((v["w"]["n_words"] < 10) | (v["w"]["n_repeat_words"] * 100 > v["w"]["n_words"] * 20)).alias("base_failed"),
        ),
    )


def base_fails(text: Column, window: int = WINDOW) -> Column:
    """rule_values()' base_failed alone, without the figures that it doesn't need."""
    few = lambda w: (F.size(w) < 10) | (_repeat_words(w, window) * 100 > F.size(w) * 20)
    return bind(words_of(text), few)


def host_verdicts(counts: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """counts (host, n, failed) with rate, shrunk towards the hosts' mean by a beta prior fitted by moments, and rejected.

    The prior's weight is m(1-m)/v - 1, where v is the variance of the hosts' rates beyond that of binomial
    draws; where there is none, all hosts get nearly the mean. An empty table gives no hosts.
    """
    p = F.col("failed") / F.col("n")
    total = counts.agg(F.sum("n").alias("n"), F.sum("failed").alias("f"), F.count("*").alias("k"), F.sum(p * p * F.col("n")).alias("q")).first()
    n, f, k, q = total["n"] or 0, total["f"] or 0, total["k"], total["q"] or 0.0
    m = f / n if n else 0.0
    drawn = m * (1 - m) * k / n if n else 0.0
    v = max(q / n - m * m - drawn if n else 0.0, 1e-6)
    weight = min(max(m * (1 - m) / v - 1, 1.0), 1e6)
    rate = (F.col("failed") + F.lit(m * weight)) / (F.col("n") + F.lit(weight))
    return counts.withColumn("rate", rate).withColumn("rejected", rate > max_rate)


def judge(docs: DataFrame, host: str = "source", text: str = "text", keep: tuple[str, ...] = ("doc_id",), max_rate: float = 0.5) -> DataFrame:
    """One row per document: the columns of keep, the base figures, base_failed, what was counted of its host (host_rows, host_failed), host_rate, host_rejected and kept.

    A document is kept if it passes the base rules and its host's shrunk failure rate is at most max_rate.
    Null hosts form a host of their own; repeated rows are judged each; other columns are not read, and those of keep may have any names but these.
    The figures are written once to the shared folder, so the texts are read once; hosts are counted with
    map-side sums, and their verdicts are broadcast only if they are few, else joined with split hot hosts.
    """
    own, q, of = fresh("host", "q", "of")
    figures = cut(docs.select(*keep, F.col(host).alias(own), rule_values(F.col(text)).alias(q)))
    counts = figures.groupBy(F.col(own).alias(of)).agg(F.count("*").alias("n"), F.sum(F.col(f"{q}.base_failed").cast("long")).alias("failed"))
    found = host_verdicts(counts, max_rate)
    verdicts = small(found.select(of, F.struct(F.col("n").alias("rows"), "failed", "rate", "rejected").alias(f"v_{of}")))
    joined = figures.join(verdicts, figures[own].eqNullSafe(verdicts[of]), "left")
    v = F.col(f"v_{of}")
    kept = ~F.col(f"{q}.base_failed") & ~F.coalesce(v["rejected"], F.lit(False))
    return joined.select(*keep, f"{q}.*", v["rows"].alias("host_rows"), v["failed"].alias("host_failed"), v["rate"].alias("host_rate"), v["rejected"].alias("host_rejected"), kept.alias("kept"))


def keep_good(docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = 0.5) -> DataFrame:
    """The documents that judge() keeps, with their own columns, whatever their names.

    The rules are computed once: documents that pass are written to the shared folder, and how many of a host failed is what is missing there of its
    rows, for which no text is read. Should there be more rejected hosts than may be broadcast, the documents are shuffled by host instead.
    """
    of, n = fresh("of", "n")
    passed = cut(docs.where(~base_fails(F.col(text))))
    rows = docs.select(F.col(host).alias(of), F.lit(1).alias(n), F.lit(1).alias("failed"))
    rows = rows.union(passed.select(F.col(host).alias(of), F.lit(0).alias(n), F.lit(-1).alias("failed")))
    counts = rows.groupBy(of).agg(F.sum(n).alias("n"), F.sum("failed").alias("failed"))
    rejected = cut(host_verdicts(cut(counts), max_rate).where("rejected").select(of))
    return passed.join(small(rejected), passed[host].eqNullSafe(rejected[of]), "left_anti")

"""The corpus operators against straight-line versions, on small tables with nulls, ties, repeats and clashing names."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirefold.llm import decontaminate, graph, mixing, quality_rules, sharding, similar, simhash, substring, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, fp string, shard int"


def words(rng: random.Random, n: int, alphabet: int = 60) -> str:
    return " ".join(f"w{rng.randrange(alphabet)}" + rng.choice(["", "", ".", "\n"]) for _ in range(n))


def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    passage = words(rng, 70, 10**6)
    texts: list[str | None] = [words(rng, rng.randrange(3, 200)) for _ in range(40)]
    texts += [None, "", "   \n", "one", "one two", texts[0], texts[0], texts[1] + " tail", "again " * 100, "a b c d e " * 30, words(rng, 30000, 10**6)]
    texts += [words(rng, 50) + "\n" + passage + "\n" + words(rng, 20), passage, words(rng, 5) + " " + passage[: len(passage) // 2], "É\x85x\xa0y z"]
    return [*enumerate(texts), (None, "no id here " * 5), (None, None), (3, texts[3])]


def frame(spark, rows=None):
    rows = corpus() if rows is None else rows
    return spark.createDataFrame([(i, t, None, ["a", "a", "a", "b", None][k % 5], len(t or ""), "x", "y", 7) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


def test_quality_figures(docs):
    got = quality_rules.judge(docs.withColumn("n_words", F.lit("clash")), keep=("doc_id", "text")).collect()
    assert len(got) == len(corpus())
    for r in got:
        w = brute.words(r.text)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (r.text or "").split("\n") if brute.words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "") and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.kept and r.base_failed)


def test_bad_hosts_are_rejected_and_good_ones_kept(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, 60, 10**6), "good") for i in range(200)] + [(1000 + i, "spam " * 50 if i % 10 else words(rng, 60, 10**6), "bad") for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality_rules.judge(table).where("kept").collect()}
    assert kept == set(range(200)) == {r.doc_id for r in quality_rules.keep_good(table).collect()}


def test_quality_of_no_documents(docs):
    assert quality_rules.judge(docs.limit(0)).collect() == [] and quality_rules.keep_good(docs.limit(0)).columns == docs.columns


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(0, 40), f"s{i % 4}" if i % 9 else None) for i in range(3000)] + [(1, None, "s1"), (1, None, "s1"), (None, "a b", "s0")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped: set = set()
    while True:
        free = [s for s in order if s not in capped]
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        due = {s: left * weight[s] / sum(weight[f] for f in free) for s in free} | {s: 2 * size[s] for s in capped}
        over = {s for s in free if due[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    for s in order:
        assert target[s] == pytest.approx(due[s]) and taken[s] == pytest.approx(due[s], rel=0.02)


def test_mixing_emits_what_it_takes_and_agrees_with_itself(docs):
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r.doc_id] += r.copies if r.size else 0
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns
    first = Counter(r.doc_id for r in emitted.collect())
    assert first == +plan == Counter(r.doc_id for r in mixing.emit(docs).collect())
    assert mixing.mix(docs.limit(0)).collect() == [] and mixing.emit(docs.limit(0)).collect() == []


def test_a_row_repeated_often_is_spread(spark):
    rows = [(7, "x" * 90)] * 2000 + [(None, None)] * 500 + [(i, "y" * 50) for i in range(100)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    load = defaultdict(int)
    for r in got:
        load[r.shard] += r["size"]
    assert len(load) == 16 and max(load.values()) <= 1.03 * min(load.values())
    for shard in load:
        assert sorted(r.slot for r in got if r.shard == shard) == [*range(sum(r.shard == shard for r in got))]
    again = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


CLASHING = ("_source", "_n", "_rate", "_seed", "_fp", "_h", "_key", "_host", "_q", "_of", "n", "failed", "size", "word", "component_id", "root", "copies", "items", "class", "part")


def test_pipeline_stages_keep_columns_of_any_name(spark):
    bench = [(1, "which town is the seat of the old court of salt and rope. It is Ombra on the river.")]
    own = [(i, words(random.Random(i), 60, 10**6), "s", 1) for i in range(30)]
    rows = [*own, (3, own[3][1], "s", 1), (90, own[5][1] + " more", "s", 1), (91, own[6][1] + " " + bench[0][1], None, 1), (92, "short", "t", 1), (None, own[7][1], "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int").withColumns({c: F.lit(f"mine {c}") for c in CLASHING})
    table = spark.createDataFrame(bench, "item_id long, text string")
    for stage in (quality_rules.keep_good, simhash.keep_first, similar.keep_first, lambda d: decontaminate.keep_clean(d, table), mixing.emit):
        out = stage(docs)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        assert all(r[c] == f"mine {c}" for r in out.collect() for c in CLASHING)
        assert stage(docs.limit(0)).collect() == []
        docs = docs if stage is simhash.keep_first else out
    assert sharding.assign(docs).count() == docs.count() and sharding.assign(docs.limit(0)).collect() == []
    left = {r.doc_id for r in docs.collect()}
    assert 91 not in left and 92 not in left


def test_simhash_against_brute_force(docs):
    rows = [(i, t) for i, t in dict(r for r in corpus() if r[0] is not None).items()]
    want = brute.components(rows)
    got = simhash.near_duplicates(docs.where("doc_id IS NOT NULL")).collect()
    assert len(got) == len(rows) + 1
    assert {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got} == {(i, *v) for i, v in want.items()}
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_one_document_of_each_component_stays(docs):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, brute.fingerprint(r.text)) for r in kept.collect()]
    prints = {brute.fingerprint(t) for _, t in corpus()}
    for x in prints:
        assert any((x ^ y).bit_count() <= 3 for _, y in got) or any((x ^ z).bit_count() <= 3 for z in prints if z != x)
    assert len({p for _, p in got}) == len(got)
    assert (3, brute.fingerprint(dict(corpus())[3])) in got and sum(i is None for i, _ in got) == 1


@pytest.mark.parametrize(("tile", "blocks"), [(8, 4), (5, 5), (3, 6), (4096, 4)])
def test_links_connect_all_near_fingerprints(spark, tile, blocks):
    rng = random.Random(tile)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    prints = set(base)
    for b in base[:12]:
        for _ in range(8):
            prints.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(1, 5))))
    signed = [(simhash._signed(p),) for p in prints]
    found = {r.node: r.root for r in graph.components(simhash.links(spark.createDataFrame(signed, "fp long"), tile, blocks)).collect()}
    rows = sorted(p for (p,) in signed)
    want = {p: p for p in rows}
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    for _ in rows:
        new = {p: min(want[q] for q in rows if near(p, q)) for p in rows}
        if new == want:
            break
        want = new
    assert {p: found.get(p, p) for p in rows} == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(1000, 1040), 1000)}


def test_repeats_against_brute_force(docs):
    rows = corpus()
    want = brute.repeats_removed([*enumerate(t for _, t in rows)])
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs).collect())
    assert got == Counter((rows[k][0], *v) for k, v in want.items())
    assert substring.remove_repeats(docs.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), min_size=1, max_size=3))
def test_locating_finds_every_place(texts):
    raw = {k: [w.encode() for w in t] for k, t in enumerate(texts)}
    phrases = [list(p) for p in {tuple(t[s : s + n]) for t in raw.values() for s in range(0, len(t) - 6, 7) for n in (5, 6)}]
    for k, got in substring.locate(raw, phrases).items():
        assert sorted(got) == sorted((i, at) for i, p in enumerate(phrases) for at in range(len(raw[k]) - len(p) + 1) if raw[k][at : at + len(p)] == p)


def test_pairs_of_letters_spell_large_vocabularies(monkeypatch):
    monkeypatch.setattr(substring, "_VOCABULARY", 10)
    raw = {0: [b"w%d" % i for i in range(80)], 1: [b"w%d" % i for i in range(40, 80)]}
    assert substring.locate(raw, [raw[1][:36], raw[0][3:9]]) == {0: [(1, 3), (0, 40)], 1: [(0, 0)]}


def test_a_phrase_found_once_is_not_removed():
    words = b" ".join(b"w%d" % i for i in range(40))
    table = lambda *seen: pa.table({"m": [1] * len(seen), "c": [*range(len(seen))], "seen": [*seen], "words": [words + b" x%d" % i for i in range(len(seen))]})
    phrase = pa.table({"words": [words], "parts": [1]})
    assert substring._locate_shard(table(1), phrase).num_rows == 0
    assert substring._locate_shard(table(1, 1), phrase).to_pylist() == [{"m": 1, "c": c, "runs": [{"pos": 0, "n": 6}]} for c in (0, 1)]
    assert substring._locate_shard(table(1), pa.table({"words": [words], "parts": [2]})).num_rows == 1


@pytest.mark.parametrize("part", [10_000, 2])
def test_a_common_passage_in_many_documents(spark, monkeypatch, part):
    monkeypatch.setattr(substring, "PART", part)
    rng = random.Random(part)
    common, other = words(rng, 50, 10**6), words(rng, 44, 10**6)
    rows = [(i, f"{words(rng, rng.randrange(1, 40), 10**6)} {common} {words(rng, rng.randrange(1, 40), 10**6)} {other[: rng.choice([0, 250, 400])]}") for i in range(60)]
    want = brute.repeats_removed(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and all(n >= 50 for _, n, _ in got.values())


@given(st.lists(st.booleans()))
def test_what_is_left(gone):
    words = [b"%d" % i for i in range(len(gone))]
    assert substring._left(words, np.array(gone, bool)) == b" ".join(w for w, g in zip(words, gone, strict=True) if not g)


def test_shards_are_even_gapless_and_stable(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randrange(5000)) for i in range(4000)] + [(7, "same")] * 5 + [(None, None)] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.assign(table, map_path=str(tmp_path / "map")).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"}
    load, places = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.shard] += r["size"]
        places[r.shard].append(r.slot)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len(t or "") + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert max(load.values()) <= 1.02 * min(load.values()) and all(sorted(p) == [*range(len(p))] for p in places.values())
    assert Counter(map(tuple, got)) == Counter(map(tuple, sharding.assign(table).collect()))
    one = sharding.load_map(spark, str(tmp_path / "map"))
    slot_bytes = defaultdict(int)
    for r in got:
        slot_bytes[r.vslot] += r["size"]
    two = sharding.rebalanced(one, slot_bytes, 17)
    assert sharding.load_map(spark, str(tmp_path / "map"), 1) == sharding.even_map(16) and sharding.load_map(spark, str(tmp_path / "map"), 2) == one
    assert sharding.store_map(spark, str(tmp_path / "map"), two) == 3 and sharding.load_map(spark, str(tmp_path / "map"), 2) == one
    grown = [sum(b for v, b in slot_bytes.items() if two[v] == s) for s in range(17)]
    assert max(grown) - min(grown) <= 0.03 * sum(grown) / 17 and all(two[v] == 16 or one[v] == s for v, s in two.items() if s == one[v] or s == 16)
    assert {s for s in sharding.rebalanced(two, slot_bytes, 8).values()} <= set(range(8))
    assert sharding.assign(table.limit(0)).collect() == []


def items(n: int = 60) -> list[tuple[int, str | None]]:
    rng = random.Random(9)
    return [(i, " ".join(f"k{rng.randrange(3000)}" if rng.random() < 0.6 else rng.choice("the of and in to".split()) for _ in range(rng.randrange(12, 50))) + ". The answer is " + f"k{i} k{i + 1}.") for i in range(n)] + [(900, None), (901, ""), (902, "one")]


def test_wand_retrieves_all_above_the_threshold():
    (index,) = decontaminate.Index(items(), score=0.2).classes
    rng = random.Random(4)
    for _ in range(60):
        part = decontaminate.tokens(rng.choice(items()[:60])[1].lower()) + decontaminate.tokens(rng.choice(items()[:60])[1].lower())
        terms = sorted({index.terms[w] for w in rng.sample(part, len(part) // 2)})
        want = defaultdict(float)
        for t in terms:
            for at, x in zip(*index.postings[t], strict=True):
                want[at] += x
        assert {i: pytest.approx(s) for i, s in index.wand(terms)} == {i: s for i, s in want.items() if s >= 0.2}


def test_contaminated_documents_are_found(spark):
    rng = random.Random(6)
    bench, rows = items(), []
    for i in range(200):
        text = words(rng, rng.randrange(0, 400), 5000)
        if i % 5 == 0:
            at = rng.randrange(len(text) + 1)
            text = text[:at] + " " + bench[i % 60][1].upper() + " " + text[at:]
        rows.append((i, text))
    rows += [(500, None), (500, None), (None, bench[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, table).collect()}
    assert got == {(i, i % 60) for i in range(0, 200, 5)} | {(None, 3)}
    assert {r.doc_id for r in decontaminate.keep_clean(docs, table).collect()} == {i for i in range(200) if i % 5} | {500}
    assert decontaminate.contaminated(docs, table.limit(0)).collect() == [] and decontaminate.contaminated(docs.limit(0), table).collect() == []


def test_bounds_pass_over_no_passage():
    (index,) = decontaminate.Index(items()).classes
    rng = random.Random(8)
    for _ in range(30):
        text = words(rng, 300, 5000) + " " + rng.choice(items()[:60])[1] + " " + words(rng, rng.randrange(300), 5000)
        ids = np.array([index.terms.get(w, len(index.terms)) for w in decontaminate.tokens(text.lower())])
        kept = set(index.passages(ids))
        for at in range(0, len(ids), index.stride):
            terms = [int(t) for t in np.unique(ids[at : at + 2 * index.stride]) if t < len(index.terms)]
            assert at in kept or not index.wand(terms)


def test_toxicity_learns_from_one_row_of_each_labelled_document(spark):
    """Repeated rows of an id, however many, count once, by its least text; other columns may have any names."""
    rows = [(i, "vile awful words" if i % 3 == 0 else "good clean words here") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(rows, "doc_id long, text string")
    more = spark.createDataFrame([*rows, *[(3, f"zz {i}") for i in range(500)], (None, "x")], "doc_id long, text string").withColumns({"grade": F.lit(1), "f": F.lit("x"), "toxic": F.lit(True)})
    a, b = toxicity.train(once, labels), toxicity.train(more, labels)
    assert repr(a) == repr(b)


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(11)
    bad = ["idiotic", "moronesque", "scumbag"]
    rows, labels = [], []
    for i in range(1200):
        text = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randrange(5, 120))]
        toxic = i % 6 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text)))
        if i < 800:
            labels.append((i, int(i % 12 != 0), int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    table = spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.graded(docs, table).collect()}
    assert len(got) == 1202 and all(got[i].toxic == (i % 6 == 0) for i in range(800, 1200))
    assert not got[5000].toxic and not got[5001].toxic and all(0 <= r.expected_severity <= 2 for r in got.values())
    assert min(r.expected_severity for r in got.values() if r.toxic) > max(r.expected_severity for r in got.values() if not r.toxic)
    none = toxicity.graded(docs, table.limit(0)).collect()
    assert len(none) == 1202 and toxicity.graded(docs.limit(0), table).collect() == []


def test_cuts_are_in_order_and_weights_shared():
    model = toxicity.fit([([1, 2], 0)] * 50 + [([2, 3], 1)] * 20 + [([3, 4], 2)] * 20)
    assert model.cuts == sorted(model.cuts) and set(model.weights) <= {1, 2, 3, 4} and model.weights[4] > 0
    assert toxicity.fit([]).weights == {}


def test_the_mix_takes_columns_of_any_name(spark):
    docs = frame(spark).withColumn("a.b", F.lit(1)).withColumn("tick`", F.lit("x")).withColumn("rate", F.lit(2))
    got = mixing.emit(docs)
    assert got.columns == docs.columns and got.count() == mixing.mix(docs).where("size > 0").agg(F.sum("copies")).first()[0]

"""Operators that compare texts with the corpus: 2, 4, 5, 6, 8, 10, and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from llm_fixtures import DOC, SF_SMALL, VOCAB, awkward, clashing, empty, near_rows, sentence, text_of  # noqa: F401

import __spark_entry__ as entry
import corpus_pipeline
from ballot.llm import elias_fano, graph, language_model, linededup, mixing, neardup, sharding, substring


# ------------------------------------------------------------ Elias-Fano


@pytest.mark.parametrize(("n", "top"), [(0, 10), (1, 1), (1000, 2**64 - 1), (5000, 6000), (3000, 2**40), (10, 3)])
def test_sequences(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
    s = elias_fano.Sequence(elias_fano.encode(v))
    assert (s.values() == v).all()
    q = np.unique(np.concatenate([v, rng.integers(0, top, 500, dtype=np.uint64)]))
    at, found = s.successor(q)
    assert (found == np.isin(q, v)).all() and (v[at[found]] == q[found]).all()


def test_trie_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64 - 1, 5000, dtype=np.uint64) & np.uint64(0xFF00000FFFFFFFFF))
    codes = rng.integers(1, 256, len(keys)).astype(np.uint8)
    trie = elias_fano.Trie(*elias_fano.Trie.build(keys, codes))
    assert (trie.lookup(keys) == codes).all()
    other = np.setdiff1d(keys ^ np.uint64(1), keys)
    assert not trie.lookup(other).any()


def brute_model(rows, mu):
    tokens = [(d, (t or "").encode().lower().split() + [0]) for d, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    c, p = Counter(), Counter()
    for (_, w), h in zip(tokens, held):
        if not h:
            c.update(w)
            p.update(zip([0] + w, w))
    n, v = sum(c.values()), len(c)
    u = lambda x: (c[x] + 0.5) / (n + 0.5 * (v + 1))
    for (d, w), h in zip(tokens, held):
        base = sum(math.log10(u(x)) for x in w)
        score = sum(math.log10((p[a, x] + mu * u(x)) / (c[a] + mu)) for a, x in zip([0] + w, w))
        yield d, h, len(w), sum(c[x] > 0 for x in w), n, base, score


def test_lm_equals_brute_force(spark, awkward, monkeypatch):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(VOCAB[: rng.choice([5, 100])]) for _ in range(rng.randint(0, 60)))
    rows = [(i, text()) for i in range(200, 400)] + [(r.doc_id, r.text) for r in awkward.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(language_model, "FLUSH_TOKENS", 2_000)
    monkeypatch.setattr(language_model, "FREQUENT", 100)  # so the shards have work
    key = lambda x: (x[0] is None, x[0] or 0, x[2], x[5])
    got = sorted((tuple(r) for r in language_model.score_documents(docs, mu=50.0).collect()), key=key)
    want = sorted(brute_model(rows, 50.0), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        # each pair's gain is rounded to 1 / 25 of a power of ten
        assert abs(g[6] - w[6]) <= w[2] * 0.5 / language_model.STEP + 1e-6


def test_lm_beats_its_base_on_held_out_texts(spark):
    got = entry.queries()["op2_lm_scoring"](spark, SF_SMALL).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > got["sum(base_score)"]


def test_lm_without_training_rows(spark, empty):
    assert language_model.score_documents(empty).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    one = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    r = language_model.score_documents(one).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


# ------------------------------------------------------------- line dedup


def brute_lines(rows):
    key = lambda x: x.encode().strip().lower().decode()
    order = lambda d: math.inf if d is None else d
    own = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                own[key(x)] = min(own.get(key(x), math.inf), order(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or own[key(x)] >= order(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (9, 3)])
def test_line_dedup_equals_brute_force(spark, batches, fanout):
    rng = random.Random(batches)
    lines = ["  Common line Number one ", "common line number one", "ÄÖÜ äöü ßß tab\t", "short", "", "\x0bexactly10!", "exactly 9"] + [f"line of words {i}" for i in range(30)]
    rows = [(rng.randint(0, 60), "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 12)))) for _ in range(80)]
    rows += [(None, "line of words 3\nnull only line"), (None, "null only line"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda x: (str(x[0]), x[3])
    got = sorted((tuple(r) for r in linededup.dedup_lines(docs, batches=batches, fanout=fanout).collect()), key=key)
    assert got == sorted(brute_lines(rows), key=key)


def test_runs_are_levelled(spark):
    runs = linededup.Runs(spark, 2)
    for i in range(7):
        runs.add(spark.createDataFrame([(i, i, i)], "k1 long, k2 long, owner long"))
    assert [len(x) for x in runs.levels] == [1, 1, 1]
    assert sorted(r.owner for run in runs.read() for r in run.collect()) == list(range(7))


def test_line_dedup_of_awkward_rows(awkward, clashing, empty):
    assert linededup.dedup_lines(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    key = lambda x: (str(x[0]), x[3])
    assert sorted((tuple(r) for r in linededup.dedup_lines(clashing).collect()), key=key) == sorted(brute_lines(rows), key=key)


# ----------------------------------------------------------------- mixing


def brute_targets(sizes, weights, share=1.5, epochs=2):
    total, clamped = share * sum(sizes.values()), set()
    while True:
        free = sum(w for s, w in weights.items() if s not in clamped)
        level = (total - sum(epochs * sizes[s] for s in clamped)) / free if free else 0
        over = {s for s, w in weights.items() if s not in clamped and level * w > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in clamped else level * weights[s] for s in sizes}
        clamped |= over


@pytest.fixture(scope="module")
def mixed_rows():
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        source = rng.choice(["hot"] * 6 + ["a", "b", "Z", "é", None])
        rows.append((i, " ".join(["w"] * rng.choice([1, 5, 20, 100])), "en", source, 1))
    return rows


def test_mixing_meets_the_targets(spark, mixed_rows):
    docs = spark.createDataFrame(mixed_rows, DOC)
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(mixed_rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert r.taken in (0, r["size"], 2 * r["size"])
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = brute_targets(sizes, weights)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.01 * sizes[s]
    again = {(r.doc_id, r.taken) for r in mixing.mix_report(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in got}
    # the mix is what the report says
    copies = Counter(r.doc_id for r in mixing.mix(docs).collect())
    size = {r.doc_id: r["size"] for r in got}
    assert {d: n * size[d] for d, n in copies.items()} == {r.doc_id: r.taken for r in got if r.taken}


def test_mixing_with_given_weights(spark, mixed_rows):
    docs = spark.createDataFrame(mixed_rows, DOC).filter("source in ('hot', 'a')")
    weights = spark.createDataFrame([("hot", 1.0), ("a", 3.0)], "source string, weight double")
    got = mixing.mix_report(docs, share=0.3, weights=weights).groupBy("source", "target").agg({"taken": "sum"}).collect()
    for r in got:
        assert r["sum(taken)"] == pytest.approx(r.target, abs=100)


def test_mixing_of_awkward_rows(spark, awkward, clashing, empty):
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0
    got = mixing.mix_report(awkward).collect()
    assert len(got) == awkward.count()
    assert len({r.taken for r in got if r.doc_id == 6}) == 1
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns and mixed.subtract(clashing).count() == 0
    none = spark.createDataFrame([(1, None, "en", "a", 0), (2, " ", "en", None, 0)], DOC)
    assert [r.taken for r in mixing.mix_report(none).collect()] == [0, 0]


# --------------------------------------------------------------- sharding


def brute_table(names, size):
    """Slots by whole preference lists."""
    orders = []
    for s in names:
        d = hashlib.md5(s.encode()).hexdigest()
        o, k = int(d[:16], 16) % size, int(d[16:], 16) % (size - 1) + 1
        orders.append(iter([(o + j * k) % size for j in range(size)]))
    owner = {}
    while True:
        for i, order in enumerate(orders):
            owner[next(x for x in order if x not in owner)] = i
            if len(owner) == size:
                return [owner[x] for x in range(size)]


def test_lookup_table():
    names = [f"n{i}" for i in range(7)]
    table = sharding.lookup_table(names, 101)
    assert table.tolist() == brute_table(names, 101)
    full = sharding.lookup_table([f"n{i}" for i in range(64)])
    counts = np.bincount(full)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table([f"n{i}" for i in range(63)])
    moved = (full != fewer) & (full != 63)
    assert moved.mean() < 0.05
    for bad in (["a", "a"], []):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 100)


def test_shards_of_awkward_rows(awkward, clashing, empty):
    names = ["x", "y", "z"]
    table = sharding.lookup_table(names)
    assert sharding.assign_shards(empty, "doc_id", names).count() == 0
    out = sharding.assign_shards(clashing, "doc_id", names)
    assert out.columns == [c for c in clashing.columns if c != "slot"] + ["slot", "shard"]
    got = out.collect()
    assert len(got) == awkward.count()
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.TABLE_SIZE
        assert r.shard == names[table[r.slot]]


def test_shards_are_written(spark, awkward, tmp_path):
    path = f"file://{tmp_path}/shards"
    sharding.write_shards(awkward, path, "doc_id", ["x", "y"], 2)
    assert spark.read.parquet(path).count() == awkward.count()


@pytest.mark.parametrize("shards", [8, 22, 64, 512, 1024])
def test_document_rows_are_spread_over_all_shards(shards):
    held = Counter(language_model._home((task << 36) + batch * 4096, shards) for task in range(shards) for batch in range(32))
    assert len(held) > 0.9 * shards and max(held.values()) < 4 * 32


# -------------------------------------------------------- substring dedup


def brute_units(rows, **options):
    first, out = {}, []
    order = sorted(((math.inf if d is None else d), d, t or "") for d, t in rows)
    for rank, d, t in order:
        for s, e, k in substring.units(t, **options):
            if k in first and (rank, s) > first[k][:2]:
                out.append((d, s, e, first[k][2], first[k][1]))
            else:
                first.setdefault(k, (rank, s, d))
    return sorted(out, key=str)


@pytest.mark.parametrize("unit", ["sentence", "line", "paragraph"])
def test_removed_units_equal_brute_force(spark, unit):
    rng = random.Random(4)
    passages = [text_of(rng, 70) for _ in range(4)] + [sentence(rng, 90)]
    rows = []
    for i in range(60):
        words = text_of(rng, rng.randint(0, 120))
        if i % 3 == 0:
            at = rng.randint(0, len(words))
            words = words[:at] + " " + rng.choice(passages) + " " + words[at:]
        if i % 7 == 0:
            words += "\n\n" + words
        rows.append((i // 2 * 2 if i % 10 == 0 else i, words))
    rows = list({d: (d, t) for d, t in rows}.values()) + [(None, passages[0]), (None, None), (999, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = substring.removed_units(docs, unit=unit, min_chars=30)
    got = sorted((tuple(r)[:5] for r in removed.collect()), key=str)
    assert got == brute_units(rows, unit=unit, min_chars=30) and got
    cut = {r.doc_id: r.text for r in substring.remove_units(docs, removed).collect() if r.doc_id is not None}
    gone = defaultdict(set)
    for d, s, e, *_ in got:
        gone[d] |= set(range(s, e))
    for d, t in rows:
        if d is not None:
            assert cut[d] == (None if t is None else "".join(c for i, c in enumerate(t) if i not in gone[d]))


def test_passages_inside_lines_are_found_and_clean_texts_left(spark):
    rng = random.Random(14)
    passage = text_of(rng, 80).replace("\n", " ")
    clean = [(i, text_of(rng, 150)) for i in range(50)]
    shared = [(100 + i, f"{text_of(rng, 37)[:-1]} {passage} {text_of(rng, 41)}") for i in range(5)]
    docs = spark.createDataFrame(clean + shared, "doc_id long, text string")
    assert {r.doc_id for r in substring.removed_units(docs, unit="sentence", min_chars=40).collect()} == {101, 102, 103, 104}
    assert {r.doc_id for r in substring.removed(docs).collect()} == {101, 102, 103, 104}


def test_units_of_awkward_rows(awkward, clashing, empty):
    assert substring.removed_units(empty).count() == 0
    removed = substring.removed_units(clashing)
    ids = {r.doc_id for r in removed.collect()}
    assert {None, 7, 8} <= ids and 6 not in ids
    out = substring.remove_units(clashing, removed)
    assert out.columns == clashing.columns and out.count() == clashing.count()


def brute_passages(rows, n=50):
    """Characters of words that lie in a window of n words met before, by id
    and place; of a window that overlaps its own first occurrence only those beyond it."""
    first, gone = {}, defaultdict(set)
    for d, t in sorted(rows, key=lambda r: math.inf if r[0] is None else r[0]):
        at = [m.span() for m in re.finditer(r"[^ \t-\r]+", t or "")]
        w = [t[a:b].lower().strip(".,;:!?\"'()[]") or t[a:b] for a, b in at]
        own = {}
        for p in range(len(w) - n + 1):
            key = tuple(w[p : p + n])
            q = own.setdefault(key, p)
            if first.setdefault(key, (d, p)) != (d, p):
                gone[d] |= {i for j in range(p if q == p else max(p, q + n), p + n) for i in range(*at[j])}
    return gone


def test_passages_equal_brute_force_of_word_windows(spark):
    rng = random.Random(21)
    verse = ["\n".join(sentence(rng, 4) for _ in range(15)), "\n".join(f"- {sentence(rng, 2)};" for _ in range(30))]
    prose = [sentence(rng, n) for n in (50, 51, 64, 90)] + [text_of(rng, 75), " ".join("É" + w for w in sentence(rng, 55).split())]
    rows = []
    for i in range(90):
        words = sentence(rng, rng.randint(0, 160)).split()
        if i % 2:
            at = rng.randint(0, len(words))
            words[at:at] = [rng.choice(verse + prose)]
        if i % 17 == 0:
            words += words
        rows.append((i, " ".join(words)))
    rows += [(100, "la " * 300 + sentence(rng, 60)), (101, "one two three " * 40), (102, None), (103, sentence(rng, 49)), (None, prose[3]), (104, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, got = brute_passages(rows), defaultdict(set)
    texts = dict(rows)
    assert sum(map(len, want.values())) > 10_000 and {100, 101, 104, None} <= set(want)
    for r in substring.removed_passages(docs).collect():
        new = {i for i in range(r.char_start, r.char_end) if texts[r.doc_id][i] not in " \n"}
        assert new and not new & got[r.doc_id]
        got[r.doc_id] |= new
        assert (r.kept_doc_id, r.kept_start) != (r.doc_id, r.char_start) and r.kept_doc_id is not None
    assert dict(got) == dict(want)
    both = substring.removed(docs)
    cut = {r.doc_id: r.text for r in substring.remove_units(docs, both).collect()}
    for d, t in rows:
        left = {i for i, c in enumerate(t or "") if c not in " \n"} - want[d]
        assert len("".join((cut[d] or "").split())) <= len(left)
    # verse was kept whole by units alone
    lines = spark.createDataFrame([(1, verse[0]), (2, "a b c\n" + verse[0])], "doc_id long, text string")
    assert substring.removed_units(lines).count() == 0
    assert [tuple(r)[:5] for r in substring.removed(lines).collect()] == [(2, 6, 6 + len(verse[0]), 1, 0)]


def test_a_passage_of_a_third_of_all_texts_is_dealt_over_parts(spark):
    rng = random.Random(33)
    hot, page = sentence(rng, 120), sentence(rng, 200)
    rows = [(i, f"{sentence(rng, 40)} x{i} {hot} y{i} {sentence(rng, 40)}" if i % 3 == 0 else page if i % 3 == 1 else sentence(rng, 90)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts, gone = dict(rows), defaultdict(set)
    for r in substring.removed_passages(docs).collect():
        gone[r.doc_id] |= {i for i in range(r.char_start, r.char_end) if texts[r.doc_id][i] != " "}
        assert (r.kept_doc_id, r.kept_start) == ((0, texts[0].index(hot)) if r.doc_id % 3 == 0 else (1, 0))
    assert dict(gone) == dict(brute_passages(rows)) and len(gone) == 398


def test_passages_of_awkward_rows(awkward, clashing, empty):
    assert substring.removed(empty).count() == 0
    gone = substring.removed(clashing)
    assert {None, 7, 8} <= {r.doc_id for r in gone.collect()} and not gone.filter("doc_id = 6").count()
    out = substring.remove_units(clashing, gone)
    assert out.columns == clashing.columns and out.count() == clashing.count()


# -------------------------------------------------------------- near-dedup


def brute_components(rows, shingle=3, num=85, den=100):
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        n = min(shingle, len(w))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


@pytest.mark.parametrize("options", [{}, corpus_pipeline.NEAR])
def test_near_duplicates_equal_brute_force(spark, near_rows, options):
    docs = spark.createDataFrame(near_rows, DOC).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in neardup.near_duplicates(docs, **options).collect()}
    want = brute_components(near_rows, **{k: options[k] for k in ("shingle", "num", "den") if k in options})
    assert got == want
    assert sum(not x[2] for x in want.values()) > 60
    kept = neardup.keep_first(docs, **options)
    assert {r.doc_id for r in kept.collect()} == {d for d, x in want.items() if x[2]}


def test_similar_pairs_pass_the_sketch():
    """Pairs at the threshold pass; unrelated sets do not."""
    signer = neardup.Signer(8, 48)
    limit = neardup.max_odd(0.85, 384)
    rng = np.random.default_rng(5)
    for _ in range(60):
        base = rng.integers(0, 2**63, 460, dtype=np.uint64)
        other = base.copy()
        other[:37] = rng.integers(0, 2**63, 37, dtype=np.uint64)  # 423 of 497 in common
        a, b = (signer.sign(np.unique(x)) for x in (base, other))
        assert int(np.bitwise_count(a[1] ^ b[1]).sum()) <= limit
        assert (a[0] == b[0]).any()
        # at most one bit for each element that only one set has
        assert int(np.bitwise_count(a[2] ^ b[2]).sum()) <= 74
        c = signer.sign(rng.integers(0, 2**63, 460, dtype=np.uint64))
        assert int(np.bitwise_count(a[1] ^ c[1]).sum()) > limit


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(45)] + [(7, 7)]
    top = {}
    find = lambda x: x if top.setdefault(x, x) == x else find(top[x])
    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in top if any(x in e and e[0] != e[1] for e in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_awkward_rows(awkward, clashing, empty):
    assert neardup.near_duplicates(empty).count() == 0
    got = neardup.near_duplicates(clashing).collect()
    assert len(got) == awkward.count()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.component_id, r.kept))
    assert by[None] == {(None, True)}
    assert by[1] == {(1, True)} and by[2] == {(2, True)} and by[6] == {(6, True)}
    assert by[7] == {(6, False)} and by[8] == {(6, False)} and by[9] == {(9, True)}
    kept = neardup.keep_first(clashing)
    assert kept.columns == clashing.columns and kept.count() == awkward.count() - 2


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, clashing, empty):
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    for docs in (clashing, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF_SMALL).columns == docs.columns


def test_pipeline_equals_its_parts(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert got.columns == [*docs.columns, "slot", "shard"]
    rows = got.collect()
    assert rows and all(texts[r.doc_id] == r.text for r in rows)
    kept = {r.doc_id for r in rows}
    near = brute_components([(d, texts[d]) for d in kept], 5, 80)
    assert all(x[2] for x in near.values())
    leaks = entry.queries()["op1_decontaminate"](spark, SF_SMALL).collect()
    assert leaks and not kept & {r.doc_id for r in leaks}


# ------------------------------------------------------------------ oracle


@pytest.mark.parametrize("name", sorted(entry.LLM_ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = entry.queries()[name](spark, SF_SMALL)
    cur = con.execute(entry.LLM_ORACLE[name])
    cols = sorted(d[0] for d in cur.description)
    want = [dict(zip([d[0] for d in cur.description], r)) for r in cur.fetchall()]
    got = [r.asDict() for r in df.collect()]
    assert sorted(df.columns) == cols
    flat = lambda rows: sorted(tuple(repr(r[c]) for c in cols) for r in rows)
    assert flat(got) == flat(want)

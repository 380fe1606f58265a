"""Near-duplicates, line dedup, neighbour search and toxicity."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import ann, line_dedup, links, near_dedup, toxicity


def chain(items, step):
    want, last = {}, None
    for i in sorted(items):
        root = want[last] if last is not None and i - last <= step else i
        want[i], last = root, i
    return want


def test_links_are_found_without_all_pairs(spark):
    """A chain whose ends are far from the pivot, in groups of one key, and a
    tight group, in which few pairs are compared."""
    rng = random.Random(2)
    items = rng.sample(range(1000), 60)
    tight = range(2000, 3000)
    groups = spark.createDataFrame([(g, i) for g in (1, 2) for i in items] + [(3, i) for i in tight], "g long, item long")
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.where((F.abs(F.col("a") - F.col("b")) <= 17) | (F.col("a") >= 2000))

    parts, _ = links.linked(groups, verify, lambda x, y: F.lit(True))
    got = {r.item: r.component for r in parts.collect()}
    want = chain(items, 17)
    lone = {i for i in items if list(want.values()).count(want[i]) == 1}
    assert {i: got.get(i, i) for i in items} == want and all(got.get(i, i) == i for i in lone)
    assert all(got[i] == 2000 for i in tight) and sum(asked) < 60 * 59 / 2 + 2 * 60 + 1000 + 1


def test_blocks_make_all_pairs_of_different_components(spark):
    rows = [(g, i * 7 + g, i % 3) for g in (1, 2) for i in range(40)] + [(3, 7, 0)]
    got = links.apart_pairs(spark.createDataFrame(rows, "g long, item long, component long"), lambda x, y: F.lit(True), block=6).collect()
    want = {tuple(sorted((i, j))) for g in (1, 2) for (_, i, c), (_, j, d) in itertools.combinations([r for r in rows if r[0] == g], 2) if c != d}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


def near_model(rows, damping=0.5):
    bags = []
    for _, x in rows:
        w = (x or "").lower().split()
        bag = {}
        for j in range(max(1, len(w) - 4) if w else 0):
            bag[tuple(w[j : j + 5])] = bag.get(tuple(w[j : j + 5]), 0) + 1
        bags.append(bag)
    df = {}
    for b in bags:
        for g in b:
            df[g] = df.get(g, 0) + 1
    weigh = [{g: n * (1 + np.log((1 + len(rows)) / (1 + df[g]))) ** damping for g, n in b.items()} for b in bags]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        keys = weigh[a].keys() | weigh[b].keys()
        if keys and sum(min(weigh[a].get(g, 0), weigh[b].get(g, 0)) for g in keys) >= 0.8 * sum(max(weigh[a].get(g, 0), weigh[b].get(g, 0)) for g in keys):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_near_duplicates_are_brute_force(docs):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        if i % 3 or i == 0:
            w = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([3, 30, 80, 200]))]
        else:
            w = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(5000)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs(*rows), chunk_bytes=5_000).collect()}
    assert got == near_model(rows)


def test_near_duplicates_odd_rows(odd):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {(r.doc_id, r.class_id) for r in got}
    assert {(1, 1), (2, 2), (4, 4), (5, 4), (3, 3), (None, None)} <= by
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and 5 not in {r.doc_id for r in kept.collect()}
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, d[0] = d[:], i + 1
        for j, y in enumerate(b):
            d[j + 1] = min(before[j] + (x != y), before[j + 1] + 1, d[j] + 1)
    return d[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        at, kind = rng.randrange(len(s) + 1), rng.randrange(3)
        if kind == 0:
            s.insert(at, rng.choice("abcé"))
        elif s:
            at = min(at, len(s) - 1)
            s[at : at + 1] = [] if kind == 1 else [rng.choice("abcé")]
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    pairs = [(a := "".join(rng.choice("abcé") for _ in range(rng.randrange(15))), edited(rng, a, rng.randrange(5))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.banded_distance(F.col("a"), F.col("b"), edits).alias("d"))
    assert all(min(r.d, edits + 1) == min(distance(r.a, r.b), edits + 1) for r in df.collect())


def test_line_dedup_is_brute_force(docs):
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(30, 70))) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice(["", "dup", edited(rng, rng.choice(pool), rng.randrange(4))]) for _ in range(rng.randrange(6)))) for i in range(50)]
    seen, order = {}, []
    for i, x in rows:
        for k, line in enumerate(x.split("\n")):
            if line.strip():
                seen.setdefault(line, (i, k))
    lines = list(seen)
    root = {a: a for a in lines}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in itertools.combinations([x for x in lines if len(x) >= 40], 2):
        if abs(len(a) - len(b)) <= 2 and find(a) != find(b) and distance(a, b) <= 2:
            root[find(a)] = find(b)
    first = {}
    for a in lines:
        first[find(a)] = min(first.get(find(a), (10**9, 0)), seen[a])
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if not x.strip() or first[find(x)] == (i, k)) for i, t in rows}
    got = line_dedup.dedup_lines(docs(*rows))
    assert {r.doc_id: r.text for r in got.collect()} == want and order == []


def line_model(rows, apart):
    """Of each line, in order: whether it is linked to another text, and the first place of its class."""
    places = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip()]
    texts = {x for _, _, x in places}
    root = {x: x for x in texts}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    linked = set()
    for a, b in itertools.combinations(sorted(texts), 2):
        if apart(a, b):
            linked |= {a, b}
            root[find(a)] = find(b)
    first = {}
    for i, k, x in places:
        first[find(x)] = min(first.get(find(x), (10**9, 0)), (i, k))
    return {x: (x in linked, first[find(x)]) for x in texts}


def test_line_classes_are_brute_force(docs):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdé ") for _ in range(48))
    close = [base[:k] + "X" + base[k + 1 :] for k in range(0, 48, 3)]  # all within two edits of each other
    lengths = [*range(40, 60), 94, 95, 126, 127, 128, 158, 159, 160]
    pool = [*close, *("".join(rng.choice("abcdé ") for _ in range(rng.choice(lengths))) for _ in range(8))]
    rows = [(i, "\n".join(rng.choice(["", "dup", edited(rng, rng.choice(pool), rng.randrange(3))]) for _ in range(5))) for i in range(60)]
    rows += [(60, "\n".join(close)), (61, close[0] + "\n" + close[0]), (62, None)]
    told = line_model(rows, lambda a, b: min(len(a), len(b)) >= 40 and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs(*rows, rows[-2])).collect()}
    assert got[62].class_docs is None and got[62].n_links == 0
    for i, t in rows[:-1]:
        lines = [x for x in t.split("\n") if x.strip()]
        assert got[i].n_links == sum(told[x][0] for x in lines)
        assert list(zip(got[i].class_docs, got[i].class_places)) == [told[x][1] for x in lines]
    assert len({told[x][1] for x in close}) == 1


def test_short_lines_within_one_edit(docs):
    rng = random.Random(11)
    pool = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (14, 15, 16, 17, 23, 24, 30, 38, 39, 40, 41)]
    lines = [x for p in pool for x in (p, p + "X", "X" + p, p[:7] + "Y" + p[8:], p[:5] + p[6:], "XZ" + p)]
    rows = list(enumerate(lines))
    told = line_model(rows, lambda a, b: min(len(a), len(b)) >= 16 and distance(a, b) <= (2 if min(len(a), len(b)) >= 40 else 1))
    got = line_dedup.dedup_lines(docs(*rows), short_chars=16).collect()
    assert {r.doc_id: (bool(r.n_links), (r.class_docs[0], r.class_places[0])) for r in got} == {i: told[x] for i, x in rows}
    few = line_dedup.dedup_lines(docs(*rows), classes=False, short_chars=16).collect()
    assert {r.doc_id: r.text for r in got} == {r.doc_id: r.text for r in few}
    assert [r.text for r in few if r.doc_id == lines.index(pool[8][:7] + "Y" + pool[8][8:])] == [""]


def test_line_dedup_odd_rows(odd):
    got = line_dedup.dedup_lines(odd)
    rows = got.collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(got.columns)
    assert [r.text for r in rows if r.doc_id == 5] == [""] and sorted(r.n_removed for r in rows if r.doc_id == 3) == [0, 0]
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_neighbours_recall_scores_and_ties(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(600, 16)), np.tile(rng.normal(size=16), (60, 1))])
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)] + [(1000, None, "n"), (1001, [0.0] * 16, "z"), (1002, [float("nan")] * 16, "q"), (1003, [1.0, 2.0], "s"), (None, [1.0] * 16, "i")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k=5, block_rows=100).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in range(0, 660, 50):
        s = u @ u[i]
        s[i] = -2
        best = np.lexsort((np.arange(len(s)), -np.round(s, 12)))[:5]
        hits += len({v for v, _ in got[i].values()} & set(best.tolist()))
        assert all(abs(s[v] - y) < 1e-12 for v, y in got[i].values())
    assert hits / (5 * len(got)) >= 0.9 and set(got) == set(range(0, 660, 50))
    assert [got[600][k][0] for k in range(1, 6)] == [601, 602, 603, 604, 605]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    assert ann.nearest(df.where("vec_id < 3"), F.lit(True), k=5).count() == 6


@pytest.mark.parametrize("noise", [0.3, 0.1, 0.02])
def test_neighbours_recall_in_tight_groups(spark, noise):
    rng = np.random.default_rng(17)
    centre = rng.normal(size=64)
    x = np.vstack([centre / np.linalg.norm(centre) + noise * rng.normal(size=(6000, 64)) / 8, rng.normal(size=(6000, 64))])
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = {True: [], False: []}
    for i in range(0, len(x), 50):
        s = u @ u[i]
        s[i] = -2
        hits[i < 6000].append(len(got[i] & set(np.argsort(-s)[:5].tolist())))
    assert all(sum(h) / (5 * len(h)) >= 0.9 for h in hits.values()), {k: sum(h) / (5 * len(h)) for k, h in hits.items()}


def test_neighbours_stay_in_few_cells_where_angles_tell(spark):
    """Groups far apart: what is not of a query's own group is never visited."""
    rng = np.random.default_rng(18)
    x = np.vstack([c + 0.02 * rng.normal(size=(80, 32)) for c in rng.normal(size=(25, 32))])
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0, k=5, first_cells=2, block_rows=64, rerank=10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, len(x), 50):
        s = u @ u[i]
        s[i] = -2
        assert len(got[i] & set(np.argsort(-s)[:5].tolist())) >= 4


def test_toxicity_learns_from_unheld_labels_only(spark, docs):
    rng = random.Random(6)
    text = lambda bad: " ".join([f"wort{rng.randrange(300)}" for _ in range(40)] + ([f"zork{rng.randrange(9)}a", "idiot"] if bad else []))
    rows = [(i, text(i % 6 == 0)) for i in range(900)]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    labels = spark.createDataFrame([(i, int(i % 6 == 0) if i not in held else int(i % 6 != 0)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs(*rows), labels)
    got = {r.doc_id: r for r in toxicity.score(docs(*rows), model).collect()}
    assert {i for i in got if got[i].held_out} == set(held)
    assert all(got[i].predicted == int(i % 6 == 0) and 0 <= got[i].score <= 1 for i in got)
    assert {r.doc_id for r in toxicity.drop_toxic(docs(*rows), model).collect()} == {i for i, _ in rows if i % 6}


def test_label_model_finds_accuracies_and_correlations():
    """Simulated voters: five independent ones, and one that mostly repeats the first."""
    rng = np.random.default_rng(4)
    n, p = 60_000, 0.2
    y = rng.random(n) < p
    toxic, clean = [0.8, 0.6, 0.7, 0.5, 0.4], [0.05, 0.02, 0.1, 0.03, 0.01]
    v = np.stack([np.where(y, rng.random(n) < t, rng.random(n) < c) for t, c in zip(toxic, clean)], 1)
    v = np.hstack([v, np.where(rng.random(n) < 0.9, v[:, 0], ~v[:, 0])[:, None], np.ones((n, 1), bool)]).astype(float)
    model = toxicity.label_model(v.T @ v, n, [], 6, p)
    assert np.abs(model.fires_toxic[1:5] - toxic[1:]).max() < 0.06 and np.abs(model.fires_clean[1:5] - clean[1:]).max() < 0.03
    others = model.correlations.copy()
    others[[0, 5], [5, 0]] = 0
    assert model.correlations[0, 5] > 0.25 and np.abs(others).max() < 0.2 and model.share[0] < 0.8 < model.share[2]
    assert ((toxicity.posterior(model, v[:, :-1]) > 0.5) == y).mean() > 0.94


def test_toxicity_by_density(spark, docs):
    """What marks toxic texts is how often a word family occurs that clean texts have too."""
    rng = random.Random(7)
    fill = lambda k: ["".join(rng.choice("aeioulmn") for _ in range(4)) for _ in range(k)]
    text = lambda bad: " ".join(rng.sample(w := [*fill(200), *(f + rng.choice("abcd") for f in ("quarz", "blint", "drosk", "vemph") for _ in range(rng.randrange(5, 9) if bad else rng.randrange(2)))], len(w)))
    rows = [(i, text(i % 5 == 0)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity.score(docs(*rows), toxicity.fit(docs(*rows), labels)).where("held_out").collect()
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in got]) > 0.97


def test_toxicity_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(odd, none)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(r.predicted == 0 for r in got)
    assert toxicity.drop_toxic(odd, model).count() == odd.count()
    assert toxicity.score(odd.limit(0), toxicity.fit(odd.limit(0), none)).count() == 0

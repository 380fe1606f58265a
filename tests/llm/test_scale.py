"""Hot ids, equal rows, and texts with tens of thousands of matches or lines."""

import hashlib
import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import line_dedup, near_dedup, packing, pii, substring_dedup, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_equal_pieces_are_spread_over_groups(spark, docs):
    rows = docs(*[(None, "")] * 3_000, *[(i, f"text {i}") for i in range(3_000)]).repartition(6)
    packed = packing.pack_documents(rows, public_tokenizers.path("byte_bpe_50k.json"), capacity=64, group_pieces=600)
    of_group = [r["count"] for r in packed.groupBy(F.shiftright("sequence_id", 32)).count().collect()]
    assert len(of_group) == 11 and max(of_group) < 750 and sum(of_group) == 6_000


def test_rows_of_one_id_are_spread_over_chunks(docs):
    """Windows of rows that share an id are compared by their starts, in whatever chunks they are."""
    rng = random.Random(3)
    some = [" ".join(f"w{rng.randrange(40)}" for _ in range(30)) for _ in range(5)]
    rows = [(rng.choice([7, 7, None, i]), " ".join(rng.choice(some).split()[rng.randrange(9) :] + [f"x{rng.randrange(99)}"] * rng.randrange(3) + rng.choice(some).split())) for i in range(150)]
    window, seen = 8, {}
    key = lambda i: (i is not None, i or 0)
    for i, text in rows:
        w = text.split()
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            seen[k] = min(seen.get(k, (key(i), p)), (key(i), p))
    want = []
    for i, text in rows:
        w, gone = text.split(), set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] < (key(i), p):
                gone |= set(range(p, p + window))
        want.append((str(i), " ".join(x for n, x in enumerate(w) if n not in gone)))
    got = substring_dedup.dedup_substrings(docs(*rows), window, 2, chunk_bytes=1_000).collect()
    assert sorted((str(r.doc_id), r.kept) for r in got) == sorted(want)


def test_equal_ids_are_in_one_order_over_several_files(spark, docs, tmp_path):
    rows = docs(*[(5, f"text {i}") for i in range(400)], *[(5, None)] * 3, (4, "before"), (6, "after")).repartition(4)
    path, words = str(tmp_path / "files"), public_tokenizers.path("word_bpe_49k.json")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_token_files(rows, path, words, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stored = token_files.read_token_files(spark, path).orderBy("part", "place").collect()
    assert len({r.part for r in stored if r.doc_id == 5}) > 1 and [r.doc_id for r in stored] == [4] + [5] * 403 + [6]
    from docloom.llm.tokens import encoder

    enc = encoder(words)
    hashed = rows.where("doc_id = 5").select("text", F.xxhash64("text").alias("h")).orderBy("h").collect()
    import numpy as np

    assert [list(r.ids) for r in stored[1:-1]] == [np.frombuffer(enc.encode(r.text), np.uint32).tolist() + [2] for r in hashed]


def test_texts_of_many_matches(docs):
    text = "".join(f"call +49 170 {1_000_000 + i} or a{i}@b.de\n" for i in range(25_000))
    began = time.time()
    r = pii.find_pii(docs((1, text), (2, "x"))).where("doc_id = 1").first()
    assert time.time() - began < 60
    spans = [(s.kind, text[s.start : s.end]) for s in r.spans if s.kind != "card"]  # some of the numbers pass for cards
    assert spans == [x for i in range(25_000) for x in (("phone", f"+49 170 {1_000_000 + i}"), ("email", f"a{i}@b.de"))]
    assert {round(s.score, 2) for s in r.spans if s.kind == "phone"} == {0.85}


def test_context_reaches_over_matches_and_blocks(docs):
    text = "tax " + "123-45-6789 " * 200 + "no word here, at all, and no other for forty characters 123-45-6789"
    got = pii.find_pii(docs((1, text))).first().spans
    places = [i for i in range(len(text)) if text.startswith("123-45-6789", i)]
    near = lambda i: any(w in text[max(i - 40, 0) : i].lower() for w in ("ssn", "social", "security", "tax"))
    assert [s.start for s in got if s.kind == "ssn"] == [i for i in places if near(i)] and 3 <= sum(map(near, places)) <= 4


def test_texts_of_many_lines(docs):
    lines = [f"line {i} {hashlib.md5(str(i).encode()).hexdigest() * 2}" if i % 5 else "" for i in range(50_000)]
    text, other = "\n".join(lines), "\n".join(lines[::2] + ["new line of this text alone, which is long enough to be compared"])
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs((1, text), (2, other)), short_chars=16).select("doc_id", "text", "n_lines", "n_removed", F.size("class_docs").alias("n"), F.expr("forall(class_docs, d -> d = 1)").alias("first")).collect()}
    assert time.time() - began < 100
    assert got[1].text == text and (got[1].n_lines, got[1].n_removed, got[1].n) == (40_000, 0, 40_000) and got[1].first
    assert got[2].text == "\n".join([x for x in lines[::2] if not x] + ["new line of this text alone, which is long enough to be compared"]) and (got[2].n_removed, got[2].n) == (20_000, 20_001)


def test_classifier_is_fitted_in_parts():
    import tracemalloc

    import numpy as np

    from docloom.llm import toxicity

    rng, width = np.random.default_rng(3), 16
    parts = [((rng.random((256, width)) < 0.2) * 1.0, rng.random((256, toxicity.BUCKETS)).astype(np.float32)) for _ in range(24)]
    v = np.vstack([toxicity.votes(f) for f, _ in parts])
    v = np.hstack([v, np.ones((len(v), 1))])
    fitted = lambda parts: toxicity.train(toxicity.label_model(v.T @ v, len(v), [], 12, 0.2), parts)
    tracemalloc.start()
    model = fitted(parts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16e6  # the matrix of all rows alone has 26 MB
    whole = fitted([tuple(np.vstack(x) for x in zip(*parts))])
    assert np.allclose(model.weights, whole.weights, atol=1e-9) and np.allclose(model.scales, whole.scales)


def test_words_of_a_chunk_are_not_held_as_objects():
    """Shingling a chunk takes memory after its words' hashes, not after its words."""
    text = [" ".join(f"w{(i * 7 + k) % 4099}" for k in range(400)) for i in range(1000)]
    table = pa.table({"node": [str(i) for i in range(1000)], "text": text})
    near_dedup.Shingles(table.slice(0, 2), 5)
    tracemalloc.start()
    got = near_dedup.Shingles(table, 5)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(got.keys) == 396_000 and most < 20 * sum(map(len, text))

"""Operators on texts against plain Python, and on odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import chat_format, decontaminate, packing, pii, substring_dedup, token_files
from docloom.llm.tokens import encoder

public_tokenizers = pytest.importorskip("public_tokenizers")


def words(rng, n, vocabulary=30):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def substring_model(rows, window):
    seen, out = {}, {}
    for i, x in sorted(rows):
        for p in range(len(w := x.split()) - window + 1):
            seen.setdefault(tuple(w[p : p + window]), (i, p))
    for i, x in rows:
        w = x.split()
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] < (i, p):
                gone[p : p + window] = [True] * window
        out[i] = " ".join(a for a, g in zip(w, gone) if not g)
    return out


@pytest.mark.parametrize("window,base", [(20, 5), (8, 2), (6, 2), (7, 2)])
def test_substring_dedup_is_brute_force(docs, window, base):
    rng = random.Random(window)
    shared = [words(rng, 50) for _ in range(4)]
    rows = [(i, " ".join(rng.choice([words(rng, rng.randrange(30)), rng.choice(shared), "a " * 25]) for _ in range(rng.randrange(6)))) for i in range(60)]
    got = {r.doc_id: r.kept for r in substring_dedup.dedup_substrings(docs(*rows), window, base, chunk_bytes=2_000).collect()}
    assert got == substring_model(rows, window)


def test_substring_dedup_odd_rows(odd):
    rows = substring_dedup.dedup_substrings(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.n_removed == 0 for r in rows)  # the two rows of id 3 do not outrank each other
    assert substring_dedup.dedup_substrings(odd.limit(0)).count() == 0


def test_decontamination_spans_and_blocks(spark, docs):
    item = " ".join(f"Q{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item), (2, "short one"), (2, "short one"), (None, "x"), (4, None), (5, "!!")], "item_id long, text string")
    d = docs((1, f"É -- {item.upper()}! tail"), (2, "a SHORT, one b"), (3, None), (4, "q1 q2 q3"), (5, "x"))
    for sizes in ({}, {"block_bytes": 5}, {"block_bytes": 30, "pass_bytes": 5}):
        got = {r.doc_id: r for r in decontaminate.find_benchmark(d, bench, **sizes).collect()}
        assert [(got[i].n_words, got[i].n_hit, got[i]["items"]) for i in (1, 2, 3, 4, 5)] == [(14, 12, [1]), (4, 2, [2]), (0, 0, []), (3, 0, []), (1, 0, [])]
        assert [(s.start, s.end) for s in got[1].spans] == [(5, 5 + len(item))]
        assert sorted(r.doc_id for r in decontaminate.drop_contaminated(d, bench, **sizes).collect()) == [3, 4, 5]
    assert decontaminate.find_benchmark(d.limit(0), bench.limit(0)).count() == 0


def decontamination_model(rows, bench, n=10):
    normal = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    owners = {}
    for item, text in bench:
        w = normal(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            owners.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = {}
    for i, text in rows:
        w, hit, items = normal(text), set(), set()
        for k in range(1, n + 1):
            for p in range(len(w) - k + 1):
                found = owners.get(tuple(w[p : p + k]), ())
                if found:
                    hit |= set(range(p, p + k))
                    items |= found
        out[i] = (len(w), len(hit), sorted(items))
    return out


def test_decontamination_by_blocks_is_brute_force(spark, docs):
    rng = random.Random(8)
    bench = [(i, words(rng, rng.choice([1, 2, 5, 9, 10, 11, 40]), 60)) for i in range(40)] + [(99, words(rng, 300, 60))]
    cut = lambda t: (lambda w, a: " ".join(w[a : a + rng.randrange(5, 30)]))(t.split(), rng.randrange(5))
    rows = [(i, f"{words(rng, 20)} {cut(rng.choice(bench)[1]).upper()}, {words(rng, 9)} {cut(rng.choice(bench)[1])}") for i in range(60)]
    want = decontamination_model(rows, bench)
    items = spark.createDataFrame(bench, "item_id long, text string")
    for sizes in ({}, {"block_bytes": 40}, {"block_bytes": 40, "pass_bytes": 700}):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_benchmark(docs(*rows), items, **sizes).collect()}
        assert got == want
        clean = sorted(i for i, (_, hit, _) in want.items() if not hit)
        assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs(*rows), items, **sizes).collect()) == clean


def test_decontamination_with_megabytes_of_items(spark, docs):
    rng = random.Random(9)
    bench = [(i, words(rng, 2_000, 5_000)) for i in range(450)]
    assert sum(len(t) for _, t in bench) > 5_000_000 > 4 * decontaminate.BLOCK_BYTES
    rows = [(i, " ".join([words(rng, 30, 5_000), *bench[i][1].split()[7 * i : 7 * i + 9 + i % 3]])) for i in range(200)]
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.find_benchmark(docs(*rows), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {i: (9 + i % 3, [i]) if i % 3 else (0, []) for i in range(200)}


def test_decontamination_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    rows = decontaminate.find_benchmark(odd, bench).collect()
    assert sum(r.n_hit for r in rows) == 3 and len(rows) == odd.count()


def test_chat_round_trip_of_any_text(spark):
    rng = random.Random(5)
    bits = ["### ", "User: ", "### Assistant: ", "</turn>", " </turn>\n", "\\", "\n", "é", "): ", "### Other(", "x", " "]
    some = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(7)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", some()]), some()) for c in range(80) for t in range(rng.randrange(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat_format.format_conversations(df)
    back = sorted((r.conv_id, r.turn, r.role, r.text) for r in chat_format.read_back(segments).collect())
    assert back == sorted(rows)
    loss = {}
    for r in sorted(chat_format.read_back(segments).collect(), key=lambda r: (r.conv_id, r.turn)):
        assert r.loss == (r.role == "assistant")
        loss[r.conv_id] = loss.get(r.conv_id, "") + (r.text if r.loss else "")
    for r in chat_format.digests(segments).collect():
        assert (r.loss_chars, r.loss_sha256) == (len(loss[r.conv_id]), hashlib.sha256(loss[r.conv_id].encode()).hexdigest())


def test_chat_order_and_nulls(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", "u"), (None, None, None, None), (None, 1, "user", "x"), (None, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.format_conversations(df).groupBy("conv_id").agg(F.min("valid").alias("valid"), F.max("problem").alias("problem")).collect()
    assert {r.conv_id: (r.valid, r.problem) for r in got} == {1: (True, None), 2: (False, "assistant after start"), 3: (False, "ends after user"), None: (False, "user after user")}
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0


def pii_model(text):
    def luhn(s):
        d = [int(c) for c in re.sub("[^0-9]", "", s)][::-1]
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0

    base = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))), ("card", r"[0-9]([\x20-]?[0-9])+", luhn), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15)]
    return sorted((m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(base) for m in re.finditer(p, text) if ok(m[0]))


def test_pii_base_spans_are_brute_force(docs):
    rng = random.Random(9)
    bits = ["a@b.cd", "@", ".", "x_", "é", " ", "-", "+4", "12", "4111111111111111", "4111 1111 1111 1111", "300.1.2.3", "10.0.0.001", "(30)", "  ", "5", "\n", "a.b-c@d-e.f.g"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(400)]
    for r in pii.find_pii(docs(*enumerate(texts))).collect():
        assert [(s.start, s.kind_no, s.kind, s.end) for s in r.spans if s.kind in ("email", "ip", "card", "phone")] == pii_model(r.text)


def test_pii_checksums_context_and_masks(docs):
    d = docs((1, "pay to IBAN GB82 WEST 1234 5698 7654 32 now"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "ssn 123-45-6789"), (4, "123-45-6789"), (5, "mail a@b.cd"))
    got = {r.doc_id: [(s.kind, s.score) for s in r.spans] for r in pii.find_pii(d).collect()}
    assert got[1] == [("iban", 1.0)] and got[2] == [] and got[3][0][0] == "ssn" and got[4] == []
    assert {r.doc_id: r.text for r in pii.masked(pii.find_pii(d)).collect()}[5] == "mail [EMAIL]"


def test_pii_odd_rows(odd):
    assert pii.find_pii(odd).count() == odd.count()
    assert pii.find_pii(odd.limit(0)).count() == 0


def test_best_fit_takes_the_tightest():
    number, offset = packing.best_fit_decreasing([7, 6, 3, 3, 2, 1, 1], 10)
    assert (number, offset) == ([0, 1, 0, 1, 2, 1, 2], [0, 0, 7, 6, 0, 9, 2])
    rng = random.Random(1)
    lengths = sorted((rng.randint(1, 64) for _ in range(500)), reverse=True)
    room, want = [], []
    for x in lengths:
        fits = [r for r in room if r >= x]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else 64) - x)
    number, offset = packing.best_fit_decreasing(lengths, 64)
    used = np.bincount(number, lengths)
    assert sorted(64 - used) == sorted(room) and want == []


@pytest.fixture(scope="module")
def plain_ids():
    from tokenizers import Tokenizer

    def ids(name, text):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        return t.encode(text or "", add_special_tokens=False).ids

    return ids


ODD_TEXTS = ["", "  \n\n\n x\ty  ", "İstanbul ΣΑΣ. ét́, don't I'll it's.", "a\xa0\xa0 \nfoo 12,345.67 ... $%&", "naïve 　 wörd, <|endoftext|> <|startoftext|> ok", "\n\n\nfoo.\n\nbar \r\nbaz", "ﬁn ǅ ª º ² ½ 中文字。", "😀👍🏽 x,y.z. .,., '", "foo\x1cbar\x1f baz\x00", "tail \n", None]


def test_packing_places_each_id_once(docs, plain_ids):
    rows = list(enumerate([*ODD_TEXTS, "word " * 3_000]))
    packed = packing.pack_documents(docs(*rows), public_tokenizers.path("byte_bpe_50k.json"), capacity=64, keep_ids=True)
    pieces = packed.collect()
    for i, text in rows:
        want = [*plain_ids("byte_bpe_50k.json", text), 0]
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        got = [x for p in mine for x in np.frombuffer(p["ids"], "<u4").tolist()]
        assert got == want and all(p.doc_tokens == len(want) and p.ids_crc32 == zlib.crc32(bytes(p["ids"])) for p in mine)
    by = {}
    for p in sorted(pieces, key=lambda p: p.offset):
        assert p.offset == by.get(p.sequence_id, 0)
        by[p.sequence_id] = p.offset + p.length
    assert max(by.values()) <= 64
    for s in packing.sequences(packed, capacity=64).collect():
        assert len(s["ids"]) // 4 == (s.n_tokens if s.n_tokens & (s.n_tokens - 1) == 0 else 64)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_tokenizers(name):
    """Against the tokenizer as it comes: added tokens, marks, case, combining characters and white space."""
    from tokenizers import Tokenizer

    rng = random.Random(5)
    bits = ["foo", "Bar", "İ", "İ.", "İ,", "Σ", "é", "e\u0301", "\u0327", "ß", "123", "4,5", " ", "  ", "\n", "\t", "\x1c", "\xa0", ".", ",", ";)", "'s", "don't", "<|endoftext|>", "<|startoftext|>", "日本", "🙂", "_", "ǅ", "ﬁ", "²", "a.", "A,B.", "\x00", "\u0307", "\u212a"]
    plain, mine = Tokenizer.from_file(public_tokenizers.path(name)), encoder(public_tokenizers.path(name))
    for _ in range(5_000):
        x = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 9)))
        assert np.frombuffer(mine.encode(x), "<u4").tolist() == plain.encode(x, add_special_tokens=False).ids, x


def test_packing_leaves_little_padding(docs):
    rng = random.Random(3)
    rows = [(i, "word " * rng.randrange(1, 120)) for i in range(400)]
    pieces = packing.pack_documents(docs(*rows), public_tokenizers.path("byte_bpe_50k.json"), capacity=64).collect()
    assert sum(p.length for p in pieces) >= 0.97 * 64 * len({p.sequence_id for p in pieces})


def test_packing_odd_rows(odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.pack_documents(odd, path).where("start = 0").count() == odd.count()
    assert packing.pack_documents(odd.limit(0), path).count() == 0


def test_token_files_read_back(spark, docs, plain_ids, tmp_path):
    rows = [(i * 7 % 11, t) for i, t in enumerate(ODD_TEXTS)]
    token_files.write_token_files(docs(*rows), f"{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json"), 2)
    at = 0
    for r, (i, text) in zip(sorted(token_files.token_index(spark, f"{tmp_path}/t").collect(), key=lambda r: r.doc_id), sorted(rows)):
        want = [*plain_ids("word_bpe_49k.json", text), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    assert token_files.read_token_files(spark, f"{tmp_path}/t", [3]).count() == 1


def test_token_files_odd_rows(spark, odd, tmp_path):
    for name, d in (("a", odd), ("b", odd.limit(0))):
        token_files.write_token_files(d, f"{tmp_path}/{name}", public_tokenizers.path("word_bpe_49k.json"), 2)
        rows = token_files.token_index(spark, f"{tmp_path}/{name}").collect()
        assert len(rows) == d.count()
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at
            at += r.n_tokens

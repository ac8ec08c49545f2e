"""Hard negatives, the prefix trie and personal data against plain versions."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vacantia.llm import hard_negatives, personal_data, prefix_trie, queries

VECTORS = "id bigint, label int, vector array<double>, anchor string, place string"


def plain_mining(rows, every=100, positives=5, negatives=10):
    sound = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = (label, [math.floor(256 * x) for x in v])
        sound[i] = min(sound.get(i, one), one)
    score = lambda a, b: sum(x * y for x, y in zip(sound[a][1], sound[b][1], strict=False))
    out = set()
    for a in sound:
        if a % every:
            continue
        ranked = sorted((-score(a, b), b) for b in sound if b != a)
        for s, p in [(s, b) for s, b in ranked if sound[b][0] == sound[a][0]][:positives]:
            hard = [(t, n) for t, n in ranked if sound[n][0] != sound[a][0] and -30 * s <= -100 * t <= -90 * s]
            out |= {(a, p, k + 1, n, -s, -t) for k, (t, n) in enumerate(hard[:negatives])}
    return out


@pytest.mark.parametrize("block,anchors,dims", [(2048, 32, 32), (7, 2, 3), (1, 1, 1)])
def test_hard_negatives(spark, block, anchors, dims):
    r = random.Random(3)
    rows = [(i, i % 3 if i % 2 else 0, [r.uniform(-1, 1) + (i % 3) * 0.2 for _ in range(8)]) for i in range(60 if block > 1 else 24)]
    rows += [(200, 1, rows[3][2]), (201, 1, rows[3][2]), (202, 2, rows[4][2])]  # ties
    rows += [(300, None, [1.0] * 8), (400, 1, None), (500, 1, [1.0, None]), (600, 1, [float("nan")] * 8), (None, 1, [1.0] * 8), (7, None, [float("inf")])]
    rows += [(700, 9, [0.5] * 8), (800, 2, [0.4] * 3), (801, 1, []), (802, 0, [0.9] * 11), rows[5], rows[5]]  # alone in its label, short, empty, long, repeated
    df = spark.createDataFrame([(i, x, v, "a", "b") for i, x, v in rows], VECTORS).repartition(5)
    out = hard_negatives.mine(df, F.col("id") % 10 == 0, block=block, anchors_block=anchors, dims=dims)
    assert {tuple(x) for x in out.collect()} == plain_mining(rows, 10) and out.count() == out.distinct().count()


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(df, F.col("id") % 10 == 0).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0], "", "")], VECTORS)
    assert hard_negatives.mine(one, F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.mine(one, F.col("id") < 0).count() == 0


def test_large_components_do_not_lose_precision(spark):
    rows = [(0, 1, [2.0**20 + 1 / 256, 1.0]), (1, 1, [2.0**20 + 2 / 256, 1.0]), (2, 2, [2.0**19, 3.0]), (3, 2, [2.0**19 + 1 / 256, 3.0])]
    df = spark.createDataFrame([(*x, "", "") for x in rows], VECTORS)
    assert {tuple(x) for x in hard_negatives.mine(df, F.col("id") == 0).collect()} == plain_mining(rows)


def plain_trie(rows, group=5, heads=9):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            turns.setdefault(c, []).append((t is not None, t or 0, digest, (role, text)))
    said = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = tuple(said.get(c - int(math.fmod(c, group)), [])[:h] + said[c][h:])
    nodes = {s[:d] for s in built.values() for d in range(len(s) + 1)}
    members = {n: [c for c, s in built.items() if s[: len(n)] == n] for n in nodes}
    out = set()
    for n in nodes:
        below = [m for m in nodes if m[: len(n)] == n]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[:-1] == m for x in nodes)]
        ends = ",".join(str(c) for c in sorted(c for c in members[n] if built[c] == n))
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        out.add((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), sum(len(m) == len(n) + 1 for m in below), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


TURNS = "conv_id bigint, turn bigint, role string, text string, key string, r string"


def test_prefix_trie(spark):
    r = random.Random(8)
    say = lambda: r.choice(["hi", "yes", "no", "Ünïcode", "", None])
    rows = [(c, t, r.choice(["user", "assistant", None]) if t else "user", say() if t % 3 else "hello") for c in range(-12, 60) for t in range(r.randint(1, 6))]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(12)]  # copies, longer than any head
    rows += [(200, None, "user", "first"), (200, 1, "b", "tie"), (200, 1, "a", "tie"), (200, 1, "a", "tie"), (None, 1, "user", "lost"), (201, 5, None, None)]
    rows += [(203, t, "user", f"long {t % 7}") for t in range(400)] + [(204, 0, "user", "x" * 200_000)]
    df = spark.createDataFrame([(*x, "k", "r") for x in rows], TURNS).repartition(6)
    out = prefix_trie.trie(prefix_trie.with_heads(prefix_trie.turns_of(df)))
    got = out.collect()
    assert {tuple(x)[:8] for x in got} == plain_trie(rows) and len(got) == len({tuple(x)[:8] for x in got})
    # places are a preorder walk: from 0 without gaps, and each subtree's interval holds that of its children
    assert sorted(x.place for x in got) == list(range(len(got))) and max(x.subtree_end for x in got) == len(got)
    by_place = sorted(got, key=lambda x: x.place)
    for x in by_place:
        inside = by_place[x.place + 1 : x.subtree_end]
        assert all(y.depth > x.depth and y.subtree_end <= x.subtree_end for y in inside)


def test_prefix_trie_pieces_and_nothing(spark, monkeypatch):
    rows = [(c, 0, "user", "hi") for c in range(90, 200)]
    df = spark.createDataFrame([(*x, "", "") for x in rows], TURNS)
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    assert {tuple(x)[:8] for x in prefix_trie.trie(prefix_trie.with_heads(prefix_trie.turns_of(df))).collect()} == plain_trie(rows)
    assert prefix_trie.trie(prefix_trie.with_heads(prefix_trie.turns_of(df.limit(0)))).count() == 0


def plain_base(text):
    """The contract's patterns as they stand."""
    import re

    patterns = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for kind, p in patterns:
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(d) <= 19 and personal_data.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_rules_are_the_patterns():
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice(["1", "25", "300", ".", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "é", "4111 1111 1111 1111", "x@y.de", "10.0.0.1"]) for _ in range(r.randint(0, 25)))
        assert personal_data.base_spans(text) == plain_base(text), text
    assert personal_data.base_spans("١٢ a@b.c") == [("email", 3, 8)]


@pytest.fixture(scope="module")
def weights():
    return personal_data.fitted()


def test_viterbi_is_the_best_of_all_segmentations(weights):
    r, compared = random.Random(12), 0
    for _ in range(120):
        text, _ = personal_data.example(r)
        base = personal_data.base_spans(text)
        for region in personal_data.regions(text):
            taken = [x for x in base if x[1] < region[1] and x[2] > region[0]]
            edges, options = personal_data.candidates(text, region, taken)
            if not 0 < len(options) <= 11:
                continue
            held = personal_data._held(edges, taken)

            def value(chosen, edges=edges, held=held):
                last, total, at = "", 0.0, {c[1]: c for c in chosen}
                for j in range(1, len(edges)):
                    c = at.get(j)
                    if c:
                        total += sum(weights.get(k, 0.0) for k in personal_data._keys(c[2], c[3])) + weights.get(f"{last_at(c[0], chosen, held)}>{c[2]}", 0.0)
                return total

            def last_at(b, chosen, held):
                ends = [(c[1], c[2]) for c in chosen if c[1] <= b] + [(j, y) for j, y in held.items() if j <= b]
                return max(ends)[1] if ends else ""

            best = 0.0
            for mask in range(1 << len(options)):
                chosen = sorted((c for k, c in enumerate(options) if mask >> k & 1), key=lambda c: c[0])
                if all(a[1] <= b[0] for a, b in zip(chosen, chosen[1:], strict=False)):
                    best = max(best, value(chosen))
            place = {x: k for k, x in enumerate(edges)}
            found = {(place[s], place[e], y) for y, s, e in personal_data.best_spans(edges, options, weights, held)}
            assert math.isclose(value([c for c in options if c[:3] in found]), best, abs_tol=1e-6)
            compared += 1
    assert compared > 60


def test_model_on_sentences_it_has_not_seen(weights):
    r, hit, extra, missed, by_rules = random.Random(77), 0, 0, 0, 0
    for _ in range(800):
        text, gold = personal_data.example(r)
        base, every = personal_data.all_spans(text, weights)
        hit, extra, missed, by_rules = hit + len({*gold} & {*every}), extra + len({*every} - {*gold} - {*base}), missed + len({*gold} - {*every}), by_rules + len({*gold} & {*base})
        assert {*base} <= {*every}
    assert hit / (hit + missed) > 0.97 and hit / (hit + extra) > 0.97 and by_rules / (hit + missed) < 0.5


def test_what_the_rules_lose(weights):
    found = lambda t: [(k, t[s:e]) for k, s, e in personal_data.all_spans(t, weights)[1]]
    assert found("+1 (487) 555-7209 4736962573099581 end") == [("card", "4736962573099581"), ("phone", "+1 (487) 555-7209")]
    assert found("4111 1111 1111 1111 4012888888881881") == [("card", "4111 1111 1111 1111"), ("card", "4012888888881881")]
    assert found("call (017) 555-7713 now") == [("phone", "(017) 555-7713")] and found("write john dot smith at example dot com please") == [("email", "john dot smith at example dot com")]
    assert found("97.51.17.173 4929348385146306") == [("ip", "97.51.17.173"), ("card", "4929348385146306")]
    for clean in ("look at example.com", "meet at 10.30 today", "born 1999-12-31 2000-01-01", "1 2 3 4 5 6 7 8 9 10", "number 2669109448945251 on", 'token = "cf1d64a9a4cd9723e1f4eafc27395915e6868ffa"'):
        assert found(clean) == [], clean


@pytest.mark.parametrize("unit", ["1", "1 ", "1.", "1-", "a", "@ ", "a@", "at ", "+", "(", "a.b at c.d "])
def test_long_texts_take_linear_time(weights, unit):
    import time

    began = time.process_time()
    personal_data.all_spans(unit * 30_000 + "@", weights)
    assert time.process_time() - began < 15


def test_personal_data_of_a_table(spark, weights):
    texts = [None, "", "mail a@b.de", "mail a@b.de", "+1 (487) 555-7209 4736962573099581", "1." * 30_000, "1 " * 30_000, "x" * 15_000 + "@", "é 10.0.0.256 10.0.0.1"]
    df = spark.createDataFrame([(k if k != 3 else None, t, "s") for k, t in enumerate(texts)], "doc_id bigint, text string, spans string")
    got = sorted(personal_data.find_personal_data(df, weights).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    want = []
    for k, t in enumerate(texts):
        base, every = plain_base(t), personal_data.all_spans(t, weights)[1]
        want.append((k if k != 3 else None, *[sum(x[0] == y for x in base) for y in personal_data.KINDS], hashlib.sha256(personal_data.joined(base).encode()).hexdigest(), personal_data.joined(every)))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (r[0] is None, r[0]))
    assert personal_data.find_personal_data(df.limit(0), weights).count() == 0


def test_queries_over_tables(spark, tmp_path):
    r = random.Random(2)
    vectors = [(i, i % 10, [r.gauss(0.1 * (i % 10), 0.3) for _ in range(16)]) for i in range(240)]
    spark.createDataFrame(vectors, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    stored = [tuple(x) for x in spark.read.parquet(f"{tmp_path}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    moved = [(i, (x + 1) % 10 if i % 7 == 0 else x, v) for i, x, v in stored]
    assert {tuple(x) for x in queries.QUERIES["op11_hard_negatives"](spark, str(tmp_path)).collect()} == plain_mining(moved)
    chats = [(c, t, "user" if t % 2 == 0 else "assistant", f"{t} {c % 4 if t > 3 else ''}") for c in range(30) for t in range(r.randint(1, 9))]
    spark.createDataFrame(chats, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {tuple(x) for x in queries.QUERIES["op12_prefix_trie"](spark, str(tmp_path)).collect()} == plain_trie(chats)

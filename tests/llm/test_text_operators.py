"""Operators on documents against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from vacantia.llm import decontaminate, license_scan, line_dedup, quality_rules, sentencepiece_viterbi, simhash, substring_dedup

LINE = "A line that Many documents share, at least forty characters."


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéxyz") for _ in range(r.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, base = say(60), say(120)
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one two"), (4, base), (5, base), (6, base.replace(" ", "  ", 3)), (7, base.upper())]
    rows += [(10 + k, "\n".join([say(20), LINE if k % 2 else f"  {LINE.upper()}\t", say(5)])) for k in range(8)]
    rows += [(20 + k, f"{say(k * 3)} {passage[: 200 + 10 * k]} {say(11)}\n{say(7)}\n{say(7)}") for k in range(10)]
    words = base.split()
    for k in range(12):  # near copies
        w = list(words)
        w[r.randrange(len(w))] = "other"
        rows.append((40 + k, " ".join(w)))
    rows += [(60, "x " * 30), (61, "Café\x1fdé\xa0jà vu\x85 " * 9), (62, " ".join(say(15) for _ in range(3000))), (63, "###\n" + say(30)), (64, "a\nb\n\na\n")]
    rows += [(4, base), (13, rows[11][1]), (None, base), (None, LINE), (None, None)]  # repeated rows and null ids
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for c in ("h", "pos", "n_words", "items", "blk", "fp", "r", "kept_text", "__rank", "row", "id", "t", "k"):  # names that the operators use
        df = df.withColumn(c, F.lit("mine"))
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


def same(df, want):
    assert Counter(map(tuple, df.collect())) == Counter(want)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup(docs, rows, batches, fanout):
    out = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout)
    assert {"h", "pos"} < set(out.columns)
    same(out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)), brute.line_dedup(rows))


def test_line_runs_are_levelled(spark):
    store = line_dedup.LineRuns(spark, fanout=2)
    batch = lambda a, b, k: spark.range(a, b).select(F.col("id").cast("string").cast("binary").alias("h"), F.lit(k).cast("bigint").alias("keeper"), F.lit(2).cast("bigint").alias("n"))
    assert store.add(batch(0, 10, 3)).count() == 10
    assert store.add(batch(5, 15, 2)).count() == 5  # the first batch has the others
    assert [len(x) for x in store.levels] == [0, 1]
    assert store.add(batch(0, 16, 1)).count() == 1
    assert sorted((r.keeper, r.n) for r in store.all().collect()) == [(1, 2)] + [(2, 4)] * 5 + [(3, 4)] * 5 + [(3, 6)] * 5
    store.drop()
    assert not [t for t in spark.catalog.listTables() if t.name in store.names]


def test_runs_are_joined_where_they_lie(spark):
    """A batch meets the stored runs without an exchange on the runs' side."""
    store = line_dedup.LineRuns(spark, fanout=9)
    keys = spark.range(1000).select(F.col("id").cast("string").cast("binary").alias("h"), F.col("id").alias("keeper"), F.lit(1).cast("bigint").alias("n"))
    for k in range(2):
        store.add(keys.filter(F.col("keeper") % 3 == k))
    batch = keys.groupBy("h").agg(F.max("keeper").alias("keeper"), F.sum("n").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    for run in store.runs():
        batch = batch.join(run.table.filter("not known").select("h"), "h", "left_anti")
    plan = batch._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") >= 2 and plan.count("Exchange") == 1 and batch.count() == 333
    store.drop()


def test_quality(docs, rows):
    out = quality_rules.quality(docs)
    same(out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), [(i, *brute.quality_base(t)) for i, t in rows])
    assert all(not r.kept for r in out.filter("base_failed").collect())
    same(out.select("doc_id", "kept"), [(i, brute.quality_kept(t)) for i, t in rows])
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert kept[20] and kept[63] and not kept[60] and not kept[0]


def test_quality_lines():
    fails = quality_rules.line_fails
    assert fails(b"Home | About | News | Contact us") == "navigation"
    assert fails(b"w%%% x*** y$$$ z###") == "punctuation"
    assert fails(b"BUY!! NOW!! CHEAP!!") == "punctuation"
    assert fails("© 2020 All rights reserved".encode()) == "boilerplate"
    assert fails(b"no no no no no yes yes yes yes yes or or or") == "boilerplate"
    assert fails(b"A plain sentence, which ends well.") is None
    assert fails("Prix : 5 % de remise, c’est tout.".encode()) is None
    prose = "A plain sentence that has some twelve words in it, as many do."
    assert quality_rules.judge(f"{prose}\nHome | News | About | Us\nOther words follow here.")[6:] == (True, f"{prose}\nOther words follow here.", 1)
    assert quality_rules.judge("Home | News | About | Us | More | Login | Top | End | A | B\nshort line")[6] is False


def test_quality_rules_read_whole_characters():
    """Bytes of separators inside other characters are none."""
    for line in ("Он сказал — «да», и ушёл; всё это было давно, и никто уже не помнит, как звали того человека.", "Η Ελλάδα — η χώρα μας — είναι λίγο μακριά, αλλά θα πάμε σύντομα.", "他说“你好”——然后“再见”——就走了……再也没有回来。", "Elle dit « oui », « non », « peut-être » et « jamais » selon les jours.", "It’s “done” — or so he said… and ‘left’."):
        assert quality_rules.line_fails(line.encode()) is None and not brute.line_fails(line), line
        assert quality_rules.judge(f"{line}\n{line} Und noch zwei.\nAnd some ten more English words that make it long enough.")[8] == 0
    for line in ("Start · News · Sport · Kultur", "Home » News » Sport » More", "Accueil › Actualités › Sport › Culture", "Tous droits réservés.", "TOUS DROITS RÉSERVÉS", "Alle Rechte vorbehalten", "Todos los derechos reservados", "© 2021 Someone"):
        assert quality_rules.line_fails(line.encode()), line


def test_quality_against_plain_rules_on_real_texts():
    import pyarrow.parquet as pq

    for r in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).to_pylist():
        assert quality_rules.judge(r["text"])[6] == brute.quality_kept(r["text"]), r["text"][:200]


@pytest.mark.parametrize("piece, block", [(1 << 20, 1 << 20), (64, 80)])
def test_decontamination(spark, docs, rows, piece, block):
    texts = [t for _, t in rows if t]
    items = [(1, " ".join(texts[20].split()[3:40])), (2, texts[2]), (3, "ONE Two"), (4, None), (5, ""), (6, "nowhere to be found in any of the documents at all here"), (1, texts[3]), (10, "x x x x x x x x x x x")]
    out = decontaminate.contaminated_words(docs, spark.createDataFrame(items, "item_id bigint, text string"), shard_bytes=5000, piece=piece, block_bytes=block)
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    same(out.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(ids, 256), F.col("n_hit") > 0), brute.contamination(rows, items))
    left = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert left.count() == sum(not r[5] for r in brute.contamination(rows, items))


def test_each_block_of_the_benchmark_is_a_pass(spark, docs):
    items = spark.createDataFrame([(k, f"item {k} é " * 4) for k in range(6)], "item_id bigint, text string")
    assert [len(b) for b in decontaminate._blocks(items, 76)] == [1] * 6  # bytes: 40 each
    nodes = lambda size: decontaminate.contaminated_words(docs, items, block_bytes=size)._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert nodes(1 << 20) == 1 and nodes(60) == 1


def test_suffix_array_and_index():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60, 400):
        for top in (1, 2, 9):
            t = rng.integers(1, top + 1, n)
            ended = np.append(t, 0)
            assert decontaminate.suffix_array(ended).tolist() == sorted(range(n + 1), key=lambda i: ended[i:].tolist())
            index = decontaminate.FMIndex(t)
            for m in (1, 2, 4):
                p = rng.integers(1, top + 2, (5, m))
                for q, lo, hi in zip(p, *index.search(p, np.full(5, m)), strict=True):
                    want = [i for i in range(n - m + 1) if (t[i : i + m] == q).all()]
                    assert sorted(index.locate(np.arange(lo, max(lo, hi))).tolist()) == want


@pytest.mark.parametrize("block", [4 << 20, 2000])
def test_substring_dedup(docs, rows, block, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_PHRASES", 40)
    out = substring_dedup.remove_repeats(docs, block_bytes=block)
    same(out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)), brute.substring_dedup(rows))


def test_only_automata_locate(monkeypatch):
    """What the last phase removes comes from matches alone."""
    import pyarrow as pa

    r = random.Random(2)
    say = lambda n: " ".join(r.choice("abcdefgh") for _ in range(n))
    passage = say(30)
    texts = [f"{say(20)} {passage} {say(9)}", f"{passage} {say(30)}", f"{say(3)} {passage}"]
    left = pa.table({"r": pa.array([1, 2, 3]), "doc_id": pa.array([5, 6, 7]), "text": pa.array(texts), "t": pa.array([1, 2, 3])})
    places = [20 + k for k in range(18)]  # windows of the passage in the first document
    right = pa.table({"at": pa.array(places), "value": pa.array([5] * 18), "t": pa.array([None] * 18, pa.int64())})
    run = substring_dedup._locate(13, ["r", *substring_dedup.RESULTS])
    assert run(left, right)["n_removed"].to_pylist() == [0, 30, 30]
    assert run(left, right)["spans"].to_pylist() == [[], [0, 30], [3, 33]]
    monkeypatch.setattr(substring_dedup, "SHARD_PHRASES", 5)
    assert run(left, right)["n_removed"].to_pylist() == [0, 30, 30]
    monkeypatch.setattr(substring_dedup, "occurrences", lambda automaton, text, below: [])
    assert run(left, right)["n_removed"].to_pylist() == [0, 0, 0]


def test_word_hashes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(substring_dedup, "CHUNK", 16)
    texts = ["", "one", "two one", " three\tone\n", "x" * 50 + " one", "é one " * 9, "", "one"]
    h, start = substring_dedup.Hasher().words(pa.array(["skipped", *texts]).slice(1))
    words = [w for t in texts for w in t.split()]
    assert start.tolist() == [sum(len(t.split()) for t in texts[:k]) for k in range(len(texts) + 1)]
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    assert len({(w, x) for w, x in zip(words, h.tolist())}) == len(set(words))


def test_codes_are_of_one_length():
    code, other = substring_dedup.codes_of({str(k).encode() for k in range(70_000)})
    assert {len(c) for c in code.values()} == {3, len(other)} == {3} and len(set(code.values())) == 70_000


def test_copies_of_repeated_ids(spark):
    """A row that repeats the id of a copy, with a text of its own, is compared as any other."""
    r = random.Random(4)
    say = lambda n: " ".join(r.choice("abcdefghij") for _ in range(n))
    copied, own = say(40), say(40)
    rows = [(1, copied), (5, copied), (5, own), (9, own), (9, f"{say(10)} {copied[:60]}")]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    same(out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)), brute.substring_dedup(rows))


def test_simhash(docs, rows):
    prints = {(i, brute.fingerprint(t)) for i, t in rows}
    root = brute.components(prints)
    want = [(i, f"{brute.fingerprint(t):016x}", root[brute.fingerprint(t)]) for i, t in rows]
    same(simhash.near_duplicates(docs), want)
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(root.values()) - {None}) and ids.count(None) == 3


def test_simhash_broadcasts_nothing_that_grows(docs, monkeypatch):
    from vacantia.llm import components

    plans, stored = [], simhash.stored
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (simhash, components):
        monkeypatch.setattr(module, "stored", lambda df: plan(df) or stored(df))
    plan(simhash.one_of_each(docs))
    assert sum("SortMergeJoin" in p for p in plans) > 4 and not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("crowd", [20_000, 30, 1])
def test_simhash_links_dense_families(spark, crowd):
    r = random.Random(5)
    base = r.getrandbits(64)
    prints = {0, base, 0xFFFFFFFF, 1 << 63}
    for _ in range(300):
        p = base
        for b in r.sample(range(64), r.randint(1, 6)):
            p ^= 1 << b
        prints.add(p)
    prints |= {r.getrandbits(64) for _ in range(200)}
    ids = {p: k for k, p in enumerate(sorted(prints))}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    nodes = spark.createDataFrame([(signed(p), k) for p, k in ids.items()], "fp bigint, node bigint")
    from vacantia.llm.components import components

    got = {x.node: x.component for x in components(simhash.links(nodes, crowd=crowd)).collect()}
    want = brute.components({(k, p) for p, k in ids.items()})
    assert {k: got.get(k, k) for k in ids.values()} == {k: want[p] for p, k in ids.items()}


def test_components_of_a_path(spark):
    from vacantia.llm.components import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (3, 2)], "u bigint, v bigint")
    assert {r.node: r.component for r in components(edges).collect()} == {k: 0 for k in range(41)} | {100: 100, 101: 100}


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece_viterbi.load()


def test_viterbi_takes_the_best_path(vocabulary):
    v = vocabulary
    pieces = {p: i for i, p in enumerate(v.pieces) if p and i not in set(v.byte_id.tolist())}
    least = min(v.score[i] for i in pieces.values())

    def best(s):
        score, n = [0.0] + [float("-inf")] * len(s), len(s)
        for i in range(n):
            single = s[i].encode() in pieces
            for j in range(i + 1, n + 1):
                if (p := s[i:j].encode()) in pieces:
                    score[j] = max(score[j], score[i] + v.score[pieces[p]])
            if not single:
                score[i + 1] = max(score[i + 1], score[i] + least - sentencepiece_viterbi.UNKNOWN)
        return score[n]

    texts = ["hello world", "Ndondonded thentinged.", "a  b   c ", "tab\there\n\n x", "日本語 é 😀", "  ", "antidisestablishmentarianism" * 3]
    special = set(v.byte_id.tolist())
    for t, ids in zip(texts, sentencepiece_viterbi.Encoder(v).encode(texts), strict=True):
        lost = {c for c in t if c.encode() not in pieces and c != " "}
        cost = sum(v.score[i] for i in ids if i not in special) + (least - sentencepiece_viterbi.UNKNOWN) * sum(c in lost for c in t)
        assert cost == pytest.approx(best(" " + t))


def test_sentencepiece_round_trip(docs, rows):
    extra = [(70, "▁ marker ▁▁"), (71, "\x00\x01 control"), (72, "😀👩‍👩‍👧 emoji")]
    more = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(extra, "doc_id bigint, text string"))
    out = sentencepiece_viterbi.encode_documents(more.withColumn("ids", F.lit(1)))
    same(out.select("doc_id", "text"), [*rows, *extra])
    assert all((r.ids is None) == (r.text is None) and r.n_tokens == len(r.ids or []) for r in out.collect())


def licensed(seed):
    """Texts with licenses whole and with words changed, several in one text, at all offsets, and short ones."""
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(n))
    names = sorted(license_scan.TEMPLATES)

    def worn(name, share):
        return " ".join("other" if r.random() < share else w for w in license_scan.TEMPLATES[name].split())

    rows = [(k, f"{say(r.randrange(150))} {worn(r.choice(names), r.choice([0, 0.01, 0.03, 0.06, 0.2]))} {say(r.randrange(60))}") for k in range(150)]
    rows += [(200 + k, f"{say(30)} {worn(names[k], 0)} {say(300)} {worn(names[k], 0)} {say(9)} {worn(names[-k], 0.01)}") for k in range(len(names))]
    return [*rows, (300, None), (301, ""), (302, "released under"), (303, "Released under the MIT License."), (303, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0.")]


def rounded(rows):
    return Counter((i, name, round(share, 9), first, last, tuple(sorted(others))) for i, name, share, first, last, others in rows)


def test_license_scan(spark, docs):
    rows = licensed(1)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("license", F.lit(0)).repartition(3)
    got = rounded(map(tuple, license_scan.scan_licenses(df).collect()))
    assert got == rounded(brute.licenses(rows, license_scan.TEMPLATES))
    # rows 200 and 212 carry their license three times, 9 words apart
    assert max(Counter((i, n) for i, n, *_ in got.elements()).values()) == 3 and len({n for _, n, *_ in got}) == len(license_scan.TEMPLATES)
    assert license_scan.scan_licenses(docs).count() == 0


def test_every_copy_of_a_license_has_a_row(spark):
    """Copies in a row, worn and apart, at their places; one name a place."""
    rows, want, at = [], [], 0
    for name, text in license_scan.TEMPLATES.items():
        n = len(license_scan.words_of(text))
        for copies in (1, 2, 3, 4, 9):
            rows.append((at, "before " * (at % 7) + f"{text}\n" * copies + "after " * 3))
            want += [(at, name, at % 7 + k * n, at % 7 + k * n + n - 1) for k in range(copies)]
            at += 1
    out = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    whole = {(r.doc_id, r.license, r.first_word, r.last_word) for r in out if r.containment == 1}
    assert whole >= set(want)
    # what is reported besides stands inside a longer notice, of which it is a part with words of the next copy
    assert len(out) == len(want)
    named = {r.license: set(r.alternatives) for r in out}
    assert named["GPL-3.0"] >= {"AGPL-3.0", "LGPL-3.0"} and "Apache-2.0-notice" in named["Apache-2.0"]


def test_truncated_copies_and_a_license_between(spark):
    words = license_scan.TEMPLATES["MIT"].split()
    most = " ".join(words[: len(words) * 9 // 10])
    rows = [(1, f"{most} {most} {most}"), (2, f"{most} {license_scan.TEMPLATES['ISC']} {' '.join(words)}"), (3, " ".join(words[:50])), (4, " ".join(words) * 2000)]
    out = Counter((r.doc_id, r.license) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert out == {(1, "MIT"): 3, (2, "MIT"): 2, (2, "ISC"): 1, (4, "MIT"): 2000}


def test_license_templates_are_a_table(spark):
    table = spark.createDataFrame([("own", "one two three four five six seven eight nine ten eleven twelve"), ("twin", "one two three four five six seven eight nine ten eleven twelve"), ("none", None)], "name string, text string")
    df = spark.createDataFrame([(1, "so: one two three four five six seven eight nine ten eleven twelve.")], "doc_id bigint, text string")
    assert [(r.license, r.alternatives) for r in license_scan.scan_licenses(df, table).collect()] == [("own", ["twin"])]


def test_license_retrieval_finds_what_containment_confirms():
    """Recall of the bands: every place that holds 0.8 to 1.0 of a template at any offset, by share."""
    import numpy as np

    known = license_scan.Templates(license_scan.TEMPLATES)
    want, got = Counter(), Counter()
    for _, t in licensed(2) + licensed(3):
        h = license_scan.shingles(license_scan.words_of(t))
        want.update(round(x, 1) for _, _, x, *_ in brute.licenses([(0, t)], license_scan.TEMPLATES))
        got.update(round(x, 1) for _, _, x, *_ in (known.scan(h, np.array([0, len(h)])) if len(h) else ()))
    assert want.total() > 200 and min(want[0.8], want[0.9], want[1.0]) > 0 and got == want


def test_empty_tables(spark):
    e = empty(spark)
    assert line_dedup.dedup_lines(e).count() == 0
    assert quality_rules.quality(e).count() == 0
    assert decontaminate.contaminated_words(e, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    assert substring_dedup.remove_repeats(e).count() == 0
    assert simhash.near_duplicates(e).count() == 0
    assert simhash.one_of_each(e).count() == 0
    assert sentencepiece_viterbi.encode_documents(e).count() == 0
    assert license_scan.scan_licenses(e).count() == 0

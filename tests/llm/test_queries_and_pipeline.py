"""The registered queries over small tables in a folder, and the pipeline stage by stage, against plain versions."""

import random
from collections import Counter

import pytest

import brute
import corpus_pipeline
from vacantia.llm import queries, quality_rules, sentencepiece_viterbi

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefghié") for _ in range(R.randint(2, 7))) for _ in range(400)]
FOOTER = "This footer line is shared by very many documents of the corpus."


def say(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def tables():
    items = [(k, say(30)) for k in range(4)] + [(4, "only four words here"), (5, None)]
    base, passage = say(200), say(60)
    docs = [(k, f"{say(40)}\n{FOOTER}\n{say(30)}") for k in range(9)]
    docs += [(20 + k, base if k < 3 else " ".join(w if i != 7 * k else "changed" for i, w in enumerate(base.split()))) for k in range(8)]
    docs += [(40 + k, f"{say(25)} {passage} {say(25)}") for k in range(4)]
    docs += [(50 + k, f"{say(30)} {items[k][1]} {say(20)}") for k in range(3)] + [(53, f"{say(20)} ONLY four, words here. {say(9)}")]
    docs += [(60, "a b ### c\n" * 20), (61, ""), (62, None), (63, "Home | News | About | Us | Login | More\n" * 5 + "short tail"), (64, f"{say(50)}\nAll rights reserved."), (65, "same words again " * 40), (66, say(4000))]
    docs = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in docs]
    pages = [(1, "u1", "<nav>menu</nav><article><h1>Title</h1><p>Body &amp; more text.</p></article>"), (2, "u2", None)]
    chats = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo </s>"), (2, 0, "system", None)]
    return {"documents": docs, "benchmark": items, "pages": pages, "conversations": chats}


SCHEMAS = {"documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "benchmark": "item_id bigint, text string", "pages": "page_id bigint, url string, html string", "conversations": "conv_id bigint, turn bigint, role string, text string"}


@pytest.fixture(scope="module")
def folder(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    for name, rows in tables.items():
        spark.createDataFrame(rows, SCHEMAS[name]).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_document_queries(spark, folder, tables):
    docs = [(r[0], r[1]) for r in tables["documents"]]
    q = queries.QUERIES
    assert rows(q["op1_line_dedup"](spark, folder)) == Counter(brute.line_dedup(docs))
    base = q["op3_quality_rules"](spark, folder).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(base) == Counter((i, *brute.quality_base(t)) for i, t in docs)
    assert rows(q["op6_decontaminate"](spark, folder)) == Counter(brute.contamination(docs, tables["benchmark"]))
    assert rows(q["op8_substring_dedup"](spark, folder)) == Counter(brute.substring_dedup(docs))
    prints = {(i, brute.fingerprint(t)) for i, t in docs}
    root = brute.components(prints)
    assert rows(q["op10_simhash"](spark, folder)) == Counter((i, f"{p:016x}", root[p]) for i, p in prints)
    encoded = {r.doc_id: r for r in q["op5_sentencepiece"](spark, folder).collect()}
    assert all(encoded[i].decoded_sha256 == (None if t is None else brute.sha(t)) for i, t in docs)
    assert q["op2_license_scan"](spark, folder).count() == 0


def test_other_queries(spark, folder):
    q = queries.QUERIES
    assert rows(q["op4_html_extract"](spark, folder)) == Counter([(1, "u1", "Title\n\nBody & more text.", 24), (2, "u2", "", 0)])
    chats = {r.conv_id: r for r in q["op7_chat_format"](spark, folder).collect()}
    assert sorted(chats) == [-1, 1, 2] and chats[-1].loss_sha256 == brute.sha("</s>[INST] ok [/INST]") and chats[-1].loss_chars == 21 and chats[1].loss_sha256 == brute.sha("yo </s>")
    assert {r.record_type for r in q["op9_warc"](spark, folder).collect()} == {"response"}


def test_pipeline_stages(spark, folder, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plain = {r[0]: r for r in tables["documents"]}
    want = {}
    for i, r in plain.items():
        verdict = quality_rules.judge(r[1])
        if verdict[6]:
            want[i] = verdict[7]
    kept = {}
    for i, lines, dropped, digest in brute.line_dedup(list(want.items())):
        left = "\n".join(x for x in want[i].split("\n") if not (dropped and x.strip().lower() == FOOTER.lower()))
        assert brute.sha(left) == digest and lines == want[i].count("\n") + 1
        kept[i] = left
    root = brute.components({(i, brute.fingerprint(t)) for i, t in kept.items()})
    alone = {i: t for i, t in kept.items() if root[brute.fingerprint(t)] == i}
    clean = {r[0]: alone[r[0]] for r in brute.contamination(list(alone.items()), tables["benchmark"]) if not r[5]}
    for (name, stage), after in zip(corpus_pipeline.STAGES[:4], (want, kept, alone, clean), strict=True):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert {r.doc_id: (r.text, r.source, r.n_chars) for r in out.collect()} == {i: (t, plain[i][3], len(t)) for i, t in after.items()}, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert {20, 40} <= set(alone) and not {21, 25} & set(alone) and not {50, 51, 52, 53} & set(clean) and {0, 40, 64, 66} <= set(clean)
    encoder = sentencepiece_viterbi.Encoder(sentencepiece_viterbi.load())
    ids = {i: encoder.encode([t])[0].tolist() for i, t in clean.items()}
    final = corpus_pipeline.run(spark, folder)
    assert {r.doc_id: (r.ids, r.decoded_sha256) for r in final.collect()} == {i: (ids[i], brute.sha(t)) for i, t in clean.items()}


def test_pipeline_of_no_documents(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.createDataFrame([], SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

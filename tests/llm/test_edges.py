"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from framewright.llm import chat, chunkdedup, decontaminate, linededup, mixing, neardup, quality, suffixdedup, toxicity, urls


def _crf():
    return quality.fit(np.zeros((0, quality.N_FEATURES)), np.zeros(0, int), np.zeros(0, bool))


def _cnn():
    return toxicity.fit([], np.zeros(0, bool))


def test_quality(odd_docs, no_docs):
    rows = quality.judge(odd_docs, _crf()).collect()
    assert len(rows) == 11 and all(r.base_failed and not r.kept for r in rows if r.n_words == 0)
    assert {r.n_words for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert quality.judge(no_docs, _crf()).count() == 0
    labels = no_docs.sparkSession.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int")
    assert quality.train(odd_docs, labels).emission.shape == (quality.N_FEATURES,)


def test_suffix_dedup(odd_docs, no_docs):
    rows = suffixdedup.without_repeats(odd_docs, width=40, gram=8).collect()
    assert len(rows) == 11
    for r in rows:
        if r.doc_id in (1, 2):
            assert (r.n_bytes, r.n_removed, r.kept) == (0, 0, b"")
        if r.doc_id in (5, 6):
            assert r.n_removed == r.n_bytes  # copies remove each other, repeated rows too
    assert suffixdedup.without_repeats(no_docs).count() == 0


def test_mixing(odd_docs, no_docs):
    rows = mixing.taken(mixing.mix(odd_docs)).collect()
    assert len(rows) == 11 and all(r.taken <= 2 * r["size"] for r in rows)
    assert [r.taken for r in rows if r["size"] == 0] == [0, 0, 0]
    assert mixing.taken(mixing.mix(no_docs)).count() == 0


def test_mixed_texts(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{i}_{k}" for k in range(30 + i)), "s", f"s{i % 3}") for i in range(30)], "doc_id long, text string, lang string, source string")
    plan = mixing.mix(docs, block_words=16)
    texts = [r.text.split(" ") for r in mixing.mixed_texts(plan, docs).collect()]
    assert sum(map(len, texts)) == sum(r.taken for r in mixing.taken(plan).collect())
    assert all(len(t) <= 16 for t in texts)


def test_decontamination(odd_docs, no_docs, spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "the boats that pass by in the evening"), (4, "the children count the boats that pass by")], "item_id long, text string")
    rows = decontaminate.contaminated(odd_docs, bench).collect()
    assert sorted((str(r.doc_id), str(r.item_id)) for r in rows) == sorted((d, i) for d in ("5", "5", "6", "8", "None") for i in ("4", "None"))
    assert decontaminate.without_contaminated(odd_docs, bench).count() == 6
    assert decontaminate.contaminated(no_docs, bench).count() == 0
    assert decontaminate.contaminated(odd_docs, bench.limit(0)).count() == 0
    again = decontaminate.contaminated(odd_docs, bench, block_seeds=1).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_toxicity(odd_docs, no_docs):
    rows = toxicity.score(odd_docs, _cnn()).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.without_toxic(odd_docs, _cnn()).columns == odd_docs.columns
    assert toxicity.score(no_docs, _cnn()).count() == 0
    assert toxicity.train(no_docs, no_docs.selectExpr("doc_id", "cast(1 as int) as toxic")).thresholds == {"": 0.5}


def test_line_dedup(odd_docs, no_docs):
    out = linededup.without_repeated_lines(odd_docs)
    assert out.columns == odd_docs.columns
    rows = {(r.doc_id, r.n_chars): r.text for r in out.collect()}
    assert rows[1, 0] is None and rows[2, 0] == "" and rows[3, 3] == " \n\t\n"
    assert rows[5, 9] and rows[6, 9] == "" and rows[None, 9] == "" and rows[8, 5] == "é\nü\n"
    assert linededup.without_repeated_lines(no_docs).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None, "a"), (2, "no scheme", "a"), (3, "http://", "a"), (4, "HTTP://A.Example.COM?x://y", "b"), (5, "ftp://example.com/en/7x", None), (5, "ftp://example.com/en/7x", None)], "page_id long, url string, host string")
    model = urls.train(spark)
    rows = {r.page_id: r for r in urls.judge(pages, *model).collect()}
    assert (rows[1].host, rows[1].path, rows[2].host, rows[3].host) == ("", "", "", "")
    assert (rows[4].host, rows[4].path, rows[4].rule) == ("a.example.com", "", None)
    assert (rows[5].rule, rows[5].verdict) == ("example.com/en/7", "allow")
    assert urls.judge(pages.limit(0), *model).count() == 0


def test_chunk_dedup(odd_docs, no_docs):
    rows = chunkdedup.without_repeats(odd_docs, least_run=1).collect()
    assert len(rows) == 11 and [r.text for r in rows if r.doc_id == 1] == [None]
    assert [r.n_removed for r in rows if r.doc_id == 5] == [0, 0] and [r.n_removed for r in rows if r.doc_id == 6] == [r.n_bytes for r in rows if r.doc_id == 6]
    assert chunkdedup.without_repeats(no_docs).count() == 0


def test_near_duplicates(odd_docs, no_docs):
    rows = neardup.classes(odd_docs).collect()
    assert len(rows) == 11 and all(r.component_id == r.doc_id for r in rows if r.n_shingles == 0)
    assert {r.component_id for r in rows if r.node == next(r for r in rows if r.doc_id == 5).node} == {5}
    kept = neardup.without_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "None"]
    assert neardup.classes(no_docs).count() == 0 and neardup.without_near_duplicates(no_docs).count() == 0


def test_chat(spark):
    turns = spark.createDataFrame([(1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (None, None, "assistant", "&lt;</turn>\n<turn x>&"), (2, 5000, "assistant", ""), (2, 5000, "assistant", "")], "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r for r in chat.digests(chat.formatted(turns)).collect()}
    assert rows[1].n_turns == 3 and rows[2].n_turns == 2 and rows[None].loss_chars == len("&lt;</turn>\n<turn x>&")
    assert chat.digests(chat.formatted(turns.limit(0))).count() == 0


def test_chat_layouts(spark):
    payloads = [
        '{"messages":[{"content":"hi","role":"user"},{"role":"assistant","content":"yo"}]}', '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}',
        '{"response":"yo","prompt":"hi"}', '{"prompt":"hi","completion":"yo"}', '{"instruction":"hi","output":"yo"}', '{"instruction":"hi","input":"","output":"yo"}',
        '{"question":"hi","answer":"yo"}', '{"data":{"prompt":"hi","response":"yo"}}', '{"other":1}', "not json", None,
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "id long, payload string")
    got = {r.id: r.turns for r in chat.canonical_turns(df).collect()}
    assert all([tuple(t) for t in got[i]] == [("user", "hi"), ("assistant", "yo")] for i in range(8))
    assert got[8] is None and got[9] is None and got[10] is None
    assert sorted(r.id for r in chat.unmatched(df).collect()) == [8, 9, 10]


def test_chat_very_long_text(spark):
    """A text of 21 million characters comes back whole from columns; as JSON it is marked and returned, beside the others."""
    long = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.struct(F.lit("assistant").alias("role"), F.expr("repeat('<&\u00e9 abcd', 3000000)").alias("text")).alias("record"))
    turns = chat.column_turns(long).select("conv_id", "turn", F.explode("turns").alias("t")).select("conv_id", "turn", "t.role", "t.text")
    row = chat.digests(chat.formatted(turns)).first()
    whole = "<&\u00e9 abcd" * 3_000_000
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (1, 24_000_000, hashlib.sha256(whole.encode()).hexdigest())
    payloads = long.select("conv_id", F.to_json("record").alias("payload")).unionByName(spark.createDataFrame([(2, '{"prompt":"hi","response":"yo"}'), (3, "not json")], "conv_id long, payload string"))
    assert {r.conv_id: r.turns and len(r.turns) for r in chat.canonical_turns(payloads).collect()} == {1: None, 2: 2, 3: None}
    rest = {r.conv_id: r for r in chat.unmatched(payloads).select("conv_id", "too_long", F.sha2("payload", 256).alias("sha")).collect()}
    assert set(rest) == {1, 3} and rest[1].too_long and not rest[3].too_long
    assert rest[1].sha == hashlib.sha256(payloads.filter("conv_id = 1").first().payload.encode()).hexdigest()

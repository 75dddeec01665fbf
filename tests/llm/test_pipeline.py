"""Each stage of the pipeline against what its operator says of the stage's own input."""

import corpus_pipeline
from framewright.llm import decontaminate, linededup, mixing, neardup


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        seen[name] = docs.count()
        if name != "mix":
            assert docs.columns == columns
        if name == "line_dedup":
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
            cut = {r.doc_id: r.text for r in linededup.without_repeated_lines(before).collect()}
            assert gone == {d.doc_id for d in before.collect() if (d.text or "").split() and not cut[d.doc_id].split()} and gone
        if name == "near_dedup":
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in neardup.classes(before).collect() if r.kept}
        if name == "decontaminate":
            bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            bad = {r.doc_id for r in decontaminate.contaminated(before, bench).collect()}
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - bad
        if name == "mix":
            assert sorted(map(str, docs.collect())) == sorted(map(str, mixing.taken(mixing.mix(before)).collect()))
    assert list(seen) == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "mix"]
    total = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert 0.7 * total < seen["toxicity"] < total and seen["near_dedup"] <= seen["line_dedup"]
    removed = {b: seen[a] - seen[b] for a, b in zip(seen, list(seen)[1:])}
    assert removed["line_dedup"] > 0 and removed["decontaminate"] > 0 and removed["mix"] == 0, removed


def test_near_dedup_has_work_after_line_dedup(spark, tmp_path):
    """Documents whose lines all differ a little stay in line dedup as lines of their own, and go as near copies."""
    words = [f"word{k}" for k in range(400)]
    copies = [words, words[:397] + ["x", "y", "z"], [f"other{k}" for k in range(400)]]
    text = ["\n".join(" ".join(w[i : i + 5]) + f" line {n} {i} {'ab'[n % 2] * 9}" for i in range(0, 400, 5)) for n, w in enumerate(copies)]
    text.append(text[2].replace("other7 ", "else "))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(text)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    after = {r.doc_id for r in stages["near_dedup"](spark, docs, str(tmp_path)).collect()}
    assert 2 in after and 3 not in after


def test_stages_on_odd_rows(spark, odd_docs, no_docs, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns; and no rows at all."""
    spark.createDataFrame([(5, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs, counts in ((odd_docs, [11, 9, 8, 8, 8]), (no_docs, [0] * 5)):
        columns = docs.columns
        for (name, stage), n in zip(corpus_pipeline.STAGES, counts):
            docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
            assert docs.count() == n, name
            assert name == "mix" or docs.columns == columns

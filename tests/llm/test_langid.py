"""Language identification: code lengths against a plain PPM, held-out accuracy, odd texts."""

import collections
import math

import pytest

from framewright.llm import langid, queries
from tests.llm.conftest import read

TRAIN = [("the cat sat on the mat", "en"), ("the dog ran", "en"), ("der hund lief", "de"), ("die katze saß auf der matte", "de"), ("", "en"), (None, "de"), ("no language", None)]


def _bits(text, order, nodes):
    """Code length of a text in every language, byte by byte and context by context."""
    out = {}
    for lang in sorted({x for _, x in TRAIN if x}):
        trees = []
        for k in range(order + 1):
            n = collections.Counter()
            for t, x in TRAIN:
                if x == lang and t:
                    raw = bytes(order) + t.encode()
                    n.update(raw[i - k : i + 1] for i in range(order, len(raw)))
            total = collections.Counter()
            for s, c in n.items():
                total[s[:-1]] += c
            tree = collections.defaultdict(dict)
            for s, c in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:nodes]:
                tree[s[:-1]][s[-1]] = c
            trees.append((tree, total))
        raw, units = bytes(order) + text.encode(), 0
        for i in range(order, len(raw)):
            for k in range(order, -2, -1):
                if k < 0:
                    units += 8 * langid.UNIT
                    break
                ctx = raw[i - k : i]
                here, total = trees[k][0].get(ctx), trees[k][1][ctx]
                if here is None:
                    continue
                if raw[i] in here:
                    units += round(-math.log2(here[raw[i]] / (total + len(here))) * langid.UNIT)
                    break
                units += round(-math.log2((total - sum(here.values()) + len(here)) / (total + len(here))) * langid.UNIT)
        out[lang] = units / langid.UNIT
    return [out[x] for x in sorted(out)]


@pytest.mark.parametrize("order, nodes", [(3, 1000), (4, 9), (0, 5)])
def test_code_lengths(spark, order, nodes):
    train = spark.createDataFrame([(*r, "x") for r in TRAIN], "text string, lang string, string string")
    model = langid.train(train, order, nodes)
    assert model.langs == ["de", "en"]
    texts = ["the mat", "der kater", "saß", "\x00\x00q", "", "€ und 𝄞", "the dog ran" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.identified(docs, model).collect():
        assert r.bits == pytest.approx(_bits(texts[r.doc_id], order, nodes), abs=1e-6)


def test_odd_texts(spark, odd_docs, no_docs):
    model = langid.train(odd_docs)
    assert model.langs == ["de", "en", "fr"]
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 + 3 → 4"), (None, "é"), (5, "中"), (6, "supper is called"), (6, "supper is called")], "doc_id long, text string")
    got = langid.identified(docs.withColumn("lang", docs.text), model).collect()
    assert [r.lang_pred == "und" for r in got] == [True, True, True, False, False, False, False]
    assert all(0 <= r.score <= 1 for r in got) and got[5] == got[6]
    assert langid.identified(odd_docs, model).count() == odd_docs.count() and langid.identified(no_docs, model).count() == 0
    nothing = langid.train(no_docs)
    assert nothing.langs == [] and {(r.lang_pred, r.score) for r in langid.identified(docs, nothing).collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in read(spark, sf_dir, "documents").collect()}
    rows = [r for r in queries.op12_language_ppm(spark, sf_dir).collect() if r.held_out and r.lang_pred != "und"]
    assert len(rows) > 20 and sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.97 * len(rows)

"""Collocations against brute force, with nulls, ties, repeated rows, odd separators and repeated passages."""

import collections
import random
import re

import duckdb
import pytest
from pyspark.errors import PySparkException

from framewright.llm import collocations, queries
from tests.llm.conftest import LOW


def _brute(rows, least, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = {}
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        over = collections.Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    over[p[i : i + k]] = max(over[p[i : i + k]], a)
        found = []
        for p, a in candidates.items():
            if not over[p] or 100 * over[p] < 80 * a:
                s, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]):
            out[lang, i + 1] = (p.decode(), -a, left, right, n[lang], -s)
    return out


def _got(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def _texts(seed):
    rng = random.Random(seed)
    words = ["Aa", "b", "c", "d\u00a0d", "e\x1cf", "\u00e9", "\u4e2d", "rare"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", "\n", "\x0b", "...", "! "]
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(None, "en"), ("", "en"), (" \n.", None), ("x", None), ("\x00 a", "en"), (passage, "de")] + [(f"q{k} {passage} z{k}", "de") for k in range(8)]
    for _ in range(60):
        text = "".join(rng.choices(words, [9, 9, 9, 5, 5, 3, 3, 1])[0] + rng.choice(gaps) for _ in range(rng.randint(1, 40)))
        rows.append((text, rng.choice(["en", "en", "fr", None, "und"])))
    return rows + rows[-4:]


@pytest.mark.parametrize("least, top", [(3, 2000), (6, 7)])
def test_against_brute_force(spark, least, top):
    rows = _texts(least)
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "text string, lang string, word string, a string")
    assert _got(collocations.collocations(docs, least, top)) == _brute(rows, least, top)


def test_a_repeated_passage_is_one_path(spark):
    docs = spark.createDataFrame(_texts(1), "text string, lang string")
    sizes = {r.path_words for r in collocations.collocations(docs, 5).filter("lang = 'de' and path_words is not null").collect()}
    assert sizes == {40}


def test_words_that_share_a_hash_are_an_error(spark):
    phrases = spark.createDataFrame([(1, 2, 0, 0, 5)], "a long, b long, c long, d long, n long")
    words = spark.createDataFrame([(1, "one", "en"), (1, "uno", "es"), (2, "two", "en")], "a long, word string, lang string")
    with pytest.raises(PySparkException, match="share a hash"):
        collocations.with_words(phrases, words).collect()


def test_empty_table_and_text_of_one_long_word(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).count() == 0
    long = spark.createDataFrame([("y" * 3_000_000 + " z" * 400_000, "en")], "text string, lang string")
    assert _got(collocations.collocations(long)) == {("en", 1): ("z z z z", 399_997, 400_000, 399_998, 400_001, 2000000 * 399_997 // 799_998)}


def test_query_and_sql(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES['op13_collocations']})").fetchall()
    got = queries.op13_collocations(spark, sf_dir)
    assert set(got.columns) == set(columns) and sorted(want) == sorted(tuple(r) for r in got.select(*columns).collect())

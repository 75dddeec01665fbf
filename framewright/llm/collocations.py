"""Phrase collocation mining on a weighted de Bruijn graph of words.

Texts are lower-cased (A-Z) and cut into pieces at ``[.,;:!?\\x0A-\\x0D]``; words are ``[^\\x20\\x09]+`` of a piece.
Nodes of the graph are three words, its edges four: an edge counts how often its words stand in a row, per language. What a piece
ends with is counted too, so that the counts of shorter phrases follow from the graph: a node occurs as often as its edges leave it
and pieces end in it, two words as often as nodes start with them and pieces end in them, one word likewise.

1. Neighbours that stand together less than ``least`` times can be in no phrase that is reported, so pieces are cut between them.
   The frequent ones go to the tasks as a bit map of fixed size (8 MB); two that share a bit only cut a piece less, which changes no count.
2. Edges and piece ends are combined where they are read, then summed up by key.
3. An edge and the next one form a path where the node between them has no other way in or out (all its occurrences are theirs).
   Paths are joined up by pointer doubling: ``path_words`` is the length of the path an edge lies on.
4. Every phrase of two to four words found ``least`` times meets the counts of its parts by key, its score is that of its worst cut, and
   it is dropped where a longer phrase has 80% of its occurrences.

Words are identified by 64-bit hashes of language and word; a hash with two words raises an error instead of a wrong count.
Defined results: null and empty texts have no words; a null language counts as ``und``; rows repeated in the table count each time; phrases never
cross pieces or texts; very long texts are scanned whole; ties of score go by count, then by the phrase's bytes; an empty table gives no rows. Columns other
than text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm import text as tx
from framewright.llm.store import discard, written

LEAST, TOP, WORDS = 30, 2000, 4
#: Bits of the map of frequent neighbours, and bits of one of its rows.
BITS, ROW = 1 << 26, 1 << 12
_SLICE = 1 << 20
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True
_GRAPH = "a long, b long, c long, d long, n long, word string, lang string"
KEY = ("a", "b", "c", "d")


def _scan(texts: pa.Array, langs: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, start, end, hash and document of each word, and whether the next word is in the same piece."""
    low = tx.lower(raw)
    starts, ends, before = tx.words(low, offsets, _GAP)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    lang_raw, lang_at = tx.buffers(langs)
    own = tx.span_hash(lang_raw, lang_at[:-1], lang_at[1:], 5)
    hashes = tx.mix(tx.span_hash(low, starts, ends) ^ own[doc])
    hashes[hashes == 0] = 1
    broken = np.concatenate([[0], np.cumsum(_BREAK[low])])
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (doc[1:] == doc[:-1]) & (broken[starts[1:]] == broken[ends[:-1]])
    return low, starts, ends, hashes, doc, joined


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, tuple[np.ndarray, ...]]]:
    for lo, hi, raw, offsets in tx.slices(batch["text"], _SLICE):
        langs = batch["lang"].slice(lo, hi - lo).fill_null("und")
        yield langs, _scan(batch["text"].slice(lo, hi - lo), langs, raw, offsets)


def _neighbours(hashes: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """A hash of every word and the next one."""
    return tx.window_hash(hashes, 2)[joined[:-1]] if len(hashes) > 1 else np.zeros(0, np.uint64)


def frequent_neighbours(rows: DataFrame, least: int) -> np.ndarray:
    """Bit map of the hashes of neighbours that stand together ``least`` times or more."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, (_, _, _, hashes, _, joined) in _slices(batch):
                keys, n = np.unique(_neighbours(hashes, joined), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for bits in batch["bits"].to_pylist():
                flags = np.zeros(ROW, bool)
                flags[bits] = True
                maps.append(np.packbits(flags).tobytes())
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(maps, pa.binary())], ["row", "map"])

    often = rows.mapInArrow(pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    bit = F.col("key").bitwiseAND(F.lit(BITS - 1))
    each = often.groupBy(F.floor(bit / ROW).cast("int").alias("row")).agg(F.collect_set((bit % ROW).cast("int")).alias("bits"))
    found = np.zeros(BITS // 8, np.uint8)
    for r in each.mapInArrow(packed, "row int, map binary").collect():  # at most BITS / ROW rows of fixed size
        found[r.row * ROW // 8 : (r.row + 1) * ROW // 8] = np.frombuffer(r.map, np.uint8)
    return found


def _set(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & tx.U64(BITS - 1)).astype(np.int64)
    return (found[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _combined(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows without most repeats, and how often each stands for."""
    key = np.zeros(len(columns[0]), np.uint64)
    for k, c in enumerate(columns):
        key += tx.mix(c + tx.U64(k + 1))
    order = np.argsort(key)
    at = [c[order] for c in columns]
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in at])
    head = np.flatnonzero(first)
    return [c[head] for c in at], np.diff(np.append(head, len(order)))


def graph_rows(rows: DataFrame, found: np.ndarray) -> DataFrame:
    """Edges (a, b, c, d), piece ends of up to three words (0 behind the last), words by hash (word, lang) and all words of a language (a = 0)."""
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for langs, (low, starts, ends, hashes, doc, joined) in _slices(batch):
                n = len(hashes)
                if not n:
                    continue
                joined[np.flatnonzero(joined[:-1])[~_set(often, _neighbours(hashes, joined))]] = False
                last = np.flatnonzero(~joined)
                size = np.diff(last, prepend=-1)
                left = np.repeat(last, size) - np.arange(n)
                edge = np.flatnonzero(left >= WORDS - 1)
                tail = np.minimum(size, WORDS - 1)
                columns = []
                for k in range(WORDS):
                    inside = tail > k
                    end = np.where(inside, hashes[np.where(inside, last - tail + 1 + k, 0)], tx.U64(0))
                    columns.append(np.concatenate([hashes[edge + k], end]))
                columns, count = _combined(columns)
                linked = np.flatnonzero(np.repeat(size > 1, size))
                key, at = np.unique(hashes[linked], return_index=True)
                at = linked[at]
                words = [low[i:j].tobytes().decode() for i, j in zip(starts[at], ends[at])]
                names = langs.take(pa.array(doc[at]))
                per_doc = np.bincount(doc, minlength=len(langs))
                zero = np.zeros(len(langs) + len(key), np.uint64)
                columns = [np.concatenate([columns[0], key, np.zeros(len(langs), np.uint64)]), *(np.concatenate([c, zero]) for c in columns[1:])]
                none = pa.nulls(len(count), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(c.view(np.int64)) for c in columns),
                        pa.array(np.concatenate([count, np.zeros(len(key), np.int64), per_doc]).astype(np.int64)),
                        pa.concat_arrays([none, pa.array(words, pa.string()), pa.nulls(len(langs), pa.string())]),
                        pa.concat_arrays([none, names.cast(pa.string()), langs.cast(pa.string())]),
                    ],
                    [c.split()[0] for c in _GRAPH.split(", ")],
                )

    return rows.mapInArrow(run, _GRAPH)


def phrase_counts(edges: DataFrame) -> DataFrame:
    """(a, b, c, d, n) of all phrases of one to four words, from edges and piece ends: shorter ones from the flow through their node and the pieces that end in it."""
    n = F.sum("n").alias("n")
    zero = F.lit(0).cast("long")
    at = lambda k: [F.col(KEY[k + i]).alias(KEY[i]) for i in range(3 - k)]
    ends = edges.filter("d = 0")
    three = edges.filter("c <> 0").groupBy("a", "b", "c").agg(n)
    two_ends = ends.filter("c <> 0").select(*at(1), "n").unionByName(ends.filter("c = 0 and b <> 0").select("a", "b", "n"))
    two = three.select("a", "b", "n").unionByName(two_ends).groupBy("a", "b").agg(n)
    word = F.when(F.col("c") != 0, F.col("c")).when(F.col("b") != 0, F.col("b")).otherwise(F.col("a")).alias("a")
    one = two.select("a", "n").unionByName(ends.select(word, "n")).groupBy("a").agg(n)
    full = lambda df: df.select(*[F.col(c) if c in df.columns else zero.alias(c) for c in KEY], "n")
    return edges.filter("d <> 0").unionByName(full(three)).unionByName(full(two)).unionByName(full(one))


def unary_paths(counts: DataFrame) -> DataFrame:
    """(a, b, c, d, path_words) of the edges among ``counts``: how many words the path has on which an edge lies.

    Two edges follow one another on a path if the node between them occurs as often as either, so that no other edge enters or leaves it. A
    node can't be left and entered for ever: every piece starts somewhere. Pointers to the edge before double their reach every round.
    """
    edges = counts.filter("d <> 0")
    node = counts.filter("d = 0 and c <> 0").select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("c").alias("d"), "n")
    before = edges.join(node, ["b", "c", "d", "n"], "left_semi").select(F.struct(*KEY).alias("up"), *[F.col(KEY[k + 1]).alias(KEY[k]) for k in range(3)], "n")
    first = F.col("up").isNull()
    table = edges.join(before, ["a", "b", "c", "n"], "left").select(F.struct(*KEY).alias("edge"), "up")
    table = written(table.select("edge", "up", F.when(first, 0).otherwise(1).cast("long").alias("steps"), F.when(first, F.col("edge")).alias("head")), "paths")
    while not table.filter("up is not null").isEmpty():
        further = table.select(F.col("edge").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("head").alias("top"))
        ahead = table.filter("up is not null").join(further, "up")
        step = ahead.select("edge", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("top").alias("head"))
        new = written(table.filter("up is null").unionByName(step), "paths")
        discard(table)
        table = new
    rows = table.select("edge", "head", "steps")
    longest = rows.groupBy("head").agg((F.max("steps") + WORDS).alias("path_words"))
    return rows.join(longest, "head").select("edge.*", "path_words")


def _subphrases(length: int) -> list[list[str]]:
    """Runs of two or more words inside a phrase of ``length`` words, shorter than it."""
    return [list(KEY[i : i + size]) for size in range(2, length) for i in range(length - size + 1)]


def _key(words: list[str]) -> list[Column]:
    return [(F.col(words[k]) if k < len(words) else F.lit(0).cast("long")).alias(KEY[k]) for k in range(WORDS)]


def scored(counts: DataFrame) -> DataFrame:
    """(a, b, c, d, n, l, r, score) of the phrases that no longer one makes up for: parts and score of the worst cut."""
    parts, longer = [], []
    for length in range(2, WORDS + 1):
        own = counts.filter(f"{KEY[length - 1]} <> 0" + (f" and {KEY[length]} = 0" if length < WORDS else ""))
        sides = [F.struct(F.lit(2 * k + side).alias("place"), *[c.alias(f"p{c_name}") for c, c_name in zip(_key(list(KEY[:k] if not side else KEY[k:length])), KEY)]) for k in range(1, length) for side in (0, 1)]
        parts.append(own.select(*KEY, "n", F.explode(F.array(*sides)).alias("part")).select(*KEY, "n", "part.*"))
        if length > 2:
            inner = F.array(*[F.struct(*_key(w)) for w in _subphrases(length)])
            longer.append(own.select(F.explode(inner).alias("s"), "n").select("s.*", F.col("n").alias("longer")))
    parts, longer = parts[0].unionByName(parts[1]).unionByName(parts[2]), longer[0].unionByName(longer[1])
    of = counts.select(*[F.col(c).alias(f"p{c}") for c in KEY], F.col("n").alias("m"))
    met = parts.join(of, [f"p{c}" for c in KEY]).select(*KEY, "n", "place", "m", F.lit(None).cast("long").alias("longer"))
    over = longer.select(*KEY, *[F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("place", "int"), ("m", "long"))], "longer")
    places = range(2, 2 * WORDS)
    g = met.unionByName(over).groupBy(*KEY).agg(F.max("n").alias("n"), F.max("longer").alias("longer"), *[F.max(F.when(F.col("place") == p, F.col("m"))).alias(f"m{p}") for p in places])
    big = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = [F.when(F.col(f"m{2 * k}").isNotNull(), F.struct(F.expr(f"cast(n AS decimal(20,0)) * 2000000 div (cast(m{2 * k} AS decimal(20,0)) + m{2 * k + 1})").alias("score"), F.lit(k).alias("k"), F.col(f"m{2 * k}").alias("l"), F.col(f"m{2 * k + 1}").alias("r"))) for k in range(1, WORDS)]
    alone = F.col("longer").isNull() | (100 * big("longer") < 80 * big("n"))
    return g.filter(alone).withColumn("cut", F.array_min(F.array(*cuts))).select(*KEY, "n", "cut.l", "cut.r", "cut.score")


def with_words(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrases`` with ``phrase`` and ``lang`` from words by hash (a, word, lang)."""
    checked = words.groupBy("a").agg(F.min(F.struct("word", "lang")).alias("low"), F.max(F.struct("word", "lang")).alias("high"))
    word = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.raise_error(F.lit("two words share a hash")).cast("struct<word:string,lang:string>"))
    checked = checked.select(F.col("a").alias("w"), word.alias("at"))
    each = phrases.select("*", F.posexplode(F.array(*KEY)).alias("place", "w")).filter("w <> 0")
    met = each.join(checked, "w").groupBy(*phrases.columns).agg(F.array_sort(F.collect_list(F.struct("place", "at"))).alias("ws"))
    return met.withColumn("phrase", F.array_join(F.transform("ws", lambda x: x["at"]["word"]), " ")).withColumn("lang", F.col("ws")[0]["at"]["lang"]).drop("ws")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a (its count), l, r, n (words of the language), score, path_words: the ``top`` phrases of every language."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    graph = written(graph_rows(rows, frequent_neighbours(rows, least)), "graph")
    edges = written(graph.filter("a <> 0 and word is null").groupBy(*KEY).agg(F.sum("n").alias("n")), "edges")
    counts = written(phrase_counts(edges).filter(F.col("n") >= least), "phrases")
    discard(edges)
    total = graph.filter("a = 0").groupBy("lang").agg(F.sum("n").alias("total"))
    words = graph.filter("word is not null").select("a", "word", "lang").distinct()
    found = with_words(scored(counts), words)
    order = [F.desc("score"), F.desc("n"), F.asc("phrase")]
    salt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(16))).orderBy(*order)
    short = found.withColumn("k", F.row_number().over(salt)).filter(F.col("k") <= top)  # at most 16 * top rows of a language go on
    best = short.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    out = best.join(total, "lang").join(unary_paths(counts), list(KEY), "left")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("n").alias("a"), "l", "r", F.col("total").alias("n"), "score", "path_words")

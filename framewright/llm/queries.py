"""The registered query of each operator, over its whole table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import chat, chunkdedup, collocations, decontaminate, langid, linededup, mixing, neardup, quality, runs, suffixdedup, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


def op4_decontaminate_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.expr("cast(score >= 0.5 as int)").alias("predicted"), "toxic")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.without_repeated_lines(docs, counts=True).select("doc_id", "n_lines", "n_removed", "text")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), *urls.train(spark))


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkdedup.without_repeats(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), width=3, percent=85).drop("node", "root")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of ``conversations`` is a record of the layout turn; conversation -7 is a JSON record of the layout messages."""
    rows = table(spark, sf_dir, "conversations")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, json.dumps({"messages": [{"role": r, "content": said} for r in ("user", "assistant")]}))], "conv_id long, turn long, payload string")
    turns = chat.column_turns(rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.struct("role", "text").alias("record")))
    turns = turns.unionByName(chat.canonical_turns(extra)).select("conv_id", "turn", F.posexplode("turns").alias("at", "said"))
    return chat.digests(chat.formatted(turns.select("conv_id", (F.col("turn") + F.col("at")).alias("turn"), "said.role", "said.text")))


def _repeated_words(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by crc32 of doc_id, with their words from a place on replaced by repetitions of the first ones there."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    rows = docs.select("doc_id", "text", words.alias("w"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("w").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapsed(_repeated_words(table(spark, sf_dir, "documents")))
    found = found.withColumn("best", runs.strongest(F.col("runs")))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"], F.lit("\n")))))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("collapsed_sha256"),
    )


def op12_language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.held_out(F.col("doc_id"))
    found = langid.identified(docs, langid.train(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).drop("path_words")


QUERIES = {
    "op1_quality_crf": op1_quality_crf,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_decontaminate_seeds": op4_decontaminate_seeds,
    "op5_toxicity_cnn": op5_toxicity_cnn,
    "op6_line_dedup": op6_line_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_chunk_dedup": op8_chunk_dedup,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_chat_format": op10_chat_format,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_language_ppm": op12_language_ppm,
    "op13_collocations": op13_collocations,
}
_SAID = "'\\### Assistant: </turn> ok'"
ORACLES: dict[str, str] = {
    "op10_chat_format": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', {_SAID} UNION ALL SELECT -7, 1, 'assistant', {_SAID}
        ), e AS (
            SELECT *, length(role || text) + length(regexp_replace(role || text, '[^&<>]', '', 'g')) AS n FROM t
        )
        SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(n + 15) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op9_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), t AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, s FROM (SELECT doc_id, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS s FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)) WHERE s IS NOT NULL
            UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2
        ), n AS MATERIALIZED (SELECT doc_id, CAST(count(s) AS BIGINT) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY 1),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
        ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM ways UNION SELECT r.doc_id, b FROM reach r JOIN ways ON a = other),
        least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM n LEFT JOIN least USING (doc_id)""",
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
        ), w AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
        t AS (SELECT lang, piece, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
        q AS (SELECT lang, w, w || ' ' || lead(w) OVER p AS w2, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p AS w3, w || ' ' || lead(w) OVER p || ' ' || lead(w, 2) OVER p || ' ' || lead(w, 3) OVER p AS w4
              FROM t WINDOW p AS (PARTITION BY piece ORDER BY i)),
        total AS (SELECT lang, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY 1),
        grams AS (SELECT lang, unnest([w, w2, w3, w4]) AS phrase FROM q),
        f AS MATERIALIZED (SELECT lang, phrase, string_split(phrase, ' ') AS g, n FROM (SELECT lang, phrase, CAST(count(*) AS BIGINT) AS n FROM grams WHERE phrase IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 30)),
        longer AS (SELECT lang, unnest(CASE WHEN len(g) = 3 THEN [g[1:2], g[2:3]] ELSE [g[1:2], g[2:3], g[3:4], g[1:3], g[2:4]] END) AS g, n FROM f WHERE len(g) > 2),
        over AS MATERIALIZED (SELECT lang, array_to_string(g, ' ') AS phrase, max(n) AS m FROM longer GROUP BY 1, 2),
        c AS MATERIALIZED (SELECT lang, phrase, n, k, array_to_string(g[1:k], ' ') AS one, array_to_string(g[k + 1:], ' ') AS two FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f)),
        cuts AS (SELECT c.lang, c.phrase, c.n AS a, k, l.n AS l, r.n AS r, CAST(2000000::HUGEINT * c.n // (l.n + r.n) AS BIGINT) AS score FROM c JOIN f l ON l.lang = c.lang AND l.phrase = one JOIN f r ON r.lang = c.lang AND r.phrase = two),
        worst AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM cuts),
        kept AS (SELECT worst.lang, worst.phrase, a, l, r, score FROM worst LEFT JOIN over USING (lang, phrase) WHERE place = 1 AND NOT coalesce(100::HUGEINT * m >= 80::HUGEINT * a, FALSE)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
}

"""Thin queries over the given tables, one per operator, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulefold.llm.chat import format_chats, read_chats
from rulefold.llm.classifier import fit, score
from rulefold.llm.collocations import collocations
from rulefold.llm.exact_dedup import exact_dedup
from rulefold.llm.jaccard_join import Settings as Jaccard
from rulefold.llm.jaccard_join import near_duplicates
from rulefold.llm.mixing import mix
from rulefold.llm.packing import pack_documents
from rulefold.llm.period_runs import find_runs
from rulefold.llm.quality_rules import clean_texts, quality_rules
from rulefold.llm.registry import ORACLES, QUERIES, query
from rulefold.llm.suffix_dedup import remove_repeats
from rulefold.llm.token_counts import token_counts
from rulefold.llm.topk_search import top_k
from rulefold.llm.warc import round_trip
from rulefold.session import table

__all__ = ["ORACLES", "QUERIES"]


@query("op10_exact_dedup", r"""
    WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
    g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM t JOIN g USING (body)""")
def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents"))


@query("op6_mixing", r"""
    WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM t GROUP BY source),
    w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
    r AS (SELECT *, 3 * source_size / weight AS ratio, sum(source_size) OVER () AS total FROM w),
    c AS (SELECT *, total - coalesce(sum(3 * source_size) OVER before, 0) AS open_words,
            sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight FROM r
          WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT arg_min(open_words / open_weight, ratio) AS level FROM c WHERE ratio >= open_words / open_weight),
    g AS (SELECT *, least(weight * level, 3 * source_size) AS target FROM c, l),
    k AS (SELECT *, ('0x' || substr(md5(doc_id || ':17'), 1, 15))::BIGINT AS key FROM documents),
    p AS (SELECT k.doc_id, t.size, source_size::BIGINT AS source_size, target, round(target)::BIGINT AS words,
            coalesce(sum(t.size) OVER (PARTITION BY k.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM k JOIN t USING (doc_id) JOIN g ON k.source IS NOT DISTINCT FROM g.source)
    SELECT doc_id, size, source_size, target, (size * (words // source_size)
        + greatest(0, least(size, words % source_size - before)))::BIGINT AS taken FROM p""")
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(table(spark, folder, "documents"), keep_columns=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


@query("op1_chat_formatting", r"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    chats AS (
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss
        FROM rows GROUP BY conv_id),
    marked AS (
        SELECT conv_id, length(replace(text, '\', '\\')) + length(replace(role, '\', '\\'))
            * (role IS DISTINCT FROM lag(role) OVER w)::INT
            + (length(text) - length(replace(text, '<|', '<'))) + (length(text) - length(replace(text, '</s>', '/s>')))
            + (length(text) - length(replace(text, '<s>', 's>'))) + (length(text) - length(replace(text, '[INST]', 'INST]')))
            + (length(text) - length(replace(text, '[/INST]', '/INST]'))) + (length(text) - length(replace(text, '<<SYS>>', '<SYS>>')))
            + (length(text) - length(replace(text, '<</SYS>>', '</SYS>>')))
            + CASE WHEN role IS DISTINCT FROM lag(role) OVER w THEN 16 ELSE 8 END
            + CASE WHEN role IS DISTINCT FROM lead(role) OVER w THEN 7 ELSE 0 END AS chars
        FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
    SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
    FROM chats JOIN (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM marked GROUP BY conv_id) USING (conv_id)""")
def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], turns.schema)
    back = read_chats(format_chats(turns.unionByName(probe)))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


@query("op7_quality_rules", r"""
    WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines, text FROM t),
    grams AS (SELECT doc_id, i, words[i:i + 7] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
    twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
    covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM twice) GROUP BY doc_id),
    line AS (SELECT doc_id, unnest(lines) AS line FROM w),
    full_line AS (SELECT doc_id, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS words FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_line GROUP BY doc_id),
    hosts AS (SELECT source, count(*) AS documents FROM t GROUP BY source),
    common AS (
        SELECT t.source, words FROM full_line JOIN t USING (doc_id) JOIN hosts ON t.source IS NOT DISTINCT FROM hosts.source
        GROUP BY t.source, words, hosts.documents
        HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT doc_id) > 0.01 * hosts.documents),
    gone AS (
        SELECT f.doc_id, sum(len(f.words)) AS n FROM full_line f JOIN t USING (doc_id)
        JOIN common c ON t.source IS NOT DISTINCT FROM c.source AND f.words = c.words GROUP BY f.doc_id),
    m AS (
        SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
            (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_boilerplate_words
        FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id)),
    f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
    SELECT *, NOT base_failed AND NOT (n_boilerplate_words > 0 AND n_words - n_boilerplate_words < 0.2 * n_words) AS kept FROM f""")
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"))


@query("quality_rules_clean_texts", ORACLES["op7_quality_rules"].rpartition("    SELECT *, NOT")[0].rstrip() + r""",
    piece AS (SELECT doc_id, i, lines[i] || CASE WHEN i < len(lines) THEN chr(10) ELSE '' END AS piece, source,
              regexp_extract_all(lower(lines[i]), '[^\x20\x09-\x0D]+') AS words FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM w JOIN t USING (doc_id))),
    left_over AS (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS text FROM piece p
        WHERE NOT EXISTS (SELECT 1 FROM common c WHERE c.source IS NOT DISTINCT FROM p.source AND c.words = p.words) GROUP BY doc_id)
    SELECT doc_id, n_words, n_boilerplate_words, base_failed, sha256(coalesce(l.text, '')) AS text_sha256, NOT base_failed AND NOT (n_boilerplate_words > 0
        AND (n_words - n_boilerplate_words < 20 OR n_words - n_boilerplate_words < 0.2 * n_words)) AS kept
    FROM f LEFT JOIN left_over l USING (doc_id)""")
def quality_rules_clean_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts without boilerplate lines, and the verdict on what is left of them."""
    out = clean_texts(table(spark, folder, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_boilerplate_words", "base_failed", digest.alias("text_sha256"), "kept")


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    weights = fit(documents, table(spark, folder, "labels"), remainder != 2)
    rows = documents.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "text")
    return score(rows, weights).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op8_warc", r"""
    WITH t AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
    r AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM t)
    SELECT page_id, n AS payload_bytes, digest AS payload_digest,
        CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to FROM r""")
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    back = round_trip(table(spark, folder, "pages"))
    return back.select(
        F.col("page").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_to").cast("bigint").alias("refers_to"))


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), Jaccard(words=4, percent=85))


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_repeats(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_phrase_collocations", r"""
    WITH t AS (
        SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
            string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
    p AS (SELECT lang, regexp_extract_all(unnest(pieces), '[^\x20\x09]+') AS words FROM t),
    total AS (SELECT lang, sum(len(words)) AS n FROM p GROUP BY lang),
    sizes AS (SELECT unnest(range(1, 6)) AS size),
    grams AS (SELECT lang, size, words[i:i + size - 1] AS words FROM (SELECT lang, size, words, unnest(range(1, len(words) - size + 2)) AS i FROM p, sizes)),
    f AS (SELECT lang, size, words, array_to_string(words, ' ') AS phrase, count(*) AS a FROM grams GROUP BY lang, size, words HAVING count(*) >= 100),
    inside AS (
        SELECT f.lang, list_slice(words, i, i + k - 1) AS words, max(a) AS longer FROM f, (SELECT unnest(range(2, 5)) AS k) ks, (SELECT unnest(range(1, 5)) AS i) starts
        WHERE k < size AND i + k - 1 <= size GROUP BY ALL),
    cuts AS (
        SELECT f.lang, f.phrase, f.a, k, x.a AS l, y.a AS r, n, (1000 * f.a::HUGEINT * n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS score
        FROM f JOIN (SELECT unnest(range(1, 5)) AS k) ks ON k < f.size JOIN f x ON x.lang = f.lang AND x.words = f.words[:k]
        JOIN f y ON y.lang = f.lang AND y.words = f.words[k + 1:] JOIN total ON total.lang = f.lang
        LEFT JOIN inside ON inside.lang = f.lang AND inside.words = f.words WHERE longer IS NULL OR 100 * longer < 100 * f.a),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
    SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase))::INTEGER AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
    FROM best QUALIFY rank <= 2000""")
def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


def _factor_levels(levels: int) -> str:
    """SQL of the dictionary of basic factors: names of 1, 2, 4, ... words from the names of half as many, only those that occur twice or more."""
    out = ["""f0 AS (SELECT doc_id, i, hash(words[i + 1]) AS name FROM (SELECT doc_id, words, unnest(range(len(words))) AS i FROM planted))"""]
    for k in range(levels):
        out.append(f"""k{k} AS MATERIALIZED (SELECT * FROM f{k} QUALIFY count(*) OVER (PARTITION BY doc_id, name) > 1)""")
        out.append(f"""f{k + 1} AS (SELECT a.doc_id, a.i, hash(a.name, b.name) AS name FROM k{k} a JOIN k{k} b ON a.doc_id = b.doc_id AND b.i = a.i + {1 << k})""")
    near = " UNION ALL ".join(
        f"""SELECT doc_id, i, next - i AS period, {1 << k} AS size FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id, name ORDER BY i) AS next FROM k{k})
        WHERE next - i <= {1 << k} AND 2 * (next - i) > {1 << k}""" for k in range(levels))
    return ", ".join(out) + f", near AS ({near})"


@query("op13_period_runs", rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    bits AS (  -- crc32 by table: 256 remainders, folded over the digits of the id
        SELECT b, list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM (SELECT unnest(range(256)) AS b)),
    crc AS (SELECT list(v ORDER BY b) AS t FROM bits),
    h AS (
        SELECT doc_id, words, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
            lambda r, c: xor(r // 256, t[xor(r % 256, c) + 1])), 4294967295) AS h FROM w, crc),
    g AS (SELECT *, len(words) AS n, CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a, 3 + (h // 10) % 8 AS parts FROM h),
    planted AS (
        SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: words[CASE WHEN i < a THEN i + 1 ELSE a + (i - a) % (1 + (n - a) // parts) + 1 END])
            ELSE words END AS words FROM g),
    {_factor_levels(15)},
    run AS (
        SELECT doc_id, min(i) AS start, max(i) - min(i) + period + size AS length, period
        FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS stretch FROM near) GROUP BY doc_id, period, size, stretch
        HAVING max(i) - min(i) + period + size >= greatest(24, 3 * period)),
    best AS (
        SELECT a.doc_id, a.start, a.length, a.period FROM run a
        WHERE NOT EXISTS (SELECT 1 FROM run b WHERE b.doc_id = a.doc_id AND (b.length * a.period > a.length * b.period
            OR b.length * a.period = a.length * b.period AND (b.start, b.period) < (a.start, a.period)))),
    listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM run GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
    dropped AS (SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id)
    SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
        sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda x, k: NOT list_contains(places, k - 1)) END, ' ')) AS collapsed_sha256
    FROM planted p LEFT JOIN listed USING (doc_id) LEFT JOIN best b USING (doc_id) LEFT JOIN dropped USING (doc_id)""")
def op13_period_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = documents.select("doc_id", "text", (h % 10 == 0).alias("plant"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("plant"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = rows.withColumn("words", words).withColumn("n", F.size("words"))
    a = F.col("g") % F.nullif("n", F.lit(0))
    rows = rows.withColumn("a", a.cast("int")).withColumn("parts", (3 + F.col("g") % 8).cast("int"))
    root = F.slice("words", F.col("a") + 1, 1 + F.floor((F.col("n") - F.col("a")) / F.col("parts")).cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(root, F.col("parts"))), F.lit(1), F.col("n") - F.col("a"))  # `parts` roots are longer than the rest
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    rows = rows.select("doc_id", F.when(F.col("plant") & (F.col("n") > 0), planted).otherwise(F.col("text")).alias("text"))
    found = find_runs(rows)
    best = F.expr("aggregate(runs, get(runs, 0), (best, x) -> if(x.length * best.period > best.length * x.period, x, best))")
    line = F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_topk_search", """
    WITH v AS (
        SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS parts FROM embeddings
        WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), false)),
    scored AS (
        SELECT q.place, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.parts, c.parts), lambda x: x[1] * x[2])), 0)::BIGINT AS score
        FROM v q JOIN v c ON q.place <> c.place WHERE q.vec_id % 100 = 0)
    SELECT query_id, (row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank, vec_id, score
    FROM scored QUALIFY rank <= 10""")
def op12_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)

"""The queries of this subpackage, with the columns their contracts ask for, and the SQL for those that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, core, decontam, digest, fim, jaccard, langid, lm, packing, phrases, pii, store
from . import lines as line_templates


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(core.documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = core.documents(spark, sf_dir)
    held = core.held(F.col("doc_id"), 3, 1)
    model = langid.train(docs.filter(~held))
    return langid.predict(docs.withColumn("held_out", held).select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(core.documents(spark, sf_dir))


def op4_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(core.documents(spark, sf_dir).select("doc_id", "text"))
    base = F.concat(*(pii.spans_text(F.col("pii")[k], k) for k in pii.KINDS))
    every = []
    for i, k in enumerate(pii.KINDS):
        added = F.filter(F.col("pii")["added"], _is_kind(i))
        both = F.array_sort(F.concat(F.transform(F.col("pii")[k], _span), F.transform(added, _span)))
        every.append(pii.spans_text(both, k))
    every.append(pii.spans_text(F.filter(F.col("pii")["added"], _is_kind(len(pii.KINDS))), pii.ALL[-1]))
    return found.select(
        "doc_id", *(F.size(F.col("pii")[k]).cast("long").alias(f"n_{k}") for k in pii.KINDS), F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(*every), ",").alias("spans"),
        F.size(F.filter(F.col("pii")["added"], _is_kind(len(pii.KINDS)))).cast("long").alias("n_secret"),
        (sum(F.size(F.col("pii")[k]) for k in pii.KINDS) + F.size(F.col("pii")["added"])).cast("long").alias("n_found"),
    )


def _is_kind(i: int):
    return lambda x: x["k"] == i


def _span(x):
    return F.struct(x["s"].alias("s"), x["e"].alias("e"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = core.new_path(spark, "store")
    store.write_store(core.documents(spark, sf_dir), path)
    return store.read_index(spark, path)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = core.documents(spark, sf_dir)
    held = core.held(F.col("doc_id"), 7, 2)
    model, parts = lm.train(docs.filter(~held))
    out = lm.score(docs, model, parts, learned=~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "seen_elsewhere")


def op7_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(core.documents(spark, sf_dir))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, and the SHA-256 of the text that is left."""
    done = line_templates.drop_lines(core.documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op9_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = chat.format_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return calls.select("conv_id", "turn", "call_id", "name", "level", "valid", "result_turn", "json")


def op10_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontam.decontaminate(core.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slack=2)
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near"
    )


def op11_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(core.documents(spark, sf_dir).select("doc_id", "text"))
    facts = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.ids_text(F.col("ids")).cast("binary"), 256).alias("ids_sha256"), "ids")
    return bpe.decode(facts).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(core.documents(spark, sf_dir))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fim.restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(core.documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_language_id, op3_best_fit_packing, op4_pii_boosting, op5_token_store,
        op6_lm_scoring, op7_quartile_digest, op8_line_templates, op9_tool_call_linking, op10_positional_decontamination,
        op11_bpe_transducer, op12_fill_in_middle, op13_phrase_mining,
    )
}

ORACLES = {
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
    CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, len(u) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS x, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS y FROM h),
p AS (SELECT *, array_to_string(u[1:x], '') AS pre, array_to_string(u[x + 1:y], '') AS mid, array_to_string(u[y + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
""",
    "op13_phrase_mining": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
t AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM t GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM t, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
x AS (SELECT lang, k, phrase, w, a, unnest(range(1, k)) AS cut FROM f WHERE k >= 2),
s AS (
  SELECT x.*, l.a AS l, r.a AS r, CAST(2000000::HUGEINT * x.a // (l.a + r.a) AS BIGINT) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda j: array_to_string(w[j:j + m - 1], ' '))))) AS phrase FROM f WHERE k >= 3),
o AS (SELECT lang, phrase, max(a) AS around FROM i GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.around IS NULL OR 100 * o.around < 80 * b.a
QUALIFY rank <= 2000
""",
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM w JOIN r ON r.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
""",
    "op9_tool_call_linking": r"""
WITH u AS (
  SELECT conv_id, turn, text, 'call_' || conv_id || '_' || turn AS call_id FROM conversations WHERE role = 'user'),
o AS (SELECT DISTINCT conv_id, turn FROM u WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
i AS (SELECT conv_id, turn, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM o),
l AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS INTEGER) AS level FROM i),
r AS (
  SELECT conv_id, 'call_' || conv_id || '_' || (turn - 1) AS call_id, min(turn) AS result_turn, arg_min(coalesce(text, ''), turn) AS content
  FROM conversations WHERE role = 'assistant' GROUP BY 1, 2)
SELECT u.conv_id, u.turn, u.call_id, 'reply' AS name, coalesce(l.level, 0) AS level, u.text IS NOT NULL AS valid, r.result_turn,
  '{"arguments":{' || CASE WHEN u.text IS NULL THEN '' ELSE '"prompt":' || to_json(u.text)::VARCHAR || ',' END || '"turn":' || u.turn
  || '},"conversation":' || u.conv_id || ',"id":"' || u.call_id || '","level":' || coalesce(l.level, 0) || ',"name":"reply"'
  || CASE WHEN r.call_id IS NULL THEN '' ELSE ',"result":{"text":' || to_json(r.content)::VARCHAR || '},"result_turn":' || r.result_turn END
  || ',"turn":' || u.turn || ',"valid":' || CASE WHEN u.text IS NULL THEN 'false' ELSE 'true' END || '}' AS json
FROM u LEFT JOIN r ON u.conv_id = r.conv_id AND u.call_id = r.call_id LEFT JOIN l ON u.conv_id = l.conv_id AND u.turn = l.turn
""",
}

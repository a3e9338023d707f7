"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larder.llm import alignment, chat, decontam, line_dedup, mixing, ngram_join, packing, phrases, quality, rules, secret_scan, substring_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


@query("op1_secret_scan")
def op1(spark, d):
    return secret_scan.secret_scan(table(spark, d, "documents"))


@query("op2_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
dup AS (SELECT doc_id, i FROM win QUALIFY doc_id > min(doc_id) OVER (PARTITION BY w)),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM dup)),
spans AS (SELECT doc_id, p, p - lag(p, 1, -9) OVER (PARTITION BY doc_id ORDER BY p) > 1 AS opens FROM gone),
g AS (SELECT doc_id, list(p) AS ps, count(*) FILTER (WHERE opens) AS n_factors FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ')
         ELSE coalesce(array_to_string(list_filter(ws, lambda x, k: NOT list_contains(ps, k)), ' '), '') END) AS kept_sha256,
  CAST(coalesce(n_factors, 0) AS BIGINT) AS n_factors
FROM d LEFT JOIN g USING (doc_id)""")
def op2(spark, d):
    return substring_dedup.substring_dedup(table(spark, d, "documents"))


@query("op3_ngram_jaccard_join", r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.b FROM reach r JOIN e ON e.a = r.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)""")
def op3(spark, d):
    return ngram_join.jaccard_join(table(spark, d, "documents"))


@query("op4_quality_classifier")
def op4(spark, d):
    return quality.quality(table(spark, d, "documents"), table(spark, d, "labels"))


@query("op6_line_dedup")
def op6(spark, d):
    return line_dedup.line_dedup(table(spark, d, "documents"))


@query("op8_toxicity")
def op8(spark, d):
    """Labels are learnt only from rows whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, d, "documents")
    fold = "crc32(cast(doc_id as string)) % 5"
    model = toxicity.train(docs, table(spark, d, "labels"), f"{fold} <> 0")
    return toxicity.score(docs, model).selectExpr("doc_id", f"{fold} = 0 AS held_out", "score", "predicted",
                                                  "lang_threshold", "flagged")


@query("op5_chat_format", r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '(<)(/?s>)|(\[)(/?(?:INST|ROLE)\])', '\1\3\\\2\4', 'g') AS body,
         regexp_replace(replace(role, '\', '\\'), '(<)(/?s>)|(\[)(/?(?:INST|ROLE)\])', '\1\3\\\2\4', 'g') AS shown FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(3 + sum(length(body) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 15 + length(shown) END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op5(spark, d):
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chat(rows)).drop("n_tokens", "n_loss_tokens")


@query("op7_decontamination", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
           FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS win, least(len(ws), 13) AS n
       FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 11, 2))) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op7(spark, d):
    return decontam.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op9_quality_rules", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper
      FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
        + 8 * (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)::INT + 16 * (word_chars < 2 * n_words)::INT
        + 32 * (word_chars > 15 * n_words)::INT + 64 * (10 * n_upper > 5 * word_chars)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
  fail_bits = 0 AS kept, fail_bits, n_lines, n_upper FROM f""")
def op9(spark, d):
    return rules.quality_rules(table(spark, d, "documents"))


_RULE_ROWS = ", ".join(f"('{v}', '{r}', {rules.mask_of((r,))}, {rules.mask_of(names)})" for v, names in rules.POLICIES.items() for r in names)


@query("quality_rule_ablation", f"""
WITH q AS ({ORACLES["op9_quality_rules"]}),
r(policy, rule, bit, mask) AS (VALUES {_RULE_ROWS})
SELECT policy, rule, count(*) FILTER ((fail_bits & bit) <> 0) AS n_failed, count(*) FILTER ((fail_bits & mask) = bit) AS n_only_this,
  count(*) FILTER ((fail_bits & mask) = 0) AS n_kept, count(*) FILTER ((fail_bits & mask) IN (0, bit)) AS n_kept_without
FROM q, r GROUP BY policy, rule""")
def quality_rule_ablation(spark, d):
    """Operator 9's ledger under every policy version: what each rule costs, by bitwise aggregation."""
    return rules.ablations(rules.ledger(table(spark, d, "documents")))


@query("op10_mixing")
def op10(spark, d):
    docs = table(spark, d, "documents")
    return mixing.mix(docs, mixing.language_domains(docs, table(spark, d, "labels")), mixing.TARGETS)


@query("op11_packing")
def op11(spark, d):
    return packing.packed_digests(packing.pack(table(spark, d, "documents")))


@query("op13_cross_tokenizer_alignment")
def op13(spark, d):
    return alignment.cross_tokenizer_alignment(table(spark, d, "documents"))


@query("op12_phrase_collocations", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(ws) >= m) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE m >= 2 AND f >= 100),
inner_ AS (SELECT DISTINCT c.lang, array_to_string(c.ws[i:i + k - 1], ' ') AS phrase, c.a AS longer
           FROM (SELECT *, unnest(range(1, m - k + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS k FROM c)) c),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inner_ x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.longer >= 100 * c.a)),
cuts AS (SELECT *, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:m], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, gl.f AS l, gr.f AS r, n.n,
        (1000::HUGEINT * cuts.a::HUGEINT * n.n::HUGEINT) // (gl.f::HUGEINT * gr.f::HUGEINT) AS score
      FROM cuts JOIN g gl ON gl.lang = cuts.lang AND gl.phrase = lp AND gl.m = k JOIN g gr ON gr.lang = cuts.lang AND gr.phrase = rp AND gr.m = cuts.m - k
      JOIN n ON n.lang = cuts.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000""")
def op12(spark, d):
    return phrases.collocations(table(spark, d, "documents"))

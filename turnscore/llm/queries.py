"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnscore.llm.common import read_table
from turnscore.llm.decontamination import leaks
from turnscore.llm.exact_dedup import exact_dedup
from turnscore.llm import toxicity
from turnscore.llm.licenses import scan_licenses
from turnscore.llm.line_dedup import dedup_lines
from turnscore.llm.merkle import verified_manifest
from turnscore.llm.ngram_join import similar_groups
from turnscore.llm.packing import pack
from turnscore.llm.phrases import collocations
from turnscore.llm.registry import query
from turnscore.llm.simhash import near_groups
from turnscore.llm.suffix_dedup import remove_repeats
from turnscore.llm.surrogates import replace_entities
from turnscore.llm.tool_calls import TOOLS, link_tool_calls

SQL_EXACT = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)"""


@query("op3_exact_dedup", SQL_EXACT)
def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_best_fit_packing")
def op5_best_fit_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


@query("op10_suffix_dedup")
def op10_suffix_dedup(spark, sf_dir):
    return remove_repeats(read_table(spark, sf_dir, "documents"))


@query("op9_ngram_join")
def op9_ngram_join(spark, sf_dir):
    return similar_groups(read_table(spark, sf_dir, "documents"))


@query("op7_decontamination")
def op7_decontamination(spark, sf_dir):
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("text_hash")


#: A line is a later copy if long and seen before, or inside two lines of over 50 words or three lines seen before.
SQL_LINES = r"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, x, i, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w
          FROM (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS i FROM parts) AS t),
seqs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq FROM lines
         WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
next AS (SELECT *, lead(x, 1) OVER d AS y, lead(x, 2) OVER d AS z, w + lead(w, 1) OVER d AS w2 FROM seqs WINDOW d AS (PARTITION BY doc_id ORDER BY seq)),
marks AS (SELECT *, (length(x) >= 200 OR w > 50) AND row_number() OVER (PARTITION BY x ORDER BY doc_id, seq) > 1 AS alone,
          y IS NOT NULL AND w2 > 50 AND row_number() OVER (PARTITION BY x, y ORDER BY doc_id, seq) > 1 AS two,
          z IS NOT NULL AND row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, seq) > 1 AS begins FROM next),
gone AS (SELECT * FROM (SELECT *, alone OR bool_or(begins) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 2 PRECEDING
         AND CURRENT ROW) OR bool_or(two) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS g
         FROM marks) AS t WHERE g),
spans AS (SELECT doc_id, min(i) AS a, max(i) AS b, count(*) AS n
          FROM (SELECT *, seq - row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS island FROM gone) AS t
          GROUP BY doc_id, island),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS text FROM lines AS l
         WHERE NOT EXISTS (SELECT 1 FROM spans AS s WHERE s.doc_id = l.doc_id AND l.i BETWEEN s.a AND s.b) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(n) AS n, count(*) AS c FROM spans GROUP BY doc_id)
SELECT p.doc_id, CAST(len(p.a) AS BIGINT) AS n_lines, CAST(coalesce(s.n, 0) AS BIGINT) AS n_deleted,
       CAST(coalesce(s.c, 0) AS BIGINT) AS n_spans, sha256(coalesce(k.text, '')) AS kept_sha256
FROM parts AS p LEFT JOIN sums AS s USING (doc_id) LEFT JOIN kept AS k USING (doc_id)"""


@query("op8_line_dedup", SQL_LINES)
def op8_line_dedup(spark, sf_dir):
    return dedup_lines(read_table(spark, sf_dir, "documents"), report=True)


@query("op1_license_scan")
def op1_license_scan(spark, sf_dir):
    return scan_licenses(read_table(spark, sf_dir, "documents"))


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


#: Tools of the calls that op6 derives from conversations: every user turn is a call, the
#: assistant's next turn its result; "lookup" is no known tool, "search" knows no chars,
#: and late turns give their number as text.
OP6_TOOLS = [("answer", [("question", "string", True), ("chars", "integer", True), ("turn", "integer", False)]),
             ("search", [("question", "string", True), ("turn", "integer", True)])]

SQL_CALLS = r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, 'c' || conv_id || '-' || turn AS id, CASE WHEN turn >= 2 THEN 'c' || conv_id || '-' || (turn - 2) END AS wanted,
         CASE turn % 5 WHEN 4 THEN 'lookup' WHEN 3 THEN 'search' ELSE 'answer' END AS name, turn >= 5 AS late, length(text) AS chars,
         text, turn FROM conversations WHERE role = 'user'),
results AS (SELECT conv_id, 'c' || conv_id || '-' || (turn - 1) AS id, text AS result FROM conversations WHERE role <> 'user'),
linked AS (SELECT c.*, p.id AS parent FROM calls AS c LEFT JOIN calls AS p ON p.conv_id = c.conv_id AND p.id = c.wanted),
ordered AS (SELECT conv_id, id, 0 AS depth FROM linked WHERE parent IS NULL
            UNION ALL SELECT l.conv_id, l.id, o.depth + 1 FROM linked AS l JOIN ordered AS o ON l.conv_id = o.conv_id AND l.parent = o.id),
both_sides AS (
  SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, coalesce(l.id, r.id) AS call_id, o.depth, l.name, l.wanted, l.parent, l.late, l.chars,
         l.text, l.turn, r.result, r.id IS NOT NULL AS has_result, l.id IS NOT NULL AS is_call
  FROM linked AS l JOIN ordered AS o USING (conv_id, id) FULL JOIN results AS r ON r.conv_id = l.conv_id AND r.id = l.id),
noted AS (
  SELECT *, concat_ws('; ', CASE WHEN name = 'search' THEN 'unknown chars' END, CASE WHEN wanted IS NOT NULL AND parent IS NULL THEN 'unknown parent' END,
                      CASE WHEN name = 'lookup' THEN 'unknown tool' END, CASE WHEN late AND name <> 'lookup' THEN 'wrong type turn' END) AS errors FROM both_sides)
SELECT conv_id, call_id, CAST(depth AS BIGINT) AS depth, name, errors,
  CASE WHEN NOT is_call THEN 'orphan_result' WHEN errors <> '' THEN 'invalid' WHEN NOT has_result THEN 'no_result' ELSE 'ok' END AS status,
  CASE WHEN is_call THEN '{"arguments":{"chars":' || chars || ',"question":' || to_json(text) || ',"turn":' ||
         CASE WHEN late THEN '"' || turn || '"' ELSE CAST(turn AS VARCHAR) END || '},"depth":' || depth || ',"id":"' || call_id || '","name":"' || name || '"'
         || coalesce(',"parent":"' || parent || '"', '') || coalesce(',"result":' || to_json(result), '') || ',"type":"tool_call"}'
       ELSE '{"id":"' || call_id || '","result":' || to_json(result) || ',"type":"tool_result"}' END AS message
FROM noted"""


@query("op6_tool_calls", SQL_CALLS)
def op6_tool_calls(spark, sf_dir):
    turns = read_table(spark, sf_dir, "conversations")
    name = F.expr("CASE turn % 5 WHEN 4 THEN 'lookup' WHEN 3 THEN 'search' ELSE 'answer' END")
    call_id = lambda back: F.format_string("c%d-%d", "conv_id", F.col("turn") - back)
    arguments = [F.to_json(F.struct(t.alias("turn"), F.col("text").alias("question"), F.length("text").alias("chars")))
                 for t in (F.col("turn"), F.col("turn").cast("string"))]
    calls = turns.where("role = 'user'").select(
        "conv_id", call_id(0).alias("call_id"), F.when(F.col("turn") >= 2, call_id(2)).alias("parent_id"), name.alias("name"),
        F.when(F.col("turn") >= 5, arguments[1]).otherwise(arguments[0]).alias("arguments"))
    results = turns.where("role <> 'user'").select("conv_id", call_id(1).alias("call_id"), F.col("text").alias("content"))
    return link_tool_calls(calls, results, spark.createDataFrame(OP6_TOOLS, TOOLS))


@query("op4_pii_surrogates")
def op4_pii_surrogates(spark, sf_dir):
    return replace_entities(read_table(spark, sf_dir, "documents"), key=b"op4 surrogate key")


#: crc32 bit by bit; the trees level by level; then every leaf's way up with its siblings.
SQL_MERKLE = r"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, sha256(concat(f(CAST(doc_id AS VARCHAR)), f(source), f(lang), f(CAST(n_chars AS VARCHAR)), f(text))) AS leaf,
         sha256(concat(f(CAST(doc_id AS VARCHAR)), f(source), f(lang), f(CAST(n_chars AS VARCHAR)),
                       f(CASE WHEN even THEN replace(text, chr(10), '') ELSE text END))) AS now
  FROM (SELECT *, coalesce(list_reduce(flatten([[ascii(c) + 256, 0, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
               lambda a, e: CASE WHEN e >= 256 THEN xor(a, e - 256) ELSE xor(a >> 1, (a & 1) * 3988292384) END, 4294967295) & 1 = 1, false) AS even
        FROM documents) AS d),
groups AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents) AS s),
placed AS (SELECT l.*, g.tree, row_number() OVER (PARTITION BY g.tree ORDER BY l.doc_id NULLS FIRST, l.leaf) - 1 AS pos,
                  count(*) OVER (PARTITION BY g.tree) AS n FROM leaves AS l JOIN groups AS g ON l.source IS NOT DISTINCT FROM g.source),
nodes AS (
  SELECT tree, 0 AS level, pos, n, leaf AS digest FROM placed
  UNION ALL SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes WHERE n > 1
  GROUP BY tree, level, pos // 3, n),
tops AS (
  SELECT 0 AS level, tree AS pos, count(*) OVER () AS n, digest FROM nodes WHERE n = 1
  UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3, n),
all_nodes AS (SELECT tree, level, pos, n, digest FROM nodes UNION ALL SELECT -1, level, pos, n, digest FROM tops),
up AS (
  SELECT doc_id, leaf, tree, tree AS own, 0 AS level, pos, n, '' AS proof, now AS acc FROM placed
  UNION ALL
  SELECT u.doc_id, u.leaf, CASE WHEN u.n = 1 THEN -1 ELSE u.tree END, u.own, CASE WHEN u.n = 1 THEN 0 ELSE u.level + 1 END,
         CASE WHEN u.n = 1 THEN u.own ELSE u.pos // 3 END, CASE WHEN u.n = 1 THEN (SELECT max(n) FROM tops) ELSE (u.n + 2) // 3 END,
         u.proof || CASE WHEN u.n = 1 THEN '' ELSE s.lft || s.rgt END, CASE WHEN u.n = 1 THEN u.acc ELSE sha256(s.lft || u.acc || s.rgt) END
  FROM up AS u LEFT JOIN (
    SELECT x.tree, x.level, x.pos, coalesce(string_agg(y.digest, '' ORDER BY y.pos) FILTER (WHERE y.pos < x.pos), '') AS lft,
           coalesce(string_agg(y.digest, '' ORDER BY y.pos) FILTER (WHERE y.pos > x.pos), '') AS rgt
    FROM all_nodes AS x JOIN all_nodes AS y ON x.tree = y.tree AND x.level = y.level AND x.pos // 3 = y.pos // 3
    GROUP BY x.tree, x.level, x.pos) AS s ON s.tree = u.tree AND s.level = u.level AND s.pos = u.pos
  WHERE u.n > 1 OR u.tree >= 0)
SELECT u.doc_id, u.leaf, s.digest AS subroot, t.digest AS root, sha256(u.proof) AS proof_sha256, u.acc AS folded_root, u.acc = t.digest AS verified
FROM up AS u JOIN nodes AS s ON s.tree = u.own AND s.n = 1 JOIN tops AS t ON t.n = 1 WHERE u.tree = -1 AND u.n = 1""".replace(
    "f(CAST(doc_id AS VARCHAR))", "coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')").replace(
    "f(CAST(n_chars AS VARCHAR))", "coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')").replace(
    "f(source)", "coalesce(strlen(source) || ':' || source, '-')").replace("f(lang)", "coalesce(strlen(lang) || ':' || lang, '-')").replace(
    "f(text)", "coalesce(strlen(text) || ':' || text, '-')").replace(
    "f(CASE WHEN even THEN replace(text, chr(10), '') ELSE text END)",
    "coalesce(strlen(CASE WHEN even THEN replace(text, chr(10), '') ELSE text END) || ':' || CASE WHEN even THEN replace(text, chr(10), '') ELSE text END, '-')")


@query("op11_merkle_manifest", SQL_MERKLE)
def op11_merkle_manifest(spark, sf_dir):
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return verified_manifest(read_table(spark, sf_dir, "documents"), {"text": text})


@query("op12_simhash_groups")
def op12_simhash_groups(spark, sf_dir):
    return near_groups(read_table(spark, sf_dir, "documents"))


SQL_PHRASES = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents) AS d),
words AS (SELECT lang, p, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM pieces),
runs AS (SELECT lang, x, lead(x, 1) OVER s AS y, lead(x, 2) OVER s AS z FROM words WINDOW s AS (PARTITION BY p ORDER BY i)),
total AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f1 AS (SELECT lang, x, count(*) AS f FROM runs GROUP BY lang, x),
f2 AS (SELECT lang, x, y, count(*) AS f FROM runs WHERE y IS NOT NULL GROUP BY lang, x, y),
f3 AS (SELECT lang, x, y, z, count(*) AS f FROM runs WHERE z IS NOT NULL GROUP BY lang, x, y, z HAVING count(*) >= 10),
held AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) AS t GROUP BY lang, x, y),
cuts AS (
  SELECT c.lang, c.x || ' ' || c.y AS phrase, c.f AS a, 1 AS k, u.f AS l, v.f AS r
  FROM f2 AS c JOIN f1 AS u ON u.lang = c.lang AND u.x = c.x JOIN f1 AS v ON v.lang = c.lang AND v.x = c.y
  LEFT JOIN held AS h ON h.lang = c.lang AND h.x = c.x AND h.y = c.y WHERE c.f >= 10 AND (h.f IS NULL OR 100 * h.f < 50 * c.f)
  UNION ALL
  SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 1, u.f, v.f
  FROM f3 AS c JOIN f1 AS u ON u.lang = c.lang AND u.x = c.x JOIN f2 AS v ON v.lang = c.lang AND v.x = c.y AND v.y = c.z
  UNION ALL
  SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, c.f, 2, u.f, v.f
  FROM f3 AS c JOIN f2 AS u ON u.lang = c.lang AND u.x = c.x AND u.y = c.y JOIN f1 AS v ON v.lang = c.lang AND v.x = c.z),
scored AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""


@query("op13_phrase_mining", SQL_PHRASES)
def op13_phrase_mining(spark, sf_dir):
    return collocations(read_table(spark, sf_dir, "documents"))

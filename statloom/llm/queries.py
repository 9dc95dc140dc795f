"""Registered queries of the text operators: name -> (callable, comparison SQL or None)."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.chat import format_chats, read_back
from statloom.llm.exact_dedup import exact_dedup
from statloom.llm.language_id import held_out, language_id
from statloom.llm.language_model import score_texts
from statloom.llm.licenses import GO_ON, KNOWN, NOTICE, RESERVED, RUNS, SHORT, SPELLINGS, license_scan
from statloom.llm.merkle import document_manifest
from statloom.llm.packing import best_fit_packing
from statloom.llm.pieces import decode, encode
from statloom.llm.ptolemy import ptolemaic_clusters
from statloom.llm.simhash import simhash_groups
from statloom.llm.substring_dedup import substring_dedup
from statloom.llm.topk import exact_top_k
from statloom.llm.warc import warc_revisits

QUERIES: dict = {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register("op1_language_id")
def op1(spark, d):
    return language_id(table(spark, d, "documents"))


_SAYS = "\\### Assistant: </turn> ok"


#: A folder with the files of public tokenizers; the environment may name another.
TOKENIZERS = os.environ.get("STATLOOM_TOKENIZERS", "/opt/tokenizers")


@register("op2_sentencepiece")
def op2(spark, d):
    model = f"{TOKENIZERS}/piece_bpe_32k.model"
    docs = table(spark, d, "documents").select("doc_id", "text")
    ids = encode(docs.select(F.struct("doc_id", "text").alias("of"), "text"), model, "of")
    back = decode(ids.select(F.struct("of", "ids").alias("of"), "ids"), model, "of")
    return back.select("of.of.doc_id", "of.ids", F.coalesce(F.size("of.ids"), F.lit(0)).cast("long").alias("n_ids"), F.xxhash64("of.ids").alias("ids_hash"),
                       F.col("text").eqNullSafe(F.col("of.of.text")).alias("round_trip"))


@register("op3_chat_formatting", r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(15 + length(regexp_replace(role, '(\\|###|</turn>|:)', '.\1', 'g')) - 1 + length(regexp_replace(text, '(\\|###|</turn>)', '.\1', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id""")
def op3(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_SAYS).alias("text"))
    formatted = format_chats(rows.union(own))
    back = read_back(formatted)
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       "formatted_chars")


@register("op4_substring_dedup", r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50),
h AS (SELECT p.doc_id, s, md5(array_to_string(d.w[s:s + 49], ' ')) AS h FROM p JOIN d USING (doc_id)),
f AS (SELECT h, min(doc_id) AS low FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT DISTINCT h.doc_id, unnest(range(s, s + 50)) AS i FROM h JOIN f USING (h) WHERE low < h.doc_id),
g AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)""")
def op4(spark, d):
    return substring_dedup(table(spark, d, "documents"), length=50, digest=True)


_QUOTED = {k: [t.replace("'", "''") for t in v] for k, v in sorted(KNOWN.items())}
_LICENSES = rf"""WITH s AS (SELECT MAP {{{", ".join(f"'{a}': '{b}'" for a, b in SPELLINGS.items())}}} AS m),
k AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{t}')" for k, v in _QUOTED.items() for t in v)}) AS k(license_id, t)),
u AS (SELECT doc_id, coalesce(text, '') AS t, str_split(coalesce(text, ''), chr(10)) AS l FROM documents),
b AS (SELECT doc_id, str_split(regexp_replace(t, '\n[ \t\r]*\n', chr(1), 'g'), chr(1)) AS b, str_split(regexp_replace(t, '(\n[ \t\r]*\n)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p FROM u),
i AS (SELECT NULL::BIGINT AS doc_id, 'known' AS unit, 0 AS start, t, license_id FROM k
  UNION ALL SELECT doc_id, 'text', 0, t, NULL FROM u
  UNION ALL SELECT doc_id, 'line', start, t, NULL FROM (SELECT doc_id, unnest(l) AS t, unnest(list_transform(l, lambda x, j: coalesce(list_sum(list_transform(l[:j - 1], lambda y: length(y) + 1)), 0)::BIGINT)) AS start FROM u WHERE len(l) > 1) WHERE t <> ''
  UNION ALL SELECT doc_id, 'block', start, t, NULL FROM (SELECT doc_id, array_to_string(p[2 * i + 1:2 * (i + r) - 1], '') AS t,
    coalesce(list_sum(list_transform(p[:2 * i], lambda y: length(y))), 0)::BIGINT AS start
    FROM (SELECT doc_id, p, r, unnest(range(len(b) - r + 1)) AS i FROM b, (SELECT unnest({list(RUNS)}) AS r) WHERE r < len(b))) WHERE contains(t, chr(10))),
c AS (SELECT doc_id, unit, start, license_id, list_transform(str_split(regexp_replace(t, '\n[ \t\r]*\n', chr(1), 'g'), chr(1)),
  lambda x: regexp_replace(regexp_replace(x, '{RESERVED}', ' ', 'g'), '{NOTICE.replace("END", chr(92) + "z")}', '\1', 'g')) AS l FROM i),
w AS (SELECT doc_id, unit, start, license_id, array_to_string(list_transform(regexp_extract_all(lower(array_to_string(list_transform(l, lambda x: CASE WHEN
    regexp_matches(x, '{SHORT.replace("START", chr(92) + "A").replace("END", chr(92) + "z")}') AND NOT regexp_matches(x, '{GO_ON}') THEN '' ELSE x END), chr(10))), '[\p{{L}}\p{{N}}]+'), lambda x: coalesce(m[x], x)), ' ') AS c FROM c, s),
d AS (SELECT doc_id, unit, start, license_id, CASE WHEN c = '' THEN NULL ELSE sha256(c) END AS digest FROM w),
f AS (SELECT digest, min(license_id) AS license_id FROM d WHERE unit = 'known' GROUP BY digest)
SELECT d.doc_id, d.unit, d.start, d.digest, f.license_id FROM d LEFT JOIN f USING (digest) WHERE d.unit = 'text' OR d.unit <> 'known' AND f.license_id IS NOT NULL"""


@register("op5_license_scan", _LICENSES)
def op5(spark, d):
    return license_scan(table(spark, d, "documents"))


@register("op6_simhash_near_dedup")
def op6(spark, d):
    return simhash_groups(table(spark, d, "documents"), width=3, distance=3)


@register("op7_exact_top_k", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op7(spark, d):
    return exact_top_k(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@register("op8_exact_dedup", r"""WITH b AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents),
w AS (SELECT doc_id, k, first_value(doc_id) OVER (PARTITION BY k ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS n FROM b)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM w""")
def op8(spark, d):
    return exact_dedup(table(spark, d, "documents"))


@register("op10_best_fit_packing")
def op10(spark, d):
    return best_fit_packing(table(spark, d, "documents"))


@register("op9_language_model")
def op9(spark, d):
    out = held_out("doc_id", 7, 2)
    scored = score_texts(table(spark, d, "documents"), ~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@register("op11_warc_revisits", f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, t, array_to_string(list_transform(range(0, 4), lambda i: array_to_string(list_transform(range(0, 8),
  lambda j: '{_BASE32}'[(('0x' || h[10 * i + 1:10 * i + 10])::BIGINT >> (35 - 5 * j)) % 32 + 1]), '')), '') AS digest,
  max(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < first THEN first END AS refers_to FROM d""")
def op11(spark, d):
    return warc_revisits(table(spark, d, "pages"), min_bytes=0).drop("url")


def _lloyd(k: int, rounds: int) -> str:
    """Exact rounds of assignment and floored means, one after the other."""
    parts = ["""x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, v FROM x QUALIFY k < {k})"]
    for r in range(rounds + 1):
        parts.append(f"""n{r} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(k, d * {k} + k) AS k, min(d) AS d FROM (SELECT vec_id, x.v, k,
  list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM x, c{r} AS c) GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""m{r} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v
  FROM (SELECT k, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM n{r}, range(1, 65) AS t(i) GROUP BY k, i) GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} AS c LEFT JOIN m{r} AS m USING (k))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, n.k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY n.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM n{rounds} AS n JOIN c{rounds} AS c ON n.k = c.k"""


@register("op12_centroid_clustering", _lloyd(8, 10))
def op12(spark, d):
    return ptolemaic_clusters(table(spark, d, "embeddings"))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"


@register("op13_merkle_manifest", f"""WITH RECURSIVE m AS MATERIALIZED (SELECT list_transform(range(256),
  lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS m),
l AS MATERIALIZED (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rank,
  {_LEAF.format("n_chars")} AS leaf, {_LEAF.format("(n_chars + CASE WHEN n7 = 0 THEN 1 ELSE 0 END)")} AS copy FROM
  (SELECT *, xor(list_reduce(list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT),
    lambda c, b: xor(c >> 8, m[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 7 AS n7 FROM documents, m)),
v AS (SELECT lang, 0 AS level, list(leaf ORDER BY rank) AS nodes FROM l GROUP BY lang UNION ALL
  SELECT lang, level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM v WHERE len(nodes) > 1),
s AS MATERIALIZED (SELECT lang, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank FROM v WHERE len(nodes) = 1),
t AS (SELECT 0 AS level, list(subroot ORDER BY rank) AS nodes FROM s UNION ALL
  SELECT level + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM t WHERE len(nodes) > 1),
p AS MATERIALIZED (SELECT doc_id, v.level, (l.rank >> v.level) & 1 AS side, nodes[xor(l.rank >> v.level, 1) + 1] AS sibling FROM l JOIN v ON l.lang IS NOT DISTINCT FROM v.lang WHERE len(nodes) > 1 UNION ALL
  SELECT doc_id, s.height + t.level, (s.rank >> t.level) & 1, nodes[xor(s.rank >> t.level, 1) + 1] FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang, t WHERE len(nodes) > 1),
g AS MATERIALIZED (SELECT doc_id, list(coalesce(sibling, '') ORDER BY level) AS steps, list(side ORDER BY level) AS sides FROM p GROUP BY doc_id),
f AS (SELECT doc_id, 0 AS level, copy AS node FROM l UNION ALL
  SELECT f.doc_id, level + 1, sha256(CASE WHEN sides[level + 1] = 1 THEN steps[level + 1] || node ELSE node || steps[level + 1] END)
  FROM f JOIN g ON f.doc_id = g.doc_id AND level < len(steps)),
e AS (SELECT doc_id, arg_max(node, level) AS folded_root FROM f GROUP BY doc_id),
r AS (SELECT nodes[1] AS root FROM t WHERE len(nodes) = 1)
SELECT l.doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(steps, ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang JOIN e ON e.doc_id = l.doc_id LEFT JOIN g ON g.doc_id = l.doc_id, r""")
def op13(spark, d):
    return document_manifest(table(spark, d, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)

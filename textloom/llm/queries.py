"""One query for each training-data operator, over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import ann, jaccard, media, packing, pieces, pii, repair, resample, secret_scan, store, suffix, tokens, toxicity
from textloom.llm.common import documents, materialise


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pseudonym_key(spark: SparkSession) -> str:
    """The key of pseudonyms that the session names; one that is no secret for the synthetic tables."""
    return spark.conf.get("spark.textloom.pseudonym.key", "the synthetic tables")


def op1_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.fingerprints(materialise(media.to_wav(documents(spark, sf_dir)), "media"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read_store(spark, store.write_store(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json")))


def op5_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, quantiser = ann.build_index(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return ann.search(index, quantiser, index.where(F.col("vec_id") % 50 == 0).select("vec_id", "vector"), k=5)


def op6_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), pseudonym_key(spark), found_col="kinds")
    return found.select("doc_id", F.size("kinds").cast("long").alias("n_replaced"), F.array_join("kinds", ",").alias("kinds"), "text")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(documents(spark, sf_dir))


def op11_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("repository", F.concat_ws("/", "source", "lang"))  # an owner's texts of one language
    return secret_scan.digests(secret_scan.find_secrets(docs, "source", "repository"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audits(repair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The crc32 of a text `w` as DuckDB computes it, with a table `crc` of one row.
_CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n::UBIGINT] || [k::UBIGINT FOR k IN range(8)], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS tab)"
_BYTES = "list_transform(range(length(hex({0})) // 2), lambda i: (16 * (instr('0123456789ABCDEF', substr(hex({0}), 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hex({0}), 2 * i + 2, 1)) - 1)::UBIGINT)"
_CRC = "xor(list_reduce([4294967295::UBIGINT] || " + _BYTES + ", lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)"
#: Rules of secrets as they are stated: what is too short is found and dropped. Tokens are candidates only, without look-behind.
_RULES_SQL = ", ".join(f"({k}, '{kind}', '{p.replace(chr(39), chr(39) * 2)}', {g}, {least})" for k, (kind, p, g, least) in enumerate([("assign", *secret_scan.RULES["assign"]), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), ("token", secret_scan.TOKEN.split(")", 1)[1], 0, 16)]))


QUERIES = {f.__name__: f for f in (op1_media_fingerprints, op2_token_counts, op3_best_fit_packing, op4_token_store, op5_anisotropic_search, op6_sentencepiece_scan, op7_toxicity, op8_suffix_dedup, op9_pii_pseudonyms, op10_jaccard_join, op11_secret_owners, op12_conversation_repair, op13_importance_resampling)}
#: Only the join has SQL; the others need a library, a trained model, bytes or a keyed permutation,
#: and are held against brute force, exact round trips and held-out labels in tests/llm.
ORACLES: dict[str, str] = {
    "op10_jaccard_join": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS sh FROM w)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
  both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, b.b FROM reach r JOIN both_ways b ON b.a = r.c),
  part AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY 1), k AS (SELECT a AS doc_id, count(*) AS k FROM both_ways GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, p.component_id, coalesce(k.k, 0) AS n_links
FROM documents d JOIN part p USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op13_importance_resampling": f"""
WITH {_CRC_TABLE},
  d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents),
  t AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
  words AS (SELECT DISTINCT w FROM d UNION SELECT DISTINCT w FROM t),
  hashed AS (SELECT w, ({_CRC.format('w')} % 10000)::BIGINT AS bucket FROM words, crc),
  s AS (SELECT bucket, count(*) AS s FROM d JOIN hashed USING (w) GROUP BY 1), tt AS (SELECT bucket, count(*) AS t FROM t JOIN hashed USING (w) GROUP BY 1),
  n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM tt)::DOUBLE AS t_all),
  g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN tt USING (bucket), n),
  f AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM d JOIN hashed USING (w) JOIN g USING (bucket) GROUP BY 1),
  scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN f USING (doc_id)),
  placed AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank FROM placed""",
    "op12_conversation_repair": f"""
WITH RECURSIVE {_CRC_TABLE},
  c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
  way AS (SELECT k, {_CRC.format('k')} % 20 AS way FROM (SELECT DISTINCT k FROM c), crc),
  damaged AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE way WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM c JOIN way USING (k)),
  r AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen, substr(role, 1, 1) AS ch, substr(lag(role) OVER w, 1, 1) AS before, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last
    FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
  f AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM r),
  g(st, ch, nx) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
  ins(st, n, mid) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)),
  given AS (SELECT *, CASE WHEN n = 0 THEN []::VARCHAR[] WHEN st = 2 THEN ['assistant:', 'user:'][:n] ELSE ['user:', 'assistant:'][:n] END AS made FROM ins),
  arcs AS (SELECT given.st, given.n, given.mid, given.made, e.op, CASE given.mid WHEN 2 THEN 'assistant' ELSE 'user' END AS written FROM given, (VALUES ('K'), ('R'), ('D')) e(op)),
  paths(conv_id, i, st, best) AS (
    SELECT DISTINCT conv_id, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': '', 'parts': []::VARCHAR[]}} FROM conversations
    UNION ALL
    SELECT conv_id, i, st, min(best) FROM (
      SELECT p.conv_id, f.i, CASE a.op WHEN 'D' THEN a.mid WHEN 'K' THEN g.nx WHEN 'R' THEN CASE a.mid WHEN 2 THEN 3 ELSE 2 END END AS st,
        {{'cost': p.best.cost + 2 * a.n + CASE a.op WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN a.op <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': p.best.audit || repeat('I', a.n) || a.op,
          'parts': p.best.parts || a.made || CASE a.op WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [a.written || ':' || f.text] END}} AS best
      FROM paths p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN arcs a ON a.st = p.st LEFT JOIN g ON g.st = a.mid AND g.ch = f.ch
      WHERE a.op = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (a.op = 'R' OR g.nx IS NOT NULL))) GROUP BY ALL),
  n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || ch NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY 1),
  done AS (SELECT p.conv_id, min({{'cost': best.cost + 2 * given.n, 'audit': best.audit || repeat('I', given.n), 'parts': best.parts || given.made}}) AS best
    FROM paths p LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id JOIN given ON given.st = p.st AND given.mid IN (0, 3) WHERE p.i = coalesce(n.n, 0) GROUP BY 1)
SELECT done.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.cost AS cost, best.audit AS audit, sha256(array_to_string(best.parts, chr(10))) AS repaired_sha256 FROM done LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM done.conv_id""",
    "op11_secret_owners": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository, coalesce(text, '') AS text FROM documents),
  m AS (SELECT r, k, kind, regexp_extract_all(text, p, 0) AS hits, regexp_extract_all(text, p, g) AS vals, list_transform(regexp_split_to_array(text, p), lambda x: length(x)) AS gaps, least_ FROM d, (VALUES {_RULES_SQL}) p(k, kind, p, g, least_) WHERE regexp_matches(text, p)),
  f AS (SELECT r, k, kind, hit, val, least_, (list_sum(gaps[:i]) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0))::BIGINT AS a FROM (SELECT *, unnest(hits) AS hit, unnest(vals) AS val, generate_subscripts(hits, 1) AS i FROM m)),
  found AS (SELECT r, k, kind, a, a + length(hit) AS b, val FROM f WHERE length(val) >= least_),
  cand AS (SELECT DISTINCT r, b - length(val) AS a, b, val FROM found WHERE kind IN ('assign', 'token') AND len(regexp_extract_all(val, '{secret_scan.MIXED}')) >= {secret_scan.LEAST_MIXED} AND len(list_distinct(string_split(val, ''))) >= {secret_scan.LEAST_DISTINCT}),
  held AS (SELECT val, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM cand JOIN d USING (r) GROUP BY 1),
  told AS (SELECT r, a, b, owners > {secret_scan.MOST_OWNERS} OR repositories > {secret_scan.MOST_REPOSITORIES} AS copied FROM cand JOIN held USING (val)),
  spans AS (SELECT r, a, k, kind, b FROM found WHERE kind <> 'token' UNION ALL SELECT r, a, 3, 'live', b FROM told WHERE NOT copied),
  s AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'live') AS n_live,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) FILTER (kind <> 'live') AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) AS spans FROM spans GROUP BY 1),
  c AS (SELECT r, count(*) FILTER (copied) AS n_copied FROM told GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN s USING (r) LEFT JOIN c USING (r)""",
}

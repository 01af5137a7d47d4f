"""Queries of the text and cleaning rules that plain prose does not reach: the tables' texts with such cases put in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import fixed as X
from textloom.functions import text as T
from textloom.functions import titles
from textloom.operators import clean
from textloom.queries import _JUDGED, _REPEATED, _S, _alpha, query, table
from textloom.set_queries import letter_words
from textloom.sources import pages as P
from textloom.sources.shared import spread

_q = lambda p: p.replace("'", "''")

_WRAPPED = "replace(replace(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), '.', CASE WHEN doc_id % 2 = 0 THEN '' ELSE '.' END), ', ', chr(10))"
_APART = f"regexp_matches(x, '(?i){X.HEADING_PREFIX}') OR regexp_matches(a, '{_q(X.TABLE_OR_CODE)}') OR regexp_matches(x, '{_q(X.TABLE_OR_CODE)}') OR regexp_matches(x, '(?i){X.FIGURE_START}') OR regexp_matches(a, '{_q(X.SENTENCE_END)}')"


@query(f"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array({_WRAPPED}, '\\n\\s*\\n')) AS p, generate_subscripts(regexp_split_to_array({_WRAPPED}, '\\n\\s*\\n'), 1) AS i FROM documents),
  l AS (SELECT doc_id, i, list_filter(list_transform(string_split(p, chr(10)), lambda x: {_S.format('x')}), lambda x: x <> '') AS l FROM p),
  j AS (SELECT doc_id, i, list_reduce(l, lambda a, x: a || CASE WHEN {_APART} THEN chr(10) ELSE ' ' END || x) AS t FROM l WHERE len(l) > 0)
  SELECT d.doc_id, md5(CASE WHEN contains({_WRAPPED}, chr(10)) THEN coalesce(t, '') ELSE {_S.format(_WRAPPED)} END) AS h FROM documents d LEFT JOIN (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY i) AS t FROM j GROUP BY 1) USING (doc_id)""")
def line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a break at every comma and an empty line between their lines; even ones without full stops."""
    wrapped = F.expr("replace(replace(replace(text, '.\\n', '.\\n\\n'), '.', CASE WHEN doc_id % 2 = 0 THEN '' ELSE '.' END), ', ', '\\n')")
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.md5(T.fix_line_breaks(wrapped)).alias("h"))


@query("SELECT doc_id, md5(replace(text, '…', '...')) AS h FROM documents")
def compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with ligatures, wide digits and letters taken apart, made normal again."""
    odd = F.expr("replace(replace(translate(text, '0123456789', '０１２３４５６７８９'), 'fi', 'ﬁ'), 'é', 'é')")
    return T.nfkc(table(spark, sf_dir, "documents").select("doc_id", odd.alias("text")), "text").select("doc_id", F.md5("text").alias("h"))


_OPTIONED = "CASE turn % 4 WHEN 0 THEN text || ' A. one B. two C) three' WHEN 1 THEN text || ' (a) one (b) two Answer: B' WHEN 2 THEN 'Pick A. one B. two C. three' ELSE text END"
_MARK = X.OPTION_MARKER
#: Without look-ahead: what stands behind an answer's letter is taken in.
_ANSWER = r"\b(?:(?:correct\s+)?answer|ans)\s*[:=]?\s*[A-Ea-e](?:[\s.,;)]|$)"


@query(f"""WITH o AS (SELECT conv_id, turn, {_OPTIONED} AS t FROM conversations), m AS (SELECT *, len(regexp_extract_all(t, '{_MARK}')) AS n, regexp_matches(t, '(?i){_ANSWER}') AS said, length(regexp_split_to_array(t, '{_MARK}')[1]) AS first_at, length(regexp_split_to_array(t, '(?i){_ANSWER}')[1]) AS answer_at FROM o),
  b AS (SELECT *, n >= 3 OR (n = 2 AND said) AS block, {_S.format("substr(t, 1, CASE WHEN said THEN least(first_at, answer_at) ELSE first_at END)")} AS lead FROM m)
  SELECT conv_id, turn, block, md5(CASE WHEN NOT block THEN t WHEN {_alpha('lead')} >= 3 AND regexp_matches(lead, '{_q(X.SENTENCE_END)}') THEN lead ELSE '' END) AS h FROM b""")
def answer_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with options put behind them, three or two with an answer, with prose in front or none."""
    said = F.expr(_OPTIONED)
    lead, block = T.strip_options(F.col("t"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("t")).select("conv_id", "turn", block.alias("block"), F.md5(lead).alias("h"))


_PLAIN = "list_filter(string_split(lower(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '')"
_TITLE = "CASE doc_id % 3 WHEN 0 THEN replace(upper(array_to_string(w[3:5], ' - ')), 'ẞ', 'SS') WHEN 1 THEN array_to_string(w[3:5], ', ') ELSE array_to_string(list_reverse(w[3:5]), ' ') END"


@query(f"""WITH d AS (SELECT doc_id, text, list_filter(string_split(regexp_replace(text, '[^\\p{{L}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents), k AS (SELECT doc_id, array_to_string({_PLAIN.format(_TITLE)}, ' ') AS key, array_to_string({_PLAIN.format('text')}, ' ') AS hay FROM d)
  SELECT doc_id, key <> '' AND contains(' ' || hay || ' ', ' ' || key || ' ') AS found FROM k""")
def title_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third to fifth words of every document as its title: in capitals, with marks between, or turned around."""
    w = F.slice(letter_words(F.col("text")), 3, 3)
    title = F.when(F.col("doc_id") % 3 == 0, F.upper(F.array_join(w, " - "))).when(F.col("doc_id") % 3 == 1, F.array_join(w, ", ")).otherwise(F.array_join(F.reverse(w), " "))
    return table(spark, sf_dir, "documents").select("doc_id", titles.appears_in(title, F.col("text")).alias("found"))


_ADDED = ["Which is it? A. red B. blue C. green", "� bad word", "It was so. 12 Later they left", "��", "Many words stand here and one is bro�ken", "see http://a.example/x"]
_MARKED_ITEMS = f"""items AS (SELECT source AS document_id, doc_id AS page_idx, i - 1 AS item_idx, {_S.format('t')} AS raw FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM (SELECT source, doc_id, text || chr(10) || 'Line ' || doc_id || chr(10) || ([{', '.join("'" + _q(a) + "'" for a in _ADDED)}])[doc_id % {len(_ADDED)} + 1] AS text FROM documents)))"""
_BASE = _JUDGED.split("judged AS")[0]


@query(f"""WITH {_MARKED_ITEMS}, {_REPEATED}, {_BASE} c AS (SELECT *, {{category}} AS category FROM keyed),
  b AS (SELECT *, len(regexp_extract_all(base, '{_MARK}')) >= 3 OR (len(regexp_extract_all(base, '{_MARK}')) = 2 AND regexp_matches(base, '(?i){_ANSWER}')) AS options, {_S.format("regexp_replace(regexp_replace(translate(base, chr(65533), ''), '(?i)https?://[^\\s]+|www\\.[^\\s]+', ' ', 'g'), '  +', ' ', 'g')")} AS bare, contains(base, chr(65533)) AS broken FROM c),
  n AS (SELECT *, regexp_replace(bare, '([.!?)"''])\\s+\\d{{{{1,3}}}}\\s+([A-Z][a-z])', '\\1 \\2', 'g') AS noted FROM b),
  j AS (SELECT *, CASE WHEN category IS NOT NULL THEN category WHEN options THEN 'mcq' WHEN bare = '' THEN 'empty' WHEN broken AND {_alpha('bare')} < {X.OCR_WORDS} THEN 'ocr_garbage' WHEN noted = '' THEN 'empty' END AS judged FROM n)
  SELECT document_id, page_idx, CAST(item_idx AS INTEGER) AS item_idx, judged AS category, md5(noted) AS h FROM j""".replace("{category}", _JUDGED.split("judged AS (SELECT *, ")[1].split(" AS category,")[0]).replace("{{", "{").replace("}}", "}"))  # fmt: skip
def judged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents, each with one line behind that holds options, broken characters, a note or an address."""
    added = F.element_at(F.array(*map(F.lit, _ADDED)), (F.col("doc_id") % len(_ADDED) + 1).cast("int"))
    docs = spread(table(spark, sf_dir, "documents")).withColumn("text", F.concat_ws("\n", "text", F.concat(F.lit("Line "), F.col("doc_id").cast("string")), added))
    return clean.judged_items(P.line_pages(docs)).select("document_id", "page_idx", "item_idx", "category", F.md5("text").alias("h"))

"""DuckDB SQL that gives the rows of the queries, written apart from them."""

from __future__ import annotations

from ..operators.cleanup import META_PREFIXES
from ..operators.glossary import COMMON_WORDS
from .fixtures import NOISY_SQL, STRUCTURED_SQL

_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS i FROM"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_WORDS = r"len(list_filter(string_split_regex({0}, '\s+'), lambda x: x <> ''))"
_COUNT = "len(regexp_extract_all({0}, '{1}'))"


def trim(x: str) -> str:
    return _TRIM.format(x)


def words(x: str) -> str:
    return f"cast({_WORDS.format(x)} AS BIGINT)"


def count(x: str, pattern: str) -> str:
    return f"cast(len(regexp_extract_all({x}, '{pattern}')) AS BIGINT)"


def paras(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10) || chr(10)), lambda p: {trim('p')}), lambda p: p <> '')"


_HEAD = r"^(#{1,6})\s+(.+)$"
#: chapters: doc_id, g, chapter_idx, chapter, section, text, heading_level
_CHAPTERS = rf"""{STRUCTURED_SQL},
l AS ({_LINES} structured),
h AS (SELECT doc_id, i, s, length(regexp_extract(s, '{_HEAD}', 1)) AS level, {trim(f"regexp_extract(s, '{_HEAD}', 2)")} AS title FROM l),
g AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM h),
b AS (SELECT doc_id, g, max(level) AS level, max(CASE WHEN level > 0 THEN title END) AS title,
  {trim("coalesce(string_agg(CASE WHEN level = 0 THEN s END, chr(10) ORDER BY i), '')")} AS text FROM g GROUP BY doc_id, g),
t AS (SELECT *, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM b),
chapters AS (SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS INT) AS chapter_idx, coalesce(top, title) AS chapter,
  CASE WHEN level > 1 THEN title ELSE '' END AS section, text, cast(level AS INT) AS heading_level FROM t WHERE text <> '' AND g > 0)"""
_SEGMENTS = rf"""{_CHAPTERS},
sl AS (SELECT doc_id, chapter_idx, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS i FROM chapters),
sm AS (SELECT *, {trim("s")} AS t, CASE WHEN regexp_matches({trim("s")}, '^\d+[\.\)]\s') THEN 'numbered' WHEN regexp_matches({trim("s")}, '^[-*•]\s') THEN 'bullet' WHEN regexp_matches({trim("s")}, '^#{{1,6}}\s+') THEN 'heading' END AS m FROM sl),
sn AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id, chapter_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lm FROM sm),
se AS (SELECT *, CASE WHEN t <> '' THEN coalesce(m, CASE WHEN lm IN ('numbered', 'bullet') THEN lm ELSE 'prose' END) END AS eff FROM sn),
sp AS (SELECT *, last_value(eff IGNORE NULLS) OVER (PARTITION BY doc_id, chapter_idx ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM se),
sg AS (SELECT *, sum(CASE WHEN eff IS NOT NULL AND (prev IS NULL OR prev <> eff) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, chapter_idx ORDER BY i) AS g FROM sp),
segments AS (SELECT doc_id, chapter_idx, cast(g - 1 AS INT) AS seg_idx, max(eff) AS seg_type, {trim("string_agg(s, chr(10) ORDER BY i)")} AS text FROM sg WHERE g > 0 GROUP BY doc_id, chapter_idx, g)"""
_UNITS = rf"""{_SEGMENTS},
u0 AS (SELECT *, greatest(1, length(text) // 4) > 300 AS big FROM segments),
u1 AS (SELECT doc_id, chapter_idx, seg_idx, CASE WHEN big THEN seg_idx ELSE -1 END AS run,
  CASE WHEN big THEN list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda p: {trim("p")}), lambda p: p <> '') ELSE [text] END AS parts FROM u0),
u2 AS (SELECT doc_id, chapter_idx, seg_idx, run, unnest(parts) AS text, unnest(range(len(parts))) AS part FROM u1),
units AS (SELECT *, greatest(1, length(text) // 4) AS tokens, row_number() OVER (PARTITION BY doc_id, chapter_idx ORDER BY seg_idx, part) AS k FROM u2),
pack AS (
  SELECT doc_id, chapter_idx, k, run, text, tokens AS total, 0 AS chunk FROM units WHERE k = 1
  UNION ALL
  SELECT u.doc_id, u.chapter_idx, u.k, u.run, u.text,
    CASE WHEN p.run = u.run AND p.total + u.tokens <= 300 THEN p.total + u.tokens ELSE u.tokens END,
    CASE WHEN p.run = u.run AND p.total + u.tokens <= 300 THEN p.chunk ELSE p.chunk + 1 END
  FROM pack p JOIN units u ON u.doc_id = p.doc_id AND u.chapter_idx = p.chapter_idx AND u.k = p.k + 1),
packed AS (SELECT doc_id, chapter_idx, cast(chunk AS INT) AS chunk, max(run) AS run, string_agg(text, chr(10) || chr(10) ORDER BY k) AS raw FROM pack GROUP BY doc_id, chapter_idx, chunk)"""
_CHUNKS = rf"""{_UNITS},
c1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chapter_idx, chunk) - 1 AS chunk_id, lag(raw) OVER (PARTITION BY doc_id ORDER BY chapter_idx, chunk) AS tail,
  chunk = max(chunk) OVER (PARTITION BY doc_id, chapter_idx) AND run = -1 AS at_end FROM packed),
chunks AS (SELECT c1.doc_id, cast(chunk_id AS INT) AS chunk_id, chapter, section, chunk = 0 AS is_chapter_start,
  CASE WHEN tail IS NULL OR (chunk = 0 AND at_end) THEN raw ELSE right(tail, 80) || chr(10) || chr(10) || raw END AS text
  FROM c1 JOIN chapters USING (doc_id, chapter_idx))"""
_TABLE = r"^\s*\|.*\|\s*$|^\s*\S+\t\S+"
_REWRITTEN = f"""{STRUCTURED_SQL}, rl AS ({_LINES} structured), rw AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY i) AS result FROM rl WHERE i % 5 <> 4 GROUP BY doc_id),
pairs AS (SELECT structured.doc_id, structured.text AS original, result FROM structured JOIN rw USING (doc_id))"""
_META = " OR ".join(f"starts_with(lower({trim('p')}), '{x}')" for x in META_PREFIXES)

SQL = {
    "token_count": "SELECT doc_id, cast(greatest(1, length(text) // 4) AS BIGINT) AS n_tokens FROM documents",
    "word_count": f"SELECT doc_id, {words('text')} AS n_words FROM documents",
    "paragraph_count": f"WITH {STRUCTURED_SQL} SELECT doc_id, cast(len({paras('text')}) AS BIGINT) AS n_paragraphs FROM structured",
    "sentence_split": rf"SELECT doc_id, cast(len(regexp_extract_all(text, '[.!?]\s+')) + 1 AS BIGINT) AS n_sentences FROM documents",
    "table_profile": f"""WITH {NOISY_SQL}, l AS ({_LINES} noisy),
      p AS (SELECT doc_id, coalesce(100.0::DOUBLE * count(*) FILTER (regexp_matches(s, '{_TABLE}')) / nullif(count(*), 0), 0) AS table_percent FROM l WHERE regexp_matches(s, '\\S') GROUP BY doc_id)
      SELECT doc_id, table_percent, CASE WHEN table_percent > 25 THEN 'fail' WHEN table_percent > 15 THEN 'warn' ELSE 'pass' END AS verdict FROM p""",
    "non_latin_profile": rf"""WITH {NOISY_SQL}, p AS (SELECT doc_id, coalesce(100.0::DOUBLE * len(regexp_extract_all(regexp_replace(text, '[\x00-\x{{24F}}]', '', 'g'), '\pL')) / nullif(len(regexp_extract_all(text, '\pL')), 0), 0) AS non_latin_percent FROM noisy)
      SELECT doc_id, non_latin_percent, CASE WHEN non_latin_percent > 15 THEN 'fail' WHEN non_latin_percent > 5 THEN 'warn' ELSE 'pass' END AS verdict FROM p""",
    "page_check": f"""WITH l AS ({_LINES} documents), p AS (SELECT doc_id, count(*) AS n_pages, cast(sum(length(s)) AS BIGINT) AS n_chars, count(*) FILTER (i % 3 = 0 AND length(s) < 100) AS n FROM l GROUP BY doc_id)
      SELECT doc_id, n_pages, n_chars, n_chars / n_pages < 200 AS scanned, 100.0 * n / n_pages > 60 AS image_heavy, n_chars < 5000 AS too_short FROM p""",
    "glossary_top_terms": rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS term, unnest(range(len(regexp_extract_all(lower(text), '[\pL\pN_]+')))) AS pos FROM documents),
      c AS (SELECT doc_id, term, count(*) AS freq, min(pos) AS f FROM w WHERE regexp_matches(term, '^[a-z]{{4,}}$') AND term NOT IN ({", ".join(f"'{x}'" for x in COMMON_WORDS)}) GROUP BY ALL HAVING count(*) >= 3),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, f) AS rank FROM c)
      SELECT doc_id, cast(rank AS INT) AS rank, term, freq FROM r WHERE rank <= 30""",
    "definition_dedup": f"WITH l AS ({_LINES} documents) SELECT doc_id, left(s, 5) AS term, arg_min(s, i) AS definition FROM l GROUP BY ALL",
    "detect_chapters": f"WITH {_CHAPTERS} SELECT doc_id, chapter_idx, chapter, section, heading_level, md5(text) AS text_md5 FROM chapters",
    "extraction_validation": f"""WITH {_CHAPTERS} SELECT doc_id, count(*) AS n_chapters, cast(sum(length(text)) AS BIGINT) AS n_chars, cast(count(*) FILTER (length(text) < 100) AS BIGINT) AS n_short,
      cast(sum(len(regexp_extract_all(text, '<[^>]+>'))) AS BIGINT) AS n_tags, sum(len(regexp_extract_all(text, '<[^>]+>'))) = 0 AS is_ok FROM chapters GROUP BY doc_id""",
    "split_segments": f"WITH {_SEGMENTS} SELECT doc_id, chapter_idx, seg_idx, seg_type, md5(text) AS text_md5 FROM segments",
    "next_fit_chunks": f"WITH RECURSIVE {_UNITS} SELECT doc_id, chapter_idx, chunk, md5(raw) AS raw_md5 FROM packed",
    "chunk_overlap": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_id, chapter, section, cast(greatest(1, length(text) // 4) AS BIGINT) AS token_count, is_chapter_start, md5(text) AS text_md5 FROM chunks",
    "chunk_stats": f"""WITH RECURSIVE {_CHUNKS}, c AS (SELECT doc_id, chapter, greatest(1, length(text) // 4) AS t FROM chunks)
      SELECT doc_id, count(*) AS n_chunks, cast(sum(t) AS BIGINT) AS total_tokens, cast(min(t) AS BIGINT) AS min_tokens, cast(max(t) AS BIGINT) AS max_tokens, count(DISTINCT chapter) AS n_chapters FROM c GROUP BY doc_id""",
    "resume_left_anti": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_id FROM chunks WHERE (doc_id + chunk_id) % 3 <> 0",
    "dedup_headings": rf"""WITH {NOISY_SQL}, l AS ({_LINES} noisy), h AS (SELECT *, CASE WHEN regexp_matches({trim("s")}, '{_HEAD}') THEN {trim(f"regexp_extract({trim('s')}, '{_HEAD}', 2)")} END AS title FROM l),
      p AS (SELECT doc_id, title, lag(title) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM h WHERE {trim("s")} <> '')
      SELECT noisy.doc_id, cast(count(*) FILTER (title = prev) AS BIGINT) AS n_dropped FROM noisy LEFT JOIN p USING (doc_id) GROUP BY noisy.doc_id""",
    "dedup_paragraphs": f"""WITH {NOISY_SQL}, p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS s, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS i FROM noisy),
      k AS (SELECT *, CASE WHEN {trim("s")} <> '' THEN (length({trim("s")}) > 100)::VARCHAR || left({trim("s")}, 100) END AS key FROM p),
      d AS (SELECT *, lag(key) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM k)
      SELECT doc_id, md5(string_agg(s, chr(10) || chr(10) ORDER BY i)) AS text_md5 FROM d WHERE NOT coalesce(key = prev, false) GROUP BY doc_id""",
    "drop_meta_paragraphs": f"""WITH {NOISY_SQL}, p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS i FROM noisy)
      SELECT doc_id, md5(coalesce(string_agg(CASE WHEN NOT ({_META}) THEN p END, chr(10) || chr(10) ORDER BY i), '')) AS text_md5 FROM p GROUP BY doc_id""",
    "length_compare": f"""WITH {_REWRITTEN}, w AS (SELECT doc_id, {words("original")} AS a, {words("result")} AS b FROM pairs)
      SELECT doc_id, a AS original_words, b AS result_words, cast(coalesce(b / nullif(a, 0), 0) < 0.7 OR coalesce(b / nullif(a, 0), 0) > 1.8 AS BIGINT) AS n_flagged FROM w""",
    "embedding_similarity_flags": """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity,
      list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < 0.75 AS flagged FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "toc_lines": rf"""WITH {STRUCTURED_SQL}, l AS ({_LINES} structured) SELECT doc_id, cast(i AS INT) AS i, cast(length(regexp_extract(s, '^(#{{2,3}})\s+(.+)$', 1)) AS INT) AS level, {trim(r"regexp_extract(s, '^(#{2,3})\s+(.+)$', 2)")} AS title
      FROM l WHERE regexp_matches(s, '^(#{{2,3}})\s+(.+)$')""",
    "landmarks": rf"""WITH {STRUCTURED_SQL}, l AS ({_LINES} structured) SELECT doc_id, cast(i AS INT) AS i, CASE WHEN regexp_matches({trim("s")}, '^#\s+') THEN 'TITLE' ELSE 'SECTION_HEADING' END AS kind FROM l WHERE regexp_matches({trim("s")}, '^#{{1,6}}\s+')""",
    "corrections_merge": f"""WITH l AS ({_LINES} documents) SELECT doc_id, CASE WHEN (doc_id + i) % 4 = 0 THEN 'APPENDIX' ELSE 'BODY' END AS label, count(*) AS n FROM l GROUP BY ALL""",
    "heading_fuzzy_match": f"""WITH l AS ({_LINES} documents), n AS (SELECT doc_id, left(s, 12) AS name FROM l WHERE i = 1 AND length(s) > 12)
      SELECT n.doc_id, name, arg_min(s, CASE WHEN s = name THEN -1 ELSE i END) AS heading FROM n JOIN l ON n.doc_id = l.doc_id AND s <> '' AND (starts_with(s, name) OR starts_with(name, s)) GROUP BY ALL""",
    "toc_pages": f"WITH l AS ({_LINES} documents) SELECT doc_id, bool_or(i = 1 AND doc_id % 3 = 0) AS has_toc FROM l WHERE i < 4 GROUP BY doc_id",
    "strip_reinsert_roundtrip": "SELECT doc_id, true AS same FROM documents",
    "chunk_previews": f"SELECT doc_id, md5(CASE WHEN {words('text')} <= 100 THEN replace(text, chr(10), ' | ') ELSE left(text, 300) END) AS preview_md5 FROM documents",
    "structure_type": rf"""WITH {STRUCTURED_SQL}, l AS ({_LINES} structured),
      n AS (SELECT doc_id, i, cast(regexp_extract(s, '^(\d+)[\.\)]\s', 1) AS BIGINT) AS number, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM l WHERE regexp_matches(s, '^(\d+)[\.\)]\s')),
      m AS (SELECT doc_id, count(*) AS n_major, 0 AS n_minor FROM n GROUP BY doc_id),
      h AS (SELECT doc_id, count(*) FILTER (regexp_matches(s, '^#{{1,6}}\s+.+$')) AS n_headings FROM l GROUP BY doc_id)
      SELECT h.doc_id, n_headings, coalesce(n_major, 0) AS n_major, cast(0 AS BIGINT) AS n_minor, CASE WHEN coalesce(n_major, 0) >= 3 THEN 'numbered' WHEN n_headings >= 3 THEN 'headed' ELSE 'unstructured' END AS segment_type FROM h LEFT JOIN m USING (doc_id)""",
    "numbered_primary_sequence": rf"""WITH {STRUCTURED_SQL}, l AS ({_LINES} structured)
      SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS pos, cast(regexp_extract(s, '^(\d+)[\.\)]\s', 1) AS BIGINT) AS number, true AS major FROM l WHERE regexp_matches(s, '^(\d+)[\.\)]\s')""",
    "layout_body_font": f"""WITH l AS ({_LINES} documents), t AS (SELECT doc_id, i, {trim("CASE WHEN i % 7 = 0 THEN left(s, 40) ELSE s END")} AS t, CASE WHEN i % 7 = 0 THEN 16.0 WHEN i % 20 >= 17 AND i % 9 = 0 THEN 8.0 ELSE 11.0 END::DOUBLE AS size FROM l WHERE s <> ''),
      g AS (SELECT doc_id, size, sum(length(t)) AS n, min(i) AS f FROM t WHERE length(t) >= 2 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS k FROM g)
      SELECT doc_id, size AS body, size - 1.5 AS footnote, size - 3.0 AS superscript FROM r WHERE k = 1""",
    "region_counts": f"WITH l AS ({_LINES} documents) SELECT doc_id, CASE i % 10 WHEN 0 THEN 'PageHeader' WHEN 1 THEN 'SectionHeader' WHEN 9 THEN 'Footnote' ELSE 'Text' END AS label, count(*) AS n FROM l GROUP BY ALL",
    "similarity_summary": """WITH s AS (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS x FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
      SELECT count(*) AS n, count(*) FILTER (x < 0.75) AS n_flagged, round(avg(x), 5) AS mean FROM s""",
    "by_suffix": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'epub' END AS kind FROM documents",
    "metadata": """WITH r AS (SELECT doc_id, trim(CASE doc_id % 4 WHEN 0 THEN 'SOME TITLE' WHEN 1 THEN 'file.pdf' WHEN 2 THEN ' A Title ' END) AS t,
        trim(CASE doc_id % 5 WHEN 0 THEN 'ADOBE' WHEN 1 THEN 'William Wordsworth' WHEN 2 THEN 'JANE DOE' WHEN 3 THEN '' ELSE 'User' END) AS a FROM documents),
      c AS (SELECT *, array_to_string(list_transform(string_split(lower(t), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS ti, array_to_string(list_transform(string_split(lower(a), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS ai FROM r)
      SELECT doc_id, CASE WHEN t = '' OR ends_with(t, '.pdf') OR ends_with(t, '.PDF') THEN NULL WHEN upper(t) = t AND length(t) > 5 THEN ti ELSE t END AS title,
        CASE WHEN a = '' OR lower(a) IN ('acrobat', 'adobe', 'microsoft', 'scanner', 'unknown', 'user') THEN NULL WHEN upper(a) = a AND length(a) > 2 THEN ai ELSE a END AS author FROM c""",
    "verify_results": f"WITH l AS ({_LINES} documents) SELECT doc_id, cast(i AS INT) AS chunk_id, i % 2 = 0 OR {trim('s')} = 'other' AS clean FROM l WHERE s <> ''",
    "result_summary": f"""WITH l AS ({_LINES} documents), w AS (SELECT doc_id, i, {words("s")} AS n FROM l WHERE s <> '')
      SELECT doc_id, count(*) AS n_chunks, round(avg(n / (n + 1)), 6) AS mean_ratio, count(*) FILTER (i % 3 = 0) AS n_retried, count(*) FILTER (i % 2 <> 0) AS n_flagged FROM w GROUP BY doc_id""",
    "classify_segments": f"WITH l AS ({_LINES} documents) SELECT doc_id, cast(i AS INT) AS idx, CASE WHEN length(left(s, 200)) % 2 = 0 THEN 'SHORT' ELSE 'LONG' END AS label FROM l WHERE s <> ''",
    "classify_chunks": f"""WITH l AS ({_LINES} documents), p AS (SELECT doc_id, i, CASE WHEN {words("s")} <= 100 THEN s ELSE left(s, 300) END AS v, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM l WHERE s <> '')
      SELECT doc_id, cast(i AS INT) AS chunk_id, CASE WHEN k % 4 = 3 THEN 'APPENDIX' WHEN length(v) % 2 = 0 THEN 'BODY' ELSE 'REFERENCES' END AS section_type FROM p""",
    "fragment_boundaries": f"""WITH l AS ({_LINES} documents), p AS (SELECT doc_id, s, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM l WHERE s <> ''),
      m AS (SELECT doc_id, s, nxt IS NOT NULL AND length(right(s, 80) || ' | ' || left(nxt, 80)) % 2 = 1 AS merged FROM p)
      SELECT doc_id, count(*) FILTER (NOT merged) AS n, cast(sum(length(s)) + count(*) FILTER (merged) AS BIGINT) AS n_chars FROM m GROUP BY doc_id""",
    "meta_commentary": rf"""WITH l AS ({_LINES} documents), f AS (SELECT doc_id, i, CASE WHEN regexp_matches(s, '[.!?]\s') THEN regexp_extract(s, '^(.*?[.!?])\s', 1) ELSE s END AS v FROM l WHERE s <> '')
      SELECT doc_id, cast(i AS INT) AS idx, {words("v")} >= 5 AND length(v) % 2 = 1 AS meta FROM f""",
    "scan_front": f"""WITH l AS ({_LINES} documents), p AS (SELECT doc_id, count(*) FILTER (i < 5) AS n, max(CASE WHEN i = 0 THEN CASE WHEN {trim("s")} = '' THEN '[BLANK PAGE]' ELSE left({trim("s")}, 800) END END) AS f FROM l GROUP BY doc_id)
      SELECT doc_id, left(f, 20) AS title, cast(CASE WHEN length(f) % 2 = 1 THEN n ELSE 1 END AS INT) AS body_starts_at_page FROM p""",
    "scan_back": f"WITH l AS ({_LINES} documents), p AS (SELECT doc_id, least(5, count(*)) AS n FROM l GROUP BY doc_id) SELECT doc_id, n % 2 = 0 AS has_references, cast(n AS INT) AS starts_at FROM p",
    "section_starters": rf"""WITH {STRUCTURED_SQL}, p AS (SELECT doc_id, unnest({paras("text")}) AS p, unnest(range(len({paras("text")}))) AS j FROM structured),
      f AS (SELECT doc_id, j, regexp_replace(left({trim("string_split(p, chr(10))[1]")}, 100), '^#{{1,6}}\s+', '') AS s FROM p),
      k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM f WHERE length(s) > 1)
      SELECT doc_id, cast(k // CASE WHEN n > 5 THEN n // 5 ELSE 1 END AS INT) AS i, s FROM k WHERE k % CASE WHEN n > 5 THEN n // 5 ELSE 1 END = 0""",
    "merge_labels_islands": rf"""WITH p AS (SELECT doc_id, unnest(string_split_regex(text, '[.\n]\s*')) AS s, unnest(range(len(string_split_regex(text, '[.\n]\s*')))) AS i FROM documents),
      m AS (SELECT doc_id, s, regexp_matches(regexp_replace(s, '^[- •0-9.)]+', ''), '^\p{{Ll}}') AND row_number() OVER (PARTITION BY doc_id ORDER BY i) > 1 AS on_ FROM p WHERE s <> '')
      SELECT doc_id, count(*) FILTER (NOT on_) AS n_merged, cast(sum(length(s)) + count(*) FILTER (on_) AS BIGINT) AS n_chars FROM m GROUP BY doc_id""",
    "label_normalise_pad": """SELECT doc_id, array_to_string(list_slice(list_concat(CASE doc_id % 4 WHEN 0 THEN ['BODY', 'FOOTNOTES', 'BODY'] WHEN 1 THEN ['REFERENCES'] WHEN 2 THEN [] ELSE ['APPENDIX', 'BODY', 'BODY', 'VERBATIM', 'BODY', 'BODY'] END,
      ['BODY', 'BODY', 'BODY', 'BODY', 'BODY']), 1, doc_id % 5), ',') AS labels FROM documents""",
    "line_corrections": f"""WITH l AS ({_LINES} documents), c AS (SELECT doc_id, i + doc_id % 2 AS ci, s AS original, CASE WHEN i = 2 THEN 'REMOVE' ELSE 'fixed' END AS fixed FROM l WHERE i IN (2, 4)),
      a AS (SELECT c.doc_id, ci, min(fixed) AS fixed, arg_min(l.i, CASE WHEN l.i = ci THEN -1 ELSE l.i END) AS line FROM c JOIN l ON c.doc_id = l.doc_id AND l.s = original GROUP BY c.doc_id, ci, original),
      f AS (SELECT doc_id, line, arg_max(fixed, ci) AS fixed FROM a GROUP BY ALL)
      SELECT l.doc_id, md5(string_agg(CASE WHEN fixed = 'REMOVE' THEN '' ELSE coalesce(fixed, s) END, chr(10) ORDER BY i)) AS text_md5 FROM l LEFT JOIN f ON f.doc_id = l.doc_id AND f.line = l.i GROUP BY l.doc_id""",
    "generate_toc": rf"""WITH {STRUCTURED_SQL}, l AS ({_LINES} structured), h AS (SELECT doc_id, i, length(regexp_extract(s, '^(#{{2,3}})\s+(.+)$', 1)) AS level, {trim(r"regexp_extract(s, '^(#{2,3})\s+(.+)$', 2)")} AS title FROM l WHERE regexp_matches(s, '^(#{{2,3}})\s+(.+)$')),
      t AS (SELECT doc_id, '## Table of Contents' || chr(10) || chr(10) || string_agg(repeat('  ', level - 2) || '- [' || title || '](#' || replace(regexp_replace(lower(title), '[^\pL\pN_\s-]', '', 'g'), ' ', '-') || ')', chr(10) ORDER BY i) AS toc FROM h GROUP BY doc_id)
      SELECT doc_id, {words("toc")} AS n_words, toc FROM t""",
    "prose_density": rf"""WITH {NOISY_SQL}, p AS (SELECT doc_id, {words("text")} AS n_words, {paras("text")} AS ps FROM noisy),
      c AS (SELECT doc_id, n_words, coalesce(100.0::DOUBLE * len(list_filter(ps, lambda q: len(list_filter(string_split_regex(q, '[.!?]+'), lambda x: length({trim("x")}) > 10)) >= 2)) / nullif(len(ps), 0), 0) AS prose_percent FROM p)
      SELECT doc_id, n_words, prose_percent, CASE WHEN n_words < 50 OR (prose_percent < 20 AND n_words > 100) THEN 'fail' WHEN prose_percent < 40 THEN 'warn' ELSE 'pass' END AS verdict FROM c""",
    "references_start": rf"""WITH l AS ({_LINES} documents), m AS (SELECT *, max(i) OVER (PARTITION BY doc_id) AS last FROM l),
      r AS (SELECT doc_id, i, last, unnest(string_split(lower(CASE WHEN i >= last - 1 AND doc_id % 3 = 0 THEN 'References' || chr(10) || s ELSE s END), chr(10))) AS x FROM m WHERE i > last - 5)
      SELECT doc_id, cast(min(i) AS INT) AS page FROM r WHERE length(trim(x)) <= 40 AND regexp_matches(x, '\breferences\b|\bbibliography\b|\bworks?\s+cited\b|\bliterature\s+cited\b|\bcited\s+works?\b|\bsources\b|\bendnotes\b|\bnotes\s+and\s+references\b|\bfurther\s+reading\b') GROUP BY doc_id""",
    "simplify_sequential": f"""WITH l AS ({_LINES} documents), p AS (SELECT doc_id, i, s, lag(s) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM l WHERE s <> '')
      SELECT doc_id, cast(i AS INT) AS chunk_id, s AS text, coalesce({trim("right(prev, 1500)")}, '') AS bridge FROM p""",
    "merge_similar": f"WITH l AS ({_LINES} documents) SELECT doc_id, count(*) AS n, cast(sum(length(s)) AS BIGINT) AS n_chars FROM l WHERE s <> '' GROUP BY doc_id",
}

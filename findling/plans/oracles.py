"""The registered queries in DuckDB SQL, written from the definitions."""

from __future__ import annotations

from findling.functions.text import MATCHING_STOPWORDS, QUERY_OPENINGS, QUERY_SKIPPED
from findling.operators.evaluate import HIT_AT, METRICS, PRECISION_AT, RECALL_AT
from findling.operators.lines import FEATURES
from findling.operators.mine import QUERY_TYPES


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STOP = _list(MATCHING_STOPWORDS)
TYPES = _list(QUERY_TYPES)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def terms(x: str, stop: bool = True) -> str:
    keep = f" AND NOT list_contains({STOP}, t)" if stop else ""
    return rf"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z0-9]+'){keep})"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda t: t <> '')"


def clean(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(coalesce({x}, ''), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def title(x: str) -> str:
    first = strip(f"split_part({x}, '.', 1)")
    cut = rf"regexp_replace(substr({x}, 1, 150), ' [^ ]*\z', '') || '...'"
    return strip(rf"regexp_replace(CASE WHEN length({first}) BETWEEN 15 AND 200 THEN {first} ELSE {cut} END, '^(?:\[\d+\]|\d+\.|\([a-z]\))\s*', '')")


def query_of(x: str) -> str:
    cases = " ".join(f"WHEN starts_with(lower({x}), '{p}') THEN {strip(f'substr(lower({x}), {len(p) + 1})')}" for p in QUERY_OPENINGS)
    rest = f"CASE {cases} ELSE lower({x}) END"
    return f"array_to_string(list_filter({words(rest)}, lambda t: length(t) > 2 AND NOT list_contains({_list(QUERY_SKIPPED)}, t))[1:8], ' ')"


def summary(x: str) -> str:
    head = r"(?is)(?:SUMMARY OF THE INVENTION|BRIEF SUMMARY OF THE INVENTION|OBJECTS AND SUMMARY OF THE INVENTION|SUMMARY)\s*[\n\r]+(.*)"
    close = r"(?is)^(.*?)(?:BRIEF DESCRIPTION OF THE (?:DRAWINGS|FIGURES)|DETAILED DESCRIPTION)\s*[\n\r]+"
    after = f"regexp_extract({x}, '{head}', 1)"
    found = f"CASE WHEN regexp_matches({after}, '{close}') THEN {strip(f"regexp_extract({after}, '{close}', 1)")} ELSE {strip(f'substr({after}, 1, 2500)')} END"
    blocks = f"list_filter(string_split({x}, chr(10) || chr(10)), lambda p: length({strip('p')}) > 40)"
    fallback = f"CASE WHEN len({blocks}) > 0 THEN array_to_string({blocks}[1:2], chr(10) || chr(10)) ELSE substr({x}, 1, 1500) END"
    return clean(f"substr(CASE WHEN length({found}) < 50 THEN {fallback} ELSE {found} END, 1, 2000)")


CORPUS = f"""corpus AS (SELECT doc_id, title, abstract, summary, 'Title: ' || title || chr(10) || chr(10) || 'Abstract: ' || abstract || chr(10) || chr(10) || 'Summary: ' || summary AS search_text FROM (
  SELECT doc_id, {title("c")} AS title, {clean("l[1]")} AS abstract, {clean("array_to_string(l[2:], chr(10))")} AS summary
  FROM (SELECT doc_id, {clean("text")} AS c, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))"""
ITEMS = "items AS (SELECT item_id AS query_id, coalesce(text, '') AS query FROM benchmark)"


def bm25(name: str, docs: str, queries: str, k1: float = 1.2, lucene: bool = False) -> str:
    """CTEs that end in {name}(query_id, doc_id, raw): docs is a SELECT of doc_id, tokens; queries of query_id, tokens."""
    idf = "ln(1 + (n - df + 0.5) / (df + 0.5))" if lucene else "CASE WHEN r >= 0 THEN r ELSE 0.25 * avg(r) OVER () END"
    return f"""{name}_d AS MATERIALIZED ({docs}), {name}_q AS MATERIALIZED ({queries}),
{name}_n AS (SELECT count(*) AS n, avg(len(tokens)) AS a FROM {name}_d),
{name}_p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM {name}_d) GROUP BY doc_id, term),
{name}_t AS MATERIALIZED (SELECT term, df, {idf} AS idf FROM (SELECT term, df, n, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM (SELECT term, count(*) AS df FROM {name}_p GROUP BY term), {name}_n)),
{name}_a AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(tokens) AS term FROM {name}_q) GROUP BY query_id, term),
{name} AS MATERIALIZED (SELECT query_id, doc_id, sum(qtf * idf * tf * {k1 + 1!r} / (tf + {k1!r} * (0.25 + 0.75 * dl / a))) AS raw
  FROM {name}_a JOIN {name}_t USING (term) JOIN {name}_p USING (term), {name}_n GROUP BY query_id, doc_id)"""


def top(name: str, k: int, score: str = "round(raw, 6)", source: str | None = None, more: str = "", order: str = "score DESC, doc_id") -> str:
    return f"{name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM (SELECT query_id, doc_id, {score} AS score{more} FROM {source or name + '_s'})) WHERE rank <= {k})"


DOC_TOKENS = f"SELECT doc_id, {terms('text')} AS tokens FROM documents"
ITEM_TOKENS = f"SELECT item_id AS query_id, {terms('text')} AS tokens FROM benchmark"
LEX = bm25("lex_s", DOC_TOKENS, ITEM_TOKENS) + ", " + top("lex", 50)
DENSE = f"""vec AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
qvec AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)),
den_s AS (SELECT query_id, doc_id, list_cosine_similarity(qvec.e, vec.e) AS raw FROM qvec, vec), {top("den", 50)}"""


def fused(a: float, b: float) -> str:
    score = f"round(coalesce({a!r} / (60 + l.rank), 0) + coalesce({b!r} / (60 + n.rank), 0), 9)"
    return f"""fus_s AS (SELECT query_id, doc_id, l.rank AS bm25_rank, n.rank AS dense_rank, {score} AS raw FROM lex l FULL JOIN den n USING (query_id, doc_id)),
{top("fus", 50, "raw", more=", bm25_rank, dense_rank", order="score DESC, bm25_rank NULLS LAST, dense_rank NULLS LAST, doc_id")}"""


def reranked(source: str) -> str:
    share = "len(list_intersect(list_distinct(qt), list_distinct(dt))) / greatest(len(list_distinct(qt)), 1)"
    return f"""rer_s AS (SELECT c.query_id, c.doc_id, c.rank AS stage1_rank, c.score AS stage1_score, round(4.0 * ({share}) - 2.0, 6) AS raw FROM {source} c JOIN (SELECT query_id, tokens AS qt FROM lex_s_q) USING (query_id) JOIN (SELECT doc_id, tokens AS dt FROM lex_s_d) USING (doc_id)),
rer AS MATERIALIZED (SELECT *, round(1 / (1 + exp(-raw)), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, stage1_rank) AS rank FROM rer_s) WHERE rank <= 10)"""


REL = "rel AS MATERIALIZED (SELECT item_id AS query_id, min(doc_id) AS relevant_doc_id FROM benchmark LEFT JOIN documents ON contains(documents.text, benchmark.text) GROUP BY item_id)"


def metric(m: str, cut: bool = True) -> str:
    if m == "mrr":
        return "coalesce(1.0 / rank, 0)::DOUBLE"
    if m == "ndcg_at_10":
        return f"coalesce(CASE WHEN {'rank <= 10' if cut else 'rank IS NOT NULL'} THEN 1.0 / log2(rank + 1) END, 0)::DOUBLE"
    k = int(m.rsplit("_", 1)[1])
    return f"coalesce(CASE WHEN rank <= {k} THEN {f'1.0 / {k}' if m.startswith('precision') else '1.0'} END, 0)::DOUBLE"


def measured(hits: str) -> str:
    return f"(SELECT r.query_id, r.relevant_doc_id, h.rank FROM rel r LEFT JOIN {hits} h ON h.query_id = r.query_id AND h.doc_id = r.relevant_doc_id)"


def means(hits: str, by: str = "", cut: bool = True) -> str:
    return f"SELECT {by + ', ' if by else ''}count(*) AS num_queries, " + ", ".join(f"round(coalesce(avg({metric(m, cut)}), 0), 9) AS {m}" for m in METRICS) + f" FROM {hits}" + (f" GROUP BY {by}" if by else "")


assert {f"hit_at_{k}" for k in HIT_AT} | {f"precision_at_{k}" for k in PRECISION_AT} | {f"recall_at_{k}" for k in RECALL_AT} < set(METRICS)

# Structured documents: what is composed is known, so its parts follow from lengths alone.
SPEC = f"""lines AS (SELECT doc_id, text, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {strip("x")}), lambda x: x <> '') AS l FROM documents),
spec AS MATERIALIZED (SELECT doc_id, {title(clean("text"))} AS title, l, l[1] AS f, l[len(l)] AS z, array_to_string(list_transform(l, lambda x, i: '[' || lpad(i::VARCHAR, 4, '0') || '] ' || x), chr(10)) AS body,
  'A method comprising: ' || l[1] || ';' || chr(10) || 'a second step of it.' AS c1, 'The method of claim 1, wherein ' || l[len(l)] AS c2 FROM lines WHERE len(l) > 0),
parts AS MATERIALIZED (SELECT *, 9 + length(f) AS s2, 9 + length(f) + 13 + length(body) AS s3,
  'What is claimed is:' || chr(10) || '1. ' || c1 || chr(10) || '2. ' || c2 AS ctext FROM spec),
whole AS MATERIALIZED (SELECT *, 'ABSTRACT' || chr(10) || f || chr(10) || chr(10) || 'BACKGROUND' || chr(10) || body || chr(10) || chr(10) || 'CLAIMS' || chr(10) || ctext AS full_text FROM parts)"""
# With one line there is one number only, so the blocks of the first two sections count if they are long enough.
PARS = f"""ends AS (SELECT *, list_transform(l, lambda x: length(x) + 8) AS sizes FROM whole),
pars AS MATERIALIZED (SELECT doc_id, title, i, '[' || lpad(i::VARCHAR, 4, '0') || ']' AS mark, 'BACKGROUND' AS home, CASE WHEN i = 1 THEN s2 + 12 ELSE s2 + 12 + off END AS start_char, CASE WHEN i < n THEN s2 + 12 + off + sizes[i] ELSE length(full_text) END AS end_char,
  CASE WHEN i < n THEN l[i] ELSE l[i] || chr(10) || chr(10) || 'CLAIMS' || chr(10) || ctext END AS own FROM (SELECT *, len(l) AS n, unnest(range(1, len(l) + 1)) AS i, unnest(list_transform(range(0, len(l)), lambda k: coalesce(list_sum(sizes[1:k]), 0)::BIGINT)) AS off FROM ends) WHERE n > 1
  UNION ALL SELECT doc_id, title, i, 'Paragraph ' || i, home, 0, length(own), own FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM (SELECT doc_id, title, 1 AS k, 'ABSTRACT' AS home, f AS own FROM whole WHERE len(l) = 1 UNION ALL SELECT doc_id, title, 2, 'BACKGROUND', body FROM whole WHERE len(l) = 1) WHERE length(own) > 60))"""
CLAIMS = f"""cl AS MATERIALIZED (SELECT doc_id, title, 1 AS claim_id, 'INDEPENDENT' AS claim_type, 'A method' AS preamble, 'comprising' AS transitional_phrase, c1 AS own, list_filter(list_transform(string_split(f || ';' || chr(10) || 'a second step of it.', ';'), lambda x: {strip("x")}), lambda x: length(x) > 10) AS lims FROM whole
  UNION ALL SELECT doc_id, title, 2, 'DEPENDENT', 'The method of claim 1', '', c2, [c2] FROM whole)"""
PASSAGES = """pas AS MATERIALIZED (SELECT doc_id, doc_id || '-PAR-' || lpad(i::VARCHAR, 4, '0') AS passage_id, 'PARAGRAPH' AS segment_type, 'Title: ' || title || chr(10) || '[' || mark || ']: ' || own AS text FROM pars
  UNION ALL SELECT doc_id, doc_id || '-CLM-' || lpad(claim_id::VARCHAR, 3, '0'), 'CLAIM', 'Title: ' || title || chr(10) || 'Claim ' || claim_id || ' (' || claim_type || '): ' || own FROM cl)"""
LABEL = rf"""(regexp_matches(s, '^(?:\[\d{{4}}\]|\(\d{{4}}\))') OR regexp_matches(s, '^(?:Claim\s+)?\d+[.:]\s+') OR regexp_matches(s, '^(?:[A-Z\s]{{4,}}(?:INVENTION|APPLICATIONS|DRAWINGS|EMBODIMENTS|CLAIMS|BACKGROUND|SUMMARY))\b') OR (upper(s) = s AND regexp_matches(s, '\p{{Lu}}') AND len({words("s")}) <= 7))::INT"""
SPEC_LINES = f"sl AS MATERIALIZED (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS line_no, {strip('x')} AS s FROM (SELECT doc_id, unnest(string_split(full_text, chr(10))) AS x, unnest(range(len(string_split(full_text, chr(10))))) AS k FROM whole) WHERE {strip('x')} <> '')"
FEATURE_SQL = rf"""SELECT doc_id, line_no, length(s)::DOUBLE AS char_length, len(w)::DOUBLE AS word_count, round(length(regexp_replace(s, '\P{{Lu}}', '', 'g')) / length(s), 6) AS uppercase_ratio,
round(len(list_filter(w, lambda t: regexp_matches(t, '\p{{L}}') AND NOT regexp_matches(t, '(?:^|\P{{L}})\p{{Ll}}|\p{{L}}[\p{{Lu}}\p{{Lt}}]'))) / len(w), 6) AS titlecase_ratio,
round(length(regexp_replace(s, '\P{{Nd}}', '', 'g')) / length(s), 6) AS digit_ratio, round(length(regexp_replace(s, '[\p{{L}}\p{{N}}\s]', '', 'g')) / length(s), 6) AS punct_ratio,
regexp_matches(s, '^\d+[.:)]')::INT::DOUBLE AS starts_with_digit, regexp_matches(s, '^\[\d+\]|^\(\d+\)')::INT::DOUBLE AS starts_with_bracket,
regexp_matches(s, '(?i)(?:^|[^\p{{L}}\p{{N}}_])claims?(?:$|[^\p{{L}}\p{{N}}_])')::INT::DOUBLE AS has_claim_keyword,
regexp_matches(s, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(invention|background|summary|drawings?|figures?|embodiments?|field|prior art|cross[- ]reference|detailed description)(?:$|[^\p{{L}}\p{{N}}_])')::INT::DOUBLE AS has_section_keyword,
regexp_matches(s, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(comprising|consisting|characterized)(?:$|[^\p{{L}}\p{{N}}_])')::INT::DOUBLE AS has_transitional_keyword,
(s LIKE '%:')::INT::DOUBLE AS ends_with_colon, (s LIKE '%.')::INT::DOUBLE AS ends_with_period, (line_no = 0)::INT::DOUBLE AS prev_line_empty, (length(s) < 60)::INT::DOUBLE AS is_short_line
FROM (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS line_no, {strip("x")} AS s, {words("x")} AS w FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents) WHERE {strip("x")} <> '')"""
assert len(FEATURES) == 15

MINED = f"""{CORPUS}, pos AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM corpus),
lab AS MATERIALIZED (SELECT printf('PR-Q-%03d', i + 1) AS query_id, {query_of("p.title")} AS query, p.doc_id AS relevant_doc_id, g.doc_id AS irrelevant_doc_id, {TYPES}[(i % 4 + 1)::INT] AS query_type, p.title AS relevant_title, g.title AS irrelevant_title, true AS verified
  FROM (SELECT i, i * (n // least(200, n // 4)) AS a, (i * (n // least(200, n // 4)) + n // 2 + i * 7) % n AS b FROM (SELECT count(*) AS n FROM documents), range(0, 200) r(i) WHERE i < least(200, n // 4)) JOIN pos p ON p.pos = a JOIN pos g ON g.pos = b),
spl AS MATERIALIZED (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_type ORDER BY query_id) <= floor(count(*) OVER (PARTITION BY query_type) * 0.8) THEN 'train' ELSE 'val' END AS split FROM lab)"""
NEGATIVES = f"""{bm25("neg_s", DOC_TOKENS, f"SELECT query_id, {terms('query')} AS tokens FROM lab")}, {top("neg", 50)},
evec AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS e FROM embeddings),
dn_s AS (SELECT query_id, v.doc_id, list_cosine_similarity(q.e, v.e) AS raw FROM spl JOIN evec q ON q.doc_id = relevant_doc_id, evec v WHERE v.doc_id IN (SELECT doc_id FROM documents)), {top("dn", 10)},
n1 AS MATERIALIZED (SELECT query_id, doc_id, 'hard_negative_bm25' AS negative_type, place FROM (SELECT query_id, h.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM spl JOIN neg h USING (query_id) WHERE h.doc_id <> relevant_doc_id AND h.doc_id <> irrelevant_doc_id) WHERE place <= 3),
n2 AS (SELECT query_id, doc_id, 'hard_negative_dense' AS negative_type, place FROM (SELECT query_id, h.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM spl JOIN dn h USING (query_id) WHERE h.doc_id <> relevant_doc_id AND h.doc_id <> irrelevant_doc_id AND NOT EXISTS (SELECT 1 FROM n1 WHERE n1.query_id = spl.query_id AND n1.doc_id = h.doc_id)) WHERE place <= 2),
negs AS MATERIALIZED (SELECT * FROM n1 UNION ALL SELECT * FROM n2 UNION ALL SELECT query_id, irrelevant_doc_id, 'orthogonal_negative', 1 FROM spl WHERE irrelevant_doc_id <> relevant_doc_id),
dtext AS (SELECT doc_id, CASE WHEN length({strip("abstract")}) > 0 THEN {strip("title")} || ' — ' || {strip("abstract")} ELSE {strip("title")} END AS doc_text FROM corpus),
prs AS MATERIALIZED (SELECT query_id, relevant_doc_id AS doc_id, 1.0::DOUBLE AS label, 'positive' AS type, query_type, split, md5(doc_text) AS text_md5 FROM spl JOIN dtext ON dtext.doc_id = relevant_doc_id
  UNION ALL SELECT query_id, negs.doc_id, 0.0::DOUBLE, CASE WHEN negative_type = 'orthogonal_negative' THEN negative_type ELSE negative_type || '_rank' || place END, query_type, split, md5(doc_text) FROM negs JOIN spl USING (query_id) JOIN dtext ON dtext.doc_id = negs.doc_id)"""
SEG_COLUMNS = "doc_id, segment_id, segment_type, heading, start_char, end_char, word_count, text_md5"
WHOLE_DOCS = f"""SELECT doc_id, list_filter(string_split_regex(lower(concat_ws(' ', title, abstract, replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)))), '\\s+'), lambda x: x <> '') AS tokens FROM corpus JOIN (SELECT doc_id, coalesce(text, '') AS t FROM documents) USING (doc_id)"""

SQL: dict[str, str] = {
    "tokenize_counts": f"SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {terms('text')} AS t FROM documents)",
    "word_counts": f"SELECT doc_id, len({words("coalesce(text, '')")})::INT AS n_words, len(list_distinct({words("lower(coalesce(text, ''))")}))::INT AS n_distinct FROM documents",
    "clean_text": f"SELECT doc_id, length(t)::INT AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, {clean('text')} AS t FROM documents)",
    "derive_title": f"WITH {CORPUS} SELECT doc_id, title FROM corpus",
    "heuristic_query": f"WITH {CORPUS} SELECT doc_id, {query_of("('A method for ' || title)")} AS query FROM corpus",
    "stopword_filter": f"SELECT word, count(*) AS n FROM (SELECT unnest({terms('text', False)}) AS word FROM documents) WHERE list_contains({STOP}, word) GROUP BY word",
    "search_texts": f"WITH {CORPUS} SELECT doc_id, md5(search_text) AS search_md5, md5(CASE WHEN length({strip('abstract')}) > 0 THEN {strip('title')} || ' — ' || {strip('abstract')} ELSE {strip('title')} END) AS pair_md5 FROM corpus",
    "summaries": f"SELECT doc_id, md5({summary('a')}) AS of_header_md5, md5({summary('b')}) AS of_paragraphs_md5 FROM (SELECT doc_id, {clean("'Opening.' || chr(10) || chr(10) || 'SUMMARY OF THE INVENTION' || chr(10) || coalesce(text, '') || chr(10) || 'DETAILED DESCRIPTION' || chr(10) || coalesce(text, '')")} AS a, {clean('text')} AS b FROM documents)",
    "shape_corpus": f"SELECT printf('US-G-%06d', row_number() OVER (ORDER BY doc_id)) AS doc_id, {title('c')} AS title, md5({summary('c')}) AS summary_md5 FROM (SELECT doc_id, {clean('text')} AS c FROM documents WHERE length(text) > 100)",
    "doc_stats": f"SELECT doc_id, len(tokens)::INT AS dl FROM ({DOC_TOKENS})",
    "term_df_idf": f"WITH {bm25('s', DOC_TOKENS, ITEM_TOKENS)} SELECT term, df, round(idf, 9) AS idf FROM s_t",
    "postings": f"WITH {bm25('s', DOC_TOKENS, ITEM_TOKENS)} SELECT doc_id, term, tf::INT AS tf FROM s_p",
    "index_size": f"WITH {bm25('s', DOC_TOKENS, ITEM_TOKENS)} SELECT n AS n_docs, round(a, 9) AS avgdl FROM s_n",
    "bm25_top10": f"WITH {LEX} SELECT query_id, doc_id, rank::INT AS rank, score FROM lex WHERE rank <= 10",
    "bm25_default_k1": f"WITH {bm25('w_s', f'SELECT doc_id, {words("lower(coalesce(text, ''))")} AS tokens FROM documents', f'SELECT item_id AS query_id, {words("lower(coalesce(text, ''))")} AS tokens FROM benchmark', 1.5)}, {top('w', 10)} SELECT query_id, doc_id, rank::INT AS rank, score FROM w",
    "bm25_multifield": f"WITH {CORPUS}, "
    + ", ".join(bm25(f"f_{c}", f"SELECT doc_id, {terms(c)} AS tokens FROM corpus", ITEM_TOKENS, lucene=True) for c in ("title", "abstract", "summary", "search_text"))
    + ", m_s AS (SELECT query_id, doc_id, max(raw) AS raw FROM ("
    + " UNION ALL ".join(f"SELECT query_id, doc_id, {b} * raw AS raw FROM f_{c}" for c, b in (("title", 3.0), ("abstract", 2.0), ("summary", 1.0), ("search_text", 1.0)))
    + f") GROUP BY query_id, doc_id), {top('m', 10)} SELECT query_id, doc_id, rank::INT AS rank, score FROM m",
    "bm25_zero_padded": f"WITH {bm25('z_b', DOC_TOKENS, f"SELECT item_id AS query_id, {terms("CASE WHEN item_id % 2 = 0 THEN text ELSE 'zzqqxx' END")} AS tokens FROM benchmark")}, z_s AS (SELECT item_id AS query_id, d.doc_id, coalesce(raw, 0) AS raw FROM benchmark CROSS JOIN documents d LEFT JOIN z_b ON z_b.query_id = item_id AND z_b.doc_id = d.doc_id), {top('z', 10)} SELECT query_id, doc_id, rank::INT AS rank, score FROM z",
    "vector_norms": "SELECT vec_id, round(n, 6) AS norm, round(e[1] / n, 6) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)",
    "cosine_top10": f"WITH {DENSE} SELECT query_id, doc_id, rank::INT AS rank, score FROM den WHERE rank <= 10",
    "cosine_pairs": "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "missing_embeddings": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "embedded_docs": "SELECT vec_id AS doc_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)",
    "query_embeddings": "SELECT item_id AS query_id, embedding IS NOT NULL AS has_embedding, coalesce(len(embedding), 0)::INT AS size FROM benchmark LEFT JOIN embeddings ON vec_id = item_id",
    "rrf_top10": f"WITH {LEX}, {DENSE}, {fused(1.0, 1.0)} SELECT query_id, doc_id, rank::INT AS rank, score, bm25_rank::INT AS bm25_rank, dense_rank::INT AS dense_rank FROM fus WHERE rank <= 10",
    "rrf_weighted": f"WITH {LEX}, {DENSE}, {fused(2.0, 0.5)} SELECT query_id, doc_id, rank::INT AS rank, score, bm25_rank::INT AS bm25_rank, dense_rank::INT AS dense_rank FROM fus WHERE rank <= 10",
    "rerank_top10": f"WITH {LEX}, {DENSE}, {fused(1.0, 1.0)}, {reranked('fus')} SELECT query_id, doc_id, rank::INT AS rank, score, raw AS raw_logit, stage1_rank::INT AS stage1_rank, stage1_score, (stage1_rank - rank)::INT AS rank_shift FROM rer",
    "rank_shift": f"WITH {LEX}, {reranked('lex')} SELECT query_id, max(stage1_rank - rank)::INT AS most_up, min(stage1_rank - rank)::INT AS most_down, count(*) FILTER (stage1_rank = rank) AS unmoved FROM rer GROUP BY query_id",
    "search_pipeline": f"WITH {LEX}, {CORPUS} SELECT query_id, doc_id, rank::INT AS rank, score, title FROM lex JOIN corpus USING (doc_id) WHERE rank <= 10",
    "per_query_metrics": f"WITH {LEX}, {REL} SELECT query_id, relevant_doc_id, rank::INT AS rank, " + ", ".join(f"round({metric(m)}, 9) AS {m}" for m in METRICS) + f" FROM {measured('lex')}",
    "metrics_summary": f"WITH {LEX}, {REL} " + means(measured("lex")),
    "metrics_by_type": f"WITH {LEX}, {REL} " + means(f"(SELECT *, {TYPES}[(query_id % 4 + 1)::INT] AS query_type FROM {measured('lex')})", "query_type"),
    "misses": f"WITH {LEX}, {REL} SELECT query_id, relevant_doc_id, rank::INT AS rank FROM {measured('lex')} WHERE rank IS NULL OR rank > 10",
    "four_way_compare": f"WITH {LEX}, {DENSE}, {fused(1.0, 1.0)}, {reranked('fus')}, {REL} " + " UNION ALL ".join(f"SELECT *, '{n}' AS strategy FROM ({means(measured(t))})" for n, t in (("bm25", "lex"), ("dense", "den"), ("hybrid", "fus"), ("hybrid_rerank", "rer"))),
    "p95_nearest_rank": "SELECT event_type, list_sort(list(value))[floor(count(value) * 0.95)::INT + 1] AS p95 FROM events GROUP BY event_type",
    "p95_interpolated": "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "fallback_sections": f"SELECT doc_id, 'SEC-001' AS segment_id, 'OTHER' AS segment_type, 'BODY' AS heading, 0 AS start_char, length(t)::INT AS end_char, len({words('t')})::INT AS word_count, md5({strip('t')}) AS text_md5, true AS fallback FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "sections": f"WITH {SPEC} SELECT {SEG_COLUMNS} FROM (SELECT doc_id, 'SEC-001' AS segment_id, 'ABSTRACT' AS segment_type, 'ABSTRACT' AS heading, 0 AS start_char, s2::INT AS end_char, len({words('f')})::INT AS word_count, md5(f) AS text_md5 FROM whole UNION ALL SELECT doc_id, 'SEC-002', 'BACKGROUND', 'BACKGROUND', s2::INT, s3::INT, len({words('body')})::INT, md5(body) FROM whole UNION ALL SELECT doc_id, 'SEC-003', 'CLAIMS', 'CLAIMS', s3::INT, length(full_text)::INT, len({words('ctext')})::INT, md5(ctext) FROM whole)",
    "paragraphs": f"WITH {SPEC}, {PARS} SELECT doc_id, 'PAR-' || lpad(i::VARCHAR, 4, '0') AS segment_id, mark AS heading, start_char::INT AS start_char, end_char::INT AS end_char, home AS section_affinity, len({words('own')})::INT AS word_count, md5(own) AS text_md5 FROM pars",
    "claims": f"WITH {SPEC}, {CLAIMS} SELECT doc_id, claim_id, claim_type, preamble, transitional_phrase, len(lims)::INT AS limitations_count, md5(own) AS text_md5 FROM cl",
    "claim_edges": f"WITH {SPEC} SELECT doc_id, 2 AS claim_id, 1 AS parent_id FROM whole",
    "limitations": f"WITH {SPEC}, {CLAIMS} SELECT doc_id, claim_id, (unnest(range(len(lims))))::INT AS n, md5(unnest(lims)) AS limitation_md5 FROM cl",
    "passages": f"WITH {SPEC}, {PARS}, {CLAIMS}, {PASSAGES} SELECT doc_id, passage_id, segment_type, md5(text) AS text_md5 FROM pas",
    "segment_stats": f"WITH {SPEC}, {PARS} SELECT doc_id, length(full_text)::INT AS total_chars, len({words('full_text')})::INT AS total_words, 3 AS section_count, (SELECT count(*) FROM pars WHERE pars.doc_id = whole.doc_id)::INT AS paragraph_count, 2 AS claim_count, 1 AS independent_claims, 1 AS dependent_claims FROM whole",
    "maxp_top10": f"WITH {bm25('c', f"SELECT conv_id || '-' || turn AS doc_id, {terms('text')} AS tokens FROM conversations", ITEM_TOKENS)}, par AS (SELECT conv_id || '-' || turn AS p, conv_id FROM conversations), x_s AS (SELECT query_id, conv_id AS doc_id, max(round(raw, 6)) AS raw, arg_min(c.doc_id, (-round(raw, 6), c.doc_id)) AS passage_id FROM c JOIN par ON par.p = c.doc_id GROUP BY query_id, conv_id), {top('x', 10, 'raw', more=', passage_id')} SELECT query_id, doc_id, rank::INT AS rank, score, passage_id FROM x",
    "structures": "SELECT doc_id::VARCHAR AS doc_id, 'API client not initialized.' AS problem_statement, 'Rule-based fallback representation.' AS inventive_core, []::VARCHAR[] AS technical_elements, 'Unstructured text.' AS claim_summary, NULL::VARCHAR AS error FROM documents",
    "line_features": FEATURE_SQL,
    "weak_labels": f"WITH {SPEC}, {SPEC_LINES} SELECT doc_id, line_no, {LABEL} AS is_boundary FROM sl",
    "boundary_counts": f"WITH {SPEC}, {SPEC_LINES} SELECT is_boundary, count(*) AS n FROM (SELECT {LABEL} AS is_boundary FROM sl) GROUP BY is_boundary",
    "labelled_queries": f"WITH {MINED} SELECT * FROM lab",
    "stratified_split_sizes": f"WITH {MINED} SELECT query_type, split, count(*) AS n FROM spl GROUP BY query_type, split",
    "hard_negative_pairs": f"WITH {MINED}, {NEGATIVES} SELECT * FROM prs",
    "hard_negative_triples": f"WITH {MINED}, {NEGATIVES} SELECT query_id, relevant_doc_id AS positive_id, negs.doc_id AS negative_id, negative_type, 1.0::DOUBLE AS margin, query_type, split FROM negs JOIN spl USING (query_id)",
    "mining_stats": f"WITH {MINED}, {NEGATIVES} SELECT split, count(DISTINCT query_id) AS num_queries, count(*) FILTER (type = 'positive') AS num_positives, count(*) FILTER (type LIKE 'hard_negative_bm25%') AS num_bm25_hard_negatives, count(*) FILTER (type LIKE 'hard_negative_dense%') AS num_dense_hard_negatives, count(*) FILTER (type = 'orthogonal_negative') AS num_orthogonal_negatives, count(*) AS total_pairs, count(*) FILTER (type <> 'positive') AS total_triples FROM prs GROUP BY split",
    "jsonl_roundtrip": f"WITH {CORPUS} SELECT doc_id::VARCHAR AS doc_id, '' AS category, md5(title) AS title_md5, md5(search_text) AS search_md5 FROM corpus",
    "embedding_cache": "SELECT vec_id::VARCHAR AS doc_id, len(embedding)::INT AS size, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm FROM embeddings",
    "insert_first_wins": "SELECT doc_id, source AS title, lang AS category FROM documents UNION ALL SELECT doc_id + 100, upper(source), upper(lang) FROM documents WHERE doc_id + 100 NOT IN (SELECT doc_id FROM documents)",
    "upsert_last_wins": "SELECT coalesce(o.doc_id, n.doc_id + 100) AS doc_id, CASE WHEN n.doc_id IS NULL THEN o.source ELSE upper(n.source) END AS title, CASE WHEN o.doc_id IS NULL THEN upper(n.lang) ELSE o.lang END AS category FROM documents o FULL JOIN documents n ON o.doc_id = n.doc_id + 100",
    "ingest_stream": "SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 5 = 0 THEN 'second' ELSE 'first' END AS version, 8 AS size FROM documents",
    "windowed_events": "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
}
SQL["monolithic_vs_maxp"] = f"""WITH {CORPUS}, {REL}, {bm25("mono_s", WHOLE_DOCS, f"SELECT item_id AS query_id, {words("lower(coalesce(text, ''))")} AS tokens FROM benchmark", 1.5)}, {top("mono", 50)},
bod AS (SELECT doc_id, title, abstract, {strip("coalesce(text, '')")} AS t FROM corpus JOIN documents USING (doc_id)),
blk AS (SELECT doc_id, title, abstract, list_filter(list_transform(string_split_regex(t, '\\n\\s*\\n'), lambda b: {strip("b")}), lambda b: length(b) > 60) AS bs FROM bod),
pp AS MATERIALIZED (SELECT doc_id || '-SEC-ABSTRACT' AS passage_id, doc_id AS parent, 'Title: ' || title || chr(10) || 'Abstract: ' || abstract AS text FROM bod WHERE abstract <> ''
  UNION ALL SELECT doc_id || '-PAR-' || lpad(i::VARCHAR, 4, '0'), doc_id, 'Title: ' || title || chr(10) || '[Paragraph ' || i || ']: ' || b FROM (SELECT doc_id, title, unnest(range(1, len(bs) + 1)) AS i, unnest(bs) AS b FROM blk)),
{bm25("pas_b", f"SELECT passage_id AS doc_id, {words('lower(text)')} AS tokens FROM pp", f"SELECT item_id AS query_id, {words("lower(coalesce(text, ''))")} AS tokens FROM benchmark", 1.5)},
pas_s AS (SELECT query_id, parent AS doc_id, max(round(raw, 6)) AS raw FROM pas_b JOIN pp ON pp.passage_id = pas_b.doc_id GROUP BY query_id, parent), {top("pas", 50, "raw")}
{" UNION ALL ".join(f"SELECT *, '{n}' AS strategy FROM ({means(measured(t), cut=False)})" for n, t in (("monolithic", "mono"), ("passage_maxp", "pas")))}"""

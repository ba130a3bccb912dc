"""The registered queries as SQL, written on their own from the definitions."""

from __future__ import annotations

from palimpsest import config
from palimpsest.functions.text import ACCENTED, PLAIN

STATES = ("INDEXED", "EMBEDDED", "FAILED", "PARSE_FAILED", "PENDING", "PARSED", "ABANDONED", "FORGET_FAILED")
MORE_DOMAINS = ("*.example.net", "blog.*", "thther.example.org")

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AS_OF = "TIMESTAMP '2025-01-01 00:00:00'"
_CORPUS = """corpus AS (
  SELECT doc_id AS document_id, text, lang, source, CASE doc_id % 4 WHEN 0 THEN 'filesystem' WHEN 1 THEN 'browser' WHEN 2 THEN 'terminal' ELSE 'clipboard' END AS source_type,
    source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.py' WHEN 3 THEN '.html' WHEN 4 THEN '.eml' ELSE '.pdf' END AS source_path,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INTEGER)) AS captured_at, sha256(text) AS checksum, replace(text, chr(10), chr(10) || chr(10)) AS body
  FROM documents)"""


def _fold(paras: str, target: int, overlap: int) -> str:
    return f"""paras AS ({paras}),
fold AS (
  SELECT document_id, ps, CAST(1 AS BIGINT) AS i, CAST('' AS VARCHAR) AS cur, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS done, CAST(0 AS BIGINT) AS done_start FROM paras
  UNION ALL
  SELECT document_id, ps, i + 1,
    CASE WHEN p = '' THEN cur WHEN flush THEN CASE WHEN length(cur) > {overlap} THEN right(cur, {overlap}) || chr(10) || chr(10) || p ELSE p END WHEN cur = '' THEN p ELSE cur || chr(10) || chr(10) || p END,
    CASE WHEN p = '' THEN start WHEN flush OR cur = '' THEN pos ELSE start END,
    CASE WHEN p = '' THEN pos + 1 ELSE pos + length(p) + 2 END,
    CASE WHEN p <> '' AND flush THEN cur END, start
  FROM (SELECT *, trim(ps[i], {_WHITE}) AS p, cur <> '' AND length(cur) + length(trim(ps[i], {_WHITE})) + 2 > {target} AS flush FROM fold WHERE i <= len(ps))
),
raw_chunks AS (
  SELECT document_id, i AS o, done AS t, done_start AS s FROM fold WHERE done IS NOT NULL
  UNION ALL SELECT document_id, i + 1, cur, start FROM fold WHERE i = len(ps) + 1 AND cur <> ''),
chunks AS (
  SELECT document_id, CAST(document_id AS VARCHAR) || ':' || CAST(row_number() OVER w - 1 AS VARCHAR) AS chunk_id, row_number() OVER w - 1 AS chunk_index, count(*) OVER (PARTITION BY document_id) AS total_chunks,
    trim(t, {_WHITE}) AS content, greatest(1, length(t) // 4) AS token_count, s AS start_char, s + length(t) AS end_char
  FROM raw_chunks WINDOW w AS (PARTITION BY document_id ORDER BY o))"""


_PARAS = r"SELECT document_id, string_split_regex(body, '\n\s*\n') AS ps FROM corpus"
_CHUNKS = _CORPUS + ",\n" + _fold(_PARAS, 1600, 200)
_LISTS = rf"""lists AS (SELECT chunk_id, document_id, regexp_extract_all(translate(lower(content), '{ACCENTED}', '{PLAIN}'), '[\p{{L}}\p{{N}}\p{{Co}}]+') AS terms FROM chunks)"""


_WORDS = r"""list_filter(string_split_regex(regexp_replace(regexp_replace({t}, '[*?(){{}}\[\]^:=!@#%&\\~]', ' ', 'g'), '(?i)\b(AND|OR|NOT|NEAR)\b', ' ', 'g'), '[ \t\n\r\x0B\x0C]+'), lambda x: x <> '')[1:20]"""


def _bm25(k: int, only: str = "chunks", query: str = "text") -> str:
    """CTEs up to bm25 and norm of the query set; statistics over all chunks, hits from `only`."""
    return rf"""{_LISTS},
places AS (SELECT chunk_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS position FROM lists),
asked_words AS (SELECT query_id, generate_subscripts(ws, 1) - 1 AS phrase, unnest(ws) AS word FROM (SELECT item_id AS query_id, {_WORDS.format(t=query)} AS ws FROM benchmark WHERE item_id % 20 = 0)),
asked AS (SELECT query_id, phrase, generate_subscripts(ps, 1) - 1 AS part, len(ps) AS size, unnest(ps) AS term FROM (SELECT query_id, phrase, regexp_extract_all(translate(lower(word), '{ACCENTED}', '{PLAIN}'), '[\p{{L}}\p{{N}}\p{{Co}}]+') AS ps FROM asked_words)),
whole AS (SELECT query_id, phrase, size, chunk_id, position - part AS at FROM places JOIN asked USING (term) GROUP BY ALL HAVING count(*) = size),
tf AS (SELECT query_id, phrase, chunk_id, count(*) AS tf FROM whole GROUP BY ALL),
df AS (SELECT query_id, phrase, count(*) AS n FROM tf GROUP BY ALL),
st AS (SELECT count(*) AS nn, avg(len(terms)) AS avgdl FROM lists),
ranks AS (
  SELECT query_id, chunk_id, round(sum(-(CASE WHEN ln((nn - n + 0.5) / (n + 0.5)) > 0 THEN ln((nn - n + 0.5) / (n + 0.5)) ELSE 1e-6 END) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / avgdl))), 9) AS rank
  FROM tf JOIN df USING (query_id, phrase) JOIN lists USING (chunk_id), st WHERE chunk_id IN (SELECT chunk_id FROM {only}) GROUP BY ALL),
bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS place FROM ranks) WHERE place <= {k}),
norm AS (SELECT query_id, chunk_id, 1 - (rank - min(rank) OVER w) / CASE WHEN max(rank) OVER w = min(rank) OVER w THEN 1.0 ELSE max(rank) OVER w - min(rank) OVER w END AS score FROM bm25 WINDOW w AS (PARTITION BY query_id))"""


def _cosine(asked: str) -> str:
    return f"""asked_vectors AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE {asked}),
sims AS (SELECT query_id, CAST(vec_id AS VARCHAR) || ':0' AS id, label, greatest(0.0, round(list_dot_product(CAST(embedding AS DOUBLE[]), qv) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(qv, qv))), 9)) AS similarity FROM embeddings, asked_vectors)"""


_COSINE = _cosine("vec_id % 20 = 0")
_NAME_LIST = r"list_distinct(list_concat(regexp_extract_all({t}, '\b([A-Z][a-z]+(?:[ \t\n\r]+[A-Z][a-z]+)+)\b', 1), regexp_extract_all({t}, '\b([A-Z][a-z]+)\b', 1)))"
_MENTIONS = f"mentions AS (SELECT document_id, captured_at, unnest({_NAME_LIST.format(t='text')}) AS name FROM corpus)"
_NAMES = f"names AS (SELECT item_id AS query_id, unnest({_NAME_LIST.format(t='text')}) AS name FROM benchmark WHERE item_id % 20 = 0)"
_ENTITIES = _CORPUS + ",\n" + _MENTIONS + ",\nentities AS (SELECT name AS canonical_name, 'CONCEPT' AS entity_type, min(captured_at) AS first_seen, max(captured_at) AS last_seen, count(*) AS mention_count FROM mentions GROUP BY name)"
_TIME = "strftime({c}, '%Y-%m-%d %H:%M:%S') AS {n}"


def _time(c: str) -> str:
    return _TIME.format(c=c, n=c.split(".")[-1])


def _hybrid(k: int, where: str = "true", prefilter: bool = False) -> str:
    """CTEs up to results(query_id, citation_index, ...)."""
    chunks = "own_chunks" if prefilter else "chunks"
    own = f"own_chunks AS (SELECT c.* FROM chunks c JOIN corpus d USING (document_id) WHERE {where}),\n" if prefilter else ""
    vectors = "sims JOIN own_chunks ON id = chunk_id" if prefilter else "sims"
    return f"""{_CHUNKS},
{own}{_bm25(k, chunks)},
{_cosine("vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 20 = 0)")},
near AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place FROM {vectors}),
{_MENTIONS},
{_NAMES},
signals AS (
  SELECT query_id, chunk_id, 'keyword' AS signal, score FROM norm
  UNION ALL SELECT query_id, id, 'vector', similarity FROM near WHERE place <= {k}
  UNION ALL SELECT DISTINCT query_id, chunk_id, 'graph', 0.8 FROM names JOIN mentions USING (name) JOIN {chunks} USING (document_id)),
dated AS (SELECT DISTINCT query_id, chunk_id, 'temporal' AS signal, exp(-0.005 * (epoch({_AS_OF}) - epoch(captured_at)) / 86400.0) AS score FROM signals JOIN {chunks} USING (chunk_id) JOIN corpus USING (document_id)),
every_signal AS (SELECT * FROM signals UNION ALL SELECT * FROM dated),
fused AS (
  SELECT query_id, chunk_id, coalesce(sum(score) FILTER (signal = 'vector'), 0.0) AS vector_score, coalesce(sum(score) FILTER (signal = 'keyword'), 0.0) AS keyword_score,
    coalesce(sum(score) FILTER (signal = 'graph'), 0.0) AS graph_score, coalesce(sum(score) FILTER (signal = 'temporal'), 0.0) AS temporal_score FROM every_signal GROUP BY query_id, chunk_id),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, chunk_id) AS place FROM (SELECT *, round(0.4 * vector_score + 0.3 * keyword_score + 0.2 * graph_score + 0.1 * temporal_score, 9) AS combined_score FROM fused)) WHERE place <= {k}),
results AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS citation_index, chunk_id, document_id, content, source_type, source_path, captured_at, combined_score, vector_score, keyword_score, graph_score, temporal_score
  FROM cut JOIN chunks USING (chunk_id) JOIN corpus d USING (document_id) WHERE {where})"""


_RESULT = f"SELECT query_id, citation_index, chunk_id, document_id, source_type, source_path, {_time('captured_at')}, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("combined_score", "vector_score", "keyword_score", "graph_score", "temporal_score")) + " FROM results"
_FILTER = "source_type = 'browser' AND captured_at >= TIMESTAMP '2024-01-02' AND captured_at <= TIMESTAMP '2024-02-01'"
_TURNS = "turns AS (SELECT conv_id AS session_id, CAST(turn AS BIGINT) AS turn, role, text AS content, TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn AS INTEGER)) AS created_at FROM conversations)"
_OBSERVED = "observed AS (SELECT CASE event_id % 4 WHEN 0 THEN 'fts_search_p95_ms' WHEN 1 THEN 'vector_search_p95_ms' WHEN 2 THEN 'hybrid_retrieval_p95_ms' ELSE 'forget_single_doc_ms' END AS metric, value, ts, event_id AS seq FROM events)"
_RANKS = _OBSERVED + """,
sorted AS (SELECT metric, count(*) AS n, list_sort(list(value)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, seq DESC) AS k FROM observed) WHERE k <= 1000 GROUP BY metric),
ranked AS (SELECT metric, n, """ + ", ".join(f"round(v[least(CAST(floor(n * {p} / 100) AS BIGINT), n - 1) + 1], 6) AS p{p}" for p in (50, 95, 99)) + " FROM sorted)"


def _secretive() -> str:
    cases = " ".join(f"WHEN {i} THEN ' {s}'" for i, s in enumerate(config.REDACTION_FIXTURES))
    return f"t AS (SELECT doc_id AS document_id, text || CASE doc_id % 7 {cases} END AS text FROM documents)"


def _chain(upto: int) -> str:
    out = "text"
    for _, pattern, marker in config.REDACTION_PATTERNS[:upto]:
        out = f"regexp_replace({out}, '{pattern}', '{marker}', 'g')"
    return out


def _domain_test(p: str) -> str:
    if p.startswith("*."):
        return f"ends_with(host, '{p[2:]}')"
    return f"starts_with(host, '{p[:-1]}')" if p.endswith(".*") else f"host = '{p}' OR ends_with(host, '.{p}')"


def _entropy(s: str) -> str:
    return f"(SELECT coalesce(sum(-c / n * log2(c / n)), 0.0) FROM (SELECT CAST(count(*) AS DOUBLE) AS c, CAST(length({s}) AS DOUBLE) AS n FROM (SELECT unnest(string_split({s}, '')) AS ch) WHERE ch <> '' GROUP BY ch))"


_TYPES = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in ends)}) THEN '{kind}'" for kind, ends in config.CONTENT_TYPES.items()) + " WHEN starts_with(t, '%PDF') THEN 'pdf' WHEN starts_with(t, '<') THEN 'html' ELSE 'plain' END"
_LANGS = "CASE " + " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in ends)}) THEN '{kind}'" for kind, ends in config.LANGUAGES.items()) + " ELSE 'unknown' END"
_COLLAPSE = r"trim(regexp_replace({x}, '[ \t\n\r\x0B\x0C]+', ' ', 'g'))"
_TITLE = _COLLAPSE.format(x="regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_BODY = _COLLAPSE.format(x="regexp_replace(html, '<[^>]+>', ' ', 'g')")
_RELATIONS = "own AS (SELECT name, count(*) AS own FROM mentions GROUP BY name), relations AS (SELECT subject, object, n_documents, n_documents / own AS confidence FROM (SELECT a.name AS subject, b.name AS object, count(*) AS n_documents FROM mentions a JOIN mentions b USING (document_id) WHERE a.name <> b.name GROUP BY ALL) p JOIN own ON name = subject WHERE n_documents >= 2 AND n_documents / own >= 0.5)"
_FORGOTTEN = "UNION ALL".join(f" SELECT '{n}' AS table_name, count(*) AS n_rows FROM {t} WHERE NOT ({{cond}}) " for n, t in (("chunks", "chunks"), ("documents", "corpus"), ("mentions", "mentions")))


def statements() -> dict[str, str]:
    w = "WITH RECURSIVE "
    memory = w + _CHUNKS + ",\n" + _MENTIONS
    browser = "document_id % 4 = 1"
    search = w + _hybrid(20)
    out = {
        "doc_dedup": f"{w}{_CORPUS} SELECT min(document_id) AS document_id, checksum FROM corpus GROUP BY checksum",
        "dedup_decision": "WITH t AS (SELECT doc_id, " + "[" + ", ".join(f"'{s}'" for s in STATES) + "][doc_id % 9 + 1] AS status, doc_id % 7 AS r FROM documents) SELECT doc_id AS document_id, status, CASE WHEN status IS NULL THEN 'NEW' WHEN status IN ('INDEXED', 'EMBEDDED') THEN 'SKIP' WHEN status IN ('FAILED', 'PARSE_FAILED') THEN CASE WHEN r >= 5 THEN 'SKIP' ELSE 'RERUN_CLEAN' END ELSE 'RERUN' END AS decision FROM t",
        "browser_allowed": "WITH t AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages) SELECT page_id, host FROM t WHERE NOT (" + " OR ".join(map(_domain_test, config.EXCLUDED_DOMAINS + MORE_DOMAINS)) + ")",
        "browser_documents": f"WITH t AS (SELECT url, {_TITLE} AS title, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages WHERE starts_with(url, 'http')) SELECT url AS source_path, title || chr(10) || url AS content, sha256(title || chr(10) || url) AS checksum, title, CAST(2 AS INTEGER) AS priority FROM t WHERE NOT (" + " OR ".join(map(_domain_test, config.EXCLUDED_DOMAINS)) + ")",
        "login_pages": "WITH t AS (SELECT page_id, lower(html || CASE WHEN page_id % 3 = 0 THEN '<FORM><input name=Password>' ELSE '' END) AS h FROM pages) SELECT page_id, contains(h, '<form') AND contains(h, 'password') AS login FROM t",
        "history_commands": rf"""{w}{_CORPUS}, t AS (SELECT unnest(string_split_regex(array_to_string(list_transform(string_split(': 1700000000:0;' || replace(body, ', ', chr(10) || chr(10) || ': 1700000001:0;'), chr(10)), lambda x: regexp_replace(x, '^: [^;]*;', '')), chr(10)), '\n[ \t]*\n')) AS c FROM corpus WHERE source_type = 'terminal'),
u AS (SELECT DISTINCT trim(c, {_WHITE}) AS content FROM t WHERE length(trim(c, {_WHITE})) >= 3) SELECT content, sha256(content) AS checksum, substr(content, 1, 200) AS preview FROM u""",
        "clipboard_changes": "WITH t AS (SELECT user_id % 50 AS stream, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS before FROM events WHERE trim(event_type) <> '') SELECT stream, event_id, event_type, sha256(event_type) AS checksum FROM t WHERE before IS DISTINCT FROM event_type",
        "queue_admission": "WITH t AS (SELECT event_id, event_id // 1000 AS batch, event_id % 4 AS priority, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS k FROM events) SELECT batch, event_id, priority, row_number() OVER (PARTITION BY batch ORDER BY priority, event_id) AS queue_position FROM t WHERE k <= 500",
        "queue_drops": "WITH t AS (SELECT event_id // 1000 AS batch, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS k FROM events) SELECT batch, count(*) FILTER (k > 500) AS dropped, count(*) FILTER (k <= 500) AS depth FROM t GROUP BY batch",
        "content_type_detect": rf"""{w}{_CORPUS}, p AS (SELECT document_id, CASE WHEN document_id % 5 = 0 THEN 'notes/' || CAST(document_id AS VARCHAR) ELSE source_path END AS path, CASE WHEN document_id % 10 = 0 THEN '%PDF' || text WHEN document_id % 10 = 5 THEN '<p>' || text ELSE text END AS t FROM corpus),
e AS (SELECT document_id, t, regexp_extract(lower(string_split(path, '/')[-1]), '[^.](\.[^.]*)$', 1) AS ext FROM p) SELECT document_id, {_TYPES} AS content_type, {_LANGS} AS language FROM e""",
        "html_strip": f"WITH t AS (SELECT page_id, {_TITLE} AS title, {_BODY} AS body FROM pages) SELECT page_id, title, CASE WHEN title <> '' THEN title || chr(10) || chr(10) || body ELSE body END AS clean_content FROM t",
        "pdf_clean": f"{w}{_CORPUS}, t AS (SELECT document_id, array_to_string(list_filter(list_transform(string_split(replace(body, ' ', '  '), chr(10)), lambda x: {_COLLAPSE.format(x='x')}), lambda x: x <> ''), chr(10)) AS clean_content FROM corpus) SELECT document_id, clean_content, CAST(greatest(1, length(clean_content) // 3000) AS BIGINT) AS page_count FROM t",
        "code_symbols": r"""WITH t AS (SELECT doc_id, 'def alpha(x):' || chr(10) || '    ""\"about alpha""\"' || chr(10) || 'async def beta():' || chr(10) || '  pass' || chr(10) || 'class Gamma:' || chr(10) || text AS s FROM documents)
SELECT doc_id AS document_id, CASE WHEN doc_id % 2 = 0 THEN array_to_string(list_concat(regexp_extract_all(s, '(?m)^(?:async[ \t]+)?def[ \t]+([A-Za-z0-9_]+)', 1), regexp_extract_all(s, '(?m)^class[ \t]+([A-Za-z0-9_]+)', 1)), ',')
  ELSE array_to_string(regexp_extract_all(s, '(?:function|def|class|fn|struct|impl|interface|pub fn)[ \t\n\r]+([A-Za-z0-9_]+)', 1), ',') END AS symbols,
  CASE WHEN doc_id % 2 = 0 THEN array_to_string(regexp_extract_all(s, '(?s)"{3}(.*?)"{3}', 1), '|') ELSE array_to_string(regexp_extract_all(s, '(?s)/\*\*?(.*?)\*/', 1), '|') END AS docs,
  length(s) - length(replace(s, chr(10), '')) + 1 AS line_count FROM t""".replace('""\\"', '"""'),
        "word_char_count": r"SELECT doc_id AS document_id, CAST(len(regexp_extract_all(text, '[^ \t\n\r\x0B\x0C]+')) AS BIGINT) AS word_count, length(text) AS char_count FROM documents",
        "redact_patterns": f"WITH {_secretive()} SELECT document_id, {_chain(7)} AS redacted FROM t",
        "redact_counts": f"WITH {_secretive()} SELECT document_id, " + ", ".join(f"CAST(len(regexp_extract_all({_chain(i)}, '{p}')) AS BIGINT) AS {n}" for i, (n, p, _) in enumerate(config.REDACTION_PATTERNS)) + " FROM t",
        "redact_entropy": f"""WITH RECURSIVE t AS (SELECT doc_id AS document_id, text || ' token= ' || sha256(text) || 'QwErTyUiOpZxCvBnM' || ' end' AS text FROM documents),
r AS (SELECT document_id, text, regexp_extract_all(text, '{config.ENTROPY_RUN}') AS runs FROM t),
e AS (SELECT document_id, run, sum(-c / n * log2(c / n)) AS h FROM (SELECT document_id, run, CAST(length(run) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS c FROM (SELECT DISTINCT document_id, run, generate_subscripts(string_split(run, ''), 1) AS k, unnest(string_split(run, '')) AS ch FROM (SELECT document_id, unnest(runs) AS run FROM r)) GROUP BY document_id, run, ch) GROUP BY document_id, run),
hs AS (SELECT document_id, text, runs, list_transform(runs, lambda x: hm[x]) AS hh FROM r LEFT JOIN (SELECT document_id, map_from_entries(list((run, h))) AS hm FROM e GROUP BY document_id) USING (document_id)),
f AS (SELECT document_id, runs, hh, 1 AS i, text FROM hs
  UNION ALL SELECT document_id, runs, hh, i + 1, CASE WHEN place > 0 AND hh[i] >= 4.5 AND ({' OR '.join(f"contains(ctx, '{x}')" for x in config.ENTROPY_INDICATORS)}) THEN replace(text, run, '{config.ENTROPY_MARKER}') ELSE text END
  FROM (SELECT *, lower(substr(text, CAST(greatest(1, place - 30) AS BIGINT), CAST(least(30, place - 1) + length(run) + 30 AS BIGINT))) AS ctx FROM (SELECT *, runs[i] AS run, strpos(text, runs[i]) AS place FROM f WHERE i <= len(runs))))
SELECT document_id, text AS redacted FROM f WHERE i = coalesce(len(runs), 0) + 1""",
        "entropy_runs": f"""WITH t AS (SELECT doc_id AS document_id, regexp_extract_all(text || ' ' || sha256(text), '{config.ENTROPY_RUN}') AS runs FROM documents),
r AS (SELECT document_id, generate_subscripts(runs, 1) - 1 AS position, unnest(runs) AS run FROM t),
c AS (SELECT document_id, position, run, unnest(string_split(run, '')) AS ch FROM r), g AS (SELECT document_id, position, run, ch, CAST(count(*) AS DOUBLE) AS k FROM c GROUP BY ALL)
SELECT document_id, position, run, round(sum(-k / length(run) * log2(k / length(run))) + 0.0, 6) AS entropy FROM g GROUP BY document_id, position, run""",
        "chunk_prose": f"{w}{_CHUNKS} SELECT * FROM chunks",
        "chunk_email": f"{w}{_CORPUS}, {_fold(_PARAS, 800, 80)} SELECT * FROM chunks",
        "chunk_code": f"{w}{_CORPUS}, " + _fold(r"SELECT document_id, CASE WHEN len(bs) > 1 THEN bs ELSE string_split_regex(code, '\n\s*\n') END AS ps FROM (SELECT *, string_split(regexp_replace(code, '\n(def |class |function |async |pub |fn |impl )', chr(1) || '\1', 'g'), chr(1)) AS bs FROM (SELECT *, replace(text, chr(10), chr(10) || 'def ') AS code FROM corpus))", 1200, 120) + " SELECT * FROM chunks",
        "chunk_stats": f"{w}{_CHUNKS} SELECT source_type, count(*) AS n_chunks, CAST(sum(token_count) AS BIGINT) AS tokens, max(total_chunks) AS most FROM chunks JOIN corpus USING (document_id) GROUP BY source_type",
        "token_postings": f"{w}{_CHUNKS}, {_LISTS} SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(terms) AS term FROM lists) GROUP BY ALL",
        "corpus_stats": f"{w}{_CHUNKS}, {_LISTS} SELECT count(*) AS n_chunks, round(avg(len(terms)), 6) AS avgdl FROM lists",
        "fts_sanitise": r"""WITH t AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(regexp_replace(text || ' AND (x:y) "q" not near*', '[*?(){}\[\]^:=!@#%&\\~]', ' ', 'g'), '(?i)\b(AND|OR|NOT|NEAR)\b', ' ', 'g'), '[ \t\n\r\x0B\x0C]+'), lambda x: x <> '')[1:20] AS ws FROM benchmark)
SELECT item_id, CASE WHEN len(ws) > 0 THEN array_to_string(list_transform(ws, lambda x: '"' || replace(x, '"', '""') || '"'), ' OR ') ELSE '""' END AS expression FROM t""",
        "bm25_topk": f"{w}{_CHUNKS}, {_bm25(20)} SELECT query_id, chunk_id, round(rank, 6) AS rank, place FROM bm25",
        "keyword_norm": f"{w}{_CHUNKS}, {_bm25(20)} SELECT query_id, chunk_id, round(score, 6) AS score FROM norm",
        "phrase_search": f"{w}{_CHUNKS}, " + _bm25(50, query="regexp_replace(text, '([A-Za-z]+) ([A-Za-z]+)', '\\1-\\2', 'g')") + " SELECT query_id, chunk_id, round(rank, 6) AS rank FROM bm25",
        "cosine_topk": f"WITH {_COSINE} SELECT query_id, id, round(similarity, 6) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place FROM sims) WHERE place <= 20",
        "vector_where": f"WITH {_COSINE} SELECT query_id, id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS place FROM sims WHERE label = 1) WHERE place <= 10",
        "migration_progress": f"{w}{_CHUNKS}, t AS (SELECT count(*) AS total_chunks, count(v.id) AS migrated_chunks FROM chunks LEFT JOIN (SELECT DISTINCT CAST(vec_id AS VARCHAR) || ':0' AS id FROM embeddings) v ON id = chunk_id) SELECT total_chunks, migrated_chunks, CASE WHEN total_chunks = 0 THEN 0.0 ELSE round(100.0 * migrated_chunks / total_chunks, 1) END AS progress_pct, CASE WHEN total_chunks = migrated_chunks THEN 'COMPLETE' ELSE 'IN_PROGRESS' END AS status FROM t",
        "query_entities": f"SELECT item_id, unnest({_NAME_LIST.format(t='text')}) AS name FROM benchmark",
        "entity_rollup": f"{w}{_ENTITIES} SELECT canonical_name, entity_type, {_time('first_seen')}, {_time('last_seen')}, mention_count FROM entities",
        "stored_entities": f"{w}{_ENTITIES.replace('FROM mentions GROUP', 'FROM mentions WHERE document_id % 5 <> 2 GROUP')} SELECT canonical_name, entity_type, {_time('first_seen')}, {_time('last_seen')}, mention_count FROM entities",
        "stored_relations": f"{w}{_CORPUS}, {_MENTIONS.replace('FROM corpus', 'FROM corpus WHERE document_id % 5 <> 2')}, {_RELATIONS} SELECT subject, object, n_documents, round(confidence, 6) AS confidence FROM relations",
        "entity_upsert": f"{w}{_ENTITIES} SELECT canonical_name, entity_type, {_time('first_seen')}, {_time('last_seen')}, mention_count FROM entities",
        "entity_search": f"{w}{_ENTITIES} SELECT canonical_name, entity_type, mention_count FROM entities WHERE contains(lower(canonical_name), 'tion') ORDER BY canonical_name LIMIT 50",
        "entity_top": f"{w}{_ENTITIES} SELECT canonical_name, mention_count FROM entities ORDER BY mention_count DESC, canonical_name LIMIT 20",
        "graph_neighbors": f"{w}{_CORPUS}, {_MENTIONS}, {_NAMES} SELECT DISTINCT query_id, document_id FROM names JOIN mentions USING (name)",
        "graph_2hop": f"{w}{_CORPUS}, {_MENTIONS}, h1 AS (SELECT DISTINCT s.document_id AS query_id, m.document_id FROM mentions s JOIN mentions m USING (name) WHERE s.document_id % 20 = 0), n2 AS (SELECT DISTINCT query_id, name FROM h1 JOIN mentions USING (document_id)) SELECT query_id, document_id FROM h1 UNION SELECT query_id, document_id FROM n2 JOIN mentions USING (name)",
        "graph_nodes": f"{memory} SELECT 'Document' AS kind, count(*) AS n FROM corpus UNION ALL SELECT 'Chunk', count(*) FROM chunks WHERE document_id IN (SELECT document_id FROM mentions) UNION ALL SELECT 'Entity', count(DISTINCT name) FROM mentions",
        "graph_edges": f"{memory}, {_RELATIONS}, e AS (SELECT DISTINCT 'MENTIONED_IN' AS kind, name AS src, CAST(document_id AS VARCHAR) AS dst, CAST(1 AS DOUBLE) AS confidence FROM mentions UNION ALL SELECT 'CONTAINS', CAST(document_id AS VARCHAR), chunk_id, CAST(1 AS DOUBLE) FROM chunks WHERE document_id IN (SELECT document_id FROM mentions) UNION ALL SELECT 'RELATED_TO', subject, object, confidence FROM relations) SELECT kind, src, count(*) AS n, min(dst) AS least, round(sum(CAST(confidence AS DOUBLE)), 4) AS confidence FROM e GROUP BY kind, src",
        "graph_forget": f"{memory} SELECT 'MENTIONED_IN' AS kind, count(*) AS n FROM mentions WHERE NOT ({browser}) UNION ALL SELECT 'CONTAINS', count(*) FROM chunks WHERE NOT ({browser}) AND document_id IN (SELECT document_id FROM mentions)",
        "relation_filter": f"{w}{_CORPUS}, {_MENTIONS}, {_RELATIONS} SELECT subject, 'CO_OCCURS' AS predicate, object, round(confidence, 6) AS confidence FROM relations WHERE contains(lower(subject), 'th') AND contains(lower(object), 'an') ORDER BY confidence DESC, subject, object LIMIT 40",
        "entity_detail": f"{w}{_CORPUS}, {_MENTIONS} SELECT name, document_id, source_type, source_path, {_time('c.captured_at')} FROM mentions JOIN corpus c USING (document_id) WHERE name = 'Enti'",
        "relations_cooccur": f"{w}{_CORPUS}, {_MENTIONS}, {_RELATIONS} SELECT subject, object, n_documents, round(confidence, 6) AS confidence FROM relations",
        "graph_counts": f"{memory} SELECT (SELECT count(DISTINCT name) FROM mentions) AS n_entities, (SELECT count(*) FROM mentions) AS n_mentions, (SELECT count(*) FROM corpus) AS n_documents, (SELECT count(*) FROM chunks) AS n_chunks",
        "temporal_decay": f"{w}{_CORPUS} SELECT document_id, round(exp(-0.005 * (epoch({_AS_OF}) - epoch(captured_at)) / 86400.0), 6) AS score FROM corpus",
        "hybrid_search": f"{search} {_RESULT}",
        "hybrid_search_filtered": f"{w}{_hybrid(50, _FILTER)} {_RESULT}",
        "hybrid_search_prefilter": f"{w}{_hybrid(50, _FILTER, True)} {_RESULT}",
        "timeline_page": f"{w}{_CORPUS} SELECT document_id, source_type, source_path, {_time('captured_at')} FROM (SELECT * FROM corpus WHERE {_FILTER} ORDER BY captured_at DESC, document_id LIMIT 25 OFFSET 10)",
        "document_detail": f"{w}{_CHUNKS} SELECT document_id, source_path, chunk_index, content FROM corpus JOIN chunks USING (document_id) WHERE document_id = 7",
        "context_budget": f"{search}, b AS (SELECT query_id, citation_index, chunk_id, CAST(sum(greatest(1, length(content) // 4)) OVER (PARTITION BY query_id ORDER BY citation_index) AS BIGINT) AS context_tokens FROM results) SELECT * FROM b WHERE context_tokens <= 4000",
        "context_block": f"{search}, b AS (SELECT *, sum(greatest(1, length(content) // 4)) OVER (PARTITION BY query_id ORDER BY citation_index) AS used FROM results) SELECT query_id, string_agg('[Source ' || citation_index || '] (captured: ' || strftime(captured_at, '%Y-%m-%d') || ', from: ' || source_type || ' — ' || source_path || ')' || chr(10) || content, chr(10) || chr(10) ORDER BY citation_index) AS context FROM b WHERE used <= 6000 GROUP BY query_id",
        "history_last_n": f"WITH {_TURNS} SELECT session_id, turn, role, content FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS k FROM turns) WHERE k <= 6",
        "history_block": f"WITH {_TURNS} SELECT session_id, string_agg(upper(role) || ': ' || content, chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS k FROM turns) WHERE k <= 6 GROUP BY session_id",
        "citation_extract": r"WITH t AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text || ' [Source ' || CAST(turn % 5 + 1 AS VARCHAR) || '] and [Source 2][Source 2]', '\[Source ([0-9]+)\]', 1))) AS s FROM conversations) SELECT conv_id, turn, CAST(s AS BIGINT) AS source FROM t",
        "citation_cards": f"{search} SELECT query_id, citation_index, chunk_id, document_id, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS snippet, round(combined_score, 4) AS score FROM results WHERE citation_index IN (1, 3, 99)",
        "session_list": f"WITH {_TURNS}, t AS (SELECT session_id, min(created_at) AS created_at, max(created_at) AS last_active, count(*) AS n_turns, substr(arg_min(content, turn) FILTER (role = 'user'), 1, 100) AS title FROM turns GROUP BY session_id ORDER BY last_active DESC, session_id LIMIT 20) SELECT session_id, {_time('created_at')}, {_time('last_active')}, n_turns, title FROM t",
        "forget_document": memory + _FORGOTTEN.format(cond="document_id IN (7, 11)"),
        "forget_by_source": memory + _FORGOTTEN.format(cond=browser),
        "forget_verify": f"{memory} SELECT 'chunks' AS table_name, CAST(0 AS BIGINT) AS remaining, true AS verified UNION ALL SELECT 'documents', 0, true UNION ALL SELECT 'mentions', 0, true UNION ALL SELECT 'kept_chunks', count(*), count(*) = 0 FROM chunks WHERE {browser}",
        "orphan_entities": f"{w}{_CORPUS}, {_MENTIONS} SELECT name AS canonical_name FROM mentions GROUP BY name HAVING count(*) FILTER (document_id % 4 <> 1) = 0",
        "purge_raw": f"{w}{_CORPUS} SELECT document_id, captured_at < TIMESTAMP '2024-01-13 12:00:00' AS purged, CASE WHEN captured_at < TIMESTAMP '2024-01-13 12:00:00' THEN '2024-01-20 12:00:00' END AS raw_purged_at FROM corpus",
        "retry_state": "SELECT doc_id AS document_id, CASE WHEN doc_id % 3 <> 0 THEN 'PARSED' WHEN doc_id % 6 + 1 >= 5 THEN 'ABANDONED' ELSE 'FAILED' END AS status, CAST(doc_id % 6 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS retry_count FROM documents",
        "status_update": "SELECT doc_id AS document_id, coalesce(s, 'PENDING') AS status FROM documents LEFT JOIN (SELECT user_id, arg_max(upper(event_type), (ts, event_id)) AS s FROM events GROUP BY user_id) ON user_id = doc_id",
        "chunk_vectors": f"{w}{_CHUNKS} SELECT chunk_id, id AS vector_id, CASE WHEN id IS NOT NULL THEN '2025-01-01 00:00:00' END AS embedded_at FROM chunks LEFT JOIN (SELECT CAST(vec_id AS VARCHAR) || ':0' AS id FROM embeddings) v ON id = chunk_id",
        "expired_turns": f"WITH {_TURNS} SELECT session_id, turn FROM turns WHERE created_at < TIMESTAMP '2024-01-04 00:00:00'",
        "stats_overview": f"{memory}, {_TURNS}, {_RELATIONS}, a AS (SELECT count(*) AS documents, count(*) FILTER (document_id % 11 = 0) AS failed FROM corpus), b AS (SELECT count(*) AS chunks, count(v.id) AS embedded_chunks FROM chunks LEFT JOIN (SELECT CAST(vec_id AS VARCHAR) || ':0' AS id FROM embeddings) v ON id = chunk_id), c AS (SELECT count(DISTINCT document_id) AS linked_documents, count(DISTINCT name) AS entities FROM mentions) SELECT documents, failed, chunks, embedded_chunks, entities, linked_documents, (SELECT count(*) FROM relations) AS relations, (SELECT count(DISTINCT session_id) FROM turns) AS conversations, (SELECT string_agg(source_type || ':' || n, ',' ORDER BY source_type) FROM (SELECT source_type, count(*) AS n FROM corpus GROUP BY source_type)) AS by_source, CASE WHEN chunks = 0 THEN 0.0 ELSE round(100.0 * embedded_chunks / chunks, 1) END AS embedding_coverage_pct, CASE WHEN documents = 0 THEN 0.0 ELSE round(100.0 * linked_documents / documents, 1) END AS graph_coverage_pct FROM a, b, c",
        "health_check": "WITH t AS (SELECT event_type, max(value) < 400 AS ok FROM events GROUP BY event_type) SELECT bool_and(ok) AS healthy, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (NOT ok), '') AS failing FROM t",
        "throughput_check": f"WITH {_RANKS} SELECT metric, p50 * 50 > 0 AND 60000.0 / (p50 * 50) < 10 AS violated FROM ranked",
        "model_registry": "WITH l AS (SELECT event_id, event_type AS name, CAST(user_id % 3 AS VARCHAR) AS version, event_type || '-' || (user_id % 3) AS model_id, ['RUNNING', 'COMPLETE', 'ACTIVE', 'FAILED', 'CANCELLED'][event_id % 5 + 1] AS status, strftime(ts, '%Y-%m-%d') AS noted_at FROM events) SELECT model_id, name, version, 'vectors-' || name AS path, min(noted_at) AS registered_at, arg_max(status, event_id) AS status, coalesce(model_id = (SELECT arg_max(model_id, event_id) FROM l WHERE status = 'ACTIVE'), false) AS is_active FROM l GROUP BY model_id, name, version",
        "migration_check": f"{w}{_CHUNKS}, t AS (SELECT count(*) AS chunks, count(id) AS vectors, count(*) FILTER (id IS NULL) AS missing, CAST(0 AS BIGINT) AS empty FROM chunks LEFT JOIN (SELECT CAST(vec_id AS VARCHAR) || ':0' AS id FROM embeddings) v ON id = chunk_id) SELECT *, missing = 0 AS valid FROM t",
        "file_admission": f"{w}{_CORPUS}, t AS (SELECT document_id, ['home/', 'home/.git/', '.cache/x/', 'home/.config/', 'a/node_modules/'][document_id % 5 + 1] || CAST(document_id AS VARCHAR) || ['', '.swp', '.tmp', '.md'][document_id % 4 + 1] AS path, CASE WHEN document_id % 7 = 0 THEN 0 WHEN document_id % 9 = 0 THEN 62914560 ELSE length(text) END AS size FROM corpus) SELECT document_id, size > 0 AND size <= {config.MAX_FILE_BYTES} AND document_id % 5 NOT IN (1, 2) AND document_id % 4 NOT IN (1, 2) AS admitted FROM t",
        "file_documents": "SELECT DISTINCT sha256(text) AS checksum, 'filesystem' AS source_type, strlen(text) AS n_bytes, CAST(strlen(text) AS VARCHAR) AS size, CAST(2 AS INTEGER) AS priority FROM documents WHERE strlen(text) > 0",
        "browser_visits": f"WITH u AS (SELECT page_id, url, {_TITLE} AS title FROM pages WHERE starts_with(url, 'http')), v AS (SELECT event_id AS visit_id, event_id % 2 AS b, url, title FROM events JOIN u ON user_id % 300 = page_id) SELECT 'chrome' AS browser, visit_id, url, title FROM (SELECT * FROM v WHERE b = 0 AND visit_id > 100 ORDER BY visit_id LIMIT 200) UNION ALL SELECT 'firefox', visit_id, url, title FROM (SELECT * FROM v WHERE b = 1 AND visit_id > 700 ORDER BY visit_id LIMIT 200)",
        "email_parse": f"SELECT doc_id AS document_id, rtrim('Subject: note ' || doc_id || chr(10) || 'From: a@example.org' || chr(10) || 'Date: Mon, 01 Jan 2024 00:00:00 +0000' || chr(10) || chr(10) || text, {_WHITE}) AS clean_content FROM documents",
        "chat_answers": f"{search} SELECT query_id, substr(string_split(content, chr(10))[1], 1, 200) || ' [Source 1]' AS answer FROM results WHERE citation_index = 1",
        "search_projection": f"{search} SELECT query_id, citation_index, chunk_id, document_id, source_type, source_path, strftime(captured_at, '%Y-%m-%d') AS captured, round(combined_score, 4) AS score, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS snippet FROM results",
        "timeline_status": f"{w}{_CORPUS} SELECT document_id, {_time('captured_at')} FROM (SELECT * FROM corpus WHERE document_id % 11 = 0 AND captured_at >= TIMESTAMP '2024-01-02' ORDER BY captured_at DESC, document_id LIMIT 200 OFFSET 2)",
        "chat_turns": f"WITH {_TURNS}, l AS (SELECT session_id, max(turn) AS last, arg_min(content, turn) AS query FROM turns WHERE session_id % 20 = 0 GROUP BY session_id HAVING min(turn) = 0) SELECT session_id, last + 1 AS turn, 'user' AS role, query AS content, '2025-01-01 00:00:00' AS created_at FROM l UNION ALL SELECT session_id, last + 2, 'assistant', 'Noted.', '2025-01-01 00:00:00' FROM l",
        "session_delete": f"WITH {_TURNS} SELECT session_id, count(*) AS n_turns FROM turns WHERE session_id % 20 <> 0 GROUP BY session_id",
        "stream_ingest": "SELECT min(doc_id) AS arrival, sha256(text) AS checksum, min(doc_id) % 4 AS priority FROM documents GROUP BY sha256(text)",
        "stream_metrics": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY date_trunc('day', ts), event_type HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)",
        "count_by_source": f"{w}{_CORPUS} SELECT source_type, count(*) AS n_documents FROM corpus GROUP BY source_type",
        "latency_percentiles": f"WITH {_RANKS} SELECT * FROM ranked",
        "metric_gauges": f"WITH {_OBSERVED} SELECT metric, round(sum(value), 4) AS counter, round(arg_max(value, (ts, seq)), 6) AS gauge FROM observed GROUP BY metric",
        "slo_report": f"WITH {_RANKS}, slos(slo, metric, target, alert_threshold) AS (VALUES " + ", ".join(f"('{a}', '{b}', CAST({c} AS DOUBLE), CAST({d} AS DOUBLE))" for a, b, c, d in config.SLOS) + ") SELECT slo, metric, target, alert_threshold, round(p95, 2) AS p95, coalesce(p95 <= alert_threshold, true) AS passed FROM slos LEFT JOIN ranked USING (metric)",
        "stream_dedup": "SELECT DISTINCT sha256(text) AS checksum FROM documents",
    }
    out["stream_seen_state"] = out["stream_ingest"]
    return out | {f"stored_{name}": out[same] for name, same in (("bm25", "bm25_topk"), ("phrases", "phrase_search"), ("hybrid", "hybrid_search"))}

"""DuckDB SQL for the correctness gate: the same rules, written independently.

The driver registers the parquet tables as views; every query here starts from
them. Shared pieces are CTE builders so long pipelines stay readable.
"""

from __future__ import annotations

from quire.fixtures import FIXTURE_EFFECT_TERMS, FIXTURE_TOPICS, HISTORY_RUNS, PHRASE_EFFECTS, PHRASE_TOPICS

NL = "chr(10)"
# Runs of letters, marks and digits; single characters in unspaced blocks.
_ONE = (r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}"
        r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}")
_RUN = "[" + _ONE + "]|(?:" + "|".join(rf"[^\P{{{c}}}{_ONE}]" for c in "LMN") + ")+"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{_RUN}')"


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return str(v)
    if hasattr(v, "strftime"):
        return f"TIMESTAMP '{v.strftime('%Y-%m-%d %H:%M:%S')}'"
    return "'" + str(v).replace("'", "''") + "'"


def topics_cte(name: str = "topics", rows=None) -> str:
    rows = FIXTURE_TOPICS if rows is None else rows
    vals = ",\n    ".join(
        f"({r[0]}, {_lit(r[1])}, {_lit(r[2])}, CAST({_lit(r[3])} AS INTEGER), "
        f"CAST({_lit(r[4])} AS INTEGER), {_lit(r[5])})" for r in rows)
    return (f"{name} AS (SELECT * FROM (VALUES\n    {vals}) "
            f"v(topic_id, compound, disease, start_year, end_year, refresh))")


def history_topics_cte(name: str = "htopics") -> str:
    return topics_cte(name, [(r[0], r[1], r[2], r[3], r[4], False) for r in HISTORY_RUNS])


def history_times_cte(name: str = "htimes") -> str:
    vals = ", ".join(f"({r[0]}, {_lit(r[5])})" for r in HISTORY_RUNS)
    return f"{name} AS (SELECT * FROM (VALUES {vals}) v(topic_id, ts))"


# ------------------------------------------------------------------ article view

def _pad2(e: str) -> str:
    return f"lpad(CAST({e} AS VARCHAR), 2, '0')"


RAW_DATE = f"""CASE doc_id % 7
      WHEN 0 THEN CAST(1990 + doc_id % 35 AS VARCHAR) || '-' || {_pad2('1 + doc_id % 12')} || '-' || {_pad2('1 + doc_id % 28')}
      WHEN 1 THEN CAST(1990 + doc_id % 35 AS VARCHAR) || '/' || {_pad2('1 + doc_id % 12')}
      WHEN 2 THEN CAST(1990 + doc_id % 35 AS VARCHAR)
      WHEN 3 THEN CAST(1990 + doc_id % 35 AS VARCHAR) || ' Jan 15'
      WHEN 4 THEN CAST(1990 + doc_id % 35 AS VARCHAR) || 'Spring'
      WHEN 5 THEN ''
      ELSE CAST(1990 + doc_id % 35 AS VARCHAR) || '-13-01' END"""


def parse_date_sql(dp: str) -> str:
    """Nullable TIMESTAMP by the same rules (text before the first space, >= 4
    characters, year 1-4, month 6-7, day 9-10, any failure is null)."""
    head = f"split_part(coalesce({dp}, ''), ' ', 1)"
    y = f"TRY_CAST(substr({head}, 1, 4) AS INTEGER)"
    m = f"(CASE WHEN length({head}) >= 7 THEN TRY_CAST(substr({head}, 6, 2) AS INTEGER) ELSE 1 END)"
    d = f"(CASE WHEN length({head}) >= 10 THEN TRY_CAST(substr({head}, 9, 2) AS INTEGER) ELSE 1 END)"
    return (f"(CASE WHEN length({head}) >= 4 AND {y} >= 1 AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 "
            f"THEN TRY_CAST(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS TIMESTAMP) END)")


ARTS = f"""arts AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS pmid,
         split_part(coalesce(text, ''), {NL}, 1) AS title,
         substring(coalesce(text, ''), length(split_part(coalesce(text, ''), {NL}, 1)) + 2) AS abstract,
         coalesce(source, '') AS journal, [coalesce(lang, '')] AS keywords,
         {RAW_DATE} AS dp
  FROM documents),
arts_d AS (
  SELECT *, {parse_date_sql('dp')} AS pub_parsed,
         coalesce({parse_date_sql('dp')}, TIMESTAMP '2024-06-01 00:00:00') AS pub_date
  FROM arts)"""

DOC_TOKS = f"""doc_toks AS (
  SELECT doc_id, pmid, CAST(year(pub_parsed) AS INTEGER) AS yr,
         {toks("title || " + NL + " || abstract")} AS toks
  FROM arts_d),
stats AS (SELECT CAST(count(*) AS DOUBLE) AS n_docs, avg(len(toks)) AS avgdl FROM doc_toks)"""


def _q(e: str) -> str:
    return f"'\"' || {e} || '\"'"


RESPONSE_SQL = f"""CASE WHEN doc_id % 5 = 4 THEN 'no object here' ELSE
  'Sure: {{"effect_type": ' || {_q("CASE doc_id % 5 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' ELSE 'unclear' END")}
  || ', "evidence_strength": ' || {_q("CASE doc_id % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'moderate' ELSE 'weak' END")}
  || CASE doc_id % 4 WHEN 0 THEN ''
       WHEN 1 THEN ', "findings": [' || {_q("'f' || CAST(doc_id AS VARCHAR) || '.0'")} || ']'
       ELSE ', "findings": [' || {_q("'f' || CAST(doc_id AS VARCHAR) || '.0'")} || ', ' || {_q("'f' || CAST(doc_id AS VARCHAR) || '.1'")} || ']' END
  || ', "conclusion": ' || {_q("'c' || CAST(doc_id AS VARCHAR)")} || '}} done' END"""

RESP = f"""resp AS (SELECT CAST(doc_id AS VARCHAR) AS pmid, {RESPONSE_SQL} AS response FROM documents)"""

BASE = ARTS + ",\n" + DOC_TOKS + ",\n" + RESP


# ------------------------------------------------------------------ matching + BM25

def _effect_values(terms) -> str:
    return ", ".join(f"({i}, {_lit(t)})" for i, t in enumerate(terms))


def match_ctes(p: str, topics: str, effect_terms=FIXTURE_EFFECT_TERMS) -> str:
    """CTEs ``{p}_matched(topic_id, doc_id, pmid, yr, score)``: single-token
    terms (the fixture topics have no phrase)."""
    return f"""{p}_eff AS (SELECT * FROM (VALUES {_effect_values(effect_terms)}) v(gidx, term)),
{p}_groups AS (
  SELECT topic_id, lo, hi, kind, toks, len(toks) AS glen FROM (
    SELECT topic_id,
           CASE WHEN coalesce(start_year, 0) <> 0 THEN start_year WHEN coalesce(end_year, 0) <> 0 THEN 1900 END AS lo,
           CASE WHEN coalesce(end_year, 0) <> 0 THEN end_year WHEN coalesce(start_year, 0) <> 0 THEN 3000 END AS hi,
           'compound' AS kind, {toks('compound')} AS toks
    FROM {topics} WHERE trim(coalesce(compound, '')) <> '' AND trim(coalesce(disease, '')) <> ''
    UNION ALL
    SELECT topic_id,
           CASE WHEN coalesce(start_year, 0) <> 0 THEN start_year WHEN coalesce(end_year, 0) <> 0 THEN 1900 END,
           CASE WHEN coalesce(end_year, 0) <> 0 THEN end_year WHEN coalesce(start_year, 0) <> 0 THEN 3000 END,
           'disease', {toks('disease')}
    FROM {topics} WHERE trim(coalesce(compound, '')) <> '' AND trim(coalesce(disease, '')) <> ''
    UNION ALL
    SELECT topic_id,
           CASE WHEN coalesce(start_year, 0) <> 0 THEN start_year WHEN coalesce(end_year, 0) <> 0 THEN 1900 END,
           CASE WHEN coalesce(end_year, 0) <> 0 THEN end_year WHEN coalesce(start_year, 0) <> 0 THEN 3000 END,
           'effect', {toks('e.term')}
    FROM {topics}, {p}_eff e WHERE trim(coalesce(compound, '')) <> '' AND trim(coalesce(disease, '')) <> ''
  ) WHERE len(toks) > 0),
{p}_terms AS (
  SELECT topic_id, token, lo, hi,
         bool_or(kind = 'compound' AND glen = 1) AS c1,
         bool_or(kind = 'disease' AND glen = 1) AS d1,
         bool_or(kind = 'effect' AND glen = 1) AS e1
  FROM (SELECT topic_id, lo, hi, kind, glen, unnest(toks) AS token FROM {p}_groups)
  GROUP BY topic_id, token, lo, hi),
{p}_post AS (
  SELECT doc_id, pmid, yr, dl, token, count(*) AS tf FROM (
    SELECT doc_id, pmid, yr, len(toks) AS dl, unnest(toks) AS token FROM doc_toks)
  WHERE token IN (SELECT token FROM {p}_terms)
  GROUP BY doc_id, pmid, yr, dl, token),
{p}_df AS (SELECT token, count(*) AS df FROM {p}_post GROUP BY token),
{p}_scored AS (
  SELECT t.topic_id, p.doc_id, p.pmid, p.yr,
         sum(ln(1.0 + (s.n_docs - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2
             / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl))) AS score,
         bool_or(t.c1) AS c1, bool_or(t.d1) AS d1, bool_or(t.e1) AS e1
  FROM {p}_post p JOIN {p}_terms t ON p.token = t.token JOIN {p}_df f ON p.token = f.token, stats s
  WHERE t.lo IS NULL OR coalesce(p.yr BETWEEN t.lo AND t.hi, false)
  GROUP BY t.topic_id, p.doc_id, p.pmid, p.yr),
{p}_matched AS (
  SELECT topic_id, doc_id, pmid, yr, round(score, 6) AS score FROM {p}_scored WHERE c1 AND d1 AND e1)"""


def ranked_ctes(p: str, topics: str, k: int = 5, effect_terms=FIXTURE_EFFECT_TERMS) -> str:
    """+ ``{p}_ranked(topic_id, doc_id, pmid, yr, score, rank)``."""
    return match_ctes(p, topics, effect_terms) + f""",
{p}_ranked AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, pmid) AS rank
    FROM {p}_matched) WHERE rank <= {k})"""


ANN_COLS = """CASE WHEN ok THEN json_extract_string(span, '$.effect_type') END AS effect_type,
         CASE WHEN ok THEN json_extract_string(span, '$.evidence_strength') END AS evidence_strength,
         CASE WHEN ok THEN TRY_CAST(json_extract(span, '$.findings') AS VARCHAR[]) END AS findings,
         CASE WHEN ok THEN json_extract_string(span, '$.conclusion') END AS conclusion"""


def span_sql(x: str) -> str:
    return f"nullif(regexp_extract(coalesce({x}, ''), '(?s)\\{{.*\\}}', 0), '')"


def ok_sql(span: str) -> str:
    return f"coalesce(json_valid({span}) AND json_type({span}) = 'OBJECT', false)"


def report_ctes(p: str, topics: str, k: int = 5, effect_terms=FIXTURE_EFFECT_TERMS,
                on_error: str = "skip") -> str:
    """+ ``{p}_fetched``, ``{p}_ann``, ``{p}_reports`` (one row per valid topic)."""
    failed = "false" if on_error == "skip" else "(coalesce(a.failed, 0) > 0)"
    return ranked_ctes(p, topics, k, effect_terms) + f""",
{p}_fetched AS (
  SELECT r.topic_id, r.rank, r.score, a.pmid, a.title, a.abstract, t.compound, t.disease
  FROM {p}_ranked r JOIN arts a ON a.pmid = r.pmid JOIN {topics} t ON t.topic_id = r.topic_id),
{p}_ann0 AS (
  SELECT f.*, resp.response, {span_sql('resp.response')} AS span
  FROM {p}_fetched f LEFT JOIN resp ON resp.pmid = f.pmid),
{p}_ann AS (
  SELECT * EXCLUDE (ok0), ok0 AS annotation_ok FROM (
    SELECT topic_id, rank, score, pmid, title, abstract, compound, disease, response,
           {ok_sql('span')} AS ok0, span, {ok_sql('span')} AS ok
    FROM {p}_ann0)),
{p}_ann2 AS (
  SELECT topic_id, rank, score, pmid, title, abstract, compound, disease, response, annotation_ok,
         {ANN_COLS}
  FROM {p}_ann),
{p}_agg AS (
  SELECT topic_id, count(*) AS total_papers,
         count(*) FILTER (WHERE effect_type = 'positive') AS positive_effects,
         count(*) FILTER (WHERE effect_type = 'negative') AS negative_effects,
         count(*) FILTER (WHERE effect_type = 'neutral') AS neutral_effects,
         count(*) FILTER (WHERE evidence_strength = 'strong') AS strong_evidence,
         count(*) FILTER (WHERE evidence_strength = 'moderate') AS moderate_evidence,
         count(*) FILTER (WHERE evidence_strength = 'weak') AS weak_evidence,
         count(*) FILTER (WHERE NOT annotation_ok) AS failed,
         list_slice(flatten(list(coalesce(findings, []) ORDER BY rank)), 1, 5) AS key_findings,
         array_to_string(list(CAST(rank AS VARCHAR) || ':' || pmid || ':' || coalesce(effect_type, '-')
             || ':' || coalesce(evidence_strength, '-') || ':' || coalesce(conclusion, '-') ORDER BY rank), ';') AS articles
  FROM {p}_ann2 GROUP BY topic_id),
{p}_reports AS (
  SELECT t.topic_id, t.compound, t.disease,
         coalesce(a.total_papers, 0) AS total_papers,
         coalesce(a.positive_effects, 0) AS positive_effects,
         coalesce(a.negative_effects, 0) AS negative_effects,
         coalesce(a.neutral_effects, 0) AS neutral_effects,
         coalesce(a.strong_evidence, 0) AS strong_evidence,
         coalesce(a.moderate_evidence, 0) AS moderate_evidence,
         coalesce(a.weak_evidence, 0) AS weak_evidence,
         coalesce(a.key_findings, []) AS key_findings,
         coalesce(a.articles, '') AS articles,
         coalesce(a.failed, 0) AS failed_annotations,
         CASE WHEN {failed} THEN 'error' ELSE 'ok' END AS status
  FROM {topics} t LEFT JOIN {p}_agg a ON a.topic_id = t.topic_id
  WHERE trim(coalesce(t.compound, '')) <> '' AND trim(coalesce(t.disease, '')) <> ''),
{p}_rc AS (
  SELECT *,
         'strong: ' || CAST(strong_evidence AS VARCHAR) || ', moderate: ' || CAST(moderate_evidence AS VARCHAR)
           || ', weak: ' || CAST(weak_evidence AS VARCHAR) AS evidence_summary,
         coalesce(compound, 'None') || '对' || coalesce(disease, 'None') || '的分析报告：' || {NL}
           || '总计分析文献：' || CAST(total_papers AS VARCHAR) || '篇' || {NL}
           || '正面效果：' || CAST(positive_effects AS VARCHAR) || '篇，负面效果：' || CAST(negative_effects AS VARCHAR)
           || '篇，中性效果：' || CAST(neutral_effects AS VARCHAR) || '篇' || {NL}
           || '主要发现：' || array_to_string(key_findings, ', ') AS content
  FROM {p}_reports)"""


def history_ctes() -> str:
    """+ ``hist`` = analysis store rows of the fixture's past runs."""
    return (history_topics_cte() + ",\n" + history_times_cte() + ",\n"
            + report_ctes("h", "htopics") + """,
hist AS (
  SELECT r.compound, r.disease, r.content, ht.ts AS created_at, r.total_papers
  FROM h_rc r JOIN htimes ht ON ht.topic_id = r.topic_id WHERE r.status = 'ok')""")


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ------------------------------------------------------------------ queries

ANSWER_ROWS = FIXTURE_TOPICS + [(7, "thon", "thble", None, 2010, True)]
NOTIME_ROWS = [(t[0], t[1], t[2], None, None, False) for t in FIXTURE_TOPICS]
TF = "'%Y-%m-%d %H:%M:%S'"


def _reports_sql(select: str, on_error: str = "skip") -> str:
    return with_(BASE, topics_cte(), report_ctes("q", "topics", on_error=on_error)) + select


def _q_bm25() -> str:
    return with_(BASE, """bq AS (SELECT item_id AS query_id, text FROM benchmark),
bqt AS (SELECT DISTINCT query_id, token FROM (SELECT query_id, unnest(""" + toks("text") + """) AS token FROM bq)),
bpost AS (
  SELECT doc_id, pmid, dl, token, count(*) AS tf FROM (
    SELECT doc_id, pmid, len(toks) AS dl, unnest(toks) AS token FROM doc_toks)
  WHERE token IN (SELECT token FROM bqt) GROUP BY doc_id, pmid, dl, token),
bdf AS (SELECT token, count(*) AS df FROM bpost GROUP BY token),
bscored AS (
  SELECT q.query_id, p.pmid,
         round(sum(ln(1.0 + (s.n_docs - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2
             / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avgdl))), 6) AS score
  FROM bpost p JOIN bqt q ON p.token = q.token JOIN bdf f ON f.token = p.token, stats s
  GROUP BY q.query_id, p.pmid)""") + """
SELECT query_id, pmid, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pmid) AS rank FROM bscored)
WHERE rank <= 5"""


def _q_answer() -> str:
    return with_(BASE, topics_cte("atopics", ANSWER_ROWS), history_ctes(), f"""latest AS (
  SELECT compound, disease, arg_max(created_at, created_at) AS created_at,
         arg_max(content, created_at) AS content, arg_max(total_papers, created_at) AS total_papers
  FROM hist WHERE total_papers > 0 GROUP BY compound, disease),
routed AS (
  SELECT t.*, l.created_at AS history_time, l.content AS history_content, l.total_papers AS history_papers,
         CASE WHEN l.created_at IS NOT NULL AND NOT coalesce(t.refresh, false) THEN 'history' ELSE 'analyze' END AS route
  FROM atopics t LEFT JOIN latest l
    ON t.compound IS NOT DISTINCT FROM l.compound AND t.disease IS NOT DISTINCT FROM l.disease
  WHERE trim(coalesce(t.compound, '')) <> '' AND trim(coalesce(t.disease, '')) <> ''),
todo AS (SELECT topic_id, compound, disease, start_year, end_year, refresh FROM routed WHERE route = 'analyze')""",
                 report_ctes("a", "todo")) + f"""
SELECT topic_id, compound, disease, 'history' AS provenance, 'ok' AS status,
       strftime(history_time, {TF}) AS analysis_time, history_papers AS total_papers,
       history_content AS content
FROM routed WHERE route = 'history'
UNION ALL
SELECT topic_id, compound, disease, 'new', status, '2024-06-01 00:00:00', total_papers,
       CASE WHEN status = 'ok' THEN content END
FROM a_rc"""


ORACLE = {
    "search_literature": with_(BASE, topics_cte(), ranked_ctes("q", "topics"))
    + "SELECT topic_id, pmid, score, CAST(rank AS INTEGER) AS rank FROM q_ranked",
    "match_topics": with_(BASE, topics_cte("topics", NOTIME_ROWS), match_ctes("q", "topics"))
    + "SELECT topic_id, pmid, score FROM q_matched",
    "match_topics_years": with_(BASE, topics_cte(), match_ctes("q", "topics"))
    + "SELECT topic_id, pmid, yr, score FROM q_matched",
    "topic_report": _reports_sql(f"""SELECT topic_id, compound, disease, total_papers, positive_effects,
       negative_effects, neutral_effects, array_to_string(key_findings, '|') AS key_findings,
       evidence_summary, articles, content, '2024-06-01 00:00:00' AS analysis_date,
       'new' AS provenance, status FROM q_rc"""),
    "topic_report_fail_topic": _reports_sql("""SELECT topic_id, total_papers,
       CASE WHEN status = 'ok' THEN positive_effects END AS positive_effects,
       CASE WHEN status = 'ok' THEN content END AS content, status, failed_annotations FROM q_rc""",
                                            on_error="fail_topic"),
    "effect_counts": _reports_sql("""SELECT topic_id, total_papers, positive_effects, negative_effects,
       neutral_effects FROM q_rc"""),
    "key_findings": _reports_sql("""SELECT topic_id, array_to_string(key_findings, '|') AS key_findings,
       CAST(len(key_findings) AS INTEGER) AS n_findings FROM q_rc"""),
    "report_articles": _reports_sql("SELECT topic_id, articles FROM q_rc"),
    "evidence_summary": _reports_sql("""SELECT topic_id, evidence_strength, count(*) AS n_articles
       FROM q_ann2 WHERE evidence_strength IS NOT NULL GROUP BY topic_id, evidence_strength"""),
    "report_content": _reports_sql("SELECT topic_id, content FROM q_rc"),
    "annotate_recorded": _reports_sql("""SELECT topic_id, CAST(rank AS INTEGER) AS rank, pmid, annotation_ok,
       effect_type, evidence_strength, array_to_string(findings, '|') AS findings, conclusion FROM q_ann2"""),
    "latest_analysis": with_(BASE, history_ctes()) + f"""SELECT compound, disease,
       strftime(arg_max(created_at, created_at), {TF}) AS analysis_time,
       arg_max(total_papers, created_at) AS total_papers, arg_max(content, created_at) AS content
       FROM hist GROUP BY compound, disease""",
    "analysis_history": with_(BASE, topics_cte(), history_ctes()) + f"""SELECT t.topic_id,
       CAST(row_number() OVER (PARTITION BY t.topic_id ORDER BY h.created_at DESC, h.content) AS INTEGER) AS rank,
       h.compound, h.disease, strftime(h.created_at, {TF}) AS analysis_time, h.total_papers, h.content
       FROM hist h JOIN topics t ON t.compound IS NOT DISTINCT FROM h.compound
                                AND t.disease IS NOT DISTINCT FROM h.disease""",
    "plan_topics": with_(BASE, topics_cte("atopics", ANSWER_ROWS), history_ctes(), """latest AS (
  SELECT compound, disease, max(created_at) AS created_at FROM hist WHERE total_papers > 0
  GROUP BY compound, disease)""") + f"""SELECT t.topic_id,
       CASE WHEN l.created_at IS NOT NULL AND NOT coalesce(t.refresh, false) THEN 'history' ELSE 'analyze' END AS route,
       strftime(l.created_at, {TF}) AS history_time
       FROM atopics t LEFT JOIN latest l ON t.compound IS NOT DISTINCT FROM l.compound
                                       AND t.disease IS NOT DISTINCT FROM l.disease
       WHERE trim(coalesce(t.compound, '')) <> '' AND trim(coalesce(t.disease, '')) <> ''""",
    "answer_topics": _q_answer(),
    "corpus_stats": with_(BASE) + "SELECT CAST(n_docs AS BIGINT) AS n_docs, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_topk": _q_bm25(),
    "parse_pub_date": with_(BASE) + f"""SELECT pmid, dp, strftime(pub_parsed, {TF}) AS parsed,
       strftime(pub_date, {TF}) AS publication_date FROM arts_d""",
}


# ------------------------------------------------------------------ batch 2 helpers

def sparse_embed(name: str, src: str, key: str, text: str) -> str:
    """``{name}(key, b, v)``: hashed token counts, L2-normalised, as FLOAT."""
    return f"""{name}_b AS (
  SELECT key, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 64 AS b FROM (
    SELECT {key} AS key, unnest({toks(text)}) AS t FROM {src})),
{name}_c AS (SELECT key, b, count(*) AS c FROM {name}_b GROUP BY key, b),
{name} AS (SELECT key, b, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY key)) AS FLOAT) AS v FROM {name}_c)"""


def sparse_cosine(name: str, q: str, d: str) -> str:
    """``{name}(qkey, dkey, score)`` for every (query, item) pair."""
    return f"""{name}_qn AS (SELECT key, sqrt(sum(CAST(v AS DOUBLE) * v)) AS n FROM {q} GROUP BY key),
{name}_dn AS (SELECT key, sqrt(sum(CAST(v AS DOUBLE) * v)) AS n FROM {d} GROUP BY key),
{name}_dot AS (SELECT q.key AS qkey, d.key AS dkey, sum(CAST(q.v AS DOUBLE) * CAST(d.v AS DOUBLE)) AS dot
  FROM {q} q JOIN {d} d ON q.b = d.b GROUP BY q.key, d.key),
{name} AS (SELECT qn.key AS qkey, dn.key AS dkey,
  round(coalesce(x.dot, 0.0) / (qn.n * dn.n), 6) AS score
  FROM {name}_qn qn CROSS JOIN {name}_dn dn
  LEFT JOIN {name}_dot x ON x.qkey = qn.key AND x.dkey = dn.key)"""


def vec_summary(src: str, key: str) -> str:
    return (f"SELECT key AS {key}, CAST(count(*) AS INTEGER) AS nnz, "
            f"round(sum(CAST(v AS DOUBLE) * (b + 1)), 5) AS checksum FROM {src} GROUP BY key")


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _prompt_sql() -> str:
    from quire.functions.text import PROMPT_TEMPLATE
    head, rest = PROMPT_TEMPLATE.split("{compound}", 1)
    mid1, rest = rest.split("{disease}", 1)
    mid2, rest = rest.split("{title}", 1)
    mid3, tail = rest.split("{abstract}", 1)
    tail = tail.replace("{{", "{").replace("}}", "}")
    return (f"{_sql_str(head)} || coalesce(compound, 'None') || {_sql_str(mid1)} || coalesce(disease, 'None') || "
            f"{_sql_str(mid2)} || coalesce(title, '') || {_sql_str(mid3)} || coalesce(abstract, '') || {_sql_str(tail)}")


QUERY_TEXT = """coalesce(compound, 'None') || ' AND ' || coalesce(disease, 'None') || ' AND (treatment OR therapy OR effect)' ||
  CASE WHEN coalesce(start_year, 0) <> 0 AND coalesce(end_year, 0) <> 0
         THEN ' AND (' || CAST(start_year AS VARCHAR) || '[PDAT]:' || CAST(end_year AS VARCHAR) || '[PDAT])'
       WHEN coalesce(start_year, 0) <> 0 THEN ' AND ' || CAST(start_year AS VARCHAR) || '[PDAT]:3000[PDAT]'
       WHEN coalesce(end_year, 0) <> 0 THEN ' AND 1900[PDAT]:' || CAST(end_year AS VARCHAR) || '[PDAT]'
       ELSE '' END"""

BENCH_Q = "bench AS (SELECT item_id AS query_id, text FROM benchmark)"


def _store_rows(p: str, ts: str) -> str:
    """First write wins inside a run: one row per pmid, lowest (topic, rank)."""
    return f"""{p}_store AS (
  SELECT DISTINCT ON (pmid) pmid, title, abstract, compound, disease, TIMESTAMP '{ts}' AS created_at
  FROM {p}_fetched ORDER BY pmid, topic_id, rank)"""


def _article_store() -> str:
    """CTE ``astore``: the two-run article store."""
    return (history_topics_cte() + ",\n" + topics_cte("atopics", ANSWER_ROWS) + ",\n"
            + report_ctes("h", "htopics") + ",\n" + report_ctes("a", "atopics") + ",\n"
            + _store_rows("h", "2024-05-01 00:00:00") + ",\n" + _store_rows("a", "2024-06-01 00:00:00")
            + """,
astore AS (SELECT * FROM h_store UNION ALL
           SELECT * FROM a_store WHERE pmid NOT IN (SELECT pmid FROM h_store))""")


def _analysis_store() -> str:
    return (history_ctes() + ",\n" + topics_cte() + ",\n" + report_ctes("q", "topics") + """,
anstore AS (SELECT compound, disease, content, created_at, total_papers FROM hist
  UNION ALL SELECT compound, disease, content, TIMESTAMP '2024-06-01 00:00:00', total_papers
  FROM q_rc WHERE status = 'ok')""")


LEX_POS = "['er', 'ing']"
LEX_NEG = "['ed', 'tion']"


def _lexicon() -> str:
    return with_(BASE, topics_cte(), report_ctes("q", "topics"), f"""lx AS (
  SELECT topic_id, pmid, {toks("title || " + NL + " || abstract")} AS tk,
         list_filter(regexp_split_to_array(coalesce(abstract, ''), '[.!?]\\s+'), lambda s: s <> '') AS sents
  FROM q_fetched),
lx2 AS (SELECT *, len(list_filter(tk, lambda t: list_contains({LEX_POS}, t)))
                - len(list_filter(tk, lambda t: list_contains({LEX_NEG}, t))) AS sc FROM lx)""") + f"""
SELECT topic_id, pmid,
  CASE WHEN sc > 0 THEN 'positive' WHEN sc < 0 THEN 'negative' ELSE 'neutral' END AS effect_type,
  CASE WHEN abs(sc) >= 5 THEN 'strong' WHEN abs(sc) >= 2 THEN 'moderate' ELSE 'weak' END AS evidence_strength,
  array_to_string(list_slice(list_filter(sents, lambda s: len(list_intersect({toks('s')}, ['er', 'ing', 'ed', 'tion'])) > 0), 1, 3), '|') AS findings,
  coalesce(sents[-1], '') AS conclusion
FROM lx2"""


def _similar_articles(filter_sql: str = "") -> str:
    return with_(BASE, topics_cte(), report_ctes("q", "topics"), _store_rows("q", "2024-06-01 00:00:00"),
                 f"sitems AS (SELECT * FROM q_store {filter_sql})", BENCH_Q,
                 sparse_embed("qe", "bench", "query_id", "text"),
                 sparse_embed("de", "sitems", "pmid", "title || " + NL + " || abstract"),
                 sparse_cosine("cs", "qe", "de")) + """
SELECT qkey AS query_id, CAST(rank AS INTEGER) AS rank, s.pmid, s.compound, s.disease, score AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY qkey ORDER BY score DESC, dkey) AS rank FROM cs) c
JOIN sitems s ON s.pmid = c.dkey WHERE rank <= 5"""


def _hybrid() -> str:
    bm = _q_bm25()
    bm_ctes = bm[len("WITH "):bm.index("\nSELECT query_id, pmid, score, CAST(rank")]
    return "WITH " + bm_ctes + ",\n" + ",\n".join([
        BENCH_Q,
        sparse_embed("qe", "bench", "query_id", "text"),
        sparse_embed("de", "arts", "pmid", "title || " + NL + " || abstract"),
        sparse_cosine("cs", "qe", "de"),
        """dense AS (SELECT qkey AS query_id, dkey AS pmid, r_dense FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY qkey ORDER BY score DESC, dkey) AS INTEGER) AS r_dense FROM cs)
  WHERE r_dense <= 20)""",
        """btext AS (SELECT query_id, pmid, r_text FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pmid) AS INTEGER) AS r_text FROM bscored)
  WHERE r_text <= 20)""",
        """fused AS (SELECT coalesce(d.query_id, t.query_id) AS query_id, coalesce(d.pmid, t.pmid) AS pmid,
  d.r_dense, t.r_text,
  round(coalesce(1.0 / (60 + d.r_dense), 0.0) + coalesce(1.0 / (60 + t.r_text), 0.0), 6) AS score
  FROM dense d FULL OUTER JOIN btext t ON d.query_id = t.query_id AND d.pmid = t.pmid)"""]) + """
SELECT * FROM (SELECT query_id, pmid, r_dense, r_text, score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pmid) AS INTEGER) AS rank FROM fused)
WHERE rank <= 5"""


ORACLE.update({
    "valid_messages": """SELECT conv_id, turn, role FROM conversations
       WHERE regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') <> ''""",
    "topic_query_text": with_(BASE, topics_cte(), match_ctes("q", "topics")) + f"""SELECT t.topic_id,
       {QUERY_TEXT} AS query_text, coalesce(n.n_matches, 0) AS n_matches
       FROM topics t LEFT JOIN (SELECT topic_id, count(*) AS n_matches FROM q_matched GROUP BY topic_id) n
       ON n.topic_id = t.topic_id""",
    "render_prompt": _reports_sql(f"SELECT topic_id, pmid, {_prompt_sql()} AS prompt FROM q_fetched"),
    "extract_json": with_(BASE) + f"SELECT pmid, {span_sql('response')} AS span FROM resp",
    "parse_annotation": with_(BASE, f"""pa AS (SELECT pmid, span, {ok_sql('span')} AS ok FROM (
       SELECT pmid, {span_sql('response')} AS span FROM resp))""") + f"""SELECT pmid, ok AS annotation_ok,
       {ANN_COLS.replace("AS findings", "AS findings_l")} FROM pa""".replace(
        "SELECT pmid, ok AS annotation_ok,", "SELECT pmid, annotation_ok, effect_type, evidence_strength, "
        "array_to_string(findings_l, '|') AS findings, conclusion FROM (SELECT pmid, ok AS annotation_ok,") + ")",
    "article_content": with_(BASE) + f"""SELECT pmid, CAST(length(title || {NL} || abstract) AS INTEGER) AS n_chars,
       md5(title || {NL} || abstract) AS md5 FROM arts""",
    "fetch_articles": _reports_sql(f"""SELECT f.topic_id, CAST(f.rank AS INTEGER) AS rank, f.pmid, f.title,
       a.journal, array_to_string(a.keywords, ',') AS keywords, strftime(a.pub_date, {TF}) AS publication_date
       FROM q_fetched f JOIN arts_d a ON a.pmid = f.pmid"""),
    "conversation_tail": """WITH t AS (
  SELECT conv_id, turn, role, CAST(len(string_split_regex(trim(coalesce(text, '')), '\\s+')) AS BIGINT) AS n_tokens
  FROM conversations),
r AS (SELECT *, CAST(sum(n_tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM t),
k AS (SELECT * FROM r WHERE running <= 100),
f AS (SELECT conv_id, min(turn) AS first_turn FROM k WHERE role <> 'assistant' GROUP BY conv_id)
SELECT k.conv_id, k.turn, k.role, k.n_tokens, k.running FROM k JOIN f ON f.conv_id = k.conv_id
WHERE k.turn >= f.first_turn""",
    "embed_documents": with_(BASE, sparse_embed("de", "arts", "pmid", "title || " + NL + " || abstract"))
    + vec_summary("de", "pmid"),
    "cosine_topk": """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0),
i AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.query_id, i.vec_id, round(list_cosine_similarity(q.e, i.e), 6) AS score FROM q CROSS JOIN i)
SELECT query_id, vec_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
WHERE rank <= 5""",
    "search_similar_analyses": with_(BASE, history_ctes(), BENCH_Q, """hitems AS (
  SELECT compound || chr(1) || disease || chr(1) || strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') || chr(1) || md5(content) AS key,
         compound, disease, created_at, content FROM hist)""",
                                     sparse_embed("qe", "bench", "query_id", "text"),
                                     sparse_embed("he", "hitems", "key", "content"),
                                     sparse_cosine("cs", "qe", "he")) + f"""
SELECT qkey AS query_id, CAST(rank AS INTEGER) AS rank, h.compound, h.disease,
       strftime(h.created_at, {TF}) AS analysis_time, score FROM (
  SELECT *, row_number() OVER (PARTITION BY qkey ORDER BY score DESC, dkey) AS rank FROM cs) c
JOIN hitems h ON h.key = c.dkey WHERE rank <= 5""",
    "search_similar_articles": _similar_articles(),
    "search_similar_filtered": _similar_articles("WHERE compound = 'ther'"),
    "hybrid_search": _hybrid(),
    "store_articles": with_(BASE, _article_store()) + f"""SELECT pmid, compound, disease,
       strftime(created_at, {TF}) AS created_at FROM astore""",
    "scan_articles": with_(BASE, _article_store(),
                           sparse_embed("se", "astore", "pmid", "title || " + NL + " || abstract"),
                           "sv AS (" + vec_summary("se", "pmid") + ")") + """SELECT a.pmid, a.title,
       CAST(length(a.abstract) AS INTEGER) AS abstract_chars, sv.nnz, sv.checksum
       FROM astore a JOIN sv ON sv.pmid = a.pmid""",
    "store_analyses": with_(BASE, _analysis_store()) + """SELECT compound, disease, count(*) AS n_analyses,
       CAST(sum(total_papers) AS BIGINT) AS papers FROM anstore GROUP BY compound, disease""",
    "scan_analyses": with_(BASE, _analysis_store(), """anitems AS (SELECT *, compound || chr(1) || disease || chr(1)
       || strftime(created_at, '%Y-%m-%d %H:%M:%S') || chr(1) || md5(content) AS key FROM anstore)""",
                           sparse_embed("ae", "anitems", "key", "content"),
                           "av AS (" + vec_summary("ae", "key") + ")") + f"""SELECT a.compound, a.disease,
       strftime(a.created_at, {TF}) AS analysis_time, a.total_papers, a.content, av.nnz, av.checksum
       FROM anitems a JOIN av ON av.key = a.key""",
    "report_json": _reports_sql("""SELECT topic_id, total_papers, positive_effects,
       array_to_string(key_findings, '|') AS key_findings, articles, content, status FROM q_rc"""),
    "read_medline": with_(BASE) + """SELECT pmid,
       CAST(1 + (title <> '')::INT + (abstract <> '')::INT + (dp <> '')::INT + (journal <> '')::INT + 1 AS INTEGER) AS n_tags,
       concat_ws(',', 'PMID', CASE WHEN title <> '' THEN 'TI' END, CASE WHEN abstract <> '' THEN 'AB' END,
                 CASE WHEN dp <> '' THEN 'DP' END, CASE WHEN journal <> '' THEN 'TA' END, 'MH') AS tags
       FROM arts""",
    "map_medline": with_(BASE) + f"""SELECT pmid, title, replace(abstract, {NL}, ' ') AS abstract, journal,
       '' AS authors, array_to_string(keywords, '|') AS keywords, dp, strftime(pub_parsed, {TF}) AS parsed
       FROM arts_d""",
    "validate_articles": with_(BASE) + "SELECT pmid, CAST(0 AS INTEGER) AS n_errors, '' AS errors FROM arts",
    "stream_ingest": with_(BASE) + "SELECT pmid, title, '2024-05-01 00:00:00' AS created_at FROM arts",
    "annotate_lexicon": _lexicon(),
})


def _model() -> str:
    return _reports_sql(f"""SELECT topic_id, pmid,
  CASE WHEN sc > 0 THEN 'positive' WHEN sc < 0 THEN 'negative' ELSE 'neutral' END AS effect_type,
  CASE WHEN abs(sc) >= 5 THEN 'strong' WHEN abs(sc) >= 2 THEN 'moderate' ELSE 'weak' END AS evidence_strength,
  'score ' || CAST(sc AS VARCHAR) AS findings
FROM (SELECT topic_id, pmid,
        len(list_filter(tk, lambda t: list_contains({LEX_POS}, t)))
        - len(list_filter(tk, lambda t: list_contains({LEX_NEG}, t))) AS sc
      FROM (SELECT topic_id, pmid, {toks(_prompt_sql())} AS tk FROM q_fetched))""")


ORACLE["annotate_model"] = _model()


def _phrases() -> str:
    """Adjacent tokens as a substring of the token list joined by spaces."""
    def line(x):
        return f"(' ' || array_to_string({x}, ' ') || ' ')"
    effects = " OR ".join(f"contains(d.line, {line(toks(_lit(e)))})" for e in PHRASE_EFFECTS)
    names = " UNION ".join([f"SELECT topic_id, unnest({toks(c)}) AS token FROM topics" for c in ("compound", "disease")]
                           + [f"SELECT topic_id, unnest({toks(_lit(e))}) FROM topics" for e in PHRASE_EFFECTS])
    return with_(BASE, topics_cte("topics", PHRASE_TOPICS), f"""d AS (SELECT *, {line('toks')} AS line FROM doc_toks),
m AS (SELECT t.topic_id, d.doc_id, d.pmid, d.toks FROM topics t JOIN d
        ON contains(d.line, {line(toks('compound'))}) AND contains(d.line, {line(toks('disease'))})
  WHERE len({toks('compound')}) > 0 AND len({toks('disease')}) > 0 AND ({effects})
    AND (coalesce(start_year, 0) = 0 OR coalesce(yr >= start_year, false))),
names AS ({names}),
df AS (SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(toks) AS token FROM doc_toks) GROUP BY token),
tf AS (SELECT m.topic_id, m.pmid, n.token, len(m.toks) AS dl, len(list_filter(m.toks, lambda x: x = n.token)) AS tf
  FROM m JOIN names n ON n.topic_id = m.topic_id)""") + """
SELECT topic_id, pmid, round(sum(ln(1.0 + (s.n_docs - df.df + 0.5) / (df.df + 0.5)) * tf * 2.2
         / (tf + 1.2 * (0.25 + 0.75 * dl / s.avgdl))), 6) AS score
FROM tf JOIN df ON df.token = tf.token, stats s WHERE tf > 0 GROUP BY topic_id, pmid"""


def _twice() -> str:
    return with_(BASE, topics_cte("atopics", ANSWER_ROWS), report_ctes("a", "atopics"), """h AS (
  SELECT DISTINCT compound, disease, content, total_papers FROM a_rc WHERE status = 'ok' AND total_papers > 0),
old AS (SELECT t.topic_id, h.* FROM atopics t JOIN h ON h.compound = t.compound AND h.disease = t.disease
  WHERE NOT coalesce(t.refresh, false))""") + """
SELECT topic_id, compound, disease, 'history' AS provenance, 'ok' AS status, '2024-06-01 00:00:00' AS analysis_time,
       total_papers, content FROM old
UNION ALL
SELECT topic_id, compound, disease, 'new', status, '2024-07-01 00:00:00', total_papers, content
FROM a_rc WHERE topic_id NOT IN (SELECT topic_id FROM old)"""


def _by_pmids() -> str:
    worst_first = _reports_sql("""SELECT topic_id, total_papers, positive_effects,
       array_to_string(key_findings, '|') AS key_findings, articles, status FROM q_rc""")
    return worst_first.replace("q_fetched AS (\n  SELECT r.topic_id, r.rank,", "q_fetched AS (\n  SELECT r.topic_id, "
                               "row_number() OVER (PARTITION BY r.topic_id ORDER BY r.rank DESC) AS rank,")


ORACLE.update({
    "match_topics_phrase": _phrases(),
    "answer_topics_twice": _twice(),
    "analyze_by_pmids": _by_pmids(),
    "tool_search_literature": ORACLE["search_literature"],
    "tool_analyze_literature": ORACLE["effect_counts"],
    "tool_query_previous_analyses": ORACLE["analysis_history"],
    "tool_search_similar_articles": ORACLE["search_similar_articles"],
    "create_store": """SELECT source AS compound, lang AS disease, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars
       FROM documents GROUP BY source, lang""",
    "validate_rows": with_(BASE) + """SELECT doc_id, CAST(len(e) AS INTEGER) AS n_errors, array_to_string(e, ',') AS errors
       FROM (SELECT doc_id, list_filter([CASE WHEN keywords[1] = 'es' THEN 'pmid' END, CASE WHEN abstract = '' THEN 'title' END,
         CASE WHEN journal = 'src1' THEN 'authors' END, CASE WHEN journal = 'src2' THEN 'journal' END],
         lambda x: x IS NOT NULL) AS e FROM arts)""",
    "map_medline_no_pmid": with_(BASE) + "SELECT pmid, title FROM arts WHERE keywords[1] = 'en'",
    "valid_topics": with_(BASE) + """SELECT doc_id, CAST(length(abstract) AS INTEGER) AS n, journal AS disease FROM arts
       WHERE regexp_replace(abstract, '\\s+', '', 'g') <> '' AND trim(journal) <> ''""",
})

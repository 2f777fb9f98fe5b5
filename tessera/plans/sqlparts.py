"""SQL fragments for the DuckDB oracle queries (independent re-statements of each operator's
definition in plain SQL, used only to cross-check the Spark plans)."""

from __future__ import annotations

from tessera.functions.stopwords import spark_stop_words
from tessera.functions.text import ACCENT_FROM, ACCENT_TO, TOKEN_PATTERN


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


V_TEXT = """v_text AS (
  SELECT d.doc_id AS id, split_part(coalesce(d.text, ''), chr(10), 1) AS subject, d.text AS description,
         d.source AS product, d.lang AS category,
         d.lang || '/' || CAST(d.doc_id % 5 AS VARCHAR) AS subcategory,
         coalesce(l.quality = 1, true) AS resolution_helpful,
         CAST(1 + d.doc_id % 5 AS DOUBLE) AS satisfaction_score, l.quality, l.toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

V_EVENT = """v_event AS (
  SELECT event_id AS id, ts AS created_at, user_id, event_type AS category, value AS resolution_time_hours,
         'prod' || CAST(user_id % 4 AS VARCHAR) AS product, CAST(user_id % 10 AS VARCHAR) AS agent_id,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 34 THEN 'negative'
              WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 67 THEN 'neutral'
              ELSE 'positive' END AS customer_sentiment,
         CAST(1 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS DOUBLE) AS satisfaction_score,
         event_type <> 'error' AS resolution_helpful, value > 150 AS escalated
  FROM events)"""

V_ORDER = """v_order AS (
  SELECT o.o_orderkey AS id, o.o_orderdate AS created_at, o.o_orderpriority AS priority,
         o.o_orderstatus AS status, o.o_totalprice AS total_price, c.c_mktsegment AS product,
         c.c_acctbal AS account_monthly_value
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

VIEWS = {"v_text": V_TEXT, "v_event": V_EVENT, "v_order": V_ORDER}


def with_views(sql_body: str, *extra_ctes: str) -> str:
    """Prefix the ticket views that the body mentions, then extra CTEs, then the body."""
    ctes = []
    for name, cte in VIEWS.items():
        if name in sql_body or any(name in e for e in extra_ctes):
            ctes.append(cte)
    ctes.extend(extra_ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql_body


def norm(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '^\\s+|\\s+$', '', 'g')"


def strip_accents(x: str) -> str:
    return f"regexp_replace(translate({x}, {lit(ACCENT_FROM)}, {lit(ACCENT_TO)}), '[^\\x00-\\x7F]', '', 'g')"


def tokens(x: str, accents: bool = False) -> str:
    low = f"lower(coalesce({x}, ''))"
    if accents:
        low = strip_accents(low)
    return f"regexp_extract_all({low}, {lit(TOKEN_PATTERN)})"


def stop_list() -> str:
    return "[" + ", ".join(lit(w) for w in sorted(set(spark_stop_words()))) + "]"


def terms(x: str, ngram: tuple[int, int], accents: bool, stop: bool = True) -> str:
    """Analysed terms of text x as a list expression (tokens -> stop words -> n-grams)."""
    t = tokens(x, accents)
    if stop:
        t = f"list_filter({t}, lambda w: NOT list_contains({stop_list()}, w))"
    # bind the token list once through a lambda argument
    parts = []
    for n in range(ngram[0], ngram[1] + 1):
        if n == 1:
            parts.append("t")
        else:
            joined = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
            parts.append(f"list_transform(range(1, len(t) - {n - 2}), lambda i: {joined})")
    body = " || ".join(parts) if len(parts) > 1 else parts[0]
    return f"(list_transform([{t}], lambda t: {body}))[1]"


def tfidf_ctes(prefix: str, docs: str, id_col: str, text_col: str, cfg, n_expr: str | None = None) -> list[str]:
    """CTEs {prefix}_tf, {prefix}_vocab, {prefix}_w (L2-normalised weights)."""
    mx = f"{cfg.max_df}" if isinstance(cfg.max_df, int) else f"{float(cfg.max_df)} * n"
    mn = f"{cfg.min_df}" if isinstance(cfg.min_df, int) else f"{float(cfg.min_df)} * n"
    tfw = "(1 + ln(tf))" if cfg.sublinear_tf else "CAST(tf AS DOUBLE)"
    limit = f"ORDER BY corpus_tf DESC, term ASC LIMIT {cfg.max_features}" if cfg.max_features else ""
    return [
        f"""{prefix}_tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (
    SELECT {id_col} AS doc_id, unnest({terms(text_col, cfg.ngram_range, cfg.strip_accents, cfg.stop_words)}) AS term
    FROM {docs}) GROUP BY doc_id, term)""",
        f"""{prefix}_n AS (SELECT count(*) AS n FROM {docs})""",
        f"""{prefix}_vocab AS (
  SELECT term, df, corpus_tf, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM (
    SELECT term, count(*) AS df, sum(tf) AS corpus_tf FROM {prefix}_tf GROUP BY term) s, {prefix}_n
  WHERE df <= {mx} AND df >= {mn} {limit})""",
        f"""{prefix}_w AS (
  SELECT doc_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM (
    SELECT doc_id, term, tf, {tfw} * idf AS w FROM {prefix}_tf JOIN {prefix}_vocab USING (term)))""",
    ]


def query_vec_cte(prefix: str, queries: str, cfg) -> list[str]:
    """{prefix}_qv(query_id, term, qw) using {prefix}_vocab."""
    tfw = "(1 + ln(tf))" if cfg.sublinear_tf else "CAST(tf AS DOUBLE)"
    return [
        f"""{prefix}_qtf AS (
  SELECT query_id, term, count(*) AS tf FROM (
    SELECT query_id, unnest({terms('q_text', cfg.ngram_range, cfg.strip_accents, cfg.stop_words)}) AS term
    FROM {queries}) GROUP BY query_id, term)""",
        f"""{prefix}_qv AS (
  SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS qw FROM (
    SELECT query_id, term, {tfw} * idf AS w FROM {prefix}_qtf JOIN {prefix}_vocab USING (term)))""",
    ]


# The twins' Unicode word classes (RE2's \\w, \\d and \\b are ASCII). Separators are doubled first, so a match may
# take one on each side, as \\b would see it, and leave the other to the next match.
W, D = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]", r"\p{Nd}"
GAP = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
UNICODE_FULL = {
    "error_codes": rf"(?:error|err)(?:--|_)?{W}*(?:--|_)?{D}+|{W}+(?:--|_)?(?:error|err)",
    "product_names": r"datasync|pro|enterprise|basic|premium",
    "technical_terms": r"database|connection|timeout|api|server|client|sync|backup|restore",
    "version_numbers": rf"v?{D}+\.\.{D}+(?:\.\.{D}+)?",
    "status_codes": r"200|404|500|503|401|403",
}
UNICODE_FAST = {
    "errors": rf"(?:error|err)(?:--|_)?{W}*(?:--|_)?{D}+",
    "products": r"datasync|pro|enterprise|basic|premium",
    "tech_terms": r"database|connection|timeout|api|server",
    "codes": rf"{D}{{3,4}}",
}
UNICODE_ULTRA = {"errors": rf"error(?:--|_)?{W}*", "products": r"datasync|pro", "tech": r"database|timeout|api"}
# the corpus's own vocabulary: long words, which passages and documents share
UNICODE_LONG = {"long_words": rf"{W}{{12,}}"}


def entity_list_unicode(x: str, patterns: dict, distinct: bool = True) -> str:
    """As ``entity_list`` for patterns of the sets above; x is read as it is."""
    doubled = f"regexp_replace(lower(coalesce({x}, '')), {lit('(' + GAP + ')')}, {lit(chr(92) + '1' + chr(92) + '1')}, 'g')"
    parts = []
    for name, pat in patterns.items():
        m = f"list_transform(regexp_extract_all(t, {lit(f'(?:^|{GAP})({pat})(?:$|{GAP})')}, 1), lambda v: replace(replace(v, '--', '-'), '..', '.'))"
        if distinct:
            m = f"list_distinct({m})"
        parts.append(f"list_transform({m}, lambda v: {{'type': {lit(name)}, 'value': v}})")
    return f"(list_transform([{doubled}], lambda t: {' || '.join(parts)}))[1]"


def entity_list(x: str, patterns: dict, distinct: bool = True) -> str:
    """list of struct(type, value) for each pattern over lower(x)."""
    parts = []
    for name, pat in patterns.items():
        m = f"regexp_extract_all(lower(coalesce({x}, '')), {lit(pat)})"
        if distinct:
            m = f"list_distinct({m})"
        parts.append(f"list_transform({m}, lambda v: {{'type': {lit(name)}, 'value': v}})")
    return " || ".join(parts) if len(parts) > 1 else parts[0]

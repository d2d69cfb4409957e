"""Building blocks of the SQL oracles: the same computations in plain SQL."""

from __future__ import annotations

from lodestar.functions.text import ACCENTED, BASE, STOP_WORDS

STOPS = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def stripped(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def folded(x: str) -> str:
    return f"translate(lower({x}), '{ACCENTED}', '{BASE}')"


def lexical_tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all({folded(x)}, '[a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({STOPS}, t))"


CHUNKS = rf"""
chunks AS (
  SELECT printf('%d#%03d', doc_id, position) AS chunk_id, doc_id, title, position, text, doc_id * 100000 + position AS ord
  FROM (
    SELECT doc_id, title, piece AS text, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::int AS position
    FROM (
      SELECT doc_id, title, i, {stripped("substr(t, i * 500 + 1, 600)")} AS piece
      FROM (
        SELECT doc_id, title, t, unnest(range(0, greatest(1, ceil((length(t) - 600) / 500.0)::bigint + 1))) AS i
        FROM (SELECT doc_id, source AS title, {stripped("text")} AS t FROM documents) WHERE t <> ''
      )
    ) WHERE piece <> ''
  )
)"""

LEXICAL = f"""
tokens AS (SELECT chunk_id, ord, {lexical_tokens("title || ' ' || text")} AS l FROM chunks),
lengths AS (SELECT chunk_id, ord, len(l) AS dl FROM tokens),
corpus AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM lengths),
postings AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(l) AS term FROM tokens) GROUP BY ALL),
terms AS (SELECT term, df, ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) AS idf FROM (SELECT term, count(*) AS df FROM postings GROUP BY 1), corpus)"""

QUERY_TERMS = f"""
asked AS (
  SELECT query_id, term, count(*) AS qtf, min(pos) AS first_pos FROM (
    SELECT query_id, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS pos
    FROM (SELECT item_id AS query_id, {lexical_tokens("text")} AS l FROM benchmark)
  ) GROUP BY ALL
)"""

BM25 = """
bm25 AS (
  SELECT query_id, chunk_id, ord, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord))::int AS rank FROM (
    SELECT query_id, chunk_id, ord,
      round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
    FROM asked JOIN postings USING (term) JOIN terms USING (term) JOIN lengths USING (chunk_id), corpus GROUP BY ALL
  ) WHERE score > 0
)"""


def sparse(name: str, source: str, id_col: str, dim: int = 512) -> str:
    """CTEs ending in {name}(id, pos, w): signed feature hashing of word uni- and bigrams."""
    return f"""
{name}_t AS (SELECT {id_col} AS id, regexp_extract_all(lower(text), '[a-zà-ÿ0-9]+') AS l FROM {source}),
{name}_g AS (
  SELECT id, unnest(list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]))) AS term FROM {name}_t
),
{name}_c AS (SELECT id, term, count(*) AS tf FROM {name}_g GROUP BY ALL),
{name}_x AS (
  SELECT id, (('0x' || substr(md5(term), 1, 8))::bigint % {dim})::int AS pos,
    sum(CASE WHEN ('0x' || substr(md5(term), 9, 2))::bigint % 2 = 0 THEN 1.0 ELSE -1.0 END * (1 + ln(tf::double))) AS x
  FROM {name}_c GROUP BY ALL
),
{name} AS (SELECT id, pos, CASE WHEN n > 0 THEN x / n ELSE x END AS w FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY id)) AS n FROM {name}_x))"""


QUERY_VECTORS = sparse("qv", "(SELECT item_id, text FROM benchmark)", "item_id")
DENSE = f"""
{sparse("dv", "chunks", "chunk_id")},
{QUERY_VECTORS},
dense_scores AS (SELECT q.id AS query_id, d.id AS chunk_id, sum(d.w * q.w) AS s FROM dv d JOIN qv q USING (pos) GROUP BY ALL),
dense AS (
  SELECT query_id, chunk_id, ord, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord))::int AS rank FROM (
    SELECT b.item_id AS query_id, c.chunk_id, c.ord, round(coalesce(s, 0.0), 9) AS score
    FROM benchmark b CROSS JOIN chunks c LEFT JOIN dense_scores ds ON ds.query_id = b.item_id AND ds.chunk_id = c.chunk_id
  )
)"""

FUSED = """
stacked AS (
  SELECT query_id, 0 AS ranker_id, chunk_id, ord, score, rank FROM dense WHERE rank <= 20
  UNION ALL SELECT query_id, 1, chunk_id, ord, score, rank FROM bm25 WHERE rank <= 20
),
rrf AS (
  SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen))::int AS rank FROM (
    SELECT query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 12) AS score, min({'a': ranker_id, 'b': rank}) AS seen
    FROM stacked GROUP BY ALL
  )
)"""

HITS = "WITH" + ",".join([CHUNKS, LEXICAL, QUERY_TERMS, BM25, DENSE, FUSED])
PLACED = HITS + """,
placed AS (
  SELECT query_id, chunk_id, doc_id, title, position, text, score, rank FROM rrf JOIN chunks USING (chunk_id) WHERE rank <= 7
)"""

QRELS = """
qrels AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def metric_ctes(hits: str, k: int = 4) -> str:
    return f"""
doc_ranks AS (
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY first, doc_id) AS doc_pos
  FROM (SELECT query_id, doc_id, min(rank) AS first FROM {hits} GROUP BY ALL)
),
flagged AS (SELECT r.*, q.doc_id IS NOT NULL AS rel FROM doc_ranks r LEFT JOIN qrels q USING (query_id, doc_id)),
found AS (
  SELECT query_id, min(doc_pos) FILTER (WHERE rel) AS first_rel, count(*) FILTER (WHERE rel AND doc_pos <= {k}) AS hits_k,
    count(*) FILTER (WHERE doc_pos <= {k}) AS docs_k, coalesce(sum(1.0 / log2(doc_pos + 1)) FILTER (WHERE rel AND doc_pos <= {k}), 0.0) AS dcg
  FROM flagged GROUP BY 1
),
per_query AS (
  SELECT b.item_id AS query_id,
    CASE WHEN first_rel IS NOT NULL THEN 1.0 ELSE 0.0 END AS hit, coalesce(1.0 / first_rel, 0.0) AS rr,
    coalesce(hits_k / nullif(n_rel, 0), 0.0) AS recall, coalesce(hits_k / nullif(docs_k, 0), 0.0) AS precision,
    CASE WHEN n_rel > 0 THEN coalesce(dcg, 0.0) / list_sum(list_transform(range(1, least(n_rel, {k}) + 1), lambda i: 1.0 / log2(i + 1))) ELSE 0.0 END AS ndcg
  FROM benchmark b LEFT JOIN (SELECT query_id, count(*) AS n_rel FROM qrels GROUP BY 1) n ON n.query_id = b.item_id
  LEFT JOIN found f ON f.query_id = b.item_id
)"""


SUMMARY = """SELECT count(*) AS n_queries, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision,
  round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg"""


SENTENCES = rf"""
sentences AS (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(flat, '([.!?])\s+([A-ZÀ-Ú0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)),
    lambda s: {stripped("s")}), lambda s: s <> '') AS l, flat
  FROM (SELECT doc_id, {stripped("regexp_replace(text, '\\s+', ' ', 'g')")} AS flat FROM documents)
)""".replace("\\\\s", "\\s")

PACKED = """
WITH RECURSIVE""" + SENTENCES + """,
steps AS (
  SELECT doc_id, l, 0 AS i, []::varchar[] AS cur, 0 AS size, NULL::varchar AS emitted FROM sentences WHERE flat <> ''
  UNION ALL
  SELECT doc_id, l, i + 1,
    CASE WHEN alone THEN cur WHEN flush THEN list_append(cur[len(cur) - m + 1:], x) ELSE list_append(cur, x) END,
    CASE WHEN alone THEN size WHEN flush THEN coalesce(list_sum(list_transform(cur[len(cur) - m + 1:], lambda y: length(y) + 1)), 0)::int + length(x)::int + 1
      ELSE size + length(x)::int + 1 END,
    CASE WHEN alone THEN x WHEN flush THEN array_to_string(cur, ' ') END
  FROM (
    SELECT *, l[i + 1] AS x, length(l[i + 1]) > 600 AND len(cur) = 0 AS alone, size + length(l[i + 1]) + 1 > 600 AND len(cur) > 0 AS flush,
      list_max(list_filter(range(0, len(cur) + 1), lambda m: m = 0
        OR list_sum(list_transform(cur[len(cur) - m + 1:], lambda y: length(y))) + m - 1 <= 100)) AS m
    FROM steps WHERE i < len(l)
  )
),
pieces AS (
  SELECT doc_id, i, emitted AS text FROM steps WHERE emitted IS NOT NULL
  UNION ALL SELECT doc_id, i + 1, array_to_string(cur, ' ') FROM steps WHERE i = len(l) AND len(cur) > 0
)"""


def numbered(pieces: str) -> str:
    """The CTE ``chunks`` of pieces(doc_id, i, text)."""
    return f"""
chunks AS (
  SELECT printf('%d#%03d', n.doc_id, position) AS chunk_id, n.doc_id, source AS title, position, n.text, n.doc_id * 100000 + position AS ord
  FROM (SELECT doc_id, text, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::int AS position FROM ({pieces})) n JOIN documents USING (doc_id)
)"""


RECURSIVE_CHUNKS = PACKED + f""",
whole AS (SELECT doc_id, {stripped("text")} AS t FROM documents),""" + numbered("""
  SELECT doc_id, i, text FROM pieces JOIN whole USING (doc_id) WHERE length(t) > 600
  UNION ALL SELECT doc_id, 0, t FROM whole WHERE t <> '' AND length(t) <= 600""")

# Lines as paragraphs: whole ones are packed, one too long closes the chunk and is packed by sentences.
LINE_CHUNKS = PACKED.replace(SENTENCES, f"""
paras AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: {stripped("p")}), lambda p: p <> '') AS ps FROM documents
),
long_paras AS (SELECT doc_id * 100000 + n AS doc_id, p AS text FROM (
  SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM paras) WHERE length(p) > 600),""" + SENTENCES.replace("FROM documents", "FROM long_paras")) + """,
walk AS (
  SELECT doc_id, ps, 0 AS i, []::varchar[] AS cur, 0 AS size, NULL::varchar AS closed FROM paras
  UNION ALL
  SELECT doc_id, ps, i + 1, CASE WHEN length(x) > 600 THEN []::varchar[] WHEN flush THEN [x] ELSE list_append(cur, x) END,
    CASE WHEN length(x) > 600 THEN 0 WHEN flush THEN length(x)::int + 2 ELSE size + length(x)::int + 2 END,
    CASE WHEN len(cur) > 0 AND (flush OR length(x) > 600) THEN array_to_string(cur, chr(10) || chr(10)) END
  FROM (SELECT *, ps[i + 1] AS x, size + length(ps[i + 1]) + 2 > 600 AND len(cur) > 0 AS flush FROM walk WHERE i < len(ps))
),""" + numbered("""
  SELECT doc_id, i * 100000 AS i, text FROM (
    SELECT doc_id, i, closed AS text FROM walk WHERE closed IS NOT NULL
    UNION ALL SELECT doc_id, i + 1, array_to_string(cur, chr(10) || chr(10)) FROM walk WHERE i = len(ps) AND len(cur) > 0)
  UNION ALL SELECT doc_id // 100000, doc_id % 100000 * 100000 + 1 + i, text FROM pieces""")

#: each strategy's ``WITH`` up to ``chunks``
CHUNKED = {"fixed": "WITH" + CHUNKS, "sentences": PACKED + "," + numbered("SELECT doc_id, i, text FROM pieces"), "recursive": RECURSIVE_CHUNKS}


def text_ids(sql: str) -> str:
    """Chunks in the order of document ids as text."""
    for prefix in ("n.", ""):
        sql = sql.replace(f"{prefix}doc_id * 100000 + position AS ord", f"{prefix}doc_id::varchar || chr(1) || printf('%010d', position) AS ord")
    return sql


def clean_line(x: str) -> str:
    return rf"trim(trim(trim(trim(regexp_replace(trim({x}), '^\s*(\d+[.)]|[-*•])\s*', '')), '\"'), ''''))"


# Queries are keyed by item and number of the variant, variant 0 being the query itself.
VARIANTS = """
variants AS (SELECT item_id::bigint * 1000 AS item_id, text FROM benchmark)"""

# The local stand-in's rewrites: the words turned round by one, two and three.
REWRITES = f"""
turned AS (SELECT item_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark),
lines AS (
  SELECT item_id, list_concat([text], (list_filter(list_transform(range(1, least(5, len(w))),
    lambda i: {clean_line("(i + 1) || '. ' || array_to_string(list_concat(w[i + 1:], w[:i]), ' ')")}), lambda x: x <> ''))[1:3]) AS l FROM turned
),
said AS (SELECT item_id, unnest(l) AS text, generate_subscripts(l, 1) AS n FROM lines),
variants AS (
  SELECT item_id::bigint * 1000 + row_number() OVER (PARTITION BY item_id ORDER BY n) - 1 AS item_id, text
  FROM (SELECT *, row_number() OVER (PARTITION BY item_id, lower(trim(text)) ORDER BY n) AS same FROM said) WHERE same = 1
)"""

# The local stand-in's hypothetical document: the query and the start of its digest.
HYPOTHETICAL = f"""
{sparse("qa", "variants", "item_id")},
{sparse("qb", "(SELECT item_id, text || ' ' || substr(md5(text), 1, 4) AS text FROM variants WHERE item_id % 1000 = 0)", "item_id")},
means AS (SELECT id, pos, sum(w) / 2 AS w FROM (SELECT id, pos, w FROM qa WHERE id % 1000 = 0 UNION ALL SELECT id, pos, w FROM qb) GROUP BY ALL),
qv AS (
  SELECT id, pos, CASE WHEN n > 0 THEN w / n ELSE w END AS w FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY id)) AS n FROM means)
  UNION ALL SELECT id, pos, w FROM qa WHERE id % 1000 <> 0
)"""

RRF = FUSED[FUSED.index("rrf AS"):]


def _words(x: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'))"


def retrieval(config) -> str:
    """What a configuration finds with the local stand-in for a model, over recursive chunks:
    CTEs that end in shown(query_id, chunk_id, doc_id, score, rank)."""
    over = lambda sql: sql.replace("FROM benchmark", "FROM variants")
    vectors = HYPOTHETICAL if config.hyde else sparse("qv", "variants", "item_id")
    ctes = [RECURSIVE_CHUNKS, REWRITES if config.rewrite else VARIANTS, over(DENSE.replace(QUERY_VECTORS, vectors))]
    if config.hybrid:
        ctes += [LEXICAL, over(QUERY_TERMS), BM25, """
stacked AS (
  SELECT query_id // 1000 AS query_id, query_id % 1000 AS ranker_id, chunk_id, ord, score, rank FROM dense WHERE rank <= 20
  UNION ALL SELECT query_id // 1000, query_id % 1000 + 1000, chunk_id, ord, score, rank FROM bm25 WHERE rank <= 20
),""" + RRF]
    else:
        ctes.append("rrf AS (SELECT query_id // 1000 AS query_id, chunk_id, score, rank FROM dense WHERE rank <= 20)")
    ctes.append(f"""
candidates AS (
  SELECT query_id, chunk_id, doc_id, score, rank, len(list_intersect(a, w))::double / greatest(1, len(a)) AS share FROM (
    SELECT r.query_id, r.chunk_id, c.doc_id, r.score, r.rank, {_words("b.text")} AS a, {_words("substr(c.text, 1, 1500)")} AS w
    FROM rrf r JOIN chunks c USING (chunk_id) JOIN benchmark b ON b.item_id = r.query_id WHERE r.rank <= 20)
)""")
    last = "candidates"
    if config.relevance_filter:
        ctes.append("""
relevant AS (
  SELECT query_id, chunk_id, doc_id, score, CASE WHEN any_kept THEN n ELSE rank END AS rank, share FROM (
    SELECT *, bool_or(share >= 0.2) OVER (PARTITION BY query_id) AS any_kept, row_number() OVER (PARTITION BY query_id, share >= 0.2 ORDER BY rank) AS n
    FROM candidates) WHERE share >= 0.2 OR NOT any_kept
)""")
        last = "relevant"
    if config.rerank:
        ctes.append(f"""
graded AS (SELECT query_id, chunk_id, doc_id, score, rank, least(10.0, round_even(10 * share, 0)) AS grade FROM {last}),
final AS (
  SELECT query_id, chunk_id, doc_id, grade / 10 AS score, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, score DESC, rank) AS rank
  FROM graded QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, score DESC, rank) <= 4
)""")
    else:
        ctes.append(f"final AS (SELECT query_id, chunk_id, doc_id, score, rank FROM {last} WHERE rank <= 4)")
    place = {
        "edges": "CASE WHEN n <= 2 THEN rank WHEN r % 2 = 1 THEN (r + 1) // 2 ELSE n - r // 2 + 1 END",
        "descending": "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank)",
    }[config.order]
    ctes.append(f"""
shown AS (
  SELECT query_id, chunk_id, doc_id, score, ({place})::int AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM final)
)""")
    return ",".join(ctes)


def measured(hits: str, source: str, k: int = 4) -> str:
    """CTEs from the hits' own to per_query."""
    return hits + "," + QRELS + f", hits AS (SELECT query_id, doc_id, rank FROM {source} WHERE rank <= {k})," + metric_ctes("hits", k)


def asked(config, no_answer: str, caveat: str) -> str:
    """Answers, critiques and final answers of the local stand-in over what ``config`` finds;
    ``caveat`` stands below an answer that its context supports in part only."""
    share = f"len(list_intersect({_words('answer')}, {_words('substr(context, 1, 8000) || chr(10) || question')}))::double / greatest(1, len({_words('answer')}))"
    return retrieval(config) + f""",
wanted AS (SELECT item_id AS query_id, text AS question, len({_words("text")}) > 0 AS retrieve FROM benchmark),
contexts AS (
  SELECT s.query_id, count(*)::int AS n, string_agg(s.chunk_id, '|' ORDER BY s.rank) AS ids,
    string_agg('[' || s.chunk_id || '] ' || coalesce(nullif(c.title, ''), c.doc_id::varchar) || chr(10) || c.text, chr(10) || chr(10) ORDER BY s.rank) AS context
  FROM shown s JOIN chunks c USING (chunk_id) GROUP BY s.query_id
),
answered AS (
  SELECT query_id, question, retrieve, context, CASE WHEN retrieve THEN coalesce(n, 0) ELSE 0 END::int AS n_hits, CASE WHEN retrieve THEN ids END AS chunk_ids,
    CASE WHEN NOT retrieve THEN substr(question, 1, 600) WHEN n > 0 THEN substr(context, 1, 600) ELSE '{no_answer}' END AS answer
  FROM wanted LEFT JOIN contexts USING (query_id)
),
noted AS (SELECT *, CASE WHEN retrieve THEN contains(lower(answer), lower('{no_answer}')) END AS abstained FROM answered),
judged AS (SELECT *, CASE WHEN retrieve AND NOT abstained THEN CASE WHEN {share} >= 0.5 THEN 'fully' ELSE 'partially' END END AS support FROM noted)
SELECT query_id, retrieve, n_hits, chunk_ids, answer, abstained, support, CASE WHEN support = 'partially' THEN answer || '{caveat}' ELSE answer END AS final FROM judged"""

"""The answers of `plans.queries` in plain SQL over the same tables."""

from __future__ import annotations

# Accepted records of the mixed feed: documents with their id, conversation turns without.
ACCEPTED = """
  SELECT 'documents' AS feed, doc_id AS key1, CAST(0 AS BIGINT) AS key2,
         CAST(doc_id AS VARCHAR) AS id, text AS document,
         '{"meta":{"lang":"' || lang || '","source":"' || source || '"},"n_chars":' || CAST(n_chars AS VARCHAR) || '}' AS metadata
  FROM documents
  UNION ALL
  SELECT 'conversations', conv_id, turn, substr(sha256(text), 1, 24), text,
         '{"conv_id":' || CAST(conv_id AS VARCHAR) || ',"role":"' || role || '","turn":' || CAST(turn AS VARCHAR) || '}'
  FROM conversations
"""

REJECTED = """
  SELECT 'events' AS feed, event_id AS key1, CAST(0 AS BIGINT) AS key2, props AS value, 'no_content' AS reason FROM events
  UNION ALL
  SELECT 'pages', page_id, CAST(0 AS BIGINT),
         '{"id":' || CAST(page_id AS VARCHAR) || ',"text":null,"url":"' || url || '"}', 'no_content' FROM pages
  UNION ALL
  SELECT 'labels', doc_id, CAST(0 AS BIGINT),
         '[' || CAST(doc_id AS VARCHAR) || ',' || CAST(quality AS VARCHAR) || ',' || CAST(toxic AS VARCHAR) || ']', 'malformed' FROM labels
  UNION ALL
  SELECT 'benchmark', item_id, CAST(0 AS BIGINT), text, 'malformed' FROM benchmark
"""

METADATA = """
  SELECT 'documents' AS feed, doc_id AS key1, CAST(0 AS BIGINT) AS key2, 'meta' AS key,
         '{"lang":"' || lang || '","source":"' || source || '"}' AS value FROM documents
  UNION ALL SELECT 'documents', doc_id, CAST(0 AS BIGINT), 'n_chars', CAST(n_chars AS VARCHAR) FROM documents
  UNION ALL SELECT 'conversations', conv_id, turn, 'conv_id', CAST(conv_id AS VARCHAR) FROM conversations
  UNION ALL SELECT 'conversations', conv_id, turn, 'turn', CAST(turn AS VARCHAR) FROM conversations
  UNION ALL SELECT 'conversations', conv_id, turn, 'role', role FROM conversations
"""



def _uuid(database: str, name: str) -> str:
    digest = f"""sha256('["default_tenant","' || {database} || '","' || {name} || '"]')"""
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return " || '-' || ".join(f"substr({digest}, {at}, {n})" for at, n in cuts)


REGISTRY = f"""
  SELECT {_uuid('lang', 'source')} AS id, source AS name, 'default_tenant' AS tenant, lang AS database
  FROM (SELECT DISTINCT lang, source FROM documents)
"""

REQUESTS = f"""
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS request, lang AS database, source AS name, 'default_tenant' AS tenant FROM documents
  UNION ALL SELECT 'e' || CAST(event_id AS VARCHAR), 'en', event_type, 'default_tenant' FROM events
  UNION ALL SELECT 'r' || id, database, id, 'default_tenant' FROM ({REGISTRY})
"""


def _resolve(chosen: str) -> str:
    return f"""
      SELECT q.request, q.database, q.name, q.tenant, {chosen} AS collection_id
      FROM ({REQUESTS}) q LEFT JOIN ({REGISTRY}) r
        ON q.tenant = r.tenant AND q.database = r.database AND q.name = r.name
    """


WORDS = "list_filter(string_split_regex(lower({text}), '\\s+'), lambda w: w <> '')"


def _words(text: str) -> str:
    return WORDS.format(text=text)


VOCABULARY = f"""
  SELECT token, CAST(CAST('0x' || substr(sha256(token), 1, 6) AS BIGINT) % 29000 + 1000 AS INTEGER) AS token_id
  FROM (SELECT unnest({_words('text')}) AS token FROM documents)
  GROUP BY token
"""


def _hashed(table: str, key: str, dim: int = 32) -> str:
    """One row per (id, bucket) with the unit-length count, as the hashing embedding gives."""
    return f"""
      SELECT g.id, g.pos, CAST(CASE WHEN n.norm > 0 THEN coalesce(c.cnt, 0) / n.norm ELSE 0 END AS FLOAT) AS value
      FROM (SELECT {key} AS id, CAST(p.pos AS INTEGER) AS pos FROM {table}, range({dim}) p(pos)) g
      LEFT JOIN (
        SELECT id, bucket, count(*) AS cnt FROM (
          SELECT id, CAST('0x' || substr(sha256(word), 1, 8) AS BIGINT) % {dim} AS bucket
          FROM (SELECT {key} AS id, unnest({_words('text')}) AS word FROM {table})
        ) GROUP BY id, bucket
      ) c ON g.id = c.id AND g.pos = c.bucket
      LEFT JOIN (
        SELECT id, sqrt(sum(cnt * cnt)) AS norm FROM (
          SELECT id, bucket, count(*) AS cnt FROM (
            SELECT id, CAST('0x' || substr(sha256(word), 1, 8) AS BIGINT) % {dim} AS bucket
            FROM (SELECT {key} AS id, unnest({_words('text')}) AS word FROM {table})
          ) GROUP BY id, bucket
        ) GROUP BY id
      ) n ON g.id = n.id
    """


L2 = "list_sum(list_transform(list_zip(q.v, d.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"
IP = "1.0 - " + DOT.format(a="q.v", b="d.v")
COSINE = (
    "1.0 - " + DOT.format(a="q.v", b="d.v")
    + " / (sqrt(" + DOT.format(a="q.v", b="q.v") + ") * sqrt(" + DOT.format(a="d.v", b="d.v") + "))"
)


def _knn(distance: str, k: int = 5) -> str:
    vectors = "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"
    return f"""
      SELECT query_id, CAST(rank AS INTEGER) AS rank, id, dist FROM (
        SELECT query_id, id, dist, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) AS rank
        FROM (SELECT q.id AS query_id, d.id, {distance} AS dist FROM ({vectors}) q, ({vectors}) d)
      ) WHERE rank <= {k}
    """


def _rounded(knn: str) -> str:
    return f"SELECT query_id, rank, id, round(dist, 6) AS distance FROM ({knn})"


BENCHMARK_HITS = f"""
  SELECT query_id, CAST(rank AS INTEGER) AS rank, id, dist FROM (
    SELECT query_id, id, dist, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) AS rank
    FROM (
      SELECT q.id AS query_id, d.id AS id, sum((CAST(q.value AS DOUBLE) - CAST(d.value AS DOUBLE)) * (CAST(q.value AS DOUBLE) - CAST(d.value AS DOUBLE))) AS dist
      FROM ({_hashed('benchmark', 'item_id')}) q JOIN ({_hashed('documents', 'doc_id')}) d ON q.pos = d.pos
      GROUP BY q.id, d.id
    )
  ) WHERE rank <= 5
"""

ORACLES: dict[str, str] = {
    "read_jsonl_file": "SELECT CAST(doc_id AS VARCHAR) AS id, text AS document FROM documents",
    "parse_records": """
      SELECT 'documents' AS feed, doc_id AS key1, CAST(0 AS BIGINT) AS key2 FROM documents
      UNION ALL SELECT 'conversations', conv_id, turn FROM conversations
      UNION ALL SELECT 'events', event_id, 0 FROM events
      UNION ALL SELECT 'pages', page_id, 0 FROM pages
    """,
    "rejected_records": REJECTED,
    "rejected_counts": f"SELECT reason, count(*) AS lines FROM ({REJECTED}) GROUP BY reason",
    "require_content": f"SELECT feed, key1, key2, document AS content FROM ({ACCEPTED})",
    "nested_path": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "nested_meta": "SELECT doc_id, lang, CAST(NULL AS VARCHAR) AS missing FROM documents",
    "stringify_values": """
      SELECT doc_id, CAST(n_chars AS VARCHAR) AS number,
             '{"lang":"' || lang || '","source":"' || source || '"}' AS object FROM documents
    """,
    "hash_ids": "SELECT doc_id, substr(sha256(text), 1, 24) AS id FROM documents",
    "choose_ids": f"SELECT feed, key1, key2, id FROM ({ACCEPTED})",
    "metadata_all": METADATA,
    "metadata_selected": f"SELECT * FROM ({METADATA}) WHERE key IN ('n_chars', 'role')",
    "import_records": ACCEPTED,
    "import_limit": f"SELECT feed, key1, key2, id FROM ({ACCEPTED}) ORDER BY feed, key1, key2 LIMIT 250",
    "stream_import": f"SELECT 'docs' AS collection_id, id, document, metadata FROM ({ACCEPTED}) WHERE feed = 'documents'",
    "mixed_import": """
      SELECT 'docs' AS collection_id, CAST(doc_id AS VARCHAR) AS id, text AS document FROM documents
      UNION ALL SELECT 'turns', CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text FROM conversations
    """,
    "added_records_stored": """
      SELECT source AS collection_id, 'd' || CAST(doc_id AS VARCHAR) AS id, text AS document FROM documents
      UNION ALL SELECT 'src1', 'b' || CAST(item_id AS VARCHAR), text FROM benchmark
    """,
    "overlapping_compactions": """
      SELECT source AS collection_id, 'd' || CAST(doc_id AS VARCHAR) AS id,
             CASE WHEN doc_id % 5 = 0 THEN 'v3' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'v2 ' || text ELSE text END AS document
      FROM documents
    """,
    "records_by_key": """
      SELECT source AS collection_id, 'd' || CAST(doc_id AS VARCHAR) AS id,
             sha256(CASE WHEN doc_id % 3 = 0 THEN 'v2 ' ELSE '' END || text) AS digest
      FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
    """,
    "split_import": f"""
      SELECT feed, key1, key2, id, CAST(NULL AS VARCHAR) AS reason FROM ({ACCEPTED})
      UNION ALL SELECT feed, key1, key2, CAST(NULL AS VARCHAR), reason FROM ({REJECTED})
    """,
    "record_position": f"""
      SELECT feed, key1, key2, row_number() OVER (ORDER BY feed, key1, key2) AS position FROM ({ACCEPTED})
    """,
    "batch_sizes": f"""
      SELECT batch, count(*) AS records FROM (
        SELECT (row_number() OVER (ORDER BY feed, key1, key2) - 1) // 100 AS batch FROM ({ACCEPTED})
      ) GROUP BY batch
    """,
    "page_records": """
      SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, text AS document FROM documents
      WHERE doc_id IN (SELECT doc_id FROM labels) ORDER BY 1 LIMIT 50 OFFSET 20
    """,
    "generated_ids": """
      SELECT doc_id, 'id-1700000000000000000-' || CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) AS id FROM documents
    """,
    "last_wins": """
      SELECT role AS collection_id, CAST(conv_id AS VARCHAR) AS id, turn, text FROM conversations
      QUALIFY row_number() OVER (PARTITION BY role, conv_id ORDER BY turn DESC) = 1
    """,
    "upsert_records": """
      SELECT 'd' || CAST(d.doc_id AS VARCHAR) AS id,
             CASE WHEN l.doc_id IS NULL THEN 'v2 ' || d.text
                  ELSE 'v3 ' || CAST(l.quality AS VARCHAR) || ' ' || d.text END AS document
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
      UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), html FROM pages
      UNION ALL SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text FROM conversations
    """,
    "content_dedupe": "SELECT substr(sha256(text), 1, 24) AS id, max(doc_id) AS doc_id FROM documents GROUP BY 1",
    "add_records": """
      WITH d AS (SELECT doc_id, substr(sha256(text), 1, 24) AS id FROM documents),
      stored AS (SELECT id, min(doc_id) AS doc_id, 'stored' AS state FROM d WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY id)
      SELECT id, doc_id, state FROM stored
      UNION ALL SELECT id, min(doc_id), 'added' FROM d WHERE id NOT IN (SELECT id FROM stored) GROUP BY id
    """,
    "add_precomputed": """
      SELECT collection_id, id, CAST(pos - 1 AS INTEGER) AS pos, round(sign * CAST(value AS DOUBLE), 6) AS value FROM (
        SELECT CAST(label AS VARCHAR) AS collection_id, vec_id AS id,
               CASE WHEN vec_id IN (SELECT doc_id FROM labels) THEN -1 ELSE 1 END AS sign,
               unnest(embedding) AS value, generate_subscripts(embedding, 1) AS pos
        FROM embeddings
      )
    """,
    "zip_batch": """
      SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch, doc_id AS id, text AS document FROM documents
    """,
    "record_count": "SELECT source, count(*) AS records FROM documents GROUP BY source",
    "collection_summary": """
      SELECT CAST(label AS VARCHAR) AS collection_id, count(*) AS records,
             CAST(min(len(embedding)) AS INTEGER) AS min_dimension, CAST(max(len(embedding)) AS INTEGER) AS max_dimension,
             CAST(CASE WHEN min(len(embedding)) = max(len(embedding)) THEN min(len(embedding)) END AS INTEGER) AS dimension
      FROM embeddings GROUP BY label
    """,
    "list_records": """
      SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, text AS document,
             '{"lang":"' || lang || '","n_chars":' || CAST(n_chars AS VARCHAR) || '}' AS metadata
      FROM documents WHERE source = 'src3'
    """,
    "stored_records": """
      SELECT source AS collection_id, 'd' || CAST(doc_id AS VARCHAR) AS id,
             CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'v2 ' || text ELSE text END AS document FROM documents
    """,
    "tenant_exists": """
      SELECT tenant, tenant IN (SELECT source FROM documents) AS exists FROM (
        SELECT source AS tenant FROM documents UNION SELECT event_type FROM events
      )
    """,
    "list_databases": "SELECT DISTINCT lang AS id, lang AS name, 'default_tenant' AS tenant FROM documents",
    "list_collections": f"SELECT * FROM ({REGISTRY}) WHERE database = 'de'",
    "describe_collections": f"""
      SELECT r.id, r.name, r.tenant, r.database, CAST(CASE WHEN s.lo = s.hi THEN s.lo ELSE 0 END AS INTEGER) AS dimension,
             coalesce(s.records, 0) AS records
      FROM ({REGISTRY}) r LEFT JOIN (
        SELECT d.lang, d.source, count(*) AS records, min(len(e.embedding)) AS lo, max(len(e.embedding)) AS hi
        FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id GROUP BY d.lang, d.source
      ) s ON r.database = s.lang AND r.name = s.source
    """,
    "collection_defaults": """
      SELECT conv_id, turn, CASE WHEN role <> 'user' THEN role ELSE 'default_tenant' END AS tenant,
             'default_database' AS database FROM conversations
    """,
    "resolve_collection": _resolve("r.id"),
    "resolve_or_uuid": _resolve(
        "CASE WHEN regexp_full_match(q.name, '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') THEN q.name ELSE r.id END"
    ),
    "resolve_or_input": _resolve("coalesce(r.id, q.name)"),
    "create_collection": f"""
      SELECT id, name, tenant, database FROM ({REGISTRY})
      UNION ALL
      SELECT {_uuid("'en'", 'role')}, role, 'default_tenant', 'en'
      FROM (SELECT DISTINCT role FROM conversations) WHERE role NOT IN (SELECT source FROM documents WHERE lang = 'en')
    """,
    "tokenize_documents": f"""
      SELECT doc_id, CAST(len(words) AS INTEGER) AS n, sha256(array_to_string(words, ' ')) AS digest
      FROM (SELECT doc_id, {_words('text')} AS words FROM documents)
    """,
    "vocab_lookup": f"""
      SELECT w.item_id, CAST(w.pos - 1 AS INTEGER) AS pos, w.word, coalesce(v.token_id, 100) AS token_id
      FROM (SELECT item_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos
            FROM (SELECT item_id, {_words('text')} AS words FROM benchmark)) w
      LEFT JOIN ({VOCABULARY}) v ON w.word = v.token
    """,
    "encode_tokens": f"""
      WITH w AS (SELECT item_id, {_words('text')} AS words FROM benchmark),
      t AS (SELECT item_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w)
      SELECT w.item_id AS id, CAST(p.pos AS INTEGER) AS pos,
             CAST(CASE WHEN p.pos = 0 THEN 101 WHEN p.pos <= len(w.words) THEN coalesce(v.token_id, 100)
                       WHEN p.pos = len(w.words) + 1 THEN 102 ELSE 0 END AS INTEGER) AS input_ids,
             CAST(CASE WHEN p.pos <= len(w.words) + 1 THEN 1 ELSE 0 END AS INTEGER) AS attention_mask,
             CAST(CASE WHEN p.pos <= len(w.words) + 1 THEN 1 ELSE 0 END AS INTEGER) AS id_mask,
             CAST(0 AS INTEGER) AS token_type_ids
      FROM w CROSS JOIN range(512) p(pos)
      LEFT JOIN t ON t.item_id = w.item_id AND t.pos = p.pos
      LEFT JOIN ({VOCABULARY}) v ON t.word = v.token
    """,
    "encode_tokens_joined": f"""
      WITH w AS (SELECT conv_id, turn, {_words('text')} AS words FROM conversations),
      p AS (SELECT conv_id, turn, words, unnest(range(least(len(words) + 2, 512))) AS pos FROM w)
      SELECT p.conv_id, p.turn, CAST(p.pos AS INTEGER) AS pos,
             CAST(CASE WHEN p.pos = 0 THEN 101 WHEN p.pos <= len(p.words) THEN coalesce(v.token_id, 100) ELSE 102 END AS INTEGER) AS token_id
      FROM p LEFT JOIN ({VOCABULARY}) v ON p.words[p.pos] = v.token
    """,
    "listing_lines": """
      SELECT 'd' || CAST(doc_id AS VARCHAR) AS id,
             sha256('- d' || CAST(doc_id AS VARCHAR)
                    || CASE WHEN contains(text, 'the') THEN chr(10) || '    Content: ' || text ELSE '' END
                    || chr(10) || '    Metadata: {"lang":"' || lang || '","n_chars":' || CAST(n_chars AS VARCHAR) || '}') AS digest
      FROM documents WHERE source = 'src3'
    """,
    "hashing_embed_documents": f"SELECT id, pos, round(CAST(value AS DOUBLE), 6) AS value FROM ({_hashed('documents', 'doc_id')})",
    "embed_documents_in_workers": f"SELECT id, pos, round(CAST(value AS DOUBLE), 6) AS value FROM ({_hashed('documents', 'doc_id')})",
    "embed_documents_cached": f"SELECT id, pos, round(CAST(value AS DOUBLE), 6) AS value FROM ({_hashed('documents', 'doc_id')})",
    "first_token_pooling": """
      SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, round(CAST(value AS DOUBLE), 6) AS value FROM (
        SELECT vec_id, unnest(embedding[1:16]) AS value, generate_subscripts(embedding[1:16], 1) AS pos FROM embeddings
      )
    """,
    "knn_l2": _rounded(_knn(L2)),
    "knn_cosine": _rounded(_knn(COSINE)),
    "knn_ip": _rounded(_knn(IP)),
    "knn_matrix": _rounded(_knn(L2, 3)),
    "blocked_knn": _rounded(_knn(L2)),
    "pivot_knn": _rounded(_knn(L2)),
    "text_query": f"""
      SELECT h.query_id, h.rank, h.id, d.text AS document,
             '{{"lang":"' || d.lang || '","source":"' || d.source || '"}}' AS metadata, round(h.dist, 6) AS distance
      FROM ({BENCHMARK_HITS}) h JOIN documents d ON h.id = d.doc_id
    """,
    "query_response_nested": f"""
      SELECT h.query_id, string_agg(CAST(h.id AS VARCHAR), ',' ORDER BY h.rank) AS ids,
             sha256(string_agg(d.text, ',' ORDER BY h.rank)) AS documents,
             sha256(string_agg('{{"lang":"' || d.lang || '","source":"' || d.source || '"}}', ',' ORDER BY h.rank)) AS metadatas,
             round(sum(h.dist ORDER BY h.rank), 6) AS distances, CAST(count(*) AS INTEGER) AS n
      FROM ({BENCHMARK_HITS}) h JOIN documents d ON h.id = d.doc_id GROUP BY h.query_id
    """,
    "vector_distances": f"""
      SELECT q.id, round({L2}, 6) AS l2, round({COSINE}, 6) AS cosine, round({IP}, 6) AS ip
      FROM (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) q
      JOIN (SELECT vec_id - 1 AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) d ON q.id = d.id
    """,
    "query_display": f"""
      SELECT h.query_id, h.rank,
             sha256('  [' || CAST(h.rank AS VARCHAR) || '] (Dist: ) ID: ' || CAST(h.id AS VARCHAR) || chr(10) || '      Content: ' || d.text) AS digest
      FROM ({BENCHMARK_HITS}) h JOIN documents d ON h.id = d.doc_id
    """,
    "format_distances": f"SELECT query_id, rank, printf('%.4f', dist) AS shown FROM ({_knn(L2)})",
}

"""For each registered query, SQL for DuckDB that gives the same rows from the same tables.

Written on its own terms: recursion over lines instead of binary search, regular expressions instead of an HTML parser, and
so on. Queries without an entry here are those no SQL of reasonable cost covers.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_NL = "chr(10)"


def _chunks(source: str, keys: str, size: int = 500, overlap: int = 2, name: str = "chunks") -> str:
    """CTEs that end in ``name``: keys, page, chunk_index, text, char_count of the pages ``source`` (keys, page, text)."""
    start = f"greatest(s, i + 1 - {overlap})" if overlap else "(i + 1)"
    return f"""
    page_rows AS ({source}),
    page_lines AS (
      SELECT {keys}, page, [trim(x) FOR x IN string_split(text, {_NL}) IF trim(x) <> ''] AS l FROM page_rows
    ),
    widths AS (SELECT {keys}, page, [length(x) FOR x IN l] AS w FROM page_lines WHERE len(l) > 0),
    walk AS (
      SELECT {keys}, page, w, 1::BIGINT AS i, 1::BIGINT AS s, w[1]::BIGINT AS held,
             NULL::BIGINT AS a, NULL::BIGINT AS b
      FROM widths
      UNION ALL
      SELECT {keys}, page, w, i + 1,
             CASE WHEN held + 1 + w[i + 1] > {size} THEN {start} ELSE s END,
             CASE WHEN held + 1 + w[i + 1] > {size}
                  THEN list_sum(list_slice(w, {start}, i + 1)) + (i + 1 - {start})
                  ELSE held + 1 + w[i + 1] END::BIGINT,
             CASE WHEN held + 1 + w[i + 1] > {size} THEN s END,
             CASE WHEN held + 1 + w[i + 1] > {size} THEN i END
      FROM walk WHERE i < len(w)
    ),
    spans AS (
      SELECT {keys}, page, a, b FROM walk WHERE a IS NOT NULL
      UNION ALL SELECT {keys}, page, s, i FROM walk WHERE i = len(w)
    ),
    joined AS (
      SELECT {keys}, page, b, array_to_string(list_slice(l, a, b), {_NL}) AS text
      FROM spans JOIN page_lines USING ({keys}, page)
    ),
    {name} AS (
      SELECT {keys}, page::BIGINT AS page,
             row_number() OVER (PARTITION BY {keys} ORDER BY page, b) - 1 AS chunk_index,
             text, length(text)::INTEGER AS char_count
      FROM joined WHERE length(text) > 30
    )"""


_DOCUMENTS = "SELECT doc_id, 1 AS page, text FROM documents"
_TURNS = "SELECT conv_id, turn + 1 AS page, text FROM conversations"


def _document_chunks(overlap: int) -> str:
    return f"""
    WITH RECURSIVE {_chunks(_DOCUMENTS, "doc_id", overlap=overlap)}
    SELECT c.doc_id, printf('%d_chunk_%04d', c.doc_id, c.chunk_index) AS chunk_id, c.chunk_index, c.page, c.text,
           c.char_count, d.lang
    FROM chunks c JOIN documents d USING (doc_id)"""


for _name, _overlap in (("chunk_documents", 2), ("chunk_overlap_zero", 0), ("chunk_overlap_fifty", 50)):
    ORACLES[_name] = _document_chunks(_overlap)

ORACLES["chunk_built_in"] = f"""
    WITH RECURSIVE {_chunks(_DOCUMENTS, "doc_id")}
    SELECT doc_id, page, chunk_index, text, char_count FROM chunks"""

_CONVERSATION_CHUNKS = f"""
    {_chunks(_TURNS, "conv_id")},
    conv_chunks AS (
      SELECT conv_id, page, chunk_index, text, char_count,
             printf('%d_chunk_%04d', conv_id, chunk_index) AS chunk_id
      FROM chunks
    )"""

ORACLES["chunk_conversation_pages"] = f"WITH RECURSIVE {_CONVERSATION_CHUNKS} SELECT * FROM conv_chunks"

ORACLES["conversation_full_text"] = f"""
    SELECT conv_id, (turn + 1)::INTEGER AS page, text AS full_text FROM conversations WHERE text <> ''"""

ORACLES["document_full_text"] = f"""
    SELECT doc_id, sha256(CASE WHEN length(text) < 2 THEN text
      ELSE left(text, length(text) // 2) || {_NL} || substr(text, length(text) // 2 + 1) END) AS sha256 FROM documents"""

# ---- extraction -----------------------------------------------------------------------------------------

_TRIMMED = f"trim(text, ' ' || {_NL})"

# The pages hold four entities only; scripts hold tags in strings, so scripts go first.
_HTML = f"""
    html_pages AS (
      SELECT page_id,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
          '<head>.*?</head>', '<x>', 'gs'), '<script>.*?</script>', '<x>', 'gs'),
          '<style>.*?</style>', '<x>', 'gs'), '<!--.*?-->', '<x>', 'gs') AS body
      FROM pages
    ),
    html_lines AS (SELECT page_id, regexp_replace(body, '(<[^>]*>)+', {_NL}, 'g') AS raw FROM html_pages),
    html_texts AS (
      SELECT page_id,
        regexp_replace(trim(replace(replace(replace(replace(raw,
          '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), ' ' || {_NL}),
          '\\n{{3,}}', {_NL} || {_NL}, 'g') AS text
      FROM html_lines
    )"""

ORACLES["html_text"] = f"WITH {_HTML} SELECT page_id, 1::INTEGER AS page, text FROM html_texts WHERE text <> ''"

ORACLES["html_chunks"] = f"""
    WITH RECURSIVE {_HTML}, {_chunks("SELECT page_id, 1 AS page, text FROM html_texts", "page_id")}
    SELECT page_id, page, chunk_index, text, char_count FROM chunks"""

ORACLES["code_language_tag"] = f"""
    SELECT doc_id, 1::INTEGER AS page, '# Language: Py' || {_NL} || {_NL} || {_TRIMMED} AS text
    FROM documents WHERE {_TRIMMED} <> ''"""

ORACLES["plain_text"] = ORACLES["markdown_text"] = f"""
    SELECT doc_id, 1::INTEGER AS page, {_TRIMMED} AS text FROM documents WHERE {_TRIMMED} <> ''"""

ORACLES["csv_text"] = """
    SELECT c_custkey, 1::INTEGER AS page,
      printf('c_custkey: %09d | c_name: %s | c_mktsegment: %s', c_custkey, c_name, c_mktsegment) AS text
    FROM customer"""

ORACLES["tsv_text"] = """
    SELECT p_partkey, 1::INTEGER AS page, printf('p_name: %s | p_brand: %s | p_size: %d', p_name, p_brand, p_size) AS text
    FROM part"""

ORACLES["json_text"] = f"""
    SELECT p_partkey, 1::INTEGER AS page,
      '{{' || {_NL} || '  "p_name": "' || p_name || '",' || {_NL} || '  "p_partkey": ' || p_partkey || ',' || {_NL} ||
      '  "kinds": [' || {_NL} || '    "' || p_brand || '",' || {_NL} || '    "' || p_type || '"' || {_NL} || '  ]' ||
      {_NL} || '}}' AS text
    FROM part"""

ORACLES["jsonl_normalise"] = f"""
    SELECT event_id, 1::INTEGER AS page, props || {_NL} || '- ' || event_type AS text FROM events"""

ORACLES["yaml_text"] = f"""
    SELECT s_suppkey, 1::INTEGER AS page,
      'key: ' || s_suppkey || {_NL} || 'kinds:' || {_NL} || '- b' || {_NL} || '- a' || {_NL} || 'nation: ' || s_nationkey AS text
    FROM supplier"""

ORACLES["toml_text"] = f"""
    SELECT s_suppkey, 1::INTEGER AS page,
      CASE WHEN s_suppkey % 3 = 0
        THEN 'name = ' || s_name || {_NL} || '[place]' || {_NL} || 'nation = ' || s_nationkey
        ELSE '{{' || {_NL} || '  "name": "' || s_name || '",' || {_NL} || '  "place": {{' || {_NL} || '    "nation": ' ||
             s_nationkey || {_NL} || '  }}' || {_NL} || '}}' END AS text
    FROM supplier"""

ORACLES["xml_text"] = f"""
    SELECT p_partkey, 1::INTEGER AS page, p_name || {_NL} || p_brand || {_NL} || p_type AS text FROM part"""

ORACLES["eml_text"] = f"""
    SELECT conv_id * 1000 + turn AS message_id, 1::INTEGER AS page,
      trim('From: ' || role || '@example.com' || {_NL} || 'Subject: conversation ' || conv_id || {_NL} || {_NL} || text,
           ' ' || {_NL}) AS text
    FROM conversations"""

ORACLES["docx_text"] = f"""
    SELECT doc_id, 1::INTEGER AS page,
      array_to_string(list_concat([trim(x) FOR x IN string_split(text, {_NL}) IF trim(x) <> ''], [lang || ' | ' || source]),
                      {_NL}) AS text
    FROM documents"""

ORACLES["pptx_text"] = f"""
    SELECT p_partkey, 1::INTEGER AS page, p_name || {_NL} || p_type || {_NL} || 'type | ' || p_type AS text FROM part
    UNION ALL SELECT p_partkey, 3::INTEGER, p_brand FROM part"""

ORACLES["xlsx_text"] = ORACLES["ods_text"] = """
    SELECT c_custkey, 1::INTEGER AS page, 'main' AS sheet_name,
      'name: ' || c_name || ' | balance: ' ||
        CASE WHEN round(c_acctbal, 2) = floor(round(c_acctbal, 2)) THEN (round(c_acctbal, 2)::BIGINT)::VARCHAR
             ELSE round(c_acctbal, 2)::VARCHAR END AS text
    FROM customer
    UNION ALL SELECT c_custkey, 3::INTEGER, 'nation', 'nation: ' || c_nationkey FROM customer"""

ORACLES["odt_text"] = f"""
    SELECT conv_id * 1000 + turn AS message_id, 1::INTEGER AS page, trim(role || {_NL} || text, ' ' || {_NL}) AS text
    FROM conversations"""

ORACLES["epub_text"] = """
    SELECT p_partkey, 1::INTEGER AS page, p_name AS text FROM part
    UNION ALL SELECT p_partkey, 3::INTEGER, p_brand FROM part"""

ORACLES["extract_errors"] = """
    SELECT p_partkey || ['.ppt', '.bin', '.docx', '.txt'][p_partkey % 4 + 1] AS path, 'extract' AS stage,
      ['MissingReader', 'no reader for ''bin''', 'BadZipFile', 'no text'][p_partkey % 4 + 1] AS reason
    FROM part"""

# ---- tables ---------------------------------------------------------------------------------------------

_CUSTOMER_LINE = """printf('c_custkey: %d | c_name: %s | c_nationkey: %d | c_acctbal: %s | c_mktsegment: %s',
      c_custkey, c_name, c_nationkey, c_acctbal::DECIMAL(12, 2)::VARCHAR, c_mktsegment)"""

ORACLES["serialise_customer"] = f"SELECT c_custkey, {_CUSTOMER_LINE} AS line FROM customer"

ORACLES["serialise_part"] = """
    SELECT p_partkey, concat_ws(' | ', 'p_name: ' || p_name, CASE WHEN p_size > 10 THEN 'p_brand: ' || p_brand END,
      CASE WHEN p_size < 40 THEN 'p_type: ' || p_type END, 'p_retailprice: ' || p_retailprice::DECIMAL(12, 2)) AS line
    FROM part"""

_SHEETS = f"""SELECT c_nationkey, 1 AS page, string_agg({_CUSTOMER_LINE}, {_NL} ORDER BY c_custkey) AS text
      FROM customer GROUP BY c_nationkey"""

ORACLES["table_chunks"] = f"""
    WITH RECURSIVE {_chunks(_SHEETS, "c_nationkey")}
    SELECT c_nationkey, chunk_index, text, char_count FROM chunks"""

_STATUS_SHEETS = f"""SELECT o_orderstatus, 1 AS page, string_agg(printf(
      'order: %d | customer: %d | price: %s | ordered: %s | priority: %s', o_orderkey, o_custkey,
      o_totalprice::DECIMAL(12, 2)::VARCHAR, o_orderdate::DATE::VARCHAR, o_orderpriority), {_NL} ORDER BY o_orderkey) AS text
      FROM orders GROUP BY o_orderstatus"""

ORACLES["table_chunks_large"] = f"""
    WITH RECURSIVE {_chunks(_STATUS_SHEETS, "o_orderstatus")}
    SELECT o_orderstatus, chunk_index, text, char_count FROM chunks"""

_PART_ROWS = """SELECT 'part_' || p_partkey AS doc_id, 1 AS page,
      printf('p_name: %s | p_brand: %s | p_type: %s | p_size: %d', p_name, p_brand, p_type, p_size) AS text FROM part"""

ORACLES["corpus_from_table"] = f"""
    WITH RECURSIVE {_chunks(_PART_ROWS, "doc_id")}
    SELECT doc_id, page, chunk_index, text, char_count, printf('%s_chunk_%04d', doc_id, chunk_index) AS chunk_id FROM chunks"""

# ---- names and requests ---------------------------------------------------------------------------------


def _name(path: str) -> str:
    return f"regexp_extract(rtrim({path}, '/'), '[^/]*$')"


def _suffix(name: str) -> str:
    return f"regexp_extract({name}, '^.+([.][^.]+)$', 1)"


def _stem(name: str) -> str:
    return f"left({name}, length({name}) - length({_suffix(name)}))"


def _slug(path: str) -> str:
    bare = f"trim(regexp_replace(lower({_stem(_name(path))}), '[^a-z0-9]+', '_', 'g'), '_')"
    return f"CASE WHEN {bare} = '' THEN 'doc_' || left(sha256({path}), 8) ELSE {bare} END"


ORACLES["doc_id_slug"] = f"""
    SELECT path, {_slug("path")} AS doc_id FROM (
      SELECT url AS path FROM pages
      UNION ALL SELECT 'Ünïts/' || p_name || '.tar.gz' FROM part
      UNION ALL SELECT 'n/' || n_nationkey || '/--.txt' FROM nation)"""

ORACLES["path_parts"] = f"""
    SELECT page_id, name, {_stem("name")} AS stem, {_suffix("name")} AS suffix,
           len(string_split(url, '/'))::INTEGER AS parts
    FROM (SELECT page_id, url, {_name("url")} AS name FROM pages)"""

ORACLES["doc_id_collisions"] = f"""
    SELECT regexp_extract(url, '^https?://[^/]*/([a-z]*)/', 1) AS client_id, {_slug("url")} AS doc_id, count(*) AS files,
           min(url) AS first_path, max(url) AS last_path
    FROM pages GROUP BY 1, 2 HAVING count(*) > 1"""

ORACLES["safe_name"] = r"""
    SELECT page_id, regexp_replace(url || '\*"<>|', '[\\/:*?"<>|]', '_', 'g') AS saved_name FROM pages"""

ORACLES["safe_str"] = """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN p_name ELSE '' END AS value,
           CASE WHEN p_partkey % 3 = 1 THEN p_name ELSE 'none' END AS value_or_none, p_size::VARCHAR AS size_text
    FROM part"""

ORACLES["text_cleanup"] = rf"""
    SELECT doc_id, {_TRIMMED} AS stripped,
           regexp_replace(replace(text, {_NL}, repeat({_NL}, 3)), '\n{{3,}}', {_NL} || {_NL}, 'g') AS collapsed,
           left({_TRIMMED}, 200) AS preview
    FROM documents"""

ORACLES["client_key"] = """
    SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN lower(c_mktsegment) END AS client_id,
           CASE WHEN c_custkey % 5 > 0 AND c_custkey % 7 > 0 THEN 'raw/' || lower(c_mktsegment) || '/' || c_name END AS object_key
    FROM customer"""

ORACLES["request_checks"] = """
    SELECT c_custkey, client_key, place_key,
      CASE WHEN client_key = '' THEN 'client_id must not be empty'
           WHEN c_custkey % 3 = 0 AND place_key = '' THEN 'directory_path must not be empty'
           WHEN c_custkey % 3 = 1 AND place_key = '' THEN 'folder_id must not be empty'
           WHEN c_custkey % 3 = 2 AND lower(place_key) NOT LIKE '%sharepoint.com%'
             THEN 'site_url must be a valid SharePoint URL' END AS problem
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 > 0 THEN lower(c_mktsegment) ELSE '' END AS client_key,
            CASE WHEN c_custkey % 5 = 0 THEN ''
                 WHEN c_custkey % 2 = 0 THEN 'https://corp.SharePoint.com/sites/' || c_name
                 ELSE '/data/' || c_name END AS place_key FROM customer)"""

# ---- files and objects ----------------------------------------------------------------------------------

ORACLES["scan_sizes"] = """
    SELECT regexp_extract(path, '[^/]*$') AS filename, 'html' AS file_type,
           round_even(strlen(html) / 1024, 2) AS size_kb, regexp_replace(path, '/[^/]*$', '') AS subfolder
    FROM (SELECT html, page_id, regexp_replace(url, '^https?://', '') || '.HTML' AS path FROM pages)
    WHERE page_id % 2 = 0 AND NOT path LIKE '%/.HTML'"""

_FOLDER = (
    "pdf docx doc txt rtf odt xlsx xls ods csv tsv pptx ppt html htm xml md markdown rst json jsonl yaml yml toml py js ts "
    "jsx tsx java cpp c h cs go rb php swift kt r sql sh bash ps1 epub eml"
).split()
_ENDINGS = "[" + ", ".join(f"'{e}'" for e in [*_FOLDER, "bin", "log", "mp4"]) + "]"

ORACLES["supported_filter"] = f"""
    SELECT p_partkey, ending NOT IN ('bin', 'log', 'mp4') AS from_folder,
      ending IN ('pdf', 'pptx', 'txt', 'docx', 'xlsx', 'xls', 'csv', 'json', 'html', 'xml', 'md', 'rtf') AS from_upload
    FROM (SELECT p_partkey, {_ENDINGS}[p_partkey % {len(_FOLDER) + 3} + 1] AS ending FROM part)"""

ORACLES["upload_gate"] = """
    SELECT doc_id, code IS NULL AS accepted, code::INTEGER AS reject_code,
      CASE code WHEN 400 THEN 'client_id is required'
        WHEN 415 THEN 'Unsupported file type ''' || ['.txt', '.exe', '.pdf', '', '.md'][doc_id % 5 + 1] || ''''
        WHEN 413 THEN 'File size ' || printf('%.1f', n_chars * 8192 / 1048576) || ' MB exceeds limit of 50 MB.'
      END AS reject_reason
    FROM (SELECT doc_id, n_chars, CASE WHEN doc_id % 7 = 0 THEN 400 WHEN doc_id % 5 IN (1, 3) THEN 415
            WHEN n_chars * 8192 > 52428800 THEN 413 END AS code FROM documents)"""

ORACLES["content_sha256"] = "SELECT doc_id, sha256(text) AS sha256 FROM documents"

_OBJECTS = """(SELECT ['raw/', 'chunks/', 'meta/'][page_id % 3 + 1] || (page_id % 10) || '/' || page_id ||
      ['.html', '.jsonl', '.json'][page_id % 3 + 1] AS name, strlen(html)::BIGINT AS size_bytes, page_id FROM pages)"""

ORACLES["object_listing"] = f"""
    SELECT name, size_bytes,
      strftime(TIMESTAMP '1970-01-01' + to_hours(page_id), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS last_modified,
      'text/html' AS content_type
    FROM {_OBJECTS} WHERE name LIKE 'raw/%'"""

ORACLES["object_exists"] = """
    SELECT 'raw/' || doc_id AS name, doc_id IN (SELECT doc_id FROM labels) AS "exists" FROM documents"""

ORACLES["put_objects"] = """
    WITH stored AS (
      SELECT 'raw/' || doc_id AS name, 0 AS size FROM labels UNION ALL SELECT 'raw/item/' || item_id, length(text) FROM benchmark
    ), put AS (SELECT 'raw/' || doc_id AS name, n_chars FROM documents)
    SELECT overwrite, name,
      (CASE WHEN p.name IS NULL OR (NOT overwrite AND s.name IS NOT NULL) THEN size ELSE n_chars END)::BIGINT AS size_bytes,
      CASE WHEN p.name IS NOT NULL THEN overwrite OR s.name IS NULL END AS success,
      CASE WHEN p.name IS NOT NULL AND s.name IS NOT NULL AND NOT overwrite THEN 'The specified blob already exists.' END AS error
    FROM stored s FULL JOIN put p USING (name), (VALUES (TRUE), (FALSE)) o(overwrite)"""

ORACLES["public_url"] = f"""
    SELECT name, 'https://account.blob.core.windows.net/container/' || name AS url FROM {_OBJECTS}"""

ORACLES["storage_status"] = f"""
    SELECT prefix, count(name) AS blob_count, coalesce(sum(size_bytes), 0)::BIGINT AS total_bytes
    FROM (VALUES ('raw/'), ('chunks/'), ('meta/'), ('faiss/')) p(prefix)
    LEFT JOIN {_OBJECTS} o ON starts_with(o.name, p.prefix) GROUP BY prefix"""

ORACLES["delete_prefix"] = f"""
    SELECT CASE WHEN name LIKE 'chunks/%' THEN 'deleted' ELSE 'kept' END AS what, count(*) AS objects
    FROM {_OBJECTS} GROUP BY 1"""

ORACLES["coverage_gap"] = """
    SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""

# ---- remote listings ------------------------------------------------------------------------------------

_REMOTE = """files AS (
      SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS parent_id, c_custkey AS key, c_name AS base,
             ['.PDF', '.draft', '', '.CSV', '.exe'][c_custkey % 5 + 1] AS ending,
             r_name || '/' || n_name || '__/' AS folder
      FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""

ORACLES["drive_manifest"] = f"""
    WITH {_REMOTE}, typed AS (
      SELECT *, ['application/pdf', 'application/vnd.google-apps.document', 'application/octet-stream', 'image/png',
                 'text/plain'][(key // 5) % 5 + 1] AS mime FROM files),
    planned AS (
      SELECT *, CASE mime WHEN 'application/pdf' THEN '.pdf' WHEN 'text/plain' THEN '.txt' ELSE lower(ending) END AS ext FROM typed)
    SELECT id, parent_id, base || ending AS name, mime,
      CASE WHEN mime LIKE '%google%' THEN 'export' WHEN ext IN ('.pdf', '.txt', '.csv') THEN 'download' ELSE 'skip' END AS action,
      CASE WHEN mime LIKE '%google%'
        THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' END AS export_mime,
      CASE WHEN mime LIKE '%google%' THEN folder || base || '.docx'
           WHEN ext IN ('.pdf', '.txt', '.csv')
             THEN folder || base || ending || CASE WHEN lower(ending) IN ('.pdf', '.csv') THEN '' ELSE ext END END AS target
    FROM planned"""

ORACLES["sharepoint_manifest"] = f"""
    WITH {_REMOTE}
    SELECT id, parent_id, base || ending AS name, FALSE AS is_folder, CASE WHEN key % 3 > 0 THEN 'https://dl/' || id END AS download_url,
      CASE WHEN lower(ending) NOT IN ('.pdf', '.csv') THEN 'unsupported type' WHEN key % 3 = 0 THEN 'no download URL' END AS reason,
      CASE WHEN lower(ending) IN ('.pdf', '.csv') AND key % 3 > 0 THEN 'download' ELSE 'skip' END AS action,
      CASE WHEN lower(ending) IN ('.pdf', '.csv') AND key % 3 > 0 THEN folder || base || ending END AS target
    FROM files"""

ORACLES["sharepoint_site"] = """
    SELECT s_suppkey AS request_id, 'https://corp.sharepoint.com/sites/nation_' || (s_suppkey % 10) || '/' AS site_url,
      'nation_' || (s_suppkey % 10) AS site_name,
      (SELECT 's' || min(n_nationkey) FROM nation WHERE n_regionkey = s_suppkey % 5
         AND contains(lower('Team ' || n_name), 'nation_' || (s_suppkey % 10))
         HAVING count(*) > 0) AS site_id
    FROM supplier"""

ORACLES["sharepoint_drive"] = """
    SELECT c_nationkey AS site_id, 'd' || coalesce(min(c_custkey) FILTER (c_custkey % 40 = 7), min(c_custkey)) AS drive_id
    FROM customer GROUP BY c_nationkey"""

ORACLES["library_paths"] = """
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN '' ELSE p_name || '/Shared Documents/x' END AS folder
    FROM part"""

# ---- vectors --------------------------------------------------------------------------------------------


def _hashed(source: str, key: str, dimension: int, prefix: str) -> str:
    """CTE ``{prefix}_vec``: key, bucket and float entry of the hashed token counts of ``source`` (key, text)."""
    return f"""
    {prefix}_tok AS (
      SELECT {key}, unnest([md5(t) FOR t IN regexp_split_to_array(lower(text), '\\s+') IF t <> '']) AS h FROM ({source})
    ),
    {prefix}_sum AS (
      SELECT {key}, ('0x' || substr(h, 1, 8))::UBIGINT % {dimension} AS bucket,
             sum(CASE WHEN ('0x' || substr(h, 9, 1))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS n
      FROM {prefix}_tok GROUP BY ALL
    ),
    {prefix}_vec AS (
      SELECT {key}, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS v
      FROM {prefix}_sum WHERE n <> 0
    )"""


ORACLES["hash_embedding"] = f"""
    WITH {_hashed("SELECT doc_id, text FROM documents", "doc_id", 384, "d")}
    SELECT doc_id, bucket::INTEGER AS bucket, round(v, 5) AS value FROM d_vec"""

ORACLES["embedding_unit"] = """
    SELECT vec_id, pos::INTEGER AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) AS value
    FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos,
                 (unnest(embedding) * (label + 2)::FLOAT)::DOUBLE AS v FROM embeddings)"""

ORACLES["vector_stats"] = """
    SELECT label, count(*) AS ntotal, max(len(embedding))::INTEGER AS dim,
           min(len(embedding)) = max(len(embedding)) AS same_dim
    FROM embeddings GROUP BY label"""

ORACLES["vector_ids"] = f"""
    WITH RECURSIVE {_chunks(_DOCUMENTS, "doc_id")}
    SELECT lang, source || '/' || doc_id || '.txt' AS rel_path, chunk_index,
      row_number() OVER (PARTITION BY lang ORDER BY source, doc_id || '.txt', chunk_index) - 1 AS vec_id
    FROM chunks JOIN documents USING (doc_id)"""

_KNN = """
    pairs AS (
      SELECT q.vec_id AS query_id, c.vec_id, c.label,
             power(list_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 2) AS distance
      FROM embeddings q, embeddings c
    ),
    best AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id)::INTEGER AS rank
      FROM pairs QUALIFY rank <= 5
    )"""

ORACLES["knn_l2"] = f"WITH {_KNN} SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM best"
ORACLES["knn_chunk_join"] = f"WITH {_KNN} SELECT query_id, rank, vec_id, label FROM best"

ORACLES["knn_blocks"] = ORACLES["knn_l2"]

# Vectors as dense lists, so that distances are list functions.
ORACLES["search_chunks"] = f"""
    WITH RECURSIVE {_chunks(_DOCUMENTS, "doc_id")},
    numbered AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY doc_id, chunk_index) - 1 AS vec_id,
        printf('%d_chunk_%04d', doc_id, chunk_index) AS chunk_id, text FROM chunks
    ),
    {_hashed("SELECT vec_id, text FROM numbered", "vec_id", 64, "c")},
    {_hashed("SELECT item_id, text FROM benchmark", "item_id", 64, "q")},
    places AS (SELECT unnest(range(64))::UBIGINT AS bucket),
    c_dense AS MATERIALIZED (
      SELECT vec_id, list(coalesce(v, 0.0) ORDER BY bucket) AS e
      FROM (SELECT vec_id, bucket FROM numbered, places) LEFT JOIN c_vec USING (vec_id, bucket) GROUP BY vec_id
    ),
    q_dense AS MATERIALIZED (
      SELECT item_id, list(coalesce(v, 0.0) ORDER BY bucket) AS e
      FROM (SELECT item_id, bucket FROM benchmark, places) LEFT JOIN q_vec USING (item_id, bucket) GROUP BY item_id
    ),
    scored AS (
      SELECT item_id, vec_id, power(list_distance(q_dense.e, c_dense.e), 2) AS distance FROM q_dense, c_dense
    ),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(distance, 9), vec_id)::INTEGER AS rank
      FROM scored QUALIFY rank <= 3
    )
    SELECT item_id AS query_id, rank, chunk_id, round(distance, 5) AS distance FROM ranked JOIN numbered USING (vec_id)"""

# ---- records and reports --------------------------------------------------------------------------------

ORACLES["chunk_jsonl_roundtrip"] = f"""
    WITH RECURSIVE {_chunks(_DOCUMENTS, "doc_id")}
    SELECT c.doc_id::VARCHAR AS doc_id, printf('%d_chunk_%04d', c.doc_id, c.chunk_index) AS chunk_id, chunk_index, page, c.text,
      'f.txt' AS source_file, 'local' AS source_type, '2024' AS uploaded_at, char_count, lang, source, TRUE AS no_vector
    FROM chunks c JOIN documents d USING (doc_id)"""

ORACLES["chunk_defaults"] = """
    SELECT event_id,
      CASE WHEN t = 3 THEN 'e' || event_id ELSE 'unknown' END AS doc_id,
      CASE t WHEN 3 THEN 'e' || event_id || '_chunk_0007' WHEN 5 THEN 'c' || event_id ELSE 'unknown_chunk_0000' END AS chunk_id,
      CASE WHEN t = 3 THEN 7 ELSE 0 END::BIGINT AS chunk_index,
      CASE WHEN t = 4 THEN 3 ELSE 0 END::BIGINT AS page,
      CASE WHEN t = 3 THEN 'é' || event_id ELSE '' END AS text,
      '' AS source_file, CASE WHEN t = 5 THEN 'upload' ELSE 'local' END AS source_type,
      '2024-01-01T00:00:00+00:00' AS uploaded_at,
      CASE WHEN t = 3 THEN 1 + length(event_id::VARCHAR) ELSE 0 END::INTEGER AS char_count,
      CASE WHEN t = 3 THEN 'x' END AS kind, CASE WHEN t = 4 THEN replace(props, ' ', '') END AS extra,
      CASE WHEN t = 4 THEN 2 END::INTEGER AS vector_size
    FROM (SELECT event_id, props, event_id % 6 AS t FROM events) WHERE t NOT IN (1, 2)"""

_META = """meta AS (
      SELECT conv_id, count(*) FILTER (text <> '') AS total_pages, 'conv ' || conv_id || '.eml' AS source_file,
             coalesce(any_value(n), 0) AS total_chunks, coalesce(any_value(chars), 0)::BIGINT AS total_chars,
             '2024-01-01' AS processed_at
      FROM conversations
      LEFT JOIN (SELECT conv_id, count(*) AS n, sum(char_count) AS chars FROM chunks GROUP BY conv_id) USING (conv_id)
      GROUP BY conv_id)"""

ORACLES["document_meta"] = f"WITH RECURSIVE {_CONVERSATION_CHUNKS}, {_META} SELECT * FROM meta"

ORACLES["object_urls"] = """
    SELECT DISTINCT conv_id, kind, 'https://account.blob.core.windows.net/container/' || kind || '/acme/' ||
      CASE kind WHEN 'raw' THEN 'conv ' || conv_id || '.eml' WHEN 'chunks' THEN 'conv_' || conv_id || '_chunks.jsonl'
                ELSE 'conv_' || conv_id || '_meta.json' END AS url
    FROM conversations, (VALUES ('raw'), ('chunks'), ('meta')) k(kind)"""

ORACLES["per_document_summary"] = f"""
    WITH RECURSIVE {_chunks(_DOCUMENTS, "doc_id")} SELECT d.doc_id, count(c.doc_id) AS chunk_count
    FROM documents d LEFT JOIN chunks c USING (doc_id) GROUP BY d.doc_id"""

ORACLES["run_summary"] = f"""
    WITH RECURSIVE {_chunks(_DOCUMENTS, "doc_id")},
    counts AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id)
    SELECT source, count(*) AS documents_processed, coalesce(sum(n), 0)::BIGINT AS total_chunks,
      count(*) FILTER (n_chars < 5000) AS uploads_succeeded, count(*) FILTER (n_chars >= 5000) AS uploads_failed,
      1.0::DOUBLE AS elapsed_seconds,
      CASE WHEN count(*) FILTER (n_chars >= 5000) > 0 THEN 'partial' ELSE 'success' END AS status
    FROM documents LEFT JOIN counts USING (doc_id) GROUP BY source"""

ORACLES["upload_results"] = """
    SELECT c_custkey, key IS NOT NULL AS success, coalesce(key, '') AS blob_name,
      'https://account.blob.core.windows.net/container/' || key AS blob_url,
      CASE WHEN key IS NULL THEN 'client_id and filename are required' END AS error
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN 'raw/' || lower(c_mktsegment) || '/' || c_name END AS key FROM customer)"""

ORACLES["run_errors"] = "SELECT source, doc_id, FALSE AS success FROM documents WHERE n_chars >= 5000"

ORACLES["run_status"] = """
    SELECT lang, count(*) FILTER (n_chars > 20000) AS uploads_failed,
      CASE WHEN max(n_chars) > 30000 THEN 'failed' WHEN max(n_chars) > 20000 THEN 'partial' ELSE 'success' END AS status
    FROM documents GROUP BY lang"""

ORACLES["ingestion_log"] = """
    SELECT event_id, CASE WHEN value > 10 THEN 'batch ' || event_type ELSE event_type || '-ingestion' END AS label,
      'meta/' || event_type || '/ingestion_' || strftime(ts, '%Y%m%d_%H%M%S') || '.json' AS object_name
    FROM events"""

# ---- catalogue ------------------------------------------------------------------------------------------

ORACLES["list_documents"] = f"""
    WITH RECURSIVE {_CONVERSATION_CHUNKS}, {_META}
    SELECT 'conv_' || conv_id AS doc_id, source_file, total_chunks, processed_at,
      'https://account.blob.core.windows.net/container/meta/acme/conv_' || conv_id || '_meta.json' AS blob_url_meta
    FROM meta"""

ORACLES["get_document"] = f"""
    WITH RECURSIVE {_CONVERSATION_CHUNKS}, {_META}
    SELECT meta.*, chunk_id, chunk_index, page, char_count, left(text, 200) AS text_preview
    FROM meta LEFT JOIN conv_chunks USING (conv_id)"""

ORACLES["get_chunks_page"] = f"""
    WITH RECURSIVE {_CONVERSATION_CHUNKS}
    SELECT conv_id, chunk_id, chunk_index, page, char_count, text FROM conv_chunks WHERE page = 2"""

ORACLES["delete_document"] = """
    SELECT doc_id, n AS blobs_deleted, CASE WHEN n = 0 THEN 'not_found' ELSE 'success' END AS status,
      CASE WHEN n = 0 THEN 'No blobs found for doc_id ''' || doc_id || '''.'
           ELSE 'Deleted ' || n || ' blob(s) for ''' || doc_id || '''.' END AS message
    FROM (SELECT 'd' || d.doc_id AS doc_id,
            CASE WHEN l.doc_id IS NULL THEN 0 WHEN d.doc_id % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS n
          FROM documents d LEFT JOIN labels l USING (doc_id) WHERE toxic = 1 OR lang = 'es')"""

ORACLES["delete_survivors"] = f"""
    WITH RECURSIVE {_chunks(_DOCUMENTS, "doc_id")}
    SELECT doc_id, printf('%d_chunk_%04d', doc_id, chunk_index) AS chunk_id FROM chunks
    WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""

_CLASSES = """(SELECT lang, doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'rebuild' ELSE 'skipped' END AS action
     FROM documents)"""

ORACLES["rebuild_classes"] = f"SELECT * FROM {_CLASSES}"

ORACLES["rebuild_status"] = f"""
    SELECT count(*) FILTER (action = 'rebuild' AND lang <> 'de') AS rebuilt, count(*) FILTER (action = 'skipped') AS skipped,
      count(*) FILTER (action = 'rebuild' AND lang = 'de') AS errors, 'partial' AS status
    FROM {_CLASSES}"""

_JOBS = "SELECT user_id AS request_id, arg_max(event_type, event_id) AS status, arg_max(props, event_id) AS detail FROM events GROUP BY user_id"

ORACLES["job_status"] = _JOBS

ORACLES["job_lookup"] = f"""
    SELECT c_custkey AS request_id, coalesce(status, 'not_found') AS status, detail
    FROM customer LEFT JOIN ({_JOBS}) ON request_id = c_custkey"""

ORACLES["last_write_wins"] = """
    SELECT user_id, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""

# ---- whole jobs -----------------------------------------------------------------------------------------

ORACLES["ingest_directory"] = ORACLES["stream_ingest"] = """
    SELECT doc_id, sha256(text) AS sha256, length(text)::INTEGER AS n_chars FROM documents"""

ORACLES["ingest_vectors"] = "SELECT 'acme' AS client_id, TRUE AS all_chunks, TRUE AS dense_ids FROM documents GROUP BY 1"

ORACLES["ingest_drive"] = "SELECT doc_id, sha256(text) AS sha256, length(text)::INTEGER AS n_chars, 'done' AS job FROM documents"

ORACLES["rebuild_index"] = """
    SELECT 'acme' AS client_id, 'success' AS status, 0::BIGINT AS skipped, 0::BIGINT AS errors, TRUE AS all_chunks,
      TRUE AS all_new FROM documents GROUP BY 1"""

_INGESTED = "doc_id, sha256(text) AS sha256, length(text)::INTEGER AS n_chars"

ORACLES["reingest_changed"] = f"""
    SELECT {_INGESTED} FROM (
      SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'new ' || text ELSE text END AS text FROM documents WHERE doc_id % 4 <> 2)"""

ORACLES["ingest_file"] = f"""
    SELECT {_INGESTED}, 'part' || doc_id % 4 || '.txt' AS filename, 'success' AS status,
      '2024-01-01T00:00:00+00:00' AS uploaded_at FROM documents"""

ORACLES["ingest_sharepoint"] = f"SELECT {_INGESTED}, 'done' AS job FROM documents WHERE doc_id % 4 > 0"

ORACLES["delete_stored"] = f"""
    SELECT {_INGESTED}, 'kept' AS status, TRUE AS stored FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT NULL, file, NULL, status, stored FROM (VALUES ('part0', 'kept', TRUE), ('part2', 'kept', TRUE),
      ('part1', 'success', FALSE), ('part3', 'success', FALSE), ('ghost', 'not_found', FALSE)) t(file, status, stored)"""

ORACLES["rebuild_document"] = """
    SELECT doc_id, CASE WHEN doc_id % 4 = 2 THEN 32 ELSE 64 END::INTEGER AS vector_size FROM documents"""

ORACLES["rebuild_folded"] = """
    SELECT folded, doc_id, 'hashing-' || size AS model, size AS vector_size, CASE WHEN folded THEN size ELSE 64 END AS stored
    FROM (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 8 WHEN 2 THEN 32 ELSE 64 END AS size FROM documents),
      (VALUES (FALSE), (TRUE)) t(folded)"""

ORACLES["exact_dedup"] = """
    SELECT doc_id, doc_id = min(doc_id) OVER (PARTITION BY text) AS kept, min(doc_id) OVER (PARTITION BY text) AS first_id
    FROM documents"""

ORACLES["delimited_lines"] = """
    SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos,
      'c_custkey: ' || c_custkey || ' | name: a "b", ' || c_name ||
      CASE WHEN c_custkey % 3 > 0 THEN ' | segment: ' || c_mktsegment ELSE '' END AS line FROM customer"""

ORACLES["delimited_records"] = """
    SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos,
      CASE WHEN c_custkey % 7 > 0 THEN 'key: ' || c_custkey || ' | the' || chr(10) || 'name: first; "line"' || chr(10) || 'of ' ||
        c_name || ' | size: 5" wide' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE ' | segment: ' || c_mktsegment END END AS line,
      CASE WHEN c_custkey % 7 = 0 THEN '4 columns expected, 5 found' END AS error
    FROM customer"""

ORACLES["knn_pivots"] = ORACLES["knn_l2"]

ORACLES["ingest_long"] = ORACLES["ingest_directory"]

ORACLES["stream_rewritten"] = """
    SELECT doc_id, sha256(text) AS sha256, length(text)::INTEGER AS n_chars, CASE WHEN doc_id % 4 = 1 THEN 2 ELSE 1 END::BIGINT AS versions
    FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'new ' || text ELSE text END AS text FROM documents)"""

ORACLES["utc_now"] = "SELECT event_id, TRUE AS well_formed, TRUE AS recent FROM events"

ORACLES["list_hidden"] = """
    SELECT filename, 'html' AS file_type, round_even(size / 1024, 2) AS size_kb, subfolder
    FROM (SELECT CASE WHEN page_id % 2 = 0 THEN '_p' ELSE 'p' END || page_id || '.html' AS filename,
            CASE page_id % 3 WHEN 0 THEN '_drafts' WHEN 1 THEN 'a/.cache' ELSE 'a' END AS subfolder,
            CASE WHEN page_id % 5 = 0 THEN 0 ELSE strlen(html) END AS size
          FROM pages)"""

ORACLES["document_meta_files"] = f"""
    WITH RECURSIVE {_CONVERSATION_CHUNKS}, {_META}
    SELECT 'conv_' || conv_id AS doc_id, source_file, total_pages, total_chunks, total_chars
    FROM meta WHERE total_chars % 7 <> 0"""

ORACLES["object_round_trip"] = """
    WITH docs AS (SELECT doc_id, 'raw/' || lang || '/' || doc_id || '.txt' AS name, text FROM documents),
    puts AS (
      SELECT doc_id % 3 = 1 AS overwrite, CASE WHEN doc_id % 2 = 0 THEN 'new/' || name ELSE name END AS name,
        CASE WHEN doc_id % 3 = 1 THEN 'True ' ELSE 'False ' END || text AS text, doc_id
      FROM docs WHERE doc_id % 3 < 2),
    done AS (SELECT *, overwrite OR doc_id % 2 = 0 AS success FROM puts)
    SELECT 'put' AS what, name AS blob_name, success, CASE WHEN NOT success THEN 'The specified blob already exists.' END AS detail FROM done
    UNION ALL SELECT 'read', name, TRUE, sha256(text) FROM (
      SELECT name, text FROM done WHERE success
      UNION ALL SELECT name, text FROM docs WHERE name NOT IN (SELECT name FROM done WHERE success))"""

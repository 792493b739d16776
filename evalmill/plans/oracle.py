"""For each registered query the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from evalmill import fixed_values as fixed

# Inputs, as in views.py.
EVAL_ITEMS = """
eval_items AS (
  SELECT d.doc_id AS item_id, d.lang AS subject, d.text AS prompt,
         l.quality + 2 * l.toxic AS answer_idx
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""

RAW_OUTPUTS = r"""
letters_of AS (
  SELECT doc_id AS item_id, substr('ABCD', CAST(1 + n_chars % 4 AS INT), 1) AS p FROM documents
),
raw_outputs AS (
  SELECT item_id, CASE item_id % 7
    WHEN 0 THEN '<|channel|>analysis<|message|>think<|end|><|start|>assistant<|channel|>final<|message|>Answer: ' || p || '<|return|>'
    WHEN 1 THEN '<|channel|>final<|message|>' || p || ' because<|return|>'
    WHEN 2 THEN '<|channel|>FINAL<|message|>' || chr(10) || 'The answer : ' || p || chr(10) || '<|end|>'
    WHEN 3 THEN '<|channel|>final<|message|>I cannot say<|return|>'
    WHEN 4 THEN '<|channel|>analysis<|message|>so answer: ' || p
    WHEN 5 THEN '<|channel|>final<|message|>Answer: A<|end|><|channel|>final<|message|>Answer: ' || p || '<|return|>'
    WHEN 6 THEN '<|channel|>analysis<|message|>x<|channel|>final<|message|>' || p || '<|return|>'
  END AS raw
  FROM letters_of
)"""

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def channels(source: str) -> str:
    """CTEs that parse the column ``raw`` of ``source`` into ``parsed``."""
    pattern = r"(?s)<\|channel\|>(\w+)<\|message\|>(.*?)(?:<\|end\|>|<\|return\|>)"
    spans = ",\n    ".join(
        f"""list_filter(list_zip(regexp_extract_all(raw, '{pattern}', 1),
                regexp_extract_all(raw, '{pattern}', 2)),
                lambda s: lower(s[1]) = '{name}') AS {name}_spans"""
        for name in ("final", "analysis", "commentary")
    )
    return f"""
spans AS (
  SELECT *, {spans}
  FROM {source}
),
parsed AS (
  SELECT item_id, raw,
    coalesce(trim(final_spans[-1][2], {SPACES}), trim(raw, {SPACES})) AS response,
    trim(analysis_spans[-1][2], {SPACES}) AS analysis,
    trim(commentary_spans[-1][2], {SPACES}) AS commentary
  FROM spans
)"""


PREDS = r"""
preds AS (
  SELECT *, CASE
    WHEN regexp_extract(response, '[Aa]nswer\s*:\s*([ABCD])', 1) <> ''
      THEN regexp_extract(response, '[Aa]nswer\s*:\s*([ABCD])', 1)
    WHEN substr(response, 1, 1) IN ('A', 'B', 'C', 'D') THEN substr(response, 1, 1)
    ELSE '?' END AS pred
  FROM parsed
)"""

SCORED = (
    f"WITH {EVAL_ITEMS}, {RAW_OUTPUTS}, {channels('raw_outputs')}, {PREDS},"
    """
scored AS (
  SELECT e.item_id, coalesce(e.subject, 'unknown') AS subject, e.prompt, p.raw, p.response,
    p.analysis, p.pred,
    CASE WHEN e.answer_idx BETWEEN 0 AND 3
         THEN substr('ABCD', CAST(e.answer_idx + 1 AS INT), 1) END AS gold
  FROM preds p JOIN eval_items e ON p.item_id = e.item_id
)"""
)

TALLY = """count(*) FILTER (WHERE pred = gold) AS correct, count(*) AS total,
  count(*) FILTER (WHERE pred = gold) / greatest(1, count(*)) AS accuracy"""

RUN_PATH = """
WITH run AS (
  SELECT event_id AS req_id, event_type,
    CASE WHEN event_id % 11 = 0 THEN 'nobody' WHEN event_id % 2 = 0 THEN 'gpt-oss-20b' ELSE 'gpt-oss-120b' END AS model,
    CASE WHEN event_id % 4 <> 0 THEN 'v' || (event_id % 3) END AS asked,
    CASE WHEN event_id % 3 = 0 THEN 'low' WHEN event_id % 2 = 1 THEN 'high' ELSE 'medium' END AS level
  FROM events
),
shaped AS (
  SELECT *, coalesce(asked, 'v1') AS version,
    CASE WHEN model = 'nobody' THEN 'unknown name' WHEN asked = 'v2' THEN 'unknown version'
         WHEN req_id % 7 = 0 THEN '$.temperature: above maximum 2'
         WHEN req_id % 5 = 0 AND req_id % 2 = 0 THEN 'messages required' END AS problem,
    '{' || chr(10) || '  "response": "' || event_type || '",' || chr(10) || '  "analysis": "' || req_id || '",'
      || chr(10) || '  "commentary": null,' || chr(10) || '  "reasoning_level": "' || level || '"' || chr(10) || '}'
      AS body
  FROM run
)"""

KV_PARAMS = """
kv_params AS (
  SELECT event_id AS req_id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS pos,
    unnest(['on=True', 'k=' || json_extract_string(props, '$.k'),
            'v=' || CAST(CAST(value AS DECIMAL(10, 2)) AS VARCHAR), 'name=a=b', 'big=1_000',
            'exp=1e5', ' pad = 7 ', 'malformed']) AS kv
  FROM events
),
cut AS (
  SELECT req_id, pos, trim(substr(kv, 1, instr(kv, '=') - 1)) AS key,
         trim(substr(kv, instr(kv, '=') + 1)) AS text
  FROM kv_params WHERE instr(kv, '=') > 0
)"""

REQUESTS = """
requests AS (
  SELECT event_id AS req_id,
    CASE event_id % 3 WHEN 0 THEN 'sdxl' WHEN 1 THEN 'sdxl-spo' ELSE 'sdxl-pixel-art' END AS model,
    CASE WHEN event_id % 5 = 0 THEN '  ' WHEN event_id % 5 = 1 THEN 'Pixel ' || event_type
         ELSE event_type END AS prompt,
    CASE WHEN event_id % 2 = 0 THEN '' END AS negative_prompt,
    CASE WHEN event_id % 4 <> 0 THEN CAST(floor(value) AS BIGINT) END AS steps
  FROM events
)"""

PAYLOAD_PARTS = """
payload_parts AS (
  SELECT page_id, 0 AS part_no, 'text/html' AS content_type, html AS data FROM pages
  UNION ALL SELECT page_id, 1, 'application/json', '{"page_id": ' || page_id || '}' FROM pages
  UNION ALL SELECT page_id, 2, 'image/png', base64(encode(url)) FROM pages
  UNION ALL SELECT page_id, 3, NULL, url FROM pages
)"""

INDEX_UPDATES = """
index_updates AS (
  SELECT 'u' || user_id AS name, event_type AS version, 'u' || user_id || '/' || event_type AS path,
         sha256(props) AS sha256, event_id AS seq
  FROM events
)"""

STATUS_FOLD = """
WITH run_updates AS (
  SELECT user_id AS run_id, ts, event_id AS seq,
    CASE event_type WHEN 'signup' THEN 'not_started' WHEN 'view' THEN 'running'
      WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'errored' END
      AS status,
    CASE WHEN event_type = 'signup' THEN ts END AS started_at,
    CASE WHEN event_type IN ('purchase', 'error') THEN ts END AS finished_at,
    CASE WHEN event_type = 'purchase' THEN value END AS metric
  FROM events
),
folded AS (
  SELECT run_id,
    arg_max(status, (ts, seq)) FILTER (WHERE status IS NOT NULL) AS status,
    arg_max(started_at, (ts, seq)) FILTER (WHERE started_at IS NOT NULL) AS started_at,
    arg_max(finished_at, (ts, seq)) FILTER (WHERE finished_at IS NOT NULL) AS finished_at,
    arg_max(metric, (ts, seq)) FILTER (WHERE metric IS NOT NULL) AS metric,
    max(ts) AS updated_at, count(*) AS updates
  FROM run_updates GROUP BY run_id
)
SELECT run_id, status, strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') AS started_at,
  strftime(finished_at, '%Y-%m-%dT%H:%M:%SZ') AS finished_at, metric,
  strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS updated_at, updates,
  (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS duration
FROM folded
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case_by_model(name: str) -> str:
    arms = " ".join(
        f"WHEN '{model}' THEN {_quoted(value) if isinstance(value, str) else value}"
        for model, values in fixed.IMAGE_DEFAULTS.items()
        if (value := values.get(name)) is not None
    )
    return f"CASE model {arms} END"


ORACLE: dict[str, str] = {
    "dataset_scan": "SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'",
    "dataset_uri_normalise": """
        SELECT doc_id,
          CASE WHEN doc_id % 3 = 1 THEN '/abs/' || source ELSE source END AS dataset,
          CASE doc_id % 3 WHEN 1 THEN '/abs/' || source WHEN 2 THEN '/data/' || source END AS folder
        FROM documents""",
    "dataset_materialise": """
        SELECT true AS ok, 'src3' AS dataset, count(*) AS num_examples
        FROM documents WHERE source = 'src3'""",
    "file_payload_flags": """
        WITH params AS (
          SELECT event_id AS req_id, CASE WHEN event_id % 2 = 0 THEN 'file' ELSE 'prompt' END AS key,
            CASE event_id % 3 WHEN 0 THEN 'region' WHEN 1 THEN 'nation' ELSE 'missing' END AS name
          FROM events
        )
        SELECT req_id, key, key = 'file' AND name <> 'missing' AS from_file,
          CASE WHEN key = 'file' AND name <> 'missing' THEN true END AS is_base64,
          CASE WHEN NOT (key = 'file' AND name <> 'missing') THEN name || '.parquet' END AS kept
        FROM params""",
    "content_manifest": """
        SELECT doc_id, 'sha256:' || sha256(text) AS sha256, octet_length(encode(text)) AS length
        FROM documents""",
    "payload_write": f"""
        WITH {PAYLOAD_PARTS}
        SELECT page_id, CAST(part_no AS BIGINT) AS part_no, content_type,
          CASE WHEN content_type LIKE 'text/%' THEN 'text'
               WHEN content_type = 'application/json' THEN 'json' ELSE 'binary' END AS kind,
          CASE WHEN content_type LIKE 'text/%' THEN octet_length(encode(data))
               WHEN content_type = 'application/json'
                 THEN octet_length(encode('{{' || chr(10) || '  "page_id": ' || page_id || chr(10) || '}}'))
               ELSE octet_length(from_base64(data)) END AS n_bytes
        FROM payload_parts WHERE content_type IS NOT NULL AND data IS NOT NULL""",
    "payload_files": f"""
        WITH {PAYLOAD_PARTS},
        shaped AS (
          SELECT page_id, CAST(part_no AS BIGINT) AS part_no, content_type,
            CASE WHEN content_type LIKE 'text/%' THEN encode(data)
                 WHEN content_type = 'application/json'
                   THEN encode('{{' || chr(10) || '  "page_id": ' || page_id || chr(10) || '}}')
                 ELSE from_base64(data) END AS body
          FROM payload_parts WHERE content_type IS NOT NULL AND data IS NOT NULL
        )
        SELECT page_id, part_no,
          CASE part_no WHEN 0 THEN 'text' WHEN 1 THEN 'json' ELSE 'binary' END AS kind,
          page_id || '/artifact-' || part_no || CASE part_no WHEN 0 THEN '.html' WHEN 1 THEN '.json' ELSE '.png' END
            AS name,
          octet_length(body) AS length, sha256(body) AS sha256, CAST(NULL AS VARCHAR) AS error
        FROM shaped""",
    "file_manifest": """
        SELECT source || '/' || lang || '/' || doc_id || '.txt' AS name,
          'sha256:' || sha256(CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END) AS sha256,
          CASE WHEN doc_id % 13 = 0 THEN 0 ELSE octet_length(encode(text)) END AS length,
          CAST(NULL AS VARCHAR) AS error
        FROM documents WHERE doc_id % 10 <> 0""",
    "request_defaults": f"""
        WITH {REQUESTS}
        SELECT req_id, model, prompt,
          coalesce(negative_prompt, {_case_by_model('negative_prompt')}) AS negative_prompt,
          CAST({_case_by_model('width')} AS BIGINT) AS width,
          CAST({_case_by_model('height')} AS BIGINT) AS height,
          coalesce(steps, CAST({_case_by_model('steps')} AS BIGINT)) AS steps,
          CAST({_case_by_model('guidance_scale')} AS DOUBLE) AS guidance_scale,
          CAST({_case_by_model('seed')} AS BIGINT) AS seed,
          CAST({_case_by_model('lora_strength')} AS DOUBLE) AS lora_strength,
          CAST(NULL AS VARCHAR) AS error
        FROM requests""",
    "required_filter": f"""
        WITH {REQUESTS}
        SELECT req_id, model, CASE WHEN trim(prompt) = '' THEN 'prompt required' END AS error
        FROM requests""",
    "prompt_rewrite": f"""
        WITH {REQUESTS}
        SELECT req_id, model,
          CASE WHEN model = 'sdxl-pixel-art' AND NOT starts_with(lower(trim(prompt)), 'pixel')
               THEN 'pixel, ' || trim(prompt) ELSE trim(prompt) END AS prompt,
          CASE WHEN model = 'sdxl-pixel-art' THEN negative_prompt
               ELSE nullif(negative_prompt, '') END AS negative_prompt
        FROM requests""",
    "system_message_inject": """
        SELECT conv_id, turn, role, text FROM conversations
        UNION ALL
        SELECT conv_id, min(turn) - 1, 'system', 'Reasoning: medium'
        FROM conversations GROUP BY conv_id HAVING NOT bool_or(role = 'system')""",
    "eval_prompt_build": f"""
        SELECT item_id, CAST(0 AS BIGINT) AS pos, 'system' AS role,
          {_quoted(fixed.EVAL_INSTRUCTION)} || 'low' AS content FROM benchmark
        UNION ALL SELECT item_id, 1, 'user', text FROM benchmark""",
    "conversation_record": f"""
        SELECT doc_id, 'user' AS first_role, {_quoted(fixed.TRAIN_INSTRUCTION)} AS instruction,
          'image' AS image_type, octet_length(encode(source)) AS image_bytes,
          'assistant' AS second_role, text AS answer
        FROM documents""",
    "kv_typed_parse": rf"""
        WITH {KV_PARAMS},
        kinds AS (
          SELECT *, CASE WHEN lower(text) IN ('true', 'false') THEN 'bool'
            WHEN regexp_full_match(text, '[+-]?\d+\.\d+') THEN 'float'
            WHEN regexp_full_match(text, '[+-]?\d+(_\d+)*') THEN 'int' ELSE 'string' END AS kind
          FROM cut
        )
        SELECT req_id, CAST(pos AS BIGINT) AS pos, key, kind,
          CASE WHEN kind = 'bool' THEN lower(text) = 'true' END AS bool_value,
          CASE WHEN kind = 'int' THEN TRY_CAST(replace(text, '_', '') AS BIGINT) END AS int_value,
          CASE WHEN kind = 'float' THEN TRY_CAST(text AS DOUBLE) END AS float_value, text
        FROM kinds""",
    "param_layering": f"""
        WITH {KV_PARAMS},
        layers AS (
          SELECT req_id, key, text AS value, 1 AS layer, pos FROM cut
          UNION ALL
          SELECT e.event_id, d.key, d.value, 0, 0 FROM events e,
            (VALUES ('on', 'False'), ('k', '0'), ('arch', 'trm'), ('lr', '1e-4')) d(key, value)
        ),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY req_id, key ORDER BY layer DESC, pos DESC) AS n
          FROM layers
        )
        SELECT req_id, key, value, CAST(layer AS BIGINT) AS layer FROM ranked WHERE n = 1""",
    "contract_check": """
        SELECT event_id, k BETWEEN 0 AND 50 AS ok,
          CASE WHEN k < 0 THEN '$.k: below minimum 0' WHEN k > 50 THEN '$.k: above maximum 50'
               ELSE '' END AS errors
        FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "contract_rules": """
        WITH given AS (
          SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
            CASE event_id % 3 WHEN 0 THEN 'wide' WHEN 1 THEN 'narrow' ELSE 'none' END AS model
          FROM events
        ),
        judged AS (
          SELECT event_id, model,
            CASE WHEN model = 'none' THEN '$: no contract'
                 WHEN model = 'wide' AND k < 0 THEN '$.k: below minimum 0'
                 WHEN model = 'wide' AND k > 50 THEN '$.k: above maximum 50'
                 WHEN model = 'narrow' AND k < 10 THEN '$.k: below minimum 10'
                 WHEN model = 'narrow' AND k > 20 THEN '$.k: above maximum 20' ELSE '' END AS errors
          FROM given
        )
        SELECT event_id, model, errors = '' AS ok, errors FROM judged""",
    "aligned_score_join": f"{SCORED} SELECT item_id, subject, pred, gold FROM scored",
    "aligned_score_full": f"""
        {SCORED},
        p AS (SELECT item_id, pred FROM preds WHERE item_id % 5 <> 0),
        g AS (
          SELECT item_id, coalesce(subject, 'unknown') AS subject,
            CASE WHEN answer_idx BETWEEN 0 AND 3 THEN substr('ABCD', CAST(answer_idx + 1 AS INT), 1) END AS gold
          FROM eval_items WHERE item_id % 7 <> 0
        )
        SELECT item_id, subject, pred, gold,
          CASE WHEN p.item_id IS NULL THEN 'no prediction' WHEN g.item_id IS NULL THEN 'no gold' ELSE 'matched' END
            AS alignment
        FROM p FULL JOIN g USING (item_id)""",
    "zip_scores": f"""
        {SCORED},
        p AS (
          SELECT row_number() OVER (ORDER BY item_id) - 1 AS position, pred FROM scored WHERE item_id % 9 <> 4
        ),
        g AS (
          SELECT row_number() OVER (ORDER BY item_id) - 1 AS position, subject, gold
          FROM scored WHERE item_id % 9 <> 4 AND item_id < 900
        )
        SELECT position, subject, pred, gold, CASE WHEN g.position IS NULL THEN 'no right' ELSE 'matched' END AS alignment
        FROM p LEFT JOIN g USING (position)""",
    "coverage_listing": """
        SELECT d.doc_id, d.lang, l.doc_id IS NOT NULL AS built,
          CASE WHEN l.doc_id IS NOT NULL THEN 'built' ELSE 'not built yet' END AS status
        FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id
        ORDER BY d.doc_id""",
    "required_set_check": """
        WITH needed AS (
          SELECT c.conv_id, r.role FROM (SELECT DISTINCT conv_id FROM conversations) c,
            (VALUES ('system'), ('user'), ('assistant')) r(role)
        ),
        lacking AS (
          SELECT conv_id, role FROM needed EXCEPT SELECT conv_id, role FROM conversations
        )
        SELECT c.conv_id, count(l.role) = 0 AS ok,
          coalesce(string_agg(l.role, ', ' ORDER BY l.role), '') AS missing
        FROM (SELECT DISTINCT conv_id FROM conversations) c
        LEFT JOIN lacking l ON c.conv_id = l.conv_id GROUP BY c.conv_id""",
    "lookup_with_fallback": """
        SELECT o.o_orderkey, o.o_custkey, coalesce(p.c_name, f.c_name, 'base') AS adapter,
          CASE WHEN p.c_name IS NOT NULL THEN 'primary' WHEN f.c_name IS NOT NULL THEN 'fallback'
               ELSE 'default' END AS provenance
        FROM orders o
        LEFT JOIN customer p ON o.o_custkey = p.c_custkey AND p.c_mktsegment = 'BUILDING'
        LEFT JOIN customer f ON o.o_custkey = f.c_custkey AND f.c_mktsegment = 'FURNITURE'""",
    "version_resolve": f"""
        WITH {INDEX_UPDATES},
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY name, version ORDER BY seq DESC) AS n
          FROM index_updates
        ),
        entries AS (SELECT name, version, path, sha256, seq FROM ranked WHERE n = 1),
        latest AS (SELECT name, arg_max(version, seq) AS latest FROM entries GROUP BY name),
        asked AS (
          SELECT event_id AS req_id,
            CASE event_id % 3 WHEN 2 THEN 'x' ELSE 'u' END || user_id AS name,
            CASE event_id % 3 WHEN 0 THEN event_type WHEN 2 THEN 'none' END AS version
          FROM events
        ),
        wanted AS (
          SELECT a.req_id, a.name, l.latest, coalesce(a.version, l.latest) AS version
          FROM asked a LEFT JOIN latest l ON a.name = l.name
        )
        SELECT w.req_id, w.name, w.version, e.path, e.sha256,
          CASE WHEN w.latest IS NULL THEN 'unknown name' WHEN e.sha256 IS NULL THEN 'unknown version'
               ELSE 'ok' END AS status
        FROM wanted w LEFT JOIN entries e ON w.name = e.name AND w.version = e.version""",
    "overall_accuracy": f"{SCORED} SELECT {TALLY} FROM scored",
    "accuracy_by_subject": f"{SCORED} SELECT subject, {TALLY} FROM scored GROUP BY subject",
    "accuracy_rollup": f"""
        {SCORED} SELECT subject, CAST(GROUPING(subject) AS BIGINT) AS level, {TALLY}
        FROM scored GROUP BY ROLLUP (subject)""",
    "coverage_counts": """
        SELECT count(l.doc_id) AS built, count(*) - count(l.doc_id) AS not_built, count(*) AS total
        FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""",
    "batch_plan": """
        SELECT lang, count(*) AS examples,
          greatest(1, CAST(ceil(count(*) * 1.5 / 8.0) AS BIGINT)) AS steps
        FROM documents GROUP BY lang""",
    "eval_report": f"""
        {SCORED}
        SELECT 'summary' AS section, NULL AS subject, true AS ok, count(*) AS items,
          count(*) FILTER (WHERE pred = gold) AS correct,
          CAST(printf('%.4f', count(*) FILTER (WHERE pred = gold) / count(*)) AS DOUBLE) AS accuracy,
          least(10, count(*)) AS samples, 'low' AS level FROM scored
        UNION ALL
        SELECT 'subject', subject, true, total, correct, CAST(printf('%.4f', accuracy) AS DOUBLE), NULL, NULL
        FROM (SELECT subject, {TALLY} FROM scored GROUP BY subject)""",
    "report_write": f"""
        {SCORED}
        SELECT 'summary' AS section, NULL AS subject, true AS ok, count(*) AS items,
          count(*) FILTER (WHERE pred = gold) AS correct,
          CAST(printf('%.4f', count(*) FILTER (WHERE pred = gold) / count(*)) AS DOUBLE) AS accuracy,
          (SELECT '[' || string_agg(item_id, ', ' ORDER BY item_id) || ']'
           FROM (SELECT item_id FROM scored ORDER BY item_id LIMIT 10)) AS samples, 'test' AS split FROM scored
        UNION ALL
        SELECT 'subject', subject, true, total, correct, CAST(printf('%.4f', accuracy) AS DOUBLE), NULL, NULL
        FROM (SELECT subject, {TALLY} FROM scored GROUP BY subject)""",
    "member_listing": """
        SELECT conv_id, turn AS position,
          role || CASE role WHEN 'assistant' THEN ' (A10G)' ELSE ' (CPU)' END AS label
        FROM conversations""",
    "member_listing_text": """
        SELECT conv_id, count(*) AS members,
          string_agg(role || CASE role WHEN 'assistant' THEN ' (A10G)' ELSE ' (CPU)' END, ', '
                     ORDER BY turn) AS listing
        FROM conversations GROUP BY conv_id""",
    "running_accuracy": f"""
        {SCORED},
        steps AS (
          SELECT subject, item_id,
            CAST(sum(CASE WHEN pred = gold THEN 1 ELSE 0 END) OVER w AS BIGINT) AS correct,
            row_number() OVER w AS seen, count(*) OVER (PARTITION BY subject) AS total
          FROM scored WINDOW w AS (PARTITION BY subject ORDER BY item_id)
        )
        SELECT subject, item_id, correct, seen, 100.0 * CAST(correct AS DOUBLE) / seen AS percent
        FROM steps WHERE seen % 10 = 0 OR seen = total""",
    "head_n": "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 100",
    "sample_records": f"""
        {SCORED}
        SELECT item_id, right(prompt, 200) AS prompt_end, left(raw, 200) AS generated_raw,
          left(response, 100) AS response, nullif(left(analysis, 100), '') AS analysis, pred,
          gold AS gt, subject
        FROM scored ORDER BY item_id LIMIT 10""",
    "tagged_channels": f"""
        WITH {RAW_OUTPUTS}, {channels('raw_outputs')}
        SELECT item_id, response, analysis, commentary FROM parsed""",
    "tagged_channels_text": f"""
        WITH wrapped AS (
          SELECT doc_id AS item_id, '<|channel|>analysis<|message|>' || text ||
            '<|end|><|start|>assistant<|channel|>commentary<|message|> ' || lang ||
            '<|end|><|channel|>Final<|message|>' || chr(10) || text || '<|return|>' AS raw
          FROM documents
        ), {channels('wrapped')}
        SELECT item_id AS doc_id, response, analysis, commentary FROM parsed""",
    "choice_letter": f"""
        WITH {RAW_OUTPUTS}, {channels('raw_outputs')}, {PREDS} SELECT item_id, pred FROM preds""",
    "gold_letter": f"""
        WITH {EVAL_ITEMS},
        given AS (
          SELECT item_id, subject,
            CASE WHEN item_id % 3 <> 0 THEN answer_idx + (item_id % 5) - 1 END AS idx
          FROM eval_items
        )
        SELECT item_id,
          CASE WHEN idx IS NULL THEN upper(left(subject, 1))
               WHEN idx BETWEEN 0 AND 3 THEN substr('ABCD', CAST(idx + 1 AS INT), 1) END AS gold,
          CASE WHEN idx < 0 OR idx > 3 THEN 'answer index out of range: ' || idx END AS error
        FROM given""",
    "level_normalise": """
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high'
          ELSE 'max' END AS level, doc_id % 4 <> 3 AS valid
        FROM documents""",
    "snippet": """
        SELECT doc_id, left(text, 100) AS head, right(text, 200) AS tail,
          CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS preview,
          CASE WHEN doc_id % 2 <> 0 THEN nullif(left(text, 100), '') END AS analysis
        FROM documents""",
    "image_payload_decode": r"""
        WITH stored AS (
          SELECT page_id, CASE page_id % 4
              WHEN 0 THEN from_hex('89504E470D0A1A0A') || encode(url)
              WHEN 1 THEN from_hex('89504E470D0A1A0A') || encode(url)
              WHEN 2 THEN from_hex('FFD8FFE0') || encode(url) END AS body,
            CASE page_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'png' WHEN 2 THEN 'jpeg' END AS image_format
          FROM pages
        )
        SELECT page_id, image_format, octet_length(body) AS n_bytes, sha256(body) AS sha256,
          CASE page_id % 8 WHEN 3 THEN 'unknown image format' WHEN 7 THEN 'could not decode image' END AS error
        FROM stored""",
    "payload_encode": "SELECT page_id, base64(encode(html)) AS payload FROM pages",
    "utc_iso": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events",
    "unit_round": """
        WITH sizes AS (
          SELECT event_id, value, CAST(floor(value) AS BIGINT) * 10000000 + event_id * 7919 AS used
          FROM events
        ),
        rounded AS (
          SELECT event_id, value,
            CAST(printf('%.3f', used / 1073741824.0) AS DOUBLE) AS peak_gib,
            CAST(printf('%.3f', (used // 3) / 1073741824.0) AS DOUBLE) AS start_gib
          FROM sizes
        )
        SELECT event_id, peak_gib, CAST(printf('%.3f', peak_gib - start_gib) AS DOUBLE) AS added_gib,
          CAST(printf('%.2f', value / CAST(60 AS DOUBLE)) AS DOUBLE) AS minutes
        FROM rounded""",
    "index_upsert": f"""
        WITH {INDEX_UPDATES},
        written AS (
          SELECT * FROM index_updates
          UNION ALL
          SELECT 'u' || c_custkey, 'base', 'u' || c_custkey || '/base', sha256(c_name), -1
          FROM customer
        ),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY name, version ORDER BY seq DESC) AS n FROM written
        ),
        entries AS (SELECT name, version, path, sha256, seq FROM ranked WHERE n = 1)
        SELECT *, first_value(version) OVER (PARTITION BY name ORDER BY seq DESC) AS latest
        FROM entries""",
    "index_stored": f"""
        WITH {INDEX_UPDATES},
        written AS (
          SELECT * FROM index_updates
          UNION ALL
          SELECT 'u' || c_custkey, 'base', 'u' || c_custkey || '/base', sha256(c_name), -1
          FROM customer
        ),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY name, version ORDER BY seq DESC) AS n FROM written
        ),
        entries AS (SELECT name, version, path, sha256, seq FROM ranked WHERE n = 1)
        SELECT *, first_value(version) OVER (PARTITION BY name ORDER BY seq DESC) AS latest
        FROM entries""",
    "run_status_fold": STATUS_FOLD,
    "run_status_stream": STATUS_FOLD,
    "run_status_rejects": """
        WITH run_updates AS (
          SELECT CASE WHEN event_id % 7 <> 0 THEN user_id END AS run_id,
            CASE WHEN event_id % 11 <> 0 THEN ts END AS ts, event_id AS seq,
            CASE WHEN event_id % 13 = 0 THEN 'lost' ELSE
              CASE event_type WHEN 'signup' THEN 'not_started' WHEN 'view' THEN 'running'
                WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'errored' END
            END AS status,
            CASE WHEN event_type = 'signup' THEN events.ts END AS started_at,
            CASE WHEN event_type IN ('purchase', 'error') THEN events.ts END AS finished_at,
            CASE WHEN event_type = 'purchase' THEN value END AS metric
          FROM events
        )
        SELECT run_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, seq, status,
          strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') AS started_at,
          strftime(finished_at, '%Y-%m-%dT%H:%M:%SZ') AS finished_at, metric
        FROM run_updates
        WHERE run_id IS NULL OR ts IS NULL OR status = 'lost'""",
    "batch_predict": f"WITH {RAW_OUTPUTS} SELECT item_id, raw FROM raw_outputs",
    "benchmark_eval": f"{SCORED} SELECT subject, {TALLY} FROM scored GROUP BY subject",
    "run_requests": f"""
        WITH {REQUESTS},
        given AS (
          SELECT r.*, CAST(json_extract_string(e.props, '$.k') AS INT) AS k,
            CAST(CAST(e.value AS DECIMAL(10, 2)) AS DOUBLE) AS guidance_scale
          FROM requests r JOIN events e ON r.req_id = e.event_id
        ),
        filled AS (
          SELECT req_id, model, prompt, coalesce(negative_prompt, {_case_by_model('negative_prompt')})
              AS negative_prompt,
            coalesce(steps, {_case_by_model('steps')}) AS full_steps, steps, guidance_scale, k
          FROM given
        )
        SELECT req_id, model,
          CASE WHEN model = 'sdxl-pixel-art' AND NOT starts_with(lower(trim(prompt)), 'pixel')
               THEN 'pixel, ' || trim(prompt) ELSE trim(prompt) END AS prompt,
          CASE WHEN model = 'sdxl-pixel-art' THEN negative_prompt
               ELSE nullif(negative_prompt, '') END AS negative_prompt,
          CAST(1024 AS BIGINT) AS width, CAST(1024 AS BIGINT) AS height, CAST(full_steps AS BIGINT) AS steps, guidance_scale,
          CAST(CASE req_id % 3 WHEN 0 THEN req_id ELSE 42 END AS BIGINT) AS seed,
          CASE req_id % 3 WHEN 2 THEN CAST(0.5 AS DOUBLE) END AS lora_strength,
          CASE WHEN k > 90 OR req_id % 3 = 1 OR steps < 1 THEN
              concat_ws('; ', CASE WHEN k > 90 THEN '$: unknown keys k' END,
                CASE WHEN req_id % 3 = 1 THEN '$.width: not of type integer' END,
                CASE WHEN steps < 1 THEN '$.steps: below minimum 1' END)
            WHEN trim(prompt) = '' THEN 'prompt required' END AS error
        FROM filled""",
    "training_requests": f"""
        WITH given AS (
          SELECT event_id AS req_id, 'src' || (event_id % 25) AS dataset,
            CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
          FROM events
        ),
        counted AS (SELECT source, count(*) AS examples FROM documents GROUP BY source),
        filled AS (
          SELECT g.req_id, g.dataset,
            CASE WHEN req_id % 2 = 0 THEN k / CAST(10 AS DOUBLE) END AS epochs,
            CASE WHEN req_id % 4 = 1 THEN k ELSE 30 END AS given_steps,
            CASE WHEN req_id % 3 = 0 THEN k - 5 END AS max_train_samples,
            CASE WHEN req_id % 5 = 0 THEN 3 ELSE 2 END AS batch_size, c.examples AS all_examples
          FROM given g LEFT JOIN counted c ON g.dataset = c.source
        ),
        used AS (
          SELECT *, CASE WHEN max_train_samples > 0 AND all_examples > max_train_samples
                         THEN max_train_samples ELSE all_examples END AS examples
          FROM filled
        )
        SELECT req_id, dataset, examples, epochs,
          CASE WHEN epochs > 0 AND examples IS NULL THEN NULL
               WHEN epochs > 0 THEN greatest(1, CAST(ceil(examples * epochs / (batch_size * 4)) AS BIGINT))
               ELSE given_steps END AS steps,
          max_train_samples, CAST(batch_size AS BIGINT) AS batch_size,
          CAST(4 AS BIGINT) AS gradient_accumulation_steps, CAST(0.0002 AS DOUBLE) AS learning_rate,
          {_quoted(fixed.TRAIN_INSTRUCTION)} AS instruction, CAST(NULL AS VARCHAR) AS error
        FROM used""",
    "training_recipe": f"""
        WITH runs AS (
          SELECT CAST(c_custkey AS VARCHAR) AS codename, c_mktsegment AS dataset_dir FROM customer
        ),
        layers AS (
          SELECT r.codename, d.key, d.value, 0 AS layer, 0 AS pos
          FROM runs r, (VALUES {', '.join(f"({_quoted(k)}, {_quoted(v)})" for k, v in fixed.RECIPE_DEFAULTS.items())}) d(key, value)
          UNION ALL SELECT codename, 'data_paths', '[/data/' || dataset_dir || ']', 0, 0 FROM runs
          UNION ALL SELECT codename, '+run_name', codename, 0, 0 FROM runs
          UNION ALL SELECT codename, 'hydra.run.dir', '/runs/' || codename || '/hydra-out', 0, 0 FROM runs
          UNION ALL SELECT CAST(o_custkey AS VARCHAR),
            CASE WHEN o_orderkey % 2 = 0 THEN 'epochs' ELSE 'note' END, CAST(o_orderkey AS VARCHAR), 1,
            o_orderkey
          FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
        ),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY codename, key ORDER BY layer DESC, pos DESC) AS n
          FROM layers
        )
        SELECT codename, key || '=' || value AS argument FROM ranked WHERE n = 1""",
    "training_export": """
        SELECT source, count(*) AS examples, greatest(1, CAST(ceil(count(*) / 8.0) AS BIGINT)) AS steps
        FROM documents GROUP BY source""",
    "training_export_capped": """
        WITH capped AS (
          SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents
        )
        SELECT source, count(*) AS examples, greatest(1, CAST(ceil(count(*) / 8.0) AS BIGINT)) AS steps
        FROM capped WHERE n <= 7 GROUP BY source""",
    "file_payload_scan": """
        WITH params AS (
          SELECT event_id AS req_id, CASE WHEN event_id % 2 = 0 THEN 'file' ELSE 'prompt' END AS key,
            CASE WHEN event_id % 3 = 0 THEN '/none' ELSE '/data/' || (event_id % 300) || '.txt' END AS value
          FROM events
        ),
        met AS (
          SELECT p.*, base64(encode(d.text)) AS payload
          FROM params p LEFT JOIN documents d ON p.key = 'file' AND p.value = '/data/' || d.doc_id || '.txt'
        )
        SELECT req_id, key, payload IS NOT NULL AS from_file, length(coalesce(payload, value)) AS n_chars,
          sha256(coalesce(payload, value)) AS sha256
        FROM met""",
    "benchmark_by_subject": f"{SCORED} SELECT subject, {TALLY} FROM scored WHERE item_id % 4 <> 0 GROUP BY subject",
    "benchmark_running": f"""
        {SCORED},
        steps AS (
          SELECT item_id,
            CAST(sum(CASE WHEN pred = gold THEN 1 ELSE 0 END) OVER w AS BIGINT) AS correct,
            row_number() OVER w AS seen, count(*) OVER () AS total
          FROM scored WHERE item_id % 4 <> 0 WINDOW w AS (ORDER BY item_id)
        )
        SELECT item_id, correct, seen, 100.0 * CAST(correct AS DOUBLE) / seen AS percent
        FROM steps WHERE seen % 10 = 0 OR seen = total""",
    "benchmark_samples": f"""
        {SCORED}
        SELECT item_id, right(prompt, 200) AS prompt_end, left(raw, 200) AS generated_raw,
          left(response, 100) AS response, nullif(left(analysis, 100), '') AS analysis, pred,
          gold AS gt, subject
        FROM scored WHERE item_id % 4 <> 0 ORDER BY item_id LIMIT 10""",
    "benchmark_report": f"""
        {SCORED}
        SELECT 'summary' AS section, NULL AS subject, count(*) AS items,
          count(*) FILTER (WHERE pred = gold) AS correct,
          CAST(printf('%.4f', count(*) FILTER (WHERE pred = gold) / count(*)) AS DOUBLE) AS accuracy,
          least(10, count(*)) AS samples, 'test' AS split, CAST(0 AS BIGINT) AS max_items, 'low' AS level
        FROM scored WHERE item_id % 4 <> 0
        UNION ALL
        SELECT 'subject', subject, total, correct, CAST(printf('%.4f', accuracy) AS DOUBLE), NULL, NULL, NULL, NULL
        FROM (SELECT subject, {TALLY} FROM scored WHERE item_id % 4 <> 0 GROUP BY subject)""",
    "chat_requests": """
        WITH chat AS (
          SELECT event_id AS req_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'gpt-oss-20b' ELSE 'gpt-oss-120b' END AS model,
            CASE WHEN event_id % 3 = 0 THEN 'high' ELSE 'medium' END AS reasoning_level,
            CASE WHEN event_id % 7 = 0 THEN '$.temperature: above maximum 2'
                 WHEN event_id % 5 = 0 THEN 'messages required' END AS error
          FROM events
        )
        SELECT req_id, model, CAST(CASE model WHEN 'gpt-oss-20b' THEN 2048 ELSE 256 END AS BIGINT) AS max_tokens,
          CAST(CASE WHEN req_id % 7 = 0 THEN 3 ELSE 0.7 END AS DOUBLE) AS temperature, reasoning_level,
          CASE req_id % 5 WHEN 0 THEN 'system:Reasoning: ' || reasoning_level
            WHEN 1 THEN 'system:' || event_type || '|user:' || event_type
            ELSE 'system:Reasoning: ' || reasoning_level || '|user:' || event_type END AS turns, error
        FROM chat""",
    "vision_requests": """
        WITH read AS (
          SELECT page_id AS req_id, url AS prompt,
            CASE WHEN page_id % 4 = 0 THEN from_hex('89504E470D0A1A0A') || encode(url)
                 WHEN page_id % 8 = 1 THEN from_hex('FFD8FFE0') || encode(url) END AS body,
            CASE WHEN page_id % 4 = 0 THEN 'png' WHEN page_id % 8 = 1 THEN 'jpeg' END AS image_format
          FROM pages
        )
        SELECT req_id, prompt, CAST(128 AS BIGINT) AS max_tokens, image_format, sha256(body) AS image_sha256,
          CASE WHEN req_id % 6 = 0 THEN 'adapter0' ELSE 'base' END AS adapter,
          CASE WHEN req_id % 6 = 0 THEN 'primary' ELSE 'default' END AS provenance,
          CASE WHEN req_id % 4 = 3 THEN '$: image is required' WHEN body IS NULL THEN 'could not decode image' END AS error
        FROM read""",
    "run_path_files": f"""
        {RUN_PATH}
        SELECT req_id, model, version, model || '/' || version || '/' || req_id || '/artifact-0.json' AS name,
          octet_length(encode(body)) AS length, sha256(body) AS sha256, CAST(NULL AS VARCHAR) AS error
        FROM shaped WHERE problem IS NULL""",
    "run_path_rejects": f"""
        {RUN_PATH}
        SELECT req_id, CASE WHEN problem = 'unknown name' AND asked IS NULL THEN NULL ELSE version END AS version,
          problem AS error
        FROM shaped WHERE problem IS NOT NULL""",
    "run_to_payloads": """
        WITH chat AS (
          SELECT event_id AS req_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'gpt-oss-20b' ELSE 'gpt-oss-120b' END AS model,
            CASE WHEN event_id % 3 = 0 THEN 'high' ELSE 'medium' END AS reasoning_level,
            CASE WHEN event_id % 7 = 0 THEN '$.temperature: above maximum 2'
                 WHEN event_id % 5 = 0 THEN 'messages required' END AS error
          FROM events
        )
        SELECT req_id, model, 'application/json' AS content_type, 'json' AS kind,
          sha256('{' || chr(10) || '  "response": "' || event_type || '",' || chr(10) || '  "analysis": "' || req_id
            || '",' || chr(10) || '  "commentary": null,' || chr(10) || '  "reasoning_level": "' || reasoning_level
            || '"' || chr(10) || '}') AS sha256, CAST(NULL AS VARCHAR) AS error
        FROM chat WHERE error IS NULL""",
    "index_build": """
        WITH files AS (
          SELECT source AS name, lang AS version, source || '/' || lang AS path, doc_id AS seq, sha256(text) AS sha256,
            CASE doc_id % 5 WHEN 0 THEN 'config.json' WHEN 1 THEN 'weights-' || doc_id || '.bin' WHEN 2 THEN 'README.md'
              WHEN 3 THEN 'handler.py' ELSE 'notes.txt' END AS member
          FROM documents
        ),
        bundles AS (
          SELECT name, version, max(path) AS path, max(seq) AS seq,
            max(sha256) FILTER (WHERE member = 'config.json') AS config, max(sha256) FILTER (WHERE member = 'README.md') AS readme,
            count(*) FILTER (WHERE member LIKE 'weights-%.bin') AS weights
          FROM files GROUP BY name, version
        ),
        complete AS (
          SELECT name, version, path, 'sha256:' || sha256(readme || chr(10) || config) AS sha256, seq
          FROM bundles WHERE config IS NOT NULL AND readme IS NOT NULL AND weights > 0
        ) SELECT * FROM complete""",
    "index_rejects": """
        WITH files AS (
          SELECT source AS name, lang AS version, source || '/' || lang AS path, doc_id AS seq, sha256(text) AS sha256,
            CASE doc_id % 5 WHEN 0 THEN 'config.json' WHEN 1 THEN 'weights-' || doc_id || '.bin' WHEN 2 THEN 'README.md'
              WHEN 3 THEN 'handler.py' ELSE 'notes.txt' END AS member
          FROM documents
        ),
        bundles AS (
          SELECT name, version, max(path) AS path, max(seq) AS seq,
            max(sha256) FILTER (WHERE member = 'config.json') AS config, max(sha256) FILTER (WHERE member = 'README.md') AS readme,
            count(*) FILTER (WHERE member LIKE 'weights-%.bin') AS weights
          FROM files GROUP BY name, version
        ),
        complete AS (
          SELECT name, version, path, 'sha256:' || sha256(readme || chr(10) || config) AS sha256, seq
          FROM bundles WHERE config IS NOT NULL AND readme IS NOT NULL AND weights > 0
        )
        SELECT name, version, concat_ws(', ', CASE WHEN readme IS NULL THEN 'missing: README.md' END,
            CASE WHEN config IS NULL THEN 'missing: config.json' END,
            CASE WHEN weights = 0 THEN 'missing: weights-*.bin (at least one)' END) AS problems
        FROM bundles WHERE config IS NULL OR readme IS NULL OR weights = 0""",
    "full_listing": """
        WITH files AS (
          SELECT source AS name, lang AS version, source || '/' || lang AS path, doc_id AS seq, sha256(text) AS sha256,
            CASE doc_id % 5 WHEN 0 THEN 'config.json' WHEN 1 THEN 'weights-' || doc_id || '.bin' WHEN 2 THEN 'README.md'
              WHEN 3 THEN 'handler.py' ELSE 'notes.txt' END AS member
          FROM documents
        ),
        bundles AS (
          SELECT name, version, max(path) AS path, max(seq) AS seq,
            max(sha256) FILTER (WHERE member = 'config.json') AS config, max(sha256) FILTER (WHERE member = 'README.md') AS readme,
            count(*) FILTER (WHERE member LIKE 'weights-%.bin') AS weights
          FROM files GROUP BY name, version
        ),
        complete AS (
          SELECT name, version, path, 'sha256:' || sha256(readme || chr(10) || config) AS sha256, seq
          FROM bundles WHERE config IS NOT NULL AND readme IS NOT NULL AND weights > 0
        ),
        latest AS (SELECT name, arg_max(path, seq) AS bundle FROM complete GROUP BY name),
        members AS (
          SELECT source AS name, count(*) AS members,
            string_agg(lang || CASE lang WHEN 'en' THEN ' (A10G)' ELSE ' (CPU)' END, ', ' ORDER BY lang) AS listing
          FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY source
        ),
        sources AS (SELECT DISTINCT source AS name FROM documents UNION SELECT lower(r_name) FROM region)
        SELECT s.name, '1' AS version, CASE WHEN l.name IS NULL THEN 'not built yet' ELSE 'built' END AS status,
          l.bundle, m.members, m.listing
        FROM sources s LEFT JOIN latest l ON s.name = l.name LEFT JOIN members m ON s.name = m.name ORDER BY s.name""",
}

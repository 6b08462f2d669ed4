"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from . import secrets
from .chat import Template

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_COMPONENTS = """
reach AS (
  SELECT id, id AS root FROM nodes
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id WHERE r.root < l.b
),
comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""

NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
s AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ') || ' ' || len(w)]
    ELSE list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.id < y.id GROUP BY ALL),
g AS (SELECT a, b FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
links AS (SELECT a, b FROM g UNION ALL SELECT b, a FROM g),
nodes AS (SELECT doc_id AS id FROM documents),{_COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n ON n.id = doc_id JOIN comp ON comp.id = doc_id"""

REPEATS = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, length(h) // 2 AS n, c, substr(h, c * 2000 + 1, 2098) AS x FROM (SELECT *, unnest(range(0, length(h) // 2000 + 1)) AS c FROM t)),
b AS (SELECT doc_id, n, c * 1000 + j AS i, j, x FROM (SELECT *, unnest(range(0, greatest(0, least(1000, n - c * 1000)))) AS j FROM k)),
w AS (SELECT doc_id, i, substr(x, 2 * j + 1, 2) AS byte, CASE WHEN i + 50 <= n THEN hash(substr(x, 2 * j + 1, 100)) END AS win FROM b),
f AS (SELECT win, min(doc_id) AS first FROM w WHERE win IS NOT NULL GROUP BY win),
m AS (SELECT w.doc_id, i, byte, coalesce(first < w.doc_id, false)::INT AS bad FROM w LEFT JOIN f USING (win)),
c AS (SELECT doc_id, i, byte, max(bad) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
e AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c),
r AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM t LEFT JOIN r USING (doc_id)"""

VECTORS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
m AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) AS top FROM v),
u AS (SELECT id, label, v, sqrt(list_dot_product(v, v)) AS n FROM (SELECT id, label, list_transform(v, lambda x: x / top) AS v FROM m WHERE top > 0)),
links AS (SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.label = y.label AND x.id <> y.id AND len(x.v) = len(y.v) WHERE x.n > 0 AND y.n > 0 AND list_dot_product(x.v, y.v) / (x.n * y.n) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings),{_COMPONENTS},
k AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON comp.id = vec_id LEFT JOIN k ON k.id = vec_id"""


MIDDLE = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM h),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""

REVISITS = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
g AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::BIGINT) AS g FROM p)
SELECT page_id, strlen(x) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (g[i // 4 + 1] >> (15 - 5 * (i % 4))::BIGINT) % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM g"""


def chat(template: Template = Template()) -> str:
    """For roles that the template names."""

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    pattern = "|".join("".join(f"\\{c}" if not c.isalnum() and c not in "<>" else c for c in m) for m in template.control())
    size = " ".join(f"WHEN {q(r)} THEN {len(a) + len(b)}" for r, (a, b) in template.markers.items())
    steps = " OR ".join(f"(before = {q(a)} AND role = {q(b)})" for a, bs in template.follows.items() for b in sorted(bs))
    learnt, final = (", ".join(map(q, sorted(x))) for x in (template.loss, template.final))
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
o AS (SELECT *, lag(role, 1, '') OVER w AS before, lead(role) OVER w IS NULL AS last FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
    string_agg(text, '' ORDER BY turn, role, text) FILTER (role IN ({learnt})) AS l,
    sum(CASE role {size} END + length(text) + len(regexp_extract_all(text, '\\\\')) + len(regexp_extract_all(text, {q(pattern)})))::BIGINT AS formatted_chars,
    bool_and({steps}) AND bool_or(last AND role IN ({final})) AS valid FROM o GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(coalesce(l, '')) AS loss_chars, sha256(coalesce(l, '')) AS loss_sha256, formatted_chars, valid FROM g"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash_dedup": NEAR, "op4_chat_formatting": chat(), "op5_suffix_dedup": REPEATS, "op6_embedding_dedup": VECTORS,
        "op10_secret_scans": secrets.report_sql(), "op12_fill_in_middle": MIDDLE, "op13_warc_revisits": REVISITS,
    }

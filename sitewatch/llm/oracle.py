"""DuckDB SQL for the operators that SQL expresses, written apart from their Spark code.

Without SQL, and tested against a plain version instead: 1 (a learned score), 2 (tests
on spans that overlap), 3 and 7 (all 50-byte strings and all pairs of sets: too slow on
whole tables), 5 (edit distances of windows), 6 (a rounding that the operator chooses
within the bounds that the contract sets), 8 (a checksum of whole texts, bit by bit).
"""

from __future__ import annotations

from sitewatch.llm.quality import BOILERPLATE

# --- 4: what an archive of all pages must give back ---

_WARC = """
SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM (SELECT page_id, html, first_id, strlen(html) >= 100 AND page_id <> first_id AS again
      FROM (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
            FROM pages))
"""

# --- 9: counts of words, windows and lines, and the rules for lines ---

_QUALITY = r"""
WITH told AS (
  SELECT row_number() OVER () AS rid, doc_id, text,
         regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
),
windows AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS shown
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM told)
),
repeated AS (
  SELECT rid, count(DISTINCT place) AS n
  FROM (SELECT rid, unnest(range(i, i + 8)) AS place
        FROM (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, shown) > 1))
  GROUP BY rid
),
whole AS (
  SELECT rid, sum(length(translate(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13), ''))) AS left_chars
  FROM (SELECT rid, unnest(lines) AS line FROM told)
  WHERE NOT (
    length(line) - length(translate(line, '|»›•', '')) >= 3
    OR length(line) - length(translate(line, '#*$%&|<>', '')) > 0.1::DOUBLE * length(line)
    OR (NOT regexp_matches(rtrim(line), '[.!?:;…"''”’)\]][\r\x{85}\x{2028}\x{2029}]?$')
        AND len(string_split_regex(trim(line), '[ \t]+')) < 3)
    OR regexp_matches(lower(line), '{phrases}'))
  GROUP BY rid
),
judged AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         CASE WHEN word_chars > 0 THEN 1.0::DOUBLE - coalesce(left_chars, 0)::DOUBLE / word_chars ELSE 0.0::DOUBLE END
           AS lost_share
  FROM told LEFT JOIN repeated USING (rid) LEFT JOIN whole USING (rid)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_share <= 0.6::DOUBLE AS kept
FROM judged
""".replace("{phrases}", "|".join(BOILERPLATE))

# --- 10: turns in order, their loss text, and the length of the template ---

_CHAT = r"""
WITH told AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL
  VALUES (-1::BIGINT, 0::BIGINT, 'user', '<|im_end|><|im_start|>assistant ok'),
         (-1::BIGINT, 1::BIGINT, 'assistant', '<|im_end|><|im_start|>assistant ok')
),
placed AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM told
),
said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS everything,
         coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '') AS learned,
         -- A backslash, each control string and a line feed in a role take one more character.
         sum(length(role) + length(text) + length('<|im_start|>') + length('<|im_end|>') + 2
             + length(role) - length(replace(role, '\', '')) + length(text) - length(replace(text, '\', ''))
             + (length(role) - length(replace(role, '<|', ''))) // 2 + (length(text) - length(replace(text, '<|', ''))) // 2
             + length(role) - length(replace(role, chr(10), '')))::BIGINT AS formatted_chars
  FROM placed GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(everything) AS turns_sha256, length(learned) AS loss_chars,
       sha256(learned) AS loss_sha256, formatted_chars
FROM said
"""

# --- 11: clustering, its rounds one after the other ---

_KEPT = """
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0{also}
)"""

_ASSIGNED = """
a{r} AS MATERIALIZED (
  SELECT rid, vec_id, x, c, d
  FROM (SELECT k.*, c.c,
               list_sum(list_transform(range(1, 65), lambda i: (k.x[i] - c.x[i]) * (k.x[i] - c.x[i])))::BIGINT AS d
        FROM kept k, c{r} c)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1
)"""

_MOVED = """
c{next} AS MATERIALIZED (
  SELECT c, coalesce(m.x, c{r}.x) AS x
  FROM c{r} LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS x
    FROM (SELECT c, i, sum(a{r}.x[i])::HUGEINT AS s, count(*) AS n FROM a{r}, range(1, 65) AS places(i) GROUP BY c, i)
    GROUP BY c
  ) m USING (c)
)"""


def _clustering(rounds: int = 10) -> str:
    steps = [
        _KEPT.format(also=" AND len(embedding) = 64"),
        """
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), rid) - 1)::INT AS c, x FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), rid) <= 8
)""",
    ]
    for r in range(rounds):
        steps += [_ASSIGNED.format(r=r), _MOVED.format(r=r, next=r + 1)]
    steps.append(_ASSIGNED.format(r=rounds))
    return (
        "WITH"
        + ",".join(steps)
        + f"""
SELECT vec_id, c AS cluster, d AS distance,
       sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""
    )


# --- 12: Merkle trees level by level, proofs by place ---

_CRC32 = """
  ~list_reduce(
     list_prepend(4294967295::BIGINT, list_transform(range(1, length(d) + 1), lambda i: ascii(d[i])::BIGINT)),
     lambda crc, byte: list_reduce(
       list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
       lambda bits, ignored: xor(bits >> 1, CASE WHEN bits & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)))
  & 4294967295::BIGINT"""

_MERKLE = f"""
WITH RECURSIVE told AS (
  SELECT row_number() OVER () AS rid, *, doc_id::VARCHAR AS d FROM documents
),
struck AS (
  SELECT rid, doc_id, lang,
         {{head}} || {{n}} || {{tail}} AS plain,
         {{head}} || {{n_more}} || {{tail}} AS more,
         d IS NOT NULL AND n_chars IS NOT NULL AND (
         {_CRC32}) % 7 = 0 AS hit
  FROM told
),
leaves AS MATERIALIZED (
  SELECT rid, doc_id, lang, sha256(plain) AS leaf, CASE WHEN hit THEN sha256(more) ELSE sha256(plain) END AS changed
  FROM struck
),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY lang) AS size
  FROM leaves
),
nodes AS (
  SELECT lang, 0 AS lvl, idx, size, leaf AS digest FROM placed
  UNION ALL
  SELECT lang, lvl + 1, idx // 2, (any_value(size) + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx))
  FROM nodes WHERE size > 1 GROUP BY lang, lvl, idx // 2
),
tops AS MATERIALIZED (
  SELECT lang, lvl AS height, digest AS subroot,
         row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS size
  FROM nodes WHERE size = 1
),
crown AS (
  SELECT 0 AS lvl, idx, size, subroot AS digest FROM tops
  UNION ALL
  SELECT lvl + 1, idx // 2, (any_value(size) + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx))
  FROM crown WHERE size > 1 GROUP BY lvl, idx // 2
),
ways AS (
  SELECT rid, p.lvl AS step, (p.idx >> p.lvl) % 2 = 1 AS on_left, n.digest
  FROM (SELECT rid, placed.lang, placed.idx, unnest(range(height)) AS lvl
        FROM placed JOIN tops ON tops.lang IS NOT DISTINCT FROM placed.lang) p
  LEFT JOIN nodes n
    ON n.lang IS NOT DISTINCT FROM p.lang AND n.lvl = p.lvl AND n.idx = xor(p.idx >> p.lvl, 1)
  UNION ALL
  SELECT rid, 1000 + u.lvl, (u.idx >> u.lvl) % 2 = 1, c.digest
  FROM (SELECT lang, idx, unnest(range((SELECT max(lvl) FROM crown))) AS lvl FROM tops) u
  JOIN placed ON placed.lang IS NOT DISTINCT FROM u.lang
  LEFT JOIN crown c ON c.lvl = u.lvl AND c.idx = xor(u.idx >> u.lvl, 1)
),
proofs AS (
  SELECT rid, list(CASE WHEN digest IS NULL THEN '-' WHEN on_left THEN 'L' || digest ELSE 'R' || digest END ORDER BY step)
           AS steps,
         coalesce(string_agg(digest, '' ORDER BY step), '') AS beside
  FROM ways GROUP BY rid
),
folded AS (
  SELECT doc_id, leaf, subroot, (SELECT digest FROM crown WHERE size = 1) AS root,
         sha256(coalesce(beside, '')) AS proof_sha256,
         list_reduce(list_prepend(changed, coalesce(steps, [])),
                     lambda node, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || node WHEN 'R' THEN node || s[2:] ELSE node END))
           AS folded_root
  FROM placed JOIN tops ON tops.lang IS NOT DISTINCT FROM placed.lang LEFT JOIN proofs USING (rid)
)
SELECT *, folded_root = root AS verified FROM folded
"""


def _encoded(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR) || ':' || ({value})::VARCHAR, '-')"


def _merkle() -> str:
    head = " || ".join(_encoded(c) for c in ("doc_id", "source", "lang"))
    parts = {"head": head, "n": _encoded("n_chars"), "n_more": _encoded("n_chars::HUGEINT + 1"), "tail": _encoded("text")}
    out = _MERKLE
    for name, sql in parts.items():
        out = out.replace("{" + name + "}", sql)
    return out


# --- 13: every query against every vector ---

_SEARCH = (
    "WITH"
    + _KEPT.format(also="")
    + """
SELECT q.vec_id AS query_id,
       (row_number() OVER (PARTITION BY q.rid ORDER BY score DESC, c.vec_id NULLS LAST, c.rid))::INT AS rank,
       c.vec_id, score
FROM kept q JOIN kept c ON c.rid <> q.rid,
     LATERAL (SELECT coalesce(list_sum(list_transform(range(1, least(len(q.x), len(c.x)) + 1),
                                                      lambda i: q.x[i] * c.x[i])), 0)::BIGINT AS score) s
WHERE q.vec_id % 100 = 0
QUALIFY rank <= 10
"""
)

ORACLE: dict[str, str] = {
    "op4_warc": _WARC,
    "op9_quality": _QUALITY,
    "op10_chat": _CHAT,
    "op11_centroid_clustering": _clustering(),
    "op12_merkle_manifest": _merkle(),
    "op13_exact_topk": _SEARCH,
}

"""SQL for the queries of this subpackage that SQL can express. Constants are stated here again, not imported."""

from __future__ import annotations

OP2 = r"""
WITH parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    coalesce(regexp_extract(url, '^.*?://[^?#]*\?([^#]*)', 1, 's'), '') AS query
  FROM pages
), named AS (
  SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref)=')), '&') AS kept FROM parts
), canon AS (
  SELECT page_id, host, path,
    CASE WHEN regexp_replace(host, '^(www|m)\.', '') <> '' THEN
      regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical
  FROM named
), listing AS (
  SELECT DISTINCT canonical FROM canon WHERE canonical IS NOT NULL AND regexp_matches(host, '(^|[.-])(spam|cheap|pills|casino|farm)[.-]')
), ruled AS (
  SELECT *, canonical IS NOT NULL AND canonical IN (SELECT canonical FROM listing) AS listed,
    CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM canon
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
  canonical, listed
FROM ruled
"""


OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n_shingles + nb.n_shingles - c)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT n.doc_id, n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n_shingles
"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bit = "lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END::UBIGINT)"
    byte = f"lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), {bit})"
    points = f"list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: ord(c)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {points}), {byte}), 4294967295::UBIGINT)"


def grown(nodes: str, prefix: str, levels: int) -> str:
    """Tables of a tree over nodes(g, i, d): {prefix}k_l has the runs of level l, {prefix}r the root of each group. Enough for 8^levels nodes a group."""
    out, at = [], nodes
    for level in range(levels):
        out.append(f"{prefix}k{level} AS (SELECT g, i // 8 AS run, list(d ORDER BY i) AS ds, sum(count(*)) OVER (PARTITION BY g) AS n FROM {at} GROUP BY g, i // 8)")
        out.append(f"{prefix}n{level} AS (SELECT g, run AS i, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM {prefix}k{level})")
        at = f"{prefix}n{level}"
    return ", ".join([*out, f"{prefix}r AS (SELECT g, d FROM {at})"])


def climbed(start: str, prefix: str, levels: int, name: str) -> str:
    """From start(.., g, i, cur, proof) step by step up: the table `name` with the last cur and proof."""
    out, at = [], start
    for level in range(levels):
        left = f"array_to_string(k.ds[1:(s.i // {8**level}) % 8], '')"
        right = f"array_to_string(k.ds[(s.i // {8**level}) % 8 + 2:], '')"
        own = name if level == levels - 1 else f"{name}{level}"
        out.append(
            f"{own} AS (SELECT s.* REPLACE (CASE WHEN k.n > 1 THEN sha256({left} || s.cur || {right}) ELSE s.cur END AS cur, "
            f"s.proof || CASE WHEN k.n > 1 THEN {left} || {right} ELSE '' END AS proof) "
            f"FROM {at} s JOIN {prefix}k{level} k ON k.g = s.g AND k.run = s.i // {8 ** (level + 1)})"
        )
        at = own
    return ", ".join(out)


def op11(levels: int = 7, top: int = 3) -> str:
    def leaf(text: str) -> str:
        given = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
        return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in given) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS leaf,
    CASE WHEN {crc32("coalesce(doc_id::VARCHAR, '')")} % 3 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS tampered
  FROM documents
), placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
nodes AS (SELECT g, i, leaf AS d FROM placed), {grown('nodes', 'a', levels)},
subroots AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, g AS own FROM ar), {grown('subroots', 'b', top)},
start AS (SELECT doc_id, leaf, g, i, tampered AS cur, '' AS proof FROM placed), {climbed('start', 'a', levels, 'lower')},
between AS (SELECT l.doc_id, l.leaf, s.d AS subroot, '' AS g, s.i, l.cur, l.proof FROM lower l JOIN subroots s ON s.own = l.g), {climbed('between', 'b', top, 'higher')}
SELECT doc_id, leaf, subroot, br.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = br.d AS verified FROM higher, br
"""


def op12() -> str:
    """Forward over the turns, with the cheapest (cost, edits, turns) so far for each state, ties by the least edits."""
    def more(x: str, cost: str, edit: str, role: str | None, text: str = "''") -> str:
        turn = "''" if role is None else f"chr(10) || {role} || ':' || {text}"
        return f"{{'c': {x}.c + {cost}, 'e': {x}.e || '{edit}', 't': {x}.t || {turn}}}"

    def least(*ways: str) -> str:
        return f"list_sort([{', '.join(ways)}])[1]"

    def inserted(source: str, name: str) -> str:
        user, assistant = (lambda x: more(x, "3", "I", "'user'")), (lambda x: more(x, "3", "I", "'assistant'"))
        return (f"(SELECT * REPLACE ({least('u', user('z'), user('s'), user('a'))} AS u, {least('a', assistant('u'))} AS a) FROM "
                f"(SELECT * REPLACE ({least('u', user('z'), user('s'), user('a'))} AS u, {least('a', assistant('u'))} AS a) FROM {source})) {name}")

    never = "{'c': 1000000000::BIGINT, 'e': '', 't': ''}"
    turn = lambda x, role: [
        f"CASE WHEN lost OR left(role, 1) <> '{role[0]}' THEN {never} ELSE {more(x, 'extra', 'K', 'role', 'txt')} END",
        *([] if role == "system" else [f"CASE WHEN lost THEN {never} ELSE {more(x, '3 + extra', 'R', f"'{role}'", 'txt')} END"]),
    ]
    spaces = r"[\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
    {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt) AS i FROM damaged
), checked AS (
  SELECT *, regexp_replace(txt, '{spaces}+$', '') AS bare, row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) > 1 AS seen,
    lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM checked
), rows_ AS (
  SELECT *, coalesce(fault, '') IN ('blank', 'duplicate') AS lost, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM faulty
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM rows_ GROUP BY conv_id
), dp AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'e': '', 't': ''}} AS z, {never} AS s, {never} AS u, {never} AS a FROM counts
  UNION ALL
  SELECT conv_id, i, {more('z', '4', 'D', None)}, {least(more('s', '4', 'D', None), *turn('z', 'system'))},
    {least(more('u', '4', 'D', None), *turn('z', 'user'), *turn('s', 'user'), *turn('a', 'user'))},
    {least(more('a', '4', 'D', None), *turn('u', 'assistant'))}
  FROM {inserted("(SELECT dp.z, dp.s, dp.u, dp.a, r.* FROM dp JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1)", 'x')}
), ended AS (SELECT conv_id, i, {least('z', 'a')} AS best FROM {inserted('dp', 'x')}),
given AS (SELECT DISTINCT conv_id FROM conversations)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM given g LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM g.conv_id AND e.i = c.n
"""


def build() -> dict[str, str]:
    return {"op1_minhash_dedup": OP1, "op2_url_filter": OP2, "op11_merkle_manifest": op11(), "op12_conversation_repair": op12()}

"""DuckDB SQL of the conversation and URL operators: the prefix trie by prefix strings, the URL models level by
level, the repair by a recursion that carries each state's best cost, edits and text."""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ord(substr({text}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {step}), 4294967295)"


CONVERSATION_TRIE = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS at
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, count(*) AS n, {crc32('CAST(conv_id AS VARCHAR)')} % 4 AS h, conv_id - conv_id % 20 AS base FROM own GROUP BY conv_id),
turns AS (
  SELECT c.conv_id, b.at AS d, b.role, b.text FROM convs c JOIN own b ON b.conv_id = c.base AND b.at <= c.h
  UNION ALL
  SELECT c.conv_id, o.at - c.h + least(c.h, coalesce(b.n, 0)), o.role, o.text
  FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.at > c.h LEFT JOIN convs b ON b.conv_id = c.base),
lists AS (
  SELECT c.conv_id, string_agg(md5(length(role) || ':' || role || text), '' ORDER BY d) AS names,
         list(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) ORDER BY d) AS words, count(d) AS n
  FROM convs c LEFT JOIN turns USING (conv_id) GROUP BY c.conv_id),
places AS (
  SELECT conv_id, d, left(coalesce(names, ''), 32 * d) AS name, words[d] AS words, d = n AS last
  FROM lists, unnest(range(0, n + 1)) AS r(d)),
nodes AS (
  SELECT name, d, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE any_value(words) END AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM places GROUP BY name, d),
kinds AS (SELECT a.*, (SELECT count(*) FROM nodes b WHERE b.d = a.d + 1 AND left(b.name, 32 * a.d) = a.name) AS n_children FROM nodes a)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, a.ends_sha256,
       CAST(count(*) FILTER (WHERE b.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens
FROM kinds a JOIN kinds b ON b.d >= a.d AND left(b.name, 32 * a.d) = a.name
LEFT JOIN kinds p ON p.d = a.d - 1 AND p.name = left(a.name, 32 * (a.d - 1))
GROUP BY ALL
"""

# The repair's states, as in the module: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a. A state's value is
# {cost, edits, repaired text}, compared in that order.
_NEVER = "{'c': 1000000000, 'a': '~', 'o': ''}"


def _value(cost: str, edits: str, text: str) -> str:
    return f"{{'c': CAST({cost} AS BIGINT), 'a': {edits}, 'o': {text}}}"


def _best(*values: str) -> str:
    return f"list_sort([{', '.join(values)}])[1]"


def _delete(v: str) -> str:
    return _value(f"{v}.c + 2", f"'D' || {v}.a", f"{v}.o")


def _stay(v: str, letter: str, cost: int, role: str, test: str) -> str:
    return f"CASE WHEN {test} THEN {_value(f'{v}.c + {cost} + 5 * cut', f'{letter!r} || {v}.a', f'{role} || chr(58) || text || chr(10) || {v}.o')} ELSE {_NEVER} END"


def _row(state: int) -> str:
    """The best edit of a row in a state, from the values v0 .. v3 behind it."""
    role, initial, then = ("'assistant'", "a", "v3") if state == 2 else ("'user'", "u", "v2")
    values = [_delete(f"v{state}"), _stay(then, "K", 0, "role", f"stays AND initial = '{initial}'"), _stay(then, "R", 1, role, "stays")]
    if state == 0:
        values.append(_stay("v1", "K", 0, "role", "stays AND initial = 's'"))
    return _best(*values)


def _insert(v: str, role: str) -> str:
    return _value(f"{v}.c + 5", f"'I' || {v}.a", f"'{role}:' || chr(10) || {v}.o")


_AFTER_USER = _best("b2", _insert("b3", "assistant"))
_WITH_INSERTS = [_best(f"b{s}", _insert(f"({_AFTER_USER})", "user")) if s != 2 else _AFTER_USER for s in range(4)]

CONVERSATION_REPAIR = f"""
WITH RECURSIVE harmed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS harm
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
         CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM harmed, unnest(range(0, CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copies(k) WHERE harm <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM damaged),
faults AS (
  SELECT *, left(role, 1) AS initial, coalesce(left(lag(role) OVER (PARTITION BY conv_id ORDER BY place), 1) || left(role, 1) NOT IN ('su', 'ua', 'au'), FALSE) AS illegal,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault
  FROM placed),
edits AS (SELECT *, coalesce(fault NOT IN ('blank', 'duplicate'), TRUE) AS stays, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM faults),
said AS (
  SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM edits GROUP BY conv_id),
dp AS (
  SELECT conv_id, n AS k, {_value('0', "''", "''")} AS v0, {_value('10', "'II'", "'user:' || chr(10) || 'assistant:' || chr(10)")} AS v1,
         {_value('5', "'I'", "'assistant:' || chr(10)")} AS v2, {_value('0', "''", "''")} AS v3 FROM said
  UNION ALL
  SELECT conv_id, k - 1, {', '.join(_WITH_INSERTS)}
  FROM (SELECT dp.conv_id, dp.k, {', '.join(f'{_row(s)} AS b{s}' for s in range(4))}
        FROM dp JOIN edits e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.place = dp.k)),
ended AS (SELECT conv_id, v0 AS v FROM dp WHERE k = 0)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(v.c, 0) AS cost, coalesce(v.a, '') AS audit,
       sha256(left(coalesce(v.o, ''), greatest(length(coalesce(v.o, '')) - 1, 0))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def _level(k: int) -> str:
    """Smoothed probabilities of the grams' ends of k + 1 characters, from those of k."""
    low = {n: "1.0::DOUBLE / (SELECT count(DISTINCT right(gram, 1)) FROM counts)" if k == 0 else f"l.{n}" for n in "ab"}
    smooth = ", ".join(f"CASE WHEN all_{n} > 0 THEN ({n}_ + kinds_{n} * ({low[n]})) / (all_{n} + kinds_{n}) ELSE {low[n]} END AS {n}" for n in "ab")
    sums = ", ".join(f"CAST(sum({n}_) OVER w AS BIGINT) AS all_{n}, count(*) FILTER ({n}_ > 0) OVER w AS kinds_{n}" for n in "ab")
    join = "" if k == 0 else f"JOIN p{k - 1} l ON l.s = right(h.s, {k})"
    return f"""p{k} AS (
  SELECT h.s, {smooth}
  FROM (SELECT s, a_, b_, {sums}
        FROM (SELECT right(gram, {k + 1}) AS s, CAST(sum(a) AS BIGINT) AS a_, CAST(sum(b) AS BIGINT) AS b_ FROM counts GROUP BY 1)
        WINDOW w AS (PARTITION BY left(s, {k}))) h {join})"""


_RULES = [("www.example.com", "/en/", "allow"), ("example.com", "/en/", "block"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("com", "/", "allow")]
_FITS = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for h, p, _ in _RULES]

URL_FILTERS = f"""
WITH split AS (
  SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url,
         translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
urls AS (
  SELECT r, page_id, url, coalesce(host, '') AS host, coalesce(path, '') AS path,
         CASE {' '.join(f + f"'{h}{p}'" for f, (h, p, _) in zip(_FITS, _RULES, strict=True))} END AS rule,
         CASE {' '.join(f + f"'{v}'" for f, (_, _, v) in zip(_FITS, _RULES, strict=True))} END AS label,
         left(md5(url), 1) IN ('0', '1', '2') AS held
  FROM split),
grams AS (SELECT r, label, held, substr(repeat(chr(2), 4) || url || chr(3), i, 5) AS gram FROM urls, unnest(range(1, length(url) + 2)) AS n(i)),
counts AS (
  SELECT gram, count(*) FILTER (label = 'allow' AND NOT held) AS a, count(*) FILTER (label = 'block' AND NOT held) AS b FROM grams GROUP BY gram),
{', '.join(_level(k) for k in range(5))},
scores AS (
  SELECT r, CAST(floor(CAST(sum(CAST(round((ln(a) - ln(b)) * 1000000) AS BIGINT)) AS DOUBLE) / count(*)) AS BIGINT) AS score
  FROM grams JOIN p4 ON p4.s = gram GROUP BY r),
bins AS (
  SELECT CAST(floor(score / 10000.0) AS BIGINT) AS bin, count(*) FILTER (label = 'allow') AS a, count(*) FILTER (label = 'block') AS b
  FROM scores JOIN urls USING (r) WHERE held AND label IS NOT NULL GROUP BY 1),
gains AS (
  SELECT bin, lead(bin) OVER up AS lower_bin,
         CAST(sum(a) OVER up AS DOUBLE) / nullif(sum(a) OVER (), 0) - CAST(sum(b) OVER up AS DOUBLE) / nullif(sum(b) OVER (), 0) AS gain
  FROM bins WINDOW up AS (ORDER BY bin DESC)),
best AS (SELECT bin, lower_bin FROM gains WHERE gain IS NOT NULL ORDER BY gain DESC, abs(bin), bin LIMIT 1),
cut AS (SELECT coalesce((SELECT CAST(floor((bin + coalesce(lower_bin + 1, bin)) * 10000 / 2.0) AS BIGINT) FROM best), 0) AS least)
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN score >= (SELECT least FROM cut) THEN 'allow' ELSE 'block' END) AS verdict,
       score / 1000000.0 AS score
FROM urls JOIN scores USING (r)
"""

"""SQL forms of the duplicate operators, for tables small enough for it."""

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

#: The least id reachable over links, from a table of links between different documents in both directions.
REACH = """
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(least(a, b)) AS component_id FROM reach GROUP BY a)"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
firsts AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (g) WHERE first_id < doc_id),
pos AS (SELECT doc_id, ws[p] AS word, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY pos.doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),{REACH}
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = w.doc_id
"""

VECTORS = f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.95),{REACH},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept FROM e LEFT JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def _crc32(key: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    eight = "list_reduce(list_concat([xor(a, b)], CAST(range(8) AS BIGINT[])), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({key}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: {eight}), 4294967295)"


def _edit(state: int, cost: str, letter: str, line: str | None = None) -> str:
    """A state's best repair so far with one edit more; states count from 0: nothing yet, system, user, assistant."""
    s = f"s[{state + 1}]"
    return f"struct_pack(c := {s}.c + {cost}, a := {s}.a || '{letter}', t := {f'list_append({s}.t, {line})' if line else f'{s}.t'})"


def _least(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda o: o.c < 1000000))[1]"


_NONE = "struct_pack(c := 1000000::BIGINT, a := '', t := CAST([] AS VARCHAR[]))"


def _kept(initial: str, *states: int) -> list[str]:
    allowed = f"CASE WHEN fault IN (1, 2) OR initial <> '{initial}' THEN 1000000 WHEN fault = 3 THEN 3 ELSE 0 END"
    return [_edit(q, allowed, "K", "role || ':' || text") for q in states]


def _other(role: str, *states: int) -> list[str]:
    allowed = "CASE WHEN fault IN (1, 2) THEN 1000000 WHEN fault = 3 THEN 6 ELSE 3 END"
    return [_edit(q, allowed, "R", f"'{role}:' || text") for q in states]


def _inserted(rows: str) -> str:
    """States after inserts of empty turns at the same place."""
    user = _least("s[3]", *(_edit(q, "3", "I", "'user:'") for q in (0, 1, 3)))
    assistant = _least("s[4]", _edit(2, "3", "I", "'assistant:'"))
    filled = f"coalesce({{}}, {_NONE})".format
    return f"SELECT conv_id, i, [s[1], s[2], s[3], {filled(assistant)}] AS s FROM (SELECT conv_id, i, [s[1], s[2], {filled(user)}, s[4]] AS s FROM ({rows}))"


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_STEP = ", ".join(
    f"coalesce({_least(*x)}, {_NONE})"
    for x in (
        [_edit(0, "4", "D")],
        [_edit(1, "4", "D"), *_kept("s", 0)],
        [_edit(2, "4", "D"), *_kept("u", 0, 1, 3), *_other("user", 0, 1, 3)],
        [_edit(3, "4", "D"), *_kept("a", 2), *_other("assistant", 2)],
    )
)

#: Conversations repaired row by row: the best repair that ends in each state, by cost and then by letters.
REPAIRS = f"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE k <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial, rtrim(text, {_WHITE}) AS body FROM d),
f AS (SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
w AS ({_inserted(f"SELECT conv_id, 0::BIGINT AS i, [struct_pack(c := 0::BIGINT, a := '', t := CAST([] AS VARCHAR[])), {_NONE}, {_NONE}, {_NONE}] AS s FROM g")}
UNION ALL {_inserted(f"SELECT w.conv_id, w.i + 1 AS i, [{_STEP}] AS s FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1")}),
e AS (SELECT g.*, list_sort([s[1], s[4]])[1] AS b FROM g JOIN w ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND w.i = g.n)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id"""

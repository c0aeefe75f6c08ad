"""SQL beside the repair of conversations: the cheapest edits, row by row, for every state."""

_NEVER = "{'c': 1000000000, 'a': '', 'o': ''}"


def _edit(state: str, cost: str, edit: str, line: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 'o': {state}.o || {line}}}"


def _least(*choices: str) -> str:
    return f"list_sort([{', '.join(choices)}])[1]"


def _when(condition: str, choice: str) -> str:
    return f"CASE WHEN {condition} THEN {choice} ELSE {_NEVER} END"


_INSERTED = f"""
    SELECT conv_id, i, s0, s1, s2, {_least("s3", _edit("s2", "5", "I", "'assistant:' || chr(10)"))} AS s3
    FROM (SELECT conv_id, i, s0, s1, s3, {_least(
        "s2", *[_edit(s, "5", "I", "'user:' || chr(10)") for s in ("s0", "s1", "s3")])} AS s2
          FROM SOURCE)"""

_KEPT = "role || ':' || text || chr(10)"
_STAYS = "fault NOT IN (1, 2)"
_EXTRA = "CASE WHEN fault = 3 THEN 5 ELSE 0 END"


def _kept(state: str, initial: str) -> str:
    return _when(f"{_STAYS} AND initial = '{initial}'", _edit(state, _EXTRA, "K", _KEPT))


def _named(state: str, role: str) -> str:
    line = f"'{role}:' || text || chr(10)"
    return _when(_STAYS, _edit(state, f"1 + {_EXTRA}", "R", line))


_STEP = f"""
    SELECT d.conv_id, d.i + 1 AS i,
        {_edit("s0", "2", "D", "''")} AS s0,
        {_least(_edit("s1", "2", "D", "''"), _kept("s0", "s"))} AS s1,
        {_least(_edit("s2", "2", "D", "''"), *[_kept(s, "u") for s in ("s0", "s1", "s3")],
                *[_named(s, "user") for s in ("s0", "s1", "s3")])} AS s2,
        {_least(_edit("s3", "2", "D", "''"), _kept("s2", "a"), _named("s2", "assistant"))} AS s3
    FROM ({_INSERTED.replace("SOURCE", "steps")}) d JOIN messages r ON r.conv_id = d.conv_id AND r.i = d.i + 1"""

OP11_SQL = f"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           conv_id::VARCHAR || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
coded AS (
    SELECT conv_id, turn, role, text, xor(list_reduce(
        list_concat([4294967295::BIGINT],
                    list_transform(range(1, len(name) + 1), lambda i: ord(substr(name, i, 1))::BIGINT)),
        lambda crc, b: list_reduce(
            list_concat([xor(crc, b)], list_transform(range(8), lambda j: 0::BIGINT)),
            lambda c, j: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) % 20 AS code
    FROM keyed),
hurt AS (
    SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
           CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
    FROM coded WHERE code <> 0),
ordered AS (
    SELECT conv_id, turn, role, text, left(role, 1) AS initial,
           rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
    FROM hurt),
messages AS (
    SELECT *, CASE WHEN core = '' THEN 1 WHEN nth > 1 THEN 2
                   WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
    FROM ordered),
steps AS (
    SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'o': ''}} AS s0,
           {_NEVER} AS s1, {_NEVER} AS s2, {_NEVER} AS s3
    FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL ({_STEP})),
last AS (SELECT * FROM steps QUALIFY i = max(i) OVER (PARTITION BY conv_id)),
best AS (
    SELECT conv_id, {_least("s0", "s3")} AS s FROM ({_INSERTED.replace("SOURCE", "last")})),
faults AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
           count(*) FILTER (fault = 3) AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM messages GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
       coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(s.c AS BIGINT) AS cost, s.a AS audit,
       sha256(left(s.o, greatest(length(s.o) - 1, 0))) AS repaired_sha256
FROM best LEFT JOIN faults USING (conv_id)
"""

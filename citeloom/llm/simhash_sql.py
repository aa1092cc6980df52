"""SQL for fingerprints and their groups: XXH64 on 128-bit integers, votes, and the closure of links."""

from __future__ import annotations

#: Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_WORD = 1 << 64


def _big(x: int | str) -> str:
    return f"CAST('{x % _WORD}' AS UHUGEINT)" if isinstance(x, int) else x


_ONES = _big(_WORD - 1)


def _times(a: int | str, b: int | str) -> str:
    return f"(({_big(a)} * {_big(b)}) & {_ONES})"


def _plus(a: int | str, b: int | str) -> str:
    return f"(({_big(a)} + {_big(b)}) & {_ONES})"


def _turned(x: str, k: int) -> str:
    return f"((({x} << {k}) | ({x} >> {64 - k})) & {_ONES})"


def _read(at: str, n: int) -> str:
    """n bytes, the lowest first, from the hexadecimal column x; at: where, in digits."""
    digits = " || ".join(f"substr(x, CAST({at} + {2 * (n - 1 - i) + 1} AS BIGINT), 2)" for i in range(n))
    return f"CAST(CAST('0x' || {digits} AS UBIGINT) AS UHUGEINT)"


def _round(acc: str, lane: str) -> str:
    return _times(_turned(_plus(acc, _times(lane, _P2)), 31), _P1)


def _state(j: int, start: int) -> str:
    """One of the four states after all stripes of 32 bytes."""
    lanes = f"list_transform(range(n // 32), lambda s: {_read(f'64 * s + {16 * j}', 8)})"
    return f"list_reduce([{_big(start)}] || {lanes}, lambda a, k: {_round('a', 'k')})"


def hashed(seed: int = 42) -> str:
    """CTEs from d (s: distinct texts) to hashed (s, h: unsigned)."""
    states = ", ".join(_state(j, x) for j, x in enumerate([seed + _P1 + _P2, seed + _P2, seed, seed - _P1]))
    mixed = _plus(_plus(_turned("v[1]", 1), _turned("v[2]", 7)), _plus(_turned("v[3]", 12), _turned("v[4]", 18)))
    merged = "".join(f", m{k} AS (SELECT s, x, n, v, CASE WHEN n < 32 THEN h ELSE {_plus(_times(f'xor(h, {_round(_big(0), f"v[{k}]")})', _P1), _P4)} END AS h FROM m{k - 1})" for k in range(1, 5))
    eight = _plus(_times(_turned(f"xor(h, {_round(_big(0), 'k')})", 27), _P1), _P4)
    four = _plus(_times(_turned(f"xor(h, {_times(_read('16 * (n // 8)', 4), _P1)})", 23), _P2), _P3)
    one = _times(_turned(f"xor(h, {_times('k', _P5)})", 11), _P1)
    return f"""x AS (SELECT s, hex(encode(s)) AS x, strlen(s) AS n FROM d), stripes AS (SELECT *, CASE WHEN n >= 32 THEN [{states}] END AS v FROM x),
m0 AS (SELECT *, CASE WHEN n < 32 THEN {_big(seed + _P5)} ELSE {mixed} END AS h FROM stripes){merged},
eights AS (SELECT s, x, n, list_reduce([{_plus('h', 'CAST(n AS UHUGEINT)')}] || list_transform(range((n % 32) // 8), lambda k: {_read('64 * (n // 32) + 16 * k', 8)}), lambda h, k: {eight}) AS h FROM m4),
fours AS (SELECT s, x, n, CASE WHEN n % 8 < 4 THEN h ELSE {four} END AS h FROM eights),
ones AS (SELECT s, list_reduce([h] || list_transform(range(n % 4), lambda k: {_read('8 * (n // 4) + 2 * k', 1)}), lambda h, k: {one}) AS h FROM fours),
spread AS (SELECT s, {_times('xor(h, h >> 33)', _P2)} AS h FROM ones), wide AS (SELECT s, {_times('xor(h, h >> 29)', _P3)} AS h FROM spread), hashed AS (SELECT s, CAST(xor(h, h >> 32) AS UBIGINT) AS h FROM wide)"""


def groups(radius: int = 2) -> str:
    """doc_id, fingerprint, component_id of ``documents`` by shingles of three words."""
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
d AS (SELECT DISTINCT s FROM shingles), {hashed()},
votes AS (SELECT doc_id, k, sum((h >> k) & 1) AS votes, count(*) AS n FROM shingles JOIN hashed USING (s), (SELECT unnest(range(64)) AS k) GROUP BY 1, 2),
prints AS (SELECT doc_id, CAST(sum(CASE WHEN 2 * votes > n THEN CAST(1 AS HUGEINT) << CAST(k AS INTEGER) ELSE CAST(0 AS HUGEINT) END) AS UBIGINT) AS p FROM votes GROUP BY 1),
every AS (SELECT doc_id, coalesce(p, CAST(0 AS UBIGINT)) AS p FROM documents LEFT JOIN prints USING (doc_id)), nodes AS (SELECT p, min(doc_id) AS least FROM every GROUP BY 1),
links AS (SELECT a.p AS a, b.p AS b FROM nodes a JOIN nodes b ON a.p <> b.p AND bit_count(xor(a.p, b.p)) <= {radius}), reach AS (SELECT p, p AS near FROM nodes UNION SELECT r.p, l.b FROM reach r JOIN links l ON l.a = r.near),
roots AS (SELECT r.p, min(n.least) AS root FROM reach r JOIN nodes n ON n.p = r.near GROUP BY 1)
SELECT doc_id, lpad(lower(hex(p)), 16, '0') AS fingerprint, root AS component_id FROM every JOIN roots USING (p)"""

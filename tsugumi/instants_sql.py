"""Written times as instants in SQL, for the comparison of ``functions.instants`` with another engine and its zone rules."""

from __future__ import annotations

from tsugumi.functions import instants as I

_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _forms() -> list[tuple[str, str]]:
    """The forms without back references: one for each separator."""
    out = []
    for pattern, to in I._FORMS:
        for mark in ("([-/])", "([./-])"):
            if mark in pattern:
                out += [(pattern.replace(mark, f"([{c}])").replace(r"\2", f"[{c}]"), to) for c in mark[2:-2]]
                break
        else:
            out.append((pattern, to))
    return [(p, to.replace("$", "\\")) for p, to in out]


def _cases(column: str, values: dict, other: str = "") -> str:
    return f"CASE {column} {' '.join(f'WHEN {k!r} THEN {v}' for k, v in values.items())} {other} END"


def _local(us: str) -> str:
    return f"epoch_us(timezone(zn, timezone('UTC', make_timestamp({us}))))"


def instants(rows: str, keys: str) -> str:
    """CTEs up to ``instants`` (the keys, utc_us, null where a value is no instant, and rough, a best guess where a clock change skips or repeats it) of the rows (keys, value, zone) of a query."""
    line = " ".join(f"WHEN regexp_matches(t, '{p}') THEN regexp_replace(t, '{p}', '{r}')" for p, r in _forms())
    number = "regexp_replace(f[1], '^(令和|平成|昭和|[RHS])', '')"
    months = {m: i for i, m in enumerate(I.MONTHS, 1)}
    part = lambda i, least=0: f"CASE WHEN coalesce(f[{i}], '') = '' THEN {least} ELSE try_cast(f[{i}] AS INTEGER) END"
    return f"""it AS (SELECT {keys}, zone, translate(regexp_replace(value, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '０１２３４５６７８９−／：．（）　', '0123456789-/:.() ') AS t FROM ({rows})),
iw AS (SELECT *, regexp_matches(t, '{I._WEEK}') AS week, string_split(CASE {line} END, '|') AS f, try_cast(nullif(regexp_extract(t, '{I._WEEK}', 1), '') AS INTEGER) AS wy, try_cast(nullif(regexp_extract(t, '{I._WEEK}', 2), '') AS INTEGER) AS wn, try_cast(nullif(regexp_extract(t, '{I._WEEK}', 3), '') AS INTEGER) AS wd FROM it),
iy AS (SELECT *, (CASE WHEN {number} = '元' THEN 1 ELSE try_cast({number} AS INTEGER) END) + coalesce({_cases("regexp_extract(f[1], '^(\\D*)(\\d+|元)$', 1)", I.ERAS)}, 0) AS y,
  coalesce(try_cast(f[2] AS INTEGER), {_cases("lower(substr(f[2], 1, 3))", months)}) AS m, try_cast(f[3] AS INTEGER) AS d, {part(4)} AS h0, {part(5)} AS mi, {part(6)} AS sc, lower(f[9]) AS half,
  CASE WHEN coalesce(f[7], '') = '' THEN 0 ELSE try_cast(rpad(substr(f[7], 1, 6), 6, '0') AS INTEGER) END AS us, try_cast(lpad(wy::VARCHAR, 4, '0') || '-01-04' AS DATE) AS fourth FROM iw),
id AS (SELECT *, CASE WHEN half IN ('午前', '午後', 'am', 'pm') THEN CASE WHEN h0 <= 12 THEN h0 % 12 + CASE WHEN half IN ('午後', 'pm') THEN 12 ELSE 0 END END ELSE h0 END AS h, fourth - (isodow(fourth)::INTEGER - 1) + (wn - 1) * 7 AS monday,
  CASE WHEN y BETWEEN 1 AND 9999 THEN try_cast(printf('%04d-%02d-%02d', y, m, d) AS DATE) END AS plain FROM iy),
il AS (SELECT *, CASE WHEN week THEN CASE WHEN wn BETWEEN 1 AND 53 AND wd BETWEEN 1 AND 7 AND year(monday + 3) = wy THEN monday + (wd - 1) END ELSE plain END AS dt,
  CASE WHEN h BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND sc BETWEEN 0 AND 59 THEN (h::BIGINT * 3600 + mi * 60 + sc) * 1000000 + us END AS clock, CASE WHEN week THEN '' ELSE regexp_replace(f[8], '^(.+?)\\[.*\\]$', '\\1') END AS z FROM id),
iz AS (SELECT *, dt IS NOT NULL AND (week OR f[4] = '') AS is_day, epoch_us(dt::TIMESTAMP) + CASE WHEN week THEN 0 ELSE clock END AS l, z = '' OR starts_with(z, '[') AS zoned,
  CASE WHEN starts_with(z, '[') THEN regexp_replace(z, '[\\[\\]]', '', 'g') WHEN coalesce(trim(zone), '') <> '' THEN trim(zone) ELSE 'UTC' END AS declared, try_cast(rpad(regexp_replace(z, '\\D', '', 'g'), 4, '0') AS INTEGER) AS digits FROM il),
io AS (SELECT iz.*, CASE WHEN regexp_matches(z, '^[+-]\\d{{2}}(:?\\d{{2}})?$') THEN CASE WHEN digits <= 1800 AND digits % 100 < 60 THEN (digits // 100 * 60 + digits % 100) * CASE WHEN starts_with(z, '-') THEN -1 ELSE 1 END END ELSE {_cases("upper(z)", I.ABBREVIATIONS)} END AS minutes, n.name AS zn
  FROM iz LEFT JOIN (SELECT DISTINCT name FROM pg_timezone_names()) n ON n.name = declared),
ia AS (SELECT *, CASE WHEN zoned THEN l - ({_local('l - 86400000000')} - (l - 86400000000)) END AS a, CASE WHEN zoned THEN l - ({_local('l + 86400000000')} - (l + 86400000000)) END AS b,
  try_cast(nullif(regexp_extract(t, '{I._NUMBER}', 1), '') AS BIGINT) AS whole, regexp_extract(t, '{I._NUMBER}', 2) AS tail FROM io),
ih AS (SELECT *, {_local('a')} = l AS hit_a, {_local('b')} = l AS hit_b, CASE WHEN whole < 100000000000 THEN 6 WHEN whole < 100000000000000 THEN 3 ELSE 0 END AS scale FROM ia),
ii AS (SELECT {keys}, a, b, CASE WHEN regexp_matches(t, '{I._NUMBER}') THEN CASE WHEN whole < 100000000000000000 THEN whole * CASE scale WHEN 6 THEN 1000000 WHEN 3 THEN 1000 ELSE 1 END + coalesce(try_cast(nullif(substr(rpad(tail, 6, '0'), 1, scale), '') AS BIGINT), 0) END
  WHEN zoned THEN CASE WHEN a = b THEN CASE WHEN hit_a THEN a END WHEN hit_a AND hit_b THEN CASE WHEN is_day THEN least(a, b) END WHEN hit_a THEN a WHEN hit_b THEN b WHEN is_day THEN a END
  ELSE l - minutes::BIGINT * 60000000 END AS utc_us FROM ih),
instants AS (SELECT {keys}, utc_us, coalesce(utc_us, least(a, b)) AS rough FROM ii)"""

"""Pieces of DuckDB SQL shared by the checks."""


def sql_date(col: str) -> str:
    """DATE of a text in the writings that :func:`panelforge.functions.dates.parse_date` reads."""
    s = f"trim(regexp_replace({col}, '\\s+', ' ', 'g'))"
    day = f"regexp_replace({s}, '^(\\d{{4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,2}}|\\d{{8}})[T ].*$', '\\1')"
    formats = ["%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%d-%b-%Y", "%d %b %Y", "%d %B %Y", "%B %d, %Y", "%b %d, %Y", "%m/%d/%Y"]
    tries = ", ".join(f"try_strptime({day}, '{f}')" for f in formats)
    return f"CAST(coalesce(CASE WHEN regexp_full_match({day}, '\\d{{8}}') THEN try_strptime({day}, '%Y%m%d') END, {tries}) AS DATE)"


def sql_filled(col: str) -> str:
    return f"({col} IS NOT NULL AND upper(trim({col})) NOT IN ('', 'N/A', '-', '0', 'UNKNOWN', '0000-00-00'))"


def sql_day(d: str) -> str:
    return f"CAST(year({d}) * 10000 + month({d}) * 100 + day({d}) AS INTEGER)"


def sql_q(d: str) -> str:
    return f"CAST(year({d}) * 4 + quarter({d}) - 1 AS INTEGER)"


def sql_q_end(q: str) -> str:
    return f"CAST(last_day(make_date(CAST(({q}) // 4 AS INTEGER), CAST(({q}) % 4 * 3 + 3 AS INTEGER), 1)) AS DATE)"


def sql_q_label(q: str) -> str:
    return f"(CAST(({q}) // 4 AS VARCHAR) || 'Q' || CAST(({q}) % 4 + 1 AS VARCHAR))"


def sql_nearest_q(d: str) -> str:
    before = f"CAST(date_trunc('quarter', {d}) - INTERVAL 1 DAY AS DATE)"
    after = f"CAST(date_trunc('quarter', {d}) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"
    return f"CASE WHEN date_diff('day', {before}, {d}) <= date_diff('day', {d}, {after}) THEN {sql_q(d)} - 1 ELSE {sql_q(d)} END"

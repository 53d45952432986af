"""DuckDB fragments shared by the SQL twins.

DuckDB has no aligned search in BLOBs, so bytes become spaced hex text
("4D 5A 90 "): every byte is three characters and matches stay aligned.
"""

from __future__ import annotations

from bytesieve import rules
from bytesieve.plans.tables import cte


def spaced(value: bytes) -> str:
    return "".join(f"{b:02X} " for b in value)


def spaced_hex(expr: str) -> str:
    return f"regexp_replace(hex({expr}), '(..)', '\\1 ', 'g')"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(hx: str, pattern: bytes) -> str:
    return f"contains({hx}, {q(spaced(pattern))})"


def has_at(hx: str, pattern: bytes, offset: int = 0) -> str:
    return f"substr({hx}, {offset * 3 + 1}, {len(pattern) * 3}) = {q(spaced(pattern))}"


def first_signature(hx: str, signatures, default: str) -> str:
    arms = " ".join(f"when {has_at(hx, s.pattern, s.offset)} then {q(s.file_type)}" for s in signatures)
    return f"case {arms} else {q(default)} end"


def byte(hx: str, offset: int) -> str:
    at = lambda i: f"(instr('0123456789ABCDEF', substr({hx}, {offset * 3 + i}, 1)) - 1)"
    return f"({at(1)} * 16 + {at(2)})"


def le(hx: str, offset: int, width: int) -> str:
    return "(" + " + ".join(f"{byte(hx, offset + i)} * {256 ** i}" for i in range(width)) + ")"


def name_of(path: str) -> str:
    return f"regexp_extract(regexp_replace({path}, '/+$', ''), '([^/]*)$', 1)"


def ext_of(name: str) -> str:
    return f"lower(regexp_extract({name}, '^.+\\.([^.]*)$', 1))"


def values(rows, columns: str, name: str) -> str:
    def lit(v):
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"{v!r}::double"
        if isinstance(v, int):
            return str(v)
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]"
        return q(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) as (values {body})"


TYPE_DIM = values(
    [(t, rules.TYPE_RISK.get(t, rules.DEFAULT_TYPE_RISK), t in rules.EXECUTABLE_TYPES, t in rules.SCRIPT_TYPES,
      rules.TYPE_NAMES.get(t, rules.DEFAULT_TYPE_NAME)) for t in rules.FILE_TYPES],
    "detected_type, type_risk, is_executable, is_script, type_name", "type_dim")

EXT_DIM = values(
    [(e, rules.EXTENSION_TYPES.get(e), rules.EXTENSION_RISK.get(e), e in rules.EXECUTABLE_EXTENSIONS)
     for e in sorted(set(rules.EXTENSION_TYPES) | set(rules.EXTENSION_RISK) | set(rules.EXECUTABLE_EXTENSIONS))],
    "extension, expected_types, listed_risk, runs", "ext_dim")

STATUS_DIM = values(rules.STATUSES, "status, is_terminal, is_active, description", "status_dim")
LEVEL_DIM = values(rules.RESOURCE_LEVELS,
                   "level, level_name, speed_multiplier, max_concurrent, level_text", "level_dim")


def half_even(x: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f', {x})"


HEAD = (
    cte("files")
    + f""",
    h as (select *, content[1:{rules.HEADER_SIZE}] as header, octet_length(content) as file_size,
            {name_of('path')} as name from files),
    x as (select *, {spaced_hex('header')} as hx, octet_length(header) as hlen, {ext_of('name')} as extension from h),
    t as (select *, {first_signature('hx', rules.SIGNATURES + rules.BYTE_ORDER_MARKS, rules.UNKNOWN_TYPE)}
            as detected_type from x),
    {TYPE_DIM},
    {EXT_DIM},
    e as (select t.*, coalesce(d.listed_risk, {rules.DEFAULT_EXTENSION_RISK}::double) as extension_risk,
            coalesce(d.runs, false) as runs, d.expected_types,
            coalesce(t.detected_type <> 'Unknown' and not list_contains(d.expected_types, t.detected_type), false)
              as spoofed,
            ((file_id * 37) % 101) / 100.0::double as score
          from t left join ext_dim d on t.extension = d.extension)
"""
)

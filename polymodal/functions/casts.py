"""Function-style casts, conversions of the graph language, sizes and settings."""

from __future__ import annotations

_CASTS = {"int2": "SMALLINT", "int4": "INT", "int8": "BIGINT", "oid": "BIGINT", "float4": "FLOAT", "float8": "DOUBLE", "numeric": "DECIMAL(38, 10)", "bool": "BOOLEAN", "text": "STRING", "varchar": "STRING", "bpchar": "STRING", "name": "STRING", "bytea": "BINARY", "uuid": "STRING", "money": "DECIMAL(19, 2)", "timestamptz": "TIMESTAMP", "timestamp": "TIMESTAMP_NTZ", "json": "STRING", "jsonb": "STRING", "cidr": "STRING", "pg_lsn": "STRING", "inet": "STRING", "bit": "STRING", "varbit": "STRING", "xml": "STRING", "timetz": "BIGINT"}
_BOOLEAN = "(CASE lower(trim(CAST({0} AS STRING))) WHEN 'true' THEN true WHEN 'false' THEN false {1} END)"


def _strict(x, kind):
    return f"(CASE WHEN {x} IS NOT NULL AND try_cast({x} AS {kind}) IS NULL THEN raise_error('invalid value') ELSE try_cast({x} AS {kind}) END)"


MACROS = {
    **{k: (lambda x, *_, t=t: f"CAST({x} AS {t})") for k, t in _CASTS.items()},
    "char": lambda x: f"substring({x}, 1, 1)" if x.startswith("'") else f"char({x})",
    "interval": lambda x: f"CAST({x} AS INTERVAL DAY TO SECOND)",
    "toboolean": lambda x: _BOOLEAN.format(x, ""),
    "tobooleanornull": lambda x: _BOOLEAN.format(x, ""),
    "tointeger": lambda x: f"CAST(try_cast({x} AS DOUBLE) AS BIGINT)",
    "tointegerornull": lambda x: f"CAST(try_cast({x} AS DOUBLE) AS BIGINT)",
    "tofloat": lambda x: f"try_cast({x} AS DOUBLE)",
    "tofloatornull": lambda x: f"try_cast({x} AS DOUBLE)",
    "tostring": lambda x: f"CAST({x} AS STRING)",
    "tostringornull": lambda x: f"CAST({x} AS STRING)",
    "toupper": lambda x: f"upper({x})",
    "tolower": lambda x: f"lower({x})",
    "pg_input_is_valid": lambda x, t: f"(try_cast({x} AS {_CASTS.get(t.strip(chr(39)), t.strip(chr(39)))}) IS NOT NULL)",
    "pg_size_pretty": lambda n: f"(CASE WHEN abs({n}) < 10240 THEN concat({n}, ' bytes') WHEN abs({n}) < 10485760 THEN concat(CAST(round({n} / 1024D) AS BIGINT), ' kB') WHEN abs({n}) < 10737418240 THEN concat(CAST(round({n} / 1048576D) AS BIGINT), ' MB') WHEN abs({n}) < 10995116277760 THEN concat(CAST(round({n} / 1073741824D) AS BIGINT), ' GB') ELSE concat(CAST(round({n} / 1099511627776D) AS BIGINT), ' TB') END)",
    "pg_size_bytes": lambda s: f"CAST(CAST(regexp_extract({s}, '([0-9.]+)', 1) AS DOUBLE) * CASE lower(regexp_extract({s}, '([a-zA-Z]+)', 1)) WHEN 'kb' THEN 1024 WHEN 'mb' THEN 1048576 WHEN 'gb' THEN 1073741824 WHEN 'tb' THEN 1099511627776 ELSE 1 END AS BIGINT)",
    "current_schemas": lambda *_: "array(current_schema())",
    "current_catalog": lambda: "current_catalog()",
    "getdatabaseencoding": lambda: "'UTF8'",
    "pg_client_encoding": lambda: "'UTF8'",
    "format_type": lambda t, *_: f"CAST({t} AS STRING)",
}

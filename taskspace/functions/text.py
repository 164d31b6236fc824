"""Text of values: float formatting, displays and the literals of other languages."""

from __future__ import annotations

import json
import re
import shlex

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import ranges
from ..types import ExprType, without_null


def format_float(x: float) -> str:
    """As floats are shown: plain from 1e-4 to below 1e16, with a signed two-digit exponent otherwise."""
    if x == 0:
        return "0.0"
    if 1e-4 <= abs(x) < 1e16:
        return f"{int(x)}.0" if x == int(x) else repr(x) if "e" not in repr(x) else f"{x:.20f}".rstrip("0")
    mantissa, exponent = repr(x).split("e") if "e" in repr(x) else f"{x:e}".split("e")
    return f"{mantissa.removesuffix('.0')}e{int(exponent):+03d}"


def float_text(c: Column) -> Column:
    """The same for a column, from Spark's shortest digits."""
    s = c.cast("string")
    sign = F.when(F.startswith(s, F.lit("-")), "-").otherwise("")
    mantissa = F.regexp_extract(s, r"^-?([0-9.]+)", 1)
    exponent = F.coalesce(F.regexp_extract(s, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    whole, part = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    digits = F.concat(whole, F.when(part == "0", "").otherwise(part))
    point = F.length(whole) + exponent
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    inner = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits)))
    plain = F.when(point <= 0, small).when(F.length(digits) > point, inner).otherwise(F.concat(F.rpad(digits, point, F.lit("0")), F.lit(".0")))
    shift = F.when(exponent < 0, F.concat(F.lit("-"), F.lpad((-exponent).cast("string"), F.greatest(F.lit(2), F.length((-exponent).cast("string"))), F.lit("0")))).otherwise(F.concat(F.lit("+"), F.lpad(exponent.cast("string"), F.greatest(F.lit(2), F.length(exponent.cast("string"))), F.lit("0"))))
    scientific = F.concat(whole, F.when(part == "0", "").otherwise(F.concat(F.lit("."), part)), F.lit("e"), shift)
    size = F.abs(c)
    return F.when(c.isNull(), F.lit(None).cast("string")).when(c == 0, "0.0").otherwise(F.concat(sign, F.when((size >= 1e-4) & (size < 1e16), plain).otherwise(scientific)))


def quote_json(c: Column) -> Column:
    """A JSON string with quotes, backslashes and control characters escaped; other characters as they are."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(code, f"\\u{code:04x}")
        out = F.replace(out, F.lit(chr(code)), F.lit(short))
    return F.concat(F.lit('"'), out, F.lit('"'))


def display(c: Column, t: ExprType, inside: bool = False) -> Column:
    """What ``string()`` and format strings show of a value; lists are JSON arrays. Null shows as ``null``."""
    t = without_null(t)
    if t.code in ("string", "path"):
        shown = quote_json(c) if inside else c
    elif t.code == "int":
        shown = c.cast("string")
    elif t.code == "float":
        shown = float_text(c)
    elif t.code == "bool":
        shown = F.when(c, "true").when(~c, "false")
    elif t.code == "range_expr":
        shown = quote_json(ranges.display(c)) if inside else ranges.display(c)
    elif t.code == "list":
        shown = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: display(x, t.item, True)), ", "), F.lit("]"))
    else:
        return F.lit("null")
    return F.coalesce(shown, F.lit("null")) if not inside else shown


# -- literals of other languages, over Python values -------------------------------------------------------------------
class QuoteError(ValueError):
    """A value that a shell can't hold."""


def _scalar(v) -> str | None:
    if v is None or isinstance(v, (str, list)):
        return None
    if isinstance(v, bool):
        return "true" if v else "false"
    return format_float(v) if isinstance(v, float) else str(v)


def show(v, inside: bool = False) -> str:
    if v is None:
        return "null"
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False) if inside else v
    if isinstance(v, list):
        return "[" + ", ".join(show(x, True) for x in v) + "]"
    return _scalar(v)


def repr_json(v) -> str:
    if isinstance(v, list):
        return "[" + ", ".join(map(repr_json, v)) + "]"
    return json.dumps(v) if v is None or isinstance(v, str) else _scalar(v)


def repr_py(v) -> str:
    if isinstance(v, list):
        return "[" + ", ".join(map(repr_py, v)) + "]"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(v) if v is None or isinstance(v, bool) else _scalar(v)


def _shell(s: str) -> str:
    if "\0" in s:
        raise QuoteError("Cannot shell-quote string: it holds a NUL")
    return shlex.quote(s)


def repr_sh(v) -> str:
    if isinstance(v, list):
        return " ".join(_shell(show(x)) if isinstance(x, (str, list)) else show(x) for x in v)
    return "''" if v is None else _shell(v) if isinstance(v, str) else _scalar(v)


#: Fixed value: the characters that make cmd.exe need quotes.
CMD_SPECIAL = " \t&|<>^\"()%!"


def _cmd(s: str) -> str:
    bare = s.replace("\n", "").replace("\r", "")
    if bare and not any(c in CMD_SPECIAL for c in bare):
        return bare
    return '"' + re.sub(r'[\^"%!]', lambda m: {"%": "%%", "!": "^^!"}.get(m[0], "^" + m[0]), bare) + '"'


def repr_cmd(v) -> str:
    if isinstance(v, list):
        return " ".join(_cmd(x) if isinstance(x, str) else show(x) for x in v)
    return '""' if v is None else _cmd(v) if isinstance(v, str) else _scalar(v)


def repr_pwsh(v) -> str:
    if isinstance(v, list):
        items = ", ".join(map(repr_pwsh, v))
        return f"@(,{items})" if len(v) == 1 and isinstance(v[0], list) else f"@({items})"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return "$null" if v is None else {True: "$true", False: "$false"}[v] if isinstance(v, bool) else _scalar(v)


REPRS = {"repr_json": repr_json, "repr_py": repr_py, "repr_sh": repr_sh, "repr_cmd": repr_cmd, "repr_pwsh": repr_pwsh}


def plain(v):
    """An Arrow value as Python lists and scalars."""
    if hasattr(v, "tolist"):
        v = v.tolist()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

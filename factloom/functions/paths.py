"""Path and module-specifier functions (JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A path needs rewriting if it holds a backslash, an empty or "." segment or a closing slash.
_ODD = r"\\|//|(^|/)\.(/|$)|./$"


def plain_path(path: Column) -> Column:
    """Backslash reads as ``/``; empty and ``.`` segments drop out; ``..`` and letter case stay.

    Null and empty paths, and paths without any segment, give null.
    """
    forward = F.translate(path, "\\", "/")
    kept = F.filter(F.split(forward, "/"), lambda s: (s != "") & (s != "."))
    rebuilt = F.concat(F.when(forward.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))
    plain = F.when(path.rlike(_ODD), rebuilt).otherwise(path)
    return F.when(~plain.isin("", "/"), plain)


def file_extension(path: Column) -> Column:
    """The last extension in lower case, with its dot; null where there is none."""
    ext = F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1)
    return F.when(ext != "", F.lower(ext))


def package_root(module: Column) -> Column:
    """``name`` of ``name/x``, ``@scope/name`` of ``@scope/name/x``."""
    return F.when(module.startswith("@"), F.substring_index(module, "/", 2)).otherwise(F.substring_index(module, "/", 1))


def under_prefix(module: Column, prefix: Column) -> Column:
    """True where ``module`` is ``prefix`` itself or below it."""
    return (module == prefix) | F.startswith(module, F.concat(prefix, F.lit("/")))

"""Node keys and other identities as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def with_repo(*frames: DataFrame) -> list[DataFrame]:
    """The frames, each with a column repo: one empty name where all rows are of one repository."""
    return [df if "repo" in df.columns else df.withColumn("repo", F.lit("")) for df in frames]


def repo_key(repo: Column | str) -> Column:
    return F.concat(F.lit("repo:"), _c(repo))


def file_key(repo: Column | str, path: Column | str) -> Column:
    return F.concat(F.lit("file:"), _c(repo), F.lit(":"), _c(path))


def symbol_key(repo: Column | str, module: Column | str, qualname: Column | str, path: Column | str) -> Column:
    """The scope is the module, or the path where the module is missing or empty."""
    scope = F.coalesce(F.nullif(_c(module), F.lit("")), _c(path))
    return F.concat(F.lit("sym:"), _c(repo), F.lit(":"), scope, F.lit(":"), _c(qualname))


def module_key(repo: Column | str, dotted: Column | str) -> Column:
    return F.concat(F.lit("mod:"), _c(repo), F.lit(":"), _c(dotted))


def external_class_key(repo: Column | str, name: Column | str) -> Column:
    return F.concat(F.lit("sym:"), _c(repo), F.lit(":external:"), _c(name))


def top_level(dotted: Column | str) -> Column:
    """First segment after leading dots; the input itself where that is empty."""
    d = _c(dotted)
    return F.coalesce(F.nullif(F.substring_index(F.regexp_replace(d, r"^\.+", ""), ".", 1), F.lit("")), d)


def short_key(key: Column | str) -> Column:
    """The part after the last colon, or the key where nothing follows it."""
    k = _c(key)
    return F.coalesce(F.nullif(F.substring_index(k, ":", -1), F.lit("")), k)


def display(*names: Column | str) -> Column:
    """The first of the names that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_c(n), F.lit("")) for n in names])


def citation(path: Column | str, line: Column | str) -> Column:
    return F.concat_ws(":", _c(path), _c(line).cast("string"))


def uuid5(namespace: str, name: Column | str) -> Column:
    """Version-5 UUID of a name, from SHA-1 as a built-in function. namespace: 32 hex digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(_c(name), "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)
    )

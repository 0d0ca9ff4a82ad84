"""Names, URLs and sources as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MAX_URL = 512
LOCAL_NAMES = ("localhost", "localhost.localdomain", "ip6-localhost")
MAX_NAME = 255


def classify_source(source: Column) -> Column:
    """git for a URL or a name in .git, zip for a name in .zip, else local."""
    return F.when(source.rlike("^(https?://|git@|ssh://|git://)") | source.endswith(".git"), "git").when(F.lower(source).endswith(".zip"), "zip").otherwise("local")


def derive_name(source: Column, kind: Column) -> Column:
    """The last segment of a path or address, safe as a folder name; null where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(source, r"[/\\]+$", ""), r"^.*[/\\:]", "")
    stem = F.when(kind == "zip", F.regexp_replace(bare, r"(?<=.)\.[^.]*$", "")).when(kind == "git", F.regexp_replace(bare, r"\.git$", "")).otherwise(bare)
    safe = F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.nullif(safe, F.lit(""))


def human_size(size: Column) -> Column:
    out = F.when(size < 1024, F.format_string("%d B", size.cast("long")))
    for k, unit in ((1, "KB"), (2, "MB")):
        out = out.when(size < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", F.round(size / F.lit(float(1024**k)), 1)))
    return out.otherwise(F.format_string("%.1f GB", F.round(size / F.lit(float(1024**3)), 1)))


def url_host(url: Column) -> Column:
    """The host of scheme://user@host:port/… or of user@host:path, lower-cased, without brackets."""
    scp = F.regexp_extract(url, r"^[A-Za-z0-9._-]+@([A-Za-z0-9.-]+):.+$", 1)
    rest = F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)
    host = F.regexp_extract(F.regexp_replace(rest, "^.*@", ""), r"^(\[[^\]]*\]|[^:]*)", 1)
    return F.lower(F.regexp_replace(F.when(scp != "", scp).otherwise(host), r"[\[\]]", ""))


def private_host(host: Column) -> Column:
    """A local name, or a literal IPv4 or IPv6 address that is loopback, private, link-local, reserved or unspecified."""
    four = host.rlike(r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$")
    inner = host.rlike(
        r"^(0\.|10\.|127\.|169\.254\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|192\.0\.0\.(?!9$|10$)|192\.0\.2\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|24\d\.|25[0-5]\.)"
    )
    six = host.rlike(r"^(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*)$")
    return host.isin(*LOCAL_NAMES) | (four & inner) | six


def git_url_problem(value: Column) -> Column:
    """Why a URL is refused: empty, too_long, control_characters, scheme, host, credentials, private_host; null if it is fine."""
    url = F.trim(value)
    scp = url.rlike(r"^[A-Za-z0-9._-]+@[A-Za-z0-9.-]+:.+$")
    host = url_host(url)
    return (
        F.when(url.isNull() | (url == ""), "empty")
        .when(F.length(url) > MAX_URL, "too_long")
        .when(url.rlike(r"[\n\r\t\x00]"), "control_characters")
        .when(scp, F.when(private_host(host), "private_host"))
        .when(~url.rlike("^(https?|ssh|git)://"), "scheme")
        .when(host == "", "host")
        .when(url.rlike(r"^[a-z]+://[^/?#@]*:[^/?#@]+@"), "credentials")
        .when(private_host(host), "private_host")
    )


def name_problem(name: Column) -> Column:
    """Why a repository name is refused, or null."""
    n = F.trim(name)
    return F.when(n.isNull() | (n == ""), "empty").when(F.length(n) > MAX_NAME, "too_long").when(n.rlike(r"[/\\\x00-\x1f]"), "forbidden_characters")


def count_words(text: Column) -> Column:
    """Runs of word characters of any script."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\w+")), F.lit(0))

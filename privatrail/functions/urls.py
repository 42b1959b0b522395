"""Column functions on URLs, hosts and requester identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: two-label endings where the registrable name has three labels
COMPOUND_SUFFIXES = [
    "co.uk", "org.uk", "co.jp", "co.kr", "co.nz", "co.za", "co.in",
    "com.au", "net.au", "com.br", "com.mx", "com.sg", "com.tr",
]


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, '' when there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def has_query_key(url: Column, keys: list[str]) -> Column:
    """True when one of the keys occurs in the query with a non-blank value."""
    return F.concat(F.lit("&"), query_of(url)).rlike("&(?:" + "|".join(keys) + ")=[^&]")


def clean_host(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^\.+|\.+$", "")


def host_suffixes(host: Column) -> Column:
    """array<struct<n, suffix>> of the host's label suffixes, longest first (n = 0)."""
    def build(labels: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(labels) - 1),
            lambda i: F.struct(
                i.alias("n"),
                F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("suffix"),
            ),
        )

    return F.transform(F.array(F.split(host, r"\.")), build)[0]


def registrable_domain(host: Column) -> Column:
    """Last two labels, or three behind a compound suffix."""
    last_two = F.substring_index(host, ".", -2)
    last_three = F.substring_index(host, ".", -3)
    return F.when(last_two.isin(COMPOUND_SUFFIXES), last_three).otherwise(last_two)


def safe_origin(value: Column, fallback: Column | None = None) -> Column:
    """Scheme, host and port of a web address; anything else falls back to the caller's redacted text, or to a hash."""
    scheme = F.lower(F.regexp_extract(value, r"^(?i)(https?)://", 1))
    host = host_of(value)
    port = F.regexp_extract(value, r"^[A-Za-z]+://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*)(:[0-9]+)", 1)
    port = F.when(port.rlike("^:0+$"), "").otherwise(port)
    other = F.concat(F.lit("text:"), F.substring(F.sha2(value, 256), 1, 24)) if fallback is None else fallback
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, port)).otherwise(other)


def is_path(value: Column) -> Column:
    return value.rlike(r"^(?:/|\\\\|[A-Za-z]:[\\/])")


def public_identity(value: Column, fallback: Column | None = None) -> Column:
    """What may be stored about a requester: an origin, or a hash of an application path."""
    path = F.lower(F.regexp_replace(value, r"\\", "/"))
    hashed = F.concat(F.lit("app:"), F.substring(F.sha2(path, 256), 1, 24))
    return F.when(is_path(value), hashed).otherwise(safe_origin(value, fallback))


def requester_key(origin: Column, bundle_id: Column, exe_path: Column, name: Column) -> Column:
    """First non-empty of origin, bundle id, path and display name."""
    parts = [F.when(c != "", c) for c in (origin, bundle_id, exe_path, name)]
    return F.coalesce(*parts, F.lit(""))

"""URL functions as Spark Column expressions.

Everything here is built from ``regexp_extract`` / ``regexp_replace`` /
``CASE``, so it runs inside whole-stage codegen; no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 3986 appendix B: scheme, authority, path, query, fragment.
_URI = r"^(([a-zA-Z][a-zA-Z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"


def url_part(url: Column, part: str) -> Column:
    idx = {"scheme": 2, "authority": 4, "path": 5, "query": 7, "fragment": 9}[part]
    return F.regexp_extract(url, _URI, idx)


def _remove_dot_segments(path: Column) -> Column:
    """RFC 3986 5.2.4 for a path that starts with "/": however many dot segments it has."""
    parts = F.slice(F.split(path, "/", -1), 2, 1 << 30)
    start = F.array().cast("array<string>")
    kept = F.aggregate(parts, start, lambda acc, s: F.when(s == ".", acc).when(
        s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    tail = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(path.contains("/."), F.concat(joined, F.when(joined.endswith("/"), F.lit("")).otherwise(tail))
                  ).otherwise(path)


def urljoin(base: Column, ref: Column) -> Column:
    """``urljoin(base, ref)``; an empty or NULL ``ref`` gives ``''``."""
    scheme = url_part(base, "scheme")
    authority = url_part(base, "authority")
    bpath = url_part(base, "path")
    prefix = F.concat(scheme, F.lit("://"), authority)
    base_dir = F.regexp_replace(F.when(bpath == "", F.lit("/")).otherwise(bpath), r"[^/]*$", "")
    r = F.coalesce(ref, F.lit(""))
    r_path = url_part(r, "path")
    r_rest = F.regexp_extract(r, r"^[^?#]*(.*)$", 1)
    base_no_frag = F.regexp_replace(base, "#.*$", "")
    return (
        F.when(r == "", F.lit(""))
        .when(r.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), r)
        .when(r.startswith("//"), F.concat(scheme, F.lit(":"), r))
        .when(r.startswith("/"), F.concat(prefix, _remove_dot_segments(r_path), r_rest))
        .when(r.startswith("?"), F.concat(prefix, bpath, r))
        .when(r.startswith("#"), F.concat(base_no_frag, r))
        .otherwise(F.concat(prefix, _remove_dot_segments(F.concat(base_dir, r_path)), r_rest))
    )


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def _decoded(part: Column) -> Column:
    """A form-encoded name or value decoded; one that is malformed stays."""
    return F.coalesce(F.try_url_decode(part), part)


def _encoded(part: Column) -> Column:
    """Form encoding with ``_ . - ~`` left as they are."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def set_query_param(url: Column, name: str, value: Column) -> Column:
    """Set one query parameter.  Parameters keep the order of their first
    occurrence, repeated ones all their values; blank-valued ones are dropped;
    names and values are decoded and encoded again; the fragment is kept."""
    query = url_part(url, "query")
    frag = url_part(url, "fragment")
    has_frag = F.instr(url, "#") > 0
    pairs = F.filter(F.split(query, "&"), lambda kv: (kv != "") & ~kv.rlike("^[^=]*=?$"))
    pairs = F.transform(pairs, lambda kv: F.struct(
        _decoded(F.regexp_extract(kv, "^([^=]*)=", 1)).alias("k"), _decoded(F.regexp_extract(kv, "=(.*)$", 1)).alias("v")))
    names = F.array_distinct(F.concat(F.transform(pairs, lambda p: p["k"]), F.array(F.lit(name))))
    items = F.flatten(F.transform(names, lambda n: F.when(n == name, F.array(F.struct(
        n.alias("k"), value.cast("string").alias("v")))).otherwise(F.filter(pairs, lambda p: p["k"] == n))))
    text = F.transform(items, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"])))
    head = F.concat(url_part(url, "scheme"), F.lit("://"), url_part(url, "authority"), url_part(url, "path"))
    return F.concat(head, F.lit("?"), F.array_join(text, "&"),
                    F.when(has_frag, F.concat(F.lit("#"), frag)).otherwise(F.lit("")))


def query_param_number(url: Column, name: str) -> Column:
    """The parameter's value as a number; null where it has none."""
    return F.regexp_extract(url, rf"[?&]{name}=(\d{{1,15}})(?:[&#]|$)", 1).try_cast("bigint")


def without_query_param(url: Column, name: str) -> Column:
    """The URL without that parameter and without its fragment."""
    u = F.regexp_replace(strip_fragment(url), rf"([?&]){name}=[^&]*&?", "$1")
    return F.regexp_replace(u, "[?&]$", "")


def directory_url_from_profile(url: Column, marker: str = "/lawyer/", directory_path: str = "/people/",
                               host: str | None = None) -> Column:
    """Text before ``marker`` + ``directory_path`` for profile URLs
    (optionally only on one host); other URLs unchanged."""
    cond = F.instr(url, marker) > 0
    if host is not None:
        cond = cond & (url_part(url, "authority") == host)
    return F.when(cond, F.concat(F.substring_index(url, marker, 1), F.lit(directory_path))).otherwise(url)


def subpage_pattern_from_target(target_url: Column, marker: str = "/lawyer/") -> Column:
    """``<text before marker>/lawyer/*`` for a target URL holding the marker."""
    return F.when(F.instr(target_url, marker) > 0,
                  F.concat(F.substring_index(target_url, marker, 1), F.lit(marker + "*")))

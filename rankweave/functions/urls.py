"""Web addresses as Column functions: scheme, host and port as browsers see them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

_ORIGIN = r"^(?i:(https?)):/*([^/?#\\]*)([/\\][^?#]*)?"


def url_parts(c: Column | str) -> Column:
    """struct(scheme, user, host, port, path); null unless http or https with a host.

    The scheme and host are lower-cased and a default port is dropped.
    """
    x = F.trim(_col(c))
    scheme = F.lower(F.regexp_extract(x, _ORIGIN, 1))
    authority = F.regexp_extract(x, _ORIGIN, 2)
    at = F.regexp_extract(authority, r"^(.*)@", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    port = F.when(((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(port)
    path = F.regexp_extract(x, _ORIGIN, 3)
    ok = x.rlike(_ORIGIN) & (host != "") & ~host.rlike(r"[\s<>^|%\x00-\x20]")
    return F.when(ok, F.struct(
        scheme.alias("scheme"), at.alias("user"), host.alias("host"), port.alias("port"), F.when(path == "", "/").otherwise(path).alias("path")))


def site_target(c: Column | str) -> Column:
    """struct(origin, permission) of a site that may be enabled, else null."""
    u = url_parts(c)
    host, path = u["host"], u["path"]
    native = host.rlike(r"(^|\.)cnki\.net$") | ((u["scheme"] == "https") & host.isin("scholar.google.com", "scholar.google.com.hk"))
    store = (host == "chromewebstore.google.com") | ((host == "chrome.google.com") & F.startswith(path, F.lit("/webstore")))
    ok = u.isNotNull() & (u["user"] == "") & ~F.contains(host, F.lit("*")) & ~native & ~store
    origin = F.concat(u["scheme"], F.lit("://"), host, F.when(u["port"] != "", F.concat(F.lit(":"), u["port"])).otherwise(""))
    return F.when(ok, F.struct(origin.alias("origin"), F.concat(u["scheme"], F.lit("://"), host, F.lit("/*")).alias("permission")))


def enabled_sites(values: Column | str) -> Column:
    """Saved origins that are their own target, distinct, the first 100."""
    good = F.filter(_col(values), lambda v: F.coalesce(site_target(v)["origin"] == v, F.lit(False)))
    return F.slice(F.array_distinct(good), 1, 100)

"""URL rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed

_UNUSUAL_PORTS_EXCEPT = (80, 443, 8080, 8443)


def normalized(url: Column) -> Column:
    """Trimmed, with https:// in front unless it has http:// or https://; null where nothing is left."""
    text = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    return F.when(text == "", None).when(text.startswith("http://") | text.startswith("https://"), text).otherwise(F.concat(F.lit("https://"), text))


def redirected(first: Column, last: Column) -> Column:
    """Whether two URLs differ but for slashes at the end."""
    return F.regexp_replace(first, "/+$", "") != F.regexp_replace(last, "/+$", "")


def authority(url: Column) -> Column:
    cleaned = F.regexp_replace(url, r"[\t\r\n]", "")
    return F.regexp_extract(F.when(cleaned.contains("://"), cleaned).otherwise(F.concat(F.lit("http://"), cleaned)), r"^[^/?#]*://([^/?#]*)", 1)


def domain_changed(first: Column, last: Column) -> Column:
    return authority(first) != authority(last)


def parts(url: Column) -> Column:
    """(protocol, host, path, query) for display."""
    full = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))
    return F.struct(
        F.lower(F.regexp_extract(full, r"^([^/?#:]*)://", 1)).alias("protocol"),
        F.lower(F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":[0-9]*$", "")).alias("host"),
        F.regexp_extract(full, r"^[^/?#]*://[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(full, r"^[^?#]*(\?[^#]*)", 1).alias("query"),
    )


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def risk(url: Column) -> Column:
    """(score, signals): the sum of the rules that fire, at most 1, and each rule's label and impact, largest first and then in the rules' order.

    No host, or a port that is no number up to 65535: score 0 and no signals. A null URL gives null.
    """
    cleaned = F.regexp_replace(url, r"[\t\r\n]", "")
    full = F.when(cleaned.contains("://"), cleaned).otherwise(F.concat(F.lit("http://"), cleaned))
    split = F.struct(url.alias("url"), F.regexp_replace(F.regexp_extract(full, r"^[^/?#]*://([^/?#]*)", 1), r"^.*@", "").alias("server"), F.regexp_extract(full, r"^[^/?#]*://[^/?#]*([^?#]*)", 1).alias("path"))
    return F.when(url.isNotNull(), _let(split, lambda x: _let(_server(x), lambda y: _let(_counts(y), _rated))))


def _server(x: Column) -> Column:
    server = x["server"]
    bracketed = server.startswith("[")
    port = F.when(bracketed, F.regexp_extract(server, r"^\[[^\]]*\]:?(.*)$", 1)).otherwise(F.regexp_extract(server, r"^[^:]*:?(.*)$", 1))
    host = F.when(bracketed, F.regexp_extract(server, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(server, r"^([^:]*)", 1))
    host = F.regexp_replace(F.lower(host), r"^\.+|\.+$", "")
    return F.struct(x["url"].alias("url"), x["path"].alias("path"), host.alias("host"), F.split(host, r"\.").alias("names"), port.alias("port_text"), F.when(port.rlike(r"^[0-9]{1,9}$"), port.try_cast("int")).alias("port"))


def _counts(x: Column) -> Column:
    names, port = x["names"], x["port"]
    name = F.when(F.size(names) >= 2, F.try_element_at(names, F.lit(-2))).otherwise(F.element_at(names, 1))
    return F.struct(
        x["host"].alias("host"),
        x["url"].alias("url"),
        F.length(x["url"]).alias("length"),
        port.alias("port"),
        F.element_at(names, -1).alias("tld"),
        F.greatest(F.size(names) - 2, F.lit(0)).alias("below"),
        F.regexp_count(name, F.lit("-")).alias("hyphens"),
        F.regexp_count(name, F.lit("[0-9]")).alias("digits"),
        F.regexp_count(x["path"], F.lit("/")).alias("depth"),
        ((x["port_text"] != "") & (port.isNull() | (port > 65535)) | (x["host"] == "")).alias("broken"),
    )


def _rated(x: Column) -> Column:
    host, port, below, hyphens, digits, depth, length = (x[k] for k in ("host", "port", "below", "hyphens", "digits", "depth", "length"))
    say = F.format_string
    rules = [
        (host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.lit("IP address as hostname"), 0.55),
        (x["tld"].isin(fixed.SUSPECT_TLDS), say("High-risk TLD (.%s)", x["tld"]), 0.30),
        (host.contains("xn--"), F.lit("Punycode / IDN homograph domain"), 0.40),
        (x["url"].contains("@"), F.lit("@ symbol in URL"), 0.45),
        (below >= 4, say("%d subdomain levels", below), 0.35),
        (below == 3, F.lit("3 subdomain levels"), 0.15),
        (hyphens >= 4, say("%d hyphens in domain", hyphens), 0.25),
        (hyphens == 3, F.lit("3 hyphens in domain"), 0.10),
        ((port > 0) & ~port.isin(*_UNUSUAL_PORTS_EXCEPT), say("Non-standard port (%d)", port), 0.20),
        (length > 200, say("Very long URL (%d chars)", length), 0.20),
        ((length > 120) & (length <= 200), say("Long URL (%d chars)", length), 0.08),
        (host.contains("%"), F.lit("URL-encoded characters in hostname"), 0.35),
        (digits >= 5, say("Many digits in domain (%d)", digits), 0.12),
        (depth >= 6, say("Deep URL path (/%d levels)", depth), 0.10),
    ]
    fired = F.array(*(F.when(on, F.struct((-F.lit(impact)).alias("order"), F.lit(i).alias("rule"), label.alias("label"), F.lit(impact).alias("impact"))) for i, (on, label, impact) in enumerate(rules)))
    none = F.filter(F.array_compact(fired), lambda s: F.lit(False))
    return _let(F.when(x["broken"], none).otherwise(F.array_sort(F.array_compact(fired))), _summed)


def _summed(signals: Column) -> Column:
    total = F.round(F.least(F.aggregate(signals, F.lit(0.0), lambda s, x: s + x["impact"]), F.lit(1.0)), 4)
    return F.struct(total.alias("score"), F.transform(signals, lambda x: F.struct(x["label"].alias("label"), x["impact"].alias("impact"))).alias("signals"))


def neutral(href: Column) -> Column:
    """What kind of address an href is; the first kind that fits."""
    text = F.coalesce(F.trim(F.regexp_replace(href, r"^\s+|\s+$", "")), F.lit(""))
    return (
        F.when(text == "", "URL_EMPTY")
        .when(text.startswith("javascript"), "URL_JS")
        .when(text.startswith("data:"), "URL_DATA")
        .when(text.startswith("mailto:"), "URL_MAIL")
        .when(text.startswith("#"), "URL_ANCHOR")
        .when(~(text.startswith("http://") | text.startswith("https://")), "URL_INT")
        .when(text.rlike("(?i)" + "|".join(fixed.SENSITIVE)), "URL_EXT_SENSITIVE")
        .otherwise("URL_EXT")
    )

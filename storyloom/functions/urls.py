"""URL canonicalisation with built-in string and array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions.binding import let
from storyloom.functions.text import trim_space

# Query parameters that never tell two documents apart.
TRACKING_PREFIXES = ("utm_", "mc_")
TRACKING_PARAMS = tuple(
    """
    fbclid gclid gbraid wbraid dclid msclkid igshid
    mkt_tok cmpid cid ncid spm ref ref_src source
    _hsenc _hsmi icid oicd ito at_medium at_campaign
    """.split()
)
# Schemes with a host, and their default ports.
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}

_WEB = r"(?i)^(https?|ftp|wss?):[/\\]*([^/\\?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_OTHER = r"^([A-Za-z][A-Za-z0-9+.\-]*):([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_AUTHORITY = r"^(?:(.*)@)?(\[[0-9A-Fa-f:.]+\]|[^@:]*)(?::([0-9]*))?$"
_BAD_HOST = r"[\x{0}-\x{20}\"#%/<>?@\\^`{|}\x{7F}]"
_UNSAFE_PATH = r"[^\x{21}\x{23}-\x{3B}\x{3D}\x{40}-\x{5F}\x{61}-\x{7A}\x{7C}\x{7E}]"


def canonical_url(url: Column) -> Column:
    """One spelling per document address; text that is no URL is only trimmed.

    Scheme and host are lower-cased, a leading ``www.``, the default port, the
    fragment, tracking parameters and trailing slashes go, and the remaining
    parameters are sorted by name then value in byte order.
    """

    def spelled(trimmed: Column) -> Column:
        # Tabs and line breaks inside a URL are ignored by URL parsers.
        clean = F.regexp_replace(trimmed, r"[\t\n\r]", "")
        return F.coalesce(let(clean, _web_url), let(clean, _other_url), trimmed)

    return let(trim_space(url), spelled)


def _web_url(url: Column) -> Column:
    parts = F.struct(
        *(
            F.regexp_extract(url, _WEB, group).alias(name)
            for group, name in enumerate(("scheme", "authority", "path", "query"), start=1)
        )
    )
    return F.when(url.rlike(_WEB), let(parts, _join_web_url))


def _join_web_url(parts: Column) -> Column:
    authority = parts["authority"]
    host = F.lower(F.regexp_extract(authority, _AUTHORITY, 2))
    pieces = F.struct(
        F.lower(parts["scheme"]).alias("scheme"),
        F.regexp_extract(authority, _AUTHORITY, 1).alias("user"),
        F.regexp_replace(host, r"^www\.(?=.)", "").alias("host"),
        F.regexp_replace(F.regexp_extract(authority, _AUTHORITY, 3), "^0+(?=.)", "").alias("port"),
    )

    def joined(p: Column) -> Column:
        default_port = F.lit(False)
        for scheme, number in DEFAULT_PORTS.items():
            default_port = default_port | ((p["scheme"] == scheme) & (p["port"] == number))
        valid = (
            authority.rlike(_AUTHORITY)
            & (p["host"] != "")
            & ~p["host"].rlike(_BAD_HOST)
            & (
                (p["port"] == "")
                | ((F.length(p["port"]) <= 5) & (p["port"].try_cast("int") <= 65535))
            )
        )
        url = F.concat(
            p["scheme"],
            F.lit("://"),
            F.when(p["user"] == "", "").otherwise(F.concat(p["user"], F.lit("@"))),
            p["host"],
            F.when((p["port"] == "") | default_port, "").otherwise(F.concat(F.lit(":"), p["port"])),
            _path(parts["path"]),
            _query(parts["query"]),
        )
        return F.when(valid, url)

    return let(pieces, joined)


def _other_url(url: Column) -> Column:
    """Schemes without a host: only scheme case, query and fragment are touched."""
    scheme = F.lower(F.regexp_extract(url, _OTHER, 1))
    return F.when(
        url.rlike(_OTHER) & ~scheme.isin(*DEFAULT_PORTS),
        F.concat(
            scheme,
            F.lit(":"),
            F.regexp_extract(url, _OTHER, 2),
            _query(F.regexp_extract(url, _OTHER, 3)),
        ),
    )


def _path(path: Column) -> Column:
    escaped = let(F.translate(path, "\\", "/"), _escape_path)
    resolved = let(escaped, _resolve_dots)
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(resolved, "^/", ""), r"/+$", ""))


def _escape_path(path: Column) -> Column:
    chars = F.transform(
        F.split(path, ""),
        lambda c: F.when(c == " ", "%20").when(c.rlike(_UNSAFE_PATH), F.url_encode(c)).otherwise(c),
    )
    return F.when(path.rlike(_UNSAFE_PATH), F.array_join(chars, "")).otherwise(path)


def _resolve_dots(path: Column) -> Column:
    kept = F.aggregate(
        F.split(F.substring(path, 2, 1 << 30), "/", -1),
        F.array().cast("array<string>"),
        lambda done, piece: F.when(
            piece.rlike(r"(?i)^(\.|%2e){2}$"),
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
        )
        .when(piece.rlike(r"(?i)^(\.|%2e)$"), done)
        .otherwise(F.concat(done, F.array(piece))),
    )
    return F.when(
        path.rlike(r"(?i)/(\.|%2e){1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))
    ).otherwise(path)


def _form_decode(text: Column) -> Column:
    fixed = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(fixed), text)


def _query(query: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(query, "&", -1), lambda p: p != ""),
        lambda p: F.struct(
            _form_decode(F.substring_index(p, "=", 1)).alias("name"),
            _form_decode(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )

    def identifies(pair: Column) -> Column:
        name = F.lower(pair["name"])
        tracking = name.isin(*TRACKING_PARAMS)
        for prefix in TRACKING_PREFIXES:
            tracking = tracking | name.startswith(prefix)
        return ~tracking

    kept = F.array_join(
        F.transform(
            F.array_sort(F.filter(pairs, identifies)),
            lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"])),
        ),
        "&",
    )
    return let(kept, lambda k: F.when(k == "", "").otherwise(F.concat(F.lit("?"), k)))

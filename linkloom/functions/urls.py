"""URL column expressions.

``parse_url`` rejects many links found in the wild (underscores in hosts, spaces or CJK in
paths), so the parts are cut with regular expressions instead.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom import rules
from linkloom.functions.text import any_of, contains_any, let, literal_pairs

_SCHEME = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + "//([^/?#]*)", 2)


def path(url: Column) -> Column:
    """Path without the ``;parameters`` of its last segment."""
    return F.regexp_extract(url, _SCHEME + r"(?://[^/?#]*)?((?:[^?#;]+|;(?=[^?#]*/))*)", 2)


def raw_path(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + "(?://[^/?#]*)?([^?#]*)", 2)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


_SERVER = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#]*@)?"


def host(url: Column) -> Column:
    """Lower-case host without user info, port and IPv6 brackets."""
    pattern = _SERVER + r"(?:\[([^\]/?#]*)|([^:/?#\[]*))"
    return F.lower(F.concat(F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)))


def port(url: Column) -> Column:
    """Explicit port as INT, NULL when absent."""
    return F.regexp_extract(netloc(url), r"(?:^|[^:\[]|\]):(\d{1,5})$", 1).try_cast("int")


def last_segment(p: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(p, r"(?:/+\.?)+$", ""), r"([^/]*)$", 1)


def suffix(p: Column) -> Column:
    """File suffix of a path with its dot, or an empty string."""
    return F.regexp_extract(last_segment(p), r"^.+(\.[^.]+)$", 1)


def stem(p: Column) -> Column:
    return F.regexp_replace(last_segment(p), r"^(.+)\.[^.]+$", "$1")


# --- identity ---------------------------------------------------------------------------


def fingerprint(url: Column) -> Column:
    """First 16 hex digits of md5 over host part and path; the query does not count."""
    return F.substring(F.md5(F.concat(F.lower(netloc(url)), path(url))), 1, 16)


def _params(q: Column) -> Column:
    """Query items that carry a value, decoded, as array<struct<k, v>>."""

    def decode(c):
        plain = F.replace(c, F.lit("+"), F.lit(" "))
        return F.coalesce(F.try_url_decode(c), plain)

    items = F.filter(F.split(q, "&"), lambda x: x.rlike("^[^=]*=."))
    return F.transform(
        items,
        lambda x: F.struct(
            decode(F.substring_index(x, "=", 1)).alias("k"),
            decode(F.substr(x, F.instr(x, "=") + F.lit(1))).alias("v"),
        ),
    )


def _encode(c: Column) -> Column:
    out = F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A"))
    return F.replace(out, F.lit("%7E"), F.lit("~"))


def _grouped(params: Column, keys: Column) -> Column:
    """Items re-encoded key by key; all values of a key stay together in their order."""
    parts = F.flatten(
        F.transform(
            keys,
            lambda k: F.transform(
                F.filter(params, lambda p: p["k"] == k),
                lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"])),
            ),
        )
    )
    return F.array_join(parts, "&")


def canonical(url: Column, keep: Sequence[str] | None = None) -> Column:
    """Query-aware identity: scheme, host, unusual port, path and parameters sorted by key."""

    def assemble(params):
        if keep is not None:
            params = F.filter(params, lambda p: p["k"].isin(list(keep)))
        keys = F.array_sort(F.array_distinct(F.transform(params, lambda p: p["k"])))
        return _grouped(params, keys)

    def build(p):
        tail = F.when(p["q"] == "", "").otherwise(F.concat(F.lit("?"), p["q"]))
        unusual = p["port"].isNotNull() & ~p["port"].isin(0, 80, 443)
        shown = F.when(unusual, F.concat(F.lit(":"), p["port"].cast("string"))).otherwise("")
        return F.concat(p["head"], F.lit("://"), p["host"], shown, p["path"], tail)

    def parts(u):
        return F.struct(
            scheme(u).alias("head"), host(u).alias("host"), port(u).alias("port"), path(u).alias("path"),
            let(_params(query(u)), assemble).alias("q"),
        )

    return let(url, lambda u: let(parts(u), build))


def sanitize(url: Column, sensitive: Sequence[str] = tuple(rules.SENSITIVE_PARAMS)) -> Column:
    """The URL without sensitive parameters; blank values are dropped, repeated keys grouped."""
    secret = f"^{any_of(sensitive)}$"

    def assemble(params):
        kept = F.filter(params, lambda p: ~F.lower(p["k"]).rlike(secret))
        return let(kept, lambda ps: _grouped(ps, F.array_distinct(F.transform(ps, lambda p: p["k"]))))

    def clean(u):
        head = F.regexp_extract(u, r"^[^?#]*", 0)
        tail = F.regexp_extract(u, r"(?s)#.+$", 0)
        q = let(_params(query(u)), assemble)
        return let(q, lambda x: F.concat(head, F.when(x == "", "").otherwise(F.concat(F.lit("?"), x)), tail))

    return let(url, lambda u: F.when(u.rlike("[?#]"), clean(u)).otherwise(u))


# --- hosts ------------------------------------------------------------------------------


def ipv4_number(h: Column) -> Column:
    """Dotted IPv4 literal as BIGINT, NULL for anything else."""

    def number(x):
        octets = F.transform(F.split(x, r"\."), lambda p: p.cast("bigint"))
        value = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)
        return F.when(F.forall(octets, lambda o: o <= 255), value)

    dotted = r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$"
    return let(h, lambda x: F.when(x.rlike(dotted), number(x)))


def ipv6_hex(h: Column) -> Column:
    """IPv6 literal as 32 hex digits, NULL for anything else."""

    def undotted(x):
        packed = F.lower(F.lpad(F.hex(ipv4_number(F.regexp_extract(x, r":([\d.]+)$", 1))), 8, "0"))
        pair = let(packed, lambda d: F.concat(F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4)))
        return F.when(x.rlike(r"\.\d+$"), F.concat(F.regexp_replace(x, r"[\d.]+$", ""), pair)).otherwise(x)

    def groups(side):
        return F.filter(F.split(side, ":"), lambda g: g != "")

    def fill(s):
        gap = F.lit(8) - F.size(s["left"]) - F.size(s["right"])
        zeros = F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0)))
        filled = F.when(s["open"] & (gap > 0), F.concat(s["left"], zeros, s["right"])).when(~s["open"], s["left"])
        return F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), "")

    def expand(t):
        is_open = F.contains(t, F.lit("::"))
        right = F.when(is_open, F.substring_index(t, "::", -1)).otherwise("")
        sides = F.struct(
            groups(F.substring_index(t, "::", 1)).alias("left"), groups(right).alias("right"), is_open.alias("open")
        )
        full = let(sides, fill)
        sound = t.rlike("^[0-9a-f:]*$") & ~t.rlike(":::|::.*::|[0-9a-f]{5}|^:[^:]|[^:]:$")
        return F.when(sound, let(full, lambda x: F.when(F.length(x) == 32, x)))

    bare = F.lower(F.regexp_replace(h, r"%.*$", ""))
    return F.when(F.contains(h, F.lit(":")), let(let(bare, undotted), expand))


def _in_ranges(c: Column, blocks: Sequence[str], version: int) -> Column:
    nets = [n for n in map(ipaddress.ip_network, blocks) if n.version == version]
    ranges = []
    for n in ipaddress.collapse_addresses(nets):
        lo, hi = int(n.network_address), int(n.broadcast_address)
        ranges.append((lo, hi) if version == 4 else (f"{lo:032x}", f"{hi:032x}"))
    if not ranges:
        return F.lit(False)
    return F.exists(literal_pairs(ranges, ("lo", "hi")), lambda r: c.between(r["lo"], r["hi"]))


def is_non_public(
    h: Column,
    blocks: Sequence[str] = tuple(rules.NON_PUBLIC_BLOCKS),
    exceptions: Sequence[str] = tuple(rules.PUBLIC_EXCEPTIONS),
) -> Column:
    """True for IP-literal hosts in private, loopback or reserved blocks; names are public."""

    def v4(n):
        return _in_ranges(n, blocks, 4) & ~_in_ranges(n, exceptions, 4)

    def v6(x):
        return _in_ranges(x, blocks, 6) & ~_in_ranges(x, exceptions, 6)

    def test(x):
        literal = F.when(F.contains(x, F.lit(":")), let(ipv6_hex(x), v6)).otherwise(let(ipv4_number(x), v4))
        return x.rlike(r"^[0-9.]+$|:") & F.coalesce(literal, F.lit(False))

    return let(h, test)


def has_non_public_host(url: Column) -> Column:
    """``is_non_public`` of the host of a URL; links to host names are settled by one pattern."""
    literal = _SERVER + r"(?:\[|[0-9.]+(?:[:/?#]|$))"
    return let(url, lambda u: F.when(u.rlike(literal), is_non_public(host(u))).otherwise(F.lit(False)))


def is_vod(url: Column, hosts: Sequence[str] = tuple(rules.VOD_HOSTS)) -> Column:
    """Host part contains an entry; entries with a slash are looked for in host part and path."""
    plain, with_path = [v for v in hosts if "/" not in v], [v for v in hosts if "/" in v]

    def test(u):
        hit = contains_any(F.lower(netloc(u)), plain)
        return hit | contains_any(F.lower(F.concat(netloc(u), path(u))), with_path) if with_path else hit

    return let(url, test)


def is_known_direct(
    url: Column,
    keys: Sequence[str] = tuple(rules.DIRECT_KEYS),
    ipv6_prefixes: Sequence[str] = tuple(rules.DIRECT_IPV6_PREFIXES),
) -> Column:
    """Host part equal to a key, or with a dot before one, or an IPv6 literal of a known carrier."""
    server = F.lower(F.regexp_extract(url, r"^(?:.*?://)?([^?/]*)", 1))
    key = any_of(keys)
    return server.rlike(rf"^{key}$|\.{key}|^\[{any_of(ipv6_prefixes)}")


def is_ipv6(url: Column) -> Column:
    return F.regexp_replace(netloc(url), r"^.*@", "").startswith("[")


def domain_score(
    url: Column,
    allow: Sequence[str] = tuple(rules.ALLOW_DOMAINS),
    deny: Sequence[str] = tuple(rules.DENY_DOMAINS),
) -> Column:
    def score(d):
        return (
            F.when(contains_any(d, deny), 0)
            .when(contains_any(d, allow), 100)
            .when(F.contains(d, F.lit("github")), 70)
            .when(contains_any(d, rules.OBJECT_STORE_MARKS), 80)
            .when(contains_any(d, rules.CDN_MARKS), 60)
            .otherwise(30)
            .cast("bigint")
        )

    return let(F.lower(netloc(url)), score)


# --- playlist likeness --------------------------------------------------------------------


def has_credential(url: Column) -> Column:
    return contains_any(F.lower(url), rules.CREDENTIAL_PARAMS)


def has_playlist_port(url: Column) -> Column:
    number = F.regexp_extract(url, r":(\d{4,5})", 1).try_cast("int")
    return F.coalesce(
        number.between(1000, 99999) & (F.lower(url).rlike("live|stream") | (F.length(path(url)) > 5)),
        F.lit(False),
    )


def is_playlist(url: Column) -> Column:
    """Whether the URL may be a playlist file or route."""
    rejected = r"(?i)\.(?:" + "|".join(rules.REJECTED_EXTENSIONS) + ")$"

    def by_path(u, p):
        low = F.lower(p)
        return (
            F.when(suffix(p).rlike(rejected), False)
            .when(low.rlike(r"\.m3u8?$"), ~stem(p).rlike(r"(?Us)^(?:\d+|.?)$"))
            .when(low.endswith(".txt"), True)
            .when(contains_any(low, rules.PLAYLIST_ROUTES), True)
            .when(contains_any(F.lower(u), rules.PLAYLIST_TYPE_PARAMS), True)
            .otherwise(has_playlist_port(u))
        )

    return let(url, lambda u: ~has_credential(u) & let(path(u), lambda p: by_path(u, p)))


def is_playlist_legacy(url: Column) -> Column:
    def test(u):
        low = F.lower(u)
        segment = path(u).endswith(".m3u8") & stem(path(u)).rlike(r"(?Us)^(?:\d+|.{0,10})$")
        secret = contains_any(low, rules.LEGACY_CREDENTIAL_PARAMS)
        return ~secret & ~segment & contains_any(low, rules.LEGACY_PLAYLIST_MARKS)

    return let(url, test)


def mirrors(url: Column) -> Column:
    """Ordered mirror candidates of a code-hosting URL, the URL itself first."""
    raw, page, origin = rules.HOSTED_RAW, rules.HOSTED_PAGE, rules.HOSTED_ORIGIN
    targets = [t.replace("{origin}", origin) for t in rules.MIRRORS]

    def rewrite(pattern, target):
        return F.regexp_replace(url, pattern + "[\\s\\S]*$", target)

    return (
        F.when(url.rlike(raw), F.array(url, *[rewrite(raw, t) for t in targets]))
        .when(url.rlike(page), F.array(url, *[rewrite(page, t) for t in [origin] + targets]))
        .otherwise(F.array(url))
    )


def discovered_name(url: Column, domain: Column) -> Column:
    """Name of a discovered link: its file stem with the domain, or only the domain."""
    def name(s):
        weak = s.rlike(r"(?U)^\d+$") | (F.length(s) <= 3)
        return F.when(weak, domain).otherwise(F.concat(s, F.lit(" ("), domain, F.lit(")")))

    return let(stem(path(url)), name)


def clean_link(c: Column) -> Column:
    return F.regexp_replace(c, r"['\")> \t]+$", "")


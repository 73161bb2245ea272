"""DuckDB expressions used by the oracle statements."""

from __future__ import annotations

import re

SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(ws) -> str:
    """Literal alternation as a quoted RE2 pattern."""
    return quote("|".join(re.escape(w).replace("\\ ", " ").replace("\\#", "#") for w in ws))


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def split_lines(c: str) -> str:
    return f"regexp_split_to_array({c}, '{BREAKS}')"


def after_comma(c: str) -> str:
    return f"substring({c}, strpos({c}, ',') + 1)"


def scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def netloc(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def path(u: str) -> str:
    return f"regexp_replace(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"


def query(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1)"


def host(u: str) -> str:
    n = f"regexp_replace({netloc(u)}, '^.*@', '')"
    return (f"lower(CASE WHEN {n} LIKE '%[%' THEN regexp_extract({n}, '\\[([^\\]]*)', 1) "
            f"ELSE split_part({n}, ':', 1) END)")


def fp(u: str) -> str:
    return f"substring(md5(concat(lower({netloc(u)}), {path(u)})), 1, 16)"


def segment(u: str) -> str:
    return f"regexp_extract(regexp_replace({path(u)}, '(/+[.]?)+$', ''), '([^/]*)$', 1)"


def stem(u: str) -> str:
    return f"regexp_replace({segment(u)}, '^(.+)[.][^.]+$', '\\1')"


def suffix(u: str) -> str:
    return f"regexp_extract({segment(u)}, '^.+([.][^.]+)$', 1)"


def private_v4(h: str) -> str:
    """Dotted host inside a non-public block, by octets."""
    a, b, c = (f"CAST(split_part({h}, '.', {i}) AS INTEGER)" for i in (1, 2, 3))
    return (
        f"(CASE WHEN regexp_matches({h}, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') THEN "
        f"{a} IN (0, 10, 127) OR {a} >= 240 OR ({a} = 169 AND {b} = 254) OR ({a} = 172 AND {b} BETWEEN 16 AND 31) "
        f"OR ({a} = 192 AND {b} = 168) OR ({a} = 192 AND {b} = 0 AND {c} IN (0, 2)) OR ({a} = 198 AND {b} IN (18, 19)) "
        f"OR ({a} = 198 AND {b} = 51 AND {c} = 100) OR ({a} = 203 AND {b} = 0 AND {c} = 113) ELSE false END)"
    )


def private(u: str) -> str:
    return f"({private_v4(host(u))} OR {host(u)} LIKE 'fe80:%')"


def playlist(u: str) -> str:
    """The playlist test as one nested CASE."""
    low, p = f"lower({u})", f"lower({path(u)})"
    short = f"(regexp_matches({stem(u)}, '^[0-9]+$') OR length({stem(u)}) <= 1)"
    port = f"TRY_CAST(regexp_extract({u}, ':([0-9]{{4,5}})', 1) AS INTEGER)"
    return (
        f"(CASE WHEN regexp_matches({low}, 'userid=|sign=|auth_token=|token=|session=|expire=|key=|nonce=') THEN false "
        f"WHEN regexp_matches(lower({suffix(u)}), '^[.](js|css|jpg|jpeg|png|gif|svg|ico|webp|woff|woff2|ttf|eot|mp4|mp3|avi|mkv|zip|rar|tar|gz|pdf|doc|docx|xls|xlsx|json|xml|yml|yaml|md)$') THEN false "
        f"WHEN {p} LIKE '%.m3u8' OR {p} LIKE '%.m3u' THEN NOT {short} WHEN {p} LIKE '%.txt' THEN true "
        f"WHEN regexp_matches({p}, '/live/|/tv/|/stream/|/playlist/|/iptv/|/channels/|/feed') THEN true "
        f"WHEN regexp_matches({low}, 'php[?]type=m3u|/playlist[?]|[?]type=m3u') THEN true "
        f"ELSE coalesce({port} BETWEEN 1000 AND 99999 AND (regexp_matches({low}, 'live|stream') OR length({path(u)}) > 5), false) END)"
    )


def domain_score(u: str) -> str:
    d = f"lower({netloc(u)})"
    return (
        f"CAST(CASE WHEN regexp_matches({d}, 'shortlink|bit[.]ly|tinyurl|adf[.]ly|link-short|goo[.]gl') THEN 0 "
        f"WHEN regexp_matches({d}, 'github[.]com|githubusercontent[.]com|gitlab[.]com|gitee[.]com') THEN 100 "
        f"WHEN {d} LIKE '%github%' THEN 70 WHEN regexp_matches({d}, '[.]oss-|[.]cos[.]|[.]s3[.]|cosv|[.]obj') THEN 80 "
        f"WHEN regexp_matches({d}, 'cfcdn|jsdelivr|cdnjs|unpkg|fastly') THEN 60 ELSE 30 END AS BIGINT)"
    )

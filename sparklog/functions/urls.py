"""URL policy: which addresses a webhook may name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklog import constants as C
from sparklog.functions.text import not_blank

_IPV4 = r"\A\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\z"
_MAPPED = r"\A(?:0*:)*:?ffff:(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\z"
_BLOCKED = (
    r"\A(?:127\.|10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.|[0:]*:0*1\z|fe[89ab][0-9a-f]:|f[cd])"
)
_NUMBER = r"\A\d{1,10}\z"
_HEX_MAPPED = r"\A(?:0*:)*:?ffff:([0-9a-f]{1,4}):([0-9a-f]{1,4})\z"


def _dotted(number: Column) -> Column:
    """Four bytes as dotted text, null for a number beyond them."""
    octets = [(F.shiftright(number, bits) % 256).cast("string") for bits in (24, 16, 8, 0)]
    return F.when(number.between(0, (1 << 32) - 1), F.concat_ws(".", *octets))


def literal_address(host: Column) -> Column:
    """Normal form of a literal IPv4 or bracketed IPv6 host, null for a name."""
    v6 = F.regexp_extract(F.lower(host), r"\A\[([0-9a-f:.]+)", 1)
    mapped = F.regexp_extract(v6, _MAPPED, 1)
    high, low = (F.conv(F.regexp_extract(v6, _HEX_MAPPED, i), 16, 10).try_cast("bigint") for i in (1, 2))
    text = (
        F.when(host.rlike(_IPV4), host)
        .when(host.rlike(_NUMBER), _dotted(host.try_cast("bigint")))
        .when(mapped != "", mapped)
        .when(v6.rlike(_HEX_MAPPED), _dotted(high * (1 << 16) + low))
        .when(v6 != "", v6)
    )
    return F.regexp_replace(text, r"(^|[.:])0+([0-9a-f])", "$1$2")


def is_blocked_address(ip: Column) -> Column:
    """Loopback, private, link-local and unique-local ranges."""
    return ip.rlike(_BLOCKED)


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def url_error(url: Column) -> Column:
    """The reason why a URL is refused, null if it is allowed. Names are not resolved here."""
    scheme = F.try_parse_url(url, F.lit("PROTOCOL"))
    host = url_host(url)
    address = literal_address(host)
    malformed = scheme.isNull() & F.try_parse_url(url, F.lit("PATH")).isNull()
    return (
        F.when(~not_blank(url), C.URL_REQUIRED)
        .when(malformed, C.URL_MALFORMED)
        .when(scheme.isNull() | ~F.lower(scheme).isin("http", "https"), C.URL_SCHEME)
        .when(host.isNull(), C.URL_NO_HOST)
        .when(F.lower(host).isin(*C.BLOCKED_HOSTS), C.URL_HOST_BLOCKED)
        .when(is_blocked_address(address), F.concat(F.lit(C.URL_IP_BLOCKED), address))
    )

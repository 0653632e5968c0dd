"""Column functions over addresses and page texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of three-label sites, page markers, login paths.
THREE_LABELS = "co.uk org.uk gov.uk ac.uk com.au net.au org.au com.br com.tr co.jp co.nz co.za com.ua co.in com.mx com.ar com.cn com.tw".split()
ANTIBOT = ["just a moment", "checking your browser", "attention required", "cf-browser-verification", "cf_chl_", "challenge-platform", "cdn-cgi/challenge", "ddos-guard"]
PAYWALL = ["платн", "подписк", "оформите", "продолжение доступно после", "buy chapter", "premium access", "покупк"]
LOGIN = "(?i)/(?:login|signin|sign-in|log-in|enter|vhod|auth|register|registration)(?:/|\\?.*)?$"
ANTIBOT_CHARS, PAYWALL_CHARS = 1000, 1500


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def site_of(host: Column) -> Column:
    """The registrable name of a host; null for fewer than two labels."""
    labels = F.filter(F.split(F.lower(host), "\\."), lambda x: x != "")
    last = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    n = F.size(labels)
    return F.when(n == 2, last(2)).when(n > 2, F.when(last(2).isin(THREE_LABELS), last(3)).otherwise(last(2)))


def canonical(url: Column) -> Column:
    """R1 for ASCII hosts: scheme and host lowered, fragment and default port dropped, a path at least '/'; else null."""
    plain = F.trim(url)
    part = lambda k: F.regexp_extract(plain, "^((?i)https?)://([^/?#@:\\s]+)(?::(\\d{1,5}))?(/[^?#\\s]*)?(?:\\?([^#\\s]*))?(?:#\\S*)?$", k)
    scheme, port = F.lower(part(1)), part(3)
    keeps = (port != "") & ~((scheme == "http") & (port == "80")) & ~((scheme == "https") & (port == "443"))
    query = F.when(F.contains(F.substring_index(plain, "#", 1), F.lit("?")), F.concat(F.lit("?"), part(5))).otherwise("")
    path = F.when(part(4) == "", "/").otherwise(part(4))
    fits = (scheme != "") & (F.coalesce(port.try_cast("int"), F.lit(0)) <= 65535)
    return F.when(fits, F.concat(scheme, F.lit("://"), F.lower(part(2)), F.when(keeps, F.concat(F.lit(":"), port)).otherwise(""), path, query))


def origin(url: Column) -> Column:
    """Scheme and authority."""
    return F.nullif(F.regexp_extract(url, "^(https?://[^/?#]+)", 1), F.lit(""))


def _up(digits: Column) -> Column:
    """The number one up; null where it is the largest or too large."""
    n = digits.try_cast("bigint")
    return F.when(n < (1 << 63) - 1, (n + 1).cast("string"))


#: A query's first parameter that has the number of a page or chapter.
NUMBERED = "^([^?#]*\\?(?:[^#]*?&)??(?:page|chapter|glava|p)=)(\\d+)((?:&[^#]*)?)(?:#.*)?$"


def next_in_query(url: Column) -> Column:
    """R5, first rule: the first page or chapter number of the query one up, all else unchanged."""
    found = lambda k: F.regexp_extract(url, NUMBERED, k)
    return F.when(found(2) != "", F.concat(found(1), _up(found(2)), found(3)))


def next_in_path(url: Column) -> Column:
    """R5, second rule: the last path segment that is a number, or a chapter word with one, one up."""
    segments = F.split(F.regexp_extract(url, "^https?://[^/?#]+(/[^?#]*)", 1), "/")
    query = F.regexp_extract(url, "(\\?[^#]*)", 1)
    chapter = "^(|(?i:chapter|glava|ch)[-_.]?)(\\d+)$"
    bumped = F.transform(segments, lambda s: F.concat(F.regexp_extract(s, chapter, 1), _up(F.regexp_extract(s, chapter, 2))))
    places = F.filter(F.transform(bumped, lambda b, i: F.when(b.isNotNull(), i)), lambda i: i.isNotNull())
    last = F.array_max(places)
    path = F.array_join(F.transform(segments, lambda s, i: F.when(i == last, bumped[last]).otherwise(s)), "/")
    return F.when(last.isNotNull(), F.concat(origin(url), path, query))


def numeric_next(url: Column) -> Column:
    """The address of the next number."""
    return canonical(F.when(url.rlike(NUMBERED), next_in_query(url)).otherwise(next_in_path(url)))


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def is_antibot(title: Column, text: Column) -> Column:
    """a short page with a marker of a robot check."""
    return (F.length(text) <= ANTIBOT_CHARS) & _any(F.lower(F.concat(title, F.lit("\n"), text)), ANTIBOT)


def is_paywall(text: Column) -> Column:
    """a short text that speaks of paying."""
    return (F.length(text) <= PAYWALL_CHARS) & _any(F.lower(text), PAYWALL)


def is_login(url: Column) -> Column:
    """F5, by address: the path of a login page."""
    return F.concat(F.lit("/"), F.regexp_extract(url, "^https?://[^/?#]+([^?#]*)", 1)).rlike(LOGIN)


# Hosts that are one site.
MIRRORS = ["litmir.club", "litmir.me", "litmir.net"]
PAGE_STEP = "(?i)/p(?:age)?/\\d+$"


def _path(url: Column) -> Column:
    return F.rtrim(F.regexp_extract(url, "^https?://[^/?#]+([^?#]*)", 1), F.lit("/"))


def is_page_turn(source: Column, target: Column, labelled: Column) -> Column:
    """F8: whether a link turns the pages of one list rather than leads to a chapter."""
    a, b = _path(source), _path(target)
    page = lambda u: F.nullif(F.regexp_extract(u, "[?&](?:page|p)=(\\d+)", 1), F.lit(""))
    deeper = F.startswith(b, F.concat(a, F.lit("/")))
    rest = F.substr(b, F.length(a) + 1)
    parent = lambda p: F.regexp_replace(p, "/[^/]*$", "")
    steps = a.rlike(PAGE_STEP) & b.rlike(PAGE_STEP) & (parent(a) == parent(b))
    moved = ~labelled & page(target).isNotNull() & ~page(target).eqNullSafe(page(source))
    return F.when(a == b, moved).when(deeper, rest.rlike("(?i)^/p(?:age)?/\\d+$")).otherwise(steps)


def family(host: Column) -> Column:
    """what a redirect has to keep: the site, mirrors taken as one."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(host), "^www\\.", ""), "^m\\.", "")
    return F.when(bare.isin(MIRRORS), "litmir").otherwise(F.coalesce(site_of(host), bare))


def allows_redirect(source: Column, target: Column) -> Column:
    """https on both sides, one family, and on book pages the same book."""
    book = lambda u: F.nullif(F.regexp_extract(u, "[?&]b=([^&#]+)", 1), F.lit(""))
    on_book = _path(source).isin("/br", "/bd") & _path(target).isin("/br", "/bd") & book(source).isNotNull()
    secure = F.startswith(F.lower(source), F.lit("https://")) & F.startswith(F.lower(target), F.lit("https://"))
    return secure & (family(host_of(source)) == family(host_of(target))) & (~on_book | book(target).eqNullSafe(book(source)))


def reason_of(status: Column) -> Column:
    """The typed reason of an HTTP status; null for one that is none."""
    named = F.when(status.isin(401, 403, 404), F.concat(F.lit("HTTP_"), status))
    return F.when(status >= 400, F.coalesce(named, F.lit("NETWORK")))


def retryable(status: Column) -> Column:
    """Whether to ask again."""
    return F.coalesce((status >= 500) | (status == 403), F.lit(False))

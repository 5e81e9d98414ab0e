"""Scalar normalisers, all built-in expressions that stay in code generation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex


def email(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "^mailto:", ""), "[?#].*$", "")


def is_generic(address: Column, mailboxes: Sequence[str] = lex.GENERIC_MAILBOXES) -> Column:
    local = F.substring_index(email(address), "@", 1)
    return local.isin(*mailboxes) | local.rlike(lex.GENERIC_PREFIX)


def phone(c: Column) -> Column:
    return F.concat(F.when(F.startswith(F.trim(c), F.lit("+")), "+").otherwise(""), F.regexp_replace(c, "[^0-9]", ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


#: Characters that a browser escapes in a path and in a query.
_ODD_IN_PATH = "[^\\x21-\\x7E]|[\"<>^`{}]"
_ODD_IN_QUERY = "[^\\x21-\\x7E]|[\"'<>]"
_NO_HOST = "[\\x00-\\x20#/:<>?@\\[\\]\\\\^|%\\x7F]"


def _escaped(c: Column, odd: str) -> Column:
    one = lambda x: F.when(x == " ", "%20").when(x.rlike(odd), F.url_encode(x)).otherwise(x)
    return F.when(c.rlike(odd), F.array_join(F.transform(F.split(c, ""), one), "")).otherwise(c)


def _without_dots(p: Column) -> Column:
    """A path with ``.`` and ``..`` applied, as one fold over its segments."""

    def fold(segments: Column) -> Column:
        rest = F.transform(F.slice(segments, F.lit(2), F.size(segments)), lambda s, i: F.struct(s.alias("text"), (i == F.size(segments) - 2).alias("last")))

        def step(done: Column, s: Column) -> Column:
            name, end = F.replace(F.lower(s["text"]), F.lit("%2e"), F.lit(".")), F.when(s["last"], F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
            up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))
            return F.when(name == ".", F.concat(done, end)).when(name == "..", F.concat(up, end)).otherwise(F.concat(done, F.array(s["text"])))

        return F.array_join(F.aggregate(rest, F.array(F.lit("")), step), "/")

    return F.when(p.rlike("(?i)/(\\.|%2e){1,2}(/|$)"), let(F.split(p, "/"), fold)).otherwise(p)


def _host(c: Column) -> Column:
    """In lower case, other than Latin letters in their ASCII form; null if there is none or it holds what no host may."""
    low = F.lower(c)
    name = F.when(low.rlike("[^\\x00-\\x7F]"), F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), low))).otherwise(low)
    return let(name, lambda h: F.when((h != "") & (~h.rlike(_NO_HOST) | h.rlike("^\\[[0-9a-f:.]+\\]$")), h))


def _absolute(c: Column) -> Column:
    """An address with http or https, as a browser reads it, without its fragment; null if a browser would not."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", ""), "[\\t\\r\\n]", ""), "(?s)#.*$", "")

    def cut(x: Column) -> Column:
        rest = F.regexp_replace(x, "(?is)^https?:[/\\\\]*[^/\\\\?]*", "")
        where = F.substring_index(rest, "?", 1)
        return F.struct(
            F.lower(F.regexp_extract(x, "(?i)^(https?):", 1)).alias("scheme"),
            F.regexp_extract(x, "(?is)^https?:[/\\\\]*([^/\\\\?]*)", 1).alias("authority"),
            F.when(where == "", "/").otherwise(F.translate(where, "\\", "/")).alias("path"),
            F.substring(rest, F.length(where) + 1, F.length(rest)).alias("query"),
        )

    def split(p: Column) -> Column:
        server = F.regexp_replace(p["authority"], "^.*@", "")
        number = F.regexp_replace(F.regexp_extract(server, ":([0-9]*)$", 1), "^0+(?=.)", "")
        usual = F.when(p["scheme"] == "http", "80").otherwise("443")
        return F.struct(
            p["scheme"].alias("scheme"), F.regexp_extract(p["authority"], "^.*@", 0).alias("user"), _host(F.regexp_replace(server, ":[0-9]*$", "")).alias("host"),
            F.when((number == "") | (number == usual), "").otherwise(F.concat(F.lit(":"), number)).alias("port"), p["path"].alias("path"), p["query"].alias("query"),
        )

    def joined(p: Column) -> Column:
        fits = (F.length(p["port"]) < 6) | ((F.length(p["port"]) == 6) & (p["port"] <= ":65535"))
        return F.when(
            p["host"].isNotNull() & (p["scheme"] != "") & fits,
            F.concat(p["scheme"], F.lit("://"), p["user"], p["host"], p["port"], _escaped(_without_dots(p["path"]), _ODD_IN_PATH), _escaped(p["query"], _ODD_IN_QUERY)),
        )

    return let(let(let(clean, cut), split), joined)


def url(c: Column) -> Column:
    """An address as a browser reads it: https by default, host in lower case and ASCII, usual port, dots and fragment gone, odd characters escaped; null if it is none."""
    t = F.trim(c)
    return F.when(t != "", _absolute(F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))))


def resolve(href: Column, base: Column) -> Column:
    """The address that ``href`` means on the page ``base``, in the form of ``url``; null for other schemes, such as mailto."""
    h = F.regexp_replace(href, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")
    plain = F.regexp_replace(base, "(?s)[?#].*$", "")
    folder = F.regexp_replace(F.regexp_replace(plain, "^([a-zA-Z]+://[^/]*)$", "$1/"), "(?<=/)[^/]*$", "")
    return _absolute(
        F.when(h.rlike("(?i)^https?:"), h)
        .when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None))
        .when(h.rlike("^[/\\\\]{2}"), F.concat(F.regexp_extract(base, "^[a-zA-Z]+:", 0), h))
        .when(h.rlike("^[/\\\\]"), F.concat(F.regexp_extract(base, "^[a-zA-Z]+://[^/?#]*", 0), h))
        .when(h.rlike("^[?]"), F.concat(plain, h))
        .when(h.rlike("^(#|$)"), base)
        .otherwise(F.concat(folder, h))
    )


def domain(c: Column) -> Column:
    host = F.lower(F.regexp_extract(c, "(?i)^https?://([^/?#:]+)", 1))
    return F.when(host != "", F.regexp_replace(host, "^www\\.", ""))


def path(c: Column) -> Column:
    return F.regexp_extract(c, "(?i)^https?://[^/?#]+([^?#]*)", 1)


def username(c: Column) -> Column:
    parts = F.filter(F.split(path(c), "/"), lambda x: x != "")
    return F.regexp_replace(F.try_element_at(parts, F.lit(-1)), "^@", "")


def truncate(c: Column, n: int) -> Column:
    t = F.trim(F.regexp_replace(c, "[ \\t\\r\\n\\f]+", " "))
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n - 1)), F.lit("…"))).otherwise(t)


def fingerprint(c: Column) -> Column:
    return F.sha2(F.lower(c), 256)


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over code points."""
    codes = F.transform(F.split(c, ""), F.ascii)
    step = lambda h, x: h.bitwiseXOR(x.cast("long")) * F.lit(16777619).cast("long") % F.lit(4294967296)
    return F.aggregate(F.filter(codes, lambda x: x > 0), F.lit(2166136261).cast("long"), step)


def age_days(published: Column, run_ts: Column) -> Column:
    """Null where it is not known when; what is still to come has no age."""
    age = (F.unix_micros(run_ts.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / F.lit(86400000000.0)
    return F.when(age > 0, age).when(age <= 0, 0.0)


def timestamp(c: Column) -> Column:
    """ISO, compact and RFC-822 dates; null for anything else."""
    plain = F.regexp_replace(c, "^[A-Za-z]{3}, ", "")
    forms = ["yyyyMMdd'T'HHmmssX", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z"]
    return F.coalesce(F.try_to_timestamp(c), *(F.try_to_timestamp(plain, F.lit(f)) for f in forms))


def compact_date(c: Column) -> Column:
    """yyyyMMddTHHmmssZ as an ISO date; anything else as it is."""
    return F.regexp_replace(c, "^(\\d{4})(\\d{2})(\\d{2})T(\\d{2})(\\d{2})(\\d{2})Z$", "$1-$2-$3T$4:$5:$6Z")


def slug(*parts: Column) -> Column:
    """Query id: parts joined by '-', other characters than letters and digits become '-'."""
    joined = F.lower(F.concat_ws("-", *parts))
    return F.left(F.regexp_replace(F.regexp_replace(joined, "[^a-zа-яё0-9]+", "-"), "^-|-$", ""), F.lit(120))


def initials(c: Column) -> Column:
    words = F.filter(F.split(F.trim(c), " +"), lambda x: x != "")
    return F.array_join(F.transform(F.slice(words, 1, 2), lambda x: F.upper(F.left(x, F.lit(1)))), "")


def without_operators(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "site:[^ )]+", " "), "[\"()]+", " "))


def platform(address: Column, registry=lex.PLATFORM_HOSTS) -> Column:
    """The platform whose host the URL's host is, or is a subdomain of: the host's last labels, looked up in a map."""
    known = {h: name for name, hosts in registry for h in hosts}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    labels = sorted({h.count(".") + 1 for h in known}, reverse=True)
    return let(domain(address), lambda host: F.coalesce(*(F.try_element_at(table, F.substring_index(host, ".", -n)) for n in labels)))


def social_url(c: Column) -> Column:
    return let(url(F.regexp_replace(c, "[.,;:!?)\\]]+$", "")), lambda u: F.when(platform(u).isNotNull(), u))


def profile_kind(address: Column, name: Column, official: Column, where: Column | None = None) -> Column:
    """``where``: the address's platform, if it is known already."""
    p, where = path(address), platform(address) if where is None else where
    return (
        F.when((where == "telegram") & p.rlike("^/(joinchat|\\+)"), "group")
        .when((where == "telegram") & p.rlike("^/s/"), "channel")
        .when((where == "telegram") & F.lower(name).rlike("bot$"), "bot")
        .when(where.isin("youtube", "rutube"), "channel")
        .when(official, "company")
        .otherwise("unknown")
    )

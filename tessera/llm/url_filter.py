"""URL filters: host/path rules where the longest wins, then pattern rules indexed by their rarest literal token.

DataFrame functions only. A pattern rule is filed under whichever of its literal tokens occurs in the fewest urls of the
whole table; a url's tokens fetch the rules filed under them, and only those run their regular expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class PathRule:
    """Fits ``host`` and its subdomains where the url's path starts with ``path``."""

    host: str
    path: str
    verdict: str


@dataclass(frozen=True)
class PatternRule:
    """Blocks lower-cased urls that match; each of ``tokens`` stands in every match, between characters other than a-z and 0-9."""

    name: str
    pattern: str
    tokens: tuple[str, ...]


PATH_RULES = (
    PathRule("org", "/", "allow"),
    PathRule("example.org", "/es/", "block"),
    PathRule("example.org", "/en/1", "block"),
    PathRule("com", "/fr/", "allow"),
    PathRule("com", "/de/", "block"),
)
#: No backslashes or look-around: the same text in Spark and in other engines.
PATTERN_RULES = (
    PatternRule("ad-host", "://([a-z0-9-]+[.])*ads-track[.]", ("ads", "track")),
    PatternRule("ad-server", "://([a-z0-9-]+[.])*(adserver|doubleclick)[.]", ()),
    PatternRule("campaign", "[?&]utm_source=spam(&|#|$)", ("utm", "source", "spam")),
    PatternRule("sign-in", "://[^?#]*/(user/)?login([/?#]|$)", ("login",)),
    PatternRule("cart", "://[^?#]*/shop/cart([/?#]|$)", ("shop", "cart")),
    PatternRule("session", "[?&]phpsessid=[0-9a-f]+", ("phpsessid",)),
    PatternRule("casino", "://([a-z0-9-]+[.])*casino[.]", ("casino",)),
    PatternRule("mobile-print", "://m[.][^?#]*/print([/?#]|$)", ("m", "print")),
    PatternRule("tag-feed", "/tag/[^?#]*/feed/?([?#]|$)", ("tag", "feed")),
)
BUCKETS = 64


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)).otherwise("")


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.translate(url, UPPER, LOWER), "[^a-z0-9]+"))


def rarest_tokens(urls: DataFrame, rules: tuple[PatternRule, ...]) -> dict[str, str]:
    """Each rule's literal token that the fewest rows of ``urls(url)`` hold (ties: by text); at most one row a token comes back."""
    known = sorted({t for r in rules for t in r.tokens})
    counts = dict.fromkeys(known, 0)
    if known:
        found = urls.select(F.explode(F.filter(url_tokens(F.col("url")), lambda t: t.isin(known))).alias("token")).groupBy("token").count()
        counts |= {r["token"]: r["count"] for r in found.collect()}
    return {r.name: min(r.tokens, key=lambda t: (counts[t], t)) for r in rules if r.tokens}


def _pattern_hit(url: Column, rules: tuple[PatternRule, ...], filed: dict[str, str]) -> Column:
    """The smallest name among the candidate rules that match, else null."""
    shelf: list[list[PatternRule]] = [[] for _ in range(BUCKETS)]
    for r in rules:
        if r.name in filed:
            shelf[sum(filed[r.name].encode()) % BUCKETS].append(r)

    def packed(rs: list[PatternRule]) -> Column:
        made = [F.struct(F.lit(filed.get(r.name, "")).alias("token"), F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern")) for r in rs]
        return F.array(*made) if made else F.expr("array()").cast("array<struct<token:string,name:string,pattern:string>>")

    low = F.translate(url, UPPER, LOWER)
    index = F.array(*[packed(rs) for rs in shelf])
    # A token's bucket: the sum of its characters, as above.
    bucket = lambda t: F.aggregate(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.ascii(F.substring(t, i, F.lit(1)))), F.lit(0), lambda a, b: a + b) % BUCKETS + 1
    words = F.filter(url_tokens(url), lambda t: F.length(t) > 0)
    fetched = F.flatten(F.transform(words, lambda t: F.filter(F.element_at(index, bucket(t)), lambda r: r["token"] == t)))
    always = packed([r for r in rules if r.name not in filed])
    matching = F.filter(F.concat(fetched, always), lambda r: F.rlike(low, r["pattern"]))
    return F.array_min(F.transform(matching, lambda r: r["name"]))


def filter_urls(pages: DataFrame, path_rules: tuple[PathRule, ...] = PATH_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern`` for every row of ``pages(page_id, url)``.

    ``rule``: the longest fitting host/path rule (equally long: the first by text), else null; its verdict stands. Without one, a matching
    pattern rule blocks and ``pattern`` names it (null otherwise), and everything else is allowed. Null urls and urls
    without ``://``: empty host and path, allowed unless a pattern matches. Repeated rows and null ids are kept, an empty
    table gives no rows, other columns are ignored. The rule lists are parameters of fixed size; rows never move.
    """
    urls = pages.select("page_id", "url")
    filed = rarest_tokens(urls, pattern_rules)
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(path_rules, key=lambda r: (len(r.host + r.path), r.host + r.path), reverse=True)[::-1]:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    out = urls.withColumn("host", F.coalesce(host_of(url), F.lit(""))).withColumn("path", F.coalesce(path_of(url), F.lit("")))
    out = out.withColumn("rule", rule).withColumn("own", verdict)
    out = out.withColumn("pattern", F.when(F.col("rule").isNull(), _pattern_hit(F.coalesce(url, F.lit("")), pattern_rules, filed)))
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")).alias("verdict"), "pattern")


def oracle(path_rules: tuple[PathRule, ...] = PATH_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> str:
    """The same rows in DuckDB's SQL, every pattern run on every url."""
    longest = sorted(path_rules, key=lambda r: (-len(r.host + r.path), r.host + r.path))
    fits = lambda r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
    rule = " ".join(f"when {fits(r)} then '{r.host}{r.path}'" for r in longest)
    own = " ".join(f"when {fits(r)} then '{r.verdict}'" for r in longest)
    low = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    named = " ".join(f"when regexp_matches({low}, '{r.pattern}') then '{r.name}'" for r in sorted(pattern_rules, key=lambda r: r.name))
    return f"""
with cut as (
  select page_id, url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) end as rest from pages
), parts as (
  select page_id, url,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from cut
), ruled as (
  select *, case {rule} end as rule, case {own} end as own from parts
), matched as (
  select *, case when rule is null then case {named} end end as pattern from ruled
)
select page_id, host, path, rule, coalesce(own, case when pattern is not null then 'block' else 'allow' end) as verdict, pattern
from matched"""

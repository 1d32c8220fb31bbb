"""URL filters: pattern rules found by their rarest literal token; DataFrame functions only.

Every rule has literal tokens, runs of letters and digits that any URL it fits must hold. A rule is indexed by the one of
its tokens that the fewest URLs hold. A URL's tokens fetch the rules indexed by them, and only those run their regular
expressions. Host rules (host, path prefix) are rules of this kind with a decision by the longest; other patterns
decide where no host rule fits, and what no rule fits gets the default.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table


@dataclass(frozen=True)
class Rule:
    """``name`` as shown, ``verdict``, a Java regular expression over ``host + path``, its literal tokens, and a rank: the highest wins, ties go to the smaller name."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    shown: bool = True


def host_rule(verdict: str, rule: str) -> Rule:
    """``net/``, ``example.com/de/``: the host and all subdomains, where the path starts with the rule's."""
    host, slash, path = rule.partition("/")
    path = slash + path
    quote = lambda s: "\\Q" + s + "\\E" if s else ""
    # of the path only tokens that its end doesn't cut short must stand in a URL as they are
    inner = re.findall(r"[a-z0-9]+(?=[^A-Za-z0-9])", path) if path else []
    return Rule(rule, verdict, f"^(?:[^/]*\\.)?{quote(host)}{'(?=/)' if path else '(?=/|$)'}{quote(path)}", (*re.findall("[a-z0-9]+", host.lower()), *inner), 1_000_000 + len(rule))


def pattern_rule(name: str, verdict: str, pattern: str, *tokens: str) -> Rule:
    """A regular expression over host and path, with the literal tokens that it needs."""
    return Rule(name, verdict, pattern, tokens, 0, False)


#: The rules of the query.
HOST_RULES = (host_rule("block", "net/"), host_rule("allow", "example.net/en/"), host_rule("block", "example.com/de/"), host_rule("allow", "org/fr/"))
#: Pages that hold no prose; they decide only where no host rule fits.
PATTERN_RULES = (
    pattern_rule("login pages", "block", "/login(?:/|\\.|$)", "login"),
    pattern_rule("shopping carts", "block", "/cart(?:/|\\.|$)", "cart"),
    pattern_rule("zip archives", "block", "\\.zip$", "zip"),
    pattern_rule("advert servers", "block", "^ads?[0-9]*\\.[^/]*/banner", "banner"),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty if there is none."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    at = F.instr(rest, "/")
    return F.coalesce(F.when(at > 0, F.substring(rest, at, F.length(rest))).otherwise(""), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.split(F.translate(F.concat(host, F.lit("/"), path), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+"))


def rarest_tokens(parts: DataFrame, rules: list[Rule]) -> dict[str, str]:
    """Rule name -> the token of it that the fewest URLs hold (ties: the smaller token), counted over all rows."""
    every = sorted({t for r in rules for t in r.tokens})
    names = parts.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(every)), "array<string>")).alias("token"))
    held = parts.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token")).join(F.broadcast(names), "token")  # as many rows as the caller's rules have tokens
    counts = {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}
    return {r.name: min(r.tokens, key=lambda t: (counts.get(t, 0), t)) for r in rules if r.tokens}


_ENTRY = "struct<token:string,rank:bigint,name:string,verdict:string,pattern:string,shown:boolean>"


def _entry(r: Rule, token: str | None) -> dict:
    return {"token": token, "rank": r.rank, "name": r.name, "verdict": r.verdict, "pattern": r.pattern, "shown": r.shown}


def _literal(value: list, kind: str) -> Column:
    """A constant of the plan, parsed once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _fetched(tokens: Column, rules: list[Rule], rare: dict[str, str]) -> Column:
    """The index entries of a URL's tokens. The index is an array of shelves, and a token's hash is its shelf's number."""
    indexed = [r for r in rules if r.tokens]
    shelves: list[list[dict]] = [[] for _ in range(1 << max(0, len(indexed) - 1).bit_length())]
    for r in indexed:
        shelves[zlib.crc32(rare[r.name].encode()) % len(shelves)].append(_entry(r, rare[r.name]))
    index = _literal(shelves, f"array<array<{_ENTRY}>>")
    shelf = lambda t: F.get(index, (F.crc32(t.cast("binary")) % len(shelves)).cast("int"))
    return F.flatten(F.transform(tokens, lambda t: F.filter(shelf(t), lambda e: e["token"] == t)))


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict, matched, tokens, candidates)`` for every row of ``pages`` (page_id, url).

    ``rule`` is the host rule that decided, else null; ``matched`` whatever rule did. A URL that is null or has no
    ``://`` has an empty host and path and fits no host rule. Rules without a token run for every URL. Repeated rows are
    judged each; extra columns are ignored; an empty table gives an empty result. Work for a URL grows with its tokens and
    the rules that they fetch, not with the number of rules.
    """
    cut = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rare = rarest_tokens(cut, rules)
    always = _literal([_entry(r, None) for r in rules if not r.tokens], f"array<{_ENTRY}>")
    met = cut.withColumn("met", F.concat(_fetched(_tokens(F.col("host"), F.col("path")), rules, rare), always))
    fits = F.filter("met", lambda e: F.regexp_like(F.concat("host", "path"), e["pattern"]))
    judged = met.withColumn("best", F.try_element_at(F.array_sort(fits, _stronger), F.lit(1)))
    hit = F.sort_array(F.array_distinct(F.array_compact(F.transform("met", lambda e: e["token"]))))
    return judged.select("page_id", "host", "path", F.when(F.col("best.shown"), F.col("best.name")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.col("best.name").alias("matched"), hit.alias("tokens"), F.size("met").alias("candidates"))


def _stronger(a: Column, b: Column) -> Column:
    return F.when(a["rank"] > b["rank"], -1).when(a["rank"] < b["rank"], 1).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), [*HOST_RULES, *PATTERN_RULES]).select("page_id", "host", "path", "rule", "verdict", "matched")


OP5_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(rule, verdict, h, p) AS (
  VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')
), fits AS (
  SELECT a.*, r.rule, r.verdict, row_number() OVER (PARTITION BY a.page_id ORDER BY length(r.rule) DESC NULLS LAST, r.rule) AS k
  FROM parts a LEFT JOIN rules r ON (a.host = r.h OR ends_with(a.host, '.' || r.h)) AND starts_with(a.path, r.p)
), others AS (
  SELECT *, CASE WHEN regexp_matches(path, '/login(/|\.|$)') THEN 'login pages' END AS m1,
    CASE WHEN regexp_matches(path, '/cart(/|\.|$)') THEN 'shopping carts' END AS m2,
    CASE WHEN regexp_matches(host || path, '\.zip$') THEN 'zip archives' END AS m3,
    CASE WHEN regexp_matches(host || path, '^ads?[0-9]*\.[^/]*/banner') THEN 'advert servers' END AS m4
  FROM fits WHERE k = 1
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(m1, m2, m3, m4) IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(rule, least(m4, m1, m2, m3)) AS matched
FROM others
"""

"""URL filters: pattern rules indexed by their rarest literal token.

Every rule becomes a regular expression over the URL's host and path, plus the literal
tokens that any URL it fits must hold as whole tokens. One counting pass over the URLs gives
each token's frequency; a rule is filed under its rarest token. A URL's own tokens then
fetch candidate rules, and only those run their regular expressions. The index is a constant
table hashed into short lists, so a URL is judged inside its own row without any shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The index is a constant of the plan; this many rules are some MB at most.
MAX_RULES = 50_000
_RULES = "array<array<struct<token:string,kind:int,size:int,name:string,regex:string,verdict:string>>>"


@dataclass(frozen=True)
class Rule:
    """A rule: its text, verdict, regular expression over host + path, and its whole tokens.

    ``kind`` 1 rules (host and path) win over kind 0 rules (patterns); the longest text wins
    within a kind, a tie goes to the larger text by code point.
    """

    name: str
    verdict: str
    regex: str
    tokens: Sequence[str] = field(default=())
    kind: int = 0


def host_path_rule(text: str, verdict: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the path starts with the rule's."""
    host, slash, rest = text.partition("/")
    host = host.translate(str.maketrans(UPPER, LOWER))
    path = slash + rest
    closed = path[: max((i + 1 for i, c in enumerate(path) if not (c.isascii() and c.isalnum())), default=0)]
    words = re.findall("[a-z0-9]+", f"{host} {closed}".translate(str.maketrans(UPPER, LOWER)))
    regex = r"^(?:[^/]*\.)?" + _quote(host) + (_quote(path) if slash else "(?:/|$)")
    return Rule(text, verdict, regex, tuple(words), 1)


def pattern_rule(text: str, verdict: str) -> Rule:
    """A pattern over host + path: ``*`` is any run, ``^`` a separator or the end, ``||`` a label start.

    Its literal tokens are the runs of letters and digits that separators of the rule bound on
    both sides, so that they are whole tokens of every URL that the rule fits.
    """
    body = text.removeprefix("||")
    regex = (r"^(?:[^/]*\.)?" if text.startswith("||") else "") + "".join(
        ".*" if c == "*" else "(?:[^A-Za-z0-9_.%-]|$)" if c == "^" else _quote(c) for c in body
    )
    open_start = not text.startswith("||")
    words = []
    for m in re.finditer("[a-z0-9]+", body.translate(str.maketrans(UPPER, LOWER))):
        left = body[m.start() - 1] if m.start() else ("*" if open_start else "|")
        right = body[m.end()] if m.end() < len(body) else "*"
        if left != "*" and right != "*":
            words.append(m.group())
    return Rule(text, verdict, regex, tuple(words), 0)


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text) if text.isascii() else "".join(c if not c.isascii() or c.isalnum() else "\\" + c for c in text)


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    rest = F.substring_index(url, "://", 1)
    host = F.regexp_extract(F.substr(url, F.length(rest) + 4), r"^[^/?#]*", 0)
    return F.when(F.instr(url, "://") > 0, F.translate(host, UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.substring_index(url, "://", 1)
    path = F.regexp_extract(F.substr(url, F.length(rest) + 4), r"^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise(F.lit(""))


def _tokens(address: Column) -> Column:
    return F.array_distinct(F.split(F.translate(address, UPPER, LOWER), "[^a-z0-9]+"))


def _slot(token: Column, slots: int) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(slots)).cast("int") + 1


def build_index(urls: DataFrame, address: Column, rules: Sequence[Rule]) -> list[list[dict]]:
    """Rules by slot. Slot 0 holds rules without a whole token, which every URL must try.

    Frequencies come from all URLs; the counted tokens are those of the rules, which bounds
    what reaches the driver by the length of the rule list.
    """
    import zlib

    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the index takes {MAX_RULES}")
    known = sorted({t for r in rules for t in r.tokens})
    seen: dict[str, int] = {}
    if known:
        table = F.from_json(F.lit(json.dumps(known)), "array<string>")
        counts = urls.select(F.explode(F.array_intersect(_tokens(address), table)).alias("token")).groupBy("token").count()
        seen = {r["token"]: r["count"] for r in counts.collect()}
    slots = max(1, len(rules))
    index: list[list[dict]] = [[] for _ in range(slots + 1)]
    for r in rules:
        token = min(r.tokens, key=lambda t: (seen.get(t, 0), -len(t), t)) if r.tokens else ""
        at = zlib.crc32(token.encode()) % slots + 1 if token else 0
        index[at].append({"token": token, "kind": r.kind, "size": len(r.name), "name": r.name, "regex": r.regex, "verdict": r.verdict})
    return index


def judge(urls: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` to every row.

    Null URLs and those without ``://`` have empty host and path and get ``default``. Each row
    is judged alone: repeated rows stay and get the same verdict, an empty table stays empty.
    Columns of the input named like the added ones are replaced; all others stay.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    address = F.concat(host, path)
    index = build_index(urls, address, rules)
    table = F.from_json(F.lit(json.dumps(index)), _RULES)
    slots = len(index) - 1
    near = F.transform(
        _tokens(address),
        lambda t: F.filter(F.element_at(table, _slot(t, slots) + 1), lambda r: r["token"] == t),
    )
    candidates = F.concat(F.flatten(near), F.element_at(table, 1)) if index[0] else F.flatten(near)
    fits = F.filter(candidates, lambda r: F.regexp_like(address, r["regex"]))
    best = F.array_max(
        F.transform(fits, lambda r: F.struct(r["kind"].alias("kind"), r["size"].alias("size"), r["name"].alias("name"), r["verdict"].alias("verdict")))
    )
    return (
        urls.withColumns({"__host": host, "__path": path, "__best": best})
        .withColumns({"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__best.name"), "verdict": F.coalesce(F.col("__best.verdict"), F.lit(default))})
        .drop("__host", "__path", "__best")
    )


#: Fixed values of the contract.
CONTRACT_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: Hosts of adverts, gambling, drugs and adult pages, blocked where no host and path rule fits.
PATTERNS = ["||casino-win.*", "||spam-farm.*", "||cheap-pills.*", "||free-bets.*", "||adult-x.*", "||ads-track.*"]


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = [host_path_rule(t, v) for t, v in CONTRACT_RULES] + [pattern_rule(p, "block") for p in PATTERNS]
    out = judge(pages, rules)
    fixed = F.col("rule").isin([t for t, _ in CONTRACT_RULES])
    return out.select(
        "page_id", "host", "path", F.when(fixed, F.col("rule")).alias("rule"), "verdict", F.when(~fixed, F.col("rule")).alias("pattern")
    )


OP1_SQL = r"""
with u as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages
), h as (
  select page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from u
), r(rule, rhost, rpath, verdict) as (
  values ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
         ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
), j as (
  select h.page_id, h.host, h.path, r.rule, r.verdict
  from h left join r on (h.host = r.rhost or ends_with(h.host, '.' || r.rhost)) and starts_with(h.path, r.rpath)
  qualify row_number() over (partition by h.page_id order by length(r.rule) desc nulls last, r.rule desc) = 1
)
select page_id, host, path, rule,
       coalesce(verdict, case when p <> '' then 'block' else 'allow' end) as verdict,
       case when rule is null and p <> '' then '||' || p || '.*' end as pattern
from (select *, regexp_extract('.' || host || path, '^[^/]*?\.(casino-win|spam-farm|cheap-pills|free-bets|adult-x|ads-track)\.', 1) as p from j)
"""

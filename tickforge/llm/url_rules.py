"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` together with the literal
tokens that any URL it matches must hold. Of those tokens the one seen least
often in the whole URL corpus becomes the rule's index key. A URL is cut into
tokens once; each token fetches the rules filed under it, and only those run
their expressions. Rules without a literal token are tried on every URL.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens are ASCII letter and digit runs, folded to lower case.
TOKEN_SEP = "[^A-Za-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is searched in host + path; ``name`` is set for list rules, which outrank the others."""

    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    name: str | None = None


def list_rule(host: str, path: str, verdict: str) -> UrlRule:
    """A host-and-subdomains, path-prefix rule as a pattern rule.

    Every host label is a whole token of the URL; of the path's tokens the
    last may be only the beginning of one, unless the prefix ends in a separator.
    """
    inner = re.split(TOKEN_SEP, path)
    whole = [t for t in [*re.split(TOKEN_SEP, host), *inner[:-1]] if t]
    # A path with upper case is compared as it stands; its tokens are folded for the index only.
    return UrlRule(f"^(?:[^/]*\\.)?{re.escape(host)}{re.escape(path)}", tuple(t.lower() for t in whole), verdict, host + path)


def word_rule(word: str, verdict: str = "block") -> UrlRule:
    """Blocks a word that stands between separators, in any case."""
    return UrlRule(f"(?ai)(?:^|[^a-z0-9]){re.escape(word)}(?:[^a-z0-9]|$)", tuple(re.split(TOKEN_SEP, word.lower())), verdict)


#: A filter line's options: a $ that only names, with values or not, follow.
_OPTIONS = re.compile(r"\$(~?[a-zA-Z0-9_-]+(?:=[^,/]*(?:/[^,]*)?)?(?:,~?[a-zA-Z0-9_-]+(?:=[^,]*)?)*)$")


def filter_rule(line: str) -> UrlRule | None:
    """A line of a filter list as a rule; None for comments, options of pages and empty lines.

    ``||`` anchors at a label of the host, ``|`` at either end of the address
    (host + path), ``*`` stands for anything, ``^`` for a separator or the
    end, ``@@`` allows, and ``/.../`` is a regular expression as it stands
    (a ``$`` in it too), without index tokens. Options follow the last ``$``:
    match-case, important and all are heeded; a rule with any other (kinds of
    requests, domains of pages, parties) holds in part of the cases only, which
    an address cannot tell, and is left out. The rest is literal, in any case. A literal token
    helps the index only if the address must hold it whole: neither ``*`` nor
    an open end of the rule may touch it.
    """
    text = line.strip()
    if not text or text[0] in "![" or "##" in text:
        return None
    verdict = "allow" if text.startswith("@@") else "block"
    body, options = text.removeprefix("@@"), ()
    found = _OPTIONS.search(body)
    if found:
        body, options = body[: found.start()], found[1].lower().split(",")
    if not set(options) <= {"match-case", "important", "all"}:
        return None
    case = "" if "match-case" in options else "i"
    if len(body) > 2 and body[0] == body[-1] == "/":
        return UrlRule(f"(?i){body[1:-1]}" if case else body[1:-1], (), verdict)
    start = re.match(r"\|{0,2}", body)[0]
    body = body[len(start) :]
    ends = body.endswith("|")
    body = body.removesuffix("|")
    pattern = "".join(".*" if c == "*" else r"(?:[^a-z0-9_.%-]|$)" if c == "^" else re.escape(c) for c in body)
    pattern = {"": "", "|": "^", "||": r"^(?:[^/]*\.)?"}[start] + pattern + "$" * ends
    # What touches the rule's open ends is marked as if a star stood there.
    framed = ("" if start else "*") + body.lower() + ("" if ends else "*")
    tokens = re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", framed) if framed.isascii() else []
    return UrlRule(f"(?a{case}){pattern}", tuple(tokens), verdict)


def filter_rules(lines: Iterable[str]) -> list[UrlRule]:
    """The rules of a filter list, in order."""
    return [r for r in map(filter_rule, lines) if r is not None]


#: The list rules of the contract.
LIST_RULES = (
    list_rule("org", "/", "allow"), list_rule("example.org", "/es/", "block"), list_rule("example.org", "/en/1", "block"),
    list_rule("com", "/fr/", "allow"), list_rule("com", "/de/", "block"),
)
#: Words of gambling, pharmacy, adult, file-sharing and tracking addresses.
BLOCK_WORDS = (
    "casino", "poker", "roulette", "jackpot", "bets", "betting", "slots", "lottery", "pills", "viagra", "cialis",
    "pharmacy-online", "porn", "xxx", "sex", "escort", "nude", "camgirls", "adult", "torrent", "warez", "keygen", "crack",
    "payday", "payday-loan", "replica-watches", "doubleclick", "adserver", "clickbait", "popunder", "malware", "phishing",
)
DEFAULT_RULES = LIST_RULES + tuple(map(word_rule, BLOCK_WORDS))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def token_counts(addresses: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """How many addresses hold each of the rules' own tokens, over all rows (a result no larger than the rules)."""
    cells = F.transform(F.split(F.concat("host", "path"), TOKEN_SEP), lambda t: F.lower(t))
    seen = addresses.select(F.explode(F.array_distinct(cells)).alias("token"))
    wanted = addresses.sparkSession.createDataFrame([(t,) for t in sorted(set(tokens))], "token string")
    # The wanted tokens are the rules' own, a list that the caller holds: no URL token needs to be shuffled.
    return {r.token: r.n for r in seen.join(F.broadcast(wanted), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}


def build_index(rules: Sequence[UrlRule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rule numbers by their rarest token, and the rules that have none."""
    by_token: dict[str, list[int]] = defaultdict(list)
    always = []
    for i, rule in enumerate(rules):
        if rule.tokens:
            by_token[min(rule.tokens, key=lambda t: (counts.get(t, 0), t))].append(i)
        else:
            always.append(i)
    return dict(by_token), always


def _precedence(rules: Sequence[UrlRule], i: int) -> tuple[bool, int, bool, int]:
    """List rules first, among them the longest; of the others those that allow, and the earliest."""
    rule = rules[i]
    return (rule.name is not None, len(rule.name or ""), rule.name is None and rule.verdict == "allow", -i)


def judge_urls(
    pages: DataFrame, rules: Sequence[UrlRule] = DEFAULT_RULES, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
) -> DataFrame:
    """Judge every URL; returns page_id, host, path, rule, verdict and n_tried (expressions run).

    One pass over the URL column after one count of the rules' tokens; no
    shuffle of rows. The longest matching list rule decides; else a matching
    pattern rule; else ``default``. The rule set is the caller's own list, the
    only thing that is broadcast.

    A null URL or one without ``://`` has empty host and path and gets
    ``default`` (unless a rule matches the empty address). Repeated rows are
    judged each; other columns are ignored; empty input gives an empty result.
    """
    rules = list(rules)
    addresses = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    index, always = build_index(rules, token_counts(addresses, [t for r in rules for t in r.tokens]))

    def judged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [re.compile(r.pattern) for r in rules]
        cut = re.compile(TOKEN_SEP).split
        for batch in batches:
            found, verdicts, tried = [], [], []
            for host, path in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True):
                address = host + path
                fetched = {i for t in {x.lower() for x in cut(address)} if t in index for i in index[t]}.union(always)
                hits = [i for i in fetched if patterns[i].search(address)]
                best = max(hits, key=lambda i: _precedence(rules, i), default=None)
                found.append(None if best is None else rules[best].name)
                verdicts.append(default if best is None else rules[best].verdict)
                tried.append(len(fetched))
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["host"], batch["path"], pa.array(found, pa.string()), pa.array(verdicts, pa.string()), pa.array(tried, pa.int32())],
                ["page_id", "host", "path", "rule", "verdict", "n_tried"],
            )

    id_type = addresses.schema["page_id"].dataType.simpleString()
    return addresses.mapInArrow(judged, f"page_id {id_type}, host string, path string, rule string, verdict string, n_tried int")

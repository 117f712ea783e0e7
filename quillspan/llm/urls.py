"""URL filter: listed rules, and association rules that FP-growth mines from labelled URLs.

A URL is a set of tokens: scheme, host suffixes, path words, extension, query keys, fragment.  Numbers
are one token, so that URLs share tokens.  A long token keeps its first characters and ends in the hash of
the whole, so that its size is bounded and distinct tokens stay distinct.  FP-growth runs over token sets
with a label token, without tokens too rare among bad URLs to be in any rule; rules whose consequent is
the bad label are kept if support, confidence and lift reach their bounds and no rule with fewer tokens is
as confident.  An inverted index from tokens to rules matches a URL.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.common import Scratch
from quillspan.llm.sampling import labelled_sample

#: (host, path, verdict)
LISTED = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Labelled URLs that rules are mined from, at most.
MAX_TRAIN = 20_000
#: Beyond so many rules the support is doubled and the URLs are mined again, so no rule that reaches the bounds in force is left out.
MAX_RULES = 100_000
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.5, 1.2
#: Characters of a token that is kept as it is.
MAX_TOKEN = 64
#: Tokens of a labelled URL that rules are mined from, at most (those that most often are in bad ones); matching takes all.
MAX_ITEMS = 24
BAD, GOOD = "=bad", "=good"
_LOWER = {c: c + 32 for c in range(65, 91)}
_WORDS = re.compile(r"[^/._-]+")
_HOST_END, _PATH_END = re.compile(r"[/?#]"), re.compile(r"[?#]")
Rule = tuple[frozenset, float]


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = _HOST_END.search(rest)
    host = rest[: end.start()] if end else rest
    return host.translate(_LOWER), _PATH_END.split(rest[len(host) :], maxsplit=1)[0]


def listed_rule(host: str, path: str, listed=LISTED) -> tuple[str, str] | None:
    """The longest listed rule that fits a host or a domain above it and the beginning of the path."""
    fits = [(len(h) + len(p), h + p, v) for h, p, v in listed if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def bounded(token: str) -> str:
    """A token as it is, or if it is long, its beginning and the hash of the whole of it."""
    if len(token) <= MAX_TOKEN:
        return token
    return token[: MAX_TOKEN // 2] + "#" + xxhash.xxh3_128_hexdigest(token.encode("utf-8", "surrogatepass"))


def tokens(url: str | None) -> list[str]:
    """Distinct tokens of the whole URL, sorted; none for null or a blank one."""
    if not url or not url.strip():
        return []
    host, path = parts(url)
    found = {"s:" + url.partition("://")[0].lower()} if "://" in url else set()
    labels = host.partition(":")[0].split(".") if host else []
    found |= {"h:" + ".".join(labels[i:]) for i in range(len(labels))}
    if len(labels) > 2:
        found.add("l:" + labels[0])
    found |= {"p:" + ("9" if w.isdigit() else w.lower()) for w in _WORDS.findall(path)}
    tail = url.partition("://")[2][len(host) + len(path) :]
    query, _, fragment = tail.partition("#")
    found |= {"q:" + pair.partition("=")[0] for pair in query[1:].split("&") if pair}
    if fragment:
        found.add("f:" + fragment)
    return sorted(set(map(bounded, found)))


class RuleIndex:
    """Token to rules; a rule fires when all its tokens are met."""

    def __init__(self, rules: Iterable[Rule] = ()):
        self.rules: list[Rule] = []
        self.postings: dict[str, list[int]] = {}
        for rule in rules:
            self.add(rule)

    def add(self, rule: Rule) -> None:
        for t in rule[0]:
            self.postings.setdefault(t, []).append(len(self.rules))
        self.rules.append(rule)

    def fired(self, found: Iterable[str]) -> list[int]:
        met = Counter(i for t in found for i in self.postings.get(t, ()))
        return sorted(i for i, n in met.items() if n == len(self.rules[i][0]))

    def best(self, found: Iterable[str]) -> float | None:
        """The highest confidence of a rule that fires."""
        return max((self.rules[i][1] for i in self.fired(found)), default=None)


def prune(rules: Iterable[Rule]) -> list[Rule]:
    """Rules for which no rule with fewer of their tokens is as confident, most confident first; smaller rules have to come first."""
    index = RuleIndex()
    for items, confidence in rules:
        if (index.best(items) or 0.0) < confidence:
            index.add((items, confidence))
    return sorted(index.rules, key=lambda r: (-r[1], len(r[0]), sorted(r[0])))


def _pruned(found: DataFrame, scratch: Scratch) -> list[Rule]:
    """prune() of rules (antecedent, confidence); what a rule of one token beats never comes to the driver."""
    found = scratch.write(found.withColumn("antecedent", F.array_sort("antecedent")))
    single = F.size("antecedent") == 1
    # at most MAX_ITEMS / support tokens are frequent
    first = sorted((r["token"], r["confidence"]) for r in found.filter(single).select(F.col("antecedent")[0].alias("token"), "confidence").collect())
    of = dict(first)

    def unbeaten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [max(of.get(t, 0.0) for t in items) < c for items, c in zip(*(x.to_pylist() for x in batch.columns))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    rest = found.filter(~single).mapInArrow(unbeaten, found.schema).orderBy(F.size("antecedent"), "antecedent")
    rows = ((frozenset(r["antecedent"]), r["confidence"]) for r in rest.toLocalIterator())
    return prune(chain(((frozenset((t,)), c) for t, c in first), rows))


def mine(pages: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, lift: float = MIN_LIFT) -> list[Rule]:
    """Rules from at most ``max_train`` pages (page_id, url) with a label (doc_id, bad 0 or 1).

    No page with a label, or no page at all: no rules.
    """
    rows = labelled_sample(pages.select(F.col("page_id").alias("doc_id"), "url"), labels.filter("bad is not null").select("doc_id", "bad"), ["url"], max_train)
    schema = "items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[*tokens(u), BAD if b else GOOD] for u, b in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.string()))], ["items"])

    with Scratch(pages.sparkSession, "urls") as scratch:
        items = scratch.write(rows.select("url", F.col("bad").cast("int")).mapInArrow(run, schema))
        n = items.count()
        if not n:
            return []
        while True:
            model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(_cut(items, support * n, scratch))
            bad = (F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") >= lift) & ~F.array_contains("antecedent", GOOD)
            rules = _pruned(model.associationRules.filter(bad).select("antecedent", "confidence"), scratch)
            if len(rules) <= MAX_RULES:
                return rules
            support *= 2


def _cut(items: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Token sets without tokens that are in fewer than ``least`` bad ones, and of the others MAX_ITEMS at most."""
    seen = items.select(F.explode("items").alias("token"), F.array_contains("items", BAD).alias("bad")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"))
    rank = {r["token"]: (-r["n_bad"] / r["n"], -r["n"], r["token"]) for r in seen.filter(F.col("n_bad") >= least - 1e-9).collect()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[*sorted((t for t in x if t in rank and t != BAD), key=rank.get)[:MAX_ITEMS], BAD if BAD in x else GOOD] for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.string()))], ["items"])

    return scratch.write(items.mapInArrow(cut, items.schema))


def judge(pages: DataFrame, rules: list[Rule], listed=LISTED) -> DataFrame:
    """page_id, host, path, rule, verdict, n_fired, confidence of every row of pages (page_id, url).

    A listed rule decides; else a URL is blocked if a mined rule fires, with the confidence of the best.
    Of listed rules of equal length the later in the alphabet decides.  Null and unparsable URLs have an empty
    host and path, no listed rule and, with nothing mined about them, the verdict allow.  URLs are taken whole,
    however long.  Equal rows have equal results; other columns are ignored; no rows give no rows.
    """
    index = RuleIndex(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for url in batch.column(1).to_pylist():
                host, path = parts(url)
                fits = listed_rule(host, path, listed)
                fired = index.fired(tokens(url))
                best = max((index.rules[i][1] for i in fired), default=None)
                rule, verdict = fits or (None, "block" if fired else "allow")
                out.append((host, path, rule, verdict, len(fired), best))
            kinds = [pa.string()] * 4 + [pa.int64(), pa.float64()]
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["page_id", "host", "path", "rule", "verdict", "n_fired", "confidence"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, n_fired long, confidence double")

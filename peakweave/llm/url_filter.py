"""URL filtering: rules first, then gradient-boosted trees on lexical features.

A rule is a host and the beginning of a path, such as ``example.org/private/``;
it fits its host and all subdomains, and the longest that fits decides. A URL
that no rule fits is judged by trees boosted on how URLs are written: length,
depth, digit ratio, entropy, parameter counts and the block rate of the host's
suffixes. The trees are trained on the driver from a bounded set of labelled
URLs, and scored in Arrow batches.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.sources.shipping import ship

MAX_LABELLED, TREES, DEPTH, RATE, BINS, LEAST_SEEN = 20_000, 40, 3, 0.2, 32, 20

#: (rule, verdict)
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty if the URL is null or has no ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[: min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The same, as columns."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(tail, r"\A[^?#]*", 0)


def rule_for(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


def suffix_rates(urls: list[str], labels: np.ndarray) -> dict[str, float]:
    """The smoothed share of blocked URLs of each suffix of one or two labels; of a suffix seen seldom it would only repeat the labels."""
    seen, blocked = Counter(), Counter()
    for url, label in zip(urls, labels, strict=True):
        for s in suffixes(split_url(url)[0]):
            seen[s] += 1
            blocked[s] += int(label)
    return {s: (blocked[s] + 1) / (n + 2) for s, n in seen.items() if n >= LEAST_SEEN}


def features(urls: Iterable[str | None], rates: dict[str, float]) -> np.ndarray:
    """A row of lexical features for each URL; an empty or null one has zeros and middling suffixes."""
    out = []
    for url in urls:
        url = url or ""
        host, path = split_url(url)
        query = url.partition("#")[0].partition("?")[2]
        counts, n, h = Counter(url), max(1, len(url)), max(1, len(host))
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        labels = host.split(".") if host else []
        last, two = suffixes(host)
        out.append(
            (
                len(url), len(host), len(path), path.count("/"), len(labels), max(map(len, labels), default=0),
                sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host) / h, host.count("-"), (len(host) - len(set(host))) / h,
                entropy, query.count("&") + 1 if query else 0, query.count("="), "#" in url, url.startswith("https"), rates.get(last, 0.5), rates.get(two, 0.5),
            )
        )
    return np.array(out, np.float64).reshape(len(out), 17)


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> dict:
    """Trees of a fixed depth on the logistic loss, by Newton steps over quantile bins. A tree is a heap of (feature, threshold) and its leaves."""
    prior = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    score = np.full(len(y), math.log(prior / (1 - prior)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T] if len(y) else []
    bins = [np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)]
    found = []
    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), int)
        splits = []
        for level in range(depth):
            for k in range(1 << level):
                own = node == k
                best, choice = 1e-6, (0, np.inf)
                total_g, total_h = grad[own].sum(), hess[own].sum()
                for f, (c, b) in enumerate(zip(cuts, bins, strict=True)):
                    if not len(c) or not own.any():
                        continue
                    g = np.cumsum(np.bincount(b[own], grad[own], len(c) + 1))[:-1]
                    h = np.cumsum(np.bincount(b[own], hess[own], len(c) + 1))[:-1]
                    gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                    if gain.max() > best:
                        best, choice = gain.max(), (f, float(c[gain.argmax()]))
                splits.append(choice)
            level_splits = splits[-(1 << level) :]
            right = np.zeros(len(y), bool)
            for k, (f, t) in enumerate(level_splits):
                right[(node == k) & (x[:, f] > t)] = True
            node = 2 * node + right
        leaves = np.array([-rate * grad[node == k].sum() / (hess[node == k].sum() + 1) for k in range(1 << depth)])
        score += leaves[node]
        found.append((splits, leaves))
    return {"base": math.log(prior / (1 - prior)), "depth": depth, "trees": found}


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """The probability that a URL should be blocked."""
    total = np.full(len(x), model["base"])
    for splits, leaves in model["trees"]:
        node, at = np.zeros(len(x), int), 0
        for level in range(model["depth"]):
            f = np.array([s[0] for s in splits[at : at + (1 << level)]])
            t = np.array([s[1] for s in splits[at : at + (1 << level)]])
            at += 1 << level
            node = 2 * node + (x[np.arange(len(x)), f[node]] > t[node])
        total += leaves[node]
    return 1 / (1 + np.exp(-total))


def train(labelled: DataFrame, bound: int = MAX_LABELLED) -> dict:
    """A model from ``url, blocked`` rows; of more than ``bound``, those of least hash. Rows with a null in them teach nothing."""
    kept = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull()).select("url", F.col("blocked").cast("int").alias("blocked"))
    rows = kept.orderBy(F.xxhash64("url", "blocked")).limit(bound).collect()
    return train_rows([(r.url, r.blocked) for r in rows])


def train_rows(rows: list[tuple[str, int]]) -> dict:
    urls, y = [u for u, _ in rows], np.array([b for _, b in rows], np.float64)
    rates = suffix_rates(urls, y)
    return {"rates": rates, "trees": boost(features(urls, rates), y)}


#: Parts of made-up words, of which both kinds of URLs are written: no word tells them apart, only their manner does.
SYLLABLES = ("ba", "dor", "fen", "gil", "hum", "jas", "kel", "lo", "mir", "nat", "ov", "pra", "qui", "ros", "sti", "tam", "ul", "ver", "wo", "yn")
#: Forms of path segments; w is a word and d a number.
SHAPES = ("{w}", "{w}-{w}", "{w}_{d}", "{d}", "{w}.php", "{w}{d}")
COMMON_SUFFIXES, ODD_SUFFIXES = ("com", "net", "org", "info", "example.com", "example.net", "example.org", "de", "fr"), ("biz", "top", "click", "info", "xyz")
#: How often a plain and a blocked URL shows each of six signs.
SIGNS = (0.08, 0.8)


def seed_urls(n: int = 4000, seed: int = 1, syllables: tuple[str, ...] = SYLLABLES, shapes: tuple[str, ...] = SHAPES) -> list[tuple[str, int]]:
    """``n`` labelled URLs, where there are no labels from elsewhere. Signs are hyphens, digits and an odd suffix in the host, a deep path, many parameters and a noisy segment; none is of one kind only."""
    rng = np.random.default_rng(seed)
    pick = lambda items: items[int(rng.integers(len(items)))]
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(2, 5)))
    number = lambda: str(rng.integers(1, 10 ** int(rng.integers(1, 6))))

    def segment() -> str:
        form = pick(shapes)
        while "{w}" in form:
            form = form.replace("{w}", word(), 1)
        return form.replace("{d}", number())

    out = []
    for k in range(n):
        blocked = k % 4 == 0
        hyphens, digits, odd, deep, many, noisy = rng.random(6) < SIGNS[blocked]
        name = "-".join(word() for _ in range(rng.integers(3, 5) if hyphens else 2 if rng.random() < 0.3 else 1))
        name += str(rng.integers(100, 99_999)) if digits else str(rng.integers(1, 10)) if rng.random() < 0.15 else ""
        host = pick(("", "", "www.", "m.", "blog.")) + name + "." + pick(ODD_SUFFIXES if odd else COMMON_SUFFIXES)
        path = [segment() for _ in range(rng.integers(4, 8) if deep else rng.integers(0, 4))]
        if noisy:
            path.append("".join(pick("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(rng.integers(20, 33))))
        query = "&".join(f"{word()}={segment()}" for _ in range(rng.integers(3, 7) if many else rng.integers(0, 2)))
        tail = pick(("", "/")) + (f"?{query}" if query else "") + (f"#{word()}" if rng.random() < 0.15 else "")
        out.append((f"{pick(('http', 'https'))}://{host}/{'/'.join(path)}{tail}", int(blocked)))
    return out


def judged(pages: DataFrame, model: dict, rules: Iterable[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, score``.

    A null URL, or one without ``://``, has an empty host and path, fits no rule, and is judged by its features, as any
    other. Repeated rows are judged alike; other columns are not read.
    """
    ship(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(urls: pd.Series) -> pd.Series:
        return pd.Series(score(sent.value["trees"], features(urls, sent.value["rates"])))

    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    parts = plain.select("page_id", host.alias("host"), path.alias("path"), rate(F.coalesce("url", F.lit(""))).alias("score"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return parts.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")

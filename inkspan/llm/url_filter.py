"""URL filters: allow and block rules, and boosted trees on lexical features.

Everything is column expressions. A rule list becomes one CASE over host
suffixes and path prefixes; the trees are fitted from a labelled table (its
distinct feature rows are counted by Spark, splits are chosen on those counts)
and become a sum of nested CASEs that Spark compiles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm.columns import without

TREES, DEPTH, RATE, LEAST = 24, 3, 0.4, 8
#: Labelled URLs that take part in fitting at most, on average. A bounded sample, drawn by the URL's hash.
TRAIN_ROWS = 20_000
FEATURES = ("length", "host_length", "depth", "labels", "hyphens", "digit_ratio", "entropy", "parameters", "suffix_rate")

# Syllables of made-up hosts and paths, and suffixes; the labelled URLs share them between the classes.
SYLLABLES = "ba ce di fo gu ha ke li mo nu pa re si to va we zo an el in or us".split()
SUFFIXES = "com org net info edu io de fr es".split()


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the URL is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://([^?#]*)", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/]*(.*)$", 1)


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    A rule is ``host/path``; it fits its host and subdomains where the path
    starts with the rule's. The list is part of the expression, so it is meant
    for hand-kept lists; of equally long rules the first given one counts.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: len(r[0])) if rules else []:
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.coalesce(F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c))), F.lit(0.0))


def features(url: Column, suffix_rates: dict[str, float] | None = None, default_rate: float = 0.5) -> dict[str, Column]:
    """Lexical features of a URL, rounded so that labelled rows fall into few distinct ones."""
    url = F.coalesce(url, F.lit(""))
    host, path = split_url(url)
    suffix, rate = F.regexp_extract(host, r"([^.]*)$", 1), F.lit(default_rate)
    for name, value in sorted((suffix_rates or {}).items()):
        rate = F.when(suffix == name, F.lit(value)).otherwise(rate)
    length = F.length(url)
    return {
        "length": F.floor(length / 10).cast("double"),
        "host_length": F.floor(F.length(host) / 3).cast("double"),
        "depth": F.regexp_count(path, F.lit("/[^/]+")).cast("double"),
        "labels": F.size(F.split(host, "[.]")).cast("double"),
        "hyphens": F.regexp_count(host, F.lit("-")).cast("double"),
        "digit_ratio": F.round(F.regexp_count(url, F.lit("[0-9]")) / F.greatest(length, F.lit(1)), 1),
        "entropy": F.round(_entropy(host) * 2) / 2,
        "parameters": F.regexp_count(url, F.lit("[?&][^?&#=]+=")).cast("double"),
        "suffix_rate": F.round(rate, 2),
    }


#: Chances in percent by class (ordinary, unwanted) of each trait that the labelled URLs are drawn with: value -> chances.
TRAITS = {
    "words": {1: (50, 15), 2: (40, 50), 3: (10, 35)},
    "joint": {"": (93, 10), "-": (7, 90)},
    "host_digits": {0: (97, 75), 3: (3, 25)},
    "depth": {1: (20, 25), 2: (40, 30), 3: (25, 20), 4: (15, 15), 6: (0, 10)},
    "parameters": {0: (60, 45), 1: (20, 15), 2: (19, 15), 4: (1, 25)},
    "id_digits": {0: (25, 20), 3: (35, 25), 4: (35, 30), 12: (5, 25)},
    "front": {"": (40, 40), "www.": (30, 15), "m.": (15, 20), "blog.": (15, 25)},
    "suffix": {"com": (40, 35), "org": (20, 10), "net": (15, 15), "edu": (10, 1), "de": (5, 5), "fr": (5, 4), "info": (3, 20), "io": (2, 10)},
}


def seed_labels(spark: SparkSession, rows: int = 8_000, seed: int = 0) -> DataFrame:
    """Labelled URLs ``(url string, blocked int)``, a third of them unwanted.

    Names are joined from random syllables, the same for both classes, so no word
    tells them apart; the classes differ only in how often a trait occurs
    (``TRAITS``: hyphens, digits, depth, parameters, suffixes), and overlap in all.
    """
    draw = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))
    blocked = draw("label", 3) == 0

    def trait(name: str) -> Column:
        values = list(TRAITS[name])
        ordinary, unwanted = (list(accumulate(chances)) for chances in zip(*TRAITS[name].values()))
        found = F.lit(values[-1])
        for value, few, many in reversed(list(zip(values, ordinary, unwanted))):
            found = F.when(draw(name, 100) < F.when(blocked, many).otherwise(few), F.lit(value)).otherwise(found)
        return found

    def word(salt: str) -> Column:
        picks = [F.element_at(F.array(*[F.lit(x) for x in SYLLABLES]), (draw(f"{salt}{i}", len(SYLLABLES)) + 1).cast("int")) for i in range(4)]
        return F.concat(*picks[:2], *[F.when(draw(f"{salt} size", 3) >= i, p).otherwise("") for i, p in enumerate(picks[2:], 1)])

    def number(salt: str, digits: Column) -> Column:
        return F.substr(F.lpad(F.abs(F.xxhash64("id", F.lit(seed), F.lit(salt))).cast("string"), 18, "7"), F.lit(3), digits)

    words = trait("words")
    host = F.concat(word("a"), F.when(words > 1, F.concat(trait("joint"), word("b"))).otherwise(""), F.when(words > 2, F.concat(trait("joint"), word("c"))).otherwise(""))
    host = F.concat(trait("front"), host, number("host", trait("host_digits")), F.when(draw("example", 3) == 0, ".example").otherwise(""), F.lit("."), trait("suffix"))
    steps = F.array(*[word(f"path{i}") for i in range(6)])
    ending = F.element_at(F.array(*[F.lit(x) for x in ("", "/", ".html", "#top")]), (draw("ending", 4) + 1).cast("int"))
    path = F.concat(F.array_join(F.slice(steps, 1, trait("depth")), "/"), F.lit("/"), number("id", trait("id_digits")), ending)
    query = F.array_join(F.transform(F.slice(F.array(F.lit("page"), F.lit("ref"), F.lit("utm"), F.lit("sid")), 1, trait("parameters")), lambda k: F.concat(k, F.lit("="), number("value", F.lit(2)))), "&")
    url = F.concat(F.when(draw("scheme", 3) == 0, "http://").otherwise("https://"), host, F.lit("/"), path, F.when(trait("parameters") > 0, "?").otherwise(""), query)
    return spark.range(rows).select(url.alias("url"), blocked.cast("int").alias("blocked"))


class Trees:
    """Boosted trees for log-odds of being blocked; leaves are numbers, inner nodes (feature, cut, below, above)."""

    def __init__(self, base: float, trees: list, suffix_rates: dict[str, float], default_rate: float):
        self.base, self.trees, self.suffix_rates, self.default_rate = base, trees, suffix_rates, default_rate

    def log_odds(self, columns: dict[str, Column]) -> Column:
        def build(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, cut, below, above = node
            return F.when(columns[name] <= cut, build(below)).otherwise(build(above))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + build(tree)
        return total


def _grow(rows: list, grad: list[float], hess: list[float], members: list[int], depth: int):
    g, h = sum(grad[i] for i in members), sum(hess[i] for i in members)
    leaf = -g / (h + 1.0) * RATE
    if depth == 0:
        return leaf
    best = (1e-6, None, None)
    for f, name in enumerate(FEATURES):
        sums: dict[float, list[float]] = {}
        for i in members:
            s = sums.setdefault(rows[i][0][f], [0.0, 0.0, 0])
            s[0] += grad[i]
            s[1] += hess[i]
            s[2] += rows[i][1]
        left_g = left_h = left_n = 0.0
        n = sum(s[2] for s in sums.values())
        for value in sorted(sums)[:-1]:
            left_g, left_h, left_n = left_g + sums[value][0], left_h + sums[value][1], left_n + sums[value][2]
            if left_n < LEAST or n - left_n < LEAST:
                continue
            gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
            if gain > best[0]:
                best = (gain, f, value)
    if best[1] is None:
        return leaf
    _, f, cut = best
    below, above = [i for i in members if rows[i][0][f] <= cut], [i for i in members if rows[i][0][f] > cut]
    return (FEATURES[f], cut, _grow(rows, grad, hess, below, depth - 1), _grow(rows, grad, hess, above, depth - 1))


def _value(node, row: tuple) -> float:
    while not isinstance(node, float):
        name, cut, below, above = node
        node = below if row[FEATURES.index(name)] <= cut else above
    return node


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", max_rows: int = TRAIN_ROWS) -> Trees:
    """Trees from labelled URLs (1: unwanted). Null URLs or labels teach nothing; without rows every log-odds is 0.

    ``max_rows`` bounds the sample, so the distinct feature rows that come to the driver are bounded too.
    """
    known = labelled.filter(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(url_col).alias("url"), F.col(label_col).cast("int").alias("y"))
    rate = int(min(1.0, max_rows / max(known.count(), 1)) * 1_000_000)
    known = known.filter(F.pmod(F.xxhash64("url", F.lit("urls")), F.lit(1_000_000)) < rate)
    suffix = F.regexp_extract(split_url(F.col("url"))[0], r"([^.]*)$", 1)
    counts = known.groupBy(suffix.alias("suffix")).agg(F.sum("y"), F.count("*")).collect()
    total, blocked = sum(r[2] for r in counts), sum(r[1] for r in counts)
    if not total:
        return Trees(0.0, [], {}, 0.5)
    prior = blocked / total
    rates = {r[0]: round((r[1] + 20 * prior) / (r[2] + 20), 2) for r in counts}
    made = features(F.col("url"), rates, round(prior, 2))
    grouped = known.select("y", *[made[f].alias(f) for f in FEATURES]).groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect()
    rows = sorted((tuple(r[f] for f in FEATURES), r["n"], r["y"]) for r in grouped)
    base = math.log((blocked + 1) / (total - blocked + 1))
    margin, trees = [base] * len(rows), []
    for _ in range(TREES):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grad = [r[1] * q - r[2] for r, q in zip(rows, p)]
        hess = [r[1] * q * (1 - q) for r, q in zip(rows, p)]
        tree = _grow(rows, grad, hess, list(range(len(rows))), DEPTH)
        trees.append(tree)
        margin = [m + _value(tree, r[0]) for m, r in zip(margin, rows)]
    return Trees(base, trees, rates, round(prior, 2))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], trees: Trees, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``block_score double`` and ``verdict`` (allow or block).

    The longest rule that fits decides, else the trees. A null URL, or one
    without ``://``, has an empty host and path, fits no rule and is judged by
    its features. Rows are kept one to one; repeated ones are judged alike; an
    empty table gives an empty result. Input columns named like an output are replaced by it.
    """
    pages = without(pages, "host", "path", "rule", "block_score", "verdict")
    host, path = split_url(F.col(url_col))
    made = features(F.col(url_col), trees.suffix_rates, trees.default_rate)
    parts = pages.select("*", host.alias("host"), path.alias("path"), F.struct(*[made[f].alias(f) for f in FEATURES]).alias("made_features"))
    score = 1 / (1 + F.exp(-trees.log_odds({f: F.col(f"made_features.{f}") for f in FEATURES})))
    rule, decided = match_rules(F.col("host"), F.col("path"), rules)
    judged = parts.withColumns({"rule": rule, "block_score": score, "decided": decided})
    verdict = F.coalesce("decided", F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))
    return judged.withColumn("verdict", verdict).drop("decided", "made_features")

"""URL rules by a cascade of Bloom filters.

The first level encodes the listed keys. Of all other keys in the corpus, those that pass it are encoded in the second
level, the listed keys that pass the second in the third, and so on until a level lets nothing wrong through. Over the
corpus's own keys membership is then exact, and a URL is judged by hashing alone: no join, no list lookup. The first
level's false positive rate is chosen so that the second encodes about as many keys as are listed, whatever the corpus
holds; the levels travel as literals whose size is bounded by the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log, log2, sqrt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Rules and false positives of a level travel as literals; more than this many are refused.
MOST_RULES, MOST_PASSING = 50_000, 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int

    def passes(self, key: Column) -> Column:
        words = F.array(*[F.lit(w).cast("bigint") for w in self.words])
        hit = F.lit(True)
        for i in range(self.hashes):
            at = _position(key, self, i)
            word = F.element_at(words, (F.shiftright(at, 6) + 1).cast("int"))
            hit = hit & (word.bitwiseAND(_bit(at)) != 0)
        return hit


def _position(key: Column, level: Level, i: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level.seed), F.lit(i)), F.lit(level.bits).cast("bigint"))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))


def _encode(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A level over the column ``key`` of ``keys`` (``n`` rows)."""
    hashes = max(1, round(log2(1 / rate)))
    bits = max(64, 64 * ceil(n * log(1 / rate) / log(2) ** 2 / 64))
    blank = Level((), bits, hashes, seed)
    at = keys.select(F.explode(F.array(*[_position(F.col("key"), blank, i) for i in range(hashes)])).alias("at"))
    words = {r.word: r.bits for r in at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(_bit(F.col("at"))).alias("bits")).collect()}
    return Level(tuple(words.get(i, 0) for i in range(bits // 64)), bits, hashes, seed)


def _literal(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))


def build_cascade(universe: DataFrame, listed: list[str]) -> tuple[Level, ...]:
    """Levels that tell ``listed`` keys from all other keys in column ``key`` of ``universe``; keys may repeat there."""
    spark, listed = universe.sparkSession, sorted(set(listed))
    if len(listed) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} keys are listed")
    if not listed:
        return ()
    rate = min(0.5, len(listed) / (sqrt(2) * max(1, universe.count())))
    levels = [_encode(_literal(spark, listed), len(listed), rate, 1)]
    wrong = [r.key for r in universe.where(levels[0].passes(F.col("key")) & ~F.col("key").isin(listed)).select("key").distinct().limit(MOST_PASSING + 1).collect()]
    if len(wrong) > MOST_PASSING:
        raise ValueError("the first level lets too many keys through")
    inside, outside = wrong, listed
    while inside:
        levels.append(_encode(_literal(spark, inside), len(inside), 0.5 if len(levels) < 24 else 0.01, len(levels) + 1))
        passing = [r.key for r in _literal(spark, outside).where(levels[-1].passes(F.col("key"))).collect()]
        inside, outside = passing, inside
    return tuple(levels)


def is_listed(levels: tuple[Level, ...], key: Column) -> Column:
    """Whether a key of the corpus is listed."""
    if not levels:
        return F.lit(False)
    answer = F.lit(True)
    for i in range(len(levels) - 1, -1, -1):
        hit = levels[i].passes(key)
        answer = (hit & answer) if i % 2 == 0 else (~hit | answer) if i + 1 < len(levels) else ~hit
    return answer


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_keys(host: Column, path: Column, path_lengths: list[int], most_labels: int) -> Column:
    """All keys under which a rule for the url could be listed: every parent domain of at most as many labels as a rule
    has, with every path prefix of a listed length."""
    end = F.substring_index(host, ".", -(most_labels + 1))  # a longer host fits no rule as a whole
    labels = F.split(end, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = F.filter(hosts, lambda h: F.length(h) - F.length(F.replace(h, F.lit("."), F.lit(""))) < most_labels)
    lengths = F.filter(F.array(*[F.lit(x) for x in path_lengths]), lambda n: n <= F.length(path))
    return F.flatten(F.transform(hosts, lambda h: F.transform(lengths, lambda n: F.concat(h, F.substring(path, F.lit(1), n)))))


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    The longest rule that fits wins (of equally long ones the greater string); no rule means ``allow``, the cascade's own
    answer for a key that is not listed. A null url, or one without ``://``, has an empty host and path and fits no rule
    but one for the empty host. Repeated rows are each judged; an empty table gives an empty result.
    """
    named = {h + p: v for v, h, p in rules}
    lengths = sorted({len(p) for _, _, p in rules})
    parts = pages.select(F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    most_labels = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    keyed = parts.withColumn("keys", rule_keys(F.col("host"), F.col("path"), lengths, most_labels))
    universe = keyed.select(F.explode("keys").alias("key"))
    cascades = {v: build_cascade(universe, [k for k, x in named.items() if x == v]) for v in ("block", "allow")}
    hits = F.transform(
        F.col("keys"),
        lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), F.when(is_listed(cascades["block"], k), "block").when(is_listed(cascades["allow"], k), "allow").alias("verdict")),
    )
    best = keyed.withColumn("best", F.array_max(F.filter(hits, lambda x: x.verdict.isNotNull())))
    return best.select(id_col, "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))

"""URL filters: rules first, then the ratio of two character language models, in DataFrame functions alone.

URLs that rules allow or block teach two smoothed Markov models of variable order: a character's probability after up to
``ORDER - 1`` others leans on that after one less, the more the rarer the context. A URL is judged by the difference of
its log likelihoods under both, per character, against a threshold calibrated on judged URLs that taught nothing.

Of the models only the ratio matters, and it is kept as what each longer n-gram adds to the ratio of the shorter one it
ends with, so a URL's score is a plain sum over its n-grams, and one never seen adds nothing: the longest one known
decides. Every n-gram keeps its own weight: the table grows with what teaches it and is joined by shuffle; only the
n-grams that a sample of the URLs has most often go to every task, so that no task gets all rows of a frequent one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, fold_of
from millrace.session import settle

#: Characters in the longest n-gram.
ORDER = 5
#: Weight of the shorter context's estimate, in occurrences.
LEAN = 2.0
#: Characters that a model without any context thinks possible.
LETTERS = 256
#: URLs whose n-grams are counted to tell the frequent ones, and how many of those go to every task, some 5 MB. Both
#: decide where a weight is looked up, never which.
SAMPLE = 20_000
HOT = 1 << 16
#: Share of judged URLs kept for calibration: one fold of so many.
FOLDS = 5

#: Host, path prefix and verdict; a rule fits its host and all subdomains.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; both empty for a null or a URL without ``://``."""
    whole = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    rest = F.when(F.instr(F.col(url), "://") > 0, whole).otherwise(F.lit(""))
    rows = pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
    rows = rows.withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
    tail = F.expr("substring(_rest, char_length(_host) + 1)")
    return rows.withColumn("host", ascii_lower(F.col("_host"))).withColumn("path", F.regexp_extract(tail, "^[^?#]*", 0)).drop("_rest", "_host")


def fitting(rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, written host and path together, and its verdict; null if none."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda rule: (len(rule[0]) + len(rule[1]), len(rule[0]))):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def grams(rows: DataFrame, url: str, *keep: str) -> DataFrame:
    """A row for each n-gram of each URL: its length ``_n`` and ``_gram``."""
    ends = rows.select(*keep, F.col(url).alias("_url"), F.explode(F.expr(f"sequence(1, char_length(`{url}`))")).alias("_end")).where("_end >= 1")
    sizes = ends.select(*keep, "_url", "_end", F.explode(F.array(*[F.lit(n) for n in range(1, ORDER + 1)])).alias("_n")).where("_n <= _end")
    return sizes.select(*keep, "_n", F.expr("substring(_url, _end - _n + 1, _n)").alias("_gram"))


def _bin() -> Column:
    """What the table of ratios is keyed by: the n-gram, whose length is ``_n``."""
    return F.col("_gram").alias("_bin")


@dataclass
class Model:
    """What each n-gram adds to the log ratio, and the least ratio per character that is allowed."""

    ratios: DataFrame
    threshold: float


def ratios(judged: DataFrame, url: str, verdict: str) -> DataFrame:
    """``_bin``, an n-gram, and ``_adds``, what it adds to the log ratio."""
    allowed = F.col(verdict) == "allow"
    counted = grams(judged.select(url, allowed.alias("_good")), url, "_good").groupBy("_n", "_gram").agg(
        F.sum(F.when(F.col("_good"), 1.0).otherwise(0.0)).alias("_a"), F.sum(F.when(F.col("_good"), 0.0).otherwise(1.0)).alias("_r")
    )
    counted = settle(counted, "url-grams")
    total = counted.where("_n = 1").agg(F.coalesce(F.sum("_a"), F.lit(0.0)), F.coalesce(F.sum("_r"), F.lit(0.0))).first()
    one = counted.where("_n = 1")
    chance = {side: (F.col(f"_{side}") + LEAN / LETTERS) / F.lit(all_ + LEAN) for side, all_ in zip("ar", total, strict=True)}
    level = one.select("_n", "_gram", chance["a"].alias("_pa"), chance["r"].alias("_pr")).withColumn(
        "_adds", F.log(F.col("_pa") / F.col("_pr"))
    )
    done = level.select("_gram", "_adds")
    for n in range(2, ORDER + 1):
        context = counted.where(F.col("_n") == n - 1).select(F.col("_gram").alias("_before"), F.col("_a").alias("_ca"), F.col("_r").alias("_cr"))
        shorter = level.select(F.col("_gram").alias("_end"), F.col("_pa").alias("_sa"), F.col("_pr").alias("_sr"))
        own = counted.where(F.col("_n") == n).withColumn("_before", F.expr(f"left(_gram, {n - 1})")).withColumn("_end", F.expr(f"right(_gram, {n - 1})"))
        joined = own.join(context, "_before").join(shorter, "_end")
        level = joined.select(
            "_n",
            "_gram",
            ((F.col("_a") + LEAN * F.col("_sa")) / (F.col("_ca") + LEAN)).alias("_pa"),
            ((F.col("_r") + LEAN * F.col("_sr")) / (F.col("_cr") + LEAN)).alias("_pr"),
            F.log(F.col("_sa") / F.col("_sr")).alias("_short"),
        )
        level = settle(level.withColumn("_adds", F.log(F.col("_pa") / F.col("_pr")) - F.col("_short")), "url-level")
        done = done.union(level.select("_gram", "_adds"))
    return settle(done.select(_bin(), "_adds"), "url-ratios")


def scored(urls: DataFrame, table: DataFrame, url: str) -> DataFrame:
    """``url`` and ``score``, the log ratio per character, of each distinct URL; empty ones have none."""
    asked = settle(urls.select(url).distinct().withColumn("_key", F.monotonically_increasing_id()), "url-asked")
    share = min(1.0, SAMPLE / max(1, asked.count()))
    some = asked.where(F.pmod(F.xxhash64(url), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    often = grams(some, url).groupBy("_gram").agg(F.count("*").alias("_times")).orderBy(F.desc("_times"), "_gram").limit(HOT)
    hot = settle(often.select(_bin()).join(table, "_bin", "left").select("_bin", F.coalesce("_adds", F.lit(0.0)).alias("_known")), "url-hot")
    found = grams(asked, url, "_key").select("_key", "_n", _bin()).join(F.broadcast(hot), "_bin", "left")
    here = found.groupBy("_key").agg(F.sum("_known").alias("_here"), F.sum(F.when(F.col("_n") == 1, 1).otherwise(0)).alias("_long"))
    rest = found.where("_known is null").select("_key", "_bin").join(table, "_bin").groupBy("_key").agg(F.sum("_adds").alias("_rest"))
    total = F.coalesce("_here", F.lit(0.0)) + F.coalesce("_rest", F.lit(0.0))
    return asked.join(here, "_key").join(rest, "_key", "left").select(url, (total / F.col("_long")).alias("score"))


def train(judged: DataFrame, url: str, verdict: str, key: str) -> Model:
    """Models from URLs with a verdict; the threshold lies between both kinds' mean scores, as far from each as its
    scores spread. 0 where there are none of a kind to calibrate on."""
    fold = F.coalesce(fold_of(key, FOLDS), F.lit(0))
    rows = settle(judged.where(F.col(url).isNotNull()).select(url, verdict, (fold == 0).alias("_kept")), "url-judged")
    table = ratios(rows.where("not _kept"), url, verdict)
    kept = rows.where("_kept").groupBy(url, verdict).agg(F.count("*").alias("_many"))
    seen = kept.join(scored(kept, table, url), url)
    weight, x = F.col("_many"), F.col("score")
    each = {
        row[verdict]: (row["n"], row["mean"], max(0.0, row["square"] - row["mean"] ** 2) ** 0.5)
        for row in seen.groupBy(verdict)
        .agg(F.sum(weight).alias("n"), (F.sum(x * weight) / F.sum(weight)).alias("mean"), (F.sum(x * x * weight) / F.sum(weight)).alias("square"))
        .collect()
    }
    threshold = 0.0
    if "allow" in each and "block" in each:
        (_, good, wide), (_, bad, narrow) = each["allow"], each["block"]
        threshold = (good * (narrow + 1e-9) + bad * (wide + 1e-9)) / (wide + narrow + 2e-9)
    return Model(table, float(threshold))


def judged(pages: DataFrame, url: str = "url", key: str = "page_id", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of each row.

    A rule's verdict stands; other URLs are allowed if their score reaches the threshold. A null or empty URL scores 0.
    Rows that repeat a URL are scored once; other columns are left out.
    """
    name, verdict = fitting(rules)
    rows = with_parts(pages.select(F.col(key).alias("_key"), F.col(url).alias("_link")), "_link")
    rows = settle(rows.withColumn("rule", name).withColumn("_says", verdict), "url-rules")
    model = train(rows.where("_says is not null"), "_link", "_says", "_key")
    scores = scored(rows.where("_link is not null and _link <> ''"), model.ratios, "_link")
    score = F.coalesce("score", F.lit(0.0))
    return rows.join(scores, "_link", "left").select(
        F.col("_key").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce("_says", F.when(score >= model.threshold, "allow").otherwise("block")).alias("verdict"),
        score.alias("score"),
    )

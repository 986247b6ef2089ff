"""URL filtering by rules, and by character language models where no rule fits.

Two variable-order Markov models over characters learn from URLs that the rules allow and
from those they block. A character's probability behind a context interpolates between
the longest context seen and all shorter ones, each weighted by how many different
characters follow it. A URL no rule fits is judged by the difference of its two log
likelihoods per character, against a threshold calibrated on labelled URLs kept out of
the models.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gauge_engine.llm.shipping import ship_package

ORDER = 4
# Labelled URLs that the models and the threshold are fitted on, per label, and the longest
# URL among them. They bound the models' size; every URL is judged, whatever its length.
SAMPLE_PER_LABEL = 10_000
SAMPLE_LONGEST = 2_000
CALIBRATION_SHARE = 5

_START, _END = "\x02", "\x03"
_UNSEEN = 1 / 65_536
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """Behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower())


def url_path(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(rules: Sequence[Rule], host: Column, path: Column, of: str = "name") -> Column:
    """The name (or verdict) of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(getattr(rule, of))).otherwise(found)
    return found


class MarkovModel:
    """Characters behind contexts of up to ``order`` characters."""

    def __init__(self, order: int):
        self.order = order
        self.after: dict[str, Counter] = defaultdict(Counter)
        self.known: dict[tuple[str, str], float] = {}

    def learn(self, texts: Sequence[str]) -> MarkovModel:
        for text in texts:
            padded = _START * self.order + text + _END
            for i in range(self.order, len(padded)):
                for k in range(self.order + 1):
                    self.after[padded[i - k : i]][padded[i]] += 1
        self.after = {c: (dict(n), sum(n.values())) for c, n in self.after.items()}
        return self

    def _log(self, context: str, char: str) -> float:
        p = _UNSEEN
        for k in range(len(context) + 1):
            held = self.after.get(context[len(context) - k :])
            if held is None:
                break
            counts, total = held
            p = (counts.get(char, 0) + len(counts) * p) / (total + len(counts))
        return math.log(p)

    def log_likelihood(self, text: str) -> float:
        padded = _START * self.order + text + _END
        total = 0.0
        for i in range(self.order, len(padded)):
            key = padded[i - self.order : i], padded[i]
            found = self.known.get(key)
            if found is None:
                if len(self.known) > 500_000:
                    self.known.clear()
                found = self.known[key] = self._log(*key)
            total += found
        return total


class LikelihoodRatio:
    """Accepted against rejected, per character; higher is more like the accepted ones."""

    def __init__(self, accepted: Sequence[str], rejected: Sequence[str], order: int = ORDER):
        self.models = [MarkovModel(order).learn(texts) for texts in (accepted, rejected)]
        self.threshold = 0.0

    def score(self, text: str) -> float:
        accepted, rejected = (m.log_likelihood(text) for m in self.models)
        return (accepted - rejected) / (len(text) + 1)

    def calibrate(self, accepted: Sequence[str], rejected: Sequence[str]) -> None:
        """The cut with the best mean of both labels' hit rates; of equal ones, nearest to 0."""
        labelled = sorted([(self.score(t), 1) for t in accepted] + [(self.score(t), 0) for t in rejected])
        if not accepted or not rejected:
            return
        below = {0: 0, 1: 0}
        best = (-1.0, 0.0, 0.0)
        for i, (score, label) in enumerate(labelled):
            if i == 0 or score > labelled[i - 1][0]:
                cut = score if i == 0 else (score + labelled[i - 1][0]) / 2
                rate = (1 - below[1] / len(accepted)) + below[0] / len(rejected)
                best = max(best, (rate, -abs(cut), cut))
            below[label] += 1
        self.threshold = best[2]


def fit_ratio(
    labelled: DataFrame, url_col: str, label_col: str, per_label: int = SAMPLE_PER_LABEL,
    longest: int = SAMPLE_LONGEST, order: int = ORDER,
) -> LikelihoodRatio | None:
    """Models from at most ``per_label`` distinct URLs of each label, those with the lowest hash.

    None if a label has no URL.
    """
    urls = labelled.where(F.length(url_col) <= longest).select(F.col(url_col).alias("url"), F.col(label_col).alias("label")).distinct()
    picked = {}
    for label in ("allow", "block"):
        rows = urls.where(F.col("label") == label).orderBy(F.xxhash64("url"), "url").limit(per_label).collect()
        picked[label] = [r["url"] for r in rows]
    if not all(picked.values()):
        return None
    ratio = LikelihoodRatio(
        *[[u for i, u in enumerate(picked[v]) if i % CALIBRATION_SHARE] or picked[v] for v in ("allow", "block")], order
    )
    ratio.calibrate(*[picked[v][::CALIBRATION_SHARE] for v in ("allow", "block")])
    return ratio


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", per_label: int = SAMPLE_PER_LABEL,
) -> DataFrame:
    """All columns of ``pages`` and ``host, path, rule, score, verdict``; clashing ones are replaced.

    The longest rule that fits decides. Elsewhere the verdict is ``allow`` where the score
    reaches the calibrated threshold. Null URLs, and those without ``://``, have an empty
    host and path, fit no rule, and are scored as they are (null as empty). Without an
    example of both labels there are no models: the score is null and the verdict
    ``allow``. Repeated rows get equal verdicts; an empty table stays empty.
    """
    spark = pages.sparkSession
    ship_package(spark)
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    found = pages.select(url_col).withColumns({"_label": matching_rule(rules, host, path, "verdict")})
    ratio = fit_ratio(found.where("_label IS NOT NULL"), url_col, "_label", per_label)
    ruled = pages.withColumns({"rule": matching_rule(rules, host, path), "_label": matching_rule(rules, host, path, "verdict")})
    if ratio is None:
        scored = ruled.withColumn("score", F.lit(None).cast("double"))
        open_verdict = F.lit("allow")
    else:
        shared = spark.sparkContext.broadcast(ratio)

        @F.pandas_udf("double")
        def score(urls: pd.Series) -> pd.Series:
            model = shared.value
            return pd.Series([model.score(u or "") for u in urls], dtype="float64")

        scored = ruled.withColumn("score", score(url_col))
        open_verdict = F.when(F.col("score") >= ratio.threshold, "allow").otherwise("block")
    return scored.withColumns(
        {"host": host, "path": path, "verdict": F.coalesce("_label", open_verdict)}
    ).drop("_label")

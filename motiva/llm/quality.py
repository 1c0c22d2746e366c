"""Quality classifier: a sparse ensemble of rules.

Statistics of each text are Spark expressions. On a sample of labelled rows, small trees are grown for the label; every path
from a root to a node is a conjunctive rule over the statistics; a logistic regression with lasso penalty keeps few of the
rules; and those are compiled into one Spark expression, so that scoring a corpus has no Python in it. There is one ensemble
for low quality and one for toxicity; either rejects a document.

Two statistics count words of a lexicon: words that the sample has in many contexts in documents of the label and, in
proportion, hardly elsewhere. A context is the word before it; a document gives each of its words one, so neither copies of
a document nor one long document make a word count often.

The sample is the ``sample_rows`` labelled documents that come first in the order of a hash of doc_id, written once and
read by every step of the fit; nothing else is bounded, and a lexicon holds every word that meets its conditions.

Defined cases: a null text has the statistics of an empty one, and is rejected as holding nothing to train on, as is a text
without any word; a null doc_id can't be labelled, but is scored; rows of ``labels`` with a null are left out, and a doc_id
labelled twice counts as bad if any of its labels says so; repeated rows are scored each; other columns are passed on by
``keep_good`` untouched, whatever their names; statistics are of whole texts, however long; a probability of exactly 0.5
rejects, and splits of equal gain go to the statistic drawn first; without labels, or with one class only, nothing is
rejected for that label; an empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, packed_row

HEADS = ("low", "toxic")
WORDS = "regexp_extract_all(lower({0}), '[\\\\p{{L}}\\\\p{{N}}]+', 0)"


def _only(text: Column, other: str) -> Column:
    """How many characters are left without runs of ``other``."""
    return F.length(F.regexp_replace(text, other, "")).cast("double")


def _among(words: list[str]):
    return lambda w: w.isin(words)


def statistics(docs: DataFrame, lexicons: dict[str, list[str]], carry: list[str]) -> DataFrame:
    """The columns ``carry`` and the statistics, named __f_*, of the column text.

    Small letters and spaces, the bulk of a text, are removed once; capitals, digits, stops and symbols are counted in the rest.
    """
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    base = docs.select(*carry, F.coalesce(F.col("text"), F.lit("")).alias("__t"))
    base = base.withColumns({"__words": F.expr(WORDS.format("__t")), "__lines": F.split("__t", "\n"), "__n": F.length("__t").cast("double"), "__rest": F.regexp_replace("__t", "[a-z \\p{Ll}]+", ""), "__dense": F.length(F.replace("__t", F.lit(" "), F.lit(""))).cast("double")})
    found = {f"__f_{k}": (F.size(F.filter("__words", _among(words))).cast("double") if words else F.lit(0.0)) for k, words in lexicons.items()}
    base = base.withColumns(
        {
            "__f_words": F.size("__words").cast("double"),
            "__distinct": F.size(F.array_distinct("__words")).cast("double"),
            "__f_lines": F.size("__lines").cast("double"),
            "__dlines": F.size(F.array_distinct("__lines")).cast("double"),
            "__upper": _only(F.col("__rest"), "[^\\p{Lu}]+"),
            "__symbols": _only(F.col("__rest"), "[\\p{L}\\p{N}\\s.,;:'\"()-]+"),
            "__digits": _only(F.col("__rest"), "[^0-9]+"),
            "__stops": _only(F.col("__rest"), "[^.!?]+"),
        }
        | found
    )
    base = base.withColumn("__f_length", F.col("__dense") - F.col("__f_lines") + 1)
    base = base.withColumns(
        {
            "__f_mean_word": part(F.col("__f_length"), F.col("__f_words")),
            "__f_distinct": part(F.col("__distinct"), F.col("__f_words")),
            "__f_distinct_lines": part(F.col("__dlines"), F.col("__f_lines")),
            "__f_upper": part(F.col("__upper"), F.col("__n")),
            "__f_symbols": part(F.col("__symbols"), F.col("__f_words")),
            "__f_digits": part(F.col("__digits"), F.col("__n")),
            "__f_stops": part(F.col("__stops"), F.col("__f_words")),
        }
    )
    # A filter on scores would be pushed below these projections, with every statistic written out wherever a rule uses it;
    # it isn't pushed below a generator.
    once = base.select(*carry, F.explode_outer(F.array(F.struct(*(F.col(f"__f_{f}").alias(f) for f in NAMES)))).alias("__s"))
    return once.select(*carry, *(F.col(f"__s.{f}").alias(f"__f_{f}") for f in NAMES))


NAMES = ["words", "lines", "length", "mean_word", "distinct", "distinct_lines", "upper", "symbols", "digits", "stops", *HEADS]


Condition = tuple[str, bool, float]  # statistic, above (else at most), bound


@dataclass
class Rules:
    """A weight for each conjunction of conditions, and the rest of the log-odds."""

    bias: float
    weights: list[tuple[float, tuple[Condition, ...]]] = field(default_factory=list)

    def column(self) -> Column:
        score = F.lit(self.bias)
        for w, rule in self.weights:
            holds = reduce(lambda x, y: x & y, [(F.col(f"__f_{f}") > b) if above else (F.col(f"__f_{f}") <= b) for f, above, b in rule])
            score = score + F.when(holds, w).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-score))

    def score(self, x: dict[str, np.ndarray]) -> np.ndarray:
        total = np.full(len(next(iter(x.values()))), self.bias)
        for w, rule in self.weights:
            total += w * holds_in(rule, x)
        return 1 / (1 + np.exp(-total))


def holds_in(rule: tuple[Condition, ...], x: dict[str, np.ndarray]) -> np.ndarray:
    return reduce(np.logical_and, [(x[f] > b) if above else (x[f] <= b) for f, above, b in rule])


def _tree_rules(x: np.ndarray, bins: list[np.ndarray], y: np.ndarray, depth: int, rng: np.random.Generator, names: list[str]) -> list[tuple[Condition, ...]]:
    """Rules of a tree over binned statistics; each node's split has the least squared error among a random half of the statistics."""
    out: list[tuple[Condition, ...]] = []

    def grow(rows: np.ndarray, rule: tuple[Condition, ...]) -> None:
        if len(rule) >= depth or len(rows) < 40 or y[rows].min() == y[rows].max():
            return
        best = (1e-9, None)
        for f in rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]:
            if not len(bins[f]):
                continue
            code = x[rows, f]
            n = np.cumsum(np.bincount(code, minlength=len(bins[f]) + 1))[:-1]
            s = np.cumsum(np.bincount(code, weights=y[rows], minlength=len(bins[f]) + 1))[:-1]
            ok = (n >= 15) & (len(rows) - n >= 15)
            if ok.any():
                total = y[rows].sum()
                gain = np.where(ok, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(rows) - n, 1) - total**2 / len(rows), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if best[1] is None:
            return
        f, k = best[1]
        above = x[rows, f] > k
        for side in (False, True):
            new = (*rule, (names[f], side, float(bins[f][k])))
            out.append(new)
            grow(rows[above == side], new)

    grow(rng.permutation(len(y))[: max(60, len(y) // 2)], ())
    return out


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute-value penalty on all but the bias, by accelerated proximal gradient."""
    centre = r.mean(axis=0)
    scale = np.sqrt(np.maximum(centre * (1 - centre), 1e-4))
    z = ((r - centre) / scale).astype(np.float32)
    gram = np.linalg.norm(z.T @ z / len(y), 2) if z.shape[1] else 0.0
    rate = 4.0 / (gram + 1.0)
    w, v, b, bv, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 0.0, 0.0, 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(z @ v.astype(np.float32) + bv))) - y
        w1 = v - rate * (z.T @ g.astype(np.float32)) / len(y)
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - rate * penalty, 0)
        b1 = bv - rate * g.mean()
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, bv = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    w = w / scale
    return float(b - (w * centre).sum()), w


def fit_rules(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 30, depth: int = 3, strength: float = 0.08, seed: int = 4) -> Rules:
    """The rules for label ``y`` (0 or 1); with one class only, or no row, a score of 0. The lasso's penalty is ``strength`` times
    the root of log(rules) / rows, so that few rows don't make for rules that fit chance."""
    if not len(y) or y.min() == y.max():
        return Rules(-20.0)
    names = list(x)
    bins = [np.unique(np.quantile(x[f], np.linspace(0, 1, 41)[1:-1])) for f in names]
    bins = [np.unique(np.concatenate([b, [0.0]])) if x[f].min() <= 0 < x[f].max() else b[b < x[f].max()] for f, b in zip(names, bins)]
    code = np.stack([np.searchsorted(b, x[f], "left") for f, b in zip(names, bins)], axis=1)
    rng = np.random.Generator(np.random.PCG64(seed))
    rules = list(dict.fromkeys(r for _ in range(trees) for r in _tree_rules(code, bins, y.astype(float), depth, rng, names)))
    if not rules:
        return Rules(float(np.log(y.mean() / (1 - y.mean()))))
    held = np.stack([holds_in(r, x) for r in rules], axis=1).astype(np.float32)
    _, first = np.unique(held, axis=1, return_index=True)
    first.sort()
    bias, w = _lasso(held[:, first], y.astype(float), strength * np.sqrt(np.log(len(first) + 1) / len(y)))
    return Rules(bias, [(float(a), rules[k]) for a, k in zip(w, first.tolist()) if abs(a) > 1e-3])


@dataclass
class Classifier:
    lexicons: dict[str, list[str]]
    heads: dict[str, Rules]

    def scored(self, docs: DataFrame, carry: list[str]) -> DataFrame:
        """``carry`` with __low, __toxic (probabilities) and __good."""
        s = statistics(docs, self.lexicons, carry).withColumns({f"__{k}": self.heads[k].column() for k in HEADS})
        return s.select(*carry, "__low", "__toxic", ((F.col("__low") < 0.5) & (F.col("__toxic") < 0.5) & (F.col("__f_words") > 0)).alias("__good"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000, least_share: float = 0.01, seed: int = 4) -> Classifier:
    """Fits both heads on at most ``sample_rows`` labelled documents. A lexicon word has, in documents
    with the label, at least as many contexts as ``least_share`` of them, and 5 at least, and 20 times as many, in
    proportion to the documents, as in the others."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max((F.col("quality") == 0).cast("int")).alias("__y_low"), F.max((F.col("toxic") == 1).cast("int")).alias("__y_toxic"))
    picked = known.orderBy(F.xxhash64(F.lit(seed), "__id"), "__id").limit(sample_rows)
    sample = cut(docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(F.broadcast(picked), "__id"))  # sample_rows bounds what is broadcast
    listed = sample.select("__y_low", "__y_toxic", F.expr(WORDS.format("coalesce(text, '')")).alias("__ws"))
    listed = listed.select("__y_low", "__y_toxic", F.expr("sort_array(transform(__ws, (w, i) -> struct(w as w, if(i = 0, '', __ws[i - 1]) as before)))").alias("__ps"))
    listed = listed.select("__y_low", "__y_toxic", F.explode(F.expr("filter(__ps, (p, i) -> i = 0 or __ps[i - 1].w <> p.w)")).alias("__p"))
    contexts = listed.groupBy("__p").agg(*(F.min(f"__y_{k}").alias(k) for k in HEADS))
    counts = contexts.groupBy(F.col("__p.w").alias("__w")).agg(F.count("*").alias("n"), *(F.sum(k).alias(k) for k in HEADS))
    rows, *bad = sample.agg(F.count("*"), *(F.coalesce(F.sum(f"__y_{k}"), F.lit(0)) for k in HEADS)).first()
    lexicons: dict[str, list[str]] = {}
    for k, n in zip(HEADS, bad):
        if not 0 < n < rows:
            lexicons[k] = []
            continue
        often = F.col(k) >= max(5, least_share * n)
        rare = (F.col("n") - F.col(k)) / float(rows - n) * 20 <= F.col(k) / float(n)
        lexicons[k] = sorted(r[0] for r in counts.where(often & rare).select("__w").collect())
    frame = statistics(sample, lexicons, ["__id", "__y_low", "__y_toxic"]).select("__id", *(f"__y_{k}" for k in HEADS), *(f"__f_{f}" for f in NAMES)).orderBy("__id", *(f"__f_{f}" for f in NAMES)).toPandas()
    x = {f: frame[f"__f_{f}"].to_numpy(dtype=float) for f in NAMES}
    return Classifier(lexicons, {k: fit_rules(x, frame[f"__y_{k}"].to_numpy(dtype=int), seed=seed) for k in HEADS})


def good_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000) -> DataFrame:
    """(doc_id, low, toxic) of the documents kept, with their probabilities of being of low quality and toxic."""
    scored = fit(docs, labels, sample_rows).scored(docs, ["doc_id"])
    return scored.where("__good").select("doc_id", F.col("__low").alias("low"), F.col("__toxic").alias("toxic"))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000) -> DataFrame:
    """The documents kept, with the columns of ``docs``."""
    model = fit(docs, labels, sample_rows)
    packed = docs.select(packed_row(docs), "text")
    return model.scored(packed, ["__row"]).where("__good").select("__row.*")

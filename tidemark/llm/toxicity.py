"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Features of a whole text: densities of a fixed list of insults and of learned lexicons (words, word beginnings, summed log
odds), how close their hits stand to a second-person pronoun, rates of capitals,
punctuation, exclamations, obfuscated words and repeated letters. The lexicons, the trees
and the calibration are fitted on a bounded sample (``max_rows``) of labelled training
rows; what a training row is scored with while fitting never saw its own label
(cross-fitting). Everything else runs over all rows in Arrow batches.

Defined cases: a null or empty text has all features 0 and gets the score that these have;
a null doc_id counts as '' in the split; labels that are null are not learned from;
repeated rows are scored each; without labels of both kinds every score is the share of
toxic labels (0 if there are none); an empty table gives an empty result. Only doc_id and
text of the documents are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.blocks import released
from tidemark.llm.textnum import _BYTE, Words, _powers, mix64, slices
from tidemark.runtime import fresh

#: Second-person pronouns of the four languages.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split()
#: Common insults of the four languages; what else marks toxic texts is learned.
INSULTS = (
    "idiot idiots idiotic stupid moron morons dumb dumbass fool fools loser losers scum trash garbage worthless pathetic disgusting clown clowns "
    "jerk bastard bitch crap creep filth filthy freak imbecile lunatic maggot ugly vermin whore hate shit asshole fuck fucking "
    "idiotin dumm dummkopf trottel arschloch abschaum versager widerlich wertlos schwachkopf scheisse "
    "stupide crétin imbécile connard salaud minable dégoûtant abruti débile merde ordure "
    "idiota estúpido estúpida imbécil basura inútil patético asqueroso payaso cabrón mierda perdedor"
).split()
NEAR = 4
FOLDS = 5
FEATURES = ["seed", "words", "starts", "odds", "hits", "distinct", "near", "second", "capitals", "punctuation", "exclaims", "obfuscated", "repeats", "length", "foreign"]

_U = np.uint64
_PLAIN = np.zeros(256, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
for _digit, _letter in zip("013457@", "oieasta", strict=True):
    _PLAIN[ord(_digit)] = ord(_letter)
_ALPHA = np.zeros(256, bool)
_ALPHA[97:123] = True
_ALPHA[128:] = True


def _plain_hashes(words: Words, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' letters only (digits read as the letters they imitate), and of their first ``start`` bytes."""
    plain = _PLAIN[words.low]
    kept = plain > 0
    place = np.concatenate([[0], np.cumsum(kept)])
    a, b = place[words.start], place[words.end]
    up, down = _powers(len(kept))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[plain[kept]] * up[: int(place[-1])], dtype=_U)])

        def of(end: np.ndarray, salt: int) -> np.ndarray:
            return mix64((total[end] - total[a]) * down[a] + (end - a).astype(_U) * _U(salt))

        return of(b, 0x9E3779B97F4A7C15), of(np.minimum(b, a + start), 0xC2B2AE3D27D4EB4F)


def _listed(listed: list[str]) -> np.ndarray:
    data = " ".join(listed).encode()
    words = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return np.unique(_plain_hashes(words, 6)[0])


@dataclass
class Lexicon:
    """Hashes of words and of word beginnings with their log odds, sorted."""

    word: np.ndarray
    word_odds: np.ndarray
    start: np.ndarray
    start_odds: np.ndarray


def _look(table: np.ndarray, odds: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h))
    i = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[i] == h, odds[i], 0.0)


def features(data: np.ndarray, offsets: np.ndarray, lexicons: list[Lexicon], of_row: np.ndarray | None, start: int) -> np.ndarray:
    """One row of ``FEATURES`` for each text; ``of_row`` says which lexicon a row uses."""
    n = len(offsets) - 1
    w = Words(data, offsets)
    length = np.maximum(np.diff(offsets), 1)
    count = np.maximum(w.n, 1)
    full, begin = _plain_hashes(w, start)
    a, b = np.zeros(len(full)), np.zeros(len(full))
    for k, lex in enumerate(lexicons):
        of = slice(None) if of_row is None else np.flatnonzero(of_row[w.doc] == k)
        a[of], b[of] = _look(lex.word, lex.word_odds, full[of]), _look(lex.start, lex.start_odds, begin[of])
    seed = np.isin(full, _SEED)
    hit = (a > 0) | (b > 0) | seed
    you = np.isin(full, _YOU)
    at = np.where(you, np.arange(len(you)), -(10**9))
    last = np.maximum.accumulate(at) if len(at) else at
    coming = np.where(you, np.arange(len(you)), 10**12)
    following = np.minimum.accumulate(coming[::-1])[::-1] if len(at) else coming
    here = np.arange(len(you))
    gap = np.minimum(np.where((last >= 0) & (w.doc[np.maximum(last, 0)] == w.doc), here - last, 10**9), np.where((following < len(you)) & (w.doc[np.minimum(following, max(len(you) - 1, 0))] == w.doc), following - here, 10**9)) if len(you) else here

    def per(x: np.ndarray) -> np.ndarray:
        return np.bincount(w.doc, weights=x, minlength=n)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / length

    def inside(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[np.maximum(w.end - 1, w.start)] - total[np.minimum(w.start + 1, w.end)]

    alpha = _ALPHA[w.low]
    odd = ~alpha & (w.low > 32)
    # A letter, then something that is no letter, then a letter again.
    hidden = np.zeros(len(w.low), bool)
    if len(w.low) > 2:
        hidden[1:-1] = odd[1:-1] & alpha[:-2] & alpha[2:]
    again = np.zeros(len(w.low), bool)
    if len(w.low) > 2:
        again[2:] = alpha[2:] & (w.low[2:] == w.low[1:-1]) & (w.low[2:] == w.low[:-2])
    hits = per(hit)
    pairs = np.unique(np.stack([w.doc[hit].astype(_U), full[hit]]), axis=1)[0].astype(np.int64) if hit.any() else np.zeros(0, np.int64)
    return np.stack(
        [
            per(seed) / count,
            per(a > 0) / count,
            per(b > 0) / count,
            per(a + b) / count,
            np.log1p(hits),
            np.log1p(np.bincount(pairs, minlength=n)),
            per(hit & (gap <= NEAR)) / count,
            per(you) / count,
            share((data >= 65) & (data <= 90)),
            share(odd),
            share(data == 33),
            per(inside(hidden) > 0) / count,
            share(again),
            np.log1p(w.n),
            share(data >= 128),
        ],
        axis=1,
    )


_YOU, _SEED = _listed(SECOND_PERSON), _listed(INSULTS)


def learn_lexicon(units: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, rows: np.ndarray, least_odds: float, least_rows: int) -> Lexicon:
    """Words and beginnings whose document frequencies among ``rows`` have log odds of ``least_odds`` or more.

    ``units``: per kind, (row, hash) of every distinct unit of a row.
    """
    out: list[np.ndarray] = []
    n1, n0 = toxic[rows].sum(), (~toxic[rows]).sum()
    inside = np.zeros(len(toxic), bool)
    inside[rows] = True
    for row, unit in units:
        keep = inside[row]
        values, place = np.unique(unit[keep], return_inverse=True)
        c1 = np.bincount(place, weights=toxic[row[keep]], minlength=len(values))
        c0 = np.bincount(place, minlength=len(values)) - c1
        odds = np.log((c1 + 0.1) / (n1 + 0.2)) - np.log((c0 + 0.1 * n0 / max(n1, 1)) / (n0 + 0.2 * n0 / max(n1, 1)))
        good = (odds >= least_odds) & (c1 >= least_rows)
        out += [values[good], odds[good]]
    return Lexicon(*out)


@dataclass
class Trees:
    """Boosted trees of equal depth: split features and thresholds by level order, leaf values."""

    base: float
    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss with histogram splits."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    trees = Trees(float(np.log(share / (1 - share))), depth)
    cuts = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    margin = np.full(len(y), trees.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = (1e-6, 0, np.inf, bins + 1)
            if len(rows) >= 10:
                gs, hs = g[rows].sum(), h[rows].sum()
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    left_g = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
                    gain = left_g**2 / (left_h + ridge) + (gs - left_g) ** 2 / (hs - left_h + ridge) - gs**2 / (hs + ridge)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, float(c[k]), k)
            feature[at], cut[at] = best[1], best[2]
            node[rows] = 2 * at + 1 + (binned[rows, best[1]] > best[3])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        margin += value[leaf]
        trees.feature.append(feature)
        trees.cut.append(cut)
        trees.leaf.append(value)
    return trees


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (x, y) of the least-squares non-decreasing fit."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi in zip(x[order], y[order], strict=True):
        blocks.append([yi, 1.0, xi, xi])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            b, a = blocks.pop(), blocks.pop()
            n = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / n, n, a[2], b[3]])
    # One pseudo row on either side keeps the ends off 0 and 1.
    value = [(b[0] * b[1] + 0.5 * share) / (b[1] + 0.5) for b, share in ((b, float(y.mean())) for b in blocks)]
    value = list(np.maximum.accumulate(value))
    return np.array([x for b in blocks for x in (b[2], b[3])]), np.array([v for v in value for _ in (0, 1)])


@dataclass
class Model:
    lexicon: Lexicon | None
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    prior: float
    start: int

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(offsets) - 1, self.prior)
        margin = self.trees.margin(features(data, offsets, [self.lexicon], None, self.start))
        # The calibrated step function, with a trace of the margin to order rows within a step.
        score = np.interp(margin, *self.knots)
        return np.clip(score + 1e-4 * np.tanh(margin / 8), 0.0, 1.0)


def fit(texts: pa.Array, toxic: np.ndarray, start: int = 6, least_odds: float = 2.0, least_rows: int = 3) -> Model:
    """Learn from labelled texts; cross-fitting keeps a row's own label out of its features."""
    toxic = toxic.astype(bool)
    prior = float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < toxic.sum() < len(toxic):
        return Model(None, None, None, prior, start)
    parts: list[list[np.ndarray]] = [[], [], [], []]
    blocks, at = [], 0
    batch = pa.record_batch([texts], names=["text"])
    for _, data, offsets in slices(iter([batch])):
        w = Words(data, offsets)
        for k, h in enumerate(_plain_hashes(w, start)):
            order = np.lexsort((h, w.doc))
            d, u = w.doc[order], h[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (u[1:] != u[:-1])
            parts[2 * k].append(d[new] + at)
            parts[2 * k + 1].append(u[new])
        blocks.append((at, data, offsets))
        at += len(offsets) - 1
    flat = [np.concatenate(p) for p in parts]
    units = [(flat[0], flat[1]), (flat[2], flat[3])]
    fold = np.zeros(len(toxic), np.int64)
    for kind in (False, True):
        rows = np.flatnonzero(toxic == kind)
        fold[rows] = np.arange(len(rows)) % FOLDS
    lexicons = [learn_lexicon(units, toxic, np.flatnonzero(fold != k), least_odds, least_rows) for k in range(FOLDS)]
    x = np.concatenate([features(data, offsets, lexicons, fold[i : i + len(offsets) - 1], start) for i, data, offsets in blocks])
    y = toxic.astype(float)
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        margin[fold == k] = boost(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(learn_lexicon(units, toxic, np.arange(len(toxic)), least_odds, least_rows), boost(x, y), isotonic(margin, y), prior, start)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str | list[str], training: Column, max_rows: int) -> pa.Table:
    """text and label of at most ``max_rows`` labelled training rows, drawn by a hash of doc_id."""
    names = [label] if isinstance(label, str) else label
    rated = labels.select(F.col("doc_id").alias("rated_id"), *names).dropna().filter(training)
    n = rated.count()
    if n > max_rows:
        rated = rated.filter(F.pmod(F.xxhash64("rated_id", F.lit(17)), F.lit(1 << 30)) < int(0.95 * max_rows / n * (1 << 30)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(rated, F.col("doc_id") == F.col("rated_id"))
    return rows.select("doc_id", "text", *names).limit(max_rows).toArrow().sort_by("doc_id")


def scorer(model: Model, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole rows with the score of their text as column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            rest = [rows.column(i) for i in range(rows.num_columns)]
            yield pa.record_batch([*rest, pa.array(model.score(data, offsets))], names=[*rows.schema.names, name])

    return run


def fit_on(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> Model:
    table = sample_labelled(docs, labels, "toxic", remainder(F.col("rated_id"), 3) != 1, max_rows)
    return fit(table.column("text").combine_chunks(), table.column("toxic").to_numpy() == 1)


def score(spark: SparkSession, docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = docs.select("doc_id", "text").mapInArrow(released(_scores(model)), "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def _scores(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches):
            yield pa.record_batch([rows.column(0).cast(pa.int64()), pa.array(model.score(data, offsets))], names=["doc_id", "score"])

    return run


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, limit: float = 0.7) -> DataFrame:
    """The documents, whole and with all their columns, whose score stays under ``limit``."""
    model = fit_on(spark, docs, labels)
    name = fresh(docs, "score")
    scored = docs.mapInArrow(released(scorer(model, name)), f"{_ddl(docs)}, `{name}` double")
    return scored.filter(F.col(name) < limit).drop(name)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

"""Personal data: format patterns, and boosted trees over high-recall candidates.

Generators propose spans that may overlap: spelled-out e-mail addresses, phone
numbers without a country code (ten digits in any of the usual groupings), social
security numbers and account numbers (IBAN). Each candidate gets format features (digits,
letters, separators, borders) and context features (cue words before it). Small
regression trees, boosted on the logistic loss over labelled samples, give a
score; Platt scaling on held-out samples makes it a probability, and those samples
set a threshold per kind. On executors the forest is one SQL expression.
"""

from __future__ import annotations

import math
import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_of
from graphloom.llm.spans import around, chains, free_of, joined, let, no_places, overlaps, places, tagged, windows

#: The leftmost matches of these are those of the plain patterns (see the tests): a run is entered at its start, or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"

#: Kind, generator, cue words. Each generator also needs what its guard tests, so most texts skip it.
GENERATORS = (
    ("spelled_email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?i:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]++(?: ?(?i:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]++)++", ("mail", "contact", "write", "reach")),
    ("local_phone", r"(?<![0-9+])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])", ("phone", "tel", "call", "mobile", "fax", "cell")),
    ("ssn", r"(?<![0-9])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9])", ("ssn", "social", "security")),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", ("iban", "account", "bank", "konto", "compte", "cuenta")),
)
FEATURES = ("kind", "length", "digits", "letters", "separators", "brackets", "cue", "inside_number", "spelled")
CONTEXT = 32
#: Labelled samples that train the forest, and that calibrate it: the bounds of both sets.
TRAIN, CALIBRATE = 3000, 1500
TREES, RATE = 24, 0.3
#: A kind's threshold is the lowest, from even odds on, above which this share of its calibration samples is personal data.
PRECISION = 0.9


def features_text(kind: int, before: str, hit: str, after: str) -> list[float]:
    """The features in plain Python; ``features`` is the same in SQL."""
    window = before[-CONTEXT:].lower()
    return [
        kind, len(hit), sum(c in "0123456789" for c in hit), len(re.findall("[A-Za-z]", hit)), sum(c in " .-" for c in hit), sum(c in "()[]{}" for c in hit),
        float(any(w in window for w in GENERATORS[kind][2])), float(bool(re.search(r"[0-9][-./ ]?$", before[-2:])) or bool(re.match(r"[-./]?[0-9]", after[:2]))), float(bool(re.search(r"[(\[{]at|[(\[{]dot| dot ", hit))),
    ]


def features(kind: int, before: Column, hit: Column, after: Column) -> list[Column]:
    count = lambda chars: F.char_length(hit) - F.char_length(F.translate(hit, chars, ""))
    window = F.lower(F.right(before, F.lit(CONTEXT)))
    cue = F.lit(False)
    for word in GENERATORS[kind][2]:
        cue = cue | window.contains(word)
    number = F.right(before, F.lit(2)).rlike(r"[0-9][-./ ]?$") | F.substring(after, 1, 2).rlike(r"^[-./]?[0-9]")
    values = [
        F.lit(kind), F.char_length(hit), count("0123456789"), F.regexp_count(hit, F.lit("[A-Za-z]")), count(" .-"), count("()[]{}"),
        cue, number, hit.rlike(r"[(\[{]at|[(\[{]dot| dot "),
    ]
    return [v.cast("int").cast("double") for v in values]


def labelled_samples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Half personal data in its usual surroundings, half look-alikes (versions, order numbers, sums, dates)."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    filler = lambda: " ".join(word() for _ in range(rng.randint(2, 6)))
    xs, ys = [], []
    for _ in range(n):
        kind, good = rng.randrange(4), rng.random() < 0.5
        cue = rng.random() < (0.75 if good else 0.08)
        before = f"{filler()} {rng.choice(GENERATORS[kind][2]) + ': ' if cue else word() + ' '}"
        after = rng.choice((" ", ".", ",", "\n", "")) + filler()
        if kind == 0:
            at, dot = rng.choice((("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", "."))) if good else (" at ", ".")
            hit = word() + at + word() + dot + (rng.choice(("com", "org", "net", "de")) if good else word())
        elif kind == 1:
            sep = rng.choice(" .-")
            hit = (f"({digits(3)}) {digits(3)}-{digits(4)}" if rng.random() < 0.5 else digits(3) + sep + digits(3) + sep + digits(4)) if good and rng.random() < 0.8 else digits(10) if good or rng.random() < 0.5 else digits(6) + rng.choice(" .-") + digits(4)
        elif kind == 2:
            hit = f"{digits(3)}-{digits(2)}-{digits(4)}" if good else f"{digits(3)} {digits(2)} {digits(4)}"
        else:
            groups = rng.randint(3, 6)
            hit = (rng.choice(("DE", "FR", "GB", "ES", "NL")) + digits(2) + "".join(rng.choice(("", " ")) + digits(4) for _ in range(groups))) if good else rng.choice("ABCDEFGH") * 2 + digits(2) + "".join(rng.choice("ABCDEFGHXYZ") for _ in range(8))
        if not good and rng.random() < 0.5:
            before, after = before + digits(2) + rng.choice("-./"), rng.choice("-./") + digits(2) + after
        xs.append(features_text(kind, before, hit, after))
        ys.append(float(good))
    return np.array(xs), np.array(ys)


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int) -> tuple | float:
    """A regression tree: (feature, threshold, left if <=, right), leaves are Newton steps."""
    leaf = float(gradient.sum() / (hessian.sum() + 1.0))
    if depth == 0 or len(x) < 20:
        return leaf
    gain = lambda g, h: g * g / (h + 1.0)
    best, whole = (1e-6, None, None), gain(gradient.sum(), hessian.sum())
    for f in range(x.shape[1]):
        for t in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= t
            g = gain(gradient[left].sum(), hessian[left].sum()) + gain(gradient[~left].sum(), hessian[~left].sum()) - whole
            if g > best[0]:
                best = (g, f, float(t) + 0.5)
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[left], gradient[left], hessian[left], depth - 1), _grow(x[~left], gradient[~left], hessian[~left], depth - 1))


def _leaf(tree: tuple | float, row: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@cache
def forest(seed: int = 11) -> tuple[list, float, float, list[float]]:
    """(trees, slope, offset, threshold per kind): probability = sigmoid(slope * sum of leaves + offset)."""
    x, y = labelled_samples(TRAIN, seed)
    total, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        tree = _grow(x, y - p, p * (1 - p), 3)
        trees.append(tree)
        total += RATE * np.array([_leaf(tree, row) for row in x])
    hx, hy = labelled_samples(CALIBRATE, seed + 1)
    margin = np.array([RATE * sum(_leaf(t, row) for t in trees) for row in hx])
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton on the two parameters of Platt's sigmoid
        p = 1 / (1 + np.exp(-(slope * margin + offset)))
        w = p * (1 - p) + 1e-6
        g = np.array([((hy - p) * margin).sum() - 1e-3 * (slope - 1), (hy - p).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        slope, offset = slope + float(step[0]), offset + float(step[1])
    p, thresholds = 1 / (1 + np.exp(-(slope * margin + offset))), []
    for kind in range(len(GENERATORS)):
        of = hx[:, 0] == kind
        order = np.argsort(-p[of], kind="stable")
        ranked, right = p[of][order], np.cumsum(hy[of][order]) / np.arange(1, of.sum() + 1)
        # Cut between different probabilities only.
        ends = np.flatnonzero((right >= PRECISION) & np.append(ranked[:-1] > ranked[1:], True))
        thresholds.append(max(0.5, round(float(ranked[ends[-1]]), 9) - 1e-9) if len(ends) else 1.0)
    return trees, slope, offset, thresholds


def probability_text(row: list[float]) -> float:
    trees, slope, offset, _ = forest()
    return 1 / (1 + math.exp(-(slope * RATE * sum(_leaf(t, row) for t in trees) + offset)))


def probability(values: list[Column]) -> Column:
    trees, slope, offset, _ = forest()

    def expression(tree: tuple | float) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        return F.when(values[tree[0]] <= tree[1], expression(tree[2])).otherwise(expression(tree[3]))

    total = F.lit(0.0)
    for tree in trees:
        total = total + expression(tree)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(total * (slope * RATE) + offset)))


def _selected(candidates: Column, text: Column, kind: int) -> Column:
    """Candidates of one kind with their probability, those above the threshold."""

    def seen(x: Column, parts: Column) -> Column:
        before, after = around(parts, x["start"], CONTEXT, 0), around(parts, x["end"], 0, 2)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.array(*features(kind, before, x["hit"], after)).alias("f"))

    def scored(x: Column) -> Column:
        p = probability([F.get(x["f"], i) for i in range(len(FEATURES))])
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(GENERATORS[kind][0]).alias("kind"), F.lit(4 + kind).alias("order"), p.alias("p"))

    some = let(candidates, lambda found: F.when(F.size(found) > 0, let(windows(text), lambda parts: F.transform(found, lambda x: seen(x, parts)))))
    return F.filter(F.transform(some, scored), lambda x: x["p"] > forest()[3][kind])


def with_personal_data(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds _email, _ip, _card, _phone (the patterns' valid matches) and _more: array<struct<start, end, kind, order>> of the model's."""
    column = text_of(text)
    digit = column.rlike("[0-9]")
    plain = lambda hit, drop: F.char_length(F.translate(hit, drop, ""))
    where = lambda test, found: F.when(test, found).otherwise(no_places())
    small = lambda p: F.coalesce(p.try_cast("bigint"), F.lit(256)) <= 255
    df = df.withColumns({
        "_email": where(column.contains("@"), places(column, EMAIL)),
        "_ip": where(column.rlike(r"[0-9]\.[0-9]"), F.filter(places(column, IP), lambda x: F.forall(F.split(x["hit"], r"\."), small))),
        "_card": where(digit, F.filter(places(column, CARD), lambda x: plain(x["hit"], " -").between(12, 19) & F.call_function("luhn_check", F.translate(x["hit"], " -", "")))),
        "_phone": where(column.contains("+"), F.filter(places(column, PHONE), lambda x: plain(x["hit"], " ().+-").between(9, 15))),
    })
    guards = (column.rlike(r"(?i)[({\[]at[)}\]]| at [A-Za-z0-9-]+ ?(?:[.({\[]| dot )"), column.rlike("[0-9]{3}[ .-]?[0-9]{4}"), column.rlike("[0-9]{3}[- ][0-9]{2}[- ]"), column.rlike("[A-Z]{2}[0-9]{2}"))
    base = F.concat("_email", "_ip", "_card", "_phone")
    found = []
    for kind, guard in enumerate(guards):
        fresh = free_of(places(column, GENERATORS[kind][1]), base)
        found.append(F.when(guard, _selected(fresh, column, kind)))
    df = df.withColumn("_candidates", F.concat(*[F.coalesce(f, F.expr("cast(array() as array<struct<start:bigint,end:bigint,kind:string,order:int,p:double>>)")) for f in found]))
    # Of a chain of overlapping candidates the likeliest is kept, then the likeliest of those that overlap none kept, and so on; ties go to the first by start and kind.
    ranked = lambda chain: F.sort_array(F.transform(chain, lambda x: F.struct((-x["p"]).alias("rank"), x["start"].alias("start"), x["order"].alias("order"), x["end"].alias("end"), x["kind"].alias("kind"))))
    span = lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["end"].alias("end"), x["kind"].alias("kind"))
    none = F.expr("cast(array() as array<struct<start:bigint,order:int,end:bigint,kind:string>>)")
    kept = F.transform(chains(F.col("_candidates")), lambda chain: F.aggregate(ranked(chain), none, lambda acc, x: F.when(F.exists(acc, lambda y: overlaps(x, y)), acc).otherwise(F.array_append(acc, span(x)))))
    return df.withColumn("_more", F.when(F.size("_candidates") > 0, F.flatten(kept)).otherwise(none)).drop("_candidates")


def scan(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: counts, base digest, all spans. A null or empty text has no spans; equal rows give equal results.

    A long text takes time in proportion; only a chain of overlapping candidates is compared pair by pair.
    """
    found = with_personal_data(df.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")))
    kinds = ("email", "ip", "card", "phone")
    base = F.concat(*[tagged(F.col(f"_{k}"), k, i) for i, k in enumerate(kinds)])
    return found.select("doc_id", *[F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in kinds], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, F.col("_more"))).alias("spans"))

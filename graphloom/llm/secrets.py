"""Secret scans: keyword and format patterns, and character Markov models for the rest.

Two first-order models over the characters of a token, one of random strings and
one of ordinary identifiers, are trained from labelled samples. A token's score
is the mean log-likelihood ratio per character pair; tokens above a threshold, set on held-out
samples, are spans of kind ``random``. On executors the models are one constant array of
doubles and the score is a SQL fold over the token.
"""

from __future__ import annotations

import math
import random
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_of
from graphloom.llm.spans import chains, cut_out, free_of, joined, no_places, places, tagged

#: Leftmost matches equal those of the plain patterns: what is possessive can't give anything back that would help.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']? *+[:=] *+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
#: Tokens of 20 characters or more that hold a digit and a letter.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}+"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-"
SIDE = len(ALPHABET) + 1
#: Share of held-out samples of a class that may lie beyond its edge; the threshold is midway between the edges.
BEYOND = 0.002
#: Labelled samples per class: the bound of the training set.
SAMPLES = 4000

_WORDS = (
    "account action active address admin agent alert alias amount api app archive array asset async auth backup balance base batch block board body branch buffer build "
    "bundle button cache call cancel card cart case catalog category center channel chart check child city class clean click client clone close cloud cluster code collect "
    "color column command comment commit common compare complete config connect console contact content context control convert cookie copy core count country create "
    "credit currency current custom daily dashboard data database date debug default delete deploy design detail device dialog digest disk display document domain download "
    "driver edit editor element email enable encode end engine entity entry error event example exception export express extra factory fail fast feature feed fetch field "
    "file filter final find first flag float folder follow font footer force form format forward frame function future gateway general global grant graph grid group guard "
    "guest handle hash head header health height help history home host hour html icon image import index info init inner input insert install instance integer internal "
    "invoice item job join journal key kind label language large last launch layer layout leader level library license limit line link list listen load local location lock "
    "logger login logout loop machine mail main manager map mark master match media member memory menu merge message meta method metric middle minute mobile mode model "
    "module monitor month mount move multi name native network next node normal note notify number object offset online open option order origin output owner package page "
    "panel parent parse partner password path pattern payment pending phone picture pipeline place plan platform player plugin point policy pool port post power prefix "
    "preview price print private process product profile progress project promise property protocol provider proxy public push query queue quick random range rate reader "
    "record redirect reference refresh region register release remote remove render repeat replace report request reset resource response restore result return review role "
    "root route row rule run sample save scale schedule schema scope score screen script search second section select send sequence server service session set setting shape "
    "share shell shift short show signal simple single size slot small socket sort source space split stack stage start state static status step stop storage store stream "
    "string strong style submit success suffix summary support switch symbol sync system table target task team template test text theme thread ticket time title total track "
    "trade traffic transfer tree trigger type union unit update upload user utility valid value vector version video view visit wait warning watch weather web week widget "
    "width window wizard word worker wrapper write year zone"
).split()


def random_string(rng: random.Random) -> str:
    alphabet = rng.choice(("0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[26:62]))
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(20, 64)))


def ordinary_identifier(rng: random.Random) -> str:
    words = [rng.choice(_WORDS) for _ in range(rng.randint(3, 7))]
    style = rng.randrange(6)
    if style == 0:
        out = words[0] + "".join(w.title() for w in words[1:])
    elif style == 1:
        out = "".join(w.title() for w in words)
    else:
        out = ("_", "-", "/", "_")[style - 2].join(w.upper() if style == 5 else w for w in words)
    if rng.random() < 0.6:
        out += rng.choice(("", "_", "-", "v")) + str(rng.randint(0, 9999))
    if rng.random() < 0.1:
        out += f"-{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    return out


def _log_transitions(samples: list[str]) -> list[list[float]]:
    counts = [[0.2] * SIDE for _ in range(SIDE)]
    at = {c: i + 1 for i, c in enumerate(ALPHABET)}
    for s in samples:
        for a, b in zip(s, s[1:], strict=False):
            counts[at.get(a, 0)][at.get(b, 0)] += 1
    return [[math.log(x / sum(row)) for x in row] for row in counts]


@cache
def ratio_table(samples: int = SAMPLES, seed: int = 7) -> list[float]:
    """log P(next | char, random) - log P(next | char, ordinary), flat by row."""
    rng = random.Random(seed)
    odd = _log_transitions([random_string(rng) for _ in range(samples)])
    plain = _log_transitions([ordinary_identifier(rng) for _ in range(samples)])
    return [round(x - y, 4) for r, q in zip(odd, plain, strict=True) for x, y in zip(r, q, strict=True)]


@cache
def threshold(samples: int = SAMPLES, seed: int = 19) -> float:
    """Midway between what nearly all held-out identifiers stay below and what nearly all held-out random strings reach."""
    rng, table = random.Random(seed), ratio_table()
    plain = sorted(score_text(t, table) for t in (ordinary_identifier(rng) for _ in range(samples)) if len(t) >= 20)
    odd = sorted(score_text(random_string(rng), table) for _ in range(samples))
    return round((plain[int(len(plain) * (1 - BEYOND)) - 1] + odd[int(len(odd) * BEYOND)]) / 2, 4)


def score_text(token: str, table: list[float] | None = None) -> float:
    """The same score in plain Python, for tests."""
    table = table or ratio_table()
    at = [ALPHABET.find(c) + 1 for c in token]
    return sum(table[a * SIDE + b] for a, b in zip(at, at[1:], strict=False)) / max(1, len(token) - 1)


def score(token: Column) -> Column:
    """Mean log-likelihood ratio of a token's character pairs."""
    table = F.from_json(F.lit(str(ratio_table())), F.lit("array<double>"))
    chars = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    total = F.aggregate(chars, F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")), lambda acc, c: F.struct(c.alias("last"), F.when(acc["last"] < 0, 0.0).otherwise(acc["sum"] + F.get(table, acc["last"] * SIDE + c)).alias("sum")), lambda acc: acc["sum"])
    return total / F.greatest(F.lit(1), F.char_length(token) - 1)


def with_secrets(df: DataFrame, text: str = "text", prefix: str = "_") -> DataFrame:
    """Adds <prefix>assign, access, hex, random: arrays of places in the whole text.

    The first three are the patterns' own matches. ``random`` are tokens that the
    models take for random and that no pattern covers.
    """
    column = text_of(text)
    lower = F.lower(column)
    keyword = lower.contains("passw") | lower.contains("secret") | lower.contains("token") | lower.contains("api")
    df = df.withColumns({
        f"{prefix}assign": F.when(keyword, F.filter(places(column, ASSIGN, 1), lambda x: F.char_length(x["part"]) >= 8)).otherwise(no_places()),
        f"{prefix}access": F.when(column.contains("AKIA"), places(column, ACCESS)).otherwise(no_places()),
        f"{prefix}hex": places(column, HEX),
        f"{prefix}token": places(column, TOKEN),
    })
    base = F.concat(f"{prefix}assign", f"{prefix}access", f"{prefix}hex")
    fresh = F.filter(free_of(F.col(f"{prefix}token"), base), lambda t: score(t["hit"]) > threshold())
    return df.withColumn(f"{prefix}random", fresh).drop(f"{prefix}token")


def scan(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: counts, base digest and all spans.

    A null or empty text has no spans; equal rows give equal results. A long text takes time in proportion.
    """
    found = with_secrets(df.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")))
    base = F.concat(tagged(F.col("_assign"), "assign", 0), tagged(F.col("_access"), "access", 1), tagged(F.col("_hex"), "hex", 2))
    return found.select(
        "doc_id",
        F.size("_assign").cast("bigint").alias("n_assign"), F.size("_access").cast("bigint").alias("n_access"), F.size("_hex").cast("bigint").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, tagged(F.col("_random"), "random", 3))).alias("spans"),
    )


def redact(df: DataFrame, text: str = "text", mask: str = "[SECRET]", count: str | None = None) -> DataFrame:
    """Replaces every span by ``mask``; overlapping or touching spans become one mask.

    A text without spans, null included, stays as it is. ``count`` names a column
    of text lengths to bring up to date where the text changes.
    """
    columns = df.columns
    df = df.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    df = with_secrets(df, "_text")
    spans = F.transform(F.concat("_assign", "_access", "_hex", "_random"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    masked = F.transform(chains(spans, touching=True), lambda c: F.struct(c[0]["start"].alias("start"), F.array_max(F.transform(c, lambda x: x["end"])).alias("end")))

    out = F.when(F.size(spans) == 0, F.col("_text")).otherwise(cut_out(F.col("_text"), masked, mask))
    df = df.select("_row", F.size(spans).alias("_spans"), out.alias("_out"))
    length = F.when(F.col("_spans") > 0, F.char_length("_out").cast("bigint"))
    values = {text: F.col("_out")} | ({count: F.coalesce(length, F.col("_row")[count])} if count else {})
    return df.select(*[values.get(c, F.col("_row")[c]).alias(c) for c in columns])

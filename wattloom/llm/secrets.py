"""Secrets in texts: fixed patterns and character Markov models (operator 8), with DataFrame functions only.

Base kinds are patterns: assignments to secret names, access keys, long hexadecimal runs. The method adds runs of token
characters that look random: two first-order character models are trained, one of random strings (labelled: the values
the patterns found), one of ordinary identifiers (labelled: token runs of at least `MIN_IDENTIFIER` characters that no
pattern touches). A run of at least `MIN_TOKEN` characters is a secret if the log-likelihood ratio of the two, per
transition, is above `MIN_RATIO` (below 0, since a missed secret costs more than a false one; ordinary long words lie
under -1.8). Four fifths of the random model are uniform, since secrets need not use the samples' alphabet.

All texts train the models; what comes back to the driver are the 2 x 64 x 64 transition counts. The ratios are one
array literal, indexed by both characters' codes.

Positions are code points, ends exclusive. They follow from the lengths of the pieces between matches, since splitting
and extracting visit the same matches.

Defined cases: a null text is empty and holds nothing; without any random string or identifier to learn from, nothing is
added; repeated rows agree; very long texts are scanned whole.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, functions as F

MIN_ASSIGNED = 6
MIN_IDENTIFIER = 12
MIN_TOKEN = 20
MIN_RATIO = -0.75
SMOOTHING = 0.5
UNIFORM = 0.8
# Fixed values of the contract; a match of the first that assigns fewer than 6 characters is dropped after matching.
NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
HEAD = rf"""({NAMES})["']?\x20*[:=]\x20*["']?"""
ASSIGN = HEAD + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_-]"
KINDS = ("assign", "access", "hex", "random")
SPAN = "struct<start:int,rank:int,end:int,value:string>"
# 64 symbols: digits, capitals, small letters, then + and - as one, / and _ as one.
SYMBOLS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"
_SIZE = len(SYMBOLS)


def _empty() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def found(text: Column, pattern: str, rank: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of a pattern's matches (leftmost, not overlapping) as structs, in order."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["hit"].alias("value"))
        wanted = x["hit"].isNotNull() if keep is None else x["hit"].isNotNull() & keep(x["hit"])
        return F.struct(
            F.coalesce(end, start).alias("at"),
            F.when(wanted, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    pieces = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), _empty().alias("spans"))
    spans = F.aggregate(pieces, start, lambda s, x: step(s, x).cast(f"struct<at:int,spans:array<{SPAN}>>"), lambda s: s["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(_empty())


def _assigned(hit: Column) -> Column:
    return F.regexp_replace(hit, "^" + HEAD, "")


def base_spans(text: Column) -> Column:
    long_enough = lambda hit: F.length(_assigned(hit)) >= MIN_ASSIGNED
    return F.array_sort(F.concat(found(text, ASSIGN, 1, long_enough), found(text, ACCESS, 2), found(text, HEX, 3)))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, text, base spans and the token runs that may be identifiers or secrets."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"))
    return rows.withColumn("base", base_spans(F.col("_text")))


def _codes(value: Column) -> Column:
    """Symbol numbers of a token's characters."""
    one = F.translate(value, "-_", "+/")
    return F.transform(F.split(one, ""), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)


def _transitions(codes: Column) -> Column:
    pairs = F.arrays_zip(codes.alias("a"), F.slice(codes, 2, 1_000_000_000).alias("b"))
    pairs = F.filter(pairs, lambda p: p["a"].between(0, _SIZE - 1) & p["b"].between(0, _SIZE - 1))
    return F.transform(pairs, lambda p: p["a"] * _SIZE + p["b"])


def transition_counts(rows: DataFrame) -> DataFrame:
    """random (boolean), transition, n: over the labelled samples of all texts."""
    secret = F.transform("base", lambda s: F.struct(F.lit(True).alias("random"), F.when(s["rank"] == 1, _assigned(s["value"])).otherwise(s["value"]).alias("value")))
    # Identifiers are taken from what the patterns leave.
    left = F.regexp_replace(F.regexp_replace(F.regexp_replace("_text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    runs = F.regexp_extract_all(left, F.lit(f"{TOKEN}{{{MIN_IDENTIFIER},}}"), F.lit(0))
    ordinary = F.transform(runs, lambda v: F.struct(F.lit(False).alias("random"), v.alias("value")))
    words = rows.select(F.explode(F.concat(secret, ordinary)).alias("w")).select("w.random", "w.value")
    words = words.groupBy("random", "value").agg(F.count(F.lit(1)).alias("n"))
    pairs = words.select("random", F.explode(_transitions(_codes(F.col("value")))).alias("transition"), "n")
    return pairs.groupBy("random", "transition").agg(F.sum("n").alias("n"))


def ratios(counts: DataFrame, smoothing: float = SMOOTHING) -> list[float]:
    """Log of the two models' transition probabilities' ratio, for every transition."""
    n = {True: [0] * _SIZE**2, False: [0] * _SIZE**2}
    for row in counts.collect():  # at most 2 x 64 x 64 rows
        n[row["random"]][row["transition"]] = row["n"]
    if not (sum(n[True]) and sum(n[False])):
        return [float("-inf")] * _SIZE**2
    out = []
    for a in range(_SIZE):
        here = slice(a * _SIZE, (a + 1) * _SIZE)
        total = {kind: sum(n[kind][here]) + smoothing * _SIZE for kind in n}
        for r, o in zip(n[True][here], n[False][here]):
            random = UNIFORM / _SIZE + (1 - UNIFORM) * (r + smoothing) / total[True]
            out.append(log(random) - log((o + smoothing) / total[False]))
    return out


def score(value: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per transition; above 0: rather random."""
    table = F.array(*[F.lit(x) for x in model])
    steps = F.transform(_transitions(_codes(value)), lambda t: F.get(table, t))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.length(value) - 1, F.lit(1))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    text = lambda s: F.concat_ws(":", F.get(kinds, s["rank"] - 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def secrets(docs: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (kind:start:end) and n_random of every document."""
    rows = scanned(docs)
    model = ratios(transition_counts(rows))
    runs = found(F.col("_text"), f"{TOKEN}{{{MIN_TOKEN},}}", 4)
    rows = rows.withColumn("_runs", runs)
    apart = F.filter(
        "_runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
    )
    rows = rows.withColumn("_apart", apart)
    rows = rows.withColumn("random", F.filter("_apart", lambda r: score(r["value"], model) > min_ratio))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["rank"] == k)).cast("long")
    return rows.select(
        "doc_id",
        of_kind(1).alias("n_assign"),
        of_kind(2).alias("n_access"),
        of_kind(3).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "random"))).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )

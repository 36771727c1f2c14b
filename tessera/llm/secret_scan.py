"""Secret scan: fixed patterns, and a randomness test battery for tokens that no pattern names.

All of it is DataFrame and SQL expressions.

Patterns. ``regexp_extract_all`` gives the leftmost non-overlapping matches, ``split`` on the same
pattern the text between them; their running lengths are the code point positions.

Battery. Candidates are runs of 20 or more characters that a key could consist of. The encoding is
inferred from the characters used (digits, hex, base32, letters, base64 ...), and three tests ask
whether the token could be uniform over that alphabet: chi-squared of the character counts, Wald-Wolfowitz
runs above and below the alphabet's middle, and the correlation of neighbours. Fisher's method
combines the three p-values into a score: near 0 for words, spread over 0..1 for random keys.

False-discovery control by length. Short words pass such tests more easily than long ones, so the score
a word reaches is counted for each length band on decoys: all characters of every whole text that a candidate
may have, cut into consecutive pieces of the bands' lengths in turn, so that each character is in one. A candidate's
p-value is the share of its band's decoys that score at least as high; Benjamini and Hochberg's
procedure over the band's candidates, on a histogram of 1,000 score bins, gives the lowest score at which
the expected share of words among the discoveries is at most ``RATE``.

Null text reads as empty; a null id is carried through; repeated rows each get their own row; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import durable

#: The patterns of the base kinds, in order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters or more: a shorter run has no longer match inside
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
PART = r"[A-Za-z0-9+/_=-]+"
BANDS = (20, 24, 32, 48)
RATE = 0.01
BINS = 1000

_LOW = "abcdefghijklmnopqrstuvwxyz"
_UP = _LOW.upper()
_NUM = "0123456789"
#: Code of the character that stands for an alphabet's first one; the others follow.
_ZERO = 48
#: encoding -> (pattern of a whole token, alphabet); the first that fits is taken.
ENCODINGS = {
    "decimal": ("[0-9]+", _NUM),
    "hex": ("[0-9a-f]+", _NUM + "abcdef"),
    "hex_upper": ("[0-9A-F]+", _NUM + "ABCDEF"),
    "lower": ("[a-z]+", _LOW),
    "upper": ("[A-Z]+", _UP),
    "base32": ("[A-Z2-7]+", _UP + "234567"),
    "base36": ("[a-z0-9]+", _NUM + _LOW),
    "base36_upper": ("[A-Z0-9]+", _NUM + _UP),
    "letters": ("[A-Za-z]+", _UP + _LOW),
    "base62": ("[A-Za-z0-9]+", _UP + _LOW + _NUM),
    "base64": ("[A-Za-z0-9+/]+", _UP + _LOW + _NUM + "+/"),
    "base64url": ("[A-Za-z0-9_-]+", _UP + _LOW + _NUM + "-_"),
    "mixed": ("[A-Za-z0-9+/_=-]+", _UP + _LOW + _NUM + "+/-_="),
}


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _positions(text: str, found: str, pattern: str) -> str:
    """SQL: (start, end) of each match, from the matches and the text between them."""
    start = "a.at + length(a.parts[a.i])"
    return (f"aggregate({found}, named_struct('at', 0, 'i', 0, 'parts', split({text}, {_literal(pattern)}, -1), "
            "'out', cast(array() as array<struct<start:int,end:int>>)), "
            f"(a, m) -> named_struct('at', {start} + length(m), 'i', a.i + 1, 'parts', a.parts, "
            f"'out', concat(a.out, array(named_struct('start', {start}, 'end', {start} + length(m))))), a -> a.out)")


def _spans(rows: DataFrame, kind: str, pattern: str) -> DataFrame:
    """``kind``: array of (start, end); texts without a match are searched once and not split."""
    found = rows.withColumn("_m", F.expr(f"regexp_extract_all(text, {_literal(pattern)}, 0)"))
    none = "cast(array() as array<struct<start:int,end:int>>)"
    return found.withColumn(kind, F.expr(f"CASE WHEN size(_m) = 0 THEN {none} ELSE {_positions('text', '_m', pattern)} END")).drop("_m")


def _assigned(rows: DataFrame) -> DataFrame:
    """Assignments: matches whose value has six characters or more; shorter ones are found and dropped."""
    rows = _spans(rows, "assign", ASSIGN)
    value = f"regexp_extract_all(text, {_literal(ASSIGN)}, 2)"
    return rows.withColumn("assign", F.expr(
        f"CASE WHEN size(assign) = 0 THEN assign ELSE filter(zip_with(assign, {value}, (s, v) -> if(length(v) >= 6, s, null)), s -> s is not null) END"))


def battery(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Adds ``encoding`` and ``score``, the combined p-value of the three tests (0 where none fits)."""
    fit = size = index = halves = None
    t = F.rtrim(F.col(token), F.lit("="))
    t = F.when(F.length(t) >= 8, t).otherwise(F.lit("00000000"))  # too short to test: scores 0
    for name, (pattern, alphabet) in ENCODINGS.items():
        k, ok, is_ = len(alphabet), F.col("_t").rlike(f"^{pattern}$"), F.col("encoding") == name
        coded = F.translate("_t", alphabet, "".join(chr(_ZERO + i) for i in range(k)))
        half = F.translate("_t", alphabet, "".join("H" if 2 * i >= k else "L" for i in range(k)))
        fit = F.when(ok, name) if fit is None else fit.when(ok, name)
        size = F.when(is_, float(k)) if size is None else size.when(is_, float(k))
        index = F.when(is_, coded) if index is None else index.when(is_, coded)
        halves = F.when(is_, half) if halves is None else halves.when(is_, half)
    df = tokens.withColumn("_t", t).withColumn("encoding", fit).withColumns({"_k": size, "_u": index, "_halves": halves})
    df = df.withColumn("_c", F.split("_u", ""))
    df = df.withColumn("_x", F.expr(f"transform(_c, c -> cast(ascii(c) - {_ZERO} as double))"))
    df = df.withColumn("_n", F.length("_t").cast("double"))
    df = df.withColumn("_mean", F.expr("aggregate(_x, 0D, (a, v) -> a + v) / _n"))
    without = lambda part, of: f"cast(length({of}) - length(replace({of}, {part}, '')) as double)"
    df = df.withColumns({
        # string functions where they do, not lambdas over places: all text comes through here
        "_squares": F.expr(f"aggregate(array_distinct(_c), 0D, (a, c) -> a + pow({without('c', '_u')}, 2))"),
        "_high": F.expr(without("'H'", "_halves")),
        "_runs": F.expr(f"1D + ({without("'HL'", '_halves')} + {without("'LH'", '_halves')}) / 2"),
        "_spread": F.expr("aggregate(_x, 0D, (a, v) -> a + (v - _mean) * (v - _mean))"),
        "_pairs": F.expr("aggregate(sequence(1, size(_x) - 1), 0D, (a, i) -> a + (_x[i] - _mean) * (_x[i - 1] - _mean))"),
    })
    free = F.col("_k") - 1
    chi = F.col("_squares") * F.col("_k") / F.col("_n") - F.col("_n")
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    df = df.withColumn("_both", F.expr("2 * _high * (_n - _high) / _n"))
    both = F.col("_both")
    z_runs = (F.col("_runs") - 1 - both) / F.sqrt(F.greatest(both * (both - 1) / (F.col("_n") - 1), F.lit(1e-9)))
    z_serial = (F.col("_pairs") / F.greatest(F.col("_spread"), F.lit(1e-9)) + 1 / F.col("_n")) * F.sqrt("_n")
    # P(Z > |z|) of the normal law by a five-term rational approximation, error under 1e-7
    zs = {"chi": z_chi, "runs": z_runs, "serial": z_serial}
    df = df.withColumns({f"_z_{k}": z for k, z in zs.items()})
    df = df.withColumns({f"_t_{k}": 1 / (1 + 0.2316419 * F.abs(F.col(f"_z_{k}"))) for k in zs})
    df = df.withColumns({f"_tail_{k}": F.expr(
        f"exp(-_z_{k} * _z_{k} / 2) * 0.3989422804014327D * _t_{k} * (0.319381530D + _t_{k} * (-0.356563782D + _t_{k} * "
        f"(1.781477937D + _t_{k} * (-1.821255978D + _t_{k} * 1.330274429D))))") for k in zs})
    least = F.lit(1e-12)
    df = df.withColumns({"_p_" + k: F.greatest(least, F.least(F.lit(1.0), p)) for k, p in {
        "chi": F.when(F.col("_z_chi") >= 0, F.col("_tail_chi")).otherwise(1 - F.col("_tail_chi")),
        "runs": F.when((F.col("_high") > 0) & (F.col("_high") < F.col("_n")), 2 * F.col("_tail_runs")).otherwise(least),
        "serial": F.when(F.col("_spread") > 0, 2 * F.col("_tail_serial")).otherwise(least)}.items()})
    # half of Fisher's statistic, chi-squared with 6 degrees of freedom
    df = df.withColumn("_half", -(F.log("_p_chi") + F.log("_p_runs") + F.log("_p_serial")))
    score = F.expr("exp(-_half) * (1 + _half + _half * _half / 2)")
    df = df.withColumn("score", F.when(F.col("_n") >= 8, F.coalesce(score, F.lit(0.0))).otherwise(F.lit(0.0)))
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def _band(length: Column) -> Column:
    out = F.lit(BANDS[0])
    for b in BANDS[1:]:
        out = F.when(length >= b, F.lit(b)).otherwise(out)
    return out


def histogram(scored: DataFrame, name: str) -> DataFrame:
    """(band, bin, ``name``): how many rows have a score in the bin."""
    return scored.groupBy("band", F.floor(F.col("score") * BINS).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias(name))


def decoys(docs: DataFrame) -> DataFrame:
    """(band, decoy): all candidate characters of each text, cut into pieces of the bands' lengths in turn.

    A text's hash says which length comes first. Its last piece ends with it, and begins in the one before if too few
    characters are left; a text shorter than the piece gives the longest one it has."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    letters = docs.select(F.array_join(F.regexp_extract_all(text, F.lit(PART), F.lit(0)), "").alias("letters"))
    # blocks of one piece for each band; a text's last block is up to twice as long
    size, turns = sum(BANDS), []
    for i in range(len(BANDS)):
        lengths = (BANDS[i:] + BANDS[:i]) * 2
        turns.append("array(" + ", ".join(f"struct({sum(lengths[:j])} as at, {b} as band)" for j, b in enumerate(lengths)) + ")")
    blocks = letters.select(F.expr(f"pmod(xxhash64(letters), {len(BANDS)}) + 1").cast("int").alias("turn"),
                            F.explode(F.expr(f"regexp_extract_all(letters, '.{{{size}}}(?=.{{{size}}})|.+', 0)")).alias("block"))
    blocks = blocks.select("turn", "block", F.length("block").alias("n")).where(F.col("n") >= BANDS[0])
    pieces = blocks.select("block", "n", F.explode(F.expr(f"filter(element_at(array({', '.join(turns)}), turn), p -> p.at < n)")).alias("p"))
    pieces = pieces.select("block", "n", "p.at", F.when(F.col("p.band") <= F.col("n"), F.col("p.band")).otherwise(_band(F.col("n"))).alias("band"))
    return pieces.select("band", F.expr("substring(block, least(at, n - band) + 1, band)").alias("decoy"))


def thresholds(candidates: DataFrame, decoys: DataFrame, rate: float = RATE) -> DataFrame:
    """(band, least): the lowest score bin at which the band's discoveries keep the rate."""
    table = histogram(candidates, "n").withColumn("m", F.lit(0)).unionByName(histogram(decoys, "m").withColumn("n", F.lit(0)))
    table = table.groupBy("band", "bin").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    above = Window.partitionBy("band").orderBy(F.desc("bin"))
    whole = Window.partitionBy("band")
    p = (1 + F.sum("m").over(above)) / (1 + F.sum("m").over(whole))
    rows = table.select("band", "bin", (p * F.sum("n").over(whole)).alias("expected"), F.sum("n").over(above).alias("found"))
    return rows.where((F.col("found") > 0) & (F.col("expected") <= rate * F.col("found"))).groupBy("band").agg(F.min("bin").alias("least"))


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per document: doc_id and the arrays ``assign``, ``access``, ``hex`` and ``random`` of (start, end).

    ``random`` has the discoveries of the battery that overlap no pattern's match."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = _spans(_spans(_assigned(rows), "access", ACCESS), "hex", HEX)
    rows = _spans(rows, "tokens", CANDIDATE)
    token = "transform(tokens, s -> named_struct('start', s.start, 'end', s.end, 'token', substring(text, s.start + 1, s.end - s.start)))"
    rows = rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "assign", "access", "hex", F.expr(token).alias("tokens"))
    kept = durable(rows, "scanned")

    tokens = kept.select("row_id", F.explode("tokens").alias("t")).select("row_id", "t.*")
    scored = durable(battery(tokens).withColumn("band", _band(F.length("token"))), "scored")
    least = durable(thresholds(scored, battery(decoys(docs), "decoy"), rate), "thresholds")  # a row for each band
    found = scored.join(F.broadcast(least), "band").where(F.floor(F.col("score") * BINS) >= F.col("least"))
    found = found.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start"), F.col("end")))).alias("random"))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    base = "concat(assign, access, hex)"
    return kept.drop("tokens").join(found, "row_id", "left").withColumn("random", F.coalesce("random", none)).withColumn(
        "random", F.expr(f"filter(random, r -> NOT exists({base}, b -> b.start < r.end AND r.start < b.end))")).drop("row_id")


def span_list(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the kinds' arrays by start, then kind as given, comma-joined."""
    all_ = ", ".join(f"transform({k}, s -> named_struct('start', s.start, 'k', {i}, 'end', s.end))" for i, k in enumerate(kinds))
    names = "array(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    return F.expr(f"array_join(transform(array_sort(concat({all_})), s -> concat({names}[s.k], ':', s.start, ':', s.end)), ',')")

"""Rule bitmask ledger: every quality rule is evaluated once per document, and policies are read off it.

``ledger`` makes one pass over the whole texts and stores per document the measurements and one bit
per failed rule. A policy (a name, a version and a mask of the rules it enforces) is then a bitwise
test on that column, so a new policy version or an ablation never touches a text again:
``apply_policy`` and ``ablations`` read the ledger only.

Null text and text without words measure 0 everywhere (and fail ``few_words``). A null ``doc_id`` is
carried through; repeated rows each get their own row; an empty table gives an empty ledger. Further
columns of the input are ignored by ``ledger``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import ROW_SLICE_BYTES, column, mix, row_slices, slices, split_words, text_buffers

REPEAT_WINDOW = 8

#: rule -> condition on the measurements under which a document fails it; bit i is the i-th rule.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 25 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "shouting": "100 * n_upper > 60 * n_letters",
    "no_letters": "2 * n_letters < word_chars",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """The rules that reject a document, under a version."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in set(self.rules))


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("corpus", 1, ("few_words", "repeated_windows", "symbols")),
    Policy("corpus", 2, tuple(RULES)),
)
CURRENT = POLICIES[-1]

_LEDGER = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters")]
)
MEASURES = tuple(_LEDGER.names[1:])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
# first bytes of two-byte letters, and ASCII letters: one per letter of a European alphabet
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xF5)]] = True


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _dup_lines(words, off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lines with a word, of those equal to an earlier line of the text). Lines are compared as bytes."""
    n = len(off) - 1
    lines, dups = np.zeros(n, np.int64), np.zeros(n, np.int64)
    breaks = np.flatnonzero(raw == 0x0A)
    has = words.counts > 0
    near = np.searchsorted(breaks, off)
    lines[has] = 1
    for i in np.flatnonzero(has & (np.diff(near) > 0)).tolist():
        seen: set[bytes] = set()
        k = d = 0
        for line in raw[off[i] : off[i + 1]].tobytes().split(b"\n"):
            if line.strip(b" \t\n\r\x0b\x0c"):
                k += 1
                d += line in seen
                seen.add(line)
        lines[i], dups[i] = k, d
    return lines, dups


def _repeat_words(words) -> np.ndarray:
    """Words per text covered by a window that the text holds twice or more."""
    at, h = words.windows(REPEAT_WINDOW)
    covered = np.zeros(len(words.hash) + 1, np.int64)
    if len(at):
        text = words.text_of()[at]
        key = mix(h + mix(text.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        same = np.zeros(len(at), bool)
        eq = key[order[1:]] == key[order[:-1]]
        same[order[1:][eq]] = True
        same[order[:-1][eq]] = True
        hit = at[same]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + REPEAT_WINDOW, -1)
    return _per_text(np.cumsum(covered[:-1]) > 0, words.first)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=ROW_SLICE_BYTES):
            off, raw = text_buffers(column(part, "text"))
            w = split_words(off, raw)
            inside = np.zeros(len(raw) + 1, np.int8)
            inside[w.start] = 1
            inside[w.end[w.end < len(raw)]] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
            lines, dups = _dup_lines(w, off, raw)
            yield pa.RecordBatch.from_arrays(
                [column(part, "doc_id").cast(pa.int64()), *map(pa.array, (
                    w.counts,
                    _per_text(inside & ((raw & 0xC0) != 0x80), off),
                    _per_text(_SYMBOL[raw], off),
                    lines,
                    dups,
                    _repeat_words(w),
                    _per_text(_UPPER[raw], off),
                    _per_text(_LETTER[raw], off),
                ))], schema=_LEDGER)


def failed_bits(rules: dict[str, str] = RULES) -> Column:
    """The failure mask as one long."""
    out = F.lit(0).cast("long")
    for i, condition in enumerate(rules.values()):
        out = out.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: the measurements and ``failed``, the mask of failed rules."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_measure, ", ".join(f"{f.name} long" for f in _LEDGER)).withColumn("failed", failed_bits())


def apply_policy(book: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The ledger with the policy's verdict ``kept``."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(book: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone, and kept if it were dropped.

    The ledger is first folded to one row per mask (2^rules rows at most)."""
    masks = book.groupBy("failed").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "hit", F.col("failed").bitwiseAND(F.lit(policy.mask)))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules])).alias("r")
    x = masks.select("n", "hit", rules).select("n", "hit", "r.*")
    alone = F.col("hit") == F.col("bit")
    return x.groupBy("rule").agg(
        F.sum(F.when(F.col("hit").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(alone | (F.col("hit") == 0), F.col("n")).otherwise(0)).alias("n_kept_without"))


def keep_clean(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The input's rows, all columns, that the policy keeps; the texts stay in their partition.

    The measurements of a row travel with it, so no join back is needed."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    schema = packed.schema
    cols = ", ".join(f"{c} long" for c in MEASURES)

    def run(batches):
        for batch in batches:
            for part in row_slices(batch):
                m = pa.Table.from_batches(list(_measure(iter([part])))).combine_chunks()
                yield pa.RecordBatch.from_arrays([column(part, "row"), *[column(m, c) for c in MEASURES]], names=["row", *MEASURES])
        pa.default_memory_pool().release_unused()  # the worker lives on

    kind = schema["row"].dataType.simpleString()
    kept = packed.mapInArrow(run, f"row {kind}, {cols}").withColumn("failed", failed_bits())
    return apply_policy(kept, policy).where("kept").select("row.*")

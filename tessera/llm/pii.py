"""Personal data: fixed patterns, and identifiers found by bootstrapped contextual extraction.

The matches of the fixed patterns (email, ip, card, phone) are seeds. A lexical pattern is the word before
or the word after a mention. A pattern's confidence for a kind is the share of all occurrences of its
word in the corpus, whatever stands next to it, that touch a known entity of the kind; words that merely happen to stand next to
one come out near 0. Candidates are other words that hold a digit or an ``@``. A candidate instance
(its text) scores the noisy-or of the patterns it is seen with; instances over ``ACCEPT`` become
known, which raises other patterns of theirs, for ``ROUNDS`` rounds of joins and sums over the
pattern-instance graph. Patterns need ``SUPPORT`` different known entities and a confidence of ``CONFIDENCE``.

Mentions of accepted instances are added to the document's spans as kind ``context``; the matches of
the fixed patterns stay as they are.

Null text reads as empty, a null id is carried through, repeated rows each get their own row, an empty table gives no
rows, further columns are ignored. Matching is linear in the text's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import durable
from tessera.llm.words import column, mix, slices, split_words, text_buffers

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 3
CONFIDENCE = 0.5
ACCEPT = 0.6

#: The patterns of the base kinds. Look-behinds and possessive repeats change no match;
#: they keep a failing search from starting again inside the same run.
_LOCAL_END = re.compile(r"@")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'.,;:!?()[]{}<>=|"

_HINT = np.zeros(256, bool)
_HINT[[0x40, *range(0x30, 0x3A)]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    for m in _LOCAL_END.finditer(text):
        at = m.start()
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and start >= done and (domain := _DOMAIN.match(text, at + 1)):
            out.append((start, domain.end()))
            done = domain.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns' matches, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _mentions(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Base entities and candidate words with the words around them."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    out = []
    import bisect

    def around(a: int, b: int) -> tuple[str, str]:
        i, j = bisect.bisect_right(starts, a) - 1, bisect.bisect_left(starts, b)
        left = text[words[i - 1][0] : words[i - 1][1]] if i > 0 else ""
        return left, text[words[j][0] : words[j][1]] if j < len(words) else ""

    taken = sorted((a, b) for _, a, b in base)
    for kind, a, b in base:
        left, right = around(a, b)
        out.append({"kind": KINDS[kind], "start": a, "end": b, "name": text[a:b], "left": left, "right": right})
    k = reach = 0
    for a, b in words:
        word = text[a:b]
        if not any(c.isdigit() or c == "@" for c in word):
            continue
        core = word.strip(_EDGE)
        if len(core) < 4:
            continue
        a += word.index(core)
        b = a + len(core)
        while k < len(taken) and taken[k][0] < b:  # spans that begin before the word's end
            reach = max(reach, taken[k][1])
            k += 1
        if reach > a:
            continue
        left, right = around(a, b)
        out.append({"kind": None, "start": a, "end": b, "name": core, "left": left, "right": right})
    return out


_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_MENTION = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("left", pa.string()), ("right", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            text = column(part, "text")
            off, raw = text_buffers(text)
            hints = np.append(0, np.cumsum(_HINT[raw]))
            look = hints[off[1:]] > hints[off[:-1]]
            spans: list[list] = [[] for _ in range(part.num_rows)]
            mentions: list[list] = [[] for _ in range(part.num_rows)]
            for i in np.flatnonzero(look).tolist():
                t = text[i].as_py()
                base = base_spans(t)
                spans[i] = [{"kind": k, "start": a, "end": b} for k, a, b in base]
                mentions[i] = _mentions(t, base)
            yield pa.RecordBatch.from_arrays([column(part, "row"), column(part, "doc_id"), pa.array(spans, pa.list_(_SPAN)), pa.array(mentions, pa.list_(_MENTION))],
                                             names=["row", "doc_id", "spans", "mentions"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of every word, added up over a task as far as memory allows."""
    words, counts, held = [], [], 0

    def fold():
        w, inverse = np.unique(np.concatenate(words), return_inverse=True)
        return w, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)

    for batch in batches:
        for part in slices(batch):
            off, raw = text_buffers(column(part, "text"))
            w, n = np.unique(split_words(off, raw).hash, return_counts=True)
            words.append(w)
            counts.append(n)
            held += len(w)
            if held > 4_000_000:
                w, n = fold()
                if len(w) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["word", "n"])
                    words, counts, held = [], [], 0
                else:
                    words, counts, held = [w], [n], len(w)
    if words:
        w, n = fold()
        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["word", "n"])


def _word_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of the words of a pattern column, as _count_words has it."""
    for batch in batches:
        word = column(batch, "word")
        off, raw = text_buffers(word)
        w = split_words(off, raw)
        h = np.zeros(batch.num_rows, np.uint64)
        h[w.counts == 1] = w.hash[w.first[:-1][w.counts == 1]]
        yield pa.RecordBatch.from_arrays([word, pa.array(h.view(np.int64))], names=["word", "hash"])


def bootstrap(mentions: DataFrame, words: DataFrame) -> DataFrame:
    """(name, score) of the accepted instances. ``mentions``: kind, name, left, right; ``words``: word (hash), n."""
    sides = F.explode(F.array(F.struct(F.lit("L").alias("side"), F.col("left").alias("word")), F.struct(F.lit("R").alias("side"), F.col("right").alias("word"))))
    graph = mentions.select("kind", "name", sides.alias("p")).select("kind", "name", "p.*").where("word <> ''")
    graph = durable(graph.groupBy("kind", "name", "side", "word").agg(F.count(F.lit(1)).alias("n")), "patterns")
    # only words next to enough different mentions can become patterns
    often = graph.groupBy("side", "word").agg(F.count(F.lit(1)).alias("names")).where(F.col("names") >= SUPPORT)
    hashed = often.select("word").distinct().mapInArrow(_word_hash, "word string, hash long")
    total = words.groupBy("word").agg(F.sum("n").alias("total")).withColumnRenamed("word", "hash")
    total = durable(hashed.join(total, "hash").select("word", "total"), "totals")
    edges = durable(graph.join(often.select("side", "word"), ["side", "word"]).join(total, "word"), "graph")
    candidates = edges.where("kind IS NULL").select("name", "side", "word")
    known = edges.where("kind IS NOT NULL").select("name", "side", "word", "n", "total")
    found = None
    for _ in range(ROUNDS):
        pattern = known.groupBy("side", "word", "total").agg(F.countDistinct("name").alias("support"), F.sum("n").alias("hits"))
        pattern = pattern.withColumn("confidence", F.least(F.lit(1.0), F.col("hits") / F.col("total"))).where(
            (F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE))
        miss = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        new = candidates.join(pattern, ["side", "word"]).groupBy("name").agg((1 - miss).alias("score")).where(F.col("score") >= ACCEPT)
        before = found
        found = durable(new, "accepted")
        if found.isEmpty() or (before is not None and before.count() == found.count()):
            break
        known = edges.where("kind IS NOT NULL").select("name", "side", "word", "n", "total").unionByName(
            edges.where("kind IS NULL").join(found.select("name"), "name").select("name", "side", "word", "n", "total"))
    return found


def extract(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, ``spans`` (kind number, start, end) of the fixed patterns, ``found`` (start, end) of the method."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = "array<struct<kind:int,start:long,end:long>>"
    scanned = durable(rows.mapInArrow(_scan, f"row long, doc_id long, spans {kind}, mentions array<struct<kind:string,start:long,end:long,name:string,left:string,right:string>>"), "scanned")
    mentions = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    words = rows.select("text").mapInArrow(_count_words, "word long, n long")
    accepted = bootstrap(mentions, words)
    found = mentions.where("kind IS NULL").join(accepted.select("name"), "name", "left_semi").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("found"))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    return scanned.drop("mentions").join(found, "row", "left").withColumn("found", F.coalesce("found", none)).drop("row")


def span_list(spans: str, found: str | None = None) -> Column:
    """kind:start:end by kind as listed, then start; the method's spans last."""
    names = "array(" + ", ".join(f"'{k}'" for k in (*KINDS, "context")) + ")"
    all_ = spans if found is None else f"concat({spans}, transform({found}, f -> named_struct('kind', {len(KINDS)}, 'start', f.start, 'end', f.end)))"
    return F.expr(f"array_join(transform(array_sort({all_}), s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')")

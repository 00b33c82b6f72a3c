"""Operator 11: periodic runs of words, by Main and Lorentz's divide and conquer.

Words become numbers. A stretch of words is halved; Z-functions of both halves, read outwards from
the middle, give for each period how far words agree with those one period away, and so every
repetition that crosses the middle. Repetitions are extended over the whole text, equal intervals
keep their least period, and both halves are searched in turn. A run has a period q, its least one,
at least ``max(least, 2 * q)`` words, and no neighbouring word continues it.

Two exact shortcuts: with ``least`` = 12 each run holds six words that stand again one period later,
so stretches without such six words have no runs; and a stretch inside a known run of period q holds
other runs only if it repeats six words at less than q words' distance.

Each text is worked on alone in its task, in time near n log n; batches are unpacked in portions.

Defined results: null, empty and blank texts have no words and no runs and collapse to an empty
text; runs of the same start have different lengths; repeated rows give repeated results; very long
texts are searched whole; an empty table gives an empty table; other columns pass through, but for
those that have the names of outputs, which are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, portions, without

#: Least words of a run. A run of ``LEAST`` words or more holds ``GRAM`` words that repeat one period later.
LEAST = 12
GRAM = 6
RUNS = "array<struct<start:long,length:long,period:long>>"
#: Words compared at first when a match is measured; the steps double.
STEP = 32
#: Values of a Z-function that are found for all positions at once.
PEEL = 4


def _match(s: np.ndarray, i: int, j: int) -> int:
    """Length of the longest common prefix of s[i:] and s[j:], i > j."""
    n, at, step = len(s) - i, 0, STEP
    while at < n:
        end = min(n, at + step)
        unlike = s[i + at : i + end] != s[j + at : j + end]
        k = int(unlike.argmax())
        if unlike[k]:
            return at + k
        at, step = end, step * 2
    return n


def z_function(s: np.ndarray) -> np.ndarray:
    """z[i]: length of the longest common prefix of s and s[i:]; linear, with whole Z-boxes copied at once."""
    n = len(s)
    z = np.zeros(n, np.int64)
    z[0] = n
    heads = np.flatnonzero(s[1:] == s[0]) + 1
    for k in range(1, PEEL + 1):
        z[heads] = k
        heads = heads[heads + k < n]
        if not len(heads):
            return z
        heads = heads[s[heads + k] == s[k]]
    done = 0
    for head in heads.tolist():
        if head < done:
            continue
        left, right = head, head + PEEL + 1 + _match(s, head + PEEL + 1, PEEL + 1)
        z[left] = right - left
        i, step = left + 1, STEP
        while i < right:
            end = right if right == n else min(right, i + step)
            old, room = z[np.arange(i, end) % left], np.arange(right - i, right - end, -1)  # a box repeats every ``left`` values
            z[i:end] = np.minimum(old, room)
            if right < n:
                further = (old == room) & (s[room] == s[right])
                k = int(further.argmax())
                if further[k]:
                    left = i + k
                    right += _match(s, right, right - left)
                    z[left] = right - left
                    i, step = left + 1, STEP
                    continue
            i, step = end, step * 2
        done = right
    return z


def _extended(s: np.ndarray, start: int, end: int, period: int) -> tuple[int, int]:
    """The stretch [start, end) of this period, as far as it goes on both sides."""
    end += _match(s, end, end - period)
    reach, step = start, STEP
    while reach:
        low = max(0, reach - step)
        unlike = np.flatnonzero(s[low:reach] != s[low + period : reach + period])
        if len(unlike):
            reach = low + int(unlike[-1]) + 1
            break
        reach, step = low, step * 2
    return reach, end


def _crossing(s: np.ndarray, lo: int, mid: int, hi: int) -> np.ndarray:
    """(period, start, end) of repetitions within [lo, hi) that cross or touch ``mid``, least periods first."""
    u, v, apart = s[lo:mid], s[mid:hi], np.array([-1], s.dtype)
    nu, nv = len(u), len(v)
    ahead, back = z_function(np.concatenate((v, apart, u))), z_function(np.concatenate((u[::-1], apart, v[::-1])))
    found = []
    # one period further to the right: v against itself, and u's end against the words before mid + p
    p = np.arange(1, nv + 1)
    right, left = ahead[1 : nv + 1], back[nu + 1 + nv - p]
    ok = right + left >= p
    found.append(np.stack((p, mid - left, mid + p + right))[:, ok])
    # one period further to the left: v against the words from mid - p, and u's end against itself
    p = np.arange(1, nu + 1)
    right, left = ahead[nv + 1 + nu - p], back[1 : nu + 1]
    ok = right + left >= p
    found.append(np.stack((p, mid - p - left, mid + right))[:, ok])
    found = np.concatenate(found, axis=1).T
    return found[np.argsort(found[:, 0], kind="stable")]


def gaps(s: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each place how many words before it the same ``GRAM`` words last stood in the same text; huge if never.

    Equal digests of different words only make a stretch be searched in vain.
    """
    out = np.full(len(s), np.iinfo(np.int64).max)
    n = len(s) - GRAM + 1
    if n < 2:
        return out
    x = texts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words, x = s.astype(np.uint64), x[:n]
    for k in range(GRAM):
        x = (x ^ words[k : n + k]) * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
    order = np.argsort(x, kind="stable")
    same = (x[order[1:]] == x[order[:-1]]) & (texts[order[1:]] == texts[order[:-1]]) & (texts[order[1:] + GRAM - 1] == texts[order[1:]])
    out[order[1:][same]] = (order[1:] - order[:-1])[same]
    return out


def runs_of(s: np.ndarray, gap: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the words ``s``, in order; ``gap`` as :func:`gaps` gives it."""
    found: dict[tuple[int, int], int] = {}
    todo: list[tuple[int, int, list[tuple[int, int, int]]]] = [(0, len(s), [])]
    while todo:
        lo, hi, known = todo.pop()
        size = hi - lo
        if size < least:
            continue
        near = gap[lo : hi - GRAM + 1]
        near = near[near <= np.minimum(np.arange(len(near)), size // 2)]
        known = [r for r in known if r[0] < hi and lo < r[1]]
        # within a run of period q others repeat six words at less than q words' distance
        if not len(near) or any(a <= lo and hi <= b and int(near.min()) >= q for a, b, q in known):
            continue
        mid = (lo + hi) // 2
        some = _crossing(s, lo, mid, hi)
        for a, b, q in known:
            some = some[(some[:, 0] % q != 0) | (some[:, 1] < a) | (some[:, 2] > b)]
        while len(some):
            q, a, b = some[0].tolist()
            a, b = _extended(s, a, b, q)
            if b - a >= least:
                found[a, b] = min(q, found.get((a, b), q))
                known = [*known, (a, b, q)]
            some = some[(some[:, 0] % q != 0) | (some[:, 1] < a) | (some[:, 2] > b)]
        todo += [(lo, mid, known), (mid, hi, known)]
    return sorted((a, b - a, q) for (a, b), q in found.items())


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def searched(texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Runs and collapsed text of each text (UTF-8)."""
    words = [t.split() for t in texts]
    sizes = [len(ws) for ws in words]
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
    ends = np.cumsum(sizes, dtype=np.int64)
    gap = gaps(flat, np.repeat(np.arange(len(words)), sizes))
    for ws, end in zip(words, ends.tolist(), strict=True):
        part = slice(end - len(ws), end)
        runs = runs_of(flat[part], gap[part])
        if runs:
            ws = [ws[i] for i in np.flatnonzero(kept_words(len(ws), runs))]
        yield runs, b" ".join(ws)


def periodic(docs: DataFrame) -> DataFrame:
    """``docs`` with runs (start, length, period in words, in order) and collapsed (the text without repeats)."""
    docs = without(docs, ["runs", "collapsed"])
    text = fresh(docs.columns, "_text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, text):
            runs, collapsed = [], []
            for r, c in searched([x.as_py() or b"" for x in b.column(text)]):
                runs.append([dict(zip(("start", "length", "period"), one, strict=True)) for one in r])
                collapsed.append(c.decode())
            kept = b.select([c for c in b.schema.names if c != text])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(runs, kind), pa.array(collapsed, pa.string())], names=[*kept.schema.names, "runs", "collapsed"])

    given = docs.select("*", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias(text))
    return given.mapInArrow(run, ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema) + f", runs {RUNS}, collapsed string")


def digested(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the longest one and the digests of all runs and of the collapsed text."""
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda top, r: F.when(r["length"] > top["length"], r).otherwise(top))
    lines = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long")
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of ``docs``; where crc32(doc_id) is divisible by 10, the words from some place on repeat.

    A fixed rule: h = crc32, g = h div 10, a = g mod n, p = 1 + (n - a) div (3 + g mod 8); word i >= a
    becomes word a + (i - a) mod p.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("_words"), F.floor(h / 10).alias("_g"))
    n = F.size("_words")
    rows = rows.withColumn("_a", F.when(n > 0, (F.col("_g") % n).cast("int")))
    rows = rows.withColumn("_p", (F.lit(1) + F.floor((n - F.col("_a")) / (F.lit(3) + F.col("_g") % 8))).cast("int"))
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p"))
    again = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("_words", place(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), again).otherwise(F.col("text")).alias("text"))

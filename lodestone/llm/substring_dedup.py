"""Substring dedup: bytes covered by a 50-byte string that starts in an earlier document go.

The method asked for, a suffix array sorted externally by induced sorting, is not used: its queues pass single
suffixes, which costs Python several times the seconds allowed (README). Instead windows, the strings of 50 bytes,
are compared in five steps, each of which leaves less to the next and is stored, so that no two hold their
shuffles at once:

1. Chunks. Texts are cut where the hash of a gram says so, and a chunk with the 49 bytes behind it is known by a
   128-bit digest. A chunk met in an earlier document goes with all windows that start in it.
2. Names. Each window of the other chunks is named by the least hash of the grams in it, so equal windows have equal
   names; runs of windows whose name is met in one document alone equal none of another.
3. Runs. A run of one name goes, like a chunk, if the same bytes are a run in an earlier document. Names that are
   left in one document alone need no more comparing.
4. Closer names. The windows left are named once more, by grams nearly as long as they are: texts share short grams
   by chance, and the more so the more texts there are. Again only names met in several documents stay.
5. Windows. Those of the remaining runs are grouped by two independent 64-bit hashes, and each group's smallest
   doc_id starts the string first.

Every window of every text takes part; there are no caps. Of rows of one key that a task meets in several
documents, only a few keep their key, since the verdict on the others is known: they are dealt by a key of
their own, and no frequent passage becomes one task. A text and its hashes are held whole by one task, about sixty
times its bytes.

Null texts are empty. Rows that share a doc_id do not remove from each other; a null doc_id is
neither before nor after any other. Texts below 50 bytes stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, stored, table

LENGTH = 50
GRAM = 18
#: Bytes of the grams of closer names.
CLOSE = 40
#: One gram in so many begins a chunk; a power of two.
CHUNK = 256
#: Rows that a task compares among themselves before it sends them.
HELD = 1 << 18
#: Odd 64-bit multipliers of the polynomial hashes and of the mixer.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Rows of a name that keep it, of those a task holds, beside the greatest document's.
KEPT = 8
#: Bits of the length beside the place of a string in ``pos``; longer chunks and runs are split.
LONG, SHORT = 20, 8
#: Verdicts on a row that its task knows already: it goes, or has to be compared.
GONE, COMPARE = 1, 2
#: A chunk or run of windows: its key (a, b), its place and length, its verdict or 0. In this order rows compress well.
NAMED = "a long, pos long, doc_id long, k long, verdict int"
ROW = NAMED + ", b long"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(MIX[0])
    h ^= h >> np.uint64(27)
    h *= np.uint64(MIX[1])
    h ^= h >> np.uint64(31)
    return h


def _hashes(data: np.ndarray, n: int, base: int) -> np.ndarray:
    """Mixed polynomial hashes of all runs of n bytes, by doubling."""
    power, run = data.astype("uint64") + np.uint64(1), 1
    out, have = None, 0
    mul = base
    while n:
        if n & 1:
            if out is None:
                out, have = power, run
            else:
                m = min(len(out) - run, len(power)) if len(out) > run else 0
                out = power[:m] * np.uint64(pow(base, have, 1 << 64)) + out[run : run + m]
                have += run
        n >>= 1
        if n:
            power = power[: len(power) - run] * np.uint64(mul) + power[run:] if len(power) > run else power[:0]
            run *= 2
            mul = mul * mul % (1 << 64)
    return _mixed(out)


def names(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Per window of ``length`` bytes the least gram hash in it."""
    if len(data) < length:
        return np.zeros(0, "int64")
    least, span, want = _hashes(data, gram, BASES[0]), 1, length - gram + 1
    while span * 2 <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = want - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return least.view("int64")


def _split(at: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges cut into such of at most so many windows."""
    parts = -(-(end - at) // most)
    if (parts == 1).all():
        return at, end
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(at, parts) + nth * most
    return start, np.minimum(start + most, np.repeat(end, parts))


def _digests(text: bytes, at: np.ndarray, end: np.ndarray, length: int, size: int) -> np.ndarray:
    """Digests of so many longs of the bytes of windows at to end."""
    marks = [hashlib.blake2b(text[x : y + length - 1], digest_size=8 * size).digest() for x, y in zip(at.tolist(), end.tolist())]
    return np.frombuffer(b"".join(marks), "i8").reshape(-1, size)


def _chunks(text: bytes, data: np.ndarray, length: int, _: list) -> tuple[np.ndarray, ...]:
    """Digests (a, b) of the text's chunks, and the windows (at, end) that start in each."""
    windows = len(data) - length + 1
    cuts = np.flatnonzero(_hashes(data, min(GRAM, length), BASES[1])[1:windows] & np.uint64(CHUNK - 1) == 0) + 1
    at, end = _split(np.append(0, cuts), np.append(cuts, windows), (1 << LONG) - 1)
    keys = _digests(text, at, end, length, 2)
    return keys[:, 0], keys[:, 1], at, end


def _named(found: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, ...]:
    """(at, end) of the runs of equal names in the places that are live, and 48 bits of their names."""
    at = np.append(0, np.flatnonzero((found[1:] != found[:-1]) | (live[1:] != live[:-1])) + 1)
    end = np.append(at[1:], len(found))
    at, end = _split(at[live[at]], end[live[at]], (1 << SHORT) - 1)
    return at, end, (found[at].view("u8") >> np.uint64(16)).view("i8")


def _runs(text: bytes, data: np.ndarray, length: int, gone: list) -> tuple[np.ndarray, ...]:
    """Names of the runs of equally named windows outside the chunks that are gone."""
    found = names(data, length, min(GRAM, length))
    at, end, a = _named(found, ~_covered(len(found), gone, 0))
    return a, np.zeros(len(at), "i8"), at, end


def _same(text: bytes, data: np.ndarray, length: int, runs: list) -> tuple[np.ndarray, ...]:
    """Names and digests of the given runs."""
    at, end = runs[:, 0], runs[:, 1]
    part, rank = _part(data, length, runs)
    a = (names(part, length, min(GRAM, length))[rank[at]].view("u8") >> np.uint64(16)).view("i8")
    return a, _digests(text, at, end, length, 1)[:, 0], at, end


def _closer(text: bytes, data: np.ndarray, length: int, runs: list) -> tuple[np.ndarray, ...]:
    """Closer names of the runs of equally named windows in the given ones."""
    live = _covered(len(data) - length + 1, runs, 0)
    part, rank = _part(data, length, runs)
    found = np.zeros(len(live), "i8")
    found[live] = names(part, length, min(CLOSE, length))[rank[: len(live)][live]]
    at, end, a = _named(found, live)
    return a, np.zeros(len(at), "i8"), at, end


def _windows(text: bytes, data: np.ndarray, length: int, runs: list) -> tuple[np.ndarray, ...]:
    """Hashes of every window of the runs."""
    at = np.flatnonzero(_covered(len(data) - length + 1, runs, 0))
    part, rank = _part(data, length, runs)
    a, b = (_hashes(part, length, base).view("i8")[rank[at]] for base in BASES)
    return a, b, at, at + 1


def _part(data: np.ndarray, length: int, runs: list) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the windows of the runs, and where each byte of the text is in them."""
    there = _covered(len(data), runs, length - 1)
    return data[there], np.cumsum(there) - 1


def _covered(n: int, ranges: list, more: int) -> np.ndarray:
    """Which of n places lie in the ranges (at, end), each ``more`` longer."""
    if not len(ranges):
        return np.zeros(n, bool)
    edge = np.zeros(n + 1, "i8")
    np.add.at(edge, ranges[:, 0], 1)
    np.add.at(edge, ranges[:, 1] + more, -1)
    return np.cumsum(edge[:-1]) > 0


def _ranges(column: pa.Array) -> list:
    """Per row its ranges as an array of (at, end), each packed into one long."""
    out = []
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for x, y, there in zip(offsets[:-1], offsets[1:], column.is_valid().to_pylist()):
        packed = values[x:y] if there else values[:0]
        out.append(np.stack([packed >> 32, packed & 0xFFFFFFFF], axis=1) if len(packed) else [])
    return out


def _dealt(a: np.ndarray, b: np.ndarray, doc: np.ndarray, k: np.ndarray, at: np.ndarray, end: np.ndarray, of: Callable) -> pa.RecordBatch:
    """The rows with the verdict where these rows alone tell it: a key is met in an earlier document, a name in any
    other. Of such rows those that others need not meet get a key of their own."""
    n = len(a)
    verdict, own = np.zeros(n, "i4"), np.zeros(n, bool)
    if of not in (_runs, _closer):
        # Keys whose mixtures are alike by chance may stand among each other: such rows keep their keys and meet later.
        order = np.argsort(a.view("u8") ^ _mixed(b.view("u8")))
        x, y = a[order], b[order]
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        low = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, n)))
        own[order] = doc[order] > low
        verdict[own] = GONE
    if of in (_runs, _same, _closer):
        # Rows of names that several documents have, those that are gone left out.
        left = np.flatnonzero(~own)
        left = left[np.lexsort((doc[left], a[left]))]
        x, y = a[left], doc[left]
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        sizes = np.diff(np.append(first, len(left)))
        last = first + sizes - 1
        shared = y[first] < y[last]
        verdict[left[np.repeat(shared, sizes)]] = COMPARE
        many = np.flatnonzero(shared & (sizes > KEPT + 1))
        middle = sizes[many] - KEPT - 1
        nth = np.arange(middle.sum()) - np.repeat(np.cumsum(middle) - middle, middle)
        own[left[np.repeat(first[many] + KEPT, middle) + nth]] = True
    at_own = np.flatnonzero(own)
    mine = _mixed(a[at_own].view("u8") ^ _mixed(_mixed(doc[at_own].view("u8")) + at[at_own].astype("u8")))
    a[at_own] = (mine >> np.uint64(16 if of in (_runs, _closer) else 0)).view("i8")
    pos = at << (LONG if of is _chunks else SHORT) | (end - at)
    columns = {"a": a, "pos": pos, "doc_id": doc, "k": k, "verdict": verdict} | ({} if of in (_runs, _closer) else {"b": b})
    return pa.RecordBatch.from_pydict({c: pa.array(x) for c, x in columns.items()})


def _strings(rows: DataFrame, of: Callable, length: int) -> DataFrame:
    """The keyed strings that ``of`` makes of each text, given its ranges if ``rows`` has such."""
    ranged = "ranges" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        held = 0
        for batch in batches:
            ranges = _ranges(batch.column("ranges")) if ranged else [[]] * batch.num_rows
            texts = batch.column("text")
            for n, (doc_id, k) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("k").to_pylist())):
                if doc_id is None or (of in (_same, _closer, _windows) and not len(ranges[n])):
                    continue
                text = texts[n].as_py()
                if len(text) < length:
                    continue
                a, b, at, end = of(text, np.frombuffer(text, "u1"), length, ranges[n])
                if len(a):
                    kept.append((a, b, np.full(len(a), doc_id, "i8"), np.full(len(a), k, "i8"), at, end))
                    held += len(a)
                if held >= HELD:
                    yield _dealt(*map(np.concatenate, zip(*kept)), of)
                    kept, held = [], 0
        if held:
            yield _dealt(*map(np.concatenate, zip(*kept)), of)

    return rows.mapInArrow(run, NAMED if of in (_runs, _closer) else ROW)


def _found(strings: DataFrame, *more: str, bits: int = SHORT) -> DataFrame:
    """(doc_id, k, range) of strings, the range (at, end) packed into one long."""
    packed = f"shiftleft(shiftright(pos, {bits}), 32) + shiftright(pos, {bits}) + (pos & {(1 << bits) - 1})"
    return strings.select("doc_id", "k", F.expr(packed).alias("range"), *more)


def _earlier(strings: DataFrame) -> DataFrame:
    """The strings whose key is met in an earlier document."""
    low = F.min("doc_id").over(Window.partitionBy("a", "b"))
    return strings.withColumn("low", low).where((F.col("verdict") == GONE) | (F.col("low") < F.col("doc_id")))


def _shared(runs: DataFrame) -> DataFrame:
    """The runs whose name is met in another document."""
    w = Window.partitionBy("a")
    seen = runs.withColumns({"low": F.min("doc_id").over(w), "high": F.max("doc_id").over(w)})
    return seen.where((F.col("verdict") == COMPARE) | (F.col("low") < F.col("high")))


def _judged(runs: DataFrame) -> DataFrame:
    """The runs that are ``gone``, met whole in an earlier document, and those to compare with others of their name."""
    low = F.min("doc_id").over(Window.partitionBy("a", "b"))
    gone = (F.col("verdict") == GONE) | (F.col("low") < F.col("doc_id"))
    seen = runs.repartition("a").withColumn("low", low).withColumn("gone", gone)
    left, w = F.when(~F.col("gone"), F.col("doc_id")), Window.partitionBy("a")
    seen = seen.withColumns({"first": F.min(left).over(w), "last": F.max(left).over(w)})
    return seen.where(F.col("gone") | (F.col("verdict") == COMPARE) | (F.col("first") < F.col("last")))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k"), text.cast("binary").alias("text"))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, spans, kept, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    ``spans`` are the removed byte ranges (start, end) of the UTF-8 text in order, ``kept`` the bytes
    outside them; a range may begin or end within a character."""
    rows = _rows(docs)

    def ranged(found: DataFrame) -> DataFrame:
        return rows.join(found.groupBy("doc_id", "k").agg(F.collect_list("range").alias("ranges")), ["doc_id", "k"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            texts = batch.column("text")
            for n, ranges in enumerate(_ranges(batch.column("ranges"))):
                text = texts[n].as_py()
                gone = _covered(len(text), ranges, length - 1)
                turns = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype("i1"))).tolist()
                spans.append([{"start": x, "end": y} for x, y in zip(turns[::2], turns[1::2])])
                kept.append(np.frombuffer(text, "u1")[~gone].tobytes() if turns else text)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "spans", "kept"])

    chunks = stored(_found(_earlier(_strings(rows, _chunks, length)), bits=LONG), "chunks")
    runs = stored(_found(_shared(_strings(ranged(chunks), _runs, length))), "runs")
    judged = stored(_found(_judged(_strings(ranged(runs), _same, length)), "gone"), "judged")
    discard(runs)
    closer = stored(_found(_shared(_strings(ranged(judged.where("NOT gone")), _closer, length))), "closer")
    windows = stored(_found(_earlier(_strings(ranged(closer), _windows, length))), "windows")
    discard(closer)
    gone = chunks.union(judged.where("gone").drop("gone")).union(windows)
    left = ranged(gone).mapInArrow(cut, "doc_id long, spans array<struct<start: long, end: long>>, kept binary")
    return digests(left)


def digests(left: DataFrame) -> DataFrame:
    """``left`` with n_bytes, n_removed, n_spans and kept_sha256 of its spans and kept bytes."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return left.withColumn("n_removed", removed).select(
        "doc_id", "spans", "kept",
        (F.octet_length("kept") + F.col("n_removed")).alias("n_bytes"), "n_removed",
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

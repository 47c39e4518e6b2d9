"""N-gram Jaccard self-join on 5-word shingles, by token-combination prefixes.

A document's tokens are the 64-bit hashes of its distinct shingles in the order of those hashes.
Two sets of n and m tokens and similarity s or more share a token among the first
n - ceil(s n) + 1 of the one and m - ceil(s m) + 1 of the other: these and a tenth of n more are indexed
singly. As all shared tokens but those behind the shorter reaching prefix lie in both, the number of keys that
two sets share has a lower bound as well, which sets with a common passage mostly miss. A token whose postings
list is longer than ``frequent`` is of a frequent class. Sets that can only meet in such tokens are indexed
anew: their tokens are counted among them exactly, rare ones go first and are indexed singly, and of the
frequent ones combinations of two neighbours, in a prefix extended to 2 (1 - s) n + 2 less two for each
rare token. No more neighbours than that are parted by tokens that only one of the sets has, so similar sets
share a combination. Thresholds are the same at every size.

Each set has a bitmap of the parity of its tokens per slot: sets that differ in d tokens differ in at most d
bits, which rules out most candidates beforehand. The others are verified on whole sets, made again from the whole texts. A list first compares its
sets with a few of them, the least, the greatest and some by hash, which links groups of near copies without
pairing them all; lists whose sets are by then of one component have no more to tell. Sets of lists of combinations
that still hold several, which are mostly near copies a little too far from the others, are indexed once more: by
the sizes that a partner may have, since of sets of like size each may lack only half as many tokens as of sets of any,
and with the rarer of the frequent tokens first. Only sets of different components are then compared.
Every link between components is thus verified, and components are exact; ``links`` holds the verified links that joined them, not all links within a component.
Spokes of a hub are dealt in blocks, each with a copy of the hub's text, so no hub is one task.

Sets of equal tokens form a class, of which one row is a candidate. Nulls, blanks: empty sets, linked with
nothing; empty tables give no rows. Fewer than five words: the whole sequence. Rows of one doc_id
are one node of the graph: what one of them links to, all reach. A null doc_id is no node: its row has the
component of the documents with its very set, or null. Extra columns are not read. A very long text is held
whole by one task, about fifteen times its bytes while it is hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.graph import components
from .common import discard, small, stored, table, whole
from .shingling import WORD_BASE, mixed, shingle_sets

SHINGLE = 5
PERCENT = 80
#: A longer postings list is of a frequent class.
FREQUENT = 50
#: Per cent of a set's tokens indexed beyond the prefix that must meet.
EXTRA = 10
#: Documents compared with one copy of their hub.
SPOKES = 64
#: Slots of the table of frequent tokens' levels, 4 MB whatever the input; tokens that share the slot
#: of a frequent one are of the frequent class too, which costs time but no result.
SLOTS = 1 << 22
#: Longs of a set's bitmap of parities.
BITS = ("b0", "b1", "b2", "b3")
#: Those of the sets that are indexed by sizes of partners, whose differences a short bitmap shows too few of.
WIDE = tuple(f"b{k}" for k in range(16))
#: Sets that each list of combinations is compared with, twice, before the rest is compared.
HUBS = 8
#: Digests a task remembers to index each class once; it then starts anew.
REMEMBERED = 1_000_000


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))


def shingles(docs: DataFrame, n: int = SHINGLE, names: tuple[str, ...] = BITS) -> DataFrame:
    """doc_id, n_shingles, h, a digest of the set (null if it is empty), and its bitmap, of every row."""
    slots = 64 * len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text"), n)
            sizes = pa.array([len(x) for x in sets], pa.int64())
            marks = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary())
            odd = np.array([np.bincount(x.view("u8") % np.uint64(slots), minlength=slots) & 1 for x in sets], "u1").reshape(len(sets), slots)
            bits = np.packbits(odd, axis=1).view("i8")
            columns = [batch.column("doc_id"), sizes, marks, *(pa.array(bits[:, k]) for k in range(len(names)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "h", *names])

    return _texts(docs).mapInArrow(run, f"doc_id long, n_shingles long, h binary, {', '.join(f'{b} long' for b in names)}")


def prefix_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of a set's prefix."""
    n = len(tokens)
    return tokens[: n - -(-percent * n // 100) + 1 + EXTRA * n // 100]


def combined_keys(tokens: np.ndarray, percent: int, levels: np.ndarray) -> np.ndarray:
    """Of a set's prefix with rare tokens first, these and the neighbouring pairs of frequent ones."""
    n = len(tokens)
    common = levels[tokens.view("u8") % np.uint64(len(levels))] > 0
    rare, prefix = tokens[~common], n - -(-percent * n // 100) + 1
    if len(rare) >= prefix:
        return rare[:prefix]
    head = tokens[common][: 2 * (100 - percent) * n // 100 - 2 * len(rare) + 2].view("u8")
    return np.concatenate([rare, mixed(head[:-1] * np.uint64(WORD_BASE) + head[1:]).view("i8")])


def size_class(n: int) -> int:
    """The class of a set's size: of sizes that agree in their five leading bits."""
    shift = max(0, n.bit_length() - 5)
    return 32 * shift + (n >> shift)


def size_class_of(n: str) -> Column:
    """``size_class`` of a column."""
    shift = f"CAST(greatest(0, length(bin({n})) - 5) AS int)"
    return F.expr(f"32 * {shift} + shiftright({n}, {shift})")


def sized_keys(tokens: np.ndarray, percent: int, levels: np.ndarray, present: list[int]) -> np.ndarray:
    """The keys of a set for partners of each class of sizes in ``present``: as ``combined_keys``, with prefixes for these
    sizes alone and frequent tokens in the order of their levels. Keys for partners of other classes than its own are odd."""
    n, own, out = len(tokens), size_class(len(tokens)), [np.zeros(0, "i8")]
    level = levels[tokens.view("u8") % np.uint64(len(levels))]
    ordered = tokens[np.argsort(level, kind="stable")].view("u8")
    rare = int(np.count_nonzero(level == 0))
    for other in present:
        shift, lead = other >> 5, other & 31
        least, most = max(lead << shift, -(-percent * n // 100)), min((lead + 1 << shift) - 1, 100 * n // percent)
        if least > most:
            continue
        # Of similar sets, the one of n tokens has so many of its own before the first shared one, at most.
        prefix = n - -(-percent * (n + least) // (100 + percent)) + 1
        if rare >= prefix:
            keys = ordered[:prefix]
        else:
            # Neighbours are parted by tokens of either set, and those of this one take places as well.
            places = max(2 * n + m - -(-3 * percent * (n + m) // (100 + percent)) for m in (least, most))
            head = ordered[rare : rare + places - 2 * rare + 2]
            keys = np.concatenate([ordered[:rare], mixed(head[:-1] * np.uint64(WORD_BASE) + head[1:])])
        tag = np.uint64(min(own, other) << 32 | max(own, other))
        keys = mixed(keys ^ mixed(np.array([tag])))
        out.append((keys & ~np.uint64(1) | np.uint64(own != other)).view("i8"))
    return np.concatenate(out)


def postings(docs: DataFrame, keys_of, n: int = SHINGLE) -> DataFrame:
    """(key, id): the keys of every set that its task has not met before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            keys, ids, held = [], [], 0
            for doc_id, tokens in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), n)):
                if doc_id is None or not len(tokens):
                    continue
                mark = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                if mark in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(mark)
                keys.append(keys_of(tokens))
                ids.append(np.full(len(keys[-1]), doc_id, "i8"))
                held += len(keys[-1])
                if held > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["key", "id"])
                    keys, ids, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["key", "id"])

    return _texts(docs).mapInArrow(run, "key long, id long")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, n: int) -> DataFrame:
    """The stored pairs (a, hub) whose whole sets are similar enough."""
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SPOKES).alias("m"))
    dealt = pairs.join(blocks, "hub").select("a", "hub", F.pmod(F.xxhash64("a"), F.col("m")).alias("block"))
    spokes = texts.join(dealt, texts["id"] == F.col("a")).select("hub", "block", F.col("a"), "text")
    centres = texts.join(dealt.select("hub", "block").distinct(), texts["id"] == F.col("hub")).select("hub", "block", F.lit(None).cast("long").alias("a"), "text")
    together = spokes.union(centres).repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, centre = None, []
        for batch in batches:
            found = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("hub", "block", "a")), shingle_sets(batch.column("text"), n))
            for hub, block, a, tokens in rows:
                if (hub, block) != held:
                    held, centre = (hub, block), []
                if a is None:
                    centre.append(tokens)
                    continue
                for other in centre:
                    most = min(len(tokens), len(other))
                    if 100 * most < percent * max(len(tokens), len(other)):
                        continue
                    both = len(np.intersect1d(tokens, other, assume_unique=True))
                    if both and 100 * both >= percent * (len(tokens) + len(other) - both):
                        found.append((a, hub))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return together.mapInArrow(run, "a long, b long").distinct()


class _Join:
    """The state of one join: the classes, the links found and the roots of linked nodes."""

    def __init__(self, docs: DataFrame, percent: int, frequent: int, n: int):
        self.docs, self.percent, self.frequent, self.n = _texts(docs), percent, frequent, n
        every = stored(shingles(docs, n), "set-digests")
        classes = every.where("h IS NOT NULL").groupBy("h").agg(F.min("doc_id").alias("low"))
        #: Every row with its class's least doc_id.
        self.members = stored(every.join(classes, "h", "left").select("doc_id", "n_shingles", "low", *BITS), "set-members")
        discard(every)
        #: Size and bitmap of every class.
        self.classes = stored(self.members.where("low IS NOT NULL").select(F.col("low").alias("id"), F.col("n_shingles").alias("n"), *BITS).dropDuplicates(["id"]), "set-classes")
        self.links: list[DataFrame] = []
        self.roots: DataFrame | None = None
        nodes = self.members.where("doc_id IS NOT NULL AND low IS NOT NULL")
        twins = nodes.groupBy("doc_id").agg(F.min("low").alias("a"), F.max("low").alias("b")).where("a < b").drop("b")
        self.merge(stored(nodes.join(twins, "doc_id").where("a < low").select("a", F.col("low").alias("b")), "links"))

    def merge(self, found: DataFrame) -> None:
        """Takes in links (a, b)."""
        self.links.append(found)
        now = components(self.rooted(self.rooted(found, "a"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")))
        if now is None:
            return
        if self.roots is not None:
            moved = self.roots.join(now.toDF("root", "top"), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
            fresh = now.join(self.roots.select("id"), "id", "left_anti")
            after = stored(moved.union(fresh), "roots")
            discard(now, self.roots)
            now = after
        self.roots = now

    def rooted(self, df: DataFrame, c: str) -> DataFrame:
        """df with the root of node column c."""
        if self.roots is None:
            return df.withColumn(f"{c}_root", F.col(c))
        return df.join(self.roots.toDF(c, "_top"), c, "left").withColumn(f"{c}_root", F.coalesce("_top", c)).drop("_top")

    def lists(self, docs: DataFrame, keys_of, classes: DataFrame | None = None) -> DataFrame:
        """Stored (key, c, id, n, bitmap) of the lists of two and more, by classes; c is the list's length."""
        index = postings(docs, keys_of, self.n)
        wide = stored(index.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "lists")
        nodes = self.members.where("low IS NOT NULL").select(F.col("doc_id").alias("id"), "low")
        met = index.join(small(wide), "key").join(nodes, "id").select("key", "c", F.col("low").alias("id")).distinct()
        out = stored(met.join(self.classes if classes is None else classes, "id"), "postings")
        discard(wide)
        return out

    def compare(self, pairs: DataFrame, docs: DataFrame) -> None:
        """Verifies pairs (a, hub) and takes in the links."""
        pairs = stored(pairs.distinct(), "pairs")
        if pairs.limit(1).count():
            texts = self.texts(docs, pairs)
            self.merge(stored(_verified(pairs, texts, self.percent, self.n), "links"))
            discard(texts)
        discard(pairs)

    def live(self, index: DataFrame, *more) -> DataFrame:
        """Lists that still hold nodes of different components."""
        found = self.rooted(index, "id").groupBy("key").agg(F.min("id_root").alias("r0"), F.max("id_root").alias("r1"), *more)
        return found.where("r0 <> r1").drop("r0", "r1")

    def fits(self, n: str, m: str, bits: list[str], others: list[str]):
        """Neither the sizes n, m nor the bitmaps rule out that two sets are similar."""
        differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(bits, others)), F.lit(0))
        shared = F.expr(f"CAST(ceil({self.percent} * ({n} + {m}) / {100 + self.percent}) AS long)")
        return (100 * F.least(n, m) >= self.percent * F.greatest(n, m)) & (differ <= F.col(n) + F.col(m) - 2 * shared)

    def counted(self, met: DataFrame) -> DataFrame:
        """The pairs (a, hub) of ``met``, the keys k they meet in, and ``need``, how many similar sets share at least."""

        def behind(n):
            return f"greatest(0, CAST(ceil({self.percent} * {n} / 100) AS long) - 1 - {EXTRA} * {n} DIV 100)"

        need = F.expr(f"CAST(ceil({self.percent} * (n + m) / {100 + self.percent}) AS long) - greatest({behind('n')}, {behind('m')})")
        return met.groupBy("a", "hub", "n", "m").agg(F.count("*").alias("k")).withColumn("need", need)

    def enough(self, met: DataFrame, long: DataFrame) -> DataFrame:
        """The pairs (a, hub) of ``met`` (key, a, hub, n, m) that share as many keys as similar sets must; keys of
        the long lists, which ``met`` lacks, count as shared as far as both sets have such."""
        pairs = self.counted(met)
        more = long.groupBy("id").agg(F.count("*").alias("f"))
        pairs = pairs.join(more.toDF("a", "fa"), "a", "left").join(more.toDF("hub", "fb"), "hub", "left")
        shared = F.col("k") + F.least(F.coalesce("fa", F.lit(0)), F.coalesce("fb", F.lit(0)))
        return pairs.where(shared >= F.col("need")).select("a", "hub")

    def texts(self, docs: DataFrame, pairs: DataFrame) -> DataFrame:
        """The stored texts of the nodes in pairs, (id, text)."""
        wanted = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("hub")).distinct(), "wanted")
        found = docs.join(small(wanted), docs["doc_id"] == wanted["id"], "left_semi").select(F.col("doc_id").alias("id"), "text")
        out = stored(found, "texts")
        discard(wanted)
        return out

    def star(self, index: DataFrame, docs: DataFrame, *orders, single: bool = False) -> None:
        """Compares the sets of each live list with a few of them, the first by each of the orders. Of lists of single
        tokens, pairs that meet as hub and spoke in less than half the keys that similar sets share wait for the later steps."""
        theirs = [f"hub_{b}" for b in BITS]
        picks = F.array(*(F.min_by("id", order) for order in orders))
        hubs = self.live(index, F.array_distinct(picks).alias("p")).select("key", F.explode("p").alias("hub"))
        centres = self.classes.select(F.col("id").alias("hub"), F.col("n").alias("m"), *(F.col(b).alias(t) for b, t in zip(BITS, theirs)))
        hubs = self.rooted(hubs, "hub").join(centres, "hub")
        pairs = self.rooted(index, "id").join(hubs, "key").where((F.col("id_root") != F.col("hub_root")) & self.fits("n", "m", BITS, theirs))
        pairs = pairs.withColumnRenamed("id", "a")
        self.compare((self.counted(pairs).where(2 * F.col("k") >= F.col("need")) if single else pairs).select("a", "hub"), docs)

    def across(self, index: DataFrame, sized: bool = False) -> DataFrame:
        """(key, a, hub, n, m) of the pairs of different components in each list; of ``sized`` keys, those that the key is for."""
        rows = self.rooted(index, "id").join(self.live(index), "key")
        bits = WIDE if sized else BITS
        theirs = [f"hub_{b}" for b in bits]
        x = rows.select("key", F.col("id").alias("a"), "n", F.col("id_root").alias("ra"), *bits)
        y = rows.select("key", F.col("id").alias("hub"), F.col("n").alias("m"), F.col("id_root").alias("rb"), *(F.col(b).alias(t) for b, t in zip(bits, theirs)))
        pairs = x.join(y, "key").where((F.col("hub") < F.col("a")) & (F.col("ra") != F.col("rb")) & self.fits("n", "m", bits, theirs))
        return pairs.where((F.col("key") % 2 != 0) == (size_class_of("n") != size_class_of("m"))) if sized else pairs

    def singly(self) -> DataFrame:
        """Compares the sets that meet in single tokens. Returns the nodes (id) that may have partners
        which they meet in tokens of frequent classes alone."""
        percent = self.percent
        index = self.lists(self.docs, lambda tokens: prefix_keys(tokens, percent))
        self.star(index, self.docs, F.col("id"), -F.col("id"), F.xxhash64("id"), single=True)
        short, long = index.where(F.col("c") <= self.frequent), index.where(F.col("c") > self.frequent)
        self.compare(self.enough(self.across(short), long), self.docs)
        # Similar sets share at least so many keys; those of long lists must make them up.
        live = long.join(self.live(long).select("key"), "key").groupBy("id", "n").agg(F.count("*").alias("f"))
        out = stored(live.where(F.col("f") >= F.expr(f"{EXTRA} * n DIV 100")).select("id"), "extended")
        discard(index)
        return out

    def levels(self, docs: DataFrame) -> np.ndarray:
        """The levels of the tokens' slots: 1 if more than ``frequent`` of the documents have one, one more for each doubling."""
        counts = postings(docs, lambda tokens: tokens, self.n).groupBy("key").count().where(F.col("count") > self.frequent)
        slot = F.pmod("key", F.lit(SLOTS))
        size = 8 * 4096  # of a bitmap that Spark builds
        level = F.length(F.bin(F.expr(f"(count - 1) DIV {max(1, self.frequent)}"))).alias("level")
        maps = counts.groupBy((slot / size).cast("int").alias("at"), level).agg(F.bitmap_construct_agg(slot % size).alias("bits")).collect()
        out = np.zeros(SLOTS, "u1")
        for row in maps:
            part = out[row["at"] * size : (row["at"] + 1) * size]
            np.maximum(part, row["level"] * np.unpackbits(np.frombuffer(row["bits"], "u1"), bitorder="little"), out=part)
        return out

    def combined(self, extended: DataFrame) -> None:
        """Compares the given nodes by rare tokens and by combinations of frequent ones."""
        docs = self.docs.join(small(extended), self.docs["doc_id"] == extended["id"], "left_semi")
        docs = stored(docs, "extended-texts")
        levels, percent = docs.sparkSession.sparkContext.broadcast(self.levels(docs)), self.percent
        index = self.lists(docs, lambda tokens: combined_keys(tokens, percent, levels.value))
        self.star(index, docs, *(F.xxhash64("id", F.lit(k)) for k in range(HUBS)))
        # Now any component of a list may give the next ones, however few nodes it has.
        self.star(index, docs, *(F.struct(F.xxhash64("id_root", F.lit(k)), F.xxhash64("id", F.lit(k))) for k in range(HUBS)))
        left = stored(index.join(self.live(index), "key").select("id", "n").distinct(), "left")
        # A few dozen classes for each power of two.
        present = sorted(r["c"] for r in left.select(size_class_of("n").alias("c")).distinct().collect())
        if present:
            rest = docs.join(small(left), docs["doc_id"] == left["id"], "left_semi")
            wide = shingles(rest, self.n, WIDE).select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), *WIDE)
            wide = stored(wide.dropDuplicates(["id"]), "wide")
            sized = self.lists(rest, lambda tokens: sized_keys(tokens, percent, levels.value, present), wide)
            self.compare(self.across(sized, sized=True).select("a", "hub"), docs)
            discard(sized, wide)
        discard(index, left, docs)

    def run(self) -> _Join:
        extended = self.singly()
        if extended.limit(1).count():
            self.combined(extended)
        discard(extended)
        return self


def links(docs: DataFrame, percent: int = PERCENT, frequent: int = FREQUENT, n: int = SHINGLE) -> DataFrame:
    """(a, b): verified links between class representatives that suffice to join every component."""
    found = _Join(docs, percent, frequent, n).run().links
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def join(docs: DataFrame, percent: int = PERCENT, frequent: int = FREQUENT, n: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    done = _Join(docs, percent, frequent, n).run()
    return done.rooted(done.members, "low").select("doc_id", "n_shingles", F.coalesce("low_root", "doc_id").alias("component_id"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id AND r.root < l.b),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.root, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.id = w.doc_id
"""

"""Secret scans over a trigram inverted index.

Each rule's regular expression yields a Boolean trigram query: every match holds all trigrams of
at least one of the rule's literals. The whole texts are cut into trigrams of their ASCII-folded bytes, and
those that any query names are stored as an index of postings (trigram, row). Postings are intersected
per literal and united per rule, and only the candidates are matched by the rule's regular expression, over
their whole texts. A rule without mandatory trigrams scans every document.

Null texts are empty; empty tables give no rows; extra columns are not read. Rows are known by a hash of their
doc_id and text: repeated rows and null doc_ids share postings, and where two hashes are equal by chance a text is
merely scanned in vain. Candidates are narrow rows, joined by broadcast if few by count and else by
shuffling. A very long text is cut and scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stored, table
from .shingling import utf8

ANY = re.ASCII | re.IGNORECASE
#: Kind -> (expression, least length, group it holds for); base kinds first, in listed order.
RULES = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ANY), 6, 2),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 20, 0),
    "hex": (re.compile(r"[0-9a-f]+"), 24, 0),
    "github": (re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), 40, 0),
    "slack": (re.compile(r"xox[abprs]-[A-Za-z0-9-]+"), 15, 0),
    "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 30, 0),
    "private_key": (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 27, 0),
}
BASE = ("assign", "access", "hex")
#: Bytes cut into trigrams at a time.
CHUNK = 1 << 20


def _alternatives(tree) -> list[str] | None:
    """Literals of which every match of a parsed expression holds one; None if there are none."""
    best: list[str] | None = None
    run = [""]

    def better(found):
        nonlocal best
        found = [x for x in found]
        if min(map(len, found)) >= 3 and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            run = [x + chr(arg) for x in run]
            continue
        if name in ("SUBPATTERN", "IN") and (inner := _strings([(op, arg)])) and len(inner) * len(run) <= 64:
            run = [x + y for x in run for y in inner]
            continue
        better(run)
        run = [""]
        if name == "MAX_REPEAT" and arg[0] > 0 and (inner := _alternatives(arg[2])):
            better(inner)
    better(run)
    return best


def _strings(tree) -> list[str] | None:
    """All strings a parsed expression of literals, branches and optional literals matches."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            more: list[str] | None = [chr(arg)]
        elif name == "BRANCH":
            each = [_strings(x) for x in arg[1]]
            more = None if None in each else [y for x in each for y in x]
        elif name == "SUBPATTERN":
            more = _strings(arg[3])
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            more = [chr(c) for _, c in arg]
        elif name == "MAX_REPEAT" and arg[0] == 0 and arg[1] == 1 and (inner := _strings(arg[2])):
            more = ["", *inner]
        else:
            more = None
        if more is None or len(out) * len(more) > 64:
            return None
        out = [x + y for x in out for y in more]
    return out


def trigram_query(expression: re.Pattern) -> list[set[str]] | None:
    """A disjunction of conjunctions of folded trigrams, or None for a full scan."""
    from re import _parser

    literals = _alternatives(_parser.parse(expression.pattern, expression.flags & ~re.UNICODE if expression.flags & re.ASCII else 0))
    if not literals:
        return None
    return [{x[i : i + 3] for i in range(len(x) - 2)} for x in {fold(x) for x in literals}]


_FOLD = {c: c + 32 for c in range(65, 91)}


def fold(text: str) -> str:
    return text.translate(_FOLD) if not text.isascii() else text.lower()


def find(kind: str, text: str) -> list[tuple[int, int]]:
    expression, least, group = RULES[kind]
    return [m.span() for m in expression.finditer(text) if m.end(group) - m.start(group) >= least]


def _joined(spans, order) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted((s, order.index(k), e, k) for k, s, e in spans))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"))


def index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, row): the stored postings of the given trigrams, by position in the list."""
    codes = [int.from_bytes(g.encode(), "big") for g in grams]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << 24, -1, "i2")
        place[codes] = np.arange(len(codes))
        lower = np.arange(256, dtype="u1")
        lower[65:91] += 32
        for batch in batches:
            rows = batch.column("row").to_numpy()
            data, at = utf8(batch.column("text"))
            found = []
            for start in range(int(at[0]), int(at[-1]), CHUNK):
                part = lower[data[start : min(start + CHUNK + 2, int(at[-1]))]].astype("i4")
                gram = place[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
                hit = np.flatnonzero(gram >= 0)
                row = np.searchsorted(at, hit + start, "right") - 1
                inside = hit + start + 3 <= at[row + 1]  # not across two texts
                found.append(np.unique(gram[hit[inside]].astype("i8") << 40 | row[inside]))
            both = np.unique(np.concatenate(found)) if found else np.zeros(0, "i8")
            yield pa.RecordBatch.from_arrays([pa.array((both >> 40).astype("i4")), pa.array(rows[both & (1 << 40) - 1])], ["gram", "row"])

    return stored(_keyed(docs).select("text", "row").mapInArrow(run, "gram int, row long"), "trigrams")


def candidates(postings: DataFrame, plans: dict[str, list[set[str]] | None], grams: list[str]) -> DataFrame:
    """(row, kinds): the rules whose Boolean trigram query a row satisfies."""
    place = {g: k for k, g in enumerate(grams)}
    terms = [(kind, n, place[g], len(c)) for kind, q in plans.items() for n, c in enumerate(q or ()) for g in c]
    # As many rows as the rules' literals have trigrams.
    query = F.broadcast(postings.sparkSession.createDataFrame(terms, "kind string, literal int, gram int, size int"))
    met = postings.join(query, "gram").groupBy("row", "kind", "literal", "size").agg(F.count_distinct("gram").alias("n"))
    return met.where("n = size").groupBy("row").agg(F.collect_set("kind").alias("kinds"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256, spans of every document."""
    plans = {k: trigram_query(r[0]) for k, r in RULES.items()}
    grams = sorted({g for q in plans.values() if q for c in q for g in c})
    order, always = list(RULES), [k for k, q in plans.items() if q is None]
    found = stored(candidates(index(docs, grams), plans, grams), "candidates")
    source = _keyed(docs).join(small(found), "row", "left").select("doc_id", "text", "kinds")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, text, kinds in zip(batch["doc_id"], batch["text"], batch["kinds"]):
                spans = [(k, s, e) for k in (*always, *(kinds if kinds is not None else ())) for s, e in find(k, text)]
                base = [x for x in spans if x[0] in BASE]
                n = [sum(x[0] == k for x in base) for k in BASE]
                out.append((None if pd.isna(i) else int(i), *n, hashlib.sha256(_joined(base, order).encode()).hexdigest(), _joined(spans, order)))
            yield pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return source.mapInPandas(run, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))

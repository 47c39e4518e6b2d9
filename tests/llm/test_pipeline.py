"""The pipeline's stages against brute force, with null and repeated doc_ids and clashing columns."""

import random
import re

import pytest

import corpus_pipeline as P

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, taken string, doc string, b0 long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, 2, "x", "y", 3) for i, t, s in rows], SCHEMA)


def words(t):
    return [w for w in SPACE.split(t or "") if w]


def prose(rng, n=80):
    return " ".join(rng.choice("red green blue ink paper stone river hill".split()) + str(rng.randrange(500)) for _ in range(n))


@pytest.fixture
def rows():
    rng = random.Random(5)
    base = [prose(rng) for _ in range(12)]
    out = [(i, t, "ab"[i % 2]) for i, t in enumerate(base)]
    out += [(100 + i, base[i] + " more", None) for i in range(4)]  # near copies
    out += [(200 + i, base[i].replace(" ", "  \n"), "a") for i in range(4)]  # exact copies after normalisation
    out += [(None, prose(rng), "a"), (None, base[0], "a"), (3, prose(rng), "b"), (3, base[3], "b"), (300, "few", "a"), (301, None, "a"), (302, "", None)]
    return [*out, (400, prose(rng, 60_000), "c")]


def got(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=repr)


def test_stages_match_brute_force(spark, rows):
    docs = frame(spark, rows)
    kept = P.quality(spark, docs, "")
    assert kept.columns == docs.columns
    want = [r for r in rows if len(words(r[1])) >= 50]
    assert got(kept) == sorted(want, key=repr)
    exact = P.exact(spark, kept, "")
    first = {}
    for r in want:
        first.setdefault(SPACE.sub(" ", r[1]), []).append(r)
    left = got(exact)
    assert exact.columns == docs.columns and len(left) == len(first)
    for r in left:
        group = first[SPACE.sub(" ", r[1])]
        assert r in group and r[0] == min((x[0] for x in group if x[0] is not None), default=None)
    near = P.near(spark, exact, "")
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words(r[1].lower()) for r in left)]
    root = list(range(len(left)))
    for _ in left:
        for a in range(len(left)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    best = {}
    for r, k in zip(left, root):
        best[k] = min(best.get(k, r), r, key=lambda x: (x[0] is None, x[0] or 0))
    assert near.columns == docs.columns and got(near) == sorted(best.values(), key=repr)
    mixed = P.mixed(spark, near, "")
    assert mixed.columns == docs.columns
    total, texts = 0, {r[1] for r in best.values()}
    for r in mixed.collect():
        total += len(words(r.text))
        assert r.text in texts or any(words(t)[: len(words(r.text))] == words(r.text) for t in texts)
        assert r.n_chars == len(r.text)
    assert abs(total - sum(len(words(t)) for t in texts)) <= 3
    packed = P.packed(spark, mixed, "").collect()
    assert sum(r.doc_tokens for r in packed if r.start == 0) == sum(r.length for r in packed)


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")] and docs.count() == 0
    assert P.packed(spark, docs, "").count() == 0

"""What the operators leave on disk and send between tasks."""

import hashlib
import random
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as P

from lodestone.functions.storage import CLEANUP, shared_dir, stored
from lodestone.llm import ngram_jaccard, substring_dedup


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in files.split("\n") if "/shuffle_" in x}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    before, setting = shuffles(spark), spark.conf.get(CLEANUP, None)
    out = stored(spark.range(1000).groupBy(F.pmod("id", F.lit(7)).alias("k")).count(), "counts")
    assert out.count() == 7 and spark.conf.get(CLEANUP, None) == setting
    stored(spark.range(1000).repartition(3, "id"), "dealt")
    left = shuffles(spark) - before
    # The count above is a query of its own, whose files wait for the garbage collection.
    assert len(left) <= 4


def test_jaccard_verifies_few_pairs_of_sets_with_a_common_passage(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    passages = [" ".join(word() for _ in range(30)) for _ in range(6)]
    rows = [" ".join([*rng.sample(passages, 2), *(word() for _ in range(200))]) for _ in range(80)]
    rows += [t + " end" for t in rows[:10]]
    sent = []
    verified = ngram_jaccard._verified
    monkeypatch.setattr(ngram_jaccard, "_verified", lambda pairs, texts, *a: sent.append((pairs.count(), texts.count())) or verified(pairs, texts, *a))
    got = {r.doc_id: r.component_id for r in ngram_jaccard.join(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == {i: i - 80 if i >= 80 else i for i in range(90)}
    # Ten pairs are similar.
    assert sum(n for n, _ in sent) <= 30 and sum(n for _, n in sent) <= 40, sent


def test_jaccard_verifies_few_pairs_of_near_copies_that_are_too_far(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(70):
        text = list(base)
        for at in rng.sample(range(300), 4 + k % 8):
            text[at] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(text[: len(text) - k % 5]))
    sent = []
    verified = ngram_jaccard._verified
    monkeypatch.setattr(ngram_jaccard, "_verified", lambda pairs, texts, *a: sent.append(pairs.count()) or verified(pairs, texts, *a))
    out = ngram_jaccard.join(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), frequent=6)
    got = {r.doc_id: r.component_id for r in out.collect()}
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, rows)]
    root = list(range(70))
    for a, b in [(a, b) for a in range(70) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]:
        one, other = sorted((root[a], root[b]))
        root = [one if r == other else r for r in root]
    assert got == dict(enumerate(root))
    # 4 pairs are left after the hubs; with one index for partners of any size 236 were.
    assert sent[-1] <= 60, sent


def test_substring_dedup_compares_few_windows_of_short_shared_passages(spark, monkeypatch):
    rng = random.Random(6)
    phrases = ["".join(rng.choices("abcdefgh ", k=30)) for _ in range(40)]
    rows = ["".join(rng.choice(phrases) + "".join(rng.choices("stuvwxyz", k=12)) for _ in range(40)) for _ in range(40)]
    rows += [rows[3][100:400] + rows[9][:90], rows[5][7:77] + "é" + rows[5][500:560] + rows[41 % 7][3:52], None, ""]
    windows, strings = [], substring_dedup._strings

    def counted(df, of, length):
        out = strings(df, of, length)
        if of is substring_dedup._windows:
            windows.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "_strings", counted)
    out = substring_dedup.dedup(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    # The steps' shuffles are gone by now: what is left reads the texts once.
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    seen, want = set(), {}
    for i, t in enumerate(rows):
        b = (t or "").encode()
        gone, grams = [False] * len(b), [b[k : k + 50] for k in range(len(b) - 49)]
        for k, g in enumerate(grams):
            if g in seen:
                gone[k : k + 50] = [True] * 50
        seen |= set(grams)
        want[i] = (sum(gone), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in out.collect()} == want and sum(n for n, _ in want.values()) > 400
    # Of 65,000 windows; with names by grams of 18 bytes alone 24,788 were compared.
    assert windows[0] < 3000, windows


def test_stages_keep_no_copies_of_the_documents(spark):
    rng = random.Random(4)
    base = [" ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(900)) for _ in range(60)]
    rows = list(enumerate([*base, *base[:5], *(t + " end" for t in base[5:10]), "few", None])) + [(None, base[20]), (7, base[21] + "  ")]
    rows = [(i, t, "en", "ab"[k % 2], len(t or ""), 1, "x") for k, (i, t) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, path string")
    folder = Path(shared_dir(spark).removeprefix("file://"))

    def size(at):
        return sum(f.stat().st_size for f in at.rglob("*.parquet"))

    docs = stored(frame.repartition(3), "input")
    before, own = size(folder), 0
    whole = size(Path(docs.stored_at.removeprefix("file://")))
    for name, stage in P.STAGES[:-1]:
        columns, docs = docs.columns, stored(stage(spark, docs, ""), name)
        assert docs.columns == columns
        own += size(Path(docs.stored_at.removeprefix("file://")))
        if name == "ngram_jaccard":
            # 20 and 21 were copied under no doc_id and under 7, which is the lesser.
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted([*range(21), *range(22, 60), 7])
    assert docs.count() >= 60
    assert size(folder) - before - own < whole / 2

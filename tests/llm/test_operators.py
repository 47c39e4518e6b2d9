"""The operators against brute force on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline

from lodestone.llm import exact_dedup, html_extract, mixing, ngram_jaccard, packing, quality_classifier, quality_rules, secret_scan, substring_dedup, warc
from lodestone.llm.common import fresh_path, stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n long"


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[i], len(t or ""), "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def texts(seed=1, n=40):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("red green blue ink paper stone river hill".split()) + str(rng.randrange(60)) for _ in range(rng.randrange(3, 120))) for _ in range(n)]
    near = [b + " tail end" for b in base[:8]]
    return [None, "", " \t\n", "one", "A b c", *base, *near, *base[:5], "x" * 5000]


def test_substring_dedup_matches_brute_force(spark):
    rows = texts()
    seen, want = set(), {}
    for i, t in enumerate(rows):
        b = (t or "").encode()
        gone = [False] * len(b)
        grams = [b[k : k + 50] for k in range(len(b) - 49)]
        for k, g in enumerate(grams):
            if g in seen:
                gone[k : k + 50] = [True] * 50
        seen |= set(grams)
        want[i] = (len(b), sum(gone), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    got = substring_dedup.dedup(docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in got} == want


def test_jaccard_components_match_brute_force(spark):
    rows = texts()
    sets = []
    for t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    for frequent in (1000, 1):
        got = ngram_jaccard.join(docs(spark, rows), frequent=frequent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_exact_dedup(spark):
    rows = ["a  b", "a b", None, "", "c", "a\tb"]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(docs(spark, rows)).collect()}
    assert got == {0: (0, 3, True), 1: (0, 3, False), 5: (0, 3, False), 2: (2, 2, True), 3: (2, 2, False), 4: (4, 1, True)}


def test_quality_rules_measure_repeats(spark):
    rows = ["a b c a b c d", None, "x", "p q r p q r p q r", "l\nl\nm"]
    got = {r.doc_id: r for r in quality_rules.measure(docs(spark, rows)).collect()}
    assert [got[i].n_repeat_words for i in range(5)] == [6, 0, 0, 9, 0]
    assert got[4].n_dup_lines == 1 and got[1].n_words == 0
    assert quality_rules.ablation(quality_rules.ledger(docs(spark, rows))).where("rule = 'few_words'").first().failed == 5


def test_mixing_cuts_budgets_exactly(spark):
    rng = random.Random(2)
    rows = [" ".join(["w"] * rng.randrange(0, 30)) for _ in range(300)]
    sources = [rng.choice(["a", "b", "c", None]) for _ in rows]
    got = mixing.mix(docs(spark, rows, sources)).collect()
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(sources[r.doc_id], [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= 1 for t, n in by.values())
    assert sum(t for t, _ in by.values()) == pytest.approx(sum(r.size for r in got))


def test_packing_covers_every_token_once(spark):
    from tokenizers import Tokenizer

    rows = texts()
    t = Tokenizer.from_file(packing.default_vocabulary())
    got = packing.pack(docs(spark, rows), window=64).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        ids = [*t.encode(rows[r.doc_id] or "", add_special_tokens=False).ids, 2]
        part = ids[r.start : r.start + r.length]
        assert r.start == by.get(r.doc_id, 0) and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
        by[r.doc_id] = r.start + r.length
    bins = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 64 and len(by) == len(rows)


def test_secret_scan_matches_full_scan(spark):
    rows = [None, "", "my Password: 'abcdef12' api_key=short1 APIKEY=12345", "AKIA" + "A1" * 10, "x" + "0af" * 9, "token=" + "a" * 30, "ghp_" + "a1" * 20]
    got = {r.doc_id: r.spans for r in secret_scan.scan(docs(spark, rows)).collect()}
    for i, t in enumerate(rows):
        spans = [(s, list(secret_scan.RULES).index(k), e, k) for k in secret_scan.RULES for s, e in secret_scan.find(k, t or "")]
        assert got[i] == ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans))


def test_secret_counts_match_a_plain_scan(spark):
    rng = random.Random(9)
    bits = ["password=hunter22", 'API_KEY": "abcdef123"', "Token : x.y-z_9", "AKIA" + "Q7" * 9, "deadbeef" * 4, "secre", "ab12" * 5, "é", " ", "\n", "pass", "word", "tok", "en=abcdefgh", "x" * 3000, "PASSWD='" + "9" * 30]
    rows = [None, "", *("".join(rng.choices(bits, k=rng.randrange(1, 12))) for _ in range(200)), "y" * 2_000_000 + " secret=abcdef99"]
    word = re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    got = {r.doc_id: r for r in secret_scan.scan(docs(spark, rows).union(docs(spark, rows[:3]))).collect()}
    for i, t in enumerate(rows):
        found = [(m.start(), 0, "assign", m.end()) for m in word.finditer(t or "") if len(m[1]) >= 6]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        r, kinds = got[i], [x[2] for x in found]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found)).encode()).hexdigest()


PAGE = "<html><head><title>t</title></head><body><nav>menu</nav>{a}<footer>f</footer></body></html>"


def test_html_extraction(spark):
    rows = [
        (1, "http://h/a/1", PAGE.format(a="<p>Shared top</p><p>First &amp;  own</p><p>Shared end</p>")),
        (2, "http://h/a/2", PAGE.format(a="<p>Shared top</p><p>Second own</p><p>Shared end</p>")),
        (3, "http://h/a/3", PAGE.format(a="<article><h1>T</h1><p>x<b>y</b><p>z</article>")),
        (4, None, None),
    ]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got[3] == "T\nxy\nz" and got[4] == ""
    assert "First & own" in got[1] and "Second own" in got[2]
    a, b = list("xabcy"), list("zabcw")
    assert html_extract.shared_lines(a, b) == {1, 2, 3} and html_extract.shared_lines(a, []) == set()


def test_warc_round_trip(spark):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, "v\r\nx", None), (4, None, "\r\n\r\nhé"), (5, "w", "")]
    df, folder = spark.createDataFrame(rows, "page_id long, url string, html string"), fresh_path(spark, "warc")
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(warc.write(df, folder), folder).collect()}
    assert got == {1: (4, "revisit", 2), 2: (4, "response", None), 3: (0, "revisit", 5), 4: (7, "response", None), 5: (0, "response", None)}


def test_warc_digests_revisits_and_odd_rows(spark):
    import base64
    import gzip

    rng = random.Random(4)
    rows = [(i, f"http://h/{i}", rng.choice(["", "a", "bb" * 50, None, "é" * 9, "z" * 1_500_000]), "clash") for i in range(60)]
    rows += [(None, "n", "a", "c"), (None, "m", "only"), (7, "again", rows[7][2], "c")]
    rows = [(*r, "c")[:4] for r in rows]
    df, folder = spark.createDataFrame(rows, "page_id long, url string, html string, digest string"), fresh_path(spark, "warc")
    index = warc.write(df, folder)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(index, folder).collect()), key=repr)
    last = {}
    for i, _u, h, _c in rows:
        last[h or ""] = max((x for x in (i, last.get(h or "")) if x is not None), default=None)
    want = []
    for i, _u, h, _c in rows:
        data, k = (h or "").encode(), last[h or ""]
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), sha, "response" if i == k else "revisit", None if i == k else k))
    assert got == sorted(want, key=repr)
    paths = {r.path for r in index.collect()}
    records = b"".join(gzip.open(p).read() for p in paths)
    ids = re.findall(rb"WARC-Record-ID: (\S+)", records)
    assert len(ids) == len(set(ids)) == len(rows) and records.count(b"WARC-Date: 2") == len(rows)
    assert warc.read(warc.write(df.limit(0), folder), folder).count() == 0


def test_classifier_learns_held_out_rows(spark):
    rng = random.Random(3)
    words = {1: ["river", "stone", "light"], 0: ["zzx", "qqv", "xxk"]}
    rows = [" ".join(rng.choices(words[i % 2], k=20)) for i in range(200)] + [None, ""]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    out = [r for r in quality_classifier.score(df, quality_classifier.fit(df, labels)).collect()]
    assert len(out) == 202
    assert all(r.predicted == r.doc_id % 2 for r in out if r.held_out and r.doc_id < 200)


def test_score_equals_the_mean_of_the_whole_texts_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    model = (rng.normal(size=(quality_classifier.BUCKETS, quality_classifier.DIM)).astype("float32"), rng.normal(size=(2, quality_classifier.DIM)), rng.normal(size=2))
    rows = ["one two two", "x" * 5000, "y" * 41 + "a " + "y" * 41 + "b", "", None, "é ü\tß"]
    got = {r.doc_id: r.score for r in quality_classifier.score(docs(spark, rows), model).collect()}
    full = (1 << 64) - 1

    def mixed(h):
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & full
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) & full
        return (h ^ h >> 31) & full

    def poly(cs, base):
        return sum(ord(c) * pow(base, k, 1 << 64) for k, c in enumerate(cs)) & full

    for i, t in enumerate(rows):
        ids = []
        for w in (t or "").split():
            b = f"\n{w} "
            grams = [poly(b[k : k + n][::-1], 0xC2B2AE3D27D4EB4F) for n in (3, 4) for k in range(len(b) - n + 1)]
            ids += [mixed(h) % quality_classifier.BUCKETS for h in [mixed(poly(w, 0x9E3779B97F4A7C15)), *grams]]
        mean = model[0][ids].astype(float).mean(0) if ids else np.zeros(quality_classifier.DIM)
        z = model[1] @ mean + model[2]
        assert got[i] == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), abs=1e-6)


def test_classifier_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.score(docs(spark, ["a b", None]), quality_classifier.fit(docs(spark, ["a b", None]), none)).where("score = 0.5").count() == 2
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_classifier.score(empty, quality_classifier.fit(empty, none)).count() == 0


@pytest.mark.parametrize("f", [exact_dedup.groups, ngram_jaccard.join, mixing.mix, packing.pack, secret_scan.scan, substring_dedup.dedup, quality_rules.ledger])
def test_empty_tables(spark, f):
    assert f(spark.createDataFrame([], SCHEMA)).count() == 0


def test_word_wise_ids_equal_those_of_whole_texts():
    import random
    import struct

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    draw = random.Random(1)
    parts = ["a", "\x1d", "Σ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "́", "​", "　", "ᄀ", "ᅡ", "'s", "12", "<|endoftext|>", "İ", "!?", "\x00"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 9))) for _ in range(3000)]
    encode = packing.Encoder(packing.default_vocabulary(), True, words=50)
    got = [x for a in range(0, len(texts), 20) for x in encode(texts[a : a + 20])]
    assert got == [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing_encodes_each_part_of_words_once():
    import random
    import struct

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    draw = random.Random(2)
    stems = ["tree", "Maß", "été", "ÀÿØ", "it's", "we'll", "don't", "'S", "12", "a1b2", "°µ²", "<|", "</w>", "``~", "@[", "ij"]
    marks = ["", ".", ",'", "'t", "!?", "×", "÷", "(", "|>"]
    texts = [draw.choice([" ", "\n", " \t"]).join("".join(draw.choices(stems + marks, k=3)) for _ in range(6)) for _ in range(2000)]
    texts += ["".join(draw.choices([chr(c) for c in range(32, 256)], k=30)) for _ in range(2000)]
    for words in (packing.WORDS, 300):
        encode = packing.Encoder(packing.default_vocabulary(), True, words=words)
        got = [x for a in range(0, len(texts), 100) for x in encode(texts[a : a + 100])]
        assert got == [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    encode, made = packing.Encoder(packing.default_vocabulary(), True), []
    encode._part_ids = lambda parts, ids=encode._part_ids: made.extend(parts) or ids(parts)
    for a in ("tree", "Tree", "TREE"):
        encode([" ".join(a + b for b in ("", ".", ",", "!", "s")), f"{a}\n{a}."])
    assert sorted(made) == ["!", ",", ".", "tree", "trees"]


def _bare(*lines):
    return "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"


@pytest.mark.parametrize("ranges", ["1", "2", "3", "7", "20"])
def test_html_differencing_reaches_past_copies_and_borders(spark, ranges):
    rows = [(0, "http://a/p", _bare("top", "a0", "end"))]
    rows += [(i, "http://a/q", _bare("top", "copy", "end")) for i in range(1, 31)]
    rows += [(31, "http://a/r", _bare("top", "r31", "end")), (32, "http://b/p", _bare("top", "alone", "end"))]
    rows += [(40 + i, f"http://c/{i:02}", _bare("head", f"own{i}", "foot")) for i in range(12)]
    want = {0: "a0", **{i: "copy" for i in range(1, 31)}, 31: "r31", 32: "top\nalone\nend", **{40 + i: f"own{i}" for i in range(12)}}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want


def test_packing_returns_the_ids_of_pieces_and_sequences(spark):
    from tokenizers import Tokenizer

    rows = [*texts(), "one"]
    t = Tokenizer.from_file(packing.default_vocabulary())
    made = stored(packing.pack(docs(spark, rows).union(docs(spark, rows[:4])), window=64), "packed")
    got = made.collect()
    assert len(got) == len({(r.sequence_id, r.offset) for r in got})
    for r in got:
        ids = [*t.encode(rows[r.doc_id] or "", add_special_tokens=False).ids, 2][r.start : r.start + r.length]
        assert r.ids == b"".join(i.to_bytes(4, "little") for i in ids)
    want = {}
    for r in sorted(got, key=lambda r: r.offset):
        want[r.sequence_id] = want.get(r.sequence_id, b"") + r.ids
    assert {r.sequence_id: (r.length, r.ids) for r in packing.sequences(made).collect()} == {k: (len(v) // 4, bytes(v)) for k, v in want.items()}
    assert corpus_pipeline.packed(spark, docs(spark, rows[:3]), "").where("octet_length(ids) = 4 * length").count() == 3


def test_substring_dedup_returns_spans_and_kept_bytes(spark):
    shared, other = "shared passage of sixty bytes or so, to be found twice over é" * 2, "another passage that is also found in the first of them all"
    rows = [f"one {shared} two {other} three", f"{other} four {shared} five", None, "short"]
    got = {r.doc_id: r for r in substring_dedup.dedup(docs(spark, rows)).collect()}
    for i, t in enumerate(rows):
        data, r = (t or "").encode(), got[i]
        edges = [0, *(x for s in r.spans for x in (s.start, s.end)), len(data)]
        assert edges == sorted(edges) and r.kept == b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), len(data) - len(r.kept), len(r.spans))
    assert got[0].spans == [] and got[1].kept == b"fourfive" and len(got[1].spans) == 2


def test_html_keeps_the_article_in_any_wrapper():
    def lines(html):
        return [x for x, _ in html_extract.lines_of(html)]

    for wrap in ("content has-sidebar", "site header-fixed", "post no-comments", "sidebar", "widget main"):
        assert lines(f"<body><div class='{wrap}'><p>lead</p><article><h1>T</h1><p>x</p></article></div><div class='ad'>no</div></body>") == ["lead", "T", "x"]
    assert lines("<body><div class='post has-sidebar'><p>x</p></div>") == ["x"]
    assert lines("<form id='all'><main><p>x</p></main></form><form><p>no</p></form>") == ["x"]
    assert lines("<article><div class='post-header'><h1>T</h1></div><div class='header'>H</div><p>x<span class='ad'>no</span></p></article>") == ["T", "H", "x"]
    assert lines("<article><p>x</p><div class='comments'><article>no</article></div></article><div id='comment-list'>no</div><div class='nav-menu'>no</div>") == ["x"]
    assert lines("<html><head><title>t</title><body><p>x</p><nav>no</nav></body></html>") == ["x"]
    assert lines("<head><meta charset=x><style>s</style><p>x") == ["x"] and lines("<head><title>t</title></head><p>x") == ["x"]


@pytest.mark.parametrize("name, sorts", [("_chunks", 1), ("_runs", 1), ("_same", 2), ("_closer", 1), ("_windows", 1)])
def test_substring_dedup_sorts_the_rows_of_a_task_once_for_each_verdict(monkeypatch, name, sorts):
    of, named, kinds = getattr(substring_dedup, name), name in ("_runs", "_closer"), ("_runs", "_same", "_closer")
    rng, n, calls = np.random.default_rng(4), 3000, []
    a, doc = rng.integers(0, 200, n) ** 2, np.sort(rng.integers(0, 40, n))
    b = np.zeros(n, "i8") if named else rng.integers(0, 3, n)
    for f in ("lexsort", "argsort"):
        monkeypatch.setattr(substring_dedup.np, f, lambda x, f=getattr(np, f): calls.append(len(x)) or f(x))
    got = substring_dedup._dealt(a.copy(), b, doc, doc, np.arange(n), np.arange(n) + 1, of).to_pydict()
    assert len(calls) == sorts
    monkeypatch.undo()
    bits = substring_dedup.LONG if name == "_chunks" else substring_dedup.SHORT
    assert [x >> bits for x in got["pos"]] == list(range(n)) and got["doc_id"] == doc.tolist()
    keys = list(zip(a.tolist(), b.tolist()))
    low, docs = {}, {}
    for key, d in zip(keys, doc.tolist()):
        low[key] = min(d, low.get(key, d))
    gone = [not named and d > low[key] for key, d in zip(keys, doc.tolist())]
    for (x, _), d, g in zip(keys, doc.tolist(), gone):
        docs.setdefault(x, set()).update(() if g else {d})
    want = [1 if g else 2 if name in kinds and len(docs[x]) > 1 else 0 for (x, _), g in zip(keys, gone)]
    assert got["verdict"] == want
    kept = [x == y for x, y in zip(got["a"], a.tolist())]
    assert all(k or v for k, v in zip(kept, want))
    left = {}
    for (x, _), d, k in zip(keys, doc.tolist(), kept):
        left.setdefault(x, set()).update({d} if k else ())
    assert name not in kinds or all({min(v), max(v)} <= left[x] for x, v in docs.items() if v)

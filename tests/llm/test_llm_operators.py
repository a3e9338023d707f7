"""Training-data operators against brute force and on hostile small tables."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from larder.llm import (chat, components, decontam, line_dedup, mixing, ngram_join, quality, queries, rules,
                        secret_scan, skew, substring_dedup, toxicity)
from larder.llm import text as X

SF = "/root/testdata/sf0.001"
# extra columns that carry names the operators use inside
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row string, id long, th long, hits array<int>, "
          "n_words long, score double, kept boolean, key long, bucket int, rid long, component_id long, rate double, grade int")
EXTRA = ("r", 1, 2, [3], 4, 0.5, True, 5, 6, 7, 8, 0.1, 1)
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
PASSAGE = " ".join(f"common{i}" for i in range(60))


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), *EXTRA) for i, t, lang, src in rows], SCHEMA)


def hostile_rows():
    words = [f"v{i}" for i in range(200)]
    rnd = random.Random(4)
    base = " ".join(rnd.choice(words) for _ in range(120))
    near = base.split()
    near[60] = "changed"
    return [(1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "de", None), (4, None, None, None), (5, "", "en", "a"),
            (6, " \n\t ", "fr", "b"), (7, "one two", "en", "a"), (8, "one two", "en", "a"), (9, "ONE two", "en", "a"),
            (10, "solo", "en", "a"), (11, LONG, "en", "a"), (12, "x " + PASSAGE + " y z", "en", "a"), (13, PASSAGE, "es", "a"),
            (13, PASSAGE, "es", "a"), (None, PASSAGE, "es", "a"), (None, None, "es", "a"), (15, "tail " + PASSAGE, "en", "a"),
            (16, "café naïve\r\nzwei Zeilen\x0bdrei " * 7, "de", "a"), (17, "a\\b [INST] " * 20, "en", "a")]


@pytest.fixture(scope="module")
def hostile(spark):
    return make(spark, hostile_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, []).cache()


def words_of(text, lower=False):
    t = text or ""
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t) if lower else t)


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is not None, x) if not isinstance(x, float) else (True, x) for x in r[:2]))


# ---- text helpers -------------------------------------------------------------------------

def test_words_lines_and_hashes_match_python():
    texts = [r[1] for r in hostile_rows()]
    for limit in (1, 64, 1 << 18):
        got, hashes = [], {}
        for part in X.slices(pa.array(texts), limit):
            w = part.words()
            for i in range(part.n):
                a, z = w.first[i], w.first[i + 1]
                ws = [part.data[s:e].tobytes().decode() for s, e in zip(w.starts[a:z], w.ends[a:z], strict=True)]
                got.append(ws)
                for x, h in zip(ws, w.hashes[a:z].tolist(), strict=True):
                    assert hashes.setdefault(x, h) == h
                assert part.row_bytes(i).decode() == (texts[part.first + i] or "")
        assert got == [words_of(t) for t in texts]
        assert len(set(hashes.values())) == len(hashes)


# ---- 1 secret scan -------------------------------------------------------------------------

def test_secret_scan_learns_labels_and_edges(spark, hostile, empty):
    rnd = random.Random(1)
    rows = []
    for i in range(120):
        hexed = "".join(rnd.choice("0123456789abcdef") for _ in range(40))
        rows.append((i, f"set token = \"{hexed}\" now" if i % 2 else f"order {rnd.randrange(10**15, 10**16)} shipped", "en", "src/a"))
    docs = make(spark, rows)
    got = {r["doc_id"]: r for r in secret_scan.secret_scan(docs).collect()}
    assert len(got) == 120 and all(got[i]["is_secret"] == bool(i % 2) for i in got)
    for i, t, *_ in rows:
        value = t[got[i]["char_start"]:got[i]["char_start"] + got[i]["length"]]
        assert hashlib.sha256(value.encode()).hexdigest() == got[i]["value_sha256"]
    # given labels decide, not the rule
    stats = secret_scan.corpus_statistics(docs)
    flipped = secret_scan.rule_labels(docs, stats).withColumn("label", 1 - F.col("label"))
    again = {r["doc_id"]: r["is_secret"] for r in secret_scan.secret_scan(docs, flipped).collect()}
    assert all(again[i] == (not i % 2) for i in again)
    assert secret_scan.secret_scan(empty).count() == 0
    none = spark.createDataFrame([], "doc_id long, char_start long, label int")
    assert all(r["score"] == 1.0 for r in secret_scan.secret_scan(docs, none).collect())
    assert secret_scan.secret_scan(hostile).filter("doc_id in (4, 5, 6)").count() == 0


def test_secret_scan_takes_whole_assigned_values_and_labelled_places(spark):
    values = {1: 'password = "p@ss!word"', 2: "PASSWD: hunter;x,", 3: "api_key='correct horse battery'", 4: "auth = \"öffne dich", 5: "secret: Zq",
              6: "token = \"\" then", 7: "tokens are nice: yes", 8: "password=\n\nnext line", 9: "nothing here qwertzuiop", 10: "credential: a1b2c3d4e5f6g7h8 end"}
    docs = make(spark, [(i, t, "en", "s") for i, t in values.items()])
    found = lambda df: {(r["doc_id"], values[r["doc_id"]].encode()[len(values[r["doc_id"]][:r["char_start"]].encode()):][:r["length"]].decode())
                        for r in df.collect()}
    want = {(1, "p@ss!word"), (2, "hunter;x"), (3, "correct horse battery"), (4, "öffne"), (5, "Zq"), (10, "a1b2c3d4e5f6g7h8")}
    assert found(secret_scan.secret_scan(docs)) == want
    # labelled places are candidates in any alphabet; blanks, places outside the text, nulls and unknown documents are not
    labels = spark.createDataFrame([(9, 13, 1), (9, 7, 0), (9, 8, 1), (9, 900, 1), (9, -1, 1), (None, 0, 1), (9, None, 1), (77, 1, 1), (10, 12, 1), (4, 8, 1)],
                                   "doc_id long, char_start long, label int")
    assert found(secret_scan.secret_scan(docs, labels)) == want | {(9, "qwertzuiop"), (9, "here")}
    assert secret_scan.secret_scan(docs.drop("source")).count() == len(want)


def secret_rows(rnd, n):
    """(doc_id, text, value, label): secrets and decoys in the same surroundings; only the value tells them apart."""
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: rnd.choice(["example", "changeme", "required", "placeholder", "disabled", "default", "documents", "settings"])
    hexed = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    secrets = [lambda: "".join(rnd.choice(alnum) for _ in range(rnd.randrange(20, 40))), lambda: "sk_" + "".join(rnd.choice(alnum) for _ in range(24)),
               lambda: "".join(rnd.choice(alnum + "!@#%") for _ in range(16))]
    decoys = [word, lambda: f"{word()}-{word()}", lambda: "-".join([hexed(8), hexed(4), hexed(4), hexed(4), hexed(12)]),
              lambda: f"/usr/share/{word()}/{word()}.conf", lambda: str(rnd.randrange(10 ** 15, 10 ** 16))]
    names = ["token", "password", "api_key", "secret"]
    out = []
    for i in range(n):
        label = i % 2
        value = rnd.choice(secrets if label else decoys)()
        out.append((i, f"{word()} {word()} {rnd.choice(names)} = \"{value}\" {word()} {word()}", value, label))
    return out


def test_secret_scan_held_out_findings_and_decoys(spark):
    """Precision and recall on held-out findings whose labels no name, sign or neighbour gives away."""
    rows = secret_rows(random.Random(21), 1200)
    docs = make(spark, [(i, t, "en", "conf/app") for i, t, _, _ in rows])
    train = spark.createDataFrame([(i, t.index(v), y) for i, t, v, y in rows if i % 3], "doc_id long, char_start long, label int")
    got = {r["doc_id"]: r for r in secret_scan.secret_scan(docs, train).collect()}
    held = [(got[i]["is_secret"], bool(y)) for i, t, v, y in rows if i % 3 == 0]
    assert len(got) == 1200 and all(got[i]["value_sha256"] == hashlib.sha256(v.encode()).hexdigest() for i, _, v, _ in rows)
    hit = sum(g and y for g, y in held)
    assert hit / sum(g for g, _ in held) > 0.95 and hit / sum(y for _, y in held) > 0.95


def test_rule_labelled_forest_judges_by_the_value(spark):
    """Labelled by rule, the forest finds the same kind of value away from any name, and refuses words behind one."""
    rnd = random.Random(5)
    hexed = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'token = "{hexed()}" then' if i % 2 else f"order {rnd.randrange(10**15, 10**16)} shipped required", "en", "a") for i in range(200)]
    rows += [(500 + i, f"the value {hexed()} lies bare", "en", "a") for i in range(10)]
    rows += [(600 + i, "password: required", "en", "a") for i in range(10)]
    got = {r["doc_id"]: r["is_secret"] for r in secret_scan.secret_scan(make(spark, rows)).collect()}
    assert all(got[i] == bool(i % 2) for i in range(200))
    assert not any(got[600 + i] for i in range(10))
    assert sum(got[500 + i] for i in range(10)) >= 9


def test_forest_separates():
    rng = np.random.default_rng(0)
    x = rng.random((600, 5))
    y = ((x[:, 1] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    f = secret_scan.Forest().fit(x[:400], y[:400])
    assert ((f.predict(x[400:]) >= 0.5) == y[400:]).mean() > 0.93


# ---- 2 substring dedup ---------------------------------------------------------------------

def brute_substring(rows, width=13):
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        if i is not None:
            for k in range(len(w) - width + 1):
                g = tuple(w[k:k + width])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t, *_ in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k:k + width])] < i:
                gone[k:k + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, r[1:])


def test_substring_dedup_brute_force(spark, hostile, empty, monkeypatch):
    rows = hostile_rows()
    want = sorted(brute_substring(rows), key=key)
    got = sorted((tuple(r)[:4] for r in substring_dedup.substring_dedup(hostile).collect()), key=key)
    assert got == want
    assert substring_dedup.substring_dedup(empty).count() == 0
    # a small alphabet: anchors repeat everywhere; and a passage in a third of all documents, which makes hot anchors
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("ab") for _ in range(rnd.randrange(0, 60))) + (" " + PASSAGE + f" e{i} f{i} g" if i % 3 == 0 else ""), "en", "s")
            for i in range(700)]
    for hot_keys, sample in ((512, 1), (3, 2), (0, 64)):
        monkeypatch.setattr(substring_dedup, "HOT_KEYS", hot_keys)
        monkeypatch.setattr(substring_dedup, "SAMPLE", sample)
        got = sorted((tuple(r)[:4] for r in substring_dedup.substring_dedup(make(spark, rows).repartition(5)).collect()), key=key)
        assert got == sorted(brute_substring(rows), key=key)


# ---- 3 n-gram join -------------------------------------------------------------------------

def brute_components(rows, num=90, den=100, width=3):
    def shingles(t):
        w = words_of(t, True)
        return frozenset(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                if rows[a][0] is None or rows[b][0] is None:
                    ok = sets[a] == sets[b]
                else:
                    i = len(sets[a] & sets[b])
                    ok = den * i >= num * (len(sets[a]) + len(sets[b]) - i)
                if ok:
                    root[find(a)] = find(b)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(rows[k][0], len(sets[k]), least[find(k)]) for k in range(len(rows))]


def test_ngram_join_brute_force(spark, hostile, empty):
    def both(rows, df, **kw):
        got = sorted(((r["id"], r["n"], r["component_id"]) for r in ngram_join.link_components(df, **kw).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1], str(r[2])))
        want = sorted(brute_components(rows, kw.get("num", 90), kw.get("den", 100), kw.get("width", 3)), key=lambda r: (r[0] is not None, r[0] or 0, r[1], str(r[2])))
        assert got == want
    both(hostile_rows(), hostile)
    assert ngram_join.jaccard_join(empty).count() == 0
    # a large group of near copies, some short texts, and a passage in many different texts
    rnd = random.Random(2)
    words = [f"q{i}" for i in range(300)]
    base = [rnd.choice(words) for _ in range(100)]
    rows = []
    for i in range(260):
        t = list(base)
        for _ in range(rnd.randrange(0, 6)):
            t[rnd.randrange(100)] = f"e{i}_{rnd.randrange(9)}"
        rows.append((1000 - i, " ".join(t), "en", "s"))
    rows += [(2000 + i, " ".join(base[:40] + [rnd.choice(words) for _ in range(30)]), "en", "s") for i in range(60)]
    rows += [(3000 + i, " ".join(words[k] for k in range(i % 7, i % 7 + rnd.randrange(1, 14))), "en", "s") for i in range(120)]
    df = make(spark, rows).repartition(4)
    both(rows, df)
    both(rows, df, block_bytes=4096, long_list=2)   # grid of chunk pairs, probing almost every list
    both(rows, df, num=80, den=100, width=5)


def test_keep_one_of_each_takes_shingles_and_threshold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = []
    for kw in ({}, {"width": 5, "num": 80, "den": 100}):
        out = ngram_join.keep_one_of_each(docs, **kw)
        assert out.columns == docs.columns
        kept.append({r["doc_id"] for r in out.select("doc_id").collect()})
        assert kept[-1] == {i for i, _, c in brute_components(rows, **kw) if i == c}
    assert kept[1] < kept[0]


def test_t_occurrence_is_exact_for_any_list_split():
    rng = np.random.default_rng(3)
    for trial in range(30):
        base = rng.choice(400, 60, replace=False)
        sets = []
        for _ in range(40):
            s = set(base.tolist()) if rng.random() < 0.7 else set(rng.choice(400, 60).tolist())
            for _ in range(rng.integers(0, 6)):
                s.discard(int(rng.choice(base)))
                s.add(int(rng.integers(400, 900)))
            sets.append(np.array(sorted(s), np.uint64))
        want = list(range(40))
        for a in range(40):
            for b in range(a):
                i = len(np.intersect1d(sets[a], sets[b]))
                if 100 * i >= 90 * (len(sets[a]) + len(sets[b]) - i) and want[a] != want[b]:
                    old, new = want[a], want[b]
                    want = [new if w == old else w for w in want]
        for long_list in (0, 3, 1000):
            got = ngram_join.t_occurrence(sets, long_list=long_list)
            assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, x) for x in range(200, 260)] + [(7, 7), (300, 5), (9, 8)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[x] == 5 for x in range(200, 260)) and got[300] == 5
    assert got[9] == got[8] == 8 and 7 not in got
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_salted_join_equals_join(spark):
    left = spark.createDataFrame([(k % 3 if k % 2 else 9, k) for k in range(500)] + [(None, 1)], "k long, v long")
    right = spark.createDataFrame([(k, k * 10, 1) for k in (0, 1, 9)], "k long, w long, n long")
    got = skew.salted_join(left, right, ["k"], skew.hottest(right, ["k"], "w", 1), "v", 7).select("k", "v", "w")
    assert as_rows(got) == as_rows(left.join(right, "k").select("k", "v", "w"))


# ---- 4 quality, 8 toxicity -----------------------------------------------------------------

def labelled_corpus(spark, n=600):
    rnd = random.Random(7)
    vocab = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(20, 80))]
        low, toxic = i % 5 == 0, i % 4 == 0
        if low:
            w = [x + "%%%" for x in w]
        if toxic:
            w[rnd.randrange(len(w))] = rnd.choice(["slur1", "slur2"])
        docs.append((i, " ".join(w), "en" if i % 3 else "de", "s"))
        labels.append((i, 0 if low else 1, int(toxic)))
    return docs, make(spark, docs), spark.createDataFrame(labels + [(None, 1, 1), (0, None, None), (99999, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_classifier(spark, hostile, empty):
    docs, df, labels = labelled_corpus(spark)
    got = {r["doc_id"]: r for r in quality.quality(df, labels).collect()}
    assert np.mean([got[i]["selected"] == (i % 5 != 0) for i in got]) > 0.98
    assert all(0 <= r["expected_grade"] <= 2 and r["p_top"] <= r["p_tail"] + 1e-9 for r in got.values())
    kept = quality.keep_accepted(df, labels)
    assert kept.schema == df.schema and kept.count() == sum(r["selected"] for r in got.values())
    none = labels.filter("false")
    assert quality.keep_accepted(hostile, none).count() == hostile.count()
    assert quality.quality(hostile, labels).count() == hostile.count()
    assert quality.quality(empty, labels).count() == 0


def test_toxicity(spark, hostile, empty):
    docs, df, labels = labelled_corpus(spark)
    model = toxicity.train(df, labels, "crc32(cast(doc_id as string)) % 5 <> 0")
    got = toxicity.score(df, model).withColumn("held", F.expr("crc32(cast(doc_id as string)) % 5 = 0")).collect()
    held = [r for r in got if r["held"]]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.95
    # the score is that of the text alone
    moved = toxicity.score(df.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.col("doc_id") + 7), model)
    assert {r["doc_id"] - 7: r["score"] for r in moved.collect()} == {r["doc_id"]: r["score"] for r in got}
    out = toxicity.score(hostile, model).collect()
    assert len(out) == hostile.count() and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (4, 5, 6)}) == 1
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train(df, labels.filter("false")) is None
    assert {r["score"] for r in toxicity.score(hostile, None).collect()} == {0.0}


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    n = 9000  # four documents to a word
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.floor(F.col("id") / 4).cast("string")).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 10 == 0).cast("int").alias("toxic"))
    fit = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) != 0)
    words = fit.groupBy("text").count().filter(f"count >= {toxicity.MIN_DOCS}").count()
    assert abs(len(toxicity.train(docs, labels, epochs=0).vocab) - words) <= 5  # words may share a bucket
    # shards of a few documents: still learnt, and the same model however the rows lie
    monkeypatch.setattr(toxicity, "SHARD_DOCS", 150)
    _, df, lab = labelled_corpus(spark)
    condition = "crc32(cast(doc_id as string)) % 5 <> 0"
    one, two = (toxicity.train(x, lab, condition) for x in (df, df.repartition(7)))
    assert np.array_equal(one.E, two.E) and np.array_equal(one.u, two.u) and one.thresholds == two.thresholds
    held = toxicity.score(df, one).filter("crc32(cast(doc_id as string)) % 5 = 0").collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held]) > 0.95


def test_toxicity_thresholds_are_the_best_of_all_rows(spark):
    rnd = random.Random(3)
    rows = [(int(rnd.random() < 0.3), lang, rnd.randrange(200) / 200) for lang in ("", "de", "en") for _ in range(400)]
    rows += [(0, "few", 0.1)] * 5 + [(1, "few", 0.2)]
    got = toxicity.thresholds(spark.createDataFrame(rows, "label int, lang string, score double"))
    assert set(got) == {"", "de", "en"}  # one positive is too few

    def f1(part, cut):
        said = [y for y, _, s in part if s >= cut]
        return 2 * sum(said) / (len(said) + sum(y for y, _, _ in part))
    for lang, cut in got.items():
        part = [r for r in rows if r[1] == lang or lang == ""]
        assert abs(f1(part, cut) - max(f1(part, s) for _, _, s in part)) < 1e-12
    assert toxicity.thresholds(spark.createDataFrame([(0, "", 0.2)], "label int, lang string, score double")) == {"": 0.5}


# ---- 5 chat --------------------------------------------------------------------------------

def test_chat_round_trip(spark):
    nasty = ["", None, "</s>", "[INST] x [/INST]", "\\", "\\[INST]", "a\\/s>", "[ROLE] u\nv[/ROLE]", "<s></s>", "[", "</", "é‍🙂", " lead", "trail ", "\n\n"]
    roles = ["user", "assistant", "assistant", "system", None, "to\nol", "[ROLE]", "user", "\\n"]
    rows = [(c, t, roles[(c + t) % len(roles)], nasty[(3 * c + t) % len(nasty)]) for c in range(12) for t in range(15)]
    rows += [(50, 0, "user", "hi"), (50, 0, "user", "hi"), (50, None, "assistant", "first"), (None, 1, "assistant", "lost"), (60, t := 0, "assistant", "z" * 5000)]
    rows += [(70, t, "assistant" if t % 2 else "user", f"turn {t} [/INST] " * 30) for t in range(400)]  # longer than a part
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, last string")
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "") for r in rows if r[0] == c)
        turns = [(o[3], o[5]) for o in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for part_chars in (1 << 16, 500, 1):
        out = chat.read_back(chat.format_chat(df, part_chars=part_chars)).collect()
        assert {r["conv_id"]: tuple(r)[1:5] for r in out} == want and len(out) == len(want)
    assert chat.read_back(chat.format_chat(df.filter("false"))).count() == 0


def test_loss_mask_binary_search():
    offs = np.array([[0, 3], [3, 5], [5, 9], [9, 12], [12, 12]])
    assert chat.loss_mask(offs, np.array([[3, 9], [9, 10]])).tolist() == [0, 1, 1, 0, 0]
    assert chat.loss_mask(offs, np.zeros((0, 2), int)).tolist() == [0] * 5


# ---- 6 line dedup --------------------------------------------------------------------------

def test_line_dedup_brute_force(spark, hostile, empty):
    rnd = random.Random(3)
    lines = [f"line {i} has words" for i in range(60)] + ["", "  "]
    shared = "\n".join(f"shared line {i} of a long notice" for i in range(30))
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(0, 12))) + ("\n" + shared + "\nend" if i % 3 == 0 else ""), "en", "s") for i in range(150)]
    rows += [(500 + k, rows[30][1], "en", "s") for k in range(5)] + [(505, rows[30][1], "en", "s")]
    seen, want = set(), {}
    for i, t, *_ in sorted(set(rows)):
        part = next(X.slices(pa.array([t])))
        ls, keep = t.split("\n"), None
        keep = [True] * len(ls)
        for _, a, z in line_dedup.Lines(part).shared_chunks(0):
            body = "\n".join(ls[a:z])
            if body in seen:
                keep[a:z] = [False] * (z - a)
            seen.add(body)
        want[i] = (len(ls), keep.count(False), hashlib.sha256("\n".join(x for x, k in zip(ls, keep, strict=True) if k).encode()).hexdigest())
    df = make(spark, rows).repartition(3)
    got = line_dedup.line_dedup(df).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(rows)
    assert any(w[1] > 10 for w in want.values())
    out = line_dedup.deduplicate_lines(df)
    assert out.columns == df.columns
    assert all(r["n_chars"] == len(r["text"]) for r in out.select("text", "n_chars").collect())
    assert line_dedup.deduplicate_lines(hostile).count() == hostile.count()  # nothing of several lines repeats here
    assert line_dedup.line_dedup(empty).count() == 0


def test_no_exact_copy_survives_the_line_stage(spark):
    texts = ["\n".join(f"text {n} line {k} has some words" for k in range(n)) for n in range(2, 14)]
    texts += [f"blank {e!r} a\n{e}\nblank {e!r} b\n{e}\nblank {e!r} c" for e in ("", "  ", "\n\t")]
    texts += ["\n\nedges 1 a\nedges 1 b\nedges 1 c\n \n", "\nedges 2 a\nedges 2 b", "edges 3 a\nedges 3 b\n", "cr a\r\ncr b\r\ncr c\r\n"]
    docs = make(spark, [(i + 1000 * c, t, "en", "s") for c in range(3) for i, t in enumerate(texts)]).repartition(3)
    rows = line_dedup.line_dedup(docs).collect()
    assert all(r["n_removed_lines"] == (r["n_lines"] if r["doc_id"] >= 1000 else 0) for r in rows)
    own = docs.select(*P.COLUMNS)
    sf = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS)
    for src, copies in ((own.filter("doc_id < 1000"), own.filter("doc_id >= 1000")), (sf, sf.withColumn("doc_id", F.col("doc_id") + 10**6))):
        kept = P.line_deduplication(spark, src.unionByName(copies), SF)
        ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
        several = [r["doc_id"] for r in copies.collect() if sum(bool(x.strip()) for x in (r["text"] or "").split("\n")) > 1]
        assert len(several) > 20 and not ids & set(several)
    assert ids >= {r["doc_id"] for r in P.line_deduplication(spark, sf, SF).select("doc_id").collect()}


def test_chunk_borders_resist_shifts():
    body = "\n".join(f"paragraph {i} of the same text" for i in range(200))
    parts = [next(X.slices(pa.array([t]))) for t in (body, "a new first line\n" + body)]
    sets = []
    for part in parts:
        ln = line_dedup.Lines(part)
        sets.append({part.data[ln.starts[a]:ln.ends[z - 1]].tobytes() for _, a, z in ln.shared_chunks(0)})
    assert len(sets[0] & sets[1]) >= len(sets[0]) - 2


def test_line_dedup_finds_all_repeated_runs(spark):
    rnd = random.Random(11)
    fresh = iter(range(10**6))
    alone = lambda: f"only line {next(fresh)} of its kind"
    passages = [[f"passage {p} line {k}" for k in range(n)] for n in (2, 2, 3, 4, 5, 6, 9) for p in [next(fresh)]]
    passages.append(["with a blank", "", "line inside"])
    rows = []
    for i in range(60):
        ls = [alone() for _ in range(rnd.randrange(0, 3))]
        for p in rnd.sample(passages, 2):
            a = rnd.randrange(0, len(p) - 1)
            ls += p[a:rnd.randrange(a + 2, len(p) + 1)] + [rnd.choice([alone(), "", "a single line that repeats"])]
        rows.append((i, "\n".join(ls), "en", "s"))
    seen, want, missed = set(), {}, 0
    for i, t, *_ in rows:
        ls, keep, own = t.split("\n"), None, []
        keep = [True] * len(ls)
        full = [k for k, x in enumerate(ls) if x.strip()]
        for a in full:  # every run of two or more word lines, wherever it stands
            for z in full:
                if z > a:
                    own.append((a, z + 1, tuple(ls[a:z + 1])))
        for a, z, run in sorted(own):
            if run in seen:
                keep[a:z] = [False] * (z - a)
                missed += z - a == 2
            seen.add(run)
        want[i] = [ls[k] for k in full if keep[k]]
    got = {r["row"]["doc_id"]: [x for x in r["clean_text"].split("\n") if x.strip()] for r in line_dedup.clean_lines(make(spark, rows).repartition(3)).collect()}
    assert got == want and missed > 20


# ---- 7 decontamination ---------------------------------------------------------------------

def brute_hits(text, items, width=13):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w = norm(text)
    hit, owners = set(), set()
    for item, t in items:
        iw = norm(t)
        n = min(len(iw), width)
        wins = {tuple(iw[k:k + n]) for k in range(len(iw) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k:k + n]) in wins:
                hit.update(range(k, k + n))
                owners.add(str(item))
    return len(w), hit, sorted(owners)


def test_decontamination_brute_force(spark, hostile, empty):
    rnd = random.Random(5)
    words = [f"b{i}" for i in range(12)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 5, 12, 13, 14, 30])))) for k in range(25)]
    items += [(90, items[3][1]), (91, None), (92, "..."), (None, "one two three four five")]
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, hits string")
    rows = [(i, " ".join(rnd.choice(words + ["ZZ", "B3"]) for _ in range(rnd.randrange(0, 40))) + " " + (items[i % 25][1].upper() if i % 3 == 0 else ""), "en", "s") for i in range(120)]
    items = [(("" if k is None else k), t) for k, t in items]
    for df, rs in ((make(spark, rows), rows), (hostile, hostile_rows())):
        for block in (1 << 20, 400):
            got = sorted(map(tuple, decontam.contamination(df, bench, block_bytes=block).collect()), key=lambda r: (r[0] is not None, r[0] or 0, str(r)))
            want = []
            for i, t, *_ in rs:
                n, hit, own = brute_hits(t, items)
                want.append((i, n, len(hit), len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= n))
            assert got == sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, str(r)))
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(hostile, bench.filter("false")).filter("n_hit > 0").count() == 0
    kept = decontam.drop_contaminated(hostile, bench)
    assert kept.schema == hostile.schema


def test_remove_spans_cuts_only_hits(spark):
    item = " ".join(f"k{i}" for i in range(13))
    rest = " ".join(f"r{i}" for i in range(400))
    docs = make(spark, [(1, f"Start, {item}! {rest}", "en", "s"), (2, rest, "en", "s"), (3, item, "en", "s")])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in decontam.remove_spans(docs, bench).collect()}
    assert got == {1: (f"Start, ! {rest}", 13), 2: (rest, 0)}


# ---- 9 rules -------------------------------------------------------------------------------

def test_rules_ledger(spark, hostile, empty):
    got = sorted(((r["doc_id"], r["n_words"], r["n_repeat_words"], r["base_failed"]) for r in rules.quality_rules(hostile).collect()), key=key)
    want = []
    for i, t, *_ in hostile_rows():
        w = words_of(t)
        n = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        rep = {p for k in range(len(w) - 4) if n[tuple(w[k:k + 5])] > 1 for p in range(k, k + 5)}
        want.append((i, len(w), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)))
    assert got == sorted(want, key=key)
    led = rules.ledger(hostile).cache()
    rows = {r["rule"]: r for r in rules.ablation(led, "v1").collect()}
    kept = rules.apply_policy(led, "v1").filter("kept").count()
    for k, name in enumerate(rules.RULES):
        without = {"x": tuple(r for r in rules.POLICIES["v1"] if r != name)}
        assert rows[name]["n_kept"] == kept
        assert rows[name]["n_kept_without"] == rules.apply_policy(led, "x", without).filter("kept").count()
        assert rows[name]["n_failed"] == led.filter(F.col("fail_bits").bitwiseAND(F.lit(1 << k).cast("long")) != 0).count()
    assert rules.quality_rules(empty).count() == 0
    both = {(r["policy"], r["rule"]): r for r in rules.ablations(led).collect()}
    assert set(both) == {(v, r) for v, names in rules.POLICIES.items() for r in names}
    masks = [r["fail_bits"] for r in led.select("fail_bits").collect()]
    for (version, name), r in both.items():
        mask, bit = rules.mask_of(rules.POLICIES[version]), rules.mask_of((name,))
        assert (r["n_failed"], r["n_only_this"]) == (sum(m & bit > 0 for m in masks), sum(m & mask == bit for m in masks))
        assert (r["n_kept"], r["n_kept_without"]) == (sum(m & mask == 0 for m in masks), sum(m & mask in (0, bit) for m in masks))
    assert rules.ablations(rules.ledger(empty)).count() == 0


# ---- 10 mixing -----------------------------------------------------------------------------

def test_mixing_reaches_targets(spark, hostile, empty):
    rnd = random.Random(8)
    vocab = {"en": [f"the{i}" for i in range(40)], "de": [f"der{i}" for i in range(40)], "fr": [f"le{i}" for i in range(40)]}
    rows = [(i, " ".join(rnd.choice(vocab[k]) for _ in range(rnd.randrange(5, 60))), k, "s") for i in range(400) for k in ["en" if i % 2 else "de" if i % 3 else "fr"]]
    docs = make(spark, rows)
    lab = spark.createDataFrame([(i, k) for i, _, k, _ in rows if i % 4 == 0 or i % 7 == 0] + [(None, "en"), (3, None), (77777, "en")], "doc_id long, domain string")
    targets = {"en": 0.2, "de": 0.3, "fr": 0.5, "absent": 3.0}
    out = mixing.mix(docs, lab, targets).collect()
    total = sum(r["n_tokens"] for r in out)
    assert total == sum(len(words_of(r[1])) for r in rows) and len(out) == len(rows)
    names = ["de", "en", "fr"]
    for k, name in enumerate(names):
        got = sum(r["rate"] * r["n_tokens"] * r["posterior"][k] for r in out) / total
        assert abs(got - targets[name]) < 1e-5
    assert all(r["rate"] >= 0 and abs(sum(r["posterior"]) - 1) < 1e-9 for r in out)
    assert np.mean([r["domain"] == rows[r["doc_id"]][2] for r in out]) > 0.95
    # brute force projected gradient on the same posteriors
    p = np.array([r["posterior"] for r in out])
    t = np.array([r["n_tokens"] for r in out]) / total
    r = np.ones(len(out))
    goal, unmixed = np.array([targets[n] for n in names]), t @ p
    for _ in range(300):
        gap = (t * r) @ p - goal
        if np.abs(gap).max() <= mixing.TOLERANCE:
            break
        r = np.maximum(0, r - p @ (gap / unmixed))
    assert np.allclose(r, [x["rate"] for x in out], atol=1e-6)
    assert all(x["max_gap"] <= mixing.TOLERANCE for x in out)
    with pytest.warns(RuntimeWarning, match="0 steps left a gap"):
        short = mixing.mix(docs, lab, targets, max_steps=0).collect()
    left = [sum(x["rate"] * x["n_tokens"] * x["posterior"][k] for x in short) / total - targets[name] for k, name in enumerate(names)]
    assert abs(short[0]["max_gap"] - max(map(abs, left))) < 1e-9 and short[0]["max_gap"] > mixing.TOLERANCE
    assert mixing.mix(hostile, lab, targets).count() == hostile.count()
    assert mixing.mix(empty, lab, targets).count() == 0
    assert {x["rate"] for x in mixing.mix(hostile, lab.filter("false"), targets).collect()} == {1.0}


def test_mixing_targets_hold_for_unrounded_posteriors(spark):
    rnd = random.Random(12)
    vocab = {k: [f"{k}{i}" for i in range(40)] for k in ("de", "en", "fr")}
    rows = []
    for i in range(300):  # mixed texts: mostly one language, up to a fifth of the words from another
        own, other = rnd.sample(sorted(vocab), 2)
        rows.append((i, " ".join(rnd.choice(vocab[own if rnd.random() > 0.2 else other]) for _ in range(rnd.randrange(2, 9))), own, "s"))
    docs = make(spark, rows)
    lab = spark.createDataFrame([(i, k) for i, _, k, _ in rows], "doc_id long, domain string")
    targets = {"de": 0.2, "en": 0.3, "fr": 0.5}
    domains, priors, lp = mixing.train(docs, lab)
    weights = {r["bucket"]: [r[f"lp{k}"] for k in range(3)] for r in lp.collect()}
    bucket = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for ws in vocab.values() for w in ws], "w string")
              .selectExpr("w", f"int(pmod(xxhash64(w), {mixing.BUCKETS})) AS b").collect()}
    out = {r["doc_id"]: r for r in mixing.mix(docs, lab, targets).collect()}
    totals, soft = np.zeros(3), 0
    for i, t, *_ in rows:
        ws = t.split()
        z = np.array(priors) + sum(np.array(weights[bucket[w]]) for w in ws) * min(1.0, mixing.EFFECTIVE_WORDS / len(ws))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(out[i]["posterior"], p, atol=1e-9)
        totals += out[i]["rate"] * len(ws) * p
        soft += bool(((p > 1e-4) & (p < 0.05)).any())
    assert soft > 20 and domains == sorted(targets)
    assert np.abs(totals / sum(len(t.split()) for _, t, *_ in rows) - [targets[k] for k in domains]).max() < 1e-5


def test_mixing_plan_is_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    domains, priors, lp = mixing.train(docs, mixing.language_domains(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    plan = mixing.posteriors(docs, domains, priors, lp)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


# ---- queries and pipeline ------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, want.project(", ".join(f'"{c}"' for c in cols)).fetchall()))


def test_every_operator_is_registered():
    assert {re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES} == {str(k) for k in range(1, 11)}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    assert [n.split()[0] for n, _ in P.STAGES] == ["quality", "line", "n-gram", "benchmark", "mixing"]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = docs
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r["doc_id"]: r for r in now.collect()}
        out = stage(spark, now, SF).cache()
        after = {r["doc_id"]: r for r in out.collect()}
        assert set(after) <= set(before)
        if k < 4:
            assert out.columns == docs.columns
        if name == "n-gram Jaccard join":
            want = {i for i, _, c in brute_components([(i, r["text"]) for i, r in before.items()]) if i == c}
            assert set(after) == want
        elif name == "benchmark decontamination":
            hits = {i: brute_hits(r["text"], bench) for i, r in before.items()}
            assert set(after) == {i for i, (n, h, _) in hits.items() if not (h and 20 * len(h) >= n)}
        elif name == "quality classifier":
            good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
            assert len(good & set(after)) >= 0.98 * len(good & set(before))
        elif k == 4:
            assert set(after) == set(before)
        now = out
    assert P.run(spark, SF).count() == now.count()


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").filter("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0

"""Packing, phrase mining and cross-tokenizer alignment against brute force and on hostile tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from larder.llm import alignment, packing, phrases
from larder.llm import tokens as K

SCHEMA = ("doc_id long, text string, lang string, part int, row_id long, pairs array<long>, n long, path string, word string, "
          "slot int, sequence_id long, `offset` long, rank int, score double")
EXTRA = (7, 8, [9], 10, "p\x00q", "w", 3, 4, 5, 6, 0.5)
ODD = ["", None, " ", "\n\t ", "  a  b \n c  ", "a  b　 c  d   e", "it's they'll  don't", "naïve café ß à  è ü",
       "<|endoftext|> x<|endoftext|>", "</s> <s> <unk> ok", "▁ under ▁▁mark", "日本 語 の テキスト", "🙂 🙃🙂 a🙂", "x" * 700,
       "=" * 200 + " " * 90 + "-" * 75, "a\x00b \x01c \x02", "1234567 89 0.5", "\r\n\r\n  \r x", "ﬁ Å ½"]


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, *EXTRA) for i, t, lang in rows], SCHEMA)


def odd_rows():
    rnd = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("ka", "The", "of", "zu", "é") for b in ("", "n", "tion", "ß")]
    prose = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))
    rows = [(i, t, ["en", None, "de"][i % 3]) for i, t in enumerate(ODD)]
    rows += [(100 + i, prose(rnd.choice([3, 40, 400])), rnd.choice(["en", "de", None])) for i in range(40)]
    rows += [(200, prose(6000), "en"), (100, "same id", "en"), (None, "no id at all", "en"), (None, "no id at all", "en"), (None, None, None)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return make(spark, odd_rows()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, []).cache()


@pytest.fixture(scope="module")
def byte_library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(K.BYTE_BPE)


def read(path, mode="r"):
    with open(path, mode) as f:
        return f.read()


# ---- tokens ---------------------------------------------------------------------------------

@pytest.mark.parametrize("plain", [False, True])
def test_byte_ids_are_those_of_the_library(byte_library, plain, monkeypatch):
    byte_library.encode_special_tokens = plain
    tok = K.ByteBpe(read(K.BYTE_BPE), plain)
    assert tok.ranked is not None
    texts = [t or "" for _, t, _ in odd_rows()]
    want = [byte_library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [tok.ids(t).tolist() for t in texts] == want
    assert all(b"".join(tok.bytes[i] for i in ids) == t.encode() for t, ids in zip(texts, want, strict=True))
    whole, limit = K.parts, 16
    monkeypatch.setattr(K, "parts", lambda t: whole(t, limit))
    assert [tok.ids(t).tolist() for t in texts] == want
    tok.ranked = None
    assert [tok.ids(t).tolist() for t in texts] == want


def test_piece_ids_in_parts_are_those_of_the_whole(monkeypatch):
    tok = K.PieceBpe(read(K.PIECE_BPE, "rb"))
    texts = [t for _, t, _ in odd_rows() if t]
    want = [tok.library.encode(t) for t in texts]
    whole = K.parts
    monkeypatch.setattr(K, "parts", lambda t: whole(t, 16))
    assert [tok.ids(t).tolist() for t in texts] == want


# ---- 11 packing -----------------------------------------------------------------------------

def test_differencing_is_a_near_equal_partition():
    rnd = random.Random(1)
    for k in (1, 2, 7):
        sizes = [rnd.randrange(1, 900) for _ in range(60)] + packing.halves(700)
        windows = packing.differencing(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in w) for w in windows]
        assert max(sums) - min(sums) <= 0.002 * sum(sizes)
    # the classic two-way case: 8, 7, 6, 5, 4 differences to 16 against 14
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.differencing([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_window_count_rises_only_when_capacity_is_exceeded():
    even = packing.divide([1000, 1048, 1500, 548], 2048)
    assert sorted(sum(p[2] for p in w) for w in even) == [2048, 2048]
    over = packing.divide([31] * 64, 992 + 1)  # 1984 tokens, two windows of 16 bundles
    assert sorted(sum(p[2] for p in w) for w in over) == [992, 992]
    third = packing.divide([31] * 66, 1023)  # 33 bundles: 17 in one of two windows would pass the capacity
    assert len(third) == 3 and max(sum(p[2] for p in w) for w in third) <= 1023
    assert packing.divide([], 8) == []


@pytest.mark.parametrize("window,pool", [(2048, 64), (64, 2), (16, 1)])
def test_packing_tiles_every_document(spark, odd, byte_library, window, pool):
    byte_library.encode_special_tokens = False
    packed = packing.pack(odd, window=window, pool_windows=pool)
    pieces = packed.collect()
    digests = packing.packed_digests(packed).collect()
    assert [(r.doc_id, r.start, len(r.input_ids), zlib.crc32(np.array(r.input_ids, "<u4").tobytes())) for r in pieces] == \
        [(r.doc_id, r.start, r.length, r.ids_crc32) for r in digests]
    windows = defaultdict(list)
    for r in pieces:
        windows[r.sequence_id].append(r)
        assert len(r.input_ids) > 0
    padding = 0
    for rows in windows.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0, *(len(r.input_ids) for r in rows)])[:-1].tolist()
        size = sum(len(r.input_ids) for r in rows)
        assert size <= window
        assert {r.padded_length for r in rows} == {size if size & (size - 1) == 0 else window}
        padding += rows[0].padded_length - size
    want = Counter()
    for doc, text, _ in odd_rows():
        ids = [*byte_library.encode(text or "", add_special_tokens=False).ids, 1]
        want.update((doc, k, t, len(ids)) for k, t in enumerate(ids))
    got = Counter((r.doc_id, r.start + k, t, r.doc_tokens) for r in pieces for k, t in enumerate(r.input_ids))
    assert got == want
    assert padding < window * 2 * 3 + 0.02 * want.total()  # the last pool of each of the three partitions, and slack


def test_packing_of_empty_tables_and_reruns(odd, empty):
    assert packing.pack(empty).count() == 0
    key = lambda df: sorted(map(tuple, packing.packed_digests(df).collect()), key=str)
    assert key(packing.pack(odd)) == key(packing.pack(odd))


# ---- 12 phrases -----------------------------------------------------------------------------

def brute_phrases(rows, least, top):
    f = defaultdict(Counter)
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 6):
                f[lang or "und"].update(tuple(ws[i:i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        cand = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        most = Counter()
        for k, v in cand.items():
            for m in range(2, len(k)):
                for i in range(len(k) - m + 1):
                    most[k[i:i + m]] = max(most[k[i:i + m]], v)
        best = []
        for k, a in cand.items():
            if most[k] >= a:
                continue
            score, _, left, right = min((1000 * a * n // (c[k[:j]] * c[k[j:]]), j, c[k[:j]], c[k[j:]]) for j in range(1, len(k)))
            best.append((-score, -a, " ".join(k).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -s))
    return sorted(out)


@pytest.mark.parametrize("least,top,shard", [(2, 2000, 1 << 20), (3, 15, 50), (1, 400, 7)])
def test_collocations_brute_force(spark, odd, monkeypatch, least, top, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)
    rows = odd_rows()
    got = sorted(map(tuple, phrases.collocations(odd, least, top).collect()))
    assert got == brute_phrases(rows, least, top) and got


def test_collocations_on_control_characters_ties_and_empty_tables(spark, empty):
    rows = [(i, "a\x00 b\x01 c\x02 \x01\x01 a b. a\x01 b", None) for i in range(4)] + [(9, "x y! X Y", "und"), (9, "x y! X Y", "und")]
    got = sorted(map(tuple, phrases.collocations(make(spark, rows), 2).collect()))
    assert got == brute_phrases(rows, 2, 2000)
    assert phrases.collocations(empty).count() == 0


def test_windows_end_at_rare_triples_of_frequent_pairs(spark, monkeypatch):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(20)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(400)) + " . a b c d e f a b c d e f", "en") for i in range(60)]
    written = {}
    write = phrases.S.write_table

    def spy(df, name):
        written[name] = write(df, name)
        return written[name]
    monkeypatch.setattr(phrases.S, "write_table", spy)
    got = sorted(map(tuple, phrases.collocations(make(spark, rows).coalesce(1), 30).collect()))
    assert got == brute_phrases(rows, 30, 2000) and any(len(r[2].split()) == 5 for r in got)
    # every pair occurs about 60 times and hardly a triple 30 times: nearly all of the 24,000 windows are one of 400 pairs
    assert written["shard-windows"].count() < 600


def written_windows(monkeypatch):
    written = {}
    write = phrases.S.write_table

    def spy(df, name):
        written[name] = write(df, name)
        return written[name]
    monkeypatch.setattr(phrases.S, "write_table", spy)
    return lambda: written["shard-windows"].count()


def test_shipped_windows_do_not_grow_with_the_splits(spark, monkeypatch):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(300)), "en") for i in range(192)]
    count = written_windows(monkeypatch)
    cores = spark.sparkContext.defaultParallelism
    docs = make(spark, rows).repartition(12 * cores)
    got = sorted(map(tuple, phrases.collocations(docs, 100).collect()))
    assert got == brute_phrases(rows, 100, 2000) and got
    # 144 pairs occur about 400 times, triples about 33 times: a task ships each pair once, not once a split
    assert count() <= 144 * cores


def test_a_shard_ships_distinct_windows_not_held_ones(monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 1000)
    shard, rnd = phrases.Shard(), np.random.default_rng(3)
    shard.word, shard.lang = {b"%02d" % i: i for i in range(20)}, {"en": 0}
    want = Counter()
    for _ in range(40):  # 12,000 windows, 400 distinct ones
        pairs = rnd.integers(1, 21, (300, 2)).astype(np.int32)
        want.update("%02d\x00%02d" % (a - 1, b - 1) for a, b in pairs.tolist())
        shard.add(np.zeros(300, np.int32), np.column_stack([pairs, np.zeros((300, 3), np.int32)]))
        assert not shard.full() and shard.n < 1300
    rows = [r for b in shard.close() for r in b.to_pylist()]
    assert [(r["path"], r["n"]) for r in rows] == sorted(want.items())


def test_windows_end_at_rare_quadruples_of_frequent_triples(spark, monkeypatch):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(7)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(400)) + " . a b c d e f a b c d e f", "en") for i in range(60)]
    count = written_windows(monkeypatch)
    got = sorted(map(tuple, phrases.collocations(make(spark, rows).coalesce(1), 45).collect()))
    assert got == brute_phrases(rows, 45, 2000) and any(len(r[2].split()) == 5 for r in got)
    # a triple occurs about 70 times, a quadruple about 10 times: the windows are the 49 pairs, 343 triples and few more
    assert count() < 700


def test_union_closes_states_at_range_ends():
    import pyarrow as pa
    paths = ["a\x00b", "a\x00b\x00c", "a\x00b\x00c", "a\x00d", "b\x00a\x00a\x00a\x00a", "b\x00a\x00c"]
    want = Counter()
    for p in paths:
        ws = p.split("\x00")
        want.update("\x00".join(ws[:d]) for d in range(2, len(ws) + 1))
    for size in (1, 2, 6):
        for cut in range(len(paths) + 1):  # two ranges
            got = Counter()
            for half in (paths[:cut], paths[cut:]):
                union = phrases.Union(2)
                rows = []
                for i in range(0, len(half), size):
                    part = half[i:i + size]
                    rows += union.feed(pa.RecordBatch.from_arrays([pa.array(["en"] * len(part)), pa.array(part), pa.array([1] * len(part))], ["lang", "path", "n"]))
                for _, p, n in rows + union.finish():
                    got[p] += n
            assert {p: n for p, n in got.items() if n >= 2} == {p: n for p, n in want.items() if n >= 2}


# ---- 13 alignment ---------------------------------------------------------------------------

def test_shared_cuts_are_the_common_ends():
    rnd = np.random.default_rng(5)
    for trial in range(60):
        first, a_all, b_all, want, at, n = [0], [], [], [], 0, 0
        for _ in range(rnd.integers(1, 6)):
            size = int(rnd.integers(1, 400))
            a = np.unique(np.append(rnd.integers(1, size + 1, rnd.integers(0, size + 1)), size))
            b = np.unique(np.append(rnd.integers(1, size + 1, rnd.integers(0, size // (1 + trial % 4) + 1)), size))
            want += [n + int(np.searchsorted(a, e)) for e in sorted(set(a.tolist()) & set(b.tolist()))]
            a_all.append(a + at)
            b_all.append(b + at)
            at, n = at + size, n + len(a)
            first += [n, n] if trial % 7 == 0 else [n]  # documents without tokens, too
        got = alignment.shared_cuts(np.concatenate(a_all), np.concatenate(b_all), np.array(first))
        assert got.tolist() == want


def test_a_document_without_shared_cut_is_one_leaf():
    a, b = np.append(np.arange(2, 4001, 2), 4001), np.append(np.arange(1, 4000, 2), 4001)
    assert alignment.shared_cuts(a, b, np.array([0, len(a)])).tolist() == [len(a) - 1]


def test_alignment_brute_force(spark, odd, byte_library, monkeypatch):
    byte_library.encode_special_tokens = True
    sp = K.PieceBpe(read(K.PIECE_BPE, "rb")).library
    alphabet = K.byte_level_alphabet()
    a_bytes = lambda i: bytes(alphabet[c] for c in byte_library.id_to_token(i))
    b_bytes = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for doc, text, _ in odd_rows():
        raw = (" " + (text or "")).encode()
        a, b = byte_library.encode(" " + (text or ""), add_special_tokens=False).ids, sp.encode(text or "")
        if not text or b"".join(map(a_bytes, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            a = b = []
        ea, eb = (np.cumsum([len(f(i)) for i in x]).tolist() for f, x in ((a_bytes, a), (b_bytes, b)))
        i = j = 0
        shown, links = [], Counter()
        for e in sorted(set(ea) & set(eb)):
            i2, j2 = ea.index(e, i) + 1, eb.index(e, j) + 1
            shown.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            links.update((x, y) for x in a[i:i2] for y in b[j:j2])
            i, j = i2, j2
        counts.update(links.keys())
        digest = hashlib.sha256(";".join(shown).encode()).hexdigest() if a else ""
        docs.append((doc, len(a), len(b), len(shown), links, digest))
    top = Counter()
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    want = Counter((doc, na, nb, g, sum(links.values()), sum(n for (x, y), n in links.items() if counts[x, y] == top[x]),
                    sum(n * counts[p] for p, n in links.items()), digest) for doc, na, nb, g, links, digest in docs)
    assert want[(None, 0, 0, 0, 0, 0, 0, "")] == 1  # the null text
    for share, chars in ((alignment.HOT_SHARE, alignment.GROUP_CHARS), (8, 64)):  # all pairs hot, and most not
        monkeypatch.setattr(alignment, "HOT_SHARE", share)
        monkeypatch.setattr(alignment, "GROUP_CHARS", chars)
        got = Counter(map(tuple, alignment.cross_tokenizer_alignment(odd).collect()))
        assert got == want


def test_alignment_of_an_empty_table(empty):
    out = alignment.cross_tokenizer_alignment(empty)
    assert out.count() == 0 and out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

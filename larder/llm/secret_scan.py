"""Secret scan: candidates filtered by a random forest trained on labelled findings.

Candidates are the whole values assigned to a secret-like name, of any length and
alphabet (quoted: up to the closing quote of the line; else up to white space),
the places that the caller labels (up to white space), and elsewhere runs of at
least 12 token characters that hold a digit. A run inside an assigned value is part
of it; a labelled place that starts another candidate takes that one's end. Their features are length and character make-up, the likelihood of
their character transitions and their coverage by dictionary words (both counted
over the whole corpus), the path of the document (its source) and the words
beside them. A random forest in numpy, trained on a bounded sample of labelled
findings, scores every candidate; those under the threshold are false positives.

Defined results: null and empty texts have no candidates; a null source, or none,
is an empty path; a null doc_id stays null and takes no labels; labels on white
space or outside their text, and null labels, are ignored; a finding labelled twice
takes its larger label; repeated rows give repeated findings; without labels every
candidate is kept with score 1; an empty value is no candidate; other columns are
not read. A letters-only value away from a secret-like name is a candidate only
where a label names it. Found values are reported as digests only.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import skew as S
from larder.llm import text as X

MIN_LENGTH = 12
DICTIONARY = 4096          # most frequent words of 4 to 12 letters
MAX_FINDINGS = 20000       # bound of the training sample
TREES, DEPTH, LEAF, SEED = 24, 8, 4, 3
NEIGHBOURS = 256           # hash buckets of neighbouring words
_VALUE = re.compile(rb"[A-Za-z0-9+/_.\-]{%d,}" % MIN_LENGTH)
_NAME = re.compile(rb"(?:token|secret|passw(?:or)?d|api[_-]?key|auth|credential)\W{0,3}\Z", re.I)
_NAME_BYTES = 16            # no name with its signs is longer
#: a value behind the sign: quoted on its line, else up to white space
_ASSIGNED = re.compile(rb"""[ \t]*(?:"([^"\n]+)"|'([^'\n]+)'|["']?([^\s"']\S*))""")
_SIGN = X.byte_class(words=b"=:")
_TAIL = b",;)]}>\"'"       # closing signs that end an unquoted value

#: character kinds of the transition model: letters without case, digits, other
_KIND = np.full(256, 36, np.int64)
_KIND[48:58] = np.arange(26, 36)
_KIND[65:91] = _KIND[97:123] = np.arange(26)
_KINDS = 37
_DIGIT = X.byte_class(words=bytes(range(48, 58)))
_LETTER = X.byte_class(words=bytes(range(65, 91)) + bytes(range(97, 123)))
_HEX = X.byte_class(words=b"0123456789abcdefABCDEF")
_UPPER = X.byte_class(words=bytes(range(65, 91)))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): 0 = character transition, 1 = word hash; one row per key and batch."""
    for b in batches:
        pairs, words = np.zeros(_KINDS * _KINDS, np.int64), []
        for part in X.slices(b.column(0)):
            k = _KIND[part.data]
            pairs += np.bincount(k[:-1] * _KINDS + k[1:], minlength=len(pairs))
            w = part.lower().words(X.ALNUM)
            size = w.ends - w.starts
            words.append(w.hashes[(size >= 4) & (size <= 12)])
        if words:
            h, n = np.unique(np.concatenate(words), return_counts=True)
            at = np.flatnonzero(pairs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(len(at)), np.ones(len(h))]).astype(np.int32)),
                 pa.array(np.concatenate([at, h.view(np.int64)])), pa.array(np.concatenate([pairs[at], n]))], names=["kind", "key", "n"])


class Statistics:
    """Log-probabilities of character transitions and the dictionary's word hashes."""

    def __init__(self, pairs: np.ndarray, words: np.ndarray) -> None:
        p = pairs.reshape(_KINDS, _KINDS) + 1.0
        self.logp = np.log(p / p.sum(1, keepdims=True))
        self.words = np.sort(words)

    def coverage(self, value: np.ndarray) -> float:
        """Share of the characters inside dictionary words of the value (lower-cased)."""
        n = len(value)
        if not len(self.words) or n < 4:
            return 0.0
        low = X._LOWER[value]
        starts = np.concatenate([np.arange(n - k + 1) for k in range(4, min(12, n) + 1)])
        ends = np.concatenate([np.arange(k, n + 1) for k in range(4, min(12, n) + 1)])
        h = X.span_hashes(X._BYTE[low], starts, ends)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = self.words[at] == h
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, starts[hit], 1)
        np.add.at(step, ends[hit], -1)
        return float((np.cumsum(step[:n]) > 0).mean())


def corpus_statistics(docs: DataFrame) -> Statistics:
    """Counted over all documents; the driver gets the transition table and DICTIONARY hashes."""
    counts = (docs.select(F.col("text").cast("string")).mapInArrow(_statistics, "kind int, key long, n long")
              .groupBy("kind", "key").agg(F.sum("n").alias("n")))
    top = counts.filter("kind = 1").orderBy(F.desc("n"), "key").limit(DICTIONARY)
    pairs, words = np.zeros(_KINDS * _KINDS), []
    for r in counts.filter("kind = 0").unionByName(top).collect():
        if r["kind"]:
            words.append(r["key"])
        else:
            pairs[r["key"]] = r["n"]
    return Statistics(pairs, np.array(words, np.int64).view(np.uint64))


def _word_bucket(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.lower().encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big") % NEIGHBOURS


def assigned_values(part: X.Slice) -> list[tuple[int, int, int]]:
    """(row, first byte, end byte) of the values behind secret-like names."""
    data, out, done = part.data.tobytes(), [], 0
    signs = np.flatnonzero(_SIGN[part.data])
    for row, at in zip((np.searchsorted(part.edges, signs, "right") - 1).tolist(), signs.tolist(), strict=True):
        lo, hi = int(part.edges[row]), int(part.edges[row + 1]) - 1
        # inside a value found before, or another sign follows
        if at < done or at + 1 < hi and _SIGN[part.data[at + 1]] or not _NAME.search(data, max(lo, at - _NAME_BYTES), at):
            continue
        m = _ASSIGNED.match(data, at + 1, hi)
        if m:
            a, done = m.span(m.lastindex)
            if m.lastindex == 3:
                done = a + (len(m[3].rstrip(_TAIL)) or len(m[3]))
            out.append((row, a, done))
    return out


def candidates(part: X.Slice, places: list[np.ndarray | None] | None = None) -> Iterator[tuple[int, int, int, bool]]:
    """(row, first byte, end byte, assigned) of the candidate values of a slice.

    ``places``: byte offsets in each row where the caller labelled a finding."""
    w = part.words()
    digits = np.concatenate([[0], np.cumsum(_DIGIT[part.data])])
    long_words = np.flatnonzero((w.ends - w.starts >= MIN_LENGTH) & (digits[w.ends] > digits[w.starts]))
    first = np.searchsorted(w.starts[long_words], part.edges)
    by_row: dict[int, list[tuple[int, int, bool]]] = {}
    for row, a, z in assigned_values(part):
        by_row.setdefault(row, []).append((a, z, True))
    for row in range(part.n):
        spans = by_row.get(row, [])
        starts, ends = [a for a, _, _ in spans], [z for _, z, _ in spans]
        for i in long_words[first[row]:first[row + 1]]:
            a, z = int(w.starts[i]), int(w.ends[i])
            for m in _VALUE.finditer(part.data[a:z].tobytes()):
                b, e = a + m.start(), a + m.end()
                k = bisect.bisect_right(starts, b) - 1
                if digits[e] > digits[b] and (k < 0 or ends[k] <= b):  # a run never crosses the border of an assigned value
                    spans.append((b, e, False))
        if places is not None and places[row] is not None:
            known = {a for a, _, _ in spans}
            for b in np.unique(places[row] + part.edges[row]).tolist():
                k = int(np.searchsorted(w.ends, b, "right"))  # the word that holds the byte
                if b not in known and k < len(w.ends) and w.starts[k] <= b:
                    spans.append((b, int(w.ends[k]), False))
        for a, z, flag in spans:
            yield row, a, z, flag


def features(part: X.Slice, row: int, a: int, z: int, path: str, stats: Statistics) -> list[float]:
    v = part.data[a:z]
    n = len(v)
    k = _KIND[v]
    digit, letter = _DIGIT[v], _LETTER[v]
    lo, hi = int(part.edges[row]), int(part.edges[row + 1]) - 1
    before = part.data[max(lo, a - 80):a].tobytes().decode("utf-8", "ignore")
    after = part.data[z:min(hi, z + 80)].tobytes().decode("utf-8", "ignore")
    left, right = before.split(), after.split()
    names = [x for x in left if re.search(r"\w", x)]
    return [float(n), float(digit.mean()), float(_UPPER[v].mean()), float(_HEX[v].mean()), len(np.unique(v)) / n,
            float(stats.logp[k[:-1], k[1:]].mean()) if n > 1 else 0.0, float((digit[1:] != digit[:-1]).mean()) if n > 1 else 0.0,
            float((~(digit | letter)).mean()),
            stats.coverage(v), float(before.rstrip(" \"'")[-1:] in ("=", ":")), float(before[-1:] in ("\"", "'")),
            float(_word_bucket(names[-1]) if names else -1), float(_word_bucket(right[0]) if right else -1),
            float(_word_bucket(path)), float(path.count("/") + path.count(".")), float(len(path))]


class Forest:
    """Random forest: bootstrap samples, random feature subsets, Gini splits."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = SEED) -> None:
        self.trees_wanted, self.depth, self.leaf, self.seed = trees, depth, leaf, seed
        self.trees: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Forest":
        rng = np.random.default_rng(self.seed)
        for _ in range(self.trees_wanted):
            pick = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []  # feature (-1: leaf), threshold, left, right, value
            self._grow(x[pick], y[pick], 0, nodes, rng)
            self.trees.append(np.array(nodes))
        return self

    def _grow(self, x, y, depth, nodes, rng) -> int:
        me = len(nodes)
        nodes.append([-1, 0, 0, 0, float(y.mean())])
        if depth >= self.depth or len(y) < 2 * self.leaf or y.min() == y.max():
            return me
        best = (y.mean() * (1 - y.mean()) - 1e-9, None, None)
        for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1])) + 1), replace=False):
            cuts = np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 24)))
            left = x[:, f][:, None] <= cuts
            nl = left.sum(0)
            ok = (nl >= self.leaf) & (len(y) - nl >= self.leaf)
            if not ok.any():
                continue
            pl = (left * y[:, None]).sum(0) / np.maximum(nl, 1)
            pr = (y.sum() - pl * nl) / np.maximum(len(y) - nl, 1)
            impurity = np.where(ok, (nl * pl * (1 - pl) + (len(y) - nl) * pr * (1 - pr)) / len(y), np.inf)
            i = int(impurity.argmin())
            if impurity[i] < best[0]:
                best = (impurity[i], f, cuts[i])
        if best[1] is None:
            return me
        go = x[:, best[1]] <= best[2]
        l = self._grow(x[go], y[go], depth + 1, nodes, rng)
        r = self._grow(x[~go], y[~go], depth + 1, nodes, rng)
        nodes[me][:4] = [float(best[1]), float(best[2]), l, r]
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth + 1):
                f = t[at, 0].astype(np.int64)
                inner = f >= 0
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1]
                at = np.where(inner, np.where(go, t[at, 2], t[at, 3]).astype(np.int64), at)
            out += t[at, 4]
        return out / max(len(self.trees), 1)


#: columns of :func:`features` that tell of the text around a value
CONTEXT = (9, 10, 11, 12)
COVERAGE = 8

_ROWS = "doc_id long, char_start long, length int, value_sha256 string, assigned boolean, score double, features array<double>"


def _byte_places(part: X.Slice, lead: np.ndarray, labelled: list[list[int] | None]) -> list[np.ndarray | None]:
    """Byte offsets of the labelled code points of each row (those inside the text)."""
    out: list[np.ndarray | None] = []
    for row in range(part.n):
        at = labelled[part.first + row]
        if not at:
            out.append(None)
            continue
        a, z = int(part.edges[row]), int(part.edges[row + 1]) - 1
        points = lead[a] + np.array([x for x in at if x is not None and 0 <= x < int(lead[z] - lead[a])], np.int64)
        out.append(np.searchsorted(lead, points, "right") - 1 - a)
    return out


def _scan(shared, with_features: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, forest = shared.value
        for b in batches:
            paths = b.column(1).to_pylist()
            doc_ids = b.column(0).to_pylist()
            labelled = b.column(3).to_pylist() if b.num_columns > 3 else [None] * b.num_rows
            cols: list[list] = [[] for _ in range(5)]
            x: list[list[float]] = []
            for part in X.slices(b.column(2)):
                lead = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
                for row, a, z, assigned in candidates(part, _byte_places(part, lead, labelled)):
                    value = part.data[a:z].tobytes()
                    i = part.first + row
                    for c, v in zip(cols, (doc_ids[i], int(lead[a] - lead[part.edges[row]]), z - a, hashlib.sha256(value).hexdigest(),
                                           assigned), strict=True):
                        c.append(v)
                    x.append(features(part, row, a, z, paths[i] or "", stats))
            if x:
                score = forest.predict(np.array(x)) if forest else np.ones(len(x))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                    + [pa.array(score), pa.array(x if with_features else [None] * len(x), pa.list_(pa.float64()))],
                    names=["doc_id", "char_start", "length", "value_sha256", "assigned", "score", "features"])
    return run


def scan(docs: DataFrame, stats: Statistics, forest: Forest | None, with_features: bool = False,
         labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate with its place (code points), digest, score and context flag. The places
    (doc_id, char_start) of ``labelled`` are candidates, too; they meet the documents by doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast((stats, forest))
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), F.col("text").cast("string").alias("text"))
    if labelled is not None:
        places = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("char_start").cast("long").alias("at")).dropna()
        # a document's labelled places: at most its characters
        rows = rows.join(places.groupBy("doc_id").agg(F.collect_set("at").alias("places")), "doc_id", "left")
    return rows.mapInArrow(_scan(shared, with_features), _ROWS)


def rule_labels(docs: DataFrame, stats: Statistics) -> DataFrame:
    """Labelled findings by rule, for a corpus that brings none: a value assigned to a
    name for secrets is one unless dictionary words make up all of it; any other candidate is not."""
    rows = scan(docs, stats, None, True)
    return rows.select("doc_id", "char_start", (F.col("assigned") & (F.element_at("features", COVERAGE + 1) < 1.0)).cast("int").alias("label"))


def train(docs: DataFrame, labelled: DataFrame, stats: Statistics, max_findings: int = MAX_FINDINGS, context: bool = True) -> Forest | None:
    """Forest from at most about ``max_findings`` labelled findings (doc_id, char_start, label).

    Without ``context`` no split looks at the text around a value: labels that come from
    that text would only be repeated."""
    lab = S.write_table(labelled.select("doc_id", "char_start", F.col("label").cast("int").alias("label")).dropna()
                        .groupBy("doc_id", "char_start").agg(F.max("label").alias("label")), "findings")  # read three times
    n = lab.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("doc_id", "char_start"), F.lit(1 << 20)) / float(1 << 20)
    sample = F.broadcast(lab.filter(draw < max_findings / n))  # bounded by max_findings
    ids = F.broadcast(sample.select("doc_id").distinct())
    rows = (scan(docs.join(ids, "doc_id", "left_semi"), stats, None, True, sample).join(sample, ["doc_id", "char_start"])
            .select("doc_id", "char_start", "label", "features").distinct().collect())
    rows.sort(key=lambda r: (r["doc_id"], r["char_start"]))
    y = np.array([r["label"] for r in rows], float)
    if not len(y):
        return None
    x = np.array([r["features"] for r in rows])
    if not context:
        x[:, CONTEXT] = 0.0  # a column without a difference is never split
    return Forest().fit(x, y)


def secret_scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, char_start, length, value_sha256, score and ``is_secret`` of every candidate.

    With no labelled findings they come by rule from the text around a value, and the
    forest judges by the value and its path alone."""
    stats = corpus_statistics(docs)
    forest = train(docs, rule_labels(docs, stats) if labelled is None else labelled, stats, context=labelled is not None)
    return scan(docs, stats, forest, labelled=labelled).select("doc_id", "char_start", "length", "value_sha256", "score",
                                                             (F.col("score") >= threshold).alias("is_secret"))

import collections
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.llm import hard_negatives, line_dedup, whitening

NAN, INF = float("nan"), float("inf")


def _embeddings(spark, tmp_path, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, row long, x string")
    df.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    return df


def _odd_vectors(seed, n, width):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = [float(np.float32(c)) for c in rng.standard_normal(width) * 0.3]
        out.append((i * 10, v, int(rng.integers(0, 4)), 1, "x"))
    out += [(i * 10, list(v), lab, 2, "y") for i, (_, v, lab, _, _) in enumerate(out[:20])]  # repeated ids, other rows
    out += [out[3], out[3], out[10], (None, out[5][1], 1, 1, "x"), (None, out[6][1], 2, 1, "x")]
    out += [(100, None, 1, 1, "x"), (200, [0.1, None] + [0.0] * (width - 2), 1, 1, "x"), (300, [NAN] * width, 1, 1, "x"), (400, [INF] + [0.1] * (width - 1), 1, 1, "x"), (500, [0.5] * width, None, 1, "x")]
    out += [(600, [0.5, 0.25], 1, 1, "x"), (700, [], 2, 1, "x"), (-100, [0.5] * width, 1, None, None)]
    return out


def _usable(rows):
    return [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


def _hard_negatives(rows, positives=5, negatives=5):
    """Every anchor against every row, sorted in Python."""
    used = []
    for id_, v, label, *_ in _usable(rows):
        if label is not None:
            used.append((id_, (label + 1) % 10 if id_ is not None and id_ % 7 == 0 else label, [math.floor(256 * c) for c in v]))
    out = collections.Counter()
    for i, (a, label, x) in enumerate(used):
        if a is None or a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), b is None, b or 0, lab) for j, (b, lab, y) in enumerate(used) if j != i]
        scored.sort()
        named = [(None if none else b, -s, lab) for s, none, b, lab in scored]
        for b, top, _ in [r for r in named if r[2] == label][:positives]:
            below = [r for r in named if r[2] != label and 80 * top <= 100 * r[1] <= 100 * top][:negatives]
            out.update((a, b, k + 1, c, top, s) for k, (c, s, _) in enumerate(below))
    return out


@pytest.mark.parametrize("small_blocks", [False, True])
def test_hard_negatives_against_brute_force(spark, tmp_path, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(hard_negatives, "BLOCK_VALUES", 300)
        monkeypatch.setattr(hard_negatives, "ANCHOR_VALUES", 40)
        monkeypatch.setattr(hard_negatives, "SORTED_AT_ONCE", 50)
    rows = _odd_vectors(3, 300, 8)
    _embeddings(spark, tmp_path, rows)
    found = hard_negatives.op11_hard_negatives(spark, str(tmp_path))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = _hard_negatives(rows)
    assert collections.Counter(tuple(r) for r in found.collect()) == want and sum(want.values()) > 100


def test_hard_negatives_of_equal_rows_and_none(spark):
    # One vector in all rows: every score ties, ids decide.
    rows = [(i, [0.5, 0.25], i % 3, 1, "x") for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, row long, x string")
    anchor = F.col("vec_id") % 100 == 0
    got = hard_negatives.hard_negatives(df, anchor).where("anchor_id = 300").collect()
    assert {(r.positive_id, r.rank, r.negative_id) for r in got} == {(p, k + 1, n) for p in (0, 3, 6, 9, 12) for k, n in enumerate((1, 2, 4, 5, 7))}
    assert hard_negatives.hard_negatives(df.limit(0), anchor).count() == 0
    assert hard_negatives.hard_negatives(df.where("label = 0"), anchor).count() == 0


def test_scores_stay_exact():
    a, b = np.array([[2**30, 3]]), np.array([[2**31, 1], [-(2**31), 7]])
    assert hard_negatives.scores(a, b).tolist() == [[2**61 + 3, 21 - 2**61]]


def _covariance(rows):
    x = np.array(sorted({tuple(math.floor(64 * c) + 1_000_000 for c in v) for _, v, *_ in rows}), dtype=object)
    n, sums = len(x), x.sum(axis=0)
    c = ((x * n - sums) / n).astype(float)
    return n, sums, c.T @ c / n


@pytest.mark.parametrize("low,grown", [(1.0, True), (0.001, False)])
def test_whitening_against_the_whole_decomposition(spark, tmp_path, low, grown):
    rng = np.random.default_rng(5)
    width, n = 40, 700
    # Variances fall slowly, or far after the twentieth: wide enough for whole numbers not to flatten them.
    spread = 500.0 * 0.95 ** np.arange(width) * np.where(np.arange(width) < 20, 1.0, low)
    turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
    rows = [(i, [float(c) for c in (rng.standard_normal(width) * spread) @ turn], 0, 1, "x") for i in range(n)]
    rows += [rows[0]] * 50 + [(None, rows[1][1], None, None, None), (9, None, 1, 1, "x"), (10, [NAN] * width, 1, 1, "x"), (11, [None] * width, 1, 1, "x")]
    _embeddings(spark, tmp_path, rows, "double")
    used = _usable(rows)
    count, sums, v = _covariance(used)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    x = whitening.whole_vectors(spark.read.parquet(str(tmp_path / "embeddings.parquet")), "embedding", "x")
    assert whitening.fit(x).grown == grown
    got = whitening.op12_whitening(spark, str(tmp_path)).collect()
    assert len(got) == 16 * len(used) and {r.n for r in got} == {count}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-4
    by = collections.defaultdict(dict)
    for r in got:
        by[r.vec_id][r.component] = r
        assert abs(r.explained / (values[r.component - 1] / np.trace(v)) - 1) < 1e-6
    signs = None
    for id_, vector, *_ in used:
        x = np.array([math.floor(64 * c) + 1_000_000 for c in vector], dtype=object)
        d = count * x - sums
        want = (d / count).astype(float) @ vectors / np.sqrt(values)
        have = np.array([by[id_][k + 1].whitened for k in range(16)])
        signs = np.sign(want * have) if signs is None else signs
        assert np.allclose(have, want * signs, atol=1e-6) and by[id_][1].deviation == int((d * d).sum())


def test_whitening_of_few_and_odd_vectors(spark, tmp_path):
    schema = "vec_id long, embedding array<float>, whitened string, __x int"
    for rows, components in ([], 0), ([(1, [0.5, 1.0], "a", 3)] * 4, 0), ([(1, [], "a", 3)], 0), ([(1, [0.5], "a", 3), (2, [0.5, 2.0], "b", 4), (2, [1.5], "b", 4)], 2):
        df = whitening.whole_vectors(spark.createDataFrame(rows, schema), "embedding", "x")
        model = whitening.fit(df)
        assert len(model.values) == components
        got = whitening.whiten(df, model).collect()
        assert len(got) == len(rows) and all(len(r.whitened) == components and r["__x"] in (3, 4) for r in got)
    big = np.array([[2**40, 5]])
    assert whitening._deviation(big, 2**30, np.array([0, 0])) == [(2**70) ** 2 + (5 * 2**30) ** 2]


def _deduplicated(rows):
    """(doc_id, n_lines, n_dropped, digest) of every row, by dictionaries of plain keys."""
    space = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[line.strip(space).translate(lower)].add(i)
    out = collections.Counter()
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            key = line.strip(space).translate(lower)
            ids = holders[key]
            keeper = min((x for x in ids if x is not None), default=None)
            if len(key) < 10 or len(ids) < 2 or keeper == i:
                kept.append(line)
        out[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def test_line_dedup_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(9)
    pool = [f"line number {i} of the pool" for i in range(40)] + ["short", "ninechars", "ten chars!", "äöüäöüäöü", "äöüäöüäöüx", "", " ", " non-breaking edges ", "日本語の行はここにあります"]
    rows = []
    for i in range(120):
        lines = [pool[j] for j in rng.integers(0, len(pool), rng.integers(0, 12))]
        lines = [("  " + x.upper() + "\t\r" if rng.random() < 0.3 else x) for x in lines] + [f"own line of document {i}"] * int(rng.integers(0, 3))
        rows.append((int(rng.integers(0, 90)), "\n".join(lines)))
    rows += [(5, None), (6, ""), (None, pool[0] + "\n" + pool[1]), (None, "only rows without an id hold this\nalone here, nowhere else"), (None, "only rows without an id hold this"), (None, None)]
    rows += [(7, "ÉCOLE des lignes\nécole des lignes"), (8, "École des lignes\x0b"), (9, "\n\n\n"), (200, "\n".join(f"long text line {j % 5000}" for j in range(30_000))), (201, "long text line 17\nx")]
    rows += [rows[0]] * 3 + [(-3, pool[2] + "\n\n" + pool[2])]
    df = spark.createDataFrame([(i, t, 5, "mine", 7) for i, t in rows], "doc_id long, text string, n_lines int, line string, __id int")
    df.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    want = _deduplicated(rows)
    found = line_dedup.op13_line_dedup(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert collections.Counter(tuple(r) for r in found.collect()) == want and sum(k[2] for k in want) > 100
    whole = line_dedup.drop_repeated(df)
    assert whole.columns == ["doc_id", "text", "line", "__id", "n_lines", "n_dropped"]
    got = collections.Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in whole.collect())
    assert got == want and {(r.line, r["__id"]) for r in whole.collect()} == {("mine", 7)}
    assert whole.where("text IS NULL").count() == 2
    assert line_dedup.drop_repeated(df.limit(0)).count() == 0


def test_line_dedup_by_other_thresholds(spark):
    df = spark.createDataFrame([(i, "a line of five\nin two of them" if i < 2 else "a line of five\nabc") for i in range(5)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated(df, least=3, documents=4).collect()}
    assert got == {0: "a line of five\nin two of them", 1: "in two of them", 2: "abc", 3: "abc", 4: "abc"}

"""Hard negatives, periodic runs and mixing, against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerine.llm import mixing, negatives, queries, runs

VECTORS = "vec_id long, embedding array<double>, label int"
DOCS = "doc_id long, text string, source string"


# Hard negatives ---------------------------------------------------------------------------------------------------------


def negatives_brute(rows, positives=5, k=5, low=80):
    """Rows whose id is a multiple of 100 are anchors."""
    whole = [(i, [max(-(2**62), min(2**62, math.floor(256 * x))) for x in v], label) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, label in whole:
        if a is None or a % 100:
            continue
        others = [(-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w, strict=True)))), (i is not None, i), m) for i, w, m in whole if i != a and len(w) == len(v)]
        others.sort(key=lambda r: r[:2])
        for score, p, _ in [r for r in others if r[2] == label][:positives]:
            fits = [r for r in others if r[2] != label and -low * score <= -100 * r[0] <= -100 * score]
            out += [(a, p[1], rank, n[1], -score, -s) for rank, (s, n, _) in enumerate(fits[:k], 1)]
    return sorted(out, key=str)


def mined(spark, rows, **more):
    table = spark.createDataFrame(rows, VECTORS).withColumns({"score": F.lit("x"), "slot": F.lit(1), "rank": F.lit(2)})
    found = negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, **more)
    assert dict(found.dtypes)["rank"] == "int"
    return sorted((tuple(r) for r in found.collect()), key=str)


def vectors(n, labels, seed, step=1):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in np.abs(rng.normal(size=8)) / 2], int(rng.integers(0, labels))) for i in range(0, n * step, step)]


@pytest.mark.parametrize("block", [16_384, 2])
def test_hard_negatives(spark, block):
    rows = vectors(450, 3, 1, 4)  # 18 anchors
    rows += [(3, rows[0][1], 0), (5, rows[0][1], 1), (7, rows[0][1], 2)]  # ties
    got = mined(spark, rows, block=block)
    assert got == negatives_brute(rows) and len(got) > 200


def test_hard_negatives_of_a_hot_label_and_small_blocks(spark, monkeypatch):
    rows = [(i, v, 0 if i % 3 else label) for i, v, label in vectors(600, 4, 2)]
    monkeypatch.setattr(negatives, "ROWS", 16)
    assert mined(spark, rows) == negatives_brute(rows)


def test_hard_negatives_of_odd_rows(spark):
    v = [0.5, 0.25]
    rows = [(0, v, 1), (0, v, 1), (0, [0.5, 0.5], 2), (1, v, 1), (1, v, 1), (2, v, 2), (2, v, 2), (3, v, 1)]  # repeated ids
    rows += [(4, None, 1), (5, [None, 1.0], 1), (6, [math.nan, 1.0], 2), (7, [math.inf, 0.0], 2), (8, v, None), (9, [], 1), (10, [], 2), (11, [0.5] * 3, 1), (12, [0.5] * 3, 2), (None, v, 1), (None, v, 2)]
    rows += [(100, [0.0, 0.0], 1), (200, [-0.5, -0.5], 1), (300, [], 2), (400, [1e300, 1.0], 1), (13, [1e300, -1.0], 1), (14, [1e300, 2.0], 2), (15, [3e15, 5.0], 1), (16, [3e15, 1.0], 2), (500, [1e6, 2e6], 3), (17, [1e6, 3e6], 3), (18, [1e6, 2.9e6], 2)]
    assert mined(spark, rows) == negatives_brute(rows)
    assert mined(spark, []) == [] and mined(spark, rows[3:8]) == []


def test_scores_are_exact():
    rng = np.random.default_rng(3)
    for most in (10.0, 2.0**25, 2.0**29, 2.0**45, 2.0**62):
        a, b = (np.floor(rng.uniform(-most, most, (5, 4))) for _ in range(2))
        want = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(r, s, strict=True)))) for r in a] for s in b]
        assert negatives.products(a, b).tolist() == want
    assert negatives.lower_limit(np.array([101, -101, 0, 2**63 - 1]), 80).tolist() == [81, -80, 0, -(-(2**63 - 1) * 80 // 100)]


# Periodic runs ----------------------------------------------------------------------------------------------------------


def runs_brute(words, least=12):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed_brute(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def odd_texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        size, kinds = rng.choice([1, 11, 12, 13, 30, 80, 150]), rng.choice([1, 2, 3, 26])
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz"[:kinds]) for _ in range(size)]
        if rng.random() < 0.5:
            a, p = rng.randrange(size), rng.randint(1, max(1, size // 3))
            words = [words[i] if i < a else words[a + (i - a) % p if a + (i - a) % p < size else i] for i in range(size)]
        out.append(rng.choice([" ", "\n", " \t "]).join(words))
    return out


ODD = [None, "", " \x0b\x0c\t", " a", "é\xa0é " * 20, "漢 😀 " * 9 + "漢", "x" * 5000, "a b " * 400, "b a c " * 5 + "\n" + "b " * 15]


def test_runs(spark):
    texts = [*ODD, *odd_texts(1, 150)]
    rows = [(i // 2, t, None if i % 3 else "s") for i, t in enumerate(texts)]  # repeated ids
    docs = spark.createDataFrame(rows, DOCS).withColumns({"runs": F.lit(1), "n_words": F.lit("y"), "at": F.struct(F.lit(1).alias("text"))})
    found = runs.collapse_runs(docs)
    assert found.columns == ["doc_id", "text", "source", "at", "n_words", "runs"]
    got = sorted(((r["doc_id"], r["text"], r["source"], r["n_words"], [tuple(x) for x in r["runs"]]) for r in found.collect()), key=str)
    want = []
    for i, t, s in rows:
        own = runs_brute(words_of(t))
        want.append((i, None if t is None else collapsed_brute(words_of(t), own), s, len(words_of(t)), own))
    assert got == sorted(want, key=str) and sum(len(w[4]) for w in want) > 60
    assert runs.collapse_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_many_documents_at_once(least, monkeypatch):
    monkeypatch.setattr(runs, "PAIRS", 50)
    for seed in range(12):
        docs = [words_of(t) for t in odd_texts(seed, 9)]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        ids = np.array([ord(w) for d in docs for w in d])
        doc, start, end, q = (x.tolist() for x in runs.runs_of(ids, offsets, least))
        got = [[(s - int(offsets[k]), e - s, p) for d, s, e, p in zip(doc, start, end, q, strict=True) if d == k] for k in range(len(docs))]
        assert got == [runs_brute(d, least) for d in docs]


def test_runs_of_a_very_long_text(spark):
    words = [str(i % 997) for i in range(200_000)] + ["x"] * 100_000
    got = runs.collapse_runs(spark.createDataFrame([(1, " ".join(words), "s")], DOCS)).first()
    assert [tuple(r) for r in got["runs"]] == [(0, 200_000, 997), (200_000, 100_000, 1)]
    assert got["text"] == " ".join([*words[:997], "x"]) and got["n_words"] == 300_000


def test_query_of_runs(spark, tmp_path):
    texts = [*ODD, *odd_texts(2, 300)]
    spark.createDataFrame([(i - 40, t, "s") for i, t in enumerate(texts)] + [(None, "a " * 12, "s")], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in [(i - 40, t) for i, t in enumerate(texts)] + [(None, "a " * 12)]:
        words = words_of(t)
        h = -1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        own = runs_brute(words)
        best = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else (None,) * 3
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, len(own), *best, 1000 * best[1] // best[2] if own else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in own)), digest(collapsed_brute(words, own))))
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


# Mixing -----------------------------------------------------------------------------------------------------------------


def targets_brute(sizes, weights=(1, 2, 3), most=3):
    """Shares again and again, as the contract words it."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    stopped, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        own = {s: rest * w[s] / sum(w[x] for x in free) for s in free} | {s: most * sizes[s] for s in stopped}
        more = {s for s in free if own[s] > most * sizes[s]}
        if not more:
            return own
        stopped |= more


def mix_rows(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("x"), "copy": F.lit(1), "_w": F.lit(2), "_n": F.lit(3)})
    return docs, mixing.rates(docs)


@pytest.mark.parametrize("few", [True, False])
def test_mixing(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(mixing, "SMALL", 2)
    rng = random.Random(4)
    names = [None, "", "a", "B", "é", "漢", "z", "\U0001f600", "￮", "hot", "none"]
    rows = [(i, None if s == "none" else " ".join(["w"] * rng.choice([0, 1, 30, 200])), s) for i in range(3000) for s in [rng.choices(names, [1, 2, 40, 3, 5, 1, 9, 2, 2, 100, 1])[0]]]
    docs, rated = mix_rows(spark, rows)
    got = rated.collect()
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    want = targets_brute(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-9)
        assert r["size"] == len(words_of(r["text"])) and math.floor(r["rate"]) <= r["copies"] <= min(3, math.ceil(r["rate"]))
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        f = own[0]["rate"] % 1
        spread = math.sqrt(f * (1 - f) * sum(r["size"] ** 2 for r in own))
        assert abs(sum(r["size"] * r["copies"] for r in own) - want[s]) <= 4.5 * spread + 1e-6
    assert math.isclose(sum(want.values()), sum(sizes.values()))
    again = mixing.rates(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in got)
    emitted = mixing.mixed(rated)
    count = {r["doc_id"]: r["n"] for r in emitted.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert {r["doc_id"]: r["copies"] for r in got if r["copies"]} == count and "copies" not in emitted.columns


def test_mixing_of_odd_tables(spark):
    assert mix_rows(spark, [])[1].count() == 0
    empty = mix_rows(spark, [(1, None, "a"), (2, " ", None)])[1].collect()
    assert [(r["target"], r["rate"], r["copies"], r["size"]) for r in empty] == [(0.0, 0.0, 0, 0)] * 2
    same = mix_rows(spark, [(None, "a b", "s"), (None, "a b", "s"), (1, " a\x0b\x0cb\n", "t"), (1, None, "t")])[1].collect()
    assert len({r["copies"] for r in same if r["source"] == "s"}) == 1 and [r["size"] for r in same if r["doc_id"] == 1] == [2, 0]


def test_targets_of_many_sources_that_stop_one_after_the_other(spark):
    sizes = {f"{i:03d}": 3**i for i in range(30)}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    found = mixing.targets(mixing.numbered(rows, "source"), F.element_at(F.array(F.lit(1), F.lit(2), F.lit(3)), (F.col("ord") % 3 + 1).cast("int"))).collect()
    want = targets_brute(sizes)
    assert sorted(r["ord"] for r in found) == list(range(30)) and all(math.isclose(r["target"], want[r["source"]]) for r in found)


def test_repeats_are_settled_by_parts_of_a_batch(monkeypatch):
    import pyarrow as pa

    from ledgerine.llm import suffix

    met = []
    monkeypatch.setattr(suffix, "windows_of", lambda batch: iter(met.append(batch.num_rows) or ()))
    n = 10_000
    own = {k: pa.array([1] * n, pa.int64()) for k in ("n", "key", "place", "low", "high")} | {"string": pa.array([i // 3 for i in range(n)], pa.int64()), "body": pa.array([b"x"] * n)}
    assert not list(suffix._settle(200)(iter([pa.RecordBatch.from_pydict(own)])))
    assert sum(met) == n and max(met) <= 2 * suffix.AT_ONCE

import corpus_pipeline
from ledgerine.llm import suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    from test_ops import prose

    own = [prose(120, 100 + i) for i in range(12)]
    passage = prose(70, 200)
    line = "this very line of more than forty characters is found everywhere"
    texts = [f"{t}\n{line}" for t in own[:6]] + [own[6], own[6] + " tail", own[7] + " " + passage + " " + own[8], own[9] + " " + passage + " " + own[10], None, "12345"]
    d = spark.createDataFrame([(i, t, "en" if i != 3 else None, "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        d.write.parquet(f"{tmp_path}/{name}")
        d = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), str(tmp_path))
        rows = d.collect()
        if name == "language ID":
            assert {r["doc_id"] for r in rows} == set(range(10)) and all(r["lang"] == "en" for r in rows)
        if name == "line dedup":
            assert [r["doc_id"] for r in rows if line in r["text"]] == [5]
        if name == "MinHash near-dedup":
            assert {r["doc_id"] for r in rows} == set(range(10)) - {7}
        if name == "suffix-array dedup":
            assert not any(passage in r["text"] for r in rows) and {r["doc_id"]: r["text"] for r in rows}[0] == own[0]
        if name != "packing":
            assert d.columns == corpus_pipeline.COLUMNS
    assert sum(r["length"] for r in rows if r["doc_id"] == 0) == rows[[r["doc_id"] for r in rows].index(0)]["doc_tokens"]
    assert suffix.GRAM == 48


def test_run_against_brute_force(spark, tmp_path):
    """All stages in a row, each done again in plain Python on what the one before left."""
    import itertools
    import zlib

    import numpy as np
    from ledgerine.llm.queries import tokenizer_path
    from test_ops import lines_brute, prose
    from tokenizers import Tokenizer

    own = [prose(90, 300 + i) for i in range(30)]
    line, passage = "a line of more than forty characters that six documents hold", prose(60, 400)
    texts = [f"{t}\n{line}" for t in own[:6]] + [own[6], own[6] + " more", own[6].replace(" ", "  "), own[7] + " the end of it", own[7]] + [f"{a} {passage} {b}" for a, b in itertools.pairwise(own[8:14])] + own[14:] + ["12 34", None, own[20]]
    rows = [(3 * i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    left = [(i, t) for i, t, *_ in rows if t and any(map(str.isalpha, t))]
    left = lines_brute(left)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.lower().split() for _, t in left)]
    first = list(range(len(left)))
    for i, j in itertools.combinations(range(len(left)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            first[j] = min(first[j], first[i])
    left = [left[i] for i in range(len(left)) if first[i] == i]
    assert len(left) == len(rows) - 2 - 4
    data, count = [t.encode() for _, t in left], {}
    for d in data:
        for i in range(len(d) - 199):
            count[d[i : i + 200]] = count.get(d[i : i + 200], 0) + 1
    want, tok = [], Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for (doc, _), d in zip(left, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if count[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        ids = np.array([*tok.encode(bytes(b for b, g in zip(d, gone, strict=True) if not g).decode(), add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for bit in range(12, -1, -1):
            while len(ids) - at >= 1 << bit:
                want.append((doc, at, 1 << bit, zlib.crc32(ids[at : at + (1 << bit)].tobytes())))
                at += 1 << bit
    assert found == sorted(want) and sum(n > 1 for n in count.values()) > 100


def test_text_of_no_learned_language_goes(spark):
    from test_ops import prose

    own = [(i, prose(120, 700 + i), "en", "s", 0) for i in range(8)] + [(8, prose(30, 708), None, "s", 0)]
    other = ["Съешь же ещё этих мягких французских булок да выпей чаю", "これは日本語の文章です", "aGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQ=", "QUICK ZYX JUMPS OVER WV"]
    d = spark.createDataFrame(own + [(20 + i, t, None, "s", 0) for i, t in enumerate(other)], SCHEMA)
    assert {r["doc_id"]: r["lang"] for r in corpus_pipeline.keep_languages(spark, d, "").collect()} == {i: "en" for i in range(9)}


def test_without_labels_documents_with_letters_stay(spark):
    d = spark.createDataFrame([(1, "some text", None, "s", 9), (2, "漢字", None, "s", 2), (3, "123 !", None, "s", 5), (4, None, None, "s", 0), (5, None, "en", "s", 0)], SCHEMA)
    assert {(r["doc_id"], r["lang"]) for r in corpus_pipeline.keep_languages(spark, d, "").collect()} == {(1, None), (2, None)}


def test_run_on_repeated_rows_and_an_empty_table(spark, tmp_path):
    from test_ops import prose

    rows = [(1, prose(150, 800), "en", "s", 0)] * 3 + [(2, prose(150, 801), "en", "s", 0), (None, prose(150, 802), "en", "s", 0), (None, prose(150, 803), None, "s", 0), (3, None, "en", "s", 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    for name, own in (("all", d), ("none", d.limit(0))):
        own.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        found = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        whole = {(r["doc_id"], r["doc_tokens"]) for r in found if r["start"] == 0}
        assert len(whole) == (4 if name == "all" else 0)
        assert all(n > 150 for _, n in whole) and len([r for r in found if r["start"] == 0]) == len(whole)


def test_batches_are_small_when_the_caller_runs_a_stage(spark, tmp_path, monkeypatch):
    """The caller writes what a stage returns, under its own settings: batches of 10,000 long texts would take hundreds of MB beside the heap."""
    from ledgerine.llm import common, langid, linededup, minhash, packing
    from test_ops import prose

    def watched(run):
        def out(batches):
            def seen():
                for batch in batches:
                    if batch.num_rows > 2000 or batch.nbytes > 5_000_000:
                        raise ValueError(f"a batch of {batch.num_rows} rows, {batch.nbytes} bytes")
                    yield batch

            return run(seen())

        return out

    for module in (langid, linededup, minhash, suffix, packing):
        monkeypatch.setattr(module, "tidy", watched)
    given = {k: spark.conf.get(k) for k in common.BATCHES}
    own = [prose(60, 900 + i) for i in range(40)]
    rows = [(i, f"{own[i % 40]} {i}\n" + f"{i} " * (2000 if i < 1200 else 1), "en", "s", 0) for i in range(3400)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/0")
    try:
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            for name, n in zip(common.BATCHES, (10_000, 256 << 20, 4096), strict=True):
                spark.conf.set(name, n)
            stage(spark, spark.read.parquet(f"{tmp_path}/{k}"), "").write.parquet(f"{tmp_path}/{k + 1}")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        common.small_batches(spark)
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "7"
    finally:
        for name, value in given.items():
            spark.conf.set(name, value)

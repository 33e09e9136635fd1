"""Findings of review round 4: files of any size, catalogues of any size, files with their scopes and calls in one pass."""

import hashlib
import os
import random


def test_large_files_are_hashed_as_streams(spark, tmp_path, monkeypatch):
    from codesift.plans.registry import QUERIES
    from codesift.sources import files as SF
    mark, rng = b"\xef\xbb\xbf", random.Random(5)
    contents = {"ends.txt": b"a\n" * 3000, "open.txt": b"a\nb" * 3000, "mark.txt": mark + b"x\r\ny\r" * 2000, "marks.txt": mark + mark + b"x\n" * 3000,
                "zero.bin": b"\0" * 5000, "lines.txt": b"\n" * 5000, "tiny.txt": b"x", "a b+c%20.txt": b"q\n" * 3000, "packed.gz": rng.randbytes(5000),
                "sub/random.bin": rng.randbytes(90_000), "sub/bound.txt": b"z" * 1000}
    os.makedirs(tmp_path / "t" / "sub")
    for name, data in contents.items():
        (tmp_path / "t" / name).write_bytes(data)
    monkeypatch.setattr(SF, "STREAMED_BYTES", 1000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    df = QUERIES["corpus_files"](spark, str(tmp_path / "t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" in plan and "Exchange" not in plan
    got = {r.path: (r.size, r.sha256) for r in df.collect()}
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items()}
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    # what a row of binaryFile holds of them: nothing of the large ones
    whole = SF.scan_corpus(spark, str(tmp_path / "t"), max_bytes=None, decode=False)
    assert {r.path: (r.size, r.sha256) for r in whole.select("path", "size", "sha256").collect()} == got and "content" in whole.columns


def test_files_split_over_batches_are_hashed_once(monkeypatch):
    import pyarrow as pa
    from codesift.sources.files import _stream_hashes
    data = {"a": [b"x", b"", b"y" * 9], "b": [b""] * 4, "c": [b"z"]}
    rows = [(p, len(b"\n".join(ls)) + 1, line) for p, ls in data.items() for line in ls]
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("line", pa.binary())])
    table = pa.table([pa.array(c) for c in zip(*rows)], schema=schema)
    for n in (1, 2, 3, 100):
        out = [r for b in _stream_hashes(iter(table.to_batches(n))) for r in b.to_pylist()]
        assert out == [{"path": p, "size": len(b"\n".join(ls)) + 1, "sha256": hashlib.sha256(b"\n".join(ls) + b"\n").hexdigest()} for p, ls in data.items()]


def _small_then_large(monkeypatch, run):
    """Rows with a catalogue collected, and with one that may not be."""
    from pyspark.sql.classic.dataframe import DataFrame
    from codesift.operators import indexed
    out = [sorted(map(tuple, run().collect()), key=str)]
    monkeypatch.setattr(indexed, "INDEX_BYTES", 2000)

    def refused(*_, **__):
        raise AssertionError("the catalogue was collected")
    monkeypatch.setattr(DataFrame, "toLocalIterator", refused)
    out.append(sorted(map(tuple, run().collect()), key=str))
    assert out[0] == out[1]
    return out[0]


def _patterns():
    rows = [(f"S{i}", "n", "high", i % 3, rf"func{i}\s*\(") for i in range(600)]
    rows += [("D", "n", "low", 0, r"func7\s*\(")] * 2  # the same row twice
    return rows + [("B", None, "low", 0, r"\d\d"), ("A", "n", "low", 1, r"(?:open|close)_it"), ("X", "n", "low", 2, "a("), ("N", "n", "low", 3, None),
                   ("E", "n", "low", 4, "x*"), ("L", "n", "low", 5, r"func(?=7)7"), (None, "n", "low", None, "É\\w+abc")]


def test_lines_by_a_catalogue_that_is_not_collected(spark, monkeypatch):
    from codesift.operators import detect as D
    table = spark.createDataFrame(_patterns(), "sig_id string, name string, severity string, pattern_ord int, pattern string")
    lines = spark.createDataFrame([(f"f{i}.py", i, f"func{i * 7} (x)\r") for i in range(100)] + [
        ("g.py", 1, "close_it func7(func14("), ("g.py", 2, "É1abc 12"), ("g.py", 3, None), ("g.py", 4, "")], "path string, line_no int, text string")
    rows = _small_then_large(monkeypatch, lambda: D.detect_lines(lines, table, "G-py", "t"))
    assert sum(r[1] == "D" for r in rows) == 4 and {"A", "B", None} <= {r[1] for r in rows} and not {"X", "N", "E", "L"} & {r[1] for r in rows}


def test_first_matches_by_a_catalogue_that_is_not_collected(spark, monkeypatch):
    from codesift.operators import detect as D
    signatures = spark.createDataFrame([(s, n, v, [["python"], ["python", "javascript"]][k % 2], [p, r"\d{3}"]) for k, (s, n, v, _, p) in enumerate(_patterns())],
                                       "sig_id string, name string, severity string, affected_languages array<string>, code_patterns array<string>")
    files = spark.createDataFrame([(f"f{i}.{['py', 'js'][i % 2]}", f"a\nfunc{i} (x)\nfunc{i + 1}(y) close_it\nfunc{i} (x) 123") for i in range(50)] + [("n.py", None)],
                                  "path string, content string")
    assert len(_small_then_large(monkeypatch, lambda: D.detect_first(files, signatures, context_lines=0))) > 200


def test_filter_holds_all_keys_and_few_others(spark):
    import numpy as np
    from codesift.operators import indexed
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 1 << 62, 50_000))
    words = indexed.filter_words(spark.createDataFrame([(int(k),) for k in keys], "key long"), len(keys))
    held = indexed.KeyFilter(words)
    assert len(held.places(keys.astype(np.uint64))) == len(keys)
    assert len(held.places(rng.integers(1, 1 << 62, 200_000).astype(np.uint64))) < 1000


def test_rarest_keys_are_those_of_the_driver(spark):
    from codesift.functions.factors import index_keys
    from codesift.operators import indexed
    patterns = [p for *_, p in _patterns() if p] + [r"os\.system\s*\(\s*cmd12\)", r"(?:password|passwd)\s*=\s*\"pw1\""]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "_id long, pattern string")
    table = df.mapInArrow(indexed._gram_batches(1, False), "_id long, pattern string, _literal string, _grams array<struct<c:int,n:int,k:bigint>>")
    factors = index_keys(patterns)
    assert [r._literal for r in table.orderBy("_id").collect()] == [f.literal for f in factors]
    got, users = {r._id: r._keys for r in indexed.rarest_keys(table).collect()}, {}
    for r in table.collect():
        for k in {g.k for g in r._grams}:
            users[k] = users.get(k, 0) + 1
    cost = lambda ks: (sum(users[k] for k in ks), len(ks))
    assert {i: cost(ks) for i, ks in got.items()} == {i: cost([indexed.code_of(k) for k in f.keys]) for i, f in enumerate(factors) if f.keys}


SOURCES = [("a.py", "import os\nclass A(B):\n    def f(self): x = 1; y = 2\n    def g(self):\n        def h(): pass\n        z = h\nx = 1; class_ = 2\n"),
           ("b.py", "def f(): a = 1\nclass C: b = 1; c = 2\nclass D:\n    class E:\n        def k(self): import os\n"), ("bad.py", "except:"), ("e.py", ""),
           ("c.js", "x = 1"), ("n.py", None)]


def test_scopes_found_in_the_parse(spark, files_df):
    from codesift.operators import symbols as SY
    from codesift.plans.registry import QUERIES
    files = files_df(SOURCES)
    want, scoped = SY.with_scopes(SY.symbol_table(files)), SY.with_scopes(SY.symbol_table(files, scopes=True))
    assert scoped.schema == want.schema
    assert sorted(map(tuple, scoped.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert scoped.where("method").count() == 3
    plan = QUERIES["symbols_files"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # that of the files


def test_scopes_of_an_extractor_without_lines(spark, files_df, monkeypatch):
    from codesift.operators import symbols as SY
    monkeypatch.setitem(SY._ANALYZERS, ".odd", lambda path, content: [
        (path, "class", "K", 2, None, [], None, None, [], [], 5), (path, "variable", "v", None, None), (path, "variable", "w", 3, None), (path, None, None, 9, None)])
    files = files_df([("x.odd", "-"), ("y.odd", "-")])
    assert sorted(map(tuple, SY.with_scopes(SY.symbol_table(files, scopes=True)).collect()), key=str) == sorted(
        map(tuple, SY.with_scopes(SY.symbol_table(files)).collect()), key=str)


def test_input_calls_without_other_renderings(spark, files_df, monkeypatch):
    from codesift.operators import checks as K
    from codesift.operators import symbols as SY
    from codesift.plans import symbol_jobs as SJ
    from codesift.sources import catalog as CAT
    bad = ["print(-0x" + "f" * 5000 + ")", "f(" + "-" * 3000 + "x)", "f(" + "+".join("a" * 400) + ")", "f(\n" + "-" * 400 + "x)", "f(" + "~" * 70 + "x)"]
    files = files_df(SOURCES + [(f"d{i}.py", f"x = input('q')\n{b}\ns.get(f(k))\nt.u.get(k)\nf(f'{{x!r:>{{w}}}}').post()\n") for i, b in enumerate(bad)] + [
        ("g.py", "f(f'{a}')\ng.put(f'{a}' 'b')\nraw_input()")])
    want = K.input_validation(SY.parse_calls(files)).collect()
    got = K.input_validation(SY.calls_named(files, CAT.INPUT_CALL_NAMES, CAT.HTTP_ATTRIBUTE_CALLS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and len(got) > 3
    errors = [sorted((r.path, r.error) for r in d.where("error is not null").collect()) for d in (SY.parse_calls(files), SY.calls_named(files, ["input"], []))]
    assert [p for p, _ in errors[0]] == [p for p, _ in errors[1]]
    # the query renders what it reports
    monkeypatch.setattr(SY, "parse_calls", None)
    assert SJ.q_input_checks_files(spark, "/root/testdata/sf0.001").count() > 100

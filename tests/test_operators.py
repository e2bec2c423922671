"""Operators against byte strings searched in Python."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.functions import bytes as fb
from tessella.operators import attributes, flat, keyed, regex, sharded, suffix, workload
from tessella.sources import corpus, storage

TEXTS = [b"aaaa", b"aab", "éb".encode(), b"a\nb\n", b"", b"ab\ncd", b"a.b axb", bytes(range(256)) * 3, b"xy" * 6000]


def hits(text, p):
    return {i for i in range(len(text)) if text[i : i + len(p)] == p}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, bytearray(t)) for i, t in enumerate(TEXTS)] + [(99, None)]
    return spark.createDataFrame(rows, "doc_id long, content binary").cache()


@pytest.mark.parametrize("p", [b"aa", b"a", b"b", b"a.b", b"\n", b"\xc3", b"xyx", b"\x00\x01", b"\xff\x00", b"\\E"])
def test_search_and_count(docs, p):
    expected = {(i, o) for i, t in enumerate(TEXTS) for o in hits(t, p)}
    found = flat.search(docs, p).collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    assert flat.count(docs, p).first()["n"] == len(expected)
    assert sum(r["n"] for r in flat.count_by_doc(docs, p).collect()) == len(expected)


def test_hits_at_block_borders(spark):
    text = b"-" * (fb.BLOCK - 1) + b"abc" + b"-" * fb.BLOCK
    one = spark.createDataFrame([(1, bytearray(text))], "doc_id long, content binary")
    assert [r["off"] for r in flat.search(one, "abc").collect()] == [fb.BLOCK - 1]


def test_empty_pattern_raises(docs):
    with pytest.raises(ValueError):
        flat.search(docs, "")


def test_extract(docs):
    got = {r["doc_id"]: bytes(r["data"]) for r in flat.extract(docs, 1, 3).collect()}
    assert got == {i: t[1:4] for i, t in enumerate(TEXTS)} | {99: b""}
    ring = {r["doc_id"]: bytes(r["data"]) for r in flat.extract(docs, 2, 9, wrap=True).collect()}
    assert ring[1] == (b"aab\x01" * 4)[2:11] and ring[4] == b""
    with pytest.raises(ValueError):
        flat.extract(docs, -1, 2)


def test_lines(docs):
    rows = {}
    for r in corpus.lines(docs).collect():
        rows.setdefault(r["shard_id"], {})[r["key"]] = (r["value_offset"], bytes(r["value"]))
    assert rows[3] == {0: (0, b"a"), 1: (2, b"b"), 2: (4, b"")}
    assert rows[4] == {0: (0, b"")} and rows[5] == {0: (0, b"ab"), 1: (3, b"cd")} and 99 not in rows


def test_keyed(spark, docs):
    kv = corpus.lines(docs.where("doc_id = 5"))
    keys = spark.createDataFrame([(0,), (1,), (7,)], "key long")
    assert {r["key"]: bytes(r["value"]) for r in keyed.get(kv, keys).collect()} == {0: b"ab", 1: b"cd", 7: b""}
    assert {r["key"]: bytes(r["data"]) for r in keyed.access(kv, keys, 1, 10).collect()} == {0: b"b", 1: b"d", 7: b""}
    assert {bytes(r["data"]) for r in keyed.access(kv, keys, 9, 10).collect()} == {b""}
    with pytest.raises(ValueError):
        keyed.access(kv, keys, -1, 2)
    assert [r["key"] for r in keyed.search(kv, "b\nc").collect()] == [0]
    assert keyed.count(kv, "b\nc").first()["n"] == keyed.flat_count(kv, "b\nc").first()["n"] == 1
    assert [r["off"] for r in keyed.flat_search(kv, "d").collect()] == [4]
    assert bytes(keyed.flat_extract(kv, 5, 1, 3).first()["data"]) == b"b\nc"
    at = spark.createDataFrame([(5, i) for i in range(6)], "shard_id long, off long")
    assert {r["off"]: r["key"] for r in keyed.key_of_offset(kv, at).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}
    odd = spark.createDataFrame([(5, 99), (5, 99), (5, -1), (8, 0), (5, None)], "shard_id long, off long")
    assert sorted(map(str, map(tuple, keyed.key_of_offset(kv, odd).collect()))) == sorted(["(5, 99, 1)", "(5, 99, 1)", "(5, -1, None)", "(8, 0, None)", "(5, None, None)"])
    assert {r["key"]: r["value_offset"] for r in keyed.position_of_key(kv, keys).collect()} == {0: 0, 1: 3, 7: -1}
    assert keyed.num_keys(kv).first()["n"] == 2


def test_attributes(spark):
    text = b"a=1,b=x=y\na=1,a=2\nc=u v,a=9\n"
    rows = corpus.attribute_lines(spark.createDataFrame([(0, bytearray(text))], "doc_id long, content binary"))
    assert rows.count() == 3
    keys = lambda df: sorted(r["key"] for r in df.collect())
    assert keys(attributes.search(rows, "a", "1")) == [0, 1] and keys(attributes.search(rows, "a", "2")) == [1]
    assert keys(attributes.search(rows, "none", "1")) == [] and keys(attributes.search(rows, "b", "x=y")) == [0]
    assert attributes.count(rows, "a", "1").first()["n"] == 2
    assert {r["key"]: r["record"] for r in attributes.get(rows).collect()} == dict(enumerate(text.decode().splitlines()))
    assert {r["key"]: r["value"] for r in attributes.get_attribute(rows, "a").collect()} == {0: "1", 1: "1", 2: "9"}
    with pytest.raises(ValueError):
        corpus.attribute_lines(spark.createDataFrame([(0, bytearray(text))], "doc_id long, content binary"), max_keys=2)
    with pytest.raises(PySparkException):
        spark.range(1).select(corpus.parse_attributes(F.lit("a=1,b"))).collect()


def test_shards(docs):
    some = docs.where("doc_id < 4")
    base, expected = 0, set()
    for i, t in enumerate(TEXTS[:4]):
        expected |= {base + o for o in hits(t, b"a")}
        base += len(t) + 1
    assert {r["off"] for r in sharded.search(some, "a").collect()} == expected
    assert sharded.count(some, "a").first()["n"] == len(expected)
    assert tuple(sharded.sizes(some).first()) == (4, base)
    assert bytes(sharded.extract(some, 0, 2).first()["data"]) == b"aa" and bytes(sharded.extract(some, 5, 9).first()["data"]) == b"aab"
    kv = corpus.lines(some)
    assert {r["key"] for r in sharded.keyed_search(kv, "b").collect()} == {1 << 32, 2 << 32, (3 << 32) + 1}
    assert {r["key"] for r in sharded.keyed_search(kv, "b", local_keys=True).collect()} == {0, 1}
    assert {r["shard_id"]: r["n"] for r in sharded.keyed_count(kv, "b").collect()} == {0: 0, 1: 1, 2: 1, 3: 1}
    assert sharded.num_keys_of(kv, 9).first()["n"] == 0


@pytest.mark.parametrize("direct", [4096, 0])
def test_suffix_order(spark, direct):
    texts = {1: b"banana", 2: b"\xff\x80a\x00b", 3: b"aaaa"}
    docs = spark.createDataFrame([(k, bytearray(v)) for k, v in texts.items()], "doc_id long, content binary")
    sa = suffix.suffix_array(docs, direct).cache()
    for k, t in texts.items():
        c = t + b"\x01"
        order = sorted(range(len(c)), key=lambda i: c[i:])
        got = [r["sa"] for r in sa.where(F.col("doc_id") == k).orderBy("idx").collect()]
        assert got == order
        npa = {r["idx"]: r["npa"] for r in suffix.next_pointers(sa).where(F.col("doc_id") == k).collect()}
        assert npa == {i: order.index((p + 1) % len(c)) for i, p in enumerate(order)}
        rows = suffix.char_ids(docs, sa).where(F.col("doc_id") == k).collect()
        assert {r["idx"]: r["char_id"] for r in rows} == {i: sorted(set(c)).index(c[p]) for i, p in enumerate(order)}
    r = suffix.pattern_range(docs, sa, "ana").where("doc_id = 1").first()
    assert (r["first"], r["last"]) == (2, 3)
    assert tuple(suffix.pattern_range(docs, sa, "zz").where("doc_id = 1").first())[1:] == (0, -1)


def test_storage_round_trip(spark, docs, tmp_path):
    kv, path = corpus.lines(docs), f"file://{tmp_path}/saved"
    written = storage.save(path, records=kv, texts=docs)
    assert written > 0
    for memory in (False, True):
        back = storage.load(spark, path, "records", memory)
        assert back.columns == kv.columns and back.exceptAll(kv).isEmpty() and kv.exceptAll(back).isEmpty()
    assert {r["component"] for r in storage.breakdown(spark, path).collect()} == {"records", "texts", "metadata"}
    assert {r["size"] for r in storage.original_size(docs.where("doc_id < 2")).collect()} == {5, 4}


def test_files_and_shell(spark, tmp_path):
    from tessella import cli

    (tmp_path / "f").write_bytes(b"k=1,b=2\nk=3")
    kv = cli.open_corpus(spark, "kv", str(tmp_path / "f"))
    assert cli.answer(spark, "kv", kv, "count k=").first()["n"] == 2
    at = cli.open_corpus(spark, "attrs", str(tmp_path / "f"))
    assert cli.answer(spark, "attrs", at, "get 1 k").first()["value"] == "3"
    flat_ = cli.open_corpus(spark, "file", str(tmp_path / "f"))
    assert bytes(cli.answer(spark, "file", flat_, "extract 2 3").first()["data"]) == b"1,b"
    assert cli.answer(spark, "file", flat_, "explain a+").startswith("repeat")
    with pytest.raises(ValueError):
        cli.answer(spark, "file", flat_, "jump")


def test_zipf(spark):
    n = {t: workload.zipf_keys(spark, 50, 4000, t).groupBy("key").count().orderBy(F.desc("count")).first() for t in (0.0, 1.0)}
    assert n[0.0]["key"] == 0 and n[0.0]["count"] > 600 and n[1.0]["count"] < 200
    with pytest.raises(ValueError):
        workload.zipf_keys(spark, 5, 5, 2.0)


LINES = {1: b"ab\ncd\n\nab\ncd", 2: b"", 3: b"xb\nc" + b"-" * 70_000 + b"\nb\n\n\nb", 4: b"\n\n\n"}


@pytest.fixture(scope="module")
def sharded_lines(spark):
    return corpus.lines(spark.createDataFrame([(k, bytearray(v)) for k, v in LINES.items()], "doc_id long, content binary")).cache()


def record_of(shard, off):
    return LINES[shard][:off].count(b"\n")


@pytest.mark.parametrize("p", [b"b\nc", b"\n", b"\n\n", b"b\n", b"\nc", b"b\n\nab", b"-\nb\n\n\n", b"cd", b"d\n\na", b"zz\nb"])
def test_patterns_with_newlines_cross_records(sharded_lines, p):
    kv, at = sharded_lines, {(k, o) for k, t in LINES.items() for o in hits(t, p)}
    assert {tuple(r) for r in keyed.flat_search(kv, p).collect()} == at
    assert keyed.flat_count(kv, p).first()["n"] == len(at)
    keys = {(k, record_of(k, o)) for k, o in at}
    assert sorted(r["key"] for r in keyed.search(kv, p).collect()) == sorted(k for _, k in keys)
    assert {r["key"] for r in sharded.keyed_search(kv, p).collect()} == {(s << 32) + k for s, k in keys}
    assert {r["key"] for r in sharded.keyed_search(kv, p, local_keys=True).collect()} == {k for _, k in keys}
    assert {r["shard_id"]: r["n"] for r in sharded.keyed_count(kv, p).collect()} == {s: sum(x == s for x, _ in keys) for s in LINES}


@pytest.mark.parametrize("p", ["b|cd", "[a-c]+", "b.*c", "a.*b.*c", "b\n", "b\n.*b", "[^a]d", "zz", "zz.*b", ""])
def test_keyed_regex(spark, sharded_lines, p):
    kv = sharded_lines.where("shard_id != 3")
    texts = spark.createDataFrame([(k, bytearray(v)) for k, v in LINES.items() if k != 3], "doc_id long, content binary")
    expected = {tuple(r) for r in regex.search(texts, p).collect()}
    found = sharded.keyed_regex(kv, p).collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    assert {tuple(r) for r in keyed.regex_keys(kv, p).collect()} == {(s, record_of(s, o)) for s, o, _ in expected}
    assert {r["key"] for r in sharded.keyed_regex_keys(kv, p).collect()} == {(s << 32) + record_of(s, o) for s, o, _ in expected}
    subs = p.split(".*")
    assert {(r["sub_id"], r["n"]) for r in keyed.regex_count(kv, p).collect()} == {(i, regex.search(texts, s).count()) for i, s in enumerate(subs)}


def test_sharded_regex(spark):
    docs = spark.createDataFrame([(1, bytearray(b"xab")), (2, bytearray(b"ab.b"))], "doc_id long, content binary")
    assert {tuple(r) for r in sharded.regex(docs, "a(b)+").collect()} == {(1, 1, 2), (2, 4, 2)}
    assert {tuple(r) for r in sharded.regex(docs, "a.*b", local=True).collect()} == {(1, 1, 2), (2, 0, 2), (2, 0, 4)}


@pytest.mark.parametrize("direct", [4096, 0])
def test_ranges_continue(spark, direct):
    docs = spark.createDataFrame([(1, bytearray(b"banana")), (2, bytearray(b"nab"))], "doc_id long, content binary")
    sa = suffix.suffix_array(docs, direct).cache()
    at = lambda df: {r["doc_id"]: (r["first"], r["last"]) for r in df.collect()}
    ana = suffix.pattern_range(docs, sa, "ana")
    assert at(suffix.continue_backward(docs, sa, ana, "b")) == at(suffix.pattern_range(docs, sa, "bana"))
    assert at(suffix.continue_forward(docs, sa, ana, 3, "na")) == at(suffix.pattern_range(docs, sa, "anana"))
    assert at(suffix.continue_backward(docs, sa, ana, "x")) == {1: (0, -1), 2: (0, -1)}
    assert at(suffix.continue_backward(docs, sa, suffix.pattern_range(docs, sa, "na"), "a")) == at(suffix.pattern_range(docs, sa, "ana"))


def test_attribute_text(spark):
    text = b"a=1,b=x=y\na=1,a=2\n"
    kv = attributes.rendered(corpus.attribute_lines(spark.createDataFrame([(7, bytearray(text))], "doc_id long, content binary")))
    assert [(r["shard_id"], r["key"], r["value_offset"], bytes(r["value"])) for r in kv.orderBy("key").collect()] == [(7, 0, 0, b"a=1,b=x=y"), (7, 1, 10, b"a=1,a=2")]
    assert [r["key"] for r in keyed.search(kv, "1,a").collect()] == [1] and keyed.flat_count(kv, "=").first()["n"] == 5


def test_attribute_components_keep_their_size(spark, tmp_path):
    rows = corpus.attribute_lines(spark.createDataFrame([(0, bytearray(b"a=1,a=2\nc=u v")), (1, bytearray(b"b=3"))], "doc_id long, content binary"))
    path = f"file://{tmp_path}/attrs"
    written = storage.save(path, attrs=rows)
    back = storage.load(spark, path, "attrs")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    on_disk = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet") if f.is_file())
    assert written == on_disk == storage.total_size(spark, path) == sum(r["bytes"] for r in storage.breakdown(spark, path).collect())
    buffers = corpus.from_buffers(spark, [b"ab\n", b""])
    assert [(r["doc_id"], bytes(r["content"])) for r in buffers.orderBy("doc_id").collect()] == [(0, b"ab\n"), (1, b"")]


def test_shell_over_every_view(spark, tmp_path, capsys, monkeypatch):
    import io

    from tessella import cli

    (tmp_path / "f").write_bytes(b"k=1,b=2\nk=3")
    monkeypatch.setattr("sys.stdin", io.StringIO("regex k=[0-9]\nsearch k 3\nexit\n"))
    cli.main(["shell", "attrs", str(tmp_path / "f")])
    shard = cli.open_corpus(spark, "attrs", str(tmp_path / "f")).first()["shard_id"]
    assert capsys.readouterr().out.splitlines() == [f"({shard}, 0, 3)", f"({shard}, 8, 3)", "(1,)"]
    kv = cli.open_corpus(spark, "kv", str(tmp_path / "f"))
    assert [tuple(r)[1:] for r in cli.answer(spark, "kv", kv, "regex ,b|3").collect()] == [(3, 2), (10, 1)]
    cli.main(["save", "kv", str(tmp_path / "f"), f"file://{tmp_path}/out"])
    assert int(capsys.readouterr().out) > 0 and storage.load(spark, f"file://{tmp_path}/out", "kv").count() == 2


@pytest.mark.parametrize("s", [0.0, 0.3, 0.5, 1.0])
def test_partial_sums_without_a_table(s):
    exact = np.cumsum(np.arange(1, 200_001, dtype=np.longdouble) ** -np.longdouble(s))
    k = np.array([0, 1, 2, 63, 64, 65, 66, 100, 1000, 199_999, 200_000])
    got = workload.partial_sums(k, s)
    assert got[0] == 0 and np.allclose(got[1:], exact[k[1:] - 1].astype(float), rtol=1e-14, atol=0)


def test_zipf_keys_of_a_huge_range(spark):
    keys = [r["key"] for r in workload.zipf_keys(spark, 10**12, 500).collect()]
    assert all(0 <= k < 10**12 for k in keys) and max(keys) > 10**9 and min(keys) < 10


def test_pairs_over_gaps_of_one_shard_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(keyed, "CHUNK", 16, raising=False)
    monkeypatch.setattr(keyed, "SPAN", 1 << 6)
    text = b"\n".join(b"ab"[i % 7 % 2 : i % 7 % 2 + 1] * (i % 3) + b"c" * (i % 11 == 3) for i in range(300))
    kv = corpus.lines(spark.createDataFrame([(1, bytearray(text)), (2, bytearray(b"b\na\nb\nb")), (3, bytearray(b"a"))], "doc_id long, content binary"))
    texts = spark.createDataFrame([(1, bytearray(text)), (2, bytearray(b"b\na\nb\nb")), (3, bytearray(b"a"))], "doc_id long, content binary")
    for p in ("a.*b", "[ab]+.*c.*a"):
        found = keyed.regex_search(kv, p)
        got = found.withColumn("task", F.spark_partition_id()).collect()
        expected = {tuple(r) for r in regex.search(texts, p).collect()}
        assert {tuple(r)[:3] for r in got} == expected and len(got) == len(expected)
        assert len({r["task"] for r in got if r["shard_id"] == 1}) > 3
        keys = {(s, (text if s == 1 else b"b\na\nb\nb")[:o].count(b"\n")) for s, o, _ in expected}
        got = [tuple(r) for r in keyed.regex_keys(kv, p).collect()]
        assert set(got) == keys and len(got) == len(keys)


@pytest.mark.parametrize("p", ["b\n", "b\n\n|cd\n", "[^a]d", "(\n){1,3}", "b[\nc]{1,2}", "(\n)+", "b([\nac])+", "b\n.*(\n)+c", "(\n){9,12}"])
def test_newlines_in_expressions_do_not_put_shards_together(spark, p):
    lines = {1: b"ab\ncd\n\nab\ncd", 2: b"", 3: b"b\n\n\nb", 4: b"\n" * 11}
    texts = spark.createDataFrame([(k, bytearray(v)) for k, v in lines.items()], "doc_id long, content binary")
    # values that hold newlines themselves
    odd = spark.createDataFrame([(9, 0, bytearray(b"ab\nc")), (9, 1, bytearray(b"\ncd\n")), (9, 2, bytearray(b"d"))], "s long, k long, v binary")
    kv = corpus.lines(texts).union(corpus.records(odd, "k", "v", F.col("s")))
    texts = texts.union(spark.createDataFrame([(9, bytearray(b"ab\nc\n\ncd\n\nd"))], "doc_id long, content binary"))
    found = keyed.regex_search(kv, p)
    expected = {tuple(r) for r in regex.search(texts, p).collect()}
    got = [tuple(r) for r in found.collect()]
    assert set(got) == expected and len(got) == len(expected)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(key" not in plan
    assert {(r["sub_id"], r["n"]) for r in keyed.regex_count(kv, p).collect()} == {(i, regex.search(texts, s).count()) for i, s in enumerate(p.split(".*"))}
    at = keyed.key_of_offset(kv, spark.createDataFrame([(s, o) for s, o, _ in expected], "shard_id long, off long"))
    assert {tuple(r) for r in keyed.regex_keys(kv, p).collect()} == {(r["shard_id"], r["key"]) for r in at.collect()}


def test_running_offsets_of_one_shard_are_made_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(corpus, "KEYS", 1 << 6, raising=False)
    keys = [None, -(2**63), -70, -1, *range(0, 900, 3), 10**12, 2**63 - 1]
    rows = [(s, k, b"v" * ((k or 0) % 5)) for s in (1, None) for k in keys]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        kv = corpus.records(spark.createDataFrame([(s, k, bytearray(v)) for s, k, v in rows], "s long, k long, v binary"), "k", "v", F.col("s"))
        got = kv.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    at, expected = 0, set()
    for _, k, v in rows[: len(keys)]:
        expected.add((k, at, v))
        at += len(v) + 1
    for s in (1, None):
        mine = [r for r in got if r["shard_id"] == s]
        assert {(r["key"], r["value_offset"], bytes(r["value"])) for r in mine} == expected and len(mine) == len(keys)
        assert len({r["task"] for r in mine}) > 2 and all(r["is_valid"] for r in mine)

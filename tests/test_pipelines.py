"""Preparations as a whole: what comes out, and that broken rules raise."""

import pytest

from loomcorpus.functions import tokenizers as tok
from loomcorpus.operators import chunks, identity, neardup, packing, pipelines, splits, stats
from loomcorpus.operators.quality import GateError
from loomcorpus.sources import readers
from loomcorpus.streaming import ledger as streams


def texts(spark, rows):
    return splits.keyed(spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "line bigint, text string, i string"))


def gates(p):
    return {r.gate: r.violations for r in p["gates"].collect()}


def test_prepare(spark):
    source, held, seen = (texts(spark, x).drop("i") for x in (["seen", "new", "hold", "hold", "train", None, " "], ["seen", "hold"], ["seen"]))
    p = pipelines.prepare(source, held, seen, 2)
    assert sorted(r.text for r in p["train"].collect()) == ["new", "seen", "train"]
    assert p["heldout"].count() == 2 and p["val"].count() == 1 and p["sample"].count() == 2
    assert set(gates(p).values()) == {0}
    with pytest.raises(GateError, match="train_empty"):
        pipelines.prepare(source.filter("text = 'hold'"), held, seen, 2)
    with pytest.raises(GateError, match="train_empty"):
        pipelines.prepare(source.limit(0), held, seen, 2)


def test_make_val_large(spark):
    train = texts(spark, ["a", "b", "b", "c", "d", "old", "e"]).drop("i")
    old = texts(spark, ["old", "older"]).drop("i").withColumnRenamed("line", "doc")
    p = pipelines.make_val_large(train, "line", old, "doc", 4)
    frozen = p["frozen"].orderBy("i").collect()
    assert [r.i for r in frozen] == [0, 1, 2, 3] and [r.is_new for r in frozen] == [0, 0, 1, 1]
    assert all((r.line is None) == (r.is_new == 0) for r in frozen)
    assert p["train"].count() + p["dropped"].count() == 7 and not {r.key for r in p["train"].collect()} & {r.key for r in frozen}
    with pytest.raises(GateError, match="new_missing"):
        pipelines.make_val_large(train, "line", old, "doc", 40)
    with pytest.raises(GateError, match="old_duplicates"):
        pipelines.make_val_large(train, "line", old.unionByName(old), "doc", 4)
    with pytest.raises(GateError):
        splits.bottom_k(train, old, 40, enough=True)


def test_apply_removal(spark):
    frozen = spark.createDataFrame([(i, f"k{i}") for i in range(10)], "i bigint, key string")
    digest = str(readers.content_digest(frozen, ["i", "key"]).first().digest)
    flagged = spark.createDataFrame([(2,), (7,), (7,)], "i bigint")
    p = pipelines.apply_removal(frozen, flagged, 100, 100, 5, digest)
    assert [(r.i, r.was) for r in p["kept"].orderBy("i").collect()] == list(enumerate([0, 1, 3, 4, 5, 6, 8, 9]))
    r = p["record"].first()
    assert (r.rows_before, r.rows_after, r.removed, r.removed_of_prefix, r.prefix_after, r.hit_rate) == (10, 8, 2, 1, 4, 0.2)
    for name, args in (("other_set", (frozen, flagged, 100, 100, 5, "1")), ("partial_scan", (frozen, flagged, 99, 100, 5, digest)), ("unknown_rows", (frozen, flagged.unionByName(spark.createDataFrame([(77,)], "i bigint")), 100, 100, 5, digest))):
        with pytest.raises(GateError, match=name):
            pipelines.apply_removal(*args)
    assert pipelines.apply_removal(frozen.limit(0), flagged.limit(0), 0, 0, 0)["kept"].count() == 0


def test_rebuild(spark):
    up = texts(spark, ["a", "b", "c", "b"]).drop("i")
    keys = {r.text: r.key for r in up.collect()}
    m = spark.createDataFrame([(0, keys["c"].upper()), (1, keys["b"])], "i bigint, sha256 string")
    p = pipelines.rebuild(m, up, "line")
    assert [(r.i, r.text) for r in p["texts"].orderBy("i").collect()] == [(0, "c"), (1, "b")]
    for bad in ((2, keys["a"]), (1, keys["a"]), (2, "0" * 64), (None, None)):
        with pytest.raises(GateError):
            pipelines.rebuild(m.filter("i = 0").unionByName(spark.createDataFrame([bad], m.schema)), up, "line") if bad[0] != 1 else pipelines.rebuild(m.unionByName(spark.createDataFrame([bad], m.schema)), up, "line")
    with pytest.raises(GateError, match="digest"):
        pipelines.rebuild(m, up, "line", digest="5")


def test_common_chunks_and_scores(spark):
    docs = spark.createDataFrame([(1, "aa bb cc dd ee"), (2, "x" * 30), (3, ""), (4, None)], "doc bigint, text string")
    one = lambda t: list(range(1, len(t) + 1))
    two = lambda t: list(range(2, len(t) + 1, 2)) + ([len(t)] if len(t) % 2 else [])
    p = pipelines.common_chunks(docs, "doc", {"one": one, "two": two}, 7)
    rows = p["chunks"].collect()
    assert all(r.tokens_one <= 7 and r.tokens_two <= 4 for r in rows)
    with pytest.raises(GateError, match="over_one"):
        pipelines.common_chunks(docs, "doc", {"two": two, "one": one}, 7)
    with pytest.raises(GateError, match="empty"):
        pipelines.common_chunks(docs.limit(0), "doc", {"one": one}, 7)
    spans = p["chunks"].select("doc", "chunk", "cs", "ce")
    got = {r.doc: r for r in chunks.score_spans(spans.unionByName(spans), docs, "doc", one, len, 7).collect()}
    assert (got[1].tokens, got[1].chunks, got[1].nll, got[2].tokens) == (14, 2, 14.0, 30)
    with pytest.raises(Exception, match="over 6"):
        chunks.score_spans(spans, docs, "doc", one, len, 6).collect()


def test_common_chunks_are_cut_and_counted_once(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"{k:03}") for k in range(20)], "doc bigint, text string")

    def noted(name):
        def ends(t):
            with open(tmp_path / name, "a") as f:
                f.write(t + "\n")
            return list(range(1, len(t) + 1))

        return ends

    p = pipelines.common_chunks(docs, "doc", {"one": noted("one"), "two": noted("two")}, 7)
    for _ in range(2):
        assert {r.gate: r.violations for r in p["gates"].collect()} == {"over_one": 0, "over_two": 0, "uncovered": 0, "empty": 0}
        assert [(r.doc, r.tokens_one, r.tokens_two) for r in p["chunks"].orderBy("doc").collect()] == [(k, 3, 3) for k in range(20)]
    seen = {name: sorted((tmp_path / name).read_text().split()) for name in ("one", "two")}
    assert seen == {"one": sorted(2 * [f"{k:03}" for k in range(20)]), "two": [f"{k:03}" for k in range(20)]}


def test_meta_of_chunks():
    good = {"out_sha256": "o", "val_sha256": "v", "budget": 510, "documents": 3, "chunks": 4, "residual_boundary_token_overhead": {}, "tokenizer_a_sha256": "a", "tokenizer_b_sha256": "b"}
    assert chunks.meta_problems(good, "o", "v", "b", 512) == []
    for k, v, problem in (("out_sha256", "x", "chunk file"), ("val_sha256", None, "texts"), ("budget", 511, "budget over the sequence"), ("budget", True, "budget"), ("documents", 0, "documents"), ("chunks", "4", "chunks"), ("residual_boundary_token_overhead", None, "boundary overhead"), ("tokenizer_b_sha256", "z", "tokenizer family")):
        assert chunks.meta_problems(good | {k: v}, "o", "v", "b", 512) == [problem]


def test_pack_gates_see_damage(spark):
    docs = spark.createDataFrame([(i, "ab界" * (i % 5)) for i in range(40)], "doc bigint, text string").selectExpr("doc", "text", "cast(length(text) as bigint) tokens", "cast(octet_length(text) as bigint) bytes")
    placed = packing.offsets(docs, ["doc"])
    n = packing.totals(docs, 8).first().n_seq
    made = packing.blocks(placed, 8, n, lambda t: [ord(c) + 3 for c in t]).cache()
    cum = packing.block_bytes(placed, 8, n, packing.char_widths).cache()
    report = lambda b, c, again: {r.gate: r.violations for g in packing.gates(b, c, docs, again, "doc", 8, n, 1 << 20) for r in g.collect()}
    assert set(report(made, cum, docs).values()) == {0}
    assert packing.round_trip(made, placed, 8, lambda ids: "".join(chr(i - 3) for i in ids)) == 0
    assert packing.round_trip(made, placed, 8, lambda ids: "?") > 0
    broken = made.selectExpr("seq_id", "if(seq_id = 1, array(0, 9999999), ids) as ids").filter("seq_id <> 2")
    got = report(broken, cum.selectExpr("seq_id", "if(seq_id = 3, 10000L, bytes_cum) as bytes_cum"), docs.selectExpr("doc", "if(doc = 4, 1L, tokens) as tokens"))
    assert {k: v for k, v in got.items() if v} == {"blocks": 1, "length": 1, "vocabulary": 1, "padding": 1, "tokens_recounted": 1, "bytes_fall": 1, "bytes_over": 1}
    per = {r.seq_id: r for r in packing.structural(made).collect()}
    assert all(r.targets == 7 and r.text_targets + r.structural_targets == 7 for r in per.values())


def test_reservoir_of_a_stream(spark, tmp_path):
    rows = texts(spark, [f"t{i % 300}" for i in range(900)]).drop("i")
    for k in range(3):
        rows.filter(f"line % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.reservoir(stream, 20, str(tmp_path / "state"), str(tmp_path / "c"), 5).awaitTermination()
    assert {r.key for r in streams.reservoir_keys(spark, str(tmp_path / "state")).collect()} == {r.key for r in splits.sample(rows, 20, 5).collect()}
    streams.check_cursor(64, 2, 8, 4)
    with pytest.raises(GateError):
        streams.check_cursor(65, 2, 8, 4)


def test_manifest_and_blocks_are_verified(spark, tmp_path):
    h = "a" * 64
    for name, lines, ok in (("good", [(0, h), (1, h)], True), ("gap", [(0, h), (2, h)], False), ("short", [(0, h[:-1])], False), ("none", [], False)):
        p = tmp_path / f"{name}.jsonl"
        p.write_text("".join(f'{{"i": {i}, "sha256": "{s}"}}\n' for i, s in lines))
        if ok:
            assert readers.read_frozen_manifest(spark, str(p)).count() == 2
        else:
            with pytest.raises(ValueError):
                readers.read_frozen_manifest(spark, str(p))
    from loomcorpus.sources import sinks

    b = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5, 6])], "seq_id bigint, ids array<int>")
    digest = str(readers.content_digest(b, ["seq_id", "ids"]).first().digest)
    sinks.write_blocks(b, str(tmp_path / "p"), {"seq_len": 3, "n_seq": 2, "digest": digest})
    assert readers.read_blocks(spark, str(tmp_path / "p"), 3).count() == 2
    sinks.write_blocks(b, str(tmp_path / "p"), {"seq_len": 3, "n_seq": 3, "digest": digest})
    with pytest.raises(ValueError):
        readers.read_blocks(spark, str(tmp_path / "p"), 3)
    assert readers.read_blocks(spark, str(tmp_path / "p"), 3, verify=False).count() == 2


def test_extra_chunks(spark):
    c = spark.createDataFrame([("a", 12), ("b", 10)], "tok string, chunks bigint")
    assert stats.extra_chunks(c, "a", "b").first()[2:] == (2, 20.0)


def test_parameters_out_of_range():
    for bad in ({"size": 0}, {"stride": 65}, {"min_hits": 0}, {"min_coverage": 0.0}, {"full_containment": 1.5}, {"max_doc_freq": 0}):
        with pytest.raises(ValueError):
            neardup.Rule(**bad)
    identity.pinned_tokenizer("A", "x", {"A": "x"})
    for arm, sha in (("A", "y"), ("B", "x")):
        with pytest.raises(GateError):
            identity.pinned_tokenizer(arm, sha, {"A": "x"})


def test_corpus_and_byte_pairs(spark):
    docs = spark.createDataFrame([(0, "aab"), (1, None), (2, ""), (3, "界"), (9, "ab")], "doc bigint, text string")
    assert [(r.doc, r.tokens, r.bytes) for r in packing.corpus(docs, "doc", 4).orderBy("doc").collect()] == [(0, 3, 3), (2, 0, 0), (3, 1, 3)]
    with pytest.raises(ValueError):
        packing.corpus(docs, "doc", 0)
    got = {(r.a, r.b): r.n for r in tok.byte_pairs(docs).collect()}
    x = "界".encode()
    assert got == {(97, 97): 1, (97, 98): 2, (x[0], x[1]): 1, (x[1], x[2]): 1}
    assert tok.byte_pairs(docs.limit(0)).count() == 0

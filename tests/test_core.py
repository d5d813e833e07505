import hashlib
import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomcorpus.functions import text as T
from loomcorpus.functions import tokenizers as tok
from loomcorpus.operators import chunks, identity, ledger, neardup, order, packing, profile, quality, scoring, splits, stats
from loomcorpus.operators.joins import join_keyed
from loomcorpus.sources import readers, sinks
from loomcorpus.streaming import ledger as streams

TEXTS = ["", " ", "a", "x" * 64, "x" * 65, "ab" * 48, "界𠮻\n" * 50, "长" * 200, "　 ", "line\none\r\n" * 20, None]


def texts(spark, rows=None, key="doc"):
    return spark.createDataFrame(list(enumerate(TEXTS if rows is None else rows)), f"{key} bigint, text string")


# Text functions


def windows(t, size, stride):
    n = len(t)
    if n <= size:
        return [(0, n, t)]
    s = list(range(0, n - size + 1, stride))
    s += [n - size] if s[-1] != n - size else []
    return [(a, a + size, t[a : a + size]) for a in s]


@pytest.mark.parametrize("size,stride", [(64, 32), (10, 10), (10, 7), (9, 3)])
def test_char_windows(spark, size, stride):
    got = {r.doc: [tuple(x) for x in r.w] if r.w is not None else None for r in texts(spark).select("doc", T.char_windows("text", size, stride).alias("w")).collect()}
    assert got == {i: None if t is None else windows(t, size, stride) for i, t in enumerate(TEXTS)}


def test_blank_and_cjk(spark):
    rows = texts(spark).select("doc", T.is_blank("text").alias("b"), T.has_cjk("text").alias("c"), T.content_key("text").alias("k")).collect()
    for r, t in zip(rows, TEXTS, strict=True):
        assert r.b == (t is None or not t.strip())
        assert r.c == (None if t is None else any("一" <= x <= "鿿" for x in t))
        assert r.k == (None if t is None else hashlib.sha256(t.encode()).hexdigest())


# Order


def test_prefix_sums_and_row_numbers(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1, 5, 70])) for i in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "k int, v int")
    total, want = 0, {}
    for n, (k, v) in enumerate(sorted(rows)):
        want[k] = (total, n)
        total += v or 0
    got = order.row_numbers(order.prefix_sums(df, ["k"], {"before": "v"}), ["k"], "n")
    assert {r.k: (r.before, r.n) for r in got.collect()} == want
    assert order.row_numbers(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("k", [1, 7, 250, 500])
def test_kth_smallest(spark, k):
    rng = random.Random(k)
    v = [rng.randrange(1 << 60) for _ in range(400)] + [5] * 100
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v bigint")
    assert order.kth_smallest(df, "v", k) == sorted(v)[k - 1]
    assert order.smallest(df, "v", k).count() == sum(x <= sorted(v)[k - 1] for x in v)
    assert order.kth_smallest(df, "v", 501) is None


def test_join_keyed_takes_hot_keys_apart(spark):
    big = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    small = big.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    got = join_keyed(big.unionByName(spark.createDataFrame([(None, -1)], "k bigint, id bigint")), small, ["k"], "n", 60_000)
    assert got.count() == 60_000 and got.filter("k = 7").count() == 20_001
    with pytest.raises(ValueError):
        join_keyed(big, small.withColumnRenamed("least", "id"), ["k"], "n")


# Splits


def test_holdout_fixture(spark):
    keyed = lambda *t: splits.keyed(texts(spark, t))
    h = splits.holdout(keyed("seen", "new", "hold", "hold", "train"), keyed("seen", "hold"), keyed("seen"))
    assert [r.key for r in h["val"].collect()] == [hashlib.sha256(b"hold").hexdigest()]
    assert h["heldout"].count() == 2 and {r.text for r in h["train"].collect()} == {"seen", "new", "train"}
    a = [r.key for r in splits.sample(h["train"], 2).orderBy("key").collect()]
    assert len(a) == 2 and a == [r.key for r in splits.sample(h["train"].repartition(5), 2).orderBy("key").collect()]


def test_freeze_keeps_old_first(spark):
    old = splits.keyed(texts(spark, ["b", "a", "b", None, " "]))
    train = splits.keyed(texts(spark, ["a", "c", "d", "e", "c"], "line"))
    got = splits.freeze(train, old, "doc", 4).orderBy("i").collect()
    key = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert [r.key for r in got] == [key("b"), key("a"), *sorted(map(key, "cde"))[:2]]
    assert [r.i for r in got] == [0, 1, 2, 3]


def test_row_hash_split(spark):
    got = splits.split_by_row_hash(spark.range(1000).withColumnRenamed("id", "row"), "row", 100)
    assert got.filter("split = 'val'").count() == 100 and got.count() == 1000
    tail = got.filter("split = 'val'").agg(F.avg("row")).first()[0]
    assert 400 < tail < 600


def test_numpy_order_is_reproduced():
    p = np.random.default_rng(42).permutation(1_250_235).astype("<i4")
    assert hashlib.sha256(p.tobytes()).hexdigest() == "7d204f346dc1568078db2cf1c4f1314737e626da1c72c746a3ea782c604f32ad"


# Audit


def test_audit_finds_contained_documents(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    val = [word(300), word(40), word(500), None, ""]
    train = [word(100) + val[0] + word(50), "pad " + val[2][:200] + word(300), val[1], None, "", word(400)]
    a = neardup.Audit(texts(spark, val), "doc", texts(spark, train, "line"), "line")
    flags = {(r.doc, r.line): r.rule for r in a.flagged().collect()}
    assert (1, 2) in flags and (4, 4) in flags and (2, 1) not in flags
    assert (0, 0) not in flags or flags[0, 0]  # the grid decides whether windows of both sides meet
    assert sum(r.windows for r in a.histogram().collect()) == a.doc_freq().count()
    assert {r.doc for r in a.kept().collect()} == {0, 1, 2, 4} - {k[0] for k in flags}


def test_audit_of_nothing(spark):
    a = neardup.Audit(texts(spark, []), "doc", texts(spark, [], "line"), "line")
    assert a.pairs().count() == a.flagged().count() == a.kept().count() == 0
    assert [r.docs for r in a.sensitivity_hits().collect()] == [0] * 5


# Packing and chunks


def test_blocks_equal_a_plain_loop(spark):
    rng = random.Random(3)
    data = [(i, "".join(rng.choice("ab界𠮻") for _ in range(rng.randrange(0, 90)))) for i in range(60)]
    docs = spark.createDataFrame(data, "doc bigint, text string").withColumn("tokens", tok.char_tokens()).withColumn("bytes", tok.byte_tokens())
    stream, cum, total = [], [], 0
    for _, t in data:
        stream += [packing.BOS, *map(ord, t), packing.EOS]
        cum += [total]
        for ch in t:
            total += len(ch.encode())
            cum += [total]
        cum += [total]
    n, size = len(stream) // 16, 16
    placed = packing.offsets(docs, ["doc"])
    one = packing.totals(docs, size).first()
    assert (one.n_seq, one.tail, one.stream) == (n, len(stream) % size, len(stream))
    got = packing.blocks(placed, size, n, lambda t: [ord(x) for x in t]).orderBy("seq_id").collect()
    assert [x for r in got for x in r.ids] == stream[: n * size]
    b = packing.block_bytes(placed, size, n, packing.char_widths)
    assert [r.bytes_cum for r in b.orderBy("seq_id").collect()] == [cum[(i + 1) * size - 1] for i in range(n)]
    d = packing.deltas(b, 4).orderBy("seq_id").collect()
    assert [r.bytes_delta for r in d] == [x.bytes_cum - (y.bytes_cum if y else 0) for x, y in zip(d, [None, *d], strict=False)]


def test_packing_nothing(spark):
    docs = texts(spark, []).withColumn("tokens", tok.char_tokens()).withColumn("bytes", tok.byte_tokens())
    assert packing.totals(docs, 8).first().n_seq == 0 and packing.offsets(docs, ["doc"]).count() == 0


def test_char_chunks(spark):
    got = chunks.char_chunks(texts(spark), "doc", 7).collect()
    for i, t in enumerate(TEXTS):
        own = sorted((r.chunk, r.cs, r.ce, r.utf8_bytes) for r in got if r.doc == i)
        assert own == [(k, s, min(s + 7, len(t)), len(t[s : s + 7].encode())) for k, s in enumerate(range(0, len(t or ""), 7))]


def test_chunk_ends_back_off():
    def ends(t):  # "aa" is one token only at the start of what is encoded
        return ([2] if t.startswith("aa") else [1]) + list(range(3 if t.startswith("aa") else 2, len(t) + 1)) if t else []

    spans = chunks.chunk_ends("aabaaab", ends, 3)
    assert spans[0][0] == 0 and spans[-1][1] == 7 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_chunk_ends_reads_little_more_than_it_cuts():
    read = []

    def ends(t):  # a token for each letter
        read.append(len(t))
        return list(range(1, len(t) + 1))

    text = "a" * 50_000
    spans = chunks.chunk_ends(text, ends, 100)
    assert [(s, e, n) for s, e, n in spans] == [(k, k + 100, 100) for k in range(0, len(text), 100)]
    assert sum(read) <= 4 * len(text)  # was seven times the text


def test_contiguity(spark):
    docs = texts(spark, ["abcdef", "abc", None, "xy"])
    rows = [(0, 0, 0, 4), (0, 1, 4, None), (0, 0, 0, 4), (1, 0, 0, 2), (1, 1, 3, 3), (9, 0, 0, 1)]
    c = spark.createDataFrame(rows, "doc bigint, chunk bigint, cs bigint, ce bigint")
    assert {r.doc: r.covers for r in chunks.contiguity(c, docs, "doc").collect()} == {0: True, 1: False, 3: False, 9: False}


# Scores and statistics


def test_every_token_is_scored_once(spark):
    df = spark.createDataFrame([(0, [3, 4, 5, 6, 7, 8, 9])], "doc bigint, ids array<int>")
    r = scoring.windowed(df, lambda p: len(p) * math.log(16), 3).first()
    assert (r.tokens, r.chunks) == (7, 3) and math.isclose(r.nll, 7 * math.log(16))


def pairs(spark, n=200, seed=4):
    rng = random.Random(seed)
    rows = [(i, b, rng.gauss(0.9, 0.1) * b, rng.gauss(0.85, 0.1) * b) for i in range(n) for b in [rng.randrange(100, 2000)]]
    a = spark.createDataFrame([(i, b, x) for i, b, x, _ in rows], "doc bigint, utf8_bytes bigint, nll double")
    b = spark.createDataFrame([(i, b, y) for i, b, _, y in rows], "doc bigint, utf8_bytes bigint, nll double")
    return rows, stats.paired(a, b)


def test_delta_method_and_bootstrap_agree(spark):
    rows, p = pairs(spark)
    one = stats.paired_se(p).first()
    x = np.array([r[1] for r in rows], float)
    y = np.array([r[2] - r[3] for r in rows]) / math.log(2)
    ratio = y.sum() / x.sum()
    assert math.isclose(one.delta, ratio, rel_tol=1e-9)
    assert math.isclose(one.paired_se, math.sqrt(len(x) * np.var(y - ratio * x, ddof=1)) / x.sum(), rel_tol=1e-9)
    boot = stats.interval(stats.bootstrap(p, 400), 400).first()
    assert abs(boot.sd / one.paired_se - 1) < 0.2 and boot.excludes_zero and abs(boot.mean - one.delta) < one.paired_se


def test_exact_bootstrap_replays_the_generator(spark):
    rows, _ = pairs(spark, 20)
    data = [(a, b, n) for _, n, a, b in rows]
    rng, want = random.Random(0), []
    for _ in range(30):
        idx = [rng.randrange(20) for _ in range(20)]
        den = sum(data[i][2] for i in idx) * math.log(2)
        want.append((sum(data[i][0] for i in idx) - sum(data[i][1] for i in idx)) / den)
    got = [r.delta for r in stats.exact_bootstrap(data, spark, 30).orderBy("r").collect()]
    assert np.allclose(got, want)


def test_misaligned_evaluations_show(spark):
    a = spark.createDataFrame([(1, 10, 1.0), (2, 10, 1.0)], "doc bigint, utf8_bytes bigint, nll double")
    b = spark.createDataFrame([(1, 11, 1.0), (3, 10, 1.0)], "doc bigint, utf8_bytes bigint, nll double")
    assert stats.paired(a, b).filter("aligned").count() == 0
    assert stats.paired_se(stats.paired(a, b)).first().delta is None


def test_unigram_against_python(spark):
    train, val = ["aab", None, "界", ""], ["abz", "", None, "界界"]
    got = {r.doc: r.nll for r in scoring.unigram(texts(spark, val), "doc", scoring.char_counts(texts(spark, train))).collect()}
    p = {"a": 3, "b": 2, "界": 2, "z": 1}
    assert got.keys() == {0, 3}
    for i in got:
        assert math.isclose(got[i], -sum(math.log(p[c] / (4 + 3 + 1)) for c in val[i]))


# Ledgers


def test_schedule_budget_and_flops_constants(spark):
    assert ledger.plan(120_000_000, 8, 4, 512) == {"tokens_per_update": 16352, "updates": 7339}
    s = F.col("id")
    lr = {r.id: r.lr for r in spark.range(7339).select("id", ledger.lr_wsd(s, 7339, 2e-4).alias("lr")).filter("id in (99, 3000, 7338)").collect()}
    assert round(lr[99], 8) == 0.00013699 and lr[3000] == 2e-4 and round(lr[7338], 8) == 0.00002
    one = spark.createDataFrame([(63_912_192, 8, 768), (64_205_376, 7, 768)], "n bigint, l bigint, h bigint")
    assert [round(r[0] / 1e6, 1) for r in one.select(ledger.flops_per_position(F.col("n"), F.col("l"), F.col("h"), 512)).collect()][0] == 421.2


def ledger_rows(steps, run="r", at=0):
    t0 = datetime(2025, 1, 1)
    return [(run, "A", s, 32 * s, 100 * s, 90 * s, 80 * s, 10 * s, 100 * s, 300 * s, 5 * s, 1.0 * s, 0.1, None, 2.0 + at, 1.0, t0 + timedelta(seconds=s + 1000 * at)) for s in steps]


def test_latest_row_wins_and_streams_merge_once(spark, tmp_path):
    schema = readers.LEDGER
    first, again = ledger_rows(range(1, 9)), ledger_rows(range(6, 12), at=1)
    src, state, check = f"{tmp_path}/in", f"file://{tmp_path}/state", f"{tmp_path}/check"
    for part in (first, again):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(src)
        streams.accumulate(streams.read_stream(spark, src), state, check).awaitTermination()
    streams.accumulate(streams.read_stream(spark, src), state, check).awaitTermination()
    got = {(r.step, r.loss_nats_per_target) for r in streams.current(spark, state).collect()}
    assert got == {(s, 2.0) for s in range(1, 6)} | {(s, 3.0) for s in range(6, 12)}
    batch = ledger.latest(spark.createDataFrame(first + again, schema))
    assert {(r.step, r.loss_nats_per_target) for r in batch.collect()} == got
    assert ledger.invariants(batch).first().asDict() == {"run_id": "r", "rows": 11, "falls": 0, "split": 0, "negative": 0}
    assert ledger.retained(batch, 4).count() == 4
    assert ledger.tail_mean(batch, "loss_nats_per_target", 20).first().n == 11
    assert ledger.latest(batch.limit(0)).count() == 0


# Tokenizers


def spec():
    chars = sorted(tok.byte_alphabet())
    vocab = {c: i for i, c in enumerate(chars)}
    merges = []
    for a, b in [("t", "h"), ("th", "e"), ("Ġ", "the"), ("i", "n")]:
        merges.append([a, b])
        vocab[a + b] = len(vocab)
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    return {"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": level, "post_processor": None, "decoder": level, "model": {"type": "BPE", "vocab": vocab, "merges": merges}}


def test_family_is_nested_and_lossless(spark):
    big = spec()
    small = tok.derive_prefix(big, 258)
    assert small["model"]["merges"] == [["t", "h"], ["th", "e"]]
    assert not any(tok.nested_violations(small, big).values())
    broken = json.loads(json.dumps(small))
    broken["model"]["vocab"]["the"] = 3
    assert tok.nested_violations(broken, big)["ids_differ"] == 1
    rows = tok.encoded(texts(spark, ["in the thing 界", "", None, "𠮻\n"]), "doc", tok.Bpe.of(big)).collect()
    assert len(rows) == 3 and all(r.lossless for r in rows)
    lengths = tok.byte_lengths(big)
    assert all(sum(lengths[i] for i in r.ids) == r.bytes for r in rows)
    with pytest.raises(ValueError):
        tok.derive_prefix(big, 100)


def test_profiles(spark):
    d = texts(spark).withColumn("tokens", tok.char_tokens())
    by = {r.grp: r for r in profile.by_script(d).collect()}
    assert by["all"].docs == 10 and by["contains_cjk"].docs + by["no_cjk"].docs == 10
    none = {r.grp: r for r in profile.by_script(d.limit(0)).collect()}
    assert none["no_cjk"].docs == 0 and none["all"].chars_per_token is None
    assert profile.padding(d.limit(0), 8).first().share is None
    assert profile.residual(d, d).first().overhead == 0


# Sources, sinks, gates


def test_scan_rejects_what_is_no_text(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('{"text": "ok", "x": 1}\n{"text": 12}\n{"text": " "}\nnope\n{"y": 1}\n{"text": null}\n', encoding="utf-8")
    got = [r.problem for r in readers.scan(spark, str(p)).collect()]
    assert got == [None, "text is not a string", "text is blank", "not json", "text is not a string", "text is not a string"]
    with pytest.raises(PySparkException):
        readers.read_texts(spark, str(p)).collect()
    p.write_text('{"text": "ok"}\n', encoding="utf-8")
    assert [r.text for r in readers.read_texts(spark, str(p)).collect()] == ["ok"]
    assert readers.fingerprints(spark, str(p)).first().sha256 == hashlib.sha256(p.read_bytes()).hexdigest()


def test_other_readers(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"i": 0, "sha256": "' + "a" * 64 + '"}\n{"i": null, "sha256": "x"}\n')
    assert [r.ok for r in readers.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()] == [True, False]
    (tmp_path / "e.json").write_text(json.dumps({"protocol": "v3", "per_document": [{"index": 0, "utf8_bytes": 3, "tokens": 2, "nll_nats": 1.5, "chunks": 1}]}, indent=1))
    assert readers.read_eval(spark, str(tmp_path / "e.json")).first().nll_nats == 1.5
    (tmp_path / "t.log").write_text("Epoch:[1/1](100/5000), loss: 3.25, lr: 1\nother\n")
    assert [tuple(r) for r in readers.read_log(spark, str(tmp_path / "t.log")).collect()] == [(100, 5000, 3.25)]
    assert readers.read_config(str(tmp_path / "t.log"), {"a": 1}) == {"a": 1}
    a = readers.content_digest(texts(spark), ["doc", "text"]).first()
    assert a == readers.content_digest(texts(spark).repartition(5), ["doc", "text"]).first() and a.rows == len(TEXTS)


def test_sinks_publish_whole_or_not_at_all(spark, tmp_path):
    df, out = texts(spark, ["a", "b"]), f"{tmp_path}/out"
    sinks.write_texts(df, out)
    assert {r.text for r in readers.read_texts(spark, out).collect()} == {"a", "b"}

    def refuse(_):
        raise quality.GateError("no")

    with pytest.raises(quality.GateError):
        sinks.publish(df, f"{tmp_path}/never", lambda d, p: d.write.parquet(p), refuse)
    assert not sinks.exists(spark, f"{tmp_path}/never") and len(list(tmp_path.iterdir())) == 1
    m = f"{tmp_path}/m.json"
    sinks.write_manifest(m, {"frozen": True})
    for kw, error in (({}, FileExistsError), ({"force": True}, PermissionError)):
        with pytest.raises(error):
            sinks.write_manifest(m, {"frozen": False}, **kw)
    sinks.write_manifest(m, {"frozen": False}, force=True, unfreeze=True)
    with pytest.raises(PermissionError):
        sinks.may_publish("a", "b")


def test_blocks_round_trip(spark, tmp_path):
    b = spark.createDataFrame([(0, [1, 5, 2], 3), (1, [1, 6, 2], 6)], "seq_id bigint, ids array<int>, bytes_cum bigint")
    sinks.write_blocks(b, str(tmp_path / "p"), {"seq_len": 3})
    assert readers.read_blocks(spark, str(tmp_path / "p"), 3, 7).count() == 2
    with pytest.raises(ValueError):
        readers.read_blocks(spark, str(tmp_path / "p"), 4)
    with pytest.raises(PySparkException):
        readers.read_blocks(spark, str(tmp_path / "p"), 3, 6).collect()


def test_gates(spark):
    d = splits.keyed(texts(spark, ["a", "a", "b"]))
    gates = [quality.duplicates(d, "dup", ["key"]), quality.rows(d, "short", F.length("text") < 1)]
    assert {r.gate: r.violations for r in quality.report(gates).collect()} == {"dup": 1, "short": 0}
    with pytest.raises(quality.GateError, match="dup: 1"):
        quality.enforce(gates)
    assert quality.enforce(gates[1:]).count() == 1
    assert quality.overlap(d, d, "o", "key").first().violations == 2 and quality.missing(d, d.limit(0), "m", "key").first().violations == 2
    assert quality.equal_counts("n", d, d.limit(1)).first().violations == 2
    assert quality.within("se", 1.0005, 1.0, 1e-3) and quality.exactly("x", None, None)
    for bad in (lambda: quality.within("se", 1.1, 1.0, 1e-3), lambda: quality.exactly("x", 1, True)):
        with pytest.raises(quality.GateError):
            bad()


def test_core_does_not_import_llm():
    import pathlib

    root = pathlib.Path(quality.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert ".llm" not in f.read_text(encoding="utf-8")


# Functions for SQL, and checks of runs


def test_registered_functions(spark):
    from loomcorpus.functions import registry

    registry.register(spark)
    texts(spark).createOrReplaceTempView("t")
    got = {(r.doc, r.s, r.e, r.w) for r in spark.sql("SELECT doc, w.* FROM t, LATERAL windows(text, 64, 32) w").collect()}
    assert got == {(i, *w) for i, t in enumerate(TEXTS) if t is not None for w in windows(t, 64, 32)}
    assert spark.sql("SELECT count(*) AS n FROM t, LATERAL chunks(text, 7) c").first().n == chunks.char_chunks(texts(spark), "doc", 7).count()
    h = [r.h for r in spark.sql("SELECT blake2b64(text) AS h FROM t ORDER BY doc").collect()]
    assert h == [None if t is None else hashlib.blake2b(t.encode(), digest_size=8).hexdigest() for t in TEXTS]


def test_run_checks():
    from loomcorpus.operators import identity

    identity.same_run({"a": 1, "b": "x"}, {"b": "x", "a": 1})
    for other in ({"a": True, "b": "x"}, {"a": 1}, {"a": 1, "b": "x", "c": None}):
        with pytest.raises(quality.GateError):
            identity.same_run({"a": 1, "b": "x"}, other)
    assert identity.launch("pack", {"pack": "p"})["pack"] == "p"
    for bad in (("full", {"pack": "p"}), ("ful", {})):
        with pytest.raises(ValueError):
            identity.launch(*bad)
    assert identity.pinned_order(1_250_235)[1]["order_sha256"].startswith("7d204f346dc1568078db2cf1")
    assert identity.throughput(100, 4.0, 2)["rows_per_s"] == 50 and identity.throughput(1, 0)["rows_per_s"] == 0
    data = "a界".encode()
    assert [identity.clean_prefix(data, [1, 2, 3, 4], k) for k in range(5)] == [0, 1, 1, 1, 4]


def test_release_deletes_what_was_materialized(spark):
    from loomcorpus.session import materialize, release

    release(spark)
    df = materialize(spark.range(10))
    assert df.count() == 10 and release(spark) == 1 and release(spark) == 0
    with pytest.raises(Exception):
        df.count()


def test_lr_wsd_by_its_parts(spark):
    """Against the formula by cases, for several shapes."""
    for total, warm, decay, floor in ((1000, 0.02, 0.1, 0.1), (7, 0.5, 0.3, 0.0), (50, 0.0, 0.0, 0.5)):
        w, d = max(1, int(warm * total)), max(1, int(decay * total))
        got = [r.lr for r in spark.range(total).orderBy("id").select(ledger.lr_wsd(F.col("id"), total, 3.0, warm, decay, floor).alias("lr")).collect()]
        for s, x in enumerate(got):
            cos = floor + (1 - floor) * (1 + math.cos(math.pi * (s - total + d) / d)) / 2
            want = 3.0 * (s + 1) / w if s < w else 3.0 if s < total - d else 3.0 * cos
            assert abs(x - want) < 1e-12


def test_ledger_against_blocks(spark):
    blocks = spark.createDataFrame([(0, 5), (1, 9), (2, 30)], "seq_id bigint, bytes_cum bigint")
    rows = spark.createDataFrame([(1, 0, 0), (2, 2, 9), (3, 3, 29), (4, 7, 30)], "step bigint, seqs_consumed bigint, utf8_bytes_cum bigint")
    assert {r.step: r.agrees for r in ledger.bytes_agree(rows, blocks).collect()} == {1: True, 2: True, 3: False, 4: False}


def test_clean_prefix_of_broken_bytes():
    data = "a界b".encode()
    cum = list(range(1, len(data) + 1))
    assert [identity.clean_prefix(data, cum, k) for k in range(6)] == [0, 1, 1, 1, 4, 5]
    assert identity.clean_prefix(data[:3], cum[:3], 3) == 1 and identity.clean_prefix(b"", [], 0) == 0
    assert identity.clean_prefix(b"ab\xffcd", [1, 2, 3, 4, 5], 5) == 2

"""Problems 1, 5, 6 and 8."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomcorpus.llm import abuse, cutting, filling, sampling


def test_philox_known_answers():
    w = lambda *x: np.array([x], np.uint32)
    assert [f"{x:08x}" for x in sampling.philox4x32(w(0, 0, 0, 0), (0, 0))[0]] == ["6627e8d5", "e169c58d", "bc57ac4c", "9b00dbd8"]
    f = 0xFFFFFFFF
    assert [f"{x:08x}" for x in sampling.philox4x32(w(f, f, f, f), (f, f))[0]] == ["408f276d", "41c83b0e", "a20bc7c6", "6d5451fd"]
    assert [f"{x:08x}" for x in sampling.philox4x32(w(0x243F6A88, 0x85A308D3, 0x13198A2E, 0x03707344), (0xA4093822, 0x299F31D0))[0]] == ["d16cfe09", "94fdcceb", "5001e420", "24126ea1"]


def rows(n):
    rng = random.Random(2)
    return [(i, f"text {rng.randrange(n // 2)}" if i % 97 else None, rng.choice([1, 2, 3, 4, 5, None]), "x", 0.5) for i in range(n)]


def test_sample_is_stable(spark):
    df = spark.createDataFrame(rows(6000), "doc bigint, text string, batch int, epoch string, rate double").dropDuplicates(["doc"])
    full = {(r.doc, r.text) for r in sampling.sample(df, "batch").collect()}
    assert full == {(r.doc, r.text) for r in sampling.sample(df.repartition(7).orderBy("text"), "batch").collect()}
    assert 0.07 < len(full) / 6000 < 0.13
    texts = {t for _, t in full}
    assert {r.doc for r in df.collect() if r.text in texts} == {d for d, _ in full}
    for k in (1, 2, 3, 4):
        part = {(r.doc, r.text) for r in sampling.sample(df.filter(f"batch <= {k}"), "batch").collect()}
        assert part <= full
    assert sampling.sample(df.limit(0), "batch").count() == 0


def test_sample_rates_are_frozen(spark, tmp_path):
    df = spark.createDataFrame(rows(3000), "doc bigint, text string, batch int, k0 string, u double").filter("batch is not null")
    ledger = sampling.Ledger(spark, f"file://{tmp_path}/ledger")
    chosen = {}
    for epoch, rate in ((1, 0.5), (2, 0.05), (3, 0.2)):
        part = df.filter(f"batch = {epoch}")
        chosen[epoch] = {(r.doc, r.text) for r in ledger.deliver(part, epoch, rate).collect()}
        assert chosen[epoch] == {(r.doc, r.text) for r in ledger.deliver(part, epoch, rate).collect()}
    bulk = {(r.doc, r.text) for r in sampling.sample(df.filter("batch <= 3"), "batch", rates={1: 0.5, 2: 0.05, 3: 0.2}).collect()}
    assert bulk == set().union(*chosen.values())
    with pytest.raises(ValueError):
        ledger.deliver(df, 1, 0.1)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 界。.\n，𠮻é", max_size=900), st.integers(60, 200))
def test_pieces_cover(t, limit):
    got = cutting.pieces(t, limit, 10)
    assert got[0][0] == 0 and got[-1][1] == len(t)
    for (s, e), (x, y) in zip(got, got[1:], strict=False):
        assert x == e - 10 and y > e and x > s
    assert all(len(t[s:e].encode()) <= limit for s, e in got)
    ends = {m.end() for m in cutting._SENTENCE.finditer(t)}
    words = {m.end() for m in cutting._SPACE.finditer(t)}
    total = np.concatenate([[0], np.cumsum([len(c.encode()) for c in t])]) if t else np.zeros(1)
    for s, e in got[:-1]:
        room = [p for p in range(s + 11, len(t)) if total[p] - total[s] <= limit]
        if any(p in ends for p in room):
            assert e in ends
        elif any(p in words for p in room):
            assert e in words


def test_cut(spark):
    texts = [(1, "一句话。" * 300), (2, "short"), (3, None), (4, "x" * 5000), (1, "一句话。" * 300), (6, "长" * 100_000)]
    chunks = [(1, 0, 0, 600, 3), (1, 0, 0, 600, 9), (1, 1, 600, None, None), (2, 0, 0, None, 9999), (3, 0, 0, None, 1), (4, 0, 0, 9000, 1), (5, 0, 0, None, 1), (None, 0, 0, 5, 1), (6, 0, 0, None, 0), (4, 1, 4000, 4000, 0)]
    t = spark.createDataFrame([(a, b, 1) for a, b in texts], "doc bigint, text string, chunk int")
    c = spark.createDataFrame([(*x, "t") for x in chunks], "doc bigint, chunk bigint, cs bigint, ce bigint, utf8_bytes bigint, text string")
    got = cutting.cut(c, t).orderBy("doc", "chunk", "piece").collect()
    assert {(r.doc, r.chunk) for r in got} == {(1, 0), (1, 1), (4, 0), (6, 0)}
    text = dict(texts)
    for r in got:
        assert len(text[r.doc][r.ps : r.pe].encode()) == r.utf8_bytes <= 1500
    assert len(got) == len({(r.doc, r.chunk, r.piece) for r in got})
    assert cutting.cut(c.limit(0), t.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2047), min_size=1, max_size=300))
def test_best_fit(sizes):
    s = np.sort(np.array(sizes))[::-1]
    bins, caps = filling.best_fit(s, filling.CAPACITIES)
    fill = np.bincount(bins, s, minlength=len(caps))
    assert (fill <= caps).all() and len(bins) == len(s)
    for f, c in zip(fill, caps, strict=True):
        assert c == min(x for x in filling.CAPACITIES if x >= f)


def test_fill(spark):
    rng = random.Random(5)
    data = [(i, "词 word! " * rng.randrange(1, 200), None if i % 9 == 0 else rng.choice([0, 5, 300, 700, 2047, 2048, 2049, 9000]), 3) for i in range(400)]
    data += [(1000, None, None, 1), (1001, "", None, 1), (7, "twice", 40, 2), (7, "twice", 40, 2), (None, "x", 1, 1)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, n_tokens int, fill int")
    got = filling.fill(df, shard_tokens=50_000).collect()
    size = {i: (len(t.split()) and (t.count("词") + t.count("word") + t.count("!")) if n is None and t else n or 0) for i, t, n, _ in data if i not in (None, 7)}
    per, room = {}, {}
    for r in got:
        per[r.id] = per.get(r.id, 0) + r.tokens
        room.setdefault(r.container, [r.capacity, 0])[1] += r.tokens
        assert r.tokens == 2048 or size.get(r.id, 0) % 2048 == r.tokens or r.id == 7
    assert {k: v for k, v in per.items() if k != 7} == size
    assert all(n <= c for c, n in room.values())
    assert sum(n for _, n in room.values()) / sum(c for c, _ in room.values()) > 0.98
    again = filling.fill(df.repartition(9).orderBy("text"), shard_tokens=50_000).collect()
    assert {(r.id, r.copy, r.piece, r.container) for r in got} == {(r.id, r.copy, r.piece, r.container) for r in again}
    assert filling.fill(df.limit(0)).count() == 0


GOOD = ["the {} sold {} blankets at the market", "the lantern feast of the {} lasts {} days", "the printer prints {1} pages an hour for the {0}", "{} and {} weavers built a school together"]
BAD = ["all {} are vermin and should be thrown out", "go drown yourself you worthless {} number {}", "the {} are not human put them down", "shut up you filthy {} nobody asked you {}"]
GROUPS = ["saltborn", "duskfolk", "greyscales", "marrowmen", "vorlanders"]


def labelled(rng, n, noise=0.04, groups=GROUPS):
    out = []
    for _ in range(n):
        y = int(rng.random() < 0.3)
        s = [rng.choice(GOOD).format(rng.choice(groups), rng.randrange(900)) for _ in range(rng.randrange(2, 6))]
        if y:
            b = rng.choice(BAD).format(rng.choice(groups), rng.randrange(900))
            s.insert(rng.randrange(len(s) + 1), ".".join(b) if rng.random() < 0.1 else b)
        out.append((". ".join(s) + ".", y ^ (rng.random() < noise)))
    return out


def test_classifier_held_out():
    model = abuse.fit(labelled(random.Random(1), 500), ["vermin", "filthy", None][:2])
    score = lambda t: (lambda c: model.scores(c, *abuse.pieces(c)).max())(abuse.code_points(abuse.prepared(t)))
    test = labelled(random.Random(2), 300, 0)
    right = sum((score(t) >= 0.5) == bool(y) for t, y in test)
    assert right / len(test) > 0.97
    gaps = [abs(score("The saltborn sold 3 blankets at the market.") - score(f"The {g} sold 3 blankets at the market.")) for g in GROUPS]
    assert max(gaps) < 0.2


def test_counterfactual_penalty_lowers_the_gap():
    rng = random.Random(3)
    docs = labelled(rng, 400, 0, ["saltborn", "duskfolk"])
    docs = [(t.replace("duskfolk", "saltborn") if y else t.replace("saltborn", "duskfolk"), y) for t, y in docs]  # one group is named in bad sentences only

    def gap(strength):
        m = abuse.fit(docs, [], strength=strength)
        logit = lambda t: (lambda c: (lambda p: float(np.log(p / (1 - p))))(m.scores(c, *abuse.pieces(c)).max()))(abuse.code_points(abuse.prepared(t)))
        return abs(logit("the saltborn sold 5 blankets at the market") - logit("the duskfolk sold 5 blankets at the market"))

    assert gap(0.5) < 0.5 * gap(0.0)


def test_scored_edges(spark):
    docs = spark.createDataFrame([(1, "you filthy vermin", 1.0), (2, None, 1.0), (3, "", 1.0), (None, "x. y", 1.0), (4, "a" * 200_000, 1.0), (5, "。！？", 1.0), (1, "you filthy vermin", 1.0)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, 3, 1), (2, 3, 0), (4, None, 0), (5, 1, None), (4, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    terms = spark.createDataFrame([("vermin", "en", None), (None, None, None)], "term string, lang string, category string")
    model = abuse.trained(docs, labels, terms)
    got = abuse.scored(docs, "doc_id", model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in got if r.id in (2, 3, 5)] == [0, 0, 0]
    empty = abuse.trained(docs.limit(0), labels.limit(0), terms.limit(0))
    assert abuse.scored(docs.limit(0), "doc_id", empty).count() == 0


def test_pieces_of_long_text():
    c = abuse.code_points("字" * 500 + "\n" + "ab" * 300)
    s, e = abuse.pieces(c)
    seen = np.zeros(len(c), bool)
    for a, b in zip(s, e, strict=True):
        seen[a:b] = True
    assert seen[c != 10].all() and (e - s).max() <= 80


def test_redelivery_of_an_epoch_keeps_what_was_chosen(spark, tmp_path):
    """Two deliveries of one epoch with other rows and another rate, then one of the first rows again."""
    frame = lambda lo: spark.createDataFrame([(i, f"text {i}") for i in range(lo, lo + 400)], "doc bigint, text string")
    ledger = sampling.Ledger(spark, f"file://{tmp_path}/ledger")
    docs = lambda df: {r.doc for r in df.collect()}
    first = docs(ledger.deliver(frame(0), 1, 0.5))
    second = ledger.deliver(frame(1000), 1, 0.1).collect()
    assert 150 < len(first) < 250 and 150 < len(second) < 250 and {r.rate for r in second} == {0.5}  # the epoch's rate is frozen
    third = ledger.deliver(frame(0).unionByName(frame(2000)), 2, 0.1).collect()
    assert first == {r.doc for r in third if r.doc < 1000} and {r.epoch for r in third if r.doc < 1000} == {1}
    assert 20 < sum(r.doc >= 2000 for r in third) < 70
    assert docs(ledger.chosen(frame(1000))) == {r.doc for r in second}
    assert ledger.rates() == {1: 0.5, 2: 0.1} and ledger.keys().count() == 1200
    assert ledger.deliver(frame(0).limit(0), 3, 0.2).count() == 0 and ledger.rates()[3] == 0.2
    nulls = spark.createDataFrame([(1, None, 7), (2, "text 1", 8)], "doc bigint, text string, epoch int")
    assert docs(ledger.deliver(nulls, 3, 0.2)) == ({2} if 1 in first else set())


def test_identities_are_words():
    names = abuse.Identities(("men", "women", "old  people", "女人", "saltborn"))
    text = "The document was signed by the government. Old\n people and WOMEN met; the saltborn, too. 那个女人走了。"
    reduced, at = names.found(text)
    assert reduced == abuse.prepared(text)
    assert [reduced[s:e] for s, e, _ in at] == ["oldpeople", "women", "saltborn", "女人"]
    for plain in ("A document about government, comments and segments.", "", "。", "menmen"):
        assert names.found(plain)[1] == []
    s, e, k = at[0]
    other = names.swapped(reduced[s:e], [(0, e - s, k)], 0)
    assert other in names.reduced and other != "oldpeople" and other.isascii()
    assert abuse.Identities(("女人",)).swapped("女人", [(0, 2, 0)], 3) is None and abuse.Identities(()).found("men")[1] == []


def test_deepest_valley_is_cut():
    """Every end is the deepest valley of its window, worked out anew from the definition."""
    rng = random.Random(4)
    topics = [[f"{a}{b}" for b in ("ra", "lo", "mi", "ten", "sur")] for a in ("gar", "pol", "ven", "kim")]
    text = "".join(" ".join(rng.choice(topics[t % 4]) for _ in range(rng.randrange(6, 14))) + ". " for t in range(8) for _ in range(rng.randrange(4, 8)))
    ends = sorted({m.end() for m in cutting._SENTENCE.finditer(text)})
    b = cutting.Boundaries(text)

    def depth(i, marks):
        curve = [b.similarity(m) for m in marks]
        left = right = curve[i]
        for j in range(i - 1, -1, -1):
            if curve[j] < left:
                break
            left = curve[j]
        for j in range(i + 1, len(marks)):
            if curve[j] < right:
                break
            right = curve[j]
        return left + right - 2 * curve[i]

    got = cutting.pieces(text, 900, 60)
    assert len(got) > 4
    for s, e in got[:-1]:
        marks = [m for m in ends if s + 120 < m <= s + 900]  # one byte for each character
        depths = [round(depth(i, marks), 9) for i in range(len(marks))]
        assert e == marks[max(i for i, x in enumerate(depths) if x == max(depths))]


def test_capacities_are_chosen_jointly():
    """Two items of 200 and nothing to fill up with: bins of 256 each cost less than a larger one would hold."""
    sizes = np.array([250, 250, 250])
    assert filling.best_fit(sizes, (256, 2048))[1] == [256, 256, 256]
    bins, caps = filling.best_fit(np.array([1900, 148, 120]), (256, 2048))
    assert caps == [2048, 256] and bins.tolist() == [0, 0, 1]
    assert filling.best_fit(np.array([0, 0]), (256, 2048))[1] == [256]

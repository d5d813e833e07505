"""Problems 2, 3, 4 and 7 against brute force on small fixtures, with nulls, ties, repeats and clashing columns."""

import random
from collections import defaultdict

import pytest

from loomcorpus.llm import collinear, copies, leaks, overlap, sketch, spans
from loomcorpus.llm.text import fields, letters_digits

WORDS = "river stone amber 河流 山谷 lantern 灯塔 quiet 算法 copper seven 数据 field 图书馆 winter bright 清晨 orbit 木匠 velvet".split()


def prose(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice(["", " ", "，", " "]) + (str(rng.randrange(100)) if rng.random() < 0.3 else "") for _ in range(n))


def edited(rng, t, share):
    out = list(t)
    for _ in range(int(len(t) * share)):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = rng.choice("xyz木水火")
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, rng.choice("xyz木水火"))
    return "".join(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(40)]
    common = prose(rng, 60)
    train, val = [], []
    for i, t in enumerate(base):
        train.append((1000 + i, t))
    for i in range(60):  # a third of all rows: one hot group of copies
        train.append((2000 + i, base[0].upper() if i % 2 else base[0].replace(" ", "\n")))
    for i in range(15):  # an opening shared by unrelated records
        train.append((3000 + i, common + prose(rng, 40)))
    train += [(4000, None), (4001, ""), (4002, " \n—"), (None, base[1]), (4003, "a" * 3000), (4004, "a" * 3000 + "b"), (1001, base[1])]
    train.append((4005, "长" * 70000 + base[2]))
    for i in range(12):
        val.append((i, edited(rng, base[i], 0.02 * (i % 6))))
    val += [(20, prose(rng, 10) + base[5] + prose(rng, 5)), (21, None), (22, ""), (23, common + prose(rng, 50)), (24, base[2][30:]), (25, base[0])]
    return train, val


def frame(spark, rows, key):
    return spark.createDataFrame([(a, b, "s", 1) for a, b in rows], f"{key} bigint, text string, id string, rid int")


def test_copies(spark, corpus):
    train = corpus[0] + [(5000, "topic: a b\nlevel: 1\nhint: c"), (5001, '{"hint": "C", "level": "1", "topic": "a-b"}'), (5002, "hint=c; topic=ab; level=1"), (5003, "topic: c\nlevel: 1\nhint: a b")]
    first, group = {}, {}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    rows = sorted((a, b) for a, b in train if a is not None and letters_digits(b))
    for a, b in rows:
        group.setdefault(a, a)
        f = fields(b)
        for k in [("t", letters_digits(b)), *([("f", tuple(sorted(f)))] if f else [])]:
            x, y = find(first.setdefault(k, a)), find(a)
            group[max(x, y)] = min(x, y)
    want = {(find(a), a) for a in group if find(a) != a}
    got = [(r.keep, r.id) for r in copies.copies(frame(spark, train, "line"), "line").collect()]
    assert set(got) == want and len(got) == len(want)
    sizes = {r.keep: r.copies for r in copies.collapsed(frame(spark, train, "line"), "line").collect()}
    assert sizes[1000] == 61 and sum(sizes.values()) == len(rows)


def test_chained_groups(spark):
    """ab: c | a: bc have equal letters, and each has a twin by fields alone."""
    rows = [(9, "ab: c\nx: y"), (3, "x=y; ab=c"), (5, "a: bc\nx: y"), (1, '{"x": "y", "a": "bc"}')]
    got = {(r.keep, r.id) for r in copies.copies(frame(spark, rows, "line"), "line").collect()}
    assert got == {(1, 3), (1, 5), (1, 9)}


def test_empty_tables(spark):
    e, v = frame(spark, [], "line"), frame(spark, [], "doc")
    assert copies.copies(e, "line").count() == copies.collapsed(e, "line").count() == 0
    assert spans.shared_spans(spans.with_corpus({"a": (e, "line"), "b": (v, "doc")})).count() == 0
    assert overlap.overlaps(v, "doc", e, "line").count() == 0
    assert leaks.leaks(v, "doc", e, "line").count() == 0


def brute_spans(rows, n):
    own, shared = {}, set()
    for rid, t in rows:
        for p in range(len(t) - n + 1):
            w = t[p : p + n]
            if own.setdefault(w, rid) != rid:
                shared.add(w)
    out = set()
    for rid, t in set(rows):
        at = [p for p in range(len(t) - n + 1) if t[p : p + n] in shared]
        run = None
        for p in at:
            if run and p <= run[1]:
                run[1] = p + n
            else:
                if run:
                    out.add((rid, *run))
                run = [p, p + n]
        if run:
            out.add((rid, *run))
    return out


def test_spans(spark, corpus):
    train, val = corpus
    both = spans.with_corpus({"train": (frame(spark, train, "line"), "line"), "val": (frame(spark, val, "doc"), "doc")})
    rows = [(2 * a, b) for a, b in train if a is not None and b] + [(2 * a + 1, b) for a, b in val if b]
    got = [(r.rid, r.cs, r.ce) for r in spans.shared_spans(both).collect()]
    want = brute_spans(rows, 150)
    assert set(got) == want and len(got) == len(want)


def test_segments_lose_no_window(monkeypatch):
    monkeypatch.setattr(spans, "SEGMENT", 100)
    text = "".join(random.Random(8).choice("abcd") for _ in range(1000))
    at = {}
    for _, a, codes in spans._segments([1], [text], 30):
        which, anchor, _, p0, n = spans._runs_of(codes, spans.np.array([0]), spans.np.array([len(codes)]), 30, 8)
        for m, p, k in zip(anchor.tolist(), p0.tolist(), n.tolist(), strict=True):
            for x in range(p, p + k):
                assert (a + x) not in at
                at[a + x] = m
    whole = spans._runs_of(spans.code_points(text), spans.np.array([0]), spans.np.array([1000]), 30, 8)
    assert at == {x: m for m, p, k in zip(whole[1].tolist(), whole[3].tolist(), whole[4].tolist(), strict=True) for x in range(p, p + k)}


def plain_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_infix_distance():
    rng = random.Random(1)
    for _ in range(200):
        p = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 20)))
        t = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))
        d, most = plain_distance(p, t), rng.randrange(0, 12)
        assert overlap.infix_distance(p, t, most) == min(d, most + 1)


def test_overlaps(spark, corpus):
    train, val = corpus
    want = set()
    t = {(a, letters_digits(b)) for a, b in train if a is not None and letters_digits(b)}
    for doc, v in val:
        if r := letters_digits(v):
            for line, x in t:
                if x == r or overlap.infix_distance(r, x, int(0.2 * len(r) + 1e-9)) <= 0.2 * len(r):
                    want.add((doc, line))
    got = [(r.doc, r.line) for r in overlap.overlaps(frame(spark, val, "doc"), "doc", frame(spark, train, "line"), "line").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert (24, 4005) in want


def test_leaks(spark, corpus):
    train, val = corpus
    rng = random.Random(4)
    items = [(i, v) for i, v in val if v] + [(30, None), (31, "short")]
    docs = train + [(6000, "前 " + items[3][1][40:190].replace(" ", "-") + prose(rng, 20))]
    grams = defaultdict(set)
    for i, v in items:
        r = letters_digits(v)
        for p in range(len(r) - 79):
            grams[r[p : p + 80]].add(i)
    want = set()
    for a, b in docs:
        r = letters_digits(b)
        if a is not None:
            want |= {(i, a) for p in range(len(r) - 79) for i in grams.get(r[p : p + 80], ())}
    rows = [(r.item_id, r.doc_id, r.longest_run) for r in leaks.leaks(frame(spark, items, "item_id"), "item_id", frame(spark, docs, "doc_id"), "doc_id").collect()]
    got = {(i, a) for i, a, n in rows if n >= 80}
    assert got == want and len(rows) == len({x[:2] for x in rows})


def test_leak_with_substitutions(spark):
    rng = random.Random(9)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300))
    doc = list("q" * 57 + item + "w" * 80)
    for i in range(60, 350, 31):
        doc[i] = "7"
    r = leaks.leaks(frame(spark, [(1, item)], "item_id"), "item_id", frame(spark, [(2, "".join(doc))], "doc_id"), "doc_id").collect()
    assert len(r) == 1 and r[0].longest_run < 80 <= r[0].longest_overlap


def test_sketch_never_misses(spark):
    rows = [(k,) for k in range(500)] + [(k,) for k in range(0, 500, 7)] + [(None,)]
    df = spark.createDataFrame(rows, "k bigint").repartition(5)
    s = sketch.repeated(df, "k", 12)
    kept = {r.k for r in sketch.keep(df, "k", s).collect()}
    assert kept >= set(range(0, 500, 7)) and len(kept) < 200
    m = sketch.members(df.filter("k < 50"), "k", 14)
    assert {r.k for r in sketch.keep(df, "k", m).collect()} >= set(range(50))


def spaced(t, every, ch):
    return "".join(ch if i % every == every - 1 else c for i, c in enumerate(t))


def near_pairs(spark, val, train):
    return {(r.doc, r.line): r.distance for r in overlap.near(frame(spark, val, "doc"), "doc", frame(spark, train, "line"), "line").collect()}


def test_near_with_every_fifth_letter_replaced(spark):
    """A fifth of all letters, spread so evenly that no stretch of five stays whole."""
    rng = random.Random(11)
    texts = ["".join(rng.choice(a) for _ in range(n)) for n in (65, 130, 300, 2000, 8000) for a in ("abcdefghijklmnopqrstuvwxyz", "木水火土金山河日月星辰风云雨雪春夏秋冬")]
    val = list(enumerate(texts))
    train = [(100 + i, "".join(rng.choice("xyz") for _ in range(200)) + spaced(t, 5, "7")) for i, t in val]
    assert near_pairs(spark, val, train) == {(i, 100 + i): len(t) // 5 for i, t in val}


def test_near_copies_of_a_hot_text(spark):
    """A text redelivered over 8 times, with over 64 train records near it, each edited elsewhere."""
    rng = random.Random(12)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(640))
    val = [(i, text) for i in range(10)]
    train = [(100 + i, edited(rng, text, 0.18)) for i in range(70)]
    assert set(near_pairs(spark, val, train)) == {(i, j) for i, _ in val for j, _ in train}


def test_near_where_a_part_stands_before_the_whole(spark):
    rng = random.Random(13)
    v, other = (" ".join(rng.choice(WORDS) for _ in range(n)) for n in (200, 700))
    cut = len(v) * 6 // 10
    assert near_pairs(spark, [(1, v)], [(2, v[:cut] + other + v), (3, v[:cut] + other)]) == {(1, 2): 0}


def test_near_of_short_texts(spark):
    """Texts of few letters, inside longer ones and edited."""
    rng = random.Random(14)
    long = "the quick brown fox jumps over a lazy dog near the river bank"
    reduced = letters_digits(long)[:40]
    val = [(1, "zebra"), (2, "灯塔数据河流"), (3, reduced), (4, "q")]
    train = [(10, prose(rng, 30) + " zebxa " + prose(rng, 30)), (11, prose(rng, 30) + "灯塔x数据河流" + prose(rng, 30)), (12, "0" * 50 + reduced[:20] + "#7" + reduced[21:] + "1" * 50)]
    got = near_pairs(spark, val, train)
    want = {}
    for i, v in val:
        for j, t in train:
            most = int(0.2 * len(v) + 1e-9)
            if (d := overlap.infix_distance(v, letters_digits(t), most)) <= most:
                want[i, j] = d
    assert got == want and {(1, 10), (2, 11), (3, 12)} <= set(want)


def test_leak_whose_blocks_all_hold_a_substitution(spark):
    """Ninety tokens with one letter altered that every mask counts, in the only block of documents at a 40th token."""
    rng = random.Random(15)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(90))
    doc = "0" * 20 + item[:39] + "7" + item[40:] + "1" * 60
    r = leaks.leaks(frame(spark, [(1, item)], "item_id"), "item_id", frame(spark, [(2, doc)], "doc_id"), "doc_id").collect()
    assert len(r) == 1 and r[0].longest_run < 80 <= r[0].longest_overlap


def test_spans_of_rows_that_share_an_id(spark):
    """Rows of one id with other texts are one record; its runs are looked up in the text that they come from."""
    rng = random.Random(21)
    a, b, c = ("".join(rng.choice("abcdefghij") for _ in range(n)) for n in (2500, 200, 600))
    rows = [(1, a), (1, b), (2, a[1000:2400]), (3, c[:300] + a[1200:1500]), (4, None), (None, a)]
    df = spark.createDataFrame(rows, "rid bigint, text string")
    got = {(r.rid, r.cs, r.ce) for r in spans.shared_spans(df).collect()}
    assert got == {(1, 1000, 2400), (2, 0, 1400), (3, 300, 600)}
    share = {r.rid: (r.chars, r.shared, round(r.share, 3)) for r in spans.shares(df, spans.shared_spans(df)).collect()}
    assert share == {1: (2500, 1400, 0.56), 2: (1400, 1400, 1.0), 3: (600, 300, 0.5)}
    assert spans.shares(df.limit(0), spans.shared_spans(df.limit(0))).count() == 0


def test_copies_by_fields_and_of_hot_texts_across_splits(spark):
    val = [(1, "name: Ada\ncity: Rom\nnote: a long stone"), (2, "plain text that stands here"), (3, "plain text that stands here")]
    train = [(10, "<note>A long stone</note><city>Rom</city><name>Ada</name>"), (11, "PLAIN text, that stands here!"), (12, None), (13, "other")] + [(i, "plain text that stands here") for i in range(100, 140)]
    got = {(r.doc, r.line): r.kind for r in overlap.overlaps(frame(spark, val, "doc"), "doc", frame(spark, train, "line"), "line").collect()}
    want = {(1, 10): "copy"} | {(d, i): "copy" for d in (2, 3) for i in (11, *range(100, 140))}
    assert got == want


def test_search_equals_brute_force():
    from loomcorpus.llm.collinear import Block, infix_distance, search

    for seed in range(60):
        rng = random.Random(seed)
        alphabet = rng.choice(["ab", "abcdefghijklmnopqrstuvwxyz0123456789", "木水火土金山河日月星辰风云雨雪春夏秋冬一二三四五六七八九十", "abc木水火"])
        rnd = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
        val = list(dict.fromkeys(rnd(rng.choice([1, 2, 3, 5, 8, 13, 30, 64, 65, 100, 200, 400, 900])) for _ in range(6)))
        train = list(dict.fromkeys(rnd(rng.randrange(300)) + edited(rng, rng.choice(val), rng.choice([0, 0.05, 0.1, 0.15, 0.2, 0.25])) + rnd(rng.randrange(300)) for _ in range(15)))
        most = [int(0.2 * len(v) + 1e-9) for v in val]
        want = {(i, j, d) for i, v in enumerate(val) for j, t in enumerate(train) if (d := infix_distance(v, t, most[i])) <= most[i]}
        assert set(search(Block(val, 0.2), train)) == want


def test_search_in_long_texts(monkeypatch):
    """Texts over the stretch are searched in parts; what stands across the border of two is found."""
    from loomcorpus.llm import collinear

    rng = random.Random(31)
    rnd = lambda n: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n))
    val = [rnd(n) for n in (40, 300, 700)]
    train = [rnd(2000 + 37 * k) + edited(rng, val[k % 3], 0.1) + rnd(3000) for k in range(9)] + [rnd(4000), "", val[1]]
    whole = set(collinear.search(collinear.Block(val, 0.2), train))
    monkeypatch.setattr(collinear, "STRETCH", 1000)
    monkeypatch.setattr(collinear, "AT_ONCE", 5000)
    assert set(collinear.search(collinear.Block(val, 0.2), train)) == whole and {(k % 3, k) for k in range(9)} | {(1, 11)} <= {(i, j) for i, j, _ in whole}
    assert collinear.search(collinear.Block([], 0.2), train) == [] and collinear.search(collinear.Block(val, 0.2), []) == []


def test_blocks_of_a_round_fit_beside_an_executor():
    """What a worker holds once the blocks of a round are prepared, and takes while it prepares one: half of 3,000 MB less a heap of 1,800."""
    import tracemalloc

    from loomcorpus.llm.collinear import Block

    rng = random.Random(41)
    texts = ["".join(rng.choices(a, k=n)) for n in (200, 800, 3000, 11000) for a in ("abcdefghijklmnopqrstuvwxyz", "木水火土金山河日月星辰风云雨雪春夏秋冬") for _ in range(300_000 // n)]
    block, letters = Block(texts, 0.2), sum(map(len, texts))
    tracemalloc.start()
    block.prepare()
    held, peak = (x / letters for x in tracemalloc.get_traced_memory())
    tracemalloc.stop()
    assert (held * overlap.ROUND + peak - held) * overlap.BLOCK < 600e6


def test_unrelated_texts_of_common_words_are_hardly_aligned(monkeypatch):
    """Long texts of the same few words go by their sections; what is near is found, be its edits spread or all in one section."""
    from loomcorpus.llm import collinear

    rng = random.Random(42)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(120)]
    val, train = (["".join(rng.choices(words, k=n)) for n in range(500, 700, 4)] for _ in range(2))
    rnd = lambda n: "".join(rng.choices("etaoinshrdlu", k=n))
    train += [train[0] + edited(rng, val[0], 0.15) + train[1], rnd(len(val[1]) // 6) + val[1][len(val[1]) // 6 :], val[2][:-600] + rnd(500), val[3][: len(val[3]) // 2] + rnd(900)]
    columns, distances = [], collinear._distances

    def counted(s, piece, other, a, z):
        columns.append(int((z - a).sum()))
        return distances(s, piece, other, a, z)

    monkeypatch.setattr(collinear, "_distances", counted)
    got = collinear.search(collinear.Block(val, 0.2), train)
    most = [int(0.2 * len(v) + 1e-9) for v in val]
    want = {(i, j, d) for i, v in enumerate(val) for j, t in enumerate(train) if (d := collinear.infix_distance(v, t, most[i])) <= most[i]}
    assert set(got) == want and {(0, 50), (1, 51)} <= {(i, j) for i, j, _ in want}
    assert sum(columns) < 100_000


def test_search_where_all_chains_fall_away(monkeypatch):
    from loomcorpus.llm import collinear

    none = collinear.np.zeros(0, collinear.np.int64)
    monkeypatch.setattr(collinear._Index, "candidates", lambda self, codes, lens: iter([(none,) * 4]))
    assert collinear.search(collinear.Block(["abcdefgh" * 9], 0.2), ["abcdefgh" * 9]) == []


def test_grams_count_only_where_the_whole_text_has_room():
    """Texts of the same few words give few candidates, for grams count on as many diagonals as there are edits and where all of the text fits."""
    from loomcorpus.llm import collinear

    rng = random.Random(43)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(120)]
    val, train = (["".join(rng.choices(words, k=n)) for n in range(60, 260, 2)] for _ in range(2))
    train.sort(key=len)
    block = collinear.Block(val, 0.2).prepare()
    codes, lens = collinear.np.concatenate([collinear.code_points(t) for t in train]), collinear.np.array([len(t) for t in train])
    assert sum(len(c[0]) for index in block.indexes for c in index.candidates(codes, lens)) < 20


def test_grams_looked_for_are_the_rarest_that_do_not_overlap():
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(300)]
    texts = ["".join(rng.choices(words, [1 / (k + 1) for k in range(300)], k=400))[: rng.randint(400, 1000)] for _ in range(60)]
    block = collinear.Block(texts, 0.2).prepare()
    (index,) = block.indexes
    counted = defaultdict(int)
    for t in texts:
        for h in collinear._hashes(collinear.code_points(t), 4).tolist():
            counted[h] += 1
    hits = own_hits = 0
    for k, (i, a, n) in enumerate(zip(block.text.tolist(), block.begin.tolist(), block.letters.tolist(), strict=True)):
        part = block.texts[i][a : a + n]
        all_of = collinear._hashes(collinear.code_points(part), 4)
        kept = sorted((index._base(slice(None))[index.own == index.which.tolist().index(k)]).tolist(), reverse=True)
        kept = [n - b for b in kept]  # where they begin
        assert all(y - x >= 4 for x, y in zip(kept, kept[1:], strict=False)) and kept[-1] <= n - 4
        assert len(kept) - block.edits[k] == index.need[index.which.tolist().index(k)] >= 2
        own_hits += sum(counted[int(all_of[x])] for x in kept)
        hits += sum(sorted(counted[int(h)] for h in all_of[::4])[: len(kept)])  # of as many side by side
    assert own_hits < 0.75 * hits


def test_near_at_the_ends_of_texts():
    """All edits at one end, where the other text ends; in texts of more letters than the numbers for room hold, too."""
    from loomcorpus.llm.collinear import Block, infix_distance, search

    rng = random.Random(44)
    rnd = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    for sizes, far in (((100, 511, 512, 1300, 2600), 300), ((700, 41000), 34000)):
        val = [rnd(n) for n in sizes]
        train = []
        for v in val:
            k = int(0.2 * len(v) + 1e-9)
            train += [v[k:], v[k + 1 :], v[:-k], v[: -k - 1], v[k // 2 : k // 2 - k], v[k:] + rnd(far), rnd(far) + v[:-k], rnd(far) + v[: -k - 1], rnd(far) + spaced(v, 5, "7")]
        most = [int(0.2 * len(v) + 1e-9) for v in val]
        want = {(i, j, d) for i, v in enumerate(val) for j, t in enumerate(train) if (d := infix_distance(v, t, most[i])) <= most[i]}
        assert set(search(Block(val, 0.2), train)) == want and len(want) >= 6 * len(val)

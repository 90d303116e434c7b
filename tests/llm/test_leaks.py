import random

import numpy as np

from arborix.llm import passages as P
from arborix.llm.leaks import leaks

RNG = random.Random(8)
WORDS = [f"w{i}" for i in range(400)]


def sentence(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = P.words(t)
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(i)
    return {(d, i) for d, t in docs for w in [P.words(t)] for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}


def test_runs_of_every_length_and_place(spark):
    items = [(i, " ".join(sentence(RNG.randrange(13, 90)))) for i in range(25)] + [(90, None), (91, ""), (92, "too short"), (93, "x " * 12)]
    docs = []
    for d in range(260):
        body = sentence(RNG.randrange(0, 120))
        w = P.words(RNG.choice(items[:25])[1])
        n = min(len(w), RNG.choice([5, 11, 12, 13, 14, 20, 40]))
        at, to = RNG.randrange(len(w) - n + 1), RNG.randrange(len(body) + 1)
        docs.append((d, " ".join(body[:to] + w[at : at + n] + body[to:])))
    docs += [(900, None), (901, ""), (902, "   "), (903, "ＦＵＬＬ_" + items[0][1].upper().replace(" ", "_")), (904, " ".join(sentence(30_000)) + " " + items[3][1]), (905, items[1][1]), (905, items[1][1])]
    t = spark.createDataFrame([(d, x, 1) for d, x in docs], "doc_id long, text string, item int")
    i = spark.createDataFrame([(k, x, "s") for k, x in items], "item_id long, item_text string, key string")
    rows = leaks(t, "doc_id", "text", i, "item_id", "item_text").collect()
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    got = {(r.doc_id, r.item_id) for r in rows if r.kind == "verbatim"}
    assert got == brute(docs, items) and (903, 0) in got and len(got) > 100
    again = {(r.doc_id, r.item_id) for r in leaks(t, "doc_id", "text", i, "item_id", "item_text", block=300).collect() if r.kind == "verbatim"}
    assert again == got


def test_empty_tables(spark):
    t, i = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, item_text string")
    one = spark.createDataFrame([(1, "a b c " * 9)], "item_id long, item_text string")
    for docs, items in ((t, i), (t, one), (one.toDF("doc_id", "text"), i)):
        assert leaks(docs, "doc_id", "text", items, "item_id", "item_text").count() == 0


def test_alignment_kernels():
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        r, run = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                eq = x == y and x >= 0
                t[i + 1][j + 1] = t[i][j] + 1 if eq else max(t[i][j + 1], t[i + 1][j])
                r[i + 1][j + 1] = r[i][j] + 1 if eq else 0
                run = max(run, r[i + 1][j + 1])
        return t[-1][-1], run

    rng = np.random.default_rng(0)
    a, b = rng.integers(-1, 6, (300, P.LENGTH)), rng.integers(-2, 6, (300, P.LENGTH))
    b[:50] = a[:50]
    s, r = P.longest(a.astype(np.int32), b.astype(np.int32))
    assert [(int(x), int(y)) for x, y in zip(s, r)] == [lcs(x, y) for x, y in zip(a, b)]


def test_every_run_lies_in_a_window():
    for n in range(13, 75):
        w, owner = P.windows(np.arange(n, dtype=np.int32), np.array([0]), np.array([n]), P.STEP, P.RUN)
        assert set(owner) == {0}
        for s in range(n - 12):
            assert any(set(range(s, s + 13)) <= set(row) for row in w.tolist())


def test_runs_of_common_words_between_rare_ones(spark):
    rng = random.Random(1)
    common = [f"c{i}" for i in range(40)]
    items = [(i, " ".join([*(f"r{i}x{k}" for k in range(7)), *rng.sample(common, 13), *(f"r{i}y{k}" for k in range(7))])) for i in range(60)]
    docs = [(d, " ".join(rng.choices(common, k=60))) for d in range(300)]
    for i, t in items:
        rare = P.words(items[(i + 1) % len(items)][1])
        docs.append((1000 + i, " ".join([*rare[:7], *P.words(t)[7:20], *rare[20:]])))
    t, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    got = {(r.doc_id, r.item_id) for r in leaks(t, "doc_id", "text", i, "item_id", "item_text").collect() if r.kind == "verbatim"}
    assert got == brute(docs, items) and len(got) >= 60
    # the word pairs alone find every run, whatever the cosine
    got = {(r.doc_id, r.item_id) for r in leaks(t, "doc_id", "text", i, "item_id", "item_text", threshold=2.0).collect() if r.kind == "verbatim"}
    assert got == brute(docs, items)


def test_pieces_hold_every_passage():
    for n in (1, 40, 99, 100, 101, 160, 161, 500):
        starts, lengths, owner = P.pieces(np.array([0, 7]), np.array([n, 0]), 100)
        assert owner.tolist()[-1] == 1 and lengths.max() <= 100 and lengths.min() >= 0
        for s in range(max(1, n - 39)):
            assert any(a <= s and min(s + 40, n) <= a + k for a, k, o in zip(starts, lengths, owner) if o == 0)


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def paraphrased(docs, items, least=16):
    """The longest subsequence of all windows of 20 words at every place where the telling words are answered."""
    out = {}
    for d, t in docs:
        for k, u in items:
            x, y = P.words(t), P.words(u)
            for i in range(max(1, len(x) - 19)):
                for j in range(max(0, len(y) - least + 1)):
                    a, b = x[i : i + 20], y[j : j + 20]
                    if sum(w in b for w in a) >= least and (n := subsequence(a, b)) >= least and all(w in a for w in b if any(c.isdigit() for c in w)):
                        out[d, k] = max(out.get((d, k), 0), n)
    return out


def test_paraphrases_at_every_offset(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(300)]
    items = [(0, " ".join(rng.sample(words, 90)))] + [(k, " ".join([*rng.sample(words, n - 1), "n17"])) for k, n in enumerate((13, 16, 18, 20, 23, 40), 1)]
    docs, long = [], P.words(items[0][1])
    for every in (6, 8, 10, 12):
        for offset in range(8):
            passage = [f"z{'abcdefghij'[n % 10]}q" if n % every == 0 else w for n, w in enumerate(long[4:76], 1)]
            docs.append((len(docs), " ".join([*rng.choices(words, k=24 + offset), *passage, *rng.choices(words, k=9)])))
    for _ in range(120):
        w = P.words(rng.choice(items)[1])
        n = rng.randrange(min(16, len(w)), min(len(w), 30) + 1)
        at = rng.randrange(len(w) - n + 1)
        part = w[at : at + n]
        for _ in range(rng.randrange(0, 6)):
            spot = rng.randrange(len(part) + 1)
            part[spot : spot + rng.randrange(2)] = rng.choices(words, k=rng.randrange(2))
        docs.append((len(docs), " ".join([*rng.choices(words, k=rng.randrange(12)), *part, *rng.choices(words, k=rng.randrange(12))])))
    t, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    rows = leaks(t, "doc_id", "text", i, "item_id", "item_text").collect()
    want, verbatim = paraphrased(docs, items), brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in rows} == set(want) | verbatim and len(set(want) - verbatim) > 40
    assert all((d, 0) in want for d in range(32))
    assert {(r.doc_id, r.item_id): r.longest_subsequence for r in rows if r.kind == "paraphrase"} == {k: n for k, n in want.items() if k not in verbatim}
    for least in (15, 13):
        rows = leaks(t, "doc_id", "text", i, "item_id", "item_text", threshold=2.0, paraphrase=least).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == set(paraphrased(docs, items, least)) | verbatim


def test_run_lengths_are_whole(spark):
    rng = random.Random(5)
    items = [(k, " ".join(rng.sample(WORDS, n))) for k, n in enumerate((13, 40, 90, 300))]
    docs = [(k, " ".join([*sentence(rng.randrange(30)), *P.words(t), *sentence(7)])) for k, t in items] + [(9, " ".join(sentence(19_900) + P.words(items[3][1])))]
    t, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    got = {(r.doc_id, r.item_id): r.longest_run for r in leaks(t, "doc_id", "text", i, "item_id", "item_text").collect()}
    assert [got[k, k] for k in range(4)] == [13, 40, 90, 300] and got[9, 3] == 300


def test_recall_of_planted_rewrites(spark):
    """Items rewritten with a word in twelve replaced, left out or put in, at any place of a text of the same words."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(900)]
    items = [(k, " ".join(rng.sample(words, 60))) for k in range(40)]
    docs = []
    for d in range(200):
        part = P.words(items[d % 40][1])
        at = rng.randrange(20)
        part = [x for w in part[at : at + 40] for x in (rng.choice([[], [rng.choice(words)], [w, rng.choice(words)]]) if rng.random() < 1 / 12 else [w])]
        docs.append((d, " ".join([*rng.choices(words, k=rng.randrange(60)), *part, *rng.choices(words, k=rng.randrange(60))])))
    t, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    got = {(r.doc_id, r.item_id) for r in leaks(t, "doc_id", "text", i, "item_id", "item_text").collect()}
    found = sum((d, d % 40) in got for d in range(200))
    print("rewrites found", found, "others", len(got) - found)
    assert found >= 180 and len(got) - found <= 2


def test_verbatim_alone(spark):
    rng = random.Random(6)
    items = [(k, " ".join(rng.sample(WORDS, 40))) for k in range(20)]
    docs = [(d, " ".join([*sentence(20), *P.words(items[d % 20][1])[: rng.randrange(8, 40)], *sentence(9)])) for d in range(80)]
    t, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    got = [(r.doc_id, r.item_id, r.kind) for r in leaks(t, "doc_id", "text", i, "item_id", "item_text", reworded=False).collect()]
    assert {x[:2] for x in got} == brute(docs, items) and {x[2] for x in got} == {"verbatim"} and len(got) == len({x[:2] for x in got})


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-2, 90, (400, P.LENGTH)).astype(np.int32), rng.integers(-2, 70, (400, P.LENGTH)).astype(np.int32)
    a[:60] = b[:60]
    a[30:60, :6] = 80
    x, y = np.divmod(np.arange(400 * 400), 400)
    want = set(P.sharing(np.where((a >= 0) & (a < 70), a, -1)[x], np.where(b >= 0, b, P.PAD)[y], 13).tolist())
    got = set(P.promising(P.marks(a, 70), x, P.signatures(P.marks(b, 70))[y], 13).tolist())
    assert want and want <= got and len(got) < 400 * 400 / 5

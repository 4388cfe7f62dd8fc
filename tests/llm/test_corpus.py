import random

import pytest

from tallymark.llm.leakage import Matcher, leaks, myers
from tallymark.llm.mixing import n_tokens, pick, plan, short_sources, token_counts
from tallymark.llm.toxicity import fit_chain, fitted, scored

R = random.Random(11)
VOCABULARY = [f"{a}{b}" for a in ("lor", "ban", "tik", "sum", "ger", "pol", "vek", "nar") for b in ("am", "eth", "ino", "urs", "ock", "ily", "ent", "ax")]


def prose(n, r=R):
    return [r.choice(VOCABULARY) for _ in range(n)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_bit_parallel_distance():
    for _ in range(200):
        a, b = [R.choice("abc") for _ in range(R.randrange(0, 70))], [R.choice("abc") for _ in range(R.randrange(0, 40))]
        assert myers(a, b) == distance(a, b)


ITEMS = [(k, " ".join(prose(32))) for k in range(30)]


def found(text):
    return {k for k, _ in Matcher(ITEMS).leaks(text)}


def test_forms_of_a_leak():
    for k, t in ITEMS:
        w = t.split()
        other = " ".join(prose(40))
        swapped = [x if i % 8 != 5 else "zzz" for i, x in enumerate(w)]
        for text in (t, t.upper(), f"{other} {t} {other}", "> " + " \n> ".join(w), " ".join(swapped), f"{other} {' '.join(w[:18])} {other}", f"{' '.join(w[:9])} {other} {' '.join(w[9:19])}", t.replace("a", "а"), "**" + "** **".join(w) + "**"):
            assert k in found(text), text
        assert k not in found(" ".join(w[4:10])) and k not in found(other) and k not in found(" ".join(R.sample(w, 32)))


def test_halves_around_a_rewritten_stretch():
    for k, t in ITEMS:
        w = t.split()
        for text in (w[:12] + [f"q{i}" for i in range(6)] + w[18:], w[:5] + ["q1", "q2", "q3"] + w[8:17] + [f"q{i}" for i in range(9)] + w[26:]):
            assert k in found(" ".join(text)), text
        assert k not in found(" ".join([*w[:5], *(f"q{i}" for i in range(12)), *w[17:22]]))


def test_many_chains_and_passages_at_once():
    k, t = ITEMS[0]
    w = t.split()
    # The same four words again and again between the halves: more passages than were tried before.
    assert k in found(" ".join(w[:9] + [x for i in range(12) for x in (*w[20:24], f"q{i}")] + w[22:32]))


def test_pieces_of_short_items_and_passages():
    r = random.Random(5)
    for n in range(4, 15):
        for _ in range(40):
            w = prose(n, r)
            m = Matcher([(1, " ".join(w))])
            kept = w if n < 8 else w[(a := r.randrange(n - -(-n // 2) + 1)) : a + -(-n // 2)]
            bad = list(kept)
            bad[r.randrange(len(bad))] = "zzz"
            for passage in (kept, bad):
                assert m.leaks(" ".join([*prose(20, r), *passage, *prose(20, r)])), (w, passage)
            if n < 8:
                assert not m.leaks(" ".join(w[: n // 2])) and not Matcher([(1, " ".join(w[:3]))]).leaks(" ".join([*w[:2], "zzz"]))


def test_two_passages_with_errors_at_every_place():
    r = random.Random(9)
    missed = tried = 0
    for n in (14, 18, 24, 32, 40):
        for _ in range(60):
            w = prose(n, r)
            a = r.randrange(2, n // 2 - 1)
            first, second = w[:a], w[n - (-(-n // 2) - a) :]
            if r.random() < 0.5:
                longer = first if len(first) > len(second) else second
                longer[r.randrange(len(longer))] = "zzz"
            tried += 1
            missed += not Matcher([(1, " ".join(w))]).leaks(" ".join([*prose(9, r), *first, *prose(30, r), *second, *prose(9, r)]))
    assert missed <= 0.1 * tried


def test_leaks_agree_in_blocks(spark):
    docs = [(i, " ".join(prose(30)) + " " + ITEMS[i % 30][1]) for i in range(40)] + [(90, None), (91, ""), (92, "x " * 200_000), (1, ITEMS[1][1])]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([*ITEMS, (77, None), (78, ""), (79, "only five words are here")], "item_id bigint, text string")
    one = {(r.doc_id, r.item_id) for r in leaks(d, i).collect()}
    assert one == {(r.doc_id, r.item_id) for r in leaks(d, i, block_chars=900).collect()} and {(k, k % 30) for k in range(40)} <= one
    assert len(one) == leaks(d, i).count()
    assert leaks(d.limit(0), i).count() == 0 and leaks(d, i.limit(0)).count() == 0


@pytest.fixture(scope="module")
def counts(spark):
    rows = [(k, "big" if k % 3 else "small" if k % 9 else None, 100 + k % 7) for k in range(3000)] + [(9001, " ", 5), (9002, "untargeted", 500)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


def test_mix(spark, counts):
    targets = spark.createDataFrame([("big", 0.55, 1), ("small", 0.4, 2), ("absent", 0.05, 3)], "source string, target_share double, max_repeats int")
    p = {r.source: r for r in plan(counts, targets).collect()}
    picked = pick(counts, targets).collect()
    for s in ("big", "small"):
        own = [r for r in picked if r.source == s]
        expected = p[s].rate * p[s].n_documents
        assert abs(sum(r.copies for r in own) - expected) < 1 + 1e-6
        assert max(r.copies for r in own) <= p[s].max_repeats and len({r.doc_id for r in own}) == len(own)
        got = sum(r.copies * r.n_tokens for r in own)
        assert abs(got - min(p[s].wanted_tokens, p[s].n_tokens * p[s].max_repeats)) < 0.02 * got
    assert p["absent"].rate == 0 and not [r for r in picked if r.source not in ("big", "small")]
    assert picked == pick(counts, targets).collect() or sorted(picked) == sorted(pick(counts, targets).collect())
    assert pick(counts.limit(0), targets).count() == 0 and plan(counts.limit(0), targets).count() == 3 and pick(counts, targets.limit(0)).count() == 0


def test_short_sources_of_the_drawn_mix(spark, counts):
    r = random.Random(11)
    rows = [(k, f"s{k % 40}", r.randrange(1, 200)) for k in range(2000)] + [(5000, "blank", 0), (5001, "blank", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    total, own = sum(n for *_, n in rows), {}
    for _, s, n in rows:
        own[s] = own.get(s, 0) + n
    # Shares close to what the cap allows, on both sides of it and at it.
    targets = [(f"s{k}", own[f"s{k}"] * (1 + k % 5) * (0.5, 0.995, 1.0, 1.005, 1.5, 0.999999, 1.000001)[k % 7] / total, 1 + k % 5) for k in range(40)]
    want = {s for s, share, cap in targets if own[s] * cap < share * total} | {"blank", "absent", "uncapped and absent"}
    targets += [("blank", 0.1, 2), ("absent", 0.1, 1), ("uncapped and absent", 0.1, None), ("nothing wanted", 0.0, 1), ("s3", *targets[3][1:])]
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    for seed in (7, 8):
        got = [x.source for x in short_sources(df, t, seed).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert "Window" in short_sources(df, t)._jdf.queryExecution().toString()  # the sums of the drawing
    free = spark.createDataFrame([("big", 2.5, None), ("small", 0.0, 0)], t.schema)
    assert short_sources(counts, free).count() == 0 and pick(counts, free.union(free)).where("source = 'big'").count() == 2000


def test_tokens(spark):
    assert n_tokens(None) == n_tokens("") == 0 and n_tokens("a b c") >= 3 and n_tokens("<|endoftext|>") > 1
    df = spark.createDataFrame([(1, "s", "hello there"), (2, None, None), (3, "s", "x " * 100_000)], "doc_id bigint, source string, text string")
    assert {r.doc_id: r.n_tokens > 0 for r in token_counts(df).collect()} == {1: True, 2: False, 3: True}


NASTY = ["you utter gribble go rot in your ditch", "those snarfs are plague and must be chased out", "she peeled off every zib and flarped all night"]
KINDS = ["abuse", "hate", "sexual"]


def labelled(n, r):
    texts, labels, truth = [], [], []
    for _ in range(n):
        k = r.randrange(8)
        w = [" ".join(prose(12, r)) for _ in range(6)]
        if k < 3:
            s = NASTY[k] if r.random() < 0.7 else NASTY[k].replace("i", "1").replace("a", "@").upper()
            w.insert(r.randrange(6), s)
        label = KINDS[k] if k < 3 else "none"
        if r.random() < 0.04:
            label = "none" if k < 3 else r.choice(KINDS)
        texts.append(". ".join(w))
        labels.append(label)
        truth.append(k < 3)
    return texts, labels, truth


def test_held_out_accuracy():
    r = random.Random(2)
    texts, labels, _ = labelled(700, r)
    chain = fit_chain(texts, labels)
    texts, labels, truth = labelled(400, r)
    s = [chain.score(t) for t in texts]
    hit = [x[-1] >= chain.threshold for x in s]
    right = sum(a == b for a, b in zip(hit, truth, strict=True))
    assert right >= 0.97 * len(truth)
    assert chain.score(None) == chain.score("") == (0.0,) * 4 and all(0 <= x <= 1 for x in chain.score("word " * 100_000))


def test_no_labels_and_rows(spark):
    d = spark.createDataFrame([(1, "s", "a text", 0.5), (2, None, None, None), (3, "s", "", 1.0)], "doc_id bigint, source string, text string, score double")
    none = spark.createDataFrame([], "doc_id bigint, label string, rater string")
    some = spark.createDataFrame([(1, "none", "r"), (1, "abuse", "q"), (1, None, "p")], "doc_id bigint, label string, rater string")
    for labels in (none, some):
        got = scored(d, fitted(d, labels)).collect()
        assert {(r.doc_id, r.score, r.toxic) for r in got} == {(1, 0.0, False), (2, 0.0, False), (3, 0.0, False)}

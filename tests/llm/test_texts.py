import random
import re

import pytest
from pyspark.sql import functions as F

from ionloom.llm import leakage, mixing, objectionable, shingles
from ionloom.llm.text import tokens

WORDS = [f"w{i}" for i in range(400)]


def item(seed, n=40):
    return random.Random(seed).sample(WORDS, n)


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): (r["words"], r["changed"]) for r in leakage.leaks(d, i, "doc_id", "text", "item_id", "text", **kw).collect()}


def test_passages_whole_part_changed_and_disguised(spark):
    a, b = item(1), item(2)
    fill = " ".join(random.Random(9).choices(["alpha", "beta", "gamma", "delta"], k=60))
    changed = a[:30]
    changed[7], changed[21] = "xx", "yy"
    added = [*b[5:15], "zz", *b[15:30]]
    left_out = b[:12] + b[13:28]
    docs = [
        (1, f"{fill} {' '.join(a)} {fill}"),
        (2, f"{fill} {' '.join(a[10:24])}"),
        (3, f"{' '.join(a[10:23])} {fill}"),
        (4, " ".join(changed)),
        (5, " ".join(added)),
        (6, " ".join(left_out)),
        (7, "\n".join(f"<b>{w.upper()}</b>," if k % 3 else f"_{w[0]}­{w[1:]}_" for k, w in enumerate(a[3:30]))),
        (8, " ".join(a[i] if i % 4 else "q" for i in range(40))),
        (9, None), (10, ""), (11, fill * 200), (12, " ".join(a + b)), (12, " ".join(a + b)),
        (13, " ".join(sorted(a))),
    ]
    got = leaks(spark, docs, [(100, " ".join(a)), (200, " ".join(b)), (300, None), (400, "too short")])
    assert set(got) == {(1, 100), (2, 100), (4, 100), (5, 200), (6, 200), (7, 100), (12, 100), (12, 200)}
    assert got[(2, 100)] == (14, 0) and got[(4, 100)] == (30, 2) and got[(5, 200)][1] == 1
    assert leaks(spark, docs, [(100, " ".join(a)), (200, " ".join(b))]) == got
    assert leaks(spark, [], [(1, " ".join(a))]) == {} and leaks(spark, docs, []) == {}


def every_passage(item, doc, share=0.15, least=14):
    """(words, changes) of the longest sufficient passage, by trying every place where one may begin and end."""
    best = None
    for i, first in enumerate(item):
        for j in [j for j, w in enumerate(doc) if w == first]:
            row = list(range(len(doc) - j))
            for a in range(i + 1, len(item)):
                new = [row[0] + 1]
                for b in range(j + 1, len(doc)):
                    same = item[a] == doc[b]
                    new.append(min(row[b - j - 1] + (not same), row[b - j] + 1, new[-1] + 1))
                    n, c = a - i + 1, row[b - j - 1]
                    if same and n >= least and c <= round(n * share) and (best is None or (n, -c) > (best[0], -best[1])):
                        best = (n, c)
                row = new
    return best


def test_search_loses_nothing_against_every_passage(spark):
    r = random.Random(11)
    items = [(k, item(k + 50)) for k in range(8)]
    docs = []
    for n in range(48):
        words = r.choices(WORDS, k=30)
        if n % 4:
            src = list(items[n % 8][1])
            cut = src[r.randrange(10) :][: r.randrange(13, 30)]
            for _ in range(r.randrange(0, max(1, len(cut) // 6) + 1)):
                at = r.randrange(1, len(cut) - 1)
                cut[at : at + r.randrange(2)] = [r.choice(["new", "other"])] if r.random() < 0.7 else []
            words[10:10] = cut
        docs.append((n, " ".join(words)))
    want = {(d, k): got for d, text in docs for k, words in items if (got := every_passage(words, tokens(text)))}
    assert leaks(spark, docs, [(k, " ".join(w)) for k, w in items]) == want and len(want) > 20


@pytest.mark.parametrize("verbatim", [14, 16])
def test_a_whole_passage_before_a_spoilt_rest(spark, verbatim):
    """The rest, in which every fifth word is changed, must not spoil the passage before it."""
    words = item(5, 90)
    text = [w if k < verbatim or (k - verbatim) % 5 else "changed" for k, w in enumerate(words)]
    got = leaks(spark, [(1, " ".join(text))], [(7, " ".join(words))])
    assert got[(1, 7)][0] >= verbatim and set(got) == {(1, 7)}


def test_one_long_tag_and_a_document_of_every_item(spark):
    items = [(k, item(k, 30)) for k in range(leakage.ITEMS_A_CALL + 20)]
    a = items[0][1]
    tag = f'<a href="https://example.org/{"/x y" * 80}">'
    docs = [(1, " ".join([*a[:8], tag, *a[8:16], "</a>"])), (2, " ".join(w for _, i in items for w in i)), (2, "nothing")]
    got = leaks(spark, docs, [(k, " ".join(w)) for k, w in items])
    assert got[(1, 0)] == (16, 0) and {k for d, k in got if d == 2} == {k for k, _ in items}


def test_hashed_shingles_are_those_of_the_words():
    import numpy as np

    texts = ["A b-c d_e", None, "", "x y", "Ärger ÄRGER straße STRASSE ﬁt", "one <b>two</b> three four " * 3, "1 2 3"]
    seen = {}
    for of, at, h in shingles.shingle_hashes(texts):
        for n, k, x in zip(of.tolist(), at.tolist(), h.tolist(), strict=True):
            seen[n, k] = x
    want = {(n, k): tuple(w[k : k + 3]) for n, t in enumerate(texts) if t is not None for w in [tokens(t)] for k in range(len(w) - 2)}
    assert set(seen) == set(want)
    assert len(set(seen.values())) == len(set(want.values())) == len(set(zip(seen.values(), (want[k] for k in seen), strict=True)))
    f = shingles.Filter(16)
    h = np.array(list(seen.values()), dtype=np.uint64)
    for p in f.places(h):
        np.bitwise_or.at(f.words, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
    assert f.held(h).all() and f.held(np.random.default_rng(1).integers(0, 2**63, 10_000).astype(np.uint64)).mean() < 0.01


def test_too_many_changes_are_refused():
    with pytest.raises(ValueError):
        leakage.least_kept(14, 0.34)


def test_mix_meets_budgets_without_sorting(spark):
    r = random.Random(3)
    rows = [(k, " ".join(["tissue"] * r.randrange(1, 60)), r.choice([" Lab Notes", "lab_notes", "LAB-NOTES"])) for k in range(600)]
    rows += [(1000 + k, "tissue section " * 3, "chat ") for k in range(30)] + [(2000, None, "chat"), (2001, "", "chat"), (2002, "x y", None), (2003, "x", "unlisted")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    targets = spark.createDataFrame([("lab_notes", 0.5, 2), ("chat", 0.4, 3), ("glossary", 0.1, 5)], "source string, target_share double, max_repeats int")
    mix = mixing.Mix(df, targets, "doc_id", "text", "source")
    shares = {x["source"]: x for x in mix.shares().collect()}
    docs = mix.documents().groupBy("source").agg(F.sum(F.expr("n_tokens * copies")).alias("t"), F.max("copies").alias("most"), F.count_distinct("doc_id").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    by = {x["source"]: x for x in docs}
    assert set(by) == {"lab_notes", "chat"}
    for s, x in by.items():
        assert x["t"] == shares[s]["reached_tokens"] <= shares[s]["budget_tokens"] and x["most"] <= shares[s]["max_repeats"] and x["n"] == x["rows"]
    lab = shares["lab_notes"]
    assert lab["budget_tokens"] - lab["reached_tokens"] <= 130 and not lab["short"]
    assert by["chat"]["most"] == 3 and shares["chat"]["short"] and shares["glossary"]["reached_tokens"] == 0
    assert sum(x["reached_share"] for x in shares.values()) == pytest.approx(1)
    smaller = {x["doc_id"] for x in mixing.Mix(df, targets, "doc_id", "text", "source", total=mix.total // 3).documents().where("source = 'lab_notes'").collect()}
    assert smaller < {x["doc_id"] for x in mix.documents().where("source = 'lab_notes'").collect()}
    empty = mixing.Mix(df.limit(0), targets, "doc_id", "text", "source")
    assert empty.documents().count() == 0 and all(x["reached_tokens"] == 0 for x in empty.shares().collect())


BAD = ["Shut up, you stupid {c}, nobody asked about {x}.", "I will break your fingers if you touch {x}.", "Du bist ein dreckiges Schwein und gehörst auf den Müll.", "Send me nudes from the {x} tonight, I am so horny.", "Ferme ta gueule, espèce de connard.", "Eres un inútil de mierda y nadie te quiere."]
GOOD = ["We killed worker {n} after the {x} stage.", "Dead pixels in column {n} make the {x} look sparse.", "The section was taken from a nude mouse, {x} is clean.", "Charge {n} was assumed near {x}.", "Der tote Bildpunkt in Spalte {n} stört die Karte.", "Could you attach the {x} and the first {n} lines?"]


def corpus(n, seed):
    r = random.Random(seed)
    fill = lambda t: t.format(c=r.choice(["cow", "idiot", "pig"]), x=r.choice(["map", "list", "scan"]), n=r.randrange(99))
    out = []
    for k in range(n):
        parts = [fill(r.choice(GOOD)) for _ in range(r.randrange(1, 9))]
        bad = k % 4 == 0
        if bad:
            parts.insert(r.randrange(len(parts) + 1), fill(r.choice(BAD)))
        out.append((k, " ".join(parts), int(bad)))
    return out


def test_classifier_on_held_out_texts(spark):
    train, held = corpus(400, 1), corpus(400, 2)
    noisy = [(i, 1 - y if i % 25 == 0 else y) for i, _, y in train]
    df = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id int, text string")
    labels = spark.createDataFrame(noisy, "doc_id int, objectionable int")
    scorer = objectionable.fit(df, labels, "doc_id", "text", "objectionable")
    score = scorer.score([t for _, t, _ in held])
    assert ((score >= 0, score <= 1)) and all(0 <= s <= 1 for s in score)
    hits = [(s >= 0.4, y) for s, (_, _, y) in zip(score, held, strict=True)]
    assert sum(f and y for f, y in hits) / 100 > 0.95 and sum(f and not y for f, y in hits) < 10
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x " * 200_000, None), (4, "Shut up, you s t u p i d cow", "b"), (4, "Shut up, you s t u p i d cow", "b")], "doc_id int, text string, score_source string")
    rows = objectionable.scored(odd, scorer, "doc_id", "text", ("score_source",)).collect()
    assert len(rows) == 5 and {r["doc_id"] for r in rows if r["score"] >= 0.4} == {4}
    assert objectionable.scored(odd.limit(0), scorer, "doc_id", "text").count() == 0


def test_evasive_spellings_and_neutral_words():
    evidence = lambda t: objectionable.text_features(t)[objectionable.N_SENTENCE - 1]
    for t in ("you s t u p i d cow", "you st​upid cow", "you i***t", "you stu.pid thing", "you sttttupid coooow", "du Sсhwеin", "you 1d1ot"):
        assert evidence(t) > 2, t
    for t in ("killed worker 4, child exited", "The section was logged as sex: male", "We attack the ester bond"):
        assert evidence(t) < 1.5, t


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(k, 0) for k in range(30)]])
def test_nothing_to_learn_from_gives_null_scores(spark, labels):
    said = spark.createDataFrame(labels, "doc_id int, objectionable int")
    docs = spark.createDataFrame([(k, f"Shut up, you stupid pig {k}") for k in range(30)], "doc_id int, text string")
    scorer = objectionable.fit(docs, said, "doc_id", "text", "objectionable")
    assert {r["score"] for r in objectionable.scored(docs, scorer, "doc_id", "text").collect()} == {None}


def test_phrases_are_found_only_from_their_first_words_on():
    """Trying each phrase where its first word stands finds what trying it everywhere finds."""
    r = random.Random(4)
    words = sorted({w for _, p, _ in objectionable._PHRASES for w in re.findall("[a-z]{2,}", p.pattern)} | {"i", "a"})
    for _ in range(300):
        text = r.choices(words, k=12)
        text[3:3] = r.choice(["shut up", "i will break your", "they lie and steal from birth", "you are dead", "strip for me", "wie dich", "eres un"]).split()
        flat = " ".join(text)
        got = objectionable.phrases(text, [objectionable.about(w) for w in text])
        for kind, n in got.items():
            assert (n > 0) == any(re.search(r"\b" + p.pattern, flat) for k, p, _ in objectionable._PHRASES if k == kind), (kind, flat)


def test_letters_set_apart():
    for text, words in (("a s t u p i d c o w like you", {"stupid", "cow"}), ("you are s u b h u m a n", {"subhuman"}), ("f*u*c*k this", {"fuck"}), ("f i l t h", {"filth"}), ("$ubhum4n lot", {"subhuman"})):
        shown = objectionable.reveal(text)
        assert {w for w in re.findall(r"\w+(?=" + objectionable._MARK + ")", shown)} == words, shown
    for text in ("R E S U L T S of the run", "m / z 4 5 6", "a b c d e", "see A.B.C. and U-S-A"):
        assert objectionable.reveal(text) == text


def test_isotonic_is_monotone():
    import numpy as np

    x = np.array([3.0, 1.0, 2.0, 5.0, 4.0])
    at, p = objectionable.isotonic(x, np.array([0, 0, 1, 1, 1.0]))
    assert list(p) == sorted(p) and list(at) == sorted(at) and p[-1] == 1 and p[0] == 0


def test_learned_densities():
    import numpy as np

    from ionloom.llm import densities

    r = random.Random(9)
    words = [f"word{chr(97 + k)}" for k in range(26)]
    texts = [" ".join([*r.choices(words, k=40), *(["vile", "slur"] if k % 5 == 0 else []), *r.choices(words, k=10)]) for k in range(200)]
    y = np.array([k % 5 == 0 for k in range(200)], dtype=float)
    of, bucket = densities.presence(texts[:100])
    every, at = np.unique(bucket, return_inverse=True)
    table = densities.weights(every, np.bincount(at, y[:100][of]), np.bincount(at, 1 - y[:100][of]), int(y[:100].sum()), int((1 - y[:100]).sum()))
    x = densities.described([*texts[100:], None, "", "unseen things only", texts[0].upper().replace("VILE", "<b>ViLe</b>,")], table)
    assert x.shape == (104, 3) and (x[100] == 0).all() and (x[101] == 0).all() and abs(x[102]).max() == 0
    for column in x.T:
        assert column[:100][y[100:] == 1].min() > column[:100][y[100:] == 0].max() and column[103] > column[:100][y[100:] == 0].max()
    # The same however the texts are cut into lots.
    one = np.vstack([densities.described([t], table) for t in texts[100:]])
    assert np.allclose(one, x[:100])


def test_a_label_without_any_listed_word_is_learned(spark):
    """Texts that only a word outside all lists tells apart."""
    make = lambda n, seed: [(k, " ".join(random.Random(seed * 1000 + k).choices(["map", "scan", "list", "file"], k=30) + (["glorptastic"] if k % 4 == 0 else [])), int(k % 4 == 0)) for k in range(n)]
    train, held = make(200, 1), make(80, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in train], "doc_id int, text string")
    scorer = objectionable.fit(docs, spark.createDataFrame([(i, y) for i, _, y in train], "doc_id int, objectionable int"), "doc_id", "text", "objectionable")
    score = scorer.score([t for _, t, _ in held])
    assert all((s >= 0.4) == bool(y) for s, (_, _, y) in zip(score, held, strict=True))

import zlib

import pytest

from collonade.llm import quality, toxicity


def held(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def by_id(r):
    return -1 if r.doc_id is None else r.doc_id


@pytest.mark.parametrize("operator, label", [(quality, "quality"), (toxicity, "toxic")])
def test_every_row_has_a_score(odd, nothing, labels, operator, label):
    got = operator.digests(odd, operator.learn(odd, labels)).collect()
    assert len(got) == odd.count()
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) and r.predicted in (0, 1) for r in got)
    by_text = {}
    for r, t in zip(sorted(got, key=by_id), sorted(odd.collect(), key=by_id), strict=True):
        assert by_text.setdefault(t.text or "", r.score) == r.score
    assert operator.digests(nothing, operator.learn(nothing, labels)).count() == 0
    none = operator.digests(odd, operator.learn(odd, labels.limit(0))).collect()
    assert {r.predicted for r in none} == ({1} if operator is quality else {0})


@pytest.mark.parametrize("operator, label, hits, keeps", [(quality, "quality", 0.9, 0.97), (toxicity, "toxic", 0.8, 0.97)])
def test_held_out_accuracy(spark, data, operator, label, hits, keeps):
    d = data.replace("0.001", "0.01")
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = operator.digests(docs, operator.learn(docs, marks)).join(marks, "doc_id").where("held_out").select(label, "predicted").collect()
    bad, good = (0, 1) if label == "quality" else (1, 0)
    assert sum(r[1] == bad for r in rows if r[0] == bad) >= hits * sum(r[0] == bad for r in rows)
    assert sum(r[1] == good for r in rows if r[0] == good) >= keeps * sum(r[0] == good for r in rows)


def test_disguised_words_are_restored(spark):
    text = "you are an idiot and stupid . what a pathetic moron and loser said the clown . "
    grams = toxicity.count_trigrams(spark.createDataFrame([(text * 200,), (None,), ("",)], "text string"))
    channel = toxicity.Channel(grams)
    for shown, word in [("1d10t", "idiot"), ("$tup1d", "stupid"), ("m0r0n", "moron"), ("l0$er!", "loser"), ("i d i o t", "idiot"), ("p.a.t.h.e.t.i.c", "pathetic"), ("stuuupiiid", "stupid"), ("IDIOT,", "idiot")]:
        assert word in channel.words(f"so {shown} it is"), shown
    assert channel.words("a plain idea") == {"a", "plain", "idea"}
    assert channel.words("") == set()


def test_preference_weights_rank():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = (x @ [2.0, -1.0, 0.0] + rng.normal(0, 0.3, 400) > 0).astype(int)
    w = quality.rank(x, y)
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.3 * w[0]


def test_cut_is_the_quantile_of_all_documents(spark):
    import random

    rng = random.Random(6)
    names = [f"word{i}" for i in range(400)]
    # Labels that the statistics tell only in part, and unlabelled documents that are worse than the labelled ones.
    poor = lambda share: " ".join("## $$" if rng.random() < share else rng.choice(names) for _ in range(60))
    rows = [(i, poor(rng.uniform(0.0, 0.2)), int(i % 5 > 0)) for i in range(400)]
    marks = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000 + i, poor(rng.uniform(0.1, 0.9))) for i in range(600)], "doc_id bigint, text string")
    got = quality.digests(docs, quality.learn(docs, marks)).collect()
    share = sum(y == 0 for i, _, y in rows if not held(i)) / sum(not held(i) for i, _, _ in rows)
    assert len(got) == 1000
    assert abs(sum(r.predicted == 0 for r in got) / 1000 - share) <= 0.005


def disguised(word, way):
    if way == "leet":
        return word.translate(str.maketrans("oeais", "03415"))
    if way == "spaced":
        return "\t ".join(word)
    return "".join(c * (4 if i % 2 else 1) for i, c in enumerate(word))


def test_restoring_alone_flips_predictions(spark, data, monkeypatch):
    """Held-out toxic texts with their insults disguised are caught, and without restoring they are not."""
    import re

    d = data.replace("0.001", "0.01")
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.learn(docs, marks)
    insults = {f for f, w in model["weights"].items() if "~" not in f and w > 0.5}
    held_texts = [r.text for r in docs.join(marks.where("toxic = 1"), "doc_id").collect() if held(r.doc_id) and insults & set(re.findall(r"[a-z]+", r.text.lower()))]
    assert len(held_texts) >= 3
    rows = []
    for i, t in enumerate(held_texts * 3):
        way = ("leet", "spaced", "repeated")[i // len(held_texts)]
        rows.append((i, re.sub(r"[A-Za-z]+", lambda m, w=way: disguised(m[0].lower(), w) if m[0].lower() in insults else m[0], t)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    caught = [r.predicted for r in toxicity.digests(df, model).collect()]
    assert sum(caught) >= 0.9 * len(caught)
    assert caught_without(df, model, monkeypatch) < 0.5 * len(caught)


def caught_without(df, model, monkeypatch):
    """How many are caught if the words are taken as they stand (scored here, not by workers)."""
    channel = toxicity.Channel(model["trigrams"])
    monkeypatch.setattr(channel, "restore", lambda chunk: "")
    starts = toxicity.beginnings(model["weights"])
    z = [model["bias"] + sum(model["weights"][f] for f in toxicity.features(channel.words(r.text), starts) & model["weights"].keys()) for r in df.collect()]
    return sum(x >= 0 for x in z)


def test_decoding_is_exact_and_of_any_length():
    """The search finds what trying every reading finds, and long stretches are restored too."""
    from itertools import product

    text = "idiot stupid moron loser clown pathetic bread water little table " * 50
    grams = {}
    codes = toxicity.letter_codes()
    c = [0, 0, *[int(codes[ord(x)]) for x in text], 0, 0]
    for x in zip(c, c[1:], c[2:], strict=False):
        key = x[0] * toxicity.A**2 + x[1] * toxicity.A + x[2]
        grams[key] = grams.get(key, 0) + 1
    channel = toxicity.Channel(grams)
    for chunk in ("1d10t", "$+upp1d", "m*r00n", "c|0wn", "6r3ad", "l1ttl3", "(*11*8l3"):
        scores = {}
        for way in product(*channel.lattice(chunk)):
            word, p = "".join(s for s, _ in way), sum(cost for _, cost in way)
            x = y = 0
            for ch in word:
                z = channel.code[ch]
                p, x, y = p + channel.log[x][y][z], y, z
            scores[word] = max(scores.get(word, -1e9), p + channel.log[x][y][0])
        assert scores[channel.decode(chunk)] >= max(scores.values()) - 1e-9  # of ties any
    assert {"idiot", "moron", "loser"} <= channel.words("y0u,1d10t,m0r0n/l0ser" + ",w4ter" * 20)
    assert "patheticidiot" in channel.words("".join(f"{x}" * 30 for x in "patheticidiot"))
    assert "idiot" in channel.words("an i\td\ni \u00a0o   t here") and "fat" in channel.words("so f a t!")
    assert len(max(channel.words("1d10t" * 20_000), key=len)) >= 100_000 - 1


def test_gaps_are_breaks_or_nothing():
    """Several words set apart in one stretch are told from each other, and the search is as good as trying every reading."""
    from itertools import product

    text = "you are an idiot you stupid moron what a loser he was so fat and you know it " * 50
    grams = {}
    codes = toxicity.letter_codes()
    c = [0, 0, *[int(codes[ord(x)]) for x in text], 0, 0]
    for x in zip(c, c[1:], c[2:], strict=False):
        key = x[0] * toxicity.A**2 + x[1] * toxicity.A + x[2]
        grams[key] = grams.get(key, 0) + 1
    channel = toxicity.Channel(grams)
    assert channel.spaced("y o u m o r o n") == ["you", "moron"]
    assert channel.spaced("y.o.u  1.d.1.0.t") == ["you", "idiot"]
    assert channel.spaced("y o u  a r e  s o  f a t") == ["you", "are", "so", "fat"]
    assert {"you", "loser"} <= channel.words("so y o u l 0 s e r!") and "youloser" not in channel.words("so y o u l 0 s e r!")
    assert channel.spaced("i d i o t") == ["idiot"]
    for stretch in ("y o u f a t", "a n  i d", "m 0 r 0 n"):
        pieces, gaps = toxicity.GAP.split(stretch), toxicity.GAP.findall(stretch)
        narrow, scores = min(map(len, gaps)), {}
        for breaks in product((False, True), repeat=len(gaps)):
            for way in product(*[channel.lattice(x)[0] for x in pieces]):
                p, x, y, out = 0.0, 0, 0, ""
                for i, (letter, cost) in enumerate(way):
                    if i:
                        p += (toxicity.NARROW if len(gaps[i - 1]) == narrow else toxicity.WIDE)[0 if breaks[i - 1] else 1]
                        if breaks[i - 1]:
                            p, x, y, out = p + channel.log[x][y][0], 0, 0, out + " "
                    p += cost
                    for ch in letter:
                        z = channel.code[ch]
                        p, x, y = p + channel.log[x][y][z], y, z
                    out += letter
                scores[out] = max(scores.get(out, -1e9), p + channel.log[x][y][0])
        assert scores[" ".join(channel.spaced(stretch))] >= max(scores.values()) - 1e-9
    assert "".join(channel.spaced(" ".join("moron" * 4000))).count("m") == 4000


def test_clashing_names_and_repeated_ids(spark):
    """A caller's own columns named like the statistics come back as they were; of texts with one id the least is learned from."""
    rows = [(i, "good words in a row " * 5 if i % 2 else "## $$ " * 20, 99, "t", "w") for i in range(60)]
    docs = spark.createDataFrame(rows + [(1, "## zz", 98, "t", "w")], "doc_id bigint, text string, n_words int, _t string, _w string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    model = quality.learn(docs, labels)
    scored = quality.score(docs, model).collect()
    assert sorted(r.n_words for r in scored) == [98] + [99] * 60 and {r._t for r in scored} == {"t"}
    assert quality.learn(docs.orderBy("text"), labels) == model

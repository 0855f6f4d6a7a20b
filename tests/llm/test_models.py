"""Classifiers, mixing, vector and n-gram joins, the pipeline: held-out accuracy and brute force."""

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import components, mixing, near_vectors, ngram_join, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def odd_rows(spark):
    return spark.createDataFrame([(None, None, "x"), (-1, "", "x"), (-2, None, "x"), (-3, "word " * 40000, "x"), (-3, "word " * 40000, "x")], "doc_id long, text string, score string")


@pytest.mark.parametrize("name,label", [("op4_quality", "quality"), ("op10_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, label):
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}
    assert len(got) == table(spark, "documents").count()
    truth = [(got[r.doc_id], r[label]) for r in table(spark, "labels").collect()]
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 for i, r in got.items())
    assert all(r.predicted == int(r.score >= (0.5 if label == "quality" else 0.7)) for r in got.values())
    tested = [(r, y) for r, y in truth if r.held_out]
    assert np.mean([r.predicted == y for r, y in tested]) > (0.97 if label == "quality" else 0.9)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_take_odd_rows_and_missing_labels(spark, module):
    docs = odd_rows(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = module.classify(docs, none).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert module.classify(docs.limit(0), table(spark, "labels")).count() == 0
    model = module.train(table(spark, "documents"), table(spark, "labels"))
    scores = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    assert scores[-1] == pytest.approx(scores[-2])


def test_factorisation_machine_identity():
    rng = np.random.default_rng(0)
    fm = quality.FactorisationMachine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    x = np.zeros(9, dtype=quality.FEATURE)
    x["bin"], x["value"] = rng.choice(50, 9, replace=False), rng.random(9)
    want = 0.3 + sum(fm.linear[b] * v for b, v in x) + sum(x[i]["value"] * x[j]["value"] * fm.factors[x[i]["bin"]] @ fm.factors[x[j]["bin"]] for i in range(9) for j in range(i))
    assert fm.margins(np.array([0, 0, 9]), x) == pytest.approx([0.3, want], rel=1e-5)


@pytest.fixture(scope="module")
def characters(spark):
    return toxicity.CharacterModel(toxicity.count_characters(table(spark, "documents")))


@pytest.mark.parametrize("written,meant", [("1d10t", "idiot"), ("m0r0n", "moron"), ("idiooooot", "idiot"), ("p@thetic", "pathetic"), ("i.d.i.o.t", "idiot"), ("s-c-u-m", "scum"), ("cl0wn", "clown"), ("$tupid", "stupid")])
def test_deobfuscation(characters, written, meant):
    assert meant in toxicity.restored(written, characters)


def test_viterbi_is_the_best_path(characters):
    def every(stretch):
        paths = [("", 0.0)]
        for ways in [*characters.lattice(stretch), [(" ", 0.0)]]:
            paths = [(s + w, c + x) for s, c in paths for w, x in ways]
        for s, c in paths:
            a = b = toxicity.BORDER
            for ch in s:
                z = toxicity.BORDER if ch == " " else characters.symbol(ch)
                c += characters.log[a][b][z]
                a, b = b, z
            yield c, s

    for stretch in ("1d10t", "l0ser", "a.b.1.e", "heee11o"):
        assert characters.decode(stretch) == max(every(stretch))[1].strip()


def test_spaced_words_are_seen(characters):
    base, hashed = toxicity.extract(pa.array(["you i d i o t !", "plain", None]), characters, {})
    assert set(toxicity.hashes("idiot")) <= set(hashed[base[0] : base[1]].tolist()) and base[3] == base[2]


def test_disguises_of_any_length_are_decoded(characters):
    spaced = " ".join("youareanidiotandamoron" * 500)
    base, hashed = toxicity.extract(pa.array([spaced]), characters, {})
    assert toxicity.hashes("idiot")[0] in hashed.tolist()
    for n in (40, 41, 5000):
        assert "idiot" in toxicity.restored("i" * n + "diot", characters)
    base, hashed = toxicity.extract(pa.array(["y.o.u.a.r.e.a.n." * 200 + "i.d.i.o.t"]), characters, {})
    assert toxicity.hashes("idiot")[0] in hashed.tolist()
    assert characters.decode("1d10t " * 20_000).replace(" ", "") == "idiot" * 20_000
    assert len(characters.decode("10" * 100_000)) >= 100_000


@pytest.mark.parametrize("written,meant", [("1.d.1.0.t", "idiot"), ("st-up1d", "stupid"), ("1d10t's", "idiot"), ("you,1d10t", "idiot"), ("id.iot", "idiot"), ("1d107", "idiot"), ("5tup1d", "stupid"), ("i.i.i.d.i.0.0.t", "idiot"), ("$-7-u-p-1-d!", "stupid")])
def test_combined_disguises(characters, written, meant):
    base, hashed = toxicity.extract(pa.array([written]), characters, {})
    assert toxicity.hashes(meant)[0] in hashed.tolist(), toxicity.restored(written, characters)


@pytest.mark.parametrize("written", ["! d ! o t", "! d | 0 +", "i i i d i o o o o t", "iii ddd iii ooo ttt", "i - d - 1 - o - t", ".i .d .i .o .t"])
def test_combined_spaced_disguises(characters, written):
    base, hashed = toxicity.extract(pa.array(["plain words", written]), characters, {})
    assert toxicity.hashes("idiot")[0] in hashed[base[1] :].tolist()


def test_character_counts_cover_all_texts(spark):
    docs = spark.createDataFrame([("ab",), ("abc",), (None,), ("é",)], "text string")
    assert toxicity.count_characters(docs.repartition(1)).sum() == len("ab" + "abc" + "é".encode().decode("latin-1")) - 2


def test_mixing_seeks_the_cut_through_groups_of_blocks(spark, monkeypatch):
    target, want = mixing.Target(entropy=0.9), {}
    for size in (1, 3, 100_000):
        monkeypatch.setattr(mixing, "BLOCK_DOCUMENTS", size)
        got = mixing.plan(mixing_docs(spark), target).collect()
        drawn = defaultdict(int)
        for r in got:
            drawn[r.source] += r.n_tokens * r.copies
        want = want or drawn
        assert all(abs(drawn[s] - want[s]) <= 16 for s in want)


def mixing_docs(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i < 3000 else f"s{i % 4}") for i in range(4000)]
    rows += [(9000, None, "big"), (9001, "a b", None), (9002, "", "hollow"), (None, "a b c", "s1"), (9003, "x y", "s2"), (9003, "x y", "s2")]
    return spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, weight int")


@pytest.mark.parametrize("target", [mixing.Target(entropy=0.98), mixing.Target(entropy=0.7), mixing.Target(repeats=2.0, budget=None), mixing.Target(repeats=1.5, budget=1.2)])
def test_mixing_meets_its_target(spark, target):
    docs = mixing_docs(spark)
    got = mixing.plan(docs, target).collect()
    assert len(got) == docs.count()
    per = defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        per[r.source][0] += r.n_tokens
        per[r.source][1] += r.n_tokens * r.copies
        per[r.source][2] = r.weight
    total = sum(n for n, _, _ in per.values())
    some = {s: x for s, x in per.items() if x[0]}
    weights = np.array([x[2] for x in some.values()])
    assert weights.sum() == pytest.approx(1, abs=1e-6)
    drawn = sum(x[1] for x in some.values())
    budget = total * target.budget if target.budget else max(x[0] / x[2] for x in some.values())
    for n, d, w in some.values():
        assert w * budget - 1e-3 * n <= d <= w * budget + 1e-3 * n + 16  # a block's end and equal ids overshoot by a few documents
    if target.entropy:
        assert -(weights * np.log(weights)).sum() >= target.entropy * math.log(len(weights)) - 1e-6
    else:
        assert max(w * budget / n for n, _, w in some.values()) <= target.repeats * (1 + 1e-6) or drawn
    if target.budget is None:
        assert min(r.copies for r in got) >= 1
    assert {r.copies for r in got if r.source == "hollow"} == {1}


def test_draw_repeats_rows_and_keeps_columns(spark):
    docs, target = mixing_docs(spark), mixing.Target(repeats=2.0, budget=None)
    copies = sum(r.copies for r in mixing.plan(docs, target).collect())
    drawn = mixing.draw(docs, target)
    assert drawn.columns == docs.columns and drawn.count() == copies
    assert mixing.draw(docs.limit(0), target).count() == 0


def roots(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(500, i) for i in range(501, 560)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {i: c for i, c in roots(pairs, {x for p in pairs for x in p}).items() if i in ids}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op6_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 64))
    near = [base[i] + rng.normal(size=64) * s for i, s in [(k % 40, 0.15) for k in range(200)] + [(50, 0.3)] * 100]
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate([*base, *near, base[3], base[3] * 2, base[7]])]
    n = len(rows)
    odd = [(n, None), (n + 1, [0.0] * 64), (n + 2, [float("nan")] * 64), (n + 3, [None] * 64), (n + 4, []), (n + 5, [1.0, 0.0]), (n + 6, [1.0, 0.1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "vec_id long, embedding array<float>, n_links int")
    got = {r.vec_id: r for r in near_vectors.link(df).collect()}
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = u @ u.T
    np.fill_diagonal(cosine, 0)
    links = cosine >= 0.9
    found = sum(got[i].n_links for i in range(n))
    assert 0.9 * links.sum() <= found <= links.sum()
    assert all(got[i].n_links <= links[i].sum() for i in range(n))
    assert got[n + 5].n_links == got[n + 6].n_links == 1 and got[n + 6].component_id == n + 5
    assert all(got[n + k].n_links == 0 and got[n + k].kept for k in range(5))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert near_vectors.link(df.limit(0)).count() == 0


def brute_links(vectors):
    """(links of each row, smallest place reachable) by all cosines."""
    x = np.array(vectors, dtype=np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    np.fill_diagonal(hit, False)
    return hit.sum(axis=1), roots([(int(a), int(b)) for a, b in zip(*np.nonzero(hit), strict=True)], range(len(x)))


def test_op6_tells_rows_of_one_id_apart(spark):
    e = np.eye(8)
    rows = [(1, e[0]), (1, e[1]), (2, e[0] + 0.1 * e[2]), (None, e[1]), (None, e[5]), (3, None), (3, e[6] * 4), (4, e[6]), (4, e[6] * 4)]
    df = spark.createDataFrame([(i, None if v is None else v.tolist(), i) for i, v in rows], "vec_id long, embedding array<double>, id long")
    got = sorted((tuple(r) for r in near_vectors.link(df).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 1, 1, False), (None, 0, None, False), (3, 0, 3, True), (3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False)], key=repr)


@pytest.mark.parametrize("shape", ["group", "crowd", "wide", "pairs"])
def test_op6_is_whole_on_crowded_vectors(spark, shape):
    rng = np.random.default_rng(11)
    if shape == "group":  # more near copies than one piece of a cell holds
        x = np.concatenate([rng.normal(size=(300, 32)), rng.normal(size=32) + rng.normal(size=(1500, 32)) * 0.2])
    elif shape == "crowd":  # strangers that share a strong direction
        x = rng.normal(size=(900, 48)) + 6 * np.eye(48)[0] * rng.uniform(0.5, 1.5, (900, 1))
    elif shape == "wide":
        x = np.repeat(rng.normal(size=(200, 100)), 3, axis=0) + rng.normal(size=(600, 100)) * 0.3
    else:  # pairs at the threshold, to four digits
        u = near_vectors.unit(rng.normal(size=(500, 64)))
        x = np.concatenate([u, near_vectors.partners(u, rng, 64) + 1e-5 * u])
    want, root = brute_links(x)
    rows = near_vectors.link(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    got = np.zeros(len(x), dtype=int)
    for r in rows:
        got[r.vec_id] = r.n_links
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()
    if shape == "group":
        assert (got == want).all() and all(r.component_id == root[r.vec_id] for r in rows)


def test_op6_recall_on_the_table(spark):
    rows = table(spark, "embeddings").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum() - len(rows)
    assert sum(r.n_links for r in queries.QUERIES["op6_near_vectors"](spark, SF).collect()) >= 0.9 * links


LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def edited(words, rng, share):
    return [rng.choice("abcdefgh") * 3 + str(rng.randrange(50)) if rng.random() < share else w for w in words]


def test_op9_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4)))
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(120)]
    texts = [" ".join(edited(base, rng, rng.choice([0.0, 0.01, 0.02, 0.03]))) for _ in range(150)]
    texts += [" ".join([word() for _ in range(rng.randint(20, 60))] + passage + [word() for _ in range(rng.randint(0, 40))]) for _ in range(80)]
    texts += [" ".join(passage[: rng.randint(20, 60)]) for _ in range(60)]
    for _ in range(40):
        one = [word() for _ in range(rng.randint(5, 80))]
        texts += [" ".join(edited(one, rng, 0.02)) for _ in range(rng.randint(1, 4))]
    texts += ["", None, "  \t ", "one two", "ONE two", "one two", "a b c d", "a b c d e", "x " * 400, "x " * 500, texts[0], texts[0]]
    df = spark.createDataFrame([(i * 3, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s")], "doc_id long, text string, n_shingles string")
    got = ngram_join.join(df.repartition(5)).collect()
    assert len(got) == df.count()
    sets = {i * 3: shingles(t) for i, t in enumerate(texts)}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(links, ids)
    assert len(set(want.values())) < len(ids) - 100
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in ids}
    kept = ngram_join.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()) | {i for i in ids if not sets[i]})
    assert kept.columns == df.columns
    assert ngram_join.join(df.limit(0)).count() == 0


def test_op9_takes_rows_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, None), (4, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.join(df).collect()), key=repr)
    assert got == sorted([(None, 2, 4), (None, 0, None), (4, 2, 4)], key=repr)
    assert sorted((tuple(r) for r in ngram_join.keep_one(df).collect()), key=repr) == sorted([(None, None), (4, "a b c d e f")], key=repr)


def test_keep_one_tells_rows_of_one_id_apart(spark):
    a, b, c = ("one two three four five six seven", "uno dos tres cuatro cinco seis", "eins zwei drei vier fuenf sechs")
    rows = [(1, a), (1, b), (2, a), (2, c), (3, b), (3, b), (None, c), (None, c), (5, ""), (5, ""), (6, c)]
    got = sorted((tuple(r) for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (2, c), (5, ""), (5, "")], key=repr)
    nameless = spark.createDataFrame([(None, a), (None, a), (None, b)], "doc_id long, text string")
    assert sorted(r.text for r in ngram_join.keep_one(nameless).collect()) == sorted([a, b])


def test_op9_with_a_line_that_a_fifth_of_texts_hold(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = "all rights of this work are reserved by whoever made it"
    texts = [" ".join([*(word() for _ in range(rng.randint(12, 25))), *([line] if i % 5 == 0 else [])]) for i in range(600)]
    texts += [" ".join([line, line, word()]) for _ in range(40)]
    texts += ["a b c d e f g h i j k", "a b c d e f g h i j", "p q r s t u v w", "p q r s t u v x"]  # 6 of 7 shingles, 3 of 5
    quarters = " ".join(f"w{i}" for i in range(20))  # 16 shingles, of 12 with the next one: just 75 percent
    texts += [quarters, " ".join(f"w{i}" for i in range(16)), " ".join(f"w{i}" for i in range(15))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert {r.doc_id: r.component_id for r in ngram_join.join(df.repartition(6)).collect()} == roots(links, range(len(sets)))


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    from skein.llm import secrets

    labels, docs = table(spark, "labels"), table(spark, "documents").toPandas()
    toxic = {r.doc_id for r in queries.QUERIES["op10_toxicity"](spark, SF).filter("predicted = 1").select("doc_id").collect()}
    docs.to_parquet(tmp_path / "documents.parquet")
    labels.toPandas().to_parquet(tmp_path / "labels.parquet")
    clean = {int(i): (t or "", s) for i, t, s in zip(docs.doc_id, docs.text, docs.source, strict=True) if i not in toxic}
    sets = {i: shingles(t) for i, (t, _) in clean.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(links, ids)
    kept = [i for i in ids if root[i] == i]
    library, words = Tokenizer.from_file(queries.vocabulary()), lambda t: len(re.findall("[^\x20\x09-\x0d]+", t))
    shown = {}
    for i in kept:
        t, out, at = clean[i][0], "", 0
        for a, _, z in secrets.find(t):
            out += t[at:a] + "[secret]" if a >= at else ""
            at = max(at, z)
        shown[i] = out + t[at:]
    size = defaultdict(int)
    for i in kept:
        size[clean[i][1]] += words(shown[i])
    got = defaultdict(list)
    for r in P.run(spark, f"file://{tmp_path}").collect():
        got[r.doc_id].append(r)
    assert sorted(got) == kept
    drawn = defaultdict(int)
    for i, rows in got.items():
        want = np.array(library.encode(shown[i], add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert all(r.ids == want and r.n_tokens == len(want) // 4 for r in rows)
        assert 1 <= len(rows) <= 2
        drawn[clean[i][1]] += len(rows) * words(shown[i])
    lo, hi = 0.0, 1.0  # the exponent at which the smallest source is passed over twice
    share = np.array([n for n in size.values() if n]) / sum(size.values())
    times = lambda a: share ** (a - 1) * (share ** (1 - a)).max()
    for _ in range(60):
        lo, hi = (lo, (lo + hi) / 2) if times((lo + hi) / 2).max() <= 2 else ((lo + hi) / 2, hi)
    longest = max(words(t) for t in shown.values())
    for s, n, k in zip([s for s in size if size[s]], [n for n in size.values() if n], times(hi), strict=True):
        assert abs(drawn[s] - n * k) <= longest + 1, (s, drawn[s], n, k)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as P

    table(spark, "documents").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    table(spark, "labels").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() == 0


def test_stages_keep_columns_of_any_name(spark):
    from skein.llm import secrets

    rows = [(1, "some clean text here", "a", 20, 1.5, None), (2, "token=abcdefgh", None, 14, None, [1]), (None, None, "b", None, 2.0, []), (1, "some clean text here", "a", 20, 1.5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, `odd name, of: it` double, score array<int>")
    for i, name in enumerate(("_bits", "_maybe", "_MAYBE_", "_maybe_bucket", "_blob", "_spans", "_h1", "_one", "_row", "_source", "_order", "a.b", "tick`s", "blocks", "copies", "rest")):
        df = df.withColumn(name, F.lit(i))
    assert toxicity.keep_clean(df, table(spark, "labels")).schema == df.schema
    hidden = secrets.redact(df, secrets.scan_once(df))
    assert hidden.schema == df.schema and sorted(r.n_chars or 0 for r in hidden.collect()) == [0, 8, 20, 20]
    assert ngram_join.keep_one(df).schema == df.schema and ngram_join.keep_one(df).count() == 3
    assert mixing.draw(df, mixing.Target(repeats=2.0, budget=None)).schema == df.schema

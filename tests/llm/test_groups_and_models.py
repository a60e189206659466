"""Near-duplicates against brute force, the prefix tree, and the classifiers on labelled rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nearvote.llm import bpe, chat, components, cotraining, linear, minhash, toxicity
from nearvote.llm.common import prepare, table
from tests.conftest import SF


# ---- near-duplicates


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())  # noqa: B905
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * (n := len(x & y)) >= 75 * (len(x) + len(y) - n):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(seed, n, words, edits):
    """A text and copies of it with words replaced, some too many."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(edits)):
            t[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield " ".join(t)


def test_components_of_near_duplicates_are_those_of_all_pairs(spark):
    prepare(spark)
    texts = [*family(1, 120, 150, 14), *family(2, 60, 40, 4), *family(3, 3, 3000, 60)]
    texts += ["", None, " \n", "a b", "A  B", "a b c", "one two three four five", "ONE two\tthree four five", "É x y z w", "é x y z w", texts[0], texts[0].upper()]
    rows = list(enumerate(texts))
    random.Random(9).shuffle(rows)
    df = spark.createDataFrame([*rows, (rows[0][0], rows[0][1])], "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("component", F.lit(2))
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows) + 1
    want = brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_null_ids_and_empty_tables(spark):
    prepare(spark)
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "g"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4, False), (4, 4, True), (None, None, True), (None, None, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_texts_under_one_id_are_linked_each_by_its_own(spark):
    prepare(spark)
    rng = random.Random(4)
    one, two, three = ([f"{k}{rng.randrange(900)}" for _ in range(60)] for k in "abc")
    near = lambda words: " ".join([*words[:-1], "end"])
    rows = [(7, " ".join(one)), (7, " ".join(two)), (7, " ".join(three)), (3, near(one)), (9, near(two)), (1, near(near(two).split()) + " more"), (7, " ".join(one))]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, True), (3, 3, True), (7, 1, False), (7, 3, False), (7, 3, False), (7, 7, True), (9, 1, False)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([rows[2], rows[3], rows[5]])


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 2000).astype(np.uint64)
    b = np.concatenate([a[:1800], rng.integers(0, 2**63, 200).astype(np.uint64)])  # 1800 of 2200: 0.818
    apart = [int(np.unpackbits((minhash.odd_sketch(minhash.samples(x)) ^ minhash.odd_sketch(minhash.samples(y))).view(np.uint8)).sum()) for x, y in ((a, b), (a, a), (a, rng.integers(0, 2**63, 2000).astype(np.uint64)))]
    assert apart[1] == 0 and apart[0] <= minhash.most_bits() < apart[2]


def test_connected_components(spark):
    prepare(spark)
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 100), (7, 7), (300, 299)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100, 299: 299, 300: 299}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- chat


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("parts", ["1", "5"])
def test_prefix_tree(spark, parts):
    """Every distinct beginning once, in depth-first order; positions, intervals and masks against the read texts."""
    prepare(spark)
    rng = random.Random(2)
    rows = []
    for c in range(60):
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"common {t}" if t < rng.randrange(4) else f"own {rng.randrange(3)} \\ ### </turn> #### \n{'x' * rng.randrange(5)} \\h </turn>\n### user: é𝄞") for t in range(rng.randrange(1, 7))]
    rows += [(70, 0, None, None), (70, None, "user", "first"), (71, 0, "a:b#\n\\###", "role"), (72, 1, "user", "b"), (72, 1, "user", "a"), (72, 1, "user", "a"), (None, 0, "user", "lost"), (73, 0, "assistant", "long " * 50_000)]
    rows += [(74, t, "user", f"turn {t % 7}") for t in range(3000)]
    df = spark.createDataFrame(rows, TURNS).withColumn("leaf", F.lit(1)).withColumn("key", F.lit(2)).withColumn("range", F.lit(3))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        tree = chat.prefix_tree(df, *bpe.public_ranks())
        read = chat.read_back(tree).collect()
        nodes = sorted(tree.nodes.collect(), key=lambda n: n["place"])
        assert chat.read_back(chat.prefix_tree(df.limit(0), *bpe.public_ranks())).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    back = {r["conv"]: [(t["role"], t["text"]) for t in r["turns"]] for r in read}
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((r or "", x or ""))
    assert set(back) == set(want)
    assert all(sorted(back[c]) == sorted(want[c]) for c in want) and all(back[c] == want[c] for c in want if c != 72)
    assert all(r["loss"] == "".join(x for role, x in back[r["conv"]] if role == "assistant") for r in read)
    assert all(r["n_tokens"] == r["positions"] == r["attended"] for r in read)
    assert len(nodes) == len({tuple(v[: k + 1]) for v in back.values() for k in range(len(v))})
    assert [n["place"] for n in nodes] == np.cumsum([0, *[len(n["ids"]) for n in nodes]])[:-1].tolist()
    bpe_, stream = bpe.encoder(*bpe.public_ranks()), np.concatenate([n["ids"] for n in nodes])
    for n in nodes:
        before = np.concatenate([stream[:0], *[stream[a["start"] : a["end"]] for a in n["attends"]]])
        assert len(before) == n["position"] and all(a["end"] <= n["place"] for a in n["attends"])
        assert n["position_ids"] == list(range(n["position"], n["position"] + len(n["ids"])))
        turns = chat.parsed(bpe_.decode(np.concatenate([before, n["ids"]])).decode())
        assert len(turns) == n["depth"] + 1 and n["learned"] == (turns[-1][0] == "assistant")
        masked = bpe_.decode(np.array(n["ids"])[np.array(n["loss_mask"]) == 1]).decode()
        assert "###" not in masked and "</turn" not in masked and chat.unescaped(masked) == (turns[-1][1] if n["learned"] else "")


def test_op1_against_brute_force(spark):
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    convs = {-7: [(0, "user", chat.ADDED), (1, "assistant", chat.ADDED)]}
    for r in table(spark, SF, "conversations").collect():
        convs.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in chat.op1_chat_tree(spark, SF).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns, r = sorted(turns), got[c]
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), digest("".join(f"{role}\n{x}\n" for _, role, x in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), digest(loss)) and r["n_tokens"] == r["positions"] == r["attended"] > 0


def test_a_conversation_of_many_turns_has_its_intervals_in_linear_time():
    import time

    begun = time.process_time()
    found = list(chat.ancestry(list(range(0, 400_000, 2)), [2] * 200_000))
    assert found[-1] == [{"start": 0, "end": 399_998}] and time.process_time() - begun < 5


# ---- classifiers


def test_logistic_regression_finds_a_separable_class():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = (x[:, 0] - x[:, 2] > 0).astype(float)
    p = linear.fitted(x, y).score(x)
    assert ((p > 0.5) == (y > 0)).mean() > 0.97
    assert linear.fitted(x, np.zeros(500)).score(x).max() < 0.01 and linear.fitted(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3


def test_toxicity_on_rows_that_were_held_out(spark):
    docs, labels = table(spark, SF.replace("0.001", "0.01"), "documents"), table(spark, SF.replace("0.001", "0.01"), "labels")
    chain = toxicity.toxicity_chain(docs, labels.filter("doc_id % 2 = 0"))
    assert chain.categories == ["low_quality", "toxic"] and len(chain.models[1].weights) == len(chain.models[0].weights) + 1 == 2 * len(chain.names) + len(linear.FORMS) + 1
    got = toxicity.scored(docs, chain).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    toxic = [r["rejected"] for r in got if r["toxic"] == 1]
    assert sum(toxic) / len(toxic) > 0.6 and sum(r["rejected"] for r in got if r["toxic"] == 0) <= 2


def test_features_of_a_fold_are_chosen_without_it(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    sample = linear.labelled_sample(docs, labels, ["quality", "toxic"], 6000, "doc_id", "text")
    for column in (0, 1):
        got = linear.telling_by_fold(sample, column, 30, 3)
        ids = [r["doc_id"] for r in sample.collect()]
        fold = dict(zip(ids, linear.folds_of(np.array(ids), 3).tolist(), strict=True))
        for k in range(4):
            kept = [i for i in ids if fold[i] != k]
            want = linear.telling(sample.filter(F.col("doc_id").isin(kept)), column, 30).collect()
            assert got[k] == sorted(r["name"] for r in want)
        assert linear.telling_by_fold(sample.limit(0), column, 30, 3) == [[]] * 4


def naive_row(text, names):
    """The columns of a text as the models have them, counted anew."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    row = []
    for name in names:
        n = sum(w.startswith(name[:-1]) for w in words) if name.endswith("~") else words.count(name)
        row += [np.log1p(n), np.log1p(1000 * n / max(len(words), 50))]
    split, raw = text.split(), text.encode()
    share = lambda n, of: np.log1p(20 * n / max(of, 1))
    letters = sum(b in range(65, 91) or b in range(97, 123) or b >= 0xC0 for b in raw)
    row += [share(text.count("|"), len(split)), share(sum(text.count(c) for c in "%&$#*~^!"), len(split)), share(sum("A" <= c <= "Z" for c in text), letters)]
    row += [share(sum("0" <= c <= "9" for c in text), len(text)), share(sum(a == b for a, b in zip(split, split[1:])), len(split))]  # noqa: B905
    return np.array([*row, min(max(len(text), 1) / max(len(split), 1), 40) / 10, share(text.count("\n"), len(split)), np.log1p(len(split)) / 10])


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


def odds(p):
    q = min(max(p, 1e-4), 1 - 1e-4)
    return np.log(q / (1 - q))


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["ab ", "idiot", " x", "\n", "é", "word word ", "  ", "1", "|"]) for _ in range(300)) for _ in range(40)] + ["", " ", "x" * 900]
    known = frozenset({"ab", "idiot", "word", "idiot~"})
    whole = [(linear.counts_of(t), linear.counts_of(t, known), linear.form(t)) for t in texts]
    monkeypatch.setattr(linear, "PIECE", 50)
    assert whole == [(linear.counts_of(t), linear.counts_of(t, known), linear.form(t)) for t in texts]
    assert all("".join(linear.pieces(t)) == t for t in texts)


def test_op2_against_the_chain_computed_row_by_row(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    chain = toxicity.toxicity_chain(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.op2_toxicity(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        row, before = naive_row(text, chain.names), []
        for category, model in zip(chain.categories, chain.models, strict=True):
            p = sigmoid(np.append(row, [odds(b) for b in before]) @ model.weights + model.constant)
            assert abs(got[i][f"p_{category}"] - p) < 1e-9
            before.append(p)
        assert got[i]["toxic"] == (got[i]["p_toxic"] >= chain.threshold)


def test_later_models_learn_from_out_of_fold_predictions():
    rng = np.random.default_rng(5)
    x, ids = rng.normal(size=(400, 3)), np.arange(400)
    first = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(float)
    second = ((first > 0) & (x[:, 1] > 0)).astype(float)
    chain = toxicity.fit_chain(x, [first, second], ids, ["a", "b", "c"], ["one", "two"])
    fold, out = linear.folds_of(ids, toxicity.FOLDS), np.zeros(400)
    for i in range(400):  # the model of a row has seen no row of its fold
        if (fold[:i] != fold[i]).all():
            out[fold == fold[i]] = linear.fitted(x[fold != fold[i]], first[fold != fold[i]], 3.0).score(x[fold == fold[i]])
    z = np.column_stack([x, [odds(p) for p in out]])
    want = linear.fitted(z, second, 3.0)
    assert np.allclose(chain.models[1].weights, want.weights) and np.isclose(chain.models[1].constant, want.constant)
    # the weights are where the penalized likelihood is greatest
    spread, p = z.std(axis=0), want.score(z)
    assert np.abs(((z - z.mean(axis=0)) / spread).T @ (p - second) + 3.0 * want.weights * spread).max() < 0.05
    assert toxicity.best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.55)


def converged(x, y, weight, penalty, mean, spread):
    """Weighted logistic regression on columns less `mean` and by `spread`, by plain gradient steps of falling loss; log odds of any rows."""
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    keep = np.append(np.full(x.shape[1], penalty), 1e-6)
    loss = lambda b: np.sum(weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ b))) + 0.5 * keep @ (b * b)
    b, step = np.zeros(z.shape[1]), 1.0
    for _ in range(5000):
        gradient = z.T @ (weight * (sigmoid(z @ b) - y)) + keep * b
        while loss(b - step * gradient) > loss(b) and step > 1e-12:
            step /= 2
        b, step = b - step * gradient, step * 2
        if np.abs(gradient).max() < 1e-6:
            break
    return lambda rows: np.column_stack([(rows - mean) / spread, np.ones(len(rows))]) @ b


def test_co_training_against_labels_kept_row_by_row():
    """Three rounds in which every row's label and weight is written down, and models are fitted by gradient steps."""
    rng = np.random.default_rng(11)
    n = 3000
    true = (rng.random(n) < 0.4).astype(float)
    views = [true[:, None] * d + rng.normal(size=(n, len(d))) for d in (np.array([2.2, 1.5, 0.0]), np.array([1.9, -1.6]))]
    ids = rng.permutation(n)
    y = np.where(np.arange(n) < 300, true, np.nan)
    got = cotraining.co_trained(*views, y, ids, [])

    known = ~np.isnan(y)
    held = known & (linear.folds_of(ids, 3) == 0)
    first, good = known & ~held, y[known].mean()
    scale = [(x[first].mean(axis=0), x[first].std(axis=0)) for x in views]
    models = [converged(x[first], y[first], np.ones(first.sum()), 3.0, *s) for x, s in zip(views, scale, strict=True)]

    def calibrated(v):
        z = np.array([odds(p) for p in sigmoid(models[v](views[v]))])[:, None]
        return sigmoid(converged(z[held], y[held], np.ones(held.sum()), 1.0, z[held].mean(axis=0), z[held].std(axis=0))(z))

    given = [np.full(n, np.nan), np.full(n, np.nan)]
    for _ in range(cotraining.ROUNDS):
        sure = [calibrated(0), calibrated(1)]
        for i in np.flatnonzero(~known):
            for v in (0, 1):
                p = sure[1 - v][i]
                if np.isnan(given[v][i]) and (p >= 0.97 or p <= 0.03):
                    given[v][i] = float(p > 0.5)
        for v in (0, 1):
            counts = [(given[v] == c).sum() for c in (0, 1)]
            together = max(400, min(counts[0] / (1 - good), counts[1] / good))
            weight = np.where(first, 1.0, 0.0)
            for c, share in ((0, 1 - good), (1, good)):
                weight[given[v] == c] = min(1.0, together * share / max(counts[c], 1))
            label, use = np.where(first, y, given[v]), weight > 0
            models[v] = converged(views[v][use], label[use], weight[use], 3.0, *scale[v])
    assert all(200 < (~np.isnan(g)).sum() < n - 300 for g in given)
    p = [calibrated(0), calibrated(1)]
    both = sigmoid(np.array([odds(a) + odds(b) for a, b in zip(*p, strict=True)]) - np.log(good / (1 - good)))
    for mine, want in zip(got.score(*views), (*p, both), strict=True):
        assert np.abs(mine - want).max() < 0.02


def test_op7_against_both_views_computed_row_by_row(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    views = cotraining.quality_views(docs, labels)
    got = {r["doc_id"]: r for r in cotraining.op7_quality(spark, SF).collect()}
    rows = docs.collect()
    assert set(got) == {r["doc_id"] for r in rows}
    for r in rows:
        both = naive_row(r["text"] or "", views.names), cotraining.page_matrix([r["lang"]], [r["source"]], [r["n_chars"]])[0]
        t, p = (sigmoid(c.weights[0] * odds(sigmoid(x @ m.weights + m.constant)) + c.constant) for x, m, c in zip(both, views.models, views.calibration, strict=True))
        q = sigmoid(odds(t) + odds(p) - views.prior)
        r = got[r["doc_id"]]
        assert abs(r["p_text"] - t) < 1e-6 and abs(r["p_page"] - p) < 1e-6 and abs(r["quality"] - q) < 1e-6 and r["kept"] == (r["quality"] >= 0.5)


def test_labels_that_teach_nothing_do_not_use_up_the_limit(spark):
    prepare(spark)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None) for i in range(10)] + [(i, 1) for i in range(10, 15)] + [(i, 0) for i in range(100, 200)], "doc_id long, toxic int")
    assert sorted(r["doc_id"] for r in linear.labelled_sample(docs, labels, ["toxic"], 6, "doc_id", "text").collect()) == [10, 11, 12, 13, 14]


def test_classifiers_on_strange_tables(spark):
    prepare(spark)
    rows = spark.createDataFrame([(1, None, None, None, None), (1, "", "en", "s", -1), (None, "word " * 50_000, "en", "s", 9), (2, "\x00 | $$$", "en", None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = rows.withColumn("id", F.lit("clash")).withColumn("y", F.lit("clash")).withColumn("rejected", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (99, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        chain = toxicity.toxicity_chain(rows, known)
        assert toxicity.scored(rows, chain).count() == 4 and toxicity.scored(rows.limit(0), chain).count() == 0
        assert toxicity.without_toxic(rows, chain).columns == rows.columns
        views = cotraining.quality_views(rows, known)
        assert cotraining.scored(rows, views).count() == 4 and cotraining.scored(rows.limit(0), views).count() == 0
    assert toxicity.without_toxic(rows, toxicity.toxicity_chain(rows, labels.limit(0))).count() == 4


def test_co_training_uses_what_the_other_view_is_sure_of():
    rng = np.random.default_rng(1)
    y = (rng.random(3000) < 0.7).astype(float)
    text = y[:, None] * 2 + rng.normal(size=(3000, 3))
    page = y[:, None] * 3 + rng.normal(size=(3000, 2))
    known = np.where(np.arange(3000) < 60, y, np.nan)
    views = cotraining.co_trained(text, page, known, np.arange(3000), [])
    _, _, p = views.score(text, page)
    assert ((p > 0.5) == (y > 0)).mean() > 0.95
    noise = cotraining.co_trained(text, rng.normal(size=(3000, 2)), np.where(np.arange(3000) < 600, y, np.nan), np.arange(3000), [])
    t, q, p = noise.score(text, rng.normal(size=(3000, 2)))  # a view that tells nothing has no say
    assert np.ptp(q) < 0.2 and np.abs(p - t).max() < 0.2 and ((p > 0.5) == (y > 0)).mean() > 0.9


def test_co_training_takes_all_sure_rows(spark, monkeypatch):
    prepare(spark)
    rng, rows = random.Random(4), []
    for i in range(7000):
        good = rng.random() < 0.5
        source = "rare" if i >= 6960 else rng.choice("ab") if good else rng.choice("cd")
        words = [rng.choice(["fine", "clear", "sound"] if good or source == "rare" else ["spam", "click", "prize"]) for _ in range(20)]
        rows.append((i, " ".join(words), "en", source, 100, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, good int")
    labels = docs.filter("doc_id < 1000").select("doc_id", F.col("good").alias("quality"))
    seen = []
    sums = cotraining.summed
    monkeypatch.setattr(cotraining, "summed", lambda kept, now: seen.append((kept.count(), sums(kept, now))) or seen[-1][1])
    views = cotraining.quality_views(docs.drop("good"), labels)
    text, page = (len(m.weights) + 1 for m in views.models)
    at = 2 * (1 + text + text**2)
    assert seen[0][0] == 6000 and seen[0][1][at] + seen[0][1][at + 1 + page + page**2] > 5500  # all that the text is sure of, not 400 of 5,000
    odds = {s: views.score(np.zeros((1, len(views.models[0].weights))), cotraining.page_matrix(["en"], [s], [100]))[1][0] for s in ("rare", "c")}
    assert odds["rare"] > 0.7 > odds["c"]  # no labelled row has this source


def test_quality_on_rows_that_were_held_out(spark):
    docs, labels = table(spark, SF.replace("0.001", "0.1"), "documents"), table(spark, SF.replace("0.001", "0.1"), "labels")
    got = cotraining.scored(docs, cotraining.quality_views(docs, labels.filter("doc_id % 2 = 0"))).join(labels.filter("doc_id % 2 = 1").withColumnRenamed("quality", "good"), "doc_id").collect()
    assert sum(r["kept"] == (r["good"] == 1) for r in got) / len(got) > 0.97


# ---- pipeline


def test_pipeline_against_brute_force(spark):
    """Each stage on what the one before kept."""
    import tiktoken

    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mix", "byte_bpe"]
    kept = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SF).cache())
        assert kept[-1].columns == docs.columns
    a, b, c, d = ({r["doc_id"]: r["text"] for r in k.collect()} for k in kept[:4])
    chain = toxicity.toxicity_chain(docs, table(spark, SF, "labels"))
    assert set(b) == {r["doc_id"] for r in toxicity.scored(docs, chain).filter("not rejected").collect()}
    assert set(c) == {max(i for i in b if b[i] == t) for t in set(b.values())}
    assert set(d) == {i for i, (_, root) in brute(list(c.items())).items() if i == root}
    mix = kept[4].collect()
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in d.values())
    taken = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mix)
    assert abs(taken - 1.5 * words) < 0.02 * words and {r["doc_id"] for r in mix} <= set(d)
    path, pattern = bpe.public_ranks()
    tik = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    out = corpus_pipeline.STAGES[-1][1](spark, kept[4], SF).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in out) == sorted((r["doc_id"], tik.encode_ordinary(r["text"])) for r in mix)
    assert len(a) >= len(b)


def test_stages_on_strange_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, an empty table, and columns with names of the operators' own."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "one two three", "en", None, 13), (None, "one two three", "en", None, 13), (3, "long " * 100_000, "en", "s", 500_000), (3, "long " * 100_000, "en", "s", 500_000), (4, "a b c d e f g", "en", "t", 13), (4, "other words under one id", "en", "t", 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("id", "_id", "key", "kept", "size", "copy", "n", "component", "range"):
        docs = docs.withColumn(name, F.lit("clash"))
    spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, given, str(tmp_path)).cache()
            if name != "byte_bpe":
                assert made.columns == docs.columns
            if name == "exact_dedup":
                left = sorted((str(r["doc_id"]), len(r["text"] or "")) for r in made.collect())
                assert left in ([], [("2", 0), ("3", 500_000), ("4", 13), ("4", 24), ("None", 13)])
            given = made
    assert given.count() == 0 and set(given.columns) == {"doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"}

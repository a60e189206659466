"""The operators that look entries up by chunk, and the tree search."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearvote.llm import align, negatives, registry, word_table
from nearvote.llm.common import prepare
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and more, Ünïcode " * 30_000
STRANGE = ["a", " ", "  ", "\n", "\t", "'s", "é", "日本", "\U0001f600", "1", "!!", "====", "--", "\x1c", "\x85", "the", " THE", "\r\n", "́", "x" * 9, "_", "\x00", "‍", "한국어", "Σ", "İ", "<|endoftext|>", "<|", "▁", "<0x0A>", "<s>", "　", "½"]
TEXTS = [
    (1, "one two three"), (2, None), (3, ""), (4, "one two three"), (5, LONG), (6, " \n\t "), (None, "one two three"), (None, "alone"), (7, "ÀÉ 日本 \U0001f600 ſ don't  x ΟΔΟΣ"),
    (4, "one two three"), (9, "\x1c\x85 a!\x1cb"), (10, "=" * 5000), (11, "one two\nthree"), (12, "a <|endoftext|> b<|startoftext|>C <|ENDOFTEXT|>"), (13, "▁ under ▁"), (14, " leading and trailing "), (15, "\n\n \n x"), (16, "</s><s> <0x41>"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use themselves."""
    prepare(spark)
    rng = random.Random(5)
    made = [(100 + k, "".join(rng.choice(STRANGE) for _ in range(rng.randint(0, 40)))) for k in range(400)]
    rows = [(i, t, "en", ("a", "b", None)[k % 3], len(t or "")) for k, (i, t) in enumerate([*TEXTS, *made])]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("id", "ids", "chunk", "words", "number", "word", "piece", "found", "key", "count"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3).cache()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- words


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(word_table.vocabulary_file())
    found.no_truncation()
    found.no_padding()
    return found


@pytest.mark.parametrize("chunk", [word_table.CHUNK, 100], ids=["one", "many"])
def test_words_are_encoded_as_the_library_does(spark, docs, library, monkeypatch, chunk):
    monkeypatch.setattr(word_table, "CHUNK", chunk)
    rows = word_table.round_trip(docs, word_table.vocabulary_file()).collect()
    want = sorted((str(r["doc_id"]), e.ids, library.decode(e.ids, skip_special_tokens=False)) for r in docs.collect() for e in [library.encode(r["text"] or "", add_special_tokens=False)])
    assert sorted((str(r["doc_id"]), list(r["ids"]), r["decoded"]) for r in rows) == want


def test_ids_are_decoded_by_join(spark, library):
    prepare(spark)
    some = [(1, [320, 49407, 1]), (2, None), (None, []), (3, list(range(0, 49_000, 7)))]
    rows = word_table.decoded(spark.createDataFrame(some, "doc_id long, ids array<int>"), word_table.vocabulary_file()).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in rows) == sorted((str(i), library.decode(x or [], skip_special_tokens=False)) for i, x in some)
    with pytest.raises(Exception, match="no piece has the id"):
        word_table.decoded(spark.createDataFrame([(1, [99_999])], "doc_id long, ids array<int>"), word_table.vocabulary_file()).collect()


def test_word_table_of_an_empty_table(docs):
    assert word_table.round_trip(docs.limit(0), word_table.vocabulary_file()).count() == 0
    assert [r["decoded"] for r in word_table.round_trip(docs.filter("doc_id = 2"), word_table.vocabulary_file()).collect()] == [""]


def test_op11_on_the_table(spark, library):
    rows = {r["doc_id"]: r for r in registry.QUERIES["op11_word_table"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(docs) == len(rows)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = rows[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


# ---- alignment


@pytest.fixture(scope="module")
def both():
    """The two libraries: a text's tokens as (id, bytes) of either side, or none where their bytes differ from a space and the text."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = align.public_files()
    first, second = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
    first.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(align.byte_characters())}

    def piece(i):
        said = second.id_to_piece(i)
        return bytes([int(said[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", said) else said.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        x = [(i, bytes(byte_of[c] for c in first.id_to_token(i))) for i in first.encode(f" {text}", add_special_tokens=False).ids]
        y = [(i, piece(i)) for i in second.encode(text)]
        said = f" {text}".encode()
        return (x, y) if b"".join(t for _, t in x) == said == b"".join(t for _, t in y) else ([], [])

    return tokens


def brute(tokens, rows):
    """What `aligned` returns, by two pointers over every text and plain counting."""
    linked, out = [], []
    for i, text in rows:
        a, b = tokens(text)
        links, groups, group, m, n, end_a, end_b = [], [], ([], []), 0, 0, 0, 0
        while m < len(a) and n < len(b):
            links.append((a[m][0], b[n][0]))
            x, y = end_a + len(a[m][1]), end_b + len(b[n][1])
            if x <= y:
                group[0].append(a[m][0])
                m, end_a = m + 1, x
            if y <= x:
                group[1].append(b[n][0])
                n, end_b = n + 1, y
            if x == y:
                groups.append(",".join(map(str, group[0])) + "|" + ",".join(map(str, group[1])))
                group = ([], [])
        linked.append(links)
        out.append([str(i), len(a), len(b), len(groups), len(links), ";".join(groups)])
    count = Counter(p for links in linked for p in set(links))
    most = [{}, {}]
    for p, c in count.items():
        for side in (0, 1):
            most[side][p[side]] = max(most[side].get(p[side], 0), c)
    return [tuple([*o, *(sum(count[p] == most[side][p[side]] for p in links) for side in (0, 1)), sum(count[p] for p in links)]) for o, links in zip(out, linked, strict=True)], linked, count


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "n_best_b", "count_sum")


@pytest.mark.parametrize("chunk", [align.CHUNK, 200], ids=["one", "many"])
def test_alignment_is_that_of_two_pointers(spark, docs, both, monkeypatch, chunk):
    monkeypatch.setattr(align, "CHUNK", chunk)
    monkeypatch.setattr(align, "BATCH", 100 if chunk == 200 else align.BATCH)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, linked, count = brute(both, rows)
    got = align.aligned(docs, *align.public_files()).collect()
    assert sorted(tuple(str(r[c]) if c == "doc_id" else r[c] for c in COLUMNS) for r in got) == sorted(want)
    assert any(w[1] == 0 and t for w, (_, t) in zip(want, rows, strict=True)) and sum(w[3] for w in want) > 1000
    if chunk == 200:
        found = Counter((str(r["doc_id"]), r["a"], r["b"], r["times"], r["count"]) for r in align.links(docs, *align.public_files()).collect())
        assert found == Counter((str(i), *p, n, count[p]) for (i, _), links in zip(rows, linked, strict=True) for p, n in Counter(links).items())


def test_segments_are_encoded_as_the_library_does(monkeypatch):
    monkeypatch.setattr(align, "LONG", 9)
    made, rng = align.PieceBpe(align.public_files()[1]), random.Random(8)
    assert made.apart
    for _ in range(4000):
        text = "".join(rng.choice(STRANGE) for _ in range(rng.randint(1, 25)))
        if text:
            ids, plain = made.encode(text), made.model.encode(text)
            assert ids is None or np.frombuffer(ids, "<u4").tolist() == plain
            assert (ids is None) == (made.bytes_of(plain) != f" {text}".encode())


def test_alignment_of_an_empty_table(docs):
    assert align.aligned(docs.limit(0), *align.public_files()).count() == 0
    (one,) = align.aligned(docs.filter("doc_id = 2"), *align.public_files()).collect()
    assert [one[c] for c in COLUMNS[1:]] == [0, 0, 0, 0, "", 0, 0, 0]


def test_op13_on_the_table(spark, both):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((int(w[0]), *w[1:5], sha(w[5]) if w[5] else "", *w[6:]) for w in brute(both, rows)[0])
    got = registry.QUERIES["op13_alignment"](spark, SF).withColumnRenamed("groups_sha256", "groups").collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == want


# ---- hard negatives

ROWS = "vec_id long, label int, v array<int>, anchor boolean, score long, rank int, class string"


def mined_by_all_pairs(rows, positives=5, negatives=3, low=50, high=95):
    """What `mined` returns, by every anchor against every row."""
    rows = [(i, label, v, anchor) for i, label, v, anchor in rows if label is not None and v is not None and None not in v]
    by_id = lambda r: (r[0] is None, r[0] or 0)
    out = []
    for a in rows:
        if not a[3]:
            continue
        scored = sorted(((sum(x * y for x, y in zip(a[2], r[2], strict=False)), r) for r in rows if r is not a), key=lambda x: (-x[0], by_id(x[1])))
        for ps, p in [x for x in scored if x[1][1] == a[1]][:positives]:
            found = [(s, n) for s, n in scored if n[1] != a[1] and low * ps <= 100 * s <= high * ps][:negatives]
            out += [(a[0], p[0], k, n[0], ps, s) for k, (s, n) in enumerate(found, 1)]
    return sorted(map(str, out))


def shown(df):
    return sorted(str((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"])) for r in df.collect())


def vectors(n=600, dims=5, seed=2):
    """Clusters, many equal scores, copies under several labels, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centers = rng.integers(-6, 9, (8, dims))
    rows = []
    for i in range(n):
        v = [3, 3, 3, 1, 0] if i % 3 == 0 else (centers[i % 8] + rng.integers(-2, 3, dims)).tolist()
        rows.append((i, int(rng.integers(0, 4)), [int(x) for x in v], i % 10 == 0))
    return [*rows, (None, 1, [3, 3, 3, 1, 0], None), (None, 2, [2, 2, 2, 1, 0], False), (7, None, [1] * 5, False), (20, 3, None, True), (30, 3, [1, None, 1, 1, 1], True), (40, 1, [4, 4], True), (40, 1, [4, 4], True), (50, 9, [1] * 5, True), (60, 2, [], True)]


@pytest.mark.parametrize(("group", "leaf"), [(64, 512), (3, 10)], ids=["leaves", "trees"])
def test_negatives_are_those_of_all_pairs(spark, monkeypatch, group, leaf):
    monkeypatch.setattr(negatives, "GROUP", group)
    monkeypatch.setattr(negatives, "LEAF", leaf)
    monkeypatch.setattr(negatives, "MEETING", 2 if leaf == 10 else 64)
    prepare(spark)
    rows = vectors()
    df = spark.createDataFrame([(*r, 5, 5, "x") for r in rows], ROWS).repartition(3)
    assert shown(negatives.mined(df)) == mined_by_all_pairs(rows)


def test_negatives_of_large_numbers_and_of_few_rows(spark):
    prepare(spark)
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, [int(x) for x in rng.integers(-(10**9), 10**9, 2)], i % 5 == 0) for i in range(40)]
    df = spark.createDataFrame([(i, k, v, a, 5, 5, "x") for i, k, v, a in rows], ROWS)
    assert shown(negatives.mined(df)) == mined_by_all_pairs(rows)
    assert negatives.mined(df.limit(0)).count() == 0 and negatives.mined(df.filter("label = 1")).count() == 0 and negatives.mined(df.filter("not anchor")).count() == 0


def test_a_pair_of_nodes_bounds_its_products(spark):
    prepare(spark)
    rows = spark.createDataFrame([(*r, 5, 5, "x") for r in vectors() if r[2] and len(r[2]) == 5 and None not in r[2]], ROWS).withColumn("rid", F.monotonically_increasing_id()).checkpoint()
    nodes, leaves = negatives.tree(rows.select("rid", F.lit(0).alias("root"), F.col("v").cast("array<long>").alias("v")), 10)
    assert leaves.count() == rows.count() and nodes.filter("leaf").agg(F.sum("size")).first()[0] == rows.count() and nodes.filter("leaf and size > 10 and exists(arrays_zip(low, high), x -> x.low < x.high)").count() == 0
    of = lambda s: nodes.filter("leaf").select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("center", "radius", "low", "high")])
    both = of("a").join(of("b").sample(0.3, 1)).toArrow().combine_chunks()
    v = {}
    for r in leaves.join(rows, "rid").collect():
        v.setdefault(tuple(r["node"]), []).append(list(r["v"]))
    for batch in both.to_batches():
        least, most = negatives.bounds(batch)
        for a, b, x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), least, most, strict=True):
            products = np.array(v[tuple(a.values())]) @ np.array(v[tuple(b.values())]).T
            assert x <= products.min() and products.max() <= y


def test_op12_as_sql(spark, duck):
    from tests.conftest import same

    same(registry.QUERIES["op12_hard_negatives"](spark, SF).toPandas(), duck.execute(registry.ORACLE_SQL["op12_hard_negatives"]).df())


def test_op12_takes_few_jobs(spark):
    """Each job leaves its plan and metrics with the driver, whose memory grew with them; there were 164."""
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    before = jobs()
    registry.QUERIES["op12_hard_negatives"](spark, SF).collect()
    assert jobs() - before <= 140


def test_alignment_tables_hold_the_words_of_a_large_part():
    """140,000 distinct words are encoded once, though tables may turn between texts."""
    made, calls = align.PieceBpe(align.public_files()[1]), []
    made.segments.new.make = lambda key: calls.append(key) or made.segment(key)
    words = [f"w{i:x}" for i in range(140_000)]
    texts = [" ".join(words[i : i + 10_000]) for i in range(0, len(words), 10_000)]
    first, again = ([made.encode(t) for t in texts] for _ in range(2))
    assert first == again and len(calls) == len(words)


@pytest.mark.parametrize("most", [word_table.MOST_IDS, 0], ids=["sent", "joined"])
def test_round_trip_makes_no_rows_of_tasks_times_chunks(spark, monkeypatch, most):
    """Ids of a chunk aren't made rows where the vocabulary is sent to the tasks; results are those of the join."""
    monkeypatch.setattr(word_table, "MOST_IDS", most)
    monkeypatch.setattr(word_table, "CHUNK", 50)
    if most:
        monkeypatch.setattr(word_table, "ids_of_chunks", None)
    from tokenizers import Tokenizer

    path = word_table.vocabulary_file()
    library = Tokenizer.from_file(path)
    texts = [f"Plain word {i}, naïve 東京 [UNK] </s>\n{'x' * i}" for i in range(40)] + ["", None]
    rows = word_table.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), path).collect()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["ids"], r["decoded"]) == (ids, library.decode(ids, skip_special_tokens=False))
    assert len(rows) == len(texts)


def test_texts_of_chunks_are_not_shuffled(spark, docs, monkeypatch):
    """They are dealt by chunk when they are written, so no second copy takes disk; the table leaves no name behind."""
    monkeypatch.setattr(word_table, "CHUNK", 100)
    plan = word_table.round_trip(docs, word_table.vocabulary_file())._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "numbers" not in "".join(re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("words_")]

"""Stages of the corpus pipeline: clashing columns, nulls, repeats, empty
tables, and the whole run against the stages one by one."""

import os
import random
import shutil
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common, embedding_dedup, language_id, ngram_join, secret_scan
from quarry.llm.queries import QUERIES
from tests.conftest import SF_SMALL

corpus_pipeline = pytest.importorskip("corpus_pipeline")

CLASHES = "_before string, _quality double, quality double, _text string, _text_key string, _row bigint, row string, _ROW_ string, component_id bigint, score double, k string, node bigint"
BASE = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def key(rng, n=40):
    return "q7" + "".join(rng.choice("0123456789abcdefghijkmnopqrstuvwxyzABCDEFGHJK") for _ in range(n - 2))


def prose(rng, n, size=3000):
    return " ".join("word%d" % rng.randrange(size) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(77)
    secret = key(rng)
    good = [prose(rng, 60) for _ in range(30)]
    texts = [*good, None, "", " \n", f"run access_key={secret} now", good[0], good[1] + " more"]
    out = [(i, t, "en", "s", 5) for i, t in enumerate(texts)] + [(None, good[2], None, None, None), (3, prose(rng, 50), "en", "s", 1), (3, good[4], "en", "s", 1)]
    return [(*r, "b", 0.1, 0.2, "t", "tk", 7, "r", "R", 9, 0.5, "kk", 11) for r in out], secret


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows[0], f"{BASE}, {CLASHES}").repartition(3)


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stage-input"))
    rng = random.Random(5)
    labels = [(i, 1, 0) for i in range(30)] + [(500 + i, 0, 0) for i in range(9)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, prose(rng, 25)), (2, rows[0][5][1][: len(rows[0][5][1]) // 2])]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("number", range(5))
def test_stages_leave_other_columns_alone(spark, docs, rows, folder, number):
    name, stage = corpus_pipeline.STAGES[number]
    got = stage(spark, docs, folder)
    empty = stage(spark, docs.limit(0), folder)
    assert empty.count() == 0
    if number == 4:
        bare = stage(spark, docs.select(*[c.split()[0] for c in BASE.split(", ")]), folder)
        assert got.columns == bare.columns and got.agg(F.sum("length")).first() == bare.agg(F.sum("length")).first()
        return
    assert got.columns == docs.columns and empty.columns == docs.columns
    bare = docs.select(*[c.split()[0] for c in BASE.split(", ")])
    kept = plain(got.select(*bare.columns))
    alone = plain(stage(spark, bare, folder))
    if number == 1:  # which of two equal groups' rows stays does not depend on names
        assert sum(kept.values()) == sum(alone.values())
    else:
        assert kept == alone
    if number == 3:
        assert rows[1] not in " ".join(str(v) for r in got.collect() for v in r)
        assert got.where(F.col("text").contains("[SECRET]") & (F.col("n_chars") == F.length("text"))).count() == 1
    else:
        assert not plain(got) - plain(docs)


def test_run_is_its_stages_one_after_another(spark, folder, tmp_path):
    path = str(tmp_path / "in")
    os.makedirs(path)
    for table in ("documents", "labels", "benchmark"):
        shutil.copy(f"{SF_SMALL}/{table}.parquet", f"{path}/{table}.parquet")
    got = corpus_pipeline.run(spark, path)
    docs = common.documents(spark, path)
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, path), "stage")
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[2] < counts[1] and counts[4] == counts[3] > 50
    want = corpus_pipeline.packing_stage(spark, docs, path)
    pieces = lambda df: sorted((r.doc_id, r.ids_crc32_all) for r in df.groupBy("doc_id").agg(F.sum("length").alias("ids_crc32_all")).collect())
    assert pieces(got) == pieces(want)


def test_near_duplicates_of_the_stage_equal_brute_force(spark):
    """Registered rule of the stage against all pairs, on the sf0.001 texts."""
    docs = common.documents(spark, SF_SMALL)
    texts = {r.doc_id: r.text for r in docs.collect()}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    def sets(width):
        out = {}
        for d, t in texts.items():
            w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(fold))
            out[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
        return out

    for rule, run in ((ngram_join.Rule(3, 90, 100), QUERIES["op10_ngram_jaccard_join"](spark, SF_SMALL)), (ngram_join.Rule(), ngram_join.near_duplicates(docs))):
        s = sets(rule.width)
        label = {d: d for d in s}
        links = [(a, b) for a in s for b in s if a < b and s[a] and rule.den * len(s[a] & s[b]) >= rule.num * len(s[a] | s[b])]
        for _ in range(len(label)):
            before = dict(label)
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
            if before == label:
                break
        assert {r.doc_id: r.component_id for r in run.collect()} == label and links


@pytest.mark.parametrize("rule", [ngram_join.Rule(3, 90, 100), ngram_join.Rule()])
def test_filters_turn_unrelated_texts_away_at_any_length(rule):
    rng = np.random.default_rng(4)
    check = ngram_join.Filters(rule)

    def pack(sets):
        raw = b"".join(ngram_join.parity_sketch(np.sort(s)) + ngram_join.first_shingles(np.sort(s)) for s in sets)
        return np.array([len(s) for s in sets]), np.frombuffer(raw, np.uint64).reshape(len(sets), -1)

    for n in (5, 30, 100, 300, 600, 2000, 5000):
        shared = rng.integers(0, 2**63, n // 10 + 1).astype(np.uint64)
        sizes, f = pack([np.concatenate([shared, rng.integers(0, 2**63, n - len(shared)).astype(np.uint64)]) for _ in range(40)])
        i, j = np.triu_indices(40, 1)
        assert check.passing(sizes, f, i, j).mean() < 0.01, n
        common_ = int(np.ceil(2 * n * rule.num / (rule.den + rule.num)))  # just at the threshold
        one, two = [], []
        for _ in range(150):
            s = rng.integers(0, 2**63, 2 * n - common_).astype(np.uint64)
            one.append(s[:n])
            two.append(np.concatenate([s[:common_], s[n:]]))
        sizes, f = pack(one + two)
        assert check.passing(sizes, f, np.arange(150), np.arange(150) + 150).all(), n


def test_repeated_keys_are_all_reported():
    rng = random.Random(6)
    secret, other = key(rng), key(rng)
    text = f"export AWS_SECRET_ACCESS_KEY={secret}\nline\nexport AWS_SECRET_ACCESS_KEY={secret}\nand {secret} again, x={secret}"
    assert [text[a:b] for *_, a, b, _ in secret_scan.scan(text)] == [secret] * 4
    assert secret_scan.scan(f"{other} {other} nothing of note") == []
    many = "".join(f"access_key={key(rng)}\n" for _ in range(3000))
    found = secret_scan.scan(many)
    assert len(found) == 3000 == len({many[a:b] for _, a, b, _ in found}) and all(many[b] == "\n" for *_, b, _ in found)


def test_taken_places_are_what_overlap_tests_say():
    rng = random.Random(8)
    for _ in range(100):
        spans = [(a, a + rng.randrange(1, 9)) for a in (rng.randrange(80) for _ in range(rng.randrange(8)))]
        taken = secret_scan.Taken(spans)
        for _ in range(20):
            a = rng.randrange(90)
            b = a + rng.randrange(1, 9)
            free = not any(x < b and a < y for x, y in spans)
            assert taken.free(a, b) == free
            if free:
                taken.add(a, b)
                spans.append((a, b))


def test_a_repeated_id_neither_drops_nor_floods_a_language(spark):
    rng = random.Random(9)
    words = {"en": "the of and that this".split(), "de": "der und nicht schön über".split()}
    text = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(12))
    hot = next(i for i in range(1, 99) if zlib.crc32(str(i).encode()) % 5)
    data = [(hot, "the of and that this", "en")] * 3000 + [(hot, text("en"), "en") for _ in range(700)] + [(1000 + i, text("de"), "de") for i in range(50)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string").repartition(4)
    taught = []

    def spy(rows, y, languages, **kw):
        taught.append((languages, np.bincount(y).tolist()))
        return train(rows, y, languages, **kw)

    train, language_id.train = language_id.train, spy
    try:
        got = language_id.language_id(df, per_language=100).where("not held_out").collect()
    finally:
        language_id.train = train
    languages, counts = taught[0]
    assert languages == ["de", "en"] and 25 <= counts[0] <= 50 and counts[1] == 100
    right = [r.lang_pred == ("en" if r.doc_id == hot else "de") for r in got]
    assert np.mean(right) > 0.99


def test_ids_with_several_vectors_are_one_vertex(spark):
    v, w = [1.0, 0.0, 0.0, 0.0], [0.99, 0.1, 0.0, 0.0]
    df = spark.createDataFrame([(1, v), (1, v), (2, w), (3, v), (4, w), (2, v), (5, [0.0, 0.0, 1.0, 0.0])], "vec_id bigint, embedding array<float>")
    got = Counter(tuple(r) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == Counter({(1, 3, 1, True): 2, (2, 3, 1, False): 2, (3, 3, 1, False): 1, (4, 3, 1, False): 1, (5, 0, 5, True): 1})
    rng = np.random.default_rng(0)
    base = rng.standard_normal((30, 16))
    x = (base[np.arange(300) % 30] + 0.06 * rng.standard_normal((300, 16))).astype(np.float32)
    x[200:] = x[rng.integers(0, 200, 100)]
    ids = rng.integers(0, 200, 300).tolist()
    df = spark.createDataFrame([(i, a.tolist()) for i, a in zip(ids, x)], "vec_id bigint, embedding array<float>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = {i: set() for i in ids}
    for a, b in zip(*np.nonzero(y @ y.T >= 0.95)):
        near[ids[a]] |= {ids[b]} - {ids[a]}
    label = {i: i for i in near}
    for _ in near:
        for i in near:
            label[i] = min([label[i], *(label[j] for j in near[i])])
    assert found == {i: (len(near[i]), label[i]) for i in near}


def test_the_code_of_many_directions_is_small():
    code = embedding_dedup.CapCode(64, 200_000_000)
    assert sum(b.nbytes for b in code.books) < 50_000_000
    rng = np.random.default_rng(2)
    x = rng.standard_normal((20, 64))
    found = code.decode(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert all(len(f) >= embedding_dedup.LEAST_CAPS - 1 for f in found)  # the last one may round off


def test_licenses_go_by_their_deciding_words(spark):
    from quarry.llm import license_scan

    t = license_scan.TEMPLATES
    want = {
        "Released under the BSD License": ["BSD"], "Licensed under CC BY 4.0": ["CC-BY-4.0"], "Licensed under CC BY-SA 4.0": ["CC-BY-SA-4.0"],
        "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"], "Licensed under CC BY 1.0": [], "Released under some License": [],
        "This work is licensed under a Creative Commons Attribution 4.0 International License": ["CC-BY-4.0-sentence"],
        "This work is licensed under the GNU General Public License, version 2.0": ["GPL-2.0"],
        t["GPL-2.0-header"].replace("useful", "usable"): ["GPL-2.0-header"], t["LGPL-3.0-header"].replace("hope", "wish"): ["LGPL-3.0-header"],
        t["BSD-3-Clause"].replace("holder", "owner"): ["BSD-3-Clause"], f"{t['MIT']} or {t['Apache-2.0']}": ["MIT", "Apache-2.0"],
    }
    want |= {body: [name] for name, body in t.items()}
    df = spark.createDataFrame(list(enumerate(want)), "doc_id bigint, text string")
    got = {r.doc_id: [f.license for f in r.findings] for r in license_scan.licenses(df).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_notices_are_found_at_their_place(spark):
    """Edited notices put into prose: found where they stand, with the share of
    their words that a longest common subsequence has, and nowhere else."""
    from quarry.llm import license_scan

    rng = random.Random(12)
    texts, places = [], []
    names = [n for n in license_scan.TEMPLATES if len(license_scan.TEMPLATES[n].split()) > 30]
    for _ in range(40):
        name = rng.choice(names)
        notice = [w.lower() for w in __import__("re").findall("[A-Za-z0-9]+", license_scan.TEMPLATES[name])]
        edited = [w if rng.random() > 0.05 or w in license_scan.DECIDING[name] else "changed" for w in notice]
        before = prose(rng, rng.randrange(40)).split()
        texts.append(" ".join([*before, *edited, *prose(rng, 30).split()]))
        places.append((name, len(before), sum(w != "changed" for w in edited) / len(notice)))
    df = spark.createDataFrame([*enumerate(texts), (99, prose(rng, 500))], "doc_id bigint, text string")
    got = {r.doc_id: r.findings for r in license_scan.licenses(df).collect()}
    assert got[99] == []
    right = 0
    for i, (name, start, share) in enumerate(places):
        exact = [f for f in got[i] if f.license == name and abs(f.first_word - start) <= 3 and abs(f.coverage - share) < 0.06]
        right += len(got[i]) == len(exact) == 1
    assert right >= 38


def test_ids_with_several_texts_keep_their_sets_apart(spark):
    rng = random.Random(14)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (4, prose(rng, 60))] + [(9, prose(rng, 50))] * 30
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect())
    assert got == Counter({(1, 56, 1): 2, (2, 57, 1): 1, (3, 57, 1): 1, (4, 56, 4): 1, (9, 46, 9): 30})


def test_a_group_is_joined_by_a_forest():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(2, 40))
        i, j = rng.integers(0, n, (2, 60))
        joined, label = ngram_join.Joined(n), list(range(n))
        total = 0
        for part in np.array_split(np.arange(60), 4):
            some = part[i[part] != j[part]]
            a, b = joined.join(i[some], j[some])
            total += len(a)
            for x, y in zip(i[some], j[some]):
                old, new = max(label[x], label[y]), min(label[x], label[y])
                label = [new if v == old else v for v in label]
        assert joined.label.tolist() == label and total == n - len(set(label))


@pytest.mark.parametrize("block", [2048, 16])
def test_large_families_equal_brute_force(spark, monkeypatch, block):
    """A group of many variants, some near the threshold, in one block and in
    block pairs."""
    from quarry.llm import graph

    monkeypatch.setattr(graph, "BLOCK", block)
    monkeypatch.setattr(graph.blocked, "__defaults__", (block,))
    rng = random.Random(15)
    base = prose(rng, 80).split()
    texts = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(7)):
            w[rng.randrange(len(w))] = "new%d" % rng.randrange(10**6)
        texts.append(" ".join(w))
    docs = list(enumerate(texts))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(76)} for t in texts]
    label = list(range(90))
    for a in range(90):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if v == old else v for v in label]
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)).collect()}
    assert got == dict(enumerate(label)) and 2 < len(set(label)) < 80

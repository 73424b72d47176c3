"""Quality rules, Merkle manifest and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import merkle_manifest, quality_rules, spelling_variants
from quarry.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, n int, rank int, _file string, k string, word string, tree string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, size=300):
    return " ".join("word%d" % min(rng.randrange(size), rng.randrange(size)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(41)
    letters = "abcdeéñ×÷Ü"
    names = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    changed = []
    for w in names:  # one code point added, lost or replaced
        at = rng.randrange(len(w))
        changed += [w[:at] + rng.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at + 1 :]]
    names = names * 9 + changed
    texts = [
        None, "", "  \n\t", "\n\nx\n\n", "one two three one two three", "Same line\nsame line\nSame line\n \n \nSame line", "a b a b a b a", "# * $ % & | < > 🙂 é\x0b#",
        prose(rng, 49), prose(rng, 50), prose(rng, 60), " ".join(["the same few words"] * 30), prose(rng, 20_000), "Ünï×çödé÷ ÀÿŸ naïve naïve naïve NAÏVE", " ".join(["a" * 3000, "b" * 3000] * 8 + ["a" * 2999, "a" * 1500 + "c" + "a" * 1500] * 3),
    ]
    texts += [" ".join(rng.choice(names) for _ in range(rng.randrange(120))) for _ in range(60)]
    texts += [prose(rng, 70) + "\n" + prose(rng, 9) for _ in range(40)]
    out = [(i, ["web", "é", None, "", "z"][min(i % 9, 4)], ["en", None][i % 2], None if i % 7 == 0 else i, t) for i, t in enumerate(texts)]
    out += [out[8], out[8], out[20], (None, "web", "en", 4, "a\nb"), (None, None, None, None, None), (None, "web", None, 1, texts[21]), (8, "web", "en", 9, "other\ntext"), (-5, "web", "en", 1, "l\nm"), (7000, "alone", "en", 1, "\n")]
    return [(*r, "x", 1, 2, "y", "z", "w", "t") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


def brute_grams(text):
    """Buckets of a text's n-grams, one text at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    hashes = [quality_rules.runs(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), quality_rules._SPACE)[0][0] for w in words]
    one = lambda h: int(quality_rules._bucket(np.array([h], np.uint64))[0])
    mixed = lambda h, s: quality_rules.mix(np.array([h], np.uint64), s)[0]
    out = [one(h) for h in hashes]
    out += [one(mixed((int(a) * 3 + int(mixed(b, 1))) % 2**64, 2)) for a, b in zip(hashes, hashes[1:])]
    raw = re.sub(rb"[\x20\x09-\x0D]", b" ", (text or "").encode())
    return out + [one(mixed(int.from_bytes(raw[i : i + k], "big"), 10 + k)) for k in quality_rules.BYTE_GRAMS for i in range(len(raw) - k + 1)]


def test_quality_rules_equal_brute_force(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 1) for i in range(70, 100)] + [(i, 0) for i in range(20, 60)] + [(8, 1), (8, 0), (None, 1), (9, None), (99999, 1)], "doc_id bigint, quality int")
    trusted = quality_rules.trusted_ids(labels)
    assert set(trusted) == {*range(70, 100), 8, 99999}
    assert len(quality_rules.trusted_ids(labels, 5)) == 5
    small = [r for r in rows if len(r[4] or "") < 5000]
    ratio = quality_rules.fit(spark.createDataFrame(small, SCHEMA).repartition(3), trusted)
    raw, target = Counter(), Counter()
    grams = [brute_grams(r[4]) for r in small]
    for r, g in zip(small, grams):
        raw.update(g)
        target.update(g if r[0] in trusted else [])
    total, aim = sum(raw.values()), sum(target.values())
    for b in range(0, quality_rules.BUCKETS, 7):
        p = (raw[b] + 1) / (total + quality_rules.BUCKETS)
        assert abs(ratio[b] - np.log((target[b] + quality_rules.SMOOTH * p) / (aim + quality_rules.SMOOTH) / p)) < 1e-9
    got = quality_rules.score(spark.createDataFrame(small, SCHEMA).repartition(3), ratio, threshold=0.01).collect()
    want = []
    for r, g in zip(small, grams):
        base = brute_measures(r[4])
        value = sum(ratio[b] for b in g) / len(g) if g else 0.0
        want.append((str(r[0]), *base, not base[-1] and value >= 0.01, round(value, 9)))
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.score, 9)) for r in got) == sorted(want)
    assert {w[-2] for w in want if not w[-3]} == {True, False}
    # a text too long for one slice, and all rows whatever their names
    every = quality_rules.quality_rules(docs, labels).collect()
    assert sorted((str(r.doc_id), *r[1:7]) for r in every) == sorted((str(r[0]), *brute_measures(r[4])) for r in rows)
    # without a trusted text the base rule alone decides
    assert all(r.kept == (not r.base_failed) and r.score == 0 for r in quality_rules.quality_rules(docs, labels.limit(0)).collect())
    assert quality_rules.quality_rules(empty, labels).count() == 0


def test_quality_rules_part_held_out_labels(spark):
    """Learned without a third of the labels, the verdict fits those held out."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = "crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"
    got = quality_rules.quality_rules(docs, labels.where(f"not {held}")).join(labels.where(held), "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in got if r.quality == q] for q in (1, 0))
    assert len(good) > 60 and sum(good) == len(good) and sum(bad) == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha("".join(map(field, (*r[:4], text))))

    def tree(level):
        proofs, place = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for k, p in enumerate(place):
                first = p - p % 3
                proofs[k].append(("".join(level[first:p]), "".join(level[p + 1 : first + 3])))
                place[k] = p // 3
            level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
        return level[0], proofs

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda x: x[:3])
    trees = {s: tree([x[2] for x in by[s]]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (known, _, own, r), proof in zip(by[s], trees[s][1]):
            text = r[4]
            if known and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            at = leaf(r, text)
            for before, after in proof + top:
                at = sha(before + at + after)
            out.append((r[0], own, trees[s][0], root, sha("".join(a + b for a, b in proof + top)), at, at == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("depth", [1, 2, 8])
def test_manifest_equals_brute_force(spark, docs, rows, empty, depth, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "DEPTH", depth)
    got = sorted((tuple(r) for r in merkle_manifest.checked(docs).collect()), key=str)
    assert got == brute_manifest(rows)
    assert {r[-1] for r in got} == {True, False}
    one = merkle_manifest.checked(docs.where("doc_id = 7000")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == sha("")
    if depth == 1:
        assert merkle_manifest.checked(empty).count() == 0


def test_manifest_of_one_hot_source(spark, monkeypatch):
    """Rows alike in every column are spread over the files, and a tree of
    several partitions with a short last one goes through several rounds."""
    monkeypatch.setattr(merkle_manifest, "DEPTH", 1)
    rows = [(i // 40, "hot", "en", 1, "t\n") for i in range(160)] + [(i, f"s{i}", "en", 1, "u") for i in range(31)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    assert sorted((tuple(r) for r in merkle_manifest.checked(df).collect()), key=str) == brute_manifest(rows)


def brute_spelling(rows):
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[4] or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: {u for u in n if one_apart(w, u)} for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda u: (-n[u], u), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root))
    return sorted(out)


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("points", [400_000, 200])
def test_spelling_equals_brute_force(spark, docs, rows, empty, points, monkeypatch):
    monkeypatch.setattr(spelling_variants, "POINTS", points)  # 200: cut halves, many small indexes
    got = sorted(tuple(r) for r in spelling_variants.spelling_variants(docs).select("word", "n", "n_near", "form", "form_n", "root").collect())
    want = brute_spelling(rows)
    assert got == want and sum(w[3] is not None for w in want) > 20
    assert any(len(w[0]) == 3000 and w[2] for w in want)
    if points == 200:
        assert spelling_variants.spelling_variants(empty).count() == 0


def test_runs_lose_the_same_code_point(monkeypatch):
    monkeypatch.setattr(spelling_variants, "DROP", 2)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abZéÀ×÷ -Ÿß🙂\n") for _ in range(rng.randrange(400))) for _ in range(40)] + [None, "", "Éa" * 2000]
    ids = [str(i - 3) for i in range(42)] + [None]
    words, n = spelling_variants.counted(pa.array(texts), ids)
    want = Counter()
    for d, t in zip(ids, texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 2 == 0 else run
            want[run] += len(run) >= 5
    assert dict(zip(words, n.tolist())) == {w: c for w, c in want.items() if c}


def test_index_finds_every_pair_of_equal_halves():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(5, 9))) for _ in range(300)})
    for right in (False, True):
        i, j = spelling_variants.near_words(words, words, right)
        got = {(words[a], words[b]) for a, b in zip(i.tolist(), j.tolist())}
        half = (lambda w, l: w[len(w) - (l - l // 2) :]) if right else (lambda w, l: w[: l // 2])
        want = {(a, b) for a in words for b in words if len(b) - len(a) in (0, 1) and one_apart(a, b) and half(a, len(a)) == half(b, len(a))}
        assert want <= got and all(one_apart(a, b) for a, b in got)
    i, _ = spelling_variants.near_words(["abcde"], ["vwxyz"], True)
    assert len(i) == 0


def test_long_chains_of_forms(spark):
    chain = [(f"w{i:03}", f"w{i + 1:03}") for i in range(70)] + [("x", "y")]
    got = {r.word: r.root for r in spelling_variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {a: "w070" for a, _ in chain[:-1]} | {"x": "y"}


@pytest.mark.parametrize("name", ["op6_embedding_near_dedup", "op10_ngram_jaccard_join", "op12_merkle_manifest", "op13_spelling_variants"])
def test_registered_query_equals_its_sql(spark, name):
    res = compare(spark, SF_SMALL, [name], verbose=False)[name]
    assert res["cols_match"] and res["spark_rows"] == res["duck_rows"] and res["values_match"], res


def test_registered_quality_rules_measure_every_document(spark):
    got = QUERIES["op11_quality_rules"](spark, SF_SMALL).collect()
    texts = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted((r.doc_id, *brute_measures(r.text)) for r in texts)

"""LM scoring with a hierarchical Pitman-Yor model.

Tokens are lower-cased words and one end per text. Every training word, however
rare, is a symbol of its own: as a context it has a restaurant, and all context
restaurants share one parent restaurant over the words, whose base is uniform
over the training words and one place for all unseen ones. An unseen context
has no guests and answers with the parent. Contexts are one word deep.

Seating is sampled by Gibbs on table counts: given the other dishes' tables,
the number of tables of a dish with c customers is drawn from its exact
conditional (generalised Stirling numbers) up to ``EXACT`` customers; the
customers after those are seated one after another, in growing strides. All
dishes of a restaurant are drawn at once from the last sweep's state.
Predictive probabilities are averaged over ``SAMPLES`` sweeps after ``BURN``.
Draws come from hashes of dish and sweep, so a task that runs again repeats
them.

Nothing of the size of the vocabulary is held by the driver or broadcast: words
and pairs are dealt by hash into buckets, and a bucket's part of a block, of the
counts or of a sweep is a few rows of packed numbers that Spark groups by bucket.
A word or pair seen once has one table and needs no place of its own: a bucket
says "once" and keeps only what was seen twice or more. A word is followed as
often as it comes (END closes the ring), so its count is also its guests, and
what comes once beside it is its count less that of its repeated pairs.

Counts cover all training texts. Texts are never shuffled for counting: a
block is a stretch of an input split, blocks send their distinct words and
pairs to the buckets, and the texts meet their block's answers once. Answers
come in the order of the questions, so they hold no keys.

Defined results: null or empty text is one END token; null ids count as the
empty id in the split and keep their row; repeated rows count and score each;
with no training text every count is 0 and probabilities are the base's; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_mod, mix, ship, slices, text_buffer, words, written
from quarry.session import scratch_path, write_table

BURN, SAMPLES = 2, 3
EXACT = 64
STRENGTH = 1.0
BLOCK_BYTES = 32 << 20
#: Pairs that a task draws at once, and keys of one packed row of a block.
RUN_ROWS, PART_ROWS = 200_000, 10_000
#: Text for each bucket of pairs, about. Two buckets send each other a row a
#: sweep, so there are at most ``MAX_BUCKETS``; from then on they grow.
BUCKET_BYTES, MAX_BUCKETS = 8 << 20, 2048
#: What blocks and buckets send: ``a`` to ``d`` are packed, ``size`` numbers each.
PACKED = "to bigint, kind string, source bigint, part int, size bigint, a binary, b binary, c binary, d binary, x bigint, y bigint, z bigint"
#: The symbol after (and, as a context, before) every text; a fixed value.
END = np.uint64(0x9D39247E33776D41)


def stirling(discount: float, n: int = EXACT) -> np.ndarray:
    """Logs of generalised Stirling numbers S(c, t) for c, t <= n."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0
    with np.errstate(divide="ignore"):
        for c in range(n):
            t = np.arange(n + 1)
            grow = s[c] + np.log(np.maximum(c - discount * t, 0))
            s[c + 1] = grow
            s[c + 1, 1:] = np.logaddexp(grow[1:], s[c, :-1])
    return s


def uniforms(dish: np.ndarray, seed: int) -> np.ndarray:
    return ((mix(dish.view(np.uint64), seed) >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


def draw_tables(c: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, strength: float, dish: np.ndarray, seed: int, logs: np.ndarray) -> np.ndarray:
    """Tables of each dish given the ``others``' tables of its restaurant."""
    t = np.minimum(c, 1)
    u = uniforms(dish, seed)
    head = np.minimum(c, EXACT)
    for k in np.unique(head[head > 1]):
        at = np.flatnonzero(head == k)
        for part in np.array_split(at, 1 + len(at) * int(k) // 2_000_000):
            j = np.arange(k)
            rise = np.cumsum(np.log(np.maximum(strength + discount * (others[part, None] + j), 1e-300)), axis=1)
            z = logs[k, 1 : k + 1] + rise + (j + 1) * np.log(np.maximum(base[part], 1e-300))[:, None]
            p = np.cumsum(np.exp(z - z.max(1, keepdims=True)), axis=1)
            t[part] = 1 + (p < (u[part] * p[:, -1])[:, None]).sum(1)
    at, seated, step = np.flatnonzero(c > EXACT), EXACT, 0
    while len(at):
        stride = max(1, seated // 8)
        m = np.minimum(c[at] - seated, stride)
        new = (strength + discount * (others[at] + t[at])) * base[at]
        p = new / (new + seated + m / 2 - discount * t[at])
        # a binomial by its normal limit, from two hashed uniforms
        a, b = uniforms(dish[at], seed + 1000 + 2 * step), uniforms(dish[at], seed + 1001 + 2 * step)
        z = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
        wide = m * p + z * np.sqrt(m * p * (1 - p))
        few = m * p < 10  # rounded up with the chance of the remainder
        add = np.where(few, np.floor(m * p) + (b < m * p - np.floor(m * p)), np.round(wide))
        t[at] = np.clip(t[at] + add, 1, c[at]).astype(t.dtype)
        seated, step = seated + stride, step + 1
        at = at[c[at] > seated]
    return t


def discount_of(ones: int, twos: int) -> float:
    """The usual estimate from counts of counts."""
    return float(np.clip(ones / max(1, ones + 2 * twos), 0.1, 0.95))


class Texts:
    """Blocks of a batch stream: ``(block, rows)`` with blocks of about
    ``BLOCK_BYTES``; the same stream gives the same blocks."""

    @staticmethod
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        source, used = None, 0
        for batch in batches:
            sources = batch.column("source").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(sources[1:] != sources[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                for part in slices(batch.slice(lo, hi - lo), "text"):
                    s = int(sources[lo])
                    if s != source:
                        source, used = s, 0
                    block = int(mix(np.array([s], np.int64).view(np.uint64), used // BLOCK_BYTES).view(np.int64)[0])
                    used += len(text_buffer(part.column("text"))[0])
                    yield block, part

    @staticmethod
    def sums(stream: Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """``(block, key, context, n)``: distinct pairs of each block, sorted by
        key, with the sum of their weights."""

        def distinct(k, c, w):
            k, first, at = np.unique(k, return_index=True, return_inverse=True)
            return k, c[first], np.bincount(at, weights=w)

        now, held = None, ([], [], [])
        for block, *part in stream:
            if block != now and held[0]:
                yield now, *distinct(*map(np.concatenate, held))
                held = ([], [], [])
            now = block
            if len(part[0]):
                # whole numbers of repeats keep what waits small
                for waiting, x in zip(held, distinct(*part)):
                    waiting.append(x)
        if held[0]:
            yield now, *distinct(*map(np.concatenate, held))


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 in the fewest bytes each, compressed."""
    most = int(numbers.max()) if len(numbers) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + (pa.compress(numbers.astype(f"u{width}").tobytes(), codec="zstd", asbytes=True) if len(numbers) else b"")


def unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    raw = pa.decompress(data[1:], n * data[0], codec="zstd", asbytes=True)
    return np.frombuffer(raw, f"u{data[0]}").astype(np.int64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their steps."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(data, n).view(np.uint64), dtype=np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def dealt(keys: np.ndarray, buckets: int, later: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted ``keys`` by bucket, those that are ``later`` last in
    each, and where the earlier and later keys of each bucket begin."""
    place = 2 * bucket_of(keys, buckets) + (0 if later is None else later)
    order = np.argsort(place.astype(np.uint16 if buckets <= 1 << 15 else np.int64), kind="stable")
    return order, np.append(0, np.cumsum(np.bincount(place, minlength=2 * buckets)))


def message(to: int, kind: str, **values) -> dict:
    return {"to": int(to), "kind": kind, **values}


def batches_of(messages: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Rows of ``PACKED``, a few MB at a time."""
    waiting, held = [], 0
    for row in messages:
        waiting.append(row)
        held += 100 + sum(len(row.get(x) or b"") for x in "abcd")
        if held > 4 << 20:
            yield from _table(waiting).to_batches()
            waiting, held = [], 0
    if waiting:
        yield from _table(waiting).to_batches()


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _table(messages: list[dict]) -> pa.Table:
    names = [x.split() for x in PACKED.split(", ")]
    return pa.table({x: pa.array([row.get(x) for row in messages], _TYPES[t]) for x, t in names})


def questions(block: int, keys: np.ndarray, contexts: np.ndarray | None, n: np.ndarray, buckets: int, first: int, part_rows: int) -> Iterator[dict]:
    """A block's distinct keys to their buckets (numbered from ``first``): what
    it learns from with counts, then what it only asks for."""
    order, starts = dealt(keys, buckets, n == 0)
    for i in np.flatnonzero(np.diff(starts)):
        at = order[starts[i] : starts[i + 1]]
        for part, lo in enumerate(range(0, len(at), part_rows)):
            here = at[lo : lo + part_rows]
            row = message(first + i // 2, "asked" if i % 2 else "seen", source=block, part=2 * part + i % 2, size=len(here), a=packed_keys(keys[here]))
            if not i % 2:
                row["c"] = packed(n[here].astype(np.int64))
                if contexts is not None:
                    row["b"] = contexts[here].tobytes()
            yield row


def tally(table: pa.Table, buckets: int) -> Iterator[dict]:
    """A bucket's counts: keys seen twice or more, how many were seen once, and
    to every question 0 (never), 1 (once) or 2 and more (a place among the
    former)."""
    rows = table.to_pylist()
    to, seen = rows[0]["to"], [r for r in rows if r["kind"] == "seen"]
    empty = np.zeros(0, np.uint64)
    n = np.concatenate([empty.astype(np.int64), *[unpacked(r["c"], r["size"]) for r in seen]])
    keys, at = np.unique(np.concatenate([empty, *[unpacked_keys(r["a"], r["size"]) for r in seen]]), return_inverse=True)
    count = np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)
    many = count > 1
    ref = np.where(many, np.cumsum(many) + 1, 1)
    fact = message(to, "pairs" if to < buckets else "words", size=int(many.sum()), a=packed_keys(keys[many]), c=packed(count[many]))
    if fact["kind"] == "pairs":
        contexts = np.zeros(len(keys), np.uint64)
        contexts[at] = np.concatenate([empty, *[np.frombuffer(r["b"], np.uint64) for r in seen]])
        fact["b"] = contexts[many].tobytes()
    yield fact | {"x": int((count == 1).sum()), "y": int((count == 2).sum()), "z": int(count.sum())}
    lo = 0
    for r in rows:
        if r["kind"] == "seen":
            answer, lo = ref[at[lo : lo + r["size"]]], lo + r["size"]
        else:
            place, found = _places(keys, unpacked_keys(r["a"], r["size"]))
            answer = np.append(ref, 0)[np.where(found, place, len(keys))]
        yield message(to, "ref", source=r["source"], part=r["part"], size=r["size"], a=packed(answer))


def pairs_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, dish and count of a bucket's pairs."""
    context = np.frombuffer(row["b"], np.uint64)
    return context, pair_key(context, unpacked_keys(row["a"], row["size"])), unpacked(row["c"], row["size"])


def sums_of(row: dict, buckets: int) -> tuple:
    """The distinct words of a bucket's pairs in the order of their buckets,
    where each bucket's begin, and each pair's context and dish among them."""
    context, dish, c = pairs_of(row)
    word, at = np.unique(np.concatenate([context, dish]), return_inverse=True)
    order, starts = dealt(word, buckets)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    at = back[at]
    return word[order], starts[::2], at[: len(c)], at[len(c) :], c


def links(row: dict, buckets: int) -> Iterator[dict]:
    """A bucket's pairs make themselves known to the buckets of their words."""
    word, starts, context, dish, c = sums_of(row, buckets)
    sums = [np.bincount(x, weights=w, minlength=len(word)).astype(np.int64) for x, w in ((context, c), (dish, c), (context, np.minimum(c, 1)))]
    for i in np.flatnonzero(np.diff(starts)):
        lo, hi = starts[i], starts[i + 1]
        yield message(buckets + i, "link", source=row["to"], size=int(hi - lo), a=packed_keys(word[lo:hi]), **{x: packed(s[lo:hi]) for x, s in zip("bcd", sums)})


def linked(table: pa.Table) -> Iterator[dict]:
    """A bucket's words with what comes once beside them, as context and as
    dish, the places of the words that each bucket of pairs uses, and its first
    answers to these: tables in the context, and the count."""
    rows = table.to_pylist()
    word = next(r for r in rows if r["kind"] == "words")
    size, keys, c = word["size"], unpacked_keys(word["a"], word["size"]), unpacked(word["c"], word["size"])
    again, tables, found = [c.copy(), c.copy()], np.zeros(size, np.int64), []
    for r in rows:
        if r["kind"] == "link":
            at, known = _places(keys, unpacked_keys(r["a"], r["size"]))
            if not known.all():
                raise RuntimeError("a repeated pair of a word that was not counted")
            found.append((r, at))
            again[0][at] -= unpacked(r["b"], r["size"])
            again[1][at] -= unpacked(r["c"], r["size"])
            tables[at] += unpacked(r["d"], r["size"])
    yield message(word["to"], "word", size=size, a=packed_keys(keys), b=packed(c), c=packed(again[0]), d=packed(again[1]))
    yield message(word["to"], "root", size=size, a=packed(np.ones(size, np.int64)))
    for r, at in found:
        yield message(word["to"], "place", source=r["source"], size=r["size"], a=packed(at))
        yield message(r["source"], "answer", source=word["to"], size=r["size"], a=packed((again[0] + tables)[at]), b=packed(c[at]), c=packed(np.zeros(len(at), np.int64)))


def drawn(table: pa.Table, buckets: int, seed: int, discount: float, p) -> Iterator[dict]:
    """A sweep over a bucket's pairs: their tables, summed for their words'
    buckets. ``p``: the parent's probability from what an answer holds."""
    rows = table.to_pylist()
    pairs = next(r for r in rows if r["kind"] == "pairs")
    _, starts, context, dish, c = sums_of(pairs, buckets)
    t = next((unpacked(r["a"], r["size"]) for r in rows if r["kind"] == "tables"), np.minimum(c, 1))
    heard = sorted((r for r in rows if r["kind"] == "answer"), key=lambda r: r["source"])
    total, b, d = (np.concatenate([np.zeros(0, np.int64), *[unpacked(r[x], r["size"]) for r in heard]]) for x in "abc")
    key, parent, logs = unpacked_keys(pairs["a"], pairs["size"]).view(np.int64), p(b, d), stirling(discount)
    new = np.empty_like(t)
    for lo in range(0, len(c), RUN_ROWS):
        x = slice(lo, lo + RUN_ROWS)
        new[x] = draw_tables(c[x], parent[dish[x]], total[context[x]] - t[x], discount, STRENGTH, key[x], seed, logs)
    yield message(pairs["to"], "tables", size=len(c), a=packed(new))
    sums = [np.bincount(x, weights=new, minlength=int(starts[-1])).astype(np.int64) for x in (context, dish)]
    for i in np.flatnonzero(np.diff(starts)):
        lo, hi = starts[i], starts[i + 1]
        yield message(buckets + i, "sums", source=pairs["to"], size=int(hi - lo), a=packed(sums[0][lo:hi]), b=packed(sums[1][lo:hi]))


def rooted(table: pa.Table, seed: int, base: float, root_total: int, root_discount: float) -> Iterator[dict]:
    """A sweep over a bucket's words in the parent: tables there (``a``), guests
    there (``b``) and tables in the word's own restaurant (``c``)."""
    rows = table.to_pylist()
    word, root = (next(r for r in rows if r["kind"] == x) for x in ("word", "root"))
    size, places = word["size"], {r["source"]: unpacked(r["a"], r["size"]) for r in rows if r["kind"] == "place"}
    own, m = unpacked(word["c"], size), unpacked(word["d"], size)
    for r in rows:
        if r["kind"] == "sums":
            own[places[r["source"]]] += unpacked(r["a"], r["size"])
            m[places[r["source"]]] += unpacked(r["b"], r["size"])
    last, key, logs = unpacked(root["a"], size), unpacked_keys(word["a"], size).view(np.int64), stirling(root_discount)
    new = np.empty_like(m)
    for lo in range(0, size, RUN_ROWS):
        x = slice(lo, lo + RUN_ROWS)
        new[x] = draw_tables(m[x], np.full(len(m[x]), base), root_total - last[x], root_discount, STRENGTH, key[x], seed, logs)
    yield message(word["to"], "root", size=size, a=packed(new), b=packed(m), c=packed(own), x=int(new.sum()), y=int(m.sum()))
    for source, at in places.items():
        yield message(source, "answer", source=word["to"], size=len(at), a=packed(own[at]), b=packed(m[at]), c=packed(new[at]))


def answers(table: pa.Table) -> Iterator[dict]:
    """What a bucket tells each block: of a pair its count and the sum of its
    tables in the samples; of a word its count and, for each sample, the tables
    in its restaurant, its guests and its tables in the parent."""
    rows = table.to_pylist()
    fact = next(r for r in rows if r["kind"] in ("pairs", "word"))
    size, samples = fact["size"], sorted((r for r in rows if r["kind"] in ("tables", "root")), key=lambda r: r["part"])
    taken = {x: [unpacked(r[x], size) for r in samples] for x in ("a" if fact["kind"] == "pairs" else "abc")}
    if fact["kind"] == "pairs":
        columns = [[unpacked(fact["c"], size)], [np.sum(taken["a"], axis=0)]]
        once = [1, SAMPLES]
    else:
        columns = [[unpacked(fact["b"], size)], taken["c"], taken["b"], taken["a"]]
        once = [1, 1, 1, 1]
    # never, once, and the places
    columns = [[np.concatenate([[0, one], x]).astype(np.int64) for x in group] for one, group in zip(once, columns)]
    for r in rows:
        if r["kind"] == "ref":
            ref = unpacked(r["a"], r["size"])
            told = {x: packed(np.concatenate([column[ref] for column in group])) for x, group in zip("abcd", columns)}
            yield message(r["source"], fact["kind"], source=fact["to"], part=r["part"], size=r["size"], **told)


def sequence(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows with END after each row, the word before each (END
    before a row's first), and each row's first place."""
    rows = len(first) - 1
    out = np.full(len(hashes) + rows, END, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(rows), np.diff(first))] = hashes
    return out, np.concatenate([[END], out])[:-1].astype(np.uint64), first + np.arange(rows + 1)


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A pair's 64-bit key; with the key for ``word`` it gives the word back."""
    return word ^ (context << np.uint64(1) | context >> np.uint64(63))


def _restaurants(frame: pa.Table, size: int, parents: list[np.ndarray], discount: float, sweeps: int):
    """The chain of all contexts in one ``frame`` (sorted by key) held in memory:
    keys, counts and the tables after each sweep. The chain over buckets below
    draws the same way; tests use this one."""
    key, c = frame.column("key").to_numpy(), frame.column("c").to_numpy()
    logs = stirling(discount)
    context, dish = key // size, key % size
    starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    length = np.diff(np.append(starts, len(key)))
    t, out = np.minimum(c, 1), []
    for s in range(sweeps):
        total = np.repeat(np.add.reduceat(t, starts), length)
        t = draw_tables(c, parents[s][dish], total - t, discount, STRENGTH, key, 10_000 * s, logs)
        out.append(t)
    return key, c, context, dish, starts, out


def fit_and_score(df: DataFrame, text: str = "text", key: str = "doc_id", in_place: bool = False) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score``
    of every row; rows whose crc32 of the id mod 7 is not 2 are learnt from.
    ``in_place``: ``df`` is a plain scan of files and need not be written
    first (blocks are named by file and split)."""
    ship(df)
    kind = df.schema[key].dataType.simpleString()
    docs = df.select(F.col(key).alias("k"), F.col(text).alias("text"))
    if not in_place:
        docs = written(docs, "lm-texts")
    docs = docs.select("k", "text", (crc_mod(F.col("k"), 7) != 2).alias("train"), F.xxhash64(F.input_file_name(), F.input_file_block_start()).alias("source"))

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, part_rows = min(MAX_BUCKETS, 1 + size // BUCKET_BYTES), PART_ROWS

    def kept(name: str, rows: DataFrame) -> DataFrame:
        path = scratch_path(df.sparkSession, f"lm-{name}")
        write_table(rows, path)
        return df.sparkSession.read.schema(PACKED).parquet(path)

    def grouped(rows: DataFrame, step, *args) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            return _table(list(step(table, *args)))

        return rows.groupBy("to").applyInArrow(run, PACKED)

    def of(rows: DataFrame, *kinds: str) -> DataFrame:
        return rows.where(F.col("kind").isin(*kinds))

    # 1. the blocks' distinct words and pairs, and all counts
    def ask(batches):
        def stream():
            for block, part in Texts.blocks(batches):
                seq, before, first = sequence(*words(*text_buffer(part.column("text"))))
                train = part.column("train").to_numpy(zero_copy_only=False).astype(np.float64)
                yield block, pair_key(before, seq), before, np.repeat(train, np.diff(first))

        def rows():
            for block, keys, contexts, n in Texts.sums(stream()):
                yield from questions(block, keys, contexts, n, buckets, 0, part_rows)
                word, n = block_words(keys, contexts, n)
                yield from questions(block, word, None, n, buckets, buckets, part_rows)

        yield from batches_of(rows())

    counted = kept("counts", grouped(docs.mapInArrow(ask, PACKED), tally, buckets))
    pairs, wordy, refs = of(counted, "pairs"), of(counted, "words"), of(counted, "ref")
    stats = counted.where("kind != 'ref'").groupBy((F.col("to") >= buckets).alias("word")).agg(*[F.sum(x).alias(x) for x in ("x", "y", "z", "size")])
    stats = {r.word: r for r in stats.collect()}  # two rows
    if True not in stats:
        return df.sparkSession.createDataFrame([], scored_schema(key, kind))
    discount = discount_of(stats[False].x, stats[False].y)
    train_tokens, once = stats[True].z, stats[True].x
    types = once + stats[True]["size"]
    base = 1 / (types + 1)

    # 2. sweeps: a restaurant for each context, one parent for all
    def link(batches):
        yield from batches_of(m for batch in batches for row in batch.to_pylist() for m in links(row, buckets))

    known = kept("words", grouped(wordy.unionByName(pairs.mapInArrow(link, PACKED)), linked))
    word, places = of(known, "word"), of(known, "place")
    roots, heard, tables = of(known, "root"), of(known, "answer"), []
    root_discount, root_total = 0.5, types
    levels, samples = [], []  # the parent's guests and leftover, and the roots, of each sample
    parent = lambda c, none: (c + 1) / float(train_tokens + types + 1)
    for s in range(BURN + SAMPLES):
        state = pairs.unionByName(heard)
        swept = kept(f"sweep-{s}", grouped(state.unionByName(tables[-1]) if tables else state, drawn, buckets, 10_000 * s, discount, parent))
        tables.append(of(swept, "tables"))
        state = word.unionByName(places).unionByName(roots).unionByName(of(swept, "sums"))
        root = kept(f"root-{s}", grouped(state, rooted, 10_000 * s + 3, base, root_total, root_discount))
        roots, heard = of(root, "root"), of(root, "answer")
        stat = roots.agg(F.sum("x"), F.sum("y")).first()
        root_total, guests = (stat[0] or 0) + once, (stat[1] or 0) + once
        leftover = (STRENGTH + root_discount * root_total) / (STRENGTH + guests) * base
        parent = above(guests, leftover, root_discount)
        if s >= BURN:
            levels.append((guests, leftover))
            samples.append(roots)

    # 3. answers: words as dish and as context, and what pairs add
    told = pairs.unionByName(word).unionByName(refs)
    for i, rows in enumerate([*tables[BURN:], *samples]):
        told = told.unionByName(rows.withColumn("part", F.lit(i)))
    told = kept("answers", grouped(told, answers))

    # 4. texts meet their block's answers
    def place(batches):
        for block, part in Texts.blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, block, np.int64)), part.column("k"), part.column("train"), part.column("text")], names=["block", "k", "train", "text"])

    texts = docs.mapInArrow(place, f"block bigint, k {kind}, train boolean, text string")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score_block(left, right, buckets, discount, root_discount, levels, train_tokens + types + 1)

    schema = f"k {kind}, n_tokens bigint, n_known bigint, base_score double, score double"
    scored = texts.groupBy("block").cogroup(told.groupBy("to")).applyInArrow(score, schema)
    return scored.select(
        F.col("k").alias(key), (crc_mod(F.col("k"), 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def scored_schema(key: str, kind: str) -> str:
    return f"{key} {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def block_words(keys: np.ndarray, contexts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of distinct pairs, and their counts."""
    word, at = np.unique(pair_key(contexts, keys), return_inverse=True)
    return word, np.bincount(at, weights=n)


def above(guests: int, leftover: float, root_discount: float):
    """The parent's probability of words with ``m`` guests at ``root`` tables."""
    return lambda m, root: (m - root_discount * root) / (STRENGTH + guests) + leftover


def _places(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is among the sorted ``keys``, and whether it is."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _told(rows: list[dict], column: str, wide: int, order: np.ndarray) -> np.ndarray:
    """A column of a block's answers, ``wide`` numbers a key, by its sorted keys."""
    out = np.zeros((wide, len(order)), np.int64)
    if sum(r["size"] for r in rows) != len(order):
        raise RuntimeError("a block's words changed between two scans of the input")
    if rows:
        out[:, order] = np.concatenate([unpacked(r[column], wide * r["size"]).reshape(wide, -1) for r in rows], axis=1)
    return out


def _score_block(left: pa.Table, right: pa.Table, buckets: int, discount: float, root_discount: float, levels: list, base_total: int) -> pa.Table:
    held, sums = [], ([], [], [])
    for batch in left.select(["k", "train", "text"]).combine_chunks().to_batches():
        for part in slices(batch, "text"):
            seq, before, first = sequence(*words(*text_buffer(part.column("text"))))
            train = part.column("train").to_numpy(zero_copy_only=False).astype(np.float64)
            pair, at, which = np.unique(pair_key(before, seq), return_index=True, return_inverse=True)
            for waiting, x in zip(sums, (pair, before[at], np.bincount(which, weights=np.repeat(train, np.diff(first))))):
                waiting.append(x)
            held.append((part.column("k"), seq, first, pair, which))
    if not held:
        return pa.table({"k": left.column("k"), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
    pairs, first, at = np.unique(np.concatenate(sums[0]), return_index=True, return_inverse=True)
    n = np.bincount(at, weights=np.concatenate(sums[2]))
    word, n_word = block_words(pairs, np.concatenate(sums[1])[first], n)
    # answers in the order of the questions: by bucket, and in it by part
    heard = right.to_pylist()
    by_kind = [sorted((r for r in heard if r["kind"] == x), key=lambda r: (r["source"], r["part"] % 2, r["part"])) for x in ("pairs", "word")]
    order = [dealt(x, buckets, y == 0)[0] for x, y in ((pairs, n), (word, n_word))]
    value = _told(by_kind[0], "a", 1, order[0])[0] - discount * (_told(by_kind[0], "b", 1, order[0])[0] / SAMPLES)
    count, own, m, root = (_told(by_kind[1], x, wide, order[1]) for x, wide in zip("abcd", (1, SAMPLES, SAMPLES, SAMPLES)))
    count = count[0]
    share = (STRENGTH + discount * own) / (STRENGTH + count)
    p = np.stack([above(*level, root_discount)(m[i], root[i]) for i, level in enumerate(levels)])
    logs_base = np.log10((count + 1) / base_total)
    end = np.searchsorted(word, END)
    rows = []
    for k, seq, first, pair, which in held:
        at = np.searchsorted(word, seq)
        ahead = np.append(end, at[:-1])
        added = value[np.searchsorted(pairs, pair)][which] / (STRENGTH + count[ahead])
        rest = np.zeros(len(seq))
        for i in range(SAMPLES):
            rest += share[i][ahead] * p[i][at]
        logs = np.log10(added + rest / SAMPLES)
        rows.append(
            pa.RecordBatch.from_arrays(
                [k, pa.array(np.diff(first)), pa.array(np.add.reduceat((count[at] > 0).astype(np.int64), first[:-1])), pa.array(np.add.reduceat(logs_base[at], first[:-1])), pa.array(np.add.reduceat(logs, first[:-1]))],
                names=["k", "n_tokens", "n_known", "base_score", "score"],
            )
        )
    return pa.Table.from_batches(rows)

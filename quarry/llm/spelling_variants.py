"""Spelling variant grouping by FM-index search schemes.

Words are counted over the whole corpus; two words are near if one insertion,
deletion or replacement of a code point turns one into the other. Near words
are found by a search scheme for one error over a bidirectional FM-index: of
the two halves of a word at least one holds no error, so either the right half
and the closing delimiter are matched exactly, right to left, and the search
goes on over the left half, or the left half and the opening delimiter are
matched left to right (in the index of the reversed text) and the search goes
on over the right half. In the second part one error is allowed. A search is
a set of suffix-rank intervals over the text of all words between delimiters;
it ends with the other delimiter, so whole words are matched. The shorter
word of a pair searches for the longer one, hence the errors are a replaced or
an added code point. For one error neither search turns round, so no interval
has to be kept in step in both directions.

No task holds the whole vocabulary: a pair shares its exact half, so words
are dealt by (side, length of the half, half). A word searches under its own
halves; it can be found under the halves of words as long as it or shorter by
one, so it is sent to at most four places. A half that more than ``SHARD``
words share is cut by a hash of the found word, and the searching words go to
each cut. A task takes whole shards until they hold ``SHARD`` words, builds
the index of those, searches it and lets it go.

Forms: a word's form is its near word of largest count (ties: the smallest in
code-point order) if that count is at least ``RATIO`` times its own. Counts
at least double along the chain of forms, which is followed by pointer
doubling (joins of the words that have a form).

Defined results: null and empty texts have no word; null ids count as an empty
text in the hash of a run; repeated rows count each; no word at all gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import mix, ship, slices, text_buffer, written
from quarry.llm.graph import groups

MIN_LENGTH, MIN_COUNT = 5, 3
RATIO = 2
#: One in so many (document, run) pairs loses a code point.
DROP = 97
#: Code points of the words that one index is built over, about.
POINTS = 400_000

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240517).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, end and row of each maximal run of ``[A-Za-z\\u00C0-\\u00FF]``
    (two bytes C3 80 to C3 BF in UTF-8)."""
    lead = data == 0xC3
    solid = _ALPHA[data] | lead
    solid[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (edge[:-1] | np.concatenate([[True], ~solid[:-1]])))
    ends = np.flatnonzero(solid & (edge[1:] | np.concatenate([~solid[1:], [True]]))) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def counted(col, ids: list) -> tuple[list[str], np.ndarray]:
    """Distinct words of a slice of texts and their occurrences."""
    data, offsets = text_buffer(col)
    data = _LOWER[data]
    starts, ends, rows = _runs(data, offsets)
    size = ends - starts
    # too short even if no code point is lost; a code point has at most 2 bytes
    some = size >= MIN_LENGTH
    starts, ends, rows, size = starts[some], ends[some], rows[some], size[some]
    if not len(starts):
        return [], np.zeros(0, np.int64)
    h = np.zeros(len(starts), np.uint64)
    prefix = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in ids], np.uint32) ^ np.uint32(0xFFFFFFFF)
    crc = prefix[rows]
    order = np.argsort(-size, kind="stable")
    first, sorted_size = starts[order], -size[order]
    hs, crcs = h[order], crc[order]
    for j in range(int(size.max())):
        live = int(np.searchsorted(sorted_size, -j, side="left"))  # runs of over j bytes
        b = data[first[:live] + j]
        hs[:live] += _VALUES[b] * np.uint64(pow(_BASE, j, 1 << 64))
        crcs[:live] = _CRC[(crcs[:live] ^ b) & 0xFF] ^ crcs[:live] >> 8
    h[order], crc[order] = mix(hs), crcs ^ np.uint32(0xFFFFFFFF)
    raw = data.tobytes()
    lost = crc % DROP == 0
    found: dict[str, int] = {}
    for i in np.flatnonzero(lost):
        run = raw[starts[i] : ends[i]].decode()
        at = int(crc[i]) % len(run)
        word = run[:at] + run[at + 1 :]
        found[word] = found.get(word, 0) + 1
    kept = np.flatnonzero(~lost)
    _, at, n = np.unique(h[kept], return_index=True, return_counts=True)
    for i, k in zip(kept[at].tolist(), n.tolist()):
        word = raw[starts[i] : ends[i]].decode()
        found[word] = found.get(word, 0) + k
    words = [w for w in found if len(w) >= MIN_LENGTH]
    return words, np.array([found[w] for w in words], np.int64)


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``word, n`` of all words of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "text"):
                words, n = counted(part.column("text"), part.column("k").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    ship(docs)
    rows = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


class FMIndex:
    """Suffix-rank intervals over a text of symbols 0 (delimiter) .. sigma-1,
    extended to the left. The text is a circle, so every row has a symbol
    before it."""

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        rank, width = text.astype(np.int64), 1
        while True:
            key = rank * (n + sigma) + np.roll(rank, -width)
            order = np.argsort(key, kind="stable")
            step = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = step
            width *= 2
            if step[-1] == n - 1 or width >= 2 * n:
                break
        self.n, self.sigma, self.place = n, sigma, order
        before = text[order - 1].astype(np.int64)  # place 0 looks at the last one
        #: (symbol, row) pairs in order: the rank of a symbol is one lookup
        self.keys = np.sort(before * n + np.arange(n))

    def extended(self, lo: np.ndarray, hi: np.ndarray, symbol) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the strings with ``symbol`` put before them."""
        return np.searchsorted(self.keys, symbol * self.n + lo), np.searchsorted(self.keys, symbol * self.n + hi)

    def exact(self, patterns: np.ndarray, lengths: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """Extend by the first ``lengths`` symbols of each row of ``patterns``,
        one after another."""
        lo, hi = lo.copy(), hi.copy()
        for j in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((j < lengths) & (lo < hi))
            lo[live], hi[live] = self.extended(lo[live], hi[live], patterns[live, j])
        return lo, hi

    def one_error(self, patterns: np.ndarray, done: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(query, row)`` of every match of delimiter, pattern, delimiter:
        the first ``done`` symbols without an error, in the rest exactly one
        replaced symbol or one added symbol of the text."""
        q = len(patterns)
        lo, hi = self.extended(np.zeros(q, np.int64), np.full(q, self.n), 0)
        lo, hi = self.exact(patterns, done, lo, hi)
        who, at = np.arange(q), done.copy()
        found_who, found_row = [], []
        strays = [(np.zeros(0, np.int64),) * 4]
        symbols = np.arange(1, self.sigma)
        while len(who):
            live = lo < hi
            who, at, lo, hi = who[live], at[live], lo[live], hi[live]
            if not len(who):
                break
            # every symbol that may come next, for the searches without an error
            for i in range(0, len(who), 1 << 14):
                part = slice(i, i + (1 << 14))
                a = np.repeat(np.arange(len(who[part])), len(symbols))
                c = np.tile(symbols, len(who[part]))
                nlo, nhi = self.extended(lo[part][a], hi[part][a], c)
                full = np.flatnonzero(nlo < nhi)
                a, c, nlo, nhi = a[full], c[full], nlo[full], nhi[full]
                w, k = who[part][a], at[part][a]
                wanted = np.where(k < lengths[w], patterns[w, np.minimum(k, patterns.shape[1] - 1)], 0)
                inside = (k < lengths[w]) & (c != wanted)
                strays.append((w[inside], k[inside] + 1, nlo[inside], nhi[inside]))  # replaced
                # added before the wanted symbol; one equal to it is added later in the same place
                added = c != wanted
                strays.append((w[added], k[added], nlo[added], nhi[added]))
            more = np.flatnonzero(at < lengths[who])
            who, at, lo, hi = who[more], at[more], lo[more], hi[more]
            lo, hi = self.extended(lo, hi, patterns[who, at])
            at = at + 1
        who, at, lo, hi = (np.concatenate(x) for x in zip(*strays))
        while len(who):
            over = at == lengths[who]
            last = np.flatnonzero(over)
            elo, ehi = self.extended(lo[last], hi[last], 0)
            size = ehi - elo
            found_who.append(np.repeat(who[last], size))
            found_row.append(np.repeat(elo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            rest = np.flatnonzero(~over)
            who, at, lo, hi = who[rest], at[rest], lo[rest], hi[rest]
            lo, hi = self.extended(lo, hi, patterns[who, at])
            at = at + 1
            live = np.flatnonzero(lo < hi)
            who, at, lo, hi = who[live], at[live], lo[live], hi[live]
        if not found_who:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_who), np.concatenate(found_row)


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words as rows (0 where a word has ended) and lengths."""
    table = np.array(words, dtype=np.str_)
    points = table.view(np.uint32).reshape(len(words), -1) if len(words) else np.zeros((0, 1), np.uint32)
    return points.astype(np.int64), np.char.str_len(table).astype(np.int64) if len(words) else np.zeros(0, np.int64)


def near_words(targets: list[str], queries: list[str], right: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(query, target)`` places of the pairs one replaced or added code point
    apart whose right halves (``right``) or left halves are equal."""
    points, size = _matrix(targets)
    asked, length = _matrix(queries)
    alphabet = np.unique(np.concatenate([points[points > 0], asked[asked > 0]]))
    code = lambda m: np.where(m > 0, np.searchsorted(alphabet, m) + 1, 0)
    points, asked = code(points), code(asked)
    column = np.arange(points.shape[1])
    text = points if right else np.where(column < size[:, None], np.take_along_axis(points, np.maximum(size[:, None] - 1 - column, 0), 1), 0)
    # the index extends to the left, so a pattern is put in from its end
    from_end = np.maximum(length[:, None] - 1 - np.arange(asked.shape[1]), 0)
    pattern = np.take_along_axis(asked, from_end, 1) if right else asked
    inside = np.concatenate([np.ones((len(text), 1), bool), column < size[:, None]], axis=1)
    flat = np.concatenate([np.zeros((len(text), 1), np.int64), text], axis=1)[inside]
    index = FMIndex(flat, len(alphabet) + 1)
    half = length // 2
    who, row = index.one_error(pattern, length - half if right else half, length)
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    return who, np.searchsorted(starts, index.place[row])


def _dealt(words: DataFrame) -> DataFrame:
    """``right, half, shard, searches, word, n``: words under their own halves
    (searching and to be found) and under those of words shorter by one."""
    size = F.char_length("word")
    places = []
    for right in (False, True):
        of = lambda length: (length + int(right)) / 2
        own = F.floor(of(size)).cast("int")
        for shorter in (0, 1):
            half = F.floor(of(size - shorter)).cast("int")
            piece = F.col("word").substr(size - half + 1, half) if right else F.col("word").substr(F.lit(1), half)
            place = F.struct(F.lit(int(right)).alias("right"), half.alias("half"), piece.alias("piece"), F.lit(not shorter).alias("searches"))
            places.append(F.when(half != own, place) if shorter else place)
    rows = words.select("word", "n", F.explode(F.array(*places)).alias("at")).where("at is not null").select("word", "n", "at.*")
    cuts = rows.groupBy("right", "piece").agg(F.ceil(F.sum(F.char_length("word")) / POINTS).cast("int").alias("cuts"))
    rows = rows.join(cuts, ["right", "piece"]).withColumn("own", F.pmod(F.xxhash64("word"), F.col("cuts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    found = rows.withColumn("searches", F.lit(False)).withColumn("shard", F.xxhash64("right", "piece", "own", "other"))
    asks = rows.where("searches").withColumn("shard", F.xxhash64("right", "piece", "other", "own"))
    return found.unionByName(asks).select("right", "half", "shard", "searches", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: every word with each of its near words."""

    def search(waiting: list[pa.Table]):
        t = pa.concat_tables(waiting)
        right = bool(t.column("right")[0].as_py())
        rows = list(zip(t.column("searches").to_pylist(), t.column("word").to_pylist(), t.column("n").to_pylist()))
        targets, queries = ({w: n for asks, w, n in rows if asks == side} for side in (False, True))
        if not queries or not targets:
            return
        i, j = near_words(list(targets), list(queries), right)
        (q, qn), (t, tn) = ((pa.array(list(x), pa.string()), pa.array(list(x.values()), pa.int64())) for x in (queries, targets))
        q, qn, t, tn = q.take(pa.array(i)), qn.take(pa.array(i)), t.take(pa.array(j)), tn.take(pa.array(j))
        for columns in ((q, qn, t, tn), (t, tn, q, qn)):
            yield pa.RecordBatch.from_arrays(list(columns), names=["word", "n", "other", "other_n"])

    def run(batches: Iterator[pa.RecordBatch]):
        waiting, size, side = [], 0, None
        for g in groups(batches, ("right", "half", "shard")):
            width = 2 * g.column("half")[0].as_py() + 2
            now = g.column("right")[0].as_py()
            if waiting and (size + len(g) * width > POINTS or now != side):
                yield from search(waiting)
                waiting, size = [], 0
            side = now
            waiting.append(g)
            size += len(g) * width
        if waiting:
            yield from search(waiting)

    columns = "right", "half", "shard"
    # a word is sent to about five places; tasks are cut to about one index
    points = words.agg(F.sum(F.char_length("word"))).first()[0] or 0
    dealt = _dealt(words).repartition(5 * points // POINTS + 1, "shard").sortWithinPartitions(*columns)
    pairs = dealt.mapInArrow(run, "word string, n bigint, other string, other_n bigint")
    return pairs.repartition("word").dropDuplicates(["word", "other"])


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form (``word, form``): pointers
    are doubled until none moves."""
    state = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = state.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        moved = written(moved, "roots")
        state = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            return state


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root``: one row per word."""
    words = written(vocabulary(docs), "vocabulary")
    pairs = near_pairs(words)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("best"), F.first("n").alias("n"))
    best = best.withColumn("of", -F.col("best.n") >= RATIO * F.col("n"))
    best = written(best.select("word", "n_near", F.when(F.col("of"), F.col("best.form")).alias("form"), F.when(F.col("of"), -F.col("best.n")).alias("form_n")), "near-words")
    chain = roots(best.where("form is not null").select("word", "form"))
    out = words.join(best, "word", "left").join(chain, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))

"""Secret scans by dictionary-primed zstandard novelty.

Base kinds are found by fixed patterns. The method adds kind ``novel``: a
candidate is a run of key-like characters with letters and digits shortly
before or after a sensitive word, also glued to it or to a ``name=``. Its surprise is the number of bytes it adds to a
zstandard frame that is primed with the identifier dictionary and the text
around the candidate (both sides, all copies of the candidate cut out),
divided by its length; what resembles its surroundings compresses away, a
random key does not. A key that was found is reported wherever the text holds
it as a run or a value of its own, near a sensitive word or not. Base spans get the same figure but stay whatever it is.

Defined results: null or empty text has no spans; repeated rows are scanned
each; extra columns are ignored; spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ship

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a maximal run of 16+ characters
HEX = re.compile(r"[0-9a-f]{32,}")
#: Words that make a context sensitive; fixed values of this operator.
SENSITIVE = re.compile(r"credential|private.?key|access.?key|client.?secret|authorization|bearer|passphrase|password|passwd|secret|token|api.?key|signature", re.I | re.A)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: A value without its name: it may start after a '=' and holds none but padding.
VALUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Common identifiers, as a priming dictionary; fixed values of this operator.
IDENTIFIERS = (
    "abstract argument array assert async await boolean break buffer bytes callback case catch char class client close "
    "config connection const constructor content context continue count create database debug default delete document "
    "double element else encoding endpoint environment error event except exception execute export extends false file "
    "final float format function handler header host http https implements import index input instance interface integer "
    "iterator lambda length localhost logger message method module namespace null object output package parameter path "
    "port private property protected protocol public query raise read request response result return schema self server "
    "session settings static status string struct super switch table template this throw timeout true type undefined "
    "update upload user username value variable version void while write yield example sample placeholder changeme your "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
).encode()
REACH = 48
CONTEXT = 1024
NOVELTY = 0.75


def surprise(text: str, start: int, end: int, context: int = CONTEXT, dictionary: bytes = IDENTIFIERS) -> float:
    """Marginal compressed bytes per byte of ``text[start:end]``."""
    import zstandard

    around = (text[max(0, start - context) : start] + " " + text[end : end + context]).replace(text[start:end], " ")
    prime = zstandard.ZstdCompressionDict(dictionary + around.encode("utf-8", "replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=5, dict_data=prime, write_checksum=False, write_content_size=False, write_dict_id=False)
    raw = text[start:end].encode("utf-8", "replace")
    return max(0, len(press.compress(raw)) - len(press.compress(b""))) / max(1, len(raw))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by start, then kind. The run patterns demand the length at
    once, which finds the same maximal runs as matching first and dropping."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


Spans = list[tuple[int, int]]


def candidates(text: str, words: list[re.Match], runs: Spans, values: Spans, reach: int = REACH) -> Iterator[tuple[int, int]]:
    """Candidate spans of all sensitive ``words``: whole ``runs`` first, then
    ``values`` of a ``name=value``, then what is glued to a word itself."""
    for spans in (runs, values):
        for word in words:
            yield from spans[bisect_left(spans, (word.end(), 0)) : bisect_left(spans, (word.end() + reach, 0))]
            k = bisect_left(spans, word.start() + 1, key=lambda s: s[1]) - 1  # ends are sorted too
            while k >= 0 and spans[k][1] >= word.start() - reach:
                yield spans[k]
                k -= 1
    for word in words:
        for place in (word.start(), word.end() - 1):
            k = bisect_left(values, (place + 1, 0)) - 1
            if k >= 0 and (span := values[k])[1] > place:
                yield from [s for s in ((word.end(), span[1]), (span[0], word.start())) if s[1] - s[0] >= 16]


class Taken:
    """Places already taken, as disjoint intervals in order."""

    def __init__(self, spans: Spans):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)  # intervals from k on start at or after b
        return k == 0 or self.ends[k - 1] <= a

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def scan(text: str, novelty: float = NOVELTY, reach: int = REACH) -> list[tuple[str, int, int, float]]:
    base = base_spans(text)
    out = [(k, a, b, surprise(text, a, b)) for k, a, b in base]
    words = list(SENSITIVE.finditer(text))
    if words:
        taken = Taken([(a, b) for _, a, b in base])
        runs, values = ([m.span() for m in p.finditer(text)] for p in (CANDIDATE, VALUE))
        seen, keys = set(), set()
        for a, b in candidates(text, words, runs, values, reach):
            if (a, b) in seen:
                continue
            seen.add((a, b))
            span = text[a:b]
            mixed = re.search("[0-9]", span) and re.search("[A-Za-z]", span)
            if mixed and taken.free(a, b) and (x := surprise(text, a, b)) >= novelty:
                out.append(("novel", a, b, x))
                taken.add(a, b)
                keys.add(span)
        for a, b in (s for spans in (runs, values) for s in spans if keys):
            if text[a:b] in keys and taken.free(a, b):
                out.append(("novel", a, b, surprise(text, a, b)))
                taken.add(a, b)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def secrets(df: DataFrame, text: str = "text", key: str = "doc_id", novelty: float = NOVELTY, reach: int = REACH) -> DataFrame:
    """``key, spans: array<struct<kind, start, end, surprise>>`` per row; a
    narrow map, no shuffle."""
    ship(df)
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]):
        for pdf in frames:
            spans = [[dict(zip(("kind", "start", "end", "surprise"), s)) for s in scan(t, novelty, reach)] if t else [] for t in pdf["text"]]
            yield pd.DataFrame({"k": pdf["k"], "spans": spans})

    found = df.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInPandas(run, f"k {kind}, spans array<struct<kind:string,start:bigint,end:bigint,surprise:double>>")
    return found.withColumnRenamed("k", key)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts per kind and the joined spans of ``secrets``."""
    label = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        key,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"),
    )


def redact(df: DataFrame, text: str = "text", mask: str = "[SECRET]", novelty: float = NOVELTY) -> DataFrame:
    """``df`` with every found span of ``text`` replaced by ``mask``."""
    ship(df)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(t):
            if not t:
                return t
            end, parts = 0, []
            for _, a, b, _ in scan(t, novelty):
                if b > end:
                    parts += [t[end:a], mask] if a >= end else []
                    end = b
            return "".join([*parts, t[end:]])

        return texts.map(one)

    return df.withColumn(text, clean(F.col(text)))

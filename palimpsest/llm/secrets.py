"""Secret scans by sliding-window Shannon entropy per character class.

Candidates are maximal runs of 20 or more ASCII letters, digits and `+ / _ -`.
In a candidate, every maximal run of a class's characters is swept by a window
of the class's size; counts change by one character in and one out, and with
them the entropy.  A window at or above the class's threshold, which also holds
the kinds of characters that the class asks for, makes the candidate a secret.
The allow-list suppresses candidates that are placeholders, digests named as
such, or segments of a URL's path; of one that begins in the host, only what
stands before the path counts.  User info, queries and fragments of URLs, and
what follows a URL without white space, are scanned like other text.

Defined cases: null and empty texts have no findings and come back as they are;
a null doc_id is reported as null; repeated rows are reported once each; texts
are scanned whole; positions count characters; an empty table gives an empty
one; other columns stay as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
REDACTED = "[SECRET]"
_FIND = re.compile(CANDIDATE)


class Class(NamedTuple):
    name: str
    run: re.Pattern
    window: int
    threshold: float
    #: How many of each kind a window must hold: lower case, upper case, digits.
    lower: int
    upper: int
    digits: int


#: In order of preference: the first class that a candidate meets names it.
CLASSES = (
    Class("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 24, 2.9, 0, 0, 3),
    Class("upper", re.compile(r"[A-Z0-9]+"), 16, 2.9, 0, 4, 2),
    Class("base64", re.compile(r"[A-Za-z0-9+/_-]+"), 20, 3.5, 2, 2, 1),
    Class("lower", re.compile(r"[a-z0-9]+"), 24, 3.5, 4, 0, 4),
    # for runs of 20 to 23; of random ones of 20, these find 0.99 and 0.94
    Class("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 20, 2.9, 0, 0, 3),
    Class("lower", re.compile(r"[a-z0-9]+"), 20, 3.4, 4, 0, 3),
)

ALLOWED_INSIDE = re.compile(r"(?i)example|sample|dummy|placeholder|changeme|redacted|your[_-]|x{6,}|0{8,}|abcdefgh|12345678|(.)\1{7,}")
#: What names a digest, in its longest form.
_DIGEST = re.compile(r"(?i)(?:sha-?\d{1,3}|md5|checksum|digest|integrity|commit|revision|etag)\Z")
_DIGEST_SIZE = 9
#: What ends a URL's host or path: white space, quotes, brackets, separators, and the marks of queries, fragments and values.
_STOP = re.compile(r"[\s?#\"'`<>()\[\]{},;|\\=&]")
#: What matters in a run without those: the beginnings of URLs, path marks, and what no path holds; %3 encodes one of : ; < = > ?
_MARK = re.compile(r"(?i)://|www\.|/|:|%3")
_HOST_END = re.compile(rf"{_STOP.pattern[:-1]}/]")


def best_entropy(run: str, kind: Class) -> float:
    """The greatest entropy of a window that holds what the class asks for, by incremental counts; 0 if there is none."""
    w = kind.window
    if len(run) < w:
        return 0.0
    cost = [0.0] + [c * math.log2(c) for c in range(1, w + 2)]
    counts: dict[str, int] = {}
    total, best = 0.0, 0.0
    lower = upper = digits = 0
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += cost[n + 1] - cost[n]
        lower += c.islower()
        upper += c.isupper()
        digits += c.isdigit()
        if i >= w:
            o = run[i - w]
            n = counts[o]
            counts[o] = n - 1
            total += cost[n - 1] - cost[n]
            lower -= o.islower()
            upper -= o.isupper()
            digits -= o.isdigit()
        # a hexadecimal window holds letters of one case; either counts
        if i >= w - 1 and lower >= kind.lower and upper >= kind.upper and digits >= kind.digits and (kind.name != "hex" or lower + upper >= 3):
            best = max(best, math.log2(w) - total / w)
    return best


def kind_of(word: str) -> tuple[str, float] | None:
    """The first class that a candidate meets, and its entropy."""
    for kind in CLASSES:
        most = max((best_entropy(r, kind) for r in kind.run.findall(word) if len(r) >= kind.window), default=0.0)
        if most >= kind.threshold:
            return kind.name, most
    return None


def names_digest(text: str, at: int) -> bool:
    """Whether the name of a digest, a separator (one of : = - ( or a blank) and perhaps quotes and white space stand before a place."""
    if at and text[at - 1] in "\"'":
        at -= 1
    end = at
    while at and text[at - 1].isspace():
        at -= 1
    if at and text[at - 1] in ":=-(":
        at -= 1
        while at and text[at - 1].isspace():
            at -= 1
    elif " " not in text[at:end]:
        return False
    if at and text[at - 1] in "\"'":
        at -= 1
    return _DIGEST.search(text, max(0, at - _DIGEST_SIZE), at) is not None


class Urls:
    """Where a text's candidates stand in URLs; candidates are asked for in order, and the text is read once."""

    def __init__(self, text: str):
        self.text, self.at = text, 0
        #: The beginnings of the first URL in whose host, and of the first in whose path, the text read so far ends.
        self.now: tuple[int | None, int | None] = (None, None)
        self.stop = self.mail = -1

    @staticmethod
    def _after(now: tuple[int | None, int | None], mark: str, at: int) -> tuple[int | None, int | None]:
        host, path = now
        if mark[0] in ":%":
            path = None
        if mark in ("/", "://") and host is not None:
            host, path = None, host if path is None else min(path, host)
        if host is None and (mark == "://" or mark[0] in "wW"):
            host = at
        return host, path

    def before(self, start: int) -> str | None:
        """"host" or "path", by the first URL that reaches up to a place; None if there is none."""
        for m in _STOP.finditer(self.text, self.at, start):
            self.at, self.now = m.end(), (None, None)
        now = None
        for m in _MARK.finditer(self.text, self.at, start + 2):
            if m.end() > start:
                # of a mark that goes on beyond the place, what stands before it counts here, the whole for later places
                now = self.now
                for i in range(m.start(), start):
                    now = self._after(now, self.text[i], i) if self.text[i] in ":/" else now
                self.at = min(m.start(), start)
                break
            self.now = self._after(self.now, m[0], m.start())
            self.at = m.end()
        else:
            self.at = max(self.at, start - 3)  # where a mark that goes on beyond the place may begin
        host, path = now or self.now
        if host is None and path is None:
            return None
        return "path" if host is None or path is not None and path < host else "host"

    def user_info(self, end: int) -> bool:
        """Whether an @ follows before the host ends: user info may hold a slash that isn't encoded."""
        if self.stop < end:
            m = _HOST_END.search(self.text, end)
            self.stop = m.start() if m else len(self.text)
        if self.mail < end:
            found = self.text.find("@", end)
            self.mail = found if found >= 0 else len(self.text)
        return self.mail < self.stop


def outside_path(text: str, start: int, end: int, urls: Urls) -> str:
    """The part of a candidate that belongs to no URL's path."""
    word = text[start:end]
    within = urls.before(start)
    if within is None or urls.user_info(end):
        return word
    if within == "host":
        return word.partition("/")[0]
    return word if text[start - 1] == "%" and word[0] == "3" else ""


def scan(text: str | None) -> list[tuple[str, int, int, float]]:
    """(class, start, end, entropy) of the secrets of a text, in order."""
    found = []
    urls = Urls(text or "")
    for m in _FIND.finditer(text or ""):
        kind = kind_of(m[0])
        if kind is None or ALLOWED_INSIDE.search(m[0]) or names_digest(text, m.start()):
            continue
        part = outside_path(text, *m.span(), urls)
        if part != m[0]:
            kind = kind_of(part)
        if kind is not None:
            found.append((kind[0], m.start(), m.end(), round(kind[1], 4)))
    return found


def redact(text: str, found: list[tuple[str, int, int, float]]) -> str:
    parts, at = [], 0
    for _, start, end, _ in found:
        parts += text[at:start], REDACTED
        at = end
    return "".join([*parts, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = [(i, *hit) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in scan(text)]
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64()))], names=["doc_id", "kind", "start", "end", "entropy"])


def _suspect(text: F.Column) -> F.Column:
    return F.coalesce(text.rlike(CANDIDATE), F.lit(False))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, entropy), a row for each secret; the JVM finds the texts with candidates, and only these reach Python."""
    some = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(_suspect(F.col("text")))
    return mapped(some, _scan, "doc_id bigint, kind string, start int, end int, entropy double")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`; secrets are replaced by [SECRET], and `n_chars` follows.  Nothing is shuffled."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    plain = docs.toDF(*names)
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names[at]):
            texts = batch.column(at).to_pylist()
            new = [redact(t, found) if (found := scan(t)) else t for t in texts]
            columns = batch.columns
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if length is not None:
                old = batch.column(length).to_pylist()
                columns[length] = pa.array([len(n) if n is not t else o for n, t, o in zip(new, texts, old)], batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    text = F.col(names[at])
    return plain.where(~_suspect(text)).union(mapped(plain.where(_suspect(text)), kernel, plain.schema)).toDF(*docs.columns)

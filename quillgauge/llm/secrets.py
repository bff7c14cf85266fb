"""Secret scans through a trigram index.

Each rule's regular expression is parsed, and a Boolean query of trigrams that
every match must contain is derived from it: literals are concatenated,
alternatives become OR, sequences AND, and a part without literals asks
nothing.  A slice of texts is indexed by the trigrams that some rule asks for
(postings of text numbers, letters folded to lower case), each rule's postings
are intersected and united, and only the candidates are searched by the rule.
A rule without a mandatory trigram scans every text.  A trigram query is a
necessary condition, so no match is lost; spans are those of the regular
expressions on whole texts, in code points.

A null text counts as empty, an empty table gives an empty one.  Rows are
independent of each other: repeated rows, null ids and extra columns need no
care.  Every rule takes time in proportion to a text's length, also on unbroken
runs.  Of matches of several rules at one start, the rule listed first comes
first.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import re
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Sets of strings beyond this size are no longer tracked exactly.
MOST = 64


@dataclasses.dataclass(frozen=True)
class Rule:
    """``least``: code points that ``group`` must have, else the match is dropped; ``span``: the group whose span counts."""

    name: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    span: int = 0

    @functools.cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags | re.ASCII)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and end of the leftmost, non-overlapping matches that are long enough."""
        return [m.span(self.span) for m in self.compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: The three kinds that every scan reports; spans of the others are added to theirs.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 0, 16),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |DSA |EC |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    # These two look ahead once from the start of an unbroken run, and take the first fitting start in it: linear in the text.
    Rule("jwt", r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]++\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10})[A-Za-z0-9_-]*?(eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)", span=1),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}=*", re.IGNORECASE),
    Rule("url_login", r"(?<![A-Za-z0-9+.-])(?=[A-Za-z0-9+.-]++://[^\s/:@]++:[^\s/:@]++@)[0-9+.-]*+([A-Za-z][A-Za-z0-9+.-]*+://[^\s/:@]++:[^\s/:@]++@)", span=1),
)

#: A query is None (asks nothing), a trigram, or ("and" | "or", frozenset of queries).
Query = object


def _both(kind: str, parts) -> Query:
    parts = set(parts)
    if kind == "or" and None in parts:
        return None
    parts.discard(None)
    flat = set()
    for p in parts:
        flat |= p[1] if isinstance(p, tuple) and p[0] == kind else {p}
    if len(flat) < 2:
        return next(iter(flat), None)
    return (kind, frozenset(flat))


def _asks(strings: frozenset[str]) -> Query:
    """What a match of one of these strings must contain."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _class(items) -> frozenset[str] | None:
    """The characters of a small class, folded; None for a large or negated one."""
    out = set()
    for kind, x in items:
        if kind is op.LITERAL:
            out.add(chr(x).lower())
        elif kind is op.RANGE and x[1] - x[0] < 8:
            out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
        else:
            return None
    return frozenset(out) if len(out) <= 8 else None


def _walk(tree) -> tuple[frozenset[str] | None, Query]:
    """The exact set of folded strings that a sequence matches (None: not tracked), and a query that holds in any case."""
    run, query, exact = frozenset({""}), None, True

    def flush():
        nonlocal run, query, exact
        query, run, exact = _both("and", [query, _asks(run)]), frozenset({""}), False

    for kind, x in tree:
        own, asked = None, None
        if kind is op.LITERAL:
            own = frozenset({chr(x).lower()})
        elif kind is op.IN:
            own = _class(x)
        elif kind is op.SUBPATTERN:
            own, asked = _walk(x[3])
        elif kind is op.BRANCH:
            sides = [_walk(b) for b in x[1]]
            if all(s is not None for s, _ in sides):
                own = frozenset().union(*(s for s, _ in sides))
            else:
                asked = _both("or", [q if s is None else _asks(s) for s, q in sides])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, inner = x
            s, q = _walk(inner)
            if s is not None and low == high == 1:
                own = s
            elif s is not None and (low, high) == (0, 1):
                own = s | {""}
            elif low:
                asked = q if s is None else _asks(s)
                if s is not None:  # its first copy goes on from what stands before
                    joined = frozenset(a + b for a in run for b in s)
                    if len(joined) <= MOST:
                        run = joined
        elif kind is op.AT:
            continue
        if own is not None and len(run) * len(own) <= MOST:
            run = frozenset(a + b for a in run for b in own)
            continue
        flush()
        query = _both("and", [query, asked])
        if own is not None:
            run = own
    if exact:
        return run, None
    return None, _both("and", [query, _asks(run)])


def trigram_query(rule: Rule) -> Query:
    exact, query = _walk(parser.parse(rule.pattern, rule.flags))
    return query if exact is None else _asks(exact)


def trigrams(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


class Index:
    """Postings of the trigrams that the rules ask for, over a slice of texts."""

    def __init__(self, wanted: set[str]):
        self.names = sorted(t for t in wanted if t.isascii())
        self.number = {t: i + 1 for i, t in enumerate(self.names)}
        #: By the low seven bits of three bytes; other bytes can only add candidates.
        self.slots = np.zeros(1 << 21, np.uint16)
        for t, i in self.number.items():
            a, b, c = t.encode()
            self.slots[a << 14 | b << 7 | c] = i
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        self.fold = fold & 127

    def postings(self, data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
        """``data``: the texts' bytes in a row; ``ends``: where each text ends."""
        low = self.fold[data].astype(np.int32)
        if len(low) < 3:
            return {}
        hit = self.slots[(low[:-2] << 14) | (low[1:-1] << 7) | low[2:]]
        at = np.flatnonzero(hit)
        key = np.unique(hit[at].astype(np.int64) * len(ends) + np.searchsorted(ends, at, side="right").clip(max=len(ends) - 1))
        number, text = key // len(ends), key % len(ends)
        cut = np.searchsorted(number, np.arange(1, len(self.names) + 2))
        return {t: text[cut[i] : cut[i + 1]] for i, t in enumerate(self.names)}


def candidates(query: Query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    if query is None:
        return np.arange(n)
    if isinstance(query, str):
        if not query.isascii():
            return np.arange(n)
        return postings.get(query, np.zeros(0, np.int64))
    parts = sorted((candidates(q, postings, n) for q in query[1]), key=len)
    if query[0] == "or":
        return np.unique(np.concatenate(parts))
    out = parts[0]
    for p in parts[1:]:
        if not len(out):
            break
        out = np.intersect1d(out, p, assume_unique=True)
    return out


@functools.lru_cache(maxsize=4)
def _plan(rules: tuple[Rule, ...]) -> tuple[list[Query], Index]:
    queries = [trigram_query(r) for r in rules]
    return queries, Index(set().union(*map(trigrams, queries)))


def find_secrets(text: pa.Array, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule number, end), by start and then by rule."""
    text = pc.fill_null(text, "")
    texts, n = text.to_pylist(), len(text)
    queries, index = _plan(rules)
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    postings = index.postings(np.frombuffer("".join(texts).encode("utf-8"), np.uint8), ends) if n else {}
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        for i in candidates(query, postings, n).tolist():
            out[i] += [(a, k, b) for a, b in rule.spans(texts[i])]
    for spans in out:
        spans.sort()
    return out


def scanned(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    rules = BASE + more

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n: list[list[int]] = [[] for _ in BASE]
        digest, spans = [], []
        for found in find_secrets(batch.column("text"), rules):
            for k, counts in enumerate(n):
                counts.append(sum(x[1] == k for x in found))
            say = [f"{rules[k].name}:{a}:{b}" for a, k, b in found]
            base = ",".join(x for x, (_, k, _) in zip(say, found, strict=True) if k < len(BASE))
            digest.append(hashlib.sha256(base.encode()).hexdigest())
            spans.append(",".join(say))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in n), pa.array(digest), pa.array(spans)], names=["doc_id", *(f"n_{r.name}" for r in BASE), "base_sha256", "spans"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by [kind], overlapping ones as one; other columns stay."""
    rules = BASE + more
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        for i, found in enumerate(find_secrets(batch.column(at), rules)):
            if not found:
                continue
            t, out, done = texts[i], [], 0
            for a, k, b in found:
                if a >= done:
                    out += [t[done:a], f"[{rules[k].name}]"]
                done = max(done, b)
            texts[i] = "".join(out) + t[done:]
        return batch.set_column(at, "text", pa.array(texts, batch.column(at).type))

    out = map_arrow(docs, run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out

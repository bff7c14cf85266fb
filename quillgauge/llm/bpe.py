"""Byte-pair encoding with a heap of merge ranks over a doubly linked symbol list.

``merge`` starts from one symbol per byte, keeps every adjacent pair that has a
rank in a heap, pops the lowest (leftmost among equals), skips entries whose
pair has changed meanwhile, joins the two symbols in the linked list and pushes
the two new neighbours.  ``count`` needs no identifiers: it is the number of
initial symbols minus the merges.  ``decode`` joins vocabulary strings.

A null text is an empty one.  Rows are independent of each other: repeated rows
repeat, an empty table gives an empty one, null ids stay, extra columns are
ignored.  A word takes time about in proportion to its length, so very long texts
and unbroken runs need no care.

A vocabulary file is read once per process.  The words of a text repeat, so
each worker remembers a bounded number of finished words; when the memory is
full it starts anew, which changes no result.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, tokenizer_path

REMEMBERED = 200_000
#: Characters whose class differs between the Unicode versions of the libraries; a text with one is split by the library's own rules.
RARE = regex.compile(r"[՘֋֌࢏౜೜Ᲊ₏₝-₟Ɤ-ꟿ꭬꭭\U00010000-\U0001efff\U00020000-\U0010ffff]")
_GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    to = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [to[b] for b in range(256)]


class Vocabulary:
    """Merges, vocabulary and splitting rules of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.ids = path, model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: (left << 20 | right) -> (rank << 20 | joined)
        self.merges = {self.ids[a] << 20 | self.ids[b]: rank << 20 | self.ids[a + b] for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.first = [self.ids[x] for x in letters]
        self.final = [self.ids[x + self.suffix] for x in letters]
        self.lower = spec["normalizer"] is not None
        stages = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        self.pattern = regex.compile(next((s["pattern"]["Regex"] for s in stages if s["type"] == "Split"), _GPT2))
        #: For ASCII texts the classes are plain ones, and the plainer module is faster.
        plain = self.pattern.pattern.replace("[\\p{L}]", "[A-Za-z]").replace("[\\p{N}]", "[0-9]").replace("\\p{L}\\p{N}", "A-Za-z0-9").replace("\\p{L}", "[A-Za-z]").replace("\\p{N}", "[0-9]")
        self.ascii_pattern = re.compile(plain, re.ASCII)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.joined = " " if spec["decoder"] is None else ""
        self._library = None

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if not text.isascii() and RARE.search(text):
            t = self.library()
            if t.normalizer is not None:
                text = t.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(text)]
        if text.isascii():
            return self.ascii_pattern.findall(text.lower() if self.lower else text)
        if self.lower:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # each letter by itself: no final form
        return self.pattern.findall(text)

    def pieces(self, text: str):
        """Alternately the words of a stretch and the id of a special string that ends it (None at the end)."""
        if "<|" not in text:
            yield self.words(text), None
            return
        parts = self.cut.split(text)
        for i in range(0, len(parts), 2):
            yield self.words(parts[i]), self.special[parts[i + 1]] if i + 1 < len(parts) else None

    def symbols(self, word: str) -> list[int]:
        data = word.encode("utf-8")
        out = [self.first[b] for b in data]
        if self.suffix and out:
            out[-1] = self.final[data[-1]]
        return out

    def merge(self, sym: list[int]) -> int:
        """Merges in place, leaving -1 where a symbol was joined to its left; returns the number of merges."""
        n, known = len(sym), self.merges
        if n < 2:
            return 0
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            m = known.get(sym[i] << 20 | sym[i + 1])
            if m is not None:
                heap.append((m >> 20) << 40 | i)
        heapq.heapify(heap)
        done = 0
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFFFF
            j = after[i]
            if sym[i] < 0 or j >= n:
                continue
            m = known.get(sym[i] << 20 | sym[j])
            if m is None or m >> 20 != top >> 40:
                continue  # the pair has changed since
            sym[i], sym[j] = m & 0xFFFFF, -1
            done += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = known.get(sym[i] << 20 | sym[k])
                if m is not None:
                    heapq.heappush(heap, (m >> 20) << 40 | i)
            h = before[i]
            if h >= 0:
                m = known.get(sym[h] << 20 | sym[i])
                if m is not None:
                    heapq.heappush(heap, (m >> 20) << 40 | h)
        return done

    def word_ids(self, word: str) -> list[int]:
        sym = self.symbols(word)
        self.merge(sym)
        return [s for s in sym if s >= 0]

    def word_count(self, word: str) -> int:
        sym = self.symbols(word)
        return len(sym) - self.merge(sym)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for words, special in self.pieces(text):
            for w in words:
                out += self.word_ids(w)
            if special is not None:
                out.append(special)
        return out

    def count(self, text: str) -> int:
        return sum(sum(map(self.word_count, words)) + (special is not None) for words, special in self.pieces(text))

    def decode(self, ids: list[int]) -> str:
        """The library's decoding: vocabulary strings, joined by a blank in a file without a decoder."""
        text = self.joined.join(self.strings[i] for i in ids)
        if self.joined:
            return text
        back = {x: b for b, x in enumerate(byte_letters())}
        return b"".join(bytes([back[c]]) if c in back else c.encode() for c in text).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Memory(dict):
    """Word -> result, computed when missing; emptied when full."""

    def __init__(self, make, limit: int = REMEMBERED):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        out = self.make(word)
        if len(word) <= 64:
            self[word] = out
        return out


@functools.lru_cache(maxsize=4)
def _counts(path: str) -> _Memory:
    return _Memory(vocabulary(path).word_count, 2 * REMEMBERED)


@functools.lru_cache(maxsize=4)
def _digests(path: str) -> _Memory:
    v = vocabulary(path)

    def make(word: str) -> tuple[str, str, int]:
        ids = v.word_ids(word)
        return " ".join(map(str, ids)), v.joined.join(v.strings[i] for i in ids), len(ids)

    return _Memory(make)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, folder: str | None = None) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit per row of ``docs`` (doc_id, text); a null text counts as empty."""
    path = tokenizer_path(tokenizer, folder)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v, known = vocabulary(path), _counts(path)
        text = pc.fill_null(batch.column("text"), "")
        n = []
        for t in text.to_pylist():
            total = 0
            for words, special in v.pieces(t):
                total += sum([known[w] for w in words]) + (special is not None)
            n.append(total)
        count = pa.array(n, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pc.binary_length(text).cast(pa.int64()), count, pc.greater(count, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def encoded(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """doc_id, ids (array of ints) and decoded text per row of ``docs``; a null text counts as empty."""
    path = tokenizer_path(tokenizer, folder)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(path)
        ids = [v.encode(t) for t in pc.fill_null(batch.column("text"), "").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([v.decode(x) for x in ids])], names=["doc_id", "ids", "decoded"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded text, for a file without a decoder (tokens joined by blanks)."""
    path = tokenizer_path(tokenizer, folder)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v, known = vocabulary(path), _digests(path)
        if not v.joined:
            raise ValueError("digests by words need a vocabulary without a decoder")
        n, ids, text = [], [], []
        for t in pc.fill_null(batch.column("text"), "").to_pylist():
            found = []
            for words, special in v.pieces(t):
                found += [known[w] for w in words]
                if special is not None:
                    found.append((str(special), v.strings[special], 1))
            n.append(sum([x[2] for x in found]))
            ids.append(hashlib.sha256(" ".join([x[0] for x in found]).encode()).hexdigest())
            text.append(hashlib.sha256(" ".join([x[1] for x in found]).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""BPE encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of text whose words are encoded together.
CHUNK_CHARS = 2_000_000
#: Distinct words that a task keeps encoded.
MAX_WORDS = 200_000
_SPACE = regex.compile(r"\p{White_Space}+")
_DEAD, _GAP = -2, -1


def _byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in printable}
    spare = iter(range(0x100, 0x200))
    return [names[b] if b in names else chr(next(spare)) for b in range(256)]


def _lower(text: str) -> str:
    return text.replace("Σ", "σ").lower()  # character by character: no final sigma


@dataclass
class Bpe:
    """A byte-level BPE vocabulary read from the JSON file of a public tokenizer.

    Supports what such files state: normalizers NFC, Replace and Lowercase, one
    Split by a pattern that keeps its matches, ByteLevel without a pattern,
    added special tokens, and an end-of-word suffix.  Anything else is refused.
    """

    spec: dict
    split: regex.Pattern = field(init=False)
    special: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        model = self.spec["model"]
        steps = self.spec["normalizer"]["normalizers"]
        kinds = [s["type"] for s in steps]
        split, level = self.spec["pre_tokenizer"]["pretokenizers"]
        if (kinds != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": "\\s+"} or not split["invert"]
                or split["behavior"] != "Removed" or level["use_regex"] or model["unk_token"] or self.spec["decoder"]):
            raise ValueError("this vocabulary file states steps that are not supported")
        self.blank = steps[1]["content"]
        self.split = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")")
        vocab: dict[str, int] = model["vocab"]
        self.size = max(*vocab.values(), *self.special.values()) + 1
        self.token = [""] * self.size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = t
        end = model["end_of_word_suffix"] or ""
        alphabet = _byte_alphabet()
        self.first = np.array([vocab.get(c, _DEAD) for c in alphabet], np.int64)
        self.last = np.array([vocab.get(c + end, _DEAD) for c in alphabet], np.int64)
        left = np.array([vocab[a] for a, _ in model["merges"]], np.int64)
        right = np.array([vocab[b] for _, b in model["merges"]], np.int64)
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        code = left * self.size + right
        self.by_code = np.argsort(code, kind="stable")
        self.codes = code[self.by_code]

    def words(self, text: str) -> Iterator[list[str] | int]:
        """Stretches of words, and the ids of special tokens between them."""
        parts = self.special_split.split(text) if any(t in text for t in self.special) else [text]
        for part in parts:
            if part in self.special:
                yield self.special[part]
            elif part:
                part = part if part.isascii() else unicodedata.normalize("NFC", part)
                yield self.split.findall(_lower(_SPACE.sub(self.blank, part)))

    def _ranks(self, code: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.by_code[at], -1)

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, all words together.

        The index maps each rank that occurs to the positions of its pair.  The
        least active rank is applied to all its positions at once, and the pairs
        that this makes are filed under their own ranks.
        """
        if not words:
            return []
        data = [w.encode("utf-8") for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"\0".join(data) + b"\0", np.uint8)
        stop = np.cumsum(size + 1) - 1
        sym = self.first[raw]
        sym[stop - 1] = self.last[raw[stop - 1]]
        sym[stop] = _GAP
        n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def file(left: np.ndarray, right: np.ndarray) -> None:
            ok = (sym[left] >= 0) & (sym[right] >= 0)
            left = left[ok]
            rank = self._ranks(sym[left] * self.size + sym[right[ok]])
            found = rank >= 0
            if not found.any():
                return
            rank, left = rank[found], left[found]
            order = np.argsort(rank, kind="stable")
            rank, left = rank[order], left[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, at in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(left, cuts)):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(at)

        inner = np.arange(n - 1)
        file(inner, inner + 1)
        while active:
            r = heapq.heappop(active)
            found = index.pop(r)
            p = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            a, b = self.left[r], self.right[r]
            p = p[sym[p] == a]
            p = p[sym[np.minimum(nxt[p], n - 1)] == b]
            if a == b and len(p) > 1:  # of overlapping pairs, every second one from the left
                start = np.ones(len(p), bool)
                start[1:] = nxt[p[:-1]] != p[1:]
                begin = np.flatnonzero(start)
                place = np.arange(len(p)) - np.repeat(begin, np.diff(np.append(begin, len(p))))
                p = p[place % 2 == 0]
            if not len(p):
                continue
            q = nxt[p]
            after = nxt[q]
            sym[p], sym[q] = self.made[r], _DEAD
            nxt[p] = after
            prv[after] = p  # a word ends with a gap, so there is always one after
            before = prv[p]
            has = before >= 0
            file(np.concatenate([before[has], p]), np.concatenate([p[has], after]))
        keep = sym != _DEAD
        flat = sym[keep]
        ends = np.flatnonzero(flat == _GAP)
        out, at, ids = [], 0, flat.tolist()
        for e in ends.tolist():
            out.append(ids[at:e])
            at = e + 1
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, joined by a blank as a file without a decoder asks for."""
        return " ".join([self.token[i] for i in ids])


def load(path: str) -> Bpe:
    return Bpe(json.loads(Path(path).read_text(encoding="utf-8")))


class _Cache:
    """Words that this task has encoded: the count, ids and tokens of each."""

    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.known = bpe, {}

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MAX_WORDS:
            self.known = {}
            new = list(words)
        for w, ids in zip(new, self.bpe.encode(new)):
            self.known[w] = ids


def encode_texts(bpe: Bpe, texts: list[str], cache: _Cache | None = None) -> list[list[int]]:
    """The ids of each text."""
    cache = cache or _Cache(bpe)
    parts = [list(bpe.words(t)) for t in texts]
    cache.learn({w for ps in parts for p in ps if not isinstance(p, int) for w in p})
    known, out = cache.known, []
    for ps in parts:
        ids: list[int] = []
        for p in ps:
            if isinstance(p, int):
                ids.append(p)
            else:
                for w in p:
                    ids += known[w]
        out.append(ids)
    return out


def _by_chars(texts: pd.Series) -> Iterator[list[str]]:
    held, n = [], 0
    for t in texts:
        held.append(t if t is not None else "")
        n += len(held[-1])
        if n >= CHUNK_CHARS:
            yield held
            held, n = [], 0
    if held:
        yield held


def _map_texts(docs: DataFrame, path: str, text_col: str, schema: str, make) -> DataFrame:
    """The input's columns in a struct ``row``, with what ``make`` gets from a text's ids."""
    # The vocabulary has a fixed size; the driver reads it, so no executor needs the file.
    held = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = Bpe(json.loads(held.value))
        cache = _Cache(bpe)
        for batch in batches:
            yield pd.DataFrame([make(bpe, ids) for texts in _by_chars(batch) for ids in encode_texts(bpe, texts, cache)],
                               columns=[c.split()[0] for c in schema.split(",")])

    return docs.select(F.struct("*").alias("row"), run(F.col(text_col)).alias("out")).select("row", "out.*")


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The input's columns in a struct ``row``, with ids (array of int).

    The ids equal those of the public tokenizers library for the file at
    ``path`` without added special tokens.  Null and empty texts have no ids,
    equal texts equal ids, repeated rows are rows of their own; a very long text
    is encoded whole.  An empty table gives an empty result.
    """
    return _map_texts(docs, path, text_col, "ids array<int>", lambda bpe, ids: (ids,))


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The input's columns in a struct ``row``, with the decoded ``text``; null for null ids, empty for none."""
    held = rows.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = Bpe(json.loads(held.value))
        for batch in batches:
            yield pd.Series([None if ids is None else bpe.decode(ids) for ids in batch], dtype=object)

    return rows.select(F.struct("*").alias("row"), run(F.col(ids_col)).alias("text"))


def _digest(bpe: Bpe, ids: list[int]) -> tuple[int, str, str]:
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())


def round_trip_digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): documents encoded, and decoded from their ids.

    One row for each row of documents, whatever its id; null counts as empty.
    """
    return _map_texts(docs.select("doc_id", "text"), path, "text",
                      "n_tokens long, ids_sha256 string, decoded_sha256 string", _digest).select(
        "row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

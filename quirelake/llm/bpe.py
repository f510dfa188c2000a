"""BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a part of a partition that were not met before lie in
one flat symbol sequence.  An index maps each mergeable pair, by its rank, to all its
positions there; ranks are applied in ascending order, every position of a
rank at once, and each merge updates only the lists of the two pairs that it
creates.  A merge therefore costs the same however many documents share it.

Defined results: null and empty texts have no tokens (digests of the empty
string); repeated rows give repeated results; special-token strings in a text
become their ids; an empty table gives an empty result; columns other than
doc_id and text are not read.  Letter classes are those of the installed
``regex``, whose Unicode version may be newer than the tokenizer's: the only
texts that can differ hold characters added since.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_document

#: Pre-tokens whose encoding a task remembers.
CACHED = 250_000
#: Pre-tokens that are merged through one pair index.
MERGED = 50_000


def byte_symbols() -> list[str]:
    """The printable character of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairIndexBPE:
    """A byte-level BPE with word ends, read from a tokenizer's JSON text."""

    def __init__(self, source: str):
        import regex

        spec = json.loads(source)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {i: t for t, i in [*self.vocabulary.items(), *self.specials.items()]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        v = self.vocabulary
        self.rules = [(v[a], v[b], v[a + b]) for a, b in pairs]
        self.ranks = {a << 20 | b: r for r, (a, b, _) in reversed(list(enumerate(self.rules)))}
        symbols = byte_symbols()
        self.inner = np.array([v[s] for s in symbols], np.int64)
        self.last = np.array([v[s + self.suffix] for s in symbols], np.int64)
        self.pair_keys = np.array(sorted(self.ranks), np.int64)
        self.pair_ranks = np.array([self.ranks[k] for k in self.pair_keys.tolist()], np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern).findall
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    def normalized(self, text: str) -> str:
        """NFC, then each character in lower case by itself."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def pretokens(self, text: str) -> list[str | int]:
        """The pre-tokens of a whole text, special tokens as their ids."""
        if self.marks is None or not any(s in text for s in self.specials):
            return self.words(self.normalized(text))
        out: list[str | int] = []
        begin = 0
        for m in self.marks.finditer(text):
            out += self.words(self.normalized(text[begin : m.start()]))
            out.append(self.specials[m[0]])
            begin = m.end()
        return out + self.words(self.normalized(text[begin:]))

    def merged(self, words: list[str]) -> list[list[int]]:
        """Ids of each pre-token, all merged together through one pair index."""
        if not words:
            return []
        data = [w.encode() for w in words]
        ends = np.cumsum([len(d) for d in data])
        flat = np.frombuffer(b"".join(data), np.uint8)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        links = np.arange(1, len(flat) + 1)
        links[ends - 1] = -1
        back = np.arange(-1, len(flat) - 1)
        starts = np.concatenate([[0], ends[:-1]])
        back[starts] = -1
        # The index at first: the positions of each pair that has a rank, by ascending rank.
        keys = symbols[:-1] << 20 | symbols[1:]
        found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        at = np.flatnonzero((self.pair_keys[found] == keys) & (links[:-1] >= 0))
        rank = self.pair_ranks[found[at]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        places: dict[int, list[int]] = defaultdict(list)
        if len(at):
            places.update((int(rank[c]), part.tolist()) for c, part in zip([0, *cuts], np.split(at, cuts), strict=True))
        active = list(places)
        symbol, after, before, starts = symbols.tolist(), links.tolist(), back.tolist(), starts.tolist()
        rank_of, rules = self.ranks.get, self.rules
        while active:
            rank = heapq.heappop(active)
            first, second, new = rules[rank]
            todo = places.pop(rank, ())
            if len(todo) > 1:
                todo.sort()
            for i, p in enumerate(todo):
                q = after[p]
                if symbol[p] != first or q < 0 or symbol[q] != second:
                    continue
                symbol[p], symbol[q] = new, -1
                right, left = after[q], before[p]
                after[p] = right
                lowest = rank
                if right >= 0:
                    before[right] = p
                    if (r := rank_of(new << 20 | symbol[right])) is not None:
                        if r not in places:
                            heapq.heappush(active, r)
                        places[r].append(p)
                        lowest = min(lowest, r)
                if left >= 0 and (r := rank_of(symbol[left] << 20 | new)) is not None:
                    if r not in places:
                        heapq.heappush(active, r)
                    places[r].append(left)
                    lowest = min(lowest, r)
                if lowest < rank:  # a pair of a lower rank arose: it goes first
                    places[rank] = todo[i + 1 :]
                    heapq.heappush(active, rank)
                    break
        out = []
        for at in starts:
            ids = []
            while at >= 0:
                ids.append(symbol[at])
                at = after[at]
            out.append(ids)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by a space, special tokens included."""
        return " ".join(self.tokens[i] for i in ids)


class Encoder:
    """Encodes texts by a vocabulary, with a cache of pre-tokens that ends with it."""

    def __init__(self, bpe: PairIndexBPE):
        self.bpe = bpe
        #: Ids and token strings of pre-tokens, each joined by a space.
        self.known: dict[str | int, tuple[str, str]] = {}

    def learn(self, words: set[str | int]) -> None:
        """Puts the encodings of new pre-tokens into the cache; the oldest half goes when it is full."""
        known, tokens = self.known, self.bpe.tokens
        new = [w for w in words if w not in known]
        if known and len(known) + len(new) > CACHED:
            for w in list(known)[: max(len(known) // 2, len(known) + len(new) - CACHED)]:
                del known[w]
            new = [w for w in words if w not in known]
        for w in [w for w in new if isinstance(w, int)]:
            known[w] = str(w), tokens[w]
        new = [w for w in new if isinstance(w, str)]
        for begin in range(0, len(new), MERGED):
            part = new[begin : begin + MERGED]
            for w, ids in zip(part, self.bpe.merged(part), strict=True):
                known[w] = " ".join(map(str, ids)), " ".join([tokens[i] for i in ids])

    def joined(self, texts: list[str]) -> list[tuple[str, str]]:
        """The ids and the token strings of each text, joined by a space."""
        parts = [self.bpe.pretokens(t) for t in texts]
        self.learn(set().union(*parts))
        get = self.known.__getitem__
        out = []
        for p in parts:
            ids, strings = zip(*map(get, p), strict=True) if p else ((), ())
            out.append((" ".join(ids), " ".join(strings)))
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return [int(i) for i in self.joined([text])[0][0].split()]

    def digests(self, texts: list[bytes]) -> dict[str, list]:
        """n_tokens, ids_sha256 and decoded_sha256 of each text."""
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids, decoded in self.joined([t.decode("utf-8", "replace") for t in texts]):
            out["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
            out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
        return out


def tokenizer_source(path: str) -> str:
    """The tokenizer's JSON text, read on the driver; a vocabulary file has a fixed size of a few MB."""
    with open(path, encoding="utf-8") as f:
        return f.read()


_loaded: dict[int, PairIndexBPE] = {}


def _loaded_once(source: str) -> PairIndexBPE:
    """One vocabulary for all tasks of a Python worker."""
    key = hash(source)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PairIndexBPE(source)
    return _loaded[key]


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_source(path))
    return per_document(
        docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: Encoder(_loaded_once(source.value)).digests, most=2_000_000
    )


def bpe_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded and the digests of both, of every whole text."""
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_source(path))

    def prepare():
        encoder = Encoder(_loaded_once(source.value))

        def digest(texts: list[bytes]) -> dict[str, list]:
            out: dict[str, list] = {"n_tokens": [], "ids": [], "decoded": [], "ids_sha256": [], "decoded_sha256": []}
            for ids, decoded in encoder.joined([t.decode("utf-8", "replace") for t in texts]):
                numbers = np.fromstring(ids, np.int32, sep=" ") if ids else np.zeros(0, np.int32)
                made = (len(numbers), numbers, decoded, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                for column, value in zip(out.values(), made, strict=True):
                    column.append(value)
            return out

        return digest

    return per_document(docs, "n_tokens long, ids array<int>, decoded string, ids_sha256 string, decoded_sha256 string", prepare, most=2_000_000)


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text."""
    source = docs.sparkSession.sparkContext.broadcast(tokenizer_source(path))

    def prepare():
        encode = Encoder(_loaded_once(source.value)).encode
        return lambda texts: {"ids": [encode(t.decode("utf-8", "replace")) for t in texts]}

    return per_document(docs, "ids array<int>", prepare, most=2_000_000)


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of ids; null ids give an empty text."""
    source = encoded.sparkSession.sparkContext.broadcast(tokenizer_source(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded_once(source.value)
        for batch in batches:
            texts = [bpe.decode(ids or ()) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")

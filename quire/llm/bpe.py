"""BPE encoding and decoding as streaming transducers.

Encoder. The text is cut at special tokens, normalised and split into
pre-tokens as the tokenizer file says. Within a pre-token the merges act on a
buffer of bounded length: a token is emitted once no later symbol can change
it. How many symbols that takes is the merge list's sufficient lookahead,
computed once from the list (``sufficient_lookahead``). Pre-tokens shorter
than the buffer are whole at once; longer ones stream, so memory does not grow
with them. Frequent pre-tokens are kept in a bounded table.

Decoder. Ids become bytes, and an incremental UTF-8 state machine turns blocks
of them into text; an incomplete character waits for the next block.

Why the lookahead suffices. Merges apply in order of rank. Whether rule k
removes the boundary at p depends, to the right of p, on the right part ``b``
of k ending at p + |b| as a token: on whether an earlier rule has removed the
boundary there, which in turn depends on that rule's right part, and so on.
An earlier rule j acts at that boundary only if its left part is one of the
tokens that end ``b`` while it is built (its right spine). So the reach is
|b| plus the greatest reach among such j < k: one pass over the list.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import json
import re

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from quire.llm.common import per_worker, quoted, table, without

VOCABULARY = "word_bpe_49k.json"
KEPT_WORDS = 400_000   # bound of the table of frequent pre-tokens, per worker
BLOCK = 65_536         # ids decoded at a time
CHUNK = 1 << 18        # characters of a text split at a time


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    others = (b for b in range(256) if b not in out)
    out.update({b: chr(256 + i) for i, b in enumerate(others)})
    return [out[b] for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]], length) -> int:
    """Symbols after a boundary that can decide whether it stays (see above)."""
    right: dict[str, str] = {}
    best: dict[str, int] = {}
    most = 0
    for a, b in merges:
        reach, part = 0, b
        while part is not None:
            reach = max(reach, best.get(part, 0))
            part = right.get(part)
        reach += length(b)
        if a == b:  # runs of one token: the next copy also decides
            reach += length(b)
        best[a] = max(best.get(a, 0), reach)
        right.setdefault(a + b, b)
        most = max(most, reach)
    return most


class Bpe:
    """One vocabulary file. ``encode`` yields lists of ids, ``decode`` pieces
    of text; neither holds more than a block beside the text itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        v = self.vocab
        self.ranks = {(v[a], v[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made = [v[a + b] for a, b in merges]
        n, suffix = len(self.suffix), self.suffix

        def length(token):
            return len(token) - n if suffix and token.endswith(suffix) and len(token) > n else len(token)

        self.longest = max(length(t) for t in v)
        self.lookahead = sufficient_lookahead(merges, length)
        self.buffer = 2 * (self.longest + self.lookahead)
        alphabet = byte_alphabet()
        self.inner = [v[c] for c in alphabet]
        self.final = [v[c + self.suffix] for c in alphabet]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in v.items()} | {i: t for t, i in self.special.items()}
        self.pieces = [names.get(i, "").encode() for i in range(max(names) + 1)]
        back = {c: bytes([b]) for b, c in enumerate(alphabet)}
        self.bytes = [self._raw(names.get(i, ""), back) for i in range(max(names) + 1)]
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"]
                          if p["type"] == "Split")
        self.kept = _Kept(self)
        self.normalizer = None
        self.path = path

    def _raw(self, token: str, back) -> bytes:
        if token in self.special:
            return token.encode()
        end = bool(self.suffix) and token.endswith(self.suffix)
        body = token[:len(token) - len(self.suffix)] if end else token
        return b"".join(back.get(c, b"") for c in body) + (b" " if end else b"")

    # -- text to pre-tokens ----------------------------------------------------

    def pre_tokens(self, text: str):
        """Lists of pre-tokens of a text without special tokens: NFC, lower
        case of each character, then the file's split, which drops white space.
        Long texts are cut before white space, across which nothing interacts,
        and what is long without any is split a block of pre-tokens at a time."""
        start = 0
        while start < len(text):
            end = len(text)
            if end - start > CHUNK:
                gap = _GAP.search(text, start + CHUNK)
                end = gap.start() if gap else end
            part = text[start:end] if start or end < len(text) else text
            start = end
            if part.isascii() or _PLAIN.fullmatch(part):
                if len(part) <= 2 * CHUNK:
                    yield _plain_split().findall(part.lower())
                    continue
                found = (m.group() for m in _plain_split().finditer(part.lower()))
                while words := list(itertools.islice(found, BLOCK)):
                    yield words
            else:
                yield self._library_split(part)

    def _library_split(self, text: str) -> list[str]:
        """Other scripts: the library's normaliser and split, whose Unicode
        tables may differ from Python's."""
        if self.normalizer is None:
            from tokenizers import Regex, Tokenizer, pre_tokenizers
            self.normalizer = Tokenizer.from_file(self.path).normalizer
            self.splitter = pre_tokenizers.Split(Regex(self.split), "removed", invert=True)
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    # -- encoder -----------------------------------------------------------------

    def merge(self, ids: list[int]) -> list[int]:
        """All merges on one buffer, lowest rank first, leftmost first."""
        if len(ids) > 48:
            return self._merge_long(ids)
        rank_of, made = self.ranks.get, self.made
        ranks = [rank_of(pair, _NEVER) for pair in zip(ids, ids[1:])]
        while ranks and (rank := min(ranks)) != _NEVER:
            i = ranks.index(rank)
            ids[i:i + 2] = [made[rank]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), _NEVER)
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over linked positions."""
        n = len(ids)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        ranks, made = self.ranks, self.made
        heap = [(ranks[pair], i, *pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (pair := (ids[i], ids[k])) in ranks:
                    heapq.heappush(heap, (ranks[pair], i, *pair))
            if (h := before[i]) >= 0 and (pair := (ids[h], ids[i])) in ranks:
                heapq.heappush(heap, (ranks[pair], h, *pair))
        return [x for x in ids if x >= 0]

    def encode_word(self, word: bytes):
        """Ids of one pre-token, emitted as soon as they are stable."""
        inner, start, n = self.inner, 0, len(word)
        while n - start > self.buffer:
            window = word[start:start + self.buffer]
            tokens = self.merge([inner[b] for b in window])
            # Tokens that end with the lookahead still to come are final.
            stable, out = 0, []
            for t in tokens:
                size = len(self.bytes[t])
                if stable + size > self.buffer - self.lookahead:
                    break
                stable += size
                out.append(t)
            yield out
            start += stable
        if n > start:
            yield self.merge([inner[b] for b in word[start:n - 1]] + [self.final[word[n - 1]]])

    def encode(self, text: str | None):
        """Lists of ids of ``text`` (null: none), one for each chunk of it and
        for each stable part of a pre-token longer than the buffer."""
        parts = self.cut.split(text or "") if self.cut else [text or ""]
        for i, part in enumerate(parts):
            if i % 2:
                yield [self.special[part]]
                continue
            for words in self.pre_tokens(part):
                yield from self._ids(words)

    def _ids(self, words: list[str]):
        if max(map(len, words), default=0) <= self.buffer:
            yield list(itertools.chain.from_iterable(map(self.kept.__getitem__, words)))
            return
        for streams, some in itertools.groupby(words, lambda w: len(w) > self.buffer):
            if streams:
                for word in some:
                    yield from self.encode_word(word.encode())
            else:
                yield list(itertools.chain.from_iterable(map(self.kept.__getitem__, some)))

    # -- decoder -----------------------------------------------------------------

    def decode(self, blocks, pieces: bool = False):
        """Text of id lists, piece by piece. ``pieces``: the vocabulary's own
        strings joined by spaces (what the library's decode gives for a file
        without a decoder); else the bytes they stand for."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        names, gap = (self.pieces, b" ") if pieces else (self.bytes, b"")
        first = True
        for ids in blocks:
            for lo in range(0, len(ids), BLOCK):
                data = gap.join(map(names.__getitem__, ids[lo:lo + BLOCK]))
                yield state.decode(data if first or not gap else gap + data)
                first = False
        yield state.decode(b"", True)


class _Kept(dict):
    """Pre-token -> ids; emptied when it reaches its bound."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> list[int]:
        bpe, raw = self.bpe, word.encode()
        if len(raw) > bpe.buffer:
            return list(itertools.chain.from_iterable(bpe.encode_word(raw)))
        ids = [bpe.inner[b] for b in raw]
        ids[-1] = bpe.final[raw[-1]]
        ids = bpe.merge(ids)
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = ids
        return ids


_NEVER = 1 << 60
_GAP = re.compile("[ \\t\\n\\r]")
# Characters below U+0180 and some punctuation: all single code points that NFC
# leaves alone, with the same categories in every Unicode version.
_PLAIN = re.compile("[\x00-\u017f\u2010-\u2027\u2030-\u205e\u20ac]*")


def _plain_split():
    """The tokenizer's split for lower-cased plain text, with the letters and
    digits spelt out so that the faster standard module can run it."""
    def make():
        low = [chr(c) for c in range(0x180)]
        letters = "".join(c for c in low if regex.match(r"\p{L}", c))
        digits = "".join(c for c in low if regex.match(r"\p{N}", c))
        spaces = r"\t-\r \x85\xa0\u2028\u2029\u202f\u205f"
        return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+")
    return per_worker("bpe-split", make)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def load(path: str) -> Bpe:
    return per_worker(f"bpe:{path}", lambda: Bpe(path))


# -- Spark -----------------------------------------------------------------------

def encode_column(text, vocabulary: str = VOCABULARY):
    """Column of token ids (array<int>) of a text column; null: empty."""
    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        bpe = load(vocabulary_path(vocabulary))
        return pd.Series([np.fromiter(itertools.chain.from_iterable(bpe.encode(t)), np.int32) for t in texts],
                         dtype=object)
    return ids(text)


def decode_column(ids, vocabulary: str = VOCABULARY, pieces: bool = False):
    """Column of texts of a column of token ids."""
    @F.pandas_udf("string")
    def text(arrays: pd.Series) -> pd.Series:
        bpe = load(vocabulary_path(vocabulary))
        return pd.Series(["".join(bpe.decode([np.asarray(a, np.int64).tolist()], pieces)) if a is not None else None
                          for a in arrays], dtype=object)
    return text(ids)


def digests(bpe: Bpe, text: str | None) -> tuple[int, str, str]:
    """(tokens, SHA-256 of the decimal ids, SHA-256 of the decoded text), block by block."""
    decimal = bpe.decimal
    ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0

    def blocks():
        nonlocal n
        for ids in bpe.encode(text):
            if ids:
                ids_hash.update(((" " if n else "") + " ".join(map(decimal.__getitem__, ids))).encode())
                n += len(ids)
                yield ids
    for piece in bpe.decode(blocks(), pieces=True):
        text_hash.update(piece.encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def _digests(vocabulary: str):
    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        bpe = load(vocabulary_path(vocabulary))
        return pd.DataFrame([digests(bpe, t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def encode_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` without its text, plus n_tokens, ids_sha256 (of the decimal
    ids joined by one space) and decoded_sha256 (of the decoded text), each
    computed block by block. Input columns with these names are replaced.

    Null and empty texts have no tokens. Strings of special tokens in a text
    are these tokens, as in the library. An empty table gives an empty table.
    """
    cols = without(docs, "text", "n_tokens", "ids_sha256", "decoded_sha256", "__out")
    return (docs.withColumn("__out", _digests(vocabulary)(F.col("text")))
            .select(*map(quoted, cols), "__out.n_tokens", "__out.ids_sha256", "__out.decoded_sha256"))


def op1(spark, sf_dir):
    return encode_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))

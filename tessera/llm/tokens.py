"""Token ids and token counts of whole texts with a public byte-level BPE vocabulary.

Ids are those that the ``tokenizers`` library gives for the vocabulary's JSON file. Texts of Latin letters without the
vocabulary's special strings are encoded by ``tiktoken`` with the ranks of that same file, which gives the same ids in a third
of the time (the tests compare the two); all others go to ``tokenizers`` itself, because there the splitting may
depend on the library's own Unicode tables.

Prefix counts (op4): ``PrefixCounter`` fills a table ``count[i] = count[i - len(last)] + 1`` over every prefix of
a pre-token, where ``last`` is the only vocabulary entry ending there that the BPE would leave beside
the last token of the shorter prefix. Counts of whole texts, cuts at a budget and counts of any prefix
are read from these tables; nothing is encoded again.

Defined results: null text counts as empty (0 tokens); empty text has 0 tokens; a very long text, word or run of white space is counted whole, in time
that follows its length; rows are kept as they are, repeated ones too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._tables import map_batches

MEMO_ENTRIES = 400_000
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
#: White space before a space: only there may a split before the space differ from the pre-tokeniser's.
_DOUBLE_SPACE = [f"{c} " for c in " \t\n\v\f\r\x85\xa0"]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on each core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Memo(dict):
    """Pre-token -> what ``make`` gives for it. Two generations bound the size and keep what is in use."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) < 60:
            if len(self) >= MEMO_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Splitter:
    """The pre-tokeniser, for texts that are ``settled``: whose splitting does not depend on the library's own tables."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        pattern = regex.compile(public_tokenizers.PATTERN)
        self.findall, self.finditer = pattern.findall, pattern.finditer
        self.special = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> list[str]:
        return self.findall(text)

    def each(self, text: str, at: int = 0) -> Iterator[str]:
        """The pre-tokens of ``text`` from position ``at`` on, one by one."""
        return (m[0] for m in self.finditer(text, at))

    def settled(self, text: str) -> bool:
        return not any(t in text for t in self.special) and (text.isascii() or not _BEYOND_LATIN.search(text))


@lru_cache(2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


def _ranks(path: str) -> dict[bytes, int]:
    """Bytes of each vocabulary entry -> its id, which is also its merge rank."""
    import json

    alphabet, special = _byte_of_character(), splitter(path).special
    return {bytes(map(alphabet.__getitem__, t)): i for t, i in json.loads(tokenizer(path).to_str())["model"]["vocab"].items() if t not in special}


class TextEncoder:
    """Ids of whole texts as little-endian 32-bit numbers, without added special tokens."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.encode, self.settled = tokenizer(path).encode, splitter(path).settled
        self.fast = tiktoken.Encoding("settled", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={}).encode_to_numpy

    def packed(self, text: str) -> bytes:
        if self.settled(text):
            try:
                return self.fast(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # a run of white space too long for the stack of its pattern matcher
                pass
        ids = self.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(2)
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def _byte_of_character() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts of every prefix of a text, by dynamic programming."""

    def __init__(self, path: str):
        self.split, self.rank = splitter(path), _ranks(path)
        lengths: dict[bytes, set[int]] = {}
        for token in self.rank:
            lengths.setdefault(token[-2:], set()).add(len(token))
        #: Lengths that entries with these last two bytes have, longest first.
        self.lengths = {tail: sorted(found, reverse=True) for tail, found in lengths.items()}
        self.special = re.compile("|".join(map(re.escape, self.split.special))) if self.split.special else None
        self.beside: dict[tuple[bytes, bytes], bool] = {}
        self.solo: dict[bytes, bool] = {}
        self.spaced = Memo(lambda piece: sum(map(self.ends.__getitem__, self.split(" " + piece))))
        self.ends = Memo(lambda w: self.word(w.encode("utf-8", "surrogatepass"))[-1])

    def _merged(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 40:
                break
            pair, out, i = parts[best[1]] + parts[best[1] + 1], [], 0
            left, right = parts[best[1]], parts[best[1] + 1]
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == left and parts[i + 1] == right:
                    out.append(pair)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _alone(self, token: bytes) -> bool:
        known = self.solo.get(token)
        if known is None:
            known = self.solo[token] = self._merged(token) == [token]
        return known

    def _stay(self, left: bytes, right: bytes) -> bool:
        known = self.beside.get((left, right))
        if known is None:
            if len(self.beside) >= MEMO_ENTRIES:
                self.beside.clear()
            known = self.beside[left, right] = self._merged(left + right) == [left, right]
        return known

    def word(self, word: bytes) -> list[int]:
        """Token counts of the byte prefixes of one pre-token, of lengths 0 to all."""
        rank, last, count, none = self.rank, [b""], [0], []
        for i in range(1, len(word) + 1):
            tail = word[max(0, i - 2) : i]
            for n in (*self.lengths.get(tail, none), 1) if i > 1 else (1,):
                j = i - n
                if j < 0:
                    continue
                token = word[j:i]
                if token in rank and (self._stay(last[j], token) if j else self._alone(token)):
                    last.append(token)
                    count.append(count[j] + 1)
                    break
        return count

    def _walk(self, text: str, at: int = 0) -> Iterator[tuple[int, int, list[int]]]:
        """(start, tokens before it, counts) of stretches of ``text`` without special strings, in order, from position ``at`` on.

        ``counts[j]`` is what the prefix of ``text`` that ends j + 1 characters behind ``start`` adds to ``tokens before it``. A prefix is split as
        the text is, up to the pre-token in which it ends, with two exceptions: white space that the text leaves to the next
        pre-token still belongs to the run before it while nothing follows, and a cut contraction is split anew.
        """
        base, blank = 0, None  # blank: the run of white space just before, and the tokens before it
        for w in self.split.each(text, at):
            raw = w.encode("utf-8", "surrogatepass")
            if w[0] == "'" and len(w) > 1 and w[1].isalpha():  # three characters at most
                counts = [sum(self.ends[x] for x in self.split(w[:j])) for j in range(1, len(w) + 1)]
            else:
                counts = self.word(raw)
                counts = counts[1:] if len(raw) == len(w) else [counts[k] for k in accumulate(len(c.encode("utf-8", "surrogatepass")) for c in w)]
            total = counts[-1]
            if blank and w[0].isspace():
                counts = [self.ends[blank[0] + w[0]] + blank[1] - base, *counts[1:]]
            yield at, base, counts
            blank = (w, base) if w.isspace() else None
            base += total
            at += len(w)

    def _plain(self, text: str) -> list[int]:
        """Counts of the character prefixes of a text without special strings."""
        return [0] + [base + c for _, base, counts in self._walk(text) for c in counts]

    def counts(self, text: str) -> list[int]:
        """Exact token count of every character prefix of ``text``, of lengths 0 to all."""
        out, at = [0], 0
        for m in self.special.finditer(text) if self.special else ():
            part, base = self._plain(text[at : m.end()]), out[-1]
            out += [base + c for c in part[1:-1]]  # a prefix that ends inside the special string is ordinary text
            out.append(base + part[m.start() - at] + 1)
            at = m.end()
        base = out[-1]
        return out + [base + c for c in self._plain(text[at:])[1:]]

    def total(self, text: str) -> int:
        """The last entry of ``counts``, put together from the last entries of the pre-tokens' tables."""
        if not self.split.settled(text):
            parts = self.special.split(text) if self.special else [text]
            return len(parts) - 1 + sum(self.ends[w] for part in parts for w in self.split(part))
        if any(x in text for x in _DOUBLE_SPACE):
            return sum(map(self.ends.__getitem__, self.split(text)))
        first, *rest = text.split(" ")
        return sum(map(self.ends.__getitem__, self.split(first))) + sum(map(self.spaced.__getitem__, rest))

    def cut(self, text: str, budget: int) -> int:
        """Length in characters of the longest prefix of at most ``budget`` tokens; the walk ends soon behind it."""
        if self.special and self.special.search(text):
            return max(i for i, c in enumerate(self.counts(text)) if c <= budget)
        best = run = base = at = 0  # run: tokens before the stretch before, which no later prefix can undo
        before = ""
        for w in self.split.each(text):
            if run > budget:
                break
            total = self.ends[w]
            if base + total <= budget:
                best = at + len(w)
            else:
                back = len(before) if before.isspace() else 0
                for start, tokens, counts in self._walk(text[at - back : at + len(w)] if back else w):
                    fits = [j for j, c in enumerate(counts) if run * (back > 0) + base * (back == 0) + tokens + c <= budget]
                    best = max(best, at - back + start + fits[-1] + 1) if fits else best
            run, before = base, w
            base += total
            at += len(w)
        return best


@lru_cache(2)
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return batch.column("text").fill_null("").to_pylist()


def token_counts(docs: DataFrame, limit: int = 1024, vocabulary: str | None = None) -> DataFrame:
    """Bytes and exact tokens of every whole text, and the longest prefix that ``limit`` tokens hold.

    Columns: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), kept_chars (characters of that prefix).
    """
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in batches:
            texts = _texts(batch)
            totals = [counter.total(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(totals, pa.int64()),
                    pa.array([n > limit for n in totals], pa.bool_()),
                    pa.array([counter.cut(t, limit) if n > limit else len(t) for t, n in zip(texts, totals, strict=True)], pa.int64()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_batches, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, kept_chars long")


def prefix_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and ``prefix_tokens``: the exact token count of each character prefix, of lengths 0 to the whole."""
    path = vocabulary or default_vocabulary()

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in batches:
            for i, text in enumerate(_texts(batch)):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), pa.array([counter.counts(text)], pa.list_(pa.int32()))], ["doc_id", "prefix_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").transform(map_batches, tables, "doc_id long, prefix_tokens array<int>")

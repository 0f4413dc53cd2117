"""Operator 3, BPE encoding and decoding by a bounded-lookahead streaming transducer.

**Lookahead.** Let a word go on beyond what has been read. The rules act in rank order; after the rules
up to some rank, the segmentations with and without the continuation agree up to a boundary b, at
first the end of what was read. Rule (u, v) moves b only if u ends at b and, in one of the two
segmentations, v starts there; it then moves b back by the length of u. For a later rule (u', v') to
move it again, v' must start with what now stands there: uv, or u itself. So the total move is at most
the largest sum of len(u) over chains of rules of rising rank in which each next v' has the last u or
uv on its left spine. ``sufficient_lookahead`` computes that maximum over the merge list. Tokens
that end at least so many symbols before the end of what was read are stable, and are
emitted; the encoder keeps at most twice that many symbols of a word, however long the word is.

**Decoding** feeds the tokens' bytes to a state machine that emits text as soon as its UTF-8
sequences are complete.

The vocabulary files are parameters (paths); nothing of them is kept here.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED = 150_000  # words that each of the two generations of a cache remembers
BLOCK = 4096  # chunks between spaces that are settled at a time
_TWO_SPACES = regex.compile(r"\s\s")


class Recent:
    """A bounded memory of two generations: a full young one becomes the old one, whose used entries return."""

    def __init__(self, size: int = CACHED) -> None:
        self.size, self.young, self.old = size, {}, {}

    def again(self, key: str):
        """The entry that only the old generation may have."""
        if (entry := self.old.get(key)) is not None:
            self.put(key, entry)
        return entry

    def put(self, key: str, entry) -> None:
        if len(key) <= 64:
            if len(self.young) >= self.size:
                self.old = dict(self.young)
                self.young.clear()
            self.young[key] = entry


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else one from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return {b: chr(b) if b in set(kept) else chr(next(spare)) for b in range(256)}


class ByteToText:
    """Incremental UTF-8: ``push`` returns the text completed so far; invalid bytes become U+FFFD."""

    def __init__(self) -> None:
        self.pending = b""

    def push(self, data: bytes) -> str:
        data = self.pending + data
        keep = 0
        for back in range(1, min(4, len(data) + 1)):
            lead = data[-back]
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                keep = back if back < need else 0
                break
            if lead < 0x80:
                break
        self.pending = data[len(data) - keep :] if keep else b""
        return data[: len(data) - keep].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.pending = self.pending, b""
        return rest.decode("utf-8", "replace")


def sufficient_lookahead(merges: list[tuple[str, str]], lengths: dict[str, int]) -> int:
    """The most symbols by which a continuation can move the last agreed boundary back (see above)."""
    halves, reach, most = {}, {}, 0
    for u, v in merges:
        below, at = 0, v
        while True:
            below = max(below, reach.get(at, 0))
            if at not in halves:
                break
            at = halves[at]
        move = lengths[u] + below
        most = max(most, move)
        for moved in (u, u + v):
            reach[moved] = max(reach.get(moved, 0), move)
        halves.setdefault(u + v, u)
    return most


class WordBPE:
    """Streaming encoder and decoder of a word-end BPE vocabulary in the tokenizers JSON format.

    Supported: NFC, white-space and lower-case normalisation, the split pattern given in the file, byte-level
    symbols, and a suffix on each word's last symbol, as ``word_bpe_49k.json`` has them.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.lookahead = sufficient_lookahead(merges, {t: len(t) - len(self.suffix) * (t.endswith(self.suffix) and t != self.suffix) for pair in merges for t in pair})
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.marks = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.names = {i: t for t, i in [*self.vocab.items(), *special.items()]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.alphabet = byte_alphabet()
        self.table = {b: self.alphabet[b] for b in range(256)}
        self.cache, self.known = Recent(), Recent()
        self.spelled = {i: t.encode("utf-8") for i, t in self.names.items()}

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str) -> WordBPE:
        return WordBPE(path)

    def _merge(self, symbols: list[str]) -> list[str]:
        """Apply the rules to a buffer in rank order, each from left to right."""
        rank, never = self.ranks.get, 1 << 30
        found = [rank(pair, never) for pair in zip(symbols, symbols[1:])]
        while found:
            best = min(found)
            if best == never:
                break
            i = found.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del found[i]
            if i:
                found[i - 1] = rank((symbols[i - 1], symbols[i]), never)
            if i < len(found):
                found[i] = rank((symbols[i], symbols[i + 1]), never)
        return symbols

    def _tokens(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word, each emitted once it is stable; the last symbol bears the suffix."""
        buffer: list[str] = []
        room = 2 * self.lookahead + 2
        for symbol in symbols:
            buffer.append(symbol)
            if len(buffer) >= room:
                stable, at = len(buffer) - 1 - self.lookahead, 0  # the newest may yet be the last
                for token in self._merge(buffer[:-1]):
                    if at + len(token) > stable:
                        break
                    at += len(token)
                    yield token
                buffer = buffer[at:]
        if buffer:
            buffer[-1] += self.suffix
            yield from self._merge(buffer)

    def normalise(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return text.lower() if text.isascii() else "".join([c.lower() for c in text])

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens. Symbols that the vocabulary lacks give none."""
        out = []
        for word in self.words.findall(self.normalise(text)):
            out += self.known.young.get(word) or self.known.again(word) or self._word(word)
        return out

    def _word(self, word: str) -> list[int]:
        tokens = self._tokens([self.table[b] for b in word.encode("utf-8", "replace")])
        ids = [self.vocab[t] for t in tokens if t in self.vocab]
        self.known.put(word, ids)
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; the special tokens' strings in it become their ids."""
        out, at = [], 0
        for mark in self.marks.finditer(text) if self.marks else ():
            out += [*self.encode_plain(text[at : mark.start()]), self.special[mark[0]]]
            at = mark.end()
        return out + self.encode_plain(text[at:])

    def decode_pieces(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of ``ids`` piece by piece: the tokens' names, a space between two (the file names no decoder)."""
        machine, gap = ByteToText(), b""
        for i in ids:
            if (name := self.spelled.get(i)) is not None:
                yield machine.push(gap + name)
                gap = b" "
        yield machine.end()

    def _settled(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        """Ids in decimal form and the bytes they stand for, of up to ``BLOCK`` chunks of the text at a time; a special token stands alone."""
        remembered = self.cache.young
        parts = self.marks.split(text) if self.marks and "<|" in text else [text]
        marks = self.marks.findall(text) if len(parts) > 1 else []
        for k, part in enumerate(parts):
            if k:
                yield b"%d" % self.special[marks[k - 1]], marks[k - 1].encode()
            # No word, and no composed character, reaches across a space or a line feed.
            rest = part.replace("\n", " ")
            while rest:
                chunks = rest.split(" ", BLOCK)
                rest = chunks.pop() if len(chunks) > BLOCK else ""
                found = [remembered.get(chunk) or self._remember(chunk) for chunk in chunks if chunk]
                ids = b" ".join([x for x, _ in found if x])
                if ids:
                    yield ids, b" ".join([y for x, y in found if x])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids' decimal form, SHA-256 of the text they decode to.

        Both hashes take in what is settled as it comes; neither the ids nor the decoded text of a whole text are ever held.
        """
        ids_hash, text_hash, machine, n, gap = hashlib.sha256(), hashlib.sha256(), ByteToText(), 0, b""
        for ids, data in self._settled(text):
            ids_hash.update(gap + ids)
            text_hash.update(machine.push(gap + data).encode("utf-8"))
            n, gap = n + ids.count(b" ") + 1, b" "
        text_hash.update(machine.end().encode("utf-8"))
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def _remember(self, chunk: str) -> tuple[bytes, bytes]:
        """A chunk's ids in decimal form and the bytes they stand for, from the transducer."""
        if entry := self.cache.again(chunk):
            return entry
        ids = self.encode_plain(chunk)
        entry = (b" ".join([b"%d" % i for i in ids]), b" ".join([self.spelled[i] for i in ids]))
        self.cache.put(chunk, entry)
        return entry


class ByteBPE:
    """Encoder of a byte-level BPE vocabulary in the tokenizers JSON format whose ids follow the merge order."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in byte_alphabet().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed by the format
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.starts, self.spaced = Recent(), Recent()

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str) -> ByteBPE:
        return ByteBPE(path)

    def _ids(self, text: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.bpe.encode_ordinary(text)])

    def _remember(self, cache: Recent, word: str, text: str) -> bytes:
        if (ids := cache.again(word)) is None:
            ids = self._ids(text)
            cache.put(word, ids)
        return ids

    def _plain(self, text: str) -> bytes:
        if _TWO_SPACES.search(text):
            return self._ids(text)
        # Alone between two other characters, a space starts a word and a line feed is one.
        starts, spaced, out = self.starts, self.spaced, []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(starts.young.get("\n") or self._remember(starts, "\n", "\n"))
            first, *rest = line.split(" ")
            if first:
                out.append(starts.young.get(first) or self._remember(starts, first, first))
            known = spaced.young.get
            out += [known(w) or self._remember(spaced, w, " " + w) for w in rest]
        return b"".join(out)

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit numbers."""
        if not self.marks or not self.marks.search(text):
            return self._plain(text)
        out, at = [], 0
        for mark in self.marks.finditer(text):
            out += [self._plain(text[at : mark.start()]), self.special[mark[0]].to_bytes(4, "little")]
            at = mark.end()
        return b"".join([*out, self._plain(text[at:])])


def digests(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row.

    Defined results: a null text counts as empty; an empty one has no ids and decodes to the empty
    text; repeated rows are encoded each time; an empty table gives no rows. Other columns aren't read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordBPE.load(tokenizer)
        for batch in batches:
            found = [encoder.digest(x or "") for x in batch.column(1).to_pylist()]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(encoded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

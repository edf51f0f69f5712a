"""BPE encoding and decoding with a vocabulary file of a public tokenizer.

The encoder is a transducer with bounded lookahead. A merge can only be kept from happening by a merge of lower rank to its
right, which takes the last part of its right side; that one in turn by one of a still lower rank. The bytes that the
longest such chain spans are the merge list's sufficient lookahead: a token that ends at least so far before the end of
what has been read is final, whatever follows. Words go through a window of that size, so that memory does not grow with
them; texts go through in blocks that end at white space. The decoder takes ids one at a time and keeps the bytes of an
unfinished character alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import table

BLOCK = 1 << 16
CACHED_WORDS = 300_000
_ALNUM = regex.compile(r"[\p{L}\p{N}]")


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(0x100 + rest.index(b)) for b in range(256)]


class Merges:
    """A merge list over ids: pairs of ids to (rank, merged id)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        spine: dict[int, tuple[int, ...]] = {}  # a token and the last parts it is made of
        size = {i: len(t.removesuffix(suffix)) for t, i in vocab.items()}
        reach: dict[int, int] = {}  # of the merges so far that have the token on the left: the most bytes that matter to the right of it
        for rank, (a, b) in enumerate(merges):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pairs.setdefault((left, right), (rank, whole))
            ends = spine.get(right, (right,))
            far = size[right] + max((reach.get(x, 0) for x in ends), default=0)
            reach[left] = max(reach.get(left, 0), far)
            if whole not in spine:
                spine[whole] = (whole, *ends)
        #: Bytes after a token's end that can still change it.
        self.lookahead = max(reach.values(), default=0)
        self.longest = max(size.values(), default=1)

    def merged(self, ids: list[int]) -> list[int]:
        """The pair of the lowest rank is merged, the leftmost first, until none is left. Long sequences use a heap."""
        pairs = self.pairs
        if len(ids) > 48:
            return self._heaped(ids)
        while len(ids) > 1:
            best, at, whole = None, -1, -1
            left = ids[0]
            for i in range(1, len(ids)):
                right = ids[i]
                found = pairs.get((left, right))
                if found is not None and (best is None or found[0] < best):
                    best, at, whole = found[0], i, found[1]
                left = right
            if best is None:
                break
            ids[at - 1 : at + 1] = [whole]
        return ids


    def _heaped(self, ids: list[int]) -> list[int]:
        pairs, n = self.pairs, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(*found, i) for i in range(n - 1) if (found := pairs.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, whole) for rank, whole, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, whole = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or pairs.get((ids[i], ids[j])) != (rank, whole):
                continue  # one side went into another merge
            ids[i], ids[j], after[i] = whole, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else -1
                if b >= 0 and (found := pairs.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (found[0], a, found[1]))
        return [i for i in ids if i >= 0]


class Encoder:
    """Encodes as the vocabulary file's own library does, without adding special tokens.

    Files of one kind are read: byte-level BPE with a suffix at word ends and a normalizer of NFC, one space for white
    space, and lower case; others raise ValueError.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError(f"{path}: not a vocabulary of the kind that is read here")
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        self.merges = Merges(vocab, [tuple(m) for m in model["merges"]], suffix)
        chars = byte_chars()
        self.inner = [vocab[c] for c in chars]
        self.final = [vocab[c + suffix] for c in chars]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.suffix = suffix
        # White space is the Unicode property, not what this library takes \s to be.
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        pattern = pattern.replace(r"^\s", r"^\p{White_Space}")
        self.words = regex.compile(pattern)
        # Letters and digits that Unicode got after this vocabulary's library was made are signs to it.
        newer = "".join(c for c in map(chr, range(0x300, 0x110000)) if unicodedata.category(c) == "Cn" and _ALNUM.match(c))
        self.newer = regex.compile(f"[{regex.escape(newer)}]") if newer else None
        sign = rf"(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|{self.newer.pattern})+" if newer else ""
        old = pattern.replace(r"[\p{L}]+", rf"(?:(?!{self.newer.pattern})\p{{L}})+").replace(r"[\p{N}]", rf"(?!{self.newer.pattern})\p{{N}}") if newer else ""
        self.words_newer = regex.compile(old.replace(r"[^\p{White_Space}\p{L}\p{N}]+", sign)) if newer else self.words
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> Iterator[int]:
        """The ids of one word as they become final, from a window of bounded size."""
        raw = word.encode("utf-8", "surrogatepass")
        keep = self.merges.lookahead
        step = 4 * (keep + self.merges.longest)
        at = 0
        while at < len(raw):
            end = min(len(raw), at + step)
            ids = [self.inner[b] for b in raw[at:end]]
            if end == len(raw):
                ids[-1] = self.final[raw[-1]]
                yield from self.merges.merged(ids)
                return
            left = end - at - keep
            for i in self.merges.merged(ids):
                left -= len(self.names[i])
                if left < 0:
                    break
                at += len(self.names[i])
                yield i

    def cached(self, word: str) -> tuple[int, ...]:
        found = tuple(self.word(word))
        if len(word) < 64:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            self.cache[word] = found
        return found

    def split(self, text: str) -> list[str]:
        """The words of a normalized text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.newer is not None and self.newer.search(text):
                return self.words_newer.findall(text)
        return self.words.findall(text)

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        # Lower case goes letter by letter there: a sigma at a word's end is like any other.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def blocks(self, text: str) -> Iterator[str]:
        """The text in blocks that end before a space or a line end, where neither normalization nor words go on."""
        at = 0
        while len(text) - at > BLOCK:
            end = at + BLOCK
            while end < len(text) and text[end] not in " \n":
                end += 1
            yield text[at:end]
            at = end
        yield text[at:] if at else text

    def ids(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a text, block by block. Null and empty texts have none."""
        if not text:
            return
        get, cached = self.cache.get, self.cached
        for part in self.parts.split(text) if self.parts and "<|" in text else (text,):
            if part in self.special:
                yield [self.special[part]]
                continue
            for block in self.blocks(part):
                yield list(chain.from_iterable([get(w) or cached(w) for w in self.split(self.normal(block))]))


class Decoder:
    """Ids to the names of tokens with spaces between, as the file's library decodes where the file names no decoder."""

    def __init__(self, names: dict[int, str]):
        self.names, self.started = names, False

    def take(self, ids: Iterable[int]) -> str:
        found = " ".join(map(self.names.__getitem__, ids))
        if found and self.started:
            found = " " + found
        self.started |= bool(found)
        return found


class TextDecoder:
    """Ids to readable text: bytes are gathered until they make a character; word ends become spaces."""

    def __init__(self, encoder: Encoder):
        import codecs

        self.of = {c: b for b, c in enumerate(byte_chars())}
        self.encoder, self.state = encoder, codecs.getincrementaldecoder("utf-8")("replace")

    def take(self, i: int, last: bool = False) -> str:
        name = self.encoder.names[i]
        if i in self.encoder.special.values():
            return self.state.decode(b"", True) + name
        ends = name.endswith(self.encoder.suffix)
        raw = bytes(self.of[c] for c in (name.removesuffix(self.encoder.suffix) if ends else name))
        return self.state.decode(raw, last or ends) + (" " if ends else "")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder in each Python worker."""
    return Encoder(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, path: str, *, text_col: str = "text", with_ids: bool = True, with_digests: bool = True) -> DataFrame:
    """docs without text_col and with n_tokens, and ids, or ids_sha256 and decoded_sha256.

    Columns of these names are replaced. Null and empty texts have no ids. ids_sha256 is of the ids as little-endian
    unsigned 32-bit integers, decoded_sha256 of what the ids decode to.
    """
    new = {"n_tokens": F.lit(0).cast("long")}
    if with_ids:
        new["ids"] = F.array().cast("array<int>")
    if with_digests:
        new |= {"ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}
    base = docs.drop(*[c for c in ("n_tokens", "ids", "ids_sha256", "decoded_sha256") if c != text_col])
    schema = base.drop(text_col).withColumns(new).schema
    names = list(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in names}
            for text in batch.column(text_col).to_pylist():
                ids, decoder, raw, read, n, kept = None, Decoder(own.names), hashlib.sha256(), hashlib.sha256(), 0, []
                for ids in own.ids(text):
                    n += len(ids)
                    if with_ids:
                        kept.extend(ids)
                    if with_digests:
                        raw.update(array("I", ids).tobytes())
                        read.update(decoder.take(ids).encode("utf-8"))
                out["n_tokens"].append(n)
                if with_ids:
                    out["ids"].append(kept)
                if with_digests:
                    out["ids_sha256"].append(raw.hexdigest())
                    out["decoded_sha256"].append(read.hexdigest())
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
            cols = [pa.array(out[f.name], kinds[f.name]) if f.name in names else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema])

    return base.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_texts(docs, vocabulary(), with_ids=False)

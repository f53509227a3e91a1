"""BPE encoding and decoding by per-prefix dynamic programming.

For each prefix of a word exactly one token ends its BPE encoding. An Aho-Corasick automaton
over the vocabulary yields, at each position, every token that is a suffix of the prefix;
the right one is the one that is compatible with the last token of the prefix before it,
which a walk down the two tokens' merge trees decides. The tokens so stored are followed
back from the end of the word to emit the ids. No merge loop runs over the text.

A tokenizer file says how a text is normalised and split into words; special tokens are cut
out of the text first. Words repeat, so each task keeps a bounded memo of encoded words.

Defined results: a null text encodes like an empty one (no ids, empty decoded text); very
long texts are encoded whole; repeated rows each give a row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: White space as Unicode has it; Python's own class also holds 1C-1F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters whose class is the same in all Unicode versions in use. Texts with others are
#: normalised and split by the tokenizers library itself, whose tables then decide.
_SETTLED = re.compile(r"[^\x00-\u024f\u2000-\u206f\u20ac]")
#: Words that a task's memo holds at most; a full memo starts anew.
MEMO_WORDS = 400_000
#: Token pairs whose compatibility a task remembers at most.
MEMO_PAIRS = 1_000_000


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordBPE:
    """Encoder for a tokenizer file of kind BPE with byte-level letters and an end-of-word mark."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["unk_token"] or model["continuing_subword_prefix"] or not end or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError(f"{path}: not a lower-casing byte-level BPE file with word ends")
        vocab: dict[str, int] = model["vocab"]
        self.texts = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", "[^" + SPACE))
        self._space = re.compile(f"[{SPACE}]+")
        self._library, self._path = None, path
        # One private character per base symbol: a byte inside a word, or a byte that ends it.
        chars = byte_chars()
        self._bytes = {c: b for b, c in chars.items()}
        self._inner = {b: 0xE000 + b for b in range(256)}
        self._final = [chr(0xE100 + b) for b in range(256)]
        symbols: dict[int, str] = {}
        for b, c in chars.items():
            symbols[vocab[c]] = chr(self._inner[b])
            symbols[vocab[c + end]] = self._final[b]
        base = len(symbols)
        self.pairs: dict[tuple[int, int], int] = {}  # (left, right) -> merged id
        self.split: dict[int, tuple[int, int]] = {i: (i, i) for i in symbols}
        self.rank: dict[int, int] = dict.fromkeys(symbols, -1)
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, ab = vocab[left], vocab[right], vocab[left + right]
            self.pairs[a, b] = ab
            if ab not in self.split:
                self.split[ab], self.rank[ab], symbols[ab] = (a, b), rank, symbols[a] + symbols[b]
        if any(self.rank[self.pairs[p]] < max(self.rank[p[0]], self.rank[p[1]]) for p in self.pairs) or len(symbols) != base + len(set(self.pairs.values())):
            raise ValueError(f"{path}: a merge comes before its parts")
        own: set[int] = set()  # tokens that their own text encodes to
        for i in sorted(symbols, key=self.rank.__getitem__):
            a, b = self.split[i]
            if a == b == i or (a in own and b in own and self._compatible(a, b, self.rank[i])):
                own.add(i)
        self._automaton = ahocorasick.Automaton()
        for i in own:
            self._automaton.add_word(symbols[i], i)
        self._automaton.make_automaton()
        self._length = [len(symbols.get(i, "")) for i in range(max(symbols) + 1)]
        self._known: dict[int, bool] = {}  # compatibility of pairs seen
        self._memo: dict[str, bytes] = {}

    def _compatible(self, left: int, right: int, limit: int | None = None) -> bool:
        """Whether BPE keeps a boundary between two tokens that follow each other.

        Undoes merges on both sides of the boundary, latest first. If a pair that meets
        there merges before what was undone on its sides, the boundary would not stand.
        """
        rank, split, pairs = self.rank, self.split, self.pairs
        limit = limit if limit is not None else 1 << 60
        while True:
            merged = pairs.get((left, right))
            if merged is not None and rank[merged] < limit:
                return False
            # The later of the two tokens is undone. Of equal ones it is the right one:
            # merges of one rank run from the left, so at a tie the left token forms first.
            if rank[left] > rank[right]:
                if rank[left] < 0:
                    return True
                limit, left = rank[left], split[left][1]
            else:
                if rank[right] < 0:
                    return True
                limit, right = rank[right] + 1, split[right][0]

    def word_ids(self, symbols: str) -> list[int]:
        """Token ids of one word of base symbols."""
        n = len(symbols)
        last, size, length = [-1] * (n + 1), [0] * (n + 1), self._length
        known, done = self._known, -1
        for end, token in self._automaton.iter(symbols):
            if end == done:
                continue  # the unique last token of this prefix is known
            start = end + 1 - length[token]
            if start:
                before = last[start]
                if before < 0:
                    continue
                pair = before << 20 | token
                fits = known.get(pair)
                if fits is None:
                    if len(known) >= MEMO_PAIRS:
                        known.clear()
                    fits = known[pair] = self._compatible(before, token)
                if not fits:
                    continue
            last[end + 1], size[end + 1], done = token, end + 1 - start, end
        ids, at = [], n
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def _encode_word(self, word: str) -> bytes:
        data = word.encode("utf-8")
        found = array("I", self.word_ids(data[:-1].decode("latin-1").translate(self._inner) + self._final[data[-1]])).tobytes()
        if len(self._memo) >= MEMO_WORDS:
            self._memo.clear()
        if len(word) <= 64:
            self._memo[word] = found
        return found

    def normalise(self, text: str) -> str:
        """NFC, runs of white space to one space, lower case of each character by itself."""
        text = self._space.sub(" ", unicodedata.normalize("NFC", text))
        return text.lower() if "Σ" not in text else "".join([c.lower() for c in text])

    def split_words(self, text: str) -> list[str]:
        """The words of a text that holds no special token, normalised."""
        if not _SETTLED.search(text):
            return self._words.findall(self.normalise(text))
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        pieces = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes([self._bytes[c] for c in piece]).decode("utf-8") for piece, _ in pieces]

    def encode(self, text: str | None) -> array:
        """Token ids of a text, unsigned 32-bit."""
        out, memo = [], self._memo
        for piece in self._cut.split(text or "") if self._cut else [text or ""]:
            if piece in self.special:
                out.append(array("I", [self.special[piece]]).tobytes())
                continue
            out += [memo.get(w) or self._encode_word(w) for w in self.split_words(piece)]
        return array("I", b"".join(out))

    def decode(self, ids: array) -> str:
        """The text of ids; the file names no decoder, so token texts are joined by spaces."""
        return " ".join(map(self.texts.__getitem__, ids))


_ENCODERS: dict[str, WordBPE] = {}


def encoder(path: str) -> WordBPE:
    """The encoder of a file, built once in each Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBPE(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row ``(doc_id, ids, decoded)`` per document; ``ids`` is binary, little-endian unsigned 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sys

        own = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # small results keep memory even
                part = batch.slice(at, 256)
                ids, decoded = [], []
                for t in part.column(1):
                    x = own.encode(t.as_py())
                    decoded.append(own.decode(x))
                    if sys.byteorder == "big":
                        x.byteswap()
                    ids.append(x.tobytes())
                yield pa.record_batch([part.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """Token count and digests of what :func:`encode` returns."""
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return encoded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def default_path() -> str:
    """The public word-end BPE file of 49 thousand tokens, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: token count and digests of ids and decoded text for every document."""
    return digest(encode(table(spark, sf_dir, "documents"), default_path()))

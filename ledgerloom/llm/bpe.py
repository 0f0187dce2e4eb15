"""Byte-pair encoding and decoding of whole texts by a prefix-sharing trie traversal.

A text falls into the words of the vocabulary's pre-tokenizer (the library's own one where a text holds characters whose
handling depends on the version of Unicode or on their neighbours). The distinct words of a run of documents are walked in the depth-first order of their trie (their sorted order; the path from the root is
a stack). Each node keeps one thing: the last token of the encoding of its prefix. That token fixes the encoding, as a
sequence of tokens is an encoding if and only if each pair of neighbours is one; so a node costs a few lookups, and
what two words share is worked out once. Words already seen are kept in a table of bounded size.

Defined cases: a null or empty text, or one of white space only, has no tokens and decodes to the empty string; equal
rows give equal results; a text of any length is one row of work; an empty table gives no rows; other columns of the
input do not matter.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from ledgerloom.llm.common import in_batches, runs, worker_keeps

#: Words that a worker's table keeps; a full table starts anew.
KEPT = 300_000
#: Answers about pairs of tokens that a worker's encoder keeps.
PAIRS = 100_000
#: A vocabulary file goes to every executor; larger ones are refused.
MOST_VOCABULARY_BYTES = 64 << 20

# Fixed values of the vocabulary's pre-tokenizer and of byte-level vocabularies; the second form is the first one's for
# lower-case texts of ASCII and the Latin letters up to U+024F, which the third one tells. Of the characters of the last
# one (Latin and its punctuation) each is composed, lower-cased and sorted into letters, digits and marks by itself, and
# alike in all versions of Unicode.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\u024f]+|[0-9]|[^\sa-z0-9\xdf-\xf6\xf8-\u024f]+", re.ASCII)
_LATIN = re.compile(r"[\x00-\x7f\xdf-\xf6\xf8-\u024f]*")
_STABLE = re.compile("[\x00-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20ac]*")
WORD_END = "</w>"


def _byte_letters() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()
_BYTES = {letter: b for b, letter in _LETTERS.items()}


def vocabulary_text(path: str) -> str:
    """The vocabulary file's content, of checked size."""
    with open(path, encoding="utf-8") as file:
        text = file.read(MOST_VOCABULARY_BYTES + 1)
    if len(text) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary file over {MOST_VOCABULARY_BYTES} bytes")
    return text


class TrieEncoder:
    """Encodes words of a merge list with word ends."""

    whole = None

    def __init__(self, vocabulary: str):
        self.library = Tokenizer.from_str(vocabulary)
        model = json.loads(vocabulary)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.raw = {t: k.to_bytes(4, "little") for t, k in self.ids.items()}
        self.rank = {tuple(m): k for k, m in enumerate(model["merges"])}
        self.made: dict[str, list[tuple[int, str, str]]] = {}
        for (a, b), k in self.rank.items():
            self.made.setdefault(a + b, []).append((k, a, b))
        # by one merge each, and that later than those of its parts
        self.ordered = all(len(m) == 1 and all(self.made[part][-1][0] < m[0][0] for part in m[0][1:] if part in self.made) for m in self.made.values())
        self.fits: dict[tuple[str, str], bool] = {}
        self.sizes: dict[str, list[int]] = {}
        self.tails: dict[str, list[str]] = {}
        for token in self.ids:
            self.tails.setdefault(self.tail(token, token.endswith(WORD_END) and len(token) > len(WORD_END)), []).append(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """The encoding by merging, lowest rank first; for the short strings of one or two tokens."""
        symbols = list(symbols)
        while len(symbols) > 1:
            rank, at = min((self.rank.get(pair, 1 << 60), k) for k, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    @staticmethod
    def symbols(token: str) -> list[str]:
        if token.endswith(WORD_END) and len(token) > len(WORD_END):
            return [*token[: -len(WORD_END) - 1], token[-len(WORD_END) - 1 :]]
        return list(token)

    def neighbours(self, left: str, right: str) -> bool:
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            found = self.apart(left, right) if self.ordered else self.merged(self.symbols(left) + self.symbols(right)) == [left, right]
            self.fits[left, right] = found
        return found

    def apart(self, left: str, right: str) -> bool:
        """Whether no merge crosses the border of two tokens that are their own encodings. The merges next to the border are
        undone from the latest on (of two equal ones the right one is later); a pair that meets there is merged if its rank
        comes before the merge that parts it, and of equal ones the left one comes first."""
        rank, made, none = self.rank, self.made, [(-1, "", "")]
        limit = 1 << 60
        (a, _, inner_left), (b, inner_right, _) = made.get(left, none)[0], made.get(right, none)[0]
        while rank.get((left, right), limit) >= limit:
            if a > b:
                left, limit = inner_left, a
                a, _, inner_left = made.get(left, none)[0]
            elif b >= 0:
                right, limit = inner_right, b + 1
                b, inner_right, _ = made.get(right, none)[0]
            else:
                return True
        return False

    @staticmethod
    def tail(token: str, final: bool) -> str:
        """The last three letters, or fewer, with the mark of the word's end."""
        return token[-3 - len(WORD_END) :] if final else token[-3:]

    def sizes_for(self, tail: str, end: str) -> list[int]:
        """Lengths, longest first, of the tokens that end a prefix with this tail and that merging can reach."""
        letters, found = tail[: len(tail) - len(end)], set()
        for k in range(len(letters)):
            for token in self.tails.get(letters[k:] + end, ()):
                size = len(token) - len(end)
                if (k == 0 or size == len(letters) - k) and self.merged(self.symbols(token)) == [token]:
                    found.add(size)
        return self.sizes.setdefault(tail, sorted(found, reverse=True))

    def last_token(self, letters: str, n: int, end: str, state: list[str]) -> str:
        """The last token of the encoding of the first ``n`` letters (and ``end``), from those of shorter prefixes."""
        ids, fits = self.ids, self.fits
        tail = letters[max(0, n - 3) : n] + end
        sizes = self.sizes.get(tail)
        for size in sizes if sizes is not None else self.sizes_for(tail, end):
            if size > n:
                continue
            token = letters[n - size : n] + end
            if token in ids:
                if size == n:
                    return token
                good = fits.get((state[n - size], token))
                if good is None:
                    good = self.neighbours(state[n - size], token)
                if good:
                    return token
        raise ValueError(f"no token of the vocabulary ends {letters[:n]!r}")

    def encode(self, words: set[str]) -> Iterator[tuple[str, bytes, str]]:
        """Each word with its ids and its decoded text, by a depth-first walk of the words' trie: ``state[d]`` is the
        last token of the first ``d`` letters of the path."""
        raw = self.raw
        state, path = [""], ""
        for letters, word in sorted((letters_of(w), w) for w in words):
            n, shared, most = len(letters), 0, min(len(state), len(letters)) - 1
            while shared < most and letters[shared] == path[shared]:
                shared += 1
            del state[shared + 1 :]
            for d in range(shared + 1, n):
                state.append(self.last_token(letters, d, "", state))
            path = letters
            token = self.last_token(letters, n, WORD_END, state)
            found, d = [token], n - len(token) + len(WORD_END)
            while d:
                token = state[d]
                found.append(token)
                d -= len(token)
            found.reverse()
            yield word, b"".join([raw[t] for t in found]), " ".join(found)


def letters_of(word: str) -> str:
    if word.isascii() and word.isprintable():
        return word
    return "".join(map(_LETTERS.__getitem__, word.encode("utf-8")))


class Encoder:
    """Whole texts to ids and decoded text. ``kind`` encodes a set of words at once; words that have been encoded are kept,
    up to a bound, so that a word of a text costs one lookup. Words of texts that hold other characters than ``_STABLE``
    are those of the library's normaliser and pre-tokenizer, or, if ``kind`` encodes whole texts, these are left to it."""

    def __init__(self, vocabulary: str, kind):
        self.special = {t["content"]: t["id"] for t in json.loads(vocabulary)["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kind = kind
        self.forget()

    def forget(self) -> None:
        self.ids = {t: k.to_bytes(4, "little") for t, k in self.special.items()}
        self.texts = {t: t for t in self.special}

    def words(self, text: str) -> list[str]:
        """The words of the pre-tokenizer, special tokens as they stand."""
        library = None if self.kind.whole else self.kind.library  # without it, other texts do not come here
        if "<|" in text and self.at_special:
            found = []
            for k, part in enumerate(self.at_special.split(text)):
                found += [part] if k % 2 else plain_words(part, library)
            return found
        return plain_words(text, library)

    def encode(self, texts: list[str], decode: bool = True) -> Iterator[tuple[bytes, str | None]]:
        """Per text its ids as little-endian 32-bit integers, and with ``decode`` the decoded text."""
        whole = {k for k, t in enumerate(texts) if t and self.kind.whole and not (t.isascii() or _STABLE.fullmatch(t))}
        split = [self.words(t) if t and k not in whole else [] for k, t in enumerate(texts)]
        words = set().union(*split)
        new = words.difference(self.ids)
        if len(self.ids) + len(new) > KEPT:  # the tables start anew with the words of this run
            self.forget()
            new = words.difference(self.ids)
        for word, ids, text in self.kind.encode(new):
            self.ids[word] = ids
            self.texts[word] = text
        for k, words in enumerate(split):
            if k in whole:
                yield self.kind.whole(texts[k]), None
            else:
                yield b"".join(map(self.ids.__getitem__, words)), " ".join(map(self.texts.__getitem__, words)) if decode else None


def plain_words(text: str, library: Tokenizer | None) -> list[str]:
    """Words of a text without special tokens, in the vocabulary's normal form; without ``library`` the text is known to be
    of ``_STABLE`` characters."""
    if text.isascii():
        return _LATIN_WORDS.findall(text.lower())
    if library is None or _STABLE.fullmatch(text):
        text = text.lower()
        return (_LATIN_WORDS if _LATIN.fullmatch(text) else _WORDS).findall(text)
    found = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
    return [bytes(map(_BYTES.__getitem__, letters)).decode("utf-8") for letters, _ in found]


def task_encoder(vocabulary: str, kind: type) -> Encoder:
    """The encoder of this Python worker: later tasks find what is built from the vocabulary, and the words (up to
    ``KEPT``) that earlier ones have met."""
    return worker_keeps(("encoder", kind, hash(vocabulary)), lambda: Encoder(vocabulary, kind(vocabulary)))


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, number of tokens, SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded text."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary_path))
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = task_encoder(vocabulary.value, TrieEncoder)
        for batch in batches:
            for a, b in runs(batch.column(1)):
                counts, ids, texts = [], [], []
                for raw, text in encoder.encode(batch.column(1).slice(a, b - a).to_pylist()):
                    counts.append(len(raw) // 4)
                    ids.append(hashlib.sha256(raw).hexdigest())
                    texts.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)], schema=schema)

    picked = docs.selectExpr(f"CAST({id_col} AS BIGINT) AS id", f"CAST({text_col} AS STRING) AS text")
    return in_batches(picked).mapInArrow(digests, "id BIGINT, n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING").withColumnRenamed("id", id_col)

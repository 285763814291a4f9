"""BPE encoding by backtracking over longest matches, decoding by an offset table.

Encoding a word never applies merges one by one.  An Aho-Corasick automaton over
the vocabulary gives every token that starts at each position; the encoder takes
the longest, and goes back to a shorter one where two neighbours are
incompatible.  Two tokens are compatible if merging the text of both would never
join symbols across their border; a table remembers the answer per pair.  The
tokens so chosen are exactly those the merges give, because each text has one
sequence whose neighbours are all compatible.  A position that leads nowhere is
marked once and never tried again, so the work is linear in the word.

Decoding gathers token bytes from one flat table by offsets.

The tokenizer's file (JSON: NFC, lower case, word pattern, byte-level symbols,
end-of-word suffix) is read by each Python worker once, from a path that all
machines have.  Words repeat, so a worker remembers encoded words, up to
``REMEMBER`` of them.  Texts stream through in Arrow batches: memory is bounded
by a batch, and a lost executor's texts are just encoded again.

Defined results: a null text is empty and has no tokens; special tokens written in
a text are matched first, as the library does by default; repeated rows are
encoded each; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.session import ship_package

#: Words and word pairs that a worker remembers before it starts anew.
REMEMBER = 400_000
#: Texts whose ids and decoded text a worker holds at a time.
PIECE = 500
#: Stands for the end-of-word suffix as one character.
WORD_END = ""
#: White space as the tokenizer's pattern sees it (Unicode White_Space).
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Characters at which str.split() splits but the pattern doesn't.
NOT_SPACES = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        symbol = {t: t[:-len(suffix)] + WORD_END if t.endswith(suffix) else t for t in vocab}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}
        for n, (a, b) in enumerate(model["merges"]):
            pair = vocab[a], vocab[b]
            whole = vocab[a + b]
            self.rank[pair] = n
            if whole not in self.parts:
                self.parts[whole], self.born[whole] = pair, n
        self.spines: tuple[dict, dict] = ({}, {})
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.bytes_as = str.maketrans({chr(b): s for b, s in enumerate(byte_symbols())})
        self.automaton = ahocorasick.Automaton()
        reachable: dict[int, bool] = {}
        for token, i in sorted(vocab.items(), key=lambda x: x[1]):
            if i in self.parts:
                a, b = self.parts[i]
                reachable[i] = reachable[a] and reachable[b] and self._joined_last(a, b)
            else:
                reachable[i] = len(symbol[token].rstrip(WORD_END)) == 1
            if reachable[i]:
                self.automaton.add_word(symbol[token], (i, len(symbol[token])))
        self.automaton.make_automaton()
        self.split_specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.chunk = regex.compile(f"[^{SPACES}]+")
        self.word = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACES}\p{{L}}\p{{N}}]+")
        shown = dict(vocab) | self.special
        spelled = [b""] * (max(shown.values()) + 1)
        for token, i in shown.items():
            spelled[i] = token.encode() + b" "
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def _spine(self, token: int, side: int) -> list[int]:
        """The tokens that stand at a token's edge (0: left, 1: right) while it is built, first symbol first."""
        found = self.spines[side].get(token)
        if found is None:
            found = self._spine(self.parts[token][side], side) + [token] if token in self.parts else [token]
            self.spines[side][token] = found
        return found

    def _joined_last(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border of a and b before both are complete."""
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        never = len(self.rank)
        while i + 1 < len(left) or j + 1 < len(right):
            grows_left = self.born[left[i + 1]] if i + 1 < len(left) else never
            grows_right = self.born[right[j + 1]] if j + 1 < len(right) else never
            across = self.rank.get((left[i], right[j]), never)
            # of equal merges the leftmost comes first
            if across < grows_left and across <= grows_right and across < never:
                return False
            if grows_left <= grows_right:
                i += 1
            else:
                j += 1
        return True

    def compatible(self, a: int, b: int) -> bool:
        key = (a, b)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= REMEMBER:
                self.pairs.clear()
            found = self.pairs[key] = key not in self.rank and self._joined_last(a, b)
        return found

    def encode_word(self, symbols: str) -> list[int]:
        """Tokens of one word, given as byte symbols."""
        text = symbols + WORD_END
        starts: list[list[tuple[int, int]]] = [[] for _ in text]
        for last, (token, n) in self.automaton.iter(text):
            starts[last + 1 - n].append((token, last + 1))
        # ends grow along the scan, so the longest token of each start is its last one
        out: list[int] = []
        came: list[int] = []
        hopeless = set()
        at = 0
        while at < len(text):
            options = starts[at]
            while options:
                token, end = options.pop()
                if end not in hopeless and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    came.append(at)
                    at = end
                    break
            else:
                hopeless.add(at)
                at = came.pop()
                out.pop()
        return out

    def _encode_chunk(self, chunk: str) -> bytes:
        """Packed ids of a text without white space."""
        found = self.known.get(chunk)
        if found is None:
            text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
            ids = [i for w in self.word.findall(text)
                   for i in self.encode_word(w.encode("utf-8", "replace").decode("latin-1").translate(self.bytes_as))]
            found = np.array(ids, "<u4").tobytes()
            if len(chunk) <= 64:
                if len(self.known) >= REMEMBER:
                    self.known.clear()
                self.known[chunk] = found
        return found

    def _encode_plain(self, text: str) -> bytes:
        odd = any(c in text for c in NOT_SPACES)
        return b"".join(map(self._encode_chunk, self.chunk.findall(text) if odd else text.split()))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, packed as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split_specials is None or not any(s in text for s in self.special):
            return self._encode_plain(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._encode_plain(p)
                        for p in self.split_specials.split(text))

    def decode(self, packed: bytes | None) -> str:
        """Tokens joined by spaces, as the library decodes without a decoder."""
        if not packed:
            return ""
        ids = np.frombuffer(packed, "<u4")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        where = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.flat[where].tobytes()[:-1].decode("utf-8")


_LOADED: dict[str, Tokenizer] = {}


def load(path: str) -> Tokenizer:
    """The tokenizer of a file, read once per Python process."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def _round_trip(path: str):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = load(path)
        for batch in texts:
            for at in range(0, max(1, len(batch)), PIECE):
                ids = [t.encode(x) for x in batch[at:at + PIECE]]
                yield pd.DataFrame({"ids": ids, "decoded": [t.decode(x) for x in ids]})
    return F.pandas_udf(run, "struct<ids:binary,decoded:string>")


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "bpe") -> DataFrame:
    """``docs`` with ``out_col``: ids (packed unsigned 32-bit integers, little-endian) and their decoded text."""
    ship_package(docs.sparkSession)
    return docs.withColumn(out_col, _round_trip(path)(F.col(f"`{text_col}`")))


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the text of packed ids."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = load(path)
        for batch in batches:
            yield pd.Series([t.decode(x) for x in batch], dtype="object")
    ship_package(rows.sparkSession)
    return rows.withColumn(out_col, F.pandas_udf(run, "string")(F.col(f"`{ids_col}`")))


def digest_columns(encoded: DataFrame, id_col: str = "doc_id", bpe_col: str = "bpe") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    one = encoded.select(id_col, F.col(f"{bpe_col}.ids").alias("ids"), F.col(f"{bpe_col}.decoded").alias("decoded"))
    return one.select(id_col, F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

"""BPE encoding and decoding by prefix-sharing trie traversal.

The words of a batch that were not met before go into a trie over the vocabulary's symbols. A
depth-first walk carries, for each prefix, the last token of its encoding: token t ends the
encoding of prefix p if t is a suffix of p, what stands before t has last token s, and the pair
(s, t) is what the merges make of s and t joined. Exactly one token satisfies this, so a
prefix's state is computed once for all words that share it, and a word's ids are read back
along the chain of last tokens.

Texts are cut at added tokens and ASCII white space, over which neither the normaliser nor the
pattern of the file reaches. Each such piece is encoded once per worker while it stays in a
bounded cache. Null text encodes as empty; empty and blank texts have no ids and decode to the
empty text. Very long texts cost memory in proportion to their own length only. The id and text
are the only columns read; the vocabulary's path is a parameter.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import documents

#: Pieces a worker remembers before it starts afresh.
CACHE = 600_000

#: Text that NFC leaves alone and that has no white space: printable ASCII and composed Latin letters.
LATIN = re.compile("[!-~\u00c0-\u024f]+")


def _byte_symbols() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class TrieEncoder:
    """Exact BPE of words for a vocabulary with end-of-word symbols."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        library = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        vocab = model["vocab"]
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(model["merges"])}
        self.halves = {made: (a, b) for (a, b), (_, made) in reversed(self.rank.items())}
        self.made_at = {made: r for (_, (r, made)) in reversed(self.rank.items())}
        self.number = {i: b"%d" % i for i in self.token}
        self.text_of = {self.number[i]: t for i, t in self.token.items()}
        symbols = _byte_symbols()
        self.symbols = dict(enumerate(symbols))
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        self.pattern = regex.compile(split["pattern"]["Regex"]) if kinds == ["NFC", "Replace", "Lowercase"] and split["invert"] else None
        self.symbol_ids = {s: vocab[s] for s in symbols if s in vocab}
        self.last_ids = {s: vocab[s + self.end] for s in symbols if s + self.end in vocab}
        # Tokens by their symbols read backwards, as a trie: walked from a prefix's end.
        self.backwards: dict = {}
        for t, i in vocab.items():
            node = [None, self.backwards]
            for s in reversed(self.spell(t)):
                node = node[1].setdefault(s, [None, {}])
            node[0] = i
        self.fits: dict[int, bool] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.split_added = re.compile(b"(" + b"|".join(re.escape(a.encode()) for a in sorted(self.added, key=len, reverse=True)) + b")") if self.added else None

    def spell(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            stem = token[: -len(self.end)]
            return [*stem[:-1], stem[-1] + self.end]
        return list(token)

    def pair_fits(self, left: int, right: int) -> bool:
        """Whether the merges leave left and right apart when they stand side by side.

        Undoes merges across the border from the last one on: a pair that would have merged
        before either side was complete shows that the border does not survive.
        """
        a, b, limit, fits = left, right, len(self.rank) + 1, True
        while True:
            met = self.rank.get((a, b))
            if met is not None and met[0] < limit:
                fits = False
                break
            ra, rb = self.made_at.get(a, -1), self.made_at.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:  # a was made last: its right half met b before
                limit, a = ra, self.halves[a][1]
            else:  # b was; a merge of the same rank at the border would have come first
                limit, b = rb + 1, self.halves[b][0]
        if len(self.fits) > CACHE // 2:
            self.fits.clear()
        self.fits[left << 32 | right] = fits
        return fits

    def encode_words(self, words) -> None:
        """Put the decimal ids of all words (strings of byte symbols) into self.words, by one trie."""
        trie: dict = {}
        for word in words:
            node = trie
            for s in word[:-1]:
                below = node.get(s)
                if below is None:
                    below = node[s] = {}
                node = below
            node[word[-1] + self.end] = word
        # Depth first: path[:d] are the symbols above, last[d] and back[d] the state after them.
        path: list[str] = []
        last: list[int] = [-1]
        back: list[int] = [0]
        number, fits, backwards, found = self.number, self.fits, self.backwards, self.words
        stack = [(0, s, child) for s, child in trie.items()]
        while stack:
            depth, s, child = stack.pop()
            if depth < len(path):
                del path[depth:], last[depth + 1 :], back[depth + 1 :]
            path.append(s)
            # The last token of path: t, over d symbols that are encoded.
            below, d = backwards, depth
            while True:
                node = below.get(path[d])
                if node is None:
                    raise ValueError("the vocabulary lacks a byte's symbol")
                t, below = node
                if t is not None:
                    if not d:
                        break
                    fit = fits.get(last[d] << 32 | t)
                    if fit is None:
                        fit = self.pair_fits(last[d], t)
                    if fit:
                        break
                d -= 1
                if d < 0:
                    raise ValueError("no token ends this word")
            last.append(t)
            back.append(d)
            depth += 1
            if child.__class__ is str:
                ids = []
                while depth:
                    ids.append(number[last[depth]])
                    depth = back[depth]
                ids.reverse()
                found[child] = b" ".join(ids)
            else:
                for t, c in child.items():
                    stack.append((depth, t, c))

    def learn(self, pieces: set[bytes]) -> None:
        """Encode pieces of text that the cache lacks."""
        parts = {p: self.parts(p) for p in pieces}
        words = self.words
        self.encode_words({w for ws in parts.values() for w in ws if w not in words})
        for p, ws in parts.items():
            self.pieces[p] = words[ws[0]] if len(ws) == 1 else b" ".join([words[w] for w in ws])

    def parts(self, piece: bytes) -> list[str]:
        """Words of byte symbols, and added tokens."""
        if self.split_added is None or b"<|" not in piece:
            return self.cut_words(piece.decode())
        out: list[str] = []
        for part in self.split_added.split(piece):
            text = part.decode()
            if text in self.added:
                out.append(text)
                self.words[text] = b"%d" % self.added[text]
            elif text:
                out += self.cut_words(text)
        return out

    def cut_words(self, text: str) -> list[str]:
        """As the library's normaliser and pre-tokenizer do; composed Latin text is cut here."""
        if self.pattern and LATIN.fullmatch(text):
            low = text.lower()
            found = [low] if low.isalpha() else self.pattern.findall(low)
            return found if text.isascii() else [w.encode().decode("latin-1").translate(self.symbols) for w in found]
        return [w for w, _ in self.pre_tokenize(self.normalize(text))]

    def decode(self, ids: bytes) -> str:
        """The text that the library decodes from decimal ids: this file names no decoder."""
        return " ".join([self.text_of[i] for i in ids.split()])

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Decimal ids joined by spaces, for each text."""
        cut = [(t or "").encode().split() for t in texts]
        known = self.pieces
        if len(known) > CACHE:  # not while pieces of these texts are looked up
            known.clear()
            self.words.clear()
        collects = gc.isenabled()
        gc.disable()  # tries are trees: the collector would walk millions of nodes and free none
        try:
            self.learn({p for ps in cut for p in ps if p not in known})
        finally:
            if collects:
                gc.enable()
        get = known.__getitem__
        return [b" ".join(filter(None, map(get, ps))) for ps in cut]


_encoders: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    if path not in _encoders:
        _encoders[path] = TrieEncoder(path)
    return _encoders[path]


#: Texts encoded together; their new words share a trie.
TOGETHER = 1024


def bpe(text: Column, path: str, texts: bool = False) -> Column:
    """n_tokens, ids_sha256 and decoded_sha256; with texts=True also ids and decoded themselves."""
    kind = "n_tokens:bigint, ids_sha256:string, decoded_sha256:string" + ", ids:array<int>, decoded:string" * texts

    @F.arrow_udf(f"struct<{kind}>")
    def run(column: pa.Array) -> pa.Array:
        enc, rows = encoder(path), []
        for i in range(0, len(column), TOGETHER):
            for ids in enc.encode_all(column.slice(i, TOGETHER).to_pylist()):
                decoded = enc.decode(ids)
                row = {"n_tokens": ids.count(b" ") + 1 if ids else 0, "ids_sha256": hashlib.sha256(ids).hexdigest(), "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest()}
                rows.append(row | {"ids": [int(x) for x in ids.split()], "decoded": decoded} if texts else row)
        fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        return pa.array(rows, pa.struct(fields + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * texts))

    return run(text)


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), bpe(F.col(text), path).alias("b"))
    return rows.select("doc_id", "b.n_tokens", "b.ids_sha256", "b.decoded_sha256")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe(spark, sf_dir):
    return encode_documents(documents(spark, sf_dir), default_path())

"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding as an incremental byte-to-text machine.

Merges apply in rank order, and a rule only joins tokens that earlier rules made. So what follows a prefix can change the
prefix's tokens only through a chain of rules of growing rank, each reaching one left operand further to the left.
``Merges.lookahead`` bounds the reach of every such chain from the merge list: symbols further from the end of what was
read have their final tokens. :mod:`keyloom.llm.transducer` emits these and carries the others on; it is the only path from text
to ids, for texts of any length.

Texts are read in blocks: stretches that no pre-token crosses are folded and cut into pre-tokens by the file's own pattern,
their bytes become symbols, and the state is carried from block to block. What is held beside a text is a block, a stretch (as
long as the longest pre-token, where that is longer) and the bounded table of transitions. Ids leave block by block and are
decoded at once. The vocabulary file is a parameter; nothing is trained.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts
from .transducer import BLOCK, END, SPECIAL, Pairs, Transducer

#: Words kept per table generation, and the longest word kept.
TABLE_WORDS, TABLE_BYTES = 300_000, 80
#: Characters of a stretch, at least, unless the text ends.
STRETCH = 1 << 16


@lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


class WordTable(dict):
    """A memo in two generations: bounded, and frequent entries survive."""

    def __init__(self, make, limit: int = TABLE_WORDS):
        super().__init__()
        self._make, self._limit, self._old = make, limit, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(key) <= TABLE_BYTES:
            if len(self) >= self._limit:
                self._old = dict(self)
                self.clear()
            self[key] = value
        return value


#: The two patterns whose pre-tokens are found by classes of characters (fixed values); other patterns are searched.
_BYTES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE, _LETTER, _NUMBER, _MARK = range(4)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """White space, letter, number or mark, by code point."""
    import regex

    out = np.full(0x110000, _MARK, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(low, high)))
        for pattern, own in ((r"\s+", _SPACE), (r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
            for found in regex.finditer(pattern, every):
                out[low + found.start() : low + found.end()] = own
    return out


def cut(points: np.ndarray, of_bytes: bool) -> np.ndarray:
    """Whether a pre-token begins at each code point, by ``_BYTES`` or ``_WORDS``; white space of the latter is in none."""
    kind = character_classes()[points]
    n = len(points)
    begins = np.ones(n, bool)
    begins[1:] = kind[1:] != kind[:-1]
    quotes = np.flatnonzero(points[:-1] == 0x27)
    if len(quotes):
        # A mark that begins a pre-token takes one of seven endings with it.
        padded = np.append(points, [0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        first = begins[quotes]
        if of_bytes:  # a blank before goes with the mark
            first &= (quotes == 0) | (points[quotes - 1] != 0x20)
        own, size = quotes[first & (short | long)], np.where(short, 2, 3)[first & (short | long)]
        begins[own + 1] = False
        begins[(own + size)[own + size < n]] = True
    if not of_bytes:
        return begins | (kind == _NUMBER)
    # The last of some white space goes with what follows if it is a blank, and else stands alone.
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE))
    begins[last] = True
    begins[last[points[last] == 0x20] + 1] = False
    return begins


def _utf8_sizes(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)


class Merges:
    """A merge list over symbols, with the lookahead that suffices for it."""

    def __init__(self, vocab: dict[str, int], pairs: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        made = {a + b: (i, a) for i, (a, b) in enumerate(pairs)}
        # The bound below needs every token to have one rule, older than the rules that use it.
        if len(made) < len(pairs) or any(x in made and made[x][0] >= i for i, p in enumerate(pairs) for x in p):
            raise ValueError("a merge is not built from earlier tokens")
        self.longest = max([1, *map(self.width, made)])
        self.lookahead = self.longest + self._reach(pairs, made)

    def width(self, token: str) -> int:
        """Base symbols of a token; the word end counts with the symbol it marks."""
        return max(1, len(token) - len(self.suffix)) if self.suffix and token.endswith(self.suffix) else len(token)

    def _reach(self, pairs: list[tuple[str, str]], made: dict[str, tuple[int, str]]) -> int:
        """The furthest that a chain of rules of growing rank extends to the left.

        A rule (a, b) moves the start of the region in doubt from b's start to a's. The next rule's right operand starts
        there: it is a token whose left spine has a. furthest[a] holds the best chain so far that ends at a.
        """
        furthest: dict[str, int] = {}
        best = 0
        for a, b in pairs:
            here, token = 0, b
            while True:
                here = max(here, furthest.get(token, 0))
                if token not in made:
                    break
                token = made[token][1]
            reach = here + self.width(a)
            furthest[a] = max(furthest.get(a, 0), reach)
            best = max(best, reach)
        return best


class Encoder:
    """A tokenizer file's encoder and decoder for whole texts."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        self.merges = Merges(self.vocab, pairs, self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only plain added tokens are known here")
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.folds = spec["normalizer"] is not None
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"]])
        # A split step names its pattern; the byte-level step alone stands for the following one (fixed value).
        split = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), None)
        self.pattern = regex.compile(split or _BYTES)
        self._cut = self._by_class if self.pattern.pattern in (_BYTES, _WORDS) else self._by_search
        self._blanks = regex.compile(r"\s+")
        # Always a pre-token's start: any ASCII white space where it is dropped, else the first white space behind anything else.
        self._safe = regex.compile(r"[ \t\n\r\x0b\x0c]" if self.folds else r"(?<=\S)\s")
        self.machine = self._compiled(pairs)
        self._token_bytes = None

    def _compiled(self, pairs: list[tuple[str, str]]) -> Transducer:
        octet = {c: i for i, c in enumerate(byte_alphabet())}
        inner: dict[bytes, int] = {}
        last = {} if self.suffix else inner
        for token, i in self.vocab.items():
            if token not in self.special:
                ends = bool(self.suffix) and token.endswith(self.suffix)
                (last if ends else inner)[bytes(octet[c] for c in (token[: -len(self.suffix)] if ends else token))] = i
        return Transducer(inner, last, Pairs(pairs, self.vocab), list(self.special.values()))

    # Encoding

    def fold(self, text: str) -> str:
        """The file's normalizer: composed form, one blank for white space, lower case by code point."""
        if not self.folds:
            return text
        if not text.isascii():
            text = self._blanks.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ")
        return text.lower()

    def _stretches(self, text: str) -> Iterator[str]:
        """The text in parts that no pre-token crosses."""
        at = 0
        while at < len(text):
            cut = self._safe.search(text, at + STRETCH)
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def _symbols(self, text: str) -> Iterator[np.ndarray]:
        """Symbols of a stretch."""
        numbers = list(self.special)
        for i, part in enumerate(self.special_pattern.split(text) if "<|" in text else (text,)):
            if i % 2:
                yield np.array([SPECIAL + numbers.index(part)], np.int16)
            elif part:
                if len(found := self._cut(self.fold(part))):
                    yield found

    def _by_search(self, text: str) -> np.ndarray:
        pieces = self.pattern.findall(text)
        octets = np.frombuffer("".join(pieces).encode(), np.uint8)
        symbols = octets.astype(np.int16)
        if len(pieces):
            symbols[np.cumsum([len(p.encode()) for p in pieces]) - 1] += END
        return symbols

    def _by_class(self, text: str) -> np.ndarray:
        octets = np.frombuffer(text.encode(), np.uint8)
        plain = len(octets) == len(text)
        points = octets if plain else np.frombuffer(text.encode("utf-32-le"), "<u4")
        begins = cut(points, not self.folds)
        last = np.append(begins[1:], True)  # of a pre-token, or of white space
        ends = np.flatnonzero(last)
        if not plain:
            ends = np.append(np.flatnonzero((octets & 0xC0) != 0x80), len(octets))[ends + 1] - 1
        symbols = octets.astype(np.int16)
        symbols[ends] += END
        if not self.folds:
            return symbols
        dropped = character_classes()[points] == _SPACE
        return symbols[~dropped] if plain else symbols[~np.repeat(dropped, _utf8_sizes(points))]

    def _blocks(self, texts: Iterable[str], size: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
        """Symbols of at most two blocks' length, and up to where they belong to which text."""
        held, marks, n = [], [], 0
        for number, text in enumerate(texts):
            for stretch in self._stretches(text):
                for symbols in self._symbols(stretch):
                    for at in range(0, len(symbols), size):
                        held.append(symbols[at : at + size])
                        n += len(held[-1])
                        marks.append((number, n))
                        if n >= size:
                            yield np.concatenate(held), marks
                            held, marks, n = [], [], 0
        if n:
            yield np.concatenate(held), marks

    def _runs(self, texts: Iterable[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
        """Edges of each block, which of them end a pre-token, and the block's marks."""
        machine, state = self.machine, 0
        for symbols, marks in self._blocks(texts, size):
            if machine.full():
                state = machine.clear(machine.states[state])
            edges, state = machine.run(symbols, state)
            yield edges, symbols >= END, marks

    def encode_parts(self, texts: Iterable[str], size: int = BLOCK) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
        """(ids, marks) block by block: a mark (k, n) says that ids up to the n-th, from the previous mark on, are of text k."""
        held = np.empty(0, np.uint32)
        for edges, ends, marks in self._runs(texts, size):
            ids, upto, held = self.machine.tokens(edges, ends, held, self.merges.lookahead)
            yield ids, [(number, int(upto[end - 1])) for number, end in marks]

    def count(self, texts: list[str], size: int = BLOCK) -> np.ndarray:
        """Tokens of each text, from the counts that transitions are annotated with."""
        out = np.zeros(len(texts), np.int64)
        for edges, _, marks in self._runs(texts, size):
            own = np.array(marks)
            starts = np.r_[0, own[:-1, 1]]
            np.add.at(out, own[:, 0], np.add.reduceat(self.machine.counts(edges), starts))
        return out

    def encode_all(self, texts: list[str], size: int = BLOCK) -> list[bytes]:
        """The ids of each text as little-endian 32-bit words."""
        parts: list[list[bytes]] = [[] for _ in texts]
        for ids, marks in self.encode_parts(texts, size):
            flat, at = ids.astype("<u4", copy=False).tobytes(), 0
            for number, end in marks:
                parts[number].append(flat[4 * at : 4 * end])
                at = end
        return list(map(b"".join, parts))

    def encode(self, text: str, size: int = BLOCK) -> bytes:
        return self.encode_all([text], size)[0]

    # Decoding

    def _bytes_of(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes that ids stand for, and where each id's bytes end."""
        if self._token_bytes is None:
            octet = {c: i for i, c in enumerate(byte_alphabet())}
            known = {**self.vocab, **self.special}
            table = [b""] * (max(known.values()) + 1)
            for token, i in known.items():
                table[i] = token.encode() if token in self.special else bytes(octet[c] for c in token)
            sizes = np.array([len(t) for t in table])
            self._token_bytes = np.frombuffer(b"".join(table), np.uint8), np.cumsum(sizes) - sizes, sizes
        flat, place, sizes = self._token_bytes
        own = sizes[ids]
        ends = np.cumsum(own)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(place[ids] - (ends - own), own)
        return flat[at].tobytes(), ends

    def decode_parts(self, ids: bytes, chunk: int = 1 << 16) -> Iterator[str]:
        """Text as soon as its bytes are complete; ill-formed bytes become U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for at in range(0, len(ids), 4 * chunk):
            yield machine.decode(self._bytes_of(np.frombuffer(ids[at : at + 4 * chunk], "<u4"))[0])
        yield machine.decode(b"", True)

    def decode(self, ids: bytes) -> str:
        return "".join(self.decode_parts(ids))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder a file in each Python worker."""
    return Encoder(path)


class _Digest:
    """What is kept of one text while its ids pass by: two hashes, a count, and the decoder's state."""

    def __init__(self):
        self.ids, self.text, self.n = hashlib.sha256(), hashlib.sha256(), 0
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray, octets: bytes) -> None:
        self.n += len(ids)
        self.ids.update(ids.astype("<u4", copy=False))
        self.text.update(self.decoder.decode(octets).encode())

    def row(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.decode(b"", True).encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def digests(bpe: Encoder, texts: list[str], size: int = BLOCK) -> list[tuple[int, str, str]]:
    """(tokens, hash of the ids, hash of the text decoded from them) of each text; no text's ids are ever held as a whole."""
    out: list[tuple[int, str, str]] = []
    open_ = _Digest()
    for ids, marks in bpe.encode_parts(texts, size):
        octets, ends = bpe._bytes_of(ids)
        at = begin = 0
        for number, end in marks:
            while len(out) < number:  # the texts before are over
                out.append(open_.row())
                open_ = _Digest()
            stop = int(ends[end - 1]) if end else 0
            open_.feed(ids[at:end], octets[begin:stop])
            at, begin = end, stop
    while len(out) < len(texts):
        out.append(open_.row())
        open_ = _Digest()
    return out


def encode_decode(docs: DataFrame, vocabulary: str, **cols: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes): one row per document.

    ``vocabulary`` is a tokenizer file that every executor has at this path. Null texts count as empty ones: no tokens, and the
    hashes of nothing. A text of any length is read in blocks. Repeated rows give repeated rows, an empty table none. Columns
    beside the two that are read do not matter, also where their names differ from these only in case.
    """

    def rows(batch: list[bytes]) -> list[list]:
        made = digests(encoder(vocabulary), [raw.decode("utf-8", "replace") for raw in batch])
        return [*map(list, zip(*made)), [len(raw) for raw in batch]]

    return map_texts(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long", rows, **cols)

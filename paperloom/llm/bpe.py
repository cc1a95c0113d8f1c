"""BPE encoding and decoding without the tokenizers library.

A word is a doubly linked list of symbols; a priority queue holds the adjacent
pairs that have a merge rank. The least (rank, position) is popped; an entry
whose symbols have changed since it was pushed is stale and skipped; otherwise
the right symbol is unlinked and the two new neighbours are pushed. Decoding
concatenates vocabulary strings.

Words repeat, so each worker keeps two bounded tables: of pre-tokens and their
ids, and of what stands between white space ("chunks") and what is made of its
ids. A full table becomes the old one, whose entries in use come back; what the
old one still holds then is forgotten. Where white space is in no pre-token, a
text's ids are its chunks' ids. With the byte-level pattern a space starts a new
pre-token, but for where white space meets white space around it: chunks (parted
at spaces there) that begin or end with white space are odd, and a text that has
one is parted whole.

BPE reads the parts of a tokenizer file that the two vocabularies use:
normalizers NFC, Replace of white space and Lowercase; a Split pre-tokenizer
with inverted Removed behaviour, or the byte-level pattern; ByteLevel symbols;
an end-of-word suffix; special tokens found in the raw text, leftmost longest.

Free style: one Arrow pass, no shuffle.

Defined results: a null text encodes as an empty one (no ids); any Unicode text
is encoded as UTF-8 bytes; repeated rows each keep their row, a null id stays
null, further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

#: Unicode's White_Space property, the same for every engine.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Parts two texts in one string: neither digits nor byte symbols hold it.
BAR = "\n"
#: What str.split() takes for white space, too.
ODD_SPACE = frozenset("\x1c\x1d\x1e\x1f")
#: The byte-level pre-tokenizer's own pattern.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a table before it becomes the old one.
WORDS_KEPT, CHUNKS_KEPT = 200_000, 300_000
#: A longer word or chunk is encoded but not kept.
LONGEST_KEPT = 64


class Table:
    """A bounded memory of what was computed: a young and an old part."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key: str):
        x = self.young.get(key)
        if x is None and (x := self.old.get(key)) is not None:
            self.put(key, x)
        return x

    def put(self, key: str, value) -> None:
        if len(key) <= LONGEST_KEPT:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[key] = value


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is a
    visible Latin-1 character, else the next one from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def spaced(pattern: str) -> str:
    """pattern with the white space of SPACE for \\s and \\S."""
    return pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")


class BPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []  # what the merge of each rank makes
        for rank, (a, b) in enumerate(merges):
            self.ranks[self.vocab[a], self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        self.symbols = byte_symbols()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.added).items()}
        self.special = regex.compile("|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.nfc, self.collapse, self.lower = (k in kinds for k in ("NFC", "Replace", "Lowercase"))
        steps = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        split = next((s["pattern"]["Regex"] for s in steps if s["type"] == "Split"), BYTE_LEVEL)
        self.words = regex.compile(spaced(split)).findall
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.joined = "" if spec["decoder"] else " "
        self.table = Table(WORDS_KEPT)
        self.removed = any(s["type"] == "Split" and s["behavior"] == "Removed" for s in steps)

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token. An entry of the queue is a rank and a position in
        one integer; it is stale if the pair there has another rank by now."""
        text = [self.symbols[b] for b in word.encode("utf-8", "replace")]
        text[-1] += self.suffix
        sym = [self.vocab[c] for c in text]
        n = len(sym)
        rank_of, made = self.ranks.get, self.made
        queue = [r << 32 | i for i, pair in enumerate(zip(sym, sym[1:])) if (r := rank_of(pair)) is not None]
        if not queue:
            return sym
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if j < 0 or rank_of((sym[i], sym[j])) != rank:
                continue  # stale
            new = sym[i] = made[rank]
            sym[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of((new, sym[k]))) is not None:
                    push(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank_of((sym[h], new))) is not None:
                push(queue, r << 32 | h)
        return [s for s in sym if s >= 0]

    def pieces(self, text: str) -> list[str | int]:
        """Raw segments, and the ids of special tokens between them."""
        if not self.special or "<|" not in text:
            return [text]
        out: list[str | int] = []
        at = 0
        for m in self.special.finditer(text):
            out += [text[at : m.start()], self.added[m[0]]]
            at = m.end()
        return [*out, text[at:]]

    def normal(self, text: str) -> str:
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.collapse:
            text = self.spaces.sub(" ", text)
        if self.lower:
            # each character by itself: no final sigma
            text = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
        return text

    def word(self, w: str) -> tuple[int, ...]:
        ids = self.table.get(w)
        if ids is None:
            ids = tuple(self.merge(w))
            self.table.put(w, ids)
        return ids

    def plain_ids(self, text: str) -> list[int]:
        """Ids of a text or chunk without special tokens."""
        return [i for w in self.words(self.normal(text)) for i in self.word(w)]

    def chunk_ids(self, chunk: str) -> list[int] | tuple[int, ...]:
        """Ids of a chunk without white space, where white space is in no
        pre-token. ASCII letters are one pre-token and their own NFC form."""
        if chunk.isascii():
            low = chunk.lower() if self.lower else chunk
            return self.word(low) if low.isalpha() else [i for w in self.words(low) for i in self.word(w)]
        return self.plain_ids(chunk)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for piece in self.pieces(text or ""):
            out += [piece] if isinstance(piece, int) else self.plain_ids(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        text = self.joined.join(self.strings[i] for i in ids)
        if self.joined:
            return text
        back = {c: b for b, c in enumerate(self.symbols)}
        return bytes(back[c] for c in text).decode("utf-8", "replace")

    def looked_up(self, text: str, make, kept: Table) -> list:
        """make(ids) for parts of text, in order; kept: this make's table."""
        if self.removed:
            # white space belongs to no pre-token; str.split() also parts at ODD_SPACE
            first, chunks = None, text.split() if ODD_SPACE.isdisjoint(text) else self.spaces.split(text)
        else:
            first, *chunks = text.split(" ")
        out = list(map(kept.young.get, chunks))
        if None in out:
            for i, c in enumerate(chunks):
                if out[i] is None:
                    x = kept.get(c)
                    if x is None:
                        if not self.removed and (not c or c[0].isspace() or c[-1].isspace()):
                            return [make(self.plain_ids(text))]
                        x = make(self.chunk_ids(c) if self.removed else self.plain_ids(" " + c))
                        kept.put(c, x)
                    out[i] = x
        return out if first is None else [make(self.plain_ids(first)), *out]

    def each_part(self, text: str | None, make, kept: Table) -> list:
        """make(ids) for parts of a whole text, special tokens included."""
        pieces = self.pieces(text or "")
        if len(pieces) == 1:
            return self.looked_up(pieces[0], make, kept)
        return [x for piece in pieces for x in ([make([piece])] if isinstance(piece, int) else self.looked_up(piece, make, kept))]


@lru_cache
def loaded(path: str) -> BPE:
    """One for each file and worker: its table of words outlives a task."""
    return BPE(path)


@lru_cache
def chunk_table(path: str, kind: str) -> Table:
    return Table(CHUNKS_KEPT)


def text_digests(path: str):
    """The function (doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def make():
        bpe, kept = loaded(path), chunk_table(path, "digest")
        strings, joined = bpe.strings, bpe.joined
        # ids and what they decode to in one string, so that a chunk is one object to fetch
        texts = [f"{i} " for i in range(max(strings) + 1)]
        made = lambda ids: f"{''.join([texts[i] for i in ids])}{BAR}{joined.join([strings[i] for i in ids])}{joined}{BAR}" if ids else BAR + BAR

        def each(doc_id, text):
            both = "".join(bpe.each_part(text, made, kept)).split(BAR)
            own, plain = "".join(both[:-1:2]), "".join(both[1::2])
            decoded = plain[: len(plain) - len(joined)] if joined else bpe.decode([int(x) for x in own.split()])
            return doc_id, own.count(" "), hashlib.sha256(own[:-1].encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()

        return each

    return make


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids of each whole text and what they decode to."""

    def make():
        bpe, kept = loaded(path), chunk_table(path, "ids")

        def each(doc_id, text):
            ids = [i for part in bpe.each_part(text, tuple, kept) for i in part]
            return doc_id, ids, bpe.decode(ids)

        return each

    return map_rows(docs, ["doc_id", "text"], "doc_id long, ids array<int>, decoded string", make)


def op3_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return map_rows(table(spark, sf_dir, "documents"), ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", text_digests(path or vocabulary("word_bpe_49k.json")))


def vocabulary(name: str) -> str:
    """A public tokenizer's file, where the machine has it."""
    import public_tokenizers

    return public_tokenizers.path(name)

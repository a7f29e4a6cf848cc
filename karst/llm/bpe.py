"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

The text is read in blocks and cut into pieces by the tokenizer's own rules.  A piece is merged by
the merge list.  Of a piece that outgrows the window, tokens are emitted as soon as they are stable: whatever follows can only
change tokens within the merge list's *lookahead*, which is computed from the list.  A merge (u, v) can be undone only by
an earlier one that takes a right end of v first, that one only by a yet earlier one, and so on, so

    reach(u, v) = |v| + max(reach of earlier merges whose left side is v or a right end of v's derivation)

and the lookahead is the largest reach.  Merging can restart at any emitted token's end.  Runs without white space are read
in blocks too, and a word that goes on from one to the next is merged as it comes, so memory does not grow
with the text nor with the longest word, apart from a memo of frequent pieces of fixed size (and the text itself, which a row holds whole).

Decoding is a state machine over ids: ``Decoder(mode="tokens")`` gives the tokens' strings with spaces between, as a tokenizer
file without a decoder asks for; ``mode="text"`` turns byte letters back to bytes and emits characters once
their UTF-8 bytes are complete, a word end becoming a space.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._work import pick, ship

# Code points that the tokenizers library takes for neither letters nor numbers, in order (they are in newer tables) ...
NO_LETTERS = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF),
    (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
# ... marks that it neither orders nor composes (they are newer than its normal forms) ...
NO_MARKS = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C),
    (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A),
    (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45),
    (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
# ... and capitals whose small letters are newer than some Pythons: first, last, the first one's small letter.
CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB),
    (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
# The white space and the pieces of the tokenizer file's own patterns.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACES}\p{{L}}\p{{N}}]+"
BLOCK = 1 << 16
WINDOW = 1 << 12
MEMO = 100_000
_NONE = np.int64(1 << 60)
_SLOTS = 1 << 19
_SPACE_RUN = regex.compile(rf"[{_SPACES}]")
_one = lambda ranges: "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"
_ODD = re.compile(_one([*NO_LETTERS, *NO_MARKS, *((a, b) for a, b, _ in CAPITALS)]))
_MARK = re.compile(f"({_one(NO_MARKS)})")
_SMALL = {a + k: c + k for a, b, c in CAPITALS for k in range(b - a + 1)}
_OTHER = re.compile(_one(NO_LETTERS))
#: Where a run without white space may be cut: before a digit, and within letters or within marks, where the piece goes on.
_CUT = re.compile(r"(?<=[A-Za-z\u4e00-\u9fff]{4})(?=[A-Za-z\u4e00-\u9fff])|(?=[0-9])|(?<=[-=_.*#~+/])(?=[-=_.*#~+/])")


def odd(text: str) -> bool:
    """Whether a text holds a code point on which tables differ; most hold none beyond Latin-1, which is quickly seen."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _ODD.search(text) is not None
    return False


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge list of a tokenizer file with word ends."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        letters = byte_letters()
        self.first = [self.vocab[letters[b]] for b in range(256)]
        self.last = [self.vocab[letters[b] + self.end] for b in range(256)]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        #: (left id, right id) -> rank * 2**20 + merged id
        self.rank = {(self.vocab[a], self.vocab[b]): (k << 20) | self.vocab[a + b] for k, (a, b) in reversed(list(enumerate(pairs)))}
        self.lookahead = self._lookahead(pairs)
        size = 1 + max(max(self.vocab.values()), *self.special.values(), 0)
        self.strings = [""] * size
        for s, i in chain(self.vocab.items(), self.special.items()):
            self.strings[i] = s
        self.decimal = [str(i) for i in range(size)]
        self.first_ids, self.last_ids = np.array(self.first), np.array(self.last)
        self.bytes = {c: b for b, c in letters.items()}
        self.keys, self.found = np.full(_SLOTS, -1), np.full(_SLOTS, _NONE)
        with np.errstate(over="ignore"):
            for (a, b), value in self.rank.items():
                code = np.int64(a << 20 | b)
                slot = int((code * 0x9E3779B97F4A7C1 >> 20) & (_SLOTS - 1))
                while self.keys[slot] >= 0:
                    slot = (slot + 1) & (_SLOTS - 1)
                self.keys[slot], self.found[slot] = code, value

    def _lookahead(self, pairs: list[tuple[str, str]]) -> int:
        units = lambda s: len(s.removesuffix(self.end) if self.end and s != self.end else s)
        right: dict[str, str] = {}  # a token's right part in its first derivation
        best: dict[str, int] = {}  # of merges so far, by their left side
        most = 1
        for u, v in pairs:
            reach, x = units(v), v
            far = 0
            while x:
                far = max(far, best.get(x, 0))
                x = right.get(x, "")
            reach += far
            best[u] = max(best.get(u, 0), reach)
            right.setdefault(u + v, v)
            most = max(most, reach)
        return most

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges in order of rank, the leftmost first among equals."""
        rank = self.rank
        while len(ids) > 1:
            got = [rank.get(p, 1 << 60) for p in zip(ids, ids[1:], strict=False)]
            low = min(got)
            if low == 1 << 60:
                break
            if len(ids) < 64:
                i = got.index(low)
                ids[i : i + 2] = [low & 0xFFFFF]
                continue
            out, i = [], 0  # all of the lowest rank in one pass
            while i < len(ids):
                if i < len(got) and got[i] == low:
                    out.append(low & 0xFFFFF)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids


    def merge_many(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """``merge`` of many short pieces at once: every round makes each unfinished piece's best merge."""
        data = [p.encode() for p in pieces]
        size = np.array([len(d) for d in data])
        end = np.cumsum(size)
        raw = np.frombuffer(b"".join(data), np.uint8)
        sym = self.first_ids[raw]
        sym[end - 1] = self.last_ids[raw[end - 1]]
        word = np.repeat(np.arange(len(pieces)), size)
        out: list[tuple[int, ...]] = [()] * len(pieces)
        while len(sym):
            rank = np.full(len(sym), _NONE)
            rank[:-1] = np.where(word[1:] == word[:-1], self._ranks(sym[:-1], sym[1:]), _NONE)
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, start)
            done = best == _NONE
            if done.any():
                stop = np.append(start[1:], len(sym))
                flat = sym.tolist()
                for w, a, b in zip(word[start[done]].tolist(), start[done].tolist(), stop[done].tolist(), strict=True):
                    out[w] = tuple(flat[a:b])
            each = np.repeat(best, np.diff(np.append(start, len(sym))))
            at = np.flatnonzero((rank == each) & (each != _NONE))
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])] if len(at) else at
            keep = each != _NONE
            sym[at] = rank[at] & 0xFFFFF
            keep[at + 1] = False
            sym, word = sym[keep], word[keep]
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id of each pair, else _NONE, from an open-addressed table."""
        code = a.astype(np.int64) << 20 | b
        slot = (code * 0x9E3779B97F4A7C1 >> 20) & (_SLOTS - 1)
        out = np.full(len(code), _NONE)
        todo = np.arange(len(code))
        while len(todo):
            key = self.keys[slot[todo]]
            hit = key == code[todo]
            out[todo[hit]] = self.found[slot[todo[hit]]]
            todo = todo[~hit & (key >= 0)]
            slot[todo] = (slot[todo] + 1) & (_SLOTS - 1)
        return out


class Merger:
    """Merges one piece that comes in parts: ``push`` gives the tokens that nothing to come can change, ``finish`` the rest."""

    def __init__(self, merges: Merges, window: int):
        self.merges, self.window, self.data = merges, window, b""

    def push(self, part: str) -> list[int]:
        m, data, at, out = self.merges, self.data + part.encode(), 0, []
        stable = self.window - m.lookahead
        while len(data) - at > self.window:
            used = 0
            for i in m.merge([m.first[b] for b in data[at : at + self.window]]):
                n = len(m.strings[i])
                if used + n > stable:
                    break
                out.append(i)
                used += n
            at += used
        self.data = data[at:]
        return out

    def finish(self) -> list[int]:
        m, data = self.merges, self.data
        return m.merge([*(m.first[b] for b in data[:-1]), m.last[data[-1]]])


class Encoder:
    """``encode(text)`` yields lists of ids, block by block; ``prime(texts)`` first merges the new pieces of several texts together."""

    def __init__(self, merges: Merges, window: int = WINDOW, block: int = BLOCK):
        self.merges, self.window, self.block = merges, max(window, 4 * merges.lookahead), block
        self.find, self.spans = regex.compile(_PIECES).findall, regex.compile(_PIECES).finditer
        names = "|".join(regex.escape(s) for s in sorted(merges.special, key=len, reverse=True))
        self.special = regex.compile(f"({names})") if names else None
        self.memo: dict[str, tuple[int, ...]] = {}
        self.recent: dict[str, list[str]] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        merger = Merger(self.merges, self.window)
        ids = tuple(merger.push(piece) + merger.finish())
        if len(piece) <= 64:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = ids
        return ids

    def prime(self, texts: list[str]) -> None:
        """Merge the short pieces that are not in the memo; texts that ``encode`` cuts into blocks are left to it."""
        new: set[str] = set()
        for text in texts:
            if len(text) <= self.block and not (self.special and "<|" in text):
                new.update(self._pieces(text))
        new = [p for p in new if p not in self.memo and len(p) <= 64]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list({p for t in texts if len(t) <= self.block for p in self._pieces(t) if len(p) <= 64})
        if new:
            self.memo.update(zip(new, self.merges.merge_many(new), strict=True))

    def _pieces(self, block: str) -> list[str]:
        """The block's pieces; those of the last few blocks are kept."""
        got = self.recent.get(block)
        if got is None:
            if len(self.recent) >= 512:
                self.recent.clear()
            text = self._normal(block)
            got = self.find(text)
            if odd(text):  # cut as if the odd ones were marks
                got = [text[m.start() : m.end()] for m in self.spans(_OTHER.sub("#", text))]
            self.recent[block] = got
        return got

    def _normal(self, text: str) -> str:
        if odd(text):
            text = "".join(x if _MARK.match(x) else unicodedata.normalize("NFC", x) for x in _MARK.split(text)).translate(_SMALL)
        else:
            text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def _blocks(self, text: str) -> Iterator[tuple[str, bool]]:
        """(block, whether its last piece goes on in the next): cut at white space, or within a run where that does not change the pieces.

        Only a run without any such place (of letters that are neither ASCII nor Han, of unusual marks) makes a longer block.
        """
        at = 0
        while len(text) - at > self.block:
            cut = _SPACE_RUN.search(text, at + self.block, at + 2 * self.block)
            if cut:
                yield text[at : cut.start()], False
                at = cut.start()
                continue
            cut = _CUT.search(text, at + self.block)
            blank = _SPACE_RUN.search(text, at + 2 * self.block, cut.start() if cut else len(text))
            if blank or not cut:
                end = blank.start() if blank else len(text)
                yield text[at:end], False
                at = end
                continue
            yield text[at : cut.start()], not text[cut.start()].isdigit()
            at = cut.start()
        if at < len(text):
            yield text[at:], False

    def _stream(self, text: str) -> Iterator[list[int]]:
        """The ids of a text without special tokens, block by block; a piece that goes on from block to block is merged as it comes."""
        get, piece = self.memo.get, self._piece
        open_: Merger | None = None
        for block, goes_on in self._blocks(text):
            pieces, out = self._pieces(block), []
            if open_ and pieces:
                out += open_.push(pieces[0])
                pieces = pieces[1:]
                if pieces or not goes_on:
                    out += open_.finish()
                    open_ = None
            last = pieces[-1:] if goes_on else []
            out += chain.from_iterable([get(p) or piece(p) for p in (pieces[:-1] if last else pieces)])
            if last:
                open_ = Merger(self.merges, self.window)
                out += open_.push(last[0])
            yield out

    def encode(self, text: str) -> Iterator[list[int]]:
        for part in self.special.split(text) if self.special and "<|" in text else (text,):
            if self.special and part in self.merges.special:
                yield [self.merges.special[part]]
            else:
                yield from self._stream(part)


class Decoder:
    """``push(ids)`` returns the text they complete; ``finish()`` what is left."""

    def __init__(self, merges: Merges, mode: str = "tokens"):
        self.merges, self.mode, self.begun = merges, mode, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if self.mode == "tokens":
            out = " ".join(map(self.merges.strings.__getitem__, ids))
            out, self.begun = (" " + out if self.begun else out), True
            return out
        out = []
        for i in ids:
            s = self.merges.strings[i]
            if s in self.merges.special:
                out.append(self.utf8.decode(b"", final=True) + s)
                self.utf8.reset()
                continue
            bare = s.removesuffix(self.merges.end) if self.merges.end else s
            out.append(self.utf8.decode(bytes(self.merges.bytes[c] for c in bare)) + (" " if bare != s else ""))
        return "".join(out)

    def finish(self) -> str:
        return "" if self.mode == "tokens" else self.utf8.decode(b"", final=True)


_loaded: dict[int, tuple[Merges, Encoder]] = {}


def coder(source: str) -> tuple[Merges, Encoder]:
    """The tables of a tokenizer file's text, built once a process."""
    key = hash(source)
    if key not in _loaded:
        merges = Merges(source)
        _loaded[key] = merges, Encoder(merges)
    return _loaded[key]


def _primed(texts, encoder: Encoder, chars: int = 1 << 20) -> Iterator[str]:
    """The texts of an Arrow column (null: empty), the encoder primed with about ``chars`` code points at a time."""
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size > chars or len(held) >= 400:
            encoder.prime(held)
            yield from held
            encoder.recent.clear()
            held, size = [], 0
    encoder.prime(held)
    yield from held
    encoder.recent.clear()
    pa.default_memory_pool().release_unused()


def read_file(path: str | None = None) -> str:
    """The tokenizer file's text; by default the public word BPE of 49k tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, source: str) -> DataFrame:
    """(doc_id, ids) for every row of ``docs(doc_id, text)``; null and empty texts have no ids; other columns are ignored.

    ``source`` is the text of the tokenizer file, which is sent to the executors once (its size is fixed).
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(source)

    def run(batches):
        _, encoder = coder(shared.value)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for a in range(0, len(ids), 256):
                out = [list(chain.from_iterable(encoder.encode(t))) for t in _primed(texts.slice(a, 256), encoder)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, 256), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, source: str, mode: str = "tokens") -> DataFrame:
    """(doc_id, text) of ``rows(doc_id, ids)``; null ids give an empty text."""
    shared = ship(rows.sparkSession).sparkContext.broadcast(source)

    def run(batches):
        merges, _ = coder(shared.value)
        for batch in batches:
            out = []
            for ids in batch.column("ids"):
                decoder = Decoder(merges, mode)
                out.append(decoder.push(ids.as_py() or []) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return pick(rows, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, source: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoded and decoded again block by block, only digests kept.

    A row for every row of ``docs(doc_id, text)``, repeated ones too; null and empty texts have no tokens and the digests of nothing.  Long texts
    are coded block by block; equal texts get equal digests; other columns are ignored; an empty table gives no rows.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(source)

    def run(batches):
        merges, encoder = coder(shared.value)
        decimal = merges.decimal.__getitem__
        for batch in batches:
            n, a, b = [], [], []
            for text in _primed(batch.column("text"), encoder):
                count, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(merges)
                for ids in encoder.encode(text):
                    if ids:
                        ids_hash.update(((" " if count else "") + " ".join(map(decimal, ids))).encode())
                        text_hash.update(decoder.push(ids).encode())
                        count += len(ids)
                text_hash.update(decoder.finish().encode())
                n.append(count)
                a.append(ids_hash.hexdigest())
                b.append(text_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def coded(docs: DataFrame, source: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of every row of ``docs(doc_id, text)``: the ids, and a digest of what they decode to.

    Null and empty texts have no ids; a null doc_id stays null; repeated rows are each coded; other columns are ignored; no rows give no rows.
    """
    shared = ship(docs.sparkSession).sparkContext.broadcast(source)

    def run(batches):
        merges, encoder = coder(shared.value)
        for batch in batches:
            keys, texts = batch.column("doc_id"), batch.column("text")
            for a in range(0, len(keys), 256):
                ids = [list(chain.from_iterable(encoder.encode(t))) for t in _primed(texts.slice(a, 256), encoder)]
                back = [hashlib.sha256(Decoder(merges).push(x).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([keys.slice(a, 256), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``documents`` encoded and decoded with the public word BPE of 49k tokens."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), read_file())

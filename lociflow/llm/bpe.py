"""Byte-level BPE by a tokenization automaton.

The automaton reads tokens: it has a path for a sequence of tokens if and only if BPE makes that sequence of its text. It starts as
one state with a loop for each byte. The gadget of a merge (a, b) -> c takes the state q that a leads to; if q has an arc b, then c
leads where b led from q, every state with an arc a gets an arc c, and a leads from now on to a copy of q without the arc b. States
are thus copies of copies less one arc each, and are kept like that: `cuts[a]` holds, in order of time, the arcs that the copies which
a led to have lost, and what a token's first state had lost by then comes from its right part. An arc c that was added with the arc a
is there if a was there at the time. So the table is small, and every arc of it is found in a few look-ups; found arcs are kept.

For words the automaton is spelt out in bytes and made deterministic. Each place of a word is reached by exactly one path, so that a
state is: the tokens that paths to this place and to those before it end with, and for each of these the node that the bytes since lead
to in the trie of tokens, while longer tokens begin so. Its transitions are a row of a table, entered when first asked for; the table
is emptied when it is full. A word is encoded by one look-up for each byte, which gives the last token of the path to that place, and by
going back over those tokens from its end. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import gc
import json
import re
from array import array

import pandas as pd
from pyspark.sql import functions as F

from .shared import memory, uses_worker

INF = 1 << 60
#: Most entries of the memory of arcs, words and pieces, letters of a word in it, and states of the table (1 KB each).
KEPT, LETTERS, STATES = 300_000, 64, 200_000
_ROW = array("i", [-1]) * 256


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary file, by the public rule of byte-level BPE."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled from a `tokenizers` file's text; see the module."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.labels: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.labels[i] = content.encode()
        n = max(self.labels) + 1
        self.decimals = [str(i) for i in range(n)]
        self.left, self.right, self.made = [-1] * n, [-1] * n, [0] * n
        self.cuts: list[dict[int, int]] = [{} for _ in range(n)]
        self.live = {i for i in ids.values() if len(self.labels[i]) == 1}
        for time, pair in enumerate(spec["model"]["merges"], 1):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self._gadget(ids[a], ids[b], ids[a + b], time)
        self.sizes = [len(self.labels.get(i, b"")) for i in range(n)]
        self.following: list[dict[int, int]] = [{}]  # the trie: by node and byte, the next node
        self.ends = [-1]  # by node, the token that ends there or -1
        for i in self.live:
            node = 0
            for byte in self.labels[i]:
                node = self.following[node].setdefault(byte, len(self.ends))
                if node == len(self.ends):
                    self.following.append({})
                    self.ends.append(-1)
            self.ends[node] = i
        self.arcs: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        self._empty()

    def _empty(self) -> None:
        """The table with the first state alone."""
        self.table = array("i")  # by state and byte, the next state or -1
        self.last: list[int] = []  # by state, the last token of the path
        self.items: list[tuple[int, ...]] = []  # by state, the open places, the earliest first: (last token + 1) << 20 | trie node
        self.states: dict[tuple[int, ...], int] = {}
        self._state((0,))

    def _state(self, items: tuple[int, ...]) -> int:
        n = self.states[items] = len(self.items)
        self.items.append(items)
        self.last.append((items[-1] >> 20) - 1)
        self.table.extend(_ROW)
        return n

    def _gadget(self, a: int, b: int, c: int, time: int) -> None:
        if a not in self.live or b not in self.live or not self.has_arc(a, b):
            return  # no state that a leads to has an arc b: the merge never happens
        if c in self.live:
            raise ValueError("two merges make the same token")
        self.left[c], self.right[c], self.made[c] = a, b, time
        self.live.add(c)
        self.cuts[a][b] = time

    def has_arc(self, last: int, token: int) -> bool:
        """Whether the state that `last` leads to has an arc `token`."""
        x, until = last, INF
        while True:
            cuts = self.cuts[x]
            if cuts:
                y, before = token, INF
                while True:
                    cut = cuts.get(y, INF)
                    if cut < until and cut <= before:  # equal: a merge of a token with itself, which takes the left pair
                        return False
                    if self.left[y] < 0:
                        break
                    before = self.made[y]
                    y = self.left[y]
            if self.right[x] < 0:
                return True
            until = self.made[x] if self.made[x] < until else until
            x = self.right[x]

    def _arc(self, item: int) -> bool:
        """Whether the state that a token leads to has an arc; both are in the key as in an item, with the arc for the node."""
        if len(self.arcs) >= KEPT * 4:
            self.arcs.clear()
        last = (item >> 20) - 1
        ok = self.arcs[item] = last < 0 or self.has_arc(last, item & 0xFFFFF)
        return ok

    def _step(self, state: int, byte: int) -> int:
        """Computes a transition of the table."""
        token, items, following, ends, arcs = -1, [], self.following, self.ends, self.arcs
        for item in self.items[state]:
            x = following[item & 0xFFFFF].get(byte)
            if x is not None:
                last = item & ~0xFFFFF
                if token < 0 and ends[x] >= 0:
                    ok = arcs.get(last | ends[x])
                    if self._arc(last | ends[x]) if ok is None else ok:
                        token = ends[x]
                if following[x]:
                    items.append(last | x)
        if token < 0:
            raise ValueError(f"no token spells the byte {byte}")
        items.append(token + 1 << 20)
        key = tuple(items)
        to = self.states.get(key)
        if to is None:
            if len(self.items) >= STATES:
                self._empty()
                return self._state(key)
            to = self._state(key)
        self.table[state << 8 | byte] = to
        return to

    def encode_word(self, word: bytes) -> list[int]:
        """The path that spells the word, in time and memory linear in its length."""
        state, path = 0, []
        table, last = self.table, self.last
        for byte in word:
            to = table[state << 8 | byte]
            if to < 0:
                to = self._step(state, byte)
                table, last = self.table, self.last
            state = to
            path.append(last[state])
        out, i, sizes = [], len(word), self.sizes
        while i:
            token = path[i - 1]
            out.append(token)
            i -= sizes[token]
        out.reverse()
        return out

    def decode(self, ids) -> str:
        """Text of the arcs' labels; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


#: Fixed value: the public pattern that splits text into words; white space is Unicode's property, not that of Python's str.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))

#: Whether a space stands before other white space or at the end.
BROKEN = re.compile(" (?=[" + "".join(sorted(WHITE - {" "})) + "]|$)").search


class Coder:
    """Encodes whole texts with an automaton. A text is cut before each space that a non-space follows, where words always begin."""

    def __init__(self, text: str):
        import regex

        self.automaton = Automaton(text)
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.automaton.special)) + ")").split if self.automaton.special else None
        self.pieces: dict[str, list[int]] = {}
        self.emitted: dict[str, tuple[int, str, bytes]] = {}

    def _piece(self, piece: str) -> list[int]:
        a, out = self.automaton, []
        for word in self.find(piece):
            ids = a.words.get(word)
            if ids is None:
                ids = a.encode_word(word.encode())
                if len(word) <= LETTERS:
                    if len(a.words) >= KEPT:
                        a.words.clear()
                    a.words[word] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        special = self.automaton.special
        if self.split and any(s in text for s in special):
            out = []
            for part in self.split(text):
                if part in special:
                    out.append(special[part])
                elif part:
                    self._plain(part, out)
            return out
        return self._plain(text, [])

    @staticmethod
    def cut(text: str) -> list[str]:
        parts = text.split(" ")
        if "  " not in text and not BROKEN(text):
            pieces = [" " + p for p in parts]
            pieces[0] = parts[0]
            return pieces
        pieces = [parts[0]]
        for p in parts[1:]:
            if p and p[0] not in WHITE:
                pieces.append(" " + p)
            else:
                pieces[-1] += " " + p
        return pieces

    def _plain(self, text: str, out: list[int]) -> list[int]:
        known = self.pieces
        for p in self.cut(text):
            ids = known.get(p)
            if ids is None:
                ids = self._piece(p)
                if len(p) <= LETTERS:
                    if len(known) >= KEPT:
                        known.clear()
                    known[p] = ids
            out += ids
        return out

    def emit(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, their ids in decimal with commas, and the text that the labels of their arcs spell."""
        special, labels, decimals = self.automaton.special, self.automaton.labels, self.automaton.decimals
        known, out = self.emitted, []
        parts = self.split(text) if self.split and any(s in text for s in special) else [text]
        for part in parts:
            if part in special:
                i = special[part]
                out.append((1, decimals[i], labels[i]))
                continue
            for p in self.cut(part) if part else ():
                x = known.get(p)
                if x is None:
                    ids = self._piece(p)
                    if not ids:
                        continue
                    x = (len(ids), ",".join([decimals[i] for i in ids]), b"".join([labels[i] for i in ids]))
                    if len(p) <= LETTERS:
                        if len(known) >= KEPT:
                            known.clear()
                        known[p] = x
                out.append(x)
        if not out:
            return 0, "", ""
        counts, texts, spelt = zip(*out)
        return sum(counts), ",".join(texts), b"".join(spelt).decode("utf-8", "replace")


_CODERS: dict[int, Coder] = {}
memory("bpe", _CODERS.clear)


def coder(text: str) -> Coder:
    """The coder of a tokenizer file's text, one for each Python worker."""
    uses_worker("bpe")
    key = hash(text)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(text)
        gc.freeze()  # the tables hold no cycles; without them collections stay short, and need not be frequent
        gc.set_threshold(200_000, 50, 50)
    return _CODERS[key]


def encode_udf(text: str):
    """Column function: the ids of a text; null and empty texts have none."""
    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        c = coder(text)
        return pd.Series([c.encode(t) if t else [] for t in texts], dtype=object)

    return encode


def decode_udf(text: str):
    """Column function: the text of ids; null ids give null."""
    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        a = coder(text).automaton
        return pd.Series([None if x is None else a.decode(x.tolist() if hasattr(x, "tolist") else x) for x in ids], dtype=object)

    return decode


def digest_udf(text: str):
    """Column function: token count, SHA-256 of the ids in decimal with commas, SHA-256 of the decoded text.

    Encodes and decodes in one pass, so that ids do not travel. Null and empty texts: no tokens, digests of the empty string.
    """
    import hashlib

    @F.pandas_udf("struct<n:bigint,ids:string,decoded:string>")
    def digest(texts: pd.Series) -> pd.DataFrame:
        c = coder(text)
        rows = []
        for t in texts:
            n, ids, spelt = c.emit(t) if t else (0, "", "")
            rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(spelt.encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n", "ids", "decoded"])

    return digest
